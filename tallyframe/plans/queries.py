"""All registered queries, grouped by SURVEY section."""

from tallyframe.plans import q_analytics, q_explore, q_geo, q_ingest, q_quality  # noqa: F401
