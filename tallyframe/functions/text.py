"""Text standardisation (P7, P9, P10) and label truncation (F2)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe.functions.util import as_col


def upper_trim(c) -> Column:
    """Case and whitespace standardisation."""
    return F.upper(F.trim(as_col(c)))


def blank_to_null(c) -> Column:
    return F.nullif(F.trim(as_col(c)), F.lit(""))


def impute(c, default: str) -> Column:
    """P10: COALESCE(NULLIF(TRIM(c), ''), default)."""
    return F.coalesce(blank_to_null(c), F.lit(default))


def short_name(c) -> Column:
    """Text inside the first '(' and the first ')' after it, else the whole name.

    A name without '(' or without a ')' after it keeps the full name (the
    reference's negative-length SUBSTRING is not reproduced).
    """
    c = as_col(c)
    open_at = F.instr(c, "(")
    tail = c.substr(open_at + 1, F.length(c))
    close_in_tail = F.instr(tail, ")")
    return F.when((open_at > 0) & (close_in_tail > 0),
                  tail.substr(F.lit(1), close_in_tail - 1)).otherwise(c)


def truncate_label(c, max_len: int, keep: int, ellipsis: str = "…") -> Column:
    """labels longer than ``max_len`` become their first ``keep`` chars + ellipsis."""
    c = as_col(c)
    return F.when(F.length(c) > max_len, F.concat(c.substr(1, keep), F.lit(ellipsis))).otherwise(c)
