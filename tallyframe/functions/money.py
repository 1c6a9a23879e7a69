"""Casts for text amounts (P2, P3, P11) and exact report rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe.functions.util import as_col


def strict_cast(c, to: str) -> Column:
    """A malformed non-null value aborts the job (independent of ANSI mode)."""
    c = as_col(c)
    v = c.try_cast(to)
    return F.when(c.isNotNull() & v.isNull(),
                  F.raise_error(F.concat(F.lit(f"malformed value for {to}: "), c))).otherwise(v)


def tolerant_bigint(c) -> Column:
    """Text -> BIGINT, malformed -> NULL, fractions rounded half away from zero.

    Goes through decimal(38,10) so '2.5' -> 3, '1e3' -> 1000, '1_000' -> 1000 and '1,000' -> NULL,
    the meaning of the reference's tolerant integer cast.
    """
    c = as_col(c)
    # fast path: plain integer text parses straight to BIGINT (no decimal object); only text that
    # fails it and holds an underscore pays for taking separators out
    plain = F.when(F.instr(c, "_") > 0, F.regexp_replace(c, "(?<=[0-9])_(?=[0-9])", "")).otherwise(c)
    return F.coalesce(c.try_cast("bigint"), F.round(plain.try_cast("decimal(38,10)"), 0).try_cast("bigint"))


def parse_money(c) -> Column:
    """Strip commas, tolerant DOUBLE, missing -> 0.0, stored as DECIMAL(18,2)."""
    cleaned = F.replace(F.trim(as_col(c)), F.lit(","), F.lit(""))
    return F.coalesce(cleaned.try_cast("double"), F.lit(0.0)).cast("decimal(18,2)")


def money_sum(c) -> Column:
    """SUM of a money column as decimal(38,0): never overflows like a 64-bit sum."""
    return F.sum(as_col(c).cast("decimal(38,0)"))


def dround(x, digits: int) -> Column:
    """Round a double half-up through decimal(38,10), then back to double.

    Rounding a double directly differs between engines near ties (1.005);
    rounding its decimal form is exact and identical everywhere.
    """
    return F.round(as_col(x).try_cast("decimal(38,10)"), digits).cast("double")   # NULL beyond 1e28


def pct(part, total, digits: int = 1) -> Column:
    """Share of ``total`` in percent, rounded to ``digits`` (NULL when total is 0)."""
    p = as_col(part).cast("double") * F.lit(100.0) / F.nullif(as_col(total).cast("double"), F.lit(0.0))
    return dround(p, digits)
