"""Report labels: peso abbreviation (F1), grouped thousands (F3), scaling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe.functions.money import dround
from tallyframe.functions.util import as_col

PESO = "₱"

# Decimal places per unit, (trillion, billion, million, thousand); None = unit unused.
WORKSHOP_DECIMALS = (2, 2, 1, 0)
DASHBOARD_DECIMALS = (2, 1, 0, None)
SUMMARY_DECIMALS = (2, 1, 1, None)
TABLE_DECIMALS = (None, 2, 1, 0)
MAP_DECIMALS = (None, 1, 0, None)


def fixed(x: Column, digits: int) -> Column:
    """Half-up rounded value printed with exactly ``digits`` places ('%.nf')."""
    return dround(x, digits).cast(f"decimal(38,{digits})").cast("string")


def thousands(c) -> Column:
    """grouped thousands with up to three fraction places ('1,234,567', '999.5'), rounded half up."""
    rounded = F.round(as_col(c).cast("decimal(38,10)"), 3)
    return F.call_function("format_number", rounded, F.lit("#,##0.###"))


def abbrev(c, decimals=WORKSHOP_DECIMALS, symbol: str = PESO) -> Column:
    """F1: '₱1.23T' / '₱4.5B' / '₱6.0M' / '₱7K', else grouped digits.

    ``decimals`` gives the places per unit; a None unit is skipped. Rounding
    is done on the decimal value, so labels agree across engines.
    """
    v = as_col(c).cast("double")
    units = ((1e12, "T"), (1e9, "B"), (1e6, "M"), (1e3, "K"))
    out = None
    for (scale, suffix), d in zip(units, decimals):
        if d is None:
            continue
        label = F.concat(F.lit(symbol), fixed(v / F.lit(scale), d), F.lit(suffix))
        out = F.when(v >= scale, label) if out is None else out.when(v >= scale, label)
    small = F.concat(F.lit(symbol), thousands(v))
    return small if out is None else out.otherwise(small)


def billions(c, digits: int = 2) -> Column:
    """Value in billions."""
    return dround(as_col(c).cast("double") / F.lit(1e9), digits)
