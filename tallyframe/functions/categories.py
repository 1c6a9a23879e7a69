"""Category mappings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe.functions.text import impute, upper_trim
from tallyframe.functions.util import as_col

# Expense class -> broad expense category (exact match, else 'Other').
EXPENSE_CATEGORY = {
    "Personnel Services": "PS",
    "Maintenance and Other Operating Expenses": "MOOE",
    "Capital Outlays": "CO",
    "Financial Expenses": "FE",
}
EXPENSE_CATEGORY_OTHER = "Other"
EXPENSE_DOMAIN = ("PS", "MOOE", "CO", "FE", "Other")


def expense_category(c) -> Column:
    """P5: exact-match CASE map of the expense class."""
    c = as_col(c)
    out = None
    for cls, code in EXPENSE_CATEGORY.items():
        out = F.when(c == cls, code) if out is None else out.when(c == cls, code)
    return out.otherwise(EXPENSE_CATEGORY_OTHER)


def standard_category(c) -> Column:
    """prefix/equality standardisation on UPPER(TRIM(c)), else impute."""
    u = upper_trim(c)
    return (F.when(u.startswith("PERSONNEL"), "Personnel Services")
            .when(u == "MOOE", "MOOE")
            .when(u.startswith("CAPITAL"), "Capital Outlays")
            .otherwise(impute(c, "Uncategorized")))
