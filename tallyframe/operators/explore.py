"""Filters, search, top-k, paging and drill-downs.

Top-k is ``orderBy(...).limit(k)``, which Spark plans as TakeOrderedAndProject:
each task keeps a k-row heap, so nothing but k rows per task crosses the
network. Every ordering ends in a tie-breaker so results are deterministic.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.format import billions
from tallyframe.functions.money import money_sum
from tallyframe.functions.text import truncate_label
from tallyframe.functions.util import as_col
from tallyframe.operators.lattice import COUNT, Lattice

SEARCH_COLUMNS = ("object_description", "agency_name", "program_description", "department_short")
GROUP_DIMENSIONS = ("department", "category", "region", "agency")
PAGE_SIZE = 50
PAGE_TIES = ("department_short", "agency_name", "program_description", "expense_category", "object_description")
ALL = "All"


def _order(cols, desc=False) -> list[Column]:
    out = []
    for c in cols:
        c = as_col(c)
        out.append(c.desc_nulls_last() if desc else c.asc_nulls_last())
    return out


def active_filters(filters: dict | None) -> dict:
    """The filters that filter: None and 'All' mean none."""
    return {c: v for c, v in (filters or {}).items() if v is not None and v != ALL}


def equality_filter(df: DataFrame, filters: dict | None = None) -> DataFrame:
    """AND of ``col == value`` for each given filter; None/'All' means no filter.

    Values are bound as literals, never spliced into SQL text.
    """
    conds = [F.col(c) == F.lit(v) for c, v in active_filters(filters).items()]
    return df.where(reduce(lambda a, b: a & b, conds)) if conds else df


def search(df: DataFrame, text: str | None, columns=SEARCH_COLUMNS, wildcards: bool = False) -> DataFrame:
    """Case-insensitive substring match OR-ed over ``columns``.

    Default is a literal match (``%``, ``_``, quotes and backslashes are plain
    characters). ``wildcards=True`` gives ILIKE semantics with ``%``/``_``
    live and backslash taken literally.
    """
    if text is None or not text.strip():
        return df
    s = text.strip()
    if wildcards:
        pattern = "%" + s.replace("\\", "\\\\") + "%"
        conds = [as_col(c).ilike(pattern) for c in columns]
    else:
        needle = F.lower(F.lit(s))
        conds = [F.contains(F.lower(as_col(c)), needle) for c in columns]
    return df.where(reduce(lambda a, b: a | b, conds))


def not_equal_not_null(df: DataFrame, column: str, value) -> DataFrame:
    """``column != value AND column IS NOT NULL``."""
    return df.where(_not_equal_not_null(column, value))


def _not_equal_not_null(column: str, value) -> Column:
    return (F.col(column) != F.lit(value)) & F.col(column).isNotNull()


def top_k(df: DataFrame, by: str, k: int | None, tie=(), desc: bool = True) -> DataFrame:
    """The k largest (or smallest) rows by ``by``, ties broken by ``tie``; k=None is all."""
    ordered = df.orderBy(*_order([by], desc), *_order(tie))
    return ordered if k is None else ordered.limit(k)


def for_display(df: DataFrame, by: str, tie=()) -> DataFrame:
    """Re-order a top-k result ascending for display."""
    return df.orderBy(*_order([by]), *_order(tie, desc=True))


def sum_amount(c: str = "amount") -> Column:
    """SUM of a DECIMAL(18,2) workshop amount, as decimal(38,2)."""
    return F.sum(F.col(c)).cast("decimal(38,2)")


def totals_by(df: DataFrame | Lattice, dim: str, label: str | None = None, k: int | None = None,
              filters: dict | None = None, amount: str = "amount") -> DataFrame:
    """SUM(amount) per ``dim`` under optional filters, top k by total.

    A lattice answers from its smallest grain that has the columns.
    """
    if isinstance(df, Lattice):
        out = df.totals([dim], active_filters(filters)).select(dim, F.col(amount).alias("total"))
    else:
        out = equality_filter(df, filters).groupBy(dim).agg(sum_amount(amount).alias("total"))
    if label:
        out = out.withColumnRenamed(dim, label)
    return top_k(out, "total", k, tie=(label or dim,))


def total(df: DataFrame | Lattice, filters: dict | None = None, amount: str = "amount") -> DataFrame:
    """SUM(amount) of all rows under optional filters."""
    if isinstance(df, Lattice):
        return df.totals((), active_filters(filters)).select(F.col(amount).alias("total"))
    return equality_filter(df, filters).agg(sum_amount(amount).alias("total"))


def dynamic_group(df: DataFrame | Lattice, dim: str, region: str | None = ALL, category: str | None = ALL,
                  k: int = 20) -> DataFrame:
    """One of four dimensions (checked against an allow-list) as ``label``, top 20."""
    if dim not in GROUP_DIMENSIONS:
        raise ValueError(f"group-by dimension must be one of {GROUP_DIMENSIONS}, got {dim!r}")
    return totals_by(df, dim, label="label", k=k, filters={"region": region, "category": category})


def filtered_count(df: DataFrame | Lattice, filters: dict | None = None, text: str | None = None,
                   page_size: int = PAGE_SIZE) -> DataFrame:
    """A12 + T5: filtered row count and the number of pages. A search reads the detail of a lattice."""
    if isinstance(df, Lattice):
        if text is None or not text.strip():
            n = F.coalesce(F.col(COUNT), F.lit(0).cast("bigint"))
            return df.totals((), active_filters(filters)).select(
                n.alias("rows"), F.ceil(n / F.lit(page_size)).cast("bigint").alias("pages"))
        df = df.detail
    n = F.count(F.lit(1))
    return search(equality_filter(df, filters), text).agg(
        n.alias("rows"), F.ceil(n / F.lit(page_size)).cast("bigint").alias("pages"))


def distinct_options(df: DataFrame | Lattice, column: str) -> DataFrame:
    """Distinct values of a dimension, sorted."""
    if isinstance(df, Lattice):
        df = df.totals([column])
    return df.select(column).distinct().orderBy(F.col(column).asc_nulls_last())


def page(df: DataFrame, order_by: str = "amount_php", desc: bool = True, page_no: int = 0,
         page_size: int = PAGE_SIZE, columns=None, filters: dict | None = None,
         text: str | None = None) -> DataFrame:
    """T4: filter + search, ORDER BY one column, LIMIT page_size OFFSET page_no*page_size.

    Ties are broken by the other displayed columns (rows equal in all of them
    look identical). Plans as TakeOrderedAndProject(limit, offset); for deep
    pages use ``page_after`` (keyset), which needs no offset heap.
    """
    if order_by not in ("amount_php", "department_short"):
        raise ValueError("order_by must be amount_php or department_short")
    columns = list(columns or ("department_short", "agency_name", "program_description",
                               "expense_category", "object_description", "amount_php"))
    base = search(equality_filter(df, filters), text).select(*columns)
    tie = [c for c in columns if c != order_by]
    ordered = base.orderBy(*_order([order_by], desc), *_order(tie))
    return ordered.offset(page_no * page_size).limit(page_size)


def page_after(df: DataFrame, order_by: str, last, page_size: int = PAGE_SIZE, desc: bool = True, tie=()) -> DataFrame:
    """T4 (deep pages): the rows after ``last`` in the order of ``order_by`` and then ``tie`` ascending.

    ``last`` holds the last row's values of these columns (a bare value without ties). Rows that tie
    with it in the first columns are compared by the next ones; nulls come last. A predicate and a
    k-row top-k: the cost does not grow with the page's number.
    """
    columns = [order_by, *tie]
    values = list(last) if isinstance(last, (tuple, list)) else [last]
    if len(values) != len(columns):
        raise ValueError(f"last needs a value for each of {columns}")
    return df.where(beyond(columns, values, desc)).orderBy(*_order([order_by], desc), *_order(tie)).limit(page_size)


def beyond(columns, values, desc: bool = True, inclusive: bool = False) -> Column:
    """Rows after the row of these ``values`` (with ``inclusive`` also equal ones): the first column descending or
    ascending, the others ascending, nulls last."""
    cond = F.lit(inclusive)
    for i, (c, v) in reversed(list(enumerate(zip(columns, values, strict=True)))):
        col = F.col(c)
        if v is None:                       # nulls are last: only ties can follow
            cond = col.isNull() & cond
        else:
            later = col < F.lit(v) if desc and i == 0 else col > F.lit(v)
            cond = F.coalesce(later, F.lit(True)) | (col.eqNullSafe(F.lit(v)) & cond)
    return cond


def special_funds(detail: DataFrame | Lattice, exclude: str, k: int = 15) -> DataFrame:
    """A6 (+P14, F2, M17): funds other than ``exclude``; count, total, top 15; labels."""
    fund = "fund_subcategory"
    if isinstance(detail, Lattice):
        out = detail.totals([fund], where=_not_equal_not_null(fund, exclude), where_columns=[fund]).select(
            fund, F.col(COUNT).alias("line_items"), F.col("amount_php").alias("total_php"))
    else:
        out = not_equal_not_null(detail, fund, exclude).groupBy(fund).agg(
            F.count(F.lit(1)).alias("line_items"), money_sum("amount_php").alias("total_php"))
    out = top_k(out, "total_php", k, tie=(fund,))
    return out.select("*", truncate_label(fund, 40, 38).alias("label"),
                      billions("total_php", 1).alias("total_b"))


def displayed_total(top: DataFrame, column: str = "total_php", alias: str = "displayed_total") -> DataFrame:
    """Total of the displayed (top-k) rows."""
    return top.agg(F.sum(column).alias(alias))


def drill_down(agg_agency: DataFrame, department_short: str) -> DataFrame:
    """Roll-up rows of one department, by total."""
    return top_k(agg_agency.where(F.col("department_short") == F.lit(department_short))
                 .select("agency_name", "expense_category", "total_php"),
                 "total_php", None, tie=("agency_name", "expense_category"))
