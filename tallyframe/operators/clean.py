"""Cleaning: projection, casts, admission, enrichment, imputation, dedup.

P1-P11, D1, D2, D4. Every step is row-local except the two dedups, which are
aggregations. The keyed one combines duplicates map-side before the shuffle,
so a key that holds a large share of the rows never lands in one task whole;
the exact one deals rows by a hash of all columns first (``distinct_rows``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.categories import expense_category, standard_category
from tallyframe.functions.money import parse_money, strict_cast, tolerant_bigint
from tallyframe.functions.text import impute, short_name, upper_trim
from tallyframe.plans.ledger import DENIED_DEPARTMENTS

# Source column -> detail column (all trimmed text unless typed below).
RAW_TO_DETAIL = (
    ("SORDER", "sort_order"),
    ("DEPARTMENT", "department_code"),
    ("UACS_DPT_DSC", "department_name"),
    ("AGENCY", "agency_code"),
    ("UACS_AGY_DSC", "agency_name"),
    ("PREXC_FPAP_ID", "program_id"),
    ("PREXC_LEVEL", "program_level"),
    ("DSC", "program_description"),
    ("OPERUNIT", "oper_unit"),
    ("UACS_OPER_DSC", "oper_unit_description"),
    ("UACS_REG_ID", "region_id"),
    ("UACS_OPERDIV_ID", "division_id"),
    ("UACS_DIV_DSC", "division_description"),
    ("FUNDCD", "fund_code"),
    ("UACS_FUNDSUBCAT_DSC", "fund_subcategory"),
    ("UACS_EXP_CD", "expense_class_code"),
    ("UACS_EXP_DSC", "expense_class"),
    ("UACS_OBJ_CD", "object_code"),
    ("UACS_OBJ_DSC", "object_description"),
    ("AMT", "amount_thousands"),
)
# sort_order is BIGINT (not INTEGER) so it survives ledgers beyond 2^31 rows.
STRICT_TYPES = {"sort_order": "bigint", "program_level": "int"}
OTHER_GROUPS = 1024           # groups over which rows that are not admitted are counted
TASK_ROWS = 500_000           # rows that a task sorts by key before the shuffle
FEW_TASKS = 4                 # tables of at most so many such tasks are not dealt


def _rule(deny) -> Column:
    # NULL text and text that does not cast make NULL comparisons, which admit nothing: one cast is enough
    dept = F.trim(F.col("UACS_DPT_DSC"))
    return (tolerant_bigint(F.col("AMT")) > 0) & (dept != "") & ~dept.isin(*deny)


def admit(raw: DataFrame, deny=DENIED_DEPARTMENTS) -> DataFrame:
    """Amount castable and > 0; department name present, non-empty, not denied."""
    return raw.where(_rule(deny))


def admitted(deny=DENIED_DEPARTMENTS) -> Column:
    """The rule of P4 as a flag that is never NULL."""
    return F.coalesce(_rule(deny), F.lit(False))


def detail_columns() -> list[Column]:
    """P1 + P2 + P3: rename to snake_case, trim text, strict/tolerant casts."""
    cols = []
    for src, dst in RAW_TO_DETAIL:
        if dst == "amount_thousands":
            cols.append(tolerant_bigint(F.col(src)).alias(dst))
        elif dst in STRICT_TYPES:
            cols.append(strict_cast(F.col(src), STRICT_TYPES[dst]).alias(dst))
        else:
            cols.append(F.trim(F.col(src)).alias(dst))
    return cols


def project(raw: DataFrame) -> DataFrame:
    return raw.select(detail_columns())


def enrich(cleaned: DataFrame) -> DataFrame:
    """P8 + P5 + P7: amount in pesos, broad expense category, department short name."""
    return cleaned.select(
        "*",
        (F.col("amount_thousands") * 1000).alias("amount_php"),
        expense_category("expense_class").alias("expense_category"),
        short_name("department_name").alias("department_short"),
    )


def ingest(raw: DataFrame, deny=DENIED_DEPARTMENTS) -> DataFrame:
    """Raw text ledger -> budget detail: admit, project, exact DISTINCT (D1), enrich."""
    return enrich(distinct_rows(project(admit(raw, deny))))


def distinct_rows(df: DataFrame) -> DataFrame:
    """DISTINCT with the rows dealt by their hash first.

    Ledger rows are nearly all different, so combining them before the shuffle holds (and spills) all
    that a task makes and shrinks nothing. Dealt first, they are combined once, in the tasks they go to;
    copies of a row meet there one by one and take the room of one row.
    """
    return df.repartition(*[F.col(c) for c in df.columns]).distinct()


def castable(amt: Column) -> Column:
    """Amounts that the tolerant cast takes (the 'before' of D4 in the ingest)."""
    return tolerant_bigint(amt).isNotNull()


def ingest_groups(raw: DataFrame, deny=DENIED_DEPARTMENTS) -> DataFrame:
    """The DISTINCT of the ingest with ``_n``, the raw rows of each distinct admitted row, and flags.

    Rows that are not admitted carry NULLs and are dealt over groups by a hash of theirs. Dealt before
    they are combined, as in ``distinct_rows``.
    """
    row = F.xxhash64(*[F.col(src) for src, _ in RAW_TO_DETAIL])
    ok = raw.select("*", castable(F.col("AMT")).alias("_castable"), admitted(deny).alias("_admitted"))
    names = [dst for _, dst in RAW_TO_DETAIL]
    cols = [F.when(F.col("_admitted"), c).alias(dst) for c, dst in zip(detail_columns(), names, strict=True)]
    other = F.when(~F.col("_admitted"), F.pmod(row, F.lit(OTHER_GROUPS))).alias("_other")
    keys = ["_castable", "_admitted", "_other", *names]
    return (ok.select("_castable", "_admitted", other, *cols).repartition(*[F.col(k) for k in keys])
            .groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")))


def detail_of(groups: DataFrame) -> DataFrame:
    """The budget detail from ``ingest_groups``: the rows of ``ingest``."""
    return enrich(groups.where("_admitted").select(*[dst for _, dst in RAW_TO_DETAIL]))


def counts_of(groups: DataFrame) -> DataFrame:
    """S11 + D4 (ingest) from ``ingest_groups``: rows raw, castable, and distinct after admission."""
    zero = F.lit(0).cast("bigint")
    return groups.agg(F.coalesce(F.sum("_n"), zero).alias("raw"),
                      F.coalesce(F.sum(F.when(F.col("_castable"), F.col("_n"))), zero).alias("castable"),
                      F.count_if("_admitted").alias("final"))


def ingest_counts(raw: DataFrame, deny=DENIED_DEPARTMENTS) -> DataFrame:
    """S11 + D4 (ingest) in one pass: rows raw, castable, and distinct after admission."""
    return counts_of(ingest_groups(raw, deny))


def ingest_removed(raw: DataFrame) -> DataFrame:
    """D4 (ingest): castable rows before vs final rows, and the difference."""
    return ingest_counts(raw).select(F.col("castable").alias("before_rows"), F.col("final").alias("after_rows"),
                                     (F.col("castable") - F.col("final")).alias("removed_rows"))


# ---------------------------------------------------------------- workshop

def stage(raw: DataFrame) -> DataFrame:
    """P2 + P9 + P10 + P11 + P6: the workshop's cleaned, typed columns."""
    return raw.select(
        strict_cast(F.trim(F.col("id")), "bigint").alias("id"),
        upper_trim("department").alias("department"),
        impute("agency", "Unspecified Agency").alias("agency"),
        parse_money("amount").alias("amount"),
        standard_category("category").alias("category"),
        F.coalesce(F.nullif(upper_trim("region"), F.lit("")), F.lit("UNASSIGNED")).alias("region"),
    )


def dedup_keyed(df: DataFrame, keys=("department", "agency", "amount", "category"),
                order=("id",)) -> DataFrame:
    """One row per key, the one with the smallest ``order`` tuple.

    Same rows as ROW_NUMBER() OVER (PARTITION BY keys ORDER BY amount DESC,
    id ASC) = 1 -- amount is itself a key, so it never breaks a tie -- but as
    a min-aggregate: partial mins are taken map-side, so a hot key costs one
    row per task in the shuffle instead of a sort of the whole group. The
    remaining columns break exact ties deterministically.
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys and c not in order]
    pick = F.min(F.struct(*[F.col(c) for c in (*order, *rest)])).alias("_pick")
    out = df.groupBy(*keys).agg(pick)
    return out.select(*[F.col(f"_pick.{c}").alias(c) if c not in keys else F.col(c)
                        for c in df.columns])


def dealt(df: DataFrame, rows: int, per_task: int = TASK_ROWS) -> DataFrame:
    """``df`` of about ``rows`` rows in tasks of about ``per_task``, by a hash of all columns.

    The tasks of a join are cut by the bytes of its narrow input; one that sorts its rows by key would hold
    as many as fit there. Few rows stay as they are.
    """
    tasks = -(-rows // per_task)
    return df.repartition(tasks, *[F.col(c) for c in df.columns]) if tasks > FEW_TASKS else df


def clean_workshop(raw: DataFrame) -> DataFrame:
    return dedup_keyed(stage(raw))


def removed_rows(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows before, after and removed, as one row."""
    b = before.agg(F.count(F.lit(1)).alias("before_rows"))
    after_rows = after.agg(F.count(F.lit(1))).scalar()
    return b.select("before_rows", after_rows.alias("after_rows"),
                    (F.col("before_rows") - after_rows).alias("removed_rows"))


def keyed_removed(df: DataFrame, keys=("department", "agency", "amount", "category")) -> DataFrame:
    """D4 of the keyed dedup (D2) in one pass: a count per key gives the rows before and after."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return per_key.select("_n").agg(
        F.coalesce(F.sum("_n"), F.lit(0).cast("bigint")).alias("before_rows"), F.count(F.lit(1)).alias("after_rows"),
        (F.coalesce(F.sum("_n"), F.lit(0).cast("bigint")) - F.count(F.lit(1))).alias("removed_rows"))
