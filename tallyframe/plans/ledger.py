"""Ledger-shaped views over the TPC-H-like test tables.

The test tables are clean, so two views stand in for the reference's inputs:

* ``raw_ledger``: the 20 all-text source columns of a budget workbook, with
  dirt added by fixed rules (deny-listed departments, padded lower-case
  names, missing agencies, 'N/A' / '' / '-5' / '.50' / comma-grouped amounts)
  and exact duplicate rows.
* ``workshop_raw``: the 6-column dirty CSV shape (id, department, agency,
  amount, category, region).

Both come from one join of lineitem with orders, part and supplier->nation.
Dimension joins are left to Catalyst: nation/region are fixed-size (25/5 rows)
and broadcast explicitly; part/supplier/orders broadcast only when their
scan statistics are under the broadcast threshold, and are shuffle joins
otherwise (AQE may still convert at runtime on measured sizes).

The same rules are written as DuckDB SQL in ``tallyframe.plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# The deny list of meta departments and the dirt rules' moduli.
DENIED_DEPARTMENTS = ("Automatic Appropriations", "New General Appropriations")


def _code2(c: Column) -> Column:
    return F.lpad(c.cast("string"), 2, "0")


def base_lines(t) -> DataFrame:
    """lineitem joined to its order, part and supplier's nation (one row per line)."""
    l = (t["lineitem"].select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                                    "l_extendedprice", "l_returnflag", "l_linestatus"))
    o = t["orders"].select("o_orderkey", "o_orderstatus", "o_orderpriority")
    p = t["part"].select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    s = t["supplier"].select("s_suppkey", "s_name", "s_nationkey")
    n = t["nation"].select("n_nationkey", "n_name", "n_regionkey")
    # Each dimension joins the fact side directly, so the broadcast decision is
    # made on the dimension's own scan size (a join's size estimate is the
    # product of its inputs and would never broadcast). nation is fixed-size.
    return (l.join(o, l.l_orderkey == o.o_orderkey)
             .join(p, l.l_partkey == p.p_partkey)
             .join(s, l.l_suppkey == s.s_suppkey)
             .join(F.broadcast(n), F.col("s_nationkey") == n.n_nationkey))


def amount_text(x: Column) -> Column:
    """Dirty amount text for a whole amount ``x`` (first matching rule wins)."""
    grouped = F.concat(((x - x % 1000) / 1000).cast("bigint").cast("string"), F.lit(","),
                       F.lpad((x % 1000).cast("string"), 3, "0"))
    return (F.when(x % 97 == 0, F.lit("N/A"))
            .when(x % 89 == 0, F.lit(""))
            .when(x % 83 == 0, F.lit("-5"))
            .when(x % 73 == 0, F.concat(x.cast("string"), F.lit(".50")))
            .when((x % 7 == 0) & (x >= 1000), grouped)
            .otherwise(x.cast("string")))


def _with_duplicates(df: DataFrame, key: str) -> DataFrame:
    """Exact duplicates of rows whose ``key`` text ends in '01', in one pass (no self-union)."""
    copies = F.when(F.col(key).endswith("01"), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return df.withColumn("_copy", F.explode(copies)).drop("_copy")


def raw_ledger(t) -> DataFrame:
    """The 20-column all-text raw ledger."""
    b = base_lines(t)
    code = _code2(F.col("n_nationkey"))
    name = F.concat(F.col("n_name"), F.lit(" (N"), code, F.lit(")"))
    x = F.floor(F.col("l_extendedprice")).cast("bigint")
    ln, ok = F.col("l_linenumber"), F.col("l_orderkey")
    df = b.select(
        (ok * 10 + ln).cast("string").alias("SORDER"),
        code.alias("DEPARTMENT"),
        F.when(ok % 79 == 0, F.lit(DENIED_DEPARTMENTS[1]))
         .when(ln % 5 == 0, F.concat(F.lit("  "), F.lower(name), F.lit(" ")))
         .otherwise(name).alias("UACS_DPT_DSC"),
        F.col("s_suppkey").cast("string").alias("AGENCY"),
        F.when(ok % 71 == 0, F.lit(None).cast("string")).otherwise(F.col("s_name")).alias("UACS_AGY_DSC"),
        F.col("p_partkey").cast("string").alias("PREXC_FPAP_ID"),
        F.col("p_size").cast("string").alias("PREXC_LEVEL"),
        F.col("p_name").alias("DSC"),
        F.col("o_orderstatus").alias("OPERUNIT"),
        F.concat(F.lit("Unit "), F.col("o_orderstatus")).alias("UACS_OPER_DSC"),
        _code2(F.col("n_regionkey")).alias("UACS_REG_ID"),
        ln.cast("string").alias("UACS_OPERDIV_ID"),
        F.concat(F.lit("Division "), ln.cast("string")).alias("UACS_DIV_DSC"),
        F.substring(F.col("o_orderpriority"), 1, 1).alias("FUNDCD"),
        F.col("o_orderpriority").alias("UACS_FUNDSUBCAT_DSC"),
        F.concat(F.col("l_returnflag"), F.col("l_linestatus")).alias("UACS_EXP_CD"),
        F.when(F.col("l_returnflag") == "R", F.lit("Personnel Services"))
         .when(F.col("l_returnflag") == "A", F.lit("Maintenance and Other Operating Expenses"))
         .when(F.col("l_linestatus") == "F", F.lit("Capital Outlays"))
         .otherwise(F.lit("Financial Expenses")).alias("UACS_EXP_DSC"),
        F.col("p_brand").alias("UACS_OBJ_CD"),
        F.col("p_type").alias("UACS_OBJ_DSC"),
        amount_text(x).alias("AMT"),
    )
    return _with_duplicates(df, "SORDER")


def workshop_raw(t) -> DataFrame:
    """The 6-column dirty CSV shape, all text."""
    b = base_lines(t)
    r = t["region"].select("r_regionkey", "r_name")
    b = b.join(F.broadcast(r), b.n_regionkey == r.r_regionkey)
    x = F.floor(F.col("l_extendedprice")).cast("bigint")
    ln, ok = F.col("l_linenumber"), F.col("l_orderkey")
    rf, ls = F.col("l_returnflag"), F.col("l_linestatus")
    even = ln % 2 == 0
    df = b.select(
        (ok * 10 + ln).cast("string").alias("id"),
        F.when(ln % 5 == 0, F.concat(F.lit("  "), F.lower("n_name"), F.lit(" ")))
         .when(ln % 3 == 0, F.lower("n_name"))
         .otherwise(F.col("n_name")).alias("department"),
        F.when(ok % 71 == 0, F.lit(None).cast("string"))
         .when(ok % 67 == 0, F.lit(""))
         .when(ln % 4 == 0, F.concat(F.col("s_name"), F.lit(" ")))
         .otherwise(F.col("s_name")).alias("agency"),
        amount_text(x).alias("amount"),
        F.when(rf == "R", F.when(even, F.lit("personnel services")).otherwise(F.lit("Personnel Services")))
         .when(rf == "A", F.when(even, F.lit("mooe")).otherwise(F.lit("MOOE")))
         .when(ls == "F", F.when(even, F.lit("CAPITAL OUTLAYS")).otherwise(F.lit("Capital Outlays")))
         .when(ok % 13 == 0, F.lit(None).cast("string"))
         .when(ln % 3 == 0, F.lit("Financial Expenses "))
         .otherwise(F.lit("Financial Expenses")).alias("category"),
        F.when(ok % 61 == 0, F.lit(""))
         .when(even, F.lower("r_name"))
         .otherwise(F.col("r_name")).alias("region"),
    )
    return _with_duplicates(df, "id")
