"""Scalar rules give the same results in Spark and in DuckDB (the oracle's engine)."""

import math
import random

import duckdb
from pyspark.sql import functions as F

from tallyframe.functions.money import tolerant_bigint
from tallyframe.functions.text import short_name
from tallyframe.plans.oracle import SHORT_SQL

# Digit separators ('1_000') are a documented difference: DuckDB accepts them, Spark's casts do not.
NUMERIC_TEXT = ['12', ' 12 ', '+7', '-0', '-0.5', '0.5', '1.5', '2.5', '-2.5', '.5', '5.', '1e3', '1E3', '1e-2',
                '__', '_1', '1_', '0x10', 'Infinity', 'NaN', '1,000',
                '12a', '', ' ', '9223372036854775807', '9223372036854775808', '99999999999999999999', '\t5',
                '00012', None]


def _same(a, b):
    if a is None or b is None:
        return a is None and b is None
    if isinstance(a, float) and math.isnan(a):
        return isinstance(b, float) and math.isnan(b)
    return a == b


def test_numeric_casts_agree(spark):
    df = spark.createDataFrame([(v,) for v in NUMERIC_TEXT], "v string")
    got = [tuple(r) for r in df.select(tolerant_bigint(F.col("v")), F.col("v").try_cast("double")).collect()]
    con = duckdb.connect()
    want = [con.execute("SELECT TRY_CAST(ROUND(TRY_CAST(? AS DECIMAL(38,10))) AS BIGINT), TRY_CAST(? AS DOUBLE)",
                        [v, v]).fetchone() for v in NUMERIC_TEXT]
    bad = [(v, a, b) for v, a, b in zip(NUMERIC_TEXT, got, want) if not (_same(a[0], b[0]) and _same(a[1], b[1]))]
    assert not bad


def test_short_name_agrees_on_random_strings(spark):
    rnd = random.Random(11)
    vals = [''.join(rnd.choice('ab() ') for _ in range(rnd.randint(0, 9))) for _ in range(1500)]
    vals += [None, '', '()', '(', ')', ')(', 'Dept (ABC) (X)', 'Department of Education (DepEd)']
    df = spark.createDataFrame(list(enumerate(vals)), "i int, v string")
    got = [r[0] for r in df.orderBy("i").select(short_name(F.col("v"))).collect()]
    con = duckdb.connect()
    con.execute("CREATE TABLE t (i INTEGER, v VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(vals)))
    want = [r[0] for r in con.execute("SELECT " + SHORT_SQL.format(c="v") + " FROM t ORDER BY i").fetchall()]
    assert got == want


def test_peso_labels_agree_across_magnitudes(spark):
    from tallyframe.functions import format as fm
    from tallyframe.plans.oracle import abbrev as sql_abbrev
    rnd = random.Random(3)
    vals = [round(10 ** rnd.uniform(0, 14), rnd.choice([0, 1, 2])) for _ in range(1500)]
    vals += [999.5, 999999.5, 1e9 - 0.5, 1e12, 2.675e12, 1.005e6, 0.0]
    variants = [fm.WORKSHOP_DECIMALS, fm.DASHBOARD_DECIMALS, fm.SUMMARY_DECIMALS, fm.TABLE_DECIMALS]
    df = spark.createDataFrame(list(enumerate(vals)), "i int, v double")
    got = [tuple(r) for r in df.orderBy("i").select(*[fm.abbrev(F.col("v"), d) for d in variants]).collect()]
    con = duckdb.connect()
    con.execute("CREATE TABLE t (i INTEGER, v DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(vals)))
    want = [tuple(r) for r in con.execute(
        "SELECT " + ", ".join(sql_abbrev("v", d) for d in variants) + " FROM t ORDER BY i").fetchall()]
    assert got == want


def test_percent_rounding_agrees(spark):
    from tallyframe.functions.money import pct
    from tallyframe.plans.oracle import pct as sql_pct
    rnd = random.Random(5)
    pairs = [(rnd.randint(0, 10 ** rnd.randint(1, 13)), rnd.randint(1, 10 ** 13)) for _ in range(2000)]
    pairs += [(1005, 100000), (125, 1000), (0, 5), (3, 0)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a long, b long")
    got = [tuple(r) for r in df.orderBy("i").select(pct("a", "b", 1), pct("a", "b", 2)).collect()]
    con = duckdb.connect()
    con.execute("CREATE TABLE t (i INTEGER, a BIGINT, b BIGINT)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?)", [(i, a, b) for i, (a, b) in enumerate(pairs)])
    want = [tuple(r) for r in con.execute(
        f"SELECT {sql_pct('a', 'b', 1)}, {sql_pct('a', 'b', 2)} FROM t ORDER BY i").fetchall()]
    assert got == want
