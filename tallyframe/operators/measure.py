"""Repeated-measurement statistics (A19): exact median, max, pass flag.

Exact medians without collecting a group and without a join on the group
key (a hot group would put all its rows in one task):

1. equal values are combined into ``(group, value, count)`` rows (map-side);
2. a range-partitioned sort on (group, value) places every group in
   consecutive partitions; a streaming pass adds the running count inside the
   partition, batch by batch, and the result is checkpointed;
3. each (partition, group) pair is one row with its first and last running
   count. A partition's offset is the rows of those before it (one number
   per partition, prefix-summed on the driver), and a group's extent the
   smallest and largest count of its pairs: at most one pair more per
   partition than there are groups;
4. the middle rows of each group are a filter on the running count, joined
   on (partition, group), so a hot group stays spread over its partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.session import checkpoint_dir


def _running(batches):
    """Running count inside a partition (rows arrive sorted by group, value)."""
    total = 0
    for pdf in batches:
        pdf["_hi"] = (pdf["_w"].cumsum() + total).astype("int64")
        total = int(pdf["_hi"].iloc[-1]) if len(pdf) else total
        yield pdf


def exact_median(df: DataFrame, group: str, value: str) -> DataFrame:
    """Per group: runs (n) and the median (middle value, or mean of the two middle values).

    A NULL group is a group of its own; NULL values are no measurements.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    vals = (df.where(F.col(value).isNotNull())
            .groupBy(F.col(group).cast("string").alias("_g"), F.col(value).cast("double").alias("_v"))
            .agg(F.count(F.lit(1)).alias("_w")))
    # no explicit count: AQE may coalesce adjacent ranges, which keeps the global order
    ranged = (vals.repartitionByRange("_g", "_v").sortWithinPartitions("_g", "_v")
              .withColumn("_pid", F.spark_partition_id()))
    schema = T.StructType(ranged.schema.fields + [T.StructField("_hi", T.LongType())])
    local = ranged.mapInPandas(_running, schema).checkpoint(eager=True)

    pairs = local.groupBy("_pid", "_g").agg(F.min(F.col("_hi") - F.col("_w")).alias("_from"), F.max("_hi").alias("_to"))
    offsets, before = [], 0
    for pid, weight in sorted((r["_pid"], r["_to"]) for r in local.groupBy("_pid").agg(F.max("_hi").alias("_to")).collect()):
        offsets.append((pid, before))
        before += weight
    off = F.broadcast(spark.createDataFrame(offsets, "_pid int, _off long"))     # one row per partition
    pairs = pairs.join(off, "_pid")
    extent = pairs.groupBy("_g").agg(F.min(F.col("_from") + F.col("_off")).alias("_start"),
                                     F.max(F.col("_to") + F.col("_off")).alias("_end"))
    extent = extent.withColumnRenamed("_g", "_k")
    spans = (pairs.join(extent, pairs["_g"].eqNullSafe(extent["_k"]))
             .select(F.col("_pid").alias("_p"), "_k", "_off", "_start", (F.col("_end") - F.col("_start")).alias("n")))
    rows = local.join(spans, (local["_pid"] == spans["_p"]) & local["_g"].eqNullSafe(spans["_k"]))
    hi = F.col("_hi") + F.col("_off") - F.col("_start")          # of the group's sorted values: (hi - w) <= index < hi
    holds = lambda i: (hi - F.col("_w") <= i) & (i < hi)
    low, high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    med = (rows.where(holds(low) | holds(high)).groupBy("_k", "n")
           .agg(F.max(F.when(holds(low), F.col("_v"))).alias("_x"), F.max(F.when(holds(high), F.col("_v"))).alias("_y")))
    return med.select(F.col("_k").alias(group), F.col("n").alias("runs"),
                      ((F.col("_x") + F.col("_y")) / F.lit(2.0)).alias("median_value"))


def measurement_stats(df: DataFrame, group: str, value: str, threshold: float = 100.0) -> DataFrame:
    """Per group: runs, median, max and whether the median is under the threshold."""
    med = exact_median(df, group, value)
    mx = df.groupBy(F.col(group).cast("string").alias("_k")).agg(F.max(value).alias("max_value"))
    # one row per group on both sides; null-safe so a NULL group keeps its max
    j = med.join(mx, med[group].eqNullSafe(mx["_k"]))
    return j.select(group, "runs", "median_value", "max_value",
                    (F.col("median_value") < F.lit(threshold)).alias("passed"))


def overall(stats: DataFrame, threshold: float = 100.0) -> DataFrame:
    """Median of the group medians and whether every group passed."""
    med = exact_median(stats.select(F.lit("all").alias("_all"), "median_value"), "_all", "median_value")
    flag = stats.agg(F.bool_and("passed").alias("all_passed"), F.count(F.lit(1)).alias("groups"))
    return med.select(flag.select("groups").scalar().alias("groups"),
                      F.col("median_value").alias("median_of_medians"),
                      (F.col("median_value") < F.lit(threshold)).alias("overall_passed"),
                      flag.select("all_passed").scalar().alias("all_passed"))
