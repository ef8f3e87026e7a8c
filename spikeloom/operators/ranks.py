"""Exact order statistics and neighbours in time of groups of any size, without a task that holds a whole group.

A group's values are first counted in bins of its range; only the bins that hold a wanted
rank are looked into, value by value. Trains are cut into time buckets, each of which hands
its last spikes on to the next one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bins of a group's range, and spikes of the busiest unit in a time bucket, on average.
BINS, BUCKET_SPIKES = 1024, 1_000_000


def cut_lineage(df: DataFrame) -> DataFrame:
    """df written to the shared folder of spark.checkpoint.dir, so that its many readers don't compute it again; unset: df itself."""
    spark = df.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        return df
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared)
    return df.checkpoint()


def spread(df: DataFrame, *by: str) -> DataFrame:
    """df dealt over as many tasks as a shuffle has: for few rows that each take long, which would else be put together in one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def by_rank(df: DataFrame, by: list[str], value: str, ranks: dict[str, Callable[[Column], Column]], scale: Callable[[Column], Column] = lambda v: v, bins: int = BINS) -> DataFrame:
    """(by, n, names): the values of the given ranks (from 0, as functions of a group's size) of each group; no such rank: null.

    scale: a rising function that spreads the values over the bins. Nulls don't count.
    """
    x = df.select(*by, F.col(value).alias("v"), scale(F.col(value)).alias("s")).filter("v is not null")
    groups = x.groupBy(*by).agg(F.min("s").alias("lo"), F.max("s").alias("hi"), F.count("*").alias("n"))
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("s") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))).otherwise(0).cast("int")
    placed = x.join(groups, by).withColumn("bin", at)
    counts = placed.groupBy(*by, "bin").agg(F.count("*").alias("c"), F.first("n").alias("n"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hit = lambda r: (r(F.col("n")) >= F.col("before")) & (r(F.col("n")) < F.col("before") + F.col("c"))
    any_hit = F.lit(False)
    for r in ranks.values():
        any_hit = any_hit | F.coalesce(hit(r), F.lit(False))
    wanted = counts.withColumn("before", before).filter(any_hit).select(*by, "bin", "before")
    values = placed.join(wanted, [*by, "bin"]).groupBy(*by, "bin", "v").agg(F.count("*").alias("c"), F.first("before").alias("base"), F.first("n").alias("n"))
    lower = F.coalesce(F.sum("c").over(Window.partitionBy(*by, "bin").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = values.withColumn("before", F.col("base") + lower)
    picked = found.groupBy(*by).agg(*[F.max(F.when(hit(r), F.col("v"))).alias(name) for name, r in ranks.items()])
    return groups.select(*by, "n").join(picked, by, "left")


def percentiles(df: DataFrame, by: list[str], value: str, probs: dict[str, float], bins: int = BINS) -> DataFrame:
    """(by, n, names): exact percentiles with linear interpolation."""
    ranks = {}
    for name, p in probs.items():
        ranks[f"{name}_lo"] = lambda n, p=p: F.floor(p * (n - 1))
        ranks[f"{name}_hi"] = lambda n, p=p: F.ceil(p * (n - 1))
    x = by_rank(df, by, value, ranks, bins=bins)
    part = lambda p: p * (F.col("n") - 1) - F.floor(p * (F.col("n") - 1))
    return x.select(*by, "n", *[(F.col(f"{k}_lo") + (F.col(f"{k}_hi") - F.col(f"{k}_lo")) * part(p)).alias(k) for k, p in probs.items()])


def in_buckets(spikes: DataFrame, bucket_spikes: int = BUCKET_SPIKES) -> DataFrame | None:
    """spikes with a time bucket of the recording, so many that the busiest unit has about bucket_spikes in each; None if one would do.

    One aggregation over the units, whose largest count comes to the driver, decides it.
    """
    units = spikes.groupBy("unit_id").agg(F.count("*").alias("n"), F.min("t").alias("first"), F.max("t").alias("last"))
    r = units.agg(F.max("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last")).first()
    if not r["n"] or r["n"] <= bucket_spikes:
        return None
    buckets = -(-r["n"] // bucket_spikes)
    width = max(-(-(r["last"] - r["first"] + 1) // buckets), 1)
    return spikes.withColumn("bucket", F.expr(f"cast((t - {r['first']}L) div {width}L as int)"))


def with_previous(spikes: DataFrame, *keys: str, bucket_spikes: int = BUCKET_SPIKES) -> DataFrame:
    """spikes with t1 and t2, the times of the one and the two spikes before of each unit (and key); null where there is none.

    Units of up to bucket_spikes are ordered whole. If any has more, each time bucket is
    ordered by itself, and a unit's buckets, one row each, hand the times of their last two
    spikes on.
    """
    by = ["unit_id", *keys]
    x = in_buckets(spikes, bucket_spikes)
    if x is None:
        w = Window.partitionBy(*by).orderBy("t", "spike_idx")
        return spikes.withColumn("t1", F.lag("t", 1).over(w)).withColumn("t2", F.lag("t", 2).over(w))
    w = Window.partitionBy(*by, "bucket").orderBy("t", "spike_idx")
    x = x.withColumn("l1", F.lag("t", 1).over(w)).withColumn("l2", F.lag("t", 2).over(w))
    last = x.groupBy(*by, "bucket").agg(F.max(F.struct("t", "spike_idx", "l1")).alias("e"))
    tail = F.array_compact(F.array("e.l1", "e.t"))
    order = Window.partitionBy(*by).orderBy("bucket")
    none = F.array().cast("array<bigint>")
    handed = F.concat(F.coalesce(F.lag(tail, 2).over(order), none), F.coalesce(F.lag(tail, 1).over(order), none))
    handed = last.select(*by, "bucket", handed.alias("h"))
    y = x.join(handed, [*by, "bucket"])
    back = lambda i: F.get("h", F.size("h") - i)
    t1 = F.coalesce("l1", back(1))
    t2 = F.when(F.col("l2").isNotNull(), F.col("l2")).when(F.col("l1").isNotNull(), back(1)).otherwise(back(2))
    return y.select(*spikes.columns, t1.alias("t1"), t2.alias("t2"))


def with_rank(spikes: DataFrame, bucket_spikes: int = BUCKET_SPIKES) -> DataFrame:
    """spikes with their rank (from 0) in their unit's train and the unit's size n."""
    x = in_buckets(spikes, bucket_spikes)
    if x is None:
        w = Window.partitionBy("unit_id")
        return spikes.withColumn("rank", F.row_number().over(w.orderBy("t", "spike_idx")) - 1).withColumn("n", F.count("*").over(w))
    x = x.withColumn("inner_rank", F.row_number().over(Window.partitionBy("unit_id", "bucket").orderBy("t", "spike_idx")) - 1)
    counts = x.groupBy("unit_id", "bucket").agg(F.count("*").alias("c"))
    order = Window.partitionBy("unit_id")
    before = F.coalesce(F.sum("c").over(order.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    y = x.join(counts.select("unit_id", "bucket", before.alias("before"), F.sum("c").over(order).alias("n")), ["unit_id", "bucket"])
    return y.select(*spikes.columns, (F.col("before") + F.col("inner_rank")).alias("rank"), "n")
