"""The driver's tables as spike-train relations; times are integer microseconds."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"
TICK = 1e-6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events: a user is a unit, a value an amplitude."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("unit_id"), F.col("event_id").alias("spike_idx"), F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, cast(ts as timestamp_ntz))").alias("t"), F.col("value").alias("amplitude"), F.col("event_type"))


def dense_spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem: a supplier is a unit, days are ticks with many ties; the channel is that of the supplier's group of four."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("unit_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("spike_idx"), F.expr("datediff(cast(l_shipdate as date), date'1970-01-01')").cast("long").alias("t"),
        F.col("l_extendedprice").alias("amplitude"), F.expr("l_suppkey div 4").alias("channel"))


def templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings: one channel of 64 samples a template."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("template_id"), F.lit(0).alias("channel"), F.transform("embedding", lambda v: v.cast("double")).alias("wf"))


def channel_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as templates of 16 channels: vec_id div 16, channel vec_id % 16."""
    return table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 16").alias("template_id"), F.expr("cast(vec_id % 16 as int)").alias("channel"), F.transform("embedding", lambda v: v.cast("double")).alias("wf"))


def spike_templates(spark: SparkSession, sf_dir: str, n_channels: int = 16, samples: int = 64) -> DataFrame:
    """embeddings as parameters of spikes on a probe: an early peak, a trough and a late peak, whose widths, delay and heights
    and whose fall with the distance from channel vec_id % 16 come from the vector's first values.

    exp is the C library's, as in SQL: Java's differs in the last digit, which ratios of tiny peaks show.
    """
    @F.pandas_udf("array<double>")
    def exps(powers: pd.Series) -> pd.Series:
        return powers.map(lambda v: None if v is None else [math.exp(p) for p in v])

    e = lambda k: F.abs(F.element_at("embedding", k).cast("double"))
    x = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("template_id"), (F.col("vec_id") % n_channels).cast("int").alias("peak"), (1.5 + 8 * e(1)).alias("w1"), (0.2 + 2 * e(2)).alias("b"), (6 + F.floor(60 * e(3))).alias("d"), (3 + 20 * e(4)).alias("w2"),
        e(5).alias("c"), (15 + 200 * e(6)).alias("reach"))
    xy = lambda c: (c % 2 * 32.0, F.floor(c / 2) * 15.0)

    def fall(c):
        (ax, ay), (bx, by) = xy(c), xy(F.col("peak"))
        return -F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by)) / F.col("reach")

    steps = F.sequence(F.lit(0), F.lit(samples - 1))
    bump = lambda at, w: F.transform(steps, lambda i: -((i - at) * (i - at)) / (2 * w * w))
    powers = {"late": bump(25 + F.col("d"), F.col("w2")), "early": bump(F.lit(17), F.lit(2.0)), "trough": bump(F.lit(25), F.col("w1")), "falls": F.transform(F.sequence(F.lit(0), F.lit(n_channels - 1)), fall)}
    x = x.select("template_id", "b", "c", *[exps(v).alias(k) for k, v in powers.items()])
    x = x.select("*", F.posexplode("falls").alias("channel", "fall"))
    wf = F.transform(steps, lambda i: (F.col("b") * F.get("late", i) + F.col("c") * F.get("early", i) - F.get("trough", i)) * F.col("fall"))
    return x.select("template_id", "channel", wf.alias("wf"))


def channels(spark: SparkSession, n: int = 16) -> DataFrame:
    return spark.range(n).select(F.col("id").cast("int").alias("channel"), F.expr("cast(id % 2 * 32 as double)").alias("x_um"), F.expr("cast(id div 2 * 15 as double)").alias("y_um"))


def pc_vectors(spark: SparkSession, sf_dir: str, dims: int = 12) -> DataFrame:
    """embeddings: a label is a unit, the first values its PC features."""
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("unit_id"), F.col("vec_id").alias("spike_idx"), F.transform(F.slice("embedding", 1, dims), lambda v: v.cast("double")).alias("f"))


def manual_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("unit_id"), F.col("quality").alias("manual_classification"))


def auto_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("unit_id"), F.when(F.col("toxic") == 1, "NOISE").otherwise("GOOD").alias("unit_type_string"))
