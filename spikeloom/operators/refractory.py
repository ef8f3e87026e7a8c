"""Refractory-period contamination: Hill, all-pairs and sliding-confidence estimators, by chunk and by unit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .correlogram import band_pairs
from .trains import intervals


def tau_frame(spark, taus: list[int]) -> DataFrame:
    """(tau_idx, tau_r) of a refractory sweep, a literal list."""
    return spark.createDataFrame(list(enumerate(taus)), "tau_idx int, tau_r long")


def hill(n: Column, spikes: Column, duration: Column, window: Column) -> Column:
    """Smaller root of k f^2 - k f + nT = 0, k = 2 w N^2; no violation 0, no real root n/(2w(N-n)), at most 1."""
    k = 2 * window * spikes * spikes
    disc = 1 - F.try_divide(4 * n * duration, k)
    fallback = F.when(n < spikes, F.try_divide(n, 2 * window * (spikes - n))).otherwise(1.0)
    return F.least(F.lit(1.0), F.when(n == 0, 0.0).when(disc >= 0, (1 - F.sqrt(F.greatest(disc, F.lit(0.0)))) / 2).otherwise(fallback))


def hill_sweep(spikes: DataFrame, taus: list[int], tau_c: int, tick: float, *keys: str, low: bool = False) -> DataFrame:
    """One row a unit (and key) and tau: violations isi <= tau (isi > tau_c too if low) and contamination."""
    x = intervals(spikes, *keys)
    by = ["unit_id", *keys]
    counted = x.groupBy(*by).agg(
        F.count("*").alias("n_spikes"), ((F.max("t") - F.min("t")) * tick).alias("duration"),
        *[F.count_if((F.col("isi") <= t) & ((F.col("isi") >= tau_c) if low else F.lit(True))).alias(f"v{i}") for i, t in enumerate(taus)])
    rows = F.array(*[F.struct(F.lit(i).alias("tau_idx"), F.lit(t).cast("long").alias("tau_r"), F.col(f"v{i}").alias("n_violations")) for i, t in enumerate(taus)])
    long = counted.select(*by, "n_spikes", "duration", F.inline(rows))
    return long.withColumn("contamination", hill(F.col("n_violations"), F.col("n_spikes"), F.col("duration"), (F.col("tau_r") - tau_c) * tick))


def llobet_sweep(spikes: DataFrame, taus: list[int], tau_c: int, tick: float, *keys: str) -> DataFrame:
    """One row a unit (and key) and tau, of all pairs with tau_c <= d <= tau: 1 - sqrt(1 - n(T - 2N tau_c)/(N^2(tau - tau_c))); no real root 1."""
    by = ["unit_id", *keys]
    pairs = band_pairs(spikes, max(taus), *keys).filter(F.col("delta") >= tau_c)
    n_of = pairs.groupBy(*by).agg(*[F.count_if(F.col("delta") <= t).alias(f"p{i}") for i, t in enumerate(taus)])
    units = spikes.groupBy(*by).agg(F.count("*").alias("n_spikes"), ((F.max("t") - F.min("t")) * tick).alias("duration")).join(n_of, by, "left")
    rows = F.array(*[F.struct(F.lit(i).alias("tau_idx"), F.lit(t).cast("long").alias("tau_r"), F.coalesce(f"p{i}", F.lit(0)).alias("n_pairs")) for i, t in enumerate(taus)])
    long = units.select(*by, "n_spikes", "duration", F.inline(rows))
    inner = 1 - F.try_divide(F.col("n_pairs") * (F.col("duration") - 2 * F.col("n_spikes") * tau_c * tick), F.col("n_spikes") * F.col("n_spikes") * (F.col("tau_r") - tau_c) * tick)
    return long.withColumn("contamination", F.when(inner >= 0, 1 - F.sqrt(inner)).otherwise(1.0))


def poisson_cdf(n: Column, mean: Column) -> Column:
    """P(X <= n) by the finite sum with a running term."""
    start = F.struct(F.exp(-mean).alias("term"), F.exp(-mean).alias("sum"))
    step = lambda a, k: F.struct((a["term"] * mean / k).alias("term"), (a["sum"] + a["term"] * mean / k).alias("sum"))
    return F.aggregate(F.when(n > 0, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.array().cast("array<int>")), start, step, lambda a: a["sum"])


def sliding_confidence(spikes: DataFrame, taus: list[int], tau_c: int, tick: float, confidence: float = 0.9, *keys: str) -> DataFrame:
    """Smallest contamination of 0.5..34.5 % held with the confidence, over all taus, of each unit (and key); the first tau of equals.

    Violations have tau_c <= isi < tau. A unit of one spike or no effective time has nulls.
    """
    by = ["unit_id", *keys]
    counted = intervals(spikes, *keys).groupBy(*by).agg(
        F.count("*").alias("n_spikes"), ((F.max("t") - F.min("t")) * tick).alias("duration"),
        *[F.count_if((F.col("isi") >= tau_c) & (F.col("isi") < t)).alias(f"v{i}") for i, t in enumerate(taus)])
    rows = F.array(*[F.struct(F.lit(i).alias("tau_idx"), F.lit(t).cast("long").alias("tau_r"), F.col(f"v{i}").alias("n")) for i, t in enumerate(taus) if t > tau_c])
    x = counted.withColumn("effective", F.col("duration") - 2 * F.col("n_spikes") * tau_c * tick)
    grid = F.transform(F.sequence(F.lit(1), F.lit(69)), lambda c: c * 0.005)
    long = x.filter("n_spikes > 1 and effective > 0").select(*by, "n_spikes", "effective", F.inline(rows)).select("*", F.explode(grid).alias("level"))
    mean = F.col("n_spikes") / F.col("effective") * F.col("level") * (F.col("tau_r") - tau_c) * tick * 2 * F.col("n_spikes")
    held = long.withColumn("mean", mean).filter(1 - poisson_cdf(F.col("n"), F.col("mean")) > confidence)
    best = held.groupBy(*by).agg(F.min(F.struct("level", "tau_idx", "tau_r")).alias("b"))
    return x.select(*by, "n_spikes").join(best, by, "left").select(*by, "n_spikes", F.col("b.level").alias("contamination"), F.col("b.tau_r").alias("tau_r"))


def unit_summary(per_chunk: DataFrame) -> DataFrame:
    """Of rows (unit, chunk, tau): a chunk's contamination is its least (first tau); a unit's their mean, its tau that of the least chunk."""
    chunk = per_chunk.groupBy("unit_id", "chunk").agg(F.min(F.struct("contamination", "tau_idx", "tau_r", "n_violations")).alias("m"))
    return chunk.groupBy("unit_id").agg(
        F.avg("m.contamination").alias("contamination"), F.min(F.struct("m.contamination", "chunk", "m.tau_r")).getField("tau_r").alias("tau_r"),
        F.sum("m.n_violations").alias("n_violations"), F.count("*").alias("n_chunks"))


def window_tau_index(per_chunk: DataFrame) -> DataFrame:
    """The last tau index that attains the least contamination summed over chunks."""
    s = per_chunk.groupBy("unit_id", "tau_idx").agg(F.round(F.sum("contamination"), 9).alias("total"))
    return s.groupBy("unit_id").agg(F.max_by("tau_idx", F.struct(-F.col("total"), F.col("tau_idx"))).alias("rpv_window_index"))


def tau_table(per_chunk: DataFrame, taus: list[int]) -> DataFrame:
    """One row a unit, one column a tau, of the mean contamination over chunks."""
    cols = [F.avg(F.when(F.col("tau_idx") == i, F.col("contamination"))).alias(f"tau_{t}") for i, t in enumerate(taus)]
    return per_chunk.groupBy("unit_id").agg(*cols)


def estimate(spikes: DataFrame, method: str, taus: list[int], tau_c: int, tick: float, confidence: float = 0.9) -> DataFrame:
    """(unit_id, contamination, tau_r) by one of the methods hill, llobet and ibl: the least over all taus, and the first tau that attains it."""
    if method == "ibl":
        return sliding_confidence(spikes, taus, tau_c, tick, confidence).select("unit_id", "contamination", "tau_r")
    sweeps = {"hill": hill_sweep, "llobet": llobet_sweep}
    if method not in sweeps:
        raise ValueError(f"unknown refractory method {method!r}")
    best = sweeps[method](spikes, taus, tau_c, tick).groupBy("unit_id").agg(F.min(F.struct("contamination", "tau_idx", "tau_r")).alias("m"))
    return best.select("unit_id", F.col("m.contamination").alias("contamination"), F.col("m.tau_r").alias("tau_r"))
