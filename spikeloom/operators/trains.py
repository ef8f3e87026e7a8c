"""Spike trains: counts, intervals, rates, presence and the choice of a good time window.

A train relation has unit_id, spike_idx, t (integer ticks) and amplitude; every operator
groups by unit_id, so that one shuffle serves all units. `tick` is seconds a tick.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import with_previous, with_rank


def spike_counts(spikes: DataFrame) -> DataFrame:
    return spikes.groupBy("unit_id").agg(F.count("*").alias("n_spikes"), F.min("t").alias("t_first"), F.max("t").alias("t_last"))


def intervals(spikes: DataFrame, *keys: str) -> DataFrame:
    """spikes with isi in ticks; the first of each unit (and key) has none."""
    return with_previous(spikes, *keys).withColumn("isi", F.col("t") - F.col("t1")).drop("t1", "t2")


def interval_properties(spikes: DataFrame, long_isi: int) -> DataFrame:
    """Share of intervals over long_isi; CV, population skewness and CV2 (mean of 2|d|/(a+b))."""
    x = with_previous(spikes.select("unit_id", "spike_idx", "t")).filter("t1 is not null")
    x = x.select("unit_id", (F.col("t") - F.col("t1")).cast("double").alias("isi"), (F.col("t1") - F.col("t2")).cast("double").alias("before"))
    pair = F.col("isi") + F.col("before")
    return x.groupBy("unit_id").agg(
        F.count("*").alias("n_isi"), F.avg((F.col("isi") > long_isi).cast("double")).alias("prop_long"),
        F.try_divide(F.stddev_pop("isi"), F.avg("isi")).alias("cv"), F.when(F.var_pop("isi") > 0, F.skewness("isi")).alias("skew"),
        F.avg(F.when(pair > 0, 2 * F.abs(F.col("isi") - F.col("before")) / pair)).alias("cv2"),
    )


def zero_filled(bins: DataFrame, counts: DataFrame, keys: list[str], count: str = "n") -> DataFrame:
    """Every row of bins with its count, 0 where there is none."""
    return bins.join(counts, keys, "left").withColumn(count, F.coalesce(count, F.lit(0)).cast("long"))


def rate_properties(spikes: DataFrame, bin_ticks: int, tick: float, most_bins: int = 10_000) -> DataFrame:
    """Rate over the unit's span; population std, Fano factor and p95/p5 of its equi-width bin rates."""
    units = spike_counts(spikes).withColumn("span", F.col("t_last") - F.col("t_first"))
    units = units.withColumn("n_bins", F.least(F.floor(F.col("span") / bin_ticks), F.lit(most_bins)).cast("int")).filter("n_bins >= 1")
    counts = spikes.join(units, "unit_id").groupBy("unit_id", F.least(F.expr("((t - t_first) * n_bins) div span"), F.col("n_bins") - 1).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    bins = units.select("unit_id", "n_spikes", "span", "n_bins", F.explode(F.sequence(F.lit(0), F.col("n_bins") - 1)).alias("bin"))
    rate = F.col("n") / (F.col("span") * tick / F.col("n_bins"))
    per = zero_filled(bins, counts, ["unit_id", "bin"]).withColumn("rate", rate)
    return per.groupBy("unit_id").agg(
        (F.max("n_spikes") / (F.max("span") * tick)).alias("mean_rate"), F.max("n_bins").alias("n_bins"), F.stddev_pop("rate").alias("std_rate"),
        F.try_divide(F.var_pop("rate"), F.avg("rate")).alias("fano"), F.try_divide(F.percentile("rate", F.lit(0.95)), F.percentile("rate", F.lit(0.05))).alias("rate_ratio"))


def binned_rates(spikes: DataFrame, bin_ticks: int, tick: float) -> DataFrame:
    """(unit_id, bin, start, rate) of bins of the recording from its first spike on, zero-filled: the rate panel beside the amplitudes."""
    b = bounds(spikes)  # one row
    n = F.greatest(F.ceil((F.col("end") - F.col("start") + 1) / bin_ticks), F.lit(1)).cast("int")
    bins = spikes.select("unit_id").distinct().crossJoin(F.broadcast(b)).select("unit_id", "start", F.explode(F.sequence(F.lit(0), n - 1)).alias("bin"))
    counts = spikes.crossJoin(F.broadcast(b)).groupBy("unit_id", F.expr(f"cast((t - start) div {bin_ticks} as int)").alias("bin")).agg(F.count("*").alias("n"))
    return zero_filled(bins, counts, ["unit_id", "bin"]).select("unit_id", "bin", (F.col("start") + F.col("bin") * bin_ticks).alias("start"), (F.col("n") / (bin_ticks * tick)).alias("rate"))


def bounds(spikes: DataFrame) -> DataFrame:
    """One row with the recording's first and last tick."""
    return spikes.agg(F.min("t").alias("start"), F.max("t").alias("end"))


def presence_ratio(spikes: DataFrame, bin_ticks: int, *keys: str, window: DataFrame | None = None) -> DataFrame:
    """Share of the whole bins of the window (start, end; by default the recording's) that are full.

    Full: more than none and at least a twentieth of the 90th percentile. Fewer than two
    edges: null. keys add grouping columns, such as a chunk, whose own windows are then given;
    a window table with a unit_id holds each unit's own.
    """
    window = bounds(spikes) if window is None else window
    by = ["unit_id", *keys]
    if "unit_id" in window.columns:
        keys = ("unit_id", *keys)
    n_bins = (F.ceil((F.col("end") - F.col("start")) / bin_ticks) - 1).cast("int")
    if keys:
        units, placed = spikes.select(*by).distinct().join(window, list(keys)), spikes.join(window, list(keys))
    else:
        units, placed = spikes.select(*by).distinct().crossJoin(F.broadcast(window)), spikes.crossJoin(F.broadcast(window))  # one row
    units = units.withColumn("n_bins", n_bins)
    bins = units.filter("n_bins >= 1").select(*by, F.explode(F.expr("sequence(0, n_bins - 1)")).alias("bin"))
    counts = placed.filter("t >= start").groupBy(*by, F.expr(f"cast((t - start) div {bin_ticks} as int)").alias("bin")).agg(F.count("*").alias("n"))
    per = zero_filled(bins, counts, [*by, "bin"])
    p90 = per.groupBy(*by).agg(F.percentile("n", F.lit(0.9)).alias("p90"))
    full = (F.col("n") > 0) & (F.col("n") >= 0.05 * F.col("p90"))
    ratio = per.join(p90, by).groupBy(*by).agg(F.avg(full.cast("double")).alias("presence_ratio"), F.count("*").alias("n_bins"))
    return units.select(*by).join(ratio, by, "left")


def chunk_edges(spikes: DataFrame, chunk_ticks: int) -> DataFrame:
    """(chunk, start, end) of the whole chunks of the recording; the last partial one is dropped."""
    b = bounds(spikes).withColumn("n", F.ceil((F.col("end") - F.col("start")) / chunk_ticks).cast("int") - 1)
    x = b.filter("n >= 1").select("start", F.explode(F.expr("sequence(0, n - 1)")).alias("chunk"))
    return x.select("chunk", (F.col("start") + F.col("chunk") * chunk_ticks).alias("start"), (F.col("start") + (F.col("chunk") + 1) * chunk_ticks).alias("end"))


def in_chunks(spikes: DataFrame, chunk_ticks: int) -> DataFrame:
    """spikes with their half-open chunk; those of no whole chunk are left out. Arithmetic, not a range join."""
    b = bounds(spikes).withColumn("n_chunks", F.ceil((F.col("end") - F.col("start")) / chunk_ticks).cast("int") - 1)
    x = spikes.crossJoin(F.broadcast(b)).withColumn("chunk", F.expr(f"cast((t - start) div {chunk_ticks} as int)"))  # b is one row
    return x.filter("chunk < n_chunks").drop("end", "n_chunks", "start")


def good_runs(chunk_metrics: DataFrame, good: Column, quirk: bool = False) -> DataFrame:
    """Longest run of consecutive good chunks of each unit; the first of equal length. No good chunk: all chunks.

    quirk: a run that isn't the last ends one chunk later, as the reference counts it.
    """
    w = Window.partitionBy("unit_id").orderBy("chunk")
    x = chunk_metrics.select("unit_id", "chunk", F.coalesce(good, F.lit(False)).alias("good"))
    ranges = x.groupBy("unit_id").agg(F.min("chunk").alias("lo"), F.max("chunk").alias("hi"))
    runs = x.filter("good").withColumn("island", F.col("chunk") - F.row_number().over(w)).groupBy("unit_id", "island").agg(F.min("chunk").alias("first"), F.max("chunk").alias("last"))
    if quirk:
        runs = runs.withColumn("last", F.coalesce(F.lead("first").over(Window.partitionBy("unit_id").orderBy("first")), F.col("last")))
    best = runs.groupBy("unit_id").agg(F.max_by(F.struct("first", "last"), F.struct(F.col("last") - F.col("first"), -F.col("first"))).alias("run"))
    return ranges.join(best, "unit_id", "left").select("unit_id", F.coalesce("run.first", "lo").alias("first_chunk"), F.coalesce("run.last", "hi").alias("last_chunk"), F.col("run").isNotNull().alias("any_good"))


def within_window(spikes: DataFrame, windows: DataFrame) -> DataFrame:
    """Spikes inside their unit's closed window (start, end)."""
    return spikes.join(windows.select("unit_id", "start", "end"), "unit_id").filter("t >= start and t <= end").drop("start", "end")


def sampled_spikes(spikes: DataFrame, k: int) -> DataFrame:
    """At most k spikes of each unit, evenly over their ranks: floor(i*(n-1)/(k-1)); a sampling operator."""
    # rank r is taken if some i has floor(i*(n-1)/(k-1)) = r: the least i that reaches r does
    taken = F.expr(f"((((rank * {k - 1} + n - 2) div greatest(n - 1, 1)) * (n - 1)) div {k - 1}) = rank")
    hit = F.when(F.col("n") <= k, True).otherwise(taken)
    return with_rank(spikes).filter(hit).drop("n")
