"""Amplitude distributions: histogram, missing-spike estimates, raw amplitude and signal to noise."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fits import SQUARE_BITS, cut_gaussians_missing, deviation
from .ranks import spread

BINS = 50


def once(value: Column, use) -> Column:
    """use(value) with the value computed once a row, though it stands inside an array function."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def drop_outliers(spikes: DataFrame, *keys: str) -> DataFrame:
    """Without amplitudes over p99 + 10 (p99 - p1) of their unit (and key, such as a chunk)."""
    by = ["unit_id", *keys]
    q = spikes.groupBy(*by).agg(F.percentile("amplitude", F.array(F.lit(0.99), F.lit(0.01))).alias("q")).select(*by, F.col("q")[0].alias("p99"), F.col("q")[1].alias("p1"))
    return spikes.join(q, by).filter("amplitude <= p99 + 10 * (p99 - p1)").drop("p99", "p1")


def ranges(spikes: DataFrame, *keys: str, bins: int = BINS) -> DataFrame:
    """Least and largest amplitude, width of a bin, mean and 1st percentile of each unit (and key) with a range, in one pass."""
    by = ["unit_id", *keys]
    r = spikes.groupBy(*by).agg(F.min("amplitude").alias("lo"), F.max("amplitude").alias("hi"), F.avg("amplitude").alias("mean"), F.percentile("amplitude", F.lit(0.01)).alias("low"))
    return r.filter("hi > lo").withColumn("width", (F.col("hi") - F.col("lo")) / bins)


def squares(spikes: DataFrame, *keys: str) -> DataFrame:
    """(unit_id, keys, parts, offset, scale, low): what `fits.deviation` takes the deviation of each unit (and key) with a range from.

    Squares of distances from a centre near the mean, over a power of two, are cut into whole
    numbers, whose sums are exact: the deviation is the same in any order and rounded once.
    """
    by, one = ["unit_id", *keys], 2.0**SQUARE_BITS
    r = ranges(spikes, *keys).withColumn("scale", F.pow(F.lit(2.0), F.ceil(F.log2(F.col("hi") - F.col("lo")))))
    r = r.select(*by, "low", "scale", (F.col("lo") + F.floor((F.col("mean") - F.col("lo")) / F.col("scale") * 2.0**20) / 2.0**20 * F.col("scale")).alias("centre"))
    y = (F.col("amplitude") - F.col("centre")) / F.col("scale")
    x = spikes.join(r, by).select(*by, "low", "scale", y.alias("y")).withColumn("rest", F.col("y") * F.col("y") * one)
    for i in range(3):
        x = x.withColumn(f"part{i}", F.floor("rest")).withColumn("rest", (F.col("rest") - F.col(f"part{i}")) * one)
    g = x.groupBy(*by).agg(*[F.sum(f"part{i}").alias(f"part{i}") for i in range(3)], F.sum("y").alias("offset"), F.first("scale").alias("scale"), F.first("low").alias("low"))
    return g.select(*by, F.array("part0", "part1", "part2").alias("parts"), "offset", "scale", "low")


def histogram(spikes: DataFrame, *keys: str, bins: int = BINS) -> DataFrame:
    """(unit_id, keys, bin, left, width, n) of equi-width bins over each unit's range, zero-filled, the last one closed."""
    by = ["unit_id", *keys]
    r = ranges(spikes, *keys, bins=bins)
    at = F.least(F.floor((F.col("amplitude") - F.col("lo")) / F.col("width")), F.lit(bins - 1)).cast("int")
    n = spikes.join(r, by).groupBy(*by, at.alias("bin")).agg(F.count("*").alias("n"))
    grid = r.select(*by, "lo", "width", F.explode(F.expr(f"sequence(0, {bins - 1})")).alias("bin"))
    full = grid.join(n, [*by, "bin"], "left")
    return full.select(*by, "bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("left"), "width", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def counts_array(hist: DataFrame, *keys: str) -> DataFrame:
    """One row a unit (and key) with its counts in bin order: 50 numbers, however many spikes."""
    by = ["unit_id", *keys]
    x = hist.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("bin", "n", "left", "width"))).alias("h"))
    return x.select(*by, F.col("h.n").alias("counts"), F.col("h.left").alias("lefts"), F.element_at("h.width", 1).alias("width"))


def median5(c: Column) -> Column:
    """Running median of five with zeros beyond the ends."""
    padded = F.concat(F.array(F.lit(0), F.lit(0)).cast("array<bigint>"), c, F.array(F.lit(0), F.lit(0)).cast("array<bigint>"))
    return F.transform(F.sequence(F.lit(1), F.size(c)), lambda i: F.element_at(F.array_sort(F.slice(padded, i, 5)), 3))


def missing_symmetric(hist: DataFrame, *keys: str) -> DataFrame:
    """Percent missing if the part right of the mode were mirrored: 100 (S - N)/S, at least 0; too few spikes: null.

    The mode is the first maximum of the median-filtered counts; the surrogate leaves the modal
    bin out, and mirrored bins before the first are dropped.
    """
    x = counts_array(hist, *keys).withColumn("smooth", median5(F.col("counts")))
    x = x.withColumn("mode", F.array_position("smooth", F.array_max("smooth")).cast("int"))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, v: s + v)
    right = F.slice("counts", F.col("mode") + 1, F.lit(BINS))
    mirrored = F.slice(right, F.lit(1), F.greatest(F.least(F.size(right), F.col("mode") - 1), F.lit(0)))
    x = x.select("unit_id", *keys, total("counts").alias("n"), (total(right) + total(mirrored)).alias("surrogate"))
    missing = F.when(F.col("surrogate") > 0, F.greatest(F.lit(0.0), 100.0 * (F.col("surrogate") - F.col("n")) / F.col("surrogate"))).otherwise(0.0)
    return x.select("unit_id", *keys, "n", F.when(F.col("n") > 5, missing).alias("missing_symmetric"))


def peak_cutoff(hist: DataFrame) -> DataFrame:
    """Whether the largest count is also the largest rise from one bin to the next, before the first being 0."""
    w = Window.partitionBy("unit_id").orderBy("bin")
    x = hist.withColumn("rise", F.col("n") - F.coalesce(F.lag("n").over(w), F.lit(0)))
    return x.groupBy("unit_id").agg((F.max("n") == F.max("rise")).alias("is_cutoff"), F.sum("n").alias("n"))


def missing_gaussian(spikes: DataFrame, *keys: str) -> DataFrame:
    """Percent missing by a cut Gaussian fitted to each unit's (and key's) 50 counts; a cut-off histogram gives 100, few spikes null.

    The fit sees the counts and a few numbers of each unit, never its spikes, and takes all
    units of an Arrow batch at once.
    """
    by = ["unit_id", *keys]
    kept = drop_outliers(spikes, *keys)
    x = counts_array(histogram(kept, *keys), *keys).join(squares(kept, *keys), by)
    n = F.aggregate("counts", F.lit(0).cast("long"), lambda s, v: s + v)
    rises = F.transform("counts", lambda v, i: v - F.coalesce(F.get("counts", i - 1), F.lit(0)))
    x = spread(x.select(*by, "counts", "lefts", "width", "parts", "offset", "scale", "low", n.alias("n"), (F.array_max("counts") == F.array_max(rises)).alias("is_cutoff")), *by)

    @F.pandas_udf("double")
    def fit(counts: pd.Series, lefts: pd.Series, width: pd.Series, parts: pd.Series, offset: pd.Series, scale: pd.Series, low: pd.Series) -> pd.Series:
        if not len(counts):
            return pd.Series([], dtype="float64")
        counts = np.stack(counts)
        sd = deviation(list(np.stack(parts).T), offset.to_numpy(), counts.sum(1), scale.to_numpy())
        return pd.Series(cut_gaussians_missing(counts, np.stack(lefts), width.to_numpy(), sd, low.to_numpy()))

    percent = fit("counts", "lefts", "width", "parts", "offset", "scale", "low")
    return x.select(*by, "n", F.when(F.col("n") > 5, F.when(F.col("is_cutoff"), 100.0).otherwise(F.nanvl(percent, F.lit(None).cast("double")))).alias("missing_gaussian"))


def raw_amplitude(wf: Column, gain: Column | float | None) -> Column:
    """(|max| + |min|) x gain of a peak-channel waveform; no gain: null."""
    g = gain if isinstance(gain, Column) else F.lit(gain).cast("double")
    return (F.abs(F.array_max(wf)) + F.abs(F.array_min(wf))) * g


def signal_to_noise(peaks: DataFrame, baseline: DataFrame) -> DataFrame:
    """Largest |value| of each unit's mean waveform over the unscaled MAD of its baseline samples (unit_id, value); units without any keep a null."""
    med = baseline.groupBy("unit_id").agg(F.median("value").alias("m"))
    mad = baseline.join(med, "unit_id").groupBy("unit_id").agg(F.median(F.abs(F.col("value") - F.col("m"))).alias("mad"))
    top = F.array_max(F.transform("wf", lambda v: F.abs(v)))
    return peaks.join(mad, "unit_id", "left").select("unit_id", "mad", F.when(F.col("mad") > 0, top / F.col("mad")).alias("snr"))


def mean_waveforms(snippets: DataFrame, baseline_samples: int) -> DataFrame:
    """(unit_id, channel, wf) mean of the snippets (unit_id, spike_idx, channel, wf) less the mean of its first samples.

    Samples are averaged by position map-side; snippets are exploded one channel's samples at a time.
    """
    x = snippets.select("unit_id", "channel", F.posexplode("wf").alias("sample", "v")).groupBy("unit_id", "channel", "sample").agg(F.avg("v").alias("v"))
    y = x.groupBy("unit_id", "channel").agg(F.array_sort(F.collect_list(F.struct("sample", "v"))).alias("s"))
    wf, mean = F.col("s.v"), lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    base = mean(F.slice(F.col("s.v"), 1, baseline_samples)) / baseline_samples
    return y.select("unit_id", "channel", once(base, lambda b: F.transform(wf, lambda v: v - b)).alias("wf"))


def half_medians(snippets: DataFrame, baseline_samples: int) -> DataFrame:
    """Medians of the first and second half of each unit's snippets, smoothed over time (Gaussian, sigma 1, radius 2)."""
    k = [0.054488684549642945, 0.24420134200323335, 0.4026199468942475]  # the normalised kernel's outer, inner and centre weight
    at = lambda a, i: F.element_at(a, F.greatest(F.lit(1), F.least(F.size(a), i)).cast("int"))
    wf = F.col("wf")
    smooth = F.transform(F.sequence(F.lit(1), F.size(wf)), lambda i: k[0] * (at(wf, i - 2) + at(wf, i + 2)) + k[1] * (at(wf, i - 1) + at(wf, i + 1)) + k[2] * at(wf, i))
    order = Window.partitionBy("unit_id", "channel").orderBy("spike_idx")
    half = F.when(F.row_number().over(order) * 2 <= F.count("*").over(Window.partitionBy("unit_id", "channel")), 0).otherwise(1)
    x = snippets.select("unit_id", "channel", half.alias("half"), smooth.alias("wf"))
    base = F.aggregate(F.slice("wf", 1, baseline_samples), F.lit(0.0), lambda s, v: s + v) / baseline_samples
    x = x.select("unit_id", "channel", "half", F.posexplode(once(base, lambda b: F.transform(F.col("wf"), lambda v: v - b))).alias("sample", "v"))
    y = x.groupBy("unit_id", "channel", "half", "sample").agg(F.median("v").alias("v"))
    return y.groupBy("unit_id", "channel", "half").agg(F.array_sort(F.collect_list(F.struct("sample", "v"))).alias("s")).select("unit_id", "channel", "half", F.col("s.v").alias("wf"))


def detrended(snippets: DataFrame) -> DataFrame:
    """Snippets less their least-squares line, as array arithmetic."""
    n = F.size("wf").cast("double")
    i_mean = (n - 1) / 2
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v)
    slope = F.try_divide(total(F.transform(F.col("wf"), lambda v, i: (i - i_mean) * v)), n * (n * n - 1) / 12)
    line = F.struct((total(F.col("wf")) / n).alias("mean"), slope.alias("slope"), i_mean.alias("middle"))
    return snippets.withColumn("wf", once(line, lambda s: F.transform(F.col("wf"), lambda v, i: v - s["mean"] - s["slope"] * (i - s["middle"]))))
