"""Template waveforms: peak channel, duration, flatness, extrema, full shape and spatial decay."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fits import exponential_slope, shape
from .ranks import spread


def magnitudes(wf: Column) -> Column:
    return F.transform(wf, lambda v: F.abs(v))


def peak_channel(templates: DataFrame, absolute: bool = False) -> DataFrame:
    """(template_id, channel, wf) of the channel with the largest range, or largest |value|; the first of ties."""
    size = F.array_max(magnitudes(F.col("wf"))) if absolute else F.array_max("wf") - F.array_min("wf")
    best = F.max_by(F.struct("channel", "wf"), F.struct(size, -F.col("channel")))
    return templates.groupBy("template_id").agg(best.alias("b")).select("template_id", F.col("b.channel").alias("channel"), F.col("b.wf").alias("wf"))


def duration_us(wf: Column, fs: float, masked: int = 0) -> Column:
    """Time between the largest |value| and the opposite extremum after it; an all-zero waveform: null."""
    w = F.slice(wf, masked + 1, 100_000)
    at = F.array_position(magnitudes(w), F.array_max(magnitudes(w)))
    rest = F.slice(w, at.cast("int"), F.lit(100_000))
    opposite = F.when(F.element_at(w, at.cast("int")) > 0, F.array_min(rest)).otherwise(F.array_max(rest))
    return F.when(F.array_max(magnitudes(w)) > 0, (F.array_position(rest, opposite) - 1) * 1e6 / fs)


def baseline_flatness(wf: Column, start: int, stop: int) -> Column:
    return F.try_divide(F.array_max(magnitudes(F.slice(wf, start + 1, stop - start))), F.array_max(magnitudes(wf)))


def half_width_ms(wf: Column, fs: float) -> Column:
    """From the first to the last sample at or over half the maximum; a single one: null."""
    high = F.get(F.transform(F.array(F.array_max(wf) / 2), lambda h: F.array_compact(F.transform(wf, lambda v, i: F.when(v >= h, i)))), F.lit(0))
    return F.when(F.size(high) > 1, (F.array_max(high) - F.array_min(high)) / fs * 1000)


def extrema(waves: DataFrame, share: float = 0.1) -> DataFrame:
    """Numbers of local maxima and minima at least `share` of the largest; a plateau counts once. Runs of equal values are collapsed in place."""
    distinct = F.filter(F.transform("wf", lambda v, i: F.struct(v.alias("v"), (i == 0).alias("first"), F.get(F.col("wf"), i - 1).alias("before"))), lambda s: s["first"] | (s["v"] != s["before"]))
    x = waves.withColumn("r", F.transform(distinct, lambda s: s["v"]))

    def count(sign: int) -> Column:
        top = sign * (F.array_max("r") if sign > 0 else F.array_min("r"))
        at = lambda i: sign * F.get(F.col("r"), i)
        inner = F.when(F.size("r") > 2, F.sequence(F.lit(1), F.size("r") - 2)).otherwise(F.array().cast("array<int>"))
        return F.size(F.filter(inner, lambda i: (at(i) > at(i - 1)) & (at(i) > at(i + 1)) & (at(i) >= share * top)))

    return x.select("template_id", count(1).alias("n_peaks"), count(-1).alias("n_troughs"))


SHAPE = "n_peaks int, n_troughs int, duration_us double, peak_before_width double, trough_width double, second_peak_to_trough double, peak1_to_peak2 double, main_peak_to_trough double, trough_to_peak2 double, peak_places array<int>, trough_places array<int>"
_NUMBERS = [c.split()[0] for c in SHAPE.split(", ") if c.endswith("double")]


def waveform_shape(waves: DataFrame, fs: float, share: float = 0.2) -> DataFrame:
    """Prominence-based shape of each peak-channel template (template_id, wf); undefined values are null.

    Prominence walks over the samples, so it runs as an Arrow-batched function of one array a unit.
    """

    @F.pandas_udf(SHAPE)
    def describe(wf: pd.Series) -> pd.DataFrame:
        rows = [shape(w, fs, share) or {} for w in wf]
        return pd.DataFrame({c.split()[0]: [r.get(c.split()[0]) for r in rows] for c in SHAPE.split(", ")}).astype({"n_peaks": "Int32", "n_troughs": "Int32"})

    x = spread(waves.select("template_id", "wf"), "template_id").select("template_id", describe("wf").alias("s")).select("template_id", "s.*")
    return x.withColumns({c: F.when(F.isnan(c), None).otherwise(F.col(c)) for c in _NUMBERS})


def decay_points(templates: DataFrame, channels: DataFrame, k: int, tolerance: float = 33.0) -> DataFrame:
    """(template_id, points array<struct<distance, value>>): the k nearest channels of each peak channel, by |dy| among |dx| <= tolerance.

    Values are max |w|, divided by the largest of the points. Channels off the column come last,
    as far as the farthest; fewer than k on it: no row. channels is the probe's geometry, a
    few hundred rows whatever the recording's length.
    """
    top = peak_channel(templates).select("template_id", F.col("channel").alias("peak"))
    here = channels.select(F.col("channel").alias("peak"), F.col("x_um").alias("px"), F.col("y_um").alias("py"))
    size = templates.select("template_id", "channel", F.array_max(magnitudes(F.col("wf"))).alias("value"))
    x = size.join(channels, "channel").join(top, "template_id").join(here, "peak")
    near = F.abs(F.col("x_um") - F.col("px")) <= tolerance
    w = Window.partitionBy("template_id")
    x = x.withColumn("dy", F.abs(F.col("y_um") - F.col("py"))).withColumn("far", F.max("dy").over(w)).withColumn("on", F.sum(near.cast("int")).over(w))
    x = x.withColumn("rank", F.row_number().over(w.orderBy(F.when(near, F.col("dy")).otherwise(F.col("far")), "channel"))).filter((F.col("rank") <= k) & (F.col("on") >= k))
    dist = F.sqrt((F.col("x_um") - F.col("px")) ** 2 + (F.col("y_um") - F.col("py")) ** 2)
    g = x.groupBy("template_id").agg(F.array_sort(F.collect_list(F.struct(dist.alias("distance"), "channel", "value"))).alias("p"), F.max("value").alias("m"))
    return g.filter("m > 0").select("template_id", F.transform("p", lambda s: F.struct(s["distance"].alias("distance"), (s["value"] / F.col("m")).alias("value"))).alias("points"))


def linear_decay(points: DataFrame) -> DataFrame:
    x = points.select("template_id", F.inline("points"))
    return x.groupBy("template_id").agg((-F.regr_slope("value", "distance")).alias("spatial_decay"), F.count("*").alias("n_points"))


def exponential_decay(points: DataFrame) -> DataFrame:
    """-m of A exp(m x), fitted to the few points of each unit."""

    @F.pandas_udf("double")
    def fit(distances: pd.Series, values: pd.Series) -> pd.Series:
        return pd.Series([exponential_slope(d, v) for d, v in zip(distances, values, strict=True)], dtype="float64")

    x = spread(points, "template_id").select("template_id", fit(F.col("points.distance"), F.col("points.value")).alias("s"))
    return x.select("template_id", F.when(~F.isnan("s"), F.col("s")).alias("spatial_decay"))


def log_linear_decay(points: DataFrame) -> DataFrame:
    """The display's variant: line through (distance, ln(value + 1e-10))."""
    x = points.select("template_id", F.inline("points"))
    y = F.ln(F.col("value") + F.lit(1e-10))
    return x.groupBy("template_id").agg(F.regr_slope(y, F.col("distance")).alias("slope"), F.regr_intercept(y, F.col("distance")).alias("intercept"))


def geometry_allows_decay(channels: DataFrame, most: float = 30.0) -> DataFrame:
    """One row: whether the least difference of distinct depths is below `most`."""
    y = channels.select("y_um").distinct().agg(F.array_sort(F.collect_set("y_um")).alias("y"))
    gaps = F.zip_with(F.slice("y", 2, 100_000), F.slice("y", F.lit(1), F.greatest(F.size("y") - 1, F.lit(0))), lambda b, a: b - a)
    return y.select(F.array_min(gaps).alias("least_gap"), F.coalesce(F.array_min(gaps) < most, F.lit(False)).alias("allowed"))


def nearest_channels(channels: DataFrame, k: int = 16, radius: float | None = None) -> DataFrame:
    """(channel, near, rank, distance): each channel's k nearest, itself included, within radius if given."""
    a = channels.select("channel", F.col("x_um").alias("ax"), F.col("y_um").alias("ay"))
    b = channels.select(F.col("channel").alias("near"), F.col("x_um").alias("bx"), F.col("y_um").alias("by"))
    # a probe's channels pair by depth bands of one radius when one is given
    reach = radius if radius is not None else 1e9
    band = lambda c: F.floor(c / reach)
    pairs = a.withColumn("band", F.explode(F.array(*[band(F.col("ay")) + d for d in (-1, 0, 1)]))).join(b.withColumn("band", band(F.col("by"))), "band")
    d = F.sqrt((F.col("ax") - F.col("bx")) ** 2 + (F.col("ay") - F.col("by")) ** 2)
    x = pairs.withColumn("distance", d).filter(F.col("distance") <= reach).dropDuplicates(["channel", "near"])
    return x.withColumn("rank", F.row_number().over(Window.partitionBy("channel").orderBy("distance", "near"))).filter(F.col("rank") <= k).select("channel", "near", "rank", "distance")


def same_column_channels(channels: DataFrame, k: int = 6) -> DataFrame:
    """(channel, near, rank): k channels of each channel's own column, upwards by number, or downwards where fewer than k are left above."""
    a = channels.select("channel", "x_um")
    b = channels.select(F.col("channel").alias("near"), "x_um")
    x = a.join(b, "x_um")  # a probe's columns: a few hundred rows whatever the recording
    above = F.count_if(F.col("near") >= F.col("channel")).over(Window.partitionBy("channel")) >= k
    x = x.withColumn("above", above).filter(F.when(F.col("above"), F.col("near") >= F.col("channel")).otherwise(F.col("near") <= F.col("channel")))
    order = Window.partitionBy("channel").orderBy(F.abs(F.col("near") - F.col("channel")))
    return x.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("channel", "near", "rank")


def rescaled_decay(decay: DataFrame, templates: DataFrame) -> DataFrame:
    """Decay slopes of templates in raw units over the template's largest |value|."""
    top = templates.groupBy("template_id").agg(F.max(F.array_max(magnitudes(F.col("wf")))).alias("top"))
    return decay.join(top, "template_id", "left").withColumn("spatial_decay", F.try_divide("spatial_decay", "top")).drop("top")


def display_channels(channels: DataFrame, k: int = 16, tolerance: float = 33.0) -> DataFrame:
    """(channel, near, rank): the k channels to draw around each, those of its own column and the next ones first, by distance."""
    a = channels.select("channel", F.col("x_um").alias("ax"), F.col("y_um").alias("ay"))
    b = channels.select(F.col("channel").alias("near"), F.col("x_um").alias("bx"), F.col("y_um").alias("by"))
    x = a.crossJoin(F.broadcast(b))  # a probe's geometry, a few hundred rows
    far = F.sqrt((F.col("ax") - F.col("bx")) ** 2 + (F.col("ay") - F.col("by")) ** 2)
    order = Window.partitionBy("channel").orderBy((F.abs(F.col("ax") - F.col("bx")) > tolerance).cast("int"), far, "near")
    return x.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("channel", "near", "rank")


def unwhitened(templates: DataFrame, inverse: DataFrame) -> DataFrame:
    """Whitened templates (template_id, channel, wf) times the inverse whitening matrix (channel, to_channel, weight)."""
    x = templates.join(inverse, "channel").select("template_id", "to_channel", "weight", F.posexplode("wf").alias("sample", "v"))
    y = x.groupBy("template_id", "to_channel", "sample").agg(F.sum(F.col("v") * F.col("weight")).alias("v"))
    return y.groupBy("template_id", "to_channel").agg(F.array_sort(F.collect_list(F.struct("sample", "v"))).alias("s")).select("template_id", F.col("to_channel").alias("channel"), F.col("s.v").alias("wf"))
