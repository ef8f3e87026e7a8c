"""PC-feature metrics: drift of the spikes' depth, isolation distance and L-ratio."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranks import by_rank, cut_lineage


def spike_depths(pcs: DataFrame, channels: DataFrame) -> DataFrame:
    """Depth of each spike: its channels' depths weighted by the squared positive first PC, plus 1e-3 below.

    pcs: (unit_id, spike_idx, t, channel, pc1).
    """
    w = F.greatest(F.col("pc1"), F.lit(0.0)) ** 2
    return pcs.join(channels.select("channel", "y_um"), "channel").groupBy("unit_id", "spike_idx", "t").agg((F.sum(F.col("y_um") * w) / (F.sum(w) + 1e-3)).alias("depth"))


def drift_bins(depths: DataFrame, bin_ticks: int) -> DataFrame:
    """Median depth of each unit's bins from its first spike; the last edge's bin is dropped, a short span has two bins."""
    u = depths.groupBy("unit_id").agg(F.min("t").alias("first"), (F.max("t") - F.min("t")).alias("span"))
    u = u.withColumn("size", F.when(F.col("span") < 2 * bin_ticks, F.col("span") / 2.0).otherwise(F.lit(float(bin_ticks)))).withColumn("n_bins", F.when(F.col("span") > 0, F.ceil(F.col("span") / F.col("size")) - 1))
    x = depths.join(u, "unit_id").withColumn("bin", F.floor((F.col("t") - F.col("first")) / F.col("size")).cast("int")).filter("bin < n_bins")
    return x.groupBy("unit_id", "bin").agg(F.median("depth").alias("median_depth"), F.count("*").alias("n"))


def drift(bins: DataFrame) -> DataFrame:
    """Range of the bin medians and the sum of their steps from one filled bin to the next."""
    step = F.abs(F.col("median_depth") - F.lag("median_depth").over(Window.partitionBy("unit_id").orderBy("bin")))
    return bins.withColumn("step", step).groupBy("unit_id").agg((F.max("median_depth") - F.min("median_depth")).alias("max_drift"), F.coalesce(F.sum("step"), F.lit(0.0)).alias("cumulative_drift"), F.count("*").alias("n_bins"))


def chi2_tail(x, dof: int):
    """P(X > x) for an even number of degrees, as a finite sum of native expressions."""
    h = x / 2
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
    total = F.aggregate(F.sequence(F.lit(1), F.lit(max(dof // 2 - 1, 1))), start, lambda a, k: F.struct((a["term"] * h / k).alias("term"), (a["sum"] + a["term"] * h / k).alias("sum")), lambda a: a["sum"])
    return F.exp(-h) * (total if dof > 2 else F.lit(1.0))


def unit_gaussians(features: DataFrame, dims: int) -> DataFrame:
    """(unit_id, n, mean, inverse) of each unit's feature vectors: sums of products natively, a small inverse in Python.

    features: (unit_id, spike_idx, f array of dims). The sums are combined map-side, so a
    unit of any size costs one row of dims^2 numbers a task.
    """
    f = F.col("f")
    sums = [F.sum(f[i]).alias(f"s{i}") for i in range(dims)] + [F.sum(f[i] * f[j]).alias(f"q{i}_{j}") for i in range(dims) for j in range(i, dims)]
    g = features.groupBy("unit_id").agg(F.count("*").alias("n"), *sums)
    packed = g.select("unit_id", "n", F.array(*[F.col(f"s{i}") for i in range(dims)]).alias("s"), F.array(*[F.col(f"q{min(i, j)}_{max(i, j)}") for i in range(dims) for j in range(dims)]).alias("q"))

    @F.pandas_udf("array<double>")
    def inverse(n: pd.Series, s: pd.Series, q: pd.Series) -> pd.Series:
        out = []
        for k, a, b in zip(n, s, q, strict=True):
            m = np.asarray(a) / k
            cov = (np.asarray(b).reshape(dims, dims) - k * np.outer(m, m)) / max(k - 1, 1)
            out.append(np.linalg.pinv(cov + 1e-10 * np.eye(dims)).ravel())
        return pd.Series(out)

    return packed.select("unit_id", "n", F.transform("s", lambda v: v / F.col("n")).alias("mean"), inverse("n", "s", "q").alias("inverse"))


def distances(features: DataFrame, unit_channels: DataFrame, dims: int, per_channel: int | None = None) -> DataFrame:
    """(unit_id, d2) squared Mahalanobis distance of other units' spikes that share a unit's first channel.

    unit_channels: (unit_id, first_channel, channels array). Candidates meet by an equi-join on
    the channel; each unit's mean and inverse ride along.
    per_channel: f holds so many values of each of its own unit's channels, channel after
    channel. Other spikes' values then go to the place that their channel has in this unit's
    list, and a channel that the other unit lacks gives zeros. None: the vectors of all units
    have one layout already and are compared place by place.
    """
    g = unit_gaussians(features, dims).join(unit_channels.select("unit_id", "first_channel", F.col("channels").alias("own")), "unit_id").filter(F.col("n") > dims)
    others = unit_channels.select(F.col("unit_id").alias("other_id"), F.col("channels").alias("theirs"), F.explode(F.array_distinct("channels")).alias("first_channel"))
    pairs = g.join(others, "first_channel").filter("other_id <> unit_id")
    x = pairs.join(features.select(F.col("unit_id").alias("other_id"), "f"), "other_id")
    if per_channel:
        places = [(F.array_position("theirs", F.get("own", F.lit(i // per_channel))), i % per_channel) for i in range(dims)]
        x = x.withColumn("f", F.array(*[F.when(at > 0, F.coalesce(F.get("f", ((at - 1) * per_channel + k).cast("int")), F.lit(0.0))).otherwise(0.0) for at, k in places]))
    diff = F.zip_with("f", "mean", lambda a, b: a - b)
    x = x.select("unit_id", "n", "inverse", diff.alias("d"))
    # d' M d as one sum over the flattened matrix
    quad = F.aggregate(F.sequence(F.lit(0), F.lit(dims * dims - 1)), F.lit(0.0), lambda s, k: s + F.get("inverse", k) * F.get(F.col("d"), F.floor(k / dims).cast("int")) * F.get(F.col("d"), k % dims))
    return x.select("unit_id", "n", quad.alias("d2"))


def isolation(features: DataFrame, unit_channels: DataFrame, dims: int, per_channel: int | None = None) -> DataFrame:
    """L-ratio and isolation distance: the (N+1)-th smallest distance of others, if there are more than N of them.

    The distances are written once. The order statistic is looked up by bins of the
    distances' logarithms, so that no unit's distances meet in one task.
    """
    d = cut_lineage(distances(features, unit_channels, dims, per_channel))
    g = d.groupBy("unit_id").agg(F.max("n").alias("n"), F.count("*").alias("n_other"), F.sum(chi2_tail(F.col("d2"), dims)).alias("l"))
    own = g.select("unit_id", F.col("n").alias("own"))
    ranked = by_rank(d.join(own, "unit_id"), ["unit_id", "own"], "d2", {"isolation_distance": lambda n: F.col("own")}, F.log1p)
    return g.join(ranked.select("unit_id", "isolation_distance"), "unit_id", "left").select("unit_id", "n", "n_other", (F.col("l") / F.col("n")).alias("l_ratio"), "isolation_distance")


def silhouette_ratio(features: DataFrame, unit_channels: DataFrame, dims: int, per_channel: int | None = None) -> DataFrame:
    """The MATLAB variant: mean distance of others over mean distance of the unit's own spikes (dims by construction of the inverse)."""
    d = distances(features, unit_channels, dims, per_channel).groupBy("unit_id").agg(F.avg("d2").alias("others"), F.max("n").alias("n"))
    return d.select("unit_id", (F.col("others") / (dims * (F.col("n") - 1) / F.col("n"))).alias("silhouette"))
