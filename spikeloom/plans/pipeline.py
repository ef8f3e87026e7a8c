"""End-to-end plans: unit quality and physiology, as metric tables joined on the unit."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import amplitude, correlogram, duplicates, labels, refractory, summary, trains, waveform
from ..operators.ranks import cut_lineage
from ..params import PhysiologyParams, QualityParams, Ticks

#: name -> fn(spikes, ticks) -> DataFrame(unit_id, ...): metrics added by users of the library.
EXTRA_METRICS: dict[str, Callable[[DataFrame, float], DataFrame]] = {}


def good_windows(spikes: DataFrame, p: QualityParams, k: Ticks) -> DataFrame:
    """(unit_id, start, end, any_good) of the longest run of chunks of the recording in which a unit is complete and clean.

    A chunk is good if less than max_perc_missing of its spikes are missing by the Gaussian
    estimate and its contamination is below max_rpv at the tau that suits all chunks best.
    """
    chunked = trains.in_chunks(spikes, k.chunk)
    big = trains.spike_counts(spikes).filter(F.col("n_spikes") >= p.small_unit_spikes).select("unit_id")
    chunked = chunked.join(big, "unit_id", "left_semi")
    sweep = cut_lineage(refractory.hill_sweep(chunked, list(k.taus), k.tau_c, k.tick, "chunk"))
    at = sweep.join(refractory.window_tau_index(sweep), "unit_id").filter(F.col("tau_idx") == F.col("rpv_window_index"))
    per = at.select("unit_id", "chunk", "contamination").join(amplitude.missing_gaussian(chunked, "chunk"), ["unit_id", "chunk"], "left")
    runs = trains.good_runs(per, (F.col("missing_gaussian") < p.max_perc_missing) & (F.col("contamination") < p.max_rpv))
    edges = trains.chunk_edges(spikes, k.chunk)
    first, last = edges.select(F.col("chunk").alias("first_chunk"), "start"), edges.select(F.col("chunk").alias("last_chunk"), "end")
    return runs.join(first, "first_chunk").join(last, "last_chunk").select("unit_id", "start", "end", "any_good")


def template_metrics(templates: DataFrame, channels: DataFrame, p: QualityParams, fs: float, n_points: int = 6, baseline: tuple[int, int] = (0, 10)) -> DataFrame:
    """Waveform metrics of every unit's template (template_id = unit_id); spatial decay only if the probe is dense enough."""
    peak = waveform.peak_channel(templates).select("template_id", "wf")
    shapes = waveform.waveform_shape(peak, fs, p.min_prominence_share)
    shapes = shapes.withColumns({c: summary.finite(F.col(c)) for c in ("second_peak_to_trough", "peak1_to_peak2", "main_peak_to_trough", "trough_to_peak2")})
    flat = peak.select("template_id", waveform.baseline_flatness(F.col("wf"), *baseline).alias("baseline_flatness"))
    points = waveform.decay_points(templates, channels, n_points)
    decay = (waveform.linear_decay if p.linear_decay else waveform.exponential_decay)(points).select("template_id", "spatial_decay")
    allowed = waveform.geometry_allows_decay(channels)  # one row
    decay = decay.crossJoin(F.broadcast(allowed)).select("template_id", F.when(F.col("allowed"), F.col("spatial_decay")).alias("spatial_decay"))
    return shapes.join(flat, "template_id").join(decay, "template_id", "left").withColumnRenamed("template_id", "unit_id")


def unit_quality(spikes: DataFrame, templates: DataFrame, channels: DataFrame, p: QualityParams, k: Ticks, fs: float, extra: list[DataFrame] | None = None) -> DataFrame:
    """One row a unit with its metrics and label, from raw trains and templates.

    Duplicates go first; the metrics are then taken in each unit's good window: spikes,
    contamination, presence, missing spikes, with the template's metrics beside them. Units
    under the small-unit gate keep n_spikes only. spikes: (unit_id, spike_idx, t, amplitude,
    channel); extra: tables by unit_id with further metrics, such as raw_amplitude and snr,
    max_drift, isolation_distance and l_ratio, which the label uses if the parameters say so.
    """
    kept = spikes if k.dedup is None else duplicates.without_duplicates(spikes, k.dedup)
    kept = cut_lineage(kept.select("unit_id", "spike_idx", "t", "amplitude"))
    raw = trains.spike_counts(kept).select("unit_id", F.col("n_spikes").alias("n_raw"))
    windows = cut_lineage(good_windows(kept, p, k))
    used = cut_lineage(trains.within_window(kept, windows))
    counts = trains.spike_counts(used).select("unit_id", "n_spikes")
    rpv = refractory.estimate(used, p.rpv_method, list(k.taus), k.tau_c, k.tick, p.confidence)
    presence = trains.presence_ratio(used, k.presence_bin, window=windows.select("unit_id", "start", "end")).select("unit_id", "presence_ratio")
    missing = amplitude.missing_gaussian(used).select("unit_id", F.col("missing_gaussian").alias("percent_missing"))
    symmetric = amplitude.missing_symmetric(amplitude.histogram(amplitude.drop_outliers(used))).select("unit_id", F.col("missing_symmetric").alias("percent_missing_symmetric"))
    parts = [counts, windows, rpv, presence, missing, symmetric, template_metrics(templates, channels, p, fs), *(extra or []), *[f(used, k.tick) for f in EXTRA_METRICS.values()]]
    x = reduce(lambda a, b: a.join(b, "unit_id", "left"), parts, raw)
    big = F.col("n_raw") >= p.small_unit_spikes
    x = x.select("unit_id", F.when(big, F.coalesce("n_spikes", "n_raw")).otherwise(F.col("n_raw")).alias("n_spikes"), *[F.when(big, F.col(c)).alias(c) for c in x.columns if c not in ("unit_id", "n_spikes", "n_raw")])
    return labels.unit_types(x, p)


def physiology(spikes: DataFrame, waves: DataFrame, fs: float, p: PhysiologyParams, tick: float, acg_bin: int, acg_window: int, long_isi: int, rate_bin: int, region: str) -> DataFrame:
    """Interval, rate, correlogram and waveform properties and the cell type of units with enough spikes."""
    units = trains.spike_counts(spikes).filter(F.col("n_spikes") >= p.min_spikes).select("unit_id")
    kept = spikes.join(units, "unit_id", "left_semi")
    half = correlogram.half_bins(acg_window, acg_bin)
    dense = correlogram.dense(correlogram.autocorrelogram(kept, acg_bin, acg_window), units, half)
    q = max(half // 5, 1)
    acg = correlogram.features(dense, half, acg_bin * tick * 1000, q, 2 * q, q, min(4 * q, half), max(half // 2, 4))
    shape = waves.select(F.col("template_id").alias("unit_id"), waveform.duration_us(F.col("wf"), fs).alias("duration_us"))
    isi = trains.interval_properties(kept, long_isi)
    rates = trains.rate_properties(kept, rate_bin, tick)
    x = reduce(lambda a, b: a.join(b, "unit_id", "left"), [isi, rates, acg, shape], units)
    return x.join(labels.cell_types(x, region, p), "unit_id")
