"""Tables behind the summary plots: failure combinations, metric histograms, proportions across datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def combinations(failures: DataFrame) -> DataFrame:
    """(failed, n): exact combinations of failed criteria, comma-joined; units without any are ''."""
    flags = [c for c in failures.columns if c.startswith("fails_")]
    names = F.array_compact(F.array(*[F.when(F.col(c), c.removeprefix("fails_")) for c in flags]))
    return failures.groupBy(F.array_join(F.array_sort(names), ",").alias("failed")).agg(F.count("*").alias("n"))


def criterion_totals(failures: DataFrame) -> DataFrame:
    """(criterion, n) inclusive counts."""
    flags = [c for c in failures.columns if c.startswith("fails_")]
    rows = F.array(*[F.struct(F.lit(c.removeprefix("fails_")).alias("criterion"), F.col(c).cast("long").alias("hit")) for c in flags])
    return failures.select(F.inline(rows)).groupBy("criterion").agg(F.sum("hit").alias("n"))


def metric_histograms(metrics: DataFrame, names: list[str], bins: int = 40, own: dict[str, int] | None = None, whole: tuple[str, ...] = ()) -> DataFrame:
    """(metric, bin, left, n, share) of equi-width bins over each metric's range, zero-filled, nulls left out.

    own: metrics with another number of bins; whole: counts, whose bins are the whole numbers
    from the least to the largest.
    """
    of = lambda m: F.lit((own or {}).get(m, bins)).cast("int")
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), of(m).alias("bins"), F.lit(m in whole).alias("whole")) for m in names])
    x = metrics.select(F.inline(rows)).filter("value is not null")
    r = x.groupBy("metric", "whole", "bins").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("*").alias("total")).filter("hi > lo or whole")
    # a whole number k fills the bin from k to k + 1
    r = r.withColumn("bins", F.when(F.col("whole"), (F.col("hi") - F.col("lo") + 1).cast("int")).otherwise(F.col("bins"))).withColumn("hi", F.when(F.col("whole"), F.col("hi") + 1).otherwise(F.col("hi")))
    span = F.col("hi") - F.col("lo")
    at = F.least(F.floor((F.col("value") - F.col("lo")) * F.col("bins") / span), F.col("bins") - 1).cast("int")
    n = x.select("metric", "value").join(r, "metric").groupBy("metric", at.alias("bin")).agg(F.count("*").alias("n"))
    grid = r.select("*", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin")).join(n, ["metric", "bin"], "left")
    count = F.coalesce("n", F.lit(0)).cast("long")
    return grid.select("metric", "bin", (F.col("lo") + F.col("bin") * span / F.col("bins")).alias("left"), count.alias("n"), (count / F.col("total")).alias("share"))


def thresholds(p) -> list[tuple[str, float | None, float | None]]:
    """(metric, least, most) that a good unit may have, for the lines in the histograms."""
    return [
        ("n_peaks", None, p.max_n_peaks), ("n_troughs", None, p.max_n_troughs), ("duration_us", p.min_wv_duration, p.max_wv_duration), ("baseline_flatness", None, p.max_wv_baseline_fraction),
        ("second_peak_to_trough", None, p.max_scnd_peak_to_trough), ("spatial_decay", p.min_spatial_decay, p.max_spatial_decay), ("percent_missing", None, p.max_perc_missing),
        ("n_spikes", p.min_num_spikes, None), ("contamination", None, p.max_rpv), ("presence_ratio", p.min_presence_ratio, None), ("raw_amplitude", p.min_amplitude, None), ("snr", p.min_snr, None),
        ("max_drift", None, p.max_drift), ("isolation_distance", p.min_isolation_distance, None), ("l_ratio", None, p.max_l_ratio),
    ]


def dataset_proportions(labelled: DataFrame, dataset: str, label: str) -> DataFrame:
    """(label, total, mean_share, se): share of each label in every dataset, 0 where absent; se = sample deviation / sqrt(datasets)."""
    n = labelled.groupBy(F.col(dataset).alias("dataset"), F.col(label).alias("label")).agg(F.count("*").alias("n"))
    size = labelled.groupBy(F.col(dataset).alias("dataset")).agg(F.count("*").alias("size"))
    # a row for each dataset and label: the labels are a handful
    labels = n.agg(F.collect_set("label").alias("labels"))
    grid = size.crossJoin(F.broadcast(labels)).select("dataset", "size", F.explode("labels").alias("label"))
    x = grid.join(n, ["dataset", "label"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    share = F.col("n") / F.col("size")
    return x.groupBy("label").agg(F.sum("n").alias("total"), F.avg(share).alias("mean_share"), (F.stddev_samp(share) / F.sqrt(F.count("*"))).alias("se"), F.count("*").alias("n_datasets"))


def overlay(waves: DataFrame, typed: DataFrame, label: str) -> DataFrame:
    """Peak-channel waveforms of a class, for overlay panels."""
    return waves.join(typed.filter(F.col("unit_type_string") == label).select(F.col("unit_id").alias("template_id")), "template_id", "left_semi")


def finite(c: Column) -> Column:
    """Infinite values as null."""
    return F.when(F.abs(c) != F.lit(float("inf")), c)


def unit_report(typed: DataFrame, p) -> str:
    """Units of each label and, of each criterion, how many units miss it; one row a label and a criterion comes to the driver."""
    counts = {r["unit_type_string"] or "empty": r["n"] for r in typed.groupBy("unit_type_string").agg(F.count("*").alias("n")).collect()}
    limits = [(m, lo, hi) for m, lo, hi in thresholds(p) if m in typed.columns]
    misses = [F.count_if((F.col(m) < lo if lo is not None else F.lit(False)) | (F.col(m) > hi if hi is not None else F.lit(False))).alias(m) for m, lo, hi in limits]
    row = typed.agg(*misses).first() if misses else {}
    bound = lambda lo, hi: " to ".join(f"{x:g}" for x in (lo, hi) if x is not None) if None not in (lo, hi) else f"at least {lo:g}" if hi is None else f"at most {hi:g}"
    return "\n".join([f"{sum(counts.values())} units: " + ", ".join(f"{n} {k}" for k, n in sorted(counts.items())), *[f"  {m} ({bound(lo, hi)}): {row[m]} units outside" for m, lo, hi in limits]])


def methods_text(p, typed: DataFrame) -> str:
    """A methods paragraph with the thresholds used and the number of units of each label."""
    counts = {r["unit_type_string"] or "empty": r["n"] for r in typed.groupBy("unit_type_string").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    told = ", ".join(f"{n} {name}" for name, n in sorted(counts.items()))
    return (
        f"Units were judged on waveform shape, completeness and contamination. A unit was noise with more than {p.max_n_peaks} peaks or {p.max_n_troughs} troughs, a duration outside "
        f"{p.min_wv_duration:g}-{p.max_wv_duration:g} us or a baseline over {p.max_wv_baseline_fraction:g} of its maximum; multi-unit with over {p.max_perc_missing:g} % of spikes missing, fewer than "
        f"{p.min_num_spikes} spikes, over {100 * p.max_rpv:g} % refractory-period violations or a presence ratio under {p.min_presence_ratio:g}. Of {total} units: {told}."
    )
