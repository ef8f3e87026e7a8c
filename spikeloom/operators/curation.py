"""Manual curation: agreement with automatic labels, threshold suggestions, merged templates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Names of manual codes, and automatic names that are spelled otherwise.
MANUAL = {-1: "Unknown", 0: "Noise", 1: "Good", 2: "MUA", 3: "Non-somatic"}
SPELLED = {"NOISE": "Noise", "GOOD": "Good", "MUA": "MUA", "NON-SOMA": "Non-somatic"}
#: Metric, direction, default threshold of each suggestion.
SUGGESTED = (
    ("n_spikes", "min", 300.0), ("presence_ratio", "min", 0.7), ("contamination", "max", 0.1), ("percent_missing", "max", 20.0),
    ("n_peaks", "max", 2.0), ("n_troughs", "max", 1.0), ("duration_us", "max", 1150.0), ("spatial_decay", "min", -0.008),
)


def _named(col, names: dict):
    out = F.lit("Unknown") if -1 in names else col
    for k, v in names.items():
        out = F.when(col == k, v).otherwise(out)
    return out


def joined(manual: DataFrame, auto: DataFrame) -> DataFrame:
    """(unit_id, manual, auto) of the units that have both, by one inner equi-join."""
    return manual.join(auto, "unit_id").select("unit_id", _named(F.col("manual_classification"), MANUAL).alias("manual"), _named(F.col("unit_type_string"), SPELLED).alias("auto"))


def confusion(pairs: DataFrame) -> DataFrame:
    """(manual, auto, n) with the margins under 'All', from one cube."""
    return pairs.cube("manual", "auto").agg(F.count("*").alias("n")).select(F.coalesce("manual", F.lit("All")).alias("manual"), F.coalesce("auto", F.lit("All")).alias("auto"), "n")


def concordance(pairs: DataFrame) -> DataFrame:
    """(class, n_manual, n_auto, n_both, precision, recall) by class, and the overall percent agreement under 'All'."""
    agree = F.col("manual") == F.col("auto")
    sides = pairs.select(F.explode(F.array(F.struct(F.col("manual").alias("class"), F.lit(1).alias("m"), F.lit(0).alias("a")), F.struct(F.col("auto").alias("class"), F.lit(0).alias("m"), F.lit(1).alias("a")))).alias("s"), agree.alias("agree")).select("s.*", "agree")
    per = sides.groupBy("class").agg(F.sum("m").alias("n_manual"), F.sum("a").alias("n_auto"), F.sum(F.when(F.col("agree"), F.col("m")).otherwise(0)).alias("n_both"))
    per = per.select("class", "n_manual", "n_auto", "n_both", F.try_divide("n_both", "n_auto").alias("precision"), F.try_divide("n_both", "n_manual").alias("recall"))
    whole = pairs.agg(F.count("*").alias("n"), F.count_if(agree).alias("same")).select(F.lit("All").alias("class"), F.col("n").alias("n_manual"), F.col("n").alias("n_auto"), F.col("same").alias("n_both"), F.try_divide("same", "n").alias("precision"), F.try_divide("same", "n").alias("recall"))
    return per.unionByName(whole)


def agreement_counts(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy(F.concat_ws(" -> ", "auto", "manual").alias("change")).agg(F.count("*").alias("n"))


def threshold_suggestions(metrics: DataFrame, manual: DataFrame, suggested=SUGGESTED) -> DataFrame:
    """(metric, direction, current, suggestion, good_now, good_then) where moving a threshold lets more good units pass.

    A lower bound moves to the worst good unit, an upper one to the least noise unit; without
    good or noise values there is no row. n_peaks over 1 among noise suggests 1.
    """
    have = [s for s in suggested if s[0] in metrics.columns]
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(d).alias("direction"), F.lit(t).alias("current"), F.col(m).cast("double").alias("value")) for m, d, t in have])
    x = manual.join(metrics, "unit_id", "left").select(_named(F.col("manual_classification"), MANUAL).alias("manual"), F.inline(rows)).filter("value is not null and manual in ('Good', 'Noise')")
    good, noise = F.col("manual") == "Good", F.col("manual") == "Noise"
    # both passing counts need the suggested value: it is one of a dozen rows, joined back
    s = x.groupBy("metric", "direction", "current").agg(F.min(F.when(good, F.col("value"))).alias("least_good"), F.min(F.when(noise, F.col("value"))).alias("least_noise"), F.max(F.when(noise, F.col("value"))).alias("most_noise"))
    s = s.filter("least_good is not null and least_noise is not null").withColumn("suggestion", F.when(F.col("direction") == "min", F.col("least_good")).otherwise(F.col("least_noise")))
    passes = lambda t: F.count_if(good & F.when(F.col("direction") == "min", F.col("value") >= F.col(t)).otherwise(F.col("value") <= F.col(t)))
    y = x.join(F.broadcast(s.select("metric", "suggestion", "most_noise")), "metric").groupBy("metric", "direction", "current", "suggestion", "most_noise").agg(passes("current").alias("good_now"), passes("suggestion").alias("good_then"))
    forced = (F.col("metric") == "n_peaks") & (F.col("most_noise") > 1) & (F.col("current") > 1)
    better = (F.col("current") > F.col("suggestion")) & (F.col("good_then") > F.col("good_now"))
    return y.filter(forced | better).select("metric", "direction", "current", F.when(forced, 1.0).otherwise(F.col("suggestion")).alias("suggestion"), "good_now", "good_then")


def merged_templates(spikes: DataFrame, templates: DataFrame) -> DataFrame:
    """templates with a row for each unit that curation made: the mean of its spikes' templates.

    spikes: (unit_id, template_id). A unit whose id is a template's keeps that; merges average,
    splits copy.
    """
    made = spikes.select("unit_id", "template_id").distinct().join(templates.select(F.col("template_id").alias("unit_id")).distinct(), "unit_id", "left_anti")
    x = made.join(templates, "template_id").select("unit_id", "channel", F.posexplode("wf").alias("sample", "v")).groupBy("unit_id", "channel", "sample").agg(F.avg("v").alias("v"))
    new = x.groupBy("unit_id", "channel").agg(F.array_sort(F.collect_list(F.struct("sample", "v"))).alias("s")).select(F.col("unit_id").alias("template_id"), "channel", F.col("s.v").alias("wf"))
    return templates.select("template_id", "channel", "wf").unionByName(new)


def default_manual(units: DataFrame, manual: DataFrame) -> DataFrame:
    """Every unit with its manual code, -1 where there is none."""
    return units.select("unit_id").join(manual, "unit_id", "left").select("unit_id", F.coalesce("manual_classification", F.lit(-1)).alias("manual_classification"))


def neighbours_of_class(typed: DataFrame, label: str | None, *by: str, column: str = "unit_type_string") -> DataFrame:
    """For each unit the next and the previous unit of a class, and both with wrap-around; by: recordings, each with its own units.

    label None: units that have no value yet, such as those not classified by hand.
    """
    w = Window.partitionBy(*by).orderBy("unit_id")  # one row a unit; a recording's units are one group
    hit = F.when(F.col(column).isNull() if label is None else F.col(column) == label, F.col("unit_id"))
    x = typed.select(*by, "unit_id", hit.alias("hit"))
    nxt = F.min("hit").over(w.rowsBetween(1, Window.unboundedFollowing))
    prev = F.max("hit").over(w.rowsBetween(Window.unboundedPreceding, -1))
    every = Window.partitionBy(*by)
    return x.select(*by, "unit_id", nxt.alias("next_unit"), prev.alias("previous_unit"), F.coalesce(nxt, F.min("hit").over(every)).alias("next_wrapped"), F.coalesce(prev, F.max("hit").over(every)).alias("previous_wrapped"))


def compared(metrics: DataFrame, manual: DataFrame) -> DataFrame:
    """Units that have both labels, with all their metrics: what a comparison plot and its CSV show."""
    auto = metrics.select("unit_id", "unit_type_string")
    return joined(manual, auto).withColumn("agree", F.col("manual") == F.col("auto")).join(metrics.drop("unit_type_string"), "unit_id")


def compare(metrics: DataFrame, manual: DataFrame) -> dict[str, DataFrame]:
    """The whole comparison of labelled metrics with manual labels: side by side, confusion, concordance, changes and suggestions."""
    both = joined(manual, metrics.select("unit_id", "unit_type_string"))
    return {
        "compared": compared(metrics, manual), "confusion": confusion(both), "concordance": concordance(both), "changes": agreement_counts(both),
        "suggestions": threshold_suggestions(metrics, manual),
    }


def report(found: dict[str, DataFrame]) -> str:
    """The comparison as text: agreement, confusion and suggested thresholds, a few dozen rows whatever the recording."""
    whole = found["concordance"].filter("class = 'All'").first()
    lines = [f"Overall concordance: {100 * (whole['precision'] or 0):.1f} % of {whole['n_manual']} units"]
    lines += [f"  {r['manual']} / {r['auto']}: {r['n']}" for r in found["confusion"].orderBy("manual", "auto").collect()]
    rows = found["suggestions"].orderBy("metric").collect()
    lines += [f"  {r['metric']}: {r['current']:g} -> {r['suggestion']:g} ({r['good_now']} -> {r['good_then']} good units pass)" for r in rows] or ["No thresholds to change"]
    return "\n".join(lines)
