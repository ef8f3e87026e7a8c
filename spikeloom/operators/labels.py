"""Rule-based labels: unit quality, the failure table, and cell types by brain region.

Metrics are nullable columns of one row a unit; a comparison with null never holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import PhysiologyParams, QualityParams

#: Label names by code.
NAMES = {0: "NOISE", 1: "GOOD", 2: "MUA", 3: "NON-SOMA"}
SPLIT_NAMES = {0: "NOISE", 1: "GOOD", 2: "MUA", 3: "NON-SOMA GOOD", 4: "NON-SOMA MUA"}


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def noise_rules(df: DataFrame, p: QualityParams) -> dict[str, Column]:
    c = F.col
    rules = {
        "peaks": c("n_peaks") > p.max_n_peaks, "troughs": c("n_troughs") > p.max_n_troughs,
        "duration": (c("duration_us") < p.min_wv_duration) | (c("duration_us") > p.max_wv_duration),
        "baseline": c("baseline_flatness") > p.max_wv_baseline_fraction, "second_peak": c("second_peak_to_trough") > p.max_scnd_peak_to_trough,
    }
    if "spatial_decay" in df.columns:
        low, high = c("spatial_decay") < p.min_spatial_decay, c("spatial_decay") > p.max_spatial_decay
        rules["spatial_decay"] = c("spatial_decay") < p.min_spatial_decay_linear if p.linear_decay else low | high
    return {k: _true(v) for k, v in rules.items()}


def mua_rules(df: DataFrame, p: QualityParams) -> dict[str, Column]:
    c = F.col
    rules = {
        "missing": c("percent_missing") > p.max_perc_missing, "few_spikes": c("n_spikes") < p.min_num_spikes, "rpv": c("contamination") > p.max_rpv, "presence": c("presence_ratio") < p.min_presence_ratio,
    }
    if p.use_raw:
        rules |= {"amplitude": c("raw_amplitude") < p.min_amplitude, "snr": c("raw_amplitude").isNotNull() & (c("snr") < p.min_snr)}
    if p.use_drift:
        rules["drift"] = c("max_drift") > p.max_drift
    if p.use_distance:
        rules |= {"isolation": c("isolation_distance") < p.min_isolation_distance, "l_ratio": c("l_ratio") > p.max_l_ratio}
    return {k: _true(v) for k, v in rules.items()}


def non_somatic(p: QualityParams) -> Column:
    """(all four of the small-first-peak tests) or a main peak too large against the trough."""
    c = F.col
    early = (c("trough_to_peak2") < p.min_trough_to_peak2) & (c("peak_before_width") < p.min_width_first_peak) & (c("trough_width") < p.min_width_main_trough) & (c("peak1_to_peak2") > p.max_peak1_to_peak2)
    return _true(early) | _true(c("main_peak_to_trough") > p.max_main_peak_to_trough)


def _any(rules: dict[str, Column]) -> Column:
    out = F.lit(False)
    for r in rules.values():
        out = out | r
    return out


def unit_types(metrics: DataFrame, p: QualityParams) -> DataFrame:
    """metrics with unit_type and unit_type_string: noise, then multi-unit, then good; non-somatic replaces the last two; no spikes: null and ''."""
    noise = F.col("n_peaks").isNull() | _any(noise_rules(metrics, p))
    mua = _any(mua_rules(metrics, p))
    soma = F.when(non_somatic(p), F.when(mua, 4 if p.split_good_and_mua_non_somatic else 3).otherwise(3))
    code = F.when(F.col("n_spikes") > 0, F.when(noise, 0).otherwise(F.coalesce(soma, F.when(mua, 2).otherwise(1))))
    names = SPLIT_NAMES if p.split_good_and_mua_non_somatic else NAMES
    text = F.lit("")
    for k, v in names.items():
        text = F.when(F.col("unit_type") == k, v).otherwise(text)
    return metrics.withColumn("unit_type", code.cast("int")).withColumn("unit_type_string", text)


def failure_table(typed: DataFrame, p: QualityParams) -> DataFrame:
    """One boolean a criterion, true only for units of the class that the criterion decides."""
    is_ = lambda *names: F.col("unit_type_string").isin(*names)
    cols = [(is_("NOISE") & v).alias(f"fails_{k}") for k, v in noise_rules(typed, p).items()]
    cols += [(is_("MUA") & v).alias(f"fails_{k}") for k, v in mua_rules(typed, p).items()]
    cols.append((is_("NON-SOMA", "NON-SOMA GOOD", "NON-SOMA MUA") & non_somatic(p)).alias("fails_somatic"))
    return typed.select("unit_id", "unit_type_string", *cols)


def striatum_type(p: PhysiologyParams) -> Column:
    """MSN, FSI, TAN or UIN from duration_us, suppression_ms and prop_long; any null: Unknown."""
    d, s, l = F.col("duration_us"), F.col("suppression_ms"), F.col("prop_long")
    wide = d > p.template_duration_threshold
    slow = s >= p.post_spike_suppression_threshold
    return F.when(d.isNull() | s.isNull() | l.isNull(), "Unknown").when(wide & ~slow, "MSN").when(~wide & (l <= p.prop_isi_threshold), "FSI").when(wide & slow, "TAN").otherwise("UIN")


def cortex_type(p: PhysiologyParams) -> Column:
    d = F.col("duration_us")
    return F.when(d.isNull(), "Unknown").when(d > p.template_duration_threshold, "Wide-spiking").otherwise("Narrow-spiking")


def cell_types(properties: DataFrame, region: str, p: PhysiologyParams | None = None) -> DataFrame:
    """(unit_id, cell_type) for striatum or cortex; any other region has null."""
    p = p or PhysiologyParams()
    kind = {"striatum": striatum_type, "cortex": cortex_type}.get(region.lower())
    return properties.select("unit_id", (kind(p) if kind else F.lit(None).cast("string")).alias("cell_type"))


def distribution(labelled: DataFrame, column: str, names: list[str] | None = None) -> DataFrame:
    """(label, n, percent) of a label column; names that no row has count 0."""
    n = labelled.groupBy(F.col(column).alias("label")).agg(F.count("*").alias("n"))
    if names:
        every = labelled.sparkSession.createDataFrame([(x,) for x in names], "label string")
        n = every.join(n, "label", "full").withColumn("n", F.coalesce("n", F.lit(0)))
    total = labelled.agg(F.count("*").alias("total"))  # one row
    return n.crossJoin(F.broadcast(total)).select("label", "n", F.try_divide(100.0 * F.col("n"), F.col("total")).alias("percent"))
