"""Saved results: metric tables, one TSV a metric, parameters, and their reload."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def metric_rows(metrics: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(unit_id, metric, value) long form of the numeric metrics."""
    names = names or [c for c, t in metrics.dtypes if c != "unit_id" and t in ("double", "int", "bigint", "float")]
    return metrics.select("unit_id", *[F.col(c).cast("double") for c in names]).unpivot("unit_id", names, "metric", "value")


def write_single(df: DataFrame, path: str, sep: str = ",") -> None:
    """One delimited text file with a header at exactly `path`: tables of a row a unit, for programs that know no folders."""
    spark = df.sparkSession
    staging = f"{path}.writing"
    df.coalesce(1).write.mode("overwrite").option("sep", sep).option("header", True).csv(staging)
    path_of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = path_of(staging).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    part = next(f.getPath() for f in files.listStatus(path_of(staging)) if f.getPath().getName().startswith("part-"))
    files.delete(path_of(path), False)
    files.rename(part, path_of(path))
    files.delete(path_of(staging), True)


def params_frame(spark: SparkSession, params: dict) -> DataFrame:
    """One row: numbers, booleans and texts as they are, paths and other objects as text; sequences and arrays are left out, as null is."""
    kept = {k: v if isinstance(v, (bool, int, float, str)) else str(v) for k, v in params.items() if v is not None and not hasattr(v, "__len__") or isinstance(v, str)}
    return spark.createDataFrame([kept])


def save_params(spark: SparkSession, params: dict, folder: str, name: str = "parameters") -> None:
    row = params_frame(spark, params)
    row.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    write_single(row, f"{folder}/{name}.csv")


def save_results(metrics: DataFrame, params, folder: str) -> None:
    """Parquet and CSV of the metrics, the one-row parameter table, and cluster_<metric>.tsv files (cluster_id, <metric>) for sorter viewers."""
    spark = metrics.sparkSession
    metrics.write.mode("overwrite").parquet(f"{folder}/metrics.parquet")
    saved = spark.read.parquet(f"{folder}/metrics.parquet")
    write_single(saved.select([c for c, t in saved.dtypes if not t.startswith("array")]), f"{folder}/metrics.csv")
    save_params(spark, vars(params), folder)
    save_tsv(saved, folder)


def save_tsv(metrics: DataFrame, folder: str, names: list[str] | None = None) -> None:
    """cluster_<metric>.tsv for each number, and cluster_bc_unitType.tsv; a trailing folder called after the engine's results is left out."""
    folder = folder.rstrip("/").removesuffix("/spikeloom")
    names = names or [c for c, t in metrics.dtypes if c not in ("unit_id", "unit_type") and t in ("double", "int", "bigint", "float")]
    for name in names:
        write_single(metrics.select(F.col("unit_id").alias("cluster_id"), name).orderBy("cluster_id"), f"{folder}/cluster_{name}.tsv", "\t")
    if "unit_type_string" in metrics.columns:
        write_single(metrics.select(F.col("unit_id").alias("cluster_id"), F.col("unit_type_string").alias("bc_unitType")).orderBy("cluster_id"), f"{folder}/cluster_bc_unitType.tsv", "\t")


def load_results(spark: SparkSession, folder: str) -> tuple[DataFrame, dict]:
    """Saved metrics with empty_unit, and the parameters."""
    metrics = spark.read.parquet(f"{folder}/metrics.parquet").withColumn("empty_unit", F.coalesce(F.col("n_spikes") == 0, F.lit(True)))
    return metrics, spark.read.parquet(f"{folder}/parameters.parquet").first().asDict()


def all_templates(metrics: DataFrame, templates: DataFrame) -> DataFrame:
    """metrics with a row for every template; those without spikes are empty units."""
    every = templates.select(F.col("template_id").alias("unit_id")).distinct()
    return every.join(metrics, "unit_id", "left").withColumn("empty_unit", F.coalesce(F.col("n_spikes") == 0, F.lit(True)))


def load_tsv(spark: SparkSession, folder: str, metric: str) -> DataFrame:
    return spark.read.option("sep", "\t").option("header", True).schema(f"cluster_id long, `{metric}` double").csv(f"{folder}/cluster_{metric}.tsv")


#: Names of the metrics in files that the MATLAB tools read.
MATLAB = {
    "n_peaks": "nPeaks", "n_troughs": "nTroughs", "duration_us": "waveformDuration_peakTrough", "spatial_decay": "spatialDecaySlope", "baseline_flatness": "waveformBaselineFlatness",
    "second_peak_to_trough": "scndPeakToTroughRatio", "peak1_to_peak2": "peak1ToPeak2Ratio", "main_peak_to_trough": "mainPeakToTroughRatio", "trough_to_peak2": "troughToPeak2Ratio",
    "peak_before_width": "mainPeak_before_width", "trough_width": "mainTrough_width", "percent_missing": "percentageSpikesMissing_gaussian", "percent_missing_symmetric": "percentageSpikesMissing_symmetric",
    "n_spikes": "nSpikes", "contamination": "fractionRPVs_estimatedTauR", "presence_ratio": "presenceRatio", "raw_amplitude": "rawAmplitude", "snr": "signalToNoiseRatio",
}


def matlab_metrics(metrics: DataFrame, p) -> DataFrame:
    """metrics under their MATLAB names; peak1ToPeak2Ratio is 0 where the other tests of a small first peak fail."""
    c = F.col
    early = (c("trough_to_peak2") < p.min_trough_to_peak2) & (c("peak_before_width") < p.min_width_first_peak) & (c("trough_width") < p.min_width_main_trough)
    out = metrics.withColumn("peak1_to_peak2", F.when(early, c("peak1_to_peak2")).otherwise(0.0))
    return out.withColumnsRenamed({k: v for k, v in MATLAB.items() if k in out.columns})


def save_matlab(metrics: DataFrame, p, folder: str) -> None:
    """The same files as `save_tsv` under MATLAB names; files of earlier runs are replaced."""
    save_tsv(matlab_metrics(metrics, p), folder, [v for k, v in MATLAB.items() if k in metrics.columns])


def load_matlab(spark: SparkSession, folder: str) -> DataFrame:
    """(unit_id, metrics) of a folder of MATLAB-named files, in this engine's names; missing files are left out."""
    path_of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = path_of(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = None
    for ours, theirs in MATLAB.items():
        if files.exists(path_of(f"{folder}/cluster_{theirs}.tsv")):
            one = load_tsv(spark, folder, theirs).select(F.col("cluster_id").alias("unit_id"), F.col(theirs).alias(ours))
            out = one if out is None else out.join(one, "unit_id", "full")
    if out is None:
        raise ValueError(f"no metric files in {folder}")
    return out


def save_raw_waveforms(waves: DataFrame | None, folder: str) -> None:
    """(unit_id, channel, wf) mean raw waveforms; nothing is written without any."""
    if waves is not None:
        waves.write.mode("overwrite").parquet(f"{folder}/raw_waveforms.parquet")


def load_raw_waveforms(spark: SparkSession, folder: str, units: DataFrame) -> DataFrame:
    """Raw waveforms of every unit of a table; units without a saved one have nulls.

    Folders of the older layout hold one table a unit, unit=<id>/, and are read likewise.
    """
    path_of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = path_of(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(path_of(f"{folder}/raw_waveforms.parquet")):
        saved = spark.read.parquet(f"{folder}/raw_waveforms.parquet")
    else:
        saved = spark.read.parquet(f"{folder}/raw_waveforms_by_unit").withColumnRenamed("unit", "unit_id")
    return units.select("unit_id").join(saved, "unit_id", "left")


def save_properties(properties: DataFrame, params, folder: str) -> None:
    """Physiological properties and cell types, and their parameters."""
    properties.write.mode("overwrite").parquet(f"{folder}/properties.parquet")
    save_params(properties.sparkSession, vars(params), folder, "properties_parameters")


def load_properties(spark: SparkSession, folder: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(f"{folder}/properties.parquet"), spark.read.parquet(f"{folder}/properties_parameters.parquet").first().asDict()


def save_tau_table(table: DataFrame, folder: str) -> None:
    """Contamination of each unit, a column a tau."""
    table.write.mode("overwrite").parquet(f"{folder}/contamination_by_tau.parquet")


def save_duplicate_mask(spikes: DataFrame, losers: DataFrame, folder: str) -> None:
    """(spike_idx, duplicate) of every spike."""
    gone = losers.select("spike_idx").distinct().withColumn("duplicate", F.lit(True))
    spikes.select("spike_idx").join(gone, "spike_idx", "left").select("spike_idx", F.coalesce("duplicate", F.lit(False)).alias("duplicate")).write.mode("overwrite").parquet(f"{folder}/duplicate_mask.parquet")


def load_duplicate_mask(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/duplicate_mask.parquet")


def save_display_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """The tables behind the interactive views, by name."""
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{folder}/display/{name}.parquet")


def load_display_tables(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/display/{name}.parquet") for name in names}


def save_text(spark: SparkSession, text: str, path: str) -> None:
    """A small text, such as the methods paragraph, as one file."""
    path_of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    out = path_of(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path_of(path), True)
    out.write(bytearray(text.encode()))
    out.close()


def save_comparison(compared: DataFrame, path: str) -> None:
    """Manual and automatic labels side by side, one CSV file."""
    write_single(compared.orderBy("unit_id"), path)


def load_manual_labels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema("unit_id long, manual_classification int").csv(path)


def save_manual_labels(labels: DataFrame, path: str) -> None:
    labels.select("unit_id", "manual_classification").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def missing_metrics(metrics: DataFrame, expected: list[str]) -> list[str]:
    """Expected columns that the table lacks."""
    return sorted(set(expected) - set(metrics.columns))


#: Legacy names of metrics.
LEGACY = {"nSpikes": "n_spikes", "nPeaks": "n_peaks", "nTroughs": "n_troughs", "presenceRatio": "presence_ratio", "waveformDuration_peakTrough": "duration_us", "spatialDecaySlope": "spatial_decay", "waveformBaselineFlatness": "baseline_flatness", "rawAmplitude": "raw_amplitude", "signalToNoiseRatio": "snr", "fractionRPVs_estimatedTauR": "contamination", "percentageSpikesMissing_gaussian": "percent_missing", "Lratio": "l_ratio", "isolationDistance": "isolation_distance", "maxDriftEstimate": "max_drift"}


def modern_names(metrics: DataFrame, defaults: dict | None = None) -> DataFrame:
    """Legacy names replaced, and missing columns added with their defaults."""
    out = metrics.withColumnsRenamed({k: v for k, v in LEGACY.items() if k in metrics.columns})
    return out.withColumns({k: F.lit(v) for k, v in (defaults or {}).items() if k not in out.columns})
