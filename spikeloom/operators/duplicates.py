"""Duplicate spikes: pairs within a window on one peak channel, and their removal by set or greedy rules."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .correlogram import band_pairs


def duplicate_pairs(spikes: DataFrame, window: int) -> DataFrame:
    """Pairs (idx_a earlier) of spikes on one `channel` at most window ticks apart, with the loser of each.

    Within a unit the lower amplitude loses, across units the spike of the unit with fewer
    spikes; in a tie the later one.
    """
    sized = spikes.join(spikes.groupBy("unit_id").agg(F.count("*").alias("n")), "unit_id")
    x = band_pairs(sized, window, "channel", across=True, carry=("amplitude", "n"))
    same = F.col("unit_a") == F.col("unit_b")
    a_loses = F.when(same, F.col("amplitude_a") < F.col("amplitude_b")).otherwise(F.col("n_a") < F.col("n_b"))
    return x.select("channel", "idx_a", "idx_b", "unit_a", "unit_b", "delta", F.when(a_loses, F.col("idx_a")).otherwise(F.col("idx_b")).alias("loser"))


def without_duplicates(spikes: DataFrame, window: int) -> DataFrame:
    """Spikes that lose no pair. In a chain of more than two, a loser's own pairs still count."""
    return spikes.join(duplicate_pairs(spikes, window).select(F.col("loser").alias("spike_idx")).distinct(), "spike_idx", "left_anti")


def greedy_losers(spikes: DataFrame, window: int) -> DataFrame:
    """(spike_idx) removed by the one-pass rule: in time order, a surviving spike is held against its later survivors.

    Runs of spikes on a channel with gaps of at most the window are independent, so each is
    judged in order by itself; runs of one spike never leave the JVM.
    """
    w = Window.partitionBy("channel").orderBy("t", "spike_idx")
    size = spikes.groupBy("unit_id").agg(F.count("*").alias("n_unit"))
    x = spikes.select("channel", "unit_id", "spike_idx", "t", "amplitude").withColumn("new", F.coalesce((F.col("t") - F.lag("t").over(w) > window).cast("int"), F.lit(1)))
    x = x.withColumn("run", F.sum("new").over(w))
    x = x.withColumn("n_run", F.count("*").over(Window.partitionBy("channel", "run"))).filter("n_run > 1").join(size, "unit_id")

    def judge(table: pa.Table) -> pa.Table:
        table = table.sort_by([("t", "ascending"), ("spike_idx", "ascending")])
        t, idx, unit, size, amplitude = (table.column(c).to_numpy().tolist() for c in ("t", "spike_idx", "unit_id", "n_unit", "amplitude"))
        n, gone = len(t), [False] * len(t)
        for i in range(n):
            if gone[i]:
                continue
            for j in range(i + 1, n):
                if t[j] - t[i] > window:
                    break
                if gone[j]:
                    continue
                if amplitude[i] < amplitude[j] if unit[i] == unit[j] else size[i] < size[j]:
                    gone[i] = True
                    break
                gone[j] = True
        return pa.table({"spike_idx": pa.array([x for x, g in zip(idx, gone, strict=True) if g], pa.int64())})

    return x.groupBy("channel", "run").applyInArrow(judge, "spike_idx long")
