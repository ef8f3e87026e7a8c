"""Live trains with Structured Streaming: presence by event-time windows, bursts by sessions, intervals with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def presence_counts(stream: DataFrame, bin_length: str, late: str) -> DataFrame:
    """(unit_id, start, n) of tumbling windows over `ts`; rows later than the watermark are dropped."""
    x = stream.withWatermark("ts", late).groupBy("unit_id", F.window("ts", bin_length)).agg(F.count("*").alias("n"))
    return x.select("unit_id", F.col("window.start").alias("start"), "n")


def bursts(stream: DataFrame, gap: str, late: str) -> DataFrame:
    """(unit_id, start, end, n) of runs of spikes with smaller gaps."""
    x = stream.withWatermark("ts", late).groupBy("unit_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return x.select("unit_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def running_violations(stream: DataFrame, tau: int, late: int = 0) -> DataFrame:
    """(unit_id, n_spikes, n_violations, n_dropped) after each batch.

    Spikes may come up to `late` ticks after a later one and are then sorted in; older ones
    are dropped and counted. A unit's state is its spikes of the last `late` ticks, the last
    one before them, and three counts.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, last, n, bad, dropped = state.get if state.exists else ([], None, 0, 0, 0)
        new = [int(t) for f in frames for t in f["t"]]
        # what was final before this batch stays so
        floor = None if last is None and not held else max([*held, *([] if last is None else [last])]) - late
        kept = [t for t in new if floor is None or t >= floor]
        dropped += len(new) - len(kept)
        n += len(kept)
        times = sorted([*held, *kept])
        edge = times[-1] - late if times else None
        while times and times[0] < edge:
            t = times.pop(0)
            bad += last is not None and t - last <= tau
            last = t
        chain = times if last is None else [last, *times]
        open_bad = sum(b - a <= tau for a, b in zip(chain, chain[1:], strict=False))
        state.update((times, last, n, int(bad), dropped))
        yield pd.DataFrame({"unit_id": [key[0]], "n_spikes": [n], "n_violations": [int(bad) + open_bad], "n_dropped": [dropped]})

    return stream.select("unit_id", "t").groupBy("unit_id").applyInPandasWithState(
        step, "unit_id long, n_spikes long, n_violations long, n_dropped long", "held array<long>, last long, n long, bad long, dropped long", "update", GroupStateTimeout.NoTimeout)
