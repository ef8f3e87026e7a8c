"""Correlograms by a time-bucketed band join, their normalisations and shape features."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Spikes of a block of units, of which a task of a cross-correlogram holds two; a unit of more than HOT_SPIKES goes another way.
BLOCK_SPIKES, HOT_SPIKES = 200_000, 300_000


def band_pairs(spikes: DataFrame, width: int, *keys: str, across: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of spikes (a before b by time, then index) at most width ticks apart, of one unit or across units.

    Each spike is looked up in its own time bucket and the one before, so the join's key holds
    the time as well as the unit: a very active unit is spread over as many keys as its span
    has buckets, and no key holds more than one width of it. Columns to carry come out with
    _a and _b after their names.
    """
    width = max(int(width), 1)
    by = [*keys] if across else ["unit_id", *keys]
    base = spikes.select(*dict.fromkeys(["unit_id", *keys, *carry]), "spike_idx", "t", F.expr(f"t div {width}").alias("bucket"))
    a = base.select(*[F.col(k).alias(f"a_{k}") for k in by], F.col("unit_id").alias("unit_a"), F.col("spike_idx").alias("idx_a"), F.col("t").alias("t_a"), *[F.col(c).alias(f"{c}_a") for c in carry], F.explode(F.array(F.col("bucket"), F.col("bucket") + 1)).alias("bucket_a"))
    b = base.select(*[F.col(k).alias(f"b_{k}") for k in by], F.col("unit_id").alias("unit_b"), F.col("spike_idx").alias("idx_b"), F.col("t").alias("t_b"), *[F.col(c).alias(f"{c}_b") for c in carry], "bucket")
    on = F.col("bucket_a") == F.col("bucket")
    for k in by:
        on &= F.col(f"a_{k}") == F.col(f"b_{k}")
    later = (F.col("t_b") > F.col("t_a")) | ((F.col("t_b") == F.col("t_a")) & (F.col("idx_b") > F.col("idx_a")))
    x = a.join(b, on & later & (F.col("t_b") - F.col("t_a") <= width))
    return x.select(*[F.col(f"a_{k}").alias(k) for k in by if k != "unit_id"], F.col("unit_a").alias("unit_id"), "unit_a", "unit_b", "idx_a", "idx_b", "t_a", "t_b", (F.col("t_b") - F.col("t_a")).alias("delta"), *[f"{c}_{k}" for c in carry for k in "ab"])


def half_bins(window: int, bin_ticks: int) -> int:
    return int(0.5 * window / bin_ticks)


def autocorrelogram(spikes: DataFrame, bin_ticks: int, window: int) -> DataFrame:
    """Sparse (unit_id, lag_bin, n), symmetric; the bin of lag 0 is always 0 and left out."""
    half = half_bins(window, bin_ticks)
    pairs = band_pairs(spikes, (half + 1) * bin_ticks - 1)
    right = pairs.groupBy("unit_id", F.expr(f"cast(delta div {bin_ticks} as int)").alias("lag_bin")).agg(F.count("*").alias("n")).filter(f"lag_bin between 1 and {half}")
    return right.unionByName(right.withColumn("lag_bin", -F.col("lag_bin")))


def crosscorrelogram(spikes: DataFrame, bin_ticks: int, window: int, block_spikes: int = BLOCK_SPIKES, hot_spikes: int = HOT_SPIKES) -> DataFrame:
    """Sparse (unit_i, unit_j, lag_bin, n) of all pairs of units and both directions; at lag 0 the larger count, 0 within a unit."""
    half = half_bins(window, bin_ticks)
    reach = (half + 1) * bin_ticks - 1
    # spikes of unit_j before the one of unit_i have places from half down, those after it from half + 1 on
    sides = [(-reach, 0, 1, half * bin_ticks + bin_ticks - 1, bin_ticks), (0, reach, 1, (half + 1) * bin_ticks, bin_ticks)]

    def by_pairs(pairs):
        one = pairs.groupBy(F.col("unit_a").alias("unit_i"), F.col("unit_b").alias("unit_j"), F.expr(f"cast(delta div {bin_ticks} as int)").alias("lag_bin")).agg(F.count("*").alias("n")).filter(f"lag_bin <= {half}")
        other = one.select(F.col("unit_j").alias("unit_i"), F.col("unit_i").alias("unit_j"), (-F.col("lag_bin")).alias("lag_bin"), "n")
        return one.unionByName(other).groupBy("unit_i", "unit_j", "lag_bin").agg(F.max("n").alias("n"))

    out = _crossed(spikes, reach, half, sides, by_pairs, lambda x: x.drop("n_i"), block_spikes, hot_spikes)
    return out.filter("not (unit_i = unit_j and lag_bin = 0)")


def rounded_crosscorrelogram(spikes: DataFrame, bin_ticks: int, half: int, rate: bool = False, tick: float = 1.0, block_spikes: int = BLOCK_SPIKES, hot_spikes: int = HOT_SPIKES, rounded=lambda rate: rate) -> DataFrame:
    """The variant with bins centred on their lag: floor(0.5 + d/bin); rate divides by spikes of unit_i and seconds a bin, and leaves a null unit_i out.

    rounded(rate) stands for the rate and is taken once a run of equal rows, not once a row.
    """
    reach = half * bin_ticks + bin_ticks // 2
    wide = bin_ticks * (2 * half + 1)
    sides = [(-(wide // 2), (wide - 1) // 2, 2, wide, 2 * bin_ticks)]

    def by_pairs(pairs):
        pairs = pairs.filter("idx_a != idx_b")
        lag = lambda d: F.floor(F.lit(0.5) + d / bin_ticks).cast("int")
        both = pairs.select(F.col("unit_a").alias("unit_i"), F.col("unit_b").alias("unit_j"), lag(F.col("delta")).alias("lag_bin")).unionByName(
            pairs.select(F.col("unit_b").alias("unit_i"), F.col("unit_a").alias("unit_j"), lag(-F.col("delta")).alias("lag_bin")))
        return both.filter(F.abs("lag_bin") <= half).groupBy("unit_i", "unit_j", "lag_bin").agg(F.count("*").alias("n"))

    def rates(x):
        if not rate:
            return x.drop("n_i")
        return x.filter("unit_i is not null").withColumn("rate", rounded(F.col("n") / (F.col("n_i") * bin_ticks * tick))).drop("n_i")

    out = _crossed(spikes, reach, half, sides, by_pairs, rates, block_spikes, hot_spikes)
    return out.select("unit_i", "unit_j", "lag_bin", "n", *["rate"] * rate)


def _crossed(spikes: DataFrame, reach: int, half: int, sides: list[tuple], by_pairs, of_run, block_spikes: int, hot_spikes: int) -> DataFrame:
    """(unit_i, unit_j, lag_bin, n, n_i), by of_run, of all ordered pairs of units with spikes within reach; n_i counts the spikes of unit_i.

    Units are dealt to blocks by hash. A block is packed into one row, and the rows meet in a
    Cartesian product whose tasks read two blocks each from the same shuffle: every count of
    a pair of units is finished there, a few units at a time, and goes straight to the output.
    What lies on disk are the spikes, twice (dealt, and packed) whatever the number of blocks, never
    pairs or their counts. Rows of equal n, unit_i and lag leave Python as one, with a list of unit_j.
    Units over hot_spikes would burden one task; their pairs, with all
    units, go by `band_pairs`. Sizes come to the driver: the spikes and whether a unit is hot.

    sides: (low, high, scale, shift, width): differences d from low to high have the place (scale d + shift) // width. Of two
    sides one ends and one begins at 0, where the order of indices tells them apart, and their two places of lag 0
    leave the larger count. of_run(rows): columns that need no unit_j, once a run.
    """
    sizes = spikes.groupBy("unit_id").agg(F.count("*").alias("n_i"))
    total = sizes.agg(F.sum("n_i").alias("n"), F.max("n_i").alias("most")).first()
    x = spikes.select("unit_id", "spike_idx", "t")
    cold, hot = x, None
    if (total["most"] or 0) > hot_spikes:
        large = sizes.filter(F.col("n_i") > hot_spikes)  # at most the spikes over hot_spikes
        flagged = x.join(F.broadcast(large.select(F.col("unit_id").alias("u"), F.lit(True).alias("hot"))), F.col("unit_id").eqNullSafe(F.col("u")), "left").drop("u").withColumn("hot", F.coalesce("hot", F.lit(False)))
        cold = flagged.filter("not hot").drop("hot")
        pairs = band_pairs(flagged, reach, across=True, carry=("hot",)).filter("hot_a or hot_b")
        hot = by_pairs(pairs).join(sizes.withColumnRenamed("unit_id", "u"), F.col("unit_i").eqNullSafe(F.col("u"))).select("unit_i", "unit_j", "lag_bin", "n", "n_i")
    blocks = max(-(-(total["n"] or 0) // block_spikes), math.isqrt(3 * spikes.sparkSession.sparkContext.defaultParallelism) + 1)
    kind = dict(spikes.dtypes)["unit_id"]
    dealt = cold.select(F.pmod(F.xxhash64("unit_id"), F.lit(blocks)).cast("int").alias("block"), "unit_id", F.col("spike_idx").cast("long"), F.col("t").cast("long")).repartitionById(blocks, "block")
    packed = dealt.mapInArrow(_pack(), f"block int, units array<{kind}>, n array<long>, code array<int>, idx array<long>, t array<long>").repartitionById(blocks, "block").drop("block")
    both = packed.select(F.struct("*").alias("i")).crossJoin(packed.select(F.struct("*").alias("j")).hint("shuffle_replicate_nl"))
    runs = of_run(both.mapInArrow(_block_counts(half, sides), f"unit_i {kind}, others array<struct<unit_j: {kind}>>, lag_bin int, n long, n_i long"))
    found = runs.select("unit_i", F.inline("others"), *[c for c in runs.columns if c not in ("unit_i", "others")])
    return found if hot is None else found.unionByName(of_run(hot))


def _pack():
    """Of rows (block, unit_id, spike_idx, t) one row a block: its units, their numbers of spikes, and its whole spikes by time and index, their units as places in units."""

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        x = pa.Table.from_batches(held).combine_chunks()
        blocks = x.column(0).to_numpy()
        for block in np.unique(blocks):
            own = x.filter(pa.array(blocks == block)).combine_chunks()
            names = own.column(1).combine_chunks().dictionary_encode(null_encoding="encode")
            codes = names.indices.to_numpy()
            whole = np.flatnonzero(pa.compute.and_(pa.compute.is_valid(own.column(2)), pa.compute.is_valid(own.column(3))).to_numpy())
            idx, t = (own.column(k).take(pa.array(whole)).to_numpy() for k in (2, 3))
            order = np.lexsort((idx, t))
            columns = names.dictionary, pa.array(np.bincount(codes, minlength=len(names.dictionary)).astype(np.int64)), pa.array(codes[whole][order].astype(np.int32)), pa.array(idx[order]), pa.array(t[order])
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), *[pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns]], ["block", "units", "n", "code", "idx", "t"])

    return run


#: Pairs of spikes counted at once, and rows of a batch handed to Spark.
_PAIRS_AT_ONCE, _ROWS_OUT = 1 << 17, 1 << 17


def _block_counts(half: int, sides: list[tuple], at_once: int = _PAIRS_AT_ONCE):
    """Of pairs (i, j) of packed blocks: (unit_i, unit_j as a list, lag_bin, n, n_i) of the units of i against those of j.

    Runs come by count (from 255 on as one), unit_i, lag and unit_j within those counted at once, which files hold in few bytes.
    A key holds the unit of i among those counted at once, the place and the unit of j.
    """
    split = len(sides) > 1
    places = 2 * half + 1 + split
    most_units = max((1 << 60) // (places * max(s[4] for s in sides)), 1)

    def counted(keys, size):
        """Sorted distinct keys under size and how often each comes."""
        if size <= 2 * len(keys):
            n = np.bincount(keys, minlength=size)
            found = np.flatnonzero(n)
            return found.astype(keys.dtype), n[found]
        keys.sort()
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return keys[first], np.diff(np.append(first, len(keys)))

    def merged(parts, reduce=np.add):
        keys, n = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return keys[first], reduce.reduceat(n, first)

    def equals(xi, xt, yi, yt):
        """Where the spikes of y at a spike of x with its index begin and end among y."""
        order = np.lexsort((np.concatenate([yi, xi]), np.concatenate([yt, xt])))
        t, i = np.concatenate([yt, xt])[order], np.concatenate([yi, xi])[order]
        first = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (i[1:] != i[:-1])]))
        before = np.concatenate([[0], np.cumsum(order < len(yt))])
        size = np.diff(first, append=len(order))
        out = np.empty((2, len(order)), np.int64)
        out[0, order], out[1, order] = np.repeat(before[first], size), np.repeat(before[first + size], size)
        return out[:, len(yt):]

    def ranges(xi, xt, yi, yt):
        """For each side: the first and the last place among y of those that a spike of x meets."""
        at = [(np.searchsorted(yt, xt + s[0], "left"), np.searchsorted(yt, xt + s[1], "right")) for s in sides]
        if split:
            begin, end = equals(xi, xt, yi, yt)
            at = [(at[0][0], begin), (end, at[1][1])]
        return at

    def meet(x, y, own):
        """Keys, counts, first unit and bits of a key's unit of y, own in number, of whole units of x at a time."""
        (xu, xi, xt), (yu, yi, yt) = x, y
        if not len(xu) or not len(yu):
            return
        order = np.argsort(xu, kind="stable")
        xu, xi, xt = xu[order], xi[order], xt[order]
        bits = (own - 1).bit_length()
        at = ranges(xi, xt, yi, yt)
        idx = np.sort(np.concatenate([xi, yi]))
        check = not split and bool((idx[1:] == idx[:-1]).any())  # else no index comes twice
        base = min(int(xt[0]), int(yt[0]))
        total = np.concatenate([[0], np.cumsum(sum(hi - lo for lo, hi in at))])
        ends = np.append(np.flatnonzero(xu[1:] != xu[:-1]) + 1, len(xu))
        scaled = [s[2] * (yt - base) for s in sides]
        places_of_y = yu.astype(np.int32)
        steps = np.arange(max(at_once, int(np.diff(total).max())) + 1)

        def keys_of(s, e, first, size):
            parts = []
            for (lo, hi), of_y, (_, _, scale, shift, width) in zip(at, scaled, sides, strict=True):
                n = hi[s:e] - lo[s:e]
                sums = np.cumsum(n)
                b = np.repeat(lo[s:e] - (sums - n), n)
                b += steps[: len(b)]
                key = np.repeat((xu[s:e] - first) * (places * width) + (shift - scale * (xt[s:e] - base)), n)
                key += of_y[b]
                key //= width
                if size < 1 << 31:
                    key = key.astype(np.int32)
                key <<= bits
                key |= places_of_y[b]
                parts.append(key[yi[b] != np.repeat(xi[s:e], n)] if check else key)
            return parts[0] if len(parts) == 1 else np.concatenate(parts)

        s = 0
        while s < len(xu):
            # as many whole units as at_once pairs allow; a larger one by itself, in parts
            k = max(np.searchsorted(total[ends], total[s] + at_once, "right") - 1, np.searchsorted(ends, s, "right"))
            k = min(k, np.searchsorted(ends, s, "right") + most_units - 1)
            e, first = int(ends[k]), int(xu[s])
            size = (int(xu[e - 1]) - first + 1) * places << bits
            parts, held = [], 0
            while s < e:
                m = min(max(int(np.searchsorted(total, total[s] + at_once, "right")) - 1, s + 1), e)
                keys = keys_of(s, m, first, size)
                if len(keys):
                    parts.append(counted(keys, size))
                    held += len(parts[-1][0])
                    if len(parts) > 1 and held > 8 * at_once:
                        parts = [merged(parts)]
                        held = 0
                s = m
            if parts:
                yield *(parts[0] if len(parts) == 1 else merged(parts)), first, bits

    def by_runs(keys, n, bits):
        """Keys by count, unit of i and lag."""
        if split:
            # of a pair's two places of lag 0 one goes, the larger count stays
            at = keys >> bits
            at -= at // places * places
            two = at == half + 1
            zero = two | (at == half)
            one = merged([(keys[zero] - (two[zero].astype(keys.dtype) << bits), n[zero])], np.maximum) if zero.any() else (keys[:0], n[:0])
            keys, n = np.concatenate([keys[~zero], one[0]]), np.concatenate([n[~zero], one[1]])
        single = n == 1
        more, m = keys[~single], n[~single]
        order = np.argsort(np.minimum(m, 255).astype(np.uint8), kind="stable")
        single = keys[single]
        return np.concatenate([single, more[order]]), np.concatenate([np.ones(len(single), np.int64), m[order]])

    def block(column, r):
        units, size, code, idx, t = (column.field(k)[r].values for k in range(5))
        return units, size.to_numpy(), (code.to_numpy().astype(np.int64), idx.to_numpy(), t.to_numpy())

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                (units, size, x), (others, _, y) = (block(batch.column(k), r) for k in (0, 1))
                for keys, n, first, bits in meet(x, y, max(len(others), 1)):
                    keys, n = by_runs(keys, n, bits)
                    at = keys >> bits
                    starts = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (n[1:] != n[:-1])]))
                    unit, place = np.divmod(at[starts].astype(np.int64), places)
                    unit += first
                    n, lag = n[starts], (place - half - (split & (place > half))).astype(np.int32)
                    ends = np.append(starts, len(keys))
                    s = 0
                    while s < len(starts):
                        e = max(int(np.searchsorted(ends, ends[s] + _ROWS_OUT, "right")) - 1, s + 1)
                        found = others.take(pa.array(keys[ends[s] : ends[e]] & ((1 << bits) - 1)))
                        lists = pa.ListArray.from_arrays(pa.array((ends[s : e + 1] - ends[s]).astype(np.int32)), pa.StructArray.from_arrays([found], ["unit_j"]))
                        yield pa.RecordBatch.from_arrays([units.take(pa.array(unit[s:e])), lists, pa.array(lag[s:e]), pa.array(n[s:e].astype(np.int64)), pa.array(size[unit[s:e]])], ["unit_i", "others", "lag_bin", "n", "n_i"])
                        s = e

    return run


def dense(acg: DataFrame, units: DataFrame, half: int) -> DataFrame:
    """acg with all lag bins -half..half of each unit."""
    grid = units.select("unit_id").select("*", F.explode(F.sequence(F.lit(-half), F.lit(half))).alias("lag_bin"))
    return grid.join(acg, ["unit_id", "lag_bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def normalised(acg: DataFrame, spikes: DataFrame, bin_ticks: int, half: int, tick: float) -> DataFrame:
    """Dense autocorrelogram as counts, hertz, pearson (n over N) and z-score against the outer four fifths of the lags."""
    units = spikes.groupBy("unit_id").agg(F.count("*").alias("n_spikes"), ((F.max("t") - F.min("t")) * tick).alias("duration"))
    x = dense(acg, units, half).join(units, "unit_id")
    outer = F.abs("lag_bin") > half * 0.2
    w = Window.partitionBy("unit_id")
    mean, sd = F.avg(F.when(outer, F.col("n"))).over(w), F.stddev_pop(F.when(outer, F.col("n"))).over(w)
    rate = F.col("n_spikes") / F.col("duration")
    expected = rate * rate * F.col("duration") * (bin_ticks * tick)
    return x.select(
        "unit_id", "lag_bin", "n", (F.col("n") / (F.col("n_spikes") * bin_ticks * tick)).alias("hertz"), F.try_divide(F.col("n") - expected, F.sqrt(expected)).alias("pearson"),
        F.when(sd > 0, (F.col("n") - mean) / sd).alias("zscore"))


def log_autocorrelogram(spikes: DataFrame, low: int, high: int, n_bins: int, tick: float) -> DataFrame:
    """(unit_id, lag_bin, n, rate) of lags in bins evenly spaced in the logarithm from low to high ticks (exclusive); rate is per spike and second of the bin."""
    a, b = math.log10(low), math.log10(high)
    edge = lambda i: F.pow(F.lit(10.0), F.lit(a) + (i * (b - a) / n_bins))
    at = F.least(F.floor((F.log10(F.col("delta")) - a) * n_bins / (b - a)), F.lit(n_bins - 1)).cast("int")
    counted = band_pairs(spikes, high - 1).filter(F.col("delta") >= low).groupBy("unit_id", at.alias("lag_bin")).agg(F.count("*").alias("n"))
    sizes = spikes.groupBy("unit_id").agg(F.count("*").alias("n_unit"))
    width = (edge(F.col("lag_bin") + 1) - edge(F.col("lag_bin"))) * tick
    return counted.join(sizes, "unit_id").select("unit_id", "lag_bin", "n", (F.col("n") / (F.col("n_unit") * width)).alias("rate"))


def features(dense_acg: DataFrame, half: int, bin_ms: float, supp: int, base: int, rec_lo: int, rec_hi: int, fit: int) -> DataFrame:
    """Suppression ratio and time, rise and decay of each unit's dense correlogram; all lags in bins.

    supp: bins after the centre that are searched for suppression; base: where the baseline
    begins; recovery is the first bin not below the mean over rec_lo..rec_hi; the rise is the
    first of the `fit` bins after the centre at half their maximum, the decay -1 over the slope
    of their second half's logarithm.
    """
    lag, n = F.col("lag_bin"), F.col("n")
    in_base = (lag >= base) | ((lag >= -base) & (lag < -supp))
    w = Window.partitionBy("unit_id")
    x = dense_acg.withColumns({
        "rec_mean": F.avg(F.when((lag >= rec_lo) & (lag < rec_hi), n)).over(w),
        "fit_max": F.max(F.when((lag >= 1) & (lag < fit), n)).over(w),
        "tail_max": F.max(F.when((lag >= 1 + (fit - 1) // 2) & (lag < fit), n)).over(w)})
    tail = (lag >= 1 + (fit - 1) // 2) & (lag < fit)
    y = F.when(tail & (F.col("tail_max") > 0), F.ln(F.greatest(n.cast("double"), F.col("tail_max") * 0.01)))
    g = x.groupBy("unit_id").agg(
        F.min(F.when((lag >= 1) & (lag <= supp), n)).alias("least"), F.avg(F.when(in_base, n)).alias("mean_base"),
        F.min(F.when((lag >= 0) & (lag < rec_hi + (rec_hi - rec_lo)) & (n >= F.col("rec_mean")), lag)).alias("recovery"),
        F.min(F.when((lag >= 1) & (lag < fit) & (F.col("fit_max") > 0) & (n >= F.col("fit_max") * 0.5), lag)).alias("rise"),
        F.regr_slope(y, F.when(tail, lag.cast("double"))).alias("slope"))
    return g.select(
        "unit_id", F.when(F.col("mean_base") > 0, F.col("least") / F.col("mean_base")).otherwise(0.0).alias("suppression_ratio"),
        (F.col("recovery") * bin_ms).alias("suppression_ms"), ((F.col("rise") - 1) * bin_ms).alias("tau_rise_ms"),
        F.when(F.col("slope") < -1e-12, -1 / F.col("slope") * bin_ms).alias("tau_decay_ms"))


def refractory_ms(dense_acg: DataFrame, bin_ms: float) -> DataFrame:
    """First lag above the least count plus the (sample) deviation of the right half.

    Compared in whole numbers: (n - least)^2 m (m - 1) against m sum(n^2) - sum(n)^2 of m lags, so
    that a count just at the limit is never above it, whatever the order of summation.
    """
    right = dense_acg.filter("lag_bin >= 0")
    w = Window.partitionBy("unit_id")
    n, m = F.col("n").cast("decimal(19,0)"), F.count("*").over(w).cast("decimal(10,0)")
    whole = lambda c: c.cast("decimal(38,0)")
    spread_ = whole(m * whole(F.sum(n * n).over(w))) - whole(whole(F.sum(n).over(w)) * F.sum(n).over(w).cast("decimal(19,0)"))
    over = whole(n - whole(F.min(n).over(w)))
    x = right.withColumn("above", (F.col("n") > F.min("n").over(w)) & (m > 1) & (whole(whole(over * over) * (m * (m - 1)).cast("decimal(19,0)")) > spread_))
    return x.groupBy("unit_id").agg((F.min(F.when(F.col("above"), F.col("lag_bin"))) * bin_ms).alias("refractory_ms"))


def outer_rate(dense_acg: DataFrame, half: int) -> DataFrame:
    """Mean count of the outer fifth of lags on each side."""
    return dense_acg.filter(F.abs("lag_bin") > half - (2 * half + 1) // 5).groupBy("unit_id").agg(F.avg("n").alias("mean_outer"))
