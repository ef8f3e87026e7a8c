"""All registered queries of the spike-train operators, over whole tables, and their DuckDB twins.

Doubles are rounded to six places on both sides. Constants are rescaled to the sparse
`events` trains: microsecond ticks, day bins, refractory sweeps of minutes.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fits import GAUSSIAN_STEPS, GAUSSIAN_TOLERANCE
from ..operators import amplitude, correlogram, curation, duplicates, features, labels, refractory, summary, trains, waveform
from ..params import PhysiologyParams, QualityParams, Ticks
from . import pipeline
from . import relations as rel

S = 1_000_000
DAY = 86_400 * S
TAUS = [600 * S, 1800 * S, 3600 * S]
TAU_C = 10 * S
CHUNK = 5 * DAY
ACG_BIN, ACG_WINDOW = 3600 * S, 172_800 * S
ACG_HALF = correlogram.half_bins(ACG_WINDOW, ACG_BIN)
CCG_BIN, CCG_WINDOW = 60 * S, 1200 * S
FS = 30000.0
DEDUP = 400 * S
PHYSIOLOGY = PhysiologyParams(min_spikes=60, template_duration_threshold=800.0)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql.strip()
        return f

    return add


def r6(df: DataFrame) -> DataFrame:
    """Doubles rounded; -0 becomes 0."""
    return df.select(*[(F.round(F.col(c), 6) + F.lit(0.0)).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes])


def quick_r6(c: Column) -> Column:
    """round(c, 6) without a decimal for each row: numbers near a tie, large ones and NaN alone go by Spark's round."""
    m = c * 1e6
    return F.when((F.abs(m) < 1e9) & (F.abs(m - F.floor(m) - 0.5) > 1e-3), F.floor(m + 0.5) / 1e6).otherwise(F.round(c, 6) + F.lit(0.0))


def r3(df: DataFrame) -> DataFrame:
    """Doubles that end an iteration or a matrix inverse, rounded to three places."""
    return df.select(*[(F.round(F.col(c), 3) + F.lit(0.0)).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes])


SP = "spikes as (select user_id as unit_id, event_id as spike_idx, epoch_us(ts) as t, value as amplitude, event_type from events)"
LINE = "dense as (select l_suppkey as unit_id, l_orderkey * 10 + l_linenumber as spike_idx, cast(date_diff('day', date '1970-01-01', cast(l_shipdate as date)) as bigint) as t, l_extendedprice as amplitude, l_suppkey // 4 as channel from lineitem)"
ISI = "isi as (select *, t - lag(t) over (partition by unit_id order by t, spike_idx) as isi from spikes)"
TAU = "taus(tau_idx, tau_r) as (values " + ", ".join(f"({i}, {t})" for i, t in enumerate(TAUS)) + ")"


def hill_sql(n: str, spikes: str, dur: str, win: str) -> str:
    k = f"(2 * {win} * {spikes} * {spikes})"
    disc = f"(1 - 4.0e0 * {n} * {dur} / nullif({k}, 0))"
    return f"least(1.0e0, case when {n} = 0 then 0.0e0 when {disc} >= 0 then (1 - sqrt(greatest({disc}, 0.0e0))) / 2 when {n} < {spikes} then {n} / (2 * {win} * ({spikes} - {n})) else 1.0e0 end)"


@query(f"with {SP} select unit_id, count(*) as n_spikes, min(t) as t_first, max(t) as t_last from spikes group by unit_id")
def unit_spike_counts(spark, d):
    return r6(trains.spike_counts(rel.spikes(spark, d)))


@query(f"""
with {SP}, {ISI}, x as (select unit_id, t, spike_idx, cast(isi as double) as isi, cast(lag(isi) over (partition by unit_id order by t, spike_idx) as double) as before from isi),
y as (select * from x where isi is not null),
m as (select unit_id, avg(isi) as mu from y group by unit_id)
select unit_id, count(*) as n_isi, round(avg(case when isi > {DAY} then 1.0e0 else 0.0e0 end), 6) as prop_long, round(stddev_pop(isi) / nullif(avg(isi), 0), 6) as cv,
  round(case when var_pop(isi) > 0 then avg((isi - mu) ** 3) / (var_pop(isi) ** 1.5) end, 6) as skew,
  round(avg(case when isi + before > 0 then 2 * abs(isi - before) / (isi + before) end), 6) as cv2
from y join m using (unit_id) group by unit_id""")
def isi_stats(spark, d):
    return r6(trains.interval_properties(rel.spikes(spark, d), DAY))


HILL = f"""{SP}, {ISI}, {TAU},
u as (select unit_id, count(*) as n, (max(t) - min(t)) * 1e-6 as dur from spikes group by unit_id),
v as (select unit_id, tau_idx, tau_r, count(*) filter (where isi <= tau_r) as k from isi, taus group by all),
hill as (select unit_id, n as n_spikes, dur as duration, tau_idx, tau_r, k as n_violations, {hill_sql('k', 'n', 'dur', f'((tau_r - {TAU_C}) * 1e-6)')} as contamination from u join v using (unit_id))"""


@query(f"with {HILL} select unit_id, n_spikes, round(duration, 6) as duration, cast(tau_idx as bigint) as tau_idx, cast(tau_r as bigint) as tau_r, n_violations, round(contamination, 6) as contamination from hill")
def rpv_hill(spark, d):
    return r6(refractory.hill_sweep(rel.spikes(spark, d), TAUS, TAU_C, rel.TICK))


@query(f"""
with {SP}, {TAU}, u as (select unit_id, count(*) as n, (max(t) - min(t)) * 1e-6 as dur from spikes group by unit_id),
p as (select a.unit_id, b.t - a.t as delta from spikes a join spikes b on a.unit_id = b.unit_id and b.t - a.t between {TAU_C} and {max(TAUS)} and (b.t > a.t or b.spike_idx > a.spike_idx)),
k as (select unit_id, tau_idx, tau_r, count(delta) filter (where delta <= tau_r) as k from u cross join taus left join p using (unit_id) group by all),
x as (select *, 1 - k * (dur - 2 * n * {TAU_C} * 1e-6) / (n * n * (tau_r - {TAU_C}) * 1e-6) as inner_ from u join k using (unit_id))
select unit_id, n as n_spikes, round(dur, 6) as duration, cast(tau_idx as bigint) as tau_idx, cast(tau_r as bigint) as tau_r, k as n_pairs, round(case when inner_ >= 0 then 1 - sqrt(inner_) else 1.0e0 end, 6) as contamination from x""")
def rpv_llobet(spark, d):
    return r6(refractory.llobet_sweep(rel.spikes(spark, d), TAUS, TAU_C, rel.TICK))


IBL_TAUS = [100 * S, *TAUS]


@query(f"""
with {SP}, {ISI}, taus(tau_idx, tau_r) as (values {', '.join(f'({i}, {t})' for i, t in enumerate(IBL_TAUS))}),
u as (select unit_id, count(*) as n, (max(t) - min(t)) * 1e-6 as dur from spikes group by unit_id),
v as (select unit_id, tau_idx, tau_r, count(*) filter (where isi >= {TAU_C} and isi < tau_r) as k from isi, taus group by all),
g as (select *, c * 0.005e0 as level, dur - 2 * n * {TAU_C} * 1e-6 as eff from u join v using (unit_id), unnest(range(1, 70)) as t(c)),
h as (select *, n / eff * level * (tau_r - {TAU_C}) * 1e-6 * 2 * n as mean from g where n > 1 and eff > 0),
q as (select *, list_sum(list_transform(range(0, cast(k as bigint) + 1), lambda i: exp(-mean + i * ln(mean) - lgamma(i + 1)))) as cdf from h),
b as (select unit_id, min(struct_pack(level := level, tau_idx := tau_idx, tau_r := tau_r)) as b from q where 1 - cdf > 0.9 group by unit_id)
select unit_id, n as n_spikes, round(b.level, 6) as contamination, cast(b.tau_r as bigint) as tau_r from u left join b using (unit_id)""")
def rpv_ibl_sliding(spark, d):
    return r6(refractory.sliding_confidence(rel.spikes(spark, d), IBL_TAUS, TAU_C, rel.TICK))


CHUNKED = f"""{SP}, {TAU}, bnd as (select min(t) as t0, max(t) as t1 from spikes),
ch as (select spikes.*, cast((t - t0) // {CHUNK} as bigint) as chunk from spikes, bnd where (t - t0) // {CHUNK} < ceil((t1 - t0) / {CHUNK}.0e0) - 1),
ci as (select *, t - lag(t) over (partition by unit_id, chunk order by t, spike_idx) as isi from ch),
cu as (select unit_id, chunk, count(*) as n, (max(t) - min(t)) * 1e-6 as dur from ch group by all),
cv as (select unit_id, chunk, tau_idx, tau_r, count(*) filter (where isi <= tau_r) as k from ci, taus group by all),
chill as (select unit_id, chunk, n as n_spikes, dur as duration, tau_idx, tau_r, k as n_violations, {hill_sql('k', 'n', 'dur', f'((tau_r - {TAU_C}) * 1e-6)')} as contamination from cu join cv using (unit_id, chunk))"""


def chunk_sweep(spark, d):
    return refractory.hill_sweep(trains.in_chunks(rel.spikes(spark, d), CHUNK), TAUS, TAU_C, rel.TICK, "chunk")


@query(f"""with {CHUNKED}, p as (select a.unit_id, a.chunk, b.t - a.t as delta from ch a join ch b on a.unit_id = b.unit_id and a.chunk = b.chunk and b.t - a.t between {TAU_C} and {max(TAUS)} and (b.t > a.t or b.spike_idx > a.spike_idx)),
k as (select unit_id, chunk, tau_idx, tau_r, count(delta) filter (where delta <= tau_r) as k from cu cross join taus left join p using (unit_id, chunk) group by all),
x as (select *, 1 - k * (dur - 2 * n * {TAU_C} * 1e-6) / nullif(n * n * (tau_r - {TAU_C}) * 1e-6, 0) as inner_ from cu join k using (unit_id, chunk))
select unit_id, chunk, n as n_spikes, round(dur, 6) as duration, cast(tau_idx as bigint) as tau_idx, cast(tau_r as bigint) as tau_r, k as n_pairs, round(case when inner_ >= 0 then 1 - sqrt(inner_) else 1.0e0 end, 6) as contamination from x""")
def rpv_llobet_per_chunk(spark, d):
    return r6(refractory.llobet_sweep(trains.in_chunks(rel.spikes(spark, d), CHUNK), TAUS, TAU_C, rel.TICK, "chunk"))


@query(f"""with {CHUNKED.replace(TAU, "taus(tau_idx, tau_r) as (values " + ", ".join(f"({i}, {t})" for i, t in enumerate(IBL_TAUS)) + ")")},
v as (select unit_id, chunk, tau_idx, tau_r, count(*) filter (where isi >= {TAU_C} and isi < tau_r) as k from ci, taus group by all),
g as (select *, c * 0.005e0 as level, dur - 2 * n * {TAU_C} * 1e-6 as eff from cu join v using (unit_id, chunk), unnest(range(1, 70)) as t(c)),
h as (select *, n / eff * level * (tau_r - {TAU_C}) * 1e-6 * 2 * n as mean from g where n > 1 and eff > 0),
q as (select *, list_sum(list_transform(range(0, cast(k as bigint) + 1), lambda i: exp(-mean + i * ln(mean) - lgamma(i + 1)))) as cdf from h),
b as (select unit_id, chunk, min(struct_pack(level := level, tau_idx := tau_idx, tau_r := tau_r)) as b from q where 1 - cdf > 0.9 group by all)
select unit_id, chunk, n as n_spikes, round(b.level, 6) as contamination, cast(b.tau_r as bigint) as tau_r from cu left join b using (unit_id, chunk)""")
def rpv_ibl_per_chunk(spark, d):
    return r6(refractory.sliding_confidence(trains.in_chunks(rel.spikes(spark, d), CHUNK), IBL_TAUS, TAU_C, rel.TICK, 0.9, "chunk"))


@query(f"with {CHUNKED} select unit_id, chunk, n_spikes, round(duration, 6) as duration, cast(tau_idx as bigint) as tau_idx, cast(tau_r as bigint) as tau_r, n_violations, round(contamination, 6) as contamination from chill")
def rpv_per_chunk(spark, d):
    return r6(chunk_sweep(spark, d))


@query(f"""with {CHUNKED}, m as (select unit_id, chunk, min(struct_pack(c := contamination, i := tau_idx, r := tau_r, v := n_violations)) as m from chill group by all)
select unit_id, round(avg(m.c), 6) as contamination, cast(arg_min(m.r, struct_pack(c := m.c, k := chunk, r := m.r)) as bigint) as tau_r, cast(sum(m.v) as bigint) as n_violations, count(*) as n_chunks from m group by unit_id""")
def rpv_unit_summary(spark, d):
    return r6(refractory.unit_summary(chunk_sweep(spark, d)))


@query(f"""with {CHUNKED}, s as (select unit_id, tau_idx, round(sum(contamination), 9) as total from chill group by all)
select unit_id, cast(max(tau_idx) filter (where total = least_) as bigint) as rpv_window_index from (select *, min(total) over (partition by unit_id) as least_ from s) group by unit_id""")
def rpv_window_index(spark, d):
    return r6(refractory.window_tau_index(chunk_sweep(spark, d)))


@query(f"with {CHUNKED} select unit_id, " + ", ".join(f"round(avg(contamination) filter (where tau_idx = {i}), 6) as tau_{t}" for i, t in enumerate(TAUS)) + " from chill group by unit_id")
def rpv_tau_table(spark, d):
    return r6(refractory.tau_table(chunk_sweep(spark, d), TAUS))


PRESENCE = f"""{SP}, bnd as (select min(t) as t0, cast(ceil((max(t) - min(t)) / {DAY}.0e0) - 1 as bigint) as nb from spikes),
grid as (select unit_id, bin from (select distinct unit_id from spikes), bnd, unnest(range(nb)) as g(bin)),
cnt as (select unit_id, (t - t0) // {DAY} as bin, count(*) as n from spikes, bnd group by all),
full_ as (select unit_id, bin, coalesce(n, 0) as n from grid left join cnt using (unit_id, bin)),
p90 as (select unit_id, quantile_cont(n, 0.9) as p90 from full_ group by unit_id),
presence as (select unit_id, avg(case when n > 0 and n >= 0.05 * p90 then 1.0e0 else 0.0e0 end) as presence_ratio, count(*) as n_bins from full_ join p90 using (unit_id) group by unit_id)"""


@query(f"with {PRESENCE} select unit_id, round(presence_ratio, 6) as presence_ratio, n_bins from presence")
def presence_ratio(spark, d):
    return r6(trains.presence_ratio(rel.spikes(spark, d), DAY))


@query(f"""with {SP}, bnd as (select min(t) as t0, max(t) as t1 from spikes),
ch as (select spikes.*, cast((t - t0) // {CHUNK} as bigint) as chunk from spikes, bnd where (t - t0) // {CHUNK} < ceil((t1 - t0) / {CHUNK}.0e0) - 1),
grid as (select unit_id, chunk, bin from (select distinct unit_id, chunk from ch), unnest(range(4)) as g(bin)),
cnt as (select unit_id, chunk, (t - t0 - chunk * {CHUNK}) // {DAY} as bin, count(*) as n from ch, bnd group by all),
f as (select unit_id, chunk, bin, coalesce(n, 0) as n from grid left join cnt using (unit_id, chunk, bin)),
p as (select unit_id, chunk, quantile_cont(n, 0.9) as p90 from f group by all)
select unit_id, chunk, round(avg(case when n > 0 and n >= 0.05 * p90 then 1.0e0 else 0.0e0 end), 6) as presence_ratio, count(*) as n_bins from f join p using (unit_id, chunk) group by all""")
def presence_per_chunk(spark, d):
    s = rel.spikes(spark, d)
    return r6(trains.presence_ratio(trains.in_chunks(s, CHUNK), DAY, "chunk", window=trains.chunk_edges(s, CHUNK)))


GOOD = 0.3
WINDOWS = f"""{CHUNKED}, cc as (select unit_id, chunk, min(contamination) as c from chill group by all),
cr as (select unit_id, min(chunk) as lo, max(chunk) as hi from cc group by unit_id),
ci2 as (select unit_id, chunk, chunk - row_number() over (partition by unit_id order by chunk) as island from cc where c <= {GOOD}),
ru as (select unit_id, island, min(chunk) as f, max(chunk) as l from ci2 group by all),
be as (select unit_id, f, l from ru qualify row_number() over (partition by unit_id order by l - f desc, f) = 1),
win as (select unit_id, coalesce(f, lo) as first_chunk, coalesce(l, hi) as last_chunk, f is not null as any_good from cr left join be using (unit_id))"""


def windows(spark, d):
    per = chunk_sweep(spark, d).groupBy("unit_id", "chunk").agg(F.min("contamination").alias("c"))
    return trains.good_runs(per, F.col("c") <= GOOD)


@query(f"with {WINDOWS} select * from win")
def good_window(spark, d):
    return r6(windows(spark, d))


@query(f"""with {WINDOWS} select s.unit_id, count(*) as n_spikes, min(t) as t_first, max(t) as t_last from spikes s join win using (unit_id), bnd
where t >= t0 + first_chunk * {CHUNK} and t <= t0 + (last_chunk + 1) * {CHUNK} group by s.unit_id""")
def spikes_in_good_window(spark, d):
    s = rel.spikes(spark, d)
    edges = trains.chunk_edges(s, CHUNK)
    w = windows(spark, d).join(edges.select(F.col("chunk").alias("first_chunk"), "start"), "first_chunk").join(edges.select(F.col("chunk").alias("last_chunk"), "end"), "last_chunk")
    return r6(trains.spike_counts(trains.within_window(s, w)))


def hist_sql(source: str, by: str = "unit_id", x: str = "") -> str:
    """CTEs up to {x}kept and {x}hist (by, bin, left_, width, n) of a source's amplitudes."""
    return f"""{x}q as (select {by}, quantile_cont(amplitude, 0.99) as p99, quantile_cont(amplitude, 0.01) as p1 from {source} group by {by}),
{x}kept as (select {source}.* from {source} join {x}q using ({by}) where amplitude <= p99 + 10 * (p99 - p1)),
{x}rng as (select {by}, min(amplitude) as lo, max(amplitude) as hi, (max(amplitude) - min(amplitude)) / 50 as width from {x}kept group by {by} having max(amplitude) > min(amplitude)),
{x}hc as (select {by}, least(cast(floor((amplitude - lo) / width) as bigint), 49) as bin, count(*) as n from {x}kept join {x}rng using ({by}) group by all),
{x}hist as (select {by}, bin, lo + bin * width as left_, width, coalesce(n, 0) as n from (select * from {x}rng, unnest(range(50)) as g(bin)) left join {x}hc using ({by}, bin))"""


HIST = f"{SP}, {hist_sql('spikes')}"


def hist(spark, d):
    return amplitude.histogram(amplitude.drop_outliers(rel.spikes(spark, d)))


@query(f'with {HIST} select unit_id, bin, round(left_, 6) as "left", round(width, 6) as width, n from hist')
def amplitude_histogram(spark, d):
    return r6(hist(spark, d))


_SYM = """sm as (select unit_id, bin, n, list_sort(list(n) over (partition by unit_id order by bin rows between 2 preceding and 2 following) || list_transform(range(greatest(0, greatest(2 - bin, bin - 47))), lambda z: cast(0 as bigint)))[3] as s from HIST),
mode_ as (select unit_id, min(bin) as m from (select *, max(s) over (partition by unit_id) as top from sm) where s = top group by unit_id),
sym as (select unit_id, sum(n) as n, sum(case when bin > m then n else 0 end) + sum(case when bin > m and 2 * m - bin >= 0 then n else 0 end) as sur from HIST join mode_ using (unit_id) group by unit_id),
missing as (select unit_id, cast(n as bigint) as n, case when n > 5 then case when sur > 0 then greatest(0.0e0, 100.0e0 * (sur - n) / sur) else 0.0e0 end end as missing_symmetric from sym)"""
SYM = f"{HIST}, {_SYM.replace('HIST', 'hist')}"


@query(f"with {SYM} select unit_id, n, round(missing_symmetric, 6) as missing_symmetric from missing")
def missing_symmetric(spark, d):
    return r6(amplitude.missing_symmetric(hist(spark, d)))


@query(f"""with {HIST}, x as (select unit_id, n, n - coalesce(lag(n) over (partition by unit_id order by bin), 0) as rise from hist)
select unit_id, max(n) = max(rise) as is_cutoff, cast(sum(n) as bigint) as n from x group by unit_id""")
def peak_cutoff(spark, d):
    return r6(amplitude.peak_cutoff(hist(spark, d)))


def _normal_cdf_sql(z: str) -> str:
    """The series of odd powers over odd factorials; beyond eight deviations 0 or 1."""
    term = "exp((2 * k + 1) * ln(abs(Z)) - (k + 1) * ln(2.0e0) - lgamma(k + 1.5e0) + 0.5e0 * ln(pi()))".replace("Z", z)
    return f"case when abs({z}) > 8 then case when {z} > 0 then 1.0e0 else 0.0e0 end when {z} = 0 then 0.5e0 else 0.5e0 + sign({z}) * exp(-(({z}) ** 2) / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 100), lambda k: {term})) end"


def gaussian_sql(hist: str, kept: str, by: str = "unit_id", x: str = "") -> str:
    """CTEs up to {x}gauss (by, n, missing_gaussian): damped least squares on all histograms, a step a round of the recursion. Needs `with recursive`."""
    total = lambda e: f"list_sum(list_transform(range(1, len(xs) + 1), lambda i: {e}))"
    f = lambda a, u, s: f"({a} * exp(-((xs[i] - {u}) ** 2) / (2 * {s} * {s})) * ms[i])"
    now, d = f("a", "u", "s"), "(xs[i] - u)"
    jac = [f"({now} / a)", f"({now} * {d} / (s * s))", f"({now} * {d} * {d} / (s * s * s))"]
    sums = ", ".join([f"{total(f'{jac[i]} * {jac[j]}')} as q{i}{j}" for i in range(3) for j in range(i, 3)] + [f"{total(f'{jac[i]} * (ns[i] - {now})')} as g{i}" for i in range(3)])
    damped = ", ".join([f"q{i}{i} * (1 + lam) as d{i}" for i in range(3)])
    cofactors = "d1 * d2 - q12 * q12 as c00, q02 * q12 - q01 * d2 as c01, q01 * q12 - q02 * d1 as c02, d0 * d2 - q02 * q02 as c11, q01 * q02 - d0 * q12 as c12, d0 * d1 - q01 * q01 as c22"
    moves = "a + (c00 * g0 + c01 * g1 + c02 * g2) / det as a2, u + (c01 * g0 + c11 * g1 + c12 * g2) / det as u2, s + (c02 * g0 + c12 * g1 + c22 * g2) / det as s2"
    same = f"{by}, xs, ns, ms"
    return f"""{x}gst as (select {by}, stddev_pop(amplitude) as sd, quantile_cont(amplitude, 0.01) as low from {kept} group by {by}),
{x}gar as (select {by}, list(left_ + width / 2 order by bin) as xs, list(cast(n as double) order by bin) as ns, sum(n) as n from {hist} group by {by}),
{x}gin as (select {same}, low, sd, n, list_max(ns) = list_max(list_transform(range(1, len(ns) + 1), lambda i: ns[i] - coalesce(ns[i - 1], 0))) as cutoff from (select *, list_transform(xs, lambda v: case when v >= low then 1.0e0 else 0.0e0 end) as ms from {x}gar join {x}gst using ({by}))),
{x}gs0 as (select {same}, list_aggregate(ns, 'quantile_cont', 0.99) as a, xs[list_position(ns, list_max(ns))] as u, sd as s from {x}gin where not cutoff and n > 5),
{x}git({by}, xs, ns, ms, a, u, s, lam, cost, going, k) as (select {same}, a, u, s, 1e-3, {total(f'(ns[i] - {now}) ** 2')}, true, 0 from {x}gs0
 union all select {same}, case when ok then a2 else a end, case when ok then u2 else u end, case when ok then s2 else s end, case when ok then greatest(lam / 10, 1e-12) else least(lam * 10, 1e12) end, case when ok then cost2 else cost end, going and not (ok and cost - cost2 <= {GAUSSIAN_TOLERANCE} * cost), k + 1
 from (select *, coalesce(going and isfinite(a2) and isfinite(u2) and isfinite(s2) and isfinite(cost2) and cost2 <= cost, false) as ok
  from (select *, {total(f"(ns[i] - {f('a2', 'u2', 's2')}) ** 2")} as cost2
   from (select *, {moves} from (select *, nullif(d0 * c00 + q01 * c01 + q02 * c02, 0) as det from (select *, {cofactors} from (select *, {damped} from (select *, {sums} from {x}git where going and k < {GAUSSIAN_STEPS}))))))))
,
{x}gauss as (select {by}, cast(i.n as bigint) as n, case when i.n > 5 then case when cutoff then 100.0e0 when isfinite((u - low) / abs(s)) then 100 * (1 - ({_normal_cdf_sql('((u - low) / abs(s))')})) end end as missing_gaussian
 from {x}gin i left join (select {by}, u, s from {x}git where not going or k = {GAUSSIAN_STEPS}) f using ({by}))"""


@query(f"with recursive {HIST}, {gaussian_sql('hist', 'kept')} select unit_id, n, round(missing_gaussian, 3) as missing_gaussian from gauss")
def missing_gaussian(spark, d):
    return r3(amplitude.missing_gaussian(rel.spikes(spark, d)))


@query(f"""with recursive {CHUNKED}, {hist_sql('ch', 'unit_id, chunk')}, {gaussian_sql('hist', 'kept', 'unit_id, chunk')} select unit_id, chunk, n, round(missing_gaussian, 3) as missing_gaussian from gauss""")
def missing_per_chunk(spark, d):
    return r3(amplitude.missing_gaussian(trains.in_chunks(rel.spikes(spark, d), CHUNK), "chunk"))


RATES = f"""{SP}, u as (select unit_id, count(*) as n_spikes, min(t) as t0, max(t) - min(t) as span, least((max(t) - min(t)) // {DAY}, 10000) as nb from spikes group by unit_id having (max(t) - min(t)) // {DAY} >= 1),
rc as (select unit_id, least(((t - t0) * nb) // span, nb - 1) as bin, count(*) as n from spikes join u using (unit_id) group by all),
rb as (select unit_id, n_spikes, span, nb, coalesce(n, 0) / (span * 1e-6 / nb) as rate from (select * from u, unnest(range(nb)) as g(bin)) left join rc using (unit_id, bin))"""


@query(f"""with {RATES} select unit_id, round(max(n_spikes) / (max(span) * 1e-6), 6) as mean_rate, max(nb) as n_bins, round(stddev_pop(rate), 6) as std_rate,
round(var_pop(rate) / nullif(avg(rate), 0), 6) as fano, round(quantile_cont(rate, 0.95) / nullif(quantile_cont(rate, 0.05), 0), 6) as rate_ratio from rb group by unit_id""")
def firing_rate_stats(spark, d):
    return r6(trains.rate_properties(rel.spikes(spark, d), DAY, rel.TICK))


ACG = f"""{SP}, ar as (select a.unit_id, (b.t - a.t) // {ACG_BIN} as lag_bin, count(*) as n from spikes a join spikes b on a.unit_id = b.unit_id and b.t - a.t between 0 and {(ACG_HALF + 1) * ACG_BIN - 1} and (b.t > a.t or b.spike_idx > a.spike_idx) group by all),
acg as (select unit_id, lag_bin, n from ar where lag_bin between 1 and {ACG_HALF} union all select unit_id, -lag_bin, n from ar where lag_bin between 1 and {ACG_HALF}),
dns as (select unit_id, lag_bin, coalesce(n, 0) as n from (select unit_id, lag_bin from (select distinct unit_id from spikes), unnest(range(-{ACG_HALF}, {ACG_HALF + 1})) as g(lag_bin)) left join acg using (unit_id, lag_bin))"""


def acg(spark, d):
    return correlogram.autocorrelogram(rel.spikes(spark, d), ACG_BIN, ACG_WINDOW)


def dense_acg(spark, d):
    return correlogram.dense(acg(spark, d), trains.spike_counts(rel.spikes(spark, d)), ACG_HALF)


@query(f"with {ACG} select unit_id, lag_bin, n from acg")
def acg_counts(spark, d):
    return r6(acg(spark, d))


@query(f"""with {ACG}, u as (select unit_id, count(*) as c, (max(t) - min(t)) * 1e-6 as dur from spikes group by unit_id),
o as (select unit_id, avg(n) as mu, stddev_pop(n) as sd from dns where abs(lag_bin) > {ACG_HALF} * 0.2e0 group by unit_id),
x as (select *, (c / dur) * (c / dur) * dur * {ACG_BIN} * 1e-6 as ex from dns join u using (unit_id) join o using (unit_id))
select unit_id, lag_bin, n, round(n / (c * {ACG_BIN} * 1e-6), 6) as hertz, round((n - ex) / nullif(sqrt(ex), 0), 6) as pearson, round(case when sd > 0 then (n - mu) / sd end, 6) as zscore from x""")
def acg_normalised(spark, d):
    return r6(correlogram.normalised(acg(spark, d), rel.spikes(spark, d), ACG_BIN, ACG_HALF, rel.TICK))


FEAT = (6, 12, 6, 18, 16)  # suppression, baseline, recovery from and to, fit


def feature_sql(supp: int, base: int, lo: int, hi: int, fit: int, bin_ms: float, acg: str = "dns") -> str:
    """CTEs up to `acgf` over a dense correlogram."""
    t = 1 + (fit - 1) // 2
    return f"""fx as (select *, avg(n) filter (where lag_bin >= {lo} and lag_bin < {hi}) over w as rm, max(n) filter (where lag_bin >= 1 and lag_bin < {fit}) over w as fm, max(n) filter (where lag_bin >= {t} and lag_bin < {fit}) over w as tm from {acg} window w as (partition by unit_id)),
fg as (select unit_id, min(n) filter (where lag_bin between 1 and {supp}) as lo, avg(n) filter (where lag_bin >= {base} or (lag_bin >= -{base} and lag_bin < -{supp})) as base,
 min(lag_bin) filter (where lag_bin >= 0 and lag_bin < {2 * hi - lo} and n >= rm) as rec, min(lag_bin) filter (where lag_bin >= 1 and lag_bin < {fit} and fm > 0 and n >= fm * 0.5) as rise,
 regr_slope(ln(greatest(cast(n as double), tm * 0.01e0)), cast(lag_bin as double)) filter (where lag_bin >= {t} and lag_bin < {fit} and tm > 0) as slope from fx group by unit_id),
acgf as (select unit_id, case when base > 0 then lo / base else 0.0e0 end as suppression_ratio, rec * {bin_ms}e0 as suppression_ms, (rise - 1) * {bin_ms}e0 as tau_rise_ms, case when slope < -1e-12 then -1 / slope * {bin_ms} end as tau_decay_ms from fg)"""


@query(f"with {ACG}, {feature_sql(*FEAT, ACG_BIN / 1000)} select unit_id, round(suppression_ratio, 6) as suppression_ratio, round(suppression_ms, 6) as suppression_ms, round(tau_rise_ms, 6) as tau_rise_ms, round(tau_decay_ms, 3) as tau_decay_ms from acgf")
def acg_features(spark, d):
    x = correlogram.features(dense_acg(spark, d), ACG_HALF, ACG_BIN / 1000, *FEAT)
    return r6(x.withColumn("tau_decay_ms", F.round("tau_decay_ms", 3)))


@query(f"""with {ACG}, x as (select unit_id, lag_bin, n, min(n) over w + stddev_samp(n) over w as lim from dns where lag_bin >= 0 window w as (partition by unit_id))
select unit_id, round(min(lag_bin) filter (where n > lim) * {ACG_BIN / 1000}e0, 6) as refractory_ms, from x group by unit_id""")
def acg_refractory(spark, d):
    return r6(correlogram.refractory_ms(dense_acg(spark, d), ACG_BIN / 1000))


@query(f"with {ACG} select unit_id, round(avg(n), 6) as mean_outer from dns where abs(lag_bin) > {ACG_HALF - (2 * ACG_HALF + 1) // 5} group by unit_id")
def acg_outer_rate(spark, d):
    return r6(correlogram.outer_rate(dense_acg(spark, d), ACG_HALF))


LOG_BINS = (60 * S, 100_000 * S, 12)
_la, _lb = math.log10(LOG_BINS[0]), math.log10(LOG_BINS[1])


@query(f"""with {SP}, u as (select unit_id, count(*) as c from spikes group by unit_id),
p as (select a.unit_id, b.t - a.t as d from spikes a join spikes b on a.unit_id = b.unit_id and b.t - a.t between {LOG_BINS[0]} and {LOG_BINS[1] - 1}),
n as (select unit_id, least(cast(floor((log10(d) - {_la!r}) * {LOG_BINS[2]} / {_lb - _la!r}) as bigint), {LOG_BINS[2] - 1}) as lag_bin, count(*) as n from p group by all)
select unit_id, lag_bin, n, round(n / (c * (pow(10.0e0, {_la!r} + (lag_bin + 1) * {(_lb - _la)!r} / {LOG_BINS[2]}) - pow(10.0e0, {_la!r} + lag_bin * {(_lb - _la)!r} / {LOG_BINS[2]})) * 1e-6), 6) as rate from n join u using (unit_id)""")
def acg_log_counts(spark, d):
    return r6(correlogram.log_autocorrelogram(rel.spikes(spark, d), *LOG_BINS, rel.TICK))


@query(f"""with {SP}, bnd as (select min(t) as t0, cast(greatest(ceil((max(t) - min(t) + 1) / {DAY}.0e0), 1) as bigint) as nb from spikes),
c as (select unit_id, (t - t0) // {DAY} as bin, count(*) as n from spikes, bnd group by all)
select unit_id, bin, t0 + bin * {DAY} as "start", round(coalesce(n, 0) / ({DAY} * 1e-6), 9) as rate from (select unit_id, t0, bin from (select distinct unit_id from spikes), bnd, unnest(range(nb)) as g(bin)) left join c using (unit_id, bin)""")
def amplitude_panel_rates(spark, d):
    x = trains.binned_rates(rel.spikes(spark, d), DAY, rel.TICK)
    return x.select("unit_id", F.col("bin").cast("long").alias("bin"), "start", F.round("rate", 9).alias("rate"))


CCG_HALF = correlogram.half_bins(CCG_WINDOW, CCG_BIN)


@query(f"""with {SP}, p as (select a.unit_id as i, b.unit_id as j, (b.t - a.t) // {CCG_BIN} as l, count(*) as n from spikes a join spikes b on b.t - a.t between 0 and {(CCG_HALF + 1) * CCG_BIN - 1} and (b.t > a.t or b.spike_idx > a.spike_idx) group by all),
q as (select i, j, l, n from p where l <= {CCG_HALF} union all select j, i, -l, n from p where l <= {CCG_HALF})
select i as unit_i, j as unit_j, l as lag_bin, max(n) as n from q where not (i = j and l = 0) group by all""")
def ccg_counts(spark, d):
    return r6(correlogram.crosscorrelogram(rel.spikes(spark, d), CCG_BIN, CCG_WINDOW))


@query(f"""with {SP}, n as (select unit_id as i, count(*) as ni from spikes group by all),
p as (select a.unit_id as i, b.unit_id as j, cast(floor(0.5e0 + (b.t - a.t) / {CCG_BIN}.0e0) as bigint) as l from spikes a join spikes b on abs(b.t - a.t) <= {CCG_HALF * CCG_BIN + CCG_BIN // 2} and a.spike_idx <> b.spike_idx)
select i as unit_i, j as unit_j, l as lag_bin, count(*) as n, round(count(*) / (max(ni) * {CCG_BIN} * 1e-6), 6) as rate from p join n using (i) where abs(l) <= {CCG_HALF} group by i, j, l""")
def ccg_rounded(spark, d):
    x = correlogram.rounded_crosscorrelogram(rel.spikes(spark, d), CCG_BIN, CCG_HALF, rate=True, tick=rel.TICK, rounded=quick_r6)
    return x.select("unit_i", "unit_j", F.col("lag_bin").cast("long").alias("lag_bin"), "n", "rate")


CT = "tpl as (select vec_id // 16 as template_id, vec_id % 16 as channel, list_transform(embedding, lambda v: cast(v as double)) as wf from embeddings)"
T1 = "tpl as (select vec_id as template_id, list_transform(embedding, lambda v: cast(v as double)) as wf from embeddings)"


@query(f"with {CT} select template_id, channel, round(list_max(wf) - list_min(wf), 6) as range from tpl qualify row_number() over (partition by template_id order by list_max(wf) - list_min(wf) desc, channel) = 1")
def template_peak_channel(spark, d):
    x = waveform.peak_channel(rel.channel_templates(spark, d))
    return r6(x.select("template_id", "channel", (F.array_max("wf") - F.array_min("wf")).alias("range")))


@query(f"with {CT}, m as (select template_id, channel, list_max(list_transform(wf, lambda v: abs(v))) as top from tpl) select template_id, channel, round(top, 6) as top from m qualify row_number() over (partition by template_id order by top desc, channel) = 1")
def template_peak_channel_absolute(spark, d):
    x = waveform.peak_channel(rel.channel_templates(spark, d), absolute=True)
    return r6(x.select("template_id", "channel", F.array_max(waveform.magnitudes(F.col("wf"))).alias("top")))


@query(f"""with {T1}, m as (select template_id, wf, wf[5:] as w, list_transform(wf[5:], lambda v: abs(v)) as a from tpl), p as (select *, list_position(a, list_max(a)) as pos from m),
q as (select *, w[pos:] as rest from p)
select template_id, round(case when list_max(a) > 0 then (list_position(rest, case when w[pos] > 0 then list_min(rest) else list_max(rest) end) - 1) * 1e6 / 30000 end, 6) as duration_us,
 round(list_max(list_transform(wf[1:10], lambda v: abs(v))) / nullif(list_max(list_transform(wf, lambda v: abs(v))), 0), 6) as baseline_flatness,
 round((abs(list_max(wf)) + abs(list_min(wf))) * 2.34375e0, 6) as raw_amplitude,
 round(case when len(hi) > 1 then (list_max(hi) - list_min(hi)) / 30000.0e0 * 1000 end, 6) as half_width_ms
from (select *, list_filter(range(1, 65), lambda i: wf[i] >= list_max(wf) / 2) as hi from q)""")
def waveform_scalars(spark, d):
    wf = F.col("wf")
    return r6(rel.templates(spark, d).select(
        "template_id", waveform.duration_us(wf, FS, masked=4).alias("duration_us"), waveform.baseline_flatness(wf, 0, 10).alias("baseline_flatness"), amplitude.raw_amplitude(wf, 2.34375).alias("raw_amplitude"), waveform.half_width_ms(wf, FS).alias("half_width_ms")))


@query(f"""with {T1}, e as (select template_id, i, wf[i] as v, list_max(wf) as hi, -list_min(wf) as lo from tpl, unnest(range(1, 65)) as g(i)),
r as (select *, lag(v) over (partition by template_id order by i) as b from e), k as (select * from r where b is null or v <> b),
n as (select *, lag(v) over w as p, lead(v) over w as q from k window w as (partition by template_id order by i))
select template_id, count(*) filter (where v > p and v > q and v >= 0.1e0 * hi) as n_peaks, count(*) filter (where v < p and v < q and -v >= 0.1e0 * lo) as n_troughs from n group by template_id""")
def waveform_extrema(spark, d):
    return r6(waveform.extrema(rel.templates(spark, d)))


def peaks_sql(name: str, series: str, sign: str = "") -> str:
    """CTEs up to `name` (template_id, p, top, prom, width) of the local maxima of a series (template_id, i, v, wf), v being sign wf[i + 1].

    No plateaus: in the tables at hand no two neighbours are equal.
    """
    at = lambda i: f"({sign}wf[{i} + 1])"
    with_series = f"join {series} s using (template_id) group by all"
    return f"""{name}_n as (select *, lag(v) over w as pv, lead(v) over w as nv from {series} window w as (partition by template_id order by i)),
{name}_p as (select template_id, i as p, v as top from {name}_n where pv < v and nv < v),
{name}_b as (select q.*, coalesce(max(s.i) filter (where s.i < p and s.v > top), -1) as lb, coalesce(min(s.i) filter (where s.i > p and s.v > top), 100000) as rb from {name}_p q {with_series}),
{name}_l as (select q.*, min(s.v) filter (where s.i > lb and s.i <= p) as ll, min(s.v) filter (where s.i >= p and s.i < rb) as rl from {name}_b q {with_series}),
{name}_e as (select q.*, top - greatest(ll, rl) as prom, top - (top - greatest(ll, rl)) / 2 as half, max(s.i) filter (where s.i > lb and s.i <= p and s.v = ll) as le, min(s.i) filter (where s.i >= p and s.i < rb and s.v = rl) as re from {name}_l q {with_series}),
{name}_k as (select q.*, any_value(s.wf) as wf, max(s.i) filter (where s.i between le and p and s.v <= half) as lk, min(s.i) filter (where s.i between p and re and s.v <= half) as rk from {name}_e q {with_series}),
{name} as (select template_id, p, top, prom, (rk - case when {at('rk')} < half then (half - {at('rk')}) / ({at('(rk - 1)')} - {at('rk')}) else 0 end) - (lk + case when {at('lk')} < half then (half - {at('lk')}) / ({at('(lk + 1)')} - {at('lk')}) else 0 end) as width from {name}_k)"""


def _side_sql(name: str, part: str) -> str:
    """CTE `name` (template_id, places, sizes, width, forced): the peaks of one side of the trough, or what stands for them."""
    strong, weak = f"list({{}} order by p) filter (where prom >= 0.2e0 * big)", "arg_max({}, struct_pack(a := prom, b := -p)) filter (where prom >= 0.015e0 * big)"
    return f"""{name}_f as (select template_id, {strong.format('p')} as sp, {strong.format('top')} as st, arg_max(width, struct_pack(a := prom, b := -p)) filter (where prom >= 0.2e0 * big) as sw,
 {weak.format('p')} as wp, {weak.format('top')} as wt, {weak.format('width')} as ww from {name}_pk join shp_t using (template_id) where usable_{name} group by template_id),
{name}_m as (select template_id, arg_max(i, struct_pack(a := v, b := -i)) as mp, max(v) as mt from {part} group by template_id),
{name} as (select template_id, case when sp is not null then sp when wp is not null then [wp] when mp is not null then [mp] else [case when '{name}' = 'aft' then trough else 0 end] end as places,
 case when sp is not null then st when wp is not null then [wt] when mp is not null then [mt] else [0.0e0] end as sizes, case when sp is not null then sw when wp is not null then ww end as width, sp is null as forced
 from shp_t left join {name}_f using (template_id) left join {name}_m using (template_id))"""


def shape_sql(tpl: str = "tpl", lead: int = 4, fs: float = FS) -> str:
    """CTEs up to `shape` over templates (template_id, wf) of which some value after the masked lead isn't 0."""
    ratio = lambda a, b: f"case when {b} <> 0 then abs({a} / {b}) end"
    return f"""smp as (select template_id, wf, i, wf[i + 1] as v from {tpl}, unnest(range({lead}, len(wf))) as g(i)), neg as (select template_id, wf, i, -v as v from smp),
{peaks_sql('low', 'neg', '-')},
shp_b as (select template_id, len(any_value(wf)) as size, max(abs(v)) as big, arg_min(i, struct_pack(a := v, b := i)) as deepest, min(v) as depth, arg_max(i, struct_pack(a := abs(v), b := -i)) as largest from smp group by template_id),
shp_l as (select template_id, list(p order by p) as lp, list(top order by p) as lt, arg_max(p, struct_pack(a := top, b := -p)) as main, arg_max(width, struct_pack(a := prom, b := -p)) as lw from low join shp_b using (template_id) where prom >= 0.2e0 * big group by template_id),
shp_t as (select template_id, size, big, largest, coalesce(main, deepest) as trough, lw as trough_width, coalesce(lp, [deepest]) as trough_places, coalesce(list_max(lt), depth) as size_t,
 coalesce(main, deepest) > 3 as usable_bef, size - coalesce(main, deepest) > 3 as usable_aft from shp_b left join shp_l using (template_id)),
part_b as (select s.* from smp s join shp_t using (template_id) where i < trough), part_a as (select s.* from smp s join shp_t using (template_id) where i >= trough),
{peaks_sql('bef_pk', 'part_b')}, {peaks_sql('aft_pk', 'part_a')}, {_side_sql('bef', 'part_b')}, {_side_sql('aft', 'part_a')},
shp_s as (select t.*, b.places as bp, a.places as ap, b.width as bw, list_max(list_transform(b.sizes, lambda x: abs(x))) as size_b, list_max(list_transform(a.sizes, lambda x: abs(x))) as size_a,
 case when b.forced and a.forced then not b.sizes[1] > a.sizes[1] else b.forced end as fb, case when b.forced and a.forced then b.sizes[1] > a.sizes[1] else a.forced end as fa from shp_t t join bef b using (template_id) join aft a using (template_id)),
shp_d as (select template_id, case when any_value(wf[largest + 1]) > 0 then arg_min(i, struct_pack(a := v, b := i)) else arg_max(i, struct_pack(a := v, b := -i)) end as opposite from smp join shp_t using (template_id) where i >= largest group by template_id),
shape as (select template_id, case when fb and size_b < 0.1e0 * big then ap when fa and size_a < 0.1e0 * big then bp else list_concat(bp, ap) end as peak_places, trough_places, len(peak_places) as n_peaks, len(trough_places) as n_troughs,
 1e6 * abs(largest - opposite) / {fs}e0 as duration_us, bw as peak_before_width, trough_width, {ratio('size_a', 'size_t')} as second_peak_to_trough, {ratio('size_b', 'size_a')} as peak1_to_peak2, {ratio('greatest(size_b, size_a)', 'size_t')} as main_peak_to_trough, {ratio('size_t', 'size_b')} as trough_to_peak2
 from shp_s join shp_d using (template_id))"""


_SHAPE_NUMBERS = ("duration_us", "peak_before_width", "trough_width", "second_peak_to_trough", "peak1_to_peak2", "main_peak_to_trough", "trough_to_peak2")


@query(f"""with {T1}, {shape_sql()} select template_id, n_peaks, n_troughs, {", ".join(f"round({c}, 6) as {c}" for c in _SHAPE_NUMBERS)},
array_to_string(peak_places, ',') as peak_places, array_to_string(trough_places, ',') as trough_places from shape""")
def waveform_shape(spark, d):
    x = waveform.waveform_shape(rel.templates(spark, d), FS).withColumns({c: summary.finite(F.col(c)) for c in ("second_peak_to_trough", "peak1_to_peak2", "main_peak_to_trough", "trough_to_peak2")})
    return r6(x.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("peak_places", "trough_places")}))


CHAN = "chn as (select i as channel, i % 2 * 32.0e0 as x, i // 2 * 15.0e0 as y from range(16) g(i))"
POINTS = f"""{CT}, {CHAN}, top as (select template_id, channel as peak from tpl qualify row_number() over (partition by template_id order by list_max(wf) - list_min(wf) desc, channel) = 1),
dp as (select template_id, c.channel, list_max(list_transform(wf, lambda v: abs(v))) as val, abs(c.x - k.x) as dx, abs(c.y - k.y) as dy, sqrt((c.x - k.x) ** 2 + (c.y - k.y) ** 2) as dist from tpl join chn c using (channel) join top using (template_id) join chn k on k.channel = peak),
rk as (select *, row_number() over (partition by template_id order by case when dx <= 33 then dy else far end, channel) as r from (select *, max(dy) over (partition by template_id) as far from dp)),
pts as (select template_id, dist, val / max(val) over (partition by template_id) as val from rk where r <= 6 qualify count(*) over (partition by template_id) = 6)"""


def points(spark, d):
    return waveform.decay_points(rel.channel_templates(spark, d), rel.channels(spark), 6)


@query(f"with {POINTS} select template_id, round(-regr_slope(val, dist), 6) as spatial_decay, count(*) as n_points from pts group by template_id")
def spatial_decay_linear(spark, d):
    return r6(waveform.linear_decay(points(spark, d)))


@query(f"with {POINTS} select template_id, round(regr_slope(ln(val + 1e-10), dist), 6) as slope, round(regr_intercept(ln(val + 1e-10), dist), 6) as intercept from pts group by template_id")
def spatial_decay_loglinear(spark, d):
    return r6(waveform.log_linear_decay(points(spark, d)))


def exponential_sql(points: str = "pts", most: float = 0.3, grid: int = 600, rounds: int = 60) -> str:
    """CTEs up to `expo` (template_id, spatial_decay): the slope with the least squares, its height solved for, on a grid and then by thirds. Needs `with recursive`."""
    cost = lambda m: f"(select sum(val * val) - sum(val * exp({m} * dist)) ** 2 / sum(exp(2 * {m} * dist)) from {points} p where p.template_id = z.template_id)"
    step = 1.2 * most / grid
    return f"""eg as (select template_id, m, sum(val * val) - sum(val * exp(m * dist)) ** 2 / sum(exp(2 * m * dist)) as c from {points}, (select -{most} + i * {step}e0 as m from range({grid + 1}) g(i)) group by all),
e0 as (select template_id, arg_min(m, c) as m from eg group by template_id),
et(template_id, lo, hi, k) as (select template_id, m - {step}, m + {step}, 0 from e0 union all
 select template_id, case when ca > cb then a else lo end, case when ca > cb then hi else b end, k + 1 from (select *, {cost('a')} as ca, {cost('b')} as cb from (select *, lo + (hi - lo) / 3 as a, hi - (hi - lo) / 3 as b from et where k < {rounds}) z)),
expo as (select template_id, -(lo + hi) / 2 as spatial_decay from et where k = {rounds})"""


@query(f"with recursive {POINTS}, {exponential_sql()} select template_id, round(spatial_decay, 3) as spatial_decay from expo")
def spatial_decay_exponential(spark, d):
    return r3(waveform.exponential_decay(points(spark, d)))


@query("with y as (select distinct i // 2 * 15.0e0 as y from range(16) g(i)), z as (select y - lag(y) over (order by y) as gap from y) select min(gap) as least_gap, min(gap) < 30 as allowed from z")
def probe_geometry_gate(spark, d):
    return r6(waveform.geometry_allows_decay(rel.channels(spark)))


@query(f"with {CHAN}, p as (select a.channel, b.channel as near, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) as dist from chn a, chn b) select channel, near, row_number() over (partition by channel order by dist, near) as rank, round(dist, 6) as distance from p where dist <= 40 qualify row_number() over (partition by channel order by dist, near) <= 5")
def nearest_channels(spark, d):
    return r6(waveform.nearest_channels(rel.channels(spark), 5, 40.0))


@query(f"""with {CHAN}, p as (select a.channel, b.channel as near, case when abs(a.x - b.x) > 20 then 1 else 0 end as off, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) as dist from chn a, chn b)
select channel, near, row_number() over (partition by channel order by off, dist, near) as rank from p qualify rank <= 10""")
def display_channels(spark, d):
    return r6(waveform.display_channels(rel.channels(spark), 10, 20.0))


@query(f"""with {CHAN}, p as (select a.channel, b.channel as near, count(*) filter (where b.channel >= a.channel) over (partition by a.channel) >= 4 as up from chn a join chn b using (x)),
q as (select * from p where case when up then near >= channel else near <= channel end) select channel, near, row_number() over (partition by channel order by abs(near - channel)) as rank from q qualify rank <= 4""")
def same_column_channels(spark, d):
    return r6(waveform.same_column_channels(rel.channels(spark), 4))


@query(f"""with {POINTS}, d as (select template_id, -regr_slope(val, dist) as sl from pts group by template_id), t as (select template_id, max(list_max(list_transform(wf, lambda v: abs(v)))) as top from tpl group by template_id)
select template_id, round(sl / nullif(top, 0), 6) as spatial_decay from d join t using (template_id)""")
def spatial_decay_rescaled(spark, d):
    x = waveform.linear_decay(points(spark, d)).select("template_id", "spatial_decay")
    return r6(waveform.rescaled_decay(x, rel.channel_templates(spark, d)))


PC = "pcs as (select user_id as unit_id, event_id as spike_idx, epoch_us(ts) as t, c as channel, abs(value) * (1 + (event_id * (c + 3)) % 7) - 2.0e0 as pc1 from events, unnest(range(4)) as g(c))"


def pcs(spark, d):
    x = rel.spikes(spark, d).select("unit_id", "spike_idx", "t", "amplitude", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("channel"))
    return x.select("unit_id", "spike_idx", "t", "channel", (F.abs("amplitude") * (1 + (F.col("spike_idx") * (F.col("channel") + 3)) % 7) - 2.0).alias("pc1"))


@query(f"""with {PC}, {CHAN}, dep as (select unit_id, spike_idx, t, sum(y * greatest(pc1, 0) ** 2) / (sum(greatest(pc1, 0) ** 2) + 1e-3) as depth from pcs join chn using (channel) group by all),
u as (select unit_id, min(t) as t0, max(t) - min(t) as span, case when max(t) - min(t) < {2 * DAY} then (max(t) - min(t)) / 2.0e0 else {DAY}.0e0 end as size from dep group by unit_id),
b as (select unit_id, cast(floor((t - t0) / size) as bigint) as bin, median(depth) as m from dep join u using (unit_id) where span > 0 and floor((t - t0) / size) < ceil(span / size) - 1 group by all),
s as (select *, abs(m - lag(m) over (partition by unit_id order by bin)) as step from b)
select unit_id, round(max(m) - min(m), 6) as max_drift, round(coalesce(sum(step), 0), 6) as cumulative_drift, count(*) as n_bins from s group by unit_id""")
def drift_estimate(spark, d):
    return r6(features.drift(features.drift_bins(features.spike_depths(pcs(spark, d), rel.channels(spark)), DAY)))


DIMS, PER_CHANNEL = 12, 3


def unit_channels(spark, d):
    """A unit's first channel is label mod 3; its channels are that and the next three, with three values each."""
    u = F.col("unit_id")
    return rel.pc_vectors(spark, d, DIMS).select("unit_id").distinct().select("unit_id", (u % 3).alias("first_channel"), F.array(*[u % 3 + i for i in range(DIMS // PER_CHANNEL)]).alias("channels"))


def _mahalanobis_sql() -> str:
    """CTEs up to `dist` (unit_id, n, d2): a Cholesky factor of each unit's covariance, column after column, and a forward substitution for each spike of others."""
    dims = range(DIMS)
    out = [
        "emb as (select cast(label as bigint) as u, vec_id as s, list_transform(embedding[1:12], lambda v: cast(v as double)) as f from embeddings)",
        "cov0 as (select u, count(*) as n, " + ", ".join(f"avg(f[{i + 1}]) as m{i}" for i in dims) + ", "
        + ", ".join(f"(sum(f[{i + 1}] * f[{j + 1}]) - count(*) * avg(f[{i + 1}]) * avg(f[{j + 1}])) / (count(*) - 1){' + 1e-10' if i == j else ''} as a{i}_{j}" for i in dims for j in range(i + 1)) + f" from emb group by u having count(*) > {DIMS})",
    ]
    for j in dims:
        done = lambda i, top: "".join(f" - l{i}_{k} * l{top}_{k}" for k in range(top))
        out.append(f"piv{j} as materialized (select *, sqrt(a{j}_{j}{done(j, j)}) as l{j}_{j} from cov{j})")
        below = "".join(f", (a{i}_{j}{done(i, j)}) / l{j}_{j} as l{i}_{j}" for i in range(j + 1, DIMS))
        out.append(f"cov{j + 1} as materialized (select *{below} from piv{j})")
    # other spikes' values at the place of this unit's channels; a channel that the other unit lacks gives zeros
    value = lambda i: f"case when u % 3 + {i // PER_CHANNEL} between o % 3 and o % 3 + {DIMS // PER_CHANNEL - 1} then f[({PER_CHANNEL} * (u % 3 + {i // PER_CHANNEL} - o % 3) + {i % PER_CHANNEL + 1})] else 0.0e0 end"
    out.append(f"sub0 as materialized (select c.*, {', '.join(f'{value(i)} - m{i} as d{i}' for i in dims)} from cov{DIMS} c join (select u as o, f from emb) e on o <> c.u and c.u % 3 between o % 3 and o % 3 + {DIMS // PER_CHANNEL - 1})")
    for i in dims:
        out.append(f"sub{i + 1} as materialized (select *, (d{i}{''.join(f' - l{i}_{k} * y{k}' for k in range(i))}) / l{i}_{i} as y{i} from sub{i})")
    out.append(f"dist as (select u as unit_id, n, {' + '.join(f'y{i} * y{i}' for i in dims)} as d2 from sub{DIMS})")
    return ",\n".join(out)


_TAIL = "exp(-d2 / 2) * (" + " + ".join(f"(d2 / 2) ** {k} / {math.factorial(k)}" for k in range(DIMS // 2)) + ")"


@query(f"""with {_mahalanobis_sql()}, rk as (select *, row_number() over (partition by unit_id order by d2) as r, count(*) over (partition by unit_id) as n_other from dist)
select unit_id, max(n) as n, max(n_other) as n_other, round(sum({_TAIL}) / max(n), 3) as l_ratio, round(max(d2) filter (where n_other > n and r = n + 1), 3) as isolation_distance from rk group by unit_id""")
def isolation_distance(spark, d):
    return r3(features.isolation(rel.pc_vectors(spark, d, DIMS), unit_channels(spark, d), DIMS, PER_CHANNEL))


@query(f"with {_mahalanobis_sql()} select unit_id, round(avg(d2) / ({DIMS} * (max(n) - 1.0e0) / max(n)), 3) as silhouette from dist group by unit_id")
def silhouette(spark, d):
    return r3(features.silhouette_ratio(rel.pc_vectors(spark, d, DIMS), unit_channels(spark, d), DIMS, PER_CHANNEL))


@query(f"""with {T1}, {SP}, med as (select unit_id, median(amplitude) as m from spikes group by unit_id), mad as (select unit_id, median(abs(amplitude - m)) as mad from spikes join med using (unit_id) group by unit_id)
select template_id as unit_id, round(mad, 6) as mad, round(case when mad > 0 then list_max(list_transform(wf, lambda v: abs(v))) / mad end, 6) as snr from tpl left join mad on template_id = unit_id""")
def snr_mad(spark, d):
    s = rel.spikes(spark, d).select("unit_id", F.col("amplitude").alias("value"))
    return r6(amplitude.signal_to_noise(rel.templates(spark, d).select(F.col("template_id").alias("unit_id"), "wf"), s))


@query("""with s as (select cast(label as bigint) as unit_id, vec_id, i, cast(embedding[i] as double) as v from embeddings, unnest(range(1, 65)) as g(i)), m as (select unit_id, i, avg(v) as v from s group by all),
b as (select unit_id, avg(v) as b from m where i <= 20 group by unit_id) select unit_id, i - 1 as sample, round(v - b, 6) as v from m join b using (unit_id)""")
def mean_waveform(spark, d):
    x = rel.table(spark, d, "embeddings").select(F.col("label").alias("unit_id"), F.col("vec_id").alias("spike_idx"), F.lit(0).alias("channel"), F.transform("embedding", lambda v: v.cast("double")).alias("wf"))
    return r6(amplitude.mean_waveforms(x, 20).select("unit_id", F.posexplode("wf").alias("sample", "v")))


@query("""with s as (select label as unit_id, vec_id, i, cast(embedding[i] as double) as v from embeddings, unnest(range(1, 65)) as g(i)),
l as (select vec_id, regr_slope(v, i) as a, regr_intercept(v, i) as b from s group by all) select vec_id as spike_idx, i - 1 as sample, round(v - a * i - b, 6) as v from s join l using (vec_id)""")
def detrended_snippets(spark, d):
    x = rel.table(spark, d, "embeddings").select(F.col("vec_id").alias("spike_idx"), F.transform("embedding", lambda v: v.cast("double")).alias("wf"))
    return r6(amplitude.detrended(x).select("spike_idx", F.posexplode("wf").alias("sample", "v")))


_KERNEL = (0.054488684549642945, 0.24420134200323335, 0.4026199468942475)


@query(f"""with s as (select cast(label as bigint) as unit_id, vec_id, list_transform(embedding, lambda v: cast(v as double)) as wf from embeddings),
m as (select unit_id, vec_id, list_transform(range(1, 65), lambda i: {_KERNEL[0]} * (wf[greatest(i - 2, 1)] + wf[least(i + 2, 64)]) + {_KERNEL[1]} * (wf[greatest(i - 1, 1)] + wf[least(i + 1, 64)]) + {_KERNEL[2]} * wf[i]) as wf,
 case when row_number() over (partition by unit_id order by vec_id) * 2 <= count(*) over (partition by unit_id) then 0 else 1 end as half from s),
b as (select unit_id, half, i, wf[i] - list_sum(wf[1:20]) / 20 as v from m, unnest(range(1, 65)) as g(i))
select unit_id, cast(half as bigint) as half, i - 1 as sample, round(median(v), 6) as v from b group by all""")
def half_median_waveforms(spark, d):
    x = rel.table(spark, d, "embeddings").select(F.col("label").alias("unit_id"), F.col("vec_id").alias("spike_idx"), F.lit(0).alias("channel"), F.transform("embedding", lambda v: v.cast("double")).alias("wf"))
    return r6(amplitude.half_medians(x, 20).select("unit_id", "half", F.posexplode("wf").alias("sample", "v")))


_DUPES = f"""{LINE}, sz as (select unit_id, count(*) as n from dense group by unit_id),
dup as (select a.channel, a.spike_idx as idx_a, b.spike_idx as idx_b, a.unit_id as unit_a, b.unit_id as unit_b, b.t - a.t as delta,
 case when case when a.unit_id = b.unit_id then a.amplitude < b.amplitude else na.n < nb.n end then a.spike_idx else b.spike_idx end as loser
 from dense a join dense b on a.channel = b.channel and b.t - a.t between 0 and 1 and (b.t > a.t or b.spike_idx > a.spike_idx) join sz na on na.unit_id = a.unit_id join sz nb on nb.unit_id = b.unit_id)"""


@query(f"with {_DUPES} select * from dup")
def duplicate_pairs(spark, d):
    return r6(duplicates.duplicate_pairs(rel.dense_spikes(spark, d), 1))


@query(f"with {_DUPES} select unit_id, count(*) as n_spikes, round(sum(amplitude), 2) as total from dense where spike_idx not in (select loser from dup) group by unit_id")
def dedup_spikes(spark, d):
    x = duplicates.without_duplicates(rel.dense_spikes(spark, d), 1)
    return r6(x.groupBy("unit_id").agg(F.count("*").alias("n_spikes"), F.round(F.sum("amplitude"), 2).alias("total")))


@query(f"""with recursive {LINE}, sz as (select unit_id, count(*) as n from dense group by unit_id),
s as (select d.*, n, case when t - lag(t) over w <= 1 then 0 else 1 end as opens from dense d join sz using (unit_id) window w as (partition by channel order by t, spike_idx)),
r as (select *, sum(opens) over (partition by channel order by t, spike_idx) as run from s),
q as (select channel, run, list(struct_pack(i := spike_idx, p := p, t := t, u := unit_id, n := n, a := amplitude) order by p) as l
 from (select *, row_number() over (partition by channel, run order by t, spike_idx) as p from r) group by all having count(*) > 1),
g(channel, run, l, k, gone) as (select channel, run, l, 1, cast([] as bigint[]) from q
 union all select channel, run, l, k + 1, case when list_contains(gone, k) then gone else list_concat(gone,
  list_transform(case when f = 0 then c else c[:f - 1] end, lambda b: b.p), case when f > 0 then [k] else cast([] as bigint[]) end) end
 from (select *, list_position(list_transform(c, lambda b: case when b.u = l[k].u then l[k].a < b.a else l[k].n < b.n end), true) as f0, coalesce(f0, 0) as f
  from (select *, list_filter(l[k + 1:], lambda b: b.t - l[k].t <= 1 and not list_contains(gone, b.p)) as c from g where k < len(l))))
select unnest(list_transform(gone, lambda p: l[p].i)) as spike_idx from g where k = len(l)""")
def dedup_greedy(spark, d):
    return duplicates.greedy_losers(rel.dense_spikes(spark, d), 1)


@query(f"""with {SP}, r as (select unit_id, spike_idx, t, row_number() over (partition by unit_id order by t, spike_idx) - 1 as rank, count(*) over (partition by unit_id) as n from spikes),
k as (select distinct unit_id, case when n <= 20 then i else (i * (n - 1)) // 19 end as rank from (select distinct unit_id, n from r), unnest(range(greatest(20, n))) as g(i) where i < 20 or n <= 20)
select r.unit_id, spike_idx, t, r.rank from r join k on r.unit_id = k.unit_id and r.rank = k.rank""")
def sampled_spikes(spark, d):
    return r6(trains.sampled_spikes(rel.spikes(spark, d), 20).select("unit_id", "spike_idx", "t", "rank"))


# the end-to-end run: dense trains in days with duplicates, spikes of a probe as templates
RUN = Ticks(tick=1.0, taus=(2, 4, 6), tau_c=1, chunk=400, presence_bin=100, dedup=1)
RUN_PARAMS = QualityParams(min_num_spikes=90, max_rpv=0.5, max_perc_missing=60.0, min_presence_ratio=0.9)
_bump = lambda at, w: f"exp(-((i - ({at})) * (i - ({at}))) / (2 * {w} * {w}))"
SPIKE_TEMPLATES = f"""tpl0 as (select vec_id as template_id, vec_id % 16 as peak, 1.5e0 + 8 * abs(cast(embedding[1] as double)) as w1, 0.2e0 + 2 * abs(cast(embedding[2] as double)) as b, 6 + floor(60 * abs(cast(embedding[3] as double))) as d,
 3 + 20 * abs(cast(embedding[4] as double)) as w2, abs(cast(embedding[5] as double)) as c, 15 + 200 * abs(cast(embedding[6] as double)) as reach from embeddings),
tpl as (select template_id, channel, list_transform(range(64), lambda i: (b * {_bump('25 + d', 'w2')} + c * {_bump('17', '2.0e0')} - {_bump('25', 'w1')}) * exp(-far / reach)) as wf
 from (select *, sqrt(((channel % 2) - (peak % 2)) ** 2 * 1024.0e0 + ((channel // 2) - (peak // 2)) ** 2 * 225.0e0) as far from tpl0, unnest(range(16)) as g(channel)))"""
_COLUMNS = ("contamination", "tau_r", "presence_ratio", "percent_missing", "percent_missing_symmetric", "n_peaks", "n_troughs", *_SHAPE_NUMBERS, "baseline_flatness", "spatial_decay")
_NOISE = {
    "peaks": "n_peaks > 2", "troughs": "n_troughs > 1", "duration": "duration_us < 100 or duration_us > 1150", "baseline": "baseline_flatness > 0.3", "second_peak": "second_peak_to_trough > 0.8", "spatial_decay": "spatial_decay < 0.01 or spatial_decay > 0.1"}
_MUA = {"missing": f"percent_missing > {RUN_PARAMS.max_perc_missing}", "few_spikes": f"n_spikes < {RUN_PARAMS.min_num_spikes}", "rpv": f"contamination > {RUN_PARAMS.max_rpv}", "presence": f"presence_ratio < {RUN_PARAMS.min_presence_ratio}"}
_SOMA = "coalesce(trough_to_peak2 < 5 and peak_before_width < 4 and trough_width < 5 and peak1_to_peak2 > 3, false) or coalesce(main_peak_to_trough > 0.8, false)"
_any = lambda rules: " or ".join(f"coalesce({v}, false)" for v in rules.values())
_chunks_sql = CHUNKED.split("ci as (", 1)[1].replace("1e-6", "1").replace(f"tau_r - {TAU_C}", f"tau_r - {RUN.tau_c}")
QUALITY = f"""recursive {_DUPES}, spikes as (select unit_id, spike_idx, t, amplitude from dense where spike_idx not in (select loser from dup)),
qn as (select unit_id, count(*) as n0 from spikes group by unit_id), bnd as (select min(t) as t0, max(t) as t1 from spikes),
taus(tau_idx, tau_r) as (values {", ".join(f"({i}, {t})" for i, t in enumerate(RUN.taus))}),
ch as materialized (select s.*, cast((t - t0) // {RUN.chunk} as bigint) as chunk from spikes s join qn using (unit_id), bnd where n0 >= {RUN_PARAMS.small_unit_spikes} and (t - t0) // {RUN.chunk} < ceil((t1 - t0) / {RUN.chunk}.0e0) - 1),
ci as ({_chunks_sql},
ti as (select unit_id, max(tau_idx) filter (where total = least_) as ti from (select *, min(total) over (partition by unit_id) as least_ from (select unit_id, tau_idx, round(sum(contamination), 9) as total from chill group by all)) group by unit_id),
{hist_sql('ch', 'unit_id, chunk', 'c')}, {gaussian_sql('chist', 'ckept', 'unit_id, chunk', 'c')},
cc as (select unit_id, chunk, coalesce(missing_gaussian < {RUN_PARAMS.max_perc_missing} and contamination < {RUN_PARAMS.max_rpv}, false) as good from chill join ti using (unit_id) left join cgauss using (unit_id, chunk) where tau_idx = ti),
cr as (select unit_id, min(chunk) as lo, max(chunk) as hi from cc group by unit_id),
ci2 as (select unit_id, chunk, chunk - row_number() over (partition by unit_id order by chunk) as island from cc where good),
ru as (select unit_id, island, min(chunk) as f, max(chunk) as l from ci2 group by all),
be as (select unit_id, f, l from ru qualify row_number() over (partition by unit_id order by l - f desc, f) = 1),
wn as (select unit_id, t0 + coalesce(f, lo) * {RUN.chunk} as ws, t0 + (coalesce(l, hi) + 1) * {RUN.chunk} as we, f is not null as any_good from cr left join be using (unit_id), bnd),
us as materialized (select s.* from spikes s join wn using (unit_id) where t between ws and we),
ui as (select *, t - lag(t) over (partition by unit_id order by t, spike_idx) as isi from us),
uu as (select unit_id, count(*) as n, (max(t) - min(t)) * 1.0e0 as dur from us group by unit_id),
uv as (select unit_id, tau_idx, tau_r, count(*) filter (where isi <= tau_r) as k from ui, taus group by all),
uh as (select unit_id, tau_idx, tau_r, {hill_sql('k', 'n', 'dur', f'(tau_r - {RUN.tau_c})')} as c from uu join uv using (unit_id)),
rpv as (select unit_id, min(c) as contamination, arg_min(tau_r, struct_pack(c := c, i := tau_idx)) as tau_r from uh group by unit_id),
pg as (select unit_id, ws, cast(ceil((we - ws) / {RUN.presence_bin}.0e0) - 1 as bigint) as nb from wn join uu using (unit_id)),
pc as (select unit_id, (t - ws) // {RUN.presence_bin} as bin, count(*) as n from us join pg using (unit_id) group by all),
pf as (select unit_id, bin, coalesce(n, 0) as n from (select unit_id, bin from pg, unnest(range(nb)) as g(bin)) left join pc using (unit_id, bin)),
pr as (select unit_id, avg(case when n > 0 and n >= 0.05 * p90 then 1.0e0 else 0.0e0 end) as presence_ratio from pf join (select unit_id, quantile_cont(n, 0.9) as p90 from pf group by unit_id) using (unit_id) group by unit_id),
{hist_sql('us', 'unit_id', 'u')}, {gaussian_sql('uhist', 'ukept', 'unit_id', 'u')}, {_SYM.replace('HIST', 'uhist')},
{SPIKE_TEMPLATES}, {POINTS.split(CT + ", ")[1]}, {exponential_sql()},
ptp as materialized (select tpl.template_id, wf from tpl join top on top.template_id = tpl.template_id and peak = channel), {shape_sql('ptp')},
allm as (select qn.unit_id, n0, uu.n as n1, ws, we, any_good, contamination, tau_r, presence_ratio, ugauss.missing_gaussian as percent_missing, missing_symmetric as percent_missing_symmetric, shape.* exclude (template_id, peak_places, trough_places), spatial_decay,
 list_max(list_transform(wf[1:10], lambda v: abs(v))) / list_max(list_transform(wf, lambda v: abs(v))) as baseline_flatness
 from qn left join uu using (unit_id) left join wn using (unit_id) left join rpv using (unit_id) left join pr using (unit_id) left join ugauss using (unit_id) left join missing using (unit_id)
 left join shape on shape.template_id = qn.unit_id left join expo on expo.template_id = qn.unit_id left join ptp on ptp.template_id = qn.unit_id),
met as (select unit_id, case when n0 >= {RUN_PARAMS.small_unit_spikes} then coalesce(n1, n0) else n0 end as n_spikes, {", ".join(f"case when n0 >= {RUN_PARAMS.small_unit_spikes} then {c} end as {n}" for c, n in (("ws", '"start"'), ("we", '"end"'), ("any_good", "any_good"), *zip(_COLUMNS, _COLUMNS, strict=True)))} from allm),
typ0 as (select *, case when n_spikes > 0 then case when n_peaks is null or {_any(_NOISE)} then 0 when {_SOMA} then 3 when {_any(_MUA)} then 2 else 1 end end as unit_type from met),
typed as materialized (select *, case unit_type when 0 then 'NOISE' when 1 then 'GOOD' when 2 then 'MUA' when 3 then 'NON-SOMA' else '' end as unit_type_string from typ0)"""


def typed_units(spark, d):
    return pipeline.unit_quality(rel.dense_spikes(spark, d), pipeline.cut_lineage(rel.spike_templates(spark, d)), rel.channels(spark), RUN_PARAMS, RUN, FS)


@query(f"""with {QUALITY} select unit_id, n_spikes, "start", "end", any_good, tau_r, n_peaks, n_troughs, {", ".join(f"round({c}, 3) as {c}" for c in _COLUMNS if c not in ("tau_r", "n_peaks", "n_troughs"))},
cast(unit_type as bigint) as unit_type, unit_type_string from typed""")
def unit_quality(spark, d):
    return r3(typed_units(spark, d).drop("peak_places", "trough_places"))


FAIL = f"""{QUALITY}, fails as (select unit_id, unit_type_string, {", ".join(f"unit_type_string = 'NOISE' and coalesce({v}, false) as fails_{k}" for k, v in _NOISE.items())},
 {", ".join(f"unit_type_string = 'MUA' and coalesce({v}, false) as fails_{k}" for k, v in _MUA.items())}, unit_type_string = 'NON-SOMA' and ({_SOMA}) as fails_somatic from typed)"""
_CRITERIA = [*_NOISE, *_MUA, "somatic"]


def failures(spark, d):
    return labels.failure_table(typed_units(spark, d), RUN_PARAMS)


@query(f"with {FAIL} select * from fails")
def qm_failure_table(spark, d):
    return failures(spark, d)


@query(f"with {FAIL} select array_to_string(list_sort(list_filter([{', '.join(f'case when fails_{k} then {chr(39)}{k}{chr(39)} end' for k in _CRITERIA)}], lambda x: x is not null)), ',') as failed, count(*) as n from fails group by all")
def upset_counts(spark, d):
    return summary.combinations(failures(spark, d))


@query(f"with {FAIL} " + " union all ".join(f"select '{k}' as criterion, cast(count(*) filter (where fails_{k}) as bigint) as n from fails" for k in _CRITERIA))
def criterion_totals(spark, d):
    return summary.criterion_totals(failures(spark, d))


_HISTED = ["n_spikes", "presence_ratio", "percent_missing", "duration_us", "baseline_flatness"]


@query(f"""with {QUALITY}, l as ({" union all ".join(f"select '{m}' as metric, cast({m} as double) as v from typed where {m} is not null" for m in _HISTED)}),
r as (select metric, min(v) as lo, max(v) as hi, count(*) as total from l group by metric having max(v) > min(v)),
c as (select metric, least(cast(floor((v - lo) * 40 / (hi - lo)) as bigint), 39) as bin, count(*) as n from l join r using (metric) group by all)
select metric, bin, round(lo + bin * (hi - lo) / 40, 6) as "left", coalesce(n, 0) as n, round(coalesce(n, 0) / total, 6) as share from (select * from r, unnest(range(40)) as g(bin)) left join c using (metric, bin)""")
def metric_histograms(spark, d):
    return r6(summary.metric_histograms(typed_units(spark, d), _HISTED))


@query("""with u as (select c_mktsegment as d, c_nationkey % 4 as l from customer), n as (select d, l, count(*) as n from u group by all), z as (select d, count(*) as size from u group by d),
g as (select z.d, size, x.l, coalesce(n, 0) as n from z cross join (select distinct l from u) x left join n on n.d = z.d and n.l = x.l)
select cast(l as bigint) as label, cast(sum(n) as bigint) as total, round(avg(n / size), 6) as mean_share, round(stddev_samp(n / size) / sqrt(count(*)), 6) as se, count(*) as n_datasets from g group by l""")
def dataset_proportions(spark, d):
    x = rel.table(spark, d, "customer").select("c_mktsegment", F.expr("c_nationkey % 4").alias("l"))
    return r6(summary.dataset_proportions(x, "c_mktsegment", "l"))


_STRIATUM = f"""case when duration_us is null or suppression_ms is null or prop_long is null then 'Unknown' when duration_us > {PHYSIOLOGY.template_duration_threshold} and suppression_ms < 40 then 'MSN'
 when duration_us <= {PHYSIOLOGY.template_duration_threshold} and prop_long <= 0.1 then 'FSI' when duration_us > {PHYSIOLOGY.template_duration_threshold} then 'TAN' else 'UIN' end"""


_ISI_PROPS = f"""x as (select unit_id, t, spike_idx, cast(isi as double) as isi, cast(lag(isi) over (partition by unit_id order by t, spike_idx) as double) as before from isi),
y as (select * from x where isi is not null), mu as (select unit_id, avg(isi) as mu from y group by unit_id),
ip as (select unit_id, count(*) as n_isi, avg(case when isi > {DAY} then 1.0e0 else 0.0e0 end) as prop_long, stddev_pop(isi) / nullif(avg(isi), 0) as cv, case when var_pop(isi) > 0 then avg((isi - mu) ** 3) / (var_pop(isi) ** 1.5) end as skew,
 avg(case when isi + before > 0 then 2 * abs(isi - before) / (isi + before) end) as cv2 from y join mu using (unit_id) group by unit_id)"""
_RATE_PROPS = """rp as (select unit_id, max(n_spikes) / (max(span) * 1e-6) as mean_rate, max(nb) as n_bins, stddev_pop(rate) as std_rate, var_pop(rate) / nullif(avg(rate), 0) as fano,
 quantile_cont(rate, 0.95) / nullif(quantile_cont(rate, 0.05), 0) as rate_ratio from rb group by unit_id)"""
_q = ACG_HALF // 5
_PHYS = f"""{ACG}, {ISI}, {RATES.replace(SP + ", ", "")}, {_ISI_PROPS}, {_RATE_PROPS}, {T1}, {feature_sql(_q, 2 * _q, _q, min(4 * _q, ACG_HALF), max(ACG_HALF // 2, 4), ACG_BIN / 1000)},
wd as (select template_id as unit_id, case when list_max(ab) > 0 then (list_position(w[p:], case when w[p] > 0 then list_min(w[p:]) else list_max(w[p:]) end) - 1) * 1e6 / 30000 end as duration_us
 from (select template_id, wf as w, list_transform(wf, lambda v: abs(v)) as ab, list_position(list_transform(wf, lambda v: abs(v)), list_max(list_transform(wf, lambda v: abs(v)))) as p from tpl)),
ph as (select k.unit_id, ip.* exclude (unit_id), rp.* exclude (unit_id), acgf.* exclude (unit_id), duration_us from (select unit_id from spikes group by unit_id having count(*) >= {PHYSIOLOGY.min_spikes}) k
 left join ip using (unit_id) left join rp using (unit_id) left join acgf using (unit_id) left join wd using (unit_id))"""
_THREE = ("prop_long", "cv", "skew", "cv2", "mean_rate", "std_rate", "fano", "rate_ratio", "suppression_ratio", "suppression_ms", "tau_rise_ms", "duration_us")


def properties(spark, d, region: str = "striatum"):
    return pipeline.physiology(rel.spikes(spark, d), rel.templates(spark, d), FS, PHYSIOLOGY, rel.TICK, ACG_BIN, ACG_WINDOW, DAY, DAY, region)


@query(f"""with {_PHYS} select unit_id, n_isi, n_bins, {", ".join(f"round({c}, 3) as {c}" for c in _THREE)}, round(tau_decay_ms, -3) as tau_decay_ms,
{_STRIATUM} as cell_type from ph""")
def physiology(spark, d):
    return r3(properties(spark, d).withColumn("tau_decay_ms", F.round("tau_decay_ms", -3)))


@query(f"with {_PHYS} select unit_id, {_STRIATUM} as cell_type from ph")
def cell_type_striatum(spark, d):
    return labels.cell_types(properties(spark, d), "striatum", PHYSIOLOGY)


@query(f"with {_PHYS} select unit_id, case when duration_us is null then 'Unknown' when duration_us > {PHYSIOLOGY.template_duration_threshold} then 'Wide-spiking' else 'Narrow-spiking' end as cell_type from ph")
def cell_type_cortex(spark, d):
    return labels.cell_types(properties(spark, d, "cortex"), "cortex", PHYSIOLOGY)


@query(f"with {_PHYS}, lc as (select {_STRIATUM} as label from ph) select label, count(*) as n, round(100.0e0 * count(*) / (select count(*) from lc), 6) as percent from lc group by label")
def cell_type_distribution(spark, d):
    return r6(labels.distribution(properties(spark, d), "cell_type"))


CUR = "cur as (select doc_id, case quality when 0 then 'Noise' when 1 then 'Good' else 'Unknown' end as manual, case when toxic = 1 then 'Noise' else 'Good' end as auto from labels)"


def curated(spark, d):
    return curation.joined(rel.manual_labels(spark, d), rel.auto_labels(spark, d))


@query(f"with {CUR} select coalesce(manual, 'All') as manual, coalesce(auto, 'All') as auto, count(*) as n from cur group by cube (manual, auto)")
def confusion_matrix(spark, d):
    return curation.confusion(curated(spark, d))


@query(f"""with {CUR}, c as (select distinct manual as class from cur union select distinct auto from cur), x as (select class, count(*) filter (where manual = class) as m, count(*) filter (where auto = class) as a, count(*) filter (where manual = class and auto = class) as b from c, cur group by class)
select class, m as n_manual, a as n_auto, b as n_both, round(b / nullif(a, 0), 6) as precision, round(b / nullif(m, 0), 6) as recall from x
union all select 'All', count(*), count(*), count(*) filter (where manual = auto), round(count(*) filter (where manual = auto) / nullif(count(*), 0), 6), round(count(*) filter (where manual = auto) / nullif(count(*), 0), 6) from cur""")
def concordance(spark, d):
    return r6(curation.concordance(curated(spark, d)))


@query(f"""with {QUALITY}, man as (select unit_id, case when unit_id % 3 = 0 then 'Noise' else 'Good' end as manual from typed),
aut as (select unit_id, case unit_type_string when 'NOISE' then 'Noise' when 'GOOD' then 'Good' when 'MUA' then 'MUA' when 'NON-SOMA' then 'Non-somatic' else unit_type_string end as auto, n_spikes, n_peaks from typed)
select unit_id, manual, auto, manual = auto as agree, n_spikes, n_peaks from man join aut using (unit_id)""")
def compared_labels(spark, d):
    m = typed_units(spark, d)
    manual = m.select("unit_id", F.when(F.col("unit_id") % 3 == 0, 0).otherwise(1).alias("manual_classification"))
    return r6(curation.compared(m, manual).select("unit_id", "manual", "auto", "agree", "n_spikes", "n_peaks"))


@query(f"with {CUR} select auto || ' -> ' || manual as change, count(*) as n from cur group by all")
def agreement_counts(spark, d):
    return curation.agreement_counts(curated(spark, d))


_SUG = [s for s in curation.SUGGESTED]


@query(f"""with {QUALITY}, man as (select unit_id, case when unit_id % 3 = 0 then 'Noise' else 'Good' end as manual from typed),
l as ({" union all ".join(f"select '{m}' as metric, '{dr}' as direction, cast({t} as double) as cur, manual, cast({m} as double) as v from typed join man using (unit_id) where {m} is not null" for m, dr, t in _SUG)}),
s as (select metric, direction, cur, min(v) filter (where manual = 'Good') as lg, min(v) filter (where manual = 'Noise') as ln_, max(v) filter (where manual = 'Noise') as mn from l group by all having lg is not null and ln_ is not null),
y as (select l.metric, l.direction, l.cur, case when l.direction = 'min' then lg else ln_ end as sug, mn,
 count(*) filter (where manual = 'Good' and case when l.direction = 'min' then v >= l.cur else v <= l.cur end) as g1, count(*) filter (where manual = 'Good' and case when l.direction = 'min' then v >= lg else v <= ln_ end) as g2 from l join s using (metric) group by all)
select metric, direction, cur as current, round(case when metric = 'n_peaks' and mn > 1 and cur > 1 then 1.0e0 else sug end, 6) as suggestion, g1 as good_now, g2 as good_then from y where (metric = 'n_peaks' and mn > 1 and cur > 1) or (cur > sug and g2 > g1)""")
def threshold_suggestions(spark, d):
    m = typed_units(spark, d)
    manual = m.select("unit_id", F.when(F.col("unit_id") % 3 == 0, 0).otherwise(1).alias("manual_classification"))
    return r6(curation.threshold_suggestions(m, manual))


@query("""with tpl as (select vec_id as template_id, i, cast(embedding[i] as double) as v from embeddings, unnest(range(1, 65)) as g(i)),
sp as (select distinct 100000 + user_id % 5 as unit_id, user_id % 40 as template_id from events union select distinct user_id % 40, user_id % 40 from events),
made as (select * from sp where unit_id not in (select template_id from tpl))
select template_id, i - 1 as sample, round(v, 6) as v from tpl union all select unit_id, i - 1, round(avg(v), 6) from made join tpl using (template_id) group by unit_id, i""")
def curation_merge_templates(spark, d):
    e = rel.table(spark, d, "events")
    t = (F.col("user_id") % 40).alias("template_id")
    s = e.select((100_000 + F.col("user_id") % 5).alias("unit_id"), t).unionByName(e.select((F.col("user_id") % 40).alias("unit_id"), t))
    return r6(curation.merged_templates(s, rel.templates(spark, d)).select("template_id", F.posexplode("wf").alias("sample", "v")))


@query(f"with {SP}, u as (select distinct unit_id from spikes) select u.unit_id, cast(coalesce(quality, -1) as bigint) as manual_classification from u left join labels on doc_id = u.unit_id")
def manual_default(spark, d):
    return r6(curation.default_manual(trains.spike_counts(rel.spikes(spark, d)), rel.manual_labels(spark, d)))


@query(f"with {QUALITY} select unit_id, min(h) over (order by unit_id rows between 1 following and unbounded following) as next_unit, max(h) over (order by unit_id rows between unbounded preceding and 1 preceding) as previous_unit, coalesce(min(h) over (order by unit_id rows between 1 following and unbounded following), min(h) over ()) as next_wrapped, coalesce(max(h) over (order by unit_id rows between unbounded preceding and 1 preceding), max(h) over ()) as previous_wrapped from (select unit_id, case when unit_type_string = 'NOISE' then unit_id end as h from typed)")
def next_unit_of_class(spark, d):
    return curation.neighbours_of_class(typed_units(spark, d), "NOISE")


@query(f"with {QUALITY} " + " union all ".join(f"select unit_id, '{m}' as metric, round(cast({m} as double), 6) as value from typed" for m in ("n_spikes", "contamination", "presence_ratio", "percent_missing")))
def metrics_long(spark, d):
    from ..sources.sinks import metric_rows

    return r6(metric_rows(typed_units(spark, d), ["n_spikes", "contamination", "presence_ratio", "percent_missing"]))
