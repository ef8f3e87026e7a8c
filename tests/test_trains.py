"""Closed forms, brute force and properties of the spike-train operators."""

import itertools
import json
import math
import random
from decimal import Decimal
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from spikeloom import params
from spikeloom.functions import fits
from spikeloom.operators import amplitude, correlogram, curation, duplicates, features, labels, ranks, refractory, summary, trains, waveform
from spikeloom.params import PhysiologyParams, QualityParams, spike_width_samples
from spikeloom.plans import catalog, pipeline
from spikeloom.sources import recording, sinks, sorter

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def train(spark):
    rng = random.Random(1)
    rows = [(u, i * 10 + u, rng.randrange(5000), rng.gauss(10, 2)) for u in range(3) for i in range(120)]
    return rows, spark.createDataFrame(rows, "unit_id long, spike_idx long, t long, amplitude double")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_sql_twin(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    cur = con.execute(catalog.ORACLE[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    key = lambda r: tuple(map(str, r))
    got = sorted((tuple(r) for r in df.select(*names).collect()), key=key)
    for a, b in zip(got, sorted(cur.fetchall(), key=key), strict=True):
        assert all(x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) < 2e-6 * max(1, abs(x))) for x, y in zip(a, b, strict=True)), (a, b)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_hill(spark):
    f = lambda n, s, d, w: spark.range(1).select(refractory.hill(F.lit(n), F.lit(s), F.lit(d), F.lit(w)).alias("x")).first().x
    assert f(0, 100, 10.0, 0.002) == 0 and f(5, 3, 1e6, 0.002) == 1
    k = 2 * 0.002 * 1000 * 1000
    assert abs(f(3, 1000, 100.0, 0.002) - (1 - math.sqrt(1 - 4 * 3 * 100 / k)) / 2) < 1e-12
    assert f(50, 100, 1000.0, 0.002) == 1  # no real root, the fallback is over 1


def test_pairs_equal_brute_force(train):
    rows, df = train
    got = {(r.idx_a, r.idx_b) for r in correlogram.band_pairs(df, 40).collect()}
    want = set()
    for a, b in itertools.combinations(rows, 2):
        if a[0] == b[0] and abs(a[2] - b[2]) <= 40:
            x, y = sorted((a, b), key=lambda r: (r[2], r[1]))
            want.add((x[1], y[1]))
    assert got == want
    acg = {(r.unit_id, r.lag_bin): r.n for r in correlogram.autocorrelogram(df, 10, 200).collect()}
    assert all(acg[u, -b] == n for (u, b), n in acg.items()) and not any(b == 0 for _, b in acg)


@pytest.mark.parametrize("size", [1, 2, 7, 10**6])
def test_previous_spikes_and_ranks_over_buckets(spark, train, size):
    """Whatever the size of a bucket, also with one spike a bucket, equal times and a second key."""
    rows, df = train
    extra = [(9, 9000 + i, t, 1.0) for i, t in enumerate([5, 5, 5, 4000, 4000])]
    df = df.select("unit_id", "spike_idx", "t", "amplitude").unionByName(spark.createDataFrame(extra, "unit_id long, spike_idx long, t long, amplitude double"))
    data = [tuple(r)[:3] for r in df.collect()]
    got = {r.spike_idx: (r.t1, r.t2) for r in ranks.with_previous(df, bucket_spikes=size).collect()}
    ranked = {r.spike_idx: (r["rank"], r.n) for r in ranks.with_rank(df, bucket_spikes=size).collect()}
    parted = {r.spike_idx: r.t1 for r in ranks.with_previous(df.withColumn("k", F.col("spike_idx") % 2), "k", bucket_spikes=size).collect()}
    for u in {r[0] for r in data}:
        own = sorted((t, i) for v, i, t in data if v == u)
        for k, (_, i) in enumerate(own):
            assert got[i] == (own[k - 1][0] if k else None, own[k - 2][0] if k > 1 else None) and ranked[i] == (k, len(own))
        for odd in (0, 1):
            half = [(t, i) for t, i in own if i % 2 == odd]
            assert all(parted[i] == (half[k - 1][0] if k else None) for k, (_, i) in enumerate(half))


@pytest.mark.parametrize("bins", [1, 3, 1024])
def test_exact_percentiles_by_bins(spark, bins):
    rng = np.random.default_rng(7)
    groups = {1: rng.normal(0, 1, 501), 2: np.array([3.0] * 40), 3: np.array([1.0, 2.0]), 4: np.concatenate([np.zeros(90), [1e9]]), 5: np.array([5.0])}
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs] + [(1, None), (6, None)], "unit_id long, v double")
    got = {r.unit_id: r for r in ranks.percentiles(df, ["unit_id"], "v", {"lo": 0.01, "mid": 0.5, "hi": 0.99}, bins).collect()}
    assert got.keys() == groups.keys()
    for g, vs in groups.items():
        assert got[g].n == len(vs) and np.allclose([got[g].lo, got[g].mid, got[g].hi], np.percentile(vs, [1, 50, 99]))


def test_result_does_not_depend_on_partitions(train):
    _, df = train
    a = sorted(map(tuple, catalog.r6(trains.interval_properties(df, 50)).collect()))
    assert a == sorted(map(tuple, catalog.r6(trains.interval_properties(df.repartition(7).orderBy(F.rand(3)), 50)).collect()))


def test_greedy_and_set_removal_agree_on_pairs(spark):
    rows = [(0, 1, 0, 10, 5.0), (0, 1, 1, 11, 6.0), (0, 2, 2, 100, 5.0), (0, 1, 3, 101, 1.0), (1, 2, 4, 10, 5.0), (0, 1, 5, 300, 1.0)]
    df = spark.createDataFrame([(u, i, t, a, c) for c, u, i, t, a in rows], "unit_id long, spike_idx long, t long, amplitude double, channel long")
    kept = {r.spike_idx for r in duplicates.without_duplicates(df, 2).collect()}
    gone = {r.spike_idx for r in duplicates.greedy_losers(df, 2).collect()}
    # unit 1 has four spikes, unit 2 two: of 2 and 3, unit 2's goes
    assert kept == {1, 3, 4, 5} and gone == {0, 2}


def test_spike_of_the_smaller_unit_goes(spark):
    """Units of three spikes and of one at the same time: the lone spike goes; of equal units the later one."""
    for rows, lost in (([(7, 0, 10), (7, 1, 500), (7, 2, 900), (8, 3, 10)], {3}), ([(8, 0, 10), (7, 1, 10), (7, 2, 500)], {0}), ([(7, 0, 10), (8, 1, 11)], {1})):
        df = spark.createDataFrame([(u, i, t, 1.0, 0) for u, i, t in rows], "unit_id long, spike_idx long, t long, amplitude double, channel long")
        assert {r.spike_idx for r in duplicates.greedy_losers(df, 2).collect()} == lost
        assert {r.spike_idx for r in duplicates.without_duplicates(df, 2).collect()} == {i for _, i, _ in rows} - lost


def test_windows_need_both_criteria(spark):
    """A unit of which one chunk is contaminated and another cut off keeps the run of chunks that are neither."""
    rng = random.Random(4)
    rows, k = [], 0
    for chunk in range(6):
        for i in range(400):
            t = chunk * 100_000 + i * 250 + rng.randrange(60)
            a = rng.gauss(50, 8)
            if chunk == 0:  # cut off at its mode
                a = 50 + abs(a - 50)
            rows.append((1, k, t, a, 0))
            k += 1
            if chunk == 3 and i % 2:  # many short intervals
                rows.append((1, k, t + 3, a, 0))
                k += 1
    df = spark.createDataFrame([*rows, (2, k, 0, 1.0, 0), (2, k + 1, 600_001, 1.0, 0)], "unit_id long, spike_idx long, t long, amplitude double, channel long")
    p = params.QualityParams(max_rpv=0.1, max_perc_missing=30.0)
    w = {r.unit_id: (r.start, r.end, r.any_good) for r in pipeline.good_windows(df, p, params.Ticks(1e-4, (20, 40), 1, 100_000, 10_000)).collect()}
    assert w == {1: (400_000, 600_000, True)} or w == {1: (100_000, 300_000, True)}


def test_linear_decay_has_its_own_bound(spark):
    df = spark.createDataFrame([(1, -0.02), (2, -0.001), (3, 0.5)], "unit_id long, spatial_decay double").selectExpr("*", *[f"cast(0 as double) as {c}" for c in ("n_peaks", "n_troughs", "baseline_flatness", "second_peak_to_trough")], "500.0 as duration_us")
    for linear, want in ((True, [1]), (False, [1, 2, 3])):
        rule = labels.noise_rules(df, params.QualityParams(linear_decay=linear))["spatial_decay"]
        assert [r.unit_id for r in df.filter(rule).orderBy("unit_id").collect()] == want


def test_refractory_methods(spark, train):
    _, df = train
    for method in ("hill", "llobet", "ibl"):
        got = refractory.estimate(df, method, [10, 20], 1, 1.0).collect()
        assert len(got) == 3 and all(r.contamination is None or 0 <= r.contamination <= 1 for r in got)
    with pytest.raises(ValueError, match="unknown"):
        refractory.estimate(df, "other", [10], 1, 1.0)


def test_batched_gaussians_equal_single_ones():
    rng = np.random.default_rng(5)
    hists = [np.histogram(rng.normal(m, s, 500), 50) for m, s in ((0, 1), (5, 2), (9, 0.1))]
    stats = [(float(np.dot(n, e[:-1]) / n.sum()), float(e[3])) for n, e in hists]
    args = [(n, e[:-1], e[1] - e[0], sd or 1.0, low) for (n, e), (sd, low) in zip(hists, stats, strict=True)]
    both = fits.cut_gaussians_missing(*[np.array([a[i] for a in args]) for i in range(5)])
    assert all(abs(fits.cut_gaussian_missing(*a) - b) < 1e-9 or math.isnan(b) for a, b in zip(args, both, strict=True))


def test_missing_gaussian_recovers_cut():
    rng = np.random.default_rng(2)
    for cut, want in ((-1.0, 15.9), (0.0, 50.0)):
        x = rng.normal(0, 1, 60_000)
        x = x[x > cut]
        n, e = np.histogram(x, 50)
        got = fits.cut_gaussian_missing(n, e[:-1], e[1] - e[0], x.std(), np.percentile(x, 1))
        assert abs(got - want) < 6


def test_peaks_by_definition():
    w = np.array([0, 1, 0, 3, 3, 0.5, 2, 0, 0], float)
    places, prom, width = fits.peaks(w, 0)
    assert places == [1, 3, 6] and prom == [1, 3, 1.5] and abs(width[1] - (4.6 - 2.5)) < 0.2
    assert fits.peaks(w, 2)[0] == [3]


def test_shape_of_a_spike():
    t = np.arange(64)
    w = -np.exp(-((t - 30) ** 2) / 8) + 0.4 * np.exp(-((t - 42) ** 2) / 30)
    s = fits.shape(w, 30000)
    assert s["n_troughs"] == 1 and s["n_peaks"] == 1 and s["trough_places"] == [30] and abs(s["duration_us"] - 400) < 40
    assert fits.shape(np.zeros(64), 30000) is None


def test_exponential_slope():
    x = np.arange(0, 100, 10.0)
    assert abs(fits.exponential_slope(x, np.exp(-0.03 * x)) - 0.03) < 1e-4


def test_chi2_tail(spark):
    row = spark.range(1).select(features.chi2_tail(F.lit(0.0), 12).alias("a"), features.chi2_tail(F.lit(1000.0), 12).alias("b"), features.chi2_tail(F.lit(21.026), 12).alias("c")).first()
    assert row.a == 1 and row.b < 1e-100 and abs(row.c - 0.05) < 1e-4


def test_isolation_equals_numpy(spark):
    rng = np.random.default_rng(3)
    data = [(u, i + 1000 * u, rng.normal(u, 1, 4).tolist()) for u, n in ((0, 40), (1, 90), (2, 30)) for i in range(n)]
    df = spark.createDataFrame(data, "unit_id long, spike_idx long, f array<double>")
    ch = spark.createDataFrame([(0, 5, [5, 6]), (1, 5, [5]), (2, 6, [6])], "unit_id long, first_channel long, channels array<long>")
    got = {r.unit_id: r for r in features.isolation(df, ch, 4).collect()}
    own, other = (np.array([f for u, _, f in data if u == k]) for k in (0, 1))
    inv = np.linalg.inv(np.cov(own.T) + 1e-10 * np.eye(4))
    d = np.sort(np.einsum("ij,jk,ik->i", other - own.mean(0), inv, other - own.mean(0)))
    assert abs(got[0].isolation_distance - d[40]) < 1e-6 and got[0].n_other == 90


def test_isolation_gathers_by_channel(spark):
    rng = np.random.default_rng(4)
    chans = {0: [0, 1], 1: [2, 0], 2: [1, 0], 3: [5, 6]}
    data = [(u, i + 1000 * u, rng.normal(u, 1, 4).tolist()) for u, n in ((0, 40), (1, 35), (2, 30), (3, 50)) for i in range(n)]
    df = spark.createDataFrame(data, "unit_id long, spike_idx long, f array<double>")
    ch = spark.createDataFrame([(u, c[0], c) for u, c in chans.items()], "unit_id long, first_channel long, channels array<long>")
    own = np.array([f for u, _, f in data if u == 0])
    other = np.array([[x for c in chans[0] for x in (f[2 * chans[u].index(c) :][:2] if c in chans[u] else [0, 0])] for u, _, f in data if u in (1, 2)])
    inv = np.linalg.inv(np.cov(own.T) + 1e-10 * np.eye(4))
    d = np.sort(np.einsum("ij,jk,ik->i", other - own.mean(0), inv, other - own.mean(0)))
    got = {r.unit_id: r for r in features.isolation(df, ch, 4, 2).collect()}[0]
    assert got.n_other == 65 and abs(got.isolation_distance - d[40]) < 1e-6
    assert abs(got.l_ratio - float(np.sum(np.exp(-d / 2) * (1 + d / 2))) / 40) < 1e-9
    ratio = {r.unit_id: r.silhouette for r in features.silhouette_ratio(df, ch, 4, 2).collect()}[0]
    assert abs(ratio - d.mean() / (4 * 39 / 40)) < 1e-6


def test_labels_with_nulls(spark):
    cols = "unit_id long, n_spikes long, n_peaks int, n_troughs int, duration_us double, baseline_flatness double, second_peak_to_trough double, percent_missing double, contamination double, presence_ratio double, trough_to_peak2 double, peak_before_width double, trough_width double, peak1_to_peak2 double, main_peak_to_trough double"
    base = [1, 500, 1, 1, 500.0, 0.1, 0.2, 5.0, 0.01, 0.9, 9.0, 9.0, 9.0, 1.0, 0.2]
    cases = {(): "GOOD", ((2, None),): "NOISE", ((2, 3),): "NOISE", ((1, 100),): "MUA", ((8, 0.5),): "MUA", ((14, 0.9),): "NON-SOMA", ((14, 0.9), (1, 10)): "NON-SOMA", ((1, 0), (2, None)): ""}
    for i in range(4, 15):
        cases[((i, None),)] = "GOOD"
    rows = []
    for k, change in enumerate(cases):
        r = [k, *base[1:]]
        for i, v in change:
            r[i] = v
        rows.append(tuple(r))
    got = {r.unit_id: r.unit_type_string for r in labels.unit_types(spark.createDataFrame(rows, cols), QualityParams()).collect()}
    assert [got[k] for k in range(len(cases))] == list(cases.values())


def test_cell_types(spark):
    df = spark.createDataFrame([(0, 500.0, 10.0, 0.5), (1, 300.0, 10.0, 0.05), (2, 500.0, 50.0, 0.5), (3, 300.0, 10.0, 0.5), (4, None, 1.0, 1.0)], "unit_id long, duration_us double, suppression_ms double, prop_long double")
    assert [r.cell_type for r in labels.cell_types(df, "striatum").orderBy("unit_id").collect()] == ["MSN", "FSI", "TAN", "UIN", "Unknown"]
    assert labels.cell_types(df, "moon").filter("cell_type is not null").count() == 0


def test_sorter_source(spark, tmp_path):
    rng = np.random.default_rng(4)
    n, t, c = 50, 20, 6
    np.save(tmp_path / "spike_times.npy", np.sort(rng.integers(0, 10_000, n)))
    np.save(tmp_path / "spike_templates.npy", rng.integers(0, 3, n))
    np.save(tmp_path / "amplitudes.npy", rng.random(n))
    w, inv = rng.random((3, t, c)), rng.random((c, c))
    np.save(tmp_path / "templates.npy", w)
    np.save(tmp_path / "whitening_mat_inv.npy", inv)
    np.save(tmp_path / "channel_positions.npy", rng.random((c, 2)))
    spark.dataSource.register(sorter.SorterSource)
    read = lambda name: spark.read.format("sorter").option("table", name).option("rows_per_partition", 7).load(str(tmp_path))
    spikes = read("spikes").orderBy("spike_idx").collect()
    assert len(spikes) == n and [r.t for r in spikes] == np.load(tmp_path / "spike_times.npy").tolist() and all(r.unit_id == r.template_id for r in spikes)
    got = {(r.template_id, r.channel): r.wf for r in read("templates").collect()}
    assert np.allclose(got[2, 4], (w[2] @ inv)[:, 4]) and read("channels").count() == c
    assert read("pc_features").count() == 0


def test_raw_and_compressed(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = rng.integers(-500, 500, (2000, 4)).astype(np.int16)
    x.tofile(tmp_path / "r.bin")
    s = recording.usable(spark.createDataFrame([(0, 0, 5), (0, 1, 500), (1, 2, 900), (1, 3, 1999)], "unit_id long, spike_idx long, t long"), 2000, 41)
    snippets = recording.raw_snippets(s, str(tmp_path / "r.bin"), 4, 41, [0, 2])
    got = {(r.spike_idx, r.channel): r.wf for r in snippets.collect()}
    assert sorted(got) == [(1, 0), (1, 2), (2, 0), (2, 2)] and got[1, 2] == x[480:521, 2].astype(float).tolist()
    mean = amplitude.mean_waveforms(snippets, 10).filter("unit_id = 0 and channel = 0").first().wf
    assert np.allclose(mean, x[480:521, 0] - x[480:490, 0].mean())
    assert amplitude.half_medians(snippets, 10).count() == 8 - 4
    parts = [recording.encode_chunk(x[a : a + 700]) for a in range(0, 2000, 700)]
    (tmp_path / "r.cbin").write_bytes(b"".join(parts))
    header = {"chunk_bounds": [0, 700, 1400, 2000], "chunk_offsets": [0, *np.cumsum([len(p) for p in parts]).tolist()]}
    out = recording.decompressed(recording.chunk_table(spark, header), str(tmp_path / "r.cbin"), 4, [3]).orderBy("chunk").collect()
    assert sum((r.samples for r in out), []) == x[:, 3].tolist()


def test_metadata():
    m = recording.parse_meta("~imroTbl=(0,2)(0 0 0 500 250 1)(1 0 0 1000 125 1)\ntypeThis=imec\nimAiRangeMax=0.6\nimSampRate=30000\nsnsApLfSy=384,384,1\nsnsSaveChanSubset=0:2,5\n")
    assert recording.sync_channels(m) == 1 and recording.sample_rate(m) == 30000 and recording.saved_channels(m) == [0, 1, 2, 5] and recording.channel_gains(m)[1] == (1000.0, 125.0)
    assert abs(recording.microvolts_per_bit(m) - 0.6e6 / 512 / 500) < 1e-12 and recording.parse_meta(recording.render_meta(m)) == m
    assert recording.microvolts_per_bit({"imDatPrb_type": "24", "imAiRangeMax": "0.5"}) == 0.5e6 / 2048 / 80
    assert recording.parse_oebin(json.dumps({"continuous": [{"folder_name": "Probe-AP/", "sample_rate": 30000, "num_channels": 3, "channels": [{"channel_name": "CH1", "bit_volts": 0.195}, {"channel_name": "ADC1", "bit_volts": 1}]}]}))["n_neural"] == 1
    assert recording.find_recording(["a.lf.bin", "a.ap.cbin"]) == "a.ap.cbin" and recording.parse_file_name("x/run_g0_t1.imec0.ap.bin") == {"run": "run", "gate": "0", "trigger": "1", "stream": "imec0.ap"}
    assert recording.digital_lines(np.array([5]), [0, 1, 2]).ravel().tolist() == [1, 0, 1] and spike_width_samples(2.0, 30000) == 61


def test_sinks_round_trip(spark, tmp_path):
    m = common_cut(catalog.typed_units(spark, SF), tmp_path)
    at = "file://" + str(tmp_path)
    sinks.save_results(m, catalog.RUN_PARAMS, at)
    back, saved = sinks.load_results(spark, at)
    assert sorted(map(str, back.drop("empty_unit").collect())) == sorted(map(str, m.collect()))
    assert saved["max_rpv"] == 0.5 and saved["rpv_method"] == "hill" and saved["use_raw"] is False and "tau_r" not in saved
    assert (tmp_path / "cluster_n_spikes.tsv").read_text().splitlines()[0] == "cluster_id\tn_spikes" and (tmp_path / "cluster_bc_unitType.tsv").is_file() and (tmp_path / "metrics.csv").is_file()
    assert sinks.load_tsv(spark, at, "n_spikes").agg(F.sum("n_spikes")).first()[0] == m.agg(F.sum("n_spikes")).first()[0]
    assert sinks.missing_metrics(m, ["n_spikes", "nope"]) == ["nope"]
    lab = spark.createDataFrame([(1, 0), (2, -1)], "unit_id long, manual_classification int")
    sinks.save_manual_labels(lab, at + "/manual")
    assert sorted(map(tuple, sinks.load_manual_labels(spark, at + "/manual").collect())) == [(1, 0), (2, -1)]
    whole = sinks.all_templates(m, spark.createDataFrame([(0,), (10_000,)], "template_id long"))
    assert {r.unit_id: r.empty_unit for r in whole.collect()} == {0: False, 10_000: True}
    sinks.save_matlab(m, catalog.RUN_PARAMS, at + "/ml")
    old = {r.unit_id: r for r in sinks.load_matlab(spark, at + "/ml").collect()}
    for r in m.collect():
        early = all(x is not None for x in (r.trough_to_peak2, r.peak_before_width, r.trough_width)) and r.trough_to_peak2 < 5 and r.peak_before_width < 4 and r.trough_width < 5
        assert old[r.unit_id].n_spikes == r.n_spikes and old[r.unit_id].peak1_to_peak2 == (r.peak1_to_peak2 if early else 0)
    with pytest.raises(ValueError, match="no metric files"):
        sinks.load_matlab(spark, at + "/manual")
    found = curation.compare(m, m.select("unit_id", F.lit(1).alias("manual_classification")))
    assert found["compared"].count() == m.count() and "Overall concordance" in curation.report(found)
    sinks.save_comparison(found["compared"].select("unit_id", "manual", "auto", "agree"), at + "/comparison.csv")
    assert len((tmp_path / "comparison.csv").read_text().splitlines()) == m.count() + 1
    text = summary.methods_text(catalog.RUN_PARAMS, m)
    sinks.save_text(spark, text, at + "/methods.txt")
    assert (tmp_path / "methods.txt").read_text() == text and f"{m.count()} units" in summary.unit_report(m, catalog.RUN_PARAMS)


def common_cut(df, tmp_path):
    df.write.parquet(f"file://{tmp_path}/typed")
    return df.sparkSession.read.parquet(f"file://{tmp_path}/typed")


def test_other_sinks(spark, tmp_path):
    at = "file://" + str(tmp_path)
    units = spark.createDataFrame([(1,), (2,)], "unit_id long")
    waves = spark.createDataFrame([(1, 0, [1.0, 2.0])], "unit_id long, channel int, wf array<double>")
    sinks.save_raw_waveforms(None, at)
    waves.withColumnRenamed("unit_id", "unit").write.partitionBy("unit").parquet(at + "/raw_waveforms_by_unit")
    for _ in range(2):  # the older layout, then the newer
        assert {r.unit_id: r.wf for r in sinks.load_raw_waveforms(spark, at, units).collect()} == {1: [1.0, 2.0], 2: None}
        sinks.save_raw_waveforms(waves, at)
    sinks.save_properties(units, PhysiologyParams(), at)
    props, params_ = sinks.load_properties(spark, at)
    assert props.count() == 2 and params_["min_spikes"] == 100
    spikes = spark.createDataFrame([(7,), (8,)], "spike_idx long")
    sinks.save_duplicate_mask(spikes, spark.createDataFrame([(8,), (8,)], "spike_idx long"), at)
    assert sorted(map(tuple, sinks.load_duplicate_mask(spark, at).collect())) == [(7, False), (8, True)]
    sinks.save_display_tables({"a": units, "b": waves}, at)
    assert sinks.load_display_tables(spark, at, ["a", "b"])["b"].count() == 1
    sinks.save_tau_table(units, at)


def test_streaming_late_spikes(spark, tmp_path):
    """A spike behind a later one is sorted in within the bound, and dropped beyond it."""
    from spikeloom.streaming import live

    batches, schema = [[1000], [10], [940], [1100, 1005], [1102]], "unit_id long, t long"
    for late, want in ((100, (5, 2, 1)), (0, (4, 2, 2))):  # within a batch spikes are sorted at any bound
        src = f"{tmp_path}/in{late}"
        for ts in batches:
            spark.createDataFrame([(1, t) for t in ts], schema).coalesce(1).write.mode("append").parquet(src)
            found = live.running_violations(spark.readStream.schema(schema).parquet(src), 5, late)
            sink = found.writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/c{late}").trigger(availableNow=True)
            sink.foreachBatch(lambda df, _, k=late: df.write.mode("overwrite").parquet(f"{tmp_path}/out{k}")).start().awaitTermination()
        r = spark.read.parquet(f"{tmp_path}/out{late}").first()
        assert (r.n_spikes, r.n_violations, r.n_dropped) == want


def test_recording_gains_and_trims(spark, tmp_path):
    meta = {"typeThis": "imec", "imDatPrb_type": "1110", "imAiRangeMax": "0.5", "imMaxInt": "512", "imroTbl": "(1110,2,0,500,250)(0 0 0)(1 0 0)", "acqApLfSy": "2,2,1", "nSavedChans": "5"}
    assert recording.channel_gains(meta) == {0: (500.0, 250.0), 1: (500.0, 250.0)}
    v = 0.5 / 512
    assert np.allclose(recording.gain_corrected(np.ones((1, 5)), [0, 1, 2, 3, 4], meta), [[v / 500, v / 500, v / 250, v / 250, 1]])
    ni = {"typeThis": "nidq", "niAiRangeMax": "5", "niMaxInt": "32768", "snsMnMaXaDw": "1,1,1,1", "niMNGain": "200", "niMAGain": "2"}
    w = 5 / 32768
    assert np.allclose(recording.gain_corrected(np.ones((1, 4)), [0, 1, 2, 3], ni), [[w / 200, w / 2, w, 1]])
    assert np.allclose(recording.gain_corrected(np.ones((1, 1)), [0], {"typeThis": "obx", "obAiRangeMax": "5", "obMaxInt": "32768"}), [[w]])
    assert recording.channels_of_file(2 * 385 * 10, 385) == 385 and recording.channels_of_file(2 * 384 * 7, 385, 384) == 384
    with pytest.raises(ValueError, match="whole number"):
        recording.channels_of_file(7, 385, 384)
    x = np.arange(60, dtype=np.int16).reshape(30, 2)
    parts = [recording.encode_chunk(x[a : a + 10]) for a in (0, 10, 20)]
    path = tmp_path / "a.cbin"
    path.write_bytes(b"".join(parts))
    header = {"chunk_bounds": [0, 10, 20, 30], "chunk_offsets": np.cumsum([0, *map(len, parts)]).tolist()}
    for where in (str(path), f"file://{path}"):
        got = recording.decompressed(recording.chunk_table(spark, header), where, 2, [1], 5, 23).orderBy("first_sample").collect()
        assert [r.first_sample for r in got] == [5, 10, 20] and [v for r in got for v in r.samples] == x[5:23, 1].tolist()
    assert recording.decompress_to_file(header, str(path), str(tmp_path / "a.bin"), 2) == 30 and (recording.read_samples(str(tmp_path / "a.bin"), 2, 3, 4) == x[3:7]).all()
    ch = spark.createDataFrame([(0, 9), (1, 4)], "channel int, hw_channel int")
    v = spark.createDataFrame([(4, 1.0), (9, 2.0), (5, 3.0)], "channel int, v double")
    assert sorted(map(tuple, recording.by_site(v, ch).collect())) == [(0, 2.0), (1, 1.0)]
    assert sorted(map(tuple, recording.by_hardware(recording.by_site(v, ch), ch).collect())) == [(4, 1.0), (9, 2.0)]
    four = recording.named_probe(spark, "np2_four_shank")
    assert four.count() == 384 and four.select("x_um", "y_um").distinct().count() == 384 and recording.named_probe(spark, "np1").filter("channel = 2").first().x_um == 59.0


def test_histograms_of_counts(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (3, 4.0), (None, 9.0)], "n_peaks int, duration_us double")
    got = summary.metric_histograms(df, ["n_peaks", "duration_us"], own={"duration_us": 4}, whole=("n_peaks",)).collect()
    assert sorted((r.left, r.n) for r in got if r.metric == "n_peaks") == [(1.0, 2), (2.0, 0), (3.0, 1)]
    assert sorted((r.left, r.n) for r in got if r.metric == "duration_us") == [(1.0, 2), (3.0, 1), (5.0, 0), (7.0, 1)]
    assert sorted(map(tuple, labels.distribution(df.selectExpr("cast(n_peaks as string) as l"), "l", ["1", "7"]).collect()), key=str) == sorted([("1", 2, 50.0), ("3", 1, 25.0), (None, 1, 25.0), ("7", 0, 0.0)], key=str)


def test_streaming(spark, tmp_path):
    from spikeloom.streaming import live

    src = str(tmp_path / "in")
    rows = spark.createDataFrame([(1, 0), (1, 30), (1, 200), (2, 10)], "unit_id long, t long").select("unit_id", "t", F.timestamp_seconds("t").alias("ts"))
    rows.write.parquet(src)
    stream = spark.readStream.schema(rows.schema).parquet(src)
    for name, df, mode in (("p", live.presence_counts(stream, "60 seconds", "10 seconds"), "complete"), ("b", live.bursts(stream, "60 seconds", "10 seconds"), "complete"), ("v", live.running_violations(stream, 50), "update")):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
    assert spark.table("p").count() == 3 and spark.table("b").count() == 3
    assert {(r.unit_id, r.n_spikes, r.n_violations) for r in spark.table("v").collect()} == {(1, 3, 1), (2, 1, 0)}


def test_geometry_and_params(spark):
    assert recording.probe_layout(spark).count() == 384 and PhysiologyParams().min_spikes == 100
    assert curation.MANUAL[-1] == "Unknown"


@pytest.fixture(scope="module")
def crossed(spark):
    """Spikes with ties, repeated indices and nulls, and the counts of all pairs of units by brute force."""
    rng = random.Random(3)
    rows = [(rng.choice([None, 1, 2, 3, 4, 5, 5, 5, 5, 5]), rng.randrange(150), rng.choice([None, *range(60), *range(60)])) for _ in range(200)]
    return rows, spark.createDataFrame(rows, "unit_id long, spike_idx long, t long")


SIZES = [{}, {"block_spikes": 20}, {"hot_spikes": 60}, {"hot_spikes": 10}]


def shuffles_pairs(df):
    """Whether anything is shuffled by pairs of units."""
    return any("hashpartitioning" in line and "unit_" in line for line in df._jdf.queryExecution().toString().splitlines())


@pytest.mark.parametrize("sizes", SIZES)
def test_crosscorrelogram_blocks(crossed, sizes):
    rows, df = crossed
    one = {}
    for (i, x, t), (j, y, u) in itertools.product(rows, rows):
        if None not in (t, u) and (u > t or (u == t and y > x)) and (u - t) // 3 <= 5:
            one[i, j, (u - t) // 3] = one.get((i, j, (u - t) // 3), 0) + 1
    both = {}
    for (i, j, lag), n in one.items():
        for k in ((i, j, lag), (j, i, -lag)):
            if lag or (i != j and None not in k):
                both[k] = max(both.get(k, 0), n)
    out = correlogram.crosscorrelogram(df, 3, 30, **sizes)
    got = [((r.unit_i, r.unit_j, r.lag_bin), r.n) for r in out.collect()]
    assert len(got) == len(both) and dict(got) == both
    assert "hot_spikes" in sizes or not shuffles_pairs(out)


@pytest.mark.parametrize("sizes", SIZES)
def test_rounded_crosscorrelogram_blocks(crossed, sizes):
    rows, df = crossed
    sums, size = {}, {}
    for i, x, t in rows:
        size[i] = size.get(i, 0) + 1
        for j, y, u in rows:
            if None not in (i, t, u) and x != y and abs(u - t) <= 22 and abs(lag := math.floor(0.5 + (u - t) / 4)) <= 5:
                sums[i, j, lag] = sums.get((i, j, lag), 0) + 1
    out = correlogram.rounded_crosscorrelogram(df, 4, 5, rate=True, tick=0.5, **sizes)
    got = [((r.unit_i, r.unit_j, r.lag_bin), (r.n, r.rate)) for r in out.collect()]
    assert len(got) == len(sums) and dict(got) == {k: (n, n / (size[k[0]] * 4 * 0.5)) for k, n in sums.items()}
    assert "hot_spikes" in sizes or not shuffles_pairs(out)


def test_crosscorrelogram_blocks_are_shuffled_once(spark, crossed):
    """Blocks meet in a Cartesian product, so that spikes aren't copied for each block, and rows come in runs of n, unit_i, lag."""
    _, df = crossed
    df = df.filter("unit_id is not null")
    for out in (correlogram.crosscorrelogram(df, 3, 30, block_spikes=20), correlogram.rounded_crosscorrelogram(df, 4, 5, rate=True, block_spikes=20)):
        plan = out._jdf.queryExecution().toString()
        assert "CartesianProduct" in plan and "explode" not in plan
        parts = {}
        for r in out.withColumn("part", F.spark_partition_id()).collect():
            parts.setdefault(r.part, []).append(r)
        assert len(parts) > 4
        for rows in parts.values():  # few enough to be counted at once; counts from 255 on are not told apart
            for key in (lambda r: min(r.n, 255), lambda r: (min(r.n, 255), r.unit_i, r.lag_bin)):
                assert sum(key(a) != key(b) for a, b in itertools.pairwise(rows)) == len(set(map(key, rows))) - 1


def test_crosscorrelogram_rows_leave_python_as_runs(spark, crossed):
    """Of equal n, unit_i and lag one row with a list of unit_j comes from Python; the rate is taken once a run, before it is unfolded."""
    _, df = crossed
    for out in (correlogram.crosscorrelogram(df, 3, 30, block_spikes=20), correlogram.rounded_crosscorrelogram(df, 4, 5, rate=True, block_spikes=20)):
        plan = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
        at = {k: next(n for n, line in enumerate(plan) if k in line) for k in ("Generate inline", "MapInArrow")}
        assert at["Generate inline"] < at["MapInArrow"]  # parents come first
    assert at["Generate inline"] < next(n for n, line in enumerate(plan) if "AS rate" in line) < at["MapInArrow"]


def test_block_counts_in_parts():
    """A unit of more pairs than are counted at once is put together from its parts, at lag 0 too."""
    import pyarrow as pa

    rng = random.Random(6)
    x = [(rng.randrange(3), k, rng.randrange(40)) for k in range(120)]
    rows = pa.RecordBatch.from_arrays([pa.array([0] * len(x), pa.int32()), *[pa.array(c, pa.int64()) for c in zip(*x, strict=True)]], ["block", "unit_id", "spike_idx", "t"])
    (packed,) = correlogram._pack()(iter([rows]))
    block = pa.StructArray.from_arrays(packed.columns[1:], ["units", "n", "code", "idx", "t"])
    pairs = pa.RecordBatch.from_arrays([block, block], ["i", "j"])
    sides = [(-17, 0, 1, 17, 3), (0, 17, 1, 18, 3)]

    def rows_of(at_once):
        got = [(b["unit_i"], j["unit_j"], b["lag_bin"], b["n"]) for batch in correlogram._block_counts(5, sides, at_once)(iter([pairs])) for b in batch.to_pylist() for j in b["others"]]
        assert len(got) == len({r[:3] for r in got})
        return sorted(got)

    later = {}
    for (i, k, t), (j, m, u) in itertools.product(x, x):
        if (u, m) > (t, k) and (u - t) // 3 <= 5:
            later[i, j, (u - t) // 3] = later.get((i, j, (u - t) // 3), 0) + 1
    both = {}
    for (i, j, lag), n in later.items():
        for key in ((i, j, lag), (j, i, -lag)):
            both[key] = max(both.get(key, 0), n)
    assert rows_of(1 << 17) == rows_of(50) == rows_of(1) == sorted((*k, n) for k, n in both.items())


def test_crosscorrelogram_of_no_spikes_and_one(spark):
    for rows in ([], [(1, 1, 5)], [(None, None, None)]):
        df = spark.createDataFrame(rows, "unit_id long, spike_idx long, t long")
        assert correlogram.crosscorrelogram(df, 3, 30).collect() == correlogram.rounded_crosscorrelogram(df, 4, 5, rate=True).collect() == []


def test_quick_rounding_is_sparks(spark):
    rng = random.Random(4)
    x = [None, 0.0, -0.0, -1e-9, 5e-7, -5e-7, 1.5e-6, 2.5e-6, 0.0000125, 1.0000005, 999.9999995, 1e3, 1e9 + 0.1234565, 1e17, float("nan"), float("inf"), -float("inf")]
    x += [rng.randrange(1, 60) / (rng.randrange(1, 5000) * 60) for _ in range(3000)] + [k / 2e6 for k in range(-500, 500)] + [math.nextafter(k / 2e6, 9) for k in range(500)]
    df = spark.createDataFrame([(v,) for v in x], "x double")
    got = df.select((F.round("x", 6) + F.lit(0.0)).alias("a"), catalog.quick_r6(F.col("x")).alias("b")).filter("not (a <=> b)").collect()
    assert got == []


def test_refractory_ties(spark):
    # deviations that are whole numbers: a count at the limit isn't above it, in any order of the lags
    shapes = [[0, 7, 7, 5, 3, 8, 8, 11, 3, 7, 7, 10, 7, 12, 11, 6, 10, 10, 4, 7, 4, 6, 6, 10, 11], [0, 7, 5, 2, 5, 3, 6, 3, 7, 8, 4, 4, 13, 8, 6, 3, 2, 6, 2, 7, 11, 8, 9, 6, 5], [0, 2, 2, 6, 6, 3, 4, 3, 3, 4, 4, 9, 3, 6, 4, 1, 4, 1, 5, 2, 2, 4, 4, 2, 6]]
    rng, trains_ = random.Random(5), []
    for s in shapes:
        trains_ += [s] + [rng.sample(s, len(s)) for _ in range(60)]
    trains_ += [[5, 5, 5], [3], [0, 3_000_000_000, 0]]
    rows = [(u, lag, n) for u, s in enumerate(trains_) for lag, n in enumerate(s)]
    got = {r.unit_id: r.refractory_ms for r in correlogram.refractory_ms(spark.createDataFrame(rows, "unit_id long, lag_bin int, n long").repartition(3), 1.0).collect()}
    for u, s in enumerate(trains_):
        m, least = len(s), min(s)
        above = [lag for lag, n in enumerate(s) if (n - least) ** 2 * m * (m - 1) > m * sum(v * v for v in s) - sum(s) ** 2]
        assert got[u] == (above[0] if above and m > 1 else None), (u, s)


def few_spikes():
    """Trains of 8 to 40 spikes, of whose fits some run off along a valley."""
    rng = np.random.default_rng(7)
    return [(u, i, i, round(float(a), 2)) for u in range(300) for i, a in enumerate(rng.uniform(900, 105000, rng.integers(8, 40)))]


def test_gaussian_fit_is_sqls_to_the_last_digit():
    con = duckdb.connect()
    con.execute("create table spikes (unit_id bigint, spike_idx bigint, t bigint, amplitude double)")
    con.executemany("insert into spikes values (?, ?, ?, ?)", few_spikes())
    head = f"with recursive {catalog.hist_sql('spikes')}, {catalog.gaussian_sql('hist', 'kept')}"
    rows = con.execute(f"""{head} select list(h.n order by bin), list(left_ order by bin), any_value(width), any_value(gst.sd), any_value(gst.low), any_value(missing_gaussian)
from hist h join gst using (unit_id) join gin using (unit_id) join gauss using (unit_id) where not cutoff and missing_gaussian is not null group by unit_id""").fetchall()
    got = fits.cut_gaussians_missing(*[np.array(c, float) for c in list(zip(*rows, strict=True))[:5]])
    assert len(rows) > 30 and all(abs(a - r[5]) < 1e-9 for a, r in zip(got, rows, strict=True))


def test_gaussian_fit_beyond_the_range_of_squares_is_none():
    n = np.histogram(np.random.default_rng(2).normal(0, 1, 100), 50)[0]
    assert all(math.isnan(fits.cut_gaussian_missing(n, np.arange(50) * k, k, 10 * k, 2 * k)) for k in (1e200, 1e-300))


def test_deviation_is_exact_in_any_order(spark):
    rows = few_spikes()
    found = []
    for parts, order in ((1, rows), (7, rows[::-1])):
        df = spark.createDataFrame(order, "unit_id long, spike_idx long, t long, amplitude double").repartition(parts)
        x = amplitude.squares(df).toPandas().sort_values("unit_id")
        sizes = np.array([sum(r[0] == u for r in rows) for u in x.unit_id])
        found.append(fits.deviation(list(np.stack(x.parts).T), x.offset.to_numpy(), sizes, x.scale.to_numpy()))
    assert (found[0] == found[1]).all()
    for u, sd in enumerate(found[0]):
        v = [Fraction(r[3]) for r in rows if r[0] == u]
        mean = sum(v) / len(v)
        var = sum((a - mean) ** 2 for a in v) / len(v)
        assert abs(sd - float((Decimal(var.numerator) / Decimal(var.denominator)).sqrt())) <= math.ulp(sd)


def test_spike_templates_are_sqls_to_the_last_digit(spark, con):
    want = {(a, b): w for a, b, w in con.execute(f"with {catalog.SPIKE_TEMPLATES} select template_id, channel, wf from tpl").fetchall()}
    got = {(r.template_id, r.channel): list(r.wf) for r in catalog.rel.spike_templates(spark, SF).collect()}
    assert got == want
