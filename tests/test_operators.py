"""Operators against small models, at the boundaries the oracles do not reach."""

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evstream.config import FlickerConfig, FrameConfig, MotionConfig, PhaseConfig, RecordingConfig, Sensor
from evstream.functions.scalars import grid_cell, register_functions
from evstream.operators import frames, motion, phase, signal, spectral, windows
from evstream.plans.pipelines import offline

EVENTS = "ord long, packet_id long, idx_in_packet int, type int, x int, y int, t_us long"
POINTS = "ord long, x int, y int, t long"


def events(spark, rows):
    return spark.createDataFrame([(k, 0, k, *r) for k, r in enumerate(rows)], EVENTS)


def points(spark, rows):
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], POINTS)


def motion_model(rows, cfg):
    out = []
    for i, (xi, yi, ti) in enumerate(rows):
        near = [(xi - x, yi - y) for x, y, t in rows if 0 < ti - t <= cfg.window_us and (xi - x) ** 2 + (yi - y) ** 2 <= cfg.radius_px**2 and np.hypot(xi - x, yi - y) / ((ti - t) / 1000) <= cfg.max_speed + 1e-9]
        c = 0.0
        if len(near) > 1:
            e = np.linalg.eigvalsh(np.cov(np.array(near, float).T))
            c = e[1] / (e.sum() + 1e-6)
        out.append((len(near), len(near) >= cfg.min_neighbors and (cfg.support_only or c >= cfg.min_coherence)))
    return out


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25), st.integers(0, 60_000)), max_size=60))
def test_motion_filter_is_the_brute_force_join(spark, rows):
    for cfg in (MotionConfig(min_coherence=0.8), MotionConfig(radius_px=2, window_ms=30, support_only=True, min_neighbors=1)):
        got = {r.ord: (r.neighbors, r.keep) for r in motion.motion_filter(points(spark, rows), cfg).collect()}
        assert [got[k] for k in range(len(rows))] == motion_model(rows, cfg)


@pytest.mark.parametrize("radius, window_ms", [(1, 0.003), (5, 0.1), (6, 12.0)])
def test_motion_pairs_meet_once_across_cell_edges(spark, radius, window_ms):
    rng = np.random.default_rng(radius)
    rows = list(zip(rng.integers(0, 40, 300).tolist(), rng.integers(0, 40, 300).tolist(), rng.integers(0, 400, 300).tolist()))
    cfg = MotionConfig(radius_px=radius, window_ms=window_ms, max_speed=1e9, support_only=True)
    got = {r.ord: (r.neighbors, r.keep) for r in motion.motion_filter(points(spark, rows), cfg).collect()}
    assert [got[k] for k in range(len(rows))] == motion_model(rows, cfg)


def test_no_pair_is_slower_than_a_negative_speed(spark):
    rows = [(k, 5, 1000 * k) for k in range(9)]
    assert motion.motion_filter(points(spark, rows), MotionConfig(max_speed=-50.0)).where("neighbors > 0 or keep").count() == 0


@pytest.mark.parametrize("span_ms, block", [(300, 1 << 20), (300, 64), (997, 256), (1024, 1), (2003, 512)])
def test_one_array_and_the_turned_matrix_transform_alike(spark, span_ms, block):
    rng = np.random.default_rng(span_ms)
    times = sorted(rng.integers(0, span_ms * 1000, 400).tolist()) + [span_ms * 1000 - 500]
    pts = points(spark, [(1, 1, t) for t in [0, *times]])
    both = [sorted((r.k, r.freq_hz, r.magnitude) for r in spectral.fft_magnitude(pts, one_array=n, block=block).collect()) for n in (1 << 24, 0)]
    assert [r[:2] for r in both[0]] == [r[:2] for r in both[1]] and len(both[0]) > 50
    assert np.allclose([r[2] for r in both[0]], [r[2] for r in both[1]], rtol=1e-9, atol=1e-6)


@pytest.mark.parametrize("n", [1, 2, 5, 64, 97, 1000])
def test_the_turned_matrix_holds_every_place_once(n):
    for block in (1, 8, 1 << 20):
        m = spectral._Turned(n, block)
        places = np.concatenate([m.places(j).ravel() for j in range(m.wide // m.columns)])
        assert m.size >= 2 * n and sorted(places) == list(range(m.size)) and m.rows * m.wide <= max(block, m.wide)


def test_offsets_run_on_over_many_files(spark):
    files = spark.range(3000).selectExpr("id * 4294967296 AS packet_id", "id % 7 AS n").unionByName(spark.range(200_000).selectExpr("5 * 4294967296 + 1 + id AS packet_id", "id % 3 AS n"))
    rows = windows.running_offsets(files, "packet_id", "n").toPandas().sort_values("packet_id")
    ends = rows.n.cumsum().to_numpy()
    assert (rows.end_event_idx.to_numpy() == ends).all() and (rows.start_event_idx.to_numpy() == ends - rows.n.to_numpy()).all()
    assert (rows.packet_idx.to_numpy() == np.arange(len(rows))).all()


def test_cells_are_worked_through_in_blocks():
    rng, cfg = np.random.default_rng(3), MotionConfig(radius_px=3, window_ms=0.2, max_speed=40.0)
    side, span, around = 12, 800, motion.offsets(cfg)
    rows = [(int(x), int(y), int(t), int(c)) for x, y, t, c in zip(rng.integers(0, 60, 900), rng.integers(-30, 30, 900), rng.integers(-2000, 2000, 900), rng.integers(1, 4, 900))]
    rows = list({r[:3]: r for r in rows}.values())
    sent = sorted((cx, cy, tb, x, y, t, c) for x, y, t, c in rows for cx in range((x - 3) // side, (x + 3) // side + 1) for cy in range((y - 3) // side, (y + 3) // side + 1) for tb in range(t // span, (t + 200) // span + 1))
    want = {}
    for x, y, t, _ in rows:
        near = [(x - a, y - b, c) for a, b, s, c in rows if 0 < t - s <= 200 and (x - a) ** 2 + (y - b) ** 2 <= 9 and ((x - a) ** 2 + (y - b) ** 2) * 1e6 <= 1600 * (t - s) ** 2]
        if near:
            want[x, y, t] = tuple(sum(f(dx, dy) * c for dx, dy, c in near) for f in (lambda a, b: 1, lambda a, b: a, lambda a, b: b, lambda a, b: a * a, lambda a, b: b * b, lambda a, b: a * b))
    for size, block in ((10_000, 1 << 17), (7, 1), (50, 100), (1, 3)):
        batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*sent[k : k + size])], names=list("abcdefg")) for k in range(0, len(sent), size)]
        got = [tuple(r.values()) for b in motion.rank_batches(batches, cfg, around, block) for r in b.to_pylist()]
        assert len(got) == len(want) and {r[:3]: r[3:] for r in got} == want


def test_a_hot_pixel_costs_what_its_events_cost():
    """Ten times the events on one pixel: pairs would be a hundred times as many, searches are ten times."""
    cfg = MotionConfig()

    def searches(n):
        t = np.sort(np.random.default_rng(1).choice(40_000, n, replace=False)) + 4096
        one, zero = np.ones(n, np.int64), np.zeros(n, np.int64)
        calls = []
        real = np.searchsorted
        np.searchsorted = lambda keys, at, side="left": calls.append(len(at) * np.log2(len(keys) + 2)) or real(keys, at, side)
        try:
            (batch,) = motion._rank_sums([zero, zero, zero, 5 * one, 5 * one, t, one], cfg, motion.offsets(cfg))
        finally:
            np.searchsorted = real
        expect = [int(((t < u) & (u - t <= 12_000)).sum()) for u in t]
        got = dict(zip(batch.column("t").to_pylist(), batch.column("n").to_pylist()))
        assert [got.get(int(u), 0) for u in t] == expect
        return sum(calls), sum(expect)

    (few, pairs), (many, more) = searches(800), searches(8000)
    assert many < 15 * few and more > 60 * pairs


def test_equal_events_and_nulls(spark):
    rows = [(5, 5, 100)] * 50 + [(6, 5, 1100)] * 30 + [(None, 5, 100), (5, None, 100), (5, 5, None)]
    got = motion.motion_filter(points(spark, rows).withColumns({c: F.lit("clash") for c in ("n", "a", "times", "cx", "sx")}), MotionConfig(support_only=True))
    assert got.columns[4:9] == ["n", "a", "times", "cx", "sx"]
    assert sorted((r.ord, r.neighbors, r.keep) for r in got.collect()) == [(k, 50 if 50 <= k < 80 else 0, 50 <= k < 80) for k in range(83)]


def test_motion_filter_without_radius_keeps_nothing(spark):
    got = motion.motion_filter(points(spark, [(1, 1, 0), (1, 1, 5)]), MotionConfig(radius_px=0)).collect()
    assert [(r.neighbors, r.keep) for r in got] == [(0, False)] * 2


def test_equal_times_never_support_each_other(spark):
    got = motion.motion_filter(points(spark, [(5, 5, 100)] * 4), MotionConfig(support_only=True, min_neighbors=1))
    assert not got.where("keep").count()


def test_opposite_events_leave_grey(spark):
    frame = frames.mono_frame(events(spark, [(1, 3, 3, 10), (0, 3, 3, 20)])).collect()
    assert [(r.y, r.x, r.level) for r in frame] == [(3, 3, 128)]


def test_type_two_counts_down_and_out_of_bounds_is_dropped(spark):
    frame = frames.mono_frame(events(spark, [(2, 3, 3, 10), (1, 320, 3, 20), (1, 0, 65535, 20)])).collect()
    assert [(r.y, r.x, r.level) for r in frame] == [(3, 3, 0)]


def test_channel_edges_count_twice_when_shifted(spark):
    ev = events(spark, [(1, 1, 1, 1_000_000), (1, 2, 1, 950_000), (1, 3, 1, 750_000), (1, 4, 1, 749_999)])
    got = {(r.ord, r.ch) for r in windows.channel_masks(ev, (50, 250, 1000), "shifted").collect()}
    assert got == {(0, 0), (1, 0), (1, 1), (2, 1), (2, 2), (3, 2)}


def test_count_signal_never_counts_the_latest_event(spark):
    cfg = FlickerConfig(window_s=0.004, bin_us=1000)
    got = signal.count_signal(events(spark, [(1, 1, 1, 10_000), (1, 1, 1, 10_000), (1, 1, 1, 6_000), (1, 1, 1, 5_999), (1, 1, 1, 9_999)]), cfg).orderBy("bin").collect()
    assert [r.c for r in got] == [1.0, 0.0, 0.0, 1.0]


def test_power_is_numpys(spark):
    rng = np.random.default_rng(1)
    c = rng.poisson(3, 64).astype(float)
    sig = spark.createDataFrame([(k, float(v)) for k, v in enumerate(c)], "bin long, c double")
    want = np.abs(np.fft.rfft((c - c.mean()) * np.hanning(64))) ** 2
    got = [r.power for r in spectral.fft_power(sig, 64, 1000).orderBy("k").collect()]
    joined = [r.power for r in spectral._joined(sig, 64, 1000, 0, 32).orderBy("k").collect()]
    assert np.allclose(got, joined, rtol=1e-9, atol=1e-9) and len(joined) == 33
    keyed = [r.power for r in spectral.fft_power(sig.withColumn("g", F.lit(1)), 64, 1000, keys=("g",)).orderBy("k").collect()]
    assert np.allclose(got, want) and np.allclose(keyed, want)


@pytest.mark.parametrize("c", [[2.0] * 32, [1.0, 5.0] * 7])
def test_flat_and_short_signals_have_no_power(spark, c):
    sig = spark.createDataFrame([(k, v) for k, v in enumerate(c)], "bin long, c double")
    assert spectral.fft_power(sig, len(c), 1000).agg(F.max("power")).first()[0] == 0.0


def test_dominant_frequency_of_a_blinking_light_and_of_nothing(spark):
    rows = [(1, 1, int(k * 1e6 / 120)) for k in range(240)]
    assert abs(spectral.dominant_frequency(points(spark, rows)).first()[0] - 120) < 1
    assert spectral.dominant_frequency(points(spark, [])).first()[0] == 1.0
    assert spectral.dominant_frequency(points(spark, [(1, 1, 5)] * 3)).first()[0] == 1.0


def test_phase_filter_rejects_what_keeps_the_phase(spark):
    rng = np.random.default_rng(2)
    locked = [(5, 5, int(round(k * 1e6 / 240))) for k in range(60)]
    rest = [(6, 6, int(t)) for t in rng.integers(0, 250_000, 20)]
    few = [(100, 100, int(round(k * 1e6 / 240))) for k in range(49)]
    got = phase.phase_filter(points(spark, locked + rest + few), 240.0)
    sums = phase.phase_filter_counts(got, 240.0).first()
    assert sums.rejected >= 60 and sums.rejected + sums.kept == 129
    assert got.where("x = 100 and not keep").count() == 0
    assert phase.phase_filter(points(spark, few), 0.0).where("keep").count() == 49
    assert tuple(phase.phase_filter_counts(got, 0.0).first()) == (0, 0)


def test_blur_is_the_dense_blur(spark):
    sensor = Sensor(9, 7)
    rng = np.random.default_rng(3)
    img = np.full((7, 9), 128.0)
    rows = [(int(y), int(x), int(v)) for y, x, v in zip(rng.integers(0, 7, 12), rng.integers(0, 9, 12), rng.integers(0, 256, 12))]
    rows = list({(y, x): v for y, x, v in rows}.items())
    for (y, x), v in rows:
        img[y, x] = v
    frame = spark.createDataFrame([(y, x, v) for (y, x), v in rows], "y int, x int, level smallint")
    for blurred, taps, anchor in ((frames.box_blur(frame, 2, sensor), [0.5, 0.5], 1), (frames.gaussian_blur(frame, 4, sensor), frames.gaussian_weights(5), 2), (frames.gaussian_blur(frame, 9, sensor), frames.gaussian_weights(9), 4)):
        flip = lambda k, n: -k if k < 0 else 2 * (n - 1) - k if k >= n else k
        ends = [(i - anchor, w) for i, w in enumerate(taps)]
        if max(abs(d) for d, _ in ends) >= 7:
            continue
        want = np.array([[sum(a * b * img[flip(y + i, 7), flip(x + j, 9)] for i, a in ends for j, b in ends) for x in range(9)] for y in range(7)])
        got = np.full((7, 9), 128)
        for r in blurred.collect():
            got[r.y, r.x] = r.level
        assert (got == np.floor(np.round(want - 128, 9) + 128.5)).all()


def test_percentile_render_wraps_and_clips(spark):
    counts = spark.createDataFrame([(0, k, 1 if k < 99 else 5000) for k in range(100)], "y int, x int, n long")
    wrapped = {r.x: r.level for r in frames.percentile_render(counts, Sensor(10, 10)).collect()}
    cut = {r.x: r.level for r in frames.percentile_render(counts, Sensor(10, 10), clip=True).collect()}
    v = np.log1p([1] * 99 + [5000])
    p99 = np.percentile(v, 99)
    assert cut[99] == 255 and wrapped[99] == int(v[99] / p99 * 255) % 256


def test_frame_series_drops_the_tail_and_spans_all_frames(spark):
    rows = points(spark, [(1, 1, 0), (1, 1, 33_332), (1, 1, 33_333), (1, 1, 30 * 33_333)]).withColumn("keep", F.col("ord") < 2)
    got = {(r.side, r.frame_idx, r.n) for r in frames.frame_series(rows).collect()}
    assert got == {("raw", 0, 2), ("raw", 1, 1), ("filtered", 0, 2)}
    assert frames.frame_spine(rows).count() == 60


def test_eviction_is_from_the_head_only(spark):
    ev = spark.createDataFrame([(k, p, 0, 1, 1, 1, t) for k, (p, t) in enumerate([(0, 0), (1, 900_000), (2, 100_000), (3, 1_000_000)])], EVENTS)
    assert {r.packet_id for r in windows.evict_packets(ev, 0.5).collect()} == {1, 2, 3}


def test_running_offsets_cross_buckets(spark):
    ids = [5, 65_535, 65_536, 200_000, 200_001]
    rows = spark.createDataFrame([(p, k + 1) for k, p in enumerate(ids)], "packet_id long, event_count long")
    got = windows.running_offsets(rows, "packet_id", "event_count").orderBy("packet_id").collect()
    assert [(r.packet_idx, r.start_event_idx, r.end_event_idx) for r in got] == [(0, 0, 1), (1, 1, 3), (2, 3, 6), (3, 6, 10), (4, 10, 15)]


def test_empty_input_gives_empty_results(spark):
    nothing = offline(points(spark, []))
    assert nothing.filtered.count() == nothing.classes.count() == nothing.frames.count() == 0
    assert nothing.summary.first().raw == 0
    ev = events(spark, [])
    assert frames.mono_frame(ev).count() == signal.count_signal(ev).count() == 0
    assert {r.ratio for r in spectral.grid_flicker(ev).collect()} == {0.0}


def test_grid_edges(spark):
    df = spark.range(320).select(F.col("id").cast("int").alias("x"))
    for g in (1, 2, 3, 7, 11):
        edges = np.linspace(0, 320, g + 1).astype(np.int32)
        got = [r[0] for r in df.select(grid_cell("x", 320, g)).collect()]
        assert got == list(np.searchsorted(edges, np.arange(320), "right") - 1)


def test_sql_functions(spark):
    register_functions(spark)
    row = spark.sql("SELECT ev_timestamp(1, 2, 3), ev_polarity(2, 1.5), ev_phase_bin(0.5, 1.0, 64), ev_circular_distance(1, 63, 64), ev_tile(17, 33, 16, 320)").first()
    assert tuple(row) == (1_002_003, -1.5, 32, 2, 41)


def test_configuration_checks():
    with pytest.raises(ValueError):
        FrameConfig(windows_ms=(0, 1, 2))
    with pytest.raises(ValueError):
        FrameConfig(mono_topic="a", three_channel_topic="a")
    with pytest.warns(UserWarning):
        assert FrameConfig(mode="odd", encoding="odd").checked().mode == "cumulative"
    assert FrameConfig(mode="shifted", windows_ms=(3, 1, 2)).checked().windows_ms == (1, 2, 3)
    assert [RecordingConfig(compression=c).codec for c in (" GZIP ", "lzf", "", "none")] == ["gzip", "snappy", "none", "none"]
    with pytest.warns(UserWarning):
        assert RecordingConfig(compression="odd").codec == "gzip"
    assert PhaseConfig().strength == 0.18


def test_range_join_is_an_equi_join(spark):
    plan = motion.motion_filter(points(spark, [(1, 1, 1)]))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
