"""SQL, for DuckDB over the test tables, that states the rows of the registered queries.

Written from the operators' definitions, without the plans' devices: range joins as they stand, dense
spines, sums over all pairs.
"""

from __future__ import annotations

CAM = """cam AS (SELECT event_id AS ord, event_id // 64 AS packet_id, CAST(event_id % 64 AS INT) AS idx_in_packet,
  CASE WHEN event_type IN ('purchase', 'signup') THEN 1 WHEN event_type = 'error' THEN 2 ELSE 0 END AS type,
  CAST(t_us // 1000000 AS INT) AS sec, CAST(t_us // 1000 % 1000 AS INT) AS ms, CAST(t_us % 1000 AS INT) AS us,
  CAST((t_us // 12500 + event_id % 5) % 330 AS INT) AS x, CAST(140 + user_id % 24 AS INT) AS y, t_us
  FROM (SELECT *, (epoch_us(ts) - 1704067200000000) // 648000 AS t_us FROM events)),
inb AS (SELECT * FROM cam WHERE x BETWEEN 0 AND 319 AND y BETWEEN 0 AND 319),
pts AS (SELECT x, y, t_us AS t, ord FROM inb)"""
LAST = "mx AS (SELECT max(t_us) AS now FROM cam)"
LEVEL = "CAST(floor(least(255.0, greatest(0.0, {v}))) AS SMALLINT)"
SIGN = "CASE WHEN type = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END"
MONO = f"""{LAST}, acc AS (SELECT y, x, sum({SIGN}) AS acc FROM inb, mx WHERE t_us >= now - 100000 GROUP BY y, x),
m AS (SELECT max(abs(acc)) AS m FROM acc),
mono AS (SELECT y, x, {LEVEL.format(v='128.0 + (CASE WHEN m > 0 THEN acc / m ELSE acc END) * 4.0 * 127.0')} AS level FROM acc, m)"""
SIGNAL = """e AS (SELECT max(t_us) AS t_end FROM inb),
cnt AS (SELECT (t_us - (t_end - 4000000)) // 1000 AS bin, count(*) AS n FROM inb, e WHERE t_us >= t_end - 4000000 GROUP BY 1),
sig AS (SELECT b.bin, coalesce(n, 0)::DOUBLE AS c FROM (SELECT unnest(range(0, 4000)) AS bin) b LEFT JOIN cnt USING (bin))"""
POWER = """v AS (SELECT bin, (c - (SELECT avg(c) FROM {sig})) * (0.5 - 0.5 * cos(2 * pi() / 3999 * bin)) AS v FROM {sig}),
pw AS (SELECT k, k * 1000000.0::DOUBLE / 4000000.0::DOUBLE AS freq_hz, pow(sum(v * cos(2 * pi() * ((k * bin) % 4000) / 4000)), 2) + pow(sum(v * sin(2 * pi() * ((k * bin) % 4000) / 4000)), 2) AS power
  FROM v, (SELECT unnest(range(160, 1201)) AS k) GROUP BY k)"""
RATIO = "sum(CASE WHEN freq_hz BETWEEN 220 AND 260 THEN power ELSE 0 END) / sum(CASE WHEN freq_hz BETWEEN 40 AND 300 THEN power ELSE 0 END)"
CLIP = """th AS (SELECT greatest(avg(c) + 2.0 * stddev_pop(c), {least}) AS threshold FROM sig),
clip AS (SELECT bin, least(c, threshold) AS c, threshold FROM sig, th)"""
TILE = "y // 16 * 20 + x // 16"
PHASED = f"""ph AS (SELECT *, {TILE} AS tile, least(63, greatest(0, CAST(floor((((t - t0)::DOUBLE * 1e-6::DOUBLE * 240.0::DOUBLE) % 1.0::DOUBLE) * 64) AS INT))) AS phase FROM pts, (SELECT min(t) AS t0 FROM pts)),
pb AS (SELECT tile, phase, count(*) AS c FROM ph GROUP BY ALL),
tl AS (SELECT tile, CAST(sum(c) AS BIGINT) AS n, arg_max(phase, c * 100 - phase) AS peak_bin, max(c) AS top FROM pb GROUP BY tile HAVING sum(c) >= 50),
ts AS (SELECT tile, n, peak_bin, CAST(CAST(top::DOUBLE / n AS FLOAT) AS DOUBLE) AS strength FROM tl)"""
PAIRS = """pr AS (SELECT i.ord, (i.x - j.x)::DOUBLE AS dx, (i.y - j.y)::DOUBLE AS dy FROM {pts} i JOIN {pts} j
  ON j.t < i.t AND j.t >= i.t - 12000 AND abs(i.x - j.x) <= 6 AND abs(i.y - j.y) <= 6
  WHERE (i.x - j.x) * (i.x - j.x) + (i.y - j.y) * (i.y - j.y) <= 36 AND sqrt((i.x - j.x) * (i.x - j.x) + (i.y - j.y) * (i.y - j.y)) / ((i.t - j.t) / 1000.0::DOUBLE) <= 50.0),
st AS (SELECT ord, count(*) AS n, coalesce(var_samp(dx), 0) AS a, coalesce(covar_samp(dx, dy), 0) AS b, coalesce(var_samp(dy), 0) AS c FROM pr GROUP BY ord),
mo AS (SELECT p.*, coalesce(n, 0) AS neighbors, coalesce(((a + c) / 2 + sqrt(pow(a - c, 2) / 4 + b * b)) / (a + c + 1e-6::DOUBLE), 0) AS coherence FROM {pts} p LEFT JOIN st USING (ord)),
mf AS (SELECT *, neighbors >= 2 AND coherence >= 0.45 AS keep, neighbors >= 2 AND coherence >= 0.9 AS strict, neighbors >= 2 AS support FROM mo)"""
MOTION = PAIRS.format(pts="pts")
SUMMARY = """SELECT count(*) AS raw, count(*) FILTER (strict) AS kept, count(*) FILTER (NOT strict) AS rejected,
  round(count(*) FILTER (strict) * 100.0::DOUBLE / count(*), 6) AS kept_pct, round(count(*) FILTER (NOT strict) * 100.0::DOUBLE / count(*), 6) AS rejected_pct,
  round(avg(neighbors), 6) AS mean_neighbors, round(CAST(quantile_cont(neighbors::DOUBLE, 0.5) AS DOUBLE), 6) AS median_neighbors FROM mf"""
RENDER = """vs AS (SELECT {keys} y, x, n, ln(n + 1.0::DOUBLE) AS v FROM fc),
dense AS (SELECT {keys} v FROM vs UNION ALL SELECT {keys} 0.0::DOUBLE FROM (SELECT {keys} 102400 - count(*) AS z FROM vs GROUP BY ALL) g, (SELECT unnest(range(0, 102400)) AS i) WHERE i < z),
p9 AS (SELECT {keys} quantile_cont(v, 0.99) AS p99 FROM dense {group})"""
LEVEL99 = "CAST(CAST(floor(CASE WHEN p99 > 0 THEN v / p99 * 255.0 ELSE v END) AS INT) % 256 AS SMALLINT) AS level"
CHANNELS = {"cumulative": "(VALUES (0, 50000, 0), (1, 250000, 0), (2, 1000000, 0)) c(ch, old, new)", "shifted": "(VALUES (0, 50000, 0), (1, 250000, 50000), (2, 1000000, 250000)) c(ch, old, new)"}


def _q(body: str, *parts: str) -> str:
    return f"WITH {', '.join([CAM, *parts])} {body}"


def _three(mode: str) -> str:
    acc = f"acc AS (SELECT ch, y, x, sum({SIGN}) AS acc FROM inb, mx, {CHANNELS[mode]} WHERE t_us BETWEEN now - old AND now - new GROUP BY ALL)"
    value = "128.0 + (CASE WHEN m > 0 THEN acc / m ELSE acc END) * 4.0 * 127.0"
    return _q(f"SELECT ch, y, x, {LEVEL.format(v=value)} AS level FROM (SELECT *, max(abs(acc)) OVER (PARTITION BY ch) AS m FROM acc)", LAST, acc)


def _blur(taps: dict[int, float]) -> str:
    """Each output pixel over its window on the dense frame, borders reflected without the edge."""
    values = ", ".join(f"({d}, {w}::DOUBLE)" for d, w in taps.items())
    reach = max(map(abs, taps))
    flip = lambda c, d: f"CASE WHEN o.{c} + {d} < 0 THEN -(o.{c} + {d}) WHEN o.{c} + {d} > 319 THEN 638 - (o.{c} + {d}) ELSE o.{c} + {d} END"
    cells = f"o AS (SELECT DISTINCT CAST(y + a AS INT) AS y, CAST(x + b AS INT) AS x FROM mono, (SELECT unnest(range({-reach}, {reach + 1})) AS a), (SELECT unnest(range({-reach}, {reach + 1})) AS b) WHERE y + a BETWEEN 0 AND 319 AND x + b BETWEEN 0 AND 319)"
    out = f"bl AS (SELECT o.y, o.x, sum(a.w * b.w * coalesce(mono.level, 128)) AS v, count(mono.level) AS hit FROM o, (VALUES {values}) a(d, w), (VALUES {values}) b(d, w) LEFT JOIN mono ON mono.y = ({flip('y', 'a.d')}) AND mono.x = ({flip('x', 'b.d')}) GROUP BY ALL)"
    return _q("SELECT y, x, CAST(floor(round(v - 128, 9) + 128.5) AS SMALLINT) AS level FROM bl WHERE hit > 0", MONO, cells, out)


_FC_SIDES = """clk AS (SELECT min(t) AS t0, max(t) AS t1 FROM mf),
rw AS (SELECT *, (t - t0) // 33333 AS frame_idx FROM mf, clk WHERE (t - t0) // 33333 < greatest(1, ceil((t1 - t0) * 1e-6::DOUBLE * 30.0::DOUBLE))),
fc AS (SELECT 'raw' AS side, frame_idx, y, x, count(*) AS n FROM rw GROUP BY ALL UNION ALL SELECT 'filtered', frame_idx, y, x, count(*) FROM rw WHERE strict GROUP BY ALL)"""
_GRID = """cl AS (SELECT *, CAST((x >= 106)::INT + (x >= 213)::INT AS INT) AS gx, CAST((y >= 106)::INT + (y >= 213)::INT AS INT) AS gy FROM inb),
ce AS (SELECT gy, gx, max(t_us) AS t_end FROM cl GROUP BY ALL),
cc AS (SELECT gy, gx, (t_us - (t_end - 4000000)) // 1000 AS bin, count(*)::DOUBLE AS c FROM cl JOIN ce USING (gy, gx) WHERE t_us >= t_end - 4000000 AND t_us < t_end GROUP BY ALL),
cs AS (SELECT gy, gx, bin, coalesce(c, 0) AS c FROM ce CROSS JOIN (SELECT unnest(range(0, 4000)) AS bin) LEFT JOIN cc USING (gy, gx, bin)),
cv AS (SELECT gy, gx, bin, (c - avg(c) OVER (PARTITION BY gy, gx)) * (0.5 - 0.5 * cos(2 * pi() / 3999 * bin)) AS v FROM cs),
cp AS (SELECT gy, gx, k / 4.0::DOUBLE AS freq_hz, pow(sum(v * cos(2 * pi() * ((k * bin) % 4000) / 4000)), 2) + pow(sum(v * sin(2 * pi() * ((k * bin) % 4000) / 4000)), 2) AS power FROM cv, (SELECT unnest(range(160, 1201)) AS k) GROUP BY ALL)"""
_HIST = """h0 AS (SELECT min(t) AS t0, max(t) AS t1 FROM pts),
hc AS (SELECT t0, CAST(ceil((t1 - t0)::DOUBLE * 1e-6::DOUBLE / 0.001::DOUBLE) AS BIGINT) + 1 AS n FROM h0),
hs AS (SELECT t0, n, n * 0.001::DOUBLE / n AS step FROM hc),
hk AS (SELECT (t - t0)::DOUBLE * 1e-6::DOUBLE AS s, step, floor(((t - t0)::DOUBLE * 1e-6::DOUBLE) / step) AS k FROM pts, hs),
hb AS (SELECT CAST(k - (s < k * step)::INT + (s >= (k + 1) * step)::INT AS BIGINT) AS bin, count(*) AS c FROM hk GROUP BY 1),
hr AS (SELECT b.bin, coalesce(c, 0) / 0.001::DOUBLE AS rate FROM (SELECT unnest(range(0, (SELECT n FROM hs))) AS bin) b LEFT JOIN hb USING (bin)),
hm AS (SELECT k, k / (n * 0.001::DOUBLE) AS freq_hz, sqrt(pow(sum(v * cos(2 * pi() * ((k * bin) % n) / n)), 2) + pow(sum(v * sin(2 * pi() * ((k * bin) % n) / n)), 2)) AS magnitude
  FROM (SELECT bin, rate - (SELECT avg(rate) FROM hr) AS v FROM hr), hs, (SELECT unnest(range(1, 2001)) AS k) WHERE k / (n * 0.001::DOUBLE) BETWEEN 1.0 AND 300.0 GROUP BY k, n)"""
_PACKETS = """ps AS (SELECT packet_id, count(*) AS event_count, arg_min(t_us, idx_in_packet) AS first_event_t_us, arg_max(t_us, idx_in_packet) AS last_event_t_us FROM cam GROUP BY packet_id),
pk AS (SELECT packet_id, CAST(row_number() OVER (ORDER BY packet_id) - 1 AS BIGINT) AS packet_idx, CAST(sum(event_count) OVER (ORDER BY packet_id) - event_count AS BIGINT) AS start_event_idx, CAST(sum(event_count) OVER (ORDER BY packet_id) AS BIGINT) AS end_event_idx, event_count, first_event_t_us, last_event_t_us FROM ps)"""
_D = 0.94
_DECAY = f"(pow({_D}::DOUBLE, greatest(0, lp - packet_id - 9)) - pow({_D}::DOUBLE, lp - packet_id + 1)) / (1.0::DOUBLE - {_D}::DOUBLE)"
_FADED = f"dk AS (SELECT y, x, sum((CASE WHEN type = 1 THEN 0.75::DOUBLE ELSE -0.75::DOUBLE END) * {_DECAY}) AS acc FROM inb, (SELECT max(packet_id) AS lp FROM cam) GROUP BY ALL)"
_CROP = PAIRS.format(pts="cp")
_CROPPED = "cr AS (SELECT x, y, t, ord FROM pts, (SELECT min(t) AS t0 FROM pts) WHERE (t - t0) * 1e-6::DOUBLE BETWEEN 0.5 AND 2.5), cp AS (SELECT x, y, t - (SELECT min(t) FROM cr) AS t, ord FROM cr)"

ORACLES: dict[str, str] = {
    "event_timestamp": _q("SELECT ord, sec * 1000000::BIGINT + ms * 1000 + us AS t FROM cam"),
    "bounds_filter": _q("SELECT ord, x, y FROM inb"),
    "coord_clamp": _q("SELECT ord, greatest(0, least(x, 319)) AS x, greatest(0, least(y, 150)) AS y FROM cam"),
    "scalar_functions": _q(f"SELECT ord, phase, least(abs(phase - 3), 64 - abs(phase - 3)) AS distance, round(ln(x + 1.0::DOUBLE), 6) AS log_x, {LEVEL.format(v='x * 1.5 - 20')} AS level FROM (SELECT *, least(63, greatest(0, CAST(floor(((t_us::DOUBLE * 1e-6::DOUBLE * 240.0::DOUBLE) % 1.0::DOUBLE) * 64) AS INT))) AS phase FROM cam)"),
    "time_crop": _q("SELECT ord, t FROM pts, (SELECT min(t) AS t0 FROM pts) WHERE (t - t0) * 1e-6::DOUBLE BETWEEN 0.5 AND 1.25"),
    "time_rebase": _q("SELECT ord, t - (SELECT min(t) FROM pts) AS t FROM pts"),
    "trailing_window": _q("SELECT ord, t_us FROM cam, mx WHERE t_us >= now - 100000", LAST),
    "channel_masks": _q(f"SELECT ord, ch FROM cam, mx, {CHANNELS['cumulative']} WHERE t_us BETWEEN now - old AND now - new", LAST),
    "channel_masks_shifted": _q(f"SELECT ord, ch FROM cam, mx, {CHANNELS['shifted']} WHERE t_us BETWEEN now - old AND now - new", LAST),
    "tick_windows": _q("SELECT tick, count(*) AS n, min(t_us) AS oldest, max(t_us) AS newest FROM nw JOIN cam ON t_us <= tick * 33333 AND t_us >= now - 100000 WHERE (SELECT count(*) FROM cam c WHERE (c.t_us + 33332) // 33333 BETWEEN tick - 4 AND tick) > 0 GROUP BY tick", "tk AS (SELECT unnest(range(0, (SELECT max(t_us) // 33333 + 6 FROM cam))) AS tick)", "nw AS (SELECT tick, max(t_us) AS now FROM tk JOIN cam ON t_us <= tick * 33333 GROUP BY tick)"),
    "tile_assign": _q(f"SELECT ord, CAST({TILE} AS BIGINT) AS tile FROM inb"),
    "grid_assign": _q("SELECT ord, CAST((x >= 106)::INT + (x >= 213)::INT AS INT) AS gx, CAST((y >= 106)::INT + (y >= 213)::INT AS INT) AS gy FROM inb"),
    "signed_accumulate": _q(f"SELECT y, x, sum({SIGN}) AS acc FROM inb GROUP BY y, x"),
    "mono_frame": _q("SELECT * FROM mono", MONO),
    "three_channel_cumulative": _three("cumulative"),
    "three_channel_shifted": _three("shifted"),
    "decay_frame": _q(f"SELECT y, x, round(acc, 6) AS acc, {LEVEL.format(v='128.0 + acc * 10.0')} AS level FROM dk", _FADED),
    "pixel_heatmap": _q("SELECT y, x, count(*) AS n, round(ln(count(*) + 1.0::DOUBLE), 6) AS log_n FROM inb GROUP BY y, x"),
    "frame_counts": _q("SELECT greatest(0, least(y, 319)) AS y, greatest(0, least(x, 319)) AS x, count(*) AS n FROM cam GROUP BY ALL"),
    "count_signal": _q("SELECT bin, c FROM sig", SIGNAL),
    "rate_histogram": _q("SELECT bin, round(rate, 6) AS rate FROM hr", _HIST.split(",\nhm")[0]),
    "burst_clip": _q("SELECT bin, round(c, 6) AS c, round(threshold, 6) AS threshold FROM clip", SIGNAL, CLIP.format(least="0.0::DOUBLE")),
    "fft_power_band": _q("SELECT k, round(freq_hz, 6) AS freq_hz, round(ln(power + 1), 6) AS log_power FROM pw", SIGNAL, POWER.format(sig="sig")),
    "fft_magnitude": _q("SELECT k, round(freq_hz, 6) AS freq_hz, round(ln(magnitude + 1), 6) AS log_magnitude FROM hm", _HIST),
    "flicker_ratio": _q(f"SELECT round({RATIO}, 6) AS ratio FROM pw", SIGNAL, POWER.format(sig="sig")),
    "flicker_ratio_clipped": _q(f"SELECT round({RATIO}, 6) AS ratio, round((SELECT threshold FROM th), 6) AS threshold FROM pw", SIGNAL, CLIP.format(least="30.0::DOUBLE"), POWER.format(sig="clip")),
    "flicker_ratio_clipped_low": _q(f"SELECT round({RATIO}, 6) AS ratio, round((SELECT threshold FROM th), 6) AS threshold FROM pw", SIGNAL, CLIP.format(least="0.0::DOUBLE"), POWER.format(sig="clip")),
    "grid_flicker": _q(f"SELECT g.gy, g.gx, coalesce(round(r, 6), 0) AS ratio FROM (SELECT CAST(a AS INT) AS gy, CAST(b AS INT) AS gx FROM (SELECT unnest(range(0, 3)) AS a), (SELECT unnest(range(0, 3)) AS b)) g LEFT JOIN (SELECT gy, gx, CASE WHEN sum(CASE WHEN freq_hz BETWEEN 40 AND 300 THEN power ELSE 0 END) <= 1e-12 THEN 0 ELSE {RATIO} END AS r FROM cp GROUP BY gy, gx) USING (gy, gx)", _GRID),
    "dominant_frequency": _q("SELECT round(freq_hz, 6) AS freq_hz FROM hm ORDER BY round(magnitude, 6) DESC, k LIMIT 1", _HIST),
    "top_peaks": _q("SELECT round(freq_hz, 6) AS freq_hz, round(ln(power + 1), 6) AS log_power, round(power / (SELECT max(power) FROM pw), 6) AS rel FROM pw ORDER BY power DESC, k LIMIT 5", SIGNAL, POWER.format(sig="sig")),
    "tile_counts": _q(f"SELECT CAST({TILE} AS BIGINT) AS tile, count(*) AS n, count(*) >= 50 AS eligible FROM pts GROUP BY 1"),
    "tile_phase_strength": _q("SELECT CAST(tile AS BIGINT) AS tile, n, peak_bin, round(strength, 6) AS strength FROM ts", PHASED),
    "phase_filter": _q("SELECT ord, NOT coalesce(least(abs(phase - peak_bin), 64 - abs(phase - peak_bin)) <= 2, false) AS keep FROM ph LEFT JOIN (SELECT * FROM ts WHERE strength > 0.18) USING (tile)", PHASED),
    "phase_filter_low": _q("SELECT ord, NOT coalesce(least(abs(phase - peak_bin), 64 - abs(phase - peak_bin)) <= 2, false) AS keep FROM ph LEFT JOIN (SELECT * FROM ts WHERE strength > 0.05) USING (tile)", PHASED),
    "percentile_render": _q(f"SELECT y, x, n, {LEVEL99} FROM vs, p9", "fc AS (SELECT y, x, count(*) AS n FROM pts GROUP BY ALL)", RENDER.format(keys="", group="")),
    "throughput": _q("SELECT packets, events, events * 12 AS payload_bytes, events * 12 + packets * 12 AS protocol_bytes, round(packets / 2.0::DOUBLE, 6) AS packets_per_s, round(events / 2.0::DOUBLE, 6) AS events_per_s, round(events * 12 / 2e6::DOUBLE, 6) AS payload_mb_per_s, round((events * 12 + packets * 12) / 2e6::DOUBLE, 6) AS protocol_mb_per_s FROM (SELECT count(DISTINCT packet_id) AS packets, count(*) AS events FROM cam)"),
    "window_stats": _q("SELECT count(*) AS events, round(count(*) / 4.0::DOUBLE, 6) AS events_per_s, count(DISTINCT y * 320 + x) AS active_px, round(count(DISTINCT y * 320 + x) / 102400.0::DOUBLE, 6) AS active_share FROM inb"),
    "packet_probe": _q("SELECT packet_id, string_agg(DISTINCT type::VARCHAR, ',' ORDER BY type::VARCHAR) AS types, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y FROM cam WHERE packet_id < 3 GROUP BY packet_id"),
    "recording_events": _q("SELECT start_event_idx + idx_in_packet AS event_idx, CAST(type % 256 AS SMALLINT) AS type, x, y, t_us, packet_idx AS packet_id FROM cam JOIN pk USING (packet_id)", _PACKETS),
    "recording_packets": _q("SELECT packet_idx, start_event_idx, end_event_idx, event_count, first_event_t_us, last_event_t_us FROM pk", _PACKETS),
    "motion_neighbors": _q("SELECT ord, neighbors, round(coherence, 6) AS coherence FROM mf", MOTION),
    "motion_filter": _q("SELECT ord, x, y, t, neighbors FROM mf WHERE keep", MOTION),
    "motion_filter_strict": _q("SELECT ord, x, y, t, neighbors FROM mf WHERE strict", MOTION),
    "motion_support_only": _q("SELECT ord, x, y, t, neighbors FROM mf WHERE support", MOTION),
    "rejected_events": _q("SELECT ord, neighbors FROM mf WHERE NOT strict", MOTION),
    "filter_summary": _q(SUMMARY, MOTION),
    "debug_classes": _q("SELECT y, x, bool_or(strict) AS kept FROM mf GROUP BY y, x", MOTION),
    "time_sort": _q("SELECT ord, t_us FROM cam ORDER BY t_us, ord"),
    "keep_last_packets": _q("SELECT ord, packet_id FROM cam WHERE packet_id > (SELECT max(packet_id) FROM cam) - 10"),
    "packet_eviction": _q("SELECT ord, packet_id FROM cam JOIN (SELECT packet_id, max(t_us) AS latest FROM cam GROUP BY 1) USING (packet_id) WHERE packet_id <= 100 AND latest >= (SELECT max(t_us) - 500000 FROM cam WHERE packet_id = (SELECT max(packet_id) FROM cam WHERE packet_id <= 100))"),
    "packet_eviction_all": _q("SELECT ord, packet_id FROM cam WHERE packet_id >= (SELECT min(packet_id) FROM cam WHERE t_us >= (SELECT max(t_us) - 500000 FROM cam WHERE packet_id = (SELECT max(packet_id) FROM cam)))"),
    "frame_series": _q(f"SELECT side, frame_idx, y, x, n, {LEVEL99} FROM vs JOIN p9 USING (side, frame_idx)", MOTION, _FC_SIDES, RENDER.format(keys="side, frame_idx,", group="GROUP BY ALL")),
    "offline_pipeline": _q(SUMMARY, _CROPPED, _CROP),
    "upscale": _q("SELECT CAST(y * 2 + a AS INT) AS y, CAST(x * 2 + b AS INT) AS x, level FROM mono, (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b)", MONO),
    "box_blur": _blur({-1: 0.5, 0: 0.5}),
    "gaussian_blur": _blur({-1: 0.25, 0: 0.5, 1: 0.25}),
}

#: Events that went through capture files give the same tables.
ORACLES |= {"capture_recording_events": ORACLES["recording_events"], "capture_ranges": ORACLES["recording_events"], "capture_recording_packets": ORACLES["recording_packets"], "capture_heatmap": ORACLES["pixel_heatmap"], "capture_throughput": ORACLES["throughput"]}

_HEADS = "pk AS (SELECT packet_id, max(t_us) AS latest, count(*) AS n FROM cam GROUP BY packet_id)"
_HELD = "SELECT 'camera' AS sensor, count(*) AS packets, CAST(sum(n) AS BIGINT) AS events, min(packet_id) AS oldest_packet, max(packet_id) AS newest_packet, arg_max(latest, packet_id) AS latest FROM pk WHERE "

#: Films hold what their table does; streams that ran to their end leave what the whole table gives.
ORACLES |= {
    "capture_corrupt": ORACLES["recording_events"],
    "recording_written": ORACLES["recording_events"],
    "point_file": _q("SELECT CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, t_us AS t FROM inb"),
    "frame_message": f"SELECT 123456 AS stamp_us, 'camera' AS frame_id, 'mono8' AS encoding, 320 AS height, 320 AS width, * FROM ({ORACLES['mono_frame']})",
    "frame_message_three_channel": f"SELECT 123456 AS stamp_us, 'camera' AS frame_id, 'bgr8' AS encoding, 320 AS height, 320 AS width, * FROM ({ORACLES['three_channel_cumulative']})",
    "sql_functions": _q("SELECT ord, sec * 1000000::BIGINT + ms * 1000 + us AS t, CASE WHEN type = 1 THEN 0.75::DOUBLE ELSE -0.75::DOUBLE END AS delta FROM cam"),
    "film_files": f"SELECT side, frame_idx, count(*) AS lit, CAST(sum(level) AS BIGINT) AS total FROM ({ORACLES['frame_series']}) WHERE level > 0 GROUP BY side, frame_idx",
    "stream_recording": ORACLES["recording_events"],
    "stream_preview": ORACLES["decay_frame"],
    "stream_arrival_buffer": _q(_HELD + "latest >= (SELECT max(latest) - 500000 FROM pk)", _HEADS),
    "stream_event_buffer": _q(_HELD + "packet_id >= (SELECT min(packet_id) FROM pk WHERE latest >= (SELECT arg_max(latest, packet_id) - 500000 FROM pk))", _HEADS),
    "stream_tick_windows": f"SELECT * FROM ({ORACLES['tick_windows']}) WHERE tick * 33333 <= (SELECT max(newest) // 1000 * 1000 - 1000000 FROM ({ORACLES['tick_windows']}))",
}
