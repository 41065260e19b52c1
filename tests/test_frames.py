"""Frame comparison, detection in batch, in blocks and as a stream, and the cost figures."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuelake.functions import cost as M
from cuelake.operators import frames as V
from cuelake.streaming.detect import detect_stream, read_decisions, state_table

GRID = V.Grid()
SCHEMA = "media_id BIGINT, t_ms DOUBLE, width INT, height INT, pixels BINARY"


def pattern(seed):
    return np.random.default_rng(seed).integers(20, 230, (108, 192)).astype(float)


def kinds(images):
    d = V.Detector(GRID)
    return [d.decide(im, i * 500.0)[0] for i, im in enumerate(images)]


def test_machine():
    a, b = pattern(1), pattern(2)
    assert kinds([a, a, b, b, a, a]) == ["candidate", "stable"] * 3
    black = np.zeros_like(a)
    assert kinds([black, a]) == ["black", "candidate"]


def test_compare():
    a = pattern(3)
    patch = a.copy()
    patch[50:55, 60:65] = 255
    assert V.compare(a, patch, GRID).changed
    flat = np.clip(a, 20, 230)
    assert not V.compare(flat, flat + 10, GRID).changed
    assert V.compare(a, np.roll(a, 1, axis=1), GRID).motion


def small_frames(spark, rng, media, most=14):
    """Short recordings of 8 x 8 frames that stay, come back, go black or flicker."""
    looks = [rng.integers(20, 230, (8, 8)) for _ in range(3)] + [np.zeros((8, 8))]
    rows = []
    for m in range(media):
        for k in range(int(rng.integers(1, most))):
            rows.append((m, k * 500.0, 8, 8, bytearray(looks[int(rng.choice([0, 0, 1, 1, 2, 3]))].astype(np.uint8).tobytes())))
    return spark.createDataFrame(rows, SCHEMA)


SMALL = V.Grid(margin=1, stride=1, cells=4, shift=1)


def table(spark, images, media=1):
    rows = [(media, i * 500.0, 192, 108, bytearray(im.astype(np.uint8).tobytes())) for i, im in enumerate(images)]
    return spark.createDataFrame(rows, SCHEMA)


def scan(spark, images, rows=4096):
    f = table(spark, images)
    d = V.detect_decisions(f, GRID, frame_rows=rows)
    m = spark.createDataFrame([(1, len(images) * 500, False)], "media_id BIGINT, duration_ms BIGINT, last_changed BOOLEAN")
    states, audit, _ = V.display_states(d, m)
    return states.orderBy("state_no").collect(), audit.collect(), d


def test_three_states_and_blocks(spark):
    a, b = pattern(1), pattern(2)
    images = [a] * 4 + [b] * 4 + [a] * 4
    states, _, d = scan(spark, images)
    assert len(states) == 3 and states[0].start_ms == 0 and states[-1].end_ms == 6000
    assert all(s.end_ms == n.start_ms for s, n in zip(states, states[1:]))
    cut = scan(spark, images, 3)[2]
    assert sorted(map(str, d.collect())) == sorted(map(str, cut.collect()))


def test_short_state_is_kept_and_audited(spark):
    a, b = pattern(1), pattern(2)
    states, audit, _ = scan(spark, [a] * 4 + [b] + [a] * 7)
    assert len(states) == 3 and "incomplete" in states[1].flags
    assert [x.kind for x in audit] == ["transition"]


def test_black_tail(spark):
    a = pattern(1)
    states, audit, _ = scan(spark, [a] * 8 + [np.zeros_like(a)] * 4)
    assert states[0].end_ms < 6000
    assert [(x.kind, x.end_ms) for x in audit] == [("black", 6000.0)]


def run_stream(spark, folder, now=lambda: 0, **options):
    stream = spark.readStream.schema(SCHEMA).parquet(f"{folder}/in")
    q = detect_stream(stream, f"{folder}/out", f"{folder}/cp", SMALL, buckets=4, now_ms=now, **options).trigger(availableNow=True).start()
    q.awaitTermination()
    assert q.exception() is None


def decided(spark, folder):
    return sorted(map(str, read_decisions(spark, f"{folder}/out").select("media_id", "t_ms", "kind", "since", "motion").collect()))


def test_stream_equals_batch(spark, tmp_path):
    folder = str(tmp_path)
    f = small_frames(spark, np.random.default_rng(3), 12).cache()
    want = sorted(map(str, V.detect_decisions(f, SMALL).select("media_id", "t_ms", "kind", "since", "motion").collect()))
    cut = F.col("media_id") * 7 % 11 * 500
    for part in (f.where(F.col("t_ms") < cut), f.where(F.col("t_ms") >= cut)):
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        run_stream(spark, folder, frame_rows=3)
    assert decided(spark, folder) == want
    # the last batch is repeated because its commit was lost
    last = max(p for p in os.listdir(f"{folder}/cp/commits") if p.isdigit())
    for name in (last, f".{last}.crc"):
        if os.path.exists(f"{folder}/cp/commits/{name}"):
            os.remove(f"{folder}/cp/commits/{name}")
    run_stream(spark, folder)
    assert decided(spark, folder) == want


def test_late_frames_are_told_and_idle_states_dropped(spark, tmp_path):
    folder = str(tmp_path)
    looks = np.random.default_rng(4).integers(20, 230, (8, 8))
    row = lambda m, t: (m, float(t), 8, 8, bytearray(looks.astype(np.uint8).tobytes()))
    for rows, now in (([row(1, 0), row(1, 500), row(2, 0)], 0), ([row(1, 500), row(1, 1000), row(1, 1000)], 5), ([row(1, 1500), row(2, 500)], 12)):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        run_stream(spark, folder, now=lambda now=now: now, ttl_ms=10)
    got = sorted((r.media_id, r.t_ms, r.kind) for r in read_decisions(spark, f"{folder}/out").collect())
    assert got == [
        (1, 0.0, "candidate"), (1, 500.0, "late"), (1, 500.0, "stable"), (1, 1000.0, "late"), (1, 1000.0, "same"), (1, 1500.0, "same"),
        (2, 0.0, "candidate"), (2, 500.0, "candidate"),  # its state was twelve old
    ]
    assert {r.media_id: r.updated_ms for r in state_table(spark, f"{folder}/out", 4).read().collect()} == {1: 12, 2: 12}


@pytest.mark.parametrize("calls, tokens_in, tokens_out, profile, allowance, want", [
    (96, 3000, 1000, "standard", 0, 1.536), (96, 3000, 1000, "standard", 0.25, 1.92), (160, 7000, 1500, "standard", 0, 4.64),
    (160, 7000, 1500, "standard", 0.25, 5.8), (80, 3000, 1000, "economy", 0, 0.064),
])
def test_costs(spark, calls, tokens_in, tokens_out, profile, allowance, want):
    p = M.default_pricing(spark).where(F.col("profile") == profile)
    c = M.hypothetical_cost(F.lit(calls), F.lit(tokens_in), F.lit(tokens_out), F.col("input"), F.col("output"), F.lit(allowance))
    assert p.select(F.round(c, 9)).first()[0] == pytest.approx(want)


def test_usage_cost(spark):
    p = M.default_pricing(spark).where("profile = 'standard'")
    rates = [F.col(c) for c in ("input", "output", "cached_input", "cache_write")]
    use = lambda *t: p.select(M.usage_cost(*[F.lit(x) for x in t], *rates)).first()[0]
    assert use(3000, 1000, 0, 0) == pytest.approx(0.016)
    assert use(2000, 1000, 1000, 0) == pytest.approx(0.0121)


def test_tiles(spark):
    i = spark.createDataFrame([(1, 1000, 1000, 0.1), (2, 20_000, 100, 0.1), (3, 90, 90, 1e9)], "image_id INT, width INT, height INT, bytes_per_pixel DOUBLE")
    rows = V.tile_plan(i).collect()
    assert [(r.x, r.width) for r in rows if r.image_id == 1] == [(0, 1000)]
    assert sorted((r.x, r.width) for r in rows if r.image_id == 2) == [(0, 5048), (4984, 5048), (9968, 5048), (14952, 5048)]
    assert [r.refused for r in rows if r.image_id == 3] == [True]


def scanned(decisions, duration, last_changed, most, step):
    """The scan told frame by frame: states, audit and status of one recording."""
    states, audit, current, pending, gap = [], [], None, None, None
    prev = max(0.0, decisions[0][0] - step)

    def opened(t, certain):
        nonlocal current, gap
        start = 0.0 if not states and t < step else (prev + t) / 2
        if current:
            current["end"] = max(current["start"], start)
        if gap and start > gap[0]:
            audit.append((gap[1], gap[0], start))
        gap = None
        current = {"start": start, "end": t, "flags": ["boundary-uncertain"] + ([] if certain else ["dynamic", "incomplete"])}
        states.append(current)

    for t, kind, since, motion in decisions:
        if kind in ("black", "unobservable"):
            if current:
                current["end"] = max(current["start"], (prev + t) / 2)
                current = None
            gap = gap or ((prev + t) / 2, kind)
            pending = None
        elif kind == "candidate" and pending != since:
            if len(states) >= most:
                return states, audit, ("paused", t, "limit")
            opened(t, False)
            pending = since
        elif kind == "stable":
            if current and pending == since and pending is not None:
                current["flags"] = ["boundary-uncertain"]
                current["end"] = t
            else:
                if len(states) >= most:
                    return states, audit, ("paused", t, "limit")
                opened(t, True)
            pending = None
        elif kind == "same":
            if pending is not None:
                if current:
                    audit.append(("transition", current["start"], t))
                if len(states) >= most:
                    return states, audit, ("paused", t, "limit")
                opened(t, True)
                pending = None
            if current:
                current["end"] = t
                if motion:
                    current["flags"].append("region-review")
                    return states, audit, ("paused", t, "motion")
        prev = t
    if current and pending is None and not last_changed:
        current["end"] = float(duration)
    elif current:
        current["flags"] += ["incomplete"] if "incomplete" not in current["flags"] else []
        audit.append(("transition", current["end"], float(duration)))
    if gap and duration > gap[0]:
        audit.append((gap[1], gap[0], float(duration)))
    return states, audit, ("complete", float(duration), None)


def test_states_equal_the_scan_told_frame_by_frame(spark):
    import random

    rng = random.Random(5)
    rows, media, want = [], [], {}
    for m in range(120):
        t, since, own = 0.0, 0.0, []
        for _ in range(rng.randint(1, 25)):
            kind = rng.choice(["candidate", "candidate", "stable", "same", "same", "same", "black", "unobservable"])
            since = rng.choice([since, t])
            own.append((t, kind, since if kind in ("candidate", "stable") else None, kind == "same" and rng.random() < 0.08))
            t += rng.choice([500.0, 500.0, 1000.0])
        duration, changed = int(t + 250), rng.random() < 0.3
        rows += [(m, *d) for d in own]
        media.append((m, duration, changed))
        want[m] = scanned(own, duration, changed, 4, 500.0)
    d = spark.createDataFrame(rows, "media_id BIGINT, t_ms DOUBLE, kind STRING, since DOUBLE, motion BOOLEAN")
    found = V.display_states(d, spark.createDataFrame(media, "media_id BIGINT, duration_ms BIGINT, last_changed BOOLEAN"), 4)
    states, audit, status = (f.collect() for f in found)
    for m, (s, a, st) in want.items():
        got = sorted((r.state_no, r.start_ms, r.end_ms, tuple(r.flags)) for r in states if r.media_id == m)
        assert got == [(k + 1, x["start"], x["end"], tuple(x["flags"])) for k, x in enumerate(s)], m
        assert sorted((r.kind, r.start_ms, r.end_ms) for r in audit if r.media_id == m) == sorted(a), m
        assert [(r.status, r.cursor_ms, r.reason) for r in status if r.media_id == m] == [st], m


def test_representative_is_compared_with_the_first(spark):
    e = spark.createDataFrame([(1, "e0", 0.5, 0), (1, "e1", 0.9, 1), (1, "e2", 0.6, 2), (1, "e3", 0.4, 3)], "state_id INT, evidence_id STRING, sharpness DOUBLE, ord INT")
    assert [r.representative_id for r in V.representative_evidence(e).collect()] == ["e2"]


def test_boundaries_stay_inside_the_recording(spark):
    a, b = pattern(1), pattern(2)
    raw = lambda im: bytearray(im.astype(np.uint8).tobytes())
    changes = spark.createDataFrame(
        [(1, 7, 1000, 2000, raw(a), 192, 108, 1900)],
        "media_id BIGINT, change_id BIGINT, low_ms BIGINT, high_ms BIGINT, baseline BINARY, width INT, height INT, duration_ms BIGINT")
    dense = spark.createDataFrame(
        [(1, t, raw(a if t < 1500 else b)) for t in range(1000, 2001, 100)], "media_id BIGINT, t_ms BIGINT, pixels BINARY")
    assert [(r.low_ms, r.high_ms) for r in V.refine_boundaries(changes, dense, GRID).collect()] == [(1050, 1750)]
    assert [(r.low_ms, r.high_ms) for r in V.refine_boundaries(changes, dense.where("t_ms < 1500"), GRID).collect()] == [(1550, 1900)]


@pytest.mark.parametrize("rows", [4096, 3])
def test_going_on_from_a_cursor_equals_one_scan(spark, rows):
    f = small_frames(spark, np.random.default_rng(11), 60).cache()
    whole, end = V.scan_on(f, None, SMALL, frame_rows=rows)
    cursor = (F.col("media_id") * 7 % 13) * 500.0
    before, states = V.scan_on(f.where(F.col("t_ms") <= cursor), None, SMALL, frame_rows=rows)
    after, last = V.scan_on(f, states, SMALL, frame_rows=rows)
    plain = lambda d: sorted(map(str, d.select("media_id", "t_ms", "kind", "since", "motion").collect()))
    assert plain(before.unionByName(after)) == plain(whole) == plain(V.detect_decisions(f, SMALL, frame_rows=rows))
    told = lambda d: sorted(map(str, d.select("media_id", "cursor_ms", "state").collect()))
    assert told(last) == told(end)
    none, same = V.scan_on(f, last, SMALL, frame_rows=rows)
    assert none.count() == 0 and told(same) == told(end)


def test_end_is_compared_with_the_last_baseline(spark):
    a, b, black = pattern(1), pattern(2), np.zeros((108, 192))
    cases = {1: ([a, a, a], a), 2: ([a, a, a], b), 3: ([a, a, a], black), 4: ([a, a, black], a), 5: ([a, b, b], b), 6: ([a], a)}
    frames = [table(spark, images, m) for m, (images, _) in cases.items()]
    finals = [table(spark, [last], m).drop("t_ms") for m, (_, last) in cases.items()]
    union = lambda parts: __import__("functools").reduce(lambda x, y: x.unionByName(y), parts)
    _, states = V.scan_on(union(frames), None, GRID)
    got = {r.media_id: r.last_changed for r in V.end_changes(states, union(finals), GRID).collect()}
    assert got == {1: False, 2: True, 3: True, 4: True, 5: False, 6: True}


def test_bisection_follows_single_probes(spark):
    rng = np.random.default_rng(5)
    a, b = (rng.integers(20, 230, (8, 8)) for _ in range(2))
    raw = lambda im: bytearray(im.astype(np.uint8).tobytes())
    frames, changes, want = [], [], {}
    for m in range(25):
        turn, duration = int(rng.integers(0, 5000)), 5100
        own = sorted({int(t) for t in rng.integers(0, 5000, 80)})
        frames += [(m, float(t), 8, 8, raw(b if t >= turn else a)) for t in own]
        low, high = sorted(int(x) for x in rng.integers(0, 5001, 2))
        changes.append((m, 1, low, high, raw(a), 8, 8, duration))
        lo, hi = float(low), float(high)
        while hi - lo > 200:
            mid = (lo + hi) / 2
            seen = [t for t in own if t <= mid]
            lo, hi = (lo, mid) if seen and seen[-1] >= turn else (mid, hi)
        want[m] = (max(0.0, lo - 250), min(float(duration), hi + 250))
    c = spark.createDataFrame(changes, "media_id BIGINT, change_id BIGINT, low_ms BIGINT, high_ms BIGINT, baseline BINARY, width INT, height INT, duration_ms BIGINT")
    got = V.bisect_boundaries(c, spark.createDataFrame(frames, SCHEMA), SMALL)
    assert {r.media_id: (r.low_ms, r.high_ms) for r in got.collect()} == want


def test_changes_are_worked_out_once(spark):
    """Every round and the result read the brackets; what they come from is not run again."""
    rng = np.random.default_rng(8)
    a, b = (bytearray(rng.integers(20, 230, (8, 8)).astype(np.uint8).tobytes()) for _ in range(2))
    frames = [(m, k * 500.0, 8, 8, b if k > 3 else a) for m in range(6) for k in range(10)]
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    names = "media_id BIGINT, change_id BIGINT, low_ms BIGINT, high_ms BIGINT, baseline BINARY, width INT, height INT, duration_ms BIGINT"
    c = spark.createDataFrame([(m, 1, 0, 4500, a, 8, 8, 5000) for m in range(6)], names).mapInPandas(count, names)
    assert {(r.low_ms, r.high_ms) for r in V.bisect_boundaries(c, spark.createDataFrame(frames, SCHEMA), SMALL).collect()} == {(1718.75, 2359.375)}
    assert seen.value == 6


def test_refined_states_read_decisions_that_were_written(spark):
    from catalog.base import Tables
    from catalog.framing import brackets

    d, c, _ = brackets(Tables(spark, "/root/testdata/sf0.001"))
    for df in (d, c):
        assert "MapInArrow" not in df._jdf.queryExecution().toString()
