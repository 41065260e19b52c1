"""Frame statistics, frame comparison, and display-state detection over sampled frames.

frames: media_id, t_ms, width, height, pixels (BINARY, one gray byte per pixel, row by row)."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BooleanType, DoubleType, StructField, StructType,
)

from cuelake.functions.tables import MAX_PIXELS, MAX_SIDE, register_table_functions
from cuelake.operators.folds import block_fold
from cuelake.operators.joins import asof_join, attach_key_values
from cuelake.operators.ordered import Scan, numbered, ordered_scan, row_block, time_block
from cuelake.session import stage_table

# Frames of one recording scanned by one task.
FRAME_ROWS = 4096


@dataclass(frozen=True)
class Grid:
    """Comparison settings. The defaults suit the 192 x 108 grid; small grids need a smaller
    margin, fewer cells and a smaller shift."""

    margin: int = 3
    stride: int = 2
    cells: int = 24
    shift: int = 2
    sensitivity: float = 1.0
    stable_samples: int = 2


FEATURE = StructType([
    StructField("mean", DoubleType()), StructField("variance", DoubleType()), StructField("sharpness", DoubleType()),
    StructField("black", BooleanType()), StructField("unobservable", BooleanType()),
])


def image(pixels: bytes, width: int, height: int) -> np.ndarray:
    return np.frombuffer(pixels, dtype=np.uint8).reshape(height, width).astype(np.float64)


def feature_of(a: np.ndarray) -> tuple[float, float, float, bool, bool]:
    """mean, variance, sharpness, black, unobservable"""
    inner = a[1:, 1:]
    edge = np.abs(inner - a[1:, :-1]).sum() + np.abs(inner - a[:-1, 1:]).sum()
    mean, var, sharp = float(a.mean()), float(a.var()), float(edge / (a.size * 2 * 255))
    return mean, var, sharp, mean < 9 and var < 80, sharp < 0.002 and var < 30


@F.pandas_udf(FEATURE)
def frame_feature(pixels: pd.Series, width: pd.Series, height: pd.Series) -> pd.DataFrame:
    rows = [feature_of(image(p, w, h)) for p, w, h in zip(pixels, width, height)]
    return pd.DataFrame(rows, columns=[f.name for f in FEATURE.fields])


def gray(red: Column, green: Column, blue: Column) -> Column:
    return F.round(red * 0.299 + green * 0.587 + blue * 0.114).cast("int")


@dataclass(frozen=True)
class Difference:
    overall: float
    regional: float
    motion: bool
    changed: bool
    uncertain: bool


def compare(a: np.ndarray, b: np.ndarray, grid: Grid) -> Difference:
    """Exposure-compensated difference: best of small shifts overall, worst cell regionally."""
    if a.shape != b.shape:
        raise ValueError("frames of one recording must have one size")
    h, w = a.shape
    m, s = grid.margin, grid.shift
    b = b - (b.mean() - a.mean())
    ys, xs = np.arange(m, h - m, grid.stride), np.arange(m, w - m, grid.stride)
    base = a[np.ix_(ys, xs)]

    def at(dy: int, dx: int) -> float:
        return float(np.abs(base - b[np.ix_(ys + dy, xs + dx)]).mean() / 255)

    moves = [(dy, dx) for dy in range(-s, s + 1) for dx in range(-s, s + 1)]
    plain = at(0, 0)
    best, by, bx = plain, 0, 0
    for dy, dx in moves:
        value = at(dy, dx)
        if value < best:
            best, by, bx = value, dy, dx
    y, x = np.arange(m, h - m), np.arange(m, w - m)
    off = np.abs(a[np.ix_(y, x)] - b[np.ix_(y + by, x + bx)])
    cell = (y * grid.cells // h)[:, None] * grid.cells + (x * grid.cells // w)[None, :]
    totals = np.bincount(cell.ravel(), off.ravel(), grid.cells**2)
    counts = np.bincount(cell.ravel(), minlength=grid.cells**2)
    regional = float((totals / (np.maximum(counts, 1) * 255)).max())
    motion = plain > 0.04 and best < plain * 0.5
    k = grid.sensitivity
    return Difference(
        best, regional, motion, best > 0.07 / k or regional > 0.045 / k,
        best > 0.025 / k or regional > 0.018 / k or motion,
    )


def compare_neighbours(frames: DataFrame, grid: Grid = Grid()) -> DataFrame:
    """Difference of each frame from the one before it in its recording."""
    seen = ordered_scan(
        frames, ["media_id"], ["t_ms"], time_block("t_ms"), [Scan("__prev", "lag", F.col("pixels"))], spread=True
    )
    result = StructType([
        StructField("overall", DoubleType()), StructField("regional", DoubleType()), StructField("motion", BooleanType()),
        StructField("changed", BooleanType()), StructField("uncertain", BooleanType()),
    ])

    @F.pandas_udf(result)
    def difference(a: pd.Series, b: pd.Series, width: pd.Series, height: pd.Series) -> pd.DataFrame:
        rows = [compare(image(p, w, h), image(q, w, h), grid) for p, q, w, h in zip(a, b, width, height)]
        return pd.DataFrame([vars(r) for r in rows], columns=result.names)

    pairs = seen.where(F.col("__prev").isNotNull())
    return pairs.select("media_id", "t_ms", difference("__prev", "pixels", "width", "height").alias("d")).select(
        "media_id", "t_ms", "d.*"
    )


def plain_difference(a: Column, b: Column) -> Column:
    """Mean absolute difference of two pixel arrays, without shifts."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y).cast("double")), F.lit(0.0), lambda s, d: s + d)
    return total / (F.size(a) * 255)


class Detector:
    """Per-recording machine: baseline, pending frame, its time and count.

    decide returns (kind, since, motion) with kind same, candidate, stable, black, unobservable."""

    def __init__(self, grid: Grid, feature: Callable = feature_of) -> None:
        self.grid, self.feature = grid, feature
        self.baseline: np.ndarray | None = None
        self.pending: np.ndarray | None = None
        self.since, self.count = 0.0, 0

    def decide(self, frame: np.ndarray, t: float) -> tuple[str, float, bool]:
        *_, black, unobservable = self.feature(frame)
        if black or unobservable:
            self.baseline = self.pending = None
            self.count = 0
            return ("black" if black else "unobservable"), t, False
        if self.baseline is not None:
            d = compare(self.baseline, frame, self.grid)
            if d.motion or not (d.changed or d.uncertain):
                self.pending, self.count = None, 0
                return "same", t, d.motion
        if self.pending is not None and not compare(self.pending, frame, self.grid).changed:
            self.count += 1
        else:
            first = self.baseline is None and self.pending is None
            self.pending, self.since, self.count = frame, t, 1
            if first:
                return "candidate", t, False
        if self.count < self.grid.stable_samples:
            return "candidate", self.since, False
        self.baseline, self.pending, self.count = frame, None, 0
        return "stable", self.since, False

    def dump(self) -> list:
        pack = lambda a: None if a is None else [a.shape, a.astype(np.uint8).tobytes().hex()]
        return [pack(self.baseline), pack(self.pending), self.since, self.count]

    def load(self, state: list) -> None:
        def unpack(x):
            return None if x is None else np.frombuffer(bytes.fromhex(x[1]), np.uint8).reshape(x[0]).astype(float)

        self.baseline, self.pending = unpack(state[0]), unpack(state[1])
        self.since, self.count = state[2], state[3]


class _Decisions:
    """Fold of frames to decisions."""

    def __init__(self, grid: Grid, feature: Callable) -> None:
        self.machine = Detector(grid, feature)

    @property
    def state(self) -> list:
        return self.machine.dump()

    @state.setter
    def state(self, value: list) -> None:
        self.machine.load(value)

    def push(self, row: tuple) -> Iterable[tuple]:
        t, width, height, pixels = row
        return [(t, *self.machine.decide(image(pixels, width, height), t))]

    def finish(self) -> Iterable[tuple]:
        return []


def detect_decisions(
    frames: DataFrame, grid: Grid = Grid(), feature: Callable = feature_of, frame_rows: int = FRAME_ROWS
) -> DataFrame:
    """decisions(media_id, t_ms, kind, since, motion). ``feature`` replaces the frame statistics."""
    ordinal = numbered(frames, ["media_id"], ["t_ms"], time_block("t_ms"), "n")
    return block_fold(
        ordinal, ["media_id"], ["n"], row_block("n", frame_rows), ["t_ms", "width", "height", "pixels"],
        lambda: _Decisions(grid, feature), "t_ms DOUBLE, kind STRING, since DOUBLE, motion BOOLEAN",
    )


def scan_on(
    frames: DataFrame, start: DataFrame | None = None, grid: Grid = Grid(), feature: Callable = feature_of, frame_rows: int = FRAME_ROWS
) -> tuple[DataFrame, DataFrame]:
    """(decisions, states) of a scan that goes on where an earlier one stopped.

    start: the states of earlier scans, one row per recording: media_id, cursor_ms (its last frame) and
    state (what the machine holds, as text). Frames at or before the cursor are not read again. The new
    states hold all recordings of either table, so stopping anywhere and going on gives the decisions
    of one scan."""
    keys, block = ["media_id"], time_block("t_ms")
    fresh = frames
    if start is not None:
        known = attach_key_values(frames, keys, block, start.select("media_id", "cursor_ms"))
        fresh = known.where(F.col("cursor_ms").isNull() | (F.col("t_ms") > F.col("cursor_ms"))).select(*frames.columns)
    ordinal = numbered(fresh, keys, ["t_ms"], block, "n")
    rows = stage_table(
        block_fold(
            ordinal, keys, ["n"], row_block("n", frame_rows), ["t_ms", "width", "height", "pixels"],
            lambda: _Decisions(grid, feature), "t_ms DOUBLE, kind STRING, since DOUBLE, motion BOOLEAN", start=start, leave=True,
        ),
        "scan_decisions",
    )
    left = rows.where(F.col("state").isNotNull()).select("media_id", "state")
    states = rows.groupBy("media_id").agg(F.max("t_ms").alias("cursor_ms")).join(left, "media_id")
    if start is not None:
        idle = start.join(states.select("media_id"), "media_id", "left_anti")
        states = states.unionByName(idle.select("media_id", F.col("cursor_ms").cast("double").alias("cursor_ms"), "state"))
    return rows.where(F.col("state").isNull()).drop("state"), states


def end_changes(states: DataFrame, finals: DataFrame, grid: Grid = Grid(), feature: Callable = feature_of) -> DataFrame:
    """media_id, last_changed: is the final frame of a recording unreadable, or different from the
    baseline that its scan (`states`) was left with? Without a baseline it counts as changed.

    finals: media_id, width, height, pixels, one row per recording."""

    @F.pandas_udf(BooleanType())
    def changed(state: pd.Series, pixels: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
        machine = Detector(grid, feature)
        out = []
        for dumped, p, w, h in zip(state, pixels, width, height):
            machine.load(json.loads(dumped))
            last = image(p, w, h)
            *_, black, unobservable = feature(last)
            out.append(bool(black or unobservable or machine.baseline is None or compare(machine.baseline, last, grid).changed))
        return pd.Series(out)

    both = states.select("media_id", "state").join(finals, "media_id")
    return both.select("media_id", changed("state", "pixels", "width", "height").alias("last_changed"))


def display_states(
    decisions: DataFrame, media: DataFrame, max_states: int = 200, step_ms: float = 500.0, refined: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(states, audit, status) from decisions(media_id, t_ms, kind, since, motion), by windows alone.

    A state opens at a candidate with a new ``since``, at a stable frame that was not pending, or at
    a "same" frame that ends a pending one; black and unobservable frames close it. A recording is
    paused before the frame that would open state ``max_states`` + 1, and after a frame with motion
    inside a state; decisions behind the pause are cut first, so nothing is claimed of that time.
    status has one row per recording: paused or complete, the cursor to go on from, and the reason.

    media: media_id, duration_ms, last_changed (is the final frame unreadable or different from the
    last baseline). step_ms is the time between two samples. refined(media_id, t_ms, low_ms,
    high_ms) narrows the boundaries of candidates that open a state."""
    keys, block = ["media_id"], time_block("t_ms")
    seen = ordered_scan(decisions, keys, ["t_ms"], block, [Scan("prev", "lag", F.struct("t_ms", "kind", "since"))])
    gap = F.col("kind").isin("black", "unobservable")
    pending = F.coalesce(F.col("prev.kind") == "candidate", F.lit(False))
    again = pending & (F.col("prev.since") == F.col("since"))
    before = F.coalesce(F.col("prev.t_ms"), F.greatest(F.lit(0.0), F.col("t_ms") - step_ms))
    returns = (F.col("kind") == "same") & pending
    marked = seen.withColumns({
        "gap": gap, "returns": returns, "before": before, "middle": (before + F.col("t_ms")) / 2,
        "opens": ((F.col("kind").isin("candidate", "stable")) & ~again) | returns,
        "confirms": (F.col("kind") == "stable") & again,
    }).drop("prev")
    counted = ordered_scan(
        marked, keys, ["t_ms"], block,
        [
            Scan("state_no", "sum", F.col("opens").cast("bigint")),
            Scan("open_at", "last", F.when(F.col("opens"), F.col("t_ms"))),
            Scan("gap_at", "last", F.when(F.col("gap"), F.col("t_ms"))),
        ],
    )
    active = (F.col("state_no") > 0) & (F.col("gap_at").isNull() | (F.col("gap_at") < F.col("open_at")))
    # read by the stops, the states, the audit and the status
    rows = stage_table(counted.withColumn("active", active).drop("open_at", "gap_at"), "scan_rows")

    over = F.when(F.col("opens") & (F.col("state_no") > max_states), F.col("t_ms"))
    moved = F.when((F.col("kind") == "same") & F.col("motion") & F.col("active"), F.col("t_ms"))
    stops = rows.groupBy("media_id").agg(F.min(over).alias("over_ms"), F.min(moved).alias("moved_ms"))
    by_limit = F.col("over_ms").isNotNull() & (F.col("moved_ms").isNull() | (F.col("over_ms") <= F.col("moved_ms")))
    stops = media.join(stops, "media_id").select(
        "media_id", "duration_ms", "last_changed",
        F.when(by_limit, F.lit("limit")).when(F.col("moved_ms").isNotNull(), F.lit("motion")).alias("reason"),
        F.when(by_limit, F.col("over_ms")).otherwise(F.col("moved_ms")).alias("stop_ms"),
    )
    known = attach_key_values(rows, keys, block, stops.select("media_id", "stop_ms", "reason"))
    at_stop = F.col("t_ms") == F.col("stop_ms")
    kept = known.where(F.col("stop_ms").isNull() | (F.col("t_ms") < F.col("stop_ms")) | (at_stop & (F.col("reason") == "motion")))
    if refined is not None:
        kept = kept.join(refined.select("media_id", "t_ms", F.col("low_ms").alias("r_low"), F.col("high_ms").alias("r_high")), ["media_id", "t_ms"], "left")
    else:
        kept = kept.withColumns({"r_low": F.lit(None).cast("double"), "r_high": F.lit(None).cast("double")})
    narrowed = F.col("opens") & (F.col("kind") == "candidate")
    low = F.when(narrowed, F.coalesce("r_low", "before")).otherwise(F.col("before"))
    high = F.when(narrowed, F.coalesce("r_high", "t_ms")).otherwise(F.col("t_ms"))

    moves_end = F.col("active") & (F.col("opens") | F.col("confirms") | (F.col("kind") == "same"))
    opening = F.when(F.col("opens"), F.struct("t_ms", low.alias("low_ms"), high.alias("high_ms"), "kind", "returns"))
    groups = kept.groupBy("media_id", "state_no").agg(
        F.min(opening).alias("o"),
        F.max(F.when(moves_end, F.col("t_ms"))).alias("seen_ms"),
        F.min(F.when(F.col("gap"), F.struct("t_ms", "middle", "kind"))).alias("g"),
        F.max("confirms").alias("confirmed"),
        F.max_by("kind", "t_ms").alias("last_kind"),
    )
    early = (F.col("state_no") == 1) & (F.col("o.t_ms") < step_ms)
    groups = groups.withColumn("start_ms", F.when(early, F.lit(0.0)).otherwise((F.col("o.low_ms") + F.col("o.high_ms")) / 2))
    chain = ordered_scan(
        groups.join(stops, "media_id"), keys, ["state_no"], row_block("state_no"), [Scan("next", "lead", F.struct("start_ms", "o"))]
    )
    complete = F.col("stop_ms").isNull()
    open_end = F.col("next").isNull() & F.col("g").isNull()
    verified = complete & open_end & (F.col("last_kind") != "candidate") & ~F.col("last_changed")
    uncertain = (F.col("o.kind") == "candidate") & ~F.col("confirmed")
    end = F.coalesce(F.col("g.middle"), F.col("next.start_ms"), F.when(verified, F.col("duration_ms").cast("double")), F.col("seen_ms"))
    moving = open_end & (F.col("reason") == "motion")
    unverified = open_end & complete & ~verified
    built = chain.where("state_no > 0").withColumns({"end_ms": F.greatest(F.col("start_ms"), end), "unverified": unverified})
    end_low = F.when(F.col("g").isNotNull(), 2 * F.col("g.middle") - F.col("g.t_ms")).otherwise(F.coalesce(F.col("next.o.low_ms"), F.col("seen_ms")))
    after = F.least(F.col("duration_ms").cast("double"), F.col("seen_ms") + F.when(F.col("last_kind") == "same", F.lit(step_ms)).otherwise(F.lit(0.0)))
    states = built.select(
        "media_id", "state_no", F.sha2(F.concat_ws(":", "media_id", "state_no"), 256).alias("state_id"), "start_ms", "end_ms",
        F.col("o.low_ms").alias("start_low_ms"), F.col("o.high_ms").alias("start_high_ms"), end_low.alias("end_low_ms"),
        F.coalesce(F.col("g.t_ms"), F.col("next.o.high_ms"), after).alias("end_high_ms"),
        F.array_compact(F.array(
            F.lit("boundary-uncertain"), F.when(uncertain, F.lit("dynamic")),
            F.when(uncertain | F.col("unverified"), F.lit("incomplete")), F.when(moving, F.lit("region-review")),
        )).alias("flags"),
    )
    # a gap runs to the start of the next state, or to the end of a recording that was scanned whole
    until = F.coalesce(F.col("next.start_ms"), F.when(complete, F.col("duration_ms").cast("double")))
    gaps = chain.where(F.col("g").isNotNull() & (until > F.col("g.middle"))).select(
        "media_id", F.col("g.kind").alias("kind"), F.col("g.middle").alias("start_ms"), until.alias("end_ms"))
    fades = built.where("next.o.returns").select(
        "media_id", F.lit("transition").alias("kind"), "start_ms", F.col("next.o.t_ms").alias("end_ms"))
    # the frame that the limit stops at may end a short state too
    stopped = known.where(at_stop & (F.col("reason") == "limit") & F.col("returns")).select("media_id", F.col("t_ms").alias("end_ms"))
    newest = built.where(F.col("next").isNull() & F.col("g").isNull()).select("media_id", "start_ms")
    stopped = stopped.join(newest, "media_id").select("media_id", F.lit("transition").alias("kind"), "start_ms", "end_ms")
    tails = built.where("unverified").select(
        "media_id", F.lit("transition").alias("kind"), F.col("end_ms").alias("start_ms"), F.col("duration_ms").cast("double").alias("end_ms"))
    status = stops.select(
        "media_id", F.when(complete, F.lit("complete")).otherwise(F.lit("paused")).alias("status"),
        F.coalesce("stop_ms", F.col("duration_ms").cast("double")).alias("cursor_ms"), "reason",
    )
    return states, gaps.unionByName(fades).unionByName(stopped).unionByName(tails), status


def gap_intervals(spans: DataFrame, media: DataFrame) -> DataFrame:
    """One interval per run of unreadable frames: from half way after the last readable frame to
    half way before the next one, or to the end of the recording. Kind of the first frame."""
    runs = spans.where("gap").groupBy("media_id", "gap_no").agg(
        F.min("middle").alias("start_ms"), F.min_by("kind", "t_ms").alias("kind"))
    after = spans.where(~F.col("gap") & (F.col("gap_no") > 0)).groupBy("media_id", "gap_no").agg(F.min("middle").alias("next_ms"))
    out = runs.join(after, ["media_id", "gap_no"], "left").join(media.select("media_id", "duration_ms"), "media_id")
    until = F.coalesce("next_ms", F.col("duration_ms").cast("double"))
    return out.where(until > F.col("start_ms")).select("media_id", "kind", "start_ms", until.alias("end_ms"))


def mark_gaps(frames: DataFrame) -> DataFrame:
    """frames(media_id, t_ms, kind) with gap columns for gap_intervals."""
    seen = ordered_scan(
        frames, ["media_id"], ["t_ms"], time_block("t_ms"), [Scan("prev", "lag", F.struct("t_ms", "kind"))])
    gap = F.col("kind").isin("black", "unobservable")
    first = gap & ~F.coalesce(F.col("prev.kind").isin("black", "unobservable"), F.lit(False))
    marked = seen.withColumns({"gap": gap, "middle": (F.coalesce("prev.t_ms", F.greatest(F.lit(0.0), F.col("t_ms") - 500.0)) + F.col("t_ms")) / 2, "g": first})
    return ordered_scan(
        marked, ["media_id"], ["t_ms"], time_block("t_ms"), [Scan("gap_no", "sum", F.when(F.col("g"), 1).otherwise(0).cast("bigint"))])


def audit_coverage(audit: DataFrame) -> DataFrame:
    return audit.groupBy("media_id", "kind").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("covered_ms"))


def representative_evidence(evidence: DataFrame) -> DataFrame:
    """Per state the newest capture that is at least as sharp as the first one."""
    first = evidence.groupBy("state_id").agg(F.min_by("sharpness", "ord").alias("__least"))
    return evidence.join(first, "state_id").where(F.col("sharpness") >= F.col("__least")).groupBy("state_id").agg(
        F.max_by("evidence_id", "ord").alias("representative_id"))


def tile_plan(images: DataFrame, max_side: int = MAX_SIDE, max_pixels: int = MAX_PIXELS) -> DataFrame:
    """images(image_id, width, height, bytes_per_pixel) to overlapping tiles within the limits, by the
    table function `tiles` next to each row. An image splits into a bounded number of tiles."""
    register_table_functions(images.sparkSession)
    return images.sparkSession.sql(
        "SELECT i.image_id, t.* FROM {images} i, LATERAL tiles(i.width, i.height, i.bytes_per_pixel, {side}, {pixels}) t",
        images=images, side=max_side, pixels=max_pixels,
    )


def refine_boundaries(changes: DataFrame, dense: DataFrame, grid: Grid = Grid(), step_ms: int = 200, slack_ms: int = 250) -> DataFrame:
    """changes(media_id, change_id, low_ms, high_ms, baseline, width, height, duration_ms) narrowed with
    dense frames(media_id, t_ms, pixels): the first changed frame inside the bracket, widened by the
    timing uncertainty and kept inside the recording. Frames and brackets meet in time bins, one bin per frame."""
    width_ms = 10_000
    bins = F.sequence(F.floor(F.col("low_ms") / width_ms), F.floor(F.col("high_ms") / width_ms))
    spread = changes.withColumn("bin", F.explode(bins))
    near = dense.select("media_id", "t_ms", "pixels", F.floor(F.col("t_ms") / width_ms).alias("bin"))
    pairs = spread.join(near, ["media_id", "bin"]).where((F.col("t_ms") > F.col("low_ms")) & (F.col("t_ms") <= F.col("high_ms")))

    @F.pandas_udf(BooleanType())
    def changed(a: pd.Series, b: pd.Series, w: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([compare(image(p, x, y), image(q, x, y), grid).changed for p, q, x, y in zip(a, b, w, h)])

    judged = pairs.withColumn("hit", changed("baseline", "pixels", "width", "height"))
    found = judged.groupBy("media_id", "change_id").agg(
        F.min(F.when(F.col("hit"), F.col("t_ms"))).alias("first_hit"))
    out = changes.join(found, ["media_id", "change_id"], "left")
    high = F.coalesce("first_hit", "high_ms")
    low = F.greatest(F.col("low_ms"), high - step_ms)
    return out.select(
        "media_id", "change_id", F.greatest(F.lit(0), low - slack_ms).cast("bigint").alias("low_ms"),
        F.least(F.col("duration_ms"), high + slack_ms).cast("bigint").alias("high_ms"))


def bisect_boundaries(
    changes: DataFrame, dense: DataFrame, grid: Grid = Grid(), step_ms: float = 200.0, slack_ms: float = 250.0
) -> DataFrame:
    """changes (as for refine_boundaries) narrowed by halving all brackets at once.

    A round probes one frame per open bracket, the one shown at its middle: the middles meet the frame
    times in one as-of scan, then only the probed frames are fetched. A bracket closes at `step_ms`, so
    the rounds are the binary logarithm of the widest one. The result is widened by the timing
    uncertainty and kept inside the recording. A middle with no frame before it counts as unchanged."""

    @F.pandas_udf(BooleanType())
    def changed(a: pd.Series, b: pd.Series, w: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([q is not None and compare(image(p, x, y), image(q, x, y), grid).changed for p, q, x, y in zip(a, b, w, h)])

    keys = ["media_id", "change_id"]
    # read by every round and by the result
    changes = stage_table(changes, "changes")
    fixed = changes.select(*keys, "baseline", "width", "height")
    ends = changes.select(*keys, F.col("low_ms").cast("double").alias("low_ms"), F.col("high_ms").cast("double").alias("high_ms"))
    times = dense.select("media_id", F.col("t_ms").cast("double").alias("t_ms"))
    found = dense.select("media_id", F.col("t_ms").cast("double").alias("probe_ms"), "pixels")
    ends = stage_table(ends, "brackets")
    while not (wide := ends.where(F.col("high_ms") - F.col("low_ms") > step_ms)).isEmpty():
        asked = wide.withColumn("middle", (F.col("low_ms") + F.col("high_ms")) / 2)
        shown = asof_join(asked, times, ["media_id"], F.col("middle"), F.col("t_ms"), ["t_ms"], prefix="shown", left_order=["change_id"])
        probes = shown.select(*asked.columns, F.col("shown.t_ms").alias("probe_ms")).join(found, ["media_id", "probe_ms"], "left")
        hit = changed("baseline", "pixels", "width", "height")
        judged = probes.join(fixed, keys).withColumn("hit", hit).select(
            *keys, F.when(F.col("hit"), F.col("low_ms")).otherwise(F.col("middle")).alias("low_ms"),
            F.when(F.col("hit"), F.col("middle")).otherwise(F.col("high_ms")).alias("high_ms"),
        )
        ends = stage_table(ends.where(F.col("high_ms") - F.col("low_ms") <= step_ms).unionByName(judged), "brackets")
    return ends.join(changes.select(*keys, "duration_ms"), keys).select(
        *keys, F.greatest(F.lit(0.0), F.col("low_ms") - slack_ms).alias("low_ms"),
        F.least(F.col("duration_ms").cast("double"), F.col("high_ms") + slack_ms).alias("high_ms"),
    )


def apply_provider(rows: DataFrame, provide: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Run a user's "rows to results" callable over batches; the callable sees one batch only."""

    def batches(it):
        for pdf in it:
            yield provide(pdf)

    return rows.mapInPandas(batches, schema)
