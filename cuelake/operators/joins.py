"""As-of, interval and content-keyed joins. No operator pairs all rows of a key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.functions import text as T
from cuelake.operators.ordered import Scan, ordered_scan, row_block, time_block


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_at: Column,
    right_at: Column,
    right_order: Sequence[str],
    direction: str = "backward",
    prefix: str = "r",
    width_ms: int = 600_000,
    left_order: Sequence[str] = ("seq",),
) -> DataFrame:
    """Each left row with the last right row at or before it (backward) or the first at or
    after it (forward), as struct column ``prefix``; null when there is none. ``both`` gives the
    last at or before as ``prefix`` and the first strictly after as ``prefix``_next.

    Both sides are stacked and scanned in time order, so a busy key is read block by block.
    """
    if direction not in ("backward", "forward", "both"):
        raise ValueError("direction is backward, forward or both")
    left_cols = [c for c in left.columns if c not in keys]
    right_cols = [c for c in right.columns if c not in keys]
    blank_left = F.lit(None).cast(left.select(F.struct(*left_cols).alias("s")).schema["s"].dataType)
    blank_right = F.lit(None).cast(
        right.select(F.struct(*right_cols).alias("s")).schema["s"].dataType
    )
    # At equal times a right row must be seen first going forward in time, and last otherwise.
    right_side, left_side = (1, 0) if direction == "forward" else (0, 1)

    def ranks(columns: Sequence[str], real: bool) -> Column:
        return F.struct(
            *[
                (F.col(c).cast("double") if real else F.lit(0.0)).alias(f"o{i}")
                for i, c in enumerate(columns)
            ]
        )

    def side(df: DataFrame, at: Column, number: int, lcol: Column, rcol: Column) -> DataFrame:
        from_left = number == left_side
        return df.select(
            *keys,
            at.cast("double").alias("__t"),
            F.lit(number).alias("__side"),
            ranks(right_order, not from_left).alias("__rank"),
            ranks(left_order, from_left).alias("__tie"),
            lcol.alias("__l"),
            rcol.alias("__r"),
        )

    stacked = side(left, left_at, left_side, F.struct(*left_cols), blank_right).unionByName(
        side(right, right_at, right_side, blank_left, F.struct(*right_cols))
    )
    scans = [Scan("__hit", "next" if direction == "forward" else "last", F.col("__r"))]
    hits = [F.col("__hit").alias(prefix)]
    if direction == "both":
        scans.append(Scan("__after", "next", F.col("__r")))
        hits.append(F.col("__after").alias(f"{prefix}_next"))
    scanned = ordered_scan(
        stacked,
        keys,
        ["__t", "__side", "__rank", "__tie"],
        time_block("__t", width_ms),
        scans,
    )
    return scanned.where(F.col("__side") == left_side).select(
        *keys, *[F.col(f"__l.{c}").alias(c) for c in left_cols], *hits
    )


def attach_key_values(
    df: DataFrame, keys: Sequence[str], block: Column, values: DataFrame
) -> DataFrame:
    """Join one row per key back onto its rows without sending a key to one task: the values
    go to the key's blocks first, and the blocks join the rows."""
    keys = list(keys)
    base = df.withColumn("__blk", block)
    spread = base.select(*keys, "__blk").distinct().join(values, keys, "inner")
    return base.join(spread, [*keys, "__blk"], "left").drop("__blk")


def own_segments(segments: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Owner of a segment: the last paragraph that starts at or before it (null when none)."""
    right = paragraphs.select("media_id", F.col("seq").alias("p_seq"), "start_ms", "speaker")
    out = asof_join(
        segments, right, ["media_id"], F.col("start_ms"), F.col("start_ms"), ["p_seq"], prefix="owner"
    )
    return out.select(
        *segments.columns,
        F.col("owner.p_seq").alias("owner_seq"),
        F.col("owner.speaker").alias("owner_speaker"),
    )


def region_at(frames: DataFrame, regions: DataFrame) -> DataFrame:
    """Latest region at or before a frame; before all of them, the first *listed* region."""
    out = asof_join(
        frames, regions, ["media_id"], F.col("t_ms"), F.col("time_ms"), ["pos"],
        prefix="region", left_order=["t_ms"],
    )
    first = regions.groupBy("media_id").agg(
        F.min_by(F.struct(*[c for c in regions.columns if c != "media_id"]), F.col("pos")).alias(
            "__first"
        )
    )
    both = attach_key_values(out, ["media_id"], time_block("t_ms"), first)
    return both.withColumn("region", F.coalesce("region", "__first")).drop("__first")


def attach_speakers(segments: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Segments without a real speaker take the speaker of the first paragraph that covers
    them, 50 ms before its start to 150 ms after its end.

    The first paragraph whose end reaches a segment is where the running maximum of ends
    first reaches it, so this is a forward as-of join on that maximum. Paragraphs are in
    start order, which makes it the first match or proves that there is none.
    """
    reach = ordered_scan(
        paragraphs.select(
            "media_id", F.col("seq").alias("p_seq"), F.col("start_ms").alias("p_start"),
            (F.col("start_ms") + F.col("dur_ms") + 150).alias("p_end"), F.col("speaker").alias("who"),
        ),
        ["media_id"], ["p_seq"], row_block("p_seq"), [Scan("reach", "max", F.col("p_end"))],
    )
    out = asof_join(
        segments, reach, ["media_id"], F.col("start_ms"), F.col("reach"), ["p_seq"],
        direction="forward", prefix="hit",
    )
    covered = F.col("hit.p_start") - 50 <= F.col("start_ms")
    own = T.present(F.col("speaker")) & ~T.is_single_letter(F.col("speaker"))
    found = F.when(covered, F.nullif(F.col("hit.who"), F.lit("")))
    return out.withColumn(
        "speaker",
        F.when(own, F.col("speaker")).otherwise(F.coalesce(found, F.col("speaker"))),
    ).drop("hit")


def pending_chunks(plan: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Planned chunks that have no checkpoint yet."""
    return plan.join(checkpoints.select("media_id", "id"), ["media_id", "id"], "left_anti")


def previous_context(
    plan: DataFrame, checkpoints: DataFrame, chars: int = 400, slack_ms: int = 50
) -> DataFrame:
    """Tail of the latest checkpoint that ends at or just after the start of a planned core."""
    right = checkpoints.select("media_id", "core_end", F.col("idx").alias("c_idx"), "text")
    out = asof_join(
        plan, right, ["media_id"], F.col("core_start") + slack_ms, F.col("core_end"),
        ["c_idx"], prefix="prev", left_order=["idx"],
    )
    tail = F.coalesce(F.expr(f"right(prev.text, {chars})"), F.lit(""))
    return out.withColumn("context", tail).drop("prev")


def overlay_edits(paragraphs: DataFrame, edits: DataFrame) -> DataFrame:
    """Edited fields win; an edit that clears the speaker clears it. Keyed on the exact start,
    so the join is one-to-one and the (media, start) key spreads a busy recording."""
    e = edits.select(
        "media_id", "start_ms", F.col("text").alias("e_text"), F.col("speaker").alias("e_speaker"),
        F.lit(True).alias("e_hit"),
    )
    out = paragraphs.join(e, ["media_id", "start_ms"], "left")
    hit = F.col("e_hit").isNotNull()
    return out.withColumns(
        {
            "text": F.when(hit, F.col("e_text")).otherwise(F.col("text")),
            "speaker": F.when(hit, F.col("e_speaker")).otherwise(F.col("speaker")),
        }
    ).select(*paragraphs.columns)


def evidence_mismatches(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Per evidence: rectangles missing on either side or with another hash, and the counts."""
    box = ["evidence_id", "x", "y", "width", "height", "full_width", "full_height", "hash"]
    a = stored.groupBy(*box).agg(F.count(F.lit(1)).alias("n_stored"))
    b = fresh.groupBy(*box).agg(F.count(F.lit(1)).alias("n_fresh"))
    both = a.join(b, box, "full_outer")
    report = both.groupBy("evidence_id").agg(
        F.sum(F.coalesce("n_stored", F.lit(0))).cast("bigint").alias("stored"),
        F.sum(F.coalesce("n_fresh", F.lit(0))).cast("bigint").alias("fresh"),
        F.sum(F.when(F.col("n_fresh").isNull(), F.col("n_stored")).otherwise(0))
        .cast("bigint").alias("missing"),
        F.sum(F.when(F.col("n_stored").isNull(), F.col("n_fresh")).otherwise(0))
        .cast("bigint").alias("unexpected"),
    )
    return report.withColumn(
        "mismatch", (F.col("missing") > 0) | (F.col("stored") != F.col("fresh"))
    )


def nearest_silence(targets: DataFrame, silences: DataFrame) -> DataFrame:
    """Cut for each target: the nearest midpoint of a silence of at least 700 ms within 15 s,
    strictly inside the recording, ties by input order; the target itself when there is none.

    ``targets``: media_id, target_ms, duration_ms. Only the midpoints next to a target can be
    nearest, so one as-of scan in both directions replaces the range join.
    """
    mids = (
        silences.where(F.col("end_ms") - F.col("start_ms") >= 700)
        .select("media_id", ((F.col("start_ms") + F.col("end_ms")) / 2).alias("mid"), "pos")
        .groupBy("media_id", "mid").agg(F.min("pos").alias("pos"))
    )
    # Midpoints at or past the end of the recording never qualify: they would hide nothing on
    # the left, and on the right they are rejected together with everything after them.
    mids = mids.where(F.col("mid") > 0)
    both = asof_join(
        targets, mids, ["media_id"], F.col("target_ms"), F.col("mid"), ["pos"], "both", "near",
        left_order=["target_ms"],
    )

    def candidate(side: str) -> Column:
        mid = F.col(f"{side}.mid")
        away = F.abs(mid - F.col("target_ms"))
        return F.when(
            (away <= 15_000) & (mid < F.col("duration_ms")),
            F.struct(away.alias("away"), F.col(f"{side}.pos").alias("pos"), mid.alias("mid")),
        )

    best = F.least(candidate("near"), candidate("near_next"))
    return both.select(
        "media_id", "target_ms", "duration_ms",
        F.coalesce(best["mid"], F.col("target_ms").cast("double")).alias("cut_ms"),
    )
