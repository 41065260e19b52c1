"""Paragraph rules that need only windows, and their statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.functions import text as T
from cuelake.operators.ordered import Scan, fill_forward_then_back, ordered_scan, row_block

KEY = ["media_id"]


def fill_speakers(rows: DataFrame, name: str = "speaker") -> DataFrame:
    """Forward fill the speaker, then the head of the recording takes the first one."""
    v = "speaker"
    rows = rows.withColumn(v, F.nullif(F.col(v), F.lit("")))
    filled = fill_forward_then_back(rows, KEY, ["seq"], row_block(), v, "__who")
    return filled.withColumn(name, F.col("__who")).drop("__who")


def mark_paragraphs(segments: DataFrame, pause_ms: int = 2600, span_ms: int = 14000) -> DataFrame:
    """Paragraph ordinal per cue: a new one at a speaker change, a pause, or a new span of time.

    The span slot also bounds a paragraph, so its text always fits one aggregate.
    """
    who = F.col("speaker")
    seen = ordered_scan(
        segments, KEY, ["seq"], row_block(),
        [
            Scan("__prev_who", "last_before", who),
            Scan("__next_who", "next", who),
            Scan("__prev_start", "lag", F.col("start_ms")),
            Scan("__prev_end", "lag", F.col("start_ms") + F.col("dur_ms")),
        ],
    )
    starts = (
        T.speakers_differ(who, F.col("__prev_who"))
        | (F.col("start_ms") - F.col("__prev_end") >= pause_ms)
        | (F.floor(F.col("start_ms") / span_ms) != F.floor(F.col("__prev_start") / span_ms))
    )
    marked = seen.withColumns(
        {
            "who": F.coalesce(who, "__prev_who", "__next_who"),
            "__break": F.when(F.coalesce(starts, F.lit(False)), 1).otherwise(0),
        }
    )
    out = ordered_scan(
        marked, KEY, ["seq"], row_block(), [Scan("p_seq", "sum", F.col("__break").cast("bigint"))]
    )
    return out.select(*segments.columns, "who", "p_seq")


def window_paragraphs(segments: DataFrame) -> DataFrame:
    """paragraphs(media_id, seq, start_ms, dur_ms, text, speaker) from the window rules."""
    marked = mark_paragraphs(segments)
    lines = F.array_sort(F.collect_list(F.struct("seq", "text")))
    return marked.groupBy("media_id", "p_seq").agg(
        F.min("start_ms").alias("start_ms"),
        F.greatest(F.lit(400), F.max(F.col("start_ms") + F.col("dur_ms")) - F.min("start_ms"))
        .cast("bigint").alias("dur_ms"),
        F.array_join(F.transform(lines, lambda x: x["text"]), " ").alias("text"),
        F.min("who").alias("speaker"),
    ).select("media_id", F.col("p_seq").alias("seq"), "start_ms", "dur_ms", "text", "speaker")


def extent(segments: DataFrame) -> DataFrame:
    """End of the last segment and number of segments per recording."""
    return segments.groupBy("media_id").agg(
        F.max(F.col("start_ms") + F.col("dur_ms")).alias("duration_ms"), F.count(F.lit(1)).alias("segment_count")
    )


def spoken(paragraphs: DataFrame) -> DataFrame:
    """Paragraphs that say something."""
    return paragraphs.where(T.trim(F.col("text")) != "")


def reading_stats(paragraphs: DataFrame, by: list[str]) -> DataFrame:
    """Words, Korean syllables and paragraphs per group; partial sums make it skew-safe."""
    return paragraphs.groupBy(*by).agg(
        F.count(F.lit(1)).cast("bigint").alias("n_paragraphs"),
        F.sum(T.word_count(F.col("text"))).cast("bigint").alias("words"),
        F.sum("dur_ms").cast("bigint").alias("spoken_ms"),
    )
