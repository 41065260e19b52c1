"""Raw cues to readable segments and paragraphs, for all recordings at once."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuelake.functions import text as T
from cuelake.functions.arrays import posexplode_rows
from cuelake.operators.folds import (
    FOLD_ROWS, Collapse, Contained, Sentences, block_fold, paragraph_chain,
    transcript_chain,
)
from cuelake.operators.joins import attach_key_values
from cuelake.operators.ordered import numbered, row_block
from cuelake.operators.paragraphs import fill_speakers
from cuelake.session import stage_table

KEY = ["media_id"]
CUE = "seq BIGINT, piece BIGINT, start_ms DOUBLE, dur_ms DOUBLE, text STRING, speaker STRING, turn_mark BOOLEAN"
FREQUENT_LEAD = 0.35


class Transcript(NamedTuple):
    segments: DataFrame
    paragraphs: DataFrame


def _speaker(c="speaker"):
    return F.nullif(F.col(c), F.lit(""))


def _normalized(cues: DataFrame) -> DataFrame:
    text = F.col("text")
    return cues.withColumn("text", F.when(T.may_change(text), T.normalize_cue_text(text)).otherwise(text))


def collapse_rolling(segments: DataFrame, fold_rows: int = FOLD_ROWS) -> DataFrame:
    """Rolling caption windows to single cues. Order: seq (of the cue that opened the item). The segments are
    read several times, so they should come from files."""
    ready = segments.select(
        "media_id", "seq", F.col("start_ms").cast("double").alias("start_ms"),
        F.col("dur_ms").cast("double").alias("dur_ms"),
        "text", _speaker().alias("speaker"),
    )
    return block_fold(
        ready, KEY, ["seq"], row_block(rows=fold_rows),
        ["seq", "start_ms", "dur_ms", "text", "speaker"], Collapse,
        "seq BIGINT, start_ms DOUBLE, dur_ms DOUBLE, text STRING, speaker STRING", _normalized, stored=True,
    )


def mark_share(cues: DataFrame) -> DataFrame:
    """share of a recording's cues that start with a mark, and whether marks are decoration there."""
    lead = F.regexp_like(T.trim(F.col("text")), F.lit("^(?:>>|»)")).cast("double")
    return cues.groupBy("media_id").agg(F.avg(lead).alias("share")).withColumn("decoration", F.col("share") >= FREQUENT_LEAD)


def explode_speaker_marks(cues: DataFrame) -> DataFrame:
    """Split cues at ``>>`` or ``»`` and lift ``Name:`` prefixes; a recording where at least
    35 % of cues start with a mark uses marks as decoration, so there they do not turn."""
    share = mark_share(cues).select("media_id", F.col("decoration").alias("frequent"))
    base = attach_key_values(cues, KEY, row_block(), share).withColumn(
        "raw", T.squash(F.replace("text", F.lit(" "), F.lit(" ")))
    ).withColumn("stripped", T.strip_leading_marks(F.col("raw")))
    base = base.where((F.col("raw") != "") & (F.col("stripped") != ""))
    source = F.when(F.col("frequent"), F.col("stripped")).otherwise(F.col("raw"))
    # Splitting at mark runs: the text before a leading run is an empty first piece.
    pieces = F.transform(F.split(source, ">>+|»+"), T.trim)
    split = base.withColumn("pieces", pieces).withColumns(
        {
            "total": F.greatest(
                F.lit(1),
                F.aggregate("pieces", F.lit(0), lambda acc, p: acc + F.length(p)),
            ),
            "interior": F.size("pieces") > 1,
        }
    )
    rows = posexplode_rows(split, ["*"], F.col("pieces"), "piece", "part").where(
        F.col("part") != ""
    )
    # Durations are shared by text length, at least 250 ms each; starts add up inside a cue.
    shared = F.when(
        F.col("frequent") & ~F.col("interior"), F.col("dur_ms")
    ).otherwise(F.greatest(F.lit(250.0), F.col("dur_ms") * (F.length("part") / F.col("total"))))
    rows = rows.withColumn("dur", shared)
    along = Window.partitionBy("media_id", "seq").orderBy("piece").rowsBetween(
        Window.unboundedPreceding, -1
    )
    # Marks are gone from a piece, so peeling it is lifting a leading name: in steps, which keeps
    # each generated expression small.
    peeled = rows.withColumn(
        "name",
        T.trim(
            F.coalesce(
                F.nullif(F.regexp_extract("part", T.LABELLED, 1), F.lit("")),
                F.regexp_extract("part", T.LABELLED, 2),
            )
        ),
    )
    fake = T.is_false_speaker(F.col("name")) & ~T.is_single_letter(F.col("name"))
    peeled = peeled.withColumn("lifted", (F.col("name") != "") & ~fake)
    said = F.when(F.col("lifted"), T.normalize_speaker(F.col("name")))
    rest = F.when(F.col("lifted"), T.trim(F.regexp_extract("part", T.LABELLED, 3))).otherwise(
        F.col("part")
    )
    mark = F.when(F.col("frequent"), F.col("lifted")).otherwise(
        (F.col("piece") > 0) | F.col("lifted")
    )
    return peeled.select(
        "media_id", "seq", F.col("piece").cast("bigint").alias("piece"),
        (F.col("start_ms") + F.coalesce(F.sum("dur").over(along), F.lit(0.0))).alias("start_ms"),
        F.col("dur").alias("dur_ms"), rest.alias("text"),
        F.coalesce(said, "speaker").alias("speaker"), mark.alias("turn_mark"),
    )


def merge_sentences(cues: DataFrame, fold_rows: int = FOLD_ROWS) -> DataFrame:
    """Exploded cues to sentence-like cues."""
    return block_fold(
        cues, KEY, ["seq", "piece"], row_block(rows=fold_rows),
        ["seq", "piece", "start_ms", "dur_ms", "text", "speaker", "turn_mark"], Sentences, CUE,
        _normalized,
    )


def group_paragraphs(cues: DataFrame, fold_rows: int = FOLD_ROWS) -> DataFrame:
    """Cues to paragraphs, then paragraphs that repeat their predecessor merged into it."""
    return block_fold(
        cues, KEY, ["seq", "piece"], row_block(rows=fold_rows),
        ["seq", "piece", "start_ms", "dur_ms", "text", "speaker", "turn_mark"], paragraph_chain,
        "kind STRING, " + CUE,
    ).drop("kind")


def merge_contained(paragraphs: DataFrame, fold_rows: int = FOLD_ROWS) -> DataFrame:
    """Merge each paragraph into its predecessor when it repeats it."""
    return block_fold(
        paragraphs, KEY, ["seq", "piece"], row_block(rows=fold_rows),
        ["seq", "piece", "start_ms", "dur_ms", "text", "speaker", "turn_mark"], Contained, CUE,
    )


def clean_transcript(segments: DataFrame, fold_rows: int = FOLD_ROWS) -> Transcript:
    """Collapse, split at marks, merge to sentences and paragraphs, fill speaker gaps.

    Sentences and paragraphs come from one pass over the cues. A recording whose cues are all
    noise keeps its split cues (or its collapsed ones) as segments.
    """
    collapsed = stage_table(collapse_rolling(segments, fold_rows), "collapsed")
    exploded = stage_table(explode_speaker_marks(collapsed), "exploded")
    folded = stage_table(
        block_fold(
            exploded, KEY, ["seq", "piece"], row_block(rows=fold_rows),
            ["seq", "piece", "start_ms", "dur_ms", "text", "speaker", "turn_mark"],
            transcript_chain, "kind STRING, " + CUE, _normalized,
        ),
        "folded",
    )
    sentences = folded.where(F.col("kind") == "sentence").drop("kind")
    with_sentence = sentences.select("media_id").distinct()
    only_noise = exploded.join(with_sentence, "media_id", "left_anti")
    with_cue = exploded.select("media_id").distinct()
    whole = collapsed.join(with_cue, "media_id", "left_anti").select(
        "media_id", "seq", F.lit(0).cast("bigint").alias("piece"), "start_ms", "dur_ms", "text",
        "speaker", F.lit(False).alias("turn_mark"),
    )
    segs = sentences.unionByName(only_noise).unionByName(whole)
    paras = (
        folded.where(F.col("kind") == "paragraph").drop("kind")
        .unionByName(group_paragraphs(only_noise, fold_rows))
    )
    order = ["seq", "piece"]
    segs = numbered(segs, KEY, order, row_block(), "n")
    paras = numbered(paras, KEY, order, row_block(), "n")
    columns = ["start_ms", "dur_ms", "text", "speaker"]
    done = paras.select("media_id", F.col("n").alias("seq"), *columns, "turn_mark")
    return Transcript(
        segs.select("media_id", F.col("n").alias("seq"), *columns),
        fill_speakers(done).select("media_id", "seq", *columns, "turn_mark"),
    )


