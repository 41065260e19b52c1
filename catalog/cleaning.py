"""Order-dependent cleaning. SQL cannot carry growing text, so these are rows-only here and
checked against brute force and golden cases in the tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.adapters import rolling_captions, segments
from catalog.base import query
from cuelake.plans import clean as C


@query("wn01_collapse_rolling_captions")
def _(t):
    return C.collapse_rolling(rolling_captions(t))


def marked_segments(t):
    """Cues whose text carries marks and names, from the turns of a conversation."""
    s = segments(t)
    named = F.when(F.col("speaker").isNotNull(), F.concat(F.lit(">> "), "speaker", F.lit(": "), "text"))
    return s.withColumns(
        {
            "text": F.coalesce(named, F.regexp_replace("text", ", ", " >> ")),
            "speaker": F.lit(None).cast("string"),
        }
    )


def collapsed_segments(t):
    s = marked_segments(t)
    return s.withColumns({"start_ms": F.col("start_ms").cast("double"), "dur_ms": F.col("dur_ms").cast("double")})


@query("wn10_explode_speaker_marks")
def _(t):
    return C.explode_speaker_marks(collapsed_segments(t))


@query("wn02_merge_sentences")
def _(t):
    return C.merge_sentences(C.explode_speaker_marks(collapsed_segments(t)))


@query("wn03_group_paragraphs")
def _(t):
    return C.group_paragraphs(C.explode_speaker_marks(collapsed_segments(t)))


@query("wn04_merge_contained")
def _(t):
    return C.merge_contained(C.explode_speaker_marks(collapsed_segments(t)))


@query("clean_transcript_segments")
def _(t):
    return C.clean_transcript(marked_segments(t)).segments


@query("clean_transcript_paragraphs")
def _(t):
    return C.clean_transcript(marked_segments(t)).paragraphs
