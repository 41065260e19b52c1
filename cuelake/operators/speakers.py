"""Speaker labels on paragraphs. ``names`` is an array column of trimmed plausible names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.functions import text as T
from cuelake.operators.folds import FOLD_ROWS
from cuelake.operators.joins import attach_key_values, attach_speakers, own_segments
from cuelake.operators.ordered import Scan, ordered_scan, row_block
from cuelake.session import stage_table

KEY = ["media_id"]


def with_names(paragraphs: DataFrame, names: DataFrame) -> DataFrame:
    """names(media_id, names) joined onto every paragraph, plausible ones only."""
    clean = names.select("media_id", T.plausible_names(F.col("names")).alias("names"))
    out = attach_key_values(paragraphs, KEY, row_block(), clean)
    return out.withColumn("names", F.coalesce("names", F.array().cast("array<string>")))


def apply_names(paragraphs: DataFrame) -> DataFrame:
    """Remap every label onto the names, or clear it."""
    return paragraphs.withColumn("speaker", T.remap_speaker(F.col("speaker"), F.col("names"))).drop("names")


def apply_turns(paragraphs: DataFrame, turns: DataFrame) -> DataFrame:
    """turns(media_id, pos, i, speaker) by paragraph index: the last usable duplicate wins, else
    the paragraph's own remapped label, else the last speaker carried forward."""
    said = turns.where(F.col("i") >= 0).join(
        paragraphs.select("media_id", F.col("seq").alias("i"), "names"), ["media_id", "i"], "inner"
    ).withColumn("name", T.remap_speaker(F.col("speaker"), F.col("names"))).where(T.present(F.col("name")))
    chosen = said.groupBy("media_id", F.col("i").alias("seq")).agg(F.max_by("name", "pos").alias("named"))
    own = paragraphs.join(chosen, ["media_id", "seq"], "left").withColumn(
        "__own", F.coalesce("named", T.remap_speaker(F.col("speaker"), F.col("names")))
    )
    out = ordered_scan(own, KEY, ["seq"], row_block(), [Scan("__last", "last", F.col("__own"))])
    return out.withColumn("speaker", F.col("__last")).select(
        *[c for c in paragraphs.columns if c != "names"]
    )


def _interview_facts(paragraphs: DataFrame) -> DataFrame:
    """What the roles need of a text: does it ask, is it long, is it brief. Of a text whose beginning is
    long already the rest is not read."""
    size = lambda c: F.length(F.regexp_replace(c, f"{T.MAY_BE_SPACE}[{T.SPACE}]+", ""))
    compact = F.when(size(F.substring("text", 1, 64)) > 24, 25).otherwise(size(F.col("text")))
    hangul = T.hangul_count(F.col("text"))
    return paragraphs.withColumns({
        "asks": T.looks_like_question(F.col("text")),
        "long": (compact > 24) | (hangul > 16),
        "brief": (compact < 14) & (hangul < 10),
    })


def _interview_roles(facts: DataFrame, fold_rows: int = FOLD_ROWS) -> DataFrame:
    """The speaker of every row of `_interview_facts` with names.

    An own label or a question sets the role, the first one being the host's. From then on a long text
    moves the host's role to the guest and a brief one the guest's to the host, so what counts is the last
    of these moves, if the role set before it was one of the two."""
    s = F.col("speaker")
    remapped = T.remap_speaker(s, F.col("names"))
    host, guest = F.get("names", F.lit(0)), F.get("names", F.lit(1))
    existing = F.when(T.present(s) & ~T.is_single_letter(s), F.coalesce(remapped, s))
    told = F.coalesce(existing, F.when(F.col("asks"), host))
    moved = F.when(F.col("long"), guest).when(F.col("brief") & (F.col("seq") > 0), host)
    at = lambda c: F.when(c.isNotNull(), F.struct("seq", c.alias("role")))
    seen = ordered_scan(
        facts, KEY, ["seq"], row_block(rows=fold_rows), [Scan("__told", "last", at(told)), Scan("__moved", "last", at(moved))])
    base = F.coalesce("__told.role", host)
    free = base.isin(host, guest) & (F.col("__moved.seq") > F.coalesce("__told.seq", F.lit(-1)))
    role = F.when(free, F.col("__moved.role")).otherwise(base)
    few = F.when(F.size("names") == 0, F.when(~T.is_single_letter(s), s)).otherwise(F.coalesce(remapped, host))
    keep = [c for c in facts.columns if c not in ("names", "speaker", "asks", "long", "brief")]
    return seen.select(*keep, F.when(F.size("names") >= 2, role).otherwise(few).alias("speaker"))


def label_interview(paragraphs: DataFrame, fold_rows: int = FOLD_ROWS) -> DataFrame:
    """Interview roles: no names strips single-letter labels, one name labels everything, two or
    more keep remapped labels and assign host and guest by question and length."""
    return _interview_roles(_interview_facts(paragraphs), fold_rows)


def finish_labels(
    segments: DataFrame, paragraphs: DataFrame, summaries: DataFrame, turns: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Label paragraphs by the kind of each recording, then its segments.

    summaries(media_id, kind, summary, speakers array); turns(media_id, pos, i, speaker).
    The rows that the three rules read, and the labels they give, are written once, without texts."""
    with_turns = turns.select("media_id").distinct().withColumn("has_turns", F.lit(True))
    named = summaries.select(
        "media_id", "kind",
        F.when(F.size("speakers") > 0, F.col("speakers")).otherwise(
            T.speakers_from_summary(F.col("summary"))
        ).alias("names"),
    ).withColumn("names", T.plausible_names(F.col("names"))).join(with_turns, "media_id", "left")
    said = ["media_id", "seq", "start_ms", "dur_ms", "speaker"]
    facts = ["asks", "long", "brief"]
    known = attach_key_values(_interview_facts(paragraphs).select(*said, *facts), KEY, row_block(), named)
    rows = stage_table(known.withColumn("names", F.coalesce("names", F.array().cast("array<string>"))), "label_rows")
    talk = F.coalesce(F.col("kind").isin("interview", "podcast"), F.lit(False))
    of = lambda which, *more: rows.where(which).select(*said, "names", *more)
    labels = stage_table(
        apply_turns(of(talk & F.col("has_turns").isNotNull()), turns)
        .unionByName(_interview_roles(of(talk & F.col("has_turns").isNull(), *facts)))
        .unionByName(apply_names(of(~talk))),
        "labels",
    )
    out = paragraphs.drop("speaker").join(labels.select("media_id", "seq", "speaker"), ["media_id", "seq"])
    return attach_speakers(segments, labels), out.select(*paragraphs.columns)


def speaker_names(paragraphs: DataFrame, segments: DataFrame) -> DataFrame:
    """Distinct speakers in first-seen order, paragraphs before segments: (media_id, pos, speaker).
    The rank runs over one row per speaker, after the distinct."""
    side = lambda df, n: df.where(T.present(F.col("speaker"))).select(
        "media_id", "speaker", F.struct(F.lit(n).alias("side"), F.col("seq").alias("seq")).alias("at")
    )
    first = side(paragraphs, 0).unionByName(side(segments, 1)).groupBy("media_id", "speaker").agg(
        F.min("at").alias("at")
    ).select("media_id", "speaker", F.col("at.side").alias("side"), F.col("at.seq").alias("seq"))
    block = (F.col("side") * (1 << 40) + F.floor(F.col("seq") / 65_536)).cast("bigint")
    out = ordered_scan(first, KEY, ["side", "seq", "speaker"], block, [Scan("pos", "position")])
    return out.select("media_id", "pos", "speaker")


def update_paragraphs(
    segments: DataFrame, paragraphs: DataFrame, edits: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Apply edits(media_id, seq, text, speaker[, set_speaker]) to both tables; also the records of
    the edits that changed something: (media_id, start_ms, text, speaker) as they are now.

    A null text keeps the text. The speaker is set where ``set_speaker`` holds (a blank one clears
    it); without that column, where a speaker is given. A text change replaces the segments that the
    paragraph owns before its end by one segment, or by nothing when blank; a change of the speaker
    alone relabels them. An edit that changes nothing leaves the segments as they are."""
    sets = F.coalesce("set_speaker", F.lit(False)) if "set_speaker" in edits.columns else F.col("speaker").isNotNull()
    e = edits.select(
        "media_id", "seq", F.col("text").alias("e_text"), F.nullif(T.trim(F.col("speaker")), F.lit("")).alias("e_speaker"),
        sets.alias("e_sets"), F.lit(True).alias("hit"),
    )
    p = paragraphs.join(e, ["media_id", "seq"], "left").withColumns({
        "n_text": F.coalesce("e_text", "text"),
        "n_speaker": F.when(F.coalesce("e_sets", F.lit(False)), F.col("e_speaker")).otherwise(F.col("speaker")),
    })
    p = p.withColumns({
        "retext": F.col("hit").isNotNull() & ~F.col("n_text").eqNullSafe(F.col("text")),
        "respeak": F.col("hit").isNotNull() & ~F.col("n_speaker").eqNullSafe(F.col("speaker")),
        "end_of": F.col("start_ms") + F.greatest(F.col("dur_ms"), F.lit(400)),
    })
    changed = p.where("retext or respeak").select(
        "media_id", F.col("seq").alias("owner_seq"), F.col("retext").alias("__retext"), F.col("end_of").alias("__end"),
        F.col("n_speaker").alias("__who"), F.lit(True).alias("__hit"),
    )
    owned = own_segments(segments, paragraphs).join(changed, ["media_id", "owner_seq"], "left")
    gone = F.coalesce(F.col("__retext") & (F.col("start_ms") < F.col("__end")), F.lit(False))
    relabel = F.coalesce(F.col("__hit") & ~F.col("__retext"), F.lit(False))
    kept = owned.where(~gone).select(
        "media_id", F.col("seq").cast("double").alias("ord"), "start_ms", "dur_ms", "text",
        F.when(relabel, F.col("__who")).otherwise(F.col("speaker")).alias("speaker"), F.lit(1).alias("side"),
    )
    fresh = p.where(F.col("retext") & (T.trim(F.col("n_text")) != "")).select(
        "media_id", F.col("seq").cast("double").alias("ord"), "start_ms", "dur_ms", F.col("n_text").alias("text"),
        F.col("n_speaker").alias("speaker"), F.lit(0).alias("side"),
    )
    out = ordered_scan(
        kept.unionByName(fresh), KEY, ["start_ms", "side", "ord"], F.floor(F.col("start_ms") / 600_000).cast("bigint"), [Scan("seq", "position")]
    )
    new_p = p.withColumns({"text": F.col("n_text"), "speaker": F.col("n_speaker")})
    return (
        out.select("media_id", "seq", "start_ms", "dur_ms", "text", "speaker"),
        new_p.select(*paragraphs.columns),
        new_p.where("retext or respeak").select("media_id", "start_ms", "text", "speaker"),
    )


def rename_speakers(
    segments: DataFrame, paragraphs: DataFrame, renames: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """renames(old, new[, ord]): paragraphs by label, segments by their owner's label, or by their
    own when the owner has none; also the edit records of the renamed paragraphs. A blank new name
    clears the label. Of several rows for one old name the last counts, by ``ord`` or as listed."""
    at = F.col("ord") if "ord" in renames.columns else F.monotonically_increasing_id()
    last = renames.where(F.col("old").isNotNull()).withColumn("__at", at).groupBy("old").agg(
        F.max_by(F.struct("new"), "__at").alias("__to")
    ).select(F.col("old").alias("__old"), F.nullif(T.trim(F.coalesce("__to.new", F.lit(""))), F.lit("")).alias("__new"), F.lit(True).alias("__hit"))
    last = last.where(~F.col("__old").eqNullSafe(F.col("__new")))
    own = own_segments(segments, paragraphs)
    label = F.coalesce(F.nullif(F.col("owner_speaker"), F.lit("")), F.col("speaker"))
    named = F.when(F.col("__hit"), F.col("__new")).otherwise(F.col("speaker"))
    moved = own.withColumn("__label", label).join(last, F.col("__label") == F.col("__old"), "left")
    told = paragraphs.join(last, F.col("speaker") == F.col("__old"), "left").withColumn("speaker", named)
    return (
        moved.withColumn("speaker", named).select(*segments.columns),
        told.select(*paragraphs.columns),
        told.where("__hit").select("media_id", "start_ms", "text", "speaker"),
    )
