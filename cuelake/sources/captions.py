"""Landed caption payloads to segments and tracks. A payload is one row, so its events are
handled by array functions inside the row and nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from cuelake import schemas
from cuelake.functions import clock as K
from cuelake.functions import text as T
from cuelake.functions.arrays import posexplode_rows

# Markers of the markdown payload.
IGNORED_LINES = ["To request", "Interactive version"]
HEADER_LINES = ["Source video:", "Language:", "Other available", "To request", "Interactive version"]
TIMED_LINE = f"^(\\[(?:\\d{{1,2}}:)?\\d{{1,2}}:\\d{{2}}\\])[{T.SPACE}]*(.*)$"
LAST_CHUNK_SEC = 4.0


def _segments(df: DataFrame, cues: Column) -> DataFrame:
    """Explode an array of struct(start_ms, dur_ms, text); blank cues are gone already."""
    return posexplode_rows(df, ["media_id"], cues, "seq", "cue").select(
        "media_id", F.col("seq").cast("bigint").alias("seq"), "cue.start_ms", "cue.dur_ms", "cue.text"
    )


def json3_cues(payload: Column) -> Column:
    events = F.from_json(payload, schemas.JSON3_PAYLOAD)["events"]

    def cue(e: Column) -> Column:
        parts = F.filter(
            F.transform(F.coalesce(e["segs"], F.array()), lambda s: F.coalesce(s["utf8"], F.lit(""))),
            lambda s: (s != "") & (s != "\n"),
        )
        return F.struct(
            F.coalesce(e["tStartMs"], F.lit(0)).cast("bigint").alias("start_ms"),
            F.coalesce(e["dDurationMs"], F.lit(1000)).cast("bigint").alias("dur_ms"),
            T.squash(F.array_join(parts, "")).alias("text"),
        )

    return F.filter(F.transform(events, cue), lambda c: c["text"] != "")


def read_caption_json3(payloads: DataFrame) -> DataFrame:
    """payloads(media_id, payload): JSON caption events."""
    return _segments(payloads, json3_cues(F.col("payload")))


def timedtext_cues(payload: Column) -> Column:
    # the markup patterns here and below are fixed values
    block = F.lit("(?i)<p\\b([^>]*)>([\\s\\S]*?)</p>")
    pairs = F.arrays_zip(
        F.regexp_extract_all(payload, block, 1).alias("attrs"),
        F.regexp_extract_all(payload, block, 2).alias("inner"),
    )

    def number(attrs: Column, name: str, default: int) -> Column:
        found = F.regexp_extract(attrs, f'\\b{name}="(\\d+)"', 1)
        return F.coalesce(found.try_cast("bigint"), F.lit(default).cast("bigint"))

    def cue(p: Column) -> Column:
        inner = F.regexp_replace(p["inner"], "(?i)<s\\b[^>]*>|</s>", "")
        inner = F.regexp_replace(F.regexp_replace(inner, "(?i)<br\\s*/?>", " "), "<[^>]+>", "")
        return F.struct(
            number(p["attrs"], "t", 0).alias("start_ms"),
            number(p["attrs"], "d", 1000).alias("dur_ms"),
            T.squash(T.decode_entities(inner)).alias("text"),
        )

    renamed = F.transform(
        pairs, lambda p: F.struct(p["attrs"].alias("attrs"), p["inner"].alias("inner"))
    )
    return F.filter(F.transform(renamed, cue), lambda c: c["text"] != "")


def read_timedtext_xml(payloads: DataFrame) -> DataFrame:
    """payloads(media_id, payload): every timed <p> element."""
    return _segments(payloads, timedtext_cues(F.col("payload")))


def read_captions(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Choose the parser by the first character: JSON events, else timed markup when those gave
    nothing. Returns (segments, failures) where a failure has code ``no_captions``."""
    body = T.trim(F.col("payload"))
    empty = F.array().cast("array<struct<start_ms: bigint, dur_ms: bigint, text: string>>")
    from_json = F.when(F.startswith(body, F.lit("{")), json3_cues(body))
    from_xml = F.when(F.startswith(body, F.lit("<")), timedtext_cues(body))
    both = payloads.withColumn("__json", F.coalesce(from_json, empty)).withColumn(
        "__cues",
        F.when(F.size("__json") > 0, F.col("__json")).otherwise(F.coalesce(from_xml, empty)),
    )
    # Each parser is asked once: the choice of both would parse JSON again for every mention of it.
    failures = both.where((F.size("__json") == 0) & (F.size(F.coalesce(from_xml, empty)) == 0)).select(
        "media_id", F.lit("no_captions").alias("code")
    )
    return _segments(both, F.col("__cues")), failures


# -- markdown transcripts ----------------------------------------------------------------


def available_languages(line: Column) -> Column:
    """array<struct(language_code, source_type, is_auto)> from 'Name (code) [auto], ...'."""
    pattern = f"([a-zA-Z][A-Za-z0-9_-]*)[{T.SPACE}]*\\(([A-Za-z0-9_-]+)\\)([{T.SPACE}]*\\[auto\\])?"
    zipped = F.arrays_zip(
        F.regexp_extract_all(line, F.lit(pattern), 1).alias("name"),
        F.regexp_extract_all(line, F.lit(pattern), 2).alias("code"),
        F.regexp_extract_all(line, F.lit(pattern), 3).alias("auto"),
    )

    def track(x: Column) -> Column:
        auto = (x["auto"] != "") | F.startswith(x["name"], F.lit("a-"))
        return F.struct(
            x["code"].alias("language_code"),
            F.when(auto, "asr").otherwise("manual").alias("source_type"),
            auto.alias("is_auto"),
        )

    return F.transform(zipped, track)


def markdown_fields(payloads: DataFrame) -> DataFrame:
    """Add header fields and the cue array ``cues`` of markdown transcripts."""
    text = F.regexp_replace("payload", "^\\ufeff", "")
    grab = lambda c, p: F.nullif(T.trim(F.regexp_extract(c, p, 1)), F.lit(""))
    df = payloads.withColumn("__text", text).withColumns(
        {
            "title": F.coalesce(
                grab(F.col("__text"), "(?m)^#\\s*Transcript:[ \\t]*(.+)$"),
                grab(F.col("__text"), "(?m)^#[ \\t]+(.+)$"),
                F.col("media_id").cast("string"),
            ),
            "__lang": F.regexp_extract("__text", "(?m)^Language:[ \\t]*(.+)$", 1),
            "__other": F.regexp_extract("__text", "(?m)^Other available languages:[ \\t]*(.+)$", 1),
            "__parts": F.split("__text", "(?m)^##[ \\t]*Transcript[ \\t]*$"),
        }
    )
    token = F.split(T.trim(F.split("__lang", "[·•|,]")[0]), f"[{T.SPACE}]+")[0]
    code = F.regexp_replace(token, "[^A-Za-z0-9-]", "")
    df = df.withColumns(
        {
            "language": F.when(code == "", "und").otherwise(code),
            "is_auto": F.regexp_like("__lang", F.lit("(?i)\\[auto\\]|\\basr\\b|auto-generated")),
            "duration_sec": K.parse_duration(
                F.regexp_extract("__lang", "(?i)Duration:[ \\t]*([0-9:]+)", 1)
            ),
            "__listed": available_languages(F.col("__other")),
            "__body": F.coalesce(F.get("__parts", F.lit(1)), F.col("__text")),
        }
    )
    own = F.struct(
        F.col("language").alias("language_code"),
        F.when(F.col("is_auto"), "asr").otherwise("manual").alias("source_type"),
        F.col("is_auto").alias("is_auto"),
    )
    known = F.exists("__listed", lambda x: T.lang_matches(x["language_code"], F.col("language")))
    lines = F.filter(
        F.transform(F.split("__body", "\n"), T.trim),
        lambda s: (s != "") & ~F.regexp_like(s, F.lit("^(?:" + "|".join(IGNORED_LINES) + ")")),
    )
    df = df.withColumns(
        {
            "available": F.when(known, F.col("__listed")).otherwise(
                F.concat(F.array(own), "__listed")
            ),
            "__lines": lines,
        }
    )
    # One entry per line: its start in seconds when it opens a chunk, and its words.
    df = df.withColumn(
        "__lines",
        F.transform(
            "__lines",
            lambda s: F.struct(
                K.parse_timestamp_token(F.regexp_extract(s, TIMED_LINE, 1)).alias("at"), s.alias("line")
            ),
        ),
    )
    df = df.withColumn(
        "__opens",
        F.filter(
            F.transform("__lines", lambda x, i: F.struct(i.alias("i"), x["at"].alias("at"))),
            lambda x: x["at"].isNotNull(),
        ),
    )

    def chunk(x: Column, k: Column) -> Column:
        nxt = F.get("__opens", k + 1)
        until = F.coalesce(nxt["i"], F.size("__lines"))
        body = F.transform(
            F.slice("__lines", x["i"] + 1, until - x["i"]), lambda part: part["line"]
        )
        text = F.regexp_replace(
            F.array_join(body, " "), f"^\\[(?:\\d{{1,2}}:)?\\d{{1,2}}:\\d{{2}}\\][{T.SPACE}]*", ""
        )
        length = F.coalesce(
            F.greatest(F.lit(400), (nxt["at"] - x["at"]) * 1000), F.lit(int(LAST_CHUNK_SEC * 1000))
        )
        return F.struct(
            (x["at"] * 1000).cast("bigint").alias("start_ms"),
            F.when(nxt.isNull(), int(LAST_CHUNK_SEC * 1000)).otherwise(length).cast("bigint").alias("dur_ms"),
            T.trim(text).alias("text"),
        )

    untimed = T.trim(
        F.regexp_replace(
            "__body", "(?m)^(?:#.+|(?:" + "|".join(HEADER_LINES) + ").*)$", ""
        )
    )
    whole = F.array(
        F.struct(
            F.lit(0).cast("bigint").alias("start_ms"),
            F.lit(int(LAST_CHUNK_SEC * 1000)).cast("bigint").alias("dur_ms"), untimed.alias("text"),
        )
    )
    cues = F.when(F.size("__opens") > 0, F.transform("__opens", chunk)).when(untimed != "", whole)
    return df.withColumn("cues", cues)


def read_caption_markdown(payloads: DataFrame) -> DataFrame:
    """payloads(media_id, payload): timed lines of readable markdown transcripts."""
    usable = payloads.where(~is_unavailable(F.col("payload")))
    return _segments(markdown_fields(usable), F.col("cues"))


def markdown_headers(payloads: DataFrame) -> DataFrame:
    usable = payloads.where(~is_unavailable(F.col("payload")))
    return markdown_fields(usable).select(
        "media_id", "title", "language", "is_auto", "duration_sec", "available"
    )


def is_unavailable(payload: Column) -> Column:
    return F.regexp_like(F.left(payload, F.lit(400)), F.lit("(?i)transcript unavailable"))


def markdown_failures(payloads: DataFrame) -> DataFrame:
    """Error class of payloads that say the transcript is unavailable, or hold no text."""
    reason = F.coalesce(
        F.nullif(
            F.regexp_extract("payload", "Reason:\\s*(\\{[\\s\\S]*?\\}|[^\\n]+)", 1), F.lit("")
        ),
        F.left("payload", F.lit(280)),
    )
    low = F.lower(reason)
    has = lambda *words: F.regexp_like(low, F.lit("|".join(words)))
    said = payloads.where(is_unavailable(F.col("payload"))).select(
        "media_id",
        F.when(has("age"), "age_restricted")
        .when(has("member"), "members_only")
        .when(has("unavailable", "private"), "unavailable")
        .when(has("caption", "transcript", "subtitle"), "no_captions")
        .otherwise("unavailable").alias("code"),
        reason.alias("details"),
    )
    blank = markdown_fields(payloads.where(~is_unavailable(F.col("payload")))).where(
        F.col("cues").isNull()
    )
    return said.unionByName(
        blank.select(
            "media_id", F.lit("no_captions").alias("code"), F.lit(None).cast("string").alias("details")
        )
    )


# -- tracks and embedded JSON ------------------------------------------------------------


def _tracks(df: DataFrame, tracks: Column) -> DataFrame:
    return posexplode_rows(df, ["media_id"], tracks, "pos", "t").select(
        "media_id", "pos", "t.*"
    )


def read_track_list(lists: DataFrame) -> DataFrame:
    """lists(media_id, line): 'English (en), a-Korean (ko) [auto]' to track rows."""
    return _tracks(lists, available_languages(F.col("line")))


def read_track_objects(objects: DataFrame) -> DataFrame:
    """objects(media_id, payload): JSON array of caption tracks; kind asr means automatic."""
    parsed = F.from_json("payload", schemas.TRACK_OBJECTS)

    def track(x: Column) -> Column:
        auto = F.coalesce(x["kind"] == "asr", F.lit(False))
        simple = F.get_json_object(x["name"], "$.simpleText")
        return F.struct(
            F.coalesce(F.nullif(x["languageCode"], F.lit("")), F.lit("und")).alias("language_code"),
            F.coalesce(simple, x["name"]).alias("language_name"),
            F.when(auto, "asr").otherwise("manual").alias("source_type"),
            auto.alias("is_auto"),
        )

    return _tracks(objects, F.transform(parsed, track))


def extract_page_json(pages: DataFrame, token: str, column: str = "html") -> DataFrame:
    """Add ``json``: the first balanced object after ``token``, or null when it does not parse."""
    return pages.withColumn("json", _balanced_object(F.col(column), F.lit(token)))


@F.pandas_udf(StringType())
def _balanced_object(html, token):
    import json

    import pandas as pd

    def reject(name):
        raise ValueError(name)

    decoder = json.JSONDecoder(parse_constant=reject)

    def find(page, mark):
        at = page.find(mark) if page is not None else -1
        start = page.find("{", at) if at >= 0 else -1
        if start < 0:
            return None
        try:
            _, end = decoder.raw_decode(page, start)
        except ValueError:
            return None
        return page[start:end]

    return pd.Series([find(p, m) for p, m in zip(html, token)])
