"""Exported documents as rows of text chunks.

A document is the concatenation of its chunks in ``ord`` order: no recording is ever gathered
into one row. ``document_parts`` joins chunks into bounded parts (one part for any recording of
ordinary size) and ``write_files`` streams the parts of a recording into one file.

jobs: media_id, title, language, source_type, provider_label, summary, summary_kind,
source_label, timestamp_quality (each nullable). segments and paragraphs carry dense seq.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from cuelake.functions import clock as K
from cuelake.functions import text as T
from cuelake.operators.ordered import Scan, ordered_scan, row_block

PART_CHUNKS = 10_000
BOM = "﻿"
PRINT_STYLE = "body{font:16px/1.6 sans-serif;max-width:850px;margin:40px auto}"


def _body(df: DataFrame, chunk: Column, first_ord: int = 1) -> DataFrame:
    return df.select("media_id", (F.col("seq") + first_ord).alias("ord"), chunk.alias("chunk"))


def _head(jobs: DataFrame, chunk: Column) -> DataFrame:
    return jobs.select("media_id", F.lit(0).cast("bigint").alias("ord"), chunk.alias("chunk"))


def _tail(jobs: DataFrame, chunk: Column) -> DataFrame:
    return jobs.select("media_id", F.lit(1 << 60).cast("bigint").alias("ord"), chunk.alias("chunk"))


def document_title() -> Column:
    title = F.nullif(T.trim(F.coalesce("title", F.lit(""))), F.lit(""))
    return F.coalesce(title, F.nullif(F.col("source_label"), F.lit("")), F.lit("Transcript"))


def _summary() -> Column:
    return T.trim(F.coalesce("summary", F.lit("")))


def _spoken(speakers: bool) -> Column:
    return F.nullif(F.col("speaker"), F.lit("")) if speakers else F.lit(None).cast("string")


def transcript_lines(paragraphs: DataFrame, timestamps: str = "inline", speakers: bool = True) -> DataFrame:
    """Readable transcript: the speaker is printed when it changes, entries are set apart by a
    blank line. timestamps: off, inline, or srt (numbered entries)."""
    who = _spoken(speakers)
    stamp = F.lit("")
    if timestamps != "off":
        stamp = F.concat(K.format_inline_timestamp(F.col("start_ms")), F.lit(" "))
    gap = F.when(F.col("seq") > 0, "\n\n").otherwise("")
    if timestamps == "srt":
        name = F.when(who.isNotNull(), F.concat(who, F.lit(": "))).otherwise("")
        number = F.concat((F.col("seq") + 1).cast("string"), F.lit("\n"))
        entry = F.concat(number, T.trim(F.concat(name, stamp, "text")))
        return _body(paragraphs, F.concat(gap, entry))
    seen = ordered_scan(
        paragraphs.withColumn("__who", who), ["media_id"], ["seq"], row_block(),
        [Scan("__shown", "lag", F.col("__who"))],
    )
    turn = F.col("__who").isNotNull() & ~F.col("__who").eqNullSafe(F.col("__shown"))
    name = F.when(turn, F.concat("__who", F.lit(": "))).otherwise("")
    return _body(seen, F.concat(gap, T.trim(F.concat(name, stamp, "text"))))


def export_txt(jobs: DataFrame, paragraphs: DataFrame, timestamps="inline", speakers=True, summary=True) -> DataFrame:
    text = _summary() if summary else F.lit("")
    block = F.when(
        text != "",
        F.concat(
            F.lit("Summary ("), T.summary_kind_label(F.col("summary_kind")), F.lit(")\n"), text, F.lit("\n\n")
        ),
    ).otherwise("")
    return (
        _head(jobs, F.concat(document_title(), F.lit("\n\n"), block))
        .unionByName(transcript_lines(paragraphs, timestamps, speakers))
        .unionByName(_tail(jobs, F.lit("\n")))
    )


def export_markdown(jobs: DataFrame, paragraphs: DataFrame, timestamps="inline", speakers=True, summary=True) -> DataFrame:
    text = _summary() if summary else F.lit("")
    source = F.coalesce(F.concat(F.lit("Source: "), F.nullif(F.col("source_label"), F.lit("")), F.lit("\n")), F.lit(""))
    block = F.when(
        text != "",
        F.concat(
            F.lit("## Summary ("), T.summary_kind_label(F.col("summary_kind")), F.lit(")\n\n"), text, F.lit("\n\n")
        ),
    ).otherwise("")
    head = F.concat(
        F.lit("# "), document_title(), F.lit("\n\n"), source,
        F.lit("Language: "), "language", F.lit(" ("), T.source_type_label(F.col("source_type")),
        F.lit(")\nProvider: "), "provider_label", F.lit("\n\n"), block, F.lit("## Transcript\n\n"),
    )
    return (
        _head(jobs, head)
        .unionByName(transcript_lines(paragraphs, timestamps, speakers))
        .unionByName(_tail(jobs, F.lit("\n")))
    )


def _cue_text(speakers: bool) -> Column:
    who = _spoken(speakers)
    return F.concat(F.when(who.isNotNull(), F.concat(who, F.lit(": "))).otherwise(""), "text")


def _cue_end() -> Column:
    return F.col("start_ms") + F.greatest(F.col("dur_ms"), F.lit(400))


def _cue(separator: str, text: Column) -> Column:
    return F.concat(
        F.when(F.col("seq") > 0, "\n").otherwise(""),
        (F.col("seq") + 1).cast("string"), F.lit("\n"),
        K.format_clock_ms(F.col("start_ms"), separator), F.lit(" --> "),
        K.format_clock_ms(_cue_end(), separator), F.lit("\n"), text, F.lit("\n"),
    )


def export_srt(segments: DataFrame, speakers: bool = True) -> DataFrame:
    return _body(segments, _cue(",", _cue_text(speakers)))


def export_vtt(jobs: DataFrame, segments: DataFrame, speakers: bool = True) -> DataFrame:
    head = _head(jobs, F.lit("WEBVTT\n\n"))
    return head.unionByName(_body(segments, _cue(".", T.escape_vtt(_cue_text(speakers)))))


def export_csv(jobs: DataFrame, segments: DataFrame, timestamps=True, speakers=True, summary=True) -> DataFrame:
    """Every cell quoted, CRLF lines, an optional summary line first. Times in seconds."""
    def line(*cells: Column) -> Column:
        return F.concat(F.array_join(F.array(*[T.csv_cell(c) for c in cells]), ","), F.lit("\r\n"))

    times = [F.lit("start"), F.lit("end")] if timestamps else []
    who = [F.lit("speaker")] if speakers else []
    blanks = [F.lit("")] * (len(times) + len(who))
    text = _summary() if summary else F.lit("")
    head = F.concat(
        line(F.lit("type"), *times, *who, F.lit("text")),
        F.when(text != "", line(F.lit("summary"), *blanks, text)).otherwise(""),
    )
    seconds = lambda ms: plain_seconds(ms)
    cells = [F.lit("transcript")]
    cells += [seconds(F.col("start_ms")), seconds(_cue_end())] if timestamps else []
    cells += [F.coalesce("speaker", F.lit(""))] if speakers else []
    return _head(jobs, head).unionByName(_body(segments, line(*cells, F.col("text"))))


def plain_seconds(ms: Column) -> Column:
    """Milliseconds as the shortest decimal number of seconds: 1500 -> 1.5, 2000 -> 2."""
    whole = F.round(ms).cast("bigint")
    fixed = F.concat(
        F.floor(whole / 1000).cast("bigint").cast("string"), F.lit("."), F.lpad((whole % 1000).cast("string"), 3, "0")
    )
    return F.regexp_replace(fixed, "\\.?0+$", "")


def export_html(jobs: DataFrame, paragraphs: DataFrame, timestamps="off", speakers=True, summary=True, style: str = PRINT_STYLE) -> DataFrame:
    """Escaped printable page. ``style`` is the page's style sheet."""
    shown = timestamps != "off"
    title = T.escape_html(document_title())
    text = _summary() if summary else F.lit("")
    quality = F.lit("")
    if shown:
        quality = F.concat(F.lit("<br>Timestamp quality: "), T.escape_html(T.timestamp_quality_label(F.col("timestamp_quality"))))
    source = F.coalesce(
        F.concat(F.lit("Source: "), T.escape_html(F.nullif(F.col("source_label"), F.lit(""))), F.lit("<br>")), F.lit("")
    )
    head = F.concat(
        F.lit('<!doctype html>\n<html lang="'), T.escape_html(F.coalesce(F.nullif(F.col("language"), F.lit("")), F.lit("en"))),
        F.lit('">\n<head><meta charset="utf-8"><title>'), title, F.lit(f"</title>\n<style>{style}</style></head>\n<body><h1>"),
        title, F.lit('</h1>\n<div class="metadata">'), source, F.lit("Language: "), T.escape_html(F.col("language")), F.lit(" ("),
        T.escape_html(T.source_type_label(F.col("source_type"))), F.lit(")<br>Provider: "), T.escape_html(F.col("provider_label")),
        quality, F.lit("</div>\n"),
        F.when(
            text != "",
            F.concat(
                F.lit("<h2>Summary ("), T.summary_kind_label(F.col("summary_kind")), F.lit(')</h2><div class="summary">'),
                T.escape_html(text), F.lit("</div>"),
            ),
        ).otherwise(""),
        F.lit("\n<h2>Transcript</h2>"),
    )
    who = _spoken(speakers)
    stamp = F.lit("")
    if shown:
        stamp = F.concat(F.lit('<span class="timestamp">'), K.format_inline_timestamp(F.col("start_ms")), F.lit("</span> "))
    name = F.when(who.isNotNull(), F.concat(F.lit("<strong>"), T.escape_html(who), F.lit(":</strong> "))).otherwise("")
    entry = F.concat(
        F.when(F.col("seq") > 0, "\n").otherwise(""), F.lit("<p>"), stamp, name, T.escape_html(F.col("text")), F.lit("</p>")
    )
    return (
        _head(jobs, head).unionByName(_body(paragraphs, entry)).unionByName(_tail(jobs, F.lit("</body></html>")))
    )


MIDDLE = 1 << 50  # where the second list of a JSON document begins


def export_json(jobs: DataFrame, segments: DataFrame, paragraphs: DataFrame, timestamps=True, speakers=True, summary=True) -> DataFrame:
    """One JSON document per recording: the metadata and the two entry lists, an entry per chunk."""
    upload = F.coalesce(F.col("kind") == "upload", F.lit(False))
    fields = [
        F.col("id"), F.col("source"), F.when(~upload, F.col("video_id")).alias("videoId"),
        F.when(~upload, F.col("url")).alias("url"), F.col("language"), F.col("source_type").alias("sourceType"),
        document_title().alias("title"), F.col("provider"),
        F.coalesce("timestamp_quality", F.when(upload, "none").otherwise("source")).alias("timestampQuality"),
    ]
    if summary:
        fields += [F.col("summary_kind").alias("summaryKind"), F.col("summary")]

    def entries(df: DataFrame, first_ord: int) -> DataFrame:
        shown = []
        if timestamps:
            shown += [(F.col("start_ms") / 1000).alias("start"), (F.col("dur_ms") / 1000).alias("duration")]
        shown.append(F.col("text"))
        if speakers:
            shown.append(_spoken(True).alias("speaker"))
        return _body(df, F.concat(F.when(F.col("seq") > 0, ", ").otherwise(""), F.to_json(F.struct(*shown))), first_ord)

    meta = F.to_json(F.struct(*fields))
    middle = jobs.select("media_id", F.lit(MIDDLE).cast("bigint").alias("ord"), F.lit('], "paragraphs": [').alias("chunk"))
    head = F.concat(F.left(meta, F.length(meta) - 1), F.lit(', "segments": ['))
    return (
        _head(jobs, head).unionByName(entries(segments, 1)).unionByName(middle)
        .unionByName(entries(paragraphs, MIDDLE + 1)).unionByName(_tail(jobs, F.lit("]}\n")))
    )


def document_parts(chunks: DataFrame, per_part: int = PART_CHUNKS) -> DataFrame:
    """parts(media_id, part, text): chunks joined in order, at most ``per_part`` chunks each.
    Chunk numbers have gaps between head, body and tail, so chunks are numbered first."""
    numbered = ordered_scan(
        chunks, ["media_id"], ["ord"], F.floor(F.col("ord") / 65_536).cast("bigint"), [Scan("__n", "position")]
    )
    lines = F.array_sort(F.collect_list(F.struct("ord", "chunk")))
    return numbered.groupBy(
        "media_id", F.floor(F.col("__n") / per_part).cast("bigint").alias("part")
    ).agg(F.array_join(F.transform(lines, lambda x: x["chunk"]), "").alias("text"))


def write_files(parts: DataFrame, names: DataFrame, folder: str, extension: str, bom: bool = False) -> DataFrame:
    """One file per recording, ``folder``/basename.extension; the manifest: media_id, path, size_bytes.

    names(media_id, basename). The id follows a name that recordings share, in whatever case, and one
    that ends like a name with an id, so no two files ever meet. A task streams the
    parts of its recordings in order, so it never holds a document. Writing again gives the same
    bytes under the same names, so a task that is repeated changes nothing."""
    folded = names.withColumn("__folded", F.lower("basename"))
    shared = folded.groupBy("__folded").agg(F.count(F.lit(1)).alias("__n"))
    sign = F.when(F.col("media_id") < 0, "-m").otherwise("-")
    alike = (F.col("__n") > 1) | F.col("basename").rlike("-m?[0-9]+$")
    told = F.when(alike, F.concat("basename", sign, F.abs("media_id").cast("string"))).otherwise(F.col("basename"))
    named = folded.join(shared, "__folded").select("media_id", told.alias("name"))
    rows = parts.join(named, "media_id").select("media_id", "part", "name", "text").repartition("media_id").sortWithinPartitions("media_id", "part")
    start = BOM if bom else ""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, inner = fs.FileSystem.from_uri(folder)  # names may hold what a URI may not
        system.create_dir(inner, recursive=True)
        at, path, stream, size = None, "", None, 0
        done = []
        for batch in batches:
            for row in batch.itertuples(index=False):
                if row.media_id != at:
                    if stream is not None:
                        stream.close()
                        done.append((at, path, size))
                    at, path, size = row.media_id, f"{folder}/{row.name}.{extension}", 0
                    stream = system.open_output_stream(f"{inner}/{row.name}.{extension}")
                    size += stream.write(start.encode())
                size += stream.write(row.text.encode())
        if stream is not None:
            stream.close()
            done.append((at, path, size))
        yield pd.DataFrame(done, columns=["media_id", "path", "size_bytes"])

    return rows.mapInPandas(write, "media_id BIGINT, path STRING, size_bytes BIGINT")


def export_names(jobs: DataFrame) -> DataFrame:
    """Base file name per job: title, else the upload's name without extension, else the id."""
    upload = F.when(F.col("kind") == "upload", F.regexp_replace("file_name", "\\.[^.]+$", ""))
    title = F.coalesce(
        F.nullif(T.trim(F.coalesce("title", F.lit(""))), F.lit("")), F.nullif(upload, F.lit("")),
        F.nullif(F.col("video_id"), F.lit("")), F.lit("transcript"),
    )
    return jobs.select("media_id", T.safe_filename(nfc(title)).alias("basename"))


@F.pandas_udf(StringType())
def nfc(text):
    return text.str.normalize("NFC")
