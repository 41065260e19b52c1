"""Exported documents."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalog import sqltext as S
from catalog.adapters import JOBS_SQL, PARAGRAPHS_SQL, SEGMENTS_SQL, export_jobs, paragraphs, segments
from catalog.base import query
from cuelake.functions import clock as K
from cuelake.session import ensure_checkpoint_dir, stage_table
from cuelake.sinks import documents as D

TITLE = S.trim("title")
SUM = S.trim("summary")

def _doc(head: str, line: str, tail: str, src: str = "paragraphs") -> str:
    base = PARAGRAPHS_SQL if src == "paragraphs" else SEGMENTS_SQL
    return f"""WITH {base}, {JOBS_SQL},
shown AS (SELECT *, lag(speaker) OVER (PARTITION BY media_id ORDER BY seq) AS before FROM {src}),
body AS (SELECT media_id, string_agg({line}, '' ORDER BY seq) AS body FROM shown GROUP BY media_id)
SELECT j.media_id, 0::BIGINT AS part, concat({head}, coalesce(b.body, ''), {tail}) AS text
FROM jobs j LEFT JOIN body b ON j.media_id = b.media_id"""


_GAP = "CASE WHEN seq > 0 THEN chr(10) || chr(10) ELSE '' END"
_NAME = "CASE WHEN speaker IS NOT NULL AND speaker IS DISTINCT FROM before THEN speaker || ': ' ELSE '' END"
_PARA = f"concat({_GAP}, {_NAME}, '[', {S.stamp('start_ms')}, '] ', text)"


def _summary(mark: str, gap: str) -> str:
    return f"CASE WHEN {SUM} <> '' THEN concat('{mark}Summary (Meeting)', chr(10), {gap}{SUM}, chr(10), chr(10)) ELSE '' END"



@query("snk01_export_txt", _doc(
    f"{TITLE}, chr(10), chr(10), " + _summary("", ""), _PARA, "chr(10)"))
def _(t):
    return D.document_parts(D.export_txt(export_jobs(t), paragraphs(t)))


@query("snk01_export_srt_mode", f"""WITH {PARAGRAPHS_SQL} SELECT media_id, (seq + 1)::BIGINT AS ord,
  concat({_GAP}, seq + 1, chr(10), CASE WHEN speaker IS NOT NULL THEN speaker || ': ' ELSE '' END, '[',
  {S.stamp('start_ms')}, '] ', text) AS chunk FROM paragraphs""")
def _(t):
    return D.transcript_lines(paragraphs(t), "srt")


@query("wn09_speaker_change", f"""WITH {PARAGRAPHS_SQL} SELECT media_id, (seq + 1)::BIGINT AS ord,
  concat({_GAP}, CASE WHEN speaker IS DISTINCT FROM lag(speaker) OVER (PARTITION BY media_id ORDER BY seq)
    AND speaker IS NOT NULL THEN speaker || ': ' ELSE '' END, text) AS chunk FROM paragraphs""")
def _(t):
    return D.transcript_lines(paragraphs(t), "off")


@query("snk02_export_markdown", _doc(
    f"'# ', {TITLE}, chr(10), chr(10), 'Source: ', source_label, chr(10), 'Language: en (', type_label, ')', chr(10), "
    f"'Provider: Landed captions', chr(10), chr(10), " + _summary("## ", "chr(10), ") +
    ", '## Transcript', chr(10), chr(10)", _PARA, "chr(10)"))
def _(t):
    return D.document_parts(D.export_markdown(export_jobs(t), paragraphs(t)))


_END = "start_ms + greatest(dur_ms, 400)"


def _cue_sql(sep: str, text: str) -> str:
    return (
        f"concat(CASE WHEN seq > 0 THEN chr(10) ELSE '' END, seq + 1, chr(10), {S.clock('start_ms', sep)}, ' --> ', "
        f"{S.clock(_END, sep)}, chr(10), {text}, chr(10))"
    )


_CUE_TEXT = "concat(CASE WHEN speaker IS NOT NULL THEN speaker || ': ' ELSE '' END, text)"


@query("snk03_export_srt", f"""WITH {SEGMENTS_SQL} SELECT media_id, 0::BIGINT AS part,
  string_agg({_cue_sql(',', _CUE_TEXT)}, '' ORDER BY seq) AS text FROM segments GROUP BY media_id""")
def _(t):
    return D.document_parts(D.export_srt(segments(t)))


_VTT = f"replace(replace(replace({_CUE_TEXT}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query("snk04_export_vtt", _doc("'WEBVTT', chr(10), chr(10)", _cue_sql(".", _VTT), "''", "segments"))
def _(t):
    return D.document_parts(D.export_vtt(export_jobs(t), segments(t)))


def _q(x):
    return f"'\"', replace({x}, '\"', '\"\"'), '\"'"


def _sec(ms):
    return (
        f"regexp_replace(concat(({ms}) // 1000, '.', lpad((({ms}) % 1000)::VARCHAR, 3, '0')), '\\.?0+$', '')"
    )


@query("snk06_export_csv", _doc(
    "'\"type\",\"start\",\"end\",\"speaker\",\"text\"', chr(13), chr(10), CASE WHEN " + SUM +
    " <> '' THEN concat('\"summary\",\"\",\"\",\"\",', " + _q(SUM) + ", chr(13), chr(10)) ELSE '' END",
    f"concat('\"transcript\",', {_q(_sec('start_ms'))}, ',', {_q(_sec(_END))}, ',', {_q(chr(99) + 'oalesce(speaker, ' + chr(39) * 2 + ')')}, ',', {_q('text')}, chr(13), chr(10))",
    "''", "segments"))
def _(t):
    return D.document_parts(D.export_csv(export_jobs(t), segments(t)))


@query("snk07_export_html", _doc(
    f"""'<!doctype html>', chr(10), '<html lang="en">', chr(10), '<head><meta charset="utf-8"><title>', {S.html(TITLE)},
    '</title>', chr(10), '<style>{D.PRINT_STYLE}</style></head>', chr(10), '<body><h1>', {S.html(TITLE)}, '</h1>', chr(10),
    '<div class="metadata">Source: ', {S.html('source_label')}, '<br>Language: en (', type_label, ')<br>Provider: Landed captions<br>Timestamp quality: ',
    quality_label, '</div>', chr(10), CASE WHEN {SUM} <> '' THEN concat('<h2>Summary (Meeting)</h2><div class="summary">', {S.html(SUM)}, '</div>') ELSE '' END,
    chr(10), '<h2>Transcript</h2>'""",
    f"""concat(CASE WHEN seq > 0 THEN chr(10) ELSE '' END, '<p><span class="timestamp">[', {S.stamp('start_ms')}, ']</span> ',
    CASE WHEN speaker IS NOT NULL THEN concat('<strong>', {S.html('speaker')}, ':</strong> ') ELSE '' END, {S.html('text')}, '</p>')""",
    "'</body></html>'"))
def _(t):
    return D.document_parts(D.export_html(export_jobs(t), paragraphs(t), "inline"))


@query("snk05_export_json", f"""WITH {PARAGRAPHS_SQL}, {JOBS_SQL}
SELECT s.media_id, 'segments' AS list, s.seq::INT AS pos, (s.start_ms / 1000.0)::DOUBLE AS start, (s.dur_ms / 1000.0)::DOUBLE AS duration,
  s.text, s.speaker, j.id, {TITLE} AS title, CASE WHEN j.kind = 'upload' THEN NULL ELSE j.video_id END AS video_id FROM segments s JOIN jobs j USING (media_id)
UNION ALL SELECT p.media_id, 'paragraphs', p.seq::INT, (p.start_ms / 1000.0)::DOUBLE, (p.dur_ms / 1000.0)::DOUBLE, p.text, p.speaker, j.id, {TITLE},
  CASE WHEN j.kind = 'upload' THEN NULL ELSE j.video_id END FROM paragraphs p JOIN jobs j USING (media_id)""")
def _(t):
    doc = D.document_parts(D.export_json(export_jobs(t), segments(t), paragraphs(t)))
    row = "ARRAY<STRUCT<start: DOUBLE, duration: DOUBLE, text: STRING, speaker: STRING>>"
    back = doc.withColumn("d", F.from_json("text", f"STRUCT<id: STRING, title: STRING, videoId: STRING, segments: {row}, paragraphs: {row}>"))
    parts = [
        back.select("media_id", F.lit(name).alias("list"), F.posexplode(f"d.{name}").alias("pos", "e"), "d.id", "d.title", F.col("d.videoId").alias("video_id"))
        for name in ("segments", "paragraphs")
    ]
    return parts[0].unionByName(parts[1]).select(
        "media_id", "list", "pos", "e.start", "e.duration", "e.text", "e.speaker", "id", "title", "video_id"
    )


def _basename_sql(x: str) -> str:
    plain = f"regexp_replace(regexp_replace(nfc_normalize({x}), '[\\x00-\\x1f]', '', 'g'), '[<>:" + chr(34) + "/\\\\|?*]', ' ', 'g')"
    name = f"left({S.trim(f"regexp_replace(regexp_replace({plain}, '[{S.SP}]+', ' ', 'g'), '[. ]+$', '')")}, 120)"
    return f"CASE WHEN {name} = '' THEN 'transcript' ELSE {name} END"


_BASENAME_SQL = _basename_sql(TITLE)


@query("snk10_export_names", f"WITH {JOBS_SQL} SELECT media_id, {_BASENAME_SQL} AS basename FROM jobs")
def _(t):
    return D.export_names(export_jobs(t))


@query("snk10_written_files", f"""WITH {SEGMENTS_SQL}, {JOBS_SQL}, b AS (SELECT media_id, {_BASENAME_SQL} AS basename FROM jobs),
d AS (SELECT media_id, string_agg({_cue_sql(',', _CUE_TEXT)}, '' ORDER BY seq) AS text FROM segments GROUP BY media_id),
n AS (SELECT media_id, CASE WHEN count(*) OVER (PARTITION BY lower(basename)) > 1 OR regexp_matches(basename, '-m?[0-9]+$') THEN basename || '-' || media_id ELSE basename END AS name FROM b)
SELECT d.media_id, name || '.srt' AS file_name, octet_length(encode(text))::BIGINT + 3 AS size_bytes, sha256(chr(65279) || text) AS hash FROM d JOIN n USING (media_id)""")
def _(t):
    """Files written, read back with Spark and told apart by their names."""
    folder = f"{ensure_checkpoint_dir(t.spark)}/exports-{uuid.uuid4().hex}"
    done = stage_table(D.write_files(D.document_parts(D.export_srt(segments(t))), D.export_names(export_jobs(t)), folder, "srt", bom=True), "written")
    back = t.spark.read.format("binaryFile").load(folder).select(
        F.element_at(F.split("path", "/"), -1).alias("file_name"), F.sha2("content", 256).alias("hash"))
    return done.select("media_id", F.element_at(F.split("path", "/"), -1).alias("file_name"), "size_bytes").join(back, "file_name")


@query("wn14_cue_numbers", f"""WITH {PARAGRAPHS_SQL} SELECT media_id, seq, 'Slide ' || lpad((seq + 1)::VARCHAR,
  greatest(3, length((seq + 1)::VARCHAR))::INT, '0') AS label FROM paragraphs""")
def _(t):
    return paragraphs(t).select(
        "media_id", "seq", F.concat(F.lit("Slide "), K._pad(F.col("seq") + 1, 3)).alias("label")
    )
