"""Landed payloads derived from the tables, parsed back and compared with the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalog import sqltext as S
from catalog.adapters import staged
from catalog.base import query
from cuelake.operators.ordered import numbered
from cuelake.session import ensure_checkpoint_dir, stage_table
from cuelake.sinks.documents import write_files
from cuelake.sources import captions as C
from cuelake.sources import media as M
from cuelake.sources import responses as R

# -- JSON caption events: one payload per document, one event per line --------------------


def json3_payloads(t):
    lines = F.split("text", "\n")
    events = F.transform(
        lines,
        lambda x, i: F.struct(
            (i * 1500).cast("bigint").alias("tStartMs"),
            F.when(F.length(x) >= 40, F.length(x).cast("bigint") * 20).alias("dDurationMs"),
            F.array(F.struct(x.alias("utf8")), F.struct(F.lit("\n").alias("utf8"))).alias("segs"),
        ),
    )
    return t.documents.select(
        F.col("doc_id").alias("media_id"), "lang",
        F.to_json(F.struct(events.alias("events"))).alias("payload"),
    )


LINES_SQL = f"""line AS (SELECT doc_id AS media_id, lang, unnest(parts) AS raw, generate_subscripts(parts, 1) - 1 AS i
  FROM (SELECT doc_id, lang, regexp_split_to_array(text, '\\n') AS parts FROM documents)),
kept AS (SELECT media_id, lang, (row_number() OVER (PARTITION BY media_id ORDER BY i) - 1)::BIGINT AS seq, (i * 1500)::BIGINT AS start_ms,
  CASE WHEN length(raw) >= 40 THEN length(raw) * 20 ELSE 1000 END::BIGINT AS dur_ms, {S.squash('raw')} AS text
  FROM line WHERE {S.squash('raw')} <> '')"""


@query("src01_read_caption_json3", f"WITH {LINES_SQL} SELECT media_id, seq, start_ms, dur_ms, text FROM kept")
def _(t):
    return C.read_caption_json3(json3_payloads(t))


# -- timed markup: the paragraphs of real pages ------------------------------------------

_ENT = "{x}"
for _name, _char in [("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "''"), ("nbsp", " "), ("amp", "&")]:
    _ENT = f"regexp_replace({_ENT}, '&{_name};', '{_char}', 'gi')"


@query("src02_read_timedtext_xml", f"""WITH p AS (SELECT page_id, regexp_extract_all(html, '(?i)<p\\b([^>]*)>((?s:.)*?)</p>', 2) AS inners FROM pages),
u AS (SELECT page_id, unnest(inners) AS x, generate_subscripts(inners, 1) AS i FROM p),
c AS (SELECT page_id, i, regexp_replace(regexp_replace(regexp_replace(x, '(?i)<s\\b[^>]*>|</s>', '', 'g'), '(?i)<br\\s*/?>', ' ', 'g'), '<[^>]+>', '', 'g') AS y FROM u),
d AS (SELECT page_id, i, {S.squash(_ENT.format(x='y'))} AS text FROM c)
SELECT page_id AS media_id, (row_number() OVER (PARTITION BY page_id ORDER BY i) - 1)::BIGINT AS seq, 0::BIGINT AS start_ms, 1000::BIGINT AS dur_ms, text
FROM d WHERE text <> ''""")
def _(t):
    return C.read_timedtext_xml(
        t.pages.select(F.col("page_id").alias("media_id"), F.col("html").alias("payload"))
    )


# -- dispatch by payload shape -----------------------------------------------------------


def mixed_payloads(t):
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    timed = F.array_join(
        F.transform(lines, lambda x, i: F.concat(
            F.lit('<p t="'), (i * 1500).cast("string"), F.lit('" d="900">'),
            F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</p>"))), "")
    xml = t.documents.where(F.col("lang") == "de").select(
        F.col("doc_id").alias("media_id"), F.concat(F.lit(" <tt>"), timed, F.lit("</tt>")).alias("payload")
    )
    events = json3_payloads(t).where(F.col("lang") == "en").select("media_id", "payload")
    other = t.documents.where(~F.col("lang").isin("en", "de")).select(
        F.col("doc_id").alias("media_id"), F.concat(F.lit("* "), "text").alias("payload")
    )
    return events.unionByName(xml).unionByName(other)


_XML_TEXT = S.squash("CASE WHEN lang = 'de' THEN replace(raw, chr(160), ' ') ELSE raw END")


@query("src04_read_captions", f"""WITH {LINES_SQL},
x AS (SELECT media_id, raw, (row_number() OVER (PARTITION BY media_id ORDER BY i) - 1) AS j FROM line WHERE lang = 'de' AND trim(raw) <> ''),
y AS (SELECT media_id, j, {S.squash('raw')} AS text FROM x)
SELECT media_id, seq, start_ms, dur_ms, text FROM kept WHERE lang = 'en'
UNION ALL SELECT media_id, (row_number() OVER (PARTITION BY media_id ORDER BY j) - 1)::BIGINT, (j * 1500)::BIGINT, 900::BIGINT, text FROM y WHERE text <> ''""")
def _(t):
    return C.read_captions(mixed_payloads(t))[0]


@query("src04_caption_failures", """SELECT doc_id AS media_id, 'no_captions' AS code FROM documents
WHERE lang NOT IN ('en', 'de') OR trim(replace(text, chr(10), '')) = ''""")
def _(t):
    return C.read_captions(mixed_payloads(t))[1]


# -- markdown transcripts ----------------------------------------------------------------


def markdown_payloads(t):
    lines = F.filter(
        F.transform(F.split("text", "\n"), lambda x: F.trim(F.regexp_replace(x, "[^\\p{L}\\p{N} ]", ""))),
        lambda x: x != "",
    )
    stamp = lambda i: F.format_string(
        "[%d:%02d]", F.floor(i * 7 / 60).cast("int"), ((i * 7) % 60).cast("int")
    )
    # Every third line continues the one before it and carries no time.
    body = F.transform(lines, lambda x, i: F.when((i % 3 == 2) | (i * 7 >= 5940), x).otherwise(F.concat(stamp(i), F.lit(" "), x)))
    return t.documents.where(F.size(lines) > 0).select(
        F.col("doc_id").alias("media_id"),
        F.concat(
            F.lit("# Transcript: Doc "), "doc_id", F.lit("\nLanguage: "), "lang", F.lit(" [auto] · Duration: 1:02:03\n"),
            F.lit("Other available languages: English (en), a-Korean (ko), French (fr) [auto]\n\n## Transcript\n"),
            F.array_join(body, "\n"), F.lit("\nTo request another language, ask.\n"),
        ).alias("payload"),
    )


MD_SQL = r"""md AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n'),
   lambda x: trim(regexp_replace(x, '[^\p{L}\p{N} ]', '', 'g'))), lambda x: x <> '') AS lines FROM documents),
ml AS (SELECT doc_id, unnest(lines) AS x, generate_subscripts(lines, 1) - 1 AS i FROM md WHERE len(lines) > 0),
mc AS (SELECT *, CASE WHEN i % 3 = 2 OR i * 7 >= 5940 THEN 0 ELSE 1 END AS timed FROM ml),
mg AS (SELECT *, sum(timed) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM mc),
mm AS (SELECT doc_id AS media_id, (g - 1)::BIGINT AS seq, min(i) * 7000 AS start_ms, string_agg(x, ' ' ORDER BY i) AS text FROM mg GROUP BY doc_id, g)"""


@query("src03_read_caption_markdown", f"""WITH {MD_SQL} SELECT media_id, seq, start_ms::BIGINT AS start_ms,
  CASE WHEN lead(start_ms) OVER (PARTITION BY media_id ORDER BY seq) IS NULL THEN 4000 ELSE greatest(400, lead(start_ms) OVER (PARTITION BY media_id ORDER BY seq) - start_ms) END::BIGINT AS dur_ms, {S.trim('text')} AS text FROM mm""")
def markdown_segments(t):
    return C.read_caption_markdown(markdown_payloads(t))


@query("wn08_continuation_lines", f"WITH {MD_SQL} SELECT media_id, count(*)::BIGINT AS chunks, max(length(text))::BIGINT AS longest FROM mm GROUP BY media_id")
def _(t):
    return markdown_segments(t).groupBy("media_id").agg(
        F.count(F.lit(1)).alias("chunks"), F.max(F.length("text")).cast("bigint").alias("longest")
    )


@query("wn07_duration_from_next", f"""WITH {MD_SQL} SELECT media_id, seq,
  CASE WHEN lead(start_ms) OVER (PARTITION BY media_id ORDER BY seq) IS NULL THEN 4000 ELSE greatest(400, lead(start_ms) OVER (PARTITION BY media_id ORDER BY seq) - start_ms) END::BIGINT AS dur_ms FROM mm""")
def _(t):
    return markdown_segments(t).select("media_id", "seq", "dur_ms")


@query("src03_markdown_headers", f"""WITH {MD_SQL} SELECT d.doc_id AS media_id, 'Doc ' || d.doc_id AS title, d.lang AS language, true AS is_auto,
  3723.0::DOUBLE AS duration_sec, CASE WHEN d.lang IN ('en', 'fr', 'ko') THEN '' ELSE d.lang || ':asr,' END || 'en:manual,ko:asr,fr:asr' AS tracks
FROM documents d JOIN md USING (doc_id) WHERE len(md.lines) > 0""")
def _(t):
    h = C.markdown_headers(markdown_payloads(t))
    return h.withColumn(
        "tracks",
        F.array_join(F.transform("available", lambda a: F.concat(a["language_code"], F.lit(":"), a["source_type"])), ","),
    ).drop("available")


@query("flt10_markdown_failures", """SELECT doc_id AS media_id, CASE lang WHEN 'en' THEN 'age_restricted' WHEN 'de' THEN 'members_only'
  WHEN 'fr' THEN 'unavailable' ELSE 'no_captions' END AS code, CASE lang WHEN 'en' THEN 'Confirm your AGE' WHEN 'de' THEN '{"r": "Members"}'
  WHEN 'fr' THEN 'Private video' ELSE 'No subtitle' END AS details FROM documents""")
def _(t):
    why = (
        F.when(F.col("lang") == "en", "Confirm your AGE").when(F.col("lang") == "de", '{"r": "Members"}')
        .when(F.col("lang") == "fr", "Private video").otherwise("No subtitle")
    )
    p = t.documents.select(
        F.col("doc_id").alias("media_id"),
        F.concat(F.lit("# Transcript unavailable\nReason: "), why, F.lit("\n"), "text").alias("payload"),
    )
    return C.markdown_failures(p)


# -- tracks ------------------------------------------------------------------------------


@query("src05_read_track_list", """WITH l AS (SELECT doc_id, unnest(['manual', 'asr', 'asr']) AS source_type, unnest([lang, 'ko', source]) AS language_code,
   generate_subscripts([1, 2, 3], 1) - 1 AS pos FROM documents)
SELECT doc_id AS media_id, pos::INT AS pos, language_code, source_type, source_type = 'asr' AS is_auto FROM l""")
def _(t):
    line = F.concat(F.lit("Main ("), "lang", F.lit("), a-Korean (ko), Extra ("), "source", F.lit(") [auto]"))
    return C.read_track_list(t.documents.select(F.col("doc_id").alias("media_id"), line.alias("line")))


@query("src05_read_track_objects", """SELECT doc_id AS media_id, p::INT AS pos, CASE p WHEN 0 THEN lang ELSE 'und' END AS language_code,
  CASE p WHEN 0 THEN 'Name ' || lang ELSE source END AS language_name, CASE p WHEN 0 THEN 'asr' ELSE 'manual' END AS source_type, p = 0 AS is_auto
FROM documents, (SELECT unnest([0, 1]) AS p)""")
def _(t):
    payload = F.concat(
        F.lit('[{"baseUrl":"u","languageCode":"'), "lang", F.lit('","kind":"asr","name":{"simpleText":"Name '), "lang",
        F.lit('"}},{"baseUrl":"u","languageCode":"","name":"'), "source", F.lit('"}]'),
    )
    return C.read_track_objects(t.documents.select(F.col("doc_id").alias("media_id"), payload.alias("payload")))


@query("src06_extract_page_json", """SELECT d.doc_id AS page_id, d.text, d.lang, true AS first_only FROM documents d""")
def _(t):
    page = F.concat(
        F.lit("<script>var page = 1; player = "),
        F.to_json(F.struct("text", "lang", F.struct(F.lit('}{"\\').alias("x")).alias("inner"))),
        F.lit("; other = {broken</script>"),
    )
    pages = t.documents.select(F.col("doc_id").alias("page_id"), page.alias("html"))
    got = C.extract_page_json(pages, "player =")
    also = C.extract_page_json(got.withColumnRenamed("json", "first"), "other =")
    return also.select(
        "page_id", F.get_json_object("first", "$.text").alias("text"), F.get_json_object("first", "$.lang").alias("lang"),
        F.col("json").isNull().alias("first_only"),
    )


# -- silence log -------------------------------------------------------------------------


@staged
def silence_log(t):
    """Log lines of a user's events in time order: views open a silence, clicks close one."""
    e = t.events.select(
        F.col("user_id").alias("media_id"), "event_id", "ts",
        F.when(F.col("event_type") == "view", F.concat(F.lit("[x] silence_start: "), (F.col("value") - 1).cast("decimal(12,2)")))
        .when(F.col("event_type") == "click", F.concat(F.lit("[x] silence_end: "), F.col("value").cast("decimal(12,2)"), F.lit(" | d: 1")))
        .otherwise(F.lit("size= 1kB")).alias("line"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"),
    )
    out = numbered(e, ["media_id"], ["ms", "event_id"], F.floor(F.col("ms") / 60_000).cast("bigint"), "line_no")
    return out.select("media_id", "line_no", "line")


SILENCE_SQL = """lg AS (SELECT user_id AS media_id, (row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) - 1)::BIGINT AS line_no, event_type,
   round(value * 100)::BIGINT AS c FROM events),
s1 AS (SELECT *, max(CASE WHEN event_type = 'view' THEN line_no END) OVER w AS open_no,
  arg_max(CASE WHEN event_type = 'view' THEN greatest(0, c - 100) END, CASE WHEN event_type = 'view' THEN line_no END) OVER w AS open_c,
  max(CASE WHEN event_type = 'click' THEN line_no END) OVER (PARTITION BY media_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS closed_no
  FROM lg WINDOW w AS (PARTITION BY media_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
tot AS (SELECT media_id, max(CASE WHEN event_type = 'view' THEN line_no END) AS o,
  arg_max(greatest(0, c - 100), line_no) FILTER (event_type = 'view') AS oc, max(CASE WHEN event_type = 'click' THEN line_no END) AS k FROM lg GROUP BY media_id)"""


@query("src07_read_silence_log", f"""WITH {SILENCE_SQL}
SELECT media_id, line_no, (285000 + open_c * 10)::BIGINT AS start_ms, (285000 + c * 10)::BIGINT AS end_ms FROM s1
WHERE event_type = 'click' AND open_no IS NOT NULL AND (closed_no IS NULL OR open_no > closed_no)
UNION ALL SELECT media_id, o, (285000 + oc * 10)::BIGINT, 315000::BIGINT FROM tot WHERE o IS NOT NULL AND (k IS NULL OR o > k)""")
def _(t):
    return M.read_silence_log(silence_log(t), 285_000, 30_000)


# -- recording files ---------------------------------------------------------------------


def text_files(t):
    """Documents as files: the text is the content, the source picks name and type."""
    ext = F.element_at(F.array(*[F.lit(x) for x in ("mp3", "mp4", "wav", "exe")]), (F.col("doc_id") % 4 + 1).cast("int"))
    head = F.when(F.col("lang") == "en", "ID3").when(F.col("lang") == "de", "xxxxftyp").otherwise("RIFFxxxxWAVE")
    files = t.documents.select(
        F.col("doc_id").alias("media_id"), F.concat(F.lit("f"), "doc_id", F.lit("."), ext).alias("file_name"),
        (F.col("doc_id") * 1000).alias("modified_ms"), F.encode(F.concat(head, "text"), "UTF-8").alias("content"),
        F.when(F.col("source") == "src1", "audio/mpeg").otherwise("").alias("mime_type"),
    ).withColumn("size_bytes", F.octet_length("content").cast("bigint"))
    return M.with_ends(files)


@query("src08_media_inventory", """WITH f AS (SELECT doc_id, ['mp3', 'mp4', 'wav', 'exe'][doc_id % 4 + 1] AS ext, source, lang FROM documents)
SELECT doc_id AS media_id, 'f' || doc_id || '.' || ext AS file_name, CASE WHEN ext = 'exe' OR (source = 'src1' AND ext <> 'mp3') THEN 'unsupported_type'
  WHEN NOT ((ext = 'mp3' AND lang = 'en') OR (ext = 'mp4' AND lang = 'de') OR (ext = 'wav' AND lang NOT IN ('en', 'de'))) THEN 'bad_container' END AS problem FROM f""")
def _(t):
    return M.media_inventory(text_files(t)).select("media_id", "file_name", "problem")


@query("src08_scan_media_folder", """WITH f AS (SELECT doc_id, 'rec' || doc_id || '.mp3' AS file_name, encode(CASE WHEN lang = 'en' THEN 'ID3' ELSE '' END || text) AS b, lang FROM documents),
h AS (SELECT *, octet_length(b) AS n, hex(b) AS x FROM f)
SELECT file_name, n::BIGINT AS size_bytes, CASE WHEN n = 0 THEN 'empty' WHEN NOT coalesce(x LIKE '494433%' OR x LIKE '000001%' OR (x LIKE 'FF%' AND substr(x, 3, 1) IN ('E', 'F')), false) THEN 'bad_container' END AS problem,
  sha256(unhex(substr(x, 1, 131072))) AS head_hash, sha256(unhex(substr(x, 2 * greatest(65536, n - 65536) + 1, 131072))) AS tail_hash FROM h""")
def _(t):
    """Documents written as files; their ends, sizes and containers read back from the folder."""
    folder = f"{ensure_checkpoint_dir(t.spark)}/recordings-{uuid.uuid4().hex}"
    head = F.when(F.col("lang") == "en", "ID3").otherwise("")
    parts = t.documents.select(F.col("doc_id").alias("media_id"), F.lit(0).alias("part"), F.concat(head, "text").alias("text"))
    names = t.documents.select(F.col("doc_id").alias("media_id"), F.concat(F.lit("rec"), "doc_id").alias("basename"))
    stage_table(write_files(parts, names, folder, "mp3"), "written")
    files = M.media_inventory(M.read_media_files(t.spark, folder, "*.mp3"))
    return files.select("file_name", "size_bytes", "problem", F.sha2("head", 256).alias("head_hash"), F.sha2("tail", 256).alias("tail_hash"))


@query("src09_fingerprint_files", """WITH f AS (SELECT doc_id, ['mp3', 'mp4', 'wav', 'exe'][doc_id % 4 + 1] AS ext, encode(CASE lang WHEN 'en' THEN 'ID3' WHEN 'de' THEN 'xxxxftyp' ELSE 'RIFFxxxxWAVE' END || text) AS b FROM documents),
h AS (SELECT doc_id, encode('f' || doc_id || '.' || ext || chr(0) || octet_length(b) || chr(0) || (doc_id * 1000) || chr(0)) AS head, hex(b) AS x, octet_length(b) AS n FROM f)
SELECT doc_id AS media_id, sha256(head || unhex(substr(x, 1, 131072)) || unhex(substr(x, 2 * greatest(65536, n - 65536) + 1, 131072))) AS fingerprint FROM h""")
def _(t):
    return M.fingerprint_files(text_files(t)).select("media_id", "fingerprint")


@query("src09_duplicate_recordings", """WITH k AS (SELECT md5(CASE lang WHEN 'en' THEN 'ID3' WHEN 'de' THEN 'xxxxftyp' ELSE 'RIFFxxxxWAVE' END || text) AS h FROM documents)
SELECT count(*)::BIGINT AS copies, count(DISTINCT h)::BIGINT AS contents FROM (SELECT h FROM k)""")
def _(t):
    same = text_files(t).withColumns({"file_name": F.lit("x"), "modified_ms": F.lit(0)})
    marks = M.fingerprint_files(same).groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"))
    return marks.agg(F.sum("n").cast("bigint").alias("copies"), F.count(F.lit(1)).alias("contents"))


# -- sampled frames ----------------------------------------------------------------------


@query("src10_sample_frames", """WITH m AS (SELECT (vec_id // 50)::BIGINT AS media_id, max((vec_id % 50) * 700)::BIGINT AS d FROM embeddings GROUP BY 1),
g AS (SELECT media_id, unnest(range(0, d, 500))::BIGINT AS requested_ms FROM m)
SELECT g.media_id, g.requested_ms, f.t_ms AS actual_ms, f.vec_id FROM g ASOF JOIN
 (SELECT (vec_id // 50)::BIGINT AS media_id, ((vec_id % 50) * 700)::BIGINT AS t_ms, vec_id FROM embeddings) f ON g.media_id = f.media_id AND g.requested_ms >= f.t_ms""")
def _(t):
    f = t.embeddings.select(
        F.floor(F.col("vec_id") / 50).cast("bigint").alias("media_id"), ((F.col("vec_id") % 50) * 700).cast("bigint").alias("t_ms"), "vec_id"
    )
    m = f.groupBy("media_id").agg(F.max("t_ms").alias("duration_ms")).withColumn("cursor_ms", F.lit(0).cast("bigint"))
    return M.sample_frames(m, f).select(
        "media_id", "requested_ms", F.col("frame.t_ms").alias("actual_ms"), F.col("frame.vec_id").alias("vec_id")
    )


# -- provider responses ------------------------------------------------------------------


def extraction_responses(t):
    block = lambda kind: F.struct(
        F.lit(kind).alias("type"), F.col("text").alias("text"), F.array().cast("array<array<string>>").alias("rows")
    )
    status = F.when(F.col("lang") == "es", "textless").otherwise("text")
    body = F.to_json(F.struct(
        status.alias("status"), F.array(block("heading")).alias("blocks"),
        F.array().cast("array<string>").alias("flags"), F.array().cast("array<string>").alias("unreadable")))
    kind = F.when(F.col("source") == "src3", "refusal").otherwise("output_text")
    payload = F.to_json(F.struct(
        F.when(F.col("lang") == "fr", "incomplete").otherwise("completed").alias("status"),
        F.array(F.struct(F.array(F.struct(kind.alias("type"), body.alias("text"))).alias("content"))).alias("output"),
        F.when(F.col("source") != "src4", F.struct(F.col("n_chars").alias("input_tokens"), F.lit(7).alias("output_tokens"))).alias("usage")))
    return t.documents.select(F.col("doc_id").alias("id"), payload.alias("payload"))


@query("src13_read_extraction_responses", """SELECT doc_id AS id, CASE WHEN source = 'src3' THEN 'refusal' WHEN lang = 'fr' THEN 'incomplete'
   WHEN lang = 'es' OR length(text) > 100000 THEN 'malformed_response' ELSE 'completed' END AS outcome,
  CASE WHEN source = 'src4' THEN 'unknown' ELSE 'known' END AS billing, CASE WHEN source <> 'src4' THEN n_chars END AS input_tokens,
  CASE WHEN source <> 'src3' AND lang IN ('en', 'de') AND length(text) <= 100000 THEN text END AS heading,
  source <> 'src3' AND (lang IN ('fr', 'es') OR length(text) > 100000) AS kept_partial FROM documents""")
def _(t):
    r = R.read_extraction_responses(extraction_responses(t))
    return r.select(
        "id", "outcome", "billing", F.col("usage.input_tokens").alias("input_tokens"),
        F.get("extraction.blocks", F.lit(0))["text"].alias("heading"), F.coalesce(F.length("partial_text") > 0, F.lit(False)).alias("kept_partial"),
    )


@query("flt15_validate_extractions", """SELECT doc_id AS id, CASE WHEN lang = 'es' THEN 'textless_has_blocks' WHEN lang = 'fr' THEN 'status'
   WHEN lang = 'de' THEN 'cells_outside_table' ELSE '' END AS reasons FROM documents""")
def _(t):
    from cuelake.functions.checks import failed

    cells = F.when(F.col("lang") == "de", F.array(F.array(F.col("source")))).otherwise(F.array().cast("array<array<string>>"))
    e = F.struct(
        F.when(F.col("lang") == "es", "textless").when(F.col("lang") == "fr", "blurred").otherwise("text").alias("status"),
        F.array(F.struct(F.lit("paragraph").alias("type"), F.col("source").alias("text"), cells.alias("rows"))).alias("blocks"),
        F.array(F.col("lang")).alias("flags"), F.array().cast("array<string>").alias("unreadable"),
    )
    df = t.documents.select(F.col("doc_id").alias("id"), e.alias("e"))
    return df.select("id", F.array_join(failed(R.extraction_checks(F.col("e"))), ",").alias("reasons"))


@query("src14_read_transcription_responses", """SELECT doc_id AS id, CASE WHEN source IN ('src5', 'src6') THEN NULL ELSE text END AS text,
  CASE WHEN source IN ('src5', 'src6') THEN NULL WHEN lang = 'en' THEN 'en, ko-KR' ELSE lang END AS language,
  CASE WHEN source IN ('src5', 'src6') THEN NULL ELSE 'chunk-estimated' END AS timestamp_quality,
  CASE source WHEN 'src5' THEN 'unreadable' WHEN 'src6' THEN 'no_transcript' END AS problem FROM documents""")
def _(t):
    text = F.to_json(F.struct("text"))
    body = F.when(F.col("source") == "src5", F.lit("{oops")).when(
        F.col("source") == "src6", F.lit('{"text": 5}')
    ).when(
        F.col("lang") == "en",
        F.concat(F.expr("left(j, length(j) - 1)"), F.lit(',"languages":["en",{"code":"ko-KR"},7,{"code":"BAD"},{"x":1}]}')),
    ).otherwise(F.concat(F.expr("left(j, length(j) - 1)"), F.lit(',"languages":[3],"language":"'), "lang", F.lit('"}')))
    df = t.documents.withColumn("j", text).select(F.col("doc_id").alias("id"), body.alias("payload"))
    return R.read_transcription_responses(df)


@query("src15_read_summary_payloads", """SELECT conv_id * 100 + turn AS id,
  CASE WHEN role = 'system' THEN replace(replace('- Host: ' || text, '{', '('), '}', ')') ELSE 'Points. ' || text END AS summary,
  CASE WHEN role = 'system' THEN 'Host' ELSE 'Ana|Ben' END AS speakers, CASE WHEN role = 'system' THEN '' ELSE '0:Ana|' || turn || ':Ben' END AS turns FROM conversations""")
def _(t):
    said = F.to_json(F.struct(F.concat(F.lit(" Points. "), "text").alias("summary")))
    obj = F.concat(
        F.lit("Sure:\n```json\n"), F.expr("left(j, length(j) - 1)"),
        F.lit(',"speakers":[" Ana ","","Ben"],"turns":[{"i":0,"speaker":"Ana"},{"i":-1,"speaker":"x"},{"i":"'), "turn",
        F.lit('","speaker":" Ben "},{"i":1.5,"speaker":"y"},{"i":2,"speaker":""}]}\n```\nbye'),
    )
    plain = F.replace(F.replace(F.concat(F.lit("- Host: "), "text"), F.lit("{"), F.lit("(")), F.lit("}"), F.lit(")"))
    df = t.conversations.withColumn("j", said).select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("id"),
        F.when(F.col("role") == "system", plain).otherwise(obj).alias("payload"),
    )
    return R.read_summary_payloads(df).select(
        "id", "summary", F.array_join("speakers", "|").alias("speakers"),
        F.array_join(F.transform("turns", lambda x: F.concat(x["i"].cast("string"), F.lit(":"), x["speaker"])), "|").alias("turns"),
    )
