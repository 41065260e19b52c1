"""Job collections."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.adapters import SEGMENTS_SQL, segments
from catalog.base import query
from cuelake.functions.checks import failed
from cuelake.operators import backup as B
from cuelake.operators import store as S
from cuelake.operators import validation as V
from cuelake.sources.media import resume_gate


def jobs(t):
    d = t.documents
    up = F.col("lang") != "en"
    return d.select(
        F.when(F.col("source") == "src0", F.concat(F.lit("job-"), "doc_id")).alias("id"),
        F.when(up, F.lit("upload")).when(F.col("source") == "src1", "youtube").alias("kind"),
        F.when(~up, F.concat(F.lit("v"), "doc_id")).alias("video_id"), F.when(~up, F.lit("https://x")).alias("url"),
        F.when(up, F.concat("source", F.lit(".mp3"))).alias("file_name"), F.when(up, F.lit("audio/mpeg")).alias("mime_type"),
        F.when(up, F.col("n_chars")).alias("size_bytes"), F.when(up, F.col("doc_id")).alias("last_modified"),
        F.when(F.col("lang") == "fr", F.md5(F.col("text").cast("binary"))).alias("fingerprint"),
        F.col("source").alias("title"), F.col("lang").alias("language"), F.when(F.col("lang") == "es", "es").otherwise("auto").alias("requested_lang"),
        F.when(F.col("source") == "src2", "ocr").otherwise("asr").alias("source_type"), F.lit("p").alias("provider"), F.lit("P").alias("provider_label"),
        (F.col("n_chars") - 100).alias("segment_count"), (F.col("n_chars") / 15).alias("duration_sec"), (F.lit(1_700_000_000_000) + F.col("doc_id") * 1000).alias("created_at"),
        F.when(F.col("source") == "src3", "meeting").otherwise(F.col("source")).alias("summary_kind"), F.lit(None).cast("string").alias("summary"),
        F.lit(None).cast("string").alias("timestamp_quality"), F.when(F.col("source") == "src4", "slides").alias("processing_mode"))


_ID = """CASE WHEN source = 'src0' THEN 'job-' || doc_id WHEN lang = 'en' THEN 'youtube:v' || doc_id || ':en'
  ELSE 'upload:' || CASE WHEN lang = 'fr' THEN md5(text) ELSE source || '.mp3:' || n_chars || ':' || doc_id END || ':' || (1700000000000 + doc_id * 1000) END"""


@query("prj03_capture_jobs", f"""WITH {SEGMENTS_SQL}, x AS (SELECT media_id, max(start_ms + dur_ms) / 1000.0 AS e, count(*) AS n FROM segments GROUP BY 1)
SELECT doc_id AS media_id, 'v' || doc_id AS video_id, 'https://www.youtube.com/watch?v=v' || doc_id AS url, CASE WHEN lang = 'de' THEN 'v' || doc_id ELSE source END AS title, lang AS language,
  coalesce(n, 0)::BIGINT AS segment_count, coalesce(CASE WHEN doc_id % 2 = 0 THEN n_chars END, e, 0)::DOUBLE AS duration_sec, doc_id AS created_at, '' AS summary FROM documents LEFT JOIN x ON media_id = doc_id""")
def _(t):
    captures = t.documents.select(
        F.col("doc_id").alias("media_id"), F.concat(F.lit("v"), "doc_id").alias("video_id"), F.when(F.col("lang") != "de", F.col("source")).otherwise("").alias("title"),
        F.col("lang").alias("language"), F.lit("manual").alias("source_type"), F.lit("p").alias("provider"), F.lit("P").alias("provider_label"),
        F.when(F.col("doc_id") % 2 == 0, F.col("n_chars")).otherwise(0).cast("double").alias("duration_sec"))
    return S.capture_jobs(captures, segments(t), "auto", F.col("media_id")).select(
        "media_id", "video_id", "url", "title", "language", "segment_count", "duration_sec", "created_at", "summary")


@query("prj01_normalize_jobs", f"""SELECT {_ID} AS id, CASE WHEN lang = 'en' THEN 'youtube' ELSE 'upload' END AS kind, CASE WHEN source = 'src3' THEN 'meeting' ELSE 'general' END AS summary_kind,
  '' AS summary, CASE WHEN lang = 'en' THEN 'source' ELSE 'none' END AS timestamp_quality FROM documents""")
def _(t):
    return S.normalize_jobs(jobs(t)).select("id", "kind", "summary_kind", "summary", "timestamp_quality")


@query("flt13_validate_jobs", """SELECT doc_id, array_to_string(list_filter([CASE WHEN lang = 'es' THEN 'requested_lang' END, CASE WHEN source = 'src2' THEN 'source_type' END,
  CASE WHEN n_chars < 100 THEN 'segment_count' END, CASE WHEN source = 'src4' THEN 'visual' END], lambda x: x IS NOT NULL), ',') AS reasons FROM documents""")
def _(t):
    rows = jobs(t).withColumn("doc_id", ((F.col("created_at") - 1_700_000_000_000) / 1000).cast("bigint"))
    return rows.select("doc_id", F.array_join(failed(S.job_checks()), ",").alias("reasons"))


@query("flt14_validate_settings", """SELECT doc_id, array_to_string(list_filter([CASE WHEN n_chars / 1000.0 NOT BETWEEN 0.5 AND 4 THEN 'sample_rate' END, CASE WHEN n_chars NOT BETWEEN 192 AND 1024 THEN 'detection_width' END,
  CASE WHEN lang = 'de' THEN 'stable_samples' END, CASE WHEN lang = 'fr' THEN 'profile' END], lambda x: x IS NOT NULL), ',') AS reasons FROM documents""")
def _(t):
    rows = t.documents.select(
        "doc_id", (F.col("n_chars") / 1000).alias("sample_rate"), F.col("n_chars").alias("detection_width"), F.lit(1.0).alias("sensitivity"), F.lit(0.2).alias("refine_step"),
        F.when(F.col("lang") == "de", 2.5).otherwise(2.0).alias("stable_samples"), F.lit(200).alias("max_candidates"), F.lit(400).alias("max_requests"), F.lit(5.0).alias("budget_usd"),
        F.lit(0.25).alias("allowance"), F.lit(3000).alias("input_tokens_per_megapixel"), F.lit(4096).alias("output_allowance"), F.lit(1).alias("retry_allowance"),
        F.when(F.col("lang") == "fr", "fast").otherwise("standard").alias("profile"))
    return rows.select("doc_id", F.array_join(failed(S.settings_checks()), ",").alias("reasons"))


@query("flt14_validate_states", """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, array_to_string(list_filter([CASE WHEN l_quantity < l_linenumber THEN 'interval' END,
  CASE WHEN l_returnflag = 'R' THEN 'status' END], lambda x: x IS NOT NULL), ',') AS reasons FROM lineitem""")
def _(t):
    rows = t.lineitem.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_partkey").cast("string").alias("state_id"), F.col("l_linenumber").alias("start_ms"), F.col("l_quantity").alias("end_ms"),
        F.lit(0).alias("low_ms"), F.col("l_quantity").alias("high_ms"), F.when(F.col("l_returnflag") == "R", "lost").otherwise("pending").alias("status"))
    return rows.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.array_join(failed(S.state_checks()), ",").alias("reasons"))


@query("flt14_validate_crops", """SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_size * 400 > 8192 OR p_size * 400 * 1000 > 16777216 THEN 'size' END,
  CASE WHEN p_size * 400 + 10 > 10000 THEN 'inside' END], lambda x: x IS NOT NULL), ',') AS reasons FROM part""")
def _(t):
    rows = t.part.select(
        "p_partkey", F.lit(10).alias("x"), F.lit(0).alias("y"), (F.col("p_size") * 400).alias("width"), F.lit(1000).alias("height"), F.lit(10_000).alias("full_width"),
        F.lit(2000).alias("full_height"), F.sha2(F.col("p_name").cast("binary"), 256).alias("hash"))
    return rows.select("p_partkey", F.array_join(failed(S.crop_checks()), ",").alias("reasons"))


@query("flt20_setting_keys", "SELECT event_id, event_type NOT IN ('error', 'view') AS ok FROM events")
def _(t):
    key = F.when(F.col("event_type") == "error", "").when(F.col("event_type") == "view", "__internal:x").otherwise(F.col("event_type"))
    return t.events.select("event_id", S.setting_key_ok(key).alias("ok"))


def collection(t, cond, tag):
    return t.documents.where(cond).select(F.concat(F.lit("j"), F.floor(F.col("doc_id") / 2)).alias("id"), F.col("doc_id").alias("created_at"), F.lit(tag).alias("origin"))


_C = "SELECT 'j' || doc_id // 2 AS id, doc_id AS created_at FROM documents WHERE "


@query("so02_upsert_jobs", f"""WITH f AS (SELECT id, max(created_at) AS created_at FROM ({_C} lang IN ('en', 'de')) GROUP BY 1), e AS (SELECT id, max(created_at) AS created_at FROM ({_C} lang = 'fr') GROUP BY 1)
SELECT id, created_at, 'new' AS origin FROM f UNION ALL SELECT id, created_at, 'old' FROM e WHERE id NOT IN (SELECT id FROM f)""")
def _(t):
    old = collection(t, F.col("lang") == "fr", "old").groupBy("id").agg(F.max("created_at").alias("created_at"), F.max("origin").alias("origin"))
    new = collection(t, F.col("lang").isin("en", "de"), "new").withColumn("ord", F.col("created_at"))
    return S.upsert(old, new)


LEGACY_SQL = f"""a AS (SELECT id, max(created_at) AS c FROM ({_C} lang = 'en') GROUP BY 1), b AS (SELECT id, max(created_at) AS c FROM ({_C} lang = 'de') GROUP BY 1),
r AS (SELECT DISTINCT id FROM ({_C} source = 'src1')), e AS (SELECT id, max(created_at) AS c FROM ({_C} lang = 'fr') GROUP BY 1)"""


def legacy(t):
    e = collection(t, F.col("lang") == "fr", "old").groupBy("id").agg(F.max("created_at").alias("created_at"), F.max("origin").alias("origin"))
    v1 = collection(t, F.col("lang") == "en", "v1").withColumn("ord", F.col("created_at"))
    v2 = collection(t, F.col("lang") == "de", "v2").withColumn("ord", F.col("created_at"))
    receipts = collection(t, F.col("source") == "src1", "x").select("id").distinct()
    return S.import_legacy(e, v1, v2, receipts)


@query("so01_import_legacy", f"""WITH {LEGACY_SQL}, m AS (SELECT id, c, 'v2' AS o FROM b UNION ALL SELECT id, c, 'v1' FROM a WHERE id NOT IN (SELECT id FROM b))
SELECT id, c AS created_at, o AS origin FROM m WHERE id NOT IN (SELECT id FROM r) AND id NOT IN (SELECT id FROM e) UNION ALL SELECT id, c, 'old' FROM e""")
def _(t):
    return legacy(t)[0]


@query("so01_legacy_receipts", f"WITH {LEGACY_SQL} SELECT id FROM r UNION SELECT id FROM a UNION SELECT id FROM b")
def _(t):
    return legacy(t)[1]


@query("so03_delete_jobs", "SELECT l_orderkey AS job_id, count(*)::BIGINT AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1")
def _(t):
    gone = t.orders.where(F.col("o_orderstatus") == "F").select(F.col("o_orderkey").alias("job_id"))
    assets = t.lineitem.select(F.col("l_orderkey").alias("job_id"), "l_linenumber")
    return S.delete_jobs(gone, assets)[0].groupBy("job_id").agg(F.count(F.lit(1)).alias("n"))


@query("ag17_duplicate_identities", "SELECT 'k' || doc_id // 3 AS id, count(*)::BIGINT AS n FROM documents WHERE lang <> 'fr' GROUP BY 1 HAVING count(*) > 1")
def _(t):
    return S.duplicate_identities(t.documents.where(F.col("lang") != "fr").select(F.concat(F.lit("k"), F.floor(F.col("doc_id") / 3)).alias("id")))


@query("tk03_history_order", "SELECT doc_id, 1700000000000 + doc_id * 1000 AS created_at FROM documents ORDER BY 2 DESC")
def _(t):
    return t.documents.select("doc_id", (F.lit(1_700_000_000_000) + F.col("doc_id") * 1000).alias("created_at")).orderBy(F.col("created_at").desc())


def sound(t):
    return jobs(t).withColumns({
        "requested_lang": F.lit("auto"), "source_type": F.lit("asr"), "segment_count": F.lit(3).cast("bigint"), "processing_mode": F.lit("captions"),
        "duration_sec": F.col("segment_count").cast("double") + 100})


def settings(t):
    return t.events.select(F.when(F.col("event_type") == "error", "__internal:a").otherwise(F.col("event_type")).alias("key"), F.lit("v").alias("value")).distinct()


@query("src11_read_backup", f"""SELECT {_ID} AS id, source AS title, n_chars::DOUBLE AS duration_sec FROM documents""")
def _(t):
    lines = B.backup_lines(sound(t), settings(t), "2026-01-01T00:00:00Z")
    return B.read_backup(lines)[0].select("id", "title", "duration_sec")


@query("src11_backup_problems", "SELECT 'invalid_job' AS problem FROM documents WHERE lang = 'es' OR source IN ('src2', 'src4') OR n_chars < 100 LIMIT 1")
def _(t):
    return B.read_backup(B.backup_lines(jobs(t), settings(t), "x"))[1]


@query("snk09_backup_counts", """SELECT 'job' AS kind, count(*)::BIGINT AS n FROM documents UNION ALL SELECT 'setting', count(DISTINCT event_type)::BIGINT FROM events WHERE event_type <> 'error' UNION ALL SELECT 'envelope', 1""")
def _(t):
    return B.backup_lines(jobs(t), settings(t), "x").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("ag16_backup_version", "SELECT CASE WHEN count(*) FILTER (source = 'src4') > 0 THEN 2 ELSE 1 END AS version, count(*)::BIGINT AS jobs FROM documents")
def _(t):
    e = B.backup_lines(jobs(t), settings(t), "x").where(F.col("kind") == "envelope")
    return e.select(F.from_json("line", "STRUCT<version: INT, jobs: BIGINT>").alias("e")).select("e.*")


@query("so04_import_backup", f"""SELECT {_ID} AS id, source AS title FROM documents UNION ALL SELECT 'keep-' || event_type, 'kept' FROM (SELECT DISTINCT event_type FROM events)""")
def _(t):
    old = t.events.select(F.concat(F.lit("keep-"), "event_type").alias("id"), F.lit("kept").alias("title")).distinct()
    return B.import_backup(old, B.backup_lines(sound(t), settings(t), "x"))


@query("src12_save_and_load_jobs", f"SELECT {_ID} AS id, 1700000000000 + doc_id * 1000 AS created_at FROM documents")
def _(t):
    from cuelake.session import ensure_checkpoint_dir
    import uuid

    path = f"{ensure_checkpoint_dir(t.spark)}/jobs-{uuid.uuid4().hex}"
    S.save_jobs(path, S.normalize_jobs(jobs(t)))
    S.save_jobs(path, S.load_jobs(t.spark, path))
    return S.load_jobs(t.spark, path).select("id", "created_at")


@query("jn17_resume_gate", """SELECT doc_id AS job_id, CASE lang WHEN 'de' THEN 'fingerprint' WHEN 'fr' THEN 'duration' WHEN 'es' THEN 'dimensions' END AS mismatch FROM documents""")
def _(t):
    d = t.documents
    have = d.select(F.col("doc_id").alias("job_id"), F.md5(F.col("text").cast("binary")).alias("fingerprint"), F.col("n_chars").cast("double").alias("duration_sec"), F.lit(1280).alias("width"), F.lit(720).alias("height"))
    lang = lambda x: F.col("lang") == x
    got = d.select(
        F.col("doc_id").alias("job_id"), F.md5(F.when(lang("de"), F.lit("?")).otherwise(F.col("text")).cast("binary")).alias("fingerprint"),
        (F.col("n_chars") + F.when(lang("fr"), 0.2).otherwise(0.05)).alias("duration_sec"), F.lit(1280).alias("width"), F.when(lang("es"), 1080).otherwise(720).alias("height"))
    return resume_gate(got, have)


# -- nested rows and setting values -------------------------------------------------------


def nested_jobs(t):
    """Documents as jobs: a line is a segment, some with a bad time; a plan of two chunks; edits."""
    lines = F.split("text", "\n")
    cue = lambda x, i: F.struct(F.when(i % 5 == 3, -1.0).otherwise(i.cast("double")).alias("start"), F.lit(1.0).alias("duration"), F.nullif(x, F.lit("")).alias("text"), F.lit(None).cast("string").alias("speaker"))
    chunk = lambda k, index, end: F.struct(F.lit(f"c{k}").alias("id"), index.alias("index"), F.lit(0.0).alias("start"), end.alias("end"), F.lit(1.0).alias("coreStart"), F.lit(5.0).alias("coreEnd"))
    odd = F.col("doc_id") % 3 == 0
    plan = F.array(chunk(0, F.when(odd, 0.5).otherwise(0.0), F.lit(6.0)), chunk(1, F.lit(1.0), F.when(F.col("lang") == "de", 4.0).otherwise(6.0)))
    upload = F.struct(
        F.when(F.col("lang") == "fr", "asleep").otherwise("idle").alias("status"),
        F.struct(F.lit("ko").alias("language"), F.lit("speech").alias("contentMode"), F.array(F.lit("a"), F.when(~odd, "b")).alias("keywords")).alias("settings"),
        plan.alias("plan"), F.array().cast("array<struct<id:string,index:double,start:double,end:double,coreStart:double,coreEnd:double,transcript:struct<text:string,timestampQuality:string>,completedAt:double,sizeBytes:double>>").alias("chunks"))
    edit = F.struct(F.nullif(F.col("source"), F.lit("src1")).alias("text"), F.lit(None).cast("string").alias("speaker"))
    edits = F.create_map(F.when(odd, "01").otherwise("12.5"), edit)
    return t.documents.select("doc_id", F.transform(lines, cue).alias("segments"), upload.alias("upload"), edits.alias("edits"))


@query("flt13_nested_violations", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
e AS (SELECT doc_id, lang, source, CASE WHEN doc_id % 3 = 0 THEN '01' ELSE '12.5' END AS k FROM documents)
SELECT doc_id, 'segments[' || i || '].text' AS path, 'text' AS rule FROM l WHERE x = ''
UNION ALL SELECT doc_id, 'segments[' || i || '].start', 'time' FROM l WHERE i % 5 = 3
UNION ALL SELECT doc_id, 'edits{' || k || '}.key', 'timestamp' FROM e WHERE k = '01'
UNION ALL SELECT doc_id, 'edits{' || k || '}.value.text', 'text' FROM e WHERE source = 'src1'
UNION ALL SELECT doc_id, 'upload.status', 'status' FROM e WHERE lang = 'fr'
UNION ALL SELECT doc_id, 'upload.settings.keywords[1]', 'text' FROM e WHERE doc_id % 3 = 0
UNION ALL SELECT doc_id, 'upload.plan[0].index', 'index' FROM e WHERE doc_id % 3 = 0
UNION ALL SELECT doc_id, 'upload.plan[1]', 'interval' FROM e WHERE lang = 'de'""")
def _(t):
    return V.job_violations(nested_jobs(t), "doc_id")


SLIDES_JSON = (
    '{"sampleRate": RATE, "detectionWidth": 192, "sensitivity": 1, "refineStep": 0.2, "stableSamples": 2, "maxCandidates": 200, "maxRequests": 100, '
    '"budgetUsd": 5, "allowance": 0.25, "inputTokensPerMegapixel": 1500, "outputAllowance": 1024, "retryAllowance": 1, "profile": "standard", "regions": [{"time": 0}]}'
)


def setting_values(t):
    value = (
        F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit('{"language": "'), "lang", F.lit('", "contentMode": "speech", "keywords": ["a"]}')))
        .when(F.col("doc_id") % 4 == 1, F.replace(F.lit(SLIDES_JSON), F.lit("RATE"), F.col("n_chars").cast("string")))
        .when(F.col("doc_id") % 4 == 2, F.lit("true")).otherwise(F.when(F.col("lang") == "de", "{broken").otherwise("[1]"))
    )
    key = F.element_at(F.array(F.lit("upload"), F.lit("slides"), F.lit("__internal:lock"), F.lit("theme")), (F.col("doc_id") % 4 + 1).cast("int"))
    return t.documents.select(key.alias("key"), value.alias("value"))


@query("flt20_setting_values", """SELECT 'upload' AS key, 'upload.language' AS path, 'language' AS rule, count(*)::BIGINT AS n FROM documents WHERE doc_id % 4 = 0 AND lang NOT IN ('en', 'ko') HAVING count(*) > 0
UNION ALL SELECT 'slides', 'slides.sampleRate', 'range', count(*) FROM documents WHERE doc_id % 4 = 1 AND NOT (n_chars BETWEEN 0.5 AND 4) HAVING count(*) > 0
UNION ALL SELECT '__internal:lock', 'key', 'key', count(*) FROM documents WHERE doc_id % 4 = 2 HAVING count(*) > 0""")
def _(t):
    return V.setting_violations(setting_values(t)).groupBy("key", "path", "rule").agg(F.count(F.lit(1)).alias("n"))


@query("so04_import_settings", """SELECT event_type AS key, '"' || 'new' || '"' AS value FROM events GROUP BY 1 UNION ALL SELECT 'kept', '1'""")
def _(t):
    fresh = t.events.select(F.col("event_type").alias("key")).distinct().withColumn("value", F.lit('"new"'))
    had = fresh.where("key = 'click'").withColumn("value", F.lit("0")).unionByName(t.events.select(F.lit("kept").alias("key"), F.lit("1").alias("value")).distinct())
    return B.import_all(jobs(t).limit(0), had, B.backup_lines(sound(t), fresh, "x"))[1]
