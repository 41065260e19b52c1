"""The driver's tables as domain tables, in Spark and as SQL text. Plain projections only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.base import Tables, staged
from cuelake.functions.arrays import posexplode_rows
from cuelake.operators.ordered import BLOCK_ROWS, Scan, ordered_scan
from cuelake.operators.paragraphs import window_paragraphs

# -- cues: one per sentence of a conversation turn ---------------------------------------

TURNS_PER_BLOCK = 8192


@staged
def segments(t: Tables) -> DataFrame:
    cues = (
        t.conversations.select(
            F.col("conv_id").alias("media_id"), "turn", "role",
            F.posexplode(F.split("text", "[.\n]+")).alias("pos", "piece"),
        )
        .withColumn("text", F.trim("piece"))
        .where(F.col("text") != "")
        .withColumns(
            {
                "dur_ms": F.greatest(
                    F.lit(400), F.floor(F.length("text") * 1000 / F.lit(15))
                ).cast("bigint"),
                "gap_ms": (((3 * F.col("turn") + F.col("pos")) % 4) * 1000).cast("bigint"),
            }
        )
    )
    placed = ordered_scan(
        cues, ["media_id"], ["turn", "pos"],
        F.floor(F.col("turn") / TURNS_PER_BLOCK).cast("bigint"),
        [
            Scan("seq", "position"),
            Scan("start_ms", "sum_before", F.col("dur_ms") + F.col("gap_ms")),
        ],
    )
    return placed.select(
        "media_id", F.col("seq").cast("bigint").alias("seq"),
        F.col("start_ms").cast("bigint").alias("start_ms"), "dur_ms", "text",
        F.when(F.col("pos") == 0, F.col("role")).alias("speaker"),
    )


SEGMENTS_SQL = r"""
cue_piece AS (
  SELECT conv_id AS media_id, turn, role, unnest(parts) AS piece,
         generate_subscripts(parts, 1) - 1 AS pos
  FROM (SELECT conv_id, turn, role, regexp_split_to_array(text, '[.\n]+') AS parts
        FROM conversations)),
cue AS (
  SELECT media_id, turn, pos, role, trim(piece) AS text,
         greatest(400, length(trim(piece)) * 1000 // 15)::BIGINT AS dur_ms,
         (((3 * turn + pos) % 4) * 1000)::BIGINT AS gap_ms
  FROM cue_piece WHERE trim(piece) <> ''),
segments AS (
  SELECT media_id,
         (row_number() OVER w - 1)::BIGINT AS seq,
         coalesce(sum(dur_ms + gap_ms) OVER (PARTITION BY media_id ORDER BY turn, pos
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_ms,
         dur_ms, text, CASE WHEN pos = 0 THEN role END AS speaker
  FROM cue WINDOW w AS (PARTITION BY media_id ORDER BY turn, pos))
"""


@staged
def paragraphs(t: Tables) -> DataFrame:
    return window_paragraphs(segments(t))


PARAGRAPHS_SQL = SEGMENTS_SQL + """,
cue_fwd AS (
  SELECT *, last_value(speaker IGNORE NULLS) OVER (PARTITION BY media_id ORDER BY seq
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fwd FROM segments),
cue_who AS (
  SELECT *, coalesce(fwd, first_value(fwd IGNORE NULLS) OVER (PARTITION BY media_id ORDER BY seq
    ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS who FROM cue_fwd),
cue_break AS (
  SELECT *, CASE WHEN lag(seq) OVER w IS NULL THEN 0
    WHEN who <> lag(who) OVER w THEN 1
    WHEN start_ms - lag(start_ms + dur_ms) OVER w >= 2600 THEN 1
    WHEN start_ms // 14000 <> lag(start_ms) OVER w // 14000 THEN 1 ELSE 0 END AS brk
  FROM cue_who WINDOW w AS (PARTITION BY media_id ORDER BY seq)),
cue_para AS (
  SELECT *, (sum(brk) OVER (PARTITION BY media_id ORDER BY seq))::BIGINT AS p_seq FROM cue_break),
paragraphs AS (
  SELECT media_id, p_seq AS seq, min(start_ms)::BIGINT AS start_ms,
         greatest(400, max(start_ms + dur_ms) - min(start_ms))::BIGINT AS dur_ms,
         string_agg(text, ' ' ORDER BY seq) AS text, min(who) AS speaker
  FROM cue_para GROUP BY media_id, p_seq)
"""

# -- rolling captions: overlapping six-word windows of every line of a document -----------

STEP_WORDS = 3
WINDOW_WORDS = 2 * STEP_WORDS


@staged
def rolling_captions(t: Tables) -> DataFrame:
    """Windows of six words every three words inside a line; 600 ms apart, 1200 ms long, with a
    five second rest between lines."""
    documents = t.documents.select(F.col("doc_id").alias("media_id"), "text")
    evened = F.regexp_replace(F.replace("text", F.lit("\t"), F.lit(" ")), "  +", " ")
    lines = posexplode_rows(documents, ["media_id"], F.split(evened, "[.\n]+"), "line", "raw")
    steps = f"[^ ]+(?: [^ ]+){{0,{STEP_WORDS - 1}}}"
    words = F.length("said") - F.length(F.replace("said", F.lit(" "), F.lit(""))) + 1
    more = F.greatest(F.lit(0), F.ceil((words - WINDOW_WORDS) / STEP_WORDS).cast("int"))
    # Lines are placed, not their windows: a line lasts as long as its windows and the rest after them.
    # Only a document of that many lines has later blocks, so it is told by its text's length first.
    busy = documents.where((F.length("text") >= 2 * BLOCK_ROWS) & (F.size(F.split("text", "[.\n]+")) > BLOCK_ROWS))
    placed = ordered_scan(
        lines.select("media_id", "line", F.trim("raw").alias("said")).where("said <> ''").withColumn("more", more),
        ["media_id"], ["line"], "line",
        [Scan("first", "sum_before", F.col("more") + 1), Scan("begin", "sum_before", F.col("more") * 600 + 6200)],
        busy=busy.select("media_id").distinct(),
    )
    # A window is a step's words and the next one's; the last step begins no window unless it is alone.
    parts = placed.withColumn("steps", F.regexp_extract_all("said", F.lit(steps), F.lit(0)))
    windows = F.when(F.size("steps") == 1, F.col("steps")).otherwise(
        F.zip_with(
            F.slice("steps", 1, F.size("steps") - 1), F.slice("steps", 2, F.size("steps") - 1),
            lambda a, b: F.concat(a, F.lit(" "), b),
        )
    )
    cues = posexplode_rows(parts, ["media_id", "first", "begin"], windows, "pos", "text")
    return cues.select(
        "media_id", (F.col("first") + F.col("pos")).cast("bigint").alias("seq"),
        (F.col("begin") + F.col("pos") * 600).cast("bigint").alias("start_ms"),
        F.lit(1200).cast("bigint").alias("dur_ms"), "text", F.lit(None).cast("string").alias("speaker"),
    )

# -- jobs: one per conversation, with a summary and a source ------------------------------


def export_jobs(t: Tables) -> DataFrame:
    first = t.conversations.where(F.col("turn") == 0)
    upload = F.col("conv_id") % 2 == 1
    return first.select(
        F.col("conv_id").alias("media_id"),
        F.concat(F.lit("job:"), "conv_id").alias("id"),
        F.when(upload, "upload").otherwise("youtube").alias("kind"),
        F.col("text").alias("title"),
        F.when(upload, F.concat(F.lit("rec<"), "conv_id", F.lit(">.mp3")))
        .otherwise(F.concat(F.lit("https://example.com/v/"), "conv_id")).alias("source_label"),
        F.concat(F.lit("rec"), "conv_id", F.lit(".mp3")).alias("file_name"),
        F.concat(F.lit("v"), "conv_id").alias("video_id"),
        F.concat(F.lit("https://example.com/v/"), "conv_id").alias("url"),
        F.struct(F.when(upload, "upload").otherwise("youtube").alias("kind")).alias("source"),
        F.lit("en").alias("language"),
        F.when(upload, "transcription").otherwise("asr").alias("source_type"),
        F.lit("landed").alias("provider"), F.lit("Landed captions").alias("provider_label"),
        F.lit("meeting").alias("summary_kind"),
        F.when(upload, "").otherwise(F.concat(F.lit(' one "two" & <'), "role", F.lit(">\n"))).alias("summary"),
        F.when(upload, "chunk-estimated").otherwise("source").alias("timestamp_quality"),
    )


JOBS_SQL = """jobs AS (SELECT conv_id AS media_id, 'job:' || conv_id AS id,
  CASE WHEN conv_id % 2 = 1 THEN 'upload' ELSE 'youtube' END AS kind, text AS title,
  CASE WHEN conv_id % 2 = 1 THEN 'rec<' || conv_id || '>.mp3' ELSE 'https://example.com/v/' || conv_id END AS source_label,
  'rec' || conv_id || '.mp3' AS file_name, 'v' || conv_id AS video_id, 'https://example.com/v/' || conv_id AS url,
  'en' AS language, CASE WHEN conv_id % 2 = 1 THEN 'transcription' ELSE 'asr' END AS source_type,
  'meeting' AS summary_kind, CASE WHEN conv_id % 2 = 1 THEN '' ELSE ' one "two" & <' || role || '>' || chr(10) END AS summary,
  CASE WHEN conv_id % 2 = 1 THEN 'Chunk-estimated (approximate)' ELSE 'Source caption timing' END AS quality_label,
  CASE WHEN conv_id % 2 = 1 THEN 'Transcribed audio' ELSE 'Auto-generated' END AS type_label
  FROM conversations WHERE turn = 0)"""
