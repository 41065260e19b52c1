"""Row shapes of the domain tables. Times are whole milliseconds unless a name ends in _sec."""

from __future__ import annotations

SEGMENTS = "media_id BIGINT, seq BIGINT, start_ms BIGINT, dur_ms BIGINT, text STRING, speaker STRING"
CUES = "media_id BIGINT, seq BIGINT, start_ms DOUBLE, dur_ms DOUBLE, text STRING, speaker STRING"
PARAGRAPHS = CUES + ", turn_mark BOOLEAN"
TURNS = "media_id BIGINT, i BIGINT, speaker STRING"
TRACKS = (
    "media_id BIGINT, pos INT, language_code STRING, language_name STRING, "
    "source_type STRING, is_auto BOOLEAN"
)
SILENCES = "media_id BIGINT, pos BIGINT, start_ms BIGINT, end_ms BIGINT"
CHUNK_PLAN = (
    "media_id BIGINT, id STRING, idx BIGINT, core_start DOUBLE, core_end DOUBLE, "
    "start DOUBLE, end DOUBLE"
)
CORNER = "STRUCT<x: DOUBLE, y: DOUBLE>"
REGIONS = f"media_id BIGINT, pos INT, time_ms BIGINT, corners ARRAY<{CORNER}>"
USAGE = (
    "STRUCT<input_tokens: BIGINT, output_tokens: BIGINT, cached_input_tokens: BIGINT, "
    "cache_write_tokens: BIGINT, reasoning_tokens: BIGINT>"
)
EXTRACTION = (
    "STRUCT<status: STRING, blocks: ARRAY<STRUCT<type: STRING, text: STRING, "
    "rows: ARRAY<ARRAY<STRING>>>>, flags: ARRAY<STRING>, unreadable: ARRAY<STRING>>"
)
JSON3_PAYLOAD = (
    "STRUCT<events: ARRAY<STRUCT<tStartMs: BIGINT, dDurationMs: BIGINT, "
    "segs: ARRAY<STRUCT<utf8: STRING>>>>>"
)
TRACK_OBJECTS = (
    "ARRAY<STRUCT<baseUrl: STRING, languageCode: STRING, kind: STRING, name: STRING>>"
)
PROVIDER_RESPONSE = (
    "STRUCT<status: STRING, output: ARRAY<STRUCT<content: ARRAY<STRUCT<type: STRING, text: STRING>>>>, "
    "usage: STRUCT<input_tokens: DOUBLE, output_tokens: DOUBLE, "
    "input_tokens_details: STRUCT<cached_tokens: DOUBLE, cache_write_tokens: DOUBLE>, "
    "output_tokens_details: STRUCT<reasoning_tokens: DOUBLE>>>"
)
SUMMARY_PAYLOAD = (
    "STRUCT<summary: STRING, speakers: ARRAY<STRING>, turns: ARRAY<STRUCT<i: STRING, speaker: STRING>>>"
)
BACKUP_JOB = (
    "STRUCT<id: STRING, kind: STRING, video_id: STRING, url: STRING, file_name: STRING, "
    "mime_type: STRING, size_bytes: BIGINT, last_modified: BIGINT, fingerprint: STRING, title: STRING, "
    "language: STRING, requested_lang: STRING, source_type: STRING, provider: STRING, "
    "provider_label: STRING, segment_count: BIGINT, duration_sec: DOUBLE, created_at: BIGINT, "
    "summary_kind: STRING, summary: STRING, timestamp_quality: STRING, processing_mode: STRING>"
)
