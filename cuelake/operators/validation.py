"""Rules of stored jobs and settings down to their nested rows, declared once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.functions.checks import finite_nonnegative, one_of, whole, within
from cuelake.functions.rules import Rule, violation_rows
from cuelake.operators.store import QUALITIES, SETTING_RANGES, STATE_STATUSES, setting_key_ok

# Enumerations of nested rows.
UPLOAD_STATUSES = [
    "idle", "inspecting", "preparing", "extracting-audio", "analyzing-boundaries", "chunking", "transcribing", "merging",
    "postprocessing", "completed", "cancelled", "failed",
]
UPLOAD_LANGUAGES = ["ko-en", "ko", "en", "auto"]
CONTENT_MODES = ["speech", "meeting", "interview", "lecture", "podcast", "ai-conference", "lyrics"]
SLIDE_STATUSES = ["ready", "scanning", "review", "extracting", "paused", "cancelled", "completed", "failed"]
STATE_FLAGS = [
    "unreadable", "boundary-uncertain", "clipped-region", "possible-duplicate", "dynamic", "incomplete", "occlusion", "region-review",
]
AUDIT_KINDS = ["black", "transition", "unobservable", "excluded", "dynamic"]
PROFILES = ["standard", "economy"]

_CUES = "ARRAY<STRUCT<start: DOUBLE, duration: DOUBLE, text: STRING, speaker: STRING>>"
_PLANNED = "id: STRING, index: DOUBLE, start: DOUBLE, end: DOUBLE, coreStart: DOUBLE, coreEnd: DOUBLE"
UPLOAD_SETTINGS = "STRUCT<language: STRING, contentMode: STRING, keywords: ARRAY<STRING>, prompt: STRING>"
_BOUNDARY = "STRUCT<low: DOUBLE, high: DOUBLE>"
_CROP = (
    "STRUCT<id: STRING, x: DOUBLE, y: DOUBLE, width: DOUBLE, height: DOUBLE, fullWidth: DOUBLE, fullHeight: DOUBLE, hash: STRING, sizeBytes: DOUBLE>"
)
SLIDE_SETTINGS = (
    "STRUCT<sampleRate: DOUBLE, detectionWidth: DOUBLE, sensitivity: DOUBLE, refineStep: DOUBLE, stableSamples: DOUBLE, maxCandidates: DOUBLE, "
    "maxRequests: DOUBLE, budgetUsd: DOUBLE, allowance: DOUBLE, inputTokensPerMegapixel: DOUBLE, outputAllowance: DOUBLE, retryAllowance: DOUBLE, "
    "profile: STRING, regions: ARRAY<STRUCT<time: DOUBLE>>>"
)
NESTED = (
    f"segments: {_CUES}, paragraphs: {_CUES}, edits: MAP<STRING, STRUCT<text: STRING, speaker: STRING>>, "
    f"upload: STRUCT<status: STRING, settings: {UPLOAD_SETTINGS}, plan: ARRAY<STRUCT<{_PLANNED}>>, "
    f"chunks: ARRAY<STRUCT<{_PLANNED}, transcript: STRUCT<text: STRING, timestampQuality: STRING>, completedAt: DOUBLE, sizeBytes: DOUBLE>>>, "
    f"slides: STRUCT<status: STRING, settings: {SLIDE_SETTINGS}, scanCursor: DOUBLE, "
    f"states: ARRAY<STRUCT<id: STRING, start: DOUBLE, end: DOUBLE, startBoundary: {_BOUNDARY}, endBoundary: {_BOUNDARY}, status: STRING, flags: ARRAY<STRING>, "
    f"evidence: ARRAY<STRUCT<id: STRING, sharpness: DOUBLE, crops: ARRAY<{_CROP}>>>>>, "
    "audit: ARRAY<STRUCT<start: DOUBLE, end: DOUBLE, kind: STRING>>>"
)


def _there(c: Column) -> Column:
    return c.isNotNull()


def _among(values: list[str]):
    return lambda c: one_of(c, values)


def _filled(most: int):
    return lambda c: F.length(c).between(1, most)


def _at_most(most: int):
    return lambda c: F.size(c) <= most


def _count(c: Column) -> Column:
    return finite_nonnegative(c) & whole(c)


def _cues(name: str) -> list[Rule]:
    return [
        Rule(f"{name}[]", "object", _there), Rule(f"{name}[].text", "text", _there),
        Rule(f"{name}[].start", "time", finite_nonnegative), Rule(f"{name}[].duration", "time", finite_nonnegative),
    ]


def _chunk_order(c: Column) -> Column:
    numbers = [c[x] for x in ("start", "end", "coreStart", "coreEnd")]
    finite = numbers[0].isNotNull()
    for n in numbers:
        finite = finite & finite_nonnegative(n)
    start, end, core_start, core_end = numbers
    return finite & (end >= start) & (core_end >= core_start) & (core_start >= start) & (core_end <= end)


def _chunks(name: str) -> list[Rule]:
    return [
        Rule(name, "list", _there), Rule(f"{name}[]", "interval", _chunk_order),
        Rule(f"{name}[].id", "id", lambda c: c != ""), Rule(f"{name}[].index", "index", _count),
    ]


def _upload_settings(name: str) -> list[Rule]:
    return [
        Rule(name, "object", _there), Rule(f"{name}.language", "language", _among(UPLOAD_LANGUAGES)),
        Rule(f"{name}.contentMode", "content_mode", _among(CONTENT_MODES)), Rule(f"{name}.keywords", "list", _there),
        Rule(f"{name}.keywords[]", "text", _there),
    ]


def _camel(name: str) -> str:
    first, *rest = name.split("_")
    return first + "".join(w.capitalize() for w in rest)


def _slide_settings(name: str) -> list[Rule]:
    def ranged(low: float, high: float, integral: bool):
        return lambda c: (within(c, low, high) & whole(c)) if integral else within(c, low, high)

    return [
        Rule(name, "object", _there), Rule(f"{name}.profile", "profile", _among(PROFILES)),
        Rule(f"{name}.regions", "list", lambda c: F.size(c).between(1, 1000)),
        *[Rule(f"{name}.{_camel(k)}", "range", ranged(*v)) for k, v in SETTING_RANGES.items()],
    ]


def _crop_inside(c: Column) -> Column:
    return (
        (c["x"] + c["width"] <= c["fullWidth"]) & (c["y"] + c["height"] <= c["fullHeight"]) & (c["width"] * c["height"] <= 16_777_216)
    )


def _ordered(low: str, high: str):
    return lambda c: finite_nonnegative(c[low]) & finite_nonnegative(c[high]) & (c[high] >= c[low])


_STATE, _CROPS = "slides.states[]", "slides.states[].evidence[].crops[]"
JOB_RULES = [
    *_cues("segments"), *_cues("paragraphs"),
    Rule("edits{}.key", "timestamp", lambda c: c.rlike(r"^(0|[1-9][0-9]*)(\.[0-9]*[1-9])?$")),
    Rule("edits{}.value", "object", _there), Rule("edits{}.value.text", "text", _there),
    Rule("upload.status", "status", _among(UPLOAD_STATUSES)), *_upload_settings("upload.settings"),
    *_chunks("upload.plan"), *_chunks("upload.chunks"),
    Rule("upload.chunks[].transcript", "object", _there), Rule("upload.chunks[].transcript.text", "text", _there),
    Rule("upload.chunks[].transcript.timestampQuality", "quality", _among(QUALITIES)),
    Rule("upload.chunks[].completedAt", "time", finite_nonnegative), Rule("upload.chunks[].sizeBytes", "size", finite_nonnegative),
    Rule("slides.status", "status", _among(SLIDE_STATUSES)), *_slide_settings("slides.settings"),
    Rule("slides.scanCursor", "time", finite_nonnegative), Rule("slides.states", "list", _at_most(5000)),
    Rule(_STATE, "interval", _ordered("start", "end")), Rule(f"{_STATE}.id", "id", _filled(128)),
    Rule(f"{_STATE}.startBoundary", "interval", _ordered("low", "high")), Rule(f"{_STATE}.endBoundary", "interval", _ordered("low", "high")),
    Rule(f"{_STATE}.status", "status", _among(STATE_STATUSES)), Rule(f"{_STATE}.flags", "list", _at_most(20)),
    Rule(f"{_STATE}.flags[]", "flag", _among(STATE_FLAGS)), Rule(f"{_STATE}.evidence", "list", _at_most(3)),
    Rule(f"{_STATE}.evidence[].id", "id", _filled(128)), Rule(f"{_STATE}.evidence[].sharpness", "number", finite_nonnegative),
    Rule(f"{_STATE}.evidence[].crops", "list", _at_most(200)), Rule(_CROPS, "inside", _crop_inside), Rule(f"{_CROPS}.id", "id", _filled(128)),
    *[Rule(f"{_CROPS}.{c}", "place", finite_nonnegative) for c in ("x", "y", "sizeBytes")],
    *[Rule(f"{_CROPS}.{c}", "side", lambda c: within(c, 1, 8192) & whole(c)) for c in ("width", "height")],
    Rule(f"{_CROPS}.hash", "hash", lambda c: c.rlike("^[a-f0-9]{64}$")),
    Rule("slides.audit", "list", _at_most(20_000)), Rule("slides.audit[]", "interval", _ordered("start", "end")),
    Rule("slides.audit[].kind", "kind", _among(AUDIT_KINDS)),
]


def job_violations(jobs: DataFrame, *keys: str) -> DataFrame:
    """keys, path, rule of all nested rows of jobs (segments, paragraphs, edits, upload, slides; those
    the table has)."""
    has = set(jobs.columns)
    return violation_rows(jobs, [r for r in JOB_RULES if r.path.replace("[", ".").replace("{", ".").split(".")[0] in has], *keys)


def setting_violations(settings: DataFrame) -> DataFrame:
    """key, path, rule of settings(key, value): reserved or empty keys, and the parts of the two settings
    whose value is JSON of a given shape. Other values may be any text."""
    value = F.col("value")
    told = settings.select(
        "key", F.from_json(F.when(F.col("key") == "upload", value), UPLOAD_SETTINGS).alias("upload"),
        F.from_json(F.when(F.col("key") == "slides", value), SLIDE_SETTINGS).alias("slides"),
    )
    plain = violation_rows(told.select("key"), [Rule("key", "key", setting_key_ok)], "key")
    upload = violation_rows(told.where("key = 'upload'").select("key", "upload"), _upload_settings("upload"), "key")
    slides = violation_rows(told.where("key = 'slides'").select("key", "slides"), _slide_settings("slides"), "key")
    return plain.unionByName(upload).unionByName(slides)
