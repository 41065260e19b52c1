"""Nested rules tell every place; a backup is imported whole or not at all."""

import json

import pytest

from cuelake.operators import backup as B
from cuelake.operators import validation as V

CHUNK = {"id": "c", "index": 0, "start": 0, "end": 6, "coreStart": 0, "coreEnd": 5}
DONE = {**CHUNK, "transcript": {"text": "x", "timestampQuality": "source"}, "completedAt": 1, "sizeBytes": 2}
CROP = {"id": "k", "x": 0, "y": 0, "width": 10, "height": 10, "fullWidth": 10, "fullHeight": 10, "hash": "a" * 64, "sizeBytes": 1}
STATE = {
    "id": "s", "start": 0, "end": 1, "startBoundary": {"low": 0, "high": 0}, "endBoundary": {"low": 1, "high": 1}, "status": "pending",
    "flags": ["dynamic"], "evidence": [{"id": "e", "sharpness": 0.5, "crops": [CROP]}],
}
SETTINGS = {
    "sampleRate": 2, "detectionWidth": 192, "sensitivity": 1, "refineStep": 0.2, "stableSamples": 2, "maxCandidates": 200, "maxRequests": 10, "budgetUsd": 5,
    "allowance": 0.2, "inputTokensPerMegapixel": 1500, "outputAllowance": 1024, "retryAllowance": 1, "profile": "standard", "regions": [{"time": 0}],
}
UPLOAD = {"status": "idle", "settings": {"language": "ko", "contentMode": "speech", "keywords": []}, "plan": [CHUNK], "chunks": [DONE]}
SLIDES = {"status": "ready", "settings": SETTINGS, "scanCursor": 0, "states": [STATE], "audit": [{"start": 0, "end": 1, "kind": "black"}]}
CUE = {"start": 0, "duration": 1, "text": "t"}


def nested(spark, **parts):
    from pyspark.sql import functions as F

    row = {"segments": [CUE], "paragraphs": [], **parts}
    df = spark.createDataFrame([(1, json.dumps(row))], "n int, line string")
    return df.select("n", F.from_json("line", f"STRUCT<{V.NESTED}>").alias("r")).select("n", "r.*")


def found(spark, **parts):
    return sorted((r.path, r.rule) for r in V.job_violations(nested(spark, **parts), "n").collect())


def changed(base, path, value):
    """A deep copy with one place set, or removed."""
    out = json.loads(json.dumps(base))
    at = out
    for step in path[:-1]:
        at = at[step]
    if value is None:
        del at[path[-1]]
    else:
        at[path[-1]] = value
    return out


def test_sound_rows_have_no_violations(spark):
    assert found(spark, upload=UPLOAD, slides=SLIDES, edits={"12.5": {"text": "x"}, "0": {"text": "", "speaker": "A"}}) == []
    assert found(spark, segments=None, paragraphs=None) == []


@pytest.mark.parametrize("part, path, value, want", [
    ("segments", [0, "text"], None, [("segments[0].text", "text")]),
    ("segments", [0, "duration"], -1, [("segments[0].duration", "time")]),
    ("upload", ["status"], "asleep", [("upload.status", "status")]),
    ("upload", ["settings", "contentMode"], "opera", [("upload.settings.contentMode", "content_mode")]),
    ("upload", ["settings", "keywords"], ["a", None], [("upload.settings.keywords[1]", "text")]),
    ("upload", ["plan"], None, [("upload.plan", "list")]),
    ("upload", ["plan", 0, "index"], 0.5, [("upload.plan[0].index", "index")]),
    ("upload", ["plan", 0, "coreEnd"], 7, [("upload.plan[0]", "interval")]),
    ("upload", ["chunks", 0, "transcript"], None, [("upload.chunks[0].transcript", "object")]),
    ("upload", ["chunks", 0, "id"], "", [("upload.chunks[0].id", "id")]),
    ("slides", ["settings", "sampleRate"], 9, [("slides.settings.sampleRate", "range")]),
    ("slides", ["settings", "stableSamples"], 2.5, [("slides.settings.stableSamples", "range")]),
    ("slides", ["settings", "regions"], [], [("slides.settings.regions", "list")]),
    ("slides", ["states", 0, "end"], -1, [("slides.states[0]", "interval")]),
    ("slides", ["states", 0, "flags"], ["dynamic", "odd"], [("slides.states[0].flags[1]", "flag")]),
    ("slides", ["states", 0, "endBoundary", "low"], 2, [("slides.states[0].endBoundary", "interval")]),
    ("slides", ["states", 0, "evidence", 0, "crops", 0, "x"], 5, [("slides.states[0].evidence[0].crops[0]", "inside")]),
    ("slides", ["states", 0, "evidence", 0, "crops", 0, "hash"], "A" * 64, [("slides.states[0].evidence[0].crops[0].hash", "hash")]),
    ("slides", ["audit", 0, "kind"], "white", [("slides.audit[0].kind", "kind")]),
])
def test_each_place_is_told(spark, part, path, value, want):
    base = {"segments": [CUE], "upload": UPLOAD, "slides": SLIDES}[part]
    assert found(spark, **{part: changed(base, path, value)}) == want


def test_edits(spark):
    got = found(spark, edits={"01": {"text": "x"}, "1.50": {"text": "x"}, "-1": {"text": "x"}, "2": {"speaker": "A"}, "3": {"text": "fine"}})
    assert got == [("edits{-1}.key", "timestamp"), ("edits{01}.key", "timestamp"), ("edits{1.50}.key", "timestamp"), ("edits{2}.value.text", "text")]


def test_settings_are_imported_with_the_jobs_or_not_at_all(spark):
    flat = {
        "id": "j", "kind": "youtube", "video_id": "v", "url": "u", "title": "T", "language": "en", "requested_lang": "en", "source_type": "asr",
        "provider": "p", "provider_label": "P", "segment_count": 1, "duration_sec": 1.0, "created_at": 5, "segments": [CUE],
    }

    def lines(job=flat, settings=(("upload", json.dumps(UPLOAD["settings"])), ("theme", "dark"))):
        rows = [("envelope", json.dumps({"format": "transcript-backup", "version": 1, "jobs": 1})), ("job", json.dumps(job))]
        rows += [("setting", json.dumps({"key": k, "value": v})) for k, v in settings]
        return spark.createDataFrame(rows, "kind string, line string")

    jobs = spark.createDataFrame([("old", "Old")], "id string, title string")
    settings = spark.createDataFrame([("theme", "light"), ("size", "2")], "key string, value string")

    def result(rows):
        j, s = B.import_all(jobs, settings, rows)
        return sorted(r.id for r in j.collect()), {r.key: r.value for r in s.collect()}

    untouched = (["old"], {"theme": "light", "size": "2"})
    ids, values = result(lines())
    assert ids == ["j", "old"] and values["theme"] == "dark" and values["size"] == "2" and "upload" in values
    assert result(lines(job={**flat, "segments": [{**CUE, "start": -1}]})) == untouched
    for bad in ([("__internal:x", "1")], [("upload", '{"language": "xx"}')], [("slides", "no")]):
        assert result(lines(settings=bad)) == untouched
        assert [r.problem for r in B.read_backup(lines(settings=bad))[1].collect()] == ["invalid_setting"]
