"""Edits, renames, sampled packs, terms, JSON parts and the resume gate on small tables."""

import json

import pytest

from cuelake.operators import search, speakers, summary
from cuelake.sinks import documents
from cuelake.sources.media import resume_gate

SEG = "media_id BIGINT, seq BIGINT, start_ms BIGINT, dur_ms BIGINT, text STRING, speaker STRING"


@pytest.fixture()
def tables(spark):
    segments = spark.createDataFrame(
        [(1, 0, 0, 500, "a", "Ann"), (1, 1, 500, 500, "b", "Ann"), (1, 2, 2000, 500, "c", None)], SEG)
    paragraphs = spark.createDataFrame([(1, 0, 0, 1000, "a b", "Ann"), (1, 1, 2000, 500, "c", None)], SEG)
    return segments, paragraphs


def told(df):
    return [(r.seq, r.text, r.speaker) for r in df.orderBy("seq").collect()]


def test_text_only_edit_keeps_the_speaker(spark, tables):
    edits = spark.createDataFrame([(1, 0, "new", None, False)], "media_id BIGINT, seq BIGINT, text STRING, speaker STRING, set_speaker BOOLEAN")
    segments, paragraphs, records = speakers.update_paragraphs(*tables, edits)
    assert told(segments) == [(0, "new", "Ann"), (1, "c", None)]
    assert told(paragraphs) == [(0, "new", "Ann"), (1, "c", None)]
    assert [(r.start_ms, r.text, r.speaker) for r in records.collect()] == [(0, "new", "Ann")]


def test_edits_that_clear_or_change_nothing(spark, tables):
    schema = "media_id BIGINT, seq BIGINT, text STRING, speaker STRING, set_speaker BOOLEAN"
    segments, paragraphs, records = speakers.update_paragraphs(*tables, spark.createDataFrame([(1, 0, None, " ", True)], schema))
    assert told(segments) == [(0, "a", None), (1, "b", None), (2, "c", None)] and told(paragraphs)[0] == (0, "a b", None)
    same = spark.createDataFrame([(1, 0, "a b", "Ann", True), (1, 1, None, None, False)], schema)
    segments, paragraphs, records = speakers.update_paragraphs(*tables, same)
    assert told(segments) == told(tables[0]) and told(paragraphs) == told(tables[1]) and records.count() == 0
    segments, _, _ = speakers.update_paragraphs(*tables, spark.createDataFrame([(1, 0, " ", None, False)], schema))
    assert told(segments) == [(0, "c", None)]


def test_renames(spark, tables):
    renames = spark.createDataFrame([("Ann", "Bea", 1), ("Ann", " Cid ", 2), ("x", "x", 1)], "old STRING, new STRING, ord INT")
    segments, paragraphs, records = speakers.rename_speakers(*tables, renames)
    assert [r.speaker for r in segments.orderBy("seq").collect()] == ["Cid", "Cid", None]
    assert told(paragraphs) == [(0, "a b", "Cid"), (1, "c", None)]
    assert [(r.start_ms, r.speaker) for r in records.collect()] == [(0, "Cid")]


def test_equal_packs_stay_unless_sampled(spark):
    def sample(texts):
        packs = spark.createDataFrame([(1, k, x) for k, x in enumerate(texts)], "media_id BIGINT, pack BIGINT, text STRING")
        return [r.text for r in summary.sample_packs(packs).orderBy("pack").collect()]

    assert sample(["aa", "bb", "bb"]) == ["aa", "bb", "bb"]
    assert sample(["a"] * 8) == ["a"]
    assert sample(list("abcdefgh")) == ["a", "c", "d", "f", "h"]
    assert sample(["a", "b", "b", "b", "b", "b", "a"]) == ["a", "b", "a"]


def test_terms(spark):
    docs = spark.createDataFrame([("Aaa ab",), ("b AB",), (None,)], "text STRING")
    terms = spark.createDataFrame([("a",), ("a ",), ("aa",), ("ab",), ("zz",), (" ",), (None,)], "term STRING")
    assert {r.term: r.n for r in search.term_counts(docs, "text", terms).collect()} == {"a": 5, "aa": 1, "ab": 2, "zz": 0}
    assert search.term_counts(docs, "text", terms.limit(0)).collect() == []


def test_json_parts_make_one_document(spark, tables):
    jobs = spark.createDataFrame(
        [(1, "id", "s", "v", "u", "en", "manual", "T", "p", None, None, None, "video"), (2, "id2", "s", "v", "u", "en", "manual", "T", "p", None, None, None, "video")],
        "media_id BIGINT, id STRING, source STRING, video_id STRING, url STRING, language STRING, source_type STRING, title STRING, provider STRING, "
        "timestamp_quality STRING, summary_kind STRING, summary STRING, kind STRING")
    jobs = jobs.withColumns({"source_label": jobs.title, "file_name": jobs.title})
    whole = documents.document_parts(documents.export_json(jobs, *tables)).orderBy("media_id").collect()
    docs = [json.loads(r.text) for r in whole]
    assert [len(d["segments"]) for d in docs] == [3, 0] and [r.part for r in whole] == [0, 0]
    parts = documents.document_parts(documents.export_json(jobs, *tables), per_part=2).where("media_id = 1").orderBy("part").collect()
    assert len(parts) > 2 and json.loads("".join(r.text for r in parts)) == docs[0]
    assert [s["text"] for s in docs[0]["paragraphs"]] == ["a b", "c"]


def test_resume_gate_with_missing_values(spark):
    schema = "job_id BIGINT, fingerprint STRING, duration_sec DOUBLE, width INT, height INT, size_bytes BIGINT, modified_ms BIGINT"
    jobs = spark.createDataFrame([(k, "f", 10.0, 1, 2, 5, 6) for k in range(6)], schema)
    picked = spark.createDataFrame(
        [(0, "f", 10.05, 1, 2, 5, 6), (1, None, 10.0, 1, 2, 5, 6), (2, "f", None, 1, 2, 5, 6), (3, "f", 10.0, None, 2, 5, 6), (4, "f", 10.0, 1, 2, 4, 6), (5, "f", 10.0, 1, 2, 5, None)],
        schema)
    got = {r.job_id: r.mismatch for r in resume_gate(picked, jobs).collect()}
    assert got == {0: None, 1: "fingerprint", 2: "duration", 3: "dimensions", 4: "file", 5: "file"}


def test_the_line_of_an_empty_summary_is_the_first_sentence(spark):
    """Every bullet is empty: the line comes from the pool's first sentence, not from its best one."""
    from pyspark.sql import functions as F

    from cuelake.operators import summary as S

    pool = spark.createDataFrame([(1, i, 12, f"sentence {i} " + "x" * (40 if i == 2 else 5)) for i in range(12)], "media_id BIGINT, idx BIGINT, total BIGINT, sentence STRING")
    top = S.top_sentences(pool, with_first=True)
    assert top.where("third = 3").select("idx").collect() == [(0,)]
    plain = lambda d: sorted(map(str, d.select("third", "rank", "idx").collect()))
    assert plain(top.where(F.col("third") < 3)) == plain(S.top_sentences(pool))
