"""Patterns that pass over printable ASCII give what the plain patterns give."""

import random

from pyspark.sql import functions as F

from cuelake.functions import text as T
from cuelake.sources.captions import read_captions

BITS = [" ", "  ", "\t", " \t ", "\n", " \n ", " ", " ", "　 ", "﻿", "\x0b", "a", "B", "word.", "다!", "합니다 ", "까요 ", "? ", "!", "~", "&lt;", "&AMP;lt;", "&Amp", "$1", "\\", "é"]


def test_white_space_and_entities(spark):
    """F14, F17, F19, F20, F26, F30, F31, F32"""
    random.seed(3)
    texts = [("".join(random.choice(BITS) for _ in range(random.randint(0, 25))),) for _ in range(3000)] + [(None,), ("",)]
    df, c, s = spark.createDataFrame(texts, "s STRING"), F.col("s"), T.SPACE
    plain = lambda x: F.regexp_replace(x, f"^[{s}]+|[{s}]+$", "")
    named = c
    for name, char in T.NAMED_ENTITIES.items():
        named = F.regexp_replace(named, f"(?i)&{name};", char)
    cut = F.split(T.strip_noise(c), f"(?<=[{T.SENTENCE_MARKS}])[{s}]+|(?<=(?:니다|까요|세요|죠))[{s}]+")
    pairs = [
        (T.trim(c), plain(c)), (T.squash(c), plain(F.regexp_replace(c, f"[{s}]+", " "))), (T.decode_entities(c), named),
        (T.split_sentences(c), F.filter(F.transform(cut, plain), lambda x: F.length(x) >= 10)),
    ]
    for fast, slow in pairs:
        assert df.where(~fast.eqNullSafe(slow)).isEmpty()


def test_failures_parse_json_once(spark):
    """the filter of failures parsed a payload again for every mention of its cues."""
    rows = [(1, '{"events": [{"segs": [{"utf8": "x"}]}]}'), (2, "{}"), (3, '<p t="1">y</p>'), (4, "<p></p>"), (5, "* z"), (6, None)]
    failures = read_captions(spark.createDataFrame(rows, "media_id BIGINT, payload STRING"))[1]
    assert sorted((r.media_id, r.code) for r in failures.collect()) == [(i, "no_captions") for i in (2, 4, 5, 6)]
    assert failures._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
