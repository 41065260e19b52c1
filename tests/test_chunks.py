"""Chunk planning and merging: golden cases, and brute force for the boundary match."""

import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cuelake.operators import chunks as K


def plan(spark, duration, silences=()):
    media = spark.createDataFrame([(1, duration)], "media_id BIGINT, duration_ms DOUBLE")
    s = spark.createDataFrame([(1, i, a, b) for i, (a, b) in enumerate(silences)], "media_id BIGINT, pos BIGINT, start_ms BIGINT, end_ms BIGINT")
    return [(r.core_start, r.core_end, r.start, r.end, r.id) for r in K.plan_chunks(media, s).orderBy("idx").collect()]


def test_plan_near_silence(spark):
    rows = plan(spark, 620_000.0, [(297_400, 298_200)])
    assert len(rows) == 3
    assert rows[0][:4] == (0.0, 297_800.0, 0.0, 300_800.0) and rows[1][2] == 294_800.0 and rows[-1][3] == 620_000.0
    assert rows[0][4] == "chunk-0.000-297.800"


def test_plan_without_silence_and_degenerate(spark):
    rows = plan(spark, 601_000.0)
    assert [r[2] for r in rows] == [0.0, 297_000.0, 597_000.0] and rows[0][1] == 300_000.0 and rows[-1][3] == 601_000.0
    assert plan(spark, 0.0) == [] and plan(spark, float("inf")) == []
    assert plan(spark, 10_000.0)[0][:4] == (0.0, 10_000.0, 0.0, 10_000.0)


def test_split(spark):
    p = spark.createDataFrame(
        [(1, "c", 0, 0.0, 300_000.0, 600_000, 7_000_000), (1, "d", 1, 300_000.0, 305_000.0, 600_000, 9_000_000)],
        "media_id BIGINT, id STRING, idx BIGINT, core_start DOUBLE, core_end DOUBLE, duration_ms BIGINT, size_bytes BIGINT")
    rows = K.reindex_plan(K.split_oversized(p)).orderBy("idx").collect()
    assert [r.id for r in rows] == ["c.1", "c.2", "c.3", "d"] and [r.idx for r in rows] == [0, 1, 2, 3]
    assert rows[0].core_end == rows[1].core_start and rows[2].core_end == 300_000.0 and rows[0].end - rows[1].start == 6000.0
    assert rows[3].cannot_split


def merge(spark, first, second, mode="speech", gap=0.0):
    rows = [(1, "a", 0, 0.0, 300_000.0, 0.0, 303_000.0 - gap, first), (1, "b", 1, 300_000.0, 600_000.0, 297_000.0 + gap, 600_000.0, second)]
    df = spark.createDataFrame(rows, "media_id BIGINT, id STRING, idx BIGINT, core_start DOUBLE, core_end DOUBLE, start DOUBLE, end DOUBLE, text STRING")
    segments, audit = K.merge_chunks(df, mode)
    return [r.text for r in segments.orderBy("seq").collect()], audit.first()


BOUNDARY = "오늘은 새로운 인공지능 반도체 시장을 자세히 살펴보겠습니다."


def test_exact_boundary_kept_once(spark):
    text, audit = merge(spark, f"앞부분입니다. {BOUNDARY}", f"{BOUNDARY} 다음 내용입니다.")
    assert text == [f"앞부분입니다. {BOUNDARY}", "다음 내용입니다."]
    assert (audit.confidence, audit.method) == ("high", "normalized-exact")


def test_alias_spelling(spark):
    text, audit = merge(spark, "먼저 말씀드립니다. NVIDIA의 새로운 데이터센터 제품을 소개하겠습니다.",
                        "엔비디아의 새로운 데이터센터 제품을 소개하겠습니다. 이어지는 문장입니다.")
    assert text[1] == "이어지는 문장입니다." and audit.method == "fuzzy-anchored"


def test_spacing_variants(spark):
    text, _ = merge(spark, "시작. 새로운 반도체 시장 전망을 자세히 살펴보겠습니다.", "새로운반도체 시장전망을 자세히살펴보겠습니다. 다음.")
    assert text[1] == "다음."


@pytest.mark.parametrize("first, second, mode, gap", [
    ("We saw powerful growth across the entire cloud market.", "We saw useful growth across the entire cloud market. Next.", "speech", 0),
    ("Thank you.", "Thank you. Next item.", "speech", 0),
    (BOUNDARY, f"{BOUNDARY} 끝.", "lyrics", 0),
    (BOUNDARY, f"{BOUNDARY} 끝.", "speech", 3000.0),
    ("가" * 60_000, "가" * 60_000, "speech", 0),
])
def test_kept(spark, first, second, mode, gap):
    text, audit = merge(spark, first, second, mode, gap)
    assert text == [first, second] and audit.removed == 0


def brute(prev, nxt, overlap):
    import regex

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    words, chars = min(50, int(overlap * 6)), int(overlap * 40)
    spans = lambda s: [(m.start(), m.end()) for m in regex.finditer(r"[^\s.!?。！？]+[.!?。！？]*", s)]
    left = [s for s, _ in spans(prev)[-words:] if len(prev) - s <= chars]
    right = [e for _, e in spans(nxt)[:words] if e <= chars]
    highs, maybe = [], []
    tail = K.normalized(prev[-chars:])
    for e in right:
        p = K.normalized(nxt[:e])
        if len(p) >= 20 and tail.endswith(p):
            highs.append((e, 10**6, 1.0, "normalized-exact"))
    for n in range(len(left), 0, -1):
        a = prev[left[-n]:]
        for m in range(max(1, n - 2), min(len(right), n + 2) + 1):
            b = nxt[:right[m - 1]]
            if len(K.normalized(a)) < 20 or len(K.normalized(b)) < 20:
                continue
            x, y = K.comparison_key(a), K.comparison_key(b)
            exact = K.normalized(a) == K.normalized(b)
            sim = 1.0 if exact or x == y else 1 - lev(x, y) / max(len(x), len(y))
            if sim < 0.78:
                continue
            anchored = x[-8:] == y[-8:] and (x[:8] == y[:8] or x[8:16] == y[8:16])
            if exact or (sim >= 0.88 and anchored):
                highs.append((right[m - 1], n, sim, "normalized-exact" if exact else "fuzzy-anchored"))
            else:
                maybe.append((sim, n, -m))
    if highs:
        e, _, sim, method = max(highs)
        return e, round(sim, 9), method
    return (0, round(max(maybe)[0], 9), "ambiguous-kept") if maybe else (0, 0.0, "none")


def test_match_equals_brute_force(spark):
    base = "the quick brown fox jumps over the lazy dog while many small birds sing in the tall trees near our old house".split()
    cases = []
    for i in range(12):
        shared = base[i:i + 4 + i % 8]
        changed = [w if (k + i) % 5 else w[::-1] for k, w in enumerate(shared)]
        cases.append((" ".join(["intro"] * 3 + shared), " ".join((changed if i % 2 else shared) + ["outro", "words", "follow"])))
    rows = []
    for m, (a, b) in enumerate(cases):
        rows += [(m, "a", 0, 0.0, 300_000.0, 0.0, 303_000.0, a), (m, "b", 1, 300_000.0, 600_000.0, 297_000.0, 600_000.0, b)]
    df = spark.createDataFrame(rows, "media_id BIGINT, id STRING, idx BIGINT, core_start DOUBLE, core_end DOUBLE, start DOUBLE, end DOUBLE, text STRING")
    got = {r.media_id: (r.removed, round(r.similarity, 9), r.method) for r in K.merge_chunks(df)[1].collect()}
    assert got == {m: brute(a, b, 6.0) for m, (a, b) in enumerate(cases)}


def test_fixed_rounds_half_up_on_the_exact_value(spark):
    from decimal import ROUND_HALF_UP, Decimal

    values = [0.0, 62.5, 2_100_481.5, 300_000.0, 999_999.5, 187.5, 7_199_999.9996]
    df = spark.createDataFrame([(v,) for v in values], "v DOUBLE").select("v", K._fixed(F.col("v")).alias("s"))
    for r in df.collect():
        assert r.s == str(Decimal(r.v / 1000).quantize(Decimal("0.001"), ROUND_HALF_UP))


def test_folded_pieces_equal_whole(spark):
    texts = ["Ａb ć.d  è! ﬁne½ 가가 나", "ΟΔΟΣ.ΣΑΣ Σ. xͅ ΑΣ!Σ", "İI.ı ́a ①②… ㍿ x", "엔비디아 a.b.c?d", ""]
    for text in texts:
        cuts = [m.start() for m in re.finditer(r"[^\s.!?。！？]+[.!?。！？]*", text)]
        ends = [m.end() for m in re.finditer(r"[^\s.!?。！？]+[.!?。！？]*", text)]
        assert K.normalized_runs(text, cuts, True) == [K.normalized(text[c:]) for c in cuts]
        assert K.normalized_runs(text, ends, False) == [K.normalized(text[:e]) for e in ends]


def test_equal_overlap_leaves_few_pairs(spark):
    said = " ".join(f"word{k}x" for k in range(12))
    tail = " ".join(f"before{k}" for k in range(20)) + " " + said
    head = said + " " + " ".join(f"after{k}" for k in range(20))
    sides = K.boundary_sides.func(pd.Series([tail, "a b " + tail]), pd.Series([head, "c d " + head]), pd.Series([400, 400]), pd.Series([36, 36]))
    assert sides["sure"][0]["end"] == len(said) and sides["sure"][1] is None
    pairs = [sum(len(a["near"]) for a in left) for left in sides["left"]]
    assert pairs[0] <= 3 and pairs[1] > 0
