"""Packs, history search and its index, and terms in blocks against plain versions."""

import random

from cuelake.operators import search, summary


def greedy(sizes, limit):
    packs, used, pack = [], 0, 0
    for k, size in enumerate(sizes):
        if k and used + size > limit:
            pack, used = pack + 1, 0
        packs.append(pack)
        used += size + 1
    return packs


def test_packs_follow_the_greedy_rule(spark):
    rng = random.Random(5)
    sizes = {m: [rng.choice([0, 1, 30, 900, 6999, 7000, 7001, 20000, rng.randrange(4000)]) for _ in range(n)] for m, n in enumerate([1, 2, 3, 40, 300])}
    sizes[9] = [3400] * 64
    rows = [(m, 3 * k, "x" * s, None) for m, v in sizes.items() for k, s in enumerate(v)] + [(10, 0, None, None)]
    paragraphs = spark.createDataFrame(rows, "media_id BIGINT, seq BIGINT, text STRING, speaker STRING")
    want = set()
    for m, v in sizes.items():
        packs = greedy(v, summary.PACK_CHARS)
        for p in set(packs):
            want.add((m, p, "\n".join("x" * s for s, q in zip(v, packs) if q == p)))
    want.add((10, 0, ""))
    for span in (summary.BLOCK_ROWS, 5000):
        assert {tuple(r) for r in summary.pack_lines(paragraphs, span).collect()} == want


def test_packs_of_an_empty_table(spark):
    none = spark.createDataFrame([], "media_id BIGINT, seq BIGINT, text STRING, speaker STRING")
    assert summary.pack_lines(none).collect() == []


def history(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("ab É😀.") for _ in range(rng.randrange(6)))
    titles = [(m, rng.choice(["Talk", "", None, "ab"])) for m in range(60)]
    lines = [(m, s, rng.choice([word(), None, ""])) for m in range(50) for s in range(rng.randrange(6))]
    slides = [(m, o, word()) for m in range(20, 60) for o in range(rng.randrange(3))]
    text = {}
    for m, title in titles:
        body = [x or "" for k, _, x in lines if k == m]
        shown = [x for k, _, x in slides if k == m]
        text[m] = " ".join([title or "", *(body or [""]), *shown]).lower() + " "
    tables = (
        spark.createDataFrame(titles, "media_id BIGINT, title STRING"),
        spark.createDataFrame(lines, "media_id BIGINT, seq BIGINT, text STRING"),
        spark.createDataFrame(slides, "media_id BIGINT, ord BIGINT, text STRING"),
    )
    return tables, text


def test_history_search_and_index_equal_the_joined_text(spark):
    (jobs, paragraphs, slides), text = history(spark)
    index = search.build_history_index(jobs, paragraphs, slides)
    longest = max(text.values(), key=len)
    for term in ("a", "  ", "a b", "AB ", "   ", "é😀", "a  b", "aaaa", ". . ", "b.a b", longest[2:30], longest, "talk  "):
        want = {m for m, x in text.items() if term.lower() in x}
        assert {r.media_id for r in index.search(term).collect()} == want, term
    for term in ("a  b", longest[2:30]):
        want = {m for m, x in text.items() if term in x}
        assert {r.media_id for r in search.search_history(jobs, paragraphs, term, slides).collect()} == want


def test_a_search_reads_the_buckets_of_its_grams(spark):
    (jobs, paragraphs, slides), _ = history(spark)
    index = search.build_history_index(jobs, paragraphs, slides)
    plan = index.search("abc")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_terms_in_blocks_and_buffers(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcA ") for _ in range(rng.randrange(80))) for _ in range(200)] + [None, ""]
    terms = sorted({"".join(rng.choice("abcd") for _ in range(rng.randrange(1, 4))) for _ in range(60)})
    docs = spark.createDataFrame([(x,) for x in texts], "text STRING")
    got = search.term_counts(docs, "text", spark.createDataFrame([(w,) for w in terms], "term STRING"), block_terms=7, buffer_chars=300)
    assert {r.term: r.n for r in got.collect()} == {w: sum((x or "").lower().count(w) for x in texts) for w in terms}
