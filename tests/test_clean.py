"""Cleaning folds: golden cases and independence from the block size."""

import pytest
from pyspark.sql import functions as F

from cuelake import schemas
from cuelake.functions import text as T
from cuelake.operators import cuetext as C
from cuelake.operators import speakers as S
from cuelake.plans.clean import clean_transcript, collapse_rolling


def cues(spark, rows, media=1):
    data = [(media, i, int(s * 1000), int(d * 1000), x, None) for i, (s, d, x) in enumerate(rows)]
    return spark.createDataFrame(data, schemas.SEGMENTS)


def texts(df):
    return [r.text for r in df.orderBy("seq").collect()]


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_entities(spark):
    lit = lambda s: value(spark, T.normalize_cue_text(F.lit(s)))
    assert lit("a &amp; b") == "a & b"
    assert lit("&#39;quote&#x22;") == "'quote\""
    assert lit("한글&nbsp;유지") == "한글 유지"
    assert value(spark, T.decode_entities(F.lit("&#128512;&#38;lt; &amp;lt;"))) == "😀< &lt;"


@pytest.mark.parametrize("text, want", [
    ("긴축되는 시장이냐? 긴축되는 시장이냐?", "긴축되는 시장이냐?"),
    ("다룬다고 다룬다고 다룬다고 고정 댓글", "다룬다고 고정 댓글"),
    ("go on now go on now then", "go on now then"),
    ("yes yes yes indeed", "yes indeed"),
])
def test_repeats(spark, text, want):
    assert C.dedupe(text) == want
    assert value(spark, T.dedupe_repeated_phrases(F.lit(text))) == want


def test_rolling_captions(spark):
    df = cues(spark, [(0, 1.2, "we are going to"), (0.4, 1.4, "we are going to talk about"), (1.1, 1.2, "talk about captions")])
    assert texts(collapse_rolling(df)) == ["we are going to talk about captions"]


def test_sentences_and_pause(spark):
    df = cues(spark, [(0, 1.5, "Hello there,"), (1.6, 1.4, "how are you today?"), (4.2, 2, "I wanted to ask about the work."),
                      (14, 3, "Let us continue in a new block.")])
    out = clean_transcript(df)
    assert len(texts(out.segments)) >= 2
    assert "Hello there" in texts(out.paragraphs)[0]


def test_decorative_and_named_marks(spark):
    plain = clean_transcript(cues(spark, [(0, 2, ">> one small thing"), (2.5, 2, ">> another thing"), (5, 2, ">> the last thing")]))
    rows = plain.paragraphs.collect()
    assert all(">>" not in r.text and r.speaker is None for r in rows)
    named = clean_transcript(cues(spark, [(0, 3, ">> Host: Welcome in."), (3.5, 3, ">> Guest: Happy to be here.")]))
    assert [(r.speaker, r.text) for r in named.paragraphs.orderBy("seq").collect()] == [
        ("Host", "Welcome in."), ("Guest", "Happy to be here.")]


def test_interior_mark(spark):
    out = clean_transcript(cues(spark, [(0, 6, "Good evening everyone >> Thank you, glad to be here.")]))
    assert texts(out.paragraphs) == ["Good evening everyone", "Thank you, glad to be here."]


def test_only_noise_keeps_cues(spark):
    out = clean_transcript(cues(spark, [(0, 2, "(cheering)"), (9, 2, "[door]")]))
    assert texts(out.segments) == ["(cheering)", "[door]"]
    assert out.paragraphs.count() >= 1


def test_block_size_does_not_matter(spark):
    words = [f"w{i * 7 % 13}{'.' if i % 9 == 0 else ''}" for i in range(160)]
    rows, at = [], 0.0
    for i in range(0, 150, 3):
        rows.append((at, 1.2, " ".join(words[i:i + 6])))
        at += 0.6 if i % 36 else 5.5
    df = cues(spark, rows).unionByName(cues(spark, rows[5:20], media=2))
    whole, cut = clean_transcript(df), clean_transcript(df, fold_rows=4)
    for a, b in zip(whole, cut):
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert sorted(map(str, collapse_rolling(df).collect())) == sorted(map(str, collapse_rolling(df, 1).collect()))


def test_kernel_agrees_with_columns(spark):
    pairs = [("we talk about", "about captions now"), ("한국어 자막을", "자막을 봅니다"), ("abc", ""), ("a long line here", "a long line here too"),
             ("Hello (", "there"), ("x y z", "unrelated text")]
    df = spark.createDataFrame([(a, b, g) for a, b in pairs for g in (-50.0, 1000.0, 5000.0)], "a STRING, b STRING, g DOUBLE")
    a, b, g = F.col("a"), F.col("b"), F.col("g")
    for r in df.select("a", "b", "g", T.join_cue(a, b).alias("j"), T.pick_longer(a, b).alias("p"), T.should_collapse(a, b, g).alias("c")).collect():
        assert (r.j, r.p, r.c) == (C.join(r.a, r.b), C.longer(r.a, r.b), C.collapses(r.a, r.b, r.g))


def test_interview_roles(spark):
    long = "This is a long answer that goes on for quite a while indeed."
    p = spark.createDataFrame(
        [(1, i, x, None) for i, x in enumerate(["What is this?", long, "And then?", long])], "media_id BIGINT, seq BIGINT, text STRING, speaker STRING"
    ).withColumn("names", F.array(F.lit("Host"), F.lit("Guest")))
    for rows in (100, 1):
        got = [r.speaker for r in S.label_interview(p, rows).orderBy("seq").collect()]
        assert got == ["Host", "Guest", "Host", "Guest"]


def test_grown_text_is_deduped_like_a_whole_one(spark):
    """Only repeats that end in the added words are looked for; the result is that of the whole text."""
    import random

    from cuelake.operators import cuetext

    rng = random.Random(5)
    words = ["ab", "abc", "ABC", "hello", "the cat", "a.", "no!", "가나", "Σας", "one two", "-", "(x", "q?", "…"]
    for _ in range(300):
        said = ""
        for _ in range(8):
            more = " ".join(rng.choice(words) for _ in range(rng.randint(1, 5)))
            grown = cuetext.join(said, more) if said else more
            cuetext._SETTLED.clear()
            whole = cuetext.dedupe(grown)
            cuetext._SETTLED.clear()
            cuetext.dedupe(said)
            said = cuetext.dedupe(grown, said)
            assert said == whole


def test_fold_streams_many_keys_through_a_task(spark):
    """Rows of a block reach the fold behind its state: no frame of a whole block, keys kept apart."""
    from cuelake.operators import folds

    class Sum:
        def __init__(self):
            self.state = [0]

        def push(self, row):
            self.state[0] += row[1] or 0
            return [(row[0], self.state[0])]

        def finish(self):
            return [(-1, self.state[0])]

    rows = [(k, i, (i * 7 + k) % 5 or None) for k in range(40) for i in range(25)]
    df = spark.createDataFrame(rows, "k BIGINT, i BIGINT, v BIGINT")
    out = folds.block_fold(df, ["k"], ["i"], (df.i / 10).cast("bigint"), ["i", "v"], Sum, "i BIGINT, total BIGINT")
    assert "FlatMapCoGroups" not in out._jdf.queryExecution().toString()
    got = {}
    for r in out.collect():
        got.setdefault(r.k, {})[r.i] = r.total
    assert set(got) == set(range(40))
    for k in range(40):
        total = 0
        for i in range(25):
            total += (i * 7 + k) % 5
            assert got[k][i] == total
        assert got[k][-1] == total


def roles_row_by_row(rows, names):
    """Host and guest of (speaker, text) rows, one after the other."""
    host, guest = names[:2]
    last, out = host, []
    for i, (speaker, text) in enumerate(rows):
        size = len(text.replace(" ", ""))
        if speaker and not (len(speaker) == 1 and speaker.isalpha()):
            last = speaker
        elif text.endswith("?"):
            last = host
        elif size > 24 and last == host:
            last = guest
        elif size < 14 and last == guest and i > 0:
            last = host
        out.append(last)
    return out


def test_interview_roles_follow_the_rows(spark):
    import random

    rng = random.Random(3)
    said = ["Why is that so?", "yes", "a line of some words", "a long line that goes on and on for long"]
    cases = {m: [(rng.choice([None, None, None, None, "A", "Carl", "Bea"]), rng.choice(said)) for _ in range(rng.randint(1, 30))] for m in range(60)}
    p = spark.createDataFrame(
        [(m, i, x, s) for m, rows in cases.items() for i, (s, x) in enumerate(rows)], "media_id BIGINT, seq BIGINT, text STRING, speaker STRING"
    ).withColumn("names", F.array(F.lit("Ann"), F.lit("Bea")))
    for cut in (1000, 4):
        out = S.label_interview(p, cut)
        # no fold in Python, and no row is looked up again
        assert "MapInArrow" not in out._jdf.queryExecution().toString()
        got = {(r.media_id, r.seq): r.speaker for r in out.collect()}
        assert got == {(m, i): who for m, rows in cases.items() for i, who in enumerate(roles_row_by_row(rows, ["Ann", "Bea"]))}


def test_labels_read_their_paragraphs_twice_at_most(spark):
    rows = [(m, i, i * 1000, 500, "Why?" if i % 3 == 0 else f"a line of words number {i}", None) for m in range(6) for i in range(20)]
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    schema = "media_id BIGINT, seq BIGINT, start_ms BIGINT, dur_ms BIGINT, text STRING, speaker STRING"
    plain = spark.createDataFrame(rows, schema)
    kinds = spark.createDataFrame(
        [(m, "general" if m == 0 else "interview", "- Ana: hello\n- Ben: hi", []) for m in range(6)],
        "media_id BIGINT, kind STRING, summary STRING, speakers ARRAY<STRING>")
    turns = spark.createDataFrame([(2, 0, 0, "B"), (2, 0, 4, "A"), (0, 0, 0, "A")], "media_id BIGINT, pos INT, i BIGINT, speaker STRING")
    marked, told = S.finish_labels(plain, plain.mapInPandas(count, schema), kinds, turns)
    got = {(r.media_id, r.seq): r.speaker for r in marked.collect()}
    assert seen.value <= 2 * len(rows)
    assert [got[0, i] for i in range(20)] == [None] * 20
    assert [got[2, i] for i in range(6)] == ["Ben"] * 4 + ["Ana"] * 2
    assert set(got[1, i] for i in range(20)) == {"Ana"}
    assert told.columns == plain.columns and {(r.media_id, r.seq): r.speaker for r in told.collect()}[2, 19] == "Ana"


def collapsed_row_by_row(rows):
    """Collapsed cues, each text looked at as a whole."""
    out = []
    for seq, start, dur, text, who in rows:
        text = C.dedupe(text)
        if not text:
            continue
        if out:
            at, was, length, said, first = out[-1]
            if said == text or C.collapses(said, text, start - (was + length)):
                out[-1] = (at, was, max(length, start + dur - was), C.dedupe(C.longer(said, text)), first)
                continue
        out.append((seq, start, dur, text, who))
    return out


def fold_all(rows, cut):
    """The rows through the fold, its state written and read again at `cut`."""
    import json

    from cuelake.operators.folds import Collapse

    fold, out = Collapse(), []
    for i, row in enumerate(rows):
        if i == cut:
            state, fold = json.loads(json.dumps(fold.state)), Collapse()
            fold.state = state
        out += fold.push(row)
    return [*out, *fold.finish()]


def test_rolling_cues_equal_whole_texts():
    import random

    rng = random.Random(8)
    vocabularies = [
        ["ab", "abc", "ABC", "hello", "the", "The", "a.", "no!", "가나", "가나다", "ΑΣ", "ΣΑΒΓΔΕΖ", "xΣΑΒΓΔΕΖ", "xthe", "the,", "İx", "sun", "ſun"],
        ["the", "xthe", "abcdef", "xabcdef", "of", "to"], ["a", "b", "aa", "ab"], ["ñ", "étre", "de", "|", "IN!!", "of"],
        [f"w{i}" for i in range(30)] + ["the", "abcdefgh"], ["one\u00a0two", "x\x01y", "  ", "foo"],
    ]
    for _ in range(3000):
        words = [rng.choice(rng.choice(vocabularies) if rng.random() < 0.02 else vocabularies[_ % 6]) for _ in range(rng.randint(1, 40))]
        rows, start, i = [], 0.0, 0
        while i < len(words):
            text = " ".join(words[i : i + 6])[rng.choice([0] * 9 + [1]) :] + rng.choice([""] * 9 + [" ", ".", "…"])
            rows.append((len(rows), start, 1200.0, text, None))
            start, i = start + rng.choice([600.0] * 9 + [7000.0]), i + rng.choice([3] * 9 + [0, 6])
        assert fold_all(rows, rng.randint(0, len(rows))) == collapsed_row_by_row(rows), rows


def test_rolling_cue_is_only_appended(monkeypatch):
    """Of a cue that rolls on only the added words are looked at, not the grown text."""
    words = [f"{a}{b}" for a in "bcdfgh" for b in ("an", "éro", "ist", "um")] * 3
    words = [f"{w}{i}" for i, w in enumerate(words)]
    rows = [(i, 600.0 * i, 1200.0, " ".join(words[3 * i : 3 * i + 6]), None) for i in range(len(words) // 3 - 1)]
    want, calls, whole = collapsed_row_by_row(rows), [], C.dedupe
    assert [r[3] for r in want] == [" ".join(words)]
    monkeypatch.setattr(C, "dedupe", lambda *a: calls.append(a) or whole(*a))
    assert fold_all(rows, -1) == want and calls == []


def test_texts_that_normalizing_leaves_alone(spark):
    import random

    from cuelake.plans.clean import _normalized

    rng = random.Random(9)
    parts = ["word", "a", " ", " ", "  ", "\t", "\n", "\r", "\u00a0", "\u2028", "\u3000", "\x85", "&amp;", "&#39;", "&", ">>", ">", "»", "[music]", "(x)", "[", "한글", "é", "\\", "~", "!", "Z", ")"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 6))) for _ in range(4000)] + [None]
    df = spark.createDataFrame([(t,) for t in texts], "text STRING")
    got = _normalized(df.withColumn("was", F.col("text"))).withColumn("want", T.normalize_cue_text(F.col("was")))
    assert got.where(~F.col("text").eqNullSafe(F.col("want"))).collect() == []
    assert value(spark, T.may_change(F.lit("a plain line, of words"))) is False


def test_only_rows_of_blocks_with_a_later_one_are_written_again(spark, monkeypatch):
    from cuelake.operators import folds

    written, stage = [], folds.stage_table
    monkeypatch.setattr(folds, "stage_table", lambda df, label: (lambda out: written.append(out.count()) or out)(stage(df, label)))
    rows = [(m, i, 600 * i, 1200, f"w{i} w{i + 1} w{i + 2}", None) for m in range(30) for i in range(20 if m == 3 else 6)]
    df = spark.createDataFrame(rows, schemas.SEGMENTS)
    cut = sorted(map(str, collapse_rolling(df, 8).collect()))
    assert written == [16]
    assert cut == sorted(map(str, collapse_rolling(df).collect())) and written == [16]


def test_captions_of_documents_equal_brute_force(spark, tmp_path):
    import re

    from catalog.adapters import rolling_captions
    from catalog.base import Tables

    texts = ["one two three. four\t\tfive  six seven eight nine ten eleven\n\n twelve .", "", " . ", "a b c d e f g. a\u00a0b", "x", None,
             "".join(f"w{i} b\n" for i in range(70_000))]
    rows = [(i, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id BIGINT, text STRING").write.parquet(f"{tmp_path}/documents.parquet")
    want = set()
    for doc, text in rows:
        seq = begin = 0
        for line in re.split("[.\n]+", text or ""):
            words = [w for w in re.split("[ \t]+", line) if w]
            if not words:
                continue
            windows = [" ".join(words[i : i + 6]) for i in range(0, max(1, len(words) - 3), 3)]
            want |= {(doc, seq + i, begin + 600 * i, 1200, w, None) for i, w in enumerate(windows)}
            seq, begin = seq + len(windows), begin + 600 * (len(windows) - 1) + 6200
    got = [tuple(r) for r in rolling_captions(Tables(spark, str(tmp_path))).collect()]
    assert len(got) == len(want) and set(got) == want
