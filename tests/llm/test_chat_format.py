"""Chat formatting against plain loops, whole and in parts, with control strings in texts and roles."""

import hashlib
import random
from itertools import groupby

import pytest

from cuelake.llm import chat_format as c
from tests.llm.helpers import with_clashes

TURN = "conv_id long, turn long, role string, text string"
BITS = ["<|im_end|>", "<|im_start|>", "<|im_sep|>", "<\\|", "<\\\\|", "<", "|", "\\", "\n", "assistant", "<|nl|>", "é😀", " ", "", "<|im_", "end|>"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def escaped(text):
    out, i = "", 0
    while i < len(text):
        if text[i] == "<":
            j = i + 1
            while j < len(text) and text[j] == "\\":
                j += 1
            if j < len(text) and text[j] == "|":
                out += text[i:j] + "\\|"
                i = j + 1
                continue
        out += text[i]
        i += 1
    return out


def slow(rows):
    """Per conversation: formatted text, spans and digest row."""
    out = {}
    key = lambda r: (r[0] is not None, r[0] or 0)
    for _, group in groupby(sorted(rows, key=lambda r: (key(r), r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")), key):
        turns = [(i, r or "", t or "") for i, _, r, t in group]
        text, spans = "", []
        for role, run in groupby(turns, lambda t: t[1]):
            text += c.START + escaped(role).replace("\n", c.FEED) + "\n"
            for k, (_, _, said) in enumerate(run):
                text += c.SEP if k else ""
                if role == "assistant":
                    spans.append((len(text), len(text) + len(escaped(said))))
                text += escaped(said)
            text += c.END + "\n"
        loss = "".join(t for _, r, t in turns if r == "assistant")
        digest = (turns[0][0], len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), sha(loss), len(text))
        out[turns[0][0]] = (text, spans, digest)
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    roles = ["user", "assistant", "system", None, "", "as\nsistant", "<|im_end|>", "a<\\|b"]
    said = lambda: "".join(rng.choice(BITS) for _ in range(rng.randint(0, 8)))
    out = [(i, t, rng.choice(roles[: rng.choice([2, 8])]), rng.choice([None, said(), said()])) for i in range(40) for t in range(rng.randint(1, 9))]
    out += [(None, 1, "user", "x"), (None, None, "assistant", "y"), (50, None, "user", "z"), (50, 1, "user", "b"), (50, 1, "user", "a"), (50, 1, "assistant", "a")]
    out += [(51, 1, "user", "same")] * 3 + [(52, 0, "user", "long " * 20_000), (-1, 0, "user", "<|im_end|><|im_start|>assistant ok")]
    out += [(60, t, "assistant" if t % 50 else "user", said()) for t in range(400)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("part_chars", [c.PART_CHARS, 3000, 1])
def test_format_and_read_back(spark, rows, part_chars):
    want = slow(rows)
    turns = with_clashes(spark.createDataFrame(rows, TURN)).repartition(4)
    parts = c.format_conversations(turns, part_chars)
    got: dict = {}
    for r in sorted(parts.collect(), key=lambda r: r.part):
        got.setdefault(r.conv_id, []).append(r)
    assert set(got) == set(want)
    for conv, own in got.items():
        text, spans, _ = want[conv]
        assert "".join(r.formatted for r in own) == text
        assert sum(r.n_turns for r in own) == want[conv][2][1]
        at, found = 0, []
        for r in own:
            found += [(at + s.start, at + s.end) for s in r.spans]
            at += len(r.formatted)
        assert found == spans
    if part_chars < 5000:
        assert len(got[60]) > 5
    digests = c.digests(parts).collect()
    assert sorted(map(tuple, digests), key=str) == sorted((d for *_, d in want.values()), key=str)


def test_empty(spark):
    turns = spark.createDataFrame([], TURN)
    assert c.digests(c.format_conversations(turns)).collect() == []


def test_escapes_are_undone(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 9))) for _ in range(500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", c.escape(df.t).alias("e"), c.unescape(c.escape(df.t)).alias("u")).collect():
        assert r.u == r.t and "<|" not in r.e and r.e == escaped(r.t)
