"""Alignment of two tokenizers against both libraries on whole texts and groups cut by hand."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from cuelake.llm import alignment as al  # noqa: E402
from tests.llm.helpers import documents, odd_documents, prose, with_clashes  # noqa: E402

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "x", " ", "  ", "a  b", " lead", "trail ", "a\n\n b", "a \nb", "<|endoftext|>", "a <|endoftext|> b<|endoftext|>", "u▁v", "▁", "\x00 a b",
    "<s> </s> <unk> <0x41>", "é é ́", "日本 語 です", "😀 😀😀", "a　b c", "1 22 333 4444", "x y z", "a\x1c b", "A" * 700,
    "don't can't 'll", "\r\n\r\n z", " \U000f0000", "a" + " " * 40 + "b",
]


def cut(ends_a, ends_b, ids_a, ids_b):
    """Groups and links by plain loops."""
    groups, links, i, j = [], [], 0, 0
    for end in sorted(set(ends_a) & set(ends_b)):
        own_a, own_b = [], []
        while i < len(ends_a) and ends_a[i] <= end:
            own_a.append(i)
            i += 1
        while j < len(ends_b) and ends_b[j] <= end:
            own_b.append(j)
            j += 1
        groups.append((own_a, own_b))
        for x in own_a:
            for y in own_b:
                left = max(ends_a[x - 1] if x else 0, ends_b[y - 1] if y else 0)
                if left < min(ends_a[x], ends_b[y]):
                    links.append((ids_a[x], ids_b[y]))
    text = ";".join(",".join(str(ids_a[x]) for x in a) + "|" + ",".join(str(ids_b[y]) for y in b) for a, b in groups)
    return len(groups), links, hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def slow():
    import sentencepiece
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(A)
    whole.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=B)
    table = al.Aligner(A, B)

    def one(text):
        if not text:
            return 0, 0, 0, [], ""
        ids_a, ids_b = whole.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text)
        parts_a, parts_b = [table.bytes_a[i] for i in ids_a], [table.bytes_b[i] for i in ids_b]
        if not b"".join(parts_a) == b"".join(parts_b) == (" " + text).encode():
            return 0, 0, 0, [], ""
        ends_a, ends_b = np.cumsum([len(p) for p in parts_a]).tolist(), np.cumsum([len(p) for p in parts_b]).tolist()
        groups, links, digest = cut(ends_a, ends_b, ids_a, ids_b)
        return len(ids_a), len(ids_b), groups, links, digest

    return one


def test_terminals_follow_components():
    rng = random.Random(1)
    for _ in range(200):
        end = rng.randint(1, 60)
        a, b = (np.array(sorted({end, *(rng.randint(1, end) for _ in range(rng.randint(0, 40)))})) for _ in "ab")
        ids_a, ids_b = list(range(len(a))), list(range(len(b)))
        groups, pairs, _ = cut(a.tolist(), b.tolist(), ids_a, ids_b)
        got_a, got_b = al.group_numbers(a, b)
        assert got_a[-1] == got_b[-1] == groups - 1
        x, y, _ = al.links(a, b)
        assert sorted(zip(x.tolist(), y.tolist())) == sorted(pairs)
        assert all(got_a[i] == got_b[j] for i, j in pairs)
    chain = np.arange(2, 200_002, 2)
    assert (al.terminals(np.append(chain, 200_001), np.append(chain - 1, 200_001)) == 100_000).all()


def test_texts_equal_both_libraries(slow):
    rng = random.Random(2)
    bits = [" ", "  ", "\n", "a", "'s", "don't", "1", "é", "́", "。", "<|endoftext|>", "▁", "\x00", "Word", "\r\n", "　", "<0x0A>"]
    texts = ["", *ODD, *("".join(rng.choice(bits) for _ in range(rng.randint(0, 20))) for _ in range(800))]
    both = al.Aligner(A, B, most_chars=300)  # forgets on the way
    for a, z in al.in_slices(texts, 200):
        for text, (n_a, n_b, groups, n_links, digest, codes) in zip(texts[a:z], both.align(texts[a:z])):
            want = slow(text)
            pairs = sorted(x * len(both.bytes_b) + y for x, y in want[3])
            assert (n_a, n_b, groups, n_links, digest, sorted(codes.tolist())) == (*want[:3], len(want[3]), want[4], pairs), text


@pytest.mark.parametrize("most_pairs", [al.MOST_PAIRS, 50])
def test_documents(spark, slow, most_pairs):
    rng = random.Random(3)
    more = documents(spark, [(100 + k, rng.choice([rng.choice(ODD), prose(rng, rng.randint(1, 60))]), "en", "a") for k in range(80)])
    docs = odd_documents(spark).unionByName(more)
    own = [(r.doc_id, *slow(r.text)) for r in docs.collect()]
    counts = Counter(p for _, *_, pairs, _ in own for p in set(pairs))
    best = {}
    for (a, _), n in counts.items():
        best[a] = max(best.get(a, 0), n)
    want = [
        (i, n_a, n_b, g, len(p), sum(counts[x] == best[x[0]] for x in p), sum(counts[x] for x in p), h) for i, n_a, n_b, g, p, h in own
    ]
    got = [tuple(r) for r in al.align_tokenizers(with_clashes(docs).repartition(3), A, B, most_pairs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_nothing_to_align(spark):
    docs = odd_documents(spark)
    assert al.align_tokenizers(docs.limit(0), A, B).collect() == []
    rows = al.align_tokenizers(docs.where("text is null or text = ''"), A, B).collect()
    assert len(rows) == 2 and all(tuple(r)[1:] == (0, 0, 0, 0, 0, 0, "") for r in rows)
