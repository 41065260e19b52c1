"""Encoder, bit-packed files and packing."""

import io
import random
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from cuelake.llm import bitpack as b  # noqa: E402
from cuelake.llm import packing as p  # noqa: E402
from cuelake.llm.encoder import Encoder, in_slices  # noqa: E402
from tests.llm.helpers import odd_documents, prose, with_clashes  # noqa: E402

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", " ", "a  b", "a\n\n b", " x", "x ", "a\t b", "a \nb", "foo<|endoftext|> bar <|endoftext|>x", "\x00 a b", "a \x00b", "a　 b c",
    "é ́ x", "Ünï  'll don't  \r\n\r\n z", "１２３ 12 3", "日本 語", "a\x1cb \x1c c", "x\x85 y", "A" * 3000,
]


@pytest.mark.parametrize("path,spaces", [(BYTES, True), (WORDS, False)])
def test_encoder_equals_the_library(path, spaces):
    rng = random.Random(1)
    pieces = [" ", "  ", "\n", "\t", "a", "'s", "don't", "1", "é", "́", "。", "<|endoftext|>", " ", "\x00", "Word", "\r\n", ". ", ", ", "..", "_", "!", "<|STARTOFTEXT|>", "İ", "Σ", "½"]
    texts = ODD + ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 20))) for _ in range(600)]
    enc = Encoder(path, spaces, most_chars=500)  # forgets on the way
    for a, z in in_slices(texts, 300):
        ids, counts = enc.encode(texts[a:z])
        got = np.split(ids, np.cumsum(counts)[:-1])
        for text, mine in zip(texts[a:z], got):
            assert mine.tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids, text


def test_pack_round_trip():
    rng = np.random.default_rng(2)
    for bits in (1, 3, 7, 8, 11, 16, 17, 31, 32):
        for n in (0, 1, 7, 8, 1000):
            ids = rng.integers(0, 1 << bits, n, dtype=np.uint64).astype(np.uint32)
            data = b.pack(ids, bits)
            assert len(data) == -(-n * bits // 8)
            assert (b.unpack(data, bits, n) == ids).all()
    assert [b.bits_for(v) for v in (1, 2, 3, 50257, 65536, 65537)] == [1, 1, 2, 16, 16, 17]


def test_file_and_random_access():
    rng = np.random.default_rng(3)
    docs = [(k if k % 5 else None, rng.integers(0, 5000, n).astype(np.uint32)) for k, n in enumerate([0, 3, 100, 1, 64, 65, 1000, 0, 17])]
    stream = io.BytesIO()
    writer = b.PackedWriter(stream, 13, block=64)
    for doc, ids in docs:
        writer.add(doc, ids)
    writer.close()
    packed = b.PackedFile(stream)
    every = np.concatenate([ids for _, ids in docs])
    for size in (1, 70, 10_000):
        got = list(packed.documents(size))
        assert [(d, ids.tolist()) for d, _, ids in got] == [(d, ids.tolist()) for d, ids in docs]
    for start, end in ((0, 0), (0, 1), (63, 65), (64, 128), (100, 1250), (0, len(every))):
        assert (packed.read_ids(start, end) == every[start:end]).all()
    with pytest.raises(ValueError):
        b.PackedFile(io.BytesIO(bytes(100)))


def expected(docs, path, end_id):
    tokenizer = Encoder(path, True).tokenizer
    return [(r.doc_id, tokenizer.encode(r.text or "", add_special_tokens=False).ids + [end_id]) for r in docs.collect()]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_corpus_files(spark, tmp_path):
    docs = odd_documents(spark)
    manifest = b.write_corpus(with_clashes(docs).repartition(3), BYTES, True, 2, str(tmp_path / "ids"), block=1000)
    rows = b.read_documents(manifest).orderBy("start").collect()
    want = sorted(((d is not None, d or 0, crc(ids), len(ids)) for d, ids in expected(docs, BYTES, 2)))
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.ids_crc32, r.n_tokens) for r in rows) == want
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in rows]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    assert b.read_documents(b.write_corpus(docs.limit(0), BYTES, True, 2, str(tmp_path / "none"))).collect() == []


def test_best_fit_equals_brute_force():
    rng = random.Random(4)
    for size in (1, 7, 16, 100):
        for _ in range(30):
            lengths = sorted((rng.randint(1, size) for _ in range(rng.randint(0, 60))), reverse=True)
            rooms, want = [], []
            for n in lengths:
                best = min((r for r in rooms if r >= n), default=None)
                if best is None:
                    rooms.append(size - n)
                    want.append(size)
                else:
                    rooms[rooms.index(best)] = best - n
                    want.append(best)
            got = p.best_fit_decreasing(lengths, size)
            assert [size - offset for _, offset in got] == want
            assert len({w for w, _ in got}) == len(rooms)


def test_packed_pieces(spark):
    rng = random.Random(5)
    docs = odd_documents(spark).unionByName(
        spark.createDataFrame([(100 + k, prose(rng, rng.randint(1, 900)), "en", "a", 0) for k in range(60)], odd_documents(spark).schema)
    )
    rows = p.pack_documents(with_clashes(docs).coalesce(2), WORDS, False, 1, size=256, buffer_ids=9000).collect()
    want = sorted((d is not None, d or 0, tuple(ids)) for d, ids in expected(docs, WORDS, 1))
    by_doc: dict = {}
    for r in rows:
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32
        by_doc.setdefault((r.doc_id is not None, r.doc_id or 0), []).append(r)
    assert sum(r.length for r in rows) == sum(len(ids) for *_, ids in want)
    for key, ids in {(a, d): ids for a, d, ids in want if d != 7}.items():
        parts = sorted(by_doc[key], key=lambda r: r.start)
        assert np.concatenate([np.frombuffer(r.ids, "<u4") for r in parts]).tolist() == list(ids)
        assert all(r.doc_tokens == len(ids) for r in parts)
    sequences: dict = {}
    for r in sorted(rows, key=lambda r: r.offset):
        assert r.offset == sequences.get(r.sequence_id, 0)
        sequences[r.sequence_id] = r.offset + r.length
    assert max(sequences.values()) <= 256
    assert sum(sequences.values()) / (256 * len(sequences)) > 0.97
    assert p.pack_documents(docs.limit(0), WORDS, False, 1).collect() == []
