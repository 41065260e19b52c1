"""Alignment of two tokenizers over the same bytes, by pointer jumping.

Tokens of both sides cut one line of bytes. Every token points to the token of the other side that
overlaps it and reaches farthest right; where both sides end together, the token of the first side
points to itself. Doubling the pointers until they rest leads every token to the terminal token of
its component, which labels its group: the tokens between two offsets where both sides end.

Both tokenizers always cut before a single space between two characters that are not white space, so
the bytes of a text are aligned piece by piece, a distinct piece once per task while it is
remembered, all new pieces of a slice in one vectorised run. Nothing is cut elsewhere: a text that
has no such place is one piece.

Jobs. One map encodes and aligns the texts and writes a row per document, with its distinct linked
id pairs, to the shared folder. Pairs are counted in the task (a bounded buffer at a time) and summed
by pair. The counts are read by ranges of first-side ids that hold at most `most_pairs` pairs, which
bounds what a task is sent; the documents' sums over the ranges are added up. A frequent pair is
looked up where its documents are, so no key is hot.

Edge cases. Null and empty texts, and texts whose tokens do not join to a space and the text on
either side (such as those holding U+2581), have no tokens: zeros and an empty digest, and no count
in any pair. Repeated rows and null ids: every row is a document. Empty table: empty result. Other
columns are ignored."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import reduce
from itertools import chain, repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import stage_table, text_batches
from cuelake.llm.encoder import byte_alphabet, in_slices

_SAFE_SPACE = re.compile(r"(?<=\S) (?=\S)")
_SPACE_BESIDE = re.compile(r" \s|\s |\A\s|\s\Z")
MOST_PAIRS = 2_000_000


def terminals(a_ends: np.ndarray, b_ends: np.ndarray) -> np.ndarray:
    """Terminal token of every token, first side before second. Ends rise strictly and the last ones
    are equal; a terminal is always a token of the first side."""
    own = np.arange(len(a_ends))
    over_a, over_b = np.searchsorted(b_ends, a_ends), np.searchsorted(a_ends, b_ends)
    points = np.concatenate([np.where(b_ends[over_a] > a_ends, len(a_ends) + over_a, own), over_b])
    while True:
        farther = points[points]
        if np.array_equal(farther, points):
            return points
        points = farther


def group_numbers(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group of every token of the first and of the second side, counted from 0 along the line."""
    ends = terminals(a_ends, b_ends)
    number = np.zeros(len(a_ends), np.int64)
    number[ends] = 1
    labels = (np.cumsum(number) - 1)[ends]
    return labels[: len(a_ends)], labels[len(a_ends) :]


def links(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All overlapping pairs: token of the first side, token of the second, and where the shared
    bytes end. Between two neighbouring ends of either side lies exactly one pair."""
    ends = np.union1d(a_ends, b_ends)
    return np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends), ends


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    many = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int64, int(many.sum())), many


class Digits:
    """Decimal digits of token ids as rows of a byte matrix, with room for one mark behind them."""

    def __init__(self, count: int) -> None:
        texts = [str(i).encode() for i in range(count)]
        self.width = np.array([len(t) for t in texts], np.int64)
        room = int(self.width.max()) + 1
        self.rows = np.frombuffer(b"".join(t.ljust(room, b"\0") for t in texts), np.uint8).reshape(count, room)

    def write(self, ids: np.ndarray, marks: np.ndarray) -> tuple[bytes, np.ndarray]:
        """All ids, each followed by its mark, and where each mark ends."""
        rows, width = self.rows[ids], self.width[ids]
        rows[np.arange(len(ids)), width] = marks
        return rows[np.arange(rows.shape[1]) <= width[:, None]].tobytes(), np.cumsum(width + 1)


class Aligner:
    """Encodes pieces on both sides, aligns them and remembers the result, `most_chars` characters
    at most."""

    def __init__(self, path_a: str, path_b: str, most_chars: int = 4_000_000) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        self.cuts = Tokenizer.from_file(path_a)
        self.plain = Tokenizer.from_file(path_a)
        self.plain.encode_special_tokens = True
        specials = self.cuts.get_added_tokens_decoder()
        self.mark_id, self.mark = next(((i, t.content) for i, t in specials.items()), (None, None))
        self.specials = [t.content for t in specials.values()]
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_a = self._bytes_a(path_a)
        self.bytes_b = [self._bytes_b(i) for i in range(self.pieces.get_piece_size())]
        self.length_a = np.array([len(t) for t in self.bytes_a], np.int64)
        self.length_b = np.array([len(t) for t in self.bytes_b], np.int64)
        self.digits = Digits(max(len(self.bytes_a), len(self.bytes_b)))
        self.most_chars = most_chars
        self._forget()

    @staticmethod
    def _bytes_a(path: str) -> list[bytes]:
        byte_of = {c: b for b, c in byte_alphabet().items()}
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        out = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            out[i] = bytes(byte_of[c] for c in token)
        return out

    def _bytes_b(self, i: int) -> bytes:
        piece = self.pieces.id_to_piece(i)
        if self.pieces.is_byte(i):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("▁", " ").encode()

    def _forget(self) -> None:
        self.slot: dict[str, int] = {}
        self.chars = 0
        self.texts: list[bytes] = []
        self.counts = np.zeros((1 << 12, 5), np.int64)  # tokens a, tokens b, groups, links, joins wrongly
        self.codes = np.empty(1 << 14, np.int64)
        self.first = np.zeros(1 << 12, np.int64)
        self.used = 0

    def _encode_a(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many short texts and how many each has. Texts joined by a special token are encoded
        apart in one call, unless a text holds the string of one."""
        joined = "\n".join(texts)
        if self.mark is None or any(s in joined for s in self.specials):
            encoded = [e.ids for e in self.plain.encode_batch_fast(texts, add_special_tokens=False)]
            return _flat(encoded)
        runs = [self.mark.join(texts[k : k + 256]) + self.mark for k in range(0, len(texts), 256)]
        ids = np.concatenate([np.array(e.ids, np.int64) for e in self.cuts.encode_batch_fast(runs, add_special_tokens=False)])
        marks = np.flatnonzero(ids == self.mark_id)
        return np.delete(ids, marks), np.diff(marks, prepend=-1) - 1

    def _right(self, wholes: list[str], flat_a: np.ndarray, many_a: np.ndarray, flat_b: np.ndarray, many_b: np.ndarray) -> np.ndarray:
        """Which pieces the tokens of both sides join to."""
        want = [w.encode() for w in wholes]
        length = np.fromiter(map(len, want), np.int64, len(want))
        right = np.ones(len(want), bool)
        for flat, many, tokens, lengths in ((flat_a, many_a, self.bytes_a, self.length_a), (flat_b, many_b, self.bytes_b, self.length_b)):
            got = b"".join(map(tokens.__getitem__, flat.tolist()))
            ends = np.append(0, np.cumsum(lengths[flat]))[np.cumsum(many)]
            if np.array_equal(ends, np.cumsum(length)) and got == b"".join(want):
                continue
            bounds = [0, *ends.tolist()]
            right &= np.array([got[a:z] == w for a, z, w in zip(bounds, bounds[1:], want)], bool)
        return right

    def _learn(self, new: list[str]) -> None:
        wholes = [" " + p for p in new]
        flat_a, many_a = self._encode_a(wholes)
        # the second side puts a space in front by itself
        flat_b, many_b = _flat(self.pieces.encode(new, num_threads=1))
        right = self._right(wholes, flat_a, many_a, flat_b, many_b)
        first, n = len(self.slot), len(new)
        while first + n > len(self.first):
            self.counts = np.concatenate([self.counts, np.zeros_like(self.counts)])
            self.first = np.concatenate([self.first, np.zeros_like(self.first)])
        self.counts[first : first + n, :4] = 0
        self.counts[first : first + n, 4] = ~right
        texts = [b""] * n
        kept = np.flatnonzero(right)
        if len(kept):
            codes, found, counts = self._align(
                flat_a[np.repeat(right, many_a)], many_a[kept], flat_b[np.repeat(right, many_b)], many_b[kept]
            )
            while self.used + len(codes) > len(self.codes):
                self.codes = np.concatenate([self.codes, np.empty_like(self.codes)])
            self.codes[self.used : self.used + len(codes)] = codes
            self.counts[first + kept, :4] = counts
            self.first[first + kept] = self.used + np.cumsum(counts[:, 3]) - counts[:, 3]
            self.used += len(codes)
            for k, text in zip(kept.tolist(), found):
                texts[k] = text
        self.texts += texts
        self.slot.update(zip(new, range(first, first + n)))
        self.chars += sum(map(len, new))

    def _align(
        self, flat_a: np.ndarray, many_a: np.ndarray, flat_b: np.ndarray, many_b: np.ndarray
    ) -> tuple[np.ndarray, list[bytes], np.ndarray]:
        """Links as codes, group texts and counts of pieces laid end to end."""
        ends_a, ends_b = np.cumsum(self.length_a[flat_a]), np.cumsum(self.length_b[flat_b])
        last_a, last_b = np.cumsum(many_a) - 1, np.cumsum(many_b) - 1
        piece_ends = ends_a[last_a]

        group_a, group_b = group_numbers(ends_a, ends_b)
        in_group_a, in_group_b = np.bincount(group_a), np.bincount(group_b)
        place_a = np.arange(len(flat_a)) + (np.cumsum(in_group_b) - in_group_b)[group_a]
        place_b = np.arange(len(flat_b)) + np.cumsum(in_group_a)[group_b]
        ids, marks = np.empty(len(flat_a) + len(flat_b), np.int64), np.full(len(flat_a) + len(flat_b), ord(","), np.uint8)
        ids[place_a], ids[place_b] = flat_a, flat_b
        marks[place_a[np.cumsum(in_group_a) - 1]] = ord("|")
        marks[place_b[np.cumsum(in_group_b) - 1]] = ord(";")
        text, stops = self.digits.write(ids, marks)
        bounds = np.concatenate([[0], stops[place_b[last_b]]]).tolist()
        texts = [text[a : z - 1] for a, z in zip(bounds, bounds[1:])]

        link_a, link_b, where = links(ends_a, ends_b)
        codes = flat_a[link_a] * len(self.bytes_b) + flat_b[link_b]
        many_links = np.diff(np.searchsorted(where, piece_ends, "right"), prepend=0)
        groups = np.diff(group_a[last_a], prepend=-1)
        return codes, texts, np.stack([many_a, many_b, groups, many_links], axis=1)

    def _slots(self, pieces: list[str]) -> np.ndarray:
        slots = np.fromiter(map(self.slot.get, pieces, repeat(-1)), np.int64, len(pieces))
        unknown = np.flatnonzero(slots < 0)
        if len(unknown):
            missing = [pieces[k] for k in unknown.tolist()]
            self._learn(list(dict.fromkeys(missing)))
            slots[unknown] = list(map(self.slot.__getitem__, missing))
        return slots

    @staticmethod
    def _split(text: str) -> list[str]:
        """Pieces, each of which a space precedes. Cut at every space where no piece begins or ends
        in white space, else at the safe spaces only."""
        return _SAFE_SPACE.split(text) if _SPACE_BESIDE.search(text) else text.split(" ")

    def align(self, texts: list[str]) -> Iterator[tuple[int, int, int, int, str, np.ndarray]]:
        """n_a, n_b, n_groups, n_links, digest of the groups, and the codes of all links of each text."""
        if self.chars > self.most_chars:
            self._forget()
        split = [self._split(t) if t else [] for t in texts]
        slots = self._slots([p for parts in split for p in parts])
        at = 0
        for parts in split:
            own = slots[at : at + len(parts)]
            at += len(parts)
            counts = self.counts[own]
            if not len(own) or counts[:, 4].any():
                yield 0, 0, 0, 0, "", np.empty(0, np.int64)
                continue
            n_a, n_b, n_groups, n_links, _ = counts.sum(axis=0).tolist()
            many = counts[:, 3]
            ends = np.cumsum(many)
            codes = self.codes[np.repeat(self.first[own] - (ends - many), many) + np.arange(n_links)]
            groups = b";".join(map(self.texts.__getitem__, own.tolist()))
            yield n_a, n_b, n_groups, n_links, hashlib.sha256(groups).hexdigest(), codes


_ALIGNERS: dict[tuple, Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """One aligner per pair of files and Python worker."""
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes binary, times binary"


def align_documents(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """docs (doc_id, text) to one row per document: counts, digest of its groups, and its distinct
    linked id pairs (`codes`, first id times the second vocabulary plus second id) with how often
    each is linked (`times`), as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both = aligner(path_a, path_b)
        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            for a, z in in_slices(texts):
                rows = []
                for n_a, n_b, n_groups, n_links, digest, codes in both.align(texts[a:z]):
                    distinct, times = np.unique(codes, return_counts=True)
                    rows.append((n_a, n_b, n_groups, n_links, digest, distinct.astype("<u4").tobytes(), times.astype("<u4").tobytes()))
                out = pd.DataFrame(rows, columns=["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "codes", "times"])
                out.insert(0, "doc_id", pd.array([None if i is None else int(i) for i in batch["doc_id"][a:z]], dtype="Int64"))
                yield out

    plain = text_batches(docs).select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.col("text"))
    return plain.mapInPandas(run, ALIGNED)


def count_pairs(aligned: DataFrame, held: int = 2_000_000) -> DataFrame:
    """code, n: how many documents hold a pair linked. A task merges what it has seen whenever it
    holds `held` codes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts: list[np.ndarray] = []
        size = 0

        def merged() -> pd.DataFrame:
            codes, n = np.unique(np.concatenate(parts), return_counts=True)
            return pd.DataFrame({"code": codes.astype(np.int64), "n": n.astype(np.int64)})

        for batch in batches:
            for data in batch["codes"]:
                parts.append(np.frombuffer(data, "<u4"))
                size += len(parts[-1])
                if size >= held:
                    yield merged()
                    parts, size = [], 0
        if size:
            yield merged()

    return aligned.select("codes").mapInPandas(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def _ranges(sizes: list[tuple[int, int]], most_pairs: int) -> list[tuple[int, int]]:
    """Ranges (first id, id behind the last) of first-side ids with at most `most_pairs` pairs, or a
    single id."""
    out: list[tuple[int, int]] = []
    held = most_pairs
    for i, n in sizes:
        if held + n > most_pairs:
            out.append((i, i + 1))
            held = 0
        out[-1] = (out[-1][0], i + 1)
        held += n
    return out


def score_links(aligned: DataFrame, pairs: DataFrame, second: int, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """aligned (staged, with a unique `row`) and pair counts (staged) to row, n_best, count_sum."""
    spark = aligned.sparkSession
    # one row per id of the first side: bounded by its vocabulary
    sizes = [(r.a, r.n) for r in pairs.groupBy(F.floor(F.col("code") / second).alias("a")).agg(F.count("*").alias("n")).collect()]

    def looked_up(first: int, behind: int):
        part = pairs.where((F.col("code") >= first * second) & (F.col("code") < behind * second)).toPandas().sort_values("code")
        codes, n = part["code"].to_numpy(np.uint32), part["n"].to_numpy(np.int64)
        ids = codes // second
        starts = np.flatnonzero(np.diff(ids, prepend=-1))
        best = n == np.repeat(np.maximum.reduceat(n, starts), np.diff(starts, append=len(n)))
        return spark.sparkContext.broadcast((codes, n, best))

    def lookup(table):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            codes, n, best = table.value
            for batch in batches:
                got = []
                for data, often in zip(batch["codes"], batch["times"]):
                    mine, times = np.frombuffer(data, "<u4"), np.frombuffer(often, "<u4").astype(np.int64)
                    a, z = np.searchsorted(mine, codes[0]), np.searchsorted(mine, codes[-1], "right")
                    mine, times = mine[a:z], times[a:z]
                    at = np.searchsorted(codes, mine)
                    got.append((int(times[best[at]].sum()), int((times * n[at]).sum())))
                out = pd.DataFrame(got, columns=["n_best", "count_sum"], dtype="int64")
                out.insert(0, "row", batch["row"].to_numpy())
                yield out

        return run

    ranges = _ranges(sorted(sizes), most_pairs)
    held = aligned.where(F.col("n_links") > 0).select("row", "codes", "times")
    parts = [held.mapInPandas(lookup(looked_up(a, z)), "row long, n_best long, count_sum long") for a, z in ranges]
    if not parts:
        return aligned.select("row", F.lit(0).cast("long").alias("n_best"), F.lit(0).cast("long").alias("count_sum")).limit(0)
    if len(parts) == 1:
        return parts[0]
    return reduce(DataFrame.union, parts).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def align_tokenizers(docs: DataFrame, path_a: str, path_b: str, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    import sentencepiece

    second = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    aligned = stage_table(align_documents(docs, path_a, path_b).withColumn("row", F.monotonically_increasing_id()), "aligned")
    pairs = stage_table(count_pairs(aligned), "pair_counts")
    scored = score_links(aligned, pairs, second, most_pairs)
    zero = F.lit(0).cast("long")
    return aligned.join(scored, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"),
        F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256",
    )
