"""Best-fit-decreasing packing of documents into training sequences.

Each task encodes its documents, cuts overlong ones into full windows, and packs the pieces that
remain by decreasing length: a segment tree over remaining capacities finds the open window with
the least room that still holds the piece. The text is never shuffled and a task holds at most
`buffer_ids` ids at a time, so the memory does not grow with the input; more buffers only mean a
few more windows that are not full.

Sequence ids are unique: partition number times 2^40 plus a counter in the task. Pieces of equal
length are packed in the order of (document id, position in the task's input, start).

Edge cases. Null or empty text: the end id alone. Null ids, repeated rows: each row is a document
of its own. Empty table: empty result. A document longer than the buffer is packed when it comes.
Other columns are ignored."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import text_batches
from cuelake.llm.encoder import encoder, in_slices

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
)


class RoomTree:
    """Open windows by remaining capacity. Leaf c counts the open windows with c ids of room; an
    inner node counts those below it. `tightest(n)` is the least capacity >= n that has a window."""

    def __init__(self, size: int) -> None:
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, room: int, window: int) -> None:
        self.windows[room].append(window)
        self._change(room, 1)

    def take(self, room: int) -> int:
        self._change(room, -1)
        return self.windows[room].pop()

    def _change(self, room: int, by: int) -> None:
        node = room + self.leaves
        while node:
            self.count[node] += by
            node >>= 1

    def tightest(self, need: int) -> int | None:
        node = need + self.leaves
        if self.count[node]:
            return need
        while node > 1:
            if not node & 1 and self.count[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.count[2 * node] else 2 * node + 1
                return node - self.leaves
            node >>= 1
        return None


def best_fit_decreasing(lengths: list[int], size: int) -> list[tuple[int, int]]:
    """(window, offset) for each length, given in decreasing order."""
    tree, windows, out = RoomTree(size), 0, []
    for n in lengths:
        room = tree.tightest(n)
        if room is None:
            window, room = windows, size
            windows += 1
        else:
            window = tree.take(room)
        out.append((window, size - room))
        if room > n:
            tree.add(room - n, window)
    return out


def pack_documents(
    docs: DataFrame, tokenizer: str, keeps_spaces: bool, end_id: int, size: int = 2048, buffer_ids: int = 8_000_000, with_ids: bool = True
) -> DataFrame:
    """docs (doc_id, text) to one row per piece: its document, place in it, sequence and offset,
    and its ids as little-endian unsigned 32-bit integers (null unless `with_ids`)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer, keeps_spaces)
        base = TaskContext.get().partitionId() << 40
        used = held = 0
        waiting: list[tuple[list, np.ndarray, np.ndarray]] = []  # document ids, ids with end ids, counts

        def packed() -> Iterator[pd.DataFrame]:
            nonlocal used
            names = [d for docs_of, _, _ in waiting for d in docs_of]
            none = np.array([d is None for d in names], bool)
            doc = np.array([0 if d is None else int(d) for d in names], np.int64)
            ids = np.concatenate([i for _, i, _ in waiting]).astype("<u4", copy=False)
            counts = np.concatenate([c for _, _, c in waiting])
            many = -(-counts // size)
            of = np.repeat(np.arange(len(counts)), many)
            start = (np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)) * size
            length = np.minimum(size, counts[of] - start)
            order = np.lexsort((doc[of], none[of], -length))
            of, start, length = of[order], start[order], length[order]
            places = np.array(best_fit_decreasing(length.tolist(), size), np.int64).reshape(-1, 2)
            at = (np.cumsum(counts) - counts)[of] + start
            bounds = list(zip(at.tolist(), (at + length).tolist()))
            window = base + used + places[:, 0]
            used += 1 + int(places[:, 0].max(initial=-1))
            for k in range(0, len(of), 4096):
                here = slice(k, k + 4096)
                yield pd.DataFrame({
                    "doc_id": pd.arrays.IntegerArray(doc[of[here]], none[of[here]]),
                    "start": start[here],
                    "length": length[here],
                    "ids_crc32": np.array([zlib.crc32(ids[a:z]) for a, z in bounds[here]], np.int64),
                    "doc_tokens": counts[of[here]],
                    "sequence_id": window[here],
                    "offset": places[here, 1],
                    "ids": [ids[a:z].tobytes() for a, z in bounds[here]] if with_ids else None,
                })

        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            doc_ids = batch["doc_id"].tolist()
            for a, b in in_slices(texts):
                ids, counts = enc.encode(texts[a:b])
                counts = counts + 1
                closed = np.empty(len(ids) + len(counts), np.uint32)
                ends = np.cumsum(counts) - 1
                inside = np.ones(len(closed), bool)
                inside[ends] = False
                closed[inside], closed[ends] = ids, end_id
                waiting.append((doc_ids[a:b], closed, counts))
                held += len(closed)
                if held >= buffer_ids:
                    yield from packed()
                    waiting, held = [], 0
        if waiting:
            yield from packed()

    # ids travel as text: pandas has no plain integer column with nulls
    plain = text_batches(docs).select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.col("text"))
    return plain.mapInPandas(run, PIECES)
