"""Token ids of a corpus as fixed-width bit-packed files.

Every id takes the fewest bits that hold the vocabulary. A file holds the documents of one range of
ids in ascending order:

    magic "CLBP" | bits u32 | ids per block u32 | documents u64 | ids u64
    blocks: ids packed most significant bit first, each block padded to a whole byte
    document table: ids i64, presence u8, first id of each document u64
    block table: position of each block in the file u64, and where the last ends
    footer: position of the document table u64, position of the block table u64

All numbers are little-endian. The block table gives random access: `read_ids` touches the blocks
of the asked range only, and unpacks a block with two numpy calls.

Jobs. `write_corpus` deals the documents out by ranges of (doc_id, text hash), encodes and writes a
file per task under a name of its own attempt, and stages a manifest of the files that successful
tasks wrote. Only files of the manifest count, so a task that is run again leaves nothing wrong
behind. Files are written with pyarrow's file systems, so the folder may be any that it knows.

Edge cases. Null or empty text: the end id alone. Null id: before all others. Repeated rows: each
row is a document; rows with equal ids are ordered by the hash of their text. Empty table: no files
and an empty result. Other columns are ignored."""

from __future__ import annotations

import io
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuelake.llm.common import row_hash, stage_table, text_batches
from cuelake.llm.encoder import encoder, in_slices, with_ends
from cuelake.session import ensure_checkpoint_dir

MAGIC = b"CLBP"
HEADER = np.dtype([("magic", "S4"), ("bits", "<u4"), ("block", "<u4"), ("docs", "<u8"), ("ids", "<u8")])
BLOCK = 1 << 16


def bits_for(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    octets = ids.astype(">u4").view(np.uint8).reshape(-1, 4)
    if bits % 8 == 0:  # whole bytes need no single bits
        return octets[:, 4 - bits // 8 :].tobytes()
    return np.packbits(np.unpackbits(octets, axis=1)[:, 32 - bits :]).tobytes()


def unpack(data: bytes, bits: int, count: int) -> np.ndarray:
    if bits % 8 == 0:
        octets = np.zeros((count, 4), np.uint8)
        octets[:, 4 - bits // 8 :] = np.frombuffer(data, np.uint8, count * bits // 8).reshape(count, bits // 8)
        return octets.view(">u4").ravel().astype(np.uint32)
    planes = np.zeros((count, 32), np.uint8)
    planes[:, 32 - bits :] = np.unpackbits(np.frombuffer(data, np.uint8), count=count * bits).reshape(count, bits)
    return np.packbits(planes, axis=1).view(">u4").ravel().astype(np.uint32)


class PackedWriter:
    """Appends documents to an open binary stream; `close` writes the tables."""

    def __init__(self, stream, bits: int, block: int = BLOCK) -> None:
        self.stream, self.bits, self.block = stream, bits, block
        self.waiting: list[np.ndarray] = []
        self.held = self.ids = self.at = 0
        self.doc_ids: list[int | None] = []
        self.firsts: list[int] = []
        self.places: list[int] = []
        self._put(bytes(HEADER.itemsize))  # the true header follows in the footer

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.add_all([doc_id], ids, np.array([len(ids)]))

    def add_all(self, doc_ids: list[int | None], ids: np.ndarray, counts: np.ndarray) -> None:
        """Documents whose ids follow one another in `ids`."""
        self.doc_ids += doc_ids
        self.firsts += (self.ids + np.cumsum(counts) - counts).tolist()
        self.ids += len(ids)
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= self.block:
            self._flush(whole_blocks=True)

    def _flush(self, whole_blocks: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.empty(0, np.uint32)
        end = len(ids) // self.block * self.block if whole_blocks else len(ids)
        for k in range(0, end, self.block):
            self.places.append(self.at)
            self._put(pack(ids[k : min(k + self.block, end)], self.bits))
        self.waiting = [ids[end:]]
        self.held = len(ids) - end

    def close(self) -> None:
        self._flush(whole_blocks=False)
        self.places.append(self.at)
        table = self.at
        self._put(np.array([d or 0 for d in self.doc_ids], "<i8").tobytes())
        self._put(np.array([d is not None for d in self.doc_ids], np.uint8).tobytes())
        self._put(np.array(self.firsts, "<u8").tobytes())
        blocks = self.at
        self._put(np.array(self.places, "<u8").tobytes())
        head = np.array([(MAGIC, self.bits, self.block, len(self.doc_ids), self.ids)], HEADER)
        self._put(np.array([table, blocks], "<u8").tobytes() + head.tobytes())


class PackedFile:
    """Random access to a packed file through any object with seek and read."""

    def __init__(self, stream) -> None:
        self.stream = stream
        tail = 16 + HEADER.itemsize
        stream.seek(0, 2)
        size = stream.tell()
        data = self._read(size - tail, tail)
        table, blocks = np.frombuffer(data[:16], "<u8").astype(int)
        head = np.frombuffer(data[16:], HEADER)[0]
        if head["magic"] != MAGIC:
            raise ValueError("not a packed token file")
        self.bits, self.block = int(head["bits"]), int(head["block"])
        self.docs, self.ids = int(head["docs"]), int(head["ids"])
        n = self.docs
        data = self._read(table, 17 * n)
        present = np.frombuffer(data[8 * n : 9 * n], np.uint8).astype(bool)
        self.doc_ids = [int(d) if p else None for d, p in zip(np.frombuffer(data[: 8 * n], "<i8"), present)]
        self.firsts = np.append(np.frombuffer(data[9 * n :], "<u8").astype(np.int64), self.ids)
        self.places = np.frombuffer(self._read(blocks, size - tail - blocks), "<u8").astype(np.int64)

    def _read(self, at: int, count: int) -> bytes:
        self.stream.seek(int(at))
        return self.stream.read(int(count))

    def read_ids(self, start: int, end: int) -> np.ndarray:
        """Ids start to end of the file; reads and unpacks the blocks that hold them."""
        if end <= start:
            return np.empty(0, np.uint32)
        first, last = start // self.block, (end - 1) // self.block
        data = self._read(self.places[first], self.places[last + 1] - self.places[first])
        parts = []
        for k in range(first, last + 1):
            count = min(self.block, self.ids - k * self.block)
            at = self.places[k] - self.places[first]
            parts.append(unpack(data[at : self.places[k + 1] - self.places[first]], self.bits, count))
        return np.concatenate(parts)[start - first * self.block : end - first * self.block]

    def documents(self, ids_at_once: int = 16 * BLOCK) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, first id, ids) of each document, read a bounded run of documents at a time."""
        k = 0
        while k < self.docs:
            end = max(k + 1, int(np.searchsorted(self.firsts, self.firsts[k] + ids_at_once, "right")) - 1)
            end = min(end, self.docs)
            ids = self.read_ids(int(self.firsts[k]), int(self.firsts[end]))
            for d in range(k, end):
                a = int(self.firsts[d] - self.firsts[k])
                yield self.doc_ids[d], int(self.firsts[d]), ids[a : int(self.firsts[d + 1] - self.firsts[k])]
            k = end


def _open(path: str, mode: str):
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    if mode == "w":
        system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
        return system.open_output_stream(inner)
    return system.open_input_file(inner)


def write_corpus(
    docs: DataFrame, tokenizer: str, keeps_spaces: bool, end_id: int, folder: str | None = None, block: int = BLOCK
) -> DataFrame:
    """Encode docs (doc_id, text) into packed files under `folder`; the manifest, one row per file:
    part (order of the file), path, n_docs, n_ids, start (ids in all files before it)."""
    spark = docs.sparkSession
    root = folder or f"{ensure_checkpoint_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    root = root if "://" in root or root.startswith("/") else root.replace("file:", "", 1)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer, keeps_spaces)
        bits = bits_for(max(enc.tokenizer.get_vocab_size(), end_id + 1))
        context = TaskContext.get()
        path = f"{root}/part-{context.partitionId():06d}-{context.taskAttemptId()}.bin"
        writer = None
        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            doc_ids = batch["doc_id"].tolist()
            for a, b in in_slices(texts):
                if writer is None:
                    writer = PackedWriter(io.BufferedWriter(_open(path, "w"), 1 << 20), bits, block)
                own = [None if d is None or pd.isna(d) else int(d) for d in doc_ids[a:b]]
                writer.add_all(own, *with_ends(*enc.encode(texts[a:b]), end_id))
        if writer is not None:
            writer.close()
            writer.stream.close()
            yield pd.DataFrame(
                [(context.partitionId(), path, len(writer.doc_ids), writer.ids)], columns=["part", "path", "n_docs", "n_ids"]
            )

    text = F.col("text")
    ordered = (
        text_batches(docs).select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.col("doc_id").cast("long").alias("_by"), row_hash(text).alias("_tie"), text)
        .repartitionByRange("_by", "_tie")
        .sortWithinPartitions("_by", "_tie")
        .select("doc_id", "text")
    )
    files = stage_table(ordered.mapInPandas(write, "part int, path string, n_docs long, n_ids long"), "token_files")
    # one row per file: a running sum over a table that is smaller than the corpus by the file size
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long"))


def read_documents(manifest: DataFrame) -> DataFrame:
    """One row per document read back from the files: doc_id, start, n_tokens, ids_crc32."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                with _open(row.path, "r") as stream:
                    rows = [
                        (doc, row.start + first, len(ids), zlib.crc32(ids.astype("<u4", copy=False)))
                        for doc, first, ids in PackedFile(stream).documents()
                    ]
                out = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"])
                out["doc_id"] = pd.array([r[0] for r in rows], dtype="Int64")
                yield out

    files = stage_table(manifest, "token_manifest")
    spread = files.repartition(max(1, files.count()), "part")
    return spread.mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
