"""Near-duplicate texts: Jaccard similarity of word shingles, candidates by MinHash bands.

A text is the set of its `WIDTH`-word shingles as 64-bit digests; texts link at `similarity` or more of
shared to all shingles. Texts of one set are one node. A node goes to one cell per band of MinHash
values; two nodes of similarity s share a cell with probability 1 - (1 - s^ROWS)^BANDS, 0.9996 at 0.8.
Nodes that share a cell are compared by their sets, so no link is below `similarity`. Cells of one
node are dropped, and of cells with the same members one is compared.

Hot cells. A cell above `most` nodes is cut into tiles and every pair of tiles is compared. A cell
gives a spanning forest of its links, so a group of k near copies costs about k edges. Groups are
connected components (see `components`).

Edge cases. Null, empty or wordless text: one group. Fewer than WIDTH words: one shingle of all. Only
A-Z are lower-cased, words are split at ASCII white space. Rows are told apart by id and text, so
null and repeated ids with different texts are kept apart. Empty table: empty result."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.llm import simhash
from cuelake.llm.common import first_order, one_row_each, row_hash, stage_table, text_batches
from cuelake.llm.components import components

WIDTH = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 5
SEED = 42
KNOWN = 100_000  # digests of words that a task remembers

_RANDOM = np.random.default_rng(SEED)
_PLACE = _RANDOM.integers(0, 1 << 63, WIDTH, np.uint64) * np.uint64(2) + np.uint64(1)
_TIMES = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def shingles(text: str | None, known: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct digests of the text's shingles; `known` remembers digests of words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) < WIDTH:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], np.uint64)
    if len(known) > KNOWN:
        known.clear()
    for w in set(words).difference(known):
        known[w] = xxhash.xxh64_intdigest(w, SEED)
    digests = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = len(words) - WIDTH + 1
    mixed = sum(digests[k : k + n] * _PLACE[k] for k in range(WIDTH))
    mixed = (mixed ^ (mixed >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return np.unique(mixed ^ (mixed >> np.uint64(29)))


def cells_of(grams: np.ndarray) -> np.ndarray:
    """The cell of each band; none for an empty set."""
    if not len(grams):
        return np.empty(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(grams), 2048):
        np.minimum(least, (grams[k : k + 2048, None] * _TIMES + _PLUS).min(axis=0), out=least)
    bands = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(b.tobytes(), k) for k, b in enumerate(bands)], np.uint64).view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) to doc_id, key (digest of the text), node (digest of its set) and cells."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[bytes, int] = {}
        for batch in batches:
            sets = [shingles(t, known) for t in batch["text"]]
            out = batch[["doc_id", "key"]].copy()
            out["node"] = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            out["cells"] = [cells_of(s) for s in sets]
            yield out

    # ids travel as text: pandas has no plain integer column with nulls
    plain = text_batches(docs).select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), row_hash(F.col("text")).alias("key"), "text")
    made = plain.mapInPandas(read, "doc_id string, key long, node long, cells array<long>")
    return made.withColumn("doc_id", F.col("doc_id").cast("long"))


def links_of_cell(nodes: list[int], sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the links among the nodes of one cell."""
    sizes = np.array([len(s) for s in sets], np.int64)
    left = np.argsort(-sizes, kind="stable")
    edges: list[tuple[int, int]] = []
    while len(left) > 1:
        front, left = [int(left[0])], left[1:]
        while front and len(left):
            at = front.pop()
            # sets whose sizes alone allow the similarity
            fits = np.minimum(sizes[left], sizes[at]) >= similarity * np.maximum(sizes[left], sizes[at]) - 1e-9
            some = left[fits]
            if not len(some):
                continue
            values = np.concatenate([sets[k] for k in some])
            place = np.minimum(np.searchsorted(sets[at], values), sizes[at] - 1)
            shared = np.add.reduceat((sets[at][place] == values).astype(np.int64), np.cumsum(sizes[some]) - sizes[some])
            close = some[shared >= similarity * (sizes[some] + sizes[at] - shared) - 1e-9]
            edges += [(nodes[at], nodes[k]) for k in close.tolist()]
            front += close.tolist()
            left = left[~np.isin(left, close)]
    return edges


def _compare(rows: DataFrame, similarity: float) -> DataFrame:
    """rows (cell, node, grams) to edges (a, b). The rows of a cell meet in one task and stream through it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, nodes, sets = None, [], []
        for batch in batches:
            edges: list[tuple[int, int]] = []
            for c, node, grams in zip(batch["cell"], batch["node"], batch["grams"]):
                if c != cell:
                    edges += links_of_cell(nodes, sets, similarity)
                    cell, nodes, sets = c, [], []
                nodes.append(node)
                sets.append(np.asarray(grams, np.int64).view(np.uint64))
            yield pd.DataFrame(edges, columns=["a", "b"], dtype="int64")
        yield pd.DataFrame(links_of_cell(nodes, sets, similarity), columns=["a", "b"], dtype="int64")

    return text_batches(rows).repartition("cell").sortWithinPartitions("cell").mapInPandas(run, "a long, b long")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node and grams of the nodes of `wanted` (node, key), from one text of each."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[bytes, int] = {}
        for batch in batches:
            yield pd.DataFrame({"node": batch["node"], "grams": [shingles(t, known).view(np.int64) for t in batch["text"]]})

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), row_hash(F.col("text")).alias("key"), "text")
    same = F.col("id").eqNullSafe(F.col("w_id")) & (F.col("key") == F.col("w_key"))
    found = texts.join(wanted, same).select("node", "text")
    return text_batches(found).mapInPandas(read, "node long, grams array<long>").dropDuplicates(["node"])


def link_texts(docs: DataFrame, nodes: DataFrame, similarity: float = SIMILARITY, most: int = 1024) -> DataFrame:
    """Edges (a, b) that connect the nodes of `nodes` (node, first, cells) as links do."""
    placed = nodes.select("node", F.explode("cells").alias("cell"))
    members = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"m{k}") for k in range(2)]
    cells = placed.groupBy("cell").agg(F.count("*").alias("n"), *members).where("n > 1")
    chosen = stage_table(cells.groupBy("n", "m0", "m1").agg(F.min("cell").alias("cell")).select("cell", "n"), "near_cells")
    tiles = F.ceil(F.col("n") / most).cast("int")
    own = F.pmod(F.xxhash64("node", F.lit(5)), tiles).cast("int")
    tiled = placed.join(chosen, "cell").select(
        "node", "cell", own.alias("own"), F.explode(F.sequence(F.lit(0), tiles - 1)).alias("other")
    )
    pair = F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other"))
    asked = stage_table(tiled.select("node", pair.alias("cell")), "near_asked")
    wanted = nodes.join(asked.select("node").distinct(), "node", "left_semi").select(
        "node", F.col("first.doc_id").alias("w_id"), F.col("first.key").alias("w_key")
    )
    return _compare(asked.join(stage_table(_sets(docs, wanted), "near_sets"), "node"), similarity)


def _set_links(docs: DataFrame, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every row's doc_id, key and node; of each node its first row; and the components of linked nodes."""
    rows = stage_table(signatures(docs), "near_rows")
    nodes = stage_table(rows.groupBy("node").agg(F.min(first_order()).alias("first"), F.any_value("cells").alias("cells")), "near_nodes")
    return rows, nodes, components(link_texts(docs, nodes, **options)).withColumnRenamed("node", "l_node")


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """One row of `docs` per group of near-duplicates: that with the smallest id (null last) and, among
    rows of that id, the least digest of the text; of rows equal in both, one."""
    rows, nodes, linked = _set_links(docs, **options)
    rooted = nodes.join(linked, F.col("node") == F.col("l_node"), "left").select("first", F.coalesce("root", "node").alias("root"))
    chosen = stage_table(rooted.groupBy("root").agg(F.min("first").alias("first")).select("first"), "near_kept")
    return one_row_each(docs, rows, chosen)


def keep_first_of_both(docs: DataFrame) -> DataFrame:
    """As `keep_first`, over the links of SimHash fingerprints (see `simhash`) and of shingle sets together:
    groups are components of both, so a text linked by one and a text linked by the other are one group."""
    prints, named = simhash.groups(docs)
    rows, nodes, linked = _set_links(docs)
    rooted = nodes.join(linked, F.col("node") == F.col("l_node"), "left").select("node", F.coalesce("root", "node").alias("set_root"))
    # one row per text: its group by fingerprints and its group by sets
    by_print = prints.dropDuplicates(["doc_id", "key"]).join(named.select("fp", F.col("root").alias("fp_root")), "fp").select(
        F.col("doc_id").alias("p_id"), F.col("key").alias("p_key"), "fp_root"
    )
    by_set = rows.dropDuplicates(["doc_id", "key"]).join(rooted, "node").select("doc_id", "key", "set_root")
    same = F.col("doc_id").eqNullSafe(F.col("p_id")) & (F.col("key") == F.col("p_key"))
    member = lambda kind, root: F.struct(F.lit(kind).alias("kind"), F.col(root).alias("root"))
    texts = stage_table(
        by_set.join(by_print, same).select("doc_id", "key", member(0, "fp_root").alias("a"), member(1, "set_root").alias("b")), "near_both"
    )
    whole = components(texts.select("a", "b").distinct()).withColumnRenamed("root", "group")
    firsts = texts.groupBy("a").agg(F.min(first_order()).alias("first"))
    chosen = firsts.join(whole, F.col("a") == F.col("node")).groupBy("group").agg(F.min("first").alias("first"))
    return one_row_each(docs, rows, stage_table(chosen.select("first"), "near_both_kept"))
