"""SimHash fingerprints and near-duplicate groups by vantage-point trees.

Fingerprints. A bit is set if it is set in over half of the XXH64 hashes of a text's word shingles.

Links. Fingerprints link at `radius` or fewer differing bits; the search is exact. Equal fingerprints
are one. The tree's first branch names a band of bits, and below it every level measures the Hamming
distance to a vantage point inside the band; a leaf is a cell of equal distances. Two fingerprints
that differ in `radius` bits differ in at most radius // bands bits of some band, so by the triangle
inequality their distances there differ by no more, and it is enough to visit the cells whose
distances lie within that bound. With `bands` = radius + 1, the default, the bound is zero and each
row goes to one cell of each band. With fewer bands the bound is positive, distances are grouped
into shells, and a row near the boundary of a shell is also sent to the shell beyond it.

Hot cells. A cell above `most` rows is branched again on bands of the bits not used so far, which
keeps the search exact, down to `depth`; a cell that is still larger is cut into tiles, and pairs of
tiles are compared. Inside a cell the rows are ordered by their distance to one more vantage point,
and a row is compared only with the following ones up to `radius` farther out.

A cell gives a spanning forest of its links instead of all pairs, so a group of k near copies costs
about k edges. Groups are connected components (see `components`).

Edge cases. Null, empty or wordless text: fingerprint zero, linked like any other. Fewer than three
words: one shingle of all. Repeated rows and ids: each row is fingerprinted; equal ones fall in one
group. Null ids: ignored as smallest id unless the whole group has none (component_id null). Empty
table: empty result. Other columns are ignored by `group_documents` and kept by `keep_first`, which
tells rows apart by id and text."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import first_order, one_row_each, row_hash, stage_table, text_batches
from cuelake.llm.components import components

SEED = 42
FULL = (1 << 64) - 1


def fingerprint(text: str | None, width: int = 3) -> int:
    """64-bit SimHash; only A-Z are lower-cased, words are split at ASCII white space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < width:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths)[: len(words) - width + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist())], np.uint64)
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = hashes[k : k + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) to doc_id, key (digest of the text) and fp (signed 64-bit)."""
    made = F.pandas_udf(
        lambda texts: pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)), "long"
    )
    return text_batches(docs).select(F.col("doc_id").cast("long"), row_hash(F.col("text")).alias("key"), made("text").alias("fp"))


def _signed(v: int) -> int:
    return v - (1 << 64) if v >> 63 else v


def vantage(k: int) -> int:
    """A pseudo-random vantage point."""
    return xxhash.xxh64_intdigest(f"vantage {k}".encode(), SEED)


def band_masks(mask: int, bands: int) -> list[int]:
    """The bits of `mask` in `bands` runs of nearly equal length."""
    bits = [b for b in range(64) if mask >> b & 1]
    return [sum(1 << b for b in part.tolist()) for part in np.array_split(np.array(bits, dtype=int), bands)]


def _placed(rows: DataFrame, masks: list[int], bands: int, bound: int, points: int) -> DataFrame:
    """rows (fp, cell, path) to their cells one branch deeper; masks by path."""
    path = F.explode(F.sequence(F.col("path") * bands, F.col("path") * bands + bands - 1)).alias("path")
    deeper = rows.select("fp", "cell", path)
    mask = F.element_at(F.array(*[F.lit(_signed(m)) for m in masks]), F.col("path") + 1)
    deeper = deeper.withColumn("mask", mask)
    distances = [F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(vantage(k)))).bitwiseAND(F.col("mask"))) for k in range(points)]
    if bound == 0:
        return deeper.select("fp", F.xxhash64("cell", "path", *distances).alias("cell"), "path")
    shell = bound + 2
    cells = F.array(F.xxhash64("cell", "path"))
    for d in distances:
        near = F.sequence(F.floor(F.greatest(d - bound, F.lit(0)) / shell), F.floor((d + bound) / shell))
        cells = _spread(cells, near)
    return deeper.select("fp", F.explode(cells).alias("cell"), "path")


def _spread(cells: Column, near: Column) -> Column:
    """Every cell with every shell."""
    return F.flatten(F.transform(cells, lambda c: F.transform(near, lambda s: F.xxhash64(c, s))))


def links_of_cells(cell: np.ndarray, far: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows ordered by (cell, far), far being a distance to one vantage point, as a star
    per connected group: each row's fingerprint and that of the first row of its group."""
    n = len(fp)
    group = np.arange(n)
    left, right = [], []
    at = np.arange(n)
    for step in range(1, n):
        at = at[at < n - step]
        at = at[(cell[at + step] == cell[at]) & (far[at + step] - far[at] <= radius)]
        if not len(at):
            break
        close = at[np.bitwise_count(fp[at] ^ fp[at + step]) <= radius]
        if len(close):
            left.append(close)
            right.append(close + step)
    if not left:
        return fp[:0], fp[:0]
    a, b = np.concatenate(left), np.concatenate(right)
    while True:
        low = np.minimum(group[a], group[b])
        before = group.copy()
        np.minimum.at(group, a, low)
        np.minimum.at(group, b, low)
        group = group[group]
        if (group == before).all():
            break
    moved = np.flatnonzero(group != np.arange(n))
    return fp[moved], fp[group[moved]]


def _compare(rows: DataFrame, radius: int) -> DataFrame:
    """rows (fp, cell) to edges (a, b). The rows of a cell meet in one task and stream through it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)]
        for batch in batches:
            new = [batch["cell"].to_numpy(), batch["far"].to_numpy().astype(np.int64), batch["fp"].to_numpy().view(np.uint64)]
            cell, far, fp = (np.concatenate([h, x]) for h, x in zip(held, new))
            if not len(cell):
                continue
            whole = int(np.searchsorted(cell, cell[-1]))  # the last cell may go on in the next batch
            a, b = links_of_cells(cell[:whole], far[:whole], fp[:whole], radius)
            yield pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})
            held = [cell[whole:], far[whole:], fp[whole:]]
        a, b = links_of_cells(*held, radius)
        yield pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    far = F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(vantage(-1)))))
    ordered = rows.select("cell", far.alias("far"), "fp").repartition("cell").sortWithinPartitions("cell", "far", "fp")
    return ordered.mapInPandas(run, "a long, b long")


def link_fingerprints(
    fps: DataFrame, radius: int = 3, bands: int | None = None, points: int = 12, most: int = 1024, depth: int = 3
) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints of `fps` (fp) exactly as links do."""
    bands = bands or radius + 1
    bound = radius // bands
    rows = fps.select("fp", F.lit(0).cast("long").alias("cell"), F.lit(0).alias("path"))
    free, edges = [FULL], []
    for level in range(depth):
        masks = [m for f in free for m in band_masks(f, bands)]
        placed = stage_table(_placed(rows, masks, bands, bound, points), f"simhash_cells{level}")
        sizes = placed.groupBy("cell").agg(F.count("*").alias("n"))
        hot = stage_table(sizes.where(F.col("n") > most), f"simhash_hot{level}")
        edges.append(_compare(placed.join(hot, "cell", "left_anti"), radius))
        rows = placed.join(hot, "cell")
        if hot.isEmpty():
            break
        free = [f & ~m for f in free for m in band_masks(f, bands)]
        # a branch needs bits for each of its bands
        if bin(free[0]).count("1") < bands or level == depth - 1:
            tiles = F.ceil(F.col("n") / most).cast("int")
            own = F.pmod(F.xxhash64("fp", F.lit(5)), tiles).cast("int")
            other = F.explode(F.sequence(F.lit(0), tiles - 1)).alias("other")
            tiled = rows.select("fp", "cell", own.alias("own"), other)
            pair = F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other"))
            edges.append(_compare(tiled.select("fp", pair.alias("cell")), radius))
            break
        rows = rows.drop("n")
    return reduce(DataFrame.unionByName, edges)


def groups(docs: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """Every row's doc_id, key and fp, and of each fp the group (root) and its first row."""
    rows = stage_table(fingerprints(docs), "simhash_rows")
    firsts = stage_table(rows.groupBy("fp").agg(F.min(first_order()).alias("first")), "simhash_firsts")
    linked = components(link_fingerprints(firsts, **options))
    rooted = stage_table(
        firsts.join(linked, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "simhash_roots"
    )
    least = rooted.groupBy("root").agg(F.min("first").alias("first"))
    return rows, stage_table(rooted.drop("first").join(least, "root").select("fp", "root", "first"), "simhash_named")


def group_documents(docs: DataFrame, **options) -> DataFrame:
    """docs (doc_id, text) to doc_id, fp and component_id, the smallest id of the row's group."""
    rows, named = groups(docs, **options)
    return rows.join(named, "fp").select("doc_id", "fp", F.col("first.doc_id").alias("component_id"))


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """One row of `docs` per group: that with the smallest id (null last) and, among rows of that id,
    the least digest of the text; of rows equal in both, one."""
    rows, named = groups(docs, **options)
    chosen = stage_table(named.select("root", "first").distinct(), "simhash_kept")
    return one_row_each(docs, rows, chosen)
