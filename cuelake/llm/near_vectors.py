"""Near-duplicate vectors by tiled comparison in the order of principal components.

Vectors are compared only inside a label (and a dimension). Equal vectors are one, with a count.
Directions are rotated onto principal components fitted to all vectors, so that leading coordinates
hold most of the length. A label's vectors are cut into tiles along the first component, by the
cumulated histogram of that coordinate; tile pairs whose intervals are farther apart than linked
directions can be are never formed. A pair of tiles is compared a few coordinates at a time: the
partial dot products plus the product of the suffix norms bound the cosine (Cauchy-Schwarz), and the
comparison stops when no pair can reach the threshold, or goes on for the pairs that still can.

A tile pair returns per vector the number of its links and the first vector of its linked group, not
the pairs. Groups are connected components (see `components`). Each vector meets the tiles of its
label that its interval touches, a tile holds about `tile` vectors, and no label is gathered anywhere.

Edge cases. Null vectors, vectors of zeros, with null or non-finite components, and null labels link
with nothing. Repeated rows are vectors of their own and link with each other. Null ids are ignored
as smallest id unless the whole group has none. Empty table: empty result. Other columns are
ignored."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuelake.llm.common import stage_table
from cuelake.llm.components import components

BINS = 1024  # histogram bins of the first coordinate, which lies in [-1, 1]
STEP = 16  # coordinates accumulated between two looks at the bound


def usable(v) -> np.ndarray | None:
    if v is None:
        return None
    x = np.array(v, np.float64)
    return x + 0.0 if x.ndim == 1 and len(x) and np.isfinite(x).all() and x.any() else None


def vectors(df: DataFrame) -> DataFrame:
    """vec_id, label, dim, node (digest of label and vector; null if it links with nothing), data."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for vec_id, v, label in zip(batch["vec_id"], batch["embedding"], batch["label"]):
                x = usable(v) if label is not None else None
                if x is None:
                    rows.append((vec_id, label, None, None, None))
                else:
                    data = x.astype("<f8").tobytes()
                    rows.append((vec_id, label, len(x), hashlib.blake2b(f"{label}/".encode() + data, digest_size=16).hexdigest(), data))
            out = pd.DataFrame(rows, columns=["vec_id", "label", "dim", "node", "data"])
            out["dim"] = out["dim"].astype("Int64")
            yield out

    # ids and labels travel as text: pandas has no plain integer column with nulls
    plain = df.select(F.col("vec_id").cast("string"), F.col("embedding").cast("array<double>"), F.col("label").cast("string"))
    read_rows = plain.mapInPandas(read, "vec_id string, label string, dim long, node string, data binary")
    return read_rows.withColumn("vec_id", F.col("vec_id").cast("long"))


def unit(data: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(data), "<f8").reshape(len(data), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # keeps squares of very large or small values finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def principal_axes(reps: DataFrame) -> dict[int, np.ndarray]:
    """Per dimension, the rotation onto principal components (columns, largest first), from second
    moments that are summed by Spark; dim^2 numbers reach the driver."""

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, part in batch.groupby("dim"):
                u = unit(part["data"].tolist())
                total[dim] = total.get(dim, 0) + u.T @ u
        for dim, m in total.items():
            i, j = np.indices(m.shape)
            yield pd.DataFrame({"dim": dim, "i": i.ravel(), "j": j.ravel(), "s": m.ravel()})

    summed = reps.select("dim", "data").mapInPandas(moments, "dim long, i int, j int, s double").groupBy("dim", "i", "j").agg(F.sum("s").alias("s"))
    out = {}
    for dim, part in summed.toPandas().groupby("dim"):
        m = np.zeros((dim, dim))
        m[part["i"], part["j"]] = part["s"]
        out[int(dim)] = np.linalg.eigh((m + m.T) / 2)[1][:, ::-1]
    return out


def linked_pairs(a: np.ndarray, b: np.ndarray, least: float, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of a and b (rotated unit vectors) whose dot product reaches `least`."""
    slack = 1e-9
    dim = a.shape[1]
    partial = np.zeros((len(a), len(b)))
    left_a = np.sqrt(np.maximum(np.cumsum((a * a)[:, ::-1], axis=1)[:, ::-1], 0))
    left_b = np.sqrt(np.maximum(np.cumsum((b * b)[:, ::-1], axis=1)[:, ::-1], 0))
    for k in range(0, dim, step):
        partial += a[:, k : k + step] @ b[:, k : k + step].T
        end = k + step
        if end >= dim:
            return np.nonzero(partial >= least)
        bound = partial + np.outer(left_a[:, end], left_b[:, end])
        r, c = np.nonzero(bound >= least - slack)
        if not len(r):
            return r, c
        if len(r) * 8 <= partial.size:
            keep = []
            for s in range(0, len(r), 1 << 16):
                rr, cc = r[s : s + (1 << 16)], c[s : s + (1 << 16)]
                keep.append(partial[rr, cc] + np.einsum("ij,ij->i", a[rr, end:], b[cc, end:]) >= least)
            kept = np.concatenate(keep)
            return r[kept], c[kept]
    return np.nonzero(partial >= least)


def link_vectors(reps: DataFrame, least: float, tile: int) -> DataFrame:
    """reps (node, label, dim, copies, data) to node, links (rows of other nodes linked directly) and
    root (a node of the same group), one or more rows per linked node."""
    axes = principal_axes(reps)

    def first_coordinate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pc = np.zeros(len(batch))
            for dim in batch["dim"].unique():
                own = (batch["dim"] == dim).to_numpy()
                pc[own] = unit(batch["data"][own].tolist()) @ axes[int(dim)][:, 0]
            yield batch.assign(pc=np.clip(pc, -1, 1))

    key = ["label", "dim"]
    placed = stage_table(reps.mapInPandas(first_coordinate, "node string, label string, dim long, copies long, data binary, pc double"), "vec_placed")
    placed = placed.withColumn("bin", F.floor((F.col("pc") + 1) * (BINS / 2)))
    counts = placed.groupBy(*key, "bin").agg(F.count("*").alias("n_bin"))
    before = Window.partitionBy(*key).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # BINS + 1 rows of a label
    starts = stage_table(counts.withColumn("before", F.coalesce(F.sum("n_bin").over(before), F.lit(0))), "vec_bins")
    spot = F.col("before") + F.pmod(F.xxhash64("node"), F.col("n_bin"))
    tiled = stage_table(
        placed.join(starts, [*key, "bin"]).select("node", *key, "copies", "data", "pc", F.floor(spot / tile).cast("int").alias("tile")), "vec_tiled"
    )
    spans = stage_table(tiled.groupBy(*key, "tile").agg(F.min("pc").alias("lo"), F.max("pc").alias("hi")), "vec_spans")
    gap = (2 - 2 * least) ** 0.5 + 1e-9
    one, two = spans.alias("x"), spans.alias("y")
    pairs = one.join(two, key).where(
        (F.col("x.tile") <= F.col("y.tile")) & (F.col("y.lo") <= F.col("x.hi") + gap) & (F.col("x.lo") <= F.col("y.hi") + gap)
    ).select(*key, F.col("x.tile").alias("i"), F.col("y.tile").alias("j"))
    visits = stage_table(
        pairs.select(*key, "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("tile")), "vec_pairs"
    )

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        i, j = int(group["i"].iloc[0]), int(group["j"].iloc[0])
        group = group.sort_values("node", ignore_index=True)
        rows = unit(group["data"].tolist()) @ axes[int(group["dim"].iloc[0])]
        at_a = np.flatnonzero(group["tile"] == i)
        at_b = np.flatnonzero(group["tile"] == j)
        r, c = linked_pairs(rows[at_a], rows[at_b], least)
        r, c = at_a[r], at_b[c]
        if i == j:
            r, c = r[r < c], c[r < c]
        copies = group["copies"].to_numpy()
        links = np.bincount(r, copies[c], len(group)) + np.bincount(c, copies[r], len(group))
        first = np.arange(len(group))
        while len(r):
            low = np.minimum(first[r], first[c])
            was = first.copy()
            np.minimum.at(first, r, low)
            np.minimum.at(first, c, low)
            first = first[first]
            if (first == was).all():
                break
        some = np.flatnonzero(links > 0)
        node = group["node"].to_numpy()
        return pd.DataFrame({"node": node[some], "links": links[some].astype(np.int64), "root": node[first[some]]})

    met = tiled.drop("pc").join(visits, [*key, "tile"])
    return met.groupBy(*key, "i", "j").applyInPandas(compare, "node string, links long, root string")


def group_vectors(df: DataFrame, least: float = 0.93, tile: int = 1024) -> DataFrame:
    """df (vec_id, embedding, label) to vec_id, n_links, component_id and kept."""
    rows = stage_table(vectors(df), "vec_rows")
    valid = rows.where(F.col("node").isNotNull())
    reps = stage_table(
        valid.groupBy("node").agg(
            F.first("label").alias("label"), F.first("dim").alias("dim"), F.count("*").alias("copies"), F.first("data").alias("data"),
            F.min("vec_id").alias("first"),
        ),
        "vec_reps",
    )
    found = stage_table(link_vectors(reps.drop("first"), least, tile), "vec_links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    linked = components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "c_node")
    rooted = stage_table(
        reps.join(links, "node", "left")
        .join(linked, F.col("node") == F.col("c_node"), "left")
        .select("node", "first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("root")),
        "vec_roots",
    )
    least_id = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = stage_table(rooted.join(least_id, "root").select("node", "n_links", "component_id"), "vec_named")
    grouped = valid.join(named, "node").select("vec_id", "n_links", "component_id")
    alone = rows.where(F.col("node").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return grouped.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
