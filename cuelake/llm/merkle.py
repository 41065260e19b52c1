"""Merkle manifest of a table by pivoting children into slots. DataFrame functions only.

Every row becomes a leaf, the leaves of a group ascend by id, and while a group has several nodes every
`fanout` consecutive ones become their hash. The groups' roots, in the order of the groups, are the
leaves of one more tree, whose root names the table.

A pass groups the nodes by parent; conditional aggregates spread the children into one column per
slot. Concatenating the columns hashes the parent, and leaving the own slot out gives a child's
siblings. A pass spreads all nodes `levels` tree levels below its parent, and hashes the levels between
them from column to column, so the number of shuffles is the depth divided by `levels`.

Jobs. Texts are hashed where they are read. Rows of (group, id, leaf) are dealt out by ranges and
numbered: the place of a row in its group is its place in its task plus the counts of the tasks before,
so a group may hold any share of the rows. Each pass is written to the shared folder and has a
`fanout ** levels`-th of the rows of the one before. On the way down each parent hands its path to the
root to its children; only the last step has a row per leaf.

Digests are carried as 32 bytes and hashed as lower-case hexadecimal text.

Edge cases. Null fields are written `-`, a null id or group comes before all others and is hashed so.
Equal ids in a group: by leaf. Repeated rows: each is a leaf. A single leaf is its group's root. Empty
table: empty result. Other columns are ignored."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelake.llm.common import stage_table

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def shown(node: Column) -> Column:
    return F.lower(F.hex(node))


def leaf(fields: Sequence[Column]) -> Column:
    """Digest of a row's fields: each `-` if null, else its UTF-8 byte count, a colon and the value."""
    texts = [f.cast("string") for f in fields]
    return digest(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]))


def _joined(nodes: Sequence[Column]) -> Column:
    """Bytes of the nodes that are there, in order."""
    empty = F.lit(b"")
    return F.concat(empty, *[F.coalesce(n, empty) for n in nodes])


def numbered_leaves(rows: DataFrame) -> DataFrame:
    """rows (lang, doc_id, leaf, changed) to staged leaves (grp, n, idx, node, doc_id, changed): the
    group's place among the groups, its number of leaves, and the leaf's place in it."""
    order = [F.col("lang").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf")]
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stage_table(sorted_rows.withColumn("at", F.monotonically_increasing_id()), "merkle_leaves")
    task = F.shiftright("at", 33)
    blocks = placed.groupBy("lang", task.alias("task")).agg(F.count("*").alias("here"), F.min("at").alias("first"))
    whole = Window.partitionBy("lang")
    upto = whole.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    blocks = stage_table(
        blocks.select(
            "lang", "task", "first", F.coalesce(F.sum("here").over(upto), F.lit(0)).alias("before"),
            F.sum("here").over(whole).alias("n"), F.min("first").over(whole).alias("starts"),
        ),
        "merkle_blocks",
    )
    # groups follow one another in the order of the tasks' rows
    starts = blocks.where("first = starts").select("lang", "starts", F.shiftright("starts", 33).alias("task"))
    # one row per task: the number of tasks is a setting
    earlier = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = starts.groupBy("task").agg(F.count("*").alias("groups"))
    tasks = tasks.select("task", F.coalesce(F.sum("groups").over(earlier), F.lit(0)).alias("groups_before"))
    inside = F.row_number().over(Window.partitionBy("task").orderBy("starts")) - 1
    groups = starts.withColumn("inside", inside).join(tasks, "task").select(
        F.col("lang").alias("g_lang"), (F.col("groups_before") + F.col("inside")).alias("grp")
    )
    known = blocks.join(groups, F.col("lang").eqNullSafe(F.col("g_lang"))).select(
        F.col("lang").alias("b_lang"), F.col("task").alias("b_task"), "grp", "n", "before", "first"
    )
    at_block = F.col("lang").eqNullSafe(F.col("b_lang")) & (task == F.col("b_task"))
    return placed.join(known, at_block).select(
        "grp", "n", (F.col("at") - F.col("first") + F.col("before")).alias("idx"), F.col("leaf").alias("node"), "doc_id", "changed"
    )


class Tree:
    """The passes over nodes (grp, n, idx, node, other columns of the leaves)."""

    def __init__(self, nodes: DataFrame, fanout: int, levels: int, carried: Sequence[str] = ()) -> None:
        self.fanout, self.levels, self.width = fanout, levels, fanout**levels
        self.carried = list(carried)
        most = nodes.agg(F.max("n")).first()[0] or 0
        self.passes: list[DataFrame] = []
        reach = 1
        while not self.passes or reach < most:
            fields = ["node", *self.carried] if not self.passes else ["node"]
            slot = F.pmod("idx", F.lit(self.width))
            spread = [F.max(F.when(slot == k, F.struct(*fields))).alias(f"c{k}") for k in range(self.width)]
            parent = F.floor(F.col("idx") / self.width).cast("long")
            grouped = stage_table(nodes.groupBy("grp", "n", parent.alias("parent")).agg(*spread), "merkle_pass")
            self.passes.append(grouped)
            reach *= self.width
            nodes = self._hashed(grouped, len(self.passes) - 1).select(
                "grp", "n", F.col("parent").alias("idx"), F.col(f"v{levels}_0").alias("node")
            )
        #: grp, node: the root of each group
        self.roots = nodes.select("grp", "node")

    def _hashed(self, grouped: DataFrame, number: int) -> DataFrame:
        """Adds v{j}_{i}, the nodes j levels above the children of a pass. A group's tree ends where it
        has one node; further levels pass it on."""
        out = grouped.withColumns({f"v0_{k}": F.col(f"c{k}")["node"] for k in range(self.width)})
        for j in range(self.levels):
            level = number * self.levels + j
            made = {}
            for i in range(self.width // self.fanout ** (j + 1)):
                children = [F.col(f"v{j}_{i * self.fanout + k}") for k in range(self.fanout)]
                text = F.concat(*[F.coalesce(shown(c), F.lit("")) for c in children])
                several = F.col("n") > F.lit(self.fanout**level).cast("decimal(38,0)")
                made[f"v{j + 1}_{i}"] = F.when(children[0].isNotNull(), F.when(several, digest(text)).otherwise(children[0]))
            out = out.withColumns(made)
        return out

    def _siblings(self, slot: int, number: int) -> list[Column]:
        """The other children of the runs that a child passes on its way up, as bytes before and after
        it; null above the group's root."""
        out = []
        for j in range(self.levels):
            own = slot // self.fanout**j
            run = range(own // self.fanout * self.fanout, own // self.fanout * self.fanout + self.fanout)
            before, after = ([F.col(f"v{j}_{i}") for i in run if side(i)] for side in (lambda i: i < own, lambda i: i > own))
            several = F.col("n") > F.lit(self.fanout ** (number * self.levels + j)).cast("decimal(38,0)")
            out.append(F.when(several, F.struct(_joined(before).alias("before"), _joined(after).alias("after"))))
        return out

    def paths(self, above: DataFrame) -> DataFrame:
        """Every leaf with its path: `above` (grp, path, other columns) holds each group's own path to
        the root. Columns: grp, idx, node, carried, path (array of bytes before and after), others."""
        others = [c for c in above.columns if c not in ("grp", "path")]
        parents = above.withColumn("parent", F.lit(0).cast("long"))
        for number in reversed(range(len(self.passes))):
            held = self._hashed(self.passes[number], number).join(parents, ["grp", "parent"])
            children = F.array_compact(F.array(*[
                F.when(F.col(f"c{k}").isNotNull(), F.struct(
                    (F.col("parent") * self.width + k).alias("idx"), F.col(f"c{k}").alias("c"),
                    F.array_compact(F.array(*self._siblings(k, number))).alias("near"),
                ))
                for k in range(self.width)
            ]))
            rows = held.select("grp", *others, "path", F.explode(children).alias("row"))
            path = F.concat("row.near", "path").alias("path")
            if number:
                parents = rows.select("grp", F.col("row.idx").alias("parent"), path, *others)
            else:
                return rows.select("grp", "row.idx", "row.c.*", path, *others)


def proof_text(path: Column) -> Column:
    return F.array_join(F.transform(path, lambda p: F.concat(shown(p["before"]), shown(p["after"]))), "")


def fold(path: Column, node: Column) -> Column:
    """Root (hexadecimal) that a leaf and its path lead to."""
    return F.aggregate(
        path, shown(node), lambda own, p: F.sha2(F.concat(shown(p["before"]), own, shown(p["after"])), 256)
    )


def manifest(docs: DataFrame, changed: Column, fanout: int = 2, levels: int = 3) -> DataFrame:
    """docs (doc_id, source, lang, n_chars, text) to one row per document: doc_id, leaf, subroot, root,
    path, and `other`: the leaf of the row with `n_chars` as `changed` says, null where that is null."""
    fields = [F.col(c) for c in FIELDS]
    edited = [changed.alias("n_chars") if c == "n_chars" else F.col(c) for c in FIELDS]
    rows = docs.select(
        "lang", F.col("doc_id").cast("long").alias("doc_id"), leaf(fields).alias("leaf"),
        F.when(changed.isNotNull(), leaf(edited)).alias("changed"),
    )
    below = Tree(numbered_leaves(rows), fanout, levels, ["doc_id", "changed"])
    roots = stage_table(below.roots, "merkle_roots")
    n_groups = roots.count()
    top = Tree(
        roots.select(F.lit(0).cast("long").alias("grp"), F.lit(n_groups).cast("long").alias("n"), F.col("grp").alias("idx"), "node"),
        fanout, levels,
    )
    no_path = F.array().cast("array<struct<before:binary,after:binary>>")
    crown = top.paths(top.roots.select("grp", no_path.alias("path"), F.col("node").alias("root")))
    above = stage_table(crown.select(F.col("idx").alias("grp"), "path", F.col("node").alias("subroot"), "root"), "merkle_groups")
    return below.paths(above).select(
        "doc_id", F.col("node").alias("leaf"), "subroot", "root", "path", F.col("changed").alias("other")
    )


def verified(found: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root (from `other` where it is there),
    verified."""
    folded = found.withColumn("folded_root", fold(F.col("path"), F.coalesce("other", "leaf")))
    return folded.select(
        "doc_id", shown(F.col("leaf")).alias("leaf"), shown(F.col("subroot")).alias("subroot"), shown(F.col("root")).alias("root"),
        F.sha2(proof_text(F.col("path")), 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == shown(F.col("root"))).alias("verified"),
    )
