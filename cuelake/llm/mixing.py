"""Mixing sources to target weights with hash thresholds. DataFrame functions only.

Sizes are summed by source; targets follow from weights with a cap per source. What a source takes
is decided by a 64-bit hash of the row: whole passes over the source as long as the target holds
them, and of the rest the rows below a threshold. The threshold comes from nested histograms: sums
by source and leading hash bits, the bucket that the budget ends in, then sums of that bucket's
rows by the next bits, and so on. Only rows of boundary buckets are read again, nothing is sorted,
and a hot source costs one row per bucket and task.

Equal rows have one hash. Where the budget ends among such rows, they alone are numbered (inside the
tasks that read them, on top of the counts of the tasks before) and as many are taken as it needs.

Edge cases. Null text has no words. Null source is a source of its own and comes last. A source
without words has target 0. Null ids are allowed. Empty table: empty result. Other columns are ignored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelake.llm.common import WORD, row_hash, stage_table, wrapped
from cuelake.operators.ordered import numbered

HASH_BITS = 62
BITS = 10  # hash bits per histogram level
LEVELS = 4  # 2^40 thresholds: nearer than one row of any source that fits a table


def word_count(text: Column) -> Column:
    """Number of words; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_of(doc_id: Column, text: Column) -> Column:
    return F.shiftrightunsigned(row_hash(doc_id.cast("long"), text), 64 - HASH_BITS)


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, h (hash of the row) per row."""
    text = F.col("text")
    return docs.select(
        F.col("doc_id").cast("long"),
        F.col("source").cast("string"),
        word_count(text).alias("size"),
        hash_of(F.col("doc_id"), text).alias("h"),
    )


def targets(sizes: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """source, source_size to those and target. Sources by code point, null last, get the weights in
    turn; their targets share `share` of all sizes, each at most `most` times its size, and what is
    above is shared again by weight. That ends at min(cap, weight * level) with one level for all;
    the level follows from running sums over the sources ordered by cap / weight.

    The windows see one row per source, which the sums by source have already reduced."""
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(most))
    everything = Window.partitionBy()
    rising = Window.orderBy("full_at", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    staged = (
        sizes.withColumn("weight", weight)
        .withColumn("cap", cap)
        .withColumn("full_at", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("weight_all", F.sum("weight").over(everything))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(rising), F.lit(0.0)))
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(rising), F.lit(0.0)))
    )
    # the level if exactly the sources before this one are full; the first that stays below its cap decides
    level = (F.col("total") - F.col("cap_before")) / (F.col("weight_all") - F.col("weight_before"))
    found = F.min(F.when(level <= F.col("full_at"), F.struct("full_at", level.alias("level")))).over(everything)
    return staged.withColumn("level", found["level"]).select(
        "source", "source_size", F.coalesce(F.least(F.col("cap"), F.col("weight") * F.col("level")), F.col("cap")).alias("target")
    )


def thresholds(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """Per source: `times`, the whole passes that every row gets, and `limit`, the hash below which
    a row is taken once more. goals: source, source_size, target."""
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-9)).otherwise(F.lit(0)).cast("long")
    state = goals.select(
        "source", times.alias("times"), (F.col("target") - times * F.col("source_size")).alias("left"), F.lit(0).cast("long").alias("prefix")
    )
    for level in range(LEVELS):
        shift = HASH_BITS - BITS * (level + 1)
        inside = rows.alias("r").join(state.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")))
        inside = inside.where(F.shiftright("h", shift + BITS) == F.col("prefix"))
        sums = inside.groupBy(F.col("s.source").alias("source"), F.shiftright("h", shift).alias("bucket"), "left").agg(F.sum("size").alias("n"))
        up_to = Window.partitionBy("source").orderBy("bucket")  # 2^BITS buckets of a source at most
        ends = (
            sums.withColumn("upto", F.sum("n").over(up_to))
            .where(F.col("upto") > F.col("left"))
            .groupBy("source")
            .agg(F.min_by(F.struct("bucket", (F.col("upto") - F.col("n")).alias("below")), "bucket").alias("e"))
        )
        # a source whose budget never ends among its rows keeps the end of its range
        past = F.shiftleft(F.col("prefix"), BITS) + (1 << BITS)
        refined = state.alias("s").join(ends.alias("x"), F.col("s.source").eqNullSafe(F.col("x.source")), "left").select(
            F.col("s.source").alias("source"), "times",
            (F.col("left") - F.coalesce("e.below", F.lit(0))).alias("left"),
            F.coalesce("e.bucket", past).alias("prefix"),
        )
        state = stage_table(refined, f"mix_level{level}")
    # what is left is spent on the rows of the last bucket in the order of their hashes; rows of one
    # hash are equal, and as many of them are taken as end nearest to the target
    shift = HASH_BITS - BITS * LEVELS
    last = rows.alias("r").join(state.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")))
    last = last.where(F.shiftright("h", shift) == F.col("prefix")).groupBy(F.col("s.source").alias("source"), "h", "left").agg(
        F.count("*").alias("m"), F.max("size").alias("each")
    )
    # one row per hash of a bucket of 2^-40 of the hashes
    before = Window.partitionBy("source").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("left") - F.coalesce(F.sum(F.col("m") * F.col("each")).over(before), F.lit(0))
    some = F.least(F.col("m"), F.greatest(F.lit(0), F.ceil(room / F.col("each") - 0.5))).cast("long")
    ends = last.where("each > 0").withColumn("some", some).where("some < m").groupBy("source").agg(
        F.min(F.struct("h", "some")).alias("e")
    )
    found = state.alias("s").join(ends.alias("x"), F.col("s.source").eqNullSafe(F.col("x.source")), "left")
    whole = F.shiftleft(F.col("prefix") + 1, shift)
    return found.select(
        F.col("s.source").alias("source"), "times", F.coalesce("e.h", whole).alias("limit"),
        F.coalesce("e.some", F.lit(0).cast("long")).alias("some"),
    )


def mix_plan(rows: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """One row per source of `rows` (of `sized`): p_source, source_size, target, times, limit, some."""
    by_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = stage_table(targets(by_source, list(weights), share, most), "mix_targets")
    plan = goals.alias("g").join(thresholds(rows, goals).alias("l"), F.col("g.source").eqNullSafe(F.col("l.source")))
    return stage_table(plan.select(F.col("g.source").alias("p_source"), "source_size", "target", "times", "limit", "some"), "mix_plan")


def with_copies(rows: DataFrame, source: Column, h: Column, plan: DataFrame) -> DataFrame:
    """rows with the columns of the plan and copies. Rows below the limit are taken once more than
    the passes, and `some` of the rows at the limit."""
    joined = rows.withColumns({"own_h": h, "own_source": source}).join(plan, F.col("own_source").eqNullSafe(F.col("p_source")))
    tied = (F.col("own_h") == F.col("limit")) & (F.col("some") > 0)
    simple = joined.withColumn("copies", F.col("times") + (F.col("own_h") < F.col("limit")).cast("long"))
    if plan.where("some > 0").isEmpty():
        return simple
    at = stage_table(joined.where(tied).withColumn("at", F.monotonically_increasing_id()), "mix_ties")
    keyed = at.withColumns({"no_source": F.col("own_source").isNull(), "key": F.coalesce("own_source", F.lit(""))})
    placed = numbered(keyed, ["no_source", "key"], ["at"], F.shiftright("at", 33), "place")
    split = placed.withColumn("copies", F.col("times") + (F.col("place") < F.col("some")).cast("long"))
    return simple.where(~tied).unionByName(split.select(*simple.columns))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """docs (doc_id, source, text) to doc_id, source, size, source_size, target, copies and taken per row."""
    rows = stage_table(sized(docs), "mix_sizes")
    taken = with_copies(rows, F.col("source"), F.col("h"), mix_plan(rows, weights, share, most))
    return taken.select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def repeat_mixed(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it, with their own columns only."""
    plan = mix_plan(stage_table(sized(docs), "mix_sizes"), weights, share, most).select("p_source", "times", "limit", "some")
    own = wrapped(docs)
    chosen = with_copies(own, F.col("doc.source").cast("string"), hash_of(F.col("doc.doc_id"), F.col("doc.text")), plan)
    return chosen.where("copies > 0").select("doc", F.expr("explode(sequence(1L, copies))").alias("copy")).select("doc.*")
