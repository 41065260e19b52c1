"""Display states: accepted text blocks, review edits, and exported slide text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.functions import clock as K
from cuelake.functions import text as T
from cuelake.functions.arrays import posexplode_rows
from cuelake.operators.ordered import Scan, numbered, ordered_scan, row_block, time_block

# Labels printed in exported documents.
UNTITLED = "[Non-source label: titleless slide]"
TEXTLESS = "[Audit: textless source region]"
PENDING = "[Audit: extraction pending/incomplete]"


def eligible_states(states: DataFrame) -> DataFrame:
    """States that extraction may read: all that nobody excluded."""
    return states.where(F.col("status") != "excluded")


def update_flags(flags: Column, add: Column, drop: Column) -> Column:
    """A state's flags with some added and then some dropped, each once, in the order they came."""
    return F.array_except(F.array_union(flags, add), drop)


def selected_totals(estimates: DataFrame) -> DataFrame:
    """estimates(media_id, estimate), one row per chosen crop, to their number and exact sum."""
    return estimates.groupBy("media_id").agg(F.count(F.lit(1)).alias("crops"), F.sum("estimate").alias("estimate"))


def representative_crops(states: DataFrame, crops: DataFrame) -> DataFrame:
    """Crops of each state's representative evidence."""
    s = states.select("state_id", F.col("representative_id").alias("evidence_id"))
    return crops.join(s, ["state_id", "evidence_id"], "inner")


def accepted_attempts(crops: DataFrame, attempts: DataFrame, accepted: DataFrame) -> DataFrame:
    """Per crop the accepted attempt when it completed, else the last completed one."""
    a = attempts.where((F.col("outcome") == "completed") & F.col("extraction").isNotNull())
    pick = accepted.select("state_id", "crop_id", F.col("attempt_id").alias("want"))
    marked = a.join(pick, ["state_id", "crop_id"], "left")
    chosen = F.coalesce(F.col("want") == F.col("attempt_id"), F.lit(False))
    best = marked.groupBy("state_id", "crop_id").agg(
        F.max_by(F.struct("attempt_id", "extraction"), F.struct(chosen.alias("c"), F.col("ord").alias("o"))).alias("x")
    ).select("state_id", "crop_id", "x.*")
    return crops.select("state_id", F.col("id").alias("crop_id"), F.col("pos").alias("crop_pos")).join(
        best, ["state_id", "crop_id"], "left"
    )


def state_blocks(chosen: DataFrame, edits: DataFrame) -> DataFrame:
    """Blocks of the chosen attempts in crop and block order, with a manual edit where there is
    one (edits: state_id, block_key '{crop}:{index}', edited)."""
    rows = posexplode_rows(
        chosen, ["state_id", "crop_id", "crop_pos"], F.col("extraction.blocks"), "idx", "block"
    ).withColumn("block_key", F.concat("crop_id", F.lit(":"), "idx"))
    return rows.join(edits, ["state_id", "block_key"], "left")


def literal_block(b: Column) -> Column:
    table = F.array_join(F.transform(b["rows"], lambda r: F.array_join(r, "\t")), "\n")
    return F.when(b["type"] == "table", table).otherwise(b["text"])


def markdown_block(b: Column, edited: Column) -> Column:
    text = F.coalesce(edited, literal_block(b))
    row = lambda r: F.concat(
        F.lit("| "),
        F.array_join(F.transform(r, lambda c: F.replace(T.markdown_escape(c), F.lit("\n"), F.lit("<br>"))), " | "),
        F.lit(" |"),
    )
    lines = F.transform(b["rows"], row)
    rule = F.concat(
        F.lit("| "), F.array_join(F.transform(F.get(b["rows"], F.lit(0)), lambda c: F.lit("---")), " | "), F.lit(" |")
    )
    grid = F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, 1_000_000)), "\n")
    runs = F.regexp_extract_all(text, F.lit("(`+)"), 1)
    longest = F.coalesce(F.array_max(F.transform(runs, lambda r: F.length(r))), F.lit(0))
    fence = F.repeat(F.lit("`"), F.greatest(F.lit(3), longest + 1))
    return (
        F.when(edited.isNull() & (b["type"] == "table"), F.when(F.size(b["rows"]) > 0, grid).otherwise(""))
        .when(b["type"] == "code", F.concat(fence, F.lit("\n"), text, F.lit("\n"), fence))
        .otherwise(T.markdown_escape(text))
    )


def export_slides(states: DataFrame, chosen: DataFrame, blocks: DataFrame, markdown: bool = False) -> DataFrame:
    """Document chunks (media_id, ord, chunk), one per state that is not excluded.

    A state holds a bounded number of blocks (crops and blocks are limited by validation), so its
    own text is gathered; recordings are not."""
    text = markdown_block(F.col("block"), F.col("edited")) if markdown else F.coalesce("edited", literal_block(F.col("block")))
    at = F.struct("crop_pos", "idx")
    heading = F.when(F.col("block.type") == "heading", at)
    body = blocks.withColumn("text", text).groupBy("state_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("crop_pos", "idx", "text"))), lambda x: x["text"]), "\n\n"
        ).alias("source"),
        F.min_by(F.coalesce("edited", "block.text"), heading).alias("title"),
        F.count(F.lit(1)).alias("n"),
    )
    textless = chosen.groupBy("state_id").agg(
        F.bool_and(F.coalesce(F.col("extraction.status") == "textless", F.lit(False))).alias("textless")
    )
    shown = states.where(F.col("status") != "excluded").select("media_id", "state_id", "start_ms", "end_ms")
    order = numbered(shown, ["media_id"], ["start_ms", "state_id"], time_block(), "ord")
    rows = order.join(body, "state_id", "left").join(textless, "state_id", "left")
    label = F.concat(
        F.lit("["), K.format_clock_ms(F.col("start_ms"), "."), F.lit(" – "), K.format_clock_ms(F.col("end_ms"), "."), F.lit("] Slide "),
        F.lpad((F.col("ord") + 1).cast("string"), F.greatest(F.lit(3), F.length((F.col("ord") + 1).cast("string"))), F.lit("0")),
        F.lit(" — "), F.coalesce("title", F.lit(UNTITLED)),
    )
    head = F.concat(F.lit("### "), T.markdown_escape(label)) if markdown else label
    note = F.when(F.coalesce("textless", F.lit(False)), F.lit("\n" + TEXTLESS)).when(
        F.coalesce("n", F.lit(0)) == 0, F.lit("\n" + PENDING)
    ).otherwise("")
    gap = F.when(F.col("ord") > 0, "\n\n").otherwise("")
    return rows.select(
        "media_id", "ord", F.concat(gap, head, F.lit("\n"), F.coalesce("source", F.lit("")), note).alias("chunk")
    )


def search_blocks(blocks: DataFrame, term: str) -> DataFrame:
    shown = F.coalesce("edited", literal_block(F.col("block")))
    return blocks.where(F.contains(F.lower(shown), F.lit(term.lower())))


def exclude_states(states: DataFrame, audit: DataFrame, excluded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Exclude states and record one audit interval for each, unless it is there already."""
    out = states.join(excluded.select("state_id").withColumn("__x", F.lit(True)), "state_id", "left")
    new = out.withColumn("status", F.when(F.col("__x"), "excluded").otherwise(F.col("status"))).drop("__x")
    rows = out.where("__x").select(
        "media_id", F.concat(F.lit("excluded:"), "state_id").alias("id"), "start_ms", "end_ms", F.lit("excluded").alias("kind")
    ).join(audit.select("media_id", "id"), ["media_id", "id"], "left_anti")
    return new, audit.unionByName(rows)


def upsert_regions(regions: DataFrame, fresh: DataFrame, slack_ms: int = 50) -> DataFrame:
    """Replace key frames within 50 ms of a new one: both sides are put in 50 ms bins, so a row
    meets only new frames of its own and the two neighbouring bins."""
    bin_of = lambda c: F.floor(F.col(c) / (slack_ms + 1)).cast("bigint")
    near = fresh.select(
        "media_id", F.col("time_ms").alias("n_ms"),
        F.explode(F.array(bin_of("time_ms") - 1, bin_of("time_ms"), bin_of("time_ms") + 1)).alias("bin"),
    )
    old = regions.withColumn("bin", bin_of("time_ms"))
    close = F.abs(old["time_ms"] - near["n_ms"]) <= slack_ms
    kept = old.join(near, (old["media_id"] == near["media_id"]) & (old["bin"] == near["bin"]) & close, "left_anti").drop("bin")
    rows = kept.drop("pos").unionByName(fresh.drop("pos"), allowMissingColumns=True)
    return ordered_scan(rows, ["media_id"], ["time_ms"], time_block("time_ms"), [Scan("pos", "position")])


def approved_prefix(states: DataFrame, approved: DataFrame) -> DataFrame:
    """States in order up to the first one that is not approved."""
    marked = states.join(approved.select("state_id").withColumn("__ok", F.lit(True)), "state_id", "left")
    seen = ordered_scan(
        marked, ["media_id"], ["ord"], row_block("ord"),
        [Scan("__bad", "sum", F.when(F.col("__ok").isNull(), 1).otherwise(0).cast("bigint"))],
    )
    return seen.where(F.col("__bad") == 0).select(*states.columns)


def region_dimensions(corners: Column, width: Column, height: Column) -> tuple[Column, Column]:
    def edge(i: int, j: int) -> Column:
        a, b = F.get(corners, F.lit(i)), F.get(corners, F.lit(j))
        return F.hypot((a["x"] - b["x"]) * width, (a["y"] - b["y"]) * height)

    size = lambda a, b: F.greatest(F.lit(1.0), F.round(F.greatest(a, b))).cast("bigint")
    return size(edge(0, 1), edge(3, 2)), size(edge(0, 3), edge(1, 2))
