"""Extractive summaries and the limits of a summary request. The phrases of a summary are fixed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelake.functions import text as T
from cuelake.functions.arrays import posexplode_rows
from cuelake.operators.joins import attach_key_values
from cuelake.operators.ordered import BLOCK_ROWS, Scan, ordered_scan, row_block
from cuelake.session import stage_table

KEY = ["media_id"]
# Request limits.
MAX_PARAGRAPHS, MAX_TEXT, MAX_SPEAKER, MAX_TITLE, MAX_LANGUAGE = 800, 800, 40, 300, 16
BODY_CHARS, PACK_CHARS, MAX_PACKS = 40_000, 7_000, 5
PER_THIRD, MAX_POINTS, SAME_PREFIX = 3, 10, 24


def summary_input(paragraphs: DataFrame) -> DataFrame:
    """Paragraphs as a summary request takes them: the first 800, with clipped fields."""
    return paragraphs.where(F.col("seq") < MAX_PARAGRAPHS).select(
        "media_id", "seq", F.left("text", F.lit(MAX_TEXT)).alias("text"),
        F.left(F.nullif(F.col("speaker"), F.lit("")), F.lit(MAX_SPEAKER)).alias("speaker"),
    )


def opening_sample(paragraphs: DataFrame, lines: int = 12) -> DataFrame:
    """The first lines of a recording as one text, which its language is told from."""
    first = F.array_sort(F.collect_list(F.struct("seq", "text")))  # at most `lines` rows of a recording
    return paragraphs.where(F.col("seq") < lines).groupBy("media_id").agg(
        F.array_join(F.transform(first, lambda x: x["text"]), " ").alias("sample")
    )


def spoken_line() -> Column:
    who = F.nullif(F.col("speaker"), F.lit(""))
    return F.concat(F.when(who.isNotNull(), F.concat(who, F.lit(": "))).otherwise(""), "text")


def body_prefix(paragraphs: DataFrame, limit: int = BODY_CHARS) -> DataFrame:
    """Leading lines that fit the limit, counting one separator each."""
    line = paragraphs.withColumn("line", spoken_line())
    out = ordered_scan(
        line, KEY, ["seq"], row_block(), [Scan("__used", "sum", (F.length("line") + 1).cast("bigint"))]
    )
    return out.where(F.col("__used") <= limit).select("media_id", "seq", "line")


def pack_lines(paragraphs: DataFrame, span: int = BLOCK_ROWS) -> DataFrame:
    """packs(media_id, pack, text): consecutive lines in packs of about 7,000 characters; a line
    without text takes no room.

    A pack that begins with a line ends before the first line whose end lies more than PACK_CHARS behind
    its start; lines end in rising order, so that line's number is the count of the ends up to there: one
    ordered scan over ends and limits gives every line its next pack, whether a pack begins with it or
    not. From the first line on these pointers are doubled: a round finds as many packs as there were
    before, and the number of rounds is the logarithm of the packs of the longest recording. Rows meet by
    recording and line, so a long recording is spread. ``span``: characters in a block of the scan."""
    line = paragraphs.withColumn("line", spoken_line())
    sizes = line.select("media_id", "seq", F.coalesce(F.length("line"), F.lit(0)).cast("bigint").alias("size"))
    placed = stage_table(ordered_scan(
        sizes, KEY, ["seq"], row_block(), [Scan("at", "position"), Scan("ends", "sum", F.col("size") + 1)]
    ), "lines")
    ends = placed.select("media_id", (F.col("ends") - 1).alias("reach"), F.lit(0).alias("asks"), "at")
    limits = placed.select("media_id", (F.col("ends") - F.col("size") - 1 + PACK_CHARS).alias("reach"), F.lit(1).alias("asks"), "at")
    counted = ordered_scan(
        ends.unionByName(limits), KEY, ["reach", "asks", "at"], row_block("reach", span), [Scan("ended", "sum", 1 - F.col("asks"))]
    ).where("asks = 1")
    hops = stage_table(counted.select("media_id", "at", F.greatest("ended", F.col("at") + 1).cast("bigint").alias("to")), "hops")
    starts = placed.where("at = 0").select("media_id", "at", F.lit(0).cast("bigint").alias("pack"))
    width = 1
    while not hops.isEmpty():
        after = starts.join(hops, ["media_id", "at"]).select("media_id", F.col("to").alias("at"), (F.col("pack") + width).alias("pack"))
        starts = stage_table(starts.unionByName(after), "starts")
        on = hops.select("media_id", F.col("at").alias("to"), F.col("to").alias("next"))
        hops = stage_table(hops.join(on, ["media_id", "to"]).select("media_id", "at", F.col("next").alias("to")), "hops")
        width *= 2
    opened = placed.select("media_id", "seq", "at").join(starts, ["media_id", "at"], "left").select("media_id", "seq", F.col("pack").alias("opens"))
    packs = ordered_scan(opened, KEY, ["seq"], row_block(), [Scan("pack", "last", F.col("opens"))]).drop("opens")
    lines = F.array_sort(F.collect_list(F.struct("seq", "line")))
    return line.join(packs, ["media_id", "seq"]).groupBy("media_id", "pack").agg(
        F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("text")
    )


def sample_packs(packs: DataFrame) -> DataFrame:
    """All packs up to five; beyond that the first, three evenly spaced middle ones, the last."""
    n = packs.groupBy("media_id").agg((F.max("pack") + 1).alias("n"))
    mid = F.col("n") - 2
    picks = F.transform(
        F.array(*[F.lit(i) for i in (1, 2, 3)]),
        lambda i: F.least(mid - 1, F.greatest(F.lit(0), F.floor(i * mid / 4 - 1 + 0.5))) + 1,
    )
    wanted = F.when(F.col("n") > MAX_PACKS, F.array_distinct(
        F.concat(F.array(F.lit(0).cast("bigint")), picks.cast("array<bigint>"), F.array((F.col("n") - 1).cast("bigint")))
    )).otherwise(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1))
    keep = n.select("media_id", F.explode(wanted).alias("pack"))
    chosen = packs.join(keep, ["media_id", "pack"], "left_semi").join(n, "media_id")
    # Where packs are sampled, at most five rows of a recording: a middle pack equal to one kept
    # before it is left out, and the last one if it equals the one kept before it.
    whole = Window.partitionBy("media_id").orderBy("pack")
    same = Window.partitionBy("media_id", F.md5(F.col("text").cast("binary"))).orderBy("pack")
    end = F.col("pack") == F.col("n") - 1
    middle = chosen.withColumn("__new", (F.row_number().over(same) == 1) | end)
    told = middle.where(F.col("__new") | (F.col("n") <= MAX_PACKS)).withColumn("__before", F.lag("text").over(whole))
    return told.where((F.col("n") <= MAX_PACKS) | ~end | ~F.col("text").eqNullSafe(F.col("__before"))).select(*packs.columns)


def summary_sentences(paragraphs: DataFrame) -> DataFrame:
    """pool(media_id, idx, total, sentence): usable sentences, or all when none is usable. Positions are
    counted over paragraphs, which are narrow rows then; texts meet them once."""
    parts = F.transform(T.split_sentences(F.col("text")), lambda s: F.struct(s.alias("sentence"), (~T.is_boilerplate(s)).alias("usable")))
    cut = paragraphs.select("media_id", "seq", parts.alias("parts")).select(
        "media_id", "seq", "parts", F.coalesce(F.size("parts"), F.lit(0)).cast("bigint").alias("n_all"),
        F.coalesce(F.size(F.filter("parts", lambda x: x["usable"])), F.lit(0)).cast("bigint").alias("n_usable"),
    )
    # Splitting is the costly part and the rows are read several times below.
    cut = stage_table(cut, "sentences")
    counts = cut.where("n_all > 0").select("media_id", "seq", "n_all", "n_usable")
    whole = counts.groupBy("media_id").agg(F.sum("n_usable").alias("t_usable"), F.sum("n_all").alias("t_all"))
    before = ordered_scan(counts, KEY, ["seq"], row_block(), [
        Scan("b_usable", "sum_before", F.col("n_usable")), Scan("b_all", "sum_before", F.col("n_all"))])
    known = attach_key_values(before, KEY, row_block(), whole)
    none = F.col("t_usable") == 0
    place = known.select(
        "media_id", "seq", none.alias("any"), F.when(none, F.col("t_all")).otherwise(F.col("t_usable")).alias("total"),
        F.when(none, F.col("b_all")).otherwise(F.col("b_usable")).alias("first"),
    )
    mine = F.when(F.col("any"), F.col("parts")).otherwise(F.filter("parts", lambda x: x["usable"]))
    rows = posexplode_rows(cut.select("media_id", "seq", "parts").join(place, ["media_id", "seq"]), ["media_id", "first", "total"], mine, "pos", "part")
    return rows.select("media_id", (F.col("first") + F.col("pos")).alias("idx"), "total", F.col("part.sentence").alias("sentence"))


def top_sentences(pool: DataFrame, with_first: bool = False) -> DataFrame:
    """The three best sentences of each third, ties by position. A pool is free of boilerplate or nothing
    else, so that part of the score is left out: it changes no order. The limit on the rank lets Spark keep
    three rows of a third in each task before they are shuffled. With ``with_first`` the first sentence
    of the pool comes too, in a third of its own, numbered 3."""
    opening = F.when((F.col("idx") == 0) & F.lit(with_first), F.array(F.lit(3))).otherwise(F.array().cast("array<int>"))
    scored = pool.withColumns({
        "score": T.score_sentence(F.col("sentence"), F.col("idx"), F.col("total"), F.lit(False)),
        # A short pool reads one sentence in each third even where thirds would be empty.
        "thirds": F.filter(
            F.sequence(F.lit(0), F.lit(2)),
            lambda k: (F.col("idx") >= F.floor(F.col("total") * k / 3))
            & (F.col("idx") < F.greatest(
                F.floor(F.col("total") * k / 3) + 1, F.floor(F.col("total") * (k + 1) / 3))),
        ),
    }).withColumn("third", F.explode(F.concat("thirds", opening))).drop("thirds")
    best = Window.partitionBy("media_id", "third").orderBy(F.col("score").desc(), F.col("idx"))
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= PER_THIRD)


def summarize(jobs: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """jobs(media_id, title, kind) to (media_id, summary): key points from the opening, the middle
    and the end, never a pasted opening."""
    top = top_sentences(summary_sentences(paragraphs), with_first=True).withColumn("point", T.shorten_point(F.col("sentence")))
    best = F.when(F.col("third") < 3, F.struct("third", "rank", "point"))
    points = top.groupBy("media_id").agg(
        F.transform(F.array_sort(F.collect_list(best)), lambda x: x["point"]).alias("points"),
        F.min_by("sentence", "idx").alias("first"),  # of the whole pool
    )
    empty = F.array().cast("array<string>")
    kept = F.aggregate(
        "points", empty,
        lambda acc, p: F.when(
            (p == "") | F.exists(acc, lambda line: F.contains(line, F.left(p, F.lit(SAME_PREFIX)))), acc
        ).otherwise(F.concat(acc, F.array(p))),
    )
    bullets = F.transform(F.slice(kept, 1, MAX_POINTS), lambda p: F.concat(F.lit("- "), p))
    label = F.concat(T.label_of(F.col("kind"), T.KEY_POINT_LABELS, "Talk"), F.lit(" key points:"))
    title = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.lit("this video"))
    return jobs.join(points, "media_id", "left").select(
        "media_id",
        F.when(F.col("points").isNull(), F.concat(F.lit("No usable caption text to summarize for “"), title, F.lit("”.")))
        .when(F.size(kept) == 0, F.concat(F.lit("- "), T.shorten_point(F.col("first"), 120)))
        .otherwise(F.concat(label, F.lit("\n"), F.array_join(bullets, "\n"))).alias("summary"),
    )


def transcript_dumps(summaries: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """summaries(media_id, summary) with ``dump``: blank, marked automatic, pasted from the first
    six paragraphs, or a few very long lines."""
    opening = paragraphs.where(F.col("seq") < 6).groupBy("media_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), " ").alias("opening")
    )
    s = T.trim(F.col("summary"))
    compact = T.squash(F.regexp_replace(s, f"(?m)^[-*•][{T.SPACE}]*", ""))
    lines = F.filter(F.transform(F.split(s, "\n"), T.trim), lambda x: x != "")
    long = F.size(F.filter(lines, lambda x: F.length(x) > 180))
    told = F.regexp_replace(F.coalesce("opening", F.lit("")), f"[{T.SPACE}]+", " ")
    return summaries.join(opening, "media_id", "left").withColumn(
        "dump",
        (s == "") | F.regexp_like(s, F.lit("(?i)auto-extracted"))
        | ((F.length(compact) >= 80) & F.contains(told, F.left(compact, F.lit(72))))
        | ((long >= 2) & (F.size(lines) <= 4)),
    ).drop("opening")
