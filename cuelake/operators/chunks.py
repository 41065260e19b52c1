"""Overlapping audio chunks: planning, splitting, and merging their transcripts."""

from __future__ import annotations

import unicodedata
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType, IntegerType, StringType, StructField, StructType,
)

from cuelake.functions import text as T
from cuelake.functions.checks import one_of, within
from cuelake.operators.joins import nearest_silence
from cuelake.operators.ordered import Scan, ordered_scan, row_block, time_block
from cuelake.session import stage_table

# Planning and merge settings (milliseconds, bytes, characters).
CORE_MS, BUFFER_MS, MIN_CORE_MS, MAX_BYTES = 300_000, 3_000, 10_000, 3_000_000
MAX_WORDS, WORDS_PER_SEC, CHARS_PER_SEC, MIN_CHARS = 50, 6, 40, 20
AUTO, POSSIBLE, ANCHOR = 0.88, 0.78, 8
ALIASES = {"엔비디아": "nvidia"}
CONTENT_MODES = ["speech", "meeting", "interview", "lecture", "podcast", "ai-conference", "lyrics"]
UPLOAD_LANGUAGES = ["ko-en", "ko", "en", "auto"]
CHUNK_BLOCK_MS = 86_400_000


def _fixed(ms: Column) -> Column:
    """Seconds with three decimals, rounded half up on the exact binary value of the double."""
    sec = ms / 1000
    whole = F.floor(sec).cast("bigint")
    scaled = ((sec - whole) * F.lit(float(1 << 52))).cast("bigint")
    n = F.shiftright(scaled * 1000 + F.lit(1 << 51), 52)
    text = (whole + F.floor(n / 1000)).cast("bigint").cast("string")
    return F.concat(text, F.lit("."), F.lpad((n % 1000).cast("string"), 3, "0"))


def _planned(core_start: Column, core_end: Column, duration: Column) -> list[Column]:
    return [
        core_start.alias("core_start"), core_end.alias("core_end"),
        F.greatest(F.lit(0.0), core_start - BUFFER_MS).alias("start"),
        F.least(duration, core_end + BUFFER_MS).alias("end"),
    ]


def plan_chunks(media: DataFrame, silences: DataFrame) -> DataFrame:
    """media(media_id, duration_ms), silences(media_id, pos, start_ms, end_ms) to a chunk plan.

    A cut every 300 s moved to the nearest silence. Cuts stay at least 270 s apart, so each one
    is later than the one before and no running check is needed.
    """
    good = media.where(
        F.col("duration_ms").isNotNull() & (F.col("duration_ms") > 0)
        & (F.col("duration_ms") < F.lit(float("inf")))
    )
    step = F.lit(CORE_MS).cast("bigint")
    targets = good.where(F.col("duration_ms") > CORE_MS).select(
        "media_id", "duration_ms",
        F.explode(F.sequence(step, F.ceil("duration_ms") - 1, step)).alias("target_ms"),
    )
    cuts = nearest_silence(targets, silences).where(F.col("cut_ms") < F.col("duration_ms"))
    starts = cuts.select("media_id", "duration_ms", F.col("cut_ms").alias("at")).unionByName(
        good.select("media_id", "duration_ms", F.lit(0.0).alias("at"))
    )
    seen = ordered_scan(
        starts, ["media_id"], ["at"], time_block("at", CHUNK_BLOCK_MS),
        [Scan("idx", "position"), Scan("__next", "lead", F.col("at"))],
    )
    total = F.col("duration_ms").cast("double")
    until = F.coalesce("__next", total)
    return seen.select(
        "media_id",
        F.concat(F.lit("chunk-"), _fixed(F.col("at")), F.lit("-"), _fixed(until)).alias("id"),
        "idx", *_planned(F.col("at"), until, total), "duration_ms",
    )


def split_oversized(plan: DataFrame) -> DataFrame:
    """Replace chunks above the size limit by equal sub-cores. plan carries size_bytes; a core of
    10 s or less stays and is flagged. Repeat with new sizes until nothing is oversized."""
    length = F.col("core_end") - F.col("core_start")
    over = F.coalesce(F.col("size_bytes") > MAX_BYTES, F.lit(False))
    stuck = over & (length <= MIN_CORE_MS)
    parts = F.when(over & ~stuck, F.greatest(F.lit(2), F.ceil(F.col("size_bytes") / MAX_BYTES))).otherwise(1)
    base = plan.withColumns({"__n": parts.cast("int"), "__stuck": stuck, "__len": length})
    each = base.withColumn("__k", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    n, k = F.col("__n"), F.col("__k")
    low = F.col("core_start") + F.col("__len") * k / n
    high = F.when(k + 1 == n, F.col("core_end")).otherwise(F.col("core_start") + F.col("__len") * (k + 1) / n)
    split = n > 1
    total = F.col("duration_ms").cast("double")
    return each.select(
        "media_id",
        F.when(split, F.concat("id", F.lit("."), (k + 1).cast("string"))).otherwise(F.col("id")).alias("id"),
        F.col("idx").alias("was_idx"), F.col("__k").alias("part"),
        *[c for c in _planned(low, high, total)],
        "duration_ms",
        F.when(split, F.lit(None)).otherwise(F.col("size_bytes")).alias("size_bytes"),
        F.col("__stuck").alias("cannot_split"),
    )


def reindex_plan(split: DataFrame) -> DataFrame:
    """Contiguous chunk index after splitting."""
    out = ordered_scan(
        split, ["media_id"], ["was_idx", "part"], row_block("was_idx"), [Scan("idx", "position")]
    )
    return out.drop("was_idx", "part")


def request_checks() -> dict[str, Column]:
    """Checks of a chunk request row (seconds in start, core_start, core_end, end)."""
    c = F.col
    return {
        "id": c("id").isNotNull() & (F.length("id") <= 128),
        "index": within(c("idx"), 0, 10_000),
        "offsets": (c("start") >= 0) & (c("start") <= c("core_start")) & (c("core_start") < c("core_end"))
        & (c("core_end") <= c("end")),
        "end": within(c("end"), 0, 86_400),
        "length": c("end") - c("start") <= 900,
        "language": one_of(c("language"), UPLOAD_LANGUAGES),
        "content_mode": one_of(c("content_mode"), CONTENT_MODES),
        "keywords": (F.size("keywords") <= 80)
        & F.forall(
            "keywords",
            lambda k: (F.length(k) <= 80) & (F.trim(k) != "") & ~F.regexp_like(k, F.lit("[\\x00-\\x1f]")),
        ),
        "prompt": F.length("prompt") <= 1200,
        "context": F.length("context") <= 400,
    }


# -- merging -----------------------------------------------------------------------------

_SURE = StructType([StructField("end", IntegerType()), StructField("rank", IntegerType())])
_LEFT = StructType([StructField("key", StringType()), StructField("words", IntegerType()), StructField("near", ArrayType(IntegerType()))])
_RIGHT = StructType([StructField("end", IntegerType()), StructField("key", StringType())])
_SIDES = StructType([
    StructField("sure", _SURE), StructField("left", ArrayType(_LEFT)), StructField("right", ArrayType(_RIGHT)),
])
PREFIX_RANK = 1_000_000


def normalized(text: str) -> str:
    return "".join(filter(str.isalnum, unicodedata.normalize("NFKC", text).lower()))


def with_aliases(norm: str) -> str:
    for name, same in ALIASES.items():
        norm = norm.replace(name, same)
    return norm


def comparison_key(text: str) -> str:
    return with_aliases(normalized(text))


def normalized_runs(text: str, cuts: list[int], suffixes: bool) -> list[str]:
    """`normalized` of every suffix from a cut, or of every prefix to one. Cuts lie beside a white space
    or a sentence mark, where folding never joins characters, so pieces are folded once and put together.
    Only the lower case of a capital sigma looks beyond such a mark."""
    if "\u03a3" in unicodedata.normalize("NFKC", text):
        return [normalized(text[c:] if suffixes else text[:c]) for c in cuts]
    out, held, last = [], "", len(text) if suffixes else 0
    for c in reversed(cuts) if suffixes else cuts:
        held = normalized(text[c:last]) + held if suffixes else held + normalized(text[last:c])
        last = c
        out.append(held)
    return out[::-1] if suffixes else out


@F.pandas_udf(StringType())
def comparison_keys(text: pd.Series) -> pd.Series:
    return text.map(comparison_key, na_action="ignore")


def may_match(a: str, b: str, grams: dict[str, Counter]) -> bool:
    """False only where the keys are provably too far apart: an edit spoils at most three of the
    trigrams two texts share, so near texts keep many in common."""
    longest = max(len(a), len(b))
    edits = int((1 - POSSIBLE) * longest + 1e-9)
    if abs(len(a) - len(b)) > edits:
        return False
    needed = longest - 2 - 3 * edits
    if needed <= 0:
        return True
    for k in (a, b):
        if k not in grams:
            grams[k] = Counter(zip(k, k[1:], k[2:]))
    return (grams[a] & grams[b]).total() >= needed


def anchored(a: str, b: str) -> bool:
    return a[-ANCHOR:] == b[-ANCHOR:] and (a[:ANCHOR] == b[:ANCHOR] or a[ANCHOR : 2 * ANCHOR] == b[ANCHOR : 2 * ANCHOR])


@F.pandas_udf(_SIDES)
def boundary_sides(tail: pd.Series, head: pd.Series, chars: pd.Series, words: pd.Series) -> pd.DataFrame:
    """The longest overlap that is equal (`sure`), and the keys of word-aligned suffixes of the previous text
    and prefixes of the next one that are still to be compared: after an equal overlap only anchored pairs
    that would remove as much or more, as no other can win. Unicode compatibility folding is not built into
    Spark, hence Python; the comparison is not."""
    import regex

    word = regex.compile(r"[^\s.!?。！？]+[.!?。！？]*")
    out = []
    for t, h, c, w in zip(tail, head, chars, words):
        lefts = [m.start() for m in word.finditer(t)][-w:]
        lefts = [s for s in lefts if len(t) - s <= c]
        rights = [e for e in [m.end() for m in word.finditer(h)][:w] if e <= c]
        left = normalized_runs(t, lefts, True)[::-1]
        right = normalized_runs(h, rights, False)
        # i + 1 words; the other side may have two fewer or more
        pairs = [
            (i, j) for i, a in enumerate(left) if len(a) >= MIN_CHARS
            for j in range(max(0, i - 2), min(len(right), i + 3)) if len(right[j]) >= MIN_CHARS
        ]
        suffix = normalized(t[-c:])
        equal = [(rights[j], i + 1) for i, j in pairs if left[i] == right[j]]
        equal += [(e, PREFIX_RANK) for e, b in zip(rights, right) if len(b) >= MIN_CHARS and suffix.endswith(b)]
        sure = max(equal, default=None)
        left_keys, right_keys = [with_aliases(a) for a in left], [with_aliases(b) for b in right]
        grams: dict[str, Counter] = {}
        near: dict[int, list[int]] = {}
        for i, j in pairs:
            a, b = left_keys[i], right_keys[j]
            if left[i] == right[j] or sure is not None and (rights[j] < sure[0] or not anchored(a, b)):
                continue
            if may_match(a, b, grams):
                near.setdefault(i, []).append(j)
        out.append((
            sure, [(left_keys[i], i + 1, js) for i, js in near.items()], list(zip(rights, right_keys)) if near else [],
        ))
    as_rows = lambda names, rows: [dict(zip(names, r)) for r in rows]
    return pd.DataFrame({
        "sure": [s and dict(zip(("end", "rank"), s)) for s, _, _ in out],
        "left": [as_rows(("key", "words", "near"), x) for _, x, _ in out],
        "right": [as_rows(("end", "key"), x) for _, _, x in out],
    })


def similarity(a: Column, b: Column) -> Column:
    """1 - Levenshtein / longer length on comparison keys; 0 when either is empty."""
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).otherwise(
        1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))
    )


def match_boundaries(checkpoints: DataFrame, content_mode: str = "speech") -> DataFrame:
    """Compare each chunk with the raw text of its predecessor; pairs are independent.

    checkpoints: media_id, id, idx, core_start, core_end, start, end (ms), text. Adds prev_id,
    similarity, removed, method, confidence (null prev_id for the first chunk)."""
    seen = ordered_scan(
        checkpoints, ["media_id"], ["core_start", "idx"], time_block("core_start", CHUNK_BLOCK_MS),
        [Scan("__p", "lag", F.struct("id", "end", "core_end", "text"))],
        spread=True,
    )
    shared = (F.col("__p.end") - F.col("start")) / 1000
    usable = (
        F.col("__p").isNotNull() & (shared > 0)
        & (F.abs(F.col("__p.core_end") - F.col("core_start")) <= 50) & F.lit(content_mode != "lyrics")
    )
    chars = F.ceil(shared * CHARS_PER_SEC).cast("int")
    ready = seen.withColumns({
        "__use": usable,
        "__chars": F.when(usable, chars).otherwise(0),
        "__words": F.when(usable, F.least(F.lit(MAX_WORDS), F.ceil(shared * WORDS_PER_SEC))).otherwise(1).cast("int"),
    })
    ready = ready.withColumns({
        "__tail": F.when(F.col("__use"), F.expr("right(__p.text, __chars + 1)")).otherwise(""),
        "__head": F.when(F.col("__use"), F.expr("left(text, __chars + 1)")).otherwise(""),
    })
    ready = ready.withColumn("__s", boundary_sides("__tail", "__head", "__chars", "__words"))

    kind = "struct<sim: double, end: int, rank: int, right: int, exact: boolean, high: boolean>"

    def entry(sim, end, rank, right, exact, high) -> Column:
        return F.struct(
            sim.cast("double").alias("sim"), end.cast("int").alias("end"), rank.cast("int").alias("rank"),
            right.cast("int").alias("right"), exact.alias("exact"), high.alias("high"),
        )

    sure = F.when(F.col("__s.sure").isNotNull(), F.array(
        entry(F.lit(1.0), F.col("__s.sure.end"), F.col("__s.sure.rank"), F.lit(0), F.lit(True), F.lit(True))
    )).otherwise(F.array())

    def of_left(a: Column) -> Column:
        def one(j: Column) -> Column:
            b = F.get(F.col("__s.right"), j)
            longest = F.greatest(F.length(a["key"]), F.length(b["key"]))
            # Beyond this distance the pair is below the threshold: the search stops there.
            bound = F.floor((1 - POSSIBLE) * longest + 1e-9).cast("int")
            apart = F.call_function("levenshtein", a["key"], b["key"], bound)
            sim = F.when(apart < 0, 0.0).otherwise(1 - apart / longest)
            n = F.lit(ANCHOR)
            first = F.left(a["key"], n) == F.left(b["key"], n)
            second = F.substring(a["key"], ANCHOR + 1, ANCHOR) == F.substring(b["key"], ANCHOR + 1, ANCHOR)
            anchors = (F.right(a["key"], n) == F.right(b["key"], n)) & (first | second)
            return entry(sim, b["end"], a["words"], j + 1, F.lit(False), (sim >= AUTO) & anchors)

        return F.filter(F.transform(a["near"], one), lambda x: x["sim"] >= POSSIBLE)

    ready = ready.withColumn(
        "__c", F.concat(sure.cast(f"array<{kind}>"), F.flatten(F.transform(F.col("__s.left"), of_left)).cast(f"array<{kind}>"))
    )
    high = F.array_max(
        F.transform(
            F.filter("__c", lambda x: x["high"]),
            lambda x: F.struct(x["end"].alias("end"), x["rank"].alias("rank"), x["sim"].alias("sim"), x["exact"].alias("exact")),
        )
    )
    maybe = F.array_max(
        F.transform(
            F.filter("__c", lambda x: ~x["high"]),
            lambda x: F.struct(x["sim"].alias("sim"), x["rank"].alias("rank"), (-x["right"]).alias("right")),
        )
    )
    done = ready.withColumns({"__high": high, "__maybe": maybe})
    is_high, is_maybe = F.col("__high").isNotNull(), F.col("__maybe").isNotNull()
    return done.select(
        *checkpoints.columns, F.col("__p.id").alias("prev_id"),
        F.when(is_high, F.col("__high.sim")).when(is_maybe, F.col("__maybe.sim")).otherwise(0.0).alias("similarity"),
        F.when(is_high, F.col("__high.end")).otherwise(0).cast("bigint").alias("removed"),
        F.when(is_high, F.when(F.col("__high.exact"), "normalized-exact").otherwise("fuzzy-anchored"))
        .when(is_maybe, "ambiguous-kept").otherwise("none").alias("method"),
        F.when(is_high, "high").when(is_maybe, "possible").otherwise("none").alias("confidence"),
    )


def merge_chunks(checkpoints: DataFrame, content_mode: str = "speech") -> tuple[DataFrame, DataFrame]:
    """(segments, audit): texts without the removed overlap at core times, and one audit row per
    neighbouring pair. Raw checkpoints are never changed."""
    if content_mode == "lyrics":
        return _merge_unmatched(checkpoints)
    # Both results and the numbering below read the matches: compare once.
    matched = stage_table(match_boundaries(checkpoints, content_mode), "matched")
    audit = matched.where(F.col("prev_id").isNotNull()).select(
        "media_id", F.col("prev_id").alias("previous_id"), F.col("id").alias("next_id"),
        "similarity", "removed", "method", "confidence",
    )
    kept = T.trim(F.expr("substring(text, int(removed) + 1, length(text))"))
    rows = matched.withColumn("text", kept).where(F.col("text") != "")
    out = ordered_scan(
        rows, ["media_id"], ["core_start", "idx"], time_block("core_start", CHUNK_BLOCK_MS), [Scan("seq", "position")]
    )
    return _core_segments(out), audit


def _core_segments(rows: DataFrame) -> DataFrame:
    return rows.select(
        "media_id", F.col("seq").cast("bigint").alias("seq"), F.col("core_start").alias("start_ms"),
        (F.col("core_end") - F.col("core_start")).alias("dur_ms"), "text",
        F.lit(None).cast("string").alias("speaker"),
    )


def _merge_unmatched(checkpoints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """merge_chunks where a repeat is part of what is said: nothing is compared, so one scan names the
    neighbours and numbers the texts, which are shuffled once."""
    said = checkpoints.select("media_id", "id", "idx", "core_start", "core_end", T.trim(F.col("text")).alias("text"))
    said = said.withColumn("says", F.col("text") != "")  # known without the texts where only numbers are read
    seen = ordered_scan(
        said, ["media_id"], ["core_start", "idx"], time_block("core_start", CHUNK_BLOCK_MS),
        [Scan("prev_id", "lag", F.col("id")), Scan("nth", "sum", F.when(F.col("says"), 1).otherwise(0).cast("bigint"))],
    )
    audit = seen.where(F.col("prev_id").isNotNull()).select(
        "media_id", F.col("prev_id").alias("previous_id"), F.col("id").alias("next_id"), F.lit(0.0).alias("similarity"),
        F.lit(0).cast("bigint").alias("removed"), F.lit("none").alias("method"), F.lit("none").alias("confidence"),
    )
    return _core_segments(seen.where("says").withColumn("seq", F.col("nth") - 1)), audit


def merged_text(segments: DataFrame) -> DataFrame:
    """Merged text as document chunks: segments joined by a blank line, in order."""
    gap = F.when(F.col("seq") > 0, "\n\n").otherwise("")
    return segments.select("media_id", F.col("seq").alias("ord"), F.concat(gap, "text").alias("chunk"))
