"""Chat formatting by relational means: Spark expressions only.

A conversation's turns are collected as structs and sorted; an array aggregation merges neighbours of
one role; their pieces are concatenated. A run of one role becomes

    <|im_start|>role\\ntext<|im_sep|>text...<|im_end|>\\n

so the turns that were merged can be told apart again. Control strings begin with `<|`; inside texts
and roles every `<`, any number of backslashes and `|` get one more backslash, which is undone when
read back. Line feeds of roles are written as `<|nl|>`. The loss mask holds the spans (start, end in
code points) of assistant texts, without the control strings between them.

Jobs. Turns are grouped by conversation in one shuffle. A conversation of more than `part_chars`
characters is numbered by ranges of (conversation, turn) first and written in parts of about that
size, which follow one another without a break: joined they are what one part would hold. Its parts
know the roles before and behind them, so no task holds a whole one.

`read_back` parses a part into its turns with Spark expressions. The digests of a conversation in one
part are Spark expressions too; a longer one's turns pass a running digest in order, a batch at a time.

Edge cases. Null text or role: empty. Null turn: before the others. Turns of equal number: by role,
then text. Null conversation: a conversation of its own. Repeated rows: each is a turn. Empty table:
empty result. Other columns are ignored."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import stage_table, text_batches
from cuelake.operators.ordered import Scan, ordered_scan

# Fixed values of the template.
START, SEP, END, LINE, FEED = "<|im_start|>", "<|im_sep|>", "<|im_end|>", "\n", "<|nl|>"
ASSISTANT = "assistant"

PART_CHARS = 1_000_000
TURN_CHARS = 256  # what a turn counts besides its text, so that parts of tiny turns stay small


def escape(text: Column) -> Column:
    """No control string is left in the text; `unescape` gives it back."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _literal(text: str) -> str:
    return text.replace("|", r"\|")


def merge_turns(turns: Column) -> Column:
    """Array of (role, text) to array of (role, texts): neighbours of one role are one."""
    none = F.array().cast("array<struct<role:string,texts:array<string>>>")

    def add(done: Column, turn: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        same = last["role"].eqNullSafe(turn["role"])
        texts = F.when(same, F.concat(last["texts"], F.array(turn["text"]))).otherwise(F.array(turn["text"]))
        before = F.when(same, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(done)
        return F.concat(before, F.array(F.struct(turn["role"].alias("role"), texts.alias("texts"))))

    return F.aggregate(turns, none, add)


def _pieces(blocks: Column, before_role: Column, after_role: Column) -> Column:
    """One struct (before, text, after, on) per turn; concatenated they are the formatted text."""

    def block(b: Column, i: Column) -> Column:
        opened = F.concat(F.lit(START), F.replace(escape(b["role"]), F.lit(LINE), F.lit(FEED)), F.lit(LINE))
        head = F.when((i == 0) & before_role.eqNullSafe(b["role"]), F.lit(SEP)).otherwise(opened)
        goes_on = (i == F.size(blocks) - 1) & after_role.eqNullSafe(b["role"])
        tail = F.when(goes_on, F.lit("")).otherwise(F.lit(END + LINE))
        return F.transform(
            b["texts"],
            lambda t, j: F.struct(
                F.when(j == 0, head).otherwise(F.lit(SEP)).alias("before"),
                escape(t).alias("text"),
                F.when(j == F.size(b["texts"]) - 1, tail).otherwise(F.lit("")).alias("after"),
                (b["role"] == ASSISTANT).alias("on"),
            ),
        )

    return F.flatten(F.transform(blocks, block))


def _spans(pieces: Column) -> Column:
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def add(done: Column, p: Column) -> Column:
        first = done["at"] + F.length(p["before"])
        end = first + F.length(p["text"])
        span = F.array(F.struct(first.alias("start"), end.alias("end")))
        return F.struct(
            (end + F.length(p["after"])).alias("at"),
            F.when(p["on"], F.concat(done["spans"], span)).otherwise(done["spans"]).alias("spans"),
        )

    return F.aggregate(pieces, start, add, lambda done: done["spans"])


def _dealt(turns: DataFrame, part_chars: int) -> DataFrame:
    """turns with their part, and the roles before and behind them where a part is cut."""
    none = F.lit(None).cast("string")
    whole = turns.withColumns({"part": F.lit(0).cast("long"), "split": F.lit(False), "prev": none, "next": none})
    weight = (F.length("text") + F.length("role") + TURN_CHARS).cast("long")
    sizes = turns.groupBy("conv_id").agg(F.sum(weight).alias("chars"))
    long_ones = stage_table(sizes.where(F.col("chars") > part_chars).select("conv_id"), "long_conversations")
    if long_ones.isEmpty():
        return whole
    own = long_ones.select(F.col("conv_id").alias("long_id"))
    is_long = F.col("conv_id").eqNullSafe(F.col("long_id"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text"]
    ordered = turns.join(own, is_long, "left_semi").repartitionByRange(*order).sortWithinPartitions(*order)
    rows = stage_table(ordered.withColumn("at", F.monotonically_increasing_id()), "long_turns")
    keyed = rows.withColumns({"no_id": F.col("conv_id").isNull(), "key": F.coalesce("conv_id", F.lit(0))})
    scans = [Scan("chars", "sum_before", weight), Scan("prev", "lag", F.col("role")), Scan("next", "lead", F.col("role"))]
    scanned = ordered_scan(keyed, ["no_id", "key"], ["at"], F.shiftright("at", 33), scans)
    parts = scanned.withColumns({"part": F.floor(F.col("chars") / part_chars).cast("long"), "split": F.lit(True)})
    return whole.join(own, is_long, "left_anti").unionByName(parts.select(*whole.columns))


def format_conversations(turns: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """turns (conv_id, turn, role, text) to one row per part of a conversation: conv_id, part, split
    (whether it may have other parts), n_turns, formatted, spans (array of start and end under the loss
    mask, in code points of the part)."""
    plain = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    turn = F.struct("turn", "role", "text", "prev", "next")
    sorted_turns = _dealt(plain, part_chars).groupBy("conv_id", "part", "split").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    merged = sorted_turns.select(
        "conv_id", "part", "split", F.size("turns").cast("long").alias("n_turns"), merge_turns(F.col("turns")).alias("blocks"),
        F.element_at("turns", 1)["prev"].alias("prev"), F.element_at("turns", -1)["next"].alias("next"),
    )
    pieces = merged.withColumn("pieces", _pieces(F.col("blocks"), F.col("prev"), F.col("next")))
    text = F.array_join(F.transform("pieces", lambda p: F.concat(p["before"], p["text"], p["after"])), "")
    return pieces.select("conv_id", "part", "split", "n_turns", text.alias("formatted"), _spans(F.col("pieces")).alias("spans"))


def read_back(parts: DataFrame) -> DataFrame:
    """The turns that the formatted text of each part holds, from `formatted` and `spans` alone:
    `turns` (array of role and text; a part that goes on in a run has a null role there) and `loss`
    (array of the texts under the mask)."""

    def block(b: Column, i: Column) -> Column:
        body = F.regexp_replace(b, f"{_literal(END)}\\n\\z", "")
        head = F.substring_index(body, LINE, 1)
        role = unescape(F.replace(head, F.lit(FEED), F.lit(LINE)))
        first = i == 0  # what stands before the first opened block goes on in a run
        texts = F.when(first, F.regexp_replace(body, f"\\A{_literal(SEP)}", "")).otherwise(
            F.substring(body, F.length(head) + 2, F.length(body))
        )
        return F.transform(
            F.split(texts, _literal(SEP), -1), lambda t: F.struct(F.when(~first, role).alias("role"), unescape(t).alias("text"))
        )

    blocks = F.split(F.col("formatted"), _literal(START), -1)
    # a part that opens with a block has nothing before it
    turns = F.filter(F.flatten(F.transform(blocks, block)), lambda t: t["role"].isNotNull() | F.col("formatted").startswith(SEP))
    loss = F.transform("spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    return parts.withColumns({"turns": turns, "loss": loss})


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _running_digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Digests of conversations whose turns, loss texts and lengths come in order, one a row."""
    names = [c.split()[0] for c in DIGEST.split(", ")]
    key, role = None, ""

    def frame() -> pd.DataFrame:
        out = pd.DataFrame([(key[0], n, turns.hexdigest(), chars, loss.hexdigest(), formatted)], columns=names)
        out["conv_id"] = pd.array([key[0]], dtype="Int64")
        return out

    for batch in batches:
        for r in batch.itertuples(index=False):
            conv = None if r.conv_id is None else int(r.conv_id)
            if key != (conv,):
                if key is not None:
                    yield frame()
                key, role = (conv,), ""
                n = chars = formatted = 0
                turns, loss = hashlib.sha256(), hashlib.sha256()
            if r.kind == "turn":
                role = role if r.role is None else r.role
                turns.update(f"{role}\n{r.text}\n".encode())
                n += 1
            elif r.kind == "loss":
                loss.update(r.text.encode())
                chars += len(r.text)
            else:
                formatted += int(r.text)
    if key is not None:
        yield frame()


def digests(parts: DataFrame) -> DataFrame:
    """One row per conversation, read back from its formatted parts: conv_id, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars. A digest runs over a conversation from front to back, so
    that of a split one is one stream of rows through one task, which holds a batch of them."""
    read = read_back(parts)
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(LINE), t["text"], F.lit(LINE))), "")
    loss = F.array_join("loss", "")
    single = read.where(~F.col("split")).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(spoken, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )

    def row(kind: str, role: Column, text: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), role.alias("role"), text.alias("text"))

    none = F.lit(None).cast("string")
    rows = F.concat(
        F.transform("turns", lambda t: row("turn", t["role"], t["text"])),
        F.transform("loss", lambda t: row("loss", none, t)),
        F.array(row("length", none, F.length("formatted").cast("string"))),
    )
    several = read.where(F.col("split")).select("conv_id", "part", F.posexplode(rows).alias("pos", "row"))
    ordered = text_batches(several).repartition("conv_id").sortWithinPartitions("conv_id", "part", "pos")
    streamed = ordered.select(F.col("conv_id").cast("string").alias("conv_id"), "row.kind", "row.role", "row.text")
    return single.unionByName(streamed.mapInPandas(_running_digests, DIGEST))
