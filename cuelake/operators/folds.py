"""Order-dependent folds over cues, run block by block.

A fold compares each cue with text accumulated so far, so no window frame expresses it.
A key is cut into blocks of bounded size and every block is folded in its own task. The
state left open by a block is carried into the next one: all blocks first run with no
carried state, then only the blocks whose carried state changed run again, until no carry
changes. Carries usually settle in the second round because an item closes and the next
starts from its own cue alone; in the worst case rounds follow the blocks one by one, which
is still exact. What the last block of a key leaves open is asked by nobody, so a key of one block
is folded once.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Sequence
from itertools import islice
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from cuelake.operators import cuetext as C
from cuelake.session import cut_lineage, stage_table

# Cues of one key folded by one task.
FOLD_ROWS = 16_384
# Names of blocks that are broadcast: at most.
FEW_BLOCKS = 65_536


class Fold(Protocol):
    """push takes one row and finish flushes; both return finished rows. state is JSON-ready."""

    state: list

    def push(self, row: tuple) -> Iterable[tuple]: ...

    def finish(self) -> Iterable[tuple]: ...


def block_fold(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column,
    columns: Sequence[str],
    make: Callable[[], Fold],
    emits: str,
    prepare: Callable[[DataFrame], DataFrame] = lambda rows: rows,
    start: DataFrame | None = None,
    leave: bool = False,
    stored: bool = False,
) -> DataFrame:
    """Fold ``columns`` of ``df`` in order inside each key. ``emits`` is the DDL of emitted rows;
    ``prepare`` derives columns after the rows have been spread over the tasks. ``start`` (keys,
    state) is what a key's first block goes on from. With ``leave`` keys are not finished: one more row
    per key, whose emitted columns are null, holds what is left open in the column ``state``.

    Where a key has several blocks, rows are read in several rounds, so they are written once more. With
    ``stored`` they come from files already, and only those of blocks with a later one are written."""
    keys, order, columns = list(keys), list(order), list(columns)
    at = [*keys, "__blk"]
    source = df.select(*keys, block.alias("__blk"), *dict.fromkeys([*order, *columns]))
    # Fold work is heavy per byte: an explicit count keeps small inputs spread over the tasks.
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key_ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys).schema)
    width = len(emits.split(", "))
    if leave:
        emits = f"{emits}, state STRING"

    def states(key: tuple, given: str | None, last: bool, fold: Fold) -> list[tuple]:
        return [(*key, given, json.dumps(fold.state, ensure_ascii=False))]

    def ends(key: tuple, given: str | None, last: bool, fold: Fold) -> list[tuple]:
        if not last:
            return []
        if leave:
            return [(*key[:-1], *[None] * width, json.dumps(fold.state, ensure_ascii=False))]
        return [(*key[:-1], *row) for row in fold.finish()]

    def folded(rows: DataFrame, ready: Callable, carry: DataFrame, ddl: str, emitting: bool) -> DataFrame:
        """Rows of a block behind the one that holds its carried state, through one stream per task."""
        schema = to_arrow_schema(StructType.fromDDL(ddl))
        at_end = ends if emitting else states
        more = (None,) if leave else ()

        def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
            key, given, last, fold = (), None, False, None
            for batch in batches:
                out: list[tuple] = []
                is_row = batch.column("__row")
                heads = np.flatnonzero(~is_row.to_numpy(zero_copy_only=False))
                lead = zip(*(batch.column(c).take(pa.array(heads)).to_pylist() for c in [*at, "state_in", "is_last"]))
                rows = zip(*(_plain(batch.column(c).filter(is_row)) for c in columns))
                upto = np.diff(heads, prepend=-1, append=batch.num_rows) - 1
                for i, count in enumerate(upto.tolist()):  # rows before a head, and after the last one
                    if i:
                        if fold is not None:
                            out.extend(at_end(key, given, last, fold))
                        *now, state, is_last = next(lead)
                        key, given, last, fold = tuple(now), state, is_last, make()
                        if given is not None:
                            fold.state = json.loads(given)
                    for row in islice(rows, count):
                        done = fold.push(row)
                        if emitting and done:
                            out.extend((*key[:-1], *d, *more) for d in done)
                yield _batch(out, schema)
            if fold is not None:
                yield _batch(at_end(key, given, last, fold), schema)

        heads = carry.select(*at, F.lit(False).alias("__row"), "state_in", "is_last")
        stacked = rows.withColumn("__row", F.lit(True)).unionByName(heads, allowMissingColumns=True)
        spread = ready(stacked.repartition(tasks, *at))
        return spread.sortWithinPartitions(*at, "__row", *[F.col(c).asc_nulls_last() for c in order]).mapInArrow(run, ddl)

    along = Window.partitionBy(*keys).orderBy("__blk")
    nothing = F.lit(None).cast("string")
    blocks = source.groupBy(*at).agg(F.count(F.lit(1)).alias("n")).select(
        *at,
        F.lead("__blk").over(along).isNull().alias("is_last"),
        F.lag("__blk").over(along).isNull().alias("is_first"),
    )
    if start is None:
        blocks = blocks.withColumn("given", nothing)
    else:
        blocks = blocks.join(start.select(*keys, F.col("state").alias("given")), keys, "left")
    known = cut_lineage(
        blocks.select(
            *at, "is_last", "is_first", "given",
            F.when(F.col("is_first"), F.col("given")).alias("state_in"), nothing.alias("state_out"),
            (~F.col("is_last")).alias("stale"),  # nobody reads what the last block leaves open
        )
    )
    state_ddl = f"{key_ddl}, __blk BIGINT, state_in STRING, state_out STRING"
    again = None
    while waiting := known.where("stale").count():
        stale = known.where("stale").select(*at, "state_in", "is_last")
        if again is None:  # several rounds read the rows again
            asked = source
            if stored:
                names = stale.select(*at)
                asked = source.join(F.broadcast(names) if waiting <= FEW_BLOCKS else names, at, "left_semi")
            again = stage_table(prepare(asked.repartition(tasks, *at)), "fold_rows")
            if not stored:
                source, prepare = again, lambda rows: rows
        fresh = folded(
            again.join(stale.select(*at), at, "left_semi"), lambda rows: rows, stale, state_ddl, False
        ).select(*at, F.col("state_out").alias("fresh_out"))
        merged = known.join(fresh, at, "left").select(
            *at, "is_last", "is_first", "given", "state_in",
            F.coalesce("fresh_out", "state_out").alias("state_out"),
        )
        given = F.when(F.col("is_first"), F.col("given")).otherwise(F.lag("state_out").over(along))
        known = cut_lineage(
            merged.select(
                *at, "is_last", "is_first", "given", given.alias("state_in"), "state_out",
                (~given.eqNullSafe(F.col("state_in")) & ~F.col("is_last")).alias("stale"),
            )
        )
    return folded(source, prepare, known, f"{key_ddl}, {emits}", True)


def _plain(column: pa.Array) -> list:
    """Python values with None for missing ones."""
    if pa.types.is_string(column.type):
        return column.to_numpy(zero_copy_only=False).tolist()
    if not column.null_count and (pa.types.is_integer(column.type) or pa.types.is_floating(column.type)):
        numbers = column.to_numpy()
        if not np.isnan(numbers).any():
            return numbers.tolist()
    values = column.to_pylist()
    return [None if v != v else v for v in values] if pa.types.is_floating(column.type) else values


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """Rows as they were emitted; whole numbers may come as floats."""
    columns = list(zip(*rows)) or [()] * len(schema)
    arrays = [
        pa.array([v if v is None else int(v) for v in c] if pa.types.is_integer(f.type) else c, f.type)
        for c, f in zip(columns, schema)
    ]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


# -- the cue folds -----------------------------------------------------------------------
# A cue or paragraph under construction is [order..., start, dur, text, speaker, mark].


class Collapse:
    """Rolling captions: a cue that repeats the open one extends it. Of an open text that is known to be without
    repeats the key is kept, and of a cue that rolls on from it only the rest is looked at."""

    def __init__(self) -> None:
        self.state: list = []
        self.known: str | None = None
        self.key = ""

    def push(self, row: tuple) -> Iterable[tuple]:
        seq, start, dur, text, speaker = row
        if self.state:
            at, was, length, said, who = self.state
            near = said is self.known and text and start - (was + length) < C.COLLAPSE_MS
            if near and (more := C.rolls_on(said, self.key, text)):
                self.known, self.key = more
                self.state = [at, was, max(length, start + dur - was), self.known, who]
                return ()
        # a cue that is told from the texts as a whole
        plain = C.is_plain(text)
        if not plain:
            text = C.dedupe(text)
            if not text:
                return ()
        if self.state and (said == text or C.collapses(said, text, start - (was + length))):
            if said is self.known:
                C.settle(said)
            now = C.dedupe(C.longer(said, text), said)
            self._know(now)
            self.state = [at, was, max(length, start + dur - was), now, who]
            return ()
        done = self.finish()
        self.state = [seq, start, dur, text, speaker]
        self._know(text, plain)
        return done

    def _know(self, text: str, plain: bool = False) -> None:
        self.known = text if plain or C.can_roll(text) else None
        if self.known is not None:
            self.key = C.key(text)

    def finish(self) -> Iterable[tuple]:
        return [tuple(self.state)] if self.state else []


class Sentences:
    """Cues to sentence-like cues; text that is only a bracketed note is dropped or attached."""

    def __init__(self) -> None:
        self.state: list = []

    def push(self, row: tuple) -> Iterable[tuple]:
        seq, piece, start, dur, text, speaker, mark = row
        text = C.dedupe(text)
        if not text:
            return []
        held = self.state
        if C.is_noise(text):
            if held and len(C.key(held[4])) < 8:
                held[4] = C.join(held[4], text)
            return []
        if held:
            elapsed = start - (held[2] + held[3])
            until = max(400.0, start + dur - held[2])
            if C.collapses(held[4], text, elapsed):
                held[3], held[4] = until, C.dedupe(C.longer(held[4], text), held[4])
                return []
            if held[3] <= 14000 and not C.breaks_sentence(
                held[4], text, elapsed, held[5], speaker, bool(mark)
            ):
                held[3], held[4] = until, C.dedupe(C.join(held[4], text), held[4])
                return []
        done = self.finish()
        self.state = [seq, piece, start, dur, text, speaker, bool(mark)]
        return done

    def finish(self) -> Iterable[tuple]:
        return [tuple(self.state)] if self.state else []


class Paragraphs:
    """Sentence cues to paragraphs. State: order, start, end, closed text, first speaker, any
    mark, and the last cue (start, dur, text, speaker), which later cues may still extend."""

    def __init__(self) -> None:
        self.state: list = []

    def push(self, row: tuple) -> Iterable[tuple]:
        seq, piece, start, dur, text, speaker, mark = row
        held = self.state
        if held:
            _, _, first, end, closed, _, _, last = held
            upto = max(end, start + dur)
            elapsed = start - end
            if C.collapses(last[2], text, elapsed):
                last[2] = C.dedupe(C.longer(last[2], text), last[2])
                last[1] = max(last[1], start + dur - last[0])
                held[3] = upto
                return []
            if not C.breaks_paragraph(
                last[2], elapsed, upto - first, last[3], speaker, bool(mark)
            ):
                held[3] = upto
                held[4] = f"{closed} {last[2]}" if closed else last[2]
                held[5] = held[5] or speaker
                held[6] = held[6] or bool(mark)
                held[7] = [start, dur, text, speaker]
                return []
        done = self.finish()
        self.state = [
            seq, piece, start, start + dur, "", speaker, bool(mark), [start, dur, text, speaker]
        ]
        return done

    def finish(self) -> Iterable[tuple]:
        if not self.state:
            return []
        seq, piece, start, end, closed, speaker, mark, last = self.state
        text = C.dedupe(f"{closed} {last[2]}")
        if not text:
            return []
        return [(seq, piece, start, max(400.0, end - start), text, speaker or None, mark)]


class Contained:
    """Merge a paragraph into the one before when it repeats it."""

    def __init__(self) -> None:
        self.state: list = []

    def push(self, row: tuple) -> Iterable[tuple]:
        text = C.dedupe(row[4])
        if not text:
            return []
        held = self.state
        if held:
            gap = row[2] - (held[2] + held[3])
            same = gap < 1200 and C.key(held[4]) == C.key(text)
            if same or C.collapses(held[4], text, gap):
                held[4] = C.dedupe(C.longer(held[4], text), held[4])
                held[3] = max(held[3], row[2] + row[3] - held[2])
                held[5] = held[5] or row[5]
                return []
        done = self.finish()
        self.state = [*row[:4], text, *row[5:]]
        return done

    def finish(self) -> Iterable[tuple]:
        return [tuple(self.state)] if self.state else []


class Chain:
    """Folds fed by one another in one pass; every stage's rows can be emitted with a tag."""

    def __init__(self, *stages: tuple[str | None, Fold]) -> None:
        self.stages = stages

    @property
    def state(self) -> list:
        return [fold.state for _, fold in self.stages]

    @state.setter
    def state(self, value: list) -> None:
        for (_, fold), part in zip(self.stages, value):
            fold.state = part

    def _feed(self, rows: Iterable[tuple], first: int) -> list[tuple]:
        out: list[tuple] = []
        for at in range(first, len(self.stages)):
            tag, fold = self.stages[at]
            done: list[tuple] = []
            for row in rows:
                done.extend(fold.push(row))
            if tag:
                out.extend((tag, *row) for row in done)
            rows = done
        return out

    def push(self, row: tuple) -> list[tuple]:
        return self._feed([row], 0)

    def finish(self) -> list[tuple]:
        out: list[tuple] = []
        for at, (tag, fold) in enumerate(self.stages):
            done = list(fold.finish())
            if tag:
                out.extend((tag, *row) for row in done)
            out.extend(self._feed(done, at + 1))
        return out


def transcript_chain() -> Chain:
    return Chain(("sentence", Sentences()), (None, Paragraphs()), ("paragraph", Contained()))


def paragraph_chain() -> Chain:
    return Chain((None, Paragraphs()), ("paragraph", Contained()))
