"""What the operators share: staging in the shared folder, word patterns and exact word splitting."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.session import cut_lineage, stage_table

__all__ = ["WORD", "cut_lineage", "first_order", "held_out", "one_row_each", "row_hash", "split_words", "stage_table", "text_batches", "wrapped"]

# A word is a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

TEXT_ROWS = 1000

_WORD = re.compile(WORD)
# what str.split() also takes as white space
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")


def split_words(text: str) -> list[str]:
    """The words of a text; str.split() is used where it agrees with the pattern."""
    if _OTHER_SPACE.search(text) is None:
        return text.split()
    return _WORD.findall(text)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from: crc32 of the id as text leaves 2 modulo 4.
    A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def row_hash(*columns: Column) -> Column:
    """A 64-bit digest that tells rows with equal ids apart; null differs from the empty text."""
    return F.xxhash64(*[part for c in columns for part in (c, c.isNull())])


def first_order() -> Column:
    """What rows (doc_id, key) are ordered by: the id, null last, then the digest of the text."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("key"))


def wrapped(docs: DataFrame) -> DataFrame:
    """`docs` with each row as one struct, `doc`: whatever its columns are called, they meet no others."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))


def one_row_each(docs: DataFrame, rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """One row of `docs` for each row of `chosen` (first, see `first_order`). rows: doc_id and key of
    every row of `docs`; rows equal in both are one."""
    named = chosen.select(F.col("first.doc_id").alias("first_id"), F.col("first.key").alias("first_key"))
    own = wrapped(docs).withColumns({"own_id": F.col("doc.doc_id").cast("long"), "own_key": row_hash(F.col("doc.text"))})
    kept = own.join(named, F.col("own_id").eqNullSafe(F.col("first_id")) & (F.col("own_key") == F.col("first_key")), "left_semi")
    repeated = rows.groupBy("doc_id", "key").agg(F.count("*").alias("n")).where("n > 1")
    if not repeated.isEmpty():
        kept = kept.dropDuplicates(["own_id", "own_key"])
    return kept.select("doc.*")


def text_batches(df: DataFrame) -> DataFrame:
    """`df`, in a session whose Arrow batches hold TEXT_ROWS rows at most: rows that carry whole texts
    are large, and a Python worker and the JVM beside it each hold a batch several times over."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= TEXT_ROWS:
        conf.set(name, str(TEXT_ROWS))
    return df
