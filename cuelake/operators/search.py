"""Search and term statistics."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.functions.arrays import posexplode_rows
from cuelake.operators.ordered import Scan, ordered_scan, row_block
from cuelake.session import open_folder, stage_table, staged_path

BLOCK_TERMS = 50_000
BUFFER_CHARS = 16_000_000
GRAM = 3
GRAM_BUCKETS = 64
# tasks that a bucket is dealt to, so that the postings of a very common gram do not meet in one
BUCKET_TASKS = 8


def search_paragraphs(paragraphs: DataFrame, term: str) -> DataFrame:
    """Case-insensitive substring in the text or the speaker."""
    needle = F.lit(term.lower())
    has = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), needle)
    return paragraphs.where(has("text") | has("speaker"))


def history_pieces(jobs: DataFrame, paragraphs: DataFrame, slides: DataFrame | None = None) -> DataFrame:
    """pieces(media_id, start, piece): title, paragraphs and slide texts of a recording, in lower case, as
    one text joined by blanks and cut where a row ends. A piece begins at ``start`` of that text and goes
    two characters into the next ones, so every three characters in a row lie in just one piece whole.
    slides(media_id, ord, text): edits, block texts and cells of a recording in order, ord dense."""
    rows = jobs.select("media_id", F.lit(0).cast("bigint").alias("at"), F.col("title").alias("text")).unionByName(
        paragraphs.select("media_id", (F.col("seq") + 1).alias("at"), "text")
    )
    if slides is not None:
        # behind the last paragraph; a recording without any has an empty body there
        ends = paragraphs.groupBy("media_id").agg((F.max("seq") + 2).alias("__next"))
        placed = jobs.select("media_id").join(ends, "media_id", "left")
        blank = placed.where(F.col("__next").isNull()).select("media_id", F.lit(1).cast("bigint").alias("at"), F.lit("").alias("text"))
        behind = slides.join(placed, "media_id").select("media_id", (F.coalesce("__next", F.lit(2)) + F.col("ord")).alias("at"), "text")
        rows = rows.unionByName(blank).unionByName(behind)
    low = F.concat(F.lower(F.coalesce("text", F.lit(""))), F.lit(" "))
    rows = stage_table(rows.select("media_id", "at", low.alias("low")), "history_rows")
    heads = rows.select("media_id", "at", F.left("low", F.lit(GRAM - 1)).alias("head"), F.length("low").cast("bigint").alias("size"))
    # a row may be one blank, so two characters may come from the next two rows
    near = ordered_scan(heads, ["media_id"], ["at"], row_block("at"), [
        Scan("second", "lead", F.left("head", F.lit(1))), Scan("start", "sum_before", F.col("size"))])
    tail = F.left(F.concat("head", F.coalesce("second", F.lit(""))), F.lit(GRAM - 1))
    tails = ordered_scan(near, ["media_id"], ["at"], row_block("at"), [Scan("tail", "lead", tail)]).select("media_id", "at", "start", "tail")
    return rows.join(tails, ["media_id", "at"]).select("media_id", "start", F.concat("low", F.coalesce("tail", F.lit(""))).alias("piece"))


def _grams(marks: str) -> Column:
    """The grams of a piece in order, from its characters as an array column."""
    c = F.col(marks)
    return F.transform(F.slice(c, F.lit(1), F.greatest(F.size(c) - (GRAM - 1), F.lit(0))), lambda x, i: F.concat(x, F.get(c, i + 1), F.get(c, i + 2)))


def _marks() -> Column:
    return F.regexp_extract_all("piece", F.lit("(?s)."), F.lit(0))


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(GRAM_BUCKETS)).cast("int")


def find_in_pieces(pieces: DataFrame, term: str) -> DataFrame:
    """media_id of the recordings whose text contains the term. A longer term is the same as its grams at
    every third place and at its end, each at its distance from the first: places are counted per
    recording and assumed start, so only pieces that hold such a gram are cut up and no row waits for others."""
    needle = term.lower()
    if len(needle) <= GRAM:
        return pieces.where(F.contains("piece", F.lit(needle))).select("media_id").distinct()
    offsets = sorted({*range(0, len(needle) - GRAM + 1, GRAM), len(needle) - GRAM})
    wanted = sorted({needle[j : j + GRAM] for j in offsets})
    places = F.create_map(*[
        x for g in wanted for x in (F.lit(g), F.array(*[F.lit(j) for j in offsets if needle[j : j + GRAM] == g]))])
    some = F.regexp_like("piece", F.lit("|".join("".join(f"\\x{{{ord(c):x}}}" for c in g) for g in wanted)))
    cut = pieces.where(some).select("media_id", "start", _marks().alias("marks"))
    held = posexplode_rows(cut, ["media_id", "start"], _grams("marks"), "pos", "gram").where(F.col("gram").isin(wanted))
    begins = held.select("media_id", F.col("start") + F.col("pos"), F.explode(places[F.col("gram")])).toDF("media_id", "at", "offset")
    full = begins.groupBy("media_id", (F.col("at") - F.col("offset")).alias("begin")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(offsets))
    return full.select("media_id").distinct()


def search_history(jobs: DataFrame, paragraphs: DataFrame, term: str, slides: DataFrame | None = None) -> DataFrame:
    """Recordings whose title, paragraphs and slide texts, joined by blanks, contain the term, by one
    scan. For many searches of the same recordings build an index."""
    return jobs.select("media_id").join(find_in_pieces(history_pieces(jobs, paragraphs, slides), term), "media_id", "left_semi")


@dataclass(frozen=True)
class HistoryIndex:
    """Grams of recordings by hash bucket, and the pieces they come from."""

    pieces: DataFrame
    postings: DataFrame  # media_id, gram, bucket; a folder per bucket

    def search(self, term: str) -> DataFrame:
        """media_id of the recordings that contain the term. Reads the buckets of the term's grams, keeps
        recordings that hold all of them and looks into the pieces of these only; a term of one gram
        needs no look, a shorter one reads all pieces."""
        needle = term.lower()
        if len(needle) < GRAM:
            return find_in_pieces(self.pieces, needle)
        grams = sorted({needle[j : j + GRAM] for j in range(len(needle) - GRAM + 1)})
        first = self.postings.sparkSession.range(1).select(F.array_sort(F.array_distinct(F.array(*[_bucket(F.lit(g)) for g in grams]))).alias("b")).first()
        near = self.postings.where(F.col("bucket").isin(first["b"]) & F.col("gram").isin(grams))
        held = near.groupBy("media_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(grams)).select("media_id")
        return held if len(needle) == GRAM else find_in_pieces(self.pieces.join(held, "media_id", "left_semi"), needle)


def build_history_index(jobs: DataFrame, paragraphs: DataFrame, slides: DataFrame | None = None, folder: str | None = None) -> HistoryIndex:
    """Write the grams and pieces of all recordings, below ``folder`` or the shared folder."""
    spark = jobs.sparkSession
    folder = folder or staged_path(spark, "history_index")
    history_pieces(jobs, paragraphs, slides).write.parquet(f"{folder}/pieces")
    pieces = spark.read.parquet(f"{folder}/pieces")
    grams = pieces.select("media_id", _marks().alias("marks")).select("media_id", F.explode(F.array_distinct(_grams("marks"))).alias("gram")).distinct()
    dealt = grams.withColumn("bucket", _bucket(F.col("gram"))).withColumn("part", F.pmod(F.xxhash64("media_id"), F.lit(BUCKET_TASKS)))
    dealt.repartition("bucket", "part").drop("part").write.partitionBy("bucket").parquet(f"{folder}/postings")
    return HistoryIndex(pieces, spark.read.schema("media_id bigint, gram string, bucket int").parquet(f"{folder}/postings"))


def term_counts(docs: DataFrame, column: str, terms: DataFrame, block_terms: int = BLOCK_TERMS, buffer_chars: int = BUFFER_CHARS) -> DataFrame:
    """(term, n): literal, case-insensitive, non-overlapping counts over all rows, per trimmed term.

    The terms are dealt into blocks of about ``block_terms`` by hash and written to the shared folder once.
    The corpus is scanned once: a task fills a buffer of about ``buffer_chars`` characters, matches it with
    the automaton of one block after the other, and gives one row per buffer and term met. Terms that
    nothing holds are joined back."""
    trimmed = terms.select(F.trim("term").alias("term")).where("term <> ''").distinct()
    number = trimmed.count()
    if not number:
        return trimmed.select("term", F.lit(0).cast("bigint").alias("n"))
    blocks = -(-number // block_terms)
    dealt = trimmed.select(F.lower("term").alias("low")).distinct().withColumn("blk", F.pmod(F.xxhash64("low"), F.lit(blocks)).cast("int"))
    folder = staged_path(docs.sparkSession, "terms")
    dealt.repartition("blk").write.partitionBy("blk").parquet(folder)
    found = docs.select(F.lower(column).alias("low")).mapInPandas(_counter(folder, blocks, buffer_chars), "low string, n long")
    total = found.groupBy("low").agg(F.sum("n").alias("n"))
    return trimmed.withColumn("low", F.lower("term")).join(total, "low", "left").select("term", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def _block_terms(folder: str, blk: int) -> list[str]:
    """The terms of a block; a block that no term fell into has no folder."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    system, inner = open_folder(f"{folder}/blk={blk}")
    files = system.get_file_info(fs.FileSelector(inner, allow_not_found=True))
    return [w for f in files if f.base_name.endswith(".parquet") for w in pq.read_table(f.path, columns=["low"], filesystem=system, partitioning=None)["low"].to_pylist()]


def _counter(folder: str, blocks: int, buffer_chars: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def automaton(blk: int) -> ahocorasick.Automaton | None:
        machine = ahocorasick.Automaton()
        for w in _block_terms(folder, blk):
            machine.add_word(w, w)
        machine.make_automaton()
        return machine if len(machine) else None

    def matched(machine: ahocorasick.Automaton, texts: list[str]) -> pd.DataFrame:
        totals: dict[str, int] = {}
        for text in texts:
            ends: dict[str, int] = {}
            for last, word in machine.iter(text):
                if last - len(word) >= ends.get(word, -1):  # begins after the last counted one of this term
                    ends[word] = last
                    totals[word] = totals.get(word, 0) + 1
        return pd.DataFrame(list(totals.items()), columns=["low", "n"])

    def buffers(batches: Iterator[pd.DataFrame]) -> Iterator[list[str]]:
        texts, size = [], 0
        for batch in batches:
            for text in batch["low"]:
                if text:
                    texts.append(text)
                    size += len(text)
                    if size >= buffer_chars:
                        yield texts
                        texts, size = [], 0
        if texts:
            yield texts

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, ahocorasick.Automaton | None] = {}  # the last block's
        for texts in buffers(batches):
            for blk in range(blocks):
                if blk not in held:
                    held = {blk: automaton(blk)}
                if held[blk] is not None:
                    yield matched(held[blk], texts)

    return count
