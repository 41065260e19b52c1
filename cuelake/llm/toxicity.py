"""Toxicity by a weighted lexicon that is learnt from labels.

Texts are folded first: compatibility forms, lower case, invisible characters out, letters of other
scripts that look like Latin ones, and digits and signs that stand for letters inside words. The
lexicon holds folded words and word beginnings with log-odds weights; it is matched in one pass per
text by an Aho-Corasick automaton. Hits inside an exception phrase do not count. The summed weight
is divided by the root of the length and squashed so that the boundary found on the labels scores
`CUT`.

Learning uses a sample of labelled rows, at most about `max_rows` (a bound on the cost, documented
parameter); rows that `held_out` marks are never learnt from. A term enters when the number of
distinct contexts it has in toxic texts is improbable under the toxic share of all tokens, with the
number of terms tried taken into account. Contexts instead of occurrences, because copies of one text
would otherwise make its rare words look toxic. The model is as large as the sample allows at most.

Edge cases. Null or empty text: score 0. Null label: not learnt from. Several labels of an id: the
highest. No toxic label: empty lexicon, all scores 0. Null or repeated ids: each row is scored by
itself. Other columns are ignored by `score` and kept by `keep_civil`."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import held_out, stage_table, text_batches

CUT = 0.3
STEMS = (3, 4, 5, 6)
# Least share of a term's uses that lie in toxic texts. A beginning stands for words not seen, so it needs more.
PURITY_WORD, PURITY_STEM = 0.6, 0.97

# Letters that look like a Latin letter (Cyrillic, Greek, small capitals, dotless i).
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o",
    "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x", "ѐ": "e", "ё": "e", "ї": "i",
    "α": "a", "β": "b", "γ": "y", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ո": "n", "ս": "u", "օ": "o",
}
# What stands for a letter inside a word. i, l, 1, ! and | are one letter after folding.
STAND_INS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i"}
# Invisible characters.
INVISIBLE = "­​‌‍⁠﻿"

_LETTERS = str.maketrans({**LOOKALIKES, "l": "i", **{c: None for c in INVISIBLE}})
_STAND_INS = str.maketrans(STAND_INS)
_IN_WORD = re.compile(r"[013457@$!|8]+(?=[^\W\d_])")
_GAPS = re.compile(r"[\W_]+")


def fold(text: str) -> str:
    """Folded words, each with one space before and after it."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = text.lower().translate(_LETTERS)
    text = _IN_WORD.sub(lambda m: m.group().translate(_STAND_INS), text)
    return f" {_GAPS.sub(' ', text).strip()} "


def terms_of(word: str) -> list[str]:
    """Lexicon entries that a word stands for: itself (` word `) and its beginnings (` wor`)."""
    return [f" {word} ", *[f" {word[:n]}" for n in STEMS if len(word) > n]]


@dataclass
class Model:
    """weights: entry to weight; exceptions: folded phrases; boundary: density that scores CUT."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    boundary: float = 1.0
    _automaton: object = None

    def automaton(self):
        if self._automaton is None:
            made = ahocorasick.Automaton()
            for term, w in self.weights.items():
                made.add_word(term, (len(term.strip()), len(term) - 1, w))
            for phrase in self.exceptions:
                made.add_word(phrase, (-1, len(phrase) - 1, 0.0))
            made.make_automaton()
            self._automaton = made
        return self._automaton

    def __getstate__(self):
        return {**self.__dict__, "_automaton": None}

    def hits(self, folded: str) -> dict[int, float]:
        """Weight by start of each word that hits, exceptions taken out."""
        if not self.weights:
            return {}
        found: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (kind, back, w) in self.automaton().iter(folded):
            start = end - back
            if kind < 0:
                spared.append((start, end))
            else:
                found[start] = max(w, found.get(start, 0.0))
        for a, b in spared:
            for k in [k for k in found if a <= k < b]:
                del found[k]
        return found

    def density(self, text: str | None) -> float:
        if not text:
            return 0.0
        folded = fold(text)
        weight = sum(self.hits(folded).values())
        return weight / math.sqrt(folded.count(" ") + 20.0) if weight else 0.0

    def score(self, text: str | None) -> float:
        x = self.density(text)
        return x / (x + self.boundary * (1 - CUT) / CUT)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """(text, y) of at most about `max_rows` labelled rows that may be learnt from, by hash of the id."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("_y_id")).agg(F.max(label).cast("int").alias("y"))
    share = min(1.0, max_rows / max(1, known.count()))
    some = known.where(F.pmod(F.xxhash64("_y_id", F.lit(17)), F.lit(1_000_000)) < int(share * 1_000_000))
    # proven bound: max_rows rows of two numbers
    return stage_table(
        text_batches(docs).select("doc_id", "text").join(F.broadcast(some), F.col("doc_id").cast("long") == F.col("_y_id")).select("text", "y"),
        f"sample_{label}",
    )


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = 20_000) -> Model:
    sample = labelled_sample(docs, labels, label, max_rows)

    def contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen = set()
            for text in batch["text"]:
                words = fold(text or "").split()
                for before, word, after in zip(["", *words], words, [*words[1:], ""]):
                    around = f"{before} {after}"
                    seen.update((t, around) for t in terms_of(word))
            yield pd.DataFrame(list(seen), columns=["term", "around"])

    toxic = sample.where("y > 0").repartition(8, F.xxhash64("text")).mapInPandas(contexts, "term string, around string")
    counted = toxic.groupBy("term").agg(F.count_distinct("around").alias("t")).where("t >= 3")
    tried = {r["term"]: r["t"] for r in counted.collect()}  # bounded by the sample

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: dict[str, int] = defaultdict(int)
        for batch in batches:
            for text, y in zip(batch["text"], batch["y"]):
                words = fold(text or "").split()
                n["" if y > 0 else " "] += len(words)
                if y <= 0:
                    for word in words:
                        for t in terms_of(word):
                            if t in tried:
                                n[t] += 1
        yield pd.DataFrame(list(n.items()), columns=["term", "c"])

    clean = {r["term"]: r["c"] for r in sample.mapInPandas(tally, "term string, c long").groupBy("term").agg(F.sum("c").alias("c")).collect()}
    all_toxic, all_clean = clean.pop("", 0), clean.pop(" ", 0)
    if not all_toxic:
        return Model()
    q = all_toxic / max(1, all_toxic + all_clean)
    least = math.log(max(2, len(tried)))
    weights = {}
    for term, t in tried.items():
        c = clean.get(term, 0)
        n = t + c
        if t / n <= max(PURITY_WORD if term[-1] == " " else PURITY_STEM, q):
            continue
        gain = t * math.log(t / (n * q)) + (c * math.log(c / (n * (1 - q))) if c and q < 1 else 0.0)
        if gain >= least:
            weights[term] = min(8.0, math.log((t + 0.5) / (all_toxic + 1)) - math.log((c + 0.5) / (all_clean + 1)))
    model = Model({t: w for t, w in sorted(weights.items()) if w > 0})
    model.exceptions = find_exceptions(sample, model, q)
    model.boundary = find_boundary(sample, model)
    return model


def find_exceptions(sample: DataFrame, model: Model, q: float) -> list[str]:
    """Two-word phrases around a hit that occur in three clean texts at least and in toxic texts
    less often than chance: the word is meant otherwise there."""

    def phrases(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, y in zip(batch["text"], batch["y"]):
                folded = fold(text or "")
                own = set()
                for start in model.hits(folded):
                    end = folded.find(" ", start + 1)
                    before = folded.rfind(" ", 0, start) if start else -1
                    after = folded.find(" ", end + 1)
                    if before >= 0:
                        own.add(folded[before : end + 1])
                    if after >= 0:
                        own.add(folded[start : after + 1])
                rows += [(p, int(y > 0)) for p in own]
            yield pd.DataFrame(rows, columns=["phrase", "y"])

    counted = sample.mapInPandas(phrases, "phrase string, y int").groupBy("phrase").agg(F.count("*").alias("n"), F.sum("y").alias("t"))
    return [r["phrase"] for r in counted.where((F.col("n") - F.col("t") >= 3) & (F.col("t") <= F.col("n") * q)).orderBy("phrase").collect()]


def find_boundary(sample: DataFrame, model: Model) -> float:
    """Density that tells the labels apart best (share of toxic texts above less share of clean texts
    above), in the middle of the range where that is so, on a logarithmic scale."""
    density = F.pandas_udf(lambda texts: texts.map(model.density), "double")
    steps = 16
    bins = F.when(F.col("x") > 0, F.floor(F.log2("x") * steps)).otherwise(F.lit(-20 * steps)).cast("int")
    found = sample.select((F.col("y") > 0).alias("y"), density("text").alias("x")).groupBy("y", bins.alias("bin")).count().collect()
    count = {(r["y"], r["bin"]): r["count"] for r in found}  # a few hundred bins at most
    all_by = {y: max(1, sum(n for (z, _), n in count.items() if z == y)) for y in (True, False)}
    edges = range(-8 * steps, 8 * steps)
    gain = [sum((1 if y else -1) * n / all_by[y] for (y, b), n in count.items() if b >= e) for e in edges]
    best = [e for e, g in zip(edges, gain) if g >= max(gain) - 1e-9]
    return 2.0 ** ((best[0] + best[-1]) / 2 / steps)


def score_column(model: Model):
    return F.pandas_udf(lambda texts: pd.Series(np.fromiter(map(model.score, texts), float, len(texts))), "double")(F.col("text"))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs (doc_id, text) to doc_id, held_out, score and predicted."""
    scored = text_batches(docs).select("doc_id", score_column(model).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def keep_civil(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of `docs` that score under CUT, with their own columns only."""
    return text_batches(docs).where(score_column(model) < CUT)
