"""Fixtures that the operator tests share."""

from __future__ import annotations

import random

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and to in is was for on with as by at from this that river stone light green quick brown fox jumps over lazy dog".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", "er", "ing", "s"]) for _ in range(n)).capitalize() + "."


def documents(spark, rows):
    """rows of (doc_id, text, lang, source)."""
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows], DOC)


def odd_documents(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows."""
    rng = random.Random(3)
    long_text = prose(rng, 30_000)
    rows = [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t ", None, None), (4, long_text, "en", "a"), (5, prose(rng, 40), None, "b"),
        (9_007_199_254_740_993, prose(rng, 40), "en", None), (None, prose(rng, 30), "en", "a"), (7, "one two", "de", "b"), (7, "one two", "de", "b"),
        (8, "x y　z\x1cw \x85 é", "fr", "b"),
    ]
    return documents(spark, rows)


def with_clashes(df):
    """Extra columns named like the operators' own."""
    from pyspark.sql import functions as F

    names = ["kept", "score", "h", "fp", "size", "pool", "row_key", "component_id", "copies", "node", "bin", "y", "p",
             "times", "limit", "some", "p_source", "source_size", "target", "slot", "shard", "first", "key", "root", "cell",
             "_f_id", "_f_key", "_q_id", "_q_key", "doc", "own_id", "own_key", "own_h", "own_source", "at", "place", "first_id", "first_key"]
    return df.select("*", *[F.lit(k).alias(n) for k, n in enumerate(names)])
