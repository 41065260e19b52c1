"""Landed provider responses: extraction, transcription and summary payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake import schemas
from cuelake.functions import text as T
from cuelake.functions.checks import one_of

# Block types and size limits of an extraction.
STATUSES = ["text", "textless", "unreadable"]
BLOCK_TYPES = [
    "heading", "paragraph", "list", "table", "code", "formula", "chart-label", "footer",
]
MAX_TEXT = 100_000


def extraction_checks(e: Column) -> dict[str, Column]:
    """Named checks of an extraction struct."""
    blocks = F.coalesce(e["blocks"], F.array().cast("array<struct<type: string, text: string, rows: array<array<string>>>>"))
    cells = lambda b: F.coalesce(b["rows"], F.array().cast("array<array<string>>"))
    return {
        "status": one_of(e["status"], STATUSES),
        "block_count": e["blocks"].isNotNull() & (F.size(blocks) <= 500),
        "block_type": F.forall(blocks, lambda b: one_of(b["type"], BLOCK_TYPES)),
        "block_text": F.forall(
            blocks, lambda b: b["text"].isNotNull() & (F.length(b["text"]) <= MAX_TEXT)
        ),
        "rows": F.forall(
            blocks,
            lambda b: (F.size(cells(b)) <= 300)
            & F.forall(
                cells(b),
                lambda r: (F.size(r) <= 100)
                & F.forall(r, lambda c: c.isNotNull() & (F.length(c) <= 10_000)),
            ),
        ),
        "flags": e["flags"].isNotNull() & (F.size(e["flags"]) <= 100)
        & F.forall(e["flags"], lambda f: F.length(f) <= 300),
        "unreadable": e["unreadable"].isNotNull() & (F.size(e["unreadable"]) <= 200)
        & F.forall(e["unreadable"], lambda f: F.length(f) <= 1000),
        "textless_has_blocks": ~((e["status"] == "textless") & (F.size(blocks) > 0)),
        "cells_outside_table": F.forall(
            blocks, lambda b: (b["type"] == "table") | (F.size(cells(b)) == 0)
        ),
        "ragged_table": F.forall(
            blocks,
            lambda b: (b["type"] != "table")
            | F.forall(cells(b), lambda r: F.size(r) == F.size(F.get(cells(b), F.lit(0)))),
        ),
    }


def valid_extraction(e: Column) -> Column:
    out = e.isNotNull()
    for ok in extraction_checks(e).values():
        out = out & F.coalesce(ok, F.lit(False))
    return out


def normalize_usage(u: Column) -> Column:
    """Usage counters; null unless input and output are finite and not negative."""
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (c >= 0) & (c < F.lit(float("inf")))
    detail = lambda c: F.when(fine(c), c).otherwise(F.lit(0.0)).cast("bigint")
    return F.when(
        fine(u["input_tokens"]) & fine(u["output_tokens"]),
        F.struct(
            u["input_tokens"].cast("bigint").alias("input_tokens"),
            u["output_tokens"].cast("bigint").alias("output_tokens"),
            detail(u["input_tokens_details"]["cached_tokens"]).alias("cached_input_tokens"),
            detail(u["input_tokens_details"]["cache_write_tokens"]).alias("cache_write_tokens"),
            detail(u["output_tokens_details"]["reasoning_tokens"]).alias("reasoning_tokens"),
        ),
    )


def read_extraction_responses(responses: DataFrame) -> DataFrame:
    """responses(id, payload) to outcome, billing, usage, extraction and kept partial text."""
    raw = responses.withColumn("__r", F.from_json("payload", schemas.PROVIDER_RESPONSE))
    contents = F.flatten(
        F.transform(
            F.coalesce(
                F.col("__r.output"),
                F.array().cast("array<struct<content: array<struct<type: string, text: string>>>>"),
            ),
            lambda o: F.coalesce(
                o["content"], F.array().cast("array<struct<type: string, text: string>>")
            ),
        )
    )
    said = F.filter(contents, lambda c: (c["type"] == "output_text") & c["text"].isNotNull())
    step = raw.withColumns(
        {
            "__text": F.array_join(F.transform(said, lambda c: c["text"]), ""),
            "__refused": F.exists(contents, lambda c: F.coalesce(c["type"] == "refusal", F.lit(False))),
            "usage": normalize_usage(F.col("__r.usage")),
        }
    ).withColumn("__e", F.from_json("__text", schemas.EXTRACTION))
    outcome = (
        F.when(F.col("__refused"), "refusal")
        .when(~F.coalesce(F.col("__r.status") == "completed", F.lit(False)), "incomplete")
        .when(valid_extraction(F.col("__e")), "completed")
        .otherwise("malformed_response")
    )
    step = step.withColumn("outcome", outcome)
    keeps = F.col("outcome").isin("incomplete", "malformed_response")
    return step.select(
        *[c for c in responses.columns if c != "payload"],
        "outcome",
        F.when(F.col("usage").isNotNull(), "known").otherwise("unknown").alias("billing"),
        "usage",
        F.when(F.col("outcome") == "completed", F.col("__e")).alias("extraction"),
        F.when(keeps, F.left("__text", F.lit(MAX_TEXT))).alias("partial_text"),
    )


def read_transcription_responses(responses: DataFrame) -> DataFrame:
    """responses(id, payload): text, detected languages, timestamp quality, or a problem."""
    v = F.try_parse_json("payload")
    step = responses.withColumn("__v", v)
    text_of = lambda x: F.when(
        F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")
    )
    top = lambda name: text_of(F.try_variant_get("__v", f"$.{name}", "variant"))
    items = F.try_variant_get("__v", "$.languages", "array<variant>")
    codes = F.transform(
        items,
        lambda x: F.coalesce(text_of(x), text_of(F.try_variant_get(x, "$.code", "variant"))),
    )
    listed = F.array_join(
        F.filter(codes, lambda c: F.regexp_like(c, F.lit("^[a-z]{2,3}(?:-[A-Za-z]{2,4})?$"))), ", "
    )
    single = F.when(
        F.regexp_like(top("language"), F.lit("^[a-z]{2,3}$")), top("language")
    )
    text = top("text")
    return step.select(
        *[c for c in responses.columns if c != "payload"],
        text.alias("text"),
        F.when(text.isNotNull(), F.coalesce(F.nullif(listed, F.lit("")), single)).alias("language"),
        F.when(text.isNotNull(), "chunk-estimated").alias("timestamp_quality"),
        F.when(F.col("__v").isNull(), "unreadable").when(text.isNull(), "no_transcript").alias("problem"),
    )


def read_summary_payloads(payloads: DataFrame) -> DataFrame:
    """payloads(id, payload): summary, speakers and turns(i, speaker) from a fenced or bare JSON
    answer, else the plain text with names mined from its lines."""
    fence = F.regexp_extract("payload", "```(?:json)?\\s*([\\s\\S]*?)```", 1)
    fenced = F.regexp_like("payload", F.lit("```(?:json)?\\s*([\\s\\S]*?)```"))
    step = payloads.withColumn(
        "__c", T.trim(F.when(fenced, fence).otherwise(F.col("payload")))
    ).withColumn("__o", F.from_json(F.regexp_extract("__c", "(?s)(\\{.*\\})", 1), schemas.SUMMARY_PAYLOAD))
    summary = T.trim(F.col("__o.summary"))
    good = T.present(summary)
    no_names = F.array().cast("array<string>")
    names = F.filter(
        F.transform(F.coalesce(F.col("__o.speakers"), no_names), T.trim), T.present
    )
    no_turns = F.array().cast("array<struct<i: bigint, speaker: string>>")
    turns = F.filter(
        F.transform(
            F.col("__o.turns"),
            lambda t: F.struct(
                F.when(F.regexp_like(t["i"], F.lit("^[0-9]+(?:\\.0+)?$")), t["i"].try_cast("double"))
                .cast("bigint").alias("i"),
                T.trim(t["speaker"]).alias("speaker"),
            ),
        ),
        lambda t: t["i"].isNotNull() & T.present(t["speaker"]),
    )
    text = F.when(good, summary).otherwise(F.col("__c"))
    return step.select(
        *[c for c in payloads.columns if c != "payload"],
        text.alias("summary"),
        F.when(good & (F.size(names) > 0), names).otherwise(T.speakers_from_summary(text)).alias("speakers"),
        F.when(good, F.coalesce(turns, no_turns)).otherwise(no_turns).alias("turns"),
    )
