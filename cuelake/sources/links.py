"""Video links to canonical ids, as column expressions over a link table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.functions import text as T

# Accepted hosts, id shape and path kinds.
HOSTS = ["youtube.com", "m.youtube.com", "music.youtube.com", "youtube-nocookie.com", "youtu.be"]
HOST_SUFFIX = ".youtube.com"
PATH_KINDS = ["shorts", "live", "embed", "v", "e", "watch"]
ID = "^[a-zA-Z0-9_-]{11}$"
WATCH_URL = "https://www.youtube.com/watch?v="


def is_video_id(c: Column) -> Column:
    return F.coalesce(F.regexp_like(c, F.lit(ID)), F.lit(False))


def _leading_id(c: Column) -> Column:
    token = F.regexp_replace(c, "(?s)[^a-zA-Z0-9_-].*$", "")
    return F.when(is_video_id(token), token)


def _parts(url: Column) -> dict[str, Column]:
    full = F.when(F.contains(url, F.lit("://")), url).otherwise(F.concat(F.lit("https://"), url))
    shape = "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)(?::[0-9]+)?([^?#]*)(?:\\?([^#]*))?"
    host = F.lower(F.regexp_extract(full, shape, 1))
    return {
        "host": F.regexp_replace(host, "^www\\.", ""),
        "steps": F.filter(F.split(F.regexp_extract(full, shape, 2), "/"), lambda s: s != ""),
        "query": F.regexp_extract(full, shape, 3),
    }


def _parameter(query: Column, name: str) -> Column:
    raw = F.regexp_extract(query, f"(?:^|&){name}=([^&]*)", 1)
    return F.nullif(F.try_url_decode(raw), F.lit(""))


def _allowed(host: Column) -> Column:
    return host.isin(HOSTS) | F.endswith(host, F.lit(HOST_SUFFIX))


def _resolve(links: DataFrame, link: str, out: str) -> DataFrame:
    """Add ``out``_id and ``out``_bad from a link column, leaving out a nested link parameter.
    Steps are separate columns, which keeps each generated expression small."""
    p = _parts(F.col(link))
    step = links.withColumns(
        {"__host": p["host"], "__steps": p["steps"], f"{out}_query": p["query"]}
    ).withColumns(
        {
            "__v": _parameter(F.col(f"{out}_query"), "v"),
            "__first": F.get("__steps", F.lit(0)),
            "__second": _leading_id(F.get("__steps", F.lit(1))),
            f"{out}_allowed": _allowed(F.col("__host")),
        }
    )
    host, v = F.col("__host"), F.col("__v")
    kind = F.lower("__first").isin(PATH_KINDS)
    step = step.withColumn(
        f"{out}_id",
        F.when(F.col(link) == "", F.lit(None).cast("string"))
        .when(is_video_id(F.col(link)), F.col(link))
        .when(~F.col(f"{out}_allowed"), F.lit(None))
        .when(host == "youtu.be", _leading_id(F.col("__first")))
        .when(v.isNotNull(), _leading_id(v))
        .when(kind, F.col("__second")),
    ).withColumn(
        f"{out}_bad",
        F.when(F.col(f"{out}_id").isNotNull(), F.lit(None).cast("string"))
        .when(F.col(link) == "", "blank")
        .when(F.col(f"{out}_allowed") & (host != "youtu.be") & v.isNotNull(), "bad_id")
        .otherwise("not_a_video_link"),
    )
    return step.drop("__host", "__steps", "__v", "__first", "__second")


def canonicalize_links(links: DataFrame, column: str) -> DataFrame:
    """Add video_id, canonical_url and problem (blank, bad_id, not_a_video_link or null)."""
    outer = _resolve(links.withColumn("__link", T.trim(F.col(column))), "__link", "__o")
    inner = F.try_url_decode(_parameter(F.col("__o_query"), "u"))
    outer = outer.withColumn(
        "__inner", F.when(F.col("__o_allowed") & ~is_video_id(F.col("__link")), inner)
    )
    nested = F.when(F.startswith("__inner", F.lit("http")), F.col("__inner")).otherwise(
        F.concat(
            F.lit("https://www.youtube.com"),
            F.when(F.startswith("__inner", F.lit("/")), "").otherwise("/"),
            "__inner",
        )
    )
    both = _resolve(outer.withColumn("__nested", T.trim(nested)), "__nested", "__n")
    both = both.withColumn("video_id", F.coalesce("__n_id", "__o_id"))
    return both.select(
        *links.columns,
        "video_id",
        F.concat(F.lit(WATCH_URL), "video_id").alias("canonical_url"),
        F.when(F.col("__n_id").isNull(), F.col("__o_bad")).alias("problem"),
    )
