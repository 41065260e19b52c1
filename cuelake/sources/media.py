"""Recording files, silence logs and sampled frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.operators.joins import asof_join
from cuelake.operators.ordered import Scan, ordered_scan, row_block
from cuelake.sources.files import SAMPLE_BYTES, register_media_files

# Accepted extensions with their MIME types, and admission limits.
FORMATS = {
    "mp4": ["video/mp4", "application/mp4"],
    "mov": ["video/quicktime", "video/mp4"],
    "webm": ["video/webm", "audio/webm"],
    "mpeg": ["video/mpeg", "audio/mpeg"],
    "mpg": ["video/mpeg"],
    "mpga": ["audio/mpeg"],
    "mp3": ["audio/mpeg", "audio/mp3"],
    "m4a": ["audio/mp4", "audio/x-m4a", "audio/m4a", "video/mp4"],
    "wav": ["audio/wav", "audio/wave", "audio/x-wav", "audio/vnd.wave"],
}
MAX_FILE_BYTES = 1_500_000_000
MAX_DURATION_SEC = 7_200
ATOMS = ["ftyp", "moov", "mdat", "wide", "free", "skip"]


def read_media_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """files(path, file_name, modified_ms, size_bytes, head, tail, mime_type) of a folder. Only the ends
    of the files are read."""
    register_media_files(spark)
    return spark.read.format("media_files").option("glob", glob).load(path).withColumn("mime_type", F.lit(""))


def with_ends(files: DataFrame) -> DataFrame:
    """head and tail of files whose whole content is a column."""
    size = F.octet_length("content")
    start = F.greatest(F.lit(SAMPLE_BYTES), size - SAMPLE_BYTES)
    return files.withColumns({
        "head": F.substring("content", 1, SAMPLE_BYTES), "tail": F.substring(F.col("content"), start + 1, F.lit(SAMPLE_BYTES)),
    }).drop("content")


def _extension(name: Column) -> Column:
    return F.lower(F.element_at(F.split(name, "\\."), -1))


def media_problem(df_name: Column, mime: Column, size: Column, start: Column) -> Column:
    """unsupported_type, empty, file_too_large, bad_container, or null when accepted."""
    ext = _extension(df_name)
    listed = F.create_map(*[
        x for k, v in FORMATS.items() for x in (F.lit(k), F.array(*[F.lit(m) for m in v]))
    ])
    mimes = F.try_element_at(listed, ext)
    mime_ok = (mime == "") | (mime == "application/octet-stream") | F.array_contains(mimes, F.lower(mime))
    head = F.hex(F.substring(start, 1, 16))
    piece = lambda at, n: F.substring(head, at * 2 + 1, n * 2)
    text = lambda s: s.encode().hex().upper()
    sync = F.conv(piece(1, 1), 16, 10).cast("int").bitwiseAND(0xE0) == 0xE0
    good = (
        F.when(ext.isin("mp4", "m4a", "mov"), piece(4, 4).isin([text(a) for a in ATOMS]))
        .when(ext == "webm", piece(0, 4) == "1A45DFA3")
        .when(ext == "wav", (piece(0, 4) == text("RIFF")) & (piece(8, 4) == text("WAVE")))
        .when(
            ext.isin("mp3", "mpga", "mpeg", "mpg"),
            (piece(0, 3) == text("ID3"))
            | ((piece(0, 1) == "FF") & F.coalesce(sync, F.lit(False)))
            | (piece(0, 3) == "000001"),
        )
        .otherwise(False)
    )
    return (
        F.when(mimes.isNull() | ~mime_ok, "unsupported_type")
        .when(size == 0, "empty")
        .when(size > MAX_FILE_BYTES, "file_too_large")
        .when(~good, "bad_container")
    )


def media_inventory(files: DataFrame) -> DataFrame:
    return files.withColumn(
        "problem",
        media_problem(F.col("file_name"), F.col("mime_type"), F.col("size_bytes"), F.col("head")),
    )


def fingerprint(name: Column, size: Column, modified_ms: Column, head: Column, tail: Column) -> Column:
    """SHA-256 over name, size, time, the first and the last 64 KiB (not overlapping)."""
    zero = F.unhex(F.lit("00"))
    part = lambda c: F.encode(c.cast("string"), "UTF-8")
    return F.sha2(F.concat(part(name), zero, part(size), zero, part(modified_ms), zero, head, tail), 256)


def fingerprint_files(files: DataFrame) -> DataFrame:
    names = ("file_name", "size_bytes", "modified_ms", "head", "tail")
    return files.withColumn("fingerprint", fingerprint(*[F.col(c) for c in names]))


def resume_gate(picked: DataFrame, jobs: DataFrame) -> DataFrame:
    """Does the file offered for a job match it? Reason: fingerprint, file (size or time), duration,
    dimensions. A value that one side lacks does not match; size and time are compared where both
    tables have them as columns."""
    optional = [c for c in ("size_bytes", "modified_ms") if c in picked.columns and c in jobs.columns]
    names = ["fingerprint", "duration_sec", "width", "height", *optional]
    p = picked.select("job_id", *[F.col(c).alias(f"p_{c}") for c in names])
    other = lambda c: ~F.col(c).eqNullSafe(F.col(f"p_{c}")) | F.col(c).isNull()
    near = F.coalesce(F.abs(F.col("duration_sec") - F.col("p_duration_sec")) <= 0.1, F.lit(False))
    reason = F.when(other("fingerprint"), "fingerprint")
    for c in optional:
        reason = reason.when(other(c), "file")
    return jobs.join(p, "job_id", "inner").select(
        "job_id", reason.when(~near, "duration").when(other("width") | other("height"), "dimensions").alias("mismatch")
    )


def read_silence_log(
    lines: DataFrame, offset_ms: int = 0, window_ms: int | None = None
) -> DataFrame:
    """lines(media_id, line_no, line) to silences(media_id, line_no, start_ms, end_ms).

    Each end closes the last start since the previous end; a start left open closes at the end
    of the window when one is given.
    """
    number = lambda name: F.regexp_extract(
        "line", f"silence_{name}:\\s*(-?[0-9.]+)", 1
    ).try_cast("double") * 1000
    parsed = lines.select(
        "media_id", "line_no",
        F.when(number("start").isNotNull(), F.greatest(F.lit(0.0), number("start"))).alias("__open"),
        number("end").alias("__close"),
    ).where(F.col("__open").isNotNull() | F.col("__close").isNotNull())
    opened = F.when(F.col("__open").isNotNull(), F.struct("line_no", "__open"))
    closed = F.when(F.col("__close").isNotNull(), F.col("line_no"))
    seen = ordered_scan(
        parsed, ["media_id"], ["line_no"], row_block("line_no"),
        [Scan("last_open", "last", opened), Scan("prev_close", "last_before", closed)],
    )
    paired = seen.where(
        F.col("__close").isNotNull() & F.col("last_open").isNotNull()
        & (F.col("prev_close").isNull() | (F.col("last_open.line_no") > F.col("prev_close")))
    ).select(
        "media_id", "line_no",
        F.round(offset_ms + F.col("last_open.__open")).cast("bigint").alias("start_ms"),
        F.round(offset_ms + F.col("__close")).cast("bigint").alias("end_ms"),
    )
    if window_ms is None:
        return paired
    dangling = parsed.groupBy("media_id").agg(
        F.max_by(F.struct("line_no", "__open"), F.when(opened.isNotNull(), F.col("line_no"))).alias("o"),
        F.max(closed).alias("c"),
    ).where(F.col("o").isNotNull() & (F.col("c").isNull() | (F.col("o.line_no") > F.col("c"))))
    return paired.unionByName(
        dangling.select(
            "media_id", F.col("o.line_no").alias("line_no"),
            F.round(offset_ms + F.col("o.__open")).cast("bigint").alias("start_ms"),
            F.lit(offset_ms + window_ms).cast("bigint").alias("end_ms"),
        )
    )


def sample_frames(media: DataFrame, frames: DataFrame, step_ms: int = 500) -> DataFrame:
    """One frame per sampling step: the latest frame at or before each requested time.

    media(media_id, duration_ms, cursor_ms); frames(media_id, t_ms, ...). The steps of a
    recording come from one row, and the as-of scan reads a busy recording in time blocks.
    """
    grid = media.where(F.col("cursor_ms") < F.col("duration_ms")).select(
        "media_id",
        F.explode(
            F.sequence("cursor_ms", F.col("duration_ms") - 1, F.lit(step_ms).cast("bigint"))
        ).alias("requested_ms"),
    )
    found = asof_join(
        grid, frames, ["media_id"], F.col("requested_ms"), F.col("t_ms"), ["t_ms"],
        prefix="frame", left_order=["requested_ms"],
    )
    return found.where(F.col("frame").isNotNull())
