"""Table functions for SQL: one row to many where no built-in expression does it.

`register_table_functions(spark)` makes them known to a session:

    SELECT i.image_id, t.* FROM images i, LATERAL tiles(i.width, i.height, i.bytes_per_pixel) t
    SELECT * FROM image_tiles(TABLE(images))
    SELECT * FROM image_tiles(TABLE(images), max_side => 4096)

`image_tiles` asks for its rows partitioned by image_id itself."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, PartitioningColumn

# Limits of an image part that one request takes.
MAX_SIDE, MAX_PIXELS, MAX_BYTES, LEAST_SIDE = 8192, 16_777_216, 3_000_000, 96
MOST_TILES, MOST_DEPTH, LAP = 200, 12, 32

TILE = StructType([
    StructField("refused", BooleanType()), StructField("tile", IntegerType()), StructField("x", IntegerType()),
    StructField("y", IntegerType()), StructField("width", IntegerType()), StructField("height", IntegerType()),
])


def plan_tiles(width: int, height: int, weight: float, max_side: int, max_pixels: int) -> list[tuple[int, int, int, int]] | None:
    """Overlapping parts (x, y, width, height) of an image within the limits, in reading order of the
    cuts; None if it would take too many or too small ones. The longer side is halved each time."""
    waiting, done = [(0, 0, int(width), int(height), 0)], []
    while waiting:
        x, y, w, h, depth = waiting.pop()
        if depth > MOST_DEPTH or len(done) >= MOST_TILES:
            return None
        if max(w, h) <= max_side and w * h <= max_pixels and w * h * weight <= MAX_BYTES:
            done.append((x, y, w, h))
            continue
        if w < LEAST_SIDE and h < LEAST_SIDE:
            return None
        side = max(w, h)
        cut, lap = side // 2, min(LAP, side // 8)
        for at, size in ((cut - lap, side - cut + lap), (0, cut + lap)):
            waiting.append((x + at, y, size, h, depth + 1) if w >= h else (x, y + at, w, size, depth + 1))
    return done


def _rows(width: int | None, height: int | None, weight: float | None, max_side: int, max_pixels: int) -> Iterator[tuple]:
    known = None not in (width, height, weight)
    parts = plan_tiles(width, height, float(weight), max_side, max_pixels) if known else None
    if parts is None:
        yield (True, None, None, None, None, None)
    else:
        for k, part in enumerate(parts):
            yield (False, k, *part)


class Tiles:
    """Tiles of one image; a refused image gives one row without a tile."""

    @staticmethod
    def analyze(
        width: AnalyzeArgument, height: AnalyzeArgument, bytes_per_pixel: AnalyzeArgument,
        max_side: AnalyzeArgument | None = None, max_pixels: AnalyzeArgument | None = None,
    ) -> AnalyzeResult:
        return AnalyzeResult(TILE)

    def eval(self, width, height, bytes_per_pixel, max_side=MAX_SIDE, max_pixels=MAX_PIXELS):
        yield from _rows(width, height, bytes_per_pixel, max_side, max_pixels)


class ImageTiles:
    """Tiles of a table of images (image_id, width, height, bytes_per_pixel)."""

    @staticmethod
    def analyze(images: AnalyzeArgument, max_side: AnalyzeArgument | None = None, max_pixels: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not images.isTable:
            raise ValueError("image_tiles takes a table: TABLE(images)")
        types = {f.name: f.dataType for f in images.dataType}
        missing = [c for c in ("image_id", "width", "height", "bytes_per_pixel") if c not in types]
        if missing:
            raise ValueError(f"image_tiles: no column {', '.join(missing)}")
        schema = StructType([StructField("image_id", types["image_id"]), *TILE.fields])
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn("image_id")])

    def eval(self, row, max_side=MAX_SIDE, max_pixels=MAX_PIXELS):
        for tile in _rows(row["width"], row["height"], row["bytes_per_pixel"], max_side, max_pixels):
            yield (row["image_id"], *tile)


def register_table_functions(spark: SparkSession) -> None:
    from pyspark.sql.functions import udtf

    spark.udtf.register("tiles", udtf(Tiles))
    spark.udtf.register("image_tiles", udtf(ImageTiles))
