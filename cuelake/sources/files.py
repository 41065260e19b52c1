"""A Spark data source of files that reads the ends of each file only.

    register_media_files(spark)
    spark.read.format("media_files").option("glob", "*.mp3").load(folder)

The driver lists the folder; a partition is a run of files, and its task asks the file system for the
first and the last 64 KiB of each (ranged reads), so a row holds at most 128 KiB and a file may be of
any size. `tail` begins behind `head`: of a file of 100 KiB it has 36. A task costs far more than a small
file, so a run is as long as its files and the bytes of their ends allow; a task hands its rows over in
batches of a few MB. Folders are any that pyarrow's file systems know, as paths or URIs.

Options: glob (of file names, * by default), recursive (true), sample_bytes (65536), files_per_task (1024)."""

from __future__ import annotations

import fnmatch
import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cuelake.session import open_folder

SAMPLE_BYTES = 65_536
# Bytes of ends that a task reads, and bytes of a batch that it hands over.
TASK_BYTES = 64 << 20
BATCH_BYTES = 8 << 20
SCHEMA = "path string, file_name string, modified_ms bigint, size_bytes bigint, head binary, tail binary"
BATCH = pa.schema([
    ("path", pa.string()), ("file_name", pa.string()), ("modified_ms", pa.int64()), ("size_bytes", pa.int64()),
    ("head", pa.binary()), ("tail", pa.binary()),
])


def read_ends(stream, size: int, sample: int) -> tuple[bytes, bytes]:
    """First `sample` bytes of an open file, and the last ones behind them."""
    head = stream.read_at(min(sample, size), 0)
    start = max(sample, size - sample)
    return head, stream.read_at(size - start, start) if size > start else b""


@dataclass
class Run(InputPartition):
    base: str  # what the paths in their file system begin with
    files: list[tuple[str, int, int]]  # rest of the path, size, time


def run_of(files: list[tuple[str, int, int]]) -> Run:
    """A run of sorted files."""
    base = os.path.commonprefix([files[0][0], files[-1][0]]) if files else ""
    return Run(base, [(path[len(base):], size, modified) for path, size, modified in files])


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), BATCH)], schema=BATCH)


class _Reader(DataSourceReader):
    def __init__(self, options) -> None:
        self.root = options["path"]
        self.glob = options.get("glob", "*")
        self.recursive = options.get("recursive", "true").lower() == "true"
        self.sample = int(options.get("sample_bytes", SAMPLE_BYTES))
        self.per_task = int(options.get("files_per_task", 1024))

    def partitions(self) -> list[Run]:
        from pyarrow import fs

        system, inner = open_folder(self.root)
        found = system.get_file_info(fs.FileSelector(inner, recursive=self.recursive))
        files = sorted(
            (f.path, f.size, (f.mtime_ns or 0) // 1_000_000) for f in found if f.is_file and fnmatch.fnmatch(f.base_name, self.glob)
        )
        runs, first, held = [], 0, 0
        for k, (_, size, _) in enumerate(files):
            ends = min(size, 2 * self.sample)
            if k > first and (k - first >= self.per_task or held + ends > TASK_BYTES):
                runs.append(run_of(files[first:k]))
                first, held = k, 0
            held += ends
        return [*runs, run_of(files[first:])]

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        system, _ = open_folder(self.root)
        rows, held = [], 0
        for rest, size, modified in partition.files:
            path = partition.base + rest
            with system.open_input_file(path) as stream:
                head, tail = read_ends(stream, size, self.sample)
            rows.append((path, path.rsplit("/", 1)[-1], modified, size, head, tail))
            held += len(path) + len(head) + len(tail)
            if held >= BATCH_BYTES:
                yield batch_of(rows)
                rows, held = [], 0
        if rows:
            yield batch_of(rows)


class MediaFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "media_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def register_media_files(spark: SparkSession) -> None:
    spark.dataSource.register(MediaFiles)
