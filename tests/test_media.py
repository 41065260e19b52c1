"""Files read by their ends, and one file per recording whatever the names."""

import hashlib
import json
import os

from pyspark.sql import functions as F

from cuelake.sinks import documents as D
from cuelake.sources import media as M


def test_only_the_ends_are_read(spark, tmp_path):
    sizes = {"empty.mp3": 0, "small.mp3": 100, "edge.mp3": 65_536, "over.mp3": 65_537, "two.mp3": 131_072, "long.mp3": 300_001, "deep/x.mp3": 10, "other.txt": 5}
    data = {n: (b"ID3" + hashlib.sha256(n.encode()).digest() * 10_000)[:k] for n, k in sizes.items()}
    for name, content in data.items():
        path = tmp_path / "in" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    # a file above two GiB, with nothing but holes in the middle
    with open(tmp_path / "in" / "huge.mp3", "wb") as f:
        f.write(b"ID3 start")
        f.seek(3_000_000_000)
        f.write(b"the end")
    rows = M.fingerprint_files(M.media_inventory(M.read_media_files(spark, str(tmp_path / "in"), "*.mp3"))).collect()
    got = {r.file_name: r for r in rows}
    assert set(got) == {os.path.basename(n) for n in sizes if n.endswith("mp3")} | {"huge.mp3"}
    for name, content in data.items():
        if name.endswith("mp3"):
            r = got[os.path.basename(name)]
            tail = content[max(65_536, len(content) - 65_536):]
            assert (r.size_bytes, bytes(r.head), bytes(r.tail)) == (len(content), content[:65_536], tail), name
            marked = f"{r.file_name}\0{r.size_bytes}\0{r.modified_ms}\0".encode() + content[:65_536] + tail
            assert r.fingerprint == hashlib.sha256(marked).hexdigest()
    assert got["huge.mp3"].size_bytes == 3_000_000_007 and got["huge.mp3"].problem == "file_too_large"
    assert bytes(got["huge.mp3"].tail).endswith(b"the end") and len(got["huge.mp3"].tail) == 65_536
    assert got["empty.mp3"].problem == "empty" and got["small.mp3"].problem is None
    os.mkdir(tmp_path / "none")
    assert M.read_media_files(spark, str(tmp_path / "none")).collect() == []


def test_names_that_meet_after_the_id_is_added(spark, tmp_path):
    names = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a-1"), (4, "a-1"), (5, "a-1-3"), (6, "b"), (7, "A")], "media_id BIGINT, basename STRING")
    parts = names.select("media_id", F.lit(0).alias("part"), F.col("media_id").cast("string").alias("text"))
    done = D.write_files(parts, names, str(tmp_path / "out"), "txt").collect()
    assert len({r.path for r in done}) == 7 and len({os.path.basename(r.path).lower() for r in done}) == 7
    for r in done:
        with open(r.path) as f:
            assert f.read() == str(r.media_id)
    assert [r.path for r in done if r.media_id == 6] == [str(tmp_path / "out" / "b.txt")]


def test_a_long_recording_is_one_json_document(spark, tmp_path):
    jobs = spark.createDataFrame(
        [(1, "one", "T", "en"), (2, "two", None, "en")], "media_id BIGINT, id STRING, title STRING, language STRING",
    ).withColumns({c: F.lit(None).cast("string") for c in ("kind", "source", "video_id", "url", "source_type", "provider", "timestamp_quality", "summary", "summary_kind", "source_label")})
    rows = spark.range(25_000).select(
        F.lit(1).cast("bigint").alias("media_id"), F.col("id").alias("seq"), (F.col("id") * 1000).alias("start_ms"), F.lit(900).alias("dur_ms"),
        F.concat(F.lit('said "'), "id", F.lit('"')).alias("text"), F.when(F.col("id") % 2 == 0, "A").alias("speaker"))
    names = jobs.select("media_id", F.col("id").alias("basename"))
    written = D.write_files(D.document_parts(D.export_json(jobs, rows, rows.where("seq < 11000"))), names, str(tmp_path / "out"), "json").collect()
    assert len(written) == 2
    with open(tmp_path / "out" / "one.json") as f:
        doc = json.load(f)
    assert [s["text"] for s in doc["segments"]] == [f'said "{k}"' for k in range(25_000)] and len(doc["paragraphs"]) == 11_000
    back = spark.read.json(str(tmp_path / "out"), multiLine=True)
    assert {(r.id, r.n) for r in back.select("id", F.size("segments").alias("n")).collect()} == {("one", 25_000), ("two", 0)}


def test_runs_of_files_and_batches(spark, tmp_path):
    """Small files share a task by the thousand; long ends and batches stay bounded."""
    from cuelake.sources import files as S

    (tmp_path / "in" / "deep").mkdir(parents=True)
    for k in range(2000):
        (tmp_path / "in" / ("deep" if k % 2 else "") / f"f{k}.mp3").write_bytes(b"ID3" + str(k).encode())
    got = M.read_media_files(spark, str(tmp_path / "in"), "*.mp3")
    assert got.rdd.getNumPartitions() == 2
    assert {(r.file_name, bytes(r.head)) for r in got.collect()} == {(f"f{k}.mp3", b"ID3" + str(k).encode()) for k in range(2000)}
    (tmp_path / "long").mkdir()
    for k in range(600):
        with open(tmp_path / "long" / f"f{k}.mp3", "wb") as f:
            f.truncate(200_000)
    reader = S._Reader({"path": str(tmp_path / "long")})
    runs = reader.partitions()
    assert [len(r.files) for r in runs] == [512, 88]
    batches = [b for r in runs for b in reader.read(r)]
    assert sum(b.num_rows for b in batches) == 600 and max(b.nbytes for b in batches) < S.BATCH_BYTES + 200_000
    assert {p for b in batches for p in b.column("path").to_pylist()} == {str(tmp_path / "long" / f"f{k}.mp3") for k in range(600)}
