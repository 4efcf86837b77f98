"""Archives through the data source: slices, pruning and pushed filters; tables whose writes count as a whole or not at all."""

import os
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadence.plans.poses import frames
from cadence.sources import archives, committed
from cadence.sources.tables import FRAMES, keypoint_archives
from tests.conftest import SF


def recordings(spark):
    f = frames(spark, SF)
    holed = F.when(F.col("vec_id") % 7 != 0, F.transform("pose", lambda p, i: F.when((F.col("vec_id") + i) % 11 != 0, p)))
    return f.select(F.concat(F.lit("v"), F.col("vec_id") % 4).alias("video_id"), F.concat(F.lit("c"), "group").alias("label"), F.floor(F.col("vec_id") / 4).cast("int").alias("frame_idx"), (F.col("vec_id") * 10).alias("ts_ms"), "width", "height", holed.cast("array<struct<x:float,y:float,z:float,visibility:float>>").cast("array<struct<x:double,y:double,z:double,visibility:double>>").alias("pose"))


def plain(rows):
    return sorted((r.label, r.video_id, r.ts_ms, r.width, r.height, None if r.pose is None else tuple(tuple(None if v is None else round(v, 4) for v in p) if p is not None and any(v is not None for v in p) else None for p in r.pose)) for r in rows)


def test_written_and_read(spark, tmp_path):
    folder = str(tmp_path)
    want = recordings(spark)
    archives.write_archives(want, folder)
    assert not [n for n in os.listdir(folder) if n.startswith("_")]
    got = archives.read_archives(spark, folder, slice_bytes=400)
    assert plain(got.collect()) == plain(want.collect())
    assert plain(keypoint_archives(spark, folder).collect()) == plain(got.collect())
    files = want.select("label", "video_id").distinct().count()
    assert got.rdd.getNumPartitions() > files
    one = "label = 'c1' and video_id = 'v1'"
    archives.write_archives(want.where(one).limit(3), folder)
    again = archives.read_archives(spark, folder)
    assert again.where(one).count() == 3 and again.where(f"not ({one})").count() == want.where(f"not ({one})").count()


def test_pruning(spark, tmp_path, monkeypatch):
    """Labels, ids, frames and columns are chosen before anything is opened; filters of one query leave the next alone."""
    folder = str(tmp_path)
    archives.write_archives(recordings(spark), folder)
    whole = archives.read_archives(spark, folder, slice_bytes=400)
    want = [r for r in whole.collect() if r.label in ("c1", "c2") and r.video_id == "v3" and 2 <= r.frame_idx <= 89]
    some = archives.read_archives(spark, folder, None, ["c1", "c2", "none"], ["v3", "none"], 2, 89, 400)
    assert sorted(map(str, some.collect())) == sorted(map(str, want)) and want
    assert sorted(map(str, whole.where("label in ('c1', 'c2') and video_id = 'v3' and frame_idx between 2 and 89").collect())) == sorted(map(str, want))
    assert whole.where("not (label in ('c1', 'c2') and video_id = 'v3' and frame_idx between 2 and 89)").count() == whole.count() - len(want) == 500 - len(want)
    assert some.rdd.getNumPartitions() < whole.rdd.getNumPartitions() / 10
    reader = archives.ArchiveReader({"path": folder}, whole.select("video_id", "ts_ms").schema)
    opened = []
    monkeypatch.setattr(zipfile.ZipFile, "open", lambda self, name, *a, _f=zipfile.ZipFile.open, **k: opened.append(getattr(name, "filename", name)) or _f(self, name, *a, **k))
    batches = [b for p in reader.partitions()[:2] for b in reader.read(p)]
    assert set(opened) == {"timestamps_ms.npy"} and all(b.schema.names == ["video_id", "ts_ms"] for b in batches)
    assert archives.read_archives(spark, folder, labels=[]).count() == 0 and archives.read_archives(spark, folder, first=5, last=3).count() == 0


def test_arrays_are_read_in_slices(tmp_path):
    """Slices of one archive are its rows, whatever their number; compressed or stored, and with odd values."""
    rng = np.random.default_rng(3)
    marks = rng.normal(size=(5001, 33, 4)).astype(np.float32)
    marks[7] = np.nan
    marks[8, 3, 2] = np.inf
    os.makedirs(tmp_path / "a")
    for save in (np.savez, np.savez_compressed):
        save(tmp_path / "a" / "v.npz", landmarks=marks, timestamps_ms=np.arange(5001) * 33, width=np.array(640), height=np.array(480))
        from pyspark.sql.types import StructType

        reader = archives.ArchiveReader({"path": str(tmp_path), "sliceBytes": "200000"}, StructType.fromDDL(FRAMES))
        parts = reader.partitions()
        rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
        assert len(parts) > 5 and [r["frame_idx"] for r in rows] == list(range(5001)) and rows[7]["pose"] is None and rows[8]["pose"][3]["z"] is None
        assert np.allclose([[v for v in p.values()] for p in rows[4000]["pose"]], marks[4000])


def test_writer_that_fails_leaves_nothing(spark, tmp_path):
    folder = str(tmp_path / "t")
    committed.register(spark)
    committed.write(spark.range(10), folder)
    bad = spark.range(40).repartition(4).select(F.when(F.col("id") == 33, F.raise_error(F.lit("stop")).cast("long")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="stop"):
        committed.write(bad, folder)
    with pytest.raises(Exception, match="stop"):
        committed.write(bad, folder, overwrite=True)
    assert sorted(r.id for r in committed.read(spark, folder).collect()) == list(range(10))
    frames_folder = str(tmp_path / "a")
    archives.write_archives(recordings(spark).where("label = 'c1'"), frames_folder)
    before = sorted(os.listdir(frames_folder))
    with pytest.raises(Exception, match="no name"):
        archives.write_archives(recordings(spark).withColumn("label", F.when(F.col("ts_ms") > 4000, "a/b").otherwise("c9")), frames_folder)
    assert sorted(os.listdir(frames_folder)) == before
    # Files that a killed driver leaves are never named.
    with open(f"{folder}/data/part-lost.parquet", "wb") as f:
        f.write(b"half a file")
    assert committed.read(spark, folder).count() == 10 and committed.sweep(folder) >= 1 and committed.read(spark, folder).count() == 10


def test_upsert(spark, tmp_path):
    folder = str(tmp_path)
    schema = "video_id string, error string"
    committed.upsert(spark.createDataFrame([("a", "x"), ("b", "y")], schema), spark.createDataFrame([("a",), ("b",)], "video_id string"), folder, "video_id")
    committed.upsert(spark.createDataFrame([("c", "z"), ("a", "again")], schema), spark.createDataFrame([("a",), ("c",), ("d",)], "video_id string"), folder, "video_id")
    assert sorted(map(tuple, committed.read(spark, folder).collect())) == [("a", "again"), ("b", "y"), ("c", "z")]
    committed.write(spark.createDataFrame([], schema), folder)
    committed.write(spark.createDataFrame([], schema), folder, overwrite=True)
    assert committed.read(spark, folder).count() == 0 and committed.read(spark, str(tmp_path / "none"), schema).columns == ["video_id", "error"]


def test_repeated_batches_change_nothing(spark, tmp_path):
    """A batch that ran but whose completion was lost is run again by Spark under the same number."""
    import shutil

    source, table, check = (str(tmp_path / n) for n in ("in", "t", "c"))
    for k in range(3):
        spark.range(10 * k, 10 * k + 10).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("id long").parquet(source)
        committed.append_stream(stream, table, check).awaitTermination(120)
        before = committed.manifest(table)
        shutil.rmtree(f"{check}/commits")
        os.makedirs(f"{check}/commits")
        for n in range(k):
            with open(f"{check}/commits/{n}", "w") as f:
                f.write('v1\n{"nextBatchWatermarkMs":0}')
        committed.append_stream(stream, table, check).awaitTermination(120)
        assert committed.manifest(table) == before
        assert sorted(r.id for r in committed.read(spark, table).collect()) == list(range(10 * k + 10))


def test_newest_are_kept(spark, tmp_path):
    source, table, check = (str(tmp_path / n) for n in ("in", "t", "c"))
    times = [5, 9, 1, 7, 9, 3, 8, 2, 6]
    for k in range(3):
        spark.createDataFrame([(t, 3 * k + i) for i, t in enumerate(times[3 * k : 3 * k + 3])], "ended_ms long, reps int").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("ended_ms long, reps int").parquet(source)
        committed.keep_newest(stream, table, check, "ended_ms", 4, ["reps"]).awaitTermination(120)
        seen = sorted(((t, r) for r, t in enumerate(times[: 3 * k + 3])), key=lambda x: (-x[0], x[1]))[:4]
        assert sorted(map(tuple, committed.read(spark, table).collect())) == sorted(seen)
    batch = spark.createDataFrame([(100, 1)], "ended_ms long, reps int")
    committed.write(batch, table, True, check, 2)
    assert committed.read(spark, table).where("ended_ms = 100").count() == 0
