"""Keypoint archives as a Spark data source: folders `<label>/<video_id>.npz` with landmarks (T, 33, 4), timestamps_ms, width
and height.

    archives.register(spark)
    archives.read_archives(spark, folder, ["video_id", "ts_ms"], labels=["squat"])
    archives.write_archives(frames, folder)

An archive is read in slices of about `sliceBytes` bytes (8 MiB), each a partition that holds a slice of the arrays in memory.
Columns that the read schema leaves out are neither unpacked nor built, and the options `labels`, `videos` (JSON lists),
`firstFrame` and `lastFrame` choose folders, files and slices before anything is opened. Filters of a query are left to Spark:
its scan of a Python source (4.1) keeps what one query pushed down for the next query on the same DataFrame, which would lose
rows. Folders are those of any file system that pyarrow knows.
"""

from __future__ import annotations

import io
import json
import math
import uuid
import zipfile
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from cadence.sources.tables import FRAMES

NAME, SUFFIX = "keypoint_archives", ".npz"
AXES = ("x", "y", "z", "visibility")
POINTS = 33
SLICE_BYTES, ROWS = 8 << 20, 2048


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path within it of a URI or a local path."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


@dataclass
class Slice(InputPartition):
    """Part `number` of `parts` of an archive."""

    path: str
    label: str
    video_id: str
    number: int
    parts: int


class _Npy:
    """One array of an archive, of which only a range of rows is kept in memory."""

    def __init__(self, archive: zipfile.ZipFile, name: str) -> None:
        self.stream = archive.open(f"{name}.npy")
        version = np.lib.format.read_magic(self.stream)
        read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
        self.shape, fortran, self.dtype = read(self.stream)
        if fortran and len(self.shape) > 1:
            raise ValueError(f"{name}: an array in column order cannot be read in slices")
        self.row_bytes = self.dtype.itemsize * int(np.prod(self.shape[1:], dtype=np.int64))
        self.at = 0

    def rows(self, start: int, stop: int) -> np.ndarray:
        left = (start - self.at) * self.row_bytes
        while left > 0:
            skipped = len(self.stream.read(min(left, 1 << 20)))
            if not skipped:
                raise EOFError("an archive ends before its arrays do")
            left -= skipped
        data = self.stream.read((stop - start) * self.row_bytes)
        self.at = stop
        return np.frombuffer(data, self.dtype).reshape(stop - start, *self.shape[1:])


def poses_of(marks: np.ndarray) -> pa.Array:
    """(T, points, 4) as lists of structs: what is not finite is null, and so is a frame without a finite x or y."""
    t, points, _ = marks.shape
    values = marks.reshape(t * points, 4).astype(np.float64)
    columns = [pa.array(np.ascontiguousarray(values[:, k]), pa.float64(), mask=~np.isfinite(values[:, k])) for k in range(4)]
    structs = pa.StructArray.from_arrays(columns, AXES)
    gone = ~np.isfinite(marks[:, :, :2]).any(axis=(1, 2))
    return pa.ListArray.from_arrays(pa.array(np.arange(t + 1) * points, pa.int32()), structs, mask=pa.array(gone))


class ArchiveReader(DataSourceReader):
    def __init__(self, options: Mapping[str, str], schema: StructType) -> None:
        self.folder, self.schema = options["path"], schema
        self.slice_bytes = int(options.get("sliceBytes", SLICE_BYTES))
        self.labels, self.videos = (None if options.get(o) is None else sorted(set(json.loads(options[o]))) for o in ("labels", "videos"))
        self.first, self.last = int(options.get("firstFrame", 0)), float(options.get("lastFrame", math.inf)) + 1

    def partitions(self) -> list[Slice]:
        system, root = opened(self.folder)
        out = []
        folders = self.labels
        if folders is None:
            folders = sorted(f.base_name for f in system.get_file_info(fs.FileSelector(root)) if f.type == fs.FileType.Directory)
        for label in (x for x in folders if not x.startswith(("_", ".")) and "/" not in x):
            if self.videos is None:
                infos = system.get_file_info(fs.FileSelector(f"{root}/{label}", allow_not_found=True))
            else:
                infos = system.get_file_info([f"{root}/{label}/{v}{SUFFIX}" for v in self.videos if "/" not in v])
            for f in sorted(infos, key=lambda f: f.path):
                if f.type == fs.FileType.File and f.base_name.endswith(SUFFIX) and not f.base_name.startswith(("_", ".")):
                    parts = max(1, -(-f.size // self.slice_bytes))
                    out += [Slice(f.path, label, f.base_name.removesuffix(SUFFIX), k, parts) for k in range(parts)]
        return out if self.first < self.last else []

    def read(self, part: Slice | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # Spark's stand-in where there are no partitions
            return
        system, _ = opened(self.folder)
        names = self.schema.fieldNames()
        with system.open_input_file(part.path) as file, zipfile.ZipFile(file) as z:
            times = _Npy(z, "timestamps_ms")
            t = times.shape[0]
            start = max(t * part.number // part.parts, self.first)
            stop = int(min(t * (part.number + 1) // part.parts, self.last))
            marks = _Npy(z, "landmarks") if "pose" in names else None
            size = {n: int(np.load(io.BytesIO(z.read(f"{n}.npy")))) for n in ("width", "height") if n in names}
            for a in range(start, stop, ROWS):
                b = min(a + ROWS, stop)
                made = {"video_id": lambda n: pa.array([part.video_id] * n), "label": lambda n: pa.array([part.label] * n), "frame_idx": lambda n, a=a: pa.array(np.arange(a, a + n), pa.int32()), "ts_ms": lambda n, a=a: pa.array(times.rows(a, a + n).astype(np.int64)), "width": lambda n: pa.array([size["width"]] * n, pa.int32()), "height": lambda n: pa.array([size["height"]] * n, pa.int32()), "pose": lambda n, a=a: poses_of(marks.rows(a, a + n))}
                yield pa.RecordBatch.from_arrays([made[n](b - a) for n in names], names)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]] = field(default_factory=list)


class ArchiveWriter(DataSourceWriter):
    """One archive a video. Archives are made in a hidden folder of the job and move to their places when all tasks are
    done, each at once; a job that fails leaves the folder as it was."""

    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        self.folder, self.names = options["path"], schema.fieldNames()
        self.job = f"_job-{uuid.uuid4().hex}"

    def write(self, rows: Iterator[Row]) -> Written:
        system, root = opened(self.folder)
        task, done, seen = uuid.uuid4().hex, Written(), set()
        at = {n: k for k, n in enumerate(self.names)}
        system.create_dir(f"{root}/{self.job}")
        for (label, video), group in groupby(rows, key=lambda r: (r[at["label"]], r[at["video_id"]])):
            for name in (label, video):
                if not name or "/" in name or name.startswith(("_", ".")):
                    raise ValueError(f"no name for a folder or file: {name!r}")
            if (label, video) in seen:
                raise ValueError(f"rows of {label}/{video} are not together; use write_archives")
            seen.add((label, video))
            times, marks, size = [], [], (0, 0)
            for r in group:
                times.append(int(r[at["ts_ms"]]))
                marks.append(_marks(r[at["pose"]]))
                size = r[at["width"]], r[at["height"]]
            temporary = f"{root}/{self.job}/{task}-{len(done.files)}{SUFFIX}"
            with system.open_output_stream(temporary) as file:
                data = io.BytesIO()
                np.savez_compressed(data, landmarks=np.stack(marks), timestamps_ms=np.array(times, np.int64), width=np.array(size[0]), height=np.array(size[1]))
                file.write(data.getbuffer())
            done.files.append((temporary, f"{root}/{label}/{video}{SUFFIX}"))
        return done

    def commit(self, messages: list[Written | None]) -> None:
        system, root = opened(self.folder)
        for source, target in (pair for m in messages if m for pair in m.files):
            system.create_dir(target.rsplit("/", 1)[0])
            system.move(source, target)
        self._clear(system, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*opened(self.folder))

    def _clear(self, system: fs.FileSystem, root: str) -> None:
        if system.get_file_info(f"{root}/{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{self.job}")


def _marks(pose) -> np.ndarray:
    out = np.full((POINTS, 4), np.nan, np.float32)
    for k, p in enumerate((pose or [])[:POINTS]):
        if p is not None:
            out[k] = [np.nan if v is None else v for v in p]
    return out


class KeypointArchives(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return FRAMES

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(dict(self.options), schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(KeypointArchives)


def read_archives(spark: SparkSession, folder: str, columns: list[str] | None = None, labels: list[str] | None = None, video_ids: list[str] | None = None, first: int | None = None, last: int | None = None, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Frames of a folder's archives, all or those of the given labels and ids and from frame `first` to `last`; `columns`
    limits what is unpacked."""
    register(spark)
    whole = StructType.fromDDL(FRAMES)
    schema = whole if columns is None else StructType([whole[c] for c in columns])
    given = {"labels": None if labels is None else json.dumps(labels), "videos": None if video_ids is None else json.dumps(video_ids), "firstFrame": first, "lastFrame": last}
    return spark.read.format(NAME).schema(schema).options(sliceBytes=slice_bytes, **{k: v for k, v in given.items() if v is not None}).load(folder)


def write_archives(frames: DataFrame, folder: str) -> None:
    """One archive for each (label, video_id) of frames (FRAMES), in order of frame_idx; an archive that is there already is
    replaced. The arrays of one video are held by one task."""
    register(frames.sparkSession)
    names = [c.split()[0] for c in FRAMES.split(", ")]
    own = frames.select(*names).withColumn("pose", F.col("pose").cast("array<struct<x:float,y:float,z:float,visibility:float>>"))
    own.repartition("label", "video_id").sortWithinPartitions("label", "video_id", "frame_idx", "ts_ms").write.format(NAME).mode("append").save(folder)
