"""Keyed kernels over streams with typed state: one map of the state store, by series, for each part of a kernel's state.

A call of Spark for a key costs milliseconds whatever it has to do, so series, which may be many and short, share `BUCKETS`
keys by their hash; what the calls cost no longer grows with the number of series.

Kernels need their rows in order of time, so rows wait in a map of the state, in runs, until the watermark has passed them; a
batch writes what it adds and what is left of the runs that it takes from. Rows that come later than the watermark are dropped
by Spark. A series that has been silent for `idle_ms` of event time is finished by a timer: what its kernel still holds is
emitted and all of its state goes.

Operators can be chained in one query: with `event_time`, the rows of a kernel carry the time at which they were made, and
the watermark passes through.
"""

from __future__ import annotations

import datetime
import math
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type
from pyspark.sql.streaming import StatefulProcessor

from cadence.kernels.base import BATCH_VALUES, Kernel, weight
from cadence.kernels.codecs import codec, fitted
from cadence.session import bound_arrow

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
UTC = datetime.timezone.utc
#: Rows that come together and are kept as one run, whatever their times; rows already passed that wait outside the store.
RUN_ROWS, EARLY_ROWS = 256, 4096
#: Keys of the state that all series share; part of what a checkpoint holds.
BUCKETS = 1024


def with_state_store(spark: SparkSession) -> None:
    """State by key needs the RocksDB store; a session that has set another keeps it. With
    spark.sql.streaming.stateStore.encodingFormat = avro, fields can be added to the parts of stored states."""
    key = "spark.sql.streaming.stateStore.providerClass"
    if key not in spark.conf.getAll:
        spark.conf.set(key, ROCKSDB)


def _split(rows: pa.RecordBatch, watermark: int) -> tuple[pa.RecordBatch, pa.RecordBatch]:
    """Rows that the watermark has passed, and the others."""
    passed = rows.column(0).to_numpy() <= watermark
    if passed.all() or not passed.any():
        return (rows, rows.slice(0, 0)) if passed.all() else (rows.slice(0, 0), rows)
    return rows.filter(pa.array(passed)), rows.filter(pa.array(~passed))


def _is_points(kind: T.DataType) -> bool:
    inner = kind.elementType if isinstance(kind, T.ArrayType) else None
    return isinstance(inner, T.StructType) and len(inner) > 0 and all(isinstance(f.dataType, (T.DoubleType, T.FloatType)) for f in inner)


def _packed(c: Column, kind: T.DataType) -> Column:
    """Lists of points travel as numbers, the places among them without a value and the points that are missing: as Python
    values, which Spark makes of whole batches, a point is a dictionary, ten times as large."""
    if not _is_points(kind):
        return c
    values = F.flatten(F.transform(c, lambda x: F.array(*[x[f.name].cast("double") for f in kind.elementType])))
    without = lambda a: F.filter(F.transform(a, lambda x, i: F.when(x.isNull(), i)), lambda i: i.isNotNull())
    return F.when(c.isNotNull(), F.struct(values.alias("values"), without(values).alias("holes"), without(c).alias("lost")))


def _unpacked(c: pa.StructArray, kind: pa.ListType) -> pa.ListArray:
    (values, holes, lost), width = c.flatten(), kind.value_type.num_fields
    sizes = [x.value_lengths().fill_null(0).to_numpy() for x in (values, holes, lost)]
    numbers = values.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
    starts = np.cumsum(sizes[0]) - sizes[0]
    hole, gone = np.zeros(numbers.size, bool), np.zeros(len(numbers), bool)
    hole[holes.flatten().to_numpy() + np.repeat(starts, sizes[1])] = True
    gone[lost.flatten().to_numpy() + np.repeat(starts // width, sizes[2])] = True
    hole, fields = hole.reshape(-1, width), list(kind.value_type)
    points = pa.StructArray.from_arrays([pa.array(numbers[:, i], pa.float64(), mask=hole[:, i], from_pandas=False).cast(f.type) for i, f in enumerate(fields)], fields=fields, mask=pa.array(gone))
    ends = np.concatenate([[0], np.cumsum(sizes[0] // width)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), points, type=kind, mask=values.is_null())


class KeyedKernel(StatefulProcessor):
    """Runs a kernel for each series of a bucket. Input rows are (bucket, event time, _row), _row being (_event_ms, what orders
    rows, kernel inputs, the series' keys).

    Rows that wait lie in runs, entries of a map by the time of their first row, each an Arrow batch. A batch adds runs and
    rewrites none; when rows are taken, a run is read as soon as those before it have come to its first row, so memory holds
    the rows of a stretch of time and the states of the series that have rows, not all rows of a series. `_clock` has what a
    bucket needs to know between calls, so that one with few rows costs few calls to the store.
    """

    def __init__(self, kernel: Kernel, kinds: list[T.StructType], row: T.StructType, sent: T.StructType, n_order: int, keys: T.StructType, out: T.StructType, idle_ms: int, bucket_ms: int, event_time: bool) -> None:
        self.kernel, self.row, self.sent, self.keys, self.out = kernel, to_arrow_schema(row), to_arrow_schema(sent), keys, out
        self.kinds = [T.StructType().add("listed", T.ArrayType(k)) if p.listed else k for p, k in zip(codec(kernel), kinds, strict=True)]
        self.first_input, self.first_key = 1 + n_order, len(row) - len(keys)
        self.series = pa.schema([*list(self.row)[self.first_key :], pa.field("latest", pa.int64()), pa.field("stored", pa.bool_())])
        self.floats = any(isinstance(f.dataType, (T.DoubleType, T.FloatType)) for f in keys)
        self.idle_ms, self.bucket_ms, self.event_time = idle_ms, bucket_ms, event_time

    def init(self, handle) -> None:
        self.handle, self.codec = handle, codec(self.kernel)
        self.parts = [handle.getMapState(p.name, self.keys, k) for p, k in zip(self.codec, self.kinds, strict=True)]
        # Time of the first row that waits, number of runs so far, the timer; of each series the time of the latest row and
        # whether its kernel's state is stored.
        self.clock = handle.getValueState("_clock", "first long, runs long, timer long, series binary")
        self.waiting = handle.getMapState("_waiting", "first long, run long", "rows binary")

    def close(self) -> None:
        pass

    def _load(self, key: tuple, stored: bool):
        state, old = self.kernel.start(), []
        for p, store in zip(self.codec, self.parts, strict=True):
            value = store.getValue(key) if stored else None
            old.append(None if value is None else tuple(value))
            if value is not None:
                state = p.put(state, [tuple(r) for r in value[0]] if p.listed else tuple(value))
        return state, old

    def _save(self, key: tuple, state, old) -> None:
        """Writes the parts that have changed."""
        for p, kind, store, before in zip(self.codec, self.kinds, self.parts, old, strict=True):
            now = p.get(state)
            now = fitted(((now,) if now else None) if p.listed else now, kind)
            if now is None:
                if before is not None:
                    store.removeKey(key)
            elif before is None or fitted(before, kind) != now:
                store.updateValue(key, now)

    def _key(self, values) -> tuple:
        return tuple(math.nan if v != v else v for v in values) if self.floats else tuple(values)

    def _keep(self, rows: pa.RecordBatch, runs: int) -> tuple[int, int | None]:
        """Stores rows as runs, many of them by stretches of time; (number of runs so far, time of the first of these rows)."""
        if not rows.num_rows:
            return runs, None
        ms = rows.column(0).to_numpy()
        bucket = ms // self.bucket_ms
        places, cuts = np.argsort(bucket, kind="stable"), [0]
        for at in np.flatnonzero(np.diff(bucket[places])) + 1:
            if at - cuts[-1] >= RUN_ROWS:
                cuts.append(int(at))
        for some in np.split(places, cuts[1:]):
            self.waiting.updateValue((int(ms[some].min()), runs), (rows.take(pa.array(some)).serialize().to_pybytes(),))
            runs += 1
        return runs, int(ms.min())

    def _in_order(self, early: list[pa.RecordBatch], runs: list[tuple[int, int]], watermark: int, left: list[pa.RecordBatch], drop: bool) -> Iterator[tuple]:
        """Rows up to the watermark in order of time; what the runs hold beyond it goes to `left`."""
        heap, n = [], 0
        for at in [*early, *runs]:
            some = at
            if isinstance(at, tuple):
                while heap and heap[0][0] < at[0]:
                    yield heappop(heap)[-1]
                some = pa.ipc.read_record_batch(pa.py_buffer(self.waiting.getValue(at)[0]), self.row)
                if drop:
                    self.waiting.removeKey(at)
            now, later = _split(some, watermark)
            if later.num_rows:
                left.append(later)
            for r in zip(*[c.to_pylist() for c in now.columns], strict=True):
                heappush(heap, (r[0], tuple((v is not None, v) for v in r[1 : self.first_input]), n, r))
                n += 1
        while heap:
            yield heappop(heap)[-1]

    def _made(self, out: list[tuple]) -> pd.DataFrame:
        columns = zip(*[(*key, *f, *([datetime.datetime.fromtimestamp(at / 1000, UTC)] if self.event_time else [])) for key, at, f in out], strict=True)
        # Arrow columns keep NaN apart from NULL; Spark takes nested ones as objects only.
        return pd.DataFrame({f.name: pd.Series(c, dtype=object) if isinstance(f.dataType, (T.TimestampType, T.ArrayType, T.StructType, T.MapType)) else pd.arrays.ArrowExtensionArray(pa.array(c, to_arrow_type(f.dataType))) for c, f in zip(columns, self.out, strict=True)}, copy=False)

    def _run(self, series: dict, done: list[tuple], rows: Iterator[tuple], watermark: int, last: bool) -> Iterator[pd.DataFrame]:
        """Steps the kernels through rows in order of time; the series in `done` are finished and go, the others are stored."""
        states, old, out, size = {}, {}, [], 0
        for r in rows:
            key = self._key(r[self.first_key :])
            if key not in states:
                states[key], old[key] = self._load(key, series[key][1])
            states[key], found = self.kernel.step(states[key], r[self.first_input : self.first_key])
            for f in found:
                out.append((key, r[0], f))
                size += weight(f)
            if size >= BATCH_VALUES:
                yield self._made(out)
                out, size = [], 0
        for key in done:
            state = states.pop(key) if key in states else self._load(key, series[key][1])[0]
            for f in self.kernel.finish(state):
                out.append((key, watermark + 1, f))
                size += weight(f)
            if series.pop(key)[1] and not last:
                for store in self.parts:
                    store.removeKey(key)
            if size >= BATCH_VALUES:
                yield self._made(out)
                out, size = [], 0
        for key, state in states.items():
            self._save(key, state, old[key])
            series[key][1] = True
        if out:
            yield self._made(out)

    def _advance(self, new: Iterator[pa.RecordBatch], watermark: int, fired: int | None) -> Iterator[pd.DataFrame]:
        clock = self.clock.get()
        first, runs, timer, told = clock if clock is not None else (None, 0, None, None)
        series = {} if told is None else {self._key(k): [latest, stored] for *k, latest, stored in zip(*[c.to_pylist() for c in pa.ipc.read_record_batch(pa.py_buffer(told), self.series).columns], strict=True)}
        any_stored = any(stored for _, stored in series.values())
        early: list[pa.RecordBatch] = []
        for rows in new:
            now, later = _split(rows, watermark)
            if now.num_rows and sum(b.num_rows for b in early) + now.num_rows <= EARLY_ROWS:
                early.append(now)
            else:
                later = rows
            for top, *k in zip(rows.column(0).to_pylist(), *[c.to_pylist() for c in rows.columns[self.first_key :]], strict=True):
                known = series.setdefault(self._key(k), [top, False])
                known[0] = max(known[0], top)
            runs, begin = self._keep(later, runs)
            first = min((v for v in (first, begin) if v is not None), default=None)
        if not series:
            return
        done = [k for k, (latest, _) in series.items() if latest + self.idle_ms <= watermark]
        last = len(done) == len(series)
        had = first is not None
        if early or done or (had and first <= watermark):
            known = sorted(tuple(k) for k in self.waiting.keys()) if had else []
            left: list[pa.RecordBatch] = []
            yield from self._run(series, done, self._in_order(early, [k for k in known if k[0] <= watermark], watermark, left, not last), watermark, last)
            begin = None
            for some in pa.Table.from_batches(left, self.row).combine_chunks().to_batches():
                runs, begin = self._keep(some, runs)
            first = min([k[0] for k in known if k[0] > watermark] + ([begin] if begin is not None else []), default=None)
        wanted = None if last else min([latest + self.idle_ms for latest, _ in series.values()] + ([first] if first is not None else []))
        if timer is not None and timer not in (wanted, fired):
            self.handle.deleteTimer(timer)
        if last:
            for store in [*(self.parts if any_stored else []), *([self.waiting] if had else []), *([self.clock] if clock is not None else [])]:
                store.clear()
            return
        if timer != wanted or wanted == fired:
            self.handle.registerTimer(wanted)
        told = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*[(*k, *v) for k, v in series.items()], strict=True), self.series, strict=True)], schema=self.series).serialize().to_pybytes()
        if (first, runs, wanted, told) != clock:
            self.clock.update((first, runs, wanted, told))

    def _rows(self, part: pd.DataFrame) -> pa.RecordBatch:
        sent = pa.RecordBatch.from_struct_array(pa.array(part[part.columns[-1]].tolist(), pa.struct(self.sent)))
        return pa.RecordBatch.from_arrays([c if c.type == f.type else _unpacked(c, f.type) for c, f in zip(sent.columns, self.row, strict=True)], schema=self.row)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        yield from self._advance(map(self._rows, rows), timerValues.getCurrentWatermarkInMs(), None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(iter(()), timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())


def run(df: DataFrame, keys: list[str], time: str, kernel: Kernel, order: list[str] | None = None, lateness: str | None = "0 seconds", idle_ms: int = 60_000, names: dict[str, str] | None = None, bucket_ms: int = 10_000, event_time: str | None = None) -> DataFrame:
    """(keys, kernel.output) in append mode, and with `event_time` a timestamp column of that name for operators that
    follow. `time` is the event time; lateness None keeps the watermark that it already has. `order` are the columns that
    put the rows of a key in order (`ts_ms`, if not given); `names` maps kernel inputs to columns."""
    with_state_store(df.sparkSession)
    bound_arrow(df.sparkSession)
    column = {i: (names or {}).get(i, i) for i in kernel.inputs}
    kinds = {f.name: f.dataType for f in df.schema}
    order = order or ["ts_ms"]
    own = df if lateness is None else df.withWatermark(time, lateness)
    parts_of = [("_event_ms", F.floor(F.unix_micros(F.col(time)) / 1000).cast("long"), T.LongType())]
    parts_of += [(f"_{kind}{n}", F.col(c), kinds[c]) for kind, names_of in (("o", order), ("i", [column[i] for i in kernel.inputs]), ("k", keys)) for n, c in enumerate(names_of)]
    row = T.StructType([T.StructField(n, kind) for n, _, kind in parts_of])
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int").alias("_bucket")
    own = own.select(bucket, time, F.struct(*[_packed(c, kind).alias(n) for n, c, kind in parts_of]).alias("_row"))
    parts = [T.StructType.fromDDL(p.ddl) for p in codec(kernel)]
    output = ", ".join(f"`{k}` {kinds[k].simpleString()}" for k in keys) + ", " + kernel.output + (f", {event_time} timestamp" if event_time else "")
    out = T.StructType.fromDDL(output)
    processor = KeyedKernel(kernel, parts, row, own.schema["_row"].dataType, len(order), T.StructType([T.StructField(f"_k{n}", kinds[k]) for n, k in enumerate(keys)]), out, idle_ms, bucket_ms, event_time is not None)
    return own.groupBy("_bucket").transformWithStateInPandas(processor, out, "Append", "EventTime", eventTimeColumnName=event_time or "")
