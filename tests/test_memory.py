"""What tasks hold and how often they call the store does not grow with a series."""

import sys

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cadence.kernels.base import Kernel
from cadence.kernels.states import HoldTimer
from cadence.operators import evaluate
from cadence.operators.replay import replay
from cadence.streaming import keyed


class Held(Kernel):
    """The most memory blocks of the worker since the series began, beside a window for every row."""

    inputs, output = ("ts_ms", "pose"), "held long, rows array<array<double>>"

    def __init__(self, wide: bool):
        self.wide = wide

    def start(self):
        return {"n": 0, "least": None, "most": 0}

    def step(self, s, row):
        now = sys.getallocatedblocks()
        s["n"] += 1
        if s["n"] > 600:
            s["least"] = now if s["least"] is None else min(s["least"], now)
            s["most"] = max(s["most"], now - s["least"])
        return s, [(s["most"], [[float(s["n"] + i)] * 2 for i in range(40)] if self.wide else None)]


def poses(spark, n):
    at = lambda k: ((F.col("id") * 7 + k) % 1000 / 1000.0).cast("double")
    pose = F.array(*[F.struct(at(i).alias("x"), at(i + 1).alias("y"), at(i + 2).alias("z"), at(i + 3).alias("visibility")) for i in range(33)])
    return spark.range(n, numPartitions=1).select(F.lit(1).cast("long").alias("stream_id"), (F.col("id") * 100).alias("ts_ms"), pose.alias("pose"))


@pytest.mark.parametrize("wide", [False, True])
def test_replay_holds_few_rows(spark, wide):
    got = replay(poses(spark, 9000), ["stream_id"], ["ts_ms"], Held(wide)).agg(F.count("*").alias("n"), F.max("held").alias("held")).first()
    assert got.n == 9000 and got.held < 300_000


class HeldFrames(Kernel):
    """As a counter: in place of a time, the most memory blocks while frames came, beyond those after the last one."""

    inputs, output = ("ts_ms", "pose"), "rep int, rep_ms double"

    def start(self):
        return 0

    def step(self, s, row):
        return max(s, sys.getallocatedblocks()), []

    def finish(self, s):
        return [(1, float(s - sys.getallocatedblocks()))]


def test_evaluation_holds_few_frames(spark, monkeypatch):
    monkeypatch.setitem(evaluate.REGISTRY, "held", (HeldFrames, lambda label: True))
    frames = poses(spark, 9000).withColumnsRenamed({"stream_id": "video_id"}).withColumn("frame_idx", F.col("ts_ms"))
    got = evaluate.count_reps(frames, "held").first()
    assert len(got.rep_times) == 1 and got.rep_times[0] < 300_000


class Seen(Kernel):
    """How many frames and how many controls a series has."""

    inputs, output = ("kind", "pose"), "frames int, controls int"

    def start(self):
        return [0, 0]

    def step(self, s, row):
        s[row[0] is not None] += 1
        return s, []

    def finish(self, s):
        return [tuple(s)]


def test_replay_brings_unions_together(spark):
    """Poses and controls, each partitioned by series already, of sizes that Spark coalesces differently."""
    numbered = F.row_number().over(Window.partitionBy("stream_id").orderBy("id"))
    posed = spark.range(6000).select((F.col("id") % 10).alias("stream_id"), "id", F.array(*[F.rand(k) for k in range(60)]).alias("pose")).withColumn("at", numbered)
    edge = lambda at, kind: posed.groupBy("stream_id").agg(at.alias("at")).select("stream_id", "at", F.lit(kind).alias("kind"))
    rows = posed.unionByName(edge(F.min("at") - 1, "start"), allowMissingColumns=True).unionByName(edge(F.max("at") + 1, "stop"), allowMissingColumns=True)
    got = replay(rows, ["stream_id"], ["at"], Seen()).collect()
    assert sorted(map(tuple, got)) == [(k, 600, 2) for k in range(10)]


def test_stream_holds_few_rows(spark, tmp_path):
    df = poses(spark, 9000).withColumn("at", F.timestamp_millis(F.col("ts_ms") + 1))
    far = df.limit(1).withColumns({"stream_id": F.lit(-1).cast("long"), "at": F.timestamp_millis(F.lit(10**10))})
    df.unionByName(far).write.parquet(str(tmp_path / "in"))
    out = keyed.run(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), ["stream_id"], "at", Held(True), idle_ms=20_000)
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    got = spark.read.schema(out.schema).parquet(str(tmp_path / "out")).where("stream_id = 1").agg(F.count("*").alias("n"), F.max("held").alias("held")).first()
    assert got.n == 9000 and got.held < 1_000_000


class Store:
    """State variables of one key that count the calls."""

    def __init__(self):
        self.calls, self.states, self.timers = 0, {}, set()

    def state(self, name, *_):
        return self.states.setdefault(name, Variable(self))

    getValueState = getListState = getMapState = state

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.discard(at)

    def listTimers(self):
        self.calls += 1
        return list(self.timers)


class Variable:
    def __init__(self, store):
        self.store, self.value, self.map = store, None, {}

    def __getattribute__(self, name):
        if name in ("exists", "get", "update", "put", "clear", "keys", "getValue", "containsKey", "updateValue", "removeKey"):
            self.store.calls += 1
        return object.__getattribute__(self, name)

    def exists(self):
        return self.value is not None or bool(self.map)

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value, self.map = None, {}

    def keys(self):
        return iter(list(self.map))

    def getValue(self, key):
        return self.map.get(key)

    def containsKey(self, key):
        return key in self.map

    def updateValue(self, key, value):
        self.map[key] = value

    def removeKey(self, key):
        self.map.pop(key)


def test_a_key_with_rows_far_apart_costs_few_calls(spark, monkeypatch):
    """60 rows an hour apart, kept and then taken at once."""
    import pandas as pd
    from pyspark.sql import GroupedData

    made = []
    monkeypatch.setattr(GroupedData, "transformWithStateInPandas", lambda self, p, *a, **b: made.append(p))
    hour = 3_600_000
    df = spark.range(60).select(F.lit(1).cast("long").alias("k"), (F.col("id") * hour).alias("ts_ms"), (F.col("id") % 9 < 6).alias("ok"), F.timestamp_millis(F.col("id") * hour).alias("at"))
    keyed.run(df, ["k"], "at", HoldTimer(2 * hour, hour), idle_ms=hour, bucket_ms=hour)
    p, store = made[0], Store()
    p.init(store)
    rows = [{n: v for n, v in zip(("_event_ms", "_o0", "_i0", "_i1"), (i * hour, i * hour, i * hour, i % 9 < 6), strict=True)} for i in reversed(range(60))]
    clock = lambda ms: type("T", (), {"getCurrentWatermarkInMs": lambda self: ms, "getExpiryTimeInMs": lambda self: 0})()
    assert list(p.handleInputRows((1,), iter([pd.DataFrame({"k": 1, "at": None, "_row": rows})]), clock(-1))) == []
    assert store.timers == {0} and store.calls <= 8
    store.calls = 0
    got = pd.concat(p.handleExpiredTimer((1,), clock(100 * hour), clock(0)))
    kernel, want = HoldTimer(2 * hour, hour), []
    state = kernel.start()
    for i in range(60):
        state, found = kernel.step(state, (i * hour, i % 9 < 6))
        want += found
    assert [None if v is pd.NA else v for v in got["ended_ms"].tolist()] == [w[4] for w in want] and store.calls <= 8
    assert not any(v.exists() for v in store.states.values())


def captured(monkeypatch):
    """What is handed to Spark's stateful operator: (input, processor)."""
    from pyspark.sql import GroupedData

    made = []
    monkeypatch.setattr(GroupedData, "transformWithStateInPandas", lambda self, p, *a, **b: made.append((self._df, p)))
    return made


def test_poses_travel_as_numbers(spark, monkeypatch):
    """Spark makes Python values of whole batches, so a pose takes few; nothing is lost, nor NaN taken for NULL."""
    import pandas as pd
    import pyarrow as pa

    odd = F.transform("pose", lambda p, i: F.when((F.col("ts_ms") / 100 + i) % 5 != 0, p.withField("y", F.when(i % 3 == 1, F.lit(float("nan"))).when(i % 3 == 2, p["y"]))))
    df = poses(spark, 400).withColumn("pose", F.when(F.col("ts_ms") % 700 != 0, F.when(F.col("ts_ms") % 1100 == 0, F.slice("pose", 1, 0)).otherwise(odd))).withColumn("at", F.timestamp_millis("ts_ms"))
    made = captured(monkeypatch)
    keyed.run(df, ["stream_id"], "at", Held(False))
    sent, p = made[0]
    sent, want = sent.select("_row").toArrow(), df.select("ts_ms", "pose").toArrow()
    before = sys.getallocatedblocks()
    part = sent.to_pandas()
    assert sys.getallocatedblocks() - before < 40 * 400
    got = p._rows(part)
    inputs = pa.table({"ts_ms": got.column(p.first_input), "pose": got.column(p.first_input + 1)})
    plain = lambda t: [str(r) for r in t.sort_by("ts_ms").to_pylist()]
    assert plain(inputs) == plain(want)
    assert got.slice(100).column(p.first_key).to_pylist() == [1] * 300 and p._rows(pd.DataFrame({"_row": []})).num_rows == 0


def test_many_short_series_cost_few_calls(spark, monkeypatch):
    """500 series of one bucket, kept, then finished by one timer but for one that goes on."""
    import pandas as pd

    made = captured(monkeypatch)
    df = spark.range(1).select(F.col("id").alias("k"), F.col("id").alias("ts_ms"), (F.col("id") == 0).alias("ok"), F.timestamp_millis("id").alias("at"))
    keyed.run(df, ["k"], "at", HoldTimer(50, 20), idle_ms=10_000)
    p, store = made[0][1], Store()
    p.init(store)
    times = [(k, 10 * i + k % 7 + (99_000 if k == 499 else 0), (i + k) % 9 < 6) for k in range(500) for i in range(12)]
    part = pd.DataFrame({"_row": [{"_event_ms": t, "_o0": t, "_i0": t, "_i1": ok, "_k0": k} for k, t, ok in reversed(times)]})
    clock = lambda ms: type("T", (), {"getCurrentWatermarkInMs": lambda self: ms, "getExpiryTimeInMs": lambda self: 0})()
    assert list(p.handleInputRows((3,), iter([part]), clock(-1))) == [] and store.calls <= 30
    store.calls = 0
    got = pd.concat(p.handleExpiredTimer((3,), clock(50_000), clock(0)))
    assert store.calls <= 60 and store.timers == {0, 99_002}
    got = pd.concat([got, *p.handleExpiredTimer((3,), clock(200_000), clock(99_002))])
    kernel, want = HoldTimer(50, 20), []
    for k in range(500):
        state = kernel.start()
        for _, t, ok in times[12 * k : 12 * k + 12]:
            state, found = kernel.step(state, (t, ok))
            want += [(k, *r) for r in found]
    plain = lambda rows: sorted(str(tuple(None if v is pd.NA or v is None else float(v) for v in r)) for r in rows)
    assert plain(got.itertuples(index=False)) == plain(want)
    assert not any(v.exists() for v in store.states.values())
