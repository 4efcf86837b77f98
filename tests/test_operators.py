"""Operators that SQL does not cover, on small tables."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cadence.functions import geometry as G
from cadence.functions import scalars as S
from cadence.kernels import forms as kernel_forms
from cadence.kernels.pose import features_of
from cadence.operators import dedup, forms, labels, metrics, ordered, resample, split
from cadence.operators.graph import connected_components
from cadence.sources import sinks, tables

POSE = tables.POSE


@pytest.fixture(scope="module")
def poses(spark):
    made = tables.synthetic_poses(np.array([0.0, 0.3, 0.7, 1.0, np.nan, 0.5]))
    made[3][23]["visibility"] = made[3][25]["visibility"] = 0.2
    made[2][15]["x"] = float("nan")
    rows = [(k, None if p is None else [None if q is None else tuple(q.values()) for q in p], 640, 480) for k, p in enumerate(made)]
    return spark.createDataFrame(rows, f"id int, pose {POSE}, width int, height int"), made


def test_features_equal_numpy(spark, poses):
    df, made = poses
    points = G.select_landmarks(F.col("pose"), F.col("width"), F.col("height"))
    got = df.select("id", G.frame_features(G.normalize_points(points)).alias("f"), G.no_pose(F.col("pose")).alias("none"), G.visible_count(F.col("pose")).alias("seen")).orderBy("id").collect()
    for r in got:
        want = features_of(made[r.id], 640, 480)
        have = np.array([np.nan if v is None else v for v in r.f])
        assert (np.isnan(have) == np.isnan(want)).all() and np.nanmax(np.abs(have - want), initial=0) < 1e-9
    assert [r.none for r in got] == [False] * 4 + [True, False] and got[3].seen == 11
    m = df.select("id", G.motion_vector(G.frame_features(G.normalize_points(points))).alias("m"), G.mirror(G.mirror(G.frame_features(G.normalize_points(points)))).alias("mm")).orderBy("id").collect()
    assert [r.m is None for r in m] == [False, False, True, False, True, False] and m[0].mm[3] == pytest.approx(got[0].f[3])


def test_form_columns_equal_kernel(spark, poses):
    df, made = poses
    labelled = df.crossJoin(spark.createDataFrame([(k,) for k in kernel_forms.BY_LABEL], "label string"))
    got = {(r.id, r.rule_id): (r.side, r.value, r.broken) for r in forms.evaluate_rules(labelled).collect()}
    for label, rules in kernel_forms.BY_LABEL.items():
        for k, p in enumerate(made):
            e = kernel_forms.evaluate(p, rules, 640, 480)
            values = dict((r.id, v) for r, v in e.values)
            for r in rules.rules:
                side, value, broken = got[k, r.id]
                want = values.get(r.id)
                assert side == e.side and (value is None) == (want is None) and broken == (r.id in e.broken)
                assert value is None or value == pytest.approx(want)
    assert forms.with_names(spark.createDataFrame([("plank",), ("x",)], "label string")).orderBy("label").select("name").collect() == [("Plank",), ("x",)]
    q = forms.pose_quality(df).select("quality").collect()
    assert [r.quality for r in q].count("no-pose") == 1
    m = forms.measure_exercise(df, ["hip", "knee", "ankle"], lean=45.0, line=(["shoulder", "hip", "ankle"], 175.0)).orderBy("id").collect()
    assert m[0].angle > m[1].angle > 90 and m[4].angle is None and "body-line" in m[2].warnings


def test_scalars(spark):
    df = spark.createDataFrame([(" T Bar  Row ", "push-up_17.mp4", "1;; 2;x", float("nan"))], "a string, b string, c string, d double")
    r = df.select(
        S.snake_case(F.col("a")).alias("a"), S.snake_case(S.file_stem(F.lit("x/push-up_17.mp4"))).alias("b"), S.int_list(F.col("c")).alias("c"), S.finite(F.col("d")).alias("d"), S.arccos_degrees(F.lit(None).cast("double")).alias("e"),
        S.fnv1a(F.lit("push_up_17")).alias("f"), S.fnv1a(F.lit("é🙂")).alias("g"), S.rises(F.array(F.lit(1), F.lit(2), F.lit(2))).alias("h"), S.rises(F.array().cast("array<int>")).alias("i"), S.fit_within(F.lit(1280), F.lit(720), 640).alias("j"),
        S.next_speed(F.lit(2.0), F.lit(1)).alias("k"), S.rounded_json(F.array(F.lit(1.23456789), F.lit(float("nan")), F.lit(None).cast("double")), 3).alias("l"), S.int_or_null(F.lit(" 7 ")).alias("m"), S.set_badge(F.lit(5), F.lit(None).cast("int")).alias("n"),
    ).first()

    def fnv(text):
        h, raw = 2166136261, text.encode("utf-16-be")
        for k in range(0, len(raw), 2):
            h = (h ^ int.from_bytes(raw[k : k + 2], "big")) * 16777619 & 0xFFFFFFFF
        return h

    assert (r.a, r.b, r.c, r.d, r.e) == ("t_bar_row", "push_up_17", [1, 2, None], None, None)
    assert (r.f, r.g) == (fnv("push_up_17"), fnv("é🙂")) and not r.h and r.i and tuple(r.j) == (640, 360) and r.k == 2.0
    assert json.loads(r.l) == [1.235, None, None] and r.m == 7 and r.n == "5/5"


def test_components_and_pairs(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + k, 1001 + k) for k in range(120)] + [(5000, k) for k in range(5001, 5200)] + [(7, 7), (None, 8)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    find(8)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: find(x) for x in root}
    base = [int(v) for v in rng.integers(-(2**63), 2**63 - 1, 40)]
    rows = [(k, [base[k % 40] ^ int(sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 7), replace=False))), base[k % 7]]) for k in range(120)] + [(500, None), (501, [1, None])]
    df = spark.createDataFrame(rows, "id int, hashes array<bigint>")
    good = [r for r in rows if r[1] and None not in r[1]]
    dist = lambda a, b: sum(bin((x ^ y) & (2**64 - 1)).count("1") for x, y in zip(a, b, strict=True)) / 2
    want = {(a[0], b[0]) for a in good for b in good if a[0] < b[0] and dist(a[1], b[1]) <= 4}
    found = {(r.a, r.b) for r in dedup.near_pairs(df, 4).collect()}
    first = {}
    for i, h in good:
        first.setdefault(tuple(h), i)
    assert found == {(a, b) for a, b in want if first[tuple(dict(good)[a])] == a and first[tuple(dict(good)[b])] == b}
    groups = dedup.duplicate_groups(df, 4).collect()
    assert len(groups) == len(rows) and all(r.group_id.startswith("g0") for r in groups)


def test_split(spark):
    rows, k = [], 0
    for label, n in (("a", 62), ("b", 33), ("c", 20), ("d", 7), ("e", 2)):
        for i in range(n):
            rows.append((f"v{k}", label, f"{label}{i - (i % 4 == 3)}"))
            k += 1
    videos = spark.createDataFrame(rows, "video_id string, label string, group_id string")
    for exact in (False, True):
        out = split.stratified_split(videos, exact=exact)
        got = out.collect()
        assert len(got) == len(rows)
        assert all(len({r.split for r in got if r.group_id == g}) == 1 for g in {r.group_id for r in got})
        counts = {r.label: r for r in split.split_counts(out).collect()}
        assert (counts["a"].train, counts["a"].val, counts["a"].test) == (44, 9, 9) and counts["e"].train == 2
        assert {(r.label, r.problem) for r in split.split_exceptions(split.split_counts(out)).collect()} >= {("d", "small class"), ("e", "no val"), ("e", "no test")}
    t = spark.createDataFrame([(62,), (7,), (3,), (2,)], "n int").select(split.split_targets(F.col("n")).alias("t")).collect()
    assert [tuple(r.t) for r in t] == [(44, 9, 9), (5, 1, 1), (1, 1, 1), (2, 0, 0)]
    assert split.group_histogram(videos).collect()


def test_selection(spark):
    rows = [(f"v{k:02d}", "ab"[k % 2], f"g{k // 3}", ["mp4", "mov"][k % 5 == 0], float(k + 1), None if k % 7 else 0.0) for k in range(40)]
    pool = spark.createDataFrame(rows, "video_id string, label string, group_id string, ext string, duration_s double, detected_pct double")
    kept, gone = split.by_known_rate(pool)
    assert kept.count() + gone.count() == 40 and gone.count() == 6
    chosen = split.pick_diverse(kept, 5)
    got = chosen.collect()
    assert [r.label for r in got] == ["a"] * 5 + ["b"] * 5 and all(len({r.group_id for r in got if r.label == x}) == 5 for x in "ab")
    assert got == split.pick_diverse(kept.repartition(7), 5).collect()
    assert split.shortfalls(kept, chosen, 6).count() == 2 and split.shortfalls(kept, chosen, 5).count() == 0
    assert split.hash_sample(pool, "video_id").count() == 4


SHEET = "video_id string, label string, rep_count string, rep_timestamps_ms string, hold_start_ms string, hold_end_ms string, is_ambiguous string, notes string, labeler string, labeled_at string"


def sheet_row(**change):
    base = {"video_id": "squat_1", "label": "squat", "rep_count": "3", "rep_timestamps_ms": "2000;4500;7000", "hold_start_ms": "", "hold_end_ms": "", "is_ambiguous": "false", "notes": "", "labeler": "gk", "labeled_at": "2026-10-02T09:15:00.000Z"}
    return tuple((base | change).values())


HOLD = {"video_id": "plank_1", "label": "plank", "rep_count": "", "rep_timestamps_ms": "", "hold_start_ms": "1500", "hold_end_ms": "38000"}


@pytest.mark.parametrize(("change", "n"), [
    ({}, 0), (HOLD, 0), ({"rep_count": "2"}, 1), ({"rep_count": "x"}, 1), ({"rep_timestamps_ms": "2000;4500;y"}, 1), ({"rep_timestamps_ms": "2000;2000;7000"}, 1), ({"rep_timestamps_ms": "2000;4500;10250"}, 0),
    ({"rep_timestamps_ms": "2000;4500;10251"}, 1), ({"hold_end_ms": "5"}, 1), ({"rep_count": "0", "rep_timestamps_ms": ""}, 1), ({"rep_count": "0", "rep_timestamps_ms": "", "is_ambiguous": "true", "notes": "dark"}, 0),
    ({"is_ambiguous": "true"}, 1), ({"is_ambiguous": "maybe"}, 1), ({"labeler": " "}, 1), ({"labeled_at": "soon"}, 1), ({"label": "plank"}, 1), ({"video_id": "none"}, 1), (HOLD | {"hold_end_ms": ""}, 1),
    (HOLD | {"hold_end_ms": "1500"}, 1), (HOLD | {"rep_count": "1"}, 1), (HOLD | {"hold_start_ms": "a"}, 1),
])
def test_label_rules(spark, change, n):
    manifest = spark.createDataFrame([("squat_1", "squat", 10.0), ("plank_1", "plank", 40.0)], "video_id string, label string, duration_s double")
    found = labels.label_problems(spark.createDataFrame([sheet_row(**change)], SHEET), manifest).collect()
    assert len(found) == n, found


def test_label_editing_and_agreement(spark):
    manifest = spark.createDataFrame([("squat_1", "squat", 10.0)], "video_id string, label string, duration_s double")
    twice = spark.createDataFrame([sheet_row(), sheet_row()], SHEET)
    assert labels.label_problems(twice, manifest).count() == 1
    assert labels.label_problems(twice.drop("notes"), manifest).first()[0] == "-"
    log = [("a", 0, "add", 1000, None, None), ("a", 1, "add", 1100, None, None), ("a", 2, "add", 500, None, None), ("a", 3, "add", 3000, None, None), ("a", 4, "undo", None, None, None), ("b", 0, "hold_start", 5, None, None), ("b", 1, "hold_end", 900, None, None), ("c", 0, "ambiguous", None, True, "dark"), ("d", 0, "undo", None, None, None)]
    edited = labels.replay_edits(spark.createDataFrame(log, "video_id string, seq int, kind string, at_ms bigint, flag boolean, text string"))
    got = {r.video_id: r for r in edited.collect()}
    assert got["a"].marks == [500, 1000] and [got[k].status for k in "abcd"] == ["done", "done", "ambiguous", "todo"] and got["b"].hold_end_ms == 900
    kinds = spark.createDataFrame([("a", "squat", 2.0), ("b", "plank", 2.0), ("c", "squat", 2.0), ("d", "squat", 2.0)], "video_id string, label string, duration_s double")
    assert [r.video_id for r in labels.export_problems(edited, kinds).collect()] == ["d"]
    sheet = labels.to_sheet(edited, kinds, "gk", F.lit("2026-10-02T09:15:00Z"))
    assert labels.from_sheet(sheet).where("video_id = 'a'").first().marks == [500, 1000]
    other = spark.createDataFrame([sheet_row(rep_count="2", rep_timestamps_ms="2100;7400")], SHEET)
    a = labels.agreement(spark.createDataFrame([sheet_row()], SHEET), other).first()
    assert (a.n_videos, a.exact, a.off_by_one, a.mae) == (1, 0.0, 1.0, 1.0) and a.timing_match == pytest.approx(1 / 3)
    pairs = spark.createDataFrame([([1000, 2500], [1900, 3400, 9000])], "p array<bigint>, t array<bigint>")
    m = pairs.select(labels.greedy_matches(F.col("p"), F.col("t"), 1000).alias("g"), labels.pointer_matches(F.col("p"), F.col("t"), 1000).alias("w")).first()
    assert [(x.i, x.j) for x in m.g] == [(0, 1)] and m.w == 2
    s = labels.class_summary(spark.createDataFrame([sheet_row(), sheet_row(**HOLD)], SHEET)).orderBy("label").collect()
    assert (s[0].unit, s[0].mean) == ("hold seconds", 36.5) and (s[1].unit, s[1].mean) == ("reps", 3.0)


def test_ordered_rest(spark):
    rows = [("a", k, v) for k, v in enumerate([1.0, None, None, 4.0, None, None, None, None, None, None, 9.0, None])]
    df = spark.createDataFrame(rows, "key string, k int, v double")
    got = [r.v for r in resample.fill_gaps(df, "key", "k", ["v"]).orderBy("k").collect()]
    assert got == [1.0, 2.0, 3.0, 4.0, None, None, None, None, None, None, 9.0, None]
    starts = spark.createDataFrame([(29,), (30,), (60,)], "n int").select(resample.window_starts(F.col("n"), 30, 15).alias("s")).collect()
    assert [r.s for r in starts] == [[], [0], [0, 15, 30]]
    scaled = spark.range(1).select(ordered.time_scale(F.array(*[F.lit(float(k)) for k in range(5)]), F.lit(1.5)).alias("s")).first().s
    assert scaled == [0.0, 1.5, 3.0, 4.0, 4.0]
    entries = spark.createDataFrame([(k, k in (1, 2)) for k in range(5)], "i int, done boolean")
    assert ordered.next_open(entries, "i", F.col("done"), 0, 5).first().next == 3
    assert ordered.count_rises(spark.createDataFrame([("a", k, c) for k, c in enumerate([0, 1, 1, 2])], "key string, k int, c int"), "key", ["k"], "c").count() == 2
    w = metrics.within(spark.createDataFrame([("a", 1000), ("a", 5000)], "k string, p long"), spark.createDataFrame([("a", 2000), ("a", 5999), ("b", 1000)], "k string, t long"), "k", "p", "t", 1000)
    assert sorted((r.p, r.t) for r in w.collect()) == [(1000, 2000), (5000, 5999)]


def test_sources_and_sinks(spark, tmp_path):
    for name in ("Push Up/push-up_1.mp4", "Push Up/push-up_1.mov", "squat/a b.webm", "squat/notes.txt"):
        (tmp_path / "media" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "media" / name).write_bytes(b"123")
    files = tables.scan_media(spark, str(tmp_path / "media"))
    assert [(r.label, r.video_id, r.ext) for r in files.collect()] == [("push_up", "push_up_1", "mov"), ("push_up", "push_up_1", "mp4"), ("squat", "a_b", "webm")]
    assert [r.ext for r in tables.pick_files(files).orderBy("video_id").collect()] == ["webm", "mp4"]

    def probe(path):
        if path.endswith("webm"):
            raise OSError("broken")
        return {"fps": 30.0, "n_frames": 90, "duration_s": 3.0, "width": 640, "height": 480}

    manifest = tables.probe(files, probe)
    assert {r.ext: r.error for r in manifest.collect()} == {"mov": "", "mp4": "", "webm": "OSError: broken"} and tables.conflicting_ids(manifest).count() == 1
    marks = np.full((4, 33, 4), np.nan, np.float32)
    marks[:3] = 0.5
    marks[2, 5] = np.nan
    (tmp_path / "k" / "squat").mkdir(parents=True)
    np.savez_compressed(tmp_path / "k" / "squat" / "s1.npz", landmarks=marks, timestamps_ms=np.arange(4) * 33, width=640, height=480)
    frames = tables.keypoint_archives(spark, str(tmp_path / "k"))
    got = frames.orderBy("frame_idx").collect()
    assert [r.pose is None for r in got] == [False, False, False, True] and got[2].pose[5].x is None and got[0].label == "squat"
    wanted = spark.createDataFrame([("s1",), ("s2",)], "video_id string")
    docs, missing = sinks.export_labelled(frames, wanted)
    doc = json.loads(docs.first().json)
    assert doc["landmarks"][3] is None and doc["landmarks"][2][5] == [None] * 4 and doc["timestamps_ms"] == [0, 33, 66, 99] and missing.first().video_id == "s2"
    (tmp_path / "l.csv").write_text('video_id,label,rep_count,rep_timestamps_ms,hold_start_ms,hold_end_ms,is_ambiguous,notes,labeler,labeled_at\r\na,squat,1,5,,,false,"x ""y""\nz",gk,t\r\n\r\nb,squat\r\n')
    sheet = tables.read_sheet(spark, str(tmp_path / "l.csv")).orderBy("video_id").collect()
    assert sheet[0].notes == 'x "y"\nz' and sheet[0].hold_end_ms == "" and sheet[1].notes == "" and len(sheet) == 2
    (tmp_path / "s.json").write_text(json.dumps({"version": "v1", "splits": {"train": ["a"], "val": ["b", "c"], "test": []}}))
    assert {(r.video_id, r.split) for r in tables.read_split(spark, str(tmp_path / "s.json")).collect()} == {("a", "train"), ("b", "val"), ("c", "val")}
    made = json.loads(sinks.split_document(spark.createDataFrame([("b", "g", "val"), ("a", "g", "train")], "video_id string, group_id string, split string"), 42).first().json)
    assert made["splits"] == {"train": ["a"], "val": ["b"], "test": []} and made["groups"] == {"a": "g", "b": "g"}
    h = tables.parse_history(spark.createDataFrame([('[{"label":"squat","reps":3}]',), ("oops",), (None,)], "t string"), "t", "struct<label:string,reps:int>")
    assert h.collect() == [("squat", 3)]
    sinks.write_by_label(frames.select("video_id", "label", "ts_ms"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4
    assert sinks.markdown(spark.createDataFrame([(1, 0.5, None)], "a int, b double, c string"), "T").splitlines()[-1] == "| 1 | 0.500 | - |"
    q = spark.createDataFrame([("a,b",), ("plain",)], "t string").select(sinks.quoted(F.col("t")).alias("q")).collect()
    assert [r.q for r in q] == ['"a,b"', "plain"]
    m = tables.synthetic_movement(spark, 3, reps=2)
    assert m.groupBy("stream_id").agg(F.max("value")).collect()[0][1] == pytest.approx(0.5)


def test_model_hook(spark):
    from cadence.operators.models import class_scores, summary_features

    rows = [(k, [[float(np.sin(2 * np.pi * 0.5 * (1 + k) * t / 15)) for _ in range(47)] for t in range(30)]) for k in range(3)]
    df = spark.createDataFrame(rows, "video_id int, rows array<array<double>>")
    got = summary_features(df).orderBy("video_id").collect()
    assert all(len(r.summary) == 243 for r in got)
    assert [round(r.summary[-1] * 2) for r in got] == [1, 2, 3]
    scored = class_scores(df, lambda x: np.stack([x.mean((1, 2)), x.std((1, 2))], 1))
    assert all(len(r.scores) == 2 for r in scored.collect()) and isinstance(got[0].summary[0], float)
    assert pd.notna(got[0].summary[0])


def test_ladders_give_each_group_to_the_split_that_lacks_most():
    import numpy as np

    from cadence.operators.split import ladders

    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 7, 60, 400):
        sizes = np.sort(rng.integers(1, 6, n))[::-1]
        total = int(sizes.sum())
        goal = np.array([total - 2 * round(total * 0.15), round(total * 0.15), round(total * 0.15)])
        lack, want = goal.copy(), []
        for s in sizes:
            want.append(int(lack.argmax()))
            lack[want[-1]] -= s
        assert ladders(sizes, goal).tolist() == want


def _greedy(sizes, goal):
    lack, out = np.array(goal), []
    for s in sizes:
        out.append(int(lack.argmax()))
        lack[out[-1]] -= s
    return out


def test_run_plans_are_the_greedy_choice_in_few_numbers():
    rng = np.random.default_rng(6)
    for _ in range(300):
        sizes = np.sort(rng.choice(rng.integers(1, 60, 4), rng.integers(1, 90)))[::-1]
        goal = rng.integers(0, 1 + int(sizes.sum()), 3) if rng.random() < 0.5 else [int(sizes.sum()) - 8, 4, 4]
        of, counts = np.unique(-sizes, return_counts=True)
        got = []
        for m, (alone, pairs, order) in zip(counts, split.run_plan(-of, counts, goal), strict=True):
            got += [order[0 if p < alone else 1 - (p - alone) % 2 if p < pairs else 2 + (p - pairs) % 3] for p in range(m)]
        assert got == _greedy(sizes, goal)
    alone, pairs, order = split.run_plan(np.array([1]), np.array([10**12]), np.array([7 * 10**11, 15 * 10**10, 15 * 10**10]))[0]
    assert alone == 7 * 10**11 - 15 * 10**10 + 1 and sorted(order[2:]) == [0, 1, 2]


def test_split_of_one_large_label_is_the_greedy_one(spark):
    import hashlib
    from collections import Counter, defaultdict

    rows = [(f"v{k}", "hot" if k % 3 else f"rare{k % 5}", f"{'h' if k % 3 else f'r{k % 5}'}-{k // (2 + k % 4)}") for k in range(1500)] + [("x", None, "gone"), ("y", "hot", None), ("v0", "rare0", "r0-0")]
    videos = spark.createDataFrame(rows, "video_id string, label string, group_id string")
    got = split.stratified_split(videos.repartition(5)).collect()
    members = defaultdict(Counter)
    for _, label, group in rows:
        if group is not None and label is not None:
            members[group][label] += 1
    groups = [(min(c, key=lambda x: (-c[x], x)), sum(c.values()), g) for g, c in members.items()]
    want = {}
    for label in {g[0] for g in groups}:
        own = sorted((-n, hashlib.md5(f"42:{label}:{g}".encode()).hexdigest(), g) for at, n, g in groups if at == label)
        total = -sum(n for n, _, _ in own)
        part = max(1, round(total * 0.15)) if total >= 3 else round(total * 0.15)
        want |= {g: split.SPLITS[s] for (_, _, g), s in zip(own, _greedy([-n for n, _, _ in own], [total - 2 * part, part, part]), strict=True)}
    assert len(got) == len(rows) - 2 and all(r.split == want[r.group_id] for r in got)
    assert split.stratified_split(videos.limit(0)).count() == 0


def test_diverse_rows_are_the_greedy_ones(spark):
    import hashlib
    import math

    rng = np.random.default_rng(9)
    times = [1.0, 2.0, 4.0, 8.0, 50.0, 0.01, None, float("nan"), float("inf")]
    rows = [(f"v{k:03d}", ["a", "a", "a", "b", None][k % 5], [None, "g1", "g2", "g3"][int(rng.integers(0, 4))], ["mp4", "mov", None][int(rng.integers(0, 3))], times[int(rng.integers(0, 9))]) for k in range(160)]
    rows += [rows[3]] * 3 + [("solo", "c", "g", "mp4", None), ("pair1", "d", "g", "mp4", 3.0), ("pair2", "d", "g", "mp4", 12.0)]
    pool = spark.createDataFrame(rows, "video_id string, label string, group_id string, ext string, duration_s double")
    finite = lambda x: x is not None and math.isfinite(x)
    want = []
    for label in {r[1] for r in rows}:
        own = [r for r in rows if r[1] == label]
        known = [r[4] for r in own if finite(r[4])]
        fill = float(np.median(known)) if known else 1.0
        length = [math.log(max(0.1, r[4] if finite(r[4]) else fill)) for r in own]
        turn = [hashlib.md5(":".join(x for x in ("42", label, r[0]) if x is not None).encode()).hexdigest() for r in own]
        chosen = [min(range(len(own)), key=lambda i: (round(abs(length[i] - np.median(length)), 12), turn[i]))]
        while len(chosen) < min(6, len(own)):
            rest = [i for i in range(len(own)) if i not in chosen]
            seen = lambda i, f: any(own[c][f] == own[i][f] for c in chosen)
            chosen.append(min(rest, key=lambda i: (seen(i, 2), seen(i, 3), -round(min(abs(length[i] - length[c]) for c in chosen), 12), turn[i])))
        want += [(own[i][1], own[i][0]) for i in chosen]
    got = [(r.label, r.video_id) for r in split.pick_diverse(pool.repartition(3), 6).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert split.pick_diverse(pool.limit(0), 3).count() == 0 and split.pick_diverse(pool, 0).count() == 0


def test_edit_log_of_one_key_against_a_plain_replay(spark):
    """20,000 events of one key, 200 of another, missing times among them, and a key of null."""
    rng = np.random.default_rng(11)
    kinds = ["add"] * 6 + ["undo", "hold_start", "hold_end", "clear_hold", "ambiguous", None]
    rows = [(v, k, kinds[int(rng.integers(0, 12))], None if rng.random() < 0.05 else int(rng.integers(0, 400_000)), [True, False, None][int(rng.integers(0, 3))], ["why", None][k % 2]) for v, n in (("long", 20_000), ("short", 200), (None, 9)) for k in range(n)]
    want = {}
    for v, _, kind, at, flag, text in rows:
        s = want.setdefault(v, {"marks": [], "h0": None, "h1": None, "amb": False, "notes": ""})
        if kind == "add" and at is not None and not any(abs(m - at) < 150 for m in s["marks"]):
            s["marks"].append(at)
        elif kind == "undo" and s["marks"]:
            s["marks"].pop()
        elif kind == "hold_start":
            s["h0"] = at
        elif kind == "hold_end":
            s["h1"] = at
        elif kind == "clear_hold":
            s["h1" if s["h1"] is not None else "h0"] = None
        elif kind == "ambiguous":
            s["amb"], s["notes"] = bool(flag), text or ""
    log = spark.createDataFrame(rows, "video_id string, seq int, kind string, at_ms bigint, flag boolean, text string")
    got = {r.video_id: {"marks": r.marks, "h0": r.hold_start_ms, "h1": r.hold_end_ms, "amb": r.is_ambiguous, "notes": r.notes} for r in labels.replay_edits(log.repartition(6)).collect()}
    assert got == {v: s | {"marks": sorted(s["marks"])} for v, s in want.items()}
    assert labels.replay_edits(log.limit(0)).count() == 0


def test_grid_of_thresholds_in_one_pass(spark):
    from cadence.operators.metrics import hysteresis_grid, parameter_grid

    named = parameter_grid(spark, {"low": [10.0, 20.0], "high": [60.0, 80.0]}).orderBy("params").collect()
    assert [tuple(r) for r in named] == [(0, 10.0, 60.0), (1, 10.0, 80.0), (2, 20.0, 60.0), (3, 20.0, 80.0)]
    rng = np.random.default_rng(3)
    rows = [(["a", "b", None][k % 3], int(k), None if rng.random() < 0.1 else float(rng.integers(0, 100)), bool(rng.random() < 0.1)) for k in range(600)]
    df = spark.createDataFrame(rows, "key string, k long, v double, hit boolean")
    pairs, want = [(10.0, 60.0), (30.0, 60.0), (30.0, 95.0)], set()
    for p, (low, high) in enumerate(pairs):
        for key in ("a", "b", None):
            n, down = 0, False
            for v in (r[2] for r in rows if r[0] == key):
                if v is not None and v <= low:
                    down = True
                elif v is not None and v >= high:
                    n, down = n + down, False
            want.add((p, key, n, abs(n - sum(r[3] for r in rows if r[0] == key))))
    out = hysteresis_grid(df.repartition(5), "key", ["k"], "v", F.col("hit"), pairs)
    assert set(map(tuple, out.collect())) == want
    plan = hysteresis_grid(df, "key", ["k"], "v", F.col("hit"), pairs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "NestedLoop" not in plan
    assert hysteresis_grid(df.limit(0), "key", ["k"], "v", F.col("hit"), pairs).count() == 0


def test_ticks_come_in_blocks(spark):
    size = resample.TICKS
    spans = {"none": 0, "edge": size - 1, "over": size, "long": 3 * size + 5}
    df = spark.createDataFrame([(k, t) for k, n in spans.items() for t in (100.0, 100.0 + 10 * n + 9)] + [("null", None)], "key string, t double")
    got = resample.grid(df, "key", "t", 10.0).groupBy("key").agg(F.count("*").alias("n"), F.count_distinct("k").alias("d"), F.min("k").alias("low"), F.max("k").alias("high"), F.max("grid_ms").alias("end")).collect()
    assert {tuple(r) for r in got} == {(k, n + 1, n + 1, 0, n, 100.0 + 10 * n) for k, n in spans.items()}


def test_long_series_of_one_key(spark):
    """100,000 rows of one key: frames that start at each row would take hours."""
    from pyspark.sql import functions as F

    from cadence.operators import resample

    n = 100_000
    rows = spark.range(n).select(F.lit(1).alias("k0"), (F.col("id") * 40 + F.col("id") % 7).alias("t"), F.when(F.col("id") % 5 != 3, F.col("id") * 1.0).alias("v"))
    near = resample.resample_nearest(rows, "k0", "t", ["v"], 50.0)
    filled = resample.fill_gaps(near, "k0", "k", ["v"])
    out = filled.agg(F.count("*"), F.count("v")).first()
    assert out[0] == (40 * (n - 1) + (n - 1) % 7) // 50 + 1 and out[1] >= out[0] - 10
    assert resample.sample_and_hold(rows, "k0", "t", ["v"], 50.0, arrival=True).count() == out[0]
    windows = resample.hopping_windows(filled, "k0", "k", ["v"])
    assert windows.count() == (out[0] - 30) // 15 + 1 and windows.where(F.size("rows") != 30).count() == 0


def test_near_pairs_at_wide_thresholds(spark):
    import numpy as np

    from cadence.operators.dedup import near_pairs

    rng = np.random.default_rng(2)
    base = rng.integers(-(2**63), 2**63, 12)
    hashes = []
    for k in range(240):
        h = int(base[k % 12]) & (2**64 - 1)
        for bit in rng.choice(64, rng.integers(0, 9), replace=False):
            h ^= 1 << int(bit)
        hashes.append(h - 2**64 if h >= 2**63 else h)
    df = spark.createDataFrame([(k, [h]) for k, h in enumerate(hashes)], "id long, hashes array<long>")
    first = {}
    for k, h in enumerate(hashes):
        first.setdefault(h, k)
    for t in (0, 3, 10, 13):
        want = sorted((a, b) for h, a in first.items() for g, b in first.items() if a < b and bin((h ^ g) & (2**64 - 1)).count("1") <= t)
        assert sorted((r.a, r.b) for r in near_pairs(df, t).collect()) == want


def test_bands_lose_no_pair_and_meet_few_strangers():
    from cadence.operators.dedup import bands_for

    for t in range(65):
        for rows in (0, 1, 10**3, 10**6, 10**9):
            bands = bands_for(rows, t)
            assert [b.start for b in bands] == [sum(x.width for x in bands[:k]) for k in range(len(bands))] and sum(b.width for b in bands) == 64
            assert sum(b.left + b.right + 1 for b in bands) == t + 1 or t == 64
    for t, share in ((6, 0.01), (10, 0.15)):
        met = {rows: sum(b.meetings(rows) for b in bands_for(rows, t)) for rows in (10**4, 10**6, 10**8)}
        assert met[10**6] < 100 * met[10**4] * 0.15 and met[10**8] < 10**4 * met[10**4] * share and met[10**8] < 1e5


def test_near_pairs_of_any_scheme_are_the_same(spark, monkeypatch):
    """The schemes that large tables get, on a small one; rows of several hashes and of different numbers of them."""
    rng = np.random.default_rng(8)
    base = [[int(v) for v in rng.integers(0, 2**63, 3)] for _ in range(9)]
    rows = []
    for k in range(150):
        own = [h ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 8), replace=False)) for h in base[k % 9]]
        rows.append((k, [h - 2**64 if h >> 63 else h for h in own][: 2 + (k % 5 > 0)]))
    df = spark.createDataFrame(rows, "id long, hashes array<long>")
    mean = lambda a, b: sum(bin((x ^ y) & (2**64 - 1)).count("1") for x, y in zip(a, b, strict=True)) / len(a)
    choose = dedup.bands_for
    for t in (4, 7.5):
        want = sorted((a, b, mean(g, h)) for a, g in rows for b, h in rows if a < b and len(g) == len(h) and mean(g, h) <= t)
        assert want
        for pretended in (10, 10**6, 10**8):
            monkeypatch.setattr(dedup, "bands_for", lambda n, reach, as_if=pretended: choose(as_if, reach))
            assert sorted((r.a, r.b, r.distance) for r in dedup.near_pairs(df, t).collect()) == want


def test_report_of_too_many_rows_is_an_error(spark):
    import pytest

    from cadence.sources.sinks import markdown

    assert "| 2 |" in markdown(spark.range(3), "three")
    with pytest.raises(ValueError, match="more than 2"):
        markdown(spark.range(3), "three", 2)


def test_main_axes(spark):
    import numpy as np

    from cadence.operators.metrics import main_axes

    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, 5)) * [1, 3, 1, 1, 1] + 7
    df = spark.createDataFrame([(k % 2, v.tolist()) for k, v in enumerate(x)] + [(0, None)], "g int, e array<double>").repartition(7)
    for r in main_axes(df, "g", "e").collect():
        c = np.cov(x[r.g :: 2].T, bias=True)
        w, v = np.linalg.eigh(c)
        assert abs(r.variance - w[-1]) < 1e-9 and abs(abs(np.dot(r.axis, v[:, -1])) - 1) < 1e-9 and max(r.axis, key=abs) > 0


def test_closest_pairs_of_long_series():
    import numpy as np

    from cadence.operators.labels import closest_pairs

    rng = np.random.default_rng(3)
    for n, m in ((0, 3), (3, 0), (40, 50), (60, 20)):
        p, t = np.sort(rng.integers(0, 900, n)).astype(float), np.sort(rng.integers(0, 900, m)).astype(float)
        pairs = sorted((abs(a - b), i, j) for i, b in enumerate(t) for j, a in enumerate(p) if abs(a - b) <= 30)
        used, want = (set(), set()), []
        for d, i, j in pairs:
            if i not in used[0] and j not in used[1]:
                used[0].add(i)
                used[1].add(j)
                want.append((int(d), i, j))
        assert [(x["d"], x["i"], x["j"]) for x in closest_pairs(p, t, 30)] == want
    long = np.arange(0, 4_000_000, 20.0)
    assert len(closest_pairs(long, long + 3, 50)) == len(long)


def test_exact_quantiles_by_cells(spark, monkeypatch):
    """Values of ranks come from cells, also among ties, hot values and doubles far apart."""
    import random

    from cadence.operators import metrics

    rng = random.Random(8)
    values = [rng.gauss(0, 1) for _ in range(900)] + [0.25] * 500 + [1e300, -1e300, 1.7e308, -1.7e308, 5e-324, 0.0] + [rng.choice([1.0, 2.0]) for _ in range(200)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),), (float("inf"),)], "v double")
    monkeypatch.setattr(metrics, "FEW", 20)
    ordered = sorted(values)
    n = len(values)
    got = metrics.nth_values(df.where("v is not null and not isnan(v) and abs(v) < double('Infinity')"), "v", [0, 1, 700, n // 2, n - 1])
    assert got == {r: ordered[r] for r in (0, 1, 700, n // 2, n - 1)}
    tiny = spark.createDataFrame([(5e-324 * (k % 2),) for k in range(60)], "v double")
    assert metrics.nth_values(tiny, "v", [0, 29, 30, 59]) == {0: 0.0, 29: 0.0, 30: 5e-324, 59: 5e-324}
    r = metrics.describe(df.where("abs(v) < 1e200"), "v").first()
    few = sorted(v for v in values if abs(v) < 1e200)
    at = 0.95 * (len(few) - 1)
    assert r.n == len(few) and r.median == pytest.approx((few[(len(few) - 1) // 2] + few[len(few) // 2]) / 2)
    assert r.p95 == pytest.approx(few[int(at)] + (few[int(at) + 1] - few[int(at)]) * (at - int(at)))
    assert metrics.describe(df.limit(0), "v").first().n == 0
