"""The chains from frames to reports."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadence.functions.images import crop_borders, difference_hash, hash_frames
from cadence.functions.scalars import hamming
from cadence.operators import evaluate, quality
from cadence.sources.tables import POSE, synthetic_poses
from tests.test_operators import SHEET, sheet_row


@pytest.fixture(scope="module")
def frames(spark):
    rows = []
    for video, label, reps in (("squat_1", "squat", 3), ("squat_2", "squat", 2), ("curl_1", "curl", 4)):
        t = np.arange(0, 2 + reps * 2, 1 / 15)
        depth = (1 - np.cos(2 * np.pi * np.clip(t - 1, 0, reps * 2) / 2)) / 2
        for k, (a, p) in enumerate(zip(t, synthetic_poses(depth, "squat" if label == "squat" else "curl"), strict=True)):
            rows.append((video, label, k, int(a * 1000), 640, 480, None if video == "curl_1" and k < 5 else [None if q is None else tuple(q.values()) for q in p]))
    return spark.createDataFrame(rows, f"video_id string, label string, frame_idx int, ts_ms bigint, width int, height int, pose {POSE}")


def test_counter_evaluation(spark, frames):
    sheet = [sheet_row(rep_timestamps_ms="3000;5000;7000"), sheet_row(video_id="squat_2", rep_count="3", rep_timestamps_ms="3000;5000;9000"), sheet_row(video_id="curl_1", label="curl", rep_count="4", rep_timestamps_ms="3000;5000;7000;9000", is_ambiguous="true", notes="x"), sheet_row(video_id="squat_9")]
    labels = spark.createDataFrame(sheet, SHEET)
    split = spark.createDataFrame([(v, "val") for v in ("squat_1", "squat_2", "curl_1", "squat_9")], "video_id string, split string")
    chosen = evaluate.labels_of_split(labels, split, "val")
    assert [r.video_id for r in evaluate.missing_frames(chosen, frames).collect()] == ["squat_9"]
    got = {r.video_id: r for r in evaluate.score(frames, chosen, "generic").collect()}
    assert {k: (r.predicted, r.truth, r.matched) for k, r in got.items()} == {"squat_1": (3, 3, 3), "squat_2": (2, 3, 2), "curl_1": (4, 4, 4)}
    assert abs(got["squat_1"].latency_ms) < 600
    total = {r.scope: r for r in evaluate.summary(evaluate.score(frames, chosen, "generic")).collect()}
    assert total[None].mae == pytest.approx(1 / 3) and total[None].clean_mae == 0.5 and total["squat"].recall == pytest.approx(5 / 6)
    from cadence.kernels.counters import SignalOptions

    ranked = evaluate.grid_ranking(frames, chosen, "generic", [{"options": SignalOptions(min_amplitude=99.0)}, {}]).collect()
    assert [r.params for r in ranked] == [1, 0]
    for bad in (("generic", "test"), ("none", "val")):
        with pytest.raises(ValueError):
            evaluate.guard(*bad)
    with pytest.raises(ValueError):
        evaluate.guard("generic", "train", grid=True)
    evaluate.guard("generic", "test", final=True)


def test_pose_quality(frames):
    videos = quality.video_quality(frames)
    got = {r.video_id: r for r in videos.collect()}
    assert got["curl_1"].n_frames - got["curl_1"].n_detected == 5 and got["squat_1"].side == "balanced" and got["squat_1"].vis_hip == pytest.approx(0.9)
    classes = quality.by_class(videos)
    rows = classes.collect()
    assert [r.label for r in rows] == ["curl", "squat"] and rows[1].detected_pct == 100.0
    found = {r.finding: r for r in quality.findings(classes, videos).where("finding <> 'side_share'").collect()}
    assert found["worst_class"].detail == "curl" and found["without_pose"].value == 0
    assert {r.video_id: r.detected_pct for r in quality.detection_rate(frames).collect()}["squat_1"] == 0.0
    detection = frames.sparkSession.createDataFrame([("curl", 90.0), (None, 95.0)], "label string, detected_pct double")
    assert quality.class_context(classes.select("label"), detection).orderBy("label").first().context == "below"


def test_image_hashes(spark):
    rng = np.random.default_rng(1)
    image = np.kron(rng.uniform(50, 250, (9, 12)), np.ones((8, 8)))
    framed = np.zeros((100, 140))
    framed[10 : 10 + 72, 20 : 20 + 96] = image
    assert crop_borders(framed).shape == image.shape and difference_hash(framed) == difference_hash(image)
    noisy = image + rng.normal(0, 1, image.shape)
    df = spark.createDataFrame([(im.ravel().tolist(), im.shape[1]) for im in (image, noisy, image[::-1])], "pixels array<double>, width int")
    h = [r.hash for r in hash_frames(df).collect()]
    near, far = spark.createDataFrame([(h[0], h[1]), (h[0], h[2])], "a bigint, b bigint").select(hamming(F.col("a"), F.col("b")).alias("d")).collect()
    assert near.d <= 6 < far.d


def test_feature_rows_and_dataset(spark, frames):
    from cadence.kernels.windows import reference_stages, sequence_features
    from cadence.operators import features

    rows = features.sequence_features(frames).where("video_id = 'curl_1'").orderBy("k").collect()
    raw = frames.where("video_id = 'curl_1'").orderBy("ts_ms").collect()
    poses = [None if r.pose is None else [None if p is None else p.asDict() for p in r.pose] for r in raw]
    want = sequence_features(poses, [r.ts_ms for r in raw], 640, 480)
    got = np.array([[np.nan if v is None else v for v in r.features] for r in rows])
    assert got.shape == want.shape and (np.isnan(got) == np.isnan(want)).all() and np.nanmax(np.abs(got - want)) < 1e-12
    stages = reference_stages(poses, [r.ts_ms for r in raw], 640, 480)
    assert len(stages["windows"]) == len(stages["usable"]) and stages["missing"][:3] == [True] * 3
    split = spark.createDataFrame([("squat_1", "train"), ("curl_1", "val")], "video_id string, split string")
    data = features.window_dataset(frames, split)
    assert {(r.split, r.label, r.y) for r in data.collect()} == {("train", "squat", 1), ("val", "curl", 0)}
    counts = {r.split: (r.kept, r.dropped) for r in features.window_counts(frames, split).collect()}
    assert counts["train"][0] == data.where("split = 'train'").count() and counts["train"][1] == 0


def test_support_of_many_labels(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(evaluate, "count_reps", lambda frames, name, **options: frames.select("video_id").distinct().withColumn("rep_times", F.array().cast("array<double>")))
    name = F.concat(F.lit("label "), F.col("id"))
    labels = spark.range(10_050).select(F.col("id").cast("string").alias("video_id"), name.alias("label"), F.lit("false").alias("is_ambiguous"), F.lit("").alias("rep_timestamps_ms"))
    got = evaluate.score(labels.select("video_id"), labels, "generic")
    assert got.groupBy("status").count().collect() == [("ok", 10_050)]
