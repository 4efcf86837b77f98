import zlib

import numpy as np

from cadence.llm.quality import features, keep_good, op10_quality_votes, score, score_documents, train

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in op10_quality_votes(spark, SF).collect()}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    held = [r for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert all(got[r.doc_id].held_out for r in held)
    right = [(got[r.doc_id].predicted == r.quality) for r in held]
    assert np.mean(right) > 0.93
    assert all(got[r.doc_id].predicted for r in held if r.quality == 1)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())


def test_vote_is_the_exact_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    model = train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    import pyarrow as pa

    rows = docs.select("text").collect()
    x = features(pa.array([r.text for r in rows]))
    got = score(model, x, block=7)
    from cadence.llm.quality import latent

    for z, s in zip(latent(model, x), got, strict=True):
        near = model.vectors @ z
        best = np.sort(near)[::-1][: model.neighbours]
        chosen = near >= best[-1] - 1e-6
        w = np.maximum(near[chosen].astype(float), 0) ** 8 + 1e-9
        if chosen.sum() == model.neighbours:
            assert abs((w * model.labels[chosen]).sum() / w.sum() - s) < 1e-4


def test_pieces_do_not_change_scores():
    import pyarrow as pa

    from cadence.llm import quality

    rng = np.random.default_rng(3)
    texts = pa.array([" ".join(f"w{rng.integers(50)}" for _ in range(rng.integers(0, 60))) for _ in range(1300)] + [None, "", "z " * 600000])
    model = quality.fit(quality._scaled(features(texts))[:300], np.arange(300) % 2)
    assert max(len(x) for x in quality.featured(texts)) <= quality.FEW_ROWS
    assert np.abs(quality.judge(model, texts) - score(model, features(texts))).max() < 1e-4


def test_equal_texts_score_equally(spark):
    docs = spark.createDataFrame([(k, "the same text 12", 1) for k in range(40)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    assert len({round(r.score, 9) for r in score_documents(docs, train(docs, labels)).collect()}) == 1


def test_edges(spark):
    labels = spark.createDataFrame([(0, 1), (1, 0), (None, 1), (3, None)], "doc_id long, quality int")
    docs = spark.createDataFrame([(0, "a fine text", 1), (1, "### $$$ %%%", 1), (None, None, 1), (7, "", 1), (7, "x" * 200000, 1)], "doc_id long, text string, score int")
    model = train(docs, labels)
    got = score_documents(docs, model).collect()
    assert len(got) == 5
    assert score_documents(docs.limit(0), model).count() == 0
    none = train(docs, labels.limit(0))
    assert {r.score for r in score_documents(docs, none).collect()} == {0.5}
    assert keep_good(docs, none).count() == 0 and keep_good(docs, none).columns == docs.columns
