import pytest

corpus = pytest.importorskip("corpus_pipeline")


def test_stages_against_brute_force(spark, tmp_path):
    from cadence.llm.quality import train
    from tests.llm import test_lines, test_minhash, test_mixing, test_packing

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = {}
    for name, stage in corpus.STAGES:
        before = docs
        after = stage(spark, before, sf)
        if name != "packing":
            assert after.columns == docs.columns
        after.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = ([r for r in before.collect()], docs.collect())
    before, after = seen["quality"]
    from cadence.llm.quality import score_documents

    raw = spark.createDataFrame(before)
    model = train(raw, spark.read.parquet(f"{sf}/labels.parquet"))
    good = {r.doc_id for r in score_documents(raw, model).collect() if r.predicted}
    assert sorted(r.doc_id for r in after) == sorted(good) and 0 < len(after) < len(before)
    before, after = seen["lines"]
    want = test_lines.brute([(r.doc_id, r.text) for r in before])
    kept = {d: t for (d, _), (_, gone, t) in want.items() if not gone or t.strip()}
    assert {r.doc_id: r.text for r in after} == kept and all(r.n_chars == len(r.text) for r in after)
    before, after = seen["near_duplicates"]
    assert sorted(r.doc_id for r in after) == [i for i, _, _, k in sorted(test_minhash.brute([(r.doc_id, r.text) for r in before], 5), key=lambda x: x[0]) if k]
    before, after = seen["mixing"]
    sizes, taken = {}, {}
    for rows, out in ((before, sizes), (after, taken)):
        for r in rows:
            out[r.source] = out.get(r.source, 0) + len(test_minhash.WORD.findall(r.text))
    order = sorted(sizes, key=lambda s: s.encode())
    goal = test_mixing.filled(sizes, {s: k % 3 + 1 for k, s in enumerate(order)})
    assert all(abs(taken[s] - goal[s]) <= 1 for s in sizes)
    before, after = seen["packing"]
    from cadence.llm.packing import Encoder, Vocabulary

    encoder = Encoder.of(Vocabulary())
    assert sum(r.length for r in after) == sum(len(encoder.ids(r.text)) for r in before)
    assert test_packing.SF == sf


def test_run(spark):
    out = corpus.run(spark, "/root/testdata/sf0.001")
    assert out.columns[0] == "doc_id" and out.count() > 0
    assert [n for n, _ in corpus.STAGES] == ["quality", "lines", "near_duplicates", "mixing", "packing"]


def test_edges(spark, tmp_path):
    """Nulls in every column, an empty table, repeated rows and clashing names go through all stages."""
    words = " ".join(f"word{k}" for k in range(60))
    rows = [(1, words, "en", "a", 7), (1, words, "en", "a", 7), (2, words, None, None, None), (None, None, None, None, None), (3, "", "", "", 0), (4, "one\ntwo\nthree " * 3000, "en", "b", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars int, gone array<int>, p_row int, cid long, row int"
    labels = spark.createDataFrame([(k, k % 2) for k in range(9)], "doc_id long, quality int")
    for part, name in ((rows, "some"), ([], "none")):
        folder = str(tmp_path / name)
        spark.createDataFrame([(*r, [1], 1, 1, 1) for r in part], schema).write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for stage, f in corpus.STAGES[1:-1]:
            after = f(spark, docs, folder)
            assert after.columns == docs.columns
            after.write.parquet(f"{folder}/{stage}")
            docs = spark.read.parquet(f"{folder}/{stage}")
        assert (docs.where("doc_id = 4").count() > 0) == bool(part)
        assert corpus.run(spark, folder).where("length <= 0").count() == 0
