import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from cadence.llm.forest import Forest, _strings, nearest, op1_prefix_forest


def exact(ids, x, qids, k):
    x = np.asarray(x, float)
    n = np.sqrt((x * x).sum(1))
    out = {}
    for q in qids:
        i = int(np.flatnonzero(np.asarray(ids) == q)[0])
        s = (x * x[i]).sum(1) / (n * n[i])
        keep = np.flatnonzero(np.asarray(ids) != q)
        best = keep[np.lexsort((np.asarray(ids)[keep], -s[keep]))[:k]]
        out[q] = [(int(ids[b]), s[b]) for b in best]
    return out


def recall(ids, x, qids, got):
    """Share of the true neighbours found; every score found must be the exact one."""
    want = exact(ids, x, qids, 5)
    assert got.keys() == want.keys() and all(len(v) == 5 for v in got.values())
    scores = {(q, v): s for q, found in got.items() for v, s in found}
    floor = {q: found[-1][1] for q, found in want.items()}
    assert all(abs(scores[q, v] - s) < 1e-12 for q, found in want.items() for v, s in found if (q, v) in scores)
    return np.mean([s >= floor[q] - 1e-12 for (q, _), s in scores.items()])


def collected(df):
    got = {}
    for r in df.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return got


def test_recall_of_the_query(spark):
    d = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding").orderBy("vec_id").toPandas()
    ids = rows.vec_id.to_numpy()
    assert recall(ids, np.stack(rows.embedding), [i for i in ids if i % 50 == 0], collected(op1_prefix_forest(spark, d))) >= 0.95


def vectors(kind, n, dim=64):
    rng = np.random.default_rng(8)
    if kind == "isotropic":
        return rng.standard_normal((n, dim))
    return rng.standard_normal((n // 40 + 1, dim))[rng.integers(0, n // 40 + 1, n)] + 0.5 * rng.standard_normal((n, dim))


@pytest.mark.parametrize(("kind", "n", "every"), [("isotropic", 10_000, 50), ("clustered", 10_000, 50), ("isotropic", 100_000, 1000)])
def test_recall(spark, tmp_path, kind, n, every):
    """Against brute force over vectors made here."""
    x = vectors(kind, n)
    pq.write_table(pa.table({"vec_id": np.arange(n), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))}), tmp_path / "v.parquet")
    df = spark.read.parquet(str(tmp_path / "v.parquet"))
    found = recall(np.arange(n), x, list(range(0, n, every)), collected(nearest(df, df.where(f"vec_id % {every} = 0"))))
    print(kind, n, "recall", found)
    assert found >= 0.93


def test_near_copies_come_apart():
    """In a cluster of near copies a query meets a part, not all of them."""
    x = np.concatenate([vectors("isotropic", 4000), vectors("isotropic", 1) + 0.15 * vectors("isotropic", 4000)])
    apart = [np.mean([len(np.unique(_strings(f, x.astype(np.float32), t)[4000:])) for t in range(f.trees)]) for f in (Forest(trees=16, depth=4), Forest(trees=16))]
    print("strings of 4,000 near copies, by 4 and by 8 symbols:", apart)
    assert apart[1] > 3 * apart[0]


def test_edges(spark):
    one = [1.0, 0.0, 0.0]
    rows = [(0, one), (1, one), (2, [2.0, 0.0, 0.0]), (3, [0.0, 0.0, 0.0]), (4, None), (5, [float("nan"), 1.0, 0.0]), (6, [1.0, None, 0.0]), (7, []), (50, [1e200, 1e200, 0.0]), (100, [1.0]), (None, one), (1, one), (150, [float("inf"), 0.0, 0.0])]
    df = spark.createDataFrame([(*r, 1, 0) for r in rows], "vec_id long, embedding array<double>, rank int, dim int")
    got = {}
    for r in nearest(df, df.where("vec_id % 50 = 0"), forest=Forest(trees=4)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, round(r.score, 6)))
    assert got == {0: [(1, 1, 1.0), (2, 2, 1.0), (3, 50, 0.707107)], 50: [(1, 0, 0.707107), (2, 1, 0.707107), (3, 2, 0.707107)]}
    assert nearest(df.limit(0), df.limit(0)).count() == 0
