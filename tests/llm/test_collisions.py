import duckdb
import numpy as np

from cadence.llm.collisions import OP3_SQL, Projections, _judged, calibrate, meetings, near_duplicates, op3_collision_links, places, sized, window_pairs


def brute(rows):
    good = [(k, np.asarray(e, float) / np.abs(np.asarray(e, float)).max()) for k, (_, e) in enumerate(rows) if e is not None and len(e) and all(v is not None for v in e) and np.isfinite(e).all() and np.any(e)]
    n, root = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for s, (i, x) in enumerate(good):
        for j, y in good[s + 1 :]:
            if len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= 0.9:
                n[i] += 1
                n[j] += 1
                root[find(j)] = find(i)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(i, least.get(find(k), i))
    return sorted((i, n[k], least[find(k)], i == least[find(k)]) for k, (i, _) in enumerate(rows))


def test_sql(spark):
    con = duckdb.connect()
    con.sql("create view embeddings as select * from '/root/testdata/sf0.01/embeddings.parquet'")
    assert sorted(map(tuple, op3_collision_links(spark, "/root/testdata/sf0.01").collect())) == sorted(con.execute(OP3_SQL).fetchall())


def test_hot_cluster_in_cells(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal(32)
    rows = [(k, (base + rng.standard_normal(32) * 0.12).tolist()) for k in range(300)]
    rows += [(400 + k, rng.standard_normal(32).tolist()) for k in range(100)]
    rows += [(600, None), (601, [0.0] * 32), (602, [float("nan")] + [1.0] * 31), (603, [1.0, 2.0]), (604, [2.0, 4.0]), (605, [None, 1.0]), (606, [])]
    rows += [(700, rows[0][1]), (700, rows[0][1]), (701, [1e-200] * 32), (702, [2e-200] * 32)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, n_links int, cid int")
    got = sorted(tuple(r) for r in near_duplicates(df, Projections(cell=64)).collect())
    assert got == brute(rows)
    assert near_duplicates(df.limit(0)).count() == 0


def at_cosine(rng, n, dim, cosine):
    a = rng.standard_normal((n, dim))
    a /= np.sqrt((a * a).sum(1))[:, None]
    b = rng.standard_normal((n, dim))
    b -= (a * b).sum(1)[:, None] * a
    b /= np.sqrt((b * b).sum(1))[:, None]
    return a, cosine * a + np.sqrt(1 - cosine**2) * b


def judged(p, x):
    """Links by the kernels alone, and the tally of pairs in windows and of pairs with enough collisions."""
    (ends, values), (first, second) = places(p, x), meetings(p)
    width = 2 * p.directions
    met = (np.arange(len(first)) * width + ends[:, first]) * width + ends[:, second]
    row, bucket = np.repeat(np.arange(len(x)), met.shape[1]), met.ravel()
    order = np.argsort(bucket, kind="stable")
    row, bucket = row[order], bucket[order]
    cell = np.unique(bucket, return_inverse=True)[1]
    none = np.zeros(len(row), bool)
    i, j, tally = _judged(p, x[row], ends[row], values[row], cell, bucket // width**2, none, none)
    return set(zip(np.minimum(row[i], row[j]).tolist(), np.maximum(row[i], row[j]).tolist(), strict=True)), len(i), tally


def test_recall_is_calibrated():
    p = Projections()
    each, least = calibrate(p)
    assert least >= 8 and len(meetings(p)[0]) == 72
    a, b = at_cosine(np.random.default_rng(0), 2000, 64, 0.9 + 1e-9)
    found, rows, _ = judged(p, np.concatenate([a, b]))
    assert rows == len(found)
    hit = sum((k, k + 2000) in found for k in range(2000))
    print("recall at the threshold", hit / 2000, "least count", least, "of", p.families)
    assert hit >= 0.994 * 2000


def test_window_binds():
    """Some pairs that share a projection stand outside of each other's window there."""
    p = Projections()
    a, b = at_cosine(np.random.default_rng(1), 4000, 64, 0.0)
    (ea, va), (eb, vb) = places(p, a), places(p, b)
    same = ea == eb
    assert 0 < (np.abs(va - vb)[same] > p.window).mean() < 0.5


def test_candidates_grow_with_the_rows():
    """Pairs in windows per row stay bounded while the rows grow; hardly a pair of strangers has enough collisions."""
    rng = np.random.default_rng(2)
    each = {}
    for n in (2_000, 10_000, 40_000):
        p = sized(Projections(), n)
        _, _, tally = judged(p, rng.standard_normal((n, 64)))
        each[n] = tally["windows"] / n
        print(n, "rows:", each[n], "pairs in windows a row,", tally["counted"], "counted enough")
        assert tally["counted"] <= n / 1000
    assert each[40_000] < 60
    assert sized(Projections(), 4 * 10**6).directions == 2048 and sized(Projections(), 10**4).directions == 512


def test_window_pairs_are_those_of_brute_force():
    rng = np.random.default_rng(4)
    cell, value = np.sort(rng.integers(0, 9, 300)), rng.random(300) * 5
    got = [(min(i, j), max(i, j)) for a, b in window_pairs(cell, value, 0.5) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
    assert sorted(got) == [(i, j) for i in range(300) for j in range(i + 1, 300) if cell[i] == cell[j] and abs(value[i] - value[j]) <= 0.5]
