import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cadence.llm.negatives import Keys, components, hard_negatives, op13_distance_keys, products

SF = "/root/testdata/sf0.001"


def brute(rows, anchors, k=5):
    """rows: (vec_id, vector, label)."""
    use = [(i, [math.floor(256 * x) for x in v], c) for i, v, c in rows if i is not None and v is not None and c is not None and all(x is not None and math.isfinite(x) for x in v)]
    own = {}
    for i, v, c in sorted(use, key=lambda r: (r[0], r[2], r[1])):
        own.setdefault(i, (v, c))
    out = []
    for a in sorted(set(anchors) & set(own)):
        q, label = own[a]
        scored = sorted((-sum(x * y for x, y in zip(q, v, strict=False)), i, c == label) for i, v, c in use if i != a)
        for s, p, _ in [x for x in scored if x[2]][:k]:
            fits = [x for x in scored if not x[2] and 80 * -s <= 100 * -x[0] <= 100 * -s][:k]
            out += [(a, p, r + 1, n, -s, -t) for r, (t, n, _) in enumerate(fits)]
    return sorted(out)


def test_whole_table(spark):
    rows = [(r.vec_id, list(r.embedding), (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = sorted(tuple(r) for r in op13_distance_keys(spark, SF).collect())
    assert got == brute(rows, [r[0] for r in rows if r[0] % 100 == 0]) and got


def test_clusters_ties_and_edges(spark):
    """Copies over many blocks, repeated ids, nulls, short, empty and huge vectors, clashing columns."""
    rng = random.Random(5)
    middles = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(4)]
    rows = [(k, [x + rng.gauss(0, 0.2) for x in middles[k % 4]], k % 3) for k in range(240)]
    rows += [(1000 + k, middles[0], k % 2) for k in range(120)]
    rows += [(5, [1.0] * 6, 1), (5, [0.5] * 6, 2), (2000, None, 1), (2001, [None, 1.0], 1), (2002, [float("nan")] * 6, 1), (2003, [1.0], None), (None, [1.0] * 6, 1)]
    rows += [(2004, [], 1), (2005, [1.0], 1), (2006, [2.0, 1.0], 0), (2007, [0.0] * 6, 1)]
    df = spark.createDataFrame([(*r, 7, "x", 0) for r in rows], "vec_id long, embedding array<double>, label int, block int, part string, rank int")
    asked = [0, 1, 5, 13, 60, 1000, 1001, 2000, 2002, 2003, 2004, 2005, 2007, 9999]
    anchors = spark.createDataFrame([(a,) for a in [*asked, 5, None]], "vec_id long")
    for keys in (Keys(pivots=5, rows=16, visitors=2), Keys(pivots=1, rows=500, cells=3, steps=(0.2, 0.6, 1.0))):
        got = sorted(tuple(r) for r in hard_negatives(df, anchors, keys=keys).collect())
        assert got == brute(rows, asked) and len(got) > 50
    assert hard_negatives(df.limit(0), anchors).count() == 0 and hard_negatives(df, anchors.limit(0)).count() == 0


def test_products_of_any_size():
    q, _ = components(pa.array([[3e6, 1.0], [1e30, 0.0]]))
    x, _ = components(pa.array([[3e6, 7.0 / 256]]))
    assert products(q, x)[0, 0] == 768_000_000**2 + 256 * 7 and products(q, x)[1, 0] == 2**63 - 1


def test_pruning_on_clusters(spark):
    """On clustered vectors most blocks are never visited."""
    from cadence.llm import negatives

    rng = np.random.default_rng(2)
    middles = rng.normal(0, 4, (16, 24))
    rows = [(k, (middles[k % 16] + rng.normal(0, 0.05, 24)).tolist(), k % 2) for k in range(4000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    index = negatives.build(df.select("vec_id", "label", df.embedding.alias("vec")), Keys(rows=64, pivots=16, cells=64))
    blocks = index.blocks.count()
    q = np.floor(256 * np.array(rows[0][1]))
    target = spark.createDataFrame([(0, 0, 0, True, negatives.LEAST, negatives.MOST, bytearray(q.tobytes()), negatives.LEAST, negatives.LEAST)], negatives.TARGETS)
    seen = negatives._visits(target, index, 0).count()
    best = negatives.search(target, index, 5).collect()
    bound = min(r.score for r in best)
    rest = negatives._visits(target.withColumn("bound", F.lit(bound)), index, 2).count()
    print("blocks", blocks, "home", seen, "certified", rest)
    assert len(best) == 5 and seen + rest < blocks / 2
