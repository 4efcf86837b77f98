import random
import re

import duckdb
import numpy as np

from cadence.llm.minhash import OP2_SQL, Shingling, near_duplicates, one_of_each, op2_circulant_minhash, signature

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sets_of(rows, length):
    out = []
    for _, t in rows:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        out.append(frozenset(tuple(w[k : k + length]) for k in range(max(1, len(w) - length + 1))) if w else frozenset())
    return out


def brute(rows, length):
    """Components by comparing every pair; rows have distinct ids."""
    sets, ids = sets_of(rows, length), [2**63 - 1 if i is None else i for i, _ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for k, i in enumerate(ids):
        least[find(k)] = min(i, least.get(find(k), i))
    none = lambda i: None if i == 2**63 - 1 else i
    return sorted(((i, len(sets[k]), none(least[find(k)]), ids[k] == least[find(k)]) for k, (i, _) in enumerate(rows)), key=str)


def test_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    got = sorted(map(tuple, op2_circulant_minhash(spark, SF).collect()))
    assert got == sorted(con.execute(OP2_SQL).fetchall())
    assert sum(not r[3] for r in got) > 50


def noisy(rng, w, k):
    w = list(w)
    for _ in range(k):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def test_brute_in_small_cells(spark):
    rng = random.Random(1)
    base = [f"w{k}" for k in range(160)]
    rows = [(k, noisy(rng, base, rng.randint(0, 9))) for k in range(150)]
    rows += [(1000 + k, " ".join(f"v{rng.randrange(99)}" for _ in range(rng.randint(1, 60)))) for k in range(60)]
    rows += [(2000 + k, rows[0][1].upper() + "\t") for k in range(60)]
    rows += [(3000, None), (3001, ""), (3002, " \n"), (3003, "One two"), (3004, "one  TWO"), (3005, "É a b c d"), (3006, "é a b c d"), (None, "One two"), (3007, "again and again " * 3000)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, kept int, n int").repartition(3)
    for s in (Shingling(block=16, weight=3000), Shingling(length=4)):
        got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df, s).collect()), key=str)
        assert got == brute(rows, s.length)
    kept = one_of_each(df)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r[0]) for r in brute(rows, 5) if r[3])
    assert near_duplicates(df.limit(0)).count() == 0


def test_repeated_ids(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (1, "x y z"), (0, "x y z")], "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id, r.kept) for r in near_duplicates(df).collect())
    assert got == [(0, 0, True), (1, 0, False), (1, 1, True), (1, 1, True)]


def test_one_row_of_each_component(spark):
    long = " ".join(f"w{k}" for k in range(80))
    rows = [(1, "a b c d e f", "u"), (1, "a b c d e f", "u"), (1, "x y z", "u"), (0, "x y z", "u"), (1, "other words in this one", "u")]
    rows += [(7, long, "u"), (7, long + " end", "u"), (None, "p q r s t", "u"), (None, "p q r s t", "v"), (None, "P q r s t", "u"), (8, "", "u"), (8, "", "u"), (9, None, "u")]
    df = spark.createDataFrame(rows, "doc_id long, text string, k_id string").repartition(3)
    kept = one_of_each(df)
    assert kept.columns == df.columns
    got = sorted(str((r.doc_id, (r.text or "").lower()[:9])) for r in kept.collect())
    assert got == sorted(map(str, [(1, "a b c d e"), (0, "x y z"), (1, "other wor"), (7, "w0 w1 w2 "), (None, "p q r s t"), (8, ""), (9, "")]))


def test_signature_estimates_similarity():
    s, rng = Shingling(), np.random.default_rng(4)
    errors = []
    for overlap in (200, 500, 800, 950):
        x = rng.integers(0, 2**63, 2000 - overlap, dtype=np.uint64)
        a, b = x[:1000], np.concatenate([x[:overlap], x[1000:]])
        true = overlap / len(x)
        errors.append((signature(s, a) == signature(s, b)).mean() - true)
    assert np.abs(errors).max() < 0.15
