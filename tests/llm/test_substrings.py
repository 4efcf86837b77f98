import hashlib
import random
import re

import duckdb
import pytest

from cadence.llm.substrings import OP4_SQL, op4_repeated_windows, pack, remove_repeats, unpack

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    """rows: (doc_id, text) with distinct ids."""
    first, out = {}, {}
    split = {i: WORD.findall(t or "") for i, t in rows}
    for i in sorted(split, key=lambda i: (i is None, i)):
        w, gone = split[i], set()
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if key in first:
                gone.update(range(k, k + window))
            else:
                first[key] = i
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    got = sorted(map(tuple, op4_repeated_windows(spark, SF).collect()))
    assert got == sorted(con.execute(OP4_SQL).fetchall()) and sum(r[2] for r in got) > 1000


@pytest.mark.parametrize(("window", "base", "chunk"), [(20, 10, 2_000_000), (8, 2, 50), (4, 4, 30), (20, 5, 200)])
def test_brute(spark, window, base, chunk):
    rng = random.Random(window)
    bank = [" ".join(rng.choice("abcde") * rng.randint(1, 2) for _ in range(30)) for _ in range(12)]
    rows = [(k * 7 % 97, " \n".join(rng.choice(bank)[rng.randint(0, 9) :] for _ in range(rng.randint(0, 5)))) for k in range(90)]
    rows += [(200, None), (201, ""), (None, bank[0]), (-5, bank[0]), (202, "one " * 500), (203, "é x " * 40)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, key int, id int").repartition(5)
    got = remove_repeats(df, window, base, with_text=True, chunk=chunk).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == brute(rows, window)
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in got)


def test_repeated_ids_and_empty(spark):
    t = " ".join(f"w{k}" for k in range(40))
    df = spark.createDataFrame([(1, t), (1, t), (2, t)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_removed) for r in remove_repeats(df).collect())
    assert got == [(1, 0), (1, 0), (2, 40)]
    assert remove_repeats(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        remove_repeats(df, 20, 7)


def test_pack():
    import numpy as np

    for a in ([], [0], [5, 2**40], [2**64 - 1, 0]):
        x = np.array(a, np.uint64)
        assert (unpack(pack(x, x))[1] == x).all()
