import duckdb
import pytest

from cadence.llm.mixing import OP9_SQL, mix_documents, op9_mix_sources, plan_mix

SF = "/root/testdata/sf0.001"


def filled(sizes, weights, epochs=3):
    total, free, target = sum(sizes.values()), set(sizes), {}
    while True:
        left, w = total - sum(target.values()), sum(weights[s] for s in free)
        over = {s for s in free if left * weights[s] / w > epochs * sizes[s]}
        if not over:
            return target | {s: left * weights[s] / w for s in free}
        target |= {s: epochs * sizes[s] for s in over}
        free -= over


def test_sql_and_targets(spark):
    got = {r.doc_id: r for r in op9_mix_sources(spark, SF).collect()}
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.execute(OP9_SQL).fetchall()
    assert len(want) == len(got)
    for doc, size, source_size, target, taken in want:
        r = got[doc]
        assert (r.size, r.source_size, r.taken) == (size, source_size, taken) and abs(r.target - target) < 1e-6


def test_iterated_reference(spark):
    rows = [(k, "w " * n, s) for k, (n, s) in enumerate([(5, "a"), (900, "b"), (40, "c"), (3, "d"), (10, None), (70, "a"), (1, "é"), (0, "z")])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, cap int, level int")
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    want = filled(sizes, {s: k % 3 + 1 for k, s in enumerate(order)})
    got = plan_mix(df).collect()
    source_of = {k: s for k, _, s in rows}
    taken = {}
    for r in got:
        s = source_of[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s])
        assert 0 <= r.taken <= 3 * r.size
        taken[s] = taken.get(s, 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    mixed = mix_documents(df).collect()
    words = {}
    for m in mixed:
        words[m.source] = words.get(m.source, 0) + len(m.text.split())
    assert words == taken
    assert mixed[0].asDict().keys() == set(df.columns)


def test_edges(spark):
    df = spark.createDataFrame([(1, "a b", "s"), (1, "a b", "s"), (1, "c", "s"), (None, None, None), (2, "", "t")], "doc_id long, text string, source string")
    got = plan_mix(df).collect()
    assert len(got) == 5 and sum(r.taken for r in got) == 5
    assert sorted(m.text or "" for m in mix_documents(df).collect()) == ["", "", "a b", "a b", "c"]
    assert plan_mix(df.limit(0)).count() == 0 and mix_documents(df.limit(0)).count() == 0


def test_rows_that_differ_in_other_columns_mix_alike_in_every_order(spark):
    from cadence.llm.mixing import mix_documents

    rows = [(1, " ".join(f"w{j}" for j in range(50)), "a", k) for k in range(6)] + [(10 + k, "some other words", "b", k) for k in range(40)]
    seen = set()
    for parts in (1, 3, 5):
        df = spark.createDataFrame(rows if parts != 3 else rows[::-1], "doc_id long, text string, source string, n_chars int").repartition(parts)
        df = df.withColumn("note", df.n_chars)
        seen.add(tuple(sorted((r.doc_id, r.text, r.note) for r in mix_documents(df).collect())))
    assert len(seen) == 1
