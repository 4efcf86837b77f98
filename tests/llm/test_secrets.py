import hashlib
import re

import duckdb

from cadence.llm.secrets import LEDGER, OP7_SQL, RULES, Rule, extend_ledger, find_secrets, ledger_rows, op7_secret_ledger, report, scan_unseen

SF = "/root/testdata/sf0.01"
KINDS = [
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), 2, 8),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile("[0-9a-f]+"), 0, 32),
]


def brute(text):
    found = []
    for k, (name, rx, group, least) in enumerate(KINDS):
        found += [(m.start(), k, name, m.end()) for m in rx.finditer(text or "") if len(m[group]) >= least]
    return sorted(found)


ODD = [
    (1, None), (2, ""), (3, "token=passwd:abcdefgh token=abcdefgh9"), (4, "é🙂 API_KEY = \"abc.def/ghi=\" and 0123456789abcdef0123456789abcdef0"),
    (5, "AKIAAKIA1234567890 AKIA12 AKIA123456789012"), (6, "password:\x20\x20'Zz99zz99' password\t:aaaaaaaaa"), (7, "deadbeef" * 5000), (8, "toKen=abcdefghij ſecret=abcdefghij"),
    (9, "token=abcdefgh" * 400), (9, "token=abcdefgh" * 400), (10, "-----BEGIN RSA PRIVATE KEY----- ghp_" + "a1" * 20), (None, "secret=12345678"),
]


def test_brute_and_sql(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = op7_secret_ledger(spark, SF).collect()
    assert len(got) == len(texts) and sum(r.n_assign + r.n_access + r.n_hex for r in got) > 10
    for r in got:
        want = brute(texts[r.doc_id])
        line = ",".join(f"{n}:{s}:{e}" for s, _, n, e in want)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    assert sorted(map(tuple, got)) == sorted(con.execute(OP7_SQL).fetchall())


def test_odd_texts(spark):
    df = spark.createDataFrame([(*r, "blob", 1) for r in ODD], "doc_id long, text string, found string, n int")
    got = find_secrets(df, ["doc_id"]).collect()
    assert len(got) == len(ODD)
    texts = dict(ODD)
    for r in got:
        assert [(s.start, s.kind, s.rule, s.end) for s in r.found if s.kind < 3] == brute(texts[r.doc_id])
    assert find_secrets(df.limit(0), ["doc_id"]).count() == 0


def test_ledger_is_incremental(spark):
    old = spark.createDataFrame([(1, "token=abcdefgh1"), (2, "nothing")], "doc_id long, text string")
    ledger = ledger_rows(old)
    assert ledger.count() == 2 * len(RULES)
    both = old.union(spark.createDataFrame([(3, "token=abcdefgh1"), (4, "token=zyxwvuts2")], old.schema))
    assert scan_unseen(both, ledger).count() == 1
    found = {r.doc_id: len(r.found) for r in find_secrets(both, ["doc_id"], ledger).collect()}
    assert found == {1: 1, 2: 0, 3: 1, 4: 1}
    assert ledger_rows(both, ledger).count() == len(RULES)
    none = spark.createDataFrame([], LEDGER)
    assert scan_unseen(old, none).count() == 1


def test_deliveries_and_rule_changes_leave_one_row_a_pair(spark):
    """Odd texts in three deliveries that share blobs, then a rule of a new version: a pair is scanned once, all paths
    are read off the ledger, and findings of the old version no longer count."""
    df = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(ODD * 2)], "path long, text string")
    texts, ledger = {r.path: r.text for r in df.collect()}, None
    for k in range(3):
        ledger = extend_ledger(ledger, df.where(f"path % 3 = {k}"))
    pairs = [(r.blob, r.rule, r.rule_version) for r in ledger.collect()]
    blobs = len({t or "" for t in texts.values()})
    assert len(pairs) == len(set(pairs)) == blobs * len(RULES)
    assert scan_unseen(df, ledger).count() == 0 and ledger_rows(df, ledger).count() == 0
    got = report(df, ["path"], ledger).collect()
    assert len(got) == len(texts)
    assert all([(s.start, s.kind, s.rule, s.end) for s in r.found if s.kind < 3] == brute(texts[r.path]) for r in got)
    newer = (*RULES[:1], Rule("access", "(AKIA[A-Z]+)", 1, 5, version=2), *RULES[2:])
    longer = extend_ledger(ledger, df, newer)
    assert longer.count() == ledger.count() + blobs
    found = {r.path: [(s.start, s.end) for s in r.found if s.rule == "access"] for r in report(df, ["path"], longer, newer).collect()}
    assert found == {p: [m.span() for m in re.finditer("AKIA[A-Z]+", t or "") if len(m[0]) >= 5] for p, t in texts.items()}
