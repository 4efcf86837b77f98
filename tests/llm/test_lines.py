import hashlib
import random

from cadence.llm.lines import dedup_lines, line_report, op6_line_alignment, patience

SF = "/root/testdata/sf0.001"


def simple(a, b, alo=0, blo=0):
    """Patience diff by the book, recursively, over the lines themselves; longest rising run by dynamic
    programming, of equally long ones that with the lowest places in b."""
    out = set()
    while a and b and a[0] == b[0]:
        out.add(blo)
        a, b, alo, blo = a[1:], b[1:], alo + 1, blo + 1
    while a and b and a[-1] == b[-1]:
        out.add(blo + len(b) - 1)
        a, b = a[:-1], b[:-1]
    pairs = [(i, b.index(x)) for i, x in enumerate(a) if x.strip() and a.count(x) == 1 and b.count(x) == 1]
    if not pairs:
        return out
    best = [[p] for p in pairs]
    for k, (_, j) in enumerate(pairs):
        ahead = [m for m in range(k) if pairs[m][1] < j]
        if ahead:
            best[k] = [*best[max(ahead, key=lambda m: (len(best[m]), -pairs[m][1]))], pairs[k]]
    size = max(map(len, best))
    lasts = [c for c in best if len(c) == size]
    chain = min(lasts, key=lambda c: c[-1][1])
    i0 = j0 = 0
    for i, j in chain:
        out |= {blo + j} | simple(a[i0:i], b[j0:j], 0, blo + j0)
        i0, j0 = i + 1, j + 1
    return out | simple(a[i0:], b[j0:], 0, blo + j0)


def brute(rows, rare=32):
    """A line goes that patience diff aligns with any earlier document, over the lines of at most `rare` holders that both
    have; or that has more holders, one of them earlier."""
    docs = sorted({(2**63 - 1 if i is None else i, t) for i, t in rows if t is not None})
    lines = {d: d[1].split("\n") for d in docs}
    holders = {}
    for d in docs:
        for x in set(lines[d]):
            if x.strip():
                holders.setdefault(x, []).append(d)
    few = {x for x, held in holders.items() if len(held) <= rare}
    out = {}
    for d in docs:
        gone = {k for k, x in enumerate(lines[d]) if x.strip() and x not in few and holders[x][0] < d}
        for f in {f for x in set(lines[d]) & few for f in holders[x] if f < d}:
            both = set(lines[d]) & set(lines[f]) & few
            places = [k for k, x in enumerate(lines[d]) if x in both]
            gone |= {places[j] for j in simple([x for x in lines[f] if x in both], [lines[d][k] for k in places])}
        for k, x in enumerate(lines[d]):
            if not x.strip():
                ink = [j for j in range(k, -1, -1) if lines[d][j].strip()] or [j for j in range(len(lines[d])) if lines[d][j].strip()]
                gone |= {k} if ink and ink[0] in gone else set()
        kept = "\n".join(x for k, x in enumerate(lines[d]) if k not in gone)
        out[d] = (len(lines[d]), len(gone), kept)
    return out


def compare(rows, got, rare=32):
    want = brute(rows, rare)
    assert len(got) == len(rows)
    left = sorted((r.n_lines, r.n_removed, r.kept_sha256) for r in got)
    right = sorted((lambda n, g, t: (n, g, hashlib.sha256(t.encode()).hexdigest()))(*(want[(2**63 - 1 if i is None else i, t)] if t is not None else (0, 0, ""))) for i, t in rows)
    assert left == right
    return sum(r.n_removed for r in got)


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert compare(rows, op6_line_alignment(spark, SF).collect()) > 20


def test_random_and_edges(spark):
    rng = random.Random(3)
    bank = [f"line {k}" for k in range(40)] + ["", "  ", "\t"]
    rows = [(k, "\n".join(rng.choice(bank) for _ in range(rng.randint(1, 9)))) for k in range(80)]
    rows += [(None, "line 3\nx"), (None, None), (90, ""), (91, "\n\n"), (92, "\n".join(bank * 30)), (93, "\n".join(bank * 30)), (92, "\n".join(bank * 30))]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, key int, n_chars int")
    for parts, rare in ((1, 32), (7, 32), (3, 4), (3, 1000), (2, 1)):
        assert compare(rows, line_report(df.repartition(parts), rare).collect(), rare) > 10
    out = dedup_lines(df)
    assert out.columns == df.columns
    want = brute(rows)
    kept = sorted(str((i, t if t is None else want[(2**63 - 1 if i is None else i, t)][2])) for i, t in rows if t is None or not want[(2**63 - 1 if i is None else i, t)][1] or want[(2**63 - 1 if i is None else i, t)][2].strip())
    assert sorted(str((r.doc_id, r.text)) for r in out.collect()) == kept
    assert line_report(df.limit(0)).count() == 0 and dedup_lines(df.limit(0)).count() == 0


def test_frequent_lines_beside_a_rare_one(spark):
    """Frequent lines go from a document that also shares a rare line, whether it is that line's first holder or not."""
    rows = [(k, f"P1\nP2\nP3\nown {k}") for k in range(1, 301)]
    rows += [(301, "P1\nP2\nP3\nrare\nown 301"), (302, "rare\nown 302"), (303, "P1\nP2\nP3\nrare\nown 303")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = line_report(df).collect()
    assert compare(rows, got) == 3 * 301 + 2
    assert {r.doc_id: r.n_removed for r in got if r.doc_id > 300} == {301: 3, 302: 1, 303: 4}


def test_patience():
    assert patience([1, 2, 3], [9, 1, 2, 8, 3]) == [1, 2, 4]
    assert patience([1, 0, 2], [2, 0, 1]) in ([0], [2])
    assert patience([4, 5], [6, 4]) == [1] and patience([5, 4, 5], [5, 5, 4, 5, 5]) in ([0, 2, 4], [0, 1, 4], [0, 4])
    assert patience([], [1]) == [] and patience([1, 1, 1], [1, 1]) == [0, 1]


def test_blocks_that_the_first_holder_has_otherwise(spark):
    """A later holder before the document has the block in the same order; the first one has it twice, or turned round."""
    rows = [(1, "P1\nP2\nx\nP1\nP2"), *((k, f"own {k}\nP1\nP2\nmore {k}") for k in (2, 3, 4))]
    rows += [(11, "A\nB\nC"), (12, "C\nB\nA"), (13, "C\nB\nA\nown 13"), (14, "C\nB\nA")]
    rows += [(21, "5\n4\n3\n2\n1"), (22, "1\n2\n3\n4\n5\n9"), (23, "1\n2\n3\n4\n5\n8")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = line_report(df).collect()
    compare(rows, got)
    gone = {r.doc_id: r.n_removed for r in got}
    assert [gone[k] for k in (2, 3, 4, 13, 14, 23)] == [2, 2, 2, 3, 3, 5]


def test_every_holder_of_a_line_is_tried(spark):
    """Documents that cycle through orders of one template, more and fewer of them than a rare line may have."""
    rng = random.Random(1)
    lines = [f"template {k}" for k in range(12)]
    orders = [rng.sample(lines, 12) for _ in range(5)]
    for n in (8, 30, 40):
        rows = [(k, "\n".join([f"own {k}", *orders[k % 5], f"more {k}"])) for k in range(n)]
        got = line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        gone = compare(rows, got)
        assert n <= 32 or gone == 12 * (n - 1)


def test_long_documents(spark):
    """A text of 100,000 lines beside a thousand that each share ten of them, some repeated within."""
    long = [f"line {k % 90_000}" for k in range(100_000)]
    rows = [(0, "\n".join(long)), *((k, "\n".join([*long[80 * k : 80 * k + 10], f"own {k}"])) for k in range(1, 1001))]
    got = line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_removed for r in got} == {k: 10 * (k > 0) for k in range(1001)}


def test_blank_lines_go_with_the_line_above(spark):
    rows = [(1, "a\n\nb\n"), (2, "\n\na\n \nown\n\nb\n\t\n"), (3, "own 3\n\na\n\nown 4")]
    got = {r.doc_id: r for r in line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    compare(rows, list(got.values()))
    assert got[2].kept_sha256 == hashlib.sha256(b"own\n").hexdigest() and got[3].kept_sha256 == hashlib.sha256(b"own 3\n\nown 4").hexdigest()
