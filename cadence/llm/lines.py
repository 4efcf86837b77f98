"""Line deduplication by pairwise alignment (operator 6).

Documents that share a rare line, one with at most `RARE` holders, are paired, all of them; each pair is aligned by patience
diff over the rare lines that both have, and what is aligned goes from the later document. Of lines with more holders the
first holder keeps it and the others lose it, so that no line is left out and no hot line makes pairs.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.llm.groups import runs
from cadence.session import bound_arrow, cut

BLANK = 0
#: Documents that hold a rare line, at most; it bounds the pairs of a line.
RARE = 32
SPACE = " \t\r\x0b\x0c"


def _lines(text: Column) -> Column:
    """A hash per line, BLANK for lines without ink."""
    ink = lambda line: F.trim(F.translate(line, "\t\r\u000b\u000c", "")) != ""
    return F.transform(F.split(text, "\n"), lambda line: F.when(ink(line), F.xxhash64(line)).otherwise(F.lit(BLANK).cast("long")))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(2**63 - 1)).alias("id"), F.coalesce(F.xxhash64(docs["text"]), F.lit(0)).alias("key"), docs["text"].alias("text"))


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, given in order of the first place, whose second places rise too."""
    tails: list[int] = []
    at: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        p = bisect_left(tails, j)
        if p == len(tails):
            tails.append(j)
            at.append(k)
        else:
            tails[p], at[p] = j, k
        back[k] = at[p - 1] if p else -1
    out = []
    k = at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def _once(x: list[int], lo: int, hi: int) -> dict[int, int]:
    """Places of lines that occur once in x[lo:hi]."""
    seen: dict[int, int] = {}
    for k in range(lo, hi):
        seen[x[k]] = k if x[k] not in seen else -1
    return {h: k for h, k in seen.items() if k >= 0 and h != BLANK}


def patience(a: list[int], b: list[int]) -> list[int]:
    """Places in b of lines aligned with a: equal ends first, then the longest rising run of lines that are unique on both
    sides, and so on between them."""
    found: list[int] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        while alo < ahi and blo < bhi and a[alo] == b[blo]:
            found.append(blo)
            alo, blo = alo + 1, blo + 1
        while alo < ahi and blo < bhi and a[ahi - 1] == b[bhi - 1]:
            ahi, bhi = ahi - 1, bhi - 1
            found.append(bhi)
        if alo == ahi or blo == bhi:
            continue
        left, right = _once(a, alo, ahi), _once(b, blo, bhi)
        chain = _rising(sorted((i, right[h]) for h, i in left.items() if h in right))
        for i, j in chain:
            found.append(j)
            todo.append((alo, i, blo, j))
            alo, blo = i + 1, j + 1
        if chain:
            todo.append((alo, ahi, blo, bhi))
    return sorted(found)


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, n, places) of each line with ink of each document."""
    for batch in batches:
        off = np.concatenate([[0], np.cumsum(batch.column(1).value_lengths().to_numpy(zero_copy_only=False))])
        flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
        doc = np.repeat(np.arange(batch.num_rows), np.diff(off))
        place = np.arange(len(flat)) - off[doc]
        order = np.lexsort((place, flat, doc))
        order = order[flat[order] != BLANK]
        h, d = flat[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        starts = np.flatnonzero(new)
        places = pa.ListArray.from_arrays(pa.array(np.append(starts, len(h)).astype(np.int32)), pa.array(place[order].astype(np.int32)))
        yield pa.RecordBatch.from_arrays([pa.array(h[starts]), batch.column(0).take(pa.array(d[starts])), places], ["h", "n", "places"])


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(n, gone) of each pair: rows (n, f, theirs, own), one a shared rare line, with its places in both."""
    for table, starts in runs(batches, ["n", "f"]):
        theirs, own = (table[c].combine_chunks().to_pylist() for c in ("theirs", "own"))
        gone = []
        for i, j in zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows], strict=True):
            a = sorted((p, k + 1) for k in range(i, j) for p in theirs[k])
            b = sorted((p, k + 1) for k in range(i, j) for p in own[k])
            gone.append([b[k][0] for k in patience([k for _, k in a], [k for _, k in b])])
        yield pa.RecordBatch.from_arrays([table["n"].combine_chunks().take(pa.array(starts)), pa.array(gone, pa.list_(pa.int32()))], ["n", "gone"])


def _pairs(shared: DataFrame) -> DataFrame:
    """(n, f, theirs, own): for each rare line and each two of its holders, the later one n and the earlier one f, and the
    line's places in them."""
    holders = shared.groupBy("h").agg(F.array_sort(F.collect_list(F.struct("n", "places"))).alias("all"))
    met = F.flatten(F.transform("all", lambda x, i: F.transform(F.slice("all", F.lit(1), i), lambda y: F.struct(x["n"].alias("n"), y["n"].alias("f"), y["places"].alias("theirs"), x["places"].alias("own")))))
    return holders.select(F.explode(met).alias("m")).select("m.*")


def shared_blocks(docs: DataFrame, rare: int = RARE) -> DataFrame:
    """(g_id, g_key, gone): for each document that loses lines, their numbers.

    Only line hashes and places move. A rare line makes rare * (rare - 1) / 2 rows at most, and a pair of documents is as
    large as the lines that they share. Other lines are joined with their first holder as a written table with a row a
    line, which adaptive execution can split.
    """
    bound_arrow(docs.sparkSession)
    own = cut(_keyed(docs).where("text is not null").select("id", "key", _lines(F.col("text")).alias("lines")))
    ranged = own.repartitionByRange("id", "key").dropDuplicates(["id", "key"]).sortWithinPartitions("id", "key")
    table = cut(ranged.select(F.monotonically_increasing_id().alias("n"), "id", "key", "lines"))
    held = table.select("n", "lines").mapInArrow(_held, "h long, n long, places array<int>")
    lines = cut(held.groupBy("h").agg(F.count("*").alias("df"), F.min("n").alias("first")).where("df > 1"))
    shared = cut(held.join(lines, "h"))
    pairs = _pairs(shared.where(F.col("df") <= rare)).repartition("n", "f").sortWithinPartitions("n", "f")
    aligned = pairs.mapInArrow(_aligned, "n long, gone array<int>").where(F.size("gone") > 0)
    frequent = shared.where((F.col("df") > rare) & (F.col("n") > F.col("first"))).select("n", F.col("places").alias("gone"))
    gone = aligned.unionByName(frequent).groupBy("n").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("gone"))
    return gone.join(table.select("n", F.col("id").alias("g_id"), F.col("key").alias("g_key")), "n").drop("n")


def _cut_lines(text: str, gone: list[int] | None) -> tuple[int, int, str]:
    """Lines, lines that go, and the rest: a blank line goes with the line with ink above it, or at the head of the text
    with the one below."""
    lines = text.split("\n")
    if not gone:
        return len(lines), 0, text
    out = set(gone)
    ink = [k for k, line in enumerate(lines) if line.strip(SPACE)]
    above = ink[0]
    keep = []
    for k, line in enumerate(lines):
        if line.strip(SPACE):
            above = k
        if above not in out:
            keep.append(line)
    return len(lines), len(lines) - len(keep), "\n".join(keep)


def _marked(docs: DataFrame, rare: int) -> DataFrame:
    """The rows of `docs` in a struct `row`, with their text and what goes of it."""
    blocks = shared_blocks(docs, rare)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.coalesce(docs["doc_id"].cast("long"), F.lit(2**63 - 1)).alias("id"), F.coalesce(F.xxhash64(docs["text"]), F.lit(0)).alias("key"))
    return rows.join(blocks, (rows["id"] == blocks["g_id"]) & (rows["key"] == blocks["g_key"]), "left").select("row", "gone")


def dedup_lines(docs: DataFrame, rare: int = RARE) -> DataFrame:
    """The rows of `docs` with all columns, less the common lines in their texts (see the module) (`n_chars`, if there, follows).
    Rows that lose all their ink to earlier documents are dropped; others, also without any ink, stay.

    Earlier means the smaller id, rows without id last; rows that share an id are told apart by their text, and equal
    rows are one document. Lines are judged on the input, so the first holder of a line keeps it. Blank lines, without ink,
    are never compared and go with the line above them.
    """
    names = docs.columns

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row = b.column(0)
            columns = dict(zip(names, row.flatten(), strict=True))
            texts, kept = columns["text"].to_pylist(), []
            keep = np.ones(b.num_rows, bool)
            for k, (text, gone) in enumerate(zip(texts, b.column(1).to_pylist(), strict=True)):
                left = _cut_lines(text, gone)[2] if gone else text
                keep[k] = not gone or bool(left.strip())
                kept.append(left)
            columns["text"] = pa.array(kept, columns["text"].type)
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([n if t is old else len(t) for t, old, n in zip(kept, texts, columns["n_chars"].to_pylist(), strict=True)], columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names).filter(pa.array(keep))

    return _marked(docs, rare).mapInArrow(finish, docs.schema)


def line_report(docs: DataFrame, rare: int = RARE) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept_sha256) of every row; null text has no lines, an empty one has one,
    other columns are not read, repeated rows get the same result, long texts are aligned whole, an empty table gives none."""

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0).flatten()
            done = [_cut_lines(t, g) if t is not None else (0, 0, "") for t, g in zip(texts.to_pylist(), b.column(1).to_pylist(), strict=True)]
            sha = [hashlib.sha256(t.encode()).hexdigest() for _, _, t in done]
            yield pa.RecordBatch.from_arrays([ids, pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_lines", "n_removed", "kept_sha256"])

    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    return _marked(own, rare).mapInArrow(finish, "doc_id long, n_lines long, n_removed long, kept_sha256 string")


def op6_line_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
