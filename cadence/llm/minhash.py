"""Near-duplicate documents by circulant MinHash with exact verification (operator 2).

Two permutations make a whole signature: the first scatters shingles over a circle of positions, the second orders the
positions; coordinate k is the least rank met when every position is shifted by k. So one contiguous slice of the second
permutation per shingle gives all coordinates. Bands of coordinates propose, a byte of each coordinate screens, and the
full shingle sets decide.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadence.llm.groups import in_blocks, in_cells, runs, spanning
from cadence.llm.text import LOWER, U, mix, pieces, utf8, windows, word_hashes, words
from cadence.operators.graph import connected_components
from cadence.session import bound_arrow, cut


@dataclass(frozen=True)
class Shingling:
    """Sets of `length`-word shingles, linked at a Jaccard similarity of `percent` / 100.

    `bands` bands of `rows` coordinates: a pair at 0.8 shares none with probability (1 - 0.8 ** 5) ** 30 = 7e-6. Of the
    150 coordinates at least `screen` must agree in a byte: five standard deviations below a pair at 0.8.
    `weight` bounds a verification block, in shingles."""

    length: int = 5
    percent: int = 80
    bands: int = 30
    rows: int = 5
    screen: int = 95
    circle: int = 22
    block: int = 1024
    weight: int = 1_000_000
    seed: int = 2

    @property
    def width(self) -> int:
        return self.bands * self.rows


@functools.lru_cache(maxsize=2)
def _ranks(s: Shingling) -> np.ndarray:
    """The second permutation, wrapped so that the slice from every position is contiguous."""
    order = np.random.default_rng(s.seed).permutation(1 << s.circle).astype(np.int32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([order, order[: s.width]]), s.width)


def shingle_sets(s: Shingling, buf: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document; fewer words than a shingle count as one, none as none."""
    start, end, woff = words(buf, off)
    h = word_hashes(buf, start, end, LOWER)
    every = windows(h, s.length)
    out = []
    for i, j in zip(woff[:-1].tolist(), woff[1:].tolist(), strict=True):
        if j - i >= s.length:
            out.append(np.unique(every[i : j - s.length + 1]))
        else:
            out.append(windows(h[i:j], j - i) if j > i else np.zeros(0, np.uint64))
    return out


def signature(s: Shingling, hashes: np.ndarray) -> np.ndarray:
    ranks, out = _ranks(s), np.full(s.width, np.iinfo(np.int32).max, np.int32)
    place = (mix(hashes ^ U(0x5851F42D4C957F2D)) >> U(64 - s.circle)).astype(np.int64)
    for i in range(0, len(place), 2048):
        np.minimum(out, ranks[place[i : i + 2048]].min(0), out=out)
    return out


def _set_keys(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two order-free sums that name a set."""
    with np.errstate(over="ignore"):
        one = np.array([mix(x).sum(dtype=np.uint64) for x in sets], np.uint64)
        two = np.array([mix(x ^ U(0xA0761D6478BD642F)).sum(dtype=np.uint64) for x in sets], np.uint64)
    return one.view(np.int64), two.view(np.int64)


def _prints(s: Shingling):
    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, off = utf8(b.column(2))
            for i, j in pieces(off):
                sets = shingle_sets(s, buf[off[i] : off[j]], off[i : j + 1] - off[i])
                sig = np.stack([signature(s, x) for x in sets])
                one, two = _set_keys(sets)
                sketch = pa.array([r.tobytes() for r in sig.astype(np.uint8)], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(one), pa.array(two), pa.array([len(x) for x in sets], pa.int64()), sketch], ["id", "text_key", "k1", "k2", "n", "sketch"])

    return printed


def _edges(a: list[np.ndarray], b: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    if a and sum(map(len, a)):
        u, v = spanning(np.concatenate(a), np.concatenate(b))
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["a", "b"])


#: Groups up to so many rows are compared along diagonals, all groups of a table at once.
SMALL = 48


def _screened(s: Shingling):
    """Per cell of a bucket: rows whose sketches agree often enough, as edges of a spanning forest."""

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in runs(batches, ["bucket", "one", "two"]):
            table = table.combine_chunks()
            get = lambda c: table.column(c).to_numpy()  # noqa: B023, E731
            cid, side, one, two = get("cid"), get("side"), get("one"), get("two")
            raw, off = utf8(table.column("sketch").cast(pa.large_binary()))
            sketch = raw.reshape(len(cid), s.width)
            size = np.diff(np.append(starts, len(cid)))
            group = np.repeat(np.arange(len(starts)), size)
            a, b = [], []
            small = size[group] <= SMALL
            for d in range(1, min(SMALL, int(size.max()))):
                at = np.flatnonzero(small[:-d] & (group[:-d] == group[d:]))
                if not len(at):
                    break
                at = at[(side[at] != side[at + d]) | (one[at] == two[at])]
                for k in range(0, len(at), 1 << 16):
                    part = at[k : k + (1 << 16)]
                    part = part[(sketch[part] == sketch[part + d]).sum(1) >= s.screen]
                    a.append(cid[part])
                    b.append(cid[part + d])
            for g in np.flatnonzero(size > SMALL):
                rows = np.arange(starts[g], starts[g] + size[g])
                inner = one[rows[0]] == two[rows[0]]
                left = rows if inner else rows[side[rows] == one[rows[0]]]
                right = rows if inner else rows[side[rows] == two[rows[0]]]
                for k in range(0, len(left), 32):
                    part = left[k : k + 32]
                    i, j = np.nonzero((sketch[part][:, None, :] == sketch[right][None, :, :]).sum(2) >= s.screen)
                    i, j = part[i], right[j]
                    a.append(cid[i[i != j]])
                    b.append(cid[j[i != j]])
            yield from _edges(a, b)

    return screen


def _sets(s: Shingling):
    """The shingle set of each proposed document; rows of its id that hold another set fall out."""

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, off = utf8(b.column(b.schema.get_field_index("text")))
            k1, k2 = (b.column(b.schema.get_field_index(k)).to_numpy() for k in ("k1", "k2"))
            for i, j in pieces(off):
                sets = shingle_sets(s, buf[off[i] : off[j]], off[i : j + 1] - off[i])
                one, two = _set_keys(sets)
                right = np.flatnonzero((one == k1[i:j]) & (two == k2[i:j]))
                part = b.slice(i, j - i).take(pa.array(right))
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(k)) for k in ("cid", "comp", "side", "blocks")), pa.array([sets[k].tobytes() for k in right], pa.binary())], ["cid", "comp", "side", "blocks", "set"])

    return gathered


def links_in_cell(percent: int, cid: np.ndarray, sets: list[np.ndarray], side: np.ndarray, one: int, two: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs with 100 * intersection >= percent * union, from exact counts over posting lists."""
    n = np.array([len(x) for x in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), n)
    order = np.argsort(flat, kind="stable")
    head = np.ones(len(flat), bool)
    head[1:] = flat[order][1:] != flat[order][:-1]
    column = np.empty(len(flat), np.int64)
    column[order] = np.cumsum(head) - 1
    first = np.flatnonzero(head)
    length = np.diff(np.append(first, len(flat)))
    posted = owner[order]
    at = np.concatenate([[0], np.cumsum(n)])
    a, b = [], []
    for i in range(len(sets)):
        if one != two and side[i] != one:
            continue
        mine = column[at[i] : at[i + 1]]
        mine = mine[length[mine] > 1]
        size = length[mine]
        total = np.cumsum(size)
        count = np.zeros(len(sets), np.int64)
        k = 0
        while k < len(mine):
            stop = max(k + 1, int(np.searchsorted(total, (total[k - 1] if k else 0) + 4_000_000)))
            part = size[k:stop]
            spot = np.arange(part.sum()) + np.repeat(first[mine[k:stop]] - (np.cumsum(part) - part), part)
            count += np.bincount(posted[spot], minlength=len(sets))
            k = stop
        hit = np.flatnonzero(100 * count >= percent * (n[i] + n - count))
        hit = hit[hit > i] if one == two else hit[side[hit] == two]
        a.append(np.full(len(hit), cid[i]))
        b.append(cid[hit])
    return np.concatenate(a) if a else np.zeros(0, np.int64), np.concatenate(b) if b else np.zeros(0, np.int64)


def _verified(s: Shingling):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in runs(batches, ["comp", "one", "two"]):
            table = table.combine_chunks()
            get = lambda c: table.column(c).to_numpy()  # noqa: B023, E731
            cid, side, one, two = get("cid"), get("side"), get("one"), get("two")
            packed = table.column("set")
            a, b = [], []
            for i, j in zip(starts, np.append(starts[1:], len(cid)), strict=True):
                _, fresh = np.unique(cid[i:j], return_index=True)
                fresh = fresh + i
                if len(fresh) < 2:
                    continue
                sets = [np.frombuffer(packed[int(k)].as_buffer(), np.uint64) for k in fresh]
                u, v = links_in_cell(s.percent, cid[fresh], sets, side[fresh], one[i], two[i])
                a.append(u)
                b.append(v)
            yield from _edges(a, b)

    return verify


def _bands(s: Shingling) -> Column:
    """A number per band: its place and a byte of each of its coordinates."""
    band = lambda b: F.conv(F.hex(F.substring("sketch", b * s.rows + 1, s.rows)), 16, 10).cast("long") + F.lit(b << 8 * s.rows)
    return F.array(*[band(b) for b in range(s.bands)])


def near_duplicates(docs: DataFrame, s: Shingling = Shingling()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_key) of every row; documents are linked where
    100 * intersection >= percent * union of their shingle sets, and components are those of the links.

    Equal sets are collapsed first, so thousands of copies are one class. Buckets of equal bands and groups of proposed
    documents are split into cells of about bounded size that pair block with block, and a cell gives a spanning forest,
    never its pairs. A pair at just 0.8 is lost where it shares no band (7e-6) or where fewer than `screen` of its
    coordinates agree in a byte (3e-7). Screening splits proposals into tight groups; each document's full set travels once (once per cell, where
    a group is larger than a block) and every pair of such a group is decided by exact counts.

    Words are runs without ASCII white space with A-Z lowered. Null and empty texts have no shingles and link with
    nothing; rows without doc_id count as the largest ids; rows that share an id are
    told apart by their text; repeated rows get the same result; other columns are not read; an empty table gives no rows.
    """
    number = lambda c: F.nullif(F.col(c), F.lit(2**63 - 1))
    return _components(docs, s).select(number("id").alias("doc_id"), F.col("n").alias("n_shingles"), number("component_id").alias("component_id"), (F.col("id") == F.col("component_id")).alias("kept"), "text_key")


def _components(docs: DataFrame, s: Shingling) -> DataFrame:
    """(id, text_key, n, component_id, component) of every row: ids can repeat, so different components can share their
    least id `component_id`, but not their number `component`; it is null for rows without shingles."""
    spark = docs.sparkSession
    bound_arrow(spark)
    own = docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(2**63 - 1)).alias("id"), F.coalesce(F.xxhash64(docs["text"]), F.lit(0)).alias("text_key"), docs["text"].alias("text"))
    prints = cut(own.mapInArrow(_prints(s), "id long, text_key long, k1 long, k2 long, n long, sketch binary"))
    classes = prints.where("n > 0").groupBy("k1", "k2", "n").agg(F.min("id").alias("rep"), F.first("sketch").alias("sketch"))
    classes = cut(classes.select(F.monotonically_increasing_id().alias("cid"), "rep", "k1", "k2", "n", "sketch"))
    banded = in_blocks(classes.select("cid", F.explode(_bands(s)).alias("bucket")), ["bucket"], "cid", F.lit(1), s.block)
    proposed = in_cells(banded.join(classes.select("cid", "sketch"), "cid"), ["bucket"])
    groups = connected_components(proposed.mapInArrow(_screened(s), "a long, b long"), "a", "b").withColumnRenamed("node", "cid").withColumnRenamed("component", "comp")
    groups = groups.join(classes.select("cid", "rep", "k1", "k2", "n"), "cid")
    groups = in_blocks(groups, ["comp"], "cid", F.col("n") + s.weight // 500, s.weight).select("cid", "comp", "rep", "k1", "k2", "side", "blocks")
    texts = own.select("id", "text").join(groups, F.col("id") == F.col("rep")).select("cid", "comp", "k1", "k2", "side", "blocks", "text")
    sets = texts.mapInArrow(_sets(s), "cid long, comp long, side int, blocks int, set binary")
    linked = connected_components(in_cells(sets, ["comp"]).mapInArrow(_verified(s), "a long, b long"), "a", "b")
    named = classes.select("cid", "rep", "k1", "k2", "n").join(linked, F.col("cid") == F.col("node"), "left").withColumn("component", F.coalesce("component", "cid"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "component").select("k1", "k2", F.col("n").alias("c_n"), "component_id", "component")
    slim = prints.select("id", "text_key", "k1", "k2", "n")
    full = slim.where("n > 0").join(named.withColumnRenamed("k1", "c1").withColumnRenamed("k2", "c2"), (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")) & (F.col("n") == F.col("c_n")))
    none = slim.where("n = 0").withColumns({"component_id": F.col("id"), "component": F.lit(None).cast("long")})
    columns = ["id", "text_key", "n", "component_id", "component"]
    return full.select(*columns).unionByName(none.select(*columns))


def one_of_each(docs: DataFrame, s: Shingling = Shingling()) -> DataFrame:
    """One row of `docs`, with all columns, of each component: that with the smallest id, then the least hash of its text,
    then of its other columns. Rows without shingles are components of their own; if id and text are equal, of one."""
    lone = lambda c: F.when(F.col("component").isNull(), F.col(c))
    kept = _components(docs, s).groupBy("component", lone("id").alias("l_id"), lone("text_key").alias("l_key")).agg(F.min(F.struct("id", "text_key")).alias("k"))
    kept = kept.select(F.col("k.id").alias("k_id"), F.col("k.text_key").alias("k_key"))
    others = [docs[f.name] for f in docs.schema if f.name not in ("doc_id", "text") and "map<" not in f.dataType.simpleString()]
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.coalesce(docs["doc_id"].cast("long"), F.lit(2**63 - 1)).alias("k_id"), F.coalesce(F.xxhash64(docs["text"]), F.lit(0)).alias("k_key"), F.xxhash64(F.lit(0), *others).alias("k_rest"))
    place = F.row_number().over(Window.partitionBy("k_id", "k_key").orderBy("k_rest"))
    return rows.join(kept, ["k_id", "k_key"], "left_semi").withColumn("place", place).where("place = 1").select("row.*")


def op2_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs, Shingling(length=4)).select("doc_id", "n_shingles", "component_id", "kept")


OP2_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, least(len(w), 1)) + 1)) AS i FROM d)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * k >= 80 * (x.n + y.n - k)),
r AS (SELECT doc_id AS a, doc_id AS c FROM d UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.a),
m AS (SELECT a, min(c) AS c FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, m.c = d.doc_id AS kept
FROM d JOIN m ON m.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
