"""Quality by nearest labelled neighbours in a latent-semantic space (operator 10)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.llm.text import U, pieces, utf8, word_hashes, words
from cadence.session import bound_arrow

#: Hash cells of byte pairs, of word shapes and of words; then the shares of words that repeat
#: the word before, that don't, that are new to the text, that aren't.
PAIRS, SHAPES, TERMS, SHARES = 1024, 512, 1024, 4
WIDTH = PAIRS + SHAPES + TERMS + SHARES
#: Bytes and rows whose features are held at a time: 512 rows of features are 5 MB, however short the texts.
FEW_BYTES, FEW_ROWS = 512 << 10, 512
#: Documents that score at least this are taken for good.
THRESHOLD = 0.7
#: Byte classes of a word's shape: lower, upper, digit, bytes of other letters, and each ASCII sign by itself.
CLASS = np.arange(256, dtype=np.uint64)
CLASS[97:123], CLASS[65:91], CLASS[48:58], CLASS[128:] = 1, 2, 3, 1


def _count(out: np.ndarray, doc: np.ndarray, cell: np.ndarray, first: int, n: int) -> None:
    docs = out.shape[0]
    found = np.bincount(doc * n + cell, minlength=docs * n).reshape(docs, n)
    out[:, first : first + n] = found


def _piece(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    n = len(off) - 1
    out = np.zeros((n, WIDTH), np.float32)
    if not len(buf):
        return out
    size = np.diff(off)
    doc = np.repeat(np.arange(n), size)
    pair = (buf[:-1].astype(np.uint32) << np.uint32(8)) | buf[1:]
    pair = ((pair * np.uint32(2654435769)) >> np.uint32(32 - 10)).astype(np.int64)
    same = doc[:-1] == doc[1:]
    _count(out, doc[:-1][same], pair[same], 0, PAIRS)
    start, end, woff = words(buf, off)
    if len(start):
        wdoc = np.repeat(np.arange(n), np.diff(woff))
        kind = CLASS[buf]
        fresh = np.ones(len(buf), bool)
        fresh[1:] = kind[1:] != kind[:-1]
        fresh[start] = True
        at = np.flatnonzero(fresh)
        shaped = buf[at].copy()
        shaped[:] = kind[at]
        where = np.searchsorted(at, start), np.searchsorted(at, end)
        shape = word_hashes(shaped, *where)
        _count(out, wdoc, (shape % U(SHAPES)).astype(np.int64), PAIRS, SHAPES)
        term = word_hashes(buf, start, end)
        _count(out, wdoc, (term % U(TERMS)).astype(np.int64), PAIRS + SHAPES, TERMS)
        order = np.lexsort((term, wdoc))
        new = np.ones(len(term), bool)
        new[1:] = (term[order][1:] != term[order][:-1]) | (wdoc[order][1:] != wdoc[order][:-1])
        distinct = np.bincount(wdoc[order][new], minlength=n)
        count = np.maximum(np.diff(woff), 1)
        last = PAIRS + SHAPES + TERMS
        echo = np.zeros(len(term), bool)
        echo[1:] = (term[1:] == term[:-1]) & (wdoc[1:] == wdoc[:-1])
        echoes = np.bincount(wdoc[echo], minlength=n)
        out[:, last : last + 4] = np.stack([echoes / count, 1 - echoes / count, distinct / count, 1 - distinct / count], 1)
    return out


def featured(texts: pa.Array | pa.ChunkedArray) -> Iterator[np.ndarray]:
    """Counts of byte pairs, word shapes and words in hash cells, and shares, of each whole text, in pieces of few rows."""
    buf, off = utf8(texts)
    for i, j in pieces(off, FEW_BYTES, FEW_ROWS):
        yield _piece(buf[off[i] : off[j]], off[i : j + 1] - off[i])


def features(texts: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """All pieces of `featured` in one matrix, for few texts."""
    return np.concatenate([np.zeros((0, WIDTH), np.float32), *featured(texts)])


@dataclass(frozen=True)
class Model:
    weight: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    neighbours: int


def _scaled(x: np.ndarray) -> np.ndarray:
    out = np.empty_like(x)
    at = 0
    for n in (PAIRS, SHAPES, TERMS):
        part = np.sqrt(x[:, at : at + n])
        out[:, at : at + n] = part / np.maximum(np.sqrt((part * part).sum(1, keepdims=True)), 1e-9)
        at += n
    out[:, at:] = np.sqrt(x[:, at:])
    return out


def _units(z: np.ndarray) -> np.ndarray:
    return z / np.maximum(np.sqrt((z * z).sum(1, keepdims=True)), 1e-9)


def latent(model: Model, x: np.ndarray) -> np.ndarray:
    return _units((_scaled(x) * model.weight) @ model.axes)


def fit(s: np.ndarray, y: np.ndarray, rank: int = 64, neighbours: int = 25, rounds: int = 8) -> Model:
    """From scaled features. The latent space is spanned by the leading right singular vectors of the variance-weighted
    features, found by subspace iteration, so that beside the features only thin matrices are held."""
    if not len(s):
        return Model(np.ones(WIDTH, np.float32), np.zeros((WIDTH, rank), np.float32), np.zeros((0, rank), np.float32), np.zeros(0, np.float32), neighbours)
    a = s.astype(np.float32)
    weight = np.empty(WIDTH, np.float32)
    for i in range(0, WIDTH, 256):
        weight[i : i + 256] = np.sqrt(1 / np.maximum(a[:, i : i + 256].std(0), 0.02))
    a *= weight
    q = np.random.default_rng(10).standard_normal((WIDTH, rank + 16), np.float32)
    for _ in range(rounds):
        q, _ = np.linalg.qr(a.T @ (a @ q))
    thin = a @ q
    _, turn = np.linalg.eigh((thin.T @ thin).astype(np.float64))
    axes = np.ascontiguousarray(q @ turn[:, ::-1][:, :rank].astype(np.float32))
    return Model(weight, axes, _units(a @ axes), y.astype(np.float32), neighbours)


def score(model: Model, x: np.ndarray, block: int = 1024) -> np.ndarray:
    """Similarity-weighted vote of the nearest labelled vectors; every row meets every labelled vector, block by block."""
    out = np.full(len(x), 0.5)
    k = min(model.neighbours, len(model.labels))
    for i in range(0, len(x) if k else 0, block):
        near = latent(model, x[i : i + block]) @ model.vectors.T
        best = np.argpartition(-near, k - 1, axis=1)[:, :k]
        w = np.maximum(np.take_along_axis(near, best, 1), 0).astype(np.float64) ** 8 + 1e-9
        out[i : i + block] = (w * model.labels[best]).sum(1) / w.sum(1)
    return np.clip(out, 0, 1)


def judge(model: Model, texts: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Scores of whole texts, piece by piece, so that memory is that of one piece's features."""
    return np.concatenate([np.zeros(0), *(score(model, x) for x in featured(texts))])


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = 4096, rank: int = 64, neighbours: int = 25) -> Model:
    """Fit on at most `sample` labelled documents that are not held out, the first in the order of a hash of their ids.

    That bound makes the model's size (about 2 MB) and what comes to the driver (20 MB) independent of the input. Of
    repeated labels the smallest counts, of repeated ids the smallest text. Rows without id or label are passed over.
    With nothing to learn from, every score is 0.5.
    """
    bound_arrow(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where("doc_id is not null and y is not null")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("y").alias("y"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    rows = own.join(F.broadcast(known), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = featured(b.column(b.schema.get_field_index("text")))
            packed = pa.array([r.tobytes() for x in made for r in _scaled(x).astype(np.float16)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), packed], ["doc_id", "y", "x"])

    found = sorted(rows.mapInArrow(seen, "doc_id long, y int, x binary").collect())
    x = np.empty((len(found), WIDTH), np.float16)
    for k, r in enumerate(found):
        x[k] = np.frombuffer(r.x, np.float16)
    y = np.array([r.y for r in found], np.float32)
    del found
    return fit(x, y, rank, neighbours)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row. Only the text is read for the score; null text counts as empty,
    repeated rows and null ids are kept, other columns are ignored, and an empty table gives no rows. Texts are read
    whole; a piece holds 512 rows or half a megabyte, or one longer text. Equal texts score equally up to rounding; labelled
    vectors tied at the last place of the nearest count as the sort leaves them."""
    bound_arrow(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = judge(shared.value, b.column(b.schema.get_field_index("text")))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s)], ["doc_id", "held_out", "score"])

    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), held_out(docs["doc_id"]).alias("held_out"), docs["text"].alias("text"))
    scored = own.mapInArrow(judged, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` that score at least `threshold`, with all their columns."""
    bound_arrow(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(judge(shared.value, b.column(b.schema.get_field_index("text"))) >= threshold))

    return docs.mapInArrow(keep, docs.schema)


def op10_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_documents(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
