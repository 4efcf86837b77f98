"""Exact removal of repeated word windows by level-wise doubling (operator 4).

Words are hashed once. Windows of a base length are looked up across the corpus; only those that occur again are joined
with their neighbours to windows of twice the length, and so on up to the wanted length. Hashes travel in blocks: a task
gathers documents to chunks of some million words, and asks for each range of hashes (a bucket) in one packed row, in
which a window takes about seven bytes. A window that a chunk holds more than once is asked for once, so a passage that
very many documents share makes at most one entry per chunk, whatever its frequency.
"""

from __future__ import annotations

import functools
import hashlib
import struct
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.llm.groups import runs
from cadence.llm.text import U, inside, mix, pieces, utf8, windows, word_hashes, words
from cadence.session import bound_arrow, shuffle_width

#: Bits of a window's hash where repeats are only candidates, and at the last length, where they decide; words of a
#: chunk; buckets per shuffle partition.
BITS, LAST_BITS, CHUNK, FINE = 48, 64, 1_000_000, 4
ROWS = "bucket int, chunk long, kind int, payload binary"
NAMES = ["bucket", "chunk", "kind", "payload"]
TYPES = [pa.int32(), pa.int64(), pa.int32(), pa.binary()]
DIRECTORY, OWN, ASK, REPLY = range(4)
_TOP = U(1) << U(63)


def pack(*arrays: np.ndarray) -> bytes:
    """Unsigned numbers in as few whole bytes as the largest needs, byte plane after byte plane; a plane whose bytes are
    not evenly spread (the top ones) is entropy-coded."""
    out = [struct.pack("<B", len(arrays))]
    for a in arrays:
        a = np.ascontiguousarray(a, np.uint64)
        width = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
        out.append(struct.pack("<IB", len(a), width))
        for plane in a.view(np.uint8).reshape(-1, 8)[:, :width].T:
            raw = plane.tobytes()
            small = _coder()[0].compress(raw) if len(raw) > 64 else raw
            kept = small if len(small) < len(raw) else raw
            out += [struct.pack("<I", len(kept)), kept]
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    out, at = [], 1
    for _ in range(data[0]):
        n, width = struct.unpack_from("<IB", data, at)
        wide = np.zeros((n, 8), np.uint8)
        at += 5
        for k in range(width):
            (size,) = struct.unpack_from("<I", data, at)
            plane = data[at + 4 : at + 4 + size]
            wide[:, k] = np.frombuffer(plane if size == n else _coder()[1].decompress(plane, max_output_size=n), np.uint8)
            at += 4 + size
        out.append(wide.view(np.uint64).reshape(n))
    return out


@functools.lru_cache(maxsize=1)
def _coder() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    return zstandard.ZstdCompressor(level=1, write_content_size=False), zstandard.ZstdDecompressor()


def _gaps(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=U(0))


class _Rows:
    """Output rows, released as batches of bounded size."""

    def __init__(self) -> None:
        self.rows, self.size = [], 0

    def add(self, bucket: int, chunk: int, kind: int, payload: bytes) -> None:
        self.rows.append((bucket, chunk, kind, payload))
        self.size += len(payload)

    def release(self, force: bool = False) -> Iterator[pa.RecordBatch]:
        if self.rows and (force or self.size > 8 << 20 or len(self.rows) > 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*self.rows, strict=True), TYPES, strict=True)], NAMES)
            self.rows, self.size = [], 0


class _Directory:
    """The documents of a chunk in order of id: ids, text keys, offsets into the chunk's words."""

    def __init__(self, ids: np.ndarray, keys: np.ndarray, offsets: np.ndarray) -> None:
        self.ids, self.keys, self.offsets = ids, keys, offsets

    def payload(self) -> bytes:
        return pack(self.ids.view(np.uint64) ^ _TOP, self.keys.view(np.uint64), _gaps(self.offsets.astype(np.uint64)))

    @classmethod
    def of(cls, payload: bytes) -> _Directory:
        ids, keys, gaps = unpack(payload)
        return cls((ids ^ _TOP).view(np.int64), keys.view(np.int64), np.cumsum(gaps).astype(np.int64))

    def place(self, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order key of the document, and start in it, of positions in the chunk."""
        doc = np.searchsorted(self.offsets, pos, side="right") - 1
        return self.ids[doc].view(np.uint64) ^ _TOP, (pos - self.offsets[doc]).astype(np.uint64)


def _ask(out: _Rows, chunk: int, directory: _Directory, name: np.ndarray, pos: np.ndarray, buckets: int, last: bool) -> None:
    """Questions about windows by their names, and what the chunk knows by itself, for one chunk.

    Before the last length a window that the chunk holds twice is repeated for certain: others are told so, and its
    places stay with the chunk. At the last length only the earliest place of a window is asked for; later ones are
    repeats whatever the answer is.
    """
    if last:
        doc, start = directory.place(pos)
        order = np.lexsort((start, doc, name))
    else:
        order = np.argsort(name, kind="stable")
    name, pos = name[order], pos[order]
    head = np.ones(len(name), bool)
    head[1:] = name[1:] != name[:-1]
    at = np.flatnonzero(head)
    size = np.diff(np.append(at, len(name)))
    if last:
        doc, start = doc[order], start[order]
        group = np.cumsum(head) - 1
        asked = (doc == doc[at][group]) & (start == start[at][group])
        own = [np.sort(pos[~asked]).astype(np.uint64)]
        told = np.zeros(0, np.uint64)
        columns = [pos[asked].astype(np.uint64), doc[asked], start[asked]]
    else:
        twice = np.repeat(size > 1, size)
        asked = ~twice
        by_place = np.argsort(pos[twice])
        own = [pos[twice][by_place].astype(np.uint64), name[twice][by_place]]
        told = name[at[size > 1]]
        columns = [pos[asked].astype(np.uint64)]
    name = name[asked]
    bits = LAST_BITS if last else BITS
    edges = np.array([(b << bits) // buckets for b in range(buckets)], np.uint64)
    cut, told_cut = (np.append(np.searchsorted(x, edges), len(x)) for x in (name, told))
    for b in range(buckets):
        i, j, s, t = cut[b], cut[b + 1], told_cut[b], told_cut[b + 1]
        if j > i or t > s:
            out.add(b, chunk, ASK, pack(_gaps(name[i:j]), _gaps(told[s:t]), *(c[i:j] for c in columns)))
    route = chunk % buckets
    out.add(route, chunk, DIRECTORY, directory.payload())
    out.add(route, chunk, OWN, pack(*own))


def _first(base: int, buckets: int, last: bool, most: int):
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, serial, held, total = _Rows(), TaskContext.get().partitionId() << 32, [], 0

        def chunked() -> None:
            nonlocal serial, held, total
            ids, keys, counts, h = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((keys, ids))
            offsets = np.concatenate([[0], np.cumsum(counts[order])])
            source = np.concatenate([[0], np.cumsum(counts)])[:-1][order]
            h = h[np.arange(len(h)) + np.repeat(source - offsets[:-1], counts[order])]
            pos = np.flatnonzero(inside(offsets, base))
            _ask(out, serial, _Directory(ids[order], keys[order], offsets), windows(h, base)[pos] >> U(64 - (LAST_BITS if last else BITS)), pos, buckets, last)
            serial, held, total = serial + 1, [], 0

        for b in batches:
            buf, off = utf8(b.column(2))
            ids, keys = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for i, j in pieces(off):
                part = buf[off[i] : off[j]]
                start, end, woff = words(part, off[i : j + 1] - off[i])
                held.append((ids[i:j], keys[i:j], np.diff(woff), word_hashes(part, start, end)))
                total += len(start)
                if total >= most:
                    chunked()
                    yield from out.release()
        if held:
            chunked()
        yield from out.release(True)

    return hashed


def _grouped(table: pa.Table, starts: np.ndarray, columns: list[str]) -> Iterator[list[list]]:
    data = [table.column(c).to_pylist() if c != "payload" else table.column(c) for c in columns]
    ends = np.append(starts[1:], table.num_rows)
    for i, j in zip(starts, ends, strict=True):
        yield [[c[k] if isinstance(c, list) else c[int(k)].as_py() for k in range(i, j)] for c in data]


def _answer(last: bool):
    """Per bucket: which asked windows occur elsewhere too (before the last length) or earlier (at it)."""

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Rows()
        for table, starts in runs(batches, ["bucket"]):
            for chunks, kinds, payloads in _grouped(table, starts, ["chunk", "kind", "payload"]):
                asks = []
                for chunk, kind, payload in zip(chunks, kinds, payloads, strict=True):
                    if kind == ASK:
                        asks.append((chunk, unpack(payload)))
                    else:
                        out.add(0, chunk, kind, payload)
                if not asks:
                    continue
                names = [np.cumsum(a[0], dtype=np.uint64) for _, a in asks]
                told = [np.cumsum(a[1], dtype=np.uint64) for _, a in asks]
                every = np.concatenate(names)
                if last:
                    doc, start = (np.concatenate([a[k] for _, a in asks]) for k in (3, 4))
                    order = np.lexsort((start, doc, every))
                    head = np.ones(len(every), bool)
                    head[1:] = every[order][1:] != every[order][:-1]
                    first = order[np.flatnonzero(head)][np.cumsum(head) - 1]
                    hit = np.zeros(len(every), bool)
                    hit[order] = (doc[order] != doc[first]) | (start[order] != start[first])
                else:
                    found, back, count = np.unique(np.concatenate([every, *told]), return_inverse=True, return_counts=True)
                    certain = count > 1
                    certain[back[len(every) :]] = True
                    hit = certain[back[: len(every)]]
                at = 0
                for (chunk, a), name in zip(asks, names, strict=True):
                    mine = hit[at : at + len(name)]
                    at += len(name)
                    if mine.any():
                        place = a[2][mine]
                        order = np.argsort(place)
                        out.add(0, chunk, REPLY, pack(_gaps(place[order]), *([] if last else [name[mine][order]])))
                yield from out.release()
        yield from out.release(True)

    return answered


def _gathered(kinds: list, payloads: list) -> tuple[_Directory, list[list[np.ndarray]]]:
    directory, parts = None, []
    for kind, payload in zip(kinds, payloads, strict=True):
        if kind == DIRECTORY:
            directory = _Directory.of(payload)
        else:
            part = unpack(payload)
            if kind == REPLY:
                part[0] = np.cumsum(part[0], dtype=np.uint64)
            parts.append(part)
    return directory, parts


def _double(length: int, buckets: int, last: bool):
    """Per chunk: windows of `length` that are repeated, and `length` words on another such one, make the next windows."""

    def doubled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Rows()
        for table, starts in runs(batches, ["chunk"]):
            for chunks, kinds, payloads in _grouped(table, starts, ["chunk", "kind", "payload"]):
                directory, parts = _gathered(kinds, payloads)
                pos, name = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
                order = np.argsort(pos)
                pos, name = pos[order].astype(np.int64), name[order]
                other = np.minimum(np.searchsorted(pos, pos + length), max(0, len(pos) - 1))
                whole = np.zeros(len(pos), bool)
                if len(pos):
                    end = directory.offsets[np.searchsorted(directory.offsets, pos, side="right")]
                    whole = (pos[other] == pos + length) & (pos + 2 * length <= end)
                with np.errstate(over="ignore"):
                    joined = mix(name[whole] * U(0xD6E8FEB86659FD93) + mix(name[other[whole]])) >> U(64 - (LAST_BITS if last else BITS))
                _ask(out, chunks[0], directory, joined, pos[whole], buckets, last)
                yield from out.release()
        yield from out.release(True)

    return doubled


def _removed(length: int):
    """Per chunk: the words that repeated windows cover, as gaps and lengths of runs per document."""

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in runs(batches, ["chunk"]):
            rows = []
            for kinds, payloads in _grouped(table, starts, ["kind", "payload"]):
                directory, parts = _gathered(kinds, payloads)
                pos = np.unique(np.concatenate([p[0] for p in parts])).astype(np.int64)
                if not len(pos):
                    continue
                doc = np.searchsorted(directory.offsets, pos, side="right") - 1
                fresh = np.ones(len(pos), bool)
                fresh[1:] = (pos[1:] > pos[:-1] + length) | (doc[1:] != doc[:-1])
                begin = pos[fresh]
                stop = pos[np.append(np.flatnonzero(fresh)[1:], len(pos)) - 1] + length
                owner = doc[fresh]
                edge = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
                for i, j in zip(edge, np.append(edge[1:], len(owner)), strict=True):
                    d = owner[i]
                    rows.append((int(directory.ids[d]), int(directory.keys[d]), pack(begin[i:j] - directory.offsets[d], stop[i:j] - begin[i:j])))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["r_id", "r_key", "covered"])

    return marked


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows without id come last in the order of ids; rows that share an id are told apart by their text's hash."""
    return docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(2**63 - 1)).alias("id"), F.coalesce(F.xxhash64(docs["text"]), F.lit(0)).alias("key"), docs["text"].alias("text"), docs["doc_id"].cast("long").alias("doc_id"))


def repeated_runs(docs: DataFrame, window: int = 20, base: int = 10, chunk: int = CHUNK) -> DataFrame:
    """(r_id, r_key, covered): per document with repeats, the runs of words that some window of `window` words covers
    whose sequence also starts earlier (smaller id, or same document and earlier start).

    window = base * 2 ** k. All of it is one lazy plan: hash, then for each length ask by bucket and answer by chunk. `docs`
    should be read from files or be checkpointed: a task that runs again must see its rows in the same order.
    """
    levels = (window // base).bit_length() - 1
    if base << levels != window or base < 1:
        raise ValueError("window must be base times a power of two")
    spark = docs.sparkSession
    bound_arrow(spark)
    width = shuffle_width(spark)
    buckets = FINE * width
    rows = _keyed(docs).select("id", "key", "text").mapInArrow(_first(base, buckets, levels == 0, chunk), ROWS)
    for k in range(levels + 1):
        last = k == levels
        rows = rows.repartition(width, "bucket").sortWithinPartitions("bucket").mapInArrow(_answer(last), ROWS)
        rows = rows.repartition(width, "chunk").sortWithinPartitions("chunk")
        if not last:
            rows = rows.mapInArrow(_double(base << k, buckets, k + 1 == levels), ROWS)
    found = rows.mapInArrow(_removed(window), "r_id long, r_key long, covered binary")
    return found.groupBy("r_id", "r_key").agg(F.first("covered").alias("covered"))


def _kept(data: bytes, covered: bytes | None) -> tuple[int, int, list[bytes]]:
    found = data.split()
    if covered is None:
        return len(found), 0, found
    keep = np.ones(len(found), bool)
    for begin, size in zip(*(x.tolist() for x in unpack(covered)), strict=True):
        keep[begin : begin + size] = False
    return len(found), int((~keep).sum()), list(compress(found, keep))


def _finish(with_text: bool):
    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, n_removed, sha, texts = [], [], [], []
            for text, covered in zip(b.column(1), b.column(2), strict=True):
                n, gone, kept = _kept(text.as_buffer().to_pybytes() if text.is_valid else b"", covered.as_py())
                joined = b" ".join(kept)
                n_words.append(n)
                n_removed.append(gone)
                sha.append(hashlib.sha256(joined).hexdigest())
                texts.append(joined.decode() if with_text else None)
            made = [b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays([*made, *([pa.array(texts, pa.string())] if with_text else [])], ["doc_id", "n_words", "n_removed", "kept_sha256", *(["kept_text"] if with_text else [])])

    return finished


def remove_repeats(docs: DataFrame, window: int = 20, base: int = 10, with_text: bool = False, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept_text]) of every row: its text without the words that repeated
    windows cover, joined by single spaces.

    Null text has no words; texts shorter than the window lose nothing. Rows that share id and text get the same result
    and are not repeats of each other; rows that share the id alone are documents of their own in one order. Rows without
    id come after all others. Other columns are not read; an empty table gives no rows.
    """
    own = _keyed(docs)
    runs_of = repeated_runs(docs, window, base, chunk)
    joined = own.join(runs_of, (own["id"] == runs_of["r_id"]) & (own["key"] == runs_of["r_key"]), "left").select("doc_id", "text", "covered")
    return joined.mapInArrow(_finish(with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)


def op4_repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, len(w) AS n, i, array_to_string(w[i:i + 19], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM p) WHERE k > 1),
g AS (SELECT DISTINCT doc_id, i + k AS j FROM r, range(20) AS x(k)),
u AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS t FROM d),
k AS (SELECT u.doc_id, string_agg(t, ' ' ORDER BY u.j) AS kept, count(*) AS n FROM u ANTI JOIN g ON u.doc_id = g.doc_id AND u.j = g.j GROUP BY u.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
