"""Alignment of two tokenizers over the same bytes, by byte-owner arrays (operator 11)."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.llm.groups import runs
from cadence.llm.packing import LONG_BLANK
from cadence.llm.text import pieces, utf8
from cadence.session import bound_arrow, cut

#: Bytes of text whose distinct id pairs are counted before they leave a task.
CHUNK = 32 << 20
ALIGNED = "doc_id long, a_ids array<int>, b_ids array<int>, a_in_group array<int>, b_in_group array<int>, link_a array<int>, link_b array<int>"
REPORT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
PIECE = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("steps", pa.list_(pa.int32())), ("times", pa.list_(pa.int32()))])
DIGITS = 10


@dataclass(frozen=True)
class Tokenizers:
    """Paths of a byte-level BPE file (A), of the same vocabulary as ranks (only faster; None does without), and of a
    piece model with byte fallback (B). All None: the public files of the `public_tokenizers` package."""

    model_a: str | None = None
    ranks_a: str | None = None
    model_b: str | None = None


def _byte_of_letter() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable Latin-1 stands for itself, and the other bytes
    in order for the letters from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}


class Spelling:
    """The bytes of each id of a vocabulary, end to end in one array."""

    def __init__(self, words: list[bytes]) -> None:
        self.size = np.array([len(w) for w in words], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(words), np.uint8)

    def of(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        return self.flat[np.arange(int(size.sum())) + np.repeat(self.start[ids] - (np.cumsum(size) - size), size)]


class Both:
    """The two encoders and the spellings of their ids."""

    _made: dict[Tokenizers, Both] = {}

    def __init__(self, files: Tokenizers) -> None:
        import public_tokenizers
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        path_a = files.model_a or public_tokenizers.path("byte_bpe_50k.json")
        ranks = files.ranks_a or (public_tokenizers.path("byte_bpe_50k.tiktoken") if files.model_a is None else None)
        self.exact = Tokenizer.from_file(path_a)
        self.exact.encode_special_tokens = True
        letters = _byte_of_letter()
        names = self.exact.get_vocab(with_added_tokens=True)
        words = [b""] * (max(names.values()) + 1)
        for name, k in names.items():
            words[k] = bytes(letters[c] for c in name) if all(c in letters for c in name) else name.encode()
        self.a = Spelling(words)
        self.fast = None
        if ranks:
            with open(ranks, "rb") as lines:
                merges = {base64.b64decode(x): int(y) for x, y in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
        self.model_b = sentencepiece.SentencePieceProcessor(model_file=files.model_b or public_tokenizers.path("piece_bpe_32k.model"))
        ids = range(self.model_b.get_piece_size())
        names_b = [self.model_b.id_to_piece(k) for k in ids]
        self.b = Spelling([bytes([int(n[1:-1], 16)]) if self.model_b.is_byte(k) else n.replace("▁", " ").encode() for k, n in zip(ids, names_b, strict=True)])

    @classmethod
    def of(cls, files: Tokenizers) -> Both:
        if files not in cls._made:
            cls._made[files] = cls(files)
        return cls._made[files]

    def encode_a(self, text: str) -> list[int]:
        """Ids of a text; the rank form gives the same ids and leaves long white space to the file's own library."""
        if self.fast is not None and not LONG_BLANK.search(text):
            try:
                return self.fast.encode_ordinary(text)
            except ValueError:
                pass
        return self.exact.encode(text, add_special_tokens=False).ids

    def encode_b(self, texts: list[str]) -> list[list[int]]:
        return self.model_b.encode(texts, num_threads=1) if texts else []


@dataclass
class Aligned:
    """Tokens, groups and links of documents laid end to end: ids of both sides and the documents' offsets into them, the
    group of each token (counted through all documents), and the two token numbers of each link."""

    a: np.ndarray
    b: np.ndarray
    off_a: np.ndarray
    off_b: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    off_groups: np.ndarray
    off_links: np.ndarray


def _ids(found: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(x) for x in found], np.int64)
    return np.fromiter(chain.from_iterable(found), np.int64, int(sizes.sum())), sizes


def _spelled(side: Spelling, ids: np.ndarray, sizes: np.ndarray, buf: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Of each document, whether its tokens' bytes are its bytes."""
    cum = np.concatenate([[0], np.cumsum(side.size[ids])])
    ends = np.cumsum(sizes)
    own = cum[ends] - cum[ends - sizes]
    same = own == length
    doc = np.repeat(np.arange(len(sizes)), sizes)
    token = same[doc]
    bytes_ = np.repeat(same, length)
    wrong = side.of(ids[token]) != buf[bytes_]
    place = np.repeat(np.arange(len(sizes)), length)[bytes_]
    same[place[wrong]] = False
    return same


def align(texts: list[str | None], both: Both) -> Aligned:
    """Aligns space + text of each document. The owner of each byte is np.repeat of token numbers over token lengths; where
    either owner changes a link begins, and where both change at once a group does. Documents whose tokens do not spell
    their bytes have none."""
    spaced = [" " + t if t else "" for t in texts]
    buf, off = utf8(pa.array(spaced, pa.large_string()))
    length = np.diff(off)
    a, size_a = _ids([both.encode_a(t) if t else [] for t in spaced])
    b, size_b = _ids(both.encode_b([t or "" for t in texts]))
    use = _spelled(both.a, a, size_a, buf, length) & _spelled(both.b, b, size_b, buf, length) & (length > 0)
    a, b = a[np.repeat(use, size_a)], b[np.repeat(use, size_b)]
    size_a, size_b, length = np.where(use, size_a, 0), np.where(use, size_b, 0), np.where(use, length, 0)
    owner_a, owner_b = np.repeat(np.arange(len(a)), both.a.size[a]), np.repeat(np.arange(len(b)), both.b.size[b])
    new_a, new_b = np.diff(owner_a, prepend=-1) != 0, np.diff(owner_b, prepend=-1) != 0
    links = np.flatnonzero(new_a | new_b)
    starts = np.flatnonzero(new_a & new_b)
    off_bytes = np.concatenate([[0], np.cumsum(length)])
    group = np.cumsum(new_a & new_b) - 1
    off_a, off_b = (np.concatenate([[0], np.cumsum(s)]) for s in (size_a, size_b))
    return Aligned(a, b, off_a, off_b, group[new_a], group[new_b], owner_a[links], owner_b[links], np.searchsorted(starts, off_bytes), np.searchsorted(links, off_bytes))


def written(x: Aligned) -> list[str]:
    """The digest of each document's groups written out as a1,a2|b1;a3|b2,b3, or '' without tokens: every token's place in
    that text follows from the tokens of its side before it and those of the other side in groups before its own."""
    n, groups = len(x.a) + len(x.b), int(x.off_groups[-1])
    count_a, count_b = np.bincount(x.group_a, minlength=groups), np.bincount(x.group_b, minlength=groups)
    place_a = np.arange(len(x.a)) + (np.cumsum(count_b) - count_b)[x.group_a]
    place_b = np.arange(len(x.b)) + np.cumsum(count_a)[x.group_b]
    ids, mark = np.empty(n, np.int64), np.full(n, ord(","), np.uint8)
    ids[place_a], ids[place_b] = x.a, x.b
    last_a, last_b = (np.append(g[1:] != g[:-1], np.ones(min(len(g), 1), bool)) for g in (x.group_a, x.group_b))
    mark[place_a[last_a]], mark[place_b[last_b]] = ord("|"), ord(";")
    digits = np.ones(n, np.int64)
    for k in range(1, DIGITS):
        digits += ids >= 10**k
    start = np.concatenate([[0], np.cumsum(digits + 1)])
    out = np.empty(int(start[-1]), np.uint8)
    rest, at, left = ids, start[:-1] + digits - 1, digits
    for _ in range(DIGITS):
        out[at] = 48 + rest % 10
        on = left > 1
        if not on.any():
            break
        rest, at, left = rest[on] // 10, at[on] - 1, left[on] - 1
    out[start[1:] - 1] = mark
    ends = start[x.off_a + x.off_b]
    return [hashlib.sha256(out[i : j - 1].data).hexdigest() if j > i else "" for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def _lists(values: np.ndarray, off: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(values.astype(np.int32)))


def align_documents(docs: DataFrame, files: Tokenizers = Tokenizers(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, a_ids, b_ids, a_in_group, b_in_group, link_a, link_b) of each row: the ids of both sides, the group (from
    0) of each token, and each link's token numbers on both sides. Results for odd rows are those of `alignment_report`."""
    bound_arrow(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = Both.of(files)
        for b in batches:
            for i, j in pieces(utf8(b.column(1))[1]):
                x = align(b.column(1).slice(i, j - i).to_pylist(), both)
                sizes = [np.diff(o) for o in (x.off_a, x.off_b, x.off_links)]
                base = [np.repeat(o[:-1], s) for o, s in ((x.off_groups, sizes[0]), (x.off_groups, sizes[1]), (x.off_a, sizes[2]), (x.off_b, sizes[2]))]
                lists = [_lists(x.a, x.off_a), _lists(x.b, x.off_b), _lists(x.group_a - base[0], x.off_a), _lists(x.group_b - base[1], x.off_b), _lists(x.link_a - base[2], x.off_links), _lists(x.link_b - base[3], x.off_links)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), *lists], names=[c.split()[0] for c in ALIGNED.split(", ")])

    return docs.select(docs[key].cast("long").alias("doc_id"), docs[text]).mapInArrow(run, ALIGNED)


def _pack(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpack(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def alignment_report(docs: DataFrame, files: Tokenizers = Tokenizers(), text: str = "text", key: str = "doc_id", chunk: int = CHUNK) -> DataFrame:
    """A row for each row of `docs` (see REPORT): token, group and link counts, links whose id pair is the commonest of its
    B id over the whole corpus (ties included), the sum of the links' corpus-wide pair counts, and a digest of the groups.

    Texts are encoded once. A task counts the distinct id pairs of `chunk` bytes of text and keeps each document's pairs as
    numbers into them, compressed; pair counts are summed over chunks, joined back to each chunk's distinct pairs, and
    meet the documents of that chunk again. So what a pair or a chunk has in one task is bounded by the chunks and by the
    chunk's own text. Broadcast is one row for each B id, which the vocabulary bounds.

    Null and empty texts, and texts whose tokens do not spell space + text, have zeros and ''. Special tokens' strings
    are plain text. Repeated rows count as often as they occur; null ids stay null; other columns are ignored, whatever
    their names; an empty table gives no rows. A long text is one document in one task.
    """
    spark = docs.sparkSession
    bound_arrow(spark)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, part = Both.of(files), TaskContext.get().partitionId() << 33
        width = len(both.b.size)
        held: list[tuple[list, np.ndarray, np.ndarray, np.ndarray]] = []
        made, size = 0, 0

        def flush():
            keys, at = np.unique(np.concatenate([h[1] for h in held]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([h[2] for h in held]), len(keys)).astype(np.int64)
            begin = 0
            for k, (columns, own, times, off) in enumerate(held):
                number = at[begin : begin + len(own)]
                begin += len(own)
                steps = np.diff(number, prepend=0)
                first = off[:-1][np.diff(off) > 0]
                steps[first] = number[first]
                batch = pa.RecordBatch.from_arrays([*columns, _lists(steps, off), _lists(times, off)], schema=PIECE)
                head = k == 0
                yield pa.RecordBatch.from_arrays([pa.array([part + made]), pa.array([_pack(batch)]), pa.array([keys if head else None], pa.list_(pa.int64())), pa.array([counts if head else None], pa.list_(pa.int64()))], ["chunk", "docs", "keys", "counts"])

        for b in batches:
            off = utf8(b.column(1))[1]
            for i, j in pieces(off):
                x = align(b.column(1).slice(i, j - i).to_pylist(), both)
                n_links = np.diff(x.off_links)
                doc = np.repeat(np.arange(j - i), n_links)
                pair, times = np.unique(doc * (len(both.a.size) * width) + x.a[x.link_a] * width + x.b[x.link_b], return_counts=True)
                of_doc = pair // (len(both.a.size) * width)
                numbers = [np.diff(o) for o in (x.off_a, x.off_b, x.off_groups)]
                columns = [b.column(0).slice(i, j - i), *(pa.array(v) for v in (*numbers, n_links)), pa.array(written(x))]
                held.append((columns, pair % (len(both.a.size) * width), times, np.searchsorted(of_doc, np.arange(j - i + 1))))
                size += int(off[j] - off[i])
                if size >= chunk:
                    yield from flush()
                    held, size, made = [], 0, made + 1
        if held:
            yield from flush()

    coded = cut(docs.select(docs[key].cast("long").alias("doc_id"), docs[text]).mapInArrow(encode, "chunk long, docs binary, keys array<long>, counts array<long>"))
    spread = coded.where("keys is not null").select("chunk", F.posexplode(F.arrays_zip("keys", "counts")).alias("pos", "pair"))
    pairs = spread.select("chunk", "pos", F.col("pair.keys").alias("k"), F.col("pair.counts").alias("n"))
    width = F.lit(_width_b(files))
    totals = pairs.groupBy("k").agg(F.sum("n").alias("total"))
    most = totals.groupBy((F.col("k") % width).alias("b")).agg(F.max("total").alias("most"))
    scored = totals.join(F.broadcast(most), F.col("k") % width == F.col("b")).select("k", "total", (F.col("total") == F.col("most")).alias("best"))
    answers = pairs.select("chunk", "pos", "k").join(scored, "k")
    nothing = F.lit(None)
    told = answers.select("chunk", F.lit(0).alias("kind"), "pos", "total", "best", nothing.cast("binary").alias("docs"))
    kept = coded.select("chunk", F.lit(1).alias("kind"), nothing.cast("int").alias("pos"), nothing.cast("long").alias("total"), nothing.cast("boolean").alias("best"), "docs")
    met = told.unionByName(kept).repartition("chunk").sortWithinPartitions("chunk", "kind", "pos")

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, totals, best, done = None, [], [], None
        for table, starts in runs(batches, ["chunk", "kind"]):
            for i, j in zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows], strict=True):
                part = table.slice(i, j - i)
                if part["kind"][0].as_py() == 0:
                    now = part["chunk"][0].as_py()
                    totals, best = (np.concatenate([c.to_numpy(zero_copy_only=False) for c in part[name].chunks]) for name in ("total", "best"))
                    continue
                if part["chunk"][0].as_py() != now:
                    now, totals, best = part["chunk"][0].as_py(), np.zeros(0, np.int64), np.zeros(0, bool)
                for data in part["docs"]:
                    done = _unpack(data.as_py()).combine_chunks()
                    off = _offsets(done["steps"])
                    steps, times = (_flat(done[c]) for c in ("steps", "times"))
                    number = np.cumsum(steps)
                    first = off[:-1][np.diff(off) > 0]
                    number -= np.repeat(number[first] - steps[first], np.diff(np.append(first, len(steps))))
                    sums = [_sums(v, off) for v in (times * best[number], times * totals[number])]
                    yield pa.RecordBatch.from_arrays([*(_one(done[c]) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")), *map(pa.array, sums), _one(done["groups_sha256"])], names=[c.split()[0] for c in REPORT.split(", ")])

    return met.mapInArrow(sum_up, REPORT)


def _one(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks)


def _offsets(column: pa.ChunkedArray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(_one(column).value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)


def _flat(column: pa.ChunkedArray) -> np.ndarray:
    return _one(column).flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    run = np.concatenate([[0], np.cumsum(values)])
    return run[off[1:]] - run[off[:-1]]


def _width_b(files: Tokenizers) -> int:
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=files.model_b or public_tokenizers.path("piece_bpe_32k.model")).get_piece_size()


def op11_byte_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both tokenizers aligned over all of `documents`."""
    return alignment_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
