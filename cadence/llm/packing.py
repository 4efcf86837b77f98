"""Cost-balanced packing of token streams into fixed-length training sequences (operator 8)."""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from cadence.session import bound_arrow

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@dataclass(frozen=True)
class Vocabulary:
    """A byte-level BPE vocabulary by the paths of its files. `merges` (the same vocabulary as ranks) only makes encoding
    faster; None falls back to `model` alone. Both None: the public 50k vocabulary of the `public_tokenizers` package."""

    model: str | None = None
    merges: str | None = None
    end_id: int = 1


#: White space so long that the pattern of the rank form would run out of backtracking steps.
LONG_BLANK = re.compile(r"\s{10000}")


class Encoder:
    """Ids as `tokenizers` gives them for the model file. Texts that hold a special token's string or a very long run of
    white space, or that the rank form refuses, go to that library itself; for all others the rank form of the same
    vocabulary gives the same ids several times faster."""

    _made: dict[Vocabulary, Encoder] = {}

    def __init__(self, vocabulary: Vocabulary) -> None:
        from tokenizers import Tokenizer

        model, merges = vocabulary.model, vocabulary.merges
        if model is None:
            import public_tokenizers

            model, merges = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
        self.exact = Tokenizer.from_file(model)
        self.special = [t.content for t in self.exact.get_added_tokens_decoder().values()]
        self.fast = None
        if merges is not None:
            import public_tokenizers
            import tiktoken

            with open(merges, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.end = np.array([vocabulary.end_id], np.uint32)

    @classmethod
    def of(cls, vocabulary: Vocabulary) -> Encoder:
        if vocabulary not in cls._made:
            cls._made[vocabulary] = cls(vocabulary)
        return cls._made[vocabulary]

    def ids(self, text: str) -> np.ndarray:
        if not text:
            return self.end
        found = None
        if self.fast is not None and not any(s in text for s in self.special) and not LONG_BLANK.search(text):
            try:
                found = np.asarray(self.fast.encode_to_numpy(text, disallowed_special=()), np.uint32)
            except ValueError:
                found = None
        if found is None:
            found = np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.concatenate([found, self.end])


def assign(lengths: np.ndarray, size: int, linear: float = 1.0, quadratic: float | None = None) -> list[tuple[int, int, int, int, int]]:
    """(piece, from, length, sequence, offset) for pieces of at most `size` tokens.

    ceil(total / size) sequences are opened. Pieces in descending length (ties: input order) go to the sequence of the
    lowest estimated cost, linear * tokens + quadratic * tokens ** 2 summed over its pieces, among those with room
    (ties: lowest number). What fits nowhere whole is cut, in the same order, over the lowest-cost sequences that
    have any room, so all sequences but the slack of less than one are full.
    """
    quadratic = 1.0 / size if quadratic is None else quadratic
    total = int(lengths.sum())
    k = -(-total // size)
    used, cost = np.zeros(k, np.int64), np.zeros(k)
    out: list[tuple[int, int, int, int, int]] = []
    rest = []

    def put(i: int, begin: int, n: int, s: int) -> None:
        out.append((i, begin, n, s, int(used[s])))
        used[s] += n
        cost[s] += linear * n + quadratic * n * n

    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        fits = np.where(used + n <= size, cost, np.inf)
        s = int(fits.argmin())
        if np.isfinite(fits[s]):
            put(int(i), 0, n, s)
        else:
            rest.append(int(i))
    for i in rest:
        begin = 0
        while begin < lengths[i]:
            s = int(np.where(used < size, cost, np.inf).argmin())
            n = int(min(lengths[i] - begin, size - used[s]))
            put(i, begin, n, s)
            begin += n
    return out


def _packer(vocabulary: Vocabulary, size: int, pool: int, id_col: str, with_ids: bool):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, base, sequence = Encoder.of(vocabulary), TaskContext.get().partitionId() << 40, 0
        rows: list[tuple] = []
        waiting: list[tuple] = []
        held = 0

        def row(doc, start, ids, total, s, offset):
            found = (doc, start, len(ids), zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes()), total, base + s, offset)
            rows.append(found + ((ids.astype(np.int32),) if with_ids else ()))

        def settle() -> None:
            nonlocal sequence, held
            if not waiting:
                return
            lengths = np.array([len(w[2]) for w in waiting])
            for i, begin, n, s, offset in assign(lengths, size):
                doc, start, ids, total = waiting[i]
                row(doc, start + begin, ids[begin : begin + n], total, sequence + s, offset)
            sequence += -(-int(lengths.sum()) // size)
            waiting.clear()
            held = 0

        names = SCHEMA.replace(" long", "").split(", ") + ["ids"] * with_ids

        def flush():
            columns = list(zip(*rows, strict=True))
            made = [pa.array(c, pa.int64()) for c in columns[:7]]
            if with_ids:
                made.append(pa.array(list(columns[7]), pa.list_(pa.int32())))
            rows.clear()
            return pa.RecordBatch.from_arrays(made, names)

        for batch in batches:
            ids_of, texts = batch.column(batch.schema.get_field_index(id_col)), batch.column(batch.schema.get_field_index("text"))
            for k in range(batch.num_rows):
                doc, ids = ids_of[k].as_py(), encoder.ids(texts[k].as_py() or "")
                whole = len(ids) // size * size
                for start in range(0, whole, size):
                    row(doc, start, ids[start : start + size], len(ids), sequence, 0)
                    sequence += 1
                if whole < len(ids):
                    waiting.append((doc, whole, ids[whole:].copy(), len(ids)))
                    held += len(ids) - whole
                    if held >= pool * size:
                        settle()
                if len(rows) >= 8192:
                    yield flush()
        settle()
        if rows:
            yield flush()

    return pack


def pack_documents(docs: DataFrame, size: int = 2048, pool: int = 1024, vocabulary: Vocabulary = Vocabulary(), id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece of a document's token stream, with its place in a training sequence of `size` tokens.

    A stream is the text's ids and then the end id; it is cut into whole sequences and a rest. Rests gather in pools of
    `pool` sequences within a task and are placed by `assign`. Nothing is shuffled: a pool holds about `pool * size`
    ids at a time, and a task's sequences are numbered under its partition, so a task that runs again replaces all of
    its own sequences. Padding is less than one sequence per pool.

    Null text counts as empty (the end id alone); a text is encoded whole, however long; pieces of equal length are placed
    in the order of their rows; repeated rows are packed as often as they come; a null id is kept; other columns, whatever their names, are not read; an empty table gives no rows. `with_ids` adds the ids.
    """
    bound_arrow(docs.sparkSession)
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return own.mapInArrow(_packer(vocabulary, size, pool, "doc_id", with_ids), SCHEMA + ", ids array<int>" * with_ids)


def op8_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
