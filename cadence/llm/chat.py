"""Chat formatting by columnar byte assembly (operator 5).

A turn reads `<turn ROLE>`, a line feed, the text, `</turn>`, a line feed. Inside roles and texts the backslash and the
angle brackets are written `\\\\`, `\\l` and `\\g`, so no control string can occur in them and reading back is exact.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.llm.groups import changes
from cadence.llm.text import utf8
from cadence.session import bound_arrow

# Fixed values of the template.
OPEN, MIDDLE, CLOSE = b"<turn ", b">\n", b"</turn>\n"
ESCAPES = {ord("\\"): ord("\\"), ord("<"): ord("l"), ord(">"): ord("g")}
LEARNT = "assistant"

SPECIAL = np.zeros(256, bool)
SPECIAL[list(ESCAPES)] = True
CODE = np.arange(256, dtype=np.uint8)
CODE[list(ESCAPES)] = list(ESCAPES.values())
FORMATTED = "conv_id long, part int, text string, loss array<struct<start:int,end:int>>, n_turns int"
READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _escaped_sizes(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running number of escapes before each byte, and the escaped length of each string."""
    before = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(SPECIAL[buf], out=before[1:])
    return before, np.diff(off) + np.diff(before[off])


def _scatter(out: np.ndarray, at: np.ndarray, buf: np.ndarray, off: np.ndarray, before: np.ndarray) -> None:
    """Write each string, escaped, to its place `at` in the output."""
    if not len(buf):
        return
    size = np.diff(off)
    place = np.arange(len(buf)) + before[:-1] + np.repeat(at - off[:-1] - before[off[:-1]], size)
    special = SPECIAL[buf]
    out[place[~special]] = buf[~special]
    out[place[special]] = ord("\\")
    out[place[special] + 1] = CODE[buf[special]]


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All turns of a batch in one preallocated buffer: the bytes, n + 1 turn offsets, and where each text starts and ends."""
    (rbuf, roff), (tbuf, toff) = utf8(roles), utf8(texts)
    rbefore, rsize = _escaped_sizes(rbuf, roff)
    tbefore, tsize = _escaped_sizes(tbuf, toff)
    turn = np.zeros(len(rsize) + 1, np.int64)
    np.cumsum(rsize + tsize + (len(OPEN) + len(MIDDLE) + len(CLOSE)), out=turn[1:])
    out = np.empty(int(turn[-1]), np.uint8)
    role_at = turn[:-1] + len(OPEN)
    text_at = role_at + rsize + len(MIDDLE)
    for mark, at in ((OPEN, turn[:-1]), (MIDDLE, role_at + rsize), (CLOSE, text_at + tsize)):
        for k, byte in enumerate(mark):
            out[at + k] = byte
    _scatter(out, role_at, rbuf, roff, rbefore)
    _scatter(out, text_at, tbuf, toff, tbefore)
    return out, turn, text_at, text_at + tsize


def _strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.string(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])


def _parts(sizes: np.ndarray, starts: np.ndarray, first: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and numbers of parts: a conversation of over `longest` bytes is cut before the turn that would exceed them.
    The conversation that comes first begins with part `first`."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    ends = np.append(starts[1:], len(sizes))
    number = np.zeros(len(starts), np.int64)
    number[:1] = first
    if not (total[ends] - total[starts] > longest).any():
        return starts, number
    at, parts = [], []
    for i, j, k in zip(starts.tolist(), ends.tolist(), number.tolist(), strict=True):
        while True:
            at.append(i)
            parts.append(k)
            stop = max(i + 1, int(np.searchsorted(total, total[i] + longest, side="right")) - 1)
            if stop >= j:
                break
            i, k = stop, k + 1
    return np.array(at), np.array(parts)


def _whole(batches: Iterator[pa.RecordBatch], longest: int) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Tables of whole conversations (parts of `longest` bytes of longer ones) with starts and numbers of their parts,
    wherever batches end: the part that is still open is carried on to the next batch."""
    held: list[pa.RecordBatch] = []
    weight = part = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        weight += int(_bytes(b).sum())
        if weight <= longest and len(changes([pa.concat_arrays([held[0].column(k).slice(0, 1), b.column(k).slice(b.num_rows - 1)]) for k in (0, 1)])) == 1:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        size = _bytes(table)
        starts, parts = _parts(size, changes([table.column(0), table.column(1)]), part, longest)
        last = int(starts[-1])
        if last:
            yield table.slice(0, last), starts[:-1], parts[:-1]
        held, part, weight = table.slice(last).to_batches(), int(parts[-1]), int(size[last:].sum())
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, *_parts(_bytes(table), changes([table.column(0), table.column(1)]), part, longest)


def _bytes(rows: pa.RecordBatch | pa.Table) -> np.ndarray:
    """Bytes of each row's role and text."""
    return np.diff(utf8(rows.column(2))[1]) + np.diff(utf8(rows.column(3))[1])


def _formatter(longest: int):
    def formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, first, parts in _whole(batches, longest):
            conv, empty, role, text = (table.column(k) for k in range(4))
            data, turn, begin, end = assemble(role, text)
            ends = np.append(first[1:], table.num_rows)
            points = np.zeros(len(data) + 1, np.int64)
            np.cumsum((data & 0xC0) != 0x80, out=points[1:])
            learnt = pc.equal(role, LEARNT).to_numpy(zero_copy_only=False).astype(bool)
            base = points[turn[first]]
            owner = np.repeat(np.arange(len(first)), ends - first)
            spans = pa.StructArray.from_arrays([pa.array((points[x] - base[owner])[learnt], pa.int32()) for x in (begin, end)], ["start", "end"])
            held = np.concatenate([[0], np.cumsum(learnt)])
            loss = pa.ListArray.from_arrays(pa.array(np.append(held[first], held[-1]), pa.int32()), spans)
            ids, nulls = conv.to_numpy()[first], empty.to_numpy()[first]
            texts = _strings(data, turn[np.append(first, table.num_rows)])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64(), mask=nulls), pa.array(parts, pa.int32()), texts, loss, pa.array(ends - first, pa.int32())], ["conv_id", "part", "text", "loss", "n_turns"])

    return formatted


def format_conversations(turns: DataFrame, longest: int = 64 << 20) -> DataFrame:
    """(conv_id, part, text, loss, n_turns): each conversation as one training text with its loss mask, the code point
    spans of assistant texts.

    Turns are brought together by conversation and sorted in the shuffle, then assembled in one buffer a time: a task
    holds an Arrow batch and the conversation that is open at its end. A conversation is one row, wherever batches end.
    Only one of over `longest` bytes of roles and texts comes in several parts, cut between turns by those sizes alone,
    so that memory is bounded however long it is; a longer turn is a part of its own.
    Rows are ordered by turn (null first), then role, then text; repeated rows stay. Null role or text counts as empty;
    rows without conv_id form a conversation of their own; other columns are not read; an empty table gives no rows.
    """
    bound_arrow(turns.sparkSession)
    own = turns.select(turns["conv_id"].cast("long").alias("id"), turns["turn"].alias("turn"), F.coalesce(turns["role"], F.lit("")).alias("role"), F.coalesce(turns["text"], F.lit("")).alias("text"))
    own = own.select(F.coalesce("id", F.lit(0)).alias("id"), F.isnull("id").alias("empty"), "turn", "role", "text")
    dealt = own.repartition("id", "empty").sortWithinPartitions("id", "empty", "turn", "role", "text")
    return dealt.select("id", "empty", "role", "text").mapInArrow(_formatter(longest), FORMATTED)


_TURN = re.compile(rb"<turn ([^<>]*)>\n([^<>]*)</turn>\n")
_ESCAPED = re.compile(rb"\\(.)", re.DOTALL)
_PLAIN = {bytes([v]): bytes([k]) for k, v in ESCAPES.items()}


def unescape(data: bytes) -> bytes:
    return _ESCAPED.sub(lambda m: _PLAIN[m[1]], data) if b"\\" in data else data


def read_back(text: str) -> list[tuple[bytes, bytes]]:
    """Roles and texts of a formatted text; raises if anything lies between turns."""
    data, at, found = text.encode(), 0, []
    for m in _TURN.finditer(data):
        if m.start() != at:
            break
        found.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(data):
        raise ValueError("not a formatted conversation")
    return found


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in READ.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    rows: list[tuple] = []
    now: list | None = None

    def close() -> None:
        if now is not None:
            rows.append((now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]))

    for b in batches:
        for conv, part, text, loss, _ in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if part == 0:
                close()
                now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, said in read_back(text):
                now[1] += 1
                now[2].update(role + b"\n" + said + b"\n")
            for span in loss:
                learnt = unescape(text[span["start"] : span["end"]].encode())
                now[3] += len(learnt.decode())
                now[4].update(learnt)
            now[5] += len(text)
        if len(rows) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
            rows.clear()
    close()
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def digest_formatted(formatted: DataFrame) -> DataFrame:
    """Per conversation, what its formatted text holds when read back. Must follow `format_conversations` directly: the
    parts of a very long conversation are digested as they come."""
    return formatted.mapInArrow(_digests, READ)


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(LEARNT).alias("role"), F.lit(said).alias("text"))
    return digest_formatted(format_conversations(turns.unionByName(probe)))


OP5_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(16 + 2 * length(role || text) - length(replace(replace(replace(role || text, '\', ''), '<', ''), '>', ''))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
