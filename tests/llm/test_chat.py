import hashlib

import duckdb
import pyarrow as pa

from cadence.llm import chat
from cadence.llm.chat import OP5_SQL, assemble, digest_formatted, format_conversations, op5_chat_format, read_back

SF = "/root/testdata/sf0.01"


def test_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{SF}/conversations.parquet'")
    want = sorted(con.execute(OP5_SQL).fetchall())
    assert sorted(map(tuple, op5_chat_format(spark, SF).collect())) == want
    assert any(w[0] == -7 for w in want)


def test_assembly_equals_concatenation():
    roles, texts = ["user", "a<b>", "", "assistant"], ["plain", "\\l <turn user>\n é🙂 </turn>\n", "", "\\\\<>"]
    data, turn, begin, end = assemble(pa.array(roles), pa.array(texts))
    esc = lambda s: s.replace("\\", "\\\\").replace("<", "\\l").replace(">", "\\g")
    want = ["<turn " + esc(r) + ">\n" + esc(t) + "</turn>\n" for r, t in zip(roles, texts, strict=True)]
    assert data.tobytes().decode() == "".join(want)
    assert [data[a:b].tobytes().decode() for a, b in zip(begin, end, strict=True)] == [esc(t) for t in texts]
    assert read_back("".join(want)) == [(r.encode(), t.encode()) for r, t in zip(roles, texts, strict=True)]


def test_edges(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 1, "assistant", "b"), (None, 0, "user", "x"), (None, None, None, "y"), (0, 0, "assistant", "z" * 100000), (2, 5, "user", "")]
    df = spark.createDataFrame([(*r, 1, 1) for r in rows], "conv_id long, turn long, role string, text string, part int, loss int")
    got = {r.conv_id: r for r in digest_formatted(format_conversations(df)).collect()}
    assert {k: r.n_turns for k, r in got.items()} == {1: 3, None: 2, 0: 1, 2: 1}
    assert got[1].turns_sha256 == hashlib.sha256(b"user\n\nassistant\nb\nassistant\nb\n").hexdigest()
    assert got[1].loss_chars == 2 and got[1].loss_sha256 == hashlib.sha256(b"bb").hexdigest()
    assert got[2].loss_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[None].turns_sha256 == hashlib.sha256(b"\ny\nuser\nx\n").hexdigest()
    assert digest_formatted(format_conversations(df.limit(0))).count() == 0


def turns(n, conv, text="t"):
    return pa.RecordBatch.from_arrays([pa.array([conv] * n), pa.array([False] * n), pa.array(["assistant"] * n), pa.array([text] * n)], ["id", "empty", "role", "text"])


def test_a_conversation_is_one_row_wherever_batches_end():
    whole = pa.Table.from_batches([turns(2, 1), turns(4, 2), turns(1, 3), turns(5, 4)]).combine_chunks()
    want = None
    for size in (1, 2, 3, 5, 12):
        made = pa.Table.from_batches(list(chat._formatter(1 << 20)(iter(whole.to_batches(size)))))
        assert made.column("conv_id").to_pylist() == [1, 2, 3, 4] and made.column("part").to_pylist() == [0] * 4
        want = want or made.to_pydict()
        assert made.to_pydict() == want


def test_only_length_cuts_a_conversation():
    """Parts of at most 45 bytes, of turns of 10 bytes: four turns each, wherever batches end."""
    rows = [turns(3, 1), turns(3, 1), turns(4, 1), turns(1, 2), turns(1, 3, "t" * 99), turns(1, 3)]
    whole = pa.Table.from_batches(rows).combine_chunks()
    for size in (1, 2, 4, 13):
        made = list(chat._formatter(45)(iter(whole.to_batches(size))))
        table = pa.Table.from_batches(made)
        assert list(zip(table.column("conv_id").to_pylist(), table.column("part").to_pylist(), table.column("n_turns").to_pylist(), strict=True)) == [(1, 0, 4), (1, 1, 4), (1, 2, 2), (2, 0, 1), (3, 0, 1), (3, 1, 1)]
        out = pa.Table.from_batches(list(chat._digests(iter(made)))).to_pydict()
        assert out["n_turns"] == [10, 1, 2] and out["loss_chars"] == [10, 1, 100]


def test_conversation_over_a_real_batch_edge(spark):
    """10,000 rows make an Arrow batch; the conversations around its edge stay whole."""
    from pyspark.sql import functions as F

    rows = spark.range(21000).select((F.col("id") / 7).cast("long").alias("conv_id"), (F.col("id") % 7).alias("turn"), F.lit("user").alias("role"), F.lit("x").alias("text"))
    made = format_conversations(rows.coalesce(1)).groupBy("part", "n_turns").count().collect()
    assert [tuple(r) for r in made] == [(0, 7, 3000)]
