import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from cadence.llm.packing import Encoder, Vocabulary, assign, op8_pack_sequences, pack_documents

SF = "/root/testdata/sf0.001"
EXACT = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def check(rows, texts, size=2048):
    """texts: list of (doc_id, text), ids unique."""
    want = {i: [*EXACT.encode(t or "", add_special_tokens=False).ids, 1] for i, t in texts}
    by_doc, by_seq = {}, {}
    for r in rows:
        ids = want[r.doc_id][r.start : r.start + r.length]
        assert len(ids) == r.length and r.doc_tokens == len(want[r.doc_id])
        assert zlib.crc32(np.array(ids, "<u4").tobytes()) == r.ids_crc32
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length))
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert by_doc.keys() == want.keys()
    for i, parts in by_doc.items():
        at = 0
        for start, n in sorted(parts):
            assert start == at and n > 0
            at += n
        assert at == len(want[i])
    for parts in by_seq.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= size
    return sum(map(len, want.values())), len(by_seq)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    tokens, sequences = check(op8_pack_sequences(spark, SF).collect(), [tuple(d) for d in docs])
    assert sequences * 2048 - tokens < 2048


def test_edges(spark):
    odd = [(1, None), (2, ""), (3, "<|endoftext|> x <|endoftext|>"), (4, "a" * 30000), (5, " \n\t 漢字 é \u0085"), (6, "word " * 9000)]
    df = spark.createDataFrame([(i, t, "a", "b") for i, t in odd], "doc_id long, text string, start string, length string")
    check(pack_documents(df, pool=2).collect(), odd)
    assert pack_documents(df.limit(0)).count() == 0
    twice = pack_documents(df.where("doc_id = 6").union(df.where("doc_id = 6")), with_ids=True).collect()
    assert sum(r.length for r in twice) == 2 * twice[0].doc_tokens == sum(len(r.ids) for r in twice)


def test_long_runs_of_one_kind():
    encoder = Encoder.of(Vocabulary())
    for c in (" ", "\n", "7", "a", "\u00a0"):
        text = "x" + c * 2_000_000 + "y"
        assert encoder.ids(text)[:-1].tolist() == EXACT.encode(text, add_special_tokens=False).ids


def test_null_ids_and_ties(spark):
    df = spark.createDataFrame([(None, "same text"), (None, "same text"), (5, "same text"), (None, None)], "doc_id long, text string")
    got = pack_documents(df.coalesce(1)).collect()
    assert len(got) == 4 and sum(r.doc_id is None for r in got) == 3 and len({r.offset for r in got}) == 4


def test_assign_balances_cost():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 2048, 500)
    out = assign(lengths, 2048)
    assert sum(n for _, _, n, _, _ in out) == lengths.sum()
    k = -(-int(lengths.sum()) // 2048)
    cost = np.zeros(k)
    for _, _, n, s, _ in out:
        cost[s] += n * n / 2048 + n
    assert cost.max() < 2 * cost.mean()
    assert len(out) <= len(lengths) + k


def test_ids_equal_the_library():
    encoder = Encoder.of(Vocabulary())
    for t in ("It's  two\n\n spaces ", "don't ÉCOLE x", "1234 ½ ٣", "  <|endoftext|>", "\x00\x01", "🙂🙂  "):
        assert encoder.ids(t).tolist() == [*EXACT.encode(t, add_special_tokens=False).ids, 1]
