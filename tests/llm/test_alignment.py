import hashlib
from collections import Counter

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from cadence.llm.alignment import align_documents, alignment_report, op11_byte_owners

SF = "/root/testdata/sf0.001"
A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
NAMES = {k: n for n, k in A.get_vocab(with_added_tokens=True).items()}
PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
LETTER = {chr(b): b for b in PLAIN} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in PLAIN)}


def spans(ids, spell):
    out, at = [], 0
    for i in ids:
        n = len(spell(i))
        out.append((at, at + n))
        at += n
    return out


def spell_a(i):
    return bytes(LETTER[c] for c in NAMES[i])


def spell_b(i):
    name = B.id_to_piece(i)
    return bytes([int(name[3:5], 16)]) if B.is_byte(i) else name.replace("▁", " ").encode()


def one(text):
    """(a ids, b ids, groups, links), all loops over byte ranges."""
    if not text:
        return [], [], [], []
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    want = (" " + text).encode()
    if b"".join(map(spell_a, a)) != want or b"".join(map(spell_b, b)) != want:
        return [], [], [], []
    sa, sb = spans(a, spell_a), spans(b, spell_b)
    links, j = [], 0
    for i, (s, e) in enumerate(sa):
        while sb[j][1] <= s:
            j += 1
        k = j
        while k < len(sb) and sb[k][0] < e:
            links.append((i, k))
            k += 1
    ends = sorted({e for _, e in sa} & {e for _, e in sb})
    groups, at = [], 0
    for e in ends:
        groups.append(([x for x, (s, t) in zip(a, sa, strict=True) if at <= s and t <= e], [x for x, (s, t) in zip(b, sb, strict=True) if at <= s and t <= e]))
        at = e
    return a, b, groups, links


def brute(rows):
    found = [(i, *one(t)) for i, t in rows]
    count = Counter((a[i], b[j]) for _, a, b, _, links in found for i, j in links)
    top = Counter()
    for (_, y), n in count.items():
        top[y] = max(top[y], n)
    out = []
    for i, a, b, groups, links in found:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        counts = [count[a[p], b[q]] for p, q in links]
        best = sum(n == top[b[q]] for n, (_, q) in zip(counts, links, strict=True))
        out.append((i, len(a), len(b), len(groups), len(links), best, sum(counts), hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return sorted(out, key=str)


def few(spark, least):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    return docs, [tuple(r) for r in docs.collect() if len(r.text or "") <= least]


def test_whole_table(spark):
    """All rows of the query; the groups of very long texts are only counted by the slow loops of this test."""
    docs, rows = few(spark, 10**9)
    assert sorted((tuple(r) for r in op11_byte_owners(spark, SF).collect()), key=str) == brute(rows)


ODD = [(1, None), (2, ""), (3, " "), (4, "\n\n\t x"), (5, "a▁b"), (6, "<|endoftext|> <s></s><unk> <0x41>"), (7, "漢字 🙂🙂 é é \u0085 \x00\x01"), (8, "don't  stop   it"), (None, "same"), (None, "same"), (9, "same"), (10, "a" * 3000), (11, " " * 50), (12, "ﬁ ½ ٣ 1234567"), (13, "x" + " " * 12000 + "y")]


def test_odd_texts_in_small_chunks(spark):
    df = spark.createDataFrame([(*r, 1, "k", 2) for r in ODD], "doc_id long, text string, chunk int, keys string, n_a int")
    for parts, chunk in ((1, 1), (3, 40), (1, 1 << 20)):
        got = alignment_report(df.repartition(parts), chunk=chunk)
        assert sorted((tuple(r) for r in got.collect()), key=str) == brute(ODD)
    assert alignment_report(df.limit(0)).count() == 0 and align_documents(df.limit(0)).count() == 0


def test_tokens_groups_and_links(spark):
    df = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(ODD)], "doc_id long, text string")
    for r in align_documents(df).collect():
        a, b, groups, links = one(ODD[r.doc_id][1])
        assert (r.a_ids, r.b_ids, list(zip(r.link_a, r.link_b, strict=True))) == (a, b, links)
        assert [([x for x, g in zip(a, r.a_in_group, strict=True) if g == k], [x for x, g in zip(b, r.b_in_group, strict=True) if g == k]) for k in range(len(groups))] == groups
