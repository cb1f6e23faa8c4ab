"""Token alignment against whole texts encoded at once and plain loops over bytes."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from quantloom.llm import cross_tokens, queries

A, B = queries.tokenizer_path("byte_bpe_50k.json"), queries.tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def own():
    return cross_tokens.Encoders(A, B)


def plain_tokens(own, text):
    """(ids and end of each token) of both sides for the whole text, or nothing."""
    if not text:
        return [], []
    sides = []
    for ids, spelt in ((own.a.encode(" " + text, add_special_tokens=False).ids, own.a_bytes), (own.b.encode(text), own.b_bytes)):
        if b"".join(spelt[i] for i in ids) != (" " + text).encode():
            return [], []
        sides.append(list(zip(ids, np.cumsum([len(spelt[i]) for i in ids]).tolist())))
    return sides


def brute(own, docs):
    counts, links, out = Counter(), [], []
    for doc_id, text in docs:
        a, b = plain_tokens(own, text)
        ends = sorted({e for _, e in a} & {e for _, e in b})
        groups, i, j = [], 0, 0
        for end in ends:
            x, y = [], []
            while i < len(a) and a[i][1] <= end:
                x.append(a[i][0])
                i += 1
            while j < len(b) and b[j][1] <= end:
                y.append(b[j][0])
                j += 1
            groups.append((x, y))
        own_links = [(p, q) for x, y in groups for p in x for q in y]
        counts.update(set(own_links))
        links.append(own_links)
        out.append([doc_id, len(a), len(b), len(groups), len(own_links), ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)])
    most = defaultdict(int)
    for (p, _), n in counts.items():
        most[p] = max(most[p], n)
    return sorted((*row[:5], sum(counts[x] == most[x[0]] for x in ls), sum(counts[x] for x in ls), row[5]) for row, ls in zip(out, links))


def got(df):
    rows = df.collect()
    for r in rows:
        assert r.groups_sha256 == (hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "")
    return sorted((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in rows)


ODD = [
    None, "", " ", "\n", "a", " a", "a ", "it's we'll 'tis don''t x's", "two  blanks   three\n\nlines \n here\t\ttabs \r\n end  ", "▁ low line", "x▁y", "<0x41> <s> </s> <unk> <|endoftext|> a<|endoftext|>b",
    "naïve café Ärger ß ÿ Ā ȿ ɐ", "汉字 混 text 字", "\U0001f600\U0001f600 \U0001f468‍\U0001f469‍\U0001f467 ok", "1st 2nd 3.14 1,000 x2y ²³¼", "(a) [b] {c} «d» “e” …", "=" * 300 + " -" * 100, "a b c\u0085d\x00e\x07f­g",
    "combining é ä ñ", "https://example.com/a?b=c&d=e#f", "CamelCase snake_case kebab-case", "\n\n\n", "   ", "end\n", "end\n\n", "\tx", ".\nNext.Line\nA", "«»‹›¿¡¶§°", "ab" * 3000, "'", "' s 's '\ns",
]


def test_chunks_encode_as_whole_texts_do(own):
    """Cut texts give the ids of uncut ones, on odd texts and on random strings of characters that matter."""
    draw = random.Random(5)
    alphabet = list(" \n'\"-.,:;!?()stremdlvABZéüñß0129²\t▁") + ["  ", "'s", "'ll", "\r\n", " ", "ing", "the", "://", "\U0001f600", "字", "é"]
    texts = [t for t in ODD if t] + ["".join(draw.choices(alphabet, k=draw.randint(1, 40))) for _ in range(4000)]
    chunks, n = own.chunks(texts)
    words = chunks.dictionary.to_pylist()
    codes = own.codes(words)[np.asarray(chunks.indices)]
    assert "".join(words[i] for i in np.asarray(chunks.indices)) == "".join(" " + t for t in texts)
    at = 0
    for text, k in zip(texts, n.tolist(), strict=True):
        found = [[i for c in codes[at : at + k] for i in side.ids[side.starts[c] : side.starts[c] + side.counts[c]].tolist()] for side in own.sides]
        assert found == [own.a.encode(" " + text, add_special_tokens=False).ids, own.b.encode(text)], text
        at += k
    assert at == len(codes) and len(codes) > 2 * len(texts)


def test_query(spark, sf, own):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute(own, docs)
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    assert got(cross_tokens.cross_tokens(frame, A, B)) == want
    found = sorted(map(tuple, queries.op13_cross_tokens(spark, sf).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()))
    assert found == [(*r[:7], hashlib.sha256(r[7].encode()).hexdigest() if r[7] else "") for r in want]


def test_edges_and_many_blocks(spark, own):
    docs = [(i, t) for i, t in enumerate(ODD)] + [(3, "\n"), (4, "a"), (4, "a"), (90, "long words " * 20_000)]
    frame = spark.createDataFrame([*docs, (None, "no id")], "doc_id long, text string").selectExpr("*", "'clash' as block", "'clash' as a", "1 as p", "'clash' as groups")
    want = brute(own, docs)
    assert got(cross_tokens.cross_tokens(frame.repartition(3), A, B)) == want
    assert got(cross_tokens.cross_tokens(frame.repartition(40), A, B)) == want
    assert cross_tokens.cross_tokens(frame.limit(0), A, B).count() == 0
    assert [r[1:7] for r in got(cross_tokens.cross_tokens(frame.where("doc_id in (1, 9, 10)"), A, B))] == [(0,) * 6] * 3


def test_blocks_of_a_task(own):
    """Blocks of one worker share its ids, and a block's columns hang on its texts alone."""
    import duckdb

    con = duckdb.connect(config={"threads": 1})
    first = cross_tokens.aligned_block(con, own, [1, 2], ["some text", "other text"], True)
    cross_tokens.aligned_block(con, own, [3], ["words that came between"], True)
    assert cross_tokens.aligned_block(con, own, [1, 2], ["some text", "other text"], True) == first
    own.clear()
    assert cross_tokens.aligned_block(con, own, [1, 2], ["some text", "other text"], True) == first
    x = np.array([0, 1, 255, 256, 70_000, (1 << 32) - 1])
    assert cross_tokens.unpacked(cross_tokens.packed(x), len(x)).tolist() == x.tolist()
