"""Suffix deduplication, training order and nearest neighbours against brute force and round trips."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.llm import ann, queries, suffix_dedup, training_order

from test_text_operators import EDGE, docs_of, edge


def brute_suffix(docs, n=50):
    first = {}
    raws = [(d, (t or "").encode()) for d, t in docs]
    for d, r in raws:
        for i in range(len(r) - n + 1):
            first[r[i : i + n]] = min(d, first.get(r[i : i + n], d))
    out = {}
    for d, r in raws:
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - n + 1):
            if first[r[i : i + n]] < d:
                gone[i : i + n] = True
        spans = int((np.diff(np.append(False, gone).astype(int)) == 1).sum())
        out[d] = (len(r), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(r, gone) if not g)).hexdigest())
    return out


def test_suffix_dedup(spark, sf):
    got = {r.doc_id: tuple(r)[1:] for r in queries.op4_suffix_dedup(spark, sf).collect()}
    assert got == brute_suffix(docs_of(spark, sf))
    assert any(v[1] for v in got.values())


@pytest.mark.parametrize("length", [8, 20, 33, 50])
def test_suffix_dedup_edges(spark, length):
    rows = [r for r in EDGE if r[0] not in (7, 8)] + [(20, "ab" * 200, "x"), (21, "b" + "ab" * 150 + "é", "x"), (22, "a" * 300, "x"), (23, "x" + "a" * 120, "x"), (24, "a" * 49, None), (25, "naïve café " * 20, "x"), (26, "ve café " * 9, "x")]
    got = suffix_dedup.suffix_dedup(edge(spark, rows), length=length).collect()
    want = brute_suffix([r[:2] for r in rows], length)
    assert {r.doc_id: (r.n_bytes, sum(b - a for a, b in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in got} == want
    assert suffix_dedup.suffix_dedup(edge(spark, [])).count() == 0


@pytest.mark.parametrize("bucket", [3000, 20])
def test_suffix_dedup_of_a_hot_phrase(spark, bucket):
    """A phrase among ever other words is parted by longer grams, or by whole strings; what repeats is still found."""
    rng = np.random.default_rng(2)
    word = lambda: "".join(map(chr, rng.integers(97, 123, 9)))
    phrase, longer = "the very same phrase in all of them ", "and this one is a good deal longer, so that it must go but once "
    rows = [(d, " ".join([word(), word()]) + phrase + word() + (longer if d % 3 == 0 else "") + word(), "x") for d in range(60)]
    got = suffix_dedup.suffix_dedup(edge(spark, rows), bucket=bucket).collect()
    want = brute_suffix([r[:2] for r in rows])
    assert {r.doc_id: (r.n_bytes, sum(b - a for a, b in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in got} == want
    assert sum(v[1] > 0 for v in want.values()) == 19


def test_merge_equals_sorting(monkeypatch):
    rng = np.random.default_rng(3)
    for depth, prune in ((1, 100), (5, 100), (12, 100), (12, 1), (30, 2)):
        monkeypatch.setattr(suffix_dedup, "PRUNE", prune)
        texts = [np.append(rng.integers(97, 100, n), 255).astype(np.uint8) for n in (300, 7, 120)]
        pairs = [suffix_dedup.transform(t, depth) for t in texts]
        row, block = suffix_dedup.merge([b for _, b in pairs], depth)
        rows = [bytes(np.resize(np.roll(t, -i), depth)) for t, (order, _) in zip(texts, pairs) for i in order]
        prefixes = [rows[i] for i in row]
        assert prefixes == sorted(prefixes)
        assert [a == b for a, b in zip(prefixes, prefixes[1:])] == (block[1:] == block[:-1]).tolist()
        if prune > depth:
            assert len(row) == len(rows)
        assert {p for p in rows if rows.count(p) > 1} <= set(prefixes)


def test_smallest_over_many_shards():
    rng = np.random.default_rng(4)
    contents = [bytes(rng.integers(97, 99, int(n)).astype(np.uint8)) for n in rng.integers(12, 40, 200)]
    docs = rng.permutation(200)
    want = {}
    for c, d in zip(contents, docs):
        for i in range(len(c) - 11):
            want[c[i : i + 12]] = min(d, want.get(c[i : i + 12], d))
    for got, c in zip(suffix_dedup.smallest(contents, docs, 12, 300), contents):
        assert got.tolist() == [want[c[i : i + 12]] for i in range(len(c) - 11)]


def test_permutation():
    for n in (1, 2, 3, 17, 1000, 70_001):
        p = training_order.Permutation(n, 5)
        slots = p.slots(np.arange(n))
        assert sorted(slots.tolist()) == list(range(n)) and (p.numbers(slots) == np.arange(n)).all()
    assert (training_order.Permutation(1000, 5).slots(np.arange(1000)) != training_order.Permutation(1000, 6).slots(np.arange(1000))).any()


def test_training_order(spark, tmp_path):
    ranks = queries.tokenizer_path("byte_bpe_50k.tiktoken")
    rows, path = training_order.materialise(edge(spark), ranks, f"file://{tmp_path}/order", key=3, most=64, per_shard=100, waves=3)
    rows = rows.collect()
    reader = training_order.Reader(path)
    assert sorted(r.slot for r in rows) == list(range(len(reader)))
    held = dict(reader.read())
    own = training_order._ranks(ranks)
    by_doc = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        assert (r.shard, r.record) == divmod(r.slot, 100) and len(held[r.slot]) == r.length and r.start == r.piece * 64
        by_doc[r.doc_id] += held[r.slot].tolist()
    assert by_doc == {d: own.encode_ordinary(t or "") + [50256] for d, t, _ in EDGE}
    assert [s for s, _ in reader.read(150, 333)] == list(range(150, 333))
    again, _ = training_order.materialise(edge(spark), ranks, f"file://{tmp_path}/again", key=3, most=64, per_shard=1000, waves=1)
    assert sorted((r.doc_id, r.piece, r.slot) for r in again.collect()) == sorted((r.doc_id, r.piece, r.slot) for r in rows)
    empty, path = training_order.materialise(edge(spark, []), ranks, f"file://{tmp_path}/empty")
    assert empty.count() == 0 and list(training_order.Reader(path).read()) == []


def test_order_does_not_hang_on_the_layout(spark, tmp_path):
    ranks, docs = queries.tokenizer_path("byte_bpe_50k.tiktoken"), edge(spark, EDGE + EDGE[2:5] * 3)
    found = []
    for k, parts in enumerate((2, 50)):
        spark.conf.set("spark.sql.shuffle.partitions", str(3 + 4 * k))
        rows, path = training_order.materialise(docs.repartition(parts), ranks, f"file://{tmp_path}/{k}", key=9, most=64, per_shard=500, waves=1 + k)
        found.append((sorted((r.slot, r.doc_id, r.piece, r.ids_crc32) for r in rows.collect()), [x.tolist() for _, x in training_order.Reader(path).read()]))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found[0] == found[1]


def test_long_white_space():
    own = training_order._ranks(queries.tokenizer_path("byte_bpe_50k.tiktoken"))
    mixed = " \t\n\u3000\x85 "
    for text in ("a" + mixed * 20 + "b" + " " * 90, " " * 50 + "x", mixed * 9, "x\u3000\u3000" * 40, "\x1c" * 60 + " " * 40 + "\n", "a" + " " * 41 + "\x1fb", "  a " + "\n" * 40 + " 's " * 30):
        assert training_order.encoded(own, text, 40) == own.encode_ordinary(text)
    for text in (" " * 5_000_000 + "a", "a" + mixed * 800_000):
        assert own.decode(training_order.encoded(own, text)) == text


def brute_nearest(rows, k=20):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float64)
    out = {}
    for i, v in rows:
        if i % 20 == 0:
            s = x @ np.array(v, np.float64)
            best = sorted((-round(a, 12), int(j)) for a, j in zip(s, ids) if j != i)[:k]
            out[i] = [j for _, j in best]
    return out


def test_ann_recall(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want, got = brute_nearest(rows), defaultdict(list)
    vectors = {i: np.array(v, np.float64) for i, v in rows}
    for r in sorted(queries.op10_ann(spark, sf).collect()):
        got[r.query_id].append(r.vec_id)
        assert r.rank == len(got[r.query_id]) and abs(r.score - vectors[r.query_id] @ vectors[r.vec_id]) < 1e-9
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    recall = np.mean([len(set(got[q]) & set(want[q])) / 20 for q in want])
    assert recall >= 0.95, recall


@pytest.mark.parametrize("metric", ["ip", "l2"])
def test_ann_edges(spark, metric):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [0.0, 0.0]), (7, [None, 1.0]), (20, [0.0, 2.0]), (None, [1.0, 1.0]), (1, [1.0, 0.0]), (9, [0.5, 0.5])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit(1)).withColumn("rank", F.lit(1))
    got = sorted(map(tuple, ann.search(frame, F.col("vec_id") % 20 == 0, metric=metric).collect()))
    good = {i: np.array(v) for i, v in rows if i in (0, 1, 2, 9, 20)}
    want = []
    for q in (0, 20):
        near = sorted((-(good[q] @ v if metric == "ip" else -((good[q] - v) ** 2).sum()), i) for i, v in good.items() if i != q)
        want += [(q, k, i, -s) for k, (s, i) in enumerate(near, 1)]
    assert got == want
    assert ann.search(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0
