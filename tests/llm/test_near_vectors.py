"""Nearest neighbours where many vectors differ by less than the codes can tell."""

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quantloom.llm import ann

from test_index_operators import brute_nearest


def test_recall_in_a_family_of_near_copies(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1500, 16))
    family = rng.permutation(1500)[:500]
    x[family] = x[family[0]] + 1e-8 * rng.normal(size=(500, 16))
    x[rng.permutation(1500)[:30]] = x[family[1]]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    want, got = brute_nearest(rows), defaultdict(list)
    for r in sorted(ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect()):
        got[r.query_id].append(r.vec_id)
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    recall = np.mean([len(set(got[q]) & set(want[q])) / 20 for q in want])
    assert recall >= 0.95, recall


def test_many_index_rows_passes_and_odd_vectors(spark):
    """Recall with small index rows and passes; vectors of other lengths take no part, and a huge one spoils nothing."""
    sf = "/root/testdata/sf0.1"
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    dim = len(rows[0][1])
    huge = [1e300] + [0.0] * (dim - 1)
    rows += [(1_000_001, huge), (1_000_003, [1e-300] * dim)]
    odd = [(1_000_000, [1.0]), (1_000_020, [1.0] * (dim + 1)), (1_000_007, [])]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    want, got = brute_nearest(rows), defaultdict(list)
    for r in sorted(ann.search(frame, F.col("vec_id") % 20 == 0, block=256, pass_bytes=8 * dim * 60).collect()):
        got[r.query_id].append(r.vec_id)
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    recall = np.mean([len(set(got[q]) & set(want[q])) / 20 for q in want])
    assert recall >= 0.95, recall
    positive = [q for q, v in rows if q in want and v[0] > 0]
    assert positive and all(got[q][0] == 1_000_001 for q in positive)


def clustered(n, dim, seed):
    """Vectors around 600 centres, of norms between a half and two."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(600, dim))
    x = centres[rng.integers(0, 600, n)] + 0.7 * rng.normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True) * rng.uniform(0.5, 2, (n, 1))


def recall_of(found, x, asked, k=20):
    got = defaultdict(set)
    for r in found.collect():
        got[r.query_id].add(r.vec_id)
    hits = []
    for q in asked:
        s = x @ x[q]
        s[q] = -np.inf
        hits.append(len(got[q] & set(np.argpartition(-s, k)[:k].tolist())) / k)
    return np.mean(hits)


def test_recall_in_full_index_rows(spark, monkeypatch):
    """On 65,536 vectors a row of the index is full, and 300 of its 16,384 codes are less than 2 %; with codes that don't fit the vectors little is found."""
    assert 300 / ann.BLOCK < 0.02
    x = clustered(65_536, 32, 8)
    frame = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.array(list(x), pa.list_(pa.float64()))})).repartition(8)
    asked = range(0, len(x), 1024)
    monkeypatch.setattr(spark.conf, "get", lambda key, *d, f=spark.conf.get: "4" if key == "spark.sql.shuffle.partitions" else f(key, *d))
    build, rows = ann.build, []

    def counted(*args):
        index = build(*args)
        rows.append(index.count())
        return index

    monkeypatch.setattr(ann, "build", counted)
    good = recall_of(ann.search(frame, F.col("vec_id") % 1024 == 0), x, asked)
    assert rows[0] <= 8 and good >= 0.95, (rows, good)

    def shuffled(vectors, books, *args):
        rng = np.random.default_rng(1)
        return build(vectors, np.stack([b[rng.permutation(len(b))] for b in books]), *args)

    monkeypatch.setattr(ann, "build", shuffled)
    bad = recall_of(ann.search(frame, F.col("vec_id") % 1024 == 0), x, asked)
    assert bad < 0.3, bad


def test_scores_that_overflow_both_ways_come_last(spark):
    rows = [(0, [1e200, -1e200]), (1, [1e200, 1e200]), (2, [1e200, 1e200]), (3, [5e-200, 0.0]), (4, [-1.0, 0.0])]
    got = [(r.rank, r.vec_id, r.score) for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).orderBy("rank").collect()]
    assert [(k, v) for k, v, _ in got] == [(1, 3), (2, 4), (3, 1), (4, 2)] and got[0][2] == 5.0 and np.isnan([got[2][2], got[3][2]]).all()
    many = rows + [(10 + i, [float(i), 0.0]) for i in range(25)]
    got = [r.score for r in ann.search(spark.createDataFrame(many, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()]
    assert len(got) == 20 and not np.isnan(got).any()
