"""The quality classifier: features and scores against plain recomputation, training on held-out rows, edge cases."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.llm import quality, queries

M = 1 << 32
WHITE = " \t\n\x0b\x0c\r"


def plain_features(text, sizes=quality.SIZES, width=quality.WIDTH):
    """Bucket counts of one text by loops over its words."""

    def bucket(h, kind):
        return ((h ^ kind) * 0x9E3779B1 % M) >> (32 - width)

    out, hashes = Counter([1 << width]), []
    for word in [w for w in re.split(f"[{WHITE}]+", text) if w]:
        padded = f" {word} "
        for n in sizes:
            for i in range(len(padded) - n + 1):
                h = 0
                for c in padded[i : i + n]:
                    h = (h * quality.PRIME + ord(c) + 1) % M
                out[bucket(h, n - 1)] += 1
        h = sum((ord(c) + 1) * pow(quality.PRIME, i, M) for i, c in enumerate(word)) % M
        out[bucket(h, 0x5BD1E995)] += 1
        if hashes:
            out[bucket((h - hashes[-1]) % M, 0x1B873593)] += 1
        hashes.append(h)
    return out


TEXTS = ["", " \n ", "a", "The The  The\tcat", "naïve \U0001f600 word.", "x" * 300, "ab cd\nef", "the end"]


def test_features_and_scores():
    draw = np.random.default_rng(3)
    model = quality.Model(draw.normal(size=((1 << quality.WIDTH) + 1, 4)), draw.normal(size=(4, 2)))
    got = model.scores(TEXTS)
    for text, s in zip(TEXTS, got, strict=True):
        want = plain_features(text)
        _, kinds = quality.buckets([text])
        assert Counter(np.concatenate([[1 << quality.WIDTH], *(code[at] for code, at in kinds)]).tolist()) == want
        mean = sum(k * model.vectors[b] for b, k in want.items()) / sum(want.values())
        z = mean @ model.classes
        assert s == pytest.approx(math.exp(z[1]) / (math.exp(z[0]) + math.exp(z[1])), abs=1e-6)
    assert model.scores([]).shape == (0,)
    assert model.scores(TEXTS[::-1]).tolist() == pytest.approx(got[::-1].tolist())


def test_a_step_lowers_the_loss():
    texts, labels = ["good plain words", "bad!! noise!!"] * 4, np.array([1, 0] * 4)
    before, after = quality.sgd(texts, labels, epochs=0), quality.sgd(texts, labels, epochs=5)
    assert (before.scores(texts) == 0.5).all()
    assert (after.scores(texts)[labels == 1] > 0.5).all() and (after.scores(texts)[labels == 0] < 0.5).all()


def test_query_on_held_out_rows(spark):
    at = "/root/testdata/sf0.1"
    found = queries.op12_quality(spark, at)
    docs = spark.read.parquet(f"{at}/documents.parquet")
    rows = found.join(spark.read.parquet(f"{at}/labels.parquet"), "doc_id", "left").collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    held = [r for r in rows if r.held_out and r.quality is not None]
    assert len(held) > 500
    good, bad = [r for r in held if r.quality], [r for r in held if not r.quality]
    assert sum(r.predicted for r in good) >= 0.995 * len(good)
    assert sum(1 - r.predicted for r in bad) >= 0.95 * len(bad)


def test_edges_and_repeats(spark):
    rows = [(1, None, 1), (2, "", 0), (3, "good plain words here", 1), (4, "bad!! noise!! bad!!", 0), (4, "bad!! noise!! bad!!", 0), (5, "good plain words too", 1), (None, "no id", 1), (7, "plain " * 100_000, None), (8, "odd", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int").withColumns({c: F.lit("clash") for c in ("score", "row", "held_out", "at")})
    labels = docs.select("doc_id", "label")
    model = quality.fit(docs.select("doc_id", "text"), labels)
    again = quality.fit(docs.repartition(5).select("doc_id", "text"), labels.repartition(3))
    assert np.array_equal(model.vectors, again.vectors)  # the layout doesn't matter
    got = {}
    for r in quality.score(docs, model).collect():
        got.setdefault(r.doc_id, []).append(r.score)
    assert sorted(got) == [1, 2, 3, 4, 5, 7, 8] and got[1] == got[2] and got[4][0] == got[4][1]
    assert got[3][0] > 0.5 > got[4][0]
    for none in (docs.limit(0), docs.where("label = 7"), docs.where("label = 1")):
        model = quality.fit(docs.select("doc_id", "text"), none.select("doc_id", "label"))
        assert all(0 <= r.score <= 1 for r in quality.score(docs, model).collect())
        assert quality.score(docs.limit(0), model).count() == 0
