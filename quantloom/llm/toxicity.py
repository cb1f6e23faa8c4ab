"""Toxicity by a linear classifier over character n-grams scaled with naive Bayes log-count ratios.

A feature is the presence of a hashed character n-gram times its log-count ratio between toxic and clean training
texts; a logistic regression over these gives the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, discard, durable, framed

#: Hash buckets of n-grams: 2 to this power.
WIDTH = 20
#: Characters in an n-gram.
SIZES = (4, 6, 8)
#: Labelled rows that the classifier is fitted on at most: those with the least hash of their id.
MAX_ROWS = 20_000
#: Buckets that the regression weighs at most, the strongest; the log-likelihood ratio from which a bucket is more than chance; and how
#: many of the strongest serve where fewer are beyond it.
FEATURES, CHANCE, LEAST = 4_096, 15.0, 64


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts, where each text ends): A-Z lower-cased, what isn't a letter left out but for one blank before, between and after words.

    A letter is a to z or any character from U+0080 on.
    """
    raw = np.frombuffer("".join(f" {t} " for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(np.fromiter((len(t) + 2 for t in texts), np.int64, len(texts)))
    raw = np.where((raw >= 0x41) & (raw <= 0x5A), raw + np.uint32(0x20), raw)
    letter = ((raw >= 0x61) & (raw <= 0x7A)) | (raw >= 0x80)
    first = np.zeros(len(raw), bool)
    first[np.append(0, ends[:-1])[: len(texts)]] = True
    # of a run of blanks the first one stays; each text begins a run of its own
    stays = letter | np.append(True, letter[:-1])[: len(raw)] | first
    return np.where(letter, raw, np.uint32(0x20))[stays], np.cumsum(stays)[ends - 1]


def gram_codes(texts: list[str], sizes: tuple[int, ...] = SIZES, width: int = WIDTH, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, owners): the bucket of every n-gram of every text, and the place of its text.

    ``wanted`` marks the buckets that matter; others are left out early.
    """
    raw, ends = letters(texts)
    codes, owners = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    h = np.zeros(len(raw), np.uint32)
    for k in range(max(sizes)):
        m = len(raw) - k
        if m <= 0:
            break
        h = h[:m]
        h *= np.uint32(0x01000193)
        h += raw[k:]
        h += np.uint32(1)
        if k + 1 in sizes:
            code = ((h ^ np.uint32(k)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - width)
            at = np.arange(m) if wanted is None else np.flatnonzero(wanted[code])
            owner = np.searchsorted(ends, at, side="right")
            inside = at + k < ends[owner]  # an n-gram doesn't run on into the next text
            codes.append(code[at[inside]].astype(np.int32))
            owners.append(owner[inside])
    return np.concatenate(codes), np.concatenate(owners)


@dataclass
class Model:
    """``weights`` of some ``buckets``, already multiplied by the ratios, and a bias."""

    buckets: np.ndarray
    weights: np.ndarray
    bias: float
    sizes: tuple[int, ...] = SIZES
    width: int = WIDTH

    @cached_property
    def dense(self) -> np.ndarray:
        out = np.zeros(1 << self.width, np.float32)
        out[self.buckets] = self.weights
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        total = np.full(len(texts), self.bias)
        codes, owners = gram_codes(texts, self.sizes, self.width, self.dense != 0)
        # presence, not frequency: each bucket counts once a text
        pairs = np.unique(owners << self.width | codes)
        total += np.bincount(pairs >> self.width, self.dense[pairs & ((1 << self.width) - 1)], len(texts))
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def training_sample(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """Durable ``text, label`` of at most ``max_rows`` labelled rows (``doc_id, label``), in 16 partitions.

    The rows with the least hash of their id are taken, so neither order nor layout matters. Ids labelled both ways
    count as labelled 1; labels other than 0 and 1 don't count. The bounded list of ids is the only thing that the join broadcasts.
    """
    chosen = labels.where("label in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    chosen = docs.sparkSession.createDataFrame(chosen.toPandas(), "doc_id long, label int")
    rows = docs.where("text is not null").join(F.broadcast(chosen), "doc_id")
    return durable(rows.select("text", "label").repartition(16), "labelled")


def counts(sample: DataFrame, sizes: tuple[int, ...], width: int) -> tuple[np.ndarray, np.ndarray]:
    """In how many clean and in how many toxic texts each bucket is present."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, last = np.zeros((2, 1 << width), np.int32), np.zeros(1 << width, np.int64)
        for batch in blocks(batches, "text", 2 << 20):
            for label, text in zip(batch.column("label").to_pylist(), batch.column("text").to_pylist(), strict=True):
                codes, _ = gram_codes([text], sizes, width)
                # of the places with one bucket, the last one written counts
                place = np.arange(len(codes))
                last[codes] = place
                total[label][codes[last[codes] == place]] += 1
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array([total[0].tobytes()], pa.binary()), pa.array([total[1].tobytes()], pa.binary())], ["clean", "toxic"])

    clean, toxic = np.zeros(1 << width, np.int64), np.zeros(1 << width, np.int64)
    for row in sample.mapInArrow(count, "clean binary, toxic binary").toLocalIterator(prefetchPartitions=True):  # one row for each of the 16 partitions
        clean += np.frombuffer(row.clean, np.int32)
        toxic += np.frombuffer(row.toxic, np.int32)
    return clean, toxic


def log_count_ratio(clean: np.ndarray, toxic: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    p, q = toxic + smooth, clean + smooth
    return np.log(p / p.sum()) - np.log(q / q.sum())


def evidence(clean: np.ndarray, toxic: np.ndarray, n_clean: int, n_toxic: int) -> np.ndarray:
    """Log-likelihood ratio of each bucket's presence against the same rate in both classes."""
    out, rate = np.zeros(len(clean)), (clean + toxic) / (n_clean + n_toxic)
    for seen, n in ((clean, n_clean), (toxic, n_toxic)):
        for x, r in ((seen, rate), (n - seen, 1 - rate)):
            some = x > 0
            out[some] += 2 * x[some] * np.log(x[some] / (n * r[some]))
    return out


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, features: int = FEATURES, sizes: tuple[int, ...] = SIZES, width: int = WIDTH, rounds: int = 150, decay: float = 1e-3, chance: float = CHANCE, least: int = LEAST) -> Model:
    """Fit on ``docs`` (``doc_id, text``) and ``labels`` (``doc_id, label``).

    Weighed are the ``features`` buckets with the strongest evidence, as far as it is beyond ``chance``; with so few rows that fewer than
    ``least`` are, the ``least`` strongest. Without both classes in the sample every text scores the share of toxic rows. What reaches the driver is bounded by
    ``max_rows`` and ``features``.
    """
    sample = training_sample(docs, labels, max_rows)
    n = {int(r.label): int(r["count"]) for r in sample.groupBy("label").count().toLocalIterator()}
    rate = n.get(1, 0) / max(1, sum(n.values()))
    if not n.get(0) or not n.get(1):
        return Model(np.zeros(0, np.int64), np.zeros(0, np.float32), float(np.log((rate + 1e-3) / (1 - rate + 1e-3))), sizes, width)
    clean, toxic = counts(sample, sizes, width)
    ratio, strength = log_count_ratio(clean, toxic), evidence(clean, toxic, n[0], n[1])
    top = np.sort(np.argsort(-strength, kind="stable")[:features])
    top = top[strength[top] >= min(chance, np.sort(strength)[-min(least, len(strength))])]
    place = np.full(1 << width, -1, np.int32)
    place[top] = np.arange(len(top))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", 2 << 20):
            codes, owners = gram_codes(batch.column("text").to_pylist(), sizes, width, place >= 0)
            pairs = np.unique(owners << width | place[codes])
            cut = np.searchsorted(pairs, np.arange(batch.num_rows + 1, dtype=np.int64) << width)
            used = [(pairs[a:b] & ((1 << width) - 1)).astype(np.int16).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(used, pa.binary())], ["label", "used"])

    rows = sample.mapInArrow(pick, "label int, used binary").toPandas()
    discard(sample)
    used = [np.frombuffer(u, np.int16) for u in rows["used"]]
    y = rows["label"].to_numpy(np.float64)
    column = np.concatenate(used).astype(np.int64) if used else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(used)), list(map(len, used)))
    weight = logistic(row, column, ratio[top], y, rounds, decay)
    return Model(top, (weight[:-1] * ratio[top]).astype(np.float32), float(weight[-1]), sizes, width)


def logistic(row: np.ndarray, column: np.ndarray, ratio: np.ndarray, y: np.ndarray, rounds: int, decay: float) -> np.ndarray:
    """Weights and bias of a logistic regression with both classes weighing the same, by gradient descent with adaptive steps."""
    value = ratio[column]
    w, m, v = np.zeros(len(ratio) + 1), np.zeros(len(ratio) + 1), np.zeros(len(ratio) + 1)
    each = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    for step in range(1, rounds + 1):
        z = np.bincount(row, w[column] * value, len(y)) + w[-1]
        error = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y) * each
        g = np.append(np.bincount(column, error[row] * value, len(ratio)), error.sum()) + decay * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return w


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return ``doc_id, score, row`` for every row of ``docs``; ``score`` is near 1 where label 1 is likelier.

    * null and empty texts score as a text without n-grams: the bias alone
    * very long texts are read whole; n-grams don't run on from one text into the next
    * rows are judged one by one; an empty table gives an empty result; input columns live in ``row`` only
    """

    @F.arrow_udf("double")
    def judged(text: pa.Array) -> pa.Array:
        out = np.zeros(len(text))
        for part in blocks([pa.RecordBatch.from_arrays([pa.array(np.arange(len(text))), text], ["at", "text"])], "text", 2 << 20):
            out[np.asarray(part.column("at"))] = model.scores([t or "" for t in part.column("text").to_pylist()])
        return pa.array(out)

    return framed(docs, id_col, text_col).select("doc_id", judged("text").alias("score"), "row")
