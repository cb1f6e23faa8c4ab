"""Quality by supervised subword embeddings.

Every word, every pair of neighbouring words and every character n-gram of a word has a learned vector, kept by hash bucket. A text is the mean of its
vectors, a softmax over it gives the classes. All is trained by stochastic gradient descent in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, discard, framed, tidy
from .toxicity import training_sample

#: Hash buckets of words and n-grams: 2 to this power.
WIDTH = 18
#: Characters in an n-gram; a word's ends count as one each.
SIZES = (3, 4, 5)
#: Numbers in a vector.
DIM = 10
#: Labelled rows that the model is fitted on at most: those with the least hash of their id.
MAX_ROWS = 4_000
PRIME = 0x01000193


def buckets(texts: list[str], sizes: tuple[int, ...] = SIZES, width: int = WIDTH) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Where each text begins, and (bucket of each place, whether a feature begins there) for n-grams of each size, for words and for pairs of words.

    White space parts words; an n-gram lies within a word and the blank on either side of it. A pair of neighbours is hashed by the
    difference of their hashes, so all words that follow themselves are one feature.
    """
    raw = np.frombuffer("".join(f" {t} " for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    cut = np.cumsum([0, *(len(t) + 2 for t in texts[:-1])])
    blank = (raw == 0x20) | ((raw >= 9) & (raw <= 13))
    raw = np.where(blank, np.uint32(0x20), raw)
    before = np.append(0, np.cumsum(blank, dtype=np.int32))  # blanks before each place
    shift = np.uint32(32 - width)

    def full(a: np.ndarray) -> np.ndarray:
        return np.append(a, np.zeros(len(raw) - len(a), a.dtype))

    def bucket(h: np.ndarray, kind: int) -> np.ndarray:
        return ((h ^ np.uint32(kind)) * np.uint32(0x9E3779B1)) >> shift

    out, h = [], np.zeros(len(raw), np.uint32)
    for k in range(min(max(sizes), len(raw))):
        m = len(raw) - k
        h = h[:m] * np.uint32(PRIME) + raw[k:] + np.uint32(1)
        if k + 1 in sizes:
            out.append((full(bucket(h, k)), full(before[k : k + m] == before[1 : m + 1])))
    begin = ~blank & np.append(True, blank[:-1])
    follows, word, pair = begin.copy(), np.zeros(len(raw), np.uint32), np.zeros(len(raw), np.uint32)
    begins = np.flatnonzero(begin)
    if len(begins):
        place = np.arange(len(raw)) - begins[np.maximum(np.cumsum(begin) - 1, 0)]
        power = np.multiply.accumulate(np.append(np.uint32(1), np.full(max(1, int(place.max())), PRIME, np.uint32)), dtype=np.uint32)
        term = np.where(blank, np.uint32(0), (raw + np.uint32(1)) * power[np.maximum(place, 0)])
        h = np.add.reduceat(term, begins, dtype=np.uint32)
        word[begins], pair[begins] = bucket(h, 0x5BD1E995), bucket(h - np.append(h[:1], h[:-1]), 0x1B873593)
        first = np.searchsorted(begins, cut)
        follows[begins[first[first < len(begins)]]] = False
    return cut, [*out, (word, begin), (pair, follows)]


@dataclass
class Model:
    """A vector for each bucket (the last is every text's own) and the weights of the two classes."""

    vectors: np.ndarray
    classes: np.ndarray
    sizes: tuple[int, ...] = SIZES
    width: int = WIDTH

    @cached_property
    def lean(self) -> np.ndarray:
        """How much each bucket leans to label 1: the softmax sees the mean of these alone."""
        return (self.vectors @ (self.classes[:, 1] - self.classes[:, 0])).astype(np.float32)

    def scores(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        cut, kinds = buckets(texts, self.sizes, self.width)
        total, n = np.full(len(texts), float(self.lean[-1])), np.ones(len(texts), np.int64)
        for code, at in kinds:
            total += np.add.reduceat(np.where(at, self.lean[code], np.float32(0)), cut, dtype=np.float64)
            n += np.add.reduceat(at, cut, dtype=np.int64)
        return 1 / (1 + np.exp(-np.clip(total / n, -500, 500)))


def sgd(texts: list[str], labels: np.ndarray, epochs: int = 4, rate: float = 0.5, dim: int = DIM, sizes: tuple[int, ...] = SIZES, width: int = WIDTH, seed: int = 1) -> Model:
    """Train on ``texts`` one by one, in an order drawn anew for each epoch; the rate falls to nothing in a line."""
    draw = np.random.default_rng(seed)
    vectors = draw.uniform(-1 / dim, 1 / dim, ((1 << width) + 1, dim)).astype(np.float32)
    classes = np.zeros((dim, 2), np.float32)
    for step in range(epochs * len(texts)):
        if step % len(texts) == 0:
            order = draw.permutation(len(texts))
        i, now = order[step % len(texts)], np.float32(rate * (1 - step / (epochs * len(texts))))
        code, times = np.unique(np.concatenate([np.array([1 << width], np.uint32), *(code[at] for code, at in buckets([texts[i]], sizes, width)[1])]), return_counts=True)
        part = (times / times.sum()).astype(np.float32)
        hidden = part @ vectors[code]
        z = hidden @ classes
        p = np.exp(z - z.max())
        error = p / p.sum()
        error[labels[i]] -= 1
        back = classes @ error
        classes -= now * np.outer(hidden, error)
        # each vector takes the step of the mean itself: divided by their number, texts would hardly move any
        vectors[code] -= now * np.minimum(1, part * len(code))[:, None] * back
    return Model(vectors, classes, sizes, width)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, **options: object) -> Model:
    """Fit on ``docs`` (``doc_id, text``) and ``labels`` (``doc_id, label``), of which at most ``max_rows`` rows are used.

    Rows are trained on in one task, in an order that hangs on their texts alone; what reaches the driver is the model, whose size is
    fixed. With one class only the scores lean to it; without any row all are 0.5.
    """
    sample = training_sample(docs, labels, max_rows)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(t, y) for b in batches for t, y in zip(b.column("text").to_pylist(), b.column("label").to_pylist(), strict=True)]
        model = sgd([t for t, _ in rows], np.array([y for _, y in rows], np.int64), **options)
        yield pa.RecordBatch.from_arrays([pa.array([model.vectors.tobytes()], pa.binary()), pa.array([model.classes.tobytes()], pa.binary())], ["vectors", "classes"])

    ordered = sample.repartition(1).sortWithinPartitions(F.xxhash64("text"), "text", "label")
    row = ordered.mapInArrow(tidy(train), "vectors binary, classes binary").first()
    discard(sample)
    if row is None:  # no rows, no task
        return sgd([], np.zeros(0, np.int64), **options)
    dim = int(options.get("dim", DIM))
    return Model(np.frombuffer(row.vectors, np.float32).reshape(-1, dim), np.frombuffer(row.classes, np.float32).reshape(dim, 2), options.get("sizes", SIZES), options.get("width", WIDTH))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return ``doc_id, score, row`` for every row of ``docs``; ``score`` is near 1 where label 1 is likelier.

    * null and empty texts, and those of white space only, score by the vector that all texts share
    * very long texts are read whole; words and n-grams don't run on from one text into the next
    * rows are judged one by one, so repeated rows score alike; an empty table gives an empty result; input columns live in ``row`` only
    """
    lean = Model(np.zeros((0, 0)), np.zeros((0, 0)), model.sizes, model.width)
    lean.lean = model.lean  # tasks need no vectors

    @F.arrow_udf("double")
    def judged(text: pa.Array) -> pa.Array:
        out = np.zeros(len(text))
        for part in blocks([pa.RecordBatch.from_arrays([pa.array(np.arange(len(text))), text], ["at", "text"])], "text", 1 << 20):
            out[np.asarray(part.column("at"))] = lean.scores([t or "" for t in part.column("text").to_pylist()])
        return pa.array(out)

    return framed(docs, id_col, text_col).select("doc_id", judged("text").alias("score"), "row")
