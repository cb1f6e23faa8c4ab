"""Language identification with hyperdimensional profiles.

Every letter has a random +1/-1 vector, drawn from its code point. An n-gram's vector binds its letters' vectors,
each permuted by its place; a text's vector bundles its n-grams, a language's prototype those of its training texts.
Texts and prototypes are compared by cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, framed, release, tidy

DIM = 1024
SEED = 20240611
#: Place of the blank that stands between words, before the first and after the last.
BLANK = 0x20
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    """For each code point, its lower case if it is a letter, else the blank."""
    out = np.full(0x110000, BLANK, np.uint32)
    for c in range(0x110000):
        if (ch := chr(c)).isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


@cache
def letter_vector(code: int, dim: int) -> np.ndarray:
    return np.random.default_rng((SEED, code)).integers(0, 2, dim, dtype=np.int8) * np.int8(2) - np.int8(1)


def ngram_vectors(letters: np.ndarray, dim: int) -> np.ndarray:
    """One row for each n-gram (rows of code points): the product of its letters' vectors, rotated by their places."""
    n = letters.shape[1]
    out = np.ones((len(letters), dim), np.int8)
    for place in range(n):
        codes, at = np.unique(letters[:, place], return_inverse=True)
        rotated = np.stack([np.roll(letter_vector(int(c), dim), n - 1 - place) for c in codes])
        out *= rotated[at]
    return out


def normalise(text: str | None) -> np.ndarray:
    """Code points of the letters, lower-cased, with one blank for each run of others and at both ends; empty without letters."""
    if not text:
        return np.zeros(0, np.uint32)
    c = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    blank = c == BLANK
    c = c[~(blank & np.append(True, blank[:-1]))]
    if not len(c):
        return c
    return np.concatenate([[BLANK], c, [BLANK]] if c[-1] != BLANK else [[BLANK], c]).astype(np.uint32)


def profiles(texts: list[str | None], dim: int, n: int = 3, by: np.ndarray | None = None) -> np.ndarray:
    """The bundled vector of each text, or with ``by`` of each group of texts; zero without letters."""
    parts = [normalise(t) for t in texts]
    rows = np.arange(len(texts)) if by is None else by
    height = len(texts) if by is None else int(by.max(initial=-1)) + 1
    out = np.zeros((height, dim))
    sizes = np.array([max(0, len(p) - n + 1) for p in parts])
    if not sizes.sum():
        return out
    flat = np.concatenate(parts)
    alphabet, small = np.unique(flat, return_inverse=True)
    a = len(alphabet)
    ends = np.cumsum([len(p) for p in parts])
    inside = np.ones(len(flat), bool)
    for back in range(1, n):
        at = ends - back
        inside[at[at >= 0]] = False
    starts = np.flatnonzero(inside[: len(flat)])
    key = np.zeros(len(starts), np.int64)
    for k in range(n):
        key = key * a + small[starts + k]
    owner = np.repeat(rows, sizes)
    if a**n <= 1 << 22:
        seen = np.flatnonzero(np.bincount(key, minlength=1))
        index = np.zeros(a**n, np.int32)
        index[seen] = np.arange(len(seen))
        key = index[key]
    else:
        seen, key = np.unique(key, return_inverse=True)
    letters = np.stack([alphabet[seen // a ** (n - 1 - k) % a] for k in range(n)], axis=1)
    # so many n-grams at a time that the counts and the vectors stay small whatever the script
    for low in range(0, len(seen), 4096):
        high = min(low + 4096, len(seen))
        own = (key >= low) & (key < high) if len(seen) > 4096 else slice(None)
        counts = np.bincount(owner[own] * (high - low) + (key[own] - low), minlength=height * (high - low)).reshape(height, high - low)
        out += counts.astype(np.float32) @ _vectors(letters[low:high], dim)
    return out


_known: dict[tuple[int, ...], int] = {}
_matrix = np.zeros((0, 0), np.int8)
#: N-gram vectors that a worker keeps at hand.
KEPT = 8_192


def _vectors(letters: np.ndarray, dim: int) -> np.ndarray:
    global _matrix
    keys = list(map(tuple, letters.tolist()))
    if _matrix.shape[1] != dim or len(_known) > KEPT:
        _known.clear()
        _matrix = np.zeros((0, dim), np.int8)
    new = [i for i, k in enumerate(keys) if k not in _known]
    if new:
        for j, i in enumerate(new):
            _known[keys[i]] = len(_matrix) + j
        _matrix = np.concatenate([_matrix, ngram_vectors(letters[new], dim)])
    return _matrix[[_known[k] for k in keys]].astype(np.float32)


def train(docs: DataFrame, lang: Column, dim: int = DIM, n: int = 3) -> dict[str, np.ndarray]:
    """The prototype of each language in ``lang`` over ``docs`` (``text``), summed over all training rows.

    Tasks add up whole-number vectors; one vector for each language and task is shuffled, one for each language
    reaches the driver.
    """

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in blocks([batch], "text", 1 << 20):
                names, by = np.unique(np.array(part.column("lang").to_pylist(), dtype=object).astype(str), return_inverse=True)
                for name, v in zip(names, profiles(part.column("text").to_pylist(), dim, n, by), strict=True):
                    total[name] = total.get(name, 0) + v
        for name, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * dim), pa.array(np.arange(dim), pa.int32()), pa.array(v.astype(np.int64), pa.int64())], ["lang", "k", "v"])

    rows = docs.select("text", lang.cast("string").alias("lang")).where("text is not null and lang is not null")
    found = rows.mapInArrow(tidy(bundle), "lang string, k int, v bigint").groupBy("lang", "k").agg(F.sum("v").alias("v"))
    out: dict[str, np.ndarray] = {}
    for name, k, v in found.toPandas().itertuples(index=False, name=None):
        out.setdefault(name, np.zeros(dim))[k] = v
    return {k: v for k, v in sorted(out.items()) if v.any()}


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", n: int = 3, keep_null_ids: bool = False) -> DataFrame:
    """Return ``doc_id, lang_pred, score, row`` for every row of ``docs`` that has an id, with ``keep_null_ids`` for all.

    ``score`` is the cosine with the nearest prototype, not under 0; ties go to the name that sorts first.

    * null texts, and texts without a letter (empty ones too): ``und`` with score 0; so is everything without prototypes
    * very long texts are read whole, in bounded memory beside the text itself
    * rows are judged one by one; an empty table gives an empty result; input columns live in ``row`` only
    """
    names = list(prototypes)
    matrix = np.stack([prototypes[k] / np.linalg.norm(prototypes[k]) for k in names]) if names else np.zeros((0, DIM))
    dim = matrix.shape[1]

    @F.arrow_udf("lang_pred string, score double")
    def nearest(text: pa.Array) -> pa.Array:
        lang, score = np.full(len(text), UNKNOWN, object), np.zeros(len(text))
        batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(text))), text], ["at", "text"])
        for part in blocks([batch], "text", 1 << 20) if names else ():
            at = np.asarray(part.column("at"))
            v = profiles(part.column("text").to_pylist(), dim, n)
            norm = np.sqrt((v * v).sum(axis=1))
            cos = v @ matrix.T / np.maximum(norm, 1e-300)[:, None]
            lang[at] = np.where(norm > 0, np.array(names, object)[cos.argmax(axis=1)], UNKNOWN)
            score[at] = np.where(norm > 0, np.clip(cos.max(axis=1), 0, 1), 0)
        release()
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score)], ["lang_pred", "score"])

    rows = framed(docs, id_col, text_col, keep_null_ids).withColumn("_found", nearest("text"))
    return rows.select("doc_id", "_found.lang_pred", "_found.score", "row")
