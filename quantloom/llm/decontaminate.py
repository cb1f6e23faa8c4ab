"""Benchmark decontamination with a positional inverted index.

The index is a table of segments, each over whole documents: a segment holds, for every term of the test items,
the sorted positions of that term in its documents. A window of test words is found by taking its rarest term's
positions first and intersecting them with the other terms' positions, each shifted by its offset in the window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER_BYTES, blocks, discard, durable, framed, ragged, tidy

#: Bytes of words: digits, letters and all that isn't ASCII; upper case is folded, the rest ends a word.
WORDS = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in LOWER_BYTES)
#: Windows, and bytes of their words, that one pass over the documents looks for, about; more are taken in several passes.
PASS_WINDOWS, PASS_BYTES = 50_000, 8 << 20
#: (window, place) pairs that a search holds at a time, about.
PAIRS = 1 << 21

SEGMENT = "docs binary, n_words binary, starts binary, terms binary, lists binary, positions binary"


def words_of(text: str | bytes | None) -> list[bytes]:
    if text is None:
        return []
    return (text.encode() if isinstance(text, str) else text).translate(WORDS).split()


def window_table(items: DataFrame, n: int, item_col: str, item_text: str) -> DataFrame:
    """Durable ``item, words, run``: each distinct window of ``n`` consecutive words, joined by blanks; a shorter item, if not empty, is one window.

    ``run`` numbers stretches of 512 windows of an item, so that windows with common words stay together.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", 1 << 20):
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                w = words_of(text)
                many = max(1, len(w) - n + 1) if w else 0
                for low in range(0, many, 512):
                    found = [b" ".join(w[i : i + n]) for i in range(low, min(low + 512, many))]
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(found), pa.int64()), pa.array(found, pa.binary()), pa.array([low // 512] * len(found), pa.int32())], ["item", "words", "run"])

    rows = items.select(F.col(f"`{item_col}`").cast("long").alias("item"), F.col(f"`{item_text}`").cast("string").alias("text")).where("item is not null and text is not null")
    return durable(rows.mapInArrow(tidy(cut), "item bigint, words binary, run int").groupBy("item", "words").agg(F.min("run").alias("run")), "windows")


@dataclass
class Windows:
    """The windows of one pass as arrays: codes of their words and, rarest first, the places of the words; -1 beyond a window's end."""

    items: np.ndarray
    terms: np.ndarray
    rarity: np.ndarray

    @classmethod
    def of(cls, items: list[int], words: list[list[bytes]], vocabulary: dict[bytes, int], counts: np.ndarray) -> Windows:
        """``counts`` are the terms' occurrences in all documents; windows with a word that stands nowhere are left out."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        terms = np.full((len(words), int(size.max(initial=1))), -1, np.int32)
        row, place = np.repeat(np.arange(len(words)), size), ragged(np.zeros(len(words), np.int64), size)
        terms[row, place] = np.fromiter((vocabulary[w] for own in words for w in own), np.int32, int(size.sum()))
        seen = np.where(terms >= 0, counts[terms], np.iinfo(np.int64).max)
        rarity = np.argsort(seen, axis=1, kind="stable").astype(np.int32)
        rarity[np.arange(terms.shape[1])[None, :] >= size[:, None]] = -1
        found = (seen > 0).all(axis=1)
        return cls(np.array(items, np.int64)[found], terms[found], rarity[found])


def _index(vocabulary) -> callable:
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = vocabulary.value
        for batch in blocks(batches, "text"):
            docs = np.asarray(batch.column("doc_id"), dtype=np.int64)
            counts, codes = np.zeros(len(docs), np.int64), []
            for i, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                w = words_of(text)
                counts[i] = len(w)
                codes.append(np.fromiter(map(code.get, w, repeat(-1)), np.int32, len(w)))
            codes = np.concatenate(codes) if codes else np.zeros(0, np.int32)
            # a gap after each document: no window runs on into the next one
            starts = np.cumsum(counts + 1) - (counts + 1)
            at = np.flatnonzero(codes >= 0)
            spread = at + np.repeat(np.arange(len(docs)), counts)[at]
            order = np.argsort(codes[at], kind="stable")
            terms, first = np.unique(codes[at][order], return_index=True)
            columns = [docs, counts, starts, terms.astype(np.int32), np.append(first, len(at)).astype(np.int64), spread[order].astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns], [c.split()[0] for c in SEGMENT.split(", ")])

    return build


class Segment:
    """A segment read back. ``keys`` holds all postings, sorted: the term's rank in the segment times ``span``, plus the position."""

    def __init__(self, row: dict) -> None:
        self.docs, self.n_words, self.starts = (np.frombuffer(row[c], np.int64) for c in ("docs", "n_words", "starts"))
        self.terms, self.lists = np.frombuffer(row["terms"], np.int32), np.frombuffer(row["lists"], np.int64)
        self.positions = np.frombuffer(row["positions"], np.int64)
        self.ends = self.starts + self.n_words
        self.span = int(self.ends[-1]) + 1 if len(self.ends) else 1
        self.keys = np.repeat(np.arange(len(self.terms), dtype=np.int64), np.diff(self.lists)) * self.span + self.positions

    def candidates(self, w: Windows, n_terms: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(windows, ranks of their words here, places of the rarest word) in parts, of the windows whose words all stand here.

        A window comes once for each place of its rarest word.
        """
        rank = np.full(n_terms + 1, -1, np.int64)
        rank[self.terms] = np.arange(len(self.terms))
        own = np.flatnonzero(((rank[w.terms] >= 0) | (w.terms < 0)).all(axis=1))
        if not len(own):
            return
        ranks = rank[w.terms[own]]
        rarest = ranks[np.arange(len(own)), w.rarity[own, 0]]
        first, size = self.lists[rarest], np.diff(self.lists)[rarest]
        done = np.cumsum(size)
        low = 0
        while low < len(own):
            high = max(low + 1, int(np.searchsorted(done, (done[low - 1] if low else 0) + PAIRS, side="right")))
            at = np.repeat(np.arange(low, high), size[low:high])
            yield own[at], ranks[at], self.positions[ragged(first[low:high], size[low:high])]
            low = high

    def phrase(self, w: Windows, n_terms: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(windows, starts, ends) where the words stand one after another: lists shifted by their offsets meet, rarest first."""
        for win, ranks, at in self.candidates(w, n_terms):
            at = at - w.rarity[win, 0]
            for j in range(1, w.terms.shape[1]):
                k = w.rarity[win, j]
                want = np.where(k >= 0, ranks[np.arange(len(win)), k] * self.span + at + k, -1)
                hit = np.searchsorted(self.keys, want)
                ok = (k < 0) | ((at >= 0) & (at + k < self.span) & (self.keys[np.minimum(hit, len(self.keys) - 1)] == want))
                win, ranks, at = win[ok], ranks[ok], at[ok]
            yield win, at, at + (w.terms[win] >= 0).sum(axis=1)

    def near(self, w: Windows, n_terms: int, slack: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(windows, starts, ends) of spans around the rarest word in which each word's nearest place in the same document is at most ``slack`` off."""
        far = np.int64(1) << 40
        for win, ranks, at in self.candidates(w, n_terms):
            low, high = at, at
            for j in range(1, w.terms.shape[1]):
                k = w.rarity[win, j]
                doc = np.searchsorted(self.starts, at, side="right") - 1
                base = np.where(k >= 0, ranks[np.arange(len(win)), k], 0) * self.span
                i = np.searchsorted(self.keys, base + at)
                left, right = self.keys[np.maximum(i - 1, 0)] - base, self.keys[np.minimum(i, len(self.keys) - 1)] - base
                # neighbours that lie outside the document, or belong to other terms, are no neighbours
                left = np.where((left >= self.starts[doc]) & (left < at), left, -far)
                right = np.where((right >= at) & (right < self.ends[doc]), right, far)
                best = np.where(k < 0, at, np.where(at - left <= right - at, left, right))
                ok = np.abs(best - at) <= slack
                win, ranks, at, low, high = win[ok], ranks[ok], at[ok], np.minimum(low, best)[ok], np.maximum(high, best)[ok]
            yield win, low, high + 1


def _search(shared, n_terms: int, slack: int | None) -> callable:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        w = shared.value
        for batch in batches:
            for row in batch.to_pylist():
                s = Segment(row)
                found = []
                for win, at, ends in s.phrase(w, n_terms) if slack is None else s.near(w, n_terms, slack):
                    d = np.searchsorted(s.starts, at, side="right") - 1
                    found.append(np.stack([d, w.items[win], at - s.starts[d], ends - s.starts[d]], axis=1))
                hits = np.concatenate(found) if found else np.zeros((0, 4), np.int64)
                hits = hits[np.lexsort((hits[:, 2], hits[:, 0]))]
                cut = np.searchsorted(hits[:, 0], np.arange(len(s.docs) + 1))
                spans, items = [], []
                for a, b in zip(cut[:-1], cut[1:], strict=True):
                    items.append(np.unique(hits[a:b, 1]).tolist() if b > a else [])
                    spans.append(union(hits[a:b, 2], hits[a:b, 3]) if b > a else [])
                for i in range(0, len(s.docs), 1000):
                    yield pd.DataFrame({"doc_id": s.docs[i : i + 1000], "n_words": s.n_words[i : i + 1000], "spans": spans[i : i + 1000], "items": items[i : i + 1000]})

    def arrow(batches):
        kind = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))), ("items", pa.list_(pa.int64()))])
        for frame in search(batches):
            yield pa.RecordBatch.from_pandas(frame, kind, preserve_index=False)

    return arrow


def union(starts: np.ndarray, ends: np.ndarray) -> list[list[int]]:
    """Sorted starts and their ends as disjoint [start, end) spans."""
    high = np.maximum.accumulate(ends)
    new = np.flatnonzero(np.append(True, starts[1:] > high[:-1]))
    return np.stack([starts[new], np.append(high[new[1:] - 1], high[-1])], axis=1).tolist()


def build_index(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """The segments of ``docs`` (``doc_id, text``) for the terms of ``vocabulary``, as a durable table."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    return durable(docs.select("doc_id", "text").mapInArrow(tidy(_index(shared)), SEGMENT), "postings")


def term_counts(index: DataFrame, n_terms: int) -> np.ndarray:
    """Occurrences of each term, over all segments; bounded by the terms of one pass."""

    def count(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(row["terms"], np.int32)), pa.array(np.diff(np.frombuffer(row["lists"], np.int64)))], ["term", "n"])

    rows = index.select("terms", "lists").mapInArrow(tidy(count), "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(n_terms, np.int64)
    out[rows["term"].to_numpy()] = rows["n"].to_numpy()
    return out


def _one_pass(rows: DataFrame, part: DataFrame, slack: int | None) -> DataFrame:
    """``doc_id, n_words, spans, items`` of every row for the windows of ``part``, as a durable table; the postings go again."""
    found = part.select("item", "words").toPandas()
    words = [w.split(b" ") for w in found["words"].map(bytes)]
    vocabulary = {w: i for i, w in enumerate(sorted({x for own in words for x in own}))}
    index = build_index(rows, vocabulary)
    windows = Windows.of(found["item"].tolist(), words, vocabulary, term_counts(index, len(vocabulary)))
    shared = rows.sparkSession.sparkContext.broadcast(windows)
    hits = durable(index.mapInArrow(tidy(_search(shared, len(vocabulary), slack)), "doc_id bigint, n_words bigint, spans array<array<bigint>>, items array<bigint>"), "hits")
    discard(index)
    return hits


def find_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 10, slack: int | None = None, pass_windows: int = PASS_WINDOWS) -> DataFrame:
    """Return ``doc_id, n_words, spans, items`` for every row of ``docs`` that has an id.

    ``spans`` are the disjoint word ranges [start, end) that lie in an occurrence of any item's window of
    ``window`` words, ``items`` the sorted ids of the items with such an occurrence. With ``slack`` the match is by
    proximity: every word of the window has a place at most ``slack`` words off a place of its rarest one in the same
    document, in any order; the span reaches over the nearest of them. The rarest word is that with the fewest occurrences in
    all documents, at a tie the first.

    * null or empty texts, and texts without words: no words, no spans
    * items without words match nothing; null item ids are left out; rows that repeat an item count once
    * rows without an id are left out; all others are judged one by one, in one pass or in several, so rows that repeat a
      ``doc_id`` come out as often
    * empty tables give empty results or empty lists; other columns are not read

    Windows are cut by tasks and kept in a durable table. A pass takes about ``pass_windows`` of them, and no more than about
    ``PASS_BYTES``, through the driver and a broadcast; a larger set takes several passes, whose results are put
    together by row. No document, however long or often copied, is shuffled; a task holds one segment.
    """
    rows = framed(docs, id_col, text_col).select("doc_id", "text")
    windows = window_table(items, window, item_col, item_text)
    size = windows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("words")), F.lit(0)).alias("b")).first()
    passes = max(1, -(-size.n // pass_windows), -(-size.b // PASS_BYTES))
    if passes == 1:
        found = _one_pass(rows, windows, slack)
        discard(windows)
        return found
    own = durable(rows.withColumn("rid", F.monotonically_increasing_id()), "rows")
    numbered = own.select(F.col("rid").alias("doc_id"), "text")
    dealt = F.pmod(F.xxhash64("item", "run"), F.lit(passes))
    parts = [_one_pass(numbered, windows.where(dealt == k), slack) for k in range(passes)]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    found = found.groupBy("doc_id").agg(F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    merged = found.mapInArrow(tidy(_merged), found.schema).withColumnRenamed("doc_id", "rid")
    out = durable(own.select("rid", "doc_id").join(merged, "rid").select("doc_id", "n_words", "spans", "items"), "hits")
    discard(windows, own, *parts)
    return out


def _merged(batches):
    for batch in batches:
        spans = []
        for s in batch.column("spans").to_pylist():
            a = np.array(sorted(s), np.int64).reshape(-1, 2)
            spans.append(union(a[:, 0], a[:, 1]) if len(a) else [])
        yield batch.set_column(batch.schema.get_field_index("spans"), "spans", pa.array(spans, batch.schema.field("spans").type))


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text has no word in an occurrence of an item's window.

    A row is judged by its text alone, so rows with one id but other texts, and rows without an id, go or stay each by itself.
    Null and empty texts stay. The texts' hashes of the rows that go are a table of their own, which the planner
    broadcasts only where its known size is below the session's threshold.
    """
    key = F.xxhash64(F.col(f"`{text_col}`"))
    found = find_items(docs.select(key.alias("doc_id"), F.col(f"`{text_col}`").alias("text")).where("text is not null"), items, **options)
    gone = durable(found.where(F.size("spans") > 0).select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    discard(found)
    return docs.join(gone, key == gone["_gone"], "left_anti")


def digest(ids: list[int]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()


def session_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")
