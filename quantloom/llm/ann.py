"""Approximate nearest neighbours by additive quantisation.

A vector's direction is encoded as a sum of full-dimensional codewords, one from each codebook, found by beam search
over residuals; its norm is stored beside the code. A query scores all codes by lookup tables, and the vectors of the
best codes are ranked again by the exact measure on the original vectors, where they lie in the index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, durable, ragged

BOOKS, WORDS, BEAM = 24, 256, 4
#: Vectors that the codebooks are fitted on at most: those with the least hash of their id. All rows are indexed.
SAMPLE = 16_384
#: Vectors in a row of the index at most, queries that meet it at a time, and bytes of the queries of one pass over the index.
BLOCK, QUERIES, PASS_BYTES = 16_384, 512, 16 << 20
#: Codes with norms that differ by less than this power of two count as one.
STEP = 1 / 32


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id, v`` (array of double) of rows whose vector takes part.

    Null and zero vectors, and those with null or non-finite components, do not; nor do null ids.
    """
    v = F.col(f"`{vec_col}`").cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("v")).where(good & F.col("vec_id").isNotNull())


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors as float32, norms) of rows that aren't zero; no finite component is too large or too small."""
    top = np.abs(x).max(axis=1, keepdims=True)
    y = x / top
    size = np.sqrt((y * y).sum(axis=1, keepdims=True))
    with np.errstate(over="ignore"):
        norms = np.minimum((top * size)[:, 0], np.finfo(np.float64).max)
    return (y / size).astype(np.float32), norms


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Codes of each row: the best of ``beam`` partial sums is extended book by book."""
    n, (m, k, _) = len(x), books.shape
    out = np.zeros((n, m), np.uint8)
    for low in range(0, n, 2048):
        part = x[low : low + 2048]
        rest, codes = part[:, None, :], np.zeros((len(part), 1, 0), np.uint8)
        for book in books:
            gain = (book * book).sum(axis=1) - 2 * rest @ book.T  # change of the squared distance
            cost = gain + (rest * rest).sum(axis=2)[:, :, None]
            flat = cost.reshape(len(part), -1)
            width = min(beam, flat.shape[1])
            best = np.argpartition(flat, width - 1, axis=1)[:, :width]
            row, word = best // k, best % k
            rest = np.take_along_axis(rest, row[:, :, None], axis=1) - book[word]
            codes = np.concatenate([np.take_along_axis(codes, row[:, :, None], axis=1), word[:, :, None].astype(np.uint8)], axis=2)
        last = (rest * rest).sum(axis=2).argmin(axis=1)
        out[low : low + 2048] = codes[np.arange(len(part)), last]
    return out


def decode(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    return sum(book[codes[:, i]] for i, book in enumerate(books))


def _means(rows: np.ndarray, word: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Mean of the rows of each word; words without rows stay."""
    n, sums = np.bincount(word, minlength=len(before)), np.zeros_like(before)
    np.add.at(sums, word, rows)
    return np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], before)


def fit(x: np.ndarray, m: int = BOOKS, k: int = WORDS, rounds: int = 2, seed: int = 7) -> np.ndarray:
    """Codebooks: residual k-means to begin with, then beam encoding and least squares, one book at a time given the others."""
    rng = np.random.default_rng(seed)
    books, rest = np.zeros((m, k, x.shape[1]), np.float32), x.copy()
    for i in range(m):
        book = rest[rng.choice(len(rest), k, replace=len(rest) < k)].copy()
        for _ in range(6):
            book = _means(rest, ((book * book).sum(axis=1) - 2 * rest @ book.T).argmin(axis=1), book)
        near = ((book * book).sum(axis=1) - 2 * rest @ book.T).argmin(axis=1)
        books[i], rest = book, rest - book[near]
    for _ in range(rounds):
        codes = encode(x, books)
        rest = x - decode(codes, books)
        for i in range(m):
            own = rest + books[i][codes[:, i]]
            books[i] = _means(own, codes[:, i], books[i])
            rest = own - books[i][codes[:, i]]
    return books


def train(vectors: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Codebooks from the directions of at most ``sample`` usable vectors (``vec_id, v``), fitted in one task; only they reach the driver."""

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [directions(_matrix(b.column("v")))[0] for b in batches if b.num_rows]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([fit(np.concatenate(held)).tobytes()], pa.binary())], ["books"])

    chosen = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").coalesce(1)
    return np.frombuffer(chosen.mapInArrow(fitted, "books binary").first().books, np.float32).reshape(BOOKS, WORDS, -1)


INDEX = "ids binary, vectors binary, counts binary, codes binary, low binary, high binary, queries binary"


def build(vectors: DataFrame, books: np.ndarray, parts: int, copies: int, block: int = BLOCK) -> DataFrame:
    """Durable index of ``vectors`` (``vec_id, v, q``): rows of at most ``block`` vectors, dealt by hash of the id.

    A row holds its distinct codes with the ``low`` and ``high`` norms of their vectors, how many vectors each has
    (``counts``), ids and vectors in that order, and which of them are ``queries``. Of equal vectors in a row, beside queries only
    the ``copies`` smallest ids are ranked, so the others are left out.
    """
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def row(ids: np.ndarray, x: np.ndarray, asks: np.ndarray) -> pa.RecordBatch:
        same = np.unique(np.ascontiguousarray(x + 0.0).view(f"V{8 * x.shape[1]}").ravel(), return_inverse=True)[1]
        order = np.lexsort((ids, same))
        new = np.append(True, np.diff(same[order]) != 0)
        at = np.arange(len(ids))
        stay = np.zeros(len(ids), bool)
        stay[order] = at - np.maximum.accumulate(np.where(new, at, 0)) < copies
        stay |= asks
        ids, x, asks = ids[stay], x[stay], asks[stay]
        unit, norms = directions(x)
        key = np.empty(len(ids), [("code", f"V{BOOKS}"), ("size", "<i4")])
        key["code"] = encode(unit, shared.value).view(f"V{BOOKS}").ravel()
        key["size"] = np.floor(np.log2(norms) / STEP)
        _, first, of = np.unique(key.view(f"V{BOOKS + 4}"), return_index=True, return_inverse=True)
        order = np.argsort(of, kind="stable")
        counts = np.bincount(of)
        starts = np.cumsum(counts) - counts
        low, high = np.minimum.reduceat(norms[order], starts), np.maximum.reduceat(norms[order], starts)
        raw = [a.tobytes() for a in (ids[order], x[order], counts, key["code"][first], low, high, asks[order])]
        return pa.RecordBatch.from_arrays([pa.array([r], pa.binary()) for r in raw], [c.split()[0] for c in INDEX.split(", ")])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.asarray(batch.column("vec_id"))
            once = np.append(ids[0] != last, ids[1:] != ids[:-1])
            last = ids[-1]
            held.append((ids[once], _matrix(batch.column("v"))[once], np.asarray(batch.column("q").cast(pa.int8())).astype(bool)[once]))
            while sum(len(h[0]) for h in held) >= block:
                whole = [np.concatenate(c) for c in zip(*held, strict=True)]
                yield row(*[c[:block] for c in whole])
                held = [tuple(c[block:] for c in whole)]
        if sum(len(h[0]) for h in held):
            yield row(*[np.concatenate(c) for c in zip(*held, strict=True)])

    dealt = vectors.repartition(parts, "vec_id").sortWithinPartitions("vec_id", "v")
    return durable(dealt.mapInArrow(gather, INDEX), "index")


def _asked(dim: int) -> callable:
    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own = np.frombuffer(row["queries"], bool)
                ids, x = np.frombuffer(row["ids"], np.int64)[own], np.frombuffer(row["vectors"], np.float64).reshape(-1, dim)[own]
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([v.tobytes() for v in x], pa.binary())], ["query_id", "q"])

    return asked


def best(scores: np.ndarray, k: int) -> float:
    """The ``k``-th largest score, or less than all if there are fewer."""
    return np.partition(scores, len(scores) - k)[len(scores) - k] if len(scores) > k else -np.inf


def exact(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """The measure of each row of ``x``, summed component by component, so that equal vectors get equal scores."""
    out = np.zeros(len(x))
    with np.errstate(over="ignore", invalid="ignore"):
        for j in range(len(q)):
            out += x[:, j] * q[j] if metric == "ip" else -((x[:, j] - q[j]) ** 2)
    return out


def bounds(s: np.ndarray, low: np.ndarray, high: np.ndarray, size: float, metric: str) -> np.ndarray:
    """The largest score that a vector of each code may have by its cosine ``s`` with the query and the range of its norm.

    For ``l2``, what depends on the query alone is left out.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        if metric == "ip":
            return s * np.where(s > 0, high, low)
        norm = np.clip(size * s, low, high)
        out = 2 * size * s * norm - norm * norm
    return np.where(np.isnan(out), np.inf, out)


def _look_up(shared, books, k: int, keep: int, metric: str) -> callable:
    """The ``k`` nearest of each query of a pass among all vectors that a task reads."""

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, qx = shared.value
        unit, sizes = directions(qx)
        dim, n = qx.shape[1], len(qid)
        found_score, found_id = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)
        filled, reach = np.zeros(n, np.int64), np.full(n, -np.inf)
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r].as_py() for c in batch.schema.names}
                ids, counts = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["counts"], np.int64)
                x = np.frombuffer(row["vectors"], np.float64).reshape(-1, dim)
                low, high = np.frombuffer(row["low"], np.float64), np.frombuffer(row["high"], np.float64)
                codes = np.frombuffer(row["codes"], np.uint8).reshape(len(counts), -1)
                starts, columns = np.cumsum(counts) - counts, [np.ascontiguousarray(codes[:, i]) for i in range(codes.shape[1])]
                for first in range(0, n, QUERIES):
                    tables = np.einsum("qd,mkd->qmk", unit[first : first + QUERIES], books.value, optimize=True)
                    # what rounding may move two sums apart: codes that it can't tell apart all stay
                    slack = 4 * len(columns) * np.finfo(np.float32).eps * np.abs(tables).max(axis=2).sum(axis=1)
                    for i, table in enumerate(tables, first):
                        s = table[0][columns[0]]
                        for m in range(1, len(columns)):
                            s += table[m][columns[m]]
                        s = s.astype(np.float64)
                        # a code that fewer than keep others surpass in some row of the index is looked at
                        reach[i] = max(reach[i], best(bounds(s - slack[i - first], low, high, sizes[i], metric), keep + 1))
                        top = np.flatnonzero(bounds(s + slack[i - first], low, high, sizes[i], metric) >= reach[i])
                        near = ragged(starts[top], counts[top])
                        near = near[ids[near] != qid[i]]
                        score = exact(x[near], qx[i], metric)
                        score, own = np.append(found_score[i, : filled[i]], score), np.append(found_id[i, : filled[i]], ids[near])
                        if len(score) > k:
                            some = np.flatnonzero(score >= best(score, k)) if not np.isnan(score).any() else np.arange(len(score))
                            score, own = score[some], own[some]
                        order = np.lexsort((own, -score))[:k]
                        filled[i] = len(order)
                        found_score[i, : len(order)], found_id[i, : len(order)] = score[order], own[order]
        inside = np.arange(k)[None, :] < filled[:, None]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qid, filled)), pa.array(found_id[inside]), pa.array(found_score[inside])], ["query_id", "vec_id", "score"])

    return look_up


def search(vectors: DataFrame, is_query: Column, k: int = 20, keep: int = 300, metric: str = "ip", id_col: str = "vec_id", vec_col: str = "embedding", block: int = BLOCK, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """Return ``query_id, rank, vec_id, score``: each query's ``k`` nearest other rows, nearest first, ties to the smaller id.

    ``metric`` is ``ip`` (largest inner product) or ``l2`` (score: minus the squared distance). Queries are the usable rows for
    which ``is_query`` (on ``vec_id``) holds; candidates are all usable rows but the query's own id.

    * unusable vectors take no part, nor do vectors of another length than the most frequent one (of equally frequent ones the
      shortest); queries with fewer than ``k`` candidates get them all
    * components may be as large or small as a double can be: directions are quantised, norms stored as they are. A score that overflows both
      ways is NaN; such rows come after all others, ties to the smaller id
    * equal vectors compete by id alone, so each row of the index ranks ``k + 1`` of them at most; all others of a code are
      ranked exactly where they lie, so a family of vectors that the codes can't tell apart sends on no more than ``k`` a query and task
    * rows that repeat an id are one vector, the first by value
    * an empty table gives an empty result; other columns are not read

    Queries meet the index in passes of ``pass_bytes`` of vectors, which are broadcast. A task reads whole rows of the index, keeps
    the ``k`` nearest of each query of the pass, and sends on these alone.
    """
    spark, schema = vectors.sparkSession, "query_id bigint, vec_id bigint, score double"
    rows = usable(vectors, id_col, vec_col)
    lengths = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if lengths is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    dim, total = lengths.dim, lengths["count"]
    rows = rows.where(F.size("v") == dim)
    books = train(rows)
    parts = max(-(-total // block), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // 1024)))
    index = build(rows.withColumn("q", F.coalesce(is_query, F.lit(False))), books, parts, k + 1, block)
    asked = durable(index.select("ids", "vectors", "queries").mapInArrow(_asked(dim), "query_id bigint, q binary"), "asked")
    passes = max(1, -(-asked.count() * 8 * dim // pass_bytes))
    shared_books, found = spark.sparkContext.broadcast(books), []
    for part in range(passes):
        own = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == part).toArrow()
        if own.num_rows:
            held = (np.asarray(own.column("query_id").combine_chunks()), np.frombuffer(b"".join(own.column("q").to_pylist()), np.float64).reshape(-1, dim))
            shared = spark.sparkContext.broadcast(held)
            found.append(durable(index.drop("queries").mapInArrow(_look_up(shared, shared_books, k, keep, metric), schema), "nearest"))
            shared.unpersist()
    discard(index, asked)
    near = found[0] if found else spark.createDataFrame([], schema)
    for more in found[1:]:
        near = near.unionByName(more)
    nearest = Window.partitionBy("query_id").orderBy(F.isnan("score"), F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
