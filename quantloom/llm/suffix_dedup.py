"""Removal of long repeated strings by merging Burrows-Wheeler transforms.

Only stretches of text that can hold a repeat are looked at: a string of ``length`` bytes is named by the least hash of
the short grams in it, and a name that stands in one document alone can't repeat in another. Stretches with one
name meet in one bucket. There every shard gets a Burrows-Wheeler transform of its own; the transforms are merged
by refining, one symbol at a time, the order in which their suffixes interleave, until suffixes are told apart by
their first ``length`` bytes. Neighbours with that much in common are a repeated interval, whose smallest document keeps it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, discard, durable, framed, ragged, runs, tidy

#: Bytes of the grams that name a string.
GRAM = 20
#: Ends a stretch within a shard; no UTF-8 text has this byte.
END = 0xFF
#: Passes of the merge after which suffixes that stand alone are left out.
PRUNE = 4
#: Bytes of stretches in a shard, in a bucket, and of text in a block.
SHARD, BUCKET, BLOCK = 1 << 18, 1 << 20, 4 << 20
#: Blocks that a reader takes at once, and bytes that go to a worker at once.
BLOCKS, BATCH = 4, 8 << 20
#: Starts of strings that are judged at once.
AT_ONCE = 1 << 18
#: A name with more bytes of stretches than a bucket is replaced by longer grams' names; with so many times more, by whole strings' hashes.
VERY_HOT = 64


def names(raw: np.ndarray, length: int, gram: int = GRAM, at_once: int = 1 << 15) -> np.ndarray:
    """For each start of ``length`` bytes, the least mixed hash of the grams inside; piece by piece, so that arrays stay in the cache."""
    n = max(0, len(raw) - length + 1)
    out = np.empty(n, np.uint64)
    for low in range(0, n, at_once):
        high = min(n, low + at_once)
        out[low:high] = _names(raw[low : high + length - 1], length, gram)
    return out


def _names(raw: np.ndarray, length: int, gram: int) -> np.ndarray:
    n = len(raw) - length + 1
    gram = min(gram, length)
    base = 0x9E3779B97F4A7C15
    power = lambda k: np.uint64(pow(base, k, 1 << 64))
    doubled, size = {1: raw.astype(np.uint64) + np.uint64(1)}, 1
    while size * 2 <= gram:
        h = doubled[size]
        doubled[size * 2] = h[:-size] * power(size) + h[size:]
        size *= 2
    h, done = doubled[size], size
    while done < gram:
        size //= 2
        if done + size <= gram:
            m = len(raw) - done - size + 1
            h = h[:m] * power(size) + doubled[size][done : done + m]
            done += size
    h = (h ^ h >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    window, size = length - gram + 1, 1
    while size * 2 <= window:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[:n], h[window - size : window - size + n])


def stretches(raw: np.ndarray, doc_ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name, first start, number of starts) of each run of starts with one name inside one document."""
    name = names(raw, length)
    if not len(name):
        return name, np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc_starts = np.append(0, doc_ends[:-1])
    valid = np.ones(len(name), bool)
    # starts from which a string would run over a document's end
    low = np.maximum(doc_starts, doc_ends - length + 1)
    bad = ragged(low, doc_ends - low)
    valid[bad[bad < len(name)]] = False
    new = np.append(True, name[1:] != name[:-1])
    new[doc_starts[doc_starts < len(name)]] = True
    new[1:] |= valid[1:] != valid[:-1]
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(name)))
    ok = valid[at]
    return name[at][ok], at[ok], size[ok]


def finer(raw: np.ndarray, at: np.ndarray, size: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The starts of the stretches (``at``, ``size``), named and parted anew by grams of ``gram`` bytes."""
    start = ragged(at, size)
    name = names(raw, length, gram)[start]
    new = np.append(True, name[1:] != name[:-1])
    new[np.cumsum(size) - size] = True
    first = np.flatnonzero(new)
    return name[first], start[first], np.diff(np.append(first, len(start)))


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of the text, taken as a circle, in the order of the ``depth`` bytes that follow.

    Ties may come in any order: suffixes that agree so far stand for each other in every later step.
    """
    n = len(text)
    wide = np.append(text, np.resize(text, 8)).astype(np.uint64)
    key, known = wide[:n].copy(), 1
    for k in range(1, 8):
        key = key << np.uint64(8) | wide[k : k + n]
    known = 8
    order = np.argsort(key)
    rank = _ranks(key, order)
    while known < depth:
        step = min(known, depth - known)
        key = rank.astype(np.uint64) << np.uint64(32) | np.roll(rank, -step).astype(np.uint64)
        order = np.argsort(key)
        rank, known = _ranks(key, order), known + step
    return order


def _ranks(key: np.ndarray, order: np.ndarray) -> np.ndarray:
    ordered = key[order]
    rank = np.empty(len(key), np.uint32)
    rank[order] = np.cumsum(np.append(False, ordered[1:] != ordered[:-1]))
    return rank


def transform(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix order, Burrows-Wheeler transform) of one shard; a symbol of the transform is the two bytes before a suffix."""
    order = suffix_order(text, depth)
    return order, text[order - 2].astype(np.uint16) << np.uint16(8) | text[order - 1]


def merge(transforms: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(row of the transforms, laid end to end, of each suffix in the merged order; block of equal ``depth``-byte prefixes).

    The interleave starts as shard after shard, right for prefixes of no byte. A pass reads the shards'
    transforms in its order and deals their rows out by symbol, stably, each to the row that its shard's own last-to-first
    mapping names, which makes it right for one symbol, two bytes, more (an odd depth begins with one byte). Two suffixes
    stay in one block if their symbols agree and what followed was in one block: where a pass first parts two neighbours
    is their common prefix. No suffix is sorted again.

    A suffix alone in its block stays alone however far it is extended, so every few passes such rows are left out: what comes
    back are the rows that share their first ``depth`` bytes with another, or nearly so.
    """
    total = sum(map(len, transforms))
    row, block = np.arange(total), np.zeros(total, np.int32)
    take = partial(np.take, mode="clip")
    for width, passes in ((1, depth % 2), (2, depth // 2)):
        if not passes:
            continue
        own = [t if width == 2 else t & np.uint16(255) for t in transforms]
        symbols, first, base = np.concatenate(own), np.empty(total, np.int64), 0
        for t in own:
            first[base + np.argsort(t, kind="stable")] = np.arange(base, base + len(t))
            base += len(t)
        for done in range(1, passes + 1):
            seen = take(symbols, row)
            dealt = np.argsort(seen, kind="stable")
            row, before, ordered = take(first, take(row, dealt)), take(block, dealt), take(seen, dealt)
            parted = np.append((before[1:] != before[:-1]) | (ordered[1:] != ordered[:-1]), True)
            if done % PRUNE == 0 and len(row):
                several = ~(parted & np.append(True, parted[:-1]))
                row, parted = row[several], parted[several]
            block = np.zeros(len(row), np.int32)
            np.cumsum(parted[:-1], out=block[1:])
    return row, block


def smallest(contents: list[bytes], docs: np.ndarray, length: int, shard_bytes: int = SHARD) -> list[np.ndarray]:
    """For each start of ``length`` bytes in each content, the smallest of ``docs`` over all equal strings."""
    total = sum(map(len, contents)) + len(contents)
    most = max(shard_bytes, total // 8 + 1)
    texts, held, size = [], [], 0
    for c in contents:
        held.append(c)
        size += len(c) + 1
        if size >= most:
            texts.append(held)
            held, size = [], 0
    texts += [held] if held else []
    raws = [np.frombuffer(b"".join(c + bytes([END]) for c in part), np.uint8) for part in texts]
    pairs = [transform(raw, length) for raw in raws]
    row, block = merge([bwt for _, bwt in pairs], length)
    base = np.append(0, np.cumsum(list(map(len, raws))))
    suffixes = np.concatenate([order + b for (order, _), b in zip(pairs, base[:-1], strict=True)])
    place = suffixes[row]
    sizes = np.fromiter(map(len, contents), np.int64, len(contents)) + 1
    starts = np.cumsum(sizes) - sizes
    count = np.maximum(sizes - length, 0)
    inside = ragged(starts, count)
    own = np.full(len(suffixes), np.iinfo(np.int64).max)
    own[inside] = np.repeat(docs, count)
    out = own.copy()  # a string that stands once keeps its own document
    if len(place):
        first = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        out[place] = np.minimum.reduceat(own[place], first)[block]
    return np.split(out[inside], np.cumsum(count)[:-1])


def _arrays(*columns: np.ndarray | list) -> list[pa.Array]:
    return [pa.array([c if isinstance(c, bytes) else c.tobytes()], pa.binary()) for c in columns]


def _packed(cut: np.ndarray, *columns: np.ndarray) -> list[pa.Array]:
    """Each column, cut at the places ``cut``, as one value for each stretch."""
    out = []
    for c in columns:
        ends = pa.py_buffer((cut * c.itemsize).astype(np.int64).tobytes())
        out.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cut) - 1, [None, ends, pa.py_buffer(c.tobytes())]).cast(pa.binary()))
    return out


def _to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, done = TaskContext.get().partitionId(), 0
    for batch in blocks(batches, "text", BLOCK):
        texts = batch.column("text").cast(pa.binary()).fill_null(b"")
        lengths = np.asarray(pa.compute.binary_length(texts)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([part << 32 | done], pa.int64()), pa.array([int(lengths.sum())], pa.int64()), *_arrays(np.asarray(batch.column("doc_id"), dtype=np.int64), lengths, b"".join(texts.to_pylist()))], ["block", "n", "docs", "lengths", "raw"])
        done += 1


def _opened(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    docs, lengths = np.frombuffer(row["docs"], np.int64), np.frombuffer(row["lengths"], np.int64)
    return docs, np.cumsum(lengths), np.frombuffer(row["raw"], np.uint8)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """One row at a time: a block's bytes are the only copy."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _of_doc(ends: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.searchsorted(ends, at, side="right")


def _name_rows(length: int, buckets: int) -> callable:
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            docs, ends, raw = _opened(row)
            name, at, size = stretches(raw, ends, length)
            if not len(name):
                continue
            doc = docs[_of_doc(ends, at)]
            order = np.lexsort((doc, name))
            name, doc, size = name[order], doc[order], size[order]
            first = np.flatnonzero(np.append(True, name[1:] != name[:-1]))
            name, low, high = name[first], doc[first], doc[np.append(first[1:], len(doc)) - 1]
            held = np.minimum(np.add.reduceat(size + (length - 1), first), np.iinfo(np.int32).max).astype(np.int32)
            # least hashes crowd near zero, so a bucket comes from a hash of its own
            bucket = (name * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
            order = np.argsort(bucket, kind="stable")
            bucket = bucket[order].astype(np.int32)
            cut = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
            yield pa.RecordBatch.from_arrays([pa.array(bucket[cut[:-1]]), pa.array(np.full(len(cut) - 1, row["block"]), pa.int64()), *_packed(cut, *(x[order] for x in (name, low, high, held)))], ["bucket", "block", "names", "low", "high", "held"])

    return send


def _shared_names(bucket_bytes: int) -> callable:
    """For each block, its names that stand in two documents or more, and (``hot``) how fine they are to be parted: 0, 1 or 2."""

    def shared_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part in runs(batches, "bucket"):
            parts = [np.frombuffer(b, np.uint64) for b in part.column("names").to_pylist()]
            name = np.concatenate(parts)
            low, high, held = (np.frombuffer(b"".join(part.column(c).to_pylist()), t) for c, t in (("low", np.int64), ("high", np.int64), ("held", np.int32)))
            order = np.argsort(name, kind="stable")
            first = np.flatnonzero(np.append(True, name[order][1:] != name[order][:-1]))
            times = np.diff(np.append(first, len(name)))
            shared, hot = np.empty(len(name), bool), np.empty(len(name), np.uint8)
            shared[order] = np.repeat(np.minimum.reduceat(low[order], first) < np.maximum.reduceat(high[order], first), times)
            total = np.add.reduceat(held[order].astype(np.int64), first)
            hot[order] = np.repeat((total > bucket_bytes).astype(np.uint8) + (total > VERY_HOT * bucket_bytes), times)
            ends = np.cumsum(list(map(len, parts)))
            kept = np.append(0, np.cumsum(shared)[ends - 1])
            yield pa.RecordBatch.from_arrays([part.column("block").combine_chunks(), *_packed(kept, name[shared], hot[shared])], ["block", "names", "hot"])

    return shared_names


def _send_stretches(length: int, buckets: int) -> callable:
    """Rows of two kinds: what a bucket gets from a block, and (bucket -1) where the block's stretches stand and lie there."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            docs, ends, raw = _opened(row)
            shared, hot = (np.frombuffer(b"".join(x[c] for x in row["shared"]), t) for c, t in (("names", np.uint64), ("hot", np.uint8)))
            if not len(shared):
                continue
            order = np.argsort(shared)
            shared, hot = shared[order], hot[order]
            name, at, size = stretches(raw, ends, length)
            hit = np.minimum(np.searchsorted(shared, name), len(shared) - 1)
            keep = shared[hit] == name
            level = np.where(keep, hot[hit], 255)
            found = [(name[level == 0], at[level == 0], size[level == 0])]
            for k, gram in ((1, (min(GRAM, length) + length) // 2), (2, length)):
                if (own := level == k).any():
                    found.append(finer(raw, at[own], size[own], length, gram))
            name, at, size = (np.concatenate(x) for x in zip(*found, strict=True))
            doc = docs[_of_doc(ends, at)]
            bucket = (name % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            name, at, size, doc, bucket = (x[order] for x in (name, at, size, doc, bucket))
            offset, text = np.empty(len(at), np.int64), bytes(row["raw"])
            cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])).tolist()
            sent: list[list] = [[], [], [], [], []]
            for low, high in zip(cut, [*cut[1:], len(at)], strict=True):
                a, n = at[low:high], size[low:high]
                stops = (a + n + (length - 1)).tolist()
                seen: dict[bytes, int] = {}
                of = np.array([seen.setdefault(text[x:y], len(seen)) for x, y in zip(a.tolist(), stops, strict=True)])
                first = np.full(len(seen), high - low)
                np.minimum.at(first, of, np.arange(high - low))
                least = np.full(len(seen), np.iinfo(np.int64).max)
                np.minimum.at(least, of, doc[low:high])
                counts = n[first]
                offset[low:high] = (np.cumsum(counts) - counts)[of]
                for column, value in zip(sent, (int(bucket[low]), b"".join(seen), (counts + (length - 1)).tobytes(), least.tobytes(), name[low:high][first].tobytes()), strict=True):
                    column.append(value)
            for column, value in zip(sent, (-1, *(x.tobytes() for x in (at, size, offset, bucket))), strict=True):
                column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(sent[0], pa.int32()), pa.array(np.full(len(sent[0]), row["block"]), pa.int64()), *(pa.array(c, pa.binary()) for c in sent[1:])], ["bucket", "block", "raw", "sizes", "docs", "names"])

    return send


def _judge(length: int) -> callable:
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, part in runs(batches, "bucket"):
            seen: dict[bytes, int] = {}
            sources = []
            for raw, sizes in zip(part.column("raw").to_pylist(), part.column("sizes").to_pylist(), strict=True):
                ends = np.cumsum(np.frombuffer(sizes, np.int64)).tolist()
                sources.append(np.array([seen.setdefault(raw[a:b], len(seen)) for a, b in zip([0, *ends[:-1]], ends, strict=True)]))
            unique, of = list(seen), np.concatenate(sources)
            docs, named = (np.frombuffer(b"".join(part.column(c).to_pylist()), t) for c, t in (("docs", np.int64), ("names", np.uint64)))
            least, name = np.full(len(unique), np.iinfo(np.int64).max), np.empty(len(unique), np.uint64)
            np.minimum.at(least, of, docs)
            name[of] = named
            # stretches that are the only one of their name are equal throughout: one interval, nothing to interleave
            _, back, times = np.unique(name, return_inverse=True, return_counts=True)
            several = np.flatnonzero(times[back] > 1)
            sizes = np.fromiter(map(len, unique), np.int64, len(unique)) - (length - 1)
            starts = np.cumsum(sizes) - sizes
            found = np.repeat(least, sizes)
            if len(several):
                found[ragged(starts[several], sizes[several])] = np.concatenate(smallest([unique[i] for i in several.tolist()], least[several], length))
            answers: list[list[bytes]] = [[], []]
            for own in sources:
                all_ = found[ragged(starts[own], sizes[own])]
                at = np.flatnonzero(np.append(True, all_[1:] != all_[:-1]))
                answers[0].append(np.diff(np.append(at, len(all_))).tobytes())
                answers[1].append(all_[at].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sources), bucket), pa.int32()), part.column("block").combine_chunks(), *(pa.array(a, pa.binary()) for a in answers)], ["bucket", "block", "times", "least"])

    return judge


def _cut(length: int, at_once: int) -> callable:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            docs, ends, raw = _opened(row)
            edge = np.zeros(len(raw) + length + 1, np.int32)
            if row["found"]:
                found = sorted(row["found"], key=lambda x: x["bucket"])
                least = [np.repeat(np.frombuffer(x["least"], np.int64), np.frombuffer(x["times"], np.int64)) for x in found]
                base = np.cumsum([0, *map(len, least)])[:-1]
                at, size, offset, bucket = (np.frombuffer(row["sent"][0][c], np.int64) for c in ("raw", "sizes", "docs", "names"))
                offset = offset + base[np.searchsorted([x["bucket"] for x in found], bucket)]
                least, own, to = np.concatenate(least), docs[_of_doc(ends, at)], np.cumsum(size)
                for low in range(0, int(size.sum()), at_once):  # piece by piece: starts are many, and each lies in one stretch
                    part = slice(*np.searchsorted(to, (low, low + at_once), side="right"))
                    place = ragged(at[part], size[part])
                    place = place[least[ragged(offset[part], size[part])] < np.repeat(own[part], size[part])]
                    edge[place] += 1
                    edge[place + length] -= 1
            gone = np.cumsum(edge, dtype=np.int32)[: len(raw)] > 0
            kept = raw[~gone].tobytes()
            starts = ends - np.diff(np.append(0, ends))
            left = np.append(np.int32(0), np.cumsum(~gone, dtype=np.int32))
            step = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
            begins = np.zeros(len(raw) + 1, bool)
            begins[: len(step)] = step == 1
            begins[starts[starts < len(raw)]] |= gone[starts[starts < len(raw)]]
            first = np.flatnonzero(begins)
            closes = np.zeros(len(raw) + 1, bool)
            closes[: len(step)] = step == -1
            closes[ends[ends > 0]] |= gone[ends[ends > 0] - 1]
            last = np.flatnonzero(closes)
            of = _of_doc(ends, first)
            spans = np.stack([first - starts[of], last - starts[of]], axis=1)
            at = np.searchsorted(of, np.arange(len(docs) + 1))
            values = [spans[a:b].tolist() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            texts = [kept[a:b] for a, b in zip(left[starts].tolist(), left[ends].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(docs), pa.array(ends - starts), pa.array(values, pa.list_(pa.list_(pa.int64()))), pa.array(texts, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    return cut


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, bucket: int = BUCKET) -> DataFrame:
    """Remove each byte covered by a string of ``length`` bytes that also starts in a document with a smaller id.

    Returns ``doc_id, n_bytes, spans, kept`` for every row of ``docs``: texts are UTF-8 bytes, ``spans`` the maximal removed
    byte ranges [start, end), ``kept`` what is left. Strings are judged on the input; overlaps count; matches never run
    over a document's end.

    * null and empty texts, and texts shorter than ``length``: nothing removed
    * rows that share a ``doc_id`` are one document, so they don't remove from each other
    * an empty table gives an empty result; other columns are not read

    Blocks of documents and buckets of names exchange messages. A block names a string once however many of its
    documents hold it, and sends equal stretches once, so that a passage that a third of all documents share costs a
    row for each block, not for each document. Buckets are ranges of a hash and grow in number with the input. A name with more
    than ``bucket`` bytes of stretches, such as a common phrase among ever other words, is replaced by names from longer grams and beyond that
    by hashes of whole strings of ``length`` bytes, which spread over all buckets; equal strings still meet.
    """
    rows = framed(docs, id_col, text_col).select("doc_id", "text")
    table = durable(rows.mapInArrow(tidy(_to_blocks), "block bigint, n bigint, docs binary, lengths binary, raw binary"), "blocks", group_rows=BLOCKS, batch_bytes=BATCH)
    total = table.agg(F.sum("n")).first()[0] or 0
    few, many = max(1, total // (8 << 20)), max(1, total // (2 * bucket))
    named = table.mapInArrow(tidy(_name_rows(length, few)), "bucket int, block bigint, names binary, low binary, high binary, held binary")
    shared = durable(named.repartition(few, "bucket").sortWithinPartitions("bucket").mapInArrow(tidy(_shared_names(bucket)), "block bigint, names binary, hot binary"), "shared", batch_bytes=BATCH)
    by_block = shared.groupBy("block").agg(F.collect_list(F.struct("names", "hot")).alias("shared"))
    message = "bucket int, block bigint, raw binary, sizes binary, docs binary, names binary"
    sent = durable(table.join(by_block.hint("shuffle_hash"), "block").mapInArrow(tidy(_send_stretches(length, many)), message), "stretches", batch_bytes=BATCH)
    discard(shared)
    dealt = sent.where("bucket >= 0").repartition(many, "bucket").sortWithinPartitions("bucket")
    judged = durable(dealt.mapInArrow(tidy(_judge(length)), "bucket int, block bigint, times binary, least binary"), "judged", batch_bytes=BATCH)
    found = judged.groupBy("block").agg(F.collect_list(F.struct("bucket", "times", "least")).alias("found"))
    where = sent.where("bucket < 0").select("block", F.array(F.struct("raw", "sizes", "docs", "names")).alias("sent"))  # a row for each block
    answers = found.join(where, "block")
    return table.join(answers.hint("shuffle_hash"), "block", "left").mapInArrow(tidy(_cut(length, AT_ONCE)), "doc_id bigint, n_bytes bigint, spans array<array<bigint>>, kept binary")
