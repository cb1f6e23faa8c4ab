"""SimHash near-duplicates by the generalised pigeonhole principle.

Correlated bits are put into one partition, every partition gets its own threshold from a dynamic programme over
estimated candidate counts, fingerprints are probed partition by partition, and candidates are verified.
If ``m`` thresholds sum to ``tau - m + 1``, two fingerprints at distance ``tau`` or less meet in one of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER_BYTES, blocks, durable, framed
from .components import components

BITS = 64
#: A group of fingerprints up to this size is verified in one go; a larger one is parted again by its other bits.
GROUP = 1024
#: Fingerprints that the estimate of candidate counts looks at, at most; the search itself looks at all.
SAMPLE = 512


def shingle_hashes(text: bytes, n: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of ``n`` words, joined by blanks; fewer words are one run, no words none."""
    words = text.translate(LOWER_BYTES).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= n:
        return np.array([h(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)[: len(words) - n + 1].tolist()
    return np.array([h(joined[a:b], seed) for a, b in zip(starts, ends[n - 1 :].tolist(), strict=True)], np.uint64)


def fold(hashes: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """The fingerprint of each stretch ``cut[i]:cut[i+1]``: a bit is set if it is set in more than half of the hashes."""
    n = np.diff(cut)
    out = np.zeros(len(n), np.uint64)
    full = np.flatnonzero(n)
    if len(full):
        # eight counts at a time lie in the bytes of a word; 255 hashes can't overflow them
        at = [np.arange(a, b, 255) for a, b in zip(cut[full], cut[full + 1], strict=True)]
        of, at = np.repeat(full, list(map(len, at))), np.concatenate(at)
        low = np.uint64(0x0101010101010101)
        for shift in range(8):
            part = np.add.reduceat(hashes >> np.uint64(shift) & low, at)
            counts = part.view(np.uint8).reshape(-1, 8)
            first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            total = np.add.reduceat(counts.astype(np.int64), first, axis=0)
            ones = total * 2 > n[full][:, None]
            for byte in range(8):
                out[full] |= ones[:, byte].astype(np.uint64) << np.uint64(8 * byte + shift)
    return out


def fingerprints(docs: DataFrame, n: int = 3, seed: int = 42) -> DataFrame:
    """``doc_id, fp`` of ``docs`` (``doc_id, text``); ``fp`` holds the 64 bits as a signed long, zero without words."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", 4 << 20):
            hashes = [shingle_hashes(t or b"", n, seed) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            cut = np.append(0, np.cumsum(list(map(len, hashes))))
            fp = fold(np.concatenate(hashes), cut)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(sign, "doc_id bigint, fp bigint")


def bit_matrix(fps: DataFrame, columns: tuple[str, ...] = ("fp",)) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and for each pair of bits in how many both are set; ``columns`` hold 64 bits each."""
    bits = BITS * len(columns)

    def count(batches):
        total, n = np.zeros((bits, bits), np.int64), 0
        for batch in batches:
            words = np.stack([np.asarray(batch.column(c)).view(np.uint64) for c in columns], axis=1)
            for i in range(0, len(words), 65536):
                own = (words[i : i + 65536, :, None] >> np.arange(BITS, dtype=np.uint64) & np.uint64(1)).reshape(-1, bits).astype(np.float32)
                total += (own.T @ own).astype(np.int64)
            n += len(words)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(bits * bits + 1), pa.int32()), pa.array(np.append(total.ravel(), n), pa.int64())], ["k", "n"])

    rows = fps.select(*columns).mapInArrow(count, "k int, n bigint").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
    flat = np.zeros(bits * bits + 1, np.int64)
    flat[rows["k"].to_numpy()] = rows["n"].to_numpy()
    return int(flat[-1]), flat[:-1].reshape(bits, bits)


def sampled(fps: DataFrame, columns: tuple[str, ...] = ("fp",), most: int = SAMPLE) -> np.ndarray:
    """Rows of bits of at most ``most`` fingerprints, those with the least hash, on which candidate counts are estimated."""
    rows = fps.select(*columns).orderBy(F.xxhash64(*columns, F.lit(7))).limit(most).toPandas()
    words = np.ascontiguousarray(rows.to_numpy(np.int64)).view(np.uint64).reshape(len(rows), len(columns))
    return (words[:, :, None] >> np.arange(BITS, dtype=np.uint64) & np.uint64(1)).reshape(len(rows), BITS * len(columns)).astype(np.float32)


def correlated_groups(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """Deal the bits into ``m`` partitions of about equal width, each grown by the bits most correlated with it."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd)
    np.fill_diagonal(corr, 0)
    free, out = list(range(len(both))), []
    for k in range(m):
        width = (len(both) - sum(map(len, out))) // (m - k)
        group = [max(free, key=lambda b: (corr[b, free].sum(), -b))]
        free.remove(group[0])
        while len(group) < width:
            best = max(free, key=lambda b: (corr[b, group].sum(), -b))
            group.append(best)
            free.remove(best)
        out.append(sorted(group))
    return out


def radius(t: int) -> int:
    """Bits that each of two fingerprints flips so that they meet if they differ in ``t``."""
    return (t + 1) // 2


def candidates(n: int, both: np.ndarray, group: list[int], tau: int, sample: np.ndarray | None = None) -> list[float]:
    """Estimated work of a partition at thresholds -1 to ``tau``: pairs within the threshold, and probes sent.

    The share of pairs is the greater of what independent bits would give and of what the pairs of ``sample`` show, for bits
    of one partition are correlated.
    """
    p = np.diag(both)[group] / max(n, 1)
    near = np.zeros(tau + 1)
    near[0] = 1
    for same in p * p + (1 - p) ** 2:
        near = near * same + np.append(0, near[:-1]) * (1 - same)
    share = np.cumsum(near)
    if sample is not None and len(sample) > 1:
        x = sample[:, group]
        ones = x.sum(axis=1)
        apart = (ones[:, None] + ones[None, :] - 2 * x @ x.T).astype(np.uint8)
        seen = np.bincount(apart.ravel(), minlength=tau + 1)
        seen[0] -= len(x)  # each beside itself
        share = np.maximum(share, np.cumsum(seen)[: tau + 1] / seen.sum())
    pairs = n * (n - 1) / 2 * share
    sent = np.array([sum(comb(len(group), j) for j in range(radius(t) + 1)) for t in range(tau + 1)])
    return [0.0, *(pairs + n * sent).tolist()]


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds (-1 or more) that sum to ``total`` at the least cost, by dynamic programming over partitions."""
    best = {0: (0.0, [])}
    for cost in costs:
        after = {}
        for done, (c, chosen) in best.items():
            for t, more in enumerate(cost):
                key, value = done + t - 1, (c + more, [*chosen, t - 1])
                if key not in after or value < after[key]:
                    after[key] = value
        best = after
    return best.get(total, (float("inf"), []))


def plan(n: int, both: np.ndarray, tau: int, sample: np.ndarray | None = None, parts: range | None = None) -> list[tuple[int, int]]:
    """(bit mask, threshold) of each partition that is probed, for the number of partitions (of ``parts``) with the least cost."""
    found = []
    for m in parts or range(1, 2 * tau + 3):
        groups = correlated_groups(n, both, m)
        cost, chosen = allocate([candidates(n, both, g, tau, sample) for g in groups], tau - m + 1)
        found.append((cost, m, [(sum(1 << b for b in g), t) for g, t in zip(groups, chosen, strict=False) if t >= 0]))
    return min(found)[2]


def signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def probes(fps: DataFrame, parts: list[tuple[int, int]]) -> DataFrame:
    """``key, free, fp``: one row for each value within half a partition's threshold of the fingerprint's own, where near pairs meet.

    ``free`` are the bits on which rows of one key may still differ.
    """
    arms = []
    for k, (mask, t) in enumerate(parts):
        bits = [b for b in range(BITS) if mask >> b & 1]
        flips = [sum(1 << b for b in c) for j in range(radius(t) + 1) for c in combinations(bits, j)]
        free = (1 << BITS) - 1 - (0 if t else mask)
        value = F.col("fp").bitwiseAND(F.lit(signed(mask)))
        flipped = F.explode(F.transform(F.array(*[F.lit(signed(f)) for f in flips]), lambda f, v=value: v.bitwiseXOR(f)))
        arms.append(fps.select("fp", flipped.alias("v")).select(F.xxhash64(F.lit(k), "v").alias("key"), F.lit(signed(free)).cast("bigint").alias("free"), "fp"))
    out = arms[0]
    for arm in arms[1:]:
        out = out.unionByName(arm)
    return out


def _part_again(tau: int) -> callable:
    """Rows of large groups keyed anew: their free bits in ``tau + 1`` parts, one of which near pairs must share."""

    def part(batches):
        for batch in batches:
            key, free, fp = (np.asarray(batch.column(c)).view(np.uint64) for c in ("key", "free", "fp"))
            for f in np.unique(free):
                own = free == f
                bits = [b for b in range(BITS) if int(f) >> b & 1]
                for j in range(tau + 1):
                    mask = sum(1 << b for b in bits[j * len(bits) // (tau + 1) : (j + 1) * len(bits) // (tau + 1)])
                    values = np.stack([key[own], np.full(own.sum(), j, np.uint64), fp[own] & np.uint64(mask)], axis=1)
                    rows = values.tobytes()
                    again = np.fromiter((xxhash.xxh64_intdigest(rows[i : i + 24]) for i in range(0, len(rows), 24)), np.uint64, int(own.sum()))
                    rest = np.full(len(again), int(f) & ~mask, np.uint64)
                    yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (again, rest, fp[own])], ["key", "free", "fp"])

    return part


def _verify(tau: int) -> callable:
    """Links within each key: every linked fingerprint to the least of its component there."""

    def links(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        fp = np.unique(fp)
        near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= tau
        label = np.arange(len(fp))
        while True:  # least label beside each, until nothing changes
            after = np.where(near, label[None, :], len(fp)).min(axis=1)
            after = after[after]
            if (after == label).all():
                break
            label = after
        moved = label != np.arange(len(fp))
        return fp[moved], fp[label[moved]]

    def verify(batches):
        kept_key, kept = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in _then_none(batches):
            if batch is None:
                key, fp = kept_key, kept
            else:
                key = np.append(kept_key, np.asarray(batch.column("key")))
                fp = np.append(kept, np.asarray(batch.column("fp")).view(np.uint64))
            cut = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
            ends = np.append(cut[1:], len(key))
            last = len(cut) if batch is None else len(cut) - 1
            us, vs = [], []
            for a, b in zip(cut[:last].tolist(), ends[:last].tolist(), strict=True):
                if b - a == 2:
                    x, y = fp[a], fp[a + 1]
                    if x != y and int(x ^ y).bit_count() <= tau:
                        us.append([max(x, y)])
                        vs.append([min(x, y)])
                elif b - a > 2:
                    u, v = links(fp[a:b])
                    us.append(u)
                    vs.append(v)
            if batch is not None and len(cut):
                kept_key, kept = key[cut[-1] :], fp[cut[-1] :]
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.uint64).view(np.int64)) for x in (us, vs)], ["u", "v"])

    return verify


def _then_none(batches):
    yield from batches
    yield None


def near_links(fps: DataFrame, tau: int = 2, group: int = GROUP) -> DataFrame:
    """``u, v``: links between distinct fingerprints (``fp``) that have the components of all pairs within ``tau`` bits.

    Groups of one probe value are verified whole up to ``group`` fingerprints; larger ones, such as a family of
    thousands of edited copies, are parted again by the bits on which they may differ. A part has
    distinct fingerprints, so the bits run out before the parting does, and no pair is lost.
    """
    n, both = bit_matrix(fps)
    rows, found = probes(fps, plan(n, both, tau)), None
    schema = "u bigint, v bigint"
    while True:
        rows = durable(rows, "probes")
        sizes = durable(rows.groupBy("key").count().where("count > 1"), "sizes")
        small = rows.join(sizes.where(F.col("count") <= group), "key").select("key", "fp").repartition("key").sortWithinPartitions("key")
        links = small.mapInArrow(_verify(tau), schema)
        found = links if found is None else found.unionByName(links)
        hot = sizes.where(F.col("count") > group)
        if hot.isEmpty():
            return found
        rows = rows.join(hot.select("key"), "key").select("key", "free", "fp").mapInArrow(_part_again(tau), "key bigint, free bigint, fp bigint").distinct()


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tau: int = 2, n: int = 3) -> DataFrame:
    """Return ``doc_id, fp, component_id`` for every row of ``docs``; ``component_id`` is the smallest ``doc_id`` reachable.

    * null and empty texts, and texts without words, have fingerprint zero, which links like any other
    * fewer than ``n`` words make one shingle; very long texts are read whole
    * equal fingerprints are one node, so thousands of copies cost one row in the search; rows that repeat a
      ``doc_id`` with other texts are each linked by their own fingerprint
    * an empty table gives an empty result; other columns are not read
    """
    signed_docs = durable(fingerprints(framed(docs, id_col, text_col), n), "fingerprints")
    fps = durable(signed_docs.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(near_links(fps.select("fp"), tau))
    labelled = fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = labelled.groupBy("root").agg(F.min("first").alias("component_id"))
    named = labelled.join(least, "root").select("fp", "component_id")
    return signed_docs.join(named, "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
