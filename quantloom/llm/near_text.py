"""SimHash near copies judged by the similarity of their word runs.

The generalised pigeonhole search of ``simhash`` runs on fingerprints of ``WORDS`` times 64 bits, wide enough for texts whose sets of
word runs are similar by 0.8: bits are dealt into correlated partitions, thresholds come from the dynamic programme, and
fingerprints meet under the values of a partition within half its threshold. Whom they meet is judged on the whole sets, so
no text is linked below the bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, discard, durable, framed, runs, tidy
from .components import components
from .simhash import BITS, bit_matrix, fold, plan, radius, sampled, shingle_hashes

#: 64-bit words of a fingerprint; differing bits that are surely found; differing bits beyond which a pair isn't judged.
#: At a similarity of 0.8 a pair differs in 29 of 192 bits on average, with a spread of 5.
WORDS, TAU, FAR = 3, 23, 50
#: Numbers of partitions that the plan chooses from.
PARTS = range(6, 13)
#: Least similarity of near copies, as a fraction.
LEAST = (4, 5)
#: Sets or fingerprints that are compared in one go at most; larger groups are judged in chunks of half as many.
GROUP = 1024
COLUMNS = tuple(f"f{w}" for w in range(WORDS))
#: What makes several fingerprints out of one hash of a run.
ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def _sets(batch: pa.RecordBatch, n: int) -> list[np.ndarray]:
    return [np.unique(shingle_hashes(t or b"", n)) for t in batch.column("text").cast(pa.binary()).to_pylist()]


def _names(sets: list[np.ndarray]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(s.tobytes()) for s in sets), np.uint64, len(sets)).view(np.int64)


def mixed(hashes: np.ndarray, odd: int) -> np.ndarray:
    h = (hashes ^ hashes >> np.uint64(32)) * np.uint64(odd)
    h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(32)


def _sign(n: int) -> callable:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", 1 << 20):
            sets = _sets(batch, n)
            cut = np.append(0, np.cumsum(list(map(len, sets))))
            flat = np.concatenate(sets)
            words = [pa.array(fold(mixed(flat, odd), cut).view(np.int64)) for odd in ODD]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(_names(sets)), *words], ["doc_id", "th", "s", *COLUMNS])

    return sign


def _send_sets(n: int) -> callable:
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", 1 << 20):
            sets = _sets(batch, n)
            yield pa.RecordBatch.from_arrays([pa.array(_names(sets)), pa.array([s.tobytes() for s in sets], pa.binary())], ["s", "hashes"])

    return send


def words_of(mask: int) -> np.ndarray:
    return np.array([mask >> BITS * w & (1 << BITS) - 1 for w in range(WORDS)], np.uint64)


def keyed(nodes: DataFrame, part: int, mask: int, t: int) -> DataFrame:
    """``key, s``, the fingerprint and ``flip``, for each value within half the partition's threshold of the fingerprint's own.

    ``flip`` tells the bits that the value differs in: how many, the lowest's number and one more than the highest's, a byte each; 255
    and 0 stand for none.
    """
    bits = [b for b in range(BITS * WORDS) if mask >> b & 1]
    words = lambda x: words_of(x).view(np.int64).tolist()
    flips = [c for j in range(radius(t) + 1) for c in combinations(bits, j)]
    told = lambda c: len(c) << 16 | min(c, default=255) << 8 | max(c, default=-1) + 1
    values = [[*zip(COLUMNS, words(sum(1 << b for b in c)), strict=True), ("flip", told(c))] for c in flips]
    offered = F.array(*[F.struct(*[F.lit(x).cast("bigint").alias(name) for name, x in v]) for v in values])
    met = [F.col(c).bitwiseAND(F.lit(m)).bitwiseXOR(F.col(f"f.{c}")) for c, m in zip(COLUMNS, words(mask), strict=True)]
    return nodes.select("s", *COLUMNS, F.explode(offered).alias("f")).select(F.xxhash64(F.lit(part), *met).alias("key"), "s", *COLUMNS, F.col("f.flip").cast("int").alias("flip"))


def _meet(group: int, before: list[tuple[np.ndarray, int]]) -> callable:
    """``key, s, v, d`` of rows that have a near one under their key: the nearest with a smaller ``s``, if there is one, and its distance.

    A pair counts once: in the first partition where it meets (``before`` has masks and reaches of those already searched), and of the
    values there under the one for which the smaller ``s`` flips the lower half of the bits that they differ in, the odd one too.
    Rows come sorted by key. A key with more than ``group`` rows passes in chunks, each beside the key's first row, and all of it goes on.
    """

    def near(key: np.ndarray, s: np.ndarray, words: np.ndarray, flip: np.ndarray, hot: np.ndarray) -> pa.RecordBatch:
        n = len(key)
        partner, distance, met = np.full(n, np.iinfo(np.int64).max), np.full(n, FAR + 1), hot.copy()
        at = np.arange(n)
        for step in range(1, n):
            at = at[at + step < n]
            at = at[key[at] == key[at + step]]
            if not len(at):
                break
            apart = words[at] ^ words[at + step]
            d = np.bitwise_count(apart).sum(axis=1)
            ok = np.flatnonzero(d <= FAR)
            for mask, reach in before:
                ok = ok[np.bitwise_count(apart[ok] & mask).sum(axis=1) > reach]
            a, b, d = at[ok], at[ok] + step, d[ok]
            above = s[a] > s[b]
            less, more = np.where(above, flip[b], flip[a]), np.where(above, flip[a], flip[b])
            once = ((less & 255) <= (more >> 8 & 255)) & np.isin((less >> 16) - (more >> 16), (0, 1))
            a, b, d, above = a[once], b[once], d[once], above[once]
            met[a] = met[b] = True
            high, low = np.where(above, a, b), np.where(above, b, a)
            # a row stands once on each side of a step, so two rounds see each of its partners
            for side in (above, ~above):
                u, v, x = high[side], low[side], d[side]
                better = (x < distance[u]) | ((x == distance[u]) & (s[v] < partner[u]))
                distance[u[better]], partner[u[better]] = x[better], s[v[better]]
        some = partner < np.iinfo(np.int64).max
        return pa.RecordBatch.from_arrays([pa.array(key[met]), pa.array(s[met]), pa.array(partner[met], mask=~some[met]), pa.array(distance[met].astype(np.int32))], ["key", "s", "v", "d"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, hot, done = None, False, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            new = (np.asarray(batch.column("key")), np.asarray(batch.column("s")), np.stack([np.asarray(batch.column(c)).view(np.uint64) for c in COLUMNS], axis=1), np.asarray(batch.column("flip")))
            key, s, words, flip = new if held is None else tuple(np.concatenate(x) for x in zip(held, new, strict=True))
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            size = np.diff(np.append(first, len(key)))
            whole = np.flatnonzero((size <= group) & (first < first[-1]))
            own = np.repeat(np.isin(np.arange(len(first)), whole), size)
            twice = own & np.repeat(size > 1, size)
            if hot and len(first) > 1 and size[0] <= group:  # the rest of a key that began in an earlier batch
                twice[: size[0]] = False
                yield near(key[: size[0]], s[: size[0]], words[: size[0]], flip[: size[0]], np.ones(size[0], bool))
                hot = False
            if twice.any():
                yield near(key[twice], s[twice], words[twice], flip[twice], np.zeros(int(twice.sum()), bool))
            for k in np.flatnonzero((size > group) | (np.arange(len(first)) == len(first) - 1)).tolist():
                a, b, last = first[k], first[k] + size[k], k == len(first) - 1
                at = a
                while b - at > group:
                    chunk = np.append(a, np.arange(max(at, a + 1), at + group))
                    yield near(key[chunk], s[chunk], words[chunk], flip[chunk], np.ones(len(chunk), bool))
                    at += group
                if last:  # its first row stays beside what may follow
                    rest = np.append(a, np.arange(max(at, a + 1), b))
                    hot = hot and k == 0 or at > a
                    held = (key[rest], s[rest], words[rest], flip[rest])
                elif at > a:
                    chunk = np.append(a, np.arange(at, b))
                    yield near(key[chunk], s[chunk], words[chunk], flip[chunk], np.ones(len(chunk), bool))
        if held is not None and (hot or len(held[0]) > 1):
            yield near(*held, np.full(len(held[0]), hot))

    return meet


def met(nodes: DataFrame, group: int) -> DataFrame:
    """Durable ``key, s, v, d`` of all partitions of the plan, which are searched one after another, so that one is on disk at a time."""
    n, both = bit_matrix(nodes, COLUMNS)
    out, before = None, []
    for k, (mask, t) in enumerate(plan(max(n, 1), both, TAU, sampled(nodes, COLUMNS), PARTS)):
        rows = keyed(nodes, k, mask, t).repartition("key").sortWithinPartitions("key")
        found = durable(rows.mapInArrow(tidy(_meet(group, list(before))), "key bigint, s bigint, v bigint, d int"), "met")
        before.append((words_of(mask), 2 * radius(t)))
        out = found if out is None else out.unionByName(found)
    return out


def similar(a: Column, b: Column) -> Column:
    """Whether two sets, as binary values of sorted 64-bit hashes, are similar enough; two empty ones are."""

    @F.arrow_udf("boolean")
    def judged(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(LEAST[1] * both >= LEAST[0] * (len(x) + len(y) - both))
        return pa.array(out, pa.bool_())

    return judged(a, b)


def linked(sets: list[np.ndarray]) -> np.ndarray:
    """For each set the place of the first in its component of pairs that are similar enough; no set is empty."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    ends = np.cumsum(size)
    starts, words = ends - size, np.unique(np.concatenate(sets), return_inverse=True)[1]
    mark, label = np.zeros(int(words.max()) + 1, np.int32), np.full(len(sets), -1)
    for first in range(len(sets)):
        if label[first] >= 0:
            continue
        label[first], todo = first, [first]
        while todo and (label < 0).any():
            i = todo.pop()
            own = words[starts[i] : ends[i]]
            mark[own] = 1
            both = np.add.reduceat(mark[words], starts)
            mark[own] = 0
            near = np.flatnonzero((label < 0) & (LEAST[1] * both >= LEAST[0] * (size + size[i] - both)))
            label[near] = first
            todo += near.tolist()
    return label


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, part in runs(batches, "unit"):
        s = np.asarray(part.column("s"))
        label = linked([np.frombuffer(h, np.uint64) for h in part.column("hashes").to_pylist()])
        moved = label != np.arange(len(s))
        yield pa.RecordBatch.from_arrays([pa.array(s[moved]), pa.array(s[label[moved]])], ["u", "v"])


def judged_groups(keys: DataFrame, sets: DataFrame, group: int) -> DataFrame:
    """``u, v``: links that have the components of all similar pairs that share a key (``key, s``).

    A key with more than ``group`` sets, such as a family of thousands of edited copies, is judged in chunks, each with the
    key's least set. Then what isn't connected to that set meets all the others, chunk by chunk: no pair is lost, and no task holds more
    than about ``group`` sets.
    """
    sizes = durable(keys.groupBy("key").count().where("count > 1"), "sizes")
    many = lambda c: F.ceil(c / F.lit(max(1, group // 2))).cast("int")
    one_of = lambda chunks: F.pmod(F.xxhash64("s"), chunks).cast("int")
    every = lambda chunks: F.explode(F.sequence(F.lit(0), chunks - 1))
    members = keys.join(sizes.where(F.col("count") <= group), "key").groupBy("key").agg(F.sort_array(F.collect_list("s")).alias("members"))
    units = members.select("members").distinct().select(F.xxhash64("members").alias("unit"), F.explode("members").alias("s"))
    hot = durable(keys.join(sizes.where(F.col("count") > group), "key").select("key", "s", many(F.col("count")).alias("chunks")), "hot")
    least = hot.groupBy("key").agg(F.min("s").alias("s"), F.first("chunks").alias("chunks"))
    units = units.unionByName(hot.select(F.xxhash64("key", one_of(F.col("chunks"))).alias("unit"), "s"))
    units = durable(units.unionByName(least.select("key", "s", every(F.col("chunks")).alias("c")).select(F.xxhash64("key", "c").alias("unit"), "s")).distinct(), "units")

    def judged(units: DataFrame) -> DataFrame:
        return units.join(sets, "s").select("unit", "s", "hashes").repartition("unit").sortWithinPartitions("unit").mapInArrow(tidy(_judge), "u bigint, v bigint")

    found = durable(judged(units), "near")
    discard(sizes, units)
    if hot.isEmpty():
        return found
    roots = components(found)
    rooted = hot.join(roots, hot["s"] == roots["node"], "left").select("key", "s", "chunks", F.coalesce("root", "s").alias("root"))
    main = rooted.join(least.select("key", "s"), ["key", "s"]).select("key", F.col("root").alias("main"))
    rest = durable(rooted.join(main, "key").where("root <> main").select("key", "s", "chunks"), "rest")
    parts = rest.groupBy("key").agg(many(F.count("*")).alias("parts"))
    a = rest.join(parts, "key").select("key", "s", one_of(F.col("parts")).alias("i"), every(F.col("chunks")).alias("j"))
    b = hot.join(parts, "key").select("key", "s", one_of(F.col("chunks")).alias("j"), every(F.col("parts")).alias("i"))
    return found.unionByName(durable(judged(a.unionByName(b.select(a.columns)).select(F.xxhash64("key", "i", "j").alias("unit"), "s").distinct()), "near"))


def similar_links(rows: DataFrame, nodes: DataFrame, n: int, group: int) -> DataFrame:
    """``u, v``: links that have the components of all similar pairs of sets that meet under a key.

    First every set is judged beside the nearest smaller one that it met. Keys whose sets are connected by then have no
    more to tell; all others are judged whole. The empty set is like no other and takes no part.
    """
    nodes = nodes.where(F.col("s") != int(_names([np.zeros(0, np.uint64)])[0]))
    keys = met(nodes, group)
    wanted = durable(keys.select("s").distinct().join(nodes, "s").select("s", F.col("first.th").alias("th")), "wanted")
    texts = rows.join(wanted.select("th").distinct(), "th", "left_semi").select("text")
    sets = durable(texts.mapInArrow(tidy(_send_sets(n)), "s bigint, hashes binary").join(wanted.select("s"), "s", "left_semi").dropDuplicates(["s"]), "sets")
    pairs = keys.where("v is not null").groupBy("s").agg(F.min(F.struct("d", "v")).alias("x")).select(F.col("s").alias("u"), F.col("x.v").alias("v"))
    pairs = pairs.join(sets.select(F.col("s").alias("u"), F.col("hashes").alias("a")), "u").join(sets.select(F.col("s").alias("v"), F.col("hashes").alias("b")), "v")
    found = durable(pairs.where(similar(F.col("a"), F.col("b"))).select("u", "v"), "near")
    roots = durable(components(found), "roots")
    rooted = keys.select("key", "s").join(roots, F.col("s") == F.col("node"), "left").select("key", "s", F.coalesce("root", "s").alias("root"))
    open_ = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    left = durable(keys.select("key", "s").join(open_, "key", "left_semi").distinct(), "open")
    return found.unionByName(judged_groups(left, sets, group))


def labelled(docs: DataFrame, id_col: str, text_col: str, n: int, group: int) -> tuple[DataFrame, DataFrame]:
    """(``doc_id, th, s`` of every row, ``s, winner`` of every set): ``winner`` is the least (``no id, doc_id, th``) reachable."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.xxhash64(F.col(f"`{text_col}`")).alias("th"))
    signed = durable(rows.mapInArrow(tidy(_sign(n)), ", ".join(f"{c} bigint" for c in ("doc_id", "th", "s", *COLUMNS))), "signed")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("first")
    nodes = durable(signed.groupBy("s").agg(first, *[F.first(c).alias(c) for c in COLUMNS]), "nodes")
    roots = components(similar_links(rows, nodes, n, group))
    own = nodes.join(roots, nodes["s"] == roots["node"], "left").select("s", "first", F.coalesce("root", "s").alias("root"))
    winners = own.groupBy("root").agg(F.min("first").alias("winner"))
    return signed.select("doc_id", "th", "s"), own.join(winners, "root").select("s", "winner")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, group: int = GROUP) -> DataFrame:
    """Return ``doc_id, component_id`` for every row of ``docs`` with an id; ``component_id`` is the smallest ``doc_id`` reachable.

    Two texts are linked if their sets of runs of ``n`` words (A-Z lower-cased) have a Jaccard similarity of ``LEAST`` or more
    and their fingerprints meet: surely if these differ in ``TAU`` bits or fewer, likely beyond.

    * equal sets are one node, so thousands of copies cost one row in the search
    * null and empty texts, and texts without words, are equal; fewer than ``n`` words make one run; long texts are read whole
    * rows without an id are left out; rows that repeat an id are each linked by their own text
    * an empty table gives an empty result; other columns are not read
    """
    signed, winners = labelled(framed(docs, id_col, text_col).select("doc_id", "text"), "doc_id", "text", n, group)
    return signed.join(winners, "s").select("doc_id", F.col("winner.doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, group: int = GROUP) -> DataFrame:
    """One row of each group of near copies, with all its columns: that with the smallest id, and of rows that share it the least text hash.

    * a row without an id stays only where its group has none with one
    * rows alike in id and text are one document, of which one row stays
    * everything else is as ``similar_groups`` has it
    """
    signed, winners = labelled(docs, id_col, text_col, n, group)
    stay = winners.select("winner.doc_id", "winner.th").distinct()
    times = signed.groupBy("doc_id", "th").count()
    stay = durable(stay.join(times, stay["doc_id"].eqNullSafe(times["doc_id"]) & (stay["th"] == times["th"])).select(stay["doc_id"].alias("_d"), stay["th"].alias("_t"), "count"), "stay")
    th = F.xxhash64(F.col(f"`{text_col}`"))

    def having(which: DataFrame) -> DataFrame:
        return docs.join(which, F.col(f"`{id_col}`").cast("long").eqNullSafe(which["_d"]) & (th == which["_t"]), "left_semi")

    repeated = stay.where("count > 1")
    if repeated.isEmpty():
        return having(stay)
    key = "_" * (1 + max(map(len, docs.columns)))  # longer than any column's name
    again = having(repeated).withColumn(key, th).dropDuplicates([id_col, key]).drop(key)
    return having(stay.where("count = 1")).unionByName(again)
