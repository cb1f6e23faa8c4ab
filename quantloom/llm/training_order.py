"""Token ids in training order: fixed-stride binary shards that are read one after another.

A keyed Feistel network over the next power of four, walked until it falls inside, permutes the numbers of all
sequences into global slots. Each shard is a range of slots, written by one task as records of equal size, so
that a reader finds any slot by arithmetic and resumes wherever it stopped.
"""

from __future__ import annotations

import base64
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, discard, durable, framed, ragged, shared_dir

ROUNDS = 6
#: Buckets in which documents are put into their order, at most.
MAX_BUCKETS = 65_536
#: Splits text before the merges of a rank file; a fixed value of the public vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: What it takes for white space, a fixed list of Unicode's.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Runs of white space of this length are split here: the splitter's look-ahead can't take millions.
LONG_SPACE = 50_000


class Permutation:
    """A keyed bijection of 0 to ``n - 1`` and its inverse, over whole arrays."""

    def __init__(self, n: int, key: int) -> None:
        self.n, self.half = n, max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        self.mask = np.uint64((1 << self.half) - 1)
        self.keys = np.random.default_rng(key).integers(0, 1 << 63, ROUNDS, dtype=np.uint64)

    def _mix(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        x = (x ^ key) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        return (x ^ x >> np.uint64(32)) & self.mask

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        shift = np.uint64(self.half)
        left, right = x >> shift, x & self.mask
        for key in self.keys[::-1] if back else self.keys:
            if back:
                left, right = right ^ self._mix(left, key), left
            else:
                left, right = right, left ^ self._mix(right, key)
        return left << shift | right

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        out = self._once(np.asarray(x).astype(np.uint64), back)
        while (outside := out >= self.n).any():
            out[outside] = self._once(out[outside], back)
        return out.astype(np.int64)

    def slots(self, numbers: np.ndarray) -> np.ndarray:
        return self._walk(numbers, False)

    def numbers(self, slots: np.ndarray) -> np.ndarray:
        return self._walk(slots, True)


@cache
def _ranks(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})


def encoded(own, text: str, long_space: int = LONG_SPACE) -> list[int]:
    """The ids of ``text``.

    The splitter takes a run of white space before other text without its last character, and at the end whole, as
    one piece; no piece goes on from other text into such a run. So a long one is cut out there and merged by itself.
    """
    if len(text) < long_space:
        return own.encode_ordinary(text)
    out, at = [], 0
    for run in re.finditer(f"[{SPACE}]{{{long_space},}}", text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        out += own.encode_ordinary(text[at : run.start()])
        out += own._encode_single_piece(text[run.start() : end].encode())
        at = end
    return out + own.encode_ordinary(text[at:])


def sequences(docs: DataFrame, ranks: str, most: int, end_id: int, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """Durable ``part, idx, doc_id, piece, start, length, ids``: each document's ids and ``end_id``, cut at ``most``.

    Documents are dealt by ranges of a hash of id and text into ``buckets`` (the session's shuffle partitions, at most ``MAX_BUCKETS``)
    and sorted there, so bucket after bucket they stand in one order, whatever the files, the cluster or ``buckets``. ``part`` is the
    bucket, ``idx`` the place in it. Rows alike in id and text stand together; which comes first makes no difference.
    ``ids`` are little-endian unsigned 16-bit; a null text is an empty one.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, done = _ranks(ranks), None, 0
        for batch in blocks(batches, "text", 2 << 20):
            # lone surrogates can't reach here: Spark's strings are UTF-8
            found = [np.array([*encoded(own, t or ""), end_id], "<u2") for t in batch.column("text").to_pylist()]
            n = np.fromiter(map(len, found), np.int64, len(found))
            raw = np.concatenate(found).tobytes()
            pieces = -(-n // most)
            of = np.repeat(np.arange(len(n)), pieces)
            piece = ragged(np.zeros(len(n), np.int64), pieces)
            length = np.minimum(most, n[of] - piece * most)
            at = (np.append(0, np.cumsum(length)) * 2).astype(np.int32)
            ids = pa.BinaryArray.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(raw)])
            parts = np.asarray(batch.column("bucket"))[of]
            # places count on from the last batch within a bucket
            first = np.flatnonzero(np.append(True, parts[1:] != parts[:-1]))
            base = np.zeros(len(first), np.int64)
            base[0] = done if parts[0] == part else 0
            idx = np.arange(len(parts)) - np.repeat(first - base, np.diff(np.append(first, len(parts))))
            part, done = parts[-1], idx[-1] + 1
            arrays = [pa.array(parts, pa.int32()), pa.array(idx, pa.int64()), pa.array(np.asarray(batch.column("doc_id"))[of], pa.int64())]
            arrays += [pa.array(piece, pa.int32()), pa.array(piece * most, pa.int64()), pa.array(length, pa.int32()), ids]
            yield pa.RecordBatch.from_arrays(arrays, ["part", "idx", "doc_id", "piece", "start", "length", "ids"])

    many = min(buckets or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), MAX_BUCKETS)
    rows = framed(docs, id_col, text_col).select("doc_id", "text").withColumn("h", F.xxhash64("doc_id", "text"))
    rows = rows.withColumn("bucket", F.shiftright((F.shiftright("h", 32) + (1 << 31)) * many, 32).cast("int"))
    # exact ties of the hash are settled by id and text, so the order stays one and the same
    rows = rows.repartitionById(many, F.col("bucket")).sortWithinPartitions("bucket", "h", "doc_id", "text")
    return durable(rows.select("bucket", "doc_id", "text").mapInArrow(cut, "part int, idx bigint, doc_id bigint, piece int, start bigint, length int, ids binary"), "sequences")


def first_numbers(table: DataFrame) -> np.ndarray:
    """By part, the number of its first sequence; at most ``MAX_BUCKETS`` counts reach the driver."""
    sizes = table.groupBy("part").count().toPandas()
    out = np.zeros(int(sizes["part"].max()) + 2 if len(sizes) else 1, np.int64)
    out[sizes["part"].to_numpy() + 1] = sizes["count"].to_numpy()
    return np.cumsum(out)


def materialise(docs: DataFrame, ranks: str, path: str | None = None, key: int = 0, most: int = 256, end_id: int = 50256, per_shard: int = 65536, waves: int = 4, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, str]:
    """Write all sequences to ``path`` and return (``slot, shard, record, doc_id, piece, start, length, ids_crc32``, path).

    A record is a little-endian 32-bit length and ``most`` unsigned 16-bit ids, padded with ``end_id``; shard ``s`` holds
    slots ``s * per_shard`` onward; ``order.json`` has the numbers a reader needs. The same rows, key and ``most`` give the
    same slots, however the input is cut into files and whatever the cluster. Shards are written in ``waves``, so that only a part of the ids is in
    shuffle files at a time; a task writes its shard under a name of its own and renames it when it is whole,
    so a lost or repeated task leaves no half shard.

    * null or empty text: one sequence that holds ``end_id`` only; rows that repeat a document are written each
    * rows without an id are left out; very long texts become many sequences, be they white space throughout; an empty table leaves ``order.json`` with no slots and gives no rows
    * other columns are not read
    """
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/quantloom/order-{uuid.uuid4().hex}"
    table = sequences(docs, ranks, most, end_id, id_col, text_col)
    firsts = first_numbers(table)
    total = int(firsts[-1])
    order = {"slots": total, "per_shard": per_shard, "most": most, "stride": 4 + 2 * most, "key": key, "end_id": end_id}
    store, root = fs.FileSystem.from_uri(path)
    store.create_dir(root)
    with store.open_output_stream(f"{root}/order.json") as out:
        out.write(json.dumps(order).encode())
    shards = -(-total // per_shard)
    per_wave = max(1, -(-shards // waves))
    permutation, columns = Permutation(total, key), ["doc_id", "piece", "start", "length", "ids"]
    numbered = table.select("part", "idx", *columns)
    found = None
    for wave in range(-(-shards // per_wave)):
        low, high = wave * per_wave * per_shard, min(total, (wave + 1) * per_wave * per_shard)

        def dealt(batches: Iterator[pa.RecordBatch], low=low, high=high) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                slot = permutation.slots(firsts[np.asarray(batch.column("part"))] + np.asarray(batch.column("idx")))
                own = pa.array(np.flatnonzero((slot >= low) & (slot < high)))
                yield pa.RecordBatch.from_arrays([pa.array(slot).take(own), *[batch.column(c).take(own) for c in columns]], ["slot", *columns])

        rows = numbered.mapInArrow(dealt, "slot bigint, doc_id bigint, piece int, start bigint, length int, ids binary")
        shard = (F.col("slot") / F.lit(per_shard)).cast("int") - wave * per_wave
        rows = rows.repartitionById(min(per_wave, shards - wave * per_wave), shard).sortWithinPartitions("slot")
        written = durable(rows.mapInArrow(_writer(path, order), "slot bigint, shard int, record int, doc_id bigint, piece int, start bigint, length int, ids_crc32 bigint"), "written")
        found = written if found is None else found.unionByName(written)
    if found is None:
        found = spark.createDataFrame([], "slot bigint, shard int, record int, doc_id bigint, piece int, start bigint, length int, ids_crc32 bigint")
    discard(table)
    return found, path


def _writer(path: str, order: dict) -> callable:
    per_shard, most = order["per_shard"], order["most"]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        shard, out, temporary = None, None, f"{root}/.writing-{uuid.uuid4().hex}"

        def close():
            if out is not None:
                out.close()
                store.move(temporary, f"{root}/shard-{shard:08d}.bin")

        for batch in batches:
            slots, length = np.asarray(batch.column("slot")), np.asarray(batch.column("length"))
            of = slots // per_shard
            ids = batch.column("ids").to_pylist()
            for s in np.unique(of).tolist():
                own = np.flatnonzero(of == s)
                if s != shard:
                    close()
                    shard, out = s, store.open_output_stream(temporary)
                records = np.full((len(own), 2 + most), order["end_id"], "<u2")
                records[:, :2] = length[own].astype("<u4").view("<u2").reshape(-1, 2)
                inside = np.arange(most)[None, :] < length[own][:, None]
                records[:, 2:][inside] = np.frombuffer(b"".join([ids[i] for i in own]), "<u2")
                out.write(records.tobytes())
            crc = pa.array([zlib.crc32(x) for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("slot"), pa.array(of, pa.int32()), pa.array(slots % per_shard, pa.int32()), *[batch.column(c) for c in ("doc_id", "piece", "start", "length")], crc], ["slot", "shard", "record", "doc_id", "piece", "start", "length", "ids_crc32"])
        close()

    return write


class Reader:
    """Sequences of a written order from any slot on: ``for slot, ids in Reader(path).read(start)``."""

    def __init__(self, path: str) -> None:
        self.store, self.root = fs.FileSystem.from_uri(path)
        with self.store.open_input_stream(f"{self.root}/order.json") as f:
            self.order = json.loads(f.read())

    def __len__(self) -> int:
        return self.order["slots"]

    def read(self, start: int = 0, stop: int | None = None, at_once: int = 4096) -> Iterator[tuple[int, np.ndarray]]:
        per_shard, stride = self.order["per_shard"], self.order["stride"]
        stop = len(self) if stop is None else min(stop, len(self))
        while start < stop:
            shard, record = divmod(start, per_shard)
            end = min(stop, (shard + 1) * per_shard)
            with self.store.open_input_file(f"{self.root}/shard-{shard:08d}.bin") as f:
                f.seek(record * stride)
                while start < end:
                    n = min(at_once, end - start)
                    rows = np.frombuffer(f.read(n * stride), "<u2").reshape(n, -1)
                    lengths = np.ascontiguousarray(rows[:, :2]).view("<u4")[:, 0]
                    for row, length in zip(rows, lengths.tolist(), strict=True):
                        yield start, row[2 : 2 + length]
                        start += 1
