"""What the operators of this subpackage share: row framing, durable tables, byte-level helpers."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bytes with A-Z made lower case.
LOWER_BYTES = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())
#: Keys that a join broadcasts at most.
HOT_KEYS = 1000
#: How durable tables are written. Rows may be megabytes long: left alone, a writer holds a hundred of them before it looks at their size, and a reader all rows of a group.
WRITER = {"parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 512, "parquet.block.size": 16 << 20}


def framed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_null_ids: bool = False) -> DataFrame:
    """``doc_id``, ``text`` (null stays null) and ``row``, a struct of the input's own columns.

    Rows without an id are left out, since no result could name them, unless a filter that returns ``row`` asks for them. Extra columns never meet the operators' own names, whatever they are called.
    """
    return docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.col(f"`{text_col}`").cast("string").alias("text"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
    ).where(F.lit(keep_null_ids) | F.col("doc_id").isNotNull())


def unframed(rows: DataFrame, like: DataFrame, **replaced: Column) -> DataFrame:
    """The columns of ``like`` again, out of ``row``; ``replaced`` gives new values for some of them."""
    kinds = dict(like.dtypes)
    return rows.select(*[(replaced[c].cast(kinds[c]) if c in replaced else F.col(f"row.`{c}`")).alias(c) for c in like.columns])


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, every other character kept. Pure ASCII takes the engine's fast path."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        return "file:///tmp/checkpoints"
    raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")


def durable(df: DataFrame, tag: str, codec: str = "zstd", group_rows: int | None = None, batch_bytes: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again.

    Lineage ends there, so a lost executor costs no recomputation of what lies before, and later stages
    read only the columns they need. Shuffle files of the written query are no longer needed. A writer holds about 16 MB
    of compressed rows. For rows of megabytes, ``group_rows`` bounds what a reader takes at once however well they compress, and
    ``batch_bytes`` what goes to a Python worker at once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quantloom/{tag}-{uuid.uuid4().hex}"
    new = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"} | ({"spark.sql.execution.arrow.maxBytesPerBatch": str(batch_bytes)} if batch_bytes else {})
    before = {k: spark.conf.get(k, None) for k in new}
    for k, v in new.items():
        spark.conf.set(k, v)
    try:
        df.write.options(compression=codec, **WRITER, **({"parquet.block.row.count.limit": group_rows} if group_rows else {})).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out._durable_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete durable tables that no later plan reads."""
    for df in tables:
        jvm, path = df.sparkSession._jvm, df._durable_path
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def keyed_join(big: DataFrame, small: DataFrame, on: list[str], rows: str, how: str = "inner") -> DataFrame:
    """``big`` joined (``inner`` or ``left``) with ``small``, a durable table with one row for each key and, in ``rows``, how many rows of ``big`` have it.

    Keys that hold a thousandth or more of these rows, of which there can't be more than a thousand, are broadcast, so no
    task gets a hot one; all others are shuffled, whatever ``small`` takes on disk: the planner would broadcast it by the size of
    its files, which can be a small part of what its rows take in the driver's memory.
    """
    total = small.agg(F.sum(rows)).first()[0] or 0
    hot = (F.col(rows) * HOT_KEYS >= total) & (sum((F.octet_length(c) for c in on if dict(small.dtypes)[c] == "string"), F.lit(0)) <= 4096)
    own = small.drop(rows)
    few = F.broadcast(small.where(hot).drop(rows))
    rest = big.join(F.broadcast(small.where(hot).select(*on)), on, "left_anti")
    others = own if how == "left" else small.where(~hot).drop(rows)
    return big.join(few, on).unionByName(rest.join(others.hint("merge"), on, how))


def release() -> None:
    """Give the memory that a Python worker holds but doesn't use back to the system: it outlives its tasks, and the next may be another stage's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def tidy(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` for ``mapInArrow``, with what it leaves in the worker's memory released at the task's end."""

    @wraps(work)
    def done(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        release()

    return done


def blocks(batches: Iterator[pa.RecordBatch], text: str, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a block holds about ``most_bytes`` of text, or one longer text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        n = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0)).astype(np.int64)
        at = np.cumsum(n)
        start = 0
        while start < len(n):
            base = at[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(at, base + most_bytes, side="right")))
            yield batch.slice(start, end - start)
            start = end


def runs(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[tuple[int, pa.Table]]:
    """(value, rows) for each run of equal values in a sorted column."""
    held: list[pa.RecordBatch] = []
    value = None
    for batch in batches:
        keys = np.asarray(batch.column(by))
        cut = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else []
        for a, b in zip(cut, [*cut[1:], len(keys)], strict=True):
            if held and keys[a] != value:
                yield value, pa.Table.from_batches(held)
                held = []
            value = int(keys[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield value, pa.Table.from_batches(held)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of each of many ranges, one range after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def crc_mod(id_col: Column, modulus: int) -> Column:
    """crc32 of an id as text, modulo ``modulus``."""
    return F.crc32(id_col.cast("string")) % modulus
