"""Line deduplication with DataFrame functions only.

Lines are exploded, normalised and hashed; documents are counted for each hash; lines over the threshold
go, except in the smallest document that holds them; what stays is put together by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, durable, framed, keyed_join

#: What is stripped from both ends of a line for its key: blank, and tab to carriage return.
STRIPPED = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    return ascii_lower(F.trim(line, F.lit(STRIPPED)))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 2, min_chars: int = 10, keep_null_ids: bool = False) -> DataFrame:
    """Drop lines whose key is found in ``min_docs`` documents or more, but in the smallest ``doc_id`` keep them.

    Returns ``doc_id, kept, n_lines, n_dropped, row``: ``kept`` is the remaining text and ``row`` the input row.

    * null or empty text: one empty line, nothing dropped, ``kept`` is ``''``
    * keys under ``min_chars`` code points never count
    * a line repeated within its only document stays; rows that share a ``doc_id`` are one document
    * rows without an id are left out; with ``keep_null_ids`` they stay whole, and their lines don't count
    * an empty table gives an empty result; input columns of any name only live in ``row``

    A hot line needs no hot task: its counts are combined before the shuffle, and lines that make up a thousandth of all
    repeated ones or more meet their count by a broadcast of at most a thousand rows.
    """
    rows = framed(docs, id_col, text_col, keep_null_ids).withColumn("text", F.coalesce("text", F.lit("")))
    # the text's hash tells rows of one doc_id apart
    lines = rows.select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keyed = lines.select("doc_id", "th", "pos", line_key(F.col("line")).alias("key")).where((F.char_length("key") >= min_chars) & F.col("doc_id").isNotNull())
    # two chained 64-bit hashes: collisions stay out of reach at any corpus size
    hashed = durable(keyed.select("doc_id", "th", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("\x01"), "key").alias("h2")), "lines")
    times = F.count("*").alias("times")
    if min_docs <= 2:  # two distinct documents hold it if the smallest and the largest id differ
        common = hashed.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), times).where("first < last" if min_docs == 2 else "true")
    else:
        by_doc = hashed.groupBy("h1", "h2", "doc_id").agg(times)
        common = by_doc.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"), F.sum("times").alias("times")).where(F.col("n") >= min_docs)
    common = durable(common.select("h1", "h2", "first", "times"), "common")
    gone = keyed_join(hashed, common, ["h1", "h2"], "times").where("doc_id > first")
    gone = gone.groupBy("doc_id", "th").agg(F.collect_set("pos").alias("gone"))
    # a text crosses the join once, in its row; one that loses nothing is neither split nor put together
    joined = rows.select("doc_id", F.xxhash64("text").alias("th"), "row").join(gone, ["doc_id", "th"], "left")
    joined = joined.select("doc_id", "row", "gone", F.coalesce(F.col(f"row.`{text_col}`").cast("string"), F.lit("")).alias("text"))
    whole = F.col("gone").isNull()
    split = joined.withColumn("lines", F.when(~whole, F.split("text", "\n", -1)))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = F.when(whole, F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col("lines"), i)), "\n"))
    n_lines = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"))) + 1
    n_dropped = F.when(whole, 0).otherwise(F.size("gone"))
    return split.select("doc_id", kept.alias("kept"), n_lines.cast("long").alias("n_lines"), n_dropped.cast("long").alias("n_dropped"), "row")
