"""The training-data pipeline: documents in, packed sequences out.

Every stage takes (spark, docs, sf_dir); all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm import decontaminate, language_id, line_dedup, near_text, packing, queries
from quantloom.llm.common import crc_mod, discard, durable, unframed


#: Least cosine with the nearest language that the language stage takes for a language at all: three times the spread that chance gives.
LEAST_SCORE = 3 / language_id.DIM**0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language isn't known go; all others stay as they are.

    Known is what the profiles name with a score of ``LEAST_SCORE`` or more. Null and empty texts, and those without a letter, have no
    language and go. Rows are judged one by one, so rows that repeat an id or have none go or stay each by its own text. If no row
    has a label, there is no profile, and all documents stay.
    """
    prototypes = language_id.train(docs.where(crc_mod(F.col("doc_id"), 4) != 2), F.col("lang"))
    if not prototypes:
        return docs
    known = (F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE)
    return unframed(language_id.identify(docs, prototypes, keep_null_ids=True).where(known), docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from the text, but stay in the smallest id that holds them; ``n_chars`` follows.

    Every document stays, if only with an empty text; so do rows without an id, whose lines count for nobody and stay. A null text
    becomes an empty one. Rows that share an id are one document.
    """
    return unframed(line_dedup.line_dedup(docs, keep_null_ids=True), docs, text=F.col("kept"), n_chars=F.char_length("kept"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that with the smallest id.

    Near copies are found by SimHash and linked where their five-word runs have a similarity of 0.8 or more. A row without an id stays
    only where no near copy has one; of rows alike in id and text one stays; texts without words are copies of each other.
    """
    return near_text.one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with words in a benchmark window go; each row is judged by its own text. Null and empty texts stay."""
    return decontaminate.decontaminate(docs, decontaminate.session_items(spark, sf_dir))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, cut into pieces and packed: as query op8 returns it, so without rows that have no id to return.

    A null or empty text is one piece that holds the end id only; rows that repeat an id are packed each.
    """
    return packing.pack(packing.token_pieces(docs, queries.tokenizer_path(), with_ids=False))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("lines", lines),
    ("near_copies", near_copies),
    ("benchmark", benchmark),
    ("sequences", sequences),
]

#: Language profiles, fingerprints and packing are beyond SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again by the next."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
