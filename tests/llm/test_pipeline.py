"""The corpus pipeline against its stages done plainly, and its edge cases."""

import importlib

from pyspark.sql import functions as F

import corpus_pipeline

from test_near_copies import brute_similar
from test_text_operators import EDGE, brute_items, brute_languages, brute_lines, check_packing, edge


def brute(docs, items):
    """(id, text) pairs that reach the packing stage, of (id, text, lang)."""
    known = brute_languages(docs)
    docs = [(d, t) for d, t, _ in docs if known[d][0] != "und" and known[d][1] >= corpus_pipeline.LEAST_SCORE]
    lines = brute_lines(docs)
    docs = [(d, lines[d][2]) for d, _ in docs]
    least = brute_similar(docs)
    docs = [(d, t) for d, t in docs if least[d] == d]
    hit = {r[0] for r in brute_items(docs, items) if r[-1]}
    return [(d, t) for d, t in docs if d not in hit]


def test_pipeline(spark, sf):
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want, rows = brute(docs, items), corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in rows} == {d for d, _ in want} and 0 < len(want) < len(docs)
    check_packing(rows, want)


def test_stages_keep_the_columns(spark, sf):
    rows = EDGE + [(30, "ზქ წჭ ჟღ", None)]  # letters, but of no language that was learnt
    docs = edge(spark, rows).withColumn("source", F.lit("s")).withColumn("n_chars", F.char_length("text").cast("long"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.dtypes
        docs = corpus_pipeline.durable(stage(spark, docs, sf), "test")
        assert docs.dtypes == columns
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = brute(rows, items)
    assert sorted((r.doc_id, r.text) for r in docs.collect()) == want and 30 not in {d for d, _ in want}


def test_rows_without_an_id_or_with_one_in_common(spark, sf):
    """They pass the filtering stages each by itself; only the packing, which returns ids, leaves out rows that have none."""
    plain = "a plain line of words that nobody else has\n"
    rows = [(d, f"{plain}and number {d} says {' '.join(chr(97 + (d * k) % 26) * 3 for k in range(1, 30))}", "en") for d in range(1, 40)]
    odd = [(None, "a plain line of words that has no id and stays", "en"), (5, "other words that nobody else has in a plain line", "en"), (None, None, None), (6, None, None), (6, "", "en")]
    docs = edge(spark, rows + odd).withColumn("n_chars", F.lit(0).cast("long"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.durable(stage(spark, docs, sf), "test")
        left = [(r.doc_id, r.text) for r in docs.collect()]
        assert (None, odd[0][1]) in left and (5, odd[1][1]) in left, name
    assert all(t for _, t in left)
    assert {r.doc_id for r in corpus_pipeline.sequences(spark, docs, sf).collect()} == {d for d, _ in left} - {None}


def test_language_without_labels_keeps_all(spark, sf):
    docs = spark.createDataFrame([(1, "some words", None), (2, None, None)], "doc_id long, text string, lang string")
    assert corpus_pipeline.language(spark, docs, sf).count() == 2


def test_pipeline_of_nothing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0


def test_entry_without_this_subpackage(monkeypatch):
    import sys

    for name in [m for m in sys.modules if m.startswith("quantloom.llm") or m in ("corpus_pipeline", "__spark_entry__")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "quantloom.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    entry = importlib.import_module("__spark_entry__")
    names = entry.queries()
    assert "panel_flagship" in names and not any(n.startswith("op") or n == "pipeline" for n in names)
    monkeypatch.delitem(sys.modules, "__spark_entry__")

