"""Rows without an id, and nulls in every column, leave no operator behind."""

from pyspark.sql import functions as F

from quantloom.llm import ann, decontaminate, language_id, line_dedup, packing, queries, simhash, suffix_dedup, toxicity, training_order, url_filter

ROWS = [(None, "a line that nobody can name", "en"), (1, "a line that nobody can name", "en"), (2, None, None), (None, None, None), (3, "a line that nobody can name", None)]


def test_rows_without_an_id_are_left_out(spark, tmp_path):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    items = spark.createDataFrame([(None, "line that"), (1, None), (2, "nobody can")], "item_id long, text string")
    labels = spark.createDataFrame([(None, 1), (1, None), (3, 0)], "doc_id long, label int")
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    assert ids(line_dedup.line_dedup(docs)) == [1, 2, 3]
    assert {r.doc_id: r.n_dropped for r in line_dedup.line_dedup(docs).collect()} == {1: 0, 2: 0, 3: 1}
    assert ids(suffix_dedup.suffix_dedup(docs, length=10)) == [1, 2, 3]
    assert {r.doc_id: r.component_id for r in simhash.simhash_groups(docs).collect()} == {1: 1, 2: 2, 3: 1}
    assert {r.doc_id: r.items for r in decontaminate.find_items(docs, items).collect()} == {1: [2], 2: [], 3: [2]}
    assert ids(packing.pack_documents(docs, queries.tokenizer_path())) == [1, 2, 3]
    written, _ = training_order.materialise(docs, queries.tokenizer_path("byte_bpe_50k.tiktoken"), f"file://{tmp_path}/o")
    assert ids(written) == [1, 2, 3]
    assert ids(language_id.identify(docs, language_id.train(docs, F.col("lang")))) == [1, 2, 3]
    assert ids(toxicity.score(docs, toxicity.fit(docs, labels))) == [1, 2, 3]
    pages = spark.createDataFrame([(None, "http://a.com/"), (1, None), (1, "http://a.com/"), (1, "http://a.com/")], "page_id long, url string")
    rules = spark.createDataFrame([(None, "/", "block"), ("a.com", "/", None), ("com", None, "block")], "host string, path string, verdict string")
    assert url_filter.url_filter(pages, rules).count() == 4
    vectors = spark.createDataFrame([(None, [1.0, 2.0]), (20, None), (40, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert ann.search(vectors, F.col("vec_id") % 20 == 0).count() == 0
