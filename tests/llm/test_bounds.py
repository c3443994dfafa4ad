"""Bounds on what tasks hold at once, and on what may be left out: nothing."""

import corpus_pipeline


def test_stages_bound_arrow_batches(spark):
    was = spark.conf.get(corpus_pipeline.BATCH_KEY)
    docs = spark.createDataFrame([(1, "token = abcdefghij", 18), (2, None, None)], "doc_id long, text string, n_chars long")
    for own, then in ((10_000, corpus_pipeline.BATCH_ROWS), (0, corpus_pipeline.BATCH_ROWS), (7, 7)):
        spark.conf.set(corpus_pipeline.BATCH_KEY, own)
        got = corpus_pipeline.redact_secrets(spark, docs, "").collect()
        assert sorted(map(tuple, got)) == [(1, "[SECRET]", 8), (2, None, None)]
        assert int(spark.conf.get(corpus_pipeline.BATCH_KEY)) == then
    spark.conf.set(corpus_pipeline.BATCH_KEY, was)


def test_every_trusted_row_counts(spark):
    from tidepool.llm import rules

    marks = spark.range(250_000).selectExpr("id AS doc_id", "1 AS quality")
    assert rules.trusted_rows(marks).count() == 250_000
