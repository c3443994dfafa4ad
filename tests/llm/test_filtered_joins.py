"""Joins that drop rows of documents move few texts, however many rows are dropped."""

import random

import pytest
from pyspark.sql import functions as F

from tidepool.llm import common, exact_dedup, simhash


def shuffled(df):
    """Bytes that the plan of a collected table dealt out."""
    df.collect()
    work, out = [df._jdf.queryExecution().executedPlan()], 0
    while work:
        node = work.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            work.append(node.executedPlan())
            continue
        if kind.endswith("QueryStageExec"):
            work.append(node.plan())
            continue
        if kind == "ShuffleExchangeExec":
            out += node.metrics().apply("dataSize").value()
        work += [node.children().apply(i) for i in range(node.children().size())]
    return out


@pytest.fixture
def nothing_is_small(spark):
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def rows_with(spark, changed):
    """600 texts of 100 words, and one copy of every thirtieth of them with words added."""
    rng = random.Random(5)
    texts = [" ".join(f"{rng.getrandbits(40):x}" for _ in range(100)) for _ in range(600)]
    rows = [*enumerate(texts), *((1000 + i, texts[i] + changed) for i in range(0, 600, 30))]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3), sum(len(t) for t in texts)


@pytest.mark.parametrize("drop, changed", [(exact_dedup.deduplicate, ""), (simhash.drop_similar, " and more")])
def test_rows_that_nothing_drops_stay_where_they_are(nothing_is_small, drop, changed):
    docs, size = rows_with(nothing_is_small, changed)
    docs = common.materialize(docs, "filtered")
    kept = drop(docs)
    assert shuffled(kept) < size / 4
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(600))


def test_the_filter_loses_no_row(spark, monkeypatch):
    rows = spark.range(20_000).select(F.when(F.col("id") > 0, F.col("id") - 10_000).alias("filter_word"), F.lit("x").alias("filter_bits"))
    for keys, most in ((rows.where("filter_word % 7 = 0 or filter_word is null"), common.FILTER_WORDS), (rows.where("false"), 8), (rows, 4)):
        monkeypatch.setattr(common, "FILTER_WORDS", most)
        keys = keys.select("filter_word")
        met, others = common.met_and_others(rows, rows["filter_word"], keys)
        met, others, wanted = ({r[0] for r in t.collect()} for t in (met, others, keys))
        assert wanted <= met and not met & others and len(met) + len(others) == 20_000
        assert most < 100 or len(met) < 1.1 * len(wanted)
