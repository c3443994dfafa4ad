"""All queries outside tidepool.llm, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidepool.plans import fact_queries, more_queries, queries, scalar_queries, sequence_queries, store_queries
from tidepool.shipping import ensure_importable


def _shipped(run):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        ensure_importable(spark)
        return run(spark, sf_dir)

    query.__name__, query.__doc__ = run.__name__, run.__doc__
    return query


QUERIES = {name: _shipped(run) for name, run in (queries.QUERIES | scalar_queries.QUERIES | more_queries.QUERIES | fact_queries.QUERIES | sequence_queries.QUERIES | store_queries.QUERIES).items()}
ORACLES = queries.ORACLES | scalar_queries.ORACLES | more_queries.ORACLES | fact_queries.ORACLES | sequence_queries.ORACLES | store_queries.ORACLES
