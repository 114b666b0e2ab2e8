"""The training-text pipeline: run(spark, sf_dir) applies STAGES to `documents`.

Each stage takes (spark, docs, sf_dir); what it returns is written as Parquet to the
cluster's shared folder and read again as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from assaylake.llm.common import store, table
from assaylake.llm.queries import STAGES

# Language filters, patience diff, SimHash and n-best search have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir))
    return docs
