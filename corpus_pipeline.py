"""A training corpus from raw documents: quality rules, near-duplicates, secrets, mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each as a Parquet table in
the shared folder and reads it again for the next. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import jaccard_join, mixing, packing, quality_rules, secrets
from tessera.llm.common import read, written

STAGES = [
    ("quality rules", quality_rules.stage),
    ("n-gram Jaccard join", jaccard_join.stage),
    ("secret scans", secrets.stage),
    ("mixing sources to target weights", mixing.stage),
    ("best-fit packing", packing.stage),
]

#: The cube method, the field and the packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents of sf_dir."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
