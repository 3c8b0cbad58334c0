"""A corpus pipeline over documents: quality, near duplicates, secrets, mixing,
packing. Every stage takes (spark, docs, sf_dir), works on all rows that the
stage before it kept, and returns a DataFrame; all but the last return the
columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seqloom.llm import stages
from seqloom.session import drop_written, materialize, read, written

STAGES = [
    ("quality classifier", stages.quality_stage),
    ("n-gram Jaccard join", stages.jaccard_stage),
    ("secret scans", stages.secrets_stage),
    ("mixing to target weights", stages.mixing_stage),
    ("packing", stages.packing_stage),
]

#: SQL can express neither the classifier nor the tokenizer; the tests hold the
#: stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage's result is written and read again, and
    what the stage wrote on its way goes."""
    docs = read(spark, sf_dir, "documents")
    first = written()
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        drop_written([*first, written()[-1]])
    return docs
