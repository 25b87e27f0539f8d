"""A corpus from raw documents: five stages, each over all that the one before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from citelens.llm.decontamination import clean_of_benchmark
from citelens.llm.language_id import known_language
from citelens.llm.mixing import mixed_copies
from citelens.llm.ngram_join import one_of_each_group
from citelens.llm.secrets import without_secrets
from citelens.llm.shared import table, written

STAGES = [
    ("language id", known_language),
    ("near duplicates", one_of_each_group),
    ("decontamination", clean_of_benchmark),
    ("secret scan", without_secrets),
    ("mixing", mixed_copies),
]
#: Language ID and secret windows have no SQL form; the tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
