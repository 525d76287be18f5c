"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

1. language ID: documents whose language can't be told go;
2. SimHash near-dedup: one row of each group of near-duplicates stays, the first by doc_id (null ones last) and text;
3. benchmark decontamination: benchmark passages are cut out, documents that hold nothing else go;
4. secret scans: secrets are masked in the text;
5. packing: every document that is left gets its length bucket, batch and place.

All stages but the last return the columns of ``documents``. Stages 1 to 4 leave the row of a document that they have nothing
against as it is. SQL can't express the suffix automata, the connected components or the Markov models, so there is no SQL
for the whole; the tests hold it against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sluice.llm import decontaminate, language, packing, secrets, simhash
from sluice.llm.common import read, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_identified(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, nameless=True)


def remove_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove(docs, read(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs, secrets.train(secrets.samples(spark)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.report(docs)


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", deduplicate),
    ("benchmark decontamination", remove_benchmarks),
    ("secret scans", mask_secrets),
    ("packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed rows of all stages applied to ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
