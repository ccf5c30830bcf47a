"""A corpus pipeline: rules, near duplicates, benchmark passages, personal data, segmentation.

Every stage takes (spark, docs, sf_dir) and works on all documents its predecessor kept. Each result is written to the
shared folder and read again, so a lost executor repeats one stage's tasks at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import decontaminate, ngram_join, pii, quality_rules, sp_sampling
from lectern.llm._common import documents, forget, keep, table
from lectern.llm.queries import ALPHA, SAMPLES, SURROGATE_KEY


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each linked group."""
    return ngram_join.keep_one(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontaminate.drop_leaky(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced; n_chars follows the text."""
    done, (found, _) = pii.replaced(docs, SURROGATE_KEY), pii.report_names(docs)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col(found) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return done.select(*docs.columns)


def segmentation(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled piece ids of every text."""
    return sp_sampling.sample(docs, k=SAMPLES, alpha=ALPHA, carry=("lang", "source"))


STAGES = [
    ("quality_rules", rules),
    ("ngram_join", near_duplicates),
    ("decontamination", benchmark_passages),
    ("pii", personal_data),
    ("sentencepiece", segmentation),
]
#: Bitmap joins, edit distances and lattice sampling have no SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        before, docs = docs, keep(stage(spark, docs, sf_dir), name)
        forget(before)  # a written stage needs its predecessor no more
    return STAGES[-1][1](spark, docs, sf_dir)
