"""Queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, langid, license_scan, ngram_join, oracles, pii, quality_classifier, quality_rules, sharding, sp_sampling, token_counts
from ._common import documents, id_mod, keep, scratch, table

#: The key of surrogates in these queries; real corpora pass a secret one.
SURROGATE_KEY = "corpus-surrogates/1"
#: Distinct segmentations of each text, and the sharpness of their distribution.
SAMPLES, ALPHA = 2, 0.5


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after a load of all documents, the same load sent again, and the deletion of all repeated texts."""
    counted = keep(token_counts.count_tokens(documents(spark, sf_dir)), "token-counts")
    rollup = token_counts.Rollup(spark, scratch(spark, "rollup"))
    rollup.commit("load", token_counts.signed(counted, 1))
    rollup.commit("load", token_counts.signed(counted, 1))
    rollup.commit("one-of-each-text", token_counts.revised(counted, token_counts.firsts(counted)))
    return rollup.totals()


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.verdicts(documents(spark, sf_dir))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp_sampling.sample(documents(spark, sf_dir), k=SAMPLES, alpha=ALPHA)


def held_out(divisor: int, rest: int) -> Column:
    return F.coalesce(id_mod(F.col("doc_id"), divisor) == rest, F.lit(False))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    languages, model = langid.train(langid.sample_counts(docs, ~held_out(4, 2)))
    return langid.identify(docs, languages, model).select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(documents(spark, sf_dir))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    net, prior = quality_classifier.train(docs, table(spark, sf_dir, "labels"), ~held_out(3, 1))
    scored = quality_classifier.score(docs, net, prior)
    return scored.select("doc_id", held_out(3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.histogram_sort(documents(spark, sf_dir), shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replaced(documents(spark, sf_dir).select("doc_id", "text"), SURROGATE_KEY)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_decontamination, op3_quality_rules, op4_sentencepiece, op5_language_id,
        op6_license_scan, op7_ngram_join, op8_quality_classifier, op9_sharding, op10_pii,
    )
}

#: The other six hold tokenizers, edit distances, lattices, trained models or keyed hashes, which SQL does not express.
ORACLE_SQL = oracles.ORACLE_SQL
