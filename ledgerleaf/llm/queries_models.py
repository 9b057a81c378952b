"""Queries of the operators that learn: quality classifier, LM scoring, language ID."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerleaf.llm.language_id import fit_language, identify_languages
from ledgerleaf.llm.lm_scoring import score_texts, train
from ledgerleaf.llm.quality import fit_quality, fold, score_statistics, statistics_table
from ledgerleaf.llm.shared import cut_lineage, table


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    stats = cut_lineage(statistics_table(table(spark, sf_dir, "documents")))
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    scored = score_statistics(stats, fit_quality(stats, labels))
    held_out = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probability and perplexity of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs.where(fold(F.col("doc_id"), 7) != 2))
    held_out = F.coalesce(fold(F.col("doc_id"), 7) == 2, F.lit(False))
    total = F.lit(model.total).cast("long")
    return score_texts(docs, model).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", total.alias("train_tokens"), "base_score", "score", "perplexity")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False))
    return identify_languages(docs, fit_language(docs, evidence=False)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


QUERIES = {"op3_quality_classifier": op3_quality_classifier, "op7_lm_scoring": op7_lm_scoring, "op8_language_id": op8_language_id}
ORACLES: dict = {}
