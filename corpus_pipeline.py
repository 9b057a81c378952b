"""A corpus pipeline of five stages: documents of poor quality, of no known language, copies and benchmark leaks go;
what stays is tokenised.

Each stage takes (spark, docs, sf_dir) and works on whole texts of all that its predecessor kept. All but the last
return the columns of ``documents``. A null text is an empty one throughout. Rows with a null doc_id are never learnt
from and are no copies; otherwise they are treated like any other.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerleaf.llm.bpe import encode_and_decode
from ledgerleaf.llm.contamination import drop_contaminated
from ledgerleaf.llm.language_id import fit_language, keep_known_languages
from ledgerleaf.llm.ngram_join import keep_one_of_each_group
from ledgerleaf.llm.quality import fit_quality, keep_good_documents, statistics_table
from ledgerleaf.llm.shared import bounded_batches, table, written

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on these documents' labels, scores 0.3 or more."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return keep_good_documents(docs, fit_quality(statistics_table(docs), labels), 0.3)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters that the language model, fitted on these documents, puts into a language it learnt."""
    bounded_batches(spark)
    return keep_known_languages(docs, fit_language(docs))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group linked by a five-word shingle similarity of 0.8 or more."""
    return keep_one_of_each_group(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs within its edit budget."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, the ids, and whether they decode to the very text."""
    bounded_batches(spark)
    coded = encode_and_decode(docs, TOKENIZER, keep=("lang", "source", "text"))
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("lossless"))


STAGES = [
    ("quality classifier", good_quality),
    ("language ID", known_language),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", without_benchmark),
    ("BPE encoding and decoding", tokenised),
]

#: SQL can express neither the classifiers nor the tokenizer; a brute-force version is in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
