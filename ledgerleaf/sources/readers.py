"""Readers of raw documents, layout documents and stored files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerleaf.operators.documents import NAMES, RAW_SCHEMA
from ledgerleaf.operators.layout import LAYOUT_SCHEMA


def parse_raw_documents(texts: DataFrame, column: str = "raw") -> DataFrame:
    """Add a raw document's columns to rows of its JSON text, which stays; text that doesn't parse gives nulls."""
    parsed = texts.withColumn("_parsed", F.from_json(column, RAW_SCHEMA))
    return parsed.select(*texts.columns, *(F.col("_parsed")[n].alias(n) for n in NAMES))


def read_raw_documents(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Raw documents of JSON files, one a file or one a line, with the original text in ``raw``."""
    texts = spark.read.text(path, wholetext=not lines).withColumnRenamed("value", "raw")
    return parse_raw_documents(texts)


def read_layout_documents(spark: SparkSession, path: str) -> DataFrame:
    """Layout documents of JSON files, one a file."""
    return spark.read.schema(LAYOUT_SCHEMA).option("multiLine", True).json(path)


def read_stored_files(spark: SparkSession, root: str, leading: int = 8) -> DataFrame:
    """storage_key (below ``root``), size, modified_at and the leading bytes of every stored file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    key = F.element_at(F.split(F.col("path"), "/" + base.replace(".", r"\.") + "/", 2), -1)
    return files.select(key.alias("storage_key"), F.col("length").alias("size"), F.col("modificationTime").alias("modified_at"), F.substring("content", 1, leading).alias("content"))
