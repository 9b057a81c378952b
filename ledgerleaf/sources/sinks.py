"""Writers of artifacts and exports."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerleaf.functions.nested import exploded


def write_documents(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    df.write.mode(mode).format(fmt).save(path)


def write_artifacts(normalized: DataFrame, structured: DataFrame, root: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Normalised documents first, so that they stay if writing the structured results fails."""
    write_documents(normalized, f"{root}/normalized", fmt, mode)
    write_documents(structured, f"{root}/structured", fmt, mode)


def published_versions(spark: SparkSession, root: str) -> DataFrame:
    """(version, at) of what has been published under ``root``, by its manifest."""
    return spark.read.schema("version string, at timestamp").parquet(f"{root}/manifest")


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.format("binaryFile").load(path).select("path").limit(0).count()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


def publish_artifacts(normalized: DataFrame, structured: DataFrame, root: str, version: str) -> bool:
    """Write both datasets as one version that readers see as a whole, or not at all.

    Each goes to a folder of the version's own, which a run that broke off leaves behind unseen and the next one
    overwrites; then a row of the manifest, a file committed at once, publishes both. A version that is published
    already stays as it is, so a rerun changes nothing. Returns whether it was published now. One writer at a time.
    """
    spark = normalized.sparkSession
    if not re.fullmatch(r"[A-Za-z0-9._-]+", version):
        raise ValueError("a version is letters, digits, dots, dashes and underscores")
    if _exists(spark, f"{root}/manifest") and not published_versions(spark, root).where(F.col("version") == version).isEmpty():
        return False
    write_artifacts(normalized, structured, f"{root}/versions/{version}", mode="overwrite")
    row = spark.range(1, numPartitions=1).select(F.lit(version).alias("version"), F.current_timestamp().alias("at"))
    row.write.mode("append").parquet(f"{root}/manifest")
    return True


def read_artifacts(spark: SparkSession, root: str, version: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(normalized, structured) of a published version, the latest one unless told."""
    known = published_versions(spark, root) if _exists(spark, f"{root}/manifest") else None
    if known is not None and version is not None:
        known = known.where(F.col("version") == version)
    row = known.orderBy(F.desc("at"), F.desc("version")).first() if known is not None else None
    if row is None:
        raise ValueError(f"nothing is published under {root}" if version is None else f"{version} is not published")
    normalized, structured = (spark.read.parquet(f"{root}/versions/{row.version}/{part}") for part in ("normalized", "structured"))
    return normalized, structured


def flat_items(quotations: DataFrame, *keys: str) -> DataFrame:
    """One row an item, beside the quotation's columns ``keys``."""
    return exploded(quotations, "items", "_at", "_item", *keys).select(*keys, "_item.*")


def export_items(quotations: DataFrame, path: str, *keys: str, fmt: str = "csv", mode: str = "errorifexists") -> None:
    """Quotation items as flat files with a head line."""
    flat_items(quotations, *keys).write.mode(mode).format(fmt).option("header", True).save(path)
