"""Streams: the row-wise operators as they are, and registering results micro-batch by micro-batch."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerleaf.operators import registry

COMPACTED = 16


def register_results_stream(incoming: DataFrame, documents_path: str, store: str, checkpoint: str) -> StreamingQuery:
    """Register a stream of results (document_id, arrival, payload) and append every outcome to ``store``.

    A micro-batch is judged against what earlier batches registered, so a document gets one result however often it
    is sent. Each batch writes its own folder, replacing it, so a batch that is run again changes nothing. The ids
    registered are kept beside, a folder a batch, and every ``COMPACTED`` batches all of them in one, so a batch reads
    the last of these and at most so many small ones.
    """

    def judge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        documents = spark.read.parquet(documents_path)
        earlier = registered(spark, store, documents, before=number)
        registry.register_results(documents, earlier, batch).write.mode("overwrite").parquet(f"{store}/batch={number}")
        new = spark.read.parquet(f"{store}/batch={number}").where("outcome = 201").select("document_id")
        whole = number % COMPACTED == COMPACTED - 1
        ids = earlier.unionAll(new) if whole else new
        ids.write.mode("overwrite").parquet(f"{store}-ids/kind={'whole' if whole else 'new'}/batch={number}")

    return incoming.writeStream.foreachBatch(judge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def registered(spark: SparkSession, store: str, documents: DataFrame, before: int | None = None) -> DataFrame:
    """document_id of the results that batches (those ``before`` a number) registered."""
    try:
        ids = spark.read.parquet(f"{store}-ids")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return documents.select(F.col("id").alias("document_id")).where("false")
    if before is not None:
        ids = ids.where(F.col("batch") < before)
    last = ids.where("kind = 'whole'").agg(F.max("batch")).first()[0]  # of partition names
    if last is None:
        return ids.select("document_id")
    since = F.when(F.col("kind") == "whole", F.col("batch") == last).otherwise(F.col("batch") > last)
    return ids.where(since).select("document_id")
