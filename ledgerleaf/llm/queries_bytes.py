"""Queries of the operators on bytes and tokens: BPE encoding and decoding, media columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerleaf.llm.bpe import encode_and_decode
from ledgerleaf.llm.media import read_media, store_texts
from ledgerleaf.llm.shared import table


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded with the public byte-level tokenizer, as digests."""
    coded = encode_and_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored in the coefficients of a progressive JPEG and read back, as digests.

    The feature is the image's size and the mean of each colour of its full-resolution tensor, which is stored as a
    column and of which the query shows a digest.
    """
    stored = store_texts(table(spark, sf_dir, "documents"))
    digests = stored.select(F.struct("doc_id", "n_bytes", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256")).alias("stored"), "media")
    read = read_media(digests.select(F.col("stored.doc_id").alias("doc_id"), "media", "stored"), keep=("stored",))
    feature = F.concat_ws("x", "height", "width", F.array_join(F.transform("means", lambda m: F.format_number(m, 4)), ","))
    size = F.octet_length("payload")
    tail = F.substring(F.col("payload"), -64, 64)
    return read.select("doc_id", "stored.n_bytes", size.cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(tail).alias("tail_crc32"), "stored.media_bytes", "stored.media_sha256", feature.alias("feature"), F.sha2("rgb", 256).alias("tensor_sha256"))


QUERIES = {"op6_bpe": op6_bpe, "op9_media_columns": op9_media_columns}
ORACLES: dict = {}
