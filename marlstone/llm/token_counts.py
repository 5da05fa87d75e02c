"""Token counts through a digest cache.

The cache is a Parquet table (tokenizer, digest, n_tokens). Texts are joined to it by the SHA-256 of their normalised
content (null becomes empty; nothing else may change, or a lossless tokenizer would count differently) and the digest of
the tokenizer file. Only distinct texts that it lacks are encoded, and their counts are appended.

Null text counts as empty: 0 bytes, 0 tokens. Null and repeated doc_ids each get a row; extra columns are ignored; an empty
table gives no rows and adds nothing to the cache. One writer at a time fills a cache, so that its digests are distinct:
the join needs no aggregate above the cache's shuffle, and a digest that very many rows share is split by the skew join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from marlstone.llm import common, tokens

_CACHE = "tokenizer string, digest binary, n_tokens long"


def open_cache(spark, path: str) -> DataFrame:
    """The cache at path; an empty one is made there if there is none."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        spark.createDataFrame([], _CACHE).write.parquet(path)
    return spark.read.schema(_CACHE).parquet(path)


def fill(docs: DataFrame, cache_path: str, tokenizer: str) -> None:
    """Append the counts of all distinct texts that the cache lacks."""
    spark = docs.sparkSession
    version = tokens.digest(tokenizer)

    def count(batches):
        enc = tokens.encoder(tokenizer)
        for cut in common.gathered(batches, "text"):
            _, ends = enc.encode(common.text_or_empty(cut.column(1)))
            yield pa.RecordBatch.from_arrays([cut.column(0).cast(pa.binary()), pa.array(np.diff(ends).astype(np.int64))], ["digest", "n_tokens"])
        enc.rest()

    text = F.coalesce("text", F.lit(""))
    known = open_cache(spark, cache_path).where(F.col("tokenizer") == version).select("digest")
    missing = docs.select(F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text")).join(known, "digest", "left_anti")
    missing.dropDuplicates(["digest"]).mapInArrow(count, "digest binary, n_tokens long").select(
        F.lit(version).alias("tokenizer"), "digest", "n_tokens"
    ).write.mode("append").parquet(cache_path)


def count(docs: DataFrame, cache_path: str, tokenizer: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row."""
    fill(docs, cache_path, tokenizer)
    text = F.coalesce("text", F.lit(""))
    cache = open_cache(docs.sparkSession, cache_path).where(F.col("tokenizer") == tokens.digest(tokenizer)).select("digest", "n_tokens")
    rows = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.unhex(F.sha2(text, 256)).alias("digest"))
    return rows.join(cache, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
