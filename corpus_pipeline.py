"""Training-corpus pipeline: language ID, near-duplicates, repeated passages, benchmark leaks, packing.

Each stage deletes the intermediate tables of the stages before it, whose results are written by then.

A row is a document: no stage joins rows by doc_id, so null and repeated doc_ids neither lose nor multiply rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from marlstone.llm import common, decontam, jaccard, langid, packing, suffix
from marlstone.llm.queries import table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language (null, or without letters) go. Without labels, all with letters stay."""
    common.release(spark)
    profiles = langid.fit(docs.select("doc_id", "text", "lang").where(~langid.held_out()))
    if not profiles:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return langid.predict(docs, profiles).where("lang_pred <> 'und'").drop("lang_pred", "score")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of texts whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more stays.

    It has the smallest doc_id, null last; rows without an id, and unequal rows of one id, are documents of their own.
    """
    common.release(spark)
    return jaccard.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes inside repeated 100-byte strings go; documents left empty go too."""
    common.release(spark)
    others = F.struct(*[c for c in docs.columns if c not in ("text", "n_chars")])
    cleaned = suffix.clean(suffix.find(docs, row=others)).where("text <> ''")
    return cleaned.select("row.*", "text", F.length("text").cast("long").alias("n_chars")).select(docs.columns)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go: each row by its own text."""
    common.release(spark)
    found = decontam.digest(decontam.find(docs, table(spark, sf_dir, "benchmark"), row=F.struct(*docs.columns)))
    return found.where("not contaminated").select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.release(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("benchmark_leaks", benchmark_leaks), ("packing", pack)]

#: SimHash, suffix arrays and tokenizers are beyond SQL; tests/llm compares near_duplicates with brute force and runs the first four stages on odd ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), name)
    common.release(spark)
    return docs
