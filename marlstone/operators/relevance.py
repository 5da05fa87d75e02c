"""Text search: document frequencies and term scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.sources.tables import read


def document_frequency(spark, sf_dir):
    """How many documents hold each lower-case word of ASCII letters."""
    words = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0))).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n_docs"))


_FUNCTIONS = (document_frequency,)
QUERIES = {f.__name__: f for f in _FUNCTIONS}
ORACLES = {
    "document_frequency": "WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents) SELECT word, count(*) AS n_docs FROM w GROUP BY 1",
}
