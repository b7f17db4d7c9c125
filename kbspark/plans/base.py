"""The registry of named queries with their oracle SQL, and the derived tables they share.

Mapping of the given tables: corpus = documents (kb_id := source, tenant := lang, file name from
source and id), queries = benchmark, vectors = embeddings, messages = conversations, streams =
events, job, status and generation tables = orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``, with the DuckDB SQL that gives the same rows."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as chunks: chunk_id, doc_id, kb_id, tenant_id, filename, text."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("chunk_id"), "doc_id", F.col("source").alias("kb_id"), F.col("lang").alias("tenant_id"),
        F.concat("source", F.lit("-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"), "text",
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


CORPUS = "corpus AS (SELECT doc_id AS chunk_id, doc_id, source AS kb_id, lang AS tenant_id, source || '-' || doc_id || '.txt' AS filename, text FROM documents)"
STOP = "('is','the','a','an','and','or','of','to','in','for','on','at','by','with','from','as','into','this','that')"
#: BM25 hits (query_id, chunk_id, bm25_score) of every benchmark item over documents.
BM25 = f"""
tok AS MATERIALIZED (SELECT doc_id AS chunk_id, unnest(regexp_extract_all(lower(text), '[\\pL\\pN]+')) AS token FROM documents),
post AS MATERIALIZED (SELECT chunk_id, token, count(*) AS tf FROM tok WHERE token NOT IN {STOP} GROUP BY ALL),
dl AS MATERIALIZED (SELECT chunk_id, sum(tf)::DOUBLE AS dl FROM post GROUP BY ALL),
st AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(tf) FROM post) / (SELECT count(*) FROM documents) AS avgdl),
raw AS MATERIALIZED (SELECT token, count(*) AS df, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM post, st GROUP BY token, n),
term AS MATERIALIZED (SELECT token, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
qt AS (SELECT query_id, token, count(*) AS qtf FROM (
  SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\\pL\\pN]+')) AS token FROM benchmark) WHERE token NOT IN {STOP} GROUP BY ALL),
bm AS (SELECT query_id, chunk_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS bm25_score
  FROM qt JOIN term USING (token) JOIN post USING (token) JOIN dl USING (chunk_id), st GROUP BY ALL)"""


# --- folds in DuckDB SQL: lists whose last element is what is being filled ('' for nothing)

def fold_sql(items: str, step: str) -> str:
    """SQL of a fold over a list of strings: ``step`` makes a new list of ``acc`` and the string ``x[1]``."""
    return f"list_reduce(list_prepend([''], list_transform({items}, lambda y: [y])), lambda acc, x: {step})"


CUR, DONE = "acc[len(acc)]", "acc[1:len(acc) - 1]"
FLUSHED = f"(CASE WHEN {CUR} = '' THEN {DONE} ELSE acc END)"


def closed_sql(folded: str) -> str:
    """A folded list without an empty last element."""
    return f"list_transform([{folded}], lambda z: CASE WHEN z[len(z)] = '' THEN z[1:len(z) - 1] ELSE z END)[1]"
