"""Queries over vector collections (D)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.operators import vectors as V
from kbspark.plans.base import query, table


def collection(spark: SparkSession, d: str) -> DataFrame:
    label = F.col("label").cast("string")
    meta = F.create_map(F.lit("label"), label, F.lit("parity"), (F.col("vec_id") % 2).cast("string"))
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("text"), meta.alias("metadata"))


def query_vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").where("vec_id % 20 = 0").select((F.col("vec_id") / 20).cast("long").alias("query_id"), "embedding")


def _knn_sql(expr: str, condition: str = "", limit: str = "", k: int = 5) -> str:
    return f"""WITH p AS (SELECT q.vec_id // 20 AS query_id, c.vec_id AS id, round({expr}, 6) AS distance
    FROM embeddings q, embeddings c WHERE q.vec_id % 20 = 0 {condition})
  SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY distance, id))::INTEGER AS rank FROM p {limit}) WHERE rank <= {k}"""


_A, _B = "q.embedding::DOUBLE[]", "c.embedding::DOUBLE[]"
COSINE_SQL = f"1 - list_inner_product({_A}, {_B}) / sqrt(list_inner_product({_A}, {_A}) * list_inner_product({_B}, {_B}))"


@query("D1", """SELECT vec_id AS id, label FROM embeddings WHERE vec_id % 5 <> 0 UNION ALL SELECT vec_id, -1 FROM embeddings WHERE vec_id % 5 = 0
  UNION ALL SELECT vec_id + 1000000, -1 FROM embeddings WHERE vec_id % 5 = 0""")
def upsert(spark: SparkSession, d: str) -> DataFrame:
    base = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    some = base.where("id % 5 = 0")
    batch = some.select("id", F.lit(-1).alias("label")).unionByName(some.select((F.col("id") + 1000000).alias("id"), F.lit(-1).alias("label")))
    return V.upsert(base, batch)


@query("D2", _knn_sql(COSINE_SQL, limit="WHERE distance <= 0.9"))
def knn(spark: SparkSession, d: str) -> DataFrame:
    return V.knn(query_vectors(spark, d), collection(spark, d), 5, "cosine", max_distance=0.9)


@query("D2_l2", _knn_sql(f"list_sum(list_transform(list_zip({_A}, {_B}), lambda z: (z[1] - z[2]) ** 2))"))
def knn_l2(spark: SparkSession, d: str) -> DataFrame:
    return V.knn(query_vectors(spark, d), collection(spark, d), 5, "l2")


@query("D2_ip", _knn_sql(f"1 - list_inner_product({_A}, {_B})"))
def knn_ip(spark: SparkSession, d: str) -> DataFrame:
    return V.knn(query_vectors(spark, d), collection(spark, d), 5, "ip")


@query("D3", _knn_sql(COSINE_SQL, "AND c.label IN (1, 2, 3) AND (c.vec_id % 2 = 0 OR c.label = 3)"))
def filtered_knn(spark: SparkSession, d: str) -> DataFrame:
    cond = V.where({"$and": [{"label": {"$in": ["1", "2", "3"]}}, {"$or": [{"parity": "0"}, {"label": {"$eq": "3"}}]}]})
    return V.knn(query_vectors(spark, d), collection(spark, d), 5, "cosine", cond)


@query("D4", """SELECT b.item_id AS request_id, x.pos::INTEGER AS pos, e.vec_id AS id, e.label FROM benchmark b, (VALUES (0), (1), (2)) x(pos), embeddings e
  WHERE e.vec_id = CASE x.pos WHEN 0 THEN b.item_id * 3 WHEN 1 THEN b.item_id + 100000000 ELSE b.item_id END""")
def fetch(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("item_id")
    requests = table(spark, d, "benchmark").select(i.alias("request_id"), F.array(i * 3, i + 100000000, i).alias("ids"))
    coll = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return V.fetch(coll, requests).select("request_id", "pos", "id", "label")


@query("D5", "SELECT vec_id AS id FROM embeddings WHERE NOT (vec_id % 7 = 0 AND label = 1)")
def delete(spark: SparkSession, d: str) -> DataFrame:
    coll = collection(spark, d)
    return V.delete(coll, coll.where("id % 7 = 0"), V.where({"label": "1"})).select("id")


@query("D6", """SELECT vec_id AS id, 'v' || vec_id AS text, CASE WHEN vec_id % 4 = 0 THEN 'patched' ELSE label::VARCHAR END AS label,
  (vec_id % 2)::VARCHAR AS parity, CASE WHEN vec_id % 4 = 0 THEN 'x' END AS extra FROM embeddings""")
def patch(spark: SparkSession, d: str) -> DataFrame:
    coll = collection(spark, d)
    patches = coll.where("id % 4 = 0").select("id", F.create_map(F.lit("label"), F.lit("patched"), F.lit("extra"), F.lit("x")).alias("metadata"))
    m = F.col("metadata")
    return V.patch(coll, patches).select("id", "text", m["label"].alias("label"), m["parity"].alias("parity"), m["extra"].alias("extra"))


@query("D7", """SELECT vec_id AS id, CASE WHEN vec_id % 5 = 1 OR vec_id % 5 = 4 THEN 'text_or_vector' WHEN vec_id % 5 = 2 THEN 'dimension' WHEN vec_id % 5 = 3 THEN 'not_finite' END AS reason FROM embeddings""")
def validate(spark: SparkSession, d: str) -> DataFrame:
    r, e = F.col("vec_id") % 5, F.col("embedding")
    vec = F.when(r == 4, None).when(r == 2, F.slice(e, 1, 3)).when(r == 3, F.transform(e, lambda x, i: F.when(i == 0, F.lit(float("nan")).cast("float")).otherwise(x))).otherwise(e)
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), vec.alias("embedding"), F.when(r == 1, F.lit("t")).alias("text"))
    return V.validate_vectors(rows, 64).select("id", "reason")


LETTERS = "abcdefghijklmnopqrstuvwxyz"


def letter_shares(texts: list[str]) -> list[list[float]]:
    """A function for the embedding job: counts of the 26 letters, to length one."""
    out = []
    for t in texts:
        n = [float(t.count(c) + t.count(c.upper())) for c in LETTERS]
        length = math.sqrt(sum(x * x for x in n)) or 1.0
        out.append([x / length for x in n])
    return out


@query("D8", f"""WITH n AS (SELECT doc_id AS id, [{", ".join(f"(length(text) - length(replace(replace(text, '{c}', ''), '{c.upper()}', '')))::DOUBLE" for c in LETTERS)}] AS n FROM documents),
  v AS (SELECT id, n, sqrt(list_sum(list_transform(n, lambda x: x * x))) AS s FROM n)
  SELECT id, len(n)::INTEGER AS dimension, unnest(range(26))::INTEGER AS pos, round(unnest(list_transform(n, lambda x: CASE WHEN s = 0 THEN 0.0::DOUBLE ELSE x / s END::FLOAT::DOUBLE)), 5) AS x FROM v""")
def embed(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    out = V.embed(docs, letter_shares, len(LETTERS))
    return out.select("id", F.size("embedding").alias("dimension"), F.posexplode("embedding").alias("pos", "x")).withColumn("x", F.round(F.col("x").cast("double"), 5))


@query("D9", """SELECT count(*) AS rows, count(DISTINCT label) AS documents, round(count(*)::DOUBLE / count(DISTINCT label), 6) AS chunks_per_document,
  max(len(embedding))::INTEGER AS dimension FROM embeddings""")
def stats(spark: SparkSession, d: str) -> DataFrame:
    return V.collection_stats(collection(spark, d), F.col("metadata")["label"])
