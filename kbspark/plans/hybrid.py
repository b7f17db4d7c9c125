"""Queries over hybrid retrieval, ranking and context (E)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.operators import context as X
from kbspark.operators import hybrid as H
from kbspark.operators import lexical as L
from kbspark.operators import vectors as V
from kbspark.plans.base import BM25, CORPUS, STOP, corpus, query, questions, table
from kbspark.plans.documents import bm25_top
from kbspark.plans.vectors import COSINE_SQL, collection, query_vectors
from kbspark.sources.shared import shared_folder, written


def vec_hits(spark: SparkSession, d: str, asked: DataFrame | None = None) -> DataFrame:
    """Hits of all query vectors, or of those whose query is in ``asked`` (query_id)."""
    q = query_vectors(spark, d)
    near = V.knn(q if asked is None else q.join(asked.select("query_id"), "query_id", "left_semi"), collection(spark, d), 15)
    return near.select("query_id", F.col("id").alias("chunk_id"), F.round(1 - F.col("distance"), 6).alias("vector_score"))


def lex_hits(spark: SparkSession, d: str) -> DataFrame:
    top = bm25_top(spark, d, 20).select("query_id", "chunk_id", "bm25_score")
    return H.normalise_lexical(top.withColumn("exact_match_bonus", F.lit(None).cast("double")))


def fused(spark: SparkSession, d: str, asked: DataFrame | None = None) -> DataFrame:
    """Query n has the vector of row 20 n and the text of benchmark item n; the two are tied by number only."""
    lex = lex_hits(spark, d).drop("bm25_normalised", "exact_match_bonus")
    hits = H.finalise_scores(H.weighted(vec_hits(spark, d, asked), lex))
    return written(hits, f"{shared_folder(spark)}/hits-{spark.sparkContext.applicationId}")  # some plans read them two or three times


def full_hits(spark: SparkSession, d: str) -> DataFrame:
    """Fused hits of the questions, with the question and the chunk's columns."""
    kind = F.element_at(F.array(*map(F.lit, ("paragraph", "table", "list_item", "heading"))), (F.col("doc_id") % 4 + 1).cast("int"))
    q = questions(spark, d)
    return corpus(spark, d).withColumn("kind", kind).join(fused(spark, d, q), "chunk_id").join(q, "query_id")


def ranked_hits(spark: SparkSession, d: str) -> DataFrame:
    parent = F.when(F.col("chunk_id") % 5 != 0, F.floor(F.col("chunk_id") / 2))
    return H.ranked(full_hits(spark, d)).withColumn("parent_id", parent)


CHAIN = f"""{BM25},
vec AS (SELECT query_id, chunk_id, round(1 - dist, 6) AS vector_score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, chunk_id) AS r FROM (
  SELECT q.vec_id // 20 AS query_id, c.vec_id AS chunk_id, round({COSINE_SQL}, 6) AS dist FROM embeddings q, embeddings c WHERE q.vec_id % 20 = 0)) WHERE r <= 15),
lt AS (SELECT query_id, chunk_id, bm25_score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25_score DESC, chunk_id) AS r FROM bm
  WHERE bm25_score > 0) WHERE r <= 20),
mm AS (SELECT query_id, min(bm25_score) AS lo, max(bm25_score) AS hi FROM lt GROUP BY ALL),
lex AS (SELECT query_id, chunk_id, bm25_score, round(CASE WHEN hi <= 0 THEN 0.0 WHEN hi = lo THEN 1.0 ELSE (bm25_score - lo) / (hi - lo) END, 6) AS lexical_score FROM lt JOIN mm USING (query_id)),
fus AS (SELECT query_id, chunk_id, vector_score, bm25_score, lexical_score, round(0.6 * coalesce(vector_score, 0) + 0.4 * coalesce(lexical_score, 0), 6) AS fusion_score
  FROM vec FULL JOIN lex USING (query_id, chunk_id)),
fin AS (SELECT *, round(CASE WHEN vector_score IS NOT NULL AND lexical_score IS NOT NULL THEN (vector_score * 0.6 + lexical_score * 0.4) / 1.0 ELSE coalesce(vector_score, lexical_score) END, 6) AS retrieval_score,
  fusion_score AS rank_score, CASE WHEN vector_score IS NULL THEN 'bm25' WHEN lexical_score IS NULL THEN 'vector' ELSE 'hybrid' END AS score_source FROM fus),
{CORPUS},
hit AS (SELECT fin.*, b.text AS query, c.doc_id, c.kb_id, c.tenant_id, c.filename, c.text, ['paragraph', 'table', 'list_item', 'heading'][c.doc_id % 4 + 1] AS kind
  FROM fin JOIN benchmark b ON item_id = query_id JOIN corpus c USING (chunk_id)),
rk AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY rank_score DESC, chunk_id))::INTEGER AS pos, CASE WHEN chunk_id % 5 <> 0 THEN chunk_id // 2 END AS parent_id FROM hit)"""


@query("E1", f"""WITH {CHAIN}, s AS (SELECT query_id // 2 AS query_id, query_id AS subquery, chunk_id, vector_score FROM vec)
  SELECT query_id, chunk_id, max(vector_score) AS vector_score, array_to_string(list_sort(list(DISTINCT subquery)), ',') AS retrieval_queries FROM s GROUP BY query_id, chunk_id""")
def merge_subqueries(spark: SparkSession, d: str) -> DataFrame:
    v = vec_hits(spark, d).withColumn("subquery", F.col("query_id")).withColumn("query_id", F.floor(F.col("query_id") / 2))
    return H.merge_subqueries(v, "vector_score").withColumn("retrieval_queries", F.array_join("retrieval_queries", ","))


@query("E2", f"WITH {CHAIN} SELECT query_id, chunk_id, bm25_score, lexical_score FROM lex")
def normalise(spark: SparkSession, d: str) -> DataFrame:
    return lex_hits(spark, d).select("query_id", "chunk_id", "bm25_score", "lexical_score")


@query("E3", f"""WITH {CHAIN}, a AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY vector_score DESC, chunk_id) AS r FROM vec),
  b AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY lexical_score DESC, chunk_id) AS s FROM lex)
  SELECT query_id, chunk_id, round(coalesce(1.0::DOUBLE / (60 + r), 0) + coalesce(1.0::DOUBLE / (60 + s), 0), 6) AS rrf_score FROM a FULL JOIN b USING (query_id, chunk_id)""")
def rrf(spark: SparkSession, d: str) -> DataFrame:
    return H.rrf(vec_hits(spark, d), lex_hits(spark, d)).select("query_id", "chunk_id", "rrf_score")


@query("E4", f"WITH {CHAIN} SELECT query_id, chunk_id, fusion_score FROM fus")
def weighted(spark: SparkSession, d: str) -> DataFrame:
    return H.weighted(vec_hits(spark, d), lex_hits(spark, d)).select("query_id", "chunk_id", "fusion_score")


@query("E5", f"WITH {CHAIN} SELECT query_id, chunk_id, retrieval_score, rank_score, score_source FROM fin")
def finalise(spark: SparkSession, d: str) -> DataFrame:
    return fused(spark, d).select("query_id", "chunk_id", "retrieval_score", "rank_score", "score_source")


@query("E6", rf"""WITH {CHAIN}, b AS (SELECT *, round((CASE WHEN kind IN ('table', 'list_item') THEN 0.14::DOUBLE WHEN kind = 'heading' THEN 0.08 WHEN length(text) > 280 THEN -0.04 ELSE 0 END)
    + CASE WHEN contains(text, '|')::INT + contains(text, chr(10) || '- ')::INT + contains(text, chr(10) || '* ')::INT >= 2 THEN 0.05 ELSE 0 END
    + CASE WHEN len(regexp_extract_all(text, '(?i)(tiktok|instagram|reddit|twitter/x|twitter|x)')) >= 2 THEN 0.18 + CASE WHEN kind = 'list_item' THEN 0.08 ELSE 0 END
      + CASE WHEN len(regexp_extract_all(text, '(?i)(tiktok|instagram|reddit|twitter/x|twitter|x)')) >= 4 THEN 0.12 ELSE 0 END ELSE 0 END, 6) AS boost FROM hit)
  SELECT query_id, chunk_id, CASE WHEN boost = 0 THEN retrieval_score ELSE round(least(1.0, retrieval_score + boost), 6) END AS retrieval_score, round(rank_score + boost, 6) AS rank_score FROM b""")
def structure(spark: SparkSession, d: str) -> DataFrame:
    h = full_hits(spark, d).withColumn("query", F.concat(F.lit("列出 "), "query"))
    return H.structure_boost(h).select("query_id", "chunk_id", "retrieval_score", "rank_score")


E7 = rf"""tm AS (SELECT query_id, list(x ORDER BY i) AS terms FROM (SELECT query_id, x, min(i) AS i FROM (SELECT query_id, unnest(l) AS x, unnest(range(len(l))) AS i FROM (
    SELECT item_id AS query_id, list_filter(regexp_extract_all(lower(text), '[\pL\pN]+'), lambda x: length(x) > 1 AND x NOT IN {STOP}) AS l FROM benchmark)) GROUP BY ALL) GROUP BY ALL),
sp AS (SELECT hit.*, terms, lower(text || chr(10) || filename || chr(10) || doc_id) AS space FROM hit JOIN tm USING (query_id)),
bo AS (SELECT * REPLACE (CASE WHEN m THEN round(least(1.0, retrieval_score + 0.26), 6) ELSE retrieval_score END AS retrieval_score, round(rank_score + CASE WHEN m THEN 0.26 ELSE 0 END, 6) AS rank_score)
  FROM (SELECT *, len(list_filter(terms, lambda x: contains(space, x))) > 0 AS m FROM sp)),
bp AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank_score DESC, chunk_id) AS pos FROM bo),
an AS (SELECT *, min(CASE WHEN len(terms) >= 2 AND regexp_matches(terms[1], '(?i)^([a-z]\d{{1,3}}|[a-z][a-z0-9_.-]{{2,31}})$') AND contains(space, terms[1]) THEN pos END) OVER (PARTITION BY query_id) AS at_,
  max(rank_score) OVER (PARTITION BY query_id) AS top FROM bp),
e7 AS (SELECT query_id, chunk_id, (row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN pos = at_ AND at_ > 1 THEN 0 ELSE 1 END, pos))::INTEGER AS pos,
  CASE WHEN pos = at_ AND at_ > 1 THEN round(rank_score + greatest(0, top - rank_score + 0.01), 6) ELSE rank_score END AS rank_score,
  CASE WHEN pos = at_ AND at_ > 1 THEN round(least(1.0, retrieval_score + least(greatest(0, top - rank_score + 0.01), 0.35)), 6) ELSE retrieval_score END AS retrieval_score FROM an)"""


@query("E7", f"WITH {CHAIN}, {E7} SELECT * FROM e7")
def term_boost(spark: SparkSession, d: str) -> DataFrame:
    return H.term_boost(full_hits(spark, d)).select("query_id", "chunk_id", "pos", "rank_score", "retrieval_score")


def relation_questions(spark: SparkSession, d: str) -> DataFrame:
    w = F.regexp_extract_all(F.lower("query"), F.lit("[a-z]{3,}"), F.lit(0))
    return questions(spark, d).select("query_id", F.concat(w[1], F.lit(" 和 "), w[3], F.lit(" 对比")).alias("query"))


@query("E8", rf"""WITH w AS (SELECT item_id AS query_id, regexp_extract_all(lower(text), '[a-z]{{3,}}') AS w FROM benchmark),
  q AS (SELECT query_id, w[2] || ' 和 ' || w[4] || ' 对比' AS query, list_filter(CASE WHEN w[2] = w[4] THEN [w[2]] ELSE [w[2], w[4]] END, lambda x: x NOT IN {STOP} AND length(x) BETWEEN 3 AND 32) AS a FROM w)
  SELECT query_id, 0 AS pos, query AS subquery, NULL AS support_term FROM q UNION ALL
  SELECT query_id, 1, a[2] || ' 是什么', a[2] FROM q WHERE len(a) >= 2""")
def relation_queries(spark: SparkSession, d: str) -> DataFrame:
    return H.relation_subqueries(relation_questions(spark, d))


@query("E9", f"""WITH {CHAIN}, sg AS (SELECT *, CASE WHEN chunk_id % 6 = 0 THEN rank_score + 0.1 END AS strong FROM rk),
  n AS (SELECT *, CASE WHEN strong IS NOT NULL THEN row_number() OVER (PARTITION BY query_id ORDER BY strong DESC NULLS LAST, pos) END AS n FROM sg)
  SELECT query_id, chunk_id, (row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN n <= 2 THEN n ELSE 1000 END, pos))::INTEGER AS pos FROM n""")
def exact_first(spark: SparkSession, d: str) -> DataFrame:
    h = ranked_hits(spark, d)
    flag = F.col("chunk_id") % 6 == 0
    h = h.withColumns({"query": F.concat(F.lit("x7 "), "query"), "reasons": F.when(flag, F.array(F.lit("identifier:X7"))).otherwise(F.array().cast("array<string>")), "exact_match_bonus": F.when(flag, 0.1)})
    return H.promote_exact(h, 5).select("query_id", "chunk_id", "pos")


@query("E10", f"""WITH {CHAIN}, n AS (SELECT *, min(CASE WHEN chunk_id % 3 = 0 THEN pos END) OVER (PARTITION BY query_id) AS best FROM rk)
  SELECT query_id, chunk_id, (row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN pos = best THEN 0 ELSE 1 END, pos))::INTEGER AS pos FROM n""")
def title_first(spark: SparkSession, d: str) -> DataFrame:
    h = ranked_hits(spark, d).withColumns({"query": F.concat("query", F.lit(" 产品定位")), "is_title": F.col("chunk_id") % 3 == 0})
    return H.promote_title(h).select("query_id", "chunk_id", "pos")


@query("E11", rf"""WITH {CHAIN}, w AS (SELECT item_id AS query_id, regexp_extract_all(lower(text), '[a-z]{{3,}}') AS w FROM benchmark),
  q AS (SELECT query_id, list_filter(CASE WHEN w[2] = w[4] THEN [w[2]] ELSE [w[2], w[4]] END, lambda x: x NOT IN {STOP} AND length(x) BETWEEN 3 AND 32) AS a FROM w),
  g AS (SELECT rk.*, a, list_filter(a, lambda x: contains(lower(text || chr(10) || filename || chr(10) || doc_id), x)) AS got, least(count(*) OVER (PARTITION BY query_id), 3) AS win FROM rk JOIN q USING (query_id)),
  s AS (SELECT *, coalesce(flatten(list(got) FILTER (pos <= win) OVER (PARTITION BY query_id)), []) AS seen FROM g),
  nw AS (SELECT *, CASE WHEN pos > win AND len(a) >= 2 THEN list_filter(got, lambda x: NOT list_contains(seen, x)) ELSE [] END AS new FROM s),
  b AS (SELECT *, first_value(CASE WHEN len(new) > 0 THEN pos END) OVER (PARTITION BY query_id ORDER BY len(new) DESC,
      len(list_filter(new, lambda x: contains(lower(filename), x))) > 0 DESC, rank_score DESC, pos) AS best FROM nw)
  SELECT query_id, chunk_id, (row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN pos = best AND len(new) > 0 THEN CASE WHEN win > 1 THEN 2 ELSE 0 END WHEN pos = 1 THEN 1 ELSE 3 END, pos))::INTEGER AS pos FROM b""")
def relation_cover(spark: SparkSession, d: str) -> DataFrame:
    h = ranked_hits(spark, d).drop("query").join(relation_questions(spark, d), "query_id")
    return H.cover_relations(h).select("query_id", "chunk_id", "pos")


@query("E12", f"WITH {CHAIN} SELECT query_id, chunk_id, retrieval_score FROM fin WHERE retrieval_score >= 0.2")
def threshold(spark: SparkSession, d: str) -> DataFrame:
    return H.threshold(fused(spark, d)).select("query_id", "chunk_id", "retrieval_score")


@query("E13", f"WITH {CHAIN} SELECT query_id, chunk_id FROM hit WHERE doc_id % 3 <> 0")
def ready_only(spark: SparkSession, d: str) -> DataFrame:
    docs = corpus(spark, d).withColumn("status", F.when(F.col("doc_id") % 3 == 0, "processing").otherwise("ready"))
    return H.ready_only(full_hits(spark, d), docs).select("query_id", "chunk_id")


@query("E14", f"""WITH {CHAIN}, r AS (SELECT *, CASE WHEN pos <= 10 AND NOT (query_id % 4 = 0 AND chunk_id % 2 = 0) THEN round(1 / (1 + exp(-((chunk_id * 7 % 13) - 6)::DOUBLE)), 6) END AS s FROM rk),
  k AS (SELECT *, bool_and(s IS NOT NULL OR pos > 10) OVER (PARTITION BY query_id) AS reranked FROM r)
  SELECT query_id, chunk_id, reranked, CASE WHEN reranked THEN s END AS rerank_score, (row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN reranked THEN s END DESC NULLS LAST, pos))::INTEGER AS pos FROM k""")
def rerank(spark: SparkSession, d: str) -> DataFrame:
    logit = F.when(~((F.col("query_id") % 4 == 0) & (F.col("chunk_id") % 2 == 0)), F.col("chunk_id") * 7 % 13 - 6)
    return H.rerank(ranked_hits(spark, d), logit, pool=10).select("query_id", "chunk_id", "reranked", "rerank_score", "pos")


def shared_words(query: str, texts: list[str]) -> list[float]:
    """A deterministic scorer: distinct words of the question that a text holds, less six; long questions are beyond it."""
    asked = set(re.findall("[a-z]+", query.lower()))
    if len(asked) > 35:
        raise ValueError("question too long")
    return [len(asked & set(re.findall("[a-z]+", t.lower()))) - 6.0 for t in texts]


@query("E14_scorer", f"""WITH {CHAIN}, w AS (SELECT *, list_distinct(regexp_extract_all(lower(query), '[a-z]+')) AS a FROM rk),
  r AS (SELECT *, len(a) <= 35 AS reranked, CASE WHEN len(a) <= 35 AND pos <= 10 THEN round(1 / (1 + exp(6.0 - len(list_intersect(a, regexp_extract_all(lower(text), '[a-z]+'))))), 6) END AS rerank_score FROM w)
  SELECT query_id, chunk_id, reranked, rerank_score, (row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC NULLS LAST, pos))::INTEGER AS pos,
    CASE WHEN NOT reranked THEN 'ValueError: question too long' END AS rerank_error FROM r""")
def rerank_by_scorer(spark: SparkSession, d: str) -> DataFrame:
    return H.rerank_requests(ranked_hits(spark, d), shared_words, pool=10).select("query_id", "chunk_id", "reranked", "rerank_score", "pos", "rerank_error")


@query("E15", f"""WITH {CHAIN} SELECT query_id, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id, parent_id ORDER BY pos) AS n FROM rk) WHERE n = 1 OR parent_id IS NULL""")
def one_child(spark: SparkSession, d: str) -> DataFrame:
    return H.one_child_per_parent(ranked_hits(spark, d)).select("query_id", "chunk_id")


@query("E16", f"WITH {CHAIN} SELECT query_id, chunk_id, pos, CASE WHEN contains(query, '列') THEN 40 ELSE 15 END AS vector_k, 20 AS bm25_k FROM rk WHERE pos <= 5")
def final_top(spark: SparkSession, d: str) -> DataFrame:
    return H.top_k(ranked_hits(spark, d), 5).withColumns(H.pool_sizes(5, F.col("query"), False)).select("query_id", "chunk_id", "pos", "vector_k", "bm25_k")


def parent_rows(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("doc_id")
    return table(spark, d, "documents").select(p.alias("parent_id"), F.floor(p / 3).alias("doc_id"), (p % 3).cast("int").alias("parent_index"), "text")


PARENTS = "par AS (SELECT doc_id AS parent_id, doc_id // 3 AS doc_id, (doc_id % 3)::INTEGER AS parent_index, text FROM documents)"
HYDRATED = f"""{PARENTS}, cn AS (SELECT doc_id, count(*) AS parent_count, max(parent_index) AS last FROM par GROUP BY ALL),
  hy AS (SELECT h.query_id, h.chunk_id, h.pos, h.parent_id, coalesce(p.text, h.text) AS text, p.doc_id AS pdoc, parent_index, parent_count, parent_index > 0 AS has_more_before, parent_index < last AS has_more_after, parent_count = 1 AS document_complete
    FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, parent_id ORDER BY pos) AS n FROM rk) WHERE n = 1 OR parent_id IS NULL) h LEFT JOIN par p ON p.parent_id = h.parent_id LEFT JOIN cn ON cn.doc_id = p.doc_id)"""


@query("E17", f"WITH {CHAIN}, {HYDRATED} SELECT query_id, chunk_id, text, parent_count, has_more_before, has_more_after, document_complete FROM hy")
def hydrate(spark: SparkSession, d: str) -> DataFrame:
    h = X.hydrate(ranked_hits(spark, d), parent_rows(spark, d))
    return h.select("query_id", "chunk_id", "text", "parent_count", "has_more_before", "has_more_after", "document_complete")


@query("E18", f"""WITH {CHAIN}, {HYDRATED}, t AS (SELECT * FROM hy WHERE parent_id IS NOT NULL AND pdoc IS NOT NULL AND pos <= 10),
  a AS (SELECT DISTINCT t.query_id, p.parent_id, p.doc_id, p.parent_index, p.text FROM t JOIN par p ON p.doc_id = t.pdoc AND abs(p.parent_index - t.parent_index) <= 1)
  SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.query_id = a.query_id AND t.parent_id = a.parent_id)""")
def expand(spark: SparkSession, d: str) -> DataFrame:
    parents = parent_rows(spark, d)
    hits = X.hydrate(ranked_hits(spark, d), parents).where("pos <= 10").select("query_id", "parent_id")
    return X.expand(hits.join(parents, "parent_id"), parents)


@query("E19", f"""WITH {CHAIN}, u AS (SELECT query_id, chunk_id, 'a' AS kb_id, rank_score FROM fin WHERE chunk_id % 3 <> 0 UNION ALL SELECT query_id, chunk_id, 'b', round(rank_score * 0.9, 8) FROM fin WHERE chunk_id % 2 = 0),
  m AS (SELECT query_id, chunk_id, max(rank_score) AS rank_score, arg_max(kb_id, rank_score) AS kb_id FROM u GROUP BY ALL)
  SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY rank_score DESC, chunk_id))::INTEGER AS pos FROM m""")
def collections(spark: SparkSession, d: str) -> DataFrame:
    f = fused(spark, d).select("query_id", "chunk_id", "rank_score")
    a = f.where("chunk_id % 3 <> 0").withColumn("kb_id", F.lit("a"))
    b = f.where("chunk_id % 2 = 0").withColumn("rank_score", F.round(F.col("rank_score") * 0.9, 8)).withColumn("kb_id", F.lit("b"))
    return H.merge_collections(a, b)


@query("E20", f"""WITH {CHAIN}, r AS (SELECT *, CASE WHEN query_id % 2 = 0 AND chunk_id % 3 = 0 THEN 0.01 * (chunk_id % 10) END AS rr FROM rk),
  g AS (SELECT *, bool_or(rr IS NOT NULL) OVER (PARTITION BY query_id) AS anyr, max(retrieval_score) OVER (PARTITION BY query_id) AS best FROM r)
  SELECT query_id, chunk_id FROM g WHERE CASE WHEN anyr THEN coalesce(rr, retrieval_score) >= 0.05 ELSE best >= 0.35 END""")
def gate(spark: SparkSession, d: str) -> DataFrame:
    rr = F.when((F.col("query_id") % 2 == 0) & (F.col("chunk_id") % 3 == 0), F.round(0.01 * (F.col("chunk_id") % 10), 6))
    return H.relevance_gate(ranked_hits(spark, d).withColumn("rerank_score", rr)).select("query_id", "chunk_id")


@query("E21", f"""WITH {CHAIN}, sc AS (SELECT query_id, max(doc_id) AS doc_id FROM rk WHERE pos <= 3 AND query_id % 2 = 0 GROUP BY query_id UNION ALL SELECT DISTINCT query_id, -1 FROM rk WHERE query_id % 4 = 1),
  i AS (SELECT query_id, chunk_id, TRUE AS scoped FROM rk WHERE EXISTS (SELECT 1 FROM sc WHERE sc.query_id = rk.query_id AND sc.doc_id = rk.doc_id))
  SELECT * FROM i UNION ALL SELECT query_id, chunk_id, FALSE FROM rk WHERE query_id NOT IN (SELECT query_id FROM i)""")
def scoped_retry(spark: SparkSession, d: str) -> DataFrame:
    h = ranked_hits(spark, d)
    even = h.where("query_id % 2 = 0").where("pos <= 3").groupBy("query_id").agg(F.max("doc_id").alias("doc_id"))
    lost = h.where("query_id % 4 = 1").select("query_id", F.lit(-1).cast("long").alias("doc_id")).distinct()
    return X.retry_unscoped(h, even.unionByName(lost)).select("query_id", "chunk_id", "scoped")


@query("E21_scope", r"""WITH c AS (SELECT conv_id AS query_id, max(turn) AS seq FROM conversations GROUP BY ALL)
  SELECT query_id, query_id AS doc_id FROM c JOIN documents ON doc_id = query_id""")
def scope(spark: SparkSession, d: str) -> DataFrame:
    """Each conversation cites its own number and the next; its question names the file of the first."""
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("conversation_id"), F.col("turn").alias("seq"), F.array("conv_id", F.col("conv_id") + 1).alias("doc_ids"))
    docs = corpus(spark, d).select("doc_id", F.concat(F.lit("<"), "filename", F.lit(">")).alias("filename")).withColumn("stem", F.col("filename"))
    q = docs.select(F.col("doc_id").alias("query_id"), F.col("doc_id").alias("conversation_id"), F.concat(F.lit("what says "), "filename").alias("query"))
    return X.scope_plan(q, c, docs)


@query("E22", f"""WITH {CHAIN} SELECT query_id, pos AS index, doc_id, kb_id, filename, chunk_id, retrieval_score AS score FROM rk""")
def sources(spark: SparkSession, d: str) -> DataFrame:
    h = ranked_hits(spark, d).select("query_id", "chunk_id", "doc_id", "pos", "retrieval_score")
    return X.source_list(h, corpus(spark, d))


@query("E23", f"""WITH {CHAIN}, u AS (SELECT query_id, chunk_id, rank_score, FALSE AS is_expansion, 0 AS o FROM fin WHERE chunk_id % 3 <> 0
    UNION ALL SELECT query_id, chunk_id, round(rank_score * 1.1, 6), chunk_id % 4 = 0, 1 FROM fin WHERE chunk_id % 2 = 0),
  m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY rank_score DESC, o) AS n FROM u) WHERE n = 1)
  SELECT query_id, chunk_id, rank_score, is_expansion, (row_number() OVER (PARTITION BY query_id ORDER BY is_expansion DESC, rank_score DESC, chunk_id))::INTEGER AS pos FROM m""")
def rounds(spark: SparkSession, d: str) -> DataFrame:
    f = fused(spark, d).select("query_id", "chunk_id", "rank_score")
    a = f.where("chunk_id % 3 <> 0").withColumn("is_expansion", F.lit(False))
    b = f.where("chunk_id % 2 = 0").withColumn("rank_score", F.round(F.col("rank_score") * 1.1, 6)).withColumn("is_expansion", F.col("chunk_id") % 4 == 0)
    return H.merge_rounds(a, b)


FIT = r"""tk AS (SELECT *, floor(len(regexp_extract_all(text, '[^\s]+')) * 1.2)::INTEGER AS t FROM rk),
us AS (SELECT *, sum(t) OVER (PARTITION BY query_id ORDER BY pos) - t AS used FROM tk),
fi AS (SELECT *, min(CASE WHEN used + t > 1500 THEN pos END) OVER (PARTITION BY query_id) AS fst FROM us),
fit AS (SELECT query_id, chunk_id, pos, kind, coalesce(pos = fst, FALSE) AS truncated, CASE WHEN pos = fst THEN left(text, floor(length(text) * ((1500 - used)::DOUBLE / t))::BIGINT) || '...' ELSE text END AS text
  FROM fi WHERE fst IS NULL OR pos < fst OR (pos = fst AND 1500 - used > 100))"""


@query("E24", f"WITH {CHAIN}, {FIT} SELECT query_id, chunk_id, pos, truncated, text FROM fit")
def budget(spark: SparkSession, d: str) -> DataFrame:
    return X.fit_budget(ranked_hits(spark, d), 2012, 512).select("query_id", "chunk_id", "pos", "truncated", "text")


@query("E25", f"""WITH {CHAIN}, {FIT} SELECT query_id, string_agg('[' || pos || '] [kind=' || kind || '] ' || text, chr(10) || chr(10) ORDER BY pos) AS context FROM fit GROUP BY query_id""")
def render(spark: SparkSession, d: str) -> DataFrame:
    return X.render_context(X.fit_budget(ranked_hits(spark, d), 2012, 512))


@query("E26", """SELECT doc_id, CASE WHEN length(text) > 200 THEN left(text, 88) || chr(10) || '…（本次判定展示已截断，中间内容未展示）…' || chr(10) || right(text, 89) ELSE text END AS preview FROM documents""")
def preview(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.preview(F.col("text"), 200).alias("preview"))


@query("E27", f"""WITH {CHAIN}, u AS (SELECT query_id, 'vector' AS stage, chunk_id, vector_score AS s FROM vec UNION ALL SELECT query_id, 'fused', chunk_id, rank_score FROM fin),
  n AS (SELECT *, row_number() OVER (PARTITION BY query_id, stage ORDER BY s DESC, chunk_id) AS n FROM u)
  SELECT query_id, stage, count(*) AS candidates, string_agg(CASE WHEN n <= 5 THEN chunk_id::VARCHAR END, ',' ORDER BY n) AS top_ids FROM n GROUP BY ALL""")
def trace(spark: SparkSession, d: str) -> DataFrame:
    vec = vec_hits(spark, d).withColumn("rank_score", F.col("vector_score"))
    t = H.stage_trace({"vector": vec, "fused": fused(spark, d)})
    return t.select("query_id", "stage", "candidates", F.array_join(F.transform("top", lambda x: x.chunk_id.cast("string")), ",").alias("top_ids"))
