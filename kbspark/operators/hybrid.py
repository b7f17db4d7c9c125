"""Hybrid retrieval and ranking.

Hits are rows (query_id, chunk_id, score columns, text and metadata columns); an absent score is
null, not zero.  Every ordering ends with chunk_id, so results do not depend on row order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kbspark.functions.text import query_terms

KEY = ["query_id", "chunk_id"]
#: Patterns and phrases of question forms (fixed values).
LIST_QUERY = "(哪些|列出|罗列|支持哪些|适配|有哪些|分别|清单|列表|表格|字段|包含)"
CHANNELS, CHANNEL_FIELD, CHANNEL_SECTION = ("distribution_channels", "channel_drafts[]"), "渠道|适配|平台", "渠道适配|分发渠道"
MARKERS = ("|", "、", "；", "\n- ", "\n* ")
PLATFORM = "(?i)(tiktok|instagram|reddit|twitter/x|twitter|x)"
RELATION = "关系|关联|联系|区别|不同|差异|对比|比较"
RELATION_QUERY = f"((和|与|跟|及|以及).*({RELATION}))|(({RELATION}).*(和|与|跟|及|以及))"
RELATION_STOP = ["关系", "关联", "联系", "区别", "不同", "差异", "对比", "比较"]
ANCHOR = r"(?i)^(?:[a-z]\d{1,3}|[a-z][a-z0-9_.-]{2,31})$|^[一-鿿]{2,8}$"
DEFINITION_QUERY = "产品定位|目标用户|核心能力"
HARD_PHRASES = ("目标用户", "产品定位", "核心用户", "核心能力", "字段契约", "规则资产", "批量私信", "自动建联", "不包含", "不做")


def _order(*columns: Column) -> Window:
    return Window.partitionBy("query_id").orderBy(*columns, "chunk_id")


def ranked(hits: DataFrame, by: str = "rank_score") -> DataFrame:
    """``hits`` with pos, from 1, by ``by`` descending."""
    return hits.withColumn("pos", F.row_number().over(_order(F.desc(by))))


def merge_subqueries(hits: DataFrame, score: str) -> DataFrame:
    """Rows (query_id, subquery, chunk_id, score) -> best score per (query_id, chunk_id) and retrieval_queries, sorted."""
    return hits.groupBy(*KEY).agg(F.max(score).alias(score), F.sort_array(F.collect_set("subquery")).alias("retrieval_queries"))


def normalise_lexical(hits: DataFrame) -> DataFrame:
    """Plus bm25_normalised (min-max per query; largest <= 0: 0; all equal: 1) and lexical_score (plus bonus, at most 1)."""
    w = Window.partitionBy("query_id")
    h = hits.withColumns({"hi_": F.max(F.coalesce("bm25_score", F.lit(0.0))).over(w), "lo_": F.min(F.coalesce("bm25_score", F.lit(0.0))).over(w)})
    n = F.when(F.col("hi_") <= 0, 0.0).when(F.col("hi_") == F.col("lo_"), 1.0).otherwise((F.coalesce("bm25_score", F.lit(0.0)) - F.col("lo_")) / (F.col("hi_") - F.col("lo_")))
    h = h.withColumn("bm25_normalised", F.round(n, 6))
    return h.withColumn("lexical_score", F.least(F.lit(1.0), F.col("bm25_normalised") + F.coalesce("exact_match_bonus", F.lit(0.0)))).drop("hi_", "lo_")


def _both(vec: DataFrame, lex: DataFrame) -> DataFrame:
    """Full outer union of two hit lists; a column of both comes from the vector side where it is there."""
    shared = [c for c in lex.columns if c in vec.columns and c not in KEY]
    b = lex.select(*[F.col(c).alias(c + "__") if c in shared else F.col(c) for c in lex.columns])
    j = vec.join(b, KEY, "full")
    return reduce(lambda d, c: d.withColumn(c, F.coalesce(c, c + "__")).drop(c + "__"), shared, j)


def rrf(vec: DataFrame, lex: DataFrame, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion: rrf_score = sum of 1 / (k + rank), ranks from 1 per list."""
    v = vec.withColumn("vr_", F.row_number().over(_order(F.desc("vector_score"))))
    x = lex.withColumn("lr_", F.row_number().over(_order(F.desc("lexical_score"))))
    score = F.coalesce(1 / (k + F.col("vr_")), F.lit(0.0)) + F.coalesce(1 / (k + F.col("lr_")), F.lit(0.0))
    return _both(v, x).withColumn("rrf_score", F.round(score, 6)).drop("vr_", "lr_")


def weighted(vec: DataFrame, lex: DataFrame, wv: float = 0.6, wl: float = 0.4) -> DataFrame:
    """fusion_score = wv * vector_score + wl * lexical_score, an absent side counting 0."""
    score = wv * F.coalesce("vector_score", F.lit(0.0)) + wl * F.coalesce("lexical_score", F.lit(0.0))
    return _both(vec, lex).withColumn("fusion_score", F.round(score, 6))


def finalise_scores(hits: DataFrame, wv: float = 0.6, wl: float = 0.4) -> DataFrame:
    """Plus retrieval_score (weighted mean of both sides, or the one there is), rank_score and score_source."""
    have = lambda *cs: [F.col(c) for c in cs if c in hits.columns]
    v, x = F.col("vector_score"), F.col("lexical_score")
    total = max(wv + wl, 1e-10)
    first = lambda *cs: F.coalesce(*have(*cs), F.lit(0.0))
    retrieval = F.when(v.isNotNull() & x.isNotNull(), (v * wv + x * wl) / total).otherwise(F.coalesce(v, x, first("fusion_score", "rrf_score", "score", "bm25_score")))
    source = F.when(v.isNotNull() & x.isNotNull(), "hybrid").when(v.isNotNull(), "vector").when(x.isNotNull(), "bm25").otherwise("unknown")
    return hits.withColumns({
        "retrieval_score": F.round(retrieval, 6),
        "rank_score": F.round(first("fusion_score", "rrf_score", "bm25_rank_score", "vector_score", "bm25_score", "score"), 6),
        "score_source": source,
    })


def _boosted(hits: DataFrame, boost: Column) -> DataFrame:
    b = F.round(boost, 6)
    return hits.withColumn("boost_", b).withColumns({
        "retrieval_score": F.when(F.col("boost_") == 0, F.col("retrieval_score")).otherwise(F.round(F.least(F.lit(1.0), F.col("retrieval_score") + F.col("boost_")), 6)),
        "rank_score": F.round(F.col("rank_score") + F.col("boost_"), 6),
    }).drop("boost_")


def structure_boost(hits: DataFrame) -> DataFrame:
    """For list questions: by kind, structural markers, platform mentions and fields that hold query terms."""
    q = F.lower(F.trim("query"))
    terms = F.filter(F.regexp_extract_all(q, F.lit("[一-鿿A-Za-z0-9_]+"), F.lit(0)), lambda t: F.length(t) > 1)
    text = F.coalesce("text", F.lit(""))
    kind = F.lower(F.coalesce("kind", F.lit("")))
    platforms = F.regexp_count(text, F.lit(PLATFORM))
    markers = sum((F.contains(text, F.lit(m)).cast("int") for m in MARKERS), F.lit(0))
    boost = F.when(kind.isin("table", "list_item"), 0.14).when(kind.isin("heading", "title"), 0.08).when((kind == "paragraph") & (F.length(text) > 280), -0.04).otherwise(0.0)
    boost = boost + F.when(markers >= 2, 0.05).otherwise(0.0)
    boost = boost + F.when(platforms >= 2, F.lit(0.18) + F.when(kind == "list_item", 0.08).otherwise(0.0) + F.when(platforms >= 4, 0.12).otherwise(0.0)).otherwise(0.0)
    channel = reduce(Column.__or__, [F.contains(text, F.lit(c)) for c in CHANNELS])
    boost = boost + F.when((platforms == 0) & channel, -0.08).otherwise(0.0)
    for name in ("section_title", "heading_path", "table_headers"):
        if name in hits.columns:
            f = F.lower(F.coalesce(name, F.lit("")))
            one = F.when(F.exists("terms_", lambda t, f=f: F.contains(f, t)), 0.05).otherwise(0.0)
            one = one + F.when(f.rlike(CHANNEL_FIELD), 0.08).otherwise(0.0) + F.when(f.rlike(CHANNEL_SECTION), 0.08).otherwise(0.0)
            boost = boost + F.when(f != "", one).otherwise(0.0)
    return _boosted(hits.withColumn("terms_", terms), F.when(q.rlike(LIST_QUERY), boost).otherwise(0.0)).drop("terms_")


def search_space(hits: DataFrame) -> Column:
    parts = ("text", "filename", "doc_id", "section_title", "heading_path", "table_headers", "source_anchor")
    return F.lower(F.concat_ws("\n", *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts if p in hits.columns]))


def term_boost(hits: DataFrame) -> DataFrame:
    """Boost hits that hold a query term, then move the first hit with the anchor term to the top (pos 1).

    A match gives 0.26, a term in the section title 0.05 more, in the heading path 0.04.
    """
    h = hits.withColumns({"terms_": query_terms(F.col("query")), "space_": search_space(hits)})
    has = lambda c: F.exists("terms_", lambda t: F.contains(c, t))
    boost = F.lit(0.26)
    for name, worth in (("section_title", 0.05), ("heading_path", 0.04)):
        if name in hits.columns:
            boost = boost + F.when(has(F.lower(F.coalesce(name, F.lit("")))), worth).otherwise(0.0)
    h = ranked(_boosted(h, F.when(has(F.col("space_")), boost).otherwise(0.0)))
    w = Window.partitionBy("query_id")
    anchor = F.get("terms_", F.lit(0))
    usable = (F.size("terms_") >= 2) & F.coalesce(anchor.rlike(ANCHOR), F.lit(False))
    h = h.withColumn("at_", F.min(F.when(usable & F.contains("space_", anchor), F.col("pos"))).over(w)).withColumn("top_", F.max("rank_score").over(w))
    promoted = (F.col("pos") == F.col("at_")) & (F.col("at_") > 1)
    gain = F.greatest(F.lit(0.0), F.col("top_") - F.col("rank_score") + 0.01)
    h = h.withColumns({
        "rank_score": F.when(promoted, F.round(F.col("rank_score") + gain, 6)).otherwise(F.col("rank_score")),
        "retrieval_score": F.when(promoted, F.round(F.least(F.lit(1.0), F.col("retrieval_score") + F.least(gain, F.lit(0.35))), 6)).otherwise(F.col("retrieval_score")),
    })
    return _reposition(h, F.when(promoted, 0).otherwise(1)).drop("terms_", "space_", "at_", "top_")


def _reposition(hits: DataFrame, tier: Column) -> DataFrame:
    """pos renumbered by (tier, pos)."""
    return hits.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy(tier, "pos")))


def relation_anchors(text: Column) -> Column:
    """Up to three anchor terms of a relation question, else empty."""
    terms = F.filter(query_terms(text), lambda t: ~t.isin(RELATION_STOP) & t.rlike(ANCHOR))
    return F.when(F.lower(F.trim(text)).rlike(RELATION_QUERY), F.slice(terms, 1, 3)).otherwise(F.array().cast("array<string>"))


def relation_subqueries(queries: DataFrame, limit: int = 1, max_queries: int = 4) -> DataFrame:
    """(query_id, pos, subquery, support_term): the question, then for "A and B" questions ``<B> 是什么`` within budgets."""
    a = queries.select("query_id", F.trim("query").alias("query"), relation_anchors(F.col("query")).alias("a"))
    more = F.when(F.size("a") >= 2, F.slice("a", 2, min(limit, max_queries - 1))).otherwise(F.array().cast("array<string>"))
    rows = F.concat(
        F.array(F.struct(F.col("query").alias("subquery"), F.lit(None).cast("string").alias("support_term"))),
        F.transform(more, lambda t: F.struct(F.concat(t, F.lit(" 是什么")).alias("subquery"), t.alias("support_term"))),
    )
    return a.where("query <> ''").select("query_id", F.posexplode(rows).alias("pos", "s")).select("query_id", "pos", "s.*")


def promote_exact(hits: DataFrame, k: int) -> DataFrame:
    """The strongest max(1, min(k, 2)) hits with hard evidence go first; hits need pos, exact_match_bonus, reasons.

    Hard evidence: a hard phrase in the query and in the hit, or a short identifier among the reasons
    that stands in the query.  Strength: phrases in the text, then bonus plus rank score.
    """
    h = hits.withColumn("space_", search_space(hits))
    q = F.lower("query")
    phrases = [(F.contains(q, F.lit(p)), p) for p in HARD_PHRASES]
    hard = reduce(lambda a, b: a | b, [inq & F.contains("space_", F.lit(p)) for inq, p in phrases])
    ident = F.exists("reasons", lambda r: r.rlike(r"^identifier:[A-Za-z]\d{1,3}$") & F.regexp_like(q, F.concat(F.lit(r"(?<![a-z0-9])"), F.lower(F.substring(r, 12, 99)), F.lit(r"(?![a-z0-9])"))))
    hits_n = sum(((inq & F.contains(F.lower("text"), F.lit(p))).cast("int") for inq, p in phrases), F.lit(0))
    strength = F.struct(hits_n.alias("n"), (F.coalesce("exact_match_bonus", F.lit(0.0)) + F.col("rank_score")).alias("s"))
    h = h.withColumn("strong_", F.when(hard | F.coalesce(ident, F.lit(False)), strength))
    n = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("strong_").desc_nulls_last(), "pos"))
    h = h.withColumn("n_", F.when(F.col("strong_").isNotNull(), n))
    first = F.col("n_") <= max(1, min(k, 2))
    return _reposition(h, F.when(first, F.col("n_")).otherwise(1000)).drop("space_", "strong_", "n_")


def promote_title(hits: DataFrame) -> DataFrame:
    """For definition questions the best title candidate (is_title, by rank score) moves to pos 1."""
    cand = F.col("is_title") & F.col("query").rlike(DEFINITION_QUERY)
    best = F.max(F.when(cand, F.struct("rank_score", (-F.col("pos")).alias("p")))).over(Window.partitionBy("query_id"))
    h = hits.withColumn("best_", best)
    return _reposition(h, F.when(F.col("pos") == -F.col("best_.p"), 0).otherwise(1)).drop("best_")


def cover_relations(hits: DataFrame, top_n: int = 3, k: int = 5) -> DataFrame:
    """If the first hits miss an anchor of a relation question, the best later hit that holds one moves to pos 2."""
    w = Window.partitionBy("query_id")
    h = hits.withColumns({"a_": relation_anchors(F.col("query")), "space_": search_space(hits)})
    h = h.withColumn("got_", F.filter("a_", lambda t: F.contains("space_", t))).withColumn("win_", F.least(F.count(F.lit(1)).over(w), F.lit(min(max(1, k), max(1, top_n)))))
    inside = F.col("pos") <= F.col("win_")
    h = h.withColumns({
        "seen_": F.array_distinct(F.flatten(F.collect_list(F.when(inside, F.col("got_"))).over(w))),
        "docs_": F.collect_set(F.when(inside, F.col("doc_id").cast("string"))).over(w),
    })
    h = h.withColumn("new_", F.when(~inside & (F.size("a_") >= 2), F.array_except("got_", "seen_")).otherwise(F.array().cast("array<string>")))
    fields = F.lower(F.concat_ws(" ", *[F.col(c) for c in ("filename", "section_title", "heading_path") if c in hits.columns]))
    value = F.struct(
        F.size("new_").alias("n"), (~F.array_contains("docs_", F.col("doc_id").cast("string"))).cast("int").alias("d"),
        F.exists("new_", lambda t: F.contains(fields, t)).cast("int").alias("f"), F.col("rank_score").alias("r"), (-F.col("pos")).alias("p"),
    )
    h = h.withColumn("best_", F.max(F.when(F.size("new_") > 0, value)).over(w))
    tier = F.when(F.col("pos") == -F.col("best_.p"), F.when(F.col("win_") > 1, 2).otherwise(0)).when(F.col("pos") == 1, 1).otherwise(3)
    return _reposition(h, tier).drop("a_", "space_", "got_", "win_", "seen_", "docs_", "new_", "best_")


def threshold(hits: DataFrame, min_score: float = 0.2) -> DataFrame:
    return hits.where(F.col("retrieval_score") >= min_score)


def ready_only(hits: DataFrame, documents: DataFrame) -> DataFrame:
    """Hits whose document is ready and of the hit's tenant (any tenant where the hit has none)."""
    ready = documents.where("status = 'ready'").select("doc_id", F.col("tenant_id").alias("t_"))
    if "tenant_id" not in hits.columns:
        return hits.join(ready, "doc_id", "left_semi")
    free = F.coalesce(hits["tenant_id"], F.lit("")) == ""
    return hits.join(ready, (hits["doc_id"] == ready["doc_id"]) & (free | (hits["tenant_id"] == ready["t_"])), "left_semi")


def rerank(hits: DataFrame, scorer: Callable[[DataFrame], Column] | Column, pool: int = 40, mode: str = "logit") -> DataFrame:
    """Scores of the first ``pool`` hits by ``scorer`` (a column, such as a pandas UDF over query and text).

    ``logit`` goes through the sigmoid, ``probability`` must lie in [0, 1].  If any score of a query is
    missing or out of range, that query keeps its order and reranked is false.
    """
    raw = scorer(hits) if callable(scorer) else scorer
    score = F.when(F.col("pos") <= pool, raw)
    norm = 1 / (1 + F.exp(-F.col("raw_"))) if mode == "logit" else F.when(F.col("raw_").between(0, 1), F.col("raw_"))
    h = hits.withColumn("raw_", score.cast("double"))
    h = h.withColumn("rerank_score", F.round(F.when(~F.isnan("raw_"), norm), 6)).drop("raw_")
    ok = F.bool_and(F.col("rerank_score").isNotNull() | (F.col("pos") > pool)).over(Window.partitionBy("query_id"))
    h = h.withColumn("reranked", ok).withColumn("rerank_score", F.when(F.col("reranked"), F.col("rerank_score")))
    return h.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc_nulls_last(), "pos")))


def request_scores(hits: DataFrame, fn: Callable[[str, list[str]], Sequence[float]], pool: int = 40) -> DataFrame:
    """(query_id, chunk_id, raw_score, rerank_error): ``fn`` (query, texts -> scores) over the first ``pool`` hits of each request, in their order.

    Hits: query_id, chunk_id, pos, query, text.  A request is one call; what it raises, or an answer of another length, is kept as its error
    and leaves its scores null, and no other request's.  The requests of a task come in Arrow batches; a pool is bounded by ``pool``.
    """

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        kind = pa.struct([("scores", pa.list_(pa.float64())), ("error", pa.string())])
        for queries, texts in batches:
            out = []
            for query, candidates in zip(queries.to_pylist(), texts.to_pylist(), strict=True):
                try:
                    scores = [float(x) for x in fn(query or "", [t or "" for t in candidates])]
                    if len(scores) != len(candidates):
                        raise ValueError(f"{len(scores)} scores for {len(candidates)} texts")
                    out.append({"scores": scores, "error": None})
                except Exception as e:  # noqa: BLE001  a request that fails keeps its order
                    out.append({"scores": None, "error": f"{type(e).__name__}: {e}"})
            yield pa.array(out, kind)

    top = hits.where(F.col("pos") <= pool).groupBy("query_id").agg(F.first("query", ignorenulls=True).alias("query"), F.sort_array(F.collect_list(F.struct("pos", "chunk_id", "text"))).alias("c"))
    answer = F.arrow_udf(run, "scores array<double>, error string")(F.col("query"), F.transform("c", lambda x: x.text))
    each = top.select("query_id", "c", answer.alias("a")).select("query_id", F.col("a.error").alias("rerank_error"), F.posexplode("c").alias("i", "x"), F.col("a.scores").alias("s"))
    return each.select("query_id", F.col("x.chunk_id").alias("chunk_id"), F.get("s", F.col("i")).alias("raw_score"), "rerank_error")


def rerank_requests(hits: DataFrame, fn: Callable[[str, list[str]], Sequence[float]], pool: int = 40, mode: str = "logit") -> DataFrame:
    """``rerank`` by a scorer of whole requests; plus rerank_error, null where the request was answered."""
    scored = hits.join(request_scores(hits, fn, pool), ["query_id", "chunk_id"], "left")
    scored = scored.withColumn("rerank_error", F.max("rerank_error").over(Window.partitionBy("query_id")))
    return rerank(scored, F.col("raw_score"), pool, mode).drop("raw_score")


def one_child_per_parent(hits: DataFrame) -> DataFrame:
    """The best child of each parent; hits without a parent all stay."""
    n = F.row_number().over(Window.partitionBy("query_id", "parent_id").orderBy("pos"))
    return hits.withColumn("n_", n).where((F.col("n_") == 1) | F.col("parent_id").isNull()).drop("n_")


def pool_sizes(top_k: int, text: Column, reranker: bool) -> dict[str, Column]:
    """Candidate pools (vector_k, bm25_k) from k; list questions get at least 40 of each."""
    pool = max(top_k, 40) if reranker else max(top_k * 3, 15)
    wide = text.rlike(LIST_QUERY)
    size = lambda n: F.when(wide, F.greatest(F.lit(n), F.lit(40))).otherwise(F.lit(n)).cast("int")
    return {"vector_k": size(max(top_k * 3, pool)), "bm25_k": size(max(20, top_k * 3, pool))}


def top_k(hits: DataFrame, k: int = 5) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("query_id").orderBy("pos"))
    return hits.withColumn("pos", n).where(F.col("pos") <= k)


def merge_collections(*branches: DataFrame) -> DataFrame:
    """Branches of several collections: per chunk the best rank score, then one global order."""
    all_hits = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), branches)
    n = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("rank_score"), *[c for c in ("kb_id",) if c in all_hits.columns]))
    return ranked(all_hits.withColumn("n_", n).where("n_ = 1").drop("n_"))


def relevance_gate(hits: DataFrame, min_best: float = 0.35, min_rerank: float = 0.05) -> DataFrame:
    """Of a query with rerank scores the hits of at least ``min_rerank``; of another all hits if the best reaches ``min_best``, else none."""
    w = Window.partitionBy("query_id")
    h = hits.withColumns({"any_": F.bool_or(F.col("rerank_score").isNotNull()).over(w), "best_": F.max("retrieval_score").over(w)})
    keep = F.when(F.col("any_"), F.coalesce("rerank_score", "retrieval_score") >= min_rerank).otherwise(F.col("best_") >= min_best)
    return h.where(keep).drop("any_", "best_")


def merge_rounds(first: DataFrame, more: DataFrame) -> DataFrame:
    """Two retrieval rounds: per chunk the row of the higher rank score (the first round wins ties); expansions go first."""
    both = first.withColumn("o_", F.lit(0)).unionByName(more.withColumn("o_", F.lit(1)))
    n = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("rank_score"), "o_"))
    both = both.withColumn("n_", n).where("n_ = 1").drop("n_", "o_")
    return both.withColumn("pos", F.row_number().over(_order(F.desc("is_expansion"), F.desc("rank_score"))))


def stage_trace(stages: dict[str, DataFrame], score: str = "rank_score", n: int = 5) -> DataFrame:
    """(query_id, stage, candidates, top): per stage the number of hits and the first ``n`` as array<struct<chunk_id, score>>."""
    rows = reduce(
        lambda a, b: a.unionByName(b),
        [d.select("query_id", F.lit(name).alias("stage"), "chunk_id", F.col(score).alias("score")) for name, d in stages.items()],
    )
    w = Window.partitionBy("query_id", "stage").orderBy(F.desc("score"), "chunk_id")
    rows = rows.withColumn("n_", F.row_number().over(w))
    top = F.array_sort(F.collect_list(F.when(F.col("n_") <= n, F.struct("n_", "chunk_id", "score"))))
    return rows.groupBy("query_id", "stage").agg(F.count(F.lit(1)).alias("candidates"), F.transform(top, lambda x: F.struct(x.chunk_id, x.score)).alias("top"))
