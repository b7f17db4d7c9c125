"""From ranked hits to a context for the answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kbspark.functions.text import estimate_tokens


def hydrate(hits: DataFrame, parents: DataFrame) -> DataFrame:
    """Child text replaced by the parent's, one slot per parent, with parent_count, has_more_before, has_more_after, document_complete."""
    n = F.row_number().over(Window.partitionBy("query_id", "parent_id").orderBy("pos"))
    h = hits.withColumn("n_", n).where((F.col("n_") == 1) | F.col("parent_id").isNull()).drop("n_")
    counts = parents.groupBy("doc_id").agg(F.count(F.lit(1)).alias("parent_count"), F.max("parent_index").alias("last_"))
    p = parents.join(counts, "doc_id").select("parent_id", F.col("text").alias("ptext_"), "parent_index", "parent_count", "last_")
    j = h.join(p, "parent_id", "left")
    return j.withColumns({
        "text": F.coalesce("ptext_", "text"),
        "has_more_before": F.col("parent_index") > 0, "has_more_after": F.col("parent_index") < F.col("last_"),
        "document_complete": F.col("parent_count") == 1,
    }).drop("ptext_", "last_")


def expand(hits: DataFrame, parents: DataFrame, radius: int = 1, direction: str = "both") -> DataFrame:
    """(query_id, parent_id, doc_id, parent_index, text): neighbours within ``radius`` of each hit's parent, without parents already there."""
    before, after = (radius if direction in ("before", "both") else 0), (radius if direction in ("after", "both") else 0)
    at = hits.select("query_id", "doc_id", F.explode(F.sequence(F.col("parent_index") - before, F.col("parent_index") + after)).alias("parent_index")).distinct()
    near = at.join(parents, ["doc_id", "parent_index"])
    return near.join(hits.select("query_id", "parent_id"), ["query_id", "parent_id"], "left_anti").select("query_id", "parent_id", "doc_id", "parent_index", "text")


def scope_plan(queries: DataFrame, messages: DataFrame, documents: DataFrame) -> DataFrame:
    """(query_id, doc_id): documents that a question names by file name or stem, among those cited in the latest sources of its conversation.

    queries: query_id, conversation_id, query; messages: conversation_id, seq, doc_ids array;
    documents: doc_id, filename, stem.
    """
    cited = messages.where(F.size("doc_ids") > 0).groupBy("conversation_id").agg(F.max_by("doc_ids", "seq").alias("doc_ids"))
    named = queries.join(cited, "conversation_id").select("query_id", F.lower("query").alias("q"), F.explode("doc_ids").alias("doc_id")).join(documents, "doc_id")
    return named.where(F.contains("q", F.lower("filename")) | F.contains("q", F.lower("stem"))).select("query_id", "doc_id").distinct()


def retry_unscoped(hits: DataFrame, scopes: DataFrame) -> DataFrame:
    """Hits inside the scope of their query; all hits of a query without a scope or with none left inside it; plus scoped."""
    inside = hits.join(scopes, ["query_id", "doc_id"], "left_semi").withColumn("scoped", F.lit(True))
    rest = hits.join(inside.select("query_id").distinct(), "query_id", "left_anti").withColumn("scoped", F.lit(False))
    return inside.unionByName(rest)


def source_list(hits: DataFrame, documents: DataFrame) -> DataFrame:
    """(query_id, index, doc_id, kb_id, filename, chunk_id, score): one source per hit, numbered from 1 in order."""
    d = documents.select("doc_id", "kb_id", "filename")
    n = F.row_number().over(Window.partitionBy("query_id").orderBy("pos"))
    score = F.coalesce(*[F.col(c) for c in ("rerank_score", "retrieval_score", "rank_score") if c in hits.columns])
    keep = hits.select("query_id", n.alias("index"), "doc_id", "chunk_id", score.alias("score"))
    return keep.join(d, "doc_id", "left").select("query_id", "index", "doc_id", "kb_id", "filename", "chunk_id", "score")


def fit_budget(hits: DataFrame, context_tokens: int, reserved: int = 512) -> DataFrame:
    """Hits in order while their tokens fit; the first that does not is cut if over 100 tokens are left, and nothing follows it."""
    budget = context_tokens - reserved
    order = Window.partitionBy("query_id").orderBy("pos")
    h = hits.withColumn("t_", estimate_tokens(F.col("text"))).withColumn("used_", F.sum("t_").over(order) - F.col("t_"))
    over = F.col("used_") + F.col("t_") > budget
    h = h.withColumn("first_", F.min(F.when(over, F.col("pos"))).over(Window.partitionBy("query_id")))
    left = F.lit(budget) - F.col("used_")
    chars = F.floor(F.length("text") * (left / F.col("t_"))).cast("int")
    h = h.where(F.col("first_").isNull() | (F.col("pos") < F.col("first_")) | ((F.col("pos") == F.col("first_")) & (left > 100)))
    cut = F.col("pos") == F.col("first_")
    text = F.when(cut, F.concat(F.substr("text", F.lit(1), chars), F.lit("..."))).otherwise(F.col("text"))
    return h.where(F.lit(budget > 0)).withColumn("truncated", F.coalesce(cut, F.lit(False))).withColumn("text", text).drop("t_", "used_", "first_")


def budgets(window: int, max_output: int) -> dict[str, int]:
    """Token budgets of a turn: context, output, history, reserved."""
    context = max(1024, window)
    share = max(256, min(2048, context // 4))
    output = min(max(128, max_output), share)
    return {"context": context, "output": output, "history": share, "reserved": output + share + 600}


def render_context(hits: DataFrame) -> DataFrame:
    """(query_id, context): ``[n] [section=... | path=... | kind=... | headers=...] text`` per hit, joined by blank lines."""
    col = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) if c in hits.columns else F.lit("")
    section, path, kind, headers = col("section_title"), col("heading_path"), col("kind"), col("table_headers")
    tag = lambda name, c, cond=None: F.when((c != "") & (F.lit(True) if cond is None else cond), F.concat(F.lit(name + "="), c))
    meta = F.concat_ws(" | ", tag("section", section), tag("path", path, path != section), tag("kind", kind), tag("headers", headers))
    part = F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"), F.when(meta != "", F.concat(F.lit(" ["), meta, F.lit("]"))).otherwise(""), F.lit(" "), F.col("text"))
    parts = F.sort_array(F.collect_list(F.struct("pos", part.alias("part"))))
    return hits.groupBy("query_id").agg(parts.alias("p")).select("query_id", F.array_join(F.transform("p", lambda x: x.part), "\n\n").alias("context"))


MARKER = "\n…（本次判定展示已截断，中间内容未展示）…\n"


def preview(text: Column, max_chars: int) -> Column:
    """The text, or its head and tail around a marker where it is longer than ``max_chars``."""
    room = max(2, max(1, max_chars) - len(MARKER))
    head, tail = room // 2, room - room // 2
    return F.when(F.length(text) > max(1, max_chars), F.concat(F.left(text, F.lit(head)), F.lit(MARKER), F.right(text, F.lit(tail)))).otherwise(text)
