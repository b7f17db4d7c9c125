"""Metadata and lifecycle tables (I)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kbspark.functions.text import estimate_tokens, first_not_blank
from kbspark.operators import answers as A

#: Orders of preference and allowed changes of a document's status (fixed values).
DEDUPE_PRIORITY = ("ready", "reindexing", "reindex_queued", "failed", "delete_failed", "processing", "deleting")
UPLOAD_PRIORITY = ("ready", "reindexing", "reindex_queued", "processing", "deleting", "failed", "delete_failed")
TRANSITIONS = {
    "processing": ("failed", "ready"),
    "ready": ("processing", "reindexing"),
    "failed": ("processing", "reindex_queued", "reindexing", "deleting"),
    "reindex_queued": ("ready", "failed"),
    "reindexing": ("reindex_queued",),
    "deleting": ("failed", "delete_failed", "reindex_queued"),
    "delete_failed": ("deleting",),
}


def _priority(status: Column, order: tuple[str, ...]) -> Column:
    p = F.lit(len(order))
    for n, s in enumerate(order):
        p = F.when(status == s, n).otherwise(p)
    return p


def dedupe_documents(documents: DataFrame) -> DataFrame:
    """Plus role ``keep`` or ``remove`` and keeper: groups of (tenant, kb, hash, model, dimension); status priority, then the oldest stays.

    Documents without a hash are groups of their own.
    """
    key = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("tenant_id", "kb_id", "content_hash", "embedding_model", "embedding_dimension")]
    alone = F.when(F.coalesce("content_hash", F.lit("")) == "", F.col("doc_id").cast("string")).otherwise("")
    w = Window.partitionBy(*key, alone).orderBy(_priority(F.col("status"), DEDUPE_PRIORITY), "created_at", "doc_id")
    keeper = F.first("doc_id").over(w)
    return documents.withColumn("keeper", keeper).withColumn("role", F.when(F.col("doc_id") == F.col("keeper"), "keep").otherwise("remove"))


def claim_uploads(incoming: DataFrame, documents: DataFrame) -> DataFrame:
    """``incoming`` (upload_id, tenant_id, kb_id, content_hash) plus action and existing: created, ready or conflict.

    A failed document does not stand in the way; a stored row without kb matches any kb; of equal
    uploads in one batch the first creates, the others conflict.
    """
    held = documents.where(F.col("status") != "failed").select("doc_id", F.coalesce("tenant_id", F.lit("")).alias("t"), F.coalesce("kb_id", F.lit("")).alias("k"), F.col("content_hash").alias("h"), "status", "created_at")
    tenant, kb = F.coalesce(incoming["tenant_id"], F.lit("")), F.coalesce(incoming["kb_id"], F.lit(""))
    j = incoming.join(held, (incoming["content_hash"] == held["h"]) & (tenant == held["t"]) & ((held["k"] == "") | (kb == held["k"])), "left")
    best = F.row_number().over(Window.partitionBy("upload_id").orderBy(_priority(F.col("status"), UPLOAD_PRIORITY), F.desc("created_at"), "doc_id"))
    j = j.withColumn("n_", best).where("n_ = 1")
    first = F.row_number().over(Window.partitionBy(tenant, kb, incoming["content_hash"]).orderBy("upload_id"))
    j = j.withColumn("first_", first)
    action = F.when(F.col("status") == "ready", "ready").when(F.col("status").isNotNull(), "conflict").when(F.col("first_") > 1, "conflict").otherwise("created")
    return j.select(*[incoming[c] for c in incoming.columns], action.alias("action"), F.col("doc_id").alias("existing"))


def audit_transitions(log: DataFrame) -> DataFrame:
    """(doc_id, seq, before, after) of every status change of a log (doc_id, seq, status) that is not allowed."""
    spark = log.sparkSession
    allowed = spark.createDataFrame([(a, b) for a, bs in TRANSITIONS.items() for b in bs], "before string, after string")
    steps = log.withColumn("before", F.lag("status").over(Window.partitionBy("doc_id").orderBy("seq"))).withColumnRenamed("status", "after")
    steps = steps.where("before IS NOT NULL AND before <> after")
    return steps.join(F.broadcast(allowed), ["before", "after"], "left_anti").select("doc_id", "seq", "before", "after")


def status_counts(documents: DataFrame, by: str) -> DataFrame:
    """Per ``by``: documents, ready, failed and the revision (largest updated_at)."""
    n = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(s)
    return documents.groupBy(by).agg(F.count(F.lit(1)).alias("documents"), n("ready"), n("failed"), n("processing"), F.max("updated_at").alias("revision"))


def backfill_owner(documents: DataFrame, tenant: str, kb: str) -> DataFrame:
    """tenant_id and kb_id filled where missing, plus changed."""
    t, k = first_not_blank(F.col("tenant_id"), F.lit(tenant)), first_not_blank(F.col("kb_id"), F.lit(kb))
    changed = ~(F.col("tenant_id").eqNullSafe(t) & F.col("kb_id").eqNullSafe(k))
    return documents.withColumns({"changed": changed, "tenant_id": t, "kb_id": k})


def source_fingerprint(documents: DataFrame, by: str = "kb_id") -> DataFrame:
    """(by, fingerprint) of the ready documents' ids, hashes, sizes and revisions; independent of order.

    Two levels: digests are joined in buckets first, so a collection that holds a third of all rows
    does not meet in one task.
    """
    ready = documents.where("status = 'ready'")
    row = F.sha2(F.to_json(F.struct("doc_id", "content_hash", "file_size", "source_revision")), 256)
    d = ready.select(by, row.alias("d")).withColumn("b", F.substring("d", 1, 2))
    buckets = d.groupBy(by, "b").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("d")), ""), 256).alias("s"))
    return buckets.groupBy(by).agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("b", "s"))), lambda x: F.concat(x.b, x.s)), ""), 256).alias("fingerprint"))


def active_generations(generations: DataFrame, kbs: DataFrame) -> DataFrame:
    """(kb_id, index_id, state): the latest activated generation of each kb; ``missing`` where a managed kb (kb_id, managed) has none."""
    active = generations.where("status = 'active'").groupBy("kb_id").agg(F.max(F.struct("activated_at", "updated_at", "index_id")).alias("g"))
    j = kbs.join(active, "kb_id", "left")
    state = F.when(F.col("g").isNotNull(), "active").when(F.col("managed"), "missing").otherwise("legacy")
    return j.select("kb_id", F.col("g.index_id").alias("index_id"), state.alias("state"))


def activate(generations: DataFrame, fingerprints: DataFrame, candidates: DataFrame) -> DataFrame:
    """``generations`` after activating ``candidates`` (index_id) whose source_fingerprint is still current (kb_id, fingerprint).

    The kb's other active generations become ready; a stale candidate becomes ``stale``.
    """
    c = candidates.select("index_id").withColumn("wanted", F.lit(True))
    g = generations.join(c, "index_id", "left").join(fingerprints, "kb_id", "left")
    fits = F.coalesce(F.col("source_fingerprint") == F.col("fingerprint"), F.lit(False))
    g = g.withColumn("ok", F.coalesce("wanted", F.lit(False)) & fits)
    won = F.max("ok").over(Window.partitionBy("kb_id"))
    status = F.when(F.col("ok"), "active").when(F.coalesce("wanted", F.lit(False)), "stale").when(F.col("won") & (F.col("status") == "active"), "ready").otherwise(F.col("status"))
    return g.withColumn("won", won).withColumn("status", status).select(*generations.columns)


def retention(generations: DataFrame, fingerprints: DataFrame, referenced: DataFrame, now: Column, keep: int = 2, days: int = 7) -> DataFrame:
    """Plus class: active, in_use, stale_ready, excess, expired or kept."""
    g = generations.join(fingerprints, "kb_id", "left").join(referenced.select("index_id").distinct().withColumn("used", F.lit(True)), "index_id", "left")
    n = F.row_number().over(Window.partitionBy("kb_id", F.col("status") == "active").orderBy(F.desc("updated_at"), "index_id"))
    old = F.col("updated_at") < now - F.expr(f"INTERVAL {days} DAYS")
    kind = (
        F.when(F.col("status") == "active", "active").when(F.col("used"), "in_use")
        .when((F.col("status") == "ready") & ~F.coalesce(F.col("source_fingerprint") == F.col("fingerprint"), F.lit(False)), "stale_ready")
        .when(F.col("n") > keep, "excess").when(old, "expired").otherwise("kept")
    )
    return g.withColumn("n", n).select(*generations.columns, kind.alias("class"))


def reconcile_plan(snapshot: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_id, change) between a snapshot and the ready documents (doc_id, content_hash, source_revision): added, changed or removed."""
    s = snapshot.select("doc_id", F.col("content_hash").alias("h0"), F.col("source_revision").alias("r0"), F.lit(True).alias("in_s"))
    d = documents.where("status = 'ready'").select("doc_id", F.col("content_hash").alias("h1"), F.col("source_revision").alias("r1"), F.lit(True).alias("in_d"))
    j = s.join(d, "doc_id", "full")
    change = F.when(F.col("in_s").isNull(), "added").when(F.col("in_d").isNull(), "removed").when(~F.col("h0").eqNullSafe(F.col("h1")) | ~F.col("r0").eqNullSafe(F.col("r1")), "changed")
    return j.select("doc_id", change.alias("change")).where("change IS NOT NULL")


def repair_audit(documents: DataFrame, model: str, now: Column, stuck_minutes: int = 30) -> DataFrame:
    """(doc_id, flags): stuck, no_chunks, model_mismatch, missing_hash, missing_tenant, duplicate (of tenant and hash, any kb)."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    n = F.count(F.lit(1)).over(Window.partitionBy("tenant_id", "content_hash"))
    d = documents.withColumn("n_", n)
    flags = F.array_compact(F.array(
        F.when((F.col("status") == "processing") & (F.col("updated_at") < now - F.expr(f"INTERVAL {stuck_minutes} MINUTES")), "stuck"),
        F.when((F.col("status") == "ready") & (F.coalesce("chunks_count", F.lit(0)) == 0), "no_chunks"),
        F.when((F.col("status") == "ready") & ~F.coalesce(F.col("embedding_model") == model, F.lit(False)), "model_mismatch"),
        F.when(blank("content_hash"), "missing_hash"), F.when(blank("tenant_id"), "missing_tenant"), F.when(~blank("content_hash") & (F.col("n_") > 1), "duplicate"),
    ))
    return d.select("doc_id", flags.alias("flags"))


def supersede_jobs(jobs: DataFrame, key: list[str]) -> DataFrame:
    """Active jobs (queued, running) of one key: running first, then the oldest stays, the others become cancelled."""
    active = F.col("status").isin("queued", "running")
    n = F.row_number().over(Window.partitionBy(*key, active).orderBy(F.when(F.col("status") == "running", 0).otherwise(1), "created_at", "job_id"))
    return jobs.withColumn("n_", n).withColumn("status", F.when(active & (F.col("n_") > 1), "cancelled").otherwise(F.col("status"))).drop("n_")


def job_board(jobs: DataFrame, now: Column, lease_seconds: int = 600, max_attempts: int = 3, history: int = 10, keep_days: int = 30) -> DataFrame:
    """``jobs`` plus flags: stale_lease, exhausted, runnable_rank (null if not runnable), history_rank (null beyond the last ones), prunable."""
    stale = (F.col("status") == "running") & (F.col("locked_at") < now - F.expr(f"INTERVAL {lease_seconds} SECONDS"))
    ended = F.col("status").isin("succeeded", "failed", "cancelled")
    j = jobs.withColumns({"stale_lease": F.coalesce(stale, F.lit(False)), "exhausted": F.col("attempts") >= max_attempts})
    run = ((F.col("status") == "queued") | F.col("stale_lease")) & ~F.col("exhausted")
    rank = F.row_number().over(Window.partitionBy("tenant_id", run).orderBy("created_at", "job_id"))
    past = F.row_number().over(Window.partitionBy("tenant_id", ended).orderBy(F.desc("updated_at"), "job_id"))
    return j.withColumns({
        "runnable_rank": F.when(run, rank), "history_rank": F.when(ended & (past <= history), past),
        "prunable": ended & (F.col("updated_at") < now - F.expr(f"INTERVAL {keep_days} DAYS")),
    })


def covering_batch(batches: DataFrame, requests: DataFrame) -> DataFrame:
    """(request_id, batch_id): the oldest active batch (batch_id, kb_id, doc_ids, created_at, status) that holds all documents of a request (request_id, kb_id, doc_ids)."""
    # requests of one set of documents have one answer, of batches of one set only the oldest can be it; so each set meets once
    whole = F.array_sort(F.array_distinct("doc_ids"))
    asked = requests.where(F.size("doc_ids") > 0).select("request_id", "kb_id", whole.alias("want"))
    first = asked.select("kb_id", "want").distinct().withColumn("d", F.array_min("want"))
    held = batches.where(F.col("status").isin("queued", "running")).groupBy("kb_id", whole.alias("doc_ids")).agg(F.min(F.struct("created_at", "batch_id")).alias("b"))
    # a batch can only cover a request if it holds the request's first document
    held = held.select("kb_id", "b", "doc_ids", F.explode("doc_ids").alias("d"))
    ok = first.join(held, ["kb_id", "d"]).where(F.size(F.array_except("want", "doc_ids")) == 0)
    ok = ok.groupBy("kb_id", "want").agg(F.min("b")["batch_id"].alias("batch_id"))
    return asked.join(ok, ["kb_id", "want"]).select("request_id", "batch_id")


def list_conversations(conversations: DataFrame, messages: DataFrame, n: int) -> DataFrame:
    """(conversation_id, message_count, last_at): the ``n`` latest by last message, else creation."""
    m = messages.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("message_count"), F.max("created_at").alias("m_at"))
    c = conversations.join(m, "conversation_id", "left")
    c = c.select("conversation_id", F.coalesce("message_count", F.lit(0)).alias("message_count"), F.coalesce("m_at", "created_at").alias("last_at"))
    return c.orderBy(F.desc("last_at"), "conversation_id").limit(n)


def append_messages(messages: DataFrame, new: DataFrame) -> DataFrame:
    """``messages`` with ``new`` (same columns but seq, plus ord) behind the largest seq of their conversation."""
    top = messages.groupBy("conversation_id").agg(F.max("seq").alias("top"))
    n = F.row_number().over(Window.partitionBy("conversation_id").orderBy("ord"))
    added = new.withColumn("n_", n).join(top, "conversation_id", "left").withColumn("seq", (F.coalesce("top", F.lit(0)) + F.col("n_")).cast(messages.schema["seq"].dataType))
    return messages.unionByName(added.select(*messages.columns))


def latest_sources(messages: DataFrame, documents: DataFrame, kb_ids: list[str]) -> DataFrame:
    """(conversation_id, doc_ids, reusable): sources of the latest message that has any; reusable if every one is ready and in scope (empty: any)."""
    last = messages.where(F.size("doc_ids") > 0).groupBy("conversation_id").agg(F.max_by("doc_ids", "seq").alias("doc_ids"))
    each = last.select("conversation_id", F.explode("doc_ids").alias("doc_id")).join(documents.select("doc_id", "kb_id", "status"), "doc_id", "left")
    ok = F.coalesce(F.col("status") == "ready", F.lit(False))
    ok = ok & F.coalesce(F.col("kb_id").isin(kb_ids), F.lit(False)) if kb_ids else ok
    return last.join(each.groupBy("conversation_id").agg(F.bool_and(ok).alias("reusable")), "conversation_id")


def history_window(messages: DataFrame, n: int = 8, budget: int = 2048, truncate: int = 4000, least: int = 64) -> DataFrame:
    """(conversation_id, seq, role, content): the last ``n`` messages that are valid, newest first while their tokens fit.

    Valid: user or finished assistant turns with content; assistant turns without internal notes and
    with no citation outside their sources (source_idx array).  The first that does not fit keeps its
    tail if at least ``least`` tokens are left; nothing older follows.
    """
    back = Window.partitionBy("conversation_id").orderBy(F.desc("seq"))
    m = messages.withColumn("r_", F.row_number().over(back)).where(F.col("r_") <= n)
    text = F.trim(F.coalesce("content", F.lit("")))
    cited = A.citation_array(text)
    sources = F.coalesce("source_idx", F.array().cast("array<int>"))
    safe = ~A.any_of(text, A.INTERNAL_NOTES) & (F.size(F.array_except(cited, sources)) == 0)
    finished = F.coalesce("status", F.lit("completed")) == "completed"
    m = m.where((text != "") & ((F.col("role") == "user") | ((F.col("role") == "assistant") & finished & safe)))
    m = m.withColumn("content", F.substring(text, 1, truncate)).withColumn("t_", estimate_tokens(F.col("content")))
    m = m.withColumn("used_", F.sum("t_").over(back) - F.col("t_"))
    over = F.col("used_") + F.col("t_") > budget
    m = m.withColumn("stop_", F.min(F.when(over, F.col("r_"))).over(Window.partitionBy("conversation_id")))
    left = F.lit(budget) - F.col("used_")
    m = m.where(F.col("stop_").isNull() | (F.col("r_") < F.col("stop_")) | ((F.col("r_") == F.col("stop_")) & (left >= least)))
    chars = F.greatest(F.lit(1), F.floor(F.length("content") * (left / F.greatest("t_", F.lit(1)))).cast("int"))
    return m.select("conversation_id", "seq", "role", F.when(F.col("r_") == F.col("stop_"), F.right("content", chars)).otherwise(F.col("content")).alias("content"))


def detach_kb(conversations: DataFrame, kb_id: str) -> DataFrame:
    """``conversations`` (kb_ids array, mode) without the kb; an emptied scope turns to assistant mode."""
    left = F.array_distinct(F.array_remove("kb_ids", kb_id))
    had = F.array_contains("kb_ids", kb_id)
    return conversations.withColumns({"kb_ids": left, "mode": F.when(had & (F.size(left) == 0), "assistant").otherwise(F.col("mode"))})


def purge_plan(tables: dict[str, DataFrame], keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """(table, rows): how many rows of each table belong to ``keys``."""
    counts = [t.join(keys.select(key).distinct(), key, "left_semi").agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table"), "rows") for n, t in tables.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def purge(table: DataFrame, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    return table.join(keys.select(key).distinct(), key, "left_anti")


# What diagnostics must not show, and what stands for it.
SECRETS = [
    (r"(?i)\b(api[_-]?key|access[_-]?token|authorization|password)(\s*[:=]\s*)[^\s,;]+", "$1$2[已隐藏]"),
    (r"(?i)\b(?:https?|ftp)://[^\s<>\"'`]+", "[已隐藏地址]"),
    (r"(?<![\w])(?:[A-Za-z]:[\\/]|\\\\)[^\s<>\"'`]+", "[已隐藏路径]"),
    (r"(?<![\w])/(?:Users|home|tmp|var|private|opt|app|mnt|workspace)(?:/[^\s<>\"'`]+)+", "[已隐藏路径]"),
]


def redact(text: Column, limit: int = 240) -> Column:
    """Diagnostics without secrets, URLs and deployment paths, on one line, cut to ``limit``."""
    t = F.trim(F.coalesce(text, F.lit("")))
    for pattern, shown in SECRETS:
        t = F.regexp_replace(t, pattern, shown)
    t = F.trim(F.regexp_replace(t, r"(?U)\s+", " "))
    return F.when(F.length(t) > limit, F.concat(F.rtrim(F.substring(t, 1, limit - 3)), F.lit("..."))).otherwise(t)
