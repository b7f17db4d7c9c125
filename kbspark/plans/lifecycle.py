"""Queries over metadata and lifecycle tables (I)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.operators import lifecycle as I
from kbspark.plans.base import query, table

STATUSES = ("ready", "reindexing", "reindex_queued", "failed", "delete_failed", "processing", "deleting")
JOB_STATUSES = ("queued", "running", "succeeded", "failed", "cancelled")


def _pick(n, values):
    return F.element_at(F.array(*map(F.lit, values)), (n + 1).cast("int"))


def documents(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    created = F.timestamp_seconds(F.lit(1704067200) + i * 60)
    return table(spark, d, "documents").select(
        "doc_id", F.col("lang").alias("tenant_id"), F.col("source").alias("kb_id"), F.sha2("text", 256).alias("content_hash"), _pick(i % 7, STATUSES).alias("status"),
        created.alias("created_at"), F.timestamp_seconds(F.lit(1704067200) + i * 60 + i % 100 * 3600).alias("updated_at"), F.col("n_chars").alias("file_size"),
        (i % 3).cast("int").alias("source_revision"), F.when(i % 11 == 0, "old").otherwise("m").alias("embedding_model"), F.lit(64).alias("embedding_dimension"), (i % 5).cast("int").alias("chunks_count"),
    )


_S = "['" + "', '".join(STATUSES) + "']"
DOCS = f"""dm AS (SELECT doc_id, lang AS tenant_id, source AS kb_id, sha256(text) AS content_hash, ({_S})[doc_id % 7 + 1] AS status, 1704067200 + doc_id * 60 AS created_at,
  1704067200 + doc_id * 60 + doc_id % 100 * 3600 AS updated_at, n_chars AS file_size, doc_id % 3 AS source_revision, CASE WHEN doc_id % 11 = 0 THEN 'old' ELSE 'm' END AS embedding_model, doc_id % 5 AS chunks_count FROM documents)"""


def _rank_sql(order: tuple[str, ...]) -> str:
    return "CASE status " + " ".join(f"WHEN '{s}' THEN {n}" for n, s in enumerate(order)) + f" ELSE {len(order)} END"


@query("I1", f"""WITH {DOCS}, k AS (SELECT doc_id, first_value(doc_id) OVER (PARTITION BY tenant_id, kb_id, content_hash, embedding_model ORDER BY {_rank_sql(I.DEDUPE_PRIORITY)}, created_at, doc_id) AS keeper FROM dm)
  SELECT doc_id, keeper, CASE WHEN doc_id = keeper THEN 'keep' ELSE 'remove' END AS role FROM k""")
def dedupe(spark: SparkSession, d: str) -> DataFrame:
    return I.dedupe_documents(documents(spark, d)).select("doc_id", "keeper", "role")


@query("I2", f"""WITH {DOCS}, inc AS (SELECT doc_id AS upload_id, lang AS tenant_id, source AS kb_id, sha256(text) AS content_hash FROM documents),
  held AS (SELECT * FROM dm WHERE status <> 'failed'),
  j AS (SELECT i.*, h.doc_id AS existing, h.status, row_number() OVER (PARTITION BY upload_id ORDER BY {_rank_sql(I.UPLOAD_PRIORITY)}, h.created_at DESC, h.doc_id) AS n
    FROM inc i LEFT JOIN held h ON i.content_hash = h.content_hash AND i.tenant_id = h.tenant_id AND i.kb_id = h.kb_id)
  SELECT upload_id, existing, CASE WHEN status = 'ready' THEN 'ready' WHEN status IS NOT NULL THEN 'conflict'
    WHEN row_number() OVER (PARTITION BY tenant_id, kb_id, content_hash ORDER BY upload_id) > 1 THEN 'conflict' ELSE 'created' END AS action FROM j WHERE n = 1""")
def claim(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d)
    inc = docs.select(F.col("doc_id").alias("upload_id"), "tenant_id", "kb_id", "content_hash")
    return I.claim_uploads(inc, docs).select("upload_id", "existing", "action")


_OK = " OR ".join(f"(before = '{a}' AND after IN ({', '.join(repr(b) for b in bs)}))" for a, bs in I.TRANSITIONS.items())


@query("I3", f"""WITH s AS (SELECT user_id AS doc_id, event_id AS seq, ({_S})[event_id * 5 % 7 + 1] AS after FROM events),
  l AS (SELECT *, lag(after) OVER (PARTITION BY doc_id ORDER BY seq) AS before FROM s) SELECT doc_id, seq, before, after FROM l WHERE before IS NOT NULL AND before <> after AND NOT ({_OK})""")
def transitions(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return I.audit_transitions(e.select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("seq"), _pick(F.col("event_id") * 5 % 7, STATUSES).alias("status")))


@query("I4", f"""WITH {DOCS} SELECT kb_id, count(*) AS documents, count(*) FILTER (status = 'ready') AS ready, count(*) FILTER (status = 'failed') AS failed,
  count(*) FILTER (status = 'processing') AS processing, max(updated_at) AS revision FROM dm GROUP BY kb_id""")
def counts(spark: SparkSession, d: str) -> DataFrame:
    return I.status_counts(documents(spark, d), "kb_id").withColumn("revision", F.unix_timestamp("revision"))


@query("I5", """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'default' ELSE lang END AS tenant_id, CASE WHEN doc_id % 4 = 0 THEN 'kb0' ELSE source END AS kb_id, doc_id % 3 = 0 OR doc_id % 4 = 0 AS changed FROM documents""")
def owners(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    docs = table(spark, d, "documents").select("doc_id", F.when(i % 3 != 0, F.col("lang")).alias("tenant_id"), F.when(i % 4 == 0, "").otherwise(F.col("source")).alias("kb_id"))
    return I.backfill_owner(docs, "default", "kb0")


FINGER = """fr AS (SELECT kb_id, sha256('{"doc_id":' || doc_id || ',"content_hash":"' || content_hash || '","file_size":' || file_size || ',"source_revision":' || source_revision || '}') AS d FROM dm WHERE status = 'ready'),
fb AS (SELECT kb_id, d[:2] AS b, sha256(string_agg(d, '' ORDER BY d)) AS s FROM fr GROUP BY ALL), fp AS (SELECT kb_id, sha256(string_agg(b || s, '' ORDER BY b)) AS fingerprint FROM fb GROUP BY kb_id)"""


@query("I6", f"WITH {DOCS}, {FINGER} SELECT * FROM fp")
def fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return I.source_fingerprint(documents(spark, d))


def generations(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "active").when(F.col("o_orderstatus") == "O", "ready").otherwise("failed")
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("index_id"), (F.col("o_custkey") % 50).alias("kb_id"), status.alias("status"), (F.col("o_orderkey") % 3).cast("string").alias("source_fingerprint"),
        F.col("o_orderdate").alias("activated_at"), F.col("o_orderdate").alias("updated_at"),
    )


GEN = """gen AS (SELECT o_orderkey AS index_id, o_custkey % 50 AS kb_id, CASE o_orderstatus WHEN 'F' THEN 'active' WHEN 'O' THEN 'ready' ELSE 'failed' END AS status, (o_orderkey % 3)::VARCHAR AS source_fingerprint, o_orderdate AS at_ FROM orders)"""


def fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return generations(spark, d).select("kb_id").distinct().withColumn("fingerprint", F.lit("1"))


@query("I7", f"""WITH {GEN}, a AS (SELECT kb_id, index_id FROM (SELECT *, row_number() OVER (PARTITION BY kb_id ORDER BY at_ DESC, index_id DESC) AS n FROM gen WHERE status = 'active' AND kb_id % 10 <> 3) WHERE n = 1),
  k AS (SELECT DISTINCT kb_id FROM gen) SELECT kb_id, index_id, CASE WHEN index_id IS NOT NULL THEN 'active' WHEN kb_id % 2 = 1 THEN 'missing' ELSE 'legacy' END AS state FROM k LEFT JOIN a USING (kb_id)""")
def active(spark: SparkSession, d: str) -> DataFrame:
    g = generations(spark, d)
    kbs = g.select("kb_id").distinct().withColumn("managed", F.col("kb_id") % 2 == 1)
    return I.active_generations(g.where("kb_id % 10 <> 3"), kbs)


@query("I8", f"""WITH {GEN}, c AS (SELECT *, index_id % 100 = 7 AS wanted, index_id % 100 = 7 AND source_fingerprint = '1' AS ok FROM gen), w AS (SELECT *, bool_or(ok) OVER (PARTITION BY kb_id) AS won FROM c)
  SELECT index_id, kb_id, CASE WHEN ok THEN 'active' WHEN wanted THEN 'stale' WHEN won AND status = 'active' THEN 'ready' ELSE status END AS status FROM w""")
def activate(spark: SparkSession, d: str) -> DataFrame:
    g = generations(spark, d)
    return I.activate(g, fingerprints(spark, d), g.where("index_id % 100 = 7")).select("index_id", "kb_id", "status")


@query("I9", f"""WITH {GEN}, n AS (SELECT *, row_number() OVER (PARTITION BY kb_id, status = 'active' ORDER BY at_ DESC, index_id) AS n FROM gen)
  SELECT index_id, CASE WHEN status = 'active' THEN 'active' WHEN index_id % 50 = 9 THEN 'in_use' WHEN status = 'ready' AND source_fingerprint <> '1' THEN 'stale_ready'
    WHEN n > 40 THEN 'excess' WHEN at_ < TIMESTAMP '1998-07-01' - INTERVAL 365 DAYS THEN 'expired' ELSE 'kept' END AS class FROM n""")
def retention(spark: SparkSession, d: str) -> DataFrame:
    g = generations(spark, d)
    return I.retention(g, fingerprints(spark, d), g.where("index_id % 50 = 9"), F.lit("1998-07-01").cast("timestamp"), keep=40, days=365).select("index_id", "class")


@query("I10", f"""WITH {DOCS}, s AS (SELECT doc_id, content_hash, CASE WHEN doc_id % 9 = 0 THEN -1 ELSE source_revision END AS r FROM dm WHERE doc_id % 5 <> 1), c AS (SELECT * FROM dm WHERE status IN ('ready', 'failed', 'processing'))
  SELECT doc_id, CASE WHEN s.doc_id IS NULL THEN 'added' WHEN c.doc_id IS NULL THEN 'removed' ELSE 'changed' END AS change FROM s FULL JOIN c USING (doc_id)
  WHERE s.doc_id IS NULL OR c.doc_id IS NULL OR s.r <> c.source_revision""")
def reconcile(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d)
    snap = docs.where("doc_id % 5 <> 1").withColumn("source_revision", F.when(F.col("doc_id") % 9 == 0, -1).otherwise(F.col("source_revision")))
    now = docs.where("status IN ('ready', 'failed', 'processing')").withColumn("status", F.lit("ready"))
    return I.reconcile_plan(snap, now)


@query("I11", f"""WITH {DOCS}, a AS (SELECT *, count(*) OVER (PARTITION BY tenant_id, content_hash) AS n FROM dm)
  SELECT doc_id, concat_ws(',', CASE WHEN status = 'processing' AND updated_at < 1704067200 + 300000 THEN 'stuck' END, CASE WHEN status = 'ready' AND chunks_count = 0 THEN 'no_chunks' END,
    CASE WHEN status = 'ready' AND embedding_model <> 'm' THEN 'model_mismatch' END, CASE WHEN n > 1 THEN 'duplicate' END) AS flags FROM a""")
def audit(spark: SparkSession, d: str) -> DataFrame:
    now = F.timestamp_seconds(F.lit(1704067200 + 300000 + 1800))
    return I.repair_audit(documents(spark, d), "m", now).withColumn("flags", F.array_join("flags", ","))


def jobs(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        k.alias("job_id"), (F.col("o_custkey") % 20).cast("string").alias("tenant_id"), F.col("o_custkey").alias("doc_id"), _pick(k % 5, JOB_STATUSES).alias("status"), (k % 4).cast("int").alias("attempts"),
        F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("locked_at"), F.col("o_orderdate").alias("updated_at"),
    )


_J = "['" + "', '".join(JOB_STATUSES) + "']"
JOBS = f"jobs AS (SELECT o_orderkey AS job_id, (o_custkey % 20)::VARCHAR AS tenant_id, o_custkey AS doc_id, ({_J})[o_orderkey % 5 + 1] AS status, o_orderkey % 4 AS attempts, o_orderdate AS at_ FROM orders)"


@query("I12", f"""WITH {JOBS}, n AS (SELECT *, status IN ('queued', 'running') AS act, row_number() OVER (PARTITION BY doc_id, status IN ('queued', 'running') ORDER BY CASE WHEN status = 'running' THEN 0 ELSE 1 END, at_, job_id) AS n FROM jobs)
  SELECT job_id, CASE WHEN act AND n > 1 THEN 'cancelled' ELSE status END AS status FROM n""")
def supersede(spark: SparkSession, d: str) -> DataFrame:
    return I.supersede_jobs(jobs(spark, d), ["doc_id"]).select("job_id", "status")


@query("I13", f"""WITH {JOBS}, a AS (SELECT *, status = 'running' AND at_ < TIMESTAMP '1998-08-01' - INTERVAL 1000 DAYS AS stale_lease, attempts >= 3 AS exhausted, status IN ('succeeded', 'failed', 'cancelled') AS ended FROM jobs),
  b AS (SELECT *, (status = 'queued' OR stale_lease) AND NOT exhausted AS run FROM a)
  SELECT job_id, stale_lease, exhausted, CASE WHEN run THEN row_number() OVER (PARTITION BY tenant_id, run ORDER BY at_, job_id) END::INTEGER AS runnable_rank,
    CASE WHEN ended AND row_number() OVER (PARTITION BY tenant_id, ended ORDER BY at_ DESC, job_id) <= 10 THEN row_number() OVER (PARTITION BY tenant_id, ended ORDER BY at_ DESC, job_id) END::INTEGER AS history_rank,
    ended AND at_ < TIMESTAMP '1998-08-01' - INTERVAL 365 DAYS AS prunable FROM b""")
def board(spark: SparkSession, d: str) -> DataFrame:
    b = I.job_board(jobs(spark, d), F.lit("1998-08-01").cast("timestamp"), lease_seconds=1000 * 86400, keep_days=365)
    return b.select("job_id", "stale_lease", "exhausted", "runnable_rank", "history_rank", "prunable")


@query("I14", """WITH b AS (SELECT o_custkey AS batch_id, list_distinct(list(l_partkey)) AS ids, min(o_orderdate) AS at_ FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
  r AS (SELECT o_orderkey AS request_id, list_distinct(list(l_partkey)) AS ids FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey % 20 = 0 GROUP BY ALL)
  SELECT request_id, arg_min(batch_id, struct_pack(at_ := at_, b := batch_id)) AS batch_id FROM r JOIN b ON list_has_all(b.ids, r.ids) GROUP BY request_id""")
def covering(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    kb, state = F.lit("k").alias("kb_id"), F.lit("queued").alias("status")
    batches = lines.groupBy(F.col("o_custkey").alias("batch_id")).agg(F.collect_set("l_partkey").alias("doc_ids"), F.min("o_orderdate").alias("created_at")).select("*", kb, state)
    asks = lines.where("o_orderkey % 20 = 0").groupBy(F.col("o_orderkey").alias("request_id")).agg(F.collect_set("l_partkey").alias("doc_ids")).select("*", kb)
    return I.covering_batch(batches, asks)


def messages(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("conv_id")
    return table(spark, d, "conversations").select(
        i.alias("conversation_id"), (F.col("turn") + 1).alias("seq"), "role", F.col("text").alias("content"), F.timestamp_seconds(F.lit(1704067200) + i * 1000 + F.col("turn")).alias("created_at"),
        F.when((F.col("role") == "assistant") & (i % 3 != 0), F.array(i, i + 1)).otherwise(F.array().cast("array<long>")).alias("doc_ids"),
    )


@query("I15", """WITH m AS (SELECT conv_id, count(*) AS n, 1704067200 + conv_id * 1000 + max(turn) AS at_ FROM conversations WHERE conv_id % 4 <> 0 GROUP BY conv_id), c AS (SELECT DISTINCT conv_id, 1704067200 + conv_id AS created FROM conversations)
  SELECT conv_id AS conversation_id, coalesce(n, 0) AS message_count, coalesce(at_, created) AS last_at FROM c LEFT JOIN m USING (conv_id) ORDER BY last_at DESC, conversation_id LIMIT 60""")
def conversation_list(spark: SparkSession, d: str) -> DataFrame:
    m = messages(spark, d)
    c = m.select("conversation_id").distinct().withColumn("created_at", F.timestamp_seconds(F.lit(1704067200) + F.col("conversation_id")))
    return I.list_conversations(c, m.where("conversation_id % 4 <> 0"), 60).withColumn("last_at", F.unix_timestamp("last_at"))


@query("I16", """WITH b AS (SELECT conv_id, turn + 1 AS seq, role FROM conversations WHERE turn < 3), n AS (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE turn >= 3)
  SELECT conv_id AS conversation_id, seq, role FROM b UNION ALL SELECT conv_id, coalesce((SELECT max(seq) FROM b WHERE b.conv_id = n.conv_id), 0) + n, role FROM n""")
def append(spark: SparkSession, d: str) -> DataFrame:
    m = messages(spark, d).select("conversation_id", "seq", "role")
    return I.append_messages(m.where("seq <= 3"), m.where("seq > 3").withColumnRenamed("seq", "ord"))


@query("I17", f"""WITH {DOCS}, l AS (SELECT DISTINCT conv_id FROM conversations WHERE role = 'assistant' AND conv_id % 3 <> 0), e AS (SELECT conv_id, conv_id AS doc_id FROM l UNION ALL SELECT conv_id, conv_id + 1 FROM l)
  SELECT conv_id AS conversation_id, bool_and(coalesce(status IN ('ready', 'reindexing', 'reindex_queued'), FALSE)) AS reusable FROM e LEFT JOIN dm USING (doc_id) GROUP BY conv_id""")
def reuse(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d).withColumn("status", F.when(F.col("status").isin("ready", "reindexing", "reindex_queued"), "ready").otherwise("no"))
    return I.latest_sources(messages(spark, d), docs, []).select("conversation_id", "reusable")


@query("I18", r"""WITH m AS (SELECT conv_id, turn, role, trim(text) AS content, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations),
  v AS (SELECT *, floor(len(regexp_extract_all(content[:600], '[^\s]+')) * 1.2)::INTEGER AS t, content[:600] AS c FROM m WHERE r <= 6 AND role IN ('user', 'assistant') AND content <> ''),
  u AS (SELECT *, sum(t) OVER (PARTITION BY conv_id ORDER BY r) - t AS used FROM v), s AS (SELECT *, min(CASE WHEN used + t > 200 THEN r END) OVER (PARTITION BY conv_id) AS stop FROM u)
  SELECT conv_id AS conversation_id, turn + 1 AS seq, role, CASE WHEN r = stop THEN right(c, greatest(1, floor(length(c) * ((200 - used)::DOUBLE / greatest(t, 1)))::BIGINT)) ELSE c END AS content
  FROM s WHERE stop IS NULL OR r < stop OR (r = stop AND 200 - used >= 64)""")
def history(spark: SparkSession, d: str) -> DataFrame:
    m = messages(spark, d).withColumns({"status": F.lit("completed"), "source_idx": F.array().cast("array<int>")})
    return I.history_window(m, 6, 200, 600)


@query("I19", """WITH c AS (SELECT DISTINCT conv_id FROM conversations) SELECT conv_id AS conversation_id, CASE WHEN conv_id % 3 = 0 THEN '' WHEN conv_id % 3 = 1 THEN 'b' ELSE 'c' END AS kb_ids,
  CASE WHEN conv_id % 3 = 0 THEN 'assistant' ELSE 'knowledge' END AS mode FROM c""")
def detach(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("conversation_id") % 3
    c = messages(spark, d).select("conversation_id").distinct()
    ids = F.when(k == 0, F.array(F.lit("a"), F.lit("a"))).when(k == 1, F.array(F.lit("a"), F.lit("b"), F.lit("b"))).otherwise(F.array(F.lit("c")))
    out = I.detach_kb(c.select("conversation_id", ids.alias("kb_ids"), F.lit("knowledge").alias("mode")), "a")
    return out.withColumn("kb_ids", F.array_join("kb_ids", ","))


@query("I20", """SELECT 'documents' AS "table", count(*) AS rows FROM documents WHERE source = 'src3' UNION ALL SELECT 'labels', count(*) FROM labels JOIN documents USING (doc_id) WHERE source = 'src3'
  UNION ALL SELECT 'vectors', count(*) FROM embeddings JOIN documents ON doc_id = vec_id WHERE source = 'src3'""")
def purge(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return I.purge_plan({"documents": docs, "labels": table(spark, d, "labels"), "vectors": table(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id")}, docs.where("source = 'src3'"))


@query("I21", r"""WITH m AS (SELECT page_id, trim(CASE page_id % 3 WHEN 0 THEN 'failed at  ' || url || ' with api_key=s3cr3t, see /home/app/x' || page_id || '/log' || chr(10) || ' now ' || html
    WHEN 1 THEN html || ' Password: p' || page_id || ' in C:\data\x.txt end' ELSE 'plain ' || url || '  ' || html END) AS t FROM pages),
  a AS (SELECT page_id, regexp_replace(t, '(?i)\b(api[_-]?key|access[_-]?token|authorization|password)(\s*[:=]\s*)[^\s,;]+', '\1\2[已隐藏]', 'g') AS t FROM m),
  b AS (SELECT page_id, regexp_replace(t, '(?i)\b(?:https?|ftp)://[^\s<>"''`]+', '[已隐藏地址]', 'g') AS t FROM a),
  c AS (SELECT page_id, regexp_replace(t, '(^|[^\w])(?:[A-Za-z]:[\\/]|\\\\)[^\s<>"''`]+', '\1[已隐藏路径]', 'g') AS t FROM b),
  e AS (SELECT page_id, regexp_replace(t, '(^|[^\w])/(?:Users|home|tmp|var|private|opt|app|mnt|workspace)(?:/[^\s<>"''`]+)+', '\1[已隐藏路径]', 'g') AS t FROM c),
  f AS (SELECT page_id, trim(regexp_replace(t, '\s+', ' ', 'g')) AS t FROM e)
  SELECT page_id, CASE WHEN length(t) > 240 THEN rtrim(left(t, 237)) || '...' ELSE t END AS detail FROM f""")
def redacted(spark: SparkSession, d: str) -> DataFrame:
    """Messages around the whole page."""
    i = F.col("page_id")
    raw = F.when(i % 3 == 0, F.concat(F.lit("failed at  "), "url", F.lit(" with api_key=s3cr3t, see /home/app/x"), i.cast("string"), F.lit("/log\n now "), "html")).when(
        i % 3 == 1, F.concat("html", F.lit(" Password: p"), i.cast("string"), F.lit(r" in C:\data\x.txt end"))
    ).otherwise(F.concat(F.lit("plain "), "url", F.lit("  "), "html"))
    return table(spark, d, "pages").select("page_id", I.redact(raw).alias("detail"))
