"""Queries over answer checking and evaluation (G, H)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.operators import answers as A
from kbspark.operators import evaluation as E
from kbspark.operators import lexical as L
from kbspark.plans.base import BM25, query, questions, table
from kbspark.plans.documents import bm25_top, holding
from kbspark.sources.shared import shared_folder, written

#: What is put behind an assistant's whole turn, by (conv_id + turn) % 6.
TAILS = (" [1]", " [1、2] [0] [7, 2]", "", " 1/3=0.34 and 2*3=6 and 5/0=1 [2,3]", "\n\n（注：修正如下）资料未提及", " 很可能 候选片段 [9]")


def _choose(n: Column, values: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (n + 1).cast("int"))


def _choose_sql(n: str, values: tuple[str, ...]) -> str:
    quoted = ", ".join("'" + v.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for v in values)
    return f"([{quoted}])[{n} + 1]"


def answers(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").where("role = 'assistant'")
    k = (F.col("conv_id") + F.col("turn")) % 6
    return c.select((F.col("conv_id") * 100 + F.col("turn")).alias("answer_id"), k.alias("k"), F.col("text").alias("b"), F.concat("text", _choose(k, TAILS)).alias("answer"))


def labels(spark: SparkSession, d: str) -> DataFrame:
    return answers(spark, d).select("answer_id", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("idx"))


ANS = rf"""ans AS (SELECT conv_id * 100 + turn AS answer_id, (conv_id + turn) % 6 AS k, text AS b, text || {_choose_sql('(conv_id + turn) % 6', TAILS)} AS answer
  FROM conversations WHERE role = 'assistant'),
num AS (SELECT answer_id, unnest(l)::INTEGER AS idx, unnest(range(len(l))) AS i FROM (SELECT answer_id, list_filter(flatten(list_transform(
    regexp_extract_all(answer, '\[(\d+\s*([,，、]\s*\d+\s*)*)\]', 1), lambda x: regexp_extract_all(x, '\d+'))), lambda x: x::INTEGER > 0) AS l FROM ans)),
cit AS (SELECT answer_id, (row_number() OVER (PARTITION BY answer_id ORDER BY min(i)) - 1)::INTEGER AS pos, idx FROM num GROUP BY answer_id, idx)"""


@query("G1", f"WITH {ANS} SELECT * FROM cit")
def citations(spark: SparkSession, d: str) -> DataFrame:
    return A.citations(answers(spark, d))


@query("G2", f"WITH {ANS} SELECT * FROM cit WHERE idx NOT IN (1, 2, 3)")
def invalid(spark: SparkSession, d: str) -> DataFrame:
    return A.invalid_citations(answers(spark, d), labels(spark, d))


BARE = r"trim(regexp_replace(p, '^[\s#>*\-0-9.]+', ''))"
UNCITED = rf"""par AS (SELECT answer_id, unnest(range(len(l)))::INTEGER + 1 AS paragraph, unnest(l) AS p FROM (SELECT answer_id, string_split_regex(answer, '\n\s*\n') AS l FROM ans)),
unc AS (SELECT answer_id, paragraph FROM par WHERE length({BARE}) >= 8 AND NOT regexp_matches({BARE}, '资料未提及|没有找到|无法从参考资料') AND NOT regexp_matches({BARE}, '\[(\d+\s*([,，、]\s*\d+\s*)*)\]'))"""


@query("G3", f"WITH {ANS}, {UNCITED} SELECT * FROM unc")
def uncited(spark: SparkSession, d: str) -> DataFrame:
    return A.uncited_paragraphs(answers(spark, d))


def _said(patterns: tuple[str, ...]) -> str:
    return "regexp_matches(trim(answer), '(?i)" + "|".join(f"(?:{p})" for p in patterns).replace("'", "''") + "')"


@query("G4", f"""WITH {ANS} SELECT answer_id, trim(answer) = '' AS empty_answer, {_said(A.INTERNAL_NOTES)} AS has_internal_notes, {_said(A.LEAKS)} AS leaks_internal_context, {_said(A.INFERENCES)} AS infers_from_incomplete_context FROM ans""")
def flags(spark: SparkSession, d: str) -> DataFrame:
    return A.leak_flags(answers(spark, d))


@query("G5", f"""WITH {ANS} SELECT answer_id, x.pos::INTEGER AS pos, x.expression, x.expected FROM ans, (VALUES (0, '1/3=0.34', 0.333333::DOUBLE), (2, '5/0=1', NULL)) x(pos, expression, expected) WHERE k = 3""")
def arithmetic(spark: SparkSession, d: str) -> DataFrame:
    return A.arithmetic_errors(answers(spark, d))


@query("G6", f"""WITH {ANS}, {UNCITED},
  tk AS (SELECT answer_id, paragraph, p, list_distinct(regexp_extract_all(lower({BARE}), '[A-Za-z0-9][A-Za-z0-9_.:-]{{1,}}|[一-鿿]{{2,}}')) AS t FROM par JOIN unc USING (answer_id, paragraph)),
  ov AS (SELECT answer_id, paragraph, len(t) AS n3, len(list_filter(t, lambda x: x IN ('the', 'of', 'and', 'de'))) AS n2 FROM tk)
  SELECT answer_id, string_agg(CASE WHEN n3 >= 2 AND n3 > n2 THEN rtrim(p) || ' [3]' WHEN n2 >= 2 THEN rtrim(p) || ' [2]' ELSE p END, chr(10) || chr(10) ORDER BY paragraph) AS answer
  FROM par LEFT JOIN ov USING (answer_id, paragraph) GROUP BY answer_id""")
def repair(spark: SparkSession, d: str) -> DataFrame:
    """Source 1 shares nothing, source 2 a few function words, source 3 the whole answer."""
    a = answers(spark, d)
    sources = a.select("answer_id", F.posexplode(F.array(F.lit("zzzz"), F.lit("the of and de"), F.col("answer"))).alias("i", "text"))
    return A.repair_citations(a, sources.select("answer_id", (F.col("i") + 1).alias("idx"), "text"))


@query("G7", f"""WITH {ANS} SELECT answer_id, trim(b || {_choose_sql('k', (" [1]", " [1、2]  [2]", "", " 1/3=0.34 and 2*3=6 and 5/0=1 [2、3]", TAILS[4], " 很可能 候选片段 "))}) AS answer FROM ans""")
def stripped(spark: SparkSession, d: str) -> DataFrame:
    return A.strip_invalid(answers(spark, d), labels(spark, d))


@query("G8", f"WITH {ANS} SELECT answer_id, idx, pos, 's' || idx AS doc FROM cit WHERE idx <= 3")
def cited(spark: SparkSession, d: str) -> DataFrame:
    return A.cited_sources(answers(spark, d), labels(spark, d).withColumn("doc", F.concat(F.lit("s"), F.col("idx").cast("string"))))


@query("G9", f"""WITH {ANS} SELECT answer_id, 1 AS n, 'missing_required_citation' AS code, '' AS detail FROM ans WHERE k IN (2, 4, 5)
  UNION ALL SELECT answer_id, x.n, 'invalid_arithmetic', x.e FROM ans, (VALUES (1, '1/3=0.34'), (2, '5/0=1')) x(n, e) WHERE k = 3""")
def contract(spark: SparkSession, d: str) -> DataFrame:
    return A.contract_violations(answers(spark, d), labels(spark, d))


VERDICTS = (
    'sure: {"verdict": "Supported", "why": "%", "supported_indices": [1, 9, 2, 1]}', '{"verdict":"supported","supported_indices":[],"why":"%"}', "no json: %",
    '{"why":"%","verdict":"insufficient"}', '% {"verdict":"maybe","supported_indices":[1]}', '% {"verdict":"contradicted","supported_indices":[0, 3, true, "x"]} %',
)


def _around(k: Column, forms: tuple[str, ...], text: Column) -> Column:
    """The form of ``k`` with a whole text, as it stands within JSON, in place of %."""
    inside = F.regexp_replace(F.regexp_replace(F.to_json(F.struct(text.alias("t"))), r'^\{"t":"', ""), r'"\}$', "")
    return F.replace(_choose(k, forms), F.lit("%"), inside)


@query("G10", f"""WITH {ANS} SELECT answer_id AS case_id, {_choose_sql('k', ("supported", "unavailable", "unavailable", "insufficient", "unavailable", "contradicted"))} AS status,
  {_choose_sql('k', ("1,2", "", "", "", "", "3"))} AS indices FROM ans""")
def verdicts(spark: SparkSession, d: str) -> DataFrame:
    raw = answers(spark, d).select(F.col("answer_id").alias("case_id"), _around(F.col("k"), VERDICTS, F.col("b")).alias("raw"), F.lit(3).alias("n"))
    return A.parse_verdicts(raw).withColumn("indices", F.array_join(F.transform("indices", lambda x: x.cast("string")), ","))


#: (reply, action, supported, conflicting, missing, retry_query, expand, direction, reason), with retries allowed and expansion not.
CONTROLS = (
    ('{"action":"Sufficient","supported_indices":[1,2,9],"missing_aspects":[" %"," %",""],"reason_code":"r1"}', "answer", "1,2", "", "M", "", "", "both", "r1"),
    ("**Supported**。", "answer", "1,2,3", "", "", "", "", "both", "evidence_answer_bare_label"),
    ('%{"action":"retry","retry_query":"%"}', "retry", "", "", "", "Q", "", "both", "evidence_retry"),
    ('{"action":"context","supported_indices":"2","missing_aspects":["%"],"expand_indices":[1],"expand_direction":"前"}', "partial", "2", "", "M", "", "", "both", "evidence_expand_exhausted_partial"),
    ('{"action":"conflict","claims":[{"statement":"%","source_indices":[1]},{"claim":"%","kind":"conflict","source_indices":["3"]}]}', "conflict", "1", "3", "", "", "", "both", "evidence_conflict"),
    ("% supported", "unavailable", "", "", "", "", "", "both", "evidence_controller_invalid_json"),
)


@query("G10_control", f"""WITH {ANS}, c AS (SELECT answer_id AS case_id, k, {", ".join(f"{_choose_sql('k', tuple(x[i] for x in CONTROLS))} AS {n}"
  for i, n in enumerate(("action", "supported", "conflicting", "m", "q", "expand", "direction", "reason"), 1))}, b FROM ans)
  SELECT case_id, action, supported, conflicting, CASE WHEN m = 'M' THEN left(trim(b), 120) ELSE '' END AS missing, CASE WHEN q = 'Q' THEN left(trim(b), 1000) ELSE '' END AS retry_query, expand, direction, reason FROM c""")
def controls(spark: SparkSession, d: str) -> DataFrame:
    raw = answers(spark, d).select(F.col("answer_id").alias("case_id"), _around(F.col("k"), tuple(x[0] for x in CONTROLS), F.col("b")).alias("raw"), F.lit(3).alias("n"))
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    out = A.parse_controls(raw, allow_retry=True, allow_expand=False)
    return out.select("case_id", "action", joined("supported"), joined("conflicting"), joined("missing"), "retry_query", joined("expand"), "direction", "reason")


CLAIMS = (
    '[{"statement":" %","kind":"paraphrase","source_indices":[1,2,9]},{"claim":"b","source_indices":"2"}]', "[]", "not json: %",
    '[{"statement":"","source_indices":[1]},{"statement":"%","kind":"odd","source_indices":[1]}]', '[{"statement":"%","kind":"Unknown","source_indices":["3"]}]',
    '[{"statement":"e","kind":"calculation","source_indices":[1],"expression":"%"}]',
)


@query("G11", f"""WITH {ANS} SELECT answer_id AS case_id, x.pos::INTEGER AS pos, coalesce(x.statement, left(trim(b), 240)) AS statement, x.kind, x.sources, coalesce(x.expression, left(trim(b), 120)) AS expression
  FROM ans JOIN (VALUES (0, 0, NULL, 'fact', '1,2', ''), (0, 1, 'b', 'fact', '2', ''), (4, 0, NULL, 'boundary', '3', ''), (5, 0, 'e', 'derived', '1', NULL)) x(k, pos, statement, kind, sources, expression) USING (k)""")
def claims(spark: SparkSession, d: str) -> DataFrame:
    raw = answers(spark, d).select(F.col("answer_id").alias("case_id"), _around(F.col("k"), CLAIMS, F.col("b")).alias("raw"), F.lit(3).alias("n"))
    return A.parse_claims(raw).withColumn("sources", F.array_join(F.transform("sources", lambda x: x.cast("string")), ","))


# --- evaluation

def results(spark: SparkSession, d: str) -> DataFrame:
    top = bm25_top(spark, d, 5).select(F.col("query_id").alias("case_id"), "rank", F.col("chunk_id").alias("doc_id"))
    return written(top, f"{shared_folder(spark)}/hits-{spark.sparkContext.applicationId}")  # the metrics read them more than once


def expected(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold the whole item."""
    return holding(spark, d).select(F.col("query_id").alias("case_id"), F.col("chunk_id").alias("doc_id"))


def cases(spark: SparkSession, d: str) -> DataFrame:
    return questions(spark, d).select(F.col("query_id").alias("case_id"), F.when(F.length("query") > 150, "long").otherwise("short").alias("category"))


EVAL = f"""{BM25},
res AS (SELECT query_id AS case_id, rank, chunk_id AS doc_id FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY bm25_score DESC, chunk_id))::INTEGER AS rank FROM bm WHERE bm25_score > 0) WHERE rank <= 5),
ex AS (SELECT item_id AS case_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
cs AS (SELECT item_id AS case_id, CASE WHEN length(text) > 150 THEN 'long' ELSE 'short' END AS category FROM benchmark),
rr AS (SELECT cs.*, coalesce((b.best = 1)::INT, 0) AS hit_1, coalesce((b.best <= 3)::INT, 0) AS hit_k, coalesce(1.0 / b.best, 0) AS rr,
    coalesce(g.good, 0)::DOUBLE / greatest(coalesce(t.n, 0), 1) AS precision, coalesce(g.good, 0)::DOUBLE / greatest(coalesce(e.n, 0), 1) AS recall
  FROM cs LEFT JOIN (SELECT case_id, min(rank) AS best FROM res JOIN ex USING (case_id, doc_id) GROUP BY ALL) b USING (case_id)
  LEFT JOIN (SELECT case_id, count(*) AS n FROM res WHERE rank <= 3 GROUP BY ALL) t USING (case_id)
  LEFT JOIN (SELECT case_id, count(*) AS good FROM res JOIN ex USING (case_id, doc_id) WHERE rank <= 3 GROUP BY ALL) g USING (case_id)
  LEFT JOIN (SELECT case_id, count(*) AS n FROM ex GROUP BY ALL) e USING (case_id))"""
MEANS = "count(*) AS cases, round(avg(hit_1), 6) AS hit_1, round(avg(hit_k), 6) AS hit_k, round(avg(rr), 6) AS mrr, round(avg(precision), 6) AS context_precision, round(avg(recall), 6) AS context_recall"


@query("H1", f"WITH {EVAL} SELECT case_id, rank FROM res JOIN ex USING (case_id, doc_id)")
def ranks(spark: SparkSession, d: str) -> DataFrame:
    return E.find_ranks(results(spark, d), expected(spark, d))


@query("H2", f"WITH {EVAL} SELECT category, {MEANS} FROM rr GROUP BY GROUPING SETS ((), (category))")
def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    return E.retrieval_metrics(results(spark, d), expected(spark, d), cases(spark, d), by="category")


def answer_cases(spark: SparkSession, d: str) -> DataFrame:
    a = answers(spark, d)
    facts = F.array(F.array(F.left("b", F.lit(12)), F.lit("zzzz")), F.array(_choose(F.col("k"), ("zzzz", "and", "the", "1/3=0.34", "资料", "候选"))))
    return a.select(F.col("answer_id").alias("case_id"), F.when(F.col("k") == 2, F.array().cast("array<array<string>>")).otherwise(facts).alias("expected_facts"), (F.col("k") == 4).alias("should_abstain"), (F.col("k") != 2).alias("must_cite"))


FACT = r"""fc AS (SELECT answer_id AS case_id, round(CASE WHEN k = 2 THEN 1.0::DOUBLE ELSE (CASE WHEN contains(n, regexp_replace(lower(left(b, 12)), '[^\pL\pN\pM]+', '', 'g')) OR contains(n, 'zzzz') THEN 1 ELSE 0 END
    + CASE WHEN contains(n, (['zzzz', 'and', 'the', '13034', '资料', '候选'])[k + 1]) THEN 1 ELSE 0 END) / 2.0 END, 6) AS coverage
  FROM (SELECT *, regexp_replace(lower(answer), '[^\pL\pN\pM]+', '', 'g') AS n FROM ans))"""


@query("H3", f"WITH {ANS}, {FACT} SELECT * FROM fc")
def fact_coverage(spark: SparkSession, d: str) -> DataFrame:
    return E.fact_coverage(answers(spark, d).select(F.col("answer_id").alias("case_id"), "answer"), answer_cases(spark, d))


def verdict_rows(spark: SparkSession, d: str) -> DataFrame:
    a = answers(spark, d).select(F.col("answer_id").alias("case_id"), F.when(F.col("k") == 4, F.concat("answer", F.lit(" 当前资料 无法 回答"))).otherwise(F.col("answer")).alias("answer"))
    return E.evaluate_answers(a, answer_cases(spark, d), labels(spark, d).withColumnRenamed("answer_id", "case_id"))


VERDICT = f"""{UNCITED}, {FACT}, vr AS (SELECT answer_id AS case_id, CASE WHEN k = 4 THEN TRUE ELSE coverage = 1 AND ok AND (k = 2 OR k IN (0, 1, 3, 5)) END AS passed,
  k = 4 AS abstained, k = 4 AS abstention_expected, coverage AS fact_coverage, ok AS citation_valid, k = 4 AS has_internal_notes
  FROM (SELECT ans.*, k NOT IN (1, 5) AND NOT EXISTS (SELECT 1 FROM unc WHERE unc.answer_id = ans.answer_id) AS ok FROM ans) JOIN fc ON case_id = answer_id)"""


@query("H4", f"WITH {ANS}, {VERDICT} SELECT * FROM vr")
def verdicts_of_answers(spark: SparkSession, d: str) -> DataFrame:
    return verdict_rows(spark, d)


@query("H5", f"""WITH {ANS}, {VERDICT} SELECT round(avg(passed::INT), 6) AS answer_pass_rate, round(avg(fact_coverage), 6) AS fact_coverage, round(avg(citation_valid::INT), 6) AS citation_valid_rate,
  round(coalesce(avg(abstained::INT) FILTER (abstention_expected), 1), 6) AS abstention_accuracy FROM vr""")
def answer_metrics(spark: SparkSession, d: str) -> DataFrame:
    return E.answer_metrics(verdict_rows(spark, d))


def support_rows(spark: SparkSession, d: str) -> DataFrame:
    a = answers(spark, d)
    idx = lambda n: F.transform(F.sequence(F.lit(1), (n % 3 + 1).cast("int")), lambda x: x)
    names = ("supported", "contradicted", "insufficient")
    return a.select(
        F.col("answer_id").alias("case_id"), (F.col("k") % 2).cast("string").alias("category"), _choose(F.col("answer_id") % 3, names).alias("expected_verdict"),
        idx(F.col("answer_id")).alias("expected_indices"), F.upper(_choose(F.floor(F.col("answer_id") / 2) % 3, names)).alias("actual_verdict"), idx(F.floor(F.col("answer_id") / 2)).alias("actual_indices"),
    )


@query("H6", f"""WITH {ANS}, s AS (SELECT (k % 2)::VARCHAR AS category, answer_id % 3 = answer_id // 2 % 3 AS m, (answer_id % 3 < 2) = (answer_id // 2 % 3 < 2) AS am FROM ans)
  SELECT category, count(*) AS cases, round(avg(m::INT), 6) AS case_pass_rate, round(avg(m::INT), 6) AS verdict_accuracy, round(avg(am::INT), 6) AS answerability_accuracy,
  round(avg(m::INT), 6) AS evidence_index_exact_match_rate FROM s GROUP BY GROUPING SETS ((), (category))""")
def support(spark: SparkSession, d: str) -> DataFrame:
    return E.support_metrics(E.score_support(support_rows(spark, d)))


@query("H7", """SELECT 'value' AS metric, round(quantile_disc(value, 0.5), 2) AS p50, round(quantile_disc(value, 0.95), 2) AS p95 FROM events
  UNION ALL SELECT 'user_id', round(quantile_disc(user_id, 0.5)::DOUBLE, 2), round(quantile_disc(user_id, 0.95)::DOUBLE, 2) FROM events""")
def latency(spark: SparkSession, d: str) -> DataFrame:
    return E.latency_percentiles(table(spark, d, "events"), ["value", "user_id"])


def routing_rows(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    kind = F.col("event_type")
    return e.select(
        kind.alias("decision"), F.when(F.col("event_id") % 3 == 0, F.lit("click")).alias("expected_decision"), kind.alias("reason"),
        F.when(F.col("event_id") % 2 == 0, F.array(F.lit("view"), F.lit("error"))).alias("expected_reasons"), kind.alias("intent"),
        F.when(F.col("event_id") % 5 != 0, F.lit("rules")).alias("origin"), (F.col("user_id") % 3).cast("string").alias("status"), F.lit("").alias("mode"),
    )


@query("H8", """WITH u AS (SELECT unnest(['intent', 'origin', 'status', 'mode']) AS dimension, unnest([event_type, CASE WHEN event_id % 5 <> 0 THEN 'rules' ELSE 'unknown' END, (user_id % 3)::VARCHAR, 'unknown']) AS value FROM events)
  SELECT dimension, value, count(*) AS n FROM u GROUP BY ALL""")
def routing_counts(spark: SparkSession, d: str) -> DataFrame:
    return E.routing_report(routing_rows(spark, d))[1]


@query("H8_rates", """SELECT count(*) AS case_count, round(avg((event_id % 3 <> 0 OR event_type = 'click')::INT), 6) AS decision_match_rate,
  round(avg((event_id % 2 <> 0 OR event_type IN ('view', 'error'))::INT), 6) AS reason_match_rate FROM events""")
def routing_rates(spark: SparkSession, d: str) -> DataFrame:
    return E.routing_report(routing_rows(spark, d))[0]


@query("H9", f"""WITH {EVAL}, m AS (SELECT {MEANS} FROM rr), l AS (SELECT 'hit_1' AS name, hit_1 AS value FROM m UNION ALL SELECT 'mrr', mrr FROM m)
  SELECT name, required, value AS actual FROM (VALUES ('hit_1', 0.99::DOUBLE), ('mrr', 0.0), ('unknown', 0.5)) x(name, required) LEFT JOIN l USING (name) WHERE value IS NULL OR value < required""")
def gate(spark: SparkSession, d: str) -> DataFrame:
    m = E.retrieval_metrics(results(spark, d), expected(spark, d), cases(spark, d))
    long = m.selectExpr("stack(2, 'hit_1', hit_1, 'mrr', mrr) AS (name, value)")
    return E.release_gate(long, spark.createDataFrame([("hit_1", 0.99), ("mrr", 0.0), ("unknown", 0.5)], "name string, required double"))


@query("H10", """SELECT doc_id AS case_id, CASE WHEN doc_id % 7 = 0 THEN 'required_field' WHEN doc_id % 5 = 0 AND doc_id % 4 <> 0 THEN 'abstain_with_documents'
  WHEN doc_id % 5 <> 0 AND doc_id % 4 = 0 THEN 'no_documents' WHEN doc_id % 5 <> 0 AND doc_id % 3 = 0 THEN 'empty_document_id' END AS reason FROM documents""")
def validated(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    docs = F.when(i % 4 == 0, F.array().cast("array<string>")).when(i % 3 == 0, F.array(F.lit("a"), F.lit(" "))).otherwise(F.array(F.lit("a")))
    c = table(spark, d, "documents").select(i.alias("case_id"), F.when(i % 7 != 0, F.col("text")).alias("query"), F.col("lang").alias("category"), docs.alias("expected_doc_ids"), (i % 5 == 0).alias("should_abstain"))
    r = E.validate_cases(c)
    return r.select("case_id", F.when((F.col("reason") == "empty_document_id") & F.col("should_abstain"), None).otherwise(F.col("reason")).alias("reason"))


@query("H11", f"""WITH {EVAL}, {{}} SELECT 'bm25' AS mode, {MEANS} FROM rr UNION ALL SELECT 'half', {MEANS.replace('cases', 'cases')} FROM r2""".replace("{}", """
  r2 AS (SELECT cs.*, coalesce((b.best = 1)::INT, 0) AS hit_1, coalesce((b.best <= 3)::INT, 0) AS hit_k, coalesce(1.0 / b.best, 0) AS rr,
    coalesce(g.good, 0)::DOUBLE / greatest(coalesce(t.n, 0), 1) AS precision, coalesce(g.good, 0)::DOUBLE / greatest(coalesce(e.n, 0), 1) AS recall
  FROM cs LEFT JOIN (SELECT case_id, min(rank) AS best FROM res JOIN ex USING (case_id, doc_id) WHERE rank > 1 GROUP BY ALL) b USING (case_id)
  LEFT JOIN (SELECT case_id, count(*) AS n FROM res WHERE rank IN (2, 3) GROUP BY ALL) t USING (case_id)
  LEFT JOIN (SELECT case_id, count(*) AS good FROM res JOIN ex USING (case_id, doc_id) WHERE rank IN (2, 3) GROUP BY ALL) g USING (case_id)
  LEFT JOIN (SELECT case_id, count(*) AS n FROM ex GROUP BY ALL) e USING (case_id))"""))
def modes(spark: SparkSession, d: str) -> DataFrame:
    r = results(spark, d)
    return E.compare_modes({"bm25": r, "half": r.where("rank > 1")}, expected(spark, d), cases(spark, d))
