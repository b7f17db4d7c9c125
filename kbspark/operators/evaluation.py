"""Evaluation of retrieval and answers (H)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kbspark.operators import answers as A


def find_ranks(results: DataFrame, expected: DataFrame) -> DataFrame:
    """(case_id, rank) of every result (case_id, rank, doc_id) whose document is expected (case_id, doc_id)."""
    return results.join(expected, ["case_id", "doc_id"], "left_semi").select("case_id", "rank")


def retrieval_rows(results: DataFrame, expected: DataFrame, cases: DataFrame, k: int = 3) -> DataFrame:
    """One row per case with hit_1, hit_k, rr, precision, recall.

    Precision divides by the number of distinct documents among the first k, recall by the number expected.
    """
    ranks = find_ranks(results, expected).groupBy("case_id").agg(F.min("rank").alias("best"))
    top = results.where(F.col("rank") <= k).where("doc_id IS NOT NULL").select("case_id", "doc_id").distinct()
    n_top = top.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_top"))
    good = top.join(expected, ["case_id", "doc_id"], "left_semi").groupBy("case_id").agg(F.count(F.lit(1)).alias("good"))
    n_exp = expected.distinct().groupBy("case_id").agg(F.count(F.lit(1)).alias("n_exp"))
    j = cases
    for other in (ranks, n_top, good, n_exp):
        j = j.join(other, "case_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return j.select(
        *cases.columns, zero((F.col("best") == 1).cast("int")).alias("hit_1"), zero((F.col("best") <= k).cast("int")).alias("hit_k"),
        F.coalesce(1 / F.col("best"), F.lit(0.0)).alias("rr"), (zero("good") / F.greatest(zero("n_top"), F.lit(1))).alias("precision"),
        (zero("good") / F.greatest(zero("n_exp"), F.lit(1))).alias("recall"),
    )


METRICS = {"hit_1": "hit_1", "hit_k": "hit_k", "mrr": "rr", "context_precision": "precision", "context_recall": "recall"}


def retrieval_metrics(results: DataFrame, expected: DataFrame, cases: DataFrame, k: int = 3, by: str | None = None) -> DataFrame:
    """Mean metrics over all cases (null in ``by``) and, if asked, per value of a column of ``cases``; cases (case_id, ...)."""
    rows = retrieval_rows(results, expected, cases, k)
    means = [F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(m) for m, c in METRICS.items()]
    total = [F.count(F.lit(1)).alias("cases"), *means]
    return rows.agg(*total) if by is None else rows.groupingSets([[], [F.col(by)]], F.col(by)).agg(*total)


def normalise_fact(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)[\s\W_]+", "")


def fact_coverage(answers: DataFrame, cases: DataFrame) -> DataFrame:
    """(case_id, coverage): share of fact groups of which a choice stands in the answer; 1 without groups.

    cases: case_id, expected_facts array<array<string>>; answers: case_id, answer.
    """
    j = cases.join(answers.select("case_id", normalise_fact(F.col("answer")).alias("a_")), "case_id", "left")
    met = F.filter("expected_facts", lambda g: F.exists(g, lambda c: F.contains(F.coalesce("a_", F.lit("")), normalise_fact(c))))
    n = F.size(F.coalesce("expected_facts", F.array().cast("array<array<string>>")))
    return j.select("case_id", F.round(F.when(n == 0, 1.0).otherwise(F.size(met) / n), 6).alias("coverage"))


def abstains(answer: Column) -> Column:
    text = F.trim(F.coalesce(answer, F.lit("")))
    groups = [reduce(lambda a, b: a & b, [F.contains(text, F.lit(s)) for s in g]) for g in A.ABSTENTIONS]
    return reduce(lambda a, b: a | b, groups)


def evaluate_answers(answers: DataFrame, cases: DataFrame, labels: DataFrame) -> DataFrame:
    """Verdict per case: answers (case_id, answer), cases (case_id, expected_facts, should_abstain, must_cite), labels (case_id, idx)."""
    a = answers.select(F.col("case_id").alias("answer_id"), "answer")
    lab = labels.select(F.col("case_id").alias("answer_id"), "idx")
    has_labels = lab.select("answer_id").distinct()
    bad = A.invalid_citations(a, lab).select("answer_id").distinct().withColumn("bad", F.lit(True))
    uncited = A.uncited_paragraphs(a).join(has_labels, "answer_id", "left_semi").select("answer_id").distinct().withColumn("uncited", F.lit(True))
    notes = A.leak_flags(a).select("answer_id", "has_internal_notes")
    j = a.join(bad, "answer_id", "left").join(uncited, "answer_id", "left").join(notes, "answer_id").withColumnRenamed("answer_id", "case_id")
    j = j.join(fact_coverage(answers, cases), "case_id").join(cases.select("case_id", "should_abstain", "must_cite"), "case_id")
    valid = F.col("bad").isNull() & F.col("uncited").isNull()
    j = j.withColumns({"abstained": abstains(F.col("answer")), "citation_valid": valid, "n_citations": F.size(A.citation_array(F.col("answer")))})
    good = ~F.col("abstained") & (F.col("coverage") == 1) & F.col("citation_valid") & (~F.col("must_cite") | (F.col("n_citations") > 0)) & ~F.col("has_internal_notes")
    passed = F.when(F.col("should_abstain"), F.col("abstained")).otherwise(good)
    return j.select("case_id", passed.alias("passed"), "abstained", F.col("should_abstain").alias("abstention_expected"), F.col("coverage").alias("fact_coverage"), "citation_valid", "has_internal_notes")


def answer_metrics(rows: DataFrame) -> DataFrame:
    share = lambda c: F.round(F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0)), 6).alias
    abst = F.avg(F.when(F.col("abstention_expected"), F.col("abstained").cast("double")))
    none = F.when(F.count(F.lit(1)) == 0, 0.0).otherwise(F.coalesce(abst, F.lit(1.0)))
    return rows.agg(share("passed")("answer_pass_rate"), share("fact_coverage")("fact_coverage"), share("citation_valid")("citation_valid_rate"), F.round(none, 6).alias("abstention_accuracy"))


def score_support(rows: DataFrame) -> DataFrame:
    """rows (case_id, category, expected_verdict, expected_indices, actual_verdict, actual_indices) plus the matches."""
    answerable = lambda c: c.isin("supported", "contradicted")
    v = F.lower(F.trim(F.coalesce("actual_verdict", F.lit(""))))
    match = v == F.col("expected_verdict")
    same = F.array_sort(F.array_distinct("actual_indices")) == F.array_sort(F.array_distinct("expected_indices"))
    return rows.withColumns({
        "verdict_match": match, "answerability_match": answerable(v) == answerable(F.col("expected_verdict")), "evidence_index_match": match & same, "passed": match & same,
    })


def support_metrics(rows: DataFrame, by: str = "category") -> DataFrame:
    names = {"case_pass_rate": "passed", "verdict_accuracy": "verdict_match", "answerability_accuracy": "answerability_match", "evidence_index_exact_match_rate": "evidence_index_match"}
    means = [F.round(F.avg(F.col(c).cast("double")), 6).alias(m) for m, c in names.items()]
    return rows.groupingSets([[], [F.col(by)]], F.col(by)).agg(F.count(F.lit(1)).alias("cases"), *means)


def latency_percentiles(rows: DataFrame, columns: list[str], ps: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """(metric, p50, p95, ...): nearest-rank percentiles, rounded to 2; rows of null do not count."""
    names = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in columns)
    long = rows.selectExpr(f"stack({len(columns)}, {names}) AS (metric, value)").where("value IS NOT NULL")
    pick = [F.expr(f"round(percentile_disc({p}) WITHIN GROUP (ORDER BY value), 2)").alias(f"p{round(p * 100)}") for p in ps]
    return long.groupBy("metric").agg(*pick)


def routing_report(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(match rates, counts per dimension): rows (decision, expected_decision, reason, expected_reasons, intent, origin, status, mode)."""
    exp = F.coalesce("expected_decision", F.lit(""))
    reasons = F.coalesce("expected_reasons", F.array().cast("array<string>"))
    d, r = (exp == "") | (F.col("decision") == exp), (F.size(reasons) == 0) | F.array_contains(reasons, F.col("reason"))
    rates = rows.agg(
        F.count(F.lit(1)).alias("case_count"), F.round(F.coalesce(F.avg(d.cast("double")), F.lit(0.0)), 6).alias("decision_match_rate"),
        F.round(F.coalesce(F.avg(r.cast("double")), F.lit(0.0)), 6).alias("reason_match_rate"),
    )
    dims = ", ".join(f"'{c}', coalesce(nullif(`{c}`, ''), 'unknown')" for c in ("intent", "origin", "status", "mode"))
    counts = rows.selectExpr(f"stack(4, {dims}) AS (dimension, value)").groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n"))
    return rates, counts


def release_gate(metrics: DataFrame, minimums: DataFrame) -> DataFrame:
    """(name, required, actual) of every minimum that its metric (name, value) misses; an unknown metric fails."""
    j = minimums.join(metrics.select("name", F.col("value").alias("actual")), "name", "left")
    return j.where(F.col("actual").isNull() | (F.col("actual") < F.col("required"))).select("name", "required", "actual")


def validate_cases(cases: DataFrame) -> DataFrame:
    """``cases`` (case_id, query, category, expected_doc_ids, should_abstain) plus reason, null if valid."""
    blank = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""
    n = F.count(F.lit(1)).over(Window.partitionBy("case_id"))
    docs = F.coalesce(F.size("expected_doc_ids"), F.lit(0))
    abstain = F.coalesce("should_abstain", F.lit(False))
    hollow = F.exists("expected_doc_ids", lambda x: F.trim(F.coalesce(x.cast("string"), F.lit(""))) == "")
    reason = (
        F.when(blank("case_id") | blank("query") | blank("category"), "required_field").when(n > 1, "duplicate_id")
        .when(abstain & (docs > 0), "abstain_with_documents").when(~abstain & (docs == 0), "no_documents").when(F.coalesce(hollow, F.lit(False)), "empty_document_id")
    )
    return cases.withColumn("reason", reason)


def compare_modes(modes: dict[str, DataFrame], expected: DataFrame, cases: DataFrame, k: int = 3) -> DataFrame:
    """Mean metrics per retrieval mode."""
    keyed = lambda d, m: d.withColumn("case_id", F.concat(F.lit(m + ":"), F.col("case_id").cast("string")))
    union = lambda f: reduce(lambda a, b: a.unionByName(b), [keyed(f(m), m) for m in modes])
    rows = retrieval_rows(union(lambda m: modes[m].select("case_id", "rank", "doc_id")), union(lambda m: expected), union(lambda m: cases.select("case_id")), k)
    means = [F.round(F.avg(c), 6).alias(m) for m, c in METRICS.items()]
    return rows.groupBy(F.substring_index("case_id", ":", 1).alias("mode")).agg(F.count(F.lit(1)).alias("cases"), *means)
