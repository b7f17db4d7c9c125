"""Checks over a table of answers (G): answers(answer_id, answer), labels(answer_id, idx), sources(answer_id, idx, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Patterns of answers (fixed values).
PREFIX = r"^[\s#>*\-\d.]+"  # marks before the words of a paragraph
CITATION = r"\[((?:\d+\s*(?:[,，、]\s*\d+\s*)*))\]"
EQUATION = r"(?<![\w.])(-?\d+(?:\.\d+)?)\s*([+\-*/×÷])\s*(-?\d+(?:\.\d+)?)\s*=\s*(-?\d+(?:\.\d+)?)(?![\w.])"
REFUSALS = ("资料未提及", "没有找到", "无法从参考资料")
INTERNAL_NOTES = (
    r"^[\s（(]*(?:注[:：]\s*)?(?:修正如下|更正如下)[:：]?",
    r"[（(]\s*注[:：][^）)]*(?:修正如下|更正如下|引用纠错|依据上下文逻辑|严格遵循指令|原文片段中未明确编号|编号|指令)[^）)]*[）)]?",
    r"引用纠错", r"依据上下文逻辑", r"严格遵循指令", r"原文片段中未明确编号", r"此处[^。；;\n]*修正",
)
LEAKS = (
    r"候选(?:片段|内容|资料)?\s*[#编号]?[一二三四五六七八九十\d]+", r"候选片段", r"根据(?:提供的)?候选",
    r"(?:第\s*)?[一二三四五六七八九十\d]+(?:个)?片段", r"内部对照(?:文本|内容|材料)?", r"根据(?:提供的)?(?:内部文本|对照文本|上述文本)",
)
INFERENCES = (r"很可能", r"大概率", r"(?:可以|可)?推测", r"暗示(?:着|是)?", r"考虑到", r"关联线索", r"故事背景(?:可能|或许)?", r"如果这是基于")
ABSTENTIONS = (("知识库", "资料不足"), ("知识库", "没有找到", "依据"), ("参考资料", "未提及"), ("当前资料", "无法"), ("补充", "相关资料"))


def any_of(text: Column, patterns: tuple[str, ...]) -> Column:
    return text.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns))


def citation_array(answer: Column) -> Column:
    """Cited numbers: positive, in order of first mention, unique."""
    groups = F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(CITATION), F.lit(1))
    parts = F.flatten(F.transform(groups, lambda g: F.split(g, r"[\s,，、]+")))
    numbers = F.transform(F.filter(parts, lambda p: p.rlike(r"^\d{1,9}$")), lambda p: p.cast("int"))
    return F.array_distinct(F.filter(numbers, lambda n: n > 0))


def citations(answers: DataFrame) -> DataFrame:
    """(answer_id, pos, idx)"""
    return answers.select("answer_id", F.posexplode(citation_array(F.col("answer"))).alias("pos", "idx"))


def invalid_citations(answers: DataFrame, labels: DataFrame) -> DataFrame:
    """Citations that are not among the labels of their answer."""
    return citations(answers).join(labels.select("answer_id", "idx"), ["answer_id", "idx"], "left_anti").select("answer_id", "pos", "idx")


def _paragraphs(answers: DataFrame) -> DataFrame:
    parts = F.split(F.coalesce("answer", F.lit("")), r"\n\s*\n")
    p = answers.select("answer_id", F.posexplode(parts).alias("pos", "paragraph"))
    return p.withColumn("bare", F.trim(F.regexp_replace("paragraph", PREFIX, "")))


def _lacks_citation(bare: Column) -> Column:
    return (F.length(bare) >= 8) & ~any_of(bare, REFUSALS) & (F.size(citation_array(bare)) == 0)


def uncited_paragraphs(answers: DataFrame) -> DataFrame:
    """(answer_id, paragraph): numbers, from 1, of paragraphs of 8 or more characters that are no refusal and cite nothing."""
    return _paragraphs(answers).where(_lacks_citation(F.col("bare"))).select("answer_id", (F.col("pos") + 1).alias("paragraph"))


def leak_flags(answers: DataFrame) -> DataFrame:
    a = F.trim(F.coalesce("answer", F.lit("")))
    return answers.select(
        "answer_id", (a == "").alias("empty_answer"), any_of(a, INTERNAL_NOTES).alias("has_internal_notes"),
        any_of(a, LEAKS).alias("leaks_internal_context"), any_of(a, INFERENCES).alias("infers_from_incomplete_context"),
    )


def arithmetic_errors(answers: DataFrame, most: int = 5) -> DataFrame:
    """(answer_id, pos, expression, expected): explicit equations off by more than half a unit of the reported precision.

    expected is null for a division by zero; the first ``most`` of an answer are reported.
    """
    a = F.coalesce("answer", F.lit(""))
    part = lambda n: F.regexp_extract_all(a, F.lit(EQUATION), F.lit(n))
    rows = answers.select("answer_id", F.posexplode(F.arrays_zip(*[part(n).alias(c) for n, c in enumerate(("e", "l", "o", "r", "v"))])).alias("pos", "x"))
    d = lambda c: F.col(f"x.{c}").cast("decimal(20,8)")
    op = F.col("x.o")
    value = (
        F.when(op == "+", d("l") + d("r")).when(op == "-", d("l") - d("r")).when(op.isin("*", "×"), (d("l") * d("r")).cast("decimal(38,8)"))
        .otherwise(F.when(d("r") != 0, d("l") / F.nullif(d("r"), F.lit(0).cast("decimal(20,8)")))).cast("decimal(38,8)")
    )
    places = F.length(F.regexp_extract("x.v", r"\.(\d+)$", 1))
    wrong = F.col("expected").isNull() | (F.abs(F.col("expected") - d("v")) > F.lit(0.5) * F.pow(F.lit(10.0), -F.col("places")))
    rows = rows.withColumns({"expected": value, "places": places}).where(wrong)
    n = F.row_number().over(Window.partitionBy("answer_id").orderBy("pos"))
    return rows.withColumn("n", n).where(F.col("n") <= most).select("answer_id", "pos", F.col("x.e").alias("expression"), F.round(F.col("expected").cast("double"), 6).alias("expected"))


# Fixed value: what counts as a term of an answer.
TERM = "[A-Za-z0-9][A-Za-z0-9_.:-]{1,}|[一-鿿]{2,}"


def repair_citations(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """``answers`` whose uncited paragraphs got the source (answer_id, idx, text) that shares most terms, if at least two; ties to the smaller idx."""
    p = _paragraphs(answers)
    terms = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(TERM), F.lit(0)))
    need = p.where(_lacks_citation(F.col("bare"))).select("answer_id", "pos", F.explode(terms(F.col("bare"))).alias("t"))
    have = sources.select("answer_id", "idx", F.explode(terms(F.col("text"))).alias("t"))
    shared = need.join(have, ["answer_id", "t"]).groupBy("answer_id", "pos", "idx").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    best = shared.groupBy("answer_id", "pos").agg(F.max(F.struct("n", (-F.col("idx")).alias("i")))["i"].alias("i"))
    fixed = p.join(best, ["answer_id", "pos"], "left")
    text = F.when(F.col("i").isNotNull(), F.concat(F.rtrim("paragraph"), F.lit(" ["), (-F.col("i")).cast("string"), F.lit("]"))).otherwise(F.col("paragraph"))
    joined = fixed.groupBy("answer_id").agg(F.sort_array(F.collect_list(F.struct("pos", text.alias("t")))).alias("p"))
    return joined.select("answer_id", F.array_join(F.transform("p", lambda x: x.t), "\n\n").alias("answer"))


def strip_invalid(answers: DataFrame, labels: DataFrame) -> DataFrame:
    """Answers whose citation brackets keep allowed numbers only (none left: the bracket goes), tidied."""
    allowed = labels.groupBy("answer_id").agg(F.collect_set("idx").alias("ok"))
    a = answers.join(allowed, "answer_id", "left").withColumn("ok", F.coalesce("ok", F.array().cast("array<int>")))
    # cut at brackets: a control character marks their places
    marked = F.regexp_replace(F.coalesce("answer", F.lit("")), CITATION, "\u0001$1\u0002")
    pieces = F.transform(
        F.split(marked, "\u0001"),
        lambda x, i: F.when((i == 0) | ~F.contains(x, F.lit("\u0002")), x).otherwise(F.concat(_bracket(F.substring_index(x, "\u0002", 1), F.col("ok")), F.substring_index(x, "\u0002", -1))),
    )
    clean = F.regexp_replace(F.array_join(pieces, ""), r"[ \t]+([，。！？；：])", "$1")
    return a.select("answer_id", F.trim(clean).alias("answer"))


def _bracket(numbers: Column, ok: Column) -> Column:
    n = F.transform(F.filter(F.split(numbers, r"[\s,，、]+"), lambda p: p.rlike(r"^\d{1,9}$")), lambda p: p.cast("int"))
    kept = F.array_distinct(F.filter(n, lambda x: F.array_contains(ok, x)))
    return F.when(F.size(kept) > 0, F.concat(F.lit("["), F.array_join(F.transform(kept, lambda x: x.cast("string")), "、"), F.lit("]"))).otherwise("")


def cited_sources(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """Sources in the order of their first citation."""
    return citations(answers).join(sources, ["answer_id", "idx"])


def contract_violations(answers: DataFrame, labels: DataFrame, most: int = 6) -> DataFrame:
    """(answer_id, n, code, detail): no valid citation where labels exist, then wrong equations; at most ``most`` each."""
    cited = citations(answers).join(labels, ["answer_id", "idx"], "left_semi").select("answer_id").distinct()
    missing = answers.select("answer_id").join(labels.select("answer_id").distinct(), "answer_id", "left_semi").join(cited, "answer_id", "left_anti")
    rows = missing.select("answer_id", F.lit(-1).alias("o"), F.lit("missing_required_citation").alias("code"), F.lit("").alias("detail"))
    rows = rows.unionByName(arithmetic_errors(answers).select("answer_id", F.col("pos").alias("o"), F.lit("invalid_arithmetic").alias("code"), F.col("expression").alias("detail")))
    n = F.row_number().over(Window.partitionBy("answer_id").orderBy("o"))
    return rows.withColumn("n", n).where(F.col("n") <= most).select("answer_id", "n", "code", "detail")


def parse_verdicts(raw: DataFrame) -> DataFrame:
    """(case_id, raw, n) -> case_id, status, indices; fails closed to ``unavailable``.

    Indices must be whole numbers from 1 to n; supported and contradicted need one.
    """
    obj = F.regexp_extract(F.trim(F.coalesce("raw", F.lit(""))), r"(?s)(\{.*\})", 1)
    p = F.from_json(obj, "verdict string, supported_indices array<string>")
    listed = F.coalesce(p["supported_indices"], F.array().cast("array<string>"))
    r = raw.select("case_id", "n", F.lower(F.trim(p["verdict"])).alias("v"), listed.alias("l"))
    whole = F.transform(F.filter("l", lambda x: x.rlike(r"^-?\d{1,9}$")), lambda x: x.cast("int"))
    ok = F.array_distinct(F.filter(whole, lambda x: (x >= 1) & (x <= F.col("n"))))
    r = r.withColumn("ok", F.coalesce(ok, F.array().cast("array<int>")))
    fine = F.col("v").isin("supported", "contradicted", "insufficient") & (~F.col("v").isin("supported", "contradicted") | (F.size("ok") > 0))
    fine = F.coalesce(fine, F.lit(False))
    return r.select("case_id", F.when(fine, F.col("v")).otherwise("unavailable").alias("status"), F.when(fine, F.col("ok")).otherwise(F.array().cast("array<int>")).alias("indices"))


#: Other names of claim kinds (fixed values).
CLAIM_KINDS = {"paraphrase": "fact", "calculation": "derived", "inference": "derived", "unknown": "boundary", "undisclosed": "boundary"}


#: Other names of a controller's actions and directions, and replies of a single word (fixed values).
ACTIONS = {
    "supported": "answer", "sufficient": "answer", "answer_boundary": "boundary", "explicit_boundary": "boundary", "known_unknown": "boundary", "insufficient": "abstain", "unsupported": "abstain",
    "conflicting": "conflict", "context": "expand", "expand_context": "expand",
}
KNOWN_ACTIONS = ("answer", "boundary", "expand", "retry", "partial", "conflict", "abstain")
DIRECTIONS = {"previous": "before", "next": "after", "around": "both", "前": "before", "后": "after", "前后": "both"}
LABELS = {
    "answer": ("answer", "supported", "可回答", "证据充分"), "boundary": ("boundary", "explicitboundary", "明确边界", "明确未披露"), "abstain": ("abstain", "insufficient", "unsupported", "无法回答", "证据不足"),
    "conflict": ("conflict", "conflicting", "冲突", "证据冲突"), "expand": ("expand", "context", "补上下文", "扩展上下文"),
}
CONTROL = "action string, supported_indices string, conflicting_indices string, %s string, retry_query string, expand_indices string, expand_direction string, reason_code string, claims string"


def _numbers(json: Column, n: Column) -> Column:
    """Whole numbers from 1 to ``n`` of a JSON number, string or list of them, unique in order; all else, as true or 1.5, goes."""
    items = F.when(F.trim(json).startswith("["), F.from_json(json, "array<string>")).otherwise(F.array(json))
    whole = F.transform(F.filter(items, lambda x: x.rlike(r"^\s*\d{1,9}\s*$")), lambda x: F.trim(x).cast("int"))
    return F.coalesce(F.array_distinct(F.filter(whole, lambda x: (x >= 1) & (x <= n))), F.array().cast("array<int>"))


def parse_controls(raw: DataFrame, allow_retry: bool = True, allow_expand: bool = False, missing_key: str = "missing_aspects") -> DataFrame:
    """(case_id, raw, n) -> case_id, action, supported, conflicting, missing, retry_query, expand, direction, reason, of replies in JSON or of one word.

    Fails closed: what is no JSON object, no known action, or lacks what its action needs (a source to answer by, two for a conflict, a query to retry
    with, passages to expand) is ``unavailable``.  Sources that are not listed come from the claims.  A retry or expansion that is not allowed any
    more is ``partial`` if it has both sources and missing aspects, else ``abstain``.  Aspects (the field ``missing_key`` of a reply): the first six, 120 characters each.
    """
    text = F.trim(F.coalesce("raw", F.lit("")))
    obj = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    r = raw.select("case_id", "n", obj.alias("obj"), F.lower(F.regexp_replace(text, r"[`*_#\s。.！!]+", "")).alias("word"), F.from_json(obj, CONTROL % f"`{missing_key}`" + ", broken string", {"columnNameOfCorruptRecord": "broken"}).alias("p"))
    n, none = F.col("n"), F.array().cast("array<int>")
    clean = lambda c: F.trim(F.coalesce(F.col(f"p.{c}"), F.lit("")))
    looked = lambda c, table: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c), c)
    claims = F.from_json("p.claims", "array<struct<statement:string,claim:string,kind:string,source_indices:string>>")
    aspects = F.col("p")[missing_key]
    listed = F.when(F.trim(aspects).startswith("["), F.slice(F.from_json(aspects, "array<string>"), 1, 6))
    missing = F.array_distinct(F.filter(F.transform(listed, lambda x: F.substring(F.trim(x), 1, 120)), lambda x: x != ""))
    r = r.withColumns({
        "a": looked(F.lower(clean("action")), ACTIONS), "claims": F.slice(F.coalesce(claims, F.array().cast("array<struct<statement:string,claim:string,kind:string,source_indices:string>>")), 1, 8),
        "m": F.coalesce(missing, F.array().cast("array<string>")), "q": F.substring(clean("retry_query"), 1, 1000), "e": _numbers(F.col("p.expand_indices"), n),
        "d": looked(F.lower(F.coalesce(F.nullif(clean("expand_direction"), F.lit("")), F.lit("both"))), DIRECTIONS), "code": F.substring(clean("reason_code"), 1, 80),
        "s": _numbers(F.col("p.supported_indices"), n), "c": _numbers(F.col("p.conflicting_indices"), n),
    })
    kind = lambda x: looked(F.lower(F.trim(F.coalesce(F.nullif(x.kind, F.lit("")), F.lit("fact")))), CLAIM_KINDS)
    said = lambda x: (F.trim(F.coalesce(F.nullif(x.statement, F.lit("")), x.claim, F.lit(""))) != "") & kind(x).isin("fact", "derived", "boundary", "conflict")
    of = lambda conflict: F.array_distinct(F.flatten(F.transform(F.filter("claims", lambda x: said(x) & ((kind(x) == "conflict") == F.lit(conflict))), lambda x: _numbers(x.source_indices, n))))
    r = r.withColumns({"s": F.when(F.size("s") > 0, F.col("s")).otherwise(of(False)), "c": F.when(F.size("c") > 0, F.col("c")).otherwise(of(True))})

    a, word, enough = F.col("a"), F.col("word"), (F.size("s") > 0) & (F.size("m") > 0)
    spent = lambda act: F.when(enough, F.struct(F.lit("partial").alias("action"), F.lit(f"evidence_{act}_exhausted_partial").alias("reason"))).otherwise(
        F.struct(F.lit("abstain").alias("action"), F.lit(f"evidence_{act}_exhausted").alias("reason"))
    )
    end = lambda action, reason: F.struct(F.lit(action).alias("action"), F.lit(reason).alias("reason"))
    bad = lambda reason: end("unavailable", f"evidence_controller_{reason}")
    is_ = lambda label: word.isin(*LABELS[label])
    bare = (
        F.when(is_("answer") & (n > 0), end("answer", "evidence_answer_bare_label")).when(is_("boundary") & (n == 1), end("boundary", "evidence_boundary_bare_label"))
        .when(is_("boundary"), end("unavailable", "evidence_boundary_bare_label_missing_support")).when(is_("abstain"), end("abstain", "evidence_abstain_bare_label"))
        .when(is_("conflict") & (n >= 2), end("conflict", "evidence_conflict_bare_label"))
        .when(is_("expand") & (n > 0), end("expand", "evidence_expand_bare_label") if allow_expand else end("abstain", "evidence_expand_exhausted")).otherwise(bad("invalid_json"))
    )
    plain = F.struct(a.alias("action"), F.coalesce(F.nullif("code", F.lit("")), F.concat(F.lit("evidence_"), a)).alias("reason"))
    retry = F.when(F.col("q") == "", bad("missing_retry_query")).otherwise(plain) if allow_retry else spent("retry")
    expand = F.when(F.size("e") == 0, bad("missing_expand_indices")).otherwise(plain) if allow_expand else spent("expand")
    read = (
        F.when(F.col("p.broken").isNotNull() | F.col("p").isNull(), bad("invalid_json")).when(~a.isin(*KNOWN_ACTIONS), bad("invalid_action"))
        .when(a.isin("answer", "boundary") & (F.size("s") == 0), bad("missing_support")).when((a == "partial") & ~enough, bad("invalid_partial"))
        .when((a == "conflict") & (F.size(F.array_union("s", "c")) < 2), bad("invalid_conflict")).when(a == "retry", retry).when(a == "expand", expand).otherwise(plain)
    )
    r = r.withColumn("out", F.when(F.col("obj") == "", bare).otherwise(read)).withColumn("all", F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(none))
    act, label, spent_ = F.col("out.action"), F.col("obj") == "", F.col("out.reason").contains("_exhausted")
    dead = act == "unavailable"
    keep = lambda c, empty, when=True: F.when(dead | label | (spent_ & F.lit(not when)), empty).otherwise(F.col(c))
    supported = F.when(label & act.isin("answer", "boundary"), F.col("all")).otherwise(F.when(spent_ & (act == "abstain"), none).otherwise(keep("s", none)))
    return r.select(
        "case_id", act.alias("action"), supported.alias("supported"), F.when(label & (act == "conflict"), F.col("all")).otherwise(keep("c", none, False)).alias("conflicting"),
        keep("m", F.array().cast("array<string>")).alias("missing"), keep("q", F.lit(""), False).alias("retry_query"),
        F.when(label & (act == "expand"), F.col("all")).otherwise(keep("e", none, False)).alias("expand"),
        F.when(F.col("d").isin("before", "after", "both") & ~(dead | label | spent_), F.col("d")).otherwise("both").alias("direction"), F.col("out.reason").alias("reason"),
    )


def parse_claims(raw: DataFrame) -> DataFrame:
    """(case_id, raw JSON list, n) -> case_id, pos, statement, kind, sources, expression.

    The first eight items; statements cut to 240 characters, expressions to 120; items without a
    statement, a known kind or a valid source go.
    """
    item = "statement string, claim string, kind string, source_indices string, expression string"
    rows = raw.select("case_id", "n", F.posexplode(F.slice(F.from_json("raw", f"array<struct<{item.replace(' string', ':string')}>>"), 1, 8)).alias("pos", "c"))
    rows = rows.select("case_id", "n", "pos", "c.*")
    statement = F.substring(F.trim(F.coalesce(F.nullif("statement", F.lit("")), "claim", F.lit(""))), 1, 240)
    kind = F.lower(F.trim(F.coalesce(F.nullif("kind", F.lit("")), F.lit("fact"))))
    names = F.create_map(*[F.lit(x) for kv in CLAIM_KINDS.items() for x in kv])
    kind = F.coalesce(names[kind], kind)
    listed = F.split(F.regexp_replace(F.coalesce("source_indices", F.lit("")), r"[\[\]\"\s]", ""), ",")
    numbers = F.transform(F.filter(listed, lambda x: x.rlike(r"^\d{1,9}$")), lambda x: x.cast("int"))
    ok = F.array_distinct(F.filter(numbers, lambda x: (x >= 1) & (x <= F.col("n"))))
    out = rows.select("case_id", "pos", statement.alias("statement"), kind.alias("kind"), ok.alias("sources"), F.substring(F.trim(F.coalesce("expression", F.lit(""))), 1, 120).alias("expression"))
    return out.where((F.col("statement") != "") & F.col("kind").isin("fact", "derived", "boundary", "conflict") & (F.size("sources") > 0))
