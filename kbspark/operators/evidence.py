"""What an answer's evidence must hold, and which hits hold it.

Queries (query_id, query), hits (query_id, chunk_id, text and, where present, the fields of :data:`FIELDS`).  Every term is looked up
once per hit, as a boolean; texts of several hits are never brought together.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kbspark.functions.text import STOP_WORDS

FIELDS = ("text", "section_title", "heading_path", "table_headers", "filename", "file_stem")

# Patterns and words of the question kinds (fixed values).
COLLECTION = (
    r"(?i)(总结|概述|归纳|概括|提炼|梳理|介绍|说说|讲讲).{0,16}(文档|资料|知识库|内容)|(这些|已上传|当前|全部|所有).{0,8}(文档|资料|内容).{0,16}(主要|重点|结论|观点|说了什么|讲了什么)"
    r"|\b(summari[sz]e|overview|key\s+(points?|takeaways?))\b"
)
LOCATION = (r"^(.+?)(?:住在|居住在|位于|来自)(?:哪里|哪儿|何处)$", r"^(.+?)(?:住哪里|住哪儿|在哪里|在哪儿|在何处)$")
LOCATION_TERMS = ("住在", "居住", "位于", "来自", "家在", "生活在", "定居", "地址", "所在地")
NEGATIVE_QUERY = r"(?:包含|包括|包不|有没有|是否|能不能|可以不可以|可不可以|支持不支持|做不做).+(?:吗|么|？|\?)$"
NEGATIVE_TERMS = ("批量", "私信", "建联", "自动", "骚扰", "绕过", "触达")
NEGATIVE_NOISE = "包不包含|是否包含|是否包括|包含不包含|包括不包括|有没有|能不能|可以不可以|可不可以|支持不支持|做不做"
CAPABILITIES = (
    ("批量私信", "批量", "私信"), ("自动建联", "自动", "建联"), ("自动触达", "自动", "触达"), ("批量", "批量"), ("私信", "私信"), ("建联", "建联"), ("骚扰", "骚扰"), ("绕过", "绕过"), ("触达", "触达"),
)
EXCLUDES = r"不包含|不包括|不做|不支持|不提供|不具备|不允许|禁止|未提供|不涉及|不覆盖|不在(?:本|该)?范围"
INCLUDES = "包含|包括|支持|提供|具备|允许"
TYPES = "平台|产品|项目|服务|应用|系统|工具|软件|网站"
TYPE_QUERY = f"(?:什么|哪种|哪类|何种|哪个|哪一)({TYPES})"
TYPE_TERMS = {
    "平台": ("平台", "服务", "应用", "系统", "工具", "软件", "网站", "产品"),
    "产品": ("产品", "服务", "应用", "工具", "软件", "系统", "平台"),
    "项目": ("项目", "工程", "方案", "系统", "服务", "应用", "产品"),
    "服务": ("服务", "平台", "应用", "系统", "产品", "工具"),
    "应用": ("应用", "app", "软件", "服务", "平台", "系统", "工具"),
    "系统": ("系统", "平台", "服务", "软件", "应用", "工具"),
    "工具": ("工具", "软件", "应用", "服务", "平台", "系统"),
    "软件": ("软件", "应用", "工具", "系统", "服务", "平台"),
    "网站": ("网站", "平台", "服务", "应用", "系统"),
}
RELATION_WORDS = ("关系", "关联", "联系", "区别", "不同", "差异", "对比", "比较")
RELATION = f"(和|与|跟|及|以及).*({'|'.join(RELATION_WORDS)})|({'|'.join(RELATION_WORDS)}).*(和|与|跟|及|以及)"
NUMERIC = r"(?i)多少|几(?:个|次|天|年|月|小时|分钟)?|数值|参数|门槛|价格|费用|成本|比例|百分比|时长|日期|版本|错误码|error\s*code|\bcode\b"
NUMERIC_TERMS = {
    "参数": ("参数", "配置", "设置", "选项"),
    "门槛": ("门槛", "阈值", "最低", "最高", "上限", "下限", "<=", ">="),
    "价格": ("价格", "售价", "定价", "费用", "成本", "元", "$"),
    "费用": ("费用", "价格", "收费", "成本", "元", "$"),
    "成本": ("成本", "费用", "价格", "元", "$"),
    "比例": ("比例", "占比", "百分比", "%"),
    "百分比": ("百分比", "比例", "占比", "%"),
    "时长": ("时长", "小时", "分钟", "秒", "天", "周期"),
    "日期": ("日期", "时间", "年", "月", "日", "发布"),
    "版本": ("版本", "v", "release", "发行"),
    "错误码": ("错误码", "错误", "error", "code", "异常"),
}
MEASURES = ("cpm", "cpc", "ctr", "roi", "gmv", "sku", "api", "url", "id")
BINDING = "(?:在|位于|来自|就职于|属于|负责|支持|使用|提供|包含)|(?:和|与).*(?:是同一个|同一)"
ABILITY = "(?:是否会|都?会(?:不会|做)?|擅长|能不能|是否能|能够|能做|可不可以|是否可以|可以|技能|能力|本领|专长)"
CLAIM = ("(?:会不会|能不能|可不可以|是否会|是否能|是否可以)(.+)$", "(?:能够|可以|擅长|会|能)(.+)$")
NO_CLAIM = ("什么", "些什么", "哪些", "啥", "什么技能", "什么能力", "哪些技能", "哪些能力")
ABILITY_TERMS = ("会", "能", "擅长", "精通", "熟悉", "掌握", "负责", "从事", "技能", "能力", "本领", "专长")
DEFINITION = r"(?i)^(?:[a-z][a-z0-9_.-]{1,31}|[一-鿿]{2,12})\s*(?:是(?:一个|一款|一种)?|叫|指)?\s*(?:什么(?:东西|玩意)?|什么意思|是啥|指什么)[？?。！!]*$"
DEFINITION_TERMS = ("是", "指", "定位", "用于", "面向", *TYPES.split("|"))
QUESTION_TERMS = (
    "什么 怎么 如何 哪些 多少 为什么 是否 包含 采用 制作 使用 系统 内容 资料 文档 问题 情况 信息 名字 这个 那个 当前 相关 具体 "
    "东西 玩意 意思 介绍 请问 一下 一下子 到底 叫 属于 类型 种类 方面 有关 了解 说说 方案"
).split()
FILE_NAME = r"(?i)[a-z0-9_\-一-鿿]+(?:\.[a-z0-9]{1,8})+"
#: No segmenter: these characters and words part what stands between them into terms.
PARTING = "|".join(sorted({*QUESTION_TERMS, *RELATION_WORDS}, key=lambda t: (-len(t), t))) + "|[的了吗呢么啥和与跟及是]"

_NO_TERMS, _NO_GROUPS = "array<string>", "array<array<string>>"


def _list(terms) -> Column:
    return F.array(*map(F.lit, terms))


def _looked_up(table: dict[str, tuple[str, ...]]) -> Column:
    return F.create_map(*[c for k, v in table.items() for c in (F.lit(k), _list(v))])


def anchors(text: Column, *ignored: str) -> Column:
    """The terms of a question that name something: runs of letters and digits of more than one character, in order, unique."""
    bare = F.regexp_replace(F.regexp_replace(text, FILE_NAME, " "), PARTING, " ")
    runs = F.regexp_extract_all(bare, F.lit(r"\p{IsHan}+|[\p{L}\p{N}&&[^\p{IsHan}]]+"), F.lit(0))
    drop = sorted({*STOP_WORDS, *ignored})
    return F.array_distinct(F.filter(runs, lambda t: (F.length(t) > 1) & ~t.isin(drop)))


def claims(q: Column) -> Column:
    """The ability that a closed question asks about (会开飞机吗 -> 开飞机), as an array of one or none."""
    said = F.when(q.rlike(CLAIM[0]), F.regexp_extract(q, CLAIM[0], 1)).otherwise(F.regexp_extract(q, CLAIM[1], 1))
    said = F.regexp_replace(F.regexp_replace(said, r"[？?。！!\s]*$", ""), "^[：:，,；;、 ]+|[：:，,；;、 ]+$", "")
    bare = F.trim(F.regexp_replace(said, "[吗嘛呢]$|(?<!什)么$", ""))
    named = ~said.isin(*NO_CLAIM) & ~bare.isin("", *NO_CLAIM) & ~bare.rlike("什么|哪些|多少")
    return F.when(named, F.array(bare)).otherwise(F.array().cast(_NO_TERMS))


def _capability_groups(q: Column) -> Column:
    taken: list[tuple[tuple[str, ...], Column]] = []
    for group in CAPABILITIES:
        asked = F.contains(q, F.lit(group[0])) | reduce(Column.__and__, [F.contains(q, F.lit(t)) for t in group[1:]])
        for other, got in taken:
            if set(other[1:]) & set(group[1:]):
                asked = asked & ~got
        taken.append((group, asked))
    return F.array_compact(F.array(*[F.when(asked, _list(group)) for group, asked in taken]))


def requirement(queries: DataFrame) -> DataFrame:
    """Plus requirement struct<kind, entities, aspects, groups, claims>: what an answer's evidence must hold.

    Kinds, in this order: collection_overview, binding (an open question of place), negative_scope, type, relation, numeric, binding, ability,
    definition, factual.  ``entities`` name the subject, ``aspects`` the measure asked for; of each group of ``groups`` one term is needed,
    for negative_scope its first or all others; ``claims`` hold the ability of a closed question.
    """
    q = F.lower(F.trim(F.coalesce("query", F.lit(""))))
    bare = F.regexp_replace(q, r"[？?。！!\s]*$", "")
    subject = F.coalesce(*[F.nullif(F.regexp_extract(bare, p, 1), F.lit("")) for p in LOCATION])
    subject = F.nullif(F.regexp_replace(subject, "^[：:，,；;、 ]+|[：:，,；;、 ]+$", ""), F.lit(""))
    negative = q.rlike(NEGATIVE_QUERY) & q.rlike("|".join(NEGATIVE_TERMS))
    kind = (
        F.when(q.rlike(COLLECTION), "collection_overview").when(subject.isNotNull(), "place").when(negative, "negative_scope").when(q.rlike(TYPE_QUERY), "type").when(q.rlike(RELATION), "relation")
        .when(q.rlike(NUMERIC), "numeric").when(q.rlike(BINDING), "binding").when(q.rlike(ABILITY), "ability").when(q.rlike(DEFINITION), "definition").otherwise("factual")
    )
    able = F.when(q.rlike(ABILITY), F.regexp_replace(q, f"{ABILITY}.*$", " ")).otherwise(q)
    about = (
        F.when(F.col("k_") == "place", anchors(F.coalesce(subject, F.lit(""))))
        .when(F.col("k_") == "negative_scope", anchors(F.regexp_replace(F.regexp_replace(q, NEGATIVE_NOISE, " "), "|".join(NEGATIVE_TERMS), " ")))
        .otherwise(anchors(able))
    )
    r = queries.withColumn("k_", kind).withColumn("a_", F.when(F.col("k_") == "collection_overview", F.array().cast(_NO_TERMS)).otherwise(about))
    is_ = lambda *k: F.col("k_").isin(*k)
    asked = F.regexp_extract(q, TYPE_QUERY, 1)
    measure = lambda t: t.isin(*MEASURES) | t.rlike(r"^[a-z][a-z0-9_.-]*[0-9][a-z0-9_.-]*$")
    # 价格 and the like may stand within a longer run
    named = F.filter(_list(NUMERIC_TERMS), lambda t: F.contains(q, t))
    aspects = F.when(is_("numeric"), F.filter("a_", measure)).otherwise(F.array().cast(_NO_TERMS))
    claim = F.when(is_("ability"), claims(q)).otherwise(F.array().cast(_NO_TERMS))
    groups = (
        F.when(is_("place"), F.array(_list(LOCATION_TERMS))).when(is_("negative_scope"), _capability_groups(q)).when(is_("type"), F.array(F.element_at(_looked_up(TYPE_TERMS), asked)))
        .when(is_("numeric"), F.transform(named, lambda t: F.element_at(_looked_up(NUMERIC_TERMS), t))).when(is_("ability") & (F.size("c_") == 0), F.array(_list(ABILITY_TERMS)))
        .when(is_("definition"), F.array(_list(DEFINITION_TERMS))).otherwise(F.array().cast(_NO_GROUPS))
    )
    numbers = "|".join(NUMERIC_TERMS)
    rest = F.filter(F.transform("a_", lambda t: F.regexp_replace(t, numbers, "")), lambda t: F.length(t) > 1)
    entities = (
        F.when(is_("type"), F.filter(F.transform("a_", lambda t: F.regexp_replace(t, f"^(什么|哪种|哪类|何种|哪个|哪一)?({TYPES})$", "")), lambda t: F.length(t) > 1))
        .when(is_("numeric") & ((F.size("f_") > 0) | (F.size("g_") > 0)), F.array_except(F.array_distinct(rest), "f_")).otherwise(F.col("a_"))
    )
    r = r.withColumns({"c_": claim, "f_": aspects}).withColumn("g_", groups)
    plain = is_("numeric") & (F.size("f_") == 0) & (F.size("g_") == 0)  # nothing to measure: as any other question
    final = F.when(plain, "factual").when(is_("place"), "binding").otherwise(F.col("k_"))
    made = F.struct(final.alias("kind"), entities.alias("entities"), F.col("f_").alias("aspects"), F.col("g_").alias("groups"), F.col("c_").alias("claims"))
    return r.withColumn("requirement", made).drop("k_", "a_", "c_", "f_", "g_")


def contains_anchor(text: Column, term: Column) -> Column:
    """ASCII terms need boundaries, others match as substrings; both in lower case."""
    quoted = F.concat(F.lit(r"(?<![a-z0-9_.-])\Q"), term, F.lit(r"\E(?![a-z0-9_.-])"))
    return (term != "") & F.contains(text, term) & (~term.rlike("^[a-z0-9][a-z0-9_.-]*$") | F.regexp_like(text, quoted))


def evidence_text(hits: DataFrame) -> Column:
    """What a hit can be evidence by: its text and fields, in lower case, one per line."""
    return F.lower(F.concat_ws("\n", *[F.coalesce(F.col(c), F.lit("")) for c in FIELDS if c in hits.columns]))


SINGLE = ("definition", "type", "numeric", "relation", "binding", "negative_scope")


def _found(requirements: DataFrame, hits: DataFrame) -> DataFrame:
    """Hits with requirement ``r_`` and what they hold of it: ``e_`` (entities), ``m_`` (aspects, claims, groups), ``stance_``, ``some_`` (any text)."""
    j = hits.withColumn("t_", evidence_text(hits)).join(requirements.select("query_id", F.col("requirement").alias("r_")), "query_id")
    holds = lambda x: contains_anchor(F.col("t_"), x)
    all_of = lambda xs: F.forall(xs, holds)
    tail = lambda g: F.slice(g, 2, F.greatest(F.size(g) - 1, F.lit(0)))
    group = lambda g: F.when(F.col("r_.kind") == "negative_scope", holds(g[0]) | all_of(tail(g))).otherwise(F.exists(g, holds))
    must = F.concat(F.transform("r_.aspects", holds), F.transform("r_.claims", holds), F.transform("r_.groups", group))
    return j.withColumns({
        "e_": F.transform("r_.entities", holds), "m_": must, "stance_": F.regexp_like("t_", F.lit(f"{EXCLUDES}|{INCLUDES}")), "some_": F.trim("t_") != "",
    }).drop("t_")


def _askable() -> Column:
    """Whether a requirement can be met at all."""
    kind, n = F.col("r_.kind"), F.size("r_.entities")
    nothing = (n == 0) & (F.size("r_.aspects") == 0) & (F.size("r_.groups") == 0) & (F.size("r_.claims") == 0)
    return ~(kind.isin("definition", "type") & (n == 0)) & ~((kind == "relation") & (n < 2)) & ~((kind == "factual") & nothing)


def _enough(n: Column) -> Column:
    """How many of ``n`` entities a factual question needs."""
    return F.when(n == 1, 1).otherwise(F.least(n, F.greatest(F.lit(2), F.ceil(n / 2))))


def _whole() -> Column:
    """Whether one hit holds all that is required."""
    kind, yes = F.col("r_.kind"), lambda x: x
    context = F.when(kind == "type", F.exists("e_", yes)).when(kind == "negative_scope", (F.size("e_") == 0) | F.exists("e_", yes)).otherwise(F.forall("e_", yes))
    stance = (kind != "negative_scope") | F.col("stance_")
    return F.when(kind == "collection_overview", F.col("some_")).otherwise(_askable() & context & F.forall("m_", yes) & stance)


def evidence_gate(requirements: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, sufficient) for every query with hits.

    definition, type, numeric, relation, binding and negative_scope must be met by one hit, others by all hits together; a factual question
    is content with half of its entities, two at least.  A question of scope needs its context, each capability and a statement that includes or
    excludes, in one hit.
    """
    j = _found(requirements, hits)
    each = j.groupBy("query_id").agg(
        F.max(_whole().cast("int")).alias("one"), F.first(F.col("r_.kind")).alias("kind"), F.max(F.size("e_")).alias("n"), F.max(_askable().cast("int")).alias("askable"), F.max(F.col("some_").cast("int")).alias("some")
    )
    terms = j.select("query_id", F.posexplode(F.concat("e_", "m_")).alias("i", "ok")).groupBy("query_id", "i").agg(F.max(F.col("ok").cast("int")).alias("ok"))
    pooled = terms.join(each.select("query_id", "n"), "query_id").groupBy("query_id").agg(F.min("ok").alias("all"), F.sum(F.when(F.col("i") < F.col("n"), F.col("ok")).otherwise(0)).alias("matched"))
    r = each.join(pooled, "query_id", "left")
    together = (F.coalesce("all", F.lit(1)) == 1) | ((F.col("kind") == "factual") & (F.col("n") > 0) & (F.coalesce("matched", F.lit(0)) >= _enough(F.col("n"))))
    ok = F.when(F.col("kind") == "collection_overview", F.col("some") == 1).when(F.col("kind").isin(*SINGLE), F.col("one") == 1).otherwise((F.col("askable") == 1) & together)
    return r.select("query_id", ok.alias("sufficient"))


def filter_evidence(hits: DataFrame, requirements: DataFrame) -> DataFrame:
    """Hits that can support an answer alone, where the question needs that: every kind but collection_overview and a factual question of
    fewer than two entities, of which all hits stay.  A factual question is content with half of its entities here too."""
    kind, n = F.col("r_.kind"), F.size("r_.entities")
    half = (kind == "factual") & (n >= 2) & (F.size(F.filter("e_", lambda x: x)) >= _enough(n))
    free = (kind == "collection_overview") | ((kind == "factual") & (n < 2))
    return _found(requirements, hits).where(free | _whole() | half).select(*hits.columns)


def supplement(hits: DataFrame, requirements: DataFrame, accepted: DataFrame) -> DataFrame:
    """The accepted hits (query_id, chunk_id) and, for questions of relation with any of them, all hits that hold an entity; plus ``core``."""
    core = accepted.select("query_id", "chunk_id").distinct().withColumn("core", F.lit(True))
    j = _found(requirements, hits).join(core, ["query_id", "chunk_id"], "left").withColumn("core", F.coalesce("core", F.lit(False)))
    j = j.withColumn("any_", F.bool_or("core").over(Window.partitionBy("query_id")))
    return j.where(F.col("core") | (F.col("any_") & (F.col("r_.kind") == "relation") & F.exists("e_", lambda x: x))).select(*hits.columns, "core")


def weak_context(hits: DataFrame, requirements: DataFrame) -> DataFrame:
    """Hits that are visibly about the question though they don't answer it: they hold an entity or, where it has none, any aspect or term of a group."""
    j = hits.withColumn("t_", evidence_text(hits)).join(requirements.select("query_id", F.col("requirement").alias("r_")), "query_id")
    terms = F.when(F.size("r_.entities") > 0, F.col("r_.entities")).otherwise(F.concat("r_.aspects", F.flatten("r_.groups")))
    return j.where((F.col("r_.kind") == "collection_overview") | F.exists(terms, lambda x: contains_anchor(F.col("t_"), x))).select(*hits.columns)


def scope_stance(hits: DataFrame, requirements: DataFrame) -> DataFrame:
    """(query_id, chunk_id, capability, stance) for questions of scope: what the sentences of a hit that name a capability say of it.

    ``excluded`` where such a sentence excludes, else ``included`` where one includes, else null; a negation counts for its own clause, so
    "支持A，不支持B" includes A and excludes B.
    """
    q = requirements.where("requirement.kind = 'negative_scope'").select("query_id", F.explode("requirement.groups").alias("g"))
    clauses = F.split(F.lower(F.coalesce("text", F.lit(""))), r"[。！？!?；;\n，,]|但是|但|而")
    j = hits.select("query_id", "chunk_id", clauses.alias("s")).join(q, "query_id")
    names = lambda s: F.contains(s, F.col("g")[0]) | F.forall(F.slice("g", 2, F.greatest(F.size("g") - 1, F.lit(0))), lambda t: F.contains(s, t))
    j = j.withColumn("s", F.filter("s", names))
    excluded, included = F.exists("s", lambda s: s.rlike(EXCLUDES)), F.exists("s", lambda s: s.rlike(INCLUDES))
    return j.where(F.size("s") > 0).select("query_id", "chunk_id", F.col("g")[0].alias("capability"), F.when(excluded, "excluded").when(included, "included").alias("stance"))
