"""Question requirements, evidence gates and stance on hand-made texts."""


from kbspark.operators import evidence as V
from kbspark.operators import hybrid as H


def requirements(spark, *questions):
    df = spark.createDataFrame(list(enumerate(questions)), "query_id int, query string")
    return V.requirement(df)


def parsed(spark, *questions):
    return [tuple(r.requirement) for r in requirements(spark, *questions).orderBy("query_id").collect()]


def test_kinds_and_terms(spark):
    got = parsed(
        spark, "Atlas 是什么平台？", "A1 和 B2 的区别", "cpm 门槛是多少", "林小北会开飞机吗", "林小北都会什么", "林小北住在哪里？", "总结这些文档", "MVP 是否包含批量私信或自动建联吗",
        "Hook 是什么", "atlas.pdf 的内容", "what is 42", "error code E42 多少", None, "几个吗",
    )
    want = [
        ("type", ["atlas"], [], [list(V.TYPE_TERMS["平台"])], []),
        ("relation", ["a1", "b2"], [], [], []),
        ("numeric", [], ["cpm"], [list(V.NUMERIC_TERMS["门槛"])], []),
        ("ability", ["林小北"], [], [], ["开飞机"]),
        ("ability", ["林小北"], [], [list(V.ABILITY_TERMS)], []),
        ("binding", ["林小北"], [], [list(V.LOCATION_TERMS)], []),
        ("collection_overview", [], [], [], []),
        ("negative_scope", ["mvp"], [], [["批量私信", "批量", "私信"], ["自动建联", "自动", "建联"]], []),
        ("definition", ["hook"], [], [list(V.DEFINITION_TERMS)], []),
        ("factual", [], [], [], []),
        ("factual", ["what", "42"], [], [], []),
        ("numeric", ["error", "code"], ["e42"], [], []),
        ("factual", [], [], [], []),
        ("factual", ["几个"], [], [], []),
    ]
    assert got == want




SCOPE = "MVP 是否包含批量私信或自动建联吗"
CASES = [
    (SCOPE, ["MVP 不包含批量私信，也不做自动建联"], True, [0], [0]),
    (SCOPE, ["MVP 不做批量的私信、自动的建联"], True, [0], [0]),
    (SCOPE, ["MVP 不包含批量私信"], False, [], [0]),
    (SCOPE, ["MVP 里有批量私信和自动建联"], False, [], [0]),
    (SCOPE, ["其他 支持批量私信和自动建联"], False, [], []),
    (SCOPE, ["MVP 不包含批量私信", "MVP 不包含自动建联"], False, [], [0, 1]),
    ("Hook 是什么", ["hook 用于测试"], True, [0], [0]),
    ("Hook 是什么", ["hooks 用于测试"], False, [], []),
    ("Hook 是什么", ["hook", "用于测试"], False, [], [0]),
    ("A1 和 B2 的区别", ["a1 与 b2 不同"], True, [0], [0]),
    ("A1 和 B2 的区别", ["a1", "b2"], False, [], [0, 1]),
    ("A1 和它的区别", ["a1"], False, [], [0]),
    ("cpm 门槛是多少", ["cpm >= 3"], True, [0], [0]),
    ("cpm 门槛是多少", ["ecpm 阈值"], False, [], [0]),
    ("林小北会开飞机吗", ["林小北", "开飞机"], True, [], [0]),
    ("林小北会开飞机吗", ["林小北开飞机"], True, [0], [0]),
    ("林小北住在哪里", ["林小北定居杭州", "林晓北住在杭州"], True, [0], [0]),
    ("alpha beta gamma delta", ["alpha", "beta"], True, [], [0, 1]),
    ("alpha beta gamma delta", ["alpha gamma", "x"], True, [0], [0]),
    ("alpha beta gamma delta", ["alpha"], False, [], [0]),
    ("总结这些文档", [" ", "a"], True, [1], [0, 1]),
    ("什么东西", ["a"], False, [0], []),
]


def test_twenty_texts(spark):
    texts = [(n, i, t) for n, (_, ts, *_) in enumerate(CASES) for i, t in enumerate(ts)]
    hits = spark.createDataFrame(texts, "query_id int, chunk_id int, text string")
    r = requirements(spark, *[q for q, *_ in CASES])
    ok = {x.query_id: x.sufficient for x in V.evidence_gate(r, hits).collect()}
    kept, weak = [[(x.query_id, x.chunk_id) for x in df.collect()] for df in (V.filter_evidence(hits, r), V.weak_context(hits, r))]
    for n, (q, ts, sufficient, alone, near) in enumerate(CASES):
        if q != "总结这些文档":
            assert (sorted(i for m, i in kept if m == n)) == alone, (q, ts)
        assert ok[n] is sufficient and sorted(i for m, i in weak if m == n) == near, (q, ts)


def test_supplement_needs_a_core(spark):
    r = requirements(spark, "A1 和 B2 的区别", "A1 和 B2 的区别", "Hook 是什么")
    rows = [(0, 0, "a1 b2"), (0, 1, "a1"), (0, 2, "c3"), (1, 0, "a1"), (1, 1, "b2"), (2, 0, "hook 是"), (2, 1, "hook")]
    hits = spark.createDataFrame(rows, "query_id int, chunk_id int, text string")
    core = V.filter_evidence(hits, r)
    got = sorted((x.query_id, x.chunk_id, x.core) for x in V.supplement(hits, r, core).collect())
    assert got == [(0, 0, True), (0, 1, False), (2, 0, True)]


def test_fields_count_as_evidence(spark):
    hits = spark.createDataFrame([(0, 0, "用于测试", "Hook"), (0, 1, None, None)], "query_id int, chunk_id int, text string, section_title string")
    assert [x.chunk_id for x in V.filter_evidence(hits, requirements(spark, "Hook 是什么")).collect()] == [0]


def test_stance_by_clause(spark):
    rows = [(0, 0, "支持批量私信，不支持自动建联"), (0, 1, "批量私信。不包含其他"), (0, 2, "不做自动的建联；批量私信也禁止"), (0, 3, "无关"), (0, 4, None)]
    hits = spark.createDataFrame(rows, "query_id int, chunk_id int, text string")
    got = sorted(tuple(x)[1:] for x in V.scope_stance(hits, requirements(spark, SCOPE)).collect())
    assert got == [(0, "批量私信", "included"), (0, "自动建联", "excluded"), (1, "批量私信", None), (2, "批量私信", "excluded"), (2, "自动建联", "excluded")]


def test_a_failing_request_keeps_its_order_and_no_other_s(spark):
    def scorer(query, texts):
        if query == "bad":
            raise RuntimeError("down")
        if query == "short":
            return [1.0]
        return [float(len(t)) for t in texts]

    rows = [(q, n, n + 1, query, "x" * n) for q, query in enumerate(("ok", "bad", "short", None)) for n in range(4)]
    hits = spark.createDataFrame(rows, "query_id int, chunk_id int, pos int, query string, text string")
    got = H.rerank_requests(hits, scorer, pool=3).orderBy("query_id", "pos").collect()
    order = {q: [r.chunk_id for r in got if r.query_id == q] for q in range(4)}
    assert order == {0: [2, 1, 0, 3], 1: [0, 1, 2, 3], 2: [0, 1, 2, 3], 3: [2, 1, 0, 3]}
    assert {(r.query_id, r.reranked, r.rerank_error) for r in got} == {(0, True, None), (1, False, "RuntimeError: down"), (2, False, "ValueError: 1 scores for 3 texts"), (3, True, None)}
    assert H.rerank_requests(hits.limit(0), scorer).count() == 0
