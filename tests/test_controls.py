"""Controller replies, as JSON and as single words, on hand-made cases."""

import json

from kbspark.operators import answers as A


def parsed(spark, replies, **how):
    df = spark.createDataFrame([(i, raw, n) for i, (raw, n) in enumerate(replies)], "case_id int, raw string, n int")
    return [tuple(r)[1:] for r in A.parse_controls(df, **how).orderBy("case_id").collect()]


def reply(**fields):
    return json.dumps(fields, ensure_ascii=False)


def row(action, reason, supported=(), conflicting=(), missing=(), query="", expand=(), direction="both"):
    return (action, list(supported), list(conflicting), list(missing), query, list(expand), direction, reason)


def test_words(spark):
    got = parsed(spark, [("`Answer`!", 2), ("可回答。", 0), ("boundary", 1), ("明确边界", 2), ("# insufficient", 3), ("conflict", 2), ("conflict", 1), ("expand", 2), ("I would answer", 2), (None, 2)])
    assert got == [
        row("answer", "evidence_answer_bare_label", (1, 2)), row("unavailable", "evidence_controller_invalid_json"), row("boundary", "evidence_boundary_bare_label", (1,)),
        row("unavailable", "evidence_boundary_bare_label_missing_support"), row("abstain", "evidence_abstain_bare_label"), row("conflict", "evidence_conflict_bare_label", conflicting=(1, 2)),
        row("unavailable", "evidence_controller_invalid_json"), row("abstain", "evidence_expand_exhausted"), row("unavailable", "evidence_controller_invalid_json"), row("unavailable", "evidence_controller_invalid_json"),
    ]
    assert parsed(spark, [("context", 3)], allow_expand=True) == [row("expand", "evidence_expand_bare_label", expand=(1, 2, 3))]


def test_objects(spark):
    replies = [
        (reply(action="supported", supported_indices=[2, True, "1", 9, 2, 1.5, None]), 3),
        (reply(action="answer", supported_indices=[9]), 3),
        (reply(action="known_unknown", supported_indices=3, reason_code=" why "), 3),
        (reply(action="partial", supported_indices=[1], missing_aspects=[" a ", "a", "", "b" * 130, "c", "d", "e", "f"]), 3),
        (reply(action="partial", supported_indices=[1], missing_aspects="a"), 3),
        (reply(action="conflict", supported_indices=[1], conflicting_indices=["2"]), 3),
        (reply(action="conflict", supported_indices=[1], conflicting_indices=[1]), 3),
        (reply(action="answer", claims=[{"statement": "s", "source_indices": [2]}, {"claim": "t", "kind": "paraphrase", "source_indices": "3"}, {"statement": " ", "source_indices": [1]}, {"statement": "u", "kind": "odd", "source_indices": [1]}]), 3),
        (reply(action="maybe"), 3), ('{"action": "answer", ', 3), ("{broken}", 3), (reply(action=None), 3),
        ('so: {"action": "abstain"} .', 3),
    ]
    assert parsed(spark, replies) == [
        row("answer", "evidence_answer", (2, 1)), row("unavailable", "evidence_controller_missing_support"), row("boundary", "why", (3,)),
        row("partial", "evidence_partial", (1,), missing=("a", "b" * 120, "c", "d")), row("unavailable", "evidence_controller_invalid_partial"), row("conflict", "evidence_conflict", (1,), (2,)),
        row("unavailable", "evidence_controller_invalid_conflict"), row("answer", "evidence_answer", (2, 3)), row("unavailable", "evidence_controller_invalid_action"),
        row("unavailable", "evidence_controller_invalid_json"), row("unavailable", "evidence_controller_invalid_json"), row("unavailable", "evidence_controller_invalid_action"), row("abstain", "evidence_abstain"),
    ]


def test_what_is_not_allowed_any_more(spark):
    retry = [(reply(action="retry", retry_query=" q "), 3), (reply(action="retry"), 3), (reply(action="retry", retry_query="q", supported_indices=[1], missing_aspects=["a"]), 3)]
    expand = [(reply(action="expand_context", expand_indices=[2], expand_direction="next"), 3), (reply(action="expand"), 3), (reply(action="expand", expand_indices=[1], expand_direction="up"), 3)]
    assert parsed(spark, retry) == [
        row("retry", "evidence_retry", query="q"), row("unavailable", "evidence_controller_missing_retry_query"), row("retry", "evidence_retry", (1,), missing=("a",), query="q"),
    ]
    assert parsed(spark, retry, allow_retry=False) == [
        row("abstain", "evidence_retry_exhausted"), row("abstain", "evidence_retry_exhausted"), row("partial", "evidence_retry_exhausted_partial", (1,), missing=("a",)),
    ]
    assert parsed(spark, expand, allow_expand=True) == [
        row("expand", "evidence_expand", expand=(2,), direction="after"), row("unavailable", "evidence_controller_missing_expand_indices"), row("expand", "evidence_expand", expand=(1,)),
    ]
    assert [r[0] for r in parsed(spark, expand)] == ["abstain"] * 3
