"""Hand-computed fixtures for folds, promotions, limits and streams."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from kbspark.functions import text as T
from kbspark.operators import answers as A
from kbspark.operators import chunking as C
from kbspark.operators import context as X
from kbspark.operators import documents as D
from kbspark.operators import evaluation as E
from kbspark.operators import hybrid as H
from kbspark.operators import lifecycle as L
from kbspark.operators import understanding as U
from kbspark.operators import vectors as V
from kbspark.sources import corpus
from kbspark.streaming import limits as J
from kbspark.streaming import stateful as S


def value(spark, column, **row):
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} string" for k in row)).select(column.alias("x")).first().x


def test_tokeniser_makes_han_bigrams_and_keeps_repeats(spark):
    assert value(spark, T.tokens(F.col("t")), t="Ab 知识库 ab-1 库") == ["ab", "知识", "识库", "ab", "1", "库"]
    assert value(spark, T.estimate_tokens(F.col("t")), t="一二三 ab") == 4


def chunks(spark, text, **kw):
    rows = C.recursive_chunks(spark.createDataFrame([(1, text)], "doc_id long, text string"), **kw).orderBy("idx").collect()
    return [r.text for r in rows]


def test_recursive_split_emits_no_text_twice(spark):
    text = "aaaa\n\n" + "bbbb bbbb bbbb" + "\n\ncccc"
    got = chunks(spark, text, size=9, overlap=0)
    assert got == ["aaaa", "bbbb bbbb", "bbbb", "cccc"]


def test_overlong_word_stays_whole(spark):
    assert chunks(spark, "x" * 30 + " yy", size=10, overlap=0) == ["x" * 30, "yy"]
    assert chunks(spark, "   ", size=2, overlap=0) == []


def test_small_neighbours_merge_and_overlap(spark):
    assert chunks(spark, "ab. cd. " + "e" * 8, size=10, overlap=0)[0].startswith("ab")
    got = chunks(spark, "aaaaaaaa\n\nbbbbb", size=10, overlap=4)
    assert got == ["aaaaaaaa", "aaaabbbbb"]


def test_sentence_chunks_cut_long_sentences_at_clauses_then_hard(spark):
    df = spark.createDataFrame([(1, "One. Two. " + "a" * 12 + ", " + "b" * 5 + ".")], "doc_id long, text string")
    got = [r.text for r in C.sentence_chunks(df, size=10, overlap=0).orderBy("idx").collect()]
    assert got == ["One.Two.", "aaaaaaaaaa", "aa,", "bbbbb."]


def test_recent_repeats(spark):
    df = spark.createDataFrame([(["a", "b", "a", "c", "d", "a", "a", None],)], "p array<string>")
    assert df.select(D.drop_recent_repeats(F.col("p")).alias("x")).first().x[:5] == ["a", "b", "c", "d", "a"]


def test_parents_keep_a_heading_with_its_table(spark):
    rows = [(1, 0, "heading", "H", "H"), (1, 1, "table", "T", "H"), (1, 2, "paragraph", "p", "H"), (1, 3, "paragraph", "q", "H"), (1, 4, "paragraph", "r", "K"), (1, 5, "code", "c", "K")]
    got = C.build_parents(spark.createDataFrame(rows, "doc_id long, pos int, kind string, text string, heading_path string")).orderBy("parent_index").collect()
    assert [(r.text, r.kind) for r in got] == [("H\nT", "table"), ("p\nq", "paragraph"), ("r", "paragraph"), ("c", "code")]


def test_children_drop_the_separator_and_respect_the_budget():
    got = C.split_by_budget("one two. three four. five six", "", target=5, hard=5, continuity=0)
    assert got == ["one two\nthree four", "five six"]
    assert C.split_by_budget("", "", 5, 5, 0) == []
    assert all(C._tokens(x) <= 5 for x in C.split_by_budget("w " * 40, "p", 5, 5, 2))


def test_html_blocks(spark):
    page = "<html><head><title>T</title><script>var a='</p>';</script></head><body><nav><p>menu</p></nav><main><h1>One</h1><p>x<br>y</p><p>x y</p><h2>Two</h2><ul><li>i</li></ul></main><p>out</p></body></html>"
    pages = spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")
    got = [(r.kind, r.text, r.heading_path) for r in D.html_blocks(pages).orderBy("pos").collect()]
    assert got == [("heading", "One", "One"), ("paragraph", "x y", "One"), ("heading", "Two", "One > Two"), ("list_item", "i", "One > Two")]
    assert {(r.page_id, r.title) for r in D.html_prelude(pages).collect()} == {(1, "One"), (2, None)}


def test_table_blocks_repeat_the_header(spark):
    df = spark.createDataFrame([(1, i, f"v{i}") for i in range(3)], "t int, a int, b string")
    got = D.table_blocks(df, ["t"], ["a"], ["a", "b"], 2).orderBy("pos").collect()
    assert [(r.kind, r.text, r.row_start, r.row_end) for r in got] == [
        ("table_schema", "a | b", 1, 1), ("table", "a | b\n0 | v0\n1 | v1", 2, 3), ("table", "a | b\n2 | v2", 4, 4)]


HIT = "query_id long, chunk_id long, vector_score double, lexical_score double"


def test_rrf_is_symmetric_and_one_sided_scores(spark):
    v = spark.createDataFrame([(1, 10, 0.9), (1, 11, 0.8)], "query_id long, chunk_id long, vector_score double")
    x = spark.createDataFrame([(1, 11, 1.0), (1, 12, 0.5)], "query_id long, chunk_id long, lexical_score double")
    got = {r.chunk_id: r.rrf_score for r in H.rrf(v, x).collect()}
    assert got == {10: round(1 / 61, 6), 11: round(1 / 62 + 1 / 61, 6), 12: round(1 / 62, 6)}
    f = {r.chunk_id: (r.fusion_score, r.retrieval_score, r.score_source) for r in H.finalise_scores(H.weighted(v, x)).collect()}
    assert f[10] == (0.54, 0.9, "vector") and f[12] == (0.2, 0.5, "bm25") and f[11] == (0.88, 0.88, "hybrid")


def test_lexical_normalisation_edges(spark):
    rows = [(1, 1, 2.0, None), (2, 1, 3.0, 0.5), (2, 2, 3.0, None), (3, 1, 0.0, 0.3)]
    got = {(r.query_id, r.chunk_id): r.lexical_score for r in H.normalise_lexical(spark.createDataFrame(rows, "query_id long, chunk_id long, bm25_score double, exact_match_bonus double")).collect()}
    assert got == {(1, 1): 1.0, (2, 1): 1.0, (2, 2): 1.0, (3, 1): 0.3}


def test_budget_stops_at_the_first_overflow(spark):
    text = lambda n: " ".join(["w"] * n)
    rows = [(1, 1, 1, text(100)), (1, 2, 2, text(500)), (1, 3, 3, text(1))]
    hits = spark.createDataFrame(rows, "query_id long, chunk_id long, pos int, text string")
    got = X.fit_budget(hits, 512 + 220, 512).orderBy("pos").collect()
    assert [r.pos for r in got] == [1]  # exactly 100 tokens are left: no cut, nothing after it
    got = X.fit_budget(hits, 512 + 221, 512).orderBy("pos").collect()
    assert [(r.pos, r.truncated) for r in got] == [(1, False), (2, True)] and got[1].text.endswith("...")


def test_history_tail_cut_needs_64_tokens(spark):
    rows = [(1, 1, "user", " ".join(["w"] * 500), None, []), (1, 2, "assistant", " ".join(["x"] * 100), None, [])]
    m = spark.createDataFrame(rows, "conversation_id long, seq int, role string, content string, status string, source_idx array<int>")
    assert [r.seq for r in L.history_window(m, 8, 120 + 63).collect()] == [2]
    assert sorted(r.seq for r in L.history_window(m, 8, 120 + 64).collect()) == [1, 2]


def test_citations_and_arithmetic(spark):
    a = spark.createDataFrame([(1, "x [1、2] [2,3] [0] [x]"), (2, "1/3=0.33 1/3=0.34 5/0=1 2+2=4"), (3, None)], "answer_id long, answer string")
    assert [r.idx for r in A.citations(a).where("answer_id = 1").orderBy("pos").collect()] == [1, 2, 3]
    assert [r.expression for r in A.arithmetic_errors(a).orderBy("pos").collect()] == ["1/3=0.34", "5/0=1"]


def test_verdicts_fail_closed(spark):
    raw = ['{"verdict":"supported","supported_indices":[true]}', '{"verdict":"supported","supported_indices":[1.5, 4]}', '{"verdict":"SUPPORTED","supported_indices":[2]}', None]
    df = spark.createDataFrame([(i, r, 3) for i, r in enumerate(raw)], "case_id int, raw string, n int")
    assert [(r.status, r.indices) for r in A.parse_verdicts(df).orderBy("case_id").collect()] == [("unavailable", []), ("unavailable", []), ("supported", [2]), ("unavailable", [])]


def test_precision_counts_distinct_documents(spark):
    results = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, None)], "case_id int, rank int, doc_id string")
    expected = spark.createDataFrame([(1, "a"), (1, "b")], "case_id int, doc_id string")
    r = E.retrieval_rows(results, expected, spark.createDataFrame([(1,)], "case_id int")).first()
    assert (r.precision, r.recall, r.rr) == (1.0, 0.5, 1.0)


def test_where_and_vector_validation(spark):
    df = spark.createDataFrame([("a", {"x": "1"}), ("b", {"x": "2"}), ("c", {})], "id string, metadata map<string,string>")
    assert [r.id for r in df.where(V.where({"$or": [{"x": "1"}, {"x": {"$in": ["2"]}}]})).collect()] == ["a", "b"]
    vec = spark.createDataFrame([("a", [1.0, float("nan")], None), ("b", [1.0], None), ("c", [1.0, 2.0], None), ("d", None, None)], "id string, embedding array<float>, text string")
    assert [r.reason for r in V.validate_vectors(vec, 2).collect()] == ["not_finite", "dimension", None, "text_or_vector"]


def test_embedding_batches_are_halved_on_capacity_errors(spark):
    def small(texts):
        if len(texts) > 2:
            raise MemoryError
        return [[float(len(t)), 1.0] for t in texts]

    df = spark.createDataFrame([(i, "x" * i) for i in range(7)], "id int, text string")
    assert {r.id: r.embedding[0] for r in V.embed(df, small, 2).collect()} == {i: float(i) for i in range(7)}


def test_routes(spark):
    rows = [("谢谢", False, False), ("林小北在杭州么", False, False), ("今天天气", False, False), ("总结一下", True, True), ("he is who?", True, False)]
    df = spark.createDataFrame(rows, "query string, has_history boolean, has_sources boolean")
    assert [r.route for r in U.route(df).collect()] == ["DIRECT", "RETRIEVE", "LIVE_UNSUPPORTED", "REUSE", "RETRIEVE"]


def times(spark, rows):
    base = dt.datetime(2024, 1, 1, 23, 58)
    return spark.createDataFrame([(k, i, base + dt.timedelta(seconds=s), kind) for i, (k, s, kind) in enumerate(rows)], "key long, event_id long, ts timestamp, kind string")


def test_usage_limits(spark):
    rows = [(1, i * 0.5, "") for i in range(61)] + [(1, 59, ""), (1, 61, ""), (2, 0, "")]
    got = J.usage_limits(times(spark, rows), rpm=60, daily=1000).orderBy("event_id").collect()
    assert [r.allowed for r in got[:60]] == [True] * 60
    assert (got[60].allowed, got[60].reason, got[60].retry_after) == (False, "minute", 30)
    assert (got[61].retry_after, got[62].allowed, got[63].allowed) == (1, True, True)


def test_daily_quota_ends_at_midnight(spark):
    got = J.usage_limits(times(spark, [(1, 0, ""), (1, 70, ""), (1, 121, "")]), rpm=60, daily=1).orderBy("event_id").collect()
    assert [(r.allowed, r.reason, r.retry_after) for r in got] == [(True, None, None), (False, "day", 50), (True, None, None)]


def test_failure_limiter(spark):
    rows = [(1, 0, "failure"), (1, 10, "failure"), (1, 20, "success"), (1, 30, "failure"), (1, 329, "failure"), (1, 331, "failure")]
    got = J.failure_limiter(times(spark, rows), 2, 300).orderBy("event_id").collect()
    assert [(r.failures, r.blocked, r.wait) for r in got] == [(1, False, None), (2, True, 290), (0, False, None), (1, False, None), (2, True, 1), (2, True, 298)]


def replay(spark, df, path, batches=3):
    """A stream that gets ``df`` in several files."""
    rows = df.orderBy("event_id").collect()
    size = -(-len(rows) // batches)
    for n in range(batches):
        spark.createDataFrame(rows[n * size : (n + 1) * size], df.schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def drain(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()


def test_usage_stream_equals_batch(spark, tmp_path):
    df = times(spark, [(k, s, "") for s in range(0, 90, 3) for k in (1, 2)])
    drain(J.usage_limits_stream(replay(spark, df, str(tmp_path / "in")), 10, 25), "usage")
    key = lambda r: (r.key, r.event_id)
    assert sorted(spark.table("usage").collect(), key=key) == sorted(J.usage_limits(df, 10, 25).collect(), key=key)


def test_session_stream_equals_batch(spark, tmp_path):
    df = times(spark, [(1, 0, ""), (1, 100, ""), (1, 500, ""), (2, 50, ""), (3, 100_000, "")])
    drain(J.sliding_sessions_stream(replay(spark, df, str(tmp_path / "in")), 300, "1 minute"), "sessions")
    batch = J.sliding_sessions(df, 300).where("key < 3")
    row = lambda r: (r.key, r.start, r.end, r.n)
    assert sorted(map(row, spark.table("sessions").collect())) == sorted(map(row, batch.collect()))


def test_ingest_stream_takes_each_content_once_and_cuts_it(spark, tmp_path):
    rows = [(1, "a b", 0), (2, "a b", 1), (3, "b", 2), (4, "", 3), (5, None, 4), (6, "b", 5), (7, "c c c", 6), (8, "a b", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, event_id long")
    chunker = lambda docs: C.recursive_chunks(docs, size=3, overlap=0)
    target, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    files = replay(spark, df, str(tmp_path / "in"), 4).drop("event_id")
    J.ingest_stream(files, target, checkpoint, chunker).awaitTermination(120)
    taken = {r.hash: r.doc_id for r in spark.read.parquet(f"{target}/documents").collect()}
    assert len(taken) == 3
    got = sorted((r.doc_id, r.idx, r.text) for r in spark.read.parquet(f"{target}/chunks").collect())
    a, b = (next(r.doc_id for r in spark.read.parquet(f"{target}/chunks").collect() if r.text == t) for t in ("a b", "b"))
    assert got == sorted([(a, 0, "a b"), (b, 0, "b"), (7, 0, "c c"), (7, 1, "c")])
    # the same and one more, long after: only the new content is taken
    spark.createDataFrame([(9, "b", 8), (10, "d", 9)], df.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    J.ingest_stream(files, target, checkpoint, chunker).awaitTermination(120)
    assert sorted(r.doc_id for r in spark.read.parquet(f"{target}/documents").collect()) == sorted([*taken.values(), 10])


def test_ingest_of_a_replayed_batch_replaces_itself(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "a")], "doc_id long, text string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    for checkpoint in ("cp1", "cp2"):  # a fresh checkpoint delivers the files again, as batch 0
        files = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        J.ingest_stream(files, str(tmp_path / "out"), str(tmp_path / checkpoint)).awaitTermination(60)
        assert [r.text for r in spark.read.parquet(str(tmp_path / "out/chunks")).collect()] == ["a"]


def test_a_block_is_released_by_its_timer(spark, tmp_path):
    S.use_rocksdb(spark)
    rows = [(1, 0, "failure"), (1, 10, "failure"), (2, 10, "failure"), (2, 12, "failure"), (2, 15, "success"), (1, 200, "failure"), (3, 900, ""), (3, 2000, "")]
    df = times(spark, rows)
    drain(S.failure_limiter_stream(replay(spark, df, str(tmp_path / "in"), 4), 2, 300), "limited")
    start = min(J.failure_limiter(df, 2, 300).join(df, ["key", "event_id"]).select(F.unix_timestamp("ts")).collect())[0]
    got = spark.table("limited").collect()
    key = lambda r: (r.key, r.event_id)
    decided = sorted((r for r in got if r.event_id is not None), key=key)
    assert [tuple(r)[:2] + tuple(r)[3:] for r in decided] == [tuple(r) for r in sorted(J.failure_limiter(df, 2, 300).collect(), key=key)]
    # key 1 was blocked until 310, by its failure at 200 still: two failures in the window end when that of 10 leaves it; key 2's success cancels its timer
    assert [(r.key, r.t - start, r.failures, r.blocked) for r in got if r.event_id is None] == [(1, 310, 1, False)]


def test_limiter_splits_a_hot_key_by_time(spark):
    import random

    rng = random.Random(6)
    rows = sorted((1, rng.randrange(60_000), rng.choice(["failure", "failure", "other", "success"])) for _ in range(400))
    got = J.failure_limiter(times(spark, rows), 3, 500).orderBy("event_id").collect()
    for n, (_, t, _) in enumerate(rows):
        past = rows[: n + 1]
        since = max((i for i, r in enumerate(past) if r[2] == "success"), default=-1)
        near = [r[1] for r in past[since + 1 :] if r[2] == "failure" and r[1] > t - 500]
        wait = max(1, near[-3] + 500 - t) if len(near) >= 3 else None
        assert (got[n].failures, got[n].blocked, got[n].wait) == (len(near), len(near) >= 3, wait)


def test_a_silent_worker_is_reported_once_and_again_after_it_came_back(spark, tmp_path):
    S.use_rocksdb(spark)
    beat = lambda k, s: spark.createDataFrame([(k, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s))], "key long, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    beat(1, 0)
    stream = spark.readStream.schema("key long, ts timestamp").parquet(str(tmp_path / "in"))
    q = S.liveness_alerts(stream, 2).writeStream.format("memory").queryName("alerts").outputMode("append").start()

    def until(n):
        for _ in range(240):
            got = [r.alert for r in spark.table("alerts").collect()]
            if len(got) >= n or q.exception():
                break
            time.sleep(0.5)
        return got

    assert until(1) == ["stale"]
    time.sleep(3)
    assert until(1) == ["stale"]
    beat(1, 60)
    assert until(3)[:3] == ["stale", "back", "stale"]
    q.stop()


def test_generation_retry_replaces_only_its_own(spark, tmp_path):
    path = str(tmp_path / "gen")
    a = spark.createDataFrame([(1,)], "id int")
    corpus.write_generation(a, path, "g1")
    corpus.write_generation(a.union(a), path, "g2")
    corpus.write_generation(a, path, "g2")
    assert sorted(r.index_id for r in spark.read.parquet(path).collect()) == ["g1", "g2"]


def test_only_a_checked_generation_becomes_active(spark, tmp_path):
    sink = corpus.GenerationSink(spark, str(tmp_path / "sink"))
    rows = lambda *r: spark.createDataFrame(list(r), "doc_id long, text string")
    expected = spark.createDataFrame([(1, 2), (2, 1)], "doc_id long, expected long")
    assert [(r.doc_id, r.problem) for r in sink.publish(rows((1, "a"), (2, "b")), "g1", expected).collect()] == [(1, "count")]
    assert sink.active() is None
    with pytest.raises(ValueError):
        sink.read()
    assert sink.publish(rows((1, "a"), (1, "c"), (2, "b")), "g1", expected).isEmpty() and sink.active() == "g1"
    assert {r.problem for r in sink.publish(rows((1, "x"), (3, "y")), "g2", expected).collect()} == {"count", "empty", "unknown"}
    assert sorted(r.text for r in sink.read().collect()) == ["a", "b", "c"]
    with pytest.raises(ValueError):
        sink.publish(rows((1, "z")), "g1", expected)
    assert sink.publish(rows((1, "x"), (1, "y"), (2, "z")), "g2", expected).isEmpty() and sink.active() == "g2"


def test_read_corpus(spark, tmp_path):
    (tmp_path / "x.txt").write_text("hello\nworld")
    (tmp_path / "y.md").write_text("no")
    assert [tuple(r) for r in corpus.read_corpus(spark, str(tmp_path), ".txt").collect()] == [("x.txt", "hello\nworld")]
