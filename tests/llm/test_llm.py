"""The ten operators against brute force, round trips and edge cases."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kbspark.llm import bpe, chat_format, exact_dedup, katz, line_dedup, near_dedup, packing, quality, topk_search, toxicity

DOCS = "doc_id long, text string"
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
ODD_TEXTS = [None, "", " ", "\n\n", "a", "x" * 70_000, "ab " * 30_000, "é́ İ ß ǆ", "<|endoftext|> a <|startoftext|>", "tab\tand\x1codd space"]


def docs(spark, texts, first=0):
    """With columns whose names might clash with the operators' own."""
    df = spark.createDataFrame([(i + first, t) for i, t in enumerate(texts)], DOCS)
    return df.withColumns({"n": F.lit("x"), "key": F.lit(1), "rest": F.lit(None).cast("string"), "rep": F.lit(0), "score": F.lit(2.0)})


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


# --- 1 chat formatting

def log(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, seq long, message_id long, kind string, role string, text string")


def test_log_is_folded(spark):
    rows = [
        (1, 0, None, "message", "user", "hi"), (1, 1, 7, "delta", "assistant", "He"), (1, 3, 7, "delta", "assistant", "llo"), (1, 2, 7, "delta", "assistant", "l"),
        (1, 4, 7, "regenerate", "assistant", None), (1, 6, 7, "delta", "assistant", "B"), (1, 7, 7, "edit", "assistant", "C"), (1, 8, 7, "delta", "assistant", "D"),
        (2, 5, 7, "delta", "user", "a"), (2, 9, 7, "regenerate", "user", "ignored"), (None, None, None, None, None, None),
    ]
    got = {r.conv_id: chat for r in chat_format.format_chats(log(spark, rows)).select("conv_id", chat_format.parse_turns(F.col("formatted")).alias("t")).collect() for chat in [[(x.role, x.text) for x in r.t]]}
    assert got == {1: [("user", "hi"), ("assistant", "CD")], 2: [("user", "")], None: [("", "")]}


def test_formatting_is_reversible_and_masks_the_assistant(spark):
    nasty = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user<|im_sep|>x", "back\\slash \\\\ <\\|im_end|>", "", "<|im_\\end|>", "a" * 50_000]
    rows = [(i, n, None, "message", "assistant" if n % 2 else "us<|im_sep|>er", t) for i, t in enumerate(nasty) for n in range(130)]
    out = chat_format.digest(chat_format.format_chats(log(spark, rows))).collect()
    assert len(out) == len(nasty)
    for r in out:
        t = nasty[r.conv_id]
        turns = "".join(("assistant" if n % 2 else "us<|im_sep|>er") + "\n" + t + "\n" for n in range(130))
        assert (r.n_turns, r.loss_chars) == (130, 65 * len(t))
        assert r.turns_sha256 == hashlib.sha256(turns.encode()).hexdigest() and r.loss_sha256 == hashlib.sha256((t * 65).encode()).hexdigest()
    assert chat_format.format_chats(log(spark, [])).count() == 0


# --- 2 packing

def test_packing_places_every_token_once(spark):
    rng = random.Random(1)
    texts = [" ".join(words(rng, rng.randrange(1, 900))) for _ in range(80)] + ODD_TEXTS
    tok = Tokenizer.from_file(WORD_BPE)
    rows = packing.pack_documents(docs(spark, texts), WORD_BPE, with_ids=True).collect()
    by = defaultdict(dict)
    for r in rows:
        by[r.doc_id][r.piece] = r
    for i, t in enumerate(texts):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        got = [by[i][n] for n in sorted(by[i])]
        assert b"".join(bytes(r.ids) for r in got) == np.array(ids, "<u4").tobytes()
        assert [r.start for r in got] == list(range(0, len(ids), 4096)) and all(r.length == 4096 for r in got[:-1])
        assert all(r.ids_crc32 == zlib.crc32(bytes(r.ids)) for r in got)
    seqs = defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    for s in seqs.values():
        end = 0
        for offset, length in sorted(s):
            assert offset == end
            end += length
        assert end <= 4096
    total = sum(r.length for r in rows)
    assert len(seqs) <= -(-total // 4096) + 2


def test_sum_of_squares_choices():
    bins, offsets = packing.sum_of_squares(np.array([6, 4, 10, 7, 3]), 10)
    assert bins.tolist() == [0, 0, 1, 2, 2] and offsets.tolist() == [0, 6, 0, 0, 7]
    assert packing.pack_documents.__doc__


def test_packing_of_nothing(spark):
    assert packing.pack_documents(docs(spark, []), WORD_BPE).count() == 0


BIG = 2**53 + 1


def test_null_ids_leave_large_ones_exact(spark):
    """Beside a null id, in every operator that takes texts to Python."""
    texts = ["a b c d e f", "a b c d e f", None]
    some = spark.createDataFrame([(BIG, texts[0]), (None, texts[1]), (None, texts[2])], DOCS).coalesce(1)
    lab = spark.createDataFrame([(BIG, 1)], "doc_id long, toxic int")
    for out in (
        packing.pack_documents(some, WORD_BPE), near_dedup.near_dedup(some), toxicity.toxicity(some, lab), quality.classify(some), katz.lm_scores(some),
    ):
        assert sorted(r.doc_id or 0 for r in out.collect()) == [0, 0, BIG]


def test_stages_keep_columns_with_clashing_names(spark):
    names = ["n_lines", "n_dropped", "gone_", "gone__", "row__", "rid__", "doc__", "score", "worst", "text_", "quality_score", "p", "r"]
    some = docs(spark, ["some words of a text that repeat\nsome words of a text that repeat", None, ""]).withColumns({c: F.lit(c) for c in names})
    lab = spark.createDataFrame([], "doc_id long, toxic int")
    for out in (line_dedup.lean_documents(some), toxicity.reject_toxic(some, lab), quality.reject_low_quality(some)):
        assert out.columns == some.columns and all(r[c] == c for r in out.collect() for c in names)
    assert line_dedup.line_dedup(docs(spark, [])).count() == 0 and toxicity.toxicity(docs(spark, []), lab).count() == 0


def test_packing_needs_hardly_more_sequences_than_the_tokens_fill():
    rng = np.random.default_rng(4)
    for n in (300, 5_000):
        lengths = np.sort(np.minimum(rng.lognormal(5.5, 1.2, n).astype(np.int64) + 1, 4096))[::-1]
        bins, offsets = packing.sum_of_squares(lengths, 4096)
        ends = np.bincount(bins, lengths)
        assert ends.max() <= 4096 and bins.max() + 1 <= -(-lengths.sum() // 4096) + 1
        assert all(np.isin(offsets[bins == b], np.concatenate([[0], np.cumsum(lengths[bins == b])])).all() for b in range(20))


# --- 3 line dedup

def similar(a, b):
    la, lb = len(a), len(b)
    row = list(range(lb + 1))
    for i in range(1, la + 1):
        row, old = [i] + [0] * lb, row
        for j in range(1, lb + 1):
            row[j] = min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (a[i - 1] != b[j - 1]))
    return row[lb] <= int((1 - line_dedup.SIMILARITY) * max(la, lb) + 1e-9)


def test_lines_keep_one_occurrence(spark):
    rng = random.Random(2)
    base = [words(rng, 60, 5000) for _ in range(6)]
    texts = []
    for b in base:
        other = " ".join(words(rng, 30, 5000))
        texts += [" ".join(b) + "\nno", other + "\n" + " ".join(b).upper() + "!\nno\n", " ".join(b) + "."]
    texts += [None, "", "a b c d e", "a b c d e"]
    out = {r.doc_id: r for r in line_dedup.line_dedup(docs(spark, texts)).collect()}
    assert len(out) == len(texts)
    for i in range(6):
        assert out[3 * i].text == (texts[0] if i == 0 else texts[3 * i].split("\n")[0]) and out[3 * i + 2].text == ""
        assert out[3 * i + 1].text == texts[3 * i + 1].split("\n")[0] + "\n"
    assert out[18].text is None and out[19].text == "" and (out[20].n_dropped, out[21].n_dropped) == (0, 1)


def test_dropped_lines_have_a_similar_line_that_stays(spark):
    rng = random.Random(3)
    base = [words(rng, 90, 3000) for _ in range(2)]
    texts = []
    for b in base:
        for _ in range(9):
            c = list(b)
            c[rng.randrange(90)] = "changed"
            texts.append(" ".join(c))
    out = {r.doc_id: r for r in line_dedup.line_dedup(docs(spark, texts)).collect()}
    assert sum(r.n_dropped == 0 for r in out.values()) < 15
    for i, t in enumerate(texts):
        if out[i].n_dropped:
            assert any(similar(t, k) for k in texts[9 * (i // 9) : i])


def test_many_variants_of_one_line_form_one_group(spark):
    rng = random.Random(4)
    b = words(rng, 400, 3000)
    texts = [" ".join(b)] * 5 + [" ".join(b[:i] + ["new"] + b[i + 1 :]) for i in range(0, 400, 8)]
    out = line_dedup.line_dedup(docs(spark, texts)).collect()
    assert sum(r.n_dropped == 0 for r in out) <= 8


def test_edited_lines_meet(spark):
    """Recall of pairs at the similarity, as brute force finds them, for lines of 10 to 100 words."""
    rng = random.Random(21)
    texts, pairs = [], 0
    for n in (10, 15, 20, 27, 40, 60, 100):
        for k in range(10):
            b = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(n)]
            c = list(b)
            c[rng.randrange(n)] = "other"
            if k % 2 and n >= 40:
                c.insert(rng.randrange(n), "one")
            a, z = " ".join(b), " ".join(c)
            if similar(a, z):
                texts += [a, z]
                pairs += 1
    out = line_dedup.line_dedup(docs(spark, texts)).collect()
    assert pairs >= 60 and sum(r.n_dropped for r in out) >= 0.95 * pairs
    assert all(r.doc_id % 2 for r in out if r.n_dropped)


def test_links_past_a_more_frequent_line(spark):
    """Lines of the same words are compared with each other, and with the neighbours of a line they are similar to."""
    rng = random.Random(22)
    a = words(rng, 40, 5000)
    shuffled = a[20:] + a[:20]
    texts = [" ".join(a)] * 3 + [" ".join(shuffled), " ".join([*shuffled[:5], shuffled[6], shuffled[5], *shuffled[7:]])]
    out = {r.doc_id: r.n_dropped for r in line_dedup.line_dedup(docs(spark, texts)).collect()}
    assert out == {0: 0, 1: 1, 2: 1, 3: 0, 4: 1}
    # h ~ a and a ~ b, but not h ~ b
    h = words(rng, 80, 5000)
    swap = lambda w, at: [*w[:at], w[at + 1], w[at], *w[at + 2 :]]
    a = swap(swap(swap(swap(h, 10), 20), 30), 40)
    b = [*a[:50], "x" * 30, *a[56:]]
    h, a, b = " ".join(h), " ".join(a), " ".join(b)
    assert similar(h, a) and similar(a, b) and not similar(h, b)
    out = line_dedup.line_dedup(docs(spark, [h] * 3 + [a, b])).collect()
    assert sum(r.n_dropped for r in out) == 4


def test_short_and_unspaced_lines_take_part(spark):
    han = "机器学习模型的训练数据需要去除重复的行以及近似重复的内容才能得到更好的结果这一点很重要"
    lines = ["Menu", "read more", "Read more!", "---", "***", "---", "menu", "subscribe now", "subscribe new", han, han + "。", han[:20] + "们" + han[20:], " ", "ok", "ok", "\t\t\t", "\t\t\t"]
    out = line_dedup.line_dedup(docs(spark, ["\n".join(lines[:5]), "\n".join(lines[5:])])).collect()
    left = [line for r in sorted(out, key=lambda r: r.doc_id) for line in r.text.split("\n")]
    assert left == ["Menu", "read more", "---", "***", "subscribe now", han, " ", "ok", "\t\t\t", "\t\t\t"]


# --- 4 quality

def test_em_finds_the_bad_labeller():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.7
    acc = [0.95, 0.9, 0.85, 0.55]
    votes = np.array([np.where(rng.random(4000) < a, truth, ~truth) for a in acc]).T.astype(int)
    votes[rng.random(votes.shape) < 0.2] = -1
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    post, found, prior = quality.fit_labellers(patterns, counts)
    assert abs(prior - 0.7) < 0.05 and np.abs(found.mean(axis=0) - acc).max() < 0.08


def test_junk_is_rejected_and_prose_kept(spark):
    rng = random.Random(5)
    prose = lambda: ". ".join("The " + " ".join(w + (" of the" if rng.random() < 0.3 else "") for w in words(rng, 12, 3000)) for _ in range(8)) + "."
    good = [prose() for _ in range(60)]
    bad = [" ".join(w.upper() + "!!" for w in words(rng, 80, 3000)) for _ in range(12)] + [" ".join([f"Der{i}"] * 300) for i in range(12)]
    out = {r.doc_id: r for r in quality.classify(docs(spark, good + bad + ODD_TEXTS)).collect()}
    assert len(out) == len(good + bad + ODD_TEXTS)
    assert all(out[i].kept for i in range(60)) and not any(out[i].kept for i in range(60, 84))
    assert out[84].quality_score == 0.0
    assert quality.classify(docs(spark, [])).count() == 0


# --- 5 BPE

ENCODER = bpe.Encoder(BYTE_BPE)
LIBRARY = Tokenizer.from_file(BYTE_BPE)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=("Cs",)), max_size=60))
def test_bpe_equals_the_library(text):
    ids = np.frombuffer(ENCODER.encode(text), "<u4")
    assert ids.tolist() == LIBRARY.encode(text, add_special_tokens=False).ids
    assert ENCODER.v.decode(ids).decode() == text


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(sorted(ENCODER.v.id_of)), max_size=6))
def test_bpe_on_joined_tokens(parts):
    text = b"".join(parts).decode("utf-8", "replace")
    assert np.frombuffer(ENCODER.encode(text), "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_bpe_digests_and_round_trip(spark):
    df = docs(spark, ODD_TEXTS)
    out = {r.doc_id: r for r in bpe.round_trip_digest(df, BYTE_BPE).collect()}
    back = {r.doc_id: r.text for r in bpe.decode_documents(bpe.encode_documents(df, BYTE_BPE), BYTE_BPE).collect()}
    for i, t in enumerate(ODD_TEXTS):
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids
        assert out[i].n_tokens == len(ids) and out[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert out[i].decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest() and back[i] == (t or "")


def test_bpe_keeps_ids_beside_null_ones_and_takes_empty_tables(spark):
    rows = spark.createDataFrame([(None, "a b"), (2**53 + 1, "a b"), (2**53 + 1, "a b"), (None, None)], DOCS).coalesce(1)
    got = bpe.round_trip_digest(rows, BYTE_BPE).collect()
    assert [(r.doc_id, r.n_tokens) for r in got] == [(None, 2), (2**53 + 1, 2), (2**53 + 1, 2), (None, 0)]
    decoded = bpe.decode_documents(bpe.encode_documents(rows, BYTE_BPE), BYTE_BPE).collect()
    assert [tuple(r) for r in decoded] == [(None, "a b"), (2**53 + 1, "a b"), (2**53 + 1, "a b"), (None, "")]
    assert bpe.round_trip_digest(docs(spark, []), BYTE_BPE).count() == 0 and bpe.decode_documents(bpe.encode_documents(docs(spark, []), BYTE_BPE), BYTE_BPE).count() == 0


# --- 6 near-dedup

def brute(texts, size, threshold):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[j : j + size]) for j in range(max(1, len(w) - size + 1))} if w else set())
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= threshold * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


def test_near_dedup_equals_brute_force(spark):
    rng = random.Random(6)
    texts = []
    for _ in range(12):
        b = words(rng, rng.randrange(30, 150))
        texts.append(" ".join(b))
        for _ in range(rng.randrange(6)):
            c = list(b)
            for _ in range(rng.randrange(4)):
                c[rng.randrange(len(c))] = "changed"
            texts.append(" ".join(c))
    hub = words(rng, 120)  # spokes that are close to the hub, not to each other
    texts += [" ".join(hub)] * 3 + [" ".join(hub[:i] + [f"x{i}"] + hub[i + 1 :]) for i in range(3, 117, 2)]
    texts += [" ".join(hub[:30] + words(rng, 90)) for _ in range(30)] + ODD_TEXTS[:5] + ["one two", "ONE two", "One\ttwo "]
    for size, threshold in ((3, 85), (5, 80)):
        comp, n = brute(texts, size, threshold)
        out = {r.doc_id: r for r in near_dedup.near_dedup(docs(spark, texts), size, threshold).collect()}
        assert [out[i].component_id for i in range(len(texts))] == comp and [out[i].n_shingles for i in range(len(texts))] == n
        assert all(out[i].kept == (comp[i] == i) for i in range(len(texts)))
    assert near_dedup.near_dedup(docs(spark, [])).count() == 0


# --- 7 exact dedup

def test_exact_dedup_equals_brute_force(spark):
    rng = random.Random(7)
    long = "".join(rng.choice("ab") for _ in range(300_000))
    texts = [rng.choice(["a", "b", "ab", None, "", "c" * 64, "c" * 65, "c" * 4160, "c" * 4161]) for _ in range(200)] + [long, long, long[:-1] + "z", long[:-1], "x" + long]
    out = {r.doc_id: r for r in exact_dedup.exact_dedup(docs(spark, texts)).collect()}
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[t or ""].append(i)
    for i, t in enumerate(texts):
        g, r = groups[t or ""], out[i]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (max(g), len(g), i == max(g), hashlib.sha256((t or "").encode()).hexdigest())
    odd = exact_dedup.exact_dedup(spark.createDataFrame([(None, "a"), (1, "a"), (1, "a"), (2, "q")], DOCS)).collect()
    assert sorted((str(r.doc_id), r.keep_id, r.group_size) for r in odd) == [("1", 1, 3), ("1", 1, 3), ("2", 2, 1), ("None", 1, 3)]
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0


# --- 8 top-k

def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(8)
    v = np.round(rng.normal(size=(700, 8)), 2)
    v[100:250] = v[100]  # one very common vector
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(9001, None), (9002, [1.0, float("nan")]), (9003, [1.0] * 7 + [None]), (9004, [1.0, 2.0]), (9050, [2.0, 1.0]), (9100, [])]
    old = topk_search.SHARD_ROWS, topk_search.LEAF_ROWS, topk_search.BLOCK_ROWS
    topk_search.SHARD_ROWS, topk_search.LEAF_ROWS, topk_search.BLOCK_ROWS = 128, 16, 8
    try:
        x = topk_search.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
        out = defaultdict(list)
        for r in topk_search.top_k(x, topk_search.every_nth(x, 50), 5).collect():
            out[r.query_id].append((r.rank, r.vec_id, r.score))
    finally:
        topk_search.SHARD_ROWS, topk_search.LEAF_ROWS, topk_search.BLOCK_ROWS = old
    whole = np.floor(256 * v).astype(int)
    for q in range(0, 700, 50):
        best = sorted((-int(whole[q] @ whole[i]), i) for i in range(700) if i != q)[:5]
        assert sorted(out.pop(q)) == [(n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert dict(out) == {9050: [(1, 9004, 256 * 256 * 4)]}


# --- 9 toxicity

def test_toxic_sentences_are_found(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(600):
        s = [" ".join(words(rng, 9, 900)) for _ in range(rng.randrange(1, 9))]
        bad = rng.random() < 0.25
        if bad:
            s.insert(rng.randrange(len(s) + 1), " ".join([*words(rng, 5, 900), rng.choice(["vile", "Scum,"]), *words(rng, 3, 900)]))
        rows.append(". ".join(s))
        labels.append((i, 1, int(bad)))
    lab = spark.createDataFrame([*labels, (7, 1, None), (99999, 1, 1)], "doc_id long, quality int, toxic int")
    out = toxicity.toxicity(docs(spark, rows + ODD_TEXTS), lab).collect()
    assert len(out) == 600 + len(ODD_TEXTS) and all(0 <= r.score <= 1 for r in out)
    held = [(r, labels[r.doc_id][2]) for r in out if r.held_out and r.doc_id < 600]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert np.mean([r.predicted == y for r, y in held]) > 0.97
    hit = [r.worst[0].sentence.lower() for r, y in held if y and r.predicted]
    assert np.mean(["vile" in s or "scum" in s for s in hit]) > 0.95
    assert {r.score for r in out if r.doc_id in (600, 601)} == {0.0}


def test_toxicity_without_labels(spark):
    out = toxicity.toxicity(docs(spark, ["a b", None]), spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert [r.predicted for r in out] == [0, 0]


# --- 10 language model

@pytest.mark.parametrize("small", [False, True])
def test_katz_is_normalised_and_equals_brute_force(spark, monkeypatch, small):
    """The same scores whether the corpus is one block and bucket or many."""
    rng = random.Random(10)
    texts = [" ".join(words(rng, rng.randrange(0, 40), 30) + (["Rare%d" % i] if i % 3 == 0 else [])) for i in range(120)]
    texts += [None, "", "Long " * 3000, " \n\x0b a\u2003b \x1c "]
    if small:
        monkeypatch.setattr(katz, "BLOCK_BYTES", 300)
        monkeypatch.setattr(katz, "BUCKET_TOKENS", 200)
    out = {r.doc_id: r for r in katz.lm_scores(docs(spark, texts)).collect()}
    seq = lambda t: [b"<start>", *(t or "").encode().lower().split(), b"<end>"]
    uni, bi = Counter(), Counter()
    for i, t in enumerate(texts):
        if zlib.crc32(str(i).encode()) % 5 != 1:
            s = seq(t)
            uni.update(s[1:])
            bi.update(zip(s, s[1:], strict=False))
    total = sum(uni.values())
    cut = lambda c, d: d[c - 1] * c if c <= katz.MAX_R else c
    d1 = katz.discounts(Counter(uni.values()))
    d2 = katz.discounts(Counter(bi.values()))
    p1 = {w: cut(c, d1) / total for w, c in uni.items()}
    free = 1 - sum(p1.values())

    def p(h, w):
        followers = {v: c for (g, v), c in bi.items() if g == h}
        if not followers:
            return p1.get(w, free)
        ch, s = sum(followers.values()), sum(cut(c, d2) for c in followers.values())
        whole = s > ch - 1e-9
        if w in followers:
            return cut(followers[w], d2) / (ch + whole)
        return (1 / (ch + 1) if whole else 1 - s / ch) / (1 - sum(p1[v] for v in followers)) * p1.get(w, free)

    for h in list(dict.fromkeys(g for g, _ in bi))[:10]:
        assert abs(sum(p(h, w) for w in uni) + p(h, b"never seen") - 1) < 1e-9
    for i, t in enumerate(texts):
        s = seq(t)
        r = out[i]
        want = sum(np.log10(p(h, w)) for h, w in zip(s, s[1:], strict=False))
        base = sum(np.log10((uni[w] + 0.5) / (total + 0.5 * (len(uni) + 1))) for w in s[1:])
        assert r.score == pytest.approx(want) and r.base_score == pytest.approx(base)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(s) - 1, sum(uni[w] > 0 for w in s[1:]), total)


def test_katz_of_nothing_and_of_untrained_rows(spark):
    assert katz.lm_scores(docs(spark, [])).count() == 0
    some = spark.createDataFrame([(None, "a b"), (2**53 + 1, None), (None, "a b")], "doc_id long, text string").withColumn("score", F.lit(1))
    out = katz.katz_scores(some, F.lit(False)).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.n_known, r.train_tokens, r.score) for r in out) == [(0, 3, 0, 0, 0.0)] * 2 + [(2**53 + 1, 1, 0, 0, 0.0)]


def test_quick_verdict_agrees_with_edit_distance(spark):
    """Pairs that the bounds take out are too far apart, pairs that they link are near enough; edits of every kind, repeated passages."""
    rng = random.Random(11)
    words = ["the", "of", "mill", "river", "stone", "a", "winter", "é", "cart", "old", "bridge", "漢字"]
    pairs = []
    for n in range(300):
        x = [rng.choice(words) for _ in range(rng.randint(1, 60))] * rng.choice([1, 1, 1, 4])
        y = list(x) if n % 4 else ["".join(rng.choices("bdfgkpqz", k=rng.randint(1, 9))) for _ in x]
        for _ in range(rng.choice([0, 1, 2, 5, 9])):
            at = rng.randrange(len(y) + 1)
            y[at : at + rng.choice([0, 1])] = rng.choice([[], [rng.choice(words)], [rng.choice(words) + "s"]])
            y = y or ["a"]
        pairs.append((n, " ".join(x), " ".join(y)))
    df = spark.createDataFrame(pairs, "n long, ta string, tb string").withColumn("most", line_dedup.most_edits(F.greatest(F.length("ta"), F.length("tb"))))
    truth = {r.n: r.d <= r.most for r in df.select("n", "most", F.levenshtein("ta", "tb").alias("d")).collect()}
    got = {r.n: r.alike for r in line_dedup.quick_verdict(df).select("n", "alike").collect()}
    assert not [n for n, near in truth.items() if near and n not in got]
    assert not [n for n, alike in got.items() if alike and not truth[n]]
    assert sum(1 for a in got.values() if a) > 60 and len(got) < 260


def test_lines_that_share_a_passage_become_few_pairs(spark, monkeypatch):
    """Under keys that a common passage fills, the pairs that are compared grow with the lines, not with their square; a similar pair among them is found."""
    rng = random.Random(31)
    passage = words(rng, 30, 5000)
    lines = [[*words(rng, 8, 10**6), *passage, *words(rng, 8, 10**6)] for _ in range(300)]
    lines.append([*lines[150][:3], "edit", *lines[150][4:]])
    compared = []
    verdict = line_dedup.verdict
    monkeypatch.setattr(line_dedup, "verdict", lambda pairs: compared.append(pairs.count()) or verdict(pairs))
    out = line_dedup.line_dedup(docs(spark, [" ".join(line) for line in lines])).collect()
    assert [r.doc_id for r in out if r.n_dropped] == [300] and sum(compared) < 20 * len(lines)


def test_bounds_settle_long_lines_of_repeated_words(spark):
    """Runs of one word that are shorter in the other line, a repeated passage with an edit in each copy, and common ends cut off: all as the distance says."""
    run = lambda n, at: " ".join(w for i, w in enumerate(["alpha", "beta", "gamma"]) for _ in range(n + (i == at)))
    block = "one two three four five six seven eight nine ten eleven twelve"
    pairs = [(0, run(150, 9), run(148, 1)), (1, " ".join([block] * 40), " ".join([block.replace("three", "threesome")] * 39)), (2, "a" * 50 + "bcd" + "e" * 50, "a" * 50 + "e" * 50), (3, "ab" * 60, "ab" * 59)]
    df = spark.createDataFrame(pairs, "n long, ta string, tb string").withColumn("most", line_dedup.most_edits(F.greatest(F.length("ta"), F.length("tb"))))
    got = {r.n: r.alike for r in line_dedup.verdict(df).collect()}
    assert got[0] and got[1]
    cut = line_dedup.trimmed(df.withColumn("alike", F.lit(None).cast("boolean")))
    truth = {r.n: r.d for r in df.select("n", F.levenshtein("ta", "tb").alias("d")).collect()}
    assert {r.n: r.d for r in cut.select("n", F.levenshtein("ta", "tb").alias("d")).collect()} == truth
    assert {r.n: len(r.ta) + len(r.tb) for r in cut.where("n >= 2").collect()} == {2: 3, 3: 2}


def test_lines_of_documents_with_short_ids(spark):
    """Ids of a narrower type, and none at all, find their lines again."""
    texts = ["one two three four five six seven eight nine ten eleven twelve", "one two three four five six seven eight nine ten eleven twelves"]
    df = spark.createDataFrame([(1, texts[0]), (2, texts[1]), (None, texts[0])], "doc_id int, text string")
    out = {r.doc_id: r.n_dropped for r in line_dedup.line_dedup(df).collect()}
    assert out == {None: 0, 1: 1, 2: 1}
