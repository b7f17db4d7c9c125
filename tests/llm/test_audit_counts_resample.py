"""Token counts, importance resampling and the filter audit against the library and brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kbspark.llm import filter_audit, resample, token_counts

PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD_TEXTS = [
    None, "", " ", "\n\n", "a", "x" * 70_000, "ab " * 30_000, "é́ İ ß ǆ 知识库 🙂", "<s> </s> <unk> <0x0A> ▁▁ a", "tab\tand\x1codd space\x00", "aa AA \x0b\x0c aa", "  two  spaces ",
    "A#", "w" * 300 + " " + "w" * 300 + "-" + "v" * 400,
]


def docs(spark, texts, first=0):
    """With columns whose names might clash with the operators' own."""
    df = spark.createDataFrame([(i + first, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return df.withColumns({"n": F.lit("x"), "score": F.lit(2.0), "weight": F.lit(1), "rank": F.lit(1), "fails": F.lit(9), "part": F.lit("p"), "figures_": F.lit(0), "lang": F.lit(None).cast("string")})


# --- 11 token counts

def test_counts_are_the_library_s(spark):
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rng = random.Random(3)
    letters = [lib.id_to_piece(rng.randrange(259, 32_000)) for _ in range(300)] + list(" \n\t.,!0123é漢▁")
    texts = ODD_TEXTS + ["".join(rng.choices(letters, k=rng.randrange(90))) for _ in range(300)]
    got = {r.doc_id: r for r in token_counts.token_counts(docs(spark, texts), PIECES).collect()}
    for i, t in enumerate(texts):
        n = len(lib.encode(t or ""))
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 4096), t


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("aeinrst .,▁\n")), max_size=60))
def test_any_text_counts_as_in_the_library(text):
    own = token_counts.pieces(PIECES)
    assert own.count(text) == len(_lib().encode(text))
    assert own._merge_short(text) == own._merge_long(text)


def _lib(known=[]):  # noqa: B006
    if not known:
        known.append(sentencepiece.SentencePieceProcessor(model_file=PIECES))
    return known[0]


def test_whole_tokens_are_proved():
    own = token_counts.pieces(PIECES)
    bare = [p for p in own.whole if p.startswith("▁") and len(p) > 1 and "▁" not in p[1:]]
    assert len(bare) > 10_000 and all(len(x) == 1 for x in _lib().encode([p[1:] for p in bare]))
    kinds = token_counts.alphabets({"ab", "bc", "xy", "▁a", "▁x"})
    assert sorted(map(sorted, kinds)) == [["a", "b", "c"], ["x", "y"]]


def test_counts_of_nothing(spark):
    assert token_counts.token_counts(docs(spark, []), PIECES).count() == 0
    rows = spark.createDataFrame([(None, "a"), (None, "a"), (2**53 + 1, "a b")], "doc_id long, text string")
    got = token_counts.token_counts(rows, PIECES, limit=1).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.over_limit) for r in got) == [(0, 1, False), (0, 1, False), (2**53 + 1, 2, True)]


# --- 12 importance resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return w, [zlib.crc32(x.encode()) % 10_000 for x in w + [f"{a} {b}" for a, b in itertools.pairwise(w)]]


def resampled(rows, target):
    """Brute force over (doc_id, text)."""
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(grams(text)[1])
    for text in target:
        t.update(grams(text)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    out, can = [], []
    for i, text in rows:
        w, b = grams(text)
        weight = sum(math.floor(1000 * math.log((t[x] + 1) * (big_s + 10_000) / ((s[x] + 1) * (big_t + 10_000)))) for x in b) // len(b) if b else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(b), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
        if len(w) >= 20:
            can.append(out[-1])
    can.sort(key=lambda r: (-r[3], math.inf if r[0] is None else r[0]))
    for n, r in enumerate(can[: 25 * len(can) // 100]):
        r[4] = n + 1
    return out


def in_order(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is None, x or 0) for x in r))


def test_resampling_is_brute_force(spark):
    rng = random.Random(5)
    said = ["Über", "w1", "w2", "naïve", "知识", "X9", "a", "w1-w2", "don't", "É"]
    texts = ODD_TEXTS + [rng.choice([" ", "  ", "\n", "."]).join(rng.choices(said, k=rng.randrange(60))) for _ in range(300)]
    target = ["w1 w2 w1 w2 über", "Naïve w1", None, ""]
    rows = list(enumerate(texts)) + [(7, texts[40])] * 3 + [(None, texts[41]), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"score": F.lit("x"), "w": F.lit(1), "t": F.lit(0)})
    got = resample.importance_resample(df.repartition(5), docs(spark, target))
    assert in_order(got.collect()) == in_order(resampled(rows, target))


def test_resampling_of_one_hot_document(spark):
    rows = [(1, "one two " * 20)] * 40 + [(i, " ".join(f"w{j}" for j in range(i, i + 25))) for i in range(2, 22)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    target = spark.createDataFrame([("one two one",)], "text string")
    assert in_order(resample.importance_resample(df, target).collect()) == in_order(resampled(rows, ["one two one"]))
    assert set(resample.drawn_documents(df, target).columns) == {"doc_id", "text"}
    assert resample.importance_resample(df.limit(0), target).count() == 0
    assert in_order(resample.importance_resample(df, target.limit(0)).collect()) == in_order(resampled(rows, []))


def test_crcs_are_composed():
    rng = random.Random(8)
    pairs = [(rng.randbytes(rng.randrange(40)), rng.randbytes(n)) for n in [*range(1, 80), 255, 256, 70_000, 1_000_003]]
    first, lengths = np.array([zlib.crc32(a) for a, _ in pairs], np.uint32), np.array([len(b) for _, b in pairs])
    got = resample.carried(first, lengths) ^ np.array([zlib.crc32(b) for _, b in pairs], np.uint32)
    assert got.tolist() == [zlib.crc32(a + b) for a, b in pairs]


# --- 13 filter audit

def audited(rows, labels):
    """Brute force over (doc_id, lang, text) and {doc_id: (quality, toxic)}: every order applied to every document."""
    first = {}
    for i, _, text in rows:
        first[text or ""] = min(first.get(text or "", math.inf), math.inf if i is None else i)
    parts = defaultdict(list)
    for i, lang, text in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
            "E": (math.inf if i is None else i) > first[t],
        }
        parts[lang or ""].append(({k for k, v in fails.items() if v}, *labels.get(i, (0, 0))))
    out, shapley = {}, Counter()
    for part, kinds in parts.items():
        for order in map("".join, itertools.permutations("ABCDE")):
            left = kinds
            for n, f in enumerate(order):
                gone = [k for k in left if f in k[0]]
                left = [k for k in left if f not in k[0]]
                failing = [k for k in kinds if f in k[0]]
                shapley[part, f] += len(gone)
                out[part, order, n + 1] = [len(left), len(gone), len(failing) - len(gone), sum(len(k[0]) == 1 for k in failing), sum(k[1] == 1 for k in gone), sum(k[2] == 1 for k in gone)]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_is_brute_force(spark):
    rng = random.Random(4)
    texts = ODD_TEXTS + ["Le " * 250, "LOUD " * 250, " ".join(f"w{i}" for i in range(250)), " ".join(f"W{i}" for i in range(199)) + " #", "é " * 200 + "\n"]
    rows = [(i, rng.choice(["en", "fr", None]), rng.choice(texts)) for i in range(150)]
    rows += [(0, "de", rows[0][2]), (3, "en", "own"), (3, "en", "own"), (None, "en", "own"), (None, None, None), (None, "fr", "alone")]
    marks = {i: (rng.randrange(2), rng.randrange(2)) for i in range(0, 150, 2)}
    labels = spark.createDataFrame([(i, q, t, "x") for i, (q, t) in marks.items()] + [(1, None, None, "x"), (None, 1, 1, "x"), (4, 0, None, "x")], "doc_id long, quality int, toxic int, fails string")
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string").withColumns({"part": F.lit(1), "n": F.lit(2), "digest_": F.lit("x"), "quality": F.lit(1)})
    got = {(r[0], r[1], r[2]): tuple(r[3:]) for r in filter_audit.filter_audit(df.repartition(6), labels).collect()}
    assert got == audited(rows, marks)
    assert filter_audit.filter_audit(df.limit(0), labels).count() == 0
    assert filter_audit.failures(docs(spark, ["", "a"]).drop("fails")).select("doc_id", "fails").orderBy("doc_id").collect()[0].fails == 1


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("aAbB #|\n\t")), max_size=30), max_size=6))
def test_transducer_counts(texts):
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    got = filter_audit.transduce(np.frombuffer(b"".join(raw), np.uint8), offsets)
    w = [re.findall(r"[^\x20\x09-\x0D]+", t) for t in texts]
    want = [list(map(len, w)), [len(set(x)) for x in w], [len(re.findall("[A-Z]", t)) for t in texts], list(map(len, texts)), [len(re.findall(r"[#$%&*|]", t)) for t in texts]]
    assert [got[f].tolist() for f in filter_audit.FIGURES] == want
