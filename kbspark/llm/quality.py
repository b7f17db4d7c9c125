"""Quality classifier from weak labels.

Seven overlapping heuristic labellers vote good, bad or nothing on every document.  The votes of the
whole corpus are counted by pattern (at most 3**7 rows), and expectation-maximisation over the
patterns estimates each labeller's accuracy per class and the share of good documents.  The posterior
of a pattern is the soft label of its documents; a linear scorer over hashed words, word shapes and
repetition is trained on those and scores every document.

The scorer is fitted on at most about MAX_TRAIN_DOCS documents of about MAX_TRAIN_CHARS characters in all,
chosen by a hash of the id, in one task of bounded size; the votes are counted over all documents.  No
hand-made label is used.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

MAX_TRAIN_DOCS, MAX_TRAIN_CHARS = 20_000, 200_000_000
BITS = 18
PART_BYTES = 6 << 20  # texts taken together
EPOCHS = 8
#: Common function words of English, French, German and Spanish.
FUNCTION_WORDS = (
    "the of and to in is for that it with as on was be by this are or an at from "
    "de la le et les des en un une du que qui dans est pour par sur pas au "
    "der die und das den von zu mit ist im auf ein eine nicht sich dem "
    "el los las y del se por con una su para es al lo como"
).split()
LABELLERS = ("capitals", "symbols", "repetition", "function_words", "sentences", "word_length", "lines")


def measures(texts: DataFrame) -> DataFrame:
    """``texts`` (with a column text) plus the counts that the labellers look at; words and lines are cut once per text."""
    cut = texts.select(
        "*",
        F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "").alias("words_"),
        F.filter(F.split("text", "\n"), lambda s: F.trim(s) != "").alias("lines_"),
    )
    counts = {
        "n": F.size("words_"),
        "distinct": F.size(F.array_distinct("words_")),
        "function": F.size(F.filter("words_", lambda w: w.isin(FUNCTION_WORDS))),
        "lines": F.size("lines_"),
        "distinct_lines": F.size(F.array_distinct("lines_")),
        "chars": F.length("text"),
        "letters": F.length(F.regexp_replace("text", r"\P{L}+", "")),
        "upper": F.regexp_count("text", F.lit(r"\p{Lu}")),
        "symbols": F.regexp_count("text", F.lit(r"[^\p{L}\p{N}\s.,]")),
        "ends": F.regexp_count("text", F.lit(r"[.!?]+(\s|$)")),
    }
    return cut.select(*texts.columns, *[c.alias("m_" + k) for k, c in counts.items()])


def votes() -> dict[str, Column]:
    """Each labeller's vote on a row of :func:`measures`: 1 good, 0 bad, null for no opinion."""
    n, distinct, function, lines, distinct_lines, chars, letters, upper, symbols, ends = (
        F.col("m_" + k) for k in ("n", "distinct", "function", "lines", "distinct_lines", "chars", "letters", "upper", "symbols", "ends")
    )
    good, bad = F.lit(1), F.lit(0)
    return {
        "capitals": F.when(letters < 10, None).when(upper > 0.3 * letters, bad).when(upper < 0.1 * letters, good),
        "symbols": F.when(chars < 10, None).when(symbols > 0.05 * chars, bad).when(symbols < 0.02 * chars, good),
        "repetition": F.when(n < 40, None).when(distinct < 0.35 * n, bad).when(distinct > 0.5 * n, good),
        "function_words": F.when(n < 20, None).when(function < 0.04 * n, bad).when(function > 0.1 * n, good),
        "sentences": F.when(n < 40, None).when((ends * 60 < n) | (ends * 4 > n), bad).when((ends * 30 > n) & (ends * 6 < n), good),
        "word_length": F.when(n < 10, None).when((chars > 8 * n) | (chars < 4 * n), bad).when((chars > 4.5 * n) & (chars < 7.5 * n), good),
        "lines": F.when(lines < 4, None).when(distinct_lines < 0.5 * lines, bad).when(distinct_lines > 0.8 * lines, good),
    }


def patterns_of(texts: DataFrame) -> DataFrame:
    """``texts`` plus p, the votes of all labellers in order, -1 for no opinion."""
    of = votes()
    return measures(texts).select(*texts.columns, F.array(*[F.coalesce(of[k], F.lit(-1)) for k in LABELLERS]).alias("p"))


def fit_labellers(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """EM for votes that are independent given the class: (posterior of each pattern, accuracy[class, labeller], prior).

    ``patterns`` holds -1 for no vote, 0 or 1.  Voting or not carries no information.
    """
    voted = patterns >= 0
    share = np.where(voted, patterns, 0).sum(axis=1) / np.maximum(1, voted.sum(axis=1))
    post = np.where(voted.any(axis=1), 0.1 + 0.8 * share, 0.5)
    acc, prior = np.full((2, patterns.shape[1]), 0.8), 0.5
    for _ in range(rounds):
        prior = float(np.clip((counts * post).sum() / max(1, counts.sum()), 0.01, 0.99))
        for c, weight in ((0, counts * (1 - post)), (1, counts * post)):
            right = (weight[:, None] * (voted & (patterns == c))).sum(axis=0)
            seen = (weight[:, None] * voted).sum(axis=0)
            acc[c] = np.clip((right + 8) / (seen + 10), 0.05, 0.995)
        like = [
            np.where(voted, np.where(patterns == c, np.log(acc[c]), np.log(1 - acc[c])), 0).sum(axis=1) + np.log(p)
            for c, p in ((0, 1 - prior), (1, prior))
        ]
        post = 1 / (1 + np.exp(np.clip(like[0] - like[1], -500, 500)))
    return post, acc, prior


def shapes(words: pa.Array) -> pa.Array:
    """Capitals as X, other letters as x, digits as 9, runs of one of them shortened; at most 12 characters."""
    for pattern, to in ((r"\p{Lu}", "X"), (r"[\p{Ll}\p{Lt}\p{Lm}\p{Lo}]", "x"), (r"\p{Nd}", "9"), ("XX+", "X+"), ("xx+", "x+"), ("99+", "9+")):
        words = pc.replace_substring_regex(words, pattern, to)
    return pc.utf8_slice_codeunits(words, 0, 12)


def hashes(words: pa.Array, kind: bytes) -> np.ndarray:
    """Feature of each word, hashed once per distinct one."""
    coded = words.dictionary_encode()
    own = np.array([zlib.crc32(kind + w.encode()) & ((1 << BITS) - 1) for w in coded.dictionary.to_pylist()], np.int64)
    return own[coded.indices.to_numpy()] if len(own) else own


def features(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """(features of the distinct words [word, shape], their index by token, tokens of each text, word and line repeats).

    A text's words are cut at white space; repeats are the shares of its words and lines that occurred
    before in it.  Every text is taken whole; words are hashed once per batch.
    """
    lists = pc.utf8_split_whitespace(texts)
    flat, n = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(n)), n)
    some = pc.not_equal(flat, "")
    doc, coded = doc[some.to_numpy(zero_copy_only=False)], flat.filter(some).dictionary_encode()
    at, words = coded.indices.to_numpy(), coded.dictionary
    hashed = np.column_stack([hashes(pc.utf8_lower(words), b"w"), hashes(shapes(words), b"s")])
    n = np.bincount(doc, minlength=len(n))
    pairs = np.sort(doc * max(1, len(words)) + at)
    first = np.concatenate([[True], pairs[1:] != pairs[:-1]])[: len(pairs)]
    seen = np.bincount(pairs[first] // max(1, len(words)), minlength=len(n))
    line_repeats = np.zeros(len(n))
    for i, text in enumerate(texts):
        lines = [s for s in text.as_py().split("\n") if s.strip()]
        if len(lines) > 1:
            line_repeats[i] = 1 - len(set(lines)) / len(lines)
    return hashed, at, n, np.where(n > 0, 1 - seen / np.maximum(1, n), 0.0), line_repeats


def parts(texts: pa.Array) -> Iterator[slice]:
    """Slices of ``texts`` of about PART_BYTES each."""
    at = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) // PART_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(at)) + 1), len(texts)]
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        if hi > lo:
            yield slice(int(lo), int(hi))


def fit_scorer(rows: list[tuple[float, np.ndarray, float, float]]) -> tuple[np.ndarray, np.ndarray]:
    """Logistic regression on soft labels by Adagrad: (feature weights, [bias, word repeats, line repeats])."""
    size = 1 << BITS
    w, g2, v, v2 = np.zeros(size), np.full(size, 1e-8), np.zeros(3), np.full(3, 1e-8)
    rng = np.random.default_rng(11)
    for _ in range(EPOCHS):
        for part in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // 128)):
            own = [rows[i] for i in part if len(rows[i][1])]
            if not own:
                continue
            y = np.array([r[0] for r in own])
            f, n = np.concatenate([r[1] for r in own]), np.array([len(r[1]) for r in own])
            doc, extra = np.repeat(np.arange(len(own)), n), np.array([[1.0, r[2], r[3]] for r in own])
            z = 2 * np.bincount(doc, w[f], minlength=len(own)) / n + extra @ v
            d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(own)
            g = 2 * np.bincount(f, (d / n)[doc], minlength=size) + 1e-7 * w
            g2 += g * g
            w -= 0.3 * g / np.sqrt(g2)
            e = d @ extra
            v2 += e * e
            v -= 0.3 * e / np.sqrt(v2)
    return w, v


def train(docs: DataFrame, max_docs: int = MAX_TRAIN_DOCS) -> tuple[np.ndarray, np.ndarray, pd.DataFrame]:
    """Scorer weights, and a table of the labellers' estimated accuracies."""
    texts = docs.select("doc_id", text_of("text").alias("text")).where("text <> ''")
    table = patterns_of(texts).groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("k")).orderBy("p").collect()
    if not table:
        return np.zeros(1 << BITS, np.float32), np.zeros(3), pd.DataFrame()
    patterns, counts = np.array([r.p for r in table]), np.array([r.n for r in table], float)
    post, acc, _ = fit_labellers(patterns, counts)
    share = min(1.0, max_docs / counts.sum(), MAX_TRAIN_CHARS / sum(r.k for r in table))
    soft = {tuple(p): float(q) for p, q in zip(patterns.tolist(), post, strict=True)}
    chosen = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < max(1, int(share * 1_000_000)))

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole[part] for whole in batches for part in parts(whole["text"])):
            hashed, at, n, rw, rl = features(batch["text"])
            ends = np.cumsum(n)
            bags = [hashed[at[e - k : e]].astype(np.int32).ravel().tobytes() for e, k in zip(ends, n, strict=True)]
            y = [soft[tuple(p)] for p in batch["p"].to_pylist()]
            yield pa.RecordBatch.from_pydict({"y": y, "f": pa.array(bags, pa.binary()), "rw": rw, "rl": rl, "g": pa.array([0] * len(y), pa.int32())})

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y", "rw", "rl", "f"])  # the result must not depend on the order of arrival
        w, v = fit_scorer([(r.y, np.frombuffer(r.f, np.int32), r.rw, r.rl) for r in pdf.itertuples()])
        return pd.DataFrame({"w": [w.astype(np.float32).tobytes()], "v": [v.tolist()]})

    bags = patterns_of(chosen).select("p", "text").mapInArrow(featurise, "y double, f binary, rw double, rl double, g int")
    model = bags.groupBy("g").applyInPandas(fit, "w binary, v array<double>").collect()
    report = pd.DataFrame({"labeller": LABELLERS, "accuracy_bad": acc[0], "accuracy_good": acc[1]})
    if not model:
        return np.zeros(1 << BITS, np.float32), np.zeros(3), report
    return np.frombuffer(model[0].w, np.float32), np.array(model[0].v), report


def scorer(docs: DataFrame, w: np.ndarray, v: np.ndarray) -> Column:
    """The quality of ``docs.text`` (0 to 1, higher: better); texts without words, and null ones, score 0.

    Only texts go to Python; all other columns stay where they are.
    """
    shared = docs.sparkSession.sparkContext.broadcast((w, v))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        w, v = shared.value

        def one(texts: pa.Array) -> np.ndarray:
            hashed, at, n, rw, rl = features(texts)
            weights = w[hashed].astype(np.float64).sum(axis=1)
            total = np.bincount(np.repeat(np.arange(len(n)), n), weights[at], minlength=len(n))
            z = total / np.maximum(1, n) + v[0] + v[1] * rw + v[2] * rl
            return np.where(n > 0, 1 / (1 + np.exp(-np.clip(z, -30, 30))), 0.0)

        for batch in batches:
            yield pa.array(np.concatenate([np.zeros(0), *(one(batch[part]) for part in parts(batch))]))

    return F.arrow_udf(run, "double")(text_of("text"))


def classify(docs: DataFrame) -> DataFrame:
    """doc_id, quality_score, kept (score of at least 0.5) for every row, null and repeated ids included.

    Extra columns are ignored; an empty table gives an empty result.
    """
    w, v, _ = train(docs)
    scored = docs.select("doc_id", scorer(docs, w, v).alias("quality_score"))
    return scored.withColumn("kept", F.col("quality_score") >= 0.5)


def reject_low_quality(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that score 0.5 or more, with all their columns, whatever their names."""
    w, v, _ = train(docs)
    return docs.where(scorer(docs, w, v) >= 0.5)
