"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence has the probability sigmoid(b + sum of the weights of
its words); a document is toxic if any sentence is (noisy-or): P = 1 - prod(1 - p_i).  Weights are
trained from document labels alone and afterwards point at the sentences to blame.

Training uses at most about :data:`MAX_TRAIN_DOCS` labelled rows of about :data:`MAX_TRAIN_CHARS` characters in
all, chosen by a hash of the id, and runs in one task of bounded size; everything else is a narrow pass over
whole texts, in which only the texts go to Python.  Words are hashed to
2**BITS features; words that occur in fewer than :data:`MIN_DOCS` training documents, or in toxic ones
no more often than chance allows, weigh nothing.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, text_of

MAX_TRAIN_DOCS, MAX_TRAIN_CHARS = 20_000, 200_000_000
BITS = 18
MIN_DOCS = 3
CHANCE = 1.0  # words expected to pass the screen by chance
EPOCHS, MIN_UPDATES = 12, 600
CACHE = 1 << 18
SENTENCE = re.compile(r"[.!?\n]+")
EDGE = ".,;:!?\"'()[]{}*#$%&|-_<>"


class Words(dict):
    """word -> feature, filled on demand; emptied by :meth:`trim` when it has grown large."""

    def __missing__(self, word: str) -> int:
        x = zlib.crc32(word.strip(EDGE).lower().encode()) & ((1 << BITS) - 1)
        self[word] = x
        return x

    def trim(self) -> None:
        if len(self) > CACHE:
            self.clear()


def sentences(text: str) -> list[str]:
    return [s for s in SENTENCE.split(text) if s.strip()]


def fit_weights(docs: list[tuple[int, list[np.ndarray]]]) -> tuple[np.ndarray, float]:
    """Minimise the log loss of noisy-or over (label, sentences as arrays of features) by Adagrad."""
    size = 1 << BITS
    df, toxic = np.zeros(size), np.zeros(size)
    for y, bags in docs:
        if bags:
            f = np.unique(np.concatenate(bags))
            df[f] += 1
            toxic[f] += y
    # words that toxic documents hold no more often than chance explains (Chernoff bound) weigh nothing
    often = df >= MIN_DOCS
    base = min(max(sum(y for y, _ in docs) / max(1, len(docs)), 1e-6), 1 - 1e-6)
    share = np.clip(toxic / np.maximum(df, 1), 1e-12, 1 - 1e-12)
    surprise = df * (share * np.log(share / base) + (1 - share) * np.log((1 - share) / (1 - base)))
    use = often & (share > base) & (surprise > math.log(max(1, often.sum()) / CHANCE))
    w, g2, b, gb2 = np.zeros(size), np.full(size, 1e-6), -6.0, 1e-6
    rng = np.random.default_rng(7)
    packed = []
    for y, bags in docs:
        bags = [f[use[f]] for f in bags]
        packed.append((y, np.concatenate(bags) if bags else np.zeros(0, np.int64), np.array([len(f) for f in bags], np.int64)))
    batches = max(1, len(packed) // 128)
    for _ in range(max(EPOCHS, -(-MIN_UPDATES // batches))):  # few documents are seen more often
        for part in np.array_split(rng.permutation(len(packed)), batches):
            rows = [packed[i] for i in part if len(packed[i][2])]
            if not rows:
                continue
            y = np.array([r[0] for r in rows])
            f, lens = np.concatenate([r[1] for r in rows]), np.concatenate([r[2] for r in rows])
            n = np.array([len(r[2]) for r in rows])
            sent, doc = np.repeat(np.arange(len(lens)), lens), np.repeat(np.arange(len(rows)), n)
            z = b + np.bincount(sent, w[f], minlength=len(lens))
            soft = np.logaddexp(0, z)
            total = np.bincount(doc, soft, minlength=len(rows))
            pull = np.where(y == 1, -1 / np.expm1(np.clip(total, 1e-6, 50)), 1.0)
            gz = pull[doc] * np.exp(z - soft) / len(rows)
            g = np.bincount(f, gz[sent], minlength=size) + 1e-5 * w
            g2 += g * g
            w -= 0.3 * g / np.sqrt(g2) * use
            gb2 += gz.sum() ** 2
            b -= 0.05 * gz.sum() / np.sqrt(gb2)
    return w, b


def train(docs: DataFrame, labels: DataFrame, learn_from=None, max_docs: int = MAX_TRAIN_DOCS) -> tuple[np.ndarray, float]:
    """Weights and bias.  ``docs``: doc_id, text; ``labels``: doc_id, toxic.

    Null labels are left out, several labels of a document count as their largest, null texts as
    empty.  With no labelled rows every weight is zero.
    """
    lab = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    if learn_from is not None:
        lab = lab.where(learn_from)
    lab = lab.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("y"))
    texts = docs.select("doc_id", text_of("text").alias("text"))
    size = texts.select("doc_id", F.length("text").alias("k")).join(lab, "doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("k")).first()
    share = min(1.0, max_docs / max(1, size.n), MAX_TRAIN_CHARS / max(1, size.k or 0))
    lab = lab.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < math.ceil(share * 1_000_000))
    chosen = texts.join(lab, "doc_id").select("y", "text")

    def featurise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words()
        for pdf in batches:
            words.trim()
            bags = [[np.unique([words[x] for x in s.split()]).astype(np.int32) for s in sentences(t)] for t in pdf["text"]]
            yield pd.DataFrame({
                "y": pdf["y"],
                "lens": [np.array([len(x) for x in d], np.int32).tobytes() for d in bags],
                "f": [np.concatenate([np.zeros(0, np.int32), *d]).astype(np.int32).tobytes() for d in bags],
            })

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y", "lens", "f"])  # the result must not depend on the order of arrival
        rows = [
            (int(y), np.split(np.frombuffer(f, np.int32).astype(np.int64), np.cumsum(np.frombuffer(n, np.int32))[:-1]) if n else [])
            for y, n, f in zip(pdf["y"], pdf["lens"], pdf["f"], strict=True)
        ]
        w, b = fit_weights(rows)
        return pd.DataFrame({"w": [w.astype(np.float32).tobytes()], "b": [b]})

    bags = chosen.mapInPandas(featurise, "y int, lens binary, f binary").withColumn("g", F.lit(0))
    model = bags.groupBy("g").applyInPandas(fit, "w binary, b double").collect()
    if not model:
        return np.zeros(1 << BITS, np.float32), -6.0
    return np.frombuffer(model[0].w, np.float32), float(model[0].b)


def scorer(docs: DataFrame, model: tuple[np.ndarray, float], n_worst: int = 0) -> Column:
    """The score of ``docs.text`` or, with ``n_worst``, struct<score, worst array<struct<p, sentence>>>.

    Only texts go to Python; all other columns stay where they are.  The model is at most 2**BITS floats.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    full = pa.struct([("score", pa.float64()), ("worst", pa.list_(pa.struct([("p", pa.float64()), ("sentence", pa.string())])))])

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        w, b = shared.value
        weights = w.astype(np.float64).tolist()
        features = Words()

        class Weights(dict):
            def __missing__(self, word: str) -> float:
                self[word] = x = weights[features[word]]
                return x

        known = Weights()
        for batch in batches:
            if len(known) > CACHE:
                known.clear()
                features.clear()
            out = []
            for text in batch:
                parts = sentences(text.as_py())
                z = np.array([sum(map(known.__getitem__, set(s.split()))) for s in parts]) + b
                p = float(-np.expm1(-np.logaddexp(0, z).sum())) if parts else 0.0
                if n_worst:
                    top = np.argsort(-z, kind="stable")[:n_worst]
                    out.append({"score": p, "worst": [{"p": float(1 / (1 + np.exp(-z[i]))), "sentence": parts[i]} for i in top]})
                else:
                    out.append(p)
            yield pa.array(out, full if n_worst else pa.float64())

    kind = "struct<score:double,worst:array<struct<p:double,sentence:string>>>" if n_worst else "double"
    return F.arrow_udf(run, kind)(text_of("text"))


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, n_worst: int = 3) -> DataFrame:
    """doc_id, held_out, score, predicted and the ``n_worst`` worst sentences, one row per row of ``docs``.

    Learns from rows that are not held out.  A null or empty text has no sentence and scores 0; null
    and repeated ids pass through; extra columns are ignored; an empty table gives an empty result.
    """
    model = train(docs, labels, crc_mod("doc_id", folds) != 0)
    return docs.select("doc_id", scorer(docs, model, n_worst).alias("r")).select(
        "doc_id",
        (crc_mod("doc_id", folds) == 0).alias("held_out"),
        "r.score",
        (F.col("r.score") >= 0.5).cast("int").alias("predicted"),
        "r.worst",
    )


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose score is under 0.5, with all their columns, whatever their names.

    Null and empty texts stay (they score 0); an empty table gives an empty result.
    """
    model = train(docs, labels, crc_mod("doc_id", 5) != 0)
    return docs.where(scorer(docs, model) < 0.5)
