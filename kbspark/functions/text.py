"""Column functions on texts, file names and token counts."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stop words of the tokeniser (fixed values).
STOP_WORDS = (
    "的 了 是 在 有 和 就 不 人 都 一 一个 上 也 很 到 说 要 去 你 会 着 没有 看 好 自己 这 他 她 它 们 我们 你们 他们 "
    "那 那些 这些 这个 那个 什么 怎么 为什么 吗 吧 呢 啊 呀 哦 嗯 "
    "is the a an and or of to in for on at by with from as into this that"
).split()
_STOP = set(STOP_WORDS)
#: Words of a question that say nothing about its subject (fixed values).
GENERIC_TERMS = (
    "什么 哪些 如何 怎么 为何 为什么 是谁 是什么 是啥 什么意思 一个 一款 一种 东西 玩意 技能 功能 情况 内容 信息 介绍"
).split()
CJK = "[一-鿿]"


def basename(name: Column) -> Column:
    return F.regexp_extract(name, r"([^/\\]*)$", 1)


def normalise_filename(name: Column) -> Column:
    """Base name with other characters than word characters, CJK, ``-``, ``_``, ``.`` and space replaced by ``_``, cut to 200."""
    return F.substring(F.regexp_replace(basename(name), r"(?U)[^\w一-鿿\-_. ]", "_"), 1, 200)


def file_stem(name: Column) -> Column:
    return F.regexp_replace(basename(name), r"(?<=.)\.[^.]*$", "")


def file_suffix(name: Column) -> Column:
    """Lower-case suffix with its dot, empty where there is none."""
    return F.lower(F.regexp_extract(basename(name), r".(\.[^.]+)$", 1))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def count_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?U)\S+"))


def estimate_tokens(text: Column) -> Column:
    """int(1.5 * CJK characters + 1.2 * words beyond them)."""
    cjk = F.regexp_count(text, F.lit(CJK))
    return F.floor(cjk * 1.5 + F.greatest(count_words(text) - cjk, F.lit(0)) * 1.2).cast("int")


def token_bound(text: Column, reserve: int = 0) -> Column:
    """Upper bound of the tokens of any byte-level model: UTF-8 bytes and a reserve, no less than the estimate."""
    return F.greatest((F.octet_length(text) + F.lit(reserve)).cast("int"), estimate_tokens(text))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits; runs of Han characters become bigrams.  Stop words stay, repeats too."""
    low = F.lower(text)
    plain = F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    runs = F.regexp_extract_all(low, F.lit(r"\p{IsHan}+|[\p{L}\p{N}&&[^\p{IsHan}]]+"), F.lit(0))
    mixed = F.flatten(
        F.transform(
            runs,
            lambda r: F.when(
                r.rlike(r"^\p{IsHan}{2,}"), F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substr(r, i, F.lit(2)))
            ).otherwise(F.array(r)),
        )
    )
    return F.when(low.rlike(r"\p{IsHan}"), mixed).otherwise(plain)


#: Outside of UNLIKE (Han, and what Java's Unicode may not assign yet) Python's letters and digits are those of Java.
WORD = re.compile(r"[^\W_]+")
UNLIKE = r"[\x{860}-\x{10FFFF}&&[^\x{900}-\x{BFF}\x{E00}-\x{16FF}\x{1E00}-\x{2BFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7A3}\x{FE00}-\x{FFEF}\x{1F000}-\x{1FAFF}]]"
ASCII_WORD = bytes(c if chr(c).isalnum() and c < 128 else 32 for c in range(256))
#: Texts whose counts leave a task together; tokens counted before they leave it.
COUNTED_TEXTS, HELD_TERMS = 500, 500_000


def counters(batch: pa.RecordBatch) -> Iterator[Counter]:
    """For each row (low, cut) how often each word that is no stop word occurs."""
    for t, cut in zip(batch["low"].to_pylist(), batch["cut"].to_pylist(), strict=True):
        if cut:
            n = Counter(t.split())
        elif t.isascii():
            n = Counter(t.encode().translate(ASCII_WORD).decode().split())
        else:
            n = Counter(WORD.findall(t))
        for w in n.keys() & _STOP:
            del n[w]
        yield n


def lowered(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """(keys, low, cut): lower-cased texts, or their tokens joined by spaces where ``cut`` is true."""
    rows = df.select(*keys, text, F.lower(F.coalesce(text, F.lit(""))).alias("low")).withColumn("cut", F.col("low").rlike(UNLIKE))
    return rows.select(*keys, F.when(F.col("cut"), F.array_join(tokens(F.col(text)), " ")).otherwise(F.col("low")).alias("low"), "cut")


def word_counts(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, dl, words, tfs): how many of the :func:`tokens` of a row are no stop words, which words these are, in order of first occurrence, and how often each occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, COUNTED_TEXTS):
                part = batch.slice(at, COUNTED_TEXTS)
                dl, ends, words, tfs = [], [0], [], []
                for n in counters(part):
                    words += n.keys()
                    tfs += n.values()
                    dl.append(n.total())
                    ends.append(len(words))
                ends = pa.array(ends, pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(words, pa.string())), pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int32()))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(dl, pa.int32()), *lists], [key, "dl", "words", "tfs"])

    return lowered(df, text, key).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, dl int, words array<string>, tfs array<int>")


def partial_term_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """(token, df, total), several rows a token: rows that hold it, and the length in words of some rows; together, of all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = Counter(), 0

        def flushed() -> pa.RecordBatch:
            totals = [total] + [0] * (len(held) - 1)
            return pa.RecordBatch.from_arrays([pa.array(held, pa.string()), pa.array(held.values(), pa.int64()), pa.array(totals, pa.int64())], ["token", "df", "total"])

        for batch in batches:
            for n in counters(batch):
                held.update(n.keys())
                total += n.total()
                if len(held) > HELD_TERMS:
                    yield flushed()
                    held, total = Counter(), 0
        if held:
            yield flushed()

    return lowered(df, text).mapInArrow(run, "token string, df long, total long")


def query_terms(text: Column) -> Column:
    """Distinct tokens of more than one character in order, without stop words and generic terms."""
    drop = sorted({*STOP_WORDS, *GENERIC_TERMS})
    return F.array_distinct(F.filter(tokens(text), lambda t: (F.length(t) > 1) & ~t.isin(drop)))


def context_prefix(title: Column, path: Column, limit: int = 96) -> Column:
    """Title and heading path joined by a line break, cut to ``limit`` characters; empty parts left out."""
    return F.substring(F.concat_ws("\n", F.nullif(title, F.lit("")), F.nullif(path, F.lit(""))), 1, limit)


def search_text(text: Column, fields: list[Column], filename: Column) -> Column:
    """What exact matching looks at: text, listed fields, stem and extension, one per line, empty ones left out."""
    parts = [text, *fields, file_stem(filename), file_suffix(filename)]
    return F.concat_ws("\n", *[F.nullif(F.trim(p.cast("string")), F.lit("")) for p in parts])


def first_not_blank(*columns: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])
