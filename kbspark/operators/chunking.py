"""Chunking (B): narrow folds over the text of one row; no shuffle but for numbering.

Flat chunkers give (doc_id, idx, text); the parent/child chunker gives parents and children.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kbspark.functions.text import estimate_tokens

SEPARATORS = ("\n\n", "\n", "。", ".", " ")
SENTENCE_END = r"(?<=[。！？.!?；;])\s*"
CLAUSE_END = r"(?<=[，,；;、])\s*"
NONE = "CAST(array() AS array<string>)"
START = f"named_struct('done', {NONE}, 'cur', '')"


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def _level(x: str, sep: str, size: str, last: bool) -> str:
    """SQL: the pieces of ``x`` at one separator, filled up to ``size``; a piece that is too long alone stays as it is, for the next separator."""
    s, n = _sql(sep), len(sep)
    fits = f"length(acc.cur) + IF(acc.cur = '', 0, {n}) + length(part) <= {size}"
    flushed = "IF(acc.cur = '', acc.done, array_append(acc.done, acc.cur))"
    alone = "false" if last else f"length(part) > {size}"
    step = (
        f"CASE WHEN {fits} THEN named_struct('done', acc.done, 'cur', IF(acc.cur = '', part, concat(acc.cur, {s}, part))) "
        f"WHEN {alone} THEN named_struct('done', array_append({flushed}, part), 'cur', '') "
        f"ELSE named_struct('done', {flushed}, 'cur', part) END"
    )
    fold = f"aggregate(split({x}, {_sql(re.escape(sep))}), {START}, (acc, part) -> {step}, acc -> IF(acc.cur = '', acc.done, array_append(acc.done, acc.cur)))"
    return f"CASE WHEN length({x}) > {size} THEN {fold} WHEN trim({x}) = '' THEN {NONE} ELSE array({x}) END"


def split_recursive(text: str, size: str, separators: tuple[str, ...] = SEPARATORS) -> Column:
    """array<string> of the column named ``text``, cut at the first separator and, where pieces stay too long, at the next ones.

    A piece without any separator stays whole.  Text that was emitted is not emitted again.  Both columns are variables
    of an outer function, as what they stand for would else be computed anew for every piece.
    """
    out = _level("row.text", separators[0], "row.size", len(separators) == 1)
    for n, sep in enumerate(separators[1:], 2):
        out = f"flatten(transform({out}, x{n} -> {_level(f'x{n}', sep, 'row.size', n == len(separators))}))"
    return F.expr(f"transform(array(named_struct('text', {text}, 'size', {size})), row -> {out})[0]")


def merge_small(pieces: Column, size: Column | int, joiner: str = "\n\n") -> Column:
    """Neighbours joined by ``joiner`` (their touching white space dropped) while they fit."""
    size = size if isinstance(size, Column) else F.lit(size)
    row = F.array(F.struct(pieces.alias("pieces"), size.alias("size")))  # computed once, not for every piece
    return F.transform(row, lambda r: _merged(r["pieces"], r["size"], joiner))[0]


def _merged(pieces: Column, size: Column, joiner: str) -> Column:
    right = lambda c: F.regexp_replace(c, r"(?U)\s+$", "")
    left = lambda c: F.regexp_replace(c, r"(?U)^\s+", "")

    def step(acc: Column, c: Column) -> Column:
        a, b = right(acc["cur"]), left(c)
        fits = F.length(a) + F.lit(len(joiner)) + F.length(b) <= size
        return (
            F.when(acc["cur"] == "", F.struct(acc["done"].alias("done"), c.alias("cur")))
            .when(fits, F.struct(acc["done"].alias("done"), F.concat(a, F.lit(joiner), b).alias("cur")))
            .otherwise(F.struct(F.array_append(acc["done"], acc["cur"]).alias("done"), c.alias("cur")))
        )

    return F.aggregate(pieces, F.expr(START), step, lambda acc: F.when(acc["cur"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["cur"])))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is computed once a row: one behind a generator is not put in wherever its name stands, nor into the filters before another generator."""
    rest = [c for c in df.columns if c != name]
    return df.select(*rest, F.explode(F.array(F.struct(value.alias("v")))).alias("once_")).select(*rest, F.col("once_.v").alias(name))


def recursive_chunks(docs: DataFrame, size: int = 512, overlap: int = 100, max_tokens: int | None = None) -> DataFrame:
    """(doc_id, idx, text): recursive split, merge of small neighbours, overlap; with ``max_tokens`` long chunks are cut again."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("size_", F.lit(size))
    rows = once(rows, "p_", merge_small(split_recursive("text", "size_"), F.col("size_")))
    pieces = rows.select("doc_id", F.posexplode("p_").alias("idx", "text"))
    pieces = add_overlap(pieces, size, overlap)
    return pieces if max_tokens is None else resplit(pieces, max_tokens, max(overlap // 2, 10))


def add_overlap(chunks: DataFrame, size: int, overlap: int) -> DataFrame:
    """Each chunk behind the last min(overlap, size - length) characters of its un-overlapped predecessor."""
    before = F.lag("text").over(Window.partitionBy("doc_id").orderBy("idx"))
    room = F.greatest(F.least(F.lit(overlap), F.lit(size) - F.length("text")), F.lit(0))
    return chunks.withColumn("b_", before).select("doc_id", "idx", F.concat(F.when((room > 0) & F.col("b_").isNotNull(), F.right("b_", room)).otherwise(""), "text").alias("text"))


def resplit(chunks: DataFrame, max_tokens: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> DataFrame:
    """Chunks over ``max_tokens`` cut again at the remaining separators, to max(int(length * ratio * 0.9), 50) characters; renumbered.

    A chunk that cannot be cut at any remaining separator stays as it is.
    """
    rest = separators[1:] if len(separators) > 1 else separators
    c = once(once(chunks, "text", F.col("text")), "t_", estimate_tokens(F.col("text")))
    c = once(c, "size_", F.greatest(F.floor(F.length("text") * (F.lit(max_tokens) / F.greatest("t_", F.lit(1))) * 0.9).cast("int"), F.lit(50)))
    cut = merge_small(split_recursive("text", "size_", rest), F.col("size_"))
    c = once(c, "p_", F.when(F.col("t_") > max_tokens, cut).otherwise(F.array("text")))
    order = Window.partitionBy("doc_id").orderBy("idx", "sub")
    out = c.select("doc_id", "idx", "size_", F.posexplode("p_").alias("sub", "text"))
    before = F.lag("text").over(Window.partitionBy("doc_id", "idx").orderBy("sub"))
    room = F.greatest(F.least(F.lit(overlap), F.col("size_") - F.length("text")), F.lit(0))
    out = out.withColumn("b_", before)
    text = F.concat(F.when((room > 0) & F.col("b_").isNotNull(), F.right("b_", room)).otherwise(""), "text")
    return out.select("doc_id", (F.row_number().over(order) - 1).alias("idx"), text.alias("text"))


def sentence_array(text: Column) -> Column:
    """Sentences: cut behind ends of sentences, trimmed, empty ones dropped."""
    bare = F.transform(F.split(text, SENTENCE_END), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", ""))
    return F.filter(bare, lambda s: s != "")


def sentences(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode(sentence_array(F.coalesce("text", F.lit("")))).alias("pos", "text"))


def _pack(parts: Column, size: int) -> Column:
    """Parts joined without a separator while they fit; a part that is too long stands alone."""

    def step(acc: Column, p: Column) -> Column:
        flushed = F.when(acc["cur"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["cur"]))
        return (
            F.when(F.length(p) > size, F.struct(F.array_append(flushed, p).alias("done"), F.lit("").alias("cur")))
            .when(F.length(acc["cur"]) + F.length(p) <= size, F.struct(acc["done"].alias("done"), F.concat(acc["cur"], p).alias("cur")))
            .otherwise(F.struct(flushed.alias("done"), p.alias("cur")))
        )

    return F.aggregate(parts, F.expr(START), step, lambda acc: F.when(acc["cur"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["cur"])))


def _hard_cut(text: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor((F.length(text) - 1) / size).cast("int")), lambda i: F.substr(text, i * size + 1, F.lit(size)))


def sentence_chunks(docs: DataFrame, size: int = 512, overlap: int = 100, overlap_sentences: int = 2) -> DataFrame:
    """(doc_id, idx, text): sentences packed to ``size``; a longer one is cut at clauses, then hard; with the last sentences before a chunk as its overlap."""
    cut = lambda x, f: F.when(F.length(x) > size, f(x)).otherwise(F.array(x))
    clause = lambda x: F.flatten(F.transform(_pack(F.split(x, CLAUSE_END), size), lambda y: cut(y, lambda z: _hard_cut(z, size))))
    s = docs.select("doc_id", sentence_array(F.coalesce("text", F.lit(""))).alias("s"))
    s = s.withColumn("c", F.flatten(F.transform(_pack(F.col("s"), size), lambda x: cut(x, clause))))
    rows = s.select("doc_id", "s", F.posexplode("c").alias("idx", "text"))
    if not overlap_sentences or not overlap:
        return rows.select("doc_id", "idx", "text")
    head = F.left("text", F.lit(20))
    at = F.array_position(F.transform("s", lambda x: F.contains(x, head)), F.lit(True)).cast("int")
    first = F.greatest(at - overlap_sentences, F.lit(1))
    lead = F.when((F.col("idx") > 0) & (at > 1), F.right(F.array_join(F.slice("s", first, at - first), ""), F.lit(overlap))).otherwise("")
    return rows.select("doc_id", "idx", F.concat(lead, "text").alias("text"))


def block_context(blocks: DataFrame) -> DataFrame:
    """Plus heading_path and table_headers as text, from arrays."""
    return blocks.withColumns({"heading_path": F.concat_ws(" > ", "heading_path"), "table_headers": F.concat_ws(" | ", "table_headers")})


def build_parents(blocks: DataFrame, max_tokens: int = 1024) -> DataFrame:
    """(doc_id, parent_index, parent_id, text, kind, heading_path) from blocks (doc_id, pos, kind, text, heading_path).

    Blocks are joined while the heading path stays and the tokens fit; a heading begins a parent;
    tables and code stand alone but keep one directly preceding heading of their path.
    """
    b = blocks.withColumn("text", F.trim("text")).where("text <> ''").withColumn("t", estimate_tokens(F.col("text")))
    item = F.struct("pos", "kind", "text", F.coalesce("heading_path", F.lit("")).alias("path"), "t")
    rows = b.groupBy("doc_id").agg(F.sort_array(F.collect_list(item)).alias("b"))
    # g: number of the parent that is being filled; n: blocks in it; head: whether that is one heading
    start = "named_struct('g', 0, 'n', 0, 't', 0, 'path', '', 'head', false, 'ids', CAST(array() AS array<int>))"
    heading, isolated = "x.kind IN ('heading', 'title')", "x.kind IN ('table', 'code')"
    context = "acc.n = 1 AND acc.head AND acc.path = x.path"
    new = "(acc.g + IF(acc.n > 0, 1, 0))"
    breaks = f"acc.n > 0 AND ((acc.path <> '' AND x.path <> '' AND acc.path <> x.path) OR acc.t + x.t > {max_tokens})"
    put = lambda g, n, t, path, head, i: f"named_struct('g', {g}, 'n', {n}, 't', {t}, 'path', {path}, 'head', {head}, 'ids', array_append(acc.ids, {i}))"
    step = (
        f"CASE WHEN {heading} THEN {put(new, '1', 'x.t', 'x.path', 'true', new)} "
        f"WHEN {isolated} AND {context} THEN {put('acc.g + 1', '0', '0', chr(39) * 2, 'false', 'acc.g')} "
        f"WHEN {isolated} THEN {put(new + ' + 1', '0', '0', chr(39) * 2, 'false', new)} "
        f"WHEN {breaks} THEN {put('acc.g + 1', '1', 'x.t', 'IF(x.path = %s, acc.path, x.path)' % (chr(39) * 2), 'false', 'acc.g + 1')} "
        f"ELSE {put('acc.g', 'acc.n + 1', 'acc.t + x.t', 'IF(x.path = %s, acc.path, x.path)' % (chr(39) * 2), 'false', 'acc.g')} END"
    )
    ids = rows.withColumn("ids", F.expr(f"aggregate(b, {start}, (acc, x) -> {step}, acc -> acc.ids)"))
    each = ids.select("doc_id", F.inline(F.arrays_zip("b", "ids"))).select("doc_id", F.col("ids").alias("parent_index"), "b.*")
    evidence = F.max(F.when(~F.col("kind").isin("heading", "title"), F.struct("pos", "kind", "path")))
    parents = each.groupBy("doc_id", "parent_index").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x.text), "\n").alias("text"),
        F.coalesce(evidence, F.min(F.struct("pos", "kind", "path"))).alias("e"),
    )
    return parents.select(
        "doc_id", "parent_index", F.concat(F.col("doc_id").cast("string"), F.lit(":p"), F.col("parent_index").cast("string")).alias("parent_id"),
        "text", F.col("e.kind").alias("kind"), F.col("e.path").alias("heading_path"),
    )


def _tokens(text: str) -> int:
    cjk = len(re.findall("[一-鿿]", text))
    return int(cjk * 1.5 + max(len(text.split()) - cjk, 0) * 1.2)


def _largest_fit(text: str, fits) -> int:
    """Length of the longest prefix found by bisection that fits, at least 1."""
    low, high, best = 1, len(text), 1
    while low <= high:
        mid = (low + high) // 2
        if text[:mid].strip() and fits(text[:mid].strip()):
            low, best = mid + 1, mid
        else:
            high = mid - 1
    return best


def split_by_budget(text: str, prefix: str, target: int, hard: int, continuity: int) -> list[str]:
    """Bodies of the children of one parent: units of the first separator that cuts, packed with line breaks while ``prefix`` and body fit."""
    target = max(1, min(target, hard))
    cost = lambda body: _tokens(f"{prefix}\n{body}".strip() if prefix else body)
    text = (text or "").strip()
    units = [text] if text else []
    for sep in SEPARATORS:
        parts = [p.strip() for p in text.split(sep) if p.strip()] if sep in text else []
        if len(parts) > 1:
            units = parts
            break
        units = parts or units
    fitted: list[str] = []
    for rest in units:
        while rest:
            n = len(rest) if cost(rest) <= target else _largest_fit(rest, lambda s: cost(s) <= target)
            fitted.append(rest[:n].strip())
            rest = rest[n:].strip()
    packed: list[str] = []
    for u in filter(None, fitted):
        if packed and cost(f"{packed[-1]}\n{u}".strip()) <= target:
            packed[-1] = f"{packed[-1]}\n{u}".strip()
        else:
            packed.append(u)
    out = packed[:1]
    for before, body in zip(packed, packed[1:], strict=False):
        tail = before if continuity > 0 else ""
        while tail and (_tokens(tail) > continuity or cost(f"{tail}\n{body}".strip()) > target):
            tail = tail[max(1, len(tail) // 8) :].strip()
        joined = f"{tail}\n{body}".strip() if tail else body
        out.append(joined if cost(joined) <= target else body)
    return out


def build_children(parents: DataFrame, target: int = 512, hard: int | None = None, continuity: int = 40, title: str | None = None) -> DataFrame:
    """(doc_id, parent_id, parent_index, child_index, text): children with their context prefix.

    A child over ``hard`` tokens raises an error when run.  ``title`` names a column of parents.
    """
    limit = hard or target
    head = F.coalesce(F.col(title), F.lit("")) if title else F.lit("")
    path = F.when(F.col("heading_path") != head, F.col("heading_path"))
    prefix = F.substring(F.concat_ws("\n", F.nullif(head, F.lit("")), F.nullif(path, F.lit(""))), 1, 96)
    rows = parents.select("doc_id", "parent_id", "parent_index", "text", prefix.alias("prefix"))
    id_type = parents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [
                (r.doc_id, r.parent_id, r.parent_index, n, f"{r.prefix}\n{body}".strip() if r.prefix else body)
                for r in pdf.itertuples() for n, body in enumerate(split_by_budget(r.text, r.prefix or "", target, limit, continuity))
            ]
            yield pd.DataFrame(out, columns=["doc_id", "parent_id", "parent_index", "child_index", "text"])

    kids = rows.mapInPandas(run, f"doc_id {id_type}, parent_id string, parent_index int, child_index int, text string")
    over = estimate_tokens(F.col("text")) > limit
    return kids.withColumn("text", F.when(over, F.raise_error(F.lit("child chunk exceeds the token limit"))).otherwise(F.col("text")))


def number_chunks(chunks: DataFrame, order_by: list[str]) -> DataFrame:
    """Plus chunk_index from 0 in document order and chunk_id ``{doc_id}_{chunk_index}``."""
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy(*order_by)) - 1
    return chunks.withColumn("chunk_index", n).withColumn("chunk_id", F.concat(F.col("doc_id").cast("string"), F.lit("_"), F.col("chunk_index").cast("string")))


def validate_generation(chunks: DataFrame, expected: DataFrame) -> DataFrame:
    """(doc_id, expected, stored, problem) of documents (doc_id, expected) without chunks or whose stored number differs, and of unknown ones."""
    stored = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("stored"))
    j = expected.join(stored, "doc_id", "full")
    s = F.coalesce("stored", F.lit(0))
    problem = F.when(F.col("expected").isNull(), "unknown").when(s == 0, "empty").when(s != F.col("expected"), "count")
    return j.select("doc_id", "expected", s.alias("stored"), problem.alias("problem")).where("problem IS NOT NULL")


def full_context(parents: DataFrame, budget: int) -> DataFrame:
    """(doc_id, text, tokens) of documents whose parents, joined by blank lines, fit the budget."""
    parts = F.sort_array(F.collect_list(F.struct("parent_index", "text")))
    docs = parents.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda x: x.text), "\n\n").alias("text"))
    return docs.withColumn("tokens", estimate_tokens(F.col("text"))).where(F.col("tokens") <= budget)
