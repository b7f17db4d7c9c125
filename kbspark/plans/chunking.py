"""Queries over chunking."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.functions import text as T
from kbspark.operators import chunking as C
from kbspark.operators import documents as D
from kbspark.plans.base import CUR, DONE, FLUSHED, closed_sql, fold_sql, query, table
from kbspark.plans.documents import MARKDOWN
from kbspark.sources.corpus import GenerationSink
from kbspark.sources.shared import shared_folder

PARA = r"""para AS (SELECT doc_id, unnest(range(len(l)))::INTEGER AS idx, unnest(l) AS text FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)),
  lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS l FROM documents))"""


def lines(spark: SparkSession, d: str) -> DataFrame:
    parts = F.filter(F.transform(F.split("text", "\n"), T.collapse), lambda p: p != "")
    return table(spark, d, "documents").select("doc_id", F.posexplode(parts).alias("idx", "text"))


def _char(sep: str) -> str:
    return " || ".join("chr(10)" if c == "\n" else f"'{c}'" for c in sep)


def _level_sql(x: str, sep: str, size: str, last: bool) -> str:
    fits = f"length({CUR}) + CASE WHEN {CUR} = '' THEN 0 ELSE {len(sep)} END + length(x[1]) <= {size}"
    alone = "" if last else f"WHEN length(x[1]) > {size} THEN list_concat({FLUSHED}, [x[1], ''])"
    step = f"CASE WHEN {fits} THEN list_append({DONE}, CASE WHEN {CUR} = '' THEN x[1] ELSE {CUR} || {_char(sep)} || x[1] END) {alone} ELSE list_append({FLUSHED}, x[1]) END"
    return f"CASE WHEN length({x}) > {size} THEN {closed_sql(fold_sql(f'string_split({x}, {_char(sep)})', step))} WHEN trim({x}) = '' THEN [] ELSE [{x}] END"


def split_sql(text: str, size: str, separators=C.SEPARATORS) -> str:
    """A text cut at one separator after the other."""
    out = _level_sql(text, separators[0], size, len(separators) == 1)
    for n, sep in enumerate(separators[1:], 2):
        out = f"flatten(list_transform({out}, lambda x{n}: {_level_sql(f'x{n}', sep, size, n == len(separators))}))"
    return out


def merge_sql(pieces: str, size: str) -> str:
    right, left = rf"regexp_replace({CUR}, '\s+$', '')", r"regexp_replace(x[1], '^\s+', '')"
    step = f"CASE WHEN {CUR} = '' THEN list_append({DONE}, x[1]) WHEN length({right}) + 2 + length({left}) <= {size} THEN list_append({DONE}, {right} || chr(10) || chr(10) || {left}) ELSE list_append(acc, x[1]) END"
    return closed_sql(fold_sql(pieces, step))


RECURSIVE = f"""cut AS (SELECT doc_id, {split_sql('text', '512')} AS l FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
merged AS (SELECT doc_id, {merge_sql('l', '512')} AS l FROM cut), piece AS (SELECT doc_id, unnest(range(len(l)))::INTEGER AS idx, unnest(l) AS text FROM merged),
chunk AS (SELECT doc_id, idx, CASE WHEN b IS NOT NULL AND room > 0 THEN right(b, room) ELSE '' END || text AS text
  FROM (SELECT *, lag(text) OVER (PARTITION BY doc_id ORDER BY idx) AS b, greatest(least(100, 512 - length(text)), 0) AS room FROM piece))"""


@query("B3", f"WITH {RECURSIVE} SELECT * FROM chunk")
def recursive(spark: SparkSession, d: str) -> DataFrame:
    return C.recursive_chunks(table(spark, d, "documents"))


@query("B4", f"""WITH {PARA}, l AS (SELECT *, lag(text) OVER (PARTITION BY doc_id ORDER BY idx) AS b, greatest(least(50, 300 - length(text)), 0) AS room FROM para)
  SELECT doc_id, idx, CASE WHEN b IS NOT NULL AND room > 0 THEN right(b, room) ELSE '' END || text AS text FROM l""")
def overlap(spark: SparkSession, d: str) -> DataFrame:
    return C.add_overlap(lines(spark, d), 300, 50)


TOKENS = "floor(len(regexp_extract_all(text, '[一-鿿]')) * 1.5 + greatest(len(regexp_extract_all(text, '\\S+')) - len(regexp_extract_all(text, '[一-鿿]')), 0) * 1.2)"


@query("B5", rf"""WITH {RECURSIVE}, t AS (SELECT *, {TOKENS.replace(chr(92) * 2, chr(92))} AS t FROM chunk), z AS (SELECT *, greatest(floor(length(text) * (60.0::DOUBLE / greatest(t, 1)) * 0.9), 50)::INTEGER AS size FROM t),
  c AS (SELECT doc_id, idx, size, CASE WHEN t > 60 THEN {split_sql('text', 'size', C.SEPARATORS[1:])} ELSE [text] END AS l, t FROM z), m AS (SELECT doc_id, idx, size, CASE WHEN t > 60 THEN {merge_sql('l', 'size')} ELSE l END AS l FROM c),
  p AS (SELECT doc_id, idx, size, unnest(range(len(l))) AS sub, unnest(l) AS text FROM m), b AS (SELECT *, lag(text) OVER (PARTITION BY doc_id, idx ORDER BY sub) AS b, greatest(least(50, size - length(text)), 0) AS room FROM p)
  SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY idx, sub) - 1)::INTEGER AS idx, CASE WHEN b IS NOT NULL AND room > 0 THEN right(b, room) ELSE '' END || text AS text FROM b""")
def resplit(spark: SparkSession, d: str) -> DataFrame:
    return C.recursive_chunks(table(spark, d, "documents"), max_tokens=60)


def pack_sql(parts: str, size: int) -> str:
    step = f"CASE WHEN length(x[1]) > {size} THEN list_concat({FLUSHED}, [x[1], '']) WHEN length({CUR}) + length(x[1]) <= {size} THEN list_append({DONE}, {CUR} || x[1]) ELSE list_append({FLUSHED}, x[1]) END"
    return closed_sql(fold_sql(parts, step))


def _behind(text: str, signs: str) -> str:
    return rf"string_split(regexp_replace({text}, '([{signs}])\s*', '\1' || chr(1), 'g'), chr(1))"


_HARD = "CASE WHEN length(v) > 512 THEN list_transform(range(0, (length(v) - 1) // 512 + 1), lambda i: substring(v, i * 512 + 1, 512)) ELSE [v] END"
_CLAUSES = f"flatten(list_transform({pack_sql(_behind('u', '，,；;、'), 512)}, lambda v: {_HARD}))"
SENTENCES = rf"""sent AS (SELECT doc_id, list_filter(list_transform({_behind("coalesce(text, '')", '。！？.!?；;')}, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS s FROM documents),
packed AS (SELECT doc_id, s, {pack_sql('s', 512)} AS p FROM sent), whole AS (SELECT doc_id, s, flatten(list_transform(p, lambda u: CASE WHEN length(u) > 512 THEN {_CLAUSES} ELSE [u] END)) AS c FROM packed),
chunk AS (SELECT doc_id, s, unnest(range(len(c)))::INTEGER AS idx, unnest(c) AS text FROM whole)"""


@query("B6", f"WITH {SENTENCES} SELECT doc_id, idx, text FROM chunk")
def sentence_chunks(spark: SparkSession, d: str) -> DataFrame:
    return C.sentence_chunks(table(spark, d, "documents"), overlap_sentences=0)


@query("B7", r"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([。！？.!?；;])\s*', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS l FROM documents)
  SELECT doc_id, unnest(range(len(l)))::INTEGER AS pos, unnest(l) AS text FROM s""")
def sentences(spark: SparkSession, d: str) -> DataFrame:
    return C.sentences(table(spark, d, "documents"))


@query("B8", f"""WITH {SENTENCES}, a AS (SELECT *, coalesce(list_position(list_transform(s, lambda x: contains(x, left(text, 20))), TRUE), 0) AS first FROM chunk)
  SELECT doc_id, idx, CASE WHEN idx > 0 AND first > 1 THEN right(array_to_string(s[greatest(first - 2, 1):first - 1], ''), 100) ELSE '' END || text AS text FROM a""")
def sentence_overlap(spark: SparkSession, d: str) -> DataFrame:
    return C.sentence_chunks(table(spark, d, "documents"))


@query("B9", """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang || ' > ' || source END AS heading_path, left(source || CASE WHEN doc_id % 3 = 0 THEN '' ELSE chr(10) || lang || ' > ' || source END, 12) AS prefix FROM documents""")
def prefix(spark: SparkSession, d: str) -> DataFrame:
    empty = F.array().cast("array<string>")
    b = table(spark, d, "documents").select("doc_id", "source", F.when(F.col("doc_id") % 3 == 0, empty).otherwise(F.array("lang", "source")).alias("heading_path"), empty.alias("table_headers"))
    b = C.block_context(b)
    return b.select("doc_id", "heading_path", T.context_prefix(F.col("source"), F.col("heading_path"), 12).alias("prefix"))


def blocks(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("# "), "source", F.lit("\n"), "text").alias("text"))
    return D.markdown_blocks(docs)


_L, _X = "acc[len(acc)]", "x[1]"
_NEW = f"({_L}.g + CASE WHEN {_L}.n > 0 THEN 1 ELSE 0 END)"
_PATH = f"CASE WHEN {_X}.p = '' THEN {_L}.path ELSE {_X}.p END"
#: What becomes of the state (g: parent being filled, n: its blocks, t: its tokens, its path, whether it is one heading) and which parent a block joins, case by case.
_CASES = (
    (f"{_X}.kind IN ('heading', 'title')", (_NEW, "1", f"{_X}.tok", f"{_X}.p", "TRUE", _NEW)),
    (f"{_X}.kind IN ('table', 'code') AND {_L}.n = 1 AND {_L}.head AND {_L}.path = {_X}.p", (f"{_L}.g + 1", "0", "0", "''", "FALSE", f"{_L}.g")),
    (f"{_X}.kind IN ('table', 'code')", (f"{_NEW} + 1", "0", "0", "''", "FALSE", _NEW)),
    (f"{_L}.n > 0 AND (({_L}.path <> '' AND {_X}.p <> '' AND {_L}.path <> {_X}.p) OR {_L}.t + {_X}.tok > 1024)", (f"{_L}.g + 1", "1", f"{_X}.tok", _PATH, "FALSE", f"{_L}.g + 1")),
    ("TRUE", (f"{_L}.g", f"{_L}.n + 1", f"{_L}.t + {_X}.tok", _PATH, "FALSE", f"{_L}.g")),
)
_STATE = ", ".join(f"'{name}': CASE " + " ".join(f"WHEN {when} THEN {then[i]}" for when, then in _CASES) + " END" for i, name in enumerate(("g", "n", "t", "path", "head", "id")))
_ITEM = "{'g': 0, 'n': 0, 't': 0, 'path': '', 'head': FALSE, 'id': 0, 'tok': %s, 'p': %s, 'kind': %s, 'text': %s, 'pos': %s}"
PARENTS = f"""md AS ({MARKDOWN}), tk AS (SELECT doc_id, pos, kind, trim(text) AS text, coalesce(heading_path, '') AS p FROM md WHERE trim(text) <> ''),
bt AS (SELECT *, {TOKENS.replace(chr(92) * 2, chr(92))}::INTEGER AS tok FROM tk),
fo AS (SELECT doc_id, list_reduce(list_transform(list_prepend({_ITEM % ("0", "''", "''", "''", "-1")}, list({_ITEM % ("tok", "p", "kind", "text", "pos")} ORDER BY pos)), lambda y: [y]),
  lambda acc, x: list_append(acc, {{{_STATE}, 'tok': {_X}.tok, 'p': {_X}.p, 'kind': {_X}.kind, 'text': {_X}.text, 'pos': {_X}.pos}})) AS l FROM bt GROUP BY doc_id),
un AS (SELECT doc_id, unnest(l[2:]) AS b FROM fo), nb AS (SELECT doc_id, b.id AS parent_index, b.kind AS kind, b.text AS text, b.pos AS pos, b.p AS p FROM un),
par AS (SELECT doc_id, parent_index::INTEGER AS parent_index, doc_id || ':p' || parent_index AS parent_id, string_agg(text, chr(10) ORDER BY pos) AS text,
  coalesce(arg_max(kind, pos) FILTER (kind NOT IN ('heading', 'title')), arg_min(kind, pos)) AS kind, coalesce(arg_max(p, pos) FILTER (kind NOT IN ('heading', 'title')), arg_min(p, pos)) AS heading_path FROM nb GROUP BY doc_id, parent_index)"""


@query("B10", f"WITH {PARENTS} SELECT * FROM par")
def parents(spark: SparkSession, d: str) -> DataFrame:
    return C.build_parents(blocks(spark, d))


@query("B11")
def children(spark: SparkSession, d: str) -> DataFrame:
    return C.build_children(C.build_parents(blocks(spark, d)), target=256)


@query("B12", f"WITH {PARA} SELECT doc_id || '_' || (row_number() OVER (PARTITION BY doc_id ORDER BY idx) - 1) AS chunk_id, (row_number() OVER (PARTITION BY doc_id ORDER BY idx) - 1)::INTEGER AS chunk_index, text FROM para")
def numbered(spark: SparkSession, d: str) -> DataFrame:
    return C.number_chunks(lines(spark, d), ["idx"]).select("chunk_id", "chunk_index", "text")


@query("B13", f"""WITH {PARA}, s AS (SELECT doc_id, count(*) AS stored FROM para WHERE doc_id % 10 <> 4 GROUP BY ALL), e AS (SELECT doc_id, count(*) + max(CASE WHEN doc_id % 10 = 7 THEN 1 ELSE 0 END) AS expected FROM para WHERE doc_id % 10 <> 2 GROUP BY doc_id)
  SELECT doc_id, expected, coalesce(stored, 0) AS stored, CASE WHEN expected IS NULL THEN 'unknown' WHEN stored IS NULL THEN 'empty' ELSE 'count' END AS problem FROM e FULL JOIN s USING (doc_id) WHERE expected IS DISTINCT FROM stored""")
def validation(spark: SparkSession, d: str) -> DataFrame:
    x = lines(spark, d)
    expected = x.where("doc_id % 10 <> 2").groupBy("doc_id").agg((F.count(F.lit(1)) + F.max(F.when(F.col("doc_id") % 10 == 7, 1).otherwise(0))).alias("expected"))
    return C.validate_generation(x.where("doc_id % 10 <> 4"), expected)


@query("B14", rf"""WITH {PARA}, c AS (SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY idx) AS text FROM para GROUP BY ALL)
  SELECT * FROM (SELECT doc_id, text, floor(len(regexp_extract_all(text, '[^\s]+')) * 1.2)::INTEGER AS tokens FROM c) WHERE tokens <= 400""")
def full_context(spark: SparkSession, d: str) -> DataFrame:
    return C.full_context(lines(spark, d).withColumnRenamed("idx", "parent_index"), 400)


@query("A13", f"""WITH {PARA}, c AS (SELECT doc_id, count(*) AS chunks, sum(length(text) * (idx + 1))::BIGINT AS weight FROM para GROUP BY doc_id),
  lost AS (SELECT count(*) AS first_try, count(*) FILTER (doc_id % 10 = 4) AS second FROM c)
  SELECT doc_id, chunks, weight, 'g1' AS index_id, first_try AS retried, second AS refused FROM c, lost""")
def generations(spark: SparkSession, d: str) -> DataFrame:
    """Two generations: the first is written without its first chunks, refused and retried; the second lacks documents and never becomes active."""
    chunks, sink = lines(spark, d), GenerationSink(spark, f"{shared_folder(spark)}/generations-{uuid.uuid4().hex}")
    expected = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("expected"))
    retried = sink.publish(chunks.where("idx > 0"), "g1", expected).count()
    sink.publish(chunks, "g1", expected)
    refused = sink.publish(chunks.where("doc_id % 10 <> 4"), "g2", expected).count()
    got = sink.read().groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length("text") * (F.col("idx") + 1)).alias("weight"))
    return got.withColumns({"index_id": F.lit(sink.active()), "retried": F.lit(retried).cast("long"), "refused": F.lit(refused).cast("long")})
