"""Corpus admission and document structure (A)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kbspark.functions.text import collapse, file_suffix

EXTENSIONS = (".txt", ".md", ".html", ".csv", ".pdf", ".docx", ".xlsx", ".markdown")


def admit(files: DataFrame, max_bytes: int = 20_000_000, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """``files`` (filename, content) plus extension, size_bytes and reject_reason (null: admitted)."""
    size = F.octet_length(F.coalesce("content", F.lit("")))
    ext = file_suffix(F.col("filename"))
    reason = (
        F.when(F.col("filename").isNull() | (F.col("filename") == ""), "no_filename")
        .when(~ext.isin(*extensions), "extension")
        .when(size == 0, "empty")
        .when(size > max_bytes, "too_large")
    )
    return files.withColumns({"extension": ext, "size_bytes": size, "reject_reason": reason})


def paragraph_blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, text): paragraphs between blank lines, white space collapsed, empty ones dropped."""
    parts = F.filter(F.transform(F.split("text", r"\n\s*\n"), collapse), lambda p: p != "")
    return docs.select("doc_id", F.posexplode(parts).alias("pos", "text"))


def table_blocks(rows: DataFrame, table_id: list[str], order_by: list[str], columns: list[str], group_size: int = 30) -> DataFrame:
    """Rows of tables as text blocks: a ``table_schema`` block, then ``table`` blocks of ``group_size`` rows.

    Each row is its cells joined by `` | ``; every table block repeats the header.  row_start and
    row_end count rows from the header, which is row 1.  A table is the rows of one ``table_id``.
    """
    header = F.lit(" | ".join(columns))
    line = F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    filled = rows.where(F.greatest(*[F.length(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns], F.lit(0)) > 0)
    n = F.row_number().over(Window.partitionBy(*table_id).orderBy(*order_by))
    numbered = filled.select(*table_id, n.alias("rn"), line.alias("line"))
    groups = (
        numbered.withColumn("block", F.floor((F.col("rn") - 1) / group_size) + 1)
        .groupBy(*table_id, "block")
        .agg(F.sort_array(F.collect_list(F.struct("rn", "line"))).alias("g"))
        .select(
            *table_id, F.col("block").cast("int").alias("pos"), F.lit("table").alias("kind"),
            F.concat(header, F.lit("\n"), F.array_join(F.transform("g", lambda x: x.line), "\n")).alias("text"),
            (F.array_min(F.transform("g", lambda x: x.rn)) + 1).alias("row_start"),
            (F.array_max(F.transform("g", lambda x: x.rn)) + 1).alias("row_end"),
        )
    )
    schema = numbered.select(*table_id).distinct().select(
        *table_id, F.lit(0).alias("pos"), F.lit("table_schema").alias("kind"), header.alias("text"),
        F.lit(1).alias("row_start"), F.lit(1).alias("row_end"),
    )
    return schema.unionByName(groups)


NOISE_TAGS = {"script", "style", "nav", "footer", "aside", "noscript", "header", "form", "iframe"}
NOISE_CLASS = re.compile(r"(?i)\b(ad|ads|advert|sidebar|nav|menu|footer|cookie|banner|breadcrumb)\b")
BLOCK_TAGS = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "pre", "code", "blockquote", "table", "title"}
VOID_TAGS = {"br", "hr", "img", "input", "meta", "link", "source", "wbr", "area", "base", "col", "embed", "track"}


class _Blocks(HTMLParser):
    """Emits (tag, text, region, class) of block elements outside noise; region: main, article or body."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, str]] = []  # tag, is noise, class
        self.out: list[tuple[str, str, str, str]] = []
        self.parts: list[str] | None = None
        self.block, self.block_class = "", ""

    def _region(self) -> str:
        tags = {t for t, _, _ in self.open}
        return "main" if "main" in tags else "article" if "article" in tags else "body"

    def _flush(self) -> None:
        if self.parts is not None:
            text = re.sub(r"\s+", " ", "".join(self.parts)).strip()
            if text:
                self.out.append((self.block, text, self._region(), self.block_class))
        self.parts = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID_TAGS:
            if self.parts is not None:
                self.parts.append(" ")
            return
        cls = dict(attrs).get("class") or ""
        noise = tag in NOISE_TAGS or bool(NOISE_CLASS.search(cls))
        self.open.append((tag, noise, cls))
        if tag in BLOCK_TAGS and not any(n for _, n, _ in self.open) and not (self.parts is not None and self.block == "table"):
            self._flush()
            self.parts, self.block, self.block_class = [], tag, cls

    def handle_endtag(self, tag: str) -> None:
        if tag == self.block and self.parts is not None:
            self._flush()
        elif tag in {"td", "th"} and self.parts is not None:
            self.parts.append(" | ")
        for n in range(len(self.open) - 1, -1, -1):
            if self.open[n][0] == tag:
                del self.open[n:]
                break

    def handle_data(self, data: str) -> None:
        if self.parts is not None and not any(n for _, n, _ in self.open):
            self.parts.append(data)


def html_elements(pages: DataFrame) -> DataFrame:
    """(page_id, n, tag, text, region, class): block elements in document order.  Null pages have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for page_id, html in zip(pdf["page_id"], pdf["html"], strict=True):
                p = _Blocks()
                p.feed(html or "")
                p.close()
                p._flush()
                rows += [(page_id, n, *x) for n, x in enumerate(p.out)]
            yield pd.DataFrame(rows, columns=["page_id", "n", "tag", "text", "region", "class"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, n int, tag string, text string, region string, class string")


def html_blocks(pages: DataFrame) -> DataFrame:
    """(page_id, pos, kind, text, heading_path): the blocks of the main region, repeated paragraphs and list items dropped.

    The region is ``main`` where it holds text, else ``article``, else the whole page.
    """
    e = html_elements(pages).where("tag <> 'title'")
    page = Window.partitionBy("page_id")
    rank = F.when(F.col("region") == "main", 0).when(F.col("region") == "article", 1).otherwise(2)
    e = e.withColumn("r", rank).withColumn("best", F.min("r").over(page)).where("r = best")
    order = page.orderBy("n")
    level = F.when(F.col("tag").rlike("^h[1-6]$"), F.substring("tag", 2, 1).cast("int"))
    e = e.withColumn("level", level)
    path = []
    for k in range(1, 7):
        # the last heading of level k, unless a higher one came after it
        last = F.last(F.when(F.col("level") == k, F.col("text")), ignorenulls=True).over(order)
        at = F.last(F.when(F.col("level") == k, F.col("n")), ignorenulls=True).over(order)
        above = F.last(F.when(F.col("level") < k, F.col("n")), ignorenulls=True).over(order)
        path.append(F.when(at > F.coalesce(above, F.lit(-1)), last))
    kind = (
        F.when(F.col("level").isNotNull(), "heading").when(F.col("tag") == "li", "list_item").when(F.col("tag").isin("pre", "code"), "code")
        .when(F.col("tag") == "table", "table").when(F.col("tag") == "blockquote", "quote").otherwise("paragraph")
    )
    e = e.withColumn("heading_path", F.concat_ws(" > ", *path)).withColumn("kind", kind)
    again = F.row_number().over(Window.partitionBy("page_id", "kind", "text").orderBy("n"))
    e = e.withColumn("again", again).where((F.col("again") == 1) | ~F.col("kind").isin("paragraph", "list_item"))
    return e.select("page_id", (F.row_number().over(order) - 1).alias("pos"), "kind", "text", "heading_path")


def html_prelude(pages: DataFrame) -> DataFrame:
    """(page_id, title, subtitle): the first h1, else the title element; an element of class ``subtitle`` if it differs."""
    e = html_elements(pages)
    first = lambda c: F.min(F.when(c, F.struct("n", "text")))["text"]
    t = e.groupBy("page_id").agg(
        first(F.col("tag") == "h1").alias("h1"), first(F.col("tag") == "title").alias("t"),
        first(F.col("class").rlike(r"(?i)\bsubtitle\b")).alias("s"),
    )
    title = F.coalesce("h1", "t")
    return pages.select("page_id").join(t, "page_id", "left").select("page_id", title.alias("title"), F.when(F.col("s") != title, F.col("s")).alias("subtitle"))


def markdown_blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, kind, text, heading_path) per non-blank line of markdown; lines inside fences are code."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    order = Window.partitionBy("doc_id").orderBy("n")
    fence = F.col("line").rlike(r"^\s*```")
    lines = lines.withColumn("fences", F.sum(fence.cast("int")).over(order)).where(~fence & (F.trim("line") != ""))
    code = F.col("fences") % 2 == 1
    level = F.when(~code, F.nullif(F.length(F.regexp_extract("line", r"^(#{1,6}) +\S", 1)), F.lit(0)))
    kind = (
        F.when(code, "code").when(level.isNotNull(), "heading").when(F.col("line").rlike(r"^\s*([-*+]|\d+\.) +"), "list_item")
        .when(F.col("line").rlike(r"^\s*\|.*\|\s*$"), "table").when(F.col("line").rlike(r"^\s*>"), "quote").otherwise("paragraph")
    )
    text = F.when(code, F.col("line")).otherwise(F.trim(F.regexp_replace("line", r"^\s*(#{1,6} +|[-*+] +|\d+\. +|> ?)", "")))
    b = lines.select("doc_id", "n", kind.alias("kind"), text.alias("text"), level.alias("level"))
    path = []
    for k in range(1, 7):
        last = F.last(F.when(F.col("level") == k, F.col("text")), ignorenulls=True).over(order)
        at = F.last(F.when(F.col("level") == k, F.col("n")), ignorenulls=True).over(order)
        above = F.last(F.when(F.col("level") < k, F.col("n")), ignorenulls=True).over(order)
        path.append(F.when(at > F.coalesce(above, F.lit(-1)), last))
    return b.select("doc_id", (F.row_number().over(order) - 1).alias("pos"), "kind", "text", F.concat_ws(" > ", *path).alias("heading_path"))


def drop_recent_repeats(paragraphs: Column, window: int = 3) -> Column:
    """Paragraphs without those equal to one of the last ``window`` kept ones."""
    return F.aggregate(
        paragraphs,
        F.expr("CAST(array() AS array<string>)"),
        lambda acc, x: F.when(F.exists(F.slice(acc, F.greatest(F.size(acc) - window + 1, F.lit(1)), window), lambda y: y == x), acc).otherwise(
            F.array_append(acc, x)
        ),
    )


def prepend_prelude(blocks: DataFrame, prelude: DataFrame) -> DataFrame:
    """``blocks`` (doc_id, pos, kind, text) with a ``title`` block at pos -1 made of prelude lines other than the first line."""
    head = blocks.groupBy("doc_id").agg(F.min(F.struct("pos", "text"))["text"].alias("head"))
    lines = F.array_compact(F.array(F.nullif("title", F.lit("")), F.nullif("subtitle", F.lit(""))))
    p = prelude.join(head, "doc_id", "left").withColumn("l", lines)
    p = p.withColumn("l", F.filter("l", lambda x: F.col("head").isNull() | (x != F.col("head")))).where(F.size("l") > 0)
    titles = p.select("doc_id", F.lit(-1).alias("pos"), F.lit("title").alias("kind"), F.array_join("l", "\n").alias("text"))
    return blocks.select("doc_id", "pos", "kind", "text").unionByName(titles)


def prepare_qa(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Multi-hop QA records -> (documents, cases).

    Documents are unique by the slug of their title; a case expects the documents named by its
    supporting facts.  Records: _id, question, answer, type, level, context array<struct<title,
    sentences>>, supporting_facts array<struct<title, sent>>.
    """
    slug = lambda c: F.trim(F.regexp_replace(F.lower(c), r"(?U)[^\w]+", "-"), F.lit("-"))
    c = records.select(F.inline("context"))
    docs = c.select(slug(F.col("title")).alias("doc_id"), "title", F.array_join("sentences", " ").alias("content"))
    docs = docs.groupBy("doc_id").agg(F.min(F.struct("title", "content")).alias("m")).select("doc_id", "m.*")
    cases = records.select(
        F.col("_id").alias("case_id"), F.col("question").alias("query"), F.col("type").alias("category"), F.col("level").alias("difficulty"),
        F.sort_array(F.array_distinct(F.transform("supporting_facts", lambda s: slug(s.title)))).alias("expected_doc_ids"),
        F.array(F.array("answer")).alias("expected_facts"),
    )
    return docs, cases
