"""Readers and writers with declared schemas; nothing is inferred."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """CSV with a header, quoted line breaks and doubled quotes; all columns as declared. CSV cannot tell null from empty: missing
    text is ``''``."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path).na.fill("")


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """One JSON object per line; blank lines are skipped and broken ones give nulls."""
    text = spark.read.text(path).where(F.trim("value") != "")
    return text.select(F.from_json("value", schema if isinstance(schema, str) else schema.simpleString()).alias("r")).select("r.*")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole text files, one row per file."""
    return spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_raw(spark: SparkSession, path: str, kinds: str = "*.{pdf,html,htm}") -> DataFrame:
    """(path, length, content, kind) of raw files found recursively; a file that begins with ``%PDF-`` is a PDF whatever its name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", kinds).load(path)
    is_pdf = F.substring(F.hex("content"), 1, 10) == "255044462D"
    return files.select("path", "length", "content", F.when(is_pdf, "pdf").otherwise("html").alias("kind"))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def append_rows(df: DataFrame, path: str) -> None:
    """Appends to a table as one job: all of it is committed or nothing."""
    df.write.mode("append").parquet(path)


def replace_rows(df: DataFrame, path: str) -> int:
    """Empties a table and loads it anew; the number of rows it has then."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).count()


def read_or_empty(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A stored table, or an empty one with this schema where there is none yet."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def write_report(report: DataFrame, path: str) -> None:
    """A report of one row as one JSON file; more rows are an error."""
    rows = report.select(F.to_json(F.struct(*report.columns)).alias("value")).limit(2).collect()
    if len(rows) != 1:
        raise ValueError("a report has exactly one row")
    report.sparkSession.createDataFrame(rows, "value string").coalesce(1).write.mode("overwrite").text(path)


@pandas_udf(T.BooleanType())
def robots_allow(rules: pd.Series, agent: pd.Series, url: pd.Series) -> pd.Series:
    """Whether the robots text of a host allows the address for the agent; without a text everything is allowed."""
    known: dict[str, RobotFileParser] = {}

    def allowed(text, who, where):
        if text is None or where is None:
            return True
        if text not in known:
            known[text] = RobotFileParser()
            known[text].parse(text.splitlines())
        return known[text].can_fetch(who or "*", where)

    return pd.Series([allowed(*x) for x in zip(rules, agent, url, strict=True)], dtype=bool)


# Elements, and parts of class names, that hold no content.
_SKIP = {"nav", "footer", "aside", "script", "style", "header", "form", "iframe"}
_BAD = ("nav", "footer", "sidebar", "menu", "breadcrumb", "cookie", "banner", "advert")
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Text(HTMLParser):
    """The text of a page, of its whole and of each kind of root it has: the first main, the first article, the first element whose class
    speaks of content, and the body."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, set[str]]] = []
        self.texts: dict[str, list[str]] = {"": []}

    def handle_starttag(self, tag, attrs):
        if tag in _VOID:
            return
        named = {k: (v or "").lower() for k, v in attrs if k in ("class", "id")}
        _, skipped, roots = self.stack[-1] if self.stack else ("", False, set())
        skip = skipped or tag in _SKIP or any(b in v for b in _BAD for v in named.values())
        begun = {kind for kind, holds in (("main", tag == "main"), ("article", tag == "article"), ("content", "content" in named.get("class", "")), ("body", tag == "body")) if holds and not skip and kind not in self.texts}
        self.texts |= {kind: [] for kind in begun}
        self.stack.append((tag, skip, roots | begun))

    def handle_endtag(self, tag):
        if any(t == tag for t, _, _ in self.stack):
            while self.stack and self.stack.pop()[0] != tag:
                pass

    def handle_data(self, data):
        _, skipped, roots = self.stack[-1] if self.stack else ("", False, set())
        if not skipped and (s := data.strip()):
            for kind in ("", *roots):
                self.texts[kind].append(s)


def html_text(source: str | None) -> str | None:
    """The readable text of a page after ``[[PAGE:1]]``; scripts, navigation and the like are left out. The text is that of the first main
    element, else of the first article, content element or body, else of all. Null stays null."""
    if source is None:
        return None
    p = _Text()
    p.feed(source)
    p.close()
    root = next((k for k in ("main", "article", "content", "body") if k in p.texts), "")
    return "[[PAGE:1]]\n" + "\n".join(p.texts[root])


class _Tables(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[tuple[list[str], list[list[str]]]] = []
        self.open: list[int] = []
        self.cell: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.tables.append(([], []))
            self.open.append(len(self.tables) - 1)
        elif self.open and tag == "tr":
            self.tables[self.open[-1]][1].append([])
        elif self.open and tag in ("td", "th"):
            self.cell = []

    def handle_endtag(self, tag):
        if tag == "table" and self.open:
            self.open.pop()
        elif tag in ("td", "th") and self.open and self.cell is not None:
            text, (head, rows) = " ".join(self.cell), self.tables[self.open[-1]]
            if tag == "th":
                head.append(text.lower())
            elif rows:
                rows[-1].append(text)
            self.cell = None

    def handle_data(self, data):
        if self.cell is not None and (s := data.strip()):
            self.cell.append(s)


def _table_records(source: str | None) -> list[dict]:
    p = _Tables()
    p.feed(source or "")
    p.close()
    return [{"table_no": t, "row_no": r, "header": head, "cells": row} for t, (head, rows) in enumerate(p.tables) for r, row in enumerate(x for x in rows if len(x) > 1)]


_STRINGS = T.ArrayType(T.StringType())
_RECORDS = T.ArrayType(T.StructType([T.StructField("table_no", T.IntegerType()), T.StructField("row_no", T.IntegerType()), T.StructField("header", _STRINGS), T.StructField("cells", _STRINGS)]))


@pandas_udf(_RECORDS)
def html_tables(s: pd.Series) -> pd.Series:
    """The rows of at least two cells of all tables of a page, each with the header cells of its table in lower case."""
    return s.map(_table_records)


def cell_named(row: Column, name: str) -> Column:
    """The cell under the named header; null if there is none, or the table has not as many header cells as the row has cells."""
    at = F.array_position(F.reverse(row["header"]), name)
    return F.when((F.size(row["header"]) == F.size(row["cells"])) & (at > 0), F.get(F.reverse(row["cells"]), (at - 1).cast("int")))


@pandas_udf(T.StringType())
def html_to_text(s: pd.Series) -> pd.Series:
    return s.map(html_text)


_LINK = r"(?is)<a\b[^>]*?\bhref\s*=\s*[\"']([^\"']+)[\"'][^>]*>(.*?)</a>"


@pandas_udf(T.StringType())
def absolute_url(base: pd.Series, link: pd.Series) -> pd.Series:
    """The link as seen from the base address."""
    return pd.Series([None if b is None or x is None else urljoin(b, x) for b, x in zip(base, link, strict=True)], dtype=object)


def page_links(pages: DataFrame, html: str = "html", url: str = "url", wanted: str | None = None, most: int = 20, default_title: str = "") -> DataFrame:
    """The columns of ``pages`` but the HTML, and (link_no, link, link_title, link_format): the first ``most`` links of each page
    whose text or address matches the pattern ``wanted`` (all without one). Addresses are made absolute; a link without text has the default title; the
    format is PDF if the address ends so, else HTML. Null pages have none."""
    raw = F.coalesce(F.col(html), F.lit(""))
    pairs = F.arrays_zip(F.regexp_extract_all(raw, F.lit(_LINK), F.lit(1)).alias("href"), F.regexp_extract_all(raw, F.lit(_LINK), F.lit(2)).alias("inner"))
    named = F.transform(pairs, lambda p: F.struct(p["href"].alias("href"), F.trim(F.regexp_replace(F.regexp_replace(p["inner"], r"<[^>]*>", " "), r"\s+", " ")).alias("words")))
    chosen = F.filter(named, lambda p: F.concat_ws(" ", p["words"], p["href"]).rlike(wanted)) if wanted else named
    rows = pages.select(*[c for c in pages.columns if c != html], F.posexplode(F.slice(chosen, 1, most)).alias("link_no", "_p"))
    rows = rows.withColumn("link", absolute_url(F.col(url), F.col("_p.href"))).withColumn("link_title", F.when(F.col("_p.words") != "", F.col("_p.words")).otherwise(default_title))
    return rows.withColumn("link_format", F.when(F.lower("link").endswith(".pdf"), "PDF").otherwise("HTML")).drop("_p")


def recorded_source():
    """A Python data source ``recorded``: replays JSON answers of search services, one partition per file, so that crawls can be
    repeated offline. Options: ``path`` (folder of .json files)."""
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    class Reader(DataSourceReader):
        def __init__(self, options):
            self.folder = options["path"]

        def partitions(self):
            import os

            return [InputPartition(os.path.join(self.folder, f)) for f in sorted(os.listdir(self.folder)) if f.endswith(".json")] or [InputPartition(None)]

        def read(self, partition) -> Iterator[tuple]:
            if partition.value is not None:
                with open(partition.value, encoding="utf-8") as f:
                    yield partition.value.rsplit("/", 1)[-1][:-5], f.read()

    class Recorded(DataSource):
        @classmethod
        def name(cls):
            return "recorded"

        def schema(self):
            return "query string, body string"

        def reader(self, schema):
            return Reader(self.options)

    return Recorded
