"""Operators on catalogues of sources: scoring, coverage, manifests, logs and identifiers."""

from __future__ import annotations

import difflib
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.functions.text import crop_list, guess_categories, split_list, truthy
from furrow.functions.vocabulary import LOOSE_ZONES, PUBLISHER_POINTS, TABLE_WORDS
from furrow.operators.ordering import prefix_totals
from furrow.session import cut, scratch


def _or(tests: Sequence[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


# --- scores -------------------------------------------------------------------------------------------------------------------


def relevance(crops: Column, zones: Column, tables: Column, text: Column) -> Column:
    """4 a crop (40 at most), 10 for a zone or a zone word, else 5 or 2 for the wider region, 5 a table (30 at most); 40 in all."""
    low = F.lower(F.coalesce(text, F.lit("")))
    zone = F.when((F.size(zones) > 0) | _or([low.contains(z) for z in LOOSE_ZONES]), 10).when(low.contains("nigeria"), 5).when(low.contains("west africa"), 2).otherwise(0)
    return F.least(F.least(F.size(crops) * 4, F.lit(40)) + zone + F.least(F.size(tables) * 5, F.lit(30)), F.lit(40))


def quality(publisher: Column, year: Column, kind: Column, pages: Column, points: Mapping[str, int] = PUBLISHER_POINTS) -> Column:
    """Two thirds of the publisher's points, plus recency and a long PDF; 30 at most. A year that is no number gives none."""
    table = F.create_map(*[F.lit(x) for kv in points.items() for x in kv])
    pub = F.least(F.coalesce(F.try_element_at(table, publisher), F.lit(10)), F.lit(30))
    y = year.try_cast("int")
    age = F.when(y > 2015, 10).when(y >= 2010, 5).otherwise(0)
    form = F.when((kind == "PDF") & (F.coalesce(pages, F.lit(0)) > 10), 10).otherwise(5)
    return F.least(F.bround(pub * 0.67).cast("int") + age + form, F.lit(30))


def accessibility(blocked: Column, paywall: Column, open_access: Column, kind: Column, publisher: Column) -> Column:
    """0 if blocked or paid, 30 for an open PDF, 20 for open HTML, 10 for a network copy, else 0; the first rule that holds."""
    network = F.coalesce(publisher, F.lit("")).contains("ResearchGate")
    return F.when(blocked | paywall, 0).when(network & ~open_access, 10).when(open_access & (kind == "PDF"), 30).when(open_access & (kind == "HTML"), 20).when(network, 10).otherwise(0)


def score_sources(df: DataFrame, *, title="title", abstract="abstract_snippet", crops="crops_covered", zones="zones_mentioned", tables="sql_tables_likely", publisher="publisher", year="year", kind="format", pages="page_count_estimate", blocked="blocked", paywall="paywall", open_access="open_access") -> DataFrame:
    """Adds relevance, quality, accessibility and their sum; columns the table lacks count as empty."""
    col = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    text = F.concat_ws(" ", col(title), col(abstract))
    out = df.withColumn("relevance_score", relevance(crop_list(col(crops)), split_list(col(zones)), split_list(col(tables)), text))
    out = out.withColumn("quality_score", quality(col(publisher), col(year), F.upper(col(kind)), col(pages).cast("int")))
    out = out.withColumn("accessibility_score", accessibility(truthy(col(blocked)), truthy(col(paywall)), truthy(col(open_access)), F.upper(col(kind)), col(publisher)))
    return out.withColumn("total_score", F.col("relevance_score") + F.col("quality_score") + F.col("accessibility_score"))


def feeds_facts(text: Column, kinds: Sequence[str] = ("fertilizer_rate", "spacing", "crop_calendar")) -> Column:
    """Whether the text has a keyword of the given table kinds."""
    return F.size(guess_categories(text, {k: TABLE_WORDS[k] for k in kinds})) > 0


def country_or_default(country: Column, default: str = "Nigeria") -> Column:
    """The country, or the default where it is missing or empty."""
    return F.coalesce(F.nullif(country, F.lit("")), F.lit(default))


# --- coverage -----------------------------------------------------------------------------------------------------------------


def combo_counts(df: DataFrame, left: Column, right: Column, none: str = "(unspecified)") -> DataFrame:
    """(left, right, n) for every pair of list members; an empty right list counts as ``none``."""
    r = F.when(F.size(right) > 0, right).otherwise(F.array(F.lit(none)))
    return df.select(F.explode(left).alias("left"), r.alias("_r")).select("left", F.explode("_r").alias("right")).groupBy("left", "right").agg(F.count("*").alias("n"))


def gap_fillers(df: DataFrame, key: str, left: Column, right: Column, rare: int = 3) -> DataFrame:
    """(key, gap_filler): whether any pair of the row occurs fewer than ``rare`` times; rows without left member do not."""
    r = F.when(F.size(right) > 0, right).otherwise(F.array(F.lit("(unspecified)")))
    flat = df.select(key, F.explode_outer(left).alias("left"), r.alias("_r")).select(key, "left", F.explode("_r").alias("right"))
    counts = combo_counts(df, left, right)
    return flat.join(counts, ["left", "right"], "left").groupBy(key).agg(F.coalesce(F.bool_or(F.col("n") < rare), F.lit(False)).alias("gap_filler"))


def coverage(df: DataFrame, members: Column, domain: Sequence[str]) -> DataFrame:
    """(name, n) over a fixed domain, zeros kept, in the domain's order of ``ord``."""
    spark = df.sparkSession
    counts = df.select(F.explode(members).alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    dims = F.broadcast(spark.createDataFrame(list(enumerate(domain)), "ord int, name string"))
    return dims.join(counts, "name", "left").select("name", "ord", F.coalesce("n", F.lit(0)).alias("n"))


def matrix(df: DataFrame, rows: Column, columns: Column, row_domain: Sequence[str], column_domain: Sequence[str]) -> DataFrame:
    """Counts of list members by list members over fixed domains, one column per ``column_domain`` value, zeros filled."""
    spark = df.sparkSession
    flat = df.select(F.explode(rows).alias("name"), columns.alias("_c")).select("name", F.explode("_c").alias("col"))
    wide = flat.where(F.col("col").isin(*column_domain)).groupBy("name").pivot("col", list(column_domain)).count()
    dims = F.broadcast(spark.createDataFrame([(x,) for x in row_domain], "name string"))
    return dims.join(wide, "name", "left").na.fill(0)


def hard_gaps(df: DataFrame, left: Column, right: Column, left_domain: Sequence[str], right_domain: Sequence[str]) -> DataFrame:
    """The (left, right) pairs of two fixed domains that never occur together."""
    spark = df.sparkSession
    dims = spark.createDataFrame([(a, b) for a in left_domain for b in right_domain], "left string, right string")
    return dims.join(combo_counts(df, left, right), ["left", "right"], "left_anti")


# --- manifests ----------------------------------------------------------------------------------------------------------------


def manifest(scored: DataFrame, *, keep: Column, score: str = "score", order: str = "id") -> DataFrame:
    """The kept rows with ``priority``: 1 for the best score, ties in the given order, missing scores last.

    The rank is global; positions come from ranges, so no task sees all rows."""
    s = F.when(~F.isnan(score), F.col(score))
    return prefix_totals(scored.where(keep), [], [s.desc_nulls_last(), F.col(order).asc()], rank="priority")


def page_estimate(pages: Column, kind: Column) -> Column:
    """Pages if positive, else 15 for a PDF and 1 for anything else."""
    return F.when(pages > 0, pages).when(F.upper(kind) == "PDF", 15).otherwise(1)


def by_publisher(df: DataFrame, publisher: Column, pages: Column) -> DataFrame:
    """(publisher, n, pages, running_pages), most pages first; the running total follows that order, then the name."""
    per = df.groupBy(publisher.alias("publisher")).agg(F.count("*").alias("n"), F.sum(pages).alias("pages"))
    run = prefix_totals(per, [], [F.desc("pages"), F.col("publisher").asc_nulls_first()], {"pages": "before"}, rank="position")
    return run.select("publisher", "n", "pages", (F.col("before") + F.col("pages")).alias("running_pages"), "position")


def _counted(text: str, size: int) -> list[tuple[str, int]]:
    """The runs of ``size`` characters of a text, each with the number of its occurrence so far."""
    seen: dict[str, int] = {}
    out = []
    for i in range(len(text) - size + 1):
        run = text[i : i + size]
        seen[run] = seen.get(run, 0) + 1
        out.append((run, seen[run]))
    return out


def _shared(left: list[str], right: list[str], size: int, wide: int = 4096) -> np.ndarray:
    """How many runs of ``size`` characters each left text has in common with each right one, repeats counted."""
    numbers: dict[tuple[str, int], int] = {}
    sides = [[[numbers.setdefault(x, len(numbers)) for x in _counted(t, size)] for t in left], [[numbers[x] for x in _counted(t, size) if x in numbers] for t in right]]
    flat = [(np.repeat(np.arange(len(side)), [len(x) for x in side]), np.array([n for x in side for n in x], dtype=np.int64)) for side in sides]
    out = np.zeros((len(left), len(right)), np.float32)
    for low in range(0, len(numbers), wide):
        cells = []
        for side, (at, n) in zip(sides, flat, strict=True):
            here = (n >= low) & (n < low + wide)
            m = np.zeros((len(side), min(wide, len(numbers) - low)), np.float32)
            m[at[here], n[here] - low] = 1
            cells.append(m)
        out += cells[0] @ cells[1].T
    return out


def _alike(threshold: float):
    """Pairs of one task: rows of block ``a`` with rows of block ``b`` of a crop, each pair at the first crop it has in common."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        a, b = int(rows["a"].iloc[0]), int(rows["b"].iloc[0])
        left, right = rows[rows["block"] == a].reset_index(drop=True), rows[rows["block"] == b].reset_index(drop=True)
        total = left["n"].to_numpy(np.float64)[:, None] + right["n"].to_numpy(np.float64)[None, :]
        # the ratio is 2 m / total for m matched characters in order; of their m - 1 neighbours at most total - 2 m are torn apart
        least = np.ceil(threshold * total / 2 - 1e-9)
        near = np.minimum(left["n"].to_numpy()[:, None], right["n"].to_numpy()[None, :]) >= least
        if a == b:
            near &= np.tri(len(left), k=-1, dtype=bool)
        for size, need in ((1, least), (2, 3 * least - total - 1)):
            near &= _shared(left["t"].tolist(), right["t"].tolist(), size) >= need
        out = []
        for i, j in zip(*np.nonzero(near), strict=True):
            common = set(left["crops"][i]) & set(right["crops"][j])
            if common and min(common) != left["crop"][i]:
                continue
            (early, te), (late, tl) = sorted(((left["k"][i], left["t"][i]), (right["k"][j], right["t"][j])))
            if (ratio := difflib.SequenceMatcher(None, tl, te).ratio()) > threshold:
                out.append((early, late, ratio))
        return pd.DataFrame(out, columns=["earlier", "later", "ratio"])

    return run


def title_pairs(df: DataFrame, key: str, title: str, crops: Column, threshold: float = 0.85, block: int = 2000, blanks: bool = False) -> DataFrame:
    """(earlier, later, ratio): pairs of rows with a common crop, or both without, whose lower-case titles are more alike than the
    threshold (Ratcliff-Obershelp, the later row first). ``earlier`` is the smaller key. Blank titles are left out, or alike with ``blanks``.

    Complete: every pair of a crop whose lengths allow the ratio is looked at, block against block in order of length. A pair is
    dropped without its ratio only if it has too few characters, or too few runs of two, in common for the threshold. The work grows
    with the square of the rows of a crop; a task holds two blocks whatever the size of the crop.
    """
    with scratch():
        low = F.lower(F.trim(F.coalesce(title, F.lit(""))))
        rows = df.select(F.col(key).alias("k"), low.alias("t"), crops.alias("crops")).where(F.lit(blanks) | (F.col("t") != "")).withColumn("n", F.length("t"))
        each = rows.withColumn("crop", F.explode(F.when(F.size("crops") > 0, F.col("crops")).otherwise(F.array(F.lit("")))))
        placed = cut(prefix_totals(each, ["crop"], [F.col("n").asc(), F.col("k").asc()], rank="r").withColumn("block", F.floor((F.col("r") - 1) / block)).drop("r"))
        spans = placed.groupBy("crop", "block").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
        x, y = spans.select("crop", F.col("block").alias("a"), F.col("hi").alias("most")), spans.select("crop", F.col("block").alias("b"), F.col("lo").alias("least"))
        # no ratio can exceed twice the shorter length over the sum of lengths
        tasks = x.join(y, "crop").where((F.col("a") == F.col("b")) | ((F.col("a") < F.col("b")) & (2 * F.col("most") >= (threshold - 1e-9) * (F.col("most") + F.col("least")))))
        parts = tasks.select("crop", "a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("block"))
        spread = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        met = placed.join(parts, ["crop", "block"]).repartition(4 * spread, "crop", "a", "b")
        kind = dict(rows.dtypes)["k"]
        return cut(met.groupBy("crop", "a", "b").applyInPandas(_alike(threshold), f"earlier {kind}, later {kind}, ratio double"), keep=True)


def keep_best(ranked: DataFrame, pairs: DataFrame, key: str, rank: str) -> DataFrame:
    """Greedy deduplication: in order of ``rank`` a row stays unless a better row that stays is its duplicate.

    ``pairs`` are (earlier, later) keys. Each round decides all rows whose better duplicates are decided, at least the best undecided one,
    until none is open; so rounds grow with the longest chain of duplicates, not with the rows. Ranks must differ."""
    nodes = ranked.select(F.col(key).alias("k"), F.col(rank).alias("r"))
    both = pairs.select(F.col("earlier").alias("a"), F.col("later").alias("b")).unionByName(pairs.select(F.col("later").alias("a"), F.col("earlier").alias("b")))
    with scratch():
        edges = cut(both.join(nodes.select(F.col("k").alias("a"), F.col("r").alias("ra")), "a").join(nodes.select(F.col("k").alias("b"), F.col("r").alias("rb")), "b").where("ra < rb").select("a", "b").distinct())
        # rows without a duplicate stay; only the others take part in the rounds
        state = cut(edges.select(F.col("a").alias("k")).union(edges.select("b")).distinct().select("k", F.lit(None).cast("boolean").alias("stays")))
        while state.where("stays is null").limit(1).count():
            seen = edges.join(state.select(F.col("k").alias("a"), F.col("stays").alias("sa")), "a").groupBy("b").agg(F.bool_or(F.coalesce("sa", F.lit(False))).alias("beaten"), F.bool_or(F.col("sa").isNull()).alias("open"))
            new = state.join(seen.withColumnRenamed("b", "k"), "k", "left")
            state = cut(new.select("k", F.coalesce("stays", F.when(F.coalesce("beaten", F.lit(False)), F.lit(False)).when(~F.coalesce("open", F.lit(False)), F.lit(True))).alias("stays")))
        return cut(ranked.join(state.where("not stays").select(F.col("k").alias(key)), key, "left_anti"), keep=True)


# --- logs, resuming, identifiers ----------------------------------------------------------------------------------------------


PERMANENT = ("success", "blocked_robots", "http_404")


def classify_outcome(note: Column) -> Column:
    """Outcome class of a fetch note: success, blocked_robots, connection_error, or by status code http_429, http_500 (any 5xx) and http_404 (any
    other 4xx). What is not recognised, null too, is a connection_error, which is tried again."""
    n = F.coalesce(note, F.lit(""))
    code = F.regexp_extract(n, r":([^:]*)$", 1).try_cast("int")
    return (
        F.when(n == "ok", "success").when(n == "robots_disallowed", "blocked_robots").when(n.isin("timeout", "connection_error") | n.startswith("request_error"), "connection_error")
        .when(code == 429, "http_429").when((code >= 500) & (code < 600), "http_500").when((code >= 400) & (code < 500), "http_404").otherwise("connection_error")
    )


def remaining(work: DataFrame, log: DataFrame, key: str, done: Column) -> DataFrame:
    """The rows of ``work`` whose key has no finished row in the log."""
    return work.join(log.where(done).select(key).distinct(), key, "left_anti")


def retries(log: DataFrame, key: str, note: Column, order: Sequence[str]) -> DataFrame:
    """The keys that are due for their one retry: tried exactly once, with the note ``blocked:429`` or ``timeout``. Repeated log rows are one try."""
    tries = log.select(F.col(key).alias("k"), note.alias("note"), F.struct(*order).alias("o")).distinct()
    per = tries.groupBy("k").agg(F.count_distinct("o").alias("n"), F.max_by("note", "o").alias("last"))
    return per.where((F.col("n") == 1) & F.col("last").isin("blocked:429", "timeout")).select(F.col("k").alias(key), "last")


def markdown_manifest(df: DataFrame, publisher: Column, title: str = "title", url: str = "url", pages: str = "pages", order: str = "priority") -> DataFrame:
    """(publisher, line_no, text): the lines of a manifest, per publisher a heading with its counts (line 0) and one line per source in the
    given order. A publisher may have any number of lines."""
    line = F.format_string("- [%s](%s), %s pages", F.coalesce(title, F.lit("untitled")), F.coalesce(url, F.lit("")), F.coalesce(F.col(pages).cast("string"), F.lit("?")))
    rows = df.select(F.coalesce(publisher, F.lit("(none)")).alias("publisher"), F.col(order).alias("_o"), F.col(pages).alias("_p"), line.alias("text"))
    heads = rows.groupBy("publisher").agg(F.count("*").alias("n"), F.coalesce(F.sum("_p"), F.lit(0)).cast("long").alias("p"))
    heads = heads.select("publisher", F.lit(0).cast("long").alias("line_no"), F.format_string("## %s (%d sources, %d pages)", "publisher", "n", "p").alias("text"))
    return heads.unionByName(prefix_totals(rows, ["publisher"], [F.col("_o").asc(), F.col("text").asc()], rank="line_no").select("publisher", "line_no", "text"))


def wget_lines(df: DataFrame, url: str, name: Column, kind: str = "format") -> DataFrame:
    """(line): one command per source with an address; a page is mirrored, a file saved under its name."""
    quoted = lambda c: F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("'\\''")), F.lit("'"))
    saved = F.concat(F.lit("wget -O "), quoted(F.concat(name, F.lit(".pdf"))), F.lit(" "), quoted(F.col(url)))
    return df.where(F.trim(url) != "").select(F.when(F.upper(kind) == "PDF", saved).otherwise(F.concat(F.lit("wget --mirror "), quoted(F.col(url)))).alias("line"))


def parse_blocked(lines: DataFrame, line: str = "value") -> DataFrame:
    """(date, source, url, status) of log lines ``[date] source=... url=... status=... headers=...`` that were blocked; of
    lines with equal source and url the last by ``line_no`` holds, if that column is there."""
    pattern = r"^\s*\[([^\]]+)\]\s+source=(.*?)\s+url=(\S+)\s+status=(\S+)\s+headers="
    part = lambda i: F.regexp_extract(line, pattern, i)
    rows = lines.where(F.col(line).rlike(pattern)).select(part(1).alias("date"), part(2).alias("source"), part(3).alias("url"), part(4).alias("status"), (F.col("line_no") if "line_no" in lines.columns else F.lit(0)).alias("n"))
    rows = rows.where(F.col("status").startswith("blocked:") | (F.col("status") == "robots_disallowed"))
    return rows.groupBy("source", "url").agg(F.max_by(F.struct("date", "status"), F.struct("n", "date", "status")).alias("v")).select("v.date", "source", "url", "v.status")


def first_by_url(df: DataFrame, url: str, order: str) -> DataFrame:
    """One row per URL without outer blanks and trailing slashes: the first in the given order."""
    norm = F.regexp_replace(F.trim(F.col(url)), r"/+$", "")
    cols = [c for c in df.columns if c != order]
    return df.groupBy(norm.alias("url_key")).agg(F.min(F.struct(order, *cols)).alias("v")).select("url_key", "v.*")


def url_host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def next_ids(df: DataFrame, existing: DataFrame, id_col: str, order: str, prefix: str = "SRC", width: int = 8) -> DataFrame:
    """Adds ``new_id`` that continues the greatest number of ``existing`` ids with this prefix."""
    top = existing.agg(F.coalesce(F.max(F.when(F.col(id_col).startswith(prefix), F.substring(F.col(id_col), F.lit(len(prefix) + 1), F.length(id_col)).try_cast("long"))), F.lit(0)).alias("top"))
    ranked = prefix_totals(df, [], [F.col(order).asc()], rank="_n")
    return ranked.join(F.broadcast(top), F.lit(True)).withColumn("new_id", F.concat(F.lit(prefix), F.lpad((F.col("top") + F.col("_n")).cast("string"), width, "0"))).drop("_n", "top")


def path_id(path: Column) -> Column:
    """``RAW_<stem up to 40 characters>_<first 8 of the SHA-1 of the path>``."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    return F.concat(F.lit("RAW_"), F.substring(F.regexp_replace(stem, r"[^A-Za-z0-9_\-]", "_"), 1, 40), F.lit("_"), F.substring(F.sha1(path), 1, 8))
