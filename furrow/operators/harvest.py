"""Operators of the harvest: rows from recorded search answers, enrichment, intake of files, blocked sources, and rebuilt checkpoints."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.functions.text import first_paragraphs, guess_categories, safe_filename, tag_first_term, tag_terms
from furrow.functions.vocabulary import COUNTRIES, CROPS, TABLE_WORDS, ZONES
from furrow.operators.catalogue import accessibility, classify_outcome, parse_blocked, path_id, quality, relevance
from furrow.operators.ordering import prefix_totals

# The query templates of a crawl, and what blocked statuses are called.
TEMPLATES = ["{crop} production guide {country} extension", "{crop} {country} smallholder farming", "{crop} agro-ecological zone {country} recommendation"]
STATUS_LABELS = {
    "robots_disallowed": "blocked by robots.txt",
    "blocked:403": "blocked (HTTP 403 Forbidden)",
    "blocked:429": "blocked (HTTP 429 Too Many Requests)",
    "blocked:503": "blocked (HTTP 503 Service Unavailable)",
}


def make_row(title: Column, text: Column, url: Column, most: int = 400) -> list[Column]:
    """The columns a catalogue row derives from its texts: address and title trimmed, crops, zones and table kinds found, and the
    opening of the abstract on one line."""
    both = F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(text, F.lit("")))
    return [
        F.trim(F.coalesce(url, F.lit(""))).alias("url"), F.trim(F.replace(F.coalesce(title, F.lit("")), F.lit("\n"), F.lit(" "))).alias("title"),
        F.array_join(tag_terms(both, CROPS), ";").alias("crops_covered"), F.array_join(tag_terms(both, ZONES), ";").alias("zones_mentioned"), F.array_join(guess_categories(both, TABLE_WORDS), ";").alias("sql_tables_likely"),
        F.trim(F.replace(F.substring(F.coalesce(text, F.lit("")), 1, most), F.lit("\n"), F.lit(" "))).alias("abstract_snippet"),
    ]


def doi_key(doi: Column) -> Column:
    """A DOI trimmed, in lower case and without resolver address; null and empty give ''."""
    return F.replace(F.lower(F.trim(F.coalesce(doi, F.lit("")))), F.lit("https://doi.org/"), F.lit(""))


_WORK = "struct<title:string,doi:string,publication_year:string,open_access:struct<oa_url:string,oa_status:string>,abstract_inverted_index:map<string,array<int>>>"
_PAPER = "struct<title:string,abstract:string,year:string,openAccessPdf:struct<url:string>,externalIds:struct<DOI:string>>"
_VALUES = "array<struct<value:string>>"
_BUNDLE = "struct<name:string,_embedded:struct<bitstreams:struct<_embedded:struct<bitstreams:array<struct<_links:struct<content:struct<href:string>>>>>>>>"
_ITEM = f"struct<name:string,handle:string,metadata:map<string,{_VALUES}>,_embedded:struct<bundles:struct<_embedded:struct<bundles:array<{_BUNDLE}>>>>>"


def _of_works(answers: DataFrame) -> DataFrame:
    rows = answers.select("query", F.posexplode(F.from_json("body", f"struct<results:array<{_WORK}>>")["results"]).alias("hit", "w")).where(F.coalesce("w.open_access.oa_url", F.lit("")) != "")
    abstract = F.when(F.col("w.abstract_inverted_index").isNotNull(), first_paragraphs("w.abstract_inverted_index"))
    return rows.select("query", "hit", F.lit("OpenAlex").alias("publisher"), F.col("w.title").alias("title"), abstract.alias("text"), F.col("w.open_access.oa_url").alias("url"), doi_key(F.col("w.doi")).alias("doi"), F.coalesce("w.publication_year", F.lit("")).alias("year"), F.coalesce("w.open_access.oa_status", F.lit("")).alias("licence"), F.lit("openalex").alias("api_source"))


def _of_papers(answers: DataFrame) -> DataFrame:
    rows = answers.select("query", F.posexplode(F.from_json("body", f"struct<data:array<{_PAPER}>>")["data"]).alias("hit", "p")).where(F.coalesce("p.openAccessPdf.url", F.lit("")) != "")
    return rows.select("query", "hit", F.lit("Semantic Scholar").alias("publisher"), F.col("p.title").alias("title"), F.col("p.abstract").alias("text"), F.col("p.openAccessPdf.url").alias("url"), doi_key(F.col("p.externalIds.DOI")).alias("doi"), F.coalesce("p.year", F.lit("")).alias("year"), F.lit("open access (Semantic Scholar verified)").alias("licence"), F.lit("semantic_scholar").alias("api_source"))


def first_value(metadata: Column, fields: Sequence[str]) -> Column:
    """The first value of the first of the named metadata fields that has any; '' if none has."""
    picks = [F.when(F.size(F.coalesce(F.try_element_at(metadata, F.lit(f)), F.array().cast(_VALUES))) > 0, F.coalesce(F.get(F.try_element_at(metadata, F.lit(f)), F.lit(0))["value"], F.lit(""))) for f in fields]
    return F.coalesce(*picks, F.lit(""))


def _of_items(answers: DataFrame, site: str) -> DataFrame:
    shape = f"struct<_embedded:struct<searchResult:struct<_embedded:struct<objects:array<struct<_embedded:struct<indexableObject:{_ITEM}>>>>>>>"
    objects = F.from_json("body", shape)["_embedded"]["searchResult"]["_embedded"]["objects"]
    rows = answers.select("query", F.posexplode(objects).alias("hit", "o")).select("query", "hit", F.col("o._embedded.indexableObject").alias("i")).where("i is not null")
    bundles = F.filter(F.coalesce(F.col("i._embedded.bundles._embedded.bundles"), F.array().cast(f"array<{_BUNDLE}>")), lambda b: b["name"] == "ORIGINAL")
    files = F.flatten(F.transform(bundles, lambda b: F.transform(F.coalesce(b["_embedded"]["bitstreams"]["_embedded"]["bitstreams"], F.array().cast("array<struct<_links:struct<content:struct<href:string>>>>")), lambda s: s["_links"]["content"]["href"])))
    pdf = F.try_element_at(F.filter(files, lambda x: F.coalesce(x, F.lit("")) != ""), F.lit(1))
    landing = F.when(F.coalesce("i.handle", F.lit("")) != "", F.concat(F.lit(f"{site}/handle/"), F.col("i.handle")))
    out = rows.select(
        "query", "hit", F.lit("CGSpace").alias("publisher"), F.col("i.name").alias("title"), first_value(F.col("i.metadata"), ["dcterms.abstract", "dc.description.abstract"]).alias("text"), F.coalesce(pdf, landing).alias("url"), F.lit("").alias("doi"),
        F.substring(first_value(F.col("i.metadata"), ["dcterms.issued", "dc.date.issued"]), 1, 4).alias("year"), F.lit("CGIAR open access (CGSpace)").alias("licence"), F.lit("cgspace").alias("api_source"), F.when(pdf.isNotNull(), "PDF").otherwise("HTML").alias("format"),
    )
    return out.where("url is not null")


def api_rows(answers: DataFrame, site: str = "https://cgspace.cgiar.org", enrichment: DataFrame | None = None, per_query: int = 5, total: int = 200) -> DataFrame:
    """Catalogue rows of recorded search answers (source, query, body): openalex, semantic_scholar and cgspace, each with the fields of its own
    JSON. Answers that are no JSON, and hits without address, give no row.

    ``enrichment`` (doi, url) gives better addresses: it is asked for the first ``per_query`` hits with a DOI of each query, and for ``total``
    different DOIs in all, in the order of query and hit; these are limits of the service, the other rows keep their address.
    """
    of = lambda name: answers.where(F.col("source") == name)
    form = F.when(F.lower("url").endswith(".pdf"), "PDF").otherwise("HTML")
    rows = _of_works(of("openalex")).withColumn("format", form).unionByName(_of_papers(of("semantic_scholar")).withColumn("format", F.lit("PDF"))).unionByName(_of_items(of("cgspace"), site))
    if enrichment is not None:
        rows = enrich_urls(rows, enrichment, per_query, total)
        rows = rows.withColumn("format", F.when(F.col("publisher") == "OpenAlex", form).otherwise(F.col("format"))).withColumn("api_source", F.when(F.col("upgraded"), F.concat("api_source", F.lit("+unpaywall"))).otherwise(F.col("api_source"))).drop("upgraded")
    return rows.select("query", "hit", "publisher", "year", "format", "licence", "doi", *make_row(F.col("title"), F.col("text"), F.col("url")), "api_source")


def enrich_urls(rows: DataFrame, enrichment: DataFrame, per_query: int = 5, total: int = 200) -> DataFrame:
    """Replaces ``url`` by that of the enrichment (doi, url) where the row may be looked up; adds ``upgraded``."""
    asked = rows.where("doi <> ''").withColumn("_k", F.row_number().over(Window.partitionBy("api_source", "query").orderBy("hit"))).where(F.col("_k") <= per_query)
    dois = asked.groupBy("doi").agg(F.min(F.struct("api_source", "query", "hit")).alias("first")).orderBy("first").limit(total).select("doi")
    better = dois.join(enrichment.where("url is not null").select(doi_key(F.col("doi")).alias("doi"), F.col("url").alias("_better")).groupBy("doi").agg(F.min("_better").alias("_better")), "doi")
    upgrades = asked.select("api_source", "query", "hit", "doi").join(better, "doi").drop("doi")
    return rows.join(upgrades, ["api_source", "query", "hit"], "left").withColumn("url", F.coalesce("_better", "url")).withColumn("upgraded", F.col("_better").isNotNull()).drop("_better")


def query_grid(crops: DataFrame, countries: DataFrame, templates: Sequence[str] = tuple(TEMPLATES)) -> DataFrame:
    """(crop, country, query) of every crop, country and template; small fixed lists."""
    texts = F.array(*[F.replace(F.replace(F.lit(t), F.lit("{crop}"), F.col("crop")), F.lit("{country}"), F.col("country")) for t in templates])
    return crops.join(F.broadcast(countries), F.lit(True)).select("crop", "country", F.explode(texts).alias("query"))


def instructions(publisher: Column, kind: Column, url: Column, title: Column, crops: Column, ident: Column) -> Column:
    """How to fetch a source by hand, by publisher, else by format. The file name comes from the title, else from the id."""
    name = safe_filename(F.coalesce(F.nullif(title, F.lit("")), ident))
    first = F.coalesce(F.split(F.coalesce(crops, F.lit("")), ";")[0], F.lit(""))
    return (
        F.when(publisher == "NAFDAC", F.concat(F.lit("NAFDAC register page — screenshot or copy table to nafdac_"), name, F.lit(".txt")))
        .when(publisher == "CABI PlantWise", F.concat(F.lit("PlantWise factsheet — visit URL, select all, copy to "), first, F.lit("_"), name, F.lit("_plantwise.txt")))
        .when(kind == "PDF", F.concat(F.lit("Direct PDF — right-click and Save As, or wget "), F.coalesce(url, F.lit(""))))
        .otherwise(F.concat(F.lit("HTML page — use wget --mirror or copy-paste to "), name, F.lit(".html")))
    )


def blocked_priority(lines: DataFrame, line: str = "value") -> DataFrame:
    """(position, source, url, status_label, score, description): blocked sources of a log, best score first, then by source and address.
    What a source holds is guessed from its decoded address; it counts as not accessible."""
    rows = parse_blocked(lines, line).withColumn("decoded", F.coalesce(F.try_url_decode("url"), F.col("url")))
    rows = rows.withColumns({"crops": tag_terms("decoded", CROPS), "zones": tag_terms("decoded", ZONES), "tables": guess_categories("decoded", TABLE_WORDS), "country": tag_first_term("decoded", COUNTRIES)})
    text = F.concat(F.lit("[blocked] "), F.col("source"), F.lit(" query "), F.col("decoded"))
    no = F.lit(False)
    points = relevance(F.col("crops"), F.col("zones"), F.col("tables"), text) + quality(F.col("source"), F.lit(""), F.lit(""), F.lit(0)) + accessibility(F.lit(True), no, no, F.lit(""), F.col("source"))
    listed = lambda c: F.array_join(c, ", ")
    told = F.concat_ws(
        " | ", F.concat(F.lit("crops: "), F.when(F.size("crops") > 0, listed("crops")).otherwise("unspecified")), F.concat(F.lit("country: "), F.col("country")),
        F.when(F.size("zones") > 0, F.concat(F.lit("zone: "), listed("zones"))), F.when(F.size("tables") > 0, F.concat(F.lit("likely feeds: "), listed("tables"))),
    )
    labels = F.create_map(*[F.lit(x) for kv in STATUS_LABELS.items() for x in kv])
    scored = rows.select("source", "url", F.coalesce(F.try_element_at(labels, F.col("status")), F.col("status")).alias("status_label"), points.alias("score"), told.alias("description"))
    return prefix_totals(scored, [], [F.col("score").desc(), F.col("source").asc(), F.col("url").asc()], rank="position")


def manual_intake(files: DataFrame, catalogued: DataFrame, path: str = "path", first_id: int = 6000, prefix: str = "SRC") -> DataFrame:
    """New catalogue rows of files, by path relative to the corpus: those whose path is not catalogued (url) yet. The publisher is the
    folder, the title the file name in words. Ids go on from the greatest number in use, at least from ``first_id``, in the order of the paths."""
    new = files.where(F.lower(path).rlike(r"\.(pdf|txt)$")).select(F.col(path).alias("url")).distinct().join(catalogued.select("url").where("url is not null"), "url", "left_anti")
    parts = F.split("url", "/")
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
    words = F.regexp_replace(stem, "[_-]", " ")
    title = F.initcap(F.trim(words))
    number = F.when(F.col("id").startswith(prefix), F.substring(F.col("id"), F.lit(len(prefix) + 1), F.length("id")).try_cast("long"))
    top = catalogued.agg(F.greatest(F.coalesce(F.max(number), F.lit(0)) + 1, F.lit(first_id)).alias("_from"))
    ranked = prefix_totals(new, [], [F.col("url").asc()], rank="_n").join(F.broadcast(top), F.lit(True))
    return ranked.select(
        F.concat(F.lit(prefix), F.lpad((F.col("_from") + F.col("_n") - 1).cast("string"), 5, "0")).alias("id"), "url", path_id(F.col("url")).alias("raw_id"), title.alias("title"),
        F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise("").alias("publisher"), F.when(F.lower("url").endswith(".pdf"), "PDF").otherwise("TXT").alias("format"),
        F.array_join(F.array_sort(tag_terms(words, CROPS)), ";").alias("crops_covered"), F.array_join(F.array_sort(tag_terms(title, ZONES)), ";").alias("zones_mentioned"), F.array_join(F.array_sort(guess_categories(title, TABLE_WORDS)), ";").alias("sql_tables_likely"),
    )


def rebuild_checkpoint(sources: DataFrame, lines: DataFrame, grid: Mapping[str, str], single: Mapping[str, str], direct: Mapping[str, tuple[str, Sequence[str]]], templates: Sequence[str] = tuple(TEMPLATES), line: str = "value") -> DataFrame:
    """(key, outcome): the checkpoint of a crawl from what it found and its log of failures.

    ``sources`` has api_source, country and crops_covered. A source of ``grid`` marks every template of each of its crops as success under the
    prefix given there, one of ``single`` the pair of crop and country, one of ``direct`` all paths of its institution. The log overrides: its last
    entry per source and address gives the outcome.
    """
    as_map = lambda m: F.create_map(*[F.lit(x) for kv in m.items() for x in kv]) if m else F.create_map().cast("map<string,string>")
    rows = sources.select("api_source", F.coalesce("country", F.lit("")).alias("country"), F.filter(F.split(F.coalesce("crops_covered", F.lit("")), ";"), lambda x: x != "").alias("crops")).distinct()
    asked = rows.where("country <> ''").select("*", F.explode("crops").alias("crop"))
    filled = F.array(*[F.replace(F.replace(F.lit(t), F.lit("{crop}"), F.col("crop")), F.lit("{country}"), F.col("country")) for t in templates])
    many = asked.withColumn("p", F.try_element_at(as_map(grid), F.col("api_source"))).where("p is not null").select("p", F.explode(filled).alias("q")).select(F.concat_ws(":", "p", "q").alias("key"))
    one = asked.withColumn("p", F.try_element_at(as_map(single), F.col("api_source"))).where("p is not null").select(F.concat(F.col("p"), F.lit(":"), F.col("crop"), F.lit(" "), F.col("country")).alias("key"))
    paths = [(s, f"{inst}:{p}") for s, (inst, ps) in direct.items() for p in ps]
    fixed = rows.select("api_source").distinct().join(F.broadcast(rows.sparkSession.createDataFrame(paths, "api_source string, key string")), "api_source").select("key")
    won = many.unionByName(one).unionByName(fixed).distinct().select("key", F.lit(0).alias("o"), F.lit(-1).cast("long").alias("n"), F.lit("success").alias("outcome"))
    pattern = r"^\s*\[([^\]]+)\]\s+source=(.*?)\s+url=(\S+)\s+status=(\S+)\s+headers="
    part = lambda i: F.regexp_extract(line, pattern, i)
    log = lines.where(F.col(line).rlike(pattern)).select(F.concat(part(2), F.lit(":"), part(3)).alias("key"), F.lit(1).alias("o"), (F.col("line_no").cast("long") if "line_no" in lines.columns else F.lit(0).cast("long")).alias("n"), classify_outcome(part(4)).alias("outcome"))
    return won.unionByName(log).groupBy("key").agg(F.max_by("outcome", F.struct("o", "n")).alias("outcome"))
