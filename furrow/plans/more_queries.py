"""Queries of the harvest, of facts, tool calls and answers. What the tables don't hold is taken from ``cases``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.functions import text as X
from furrow.functions.vocabulary import COUNTRIES, CROPS, ZONES
from furrow.operators import calculators as K
from furrow.operators import catalogue as C
from furrow.operators import documents as D
from furrow.operators import extract as E
from furrow.operators import harvest as H
from furrow.operators import plugins as P
from furrow.operators import retrieval as R
from furrow.plans import cases
from furrow.plans.queries import _chunks, _manifest, _results, _t, query
from furrow.plans.questions import answer, crop_facts, question_crop
from furrow.session import cut, spread
from furrow.sources import files

# --- sources ------------------------------------------------------------------------------------------------------------------


def _pages(spark) -> DataFrame:
    return spark.createDataFrame(cases.PAGES, "url string, html string")


@query
def html_to_text(spark, sf):
    return _pages(spark).select("url", files.html_to_text("html").alias("text"))


@query
def page_links(spark, sf):
    return files.page_links(_pages(spark), wanted=r"(?i)maize|rice|\.pdf", default_title="untitled")


@query
def html_tables(spark, sf):
    rows = _pages(spark).select("url", F.explode(files.html_tables("html")).alias("r"))
    return rows.select("url", "r.table_no", "r.row_no", F.array_join("r.cells", "|").alias("cells"), files.cell_named(F.col("r"), "crop").alias("crop"))


@query
def api_rows(spark, sf):
    answers = spark.createDataFrame(cases.ANSWERS, "source string, query string, body string")
    return H.api_rows(answers, "https://c.example", spark.createDataFrame(cases.ENRICHMENT, "doi string, url string"))


@query
def manual_intake(spark, sf):
    files_ = _t(spark, sf, "sources").select(F.col("file_path").alias("path")).where("path <> ''")
    return H.manual_intake(files_, _manifest(spark, sf, "url").select("id", "url")).select("id", "url", "title", "publisher", "format", "crops_covered")


@query
def register_rows(spark, sf):
    return P.register_rows(spark.createDataFrame(cases.WORDS, "page int, text string, x0 double, top double")).select("page", "row_no", "product_name", "active_ingredient", "reg_no", "date_registered", "reg_expiry", "presentation", "country", "confidence", "needs_review")


@query
def checkpoint_rebuild(spark, sf):
    crawled, log = spark.createDataFrame(cases.CRAWLED, "api_source string, country string, crops_covered string"), spark.createDataFrame(cases.LOG, "line_no int, value string")
    return H.rebuild_checkpoint(crawled, log, cases.GRID, cases.SINGLE, cases.DIRECT)


def _log(spark, sf) -> DataFrame:
    """The fetch log as the lines of a crawl's log."""
    rows = _t(spark, sf, "fetch_log").where("url is not null and status <> 'ok'")
    line = F.concat(F.lit("["), F.date_format("fetched_at", "yyyy-MM-dd"), F.lit("] source="), C.url_host(F.col("url")), F.lit(" url="), F.col("url"), F.lit(" status="), F.regexp_replace("status", "^failed:", ""), F.lit(" headers={}"))
    return rows.select(F.unix_micros(F.col("logged_at").cast("timestamp")).alias("line_no"), line.alias("value"))


@query
def blocked_log(spark, sf):
    return C.parse_blocked(_log(spark, sf))


@query
def blocked_priority(spark, sf):
    lines = _log(spark, sf).unionByName(spark.createDataFrame(cases.LOG, "line_no long, value string"))
    return H.blocked_priority(lines)


@query
def retries(spark, sf):
    return C.retries(_t(spark, sf, "fetch_log"), "id", F.regexp_replace("status", "^failed:", ""), ["fetched_at"])


@query
def url_coding(spark, sf):
    rows = _manifest(spark, sf, "title").where("title is not null")
    return rows.select("id", F.url_encode("title").alias("encoded"), (F.url_decode(F.url_encode("title")) == F.col("title")).alias("round_trip"))


# --- catalogue ----------------------------------------------------------------------------------------------------------------


@query
def download_instructions(spark, sf):
    rows = _manifest(spark, sf, "publisher", "format", "url", "title", "crops_covered")
    return rows.select("id", H.instructions(F.col("publisher"), F.col("format"), F.col("url"), F.col("title"), F.col("crops_covered"), F.col("id")).alias("text"))


@query
def markdown_manifest(spark, sf):
    rows = _manifest(spark, sf, "publisher", "format", "url", "title", "estimated_pages", "priority_rank")
    key = F.nullif(F.lower(F.trim(F.regexp_replace("publisher", r"\s+", " "))), F.lit(""))
    rows = rows.withColumn("pages", C.page_estimate(F.col("estimated_pages"), F.col("format")))
    return C.markdown_manifest(rows, F.coalesce(key, F.lit("(none)")), order="priority_rank")


@query
def wget_lines(spark, sf):
    return C.wget_lines(_manifest(spark, sf, "url", "format", "title"), "url", X.safe_filename("title"))


@query
def summary_counters(spark, sf):
    rows = _manifest(spark, sf)
    scored = C.score_sources(rows, abstract="download_instructions", pages="estimated_pages", open_access="gap_filler")
    filler = C.gap_fillers(rows, "id", X.crop_list("crops_covered"), X.split_list("sql_tables_likely"))
    return scored.join(filler.select("id", F.col("gap_filler").alias("rare")), "id").agg(F.count("*").alias("n"), F.count_if(F.col("total_score") > 60).alias("n_high"), F.count_if("rare").alias("n_gap_fillers"))


@query
def feeds_facts(spark, sf):
    return _manifest(spark, sf, "title", "sql_tables_likely").select("id", C.feeds_facts(F.concat_ws(" ", "title", F.replace("sql_tables_likely", F.lit("_"), F.lit(" ")))).alias("feeds"))


def _with_country(spark, sf) -> DataFrame:
    """The manifest names no country, so one follows from the rank: the ten, one outside them, and none."""
    names = F.array(*[F.lit(c) for c in [*COUNTRIES, "Togo", ""]])
    return _manifest(spark, sf, "crops_covered", "priority_rank", "title").withColumn("country", F.element_at(names, (F.pmod("priority_rank", F.lit(12)) + 1).cast("int")))


@query
def crop_country_matrix(spark, sf):
    """A blank country is in no column."""
    wide = C.matrix(_with_country(spark, sf), X.crop_list("crops_covered"), F.array("country"), CROPS, COUNTRIES)
    return wide.select("name", *[F.col(f"`{c}`").alias(c.lower().replace(" ", "_")) for c in COUNTRIES])


@query
def country_default(spark, sf):
    return _with_country(spark, sf).groupBy(C.country_or_default(F.col("country")).alias("country")).agg(F.count("*").alias("n"))


@query
def dict_diff(spark, sf):
    a = _manifest(spark, sf, "publisher").select("id", F.coalesce("publisher", F.lit("")).alias("publisher"))
    b = _t(spark, sf, "sources").groupBy(F.col("source_id").alias("id")).agg(F.min(F.coalesce("publisher", F.lit(""))).alias("publisher"))
    return P.value_diff(a, b, "id", "publisher")


@query
def distinct_sources(spark, sf):
    ids = F.coalesce("source_ids", F.array())
    return _results(spark, sf, "source_ids").select("id", F.size(ids).alias("n"), F.array_join(F.array_distinct(ids), ",").alias("source_ids"))


@query
def has_tables(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", F.coalesce(F.col("text").contains("[[TABLE_START]]"), F.lit(False)).alias("has_tables"))


@query
def title_pair_cases(spark, sf):
    rows = spark.createDataFrame(cases.TITLES, "id int, title string, crops_covered string")
    return C.title_pairs(rows, "id", F.col("title"), X.crop_list("crops_covered"), blanks=True).select("earlier", "later", F.round("ratio", 6).alias("ratio"))


@query
def keep_best_cases(spark, sf):
    """A chain of 21 duplicates, each of the next."""
    rows = spark.range(1, 22).select(F.col("id").alias("rank"))
    return C.keep_best(rows, spark.range(1, 21).select(F.col("id").alias("earlier"), (F.col("id") + 1).alias("later")), "rank", "rank")


@query
def chunk_enrich(spark, sf):
    docs = _t(spark, sf, "sources").select("source_id", "title", F.explode_outer(X.crop_list("crops_covered")).alias("crop")).groupBy("source_id").agg(F.min("title").alias("title"), F.collect_set("crop").alias("crops"))
    chunks = _chunks(spark, sf, "source_id", "text").select("chunk_id", "source_id", "text")
    return D.enrich_chunks(chunks, docs, "source_id", doc_text="title").select("chunk_id", "crops", "zones", "topic")


# --- facts --------------------------------------------------------------------------------------------------------------------


def _texts(spark, sf) -> DataFrame:
    """All documents, and one sentence per pattern; a document is about the crops its column names."""
    rows = spread(_t(spark, sf, "documents").select("doc_id", "text", X.crop_list("crop").alias("about")))
    return rows.unionByName(spark.createDataFrame(cases.FACT_SENTENCES, "doc_id long, text string").withColumn("about", F.array().cast("array<string>")))


def _extract(table: str):
    def run(spark, sf):
        return E.extract(_texts(spark, sf), table, crops="about").drop("needs_review")

    run.__name__ = f"extract_{table}"
    return run


for _table in E.PATTERNS:
    query(_extract(_table))


@query
def facts_union(spark, sf):
    return E.fact_counts(_t(spark, sf, "documents")).groupBy("fact_table", "pattern").agg(F.sum("n").alias("n"))


@query
def zero_yield_docs(spark, sf):
    docs = _t(spark, sf, "documents")
    return docs.select("doc_id").join(E.fact_counts(docs).select("doc_id").distinct(), "doc_id", "left_anti")


@query
def confidence_histogram(spark, sf):
    return E.confidence_histogram(E.all_facts(_texts(spark, sf), crops="about"))


@query
def nearest_term(spark, sf):
    found = E.matches(_t(spark, sf, "documents"), E.PATTERNS["pest"])
    return found.select(F.col("key").alias("doc_id"), "start", E.nearest_crop(F.col("doc_crops")).alias("crop"))


@query
def nearest_place(spark, sf):
    found = E.matches(_t(spark, sf, "documents"), E.PATTERNS["pest"])
    return found.select(F.col("key").alias("doc_id"), "start", E.first_place(ZONES).alias("zone"), E.first_place(E.STATES).alias("state"))


def _crop_facts(spark, sf) -> DataFrame:
    # only pests with symptoms count: texts, then matches, without the word are left out before the work on them
    told = lambda c: F.lower(c).contains("symptom")
    docs = _t(spark, sf, "documents").where(told("text")).withColumn("about", X.crop_list("crop"))
    found = E.matches(docs, E.PATTERNS["pest"], crops="about").where(told(F.substring("around", F.col("at") + 1, F.lit(E.WINDOW))))
    pests = E.facts_of(found, "pest")
    return crop_facts(K.seed_table(spark, "calc_spacing"), K.seed_table(spark, "calc_fertilizer_rate"), pests)


@query
def tier_a_facts(spark, sf):
    return _crop_facts(spark, sf).select("crop", "facts", F.array_join("source_ids", ",").alias("source_ids"))


@query
def question_crops(spark, sf):
    return _results(spark, sf, "question").select("id", question_crop(F.col("question")).alias("crop"))


# --- tool calls and answers ---------------------------------------------------------------------------------------------------


def _calls(spark) -> DataFrame:
    return spark.createDataFrame(cases.CALLS, "id string, answer_text string").select("id", K.parse_tool_call(F.col("answer_text")).alias("call"))


@query
def parse_tool_call(spark, sf):
    recorded = _results(spark, sf, "answer_text").select("id", K.parse_tool_call(F.col("answer_text")).alias("call"))
    rows = recorded.unionByName(_calls(spark)).where("call is not null")
    return rows.select("id", F.try_variant_get("call", "$.function", "string").alias("function"), F.try_variant_get("call", "$.error", "string").alias("error"), F.try_variant_get("call", "$.params.crop", "string").alias("crop"))


@query
def tool_validation(spark, sf):
    asked = _results(spark, sf, "question").select("id", K.call_from_question(F.col("question")).alias("call"))
    return K.tool_errors(asked.unionByName(_calls(spark))).select("id", "function", "error_message")


@query
def tool_results(spark, sf):
    return K.run_tools(_calls(spark), lambda t: K.seed_table(spark, t)).select("id", "function", "error_message", "result", F.array_join("source_ids", ",").alias("source_ids"))


def _passages(spark, sf):
    """Passages for questions: the four best current chunks by words, packed. The current chunks are found, and the index is built, once."""

    def passages(questions: DataFrame) -> DataFrame:
        chunks = cut(_chunks(spark, sf, "source_id", "text").select("chunk_id", "source_id", "text"))
        hits = R.bm25_search(chunks, questions, 4, key="chunk_id")
        return R.pack_context(hits.join(chunks, "chunk_id"), key="chunk_id", queries=questions)

    return passages


@query
def answer_questions(spark, sf):
    """Every current question with a routed tier: refusals, facts, packed passages, and calculator results or what they lack. The calls of tier C are read
    from the question, as no language model is bundled."""
    rows = _results(spark, sf, "question", "routed_tier")
    calls = rows.select("id", K.call_from_question(F.col("question")).alias("call"))
    out = answer(rows, _crop_facts(spark, sf), _passages(spark, sf), lambda t: K.seed_table(spark, t), calls)
    return out.select("id", "tier", "refused", "answer", F.array_join("source_ids", ",").alias("source_ids"))


def _gold(spark) -> DataFrame:
    return spark.createDataFrame(cases.gold_questions(), "id string, query string, crop string, zone string, tier string, expected_topic string")


@query
def gold_questions(spark, sf):
    return _gold(spark)


@query
def hit_rates(spark, sf):
    """Retrieval hits of the gold questions among the five best chunks: whether one has the crop and the expected topic. Overall, and per
    crop, zone and tier over their fixed domains, zeros kept; ``gap`` marks crops and zones below 0.6."""
    gold = _gold(spark)
    chunks = _chunks(spark, sf, "crops", "topic", "text")
    hits = R.bm25_search(chunks, gold.withColumnRenamed("id", "query_id"), 5, key="chunk_id").join(chunks.select("chunk_id", F.split(F.coalesce("crops", F.lit("")), ";").alias("crops"), F.col("topic").alias("got")), "chunk_id")
    found = hits.join(gold.withColumnRenamed("id", "query_id"), "query_id").groupBy("query_id").agg(F.bool_or(F.array_contains("crops", F.col("crop")) & F.coalesce(F.col("got") == F.col("expected_topic"), F.lit(False))).alias("hit"))
    per = gold.join(found, gold["id"] == found["query_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)).cast("int"))
    counted = per.groupingSets([["crop"], ["zone"], ["tier"], []], "crop", "zone", "tier").agg(F.count("*").alias("n"), F.sum("hit").alias("hits"), F.grouping_id().alias("g"))
    kind = F.when(F.col("g") == 3, "crop").when(F.col("g") == 5, "zone").when(F.col("g") == 6, "tier").otherwise("overall")
    told = counted.select(kind.alias("level"), F.coalesce("crop", "zone", "tier", F.lit("")).alias("name"), "n", "hits")
    domain = [("overall", "")] + [("crop", c) for c in CROPS] + [("zone", z) for z in ZONES] + [("tier", t) for t in dict.fromkeys(q[4] for q in cases.gold_questions())]
    out = F.broadcast(spark.createDataFrame(domain, "level string, name string")).join(told, ["level", "name"], "left")
    rate = F.round(F.coalesce(F.col("hits") / F.col("n"), F.lit(0.0)), 3)
    return out.select("level", "name", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("hits", F.lit(0)).alias("hits"), rate.alias("rate"), (F.col("level").isin("crop", "zone") & (rate < 0.6)).alias("gap"))
