"""Queries of the core operators over the supplied tables, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from furrow.functions import text as X
from furrow.functions.vocabulary import COUNTRIES, CROPS, TABLE_WORDS, TOPIC_WORDS, ZONES
from furrow.operators import calculators as K
from furrow.operators import catalogue as C
from furrow.operators import documents as D
from furrow.operators import harvest as H
from furrow.operators import layout as L
from furrow.operators import retrieval as R
from furrow.operators import vectors as V
from furrow.operators.latest import latest
from furrow.operators.ordering import prefix_totals
from furrow.plans import cases
from furrow.plans.questions import unsafe
from furrow.session import cut, spread
from furrow.streaming.incremental import tumbling_counts

Query = Callable[[SparkSession, str], DataFrame]
_ALL: dict[str, Query] = {}

MANIFEST = ["priority_rank", "url", "title", "publisher", "year", "format", "score", "crops_covered", "sql_tables_likely", "gap_filler", "estimated_pages", "download_instructions"]
CHUNKS = ["source_id", "publisher", "crops", "zone", "topic", "is_table", "token_count", "text"]
RESULTS = ["question", "detected_language", "gold_tier", "routed_tier", "refused", "elapsed_s", "answer_text", "gold_answer", "proxy_accuracy_score", "error"]


def query(f: Query) -> Query:
    _ALL[f.__name__] = f
    return f


def queries() -> dict[str, Query]:
    from furrow.plans import more_queries  # noqa: F401 - registers its queries

    return dict(_ALL)


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _manifest(spark, sf, *cols) -> DataFrame:
    return latest(_t(spark, sf, "download_manifest"), "id", "listed_at", list(cols) or MANIFEST)


def _chunks(spark, sf, *cols) -> DataFrame:
    return latest(_t(spark, sf, "chunks"), "chunk_id", "chunked_at", list(cols) or CHUNKS)


def _results(spark, sf, *cols) -> DataFrame:
    return latest(_t(spark, sf, "eval_results"), "id", "answered_at", list(cols) or RESULTS)


# --- scans --------------------------------------------------------------------------------------------------------------------


@query
def scan_parquet(spark, sf):
    return _t(spark, sf, "chunks").where(F.col("page_start") > 10).select("chunk_id", "source_id", "page_start", "page_end")


@query
def scan_documents(spark, sf):
    return _t(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.count_if(F.col("text").isNull()).alias("n_null"))


@query
def latest_records(spark, sf):
    return _manifest(spark, sf, "priority_rank", "publisher").select("id", "priority_rank", "publisher")


@query
def json_extract(spark, sf):
    k = F.get_json_object("props", "$.k").try_cast("long")
    return _t(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("sum_k"), F.max(k).alias("max_k"))


@query
def url_domain_filter(spark, sf):
    host = C.url_host(F.col("url"))
    return _t(spark, sf, "download_manifest").select("id", host.alias("host")).where(F.col("host").isin("www.seedpress.example", "repo.cropnotes.example")).distinct()


@query
def url_functions(spark, sf):
    rows = _t(spark, sf, "fetch_log").select(C.url_host(F.col("url")).alias("host"), F.try_parse_url("url", F.lit("PATH")).alias("path"))
    return rows.groupBy("host").agg(F.count("*").alias("n"), F.count_if(F.col("path").endswith(".pdf")).alias("n_pdf"), F.min("path").alias("first_path"))


@query
def url_dedupe(spark, sf):
    rows = _t(spark, sf, "sources").where(F.trim("url") != "")
    return C.first_by_url(rows.select("url", "source_id"), "url", "source_id").select("url_key", "source_id")


@query
def url_union_dedupe(spark, sf):
    a = _t(spark, sf, "download_manifest").select("url", F.lit("manifest").alias("origin"))
    b = _t(spark, sf, "sources").select("url", F.lit("sources").alias("origin"))
    return a.unionByName(b).where(F.trim("url") != "").groupBy(F.regexp_replace(F.trim("url"), "/+$", "").alias("url_key")).agg(F.min("origin").alias("origin"), F.count("*").alias("n"))


# --- projections --------------------------------------------------------------------------------------------------------------


def _of_chunks(spark, sf, **columns) -> DataFrame:
    """Columns made from the texts of current chunks; the texts themselves are not shuffled."""
    made = spread(_t(spark, sf, "chunks").select("chunk_id", "chunked_at", "text")).select("chunk_id", "chunked_at", *[c.alias(n) for n, c in columns.items()])
    return latest(made, "chunk_id", "chunked_at", list(columns))


@query
def tag_terms(spark, sf):
    return _of_chunks(spark, sf, crops=X.tag_terms("text", CROPS)).select("chunk_id", F.explode("crops").alias("crop")).groupBy("crop").agg(F.count("*").alias("n"))


@query
def tag_first_term(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", X.tag_first_term("text", ZONES).alias("zone")).where("zone is not null")


@query
def guess_categories(spark, sf):
    return _of_chunks(spark, sf, found=X.guess_categories("text", TABLE_WORDS)).select(F.explode("found").alias("category")).groupBy("category").agg(F.count("*").alias("n"))


@query
def classify_topic(spark, sf):
    return _of_chunks(spark, sf, topic=X.classify_topic("text", TOPIC_WORDS)).groupBy("topic").agg(F.count("*").alias("n"))


@query
def make_row(spark, sf):
    clean = F.trim(F.regexp_replace(F.substring(F.coalesce("text", F.lit("")), 1, 400), r"\s+", " "))
    return _t(spark, sf, "documents").select("doc_id", clean.alias("abstract"), F.concat_ws(";", F.lower("lang"), "source").alias("tags"))


@query
def classify_outcome(spark, sf):
    return _t(spark, sf, "fetch_log").groupBy(C.classify_outcome(F.regexp_replace("status", "^failed:", "")).alias("outcome")).agg(F.count("*").alias("n"), F.count_distinct("id").alias("n_ids"))


@query
def score_sources(spark, sf):
    rows = _manifest(spark, sf)
    rows = C.score_sources(rows, abstract="download_instructions", pages="estimated_pages", open_access="gap_filler")
    return rows.select("id", "relevance_score", "quality_score", "accessibility_score", "total_score")


@query
def manifest(spark, sf):
    rows = _manifest(spark, sf)
    out = C.manifest(rows, keep=X.truthy("gap_filler") & (F.col("score") >= 50) & ~F.isnan("score"))
    return out.select("id", "priority", "score", C.page_estimate(F.col("estimated_pages"), F.col("format")).alias("pages"))


@query
def manifest_by_publisher(spark, sf):
    rows = _manifest(spark, sf)
    key = F.nullif(F.lower(F.trim(F.regexp_replace("publisher", r"\s+", " "))), F.lit(""))
    return C.by_publisher(rows, F.coalesce(key, F.lit("(none)")), C.page_estimate(F.col("estimated_pages"), F.col("format"))).select("publisher", "n", "pages", "running_pages")


@query
def source_ids(spark, sf):
    return _t(spark, sf, "sources").where("file_path <> ''").select("file_path", C.path_id(F.col("file_path")).alias("raw_id")).distinct()


@query
def safe_filename(spark, sf):
    return _manifest(spark, sf, "title").select("id", X.safe_filename("title").alias("name"))


@query
def is_garbled(spark, sf):
    return _of_chunks(spark, sf, garbled=X.is_garbled("text")).groupBy("garbled").agg(F.count("*").alias("n"))


def _with_marked(spark, sf) -> DataFrame:
    """All documents, and two with what these lack: running heads and contents pages."""
    return _t(spark, sf, "documents").select("doc_id", "text").unionByName(spark.createDataFrame(cases.MARKED, "doc_id long, text string"))


@query
def is_toc_page(spark, sf):
    return D.page_rows(_with_marked(spark, sf)).groupBy(X.is_toc_page("body").alias("toc")).agg(F.count("*").alias("n"), F.sum(F.length("body")).alias("chars"))


@query
def safety_override(spark, sf):
    return _results(spark, sf, "question").select("id", unsafe(F.col("question")).alias("unsafe"))


@query
def structural_checks(spark, sf):
    # flags first: the text itself is never shuffled
    rows = latest(D.structural_flags(_t(spark, sf, "chunks")), "chunk_id", "chunked_at", ["too_short", "broken_table"])
    return rows.groupBy("too_short", "broken_table").agg(F.count("*").alias("n"))


# --- joins --------------------------------------------------------------------------------------------------------------------


@query
def licence_left_join(spark, sf):
    licences = _t(spark, sf, "sources").groupBy(F.col("source_id").alias("id")).agg(F.max("licence").alias("licence"))
    return _manifest(spark, sf, "publisher").select("id").join(licences, "id", "left").select("id", F.coalesce("licence", F.lit("")).alias("licence"))


@query
def chunk_provenance_join(spark, sf):
    src = _t(spark, sf, "sources").groupBy("source_id").agg(F.min("title").alias("source_title"))
    return _chunks(spark, sf, "source_id").join(src, "source_id").groupBy("source_id", "source_title").agg(F.count("*").alias("n_chunks"))


@query
def rejected_chunks(spark, sf):
    return _chunks(spark, sf, "source_id").join(_t(spark, sf, "sources").select("source_id").distinct(), "source_id", "left_anti").agg(F.count("*").alias("n_chunks"), F.count_distinct("source_id").alias("n_sources"))


@query
def resume_antijoin(spark, sf):
    work = _t(spark, sf, "download_manifest").select("id").distinct()
    return C.remaining(work, _t(spark, sf, "fetch_log"), "id", C.classify_outcome(F.regexp_replace("status", "^failed:", "")).isin(*C.PERMANENT))


@query
def query_grid(spark, sf):
    return H.query_grid(spark.createDataFrame([(c,) for c in CROPS], "crop string"), spark.createDataFrame([(c,) for c in COUNTRIES], "country string"))


@query
def word_column_range_join(spark, sf):
    ranges = [("a", 0.0, 10.0), ("b", 10.0, 25.5), ("c", 25.5, 40.0), ("d", 40.0, 50.0)]
    words = _t(spark, sf, "lineitem").select(F.col("l_quantity").cast("double").alias("x0"))
    return L.word_columns(words, ranges).groupBy("column").agg(F.count("*").alias("n"), F.max("x0").alias("max_x0"))


@query
def anchor_band_asof(spark, sf):
    ev = _t(spark, sf, "events")
    anchors = ev.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("last_purchase"))
    return L.asof_join(ev.where("event_type <> 'purchase'").select("event_id", "user_id", "ts"), anchors, "user_id", "ts", "last_purchase", "last_purchase").select("event_id", "last_purchase")


@query
def title_duplicate_risk(spark, sf):
    return C.title_pairs(_manifest(spark, sf, "title", "crops_covered"), "id", F.col("title"), X.crop_list("crops_covered")).select("later").distinct()


@query
def manifest_dedup(spark, sf):
    rows = _manifest(spark, sf, "title", "crops_covered", "score")
    score = F.when(~F.isnan("score"), F.col("score"))
    ranked = cut(prefix_totals(rows, [], [score.desc_nulls_last(), F.col("id").asc()]).select("id", "rank", F.lower(F.trim(F.coalesce("title", F.lit("")))).alias("title"), X.crop_list("crops_covered").alias("crops")))
    # of rows with one title and the same crops only the best can stay: what beats it beats the others too
    best = cut(ranked.groupBy("title", "crops").agg(F.min(F.struct("rank", "id")).alias("v")).select("v.id", "v.rank", "title", "crops"))
    pairs = C.title_pairs(best, "rank", F.col("title"), F.col("crops"), blanks=True)
    return C.keep_best(best.select("id", "rank"), pairs, "rank", "rank")


# --- aggregations -------------------------------------------------------------------------------------------------------------


@query
def combo_counts(spark, sf):
    rows = _manifest(spark, sf, "crops_covered", "sql_tables_likely")
    return C.combo_counts(rows, X.crop_list("crops_covered"), X.split_list("sql_tables_likely")).select(F.col("left").alias("crop"), F.col("right").alias("fact_table"), "n")


@query
def gap_filler(spark, sf):
    rows = _manifest(spark, sf, "crops_covered", "sql_tables_likely")
    return C.gap_fillers(rows, "id", X.crop_list("crops_covered"), X.split_list("sql_tables_likely"))


@query
def coverage_counts(spark, sf):
    rows = _manifest(spark, sf, "crops_covered", "sql_tables_likely", "title")
    zones = X.tag_terms("title", ZONES)
    parts = [("crop", X.crop_list("crops_covered"), CROPS), ("zone", zones, ZONES), ("fact_table", X.split_list("sql_tables_likely"), list(TABLE_WORDS))]
    return reduce(DataFrame.unionByName, [C.coverage(rows, m, domain).select(F.lit(kind).alias("kind"), "name", "n") for kind, m, domain in parts])


@query
def table_crop_matrix(spark, sf):
    return C.matrix(_manifest(spark, sf, "crops_covered", "sql_tables_likely"), X.split_list("sql_tables_likely"), X.crop_list("crops_covered"), list(TABLE_WORDS), CROPS)


@query
def crop_zone_matrix(spark, sf):
    zone = F.array_compact(F.array(F.nullif("zone", F.lit(""))))
    wide = C.matrix(_chunks(spark, sf, "crops", "zone"), X.crop_list("crops"), zone, CROPS, ZONES)
    return wide.select("name", *[F.col(f"`{z}`").alias(z.lower().replace(" ", "_").replace("/", "_")) for z in ZONES])


@query
def hard_gaps(spark, sf):
    return C.hard_gaps(_manifest(spark, sf, "crops_covered", "sql_tables_likely"), X.crop_list("crops_covered"), X.split_list("sql_tables_likely"), [*CROPS, "millet"], list(TABLE_WORDS)).select(F.col("left").alias("crop"), F.col("right").alias("fact_table"))


@query
def chunk_stats(spark, sf):
    n = F.col("token_count")
    return _chunks(spark, sf, "token_count").agg(F.count("*").alias("n"), F.min(n).alias("least"), F.percentile(n, 0.5).alias("median"), F.max(n).alias("most"))


@query
def crop_chunk_counts(spark, sf):
    low = F.lower(F.coalesce("crops", F.lit("")))
    counts = _chunks(spark, sf, "crops").agg(*[F.count_if(low.contains(c)).alias(c) for c in CROPS])
    return counts.select(F.explode(F.create_map(*[x for c in CROPS for x in (F.lit(c), F.col(c))])).alias("crop", "n"))


@query
def topic_distribution(spark, sf):
    return _chunks(spark, sf, "topic").groupBy("topic").agg(F.count("*").alias("n"))


@query
def crop_balance(spark, sf):
    counts = crop_chunk_counts(spark, sf).where("n > 0")
    return counts.agg(F.round(F.max("n") / F.min("n"), 6).alias("ratio"), (F.max("n") / F.min("n") > 3).alias("unbalanced"), F.count("*").alias("crops"))


@query
def repeated_lines(spark, sf):
    return D.repeated_lines(D.page_rows(_with_marked(spark, sf)))


@query
def routing_rates(spark, sf):
    rows = _results(spark, sf).where("error is null")
    hit = (F.coalesce("gold_tier", F.lit("")) == F.coalesce("routed_tier", F.lit(""))).cast("int")
    return rows.withColumn("hit", hit).groupingSets([["gold_tier"], ["detected_language"], []], "gold_tier", "detected_language").agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.round(F.avg("hit"), 3).alias("rate"))


@query
def eval_scorecard(spark, sf):
    """One row per tier as routed, zeros kept: questions, share, mean score, seconds, refusals, languages, and the share that cite a source."""
    cites = F.size(F.coalesce("source_ids", F.array())) > 0
    rows = _results(spark, sf, "routed_tier", "proxy_accuracy_score", "elapsed_s", "refused", "detected_language", "source_ids", "error").where("error is null")
    n_all = rows.agg(F.count("*").alias("whole"))
    per = rows.groupBy(F.col("routed_tier").alias("tier")).agg(
        F.count("*").alias("n"), F.round(F.avg("proxy_accuracy_score"), 4).alias("mean_f1"), F.round(F.avg("elapsed_s"), 4).alias("mean_s"), F.count_if(F.col("refused")).alias("refused"), F.count_distinct("detected_language").alias("languages"), F.count_if(cites).alias("cited")
    )
    tiers = F.broadcast(spark.createDataFrame([(t,) for t in "ABCD"], "tier string"))
    out = tiers.join(per, "tier", "left").join(F.broadcast(n_all), F.lit(True))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select("tier", zero("n").alias("n"), F.round(zero("n") / F.col("whole"), 4).alias("share"), "mean_f1", "mean_s", zero("refused").alias("refused"), zero("languages").alias("languages"), F.round(zero("cited") / F.nullif("n", F.lit(0)), 4).alias("citation_rate"))


@query
def language_counts(spark, sf):
    return _results(spark, sf, "question", "error").where("error is null").groupBy(X.detect_language("question").alias("lang")).agg(F.count("*").alias("n"))


@query
def outcome_breakdown(spark, sf):
    return _t(spark, sf, "fetch_log").groupBy("status").agg(F.count("*").alias("n"), F.count_distinct("id").alias("n_ids"))


@query
def next_ids(spark, sf):
    new = _t(spark, sf, "sources").where(F.col("source_id").startswith("RAW_")).select("source_id").distinct()
    return C.next_ids(new, _t(spark, sf, "download_manifest"), "id", "source_id").select("source_id", "new_id")


# --- text ---------------------------------------------------------------------------------------------------------------------


@query
def tokenize(spark, sf):
    toks = X.tokenize("text")
    return _t(spark, sf, "documents").select("doc_id", F.size(toks).alias("n_tokens"), F.size(F.array_distinct(toks)).alias("n_distinct"))


@query
def tokenize_unicode(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", F.size(X.tokenize_unicode("text")).alias("n_tokens"))


@query
def token_count(spark, sf):
    return latest(_t(spark, sf, "chunks").withColumn("n", X.token_count("text")), "chunk_id", "chunked_at", ["n"]).select("chunk_id", "n")


@query
def content_tokens(spark, sf):
    return _results(spark, sf, "question").select("id", F.array_join(F.array_sort(X.content_tokens("question")), " ").alias("tokens"))


@query
def proxy_f1(spark, sf):
    return latest(_t(spark, sf, "eval_results").withColumn("f1", X.proxy_f1("answer_text", "gold_answer")), "id", "answered_at", ["f1"]).select("id", "f1")


@query
def fold_diacritics(spark, sf):
    return _results(spark, sf, "question").where("question is not null").select("id", X.fold_diacritics("question").alias("folded"))


@query
def dehyphenate(spark, sf):
    return _t(spark, sf, "documents").where("text is not null").select("doc_id", F.length(X.dehyphenate("text")).alias("n_chars"))


@query
def normalize_ws(spark, sf):
    return _t(spark, sf, "documents").where("text is not null").select("doc_id", F.length(X.normalize_ws("text")).alias("n_chars"))


@query
def normalise_query(spark, sf):
    return _results(spark, sf, "question").where("question is not null").select("id", X.normalise_query("question").alias("normalised"))


@query
def detect_language(spark, sf):
    return _results(spark, sf, "question").where("question is not null").select("id", X.detect_language("question").alias("lang"))


@query
def table_to_markdown(spark, sf):
    cells = F.array(F.array(F.lit("name"), F.lit("size")), F.array("p_name", F.col("p_size").cast("string")), F.array("p_brand"))
    return _t(spark, sf, "part").select("p_partkey", X.table_to_markdown(cells).alias("markdown"))


@query
def inverted_index_text(spark, sf):
    words = X.tokenize("title")
    index = F.map_from_entries(F.transform(F.array_distinct(words), lambda w: F.struct(w, F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, i) == w))))
    rows = _manifest(spark, sf, "title").where(F.size(words) > 0)
    return rows.select("id", X.first_paragraphs(index).alias("opening"))


# --- documents ----------------------------------------------------------------------------------------------------------------


def _cleaned(spark, sf) -> DataFrame:
    return D.clean_documents(_t(spark, sf, "documents"))


@query
def clean_documents(spark, sf):
    return _cleaned(spark, sf)


@query
def unit_types(spark, sf):
    return D.document_units(_cleaned(spark, sf), text="clean_text").groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query
def chunk_documents(spark, sf):
    return D.chunk_documents(_cleaned(spark, sf), text="clean_text")


@query
def split_pages(spark, sf):
    return D.page_rows(_t(spark, sf, "documents")).select("doc_id", "page_index", "page_no", F.length("body").alias("n_chars"))


# --- retrieval ----------------------------------------------------------------------------------------------------------------
# Searches take every row whose id is divisible by 100 as a query, against all rows.


def _questions(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"))


def _vector_queries(vecs: DataFrame) -> DataFrame:
    return vecs.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@query
def bm25_stats(spark, sf):
    docs = _t(spark, sf, "documents")
    return R.build_index(docs).terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query
def bm25_search(spark, sf):
    docs = _t(spark, sf, "documents")
    return R.bm25_search(docs, _questions(docs), 10).select("query_id", "doc_id", F.round("score", 4).alias("score"), "rank")


@query
def dense_topk(spark, sf):
    vecs = _t(spark, sf, "embeddings")
    return V.dense_topk(_vector_queries(vecs), vecs, 10).select("query_id", "item_id", F.round("score", 6).alias("score"), "rank")


def _ranks(spark, sf, k: int) -> DataFrame:
    docs, vecs = _t(spark, sf, "documents"), _t(spark, sf, "embeddings")
    dense = V.dense_topk(_vector_queries(vecs), vecs, 2 * k).select("query_id", F.lit(0).alias("ranker"), "rank", "item_id")
    lexical = R.bm25_search(docs, _questions(docs), 2 * k).select("query_id", F.lit(1).alias("ranker"), "rank", F.col("doc_id").alias("item_id"))
    return dense.unionByName(lexical)


@query
def rrf_fuse(spark, sf):
    return R.rrf_fuse(_ranks(spark, sf, 4), 4)


@query
def hybrid_retrieve(spark, sf):
    docs = _t(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), "lang", "source")
    return R.rrf_fuse(_ranks(spark, sf, 4), 4).join(docs, "item_id").select("query_id", "rank", F.col("item_id").alias("doc_id"), "lang", "source", "score")


@query
def pack_context(spark, sf):
    docs = _t(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), "text", F.col("source").alias("source_id"))
    out = R.pack_context(R.rrf_fuse(_ranks(spark, sf, 4), 4).join(docs, "item_id"))
    return out.select("query_id", "context", "used", F.array_join("source_ids", ",").alias("source_ids"))


@query
def cosine_pairs(spark, sf):
    """The three most similar other vectors of each query vector by cosine."""
    v = _t(spark, sf, "embeddings").select("vec_id", V.unit(F.col("embedding")).alias("embedding"))
    near = V.dense_topk(_vector_queries(v), v, 4).where(F.col("query_id") != F.col("item_id"))
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where("rank <= 3")
    return near.select("query_id", "item_id", F.round("score", 6).alias("cosine"), "rank")


@query
def centroid_similarity(spark, sf):
    v = _t(spark, sf, "embeddings")
    return V.centroid_scores(v, V.centroids(v)).groupBy("tier").agg(F.round(F.max("sim"), 6).alias("best"), F.round(F.avg("sim"), 6).alias("mean"))


@query
def tier_centroids(spark, sf):
    flat = V.centroids(_t(spark, sf, "embeddings")).select("label", F.posexplode("centroid").alias("pos", "x"))
    return flat.select("label", "pos", F.round("x", 6).alias("x"))


@query
def route_tier(spark, sf):
    v = _t(spark, sf, "embeddings")
    return V.route(v, V.centroids(v), 0.74, refuse=3).select("vec_id", "tier", F.round("confidence", 6).alias("confidence"), "refused", "reason")


@query
def centroid_margin(spark, sf):
    v = _t(spark, sf, "embeddings")
    return V.route(v, V.centroids(v), 0.74).groupBy("tier").agg(F.count("*").alias("n"), F.round(F.avg("margin"), 6).alias("mean_margin"))


@query
def confidence_stats(spark, sf):
    v = _t(spark, sf, "embeddings")
    r = V.route(v, V.centroids(v), 0.74).join(v.select("vec_id", "label"), "vec_id").withColumn("ok", F.col("tier") == F.col("label"))
    return r.groupBy("ok").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean"), F.round(F.percentile("confidence", 0.1), 6).alias("p10"), F.round(F.percentile("confidence", 0.9), 6).alias("p90"))


@query
def ood_refusal_rate(spark, sf):
    v = _t(spark, sf, "embeddings")
    return V.route(v, V.centroids(v.where("label < 5")), 0.74).join(v.select("vec_id", "label"), "vec_id").groupBy((F.col("label") >= 5).alias("outside")).agg(F.count("*").alias("n"), F.round(F.avg(F.col("refused").cast("int")), 6).alias("refusal_rate"))


@query
def knn_classify(spark, sf):
    v = _t(spark, sf, "embeddings")
    near = V.dense_topk(_vector_queries(v), v, 6).where(F.col("query_id") != F.col("item_id"))
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where("rank <= 5")
    return V.knn_vote(near, v).select("query_id", "predicted", "votes", F.round("mean_sim", 6).alias("mean_sim"))


@query
def stratified_folds(spark, sf):
    return V.folds(_t(spark, sf, "embeddings")).select("vec_id", "label", "fold")


@query
def router_cv_eval(spark, sf):
    r = V.cross_validate(_t(spark, sf, "embeddings"))
    return r.rollup("label").agg(F.count("*").alias("n"), F.round(F.avg((F.col("predicted") == F.col("label")).cast("int")), 6).alias("accuracy"))


@query
def threshold_sweep(spark, sf):
    r = V.cross_validate(_t(spark, sf, "embeddings"))
    return V.threshold_sweep(r.select((F.col("predicted") == F.col("label")).alias("ok"), F.round("sim", 6).alias("sim")))


@query
def router_knn_cv(spark, sf):
    data = cut(V.folds(_t(spark, sf, "embeddings")))
    out = V.knn_cross_validate(data, data.where("vec_id % 100 = 0"))
    return out.groupBy("k").agg(F.count("*").alias("n"), F.count_if(F.col("predicted") == F.col("label")).alias("right"))


# --- calculators --------------------------------------------------------------------------------------------------------------


@query
def calc_seed_tables(spark, sf):
    parts = [K.seed_table(spark, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n") for t in K.SEEDS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _requests(spark, sf) -> DataFrame:
    """Calculator requests from every order line: crop and zone by key, sizes by quantity."""
    names = F.array(*[F.lit(c) for c in ["maize", "cassava", "rice", "cowpea", "yam", "tomato", "sorghum"]])
    places = F.array(*[F.lit(z) for z in ZONES])
    k = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return _t(spark, sf, "lineitem").select(
        k.alias("request_id"), F.element_at(names, (F.col("l_partkey") % 7 + 1).cast("int")).alias("crop"), F.element_at(places, (F.col("l_suppkey") % 3 + 1).cast("int")).alias("zone"), (F.col("l_quantity") / 10).cast("double").alias("area_ha"),
        F.lit(None).cast("string").alias("soil_class"), F.lit(None).cast("double").alias("target_yield"), "l_quantity", "l_extendedprice", "l_tax", "l_discount", "l_linenumber",
    )


@query
def fert_best_match(spark, sf):
    rates = K.seed_table(spark, "calc_fertilizer_rate", [(7, "maize", "Northern Guinea Savanna", "clayey", 3.0, 100.0, 50.0, 50.0, "x"), (8, "maize", "Northern Guinea Savanna", "clayey", 5.0, 140.0, 60.0, 60.0, "x")])
    req = _requests(spark, sf).withColumn("soil_class", F.when(F.col("l_linenumber") % 2 == 0, "clayey")).withColumn("target_yield", F.when(F.col("l_linenumber") > 2, F.lit(4.5))).select("request_id", "crop", "zone", "area_ha", "soil_class", "target_yield")
    return K.best_rates(req, rates).select("request_id", F.col("rate.id").alias("rate_id"), "matched_exactly", "error_type")


def _plan(spark, sf) -> DataFrame:
    req = _requests(spark, sf).select("request_id", "crop", "zone", "area_ha", "soil_class", "target_yield")
    return K.fertiliser_plan(req, *[K.seed_table(spark, f"calc_{n}") for n in ("fertilizer_rate", "fertilizer_split", "product")])


@query
def fert_split_plan(spark, sf):
    out = _plan(spark, sf).select("request_id", F.posexplode("applications").alias("step", "a"))
    return out.select("request_id", (F.col("step") + 1).alias("step"), "a.timing", "a.product_name", "a.product_kg", "a.bags", F.round("a.bags_exact", 6).alias("bags_exact"))


@query
def fert_totals(spark, sf):
    return _plan(spark, sf).select("request_id", "error_type", "n_kg", "p2o5_kg", "k2o_kg", "n_open", "p2o5_open", "k2o_open")


@query
def fert_error_status(spark, sf):
    return _plan(spark, sf).groupBy("error_type").agg(F.count("*").alias("n"))


@query
def seed_rate(spark, sf):
    req = _requests(spark, sf).select("request_id", "crop", "area_ha", F.lit(75.0).alias("row_cm"), F.lit(25.0).alias("within_row_cm"), (F.lit(100.0) - F.col("l_discount") * 100).alias("germination_pct"), F.lit(2).alias("seeds_per_stand"))
    out = K.seed_rate(req, K.seed_table(spark, "calc_planting_material"))
    return out.select("request_id", "error_type", F.round("population", 4).alias("population"), "seed_kg", "units", "bundles")


@query
def spray_dilution(spark, sf):
    names = F.array(*[F.lit(x) for x in ["Glyphosate", "Paraquat", "Mancozeb", "Atrazine", "Nothing"]])
    req = _requests(spark, sf).select("request_id", F.element_at(names, F.col("l_linenumber") % 5 + 1).alias("product_name"), "crop", F.col("l_quantity").cast("double").alias("tank_litres"), F.lit(None).cast("double").alias("rate_per_ha"), F.lit(200.0).alias("spray_volume_l_per_ha"))
    return K.spray_dilution(req, K.seed_table(spark, "calc_agrochemical"))


@query
def gross_margin(spark, sf):
    req = _requests(spark, sf).select("request_id", F.col("l_quantity").cast("double").alias("yield_kg"), F.col("l_extendedprice").cast("double").alias("price_per_kg"), F.array((F.col("l_tax") * 1000).cast("double"), (F.col("l_discount") * 100 - 1).cast("double")).alias("costs"))
    return K.gross_margin(req).groupBy("error_type").agg(F.count("*").alias("n"), F.sum("revenue").alias("revenue"), F.sum("margin").alias("margin"))


# --- streaming extension --------------------------------------------------------------------------------------------------------


@query
def tumbling_windows(spark, sf):
    out = tumbling_counts(_t(spark, sf, "events"))
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))
