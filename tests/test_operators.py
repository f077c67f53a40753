from __future__ import annotations

import difflib
import random

import pytest
from pyspark.sql import functions as F

from furrow.functions import text as X
from furrow.operators import calculators as K
from furrow.operators import catalogue as C
from furrow.operators import documents as D
from furrow.operators import extract as E
from furrow.operators import layout as L
from furrow.operators import retrieval as R
from furrow.operators import vectors as V
from furrow.operators.latest import latest
from furrow.operators.ordering import prefix_totals
from furrow.plans import more_queries as M
from furrow.plans import queries as Q
from furrow.plans.questions import crop_facts
from furrow.sources import files
from furrow.streaming.incremental import run_new


def test_latest_takes_the_newest_and_ignores_null_keys(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y"), ("a", 3, "z"), ("b", None, "q"), (None, 9, "n")], "id string, at int, v string")
    assert {tuple(r) for r in latest(df, "id", "at", ["v"]).collect()} == {("a", 3, "z"), ("b", None, "q")}
    assert latest(df.limit(0), "id", "at", ["v"]).count() == 0


def test_prefix_totals_matches_a_loop(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.5 else rng.choice(["a", "b", None]), rng.randrange(20), i, rng.randrange(5)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, o int, id int, n int").repartition(7)
    got = {r.id: (r["rank"], r.before) for r in prefix_totals(df, ["k"], [F.col("o").asc(), F.col("id").asc()], {"n": "before"}).collect()}
    seen: dict = {}
    for k, _, i, n in sorted(rows, key=lambda r: (r[1], r[2])):
        rank, before = seen.get(k, (0, 0))
        assert got[i] == (rank + 1, before)
        seen[k] = (rank + 1, before + n)
    assert prefix_totals(df.limit(0), ["k"], [F.col("id").asc()]).count() == 0


def test_text_functions(spark):
    df = spark.createDataFrame([("Maize and cowpea in the Forest Zone; price 5.", None), ("", ""), (None, None)], "t string, u string")
    rows = df.select(X.tag_terms("t", ["maize", "rice", "cowpea"]).alias("tags"), X.tag_first_term("t", ["rice", "cowpea"]).alias("first"), X.is_garbled("t").alias("g"), X.proxy_f1("t", "t").alias("f1"), X.safe_filename("u").alias("name")).collect()
    assert rows[0].tags == ["maize", "cowpea"] and rows[0]["first"] == "cowpea" and rows[0].f1 == 100.0
    assert rows[1].g and rows[2].tags == [] and rows[2].f1 == 0.0 and rows[2].name == "untitled"
    q = spark.createDataFrame([("Kedu ka ọkà si eto?",), ("medicine for wake",)], "t string").select(X.normalise_query("t").alias("n"), X.detect_language("t").alias("l")).collect()
    assert q[0].n == "kedu ka maize si eto" and q[1].n == "pesticide for cowpea" and q[1].l == "ha"


def test_classify_topic_ties_go_to_the_first(spark):
    df = spark.createDataFrame([("sowing urea",), ("nothing",), (None,)], "t string")
    got = [r[0] for r in df.select(X.classify_topic("t", {"planting": ["sowing"], "feeding": ["urea"]})).collect()]
    assert got == ["planting", "unclassified", "unclassified"]


def test_greedy_dedup_of_a_long_chain(spark):
    rows = spark.range(1, 113).select(F.col("id").alias("rank"))
    kept = C.keep_best(rows, spark.range(1, 110).select(F.col("id").alias("earlier"), (F.col("id") + 1).alias("later")), "rank", "rank")
    assert sorted(r["rank"] for r in kept.collect()) == [*range(1, 111, 2), 111, 112]


def test_title_pairs_and_greedy_dedup(spark):
    titles = [("a", "Growing maize in the north of the country"), ("b", "Growing maize in the north of the countri"), ("c", "Growing maise in the north of the country"), ("d", "Quite another work on rice"), ("e", "")]
    df = spark.createDataFrame([(i, k, t, "maize" if k != "d" else "rice") for i, (k, t) in enumerate(titles)], "r int, id string, title string, crops string")
    got = {(r.earlier, r.later) for r in C.title_pairs(df, "id", F.col("title"), X.crop_list("crops")).collect()}
    want = {(a, b) for a, x in titles for b, y in titles if a < b and x and y and difflib.SequenceMatcher(None, y.lower(), x.lower()).ratio() > 0.85}
    assert got == want == {("a", "b"), ("a", "c"), ("b", "c")}
    pairs = C.title_pairs(df, "id", F.col("title"), X.crop_list("crops"))
    assert sorted(r.id for r in C.keep_best(df, pairs, "id", "r").collect()) == ["a", "d", "e"]


@pytest.mark.parametrize("block", [7, 2000])
def test_title_pairs_find_every_pair_that_comparing_all_finds(spark, block):
    rng = random.Random(8)
    name = lambda: "".join(rng.choice("bdgkmnprst") + rng.choice("aeiou") for _ in range(4))
    titles = ["Deep pruning in maize at garobobo, nkoginkoma and gipatadan [vqug-44469]", "Deep pruning in maize at garobobo & nkoginkoma & gipatadan [vqug/44469]", "ab", "ab", ""]
    for _ in range(25):
        t = f"Deep {rng.choice(['pruning', 'liming'])} in maize at {name()}, {name()} and {name()} [{name()[:4]}-{rng.randrange(10**5):05}]"
        titles += [t, t.replace(",", " &").replace("-", "/"), "".join(c for c in t if rng.random() > 0.07), "".join(c + "." * (rng.random() < 0.12) for c in t)]
    rows = [(f"k{i:03}", t, rng.choice(["maize", "rice;maize", "rice", ""])) for i, t in enumerate(titles)]
    df = spark.createDataFrame(rows, "id string, title string, crops string")
    want = set()
    for i, (a, ta, ca) in enumerate(rows):
        for b, tb, cb in rows[i + 1 :]:
            sa, sb = set(ca.split(";")), set(cb.split(";"))
            if ta and tb and sa & sb and difflib.SequenceMatcher(None, tb.lower(), ta.lower()).ratio() > 0.85:
                want.add((a, b))
    got = [(r.earlier, r.later) for r in C.title_pairs(df, "id", F.col("title"), X.crop_list("crops"), **({} if block == 2000 else {"block": block})).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20


def test_manifest_dedup_equals_the_loop_of_the_reference(spark, tmp_path):
    rng = random.Random(5)
    base = ["Deep pruning of maize at garobobo and nkogin", "Early liming of rice at gipatadan", "", " "]
    rows = []
    for i in range(60):
        t = rng.choice(base)
        t = "".join(rng.choice("xyz") if rng.random() < 0.13 else c for c in t) if t.strip() and rng.random() < 0.8 else t
        rows.append((f"k{i:02}", None if i == 7 else t, rng.choice(["maize", "maize;rice", "rice", "", "yam"]), float(rng.randrange(9)), i))
    spark.createDataFrame(rows, "id string, title string, crops_covered string, score double, listed_at int").write.parquet(f"{tmp_path}/download_manifest.parquet")
    kept = []
    for k, t, c, _, _ in sorted(rows, key=lambda r: (-r[3], r[0])):
        t, c = (t or "").strip().lower(), {x for x in c.split(";") if x}
        if not any((c & kc or not (c or kc)) and difflib.SequenceMatcher(None, t, kt).ratio() > 0.85 for _, kt, kc in kept):
            kept.append((k, t, c))
    assert sorted(r.id for r in Q.queries()["manifest_dedup"](spark, str(tmp_path)).collect()) == sorted(k for k, _, _ in kept)


def test_blocked_log(spark):
    lines = ["[2024-01-01] source=S url=http://a status=blocked:403 headers={}", "[2024-01-02] source=S url=http://a status=blocked:429 headers={}", "[2024-01-02] source=S url=http://b status=ok headers={}", "junk"]
    df = spark.createDataFrame(list(enumerate(lines)), "line_no int, value string")
    assert [tuple(r) for r in C.parse_blocked(df).collect()] == [("2024-01-02", "S", "http://a", "blocked:429")]


MARKED = "lost\n[[PAGE:1]]\nRUNNING HEAD\nThe soil is im-\nportant.\n\n- one\n- two\n[[PAGE:2]]\nRUNNING HEAD\nTable of contents\nx....1\n[[PAGE:3]]\nRUNNING HEAD\n[[TABLE_START]]\n| a | b |\n[[TABLE_END]]\nDone here."


def test_clean_documents_drops_headers_and_contents_keeps_tables(spark):
    table = "[[TABLE_START]]\n| h |\n[[TABLE_END]]"
    docs = [(1, MARKED), (2, None), (3, "no marker"), (4, "".join(f"[[PAGE:{i}]]\n{table}\nbody {i}\n" for i in range(1, 5)))]
    got = {r.doc_id: r for r in D.clean_documents(spark.createDataFrame(docs, "doc_id int, text string")).collect()}
    one = got[1].clean_text
    assert "RUNNING HEAD" not in one and "important" in one and "| a | b |" in one and "contents" not in one and "lost" not in one and got[1].n_toc == 1
    assert got[4].clean_text.count("| h |") == 4
    assert got[3].clean_text.endswith("no marker")
    lines = {(r.doc_id, r.line, r.n_pages) for r in D.repeated_lines(D.page_rows(spark.createDataFrame(docs, "doc_id int, text string"))).collect()}
    assert lines == {(1, "RUNNING HEAD", 3)}


def test_units_and_chunks():
    kinds = [k for k, _, _ in D.units_of(MARKED)]
    assert kinds.count("table") == 1 and kinds.count("list_item") == 2
    assert D.units_of("no marker") == [] and D.units_of(None) == []
    text = "[[PAGE:1]]\n" + "\n\n".join("word " * 120 + f"p{i}." for i in range(8)) + "\n\ntail."
    chunks = D.chunks_of(D.units_of(text))
    assert all(n <= D.TARGET_MOST + 200 for *_, n in chunks) and len(chunks) > 1
    assert chunks[1][0].split()[0] == "word"  # carried over
    assert all(f"p{i}." in " ".join(c[0] for c in chunks) for i in range(8))


def test_units_and_chunks_of_the_tables_cover_documents_without_markers(spark, tmp_path):
    texts = [(1, "No marker here, only a sentence on maize."), (2, "[[PAGE:1]]\nMarked text on rice."), (3, " "), (4, None)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.text, r.page_start) for r in Q.queries()["chunk_documents"](spark, str(tmp_path)).collect()}
    assert got == {1: (texts[0][1], 1), 2: ("Marked text on rice.", 1)}
    assert [tuple(r) for r in Q.queries()["unit_types"](spark, str(tmp_path)).collect()] == [("paragraph", 2, len(texts[0][1]) + 20)]


def test_extract_links_the_nearest_crop(spark):
    docs = [(1, "Maize does well. Sow at 75 cm x 25 cm. The price of rice fell."), (2, "apply 50 kg/ha of urea to cowpea"), (3, ""), (4, None), (5, "Planting in March; first rains: April in the Forest Zone for yam")]
    df = spark.createDataFrame(docs, "doc_id int, text string")
    s = E.extract(df, "spacing").collect()
    assert [(r.doc_id, r.crop, r.spacing_cm) for r in s] == [(1, "maize", "75x25")]
    f = {(r.pattern, r.crop, r.rate_kg_ha, r.fertilizer_type) for r in E.extract(df, "fertilizer_rate").collect()}
    assert ("apply_kg_ha", "cowpea", "50", "urea to cowpea") in f and ("bare_kg_ha", "cowpea", "50", "") in f
    cal = {(r.activity, r.month_start, r.crop, r.zone) for r in E.extract(df, "crop_calendar").collect()}
    assert cal == {("plant_in_month", "March", "yam", "Forest Zone"), ("first_rains", "April", "yam", "Forest Zone")}
    one = df.withColumn("about", F.when(F.col("doc_id") == 1, F.array(F.lit("yam"))).otherwise(F.array().cast("array<string>")))
    assert E.extract(one.where("doc_id = 1"), "spacing", crops="about").first().crop == "maize"  # mentioned within 60 characters


def test_calculators_golden(spark):
    rates, splits, products = (K.seed_table(spark, f"calc_{n}") for n in ("fertilizer_rate", "fertilizer_split", "product"))
    req = spark.createDataFrame([(1, "maize", "Northern Guinea Savanna", 1.0, None, None), (2, "tomato", "Sudan Savanna", 1.0, None, None), (3, "maize", "Nowhere", 1.0, None, None), (4, "maize", "Sudan Savanna", -1.0, None, None), (5, "maize", "Northern Guinea Savanna", 1.0, "clayey", None)], "request_id int, crop string, zone string, area_ha double, soil_class string, target_yield double")
    got = {r.request_id: r for r in K.fertiliser_plan(req, rates, splits, products).collect()}
    assert [(a.product_kg, a.bags) for a in got[1].applications] == [(400.0, 8), (130.43, 3)] and got[1].applications[1].bags_exact == 2.608695652173913
    assert (got[1].n_kg, got[1].p2o5_kg, got[1].k2o_kg, got[1].n_open) == (120.0, 60.0, 60.0, 0.0) and got[1].matched_exactly and not got[5].matched_exactly
    assert got[2].applications[0].product_kg == 333.33 and got[2].n_open == 50.0 and got[2].k2o_open == 30.0
    assert got[3].error_type == "MissingConstant" and got[4].error_type == "InvalidInput" and got[3].applications is None
    seeds = spark.createDataFrame([(1, "maize", 1.0, 75.0, 25.0, 85.0, 1), (2, "cassava", 1.0, 100.0, 100.0, 90.0, 1), (3, "maize", 1.0, 0.0, 25.0, 85.0, 1), (4, "okra", 1.0, 75.0, 25.0, 85.0, 1)], "request_id int, crop string, area_ha double, row_cm double, within_row_cm double, germination_pct double, seeds_per_stand int")
    s = {r.request_id: r for r in K.seed_rate(seeds, K.seed_table(spark, "calc_planting_material")).collect()}
    assert s[1].seed_kg == 15.69 and s[1].population == pytest.approx(53333.333333333336) and (s[2].units, s[2].bundles) == (10000, 200)
    assert s[3].error_type == "InvalidInput" and s[4].error_type == "MissingConstant"
    sprays = spark.createDataFrame([(1, "Glyphosate", None, 15.0, None, 200.0), (2, "Mancozeb", "tomato", 15.0, None, 200.0), (3, "Paraquat", "rice", 16.0, 6.0, 200.0), (4, "None", None, 15.0, None, 200.0)], "request_id int, product_name string, crop string, tank_litres double, rate_per_ha double, spray_volume_l_per_ha double")
    d = {r.request_id: r for r in K.spray_dilution(sprays, K.seed_table(spark, "calc_agrochemical")).collect()}
    assert (d[1].amount, d[1].unit, d[1].interval_days, d[1].match_kind) == (300.0, "ml", 30, "generic") and (d[2].amount, d[2].unit) == (113.0, "g") and d[3].match_kind == "other" and d[4].error_type == "MissingConstant"
    m = {r.request_id: r for r in K.gross_margin(spark.createDataFrame([(1, 3000.0, 250.0, [15000.4, 120000.2, 45000.1]), (2, 3000.0, 250.0, []), (3, 1.0, 1.0, [-1.0])], "request_id int, yield_kg double, price_per_kg double, costs array<double>")).collect()}
    assert (m[1].revenue, m[1].total_cost, m[1].margin) == (750000.0, 180001.0, 569999.0) and m[2].total_cost == 0 and m[3].error_type == "InvalidInput"


def test_tool_calls(spark):
    texts = ['{"function": "fertiliser_rate", "params": {"crop": "maize", "zone": "Z", "area_ha": 2}}', '```json\n{"function": "seed_rate", "params": {"crop": "okra"}}\n```', 'Sure: {"function": "spray_dilution", "params": {"product_name": "X", "tank_litres": "no"}} ok', '{"error": "cannot"}', "garbage", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string").select("id", K.parse_tool_call(F.col("t")).alias("call"))
    got = {r.id: (r.function, r.error_message) for r in K.tool_errors(df).select("id", "function", "error_message").collect()}
    assert got == {0: ("fertiliser_rate", None), 1: ("seed_rate", K.MESSAGES["seed_missing"]), 2: ("spray_dilution", K.MESSAGES["tank_bad"]), 3: (None, "cannot"), 4: (None, None), 5: (None, None)}


def test_calls_read_from_questions(spark):
    asked = ["How many kg of seed for 92.3 hectares of maize at 70 x 20 cm with 80 percent germination?", "How many bags of urea do I need for 2 ha of maize in the Northern Guinea Savanna?", "I want to spray cowpea with Pijulo 2 EC. How much?", "Why?", None]
    calls = spark.createDataFrame(list(enumerate(asked)), "id int, q string").select("id", K.call_from_question(F.col("q")).alias("call"))
    got = {r.id: r for r in K.run_tools(calls, lambda t: K.seed_table(spark, t)).collect()}
    assert got[0].function == "seed_rate" and '"seed_kg"' in got[0].result and got[1].function == "fertiliser_rate" and '"n_kg":240.0' in got[1].result
    assert got[2].error_message == K.MESSAGES["spray_missing"] and got[3].function is None and got[4].function is None


def test_layout(spark):
    words = spark.createDataFrame([(1, "w1", 84.5, 10.0), (1, "w2", 84.4, 19.6), (1, "w0", 1.0, 1.0), (2, "v", 0.0, 5.0)], "page int, text string, x0 double, top double")
    anchors = spark.createDataFrame([(1, 10.0, "A"), (1, 20.0, "B")], "page int, top double, anchor_id string")
    cols = {r.text: r.column for r in L.word_columns(words, [("left", 0.0, 84.5), ("right", 84.5, 100.0)]).collect()}
    assert cols == {"w1": "right", "w2": "left", "w0": "left", "v": "left"}
    assert {r.text: r.anchor_id for r in L.anchor_bands(words, anchors).collect()} == {"w1": "A", "w2": "B", "w0": None, "v": None}


def test_asof_join_equals_a_loop_over_ranges(spark):
    rng = random.Random(5)
    left = [(i, rng.choice("aab"), rng.randrange(200)) for i in range(400)] + [(900, None, 5), (901, "a", None)]
    right = [(rng.choice("aac"), rng.randrange(200), i) for i in range(60)] + [("a", 50, None)]
    l_, r = spark.createDataFrame(left, "i int, k string, t int").repartition(7), spark.createDataFrame(right, "k string, t int, v int").repartition(5)
    got = {x.i: x.last for x in L.asof_join(l_, r, "k", "t", "v", "last").collect()}
    want = {i: max(((t2, v) for k2, t2, v in right if k2 == k and v is not None and t is not None and t2 <= t), default=(0, None))[1] for i, k, t in left}
    assert {i: v for i, v in got.items() if i < 900} == {i: v for i, v in want.items() if i < 900} and len(got) == 402 and got[900] is None


def test_retrieval_and_packing(spark):
    docs = spark.createDataFrame([(1, "yam beetle yam"), (2, "rice blast"), (3, None), (4, "yam"), (5, "cassava root"), (6, "maize stalk")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "yam beetle"), (2, "unknown"), (3, None)], "query_id int, query string")
    got = [(r.query_id, r.doc_id) for r in R.bm25_search(docs, q, 5).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1), (1, 4)]
    ranks = spark.createDataFrame([(1, 0, 1, 10), (1, 0, 2, 20), (1, 1, 1, 20), (1, 1, 2, 30)], "query_id int, ranker int, rank int, item_id int")
    assert [r.item_id for r in R.rrf_fuse(ranks, 2).orderBy("rank").collect()] == [20, 10]
    hits = spark.createDataFrame([(1, 1, "a" * 20, "S", 7), (1, 2, "two words here now and more of them", "", 8), (1, 3, "never", "T", 9)], "query_id int, rank int, text string, source_id string, item_id int")
    packed = {r.query_id: r for r in R.pack_context(hits, budget=30, queries=spark.createDataFrame([(1,), (2,)], "query_id int")).collect()}
    assert packed[1].context == "--- Document Chunk [S] ---\n" + "a" * 20 + "\n\n--- Document Chunk [8] ---\ntwo words [...truncated]" and packed[1].used == 2 and packed[1].source_ids == ["S"]
    assert packed[2].context == R.NOTHING and packed[2].used == 0
    # what a cut leaves goes to the next text
    sliver = R.pack_context(hits.withColumn("text", F.when(F.col("rank") == 1, "x " + "y" * 40).otherwise(F.col("text"))), budget=30).first()
    assert sliver.used == 2 and sliver.context.endswith("two words [...truncated]")


def test_index_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(1, "yam beetle yam"), (2, "rice blast"), (3, None), (4, "yam")], "doc_id long, text string")
    R.save_index(R.build_index(docs), str(tmp_path))
    q = spark.createDataFrame([(1, "yam beetle")], "query_id int, query string")
    want = sorted(tuple(r) for r in R.bm25_search(docs, q, 5).collect())
    assert sorted(tuple(r) for r in R.search_index(R.load_index(spark, str(tmp_path)), q, 5).collect()) == want and want
    assert R.bm25_search(docs.limit(0), q, 5).count() == 0 and R.bm25_search(docs, q.limit(0), 5).count() == 0
    many = spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(["yam", "beetle rice", "rice rice", "none", None])], "query_id string, query string")
    whole, parts = R.bm25_search(docs, many, 2), R.search_index(R.build_index(docs), many, 2, most=1, cells=2)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.collect())) != []


def test_many_questions_alike_are_searched_in_one_scan(spark):
    rng = random.Random(7)
    words, names = [f"w{i}" for i in range(25)], [f"n{i}" for i in range(150)]
    docs = [(f"d{i:03}", " ".join([rng.choice(words[: rng.randint(1, 25)]) for _ in range(rng.randint(0, 30))] + rng.sample(names, rng.randint(0, 2)))) for i in range(200)]
    docs += [(f"c{i:03}", t) for i, (_, t) in enumerate(docs[:60])]  # ties
    forms = ["w1 w2 w2 w7 %s", "W3 w5 w24 %s here", "%s", "w0 w1", "w9 %s w9 n1 n1", "none"]
    asked = [(i, f % rng.choice(names) if "%" in f else f) for i in range(3000) for f in [rng.choice(forms)]] + [(3000, None)]
    index = R.build_index(spark.createDataFrame(docs, "doc_id string, text string").repartition(3))
    found = R.search_index(index, spark.createDataFrame(asked, "query_id int, query string"), 4)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1  # was a scan for every 1,000 questions, each scored against all documents
    got: dict = {}
    for r in found.collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.doc_id, r.score)
    terms = {d: t.split() for d, t in docs}
    stats = {r.term: r.idf for r in index.terms.collect()}
    mean = sum(map(len, terms.values())) / len(docs)
    want: dict = {}
    for text in {t for _, t in asked}:
        hits = []
        for d, ts in terms.items():
            tf = lambda t: ts.count(t)  # noqa: B023, E731
            score = sum(stats[t] * tf(t) * 2.5 / (tf(t) + 1.5 * (0.25 + 0.75 * len(ts) / mean)) for t in (text or "").lower().split() if t in stats)
            hits += [(-round(score, 9), d)] if score > 0 else []
        want[text] = [d for _, d in sorted(hits)[:4]]
    assert all([got.get(i, {})[n][0] for n in range(1, len(got.get(i, {})) + 1)] == want[t] for i, t in asked)
    whole, parts = found.where("query_id < 40").collect(), R.search_index(index, spark.createDataFrame(asked[:40], "query_id int, query string"), 4, most=20, cells=200).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, parts)) != []


def test_facts_of_a_crop_hold_all_pests_with_symptoms(spark, tmp_path):
    sign = "Maize Stem borer. %s: holes in the whorl and yellow leaves all over.\n\nYam Leaf beetle is seen."
    texts = [(1, sign % "SYMPTOMS", "maize"), (2, "Cassava Brown rot. None are told.", "cassava"), (3, sign % "Symptom", None), (4, None, "yam"), (5, "Symptoms of hunger. " + "x " * 500 + "Rice Leaf blast and Rice Neck rot", "rice")]
    docs = spark.createDataFrame(texts, "doc_id long, text string, crop string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    pests = E.extract(docs.withColumn("about", X.crop_list("crop")), "pest", crops="about")
    want = sorted(map(tuple, crop_facts(K.seed_table(spark, "calc_spacing"), K.seed_table(spark, "calc_fertilizer_rate"), pests).collect()))
    assert sorted(map(tuple, M._crop_facts(spark, str(tmp_path)).collect())) == want
    assert any("holes in the whorl" in facts and facts.count("Source: 1") and "Source: 3" in facts for _, facts, _ in want)


def test_dense_topk_equals_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8))
    rows = [(i, [float(v) for v in x[i]]) for i in range(300)] + [(1000, None), (1001, [1.0])]
    items = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = V.dense_topk(items.where("vec_id % 100 = 0 and vec_id < 300").withColumnRenamed("vec_id", "query_id"), items, 7).collect()
    few = V.dense_topk(items.where("vec_id % 100 = 0 and vec_id < 300").withColumnRenamed("vec_id", "query_id"), items, 7, most=1).collect()
    assert sorted((r.query_id, r.item_id, r["rank"]) for r in few) == sorted((r.query_id, r.item_id, r["rank"]) for r in got)
    named = V.dense_topk(items.where("vec_id = 100").withColumnRenamed("vec_id", "query_id"), items.withColumn("vec_id", F.format_string("%04d", "vec_id")), 3).orderBy("rank").collect()
    assert [int(r.item_id) for r in named] == np.argsort(-(x @ x[100]), kind="stable")[:3].tolist()
    for q in (0, 100, 200):
        assert [r.item_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == np.argsort(-(x @ x[q]), kind="stable")[:7].tolist()


def test_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a,b", 'say "x"\nnext', ""), ("c", "d", "e")], "p string, q string, r string")
    files.write_csv(df, f"{tmp_path}/csv")
    assert {tuple(r) for r in files.read_csv(spark, f"{tmp_path}/csv", "p string, q string, r string").collect()} == {tuple(r) for r in df.collect()}
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert sorted(r.a for r in files.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a int").collect()) == [1, 2]
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "a.html").write_bytes(b"%PDF-1.4 x")
    assert files.read_raw(spark, str(tmp_path / "raw")).first().kind == "pdf"
    assert files.html_text("<main>A</main><p>related</p>") == "[[PAGE:1]]\nA" and files.html_text("") == "[[PAGE:1]]\n"
    assert files.html_text('<body><nav>no</nav><main><p>Yes</p><div class="sidebar">no</div></main></body>') == "[[PAGE:1]]\nYes"
    (tmp_path / "rec").mkdir()
    (tmp_path / "rec" / "q1.json").write_text('{"n": 1}')
    spark.dataSource.register(files.recorded_source())
    assert spark.read.format("recorded").option("path", str(tmp_path / "rec")).load().first().body == '{"n": 1}'


def test_incremental_runs_read_only_new_files(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("src", "out", "mark"))
    spark.range(5).write.parquet(src)
    assert run_new(spark, src, "id long", out, mark) == 5
    assert run_new(spark, src, "id long", out, mark) == 0
    spark.range(5, 8).write.mode("append").parquet(src)
    assert run_new(spark, src, "id long", out, mark) == 3
    assert spark.read.parquet(out).count() == 8


def test_scratch_deletes_all_but_what_is_kept(spark, tmp_path, monkeypatch):
    from furrow import session

    monkeypatch.setattr(session, "shared_dir", lambda s: f"file://{tmp_path}")
    with session.scratch():
        session.cut(spark.range(3))
        with session.scratch():
            session.cut(spark.range(4))
            kept = session.cut(spark.range(5), keep=True)
        assert kept.count() == 5 and len(list(tmp_path.iterdir())) == 2
        last = session.cut(kept, keep=True)
    assert last.count() == 5 and len(list(tmp_path.iterdir())) == 1


def test_plugins(spark):
    from furrow.operators import plugins as P

    df = spark.createDataFrame([(1, "maize yam"), (2, ""), (3, None), (4, "maize yam")], "id int, t string")
    got = {r.id: r.embedding for r in P.embed_texts(df, "id", "t").collect()}
    assert got[1] == got[4] and abs(sum(x * x for x in got[1]) - 1) < 1e-6 and not any(got[2]) and not any(got[3])
    done = df.withColumn("text_print", F.xxhash64("t")).where("id < 3")
    assert {r.id for r in P.stale_vectors(df, done, "id", "t").collect()} == {3, 4}

    def extractor(raw):
        if raw == b"bad":
            raise ValueError("broken")
        return [(raw.decode(), [[["h", "k"], ["1"]]])]

    files_ = spark.createDataFrame([("a", bytearray(b"text")), ("b", bytearray(b"bad"))], "path string, content binary")
    rows = {r.path: r for r in P.extract_pages(files_, extractor).collect()}
    assert rows["a"].text == "[[PAGE:1]]\ntext\n[[TABLE_START]]\n| h | k |\n| --- | --- |\n| 1 |  |\n[[TABLE_END]]" and rows["b"].text is None and "broken" in rows["b"].error
    reg = P.register_confidence(spark.createDataFrame([("Karate", "lambda", "x"), ("a b c d", None, "y")], "product string, ingredient string, raw string")).collect()
    assert (reg[0].confidence, reg[0].needs_review, reg[1].confidence) == (1.0, False, 0.4)
    diff = P.value_diff(spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k int, v string"), spark.createDataFrame([(1, "b"), (2, None), (4, "d")], "k int, v string"), "k", "v")
    assert {r.k for r in diff.collect()} == {1, 3, 4}
    assert P.report_lines(spark.createDataFrame([("x", 10), ("long", 2)], "name string, n int")) == ["name  n", "long  2", "x     10"]
    facts = spark.createDataFrame([("maize", 0.5, "b"), ("maize", 0.9, "a"), ("", 1.0, "z")], "crop string, confidence double, raw_text string")
    assert [tuple(r) for r in P.fact_summary(facts).collect()] == [("maize", "a\nb")]


def test_tables_reports_and_robots(spark, tmp_path):
    from furrow.operators import plugins as P
    from furrow.plans import questions as A

    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    where = str(tmp_path / "t")
    assert files.read_or_empty(spark, where, "id int, v string").count() == 0
    files.append_rows(df, where)
    files.append_rows(df, where)
    assert files.read_or_empty(spark, where, "id int, v string").count() == 4 and files.replace_rows(df, where) == 2
    files.write_report(df.agg(F.count("*").alias("n")), str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r")).first().value == '{"n":2}'
    with pytest.raises(ValueError):
        files.write_report(df, str(tmp_path / "r2"))
    rules = "User-agent: *\nDisallow: /private"
    asked = spark.createDataFrame([(rules, "bot", "http://a/private/x"), (rules, "bot", "http://a/open"), (None, "bot", "http://a/private")], "r string, a string, u string")
    assert [x.ok for x in asked.select(files.robots_allow("r", "a", "u").alias("ok")).collect()] == [False, True, True]
    vectors = spark.createDataFrame([(1, [1.0]), (2, [0.5])], "id int, embedding array<double>")
    assert P.save_vectors(vectors, df, str(tmp_path / "v"), "id") == 2
    with pytest.raises(ValueError):
        P.save_vectors(vectors, df.limit(1), str(tmp_path / "v"), "id")
    raw = spark.createDataFrame([("a.pdf", bytearray(b"x")), ("b.pdf", bytearray(b"bad")), ("c.pdf", bytearray(b"y"))], "path string, content binary")

    def pages(content):
        if bytes(content) == b"bad":
            raise OSError("broken")
        return [("body", [[["h"], ["1"]]])]

    texts, errors = P.extraction_stage(raw, spark.createDataFrame([("c.pdf",)], "path string"), pages)
    assert [(r.path, r.has_tables) for r in texts.collect()] == [("a.pdf", True)] and errors.first().error == "OSError: broken"
    centres = spark.createDataFrame([("A", [1.0, 0.0]), ("B", [0.0, 1.0])], "tier string, centroid array<double>")
    asked = spark.createDataFrame([(1, "maize"), (2, "yam"), (3, "my goat is sick"), (4, None)], "id int, question string")

    def encoder():
        import numpy as np

        return lambda texts: np.array([[1.0, 0.1] if "maize" in t else [0.0, 1.0] if "yam" in t else [0.5, 0.5] for t in texts])

    got = {r.id: (r.tier, r.refused, r.reason) for r in A.route_questions(asked, centres, 0.9, encoder).collect()}
    assert got[1] == ("A", False, "classified") and got[2] == ("B", False, "classified") and got[3][1:] == (True, "safety") and got[4][1:] == (True, "low_confidence")
    text = spark.range(1).select(A.prompt(F.lit("A"), F.lit("Q?"), F.lit("facts")).alias("p")).first().p
    assert text.startswith(A.TASKS["A"]) and text.endswith("facts\n\nQuestion: Q?")
