"""DuckDB counterparts of the core queries. Where SQL cannot express a query it has none, and is tested against brute force."""

from __future__ import annotations

from furrow.functions.text import STOPWORDS
from furrow.functions.vocabulary import COUNTRIES, CROPS, LANGUAGE_MARKS, LEXICON, LOOSE_ZONES, PUBLISHER_POINTS, TABLE_WORDS, TOPIC_WORDS, ZONES
from furrow.operators.calculators import SEEDS
from furrow.operators.extract import PATTERNS
from furrow.plans import cases
from furrow.plans.questions import SAFETY


def _s(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _list(xs) -> str:
    return "[" + ", ".join(_s(x) for x in xs) + "]"


def _space(pattern: str) -> str:
    """The pattern with white space as wide as the engine's: RE2 takes ``\\s`` as ASCII only."""
    out, inside, i = "", False, 0
    while i < len(pattern):
        c = pattern[i : i + 2] if pattern[i] == "\\" else pattern[i]
        if c == "\\s":
            out += r"\s\p{Z}" if inside else r"[\s\p{Z}]"
        else:
            out += c
            inside = c == "[" or (inside and c != "]")
        i += len(c)
    return out


def _latest(table: str, key: str, at: str, name: str) -> str:
    return f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {at} DESC) AS _rn FROM {table}) WHERE _rn = 1)"


_M = "WITH " + _latest("download_manifest", "id", "listed_at", "m")
_C = "WITH " + _latest("chunks", "chunk_id", "chunked_at", "c")
_E = "WITH " + _latest("eval_results", "id", "answered_at", "e")
_CROPS = "list_filter(list_distinct(list_transform(string_split(coalesce(crops_covered, ''), ';'), lambda x: lower(trim(x)))), lambda x: x <> '')"
_TABLES = "list_filter(list_transform(string_split(coalesce(sql_tables_likely, ''), ';'), lambda x: trim(x)), lambda x: x <> '')"
_FLAT = _M + f", pairs AS (SELECT id, unnest({_CROPS}) AS crop, tables FROM (SELECT *, {_TABLES} AS tables FROM m)), flat AS (SELECT id, crop, unnest(CASE WHEN len(tables) > 0 THEN tables ELSE ['(unspecified)'] END) AS fact_table FROM pairs)"
_SCORE = "CASE WHEN isnan(score) THEN NULL ELSE score END"
_EST = "CASE WHEN estimated_pages > 0 THEN estimated_pages WHEN upper(format) = 'PDF' THEN 15 ELSE 1 END"
_HOST = "lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1))"
_WORDS = r"[\p{L}\p{M}\p{N}_]+"
_ASCII = "[a-z0-9]+(?:''[a-z0-9]+)?"


def _truthy(c: str) -> str:
    return f"coalesce(lower(trim({c})) IN ('true', '1', 'yes'), false)"


def _any(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, {_s(w)})" for w in words) + ")"


def _where(column: str, term: str) -> str:
    """Whether a term occurs as a whole word in a column in lower case."""
    return f"regexp_matches({column}, '\\b{term.lower()}\\b')"


_LEX = "MAP {" + ", ".join(f"{_s(k)}: {_s(v)}" for k, v in LEXICON.items()) + "}"
_NORMAL = f"array_to_string(list_transform(regexp_extract_all(lower(strip_accents(lower(question))), '{_WORDS}'), lambda t: coalesce({_LEX}[t], t)), ' ')"
_UNSAFE = f"coalesce(regexp_matches(question, {_s(SAFETY)}) OR regexp_matches(normalised, {_s(SAFETY)}), false)"


def _outcome(status: str = "status") -> str:
    note = f"coalesce(regexp_replace({status}, '^failed:', ''), '')"
    code = f"try_cast(regexp_extract({note}, ':([^:]*)$', 1) AS int)"
    return (
        f"CASE WHEN {note} = 'ok' THEN 'success' WHEN {note} = 'robots_disallowed' THEN 'blocked_robots' WHEN {note} IN ('timeout', 'connection_error') OR starts_with({note}, 'request_error') THEN 'connection_error' "
        f"WHEN {code} = 429 THEN 'http_429' WHEN {code} BETWEEN 500 AND 599 THEN 'http_500' WHEN {code} BETWEEN 400 AND 499 THEN 'http_404' ELSE 'connection_error' END"
    )


def _topic() -> str:
    count = lambda words: " + ".join(f"((length(t) - length(replace(t, {_s(w)}, ''))) // {len(w)})" for w in words)
    cols = ", ".join(f"{count(ws)} AS {name}" for name, ws in TOPIC_WORDS.items())
    best = "greatest(" + ", ".join(TOPIC_WORDS) + ")"
    pick = " ".join(f"WHEN {name} = {best} THEN '{name}'" for name in TOPIC_WORDS)
    return _C + f", t AS (SELECT lower(coalesce(text, '')) AS t FROM c), n AS (SELECT {cols} FROM t) SELECT topic, count(*) AS n FROM (SELECT CASE WHEN {best} = 0 THEN 'unclassified' {pick} END AS topic FROM n) GROUP BY topic"


def _scores() -> str:
    low = "lower(concat_ws(' ', title, download_instructions))"
    zone = f"CASE WHEN {_any(low, LOOSE_ZONES)} THEN 10 WHEN contains({low}, 'nigeria') THEN 5 WHEN contains({low}, 'west africa') THEN 2 ELSE 0 END"
    rel = f"least(least(len({_CROPS}) * 4, 40) + {zone} + least(len({_TABLES}) * 5, 30), 40)"
    pub = "CASE publisher " + " ".join(f"WHEN {_s(k)} THEN {v}" for k, v in PUBLISHER_POINTS.items()) + " ELSE 10 END"
    year = "CASE WHEN try_cast(year AS int) > 2015 THEN 10 WHEN try_cast(year AS int) >= 2010 THEN 5 ELSE 0 END"
    form = "CASE WHEN upper(format) = 'PDF' AND coalesce(estimated_pages, 0) > 10 THEN 10 ELSE 5 END"
    qual = f"least(cast(round_even({pub} * 0.67, 0) AS int) + {year} + {form}, 30)"
    net, free = "contains(coalesce(publisher, ''), 'ResearchGate')", _truthy("gap_filler")
    acc = f"CASE WHEN {net} AND NOT {free} THEN 10 WHEN {free} AND upper(format) = 'PDF' THEN 30 WHEN {free} AND upper(format) = 'HTML' THEN 20 WHEN {net} THEN 10 ELSE 0 END"
    return _M + f", s AS (SELECT id, {rel} AS relevance_score, {qual} AS quality_score, {acc} AS accessibility_score FROM m) SELECT *, relevance_score + quality_score + accessibility_score AS total_score FROM s"


def _language() -> str:
    toks = f"regexp_extract_all(lower(strip_accents(lower(question))), '{_WORDS}')"
    case = " ".join(f"WHEN list_has_any({toks}, {_list(ws)}) THEN '{k}'" for k, ws in LANGUAGE_MARKS.items())
    return _E + f" SELECT id, CASE {case} ELSE 'en' END AS lang FROM e WHERE question IS NOT NULL"


def _facts() -> str:
    parts = [f"SELECT {_s(t)} AS fact_table, {_s(n)} AS pattern, sum(len(regexp_extract_all(text, {_s(_space(p))}))) AS n FROM documents WHERE text IS NOT NULL" for t, ps in PATTERNS.items() for n, p in ps]
    return "SELECT fact_table, pattern, cast(n AS bigint) AS n FROM (" + " UNION ALL ".join(parts) + ") WHERE n > 0"


def _no_facts() -> str:
    hits = " OR ".join(f"regexp_matches(coalesce(text, ''), {_s(_space(p))})" for ps in PATTERNS.values() for _, p in ps)
    return f"SELECT doc_id FROM documents WHERE NOT ({hits})"


_CENTROIDS = """parts AS (SELECT label, i - 1 AS pos, avg(embedding[i]::double) AS x FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM {v}) GROUP BY ALL),
norms AS (SELECT label, sqrt(sum(x * x)) AS n FROM parts GROUP BY label),
cells AS (SELECT p.label, p.pos, p.x / n.n AS x FROM parts p JOIN norms n USING (label)),
centres AS (SELECT label, list(x ORDER BY pos) AS c FROM cells GROUP BY label)"""
_SIMS = "sims AS (SELECT v.vec_id, v.label, t.label AS tier, list_dot_product(v.embedding::double[], t.c) AS sim FROM embeddings v, centres t)"
_ROUTED = "WITH " + _CENTROIDS.format(v="embeddings") + ", " + _SIMS + ", r AS (SELECT vec_id, label, tier, sim, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, tier) AS k, lead(sim) OVER (PARTITION BY vec_id ORDER BY sim DESC, tier) AS second FROM sims), routed AS (SELECT * FROM r WHERE k = 1)"
_FOLDS = "f AS (SELECT *, cast((row_number() OVER (PARTITION BY label ORDER BY md5(cast(vec_id AS varchar)), vec_id) - 1) % 5 AS int) AS fold FROM embeddings)"
_CV = (
    "WITH "
    + _FOLDS
    + """, cellsum AS (SELECT label, fold, i - 1 AS pos, sum(embedding[i]::double) AS s, count(*) AS c FROM (SELECT label, fold, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM f) GROUP BY ALL),
held AS (SELECT label, fold, pos, (sum(s) OVER (PARTITION BY label, pos) - s) / nullif(sum(c) OVER (PARTITION BY label, pos) - c, 0) AS x FROM cellsum),
hn AS (SELECT label, fold, sqrt(sum(x * x)) AS n FROM held WHERE x IS NOT NULL GROUP BY label, fold),
hc AS (SELECT h.label AS tier, h.fold, list(h.x / hn.n ORDER BY h.pos) AS c FROM held h JOIN hn USING (label, fold) WHERE h.x IS NOT NULL GROUP BY h.label, h.fold),
cv AS (SELECT * FROM (SELECT f.vec_id, f.label, hc.tier AS predicted, list_dot_product(f.embedding::double[], hc.c) AS sim, row_number() OVER (PARTITION BY f.vec_id ORDER BY list_dot_product(f.embedding::double[], hc.c) DESC, hc.tier) AS k FROM f JOIN hc USING (fold)) WHERE k = 1)
"""
)
_BM25 = f"""toks AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{_ASCII}') AS t FROM documents),
stats AS (SELECT count(*) AS n_docs, avg(len(t)) AS avgdl FROM toks),
posts AS (SELECT term, doc_id, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM toks) GROUP BY term, doc_id),
dfs AS (SELECT term, count(*) AS df FROM posts GROUP BY term),
raw AS (SELECT term, df, ln(n_docs - df + 0.5) - ln(df + 0.5) AS raw FROM dfs, stats),
terms AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw)"""
_SEARCH = (
    _BM25
    + """, q AS (SELECT doc_id AS query_id, term, count(*) AS qtf FROM (SELECT doc_id, unnest(t) AS term FROM toks WHERE doc_id % 100 = 0) GROUP BY ALL),
hits AS (SELECT query_id, doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 9) AS score FROM q JOIN terms USING (term) JOIN posts USING (term), stats GROUP BY query_id, doc_id),
lexical AS (SELECT query_id, doc_id AS item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM hits WHERE score > 0)"""
)
_DENSE = "near AS (SELECT q.vec_id AS query_id, v.vec_id AS item_id, list_dot_product(q.embedding::double[], v.embedding::double[]) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0), dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM near)"
_FUSED = (
    "WITH "
    + _SEARCH
    + ", "
    + _DENSE
    + """, ranks AS (SELECT query_id, 0 AS ranker, rank, item_id FROM dense WHERE rank <= 8 UNION ALL SELECT query_id, 1, rank, item_id FROM lexical WHERE rank <= 8),
fused AS (SELECT query_id, item_id, round(sum(1.0::double / (60 + rank)), 12) AS score, min(ranker * 1000 + rank) AS seen FROM ranks GROUP BY query_id, item_id),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen, item_id) AS rank FROM fused) WHERE rank <= 4)
"""
)
_REQUESTS = f"""req AS (SELECT row_number() OVER () AS rid, l_orderkey * 10 + l_linenumber AS request_id, ['maize','cassava','rice','cowpea','yam','tomato','sorghum'][l_partkey % 7 + 1] AS crop, {_list(ZONES)}[l_suppkey % 3 + 1] AS zone, cast(l_quantity / 10 AS double) AS area_ha,
 l_quantity, l_extendedprice, l_tax, l_discount, l_linenumber FROM lineitem)"""


def _values(table: str, extra=()) -> str:
    schema, rows = SEEDS[table]
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"string": "varchar", "double": "double", "int": "int"}
    casts = [kinds[c.split()[1]] for c in schema.split(", ")]
    lit = lambda v, k: "NULL::" + k if v is None else f"{_s(v) if isinstance(v, str) else v}::{k}"
    body = ", ".join("(" + ", ".join(lit(v, k) for v, k in zip(r, casts, strict=True)) + ")" for r in [*rows, *extra])
    return f"{table} AS (SELECT * FROM (VALUES {body}) AS t({', '.join(names)}))"


_EXTRA_RATES = [(7, "maize", "Northern Guinea Savanna", "clayey", 3.0, 100.0, 50.0, 50.0, "x"), (8, "maize", "Northern Guinea Savanna", "clayey", 5.0, 140.0, 60.0, 60.0, "x")]


_PAGES = r"""WITH marked AS (SELECT doc_id, coalesce(text, '') AS t, regexp_matches(coalesce(text, ''), '\[\[PAGE:\d+\]\]') AS has FROM documents),
listed AS (SELECT doc_id, CASE WHEN has THEN string_split_regex(t, '\[\[PAGE:\d+\]\]')[2:] ELSE [t] END AS bodies, CASE WHEN has THEN list_transform(regexp_extract_all(t, '\[\[PAGE:(\d+)\]\]', 1), lambda x: try_cast(x AS int)) ELSE [1] END AS numbers FROM marked),
pages AS (SELECT doc_id, i AS page_index, numbers[i] AS page_no, bodies[i] AS body FROM (SELECT *, unnest(range(1, len(bodies) + 1)) AS i FROM listed))"""


_W = r"[\p{L}\p{M}\p{N}_]"
_NORMAL_WS = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '[ \t]{{2,}}', ' ', 'g'), '[ \t]+(\n|$)', '\1', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"
_TABLE = r"(?s)\[\[TABLE_START\]\].*?\[\[TABLE_END\]\]"
_CLEAN = (
    _PAGES
    + rf""", totals AS (SELECT doc_id, count(*) AS n FROM pages GROUP BY doc_id),
lines AS (SELECT doc_id, page_index, unnest(list_distinct(list_filter(list_transform(string_split(regexp_replace(body, '{_TABLE}', '', 'g'), chr(10)), lambda x: trim(x)), lambda x: length(x) > 2))) AS line FROM pages),
heads AS (SELECT doc_id, list(line) AS rep FROM (SELECT doc_id, line, count(*) AS k FROM lines GROUP BY ALL) JOIN totals USING (doc_id) WHERE k >= greatest(2, floor(n * 0.3) + 1) GROUP BY doc_id),
split AS (SELECT doc_id, page_index, coalesce(rep, []) AS rep, string_split_regex(body, '{_TABLE}') AS prose, regexp_extract_all(body, '{_TABLE}') AS tabs FROM pages LEFT JOIN heads USING (doc_id)
 WHERE NOT (regexp_matches(body, '(?im)table of contents|^contents$') OR (len(list_filter(string_split(body, chr(10)), lambda x: trim(x) <> '')) > 3 AND len(list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '\.{{3,}}\s*\d+\s*$'))) / len(list_filter(string_split(body, chr(10)), lambda x: trim(x) <> '')) > 0.3))),
tidy AS (SELECT doc_id, page_index, list_transform(prose, lambda x: regexp_replace(array_to_string(list_filter(string_split(x, chr(10)), lambda y: NOT list_contains(rep, trim(y))), chr(10)), '({_W})-\n({_W})', '\1\2', 'g')) AS prose, tabs FROM split),
joined AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page_index) AS i, array_to_string(list_transform(range(1, len(prose) + 1), lambda k: prose[k] || coalesce(tabs[k], '')), '') AS t FROM tidy),
texts AS (SELECT doc_id, string_agg('[[PAGE:' || i || ']]' || chr(10) || t, chr(10) ORDER BY i) AS t, count(*) AS kept FROM joined GROUP BY doc_id),
clean AS (SELECT p.doc_id, {_NORMAL_WS.format("coalesce(t, '')")} AS clean_text, p.n AS n_pages, p.n - coalesce(kept, 0) AS n_toc FROM totals p LEFT JOIN texts USING (doc_id))"""
)
_UNITS = (
    _CLEAN
    + rf""", bodies AS (SELECT doc_id, unnest(string_split_regex(clean_text, '\[\[PAGE:\d+\]\]')[2:]) AS body FROM clean),
runs AS (SELECT unnest(string_split_regex(body, '{_TABLE}')) AS run FROM bodies),
cuts AS (SELECT unnest(string_split_regex(run, '\n\s*\n')) AS block FROM runs),
blocks AS (SELECT regexp_replace(block, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g') AS block FROM cuts),
lined AS (SELECT block, list_filter(list_transform(string_split(block, chr(10)), lambda x: regexp_replace(x, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')), lambda x: x <> '') AS ls FROM blocks WHERE block <> ''),
typed AS (SELECT *, len(ls) > 1 AND len(list_filter(ls, lambda x: regexp_matches(x, '^(\d+[.)]|\(\d+\)|[-*•])[\s\p{{Z}}]+[^\s\p{{Z}}]'))) = len(ls) AS items,
 len(ls) = 1 AND (regexp_matches(ls[1], '^[A-Z0-9][A-Z0-9 ,.\-/&()]{{2,79}}$') OR regexp_matches(ls[1], '^\d+(\.\d+)*\.?[\s\p{{Z}}]+[^\s\p{{Z}}].{{0,78}}$') OR regexp_matches(ls[1], '^[A-Za-z][A-Za-z0-9 ,\-/&()]{{2,78}}:$')) AS head FROM lined),
units AS (SELECT 'table' AS kind, unnest(regexp_extract_all(body, '{_TABLE}')) AS text FROM bodies UNION ALL SELECT 'list_item', unnest(ls) FROM typed WHERE items UNION ALL SELECT CASE WHEN head THEN 'heading' ELSE 'paragraph' END, block FROM typed WHERE NOT items)"""
)


def _marked() -> str:
    """The pages of the documents and of the literal ones."""
    rows = " UNION ALL ".join(f"SELECT {k}, " + " || chr(10) || ".join(_s(x) for x in t.split("\n")) for k, t in cases.MARKED)
    return _PAGES.replace("FROM documents)", f"FROM (SELECT doc_id, text FROM documents UNION ALL {rows}))")


def _packed_context() -> str:
    from furrow.plans.more_oracle import packed

    return _FUSED + ", chosen AS (SELECT t.query_id, t.rank, t.item_id AS key, d.source, d.text FROM top t JOIN documents d ON d.doc_id = t.item_id), " + packed("chosen") + " SELECT query_id, context, used, source_ids FROM packed"


def _plan() -> str:
    """CTEs ending in ``s3``: three splits in order, each covering what the earlier ones left of its nutrient."""
    out = "WITH " + _REQUESTS + ", " + ", ".join(_values(t) for t in ("calc_fertilizer_rate", "calc_fertilizer_split", "calc_product"))
    out += ", s0 AS (SELECT q.request_id, q.area_ha, r.id, r.n_rate_kg_ha AS wn, r.p2o5_rate_kg_ha AS wp, r.k2o_rate_kg_ha AS wk, r.n_rate_kg_ha AS rn, r.p2o5_rate_kg_ha AS rp, r.k2o_rate_kg_ha AS rk, 0::double AS sn, 0::double AS sp, 0::double AS sk, CASE WHEN area_ha <= 0 THEN 'InvalidInput' WHEN r.id IS NULL THEN 'MissingConstant' END AS error_type FROM req q LEFT JOIN calc_fertilizer_rate r ON r.crop = q.crop AND r.zone = q.zone)"
    for i in (1, 2, 3):
        out += f""", t{i} AS (SELECT s.*, p.product_name AS product{i}, x.timing AS timing{i}, greatest(0, CASE x.basis_nutrient WHEN 'N' THEN rn WHEN 'P2O5' THEN rp ELSE rk END) * x.split_fraction / (CASE x.basis_nutrient WHEN 'N' THEN p.n_pct WHEN 'P2O5' THEN p.p2o5_pct ELSE p.k2o_pct END / 100) AS kg{i}, p.n_pct AS a, p.p2o5_pct AS b, p.k2o_pct AS c, p.bag_weight_kg AS bag{i} FROM s{i - 1} s LEFT JOIN calc_fertilizer_split x ON x.fertilizer_rate_id = s.id AND x.split_number = {i} LEFT JOIN calc_product p ON p.product_name = x.product_name),
s{i} AS (SELECT * EXCLUDE (a, b, c) REPLACE (CASE WHEN kg{i} IS NULL THEN rn ELSE rn - kg{i} * (a / 100) END AS rn, CASE WHEN kg{i} IS NULL THEN rp ELSE rp - kg{i} * (b / 100) END AS rp, CASE WHEN kg{i} IS NULL THEN rk ELSE rk - kg{i} * (c / 100) END AS rk,
 CASE WHEN kg{i} IS NULL THEN sn ELSE sn + kg{i} * (a / 100) * area_ha END AS sn, CASE WHEN kg{i} IS NULL THEN sp ELSE sp + kg{i} * (b / 100) * area_ha END AS sp, CASE WHEN kg{i} IS NULL THEN sk ELSE sk + kg{i} * (c / 100) * area_ha END AS sk) FROM t{i})"""
    return out


def oracle_sql() -> dict[str, str]:
    content = f"list_filter(list_distinct(list_transform(regexp_extract_all(coalesce({{0}}, ''), '[a-zA-Z][a-zA-Z\\-]+'), lambda x: lower(x))), lambda x: length(x) > 2 AND NOT list_contains({_list(STOPWORDS)}, x))"
    zone_cols = ", ".join(f"count(CASE WHEN zone = {_s(z)} THEN 1 END) AS {z.lower().replace(' ', '_').replace('/', '_')}" for z in ZONES)
    crop_cols = ", ".join(f"count(CASE WHEN f.crop = '{c}' THEN 1 END) AS {c}" for c in CROPS)
    from furrow.plans import more_oracle

    return more_oracle.oracle_sql() | {
        "scan_parquet": "SELECT chunk_id, source_id, page_start, page_end FROM chunks WHERE page_start > 10",
        "scan_documents": "SELECT lang, count(*) AS n, sum(length(text)) AS chars, count(*) FILTER (text IS NULL) AS n_null FROM documents GROUP BY lang",
        "latest_records": _M + " SELECT id, priority_rank, publisher FROM m",
        "json_extract": "SELECT event_type, count(*) AS n, sum(try_cast(json_extract_string(props, '$.k') AS bigint)) AS sum_k, max(try_cast(json_extract_string(props, '$.k') AS bigint)) AS max_k FROM events GROUP BY event_type",
        "url_domain_filter": f"SELECT DISTINCT id, {_HOST} AS host FROM download_manifest WHERE {_HOST} IN ('www.seedpress.example', 'repo.cropnotes.example')",
        "url_functions": f"SELECT host, count(*) AS n, count(*) FILTER (path LIKE '%.pdf') AS n_pdf, min(path) AS first_path FROM (SELECT {_HOST} AS host, regexp_extract(url, '^[a-z]+://[^/]+([^?#]*)', 1) AS path FROM fetch_log) GROUP BY host",
        "url_dedupe": "SELECT regexp_replace(trim(url), '/+$', '') AS url_key, min(source_id) AS source_id FROM sources WHERE trim(url) <> '' GROUP BY 1",
        "url_union_dedupe": "SELECT regexp_replace(trim(url), '/+$', '') AS url_key, min(origin) AS origin, count(*) AS n FROM (SELECT url, 'manifest' AS origin FROM download_manifest UNION ALL SELECT url, 'sources' FROM sources) WHERE trim(url) <> '' GROUP BY 1",
        "tag_terms": _C + " SELECT crop, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS crop FROM c WHERE {_where('lower(text)', c)}" for c in CROPS) + ") GROUP BY crop",
        "tag_first_term": "SELECT doc_id, zone FROM (SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(lower(text), '\\b{z.lower()}\\b') THEN {_s(z)}" for z in ZONES) + " END AS zone FROM documents) WHERE zone IS NOT NULL",
        "guess_categories": _C + " SELECT category, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS category FROM c WHERE {_any('lower(text)', ws)}" for k, ws in TABLE_WORDS.items()) + ") GROUP BY category",
        "classify_topic": _topic(),
        "make_row": r"SELECT doc_id, trim(regexp_replace(substring(coalesce(text, ''), 1, 400), '\s+', ' ', 'g')) AS abstract, concat_ws(';', lower(lang), source) AS tags FROM documents",
        "classify_outcome": f"SELECT {_outcome()} AS outcome, count(*) AS n, count(DISTINCT id) AS n_ids FROM fetch_log GROUP BY 1",
        "score_sources": _scores(),
        "manifest": _M + f" SELECT id, row_number() OVER (ORDER BY score DESC, id) AS priority, score, {_EST} AS pages FROM m WHERE {_truthy('gap_filler')} AND {_SCORE} >= 50",
        "manifest_by_publisher": _M + rf", p AS (SELECT coalesce(nullif(lower(trim(regexp_replace(publisher, '\s+', ' ', 'g'))), ''), '(none)') AS publisher, count(*) AS n, sum({_EST})::bigint AS pages FROM m GROUP BY 1) SELECT publisher, n, pages, sum(pages) OVER (ORDER BY pages DESC, publisher ROWS UNBOUNDED PRECEDING)::bigint AS running_pages FROM p",
        "source_ids": r"SELECT DISTINCT file_path, 'RAW_' || substring(regexp_replace(regexp_replace(regexp_extract(file_path, '[^/]*$'), '\.[^.]*$', ''), '[^A-Za-z0-9_\-]', '_', 'g'), 1, 40) || '_' || substring(sha1(file_path), 1, 8) AS raw_id FROM sources WHERE file_path <> ''",
        "safe_filename": _M + r", n AS (SELECT id, substring(regexp_replace(trim(regexp_replace(coalesce(title, ''), '[^\p{L}\p{N} _.\-]', '_', 'g')), '\s+', '_', 'g'), 1, 120) AS name FROM m) SELECT id, CASE WHEN name = '' THEN 'untitled' ELSE name END AS name FROM n",
        "is_garbled": _C + r" SELECT garbled, count(*) AS n FROM (SELECT CASE WHEN len(w) = 0 THEN true WHEN len(w) < 4 THEN false ELSE len(list_filter(w, lambda x: length(x) <= 2)) / len(w) > 0.35 END AS garbled FROM (SELECT list_filter(regexp_split_to_array(trim(coalesce(text, '')), '\s+'), lambda x: x <> '') AS w FROM c)) GROUP BY garbled",
        "is_toc_page": _marked() + r", typed AS (SELECT body, regexp_matches(body, '(?im)table of contents|^contents$') OR (len(list_filter(string_split(body, chr(10)), lambda x: trim(x) <> '')) > 3 AND len(list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '\.{3,}\s*\d+\s*$'))) / len(list_filter(string_split(body, chr(10)), lambda x: trim(x) <> '')) > 0.3) AS toc FROM pages) SELECT toc, count(*) AS n, sum(length(body))::bigint AS chars FROM typed GROUP BY toc",
        "safety_override": _E + f", n AS (SELECT id, question, {_NORMAL} AS normalised FROM e) SELECT id, {_UNSAFE} AS unsafe FROM n",
        "structural_checks": _C + r" SELECT coalesce(token_count, 0) < 50 AS too_short, len(regexp_extract_all(coalesce(text, ''), '\[\[TABLE_START\]\]')) <> len(regexp_extract_all(coalesce(text, ''), '\[\[TABLE_END\]\]')) AS broken_table, count(*) AS n FROM c GROUP BY 1, 2",
        "licence_left_join": _M + ", l AS (SELECT source_id, max(licence) AS licence FROM sources GROUP BY source_id) SELECT m.id, coalesce(l.licence, '') AS licence FROM m LEFT JOIN l ON l.source_id = m.id",
        "chunk_provenance_join": _C + ", s AS (SELECT source_id, min(title) AS source_title FROM sources GROUP BY source_id) SELECT source_id, source_title, count(*) AS n_chunks FROM c JOIN s USING (source_id) GROUP BY ALL",
        "rejected_chunks": _C + " SELECT count(*) AS n_chunks, count(DISTINCT source_id) AS n_sources FROM c WHERE NOT EXISTS (SELECT 1 FROM sources s WHERE s.source_id = c.source_id)",
        "resume_antijoin": f"SELECT DISTINCT id FROM download_manifest d WHERE NOT EXISTS (SELECT 1 FROM fetch_log f WHERE f.id = d.id AND {_outcome('f.status')} IN ('success', 'blocked_robots', 'http_404'))",
        "query_grid": f"SELECT crop, country, query FROM (SELECT crop, country, unnest([crop || ' production guide ' || country || ' extension', crop || ' ' || country || ' smallholder farming', crop || ' agro-ecological zone ' || country || ' recommendation']) AS query FROM (SELECT unnest({_list(CROPS)}) AS crop), (SELECT unnest({_list(COUNTRIES)}) AS country))",
        "word_column_range_join": "SELECT CASE WHEN x0 >= 0 AND x0 < 10 THEN 'a' WHEN x0 >= 10 AND x0 < 25.5 THEN 'b' WHEN x0 >= 25.5 AND x0 < 40 THEN 'c' WHEN x0 >= 40 AND x0 < 50 THEN 'd' END AS \"column\", count(*) AS n, max(x0) AS max_x0 FROM (SELECT cast(l_quantity AS double) AS x0 FROM lineitem) GROUP BY 1",
        "anchor_band_asof": "SELECT l.event_id, r.event_id AS last_purchase FROM (SELECT * FROM events WHERE event_type <> 'purchase') l ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') r ON l.user_id = r.user_id AND l.ts >= r.ts",
        "combo_counts": _FLAT + " SELECT crop, fact_table, count(*) AS n FROM flat GROUP BY crop, fact_table",
        "gap_filler": _FLAT + ", counts AS (SELECT crop, fact_table, count(*) AS n FROM flat GROUP BY crop, fact_table), g AS (SELECT id, bool_or(n < 3) AS g FROM flat JOIN counts USING (crop, fact_table) GROUP BY id) SELECT m.id, coalesce(g.g, false) AS gap_filler FROM m LEFT JOIN g USING (id)",
        "coverage_counts": _M
        + f", f AS (SELECT 'crop' AS kind, unnest({_CROPS}) AS name FROM m UNION ALL SELECT 'fact_table', unnest({_TABLES}) FROM m UNION ALL "
        + " UNION ALL ".join(f"SELECT 'zone', {_s(z)} FROM m WHERE {_where('lower(title)', z)}" for z in ZONES)
        + f"), d AS (SELECT 'crop' AS kind, unnest({_list(CROPS)}) AS name UNION ALL SELECT 'zone', unnest({_list(ZONES)}) UNION ALL SELECT 'fact_table', unnest({_list(TABLE_WORDS)})) SELECT d.kind, d.name, count(f.name) AS n FROM d LEFT JOIN f ON f.kind = d.kind AND f.name = d.name GROUP BY d.kind, d.name",
        "table_crop_matrix": _FLAT + f" SELECT d.name, {crop_cols} FROM (SELECT unnest({_list(TABLE_WORDS)}) AS name) d LEFT JOIN flat f ON f.fact_table = d.name GROUP BY d.name",
        "crop_zone_matrix": _C + f", f AS (SELECT zone, unnest({_CROPS.replace('crops_covered', 'crops')}) AS crop FROM c) SELECT d.name, {zone_cols} FROM (SELECT unnest({_list(CROPS)}) AS name) d LEFT JOIN f ON f.crop = d.name GROUP BY d.name",
        "hard_gaps": _FLAT + f" SELECT a.crop, b.fact_table FROM (SELECT unnest({_list([*CROPS, 'millet'])}) AS crop) a, (SELECT unnest({_list(TABLE_WORDS)}) AS fact_table) b WHERE NOT EXISTS (SELECT 1 FROM flat f WHERE f.crop = a.crop AND f.fact_table = b.fact_table)",
        "chunk_stats": _C + " SELECT count(*) AS n, min(token_count) AS least, quantile_cont(token_count, 0.5) AS median, max(token_count) AS most FROM c",
        "crop_chunk_counts": _C + " SELECT crop, count(*) FILTER (contains(lower(coalesce(crops, '')), crop)) AS n FROM c, (SELECT unnest(" + _list(CROPS) + ") AS crop) GROUP BY crop",
        "topic_distribution": _C + " SELECT topic, count(*) AS n FROM c GROUP BY topic",
        "crop_balance": _C + ", n AS (SELECT crop, count(*) FILTER (contains(lower(coalesce(crops, '')), crop)) AS n FROM c, (SELECT unnest(" + _list(CROPS) + ") AS crop) GROUP BY crop) SELECT round(max(n) / min(n), 6) AS ratio, max(n) / min(n) > 3 AS unbalanced, count(*) AS crops FROM n WHERE n > 0",
        "routing_rates": _E + ", h AS (SELECT gold_tier, detected_language, cast(coalesce(gold_tier, '') = coalesce(routed_tier, '') AS int) AS hit FROM e WHERE error IS NULL) SELECT gold_tier, detected_language, cast(grouping(gold_tier, detected_language) AS bigint) AS level, count(*) AS n, round(avg(hit), 3) AS rate FROM h GROUP BY GROUPING SETS ((gold_tier), (detected_language), ())",
        "eval_scorecard": _E + ", g AS (SELECT * FROM e WHERE error IS NULL) SELECT t.tier, count(g.id) AS n, round(count(g.id) / (SELECT count(*) FROM g), 4) AS share, round(avg(proxy_accuracy_score), 4) AS mean_f1, round(avg(elapsed_s), 4) AS mean_s, count(*) FILTER (refused) AS refused, count(DISTINCT detected_language) AS languages, round(count(*) FILTER (len(source_ids) > 0) / nullif(count(g.id), 0), 4) AS citation_rate FROM (SELECT unnest(['A', 'B', 'C', 'D']) AS tier) t LEFT JOIN g ON g.routed_tier = t.tier GROUP BY t.tier",
        "language_counts": _language().replace(" SELECT id, CASE", ", l AS (SELECT CASE").replace("WHERE question IS NOT NULL", "WHERE error IS NULL") + ") SELECT lang, count(*) AS n FROM l GROUP BY lang",
        "outcome_breakdown": "SELECT status, count(*) AS n, count(DISTINCT id) AS n_ids FROM fetch_log GROUP BY status",
        "next_ids": "WITH t AS (SELECT max(try_cast(substring(id, 4) AS bigint)) AS top FROM download_manifest WHERE starts_with(id, 'SRC')), n AS (SELECT source_id, row_number() OVER (ORDER BY source_id) AS k FROM (SELECT DISTINCT source_id FROM sources WHERE starts_with(source_id, 'RAW_'))) SELECT source_id, 'SRC' || lpad(cast(top + k AS varchar), 8, '0') AS new_id FROM n, t",
        "tokenize": f"SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{_ASCII}') AS t FROM documents)",
        "tokenize_unicode": f"SELECT doc_id, len(regexp_extract_all(lower(coalesce(text, '')), '{_WORDS}')) AS n_tokens FROM documents",
        "token_count": _C + r" SELECT chunk_id, len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{M}\p{N}]+|[^\s\p{L}\p{M}\p{N}]')) AS n FROM c",
        "content_tokens": _E + f" SELECT id, array_to_string(list_sort({content.format('question')}), ' ') AS tokens FROM e",
        "proxy_f1": _E + f", t AS (SELECT id, {content.format('answer_text')} AS a, {content.format('gold_answer')} AS g FROM e) SELECT id, CASE WHEN len(a) = 0 OR len(g) = 0 OR len(list_intersect(a, g)) = 0 THEN 0.0 ELSE round(200.0::double * len(list_intersect(a, g)) / (len(a) + len(g)), 2) END AS f1 FROM t",
        "fold_diacritics": _E + " SELECT id, strip_accents(question) AS folded FROM e WHERE question IS NOT NULL",
        "dehyphenate": r"SELECT doc_id, length(regexp_replace(text, '([\p{L}\p{M}\p{N}_])-\n([\p{L}\p{M}\p{N}_])', '\1\2', 'g')) AS n_chars FROM documents WHERE text IS NOT NULL",
        "normalize_ws": r"SELECT doc_id, length(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[ \t]{2,}', ' ', 'g'), '[ \t]+(\n|$)', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS n_chars FROM documents WHERE text IS NOT NULL",
        "normalise_query": _E + f" SELECT id, {_NORMAL} AS normalised FROM e WHERE question IS NOT NULL",
        "detect_language": _language(),
        "table_to_markdown": "SELECT p_partkey, '| name | size |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || coalesce(p_name, '') || ' | ' || coalesce(cast(p_size AS varchar), '') || ' |' || chr(10) || '| ' || coalesce(p_brand, '') || ' |  |' AS markdown FROM part",
        "inverted_index_text": _M + f", t AS (SELECT id, regexp_extract_all(lower(coalesce(title, '')), '{_ASCII}') AS w FROM m) SELECT id, array_to_string(w[1:60], ' ') AS opening FROM t WHERE len(w) > 0",
        "facts_union": _facts(),
        "zero_yield_docs": _no_facts(),
        "bm25_stats": "WITH " + _BM25 + " SELECT term, df, round(idf, 6) AS idf FROM terms",
        "bm25_search": "WITH " + _SEARCH + " SELECT query_id, item_id AS doc_id, round(score, 4) AS score, rank FROM lexical WHERE rank <= 10",
        "dense_topk": "WITH " + _DENSE + " SELECT query_id, item_id, round(score, 6) AS score, rank FROM dense WHERE rank <= 10",
        "rrf_fuse": _FUSED + "SELECT query_id, item_id, score, rank FROM top",
        "hybrid_retrieve": _FUSED + "SELECT t.query_id, t.rank, t.item_id AS doc_id, d.lang, d.source, t.score FROM top t JOIN documents d ON d.doc_id = t.item_id",
        "cosine_pairs": "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::double / sqrt(list_dot_product(embedding::double[], embedding::double[]))) AS u FROM embeddings), p AS (SELECT a.vec_id AS query_id, b.vec_id AS item_id, list_dot_product(a.u, b.u) AS c FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, item_id) AS rank FROM p) SELECT query_id, item_id, round(c, 6) AS cosine, rank FROM r WHERE rank <= 3",
        "centroid_similarity": "WITH " + _CENTROIDS.format(v="embeddings") + ", " + _SIMS + " SELECT tier, round(max(sim), 6) AS best, round(avg(sim), 6) AS mean FROM sims GROUP BY tier",
        "tier_centroids": "WITH " + _CENTROIDS.format(v="embeddings") + " SELECT label, pos, round(x, 6) AS x FROM cells",
        "route_tier": _ROUTED + " SELECT vec_id, tier, round(sim, 6) AS confidence, sim < 0.74 OR tier = 3 AS refused, CASE WHEN sim < 0.74 THEN 'low_confidence' ELSE 'classified' END AS reason FROM routed",
        "centroid_margin": _ROUTED + " SELECT tier, count(*) AS n, round(avg(sim - second), 6) AS mean_margin FROM routed GROUP BY tier",
        "confidence_stats": _ROUTED + " SELECT tier = label AS ok, count(*) AS n, round(avg(sim), 6) AS mean, round(quantile_cont(sim, 0.1), 6) AS p10, round(quantile_cont(sim, 0.9), 6) AS p90 FROM routed GROUP BY 1",
        "ood_refusal_rate": "WITH known AS (SELECT * FROM embeddings WHERE label < 5), " + _CENTROIDS.format(v="known") + ", " + _SIMS + " SELECT label >= 5 AS outside, count(*) AS n, round(avg(cast(best < 0.74 AS int)), 6) AS refusal_rate FROM (SELECT vec_id, label, max(sim) AS best FROM sims GROUP BY vec_id, label) GROUP BY 1",
        "knn_classify": "WITH " + _DENSE.replace("WHERE q.vec_id % 100 = 0)", "WHERE q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id)") + ", votes AS (SELECT query_id, label, count(*) AS votes, min(rank) AS first, avg(score) AS mean_sim FROM dense JOIN embeddings e ON e.vec_id = item_id WHERE rank <= 5 GROUP BY query_id, label) SELECT query_id, label AS predicted, votes, round(mean_sim, 6) AS mean_sim FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, first) AS k FROM votes) WHERE k = 1",
        "stratified_folds": "WITH " + _FOLDS + " SELECT vec_id, label, fold FROM f",
        "router_cv_eval": _CV + "SELECT label, count(*) AS n, round(avg(cast(predicted = label AS int)), 6) AS accuracy FROM cv GROUP BY ROLLUP (label)",
        "threshold_sweep": _CV + ", g AS (SELECT range / 100 AS threshold FROM range(50, 95, 2)) SELECT threshold, round(coalesce(100.0::double * count(*) FILTER (predicted <> label AND round(sim, 6) < threshold) / nullif(count(*) FILTER (predicted <> label), 0), 0), 4) AS wrong_caught, round(coalesce(100.0::double * count(*) FILTER (predicted = label AND round(sim, 6) < threshold) / nullif(count(*) FILTER (predicted = label), 0), 0), 4) AS correct_lost FROM cv, g GROUP BY threshold",
        "router_knn_cv": "WITH " + _FOLDS + """, p AS (SELECT a.vec_id, a.label AS own, b.label, list_dot_product(a.embedding::double[], b.embedding::double[]) AS s, b.vec_id AS item FROM f a JOIN f b ON a.fold <> b.fold WHERE a.vec_id % 100 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, item) AS rank FROM p),
votes AS (SELECT k, vec_id, own, label, count(*) AS votes, min(rank) AS first FROM r, (SELECT unnest([1, 3, 5]) AS k) WHERE rank <= k GROUP BY ALL), best AS (SELECT *, row_number() OVER (PARTITION BY k, vec_id ORDER BY votes DESC, first) AS b FROM votes)
SELECT k, count(*) AS n, count(*) FILTER (label = own) AS "right" FROM best WHERE b = 1 GROUP BY k""",
        "calc_seed_tables": " UNION ALL ".join(f"SELECT '{t}' AS name, {len(rows)}::bigint AS n" for t, (_, rows) in SEEDS.items()),
        "fert_best_match": "WITH " + _REQUESTS + ", " + _values("calc_fertilizer_rate", _EXTRA_RATES) + """, q AS (SELECT *, CASE WHEN l_linenumber % 2 = 0 THEN 'clayey' END AS soil, CASE WHEN l_linenumber > 2 THEN 4.5 END AS wish FROM req),
cand AS (SELECT q.rid, r.id, CASE WHEN soil IS NOT NULL THEN CASE WHEN r.soil_class = soil THEN 0 WHEN r.soil_class IS NULL THEN 1 ELSE 2 END ELSE CASE WHEN r.soil_class IS NULL THEN 0 ELSE 1 END END AS p1,
 CASE WHEN wish IS NOT NULL THEN coalesce(abs(r.target_yield - wish), 1e9) ELSE CASE WHEN r.target_yield IS NULL THEN 0.0 ELSE 1.0 END END AS p2 FROM q JOIN calc_fertilizer_rate r ON r.crop = q.crop AND r.zone = q.zone),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY p1, p2, id) AS k FROM cand) WHERE k = 1)
SELECT q.request_id, b.id AS rate_id, b.p1 = 0 AND b.p2 = 0 AS matched_exactly, CASE WHEN q.area_ha <= 0 THEN 'InvalidInput' WHEN b.id IS NULL THEN 'MissingConstant' END AS error_type FROM q LEFT JOIN best b USING (rid)""",
        "fert_error_status": "WITH " + _REQUESTS + ", " + _values("calc_fertilizer_rate") + " SELECT error_type, count(*) AS n FROM (SELECT CASE WHEN area_ha <= 0 THEN 'InvalidInput' WHEN r.id IS NULL THEN 'MissingConstant' END AS error_type FROM req q LEFT JOIN calc_fertilizer_rate r ON r.crop = q.crop AND r.zone = q.zone) GROUP BY error_type",
        "fert_split_plan": _plan() + " SELECT * FROM (" + " UNION ALL ".join(f"SELECT request_id, {i} AS step, timing{i} AS timing, product{i} AS product_name, round(round(kg{i} * area_ha, 9), 2) AS product_kg, ceil(round(kg{i} * area_ha / bag{i}, 9))::bigint AS bags, round(kg{i} * area_ha / bag{i}, 6) AS bags_exact FROM s3 WHERE error_type IS NULL AND kg{i} IS NOT NULL" for i in (1, 2, 3)) + ")",
        "fert_totals": _plan() + " SELECT request_id, error_type, " + ", ".join(f"CASE WHEN error_type IS NULL THEN round(round(s{x}, 9), 2) END AS {n}_kg, CASE WHEN error_type IS NULL THEN round(round(w{x} * area_ha - s{x}, 9), 2) END AS {n}_open" for x, n in (("n", "n"), ("p", "p2o5"), ("k", "k2o"))) + " FROM s3",
        "seed_rate": "WITH " + _REQUESTS + ", " + _values("calc_planting_material") + """, p AS (SELECT q.*, m.material_type, m.unit_weight_g, m.stands_per_unit, m.units_per_bundle, 10000.0::double / ((75.0::double / 100.0::double) * (25.0::double / 100.0::double)) * area_ha AS pop, 100 - l_discount * 100 AS germ FROM req q LEFT JOIN calc_planting_material m ON m.crop = q.crop)
SELECT request_id, CASE WHEN area_ha <= 0 OR germ <= 0 OR germ > 100 THEN 'InvalidInput' WHEN material_type IS NULL THEN 'MissingConstant' END AS error_type,
 CASE WHEN material_type IS NOT NULL THEN round(pop, 4) END AS population, CASE WHEN material_type = 'seed' THEN round(round(pop * 2 / ((100.0::double - l_discount * 100) / 100.0::double) * (unit_weight_g / 1000000.0::double), 9), 2) END AS seed_kg, CASE WHEN material_type <> 'seed' THEN ceil(round(pop, 9))::bigint END AS units, CASE WHEN material_type <> 'seed' AND units_per_bundle > 0 THEN ceil(round(pop / units_per_bundle, 9))::bigint END AS bundles FROM p""",
        "spray_dilution": "WITH " + _REQUESTS + ", " + _values("calc_agrochemical") + """, q AS (SELECT rid, request_id, crop, ['Glyphosate','Paraquat','Mancozeb','Atrazine','Nothing'][l_linenumber % 5 + 1] AS product_name, cast(l_quantity AS double) AS tank FROM req),
b AS (SELECT * FROM (SELECT q.*, a.id, a.rate_per_ha, a.rate_unit, a.pre_harvest_interval_days AS days, CASE WHEN a.crop = q.crop THEN 0 WHEN coalesce(a.crop, '') = '' THEN 1 ELSE 2 END AS pref, row_number() OVER (PARTITION BY rid ORDER BY CASE WHEN a.crop = q.crop THEN 0 WHEN coalesce(a.crop, '') = '' THEN 1 ELSE 2 END, a.id) AS k FROM q LEFT JOIN calc_agrochemical a ON a.product_name = q.product_name) WHERE k = 1)
SELECT request_id, CASE WHEN tank <= 0 THEN 'InvalidInput' WHEN id IS NULL THEN 'MissingConstant' END AS error_type, CASE WHEN id IS NOT NULL THEN round(round(rate_per_ha * 1000.0::double * tank / 200.0::double, 9), 0) END AS amount,
 CASE WHEN id IS NOT NULL THEN CASE rate_unit WHEN 'kg' THEN 'g' ELSE 'ml' END END AS unit, days AS interval_days, CASE WHEN id IS NOT NULL THEN CASE pref WHEN 0 THEN 'crop' WHEN 1 THEN 'generic' ELSE 'other' END END AS match_kind FROM b""",
        "gross_margin": "WITH " + _REQUESTS + """, r AS (SELECT CASE WHEN cast(l_discount * 100 - 1 AS double) < 0 THEN 'InvalidInput' END AS error_type, cast(l_quantity AS double) * cast(l_extendedprice AS double) AS revenue, (0.0::double + cast(l_tax * 1000 AS double)) + cast(l_discount * 100 - 1 AS double) AS cost FROM req)
SELECT error_type, count(*) AS n, sum(CASE WHEN error_type IS NULL THEN round(round(revenue, 9), 0) END) AS revenue, sum(CASE WHEN error_type IS NULL THEN round(round(revenue - cost, 9), 0) END) AS margin FROM r GROUP BY error_type""",
        "clean_documents": _CLEAN + " SELECT doc_id, clean_text, n_pages, n_toc FROM clean",
        "unit_types": _UNITS + " SELECT kind, count(*) AS n, sum(length(text))::bigint AS chars FROM units GROUP BY kind",
        "pack_context": _packed_context(),
        "split_pages": _PAGES + " SELECT doc_id, page_index, page_no, length(body) AS n_chars FROM pages",
        "repeated_lines": _marked()
        + """, totals AS (SELECT doc_id, count(*) AS pages FROM pages GROUP BY doc_id), lines AS (SELECT doc_id, page_index, unnest(list_distinct(list_filter(list_transform(string_split(regexp_replace(body, '(?s)\\[\\[TABLE_START\\]\\].*?\\[\\[TABLE_END\\]\\]', '', 'g'), chr(10)), lambda x: trim(x)), lambda x: length(x) > 2))) AS line FROM pages),
counted AS (SELECT doc_id, line, count(*) AS n_pages FROM lines GROUP BY ALL HAVING count(*) >= 2) SELECT doc_id, line, n_pages FROM counted JOIN totals USING (doc_id) WHERE n_pages / pages > 0.3""",
        "tumbling_windows": "SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    }
