"""DuckDB counterparts of ``more_queries``: expected rows where the input is literal, statements over the tables otherwise."""

from __future__ import annotations

from furrow.functions.vocabulary import COUNTRIES, CROPS, TABLE_WORDS, TOPIC_WORDS, ZONES
from furrow.operators.calculators import MESSAGES
from furrow.operators.extract import PATTERNS, STAGES, STATES
from furrow.plans import cases
from furrow.plans.expected import EXPECTED
from furrow.plans.oracle import _ASCII, _C, _CROPS, _E, _FLAT, _M, _any, _list, _NORMAL, _outcome, _s, _scores, _space, _UNSAFE, _values, _where
from furrow.plans.questions import ASK_CALL, NO_FACT, REFUSAL


def _literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    return _s(v) if isinstance(v, str) else f"{v}::double" if isinstance(v, float) else str(v)


def _rows(columns: list[str], rows: list[tuple]) -> str:
    body = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({', '.join(columns)})"


def _expected(name: str) -> str:
    return _rows(*EXPECTED[name])


_ABOUT = _CROPS.replace("crops_covered", "crop")
_PEST = _s(_space(PATTERNS["pest"][0][1]))
_NAMES = _list(CROPS)
_PLACES = {"zone": ZONES, "state": STATES}


def _section(head: str, least: int) -> str:
    found = f"regexp_extract(win, {_s('(?is)' + head + '[:' + chr(92) + 's]+(.{' + str(least) + ',300}?)(?:' + chr(92) + 'n[A-Z][a-z]+:|' + chr(92) + 'n' + chr(92) + 'n|$)')}, 1)"
    return f"substring(replace(regexp_replace({found}, '^\\s+|\\s+$', '', 'g'), chr(10), ' '), 1, 400)"


# a match begins after the parts before it and the matches before it; the same for the mentions of a crop around it
_PESTS = f"""found AS (SELECT doc_id, text, {_ABOUT} AS about, regexp_extract_all(text, {_PEST}) AS ms, string_split_regex(text, {_PEST}) AS ps FROM documents WHERE text IS NOT NULL),
each AS (SELECT *, unnest(range(len(ms))) AS i FROM found),
placed AS (SELECT doc_id, text, about, ms[i + 1] AS m, cast(list_sum(list_transform(ps[1:i + 1], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i], lambda x: length(x))), 0) AS int) AS start FROM each),
around AS (SELECT *, substring(text, start + 1, 800) AS win, least(start, 400) AS off, lower(substring(text, greatest(start - 400, 0) + 1, least(start, 400) + 400)) AS ctx, lower(substring(text, greatest(start - 300, 0) + 1, least(start, 300) + 300)) AS near_text FROM placed),
parts AS (SELECT *, [{', '.join(f"string_split_regex(ctx, '{chr(92)}b{c}{chr(92)}b')" for c in CROPS)}] AS parts FROM around),
dists AS (SELECT *, list_filter(list_transform(range(1, {len(CROPS) + 1}), lambda c: {{'d': list_min(list_transform(range(1, len(parts[c])), lambda i: abs(list_sum(list_transform(parts[c][1:i], lambda x: length(x))) + (i - 1) * length({_NAMES}[c]) - off))), 'o': c}}), lambda x: x.d IS NOT NULL) AS near FROM parts),
linked AS (SELECT *, coalesce({_NAMES}[list_sort(near)[1].o], '') AS any_crop, CASE WHEN len(about) = 1 THEN about[1] END AS single FROM dists),
rivals AS (SELECT *, list_sort(list_filter(near, lambda x: {_NAMES}[x.o] <> single))[1] AS rival FROM linked),
pests AS (SELECT *, CASE WHEN single IS NOT NULL THEN CASE WHEN rival.d <= 60 THEN {_NAMES}[rival.o] ELSE single END ELSE any_crop END AS crop, {_section('symptoms?', 20)} AS symptoms, {_section('cultural' + chr(92) + 's+control', 10)} AS cultural_control, {_section('chemical' + chr(92) + 's+control', 10)} AS chemical_control,
 CASE {' '.join(f"WHEN contains(lower(win), {_s(x)}) THEN {_s(x)}" for x in STAGES)} ELSE '' END AS growth_stage FROM rivals),
rated AS (SELECT *, cast(round(least(0.3 + 0.15 * ((symptoms <> '')::int + (growth_stage <> '')::int + (cultural_control <> '')::int + (chemical_control <> '')::int) + CASE WHEN crop <> '' THEN 0.1 ELSE 0 END, 1.0), 2) AS double) AS confidence FROM pests)
"""
_FACTS = (
    _values("calc_spacing")
    + ", "
    + _values("calc_fertilizer_rate")
    + ", "
    + _PESTS
    + """, known AS (SELECT crop, 0 AS o, row_number() OVER (PARTITION BY crop ORDER BY zone) AS n, 'Spacing for ' || crop || ' (' || zone || '): ' || row_cm || ' cm row x ' || within_row_cm || ' cm plant. Source: ' || source_id AS line, source_id FROM calc_spacing
UNION ALL SELECT crop, 1, id, 'Fertilizer rate for ' || crop || ' (' || zone || '): N=' || n_rate_kg_ha || ' kg/ha, P2O5=' || p2o5_rate_kg_ha || ' kg/ha, K2O=' || k2o_rate_kg_ha || ' kg/ha. Source: ' || source_id, source_id FROM calc_fertilizer_rate
UNION ALL SELECT crop, 2, n, trim(m) || ' on ' || crop || ': ' || symptoms || '. Control: ' || coalesce(nullif(chemical_control, ''), nullif(cultural_control, ''), 'Standard management') || '. Source: ' || doc_id, doc_id::varchar FROM (SELECT *, row_number() OVER (PARTITION BY crop ORDER BY doc_id, start) AS n FROM rated WHERE crop <> '' AND symptoms <> '') WHERE n <= 3),
facts AS (SELECT crop, string_agg(line, chr(10) ORDER BY o, n) AS facts FROM known GROUP BY crop),
cited AS (SELECT crop, string_agg(source_id, ',' ORDER BY first) AS source_ids FROM (SELECT crop, source_id, min(o * 1000 + n) AS first FROM known WHERE source_id <> '' GROUP BY crop, source_id) GROUP BY crop)
"""
)


def _bm25(docs: str, key: str, questions: str, k: int) -> str:
    """CTEs ending in ``best`` (query_id, key, rank)."""
    return f"""dt AS (SELECT {key}, regexp_extract_all(lower(coalesce(text, '')), '{_ASCII}') AS t FROM {docs}),
st AS (SELECT count(*) AS n_docs, avg(len(t)) AS avgdl FROM dt),
po AS (SELECT term, {key}, count(*) AS tf, any_value(dl) AS dl FROM (SELECT {key}, len(t) AS dl, unnest(t) AS term FROM dt) GROUP BY term, {key}),
rw AS (SELECT term, ln(n_docs - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT term, count(*) AS df FROM po GROUP BY term), st),
tm AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM rw) ELSE raw END AS idf FROM rw),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(regexp_extract_all(lower(coalesce(query, '')), '{_ASCII}')) AS term FROM {questions}) GROUP BY ALL),
sc AS (SELECT query_id, {key}, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 9) AS score FROM qt JOIN tm USING (term) JOIN po USING (term), st GROUP BY query_id, {key}),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {key}) AS rank FROM sc WHERE score > 0) WHERE rank <= {k})
"""


def packed(hits: str, k: int = 4, budget: int = 5600) -> str:
    """CTEs from ``hits`` (query_id, rank, key, source, text) to ``packed`` (query_id, context, used, source_ids): the budget is passed on from rank to rank."""
    out = f"p0 AS (SELECT query_id, {budget} AS budget, [] :: varchar[] AS blocks, [] :: varchar[] AS src FROM (SELECT DISTINCT query_id FROM {hits}))"
    for i in range(1, k + 1):
        out += f""", s{i} AS (SELECT p.*, h.key, coalesce(h.source, '') AS source, CASE WHEN h.query_id IS NULL OR budget <= 0 THEN NULL WHEN length(coalesce(h.text, '')) > budget THEN regexp_replace(substring(h.text, 1, budget), ' [^ ]*$', '') || ' [...truncated]' ELSE coalesce(h.text, '') END AS body FROM p{i - 1} p LEFT JOIN {hits} h ON h.query_id = p.query_id AND h.rank = {i}),
p{i} AS (SELECT query_id, CASE WHEN body IS NULL THEN budget ELSE budget - length(body) END AS budget, CASE WHEN body IS NULL THEN blocks ELSE list_append(blocks, '--- Document Chunk [' || CASE WHEN source <> '' THEN source ELSE key::varchar END || ']' || ' ---' || chr(10) || body) END AS blocks, CASE WHEN body IS NULL OR source = '' THEN src ELSE list_append(src, source) END AS src FROM s{i})"""
    ordered = "array_to_string(list_transform(list_sort(list_transform(list_distinct(src), lambda x: {'p': list_position(src, x), 'x': x})), lambda y: y.x), ',')"
    return out + f", packed AS (SELECT query_id, array_to_string(blocks, chr(10) || chr(10)) AS context, len(blocks) AS used, {ordered} AS source_ids FROM p{k})"


_ZONE_IN = "CASE " + " ".join(f"WHEN regexp_matches(q, '\\b{z.lower()}\\b') THEN {_s(z)}" for z in ZONES) + " END"
_CROP_IN = "CASE " + " ".join(f"WHEN regexp_matches(q, '\\b{c}\\b') THEN '{c}'" for c in CROPS) + " END"
_AREA = r"regexp_matches(q, '\d ?(ha|hectares?)\b')"
# what a question leaves out; the tables hold no question that states all values
_SAID = f"""CASE WHEN contains(q, 'seed') THEN CASE WHEN {_CROP_IN} IS NULL OR NOT {_AREA} OR NOT regexp_matches(q, '\\d ?x ?\\d+(\\.\\d+)? ?cm') OR NOT regexp_matches(q, '\\d ?(%|percent)') THEN {_s(MESSAGES['seed_missing'])} ELSE 'complete' END
WHEN contains(q, 'spray') THEN CASE WHEN NOT regexp_matches(q, '\\bspray\\b.* with [^?.]+') OR NOT regexp_matches(q, '\\d ?(l|litres?)\\b') THEN {_s(MESSAGES['spray_missing'])} ELSE 'complete' END
WHEN contains(q, 'margin') THEN {_s(MESSAGES['margin_missing'])}
WHEN regexp_matches(q, 'fertili[sz]er|bags of|urea|npk') THEN CASE WHEN {_CROP_IN} IS NULL OR {_ZONE_IN} IS NULL OR NOT {_AREA} THEN {_s(MESSAGES['fertiliser_missing'])} ELSE 'complete' END END"""
_FUNCTION = "CASE WHEN contains(q, 'seed') THEN 'seed_rate' WHEN contains(q, 'spray') THEN 'spray_dilution' WHEN contains(q, 'margin') THEN 'gross_margin' WHEN regexp_matches(q, 'fertili[sz]er|bags of|urea|npk') THEN 'fertiliser_rate' END"
_ASKED_CROP = "CASE " + " ".join(f"WHEN contains(lower(coalesce(question, '')), '{c}') THEN '{c}'" for c in CROPS) + " ELSE 'maize' END"
_LOG = "log AS (SELECT epoch_us(logged_at) AS n, strftime(fetched_at, '%Y-%m-%d') AS date, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS source, url, regexp_replace(status, '^failed:', '') AS status FROM fetch_log WHERE url IS NOT NULL AND status <> 'ok')"
_BLOCKED = "blocked AS (SELECT (arg_max({'date': date, 'status': status}, {'n': n, 'date': date, 'status': status})).date AS date, source, url, (arg_max({'date': date, 'status': status}, {'n': n, 'date': date, 'status': status})).status AS status FROM log WHERE starts_with(status, 'blocked:') OR status = 'robots_disallowed' GROUP BY source, url)"


def _found(column: str, names, sep: str, part: bool = False) -> str:
    tests = ", ".join(f"CASE WHEN {_any(column, ws) if part else _where(column, n)} THEN {_s(n)} END" for n, ws in (names.items() if part else ((n, None) for n in names)))
    return f"array_to_string(list_filter([{tests}], lambda x: x IS NOT NULL), '{sep}')"


def oracle_sql() -> dict[str, str]:
    low = "lower(url_decode(url))"
    crops, zones, tables = _found(low, CROPS, ", "), _found(low, ZONES, ", "), _found(low, TABLE_WORDS, ", ", part=True)
    country = "CASE " + " ".join(f"WHEN {_where(low, c)} THEN {_s(c)}" for c in COUNTRIES) + " END"
    points = f"least(least(len(list_filter(string_split({crops}, ', '), lambda x: x <> '')) * 4, 40) + CASE WHEN {zones} <> '' OR {_any(low, ['savanna', 'forest zone', 'mangrove', 'coastal'])} THEN 10 WHEN contains({low}, 'nigeria') THEN 5 WHEN contains({low}, 'west africa') THEN 2 ELSE 0 END + least(len(list_filter(string_split({tables}, ', '), lambda x: x <> '')) * 5, 30), 40) + 12"
    told = f"'crops: ' || coalesce(nullif({crops}, ''), 'unspecified') || coalesce(' | country: ' || ({country}), '') || coalesce(' | zone: ' || nullif({zones}, ''), '') || coalesce(' | likely feeds: ' || nullif({tables}, ''), '')"
    label = "CASE status WHEN 'robots_disallowed' THEN 'blocked by robots.txt' WHEN 'blocked:403' THEN 'blocked (HTTP 403 Forbidden)' WHEN 'blocked:429' THEN 'blocked (HTTP 429 Too Many Requests)' WHEN 'blocked:503' THEN 'blocked (HTTP 503 Service Unavailable)' ELSE status END"
    with_country = _M + f", mc AS (SELECT *, {_list([*COUNTRIES, 'Togo', ''])}[(priority_rank % 12) + 1] AS country FROM m)"
    file_name = r"substring(regexp_replace(trim(regexp_replace(coalesce(nullif(title, ''), id), '[^\p{L}\p{N} _.\-]', '_', 'g')), '\s+', '_', 'g'), 1, 120)"
    file_name = f"CASE WHEN {file_name} = '' THEN 'untitled' ELSE {file_name} END"
    count = lambda words: " + ".join(f"((length(lt) - length(replace(lt, {_s(w)}, ''))) // {len(w)})" for w in words)
    best = "greatest(" + ", ".join(f"t_{k}" for k in TOPIC_WORDS) + ")"
    topic = f"CASE WHEN {best} = 0 THEN 'unclassified' " + " ".join(f"WHEN t_{k} = {best} THEN '{k}'" for k in TOPIC_WORDS) + " END"
    gold = _rows(["id", "query", "crop", "zone", "tier", "expected_topic"], cases.gold_questions())
    tiers = dict.fromkeys(q[4] for q in cases.gold_questions())
    domain = [("overall", "")] + [("crop", c) for c in CROPS] + [("zone", z) for z in ZONES] + [("tier", t) for t in tiers]
    cols = EXPECTED["extract_pest"][0]
    place = lambda names: "CASE " + " ".join(f"WHEN {_where('near_text', n)} THEN {_s(n)}" for n in names) + " ELSE '' END"
    cells = ", ".join(f"count(*) FILTER (country = {_s(c)}) AS {c.lower().replace(' ', '_')}" for c in COUNTRIES)
    out = {name: _expected(name) for name in EXPECTED}
    return out | {
        "manual_intake": _M + r""", f AS (SELECT DISTINCT file_path AS url FROM sources WHERE regexp_matches(lower(file_path), '\.(pdf|txt)$') AND file_path NOT IN (SELECT url FROM m WHERE url IS NOT NULL)),
g AS (SELECT *, row_number() OVER (ORDER BY url) AS n, string_split(url, '/') AS p, regexp_replace(regexp_replace(regexp_extract(url, '[^/]*$'), '\.[^.]*$', ''), '[_-]', ' ', 'g') AS words, (SELECT greatest(coalesce(max(try_cast(substring(id, 4) AS bigint)), 0) + 1, 6000) FROM m WHERE starts_with(id, 'SRC')) AS low FROM f)
SELECT 'SRC' || CASE WHEN low + n - 1 < 100000 THEN lpad(cast(low + n - 1 AS varchar), 5, '0') ELSE substring(cast(low + n - 1 AS varchar), 1, 5) END AS id, url, array_to_string(list_transform(string_split(trim(words), ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') AS title, CASE WHEN len(p) > 1 THEN p[-2] ELSE '' END AS publisher, CASE WHEN ends_with(lower(url), '.pdf') THEN 'PDF' ELSE 'TXT' END AS format, """
        + f"array_to_string(list_sort(list_filter([{', '.join(f"CASE WHEN {_where('lower(words)', c)} THEN {_s(c)} END" for c in CROPS)}], lambda x: x IS NOT NULL)), ';') AS crops_covered FROM g",
        "blocked_log": f"WITH {_LOG}, {_BLOCKED} SELECT date, source, url, status FROM blocked",
        "blocked_priority": f"WITH {_LOG}, {_BLOCKED}, every AS (SELECT source, url, status FROM blocked UNION ALL SELECT 'OpenAlex', 'https://api.example/s?q=maize%20spacing%20Ghana', 'robots_disallowed'), scored AS (SELECT source, url, {label} AS status_label, {points} AS score, {told} AS description FROM every) SELECT row_number() OVER (ORDER BY score DESC, source, url) AS position, * FROM scored",
        "download_instructions": _M + f" SELECT id, CASE WHEN publisher = 'NAFDAC' THEN 'NAFDAC register page — screenshot or copy table to nafdac_' || {file_name} || '.txt' WHEN publisher = 'CABI PlantWise' THEN 'PlantWise factsheet — visit URL, select all, copy to ' || string_split(coalesce(crops_covered, ''), ';')[1] || '_' || {file_name} || '_plantwise.txt' WHEN format = 'PDF' THEN 'Direct PDF — right-click and Save As, or wget ' || coalesce(url, '') ELSE 'HTML page — use wget --mirror or copy-paste to ' || {file_name} || '.html' END AS text FROM m",
        "retries": "WITH t AS (SELECT DISTINCT id, fetched_at, regexp_replace(status, '^failed:', '') AS note FROM fetch_log) SELECT id, arg_max(note, fetched_at) AS last FROM t GROUP BY id HAVING count(DISTINCT fetched_at) = 1 AND arg_max(note, fetched_at) IN ('blocked:429', 'timeout')",
        "url_coding": _M + " SELECT id, replace(replace(replace(url_encode(title), '%20', '+'), '~', '%7E'), '%2A', '*') AS encoded, true AS round_trip FROM m WHERE title IS NOT NULL",
        "markdown_manifest": _M + r""", p AS (SELECT *, coalesce(nullif(lower(trim(regexp_replace(publisher, '\s+', ' ', 'g'))), ''), '(none)') AS who, CASE WHEN estimated_pages > 0 THEN estimated_pages WHEN upper(format) = 'PDF' THEN 15 ELSE 1 END AS pages FROM m)
SELECT who AS publisher, 0::bigint AS line_no, '## ' || who || ' (' || count(*) || ' sources, ' || sum(pages)::bigint || ' pages)' AS text FROM p GROUP BY who
UNION ALL SELECT who, row_number() OVER (PARTITION BY who ORDER BY priority_rank), '- [' || coalesce(title, 'untitled') || '](' || coalesce(url, '') || '), ' || pages || ' pages' FROM p""",
        "wget_lines": _M + r""", n AS (SELECT url, format, substring(regexp_replace(trim(regexp_replace(coalesce(title, ''), '[^\p{L}\p{N} _.\-]', '_', 'g')), '\s+', '_', 'g'), 1, 120) AS name FROM m WHERE trim(url) <> '')
SELECT CASE WHEN upper(format) = 'PDF' THEN 'wget -O ' || chr(39) || CASE WHEN name = '' THEN 'untitled' ELSE name END || '.pdf' || chr(39) || ' ' ELSE 'wget --mirror ' END || chr(39) || replace(url, chr(39), chr(39) || chr(92) || chr(39) || chr(39)) || chr(39) AS line FROM n""",
        "summary_counters": _scores().replace("SELECT *, relevance_score + quality_score + accessibility_score AS total_score FROM s", "SELECT (SELECT count(*) FROM s) AS n, (SELECT count(*) FROM s WHERE relevance_score + quality_score + accessibility_score > 60) AS n_high, (SELECT count(DISTINCT id) FROM rare) AS n_gap_fillers").replace(", s AS (", ", " + _FLAT[len(_M) + 2 :] + ", rare AS (SELECT id FROM flat JOIN (SELECT crop, fact_table FROM flat GROUP BY crop, fact_table HAVING count(*) < 3) USING (crop, fact_table)), s AS ("),
        "feeds_facts": _M + f" SELECT id, {_any('t', [w for k in ('fertilizer_rate', 'spacing', 'crop_calendar') for w in TABLE_WORDS[k]])} AS feeds FROM (SELECT id, lower(concat_ws(' ', title, replace(sql_tables_likely, '_', ' '))) AS t FROM m)",
        "crop_country_matrix": with_country + f", f AS (SELECT country, unnest({_CROPS}) AS crop FROM mc) SELECT d.name, {cells} FROM (SELECT unnest({_NAMES}) AS name) d LEFT JOIN f ON f.crop = d.name GROUP BY d.name",
        "country_default": with_country + " SELECT CASE WHEN country = '' THEN 'Nigeria' ELSE country END AS country, count(*) AS n FROM mc GROUP BY 1",
        "dict_diff": _M + ", s AS (SELECT source_id AS id, min(coalesce(publisher, '')) AS publisher FROM sources GROUP BY source_id) SELECT coalesce(m.id, s.id) AS id, CASE WHEN m.id IS NOT NULL THEN coalesce(m.publisher, '') END AS left_value, s.publisher AS right_value FROM m FULL JOIN s ON m.id = s.id WHERE m.id IS NULL OR s.id IS NULL OR coalesce(m.publisher, '') <> s.publisher",
        "distinct_sources": _E + ", l AS (SELECT id, coalesce(source_ids, []) AS s FROM e) SELECT id, len(s) AS n, array_to_string(list_transform(list_sort(list_transform(list_distinct(s), lambda x: {'p': list_position(s, x), 'x': x})), lambda y: y.x), ',') AS source_ids FROM l",
        "has_tables": "SELECT doc_id, contains(coalesce(text, ''), '[[TABLE_START]]') AS has_tables FROM documents",
        "keep_best_cases": "SELECT unnest(range(1, 22, 2)) AS rank",
        "chunk_enrich": _C + f", about AS (SELECT source_id, min(title) AS title, list_distinct(flatten(list({_CROPS}))) AS doc_crops FROM sources GROUP BY source_id), "
        + f"j AS (SELECT c.chunk_id, lower(coalesce(c.text, '')) AS lt, lower(coalesce(a.title, '')) AS dt, coalesce(a.doc_crops, []) AS doc_crops FROM c LEFT JOIN about a ON a.source_id = c.source_id), k AS (SELECT *, {_found('lt', ZONES, ';')} AS own, {_found('dt', ZONES, ';')} AS doc_zones, {_found('lt', CROPS, ';')} AS found, {', '.join(f'{count(ws)} AS t_{n}' for n, ws in TOPIC_WORDS.items())} FROM j) "
        + f"SELECT chunk_id, array_to_string(list_sort(list_distinct(list_concat(list_filter(string_split(found, ';'), lambda x: x <> ''), doc_crops))), ';') AS crops, array_to_string(list_sort(list_filter(string_split(CASE WHEN own <> '' THEN own ELSE doc_zones END, ';'), lambda x: x <> '')), ';') AS zones, {topic} AS topic FROM k",
        "extract_pest": f"WITH {_PESTS} {_expected('extract_pest')} UNION ALL SELECT doc_id, 'pest_name', start, crop, trim(m), symptoms, growth_stage, cultural_control, chemical_control, replace(substring(win, 1, 300), chr(10), ' '), confidence FROM rated".replace("SELECT * FROM (VALUES", f"SELECT {', '.join(cols)} FROM (VALUES", 1),
        "nearest_term": f"WITH {_PESTS} SELECT doc_id, start, any_crop AS crop FROM rated",
        "nearest_place": f"WITH {_PESTS} SELECT doc_id, start, {place(ZONES)} AS zone, {place(STATES)} AS state FROM rated",
        "confidence_histogram": f"WITH {_PESTS}, every AS (SELECT 'pest' AS t, confidence AS c FROM rated UNION ALL "
        + " UNION ALL ".join(f"SELECT '{t}', {r[-1]}" for t in PATTERNS for r in EXPECTED[f"extract_{t}"][1])
        + ") SELECT t AS fact_table, count(*) FILTER (c < 0.7) AS low, count(*) FILTER (c >= 0.7 AND c < 0.9) AS mid, count(*) FILTER (c >= 0.9) AS high FROM every GROUP BY t",
        "tier_a_facts": f"WITH {_FACTS} SELECT crop, facts, coalesce(source_ids, '') AS source_ids FROM facts LEFT JOIN cited USING (crop)",
        "question_crops": _E + f" SELECT id, {_ASKED_CROP} AS crop FROM e",
        "tool_validation": _E + f", asked AS (SELECT id, lower(coalesce(question, '')) AS q FROM e) SELECT id, {_FUNCTION} AS function, {_SAID} AS error_message FROM asked UNION ALL {_expected('tool_validation')}",
        "parse_tool_call": _E + f", calls AS (SELECT id, try_cast(answer_text AS json) AS j FROM e WHERE answer_text LIKE '%{{%}}%') SELECT id, j->>'$.function' AS function, j->>'$.error' AS error, j->>'$.params.crop' AS crop FROM calls WHERE j IS NOT NULL UNION ALL {_expected('parse_tool_call')}",
        "answer_questions": "WITH " + _FACTS + ", " + _C[5:] + ", " + _E[5:] + f""", asked AS (SELECT id, question, lower(coalesce(question, '')) AS q, coalesce(routed_tier, 'D') AS tier, {_NORMAL} AS normalised FROM e),
r AS (SELECT *, {_UNSAFE} OR question IS NULL OR tier NOT IN ('A', 'B', 'C') AS refused FROM asked),
qs AS (SELECT id AS query_id, question AS query FROM r WHERE tier = 'B' AND NOT refused), {_bm25('c', 'chunk_id', 'qs', 4)}, hits AS (SELECT query_id, rank, chunk_id AS key, source_id AS source, text FROM best JOIN c USING (chunk_id)), {packed('hits')}
SELECT r.id, r.tier, r.refused, CASE WHEN r.refused THEN {_s(REFUSAL)} WHEN r.tier = 'A' THEN coalesce(f.facts, replace({_s(NO_FACT)}, '%s', {_ASKED_CROP})) WHEN r.tier = 'B' THEN coalesce(p.context, 'No relevant document passages found.') ELSE coalesce({_SAID}, {_s(ASK_CALL)}) END AS answer,
 CASE WHEN r.refused THEN '' WHEN r.tier = 'A' THEN coalesce(s.source_ids, '') WHEN r.tier = 'B' THEN coalesce(p.source_ids, '') ELSE '' END AS source_ids
FROM r LEFT JOIN facts f ON f.crop = {_ASKED_CROP} LEFT JOIN cited s ON s.crop = {_ASKED_CROP} LEFT JOIN packed p ON p.query_id = r.id""",
        "gold_questions": gold,
        "hit_rates": _C + f", gold AS ({gold}), qs AS (SELECT id AS query_id, query FROM gold), {_bm25('c', 'chunk_id', 'qs', 5)}, ok AS (SELECT g.*, coalesce((SELECT bool_or(list_contains(string_split(coalesce(c.crops, ''), ';'), g.crop) AND coalesce(c.topic = g.expected_topic, false)) FROM best b JOIN c USING (chunk_id) WHERE b.query_id = g.id), false)::int AS hit FROM gold g), "
        + "told AS (SELECT 'overall' AS level, '' AS name, hit FROM ok UNION ALL SELECT 'crop', crop, hit FROM ok UNION ALL SELECT 'zone', zone, hit FROM ok UNION ALL SELECT 'tier', tier, hit FROM ok), "
        + f"d AS ({_rows(['level', 'name'], domain)}) SELECT d.level, d.name, count(hit) AS n, coalesce(sum(hit), 0)::bigint AS hits, round(coalesce(avg(hit), 0), 3)::double AS rate, d.level IN ('crop', 'zone') AND round(coalesce(avg(hit), 0), 3) < 0.6 AS gap FROM d LEFT JOIN told t ON t.level = d.level AND t.name = d.name GROUP BY d.level, d.name",
    }
