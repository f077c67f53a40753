"""DuckDB statements for those queries SQL can express; the others are tested against brute force in tests/llm."""

from __future__ import annotations

_RECORDS = r"""records AS (
  SELECT id, nullif(lower(trim(regexp_replace(publisher, '\s+', ' ', 'g'))), '') AS who, publisher, CASE WHEN isnan(score) THEN NULL ELSE score END AS s, score, title, crops_covered
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY listed_at DESC) AS rn FROM download_manifest) WHERE rn = 1)"""
_CUTS = (
    "WITH "
    + _RECORDS
    + r""", goals AS (SELECT lower(trim(regexp_replace(publisher, '\s+', ' ', 'g'))) AS who, max(target_pct) AS target_pct FROM keep_targets GROUP BY 1),
ranked AS (
  SELECT r.id, r.who, r.s, g.target_pct, count(*) OVER (PARTITION BY r.who) AS n,
         count(*) OVER (PARTITION BY r.who ORDER BY r.s DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ge
  FROM records r JOIN goals g ON r.who = g.who WHERE r.s IS NOT NULL),
cuts AS (SELECT who, max(s) AS cutoff FROM ranked WHERE 100 * ge >= target_pct * n GROUP BY who)
"""
)
_CAPPED = (
    "WITH "
    + _RECORDS
    + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY who ORDER BY s DESC NULLS LAST, id) AS r, (SELECT count(*) * 5 // 100 FROM records) AS cap FROM records)
"""
)
_WORDS = (
    "WITH "
    + _RECORDS
    + r""", worded AS (
  SELECT id, list_distinct(regexp_extract_all(strip_accents(lower(coalesce(title, ''))), '[a-z0-9]+')) AS words,
         list_filter(list_distinct(list_transform(string_split(coalesce(crops_covered, ''), ';'), lambda x: lower(trim(x)))), lambda x: x <> '') AS crops FROM records),
titled AS (SELECT * FROM worded WHERE len(words) > 0),
postings AS (SELECT id, unnest(words) AS w FROM titled),
frequency AS (SELECT w, count(*) AS df FROM postings GROUP BY w),
prefixed AS (
  SELECT p.id, p.w, row_number() OVER (PARTITION BY p.id ORDER BY f.df, p.w) AS pos, len(t.words) AS n
  FROM postings p JOIN frequency f USING (w) JOIN titled t USING (id)),
heads AS (SELECT id, w FROM prefixed WHERE pos <= n - ceil(0.6 * n - 1e-9) + 1),
candidates AS (SELECT DISTINCT a.id AS id_a, b.id AS id_b FROM heads a JOIN heads b ON a.w = b.w AND a.id < b.id)
SELECT c.id_a, c.id_b FROM candidates c JOIN titled a ON a.id = c.id_a JOIN titled b ON b.id = c.id_b
WHERE len(list_intersect(a.words, b.words)) >= 0.6 * (len(a.words) + len(b.words) - len(list_intersect(a.words, b.words))) - 1e-9
  AND (len(list_intersect(a.crops, b.crops)) > 0 OR (len(a.crops) = 0 AND len(b.crops) = 0))"""
)
_CHUNKS = "SELECT chunk_id FROM (SELECT chunk_id, text, row_number() OVER (PARTITION BY chunk_id ORDER BY chunked_at DESC) AS rn FROM chunks) WHERE rn = 1 AND length(text) > 1800"

_WINDOWS = """WITH classes AS (SELECT min(doc_id) AS cls, text, length(text) AS n, count(*) AS copies FROM documents WHERE length(text) >= 200 GROUP BY text),
ids AS (SELECT d.doc_id, c.cls FROM documents d JOIN classes c ON c.text = d.text),
windows AS (SELECT cls, s, substring(text, s + 1, 200) AS w FROM (SELECT cls, text, unnest(range(n - 199)) AS s FROM classes)),
repeated AS (SELECT w, count(DISTINCT cls) AS n_texts FROM windows GROUP BY w HAVING count(DISTINCT cls) > 1),
hits AS (SELECT cls, s, w, n_texts FROM windows JOIN repeated USING (w))
"""
_SHARING = (
    _WINDOWS
    + """, links AS (SELECT DISTINCT a.cls AS a, b.cls AS b FROM hits a JOIN hits b ON a.w = b.w AND a.cls < b.cls)
SELECT least(x.doc_id, y.doc_id) AS doc_id_a, greatest(x.doc_id, y.doc_id) AS doc_id_b FROM links JOIN ids x ON x.cls = links.a JOIN ids y ON y.cls = links.b
UNION SELECT x.doc_id, y.doc_id FROM ids x JOIN ids y ON x.cls = y.cls AND x.doc_id < y.doc_id"""
)
_SHARED = (
    _WINDOWS
    + """, islands AS (SELECT cls, s, n_texts, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY cls ORDER BY s) AS island FROM (SELECT *, coalesce(s - lag(s) OVER (PARTITION BY cls ORDER BY s) > 200, true) AS gap FROM (SELECT DISTINCT cls, s, n_texts FROM hits))),
spans AS (SELECT cls, island, min(s) AS s, max(s) + 200 AS e, max(n_texts) AS most FROM islands GROUP BY cls, island),
part AS (SELECT cls, sum(e - s) AS chars, count(*) AS k, string_agg(s || '-' || e, ',' ORDER BY s) AS iv, max(most) AS most FROM spans GROUP BY cls),
per AS (SELECT c.cls, CASE WHEN c.copies > 1 THEN c.n ELSE coalesce(p.chars, 0) END AS chars, CASE WHEN c.copies > 1 THEN 1 ELSE coalesce(p.k, 0) END AS k, CASE WHEN c.copies > 1 THEN '0-' || c.n ELSE coalesce(p.iv, '') END AS iv, coalesce(p.most, CASE WHEN c.copies > 1 THEN 1 ELSE 0 END) AS most FROM classes c LEFT JOIN part p USING (cls))
SELECT d.doc_id, coalesce(length(d.text), 0) AS n_chars, coalesce(p.chars, 0)::bigint AS shared_chars, CASE WHEN length(d.text) > 0 THEN round(coalesce(p.chars, 0) / length(d.text), 6) ELSE 0.0 END::double AS shared_share,
 coalesce(p.k, 0) AS n_intervals, coalesce(p.iv, '') AS intervals, coalesce(p.most, 0) AS most_texts, coalesce(i.cls, d.doc_id) AS text_class FROM documents d LEFT JOIN ids i USING (doc_id) LEFT JOIN per p ON p.cls = i.cls"""
)


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _CUTS + "SELECT r.id FROM ranked r JOIN cuts c ON r.who = c.who WHERE r.s >= c.cutoff",
        "p1_cutoffs": _CUTS
        + """SELECT g.who AS source, g.target_pct, coalesce(max(r.n), 0) AS n_records, max(c.cutoff) AS cutoff, count(CASE WHEN r.s >= c.cutoff THEN 1 END) AS n_kept
FROM goals g LEFT JOIN ranked r ON r.who = g.who LEFT JOIN cuts c ON c.who = g.who GROUP BY g.who, g.target_pct""",
        "p2_found": _CHUNKS,
        "p3_found": _CAPPED + "SELECT id FROM ranked WHERE who IS NOT NULL AND r > cap",
        "p3_kept": _CAPPED + "SELECT id, publisher, score FROM ranked WHERE who IS NULL OR r <= cap",
        "p4_found": _WORDS,
        "p4_groups": "WITH RECURSIVE pairs AS (" + _WORDS + """), edges AS (SELECT id_a AS a, id_b AS b FROM pairs UNION ALL SELECT id_b, id_a FROM pairs),
reach(a, b) AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b), least AS (SELECT a, least(a, min(b)) AS g FROM reach GROUP BY a),
ids AS (SELECT id FROM (SELECT id, title, row_number() OVER (PARTITION BY id ORDER BY listed_at DESC) AS rn FROM download_manifest) WHERE rn = 1 AND regexp_matches(strip_accents(lower(coalesce(title, ''))), '[a-z0-9]')),
named AS (SELECT ids.id, coalesce(g, ids.id) AS group_id, (SELECT count(*) FROM edges WHERE edges.a = ids.id) AS n_links FROM ids LEFT JOIN least ON least.a = ids.id)
SELECT id, group_id, count(*) OVER (PARTITION BY group_id) AS group_size, n_links FROM named""",
        "p2_checks": "SELECT chunk_id, md5(text) AS md5, length(text) AS n_chars, true AS within_limit, true AS within_overlap FROM (" + _CHUNKS.replace("SELECT chunk_id FROM", "SELECT chunk_id, text FROM") + ")",
        "p6_checks": "SELECT doc_id, true AS whole, coalesce(text, '') <> '' AS placed, true AS fits, true AS split_only_if_needed FROM documents",
        "p7_checks": """SELECT t.source, count(d.doc_id) AS n_docs, count(d.doc_id) > 0 AS in_mix, true AS repeats_kept, true AS share_met, true AS full_size
FROM mix_targets t LEFT JOIN documents d ON d.source = t.source AND d.text <> '' GROUP BY t.source""",
        "p8_found": _SHARING,
        "p8_shared": _SHARED,
    }
