"""Structured facts mined from text by pattern.

One Arrow pass finds the matches of all patterns of a document with their offsets; everything after that (linking a match to the
crop and place around it, confidence, review flag) is column expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.functions.vocabulary import CROPS, ZONES
from furrow.session import computed, cut, scratch, spread

# Months, units, pests and the phrases that announce a fact. Groups are numbered as the columns of each table expect.
MONTH = r"(January|February|March|April|May|June|July|August|September|October|November|December)"
KG_HA = r"kg\s*(?:/\s*ha|ha)(?:\s*[-−]\s*1|\s*⁻¹)?"
NUMBER = r"(\d+(?:\.\d+)?)"
PESTS = ["weevil", "borer", "aphid", "nematode", "striga", "armyworm", "thrips", "mealybug", "mite", "beetle", "caterpillar", "worm", "whitefly", "moth", "blight", "rust", "wilt", "mosaic virus", "anthracnose", "smut", "rot", "leaf spot"]
STAGES = ["seedling", "vegetative", "flowering", "grain filling", "maturity", "germination", "tillering"]
STATES = [
    "abia", "adamawa", "akwa ibom", "anambra", "bauchi", "bayelsa", "benue", "borno", "cross river", "delta", "ebonyi", "edo", "ekiti", "enugu", "gombe", "imo", "jigawa", "kaduna", "kano", "katsina", "kebbi", "kogi", "kwara",
    "lagos", "nasarawa", "niger", "ogun", "ondo", "osun", "oyo", "plateau", "rivers", "sokoto", "taraba", "yobe", "zamfara", "fct", "abuja",
]
PATTERNS: dict[str, list[tuple[str, str]]] = {
    "crop_calendar": [
        ("plant_in_month", rf"(?i)plant(?:ing)?\s+in\s+{MONTH}"),
        ("planting_window", rf"(?i)planting\s+window[:\s]+{MONTH}\s*(?:to|-|–)\s*{MONTH}"),
        ("first_rains", rf"(?i)first\s+rains?[:\s]+{MONTH}"),
    ],
    "spacing": [
        ("spacing_cm_x_cm", rf"{NUMBER}\s*cm\s*[x×X]\s*{NUMBER}\s*cm"),
        ("plants_per_ha", r"(?i)(\d[\d,]*)\s*plants?\s*(?:per|/)\s*(?:hectare|ha)\b"),
        ("row_spacing", rf"(?i)row\s+spacing\s+of\s+{NUMBER}\s*(cm|m)?"),
    ],
    "fertilizer_rate": [
        ("apply_kg_ha", rf"(?i)apply\s+{NUMBER}\s*kg\s*/\s*ha\s+of\s+([A-Za-z0-9\-: ]{{2,30}})"),
        ("basal_dressing", rf"(?i)basal\s+dressing[:\s]+{NUMBER}\s*kg"),
        ("top_dress", rf"(?i)top[\s-]?dress(?:ing)?\s+with\s+{NUMBER}\s*kg\s+([a-zA-Z0-9: ]{{2,20}})"),
        ("n_application", rf"(?i)N\s+application\s+of\s+{NUMBER}\s*{KG_HA}"),
        ("nitrogen_rate", rf"(?i)nitrogen\s+rate\s+of\s+{NUMBER}\s*{KG_HA}"),
        ("kg_n_per_ha", rf"(?i){NUMBER}\s*kg\s*N\s+per\s+hectare"),
        ("kg_n_slash_ha", rf"(?i){NUMBER}\s*kg\s*N\s*/\s*ha\b"),
        ("applied_at_kg_ha", rf"(?i)applied\s+at\s+{NUMBER}\s*{KG_HA}"),
        ("applied_at_kg", rf"(?i)applied\s+at\s+{NUMBER}\s*kg\b"),
        ("fertilized_with", rf"(?i)fertili[sz]ed\s+with\s+{NUMBER}\s*kg\b"),
        ("recommended_rate", rf"(?i)recommended\s+rate\s+of\s+{NUMBER}\s*(?:{KG_HA})?"),
        ("at_a_rate_of", rf"(?i)at\s+a\s+rate\s+of\s+{NUMBER}\s*(?:kg|L)\s*/\s*ha\b"),
        ("bare_kg_ha", rf"(?i){NUMBER}\s*{KG_HA}"),
    ],
    "agrochemical": [
        ("product_rate", rf"([A-Z][A-Za-z0-9\-®]*(?:\s+[A-Za-z][A-Za-z0-9\-®]*){{0,2}})\s+at\s+{NUMBER}\s*((?i:ml|g))\s*/\s*((?i:litre|liter|l))\b"),
        ("litres_ha", rf"(?i)apply\s+{NUMBER}\s*litres?\s*/\s*ha"),
        ("interval", r"(?i)pre[\s-]?harvest\s+interval\s*(?:of|:)?\s*(\d+)\s*days?"),
        ("interval_short", r"PHI\s*(?:of|:)?\s*(\d+)\s*days?"),
        ("dose", rf"(?i)dose\s+of\s+{NUMBER}\s*g\s*/\s*L\b"),
        ("concentration", rf"(?i)concentration\s+of\s+{NUMBER}\s*ml\s*/\s*L\b"),
        ("applied_at_l_ha", rf"(?i)applied\s+at\s+{NUMBER}\s*L\s*/\s*ha\b"),
        ("rate_of_l_ha", rf"(?i)at\s+a\s+rate\s+of\s+{NUMBER}\s*L\s*/\s*ha\b"),
    ],
    "variety": [
        ("maturity", r"(?i)maturity[:\s]+(\d+)\s*(?:-\s*(\d+))?\s*days?"),
        ("released", r"([A-Z][A-Za-z0-9\-]{1,20})\s+(?:is\s+a\s+)?(?i:released\s+variety)"),
        ("recommended", r"(?i)recommended\s+for\s+([A-Za-z /]{3,40})"),
    ],
    "pest": [("pest_name", rf"(?i)([A-Z][a-z]+(?:\s[A-Za-z]+){{0,2}}\s(?:{'|'.join(PESTS)}))")],
}
IMPLIED = {"basal_dressing": "urea", "n_application": "nitrogen", "nitrogen_rate": "nitrogen", "kg_n_per_ha": "nitrogen", "kg_n_slash_ha": "nitrogen"}
LESS_SURE = ("litres_ha", "dose", "concentration", "applied_at_l_ha", "rate_of_l_ha")
UNITS = {"litres_ha": "litres/ha", "dose": "g/L", "concentration": "ml/L", "applied_at_l_ha": "L/ha", "rate_of_l_ha": "L/ha"}
SECTIONS = {
    "symptoms": r"(?is)symptoms?[:\s]+(.{20,300}?)(?=\n[A-Z][a-z]+:|\n\n|$)",
    "cultural_control": r"(?is)cultural\s+control[:\s]+(.{10,300}?)(?=\n[A-Z][a-z]+:|\n\n|$)",
    "chemical_control": r"(?is)chemical\s+control[:\s]+(.{10,300}?)(?=\n[A-Z][a-z]+:|\n\n|$)",
}
REACH, PLACE_REACH, OVERRIDE, AROUND, WINDOW = 400, 300, 60, 60, 800


def _matcher(patterns: Sequence[tuple[str, str]]):
    ready = [(name, re.compile(p)) for name, p in patterns]
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.string(), pa.string(), pa.int32()]
    names = ["pattern", "start", "stop", "groups", "raw_text", "around", "at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, owner = [], []
            for n, text in enumerate(batch.column(1).to_pylist()):
                for name, p in ready if text else ():
                    for m in p.finditer(text):
                        lo = max(0, m.start() - REACH)
                        owner.append(n)
                        rows.append((name, m.start(), m.end(), list(m.groups()), text[max(0, m.start() - AROUND) : m.end() + AROUND].strip(), text[lo : m.start() + max(REACH, WINDOW)], m.start() - lo))
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            at = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(2).take(at), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], ["key", "doc_crops", *names])

    return run


def matches(docs: DataFrame, patterns: Sequence[tuple[str, str]], key: str = "doc_id", text: str = "text", crops: str | None = None) -> DataFrame:
    """(key, doc_crops, pattern, start, stop, groups, raw_text, around, at): every match in the whole text; ``around`` is the text near it, ``at``
    the position of the match therein, ``doc_crops`` the array column ``crops`` (empty without one). Null and empty texts have none."""
    about = F.coalesce(F.col(crops), F.array()) if crops else F.array()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), about.cast("array<string>").alias("crops"))
    return spread(rows).mapInArrow(_matcher(patterns), f"key {dict(docs.dtypes)[key]}, doc_crops array<string>, pattern string, start int, stop int, groups array<string>, raw_text string, around string, at int")


def _distance(term: str) -> Column:
    """Characters between the match and the nearest whole-word mention within reach; null without one."""
    ctx = F.lower(F.substring("around", F.lit(1), F.col("at") + REACH))
    # positions of a word: lengths of the text before each occurrence, from the parts between occurrences
    parts = F.split(ctx, rf"(?U)\b{term}\b")
    starts = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.aggregate(F.slice(parts, F.lit(1), i), F.lit(0), lambda s, x: s + F.length(x)) + (i - 1) * len(term))
    return F.when(F.size(parts) > 1, F.array_min(F.transform(starts, lambda p: F.abs(p - F.col("at")))))


def nearest_crop(doc_crops: Column, crops: Sequence[str] = CROPS) -> Column:
    """The crop mentioned nearest to the match. If the document is about one crop, that one, unless another is mentioned within
    ``OVERRIDE`` characters. '' if there is none."""
    near = F.filter(F.array(*[F.struct(_distance(c).alias("d"), F.lit(i).alias("o"), F.lit(c).alias("c")) for i, c in enumerate(crops)]), lambda x: x["d"].isNotNull())
    best = F.array_min(near)["c"]
    single = F.when(F.size(doc_crops) == 1, doc_crops[0])
    rival = F.array_min(F.filter(near, lambda x: x["c"] != single))
    return F.when(single.isNotNull(), F.when(rival["d"] <= OVERRIDE, rival["c"]).otherwise(single)).otherwise(F.coalesce(best, F.lit("")))


def first_place(places: Sequence[str]) -> Column:
    """The first place of the dictionary within reach of the match, '' if none."""
    begin = F.greatest(F.lit(1), F.col("at") - PLACE_REACH + 1)
    ctx = F.lower(F.substring("around", begin, F.col("at") + PLACE_REACH - begin + 1))
    hits = F.array_compact(F.array(*[F.when(ctx.rlike(rf"(?U)\b{p.lower()}\b"), F.lit(p)) for p in places]))
    return F.coalesce(F.try_element_at(hits, F.lit(1)), F.lit(""))


def confidence(has_crop: Column, has_place: Column, strict: Column) -> Column:
    return F.round(F.least(F.lit(0.3) + F.when(strict, 0.2).otherwise(0.0) + F.when(has_crop, 0.35).otherwise(0.0) + F.when(has_place, 0.15).otherwise(0.0), F.lit(1.0)), 2)


def extract(docs: DataFrame, table: str, key: str = "doc_id", text: str = "text", crops: str | None = None, terms: Sequence[str] = CROPS, zones: Sequence[str] = ZONES) -> DataFrame:
    """Facts of one table: key, pattern, crop, the table's own columns, raw_text, confidence and needs_review (below 0.7).

    ``crops`` names an array column with the crops the document is about. Missing values are ''.
    """
    return facts_of(matches(docs, PATTERNS[table], key, text, crops), table, key, terms, zones)


def facts_of(found: DataFrame, table: str, key: str = "doc_id", terms: Sequence[str] = CROPS, zones: Sequence[str] = ZONES) -> DataFrame:
    """The facts of one table from its ``matches``."""
    g = lambda i: F.coalesce(F.get("groups", F.lit(i)), F.lit(""))
    p = F.col("pattern")
    rows = computed(found, crop=nearest_crop(F.col("doc_crops"), terms))
    has_crop = F.col("crop") != ""
    yes, no = F.lit(True), F.lit(False)
    if table == "crop_calendar":
        rows = computed(rows, zone=first_place(zones), state=first_place(STATES))
        cols = {"zone": F.col("zone"), "state": F.col("state"), "activity": p, "month_start": F.initcap(g(0)), "month_end": F.initcap(g(1))}
        conf = confidence(has_crop, (F.col("zone") != "") | (F.col("state") != ""), yes)
    elif table == "spacing":
        cols = {"spacing_cm": F.when(p == "spacing_cm_x_cm", F.concat(g(0), F.lit("x"), g(1))).otherwise(""), "plants_per_ha": F.when(p == "plants_per_ha", F.replace(g(0), F.lit(","), F.lit(""))).otherwise(""), "row_spacing_cm": F.when(p == "row_spacing", g(0)).otherwise("")}
        conf = confidence(has_crop, no, yes)
    elif table == "fertilizer_rate":
        implied = F.create_map(*[F.lit(x) for kv in IMPLIED.items() for x in kv])
        rows = rows.withColumn("kind", F.when(F.size("groups") > 1, F.trim(g(1))).otherwise(F.coalesce(F.try_element_at(implied, p), F.lit(""))))
        cols = {"fertilizer_type": F.col("kind"), "rate_kg_ha": g(0), "application_stage": p}
        conf = confidence(has_crop, F.col("kind") != "", p != "bare_kg_ha")
    elif table == "agrochemical":
        units = F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv])
        named, interval = p == "product_rate", p.startswith("interval")
        cols = {"product_name": F.when(named, F.trim(g(0))).otherwise(""), "active_ingredient": F.lit(""), "rate": F.when(named, g(1)).when(interval, "").otherwise(g(0)), "rate_unit": F.when(named, F.concat(g(2), F.lit("/"), g(3))).otherwise(F.coalesce(F.try_element_at(units, p), F.lit(""))), "pre_harvest_interval_days": F.when(interval, g(0)).otherwise("")}
        conf = confidence(has_crop, no, yes) - F.when(p.isin(*LESS_SURE), 0.1).otherwise(0.0)
    elif table == "variety":
        named = F.array_compact(F.array(*[F.when(F.lower(g(0)).contains(z.lower()), F.lit(z)) for z in zones]))
        rows = rows.withColumn("zone", F.when(p == "recommended", F.coalesce(F.try_element_at(named, F.lit(1)), F.trim(g(0)))).otherwise(first_place(zones)))
        cols = {"variety_name": F.when(p == "released", g(0)).otherwise(""), "maturity_days": F.when(p == "maturity", F.when(g(1) != "", F.concat(g(0), F.lit("-"), g(1))).otherwise(g(0))).otherwise(""), "zone": F.col("zone")}
        conf = F.when(p == "recommended", confidence(has_crop, yes, no)).otherwise(confidence(has_crop, F.col("zone") != "", yes))
    elif table == "pest":
        rows = rows.withColumn("window", F.substring("around", F.col("at") + 1, F.lit(WINDOW)))
        rows = rows.withColumn("raw_text", F.replace(F.substring("window", 1, 300), F.lit("\n"), F.lit(" ")))
        cell = lambda regex: F.substring(F.replace(F.regexp_replace(F.regexp_extract("window", regex, 1), r"(?U)^\s+|\s+$", ""), F.lit("\n"), F.lit(" ")), 1, 400)
        stages = F.array_compact(F.array(*[F.when(F.lower("window").contains(s), F.lit(s)) for s in STAGES]))
        rows = computed(rows, **{name: cell(regex) for name, regex in SECTIONS.items()}, growth_stage=F.coalesce(F.try_element_at(stages, F.lit(1)), F.lit("")))
        cols = {"pest_name": F.trim(g(0)), **{c: F.col(c) for c in ("symptoms", "growth_stage", "cultural_control", "chemical_control")}}
        fields = sum((F.when(F.col(c) != "", 1).otherwise(0) for c in ("symptoms", "growth_stage", "cultural_control", "chemical_control")), F.lit(0))
        conf = F.round(F.least(F.lit(0.3) + 0.15 * fields + F.when(has_crop, 0.1).otherwise(0.0), F.lit(1.0)), 2)
    else:
        raise ValueError(f"no such table: {table}")
    out = rows.select(F.col("key").alias(key), "pattern", "start", "crop", *[c.alias(n) for n, c in cols.items()], "raw_text", conf.alias("confidence"))
    return out.withColumn("needs_review", F.col("confidence") < 0.7)


def fact_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", tables: Mapping[str, Sequence[tuple[str, str]]] = PATTERNS) -> DataFrame:
    """(key, fact_table, pattern, n): matches per document, of all tables in one pass over the texts. Counts need no offsets, so
    texts don't leave the JVM."""
    cells = [F.struct(F.lit(t).alias("fact_table"), F.lit(n).alias("pattern"), F.regexp_count(text, F.lit("(?U)" + p)).cast("long").alias("n")) for t, ps in tables.items() for n, p in ps]
    return spread(docs.select(key, text)).select(key, F.explode(F.filter(F.array(*cells), lambda x: x["n"] > 0)).alias("c")).select(key, "c.*")


def all_facts(docs: DataFrame, key: str = "doc_id", text: str = "text", crops: str | None = None, tables: Mapping[str, Sequence[tuple[str, str]]] = PATTERNS) -> DataFrame:
    """(key, fact_table, pattern, start, crop, confidence, needs_review, raw_text) of every table. The texts are matched once, whatever the
    number of tables."""
    named = [(f"{t}|{n}", p) for t, ps in tables.items() for n, p in ps]
    with scratch():
        found = cut(matches(docs, named, key, text, crops).withColumn("fact_table", F.split("pattern", r"\|")[0]).withColumn("pattern", F.split("pattern", r"\|")[1]))
        out = None
        for t in tables:
            part = facts_of(found.where(F.col("fact_table") == t), t, key).select(key, F.lit(t).alias("fact_table"), "pattern", "start", "crop", "confidence", "needs_review", "raw_text")
            out = part if out is None else out.unionByName(part)
        return cut(out, keep=True)


def confidence_histogram(facts: DataFrame) -> DataFrame:
    """One row per table: facts below 0.7, below 0.9, and the rest."""
    c = F.col("confidence")
    return facts.groupBy("fact_table").agg(F.count_if(c < 0.7).alias("low"), F.count_if((c >= 0.7) & (c < 0.9)).alias("mid"), F.count_if(c >= 0.9).alias("high"))
