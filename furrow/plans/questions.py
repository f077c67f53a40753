"""Question to answer as one plan: safety, then facts, retrieved passages, calculators or a refusal by tier."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.functions.text import normalise_query
from furrow.functions.vocabulary import CROPS
from furrow.operators.calculators import run_tools
from furrow.operators.plugins import embed_texts
from furrow.operators.vectors import route
from furrow.session import bounded, cut, scratch

# Questions the engine must not answer.
SAFETY = (
    r"(?i)\bfever\b|\bmedicine\b|\bdoctor\b|\bhospital\b|\bvet(erinary|erinarian)?\b"
    r"|\bmy (goat|cow|chicken|sheep|dog|cat|animal)s?\b.*\b(sick|ill|stopped eating|dying|medicine)\b"
    r"|\bpoison(ing|ed)?\b|\bstomach pain|\bbody pain|\bloan\b|\bbank\b.*\bloan\b|\binsurance\b|\bweather\b|\brain(fall)? forecast\b"
    r"|\bpolitical party\b|\belection\b|\blegal\b|\blawyer\b|\bland (dispute|ownership)\b|\bcontract\b"
)
REFUSAL = "This question is outside what can be answered here."
NO_FACT = "No structured database entry found for '%s' matching this question."
ASK_CALL = "Which calculation is needed, and with which values?"


def unsafe(text: Column) -> Column:
    """Whether the raw or the normalised question must be refused; the lexicon can hide words that the pattern looks for."""
    return F.coalesce(text.rlike(SAFETY) | normalise_query(text).rlike(SAFETY), F.lit(False))


def plain(question: Column, material: Column) -> Column:
    """The default generator: the material itself. Another takes the question and the material (facts, passages or a result) to a text."""
    return material


TASKS = {
    "A": "Answer from the facts below only. Change no number, and name the source of each fact.",
    "B": "Answer from the passages below, briefly. Name their sources in brackets, and say so if they do not hold the answer.",
    "C": "Put the result below into plain words. Keep every number and unit as it is.",
    "D": "Say politely that this cannot be answered here, and whom to ask instead.",
}


def prompt(tier: Column, question: Column, material: Column) -> Column:
    """The text a language model is given: the task of the tier, the material, and the question."""
    task = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in TASKS.items() for x in kv]), tier), F.lit(TASKS["D"]))
    return F.concat_ws("\n\n", task, material, F.concat(F.lit("Question: "), F.coalesce(question, F.lit(""))))


def route_questions(questions: DataFrame, centres: DataFrame, threshold: float, make_encoder: Callable, refuse=None, key: str = "id", text: str = "question") -> DataFrame:
    """(key, tier, confidence, margin, refused, reason) of question texts: normalised, encoded, and routed to the nearest centroid (tier,
    centroid). Unsafe questions are refused with the reason ``safety``."""
    rows = questions.select(key, F.col(text).alias("_raw"), normalise_query(text).alias("_q"))
    routed = route(embed_texts(rows, key, "_q", make_encoder), centres, threshold, refuse, key, label="tier")
    out = routed.join(rows.select(key, unsafe(F.col("_raw")).alias("_no")), key)
    return out.select(key, "tier", "confidence", "margin", (F.col("refused") | F.col("_no")).alias("refused"), F.when(F.col("_no"), "safety").otherwise(F.col("reason")).alias("reason"))


def question_crop(text: Column, crops: Sequence[str] = CROPS, default: str = "maize") -> Column:
    """The first crop of the list that is part of the question, whatever its case."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.coalesce(*[F.when(low.contains(c), F.lit(c)) for c in crops], F.lit(default))


def crop_facts(spacing: DataFrame, rates: DataFrame, pests: DataFrame, key: str = "doc_id", most: int = 3) -> DataFrame:
    """(crop, facts, source_ids): what is known of a crop, as text lines: all spacings, all fertiliser rates, then the first ``most`` pests with
    symptoms by document and place. Sources are distinct, in the order of the lines."""
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    one = spacing.select("crop", F.lit(0).alias("o"), F.row_number().over(Window.partitionBy("crop").orderBy("zone")).alias("n"), F.concat(F.lit("Spacing for "), "crop", F.lit(" ("), "zone", F.lit("): "), number("row_cm"), F.lit(" cm row x "), number("within_row_cm"), F.lit(" cm plant. Source: "), "source_id").alias("line"), "source_id")
    two = rates.select("crop", F.lit(1).alias("o"), F.col("id").alias("n"), F.concat(F.lit("Fertilizer rate for "), "crop", F.lit(" ("), "zone", F.lit("): N="), number("n_rate_kg_ha"), F.lit(" kg/ha, P2O5="), number("p2o5_rate_kg_ha"), F.lit(" kg/ha, K2O="), number("k2o_rate_kg_ha"), F.lit(" kg/ha. Source: "), "source_id").alias("line"), "source_id")
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    # the window keeps the first few of each task before the shuffle
    first = pests.where("crop <> '' and symptoms <> ''").withColumn("n", F.row_number().over(Window.partitionBy("crop").orderBy(key, "start"))).where(F.col("n") <= most)
    three = first.select(
        "crop", F.lit(2).alias("o"), "n",
        F.concat(F.coalesce(some("pest_name"), F.lit("Pest")), F.lit(" on "), "crop", F.lit(": "), "symptoms", F.lit(". Control: "), F.coalesce(some("chemical_control"), some("cultural_control"), F.lit("Standard management")), F.lit(". Source: "), F.col(key).cast("string")).alias("line"),
        F.col(key).cast("string").alias("source_id"),
    )
    lines = one.unionByName(two).unionByName(three)
    per = lines.groupBy("crop").agg(F.array_sort(F.collect_list(F.struct("o", "n", "line", "source_id"))).alias("xs"))
    return per.select("crop", F.array_join(F.transform("xs", lambda x: x["line"]), "\n").alias("facts"), F.array_distinct(F.filter(F.transform("xs", lambda x: x["source_id"]), lambda s: s != "")).alias("source_ids"))


def answer(questions: DataFrame, facts: DataFrame, passages: Callable[[DataFrame], DataFrame], tables: Callable[[str], DataFrame], calls: DataFrame, key: str = "id", text: str = "question", tier: str = "routed_tier", generator: Callable[[Column, Column], Column] = plain) -> DataFrame:
    """(key, tier, refused, answer, source_ids) of every question, by tier, in one plan.

    Unsafe questions, and those of tier D or no known tier, are refused. Tier A gets the facts of its crop (``crop_facts``); tier B the context
    that ``passages`` packs for its questions (query_id, query), as (query_id, context, source_ids); tier C the result of its tool call: ``calls``
    (key, call) are parsed replies, which pass the gate and run on the reference ``tables``, or are answered with the gate's message, the
    reply's own error, or a request to state the calculation. A null question is refused.
    """
    with scratch():
        rows = cut(questions.select(F.col(key).alias("id"), F.col(text).alias("question"), F.coalesce(F.col(tier), F.lit("D")).alias("tier")).withColumn("refused", unsafe(F.col("question")) | F.col("question").isNull() | ~F.col("tier").isin("A", "B", "C")))
        none = F.array().cast("array<string>")
        of = lambda t: rows.where((F.col("tier") == t) & ~F.col("refused"))
        d = rows.where("refused").select("id", "tier", "refused", F.lit(REFUSAL).alias("answer"), none.alias("source_ids"))
        known = bounded(cut(facts.select(F.col("crop").alias("_crop"), "facts", F.col("source_ids").alias("_src"))))
        asked = of("A").withColumn("crop", question_crop(F.col("question")))
        told = F.coalesce("facts", F.format_string(NO_FACT, F.col("crop")))
        a = asked.join(known, F.col("crop") == F.col("_crop"), "left").select("id", "tier", "refused", generator(F.col("question"), told).alias("answer"), F.coalesce("_src", none).alias("source_ids"))
        context = passages(of("B").select(F.col("id").alias("query_id"), F.col("question").alias("query")))
        b = of("B").join(context.withColumnRenamed("query_id", "id"), "id").select("id", "tier", "refused", generator(F.col("question"), F.col("context")).alias("answer"), "source_ids")
        ready = of("C").join(calls.select(F.col(key).alias("_id"), "call"), F.col("id") == F.col("_id"), "left").select("id", "question", "tier", "refused", "call")
        ran = run_tools(ready.select("id", "call"), tables)
        said = F.coalesce("result", "error_message", F.lit(ASK_CALL))
        c = of("C").join(ran, "id").select("id", "tier", "refused", generator(F.col("question"), said).alias("answer"), "source_ids")
        return cut(d.unionByName(a).unionByName(b).unionByName(c).withColumnRenamed("id", key), keep=True)
