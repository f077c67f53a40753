"""Deterministic farm calculators over request tables.

Errors are data: every result has ``error_type`` (InvalidInput or MissingConstant, the first that applies) and null values otherwise.
Reference tables are small configuration tables passed as arguments.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.functions.text import tag_terms
from furrow.functions.vocabulary import CROPS, ZONES
from furrow.session import bounded, computed, cut, scratch

# Products, planting material, rates, splits, spacings and agrochemicals.
SEEDS: dict[str, tuple[str, list[tuple]]] = {
    "calc_product": ("product_name string, n_pct double, p2o5_pct double, k2o_pct double, bag_weight_kg double, source_id string", [
        ("NPK 15-15-15", 15.0, 15.0, 15.0, 50.0, "naerls_maize_2021_p14"), ("Urea", 46.0, 0.0, 0.0, 50.0, "naerls_maize_2021_p14"), ("MOP", 0.0, 0.0, 60.0, 50.0, "naerls_maize_2021_p14"), ("SSP", 0.0, 18.0, 0.0, 50.0, "naerls_maize_2021_p14"),
    ]),
    "calc_planting_material": ("crop string, material_type string, unit_weight_g double, stands_per_unit int, units_per_bundle int, source_id string", [
        ("maize", "seed", 250.0, 1, None, "naerls_maize_2021_p14"), ("cassava", "cutting", None, 1, 50, "cgspace:95a959a1-3344-488c-b0a6-5d2994ed25f2"), ("yam", "sett", None, 1, None, "cgspace:10568/80404"), ("cowpea", "seed", 150.0, 1, None, "cgspace:94bed861-c0a2-4073-a9cf-1909836782d4"), ("tomato", "seed", 3.0, 1, None, "tomato_sudan_2020"), ("rice", "seed", 30.0, 1, None, "cgspace:10568/108804"),
    ]),
    "calc_fertilizer_rate": ("id int, crop string, zone string, soil_class string, target_yield double, n_rate_kg_ha double, p2o5_rate_kg_ha double, k2o_rate_kg_ha double, source_id string", [
        (1, "maize", "Northern Guinea Savanna", None, None, 120.0, 60.0, 60.0, "naerls_maize_2021_p14"), (2, "tomato", "Sudan Savanna", None, None, 100.0, 50.0, 80.0, "tomato_sudan_2020"), (3, "cassava", "Southern Guinea Savanna", None, None, 90.0, 30.0, 90.0, "cgspace:95a959a1-3344-488c-b0a6-5d2994ed25f2"),
        (4, "yam", "Southern Guinea Savanna", None, None, 90.0, 50.0, 75.0, "cgspace:10568/80404"), (5, "cowpea", "Northern Guinea Savanna", None, None, 20.0, 40.0, 20.0, "cgspace:94bed861-c0a2-4073-a9cf-1909836782d4"), (6, "rice", "Sudan Savanna", None, None, 80.0, 40.0, 40.0, "cgspace:10568/108804"),
    ]),
    "calc_fertilizer_split": ("fertilizer_rate_id int, split_number int, timing string, product_name string, basis_nutrient string, split_fraction double, source_id string", [
        (1, 1, "basal (at planting)", "NPK 15-15-15", "P2O5", 1.0, "naerls_maize_2021_p14"), (1, 2, "top-dress (6 WAP)", "Urea", "N", 1.0, "naerls_maize_2021_p14"), (2, 1, "basal", "NPK 15-15-15", "P2O5", 1.0, "tomato_sudan_2020"),
        (3, 1, "basal (at planting)", "NPK 15-15-15", "P2O5", 1.0, "cgspace:95a959a1-3344-488c-b0a6-5d2994ed25f2"), (3, 2, "top-dress (8 WAP)", "Urea", "N", 1.0, "cgspace:95a959a1-3344-488c-b0a6-5d2994ed25f2"), (3, 3, "top-dress (8 WAP)", "MOP", "K2O", 1.0, "cgspace:95a959a1-3344-488c-b0a6-5d2994ed25f2"),
        (4, 1, "basal", "NPK 15-15-15", "P2O5", 1.0, "cgspace:10568/80404"), (4, 2, "top-dress", "Urea", "N", 1.0, "cgspace:10568/80404"), (4, 3, "top-dress", "MOP", "K2O", 1.0, "cgspace:10568/80404"), (5, 1, "basal", "NPK 15-15-15", "P2O5", 1.0, "cgspace:94bed861-c0a2-4073-a9cf-1909836782d4"),
        (6, 1, "basal", "NPK 15-15-15", "P2O5", 1.0, "cgspace:10568/108804"), (6, 2, "top-dress", "Urea", "N", 1.0, "cgspace:10568/108804"),
    ]),
    "calc_spacing": ("crop string, zone string, row_cm double, within_row_cm double, source_id string", [
        ("maize", "Northern Guinea Savanna", 75.0, 25.0, "naerls_maize_2021_p14"), ("cassava", "Southern Guinea Savanna", 100.0, 100.0, "cgspace:95a959a1-3344-488c-b0a6-5d2994ed25f2"), ("yam", "Southern Guinea Savanna", 100.0, 100.0, "cgspace:10568/80404"), ("cowpea", "Northern Guinea Savanna", 75.0, 20.0, "cgspace:94bed861-c0a2-4073-a9cf-1909836782d4"), ("rice", "Sudan Savanna", 30.0, 15.0, "cgspace:10568/108804"), ("tomato", "Sudan Savanna", 60.0, 50.0, "tomato_sudan_2020"),
    ]),
    "calc_agrochemical": ("id int, product_name string, crop string, rate_per_ha double, rate_unit string, pre_harvest_interval_days int, source_id string", [
        (1, "Glyphosate", None, 4.0, "l", 30, "nafdac_agrochemicals_2020"), (2, "Paraquat", "maize", 3.0, "l", 45, "nafdac_agrochemicals_2020"), (3, "Mancozeb", "tomato", 1.5, "kg", 7, "nafdac_agrochemicals_2020"), (4, "Atrazine", "maize", 4.0, "l", 60, "nafdac_agrochemicals_2020"),
        (5, "Cypermethrin", "cowpea", 1.0, "l", 14, "nafdac_agrochemicals_2020"), (6, "Glyphosate", "cassava", 4.0, "l", 30, "nafdac_agrochemicals_2020"), (7, "Mancozeb", "yam", 1.5, "kg", 7, "nafdac_agrochemicals_2020"), (8, "Butachlor", "rice", 4.0, "l", 21, "nafdac_agrochemicals_2020"),
    ]),
}


def seed_table(spark: SparkSession, name: str, extra: Sequence[tuple] = ()) -> DataFrame:
    schema, rows = SEEDS[name]
    return spark.createDataFrame([*rows, *extra], schema)


def whole_up(x: Column) -> Column:
    """Up to the next whole number, ignoring noise beyond nine places."""
    return F.ceil(F.round(x, 9)).cast("long")


def half_up(x: Column, places: int = 2) -> Column:
    return F.round(F.round(x, 9), places)


def best_rates(requests: DataFrame, rates: DataFrame) -> DataFrame:
    """Adds ``rate`` (the best rate row or null), ``matched_exactly`` and ``error_type`` to requests (request_id, crop, zone, area_ha, soil_class,
    target_yield).

    Candidates of the crop and zone are ordered by soil penalty (equal 0, unspecified 1, other 2; without a wish 0 or 1), by
    distance of the yield (unspecified last; without a wish 0 or 1), and by id.
    """
    few = bounded(rates.groupBy(F.col("crop").alias("_c"), F.col("zone").alias("_z")).agg(F.collect_list(F.struct(*rates.columns)).alias("_rates")))
    soil, wish = F.col("soil_class"), F.col("target_yield")

    def penalties(r: Column) -> Column:
        p1 = F.when(soil.isNotNull(), F.when(r["soil_class"] == soil, 0).when(r["soil_class"].isNull(), 1).otherwise(2)).otherwise(F.when(r["soil_class"].isNull(), 0).otherwise(1))
        p2 = F.when(wish.isNotNull(), F.coalesce(F.abs(r["target_yield"] - wish), F.lit(1e9))).otherwise(F.when(r["target_yield"].isNull(), 0.0).otherwise(1.0))
        return F.struct(p1.alias("a"), p2.alias("b"), r["id"].alias("c"), r.alias("rate"))

    keys = requests.columns
    known = bounded(rates.select(F.col("crop").alias("_k")).distinct())
    joined = requests.join(few, (F.col("crop") == F.col("_c")) & (F.col("zone") == F.col("_z")), "left").join(known, F.col("crop") == F.col("_k"), "left")
    out = joined.withColumn("_p", F.array_min(F.transform("_rates", penalties))).withColumn("rate", F.col("_p.rate"))
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    error = F.when(blank("crop") | blank("zone") | F.coalesce(F.col("area_ha") <= 0, F.lit(True)), "InvalidInput").when(F.col("_k").isNull() | F.col("rate").isNull(), "MissingConstant")
    return out.select(*keys, "rate", F.when(F.col("rate").isNotNull(), (F.col("_p.a") == 0) & (F.col("_p.b") == 0)).alias("matched_exactly"), error.alias("error_type"))


def fertiliser_plan(requests: DataFrame, rates: DataFrame, splits: DataFrame, products: DataFrame) -> DataFrame:
    """(request_id, error_type, matched_exactly, n_kg, p2o5_kg, k2o_kg, n_open, p2o5_open, k2o_open, applications, source_ids): splits in order, each
    covering what earlier ones left of its nutrient. An ordered fold over the request's few splits."""
    best = best_rates(requests, rates)
    prod = products.select(F.col("product_name").alias("_p"), F.col("source_id").alias("product_source"), "n_pct", "p2o5_pct", "k2o_pct", F.coalesce(F.nullif("bag_weight_kg", F.lit(0.0)), F.lit(50.0)).alias("bag"))
    recipe = splits.join(bounded(prod), F.col("product_name") == F.col("_p"), "left").groupBy("fertilizer_rate_id").agg(
        F.array_sort(F.collect_list(F.struct("split_number", "timing", "product_name", "basis_nutrient", "split_fraction", "n_pct", "p2o5_pct", "k2o_pct", "bag", F.col("_p").isNotNull().alias("known"), "source_id", "product_source"))).alias("steps")
    )
    rows = best.join(bounded(recipe), F.col("rate.id") == F.col("fertilizer_rate_id"), "left").withColumn("steps", F.coalesce("steps", F.array()))
    zero = F.lit(0.0)
    app = "array<struct<timing:string,product_name:string,product_kg:double,bags:bigint,bags_exact:double>>"
    start = F.struct(F.col("rate.n_rate_kg_ha").alias("rn"), F.col("rate.p2o5_rate_kg_ha").alias("rp"), F.col("rate.k2o_rate_kg_ha").alias("rk"), zero.alias("sn"), zero.alias("sp"), zero.alias("sk"), F.array().cast(app).alias("apps"), F.lit(None).cast("string").alias("err"))

    def step(acc, s):
        basis = s["basis_nutrient"]
        target = F.greatest(zero, F.when(basis == "N", acc["rn"]).when(basis == "P2O5", acc["rp"]).when(basis == "K2O", acc["rk"]))
        pct = F.when(basis == "N", s["n_pct"]).when(basis == "P2O5", s["p2o5_pct"]).when(basis == "K2O", s["k2o_pct"])
        err = F.coalesce(acc["err"], F.when(~s["known"], "MissingConstant").when(~basis.isin("N", "P2O5", "K2O"), "InvalidInput").when(pct <= 0, "MissingConstant"))
        per_ha = target * s["split_fraction"] / (F.nullif(pct, zero) / 100)
        total = per_ha * F.col("area_ha")
        n, p, k = per_ha * (s["n_pct"] / 100), per_ha * (s["p2o5_pct"] / 100), per_ha * (s["k2o_pct"] / 100)
        one = F.struct(s["timing"].alias("timing"), s["product_name"].alias("product_name"), half_up(total).alias("product_kg"), whole_up(total / s["bag"]).alias("bags"), (total / s["bag"]).alias("bags_exact"))
        return F.struct((acc["rn"] - n).alias("rn"), (acc["rp"] - p).alias("rp"), (acc["rk"] - k).alias("rk"), (acc["sn"] + n * F.col("area_ha")).alias("sn"), (acc["sp"] + p * F.col("area_ha")).alias("sp"), (acc["sk"] + k * F.col("area_ha")).alias("sk"), F.concat(acc["apps"], F.array(one)).alias("apps"), err.alias("err"))

    done = computed(rows, f=F.aggregate("steps", start, step))
    error = F.coalesce("error_type", "f.err")
    # of the rate, and of each split and its product in order
    named = F.concat(F.array("rate.source_id"), F.flatten(F.transform("steps", lambda x: F.array(x["source_id"], x["product_source"]))))
    sources = F.array_distinct(F.filter(named, lambda x: F.coalesce(x, F.lit("")) != ""))
    ok = lambda c: F.when(error.isNull(), c)
    return done.select(
        "request_id", error.alias("error_type"), ok(F.col("matched_exactly")).alias("matched_exactly"), *[ok(half_up(F.col(f"f.s{x}"))).alias(f"{n}_kg") for x, n in (("n", "n"), ("p", "p2o5"), ("k", "k2o"))],
        *[ok(half_up(F.col(f"rate.{n}_rate_kg_ha") * F.col("area_ha") - F.col(f"f.s{x}"))).alias(f"{n}_open") for x, n in (("n", "n"), ("p", "p2o5"), ("k", "k2o"))], ok(F.col("f.apps")).alias("applications"), ok(sources).alias("source_ids"),
    )


def seed_rate(requests: DataFrame, material: DataFrame) -> DataFrame:
    """(request_id, error_type, population, seed_kg, units, bundles) for requests (request_id, crop, area_ha, row_cm, within_row_cm,
    germination_pct, seeds_per_stand). Seed is divided by germination; cuttings and setts are not."""
    m = bounded(material.groupBy(F.col("crop").alias("_c")).agg(F.min_by(F.struct("material_type", "unit_weight_g", "stands_per_unit", "units_per_bundle"), "material_type").alias("m")))
    rows = requests.join(m, F.col("crop") == F.col("_c"), "left")
    bad = lambda c: F.coalesce(c, F.lit(True))
    kind = F.col("m.material_type")
    error = (
        F.when((F.trim(F.coalesce("crop", F.lit(""))) == "") | bad(F.col("area_ha") <= 0) | bad(F.col("row_cm") <= 0) | bad(F.col("within_row_cm") <= 0) | bad((F.col("germination_pct") <= 0) | (F.col("germination_pct") > 100)) | bad(F.col("seeds_per_stand") <= 0), "InvalidInput")
        .when(F.col("m").isNull() | ((kind == "seed") & bad(F.col("m.unit_weight_g") <= 0)) | ~kind.isin("seed", "cutting", "sett"), "MissingConstant")
    )
    ok = lambda c: F.when(error.isNull(), c)
    safe = lambda c: F.nullif(F.col(c).cast("double"), F.lit(0.0))
    population = F.lit(10000.0) / ((safe("row_cm") / 100.0) * (safe("within_row_cm") / 100.0)) * F.col("area_ha")
    # unit_weight_g is the weight of a thousand seeds; stands_per_unit counts the pieces of a stand
    kg = population * F.col("seeds_per_stand") / (safe("germination_pct") / 100.0) * (F.col("m.unit_weight_g") / 1000000.0)
    pieces = population * F.coalesce(F.nullif(F.col("m.stands_per_unit"), F.lit(0)), F.lit(1))
    units = whole_up(pieces)
    bundles = F.when(F.col("m.units_per_bundle") > 0, whole_up(pieces / F.col("m.units_per_bundle")))
    return rows.select("request_id", error.alias("error_type"), ok(population).alias("population"), ok(F.when(kind == "seed", half_up(kg))).alias("seed_kg"), ok(F.when(kind != "seed", units)).alias("units"), ok(F.when(kind != "seed", bundles)).alias("bundles"))


def spray_dilution(requests: DataFrame, chemicals: DataFrame) -> DataFrame:
    """(request_id, error_type, amount, unit, interval_days, match_kind) for requests (request_id, product_name, crop, tank_litres,
    rate_per_ha, spray_volume_l_per_ha). The row for the crop comes before one without crop, that before any other."""
    few = bounded(chemicals.groupBy(F.col("product_name").alias("_p")).agg(F.collect_list(F.struct(*chemicals.columns)).alias("_rows")))
    pref = lambda r: F.when(r["crop"] == F.col("crop"), 0).when(F.coalesce(r["crop"], F.lit("")) == "", 1).otherwise(2)
    best = requests.join(few, F.col("product_name") == F.col("_p"), "left").withColumn("_o", F.array_min(F.transform("_rows", lambda r: F.struct(pref(r).alias("p"), r["id"].alias("i"), r.alias("chem")))))
    best = best.withColumn("chem", F.col("_o.chem")).withColumn("pref", F.col("_o.p"))
    bad = lambda x: F.coalesce(x, F.lit(True))
    error = F.when((F.trim(F.coalesce("product_name", F.lit(""))) == "") | bad(F.col("tank_litres") <= 0) | bad(F.col("spray_volume_l_per_ha") <= 0) | F.coalesce(F.col("rate_per_ha") <= 0, F.lit(False)), "InvalidInput").when(F.col("chem").isNull(), "MissingConstant")
    rate = F.coalesce(F.col("rate_per_ha"), F.col("chem.rate_per_ha"))
    unit = F.lower("chem.rate_unit")
    scale = F.when(unit.isin("kg", "l", "litre", "litres"), 1000.0).otherwise(1.0)
    amount = half_up(rate * scale * F.col("tank_litres") / F.nullif(F.col("spray_volume_l_per_ha"), F.lit(0.0)), 0)
    ok = lambda x: F.when(error.isNull(), x)
    return best.select(
        "request_id", error.alias("error_type"), ok(amount).alias("amount"), ok(F.when(unit == "kg", "g").when(unit.isin("l", "litre", "litres"), "ml").otherwise(unit)).alias("unit"), ok(F.col("chem.pre_harvest_interval_days")).alias("interval_days"),
        ok(F.when(F.col("pref") == 0, "crop").when(F.col("pref") == 1, "generic").otherwise("other")).alias("match_kind"),
    )


def gross_margin(requests: DataFrame) -> DataFrame:
    """(request_id, error_type, revenue, total_cost, margin) for requests (request_id, yield_kg, price_per_kg, costs array<double>); each value is
    rounded on its own. No costs are zero costs."""
    cost = F.aggregate(F.coalesce("costs", F.array().cast("array<double>")), F.lit(0.0), lambda s, x: s + x)
    revenue = F.col("yield_kg") * F.col("price_per_kg")
    negative = F.exists(F.coalesce("costs", F.array().cast("array<double>")), lambda x: x.isNull() | (x < 0))
    error = F.when(F.coalesce(F.col("yield_kg") < 0, F.lit(True)) | F.coalesce(F.col("price_per_kg") < 0, F.lit(True)) | negative, "InvalidInput")
    ok = lambda x: F.when(error.isNull(), half_up(x, 0))
    return requests.select("request_id", error.alias("error_type"), ok(revenue).alias("revenue"), ok(cost).alias("total_cost"), ok(revenue - cost).alias("margin"))


def parse_tool_call(text: Column) -> Column:
    """The JSON object of a reply as a variant: code fences are dropped, else the part from the first to the last brace; null if neither is an
    object."""
    bare = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"```[a-zA-Z]*", ""))
    whole = F.when(bare.startswith("{"), F.try_parse_json(bare))
    return F.coalesce(whole, F.try_parse_json(F.regexp_extract(bare, r"(?s)\{.*\}", 0)))


def call_from_question(question: Column, zones: Sequence[str] = ZONES, crops: Sequence[str] = CROPS) -> Column:
    """A tool call read from a question by rule, as a variant: the calculation it asks for and the values it states; null if it asks for none.
    Values that are not stated are left out, so the gate says what is missing."""
    q = F.lower(F.coalesce(question, F.lit("")))
    number = lambda pattern, i=1: F.nullif(F.regexp_extract(q, pattern, i), F.lit("")).try_cast("double")
    crop = F.try_element_at(tag_terms(q, crops), F.lit(1))
    area = number(r"(\d+(?:\.\d+)?) ?(?:ha|hectares?)\b")
    row, within = number(r"(\d+(?:\.\d+)?) ?x ?(\d+(?:\.\d+)?) ?cm", 1), number(r"(\d+(?:\.\d+)?) ?x ?(\d+(?:\.\d+)?) ?cm", 2)
    zone = F.try_element_at(tag_terms(q, zones), F.lit(1))
    product = F.nullif(F.regexp_extract(F.coalesce(question, F.lit("")), r"(?i)\bspray\b.* with ([^?.]+)", 1), F.lit(""))
    call = lambda f, **params: F.to_json(F.struct(F.lit(f).alias("function"), F.struct(*[v.alias(k) for k, v in params.items()]).alias("params")))
    made = (
        F.when(q.contains("seed"), call("seed_rate", crop=crop, area_ha=area, spacing_cm=F.when(row.isNotNull(), F.array(row, within)), germination_pct=number(r"(\d+(?:\.\d+)?) ?(?:%|percent)")))
        .when(q.contains("spray"), call("spray_dilution", product_name=product, crop=crop, tank_litres=number(r"(\d+(?:\.\d+)?) ?(?:l|litres?)\b")))
        .when(q.contains("margin"), call("gross_margin", yield_kg=number(r"(\d+(?:\.\d+)?) ?kg\b"), price_per_kg=number(r"(\d+(?:\.\d+)?) naira (?:per|a) kg")))
        .when(q.rlike("fertili[sz]er|bags of|urea|npk"), call("fertiliser_rate", crop=crop, area_ha=area, zone=zone))
    )
    return F.try_parse_json(made)


# The crops the gate knows, and what it answers.
GATE_CROPS = ["cassava", "cowpea", "maize", "rice", "tomato", "yam"]
MESSAGES = {
    "fertiliser_missing": "I need the crop, area in hectares, and the agro-ecological zone to calculate the fertilizer rate.",
    "seed_missing": "I need the crop, area in hectares, row & within-row spacing in cm, and expected germination percentage.",
    "spray_missing": "I need the product name and tank volume in litres to calculate the spray dilution.",
    "margin_missing": "I need the yield in kg, price per kg, and list of input costs to calculate the gross margin.",
    "crop": "The crop '%s' is not supported. Supported crops are: cassava, cowpea, maize, rice, tomato, yam.",
    "area_low": "Area must be greater than zero.",
    "area_bad": "Area must be a valid number.",
    "spacing_list": "Spacing must be a list of two positive numbers (e.g. [75, 25]).",
    "spacing_low": "Spacing values must be greater than zero.",
    "spacing_bad": "Spacing must contain valid numbers.",
    "germination_range": "Germination percentage must be between 0 and 100.",
    "germination_bad": "Germination percentage must be a valid number.",
    "tank_low": "Tank volume must be greater than zero.",
    "tank_bad": "Tank volume must be a valid number.",
    "rate_low": "Chemical rate per hectare must be greater than zero.",
    "rate_bad": "Rate per hectare must be a valid number.",
    "spray_low": "Spray volume per hectare must be greater than zero.",
    "yield_low": "Yield cannot be negative.",
    "yield_bad": "Yield must be a valid number.",
    "price_low": "Price per kg cannot be negative.",
    "price_bad": "Price per kg must be a valid number.",
    "costs_list": "Input costs must be a list of objects with a label and amount.",
    "costs_keys": "Each input cost must have a label and an amount.",
    "cost_low": "Cost amount for '%s' cannot be negative.",
    "cost_bad": "Cost amount for '%s' must be a valid number.",
    "unknown": "Unknown function name '%s'.",
    "no_rate": "No fertilizer recommendation found for crop '%s'",
    "no_zone": "No fertilizer recommendation found for crop '%s' in zone '%s'",
    "no_material": "No planting material record found for crop '%s'",
    "no_chemical": "No agrochemical record found for product '%s'",
    "invalid": "Invalid input.",
    "missing": "A constant is missing.",
}


def _say(name: str, *parts: Column) -> Column:
    """The message with its gaps filled."""
    return F.format_string(MESSAGES[name], *parts) if parts else F.lit(MESSAGES[name])


def tool_errors(calls: DataFrame, call: str = "call") -> DataFrame:
    """Adds ``function`` and ``error_message`` (null if the call may run) to parsed calls; errors are data, and the first that applies counts.

    A call that is null or names no function has its own ``error`` as message, or none with a null function: it is a direct answer.
    Numbers may be written as text. Crops are compared in lower case without outer blanks.
    """
    text = lambda path: F.try_variant_get(F.col(call), f"$.{path}", "string")
    has = lambda name: text(f"params.{name}").isNotNull() | listed(name).isNotNull()
    listed = lambda name: F.try_variant_get(F.col(call), f"$.params.{name}", "array<variant>")
    num = lambda name: F.trim(text(f"params.{name}")).try_cast("double")
    given = lambda name: F.coalesce(text(f"params.{name}"), F.lit("")) != ""
    crop = text("params.crop")
    crop_error = F.when(~F.lower(F.trim(crop)).isin(*GATE_CROPS), _say("crop", crop))
    low = lambda name, bad, least: F.when(num(name).isNull(), F.lit(MESSAGES[bad])).when(num(name) <= 0, F.lit(MESSAGES[least]))
    negative = lambda name, bad, least: F.when(num(name).isNull(), F.lit(MESSAGES[bad])).when(num(name) < 0, F.lit(MESSAGES[least]))
    area = low("area_ha", "area_bad", "area_low")
    pair = F.transform(listed("spacing_cm"), lambda v: F.try_variant_get(v, "$", "string").try_cast("double"))
    spacing = (
        F.when(listed("spacing_cm").isNull() | (F.size(listed("spacing_cm")) != 2), MESSAGES["spacing_list"]).when(F.exists(pair, lambda x: x.isNull()), MESSAGES["spacing_bad"])
        .when(F.exists(pair, lambda x: x <= 0), MESSAGES["spacing_low"])
    )
    pct = num("germination_pct")
    germination = F.when(pct.isNull(), MESSAGES["germination_bad"]).when((pct <= 0) | (pct > 100), MESSAGES["germination_range"])
    rate = F.when(has("rate_per_ha"), low("rate_per_ha", "rate_bad", "rate_low"))
    spray = F.when(num("spray_volume_l_per_ha") <= 0, MESSAGES["spray_low"])
    label, amount = lambda v: F.try_variant_get(v, "$.label", "string"), lambda v: F.try_variant_get(v, "$.amount", "string")
    cost = lambda v: (
        F.when(label(v).isNull() | amount(v).isNull(), MESSAGES["costs_keys"]).when(amount(v).try_cast("double").isNull(), _say("cost_bad", label(v))).when(amount(v).try_cast("double") < 0, _say("cost_low", label(v)))
    )
    costs = F.when(listed("input_costs").isNull(), MESSAGES["costs_list"]).otherwise(F.try_element_at(F.filter(F.transform(listed("input_costs"), cost), lambda x: x.isNotNull()), F.lit(1)))
    f = text("function")
    error = (
        F.when(f.isNull(), text("error"))
        .when(f == "fertiliser_rate", F.when(~given("crop") | ~given("zone") | ~has("area_ha"), MESSAGES["fertiliser_missing"]).otherwise(F.coalesce(crop_error, area)))
        .when(f == "seed_rate", F.when(~given("crop") | ~has("area_ha") | ~has("spacing_cm") | ~has("germination_pct"), MESSAGES["seed_missing"]).otherwise(F.coalesce(crop_error, area, spacing, germination)))
        .when(f == "spray_dilution", F.when(~given("product_name") | ~has("tank_litres"), MESSAGES["spray_missing"]).otherwise(F.coalesce(low("tank_litres", "tank_bad", "tank_low"), rate, spray)))
        .when(f == "gross_margin", F.when(~has("yield_kg") | ~has("price_per_kg") | ~has("input_costs"), MESSAGES["margin_missing"]).otherwise(F.coalesce(negative("yield_kg", "yield_bad", "yield_low"), negative("price_per_kg", "price_bad", "price_low"), costs)))
        .otherwise(_say("unknown", f))
    )
    return calls.withColumn("function", f).withColumn("error_message", error)


def run_tools(calls: DataFrame, tables: Callable[[str], DataFrame], key: str = "id", call: str = "call") -> DataFrame:
    """(key, function, error_message, result, source_ids): parsed calls through the gate and, where it lets them pass, through their
    calculator. ``result`` is a JSON object; ``tables`` gives a reference table by its name. Calls without function have null for it."""
    with scratch():
        gated = cut(tool_errors(calls, call))
        text = lambda path: F.try_variant_get(F.col(call), f"$.params.{path}", "string")
        num = lambda name: F.trim(text(name)).try_cast("double")
        crop = F.lower(F.trim(text("crop")))
        ready = lambda f: gated.where((F.col("function") == f) & F.col("error_message").isNull())
        rid = F.col(key).alias("request_id")
        none = F.array().cast("array<string>")

        def done(out: DataFrame, f: str, fields: Sequence[str], invalid: Column, missing: Column, sources: Column) -> DataFrame:
            error = F.when(F.col("error_type") == "InvalidInput", invalid).when(F.col("error_type") == "MissingConstant", missing)
            whole = F.when(F.col("error_type").isNull(), F.to_json(F.struct(*fields)))
            return out.select(F.col("request_id").alias(key), F.lit(f).alias("function"), error.alias("error_message"), whole.alias("result"), F.when(F.col("error_type").isNull(), sources).otherwise(none).alias("source_ids"))

        invalid, missing = F.lit(MESSAGES["invalid"]), F.lit(MESSAGES["missing"])
        fert = ready("fertiliser_rate").select(rid, crop.alias("crop"), F.trim(text("zone")).alias("zone"), num("area_ha").alias("area_ha"), text("soil_class").alias("soil_class"), num("target_yield").alias("target_yield"))
        rates = tables("calc_fertilizer_rate")
        known = bounded(rates.select(F.col("crop").alias("_kc")).distinct())
        where = bounded(rates.groupBy(F.col("crop").alias("_kc"), F.col("zone").alias("_kz")).agg(F.array_sort(F.collect_set("source_id")).alias("_src")))
        plan = fertiliser_plan(fert, rates, tables("calc_fertilizer_split"), tables("calc_product")).join(fert.select("request_id", "crop", "zone"), "request_id")
        plan = plan.join(known.withColumn("_is", F.lit(True)), F.col("crop") == F.col("_kc"), "left").drop("_kc").join(where, (F.col("crop") == F.col("_kc")) & (F.col("zone") == F.col("_kz")), "left")
        absent = F.when(F.col("_is").isNull(), _say("no_rate", F.col("crop"))).when(F.col("_src").isNull(), _say("no_zone", F.col("crop"), F.col("zone"))).otherwise(missing)
        a = done(plan, "fertiliser_rate", ["n_kg", "p2o5_kg", "k2o_kg", "n_open", "p2o5_open", "k2o_open", "applications", "matched_exactly"], invalid, absent, F.coalesce("source_ids", none))
        pair = F.transform(F.try_variant_get(F.col(call), "$.params.spacing_cm", "array<variant>"), lambda v: F.try_variant_get(v, "$", "string").try_cast("double"))
        seed = ready("seed_rate").select(rid, crop.alias("crop"), num("area_ha").alias("area_ha"), pair[0].alias("row_cm"), pair[1].alias("within_row_cm"), num("germination_pct").alias("germination_pct"), F.coalesce(num("seeds_per_stand").cast("int"), F.lit(1)).alias("seeds_per_stand"))
        material = tables("calc_planting_material")
        origin = bounded(material.groupBy(F.col("crop").alias("_kc")).agg(F.array_sort(F.collect_set("source_id")).alias("_src")))
        sown = seed_rate(seed, material).join(seed.select("request_id", "crop"), "request_id").join(origin, F.col("crop") == F.col("_kc"), "left")
        b = done(sown, "seed_rate", ["population", "seed_kg", "units", "bundles"], invalid, F.when(F.col("_src").isNull(), _say("no_material", F.col("crop"))).otherwise(missing), F.coalesce("_src", none))
        spray = ready("spray_dilution").select(rid, F.trim(text("product_name")).alias("product_name"), F.lower(F.trim(text("crop"))).alias("crop"), num("tank_litres").alias("tank_litres"), num("rate_per_ha").alias("rate_per_ha"), F.coalesce(num("spray_volume_l_per_ha"), F.lit(200.0)).alias("spray_volume_l_per_ha"))
        chemicals = tables("calc_agrochemical")
        origin = bounded(chemicals.groupBy(F.col("product_name").alias("_kp")).agg(F.array_sort(F.collect_set("source_id")).alias("_src")))
        mixed = spray_dilution(spray, chemicals).join(spray.select("request_id", "product_name"), "request_id").join(origin, F.col("product_name") == F.col("_kp"), "left")
        c = done(mixed, "spray_dilution", ["amount", "unit", "interval_days", "match_kind"], invalid, _say("no_chemical", F.col("product_name")), F.coalesce("_src", none))
        amounts = F.transform(F.try_variant_get(F.col(call), "$.params.input_costs", "array<variant>"), lambda v: F.try_variant_get(v, "$.amount", "string").try_cast("double"))
        margin = ready("gross_margin").select(rid, num("yield_kg").alias("yield_kg"), num("price_per_kg").alias("price_per_kg"), amounts.alias("costs"))
        d = done(gross_margin(margin), "gross_margin", ["revenue", "total_cost", "margin"], invalid, missing, none)
        rest = gated.where(F.col("function").isNull() | F.col("error_message").isNotNull()).select(key, "function", "error_message", F.lit(None).cast("string").alias("result"), none.alias("source_ids"))
        return cut(rest.unionByName(a).unionByName(b).unionByName(c).unionByName(d), keep=True)
