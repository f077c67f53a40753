"""Queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.llm import cap_contributors, keep_fraction, mix, near_duplicates, pack, pair_defects, shared_spans, split_chunks
from furrow.llm.common import manifest, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = manifest(spark, sf_dir, "publisher", "score")
    cutoffs = keep_fraction.source_cutoffs(records, table(spark, sf_dir, "keep_targets"))
    return keep_fraction.keep_by_cutoff(records, cutoffs).select("id")


def p1_cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = keep_fraction.source_cutoffs(manifest(spark, sf_dir, "publisher", "score"), table(spark, sf_dir, "keep_targets"))
    return out.select("source", "target_pct", "n_records", "cutoff", "n_kept")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_chunks.split_oversized(table(spark, sf_dir, "chunks")).where("piece = 0").select("chunk_id")


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_chunks.split_oversized(table(spark, sf_dir, "chunks"))


def p2_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each text that is cut: whether its pieces keep the limits, and what they join to."""
    pieces = split_chunks.split_oversized(table(spark, sf_dir, "chunks"))
    fresh = F.substring("piece_text", F.col("overlap_chars") + 1, F.length("piece_text"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", fresh.alias("t")))), lambda x: x["t"]), "")
    per = pieces.groupBy("chunk_id").agg(whole.alias("joined"), F.bool_and(F.length("piece_text") <= split_chunks.LIMIT).alias("within_limit"), F.bool_and(F.col("overlap_chars") <= split_chunks.OVERLAP).alias("within_overlap"))
    return per.select("chunk_id", F.md5("joined").alias("md5"), F.length("joined").cast("long").alias("n_chars"), "within_limit", "within_overlap")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cap_contributors.over_cap(manifest(spark, sf_dir, "publisher", "score")).select("id")


def p3_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cap_contributors.cap_contributors(manifest(spark, sf_dir, "publisher", "score")).select("id", "publisher", "score")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicate_pairs(manifest(spark, sf_dir, "title", "crops_covered"))


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicate_groups(manifest(spark, sf_dir, "title", "crops_covered"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_defects.defective_pairs(table(spark, sf_dir, "eval_results"))


def p5_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_defects.label_pairs(table(spark, sf_dir, "eval_results")).select("id", "defect_type", F.round("posterior", 6).alias("posterior"), "best")


def p6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.pack(table(spark, sf_dir, "documents"))


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.fill_report(pack.pack(table(spark, sf_dir, "documents")))


def p6_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each text: whether its pieces cover all its tokens once, lie in a container, and that no container is over its capacity."""
    packed = pack.pack(table(spark, sf_dir, "documents"))
    loads = packed.where("container_id is not null").groupBy("container_id").agg(F.sum("n_tokens").alias("load"))
    rows = packed.join(loads, "container_id", "left")
    return rows.groupBy("doc_id").agg(
        ((F.min("token_start") == 0) & (F.sum("n_tokens") == F.max("token_end")) & (F.count("*") == F.max("piece") + 1)).alias("whole"), F.bool_or(F.col("container_id").isNotNull()).alias("placed"),
        F.bool_and(F.coalesce(F.col("load") <= pack.CAPACITY, F.lit(True))).alias("fits"), F.bool_and((F.col("n_tokens") == pack.CAPACITY) | (F.col("piece") == 0) | (F.col("n_tokens") > 0)).alias("split_only_if_needed"),
    )


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


def p7_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the mix whatever the tokenizer: who takes part, repeats, shares and size."""
    rows, shares = mix.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))
    open_ = F.when(~F.col("capped"), F.col("target_share"))
    whole = shares.agg(F.sum("mix_tokens").alias("total"), F.sum(F.when(F.col("capped"), F.col("mix_tokens")).otherwise(0)).alias("given"), F.sum(open_).alias("open"), F.count(open_).alias("n_open"), F.sum("n_tokens").alias("at_hand"))
    told = rows.groupBy("source", "doc_id").count().groupBy("source").agg(F.max("count").alias("most"))
    part = (F.col("total") - F.col("given")) * F.col("target_share") / F.col("open")
    met = F.when(F.col("capped"), F.col("mix_tokens") == F.col("n_tokens") * F.col("max_repeats")).otherwise(F.abs(F.col("mix_tokens") - part) <= mix.BLOCK)
    return shares.join(F.broadcast(whole), F.lit(True)).join(told, "source", "left").select(
        "source", "n_docs", (F.col("mix_rows") > 0).alias("in_mix"), (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")).alias("repeats_kept"), met.alias("share_met"), (F.abs(F.col("total") - F.col("at_hand")) <= F.col("n_open") * mix.BLOCK).alias("full_size")
    )


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans.sharing_pairs(table(spark, sf_dir, "documents"))


def p8_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans.shared_parts(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_cutoffs, p2_found, p2_pieces, p2_checks, p3_found, p3_kept, p4_found, p4_groups, p5_found, p5_labels, p6_pack, p6_fill, p6_checks, p7_mix, p7_shares, p7_checks, p8_found, p8_shared)}
