"""Problem 7: a mix of sources with target shares of all tokens.

Method: Pfair scheduling. The stream of a source is cut into equal blocks; block i of a source with b of all S blocks is released at
slot floor((i - 1) S / b) and due at ceil(i S / b). Earliest deadline first gives each slot to one source, and at every slot each
source is less than one block from its share. Every document finds its slot from the tokens of its source before it.
"""

from __future__ import annotations

from heapq import heappop, heappush

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.tokens import TOKENIZER, token_counts
from furrow.operators.ordering import prefix_totals
from furrow.session import cut, scratch

BLOCK, MOST_BLOCKS = 2048, 100_000


def quotas(shares: dict[str, float], limits: dict[str, float], total: float) -> dict[str, float]:
    """The tokens each source gives to a mix of ``total``: in proportion to the shares, but at most its limit. What a limited source cannot
    give is divided among the others in proportion to theirs. If the limits don't allow the total, all are given in full."""
    out: dict[str, float] = {}
    open_, left = dict(shares), total
    while open_:
        scale = left / sum(open_.values())
        full = [k for k, w in open_.items() if w * scale >= limits[k]]
        if not full:
            return out | {k: w * scale for k, w in open_.items()}
        for k in full:
            out[k] = limits[k]
            left = max(0.0, left - limits[k])
            del open_[k]
    return out


def pfair_schedule(blocks: dict[str, int]) -> list[str]:
    """The source of each slot: among the released blocks the one due first, on ties by name."""
    total = sum(blocks.values())
    later: list[tuple[int, int, str, int]] = []  # (release, deadline, source, block)
    ready: list[tuple[int, str, int]] = []
    for k, b in blocks.items():
        if b:
            heappush(later, (0, -(-total // b), k, 1))
    out = []
    for t in range(total):
        while later and later[0][0] <= t:
            _, due, k, i = heappop(later)
            heappush(ready, (due, k, i))
        due, k, i = heappop(ready)
        assert t < due, "a block missed its deadline"
        out.append(k)
        if i < blocks[k]:
            heappush(later, (i * total // blocks[k], -(-(i + 1) * total // blocks[k]), k, i + 1))
    return out


def mix(docs: DataFrame, targets: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK, total_tokens: int | None = None, tokenizer: str = TOKENIZER, max_targets: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(rows, shares). rows: (position, slot, key, source, copy, n_tokens), the mix in order. shares: one row per target with
    the tokens and documents at hand, the target, the quota and the share reached, tokens and rows in the mix, the most copies of a
    document, and whether the source is capped.

    The mix has ``total_tokens``, by default as many as the listed sources hold. A source that cannot give its part of that within
    max_repeats copies of each document is capped: it gives all copies, and the others take up the rest in proportion to their shares, so
    among themselves they keep their targets. A source that isn't capped comes within an eighth of ``block`` of its quota if it has documents
    small enough to fill what is left of it. Listed sources without tokens cannot take part and are reported with 0.
    Sources that are not listed, null sources and texts without token are not in the mix. Each copy number of a
    source is shuffled anew (by hash, so the result is fixed), and copy n + 1 starts when all documents were used n times.
    Repeated targets of a source: shares add up and the smallest max_repeats holds. A null or non-positive share or repeat count takes no part.

    A block is ``block`` tokens, or a part in ``MOST_BLOCKS`` of the mix if that is more: the schedule, one row per block, is made on the
    driver. ``targets`` is configuration; its size is checked. A source may hold any part of the documents: running totals are
    taken over ranges, never in one task.
    """
    spark = docs.sparkSession
    goals = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.sum("target_share").alias("share"), F.min("max_repeats").alias("most")).limit(max_targets + 1).collect()
    if len(goals) > max_targets:
        raise ValueError(f"more than {max_targets} targets")
    names = F.broadcast(spark.createDataFrame([(g.source,) for g in goals], "source string"))
    listed = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), F.col(text).alias("text")).join(names, "source")
    with scratch():
        sized = cut(token_counts(listed, ["key", "source"], "text", tokenizer))
        have = {r.source: r for r in sized.where("n_tokens > 0").groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")).collect()}
        live = {g.source: g for g in goals if g.source in have and (g.share or 0) > 0 and (g.most or 0) > 0}
        total = total_tokens if total_tokens is not None else sum(have[k].tokens for k in live)
        limits = {k: float(have[k].tokens * g.most) for k, g in live.items()}
        quota = quotas({k: g.share for k, g in live.items()}, limits, total)
        size = max(block, sum(quota.values()) / MOST_BLOCKS)
        blocks = {k: max(1, round(q / size)) for k, q in quota.items()}
        slots: dict[str, list[int]] = {k: [] for k in quota}
        for slot, k in enumerate(pfair_schedule(blocks)):
            slots[k].append(slot)
        rule = F.broadcast(spark.createDataFrame([(k, float(q), have[k].tokens, min(live[k].most, int(-(-q // have[k].tokens)))) for k, q in quota.items()], "source string, quota double, tokens long, copies int"))
        schedule = spark.createDataFrame([(k, i, s) for k, xs in slots.items() for i, s in enumerate(xs)], "source string, block int, slot int")
        per_source = F.broadcast(spark.createDataFrame([(k, blocks[k]) for k in quota], "source string, blocks int"))
        copies = sized.where("n_tokens > 0").join(rule, "source").where("copies > 0")
        copies = copies.select("key", "source", "n_tokens", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
        copies = copies.withColumn("draw", F.xxhash64("key", "copy"))
        order = [F.col("draw").asc(), F.col("key").asc_nulls_first(), F.col("n_tokens").asc()]
        running = prefix_totals(copies, ["source", "copy"], order, {"n_tokens": "before"})
        start = F.col("before") + (F.col("copy") - 1) * F.col("tokens")
        running = cut(running.join(rule, "source").withColumn("start", start).select("key", "source", "copy", "draw", "n_tokens", "start", "quota"))
        fits = F.col("start") + F.col("n_tokens") <= F.col("quota")
        chosen, rest = running.where(fits), running.where(~fits)
        while True:
            # what is left of a quota is filled with the next documents that fit into it
            got = {r.source: r.n for r in chosen.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
            gaps = [(k, q - got.get(k, 0)) for k, q in quota.items() if q - got.get(k, 0) > block / 8]
            if not gaps:
                break
            gap = F.broadcast(spark.createDataFrame(gaps, "source string, gap double"))
            small = rest.join(gap, "source").where("n_tokens <= gap")
            more = prefix_totals(small.drop("start"), ["source"], [F.col("copy").asc(), *order], {"n_tokens": "before"}).where("before + n_tokens <= gap")
            more = cut(more.withColumn("start", F.col("quota") - F.col("gap") + F.col("before")).select(*running.columns))
            if not more.limit(1).count():
                break
            chosen = chosen.unionByName(more)
            rest = rest.join(more.select("source", "copy", "draw", "key"), ["source", "copy", "draw", "key"], "left_anti")
        at = chosen.join(per_source, "source").withColumn("block", F.least(F.floor(F.col("start") * F.col("blocks") / F.col("quota")).cast("int"), F.col("blocks") - 1))
        at = at.join(F.broadcast(schedule), ["source", "block"])
        rows = prefix_totals(at.select("slot", "source", "start", "key", "copy", "n_tokens"), [], [F.col("slot").asc(), F.col("start").asc(), F.col("key").asc_nulls_first(), F.col("copy").asc()], rank="position")
        rows = cut(rows.select("position", "slot", F.col("key").alias(key), "source", "copy", "n_tokens"), keep=True)
    told = rows.groupBy("source").agg(F.sum("n_tokens").alias("mix_tokens"), F.count("*").alias("mix_rows"), F.max("copy").alias("most_copies"))
    asked = spark.createDataFrame([(g.source, g.share, g.most, have[g.source].docs if g.source in have else 0, have[g.source].tokens if g.source in have else 0, quota.get(g.source, 0.0), quota.get(g.source, 0.0) >= limits.get(g.source, 0.0)) for g in goals], "source string, target_share double, max_repeats int, n_docs long, n_tokens long, quota double, capped boolean")
    whole = rows.agg(F.sum("n_tokens").alias("all_tokens"))
    shares = asked.join(told, "source", "left").join(F.broadcast(whole), F.lit(True)).select(
        "source", "target_share", "max_repeats", "n_docs", "n_tokens", "quota", "capped", F.coalesce("mix_tokens", F.lit(0)).alias("mix_tokens"), F.coalesce("mix_rows", F.lit(0)).alias("mix_rows"),
        F.coalesce("most_copies", F.lit(0)).alias("most_copies"), F.coalesce(F.col("mix_tokens") / F.col("all_tokens"), F.lit(0.0)).alias("actual_share"),
    )
    return rows, shares
