"""Problem 1: a score cutoff per source that keeps a target percentage of its records.

Method: the cutoff is an order statistic, that is a minimiser of the convex pinball loss of the source's scores.
Each round evaluates, for all sources in one distributed aggregate, the loss and the subgradient at one trial
point; the two tangents that enclose the minimum give the next trial point (cutting planes). Every trial also
returns the neighbouring scores, so the bracket always ends on scores that occur and the loop ends exactly when
they meet.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.common import publisher_key, usable_score
from furrow.session import cut, scratch

CUTOFFS = "source string, target_pct int, n_records long, cutoff double, n_kept long, kept_pct double, rounds int"


def _next_trial(s: dict, rounds: int) -> float:
    """Where the tangents at the ends of the bracket meet, moved inside it; every third round its middle."""
    lo, top = s["lo"], s["below_hi"]
    middle = lo + (top - lo) / 2
    trial = middle
    if rounds % 3 != 2 and s["g_hi"] != s["g_lo"]:
        x0 = s["lo"]  # losses relative to lo keep the numbers small
        trial = x0 + (s["l_hi"] - s["l_lo"] - s["g_hi"] * (s["hi"] - x0)) / (s["g_lo"] - s["g_hi"])
    if not math.isfinite(trial) or not lo < trial <= top:
        trial = middle if lo < middle <= top else top
    return trial


def source_cutoffs(records: DataFrame, targets: DataFrame, *, source: str = "publisher", score: str = "score", target: str = "target_pct", max_targets: int = 100_000) -> DataFrame:
    """Cutoff, number of records and number kept for each source of ``targets``.

    The cutoff is the highest score c of the source with 100 x count(score >= c) >= target x count. Only records
    with a source and a score that is neither null nor NaN count. Ties at the cutoff are all kept. A source of
    ``targets`` without such records gets a row with null cutoff and zero counts; sources without a target get no
    row; a target above 100 keeps all, one of 0 or less keeps the best score only. Repeated targets of one source:
    the largest holds. Infinite scores are scores.

    The state is one row per target on the driver: ``targets`` is a configuration table, its size is checked
    against ``max_targets``. Scores are pre-aggregated to (source, score) counts, once, so a hot source costs as
    many rows as it has distinct scores.
    """
    spark = records.sparkSession
    goals = {r.k: r.t for r in targets.select(publisher_key(source).alias("k"), F.col(target).cast("int").alias("t")).where("k is not null and t is not null").groupBy("k").agg(F.max("t").alias("t")).limit(max_targets + 1).collect()}
    if len(goals) > max_targets:
        raise ValueError(f"more than {max_targets} targets")
    if not goals:
        return spark.createDataFrame([], CUTOFFS)
    wanted = F.broadcast(spark.createDataFrame(list(goals.items()), "k string, goal int"))
    with scratch():
        hist = cut(
            records.select(publisher_key(source).alias("k"), usable_score(score).alias("s")).where("k is not null and s is not null")
            .groupBy("k", "s").agg(F.count("*").alias("n")).join(wanted.select("k"), "k")
        )
        state: dict[str, dict] = {}
        for r in hist.groupBy("k").agg(F.sum("n").alias("n"), F.min("s").alias("lo"), F.max("s").alias("hi"), F.sum(F.when(F.abs("s") != float("inf"), F.col("n") * F.col("s"))).alias("total")).collect():
            p = min(max(goals[r.k], 0), 100)
            keep = p / 100  # the share above the cutoff; the pinball level is 1 - keep
            # beyond both ends the loss is linear: its slopes there are the first two cuts
            mean = (r.total or 0.0) / r.n
            state[r.k] = {"n": r.n, "pct": p, "keep": keep, "lo": r.lo, "n_lo": r.n, "below_hi": r.hi, "hi": r.hi, "g_lo": -(1 - keep), "l_lo": (1 - keep) * (mean - r.lo), "g_hi": keep, "l_hi": keep * (r.hi - mean), "rounds": 0}
        live = {k for k, s in state.items() if s["lo"] < s["below_hi"]}
        rounds = 0
        while live:
            trials = {k: _next_trial(state[k], rounds) for k in live}
            at = F.broadcast(spark.createDataFrame(list(trials.items()), "k string, t double"))
            ge, finite = F.col("s") >= F.col("t"), F.abs("s") != float("inf")
            rows = hist.join(at, "k").groupBy("k").agg(
                F.sum(F.when(ge, F.col("n")).otherwise(0)).alias("n_ge"), F.min(F.when(ge, F.col("s"))).alias("above"), F.max(F.when(~ge, F.col("s"))).alias("below"),
                F.sum(F.when(ge & finite, F.col("n") * (F.col("s") - F.col("t"))).otherwise(0.0)).alias("over"),
                F.sum(F.when(~ge & finite, F.col("n") * (F.col("t") - F.col("s"))).otherwise(0.0)).alias("under"),
            ).collect()
            rounds += 1
            for r in rows:
                s = state[r.k]
                s["rounds"] = rounds
                loss = ((1 - s["keep"]) * r.over + s["keep"] * r.under) / s["n"]
                slope = s["keep"] - r.n_ge / s["n"]  # left subgradient at the trial
                if 100 * r.n_ge >= s["pct"] * s["n"] and r.above is not None and r.n_ge > 0:
                    s |= {"g_lo": slope, "l_lo": loss + slope * (r.above - trials[r.k]), "lo": r.above, "n_lo": r.n_ge}
                else:
                    s |= {"g_hi": slope, "l_hi": loss, "hi": trials[r.k], "below_hi": r.below}
                if s["below_hi"] is None or s["lo"] >= s["below_hi"]:
                    live.discard(r.k)
    out = []
    for k, goal in goals.items():
        s = state.get(k)
        out.append((k, goal, s["n"], float(s["lo"]), s["n_lo"], 100.0 * s["n_lo"] / s["n"], s["rounds"]) if s else (k, goal, 0, None, 0, None, 0))
    return spark.createDataFrame(out, CUTOFFS)


def keep_by_cutoff(records: DataFrame, cutoffs: DataFrame, *, source: str = "publisher", score: str = "score") -> DataFrame:
    """The records whose score is at least their source's cutoff; all columns are kept as they are."""
    small = F.broadcast(cutoffs.where("cutoff is not null").select(F.col("source").alias("_src"), F.col("cutoff").alias("_cut")))
    return records.join(small, (publisher_key(records[source]) == F.col("_src")) & (usable_score(records[score]) >= F.col("_cut"))).drop("_src", "_cut")
