"""Problem 6: texts into containers of fixed capacity, splitting only what is larger than a container.

Method: linear grouping. The large sizes are sorted and cut into groups of equal cardinality, and each is rounded up to the largest
of its group; the few rounded sizes are packed by configurations from a linear program (column generation with a knapsack as
pricing); the actual documents take the slots of their group, which returns the rounding as free space; the rest, small sizes
above all, goes where it fits best.

Sizes are integers up to the capacity, so all of this needs only the histogram of sizes: at most ``capacity`` rows, whatever the
number of documents. The plan is run-length coded; documents find their container by their rank among equal sizes.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.tokens import TOKENIZER, token_counts
from furrow.operators.ordering import prefix_totals
from furrow.session import cut, scratch

CAPACITY, GROUPS, SMALL_SHARE = 2048, 128, 1 / 3


def linear_groups(sizes: list[tuple[int, int]], groups: int) -> list[list[tuple[int, int]]]:
    """Cuts (size, count), descending, into at most ``groups`` lists of equal cardinality (the last may be smaller)."""
    total = sum(c for _, c in sizes)
    per = max(1, -(-total // groups))
    out: list[list[tuple[int, int]]] = []
    room = 0
    for s, c in sizes:
        while c:
            if not room:
                out.append([])
                room = per
            k = min(c, room)
            out[-1].append((s, k))
            room -= k
            c -= k
    return out


def _knapsack(sizes: np.ndarray, gain: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes that fits, and its counts. One layer per item of the multiset."""
    room = np.arange(capacity + 1)[:, None] - sizes[None, :]
    fits, room = room >= 0, np.maximum(room, 0)
    best, picks = np.zeros(capacity + 1), []
    for _ in range(capacity // int(sizes.min())):
        value = np.where(fits, best[room] + gain, -1.0)
        k = value.argmax(axis=1)
        new = value[np.arange(capacity + 1), k]
        better = new > best + 1e-12
        if not better.any():
            break
        picks.append(np.where(better, k, -1))
        best = np.where(better, new, best)
    counts, c = np.zeros(len(sizes), int), capacity
    for pick in reversed(picks):
        if pick[c] >= 0:
            counts[pick[c]] += 1
            c -= int(sizes[pick[c]])
    return float(best[capacity]), counts


def configurations(sizes: list[int], counts: list[int], capacity: int, rounds: int = 400) -> list[tuple[int, list[int]]]:
    """(times, counts of each size) from the configuration program: min sum x, A x = counts, x >= 0, rounded down."""
    s, b = np.array(sizes), np.array(counts, float)
    basis = np.diag((capacity // s).astype(float))
    x = np.linalg.solve(basis, b)
    for _ in range(rounds):
        duals = np.linalg.solve(basis.T, np.ones(len(s)))
        value, col = _knapsack(s, duals, capacity)
        if value <= 1 + 1e-7:
            break
        move = np.linalg.solve(basis, col.astype(float))
        able = move > 1e-9
        if not able.any():
            break
        ratio = np.where(able, x / np.where(able, move, 1), np.inf)
        out = int(ratio.argmin())
        step = max(0.0, ratio[out])
        x = np.maximum(x - step * move, 0)
        x[out] = step
        basis[:, out] = col
    left = np.array(counts)
    plan = []
    for j in np.argsort(-x):
        column = np.rint(basis[:, j]).astype(int)
        times = int(min(int(x[j] + 1e-6), *(left[i] // column[i] for i in np.flatnonzero(column)))) if column.any() else 0
        if times > 0:
            left -= times * column
            plan.append((times, column.tolist()))
    return plan


def pack_histogram(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small_share: float = SMALL_SHARE) -> list[tuple[int, dict[int, int]]]:
    """Containers as (number of equal containers, {size: items of that size in each}); every item is in exactly one."""
    items = sorted(((s, c) for s, c in histogram.items() if c > 0), reverse=True)
    large = [(s, c) for s, c in items if s > capacity * small_share]
    rest = {s: c for s, c in items if s <= capacity * small_share}
    done: list[tuple[int, dict[int, int]]] = []
    classes = linear_groups(large, groups)
    by_size: dict[int, list[list[tuple[int, int]]]] = {}
    for g in classes:  # groups whose largest size is the same are one class
        by_size.setdefault(g[0][0], []).append(g)
    sizes = sorted(by_size, reverse=True)
    queues = [[run for g in by_size[s] for run in g][::-1] for s in sizes]  # the last run of a queue is next
    plan = configurations(sizes, [sum(c for _, c in q) for q in queues], capacity) if sizes else []

    def take(q: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
        got = []
        while n:
            s, c = q.pop()
            k = min(c, n)
            got.append((s, k))
            n -= k
            if c > k:
                q.append((s, c - k))
        return got

    for times, column in plan:
        slots = [take(queues[i], times) for i, k in enumerate(column) for _ in range(k)]
        edges = sorted({e for runs in slots for e in np.cumsum([c for _, c in runs]).tolist()})
        at, ptr, used = 0, [0] * len(slots), [0] * len(slots)
        for e in edges:  # stretches in which no slot changes its size
            content: dict[int, int] = {}
            for k, runs in enumerate(slots):
                while at - used[k] >= runs[ptr[k]][1]:
                    used[k] += runs[ptr[k]][1]
                    ptr[k] += 1
                s = runs[ptr[k]][0]
                content[s] = content.get(s, 0) + 1
            done.append((e - at, content))
            at = e
    for q in queues:
        for s, c in q:
            rest[s] = rest.get(s, 0) + c
    return best_fit(done, rest, capacity)


def best_fit(containers: list[tuple[int, dict[int, int]]], rest: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Adds items, largest first, each to the container with the least sufficient space; equal containers move together."""
    space: dict[int, list[tuple[int, dict[int, int]]]] = {}
    levels: list[int] = []

    def put(times: int, content: dict[int, int]) -> None:
        free = capacity - sum(s * k for s, k in content.items())
        if free not in space:
            space[free] = []
            insort(levels, free)
        space[free].append((times, content))

    for times, content in containers:
        put(times, content)
    for s, left in sorted(rest.items(), reverse=True):
        while left:
            i = bisect_left(levels, s)
            if i == len(levels):
                k = capacity // s
                times, k = (left // k, k) if left >= k else (1, left)
                put(times, {s: k})
                left -= times * k
                continue
            free = levels[i]
            times, content = space[free].pop()
            if not space[free]:
                del space[free]
                levels.pop(i)
            k = min(free // s, left)
            use = min(times, left // k)
            if times > use:
                put(times - use, content)
            put(use, content | {s: content.get(s, 0) + k})
            left -= use * k
    return [x for f in levels for x in space[f]]


def pack(docs: DataFrame, *, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, groups: int = GROUPS, small_share: float = SMALL_SHARE, tokenizer: str = TOKENIZER) -> DataFrame:
    """(key, piece, token_start, token_end, n_tokens, container_id): where each text, or part of a text larger than a container, goes.

    A text larger than the capacity gives full containers and one rest, which is packed like any other item. Texts without token (null,
    empty) need no room: their one piece has container_id null. Rows with a null or repeated key are packed like others.
    """
    spark = docs.sparkSession
    with scratch():
        sized = cut(token_counts(docs, [key], text, tokenizer))
        n, cap = F.col("n_tokens"), F.lit(capacity)
        piece = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(n / cap).cast("int") - 1, F.lit(0))))
        pieces = sized.select(F.col(key).alias("key"), "n_tokens", piece.alias("piece")).select("key", "piece", (F.col("piece") * cap).cast("long").alias("token_start"), F.least(n, (F.col("piece") + 1) * cap).cast("long").alias("token_end"))
        items = pieces.withColumn("size", (F.col("token_end") - F.col("token_start")).cast("int"))
        histogram = {r["size"]: r["count"] for r in items.where("size > 0").groupBy("size").count().collect()}  # at most ``capacity`` rows
        slots, start = [], 0
        taken: dict[int, int] = {}
        for times, content in pack_histogram(histogram, capacity, groups, small_share):
            for s, k in content.items():
                lo = taken.get(s, 0)
                slots.append((s, lo, lo + times * k, start, k))
                taken[s] = lo + times * k
            start += times
        # runs of the plan: bounded by the capacity and the number of groups, not by the documents
        plan = spark.createDataFrame(slots, "size int, lo long, hi long, first long, per int")
        ranked = prefix_totals(items.where("size > 0"), ["size"], [F.col("key").asc_nulls_first(), F.col("piece").asc(), F.col("token_end").asc()])
        at = F.col("rank") - 1
        placed = ranked.join(F.broadcast(plan), "size").where((at >= F.col("lo")) & (at < F.col("hi")))
        placed = placed.select("key", "piece", "token_start", "token_end", "size", (F.col("first") + F.floor((at - F.col("lo")) / F.col("per"))).alias("container_id"))
        out = placed.unionByName(items.where("size = 0").withColumn("container_id", F.lit(None).cast("long")))
        return cut(out.select(F.col("key").alias(key), "piece", "token_start", "token_end", F.col("size").alias("n_tokens"), "container_id"), keep=True)


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers used, tokens, the least number of containers that could hold them, the unused share, and the fullest and
    emptiest container."""
    per = packed.where("container_id is not null").groupBy("container_id").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("n"))
    return per.agg(
        F.count("*").alias("containers"), F.coalesce(F.sum("used"), F.lit(0)).alias("tokens"), F.ceil(F.coalesce(F.sum("used"), F.lit(0)) / capacity).alias("lower_bound"),
        F.coalesce(1 - F.sum("used") / (F.count("*") * capacity), F.lit(0.0)).alias("unused_share"), F.max("used").alias("fullest"), F.min("used").alias("emptiest"), F.sum("n").alias("items"),
    )
