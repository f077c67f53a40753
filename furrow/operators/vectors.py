"""Vector operators: similarity, top-k, centroids, routing and their calibration."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.operators.ordering import prefix_totals

MOST_QUERY_VECTORS, MOST_CENTRES = 50_000, 10_000


def dot(a: Column, b: Column) -> Column:
    """Dot product of two arrays in index order, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(a: Column) -> Column:
    """The vector at length 1; a zero vector stays zero."""
    norm = F.sqrt(dot(a, a))
    return F.transform(a, lambda x: F.when(norm > 0, x / norm).otherwise(F.lit(0.0)))


class Best:
    """The k best items of each query among the scores added so far; ties go to the smaller item."""

    def __init__(self, k: int) -> None:
        self.k, self.q, self.s, self.ids = k, np.empty(0, np.int64), np.empty(0), None

    def add(self, scores: np.ndarray, names: np.ndarray) -> None:
        """Scores (items, queries) of named items; those of minus infinity take no part."""
        if not len(names):
            return
        pick = scores > -np.inf
        if len(names) > self.k:  # ties at the edge stay in
            pick &= scores >= np.partition(scores, len(names) - self.k, axis=0)[len(names) - self.k] - 1e-12
        i, j = np.nonzero(pick)
        ids = names[i] if self.ids is None else np.r_[self.ids, names[i]]
        q, s = np.r_[self.q, j], np.r_[self.s, -scores[i, j]]
        order = np.lexsort((ids, s, q))
        keep = order[np.arange(len(q)) - np.searchsorted(q[order], q[order]) < self.k]
        self.q, self.s, self.ids = q[keep], s[keep], ids[keep]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query number, item, score) of what remains."""
        return self.q, self.ids if self.ids is not None else np.empty(0), -self.s


def _scan(keys: list, matrix: np.ndarray, k: int, groups: list | None = None, cells: int = 4_000_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, kind = Best(k), None
        step = max(1, cells // max(1, len(keys)))
        own = None if groups is None else np.array(groups)
        for whole in batches:
            kind = whole.schema.field(0).type
            for low in range(0, whole.num_rows, step):
                batch = whole.slice(low, step)
                column = batch.column(1)
                rows = np.flatnonzero(np.asarray(pa.compute.equal(pa.compute.list_value_length(column), matrix.shape[1]).fill_null(False)))
                if not len(rows):
                    continue
                at = pa.array(rows)
                vectors = column.take(at).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1).astype(np.float64)
                scores = vectors @ matrix.T
                if own is not None:
                    scores[np.array(batch.column(2).take(at).to_pylist())[:, None] == own[None, :]] = -np.inf
                best.add(scores, np.array(batch.column(0).take(at).to_pylist()))
        q, ids, s = best.rows()
        if len(q):
            yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.int64)[q]), pa.array(ids.tolist(), kind), pa.array(s)], ["query_id", "item_id", "score"])

    return run


def dense_topk(queries: DataFrame, items: DataFrame, k: int, query_key: str = "query_id", key: str = "vec_id", vector: str = "embedding", apart: str | None = None, most: int = MOST_QUERY_VECTORS) -> DataFrame:
    """(query_id, item_id, score, rank): the k items with the greatest dot product for each query.

    Each partition of the items is scanned once per block of at most ``most`` queries by one matrix product, and keeps k per
    query, so only k rows per query and partition are shuffled. Queries are a stated set; items may grow without bound.
    Ties go to the smaller item. Vectors of another dimension and null vectors take no part. ``apart`` names a column of both sides: items
    with the query's own value take no part (held-out folds).
    """
    schema = f"query_id long, item_id {dict(items.dtypes)[key]}, score double"
    extra = [apart] if apart else []
    asked = queries.where(F.col(vector).isNotNull()).select(F.col(query_key).cast("long").alias("q"), vector, *extra)
    blocks = max(1, -(-asked.count() // most))
    near = items.sparkSession.createDataFrame([], schema)
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).collect()
        if rows:
            scan = _scan([r[0] for r in rows], np.array([r[1] for r in rows], dtype=np.float64), k, [r[2] for r in rows] if apart else None)
            near = near.unionByName(items.select(key, vector, *extra).mapInArrow(scan, schema))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def centroids(vectors: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """(label, centroid): the element-wise mean of each label's vectors at unit length."""
    parts = vectors.where(F.col(label).isNotNull()).select(label, F.posexplode(vector).alias("pos", "x")).groupBy(label, "pos").agg(F.avg("x").alias("x"))
    means = parts.groupBy(label).agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("v"))
    return means.select(label, unit(F.col("v.x")).alias("centroid"))


def _centre_lists(centres: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    """All centroids (of each ``by``) as one array ``_centres``: a label set is fixed and small, which is checked."""
    if centres.limit(MOST_CENTRES + 1).count() > MOST_CENTRES:
        raise ValueError(f"more than {MOST_CENTRES} centroids")
    listed = F.array_sort(F.collect_list(F.struct(F.col(label).alias("tier"), "centroid"))).alias("_centres")
    return F.broadcast(centres.groupBy(*by).agg(listed) if by else centres.agg(listed))


def centroid_scores(vectors: DataFrame, centres: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(key, tier, sim) against every centroid; centroids are one row per label of a fixed label set."""
    sims = F.transform("_centres", lambda c: F.struct(c["tier"].alias("tier"), dot(F.col(vector), c["centroid"]).alias("sim")))
    return vectors.join(_centre_lists(centres, label), F.lit(True)).select(key, F.explode(sims).alias("x")).select(key, "x.*")


def route(vectors: DataFrame, centres: DataFrame, threshold: float, refuse=None, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(key, tier, confidence, margin, refused, reason): the tier of the nearest centroid; below the threshold refused as
    ``low_confidence``; ``refuse`` names the tier that is always refused. Ties go to the smaller tier. Each vector is routed within its row:
    nothing is shuffled. Without centroids there are no rows; a null vector has no confidence and is refused."""
    ranked = F.array_sort(F.transform("_centres", lambda c: F.struct((-dot(F.col(vector), c["centroid"])).alias("o"), c["tier"].alias("t"))))
    top = vectors.join(_centre_lists(centres, label), F.size("_centres") > 0).select(key, ranked.alias("r")).select(key, F.col("r")[0]["t"].alias("tier"), (-F.col("r")[0]["o"]).alias("confidence"), (-F.get("r", F.lit(1))["o"]).alias("second"))
    low = F.coalesce(F.col("confidence") < threshold, F.lit(True))
    always = F.lit(False) if refuse is None else (F.col("tier") == F.lit(refuse))
    return top.select(key, "tier", "confidence", (F.col("confidence") - F.col("second")).alias("margin"), (low | always).alias("refused"), F.when(low, "low_confidence").otherwise("classified").alias("reason"))


def folds(vectors: DataFrame, n: int = 5, key: str = "vec_id", label: str = "label") -> DataFrame:
    """Adds ``fold``: stratified by label, dealt round by the order of a hash of the key (then the key). Positions come from ranges, so a
    label may hold any share of the rows."""
    dealt = prefix_totals(vectors.withColumn("_h", F.md5(F.col(key).cast("string"))), [label], [F.col("_h").asc(), F.col(key).asc()], rank="_r")
    return dealt.withColumn("fold", ((F.col("_r") - 1) % n).cast("int")).drop("_h", "_r")


def knn_vote(neighbours: DataFrame, labels: DataFrame, key: str = "vec_id", label: str = "label") -> DataFrame:
    """(query_id, predicted, votes, mean_sim) from ranked neighbours: the most frequent label, on ties the one met first."""
    named = neighbours.join(labels.select(F.col(key).alias("item_id"), label), "item_id")
    per = named.groupBy("query_id", label).agg(F.count("*").alias("votes"), F.min("rank").alias("first"), F.avg("score").alias("mean_sim"))
    order = Window.partitionBy("query_id").orderBy(F.desc("votes"), "first")
    return per.withColumn("r", F.row_number().over(order)).where("r = 1").select("query_id", F.col(label).alias("predicted"), "votes", "mean_sim")


def cross_validate(vectors: DataFrame, n: int = 5, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(key, label, fold, predicted, sim): each vector classified by the centroids of the other folds.

    Sums per (label, fold) come from one aggregate; the centroids without a fold are total minus fold, so no fold
    is scanned twice."""
    data = folds(vectors, n, key, label)
    parts = data.select(label, "fold", F.posexplode(vector).alias("pos", "x")).groupBy(label, "pos", "fold").agg(F.sum("x").alias("s"), F.count("*").alias("c"))
    whole = Window.partitionBy(label, "pos")
    held = parts.select(label, "fold", "pos", ((F.sum("s").over(whole) - F.col("s")) / F.nullif(F.sum("c").over(whole) - F.col("c"), F.lit(0))).alias("x"))
    centres = held.where("x is not null").groupBy(label, "fold").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("v")).select(F.col(label).alias("tier"), "fold", unit(F.col("v.x")).alias("centroid"))
    best = F.array_min(F.transform("_centres", lambda c: F.struct((-dot(F.col(vector), c["centroid"])).alias("o"), c["tier"].alias("t"))))
    scored = data.join(_centre_lists(centres, "tier", ["fold"]), "fold").select(key, label, "fold", best.alias("b"))
    return scored.select(key, label, "fold", F.col("b.t").alias("predicted"), (-F.col("b.o")).alias("sim"))


def knn_cross_validate(data: DataFrame, queries: DataFrame, ks: Sequence[int] = (1, 3, 5), key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(key, k, label, predicted): each query classified by its k nearest rows of the other folds. ``data`` has a column ``fold``, the
    queries are rows of it."""
    near = dense_topk(queries, data, max(ks), query_key=key, key=key, vector=vector, apart="fold")
    out = None
    for k in ks:
        part = knn_vote(near.where(F.col("rank") <= k), data, key, label).select(F.col("query_id").alias(key), F.lit(k).alias("k"), "predicted")
        out = part if out is None else out.unionByName(part)
    return out.join(queries.select(key, label), key)


def threshold_sweep(scored: DataFrame, start: int = 50, stop: int = 94, step: int = 2) -> DataFrame:
    """(threshold, wrong_caught, correct_lost) in percent, for rows (ok boolean, sim): the share of wrong rows below each threshold, and
    of right rows. One pass: rows are counted per step first."""
    grid = scored.sparkSession.range(start, stop + 1, step).select((F.col("id") / 100).alias("threshold"))
    # the first threshold above a similarity is all that matters of it
    counted = scored.select("ok", F.least(F.greatest(F.floor(F.col("sim") * 100), F.lit(-1)), F.lit(101)).alias("b"), F.when(F.floor(F.col("sim") * 100) / 100 == F.col("sim"), 0).otherwise(1).alias("past")).groupBy("ok", "b", "past").count()
    below = (F.col("b") / 100 < F.col("threshold")) & ((F.col("past") == 0) | ((F.col("b") + 1) / 100 <= F.col("threshold")))
    cells = grid.join(F.broadcast(counted), F.lit(True))
    share = lambda ok: F.coalesce(F.lit(100.0) * F.sum(F.when((F.col("ok") == ok) & below, F.col("count"))) / F.sum(F.when(F.col("ok") == ok, F.col("count"))), F.lit(0.0))
    return cells.groupBy("threshold").agg(F.round(share(False), 4).alias("wrong_caught"), F.round(share(True), 4).alias("correct_lost"))
