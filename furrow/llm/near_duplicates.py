"""Problem 4: records of the same work under several ids, found by ProbMinHash, banding and exact verification.

Method: every distinct word set is one class. Its words are weighted (rare words 1, frequent words by inverse document
frequency, so that what all titles share hardly counts), and ProbMinHash draws for each word the points of a Poisson process
of that rate; each point names a register and lowers it. The points of a word come in ascending order, so a set stops as soon
as its next point lies above its largest register. Two sets agree in a register with the probability Jaccard
similarity of their weights. Bands of registers name candidates; candidates are verified on the words themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.llm.common import crop_set, word_set
from furrow.session import cut, scratch

REGISTERS, BAND = 128, 2
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the public SplitMix64 constants)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def prob_minhash(words: np.ndarray, weights: np.ndarray, starts: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """Registers of many weighted sets at once.

    ``words`` (64-bit hashes) and positive ``weights`` of set i are at ``starts[i]:starts[i + 1]``; sets aren't empty. Returns
    an array (sets, m) of the word that won each register. Round r draws the r-th point of every word still
    active; words whose point lies above the largest register of their set are done (early termination).
    """
    n = len(starts) - 1
    owner = np.repeat(np.arange(n), np.diff(starts))
    value, winner, top = np.full(n * m, np.inf), np.zeros(n * m, _U), np.full(n, np.inf)
    at, w, who, rate = np.zeros(len(words)), words.astype(_U), owner, weights.astype(float)
    r = 0
    while len(w):
        r += 1
        bits = _mix(w + _U(r * 0x9E3779B97F4A7C15 % 2**64))
        gap = -np.log(((bits >> _U(11)).astype(float) + 0.5) / 2.0**53)
        at = at + gap / rate
        alive = at < top[who]
        at, w, who, rate, bits = at[alive], w[alive], who[alive], rate[alive], bits[alive]
        if not len(w):
            break
        cell = who * m + (_mix(bits ^ _U(0xD6E8FEB86659FD93)) % _U(m)).astype(np.int64)
        was = value[cell]
        np.minimum.at(value, cell, at)
        won = (at == value[cell]) & (at < was)
        winner[cell[won]] = w[won]
        if r % 8 == 0 or r < 4:
            top = value.reshape(n, m).max(axis=1)
    return winner.reshape(n, m)


def _bands(registers: int, band: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                lists, rates = batch.column(1), batch.column(2)
                words, weights = lists.flatten().to_numpy(zero_copy_only=False).view(_U), rates.flatten().to_numpy(zero_copy_only=False)
                starts = np.r_[0, np.cumsum(np.asarray(pa.compute.list_value_length(lists)))]
                won = prob_minhash(words, weights, starts, registers)
                key = np.zeros((len(won), registers // band), _U)
                for i in range(band):
                    key = _mix(key * _U(0x9E3779B97F4A7C15) + won[:, i::band][:, : key.shape[1]])
                key = _mix(key + np.arange(key.shape[1], dtype=_U))
                out = pa.ListArray.from_arrays(pa.array(np.arange(len(won) + 1, dtype=np.int32) * key.shape[1]), pa.array(key.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0), out], ["cid", "bands"])

    return run


def weighted_words(classes: DataFrame, plateau: int = 32, heavy_share: float = 1e-3) -> DataFrame:
    """(cid, words: array of hashes, weights) of classes (cid, words). A word in at most ``plateau`` classes weighs 1,
    any other plateau / its class count. Words in over ``heavy_share`` of all classes, of which there can be no more
    than words per class / heavy_share, are joined by broadcast; the rest by a shuffle, where no key is larger than
    that share."""
    pairs = classes.select("cid", F.explode("words").alias("word")).select("cid", F.xxhash64("word").alias("w"))
    n = classes.count()
    counts = cut(pairs.groupBy("w").count().where(F.col("count") > plateau).withColumnRenamed("count", "df"))
    limit = max(plateau, n * heavy_share)
    heavy, mid = counts.where(F.col("df") > limit).withColumnRenamed("df", "hdf"), counts.where(F.col("df") <= limit)
    joined = pairs.join(F.broadcast(heavy), "w", "left").join(mid, "w", "left")
    weight = F.lit(float(plateau)) / F.greatest(F.lit(float(plateau)), F.coalesce("hdf", "df", F.lit(0)).cast("double"))
    both = F.array_sort(F.collect_list(F.struct("w", weight.alias("x")))).alias("both")
    return joined.groupBy("cid").agg(both).select("cid", F.col("both.w").alias("words"), F.col("both.x").alias("weights"))


def _needed(n: Column, threshold: float) -> Column:
    return F.ceil(n * F.lit(threshold) - F.lit(1e-9))


def similar_classes(classes: DataFrame, *, threshold: float = 0.6, registers: int = REGISTERS, band: int = BAND, hot: int = 300, block: int = 1000) -> DataFrame:
    """Pairs (a, b, jaccard), a < b, of classes (cid, words) whose words' Jaccard similarity reaches the threshold.

    In a bucket of more than ``hot`` classes pairs are not formed directly: its members are joined on the words of
    their prefix (the rarest words, of which two sets that reach the threshold must share one). A pair is taken at a shared word only if
    the sizes, and the words that follow it in both, still allow the threshold; that loses none. More than ``block`` classes of a bucket
    with one prefix word are joined block by block, so no task holds them all.
    """
    signed = cut(weighted_words(classes))
    spread = signed.repartition(max(1, -(-classes.count() // 2000)), "cid")  # by work, not by bytes
    banded = cut(spread.mapInArrow(_bands(registers, band), "cid long, bands array<long>").select("cid", F.explode("bands").alias("key")))
    sizes = banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = cut(banded.join(sizes, "key"))
    small = shared.where(F.col("n") <= hot).select("cid", "key")
    found = small.alias("x").join(small.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.cid") < F.col("y.cid"))).select(F.col("x.cid").alias("a"), F.col("y.cid").alias("b"))
    ranked = signed.select("cid", F.array_sort(F.transform(F.arrays_zip("weights", "words"), lambda x: F.struct((-x["weights"]).alias("r"), x["words"].alias("w")))).alias("r"))
    reach = F.slice(F.col("r.w"), F.lit(1), (F.size("r") - _needed(F.size("r"), threshold) + 1).cast("int"))
    head = ranked.select("cid", F.size("r").alias("size"), F.posexplode(reach).alias("pos", "w"))
    dense = cut(shared.where(F.col("n") > hot).select("cid", "key").join(head, "cid"))
    parts = dense.groupBy("key", "w").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    dense = dense.join(parts, ["key", "w"]).withColumn("own", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    x, y = dense.alias("x"), dense.alias("y")
    most = F.least(F.col("x.size") - F.col("x.pos"), F.col("y.size") - F.col("y.pos"))  # words in common at this one or behind it
    least = F.ceil((F.col("x.size") + F.col("y.size")) * F.lit(threshold / (1 + threshold)) - F.lit(1e-9))
    met = (F.col("x.key") == F.col("y.key")) & (F.col("x.w") == F.col("y.w")) & (F.col("x.own") == F.col("y.other")) & (F.col("x.other") == F.col("y.own")) & (F.col("x.cid") < F.col("y.cid"))
    refined = x.join(y, met).where(most + F.least("x.pos", "y.pos") >= least).select(F.col("x.cid").alias("a"), F.col("y.cid").alias("b"))
    pairs = found.unionByName(refined).distinct()
    left, right = classes.select(F.col("cid").alias("a"), F.col("words").alias("wa")), classes.select(F.col("cid").alias("b"), F.col("words").alias("wb"))
    common = F.size(F.array_intersect("wa", "wb"))
    checked = pairs.join(left, "a").join(right, "b").select("a", "b", common.alias("c"), (F.size("wa") + F.size("wb") - common).alias("u"))
    return checked.where(F.col("c") * 1.0 >= F.col("u") * threshold - 1e-9).select("a", "b", (F.col("c") / F.col("u")).alias("jaccard"))


def duplicate_members(records: DataFrame, *, key: str = "id", title: str = "title", crops: str = "crops_covered") -> DataFrame:
    """(key, cid, rep, words, crop_list): cid is the class of equal word sets, rep the class of equal words and crops.
    Titles without a word and records with a null key are left out. Classes are 64-bit hashes of their content."""
    rows = records.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), word_set(F.col(title)).alias("words"), crop_set(crops).alias("crop_list")).where(F.size("words") > 0)
    return cut(rows.select("key", F.xxhash64(F.array_join("words", " ")).alias("cid"), F.xxhash64(F.array_join("words", " "), F.array_join("crop_list", ";")).alias("rep"), "words", "crop_list"))


def _links(members: DataFrame, threshold: float) -> DataFrame:
    """Linked pairs (rep_a, rep_b), rep_a < rep_b, of classes of equal words and crops; within one word set the pairs of different crop
    sets that share a crop."""
    with scratch():
        classes = members.groupBy("cid").agg(F.first("words").alias("words"))
        reps = cut(members.groupBy("rep").agg(F.first("cid").alias("cid"), F.first("crop_list").alias("crops")), keep=True)
        pairs = cut(similar_classes(cut(classes), threshold=threshold).select("a", "b"), keep=True)
    # a crop, or one mark for no crop: links are found by equality on (class pair, crop), not by all pairs of reps
    marks = reps.select("rep", "cid", F.explode(F.when(F.size("crops") > 0, F.col("crops")).otherwise(F.array(F.lit("")))).alias("crop"))
    x, y = marks.select(F.col("rep").alias("ra"), F.col("cid").alias("a"), "crop"), marks.select(F.col("rep").alias("rb"), F.col("cid").alias("b"), "crop")
    between = pairs.join(x, "a").join(y, ["b", "crop"]).select("ra", "rb")
    within = x.withColumnRenamed("a", "c").join(y.withColumnRenamed("b", "c"), ["c", "crop"]).where("ra < rb").select("ra", "rb")
    every = between.unionByName(within)
    return every.select(F.least("ra", "rb").alias("rep_a"), F.greatest("ra", "rb").alias("rep_b")).distinct()


def near_duplicate_pairs(records: DataFrame, *, threshold: float = 0.6, key: str = "id", title: str = "title", crops: str = "crops_covered") -> DataFrame:
    """All pairs (key_a, key_b), key_a < key_b, of records with similar titles and a common crop, or both without crop.

    Pairs are found between distinct contents and only then expanded to keys. Repeated keys give no pair with themselves.
    """
    members = duplicate_members(records, key=key, title=title, crops=crops)
    links = _links(members, threshold)
    same = members.select(F.col("rep").alias("rep_a"), F.col("rep").alias("rep_b")).distinct()
    a, b = members.select(F.col("rep").alias("rep_a"), F.col("key").alias("ka")), members.select(F.col("rep").alias("rep_b"), F.col("key").alias("kb"))
    out = links.unionByName(same).join(a, "rep_a").join(b, "rep_b").where((F.col("rep_a") != F.col("rep_b")) | (F.col("ka") < F.col("kb"))).where("ka <> kb")
    return out.select(F.least("ka", "kb").alias(f"{key}_a"), F.greatest("ka", "kb").alias(f"{key}_b")).distinct()


def components(edges: DataFrame, nodes: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, group): the smallest node of each connected component, for edges (a, b) and nodes (node).

    Alternates taking the smallest label of the neighbours with following labels to their labels, so rounds grow with the
    logarithm of a component's length. Labels stay distributed; every round is written to the shared folder.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(nodes.select("node", F.col("node").alias("group")))
    for _ in range(max_rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "group"), "b").groupBy("a").agg(F.min("group").alias("near"))
        lower = labels.join(near.withColumnRenamed("a", "node"), "node", "left").select("node", F.col("group").alias("was"), F.least("group", F.coalesce("near", "group")).alias("group"))
        jump = lower.select(F.col("node").alias("group"), F.col("group").alias("far"))
        new = cut(lower.join(jump, "group", "left").select("node", "was", F.least("group", F.coalesce("far", "group")).alias("group")))
        labels = new.select("node", "group")
        if not new.where("was <> group").limit(1).count():
            return labels
    raise RuntimeError("components did not settle")


def near_duplicate_groups(records: DataFrame, *, threshold: float = 0.6, key: str = "id", title: str = "title", crops: str = "crops_covered") -> DataFrame:
    """One row per record with a title: (key, group_id, group_size, n_links). group_id is the smallest key of the group;
    n_links counts the records it is directly linked to. Copies are never expanded to pairs."""
    with scratch():
        members = duplicate_members(records, key=key, title=title, crops=crops).dropDuplicates(["key"])
        links = cut(_links(members, threshold))
        sizes = cut(members.groupBy("rep").agg(F.count("*").alias("n"), F.min("key").alias("least")))
        labels = components(links.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")), sizes.select(F.col("rep").alias("node")))
        both = links.select(F.col("rep_a").alias("rep"), F.col("rep_b").alias("o")).unionByName(links.select(F.col("rep_b").alias("rep"), F.col("rep_a").alias("o")))
        degree = both.join(sizes.select(F.col("rep").alias("o"), F.col("n").alias("m")), "o").groupBy("rep").agg(F.sum("m").alias("others"))
        named = cut(sizes.join(labels.withColumnRenamed("node", "rep"), "rep").join(degree, "rep", "left"))
        groups = named.groupBy("group").agg(F.min("least").alias("group_id"), F.sum("n").alias("group_size"))
        reps = named.join(groups, "group").select("rep", "group_id", "group_size", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
        return cut(members.select("rep", "key").join(reps, "rep").select(F.col("key").alias(key), "group_id", "group_size", "n_links"), keep=True)
