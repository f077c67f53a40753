"""Problem 8: passages that occur word for word in more than one document.

Method: Rabin-Karp fingerprints of every fixed-length window, counted in Spark; repeated windows merge into maximal intervals. The
token is the code point, since the passages asked for are runs of ``length`` code points: a window of ``length`` tokens is then
repeated exactly if it is such a passage, and no pair of texts is ever compared.

Two counts keep the shuffle small. First the windows of ``window`` tokens: of each run of length - window + 1 of them, which is
one window of the full length, the least fingerprint (its anchor) is counted (winnowing: one position in about (length - window) / 2).
A full window can only be repeated if its anchor is. Then all full windows with a repeated anchor are counted, every one of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.session import cut, scratch

LENGTH, WINDOW = 200, 100
ROWS_A_TASK = 400_000  # windows that one task counts: about 10 MB
SMALL = 500_000  # class numbers that may be broadcast: 8 bytes each
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """Powers 0 .. n - 1 of an odd base modulo 2^64, kept between calls."""
    name = str(base)
    if name not in _powers or len(_powers[name]) < n:
        p = np.full(max(n, 1 << 16), _U(base))
        p[0] = 1
        _powers[name] = np.cumprod(p)
    return _powers[name][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def window_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """Rabin-Karp fingerprints of all windows of k code points, modulo 2^64, of mixed code points."""
    n = len(points)
    if n < k:
        return np.empty(0, _U)
    sums = np.zeros(n + 1, _U)
    np.cumsum(_mix(points.astype(_U) * _U(_BASE) + _U(1)) * _power(_BASE, n), out=sums[1:])
    return _mix((sums[k:] - sums[:-k]) * _power(_INVERSE, n)[: n - k + 1])


def least_of_runs(hashes: np.ndarray, run: int) -> np.ndarray:
    """The least hash of every run of ``run`` windows; empty if there are fewer."""
    n = len(hashes)
    if n < run:
        return hashes[:0]
    blocks = np.full(-(-n // run) * run, _U(2**64 - 1))
    blocks[:n] = hashes
    blocks = blocks.reshape(-1, run)
    up = np.minimum.accumulate(blocks, axis=1).ravel()
    down = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(down[: n - run + 1], up[run - 1 : n])


def _anchors(length: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(least_of_runs(window_hashes(code_points(t), window), length - window + 1)) for t in batch.column(1).to_pylist()]
            keys = np.repeat(np.asarray(batch.column(0)), [len(x) for x in found])
            prints = np.concatenate([*found, np.empty(0, _U)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(prints, pa.int64())], ["cls", "print"])

    return run


_WINDOWS = "cls long, s int, w long, c int, salt int, salts int"


def _full_windows(length: int, window: int):
    """All windows of the full length whose anchor is one of the text's repeated ones: where they start, their fingerprint, part of their
    anchor, and the salt of the class among as many as the anchor needs. A start is written as s, or as -1 - s if the text has this window
    before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cls, text, prints, salts in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                points = code_points(text)
                anchor = least_of_runs(window_hashes(points, window), length - window + 1)
                known = np.array(prints, np.int64).view(_U)
                order = np.argsort(known)
                known, parts = known[order], np.array(salts, np.int32)[order]
                at = np.searchsorted(known, anchor)
                at[at == len(known)] = 0
                s = np.flatnonzero(known[at] == anchor)
                w, n = window_hashes(points, length)[s], parts[at[s]]
                again = np.ones(len(s), bool)
                again[np.unique(w, return_index=True)[1]] = False
                salt = (_mix(np.array([cls], np.int64).view(_U)) % n.astype(_U)).astype(np.int32)
                cols = [np.full(len(s), cls, np.int64), np.where(again, -1 - s, s).astype(np.int32), w.view(np.int64), (anchor[s] & _U(0x7FFFFFFF)).astype(np.int32), salt, n]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["cls", "s", "w", "c", "salt", "salts"])

    return run


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Intervals sorted, and merged where they touch or overlap."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def text_classes(docs: DataFrame, key: str, text: str, length: int) -> tuple[DataFrame, DataFrame]:
    """Membership (key, cls, n) of texts of at least ``length`` code points that occur more than once, and the repeated classes. cls is the
    smallest key that holds exactly this text. Texts are told apart by two 64-bit hashes and the length."""
    prints = docs.where(F.length(text) >= length).select(F.col(key).cast("long").alias("key"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(7), F.reverse(text)).alias("h2"), F.length(text).alias("n")).where("key is not null")
    prints = cut(prints)
    ids = prints.groupBy("h1", "h2", "n").agg(F.min("key").alias("cls"), F.count("*").alias("copies"))
    repeated = cut(ids.where("copies > 1"))
    members = prints.join(repeated.drop("copies"), ["h1", "h2", "n"]).select("key", "cls", "n").distinct()
    return cut(members, keep=True), repeated


def repeated_windows(docs: DataFrame, *, key: str = "doc_id", text: str = "text", length: int = LENGTH, window: int = WINDOW, hot: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """(rows, members). rows (cls, s, first, n, g): every window of ``length`` code points, by its start ``s`` in the text of class
    ``cls``, that n > 1 different texts hold; g names the set of these texts. members (key, cls, n): texts that occur more than once.

    Windows are told apart by 95 bits. The windows of an anchor that more than ``hot`` texts hold are salted by text: each part is
    counted on its own and the parts are added up, so no task holds all rows of a window.
    """
    with scratch():
        members, _ = text_classes(docs, key, text, length)
        extra = members.where("key <> cls").select(F.col("key").alias("extra"))
        long = docs.where(F.length(text) >= length).select(F.col(key).cast("long").alias("cls"), F.col(text).alias("text")).where("cls is not null")
        singles = long.join(extra, long["cls"] == extra["extra"], "left_anti")
        prints = cut(singles.mapInArrow(_anchors(length, window), "cls long, print long"))
        counts = cut(prints.groupBy("print").agg(F.count("*").alias("n")).where("n > 1").select("print", F.ceil(F.col("n") / hot).cast("int").alias("salts")))
        # one row per text; its list is no longer than the text
        lists = cut(prints.join(counts, "print").groupBy("cls").agg(F.collect_list(F.struct("print", "salts")).alias("v")))
        told = lists.agg(F.count("*").alias("texts"), F.sum(F.size("v")).alias("anchors")).first()
        if told.texts <= SMALL:  # then texts without repeated anchor are left out before the shuffle
            singles = singles.join(F.broadcast(lists.select("cls")), "cls", "left_semi")
        rows = singles.join(lists, "cls").select("cls", "text", F.col("v.print").alias("p"), F.col("v.salts").alias("n")).mapInArrow(_full_windows(length, window), _WINDOWS)
        texts, members_of = F.count_if(F.col("s") >= 0).alias("n"), F.bit_xor(F.when(F.col("s") >= 0, F.xxhash64("cls"))).alias("g")
        # counted and looked up again in one shuffle: both plans read the same exchange
        # an anchor is that of about half the runs it lies in
        spread = max(docs.sparkSession.sparkContext.defaultParallelism, (told.anchors or 0) * (length - window + 1) // 2 // ROWS_A_TASK + 1)
        placed = rows.where("salts = 1").repartition(spread, "w", "c")
        several = placed.groupBy("w", "c").agg(texts, members_of).where("n > 1").select("w", "c", "n", "g")
        found = placed.join(several, ["w", "c"]).select("cls", F.when(F.col("s") < 0, -1 - F.col("s")).otherwise(F.col("s")).alias("s"), (F.col("s") >= 0).alias("first"), "n", "g")
        if counts.where("salts > 1").limit(1).count():
            crowd = cut(rows.where("salts > 1"))
            parts = crowd.groupBy("w", "c", "salt").agg(texts, members_of)
            whole = parts.groupBy("w", "c").agg(F.sum("n").alias("n"), F.bit_xor("g").alias("g")).where("n > 1")
            salted = parts.select("w", "c", "salt").join(whole, ["w", "c"])
            found = found.unionByName(crowd.join(salted, ["w", "c", "salt"]).select("cls", F.when(F.col("s") < 0, -1 - F.col("s")).otherwise(F.col("s")).alias("s"), (F.col("s") >= 0).alias("first"), "n", "g"))
        return cut(found, keep=True), members


def class_pairs(rows: DataFrame, block: int = 1000) -> DataFrame:
    """Pairs (a, b), a < b, of classes that hold a common window. Windows held by the same set of texts are one group; the pairs of a group
    of more than ``block`` texts are formed block by block, so no task forms all of them."""
    groups = cut(rows.where("first").select("g", "n", "cls").distinct())
    parts = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("cls"), parts).cast("int")
    every = F.sequence(F.lit(0), parts - 1)
    x = groups.select("g", "n", F.col("cls").alias("a"), own.alias("i"), F.explode(every).alias("j"))
    y = groups.select("g", "n", F.col("cls").alias("b"), own.alias("j"), F.explode(every).alias("i"))
    return x.join(y, ["g", "n", "i", "j"]).where("a < b").select("a", "b").distinct()


def sharing_pairs(docs: DataFrame, *, key: str = "doc_id", text: str = "text", length: int = LENGTH, **how) -> DataFrame:
    """All pairs (key_a, key_b), key_a < key_b, of documents whose texts, exactly as stored, have a common run of at least
    ``length`` code points. Exact copies are pairs of each other and share the pairs of their text. Null, short
    and keyless texts have none; keys should be unique (a repeated key makes no pair with itself).
    """
    with scratch():
        rows, members = repeated_windows(docs, key=key, text=text, length=length, **how)
        links = class_pairs(rows)
        a = members.select(F.col("cls").alias("a"), F.col("key").alias("ka"))
        b = members.select(F.col("cls").alias("b"), F.col("key").alias("kb"))
        wide = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ka", "a").alias("ka"), F.coalesce("kb", "b").alias("kb"))
        copies = a.join(b, F.col("a") == F.col("b")).where("ka < kb").select("ka", "kb")
        out = wide.unionByName(copies)
        return cut(out.select(F.least("ka", "kb").alias(f"{key}_a"), F.greatest("ka", "kb").alias(f"{key}_b")).where(f"{key}_a <> {key}_b").distinct(), keep=True)


def _merge(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [merge_spans([(s, s + length) for s in starts]) for starts in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([[{"s": s, "e": e} for s, e in x] for x in spans], pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))), batch.column(2)], ["cls", "spans", "most"])

    return run


def shared_parts(docs: DataFrame, *, key: str = "doc_id", text: str = "text", length: int = LENGTH, **how) -> DataFrame:
    """One row per document: its length, how many of its characters lie in passages shared with others, their share, the number
    of maximal intervals and the intervals, the most different texts that hold one window of it, and the smallest key with
    exactly the same text. No pair is formed. Documents without shared passage have zeros and an empty text; the share of an empty or
    null text is 0.
    """
    with scratch():
        rows, members = repeated_windows(docs, key=key, text=text, length=length, **how)
        # the starts of one text: no more than its characters
        per = rows.groupBy("cls").agg(F.collect_list("s").alias("starts"), F.max("n").alias("most")).mapInArrow(_merge(length), "cls long, spans array<struct<s:int,e:int>>, most long")
        whole = members.groupBy("cls").agg(F.first("n").alias("n"))
        per = per.join(whole, "cls", "full").select("cls", F.when(F.col("n").isNotNull(), F.array(F.struct(F.lit(0).alias("s"), F.col("n").alias("e")))).otherwise(F.col("spans")).alias("spans"), F.coalesce("most", F.lit(1)).alias("most"))
        slim = docs.select(F.col(key).alias("key"), F.coalesce(F.length(text), F.lit(0)).alias("n_chars")).join(members.select("key", "cls"), "key", "left").withColumn("cls", F.coalesce("cls", "key"))
        out = slim.join(per, "cls", "left").withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<s:int,e:int>>")))
        covered = F.aggregate("spans", F.lit(0), lambda acc, x: acc + x["e"] - x["s"])
        return cut(out.select(
            F.col("key").alias(key), "n_chars", covered.alias("shared_chars"), F.when(F.col("n_chars") > 0, F.round(covered / F.col("n_chars"), 6)).otherwise(0.0).alias("shared_share"),
            F.size("spans").alias("n_intervals"), F.array_join(F.transform("spans", lambda x: F.concat_ws("-", x["s"], x["e"])), ",").alias("intervals"), F.coalesce("most", F.lit(0)).alias("most_texts"), F.col("cls").alias("text_class"),
        ), keep=True)
