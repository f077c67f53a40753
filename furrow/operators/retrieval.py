"""Lexical retrieval, fusion of rankings, and packing of a context."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from furrow.functions.text import tokenize
from furrow.session import cut, scratch, spread

K1, B, EPSILON = 1.5, 0.75, 0.25


_TERM = re.compile(r"[a-z0-9]+(?:'[a-z0-9]+)?")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = [Counter(_TERM.findall(t)) for t in batch.column(1).to_pylist()]
        cols = [pa.array([c.total() for c in counts], pa.int32()), pa.array([list(c) for c in counts], pa.list_(pa.string())), pa.array([list(c.values()) for c in counts], pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["key", "dl", "terms", "tfs"])


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, dl, terms, tfs), one row per document: its length in tokens, its distinct terms and their frequencies. They are counted
    where the document is, so nothing is shuffled. Keys must be unique; a null text has no terms."""
    rows = docs.select(F.col(key).alias("key"), F.lower(F.coalesce(text, F.lit(""))).alias("text"))
    return spread(rows).mapInArrow(_counted, f"key {dict(docs.dtypes)[key]}, dl int, terms array<string>, tfs array<int>").withColumnRenamed("key", key)


def corpus_stats(posts: DataFrame) -> DataFrame:
    """One row: number of documents and mean length in tokens (documents without token count with length 0)."""
    return posts.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))


def term_stats(posts: DataFrame, stats: DataFrame) -> DataFrame:
    """(term, df, idf): Okapi idf; a negative one becomes epsilon times the mean idf of all terms."""
    df = posts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(stats), F.lit(True))
    raw = df.select("term", "df", (F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg(F.avg("raw").alias("mean_idf"))
    return raw.join(F.broadcast(mean), F.lit(True)).select("term", "df", F.when(F.col("raw") < 0, F.col("mean_idf") * EPSILON).otherwise(F.col("raw")).alias("idf"))


@dataclass
class Index:
    """A sparse index: postings, one row of corpus statistics, and term statistics, each a stored table."""

    posts: DataFrame
    stats: DataFrame
    terms: DataFrame


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Index:
    """The index of a corpus. Texts are read and tokenised once; everything else reads the postings. The tables lie in the shared folder."""
    posts = cut(postings(docs, key, text))
    stats = cut(corpus_stats(posts))
    return Index(posts, stats, cut(term_stats(posts, stats)))


def save_index(index: Index, path: str) -> None:
    """Overwrites the three tables below ``path``."""
    for name in ("posts", "stats", "terms"):
        getattr(index, name).write.mode("overwrite").parquet(f"{path}/{name}")


def load_index(spark: SparkSession, path: str) -> Index:
    return Index(*(spark.read.parquet(f"{path}/{name}") for name in ("posts", "stats", "terms")))


@dataclass
class _Block:
    """Queries scored in one scan of the postings. A query is its base, the words it has in common with many others, and rare words; entry j of a base
    or of a rare word is one word of it. Words that occur in the same bases equally often share a row of the base weights."""

    words: pa.Array
    column: np.ndarray  # by word: its column among the words of bases, or -1
    idf: np.ndarray  # by column
    row: np.ndarray  # by column: its row of the weights
    weights: tuple[np.ndarray, np.ndarray, np.ndarray]  # row, base, value
    base_at: np.ndarray  # by base: where its entries begin
    base_column: np.ndarray
    base_weight: np.ndarray
    rare_at: np.ndarray  # by word: where its entries begin
    rare_query: np.ndarray
    rare_weight: np.ndarray
    base_of: np.ndarray  # by query


def _spans(at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries of each of ``which``, whose entries begin at ``at``: (place in ``which``, entry)."""
    n = at[which + 1] - at[which]
    place = np.repeat(np.arange(len(which)), n)
    return place, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + at[which][place]


def _scan(block: _Block, avgdl: float, k: int, cells: int, first_slot: int):
    """The k best documents of a partition, for each base and then for each query among the documents with a rare word of it; slots are numbered from
    ``first_slot``. Bases are scored in single precision against all documents; what may be among the best, by a bound on the error, is scored again."""
    n_bases, n_columns = len(block.base_at) - 1, len(block.idf)
    n_rows, n_slots = int(block.row.max(initial=-1)) + 1, n_bases + len(block.base_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.zeros((n_rows, n_bases), np.float32)
        weights[block.weights[0], block.weights[1]] = block.weights[2]
        owner = np.repeat(np.arange(n_bases), np.diff(block.base_at))
        margin = (n_rows + 8) * 2.0**-23 * (K1 + 1) * np.bincount(owner, np.abs(block.base_weight), n_bases) + 1e-8
        low = np.where(np.bincount(owner, block.base_weight < 0, n_bases) > 0, -margin, 0.0)  # what does not score above this is not among the best
        best, item, names, kind, begun = np.full((n_slots, k), -np.inf), np.full((n_slots, k), -1), None, None, False

        def exact(columns: np.ndarray, doc: np.ndarray, base: np.ndarray) -> np.ndarray:
            out, ends = np.zeros(len(doc)), np.cumsum(block.base_at[base + 1] - block.base_at[base])
            lo = 0
            while lo < len(doc):
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + cells // 4, "right")))
                place, entry = _spans(block.base_at, base[lo:hi])
                out[lo:hi] = np.bincount(place, columns[doc[lo:hi][place], block.base_column[entry]] * block.base_weight[entry], hi - lo)
                lo = hi
            return out

        def keep(slot: np.ndarray, doc: np.ndarray, score: np.ndarray) -> None:
            score = np.round(score, 9)
            slot, doc, score = (x[score > 0] for x in (slot, doc, score))
            own = np.unique(slot)
            was = item[own] >= 0
            slot, doc, score = np.r_[np.repeat(own, was.sum(1)), slot], np.r_[item[own][was], doc], np.r_[best[own][was], score]
            order = np.lexsort((names[doc], -score, slot))
            slot, doc, score = slot[order], doc[order], score[order]
            at = np.arange(len(slot)) - np.searchsorted(slot, slot)
            top = at < k
            best[slot[top], at[top]], item[slot[top], at[top]] = score[top], doc[top]
            own = own[own < n_bases]
            low[own] = np.maximum(low[own], best[own, k - 1] - margin[own])

        for whole in batches:
            kind, before = whole.schema.field(0).type, 0 if names is None else len(names)
            new = np.array(whole.column(0).to_pylist())
            names = new if names is None else np.r_[names, new]
            lists = whole.column(2)
            word = pc.index_in(terms := lists.flatten(), block.words.cast(terms.type)).fill_null(-1).to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(whole.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            tf, dl = (c.to_numpy(zero_copy_only=False) for c in (whole.column(3).flatten(), whole.column(1)))
            doc, word, tf = doc[word >= 0], word[word >= 0], tf[word >= 0]
            part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[doc] / avgdl))
            step = max(1, cells // max(1, n_bases, n_columns))
            for start in range(0, whole.num_rows, step):
                size = min(step, whole.num_rows - start)
                a, z = np.searchsorted(doc, [start, start + size])
                d, w, x = doc[a:z] - start, word[a:z], part[a:z]
                c = block.column[w]
                common = c >= 0
                columns = np.zeros((size, n_columns))
                columns[d[common], c[common]] = x[common]
                rows = np.bincount(d[common] * n_rows + block.row[c[common]], x[common] * block.idf[c[common]], size * n_rows).reshape(size, n_rows)
                scores = rows.astype(np.float32) @ weights
                if not begun and size >= k:  # no need to score all of the first documents twice
                    low, begun = np.maximum(low, np.partition(scores, size - k, axis=0)[size - k] - 2 * margin), True
                i, g = np.nonzero(scores > low.astype(np.float32))
                if len(i):
                    keep(g, i + before + start, exact(columns, i, g))
                place, entry = _spans(block.rare_at, w)
                if len(place):
                    pair, back = np.unique(d[place] * len(block.base_of) + block.rare_query[entry], return_inverse=True)
                    more = np.bincount(back, x[place] * block.rare_weight[entry])
                    i, q = pair // len(block.base_of), pair % len(block.base_of)
                    g = block.base_of[q]
                    near = scores[i, g] + more > np.maximum(low[g], best[n_bases + q, k - 1] - margin[g])
                    i, q, g, more = i[near], q[near], g[near], more[near]
                    keep(n_bases + q, i + before + start, exact(columns, i, g) + more)
        slot, n = np.nonzero(item >= 0)
        if len(slot):
            yield pa.RecordBatch.from_arrays([pa.array(slot + first_slot), pa.array(names[item[slot, n]].tolist(), kind), pa.array(best[slot, n])], ["slot", "key", "score"])

    return run


# Measured: scoring a document again for a query with a rare word of it takes as long as scoring so many bases against it.
PAIR_COST = 30


def _blocks(lists: pa.ListArray, n_docs: int, cells: int) -> Iterator[tuple[np.ndarray, _Block]]:
    """Blocks of the queries whose words (term, qtf, df, idf) are given, each with its queries' numbers."""
    entries = lists.flatten()
    query = np.repeat(np.arange(len(lists), dtype=np.int32), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    coded = pc.dictionary_encode(entries.field("term"))
    word, vocabulary = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
    qtf, df, idf = (entries.field(x).to_numpy(zero_copy_only=False) for x in ("qtf", "df", "idf"))
    of_word = np.zeros(len(vocabulary))
    of_word[word] = idf
    # Any limit between rare and common words gives the same result; that of the least work is taken. Rare words must not lower a score.
    marks = np.random.default_rng(0).integers(0, 2**63, len(vocabulary), np.uint64)[word] * qtf.astype(np.uint64)

    def work(limit: int) -> int:
        common, sums = (df > limit) | (idf < 0), np.zeros(len(lists), np.uint64)
        np.add.at(sums, query[common], marks[common])
        return PAIR_COST * int(df[~common].sum(dtype=np.int64)) + n_docs * len(np.unique(sums))

    limit = min([0, *(2**i for i in range(2, max(3, n_docs.bit_length())))], key=work)
    del marks
    common = (df > limit) | (idf < 0)
    q, w, n = query[common], word[common], qtf[common]
    ends = np.searchsorted(q, np.arange(len(lists) + 1))
    known: dict[bytes, int] = {}
    base_of = np.array([known.setdefault(w[a:z].tobytes() + n[a:z].tobytes(), len(known)) for a, z in zip(ends[:-1], ends[1:], strict=True)], np.int64)
    _, like = np.unique(base_of, return_index=True)  # a query of each base
    place, entry = _spans(ends, like)
    by = np.lexsort((place, w[entry]))
    width = max(1, cells // max(1, len(set(_patterns(w[entry][by], place[by], n[entry][by])[1].tolist()))))
    for first in range(0, len(like), width):
        mine = np.flatnonzero((base_of >= first) & (base_of < first + width))
        place, entry = _spans(ends, like[first : first + width])
        by = np.lexsort((place, w[entry]))
        columns, row = _patterns(w[entry][by], place[by], n[entry][by])
        column = np.full(len(vocabulary), -1)
        column[columns] = np.arange(len(columns))
        at = np.r_[0, np.cumsum(np.bincount(place, minlength=min(width, len(like) - first)))]
        number = np.full(len(lists), -1)
        number[mine] = np.arange(len(mine))
        rare = np.flatnonzero(~common & (number[query] >= 0))
        rare = rare[np.argsort(word[rare], kind="stable")]
        yield mine, _Block(
            vocabulary, column, of_word[columns], row, (row[column[w[entry]]], place, n[entry]), at, column[w[entry]], n[entry] * of_word[w[entry]],
            np.r_[0, np.cumsum(np.bincount(word[rare], minlength=len(vocabulary)))], number[query[rare]], qtf[rare] * idf[rare], base_of[mine] - first,
        )


def _patterns(word: np.ndarray, base: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words, in order, and for each the number of its pattern: the bases that hold it, and how often. Entries are in order of words and bases."""
    words, starts = np.unique(word, return_index=True)
    known: dict[bytes, int] = {}
    return words, np.array([known.setdefault(base[a:z].tobytes() + n[a:z].tobytes(), len(known)) for a, z in zip(starts, [*starts[1:], len(word)], strict=True)], np.int64)


def search_index(index: Index, queries: DataFrame, k: int, key: str = "doc_id", query_key: str = "query_id", query_text: str = "query", most: int = 100_000, cells: int = 4_000_000) -> DataFrame:
    """(query_id, key, score, rank): the k best documents of each query with a positive score. Query terms count as often as they are
    repeated. Ties go to the smaller key.

    Queries are taken in blocks of about ``most``, and so that their weights fill at most about ``cells`` cells; for each block the documents' term
    counts are scanned once, each document is scored where it lies, and only k rows per slot and partition are shuffled.

    Questions are alike but for a few rare words, such as names. A query's score is that of its common words, its *base*, plus that of its
    rare ones, which is never negative. So its best documents are among the best of its base and those that hold a rare word of it: each base is scored once against
    all documents, however many queries share it, and rare words are looked up from the documents that hold them.
    """
    spark = queries.sparkSession
    kind, key_kind = dict(queries.dtypes)[query_key], dict(index.posts.dtypes)[key]
    asked = queries.select(F.col(query_key).alias("query_id"), F.explode(tokenize(query_text)).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    known = asked.join(index.terms.select("term", "df", "idf"), "term")
    weighted = cut(known.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("term", F.col("qtf").cast("int").alias("qtf"), F.col("df").cast("int").alias("df"), "idf"))).alias("words")))
    told = index.stats.first()
    near, members = spark.createDataFrame([], f"slot long, key {key_kind}, score double"), spark.createDataFrame([], f"slot long, query_id {kind}")
    posts, slots = index.posts.select(F.col(key).alias("key"), "dl", "terms", "tfs"), 0
    blocks = max(1, -(-weighted.count() // max(1, min(most, cells // k))))
    for b in range(blocks if told and told.avgdl else 0):
        rows = weighted.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toArrow()
        if not rows.num_rows:
            continue
        ids, words = rows.column("query_id"), rows.column("words").combine_chunks()
        del rows
        for mine, block in _blocks(words, told.n_docs, cells):
            near = near.unionByName(posts.mapInArrow(_scan(block, told.avgdl, k, cells, slots), near.schema))
            n_bases = len(block.base_at) - 1
            slot = np.r_[slots + block.base_of, slots + n_bases + np.arange(len(mine))]
            table = pa.table({"slot": slot, "query_id": ids.take(pa.array(np.r_[mine, mine]))})
            members = members.unionByName(spark.createDataFrame(table, members.schema))
            slots += n_bases + len(mine)
    order = lambda of: Window.partitionBy(of).orderBy(F.desc("score"), "key")
    best = near.withColumn("rank", F.row_number().over(order("slot"))).where(F.col("rank") <= k)
    per = best.join(members, "slot").repartition("query_id").groupBy("query_id", "key").agg(F.max("score").alias("score"))
    ranked = per.withColumn("rank", F.row_number().over(order("query_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("key").alias(key), "score", "rank")


def bm25_search(docs: DataFrame, queries: DataFrame, k: int, key: str = "doc_id", text: str = "text", query_key: str = "query_id", query_text: str = "query") -> DataFrame:
    """``search_index`` over the index of ``docs``, which is dropped afterwards."""
    with scratch():
        return cut(search_index(build_index(docs, key, text), queries, k, key, query_key, query_text), keep=True)


def rrf_fuse(ranks: DataFrame, k: int, constant: int = 60) -> DataFrame:
    """(query_id, item_id, score, rank) from rows (query_id, ranker int, rank, item_id): sum of 1 / (constant + rank); ties go to the item of
    the earlier ranker, then of the better rank there."""
    per = ranks.groupBy("query_id", "item_id").agg(F.round(F.sum(1 / (F.lit(float(constant)) + F.col("rank"))), 12).alias("score"), F.min(F.struct("ranker", "rank")).alias("seen"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "seen", "item_id")
    return per.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "item_id", "score", "rank")


# The forms of a context.
HEADER, SUFFIX, NOTHING = "--- Document Chunk [%s] ---\n", " [...truncated]", "No relevant document passages found."


def pack_context(hits: DataFrame, budget: int = 5600, text: str = "text", rank: str = "rank", source: str = "source_id", key: str = "item_id", queries: DataFrame | None = None) -> DataFrame:
    """(query_id, context, used, source_ids): texts in rank order, each under a header with its source, within a budget of characters.

    A text longer than what is left is cut at its last blank and marked; the cut may leave budget for a piece of the next one. Texts are
    taken until nothing is left. The header names the key where the source is null or empty; ``source_ids`` are the
    distinct sources in order. Null texts are empty. Queries of ``queries`` without hits get the text that says so. A query's hits are the
    few that its retrieval returned.
    """
    item = F.struct(F.col(rank).alias("r"), F.coalesce(F.col(text), F.lit("")).alias("t"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("s"), F.col(key).cast("string").alias("k"))
    lists = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("xs"))
    if queries is not None:
        lists = queries.select("query_id").distinct().join(lists, "query_id", "left")
    none = F.array().cast("array<string>")
    start = F.struct(F.lit(budget).alias("left"), none.alias("out"), none.alias("src"))

    def step(acc, x):
        left = acc["left"]
        part = F.concat(F.regexp_replace(F.substring(x["t"], F.lit(1), left), r" [^ ]*\z", ""), F.lit(SUFFIX))
        body = F.when(F.length(x["t"]) > left, part).otherwise(x["t"])
        named = F.concat(F.lit(HEADER.split("%s")[0]), F.when(x["s"] != "", x["s"]).otherwise(x["k"]), F.lit(HEADER.split("%s")[1]), body)
        src = F.when(x["s"] != "", F.concat(acc["src"], F.array(x["s"]))).otherwise(acc["src"])
        return F.when(left <= 0, acc).otherwise(F.struct((left - F.length(body)).alias("left"), F.concat(acc["out"], F.array(named)).alias("out"), src.alias("src")))

    done = lists.select("query_id", F.aggregate(F.coalesce("xs", F.array().cast(dict(lists.dtypes)["xs"])), start, step).alias("a"))
    return done.select("query_id", F.when(F.size("a.out") > 0, F.array_join("a.out", "\n\n")).otherwise(NOTHING).alias("context"), F.size("a.out").alias("used"), F.array_distinct("a.src").alias("source_ids"))
