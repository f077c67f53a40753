"""Training-data operators against brute force, and their edge cases: nulls, empty and long texts, ties, repeats, empty tables, clashing names."""

from __future__ import annotations

import itertools
import random
from collections import Counter, defaultdict
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow.llm import cap_contributors as cap
from furrow.llm import keep_fraction as keep
from furrow.llm import mix as mixing
from furrow.llm import near_duplicates as near
from furrow.llm import pack as packing
from furrow.llm import pair_defects as defects
from furrow.llm import shared_spans as spans
from furrow.llm import split_chunks as split
from furrow.llm.common import _words

NAN = float("nan")


def records(spark, rows):
    # extra columns with names the operators use inside must pass through unharmed
    return spark.createDataFrame(rows, "id string, publisher string, score double").withColumns({"key": F.lit(1), "who": F.lit("x"), "rank": F.lit(2), "k": F.lit("k"), "s": F.lit(0.0)})


def manifest_rows(seed: int, n: int = 2000):
    rng = random.Random(seed)
    names = ["Big Press", "big  press ", "BIG PRESS", "Small", None, " ", "Mid"]
    return [(f"r{i:05d}", rng.choices(names, [4, 2, 2, 1, 0.3, 0.2, 2])[0], rng.choice([None, NAN, *[float(x) for x in range(0, 100, 7)]])) for i in range(n)]


# --- 1 ------------------------------------------------------------------------------------------------------------------------


def norm(p):
    return " ".join(p.lower().split()) if p and p.strip() else None


@pytest.mark.parametrize("pct", [0, 1, 33, 50, 99, 100])
def test_cutoffs_match_brute_force(spark, pct):
    rows = manifest_rows(pct)
    targets = spark.createDataFrame([("Big press", pct), ("MID", pct), ("Nobody", 5), (None, 3), ("Small", None)], "publisher string, target_pct int")
    got = {r.source: r for r in keep.source_cutoffs(records(spark, rows), targets).collect()}
    assert set(got) == {"big press", "mid", "nobody"} and got["nobody"].cutoff is None
    for who in ("big press", "mid"):
        scores = [s for _, p, s in rows if norm(p) == who and s is not None and s == s]
        want = max(c for c in scores if 100 * sum(s >= c for s in scores) >= pct * len(scores))
        assert (got[who].cutoff, got[who].n_kept, got[who].n_records) == (want, sum(s >= want for s in scores), len(scores))
    cuts = keep.source_cutoffs(records(spark, rows), targets)
    kept = keep.keep_by_cutoff(records(spark, rows), cuts)
    assert "k" in kept.columns and kept.count() == sum(r.n_kept for r in got.values())


def test_cutoffs_of_awkward_scores_and_tables(spark):
    targets = spark.createDataFrame([("a", 50)], "publisher string, target_pct int")
    one = lambda xs: keep.source_cutoffs(records(spark, [(str(i), "a", x) for i, x in enumerate(xs)]), targets).first()
    assert one([5.0] * 9).cutoff == 5.0
    assert one([float("inf"), 1.0, float("-inf")]).cutoff == 1.0
    assert one([1e300, -1e300, 1e-300, 0.0]).cutoff == 1e-300
    assert one([None, NAN]).n_records == 0
    assert keep.source_cutoffs(records(spark, [("x", "a", 1.0)]).limit(0), targets).first().cutoff is None
    assert keep.source_cutoffs(records(spark, [("x", "a", 1.0)]), targets.limit(0)).count() == 0


# --- 2 ------------------------------------------------------------------------------------------------------------------------


def random_text(rng, n):
    kinds = ["word", "Word.", "longer-word!", "\n\n", "\n", "- item", "x" * rng.choice([5, 300]), "  ", "é中"]
    out = ""
    while len(out) < n:
        out += rng.choice(kinds) + rng.choice([" ", " ", "", "\n"])
    return out


@pytest.mark.parametrize("table", [False, True])
def test_pieces_are_within_limits_and_lossless(table):
    rng = random.Random(5)
    texts = [random_text(rng, n) for n in (0, 10, 1801, 2500, 9000)] + ["z" * 5000, "\n" * 4000, "| a | b |\n" * 700, "a" * 1800, "a" * 1801, " " * 1900]
    for text in texts:
        pieces = split.split_text(text, table)
        assert all(0 <= a <= f <= b and b - a <= split.LIMIT and f - a <= split.OVERLAP for a, f, b in pieces)
        assert "".join(text[f:b] for _, f, b in pieces) == text
        assert len(pieces) > 1 or len(text) <= split.LIMIT
        if table:
            assert all(a == f for a, f, _ in pieces)


def test_cuts_are_optimal_and_natural():
    text = "".join(f"Sentence number {i} is here. " for i in range(150))
    for _, _, b in split.split_text(text)[:-1]:
        assert text[:b].endswith(". ")
    rows = "".join(f"| row {i} | {'v' * 40} |\n" for i in range(120))
    assert all(rows[:b].endswith("\n") for _, _, b in split.split_text(rows, True))
    # small case against all choices of cuts
    text, limit, over = "aa bb. cc dd ee. ff gg hh. ii jj", 14, 3
    marks = split.boundaries(text, False)
    room = limit - over
    pieces = -(-len(text) // room)
    even = len(text) / pieces

    def cost(cuts):
        total, last = 0.0, 0
        for c in (*cuts, len(text)):
            if c - last > (limit if last == 0 else room):
                return float("inf")
            total += ((c - last - even) / even) ** 2 + 0.25 + (marks[c] if c < len(text) else 0)
            last = c
        return total

    best = min(cost(c) for k in range(6) for c in itertools.combinations(sorted(marks), k))
    got = [b for _, _, b in split.split_text(text, False, limit, over)][:-1]
    assert cost(got) == pytest.approx(best)


def test_long_rows_are_cut_at_cells_or_words():
    cells = "| head |\n" + "| " + " | ".join(f"cell{i:04}x" for i in range(400)) + " |\n| end |"
    words = "| " + " ".join(f"word{i:04}" for i in range(500)) + " |\n| end |"
    for text, mark in ((cells, "| "), (words, " ")):
        pieces = split.split_text(text, True)
        assert "".join(text[f:b] for _, f, b in pieces) == text and all(b - a <= split.LIMIT for a, _, b in pieces)
        assert len(pieces) > 2 and all(text[:b].endswith((mark, "\n")) for _, _, b in pieces[:-1])


def test_a_table_flag_on_prose_is_not_believed(spark):
    text = "\n".join("A sentence on maize. Another one on rice." * 9 for _ in range(9))
    df = spark.createDataFrame([("a", 1, text, True)], "chunk_id string, chunked_at int, text string, is_table boolean")
    got = split.split_oversized(df).collect()
    assert len(got) > 1 and max(r.overlap_chars for r in got) > 0


def test_only_current_versions_count(spark):
    t = lambda d: datetime(2024, 1, d)
    long = "One. " * 500
    rows = [("a", t(1), long, False), ("a", t(2), "short", False), ("b", t(1), "short", None), ("b", t(3), long, None), ("b", t(3), long, None), ("c", None, long, True), (None, t(1), long, False), ("d", t(1), None, False), ("e", t(1), "", False)]
    df = spark.createDataFrame(rows, "chunk_id string, chunked_at timestamp, text string, is_table boolean").withColumns({"at": F.lit(1), "print": F.lit(2), "piece": F.lit(3)})
    got = split.split_oversized(df)
    assert {r.chunk_id for r in got.collect()} == {"b", "c"}
    assert got.groupBy("chunk_id", "piece").count().where("count > 1").count() == 0
    assert split.split_oversized(df.limit(0)).count() == 0


# --- 3 ------------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("share,most", [(0.05, None), (0.3, None), (None, 10), (0.5, 25), (0.0001, None)])
def test_caps_match_sorting(spark, share, most):
    rows = manifest_rows(11, 1500) + [(f"t{i:05d}", "Ties", 50.0) for i in range(700)] + [("inf", "Mid", float("inf"))]
    caps = [x for x in (int(len(rows) * share + 1e-9) if share else None, most) if x is not None]
    groups = defaultdict(list)
    for i, p, s in rows:
        if norm(p):
            groups[norm(p)].append((-(s if s is not None and s == s else float("-inf")), s is None or s != s, i))
    want = {i for g in groups.values() for _, _, i in sorted(g, key=lambda x: (x[1], x[0], x[2]))[min(caps) :]}
    df = records(spark, rows).repartition(5)
    assert {r.id for r in cap.over_cap(df, max_share=share, max_count=most).collect()} == want
    left = cap.cap_contributors(df, max_share=share, max_count=most)
    assert left.count() == len(rows) - len(want) and left.columns == df.columns
    assert cap.over_cap(df.limit(0)).count() == 0


# --- 4 ------------------------------------------------------------------------------------------------------------------------


def works(seed=2, n=250):
    rng = random.Random(seed)
    common = "report of growing trial for farmers in the north and south on".split()
    rows, titles = [], []
    for i in range(n):
        if titles and rng.random() < 0.5:
            w = list(rng.choice(titles))
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = rng.choice(["X1", "maíze", "pdf", f"n{i}"])
            rng.shuffle(w)
        else:
            w = rng.sample(common, 6) + [f"Pláce{rng.randrange(200)}", f"code{i}", f"v{rng.randrange(400)}"]
        titles.append(w)
        rows.append((f"d{i:04d}", " ".join(w), rng.choice(["maize;Rice", " RICE ; ", "", None, "yam"])))
    return rows + [("e1", None, None), ("e2", "", ""), ("e3", "!!!", "x"), ("s1", "Rice", None), ("s2", "rice!", ""), ("s3", "RICE", "yam"), ("L", "long " * 5000, None), ("d0000", rows[0][1], rows[0][2])]


def linked(a, b):
    wa, wb = set(_words(a[1])), set(_words(b[1]))
    ca, cb = ({x.strip().lower() for x in (r[2] or "").split(";") if x.strip()} for r in (a, b))
    return wa and wb and len(wa & wb) >= 0.6 * len(wa | wb) - 1e-9 and (ca & cb or not (ca or cb))


@pytest.mark.parametrize("hot", [300, 2])
def test_duplicate_pairs_and_groups(spark, monkeypatch, hot):
    rows = works()
    df = spark.createDataFrame(rows, "id string, title string, crops_covered string").withColumns({"key": F.lit(0), "cid": F.lit(0), "words": F.lit("w"), "rep": F.lit(1)})
    want = {tuple(sorted((a[0], b[0]))) for a, b in itertools.combinations(rows, 2) if a[0] != b[0] and linked(a, b)}
    real = near.similar_classes
    monkeypatch.setattr(near, "similar_classes", lambda c, **k: real(c, **k, hot=hot, block=3))
    got = {(r.id_a, r.id_b) for r in near.near_duplicate_pairs(df).collect()}
    assert got <= want and len(got) >= 0.995 * len(want)
    if hot == 2:
        return
    parent = {r[0]: r[0] for r in rows if _words(r[1])}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in sorted(got):
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    groups = {r.id: r for r in near.near_duplicate_groups(df).collect()}
    assert set(groups) == set(parent)
    degree = Counter(x for p in got for x in p)
    for k, r in groups.items():
        assert find(k) == find(r.group_id) and r.n_links == degree[k]
    assert near.near_duplicate_pairs(df.limit(0)).count() == 0


def test_prob_minhash_estimates_probability_jaccard():
    rng = np.random.default_rng(0)
    words = rng.integers(1, 2**60, 12).astype(np.uint64)
    wa, wb = rng.random(12) + 0.05, rng.random(12) + 0.05
    wa[:3], wb[-3:] = 1e-9, 1e-9
    sig = near.prob_minhash(np.r_[words, words], np.r_[wa, wb], np.array([0, 12, 24]), 4096)
    jp = sum(1 / sum(max(wa[j] / wa[i], wb[j] / wb[i]) for j in range(12)) for i in range(12))
    assert abs((sig[0] == sig[1]).mean() - jp) < 0.04


# --- 5 ------------------------------------------------------------------------------------------------------------------------


def qa_rows():
    rng = random.Random(4)
    gold = ["Use {} kg of seed per hectare.", "Plant maize in April, once about {} mm of rain has fallen.", "These signs point to rust. Burn the affected plants within {} days."]
    french = "Il faut sarcler {} jours après le semis, puis une seconde fois avant la floraison."
    rows, want = [], {}
    for i in range(600):
        q = f"How much seed does maize need on {i} hectares of the farm near Borolo?"
        g = rng.choice(gold).format(rng.randrange(10, 99))
        a = rng.choice(gold).format(rng.randrange(10, 99))
        bad = rng.choice([None] * 8 + list(defects.DEFECTS))
        if bad == "empty":
            a = rng.choice([None, "", "  ", "N/A", "null", "{}", "Error: the generator returned nothing"])
        elif bad == "copy":
            a = rng.choice([q, q.upper(), f'"{q}"', q.replace("seed", "of the seed")])
        elif bad == "refusal":
            a = rng.choice(["I'm sorry, but I can't help with that.", "Unfortunately, I must decline.", "I am not able to answer this."])
        elif bad == "truncated":
            a = rng.choice(["Use 12 kg of seed per", "Plant maize in April, once about 5 mm of", '{"crop": "maize", "area', "Use 20 kg of seed per hectare, but", "Burn the…"])
        elif bad == "language":
            a = french.format(i)
        elif i % 7 == 0:
            a = a.rstrip(".")  # a complete answer may lack its stop
        elif i % 29 == 0:
            a, g = "Sorry, I must decline.", "The system has to refuse this one."
        rows.append((f"q{i}", q, a, g, None, datetime(2024, 1, 2)))
        if bad:
            want[f"q{i}"] = bad
    rows += [("q0", "old", "old", "old", None, datetime(2024, 1, 1)), ("f1", None, None, None, "failed", datetime(2024, 1, 1)), (None, "q", None, None, None, datetime(2024, 1, 1)), ("n1", None, "Use 5 kg of seed per hectare.", None, None, datetime(2024, 1, 1)), ("l1", "How long is this text on the farm?", "Use 5 kg of seed per hectare. " * 3000, None, None, datetime(2024, 1, 1))]
    return rows, want


def test_defects_of_planted_pairs(spark):
    rows, want = qa_rows()
    df = spark.createDataFrame(rows, "id string, question string, answer_text string, gold_answer string, error string, answered_at timestamp").withColumns({"d": F.lit(1), "p": F.lit(2), "segs": F.lit("x")})
    got = {r.id: r.defect_type for r in defects.defective_pairs(df).collect()}
    right = sum(want.get(k) == v for k, v in got.items())
    assert right >= 0.95 * len(got) and right >= 0.95 * len(want)
    assert "f1" not in got and "n1" not in got and "l1" not in got
    assert defects.defective_pairs(df.limit(0)).count() == 0


def test_label_model_prefers_reliable_votes():
    # on labelled pairs the first function is right, the second guesses
    labelled = [((1, 1), True, 50), ((1, -1), True, 50), ((-1, 1), False, 45), ((-1, -1), False, 55), ((0, 0), False, 10)]
    rates = defects.vote_rates(labelled)
    assert rates[1, 1, 0] > 0.9 > 0.1 > rates[0, 1, 0] and abs(rates[1, 1, 1] - rates[0, 1, 1]) < 0.15
    post, fitted, share = defects.fit_labels([((1, 1), 50), ((-1, -1), 900), ((1, -1), 5), ((0, 0), 45)], rates)
    assert post[(1, 1)] > 0.8 > 0.1 > post[(-1, -1)] and post[(1, -1)] > 0.5 > post[(0, 0)] and 0.03 < share < 0.1
    assert 0.5 <= defects.best_cutoff(labelled, fitted, share) < 1
    assert defects.fit_labels([], rates)[0] == {}


def test_labelled_pairs_are_what_they_say():
    import pyarrow as pa

    gold = "Plant the maize in rows before the first rains of April. Thin to one plant per stand after two weeks."
    rows = [(f"B{i}", f"When should I plant maize in field {i}?", "x", gold) for i in range(60)] + [("C", "Quand faut-il semer le maïs dans les champs?", "x", "Il faut semer le maïs dans les champs avant les pluies.")]
    out = next(defects._labelled(iter([pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["id", "q", "a", "g"])]))).to_pylist()
    assert {r["label"] for r in out} == {"", "copy", "empty", "truncated", "language"}
    cut_off = [r["a"] for r in out if r["label"] == "truncated"]
    assert all(a != gold for a in cut_off) and any(a.startswith("{") for a in cut_off) and sum(gold.startswith(a) for a in cut_off) > 20
    assert all(r["g"] == gold or r["id"].endswith("\nC") for r in out) and len({r["id"] for r in out}) == len(out)
    assert next(defects._labelled(iter([]))).num_rows == 0


# --- 6 ------------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(4))
def test_packing_keeps_every_item_once_and_is_tight(seed):
    rng = random.Random(seed)
    sizes = [min(100, max(1, int(rng.gammavariate(2, 15)))) for _ in range(rng.choice([0, 1, 30, 4000]))]
    plan = packing.pack_histogram(Counter(sizes), 100, groups=20, small_share=1 / 3)
    got = Counter()
    for times, content in plan:
        assert times > 0 and sum(s * k for s, k in content.items()) <= 100
        for s, k in content.items():
            got[s] += times * k
    assert got == Counter(sizes)
    used, bound = sum(t for t, _ in plan), -(-sum(sizes) // 100)
    assert used <= 1.03 * bound + 2


def test_grouping_is_even_and_configurations_fit():
    groups = packing.linear_groups([(9, 5), (7, 4), (5, 3)], 4)
    assert [sum(c for _, c in g) for g in groups] == [3, 3, 3, 3]
    plan = packing.configurations([50, 34], [10, 9], 100)
    assert all(50 * a + 34 * b <= 100 for _, (a, b) in plan) and sum(t for t, _ in plan) >= 7


def test_packed_documents(spark):
    words = "maize cassava yam " * 3
    texts = [None, "", " ", *[words * k for k in (1, 1, 2, 5, 40, 400, 900)], "é\U0001f33d" * 3000]
    df = spark.createDataFrame(list(enumerate(texts)) + [(3, words)], "doc_id long, text string").withColumns({"size": F.lit(1), "n_tokens": F.lit(1), "rank": F.lit(0)})
    rows = packing.pack(df, capacity=256).collect()
    load, parts = Counter(), defaultdict(list)
    for r in rows:
        if r.container_id is not None:
            load[r.container_id] += r.n_tokens
        parts[r.doc_id].append((r.piece, r.token_start, r.token_end))
    assert set(parts) == set(range(len(texts))) and max(load.values()) <= 256
    assert set(load) == set(range(len(load)))
    for k, ps in parts.items():
        if k != 3:
            ps.sort()
            assert ps[0][1] == 0 and all(x[2] == y[1] for x, y in zip(ps, ps[1:])) and all(e - s == 256 for _, s, e in ps[:-1])
    assert packing.pack(df.limit(0)).count() == 0
    assert packing.fill_report(packing.pack(df.limit(0))).first().containers == 0


# --- 7 ------------------------------------------------------------------------------------------------------------------------


def test_pfair_deviates_less_than_one_block():
    for parts in ({"a": 5, "b": 5}, {"a": 22, "b": 14, "c": 61, "d": 3}, {"a": 901, "b": 70, "c": 3, "d": 1}, {"a": 1}, {"a": 7, "b": 0}):
        h = sum(parts.values())
        done = Counter()
        for t, k in enumerate(mixing.pfair_schedule(parts), 1):
            done[k] += 1
            assert all(abs(done[x] - t * p / h) < 1 for x, p in parts.items())
        assert done == Counter({k: v for k, v in parts.items() if v})


def test_quotas_pass_on_what_limited_sources_cannot_give():
    got = mixing.quotas({"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 1000.0, "b": 10.0, "c": 1000.0}, 100.0)
    assert got == pytest.approx({"a": 90 * 5 / 7, "b": 10, "c": 90 * 2 / 7})
    assert mixing.quotas({"a": 0.5, "b": 0.5}, {"a": 3.0, "b": 4.0}, 100.0) == {"a": 3.0, "b": 4.0} and mixing.quotas({}, {}, 5.0) == {}


@pytest.mark.parametrize("most", [100_000, 40])
def test_mix_reaches_targets_and_caps(spark, monkeypatch, most):
    monkeypatch.setattr(mixing, "MOST_BLOCKS", most)
    rng = random.Random(1)
    docs = [(i, rng.choice(["big", "big", "big", "mid", "tiny" if i % 40 == 0 else "big", "other", None]), "word " * rng.randrange(1, 60)) for i in range(3000)] + [(9001, "mid", None), (9002, "mid", "")]
    targets = [("big", 0.6, 1), ("mid", 0.3, 2), ("tiny", 0.1, 4), ("absent", 0.1, 3), (None, 0.2, 1)]
    d = spark.createDataFrame(docs, "doc_id long, source string, text string").withColumns({"slot": F.lit(0), "draw": F.lit(0), "tokens": F.lit(0), "block": F.lit(0), "quota": F.lit(0)})
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    rows, shares = mixing.mix(d, t, block=64, total_tokens=8_000)
    got = {r.source: r for r in shares.collect()}
    assert set(got) == {"big", "mid", "tiny", "absent"} and got["absent"].mix_rows == 0
    assert got["big"].n_tokens >= 4_800 and not got["big"].capped and not got["mid"].capped and got["tiny"].capped == (got["tiny"].n_tokens * 4 <= 800)
    size = sum(r.mix_tokens for r in got.values())
    for k in ("big", "mid"):
        assert abs(got[k].mix_tokens - got[k].quota) <= 64 and got[k].most_copies <= dict((a, b) for a, _, b in targets)[k]
    order = rows.orderBy("position").collect()
    assert [r.position for r in order] == list(range(1, len(order) + 1))
    assert rows.groupBy("doc_id", "copy").count().where("count > 1").count() == 0
    total, run = 0, Counter()
    one = max(64, size / most)
    for r in order:
        total += r.n_tokens
        run[r.source] += r.n_tokens
        assert all(abs(run[k] - got[k].quota / sum(x.quota for x in got.values()) * total) <= 2 * one + 3 * 60 for k in ("big", "mid", "tiny"))
    # by default as much as there is; a source that cannot keep up gives all its copies and the others fill in
    whole = {r.source: r for r in mixing.mix(d, t, block=64)[1].collect()}
    assert whole["tiny"].capped and whole["tiny"].mix_rows == 4 * whole["tiny"].n_docs and whole["tiny"].most_copies == 4
    assert sum(r.mix_tokens for r in whole.values()) == pytest.approx(sum(r.n_tokens for r in whole.values()), rel=0.02)
    # more than there can be: all are capped
    short = {r.source: r for r in mixing.mix(d, t, block=64, total_tokens=10**7)[1].collect()}
    assert all(r.mix_tokens == r.n_tokens * r.max_repeats for r in short.values())
    assert mixing.mix(d.limit(0), t)[0].count() == 0 and mixing.mix(d, t.limit(0))[0].count() == 0


# --- 8 ------------------------------------------------------------------------------------------------------------------------


def passages(seed=7):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij éß中\U0001f33d") for _ in range(rng.randrange(3, 9)))
    shared = [" ".join(word() for _ in range(n)) for n in (30, 36, 60, 25)]
    boiler = shared[0][:150]
    docs = []
    for i in range(120):
        t = " ".join(word() for _ in range(rng.randrange(5, 80)))
        if rng.random() < 0.4:
            p = rng.choice(shared)
            a = rng.randrange(0, 60)
            t = t[: len(t) // 2] + p[a : a + rng.choice([150, 199, 200, 201, 400])] + t[len(t) // 2 :]
        docs.append((i, t + boiler))
    docs += [(500, docs[3][1]), (501, docs[3][1]), (502, None), (503, ""), (504, "short"), (505, "-" * 1000), (506, "=-" * 300 + "-" * 300), (507, shared[2] * 4), (508, shared[2] * 2)]
    return docs


@pytest.mark.parametrize("hot", [100_000, 3])
def test_shared_passages_match_all_windows(spark, hot):
    docs = passages()
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"cls": F.lit(0), "print": F.lit(0), "n": F.lit(0), "key": F.lit(0)}).repartition(4)
    where, cover = defaultdict(set), defaultdict(set)
    for i, t in docs:
        for p in range(len(t or "") - 199):
            where[t[p : p + 200]].add(i)
    want = {p for v in where.values() for p in itertools.combinations(sorted(v), 2)}
    for i, t in docs:
        for p in range(len(t or "") - 199):
            if len(where[t[p : p + 200]]) > 1:
                cover[i].update(range(p, p + 200))
    got = {(r.doc_id_a, r.doc_id_b) for r in spans.sharing_pairs(df, hot=hot).collect()}
    assert got == want
    parts = {r.doc_id: r for r in spans.shared_parts(df, hot=hot).collect()}
    assert set(parts) == {i for i, _ in docs}
    by_text = {i: t for i, t in docs}
    for i, t in docs:
        r = parts[i]
        assert r.shared_chars == len(cover[i]), i
        assert r.most_texts == max((len({by_text[j] for j in where[t[p : p + 200]]}) for p in cover[i] if p + 200 <= len(t) and len(where[t[p : p + 200]]) > 1), default=0), i
        assert sum(int(y) - int(x) for x, y in (v.split("-") for v in r.intervals.split(",") if v)) == r.shared_chars
        assert r.shared_share == pytest.approx(len(cover[i]) / len(t) if t else 0, abs=1e-6)
    assert spans.sharing_pairs(df.limit(0)).count() == 0 and spans.shared_parts(df.limit(0)).count() == 0


def test_fingerprints_do_not_depend_on_position():
    a = spans.code_points("xyz" * 40 + "the same window of text")
    b = spans.code_points("q" * 17 + "the same window of text")
    assert spans.window_hashes(a, 20)[-1] == spans.window_hashes(b, 20)[-1]
    assert len(spans.least_of_runs(np.empty(0, np.uint64), 5)) == 0 and len(spans.window_hashes(a, 1000)) == 0


# --- queries ------------------------------------------------------------------------------------------------------------------


def test_queries_run_on_the_smallest_tables(spark, sf):
    from furrow.llm import queries

    for name, f in queries.queries().items():
        df = f(spark, sf)
        assert df.count() >= 0 and df.columns, name


def test_queries_equal_their_sql(spark, sf):
    import decimal
    import math
    from pathlib import Path

    import duckdb

    from furrow.llm import oracle, queries

    def plain(v):
        v = float(v) if isinstance(v, decimal.Decimal) else v
        return (None if math.isnan(v) else round(v, 5) + 0.0) if isinstance(v, float) else v

    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    for name, sql in oracle.oracle_sql().items():
        df = queries.queries()[name](spark, sf)
        cols = sorted(df.columns)
        res = con.execute(sql)
        names = [x[0] for x in res.description]
        assert sorted(names) == cols, name
        want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in res.fetchall()), key=repr)
        assert sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr) == want, name
