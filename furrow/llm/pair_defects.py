"""Problem 5: defective question and answer pairs, with the type of defect.

Method: several noisy labelling functions per defect vote yes, no or abstain. What complete sentences look like, and what a
refusal looks like, is counted over all records: sentences are reduced to skeletons (numbers, codes and names masked), the
gold answers give the known skeletons and where each may end, and the answers to questions whose gold answer asks for a
refusal give those of refusals.

How reliable a function is, is measured on labelled pairs made from a sample of records: their gold answers as they are, broken off,
replaced by the question, by a placeholder, by a gold answer in another language, or by an answer that was given where a refusal is
asked for. From these rates expectation maximisation fits a label model to the votes on all records; a label is kept where its posterior
exceeds the cutoff that does best on the labelled pairs. A record may keep several labels.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex as re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.operators.latest import latest
from furrow.session import cut, scratch

#: Records whose gold answers are made into labelled pairs: all if there are fewer, else those with the least hashes.
SAMPLE = 1000
DEFECTS = ["empty", "copy", "refusal", "truncated", "language"]

# Frequent words that tell the seven languages apart.
LANGUAGE_WORDS = {
    "en": "the of and is are to in with that this you your my it on at be by from what which how when should can does not these there if more than use per has was were most likely damage give plant sow once after before half takes need bags tank margin costs good choice matures growers success chose next season keep people point signs advice sorry i am please would answer could will tell".split(),
    "fr": "le la les des du de et est un une pour dans sur avec que qui il elle au aux ce cette pas ne plus par en après avant si quand comment pourquoi faut jours cent près été quelle mon vous je sont ont sols lourds soit puis seconde".split(),
    "pcm": "dey don wetin una abeg fit sabi wey dem comot wahala oga abi".split(),
    "ha": "ta ne ce kuma idan kafin bayan cikin daga yake zan nawa wa su amma don ba ko manoman kwana kowace saboda kamar shekarar garin aka da yana ƙasa irin ruwan taki kilo yaya gonar wannan abin haƙuri iya jure har".split(),
    "yo": "ni ní ti tí sí àwọn kí fi bá ń wọn lórí ọjọ́ ṣe mo mi lè jẹ́ ọdún lẹ́yìn nínú láti báwo irú máa lọ kan ọjà àpò ilẹ̀ gbó ẹ ò yìí ìdá oko omi ìlú".split(),
    "ig": "nke ka m ga ndị nwere bụ ma ụbọchị kwa mgbe ala dị si akwụkwọ ọrụ ụmụ ahụhụ ọnụ ahịa otu akpa ụdị kedu gịnị mmiri kilogram enweghị ihe maara esi eme tupu mere".split(),
    "sw": "ya wa kwa ni katika za la cha vya hii huu yangu nini jinsi gani je siku baada kabla lakini shamba mmea mbolea sana samahani siwezi hekta mbegu ekari wakulima mwaka bei mimi hili lini".split(),
}
_BY_WORD: dict[str, list[str]] = {}
for _lang, _list in LANGUAGE_WORDS.items():
    for _w in _list:
        _BY_WORD.setdefault(unicodedata.normalize("NFC", _w), []).append(_lang)
#: Words that add no content to a question given back.
NEUTRAL = frozenset(_BY_WORD) | frozenset("so know like ask asked asking question wonder wondering want wanted hear say saying said thank thanks me he she they their about whether".split())
# Letters that only some of the languages write.
LANGUAGE_LETTERS = {"ha": "ɗƙɓƴ", "ig": "ịụṅ", "yo": "ẹṣ", "fr": "çêîœùûâëï"}

REFUSAL = re.compile(
    r"\bcan(?:no|['’])?t (?:help|assist|answer|provide|advise|say|tell|respond|comment|recommend)|unable to|not (?:able|possible|in a position|allowed|permitted)\b.{0,12}\bto (?:answer|help|respond|advise|say|comment)"
    r"|must decline|have to decline|decline to|rather not|won['’]?t (?:comment|answer|advise|help)|outside what i|beyond (?:the scope|my|what i)|no answer (?:can|for you)|nothing i (?:may|can)|to a specialist instead|have enough information"
    r"|isn['’]?t possible for me|something else\b|your question open|sources say nothing|have no (?:answer|information)|not possible for me"
    r"|je ne peux|je n['’]ai (?:aucune|pas)|dépasse mon|impossible de répondre|adressez-vous|samahani|siwezi|sina (?:taarifa|jibu|habari)|nje ya uwezo|ba zan iya|ba ni da|wuce abin da|\bmi ò (?:lè|ní)|kọjá ohun|enweghị m|karịrị ihe"
    r"|\bi no (?:fit|go fit|sabi|get)|pass wetin i sabi",
    re.I,
)
REFUSAL_ASKED = re.compile(r"declin|refus|no advice is to be given|out of scope|not covered|not a farming question|should not be answered", re.I)
PLACEHOLDER = re.compile(r"(?:null|none|nil|n/?a|nan|undefined|tbd|todo|empty|blank|no[ _]answer|no[ _]response|no[ _]output|answer|response|output|text|pending|placeholder|unknown|reply|content|result|insert.*here|your answer here|to be (?:added|done|completed|filled in))", re.I)
FAILURE = re.compile(r"^\W*(?:\w*error\b|exception\b|traceback\b|fail(?:ed|ure)\b|time[d ]*out\b|http\W*[45]\d\d|[45]\d\d\b.{0,12}(?:error|unavailable|gateway)|internal server|connection (?:refused|reset|error)|service unavailable|out of memory|cuda|context window)|\b(?:connection refused|generator (?:timed out|returned nothing)|context window exceeded)", re.I)
DANGLING = frozenset("the a an of and or to for with at in on by than as about such from into between is are be was that which if when because so du de la le les des et ou à au aux pour par avec dans sur en que qui dont sans kuma da na ta don a idan daga cikin ko sannan amma tí kí sí ní láti àti fún nke na ma ka maka wey make for and inside because pass before reach but while whereas unless until since once after however therefore not only your their mais car puis amma saboda ṣùgbọ́n nítorí mana n'ihi lakini ya wa kwa katika lakini kama".split())
_TOKEN = re.compile(r"[\p{L}\p{M}'’\-]+|\d+(?:[.,]\d+)*|[,;:]")
_WORD = re.compile(r"[\p{L}\p{M}]+")
_SPLIT = re.compile(r"(?<=[.!?…])[\"”’')\]]*\s+|\n+")
_BULLET = re.compile(r"^\s*(?:[-*•]|\d+[.)])\s+")
_DECOR = re.compile(r"(?:\s*\[(?:SRC|RAW)[^\]\s]*\]|\s*\(locally known as [^()]*\))+\s*$|^\s*\*\*[^*\n]*\*\*\s*", re.I)
_LEAD = re.compile(r"^(?:yes|no|answer|advice|a)\s*:\s*(?=\S)", re.I)
_OPENING = re.compile(r"^(?:[\p{L}\p{M}']+\s?){1,4}(?:,(?: but)?|:)\s+(?=\S+\s\S+\s\S)")
_CODE = re.compile(r"\b[A-Z]{2,}-\d+\b")


@lru_cache(maxsize=256)
def _rx(pattern: str):
    return re.compile(pattern)


def _nfc(s: str | None) -> str:
    return unicodedata.normalize("NFC", s or "").replace("’", "'")


def segments(text: str) -> list[str]:
    """Sentences and list items, without bullets, citations and headings in bold."""
    out = []
    for s in _SPLIT.split(_DECOR.sub("", text)):
        s = _LEAD.sub("", _DECOR.sub("", _BULLET.sub("", s)).strip())
        if s and not _rx(r"\*\*.*\*\*").fullmatch(s):
            out.append(s)
    return out


def skeleton(sentence: str) -> list[str]:
    """Tokens with numbers, codes and names (capitalised words after the first) masked."""
    toks = _TOKEN.findall(_CODE.sub(" 0C0 ", sentence).replace("0C0", "Ccode"))
    out = []
    for i, t in enumerate(toks):
        if t[0].isdigit():
            t = "#"
        elif t == "Ccode":
            pass
        elif i and t[0].isupper() and len(t) > 1:
            t = "X"
        else:
            t = t.lower()
        if not (out and out[-1] == t == "X"):
            out.append(t)
    return out


@lru_cache(maxsize=4096)
def language_of(text: str) -> tuple[str | None, float]:
    """The language whose words fit best, and its lead over the next; None without evidence."""
    low = _rx(r"\b(\w+)n't\b").sub(r"\1 not", _nfc(text).lower())
    score = dict.fromkeys(LANGUAGE_WORDS, 0.0)
    words = _WORD.findall(low)
    for w in words:
        langs = _BY_WORD.get(w)
        if langs:
            for lang in langs:
                score[lang] += 1 / len(langs)
    score["pcm"] *= 8  # Pidgin keeps most English words; these it does not share
    for lang, letters in LANGUAGE_LETTERS.items():
        score[lang] += 0.7 * sum(low.count(c) for c in letters)
    (best, a), (_, b) = sorted(score.items(), key=lambda x: -x[1])[:2]
    if best == "pcm":
        a = 1 + a / 8
        b = min(b, a - 1)
    return (best, a - b) if a >= 1 and a > b else (None, 0.0)


def _open_json(s: str) -> int:
    """1 for broken JSON, -1 for whole JSON, 0 for other text."""
    if not s[:1] in "{[" or len(s) < 3 or _rx(r"\[[A-Z]").match(s):
        return 0
    try:
        json.loads(s)
        return -1
    except ValueError:
        return 1 if _rx(r"[{\[]\s*[\"{\[\d]").match(s) else 0


def votes(question: str | None, answer: str | None, gold: str | None) -> dict:
    """Votes of the functions that need only the record itself, and what the others look up."""
    q, a, g = _nfc(question), _nfc(answer), _nfc(gold)
    plain = _rx(r"[\p{Z}\p{C}\s]+").sub(" ", _rx(r"\\[ntr]").sub(" ", a)).strip()
    bare = _rx(r"<[^<>]*>").sub(" ", plain)
    bare = _rx(r"[^\p{L}\p{N}/ ]+").sub(" ", bare).strip()
    words = _WORD.findall(plain.lower())
    e = [
        1 if not _rx(r"[\p{L}\p{N}]").search(bare) else 0,
        1 if all(PLACEHOLDER.fullmatch(x.strip()) for x in _rx(r"(?i)\s{2,}|(?<=answer) ").split(bare) if x.strip(" /")) else 0,
        1 if FAILURE.search(plain) and len(words) < 25 else 0,
        -1 if len(words) > 4 and not FAILURE.search(plain) else 0,
    ]
    segs = segments(a.strip())
    # copy: what is left of the answer without the words of the question
    qw = _WORD.findall(q.lower())
    asked_words = set(qw)
    extra = {w for w in words if w not in asked_words}
    same = len(asked_words & set(words))
    cover = same / max(1, len(asked_words))
    qn, an = " ".join(qw), " ".join(words)
    fold = lambda x: _rx(r"[^\p{L}\p{N}]+").sub("", unicodedata.normalize("NFD", x).lower())
    fq, fa = fold(q), fold(a)
    within = len(fq) > 10 and fq in fa and len(fa) - len(fq) <= 24
    content = {w for w in extra if w not in NEUTRAL}
    new_digits = set(_rx(r"\d+").findall(a)) - set(_rx(r"\d+").findall(q))
    asked = bool(segs) and a.strip(" \n\"'”»*_").endswith("?")
    c = [
        1 if within or (qn and len(qw) > 2 and qn in an and len(extra) <= 4) else (-1 if len(extra) > 8 else 0),
        1 if cover >= 0.6 and len(extra) <= max(4, 0.35 * len(qw)) and len(qw) > 2 else (-1 if cover < 0.4 or len(extra) > 8 else 0),
        1 if asked and cover >= 0.5 and len(extra) <= 12 else 0,
        -1 if new_digits else 0,
        1 if cover >= 0.6 and not content and len(words) <= len(qw) + 14 and len(qw) > 2 else 0,
    ]
    r = [1 if REFUSAL.search(a) else 0, -1 if _rx(r"\d").search(a) and not REFUSAL.search(a) else 0]
    last = segs[-1] if segs else ""
    tail = a.strip()
    tail = _DECOR.sub("", tail).rstrip(" \"'”’)]*_")
    stop = bool(_rx(r"[.!?。]$").search(tail)) and not tail.endswith("...")
    dots = tail.endswith(("…", "...")) and len(words) > 2
    js = _open_json(a.strip())
    toks = skeleton(last)
    end = _rx(r"[\p{L}\p{M}'\-]+$").findall(tail.lower())
    opened = (a.count("(") > a.count(")")) or (a.count("“") > a.count("”")) or bool(_rx(r"[,;:(\-–“]$").search(tail))
    t = [
        1 if dots else -1 if stop else 0,
        js,
        1 if not stop and end and end[0] in DANGLING and len(words) > 3 else 0,
        1 if not stop and opened and not js and len(words) > 2 else 0,
    ]
    la, ma = language_of(a)
    lq, _ = language_of(q)
    lg, _ = language_of(g) if g and not REFUSAL_ASKED.search(g) else (None, 0)
    n = len(words)
    few = n < 4 or js != 0 or 1 in e
    v = lambda x, y: 0 if few or not x or not y else 1 if x != y else -1
    marks = {k for k, s in LANGUAGE_LETTERS.items() if sum(a.lower().count(ch) for ch in s) >= 2}
    qmarks = {k for k, s in LANGUAGE_LETTERS.items() if sum(q.lower().count(ch) for ch in s) >= 2}
    lang = [v(la, lq), v(la, lg), 0 if few else 1 if (marks and not marks & qmarks and lq not in marks) else 0, 0 if few or not la else 1 if ma >= 2 and lq and la != lq else -1 if la == lq else 0]
    # a partial last word of the gold sentence it would have become
    cut_gold = 0
    if not stop and toks and g:
        stem = _rx(r"\W+$").sub("", last)
        if len(stem) > 8 and stem in g and _rx(r"\p{L}").match(g[g.index(stem) + len(stem) : g.index(stem) + len(stem) + 1]):
            cut_gold = 1
    t.append(cut_gold)
    return {
        "empty": e, "copy": c, "refusal": r, "truncated": t, "language": lang, "segs": [" ".join(skeleton(x)) for s in segs for x in (s, _OPENING.sub("", s)) if x is s or x != s], "heads": [" ".join(toks[:k]) for k in range(len(toks) - 1, max(len(toks) - 7, 2), -1)] if not stop else [], "ctx": " ".join(toks[:-1]), "last": toks[-1] if toks else "",
        "gives_back": 1 in (c[0], c[1], c[4]), "stop": stop or dots or js != 0, "asks_refusal": bool(REFUSAL_ASKED.search(g)),
    }


_FEATURES = "id string, label string, empty array<tinyint>, copy array<tinyint>, refusal array<tinyint>, truncated array<tinyint>, language array<tinyint>, segs array<string>, heads array<string>, ctx string, last string, gives_back boolean, stop boolean, asks_refusal boolean"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.string(), *[pa.list_(pa.int8())] * 5, pa.list_(pa.string()), pa.list_(pa.string()), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_()]
    names = ["id", "label", *["empty", "copy", "refusal", "truncated", "language"], "segs", "heads", "ctx", "last", "gives_back", "stop", "asks_refusal"]
    for batch in batches:
        rows = [{"id": i, "label": d} | votes(q, a, g) for i, q, a, g, d in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names)


def _gold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [" ".join(skeleton(s)) for g in batch.column(0).to_pylist() if g and not REFUSAL_ASKED.search(g) for s in segments(_nfc(g))]
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["skel"])


# What stands in an answer's place where there is none.
_NOTHING = ["", " ", "N/A", "null", "[no answer]", "...", "TODO", "Error: connection refused"]


_DANGLES = [", but", " and", " because the", " with about"]


def _breaks(gold: str, seed: int) -> str | None:
    """The answer broken off within its last sentence, run on beyond it, or broken off as a JSON text; None if the sentence has fewer than
    five words."""
    if seed % 7 == 0:
        return json.dumps({"answer": gold}, ensure_ascii=False)[: 10 + seed % max(1, len(gold))]
    if seed % 7 == 1:
        return gold.rstrip(" .!?") + _DANGLES[seed % len(_DANGLES)]
    spots = [m.start() for m in re.finditer(r"\S+", gold)]
    last = segments(gold)[-1:] or [""]
    words = len(last[0].split())
    if words < 5 or len(spots) < words:
        return None
    # after at least two words of the sentence; some inside a word, some with dots
    at = spots[len(spots) - words + 2 + seed % (words - 3)]
    if seed % 7 == 2:
        return gold[:at].rstrip() + ("..." if seed % 2 else "…")
    return gold[: at + 2].rstrip() if seed % 3 == 0 and _rx(r"\p{L}{5}").match(gold[at:]) else gold[:at].rstrip()


_LEADS = ["", "You asked: ", "The question was: ", "Thank you for asking. ", "You want to know: "]
_TURNED = {"i": "you", "my": "your", "me": "you", "we": "you", "our": "your", "mine": "yours"}


def _given_back(question: str, seed: int) -> str:
    """The question as it is, twice, after a lead, or as said to the one who asked."""
    if seed % 4 == 0:
        return question
    if seed % 4 == 1:
        return f"{question} {question}"
    turned = _rx(r"\w+").sub(lambda m: _TURNED.get(m.group().lower(), m.group()), question[:1].lower() + question[1:])
    return _LEADS[1 + seed // 4 % (len(_LEADS) - 1)] + (question if seed % 4 == 2 else turned.rstrip("?") + ".")


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = sorted(r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True) if r[1] is not None and r[3] is not None)
    full = [(i, q, g, language_of(g)[0]) for i, q, _, g in rows if not REFUSAL_ASKED.search(g)]
    declined = [(a, language_of(a)[0]) for _, _, a, g in rows if a and REFUSAL_ASKED.search(g) and len(a) > 20]
    out = []
    for n, (i, q, g, lang) in enumerate(full):
        seed = crc32(i.encode())
        made = {"": g, "copy": _given_back(q, seed), "empty": _NOTHING[seed % len(_NOTHING)], "truncated": _breaks(g, seed)}
        other = next((x for _, _, x, o in (full[(n + k) % len(full)] for k in range(1, 60)) if o and lang and o != lang and language_of(q)[0] not in (None, o)), None)
        asked = language_of(q)[0]
        same = [a for a, o in declined if o == asked]
        made |= {"language": other, "refusal": same[seed % len(same)] if same else None, "whole": json.dumps({"answer": g}, ensure_ascii=False) if seed % 7 == 0 else None, "restated": f"{_LEADS[seed % len(_LEADS)]}{q} {(segments(g) or [g])[0]}"}
        out += [(f"{k}\n{i}", q, a, g, k if k in DEFECTS else "") for k, a in made.items() if a is not None]
    cols = list(zip(*out, strict=True)) or [[]] * 5
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], ["id", "q", "a", "g", "label"])


def vote_rates(patterns: list[tuple[tuple[int, ...], bool, int]]) -> np.ndarray:
    """Of labelled pairs: how often each function votes yes, and no, on pairs without and with the label, as shares of these; half a vote is
    added to each count. An array (without or with, no or yes, function)."""
    votes_ = np.array([p for p, _, _ in patterns])
    out = np.zeros((2, 2, votes_.shape[1]))
    for y in (0, 1):
        n = np.array([c if t == bool(y) else 0 for _, t, c in patterns], float)
        for v, vote in enumerate((-1, 1)):
            out[y, v] = (((votes_ == vote) * n[:, None]).sum(0) + 0.5) / (n.sum() + 1)
    return out


def _posterior(votes_: np.ndarray, rates: np.ndarray, share: float) -> np.ndarray:
    """The share of the label among pairs with each vote pattern. A vote counts by how much more often it is cast on pairs with the label;
    abstaining says nothing."""
    gain = np.log(rates[1]) - np.log(rates[0])
    odds = (votes_ < 0) @ gain[0] + (votes_ > 0) @ gain[1] + np.log(share / (1 - share))
    return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def fit_labels(patterns: list[tuple[tuple[int, ...], int]], measured: np.ndarray, rounds: int = 200) -> tuple[dict[tuple[int, ...], float], np.ndarray, float]:
    """(posterior of each vote pattern, vote rates, share of the label) of a model with one latent label, by expectation maximisation.

    A rate is the mean of the one measured on labelled pairs and the one estimated on the records, whatever their numbers; the share starts
    from the records with more votes for than against and is the mean of that and the estimate. Patterns are few
    whatever the number of records: 3 to the power of the functions at most.
    """
    if not patterns:
        return {}, measured, 0.5
    votes_, n = np.array([p for p, _ in patterns]), np.array([c for _, c in patterns], float)
    first = float(np.clip(n[votes_.sum(1) > 0].sum() / n.sum(), 0.005, 0.5))
    rates, share = measured.copy(), first
    post = np.zeros(len(n))
    for _ in range(rounds):
        new = _posterior(votes_, rates, share)
        moved = np.abs(new - post).max()
        post = new
        if moved < 1e-7:
            break
        for y, weight in ((0, n * (1 - post)), (1, n * post)):
            for v, vote in enumerate((-1, 1)):
                rates[y, v] = (measured[y, v] + (((votes_ == vote) * weight[:, None]).sum(0) + 0.5) / (weight.sum() + 1)) / 2
        share = float(np.clip(((n * post).sum() / n.sum() + first) / 2, 0.001, 0.5))
    return {p: float(x) for (p, _), x in zip(patterns, post, strict=True)}, rates, share


def best_cutoff(labelled: list[tuple[tuple[int, ...], bool, int]], rates: np.ndarray, share: float, least: float = 0.5) -> float:
    """The cutoff, at least ``least``, with the best F1 on labelled pairs, in which the label is given the share it has among the records."""
    x = _posterior(np.array([p for p, _, _ in labelled]), rates, share)
    truth, n = np.array([t for _, t, _ in labelled]), np.array([c for _, _, c in labelled], float)
    w = np.where(truth, share * n / max(n[truth].sum(), 1), (1 - share) * n / max(n[~truth].sum(), 1))
    cuts = sorted({least, *x[x >= least].tolist()})
    f1 = [2 * w[truth & (x >= c)].sum() / (w[x >= c].sum() + share) for c in cuts]
    return float(cuts[int(np.argmax(f1))])


def label_pairs(results: DataFrame, *, key: str = "id", question: str = "question", answer: str = "answer_text", gold: str = "gold_answer", error: str = "error", at: str = "answered_at", sample: int = SAMPLE) -> DataFrame:
    """(key, defect_type, posterior, cutoff, best): every kept label of the current records without error; ``best`` marks the
    one with the highest posterior (on ties in the order empty, copy, refusal, truncated, language).

    A null answer is empty. A null gold answer asks for no refusal. Records with a null key are no record. An empty
    table gives no rows. The columns ``refused`` and ``detected_language`` are not used, as they are often wrong. At most ``sample`` records with a
    gold answer are made into labelled pairs, which measure the functions; all statistics are of all records.
    """
    spark = results.sparkSession
    with scratch():
        rows = latest(results, key, at, [question, answer, gold, error]).where(F.col(error).isNull())
        rows = rows.select(F.col(key).cast("string").alias("id"), F.col(question).alias("q"), F.col(answer).alias("a"), F.col(gold).alias("g"))
        rows = cut(rows)
        chosen = rows.where("g is not null").orderBy(F.xxhash64("id"), "id").limit(sample)
        made = cut(chosen.coalesce(1).mapInArrow(_labelled, "id string, q string, a string, g string, label string"))
        every = rows.withColumn("label", F.lit(None).cast("string")).unionByName(made)
        work = max(1, -(-rows.count() // 4000))
        feats = cut(every.repartition(work, "id").mapInArrow(_features, _FEATURES))
        known = cut(rows.select("g").where("g is not null").mapInArrow(_gold, "skel string").groupBy("skel").agg(F.count("*").alias("n")))
        # every context of a known sentence that an answer ends in, the tokens that follow it, and how often the sentence ends there
        toks = F.split("skel", " ")
        steps = known.select("n", F.size(toks).alias("len"), toks.alias("toks"), F.explode(F.sequence(F.lit(1), F.size(toks))).alias("i"))
        steps = steps.select(F.array_join(F.slice("toks", 1, F.col("i") - 1), " ").alias("ctx"), F.element_at("toks", F.col("i")).alias("tok"), F.when(F.col("i") == F.col("len"), F.col("n")).otherwise(0).alias("ends"), "n")
        steps = steps.join(feats.where("not stop").select("ctx").distinct(), "ctx", "left_semi").groupBy("ctx", "tok").agg(F.sum("ends").alias("ends"), F.sum("n").alias("n"))
        steps = cut(steps)
        # a token as a whole, and every beginning of one, so that an answer's last token is looked up by equality
        begun = steps.where(F.length("tok") > 1).select("ctx", F.explode(F.transform(F.sequence(F.lit(1), F.length("tok") - 1), lambda i: F.substring("tok", F.lit(1), i))).alias("last")).distinct().withColumn("partial", F.lit(True))
        segs = feats.select("id", "label", "asks_refusal", "gives_back", F.explode("segs").alias("skel"))
        per = segs.join(known.select("skel", F.lit(1).alias("is_known")), "skel", "left").groupBy("id").agg(F.sum(F.coalesce("is_known", F.lit(0))).alias("n_known"))
        # refusals as they are phrased where they are asked for: runs of four words of answers without any known sentence
        words = F.split("skel", " ")
        runs = F.when(F.size(words) > 3, F.transform(F.sequence(F.lit(1), F.size(words) - 3), lambda i: F.array_join(F.slice(words, i, F.lit(4)), " ")))
        strange = segs.where("not gives_back").join(per.where("n_known > 0"), "id", "left_anti").select("id", "label", "asks_refusal", F.explode(runs).alias("run")).distinct()
        phrased = strange.where("label is null").groupBy("run").agg(F.sum(F.col("asks_refusal").cast("int")).alias("asked"), F.count("*").alias("all")).where("asked >= 3 and asked >= 0.25 * all and all > asked")
        hits = strange.join(phrased.select("run"), "run").groupBy("id").agg(F.count("*").alias("n_ref"))
        per = per.join(hits, "id", "left")
        # an unfinished sentence that begins with a whole known one runs on ("..., but", "... with about")
        past = feats.select("id", F.explode("heads").alias("skel")).join(known.select("skel"), "skel").groupBy("id").agg(F.count("*").alias("n_past"))
        follow = steps.select("ctx", F.col("tok").alias("last"), "ends", F.col("n").alias("total"))
        joined = feats.join(per, "id", "left").join(past, "id", "left").join(follow, ["ctx", "last"], "left").join(begun, ["ctx", "last"], "left")
        goes_on = F.when(F.col("stop") | (F.col("last") == ""), F.lit(0)).when(F.col("ends") == 0, 1).when(F.col("ends") > 0, -1).when(F.col("partial"), 1).otherwise(0)
        n_known, n_ref = F.coalesce("n_known", F.lit(0)), F.coalesce("n_ref", F.lit(0))
        tiny = lambda c: F.array(c.cast("tinyint"))
        voted = cut(joined.select(
            "id", "label", "asks_refusal",
            F.concat("empty", tiny(F.when(n_known > 0, -1).otherwise(0))).alias("empty"),
            F.concat("copy", tiny(F.when(n_known > 0, -1).otherwise(0))).alias("copy"),
            F.concat("refusal", tiny(F.when(n_known > 0, -1).otherwise(0)), tiny(F.when(n_ref > 0, 1).otherwise(0))).alias("refusal"),
            F.concat("truncated", tiny(goes_on), tiny(F.when((goes_on == 0) & (F.col("n_past") > 0) & ~F.col("stop"), 1).otherwise(0))).alias("truncated"), "language",
        ), keep=True)
    # one pass counts the patterns of all defects, of records and of labelled pairs
    long = voted.select("id", "label", "asks_refusal", F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.col(d).alias("p")) for d in DEFECTS])).alias("x")).select("id", "label", "asks_refusal", "x.d", "x.p")
    counts = long.groupBy("d", "p", "label").count().collect()
    table = []
    for d in DEFECTS:
        own = [(tuple(r.p), r["count"]) for r in counts if r.d == d and r.label is None]
        labelled = [(tuple(r.p), r.label == d, r["count"]) for r in counts if r.d == d and r.label is not None]
        if not own:
            continue
        # without gold answers there is nothing to learn from: then every function is believed alike
        rates = vote_rates(labelled) if labelled else np.array([[0.3, 0.02], [0.02, 0.3]])[:, :, None].repeat(len(own[0][0]), 2)
        post, fitted, share = fit_labels(own, rates)
        cutoff = best_cutoff(labelled, fitted, share) if labelled else 0.5
        table += [(d, list(p), x, cutoff, DEFECTS.index(d)) for p, x in post.items() if x >= cutoff and 1 in p]
    kept = F.broadcast(spark.createDataFrame(table, "d string, p array<tinyint>, posterior double, cutoff double, ord int"))  # as few as there are patterns
    labels = long.where("label is null").join(kept, ["d", "p"]).where(~((F.col("d") == "refusal") & F.col("asks_refusal")))
    top = labels.groupBy("id").agg(F.max(F.struct(F.round("posterior", 6).alias("x"), (-F.col("ord")).alias("o"))).alias("top"))
    return labels.join(top, "id").select(F.col("id").alias(key), F.col("d").alias("defect_type"), "posterior", "cutoff", (F.col("ord") == -F.col("top.o")).alias("best"))


def defective_pairs(results: DataFrame, *, key: str = "id", **how) -> DataFrame:
    """(key, defect_type): the one best label of each defective pair."""
    return label_pairs(results, key=key, **how).where("best").select(key, "defect_type")
