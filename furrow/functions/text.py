"""Text functions as column expressions; Arrow UDFs only where Spark has no counterpart."""

from __future__ import annotations

import difflib
import unicodedata
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from furrow.functions.vocabulary import LANGUAGE_MARKS, LEXICON

ColumnOrName = Column | str


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _words(items: Sequence[str]) -> Column:
    return F.array(*[F.lit(x) for x in items])


# --- tokens -------------------------------------------------------------------------------------------------------------------


def tokenize(text: ColumnOrName) -> Column:
    """Lower-case ASCII words with an inner apostrophe; null gives an empty array."""
    return F.regexp_extract_all(F.lower(F.coalesce(_col(text), F.lit(""))), F.lit(r"[A-Za-z0-9]+(?:'[A-Za-z0-9]+)?"), F.lit(0))


def tokenize_unicode(text: ColumnOrName) -> Column:
    """Lower-case words of any script."""
    return F.regexp_extract_all(F.lower(F.coalesce(_col(text), F.lit(""))), F.lit(r"[\p{L}\p{M}\p{N}_]+"), F.lit(0))


# Words that carry no content.
STOPWORDS = [
    "a", "an", "the", "is", "are", "was", "were", "be", "been", "being", "to", "of", "in", "on", "at", "for", "and", "or", "with", "as", "by", "it",
    "this", "that", "these", "those", "i", "you", "your", "should", "would", "will", "can", "could", "and/or", "into", "from", "how", "what", "when",
    "consult", "recommend", "recommended", "use", "apply", "per",
]


def content_tokens(text: ColumnOrName, stopwords: Sequence[str] = STOPWORDS) -> Column:
    """Distinct words of more than two letters that aren't stop words."""
    words = F.regexp_extract_all(F.coalesce(_col(text), F.lit("")), F.lit(r"[a-zA-Z][a-zA-Z\-]+"), F.lit(0))
    return F.array_distinct(F.filter(F.transform(words, F.lower), lambda w: (F.length(w) > 2) & ~w.isin(*stopwords)))


def proxy_f1(a: ColumnOrName, b: ColumnOrName) -> Column:
    """F1 of the content tokens of two texts in percent, rounded to two places; 0 if either has none."""
    x, y = content_tokens(a), content_tokens(b)
    common = F.size(F.array_intersect(x, y))
    return F.when((F.size(x) == 0) | (F.size(y) == 0) | (common == 0), F.lit(0.0)).otherwise(F.round(F.lit(200.0) * common / (F.size(x) + F.size(y)), 2))


def token_count(text: ColumnOrName) -> Column:
    """Regular-expression token count: words and single marks."""
    return F.regexp_count(F.coalesce(_col(text), F.lit("")), F.lit(r"[\p{L}\p{M}\p{N}]+|[^\s\p{L}\p{M}\p{N}]"))


@pandas_udf(T.StringType())
def fold_diacritics(s: pd.Series) -> pd.Series:
    """The text without combining marks (canonical decomposition)."""
    return s.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFD", x) if unicodedata.category(c) != "Mn"))


@pandas_udf(T.DoubleType())
def gestalt_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of two strings, in argument order."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)], dtype=float)


# --- tagging ------------------------------------------------------------------------------------------------------------------


def tag_terms(text: ColumnOrName, terms: Sequence[str]) -> Column:
    """The terms that occur as whole words, in dictionary order; whatever their case."""
    low = F.lower(F.coalesce(_col(text), F.lit("")))
    hits = [F.when(low.rlike(r"(?U)\b" + _quote(t.lower()) + r"\b"), F.lit(t)) for t in terms]
    return F.array_compact(F.array(*hits))


def _quote(term: str) -> str:
    return "".join("\\" + c if c in r"\.^$|?*+()[]{}/-" else c for c in term)


def tag_first_term(text: ColumnOrName, terms: Sequence[str]) -> Column:
    """The first term of the dictionary that occurs, or null."""
    return F.try_element_at(tag_terms(text, terms), F.lit(1))


def guess_categories(text: ColumnOrName, categories: Mapping[str, Sequence[str]]) -> Column:
    """The categories of which any keyword is part of the text."""
    low = F.lower(F.coalesce(_col(text), F.lit("")))
    hits = []
    for name, words in categories.items():
        any_word = low.contains(words[0])
        for w in words[1:]:
            any_word = any_word | low.contains(w)
        hits.append(F.when(any_word, F.lit(name)))
    return F.array_compact(F.array(*hits))


def classify_topic(text: ColumnOrName, topics: Mapping[str, Sequence[str]], default: str = "unclassified") -> Column:
    """The topic with most keyword occurrences (parts of words count); the earlier topic wins ties."""
    low = F.lower(F.coalesce(_col(text), F.lit("")))
    table = F.array(*[F.struct(F.lit(-i).alias("o"), F.lit(name).alias("topic"), _words(words).alias("words")) for i, (name, words) in enumerate(topics.items())])
    count = lambda t, w: F.floor((F.length(t) - F.length(F.replace(t, w, F.lit("")))) / F.length(w)).cast("int")
    score = lambda t, k: F.struct(F.aggregate(k["words"], F.lit(0), lambda n, w: n + count(t, w)).alias("n"), k["o"].alias("o"), k["topic"].alias("topic"))
    # arrays of one element name an intermediate result, so that it is computed once
    best = F.transform(F.array(low), lambda t: F.array_max(F.transform(table, lambda k: score(t, k))))
    return F.transform(best, lambda x: F.when(x["n"] > 0, x["topic"]).otherwise(F.lit(default)))[0]


# --- normalisation ------------------------------------------------------------------------------------------------------------


def dehyphenate(text: ColumnOrName) -> Column:
    """Joins words hyphenated at the end of a line."""
    return F.regexp_replace(_col(text), r"(?U)(\w)-\n(\w)", "$1$2")


def normalize_ws(text: ColumnOrName) -> Column:
    """Runs of blanks to one, no blanks before line ends, at most one empty line, trimmed."""
    t = F.regexp_replace(_col(text), r"[ \t]{2,}", " ")
    t = F.regexp_replace(t, r"[ \t]+(?=\n|$)", "")
    return F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def safe_filename(name: ColumnOrName, most: int = 120) -> Column:
    """Letters, digits, dot, hyphen and underscore; the rest becomes an underscore; ``untitled`` if nothing is left."""
    t = F.trim(F.regexp_replace(F.coalesce(_col(name), F.lit("")), r"[^\p{L}\p{N} _.\-]", "_"))
    t = F.substring(F.regexp_replace(t, r"\s+", "_"), 1, most)
    return F.when(t == "", F.lit("untitled")).otherwise(t)


def is_garbled(text: ColumnOrName) -> Column:
    """At least four tokens of which over 35 % have one or two characters; a blank text is garbled."""
    words = F.filter(F.split(F.trim(F.coalesce(_col(text), F.lit(""))), r"\s+"), lambda w: w != "")
    short = F.size(F.filter(words, lambda w: F.length(w) <= 2))
    return F.when(F.size(words) == 0, F.lit(True)).when(F.size(words) < 4, F.lit(False)).otherwise(short / F.size(words) > 0.35)


def is_toc_page(text: ColumnOrName) -> Column:
    """A table of contents: named so, or over 30 % of more than three lines end in dot leaders and a number."""
    t = F.coalesce(_col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.trim(x) != "")
    leaders = F.size(F.filter(lines, lambda x: x.rlike(r"\.{3,}\s*\d+\s*$")))
    return t.rlike(r"(?im)table of contents|^contents$") | F.when(F.size(lines) > 3, leaders / F.size(lines) > 0.3).otherwise(False)


def normalise_query(text: ColumnOrName, lexicon: Mapping[str, str] = LEXICON) -> Column:
    """Lower case, no marks, and every token replaced once through the lexicon."""
    table = F.create_map(*[F.lit(x) for kv in lexicon.items() for x in kv])
    tokens = tokenize_unicode(fold_diacritics(F.lower(_col(text))))
    return F.array_join(F.transform(tokens, lambda t: F.coalesce(F.try_element_at(table, t), t)), " ")


def detect_language(text: ColumnOrName, marks: Mapping[str, Sequence[str]] = LANGUAGE_MARKS, default: str = "en") -> Column:
    """The first language of which a marker word occurs."""
    tokens = tokenize_unicode(fold_diacritics(F.lower(_col(text))))
    out = None
    for lang, words in marks.items():
        hit = F.arrays_overlap(tokens, _words(words))
        out = F.when(hit, F.lit(lang)) if out is None else out.when(hit, F.lit(lang))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def split_list(c: ColumnOrName, sep: str = ";") -> Column:
    """Parts of a separated list without empty ones; null gives an empty array."""
    outer = r"^[\s\p{Z}]+|[\s\p{Z}]+$"
    return F.filter(F.transform(F.split(F.coalesce(_col(c), F.lit("")), sep), lambda x: F.regexp_replace(x, outer, "")), lambda x: x != "")


def crop_list(c: ColumnOrName) -> Column:
    """Distinct lower-case names of a separated list, sorted."""
    return F.array_sort(F.array_distinct(F.transform(split_list(c), F.lower)))


def truthy(c: ColumnOrName) -> Column:
    """true, 1 and yes in any case; all else, null too, is false."""
    return F.coalesce(F.lower(F.trim(_col(c).cast("string"))).isin("true", "1", "yes"), F.lit(False))


def markdown_row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda x: F.coalesce(x, F.lit(""))), " | "), F.lit(" |"))


def table_to_markdown(rows: ColumnOrName) -> Column:
    """A markdown table of an array of arrays; rows are padded or cut to the width of the first."""
    r = _col(rows)
    width = F.size(r[0])
    fit = lambda x: F.slice(F.concat(x, F.array_repeat(F.lit(""), width)), F.lit(1), width)
    body = F.transform(F.slice(r, F.lit(2), F.greatest(F.size(r) - 1, F.lit(0))), lambda x: markdown_row(fit(x)))
    rule = markdown_row(F.array_repeat(F.lit("---"), width))
    return F.when(F.size(r) > 0, F.array_join(F.concat(F.array(markdown_row(r[0]), rule), body), "\n")).otherwise("")


def first_paragraphs(pairs: ColumnOrName, most: int = 60) -> Column:
    """The first words of a text given as an inverted index: a map from word to positions."""
    entries = F.flatten(F.transform(F.map_entries(_col(pairs)), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.slice(F.array_sort(entries), 1, most), lambda x: x["w"]), " ")
