"""Problem 2: cut oversized texts into pieces at natural boundaries.

Method: dynamic programming over boundary positions. Every position where a piece may end has a penalty (paragraph <
sentence < line < word < anywhere); the cost of a split is the sum of its penalties plus the squared deviation of the piece
lengths from the even length. Pieces never exceed the limit; for prose each next piece repeats up to the
overlap's characters of the one before, beginning at a boundary too.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 1800, 240
# penalties of the kinds of boundary, in units of the squared relative deviation from the even length
PARAGRAPH, SENTENCE, LINE, WORD, ANYWHERE = 0.0, 0.15, 0.4, 1.5, 8.0
_KINDS = [
    (re.compile(r"\n[ \t]*\n\s*"), PARAGRAPH),
    (re.compile(r"[.!?…。]+[\"')\]»”’]*\s+"), SENTENCE),
    (re.compile(r"\n"), LINE),
    (re.compile(r"\s+"), WORD),
]
_ROW = re.compile(r"\n")
_SPACE = re.compile(r"\s+")
_CELL = re.compile(r"\|[ \t]*")


def boundaries(text: str, is_table: bool, stretch: int = LIMIT // 4, limit: int = LIMIT) -> dict[int, float]:
    """Positions after which a piece may end, with the penalty of each; in a table only the ends of rows, and inside a row
    longer than ``limit`` those of cells, and of words where cells leave more than ``stretch`` characters.

    Paragraph and sentence ends are always taken; ends of lines, and then of words, where no better boundary
    occurs for more than ``stretch`` characters.
    """
    if is_table:
        found = {m.end(): PARAGRAPH for m in _ROW.finditer(text) if m.end() < len(text)}
        for kind, cost, least in ((_CELL, LINE, limit), (_SPACE, WORD, min(stretch, limit))):
            marks = [0, *sorted(found), len(text)]
            rows = [0, *sorted(p for p, c in found.items() if c == PARAGRAPH), len(text)]
            for x, y in zip(marks, marks[1:]):
                row = bisect_right(rows, x)
                if y - x > least and rows[row] - rows[row - 1] > limit:
                    for m in kind.finditer(text, x, y):
                        if x < m.end() < y:
                            found.setdefault(m.end(), cost)
        return found
    found: dict[int, float] = {}
    for kind, cost in _KINDS:
        marks = [0, *sorted(found), len(text)]
        gaps = [(0, len(text))] if cost <= SENTENCE else [(x, y) for x, y in zip(marks, marks[1:]) if y - x > stretch]
        for x, y in gaps:
            for m in kind.finditer(text, x, y):
                if 0 < m.end() < len(text):
                    found.setdefault(m.end(), cost)
    return found


def _fill(ends: list[int], costs: list[float], length: int, most: int) -> tuple[list[int], list[float]]:
    """Adds cuts inside stretches without boundary that no piece could hold."""
    out, pay, last = [], [], 0
    for p, c in zip([*ends, length], [*costs, 0.0], strict=True):
        while p - last > most:
            last += most
            out.append(last)
            pay.append(ANYWHERE)
        if p < length:
            out.append(p)
            pay.append(c)
        last = p
    return out, pay


def split_text(text: str, is_table: bool = False, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """Pieces (start, fresh, end): the piece is text[start:end], of which text[start:fresh] repeats the piece before.

    end - start <= limit; the fresh parts join to the whole text. Prose repeats at most ``overlap``
    characters: from the first sentence that begins in the earlier half of them, else from the first word (none where no word begins in reach);
    tables repeat nothing.
    """
    n = len(text)
    if n <= limit:
        return [(0, 0, n)]
    room = limit if is_table else limit - overlap  # a fresh part leaves room for the overlap before it
    marks = boundaries(text, is_table, limit=limit)
    ends = sorted(marks)
    ends, costs = _fill(ends, [marks[p] for p in ends], n, room)
    points, pay = [0, *ends, n], [0.0, *costs, 0.0]
    pieces = -(-n // room)
    even = n / pieces
    spots = np.array(points)
    best, back = np.full(len(points), np.inf), [0] * len(points)
    best[0] = 0.0
    lows = np.searchsorted(spots, spots - room).tolist()
    for j in range(1, len(points)):
        low = lows[j]
        cost = best[low:j] + ((points[j] - spots[low:j] - even) / even) ** 2
        i = int(cost.argmin()) if j > low else -1
        if i >= 0:
            best[j], back[j] = cost[i] + pay[j] + 0.25, low + i
        if low > 0 and points[j] <= limit and (first := pay[j] + ((points[j] - even) / even) ** 2 + 0.25) < best[j]:
            best[j], back[j] = first, 0  # the first piece repeats nothing and may fill the whole limit
    cuts, j = [], len(points) - 1
    while j:
        cuts.append((points[back[j]], points[j]))
        j = back[j]
    cuts.reverse()
    out = [(0, 0, cuts[0][1])]
    for k in range(1, len(cuts)):
        fresh, end = cuts[k]
        start = fresh
        if not is_table and overlap:
            reach = max(fresh - overlap, fresh - (limit - (end - fresh)), cuts[k - 1][0])
            # from the first sentence in reach if that repeats at least half of what the first word would, else from the first word
            good = [p for p in points[bisect_left(points, reach) : bisect_left(points, fresh - (fresh - reach) // 2 + 1)] if marks.get(p, ANYWHERE) <= SENTENCE]
            word = _SPACE.search(text, reach, fresh)
            start = good[0] if good else word.end() if word else fresh
        out.append((start, fresh, end))
    return out


def _run(limit: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, nos, starts, fresh, ends, texts = [], [], [], [], [], []
            for key, text, table in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                for no, (a, f, b) in enumerate(split_text(text, bool(table), limit, overlap)):
                    keys.append(key)
                    nos.append(no)
                    starts.append(a)
                    fresh.append(f - a)
                    ends.append(b)
                    texts.append(text[a:b])
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(nos, pa.int32()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(fresh, pa.int32()), pa.array(texts, pa.string())], ["key", "piece", "char_start", "char_end", "overlap_chars", "piece_text"])

    return run


def current_oversized(chunks: DataFrame, *, key: str = "chunk_id", at: str = "chunked_at", text: str = "text", table: str = "is_table", limit: int = LIMIT) -> DataFrame:
    """(key, text, is_table) of the current rows whose text is longer than the limit.

    Which version is current is decided on narrow rows (key, time, fingerprint of the content); only oversized texts
    are shuffled. Versions that tie on time are ordered by that fingerprint. Rows with a null key are left out.
    """
    narrow = chunks.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(at).alias("at"), F.length(text).alias("len"), F.xxhash64(text, table).alias("print"))
    now = narrow.groupBy("key").agg(F.max(F.struct("at", "print", "len")).alias("v")).where(F.col("v.len") > limit).select("key", F.col("v.at").alias("at"), F.col("v.print").alias("print"))
    big = chunks.where(F.col(key).isNotNull() & (F.length(text) > limit)).select(F.col(key).alias("key"), F.col(at).alias("at2"), F.xxhash64(text, table).alias("print2"), F.col(text).alias("text"), F.col(table).alias("is_table"))
    hit = big.join(now, "key").where(F.col("at").eqNullSafe(F.col("at2")) & (F.col("print") == F.col("print2")))
    return hit.groupBy("key").agg(F.first("text").alias("text"), F.first("is_table").alias("is_table"))


def split_oversized(chunks: DataFrame, *, key: str = "chunk_id", at: str = "chunked_at", text: str = "text", table: str = "is_table", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces (key, piece, char_start, char_end, overlap_chars, piece_text) of every current text above the limit.

    Lengths are code points. A text counts as a table if its flag is true, or if the flag is null or false although every
    non-empty line is a table row (flags are often wrong); a true flag counts only if there is a table row. A row longer than the limit is
    cut between cells, else between words.
    Null and short texts give no row.
    """
    rows = current_oversized(chunks, key=key, at=at, text=text, table=table, limit=limit)
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    looks = F.forall(lines, lambda x: F.ltrim(x).startswith("|") | F.ltrim(x).startswith("[[")) & (F.size(lines) > 1)
    has_rows = F.exists(lines, lambda x: F.ltrim(x).startswith("|"))
    kind = looks | (F.coalesce(F.col("is_table"), F.lit(False)) & has_rows)
    out = rows.select("key", "text", kind.alias("is_table")).mapInArrow(_run(limit, overlap), f"key {dict(rows.dtypes)['key']}, piece int, char_start int, char_end int, overlap_chars int, piece_text string")
    return out.withColumnRenamed("key", key)
