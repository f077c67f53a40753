"""Operators that run a caller's model or extractor inside the workers, once per worker, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow.functions.text import is_garbled
from furrow.operators.layout import anchor_bands, word_columns
from furrow.session import cut


def hashing_encoder(dim: int = 64) -> Callable[[list[str]], np.ndarray]:
    """The default encoder, for tests and as a baseline: signed counts of hashed words and word pairs. No model is loaded."""
    import re
    from zlib import crc32

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for i, t in enumerate(texts):
            words = re.findall(r"\w+", t.lower())
            for w in (*words, *map(" ".join, zip(words, words[1:]))):
                h = crc32(w.encode())
                out[i, h % dim] += 1 if h & 0x80000000 else -1
        return out

    return encode


def embed_texts(df: DataFrame, key: str, text: str, make_encoder: Callable[[], Callable[[list[str]], np.ndarray]] = hashing_encoder, batch: int = 64) -> DataFrame:
    """(key, embedding array<float>) at unit length. ``make_encoder`` is called once per task and returns a function from texts to
    a matrix; null and empty texts are encoded as ''; a zero vector stays zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = make_encoder()
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                part = whole.slice(at, batch)
                m = np.asarray(encode([x or "" for x in part.column(1).to_pylist()]), dtype=np.float64)
                m = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)).astype(np.float32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], [key, "embedding"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, embedding array<float>")


def save_vectors(vectors: DataFrame, ids: DataFrame, path: str, key: str, vector: str = "embedding") -> int:
    """Overwrites a table of vectors, after checking that each id has exactly one vector and no other key has one; their number."""
    counts = vectors.groupBy(key).agg(F.count(vector).alias("n"))
    odd = ids.select(key).distinct().withColumn("_id", F.lit(True)).join(counts, key, "full").where(F.col("_id").isNull() | (F.coalesce("n", F.lit(0)) != 1))
    if odd.limit(1).count():
        raise ValueError("vectors and ids do not match")
    vectors.write.mode("overwrite").parquet(path)
    return vectors.sparkSession.read.parquet(path).count()


def stale_vectors(docs: DataFrame, vectors: DataFrame, key: str, text: str, print_col: str = "text_print") -> DataFrame:
    """The documents whose (key, fingerprint of the text) has no vector yet: new ones and changed ones."""
    return docs.withColumn(print_col, F.xxhash64(text)).join(vectors.select(key, print_col), [key, print_col], "left_anti")


def extract_pages(files: DataFrame, extractor: Callable[[bytes], list[tuple[str, list[list[list[str]]]]]], content: str = "content", key: str = "path") -> DataFrame:
    """(key, text, error): the marked text of binary files. ``extractor`` gives, per page, its text and its tables as rows of cells; a page
    begins with ``[[PAGE:n]]``, tables are written as markdown between table markers. A file that fails has null text and the error."""

    def render(rows: list[list[str]]) -> str:
        width = len(rows[0]) if rows else 0
        line = lambda r: "| " + " | ".join([(c or "").strip() for c in r][:width] + [""] * (width - len(r))) + " |"
        return "\n".join([line(rows[0]), line(["---"] * width), *map(line, rows[1:])]) if rows else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, errors = [], []
            for raw in b.column(1).to_pylist():
                try:
                    parts = []
                    for n, (body, tables) in enumerate(extractor(raw), 1):
                        parts.append(f"[[PAGE:{n}]]\n{body}" + "".join(f"\n[[TABLE_START]]\n{render(t)}\n[[TABLE_END]]" for t in tables))
                    texts.append("\n".join(parts))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001 - one bad file must not stop the stage
                    texts.append(None)
                    errors.append(f"{type(e).__name__}: {e}"[:500])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(errors, pa.string())], [key, "text", "error"])

    return files.select(key, content).mapInArrow(run, f"`{key}` string, text string, error string")


def extraction_stage(files: DataFrame, done: DataFrame, extractor: Callable[[bytes], list[tuple[str, list[list[list[str]]]]]], content: str = "content", key: str = "path") -> tuple[DataFrame, DataFrame]:
    """(texts, errors) of the files that ``done`` (key) doesn't hold yet: texts (key, text, has_tables), errors (key, error). The files are
    extracted once, into a table."""
    made = cut(extract_pages(files.join(done.select(key).distinct(), key, "left_anti"), extractor, content, key))
    texts = made.where("text is not null").select(key, "text", F.col("text").contains("[[TABLE_START]]").alias("has_tables"))
    return texts, made.where("text is null").select(key, "error")


# The columns of a printed register by position, and the forms of its numbers and dates.
REGISTER_COLUMNS = [
    ("product_name", 0.0, 84.5), ("active_ingredient", 84.5, 164.5), ("applicant", 164.5, 250.0), ("manufacturer", 250.0, 325.0), ("reg_no", 325.0, 360.0),
    ("date_registered", 360.0, 403.0), ("reg_expiry", 403.0, 438.0), ("presentation", 438.0, 489.0), ("country", 489.0, 524.0),
]
REGISTER_NUMBER = r"^([0-9]{2}-[0-9]{3,6}[A-Z]?|A[0-9]-[0-9]{3,6}[A-Z]?)$"
REGISTER_DATE = r"^\d{2}/\d{2}/\d{4}$"


def register_rows(words: DataFrame, columns: Sequence[tuple[str, float, float]] = tuple(REGISTER_COLUMNS), anchor: str = "reg_no", number: str = REGISTER_NUMBER, date: str = REGISTER_DATE, dates: Sequence[str] = ("date_registered", "reg_expiry")) -> DataFrame:
    """(page, row_no, the columns, raw_text, confidence, needs_review): the rows of a register, from words (page, text, x0, top).

    A row begins at each word of the anchor column that has the form of a number and reaches to the next one. The words of a cell are
    joined in the order of their line (top to one decimal place) and position; of a date column the first date counts. Words before the first row of a
    page, or outside all columns, belong to none. Confidence is 0.4, and 0.3 each for a clean product name and ingredient.
    """
    w = word_columns(words, columns)
    starts = w.where((F.col("column") == anchor) & F.col("text").rlike(number)).select("page", "top", F.struct("top", "x0", "text").alias("_row"))
    placed = anchor_bands(w.where("column is not null"), starts, key="_row").where("_row is not null")
    cell = F.struct(F.round("top", 1).alias("t"), "x0", "text")
    cells = placed.groupBy("page", "_row").pivot("column", [c for c, _, _ in columns]).agg(F.array_sort(F.collect_list(cell)))
    joined = lambda c: F.trim(F.array_join(F.transform(c, lambda x: x["text"]), " "))
    first = lambda c: F.coalesce(F.try_element_at(F.filter(F.transform(c, lambda x: x["text"]), lambda x: x.rlike(date)), F.lit(1)), F.lit(""))
    value = lambda c: F.coalesce(F.col("_row.text") if c == anchor else first(F.col(c)) if c in dates else joined(F.col(c)), F.lit("")).alias(c)
    rows = cells.select("page", "_row", *[value(c) for c, _, _ in columns])
    rows = rows.withColumn("row_no", F.row_number().over(Window.partitionBy("page").orderBy("_row")))
    names = [c for c, _, _ in columns]
    return register_confidence(rows.withColumn("_raw", F.concat_ws(" | ", *names)), names[0], names[1], "_raw").select("page", "row_no", *names, "raw_text", "confidence", "needs_review")


def register_confidence(rows: DataFrame, product: str = "product", ingredient: str = "ingredient", raw: str = "raw") -> DataFrame:
    """Adds raw_text, confidence and needs_review to rows read from a register: 0.4, and 0.3 each for a clean product name and ingredient."""
    clean = lambda c: (F.coalesce(F.trim(c), F.lit("")) != "") & ~is_garbled(c) & (F.length(c) <= 60)
    conf = F.round(F.lit(0.4) + F.when(clean(product), 0.3).otherwise(0.0) + F.when(clean(ingredient), 0.3).otherwise(0.0), 2)
    return rows.withColumn("raw_text", F.substring(raw, 1, 500)).withColumn("confidence", conf).withColumn("needs_review", conf < 0.7)


def value_diff(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """(key, left_value, right_value) of the keys whose values differ or that one side lacks; null equals null."""
    a, b = left.select(key, F.col(value).alias("left_value"), F.lit(True).alias("_l")), right.select(key, F.col(value).alias("right_value"), F.lit(True).alias("_r"))
    out = a.join(b, key, "full")
    return out.where(F.col("_l").isNull() | F.col("_r").isNull() | ~F.col("left_value").eqNullSafe(F.col("right_value"))).select(key, "left_value", "right_value")


def report_lines(wide: DataFrame, name: str = "name", most: int = 10_000) -> list[str]:
    """A matrix of a fixed domain as aligned text lines; the row count is checked, since lines are made on the driver."""
    rows = wide.orderBy(name).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("too many rows for a text report")
    cols = [name, *[c for c in wide.columns if c != name]]
    table = [cols, *[["" if r[c] is None else str(r[c]) for c in cols] for r in rows]]
    widths = [max(len(x[i]) for x in table) for i in range(len(cols))]
    return ["  ".join(x[i].ljust(widths[i]) for i in range(len(cols))).rstrip() for x in table]


def fact_summary(facts: DataFrame, by: str = "crop", most: int = 3) -> DataFrame:
    """(by, facts): the surest facts of each crop as one text, at most ``most``, on ties in the order of the text."""
    order = Window.partitionBy(by).orderBy(F.desc("confidence"), "raw_text")
    # the window keeps the best of each task before the shuffle, so no task sees all facts of a crop
    best = facts.where(F.col(by) != "").select(by, "confidence", "raw_text").distinct().withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("_r", "raw_text"))), lambda x: x["raw_text"])
    return best.groupBy(by).agg(F.array_join(lines, "\n").alias("facts"))
