"""Text sizes in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "byte_bpe_multi_50k.tiktoken"


@lru_cache(maxsize=4)
def encoding(file: str, pattern: str | None = None):
    """The byte-level BPE of a rank file: a path, or the name of a file of the installed vocabulary package."""
    import os

    import tiktoken

    path = file
    if not os.path.isabs(file) or pattern is None:
        import public_tokenizers

        path = file if os.path.isabs(file) else public_tokenizers.path(file)
        pattern = pattern or public_tokenizers.PATTERN
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _count(file: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(file).encode_ordinary
        for batch in batches:
            last = batch.num_columns - 1
            n = np.fromiter((len(encode(t)) if t else 0 for t in (x.as_py() for x in batch.column(last))), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:last], pa.array(n)], names)

    return run


def token_counts(docs: DataFrame, keep: list[str], text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """The columns ``keep`` and ``n_tokens``; null and empty texts have none. Whole texts are counted."""
    rows = docs.select(*keep, F.col(text).alias("_text"))
    kinds = dict(rows.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keep] + ["n_tokens long"])
    return rows.mapInArrow(_count(tokenizer, [*keep, "n_tokens"]), schema)
