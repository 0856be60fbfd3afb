"""Token counts of texts under a public byte-level vocabulary."""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.session import spread

#: Where the vocabulary lies on every executor (a parameter of the operators, never copied).
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published pattern that splits text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.cache
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _counts(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    encode = encoder(path).encode_ordinary
    for batch in batches:
        sizes = [len(encode(t)) for t in batch.column(batch.num_columns - 1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes, pa.int64())], [*batch.schema.names[:-1], "n_tokens"])


def token_counts(df: DataFrame, keys: list[str], text_col: str, path: str = VOCABULARY) -> DataFrame:
    """The columns `keys` and n_tokens of every row; rows with a null text are left out."""
    rows = df.select(*keys, F.col(text_col).alias("__text")).filter(F.col("__text").isNotNull())
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return spread(rows).mapInArrow(partial(_counts, path=path), f"{kinds}, n_tokens long")
