"""A semi-join filter of fixed size, to keep rows that cannot match out of a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of 64 bits in the bitmap: its broadcast is at most 131,072 rows whatever the data.
WORDS = 1 << 17


def _word(key: Column) -> Column:
    return F.pmod(F.shiftright(F.xxhash64(key, F.lit(11)), 8), F.lit(WORDS))


def _bit(key: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(key, F.lit(11)), F.lit(64)).cast("int"))


def maybe_in(df: DataFrame, key: str, keys: DataFrame, other: str) -> DataFrame:
    """Rows of `df` whose key may be among `keys[other]`; no row that matches is dropped.

    The keys are hashed into a bitmap of fixed size, so what is broadcast never grows with the data;
    the more keys there are, the more rows pass, and the join that follows decides.  Null keys do
    not pass.  Columns of `df` keep their order.
    """
    words = keys.filter(F.col(other).isNotNull()).groupBy(_word(F.col(other)).alias("__word")).agg(F.bit_or(_bit(F.col(other))).alias("__bits"))
    hit = df.filter(F.col(key).isNotNull()).withColumn("__word", _word(F.col(key))).join(F.broadcast(words), "__word")
    return hit.filter(F.col("__bits").bitwiseAND(_bit(F.col(key))) != 0).select(*df.columns)
