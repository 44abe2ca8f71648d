"""A Bloom filter over the keys of a table, of a fixed size whatever the table holds.

The bits are set by a map-side OR per 64-bit word, so a task sends each word once. The filter is one
array of 256 KB to every task (a bound that does not grow); with more keys than it can tell apart
it answers "maybe" more often, which costs work but never a wrong row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 1 << 15
PROBES = 4


def _word_and_mask(keys: Sequence[Column]) -> tuple[Column, Column]:
    """The one word of a key, and PROBES of its bits, so that a test reads one word."""
    hashed = F.xxhash64(*keys)
    mask = F.lit(0).cast("long")
    for i in range(PROBES):
        bit = F.shiftrightunsigned(hashed, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return F.shiftrightunsigned(hashed, 64 - (WORDS - 1).bit_length()).cast("int"), mask


def filter_bits(rows: DataFrame, *keys: str) -> Column:
    """The filter of the keys of ``rows`` as a scalar: one array of WORDS words."""
    word, mask = _word_and_mask([F.col(k) for k in keys])
    empty = rows.sparkSession.range(0, WORDS, 1, 1).select(F.col("id").cast("int").alias("_word"), F.lit(0).cast("long").alias("_bits"))
    words = rows.select(word.alias("_word"), mask.alias("_bits")).unionByName(empty).groupBy("_word").agg(F.bit_or("_bits").alias("_bits"))
    # One task, WORDS words and no more.
    packed = words.agg(F.array_sort(F.collect_list(F.struct("_word", "_bits"))).alias("_all"))
    return packed.select(F.transform("_all", lambda w: w["_bits"]).alias("_all")).scalar()


def maybe(bits: Column, *keys: str) -> Column:
    """False only for keys that are not in the filter."""
    word, mask = _word_and_mask([F.col(k) for k in keys])
    return F.get(bits, word).bitwiseAND(mask) == mask
