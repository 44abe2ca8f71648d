"""Text checks: cleaning, lengths, flags and exact copies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelight.config import Config
from sievelight.functions import text as fn
from sievelight.functions.binding import let
from sievelight.operators import bloom
from sievelight.session import written

Key = str | Sequence[str]


def _keys(key: Key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def _firsts(digests: DataFrame, keys: list[str]) -> DataFrame:
    """``key, _copies``: the smallest key of each digest, one row per digest."""
    groups = digests.groupBy("_digest").agg(F.min(F.struct(*keys)).alias("_first"), F.count(F.lit(1)).alias("_copies"))
    return groups.select(*[F.col(f"_first.{k}").alias(k) for k in keys], "_copies")


def copied_keys(df: DataFrame, text_col: str, key: Key) -> DataFrame:
    """``key, _copies`` of the rows whose text occurs more than once; ``_copies`` is null but for the first.

    Texts are read once, for their digests; then only keys and digests move.
    """
    keys = _keys(key)
    digests = written(df.select(*keys, fn.digest(F.col(text_col)).alias("_digest")), "digests")
    return digests.select(*keys).join(_firsts(digests, keys), keys, "left").where("_copies is null or _copies > 1")


def mark_copies(
    df: DataFrame,
    text_col: str,
    key: Key,
    first: str | None = None,
    any_: str | None = None,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Flag exact copies of ``text_col``.

    ``first``: all rows but the one with the smallest key of their group.
    ``any_``: every row of a group of two or more.

    Groups are counted by digest with map-side partial sums, so a text shared by a third of the rows
    is one counter, never one task. The result goes back by the row key, which is unique and spreads
    evenly: a row is an original exactly when its key is the first of some group. ``key`` must be
    unique and not null.

    A Bloom filter of the keys of copies, small enough for every task, decides most rows where they
    lie; only those it picks meet the keys themselves, so texts of rows without a copy never move.
    A frame that comes out of a join by ``key`` meets one key per group as it lies: give ``counted``, the
    same keys and texts with a shorter lineage, so that the joins already in ``df`` run once.
    """
    keys = _keys(key)
    kept = [c for c in df.columns if c not in (first, any_)]

    def flags(copied: Column) -> list[Column]:
        """``copied`` is null for a copy and the size of the group for its first."""
        made = [copied.isNull().alias(first)] if first else []
        return made + ([(copied.isNull() | (copied > 1)).alias(any_)] if any_ else [])

    if counted is not None:
        firsts = _firsts(counted.select(*keys, fn.digest(F.col(text_col)).alias("_digest")), keys)
        return df.select(*kept).join(firsts, keys, "left").select(*kept, *flags(F.col("_copies")))
    copies = copied_keys(df, text_col, key)
    copies = copies if any_ else copies.where("_copies is null")
    picked = bloom.maybe(bloom.filter_bits(copies, *keys), *keys)
    alone = df.where(~picked).select(*kept, *flags(F.lit(1)))
    met = df.where(picked).select(*kept).join(copies.withColumn("_met", F.lit(True)), keys, "left")
    copied = F.when(F.col("_met"), F.col("_copies")).otherwise(F.lit(1))
    return alone.unionByName(met.select(*kept, *flags(copied)))


def drop_copies(df: DataFrame, text_col: str, key: Key) -> DataFrame:
    """Keep the row with the smallest key of each group of equal texts."""
    return (
        mark_copies(df, text_col, key, first="_copy").where(~F.col("_copy")).drop("_copy")
    )


def checked_text(text: Column, cfg: Config, collapse: bool) -> Column:
    """All row-local results for one text as a struct, so that the text is cleaned once per use.

    ``collapse`` turns inner runs of whitespace into one space; without it only the ends are stripped.
    """
    raw = F.coalesce(text.cast("string"), F.lit(""))
    collapsed = fn.strip_and_collapse(raw)

    def measured(clean: Column, one_spaced: Column) -> Column:
        length = fn.char_length(clean)
        empty, short = clean == "", length < cfg.min_text_length
        long = length > cfg.max_text_length
        return F.struct(
            clean.alias("text_clean"),
            length.alias("char_length"),
            fn.word_count(one_spaced).alias("word_count"),
            fn.special_only(clean).alias("has_special_only"),
            text.isNull().alias("is_null"),
            empty.alias("is_empty"),
            short.alias("too_short"),
            long.alias("too_long"),
            (text.isNotNull() & ~empty & ~short & ~long).alias("is_valid"),
        )

    if collapse:
        return let(collapsed, lambda c: measured(c, c))
    return let(fn.strip(raw), lambda c: measured(c, fn.collapse_whitespace(c)))


def _checks(df: DataFrame, text_col: str, cfg: Config, collapse: bool, names: dict[str, str]) -> DataFrame:
    """Add the named fields of ``checked_text``: ``{output column: field}``."""
    checked = df.withColumn("_t", checked_text(F.col(text_col), cfg, collapse))
    kept = [c for c in df.columns if c not in names]
    return checked.select(*kept, *[F.col(f"_t.{f}").alias(c) for c, f in names.items()])


METRICS = {"text_clean": "text_clean", "char_length": "char_length", "word_count": "word_count"}
BASIC = {
    **METRICS, "is_null": "is_null", "is_empty": "is_empty", "too_short": "too_short",
    "too_long": "too_long", "is_valid": "is_valid",
}
ML = {
    **METRICS, "has_special_only": "has_special_only", "text_is_null": "is_null",
    "text_is_empty": "is_empty", "text_too_short": "too_short", "text_too_long": "too_long",
    "text_valid": "is_valid",
}


def clean_columns(
    df: DataFrame, text_col: str, collapse: bool, cfg: Config = Config()
) -> DataFrame:
    """Add ``text_clean``, ``char_length`` and ``word_count``."""
    return _checks(df, text_col, cfg, collapse, METRICS)


def row_checks_ml(df: DataFrame, text_col: str, cfg: Config = Config()) -> DataFrame:
    """The row-local part of ``validate_text_ml``; also runs on a stream."""
    return _checks(df, text_col, cfg, True, ML)


def validate_text_ml(df: DataFrame, text_col: str, key: Key, cfg: Config = Config()) -> DataFrame:
    """Ten columns; a copy is any row but the first of its group. No text column: unchanged."""
    if text_col not in df.columns:
        return df
    checked = row_checks_ml(df, text_col, cfg)
    return mark_copies(checked, "text_clean", key, first="text_is_duplicate")


def validate_text_basic(
    df: DataFrame, text_col: str, key: Key, cfg: Config = Config()
) -> DataFrame:
    """Nine columns; whitespace inside the text stays, and every member of a group is a copy."""
    checked = _checks(df, text_col, cfg, False, BASIC)
    return mark_copies(checked, "text_clean", key, any_="is_duplicate")


def with_row_key(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Give rows without an id a unique key.

    Put it straight on a file scan: the number is made of the split and the position in it, so a lost
    task gets the same numbers again.
    """
    return df.withColumn(name, F.monotonically_increasing_id())
