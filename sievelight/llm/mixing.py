"""Mixing of sources to target weights, by fixed-length blocks of words."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievelight.functions.binding import let
from sievelight.llm.common import ROW, SPACE, before, with_row_key, words
from sievelight.session import written

# Rounds of the index permutations.
ROUNDS = 6
# Rows made from one row at a time when blocks are listed.
LISTED = 1 << 14


def _size(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """``sid, source, source_size, target`` of rows with ``source, size``; one row per source.

    Sources in code point order (null last) weigh ``weights`` in turn and share the sum of all sizes;
    no target is above ``most`` times the source's size. What a capped source leaves is shared by
    weight again until none is above: with sources in the order of cap over weight, the first one whose
    cap is not reached by the level of the rest sets the level for all from there on.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = W.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    given = F.array(*(F.lit(w) for w in weights))
    named = totals.withColumn("sid", F.row_number().over(by_name) - 1)
    named = named.withColumn("_w", F.get(given, F.col("sid") % len(weights)).cast("long"))
    named = named.withColumn("_cap", most * F.col("source_size"))
    whole = W.partitionBy(F.lit(0))
    by_cap = whole.orderBy(F.col("_cap") / F.col("_w"), "sid")
    earlier = by_cap.rowsBetween(W.unboundedPreceding, -1)
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(earlier), F.lit(0))
    weight = F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(earlier), F.lit(0))
    named = named.withColumn("_level", left / weight)
    open_ = F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.col("_level"))
    # The first open source in order has the smallest level among the open ones' candidates.
    named = named.withColumn("_open", F.first(open_, ignorenulls=True).over(by_cap.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    target = F.least(F.col("_cap").cast("double"), F.coalesce("_open", F.lit(0.0)) * F.col("_w"))
    return named.select("sid", "source", "source_size", target.alias("target"))


def _listed(plan: DataFrame, number: str, out: str, *by: str) -> DataFrame:
    """Rows 0 to ``number - 1`` for each row, made in pieces that any task may take; ``by`` names a row."""
    pieces = plan.filter(F.col(number) > 0).withColumn(
        "_piece", F.explode(F.sequence(F.lit(0).cast("long"), (F.col(number) - 1).cast("long"), F.lit(LISTED).cast("long")))
    )
    pieces = pieces.repartition(*by, "_piece")
    last = F.least(F.col("_piece") + LISTED, F.col(number).cast("long")) - 1
    return pieces.withColumn(out, F.explode(F.sequence("_piece", last))).drop("_piece")


def permuted(place: Column, n: Column, *key: Column) -> Column:
    """The image of ``place`` under a pseudorandom permutation of 0 .. n - 1 of its own for each ``key``.

    A place is two digits (high, low) in a grid of at least n cells; every round adds a keyed hash of one
    digit to the other. An image beyond n - 1 is sent through the rounds again until one lies below. The
    grid has fewer than sqrt(n) + 1 cells too many, which bounds that walk; one place in sqrt(n) takes it.
    """
    left = F.floor(F.sqrt(F.greatest(n - 1, F.lit(0)).cast("double"))).cast("long") + 1
    size = F.struct(n.cast("long").alias("n"), left.alias("left"), F.greatest(F.ceil(n / left), F.lit(1)).cast("long").alias("right"))

    def digits(high: Column, low: Column) -> Column:
        return F.struct(high.cast("long").alias("high"), low.cast("long").alias("low"))

    def once(x: Column, g: Column) -> Column:
        def step(d: Column, i: Column) -> Column:
            low = digits(d["high"], (d["low"] + F.pmod(F.xxhash64(*key, i, d["high"]), g["right"])) % g["right"])
            high = digits((d["high"] + F.pmod(F.xxhash64(*key, i, d["low"]), g["left"])) % g["left"], d["low"])
            return F.when(i % 2 == 1, low).otherwise(high)

        start = digits(F.floor(x / g["right"]), x % g["right"])
        return F.aggregate(F.array(*map(F.lit, range(ROUNDS))), start, step, lambda d: d["high"] * g["right"] + d["low"])

    def walked(g: Column) -> Column:
        def on(x: Column) -> Column:
            again = F.sequence(F.lit(1).cast("long"), F.greatest(g["left"] * g["right"] - g["n"], F.lit(1).cast("long")))
            return F.when(x < g["n"], x).otherwise(F.aggregate(again, x, lambda y, _: F.when(y < g["n"], y).otherwise(once(y, g))))

        return let(once(place.cast("long"), g), on)

    return let(size, walked)


def shard_counts(plan: DataFrame, shards: int, seed: int) -> DataFrame:
    """``sid, shard, number, from``: how many of a source's ``_slots`` each output shard gets, and the first.

    A multinomial draw with equal shares per source: its slots are thrown to the shards and counted. Given
    that sources meet their targets, a shard's counts over the sources are its multinomial draw.
    """
    thrown = _listed(plan.select("sid", "_slots"), "_slots", "_throw", "sid")
    shard = F.pmod(F.xxhash64(F.lit(seed), "sid", "_throw"), F.lit(shards)).cast("int")
    counts = thrown.groupBy("sid", shard.alias("shard")).agg(F.count("*").alias("number"))
    return before(counts, "shard", "number", "from", ["sid"])


def draw(targets: DataFrame, block: int, shards: int, seed: int) -> DataFrame:
    """Slots of the mix: ``sid, index, epoch, words, shard, slot``.

    A source gives its target in whole words: full passes over its blocks, then part of one. Every shard
    gets a drawn number of the source's slots, as a range of slot numbers. Slot ``j`` of pass ``epoch``
    takes the block at the place that ``j`` has in the permutation of (seed, source, pass), so each pass
    has an order of its own; the last, short block stays at the end. The last slot of the part pass takes
    only the words that are missing. ``slot`` orders a shard.
    """
    size, quota = F.col("source_size"), F.floor(F.col("target") + 0.5).cast("long")
    plan = targets.filter((size > 0) & (quota > 0)).select("sid", "source_size", quota.alias("_quota"))
    per_pass = F.expr(f"(source_size + {block - 1}) div {block}")
    part = F.expr(f"(_quota % source_size + {block - 1}) div {block}")
    plan = plan.select("*", per_pass.alias("_per_pass"), (F.expr("_quota div source_size") * per_pass + part).alias("_slots"))
    counts = written(shard_counts(plan, shards, seed), "mix-counts")
    rows = _listed(counts.join(plan.drop("_slots"), "sid"), "number", "_k", "sid", "shard")
    rows = rows.withColumn("_slot", F.col("from") + F.col("_k"))
    rows = rows.withColumns({"epoch": F.expr("_slot div _per_pass"), "_j": F.expr("_slot % _per_pass"), "_full": F.expr(f"source_size div {block}")})
    full, j = F.col("_full"), F.col("_j")
    wanted = F.least(size, F.col("_quota") - F.col("epoch") * size)
    mapped = F.when(j < full, permuted(j, full, F.lit(seed), F.col("sid"), F.col("epoch")))
    return rows.select(
        "sid",
        F.coalesce(mapped, full).alias("index"),
        "epoch",
        F.least(F.lit(block), wanted - j * block).cast("long").alias("words"),
        "shard",
        F.xxhash64(F.lit(seed), "sid", "_slot", F.lit("order")).alias("slot"),
    )


def mix(
    docs: DataFrame,
    block: int = 256,
    shards: int = 64,
    weights: tuple[int, ...] = (1, 2, 3),
    most: int = 3,
    seed: int = 0,
    key: str = "doc_id",
) -> tuple[DataFrame, DataFrame]:
    """Mix ``doc_id, text, source`` to target weights; sizes are words.

    Documents of a source follow each other in the order of md5(doc_id, text), and their words are cut into
    blocks. Places come from two levels of sums: within a bucket of neighbouring md5 values (about the
    square root of the number of documents each), and over the buckets of a source; so a source with a
    third of all rows is spread like the others. Blocks and slots meet by (source, index).

    Returns two frames. The documents: ``row`` (a key), ``key`` (the column of that name), ``doc_id,
    size, source_size, target``. The
    mix: ``row, sid, index, epoch, shard, slot, from, to``, the words [from, to) of a document that a
    slot takes.

    Null and blank texts have size 0 and are never taken. A null source is a source, in the last place.
    Rows with equal or null doc_ids stay apart, placed by their texts; wholly equal rows lie in one bucket. A source without
    words has target 0. Empty table: no rows. Same rows, same mix: nothing depends on partitioning.
    """
    sized = docs.select(
        F.col(key).alias("key"),
        "doc_id",
        F.col("source").cast("string").alias("source"),
        _size(F.col("text").cast("string")).alias("size"),
        F.xxhash64("text").alias("_text"),
        F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.xxhash64("text").cast("string"))).alias("_place"),
    )
    sized = written(sized, "mix-sizes")
    targets = written(source_targets(sized, weights, most), "mix-targets")
    buckets = max(1, math.isqrt(sized.count()))
    prefix = F.conv(F.substring("_place", 1, 8), 16, 10).cast("long")
    bucket = F.floor(prefix * buckets / 2**32).cast("long")
    # One row per source.
    rows = sized.join(targets, sized.source.eqNullSafe(targets.source)).select(
        "key", "doc_id", "size", "sid", "source_size", "target", "_place", "_text", bucket.alias("_bucket")
    )
    sums = rows.groupBy("sid", "_bucket").agg(F.sum("size").alias("_sum"))
    offsets = before(sums, "_bucket", "_sum", "_before", ["sid"]).drop("_sum")
    own = W.partitionBy("sid", "_bucket").orderBy("_place", "doc_id", "size", "_text")
    placed = (
        rows.withColumn("_n", F.row_number().over(own))
        .withColumn("_to", F.sum("size").over(own.rowsBetween(W.unboundedPreceding, W.currentRow)))
        .join(offsets, ["sid", "_bucket"])
        .select(
            F.struct("sid", "_bucket", "_n").alias("row"),
            "key",
            "doc_id",
            "size",
            "source_size",
            "target",
            "sid",
            (F.col("_before") + F.col("_to") - F.col("size")).alias("_start"),
        )
    )
    placed = written(placed, "mix-places")
    pieces = placed.filter("size > 0").select(
        "row",
        "sid",
        "_start",
        "size",
        F.explode(F.expr(f"sequence(_start div {block}, (_start + size - 1) div {block})")).alias("index"),
    )
    slots = draw(targets, block, shards, seed)
    begin = F.greatest(F.col("index") * block, F.col("_start"))
    end = F.least(F.col("index") * block + F.col("words"), F.col("_start") + F.col("size"))
    # All frames here grow with the documents: none is broadcast, however small its files look.
    taken = pieces.hint("merge").join(slots, ["sid", "index"]).filter(begin < end)
    taken = taken.select(
        "row", "sid", "index", "epoch", "shard", "slot", (begin - F.col("_start")).alias("from"), (end - F.col("_start")).alias("to")
    )
    return placed.drop("sid", "_start"), taken


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of a mix."""
    rows, taken = mix(docs, **options)
    sums = taken.groupBy("row").agg(F.sum(F.col("to") - F.col("from")).alias("taken"))
    return rows.hint("merge").join(sums, "row", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken")
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: each stretch of neighbouring words that one pass takes, as a row.

    Keeps the columns of ``docs`` (``n_chars`` is counted anew if there), with
    the white space inside a stretch as it was.
    """
    keyed = with_row_key(docs)
    rows, taken = mix(keyed.select(ROW, "doc_id", "text", "source"), key=ROW, **options)
    spans = taken.groupBy("row", "epoch").agg(F.sort_array(F.collect_list(F.struct("from", "to"))).alias("_spans"))
    # Neighbouring spans of one pass become one.
    joined = F.aggregate(
        "_spans",
        F.expr("cast(array() as array<struct<from:bigint,to:bigint>>)"),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["to"] == s["from"]),
            F.concat(
                F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))),
                F.array(F.struct(F.get(acc, F.size(acc) - 1)["from"].alias("from"), s["to"].alias("to"))),
            ),
        ).otherwise(F.concat(acc, F.array(s))),
    )
    chosen = spans.hint("merge").join(rows.select("row", F.col("key").alias(ROW)), "row").select(ROW, "epoch", F.inline(joined))
    chosen = chosen.withColumnRenamed("from", "_from").withColumnRenamed("to", "_to").drop("epoch")
    units = F.regexp_extract_all("text", F.lit(f"[^{SPACE}]+[{SPACE}]*"), F.lit(0))
    stretch = F.array_join(F.slice(units, (F.col("_from") + 1).cast("int"), (F.col("_to") - F.col("_from")).cast("int")), "")
    whole = (F.col("_from") == 0) & (F.size(words(F.col("text"))) == F.col("_to"))
    out = keyed.hint("merge").join(chosen, ROW).withColumn("text", F.when(whole, F.col("text")).otherwise(F.rtrim(stretch)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)
