"""N-gram Jaccard join by universe partition: segments of hashed shingles as join keys."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievelight.llm.common import small_batches
from sievelight.llm.components import components
from sievelight.llm.tokens import WHITE, release, text_slices
from sievelight.session import written

SHINGLE = 5
# Similarity of at least 4 / 5, as whole numbers.
NUMERATOR, DENOMINATOR = 4, 5
BASE = 0x5851F42D4C957F2D  # odd, so that it has an inverse modulo 2**64
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
FILTER_BITS = 1 << 24
# Words of 64 bits in the parity sketches of a set.
SKETCH = 16
SKETCHES = [f"s{i}" for i in range(SKETCH)]
FINE = 128


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(factor: int, n: int) -> np.ndarray:
    out = np.full(n, factor & (2**64 - 1), np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_POWERS: list[np.ndarray] = []


def powers(n: int) -> list[np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 21)
        _POWERS[:] = [_powers(BASE, size), _powers(pow(BASE, -1, 2**64), size)]
    return _POWERS


def shingle_sets(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, joined, and where each text's begin.

    Words are lower-cased (A-Z) runs of non-space bytes; a shingle is five of them, or all of a shorter
    text. Hashes have 64 bits.
    """
    n_texts = len(cuts) - 1
    empty = np.zeros(0, np.uint64), np.zeros(n_texts + 1, np.int64)
    if not len(data):
        return empty
    white = np.array(WHITE)
    white[28:32] = False
    ink = ~white[data]
    first = np.zeros(len(data) + 1, bool)
    first[cuts] = True
    begins = np.flatnonzero(ink & np.concatenate(([True], ~ink[:-1])) | ink & first[:-1])
    ends = np.flatnonzero(ink & np.concatenate((~ink[1:], [True])) | ink & first[1:]) + 1
    if not len(begins):
        return empty
    low = data + np.uint8(32) * ((data >= 65) & (data <= 90))
    up, down = powers(len(data))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64)))
    word = mix((sums[ends] - sums[begins]) * down[begins] + (ends - begins).astype(np.uint64) * FACTORS[0])
    owner = np.searchsorted(cuts, begins, "right") - 1
    per_text = np.bincount(owner, minlength=n_texts)
    start = np.cumsum(per_text) - per_text
    number = np.where(per_text >= SHINGLE, per_text - SHINGLE + 1, np.minimum(per_text, 1))
    text = np.repeat(np.arange(n_texts), number)
    at = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number) + start[text]
    length = np.minimum(per_text[text], SHINGLE)
    padded = np.concatenate((word, np.zeros(SHINGLE, np.uint64)))
    total = length.astype(np.uint64)
    for k in range(SHINGLE):
        total = total + np.where(k < length, padded[at + k], np.uint64(0)) * FACTORS[k]
    hashes = mix(total)
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    keep = np.append(True, (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1]))
    hashes, text = hashes[keep], text[keep]
    return hashes, np.searchsorted(text, np.arange(n_texts + 1))


def class_ids(hashes: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """One number per set: equal for equal sets."""
    sizes = np.diff(cuts)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(hashes + FACTORS[1]), dtype=np.uint64)))
    return mix((sums[cuts[1:]] - sums[cuts[:-1]]) + sizes.astype(np.uint64) * FACTORS[2]).view(np.int64)


@cache
def groups() -> dict[str, np.ndarray]:
    """The size groups and their allocation.

    Group k joins sets of which the smaller has ``low[k]`` to ``high[k]`` shingles, so the larger has at
    most ``top[k] = 5 / 4 high[k]``. Two sets with similarity 4 / 5 differ in at most a ninth of their
    sizes' sum, here at most ``most[k]`` shingles. Shingles are hashed into segments: ``ones`` single
    segments, in which equal subsets meet, and ``twos`` double ones, whose subsets also meet at one
    shingle's distance through their one-deletion neighbourhoods. A single segment uses up one unit, a
    double one two; with ``most + 1 + spare`` units, two similar sets meet in a double segment or in
    ``spare + 1`` single ones. So a set may leave out its ``spare`` dearest single segments, in an order
    all sets share, and still meet.

    ``twos`` and ``spare`` minimise an estimated cost per set: keys sent, and many times that for keys
    of the empty subset, which nearly all sets would share.
    """
    low, high = [1], [1]
    while high[-1] < 1 << 40:
        low.append(high[-1] + 1)
        high.append(max(high[-1] + 1, high[-1] * 25 // 16))
    low, high = np.array(low), np.array(high)
    top = high * DENOMINATOR // NUMERATOR
    most = (high + top) // 9
    ones, twos, spare = [], [], []
    for h, size in zip(most.tolist(), np.sqrt(low * high.astype(float)).tolist()):
        best = None
        for s in {0, *(max(1, math.ceil(f * (h + 1))) for f in (0.02, 0.05, 0.1, 0.15, 0.2, 0.3))} if h else {0}:
            units = h + 1 + s
            mean = size / units
            for t in {t for t in (0, 1, 2, 3, units // 8, units // 4) if 2 * t <= units - s}:
                one = units - 2 * t
                empty = max(0.0, one * math.exp(-mean) * 1.5 - s) + t * (1 + 2 * mean) * math.exp(-2 * mean)
                cost = one - s + t * (1 + 2 * mean) + 200 * empty
                if best is None or cost < best[0]:
                    best = cost, one, t, s
        ones.append(best[1])
        twos.append(best[2])
        spare.append(best[3])
    return {"low": low, "high": high, "top": top, "ones": np.array(ones), "twos": np.array(twos), "spare": np.array(spare)}


def segment_keys(hashes: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Join keys of the sets: ``(key, set)``."""
    g = groups()
    sizes = np.diff(cuts)
    own = np.searchsorted(g["high"], sizes)
    below = (own > 0) & (sizes <= g["top"][own - 1])
    full = sizes > 0
    sets = np.concatenate((np.flatnonzero(full), np.flatnonzero(full & below)))
    group = np.concatenate((own[full], own[full & below] - 1))
    if not len(sets):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ones, twos, spare = g["ones"][group], g["twos"][group], g["spare"][group]
    member = np.repeat(np.arange(len(sets)), sizes[sets])
    token = hashes[np.arange(len(member)) - np.repeat(np.cumsum(sizes[sets]) - sizes[sets], sizes[sets]) + cuts[sets][member]]
    salted = mix(token ^ (group[member].astype(np.uint64) * FACTORS[3]))
    unit = ((salted >> np.uint64(32)) * (ones + 2 * twos)[member].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
    segment = np.where(unit < ones[member], unit, (unit + ones[member]) // 2)
    segments = ones + twos
    offset = np.cumsum(segments) - segments
    at = offset[member] + segment
    total = int(segments.sum())
    sums, counts = np.zeros(total, np.uint64), np.bincount(at, minlength=total)
    value = mix(token + FACTORS[4])
    np.add.at(sums, at, value)
    of = np.repeat(np.arange(len(sets)), segments)
    place = np.arange(total) - offset[of]
    label = mix(group[of].astype(np.uint64) * FACTORS[0] + place.astype(np.uint64) * FACTORS[1])

    def key(sums: np.ndarray, counts: np.ndarray, label: np.ndarray) -> np.ndarray:
        return mix(sums + label + counts.astype(np.uint64) * FACTORS[2])

    keys = key(sums, counts, label)
    single = place < ones[of]
    # Single segments from dear to cheap: few shingles first. The first ``spare`` are left out.
    one = np.flatnonzero(single)
    order = one[np.lexsort((keys[one], counts[one], of[one]))]
    rank = np.arange(len(order)) - (np.cumsum(ones) - ones)[of[order]]
    kept = np.concatenate((order[rank >= spare[of[order]]], np.flatnonzero(~single)))
    # Double segments: the neighbourhood, too.
    near = np.flatnonzero(~single[at])
    near_keys = key(sums[at[near]] - value[near], counts[at[near]] - 1, label[at[near]])
    return (
        np.concatenate((keys[kept], near_keys)).view(np.int64),
        sets[np.concatenate((of[kept], member[near]))],
    )


def _sets(batches):
    """Per slice of a batch with ``text``: ``(batch, from, to, hashes, cuts, class ids)``."""
    release()
    for batch in batches:
        for i, j, data, bounds in text_slices(batch.column("text")):
            hashes, cuts = shingle_sets(data, bounds)
            yield batch, i, j, hashes, cuts, class_ids(hashes, cuts)


def sketches(hashes: np.ndarray, cuts: np.ndarray, words: int = SKETCH) -> np.ndarray:
    """Parity sketches of 64 ``words`` bits (a power of two), one row per set: each shingle flips one bit.

    Two sketches differ in at most as many bits as their sets differ in shingles.
    """
    n, bits = len(cuts) - 1, 64 * words
    bit = (mix(hashes ^ FACTORS[3]) >> np.uint64(64 - bits.bit_length() + 1)).astype(np.int64)
    odd = np.bincount(np.repeat(np.arange(n), np.diff(cuts)) * bits + bit, minlength=n * bits) & 1
    return np.packbits(odd.astype(np.uint8).reshape(n, words, 64), axis=2).view(np.int64).reshape(n, words)


def set_table(docs: DataFrame, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ``n_shingles, class, s0, ...`` per row; ``class`` is null for an empty set."""

    def run(batches):
        for batch, i, j, hashes, cuts, classes in _sets(batches):
            sizes = np.diff(cuts)
            for a in range(0, j - i, 500):
                b = min(a + 500, j - i)
                part = sketches(hashes[cuts[a] : cuts[b]], cuts[a : b + 1] - cuts[a])
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(name).slice(i + a, b - a) for name in keep),
                        pa.array(sizes[a:b]),
                        pa.array(classes[a:b], mask=sizes[a:b] == 0),
                        *(pa.array(np.ascontiguousarray(part[:, k])) for k in range(SKETCH)),
                    ],
                    names=[*keep, "n_shingles", "class", *SKETCHES],
                )

    kept = ", ".join(f"{name} {docs.schema[name].dataType.simpleString()}" for name in keep)
    words = ", ".join(f"{name} long" for name in SKETCHES)
    return docs.select(*keep, "text").mapInArrow(run, f"{kept}, n_shingles long, class long, {words}")


def may_link(a: str, b: str) -> Column:
    """False for sketches that rule a link out, by size or by the shingles that differ at least."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    differ = sum((F.bit_count(F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))) for s in SKETCHES), F.lit(0))
    return (DENOMINATOR * F.least(n, m) >= NUMERATOR * F.greatest(n, m)) & (9 * differ <= n + m)


def key_table(docs: DataFrame) -> DataFrame:
    """``key, class``: each task names a class once, so copies of a text do not pile up."""

    def run(batches):
        seen: set[int] = set()
        for _, _, _, hashes, cuts, classes in _sets(batches):
            new = np.zeros(len(classes), bool)
            for at, c in enumerate(classes.tolist()):
                if c not in seen:
                    new[at] = True
                    seen.add(c)
            keep = np.repeat(new, np.diff(cuts))
            sizes = np.where(new, np.diff(cuts), 0)
            keys, sets = segment_keys(hashes[keep], np.concatenate(([0], np.cumsum(sizes))))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(classes[sets])], names=["key", "class"])

    return docs.select("text").mapInArrow(run, "key long, class long")


def sets_of(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """``class, shingles, fine`` of the given classes, one row each; ``fine`` is a large parity sketch.

    A bitmap of fixed size tells the scan which classes are wanted, so that few others are sent.
    """
    words = classes.select(F.pmod("class", F.lit(FILTER_BITS)).alias("bit")).selectExpr(
        "cast(bit div 32 as int) AS word", "shiftleft(1L, cast(bit % 32 as int)) AS bits"
    )
    rows = words.groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    bitmap = np.zeros(FILTER_BITS // 32, np.uint32)
    bitmap[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches):
        seen: set[int] = set()
        for _, _, _, hashes, cuts, ids in _sets(batches):
            at = ids % FILTER_BITS
            wanted = (sent.value[at // 32] >> (at % 32).astype(np.uint32)) & 1
            wanted = (wanted == 1) & (np.diff(cuts) > 0)
            for k in np.flatnonzero(wanted):
                if int(ids[k]) in seen:
                    wanted[k] = False
                seen.add(int(ids[k]))
            sizes = np.where(wanted, np.diff(cuts), 0)[wanted]
            values = hashes[np.repeat(wanted, np.diff(cuts))].view(np.int64)
            ids, ends = ids[wanted], np.concatenate(([0], np.cumsum(sizes)))
            for a in range(0, len(ids), 100):
                b = min(a + 100, len(ids))
                own, at = values[ends[a] : ends[b]], ends[a : b + 1] - ends[a]
                fine = sketches(own.view(np.uint64), at, FINE)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[a:b]),
                        pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(own)),
                        pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * FINE), pa.array(fine.ravel())),
                    ],
                    names=["class", "shingles", "fine"],
                )

    found = docs.select("text").mapInArrow(run, "class long, shingles array<long>, fine array<long>")
    found = found.join(classes, "class", "left_semi").groupBy("class")
    return found.agg(F.first("shingles").alias("shingles"), F.first("fine").alias("fine"))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs ``a, b`` whose sets are similar, compared shingle by shingle.

    The fine sketches go first, so that few sets are sent along with pairs that do not link.
    """

    def side(name: str, *columns: str) -> DataFrame:
        return sets.select(F.col("class").alias(name), *(F.expr(c).alias(f"_{i}{name}") for i, c in enumerate(columns)))

    near = pairs.join(side("a", "fine", "size(shingles)"), "a").join(side("b", "fine", "size(shingles)"), "b")
    flips = F.aggregate(F.zip_with("_0a", "_0b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    near = near.filter(9 * flips <= F.col("_1a") + F.col("_1b")).select("a", "b")
    n, m = F.size("_0a"), F.size("_0b")
    both = F.size(F.array_intersect("_0a", "_0b"))
    return (
        near.join(side("a", "shingles"), "a")
        .join(side("b", "shingles"), "b")
        .filter(DENOMINATOR * both >= NUMERATOR * (n + m - both))
        .select("a", "b")
    )


def linked_classes(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``node, root`` of the classes that links lead to a smaller class; ``rows`` are of ``set_table``.

    Classes with a common key form a list. First each class is checked against one other, the one that
    leads most of its lists; a list is led by its class with the most meetings. A large group of near
    copies is mostly joined by this, at one check each, as their original leads them. Then,
    within each list, all pairs whose members are not yet in one component are checked, so no link
    between components is missed.
    Sketches go first: they rule out most pairs of a list without any set being moved, and never a link.
    """
    known = rows.filter("class is not null").groupBy("class").agg(
        F.first("n_shingles").alias("n"), *(F.first(s).alias(s) for s in SKETCHES)
    )
    met = key_table(docs).withColumn("_met", F.count("*").over(W.partitionBy("key"))).filter("_met > 1")
    met = written(met, "ngram-keys")
    # A hub, the text that others were copied from, meets them in more lists than they meet each other.
    degree = met.groupBy("class").agg(F.sum(F.col("_met") - 1).alias("_degree"))
    hubs = met.join(degree, "class").groupBy("key").agg(F.max_by("class", F.struct("_degree", "class")).alias("rep"))
    lists = met.select("key", "class").join(hubs, "key").filter("rep != class")
    lists = written(lists, "ngram-lists")
    members = lists.select("class").union(lists.select("rep")).distinct()
    known = written(known.join(members, "class", "left_semi"), "ngram-sketches")
    often = lists.groupBy("class", "rep").count().groupBy("class").agg(F.max(F.struct("count", "rep"))["rep"].alias("a"))
    stars = often.select("a", F.col("class").alias("b"))
    x, y = known.withColumnRenamed("class", "a").alias("x"), known.withColumnRenamed("class", "b").alias("y")
    stars = stars.join(x, "a").join(y, "b").filter(may_link("x", "y")).select("a", "b")
    stars = written(stars, "ngram-stars")
    links = _checked(docs, stars)
    roots = components(links)
    # Members of each list, with their components so far.
    everyone = lists.select("key", "class").union(lists.select("key", "rep")).distinct()
    named = everyone.join(roots.withColumnRenamed("node", "class"), "class", "left")
    named = named.withColumn("root", F.coalesce("root", "class"))
    heads = lists.groupBy("key").agg(F.min("rep").alias("rep"))
    heads = heads.join(roots.select(F.col("node").alias("rep"), F.col("root").alias("head")), "rep", "left")
    heads = heads.withColumn("head", F.coalesce("head", "rep"))
    # Only lists with two or more components go on; a pair has a member outside the smallest's.
    split = named.join(heads, "key").filter((F.col("root") != F.col("head")))
    named = named.join(split.select("key").distinct(), "key", "left_semi").join(known, "class")
    outside = split.select("key", "class", "root").join(known, "class").alias("x")
    named = named.alias("y")
    apart = F.col("x.root") != F.col("y.root")
    pairs = outside.join(named, (F.col("x.key") == F.col("y.key")) & apart & may_link("x", "y"))
    pairs = pairs.select(F.least("x.class", "y.class").alias("a"), F.greatest("x.class", "y.class").alias("b")).distinct()
    more = _checked(docs, pairs.join(stars, ["a", "b"], "left_anti"))
    return roots if more.isEmpty() else components(more.union(links))


def _checked(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The links among candidate pairs, written."""
    pairs = written(pairs, "ngram-pairs")
    if pairs.isEmpty():
        return pairs
    classes = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct()
    return written(verified(pairs, written(sets_of(docs, classes), "ngram-sets")), "ngram-links")


def _rows_and_roots(docs: DataFrame, keep: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The written ``set_table`` of the rows, and ``class, root`` of the linked classes."""
    docs = small_batches(docs).select(*keep, F.col("text").cast("string").alias("text"))
    rows = written(set_table(docs, keep), "ngram-rows")
    return rows, linked_classes(docs, rows).withColumnRenamed("node", "class")


def surplus_rows(docs: DataFrame, key: str) -> DataFrame:
    """The ``key`` of all rows but one of each component; ``key`` is unique and not null.

    The row with the smallest ``doc_id, key`` stays, one with a null doc_id only if no row has an id.
    Components are named by classes, so rows with one doc_id and different texts are apart. Rows without
    shingles are not listed.
    """
    rows, roots = _rows_and_roots(docs, ("doc_id", key))
    rows = rows.filter("class is not null")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", key)
    first = rows.groupBy("class").agg(F.min(order).alias("first")).join(roots, "class", "left")
    stay = first.groupBy(F.coalesce("root", "class").alias("root")).agg(F.min("first").alias("first"))
    return rows.select(key).join(stay.select(f"first.{key}"), key, "left_anti")


def join_components(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of ``doc_id, text``.

    Documents link when their sets of word 5-shingles have a Jaccard similarity of 0.8 or more;
    ``component_id`` is the smallest doc_id that links lead to. Texts with equal sets are one class, and
    only classes are joined. Null, empty and blank texts have no shingles and link with nothing; rows
    with a null doc_id lend no name (alone, their component is null); rows with equal doc_ids are rows
    of their own. Shingles and classes are compared by 64-bit hashes.
    """
    rows, roots = _rows_and_roots(docs, ("doc_id",))
    classes = rows.filter("class is not null").groupBy("class").agg(F.min("doc_id").alias("_first"), F.count("*").alias("_n"))
    named = classes.join(roots, "class", "left")
    named = named.withColumn("root", F.coalesce("root", "class"))
    ids = named.groupBy("root").agg(F.min("_first").alias("component_id"), F.sum("_n").alias("_all"))
    # Classes that stand alone name themselves.
    shared = named.join(ids.filter("_all > 1"), "root").select("class", "component_id")
    return rows.select("doc_id", "n_shingles", "class").join(shared, "class", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
