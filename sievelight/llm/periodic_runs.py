"""Maximal periodic runs of words, found by uniting suffix classes in order of falling common prefixes."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelight.llm.common import small_batches, words

CHUNK = 1000
SLICE_BYTES = 4_000_000
WHITE = b" \t\n\x0b\x0c\r"
RUNS = "array<struct<start: long, length: long, period: long>>"


class Positions:
    """An ordered set of positions in chunks, so that an insertion moves few of them."""

    __slots__ = ("chunks", "firsts", "size")

    def __init__(self, a: int, b: int):
        self.chunks, self.firsts, self.size = [[a, b] if a < b else [b, a]], [min(a, b)], 2

    def add(self, x: int) -> None:
        at = max(bisect_right(self.firsts, x) - 1, 0)
        chunk = self.chunks[at]
        i = bisect_left(chunk, x)
        chunk.insert(i, x)
        if not i:
            self.firsts[at] = x
        if len(chunk) > 2 * CHUNK:
            self.chunks[at : at + 1] = [chunk[:CHUNK], chunk[CHUNK:]]
            self.firsts.insert(at + 1, chunk[CHUNK])
        self.size += 1

    def around(self, x: int) -> tuple[int | None, int | None]:
        """The neighbours of the member ``x``."""
        at = bisect_right(self.firsts, x) - 1
        chunk = self.chunks[at]
        i = bisect_left(chunk, x)
        left = chunk[i - 1] if i else (self.chunks[at - 1][-1] if at else None)
        right = chunk[i + 1] if i + 1 < len(chunk) else (self.chunks[at + 1][0] if at + 1 < len(self.chunks) else None)
        return left, right

    def __iter__(self):
        for chunk in self.chunks:
            yield from chunk


def coded(text: str) -> np.ndarray:
    """A number per word, equal for equal words; the text is split slice by slice."""
    data, codes, parts, at = text.encode(), {}, [], 0
    while at < len(data):
        end = min(at + SLICE_BYTES, len(data))
        while end < len(data) and data[end] not in WHITE:
            end += 1
        piece = data[at:end].split()
        parts.append(np.fromiter((codes.setdefault(w, len(codes)) for w in piece), np.int32, len(piece)))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.int32)


def _pairs(first: np.ndarray, step: int) -> np.ndarray:
    """Ranks of windows twice as long, from ranks of windows and those ``step`` further on."""
    n = len(first) - 1
    ahead = np.full(n, -1, np.int64)
    ahead[: max(n - step, 0)] = first[step:n]
    key = first[:n].astype(np.int64) * (n + 2) + ahead + 1
    return np.append(np.unique(key, return_inverse=True)[1], -1).astype(np.int32)


def find(codes: np.ndarray, least: int = 12) -> np.ndarray:
    """Rows ``start, length, period`` of all maximal runs of at least ``least`` words, by start, then period.

    A run holds its smallest period q at least twice. Its suffixes at start and start + q share exactly
    ``length - q`` words. When the classes of suffixes are united in order of falling common prefixes,
    these two become neighbours in one class at that very union: a position between them would give the
    run a smaller period. So every newly neighbouring pair at a distance of at most the common prefix
    that cannot be moved one word to the left is one run, with its smallest period, and found once.

    Prefixes shorter than ``least / 2`` words cannot seed a run that is long enough and are not united;
    texts without a repeated window of that many words stop there.
    """
    n, short = len(codes), (least + 1) // 2
    none = np.zeros((0, 3), np.int64)
    if n < least:
        return none
    # Ranks of windows of 1, 2, 4, ... words; positions past the end have rank -1.
    levels, size = [(1, np.append(np.unique(codes, return_inverse=True)[1], -1).astype(np.int32))], 1
    while True:
        rank = levels[-1][1]
        apart = int(rank.max()) + 1 == n
        if apart and size <= short:
            return none
        if apart:
            break
        levels.append((2 * size, _pairs(rank, size)))
        size *= 2
    order = np.argsort(rank[:n], kind="stable")
    a, b = order[:-1], order[1:]
    shared = np.zeros(n - 1, np.int64)
    for size, rank in reversed(levels):
        shared += size * (rank[a + shared] == rank[b + shared])
    edges = np.flatnonzero(shared >= short)
    edges = edges[np.argsort(-shared[edges], kind="stable")]

    parent: dict[int, int] = {}
    sets: dict[int, Positions] = {}

    def top(x: int) -> int:
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent.get(x, x)
        return root

    seeds = []  # (start, next start, shared words)
    for x, y, common in zip(a[edges].tolist(), b[edges].tolist(), shared[edges].tolist()):
        x, y = top(x), top(y)
        p, q = sets.get(x), sets.get(y)
        if p is None and q is None:
            parent[x] = y
            sets[y] = Positions(x, y)
            if abs(x - y) <= common:
                seeds.append((min(x, y), max(x, y), common))
            continue
        if q is None or (p is not None and p.size > q.size):
            x, y, p, q = y, x, q, p
        parent[x] = y
        moved = (x,) if p is None else tuple(sets.pop(x))
        for i in moved:
            q.add(i)
        own = set(moved)
        for i in moved:
            # Two members of the moved class are no new pair.
            left, right = q.around(i)
            if left is not None and left not in own and i - left <= common:
                seeds.append((left, i, common))
            if right is not None and right not in own and right - i <= common:
                seeds.append((i, right, common))
    if not seeds:
        return none
    i, j, common = np.array(seeds, np.int64).T
    found = np.stack([i, j - i + common, j - i], 1)
    found = found[((i == 0) | (codes[i - 1] != codes[j - 1])) & (found[:, 1] >= least)]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def kept(n: int, runs: np.ndarray) -> np.ndarray:
    """False for the words that some run holds after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:n]) == 0


def find_runs(docs: DataFrame, least: int = 12) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of every text: its maximal periodic runs and the text without repeats.

    ``runs`` lists ``start, length, period`` in words by start, then period; ``collapsed`` joins by one
    space the words that no run holds after its first period.

    Nothing is shuffled: a text is searched whole where it lies. A null or blank text has no words, no
    runs and an empty ``collapsed``; repeated and null doc_ids are rows of their own; an empty table gives
    no rows; other columns are left out. Memory for the time of one search:
    some 40 bytes a word, and some 300 for each word in a repeated window (320 MB for a million of them).
    """
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            sizes, rows, texts = [], [], []
            for text in batch.column("text").to_pylist():
                text = text or ""
                codes = coded(text)
                runs = find(codes, least)
                sizes.append(len(codes))
                rows.append(runs)
                parts = text.encode().split()
                if len(runs):
                    parts = [w for w, k in zip(parts, kept(len(codes), runs).tolist()) if k]
                texts.append(b" ".join(parts).decode())
            cuts = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
            flat = np.concatenate(rows) if rows else np.zeros((0, 3), np.int64)
            each = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"])
            lists = pa.ListArray.from_arrays(pa.array(cuts), each)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), lists, pa.array(texts, pa.string())],
                names=["doc_id", "n_words", "runs", "collapsed"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    narrow = small_batches(docs).select("doc_id", F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, f"doc_id {kind}, n_words long, runs {RUNS}, collapsed string")


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: in a tenth of the documents the words from some place on become periodic.

    With h the crc32 of the decimal doc_id, g = h div 10 and n words: if h mod 10 is 0 and n > 0, each word
    i >= a = g mod n becomes word a + (i - a) mod p, p = 1 + (n - a) div (3 + g mod 8). Rows without a
    doc_id stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), h.alias("_h"))
    rows = rows.withColumn("_w", F.when(F.col("_h") % 10 == 0, words(F.col("text"))))
    rows = rows.withColumns({"_n": F.size("_w"), "_g": F.expr("_h div 10")})
    rows = rows.withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")).cast("int"))
    rows = rows.withColumn("_p", F.expr("cast(1 + (_n - _a) div (3 + _g % 8) as int)"))
    tail: Column = F.transform(
        F.sequence(F.lit(0), F.col("_n") - 1),
        lambda i: F.get("_w", F.when(i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % F.col("_p"))),
    )
    return rows.select("doc_id", F.when(F.col("_n") > 0, F.array_join(tail, " ")).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """Counts, the longest run (ties: smallest start, then period) and checksums of what ``find_runs`` gives."""
    best = F.array_max(
        F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")))
    )
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("_best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("_best.start")).alias("start"),
        F.col("_best.length").alias("length"),
        (-F.col("_best.period")).alias("period"),
        F.expr("1000 * _best.length div -_best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
