"""Lines that stand in several documents stay in the first only; the result is one keep bitmap per document."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelight.llm.common import SPACE_CHARS, shuffle_parts, small_batches
from sievelight.session import written

WHITE = SPACE_CHARS.encode()
# A null doc_id counts as this one, before all others.
NO_ID = -(2**63)
BITMAPS = "doc long, text_key long, n_dropped int, keep binary"


def document(doc_id: Column, text: Column) -> list[Column]:
    """What names a document in the bitmaps: its id and a hash of its text, as ids may be repeated."""
    return [
        F.coalesce(doc_id.cast("long"), F.lit(NO_ID)).alias("doc"),
        F.xxhash64(F.coalesce(text.cast("string"), F.lit(""))).alias("text_key"),
    ]


def line_hashes(docs: DataFrame, least: int = 10) -> DataFrame:
    """``h1, h2, doc, text_key, line``: a 128-bit hash of each line whose key has ``least`` code points.

    The key is the line without white space at its ends and with A-Z lower-cased.
    """
    import pyarrow as pa
    import xxhash

    schema = "h1 long, h2 long, doc long, text_key long, line int"

    def run(batches):
        for batch in batches:
            hashes, sizes, places = [], [], []
            for text in batch.column("text").to_pylist():
                found = 0
                for at, line in enumerate((text or "").encode().split(b"\n")):
                    key = line.strip(WHITE).lower()
                    if len(key) >= least and (key.isascii() or len(key.decode()) >= least):
                        hashes.append(xxhash.xxh3_128_digest(key))
                        places.append(at)
                        found += 1
                sizes.append(found)
            both = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
            each = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(both[:, 0].copy()),
                    pa.array(both[:, 1].copy()),
                    batch.column("doc").take(each),
                    batch.column("text_key").take(each),
                    pa.array(places, pa.int32()),
                ],
                names=["h1", "h2", "doc", "text_key", "line"],
            )

    rows = small_batches(docs).select(*document(F.col("doc_id"), F.col("text")), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, schema)


def later_lines(lines: DataFrame) -> DataFrame:
    """``doc, text_key, line`` of the lines whose hash stands in a document with a smaller id.

    Lines are dealt to ranges of (hash, document, line) and sorted there, so a hash with any share of all
    lines is spread over as many ranges as it fills. Each range is streamed once: the first line of a hash
    names the document that keeps it. Only the hash a range begins with may have begun in a range before;
    its lines wait for the ranges' last hashes, one row per range, which are sent to all.
    """
    import pyarrow as pa

    names = ["edge", "h1", "h2", "first", "doc", "text_key", "line"]

    def run(batches):
        opening = last = None  # (h1, h2) of the range's first line; (h1, h2, first document) of the latest line
        for batch in batches:
            h1, h2, doc, key, line = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            if not len(h1):
                continue
            opening = opening or (h1[0], h2[0])
            new = np.ones(len(h1), bool)
            new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            new[0] = last is None or last[:2] != (h1[0], h2[0])
            starts = np.flatnonzero(new)
            first = np.empty(len(h1), np.int64)
            head = starts[0] if len(starts) else len(h1)
            if head:
                first[:head] = last[2]
            first[head:] = np.repeat(doc[starts], np.diff(np.append(starts, len(h1))))
            last = (h1[-1], h2[-1], first[-1])
            waits = (h1 == opening[0]) & (h2 == opening[1])
            out = np.flatnonzero((doc != first) | waits)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (waits[out], h1[out], h2[out], first[out], doc[out], key[out], line[out])], names=names
            )
        if last is not None:
            own = [pa.array([x], pa.int64()) for x in last]
            yield pa.RecordBatch.from_arrays(
                [pa.array([None], pa.bool_()), *own, *(pa.array([None], t) for t in (pa.int64(), pa.int64(), pa.int32()))], names=names
            )

    order = ["h1", "h2", "doc", "line"]
    dealt = lines.repartitionByRange(shuffle_parts(lines.sparkSession), *order).sortWithinPartitions(*order)
    schema = "edge boolean, h1 long, h2 long, first long, doc long, text_key long, line int"
    found = written(dealt.mapInArrow(run, schema), "later-lines")
    ends = found.filter("edge is null").groupBy("h1", "h2").agg(F.min("first").alias("_first"))
    place = ["doc", "text_key", "line"]
    sure = found.filter("edge = false").select(place)
    # At most one row per range.
    waiting = found.filter("edge").join(F.broadcast(ends), ["h1", "h2"], "left").filter("doc != least(first, _first)")
    return sure.union(waiting.select(place))


def keep_bitmaps(docs: DataFrame, least: int = 10) -> DataFrame:
    """``doc, text_key, n_dropped, keep``: a compressed bitmap of every document that loses lines.

    A line's key is the line without white space at its ends and with A-Z lower-cased. Keys of at least
    ``least`` code points that stand in several documents lose their lines in all but the one with the
    smallest doc_id. ``keep`` is a zlib-compressed bitmap (first line in the lowest bit, 0 for a dropped
    line) up to the last dropped line; lines beyond it stay, and so do all lines of documents without a row.

    A null doc_id counts as one id, before all others. Rows with one doc_id are one document: they lose no
    line to each other; their bitmaps are told apart by ``text_key``, so equal ones share theirs. Null and
    empty texts lose nothing. An empty table gives no rows; other columns are left out.

    Lines move as hashes, never as text: 36 bytes each, once to ranges of the hash, and what is dropped
    once more to its document.
    """
    import pyarrow as pa

    dropped = later_lines(written(line_hashes(docs, least), "line-hashes"))

    def bitmaps(doc, key, line):
        """Finished bitmaps of sorted rows."""
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
        starts = np.flatnonzero(new)
        counts, packed = [], []
        for a, b in zip(starts, np.append(starts[1:], len(doc))):
            bits = np.ones((line[b - 1] // 8 + 1) * 8, bool)  # whole bytes: what follows the last dropped line stays
            bits[line[a:b]] = False
            counts.append(len(bits) - int(bits.sum()))
            packed.append(zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 1))
        return pa.RecordBatch.from_arrays(
            [pa.array(doc[starts]), pa.array(key[starts]), pa.array(counts, pa.int32()), pa.array(packed, pa.binary())],
            names=["doc", "text_key", "n_dropped", "keep"],
        )

    def run(batches):
        rest = None
        for batch in batches:
            rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            rows = rows if rest is None else [np.concatenate(x) for x in zip(rest, rows)]
            if not len(rows[0]):
                continue
            # The last document may go on in the next batch.
            cut = int(np.flatnonzero((rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1]))[0])
            if cut:
                yield bitmaps(*(x[:cut] for x in rows))
            rest = [x[cut:] for x in rows]
        if rest is not None:
            yield bitmaps(*rest)

    # Rows with one id and text say the same; any number of them is one document here.
    grouped = dropped.distinct().repartition("doc", "text_key").sortWithinPartitions("doc", "text_key", "line")
    return grouped.mapInArrow(run, BITMAPS)


def unpack(keep: bytes | None, n: int) -> np.ndarray:
    """One boolean per line of a document with ``n`` lines."""
    bits = np.ones(n, bool)
    if keep is not None:
        some = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), bitorder="little")[:n]
        bits[: len(some)] = some
    return bits


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``doc_id, n_lines, n_dropped, text`` of every row: its lines that the bitmaps keep, joined by a line feed.

    A null text is one empty line. Texts move once, to their bitmaps.
    """
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            lines, dropped, texts = [], [], []
            for text, keep in zip(batch.column("text").to_pylist(), batch.column("keep").to_pylist()):
                parts = (text or "").split("\n")
                lines.append(len(parts))
                if keep is not None:
                    bits = unpack(keep, len(parts)).tolist()
                    parts = [x for x, k in zip(parts, bits) if k]
                dropped.append(lines[-1] - len(parts))
                texts.append("\n".join(parts))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(texts, pa.string())],
                names=["doc_id", "n_lines", "n_dropped", "text"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = small_batches(docs).select("doc_id", F.col("text").cast("string").alias("text"), *document(F.col("doc_id"), F.col("text")))
    joined = keyed.join(bitmaps.select("doc", "text_key", "keep"), ["doc", "text_key"], "left").select("doc_id", "text", "keep")
    return joined.mapInArrow(run, f"doc_id {kind}, n_lines long, n_dropped long, text string")


def without_repeated_lines(docs: DataFrame, least: int = 10) -> DataFrame:
    """``doc_id, n_lines, n_dropped, text``: see ``keep_bitmaps`` and ``apply_bitmaps``."""
    return apply_bitmaps(docs, written(keep_bitmaps(docs, least), "keep-bitmaps"))
