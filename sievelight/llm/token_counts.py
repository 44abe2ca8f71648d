"""Token counts per document without keeping any ids."""

from __future__ import annotations

import hashlib

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievelight.llm.common import small_batches
from sievelight.llm.tokens import Stretches, WordModel, joined_lists, load_tokenizer, text_slices
from sievelight.session import written

_PIECES: dict[str, tuple[list[str], Stretches]] = {}
# Distinct pieces a worker numbers before it starts again.
PIECES_KEPT = 1_500_000


def _pieces(path: str) -> tuple[list[str], Stretches]:
    """The worker's pre-tokens as numbered strings, and the stretches that give their numbers."""
    if path not in _PIECES or len(_PIECES[path][0]) > PIECES_KEPT:
        tokenizer = load_tokenizer(path)
        added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        special = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")")
        names: list[str] = []
        numbers: dict[str, int] = {}

        def number(piece: str) -> int:
            if piece not in numbers:
                numbers[piece] = len(names)
                names.append(piece)
            return numbers[piece]

        def split(stretch: str) -> list[int]:
            base = stretch[:-1] if stretch[-1:] in (",", ".") else stretch
            if (base[1:] if base[:1] == " " else base).isalpha():
                return [number(base)] if base is stretch else [number(base), number(stretch[-1])]
            found = []
            for i, part in enumerate(special.split(stretch)):
                if i % 2:  # an added token
                    found.append(number(part))
                elif part:
                    cuts = tokenizer.pre_tokenizer.pre_tokenize_str(part)
                    found += [number(part[a:b]) for _, (a, b) in cuts]
            return found

        _PIECES[path] = names, Stretches(lambda new: joined_lists([split(s) for s in new]))
    return _PIECES[path]


def _frequencies(column, path: str):
    """Per slice of an Arrow column: ``(from, to, names, doc, piece, n)``, one entry per document and piece."""
    for i, j, data, bounds in text_slices(column):
        names, numbers = _pieces(path)
        flat, cuts = numbers.arrays(data, bounds)
        both = np.sort((np.repeat(np.arange(j - i, dtype=np.int64), np.diff(cuts)) << 32) | flat)
        first = np.flatnonzero(np.append(True, both[1:] != both[:-1])) if len(both) else np.zeros(0, np.int64)
        yield i, j, names, both[first] >> 32, both[first] & 0xFFFFFFFF, np.diff(np.append(first, len(both)))


def count_tokens(docs: DataFrame, tokenizer: str, common: int = 100_000, common_chars: int = 40) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of ``doc_id, text`` with a byte-level tokenizer.

    1. All distinct pre-tokens of the corpus, with their number of uses; each is encoded once.
    2. The ``common`` most used ones go to every task; those above ``common_chars`` characters go as
       their SHA-256 (this bounds what is sent). A document's frequencies of these are multiplied and
       summed in place.
    3. All other (document, pre-token, frequency) rows are joined to the table of 1 and summed.

    The first table has one row per distinct pre-token, and a pre-token that many documents hold is sent,
    however long it is, so none is a hot key of the join.
    Null texts count as empty: 0 bytes, 0 tokens. Rows with equal or null doc_ids stay apart.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    narrow = small_batches(docs).select("doc_id", F.col("text").cast("string").alias("text"))

    def distinct(batches):
        names: list[str] = []
        uses = np.zeros(0, np.int64)
        for batch in batches:
            for _, _, now, _, piece, n in _frequencies(batch.column(0), tokenizer):
                if now is not names:  # the worker's numbers start again
                    yield from _used(names, uses)
                    names, uses = now, np.zeros(0, np.int64)
                uses = np.concatenate((uses, np.zeros(len(names) - len(uses), np.int64)))
                uses += np.bincount(piece, n, len(names)).astype(np.int64)
        yield from _used(names, uses)

    def _used(names: list[str], uses: np.ndarray):
        for at in np.array_split(np.flatnonzero(uses), 1 + len(uses) // 100_000):
            yield pa.RecordBatch.from_arrays(
                [pa.array([names[p] for p in at.tolist()], pa.string()), pa.array(uses[at])], names=["piece", "uses"]
            )

    def encode(batches):
        library = WordModel(tokenizer)
        for batch in batches:
            pieces = batch.column("piece")
            _, sizes = library(pieces.to_pylist())
            yield pa.RecordBatch.from_arrays(
                [pieces, batch.column("uses"), pa.array(sizes)], names=["piece", "uses", "tokens"]
            )

    uses = narrow.select("text").mapInArrow(distinct, "piece string, uses long")
    uses = uses.groupBy("piece").agg(F.sum("uses").alias("uses"))
    pieces = written(uses.mapInArrow(encode, "piece string, uses long, tokens long"), "pre-tokens")
    # The least number of uses that at most ``common`` of them have: from one row per number of uses.
    most = W.partitionBy(F.lit(0)).orderBy(F.desc("uses"))
    steps = pieces.groupBy("uses").count().withColumn("_n", F.sum("count").over(most)).filter(F.col("_n") <= common)
    least = steps.agg(F.min("uses")).first()[0]
    top = pieces.filter(F.col("uses") >= (least or 0)) if least is not None else pieces.limit(0)
    # Long pieces under their digest: 32 bytes, which no piece is, as pieces are strings.
    long = F.length("piece") > common_chars
    top = top.select(F.when(~long, F.col("piece")).alias("piece"), F.when(long, F.unhex(F.sha2("piece", 256))).alias("digest"), "tokens")
    known = spark.sparkContext.broadcast({r.piece if r.digest is None else bytes(r.digest): r.tokens for r in top.collect()})

    def sent_as(piece: str):
        return piece if len(piece) <= common_chars else hashlib.sha256(piece.encode()).digest()

    def count(batches):
        names: list[str] = []
        sizes = np.zeros(0, np.int64)
        for batch in batches:
            for i, j, now, doc, piece, n in _frequencies(batch.column("text"), tokenizer):
                if now is not names:
                    names, sizes = now, np.zeros(0, np.int64)
                new = [known.value.get(sent_as(p), -1) for p in names[len(sizes) :]]
                sizes = np.concatenate((sizes, np.array(new, np.int64)))
                tokens = sizes[piece]
                rest = tokens < 0
                sums = np.bincount(doc, np.where(rest, 0, tokens * n), j - i).astype(np.int64)
                cuts = np.concatenate(([0], np.cumsum(np.bincount(doc[rest], minlength=j - i))))
                left = pa.StructArray.from_arrays(
                    [pa.array([names[p] for p in piece[rest].tolist()], pa.string()), pa.array(n[rest])],
                    names=["piece", "n"],
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c).slice(i, j - i) for c in ("row", "doc_id", "n_bytes")),
                        pa.array(sums),
                        pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), left),
                    ],
                    names=["row", "doc_id", "n_bytes", "counted", "rest"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = narrow.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        "text",
    )
    schema = f"row long, doc_id {kind}, n_bytes long, counted long, rest array<struct<piece:string,n:long>>"
    rows = written(keyed.mapInArrow(count, schema), "piece-counts")
    rare = rows.select("row", F.inline("rest")).join(pieces.select("piece", "tokens"), "piece")
    sums = rare.groupBy("row").agg(F.sum(F.col("n") * F.col("tokens")).alias("_rare"))
    return rows.drop("rest").join(sums, "row", "left").select(
        "doc_id", "n_bytes", (F.col("counted") + F.coalesce("_rare", F.lit(0))).alias("n_tokens")
    )
