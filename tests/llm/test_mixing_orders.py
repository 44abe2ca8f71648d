"""Permutations, drawn counts and per-source sums of the mix; long pre-tokens of the token counts."""

from __future__ import annotations

from collections import Counter, defaultdict

import public_tokenizers
from pyspark.sql import functions as F

from sievelight.llm import mixing, token_counts
from sievelight.llm.tokens import load_tokenizer


def test_permuted_is_a_bijection_of_its_own(spark):
    sizes = [1, 2, 3, 5, 16, 17, 63, 100, 101, 1000, 4097]
    rows = spark.createDataFrame([(n,) for n in sizes], "n long").withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    rows = rows.withColumn("epoch", F.explode(F.array(F.lit(0), F.lit(1))))
    got = rows.select("n", "epoch", "j", mixing.permuted(F.col("j"), F.col("n"), F.lit(0), F.lit(3), F.col("epoch")).alias("x")).collect()
    images = defaultdict(dict)
    for r in got:
        images[r["n"], r["epoch"]][r["j"]] = r["x"]
    for (n, _), found in images.items():
        assert sorted(found.values()) == list(range(n))
    first, second = images[1000, 0], images[1000, 1]
    # Neither the same order shifted nor steps of one length.
    assert len({(first[j] - second[j]) % 1000 for j in range(1000)}) > 300
    assert len({(first[j + 1] - first[j]) % 1000 for j in range(999)}) > 300


def test_draw(spark):
    """Per source: full passes take each block once, the target is met, and shards get even counts."""
    targets = spark.createDataFrame([(0, 80_005, 200_017.0), (1, 7, 21.0), (2, 800, 800.4), (3, 0, 0.0)], "sid int, source_size long, target double")
    rows = mixing.draw(targets, 8, 16, seed=1).collect()
    words, blocks, shards = Counter(), defaultdict(list), Counter()
    for r in rows:
        words[r["sid"]] += r["words"]
        blocks[r["sid"], r["epoch"]].append(r["index"])
        shards[r["sid"], r["shard"]] += 1
    assert words == {0: 200_017, 1: 21, 2: 800}
    assert sorted(blocks[0, 0]) == sorted(blocks[0, 1]) == list(range(10_001))
    assert len(set(blocks[0, 2])) == len(blocks[0, 2]) == 5001
    assert [sorted(blocks[1, e]) for e in range(3)] == [[0]] * 3 and sorted(blocks[2, 0]) == list(range(100))
    expected = 25_003 / 16
    assert all(abs(shards[0, s] - expected) < 6 * expected**0.5 for s in range(16))


def test_taken_by_source_and_hot_ids(spark):
    """Each source takes its target; rows of one doc_id, or of none, are placed by their texts."""
    rows = [(7 if i % 3 else None, " ".join(f"w{i}x{j}" for j in range(i % 40)), "ab"[i % 2]) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    placed, taken = mixing.mix(docs, block=8)
    by_source = taken.groupBy("sid").agg(F.sum(F.col("to") - F.col("from")).alias("n")).join(placed.select("row.sid", "target").distinct(), "sid")
    assert all(r["n"] == int(r["target"] + 0.5) for r in by_source.collect())
    assert placed.select("row.sid", "row._bucket").distinct().count() > 20
    per_row = taken.groupBy("row").agg(F.sum(F.col("to") - F.col("from")).alias("n")).join(placed, "row")
    assert per_row.filter("n > 3 * size").count() == 0


def test_long_common_pieces(spark):
    """Pieces above the length bound are counted alike, sent or joined."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["-" * 90 + " x", "-" * 90 + "\n" + "=" * 45, "ä" * 50, "word " + "-" * 90, None, ""] * 4
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    library = load_tokenizer(path)
    wanted = [(i, len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(texts)]
    for common in (1, 3, 100):
        got = token_counts.count_tokens(docs, path, common=common, common_chars=40)
        assert sorted((r["doc_id"], r["n_tokens"]) for r in got.collect()) == wanted
