from __future__ import annotations

from collections import Counter
from math import log, sqrt
import re

from pyspark.sql import functions as F

from sievelight.config import Config
from sievelight.functions import text as fn
from sievelight.operators import text_checks, tfidf

NBSP = chr(160)
EMOJI = chr(0x1F600)


def texts(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, text string")


def test_whitespace_is_that_of_python_strings(spark):
    spaces = [c for c in map(chr, range(0x3001)) if c.isspace()]
    values = [f"{c}a{c}{c}b{c}" for c in spaces] + ["".join(spaces), "", "a"]
    df = texts(spark, values).select(
        "text",
        fn.strip(F.col("text")).alias("strip"),
        fn.strip_and_collapse(F.col("text")).alias("both"),
    )
    for row in df.collect():
        assert row["strip"] == row["text"].strip()
        assert row["both"] == re.sub(r"\s+", " ", row["text"].strip())


def test_metrics_and_flags(spark):
    values = [None, "", "  ", "a b", f"{EMOJI}{EMOJI} ok then", "!!! ???", "x" * 10, "y" * 10000, "z" * 10001]
    rows = text_checks.validate_text_ml(texts(spark, values), "text", "id").orderBy("id").collect()
    assert [r["char_length"] for r in rows] == [0, 0, 0, 3, 10, 7, 10, 10000, 10001]
    assert [r["word_count"] for r in rows] == [0, 0, 0, 2, 3, 2, 1, 1, 1]
    assert [r["text_is_null"] for r in rows] == [True] + [False] * 8
    assert [r["text_is_empty"] for r in rows] == [True] * 3 + [False] * 6
    assert [r["has_special_only"] for r in rows] == [False] * 5 + [True] + [False] * 3
    assert [r["text_valid"] for r in rows] == [False] * 4 + [True, False, True, True, False]
    assert [r["text_is_duplicate"] for r in rows] == [False, True, True] + [False] * 6


def test_absent_text_column_leaves_frame_unchanged(spark):
    df = texts(spark, ["a"])
    assert text_checks.validate_text_ml(df, "absent", "id").columns == df.columns


def test_basic_keeps_inner_whitespace_and_flags_all_members(spark):
    values = ["a  b and more", "a b and more", " a b and more ", "solo text here"]
    rows = text_checks.validate_text_basic(texts(spark, values), "text", "id").orderBy("id").collect()
    assert [r["is_duplicate"] for r in rows] == [False, True, True, False]
    assert [r["word_count"] for r in rows] == [4, 4, 4, 3]
    assert rows[0]["text_clean"] == "a  b and more"


def test_copies_with_a_two_part_key(spark):
    df = spark.createDataFrame(
        [("csv", 1, "t"), ("excel", 1, "t"), ("csv", 2, "t"), ("excel", 2, "u")],
        "_source string, id long, text string",
    )
    rows = text_checks.mark_copies(df, "text", ("_source", "id"), first="first", any_="any").collect()
    got = {(r["_source"], r["id"]): (r["first"], r["any"]) for r in rows}
    assert got == {
        ("csv", 1): (False, True), ("csv", 2): (True, True),
        ("excel", 1): (True, True), ("excel", 2): (False, False),
    }


def test_a_hot_group_is_counted_not_gathered(spark):
    """A third of the rows share a text; the plan has no window and joins by the unique row key."""
    df = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, F.lit("same")).otherwise(F.col("id").cast("string")).alias("text")
    )
    marked = text_checks.mark_copies(df, "text", "id", first="copy")
    assert marked.where("copy").count() == 999
    plan = marked._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "partial_count" in plan


def test_tfidf_against_plain_python(spark):
    docs = ["The cat sat. the CAT", "a cat sat on mats", "mats sat", "", "x y", "naïve Ünïcode naïve cat"]
    cfg = Config(tfidf_max_features=8)
    counts = []
    for doc in docs:
        words = re.findall(r"\w\w+", doc.lower())
        counts.append(Counter(words + [" ".join(p) for p in zip(words, words[1:])]))
    df = Counter(t for c in counts for t in c)
    tf = sum(counts, Counter())
    kept = sorted((t for t in tf if df[t] >= 2), key=lambda t: (-tf[t], t))[: cfg.tfidf_max_features]
    idf = {t: log((1 + len(docs)) / (1 + df[t])) + 1 for t in kept}
    wanted = {}
    for i, c in enumerate(counts):
        weights = {t: c[t] * idf[t] for t in kept if c[t]}
        length = sqrt(sum(w * w for w in weights.values()))
        wanted.update({(i, t): w / length for t, w in weights.items()})
    got = tfidf.tfidf_matrix(texts(spark, docs), "text", "id", cfg.tfidf_max_features, 2).collect()
    assert {(r["id"], r["term"]) for r in got} == set(wanted)
    assert all(abs(r["tfidf"] - wanted[r["id"], r["term"]]) < 1e-12 for r in got)
    order = {t: i for i, t in enumerate(sorted(kept))}
    assert all(r["term_index"] == order[r["term"]] for r in got)


def test_term_counting_stays_on_the_document_partitioning(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    vocab = spark.createDataFrame([("the", 0, 1.0)], "term string, term_index int, idf double")
    matrix = tfidf.tfidf_matrix(df, "text", "doc_id", vocab=vocab)
    plan = matrix._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
