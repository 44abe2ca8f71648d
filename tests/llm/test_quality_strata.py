"""Cutoffs of the quality rules on planted strata."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievelight.llm import quality_rules

PLAIN = " ".join(f"word{i}" for i in range(30))
JUNK = " ".join(f"word{i}#*" for i in range(30))


def judged(spark, rows):
    """``rows`` are (lang, text, quality); the verdicts as (lang, quality, kept)."""
    numbered = [(i, *r) for i, r in enumerate(rows)]
    table = spark.createDataFrame(numbered, "doc_id long, lang string, text string, quality int")
    found = quality_rules.judge(table.select("doc_id", "lang", "text"), table.select("doc_id", "quality"))
    return [tuple(r) for r in found.join(table, "doc_id").select("lang", "quality", "kept").collect()]


def test_a_rule_rejects_planted_junk(spark):
    """217 good rows are what four strata need; 216 are too few."""
    rows = [(x, PLAIN, 1) for x in ("en", "de", None) for _ in range(217)] + [("es", PLAIN, 1)] * 216
    rows += [(x, JUNK, 0) for x in ("en", "de", "es", None) for _ in range(3)]
    for lang, quality, kept in judged(spark, rows):
        assert kept == (quality == 1 or lang == "es")


def test_the_joint_rejections_are_bounded(spark):
    """Each rule alone would lose few good rows, all of them together too many."""
    rows = [(0, 0, 0, 0)] * 970 + [(3000, 0, 0, 0)] * 10 + [(0, 1000, 0, 0)] * 10 + [(0, 0, 1000, 0)] * 10
    table = spark.createDataFrame([("en", 1, *r) for r in rows], "stratum string, quality int, " + ", ".join(f"{n} long" for n in quality_rules.RULES))
    got = quality_rules.choose_cutoffs(table).collect()
    assert [(r["symbols"], r["repeats"], r["lines"], r["capitals"]) for r in got] == [(2000, None, None, None)]
    milder = table.withColumn("repeats", F.lit(0)).withColumn("lines", F.lit(0))
    assert [r["symbols"] for r in quality_rules.choose_cutoffs(milder).collect()] == [20]


def test_small_strata_are_not_pooled(spark):
    """64 strata with more labels, and many small ones that are unlike the smallest."""
    rows = [(f"large{i}", PLAIN, 1) for i in range(64) for _ in range(42)]
    rows += [(f"small{i}", PLAIN, 1) for i in range(46) for _ in range(40)] + [("rare", JUNK, 1)] * 5
    assert all(kept for _, _, kept in judged(spark, rows))


def test_strata_too_small_to_pass_take_no_share(spark):
    rows = [("en", PLAIN, 1)] * 150 + [("en", JUNK, 0)] * 3 + [(f"small{i}", PLAIN, 1) for i in range(200)]
    assert all(kept == (quality == 1) for _, quality, kept in judged(spark, rows))


def test_rows_of_one_document_are_one_trial(spark):
    """300 rows and 300 labels of one document are one observation, whatever their texts are."""
    rows = [(1, "en", f"{PLAIN} {i}") for i in range(300)] + [(2, "en", JUNK)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(1, 1)] * 300 + [(2, 0)], "doc_id long, quality int")
    assert quality_rules.judge(docs, labels).filter("not kept").count() == 0
    features = quality_rules.features(docs).withColumns({n: F.expr(rule) for n, (rule, _) in quality_rules.RULES.items()})
    assert sorted((r["doc_id"], r["quality"]) for r in quality_rules.trials(features, labels).collect()) == [(1, 1), (2, 0)]


def test_a_document_fails_with_its_worst_row(spark):
    """200 documents of a plain row each, 5 of them with a junk row too: more than 2 % would lose text."""
    rows = [(i, "en", f"{PLAIN} {i}") for i in range(200)] + [(i, "en", JUNK) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(200)], "doc_id long, quality int")
    assert quality_rules.judge(docs, labels).filter("not kept").count() == 0
