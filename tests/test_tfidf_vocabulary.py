"""The vocabulary at size: exact whatever the buckets hold, rare terms stay where they lie, tasks follow the text."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sievelight.operators import tfidf


def frame(spark, docs):
    return spark.createDataFrame(docs, "id long, text string")


def by_hand(docs, max_features, min_df=2):
    """Rows of one key, null too, are one document."""
    tf, seen = Counter(), {}
    for key, text in docs:
        words = re.findall(r"\w\w+", (text or "").lower())
        for t in words + [" ".join(p) for p in zip(words, words[1:])]:
            tf[t] += 1
            seen.setdefault(t, set()).add(key)
    kept = sorted((t for t in tf if len(seen[t]) >= min_df), key=lambda t: (-tf[t], t))[:max_features]
    return {(t, len(seen[t]), tf[t]) for t in kept}


ZIPF = [(i, " ".join(f"w{j}" for j in range(1, 200) if i % j == 0) + f" only{i}") for i in range(1, 120)]
FLAT = [(i, f"aa{i % 30} zz{i % 30}") for i in range(60)]
ONCE = [(i, f"many{i} " * 9) for i in range(50)] + [(50, "few good"), (51, "few good")]
REPEATED = [(i // 3 or None, t) for i, t in ZIPF] + [(1, None), (None, "w1 w2 only1")]


@pytest.mark.parametrize("docs", [ZIPF, FLAT, ONCE, REPEATED, [], [(1, None), (2, "")]])
@pytest.mark.parametrize("buckets", [64, 4096])
@pytest.mark.parametrize("max_features", [3, 12])
def test_vocabulary_is_exact_for_any_buckets(spark, monkeypatch, docs, buckets, max_features):
    monkeypatch.setattr(tfidf, "BUCKETS", buckets)
    got = tfidf.tfidf_vocab(frame(spark, docs), "text", "id", max_features).collect()
    assert {(r["term"], r["df"], r["tf"]) for r in got} == by_hand(docs, max_features)


def test_rare_terms_are_not_counted_one_by_one(spark, monkeypatch):
    """Of 40 000 words found twice and 5 found often, few reach the counting by document."""
    reached = []
    counted = tfidf._most_frequent

    def watched(terms, key, max_features, min_df, buckets=None):
        reached.append(None if buckets is None else buckets.count())
        return counted(terms, key, max_features, min_df, buckets)

    monkeypatch.setattr(tfidf, "_most_frequent", watched)
    n = F.col("id") % 20000
    text = F.concat_ws(" ", F.concat(F.lit("often"), F.col("id") % 5), F.concat(F.lit("rare"), n), F.concat(F.lit("seldom"), n))
    got = tfidf.tfidf_vocab(spark.range(40000).select("id", text.alias("text")), "text", "id", 5).collect()
    assert {(r["term"], r["tf"]) for r in got} == {(f"often{i}", 8000) for i in range(5)}
    assert len(reached) == 1 and reached[0] <= tfidf.BUCKETS_PER_FEATURE * 5


def test_tasks_that_count_follow_the_text(spark):
    """One task counts about as many terms in a large table as in a small one."""
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(4000)), lambda i: F.concat(F.lit("word"), i)), " ")
    docs = spark.range(2000).select("id", text.alias("text"))
    parts = tfidf.document_terms(docs, "text", "id").select(F.spark_partition_id().alias("p")).distinct().count()
    assert parts >= 14  # 16 000 000 occurrences
