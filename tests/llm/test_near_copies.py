"""Stage near_copies of the pipeline on repeated ids."""

from __future__ import annotations

import corpus_pipeline

WORDS = [" ".join(f"{name}{i}" for i in range(40)) for name in "abcdefg"]


def kept(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(map(tuple, corpus_pipeline.one_of_each(spark, docs, "").collect()), key=repr)


def test_different_texts_of_one_id_stay(spark):
    """Also if one of them is a near copy of a smaller id, and whatever the order of the rows."""
    rows = [(5, WORDS[0]), (5, WORDS[1]), (5, WORDS[2]), (2, WORDS[0] + " end"), (7, WORDS[3]), (7, WORDS[3]), (8, WORDS[3])]
    want = [(2, WORDS[0] + " end"), (5, WORDS[1]), (5, WORDS[2]), (7, WORDS[3])]
    assert kept(spark, rows) == want
    assert kept(spark, rows[::-1]) == want


def test_copies_with_a_null_id_go(spark):
    rows = [(None, WORDS[0]), (3, WORDS[0] + " end"), (None, WORDS[1]), (None, WORDS[1]), (None, WORDS[1] + " end"), (None, WORDS[2])]
    got = kept(spark, rows)
    assert (3, WORDS[0] + " end") in got and (None, WORDS[2]) in got
    assert len(got) == 3 and sum(text in (WORDS[1], WORDS[1] + " end") for _, text in got) == 1
