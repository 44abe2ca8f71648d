"""Rejection by the language model."""

from __future__ import annotations

import numpy as np

from sievelight.llm import language


def test_two_languages_reject_foreign_and_random_text(spark):
    rng = np.random.default_rng(0)
    words = {"xx": ["lorem", "dolor", "amet", "sit", "magna", "urna"], "yy": ["kuka", "hyvin", "tyttö", "yksi", "jää", "pöly"]}
    rows = [(i, " ".join(rng.choice(words[x], 30)), x) for i, x in enumerate(["xx", "yy"] * 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs)
    assert model.least > 0.5
    found = language.predict(docs, model).collect()
    assert np.mean([r["accepted"] for r in found]) >= 0.98
    other = [(0, "這是一段完全不同的文字而且很長"), (1, "".join(chr(c) for c in rng.integers(0x4E00, 0x9FFF, 200))), (2, "qzx vwk bfg jcp"), (3, "Привет как дела")]
    foreign = spark.createDataFrame(other, "doc_id long, text string")
    assert not any(r["accepted"] for r in language.predict(foreign, model).collect())
