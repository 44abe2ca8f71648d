"""Identifiers that no base pattern matches, found by context; long texts with many matches."""

from __future__ import annotations

import random
import time

from pyspark.sql import functions as F

from sievelight.llm import pii
from tests.llm.test_operators import base_spans, redacted


def spans_of(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r[0]: r[1] for r in pii.find(docs).select("doc_id", pii.spans_text(F.col("spans"))).collect()}


def test_planted_identifiers(spark):
    """Phones without a plus after the seeds' two words are found, plain numbers are left alone.

    Mails with (at) are not found: the word before their label is random, and no seed has their shape.
    """
    pick = random.Random(5)
    plain = [f"w{chr(97 + i)}r{chr(97 + j)}" for i in range(20) for j in range(20)]

    def text(*planted):
        return " ".join((*pick.choices(plain, k=9), *planted, *pick.choices(plain, k=9)))

    texts, wanted = [], {}
    for i in range(60):
        texts.append(text("please call", f"+1 (555) 555-{1000 + i}"))
        texts.append(text("Mailbox:", f"user{i}@site{i}.example.com"))
        texts.append(text("of the", f"10.0.{i}.7"))
    for i in range(60):
        texts.append(text("of the", f"{200000 + 37 * i}"))
        texts.append(text("in room", f"{100000 + 41 * i}"))
    for i in range(10):
        for words, core, kind in (("please call", f"555-010-{2000 + i}", "phone"), ("mailbox:", f"person{i}(at)site", None)):
            texts.append(text(words, core))
            if kind:
                start = texts[-1].index(core)
                wanted[len(texts) - 1] = f"{kind}:{start}:{start + len(core)}"
    found = spans_of(spark, texts)
    more = {i: s for i, s in found.items() if s != base_spans(texts[i])}
    right = sum(more.get(i) == s for i, s in wanted.items())
    assert right == len(wanted) == 10
    assert set(more) == set(wanted)


def test_function_words_are_no_patterns(spark):
    """Every known identifier follows 'of', as many plain numbers do."""
    texts = [f"w{i} of user{i}@site.example.com" for i in range(40)] + [f"w{i} of {70000 + i}" for i in range(40)]
    assert all(s == base_spans(texts[i]) for i, s in spans_of(spark, texts).items())


def test_running_and_overlaps(spark):
    pick = random.Random(3)
    for n in (0, 1, 2, 63, 64, 65, 300):
        spans = [(s, s + pick.randint(1, 9), pick.randint(0, 3)) for s in (pick.randint(0, 900) for _ in range(n))]
        asked = [(s, s + pick.randint(1, 5)) for s in (pick.randint(0, 900) for _ in range(60))]
        row = spark.createDataFrame([(spans, asked)], "b array<struct<start:int,end:int,kind:int>>, q array<struct<start:int,end:int>>")
        hit = F.transform("q", lambda x: pii._overlapped(pii._ordered(F.col("b")), x["start"], x["end"]).isNotNull())
        assert row.select(hit).first()[0] == [any(s < e2 and s2 < e for s, e, _ in spans) for s2, e2 in asked]
        sums = row.select(pii.running(F.transform("b", lambda x: x["start"]), "int", lambda x, y: x + y)).first()[0]
        assert sums == [sum(s for s, _, _ in spans[: i + 1]) for i in range(n)]


def test_very_long_texts(spark):
    """100 000 words with digits, a tenth of them identifiers, some over the seams of the cut."""
    words = [f"w{i}" if i % 10 else f"ü{i % 5}.\U0001f600 user{i}@site.example.com" for i in range(100_000)]
    text = " ".join(words)
    docs = spark.createDataFrame([(1, text), (2, text[:3000] + " +1 555 555 5555"), (3, "no digits here " * 50_000)], "doc_id long, text string")
    begin = time.perf_counter()
    got = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert time.perf_counter() - begin < 120
    assert got == {1: redacted(text), 2: redacted(text[:3000] + " +1 555 555 5555"), 3: "no digits here " * 50_000}
