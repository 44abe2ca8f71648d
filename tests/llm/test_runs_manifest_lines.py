"""Periodic runs, Merkle manifest and line dedup against brute-force versions."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievelight.llm import check_sql, line_dedup, merkle, periodic_runs
from sievelight.llm.queries import op11_periodic_runs, op12_merkle_manifest, op13_line_dedup
from tests import compare

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, size long, at long, tree string, doc long, text_key string, keep string, digest string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TEXTS = [
    None, "", " ", "\n", "\n\n", "a\nb", "A shared line of text\nown one\nA shared line of text", "  a SHARED line of text \nlast", "x\r\ny\r",
    "A shared line of text", "ÄÖÜ ist ÄHNLICH\näöü ist ähnlich", "äöü ist ähnlich", "äöü ähnli", "ÄÖÜ ÄHNLI", "123456789", "1234567890", "1234567890\n\n1234567890",
    "go " * 40, "a b c " * 9, "a b c " * 9 + "a b " * 8, "x a a a a a a a a a a a a y", "\x0b \x0c", " trailing\n", "a　b " * 20,
]


@pytest.fixture(scope="module")
def awkward(spark):
    clash = (7, 7, "c", 7, "c", "c", "c")
    rows = [(i, t, ["en", None, "", "fr"][i % 4], [None, "", "s"][i % 3], [None, i][i % 2], *clash) for i, t in enumerate(TEXTS)]
    rows += [(None, "A shared line of text\nnull id", None, None, None, *clash), (None, "null id again", "de", None, 1, *clash)]
    rows += [(7, "A shared line of text\nother text of one id", "en", "s", 1, *clash)] + [(9, TEXTS[9], "fr", "", 1, *clash)] * 3
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(params=["real", "awkward", "empty"])
def docs(request, spark, awkward):
    return {"real": spark.read.parquet(f"{SF}/documents.parquet"), "awkward": awkward, "empty": awkward.limit(0)}[request.param]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def all_runs(w, least=12):
    out = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j - i + q
            if j > i and n >= max(least, 2 * q) and not any(w[i : i + n - d] == w[i + d : i + n] for d in range(1, q)):
                out.append((i, n, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def tailed(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def test_periodic_runs(docs):
    got = periodic_runs.digests(periodic_runs.find_runs(periodic_runs.with_periodic_tails(docs))).collect()
    want = []
    for r in docs.collect():
        w = tailed(r["doc_id"], WORD.findall(r["text"] or ""))
        runs = all_runs(w)
        dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
        s, n, q = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        best = (s, n, q, 1000 * n // q) if runs else (None,) * 4
        lines = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
        want.append((r["doc_id"], len(runs), *best, sha(lines), sha(" ".join(x for i, x in enumerate(w) if i not in dropped))))
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got)


def test_runs_of_short_alphabets():
    rng = random.Random(3)
    for _ in range(1500):
        n, k, least = rng.randint(0, 60), rng.choice([1, 2, 2, 3, 5]), rng.choice([2, 3, 7, 12])
        w = [rng.randrange(k) for _ in range(n)]
        if n and rng.random() < 0.5:
            a, p = rng.randrange(n), rng.randint(1, max(1, n // 3))
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        assert [tuple(r) for r in periodic_runs.find(np.array(w, np.int32), least).tolist()] == all_runs(w, least)


def test_runs_of_very_long_texts(spark):
    """Half a million equal words, a long period, and words that never repeat; slices of the text do not show."""
    n = 500_000
    rows = [(1, "Wort " * n), (2, " ".join(str(i % 1000) for i in range(n))), (3, " ".join(map(str, range(n))))]
    found = {r["doc_id"]: r for r in periodic_runs.find_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [tuple(x) for x in found[1]["runs"]] == [(0, n, 1)] and found[1]["collapsed"] == "Wort"
    assert [tuple(x) for x in found[2]["runs"]] == [(0, n, 1000)] and len(found[2]["collapsed"].split()) == 1000
    assert found[3]["runs"] == [] and found[3]["collapsed"] == rows[2][1]


def merkle_rows(rows, claim):
    """(doc_id, leaf, subroot, root, proof, folded root) of each row."""

    def leaf(r, text):
        values = [r["doc_id"], r["source"], r["lang"], r["n_chars"], text]
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    def levels(nodes):
        out = []
        while len(nodes) > 1:
            out.append(nodes)
            nodes = [sha("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]
        return out, nodes[0]

    def siblings(out, i):
        for nodes in out:
            g = i // 8 * 8
            yield "".join(nodes[g:i]), "".join(nodes[i + 1 : g + 8])
            i //= 8

    trees = collections.defaultdict(list)
    for r in rows:
        trees[r["lang"]].append((r["doc_id"], leaf(r, r["text"]), leaf(r, claim(r))))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    for k in langs:
        trees[k].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
    inside = {k: levels([x[1] for x in trees[k]]) for k in langs}
    if not langs:
        return []
    top, root = levels([inside[k][1] for k in langs])
    found = []
    for place, k in enumerate(langs):
        for i, (doc_id, digest, folded) in enumerate(trees[k]):
            path = [*siblings(inside[k][0], i), *siblings(top, place)]
            for left, right in path:
                folded = sha(left + folded + right)
            found.append((doc_id, digest, inside[k][1], root, "".join(a + b for a, b in path), folded))
    return found


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_manifest(docs, depth):
    def claim(r):
        return r["text"].translate(LOWER) if r["text"] is not None and (r["doc_id"] or 0) % 2 else r["text"]

    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    claimed = {"text": F.when(F.col("doc_id") % 2 != 0, lower).otherwise(F.col("text"))}
    got = merkle.manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], "lang", "doc_id", claimed, depth).collect()
    want = merkle_rows(docs.collect(), claim)
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got)


def test_manifest_of_many_trees(spark):
    """More trees than one superblock of the top tree, most of one leaf, one with a third of all rows."""
    rows = [(i, "x", "hot" if i % 3 == 0 else f"l{i}", None, i) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = merkle.manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], "lang", "doc_id", {}, depth=1).collect()
    assert sorted(map(repr, merkle_rows(docs.collect(), lambda r: r["text"]))) == sorted(repr(tuple(r)) for r in got)
    assert all(r["folded_root"] == r["root"] for r in got)


def deduplicated(rows, least=10):
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)

    holders = collections.defaultdict(set)
    for doc_id, text in rows:
        for line in text.split("\n"):
            holders[key(line)].add(-1 if doc_id is None else doc_id)
    out = []
    for doc_id, text in rows:
        lines = text.split("\n")
        own = -1 if doc_id is None else doc_id
        stay = [x for x in lines if len(key(x)) < least or own == min(holders[key(x)])]
        out.append((doc_id, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(map(repr, out))


def test_line_dedup(docs):
    got = line_dedup.without_repeated_lines(docs).collect()
    assert sorted(repr(tuple(r)) for r in got) == deduplicated([(r["doc_id"], r["text"] or "") for r in docs.collect()])


def test_line_dedup_over_ranges(spark):
    """One line in all documents fills several ranges; another stands many times in one long text."""
    rows = [(i, f"the very common line\nown line number {i}\nThe Very Common Line") for i in range(3000)]
    rows += [(5000, "the very common line\n" * 30_000 + "and the end of it"), (5001, "and the end of it\nx" * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    ranges = line_dedup.line_hashes(docs)
    hashes = {(r["h1"], r["h2"]) for r in ranges.filter("line = 0 and doc < 3000").collect()}
    assert len(hashes) == 1
    got = line_dedup.without_repeated_lines(docs).collect()
    assert sorted(repr(tuple(r)) for r in got) == deduplicated(rows)


def test_bitmaps(spark):
    docs = spark.createDataFrame([(1, "a line of some length\n" * 9), (2, "b\nA line of some length\nc" + "\nd" * 20), (3, "alone")], "doc_id long, text string")
    (row,) = line_dedup.keep_bitmaps(docs).collect()
    assert (row["doc"], row["n_dropped"]) == (2, 1)
    assert line_dedup.unpack(row["keep"], 23).tolist() == [True, False] + [True] * 21


@pytest.mark.parametrize("query", [op11_periodic_runs, op12_merkle_manifest, op13_line_dedup])
def test_against_sql(spark, query, monkeypatch):
    sql = {op11_periodic_runs: check_sql.PERIODIC_RUNS, op12_merkle_manifest: check_sql.merkle(), op13_line_dedup: check_sql.LINE_DEDUP}[query]
    monkeypatch.setattr(compare, "QUERIES", {"q": query})
    monkeypatch.setattr(compare, "ORACLES", {"q": sql})
    assert compare.differences(spark, SF, "q") == []
