"""Every dealt operator against a brute-force version, on the smallest tables and on awkward rows."""

from __future__ import annotations

import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sievelight.llm import language, mixing, ngram_join, packing, permutation_index, pii, quality_rules, sharding
from sievelight.llm import token_counts, token_files
from sievelight.llm.tokens import load_tokenizer

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, row string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
AWKWARD = [
    "", None, " ", "  ", "a  b", "a   b", "a\n b", "x \n\n y", "<|endoftext|> a <|endoftext|>", "\t\ttab　wide", "word, word.\nNext. é,\nü.",
    "İstanbul ΑΣ ΑΣ'S don't", "日本語 テキスト", "a b c d e", "A B c D e", "1 2 3 4 5 6 7 8 9 " * 300, "word " * 400, "longword" * 400,
    "mail me at x.y@z.example.org, or +1 (555) 555-1234; 999.1.1.1 10.0.0.1 4111 1111 1111 1111", "x@y@z.com a%b@c.d.e%f@g.h",
]


def path(name):
    return public_tokenizers.path(name)


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(i, t, ["en", None, "fr"][i % 3], [None, "", "s"][i % 3], None, "clash", "clash") for i, t in enumerate(AWKWARD)]
    rows += [(None, "null id text", None, None, 1, None, None), (3, "a  b", "en", "s", 1, "x", "y"), (3, "a  b", "en", "s", 1, "x", "y")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(params=["real", "awkward", "empty"])
def docs(request, real, awkward):
    return {"real": real, "awkward": awkward, "empty": awkward.limit(0)}[request.param]


def texts(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]


def encoded(docs, name, end):
    tokenizer = load_tokenizer(path(name))
    return [(i, [*tokenizer.encode(t, add_special_tokens=False).ids, *end]) for i, t in texts(docs)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files(docs):
    got = [tuple(r) for r in token_files.round_trip(docs, path("byte_bpe_50k.json"), 2).collect()]
    want = encoded(docs, "byte_bpe_50k.json", [2])
    assert sorted((repr(i), n, c) for i, _, n, c in got) == sorted((repr(i), len(x), crc(x)) for i, x in want)
    at = 0
    for doc_id, start, n, _ in sorted(got, key=lambda r: r[1]):
        assert start == at
        at += n
    ids = [r[0] for r in sorted(got, key=lambda r: r[1]) if r[0] is not None]
    assert ids == sorted(ids)


def test_token_file_format(spark, real, tmp_path):
    import pyarrow.parquet as pq

    out = f"file://{tmp_path}/tokens"
    token_files.write_token_table(real, out, path("byte_bpe_50k.json"), 2, parts=2, page_rows=20)
    meta = pq.read_metadata(sorted((tmp_path / "tokens").glob("part-*"))[0])
    columns = {meta.row_group(0).column(i).path_in_schema: meta.row_group(0).column(i) for i in range(meta.num_columns)}
    assert columns["doc_id"].has_column_index and columns["doc_id"].has_offset_index
    assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
    assert any("DICTIONARY" in e for e in columns["ids.list.element"].encodings)
    some = token_files.read_tokens(spark, out, F.col("doc_id").between(10, 19))
    assert some.count() == 10
    assert {r["doc_id"]: r["start"] for r in some.collect()}.items() <= {
        r["doc_id"]: r["start"] for r in token_files.read_metadata(spark, out).collect()
    }.items()


@pytest.mark.parametrize("length", [4096, 64])
def test_packing(docs, length):
    pieces = packing.pack(docs, path("word_bpe_49k.json"), 2, length).collect()
    by_sequence = collections.defaultdict(list)
    for p in pieces:
        assert len(p["ids"]) == p["length"] > 0
        by_sequence[p["sequence_id"]].append(p)
    sums = []
    for k in sorted(by_sequence):
        at = 0
        for p in sorted(by_sequence[k], key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        sums.append(at)
    assert all(s == length for s in sums[:-1])
    stream = [i for k in sorted(by_sequence) for p in sorted(by_sequence[k], key=lambda p: p["offset"]) for i in p["ids"]]
    want = encoded(docs, "word_bpe_49k.json", [2])
    assert collections.Counter(stream) == collections.Counter(i for _, x in want for i in x)
    for p in pieces:
        own = slice(p["start"], p["start"] + p["length"])
        assert any(x[own] == p["ids"] and len(x) == p["doc_tokens"] for i, x in want if i == p["doc_id"])
    digests = packing.pack(docs, path("word_bpe_49k.json"), 2, length, digests=True).collect()
    assert collections.Counter((r["doc_id"], r["start"], r["ids_crc32"]) for r in digests) == collections.Counter(
        (p["doc_id"], p["start"], crc(p["ids"])) for p in pieces
    )


def test_token_counts(docs):
    got = token_counts.count_tokens(docs, path("byte_bpe_50k.json"), common=50).collect()
    want = [(repr(i), len(t.encode()), len(x)) for (i, t), (_, x) in zip(texts(docs), encoded(docs, "byte_bpe_50k.json", []))]
    assert sorted((repr(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in got) == sorted(want)


def test_language(spark, awkward):
    more = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(more)
    found = language.predict(more, model).collect()
    held = [r for r in found if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) >= 0.95
    odd = language.predict(awkward, model).collect()
    for r in odd:
        if not re.search(r"[^\W\d_]", r["text"] or ""):
            assert (r["lang_pred"], r["score"], r["accepted"]) == ("und", 0.0, False)
    none = language.predict(awkward, language.fit(awkward.limit(0)))
    assert {r["lang_pred"] for r in none.collect()} == {"und"}


def sizes(rows):
    return [len(WORD.findall(t or "")) for t in rows]


def test_mixing(docs):
    source = [(r["source"], len(WORD.findall(r["text"] or ""))) for r in docs.collect()]
    names = sorted({s for s, _ in source if s is not None}) + [None] * any(s is None for s, _ in source)
    total = {n: sum(k for s, k in source if s == n) for n in names}
    weight = {n: i % 3 + 1 for i, n in enumerate(names)}
    target, open_ = {}, list(names)
    while open_:
        left = sum(total.values()) - sum(target.values())
        level = left / sum(weight[n] for n in open_)
        over = [n for n in open_ if level * weight[n] > 3 * total[n]]
        target.update({n: 3 * total[n] for n in over} if over else {n: level * weight[n] for n in open_})
        open_ = [n for n in open_ if n not in target]
    got = mixing.taken_words(docs.withColumn("key", F.lit(1)), block=8).collect()
    again = mixing.taken_words(docs.repartition(3), block=8).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    assert sorted(r["size"] for r in got) == sorted(k for _, k in source)
    wanted = sorted(round(target[s], 6) for s, _ in source)
    assert np.allclose(sorted(r["target"] for r in got), wanted)
    assert sum(r["taken"] for r in got) == sum(int(x + 0.5) for x in target.values())
    assert all(r["taken"] <= 3 * r["size"] for r in got)


def sets(rows):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = []
    for t in rows:
        w = WORD.findall((t or "").translate(fold))
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def components(rows):
    ids, found = [i for i, _ in rows], sets([t for _, t in rows])
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(found):
        for j in range(i):
            both = len(a & found[j])
            if a and both and 100 * both >= 80 * len(a | found[j]):
                parent[top(i)] = top(j)
    names = collections.defaultdict(list)
    for i in range(len(rows)):
        names[top(i)].append(ids[i])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in names.items()}
    return sorted((repr(ids[i]), len(found[i]), repr(least[top(i)])) for i in range(len(rows)))


def test_ngram_join(docs):
    got = ngram_join.join_components(docs).collect()
    assert sorted((repr(r[0]), r[1], repr(r[2])) for r in got) == components(texts(docs))


def test_ngram_join_near_the_limit(spark):
    """Chains of small changes at many sizes: links just above and below 0.8."""
    rng, rows = np.random.default_rng(5), []
    for size in (4, 5, 6, 7, 9, 12, 20, 33, 60, 120, 300):
        base = [f"w{rng.integers(10**6)}" for _ in range(size)]
        rows.append(" ".join(base))
        for cut in range(1, 12):
            changed = list(base)
            for _ in range(1 + cut * size // 150):
                changed[rng.integers(size)] = f"v{rng.integers(10**6)}"
            rows.append(" ".join(changed))
            rows.append(" ".join(base[: max(1, size - cut)]))
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = ngram_join.join_components(docs).collect()
    assert sorted((repr(r[0]), r[1], repr(r[2])) for r in got) == components(list(enumerate(rows)))


def test_quality_counts(docs, spark):
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, None)], "doc_id long, quality int")
    got = quality_rules.judge(docs, labels).collect()

    def base(text):
        words = WORD.findall(text)
        seen = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        twice = {j for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        symbols = sum(c in "#*$%&|<>" for c in text)
        return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(twice)

    want = sorted((repr(i), *base(t)) for i, t in texts(docs))
    assert sorted((repr(r["doc_id"]), *(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))) for r in got) == want
    assert all(r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) for r in got)
    assert not any(r["kept"] and r["base_failed"] for r in got)


def test_binomial_tail(spark):
    from math import comb, log

    rows = spark.createDataFrame([(0, 500), (3, 2000), (12, 3000)], "k long, n long")
    got = rows.select("k", "n", quality_rules.log_binomial_tail(F.col("k"), F.col("n"), 0.005).alias("t")).collect()
    for r in got:
        exact = sum(comb(r["n"], i) * 0.005**i * 0.995 ** (r["n"] - i) for i in range(r["k"] + 1))
        assert abs(r["t"] - log(exact)) < 1e-9


def base_spans(text):
    def luhn(digits):
        twice = [int(c) * (i % 2 + 1) for i, c in enumerate(reversed(digits))]
        return sum(x - 9 if x > 9 else x for x in twice) % 10 == 0

    def digits(m):
        return re.sub("[^0-9]", "", m)

    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    )
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p, ok in kinds for m in re.finditer(p, text) if ok(m.group()))


def redacted(text):
    spans = [(int(a), int(b), k) for k, a, b in (x.split(":") for x in base_spans(text).split(",") if x)]
    out, at = "", 0
    for start, end, kind in sorted(spans):
        if start >= at:
            out += text[at:start] + f"[{kind.upper()}]"
        at = max(at, end)
    return out + text[at:]


def test_personal_data(docs):
    got = pii.find(docs).select("doc_id", pii.spans_text(F.col("base")).alias("base")).collect()
    assert sorted((repr(r[0]), r[1]) for r in got) == sorted((repr(i), base_spans(t)) for i, t in texts(docs))


def test_personal_data_by_context(spark):
    rows = [f"please reach me mailbox: user{i}@site{i}.example.com today" for i in range(9)]
    rows += ["please reach me mailbox: user77(at)site today", "room 12345 is free"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = {r["doc_id"]: r["t"] for r in pii.find(docs).select("doc_id", pii.spans_text(F.col("spans")).alias("t")).collect()}
    assert found[9] == "email:25:39" and found[10] == ""
    text = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert text[0] == "please reach me mailbox: [EMAIL] today" and text[9] == text[0] and text[10] == rows[10]


def test_sharding(docs):
    got = sorted(sharding.shard_by_bytes(docs).collect(), key=lambda r: (r["shard"], r["slot"]))
    assert sorted((repr(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == sorted(
        (repr(i), len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in texts(docs)
    )
    ids = [r["doc_id"] for r in got if r["doc_id"] is not None]
    assert ids == sorted(ids)
    total, largest = sum(r["size"] for r in got), max((r["size"] for r in got), default=0)
    for shard in {r["shard"] for r in got}:
        rows = [r for r in got if r["shard"] == shard]
        assert [r["slot"] for r in rows] == list(range(len(rows)))
        assert sum(r["size"] for r in rows) <= total / 16 + largest


def test_permutation_index(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = permutation_index.search(permutation_index.usable(rows), F.col("id") % 20 == 0, least=100).collect()
    data = {r["vec_id"]: np.array(r["embedding"], float) for r in rows.collect()}
    hits = 0
    queries = [q for q in data if q % 20 == 0]
    for q in queries:
        best = sorted((-float(data[q] @ v), i) for i, v in data.items() if i != q)[:20]
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [m[0] for m in mine] == list(range(1, 21))
        assert all(abs(m[2] - data[q] @ data[m[1]]) < 1e-9 for m in mine)
        hits += len({i for _, i in best} & {m[1] for m in mine})
    assert hits >= 0.9 * 20 * len(queries)


def test_permutation_index_awkward(spark):
    bad = [(100, None), (101, [0.0, 0.0]), (102, [None, 1.0]), (103, [float("nan"), 1.0]), (104, [float("inf"), 1.0]), (105, []), (None, [1.0, 1.0])]
    rows = [(i, [1.0, 2.0]) for i in range(30)] + [(30, [9.0, 1.0]), (30, [9.0, 1.0])] + bad
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = permutation_index.search(permutation_index.usable(vectors), F.col("id") == 0).collect()
    assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"])] == [30, *range(1, 20)]
    assert permutation_index.search(permutation_index.usable(vectors.limit(0)), F.col("id") == 0).count() == 0


def test_pipeline(spark, real, awkward):
    for docs in (real, awkward, awkward.limit(0)):
        before = docs
        for name, stage in corpus_pipeline.STAGES:
            out = corpus_pipeline.written(stage(spark, before, SF), name)
            if name != "packing":
                assert out.columns == docs.columns
            if name == "near_copies":
                ids = [r["doc_id"] for r in out.collect() if r["doc_id"] is not None]
                assert len(ids) == len(set(ids))
                wanted = {x[2] for x in components(texts(before.filter("doc_id is not null").dropDuplicates(["doc_id"])))}
                assert {repr(i) for i in ids} == wanted
            if name == "personal_data":
                want = [redacted(t) for _, t in texts(before)]
                assert sorted(t for _, t in texts(out)) == sorted(want)
            before = out
