"""Personal data: fixed patterns, and bootstrapped contextual extraction of what they miss."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelight.functions.binding import let
from sievelight.llm.common import ROW, SPACE, with_row_key
from sievelight.session import written

KINDS = ("email", "ip", "card", "phone")
# The base patterns. Possessive quantifiers match the same texts, as what follows a run
# never starts with a character of the run, and keep long runs from costing stack or repeated scans.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
# What may be an identifier: a phone, a run of digit groups, or a word with a digit or an at sign.
CANDIDATE = rf"{PHONE}|(?<![^{SPACE}]){CARD}(?![^{SPACE}])|(?<![^{SPACE}])[^{SPACE}0-9@]*+[0-9@][^{SPACE}]*+"
# A candidate's opening (a name with = or :, and opening marks), core and closing marks.
PARTS = r"""^((?:[A-Za-z_-]*[=:])?["'(<\[]*)(.+?)([.,;:!?"')>\]]*)$"""
# A word that names what follows it.
LABEL = r"""[:=#]["'(<\[]*$"""
CONTEXT = 64
# Elements of an array that are summed up at a time.
CHUNK = 64
# Code points of a text that are cut off at a time.
LEAF = 1024
# What a core that no kind claims counts against a pattern.
DOUBT = 0.5
SPAN = "array<struct<kind:int,start:int,end:int>>"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(match: Column) -> Column:
    """Sixteen to nineteen digits whose Luhn sum is a multiple of 10."""

    def value(digits: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            digit = F.substring(digits, -i, F.lit(1)).cast("int")
            twice = digit * F.when(i % 2 == 0, 2).otherwise(1)
            return acc + F.when(twice > 9, twice - 9).otherwise(twice)

        ok = F.length(digits).between(16, 19)
        return ok & (F.aggregate(F.sequence(F.lit(1), F.when(ok, F.length(digits)).otherwise(1)), F.lit(0), step) % 10 == 0)

    return let(_digits(match), value)


def running(values: Column, kind: str, combine) -> Column:
    """``combine`` of each element of an array of ``kind`` with all before it; ``combine`` is associative.

    Elements are combined inside chunks and over the chunks' totals, so that no long array grows element
    by element.
    """

    def along(part: Column, first: Column) -> Column:
        empty = F.struct(first.alias("at"), F.expr(f"cast(array() as array<{kind}>)").alias("all"))

        def step(acc: Column, x: Column) -> Column:
            return let(
                F.when(acc["at"].isNull(), x).otherwise(combine(acc["at"], x)),
                lambda now: F.struct(now.alias("at"), F.concat(acc["all"], F.array(now)).alias("all")),
            )

        return F.aggregate(part, empty, step)["all"]

    nothing = F.lit(None).cast(kind)

    def chunked(chunks: Column) -> Column:
        totals = F.transform(chunks, lambda c: F.get(along(c, nothing), F.size(c) - 1))
        return let(along(totals, nothing), lambda sums: F.flatten(F.transform(chunks, lambda c, i: along(c, F.get(sums, i - 1)))))

    starts = F.sequence(F.lit(1), F.size(values), F.lit(CHUNK))
    chunks = F.transform(starts, lambda i: F.slice(values, i, CHUNK))
    return F.when(F.size(values) > 0, let(chunks, chunked)).otherwise(F.expr(f"cast(array() as array<{kind}>)"))


def _placed(text: Column, pattern: str) -> Column:
    """``before, match, after, start, end`` of all matches in order; places count code points.

    Splitting and extracting find the same matches, so the running sum of both's lengths gives the places.
    """

    def join(gaps: Column, found: Column) -> Column:
        lengths = F.transform(found, lambda m, i: F.char_length(F.get(gaps, i)) + F.char_length(m))

        def items(ends: Column) -> Column:
            return F.transform(
                found,
                lambda m, i: F.struct(
                    F.get(gaps, i).alias("before"),
                    m.alias("match"),
                    F.get(gaps, i + 1).alias("after"),
                    (F.get(ends, i) - F.char_length(m)).alias("start"),
                    F.get(ends, i).alias("end"),
                ),
            )

        return let(running(lengths, "int", lambda x, y: x + y), items)

    return let(F.split(text, pattern, -1), lambda b: let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda f: join(b, f)))


def _ordered(spans: Column) -> Column:
    """The spans by start, each with ``reach`` and ``of``: the furthest end so far, and its span's kind."""

    def reached(ordered: Column) -> Column:
        ends = F.transform(ordered, lambda x: F.struct(x["end"].alias("end"), x["kind"].alias("kind")))
        return let(
            running(ends, "struct<end:int,kind:int>", lambda x, y: F.greatest(x, y)),
            lambda far: F.transform(
                ordered,
                lambda x, i: F.struct(
                    x["start"].alias("start"),
                    x["end"].alias("end"),
                    x["kind"].alias("kind"),
                    F.get(far, i)["end"].alias("reach"),
                    F.get(far, i)["kind"].alias("of"),
                ),
            ),
        )

    by_start = F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))
    return let(F.array_sort(by_start), reached)


def _overlapped(ordered: Column, start: Column, end: Column) -> Column:
    """The kind of a span of ``_ordered`` that overlaps [start, end), else null: by halving, not by a scan."""
    bits = F.sequence(F.floor(F.log2(F.size(ordered).cast("double"))).cast("int"), F.lit(0), F.lit(-1))

    def step(n: Column, bit: Column) -> Column:
        more = n + F.call_function("shiftleft", F.lit(1), bit)
        return F.when((more <= F.size(ordered)) & (F.get(ordered, more - 1)["start"] < end), more).otherwise(n)

    last = let(F.aggregate(bits, F.lit(0), step), lambda n: F.get(ordered, n - 1))
    return F.when(F.size(ordered) > 0, let(last, lambda x: F.when(x["reach"] > start, x["of"])))


def base_spans(text: Column) -> Column:
    """Spans ``kind, start, end`` of the four base patterns, by kind, then start."""
    kinds = (
        (EMAIL, text.contains("@"), lambda m: F.lit(True)),
        (IP, text.rlike(r"[0-9]\.[0-9]"), lambda m: m.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")),
        (CARD, text.rlike("[0-9]"), _luhn),
        (PHONE, text.contains("+"), lambda m: F.length(_digits(m)).between(8, 15)),
    )
    none = F.expr(f"cast(array() as {SPAN})")
    found = []
    for kind, (pattern, possible, valid) in enumerate(kinds):
        right = F.filter(_placed(text, pattern), lambda x: valid(x["match"]))
        spans = F.transform(right, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
        found.append(F.when(possible, spans).otherwise(none))
    return F.concat(*found)


def shape(core: Column) -> Column:
    """The shape class: runs of letters, digits and mixtures as one mark each, and the digits by fours."""
    runs = F.regexp_replace(F.regexp_replace(core, "[0-9]+", "9"), r"\p{L}+", "a")
    mixed = F.regexp_replace(runs, "(?:9a|a9)[9a]*", "x")
    short = F.when(F.length(mixed) <= CONTEXT, mixed).otherwise(F.md5(mixed))
    return F.concat(short, F.lit("/"), F.ceil(F.length(_digits(core)) / 4).cast("string"))


def candidates(text: Column, base: Column) -> Column:
    """``patterns, core, kind, start, end`` of all that may be identifiers.

    Three patterns stand for the places a core is seen in: the two words before it; the word before and the
    core's shape, if that word or the opening ends like a label; the word before and what follows. All hold
    the opening, in lower case, from at most 64 characters on either side. One word alone is no pattern:
    that would be a function word more often than not.
    ``kind`` is that of a base span that overlaps the candidate, else null.
    """

    def item(x: Column, ordered: Column) -> Column:
        near = F.lower(F.substring(x["before"], -CONTEXT, CONTEXT))
        two = F.regexp_extract(near, rf"((?:[^{SPACE}]+[{SPACE}]+)?[^{SPACE}]+)[{SPACE}]*$", 1)
        one = F.regexp_extract(near, rf"([^{SPACE}]+)[{SPACE}]*$", 1)
        next_ = F.regexp_extract(F.lower(F.substring(x["after"], 1, CONTEXT)), rf"^[{SPACE}]*([^{SPACE}]*)", 1)
        opening, core, closing = (F.regexp_extract(x["match"], PARTS, i) for i in (1, 2, 3))

        def parts(p: Column) -> Column:
            left = F.concat_ws(" ", p["one"], p["opening"])
            start = x["start"] + F.char_length(p["opening"])
            patterns = F.array(
                F.when(p["two"].rlike(f"[{SPACE}]"), F.concat_ws(" ", F.lit("2"), p["two"], p["opening"])),
                F.when(left.rlike(LABEL), F.concat_ws(" ", F.lit("s"), left, shape(p["core"]))),
                F.when((p["one"] != "") & (p["next"] != ""), F.concat_ws(" ", F.lit("r"), left, p["closing"], p["next"])),
            )
            return F.struct(
                F.array_compact(patterns).alias("patterns"),
                p["core"].alias("core"),
                _overlapped(ordered, x["start"], x["end"]).alias("kind"),
                start.alias("start"),
                (start + F.char_length(p["core"])).alias("end"),
            )

        named = {"two": two, "one": one, "next": next_, "opening": F.lower(opening), "core": core, "closing": closing}
        return let(F.struct(*(c.alias(n) for n, c in named.items())), parts)

    found = let(_ordered(base), lambda ordered: F.transform(_placed(text, CANDIDATE), lambda x: item(x, ordered)))
    kept = F.filter(found, lambda x: (x["kind"].isNotNull()) | (F.length(x["core"]) >= 5))
    none = F.expr("cast(array() as array<struct<patterns:array<string>,core:string,kind:int,start:int,end:int>>)")
    return F.when(text.rlike("[0-9@]"), kept).otherwise(none)


def lower_bound(positive: Column, n: Column) -> Column:
    """The lower end of Wilson's interval of one standard deviation for a share of ``positive`` in ``n``."""
    share = positive / n
    return (share + 0.5 / n - F.sqrt(share * (1 - share) / n + 0.25 / (n * n))) / (1 + 1 / n)


def bootstrap(seen: DataFrame, rounds: int = 2, support: float = 5, confidence: float = 0.8) -> DataFrame:
    """``core, kind, score`` of identifiers that no base pattern finds.

    ``seen`` has ``pattern, core, kind`` per occurrence. Patterns and cores form a graph. A core known
    by a base pattern scores 1 for its kind. In each round a pattern's confidence for a kind is the lower
    bound of the share that its cores' scores have in its cores: those of another kind count in full, what
    no kind claims ``DOUBT`` times. Patterns with at least ``support`` and ``confidence`` are trusted. An
    unknown core scores 1 less the product of what its trusted patterns leave open. The next round counts
    these scores too. All steps are counts and joins by key.
    """
    edges = seen.groupBy("pattern", "core").agg(F.max("kind").alias("kind"))
    edges = written(edges, "pii-edges")
    found = None
    for _ in range(rounds):
        if found is None:
            scored = edges.withColumn("score", F.when(F.col("kind").isNotNull(), 1.0).otherwise(0.0))
        else:
            known = found.select("core", F.col("kind").alias("_kind"), F.col("score").alias("_score"))
            scored = edges.join(known, "core", "left").select(
                "pattern",
                "core",
                F.coalesce("kind", "_kind").alias("kind"),
                F.when(F.col("kind").isNotNull(), 1.0).otherwise(F.coalesce("_score", F.lit(0.0))).alias("score"),
            )
        sums = [F.sum(F.when(F.col("kind") == k, F.col("score")).otherwise(0.0)).alias(f"_{k}") for k in range(len(KINDS))]
        weight = F.sum(F.when(F.col("kind").isNull(), DOUBT).otherwise(F.col("score") + DOUBT * (1 - F.col("score"))))
        patterns = scored.groupBy("pattern").agg(weight.alias("_n"), *sums)
        best = F.greatest(*(F.col(f"_{k}") for k in range(len(KINDS))))
        which = F.coalesce(*(F.when(F.col(f"_{k}") == best, F.lit(k)) for k in range(len(KINDS))))
        trusted = patterns.select("pattern", which.alias("_kind"), best.alias("_sum"), lower_bound(best, F.col("_n")).alias("_confidence"))
        trusted = trusted.filter((F.col("_sum") >= support) & (F.col("_confidence") >= confidence))
        open_ = F.log(F.greatest(1 - F.col("_confidence"), F.lit(1e-6)))
        found = (
            edges.filter(F.col("kind").isNull())
            .join(trusted, "pattern")
            .groupBy("core")
            .agg(F.max_by("_kind", "_confidence").alias("kind"), (1 - F.exp(F.sum(open_))).alias("score"))
        )
        found = written(found, "pii-found")
    return found


def find(docs: DataFrame, rounds: int = 2, support: float = 5, confidence: float = 0.8) -> DataFrame:
    """``row, doc_id, base, spans`` of ``doc_id, text``; ``row`` is a key of the rows as written.

    ``base`` are the spans of the base patterns; ``spans`` adds those found by context, where they do
    not overlap a base span; both by kind, then start. Texts are scanned once, whole. Null and empty
    texts have no spans; repeated rows have spans of their own but count once per (pattern, core); rows
    with equal or null doc_ids stay apart. Without seeds nothing is added.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text.alias("text"))
    both = let(F.struct(F.col("text").alias("text"), base_spans(F.col("text")).alias("base")), lambda x: F.struct(x["base"].alias("base"), candidates(x["text"], x["base"]).alias("seen")))
    rows = written(rows.select("row", "doc_id", both.alias("_")).select("row", "doc_id", "_.*"), "pii-rows")
    seen = rows.select("row", F.inline("seen"))
    found = bootstrap(seen.select(F.explode("patterns").alias("pattern"), "core", "kind"), rounds, support, confidence).filter(F.col("score") >= confidence)
    fresh = seen.filter(F.col("kind").isNull()).drop("kind").join(found, "core")
    fresh = fresh.groupBy("row").agg(F.collect_set(F.struct("kind", "start", "end")).alias("_more"))
    apart = let(_ordered(F.col("base")), lambda b: F.filter("_more", lambda x: _overlapped(b, x["start"], x["end"]).isNull()))
    more = F.coalesce(apart, F.expr(f"cast(array() as {SPAN})"))
    return rows.select("row", "doc_id", "base").join(fresh, "row", "left").select(
        "row", "doc_id", "base", F.array_sort(F.concat("base", more)).alias("spans")
    )


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of all spans, joined by commas."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def redact(docs: DataFrame, **options) -> DataFrame:
    """The documents with each span replaced by its kind in brackets; overlapping spans become one.

    Keeps rows and columns (``n_chars`` is counted anew if there).
    """
    rows = with_row_key(docs)
    found = find(rows.select(F.col(ROW).alias("doc_id"), "text"), **options).filter(F.size("spans") > 0)
    found = found.select(F.col("doc_id").alias(ROW), F.col("spans").alias("_spans"))
    text, names = F.col("text"), F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))

    def replaced(ordered: Column, leaves: Column) -> Column:
        def between(start: Column, end: Column) -> Column:
            # From the leaves that hold the two places and those amid: no place is counted from the text's start.
            first, last = (start / LEAF).cast("int"), (end / LEAF).cast("int")
            head = F.substring(F.get(leaves, first), start % LEAF + 1, F.when(first == last, end - start).otherwise(F.lit(LEAF)))
            amid = F.array_join(F.slice(leaves, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
            tail = F.when(last > first, F.substring(F.get(leaves, last), F.lit(1), end % LEAF)).otherwise("")
            return F.concat(F.coalesce(head, F.lit("")), amid, F.coalesce(tail, F.lit("")))

        def piece(x: Column, i: Column) -> Column:
            at = F.coalesce(F.get(ordered, i - 1)["reach"], F.lit(0))
            return F.when(x["start"] >= at, F.concat(between(at, x["start"]), F.get(names, x["kind"]))).otherwise("")

        rest = between(F.get(ordered, F.size(ordered) - 1)["reach"], F.char_length(text))
        return F.concat(F.array_join(F.transform(ordered, piece), ""), rest)

    leaves = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{LEAF}}}"), F.lit(0))
    new = let(_ordered(F.col("_spans")), lambda o: let(leaves, lambda x: replaced(o, x)))
    out = rows.join(found, ROW, "left").withColumn("text", F.when(F.col("_spans").isNull(), text).otherwise(new))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_spans").isNull(), F.col("n_chars")).otherwise(F.char_length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)
