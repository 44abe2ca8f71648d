"""Quality rules whose cutoffs come from labelled holdouts with exact binomial bounds."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievelight.functions.binding import let
from sievelight.llm.common import SPACE_CHARS, words
from sievelight.session import written

SYMBOLS = "#*$%&|<>"
WINDOW = 8
# Rules: a score in thousandths, larger is worse, and its cutoffs from mild to strict. A text fails a
# rule when its score is above the cutoff.
RULES = {
    "symbols": ("1000 * n_symbols div greatest(n_words, 1)", (2000, 1000, 700, 500, 300, 200, 100, 50, 20)),
    "repeats": ("1000 * n_repeat_words div greatest(n_words, 1)", (900, 700, 500, 300, 250, 200, 150, 100, 50)),
    "lines": ("1000 * n_dup_lines div greatest(n_lines, 1)", (800, 600, 500, 400, 300, 250, 200, 150, 100)),
    "capitals": ("1000 * n_capitals div greatest(word_chars, 1)", (900, 800, 700, 600, 500, 400, 300, 200)),
}


def repeated_words(listed: Column) -> Column:
    """Words that lie in some window of 8 words found twice or more in the list, the first included.

    Windows are compared by two 64-bit hashes in one array, sorted to bring equal ones together; texts
    without a repeated window stop before that.
    """

    def windows(hashes: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(hashes) - WINDOW)
        return F.transform(starts, lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(WINDOW))))

    def covered(found: Column) -> Column:
        placed = F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i")))

        def twice(ordered: Column) -> Column:
            marked = F.transform(
                ordered,
                lambda x, j: F.when(
                    (x["h"] == F.get(ordered, j + 1)["h"]) | (x["h"] == F.get(ordered, j - 1)["h"]), x["i"]
                ),
            )
            return F.array_sort(F.filter(marked, lambda x: x.isNotNull()))

        def total(at: Column) -> Column:
            gaps = F.transform(at, lambda p, j: F.least(F.coalesce(F.get(at, j + 1) - p, F.lit(WINDOW)), F.lit(WINDOW)))
            return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

        return let(F.sort_array(placed), lambda ordered: let(twice(ordered), total))

    def count(hashes: Column) -> Column:
        return let(
            windows(hashes),
            lambda found: F.when(F.size(F.array_distinct(found)) == F.size(found), F.lit(0)).otherwise(covered(found)),
        )

    hashes = F.transform(listed, lambda w: F.xxhash64(w))
    return F.when(F.size(listed) <= WINDOW, F.lit(0)).otherwise(let(hashes, count)).cast("long")


def features(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """``doc_id, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` and more counts."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    inked = F.translate(text, SPACE_CHARS, "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACE_CHARS, "") != "")

    def gone(value: Column, characters: str) -> Column:
        return F.char_length(value) - F.char_length(F.translate(value, characters, ""))

    counted = F.struct(
        F.char_length(inked).cast("long").alias("word_chars"),
        gone(text, SYMBOLS).cast("long").alias("n_symbols"),
        gone(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("long").alias("n_capitals"),
    )
    by_words = let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    by_lines = let(
        lines,
        lambda x: F.struct(
            F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")
        ),
    )
    return docs.select("doc_id", F.col(stratum).cast("string").alias("stratum"), by_words.alias("w"), counted.alias("c"), by_lines.alias("l")).select(
        "doc_id", "stratum", "w.*", "c.*", "l.*"
    )


def log_binomial_tail(failed: Column, n: Column, rate: float) -> Column:
    """Logarithm of P(X <= failed) for X binomial(n, rate), summed term by term.

    Terms are taken from ``failed`` downwards in ratios to the first; each is smaller than the one
    before when ``failed < n * rate``, the only case in which the tail can be small. The first term's
    logarithm is summed upwards from 0.
    """
    odds = rate / (1 - rate)
    # log of term(failed): log((1 - rate)^n) + sum of log ratios.
    top = F.aggregate(
        F.sequence(F.lit(0).cast("long"), failed),
        n * F.log1p(F.lit(-rate)),
        lambda acc, k: F.when(k == 0, acc).otherwise(acc + F.log((n - k + 1) / F.greatest(k, F.lit(1)) * odds)),
    )
    down = F.aggregate(
        F.sequence(F.lit(0).cast("long"), failed),
        F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("term")),
        lambda acc, j: F.struct(
            (acc["sum"] + acc["term"]).alias("sum"),
            (acc["term"] * (failed - j) / ((n - failed + j + 1) * odds)).alias("term"),
        ),
    )["sum"]
    return top + F.log(down)


def steps() -> list[tuple[str, int]]:
    """The fixed sequence: each step tightens one rule, all rules by one cutoff before any by the next."""
    longest = max(len(cuts) for _, cuts in RULES.values())
    return [(name, cuts[i]) for i in range(longest) for name, (_, cuts) in RULES.items() if i < len(cuts)]


def choose_cutoffs(labelled: DataFrame, risk: float = 0.02, confidence: float = 0.95) -> DataFrame:
    """``stratum, symbols, repeats, ...``: the chosen cutoff per stratum and rule, null for none.

    ``labelled`` has the features and ``quality``, one row for each independent trial (``trials``). All rules are tested together, along
    one fixed sequence from mild to strict (``steps``). A step passes if the exact binomial upper bound of
    the good rows that any rule rejects at it is at most ``risk``: that is, if so few rejected good rows
    would have a probability below the level under a larger rate. The level is ``1 - confidence`` shared
    among the strata with enough good rows to pass a test at all (Bonferroni); the search ends at the first step that fails (fixed-sequence testing),
    which needs no further share. So with the given confidence, no stratum loses more than ``risk`` of
    its good rows to all rules together. A stratum needs ``log(level) / log(1 - risk)`` good rows (217
    with four strata); with fewer, nothing passes and nothing is rejected.
    """
    good = labelled.filter(F.col("quality") == 1)
    path = steps()
    # The first step that rejects the row; null if none does.
    first = F.least(*(F.when(F.col(name) > cut, F.lit(i)) for i, (name, cut) in enumerate(path)))
    sums = [F.count_if(F.col("first") <= i).alias(f"failed_{i}") for i in range(len(path))]
    totals = good.select("stratum", first.alias("first")).groupBy("stratum").agg(F.count("*").alias("n"), *sums)
    # With fewer rows a stratum could not pass even at the whole level: it is not tested and takes no share.
    totals = written(totals.filter(F.col("n") >= math.ceil(math.log(1 - confidence) / math.log1p(-risk))), "quality-totals")
    level = F.lit((1 - confidence) / max(1, totals.count()))
    tests = F.array(*(F.struct(F.lit(i).alias("step"), F.col(f"failed_{i}").alias("failed")) for i in range(len(path))))
    rows = totals.withColumn("level", level).select("stratum", "n", "level", F.inline(tests))
    can = F.col("failed") < F.col("n") * risk
    tail = log_binomial_tail(F.when(can, F.col("failed")).otherwise(F.lit(0).cast("long")), F.col("n"), risk)
    rows = rows.withColumn("passed", can & (tail <= F.log("level")))
    sequence = W.partitionBy("stratum").orderBy("step")
    rows = rows.withColumn("passed", F.every("passed").over(sequence))
    last = rows.groupBy("stratum").agg(F.max(F.when(F.col("passed"), F.col("step"))).alias("last"))
    return last.select(
        "stratum",
        *(F.least(*(F.when(F.col("last") >= i, F.lit(cut)) for i, (rule, cut) in enumerate(path) if rule == name)).alias(name) for name in RULES),
    )


def trials(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``stratum, doc_id, quality`` and the score by each rule: one row for each labelled document.

    Rows that share a doc_id share its labels, so they are one observation, not several: of their scores
    the worst counts, as the document loses text at the first step that rejects any of its rows. Scores are
    reduced to one row per document before the labels are joined, so a doc_id with many rows is no hot key.
    """
    worst = rows.filter(F.col("doc_id").isNotNull()).groupBy("stratum", "doc_id").agg(*(F.max(c).alias(c) for c in RULES))
    marks = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).dropna().distinct()
    return worst.join(marks, "doc_id")


def judge(
    docs: DataFrame,
    labels: DataFrame,
    stratum: str = "lang",
    risk: float = 0.02,
    confidence: float = 0.95,
) -> DataFrame:
    """Base counts of ``doc_id, text`` and a verdict; ``labels`` has ``doc_id, quality``.

    ``base_failed``: fewer than 20 words, or more than 30 % of them in repeated windows. ``kept`` is
    false for these; the others are kept unless they fail a rule at their stratum's cutoff. Every
    stratum stands alone. Cutoffs are chosen on the labelled rows that pass the base, so the guarantee is
    for what the rules add.

    Texts are read once. Null texts count as empty (base failed); a null stratum is one of its own;
    rows with equal doc_ids are judged alone, but are one trial in the choice of cutoffs; labels that
    disagree about a doc_id all count, null and repeated ones do not; no labels: the base alone decides.
    """
    rows = written(features(docs, stratum), "quality-features")
    rows = rows.withColumn(
        "base_failed",
        (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
    )
    rows = rows.withColumns({name: F.expr(rule) for name, (rule, _) in RULES.items()})
    labelled = trials(rows.filter(~F.col("base_failed")), labels)
    # One row for each stratum in which a step passed.
    cutoffs = choose_cutoffs(labelled, risk, confidence).filter(F.coalesce(*RULES).isNotNull())
    cutoffs = written(cutoffs.select(F.col("stratum").alias("_own"), *(F.col(c).alias(f"_{c}") for c in RULES)), "quality-cutoffs")
    judged = rows.join(cutoffs, F.col("stratum").eqNullSafe(F.col("_own")), "left")
    failed = [F.coalesce(F.col(c) > F.col(f"_{c}"), F.lit(False)) for c in RULES]
    any_failed = failed[0]
    for f in failed[1:]:
        any_failed = any_failed | f
    return judged.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & ~any_failed).alias("kept"),
        F.array_compact(F.array(*(F.when(f, F.lit(c)) for c, f in zip(RULES, failed)))).alias("failed_rules"),
    )
