"""Text checks, duplicates, scalar text functions, TF-IDF."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import Tables, query
from catalog.views import LETTERS, WS
from sievelight.functions import text as fn
from sievelight.operators import reports, shaping, text_checks, tfidf

ML_COLUMNS = (
    "id", "text_clean", "char_length", "word_count", "has_special_only", "text_is_null",
    "text_is_empty", "text_too_short", "text_too_long", "text_is_duplicate", "text_valid",
)
BASIC_COLUMNS = (
    "id", "text_clean", "char_length", "word_count", "is_null", "is_empty", "too_short",
    "too_long", "is_duplicate", "is_valid",
)


def ml(t: Tables):
    return text_checks.validate_text_ml(t.samples, "text", "id")


def basic(t: Tables):
    return text_checks.validate_text_basic(t.samples, "text", "id")


@query("validate_text_ml", f"SELECT {', '.join(ML_COLUMNS)} FROM k_text_ml")
def _(t):
    return ml(t).select(*ML_COLUMNS)


@query("validate_text_basic", f"SELECT {', '.join(BASIC_COLUMNS)} FROM k_text_basic")
def _(t):
    return basic(t).select(*BASIC_COLUMNS)


@query("text_derive", "SELECT id, text_clean, char_length, word_count, is_null, is_empty FROM k_text_basic")
def _(t):
    derived = text_checks.clean_columns(t.samples, "text", collapse=False)
    return derived.select(
        "id", "text_clean", "char_length", "word_count",
        F.col("text").isNull().alias("is_null"), (F.col("text_clean") == "").alias("is_empty"),
    )


@query(
    "text_flags",
    "SELECT id, text_is_null, text_is_empty, text_too_short, text_too_long FROM k_text_ml",
)
def _(t):
    return text_checks.row_checks_ml(t.samples, "text").select(
        "id", "text_is_null", "text_is_empty", "text_too_short", "text_too_long"
    )


@query("text_valid", "SELECT id, text_valid FROM k_text_ml")
def _(t):
    return text_checks.row_checks_ml(t.samples, "text").select("id", "text_valid")


@query("text_duplicates_any", "SELECT id, is_duplicate FROM k_text_basic")
def _(t):
    return basic(t).select("id", "is_duplicate")


@query("text_duplicates_first", "SELECT id, text_is_duplicate FROM k_text_ml")
def _(t):
    return ml(t).select("id", "text_is_duplicate")


@query("drop_duplicate_text", "SELECT id, text_clean FROM k_text_ml WHERE NOT text_is_duplicate")
def _(t):
    cleaned = text_checks.clean_columns(t.samples, "text", collapse=True)
    return text_checks.drop_copies(cleaned.select("id", "text_clean"), "text_clean", "id")


@query(
    "text_report",
    """SELECT count(*) AS total, count(*) FILTER (WHERE text_valid) AS valid,
  round(count(*) FILTER (WHERE text_valid) / count(*) * 100, 1) AS valid_pct,
  count(*) FILTER (WHERE text_is_null) AS null_count, count(*) FILTER (WHERE text_is_empty) AS empty_count,
  count(*) FILTER (WHERE text_too_short) AS too_short, count(*) FILTER (WHERE text_too_long) AS too_long,
  count(*) FILTER (WHERE text_is_duplicate) AS duplicates,
  round(avg(char_length) FILTER (WHERE text_valid), 6) AS mean_length,
  min(char_length) FILTER (WHERE text_valid) AS min_length, max(char_length) FILTER (WHERE text_valid) AS max_length
FROM k_text_ml""",
)
def text_report(t):
    return reports.text_report(ml(t)).withColumn("mean_length", F.round("mean_length", 6))


@query(
    "text_summary",
    """SELECT count(*) AS total, count(*) FILTER (WHERE is_valid) AS valid, count(*) FILTER (WHERE is_null) AS "null",
  count(*) FILTER (WHERE is_empty) AS empty, count(*) FILTER (WHERE too_short) AS too_short,
  count(*) FILTER (WHERE too_long) AS too_long, count(*) FILTER (WHERE is_duplicate) AS duplicates,
  round(avg(char_length), 1) AS avg_char_length, round(avg(word_count), 1) AS avg_word_count
FROM k_text_basic""",
)
def _(t):
    return reports.text_summary(basic(t))


@query("extract_text_columns", "SELECT id, text, label FROM v_samples")
def _(t):
    return shaping.extract_text_columns(t.samples, "text", "label", keep=["id"])


# scalar functions


@query("fn_strip", f"SELECT doc_id, regexp_replace(concat('  ', text, chr(160), chr(9)), '^{WS}+|{WS}+$', '', 'g') AS r FROM documents")
def _(t):
    padded = F.concat(F.lit("  "), F.col("text"), F.lit(chr(160) + chr(9)))
    return t.documents.select("doc_id", fn.strip(padded).alias("r"))


@query("fn_collapse_ws", f"SELECT doc_id, regexp_replace(text, '{WS}+', ' ', 'g') AS r FROM documents")
def _(t):
    return t.documents.select("doc_id", fn.collapse_whitespace(F.col("text")).alias("r"))


@query("fn_lower", "SELECT doc_id, lower(text) AS r FROM documents")
def _(t):
    return t.documents.select("doc_id", F.lower("text").alias("r"))


@query("fn_replace", "SELECT doc_id, replace(text, ' ', '_') AS r FROM documents")
def _(t):
    return t.documents.select("doc_id", F.replace("text", F.lit(" "), F.lit("_")).alias("r"))


@query("fn_char_length", "SELECT doc_id, CAST(length(text) AS INTEGER) AS r FROM documents")
def _(t):
    return t.documents.select("doc_id", fn.char_length(F.col("text")).alias("r"))


@query("fn_word_count", "SELECT id, word_count AS r FROM k_text_ml")
def _(t):
    clean = fn.strip_and_collapse(F.coalesce("text", F.lit("")))
    return t.samples.select("id", clean.alias("c")).select(
        "id", fn.word_count(F.col("c")).alias("r")
    )


@query(
    "fn_special_only",
    f"SELECT id, regexp_matches(coalesce(text, ''), '^[^{LETTERS}]+$') AS r FROM v_samples",
)
def _(t):
    return t.samples.select("id", fn.special_only(F.coalesce("text", F.lit(""))).alias("r"))


@query("fn_fill", "SELECT id, coalesce(text, '') AS r FROM v_samples")
def _(t):
    return t.samples.select("id", F.coalesce("text", F.lit("")).alias("r"))


@query("fn_truncate", "SELECT id, substr(text, 1, 80) AS r80, substr(text, 1, 60) AS r60 FROM v_samples")
def _(t):
    return t.samples.select(
        "id", fn.truncate(F.col("text"), 80).alias("r80"), fn.truncate(F.col("text"), 60).alias("r60")
    )


# TF-IDF


def cleaned(t: Tables):
    return text_checks.clean_columns(t.samples, "text", collapse=True).select("id", "text_clean")


@query("tfidf_vocab", "SELECT term, df, tf, round(idf, 6) AS idf, term_index FROM k_vocab")
def _(t):
    return tfidf.tfidf_vocab(cleaned(t), "text_clean", "id").select(
        "term", "df", "tf", F.round("idf", 6).alias("idf"), F.col("term_index").cast("bigint").alias("term_index")
    )


@query("vocab_topk", "SELECT term, tf FROM k_vocab ORDER BY tf DESC, term LIMIT 100")
def _(t):
    return tfidf.tfidf_vocab(cleaned(t), "text_clean", "id", max_features=100).select("term", "tf")


@query("tfidf_matrix", "SELECT id, term, round(tfidf, 6) AS tfidf FROM k_tfidf")
def _(t):
    return tfidf.tfidf_matrix(cleaned(t), "text_clean", "id").select(
        "id", "term", F.round("tfidf", 6).alias("tfidf")
    )


TOP_TERMS = """SELECT term, round(sum(tfidf) / (SELECT count(*) FROM v_samples), 6) AS mean_tfidf
FROM k_tfidf GROUP BY term ORDER BY sum(tfidf) DESC, term LIMIT 10"""


@query("tfidf_top_terms", TOP_TERMS)
def _(t):
    return tfidf.tfidf_top_terms(cleaned(t), "text_clean", "id").select(
        "term", F.round("mean_tfidf", 6).alias("mean_tfidf")
    )


@query("topk_terms", TOP_TERMS.replace("LIMIT 10", "LIMIT 25"))
def _(t):
    return tfidf.tfidf_top_terms(cleaned(t), "text_clean", "id", k=25).select(
        "term", F.round("mean_tfidf", 6).alias("mean_tfidf")
    )
