"""TF-IDF over one- and two-word terms as a long table.

Rules: lower-case words of two or more word characters; pairs join neighbouring kept words; raw
counts; ``idf = ln((1 + n) / (1 + df)) + 1``; rows scaled to length 1. Terms in fewer than ``min_df``
documents go first, then the ``max_features`` most frequent stay, ties by term.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelight.functions import text as fn
from sievelight.operators.lookup import SMALL_ROWS
from sievelight.session import written

PART_TERMS = 1 << 20  # occurrences that one task counts by document
BUCKETS = 1 << 20  # of the counts that bound how often a term occurs
BUCKETS_PER_FEATURE = 4  # of the fullest ones whose terms are counted first


def _terms(text: Column) -> Column:
    return F.explode(fn.one_and_two_grams(fn.words(text))).alias("term")


def document_terms(df: DataFrame, text_col: str, key: str, occurrences: int | None = None) -> DataFrame:
    """One row per term occurrence.

    Documents move by key once, as raw text. Counting by (key, term) and the row norm by key then
    stay on that partitioning, so the much larger term rows are never shuffled by document. The number
    of tasks follows the ``occurrences`` to be counted (estimated from the bytes of text if not given), so
    the counts in a task's memory do not grow with the table.
    """
    if occurrences is None:
        occurrences = (df.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0) // 3
    parts = max(-(-occurrences // PART_TERMS), df.sparkSession.sparkContext.defaultParallelism)
    return (
        df.select(key, F.col(text_col).alias("_text"))
        .repartition(parts, key)
        .select(key, _terms(F.col("_text")))
    )


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS))


def bucket_counts(df: DataFrame, text_col: str) -> DataFrame:
    """``_bucket, _n``: occurrences of all terms of a bucket, so no term of it occurs more often.

    Counted where the texts lie; a task holds and sends ``BUCKETS`` numbers at most, whatever its terms.
    """
    return df.select(_terms(F.col(text_col))).groupBy(_bucket(F.col("term")).alias("_bucket")).agg(F.count(F.lit(1)).alias("_n"))


def _most_frequent(
    terms: DataFrame, key: str, max_features: int, min_df: int, buckets: DataFrame | None = None
) -> DataFrame:
    """``term, df, tf`` of the most frequent terms, of those in ``buckets`` if given."""
    if buckets is not None:
        terms = terms.join(F.broadcast(buckets.select("_bucket")), _bucket(F.col("term")) == F.col("_bucket"), "left_semi")
    return (
        terms.groupBy(key, "term")
        .agg(F.count(F.lit(1)).alias("tf"))
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))
        .where(F.col("df") >= min_df)
        .orderBy(F.desc("tf"), "term")
        .limit(max_features)
    )


def frequent_terms(df: DataFrame, text_col: str, key: str, max_features: int, min_df: int) -> DataFrame:
    """``term, df, tf`` of the ``max_features`` most frequent terms, exactly; written.

    Most terms of a large table are rare, so first the terms of the fullest buckets are counted. If the
    last one kept is more frequent than any bucket left out is full, no term is missed. Else buckets at
    least as full as that one is frequent are counted, and all of them if too few terms were found.
    """
    first = BUCKETS_PER_FEATURE * max_features
    if first >= BUCKETS:
        terms = document_terms(df, text_col, key)
        return written(_most_frequent(terms, key, max_features, min_df), "vocabulary")
    counts = written(bucket_counts(df, text_col), "term_buckets")
    terms = document_terms(df, text_col, key, counts.agg(F.sum("_n")).first()[0] or 0)
    found, rest = counts.orderBy(F.desc("_n")).limit(first).agg(F.count(F.lit(1)), F.min("_n")).first()
    if found < first:
        return written(_most_frequent(terms, key, max_features, min_df), "vocabulary")
    full = counts.where(F.col("_n") > rest)
    kept = written(_most_frequent(terms, key, max_features, min_df, full), "vocabulary")
    found, last = kept.agg(F.count(F.lit(1)), F.min("tf")).first()
    if found == max_features and last > rest:
        return kept
    wider = counts.where(F.col("_n") >= last) if found == max_features else None
    return written(_most_frequent(terms, key, max_features, min_df, wider), "vocabulary")


def tfidf_vocab(
    df: DataFrame, text_col: str, key: str, max_features: int = 5000, min_df: int = 2
) -> DataFrame:
    """``(term, df, tf, idf, term_index)``; at most ``max_features`` rows."""
    kept = frequent_terms(df, text_col, key, max_features, min_df)
    n_docs = df.agg(F.count(F.lit(1)).cast("double")).scalar()
    return kept.withColumns(
        {
            "idf": F.ln((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0),
            "term_index": F.row_number().over(Window.orderBy("term")) - 1,
        }
    )


def tfidf_matrix(
    df: DataFrame,
    text_col: str,
    key: str,
    max_features: int = 5000,
    min_df: int = 2,
    vocab: DataFrame | None = None,
) -> DataFrame:
    """``(key, term, term_index, tfidf)``, non-zero entries only."""
    if vocab is None:
        vocab = tfidf_vocab(df, text_col, key, max_features, min_df)
    occurrences = (vocab.agg(F.sum("tf")).first()[0] or 0) if "tf" in vocab.columns else None
    vocab = vocab.select("term", "term_index", "idf")
    if max_features <= SMALL_ROWS:  # the limit above bounds the table
        vocab = F.broadcast(vocab)
    weighted = (
        document_terms(df, text_col, key, occurrences)
        .join(vocab, "term")
        .groupBy(key, "term", "term_index", "idf")
        .agg(F.count(F.lit(1)).alias("tf"))
        .withColumn("_w", F.col("tf") * F.col("idf"))
    )
    length = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(key)))
    return weighted.select(key, "term", "term_index", (F.col("_w") / length).alias("tfidf"))


def tfidf_top_terms(
    df: DataFrame,
    text_col: str,
    key: str,
    k: int = 10,
    max_features: int = 5000,
    min_df: int = 2,
    vocab: DataFrame | None = None,
) -> DataFrame:
    """Terms of the highest mean weight over all documents, absent terms counting as zero."""
    matrix = tfidf_matrix(df, text_col, key, max_features, min_df, vocab)
    n_docs = df.agg(F.count(F.lit(1))).scalar()
    return (
        matrix.groupBy("term")
        .agg(F.sum("tfidf").alias("_sum"))
        .select("term", (F.col("_sum") / n_docs).alias("mean_tfidf"))
        .orderBy(F.desc(F.round("mean_tfidf", 12)), "term")
        .limit(k)
    )
