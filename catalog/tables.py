"""Column shaping, filters, counts and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import Tables, query
from sievelight.functions import codes, paths
from sievelight.functions.numbers import percent
from sievelight.operators import counts, encode, image_checks, reports, shaping, split, text_checks

from sievelight.config import Config
from sievelight.plans.quality import flag_rows, run_quality


def pairs(column):
    """A ``value -> count`` map as one text, sorted by value."""
    entries = F.array_sort(F.map_entries(column))
    return F.array_join(
        F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ";"
    )


def flagged(t: Tables):
    """Samples with text and image flags."""
    return flag_rows(t.samples, "id", Config(), t.sample_files)


# shaping


@query("normalize_columns", "SELECT p_partkey AS row_id, p_name AS img_name, p_size AS size FROM part")
def _(t):
    ugly = t.part.select(
        F.col("p_partkey").alias("  Row ID "), F.col("p_name").alias("Img Name"), F.col("p_size").alias("SIZE")
    )
    return shaping.normalize_columns(ugly)


@query("select_existing", "SELECT age, diameter_1, region FROM v_metadata")
def _(t):
    return shaping.select_existing(t.metadata, ["age", "absent", "diameter_1", "region"])


@query(
    "feature_matrix",
    "SELECT row_id, age AS f0, fitspatrick AS f1, round(diameter_1, 6) AS f2, round(diameter_2, 6) AS f3 FROM v_metadata",
)
def _(t):
    matrix = shaping.feature_matrix(t.metadata, encode.LESION_FEATURES)
    return matrix.select(
        "row_id", *[F.round(F.get("features", F.lit(i)), 6).alias(f"f{i}") for i in range(4)]
    )


@query(
    "cast_features_float",
    """SELECT row_id, CAST(age AS FLOAT) AS age, CAST(fitspatrick AS FLOAT) AS fitspatrick,
  CAST(diameter_1 AS FLOAT) AS diameter_1, CAST(diameter_2 AS FLOAT) AS diameter_2,
  coalesce(diagnostic, 'nan') AS diagnostic FROM v_metadata""",
)
def _(t):
    cast = shaping.cast_features_float(t.metadata, encode.LESION_FEATURES, "diagnostic", "nan")
    return cast.select("row_id", *encode.LESION_FEATURES, "diagnostic")


@query("tag_source", "SELECT id, label, 'csv' AS _source FROM v_samples")
def _(t):
    return shaping.tag_source(t.samples.select("id", "label"), "csv")


UNION_SQL = """SELECT CAST(doc_id AS VARCHAR) AS id, lang AS label, NULL::BIGINT AS n_chars, 'csv' AS _source FROM documents
UNION ALL SELECT CAST(doc_id AS VARCHAR), NULL, n_chars, 'excel' FROM documents
UNION ALL SELECT concat('q', doc_id), CAST(quality AS VARCHAR), NULL, 'database' FROM labels"""


@query("union_sources", UNION_SQL)
def _(t):
    csv = t.documents.select(F.col("doc_id").alias("id"), F.col("lang").alias("label"))
    excel = t.documents.select(F.col("doc_id").alias("id"), "n_chars")
    database = t.labels.select(
        F.concat(F.lit("q"), F.col("doc_id")).alias("id"), F.col("quality").alias("label")
    )
    return shaping.union_sources([csv, excel, database], ["csv", "excel", "database"])


@query("filter_nonempty_sources", "SELECT doc_id, 'source_1' AS _source FROM documents")
def _(t):
    no_rows = t.part.where("p_partkey < 0").select(F.lit("x").alias("doc_id"), F.lit(1).alias("junk"))
    return shaping.union_sources([None, t.documents.select("doc_id"), no_rows])


# filters


@query("clean_filter", "SELECT id, text_clean, label FROM k_clean")
def _(t):
    return shaping.clean_filter(flagged(t)).select("id", "text_clean", "label")


@query(
    "clean_counts",
    """SELECT count(*) AS n_all, count(*) FILTER (WHERE text_valid) AS n_after_text,
  count(*) FILTER (WHERE text_valid AND img_valid) AS n_after_image,
  count(*) FILTER (WHERE text_valid AND img_valid AND NOT text_is_duplicate) AS n_clean FROM k_flagged""",
)
def _(t):
    return shaping.clean_counts(flagged(t))


@query("error_rows", "SELECT id, text_valid, img_valid, img_error FROM k_flagged WHERE NOT text_valid OR NOT img_valid")
def _(t):
    return shaping.error_rows(flagged(t)).select("id", "text_valid", "img_valid", "img_error")


@query("head_n", "SELECT id, text, label FROM v_samples ORDER BY id LIMIT 3")
def _(t):
    return shaping.head_n(t.samples.select("id", "text", "label"), 3, ["id"])


# scalar functions on other columns


@query("fn_cast_string", "SELECT row_id, CAST(CAST(fitspatrick AS INTEGER) AS VARCHAR) AS r FROM v_metadata")
def _(t):
    return t.metadata.select("row_id", F.col("fitspatrick").cast("int").cast("string").alias("r"))


@query("fn_size_mb", "SELECT path, round(length / 1e6, 3) AS r FROM v_sample_files")
def _(t):
    return t.sample_files.select("path", paths.size_mb(F.col("length")).alias("r"))


@query("fn_suffix", r"SELECT path, lower(regexp_extract(path, '\.[^./]+$')) AS r FROM v_sample_files")
def _(t):
    return t.sample_files.select("path", paths.suffix(F.col("path")).alias("r"))


@query("fn_basename", r"SELECT path, regexp_extract(path, '[^/]+$') AS r, regexp_replace(regexp_extract(path, '[^/]+$'), '\.[^.]+$', '') AS stem FROM v_sample_files")
def _(t):
    return t.sample_files.select(
        "path", paths.basename(F.col("path")).alias("r"), paths.stem(F.col("path")).alias("stem")
    )


@query("fn_md5", "SELECT id, md5(content) AS r FROM v_images")
def _(t):
    return t.images.select("id", F.md5("content").alias("r"))


@query("fn_errors_array", "SELECT filepath, errors, errors <> '' AS bad FROM k_files")
def _(t):
    files = image_checks.validate_image_files(t.sample_files)
    return files.select(
        "filepath", F.array_join("errors", "; ").alias("errors"), (F.size("errors") > 0).alias("bad")
    )


@query("fn_map_lookup", "SELECT REFNUM, CASE DENSITY WHEN 'A' THEN 1 WHEN 'B' THEN 2 WHEN 'C/D' THEN 3 END AS r FROM v_mias")
def _(t):
    return t.mias.select("REFNUM", codes.map_codes(F.col("DENSITY"), codes.DENSITY).alias("r"))


@query("map_codes", "SELECT REFNUM, CASE BG WHEN 'F' THEN 0 WHEN 'G' THEN 1 WHEN 'D' THEN 2 END AS r FROM v_mias")
def _(t):
    return t.mias.select("REFNUM", codes.map_codes(F.col("BG"), codes.BACKGROUND).alias("r"))


@query("fn_percent", "SELECT id, round(p0 * 100, 6) AS r, round(p0 / (p0 + p1) * 100, 1) AS share FROM v_predictions")
def _(t):
    return t.predictions.select(
        "id", F.round(F.col("p0") * 100, 6).alias("r"),
        percent(F.col("p0"), F.col("p0") + F.col("p1")).alias("share"),
    )


@query(
    "fn_to_json",
    """SELECT row_id, concat('{"region":', CASE WHEN region IS NULL THEN 'null' ELSE concat('"', region, '"') END,
  ',"gender":"', gender, '"}') AS r FROM v_metadata""",
)
def _(t):
    return t.metadata.select(
        "row_id", F.to_json(F.struct("region", "gender"), {"ignoreNullFields": "false"}).alias("r")
    )


@query(
    "fn_parse_size",
    """SELECT p_partkey, p_size AS height, p_size * 2 AS width FROM part""",
)
def _(t):
    text = F.concat_ws(",", F.col("p_size"), F.col("p_size") * 2)
    parts = t.part.select("p_partkey", F.split(text, ",").alias("s"))
    return parts.select(
        "p_partkey", F.get("s", F.lit(0)).cast("int").alias("height"), F.get("s", F.lit(1)).cast("int").alias("width")
    )


# counts

METADATA_COLUMNS = "row_id img_id diagnostic age fitspatrick diameter_1 diameter_2 region gender".split()


@query(
    "missing_counts",
    "SELECT " + " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in METADATA_COLUMNS) + " AS missing FROM v_metadata",
)
def _(t):
    return counts.missing_counts(t.metadata)


@query(
    "missing_by_column",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS missing FROM v_metadata"
        for c in METADATA_COLUMNS
    ),
)
def _(t):
    return counts.missing_by_column(t.metadata)


@query(
    "nunique_by_column",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_unique FROM v_metadata"
        for c in METADATA_COLUMNS
    ),
)
def _(t):
    return counts.nunique_by_column(t.metadata)


@query("shape_report", "SELECT count(*) AS n_rows, CAST(9 AS BIGINT) AS n_columns FROM v_metadata")
def _(t):
    return counts.shape_report(t.metadata)


@query("value_counts", 'SELECT CLASS AS "value", count(*) AS "count" FROM v_mias WHERE CLASS IS NOT NULL GROUP BY CLASS')
def _(t):
    return counts.value_counts(t.mias, "CLASS")


@query(
    "value_percent",
    """SELECT label AS "value", count(*) AS "count", round(count(*) / sum(count(*)) OVER () * 100, 1) AS "percent"
FROM v_samples WHERE label IS NOT NULL GROUP BY label""",
)
def _(t):
    return counts.value_percent(t.samples, "label")


def _balance_sql(source: str, label: str, verdict: str) -> str:
    return f"""SELECT *, CASE {verdict} ELSE 'balanced' END AS verdict
FROM (SELECT count(*) AS n_classes, max(n) AS max_count, min(n) AS min_count, max(n) / min(n) AS ratio
  FROM (SELECT {label}, count(*) AS n FROM {source} WHERE {label} IS NOT NULL GROUP BY {label}) c) s"""


@query(
    "label_balance",
    _balance_sql("v_samples", "label", "WHEN ratio > 10 THEN 'severe' WHEN ratio > 3 THEN 'moderate'"),
)
def _(t):
    return counts.label_balance(t.samples, "label")


@query("label_balance_basic", _balance_sql("labels", "quality", "WHEN ratio > 5 THEN 'imbalanced'"))
def _(t):
    return counts.label_balance(t.labels, "quality", counts.BALANCE_BASIC)


@query("crosstab_counts", 'SELECT CLASS, SEVERITY, count(*) AS "count" FROM v_mias GROUP BY CLASS, SEVERITY')
def _(t):
    return counts.crosstab_counts(t.mias, "CLASS", "SEVERITY")


@query(
    "crosstab_wide",
    """SELECT CLASS, count(*) FILTER (WHERE SEVERITY = 'Normal') AS "Normal", count(*) FILTER (WHERE SEVERITY = 'Benign') AS "Benign",
  count(*) FILTER (WHERE SEVERITY = 'Malignant') AS "Malignant" FROM v_mias GROUP BY CLASS""",
)
def _(t):
    return counts.crosstab_wide(t.mias, "CLASS", "SEVERITY", list(codes.SEVERITY))


def _histogram_sql(source: str, column: str, bins: int) -> str:
    return f"""WITH x AS (SELECT CAST({column} AS DOUBLE) AS v FROM {source}),
s AS (SELECT min(v) AS lo, max(v) AS hi FROM x),
b AS (SELECT i AS bin, lo + i * ((hi - lo) / {bins}.0::DOUBLE) AS lower, lo + (i + 1) * ((hi - lo) / {bins}.0::DOUBLE) AS upper
  FROM s, range({bins}) r(i))
SELECT bin, round(lower, 6) AS lower, round(upper, 6) AS upper,
  (SELECT count(*) FROM x WHERE v >= lower AND (v < upper OR bin = {bins - 1})) AS "count" FROM b"""


def _rounded(histogram):
    return histogram.withColumns({"lower": F.round("lower", 6), "upper": F.round("upper", 6)})


@query("histogram_bins", _histogram_sql("k_text_ml WHERE text_valid", "char_length", 30))
def _(t):
    rows = text_checks.row_checks_ml(t.samples, "text").where("text_valid")
    return _rounded(counts.histogram_bins(rows, "char_length", 30))


@query("histogram_bins_size", _histogram_sql("k_files WHERE is_valid", "size_mb", 20))
def _(t):
    files = image_checks.validate_image_files(t.sample_files)
    return _rounded(counts.histogram_bins(files.where("is_valid"), "size_mb", 20))


@query("valid_ratio", "SELECT count(*) FILTER (WHERE text_valid) AS valid, count(*) FILTER (WHERE NOT text_valid) AS invalid FROM k_text_ml")
def _(t):
    return counts.valid_ratio(text_checks.row_checks_ml(t.samples, "text"), "text_valid")


@query("class_count", "SELECT count(DISTINCT diagnostic) AS n_classes FROM v_metadata")
def _(t):
    return counts.class_count(t.metadata, "diagnostic")


@query(
    "split_sizes",
    """SELECT split, count(*) AS "count", round(count(*) / sum(count(*)) OVER () * 100, 1) AS "percent" FROM k_split_ratio GROUP BY split""",
)
def _(t):
    return counts.split_sizes(split.split_three_way_ratio(t.samples.select("id", "label"), "label", "id"))


@query(
    "split_distribution",
    """SELECT split, label, count(*) AS "count", round(count(*) / sum(count(*)) OVER (PARTITION BY split), 3) AS share
FROM k_split_ratio GROUP BY split, label""",
)
def _(t):
    parts = split.split_three_way_ratio(t.samples.select("id", "label"), "label", "id")
    return counts.split_distribution(parts, "label")


def _pairs_sql(source: str, column: str) -> str:
    return f"(SELECT string_agg(concat(k, '=', n), ';' ORDER BY k) FROM (SELECT {column} AS k, count(*) AS n FROM {source} GROUP BY {column}) g)"


@query(
    "image_report",
    f"""SELECT count(*) AS total, count(*) FILTER (WHERE img_valid) AS valid,
  round(count(*) FILTER (WHERE img_valid) / count(*) * 100, 1) AS valid_pct,
  count(*) FILTER (WHERE img_corrupt) AS corrupt, count(img_error) AS with_error,
  round(avg(img_width) FILTER (WHERE img_valid), 6) AS mean_width, round(avg(img_height) FILTER (WHERE img_valid), 6) AS mean_height,
  {_pairs_sql("k_flagged WHERE img_valid", "img_mode")} AS modes FROM k_flagged""",
)
def _(t):
    rows = image_checks.validate_image_rows(t.samples, t.sample_files, "path")
    return reports.image_report(rows).withColumns(
        {
            "mean_width": F.round("mean_width", 6),
            "mean_height": F.round("mean_height", 6),
            "modes": pairs(F.col("modes")),
        }
    )


@query(
    "image_summary",
    f"""SELECT count(*) AS total, count(*) FILTER (WHERE is_valid) AS valid, count(*) FILTER (WHERE NOT is_valid) AS invalid,
  count(*) FILTER (WHERE is_corrupt) AS corrupt, round(avg(size_mb), 3) AS avg_size_mb,
  {_pairs_sql("k_files", "format")} AS formats FROM k_files""",
)
def _(t):
    files = image_checks.validate_image_files(t.sample_files)
    return reports.image_summary(files).withColumn("formats", pairs(F.col("formats")))


RUN_SUMMARY_SQL = f"""WITH c AS (SELECT label, count(*) AS n FROM k_clean GROUP BY label),
a AS (SELECT *, sum(n) OVER () AS total, CAST(sum(n) OVER () - ceil(CAST(0.2 AS DOUBLE) * sum(n) OVER ()) AS BIGINT) AS keep1 FROM c),
s AS (SELECT max(total) AS total, max(keep1) AS keep1, max(keep1) - CAST(ceil(CAST(0.125 AS DOUBLE) * max(keep1)) AS BIGINT) AS keep2 FROM a)
SELECT (SELECT count(*) FROM k_flagged) AS total_raw, CAST(total AS BIGINT) AS total_clean,
  concat('test=', CAST(total - keep1 AS BIGINT), ';train=', CAST(keep2 AS BIGINT), ';val=', CAST(keep1 - keep2 AS BIGINT)) AS splits,
  (SELECT round(count(*) FILTER (WHERE text_valid) / count(*) * 100, 1) FROM k_flagged) AS text_valid_pct,
  (SELECT round(count(*) FILTER (WHERE img_valid) / count(*) * 100, 1) FROM k_flagged) AS img_valid_pct,
  {_pairs_sql("k_clean", "label")} AS label_distribution FROM s"""


@query("pipeline_summary", RUN_SUMMARY_SQL)
def _(t):
    run = run_quality(t.samples, image_files=t.sample_files)
    summary = run.summary.drop("generated_at")
    return summary.withColumns(
        {"splits": pairs(F.col("splits")), "label_distribution": pairs(F.col("label_distribution"))}
    )
