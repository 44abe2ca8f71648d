"""Imputation, encoding, scaling, ordering and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query
from sievelight.functions import codes
from sievelight.operators import encode, impute, ranking, split

LESION = list(encode.LESION_FEATURES)


def rounded(df, columns):
    return df.withColumns({c: F.round(F.col(c), 6) for c in columns})


@query(
    "impute_median",
    "SELECT row_id, round(age, 6) AS age, round(diameter_1, 6) AS diameter_1 FROM k_metadata_filled",
)
def _(t):
    filled = impute.impute_median(t.metadata, ["age", "diameter_1"])
    return rounded(filled.select("row_id", "age", "diameter_1"), ["age", "diameter_1"])


def _mode_sql(column: str) -> str:
    return f"(SELECT {column} FROM v_metadata WHERE {column} IS NOT NULL GROUP BY {column} ORDER BY count(*) DESC, {column} LIMIT 1)"


@query(
    "impute_mode",
    f"SELECT row_id, coalesce(diagnostic, {_mode_sql('diagnostic')}) AS diagnostic, coalesce(region, {_mode_sql('region')}) AS region FROM v_metadata",
)
def _(t):
    return impute.impute_mode(t.metadata, ["diagnostic", "region"]).select(
        "row_id", "diagnostic", "region"
    )


@query("impute_constant", "SELECT REFNUM, coalesce(X, -1) AS X, coalesce(Y, -1) AS Y, coalesce(RADIUS, -1) AS RADIUS FROM v_mias")
def _(t):
    return impute.impute_constant(t.mias).select("REFNUM", "X", "Y", "RADIUS")


@query(
    "preprocess_metadata",
    f"""SELECT CAST(row_id AS DOUBLE) AS row_id, coalesce(img_id, {_mode_sql('img_id')}) AS img_id,
  coalesce(diagnostic, {_mode_sql('diagnostic')}) AS diagnostic, round(age, 6) AS age, fitspatrick,
  round(diameter_1, 6) AS diameter_1, round(diameter_2, 6) AS diameter_2,
  coalesce(region, {_mode_sql('region')}) AS region, gender FROM k_metadata_filled""",
)
def _(t):
    filled, _report = impute.preprocess_metadata(t.metadata)
    return rounded(filled, ["age", "diameter_1", "diameter_2"])


@query(
    "preprocess_report",
    """SELECT count(*) AS initial_rows, CAST(9 AS BIGINT) AS initial_columns,
  9 * count(*) - count(row_id) - count(img_id) - count(diagnostic) - count(age) - count(fitspatrick) - count(diameter_1)
    - count(diameter_2) - count(region) - count(gender) AS missing_before,
  CAST(0 AS BIGINT) AS missing_after, count(*) AS final_rows, CAST(9 AS BIGINT) AS final_columns FROM v_metadata""",
)
def _(t):
    _filled, report = impute.preprocess_metadata(t.metadata)
    return report


LABEL_SQL = """SELECT row_id, diagnostic, CASE WHEN diagnostic IS NOT NULL THEN
  (SELECT CAST(count(*) AS INTEGER) FROM (SELECT DISTINCT diagnostic AS d FROM v_metadata) c WHERE c.d < m.diagnostic) END AS y
FROM v_metadata m"""


@query("label_encode", LABEL_SQL)
def _(t):
    return encode.label_encode(t.metadata, "diagnostic", "y").select("row_id", "diagnostic", "y")


@query("label_encode_transform", LABEL_SQL)
def _(t):
    classes = encode.fit_classes(t.metadata, "diagnostic")
    coded = encode.label_encode(t.metadata, "diagnostic", "y", classes)
    return coded.select("row_id", "diagnostic", "y")


@query("label_decode", "SELECT REFNUM, SEVERITY AS name FROM v_mias")
def _(t):
    coded = encode.encode_mias(t.mias, "BIRADS")
    return encode.label_decode(coded, "SEVERITY_NUM", list(codes.SEVERITY), "name").select(
        "REFNUM", "name"
    )


MIAS_COLUMNS = "REFNUM BG X Y RADIUS CLASS_NUM SEVERITY_NUM DENSITY_NUM BIRADS_NUM".split()


@query("encode_mias", f"SELECT {', '.join(MIAS_COLUMNS)} FROM k_mias")
def _(t):
    return encode.encode_mias(t.mias, "BIRADS").select(*MIAS_COLUMNS)


@query(
    "one_hot",
    "SELECT REFNUM, " + ", ".join(f"CASE WHEN SEVERITY_NUM = {i} THEN 1.0 ELSE 0.0 END::DOUBLE AS h{i}" for i in range(3)) + " FROM k_mias",
)
def _(t):
    hot = encode.one_hot(encode.encode_mias(t.mias, "BIRADS"), "SEVERITY_NUM", "hot")
    return hot.select("REFNUM", *[F.get("hot", F.lit(i)).alias(f"h{i}") for i in range(3)])


def scaled_sql(columns, source, key="row_id", kind="DOUBLE") -> str:
    parts = ", ".join(
        f"round((CAST({c} AS {kind})::DOUBLE - avg(CAST({c} AS {kind})::DOUBLE) OVER ()) / "
        f"(CASE WHEN stddev_pop(CAST({c} AS {kind})::DOUBLE) OVER () = 0 THEN 1 ELSE stddev_pop(CAST({c} AS {kind})::DOUBLE) OVER () END), 6) AS {c}"
        for c in columns
    )
    return f"SELECT {key}, {parts} FROM {source}"


@query("standard_scale_fit", scaled_sql(LESION, "k_metadata_filled"))
def _(t):
    filled = impute.impute_median(t.metadata, LESION)
    scaled = encode.scale(filled, encode.fit_scaler(filled, LESION))
    return rounded(scaled.select("row_id", *LESION), LESION)


BY_GENDER = ", ".join(
    f"round((r.{c} - s.m{i}) / s.s{i}, 6) AS {c}" for i, c in enumerate(LESION)
)
GENDER_STATS = ", ".join(f"avg({c}) AS m{i}, stddev_pop({c}) AS s{i}" for i, c in enumerate(LESION))


@query(
    "standard_scale_transform",
    f"SELECT row_id, {BY_GENDER} FROM k_metadata_filled r, (SELECT {GENDER_STATS} FROM k_metadata_filled WHERE gender = 'MALE') s",
)
def _(t):
    filled = impute.impute_median(t.metadata, LESION)
    scaler = encode.fit_scaler(filled.where("gender = 'MALE'"), LESION)
    return rounded(encode.scale(filled, scaler).select("row_id", *LESION), LESION)


@query("broadcast_stats", scaled_sql(["X", "Y", "RADIUS"], "k_mias", "REFNUM"))
def _(t):
    coded = encode.encode_mias(t.mias, "BIRADS")
    columns = ["X", "Y", "RADIUS"]
    scaled = encode.scale(coded, encode.fit_scaler(coded, columns))
    return rounded(scaled.select("REFNUM", *columns), columns)


@query(
    "encode_tabular",
    f"""SELECT s.*, l.y FROM ({scaled_sql(LESION, 'k_metadata_filled', kind='FLOAT')}) s
JOIN ({LABEL_SQL}) l ON s.row_id = l.row_id""",
)
def _(t):
    filled = impute.impute_median(t.metadata, LESION)
    coded, _scaler, _classes = encode.encode_tabular(filled, "diagnostic")
    return coded.select(
        "row_id", *[F.round(F.get("features", F.lit(i)), 6).alias(c) for i, c in enumerate(LESION)], "y"
    )


@query("stratified_order", "SELECT id, label, position FROM k_order")
def _(t):
    return ranking.stratified_order(t.samples.select("id", "label"), "label", "id")


@query(
    "split_two_way",
    "SELECT id, o.label, CASE WHEN position <= q1 THEN 'train' ELSE 'test' END AS split FROM k_order o JOIN k_quota_1 q ON o.label = q.label",
)
def _(t):
    return split.split_two_way(t.samples.select("id", "label"), "label", "id")


@query(
    "split_three_way",
    """SELECT id, o.label, CASE WHEN position <= q2 THEN 'train' WHEN position <= q1 THEN 'val' ELSE 'test' END AS split
FROM k_order o JOIN k_quota_2 q ON o.label = q.label""",
)
def _(t):
    return split.split_three_way(t.samples.select("id", "label"), "label", "id")


@query("split_three_way_ratio", "SELECT id, label, split FROM k_split_ratio")
def _(t):
    return split.split_three_way_ratio(t.samples.select("id", "label"), "label", "id")
