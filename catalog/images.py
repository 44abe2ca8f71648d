"""Image headers, checks, joins, pixels."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import Tables, query
from sievelight.functions import numbers
from sievelight.operators import image_checks, pixels
from sievelight.sources.images import read_image_blob


def headers(t: Tables):
    return image_checks.image_header(t.images)


def gray_files(t: Tables):
    """Each embedding as an 8 x 8 grey image file, built by Spark from the table."""
    value = lambda x: F.least(
        F.greatest(F.floor((x.cast("double") + 1) * 127.5), F.lit(0)), F.lit(255)
    ).cast("bigint")
    body = F.array_join(
        F.transform("embedding", lambda x: F.lpad(F.hex(value(x)), 2, "0")), ""
    )
    start = F.encode(F.lit("P5\n# made from a vector\n8 8\n255\n"), "US-ASCII")
    return t.embeddings.select("vec_id", F.concat(start, F.unhex(body)).alias("content"))


@query("image_header", "SELECT id, width, height, mode FROM k_image_headers")
def _(t):
    return headers(t).select("id", "width", "height", "mode")


@query("image_corrupt", "SELECT id, is_corrupt FROM k_image_headers")
def _(t):
    return headers(t).select("id", "is_corrupt")


FILE_COLUMNS = "filepath filename format size_mb width height mode is_corrupt errors is_valid".split()


@query("validate_image_files", f"SELECT {', '.join(FILE_COLUMNS)} FROM k_files")
def _(t):
    files = image_checks.validate_image_files(t.sample_files)
    return files.withColumn("errors", F.array_join("errors", "; "))


@query("image_valid_files", "SELECT filepath, is_valid FROM k_files")
def _(t):
    files = image_checks.validate_image_files(t.sample_files)
    return files.select("filepath", "is_valid")


ROW_SQL = "SELECT id, img_width, img_height, img_mode, img_corrupt, img_error, img_valid FROM k_flagged"


def checked_rows(t: Tables):
    return image_checks.validate_image_rows(t.samples, t.sample_files, "path")


@query("validate_image_rows", ROW_SQL)
def _(t):
    return checked_rows(t).select("id", *image_checks.ROW_COLUMNS)


@query("image_valid_rows", "SELECT id, img_valid FROM k_flagged")
def _(t):
    return checked_rows(t).select("id", "img_valid")


@query("attach_validation", "SELECT id, label, source, img_error, img_valid FROM k_flagged")
def _(t):
    return checked_rows(t).select("id", "label", "source", "img_error", "img_valid")


@query(
    "image_duplicates_md5",
    """SELECT md5(content) AS md5, count(*) AS copies, count(*) - 1 AS surplus FROM v_images
WHERE content IS NOT NULL GROUP BY md5(content) HAVING count(*) > 1""",
)
def _(t):
    return image_checks.image_duplicates(t.images)


@query(
    "image_duplicate_totals",
    """SELECT count(*) AS "groups", CAST(sum(c - 1) AS BIGINT) AS surplus_files FROM
  (SELECT md5(content), count(*) AS c FROM v_images WHERE content IS NOT NULL GROUP BY md5(content) HAVING count(*) > 1) g""",
)
def _(t):
    return image_checks.image_duplicate_totals(t.images)


@query(
    "join_images_inner",
    "SELECT m.row_id, m.img_id, h.width, h.height FROM v_metadata m JOIN k_image_headers h ON m.img_id = h.img_key",
)
def _(t):
    narrow = headers(t).select(F.col("img_key").alias("img_id"), "width", "height")
    return image_checks.join_images_inner(t.metadata.select("row_id", "img_id"), narrow, "img_id")


@query(
    "skip_missing_images",
    """SELECT m.row_id, m.img_id, m.diagnostic FROM v_metadata m JOIN k_image_headers h ON m.img_id = h.img_key
WHERE NOT h.is_corrupt""",
)
def _(t):
    readable = headers(t).where("NOT is_corrupt").select(F.col("img_key").alias("img_id"))
    return image_checks.join_images_inner(
        t.metadata.select("row_id", "img_id", "diagnostic"), readable, "img_id"
    )


@query(
    "join_images_left_default",
    """SELECT p_partkey, CASE WHEN vec_id IS NULL THEN 0.0 ELSE round(s, 2) END AS pixel_sum FROM part
LEFT JOIN (SELECT vec_id, sum(v) AS s FROM k_gray GROUP BY vec_id) g ON p_partkey = vec_id""",
)
def _(t):
    images = pixels.load_image_gray(gray_files(t), "vec_id", size=(8, 8)).select(
        F.col("vec_id").alias("p_partkey"), "image"
    )
    joined = image_checks.join_images_left_default(
        t.part.select("p_partkey"), images, "p_partkey", "image", 64
    )
    total = F.aggregate("image", F.lit(0.0), lambda a, v: a + v.cast("double"))
    return joined.select("p_partkey", F.round(total, 2).alias("pixel_sum"))


@query(
    "missing_images",
    """SELECT row_id, img_id, CASE WHEN img_id IS NULL THEN 'Không có ảnh' ELSE 'File không tồn tại' END AS img_error
FROM v_metadata m WHERE NOT EXISTS (SELECT 1 FROM v_images i WHERE i.img_key = m.img_id)""",
)
def _(t):
    images = t.images.select(F.col("img_key").alias("img_id"))
    return image_checks.missing_images(t.metadata.select("row_id", "img_id"), images, "img_id")


@query(
    "read_image_blob",
    """SELECT row_id, hex(CASE WHEN row_id % 4 = 0 THEN unhex(lpad(hex(row_id), 16, '0')) ELSE content END) AS bytes
FROM v_metadata LEFT JOIN v_images ON img_id = img_key""",
)
def _(t):
    blob = F.when(F.col("row_id") % 4 == 0, F.unhex(F.lpad(F.hex("row_id"), 16, "0")))
    rows = t.metadata.select("row_id", "img_id", blob.alias("blob"))
    files = t.images.select(F.col("img_key").alias("path"), "content")
    joined = read_image_blob(rows, files, "blob", "img_id")
    return joined.select("row_id", F.hex("image_bytes").alias("bytes"))


@query("load_image_gray", "SELECT vec_id, pos, round(CAST(CAST(v AS FLOAT) AS DOUBLE), 5) AS v FROM k_gray")
def _(t):
    images = pixels.load_image_gray(gray_files(t), "vec_id", size=(8, 8))
    return images.select("vec_id", F.posexplode("image").alias("pos", "v")).select(
        "vec_id", F.col("pos").cast("bigint").alias("pos"), F.round(F.col("v").cast("double"), 5).alias("v")
    )


@query(
    "image_features",
    """SELECT vec_id, CAST(0 AS BIGINT) AS pos, round(CAST(CAST(avg(v) AS FLOAT) AS DOUBLE), 5) AS v FROM k_gray GROUP BY vec_id
UNION ALL SELECT vec_id, 1, round(CAST(CAST(stddev_pop(v) AS FLOAT) AS DOUBLE), 5) FROM k_gray GROUP BY vec_id
UNION ALL SELECT vec_id, 2 + cell, round(CAST(CAST(avg(v) AS FLOAT) AS DOUBLE), 5)
FROM (SELECT vec_id, (pos // 16) * 4 + (pos % 8) // 2 AS cell, v FROM k_gray) c GROUP BY vec_id, cell""",
)
def _(t):
    images = pixels.load_image_gray(gray_files(t), "vec_id", size=(8, 8), features=True)
    return images.select("vec_id", F.posexplode("image_features").alias("pos", "v")).select(
        "vec_id", F.col("pos").cast("bigint").alias("pos"), F.round(F.col("v").cast("double"), 5).alias("v")
    )


@query(
    "gray_to_rgb",
    "SELECT vec_id, pos * 3 + c AS pos, round(CAST(CAST(v AS FLOAT) AS DOUBLE), 5) AS v FROM k_gray, range(3) r(c)",
)
def _(t):
    images = pixels.load_image_gray(gray_files(t), "vec_id", size=(8, 8))
    rgb = images.select("vec_id", F.posexplode(numbers.gray_to_rgb(F.col("image"))).alias("pos", "v"))
    return rgb.select(
        "vec_id", F.col("pos").cast("bigint").alias("pos"), F.round(F.col("v").cast("double"), 5).alias("v")
    )


@query(
    "fn_scale_minmax255",
    "SELECT vec_id, round(sum(v), 5) AS s FROM k_gray GROUP BY vec_id",
)
def _(t):
    raw = F.transform(
        "embedding",
        lambda x: F.least(F.greatest(F.floor((x.cast("double") + 1) * 127.5), F.lit(0)), F.lit(255)),
    )
    scaled = t.embeddings.select("vec_id", numbers.scale_255(raw).alias("p"))
    total = F.aggregate("p", F.lit(0.0), lambda a, v: a + v)
    return scaled.select("vec_id", F.round(total, 5).alias("s"))


