"""The built-in mammogram table used when no file is given."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

MAMMOGRAM_SCHEMA = (
    "REFNUM string, BG string, CLASS string, X double, Y double, RADIUS double, "
    "DENSITY string, `BI-RADS` string, SEVERITY string"
)
LESION_SCHEMA = (
    "img_id string, diagnostic string, age double, fitspatrick double, diameter_1 double, "
    "diameter_2 double, region string, gender string"
)
SAMPLE_SCHEMA = "id bigint, text string, label string, image_path string, image_bytes binary"

# The three sample patients.
SAMPLE_ROWS = [
    ("mdb001", "G", "NORM", None, None, None, "B", "BI-RADS 1", "Normal"),
    ("mdb002", "F", "CIRC", 540.0, 565.0, 60.0, "A", "BI-RADS 3", "Benign"),
    ("mdb003", "G", "SPIC", 470.0, 480.0, 45.0, "B", "BI-RADS 4", "Malignant"),
]


def sample_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SAMPLE_ROWS, MAMMOGRAM_SCHEMA)
