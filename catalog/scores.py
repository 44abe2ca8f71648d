"""Metrics, training, scoring, importance."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.features import LABEL_SQL, LESION, scaled_sql
from catalog.images import gray_files
from catalog.registry import Tables, query
from sievelight.functions import bijection, codes
from sievelight.operators import classify, importance, metrics, pixels, split
from sievelight.plans import lesion, mammogram


def predictions(t: Tables):
    return t.predictions.select("id", "y_true", F.array("p0", "p1", "p2").alias("p"))


def predicted(t: Tables):
    return metrics.argmax_class(predictions(t), "p")


@query("argmax_class", "SELECT id, y_pred FROM k_pred")
def _(t):
    return predicted(t).select("id", "y_pred")


@query(
    "evaluate_loss_accuracy",
    """SELECT round(avg(-ln(least(greatest(CASE y_true WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END, 1e-7), 1 - 1e-7))), 6) AS loss,
  round(avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM k_pred""",
)
def _(t):
    scores = metrics.evaluate_loss_accuracy(predictions(t), "y_true", "p")
    return scores.select(F.round("loss", 6).alias("loss"), F.round("accuracy", 6).alias("accuracy"))


@query("accuracy_score", "SELECT round(avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM k_pred")
def _(t):
    hot = predicted(t).withColumn("y_hot", codes.one_hot(F.col("y_true"), 3))
    scores = metrics.accuracy_score(hot, "y_hot", "y_pred")
    return scores.select(F.round("accuracy", 6).alias("accuracy"))


CLASS_SQL = """SELECT c AS cls, coalesce(hit / nullif(guessed, 0), 0.0) AS prec, coalesce(hit / nullif(support, 0), 0.0) AS rec,
  coalesce(2.0 * hit / nullif(support + guessed, 0), 0.0) AS f, support, hit
FROM (SELECT c, coalesce(sum(n) FILTER (WHERE y_true = c AND y_pred = c), 0) AS hit,
    coalesce(sum(n) FILTER (WHERE y_pred = c), 0) AS guessed, coalesce(sum(n) FILTER (WHERE y_true = c), 0) AS support
  FROM k_pairs, range(3) r(c) GROUP BY c) s"""


@query(
    "classification_report",
    f"""WITH s AS ({CLASS_SQL})
SELECT CASE cls WHEN 0 THEN 'Normal' WHEN 1 THEN 'Benign' ELSE 'Malignant' END AS class, round(prec, 6) AS precision,
  round(rec, 6) AS recall, round(f, 6) AS f1, CAST(support AS BIGINT) AS support FROM s
UNION ALL SELECT 'accuracy', round(sum(hit) / sum(support), 6), round(sum(hit) / sum(support), 6), round(sum(hit) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM s
UNION ALL SELECT 'macro avg', round(avg(prec), 6), round(avg(rec), 6), round(avg(f), 6), CAST(sum(support) AS BIGINT) FROM s
UNION ALL SELECT 'weighted avg', round(sum(prec * support) / sum(support), 6), round(sum(rec * support) / sum(support), 6),
  round(sum(f * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM s""",
)
def _(t):
    report = metrics.classification_report(predicted(t), "y_true", "y_pred", mammogram.DIAGNOSES)
    return report.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query(
    "confusion_matrix",
    """SELECT CAST(a AS INTEGER) AS y_true, CAST(b AS INTEGER) AS y_pred,
  (SELECT count(*) FROM k_pred WHERE y_true = a AND y_pred = b) AS n FROM range(3) x(a), range(3) y(b)""",
)
def _(t):
    return metrics.confusion_matrix(predicted(t), "y_true", "y_pred", 3)


@query(
    "roc_curve",
    """SELECT class, round(score, 6) AS threshold, round(fp / n, 6) AS fpr, round(tp / p, 6) AS tpr FROM k_curve
UNION ALL SELECT DISTINCT class, 'Infinity'::DOUBLE, 0.0, 0.0 FROM k_curve""",
)
def _(t):
    curve = metrics.roc_curve(predictions(t), "y_true", "p")
    threshold = F.when(F.col("threshold") == float("inf"), F.col("threshold")).otherwise(
        F.round("threshold", 6)
    )
    return curve.select(
        "class", threshold.alias("threshold"), F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr")
    )


@query(
    "roc_auc",
    """SELECT class, round(sum((fp - prev_fp) / n * (tp + prev_tp) / p / 2), 6) AS auc
FROM (SELECT *, lag(tp, 1, 0) OVER (PARTITION BY class ORDER BY score DESC) AS prev_tp,
    lag(fp, 1, 0) OVER (PARTITION BY class ORDER BY score DESC) AS prev_fp FROM k_curve) c GROUP BY class""",
)
def _(t):
    area = metrics.roc_auc(predictions(t), "y_true", "p")
    return area.select("class", F.round("auc", 6).alias("auc"))


@query(
    "predict_diagnosis",
    """SELECT id, CASE y_pred WHEN 0 THEN 'Normal' WHEN 1 THEN 'Benign' ELSE 'Malignant' END AS diagnosis,
  round(greatest(p0, p1, p2) * 100, 6) AS confidence, round(p0 * 100, 6) AS normal, round(p1 * 100, 6) AS benign,
  round(p2 * 100, 6) AS malignant FROM k_pred""",
)
def _(t):
    told = metrics.predict_diagnosis(predictions(t), "p", mammogram.DIAGNOSES)
    shares = F.col("class_probabilities")
    return told.select(
        "id", "diagnosis", F.round("confidence", 6).alias("confidence"),
        *[F.round(F.try_element_at(shares, F.lit(n)), 6).alias(n.lower()) for n in mammogram.DIAGNOSES],
    )


@query(
    "fuse_features",
    """SELECT row_id, CASE WHEN i < 2 THEN CASE i WHEN 0 THEN fitspatrick ELSE round(diameter_2, 6) END ELSE round(embedding[i - 1]::DOUBLE, 6) END AS v, i AS pos
FROM v_metadata JOIN embeddings ON row_id = vec_id, range(66) r(i)""",
)
def _(t):
    rows = t.metadata.join(t.embeddings, F.col("row_id") == F.col("vec_id")).withColumn(
        "features", F.array("fitspatrick", "diameter_2")
    )
    fused = classify.fuse_features(rows, ["features", "embedding"])
    return fused.select("row_id", F.posexplode("fused").alias("pos", "v")).select(
        "row_id", F.col("pos").cast("bigint").alias("pos"), F.round("v", 6).alias("v")
    )


# training: checked by properties, not by SQL


def labelled_vectors(t: Tables):
    return split.split_three_way(
        t.embeddings.select("vec_id", "embedding", "label").where("label IS NOT NULL"), "label", "vec_id"
    )


def part(df, name):
    return df.where(F.col("split") == name)


@query("train_vectors")
def _(t):
    rows = labelled_vectors(t)
    model = classify.train_classifier(part(rows, "train"), "embedding", "label", 10)
    scored = classify.predict_proba(model, part(rows, "test"), "embedding")
    return metrics.argmax_class(scored, "probabilities").select("vec_id", "label", "y_pred")


@query("predict_vectors")
def _(t):
    rows = labelled_vectors(t)
    model = classify.train_classifier(part(rows, "train"), "embedding", "label", 10, linear=True)
    scored = classify.predict_proba(model, part(rows, "test"), "embedding")
    total = F.aggregate("probabilities", F.lit(0.0), lambda a, v: a + v)
    return scored.select("vec_id", F.round(total, 6).alias("total"), F.array_max("probabilities").alias("best"))


@query("select_vectors")
def _(t):
    rows = labelled_vectors(t)
    model, _tried = classify.select_model(
        part(rows, "train"), part(rows, "val"), "embedding", "label", 10,
        grid=({"epochs": 10}, {"epochs": 20, "linear": True}),
    )
    return classify.evaluate_model(model, part(rows, "test"), "embedding", "label")


@query("mammogram_importance")
def _(t):
    return mammogram.run_mammogram(t.mias, birads="BIRADS").importance()


# training where the class follows from one feature, so that the right answers are known


def ruled(t: Tables):
    rows = t.ruled.select("id", "y", F.array("a", "b", "c").alias("x"))
    return rows.where("id % 5 <> 0"), rows.where("id % 5 = 0")


@query("train_classifier", "SELECT id, y, y AS y_pred FROM v_ruled WHERE id % 5 = 0")
def _(t):
    train, test = ruled(t)
    model = classify.train_classifier(train, "x", "y", 3, hidden=(8,), epochs=60)
    scored = classify.predict_proba(model, test, "x")
    return metrics.argmax_class(scored, "probabilities").select("id", "y", "y_pred")


@query("predict_proba", "SELECT id, 1.0::DOUBLE AS total, y AS likely FROM v_ruled WHERE id % 5 = 0")
def _(t):
    train, test = ruled(t)
    model = classify.train_classifier(train, "x", "y", 3, epochs=60, linear=True)
    scored = classify.predict_proba(model, test, "x")
    total = F.aggregate("probabilities", F.lit(0.0), lambda a, v: a + v)
    likely = F.array_position(F.transform("probabilities", lambda p: p > 0.5), F.lit(True)) - 1
    return scored.select("id", F.round(total, 6).alias("total"), likely.cast("int").alias("likely"))


@query("select_model", "SELECT true AS low_loss, 1.0::DOUBLE AS accuracy, 3::INTEGER AS tried, true AS best_is_kept")
def _(t):
    train, test = ruled(t)
    model, tried = classify.select_model(
        train, test, "x", "y", 3, grid=({"epochs": 1}, {"epochs": 60, "linear": True}, {"epochs": 60, "hidden": (8,)})
    )
    kept = F.abs(F.col("loss") - min(x["loss"] for x in tried)) < 1e-9
    return classify.evaluate_model(model, test, "x", "y").select(
        (F.col("loss") < 0.1).alias("low_loss"), "accuracy", F.lit(len(tried)).alias("tried"), kept.alias("best_is_kept")
    )


GIFTS = ", ".join(
    f"({f}, {r}, {bijection.key_of(42, f, r)}::BIGINT)" for f in range(3) for r in range(1, 6)
)


@query(
    "permutation_importance",
    f"""SELECT CASE f WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS feature,
  round(avg(1 - accuracy), 6) AS importance, round(stddev_pop(1 - accuracy), 6) AS std
FROM (SELECT f, r, avg(CASE WHEN CASE f WHEN 0 THEN giver.y ELSE taker.y END = taker.y THEN 1.0 ELSE 0.0 END) AS accuracy
  FROM (SELECT *, {bijection.permute_sql("place", "n", "key")} AS target
    FROM k_ruled_places, (VALUES {GIFTS}) AS gifts(f, r, key)) giver
  JOIN k_ruled_places taker ON taker.place = giver.target GROUP BY f, r) scored GROUP BY f""",
)
def _(t):
    train, test = ruled(t)
    model = classify.train_classifier(train, "x", "y", 3, epochs=60, linear=True)
    ranked = importance.permutation_importance(model, test, "id", "x", "y", ["a", "b", "c"])
    return ranked.select("feature", F.round("importance", 6).alias("importance"), F.round("std", 6).alias("std"))


@query(
    "mammogram_report",
    """WITH tests AS (SELECT class, n - q AS support FROM (
  SELECT class, n, base + CASE WHEN row_number() OVER (ORDER BY round(rest, 9) DESC, class) <= keep - sum(base) OVER () THEN 1 ELSE 0 END AS q
  FROM (SELECT *, CAST(floor(n * keep / total) AS BIGINT) AS base, n * keep / total - floor(n * keep / total) AS rest
    FROM (SELECT *, sum(n) OVER () AS total, CAST(sum(n) OVER () - ceil(CAST(0.2 AS DOUBLE) * sum(n) OVER ()) AS DOUBLE) AS keep
      FROM (SELECT SEVERITY_NUM AS class, count(*) AS n FROM k_mias GROUP BY SEVERITY_NUM) a) b) c) d)
SELECT CASE class WHEN 0 THEN 'Normal' WHEN 1 THEN 'Benign' ELSE 'Malignant' END AS class, CAST(support AS BIGINT) AS support, true AS learned FROM tests
UNION ALL SELECT name, CAST((SELECT sum(support) FROM tests) AS BIGINT), true
FROM (VALUES ('accuracy'), ('macro avg'), ('weighted avg')) v(name)""",
)
def _(t):
    report = mammogram.run_mammogram(t.mias, birads="BIRADS").class_report()
    return report.select("class", "support", (F.least("precision", "recall", "f1") > 0.95).alias("learned"))


@query(
    "prepare_multimodal",
    f"""SELECT s.*, l.y, m.img_id, CAST(22 AS INTEGER) AS width
FROM ({scaled_sql(LESION, 'k_metadata_filled', kind='FLOAT')}) s JOIN ({LABEL_SQL}) l ON s.row_id = l.row_id
JOIN v_metadata m ON s.row_id = m.row_id JOIN embeddings e ON m.img_id = concat('img_', e.vec_id, '.png')""",
)
def _(t):
    images = pixels.load_image_gray(gray_files(t), "vec_id", size=(8, 8), features=True).select(
        F.concat(F.lit("img_"), F.col("vec_id"), F.lit(".png")).alias("img_id"), "image_features"
    )
    ready = lesion.prepare_multimodal(t.metadata, images)
    return classify.fuse_features(ready, ["features", "image_features"]).select(
        "row_id", *[F.round(F.get("features", F.lit(i)), 6).alias(c) for i, c in enumerate(LESION)],
        "y", "img_id", F.size("fused").alias("width"),
    )
