"""Permutation importance of table features, all features and repeats in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.functions import codes
from sievelight.functions.bijection import key_of, permute
from sievelight.operators.classify import predict_proba
from sievelight.operators.metrics import true_class
from sievelight.operators.ranking import add_rank, shuffle_key
from sievelight.session import written


def _gifts(rows: DataFrame, features: str, n_features: int, repeats: int, seed: int) -> DataFrame:
    """``_at, _slot, _value``: what a place receives, one row per (feature, repeat)."""
    import numpy as np
    import pyarrow as pa

    keys = [key_of(seed, f, r) for f in range(n_features) for r in range(1, repeats + 1)]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            at, n = batch.column("_at").to_numpy(), batch.column("_n")[0].as_py()
            lists = batch.column("_x")
            values, starts = lists.values, lists.offsets.to_numpy()[:-1]
            for slot, key in enumerate(keys):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(permute(at, n, key)),
                        pa.array(np.full(len(at), slot, np.int32)),
                        values.take(pa.array(starts + slot // repeats)),
                    ],
                    names=["_at", "_slot", "_value"],
                )

    n = rows.agg(F.count(F.lit(1))).scalar()
    narrow = rows.select("_at", n.alias("_n"), F.slice(F.col(features).cast("array<double>"), 1, n_features).alias("_x"))
    return narrow.mapInArrow(run, "_at long, _slot int, _value double")


def _placed(df: DataFrame, key: str, seed: int) -> DataFrame:
    """The rows, written, with their number ``_at`` from 0 in a pseudo-random order."""
    ordered = df.withColumn("_order", shuffle_key(key, seed)).transform(add_rank, by=[], order="_order", key=key, out="_at")
    return written(ordered.drop("_order").withColumn("_at", F.col("_at") - 1), "importance")


def _exchanged(places: DataFrame, features: str, n_features: int, repeats: int, seed: int) -> DataFrame:
    """The placed rows once per (feature, repeat) with that feature's value from another row."""
    # Both sides keep this many parts: sizes before the rows are repeated say little about the work after.
    parts = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    given = F.array_sort(F.collect_list(F.struct("_slot", "_value")))
    taken = (
        _gifts(places, features, n_features, repeats, seed)
        .repartition(parts, "_at")
        .groupBy("_at")
        .agg(F.transform(given, lambda g: g["_value"]).alias("_values"))
    )
    kept = [c for c in places.columns if c != "_at"]
    runs = places.repartition(parts, "_at").join(taken, "_at")
    runs = runs.select(*kept, F.posexplode("_values").alias("_slot", "_value"))
    feature = F.expr(f"_slot div {repeats}").cast("int").alias("feature")
    changed = F.transform(F.col(features), lambda x, i: F.when(i == F.col("feature"), F.col("_value")).otherwise(x))
    return (
        runs.select(*kept, feature, (F.col("_slot") % repeats + 1).alias("repeat"), "_value")
        .withColumn(features, changed)
        .drop("_value")
    )


def permuted(
    df: DataFrame, key: str, features: str, n_features: int, repeats: int = 5, seed: int = 42
) -> DataFrame:
    """Each row once per (feature, repeat), with that feature's value taken from another row.

    Rows are numbered once, in a pseudo-random order. A keyed bijection per (feature, repeat) says to
    which place each row gives its value, so that every permutation is an exact shuffle and none
    needs a sort or a table of its own. A place receives all its values as one array in one join; the
    row itself moves once and is repeated only where it is scored. ``features`` must hold at least
    ``n_features`` entries in every row.
    """
    return _exchanged(_placed(df, key, seed), features, n_features, repeats, seed)


def permutation_importance(
    model: PipelineModel,
    df: DataFrame,
    key: str,
    features: str,
    label: str,
    names: Sequence[str],
    repeats: int = 5,
    seed: int = 42,
) -> DataFrame:
    """``(feature, importance, std)``: mean and deviation of the accuracy lost by shuffling a feature.

    ``names`` are the first features of the array; the rest (image features) stay as they are: give
    zeros there to score the table alone. The numbered rows are written once, for all branches.
    """
    width = len(names)
    places = _placed(df.select(key, label, features), key, seed)

    def accuracy(rows: DataFrame, by: Sequence[str]) -> DataFrame:
        scored = predict_proba(model, rows, features, "_p")
        right = (codes.argmax(F.col("_p")) == true_class(rows, label)).cast("double")
        return scored.groupBy(*by).agg(F.avg(right).alias("accuracy"))

    base = accuracy(places, []).select("accuracy").scalar()
    shuffled = accuracy(_exchanged(places, features, width, repeats, seed), ["feature", "repeat"])
    lost = shuffled.withColumn("lost", base - F.col("accuracy"))
    return (
        lost.groupBy("feature")
        .agg(F.avg("lost").alias("importance"), F.stddev_pop("lost").alias("std"))
        .withColumn("feature", codes.decode(F.col("feature"), names))
        .orderBy(F.desc("importance"), "feature")
    )
