"""Language identification: averaged hashed subword embeddings and a linear softmax, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelight.llm.common import small_batches
from sievelight.llm.tokens import release, text_slices

BUCKETS = 1 << 15
GRAMS = (2, 3, 4)
# Letters in lower case, bytes of other letters as they are, anything else as a blank.
FOLD = np.full(256, 32, np.uint8)
FOLD[128:] = np.arange(128, 256)
for _low, _high in zip(range(97, 123), range(65, 91)):
    FOLD[[_low, _high]] = _low
UNKNOWN = "und"


@dataclass(frozen=True)
class Model:
    """``table`` holds, per bucket, the embedding times the softmax weights: a text's logits are their mean."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    least: float  # a text with a lower score is rejected


def grams(data: np.ndarray, cuts: np.ndarray):
    """Bucket numbers of all byte n-grams, one array per n; ``BUCKETS`` where a text has ended."""
    folded = FOLD[data].astype(np.uint32)
    for n in GRAMS:
        value = np.full(len(data), n, np.uint32)
        for k in range(n):
            value[: len(data) - k] = value[: len(data) - k] * np.uint32(0x01000193) + folded[k:]
        value ^= value >> np.uint32(15)
        bucket = ((value * np.uint32(0x9E3779B1)) >> np.uint32(17)).astype(np.int32)
        for k in range(1, n):
            ends = cuts[1:] - k
            bucket[ends[ends >= cuts[:-1]]] = BUCKETS
        yield bucket


def mean_logits(model: Model, data: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Logits of each text; zero for an empty one."""
    sums = np.zeros((len(cuts) - 1, len(model.languages)))
    number = np.zeros(len(cuts) - 1)
    full = np.flatnonzero(np.diff(cuts))
    if not len(full):
        return sums
    table = np.concatenate((model.table, np.zeros((1, len(model.languages)), np.float32)))
    for bucket in grams(data, cuts):
        for k in range(len(model.languages)):
            sums[full, k] += np.add.reduceat(table[bucket, k], cuts[full], dtype=np.float64)
        number[full] += np.add.reduceat(bucket < BUCKETS, cuts[full], dtype=np.float64)
    return (sums + model.bias * np.maximum(number, 1)[:, None]) / np.maximum(number, 1)[:, None]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[str], size: int, rounds: int, seed: int, miss: float) -> Model:
    """Fit by stochastic gradient descent; every fifth row only calibrates.

    ``rows`` are (buckets, counts) per text. The temperature minimises the log loss of the calibration
    rows. ``least`` is the score below which at most ``miss`` of the rightly labelled calibration rows
    lie.
    """
    languages = sorted(set(labels))
    y = np.array([languages.index(x) for x in labels])
    rng = np.random.default_rng(seed)
    embed = rng.uniform(-1 / size, 1 / size, (BUCKETS, size)).astype(np.float32)
    weight = rng.normal(0, 0.1, (size, len(languages))).astype(np.float32)
    bias = np.zeros(len(languages), np.float32)
    held = np.arange(len(rows)) % 5 == 4 if len(rows) >= 50 else np.zeros(len(rows), bool)
    fit = np.flatnonzero(~held)

    def dense(at: np.ndarray) -> np.ndarray:
        x = np.zeros((len(at), BUCKETS), np.float32)
        for i, r in enumerate(at):
            buckets, counts = rows[r]
            x[i, buckets] = counts / counts.sum()
        return x

    share = np.bincount(y[fit], minlength=len(languages)) / len(fit)
    balance = 1 / (len(languages) * np.maximum(share, 1e-9))
    steps = rounds * -(-len(fit) // 32)
    step = 0
    for _ in range(rounds):
        order = rng.permutation(fit)
        for i in range(0, len(order), 32):
            at = order[i : i + 32]
            x = dense(at)
            hidden = x @ embed
            error = _softmax(hidden @ weight + bias)
            error[np.arange(len(at)), y[at]] -= 1
            error *= (balance[y[at]] / len(at))[:, None]
            error = error.astype(np.float32)
            rate = 1 - step / steps
            back = error @ weight.T
            weight -= 2 * rate * hidden.T @ error
            bias -= 0.1 * rate * error.sum(axis=0)
            touched = np.flatnonzero(x.any(axis=0))
            embed[touched] -= 60 * rate * x[:, touched].T @ back
            step += 1
    model = Model(languages, embed @ weight, bias, 1.0, 0.0)
    check = np.flatnonzero(held)
    if not len(check):
        return model
    logits = np.array([(model.table[b] * (c / c.sum())[:, None]).sum(axis=0) + bias for b, c in (rows[r] for r in check)])
    choices = np.exp(np.linspace(-4, 2, 61))
    right = [_softmax(logits / t)[np.arange(len(check)), y[check]] for t in choices]
    temperature = float(choices[np.argmin([-np.log(np.maximum(p, 1e-12)).mean() for p in right])])
    scores = _softmax(logits / temperature)
    good = scores.max(axis=1)[scores.argmax(axis=1) == y[check]]
    least = float(np.quantile(good, miss, method="lower")) if len(good) else 0.0
    return Model(languages, model.table, bias, temperature, least)


def remainder(key: Column) -> Column:
    """The fold of a document: crc32 of its key as text, modulo 5. A null key is in fold 0."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5, F.lit(0)).cast("int")


def fit(
    docs: DataFrame,
    per_language: int = 1000,
    most_languages: int = 200,
    size: int = 16,
    rounds: int = 8,
    seed: int = 0,
    miss: float = 0.001,
) -> Model | None:
    """Fit on labelled ``doc_id, text, lang`` outside fold 0; None without any.

    Bounds of the sample: about ``per_language`` texts of each of the ``most_languages`` most frequent
    languages, chosen by a hash of the key; a text arrives as at most ``BUCKETS`` counts. The counts of
    languages cover all rows. The sample meets in one task; only the model goes to the driver.
    """
    labelled = small_batches(docs).select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    labelled = labelled.filter(F.col("lang").isNotNull() & (remainder(F.col("doc_id")) != 0) & _has_letter())
    totals = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages).collect()
    if not totals:
        return None
    rates = F.create_map(*(x for r in totals for x in (F.lit(r["lang"]), F.lit(per_language / r["count"]))))
    chance = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    sample = labelled.withColumn("_chance", chance).filter(F.col("_chance") < F.coalesce(rates[F.col("lang")], F.lit(0.0)))

    def count(batches):
        release()
        for batch in batches:
            for i, j, data, cuts in text_slices(batch.column("text")):
                per_gram = list(grams(data, cuts))
                buckets, counts = [], []
                for a, b in zip(cuts[:-1], cuts[1:]):
                    at, n = np.unique(np.concatenate([g[a:b] for g in per_gram]), return_counts=True)
                    buckets.append(at[at < BUCKETS].astype(np.uint16).tobytes())
                    counts.append(n[at < BUCKETS].astype(np.uint32).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("_chance").slice(i, j - i),
                        batch.column("lang").slice(i, j - i),
                        pa.array(buckets, pa.binary()),
                        pa.array(counts, pa.binary()),
                    ],
                    names=["chance", "lang", "buckets", "counts"],
                )

    got = sample.select("_chance", "lang", "text").mapInArrow(
        count, "chance double, lang string, buckets binary, counts binary"
    )

    def learn(batches):
        got = sorted(
            (r["chance"], r["lang"], r["buckets"], r["counts"]) for batch in batches for r in batch.to_pylist() if r["buckets"]
        )
        if got:
            rows = [(np.frombuffer(b, np.uint16), np.frombuffer(n, np.uint32)) for _, _, b, n in got]
            model = train(rows, [r[1] for r in got], size, rounds, seed, miss)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([model.languages], pa.list_(pa.string())),
                    pa.array([model.table.tobytes()], pa.binary()),
                    pa.array([model.bias.tobytes()], pa.binary()),
                    pa.array([model.temperature], pa.float64()),
                    pa.array([model.least], pa.float64()),
                ],
                names=["languages", "table", "bias", "temperature", "least"],
            )

    learnt = got.repartition(1).mapInArrow(
        learn, "languages array<string>, table binary, bias binary, temperature double, least double"
    ).collect()
    if not learnt:
        return None
    (r,) = learnt
    table = np.frombuffer(r["table"], np.float32).reshape(BUCKETS, len(r["languages"]))
    bias = np.frombuffer(r["bias"], np.float32)
    return Model(list(r["languages"]), table, bias, r["temperature"], r["least"])


def _has_letter() -> Column:
    return F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False))


def predict(docs: DataFrame, model: Model | None, columns: tuple[str, str, str] = ("lang_pred", "score", "accepted")) -> DataFrame:
    """Add the predicted language, its calibrated probability and whether it is accepted.

    ``und``, 0 and rejected: a null text, one without a letter, and every text if there is no model.
    Whole texts are read where they lie; nothing is shuffled. Columns of the given names are replaced.
    """
    @F.arrow_udf("struct<language:string,score:double>")
    def guess(texts: pa.Array) -> pa.Array:
        release()
        names, scores = [], []
        for _, _, data, cuts in text_slices(texts):
            chance = _softmax(mean_logits(model, data, cuts) / model.temperature)
            names += [model.languages[k] for k in chance.argmax(axis=1)]
            scores += chance.max(axis=1).tolist()
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["language", "score"])

    name, score, accepted = columns
    if model is None:
        return docs.withColumns({name: F.lit(UNKNOWN), score: F.lit(0.0), accepted: F.lit(False)})
    found = small_batches(docs).withColumn("_language", guess(F.col("text").cast("string"))).withColumn("_letter", _has_letter())
    found = found.withColumns(
        {
            name: F.when(F.col("_letter"), F.col("_language.language")).otherwise(UNKNOWN),
            score: F.when(F.col("_letter"), F.col("_language.score")).otherwise(0.0),
            accepted: F.col("_letter") & (F.col("_language.score") >= model.least),
        }
    )
    return found.drop("_language", "_letter")
