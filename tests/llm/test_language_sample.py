"""The sample that the language model learns from stays on the executors."""

from pyspark.sql import functions as F

from sievelight.llm import language


def test_only_counts_of_languages_and_the_model_reach_the_driver(spark, monkeypatch):
    words = F.when(F.col("id") % 2 == 0, F.lit("the quick house of green fields ")).otherwise(F.lit("der schnelle hund und das haus "))
    docs = spark.range(600).select(
        F.col("id").alias("doc_id"),
        F.concat(words, F.col("id").cast("string")).alias("text"),
        F.when(F.col("id") % 2 == 0, F.lit("en")).otherwise(F.lit("de")).alias("lang"),
    )
    seen, collect = [], type(docs).collect

    def watched(df):
        rows = collect(df)
        seen.append(len(rows))
        return rows

    monkeypatch.setattr(type(docs), "collect", watched)
    model = language.fit(docs)
    assert model.languages == ["de", "en"] and sum(seen) <= 3
    monkeypatch.undo()
    assert language.predict(docs, model).where(F.col("lang_pred") != F.col("lang")).count() == 0


def test_labelled_rows_without_a_sampled_text_give_no_model(spark):
    docs = spark.createDataFrame([(1, None, "en"), (2, "123", "de"), (3, "words", None)], "doc_id long, text string, lang string")
    assert language.fit(docs) is None
