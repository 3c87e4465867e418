"""The language model's sample where one text is copied very often."""

from pyspark.sql import functions as F

from claimloom.llm import language_id


def test_copies_take_one_place_of_the_sample(spark, ws):
    rows = [(f"the cat and the dog {i}", "en") for i in range(20)] + [(f"der hund und die katze {i}", "de") for i in range(20)] + [(f"le chat et le chien {i}", "fr") for i in range(20)]
    frame = spark.createDataFrame(rows, "text string, lang string")
    first = frame.orderBy(F.xxhash64("text", "lang")).first()
    hot = spark.createDataFrame([tuple(first)] * 200, "text string, lang string")
    once, often = language_id.fit(frame, ws, rows=50), language_id.fit(frame.union(hot), ws, rows=50)
    assert often.languages == once.languages == ["de", "en", "fr"]
    assert often.words == once.words and often.grams == once.grams
    assert (often.word_logs == once.word_logs).all() and (often.gram_logs == once.gram_logs).all()
