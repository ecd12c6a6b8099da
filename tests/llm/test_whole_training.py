"""Operator 6 learns from every labelled document, however many there are."""

import pytest

from rastrum.llm import quality


class Seen(Exception):
    pass


def test_model_and_words_see_every_labelled_document(spark, monkeypatch):
    n = 9_000
    docs = spark.range(n).selectExpr("id AS doc_id", "'en' AS lang", "concat('text number ', id) AS text")
    labels = spark.range(n).selectExpr("id AS doc_id", "cast(id % 9 <> 0 AS int) AS quality", "cast(id % 10 = 0 AS int) AS toxic")
    want = spark.range(n).where(f"id % 9 <> 0 AND id % 10 <> 0 AND pmod(xxhash64(id), {quality.HELD_OUT}) <> 0").count()
    assert want > 5_000

    def model(trusted):
        raise Seen(trusted.select("doc_id").distinct().count())

    monkeypatch.setattr(quality, "Model", model)
    monkeypatch.setattr(quality, "PER_LANGUAGE", 500, raising=False)  # bounds that there were
    monkeypatch.setattr(quality, "MOST_TRAINED", 500, raising=False)
    monkeypatch.setattr(quality, "MOST_IDS", 1_500, raising=False)
    with pytest.raises(Seen) as seen:
        quality.classify(docs, labels)
    assert seen.value.args == (want,)
    marks = labels.select("doc_id", "toxic")
    monkeypatch.setattr(quality, "TOXIC_LEAST", n // 10)
    # Every toxic document holds it, so only a count of all of them reaches the least.
    spoken = docs.selectExpr("doc_id", "lang", "concat(text, if(doc_id % 10 = 0, ' vile', ' fine')) AS text")
    assert quality.toxic_words(spoken, marks).keys() == {b"vile"}
