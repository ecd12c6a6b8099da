"""Toxic documents that the model of characters finds probable."""

import random

from test_pipeline import corpus

from rastrum.llm import quality

DOCS, LABELS = "doc_id long, text string, lang string", "doc_id long, quality int, toxic int"


def test_toxic_words_reject_however_long_the_text(spark):
    rng = random.Random(3)
    rows, labels, _ = corpus()
    prose = " ".join(t for i, t, x in rows if x == "en" and i < 60)
    with_word = lambda n: " ".join(rng.sample(prose.split(), n) + ["Ingonst!"] + rng.sample(prose.split(), n))
    rows += [[1000 + i, with_word(20), "en"] for i in range(40)] + [[1100, with_word(200), "en"], [1101, with_word(5), None], [1102, prose[:500], "en"]]
    labels += [[1000 + i, 1, 1] for i in range(40)]
    got = {r.doc_id: r for r in quality.classify(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)).collect()}
    assert not any(got[i].keep for i in [*range(1000, 1040), 1100, 1101]) and all(got[1100].toxicity == got[1000 + i].toxicity for i in range(40))
    assert got[1102].keep and got[1102].toxicity is None and sum(got[i].keep for i in range(240)) >= 228


def test_toxic_texts_are_not_trusted(spark):
    rows, labels, _ = corpus()
    toxic = [[i, 1, 1] for i, _, _ in labels if i is not None]
    docs = spark.createDataFrame([r[:3] for r in rows], DOCS)
    assert quality.classify(docs, spark.createDataFrame(toxic, LABELS)).where("bits IS NOT NULL").count() == 0


def test_a_repeated_text_is_one_witness(spark):
    docs = spark.createDataFrame([(i, "alpha beta", "en") for i in range(30)] + [(30 + i, f"gamma {i}", "en") for i in range(30)], DOCS)
    marks = spark.createDataFrame([(i, 1) for i in range(30)] + [(30 + i, 0) for i in range(30)], "doc_id long, toxic int")
    quality.checkpoint_dir(spark)
    assert quality.toxic_words(docs, marks) == {}


def test_a_language_with_few_held_out_texts_has_a_limit(spark):
    rows, labels, _ = corpus()
    few = {i for i, _, x in rows if x == "de" and i < 36}
    labels = [r for r in labels if r[0] in few | {i for i, _, x in rows if x == "en"}]
    rows += [[400 + i, rows[3 * i][1].upper().replace(" ", "!! "), "de"] for i in range(20, 30)]
    got = {r.doc_id: r for r in quality.classify(spark.createDataFrame([r[:3] for r in rows], DOCS), spark.createDataFrame(labels, LABELS)).collect()}
    held = {r.doc_id for r in spark.createDataFrame([(i,) for i in few], "doc_id long").where(quality.F.pmod(quality.F.xxhash64("doc_id"), quality.F.lit(quality.HELD_OUT)) == 0).collect()}
    assert len(held & {r[0] for r in labels}) < quality.LEAST_HELD
    assert not any(got[420 + i].keep for i in range(10)) and got[300].limit is not None and got[301].limit is not None
    assert sum(got[i].keep for i in range(240)) >= 228
