"""What the classifier's workers hold at a time."""

import random

import numpy as np

import corpus_pipeline
from rastrum.llm import quality


def held(x):
    return x.nbytes if isinstance(x, np.ndarray) else sum(map(held, x)) if isinstance(x, (list, tuple)) else 0


def test_places_of_n_grams_are_narrow():
    rng = random.Random(1)
    some = ["".join(rng.choice("abcdef") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    texts = [" ".join(rng.choice(some) for _ in range(300)) for _ in range(1000)]
    grams = quality.Grams(texts)
    places = sum(len(t) + 1 for t in texts)
    assert grams.counts().sum() == places and len(grams.slices) > 1
    assert held([of for _, of, _ in grams.slices]) < 2.5 * places


def test_texts_come_a_bound_number_at_a_time(spark, monkeypatch):
    rng = random.Random(2)
    prose = lambda: " ".join("".join(rng.choice(["on", "er", "st", "an"]) for _ in range(rng.randrange(1, 4))) for _ in range(12))
    docs = spark.createDataFrame([(i, prose() if i % 9 else prose().upper(), "en") for i in range(300)], "doc_id long, text string, lang string").coalesce(1).checkpoint()
    labels = spark.createDataFrame([(i, int(i % 9 > 0), 0) for i in range(300)], "doc_id long, quality int, toxic int")
    judged = lambda: {r.doc_id: (round(r.bits, 5), r.keep) for r in quality.classify(docs, labels).collect()}
    plain = judged()

    def bound(run):
        def checked(batches):
            def each():
                for b in batches:
                    if b.num_rows > 16:
                        raise ValueError(f"{b.num_rows} texts at a time")
                    yield b

            return run(each())

        return checked

    monkeypatch.setattr(quality, "TEXT_ROWS", 16, raising=False)
    for name in ("_asked", "_counted"):
        monkeypatch.setattr(quality, name, bound(getattr(quality, name)))
    assert judged() == plain and len(plain) == 300


def test_discounts_need_no_python_worker(spark):
    docs = spark.createDataFrame([(i, "one and another text of some words", "en" if i else None) for i in range(9)], "doc_id long, text string, lang string")
    quality.checkpoint_dir(spark)
    for some in (docs, docs.limit(0)):
        told = quality.Model(some).discounts
        assert told._jdf.queryExecution().optimizedPlan().nodeName() == "LocalRelation"
        assert told.count() == (2 * quality.ORDER if some is docs else 0)
        assert told.dtypes == [("lang", "string"), ("k", "int"), ("d1", "double"), ("d2", "double"), ("d3", "double")]


def test_stages_begin_with_small_heaps(spark):
    docs = spark.createDataFrame([(1, "a few words")], "doc_id long, text string")
    full = lambda: sum(b.getCollectionCount() for b in spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if "Old" in b.getName())
    for name, stage in corpus_pipeline.STAGES[3:]:
        before = full()
        stage(spark, docs, "/root/testdata/sf0.001")
        assert full() > before, name
