"""What the classifier has on disk when its documents move: its answers, and nothing that it has used up."""

import os
import time

from rastrum.llm import common, quality

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shuffle_files(spark):
    tops = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f"{d}/{x}" for top in tops for d, _, names in os.walk(top) for x in names if x.startswith("shuffle_")}


def table_path(df):
    return df._jdf.queryExecution().logical().rdd().getCheckpointFile().get().removeprefix("file:")


def test_used_up_shuffles_and_tables_are_gone_when_documents_move(spark, monkeypatch):
    docs = spark.range(400).selectExpr("id AS doc_id", "concat('some plain words of text number ', id, if(id % 9 = 0, ' vile', ' fine')) AS text", "if(id % 3 = 0, 'de', 'en') AS lang").checkpoint()
    labels = spark.range(400).selectExpr("id AS doc_id", "cast(id % 9 > 0 AS int) AS quality", "cast(id % 9 = 0 AS int) AS toxic")
    before, setting = shuffle_files(spark), spark.conf.get(CLEANUP)
    made, left = [], []
    checkpoint, packed = type(docs).checkpoint, quality.packed

    def noted(self, *a):
        out = checkpoint(self, *a)
        made.append((set(out.columns), table_path(out)))
        return out

    def moving(*a):
        until = time.time() + 20
        while shuffle_files(spark) - before and time.time() < until:  # they go in the background
            time.sleep(0.2)
        left.append((shuffle_files(spark) - before, [c for c, p in made if c & {"gram", "grams", "context"} and os.path.exists(p)]))
        return packed(*a)

    monkeypatch.setattr(type(docs), "checkpoint", noted)
    monkeypatch.setattr(quality, "packed", moving)
    # Not by luck: neither Python's garbage nor the driver's is collected.
    monkeypatch.setattr(quality, "forget_shuffles", lambda spark: None)
    rows = quality.classify(docs, labels).collect()
    assert left == [(set(), [])]
    assert sum(bool(c & {"gram", "grams", "context"}) for c, _ in made) >= 6
    assert [p for c, p in made if "bits" in c and "shard" in c and os.path.exists(p)] == []
    assert spark.conf.get(CLEANUP) == setting
    assert len(rows) == 400 and all(r.bits > 0 for r in rows) and {r.doc_id for r in rows if r.toxicity} == {x for x in range(400) if x % 9 == 0}


def test_forgotten_tables_take_no_disk(spark):
    common.checkpoint_dir(spark)
    one, two = spark.range(10).checkpoint(), spark.range(20).checkpoint()
    assert os.path.exists(table_path(one))
    common.forget_tables(one)
    assert not os.path.exists(table_path(one)) and two.count() == 20
