"""Documents through the training-data operators, stage by stage.

Each function takes (spark, docs, sf_dir); its result is written and read again as the
next one's docs. All but the last return the columns of `documents`.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rastrum.llm import bpe, decontaminate, line_dedup, near_dup, quality
from rastrum.llm.common import checkpoint_dir, release_heaps, table
from rastrum.llm.queries import WORD_BPE, tokenizer_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines are deleted; a document of which nothing is left goes."""
    return line_dedup.without_repeats(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays, that with the smallest id."""
    return near_dup.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of the benchmark go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's tokens: their number, and digests of the ids and of the decoded text."""
    return bpe.encode_documents(docs, tokenizer_path(WORD_BPE))


def afresh(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The stage, begun on executors that have given back what the one before left in their heaps."""

    @functools.wraps(stage)
    def begun(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release_heaps(spark)
        return stage(spark, docs, sf_dir)

    return begun


STAGES = [
    ("quality classifier", afresh(quality_classifier)),
    ("line dedup", afresh(line_dedup_stage)),
    ("MinHash near-dedup", afresh(near_dedup)),
    ("benchmark decontamination", afresh(decontamination)),
    ("BPE encoding and decoding", afresh(bpe_encoding)),
]

#: SQL can't express the stages; tests hold the pipeline against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str, root: str | None = None) -> DataFrame:
    """All stages over the documents; each result is a table in the shared checkpoint folder until the next one is written.

    root: a folder for the results. Stages that are finished there are not run again, so a run that was
    broken off goes on under the same root; the tables stay.
    """
    import uuid

    keep, root = root is not None, root or f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    folder = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.hadoopConfiguration()
    for k, (_, stage) in enumerate(STAGES):
        done = folder(f"{root}/{k}/_SUCCESS")
        if not (keep and done.getFileSystem(conf).exists(done)):
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{root}/{k}")
        if k and not keep:
            before = folder(f"{root}/{k - 1}")
            before.getFileSystem(conf).delete(before, True)
        docs = spark.read.parquet(f"{root}/{k}")
    return docs
