"""What several operators share: table access, worker caches, byte-level words, hashes."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import hashlib
import io
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z to a-z; bytes outside words (``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lowering) to a space.
WORD_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def worker_cache(owner: str) -> dict:
    """A dictionary that lives on in the Python worker, over its tasks, until another operator's task comes.

    What one operator has cached never adds to what the next one needs.
    """
    cache = sys.modules.setdefault("_rastrum_worker_cache", types.ModuleType("_rastrum_worker_cache"))
    if getattr(cache, "owner", None) != owner:
        cache.owner, cache.held = owner, {}
    return cache.held


def release_memory() -> None:
    """Give back what a finished batch has freed: a worker that is kept for later tasks should be small between them."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def words_of(text: str | None) -> list[bytes]:
    """The lower-cased words of a text as UTF-8 bytes; none for null."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(WORD_TABLE).split()


def map_rows(df: DataFrame, columns: list[str], fn: Callable[..., tuple], schema: str) -> DataFrame:
    """Apply fn(*values) -> tuple to each row, batch by batch; only `columns` are read."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Slices bound the Python objects that live at once, however long the texts are.
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                rows = [fn(*values) for values in zip(*(part.column(i).to_pylist() for i in range(len(columns))), strict=True)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), out.types, strict=True)], schema=out)
        release_memory()

    return df.select(*columns).mapInArrow(run, schema)


def chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[str, pa.Table]]:
    """Rows in pieces of about `most` characters of text (the last column), each with a name.

    The name comes from the partition and the content, so that reading the same rows again gives the same
    names; the rows must come from steady(), so that they do. Whoever joins by a name raises if its answer is missing.
    """
    from pyspark import TaskContext

    worker_cache("chunks")
    held: list[pa.RecordBatch] = []
    size = n = 0

    def named():
        t, mark = pa.Table.from_batches(held), hashlib.sha256()
        for c in t.columns:
            for piece in c.chunks:
                mark.update(repr(piece.to_pylist()).encode())
        return f"{TaskContext.get().partitionId()}-{n}-{mark.hexdigest()[:16]}", t

    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            held.append(part)
            size += pc.sum(pc.utf8_length(part.column(part.num_columns - 1))).as_py() or 0
            if size >= most:
                yield named()
                held, size, n = [], 0, n + 1
                release_memory()
    if held:
        yield named()
    held = []
    release_memory()


def steady(df: DataFrame) -> DataFrame:
    """The same rows, in an order that stays when they are read again: files and tables do that, what comes out of
    a shuffle needn't (after a lost executor), and is written to the shared folder first."""
    steady_nodes = {"Project", "Filter", "LogicalRelation", "LogicalRDD", "LocalRelation"}
    todo = [df._jdf.queryExecution().optimizedPlan()]
    while todo:
        plan = todo.pop()
        if plan.nodeName() not in steady_nodes:
            checkpoint_dir(df.sparkSession)
            return df.checkpoint()
        todo += [plan.children().apply(i) for i in range(plan.children().size())]
    return df


def forget_shuffles(spark: SparkSession) -> None:
    """Let the files of shuffles that nothing refers to any more go now, not when the driver next collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def release_heaps(spark: SparkSession) -> None:
    """Let idle executors give back what their heaps don't hold any more: a heap that large pages have widened stays
    wide until the executor next marks it, and workers need the room. A task a core; requests at a time in one executor are one collection."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).selectExpr("java_method('java.lang.System', 'gc')").collect()


def forget_tables(*tables: DataFrame) -> None:
    """Delete the files of tables that checkpoint() returned and that nothing reads any more."""
    for t in tables:
        held = t._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if held.isDefined():
            path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(held.get())
            path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Python workers get at most this many rows at a time in what is computed inside: for rows that may be long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(name))
    with _setting(spark, name, str(min(rows, before) if before > 0 else rows)):
        yield


@contextlib.contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Each table made inside is written or collected once: the files of its shuffles go as soon as that has ended, whatever still refers to them."""
    with _setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        yield


#: Rows of narrow columns that may be broadcast, in some MB.
SMALL_ROWS = 50_000


def small(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """A table of narrow rows to be joined: broadcast if it has few rows, left to a shuffle if not. It is counted, so it should be cheap to read."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def packed(docs: DataFrame, most: int) -> DataFrame:
    """chunk, docs: the chunks of rows, each compressed into one value that unpacked() reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for name, t in chunks(batches, most):
            sink = io.BytesIO()
            with pa.ipc.new_stream(sink, t.schema) as w:
                w.write_table(t)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([zstandard.ZstdCompressor(level=7).compress(sink.getvalue())], pa.binary())], names=["chunk", "docs"])

    return docs.mapInArrow(run, "chunk string, docs binary")


def unpacked(blob: bytes) -> pa.Table:
    import zstandard

    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(blob)).read_all()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64), element by element."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def by_shard(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each shard that occurs and where, in order."""
    order = np.argsort(shard, kind="stable")
    edges = np.flatnonzero(np.diff(shard[order])) + 1
    for at in np.split(order, edges):
        if len(at):
            yield int(shard[at[0]]), at


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a default only on one machine, as in tests."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir", "")
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or "/tmp/checkpoints/rastrum")
    return sc._jsc.sc().getCheckpointDir().get()
