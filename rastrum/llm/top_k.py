"""Exact top-k search by distributed histogram selection (operator 10).

Vectors become integers floor(scale * x); the score is their inner product. The queries
are the stated query set. Rows and queries are dealt into a grid of cells of at most
about `cell` rows and `cell` queries, so that what a task holds is bounded, and every row
is scored against every query once a pass; all cells of a pass are one job, and what is
known of a query between passes is a row of a table.

1. A pass counts every score in equal bins over the range that may hold the query's kth
   value, scores above that range in one more bin. Of its counts a cell sends the highest
   bins, down to where they reach k: the kth value of all can't lie below. They are added
   up, and the bin with the kth value is the next pass's range, until it is one score wide:
   the kth value itself.
2. The last pass keeps the rows that score the kth value or more, of equal scores the
   smaller ids; at most k a cell and query. They are ranked by score, then id.

Rows whose vector is null, or holds a null or non-finite component, or has another length
than the query, take no part; nor does a row with a null id. A query isn't its own
candidate, but other rows with its id are; a query id that several rows have is searched for each.
Fewer than k candidates give as many rows. Extra columns are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint_dir, release_memory

BINS = 4096
#: Rows and queries of a cell.
CELL = 32_768
#: Rows and queries that are scored at once.
ROWS, QUERIES = 4096, 512
#: A cell holds this many rows at least, before more cells are made to keep all cores busy.
LEAST_ROWS = 2048
LOWEST = np.iinfo(np.int64).min


def usable(df: DataFrame, scale: int) -> DataFrame:
    """vec_id and the integer vector as doubles, of rows that take part."""
    # A null or NaN component makes the conjunction null or false.
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return df.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("v")
    )


def _by_length(t: pa.Table):
    """Vectors by length: where they stand in the table, and as the rows of a matrix of doubles."""
    column = t.column("v").combine_chunks()
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    starts = np.cumsum(ends) - ends
    for n in np.unique(ends).tolist():
        at = np.flatnonzero(ends == n)
        yield n, at, flat[starts[at][:, None] + np.arange(n)].astype(np.float64)


def _scored(queries: pa.Table, rows: pa.Table):
    """Query numbers, row numbers and their scores as integers, a block at a time (all blocks of some queries in a row)."""
    names, own = queries.column("row").to_numpy(), rows.column("row").to_numpy()
    held = {n: (at, v) for n, at, v in _by_length(rows)}
    for n, at, q in _by_length(queries):
        if n not in held:
            continue
        where, v = held[n]
        largest = max(1.0, float(np.abs(v).max(initial=0))) * max(1.0, float(np.abs(q).max(initial=0))) * max(1, n)
        for a in range(0, len(at), QUERIES):
            mine = at[a : a + QUERIES]
            yield mine, None, None
            for b in range(0, len(where), ROWS):
                theirs = where[b : b + ROWS]
                # Doubles hold every partial sum exactly below 2**53; beyond that 64-bit integers do.
                x, y = q[a : a + QUERIES], v[b : b + ROWS]
                s = (x @ y.T).astype(np.int64) if largest < 2**53 else x.astype(np.int64) @ y.T.astype(np.int64)
                _, i, j = np.intersect1d(names[mine], own[theirs], return_indices=True)
                s[i, j] = LOWEST
                yield mine, theirs, s


_COUNTS = pa.schema([("row", pa.int64()), ("bin", pa.int64()), ("n", pa.int64())])


def _counter(width: int, k: int):
    """Histogram pass over a cell: row of the query, bin (from its low on, `width` scores each; BINS: any higher), count."""
    shift = width.bit_length() - 1

    def run(key: tuple, queries: pa.Table, rows: pa.Table) -> pa.Table:
        if not queries.num_rows or not rows.num_rows:
            return _COUNTS.empty_table()
        names, out = queries.column("row").to_numpy(), []
        known, low = queries.column("low").is_valid().to_numpy(), pc.fill_null(queries.column("low"), 0).to_numpy()
        counts, mine = np.zeros(0, np.int64), None

        def told():
            n = counts.reshape(-1, BINS + 1)
            # What lies above a bin; bins are sent down to where the counts reach k.
            above = np.cumsum(n[:, ::-1], axis=1)[:, ::-1] - n
            q, b = np.nonzero((n > 0) & (above < k) & known[mine][:, None])
            out.append(pa.table([names[mine][q], b, n[q, b]], schema=_COUNTS))

        for at, where, s in _scored(queries, rows):
            if where is None:
                if mine is not None:
                    told()
                mine, counts = at, np.zeros(len(at) * (BINS + 1), np.int64)
                continue
            # A query's own row and scores below the range lie in no bin.
            q, r = np.nonzero((s >= low[at][:, None]) & (s != LOWEST))
            bins = np.minimum((s[q, r] - low[at][q]) >> shift, BINS)
            counts += np.bincount(q * (BINS + 1) + bins, minlength=len(counts))
        if mine is not None:
            told()
        counts = np.zeros(0, np.int64)
        release_memory()
        return pa.concat_tables(out) if out else _COUNTS.empty_table()

    return run


_KEPT = pa.schema([("row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _keeper(k: int):
    """Last pass over a cell: scores at or over the query's kth value (all, if it has none), the k best of the cell."""

    def run(key: tuple, queries: pa.Table, rows: pa.Table) -> pa.Table:
        if not queries.num_rows or not rows.num_rows:
            return _KEPT.empty_table()
        low = pc.fill_null(queries.column("low"), LOWEST + 1).to_numpy()
        ids, held, out = rows.column("vec_id").to_numpy(), None, []

        def told():
            q, vec, score = held
            out.append(pa.table([queries.column("row").to_numpy()[q], queries.column("vec_id").to_numpy()[q], vec, score], schema=_KEPT))

        for at, where, s in _scored(queries, rows):
            if where is None:
                if held:
                    told()
                held = [np.zeros(0, np.int64)] * 3
                continue
            q, r = np.nonzero((s >= low[at][:, None]) & (s != LOWEST))
            held = [np.concatenate(x) for x in zip(held, (at[q], ids[where[r]], s[q, r]), strict=True)]
            order = np.lexsort((held[1], -held[2], held[0]))
            held = [x[order] for x in held]
            place = np.arange(len(order)) - np.searchsorted(held[0], held[0])
            held = [x[place < k] for x in held]
        if held:
            told()
        release_memory()
        return pa.concat_tables(out) if out else _KEPT.empty_table()

    return run


def top_k(vectors: DataFrame, *, every: int = 50, k: int = 5, scale: int = 256, cell: int = CELL) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all rows for each row whose id is divisible by `every`."""
    spark = vectors.sparkSession
    checkpoint_dir(spark)
    fine = usable(vectors, scale)
    asks = F.col("vec_id") % every == 0
    largest = F.aggregate("v", F.lit(0.0), lambda s, x: F.greatest(s, F.abs(x)))
    about = fine.agg(F.count("*").alias("n"), F.count(F.when(asks, 1)).alias("q"), F.max(largest).alias("bound"), F.max(F.when(asks, largest)).alias("qbound"), F.max(F.size("v")).alias("dim")).first()
    # Components mostly fit four bytes. Rows have numbers that only this table gives out, read from its files ever after.
    kind = "array<int>" if (about.bound or 0) < 2**31 else "array<double>"
    rows = fine.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.col("v").cast(kind).alias("v")).checkpoint()
    down = max(-(-about.q // cell), 1)
    across = max(-(-about.n // cell), min(spark.sparkContext.defaultParallelism, -(-about.n // min(cell, LEAST_ROWS))), 1)
    dealt = lambda n, salt: F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(n)).cast("int")
    every_ = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    theirs = rows.select("row", "vec_id", "v", dealt(across, 1).alias("across"), every_(down).alias("down"))
    mine = rows.where(asks).select("row", "vec_id", "v", every_(across).alias("across"), dealt(down, 2).alias("down"))
    # Python's integers don't overflow here; scores beyond 64 bits are outside the operator's domain.
    most = min(2**61, int(about.bound or 0) * int(about.qbound or 0) * (about.dim or 0))
    state = rows.where(asks).select("row", F.lit(-most).cast("long").alias("low"))

    def cells(fn, schema):
        queries = mine.join(state, "row").select("row", "vec_id", "v", "low", "across", "down")
        # Named anew, as both sides come from one table.
        queries = queries.select(*(F.col(c).alias(c) for c in queries.columns))
        return queries.groupBy("across", "down").cogroup(theirs.groupBy("across", "down")).applyInArrow(fn, schema)

    span, width = 2 * most + 1, 0
    while width != 1:
        width = 1 << max(0, (-(-span // BINS) - 1).bit_length())
        counts = cells(_counter(width, k), "row long, bin long, n long").groupBy("row", "bin").agg(F.sum("n").alias("n"))
        # At most k bins of each cell, so few rows a query.
        above = F.sum("n").over(Window.partitionBy("row").orderBy(F.col("bin").desc()))
        found = counts.withColumn("above", above).where(F.col("above") >= k).groupBy("row").agg(F.max("bin").alias("bin"))
        # Without k candidates there is no kth value: low is null, and every score counts.
        state = state.join(found, "row", "left").select("row", (F.col("low") + F.col("bin") * width).alias("low")).checkpoint()
        span = width
    ranked = cells(_keeper(k), "row long, query_id long, vec_id long, score long").withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(F.col("score").desc(), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
