"""Scans over ordered rows that no single task has to hold.

A stream's rows are cut into blocks of its order column. Inside a block a scan is an
ordinary window; what a block takes over from those before it comes from a table with one
row a block, made by aggregates that combine map-side. So a recording of any length, or one
key with a third of all rows, is spread over as many tasks as it has blocks, and each row is
shuffled once.

`order` is an integer column, unique within `keys` (several columns for the total order are
packed into one before, see packed_order). Null keys are a stream of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1_000_000
_B = "__block"


def materialised(df: DataFrame) -> DataFrame:
    """The rows, written once to the shared checkpoint folder the cluster names: later steps start from there.

    Plans that use a result several times would otherwise grow with every step built on it.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir", "")
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or "/tmp/checkpoints/rastrum")
    return df.checkpoint()


def packed_order(high: Column, low: Column, bits: int) -> Column:
    """One long from two columns; low must stay under 2**bits."""
    return F.shiftleft(high.cast("long"), bits) + low.cast("long")


class Scan:
    """Lagged values, running sums and last known values of one ordered stream, in one shuffle."""

    def __init__(self, keys: list[str], order: str, block: int = BLOCK):
        self.keys, self.order, self.block = keys, order, block
        self._lags: dict[str, Column] = {}
        self._sums: dict[str, Column] = {}
        self._last: dict[str, Column] = {}
        self._leads: dict[str, Column] = {}
        self._highest: dict[str, Column] = {}
        self._before: dict[str, Column] = {}

    def lag(self, **new: Column) -> Scan:
        """Each expression's value on the row before (null on the first)."""
        self._lags |= new
        return self

    def lead(self, **new: Column) -> Scan:
        self._leads |= new
        return self

    def running(self, **new: Column) -> Scan:
        """Each expression's sum up to and with the row; nulls count as 0."""
        self._sums |= {k: F.coalesce(v, F.lit(0)) for k, v in new.items()}
        return self

    def last(self, **new: Column) -> Scan:
        """Each expression's latest value up to and with the row that isn't null."""
        self._last |= new
        return self

    def highest(self, **new: Column) -> Scan:
        """Each expression's greatest value up to and with the row."""
        self._highest |= new
        return self

    def highest_before(self, **new: Column) -> Scan:
        """Each expression's greatest value before the row (null on the first)."""
        self._before |= new
        return self

    def over(self, df: DataFrame) -> DataFrame:
        names = df.columns
        at = F.col(self.order)
        exprs = [v.alias(f"__{kind}_{k}") for kind, found in (("lag", self._lags), ("sum", self._sums), ("last", self._last), ("lead", self._leads), ("top", self._highest | self._before)) for k, v in found.items()]
        by = [f"__k{i}" for i in range(len(self.keys))] + [_B]
        # Rows are dealt out once, and the table of blocks is made from the same shuffle. It must need
        # the same columns for that, so a row travels as one value that the blocks look at too (in an
        # array, from which the optimiser doesn't take single fields before the shuffle).
        df = df.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(self.keys)], F.floor(at / self.block).alias(_B), at.alias("__at"), F.array(F.struct(*names)).alias("__row"), *exprs).repartition(*by)
        at = F.col("__at")
        lag_cols, lead_cols = [f"__lag_{k}" for k in self._lags], [f"__lead_{k}" for k in self._leads]
        edges = [F.max_by("__row", at).alias("__any")]
        edges += [F.max_by(F.struct(*lag_cols), at).alias("__tail")] if lag_cols else []
        edges += [F.min_by(F.struct(*lead_cols), at).alias("__head")] if lead_cols else []
        edges += [F.sum(f"__sum_{k}").alias(f"__total_{k}") for k in self._sums]
        # The latest known value of a block is the one with the highest place among those known.
        edges += [F.max(F.when(F.col(f"__last_{k}").isNotNull(), F.struct(at.alias("at"), F.col(f"__last_{k}").alias("v")))).alias(f"__known_{k}") for k in self._last]
        edges += [F.max(f"__top_{k}").alias(f"__most_{k}") for k in self._highest | self._before]
        blocks = df.groupBy(*by).agg(*edges).where(F.col("__any").isNotNull())
        over = Window.partitionBy(*by[:-1]).orderBy(_B)
        before = over.rowsBetween(Window.unboundedPreceding, -1)
        carry = [F.lag("__tail").over(over).alias("__tail")] if lag_cols else []
        carry += [F.lead("__head").over(over).alias("__head")] if lead_cols else []
        carry += [F.coalesce(F.sum(f"__total_{k}").over(before), F.lit(0)).alias(f"__total_{k}") for k in self._sums]
        carry += [F.last(f"__known_{k}", ignorenulls=True).over(before).alias(f"__known_{k}") for k in self._last]
        carry += [F.max(f"__most_{k}").over(before).alias(f"__most_{k}") for k in self._highest | self._before]
        blocks = blocks.select(*[F.col(c).alias(f"__b_{c}") for c in by], *carry)
        same = F.lit(True)
        for c in by:
            same = same & df[c].eqNullSafe(blocks[f"__b_{c}"])
        inside = Window.partitionBy(*by).orderBy("__at")
        upto = inside.rowsBetween(Window.unboundedPreceding, 0)
        joined = df.join(blocks, same, "left")
        out = joined
        if lag_cols:
            out = out.withColumn("__own", F.lag(F.struct(*lag_cols)).over(inside)).withColumn("__own", F.coalesce("__own", "__tail"))
            for k in self._lags:
                out = out.withColumn(k, F.col("__own")[f"__lag_{k}"])
        if lead_cols:
            out = out.withColumn("__next", F.lead(F.struct(*lead_cols)).over(inside)).withColumn("__next", F.coalesce("__next", "__head"))
            for k in self._leads:
                out = out.withColumn(k, F.col("__next")[f"__lead_{k}"])
        for k in self._sums:
            out = out.withColumn(k, F.sum(f"__sum_{k}").over(upto) + F.col(f"__total_{k}"))
        for k in self._last:
            out = out.withColumn(k, F.coalesce(F.last(f"__last_{k}", ignorenulls=True).over(upto), F.col(f"__known_{k}")["v"]))
        # greatest() passes over nulls.
        for k in self._highest:
            out = out.withColumn(k, F.greatest(F.max(f"__top_{k}").over(upto), F.col(f"__most_{k}")))
        for k in self._before:
            out = out.withColumn(k, F.greatest(F.max(f"__top_{k}").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.col(f"__most_{k}")))
        return out.withColumn("__row", F.element_at("__row", 1)).select(*[F.col("__row")[c].alias(c) for c in names], *self._lags, *self._leads, *self._sums, *self._last, *self._highest, *self._before)


def with_halo(df: DataFrame, keys: list[str], order: str, rows: int, block: int = BLOCK) -> DataFrame:
    """The rows dealt to blocks of about `block` rows (`__block`), each block with the `rows` rows before it (`__halo`).

    A window over the last `rows + 1` rows is then one inside (keys, __block); halo rows are dropped after it.
    """
    numbered = Scan(keys, order).running(__n=F.lit(1)).over(df)
    mine = F.expr(f"(__n - 1) div {block}")
    # A row near its block's end goes to the next block too (to several, where blocks are shorter than the halo).
    last = F.expr(f"(__n - 1 + {rows}) div {block}")
    dealt = numbered.withColumn("__block", F.explode(F.sequence(mine, last)))
    return dealt.withColumn("__halo", F.col("__block") != mine).drop("__n")
