"""Correlations: as-of, step schedules, nearest, cutoff lookups, audits, overlays."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .ordered import Scan

#: A schedule has at most this many rows, so it may be broadcast.
MOST_SCHEDULE_ROWS = 65_536
HELD = 256


def asof_last(df: DataFrame, keys: list[str], order: str, value: Column, known: Column, name: str, block: int | None = None) -> DataFrame:
    """Adds the value of the latest row at or before each row for which `known` holds."""
    scan = Scan(keys, order, block) if block else Scan(keys, order)
    return scan.last(**{name: F.when(known, value)}).over(df)


def correlate(units: DataFrame, resyncs: DataFrame, keys: list[str], counter: str, arrival: str, held: int = HELD) -> DataFrame:
    """Each unit with the newest resync of its counter that had arrived and was among the last `held` then.

    units: keys, counter, arrival; resyncs: the same and more. Arrival positions order both. The
    resync's rank among its stream's, and how many had arrived when the unit did, decide: a unit meets
    only resyncs of its counter in its own and the last cell of `held` ranks. Repeated units each get their row.
    """
    both = units.select(*keys, F.col(arrival).alias("__at"), F.lit(1).alias("__unit")).distinct().unionByName(resyncs.select(*keys, F.col(arrival).alias("__at"), F.lit(0).alias("__unit")))
    # Ties: a resync that arrives with the unit has not been seen yet, so the unit comes first.
    packed = both.withColumn("__order", F.col("__at") * 2 + (1 - F.col("__unit")))
    seen = Scan(keys, "__order").running(__seen=1 - F.col("__unit")).over(packed)
    at_unit = seen.where("__unit = 1").select(*keys, "__at", F.col("__seen").alias("__arrived"))
    ranked = seen.where("__unit = 0").select(*keys, "__at", F.col("__seen").alias("__rank"))
    extra = [c for c in resyncs.columns if c not in (*keys, counter, arrival)]
    cell = lambda rank: F.floor(rank / held)
    rows = resyncs.join(ranked, (resyncs[arrival] == ranked["__at"]) & _same(resyncs, ranked, keys)).select(
        *[resyncs[k].alias(f"__k_{k}") for k in keys], resyncs[counter].alias("__counter"), "__rank", cell(ranked["__rank"]).alias("__c"), *[resyncs[c].alias(f"__r_{c}") for c in extra]
    )
    # One lookup for units that are alike.
    asked = units.select(*keys, counter, arrival).distinct()
    placed = asked.join(at_unit, (asked[arrival] == at_unit["__at"]) & _same(asked, at_unit, keys)).select(*[asked[c] for c in asked.columns], "__arrived")
    placed = placed.withColumn("__cell", F.explode(F.array(cell(F.col("__arrived")), cell(F.col("__arrived")) - 1)))
    on = (placed[counter] == rows["__counter"]) & (placed["__cell"] == rows["__c"]) & (rows["__rank"] <= placed["__arrived"]) & (rows["__rank"] > placed["__arrived"] - held)
    for k in keys:
        on = on & placed[k].eqNullSafe(rows[f"__k_{k}"])
    newest = placed.join(rows, on).groupBy(*asked.columns).agg(F.max_by(F.struct(*[F.col(f"__r_{c}").alias(c) for c in extra]), "__rank").alias("__m"))
    newest = newest.select(*[F.col(c).alias(f"__a_{c}") for c in asked.columns], "__m")
    back = F.lit(True)
    for c in asked.columns:
        back = back & units[c].eqNullSafe(newest[f"__a_{c}"])
    return units.join(newest, back, "left").select(*[units[c] for c in units.columns], *[F.col("__m")[c].alias(f"matched_{c}") for c in extra])


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & a[k].eqNullSafe(b[k])
    return on


def schedule_lookup(df: DataFrame, schedule: DataFrame, counter: str, first: str = "first_counter") -> DataFrame:
    """Each row with the schedule's last row whose first counter is its own or less; nulls where there is none, as with an empty schedule.

    The schedule is small by its format; its size is checked before it goes to every task. A row's step is
    found by binary search over the sorted first counters, the rest of the step by a join on its number.
    """
    rows = schedule.limit(MOST_SCHEDULE_ROWS + 1).collect()
    if len(rows) > MOST_SCHEDULE_ROWS:
        raise ValueError(f"a schedule has at most {MOST_SCHEDULE_ROWS} rows")
    rows.sort(key=lambda r: r[first])
    firsts = np.array([r[first] for r in rows], np.int64)

    @F.pandas_udf("int")
    def step(x: pd.Series) -> pd.Series:
        # The first of equal steps is passed over: the last row counts.
        return pd.Series(np.where(x.isna(), -1, np.searchsorted(firsts, x.fillna(0).to_numpy(np.int64), side="right") - 1), dtype="int32")

    numbered = df.sparkSession.createDataFrame([(n, *r) for n, r in enumerate(rows)], StructType([StructField("__step", IntegerType()), *schedule.schema.fields]))
    found = df.withColumn("__at", step(F.col(counter).cast("long")))
    return found.join(F.broadcast(numbered), F.col("__at") == F.col("__step"), "left").select(*[found[c] for c in df.columns], *[numbered[c] for c in schedule.columns])


def nearest(df: DataFrame, candidates: DataFrame, key16: str, extended: str, target: str, most: int) -> DataFrame:
    """Each row with the candidate of its 16-bit key whose extended counter is nearest to its target, within `most`; ties to the smaller.

    Both are dealt to cells as wide as the reach, so a row meets the candidates of two or three cells. Repeated rows each get theirs.
    """
    width = 2 * most + 1
    cell = lambda x: F.floor(x / width)
    c = candidates.select(F.pmod(F.col(extended), F.lit(65536)).alias("__k"), F.col(extended).alias("__e"), cell(F.col(extended)).alias("__c")).distinct()
    asked = df.select(F.col(key16).alias("__key"), F.col(target).alias("__target")).distinct()
    spread = asked.withColumn("__cell", F.explode(F.sequence(cell(F.col("__target") - most), cell(F.col("__target") + most))))
    near = spread.join(c, (F.col("__key") == F.col("__k")) & (F.col("__cell") == F.col("__c"))).withColumn("__d", F.abs(F.col("__e") - F.col("__target"))).where(F.col("__d") <= most)
    best = near.groupBy("__key", "__target").agg(F.min(F.struct("__d", "__e")).alias("__m"))
    back = df[key16].eqNullSafe(best["__key"]) & df[target].eqNullSafe(best["__target"])
    return df.join(best, back, "left").select(*[df[x] for x in df.columns], F.col("__m")["__e"].alias("nearest"), F.col("__m")["__d"].alias("distance"))


def decisions_of_units(units: DataFrame, log: DataFrame, keys: list[str], ordinal: str, counter16: str, complete: str, extended: str, strict: bool = True) -> DataFrame:
    """Each unit with its log row's extended counter, by ordinal, and `refused`: why the log can't be this recording's, or null.

    A unit without a row, and a complete unit whose counter isn't the low 16 bits of the row's, are refused; so is an ordinal that
    several rows have. strict: the first refusal raises.
    """
    rows = log.groupBy(*keys, ordinal).agg(F.min(extended).alias("__ext"), F.count("*").alias("__rows"))
    rows = rows.withColumnsRenamed({c: f"__l_{c}" for c in [*keys, ordinal]})
    on = units[ordinal] == rows[f"__l_{ordinal}"]
    for k in keys:
        on = on & units[k].eqNullSafe(rows[f"__l_{k}"])
    joined = units.join(rows, on, "left")
    wrong = F.col(complete) & (F.col("__ext").isNull() | ~F.col("__ext").bitwiseAND(65535).eqNullSafe(F.col(counter16)))
    why = F.when(F.col("__rows").isNull(), "no row").when(F.col("__rows") > 1, "several rows").when(wrong, "another counter")
    said = F.when(why.isNotNull(), F.raise_error(F.concat(F.lit("unit "), F.col(ordinal).cast("string"), F.lit(": "), why)).cast("string")) if strict else why
    return joined.select(*[units[c] for c in units.columns], F.col("__ext").alias(extended), said.alias("refused"))


def audit(expected: DataFrame, found: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row for each key: missing, extra, duplicate, mismatch or same."""
    e = expected.groupBy(key).agg(F.count("*").alias("__ne"), *[F.min(c).alias(f"__e_{c}") for c in columns])
    f = found.groupBy(key).agg(F.count("*").alias("__nf"), *[F.min(c).alias(f"__f_{c}") for c in columns])
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"__e_{c}").eqNullSafe(F.col(f"__f_{c}"))
    verdict = (
        F.when(F.col("__nf").isNull(), "missing").when(F.col("__ne").isNull(), "extra")
        .when((F.col("__nf") > 1) | (F.col("__ne") > 1), "duplicate").when(~same, "mismatch").otherwise("same")
    )
    return e.join(f, key, "full_outer").select(key, verdict.alias("verdict"))


def next_unit_pairs(df: DataFrame, keys: list[str], counter: str, columns: list[str], block: int | None = None) -> DataFrame:
    """Each row with `next_*` columns of the row one counter on; null where the next row isn't that."""
    scan = Scan(keys, counter, block) if block else Scan(keys, counter)
    seen = scan.lead(__next=F.struct(F.col(counter).alias("c"), *[F.col(c) for c in columns])).over(df)
    follows = F.col("__next")["c"] == F.col(counter) + 1
    return seen.select(*df.columns, *[F.when(follows, F.col("__next")[c]).alias(f"next_{c}") for c in columns])


def lost_between(pairs: DataFrame, lost: DataFrame, first: str, second: str, counter16: str) -> DataFrame:
    """Pairs of counters with `lost_between`: whether a listed 16-bit counter lies strictly between them, mod 65536.

    One does exactly if the next listed counter after the first does: a table of at most 65,536 rows tells how far that is.
    """
    turn = F.lit(65536)
    gone = lost.select(F.pmod(F.col(counter16), turn).cast("long").alias("__c")).where("__c IS NOT NULL").distinct()
    every = Window.partitionBy(F.lit(0)).orderBy("__c")
    before = F.coalesce(F.lag("__c").over(every), F.last("__c").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) - turn)
    # A counter that is listed itself is as far from the next as any other; the only one listed is a whole turn from itself.
    starts = gone.select("__c", before.alias("__b")).select("__c", F.explode(F.sequence("__b", F.col("__c") - 1)).alias("__s"))
    ahead = starts.select(F.pmod("__s", turn).alias("__from"), (F.col("__c") - F.col("__s")).alias("__ahead"))
    met = pairs.join(F.broadcast(ahead), F.pmod(pairs[first], turn) == ahead["__from"], "left")
    return met.select(*pairs.columns, F.coalesce(F.col("__ahead") < F.pmod(F.col(second) - F.col(first), turn), F.lit(False)).alias("lost_between"))


def overlay(spans: DataFrame, keys: list[str], start: str, end: str, priority: str, columns: list[str], cell: int = 1 << 20) -> DataFrame:
    """Overlapping spans laid over each other, the highest priority (later record) on top: disjoint spans, cut at every span's ends.

    Spans are cut into cells of the axis, so a stretch meets only spans of its cell; what a cell's edge alone has cut is put together again.
    """
    at = lambda x: F.floor(x / cell)
    real = spans.where(F.col(end) > F.col(start))
    cut = real.withColumn("__cell", F.explode(F.sequence(at(F.col(start)), at(F.col(end) - 1))))
    cut = cut.withColumn("__from", F.greatest(start, F.col("__cell") * cell)).withColumn("__to", F.least(end, (F.col("__cell") + 1) * cell))
    edges = cut.select(*keys, "__cell", F.explode(F.array(F.struct(F.col("__from").alias("a"), (F.col("__from") == F.col(start)).alias("real")), F.struct(F.col("__to").alias("a"), (F.col("__to") == F.col(end)).alias("real")))).alias("__e"))
    edges = edges.groupBy(*keys, "__cell", F.col("__e.a").alias("__a")).agg(F.max("__e.real").alias("__real"))
    inside = Window.partitionBy(*keys, "__cell").orderBy("__a")
    parts = edges.withColumn("__b", F.lead("__a").over(inside)).where("__b IS NOT NULL").withColumnsRenamed({k: f"__k_{k}" for k in keys} | {"__cell": "__at"})
    on = (parts["__at"] == cut["__cell"]) & (parts["__a"] >= cut["__from"]) & (parts["__b"] <= cut["__to"])
    for k in keys:
        on = on & parts[f"__k_{k}"].eqNullSafe(cut[k])
    top = parts.join(cut, on).groupBy(*keys, "__a", "__b").agg(F.max_by(F.struct(*columns), priority).alias("__t"), F.max("__real").alias("__real"))
    # A cell's edge where no span begins: the stretch before it goes on, and a span of another cell may end or begin just there.
    ends = edges.groupBy(*keys, "__a").agg(F.max("__real").alias("__really")).withColumnsRenamed({k: f"__k_{k}" for k in keys} | {"__a": "__p"})
    on = top["__a"] == ends["__p"]
    for k in keys:
        on = on & top[k].eqNullSafe(ends[f"__k_{k}"])
    marked = top.join(ends, on).select(*[top[c] for c in top.columns if c != "__real"], F.col("__really").cast("long").alias("__new"))
    whole = Scan(keys, "__a", cell * 1024).running(__run=F.col("__new")).over(marked)
    out = whole.groupBy(*keys, "__run").agg(F.min("__a").alias(start), F.max("__b").alias(end), F.first("__t").alias("__t"))
    return out.select(*keys, start, end, *[F.col("__t")[c].alias(c) for c in columns])


def within_spans(points: DataFrame, spans: DataFrame, keys: list[str], at: str, start: str, end: str, cell: int = 1 << 20) -> DataFrame:
    """Points with the spans [start, end) they lie in; joined on cells of the offset, so no side is scanned whole."""
    p = points.withColumn("__cell", F.floor(F.col(at) / cell))
    s = spans.withColumn("__cell", F.explode(F.sequence(F.floor(F.col(start) / cell), F.floor((F.col(end) - 1) / cell))))
    return p.join(s, [*keys, "__cell"]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("__cell")
