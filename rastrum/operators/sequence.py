"""Ordered-stream operators: unwrapping, gaps, runs, hysteresis, attribution, anchors, votes.

Each takes a table, the columns that name a stream (`keys`, such as capture and epoch) and
the integer column that orders it, and works on recordings and plain tables alike. Time is
in ticks of 1/240000 s; a null is a value that was not measured.
"""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.ticks import TICKS_PER_SAMPLE, TICKS_PER_UNIT
from .ordered import Scan, with_halo

WRAP = 65536


def unwrap_counter(df: DataFrame, keys: list[str], order: str, counter: str, block: int | None = None) -> DataFrame:
    """Adds `extended` and `discontinuity` for a counter that wraps at 2**16.

    The first row's extended value is its counter. A step of 1 to 0x7FFF advances by itself;
    one of 0 or 0x8000 and over, which no forward step explains, advances by 1; any step but 1
    is a discontinuity.
    """
    step = F.pmod(F.col(counter) - F.col("__prev"), F.lit(WRAP))
    seen = _scan(keys, order, block).lag(__prev=F.col(counter)).over(df)
    seen = seen.withColumn("__step", F.when(F.col("__prev").isNull(), F.col(counter)).when((step == 0) | (step >= WRAP // 2), 1).otherwise(step).cast("long"))
    seen = seen.withColumn("discontinuity", F.coalesce(F.when(F.col("__prev").isNotNull(), step != 1), F.lit(False)))
    return _scan(keys, order, block).running(extended=F.col("__step")).over(seen).drop("__prev", "__step")


def _scan(keys: list[str], order: str, block: int | None) -> Scan:
    return Scan(keys, order, block) if block else Scan(keys, order)


def sequence_gaps(df: DataFrame, keys: list[str], order: str, sequence: str, block: int | None = None) -> DataFrame:
    """Adds `missing` (numbers skipped before the row) and `inverted` (the number did not rise)."""
    seen = _scan(keys, order, block).lag(__prev=F.col(sequence)).over(df)
    step = F.col(sequence) - F.col("__prev")
    return seen.withColumn("missing", F.coalesce(F.greatest(step - 1, F.lit(0)), F.lit(0)).cast("long")).withColumn("inverted", F.coalesce(step <= 0, F.lit(False))).drop("__prev")


#: Numbers that one row stands for while a gap is spread.
GAP_ROWS = 65_536


def absent_rows(df: DataFrame, keys: list[str], sequence: str, block: int | None = None) -> DataFrame:
    """One row (keys, sequence) for each number that is missing between two that are there; a wide gap is spread in two steps, so no row holds all of it."""
    seen = _scan(keys, sequence, block).lag(__prev=F.col(sequence)).over(df.select(*keys, sequence))
    gaps = seen.where(F.col(sequence) - F.col("__prev") > 1).withColumn("__last", F.col(sequence) - 1)
    parts = gaps.select(*keys, "__last", F.explode(F.sequence(F.col("__prev") + 1, "__last", F.lit(GAP_ROWS).cast("long"))).alias("__from"))
    return parts.select(*keys, F.explode(F.sequence("__from", F.least("__last", F.col("__from") + GAP_ROWS - 1))).alias(sequence))


def consecutive_runs(df: DataFrame, keys: list[str], sequence: str, block: int | None = None) -> DataFrame:
    """Runs of consecutive numbers: keys, first, last, n."""
    seen = _scan(keys, sequence, block).lag(__prev=F.col(sequence)).over(df.select(*keys, sequence))
    opened = F.coalesce((F.col(sequence) - F.col("__prev") != 1).cast("long"), F.lit(1))
    numbered = _scan(keys, sequence, block).running(__run=opened).over(seen)
    return numbered.groupBy(*keys, "__run").agg(F.min(sequence).alias("first"), F.max(sequence).alias("last"), F.count("*").alias("n")).drop("__run")


def islands(df: DataFrame, keys: list[str], order: str, value: Column, name: str = "run", block: int | None = None) -> DataFrame:
    """Adds a number for each run of equal values (nulls equal nulls), from 1."""
    seen = _scan(keys, order, block).lag(__prev=F.struct(value.alias("v"))).over(df)
    opened = (~F.col("__prev")["v"].eqNullSafe(value) | F.col("__prev").isNull()).cast("long")
    return _scan(keys, order, block).running(**{name: opened}).over(seen).drop("__prev")


def hysteresis(df: DataFrame, keys: list[str], order: str, label: str, needed: Column, at_once: Column | None = None, block: int | None = None) -> DataFrame:
    """Adds `stable`: the latest label whose run had reached `needed` rows; null before the first.

    needed may depend on the row's label; at_once: rows whose label installs without a run.
    """
    seen = _scan(keys, order, block).lag(__prev=F.struct(F.col(label).alias("v"))).running(__n=F.lit(1)).over(df)
    changed = F.col("__prev").isNull() | ~F.col("__prev")["v"].eqNullSafe(F.col(label))
    # A row's place in its run is its row number less that of the run's first row.
    begun = _scan(keys, order, block).last(__first=F.when(changed, F.col("__n"))).over(seen)
    installs = (F.col("__n") - F.col("__first") + 1 >= needed) | (at_once if at_once is not None else F.lit(False))
    return _scan(keys, order, block).last(stable=F.when(installs, F.col(label))).over(begun).drop("__prev", "__n", "__first")


def transitions(df: DataFrame, keys: list[str], order: str, state: str, block: int | None = None) -> DataFrame:
    """Adds `previous` and `changed`: the state on the row before, and whether it differs."""
    seen = _scan(keys, order, block).lag(previous=F.col(state)).over(df)
    return seen.withColumn("changed", ~F.col("previous").eqNullSafe(F.col(state)))


def unsettled_intervals(df: DataFrame, keys: list[str], order: str, opens: Column, settles: Column, block: int | None = None) -> DataFrame:
    """Adds `interval`: number of the unsettled interval a row lies in, null outside.

    A row that opens starts one unless one is open; a row that settles ends it after itself.
    """
    mark = F.when(opens, F.lit(1)).when(settles, F.lit(0))
    seen = _scan(keys, order, block).last(__now=mark).over(df)
    seen = _scan(keys, order, block).lag(__was=F.col("__now")).over(seen)
    fresh = opens & (F.coalesce("__was", F.lit(0)) == 0)
    seen = _scan(keys, order, block).running(__id=fresh.cast("long")).over(seen)
    inside = (F.col("__now") == 1) | (settles & (F.coalesce("__was", F.lit(0)) == 1))
    return seen.withColumn("interval", F.when(inside, F.col("__id"))).drop("__now", "__was", "__id")


def loss_runs(df: DataFrame, keys: list[str], order: str, lost: Column, packets: Column, nbytes: Column, block: int | None = None) -> DataFrame:
    """Contiguous lost rows as one record each: keys, first, last, packets, bytes."""
    numbered = islands(df.withColumn("__lost", lost), keys, order, F.col("__lost"), "__run", block)
    return numbered.where("__lost").groupBy(*keys, "__run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.sum(packets).alias("packets"), F.sum(nbytes).alias("bytes")).drop("__run")


def split_records(runs: DataFrame, column: str = "bytes", most: int = 2**32 - 1) -> DataFrame:
    """Records whose count exceeds a field's range, as several that sum to it (`part` from 0)."""
    parts = F.greatest(F.ceil(F.col(column) / most), F.lit(1)).cast("long")
    cut = runs.withColumn("__n", parts).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)))
    return cut.withColumn(column, F.least(F.lit(most), F.col(column) - F.col("part") * most).cast("long")).drop("__n")


def drops_before(df: DataFrame, keys: list[str], order: str, dropped: Column, block: int | None = None) -> DataFrame:
    """The retained rows with `preceding_drops`, rows dropped since the one before; plus one tail row a stream with drops at its end (null order)."""
    seen = _scan(keys, order, block).running(__drops=dropped.cast("long")).over(df.withColumn("__dropped", dropped))
    kept = _scan(keys, order, block).lag(__before=F.col("__drops")).over(seen.where(~F.col("__dropped")))
    rows = kept.withColumn("preceding_drops", F.col("__drops") - F.coalesce("__before", F.lit(0))).drop("__before")
    tail = seen.groupBy(*keys).agg(F.max("__drops").alias("__all"), F.coalesce(F.max(F.when(~F.col("__dropped"), F.col("__drops"))), F.lit(0)).alias("__seen")).where("__all > __seen")
    tail = tail.select(*keys, (F.col("__all") - F.col("__seen")).alias("preceding_drops"))
    return rows.drop("__drops", "__dropped").unionByName(tail, allowMissingColumns=True)


def anchors(df: DataFrame, keys: list[str], order: str, counter: str, ordinal: str, breaks: Column, block: int | None = None) -> DataFrame:
    """Audio anchoring: adds `run`, `pts_ticks` and `residual_ticks` to resync rows.

    The first resync of a run fixes its time (counter * 8008) and ordinal; sample n lies at
    pts0 + (n - ord0) * 5; a later resync's residual is its counter's time less that. A break
    (hole, unframed bytes, epoch) ends the run before the row.
    """
    seen = _scan(keys, order, block).running(run=breaks.cast("long"), __n=F.lit(1)).over(df)
    begins = F.when(breaks | (F.col("__n") == 1), F.struct(F.col(counter).alias("c"), F.col(ordinal).alias("o")))
    first = _scan(keys, order, block).last(__first=begins).over(seen)
    pts = F.col("__first")["c"] * TICKS_PER_UNIT + (F.col(ordinal) - F.col("__first")["o"]) * TICKS_PER_SAMPLE
    return first.withColumn("pts_ticks", pts).withColumn("residual_ticks", F.col(counter) * TICKS_PER_UNIT - F.col("pts_ticks")).drop("__first", "__n")


def residual_steps(df: DataFrame, keys: list[str], order: str, residual: str, block: int | None = None) -> DataFrame:
    """Adds `step_samples`: the change of the residual in samples, rounded, if over 6 ticks; else null.

    keys must name the run too: a step is one within an epoch and a run.
    """
    seen = _scan(keys, order, block).lag(__prev=F.col(residual)).over(df)
    change = F.col(residual) - F.col("__prev")
    step = F.signum(change).cast("long") * F.expr(f"(abs({residual} - __prev) + 2) div 5")
    return seen.withColumn("step_samples", F.when(F.abs(change) > 6, step)).drop("__prev")


#: Rows of a block of a rolling operator.
ROLLING_BLOCK = 200_000


def _votes(votes: list, rows: int) -> Iterator[tuple[int, set, object]]:
    """For each vote in order: how often the most frequent of the last `rows` votes occurs, which do so, and which one wins without an anchor."""
    held, count = deque(), Counter()
    for v in votes:
        if v is not None:
            held.append(v)
            count[v] += 1
            if len(held) > rows:
                old = held.popleft()
                count[old] -= 1
                if not count[old]:
                    del count[old]
        most = max(count.values(), default=0)
        best = {x for x, n in count.items() if n == most} if most else set()
        yield most, best, v if v in best else next((x for x in held if x in best), None)


def rolling_vote(df: DataFrame, keys: list[str], order: str, vote: str, rows: int = 30, block: int = ROLLING_BLOCK) -> DataFrame:
    """Adds `winner` and `winner_count`: the most frequent of the last `rows` votes.

    Among equals the winner of the row before stays if it is one of them, else the latest vote's value wins, else the
    one first in the window. A null neither votes nor moves the winner, which is 0 before any vote.

    Blocks are counted by themselves. As the winner before a block isn't known there, each block first tells what
    becomes of every winner it may be given (at most `rows` values matter, any other falls at once); these tables, a row
    a block, are applied one after the other, and then the blocks are counted again.
    """
    # Nulls don't vote, so the halo is counted in votes.
    voting = with_halo(df.where(F.col(vote).isNotNull()).select(*keys, order, vote), keys, order, rows, block)
    columns = [*keys, "__block"]

    def told(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by(order)
        halo = sum(t.column("__halo").to_pylist())
        # Winners that the block may be given, each with what it has become; None: any other one.
        became: dict = {}
        for n, (_, best, fresh) in enumerate(_votes(t.column(vote).to_pylist(), rows)):
            if n == halo:
                became = {None: None} | {x: x for x in best}
            if n >= halo:
                became = {a: x if x in best else fresh for a, x in became.items()}
        names, end = list(became), [became[x] for x in became]
        return pa.table({c: pa.array([k.as_py()], t.schema.field(c).type) for c, k in zip(columns, key, strict=True)} | {"given": pa.array([names], pa.list_(pa.int64())), "becomes": pa.array([end], pa.list_(pa.int64()))})

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in voting.select(*columns).schema.fields)
    blocks = voting.groupBy(*columns).applyInArrow(told, f"{ddl}, given array<bigint>, becomes array<bigint>")

    def chained(key: tuple, t: pa.Table) -> pa.Table:
        t, winner, out = t.sort_by("__block"), 0, []
        for given, becomes in zip(t.column("given").to_pylist(), t.column("becomes").to_pylist(), strict=True):
            out.append(winner)
            table = dict(zip(given, becomes, strict=True))
            winner = table.get(winner, table.get(None, winner))
        return t.select(columns).append_column("__winner", pa.array(out, pa.int64()))

    before = _by(blocks, keys).applyInArrow(chained, f"{ddl}, __winner bigint")
    marked = voting.join(before, _same_keys(voting, before, columns)).select(*[voting[c] for c in voting.columns], "__winner")

    def counted(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by(order)
        halo, winner = t.column("__halo").to_pylist(), t.column("__winner")[0].as_py()
        winners, counts, keep = [], [], [not h for h in halo]
        for h, (most, best, fresh) in zip(halo, _votes(t.column(vote).to_pylist(), rows), strict=True):
            if not h:
                winner = winner if winner in best else fresh
            winners.append(winner)
            counts.append(most)
        t = t.select([*keys, order]).append_column("winner", pa.array(winners, pa.int64())).append_column("winner_count", pa.array(counts, pa.int64()))
        return t.filter(pa.array(keep))

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys, order).schema.fields)
    voted = marked.groupBy(*columns).applyInArrow(counted, f"{own}, winner bigint, winner_count bigint")
    joined = df.join(voted, _same_keys(df, voted, [*keys, order]), "left").select(*[df[c] for c in df.columns], voted["winner"].alias("__w"), voted["winner_count"].alias("__c"))
    # Rows that don't vote keep the winner of the last that did.
    seen = Scan(keys, order).last(winner=F.col("__w"), winner_count=F.col("__c")).over(joined)
    return seen.select(*df.columns, F.coalesce("winner", F.lit(0)).alias("winner"), F.coalesce("winner_count", F.lit(0)).alias("winner_count"))


def _by(df: DataFrame, keys: list[str]):
    """Rows of each stream; all of them, where there is one stream only."""
    return df.groupBy(*keys) if keys else df.withColumn("__all", F.lit(0)).groupBy("__all")


def _same_keys(a: DataFrame, b: DataFrame, columns: list[str]) -> Column:
    on = F.lit(True)
    for c in columns:
        on = on & a[c].eqNullSafe(b[c])
    return on


def _rolled(df: DataFrame, keys: list[str], order: str, rows: int, block: int) -> tuple[DataFrame, WindowSpec]:
    window = Window.partitionBy(*keys, "__block").orderBy(order).rowsBetween(-(rows - 1), 0)
    return with_halo(df, keys, order, rows - 1, block), window


def rolling_median(df: DataFrame, keys: list[str], order: str, value: str, rows: int = 15, block: int = ROLLING_BLOCK) -> DataFrame:
    """Adds `median` of the last `rows` rows; readings that aren't valid are filtered before."""
    held, window = _rolled(df, keys, order, rows, block)
    held = held.withColumn("__held", F.array_sort(F.collect_list(value).over(window))).withColumn("__n", F.size("__held")).where("NOT __halo")
    middle = (F.element_at("__held", F.expr("(__n - 1) div 2 + 1").cast("int")) + F.element_at("__held", F.expr("__n div 2 + 1").cast("int"))) / 2
    return held.withColumn("median", middle).select(*df.columns, "median")


def change_chatter(df: DataFrame, keys: list[str], order: str, changed: str, rows: int = 30, most: int = 4, block: int = ROLLING_BLOCK) -> DataFrame:
    """Adds `changes` among the last `rows` rows and `chattering` (`most` or more of them)."""
    held, window = _rolled(df, keys, order, rows, block)
    held = held.withColumn("changes", F.sum(F.col(changed).cast("long")).over(window)).where("NOT __halo")
    return held.withColumn("chattering", F.col("changes") >= most).select(*df.columns, "changes", "chattering")


def armed_at(df: DataFrame, keys: list[str], order: str, stable: Column, needed: int = 3, block: int | None = None) -> DataFrame:
    """Where a stream may be trusted from: the first row of the first run of `needed` stable rows. keys, armed."""
    return failing_streaks(df, keys, order, stable, needed, block).groupBy(*keys).agg(F.min("first").alias("armed"))


def failing_streaks(df: DataFrame, keys: list[str], order: str, failed: Column, least: int, block: int | None = None, time: Column | None = None) -> DataFrame:
    """Streaks of `least` or more failing rows: keys, first, last, n. With a time: streaks that last `least` or longer, and how long they do."""
    held = df.withColumn("__failed", F.coalesce(failed, F.lit(False))).withColumn("__time", F.lit(None).cast("long") if time is None else time)
    numbered = islands(held, keys, order, F.col("__failed"), "__run", block)
    streaks = numbered.where("__failed").groupBy(*keys, "__run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"), (F.max("__time") - F.min("__time")).alias("lasted"))
    if time is None:
        return streaks.where(F.col("n") >= least).drop("__run", "lasted")
    return streaks.where(F.col("lasted") >= least).drop("__run")


def monotonic_times(df: DataFrame, keys: list[str], order: str, known: str, nominal: int, block: int | None = None) -> DataFrame:
    """Adds `time` and `estimated`: times that only rise. An unknown one (null) is `nominal` after the one before (0 if it is the first), one
    that doesn't rise is 1 after it.

    With c the sum of the steps (1 at known rows, `nominal` at others), time less c never falls, so it is a running maximum.
    """
    step = F.when(F.col(known).isNull(), F.lit(nominal)).otherwise(F.lit(1))
    summed = _scan(keys, order, block).running(__c=step, __n=F.lit(1)).over(df)
    start = F.when(F.col(known).isNotNull(), F.col(known) - F.col("__c")).when(F.col("__n") == 1, -F.col("__c"))
    risen = _scan(keys, order, block).highest(__top=start).over(summed)
    return risen.select(*df.columns, (F.col("__top") + F.col("__c")).alias("time"), F.col(known).isNull().alias("estimated"))


def unread_slots(df: DataFrame, keys: list[str], order: str, now: str, length: int, lead: int = 4, block: int | None = None) -> DataFrame:
    """Adds `start`, `queue_end` and `gap`: when each submitted transfer is scheduled, and the slots before it that nothing reads.

    A transfer starts `lead` after the present slot or where the queue ends, if that is later, and takes `length` slots; so the
    queue's end less what the transfers so far take is a running maximum.
    """
    numbered = _scan(keys, order, block).running(__n=F.lit(1)).over(df)
    free = F.col(now) + lead - (F.col("__n") - 1) * length
    seen = _scan(keys, order, block).highest(__top=free).highest_before(__was=free).over(numbered)
    start, queued = F.col("__top") + (F.col("__n") - 1) * length, F.col("__was") + (F.col("__n") - 1) * length
    return seen.select(*df.columns, start.alias("start"), (start + length).alias("queue_end"), F.coalesce(start - queued, F.lit(0)).alias("gap"))


def settled_doubts(df: DataFrame, keys: list[str], order: str, late: str, doubtful: Column, slot: int, least: int, watch: int = 40, block: int = ROLLING_BLOCK) -> DataFrame:
    """Which doubtful submissions left a transfer that was never delivered: keys, order, slots.

    Such a phantom makes every later completion late, a late callback only some: the least lateness of the `watch` completions from the
    doubt's own on tells its slots (nothing up to `least`), less what earlier doubts have taken already.
    """
    turned = df.withColumn("__back", -F.col(order))
    window = Window.partitionBy(*keys, "__block").orderBy("__back").rowsBetween(-(watch - 1), 0)
    ahead = with_halo(turned, keys, "__back", watch - 1, block).withColumn("__least", F.min(late).over(window)).where("NOT __halo")
    told = ahead.where(doubtful).withColumn("__slots", F.when(F.col("__least") > least, F.expr(f"(__least + {slot // 2}) div {slot}")).otherwise(0))
    seen = Scan(keys, order).highest_before(__was=F.col("__slots")).over(told.select(*keys, order, "__slots"))
    return seen.select(*keys, order, F.greatest(F.col("__slots") - F.coalesce("__was", F.lit(0)), F.lit(0)).cast("long").alias("slots"))


def nearest_slots(df: DataFrame, keys: list[str], time: str, period: int = TICKS_PER_UNIT) -> DataFrame:
    """Adds `slot`, the nearest multiple of the period after the stream's first time (halves to even), and keeps the nearest row of each slot."""
    first = df.groupBy(*keys).agg(F.min(time).alias("__t0"))
    x = (F.col(time) - F.col("__t0")) / period
    placed = (df.join(first, keys) if keys else df.join(F.broadcast(first))).withColumn("slot", F.bround(x).cast("long")).withColumn("__off", F.abs(x - F.col("slot")))
    rest = [c for c in df.columns if c not in keys]
    best = placed.groupBy(*keys, "slot").agg(F.min(F.struct("__off", time, *[c for c in rest if c != time])).alias("__b"))
    return best.select(*keys, "slot", *[F.col("__b")[c].alias(c) for c in rest])


def merge_spans(df: DataFrame, keys: list[str], start: str, end: str, block: int | None = None) -> DataFrame:
    """Spans that overlap or touch, merged: keys, start, end, n."""
    # Spans with one start overlap: one row each, so that starts are an order.
    rows = df.groupBy(*keys, start).agg(F.max(end).alias(end), F.count("*").alias("n"))
    seen = _scan(keys, start, block).highest_before(__reach=F.col(end)).over(rows)
    opened = F.coalesce((F.col(start) > F.col("__reach")).cast("long"), F.lit(1))
    numbered = _scan(keys, start, block).running(__id=opened).over(seen)
    return numbered.groupBy(*keys, "__id").agg(F.min(start).alias(start), F.max(end).alias(end), F.sum("n").alias("n")).drop("__id")


@dataclass
class Floor:
    """A latency floor that falls at once and rises slowly, and the windows in a row that lay far over it."""

    step: int
    needed: int
    most_drift: int
    value: int | None = None
    high: int = 0

    def window(self, least: int) -> int | None:
        """Takes a window's least latency; how far the floor has shifted for good, if this window shows it."""
        self.value = least if self.value is None else min(self.value, least)
        rise = least - self.value
        over = rise > self.step
        self.high = self.high + 1 if over else 0
        shifted = self.high >= self.needed
        if shifted:
            self.value, self.high = least, 0
        elif not over:
            self.value += min(rise, self.most_drift)
        return rise if shifted else None


def floor_shifts(df: DataFrame, keys: list[str], order: str, late: str, window: int = 16, step: int = 2_000_000, needed: int = 3, most_drift: int = 50_000) -> DataFrame:
    """Where the floor of a latency moved for good: keys, order (of the window's last row), shift.

    Windows of `window` rows are reduced to their least value in parallel; `needed` of them in a row whose least lies
    over the floor by more than `step` are a shift, and the floor moves there. Only that goes window by window.
    """
    numbered = Scan(keys, order).running(__n=F.lit(1)).over(df.select(*keys, order, late))
    least = numbered.groupBy(*keys, F.expr(f"(__n - 1) div {window}").alias("__window")).agg(F.min(late).alias("least"), F.max(order).alias(order), F.count("*").alias("__rows")).where(F.col("__rows") == window)

    def run(key: tuple, t: pa.Table) -> pa.Table:
        t, floor = t.sort_by("__window"), Floor(step, needed, most_drift)
        shifts = pa.array([floor.window(x) for x in t.column("least").to_pylist()], pa.int64())
        return t.select([*keys, order]).append_column("shift", shifts).filter(shifts.is_valid())

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys, order).schema.fields)
    return _by(least, keys).applyInArrow(run, f"{ddl}, shift bigint")
