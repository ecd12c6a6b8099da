"""Aggregations: transport statistics, reconciliation, exact order statistics, confusion counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import Scan
from .sequence import sequence_gaps


def endpoint_stats(df: DataFrame, endpoint: str, sequence: str, zero: Column, short: Column, block: int | None = None) -> DataFrame:
    """Of each endpoint: records, first and last number, numbers skipped, inversions, zero-length and short records."""
    seen = sequence_gaps(df.withColumn("__zero", zero.cast("long")).withColumn("__short", short.cast("long")), [endpoint], sequence, sequence, block)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return seen.groupBy(endpoint).agg(
        F.count("*").alias("records"), F.min(sequence).alias("first_seq"), F.max(sequence).alias("last_seq"), total("missing").alias("seq_gaps"),
        total(F.col("inverted").cast("long")).alias("inversions"), total("__zero").alias("zero_length"), total("__short").alias("short_records"),
    )


def distinct_gaps(df: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """Numbers missing between least and greatest: keys, gaps."""
    return df.groupBy(*keys, sequence).agg(F.count("*").alias("__n")).groupBy(*keys).agg((F.max(sequence) - F.min(sequence) + 1 - F.count("*")).cast("long").alias("gaps"))


def conservation(parts: DataFrame, total: DataFrame, keys: list[str], kept: str, lost: str, whole: str) -> DataFrame:
    """keys, kept, lost, whole, balanced: delivered plus lost must equal the input, key by key."""
    return parts.join(total, keys, "full_outer").select(*keys, kept, lost, whole, (F.coalesce(kept, F.lit(0)) + F.coalesce(lost, F.lit(0))).eqNullSafe(F.col(whole)).alias("balanced"))


def _ranked(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Distinct values of each group with the number of rows below and at or below them: groups shrink to their distinct values first."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n"))
    upto = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    return counted.withColumn("__to", F.sum("__n").over(upto)).withColumn("__from", F.col("__to") - F.col("__n")).withColumn("__all", F.sum("__n").over(whole))


def order_statistic(df: DataFrame, keys: list[str], value: str, **places: str) -> DataFrame:
    """Values at 0-based places of each sorted group; a place is an SQL expression of `n`, such as `n div 2`."""
    ranked = _ranked(df, keys, value).withColumn("n", F.col("__all"))
    at = lambda e: F.max(F.when((F.expr(e) >= F.col("__from")) & (F.expr(e) < F.col("__to")), F.col(value)))
    return ranked.groupBy(*keys).agg(*[at(e).alias(k) for k, e in places.items()])


def upper_median(df: DataFrame, keys: list[str], value: str, name: str = "upper_median") -> DataFrame:
    """The element at n div 2 of each sorted group."""
    return order_statistic(df, keys, value, **{name: "n div 2"})


def timing_summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """v[n/2], v[n*95/100] and v[n-1] of each sorted group."""
    return order_statistic(df, keys, value, median="n div 2", p95="n * 95 div 100", largest="n - 1")


def quantiles(df: DataFrame, keys: list[str], value: str, **q: float) -> DataFrame:
    """Interpolated quantiles at (n - 1) * q."""
    ranked = _ranked(df, keys, value)
    aggs = []
    for name, x in q.items():
        h = (F.col("__all") - 1) * F.lit(x)
        for part, place in (("lo", F.floor(h)), ("hi", F.ceil(h))):
            aggs.append(F.max(F.when((place >= F.col("__from")) & (place < F.col("__to")), F.col(value))).alias(f"__{name}_{part}"))
    got = ranked.groupBy(*keys).agg(F.max("__all").alias("__all"), *aggs)
    for name, x in q.items():
        h = (F.col("__all") - 1) * F.lit(x)
        got = got.withColumn(name, F.col(f"__{name}_lo") + (F.col(f"__{name}_hi") - F.col(f"__{name}_lo")) * (h - F.floor(h)))
    return got.select(*keys, *q)


def mad_noise(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """1.4826 times the median distance from the median, 1 / sqrt(12) at least: keys, noise."""
    middle = quantiles(df, keys, value, __m=0.5)
    off = df.join(middle, keys).withColumn("__off", F.abs(F.col(value) - F.col("__m")))
    return quantiles(off, keys, "__off", __mad=0.5).select(*keys, F.greatest(F.lit(1.4826) * F.col("__mad"), F.lit(1 / 12**0.5)).alias("noise"))


def population(df: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """Mean, variance (never below 0) and deviation of integers, from exact sums."""
    x = value.cast("decimal(38,0)")
    got = df.groupBy(*keys).agg(F.count(value).alias("n"), F.sum(x).cast("double").alias("__s"), F.sum(x * x).cast("double").alias("__q"))
    mean = F.col("__s") / F.col("n")
    return got.withColumn("mean", mean).withColumn("variance", F.greatest(F.col("__q") / F.col("n") - mean * mean, F.lit(0.0))).withColumn("deviation", F.sqrt("variance")).drop("__s", "__q")


def pearson(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Correlation of integers from exact sums; 0 where either hardly varies."""
    a, b = F.col(x).cast("decimal(19,0)"), F.col(y).cast("decimal(19,0)")
    s = lambda c: F.sum(c).cast("double")
    got = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys).agg(F.count("*").cast("double").alias("n"), s(a).alias("sx"), s(b).alias("sy"), s(a * a).alias("sxx"), s(b * b).alias("syy"), s(a * b).alias("sxy"))
    vx, vy = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx"), F.col("n") * F.col("syy") - F.col("sy") * F.col("sy")
    small = F.col("n") * F.col("n") * 1e-18
    r = F.when((vx <= small) | (vy <= small), 0.0).otherwise((F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / F.sqrt(F.when(vx > 0, vx)) / F.sqrt(F.when(vy > 0, vy)))
    return got.select(*keys, r.alias("correlation"))


def supported_minimum(df: DataFrame, keys: list[str], value: str, share: float = 0.1) -> DataFrame:
    """The least value that at least `share` of a group's rows have: keys, supported."""
    counted = df.groupBy(*keys, value).agg(F.count("*").alias("__n")).withColumn("__all", F.sum("__n").over(Window.partitionBy(*keys)))
    return counted.where(F.col("__n") >= F.col("__all") * share).groupBy(*keys).agg(F.min(value).alias("supported"))


def modes(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The most frequent value of each group, the least of equals: keys, mode, n."""
    counted = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    return counted.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(value).alias("v"))).alias("__b")).select(*keys, F.col("__b")["v"].alias("mode"), (-F.col("__b")["m"]).alias("n"))


def top_counts(df: DataFrame, columns: list[str], k: int) -> DataFrame:
    """The k most frequent combinations, ties in order of the columns: columns, n."""
    return df.groupBy(*columns).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), *columns).limit(k)


def two_best(df: DataFrame, keys: list[str], score: str, tie: list[str]) -> DataFrame:
    """Best and runner-up score of each group; ties by the columns given. Two rows of a group leave each task."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(score, *tie))
    kept = df.select(*keys, score, place.alias("__place")).where("__place <= 2")
    return kept.groupBy(*keys).agg(*[F.max(F.when(F.col("__place") == n, F.col(score))).alias(name) for n, name in ((1, "best"), (2, "second"))])


def conservation_laws(totals: DataFrame, keys: list[str], laws: dict[str, tuple[list[str], list[str]]]) -> DataFrame:
    """Laws that don't hold: keys, law, left, right. laws: name -> (columns, columns) whose sums must be equal; no row means all hold."""
    total = lambda columns: sum((F.coalesce(c, F.lit(0)).cast("long") for c in columns), F.lit(0).cast("long"))
    checks = F.array(*[F.struct(F.lit(name).alias("law"), total(a).alias("left"), total(b).alias("right")) for name, (a, b) in laws.items()])
    return totals.select(*keys, F.inline(checks)).where("left <> right")


#: What a recording's totals must satisfy.
LAWS = {
    "input bytes": (["delivered_bytes", "lost_bytes"], ["input_bytes"]),
    "eligible units": (["exact_units", "ring_drops"], ["eligible_units"]),
    "exact units": (["published", "pool_drops", "publisher_drops"], ["exact_units"]),
    "audio frames": (["pcm_records"], ["audio_published"]),
    "audio delivery": (["audio_published"], ["audio_delivered", "audio_dropped"]),
}


def misregistration(frames: DataFrame, keys: list[str], still: str, shift: str, ratio: str, least_still: float = 0.05, most_ratio: float = 0.8) -> DataFrame:
    """Histogram of reweave shifts: keys, shift, measurable, misregistered, share (of all measurable frames of the key that are misregistered).

    Measurable frames have over `least_still` of still picture; of those one is misregistered if another shift than 0 combs less than `most_ratio` as much.
    """
    wrong = (F.col(shift) != 0) & (F.col(ratio) < most_ratio)
    by = frames.where(F.col(still) > least_still).groupBy(*keys, F.col(shift).alias("shift")).agg(F.count("*").alias("measurable"), F.sum(wrong.cast("long")).alias("misregistered"))
    whole = Window.partitionBy(*keys)  # a few shifts a key
    return by.withColumn("share", F.sum("misregistered").over(whole) / F.sum("measurable").over(whole))


def late_handoffs(timing: DataFrame, keys: list[str], order: str, at: str, spent: list[str], limit: int, block: int | None = None) -> DataFrame:
    """Handoffs over `limit` after the one before, and where the time went: keys, late, worst (of all handoffs), each of `spent`, other (what none accounts for)."""
    scan = Scan(keys, order, block) if block else Scan(keys, order)
    seen = scan.lag(__before=F.col(at)).over(timing).withColumn("__gap", F.col(at) - F.col("__before"))
    late = F.col("__gap") > limit
    known = sum((F.coalesce(c, F.lit(0)) for c in spent), F.lit(0).cast("long"))
    total = lambda c: F.coalesce(F.sum(F.when(late, c)), F.lit(0)).cast("long")
    return seen.groupBy(*keys).agg(total(F.lit(1)).alias("late"), F.max("__gap").alias("worst"), *[total(F.col(c)).alias(c) for c in spent], total(F.greatest(F.col("__gap") - known, F.lit(0))).alias("other"))


def envelope(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Least and greatest value of each group, null without any: keys, least, greatest."""
    return df.groupBy(*keys).agg(F.min(value).alias("least"), F.max(value).alias("greatest"))


def confusion(df: DataFrame, keys: list[str], truth: Column, said: Column) -> DataFrame:
    """Counts, sensitivity, specificity, accuracy; null where a share is undefined."""
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    got = df.groupBy(*keys).agg(n(truth & said).alias("tp"), n(~truth & said).alias("fp"), n(truth & ~said).alias("fn"), n(~truth & ~said).alias("tn"))
    of = lambda a, b: F.try_divide(a, b)
    return got.withColumn("sensitivity", of(F.col("tp"), F.col("tp") + F.col("fn"))).withColumn("specificity", of(F.col("tn"), F.col("tn") + F.col("fp"))).withColumn("accuracy", of(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")))


def phase_histogram(df: DataFrame, micros: Column, period: int = 1_000_000, width: int = 100_000) -> DataFrame:
    """Events by their phase in a period: bin, n."""
    return df.groupBy(F.floor(F.pmod(micros, F.lit(period)) / width).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def tile_extents(df: DataFrame, key: str, values: str, tile: int, least: float) -> DataFrame:
    """Share of an array's tiles whose range is `least` or more: key, active_tiles, tiles."""
    starts = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / tile).cast("int"))
    ranges = F.transform(starts, lambda i: F.array_max(F.slice(values, i * tile + 1, tile)) - F.array_min(F.slice(values, i * tile + 1, tile)))
    return df.select(key, F.size(F.filter(ranges, lambda r: r >= least)).cast("long").alias("active_tiles"), F.size(ranges).cast("long").alias("tiles"))
