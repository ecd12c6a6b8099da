"""Audits of decision logs: summary, unexplained gaps, problems and notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ticks import actions
from ..operators.ordered import Scan

#: Reasons that say the host lost a unit, not the device; a range marker that is no unit.
HOST_REASONS = ("PoolFull", "PublisherFull", "RingFullTail", "Hole")
RANGE_MARKER = "RingFullTail"


def log_gaps(log: DataFrame, keys: list[str], order: str, block: int = 1_000_000) -> DataFrame:
    """Jumps of the published counter: keys, before, after, missing, covered (rows or ring drops in between explain it)."""
    marker = F.coalesce(F.col("drop_reason") == RANGE_MARKER, F.lit(False))
    shown = ~marker & F.coalesce(F.col("published") == 1, F.lit(False)) & (F.col("counter_extended") >= 0)
    hidden = (marker | ~F.coalesce(F.col("published") == 1, F.lit(False))).cast("long")
    seen = Scan(keys, order, block).running(__hidden=hidden).over(log.withColumn("__shown", shown)).where("__shown")
    near = Scan(keys, order, block).lag(before=F.col("counter_extended"), __before=F.col("__hidden")).over(seen)
    covered = (F.col("__hidden") > F.col("__before")) | (F.coalesce("preceding_ring_drops", F.lit(0)) > 0)
    jump = F.col("counter_extended") != F.col("before") + 1
    return near.where(jump).select(*keys, "before", F.col("counter_extended").alias("after"), F.greatest(F.col("counter_extended") - F.col("before") - 1, F.lit(0)).alias("missing"), covered.alias("covered"))


def log_summary(log: DataFrame, keys: list[str]) -> DataFrame:
    """Rows, published, lost by the host, held back for the device's framing, ring drops, resets, audio steps, epochs."""
    marker = F.coalesce(F.col("drop_reason") == RANGE_MARKER, F.lit(False))
    hidden = ~marker & ~F.coalesce(F.col("published") == 1, F.lit(False))
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    return log.groupBy(*keys).agg(
        F.count("*").alias("rows"), n(~marker & (F.col("published") == 1)).alias("published"), n(hidden & F.col("drop_reason").isin(*HOST_REASONS)).alias("host_lost"),
        n(hidden & ~F.coalesce(F.col("drop_reason").isin(*HOST_REASONS), F.lit(False))).alias("device_framed"), F.sum(F.coalesce("preceding_ring_drops", F.lit(0))).alias("ring_drops"),
        n(~marker & (F.col("reset_before") == 1)).alias("resets"), n(~marker & (F.coalesce("audio_step_samples", F.lit(0)) != 0)).alias("audio_steps"), F.countDistinct(F.when(~marker & (F.col("epoch") != 0), F.col("epoch"))).alias("epochs"),
    )


def problems(log: DataFrame, keys: list[str], order: str) -> DataFrame:
    """keys, problem, n: what speaks against a log; none if it is whole."""
    s = log_summary(log, keys)
    told = s.select(*keys, F.explode(F.array(F.struct(F.lit("host_lost").alias("problem"), F.col("host_lost").alias("n")), F.struct(F.lit("ring_drops").alias("problem"), F.col("ring_drops").alias("n")), F.struct(F.lit("epochs").alias("problem"), F.greatest(F.col("epochs") - 1, F.lit(0).cast("long")).alias("n")))).alias("x")).select(*keys, "x.*")
    gaps = log_gaps(log, keys, order).where("NOT covered").groupBy(*keys).agg(F.lit("unexplained_gaps").alias("problem"), F.count("*").alias("n"))
    return told.unionByName(gaps).where("n > 0")


def usable_placements(log: DataFrame, keys: list[str], counter: str = "counter_extended", d1: str = "applied_d1", d2: str = "applied_d2", strict: bool = True) -> DataFrame:
    """Log rows with a counter: keys, counter, d1, d2 and `use`: placed, empty (a distance is missing) or repeated (several rows have the counter).

    strict: a repeated counter raises, and only placed rows come out.
    """
    rows = log.where(F.col(counter).isNotNull()).groupBy(*keys, counter).agg(F.count("*").alias("__n"), F.min(d1).alias(d1), F.min(d2).alias(d2))
    use = F.when(F.col("__n") > 1, "repeated").when(F.col(d1).isNull() | F.col(d2).isNull(), "empty").otherwise("placed")
    told = rows.withColumn("use", use)
    if strict:
        told = told.withColumn("use", F.when(F.col("use") == "repeated", F.raise_error(F.concat(F.lit("the log repeats counter "), F.col(counter).cast("string")))).otherwise(F.col("use"))).where("use = 'placed'")
    return told.select(*keys, counter, d1, d2, "use")


#: First line of each field at no displacement, rows of a published picture.
ORIGINS, WOVEN_ROWS = {1: 23, 2: 286}, 480


def repair_ticks(log: DataFrame, keys: list[str], tokens: dict[int, str], offsets: dict[int, str]) -> DataFrame:
    """Rows of published pictures that retiming moved or filled: keys, field, line, action, row, finding.

    tokens, offsets: of each field, the columns with its `line:action` tokens and its displacement. Only actions R and I name rows; C and U come
    with a null row. finding: null, or what is wrong with a token (an unknown action, a repeated line, a row outside the picture).
    """
    parts = []
    for field in (1, 2):
        told = log.select(*keys, F.lit(field).alias("field"), F.col(offsets[field]).cast("int").alias("__d"), F.posexplode(actions(F.col(tokens[field]))).alias("__i", "__t"))
        parts.append(told.select(*keys, "field", "__d", "__i", "__t.line", "__t.action"))
    every = parts[0].unionByName(parts[1])
    # Tokens of one cell: some hundred at most.
    seen = F.count("*").over(Window.partitionBy(*keys, "field", "line"))
    at = 2 * (F.col("line") - F.when(F.col("field") == 1, ORIGINS[1]).otherwise(ORIGINS[2]) - F.col("__d")) + F.col("field") - 1
    shown = F.col("action").isin("R", "I")
    rows = every.withColumn("__n", seen).withColumn("row", F.when(shown, at).cast("int"))
    wrong = F.when(F.col("line").isNull() | ~F.col("action").isin("R", "I", "U", "C"), "unknown action").when(F.col("__n") > 1, "repeated line").when((F.col("row") < 0) | (F.col("row") >= WOVEN_ROWS), "outside the picture")
    return rows.select(*keys, "field", "line", "action", "row", wrong.alias("finding"))


def strip_audit(strips: DataFrame, log: DataFrame) -> DataFrame:
    """What strips read from a rendering say against the decision log: at (place in the rendering, or null), counter, finding.

    strips: place (0, 1, ...), ordinal, counter, d1, d2. log: counter_extended, published, frame_top_unit, pairing, frame_d1, frame_d2, applied_d1,
    applied_d2, f2_unused. Findings: ordinal (not its place), fill (a frame the log doesn't have, at no displacement), nonzero fill, pairing
    (the first field's unit isn't the one its pairing names), placement, same; of counters without a strip: missing; of several strips of one: repeated,
    out of order (a frame before one with a smaller counter); of log rows: log repeats, unpublished, boundary (a unit that no frame needs), unexplained.
    """
    units = log.where("counter_extended IS NOT NULL")
    counted = units.groupBy("counter_extended").agg(F.count("*").alias("n"), F.min("published").alias("published"))
    bad = counted.where("n > 1 OR NOT coalesce(published = 1, false)").select(F.lit(None).cast("long").alias("at"), F.col("counter_extended").alias("counter"), F.when(F.col("n") > 1, "log repeats").otherwise("unpublished").alias("finding"))
    once = units.dropDuplicates(["counter_extended"])
    frames = once.where("frame_top_unit IS NOT NULL").select(F.col("counter_extended").alias("__c"), F.col("frame_top_unit").alias("__top"), "pairing", "frame_d1", "frame_d2", F.col("applied_d2").alias("__own2"))
    tops = once.select(F.col("counter_extended").alias("__t"), F.col("applied_d1").alias("__own1"))
    known = frames.join(tops, F.col("__top") == F.col("__t"), "left")
    joined = strips.join(known, strips["counter"] == known["__c"], "left")
    still = (F.col("d1") == 0) & (F.col("d2") == 0)
    paired = F.col("__t").isNotNull() & (F.col("__top") == F.col("counter") + (F.col("pairing") == "reversed").cast("long"))
    placed = (F.col("d1") == F.col("frame_d1")) & (F.col("d2") == F.col("frame_d2")) & F.col("__own1").eqNullSafe(F.col("frame_d1")) & F.col("__own2").eqNullSafe(F.col("frame_d2"))
    said = F.when(F.col("ordinal") != F.col("place"), "ordinal").when(F.col("__c").isNull(), F.when(still, "fill").otherwise("nonzero fill")).when(~paired, "pairing").when(~F.coalesce(placed, F.lit(False)), "placement").otherwise("same")
    each = joined.select(F.col("place").alias("at"), "counter", said.alias("finding"), F.col("__c").isNotNull().alias("__frame"))
    none = F.lit(None).cast("long").alias("at")
    missing = frames.join(strips, frames["__c"] == strips["counter"], "left_anti").select(none, F.col("__c").alias("counter"), F.lit("missing").alias("finding"))
    repeated = each.where("__frame").groupBy("counter").agg(F.count("*").alias("n")).where("n > 1").select(none, "counter", F.lit("repeated").alias("finding"))
    order = Scan([], "at").highest_before(__top=F.col("counter")).over(each.where("__frame")).where("counter < __top").select("at", "counter", F.lit("out of order").alias("finding"))
    spare = once.where("frame_top_unit IS NULL").select(none, F.col("counter_extended").alias("counter"), F.when((F.col("pairing") == "reversed") & (F.col("f2_unused") == 1), "boundary").otherwise("unexplained").alias("finding"))
    return each.drop("__frame").unionByName(missing).unionByName(repeated).unionByName(order).unionByName(bad).unionByName(spare)
