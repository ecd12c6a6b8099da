"""Audio blocks: stretches of contiguous samples as they are published, with their flags.

A block ends at a resync, where it is full, and where its segment ends. What a break or a counter's gap has to say
lands on the next block that holds samples. Nothing goes sample by sample: blocks are intervals between cuts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ticks import TICKS_PER_SAMPLE, TICKS_PER_UNIT
from .ordered import Scan

#: Samples of a full block; flags of a block.
FULL = 4096
DISCONTINUITY, PARTIAL, UNANCHORED, COUNTER_GAP = 1, 2, 4, 8


def audio_blocks(resyncs: DataFrame, segments: DataFrame, keys: list[str], full: int = FULL, block: int | None = None) -> DataFrame:
    """keys, segment, sample_ordinal, n_frames, flags, last_resync_counter, pts_num (ticks), run.

    resyncs: keys, segment, sample_ordinal (of the sample after it), counter_extended, discontinuity; segments: keys, segment (rising),
    first_ordinal, samples. A segment's samples are contiguous; the first resync of a segment fixes its times.
    """
    scan = lambda order: Scan(keys, order, block) if block else Scan(keys, order)
    none = F.lit(None).cast("long")
    begins = segments.select(*keys, "segment", F.col("first_ordinal").alias("at"), none.alias("counter"), F.lit(False).alias("broken"), (F.col("first_ordinal") + F.col("samples")).alias("until"))
    marks = resyncs.select(*keys, "segment", F.col("sample_ordinal").alias("at"), F.col("counter_extended").alias("counter"), F.coalesce("discontinuity", F.lit(False)).alias("broken"), none.alias("until"))
    # In order: by sample, then segment (empty ones share a sample), a segment's begin before its resyncs, resyncs at one sample by counter.
    ranked = begins.unionByName(marks).groupBy(*keys, "at").agg(F.array_sort(F.collect_list(F.struct("segment", F.coalesce("counter", F.lit(-1)).alias("__c"), "counter", "broken", "until"))).alias("__all"))
    cuts = ranked.select(*keys, "at", F.posexplode("__all").alias("__i", "__c")).select(*keys, "at", "__c.segment", "__c.counter", "__c.broken", "__c.until", (F.col("at") * 256 + F.col("__i")).alias("__o"))
    first = F.col("counter").isNull()
    seen = scan("__o").lag(__was=F.struct("counter", "segment")).lead(__next=F.struct("at", "segment")).last(__until=F.col("until")).over(cuts)
    inside = F.col("__next")["segment"].eqNullSafe(F.col("segment"))
    seen = seen.withColumn("n", F.when(inside, F.col("__next")["at"]).otherwise(F.col("__until")) - F.col("at"))
    gap = ~first & (F.col("broken") | (F.col("__was")["counter"].isNotNull() & (F.col("counter") != F.col("__was")["counter"] + 1)))
    # The first segment of a stream follows nothing.
    says = F.when(first & F.col("__was").isNotNull(), DISCONTINUITY).when(gap, COUNTER_GAP).otherwise(0)
    seen = seen.withColumn("__says", says).withColumn("__run", F.when(~first & F.col("__was")["counter"].isNull(), 1).otherwise(0))
    # Cuts without samples hand what they say on to the next that has some.
    held = scan("__o").running(__blocks=(F.col("n") > 0).cast("long"), run=F.col("__run")).last(__anchor=F.when(F.col("__run") == 1, F.struct("counter", "at"))).over(seen)
    held = held.withColumn("__of", F.col("__blocks") - (F.col("n") > 0).cast("long"))
    pending = held.groupBy(*keys, "__of").agg(F.bit_or("__says").alias("__flags"))
    pending = pending.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__of").alias("__k_of"), "__flags")
    on = held["__of"] == pending["__k_of"]
    for k in keys:
        on = on & held[k].eqNullSafe(pending[f"__k_{k}"])
    flagged = held.where("n > 0").join(pending, on)
    parts = flagged.withColumn("__i", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {full}"))))
    ordinal, frames = F.col("at") + F.col("__i") * full, F.least(F.lit(full).cast("long"), F.col("n") - F.col("__i") * full)
    flags = F.when(F.col("__i") == 0, F.col("__flags")).otherwise(0).bitwiseOR(F.when(frames == full, PARTIAL).otherwise(0)).bitwiseOR(F.when(first, UNANCHORED).otherwise(0))
    pts = F.when(first, ordinal * TICKS_PER_SAMPLE).otherwise(F.col("__anchor")["counter"] * TICKS_PER_UNIT + (ordinal - F.col("__anchor")["at"]) * TICKS_PER_SAMPLE)
    return parts.select(*keys, "segment", ordinal.alias("sample_ordinal"), frames.alias("n_frames"), flags.cast("int").alias("flags"), F.coalesce("counter", F.lit(0)).alias("last_resync_counter"), pts.alias("pts_num"), "run")


def resync_residuals(resyncs: DataFrame, keys: list[str]) -> DataFrame:
    """Least and greatest distance of a resync's counter time from the time its segment's first resync gives it, in ticks; null where only first ones are. keys, least, greatest."""
    first = resyncs.groupBy(*keys, "segment").agg(F.min(F.struct("sample_ordinal", "counter_extended")).alias("__a")).withColumnsRenamed({k: f"__k_{k}" for k in keys} | {"segment": "__k_s"})
    on = resyncs["segment"].eqNullSafe(first["__k_s"])
    for k in keys:
        on = on & resyncs[k].eqNullSafe(first[f"__k_{k}"])
    time = F.col("__a")["counter_extended"] * TICKS_PER_UNIT + (F.col("sample_ordinal") - F.col("__a")["sample_ordinal"]) * TICKS_PER_SAMPLE
    later = F.col("sample_ordinal") > F.col("__a")["sample_ordinal"]
    off = F.when(later, F.col("counter_extended") * TICKS_PER_UNIT - time)
    return resyncs.join(first, on).groupBy(*[resyncs[k] for k in keys]).agg(F.min(off).alias("least"), F.max(off).alias("greatest"))
