"""What is taken out of recordings: slices, endpoint streams, synchronisation maps, proofs of pieces, timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import Scan
from ..sources.recording import CORRUPT, DATA, SESSION


def slice_records(packets: DataFrame, first: int, end: int, note: str) -> DataFrame:
    """Records that begin in [first, end) of each capture, behind a session record that says where they come from."""
    part = packets.where((F.col("file_off") >= first) & (F.col("file_off") < end) & (F.col("rec_type") != CORRUPT))
    text = F.concat(F.lit(note), F.lit(f" bytes {first}..{end} of "), F.col("capture_id"))
    head = part.groupBy("capture_id").agg(F.lit(-1).cast("long").alias("file_off")).select(
        "capture_id", "file_off", F.lit(SESSION).cast("byte").alias("rec_type"), F.lit(0).cast("short").alias("endpoint"), F.lit(0).alias("pkt_index"),
        *[F.lit(0).cast("long").alias(c) for c in ("submit_seq", "status", "req_len")], F.octet_length(text).cast("long").alias("actual_len"), F.encode(text, "UTF-8").alias("payload"),
    )
    return head.unionByName(part)


def endpoint_stream(packets: DataFrame, endpoint: int) -> DataFrame:
    """One endpoint's payloads in order, for a binary writer: capture_id, file_off, payload."""
    return packets.where((F.col("rec_type") == DATA) & (F.col("endpoint") == endpoint)).select("capture_id", "file_off", "payload").orderBy("capture_id", "file_off")


def sync_map(units: DataFrame, resyncs: DataFrame) -> DataFrame:
    """Video units beside the audio sample that has their counter: capture_id, counter_extended, start_off, sample_ordinal."""
    first = resyncs.groupBy("capture_id", "counter_extended").agg(F.max_by("sample_ordinal", "pos").alias("sample_ordinal"))
    return units.where("counter_confirmed").join(first, ["capture_id", "counter_extended"], "left").select("capture_id", "counter_extended", "start_off", "sample_ordinal")


def audio_window(resyncs: DataFrame, first: int, end: int) -> DataFrame:
    """Samples from one counter to another, of captures that have exactly one resync for each: capture_id, from_sample, to_sample."""
    n = lambda c: F.sum((F.col("counter_extended") == c).cast("long"))
    at = lambda c: F.max(F.when(F.col("counter_extended") == c, F.col("sample_ordinal")))
    got = resyncs.where(F.col("counter_extended").isin(first, end)).groupBy("capture_id").agg(n(first).alias("__a"), n(end).alias("__b"), at(first).alias("from_sample"), at(end).alias("to_sample"))
    return got.where("__a = 1 AND __b = 1").drop("__a", "__b")


def resync_owners(blocks: DataFrame, resyncs: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of blocks that a resync belongs to: the one that holds its ordinal; in a gap, the ones before and after.

    blocks: keys, run, first and last ordinal; resyncs: keys, sample_ordinal.
    """
    b = blocks.select(*keys, F.col("first").alias("__o"), "run", F.col("last").alias("__last"), F.lit(0).alias("__ask"))
    r = resyncs.select(*keys, F.col("sample_ordinal").alias("__o"), F.lit(None).cast("long").alias("run"), F.lit(None).cast("long").alias("__last"), F.lit(1).alias("__ask"))
    line = b.unionByName(r).withColumn("__at", F.col("__o") * 2 + F.col("__ask"))
    behind = Scan(keys, "__at").last(__b=F.when(F.col("__ask") == 0, F.struct("run", "__last"))).over(line)
    # The next block: the last one seen in descending order.
    ahead = Scan(keys, "__down").last(__n=F.when(F.col("__ask") == 0, F.col("run"))).over(behind.withColumn("__down", -F.col("__at")))
    asked = ahead.where("__ask = 1")
    inside = F.col("__o") <= F.col("__b")["__last"]
    runs = F.when(inside, F.array(F.col("__b")["run"])).otherwise(F.array_compact(F.array_distinct(F.array(F.col("__b")["run"], F.col("__n")))))
    return asked.select(*keys, F.col("__o").alias("sample_ordinal"), runs.alias("runs"))


def proven(pieces: DataFrame, expected: DataFrame, key: str, payload: str = "payload", digest: str = "sha1") -> DataFrame:
    """Pieces with `proof`: same, differs, or unknown (nothing expected), by their SHA-1; expected pieces that are missing too."""
    found = pieces.select(key, F.sha1(payload).alias("__found"))
    both = found.join(expected.select(key, F.col(digest).alias("__want")), key, "full_outer")
    proof = F.when(F.col("__found").isNull(), "missing").when(F.col("__want").isNull(), "unknown").when(F.col("__found") == F.col("__want"), "same").otherwise("differs")
    return both.select(key, proof.alias("proof"))


def labelled_rows(labels: DataFrame, rows: DataFrame, index: str, content: str, digest: str) -> DataFrame:
    """Labels beside the rows they were made for; `intact` tells whether the row is still what was labelled."""
    return labels.join(rows.select(index, content), index).withColumn("intact", F.sha2(F.col(content), 256) == F.col(digest))


def fill_timeline(blocks: DataFrame, keys: list[str], order: str, pts: str, units_between: str, period: int = 8008) -> DataFrame:
    """Adds `slot`: output slots from the stream's start, each row's distance to the one before being its time's, or where that is unknown 1 and the units between."""
    seen = Scan(keys, order).lag(__p=F.col(pts)).running(__n=F.lit(1)).over(blocks)
    step = F.when(F.col("__n") == 1, 0).when(F.col(pts).isNull() | F.col("__p").isNull(), 1 + F.col(units_between)).otherwise(F.bround((F.col(pts) - F.col("__p")) / period)).cast("long")
    return Scan(keys, order).running(slot=step).over(seen).drop("__p", "__n")


def status_report(findings: DataFrame) -> DataFrame:
    """A capture's findings as one JSON text: capture_id, status."""
    return findings.groupBy("capture_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list(F.struct("finding", "n"))).alias("findings"))).alias("status"))
