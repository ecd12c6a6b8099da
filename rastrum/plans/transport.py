"""Transport proof of recordings: contiguity, losses, statistics, conservation, verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import Scan
from ..sources.recording import AUDIO, CORRUPT, DATA, HOST_LOSS, TICK, TRANSFER_ERROR, VIDEO

#: What reserved packet indices of loss and error records mean.
LOSS_KINDS = {0xFFFF: "submit_failure", 0xFFFE: "control_truth_lost", 0xFFFD: "unread", 0xFFFC: "unread_found_late", 0xFFFB: "spill_read_back", 0xFFFA: "unclosed", 0xFFF9: "hole"}
GAP, STATUS, LOSS, ERROR = 1, 2, 4, 8


def loss_kind() -> Column:
    """What a loss or error record reports; null for others."""
    kind = F.when(F.col("rec_type") == HOST_LOSS, "host_loss").when(F.col("rec_type") == TRANSFER_ERROR, "transfer_error")
    named = F.lit(None).cast("string")
    for index, name in LOSS_KINDS.items():
        only = (F.col("status") == 2**32 - 1) if name == "control_truth_lost" else F.lit(True)
        named = F.when((F.col("pkt_index") == index) & only, name).otherwise(named)
    return F.when(F.col("rec_type").isin(HOST_LOSS, TRANSFER_ERROR), F.coalesce(named, kind))


def positioned_losses(packets: DataFrame) -> DataFrame:
    """Loss records by the endpoint whose stream they interrupt: holes both, late findings none (they name an earlier transfer)."""
    rows = packets.where(F.col("rec_type").isin(HOST_LOSS, TRANSFER_ERROR)).withColumn("kind", loss_kind()).where("kind <> 'unread_found_late'")
    to = F.when(F.col("kind") == "hole", F.array(F.lit(VIDEO), F.lit(AUDIO))).otherwise(F.array(F.col("endpoint").cast("int")))
    return rows.withColumn("stream", F.explode(to))


def late_losses(packets: DataFrame) -> DataFrame:
    """Losses found after the data they precede, at the transfer they name: capture_id, endpoint, submit_seq, packets."""
    late = packets.withColumn("kind", loss_kind()).where("kind = 'unread_found_late'")
    return late.groupBy("capture_id", "endpoint", "submit_seq").agg(F.sum("req_len").alias("packets"))


def contiguity(packets: DataFrame, block: int = 64 << 20) -> DataFrame:
    """Data records with `flags`: GAP where a record doesn't follow the one before of its endpoint, STATUS where its own status isn't 0.

    A record follows if it is the same transfer's next packet, or packet 0 of the next
    transfer; the place moves on even after a gap, and the first record follows nothing.
    """
    data = packets.where(F.col("rec_type") == DATA)
    seen = Scan(["capture_id", "endpoint"], "file_off", block).lag(__seq=F.col("submit_seq"), __idx=F.col("pkt_index")).over(data)
    same = (F.col("submit_seq") == F.col("__seq")) & (F.col("pkt_index") == F.pmod(F.col("__idx") + 1, F.lit(65536)))
    next_ = (F.col("submit_seq") == F.col("__seq") + 1) & (F.col("pkt_index") == 0)
    gap = F.when(F.col("__seq").isNull() | same | next_, 0).otherwise(GAP)
    return seen.withColumn("flags", gap.bitwiseOR(F.when(F.col("status") != 0, STATUS).otherwise(0))).drop("__seq", "__idx")


def statistics(packets: DataFrame, packets_per_transfer: dict[int, int], block: int = 64 << 20) -> DataFrame:
    """Of each capture's endpoint: records, bytes, zero and short lengths, transfers, sequence gaps, inversions, index errors, status errors."""
    data = packets.where(F.col("rec_type") == DATA)
    seen = Scan(["capture_id", "endpoint"], "file_off", block).lag(__seq=F.col("submit_seq"), __idx=F.col("pkt_index")).over(data)
    per = F.coalesce(*[F.when(F.col("endpoint") == e, n) for e, n in packets_per_transfer.items()])
    first, step = F.col("__seq").isNull(), F.col("submit_seq") - F.col("__seq")
    new = first | (step != 0)
    # A transfer that ends early, and one that doesn't begin at packet 0 (which is off its expected place too).
    cut = F.when(~first & (step != 0) & (F.col("__idx") + 1 != per), 1).otherwise(0)
    begun = F.when(new & (F.col("pkt_index") != 0), 2).otherwise(0)
    within = F.when(~new & (F.col("pkt_index") != F.col("__idx") + 1), 1).otherwise(0)
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    got = seen.groupBy("capture_id", "endpoint").agg(
        F.count("*").alias("records"), F.sum("actual_len").alias("bytes"), n(F.col("actual_len") == 0).alias("zero_length"),
        n((F.col("actual_len") > 0) & (F.col("actual_len") < F.col("req_len"))).alias("short_payload"), n(new).alias("transfers"),
        F.sum(F.when(step > 1, step - 1).otherwise(0)).alias("sequence_gaps"), n(step < 0).alias("inversions"),
        F.sum((cut + begun + within).cast("long")).alias("index_errors"), n(F.col("status") != 0).alias("status_errors"),
        F.min("submit_seq").alias("first_seq"), F.max("submit_seq").alias("last_seq"), F.max_by("pkt_index", "file_off").alias("__last"),
    )
    unfinished = F.when(F.col("__last") + 1 != per, 1).otherwise(0)
    return got.withColumn("index_errors", F.col("index_errors") + unfinished).drop("__last")


def losses(packets: DataFrame) -> DataFrame:
    """Reported losses of each capture's endpoint: kind, records, packets, bytes."""
    rows = packets.where(F.col("rec_type").isin(HOST_LOSS, TRANSFER_ERROR)).withColumn("kind", loss_kind())
    lost = F.col("rec_type") == HOST_LOSS
    return rows.groupBy("capture_id", "endpoint", "kind").agg(F.count("*").alias("records"), F.sum(F.when(lost, F.col("req_len")).otherwise(0)).alias("packets"), F.sum(F.when(lost, F.col("actual_len")).otherwise(0)).alias("bytes"))


def record_types(packets: DataFrame) -> DataFrame:
    return packets.groupBy("capture_id", "rec_type").agg(F.count("*").alias("n"))


def corrupt_spans(packets: DataFrame) -> DataFrame:
    return packets.where(F.col("rec_type") == CORRUPT).select("capture_id", "file_off", F.col("actual_len").alias("bytes"))


def balance(packets: DataFrame) -> DataFrame:
    """Delivered and lost bytes and packets of each capture's endpoint: what went in is their sum."""
    data, lost = F.col("rec_type") == DATA, F.col("rec_type") == HOST_LOSS
    at = lambda c, x: F.sum(F.when(c, x).otherwise(F.lit(0)))
    return packets.where(data | lost).groupBy("capture_id", "endpoint").agg(
        at(data, F.lit(1)).alias("delivered_packets"), at(data, F.col("actual_len")).alias("delivered_bytes"), at(lost, F.col("req_len")).alias("lost_packets"), at(lost, F.col("actual_len")).alias("lost_bytes"),
    )


def verdict(packets: DataFrame, packets_per_transfer: dict[int, int]) -> DataFrame:
    """One row for each finding that speaks against a capture: capture_id, endpoint, finding, n. None: the transport is whole."""
    counted = statistics(packets, packets_per_transfer)
    against = ["zero_length", "sequence_gaps", "inversions", "index_errors", "status_errors"]
    stats = counted.select("capture_id", "endpoint", F.explode(F.array(*[F.struct(F.lit(c).alias("finding"), F.col(c).cast("long").alias("n")) for c in against])).alias("x")).select("capture_id", "endpoint", "x.*")
    lost = losses(packets).select("capture_id", "endpoint", F.col("kind").alias("finding"), F.col("records").alias("n"))
    broken = corrupt_spans(packets).groupBy("capture_id").agg(F.lit(None).cast("short").alias("endpoint"), F.lit("corrupt_bytes").alias("finding"), F.sum("bytes").alias("n"))
    return stats.unionByName(lost).unionByName(broken).where("n > 0")


def heartbeat(packets: DataFrame) -> DataFrame:
    """Ticks whose elapsed time went back: capture_id, file_off, elapsed_ms, before_ms."""
    seen = Scan(["capture_id"], "file_off", 64 << 20).lag(before_ms=F.col("status")).over(packets.where(F.col("rec_type") == TICK).select("capture_id", "file_off", "status"))
    return seen.where(F.col("status") < F.col("before_ms")).select("capture_id", "file_off", F.col("status").alias("elapsed_ms"), "before_ms")


def span_probe(packets: DataFrame, units: DataFrame) -> DataFrame:
    """First and last counter of each capture's confirmed units."""
    return units.where("counter_confirmed").groupBy("capture_id").agg(F.min_by("counter16", "start_off").alias("first_counter"), F.max_by("counter16", "start_off").alias("last_counter"))
