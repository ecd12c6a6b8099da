"""What is taken out of recordings and proven of them, and the machines' queries, each beside SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ticks
from ..operators import joins, meter, raster
from . import extract, transport
from .catalogue import _PACKETS, events, packets, query, table
from .catalogue_pictures import _LUMA, units

# --- losses and proofs of transport --------------------------------------------------------------------

#: Records of all kinds: two endpoints, losses of every kind, ticks.
_KINDS = """
WITH p AS (SELECT event_id AS file_off, CASE event_id % 29 WHEN 3 THEN 1 WHEN 5 THEN 2 WHEN 7 THEN 4 ELSE 0 END AS rec_type, CASE WHEN user_id % 3 = 0 THEN 132 ELSE 131 END AS endpoint,
  65529 + event_id % 8 AS pkt_index, event_id // 16 AS submit_seq, CASE WHEN event_id % 29 = 7 THEN event_id * 3 - user_id ELSE 4294967295 END AS status, event_id % 400 AS req_len, CAST(floor(value) AS BIGINT) AS actual_len FROM events),
k AS (SELECT *, CASE WHEN rec_type IN (1, 2) THEN CASE pkt_index WHEN 65535 THEN 'submit_failure' WHEN 65534 THEN 'control_truth_lost' WHEN 65533 THEN 'unread' WHEN 65532 THEN 'unread_found_late' WHEN 65531 THEN 'spill_read_back' WHEN 65530 THEN 'unclosed' WHEN 65529 THEN 'hole'
  ELSE CASE rec_type WHEN 1 THEN 'host_loss' ELSE 'transfer_error' END END END AS kind FROM p)
"""


def _kinds(spark, sf_dir):
    e, i = events(spark, sf_dir, "event_id", "user_id", "value"), F.col("event_id")
    kind = F.when(i % 29 == 3, 1).when(i % 29 == 5, 2).when(i % 29 == 7, 4).otherwise(0)
    return e.select(
        F.lit("events").alias("capture_id"), i.alias("file_off"), kind.cast("byte").alias("rec_type"), F.when(F.col("user_id") % 3 == 0, 132).otherwise(131).cast("short").alias("endpoint"), (65529 + i % 8).cast("int").alias("pkt_index"),
        F.expr("event_id div 16").alias("submit_seq"), F.when(i % 29 == 7, i * 3 - F.col("user_id")).otherwise(4294967295).cast("long").alias("status"), (i % 400).cast("long").alias("req_len"), F.floor("value").cast("long").alias("actual_len"), F.lit(None).cast("binary").alias("payload"),
    )


@query(_KINDS + "SELECT file_off, kind, CAST(unnest(CASE WHEN kind = 'hole' THEN [131, 132] ELSE [endpoint] END) AS INTEGER) AS stream FROM k WHERE rec_type IN (1, 2) AND kind <> 'unread_found_late'")
def loss_routing(spark, sf_dir):
    """Loss records by the stream they interrupt."""
    return transport.positioned_losses(_kinds(spark, sf_dir)).select("file_off", "kind", F.col("stream").cast("int").alias("stream"))


@query(_KINDS + "SELECT CAST(endpoint AS BIGINT) AS endpoint, submit_seq, CAST(sum(req_len) AS BIGINT) AS packets FROM k WHERE kind = 'unread_found_late' GROUP BY 1, 2")
def late_losses(spark, sf_dir):
    return transport.late_losses(_kinds(spark, sf_dir)).select(F.col("endpoint").cast("long").alias("endpoint"), "submit_seq", "packets")


@query(_KINDS + ", t AS (SELECT file_off, status, lag(status) OVER (ORDER BY file_off) AS before_ms FROM k WHERE rec_type = 4) SELECT file_off, status AS elapsed_ms, before_ms FROM t WHERE status < before_ms")
def heartbeats_back(spark, sf_dir):
    return transport.heartbeat(_kinds(spark, sf_dir)).drop("capture_id")


@query(_PACKETS + """, s AS (SELECT endpoint, submit_seq, pkt_index, actual_len, status, ps, pi, ps IS NULL OR submit_seq <> ps AS fresh FROM d),
n AS (SELECT endpoint, CAST(sum(CASE WHEN actual_len = 0 THEN 1 ELSE 0 END) AS BIGINT) AS zero_length, CAST(sum(CASE WHEN submit_seq - ps > 1 THEN submit_seq - ps - 1 ELSE 0 END) AS BIGINT) AS sequence_gaps, CAST(sum(CASE WHEN submit_seq < ps THEN 1 ELSE 0 END) AS BIGINT) AS inversions, CAST(sum(CASE WHEN status <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS status_errors FROM s GROUP BY endpoint)
SELECT CAST(endpoint AS BIGINT) AS endpoint, 'zero_length' AS finding, zero_length AS n FROM n WHERE zero_length > 0 UNION ALL SELECT endpoint, 'sequence_gaps', sequence_gaps FROM n WHERE sequence_gaps > 0 UNION ALL SELECT endpoint, 'inversions', inversions FROM n WHERE inversions > 0
UNION ALL SELECT endpoint, 'status_errors', status_errors FROM n WHERE status_errors > 0 UNION ALL SELECT endpoint, 'host_loss', count(*) FROM p WHERE rec_type = 1 GROUP BY endpoint""")
def transport_findings(spark, sf_dir):
    """What speaks against a recording's transport (but for packet indices, which this one doesn't have in order)."""
    got = transport.verdict(packets(spark, sf_dir), {131: 16, 132: 16}).where("finding <> 'index_errors'")
    return got.select(F.col("endpoint").cast("long").alias("endpoint"), "finding", "n")


# --- pieces, labels, spans, owners -----------------------------------------------------------------------


@query("""
WITH e AS (SELECT doc_id AS piece, sha1(CASE WHEN doc_id % 9 = 4 THEN concat(text, '!') ELSE text END) AS want FROM documents WHERE doc_id % 7 <> 2 AND text IS NOT NULL UNION ALL SELECT doc_id + 100000000, sha1('') FROM documents WHERE doc_id % 50 = 1),
f AS (SELECT doc_id AS piece, sha1(text) AS found FROM documents WHERE text IS NOT NULL)
SELECT coalesce(f.piece, e.piece) AS piece, CASE WHEN found IS NULL THEN 'missing' WHEN want IS NULL THEN 'unknown' WHEN found = want THEN 'same' ELSE 'differs' END AS proof FROM f FULL JOIN e ON f.piece = e.piece""")
def proven_pieces(spark, sf_dir):
    """Texts as pieces whose digests were noted before: some have changed, some are missing, of some nothing was noted."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("piece"), F.col("text").cast("binary").alias("payload"))
    i = F.col("piece")
    noted = docs.where(i % 7 != 2).select("piece", F.sha1(F.when(i % 9 == 4, F.concat("payload", F.lit(b"!"))).otherwise(F.col("payload"))).alias("sha1"))
    gone = docs.where(i % 50 == 1).select((i + 100_000_000).alias("piece"), F.sha1(F.lit(b"")).alias("sha1"))
    return extract.proven(docs, noted.unionByName(gone), "piece")


@query("SELECT l.doc_id, l.quality, sha256(d.text) = sha256(CASE WHEN l.doc_id % 11 = 3 THEN 'x' ELSE d.text END) AS intact FROM labels l JOIN documents d ON d.doc_id = l.doc_id")
def labelled_texts(spark, sf_dir):
    """Labels beside the texts they were made for, as far as those are still the same."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = table(spark, sf_dir, "labels").select("doc_id", "quality").join(docs, "doc_id").select("doc_id", "quality", F.sha2(F.when(F.col("doc_id") % 11 == 3, "x").otherwise(F.col("text")), 256).alias("sha256"))
    return extract.labelled_rows(made, docs, "doc_id", "text", "sha256").select("doc_id", "quality", "intact")


@query("""
WITH s AS (SELECT user_id, event_id * 50 AS a, event_id * 50 + 40 + user_id AS b FROM events WHERE event_type = 'error'), p AS (SELECT user_id, event_id, event_id * 50 + 20 AS spot FROM events)
SELECT p.user_id, p.event_id, s.a FROM p JOIN s ON s.user_id = p.user_id AND p.spot >= s.a AND p.spot < s.b""")
def span_members(spark, sf_dir):
    """Byte offsets and the spans they lie in."""
    e, i = events(spark, sf_dir, "user_id", "event_id", "event_type"), F.col("event_id")
    spans = e.where("event_type = 'error'").select("user_id", (i * 50).alias("a"), (i * 50 + 40 + F.col("user_id")).alias("b"))
    return joins.within_spans(e.select("user_id", "event_id", (i * 50 + 20).alias("spot")), spans, ["user_id"], "spot", "a", "b", cell=4096).select("user_id", "event_id", "a")


@query("""
WITH b AS (SELECT user_id, event_id * 10 AS first, event_id * 10 + 3 + event_id % 5 AS last, event_id // 64 AS run FROM events WHERE event_type <> 'error'), r AS (SELECT user_id, event_id * 10 + 2 AS o FROM events WHERE event_id % 3 = 0),
n AS (SELECT r.user_id, r.o, max(b.first) FILTER (WHERE b.first <= r.o) AS f0, min(b.first) FILTER (WHERE b.first > r.o) AS f1 FROM r LEFT JOIN b ON b.user_id = r.user_id GROUP BY 1, 2),
o AS (SELECT n.*, x.run AS r0, x.last AS l0, y.run AS r1 FROM n LEFT JOIN b x ON x.user_id = n.user_id AND x.first = n.f0 LEFT JOIN b y ON y.user_id = n.user_id AND y.first = n.f1)
SELECT user_id, o AS sample_ordinal, array_to_string(CASE WHEN o <= l0 THEN [r0] WHEN r0 = r1 THEN [r0] ELSE list_filter([r0, r1], lambda x: x IS NOT NULL) END, ',') AS runs FROM o""")
def resync_owners(spark, sf_dir):
    """Runs of blocks that a resync belongs to."""
    e, i = events(spark, sf_dir, "user_id", "event_id", "event_type"), F.col("event_id")
    blocks = e.where("event_type <> 'error'").select("user_id", (i * 10).alias("first"), (i * 10 + 3 + i % 5).alias("last"), F.expr("event_id div 64").alias("run"))
    got = extract.resync_owners(blocks, e.where(i % 3 == 0).select("user_id", (i * 10 + 2).alias("sample_ordinal")), ["user_id"])
    return got.select("user_id", "sample_ordinal", F.array_join("runs", ",").alias("runs"))


@query("""
WITH r AS (SELECT user_id AS capture_id, event_id % 40 AS c, event_id * 3 AS o FROM events), n AS (SELECT capture_id, count(*) FILTER (WHERE c = 5) AS a, count(*) FILTER (WHERE c = 9) AS b, max(o) FILTER (WHERE c = 5) AS from_sample, max(o) FILTER (WHERE c = 9) AS to_sample FROM r GROUP BY 1)
SELECT capture_id, from_sample, to_sample FROM n WHERE a = 1 AND b = 1""")
def audio_windows(spark, sf_dir):
    """Samples between two counters, of captures that have each once."""
    r = events(spark, sf_dir, "user_id", "event_id").select(F.col("user_id").alias("capture_id"), (F.col("event_id") % 40).alias("counter_extended"), (F.col("event_id") * 3).alias("sample_ordinal"))
    return extract.audio_window(r, 5, 9)


@query("""
WITH b AS (SELECT user_id, event_id, CASE WHEN event_type <> 'view' THEN event_id * 4000 + CAST(floor(value) AS BIGINT) END AS pts, event_id % 3 AS between FROM events),
s AS (SELECT *, lag(pts) OVER w AS p, row_number() OVER w AS k FROM b WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
t AS (SELECT *, CASE WHEN k = 1 THEN 0 WHEN pts IS NULL OR p IS NULL THEN 1 + between ELSE CAST(round_even((pts - p) / 8008.0, 0) AS BIGINT) END AS step FROM s)
SELECT user_id, event_id, CAST(sum(step) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS slot FROM t""".replace("between", "gaps"))
def timeline_slots(spark, sf_dir):
    e, i = events(spark, sf_dir, "user_id", "event_id", "event_type", "value"), F.col("event_id")
    blocks = e.select("user_id", "event_id", F.when(F.col("event_type") != "view", i * 4000 + F.floor("value").cast("long")).alias("pts"), (i % 3).alias("gaps"))
    return extract.fill_timeline(blocks, ["user_id"], "event_id", "pts", "gaps").select("user_id", "event_id", "slot")


@query(_PACKETS + """SELECT file_off, CAST(rec_type AS BIGINT) AS rec_type, CAST(NULL AS VARCHAR) AS note FROM p WHERE file_off >= 100 AND file_off < 900 UNION ALL SELECT -1, 3, 'slice bytes 100..900 of events'""")
def sliced_records(spark, sf_dir):
    """Records of a stretch, behind one that says where they come from."""
    got = extract.slice_records(packets(spark, sf_dir), 100, 900, "slice")
    return got.select("file_off", F.col("rec_type").cast("long").alias("rec_type"), F.decode("payload", "UTF-8").alias("note"))


@query("""
WITH u AS (SELECT event_id, event_id // 3 AS c, event_id % 5 <> 1 AS sure FROM events), r AS (SELECT event_id // 4 AS c, event_id * 7 AS o, event_id AS pos FROM events WHERE event_type = 'view'), f AS (SELECT c, arg_max(o, pos) AS o FROM r GROUP BY c)
SELECT u.c AS counter_extended, u.event_id AS start_off, f.o AS sample_ordinal FROM u LEFT JOIN f ON f.c = u.c WHERE sure""")
def sync_maps(spark, sf_dir):
    """Video units beside the audio sample that has their counter."""
    e, i, one = events(spark, sf_dir, "event_id", "event_type"), F.col("event_id"), F.lit("a").alias("capture_id")
    u = e.select(one, F.expr("event_id div 3").alias("counter_extended"), i.alias("start_off"), (i % 5 != 1).alias("counter_confirmed"))
    r = e.where("event_type = 'view'").select(one, F.expr("event_id div 4").alias("counter_extended"), (i * 7).alias("sample_ordinal"), i.alias("pos"))
    return extract.sync_map(u, r).drop("capture_id")


# --- scalar functions of logs ------------------------------------------------------------------------------


@query("""
SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(event_id % 7 AS DOUBLE) + 0.5 END AS total, CASE WHEN event_id % 3 = 0 THEN CAST(event_id AS VARCHAR) ELSE event_id || '-' || (event_id + event_id % 3) END AS label,
  (event_id % 8) | ((user_id % 4) << 3) | ((event_id % 2) << 5) AS mode, CAST(round_even((event_id * 1000000.0 / 48 - 700) / 65536, 0) AS BIGINT) AS wraps, round(20 * log10(value + 1), 6) AS db,
  CASE WHEN value = 0 THEN CASE WHEN user_id = 0 THEN 1.0 ELSE CAST('inf' AS DOUBLE) END ELSE round(user_id / value, 6) END AS ratio, greatest(0, least(1, value / 60)) AS share FROM events""")
def log_functions(spark, sf_dir):
    """Number lists, run labels, mode words, wraps from byte counts, decibels, ratios, shares."""
    e, i, u = events(spark, sf_dir, "event_id", "user_id", "value"), F.col("event_id"), F.col("user_id")
    cell = F.when(i % 5 == 0, " ").otherwise(F.concat(F.lit(" "), (i % 7).cast("string"), F.lit("  0.5")))
    return e.select(
        "event_id", F.aggregate(ticks.number_list(cell), F.lit(0.0), lambda a, x: a + x).alias("total"), ticks.run_label(i, i + i % 3).alias("label"), ticks.mode_word([(i % 8, 0), (u % 4, 3), (i % 2, 5)]).alias("mode"),
        ticks.wrap_count(i * 1_000_000, F.lit(700), 48).alias("wraps"), ticks.rounded(ticks.decibels(F.col("value") + 1), 6).alias("db"), ticks.rounded(ticks.energy_ratio(u, F.col("value")), 6).alias("ratio"), ticks.clamp(F.col("value") / 60, 0.0, 1.0).alias("share"),
    )


@query("""
WITH w AS (SELECT user_id, event_id, value, value + user_id AS other FROM events WHERE value > 1),
m AS (SELECT user_id, event_id, quantile_cont(value, 0.5) OVER o AS n1, quantile_cont(other, 0.5) OVER o AS n2 FROM w WINDOW o AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 14 PRECEDING AND CURRENT ROW))
SELECT user_id, event_id, round(n1, 6) AS noise1, round(n2, 6) AS noise2, round(n2 / n1, 6) AS ratio, round(20 * log10(219 / n1), 6) AS snr1, round(20 * log10(219 / n2), 6) AS snr2 FROM m""")
def meter_windows(spark, sf_dir):
    """Medians of the last fifteen readings of both fields, their ratio and signal-to-noise ratios."""
    e = events(spark, sf_dir, "user_id", "event_id", "value").where("value > 1").withColumn("other", F.col("value") + F.col("user_id"))
    got = meter.window_readings(e, ["user_id"], "event_id", "value", "other")
    return got.select("user_id", "event_id", *[F.round(c, 6).alias(c) for c in ("noise1", "noise2", "ratio", "snr1", "snr2")])


# --- edges of pictures ---------------------------------------------------------------------------------------


@query(f"""
WITH k AS (SELECT CAST(n_nationkey AS BIGINT) AS u FROM nation), f AS (SELECT unnest([1, 2]) AS field),
p AS (SELECT u, field, r, sum({_LUMA}) AS n FROM k, f, (SELECT unnest(range(0, 525)) AS r), (SELECT unnest(range(0, 720)) AS x) GROUP BY 1, 2, 3),
b AS (SELECT u, field, quantile_cont({_LUMA}, 0.5) AS blank FROM k, f, (SELECT unnest(range(0, 525)) AS r), (SELECT unnest(range(0, 720)) AS x) WHERE r >= 7 + 263 * (field - 1) AND r < 16 + 263 * (field - 1) GROUP BY 1, 2),
c AS (SELECT u, field, r, x, {_LUMA} AS y FROM k, f, (SELECT unnest(range(0, 525)) AS r), (SELECT unnest(range(20, 699)) AS x) WHERE r >= 247 + 263 * (field - 1) AND r < 259 + 263 * (field - 1)),
s AS (SELECT u, field, r, x, sum(y) OVER (PARTITION BY u, field, r ORDER BY x ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS n FROM c),
o AS (SELECT s.u, s.field, s.r, count(*) FILTER (WHERE s.n > 8 * (b.blank + 12)) AS lit FROM s JOIN b ON b.u = s.u AND b.field = s.field WHERE s.x < 692 GROUP BY 1, 2, 3)
SELECT b.u AS counter_extended, CAST(b.field AS INTEGER) AS field, CAST(blank AS DOUBLE) AS blank, CAST(coalesce((SELECT max(r) + 4 FROM o WHERE o.u = b.u AND o.field = b.field AND lit >= 8), 0) AS INTEGER) AS bottom FROM b""")
def field_edges(spark, sf_dir):
    """Blanking level and the last line of each field that is lit."""
    g = raster.geometry(units(spark, sf_dir, "nation", "n_nationkey"), ["capture_id"])
    both = F.explode(F.array(F.struct(F.lit(1).alias("field"), F.col("f1.blank").alias("blank"), F.col("f1.bottom").alias("bottom")), F.struct(F.lit(2).alias("field"), F.col("f2.blank").alias("blank"), F.col("f2.bottom").alias("bottom"))))
    return g.select("counter_extended", both.alias("f")).select("counter_extended", "f.field", "f.blank", "f.bottom")
