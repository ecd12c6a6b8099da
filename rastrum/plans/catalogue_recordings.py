"""More operators as queries, those on clocks, audio blocks, logs and identity strips, each beside SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ticks
from ..operators import audio, framing, joins, sequence, stats
from . import audit
from .catalogue import events, query, table

# --- clocks ---------------------------------------------------------------------------------------------


@query("""
WITH RECURSIVE e AS (SELECT user_id, event_id, CASE WHEN event_type <> 'view' THEN event_id * 100 - CAST(floor(value * 40) AS BIGINT) END AS known, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
r AS (SELECT user_id, event_id, k, coalesce(known, 0) AS time, known IS NULL AS estimated FROM e WHERE k = 1
  UNION ALL SELECT e.user_id, e.event_id, e.k, greatest(coalesce(e.known, r.time + 8008), r.time + 1), e.known IS NULL FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)
SELECT user_id, event_id, CAST(time AS BIGINT) AS time, estimated FROM r""")
def monotonic_clock(spark, sf_dir):
    e = events(spark, sf_dir, "user_id", "event_id", "event_type", "value")
    known = e.select("user_id", "event_id", F.when(F.col("event_type") != "view", F.col("event_id") * 100 - F.floor(F.col("value") * 40).cast("long")).alias("known"))
    return sequence.monotonic_times(known, ["user_id"], "event_id", "known", 8008).select("user_id", "event_id", "time", "estimated")


@query("""
WITH RECURSIVE e AS (SELECT user_id, event_id, event_id // 4 AS now, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
r AS (SELECT user_id, event_id, k, now + 4 AS start, now + 4 + 16 AS queue_end, CAST(0 AS BIGINT) AS gap FROM e WHERE k = 1
  UNION ALL SELECT e.user_id, e.event_id, e.k, greatest(e.now + 4, r.queue_end), greatest(e.now + 4, r.queue_end) + 16, greatest(e.now + 4, r.queue_end) - r.queue_end FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)
SELECT user_id, event_id, start, queue_end, gap FROM r""")
def unread_slots(spark, sf_dir):
    """Each event a submitted transfer of 16 slots: when it is scheduled, and what nothing reads before it."""
    e = events(spark, sf_dir, "user_id", "event_id").withColumn("now", F.expr("event_id div 4"))
    return sequence.unread_slots(e, ["user_id"], "event_id", "now", 16).select("user_id", "event_id", "start", "queue_end", "gap")


@query("""
WITH e AS (SELECT event_type, event_id, CAST(floor(value * 100) AS BIGINT) + event_id // 500 * 2000 AS late, event_id % 97 = 3 AS doubt FROM events),
m AS (SELECT *, min(late) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 39 FOLLOWING) AS least FROM e),
s AS (SELECT event_type, event_id, CASE WHEN least > 1500 THEN (least + 500) // 1000 ELSE 0 END AS slots FROM m WHERE doubt)
SELECT event_type, event_id, CAST(greatest(slots - coalesce(max(slots) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS BIGINT) AS slots FROM s""")
def settled_doubts(spark, sf_dir):
    e = events(spark, sf_dir, "event_type", "event_id", "value").withColumn("late", F.floor(F.col("value") * 100).cast("long") + F.expr("event_id div 500 * 2000"))
    return sequence.settled_doubts(e, ["event_type"], "event_id", "late", F.col("event_id") % 97 == 3, 1000, 1500)


@query("""
WITH RECURSIVE n AS (SELECT event_type, event_id, CAST(floor(value * 1000) AS BIGINT) + CASE WHEN event_id // 700 % 2 = 1 THEN 3000000 ELSE 0 END AS late, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 16 AS w FROM events),
m AS (SELECT event_type, w, min(late) AS least, max(event_id) AS event_id FROM n GROUP BY 1, 2 HAVING count(*) = 16),
r AS (SELECT event_type, w, event_id, least AS floor, 0 AS high, CAST(NULL AS BIGINT) AS shift FROM m WHERE w = 0
  UNION ALL SELECT m.event_type, m.w, m.event_id,
    CASE WHEN m.least - least(r.floor, m.least) <= 2000000 THEN least(r.floor, m.least) + least(m.least - least(r.floor, m.least), 50000) WHEN r.high + 1 >= 3 THEN m.least ELSE r.floor END,
    CASE WHEN m.least - least(r.floor, m.least) <= 2000000 OR r.high + 1 >= 3 THEN 0 ELSE r.high + 1 END,
    CASE WHEN m.least - least(r.floor, m.least) > 2000000 AND r.high + 1 >= 3 THEN m.least - r.floor END
  FROM r JOIN m ON m.event_type = r.event_type AND m.w = r.w + 1)
SELECT event_type, event_id, shift FROM r WHERE shift IS NOT NULL""")
def floor_shifts(spark, sf_dir):
    moved = F.when(F.expr("event_id div 700 % 2 = 1"), 3_000_000).otherwise(0)
    e = events(spark, sf_dir, "event_type", "event_id", "value").withColumn("late", F.floor(F.col("value") * 1000).cast("long") + moved)
    return sequence.floor_shifts(e, ["event_type"], "event_id", "late")


@query("""
WITH g AS (SELECT user_id, event_id, value > 30 AS stable, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, value > 30 ORDER BY event_id) AS g FROM events),
s AS (SELECT user_id, min(event_id) AS first FROM g WHERE stable GROUP BY user_id, g HAVING count(*) >= 3) SELECT user_id, min(first) AS armed FROM s GROUP BY user_id""")
def armed_streams(spark, sf_dir):
    return sequence.armed_at(events(spark, sf_dir, "user_id", "event_id", "value"), ["user_id"], "event_id", F.col("value") > 30)


@query("""
WITH g AS (SELECT event_type, event_id, epoch_us(ts) AS us, value > 20 AS dead, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - row_number() OVER (PARTITION BY event_type, value > 20 ORDER BY event_id) AS g FROM events)
SELECT event_type, min(event_id) AS first, max(event_id) AS last, count(*) AS n, max(us) - min(us) AS lasted FROM g WHERE dead GROUP BY event_type, g HAVING max(us) - min(us) >= 400000000""")
def dead_links(spark, sf_dir):
    """Failing streaks by how long they last."""
    e = events(spark, sf_dir, "event_type", "event_id", "value", "ts")
    return sequence.failing_streaks(e, ["event_type"], "event_id", F.col("value") > 20, 400_000_000, time=F.unix_micros(F.col("ts").cast("timestamp")))


# --- audio ----------------------------------------------------------------------------------------------

_AUDIO = """
WITH e AS (SELECT event_id, user_id, event_type, event_id // 64 AS segment, event_id * 1000 AS spot FROM events),
g AS (SELECT segment, min(spot) AS first_ordinal, max(spot) + 900 - min(spot) AS samples FROM e GROUP BY segment),
r AS (SELECT segment, spot AS sample_ordinal, event_id * 5 // 8 + CASE WHEN event_id % 131 = 7 THEN 1 ELSE 0 END AS counter_extended, event_id % 57 = 0 AS discontinuity FROM e WHERE event_type IN ('error', 'purchase')),
"""


def _audio(spark, sf_dir):
    """Events as audio: segments of 64 ids, a thousand samples an id; errors and purchases are resyncs."""
    e = events(spark, sf_dir, "event_id", "event_type").select(F.expr("event_id div 64").alias("segment"), (F.col("event_id") * 1000).alias("at"), "event_id", "event_type")
    segments = e.groupBy("segment").agg(F.min("at").alias("first_ordinal"), (F.max("at") + 900 - F.min("at")).alias("samples"))
    counter = F.expr("event_id * 5 div 8") + F.when(F.col("event_id") % 131 == 7, 1).otherwise(0)
    resyncs = e.where(F.col("event_type").isin("error", "purchase")).select("segment", F.col("at").alias("sample_ordinal"), counter.alias("counter_extended"), (F.col("event_id") % 57 == 0).alias("discontinuity"))
    return resyncs, segments


@query(_AUDIO + """
c AS (SELECT segment, first_ordinal AS spot, CAST(NULL AS BIGINT) AS counter, FALSE AS broken, first_ordinal + samples AS stop FROM g UNION ALL SELECT segment, sample_ordinal, counter_extended, discontinuity, NULL FROM r),
o AS (SELECT *, row_number() OVER (ORDER BY spot, segment, counter NULLS FIRST) AS k FROM c),
n AS (SELECT *, lag(counter) OVER (PARTITION BY segment ORDER BY k) AS was, coalesce(lead(spot) OVER (PARTITION BY segment ORDER BY k), max(stop) OVER (PARTITION BY segment)) - spot AS n FROM o),
f AS (SELECT *, CASE WHEN counter IS NULL AND k > 1 THEN 1 WHEN counter IS NOT NULL AND (broken OR counter <> was + 1) THEN 8 ELSE 0 END AS says,
  coalesce(sum(CASE WHEN n > 0 THEN 1 ELSE 0 END) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grp,
  first_value(counter IGNORE NULLS) OVER (PARTITION BY segment ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS c0,
  first_value(CASE WHEN counter IS NOT NULL THEN spot END IGNORE NULLS) OVER (PARTITION BY segment ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS o0,
  sum(CASE WHEN counter IS NOT NULL AND was IS NULL THEN 1 ELSE 0 END) OVER (ORDER BY k) AS run FROM n),
p AS (SELECT *, bit_or(says) OVER (PARTITION BY grp) AS pending FROM f),
b AS (SELECT *, unnest(range(0, (n - 1) // 4096 + 1)) AS i FROM p WHERE n > 0)
SELECT segment, spot + i * 4096 AS sample_ordinal, least(4096, n - i * 4096) AS n_frames, CAST((CASE WHEN i = 0 THEN pending ELSE 0 END) | (CASE WHEN n - i * 4096 >= 4096 THEN 2 ELSE 0 END) | (CASE WHEN counter IS NULL THEN 4 ELSE 0 END) AS INTEGER) AS flags,
  coalesce(counter, 0) AS last_resync_counter, CASE WHEN counter IS NULL THEN (spot + i * 4096) * 5 ELSE c0 * 8008 + (spot + i * 4096 - o0) * 5 END AS pts_num, CAST(run AS BIGINT) AS run FROM b""")
def audio_blocks(spark, sf_dir):
    resyncs, segments = _audio(spark, sf_dir)
    return audio.audio_blocks(resyncs, segments, [])


@query(_AUDIO + """
a AS (SELECT *, first_value(counter_extended) OVER (PARTITION BY segment ORDER BY sample_ordinal) AS c0, first_value(sample_ordinal) OVER (PARTITION BY segment ORDER BY sample_ordinal) AS o0 FROM r),
x AS (SELECT segment % 8 AS capture, CASE WHEN sample_ordinal > o0 THEN counter_extended * 8008 - (c0 * 8008 + (sample_ordinal - o0) * 5) END AS off FROM a)
SELECT capture, min(off) AS least, max(off) AS greatest FROM x GROUP BY capture""")
def residual_envelope(spark, sf_dir):
    resyncs, _ = _audio(spark, sf_dir)
    return audio.resync_residuals(resyncs.withColumn("capture", F.col("segment") % 8), ["capture"])


# --- totals and pictures' statistics ---------------------------------------------------------------------


@query("""
WITH t AS (SELECT user_id, count(*) AS eligible_units, count(*) FILTER (WHERE event_type <> 'error') AS exact_units, count(*) FILTER (WHERE event_type = 'error' AND event_id % 101 <> 5) AS ring_drops,
  count(*) FILTER (WHERE event_type = 'view') AS published, count(*) FILTER (WHERE event_type = 'click') AS pool_drops, count(*) FILTER (WHERE event_type NOT IN ('view', 'click', 'error') AND event_id % 103 <> 5) AS publisher_drops FROM events GROUP BY user_id)
SELECT user_id, 'eligible units' AS law, exact_units + ring_drops AS "left", eligible_units AS "right" FROM t WHERE exact_units + ring_drops <> eligible_units
UNION ALL SELECT user_id, 'exact units', published + pool_drops + publisher_drops, exact_units FROM t WHERE published + pool_drops + publisher_drops <> exact_units""")
def conservation_violations(spark, sf_dir):
    """Streams whose totals don't add up: some events are counted nowhere."""
    kind, i = F.col("event_type"), F.col("event_id")
    n = lambda c: F.sum(c.cast("long"))
    totals = events(spark, sf_dir, "user_id", "event_id", "event_type").groupBy("user_id").agg(
        F.count("*").alias("eligible_units"), n(kind != "error").alias("exact_units"), n((kind == "error") & (i % 101 != 5)).alias("ring_drops"), n(kind == "view").alias("published"),
        n(kind == "click").alias("pool_drops"), n(~kind.isin("view", "click", "error") & (i % 103 != 5)).alias("publisher_drops"),
    )
    return stats.conservation_laws(totals, ["user_id"], {k: stats.LAWS[k] for k in ("eligible units", "exact units")})


@query("""
WITH f AS (SELECT event_type, user_id % 7 - 3 AS shift, value / 100 AS still, value % 10 / 10 AS ratio FROM events),
c AS (SELECT event_type, shift, count(*) AS measurable, count(*) FILTER (WHERE shift <> 0 AND ratio < 0.8) AS misregistered FROM f WHERE still > 0.05 GROUP BY 1, 2)
SELECT event_type, shift, measurable, misregistered, round(sum(misregistered) OVER (PARTITION BY event_type) / sum(measurable) OVER (PARTITION BY event_type), 9) AS share FROM c""")
def misregistration_histogram(spark, sf_dir):
    e = events(spark, sf_dir, "event_type", "user_id", "value")
    frames = e.select("event_type", (F.col("user_id") % 7 - 3).alias("best_shift"), (F.col("value") / 100).alias("static_share"), (F.col("value") % 10 / 10).alias("ratio"))
    got = stats.misregistration(frames, ["event_type"], "static_share", "best_shift", "ratio")
    return got.withColumn("share", F.round("share", 9))


# --- units and logs --------------------------------------------------------------------------------------


@query("""
WITH u AS (SELECT event_id, user_id, (event_id * 3 + CASE WHEN event_id % 89 = 4 THEN 1 ELSE 0 END) % 65536 AS counter16, event_id % 6 <> 5 AS complete FROM events),
l AS (SELECT event_id, event_id * 3 + 65536 AS counter_extended FROM events WHERE event_id % 83 <> 9 UNION ALL SELECT event_id, event_id * 3 + 65536 FROM events WHERE event_id % 79 = 2),
g AS (SELECT event_id, count(*) AS n, min(counter_extended) AS counter_extended FROM l GROUP BY 1)
SELECT u.event_id, g.counter_extended, CASE WHEN g.n IS NULL THEN 'no row' WHEN g.n > 1 THEN 'several rows' WHEN complete AND g.counter_extended % 65536 <> counter16 THEN 'another counter' END AS refused FROM u LEFT JOIN g ON g.event_id = u.event_id""")
def decision_match(spark, sf_dir):
    """Units beside their log rows; some rows are missing, repeated, or of another counter."""
    i = F.col("event_id")
    e = events(spark, sf_dir, "event_id")
    units = e.select("event_id", ((i * 3 + F.when(i % 89 == 4, 1).otherwise(0)) % 65536).alias("counter16"), (i % 6 != 5).alias("complete"))
    row = e.withColumn("counter_extended", i * 3 + 65536)
    got = joins.decisions_of_units(units, row.where(i % 83 != 9).unionByName(row.where(i % 79 == 2)), [], "event_id", "counter16", "complete", "counter_extended", strict=False)
    return got.select("event_id", "counter_extended", "refused")


@query("""
WITH l AS (SELECT event_type, event_id // 2 * 2 AS c, CASE WHEN event_id % 5 = 3 THEN NULL ELSE event_id % 11 - 5 END AS d1, event_id % 7 - 3 AS d2 FROM events WHERE event_id % 17 <> 0)
SELECT event_type, c AS counter_extended, min(d1) AS applied_d1, min(d2) AS applied_d2, CASE WHEN count(*) > 1 THEN 'repeated' WHEN min(d1) IS NULL THEN 'empty' ELSE 'placed' END AS use FROM l GROUP BY event_type, c""")
def placement_rows(spark, sf_dir):
    i = F.col("event_id")
    log = events(spark, sf_dir, "event_id", "event_type").select("event_type", F.when(i % 17 != 0, F.expr("event_id div 2 * 2")).alias("counter_extended"), F.when(i % 5 != 3, i % 11 - 5).alias("applied_d1"), (i % 7 - 3).alias("applied_d2"))
    return audit.usable_placements(log, ["event_type"], strict=False)


@query("""
WITH t AS (SELECT event_id, f AS field, event_id % 5 - 2 AS d, unnest([[25 + event_id % 9, event_id % 3], [300 + event_id % 4, event_id % 4], [25 + event_id % 7, 1]]) AS x FROM events, (VALUES (1), (2)) AS v(f)),
a AS (SELECT event_id, field, d, CAST(x[1] AS INTEGER) AS line, ['R', 'I', 'U', 'Q'][x[2] + 1] AS action FROM t),
r AS (SELECT *, count(*) OVER (PARTITION BY event_id, field, line) AS n, CASE WHEN action IN ('R', 'I') THEN 2 * (line - CASE WHEN field = 1 THEN 23 ELSE 286 END - d) + field - 1 END AS row FROM a)
SELECT event_id, CAST(field AS INTEGER) AS field, line, action, CAST(row AS INTEGER) AS row, CASE WHEN action = 'Q' THEN 'unknown action' WHEN n > 1 THEN 'repeated line' WHEN row < 0 OR row >= 480 THEN 'outside the picture' END AS finding FROM r""")
def repair_tick_rows(spark, sf_dir):
    """`line:action` cells of a log as rows of published pictures."""
    i = F.col("event_id")
    name = lambda k: F.element_at(F.array(*map(F.lit, "RIUQ")), (k + 1).cast("int"))
    token = lambda line, k: F.concat(line.cast("string"), F.lit(":"), name(k))
    cell = F.concat_ws(" ", token(25 + i % 9, i % 3), token(300 + i % 4, i % 4), token(25 + i % 7, F.lit(1)))
    log = events(spark, sf_dir, "event_id").select("event_id", cell.alias("t1"), cell.alias("t2"), (i % 5 - 2).alias("d1"), (i % 5 - 2).alias("d2"))
    return audit.repair_ticks(log, ["event_id"], {1: "t1", 2: "t2"}, {1: "d1", 2: "d2"})


_STRIPS = """
WITH l AS (SELECT event_id AS c, CASE WHEN event_id % 61 = 8 THEN 0 ELSE 1 END AS published, CASE WHEN event_id % 10 = 9 THEN NULL ELSE event_id + event_id % 2 + CASE WHEN event_id % 73 = 3 THEN 1 ELSE 0 END END AS top,
  CASE WHEN event_id % 2 = 1 THEN 'reversed' ELSE 'aligned' END AS pairing, event_id % 4 AS fd1, event_id % 3 AS fd2, (event_id - 1) % 4 AS ad1x, event_id % 3 + CASE WHEN event_id % 67 = 5 THEN 1 ELSE 0 END AS ad2, CASE WHEN event_id % 20 = 19 THEN 0 ELSE 1 END AS unused FROM events WHERE event_id % 29 <> 11),
"""


@query(_STRIPS + """
u AS (SELECT c, published, top, pairing, fd1, fd2, c % 4 - CASE WHEN c % 71 = 1 THEN 1 ELSE 0 END AS ad1, ad2, unused FROM l),
s AS (SELECT event_id AS place, event_id + CASE WHEN event_id % 97 = 50 THEN 1 ELSE 0 END AS ordinal, CASE WHEN event_id % 53 = 40 THEN event_id - 1 ELSE event_id END AS c, CASE WHEN event_id % 29 = 11 THEN event_id % 2 ELSE event_id % 4 END AS d1, CASE WHEN event_id % 29 = 11 THEN 0 ELSE event_id % 3 END AS d2 FROM events),
f AS (SELECT * FROM u WHERE top IS NOT NULL),
e AS (SELECT s.place, s.c, f.c IS NOT NULL AS frame, CASE WHEN s.ordinal <> s.place THEN 'ordinal' WHEN f.c IS NULL THEN CASE WHEN s.d1 = 0 AND s.d2 = 0 THEN 'fill' ELSE 'nonzero fill' END
  WHEN t.c IS NULL OR f.top <> f.c + CASE WHEN f.pairing = 'reversed' THEN 1 ELSE 0 END THEN 'pairing' WHEN s.d1 <> f.fd1 OR s.d2 <> f.fd2 OR t.ad1 <> f.fd1 OR f.ad2 <> f.fd2 THEN 'placement' ELSE 'same' END AS finding
  FROM s LEFT JOIN f ON f.c = s.c LEFT JOIN u t ON t.c = f.top)
SELECT place AS at, c AS counter, finding FROM e
UNION ALL SELECT NULL, c, 'missing' FROM f WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.c = f.c)
UNION ALL SELECT NULL, c, 'repeated' FROM e WHERE frame GROUP BY c HAVING count(*) > 1
UNION ALL SELECT place, c, 'out of order' FROM (SELECT *, max(c) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM e WHERE frame) WHERE c < m
UNION ALL SELECT NULL, c, 'unpublished' FROM u WHERE published <> 1
UNION ALL SELECT NULL, c, CASE WHEN pairing = 'reversed' AND unused = 1 THEN 'boundary' ELSE 'unexplained' END FROM u WHERE top IS NULL""")
def strip_audit(spark, sf_dir):
    """Identity strips of a rendering against the log that it was made from; both have their faults."""
    i, one = F.col("event_id"), lambda c: F.when(c, 1).otherwise(0)
    e = events(spark, sf_dir, "event_id")
    odd = i % 2 == 1
    log = e.where(i % 29 != 11).select(
        i.alias("counter_extended"), (1 - one(i % 61 == 8)).alias("published"), F.when(i % 10 != 9, i + i % 2 + one(i % 73 == 3)).alias("frame_top_unit"), F.when(odd, "reversed").otherwise("aligned").alias("pairing"),
        (i % 4).alias("frame_d1"), (i % 3).alias("frame_d2"), (i % 4 - one(i % 71 == 1)).alias("applied_d1"), (i % 3 + one(i % 67 == 5)).alias("applied_d2"), (1 - one(i % 20 == 19)).alias("f2_unused"),
    )
    fill = i % 29 == 11
    strips = e.select(i.alias("place"), (i + one(i % 97 == 50)).alias("ordinal"), F.when(i % 53 == 40, i - 1).otherwise(i).alias("counter"), F.when(fill, i % 2).otherwise(i % 4).alias("d1"), F.when(fill, 0).otherwise(i % 3).alias("d2"))
    return audit.strip_audit(strips, log)


@query("""
WITH b AS (SELECT event_id, user_id, format('{:02X}{:08X}{:08X}{:02X}{:02X}', 211, event_id, user_id * 7, (event_id % 9 - 4 + 256) % 256, (user_id % 5 - 2 + 256) % 256) AS body FROM events),
x AS (SELECT *, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(range(0, 11), lambda i: CAST('0x' || substr(body, CAST(i * 2 + 1 AS INTEGER), 2) AS BIGINT))), lambda a, b: xor(a, b)) AS sum FROM b)
SELECT event_id, body || format('{:02X}', sum) AS strip, event_id AS ordinal, user_id * 7 AS counter, event_id % 9 - 4 AS d1, user_id % 5 - 2 AS d2, NULL AS broken FROM x""")
def identity_strips(spark, sf_dir):
    """Strips written and read again; one with a byte changed can't be read."""
    i, u = F.col("event_id"), F.col("user_id")
    made = events(spark, sf_dir, "event_id", "user_id").withColumn("s", ticks.strip(i, u * 7, i % 9 - 4, u % 5 - 2))
    read, broken = ticks.read_strip(F.col("s")), ticks.read_strip(F.concat(F.substring("s", 1, 5), F.unhex(F.lit("FE")), F.substring("s", 7, 6)))
    return made.select("event_id", F.hex("s").alias("strip"), read["ordinal"].alias("ordinal"), read["counter"].alias("counter"), read["d1"].alias("d1"), read["d2"].alias("d2"), F.when(F.hex(F.substring("s", 6, 1)) != "FE", broken["ordinal"]).alias("broken"))


@query("""
SELECT event_id, format('{:.12g}', value * 1000) AS g12, format('{:.9g}', value / 100000) AS g9, format('{:.17g}', CAST(event_id AS DOUBLE) * 1e17) AS g17,
  least(greatest(event_id % 700 - 350, -(event_id % 300)), 285 - event_id % 300) AS clamped, least(4294967295 - 3 + event_id % 7, 4294967295) AS counted,
  CASE event_id % 4 WHEN 0 THEN 'hole' WHEN 1 THEN 'short' WHEN 2 THEN 'complete' END AS name, event_id % 256 * 4 AS word,
  CASE WHEN event_id % 3 = 0 THEN CAST(event_id AS DECIMAL(20, 0)) WHEN event_id % 3 = 1 THEN NULL WHEN event_id % 2 = 0 THEN CAST(18446744073709551615 AS DECIMAL(20, 0)) END AS parsed FROM events""")
def text_forms(spark, sf_dir):
    """Number formats, clamps, saturating counters, names of codes, words of pictures, strict numbers."""
    i, v = F.col("event_id"), F.col("value")
    text = F.when(i % 3 == 0, F.concat(F.lit("000"), i.cast("string"))).when(i % 3 == 1, F.concat(F.lit("+"), i.cast("string"))).when(i % 2 == 0, "18446744073709551615").otherwise("18446744073709551616")
    return events(spark, sf_dir, "event_id", "value").select(
        "event_id", ticks.shortest(v * 1000, 12).alias("g12"), ticks.shortest(v / 100000, 9).alias("g9"), ticks.shortest(i.cast("double") * 1e17, 17).alias("g17"),
        ticks.clamp_offset(i % 300, i % 700 - 350).alias("clamped"), ticks.saturating_add(F.lit(2**32 - 4), i % 7).alias("counted"),
        ticks.names_of((i % 4).cast("int"), {0: "hole", 1: "short", 2: "complete"}).alias("name"), ticks.ten_bit(i % 256).cast("long").alias("word"), ticks.strict_natural(text).alias("parsed"),
    )


_UNITS = """
WITH u AS (SELECT event_id, CASE WHEN event_type = 'error' THEN 'no_signal' ELSE 'picture' END AS kind, CASE event_id % 5 WHEN 0 THEN 'complete' WHEN 1 THEN 'short' WHEN 2 THEN 'unframed' WHEN 3 THEN 'hole' ELSE 'complete' END AS transport,
  event_id % 7 <> 2 AS counter_confirmed, CASE event_id % 5 WHEN 0 THEN 756048 WHEN 4 THEN 756048 WHEN 1 THEN 756048 - 40 * (event_id % 4000) ELSE 600000 + event_id * 977 % 1200000 END AS byte_count FROM events),
"""


def _units(spark, sf_dir):
    i = F.col("event_id")
    n = F.when((i % 5).isin(0, 4), 756_048).when(i % 5 == 1, 756_048 - 40 * (i % 4000)).otherwise(600_000 + i * 977 % 1_200_000)
    name = F.element_at(F.array(*map(F.lit, ("complete", "short", "unframed", "hole", "complete"))), (i % 5 + 1).cast("int"))
    return events(spark, sf_dir, "event_id", "event_type").select("event_id", F.when(F.col("event_type") == "error", "no_signal").otherwise("picture").alias("kind"), name.alias("transport"), (i % 7 != 2).alias("counter_confirmed"), n.cast("long").alias("byte_count"))


@query(_UNITS + """
c AS (SELECT *, kind = 'picture' AND counter_confirmed AND byte_count <> 756048 AND byte_count >= 756048 - 92160 AND byte_count <= 2 * 756048 + 92160 AND ((transport = 'short' AND byte_count <= 756048 + 92160) OR transport = 'unframed') AS repairable,
  transport IN ('complete', 'short') AND kind = 'picture' AND byte_count <= 756048 AND byte_count - 1000 >= 48 + 32 * 1440 AS showable,
  row_number() OVER (PARTITION BY transport = 'complete' AND kind = 'picture' ORDER BY event_id) AS k FROM u)
SELECT event_id, repairable, showable, transport = 'complete' AND kind = 'picture' AND (k - 1) % 4 = 0 AS sampled FROM c""")
def unit_candidates(spark, sf_dir):
    """Which units may be repaired, shown in part, or looked at by the noise meter."""
    units = _units(spark, sf_dir).withColumn("eligible", F.col("kind") == "picture").withColumn("picture_bytes", F.col("byte_count") - 1000).withColumn("format", F.when(F.col("kind") == "picture", 0xE801).otherwise(0x0800))
    told = framing.showable_parts(framing.repair_candidates(units))
    seen = framing.sampled_units(told, [], "event_id").select("event_id", F.lit(True).alias("sampled"))
    return told.join(seen, "event_id", "left").select("event_id", "repairable", "showable", F.coalesce("sampled", F.lit(False)).alias("sampled"))


@query("""
WITH p AS (SELECT l_orderkey, CASE WHEN l_linenumber <= 2 THEN 1 ELSE 2 END AS part, l_linenumber, l_partkey FROM lineitem),
o AS (SELECT part, l_orderkey * 8 + l_linenumber AS spot FROM p) SELECT CAST(part AS INTEGER) AS part, part * 1000000000 - 1000000000 + spot AS position FROM o ORDER BY position LIMIT 5000""")
def parts_in_order(spark, sf_dir):
    """The first records of a recording in two parts, read as one."""
    li = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("at"), "l_linenumber")
    whole = framing.parts_in_order([li.where("l_linenumber <= 2"), li.where("l_linenumber > 2")], "at", [1_000_000_000, 0])
    return framing.first_units(whole, ["position"], 5000).select("part", "position")
