"""Queries on keys and values beyond those of the small tables, each beside its SQL."""

import datetime
import random
import time

import pandas as pd
from oracle import compare
from pyspark.sql import functions as F

from rastrum.functions import ticks
from rastrum.operators import framing, joins, placement
from rastrum.plans import catalogue


def check(spark, folder, name, rows, columns=("event_id", "user_id", "event_type", "value")):
    table = pd.DataFrame(rows, columns=list(columns)).assign(ts=datetime.datetime(2024, 1, 1), props="{}")
    table.to_parquet(f"{folder}/events.parquet", coerce_timestamps="us")
    compare(catalogue.queries()[name](spark, str(folder)), catalogue.oracle_sql()[name], folder)


def test_log_functions_of_large_keys(spark, tmp_path):
    check(spark, tmp_path, "log_functions", [(59041463, 59000395, "view", 0.81), (59008284, 59001228, "click", 6.31), (3, 0, "view", 0.0), (4, 7, "view", 0.0), (5, 1, "view", 5.12)])


def test_rounding_by_scale(spark):
    values = [59000395 / 0.81, 2.5e-7, 0.1953125, -0.1953125, 1e308, float("inf"), float("-inf"), None]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").select(ticks.rounded(F.col("x"), 6)).collect()]
    assert got == [72839993.827161, 0.0, 0.195313, -0.195313, 1e308, float("inf"), float("-inf"), None]


def test_scalar_functions_beyond_99_minutes(spark, tmp_path):
    check(spark, tmp_path, "scalar_functions", [(i, 1, "view", 1.0) for i in (0, 17982, 179820, 179821, 1798201, 5999999)])
    assert [r[0] for r in spark.createDataFrame([(179820,), (5,)], "u long").select(ticks.minutes(F.col("u"))).collect()] == ["99:59.99", "00:00.16"]


def test_text_forms_of_inexact_doubles(spark, tmp_path):
    check(spark, tmp_path, "text_forms", [(i, 1, "view", v) for i, v in ((23613, 0.3), (23615, 47.15), (5999999, 560.21), (7, -0.0), (8, 0.0), (9, 1e-9))])


def test_shortest_is_exact(spark):
    values = [(2.5, "2"), (3.5, "4"), (0.1, "0.1"), (1e-5, "1e-05"), (float("nan"), "nan"), (float("-inf"), "-inf"), (-0.0, "-0"), (None, None)]
    got = spark.createDataFrame([(v,) for v, _ in values], "x double").select(ticks.shortest(F.col("x"), 1)).collect()
    assert [r[0] for r in got] == [w for _, w in values]


def test_framing_units_moves_no_payload(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(framing, "video_units", lambda records: seen.append(records) or spark.sql("SELECT 0 AS ordinal, 0 AS counter16, 0 AS counter_extended, '' AS kind, '' AS transport, 0 AS byte_count, 0 AS start_off, TRUE AS eligible"))
    catalogue.queries()["framing_units"](spark, "/root/testdata/sf0.001")
    above = seen[0]._jdf.queryExecution().optimizedPlan().toString().split("Generate ")[0]
    # Payloads are made above the explode; nothing there shuffles or sorts.
    assert "payload" in above and not any(word in above for word in ("Sort ", "Window ", "Repartition"))


def test_lost_between_of_wide_pairs(spark):
    rng = random.Random(5)
    for lost in ([], [7], [0, 65535], [None, 300, 300, 40000], list(range(0, 65536, 997))):
        pairs = [(a, (a + w) % 65536) for a, w in ((rng.randrange(65536), rng.choice((0, 1, 2, 300, 65535, rng.randrange(65536)))) for _ in range(300))] + [(7, 7), (6, 8), (7, 6), (8, 6), (0, 65535), (None, 3)]
        got = joins.lost_between(spark.createDataFrame(pairs, "a long, b long"), spark.createDataFrame([(c,) for c in lost], "c long"), "a", "b", "c").collect()
        want = [(a, b, a is not None and any(0 < (c - a) % 65536 < (b - a) % 65536 for c in lost if c is not None)) for a, b in pairs]
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    # Wide pairs among many lost counters: every pair met thousands of rows before.
    start = time.time()
    wide = spark.range(1_000_000).select((F.col("id") % 65536).alias("a"), ((F.col("id") * 31 + 60000) % 65536).alias("b"))
    assert joins.lost_between(wide, spark.range(65536).select(F.col("id").alias("c")), "a", "b", "c").where("lost_between").count() > 900_000
    assert time.time() - start < 60


def test_schedule_equals_place_slots_and_takes_long_gaps(spark):
    rng = random.Random(9)
    frames = [{"capture_id": c, "line": i, "counter": i + i // 9, "pts_num": i * 1001, "pts_den": 30000, "audio_pts_known": int(rng.random() < 0.8), "audio_pts_num": i * 8008 + (i // 9) * 8008 * (1 + i % 4) + rng.randrange(9000)} for c in "ab" for i in range(200)]
    ddl = "capture_id string, line long, counter long, pts_num long, pts_den long, audio_pts_known int, audio_pts_num long"
    units = [{"capture_id": c, "line": -1, "counter": n, "format": 0, "kind": 1, "transport": 0, "host_lost": int(n % 30 == 9)} for c in "ab" for n in range(0, 220, 3)]
    got = placement.schedule(spark.createDataFrame(frames, ddl), spark.createDataFrame(units, "capture_id string, line long, counter long, format int, kind int, transport int, host_lost int")).collect()
    want = []
    for c in "ab":
        rows, seen = [f for f in frames if f["capture_id"] == c], [u for u in units if u["capture_id"] == c]
        slots = placement.place_slots(rows, seen, [u["counter"] for u in seen if u["host_lost"]])
        want += [(c, s["slot"], s["kind"], None if s["frame"] is None else rows[s["frame"]]["counter"], s["off_ticks"]) for s in slots]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str) and {r.kind for r in got} == {"frame", "held", "fill"}
    # Millions of empty slots between two frames are made where they are written.
    far = [("a", 0, 0, 0, 30000, 1, 0), ("a", 1, 1, 0, 30000, 1, 8008 * 20_000_000)]
    start = time.time()
    assert placement.schedule(spark.createDataFrame(far, ddl)).groupBy("kind").count().collect() and time.time() - start < 15
