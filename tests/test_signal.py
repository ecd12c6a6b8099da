import random

import fixtures as fx
import numpy as np
import pytest
from pyspark.sql import functions as F

from rastrum.operators import meter, sequence, signal
from rastrum.plans import audit, transport
from rastrum.sources import recording, tables
from rastrum.streaming import live

LABELS = ["program", "snow", "gray_mute", "subblack_mute", "no_signal", "flat_ambiguous", "unknown"]


def test_runs_confirm_labels_and_sources():
    m = signal.Signal()
    steps = [m.step("complete", "program", 0.9) for _ in range(6)]
    assert [s["source"] for s in steps] == ["unknown"] * 4 + ["present"] * 2
    assert [s["begins_segment"] for s in steps] == [False] * 4 + [True, False]
    assert [s["appearance"] for s in steps][3:] == ["unknown", "program", "program"]
    cut = m.step("short", None, None)
    assert (cut["source"], cut["appearance"], cut["discontinuity"], cut["unsettled"]) == ("unknown", "unknown", True, True)
    again = [m.step("complete", "program", 0.9) for _ in range(5)]
    assert not again[-1]["begins_segment"] and again[-1]["source"] == "present"  # the acquisition was still open
    mute = m.step("complete", "subblack_mute", 1.0)
    assert (mute["source"], mute["unsettled"]) == ("muted", False)
    assert [m.step("complete", "no_signal", 1.0)["source"] for _ in range(3)] == ["muted", "muted", "no_input"]


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    rng = random.Random(3)
    rows = [(f"c{i % 3}", i, rng.choice(["complete"] * 9 + ["hole"]), LABELS[(i // 7 + rng.randrange(2)) % 7], rng.random()) for i in range(400)]
    ddl = "capture_id string, n long, transport string, label string, confidence double"
    whole = sorted(tuple(r) for r in signal.classify(spark.createDataFrame(rows, ddl), ["capture_id"], "n").collect())
    assert len(whole) == 400
    for k in range(4):
        spark.createDataFrame(rows[k * 100 : k * 100 + 100], ddl).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{k}"))
    src = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in" / "*"))
    run = signal.classify_stream(src, ["capture_id"], "n").writeStream.format("memory").queryName("states").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        run.processAllAvailable()
        assert sorted(tuple(r) for r in spark.table("states").collect()) == whole
    finally:
        run.stop()


def test_unwrap_stream_equals_batch(spark, tmp_path):
    rng, c, rows = random.Random(5), 65530, []
    for i in range(300):
        rows.append((f"k{i % 2}", i, c % 65536))
        c += rng.choice([1, 1, 1, 2, 0, 40000])
    ddl = "key string, n long, c16 long"
    want = {(r.key, r.n): (r.extended, r.discontinuity) for r in sequence.unwrap_counter(spark.createDataFrame(rows, ddl), ["key"], "n", "c16", block=17).collect()}
    for k in range(3):
        spark.createDataFrame(rows[k * 100 : k * 100 + 100], ddl).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{k}"))
    src = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    run = live.unwrap_stream(src, ["key"], "n", "c16").writeStream.format("memory").queryName("unwrapped").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        run.processAllAvailable()
        assert {(r.key, r.n): (r.extended, r.discontinuity) for r in spark.table("unwrapped").collect()} == want
    finally:
        run.stop()


def test_gaps_of_a_growing_recording(spark, tmp_path):
    recording.register(spark)
    v = lambda i, s: fx.data(fx.VIDEO, i, s, b"x" * 8)
    (tmp_path / "a.tpc").write_bytes(b"".join(v(*x) for x in [(0, 0), (1, 0), (0, 1), (0, 3), (1, 3), (3, 3)]))
    run = live.gap_stream(live.packets(spark, str(tmp_path / "a.tpc"), 2)).writeStream.format("memory").queryName("gaps").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        run.processAllAvailable()
        batch = spark.read.format("tpc").option("path", str(tmp_path / "a.tpc")).load()
        want = {r.file_off for r in transport.contiguity(batch).where(F.col("flags") == 1).collect()}
        assert {r.file_off for r in spark.table("gaps").collect()} == want and len(want) == 2
    finally:
        run.stop()


def picture(noise, seed=1, second=None):
    rng = np.random.default_rng(seed)
    luma = 120 + 60 * np.sin(np.arange(720) / 40) + 20 * np.sin(np.arange(480)[:, None] / 25)
    luma[:, 300:330] = luma[:, 300:330] + 30 * (np.arange(30) % 7 > 3)
    sd = np.where(np.arange(480)[:, None] % 2 == 0, noise, noise if second is None else second)
    out = np.full((480, 1440), 128, np.uint8)
    out[:, 1::2] = np.clip(np.rint(luma + rng.normal(0, 1, (480, 720)) * sd), 0, 255)
    out[:, 0::2] = np.clip(np.rint(128 + rng.normal(0, 1, (480, 720)) * sd), 0, 255)
    return out


def test_meter_measures_noise_and_refuses_what_it_can_t():
    r = meter.reading(picture(2.0, second=3.0))
    assert r["verdict"] == "ok"
    assert r["noise"][0]["y"] == pytest.approx(2.0, abs=0.25) and r["noise"][1]["y"] == pytest.approx(3.0, abs=0.3)
    flat = np.full((480, 1440), 128, np.uint8)
    assert meter.reading(flat)["verdict"] == "fields_identical"
    dark = flat.copy()
    dark[:, 1::2] = 16
    assert meter.reading(dark)["verdict"] == "too_few_blocks"
    noisy = picture(12.0)
    assert meter.reading(noisy)["verdict"] == "snow" and meter.reading(noisy, picture(12.0, seed=2))["verdict"] != "snow"


def test_static_comb_finds_the_shift():
    p = picture(0.0)
    shifted = p.copy()
    shifted[1::2] = np.roll(p[1::2], 1, axis=0)
    got = meter.static_comb(shifted, shifted)
    assert got["best_shift"] == -1 and got["energy"] > got["best_energy"]


def test_log_audit(spark):
    rows = [(1, 1, 10, 1, None, 0, 1, 0), (2, 1, 11, 1, None, 0, 0, 3), (3, 1, None, 0, "PoolFull", 0, 0, 0), (4, 1, 13, 1, None, 0, 0, 0), (5, 1, 17, 1, None, 0, 0, 0), (6, 1, 20, 1, None, 2, 0, 0), (7, 0, 0, 0, "RingFullTail", 4, 0, 0), (8, 1, 21, 0, "Short", 0, 0, 0)]
    log = spark.createDataFrame([("a", *r) for r in rows], "capture string, ordinal long, epoch long, counter_extended long, published int, drop_reason string, preceding_ring_drops long, reset_before int, audio_step_samples long")
    gaps = [(r.before, r.after, r.missing, r.covered) for r in audit.log_gaps(log, ["capture"], "ordinal").orderBy("after").collect()]
    assert gaps == [(11, 13, 1, True), (13, 17, 3, False), (17, 20, 2, True)]
    s = audit.log_summary(log, ["capture"]).first()
    assert (s.rows, s.published, s.host_lost, s.device_framed, s.ring_drops, s.resets, s.audio_steps, s.epochs) == (8, 5, 1, 1, 6, 1, 1, 1)
    assert {(r.problem, r.n) for r in audit.problems(log, ["capture"], "ordinal").collect()} == {("host_lost", 1), ("ring_drops", 6), ("unexplained_gaps", 1)}


def test_schedule_text():
    good = 'first_counter,pairing,note\n0,reversed,"a, ""b""\nc"\n6,aligned,\n'
    assert tables.parse_schedule(good) == [(0, "reversed", 'a, "b"\nc'), (6, "aligned", "")]
    for bad in ("", "x\n0,aligned,\n", good.replace("0,rev", "1,rev"), good.replace("6,", "0,"), good.replace("aligned", "other"), good + "7,aligned\n", good + "+9,aligned,\n", good.replace("\n6", "\r6"), good + "9,aligned,\0\n", 'first_counter,pairing,note\n0,aligned,"a"b\n'):
        with pytest.raises(Exception):
            tables.parse_schedule(bad)


def test_decision_and_replay_logs(spark, tmp_path):
    df = spark.createDataFrame([(1, None, "a b", float("inf")), (2, 0, None, 1.5)], "counter long, d int, note string, ratio double")
    tables.write_decision_log(df, str(tmp_path / "log"))
    back = tables.decision_log(spark, str(tmp_path / "log"), "counter long, d int, note string, ratio double")
    assert sorted(tuple(r) for r in back.collect()) == sorted(tuple(r) for r in df.collect())
    (tmp_path / "r.csv").write_text("kind,x\nV,5,1001,30000,0,-1,0,1,77\nA,0,5,240000,1600,0,5,-3\nU,9,2048,1,0,0\nV,6,2002,30000,0,0,0,0,\n")
    logs = tables.replay_log(spark, str(tmp_path / "r.csv"))
    assert [tuple(r) for r in logs["V"].collect()] == [(5, 1001, 30000, 0, -1, 0, 1, 77), (6, 2002, 30000, 0, 0, 0, 0, None)]
    assert logs["A"].first().residual == -3 and logs["U"].first().format == 2048
