import math

import numpy as np
import pytest

from rastrum.operators import placement, raster


def unit(luma, chroma=None):
    px = np.empty((525, 720, 2), np.uint8)
    px[:, :, 1], px[:, :, 0] = luma, 128 if chroma is None else chroma
    px[raster.PADDING] = (128, 16)
    return b"\x00\x00\xff\xff" + bytes(44) + px.tobytes()


RNG = np.random.default_rng(5)
PROGRAM = np.clip(120 + 60 * np.sin(np.arange(525)[:, None] / 30 + np.arange(720) / 40) + RNG.integers(-3, 4, (525, 720)), 17, 235).astype(np.uint8)
NOISE = RNG.integers(0, 256, (525, 720), dtype=np.uint8)


def by_hand(luma, chroma):
    """The sums pixel by pixel."""
    y, c, grad = [], [], []
    for lo, hi in ((20, 256), (282, 518)):
        above = None
        for r in range(lo, hi + 1):
            row = [int(v) for v in luma[r, ::4]]
            y += row
            c += [abs(int(v) - 128) for v in chroma[r, ::4]]
            grad += [abs(a - b) for a, b in zip(row, row[1:])]
            grad += [abs(a - b) for a, b in zip(row, above)] if above else []
            above = row
    mean = sum(y) / len(y)
    return {
        "luma_mean": mean, "luma_sigma": math.sqrt(sum(v * v for v in y) / len(y) - mean**2), "luma_median": sorted(y)[len(y) // 2], "gradient": sum(grad) / len(grad),
        "chroma_distance": sum(c) / len(c), "chroma_distance_median": sorted(c)[len(c) // 2], "flat_fraction": sum(abs(v - mean) <= 2 for v in y) / len(y), "subblack_fraction": sum(v < 16 for v in y) / len(y),
    }


def test_measurements_equal_sums_by_hand():
    chroma = RNG.integers(100, 160, (525, 720), dtype=np.uint8)
    got, y = raster.measure(unit(NOISE, chroma), None)
    for k, v in by_hand(NOISE, chroma).items():
        assert got[k] == pytest.approx(v, rel=1e-12), k
    again, _ = raster.measure(unit(NOISE, chroma), y)
    assert again["temporal_mad"] == 0 and got["padding_fraction"] == 1


def test_appearance_of_patterns(spark):
    flat = lambda v: np.full((525, 720), v, np.uint8)
    title = flat(60)
    title[100:110, 100:160] = 200
    bad = np.frombuffer(unit(flat(60)), np.uint8).copy()
    bad[48 : 48 + 1440 * 7] = 0
    patterns = {"snow": unit(NOISE), "program": unit(PROGRAM), "subblack_mute": unit(flat(8)), "gray_mute": unit(title), "flat_ambiguous": unit(flat(60), flat(200)), "unknown": bad.tobytes()}
    df = spark.createDataFrame([("a", n, i * 7, u) for i, (n, u) in enumerate(patterns.items())], "capture_id string, name string, counter_extended long, unit binary")
    got = {r.name: r for r in raster.measurements(df, ["capture_id", "name"]).collect()}
    assert {n: r.appearance for n, r in got.items()} == {n: n for n in patterns}
    assert all(0 <= r.confidence <= 1 for r in got.values())


def test_measurements_don_t_depend_on_blocks(spark):
    units = [("a", c, unit(np.roll(PROGRAM, c, axis=0))) for c in (3, 4, 5, 6, 9, 10)] + [("a", 11, b"short")]
    df = spark.createDataFrame(units, "capture_id string, counter_extended long, unit binary").repartition(3)
    got = {}
    for n in (2, 3, 100):
        got[n] = sorted(tuple(r) for r in raster.measurements(df, ["capture_id"], per_block=n).collect())
    assert got[2] == got[3] == got[100] and len(got[2]) == 6
    at = raster.MEASUREMENTS.index("temporal_mad") + 2
    assert [r[at] > 0 for r in got[100]] == [False, True, True, True, False, True]


def test_shifts_are_found():
    base = RNG.integers(20, 180, (700, 720), dtype=np.uint8)
    for s in (-5, -2, 0, 3):
        before, now = base[80:605], base[80 - s : 605 - s]
        for k in (0, 1):
            assert raster.vertical_motion(now, before, k)["shift"] == s
            assert raster.rigid_motion(now, before, k)["dy"] == s
    assert raster.vertical_motion(np.zeros((525, 720), np.uint8), np.zeros((525, 720), np.uint8), 0)["shift"] == 0
    tied = raster.rigid_motion(np.zeros((525, 720), np.uint8), np.zeros((525, 720), np.uint8), 0)
    assert (tied["dy"], tied["dx"], tied["clarity"]) == (-5, -8, 1.0)


def test_comb_energies_equal_sums_by_hand():
    luma = np.clip(PROGRAM.astype(int) + RNG.integers(-9, 9, PROGRAM.shape), 0, 255).astype(np.uint8)
    got = raster.comb(luma, luma)
    for d in (-5, 0, 4):
        total = 0
        for r in range(30, 241):
            a, c, b = (luma[i, 24:696].astype(int) for i in (r - 4, r - 3, r + 259 + d))
            total += int(np.maximum((a - b) * (c - b), 0).sum())
        assert got["energies"][d + 5] == float(np.float32(total / (211 * 672)))
    none = raster.comb(np.zeros((525, 720), np.uint8), np.zeros((525, 720), np.uint8))
    assert (none["shift"], none["margin"]) == (-5, 1.0)


def interlaced(top1=23, top2=286):
    """A smooth picture in both fields over blank rows; row = line - 4."""
    picture = np.clip(120 + 60 * np.sin(np.arange(1200)[:, None] / 17 + np.arange(720) / 31) + 30 * np.sin(np.arange(720) / 5.0), 40, 220)
    luma = np.full((525, 720), 16, float) + RNG.integers(0, 2, (525, 720))
    for i in range(238):
        if top1 - 4 + i < 260:
            luma[top1 - 4 + i] = picture[2 * i]
        if top2 - 4 + i < 523:
            luma[top2 - 4 + i] = picture[2 * i + 1]
    return luma.astype(np.uint8)


def test_tops_and_placement(spark):
    luma = interlaced()
    f = raster.features(unit(luma))
    assert (f["f1"]["first"], f["f2"]["first"]) == (23, 286)
    rows = [("a", c, unit(interlaced(23 + (c >= 6), 286 + (c >= 6)))) for c in range(1, 10)]
    df = spark.createDataFrame(rows, "capture_id string, counter_extended long, unit binary")
    got = placement.decide(raster.geometry(df, ["capture_id"], per_block=4), ["capture_id"]).orderBy("counter_extended").collect()
    assert [r.between for r in got] == [0] * 9 and got[0].d2 == 0
    assert len(placement.decide(raster.geometry(df, ["capture_id"], pairing="reversed"), ["capture_id"]).collect()) == 8


def test_votes_and_ties():
    assert placement.mode_vote([2, 2, 3, 3], 2) == 2 and placement.mode_vote([2, 2, 3, 3], 9) == 3
    assert placement.mode_vote([2, 2, 3, 3, 4], 9) == 2 and placement.mode_vote([5], 0) == 5


def test_weave_fills_rows_outside_the_field():
    whole, none = raster.weave(unit(NOISE), 0, 0)
    assert none == 0 and (whole[0, 1::2] == NOISE[19]).all() and (whole[1, 1::2] == NOISE[282]).all()
    assert raster.weave(unit(NOISE), 5, -2)[1] == 2


def frame(i, t, known=1, counter=None):
    return {"counter": i if counter is None else counter, "pts_num": i * 1001, "pts_den": 30000, "audio_pts_known": known, "audio_pts_num": t, "line": i}


def test_slots():
    kinds = lambda rows: [(s["kind"], s["frame"]) for s in rows]
    even = [frame(i, 1000 + i * 8008) for i in range(4)]
    assert kinds(placement.place_slots(even)) == [("frame", i) for i in range(4)]
    hole = [even[0], even[2], even[3]]
    assert kinds(placement.place_slots(hole)) == [("frame", 0), ("fill", None), ("frame", 1), ("frame", 2)]
    assert kinds(placement.place_slots(hole, lost=[])) == [("frame", 0), ("held", 0), ("frame", 1), ("frame", 2)]
    assert kinds(placement.place_slots(hole, lost=[1]))[1] == ("fill", None)
    near = [frame(0, 0), frame(1, 8008), frame(2, 8008 + 300), frame(3, 3 * 8008)]
    assert kinds(placement.place_slots(near))[1] == ("frame", 1)
    far = [frame(0, 0), frame(9, 9 * 8008)]
    lock = [{"line": 0.5, "counter": 4, "kind": 1, "transport": 2, "host_lost": 0}]
    assert kinds(placement.place_slots(far, lock, []))[1:9] == [("held", 0)] * 8
    assert kinds(placement.place_slots(far, [], []))[1] == ("fill", None)
    guess = [frame(0, 0), frame(1, 0, known=0), frame(2, 2 * 8008)]
    assert kinds(placement.place_slots(guess)) == [("frame", i) for i in range(3)]


def test_schedule(spark):
    rows = [("a", i, i, i * 1001, 30000, 1, i * 8008) for i in (0, 1, 3)]
    f = spark.createDataFrame(rows, "capture_id string, line long, counter long, pts_num long, pts_den int, audio_pts_known int, audio_pts_num long")
    got = placement.schedule(f).orderBy("slot").collect()
    assert [(r.kind, r.counter) for r in got] == [("frame", 0), ("frame", 1), ("held", 1), ("frame", 3)]
    assert placement.monotonic([5, None, 3], 10) == [(5, False), (15, True), (16, False)]


def caption(b1, b2, cell=None):
    row, cell = np.full(720, 20.0), cell or raster.CELL
    for x in range(720):
        if 25 <= x < 25 + 7 * cell:
            row[x] = 70 + 50 * math.cos(2 * math.pi * (x - 25 - cell / 2) / cell)
    bits = [0, 0, 1] + [b1 >> k & 1 for k in range(8)] + [b2 >> k & 1 for k in range(8)]
    for k, b in enumerate(bits):
        a = round(25 + (7 + k) * cell)
        row[a : round(25 + (8 + k) * cell)] = 120 if b else 20
    return row.astype(np.uint8)


def test_captions():
    luma = np.full((525, 720), 16, np.uint8)
    luma[17], luma[280] = caption(0x94, 0x20), caption(0x80, 0x81)
    got = [(r["row"], r["byte1"], r["byte2"]) for r in raster.caption_rows(luma, 0, 524)]
    assert got == [(17, 0x94, 0x20)]
