import numpy as np
import pytest
from tests_support import raster_unit

from rastrum.operators import raster, repair

H, L, U = 48, 1440, 756_048


@pytest.fixture(scope="module")
def whole():
    rng = np.random.default_rng(8)
    luma = np.clip(100 + 40 * np.sin(np.arange(525)[:, None] / 11 + np.arange(720) / 23) + rng.integers(-2, 3, (525, 720)), 30, 220).astype(np.uint8)
    px = np.frombuffer(raster_unit(luma, 120), np.uint8).copy()
    px[H:].reshape(525, 720, 2)[raster.PADDING] = (128, 16)
    px[4:8] = (5, 0, 0x01, 0xE8)
    return px.tobytes()


def rows(unit):
    return np.frombuffer(unit, np.uint8, offset=H).reshape(525, L)


def test_a_tear_loses_one_stretch(whole):
    p = H + 150 * L + 700
    status, fixed, info = repair.repair(whole[:p] + bytes(524) + whole[p + 748 :])
    assert status == "ok" and len(fixed) == U and info["delta"] == -224 and info["lost_bytes"] == 748 and info["rebuilt_rows"] == 2
    got, want = rows(fixed), rows(whole)
    assert (np.flatnonzero((got != want).any(axis=1)).tolist()) in ([150, 151], [150], [151])
    assert np.abs(got.astype(int) - want).max() < 40


def test_inserted_lines_come_out_exactly(whole):
    p = H + 200 * L
    status, fixed, info = repair.repair(whole[:p] + bytes(10 * L) + whole[p:])
    assert (status, info["lost_bytes"]) == ("ok", 0) and fixed == whole


def test_a_long_stall_takes_lines_from_the_other_field_or_the_unit_before(whole):
    p, q = H + 100 * L, H + 130 * L
    status, fixed, info = repair.repair(whole[:p] + b"\x00\xff\x21\x43" * 16_000 + whole[q:])
    assert status == "ok" and info["rebuilt_rows"] == 30 and info["delta"] == 64_000 - 30 * L
    assert np.abs(rows(fixed).astype(int) - rows(whole)).max() < 60


def test_what_does_not_fit_is_declined(whole):
    status = lambda u: repair.repair(u)[0]
    assert status(whole) == "not_a_unit" and status(b"x" * 900) == "not_a_unit"
    assert status(whole[:1000]) == "delta_range" and status(whole[: -L]) == "no_fill"
    p = H + 100 * L
    assert status(whole[:p] + bytes(5 * L) + whole[p : p + 9000] + b"\x00\x00\xff\xff" + whole[p + 9000 :]) == "marker"
    assert status(whole[:p] + bytes(50 * L) + whole[p + 260 * L :][: U - p]) in ("delta_range", "grid", "too_much_lost")


def test_tables_of_units(spark, whole):
    p = H + 200 * L
    long = whole[:p] + bytes(10 * L) + whole[p:]
    df = spark.createDataFrame([("a", 46, whole), ("a", 47, whole), ("a", 48, long), ("a", 49, whole[:-L])], "capture_id string, counter_extended long, unit binary")
    got = {r.counter_extended: r for r in repair.repaired(df, ["capture_id"]).collect()}
    assert {c: r.status for c, r in got.items()} == {48: "ok", 49: "no_fill"} and bytes(got[48].unit) == whole and got[49].unit is None


def test_a_held_sample_comes_out(whole):
    p = H + 300 * L + 8
    long = whole[:p] + whole[p - 4 : p] * 400 + whole[p:]
    status, fixed, info = repair.repair(long)
    assert status == "ok" and len(fixed) == U and (rows(fixed) != rows(whole)).sum() <= 8
    # A picture that holds as long elsewhere leaves it open.
    flat = bytearray(long)
    q = H + 400 * L
    flat[q : q + 1700] = whole[q : q + 4] * 425
    assert repair.repair(bytes(flat))[0] == "no_fill"


def test_a_run_of_two_is_taken_apart(whole):
    second = bytearray(whole)
    second[4:6] = (6).to_bytes(2, "little")
    # The stall takes the end of the first, the marker, and the top of the second.
    run = whole[: U - 3 * L] + bytes(20 * L) + bytes(second[20 * L :])
    (s1, one, _), (s2, two, _) = repair.repair_pair(run)
    assert (s1, s2) == ("ok", "ok") and one[:8] == whole[:8] and two[:8] == bytes(second[:8])
    assert (rows(one)[:510] == rows(whole)[:510]).all() and (rows(two)[20:] == rows(whole)[20:]).all()
    assert repair.repair_pair(whole + bytes(second))[0][0] == "no_fill" and repair.repair_pair(whole[:1000])[0][0] == "delta_range"


def test_a_run_of_two_is_two_rows(spark, whole):
    run = whole[: U - 3 * L] + bytes(20 * L) + whole[20 * L :]
    df = spark.createDataFrame([("a", 5, run)], "capture_id string, counter_extended long, unit binary")
    assert [(r.counter_extended, r.status) for r in repair.repaired(df, ["capture_id"]).orderBy("counter_extended").collect()] == [(5, "ok"), (6, "ok")]
