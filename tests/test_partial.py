import numpy as np
from tests_support import raster_unit

from rastrum.operators import raster, sequence

RNG = np.random.default_rng(4)
ROWS = RNG.integers(1, 200, (525, 1440), dtype=np.uint8)


def test_partial_picture_of_two_fields():
    old = np.full((480, 1440), 7, np.uint8)
    got = raster.partial_picture(ROWS[:400], old)
    assert (got[0] == ROWS[19]).all() and (got[1] == ROWS[282]).all()
    assert (got[2 * 117 + 1] == ROWS[399]).all() and (got[2 * 118 + 1] == ROWS[19 + 118]).all()
    low = raster.partial_picture(ROWS[:400], old, d1=30)
    assert (low[2 * 213] == old[0]).all() or (low[2 * 213] != ROWS[262]).any()


def test_partial_picture_of_one_field():
    got = raster.partial_picture(ROWS[:150], None)
    assert (got[0] == ROWS[19]).all() and (got[1] == ((ROWS[19].astype(int) + ROWS[20] + 1) // 2)).all()
    assert (got[-1] == np.tile([128, 16], 720)).all()


def test_spans_and_the_stall():
    luma = RNG.integers(20, 200, (525, 720), dtype=np.uint8)
    px = np.frombuffer(raster_unit(luma, 130), np.uint8).copy()
    px[48:].reshape(525, 720, 2)[raster.PADDING] = (128, 16)
    unit = bytearray(px.tobytes())
    whole = raster.spans(bytes(unit))
    assert [k for k, _, _ in whole] == ["padding", "data", "padding", "data", "padding"]
    assert whole[0][1:] == (48, 48 + 7 * 1440) and raster.stall(whole) is None
    unit[100_000:100_400] = bytes(400)
    unit[100_400:100_480] = b"\x00\xff\x21\x43" * 20
    unit[200_000:200_100] = bytes(100)
    cut = raster.spans(bytes(unit))
    assert ("junk", 100_000, 100_480) in cut and raster.stall(cut) == (100_000, 200_100)


def shifts(spark, late):
    df = spark.createDataFrame([("e", i, x) for i, x in enumerate(late)], "endpoint string, n long, late long").repartition(3)
    return [r.n for r in sequence.floor_shifts(df, ["endpoint"], "n", "late").orderBy("n").collect()]


def test_floor_shifts(spark):
    steady = [1000 + i % 7 for i in range(160)]
    assert shifts(spark, steady) == []
    assert shifts(spark, steady + [3_000_000 + x for x in steady]) == [160 + 47]
    assert shifts(spark, steady + [3_000_000] * 32 + steady) == []
