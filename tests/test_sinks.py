"""What is written is whole or not there; where reading begins and ends."""

import fixtures as fx
import pytest
from pyspark.sql import functions as F

from rastrum.operators import pictures
from rastrum.plans import transport
from rastrum.sources import recording, tables


@pytest.fixture(scope="module")
def blob(spark):
    recording.register(spark)
    return fx.transport(transfers=6)[0]


def read(spark, path, **options):
    return spark.read.format("tpc").options(path=str(path), **options).load()


def test_parts_are_named_when_all_are_whole(spark, blob, tmp_path):
    (tmp_path / "a.tpc").write_bytes(blob)
    out = tmp_path / "out"
    read(spark, tmp_path / "a.tpc").write.format("tpc").option("path", str(out)).mode("append").save()
    assert [p.name for p in out.iterdir()] == ["part-00000.tpc"] and (out / "part-00000.tpc").read_bytes() == blob


def test_a_failed_job_leaves_nothing(spark, blob, tmp_path):
    (tmp_path / "a.tpc").write_bytes(blob)
    out = tmp_path / "out"
    bad = read(spark, tmp_path / "a.tpc").withColumn("status", F.when(F.col("file_off") < 1000, F.col("status")).otherwise(F.raise_error(F.lit("broken")).cast("long")))
    with pytest.raises(Exception, match="broken"):
        bad.write.format("tpc").option("path", str(out)).mode("append").save()
    assert not [p for p in out.glob("*") if not p.name.startswith("_attempt")] if out.exists() else True


def test_payloads_alone(spark, blob, tmp_path):
    (tmp_path / "a.tpc").write_bytes(blob)
    video = read(spark, tmp_path / "a.tpc").where("rec_type = 0 AND endpoint = 131").orderBy("file_off").coalesce(1).select("payload")
    video.write.format("payload").option("path", str(tmp_path / "raw")).mode("append").save()
    assert (tmp_path / "raw" / "part-00000.raw").read_bytes() == b"".join(bytes(r.payload) for r in video.collect())


def test_reading_stops_at_the_first_bad_byte(spark, blob, tmp_path):
    (tmp_path / "b.tpc").write_bytes(blob[:2000] + b"junk" + blob[2000:])
    whole = read(spark, tmp_path / "b.tpc", mode="STOP", splitBytes="500").orderBy("file_off").collect()
    last = whole[-1]
    assert last.rec_type == recording.CORRUPT and last.file_off + last.actual_len == len(blob) + 4
    assert all(r.rec_type != recording.CORRUPT for r in whole[:-1]) and read(spark, tmp_path / "b.tpc").count() > len(whole)


def test_an_offset_is_aligned_to_a_transfer(spark, blob, tmp_path):
    (tmp_path / "a.tpc").write_bytes(blob)
    rows = {r.file_off: r for r in read(spark, tmp_path / "a.tpc").collect()}
    for offset in (1, 700, 3000):
        got = read(spark, tmp_path / "a.tpc", startingOffset=str(offset), splitBytes="1000").orderBy("file_off").collect()
        first = min(o for o, r in rows.items() if o >= offset and r.rec_type == 0 and r.endpoint == 0x83 and r.pkt_index == 0)
        assert got[0].rec_type == recording.CORRUPT and (got[0].file_off, got[0].actual_len) == (0, first)
        assert [r.file_off for r in got[1:]] == sorted(o for o in rows if o >= first)
    assert read(spark, tmp_path / "a.tpc", startingOffset=str(len(blob) - 10)).count() == 0
    assert transport.record_types(read(spark, tmp_path / "a.tpc")).count() > 1


def test_publishing_is_exclusive(spark, tmp_path):
    for name in ("x", "y"):
        (tmp_path / name).write_text(name)
    tables.publish(spark, str(tmp_path / "x"), str(tmp_path / "final"))
    with pytest.raises(FileExistsError):
        tables.publish(spark, str(tmp_path / "y"), str(tmp_path / "final"))
    assert (tmp_path / "final").read_text() == "x" and (tmp_path / "y").read_text() == "y"


def test_a_decision_log_is_never_overwritten(spark, tmp_path):
    df = spark.range(3)
    tables.write_decision_log(df, str(tmp_path / "log"))
    with pytest.raises(Exception, match="(?i)exists"):
        tables.write_decision_log(df, str(tmp_path / "log"))


def test_the_newest_log_that_holds_a_name(spark, tmp_path):
    import os

    for n, text in enumerate(["a tape7 one", "b tape7 two", "c other"]):
        (tmp_path / f"{n}.txt").write_text(text)
        os.utime(tmp_path / f"{n}.txt", (1_000_000 + n * 100,) * 2)
    assert [r.line for r in tables.newest_log(spark, str(tmp_path), "tape7").collect()] == ["b tape7 two"]


def test_an_outside_filter(spark):
    df = spark.createDataFrame([(i, bytes([65 + i]) * 5) for i in range(6)] + [(9, None)], "n long, payload binary").repartition(2)
    got = {r.n: bytes(r.payload) for r in pictures.filtered(df, ["tr", "A-Z", "a-z"]).collect()}
    assert got == {i: bytes([97 + i]) * 5 for i in range(6)} | {9: b""}
    with pytest.raises(Exception, match="bytes"):
        pictures.filtered(df, ["head", "-c", "3"]).collect()
