import fixtures as fx
import pytest

from rastrum.plans import transport
from rastrum.sources import recording


@pytest.fixture(scope="module")
def tpc(spark):
    recording.register(spark)
    return lambda path, **o: spark.read.format("tpc").options(path=str(path), **{k: str(v) for k, v in o.items()}).load()


def write(tmp_path, blob, name="a.tpc"):
    (tmp_path / name).write_bytes(blob)
    return tmp_path / name


def test_reads_every_record_whatever_the_splits(tpc, tmp_path):
    blob, truth = fx.transport(transfers=40)
    path = write(tmp_path, blob)
    rows = {}
    for split in (1 << 30, 5000, 1777):
        got = tpc(path, splitBytes=split).collect()
        rows[split] = sorted((r.file_off, r.rec_type, r.endpoint, r.submit_seq, bytes(r.payload or b"")) for r in got)
    assert rows[1 << 30] == rows[5000] == rows[1777]
    for endpoint, (nbytes, n) in truth.items():
        mine = [r for r in rows[5000] if r[1] == 0 and r[2] == endpoint]
        assert (sum(len(r[4]) for r in mine), len(mine)) == (nbytes, n)


def test_corrupt_bytes_are_reported_and_strict_mode_refuses_them(tpc, tmp_path):
    blob, _ = fx.transport(transfers=20)
    whole = len(tpc(write(tmp_path, blob, "w.tpc")).collect())
    cut = blob[:29] + b"\xde\xad" * 150 + blob[29:]
    got = tpc(write(tmp_path, cut)).collect()
    assert [(r.file_off, r.actual_len) for r in got if r.rec_type == -1] == [(29, 300)]
    assert len(got) == whole + 1
    assert tpc(tmp_path / "a.tpc", mode="DROPMALFORMED").count() == whole
    with pytest.raises(Exception, match="no whole record"):
        tpc(tmp_path / "a.tpc", mode="FAILFAST").collect()
    tail = tpc(write(tmp_path, blob + b"\x43\x41", "t.tpc")).where("rec_type = -1").collect()
    assert [(r.file_off, r.actual_len) for r in tail] == [(len(blob), 2)]


def test_statistics_balance_and_verdict(tpc, tmp_path):
    blob, truth = fx.transport(transfers=12, short_every=5, loss_at=4, error_at=7)
    p = tpc(write(tmp_path, blob))
    per = {fx.VIDEO: 8, fx.AUDIO: 8}
    stats = {r.endpoint: r for r in transport.statistics(p, per).collect()}
    for endpoint, (nbytes, n) in truth.items():
        s = stats[endpoint]
        assert (s.records, s.bytes, s.transfers, s.sequence_gaps, s.inversions, s.index_errors) == (n, nbytes, 12, 0, 0, 0)
        assert s.short_payload > 0
    balance = {r.endpoint: r for r in transport.balance(p).collect()}
    assert (balance[fx.VIDEO].lost_packets, balance[fx.VIDEO].lost_bytes) == (3, 192)
    assert balance[fx.VIDEO].delivered_bytes == truth[fx.VIDEO][0]
    found = {(r.endpoint, r.finding): r.n for r in transport.verdict(p, per).collect()}
    assert found == {(fx.VIDEO, "host_loss"): 1, (fx.VIDEO, "submit_failure"): 1}
    assert transport.heartbeat(p).count() == 0


def test_gaps_inversions_and_index_errors(tpc, tmp_path):
    v = lambda i, s: fx.data(fx.VIDEO, i, s, b"x" * 8)
    order = [(0, 0), (1, 0), (0, 1), (1, 1), (0, 4), (1, 4), (0, 3), (1, 3), (0, 4), (2, 4)]
    p = tpc(write(tmp_path, b"".join(v(*x) for x in order)))
    s = transport.statistics(p, {fx.VIDEO: 2}).first()
    assert (s.sequence_gaps, s.inversions, s.transfers) == (2, 1, 5)
    flags = [r.flags for r in transport.contiguity(p).orderBy("file_off").collect()]
    assert flags == [0, 0, 0, 0, 1, 0, 1, 0, 0, 1]


def test_late_and_hole_records_go_where_they_belong(tpc, tmp_path):
    blob = fx.data(fx.VIDEO, 0, 0, b"x") + fx.record(1, fx.VIDEO, 0xFFFC, 7, 0, 5) + fx.record(1, 0, 0xFFF9, 0, 0, 0, 99) + fx.record(1, fx.AUDIO, 0xFFFD, 1, 0, 2)
    p = tpc(write(tmp_path, blob + fx.data(fx.AUDIO, 0, 0, b"y")))
    assert sorted((r.kind, r.stream) for r in transport.positioned_losses(p).collect()) == [("hole", fx.VIDEO), ("hole", fx.AUDIO), ("unread", fx.AUDIO)]
    assert [(r.submit_seq, r.packets) for r in transport.late_losses(p).collect()] == [(7, 5)]


def test_written_recording_reads_back(spark, tpc, tmp_path):
    blob, _ = fx.transport(transfers=3)
    p = tpc(write(tmp_path, blob))
    p.coalesce(1).write.format("tpc").mode("append").save(str(tmp_path / "out"))
    assert (tmp_path / "out" / "part-00000.tpc").read_bytes() == blob


def test_growing_recording(spark, tpc, tmp_path):
    blob, _ = fx.transport(transfers=6)
    path = write(tmp_path, blob[:1003])
    got = spark.readStream.format("tpc").option("path", str(path)).option("maxRecordsPerTrigger", "7").load()
    run = got.writeStream.format("memory").queryName("grown").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        run.processAllAvailable()
        assert spark.table("grown").count() > 0
        path.write_bytes(blob)
        run.processAllAvailable()
        batch = tpc(path).select("file_off", "rec_type").collect()
        assert sorted(spark.table("grown").select("file_off", "rec_type").collect()) == sorted(batch)
    finally:
        run.stop()
