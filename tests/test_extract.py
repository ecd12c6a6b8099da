import hashlib
import json

import fixtures as fx
import pytest
import zstandard

from rastrum.operators import framing
from rastrum.plans import extract, transport
from rastrum.sources import pixels, recording


@pytest.fixture(scope="module")
def packets(spark, tmp_path_factory):
    recording.register(spark)
    path = tmp_path_factory.mktemp("x") / "a.tpc"
    blob, _ = fx.transport(transfers=12)
    path.write_bytes(blob)
    return spark.read.format("tpc").option("path", str(path)).load(), blob


def test_slice_keeps_records_and_says_where_from(packets, tmp_path):
    p, blob = packets
    cut = extract.slice_records(p, 500, 2000, "slice")
    rows = cut.orderBy("file_off").collect()
    assert rows[0].rec_type == 3 and bytes(rows[0].payload) == b"slice bytes 500..2000 of a.tpc"
    assert [r.file_off for r in rows[1:]] == [r.file_off for r in p.orderBy("file_off").collect() if 500 <= r.file_off < 2000]
    cut.orderBy("file_off").coalesce(1).write.format("tpc").mode("append").save(str(tmp_path / "o"))
    back = cut.sparkSession.read.format("tpc").option("path", str(tmp_path / "o")).option("mode", "FAILFAST").load()
    assert back.count() == len(rows)


def test_endpoint_stream(packets):
    p, blob = packets
    got = b"".join(bytes(r.payload) for r in extract.endpoint_stream(p, fx.VIDEO).collect())
    want = b"".join(bytes(r.payload) for r in p.where("rec_type = 0 AND endpoint = 131").orderBy("file_off").collect())
    assert got == want and len(got) == 12 * 8 * 64


def test_sync_map_and_audio_window(spark, tmp_path):
    recording.register(spark)
    (tmp_path / "b.tpc").write_bytes(fx.plain(4))
    p = spark.read.format("tpc").option("path", str(tmp_path / "b.tpc")).load()
    resyncs = framing.audio_records(p, framing.positions(p))["resyncs"]
    rows = extract.sync_map(framing.video_units(p), resyncs).orderBy("counter_extended").collect()
    assert [(r.counter_extended, r.sample_ordinal) for r in rows] == [(0, 0), (1, 1602), (2, 3203)]
    w = extract.audio_window(resyncs, 1, 3).first()
    assert (w.from_sample, w.to_sample) == (1602, 4805)
    assert extract.audio_window(resyncs, 1, 9).count() == 0


def test_resync_owners(spark):
    blocks = spark.createDataFrame([("a", 1, 0, 99), ("a", 1, 100, 199), ("a", 2, 300, 399)], "k string, run long, first long, last long")
    resyncs = spark.createDataFrame([("a", 0), ("a", 150), ("a", 250), ("a", 399), ("a", 500)], "k string, sample_ordinal long")
    got = {r.sample_ordinal: r.runs for r in extract.resync_owners(blocks, resyncs, ["k"]).collect()}
    assert got == {0: [1], 150: [1], 250: [1, 2], 399: [2], 500: [2]}


def test_proofs_and_labels(spark):
    sha = lambda b: hashlib.sha1(b).hexdigest()
    pieces = spark.createDataFrame([(1, b"a"), (2, b"b"), (3, b"c")], "piece long, payload binary")
    want = spark.createDataFrame([(1, sha(b"a")), (2, sha(b"x")), (4, sha(b"d"))], "piece long, sha1 string")
    assert {r.piece: r.proof for r in extract.proven(pieces, want, "piece").collect()} == {1: "same", 2: "differs", 3: "unknown", 4: "missing"}
    labels = spark.createDataFrame([(1, "positive", hashlib.sha256(b"a").hexdigest()), (2, "negative", "00")], "piece long, label string, sha256 string")
    assert {r.piece: r.intact for r in extract.labelled_rows(labels, pieces, "piece", "payload", "sha256").collect()} == {1: True, 2: False}


def test_timeline_and_status(spark, packets):
    rows = [("a", 1, 1000, 0), ("a", 2, 1000 + 8008, 0), ("a", 3, 1000 + 5 * 8008 + 90, 0), ("a", 4, None, 2), ("a", 5, 1000, 0)]
    df = spark.createDataFrame(rows, "k string, n long, pts long, between long")
    assert [r.slot for r in extract.fill_timeline(df, ["k"], "n", "pts", "between").orderBy("n").collect()] == [0, 1, 5, 8, 9]
    found = transport.verdict(packets[0], {fx.VIDEO: 9, fx.AUDIO: 8})
    status = json.loads(extract.status_report(found).first().status)
    assert status["findings"][0]["finding"] == "index_errors"


def test_published_pixels(spark, tmp_path):
    pixels.register(spark)
    frames = [bytes([i]) * 1000 for i in range(250)]
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "raw").write_bytes(b"".join(frames))
    (tmp_path / "d" / "packed.zst").write_bytes(zstandard.compress(b"".join(frames[:7])))
    got = spark.read.format("pixels").option("path", str(tmp_path / "d")).option("frameBytes", "1000").load()
    assert sorted((r.file, r.frame, bytes(r.pixels)[0], len(r.pixels)) for r in got.collect()) == sorted([("raw", i, i, 1000) for i in range(250)] + [("packed.zst", i, i, 1000) for i in range(7)])
