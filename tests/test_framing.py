import fixtures as fx
import pytest

from rastrum.operators import framing
from rastrum.sources import recording


@pytest.fixture(scope="module")
def load(spark, tmp_path_factory):
    recording.register(spark)

    def run(blob, split=1 << 20):
        path = tmp_path_factory.mktemp("r") / "a.tpc"
        path.write_bytes(blob)
        return spark.read.format("tpc").option("path", str(path)).option("splitBytes", str(split)).load()

    return run


@pytest.mark.parametrize("split", [1 << 30, 300_000])
def test_adversarial_stream(load, split):
    p = load(fx.adversarial(), split)
    units = framing.video_units(p).orderBy("ordinal").collect()
    W = fx.UNIT
    assert [(u.counter16, u.byte_count, u.kind, u.transport, u.eligible) for u in units] == [
        (None, 3, "unframed", "unframed", False),
        (65534, W, "picture", "complete", True),
        (65535, W - 224, "picture", "short", False),
        (0, W, "picture", "hole", False),
        (1, W, "picture", "complete", True),
        (None, 100, "unframed", "unframed", False),
    ]
    assert [u.counter_extended for u in units[1:5]] == [65534, 65535, 65536, 65537]
    assert units[3].transport_flags & 5 == 5 and not units[1].transport_flags
    audio = framing.audio_records(p, framing.positions(p))
    got = sorted((r.counter16, r.counter_extended, r.sample_ordinal) for r in audio["resyncs"].collect())
    assert got == [(0, 65536, 17), (1, 65537, 36), (65535, 65535, 0)]
    assert sorted((r.segment, r.first_ordinal, r.samples, r.leading) for r in audio["segments"].collect()) == [(0, 0, 36, 5), (1, 36, 1, 4)]


def test_plain_stream_is_whole(load):
    p = load(fx.plain())
    units = framing.video_units(p).orderBy("ordinal").collect()
    assert [(u.counter_extended, u.transport, u.eligible) for u in units[:-1]] == [(c, "complete", True) for c in range(5)]
    resyncs = framing.audio_records(p, framing.positions(p))["resyncs"].orderBy("pos").collect()
    assert [r.sample_ordinal for r in resyncs] == [0, 1602, 3203, 4805, 6406, 8007]


def test_an_epoch_begins_anew(load, spark):
    blob = fx.plain(units=3)
    p = load(blob + blob)
    starts = spark.createDataFrame([(p.first().capture_id, len(blob), 2)], "capture_id string, file_off long, epoch long")
    units = framing.video_units_by_epoch(p, starts).orderBy("epoch", "ordinal").collect()
    once = framing.video_units(load(blob)).orderBy("ordinal").collect()
    rows = lambda us: [(u.ordinal, u.counter_extended, u.transport, u.start_off, u.byte_count) for u in us]
    assert rows([u for u in units if u.epoch == 1]) == rows([u for u in units if u.epoch == 2]) == rows(once)
    assert {u.capture_id for u in units} == {p.first().capture_id}
