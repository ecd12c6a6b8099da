"""Framing: byte streams into video units and audio records.

Markers are found in parallel, where the packets were read; a tail of bytes is kept from
packet to packet inside a partition, and only the first and last bytes of each partition
travel to be put together. What decides where units begin and end is a small machine over
the markers, losses and audio counters of one capture's epoch: tens of rows a second of
recording, without any payload. Everything is placed on one axis, the number of video
bytes fed before it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.transport import ERROR, LOSS, contiguity, positioned_losses
from ..sources.recording import AUDIO, DATA, HOST_LOSS, VIDEO
from .ordered import Scan, materialised

#: Fixed values of the stream's format.
UNIT, HEADER, ROW = 756_048, 48, 1440
SLACK = 64 * ROW
LONGEST, DOUBLE = UNIT + SLACK, 2 * UNIT + SLACK
BUFFER = DOUBLE + 32
MARKER = b"\x00\x00\xff\xff"
PICTURE, NO_SIGNAL = 0xE801, 0x0800
RECORD, SYNC, SYNC_TAG = 24, b"DeckLinkAudioResyncT", b"\x65\x6e"
#: Bytes after a marker that a decision may need: header and 64 bytes of payload.
LOOK = HEADER + 64
DISCONTINUITY = 16
HOLE_FLAGS = 1 | 2 | LOSS | ERROR


def plausible_format(fmt: int) -> bool:
    return fmt == NO_SIGNAL or fmt & 0xFF00 in (0xE800, 0xE100)


def plausible_format_column(fmt: Column) -> Column:
    return (fmt == NO_SIGNAL) | fmt.bitwiseAND(0xFF00).isin(0xE800, 0xE100)


def little_endian(column: str, at: int) -> Column:
    """The 16-bit number at a place (from 1) of a binary column."""
    byte = lambda i: F.conv(F.hex(F.substring(column, i, 1)), 16, 10).cast("int")
    return byte(at) + byte(at + 1) * 256


# --- finding patterns in parallel -------------------------------------------------------------

_FOUND = pa.schema([("capture_id", pa.string()), ("kind", pa.string()), ("file_off", pa.int64()), ("in_off", pa.int64()), ("bytes", pa.binary()), ("at", pa.list_(pa.int64())), ("len", pa.list_(pa.int64()))])
_FOUND_DDL = "capture_id string, kind string, file_off long, in_off long, bytes binary, at array<long>, len array<long>"


def _finder(pattern: bytes, look: int):
    """Occurrences with `look` bytes from their start (kind hit), and each partition's first and last bytes (kinds head, tail)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[str, dict] = {}
        rows: list[tuple] = []

        def place(held: list[tuple[int, int, int]], i: int) -> tuple[int, int]:
            # held: packets as (file offset, first byte in the packet, bytes); i counts the kept bytes.
            for off, first, n in held:
                if i < n:
                    return off, first + i
                i -= n
            raise IndexError(i)

        for batch in batches:
            for capture, off, payload in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                s = state.setdefault(capture, {"bytes": b"", "held": [], "head": b"", "head_held": []})
                if len(s["head"]) < look:
                    part = payload[: look - len(s["head"])]
                    s["head"] += part
                    s["head_held"].append((off, 0, len(part)))
                s["bytes"] += payload
                s["held"].append((off, 0, len(payload)))
                at, stop = 0, len(s["bytes"]) - look
                while stop >= 0 and 0 <= (at := s["bytes"].find(pattern, at, stop + len(pattern))) <= stop:
                    rows.append((capture, "hit", *place(s["held"], at), s["bytes"][at : at + look], None, None))
                    at += 1
                # Starts up to `stop` are settled; the look - 1 bytes behind stay.
                drop = max(0, stop + 1)
                s["bytes"] = s["bytes"][drop:]
                while s["held"] and drop:
                    o, first, n = s["held"][0]
                    cut = min(n, drop)
                    s["held"][0] = (o, first + cut, n - cut)
                    drop -= cut
                    if s["held"][0][2] == 0:
                        s["held"].pop(0)
            if rows:
                yield _rows(rows)
                rows = []
        for capture, s in state.items():
            for kind, held, data in (("head", s["head_held"], s["head"]), ("tail", s["held"], s["bytes"])):
                held = [h for h in held if h[2]]
                if held:
                    rows.append((capture, kind, held[0][0], held[0][1], data, [h[0] for h in held], [h[2] for h in held]))
        if rows:
            yield _rows(rows)

    return run


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _FOUND, strict=True)], schema=_FOUND)


def _stitch(pattern: bytes, look: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        edges = pdf.sort_values(["file_off", "in_off"])
        out, tails = [], edges[edges["kind"] == "tail"]
        heads = edges[edges["kind"] == "head"]
        for t in tails.itertuples():
            data, held = bytes(t.bytes), [(o, t.in_off if i == 0 else 0, n) for i, (o, n) in enumerate(zip(t.at, t.len, strict=True))]
            own, last = len(data), t.at[-1]
            # Bytes of later partitions, as many as the last start in the tail needs.
            for h in heads[heads["file_off"] > last].itertuples():
                if len(data) >= own + look:
                    break
                data += bytes(h.bytes)
            at = -1
            while 0 <= (at := data.find(pattern, at + 1)) < own:
                i, spot = at, None
                for o, first, n in held:
                    if i < n:
                        spot = (o, first + i)
                        break
                    i -= n
                out.append((key[0], *spot, data[at : at + look]))
        return pd.DataFrame(out, columns=["capture_id", "file_off", "in_off", "bytes"])

    return run


def find_pattern(packets: DataFrame, endpoint: int, pattern: bytes, look: int) -> DataFrame:
    """capture_id, file_off and in_off of each occurrence's start, and `look` bytes from there (fewer at the end).

    packets must be in reading order inside each partition, as format("tpc") gives them.
    """
    data = packets.where((F.col("rec_type") == DATA) & (F.col("endpoint") == endpoint) & (F.length("payload") > 0)).select("capture_id", "file_off", "payload")
    # A row a hit and two a partition are read twice below, the recording once.
    found = materialised(data.mapInArrow(_finder(pattern, look), _FOUND_DDL))
    hits = found.where("kind = 'hit'").select("capture_id", "file_off", "in_off", "bytes")
    edges = found.where("kind <> 'hit'").groupBy("capture_id").applyInPandas(_stitch(pattern, look), "capture_id string, file_off long, in_off long, bytes binary")
    return hits.unionByName(edges)


# --- positions ------------------------------------------------------------------------------------


def positions(packets: DataFrame, block: int = 64 << 20) -> DataFrame:
    """Data records without payload: flags, and the bytes of each endpoint fed before and with them."""
    meta = contiguity(packets.drop("payload"), block)
    length = F.col("actual_len")
    summed = Scan(["capture_id"], "file_off", block).running(video_to=F.when(F.col("endpoint") == VIDEO, length), audio_to=F.when(F.col("endpoint") == AUDIO, length)).over(meta)
    # Twenty-odd bytes a packet, read by every step below.
    return materialised(summed.select("capture_id", "file_off", "endpoint", "flags", "actual_len", "video_to", "audio_to"))


def video_markers(packets: DataFrame, at: DataFrame) -> DataFrame:
    """capture_id, pos (bytes fed before it), counter16, format, padded (null if the stream ends first)."""
    hits = find_pattern(packets, VIDEO, MARKER, LOOK)
    number = lambda i: little_endian("bytes", i)
    rows = hits.join(at.select("capture_id", "file_off", (F.col("video_to") - F.col("actual_len")).alias("__from")), ["capture_id", "file_off"])
    padded = F.when(F.length("bytes") == LOOK, F.substring("bytes", HEADER + 1, 64) == F.unhex(F.lit("8010" * 32)))
    return rows.where(F.length("bytes") >= 8).select("capture_id", (F.col("__from") + F.col("in_off")).alias("pos"), number(5).alias("counter16"), number(7).alias("format"), padded.alias("padded"))


def audio_holes(packets: DataFrame, at: DataFrame) -> DataFrame:
    """capture_id, file_off, flags of what breaks the audio stream: flagged packets, losses, errors."""
    flagged = at.where((F.col("endpoint") == AUDIO) & (F.col("flags") != 0)).select("capture_id", "file_off", "flags")
    lost = positioned_losses(packets.drop("payload")).where(F.col("stream") == AUDIO).select("capture_id", "file_off", F.when(F.col("rec_type") == HOST_LOSS, LOSS).otherwise(ERROR).alias("flags"))
    return flagged.unionByName(lost)


def audio_records(packets: DataFrame, at: DataFrame, block: int = 64 << 20) -> dict[str, DataFrame]:
    """The audio stream's resync records, its segments (between holes) and their unframed bytes.

    A segment locks to its first resync record; from there every 24 bytes are a record, a
    resync if its bytes say so, else one sample. The leading bytes, and a rest of under 24, are unframed.
    """
    audio = at.where((F.col("endpoint") == AUDIO)).select("capture_id", "file_off", F.col("audio_to").alias("to"), (F.col("audio_to") - F.col("actual_len")).alias("from"), "flags", F.lit(0).alias("hole"))
    holes = audio_holes(packets, at).select("capture_id", "file_off").distinct()
    # A hole stands before the bytes of its own record: odd places are records, even ones holes.
    both = audio.withColumn("__o", F.col("file_off") * 2 + 1).select("capture_id", "__o", "from", "to", F.lit(0).alias("hole")).unionByName(
        holes.select("capture_id", (F.col("file_off") * 2).alias("__o"), F.lit(None).cast("long").alias("from"), F.lit(None).cast("long").alias("to"), F.lit(1).alias("hole"))
    )
    cut = Scan(["capture_id"], "__o", 2 * block).running(segment=F.col("hole")).over(both).where("hole = 0")
    cut = materialised(cut)
    segments = cut.groupBy("capture_id", "segment").agg(F.min("from").alias("from"), F.max("to").alias("to"), F.min("__o").alias("first"))
    hits = find_pattern(packets, AUDIO, SYNC, RECORD).where((F.length("bytes") == RECORD) & (F.substring("bytes", 23, 2) == F.lit(SYNC_TAG)))
    number = little_endian("bytes", 21)
    placed = hits.withColumn("__o", F.col("file_off") * 2 + 1).join(cut.select("capture_id", "__o", "from", "segment"), ["capture_id", "__o"])
    placed = placed.select("capture_id", "segment", (F.col("from") + F.col("in_off")).alias("pos"), number.alias("counter16"))
    ends = segments.select("capture_id", "segment", "to")
    whole = placed.join(ends, ["capture_id", "segment"]).where(F.col("pos") + RECORD <= F.col("to")).drop("to")
    locks = whole.groupBy("capture_id", "segment").agg(F.min("pos").alias("lock"))
    aligned = materialised(whole.join(locks, ["capture_id", "segment"]).where((F.col("pos") - F.col("lock")) % RECORD == 0))
    per = aligned.groupBy("capture_id", "segment").agg(F.count("*").alias("resyncs"))
    told = segments.join(locks, ["capture_id", "segment"], "left").join(per, ["capture_id", "segment"], "left")
    records = F.coalesce(F.expr(f"(to - lock) div {RECORD}"), F.lit(0))
    told = told.withColumn("samples", records - F.coalesce("resyncs", F.lit(0))).withColumn("leading", F.coalesce("lock", "to") - F.col("from"))
    told = told.withColumn("trailing", F.when(F.col("lock").isNotNull(), (F.col("to") - F.col("lock")) % RECORD).otherwise(0))
    told = Scan(["capture_id"], "segment").running(__upto=F.col("samples")).over(told).withColumn("first_ordinal", F.col("__upto") - F.col("samples")).drop("__upto")
    told = materialised(told)
    ordered = Scan(["capture_id", "segment"], "pos", block).running(__n=F.lit(1)).over(aligned)
    resyncs = ordered.join(told.select("capture_id", "segment", "first_ordinal"), ["capture_id", "segment"]).select("capture_id", "segment", "pos", "counter16", (F.col("first_ordinal") + F.expr(f"(pos - lock) div {RECORD}") - (F.col("__n") - 1)).alias("sample_ordinal"))
    from .sequence import unwrap_counter

    resyncs = unwrap_counter(resyncs, ["capture_id"], "pos", "counter16", block).withColumnRenamed("extended", "counter_extended")
    return {"resyncs": materialised(resyncs), "segments": told.drop("first")}


# --- the machine -------------------------------------------------------------------------------------


#: Rules by which a marker is weighed: the first whose words all hold ("-": doesn't hold) gives the verdict.
BEGINS = (
    ("payload", "-plausible"),
    ("begins", "-running"),
    ("begins", "next"),
    ("begins", "two units"),
    # After a run without picture the audio's counter can vouch for a marker, if padding follows it.
    ("wait", "-picture run", "vouched", "-looked"),
    ("begins unheard", "-picture run", "vouched", "padded"),
    ("stale", "unit long"),
    # No signal inside a picture's run: what comes next tells whether the picture is lost.
    ("hold", "picture run", "blank", "vouched run", "-pending"),
    ("payload",),
)
#: Whether a run that ends without its successor keeps its counter.
ENDS = (
    ("doubtful", "-vouched run"),
    ("doubtful", "-run ahead"),
    ("confirmed", "-picture"),
    ("confirmed", "two later", "vouched"),
    ("confirmed", "three later", "-double length", "vouched"),
    ("doubtful",),
)
#: What a marker says of a no-signal marker before it.
AFTER_BLANK = (
    ("lost picture", "blank", "next blank"),
    ("payload", "two units"),
    ("lost picture", "picture", "later"),
    ("repeated", "blank", "same blank"),
    ("payload",),
)


def verdict(rules: tuple[tuple[str, ...], ...], seen: dict[str, bool]) -> str:
    return next(said for said, *words in rules if all(not seen.get(w[1:], False) if w[0] == "-" else seen.get(w, False) for w in words))


@dataclass
class Framer:
    """Decides where video units begin and end. Feed events in order of position; `units` collects rows."""

    units: list[dict] = field(default_factory=list)
    most_unframed: int = UNIT
    start: int = 0  # first byte that is buffered
    pos: int = 0  # bytes fed
    flags: int = 0
    run: tuple[int, int] | None = None  # counter and format of the marker at `start`
    vouched: bool = False
    candidate: tuple[int, int, int, bool | None] | None = None  # marker not decided yet
    wait: bool = False
    pending: tuple[int, int] | None = None  # no-signal marker inside a picture run: position, counter
    audio16: int | None = None
    audio_extended: int = 0
    since_audio: int = 0
    video16: int | None = None
    video_extended: int = 0

    # What the audio stream says.
    def audio(self, counter16: int, extended: int) -> None:
        self.audio16, self.audio_extended, self.since_audio = counter16, extended, 0

    def vouches(self, counter: int, fmt: int) -> bool:
        return fmt == PICTURE and self.audio16 is not None and (counter - self.audio16) & 0xFFFF in (0, 1)

    def _extend(self, counter: int) -> tuple[int, int]:
        """Extended value of a confirmed unit's counter, and flags."""
        before, known = self.video_extended, self.video16 is not None
        if self.audio16 is None or self.since_audio >= 0x4000:
            if not known:
                extended, flag = counter, 0
            else:
                step = (counter - self.video16) & 0xFFFF
                forward = 1 <= step < 0x8000
                extended, flag = before + (step if forward else 1), 0 if step == 1 else DISCONTINUITY
        else:
            self.since_audio += 1
            step = (counter - self.audio16 + 0x8000 & 0xFFFF) - 0x8000
            if step < 0 and -step > self.audio_extended:
                step += 0x10000
            extended = self.audio_extended + step
            flag = DISCONTINUITY if known and extended != before + 1 else 0
        self.video16, self.video_extended = counter, extended
        return extended, flag

    def emit(self, end: int, marked: bool, confirmed: bool, flags: int, stale: bool) -> None:
        n = end - self.start
        if n <= 0:
            return
        row = {"ordinal": len(self.units), "start_off": self.start, "end_off": end, "byte_count": n, "counter16": None, "format": None, "counter_extended": None, "counter_confirmed": False, "kind": "unframed", "transport": "hole" if flags else "unframed"}
        if marked and n >= 8 and self.run:
            counter, fmt = self.run
            row |= {"counter16": counter, "format": fmt, "kind": {PICTURE: "picture", NO_SIGNAL: "no_signal"}.get(fmt, "other_format")}
            if confirmed and fmt != NO_SIGNAL:
                row["counter_extended"], more = self._extend(counter)
                row["counter_confirmed"] = True
                flags |= more
            else:
                row["counter_extended"] = self.audio_extended if self.audio16 is not None else self.video_extended if self.video16 is not None else 0
            picture = fmt == PICTURE
            row["transport"] = "hole" if flags & HOLE_FLAGS else "short" if picture and n < UNIT else "unframed" if picture and (n > UNIT or stale) else "complete"
        row["transport_flags"] = flags
        row["eligible"] = row["kind"] == "picture" and row["transport"] == "complete" and n == UNIT
        self.units.append(row)

    def _begin(self, at: int, counter: int, fmt: int) -> None:
        self.start, self.run, self.flags, self.pending = at, (counter, fmt), 0, None
        self.vouched = self.vouches(counter, fmt)

    def _relation(self, at: int, counter: int, fmt: int) -> dict[str, bool]:
        """What a marker is to the run that is buffered; the rules below are written in these words."""
        if self.run is None:
            return {"running": False, "plausible": plausible_format(fmt)}
        run, run_fmt = self.run
        step, length = (counter - run) % 65536, at - self.start
        two_long = 2 * UNIT <= length + SLACK
        ahead = None if self.video16 is None else (run - self.video16) % 65536
        return {
            "running": True, "plausible": plausible_format(fmt), "picture": fmt == PICTURE, "blank": fmt == NO_SIGNAL, "picture run": run_fmt == PICTURE,
            "next": step == 1 and length <= LONGEST, "two units": step == 2 and two_long and length <= DOUBLE,
            "two later": step == 2, "three later": step == 3, "later": 2 <= step < 0x8000, "double length": two_long and length <= DOUBLE + SLACK, "unit long": length >= UNIT,
            "vouched": self.vouches(counter, fmt), "vouched run": self.vouched, "run ahead": ahead is None or 1 <= ahead < 0x8000, "pending": self.pending is not None,
        }

    def _end_stale(self, at: int, counter: int, fmt: int) -> None:
        """The run ends without its successor at a marker that begins another."""
        good = verdict(ENDS, self._relation(at, counter, fmt)) == "confirmed"
        self.emit(at, True, good, self.flags | (0 if good else DISCONTINUITY), not good)
        self._begin(at, counter, fmt)

    def feed(self, to: int, markers: list[tuple[int, int, int, bool | None]]) -> None:
        """Bytes up to `to`; markers: those whose first four bytes lie in them, in order, as (position, counter, format, padded)."""
        markers = list(markers)
        if self.wait and self.pos < to:
            # A marker that waits for its padding is weighed anew with every byte: what audio says may have changed.
            self._decide(self.pos + 1)
        while True:
            events = [(self.start + BUFFER + 1, 0)]
            if self.run is None:
                events.append((self.start + self.most_unframed, 1))
            if markers:
                events.append((markers[0][0] + 4, 2))
            if self.candidate:
                events.append((self.candidate[0] + (LOOK if self.wait else 8), 3))
            at, what = min(events)
            if at > to:
                break
            if what == 0:
                self.pos = at - 1
                if self.pending:
                    spot, counter = self.pending
                    self._end_stale(spot, counter, NO_SIGNAL)
                if self.pos - self.start >= BUFFER:
                    self.emit(self.pos, self.run is not None, False, self.flags | DISCONTINUITY, False)
                    self.start, self.run, self.candidate, self.wait, self.flags, self.pending = self.pos, None, None, False, 0, None
            elif what == 1:
                self.pos = at
                # Seven bytes stay: a marker may have begun.
                self.emit(at - 7, False, False, self.flags, False)
                self.start, self.flags, self.candidate = at - 7, 0, None
            elif what == 2:
                self.pos = at
                found = markers.pop(0)
                if found[0] >= self.start:
                    self.candidate, self.wait = found, False
            else:
                self._decide(at)
        self.pos = max(self.pos, to)

    def _decide(self, at: int) -> None:
        self.pos = at
        spot, counter, fmt, padded = self.candidate
        if self.pending and spot > self.pending[0]:
            (blank_at, blank), self.pending = self.pending, None
            seen = self._relation(spot, counter, fmt) | {"next blank": counter == (blank + 1) % 65536, "same blank": counter == blank}
            said = verdict(AFTER_BLANK, seen)
            if said == "lost picture":
                self._end_stale(blank_at, blank, NO_SIGNAL)
            elif said == "repeated":
                self.candidate, self.wait = None, False
                return
        seen = self._relation(spot, counter, fmt) | {"looked": at >= spot + LOOK, "padded": bool(padded)}
        said = verdict(BEGINS, seen)
        if said == "wait":
            self.wait = True
            return
        self.candidate, self.wait = None, False
        if said == "hold":
            self.pending = (spot, counter)
        elif said == "stale":
            self._end_stale(spot, counter, fmt)
        elif said in ("begins", "begins unheard"):
            running = self.run is not None
            self.emit(spot, running, running and said == "begins", self.flags, False)
            self._begin(spot, counter, fmt)

    def finish(self) -> None:
        if self.pos > self.start:
            self.emit(self.pos, False, False, self.flags, False)


UNITS_DDL = (
    "capture_id string, epoch long, ordinal long, counter16 int, counter_extended long, format int, kind string, transport string, transport_flags int, "
    "byte_count long, start_off long, end_off long, eligible boolean, counter_confirmed boolean"
)


def frame(events: pd.DataFrame) -> list[dict]:
    """Units of one epoch from its events: pos, rank, kind (marker, flags, audio, end) and what each carries."""
    machine, markers = Framer(), []
    rows = events.sort_values(["pos", "rank", "seq"])
    waiting = rows[rows["kind"] == "marker"]
    queue = list(zip(waiting["pos"].astype(int), waiting["a"].astype(int), waiting["b"].astype(int), [None if pd.isna(x) else bool(x) for x in waiting["c"]], strict=True))
    i = 0
    for e in rows[rows["kind"] != "marker"].itertuples():
        while i < len(queue) and queue[i][0] + 4 <= e.pos:
            markers.append(queue[i])
            i += 1
        machine.feed(int(e.pos), markers)
        markers = []
        if e.kind == "audio":
            machine.audio(int(e.a), int(e.b))
        elif e.kind == "flags":
            machine.flags |= int(e.a)
    machine.finish()
    return machine.units


def _framed(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    units = pd.DataFrame(frame(pdf))
    columns = [c.split(" ")[0] for c in UNITS_DDL.split(", ")]
    if units.empty:
        return pd.DataFrame(columns=columns)
    return units.assign(capture_id=key[0], epoch=1)[columns].astype({"counter16": "Int32", "format": "Int32", "counter_extended": "Int64"})


def video_units(packets: DataFrame, block: int = 64 << 20) -> DataFrame:
    """Video units of recordings, one epoch each: where they lie in the video stream, and what is known of them."""
    at = positions(packets, block)
    none = F.lit(None).cast("long")
    event = lambda df, kind, rank, pos, seq, a=none, b=none, c=none: df.select("capture_id", pos.cast("long").alias("pos"), F.lit(rank).alias("rank"), seq.cast("long").alias("seq"), F.lit(kind).alias("kind"), a.cast("long").alias("a"), b.cast("long").alias("b"), c.cast("long").alias("c"))
    markers = event(video_markers(packets, at), "marker", 9, F.col("pos"), F.col("pos"), F.col("counter16"), F.col("format"), F.col("padded").cast("int"))
    flagged = event(at.where((F.col("endpoint") == VIDEO) & (F.col("flags") != 0)), "flags", 1, F.col("video_to") - F.col("actual_len"), F.col("file_off"), F.col("flags"))
    lost = positioned_losses(packets.drop("payload")).where(F.col("stream") == VIDEO)
    heard = audio_records(packets, at, block)["resyncs"]
    # Where losses and resyncs fall on the video axis: the bytes fed before their record.
    marks = at.select("capture_id", "file_off", "video_to", F.lit(None).cast("long").alias("ask")).unionByName(lost.select("capture_id", "file_off", F.lit(None).cast("long").alias("video_to"), F.col("file_off").alias("ask")))
    known = Scan(["capture_id"], "file_off", block).last(fed=F.col("video_to")).over(marks).where("ask IS NOT NULL")
    losses = event(lost.join(known.select("capture_id", "file_off", "fed"), ["capture_id", "file_off"]), "flags", 1, F.coalesce("fed", F.lit(0)), F.col("file_off"), F.when(F.col("rec_type") == HOST_LOSS, LOSS).otherwise(ERROR))
    # A resync counts from the packet that holds its last byte.
    by_byte = at.where(F.col("endpoint") == AUDIO).select("capture_id", F.col("audio_to").alias("__to"), "video_to", "file_off")
    asked = heard.select("capture_id", (F.col("pos") + RECORD).alias("__to"), F.lit(None).cast("long").alias("video_to"), F.lit(None).cast("long").alias("file_off"), "counter16", "counter_extended")
    line = by_byte.withColumn("counter16", F.lit(None).cast("int")).withColumn("counter_extended", F.lit(None).cast("long")).unionByName(asked)
    # The first packet that ends at or after the byte: the next known one, in descending order the last.
    line = line.withColumn("__o", -(F.col("__to") * 2 + F.when(F.col("counter16").isNull(), 1).otherwise(0)))
    line = Scan(["capture_id"], "__o", 2 * block).last(__v=F.col("video_to"), __f=F.col("file_off")).over(line).where("counter16 IS NOT NULL")
    audio = event(line, "audio", 1, F.col("__v"), F.col("__f") * 4096 + F.pmod(F.col("__to"), F.lit(4096)), F.col("counter16"), F.col("counter_extended"))
    end = event(at.groupBy("capture_id").agg(F.max("video_to").alias("fed")), "end", 10, F.col("fed"), F.lit(0))
    events = markers.unionByName(flagged.withColumn("seq", F.col("seq") * 4096)).unionByName(losses.withColumn("seq", F.col("seq") * 4096)).unionByName(audio).unionByName(end)
    return events.groupBy("capture_id").applyInPandas(_framed, UNITS_DDL)


#: Starts of epochs that one capture may have.
MOST_EPOCHS = 65_536
_SEP = "\x1f"


def video_units_by_epoch(packets: DataFrame, starts: DataFrame, block: int = 64 << 20) -> DataFrame:
    """Video units of recordings that begin anew at some records: starts has capture_id, file_off of the epoch's first record, and epoch (from 2 on).

    What is buffered at the end of an epoch is flushed, and nothing of it goes into the next: an epoch is framed like a capture of its own. Positions
    and ordinals count from the epoch's begin.
    """
    n = starts.limit(MOST_EPOCHS + 1).count()
    if n > MOST_EPOCHS:
        raise ValueError(f"over {MOST_EPOCHS} starts of epochs")
    folded = starts.groupBy(F.col("capture_id").alias("__c")).agg(F.array_sort(F.collect_list(F.struct("file_off", "epoch"))).alias("__starts"))
    known = packets.join(F.broadcast(folded), packets["capture_id"] == folded["__c"], "left")
    last = F.try_element_at(F.filter("__starts", lambda s: s["file_off"] <= F.col("file_off")), F.lit(-1))["epoch"]
    named = known.withColumn("capture_id", F.concat_ws(_SEP, "capture_id", F.coalesce(last, F.lit(1)).cast("string"))).select(*packets.columns)
    units = video_units(named, block)
    parts = F.split("capture_id", _SEP)
    return units.withColumn("epoch", F.element_at(parts, -1).cast("long")).withColumn("capture_id", F.element_at(parts, 1))


# --- what may be done with units that aren't whole ---------------------------------------------------


def repair_candidates(units: DataFrame) -> DataFrame:
    """Adds `repairable`: a confirmed picture unit of a wrong length that one stall or insert can explain, or a run of two."""
    n = F.col("byte_count")
    near = (n != UNIT) & (n >= UNIT - SLACK) & (n <= DOUBLE)
    short = (F.col("transport") == "short") & (n <= LONGEST)
    return units.withColumn("repairable", (F.col("kind") == "picture") & F.col("counter_confirmed") & near & (short | (F.col("transport") == "unframed")))


def showable_parts(units: DataFrame, picture_bytes: str = "picture_bytes", least_rows: int = 32) -> DataFrame:
    """Adds `showable`: a unit cut short that still holds `least_rows` rows of picture; units with bytes missing inside are none."""
    whole = ~F.col("transport").isin("hole", "unframed") & (F.col("byte_count") <= UNIT)
    return units.withColumn("showable", F.coalesce(whole & (F.col("format").bitwiseAND(0xFF00) == 0xE800) & (F.col(picture_bytes) >= HEADER + least_rows * ROW), F.lit(False)))


def sampled_units(units: DataFrame, keys: list[str], order: str, every: int = 4) -> DataFrame:
    """One whole unit in `every`, from the first on: those the noise meter looks at."""
    numbered = Scan(keys, order).running(__n=F.lit(1)).over(units.where((F.col("transport") == "complete") & F.col("eligible")))
    return numbered.where((F.col("__n") - 1) % every == 0).drop("__n")


def first_units(units: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n units in order."""
    return units.orderBy(*order).limit(n)


def overridden(decisions: DataFrame, first1: int = 0, first2: int = 0) -> DataFrame:
    """Decisions with registration off: every frame at the nominal place, or at the first lines given; what was decided stays in its other columns."""
    at = (first1 - 23 if first1 else 0, first2 - 286 if first2 else 0)
    return decisions.withColumns({f"d{k}": F.lit(x) for k, x in enumerate(at, 1)})


def parts_in_order(parts: list[DataFrame], order: str, size: list[int]) -> DataFrame:
    """The parts of one recording as one: `part` (from 1) and `position`, the record's place in all of it; size: bytes of each part."""
    out, base = None, 0
    for n, (df, nbytes) in enumerate(zip(parts, size, strict=True), 1):
        one = df.withColumn("part", F.lit(n)).withColumn("position", F.col(order) + base)
        out = one if out is None else out.unionByName(one)
        base += nbytes
    return out
