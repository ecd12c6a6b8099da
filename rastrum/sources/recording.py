"""Tagged packet recordings as Spark data sources (batch and growing) and a sink.

A record is a packed little-endian header (magic, type, endpoint, packet index, submission
sequence, status, requested and actual length) and, for data and session records, a payload.
A file is cut into splits; each finds its first record as the first offset from which DEPTH
headers chain, so splits need nothing from each other. Bytes that are no record come out
as rows of rec_type -1 (their offset and number), in FAILFAST mode as an error.
"""

from __future__ import annotations

import itertools
import os
import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: Fixed values of the format.
HEADER, HEADER_BYTES = "<IBBHIIII", 24
MAGIC = 0x31504143
DATA, HOST_LOSS, TRANSFER_ERROR, SESSION, TICK = range(5)
VIDEO, AUDIO = 0x83, 0x84
MOST_PACKET, MOST_SESSION, MOST_SKIP = 65536, 1 << 20, 256 << 20
CORRUPT = -1

DEPTH = 16
SPLIT_BYTES = 128 << 20
READ_BYTES = 4 << 20
#: What is read to follow headers alone.
HEAD_BYTES = 4096
BATCH_BYTES = 8 << 20

SCHEMA = (
    "capture_id string, file_off long, rec_type byte, endpoint short, pkt_index int, submit_seq long, "
    "status long, req_len long, actual_len long, payload binary"
)
_ARROW = pa.schema([
    ("capture_id", pa.string()), ("file_off", pa.int64()), ("rec_type", pa.int8()), ("endpoint", pa.int16()), ("pkt_index", pa.int32()),
    ("submit_seq", pa.int64()), ("status", pa.int64()), ("req_len", pa.int64()), ("actual_len", pa.int64()), ("payload", pa.binary()),
])


def plausible(header: tuple) -> bool:
    """Whether a capture could have written this header."""
    magic, kind, endpoint, _, _, _, requested, actual = header
    if magic != MAGIC or kind > TICK:
        return False
    if kind == DATA:
        return endpoint in (VIDEO, AUDIO) and actual <= requested <= MOST_PACKET
    return kind != SESSION or actual <= MOST_SESSION


def payload_bytes(header: tuple) -> int:
    return header[7] if header[1] in (DATA, SESSION) else 0


class Bytes:
    """Random access to a file in any store that pyarrow's file systems reach, with a window of bytes kept."""

    def __init__(self, path: str, window: int | None = None):
        from pyarrow import fs

        system, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        self.size = system.get_file_info(name).size
        self.file = system.open_input_file(name)
        self.at, self.held, self.window = 0, b"", window or READ_BYTES

    def get(self, at: int, n: int) -> bytes:
        """n bytes from `at`; fewer at the end."""
        if not (self.at <= at and at + n <= self.at + len(self.held)):
            self.file.seek(at)
            self.at, self.held = at, self.file.read(max(n, self.window))
        return self.held[at - self.at : at - self.at + n]

    def find(self, pattern: bytes, at: int, most: int) -> int:
        """Offset of the pattern at or after `at`, within `most` bytes; -1 if it isn't there."""
        end = min(self.size, at + most + len(pattern))
        while at < end:
            piece = self.get(at, min(READ_BYTES, end - at))
            hit = piece.find(pattern)
            if hit >= 0:
                return at + hit
            if len(piece) < len(pattern):
                return -1
            at += len(piece) - len(pattern) + 1
        return -1


def find_boundary(data: Bytes, at: int, depth: int = DEPTH, most: int = MOST_SKIP) -> int:
    """First offset at or after `at` from which `depth` headers chain, or all up to the end; -1 within `most` bytes if none."""
    stop = at + most
    while True:
        at = data.find(MAGIC.to_bytes(4, "little"), at, stop - at)
        if at < 0:
            return -1
        place = at
        for _ in range(depth):
            raw = data.get(place, HEADER_BYTES)
            if len(raw) < HEADER_BYTES:
                if place == data.size:
                    return at
                break
            header = struct.unpack(HEADER, raw)
            if not plausible(header):
                break
            place += HEADER_BYTES + payload_bytes(header)
            if place > data.size:
                break
        else:
            return at
        at += 1


def read_records(path: str, start: int, end: int, with_payload: bool, strict: bool, first: bool, stop: bool = False) -> Iterator[tuple]:
    """Records that begin in [start, end), as rows without the capture's name. `first`: the split begins at a record, not in the midst. `stop`: nothing is read behind the first bad byte."""
    data = Bytes(path)
    at = start
    if not first:
        at = find_boundary(data, start)
        if at < 0:
            return
    while at < min(end, data.size):
        raw = data.get(at, HEADER_BYTES)
        header = struct.unpack(HEADER, raw) if len(raw) == HEADER_BYTES else None
        size = payload_bytes(header) if header else 0
        if header is None or not plausible(header) or at + HEADER_BYTES + size > data.size:
            if strict:
                raise ValueError(f"{path}: no whole record at byte {at}")
            if stop:
                yield at, CORRUPT, None, None, None, None, None, data.size - at, None
                return
            to = find_boundary(data, at + 1)
            to = to if to >= 0 else data.size
            yield at, CORRUPT, None, None, None, None, None, to - at, None
            at = to
            continue
        payload = data.get(at + HEADER_BYTES, size) if size and with_payload else None
        yield at, *header[1:], payload
        at += HEADER_BYTES + size


class Split(InputPartition):
    def __init__(self, path: str, start: int, end: int, first: bool):
        self.path, self.start, self.end, self.first = path, start, end, first


def _files(path: str) -> list[str]:
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    info = system.get_file_info(name)
    if info.type == fs.FileType.Directory:
        prefix = path[: len(path) - len(name)] if "://" in path else ""
        return sorted(prefix + f.path for f in system.get_file_info(fs.FileSelector(name)) if f.is_file and not os.path.basename(f.path).startswith(("_", ".")))
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    return [path]


class RecordingReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.strict = options.get("mode", "PERMISSIVE").upper() == "FAILFAST"
        self.drop = options.get("mode", "PERMISSIVE").upper() == "DROPMALFORMED"
        # STOP reads up to the first bad byte, in one piece, as what lies behind it depends on all before.
        self.stop = options.get("mode", "PERMISSIVE").upper() == "STOP"
        self.with_payload = options.get("payload", "true").lower() == "true"
        self.split = int(options.get("splitBytes", SPLIT_BYTES))
        self.offset = int(options.get("startingOffset", 0))

    def partitions(self):
        out = []
        for f in _files(self.path):
            size = Bytes(f).size
            step = max(size, 1) if self.stop else self.split
            begin = self._aligned(f, size) if self.offset else 0
            starts = range(begin, max(size, begin + 1), step)
            out += [Split(f, s, min(size, s + step), s == begin) for s in starts]
        return out

    def _aligned(self, path: str, size: int) -> int:
        """Where reading begins for a starting offset: at the first video record with packet 0 from the first boundary on (the file's end if there is none)."""
        at = find_boundary(Bytes(path), min(self.offset, size))
        for r in read_records(path, at, size, False, False, True) if at >= 0 else ():
            if r[1] == DATA and r[2] == VIDEO and r[3] == 0:
                return r[0]
        return size

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        found = read_records(split.path, split.start, split.end, self.with_payload, self.strict, split.first, self.stop)
        if split.first and split.start and split.start < split.end:
            # Bytes that the alignment has passed over.
            found = itertools.chain([(0, CORRUPT, None, None, None, None, None, split.start, None)], found)
        return _batches(os.path.basename(split.path), (r for r in found if not (self.drop and r[1] == CORRUPT)))


def _batches(name: str, records: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    for r in records:
        rows.append((name, *r))
        size += len(r[-1] or b"") + 64
        if size >= BATCH_BYTES:
            yield _batch(rows)
            rows, size = [], 0
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


class GrowingReader(DataSourceStreamReader):
    """A recording that is still written: the offset is the byte after the last whole record.

    The driver follows headers alone, up to maxRecordsPerTrigger of them; payload is read by the tasks, in splits.
    """

    MOST = 4096

    def __init__(self, options):
        self.path = options["path"]
        self.most = int(options.get("maxRecordsPerTrigger", self.MOST))
        self.split = int(options.get("splitBytes", SPLIT_BYTES))
        self.with_payload = options.get("payload", "true").lower() == "true"
        self.known: int | None = None  # as far as records are known to be whole; unknown after a restart

    def initialOffset(self) -> dict:
        self.known = 0
        return {"at": 0}

    def latestOffset(self) -> dict:
        data, at, n = Bytes(self.path, HEAD_BYTES), self.known or 0, 0
        # After a restart all that is there by now is one batch: where the last one ended isn't told.
        while self.known is None or n < self.most:
            raw = data.get(at, HEADER_BYTES)
            if len(raw) < HEADER_BYTES:
                break
            header = struct.unpack(HEADER, raw)
            after = at + HEADER_BYTES + payload_bytes(header) if plausible(header) else find_boundary(data, at + 1)
            if not at < after <= data.size:
                break  # the rest may yet become a record
            at, n = after, n + 1
        self.known = at
        return {"at": at}

    def partitions(self, start: dict, end: dict) -> list[Split]:
        self.known = max(self.known or 0, end["at"])
        return [Split(self.path, a, min(end["at"], a + self.split), a == start["at"]) for a in range(start["at"], end["at"], self.split)]

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        return _batches(os.path.basename(split.path), read_records(split.path, split.start, split.end, self.with_payload, False, split.first))

    def commit(self, end: dict) -> None:
        """Nothing is held for a batch."""


class Written(WriterCommitMessage):
    """A task's part under its temporary name, and the name it is to have."""

    def __init__(self, staged: str, name: str):
        self.staged, self.name = staged, name


class PartWriter(DataSourceWriter):
    """Writes each partition's rows, in their order, as one file; parts sort by number.

    Tasks write under names of their own attempt, so a retry or a twin never touches another's file. Parts get their
    names when all are whole; if the job fails, what was written goes.
    """

    suffix = ".tpc"

    def __init__(self, options):
        self.path = options["path"]

    def _system(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)

    def bytes_of(self, row) -> bytes:
        if row.rec_type == CORRUPT:
            return b""
        head = struct.pack(HEADER, MAGIC, row.rec_type, row.endpoint or 0, row.pkt_index or 0, row.submit_seq or 0, row.status or 0, row.req_len or 0, row.actual_len or 0)
        return head + (bytes(row.payload) if row.rec_type in (DATA, SESSION) and row.payload else b"")

    def write(self, rows) -> WriterCommitMessage:
        from pyspark import TaskContext

        system, name = self._system()
        task = TaskContext.get()
        final = f"part-{task.partitionId():05d}{self.suffix}"
        staged = f"_attempt-{task.taskAttemptId()}-{final}"
        system.create_dir(name)
        with system.open_output_stream(f"{name}/{staged}") as out:
            for r in rows:
                out.write(self.bytes_of(r))
        return Written(staged, final)

    def commit(self, messages) -> None:
        system, name = self._system()
        for m in messages:
            if m is not None:
                system.move(f"{name}/{m.staged}", f"{name}/{m.name}")

    def abort(self, messages) -> None:
        system, name = self._system()
        for m in messages:
            if m is not None:
                system.delete_file(f"{name}/{m.staged}")


class RecordingWriter(PartWriter):
    """Records with their headers."""


class PayloadWriter(PartWriter):
    """Payloads alone, one after the other: pictures or samples as plain bytes."""

    suffix = ".raw"

    def bytes_of(self, row) -> bytes:
        return bytes(row.payload) if row.payload else b""


class Payload(DataSource):
    """format("payload"), to write only: the column payload of each row, in order. Option path."""

    @classmethod
    def name(cls) -> str:
        return "payload"

    def schema(self) -> str:
        return "payload binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return PayloadWriter(self.options)


class Recording(DataSource):
    """format("tpc"): options path, mode, payload, splitBytes, startingOffset, maxRecordsPerTrigger."""

    @classmethod
    def name(cls) -> str:
        return "tpc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return RecordingReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return GrowingReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return RecordingWriter(self.options)


def register(spark) -> None:
    """Make format("tpc") known to the session; the module goes to the workers by value."""
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(Recording)
    spark.dataSource.register(Payload)
