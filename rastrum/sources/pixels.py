"""Published pictures: files of fixed-size frames, raw or zstd-compressed."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Fixed value: 480 rows of 720 pixels of two bytes.
FRAME_BYTES = 691_200
FRAMES_PER_SPLIT = 192
SCHEMA = "file string, frame long, pixels binary"


class Frames(InputPartition):
    def __init__(self, path: str, first: int, n: int, packed: bool):
        self.path, self.first, self.n, self.packed = path, first, n, packed


class PixelReader(DataSourceReader):
    """Raw files are split by frames; a compressed file is read by one task, a frame at a time."""

    def __init__(self, options):
        self.path, self.size = options["path"], int(options.get("frameBytes", FRAME_BYTES))

    def partitions(self):
        from rastrum.sources.recording import Bytes, _files

        out = []
        for f in _files(self.path):
            if f.endswith(".zst"):
                out.append(Frames(f, 0, -1, True))
                continue
            n, rest = divmod(Bytes(f).size, self.size)
            if rest:
                raise ValueError(f"{f}: {rest} bytes beyond the last whole frame")
            out += [Frames(f, a, min(FRAMES_PER_SPLIT, n - a), False) for a in range(0, n, FRAMES_PER_SPLIT)]
        return out

    def read(self, split: Frames) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, name = fs.FileSystem.from_uri(split.path) if "://" in split.path else (fs.LocalFileSystem(), split.path)
        with system.open_input_stream(name, compression="zstd") if split.packed else system.open_input_file(name) as f:
            if not split.packed:
                f.seek(split.first * self.size)
            frame = split.first
            while split.packed or frame < split.first + split.n:
                data = f.read(self.size)
                if not data:
                    return
                if len(data) < self.size:
                    raise ValueError(f"{split.path}: frame {frame} is cut short")
                yield pa.RecordBatch.from_arrays([pa.array([os.path.basename(split.path)]), pa.array([frame], pa.int64()), pa.array([data], pa.binary())], names=["file", "frame", "pixels"])
                frame += 1


class Pixels(DataSource):
    """format("pixels"): options path, frameBytes."""

    @classmethod
    def name(cls) -> str:
        return "pixels"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PixelReader(self.options)


def register(spark) -> None:
    spark.dataSource.register(Pixels)
