"""Table forms of what looks at pictures: each unit's raster goes through a kernel, the unit before it along, and narrow rows come out.

Units are dealt to blocks of consecutive counters, each block with the unit before its first, so a kernel that compares
neighbours never needs the rest of the recording, and a task holds some dozen rasters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import census, meter, raster

HEADER, ROWS, WIDTH = raster.HEADER, raster.ROWS, raster.WIDTH
UNIT = HEADER + ROWS * WIDTH * 2


def by_unit(units: DataFrame, keys: list[str], counter: str, unit: str, fn: Callable[[dict, bytes, tuple[dict, bytes] | None], Iterator[dict]], ddl: str, whole: bool = True, per_block: int = raster.UNITS_PER_BLOCK) -> DataFrame:
    """keys, counter and what fn(row, bytes, the same of the unit one counter before) yields; only whole rasters, unless `whole` is false."""
    rows = units.where(F.length(unit) == UNIT) if whole else units
    names = [*keys, counter]
    fields = [units.schema[n] for n in names]
    out = pa.schema([*to_arrow_schema(StructType(fields)), *to_arrow_schema(StructType.fromDDL(ddl))])

    def run(key: tuple, t: pa.Table) -> pa.Table:
        t, found, was = t.sort_by(counter), [], None
        others = [c for c in t.column_names if c != unit]
        for i in range(t.num_rows):
            row, data = {c: t.column(c)[i].as_py() for c in others}, t.column(unit)[i].as_buffer()
            before = was if was is not None and row[counter] == was[0][counter] + 1 else None
            if not row["back"]:
                found += [{n: row[n] for n in names} | r for r in fn(row, data, before)]
            was = (row, data)
        return pa.Table.from_pylist(found, schema=out)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", " + ddl
    # Columns such as a frame's placement go along.
    more = [c for c in units.columns if c not in (*keys, counter, unit)]
    return raster.in_blocks(rows, [*keys, *more], counter, unit, per_block).groupBy(*keys, "block").applyInArrow(run, schema)


def captions(units: DataFrame, keys: list[str], counter: str = "counter_extended", unit: str = "unit", rows: tuple[tuple[int, int], ...] = ((10, 30), (273, 293))) -> DataFrame:
    """Caption bytes found on the top rows of both fields: keys, counter, field, row, byte1, byte2, amplitude."""

    def found(row, data, before):
        luma = raster.planes(data)[0]
        for field, (first, last) in enumerate(rows, 1):
            for c in raster.caption_rows(luma, first, last):
                yield {"field": field, **c}

    return by_unit(units, keys, counter, unit, found, "field int, row int, byte1 int, byte2 int, amplitude double")


def envelopes(units: DataFrame, keys: list[str], counter: str = "counter_extended", unit: str = "unit") -> DataFrame:
    """First and last picture line of both fields and their first caption-like line: keys, counter, field, top, bottom, caption."""
    found = lambda row, data, before: ({"field": f + 1} | census.envelope(data, f) for f in (0, 1))
    return by_unit(units, keys, counter, unit, found, "field int, top int, bottom int, caption int")


def row_boundaries(units: DataFrame, keys: list[str], counter: str = "counter_extended", unit: str = "unit", every: int = 8) -> DataFrame:
    """Where every eighth picture row rises from blanking, from either side: keys, counter, row, side, status, position, uncertainty."""

    def found(row, data, before):
        luma = raster.planes(data)[0]
        for f, rows in enumerate(raster.PICTURE):
            level = census.blanking_level(data, f)
            for r in range(rows.start, rows.stop, every):
                for side, right in (("left", False), ("right", True)):
                    b = census.boundary(luma[r], level, right)
                    yield {"row": r, "side": side, "status": b["status"], "position": b["position"], "uncertainty": b["uncertainty"]}

    return by_unit(units, keys, counter, unit, found, "row int, side string, status string, position double, uncertainty double")


def two_band_rows(units: DataFrame, keys: list[str], rows: list[int], counter: str = "counter_extended", unit: str = "unit", epsilon: float = 12.0) -> DataFrame:
    """Whether rows of a raster only swing between two bands: keys, counter, row, swings, why."""

    def found(row, data, before):
        luma = raster.planes(data)[0]
        for r in rows:
            swings, why = census.two_bands(luma[r], epsilon)
            yield {"row": r, "swings": swings, "why": why}

    return by_unit(units, keys, counter, unit, found, "row int, swings boolean, why string")


def _placed(row: dict, data: bytes) -> np.ndarray:
    return raster.weave(data, row.get("d1") or 0, row.get("d2") or 0)[0]


def woven_rows(frames: DataFrame, keys: list[str], counter: str = "counter_extended", unit: str = "unit") -> DataFrame:
    """Published pictures by row: keys, counter, row, luma (sum), chroma (sum). frames: units with d1 and d2 (0 without)."""

    def found(row, data, before):
        picture = _placed(row, data).astype(np.int64)
        for j, (luma, chroma) in enumerate(zip(picture[:, 1::2].sum(axis=1).tolist(), picture[:, 0::2].sum(axis=1).tolist(), strict=True)):
            yield {"row": j, "luma": luma, "chroma": chroma}

    return by_unit(frames, keys, counter, unit, found, "row int, luma long, chroma long")


def meter_readings(frames: DataFrame, keys: list[str], counter: str = "counter_extended", unit: str = "unit") -> DataFrame:
    """The tracking meter's reading of each published picture: keys, counter, verdict, noise1, noise2 (luma, of both fields), blocks1, blocks2, persist."""

    def found(row, data, before):
        r = meter.reading(_placed(row, data), _placed(*before) if before else None)
        noise = [n["y"] if n else None for n in r["noise"]]
        yield {"verdict": r["verdict"], "noise1": noise[0], "noise2": noise[1], "blocks1": r["blocks"][0], "blocks2": r["blocks"][1], "persist": r["persist"]}

    return by_unit(frames, keys, counter, unit, found, "verdict string, noise1 double, noise2 double, blocks1 int, blocks2 int, persist double")


def static_combs(frames: DataFrame, keys: list[str], counter: str = "counter_extended", unit: str = "unit") -> DataFrame:
    """Combing of the still parts of each picture: keys, counter, static_share, best_shift, ratio (of the best shift's energy to that without a shift)."""

    def found(row, data, before):
        if before:
            c = meter.static_comb(_placed(row, data), _placed(*before))
            yield {"static_share": c["static_share"], "best_shift": c["best_shift"], "ratio": c["best_energy"] / c["energy"] if c["energy"] > 0 else 1.0}

    return by_unit(frames, keys, counter, unit, found, "static_share double, best_shift int, ratio double")


def stability(frames: DataFrame, keys: list[str], counter: str = "counter_extended", unit: str = "unit", top: int = 12) -> DataFrame:
    """Data lines at the top of published pictures, and how far the body moved from the one before: keys, counter, data_rows (`row:kind`), shift, correlation."""

    def found(row, data, before):
        luma = _placed(row, data)[:, 1::2]
        kinds = ("caption", "timing", "bar")
        lines = census.line_kinds(luma[:top], *kinds)
        moved = census.vertical_shift(_placed(*before)[:, 1::2], luma) if before else (None, None)
        yield {"data_rows": " ".join(f"{r}:{kinds[k]}" for r, k in enumerate(lines.tolist()) if k >= 0), "shift": moved[0], "correlation": moved[1]}

    return by_unit(frames, keys, counter, unit, found, "data_rows string, shift int, correlation double")


def partial_pictures(units: DataFrame, keys: list[str], counter: str = "counter_extended", unit: str = "unit") -> DataFrame:
    """Pictures made of units cut short: keys, counter, picture_bytes (before the cut), picture (480 rows; what it lacks is the unit's before, or black)."""

    def found(row, data, before):
        data = bytes(data)
        n = census.picture_bytes(data[HEADER:])
        rows = np.frombuffer(data, np.uint8, n // (2 * WIDTH) * 2 * WIDTH, HEADER).reshape(-1, 2 * WIDTH)
        old = raster.weave(bytes(before[1]), 0, 0)[0] if before and len(before[1]) == UNIT else None
        yield {"picture_bytes": HEADER + n, "picture": raster.partial_picture(rows, old, row.get("d1") or 0, row.get("d2") or 0).tobytes()}

    return by_unit(units, keys, counter, unit, found, "picture_bytes int, picture binary", whole=False)


def filtered(frames: DataFrame, command: list[str], column: str = "payload") -> DataFrame:
    """Frames through an outside program that reads frames on its input and writes as many of the same size on its output; other columns as they are.

    The program runs once a batch of rows, so nothing is lost with an executor but its batch.
    """
    import subprocess

    schema = to_arrow_schema(frames.schema)
    at = frames.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                part = batch.slice(a, 64)
                data = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in part.column(at)]
                done = subprocess.run(command, input=b"".join(data), stdout=subprocess.PIPE, check=True).stdout
                if len(done) != sum(map(len, data)):
                    raise ValueError(f"{command[0]} gave {len(done)} bytes for {sum(map(len, data))}")
                ends = np.cumsum([len(x) for x in data]).tolist()
                pieces = [done[s:e] for s, e in zip([0, *ends[:-1]], ends, strict=True)]
                columns = [pa.array(pieces, schema.field(at).type) if i == at else part.column(i) for i in range(part.num_columns)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return frames.mapInArrow(run, frames.schema)
