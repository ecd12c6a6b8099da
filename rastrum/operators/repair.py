"""Unit repair: a unit that one stall or one held sample of the device made too long or too short, put back on its grid.

What the stall wrote (zeros, repeated words) says where the error is; padding after it, which begins on row
boundaries of its own, says how far the rest is displaced. Lost rows are rebuilt from the lines beside them, the
other field's, or the unit before. A unit too long without a stall may hold one sample for as long as its length is wrong. A run of two units whose
middle marker a stall has overwritten is taken apart there, and each is repaired by itself. Anything that doesn't fit this model is declined with the reason.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .raster import HEADER, PADDING, ROWS, spans, stall

#: Bytes of a whole unit and of a row, how far from whole a unit may be, how far padding may lie off the length error, rows that may be rebuilt.
UNIT, ROW = 756_048, 1440
MOST_DELTA, GRID_SLACK, MOST_ROWS = 64 * ROW, 16, 200
#: Fixed value: least zeros that are a stall's.
JUNK = 16
MARKER = b"\x00\x00\xff\xff"
OWN_PADDING = {261: 270, 523: 525}
FIELD2 = 262


def displacement(found: list[tuple[str, int, int]], lost: tuple[int, int], n: int) -> int | None:
    """How far what follows the stall lies from its place in a whole unit; None where padding doesn't say, or disagrees."""
    delta = n - UNIT
    if lost[1] == n:
        return delta
    fits: set[int] | None = None
    for kind, s, e in found:
        if kind != "padding" or s < lost[1]:
            continue
        whole = (e - s) // ROW
        mine = set()
        for d in range(delta - GRID_SLACK, delta + GRID_SLACK + 1, 1):
            if d % 4 or not whole and e != n:
                continue
            # The true start may lie a little later: picture that looks like padding joins it.
            for start in range(s, s + (e - s) % ROW + 1 if e != n else s + 1):
                row, rest = divmod(start - d - HEADER, ROW)
                if not rest and row in OWN_PADDING and (e == n or whole == OWN_PADDING[row] - row):
                    mine.add(d)
        if not mine:
            return None
        fits = mine if fits is None else fits & mine
    if not fits:
        return None
    return min(fits, key=lambda d: (abs(d - delta), d))


def between_grids(found: list[tuple[str, int, int]], delta: int, n: int) -> tuple[int, int]:
    """Where a length error must lie: behind the last padding that is in place, before the first that is displaced by it."""
    at = lambda s, d: divmod(s - d - HEADER, ROW)
    paddings = [(s, e) for kind, s, e in found if kind == "padding"]
    low = max([HEADER, *(e for s, e in paddings if at(s, 0)[1] == 0 and at(s, 0)[0] in (0, *OWN_PADDING))])
    high = min([n, *(s for s, _ in paddings if s >= low and at(s, delta)[1] == 0 and at(s, delta)[0] in OWN_PADDING)])
    return low, high


#: Fixed value: least bytes of a held sample that picture doesn't hold by chance.
HELD_LEAST = 64


def held_insert(unit: bytes, low: int, high: int, need: int) -> tuple[int, int] | None:
    """The only stretch in [low, high) where each of the four bytes of a pixel pair stays within one code for `need` bytes or more: where it begins and `need` bytes on."""
    width = need // 4 + (need % 4 > 0)
    if need < HELD_LEAST or high - low < need:
        return None
    a = np.frombuffer(unit, np.uint8)[low:high].astype(np.int16)
    # Greatest and least value of every fourth byte over `width` of them, from each byte on: by doubling.
    top = least = a
    span = 1
    while span < width:
        step = min(span, width - span) * 4
        top, least = np.maximum(top[:-step], top[step:]), np.minimum(least[:-step], least[step:])
        span += step // 4
    # The four bytes of a pair hold together.
    calm = (top - least) <= 1
    begins = np.flatnonzero(calm[:-3] & calm[1:-2] & calm[2:-1] & calm[3:]) if len(calm) > 3 else np.zeros(0, np.int64)
    # Stretches that don't overlap would leave it open which one is the insert.
    if not len(begins) or begins[-1] - begins[0] >= need:
        return None
    return low + int(begins[0]), low + int(begins[0]) + need


def repair_pair(run: bytes, before: bytes | None = None) -> list[tuple[str, bytes | None, dict]]:
    """Both units of a run of two whose middle marker a stall overwrote: status, whole unit and what was lost, of each.

    That stall leaves at most a unit behind it and at most a unit and the slack before it. If several fit, only what lies before the
    first is surely the first unit's, and the second is declined.
    """
    n = len(run)
    info = {"delta": n - 2 * UNIT, "grid_offset": 0, "lost_bytes": 0, "rebuilt_rows": 0}
    declined = lambda why: (why, None, info)
    if run[:4] != MARKER or run[6:8] != b"\x01\xe8" or n < 2 * HEADER:
        return [declined("not_a_unit")] * 2
    if abs(info["delta"]) > MOST_DELTA:
        return [declined("delta_range")] * 2
    junk = [(s, e) for kind, s, e in spans(run) if kind == "junk"]
    fits = [(s, e) for s, e in junk if s <= UNIT + MOST_DELTA and n - e + HEADER + JUNK <= UNIT]
    if not fits:
        return [declined("no_fill")] * 2
    # A unit whose rest a stall took: its bytes, and zeros up to the length it would have had.
    cut = lambda data: data + bytes(max(UNIT, len(data)) + JUNK - len(data))
    if len(fits) > 1:
        start = junk[0][0]
        return [repair(cut(run[:start]), before) if start <= UNIT else declined("second_event"), declined("second_event")]
    (start, end), = fits
    first = repair(cut(run[:start]), before)
    counter = (int.from_bytes(run[4:6], "little") + 1) % 65536
    head = MARKER + counter.to_bytes(2, "little") + run[6:HEADER]
    second = repair(head + bytes(UNIT + JUNK - HEADER - (n - end)) + run[end:], first[1])
    return [first, second]


def repair(unit: bytes, before: bytes | None = None) -> tuple[str, bytes | None, dict]:
    """Status, the whole unit (None if declined), and what was lost and rebuilt."""
    n = len(unit)
    info = {"delta": n - UNIT, "grid_offset": 0, "lost_bytes": 0, "rebuilt_rows": 0}
    if unit[:4] != MARKER or unit[6:8] != b"\x01\xe8" or n == UNIT:
        return "not_a_unit", None, info
    if not -MOST_DELTA <= info["delta"] <= MOST_DELTA:
        return "delta_range", None, info
    found = spans(unit)
    lost = stall(found)
    if lost is None:
        held = held_insert(unit, *between_grids(found, info["delta"], n), info["delta"])
        return ("no_fill", None, info) if held is None else ("ok", unit[: held[0]] + unit[held[1] :], info)
    at = unit.find(MARKER, 4)
    while 0 <= at:
        if not lost[0] - 3 <= at < lost[1]:
            return "marker", None, info
        at = unit.find(MARKER, at + 1)
    if any(k == "padding" and e <= lost[0] and (s - HEADER) % ROW and (e - HEADER) % ROW for k, s, e in found):
        return "grid", None, info
    moved = displacement(found, lost, n)
    if moved is None:
        return "grid", None, info
    start, resume = lost[0], lost[1] - moved
    if resume < start or start > UNIT or resume > UNIT:
        return "grid", None, info
    info |= {"grid_offset": 0 if lost[1] == n else moved - info["delta"], "lost_bytes": resume - start}
    out = np.zeros(UNIT, np.uint8)
    have = np.zeros(UNIT, bool)
    a = np.frombuffer(unit, np.uint8)
    out[:start], have[:start] = a[:start], True
    tail = min(n - lost[1], UNIT - resume)
    out[resume : resume + tail], have[resume : resume + tail] = a[lost[1] : lost[1] + tail], True
    rows, known = out[HEADER:].reshape(ROWS, ROW), have[HEADER:].reshape(ROWS, ROW)
    rows[PADDING] = np.tile(np.array([128, 16], np.uint8), ROW // 2)
    known[PADDING] = True
    whole = known.all(axis=1)
    broken = np.flatnonzero(~whole)
    if len(broken) > MOST_ROWS:
        return "too_much_lost", None, info
    padding = np.zeros(ROWS, bool)
    padding[PADDING] = True
    fit = whole & ~padding
    old = np.frombuffer(before, np.uint8, ROWS * ROW, HEADER).reshape(ROWS, ROW) if before is not None and len(before) == UNIT else None
    for k in broken.tolist():
        line = _rebuilt(rows, fit, k, old)
        if line is None:
            return "no_source", None, info
        # Whole pairs of pixels are replaced.
        gap = np.repeat((~known[k]).reshape(-1, 4).any(axis=1), 4)
        rows[k][gap] = line[gap]
    info["rebuilt_rows"] = len(broken)
    return "ok", out.tobytes(), info


def _rebuilt(rows: np.ndarray, fit: np.ndarray, k: int, old: np.ndarray | None) -> np.ndarray | None:
    """A lost row from intact ones: close by in its field, the other field's beside it, the unit before, the nearest of its field."""
    low, high = (0, FIELD2) if k < FIELD2 else (FIELD2, ROWS)
    above = next((i for i in range(k - 1, low - 1, -1) if fit[i]), None)
    below = next((i for i in range(k + 1, high) if fit[i]), None)
    blend = lambda a, b, wa, wb: ((rows[a].astype(np.int32) * wa + rows[b].astype(np.int32) * wb + (wa + wb) // 2) // (wa + wb)).astype(np.uint8)
    if above is not None and below is not None and below - above <= 3:
        return blend(above, below, below - k, k - above)
    near = [o for o in ((k + 262, k + 263) if k < FIELD2 else (k - 263, k - 262)) if 0 <= o < ROWS and (o >= FIELD2) == (k < FIELD2) and fit[o]]
    if near:
        return blend(near[0], near[-1], 1, 1)
    if old is not None:
        return old[k]
    if above is not None and below is not None:
        return blend(above, below, below - k, k - above)
    one = above if above is not None else below
    return None if one is None else rows[one]


REPAIR = "status string, unit binary, delta long, grid_offset long, lost_bytes long, rebuilt_rows long"


def repaired(units: DataFrame, keys: list[str], counter: str = "counter_extended", unit: str = "unit", per_block: int = 48) -> DataFrame:
    """keys, counter and the repair of each unit that isn't whole; the unit one counter before is its last resort.

    Decisions elsewhere never read the result: it is for output only.
    """
    from .raster import in_blocks

    names = [*keys, counter]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out, before, at = [], None, None
        for r in pdf.sort_values(counter).to_dict("records"):
            data = bytes(r[unit])
            if len(data) != UNIT and not r["back"]:
                old = before if at is not None and r[counter] == at + 1 else None
                # A run of two is two rows, the second one counter on.
                for k, (status, fixed, info) in enumerate(repair_pair(data, old) if len(data) > UNIT + MOST_DELTA else [repair(data, old)]):
                    out.append({n: r[n] for n in names} | {counter: r[counter] + k, "status": status, "unit": fixed} | info)
            before, at = data, r[counter]
        return pd.DataFrame(out, columns=[*names, *(c.split(" ")[0] for c in REPAIR.split(", "))])

    ddl = ", ".join(f"`{n}` {units.schema[n].dataType.simpleString()}" for n in names) + ", " + REPAIR
    blocks = in_blocks(units.where(F.col(unit).isNotNull()), keys, counter, unit, per_block)
    return blocks.groupBy(*keys, "block").applyInPandas(run, ddl)
