"""Tracking meter: fine-grain noise of both fields of placed pictures, and whether a reading can be trusted."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Block of the residual, margins, luma gate, share of flattest blocks, thresholds of the verdicts.
LINES, PIXELS, EDGE_X, EDGE_LINES = 8, 16, 32, 8
LUMA, SHARE, LEAST_BLOCKS = (40, 210), 0.10, 40
DETAIL, DETAIL_SHARE, SAME_LINES, MOST_NOISE, LEAST_PERSIST = 4.0, 0.02, 0.3, 6.0, 0.56
PEAK = {"y": 219.0, "cb": 224.0, "cr": 224.0}


def plane_residuals(blocks: np.ndarray) -> np.ndarray:
    """Standard deviation about the least-squares plane of each block (blocks x lines x pixels)."""
    lines, pixels = blocks.shape[1:]
    v = blocks.astype(float)
    x, y = np.arange(pixels) - (pixels - 1) / 2, np.arange(lines) - (lines - 1) / 2
    n = lines * pixels
    total = (v * v).sum((1, 2)) - v.sum((1, 2)) ** 2 / n
    slopes = (v * x).sum((1, 2)) ** 2 / ((x * x).sum() * lines) + (v * y[:, None]).sum((1, 2)) ** 2 / ((y * y).sum() * pixels)
    return np.sqrt(np.maximum(total - slopes, 0) / (n - 3))


def low_bias(freedom: int) -> float:
    """What the flattest tenth of such deviations is of the true one."""
    return 1 - 1.2816 / math.sqrt(2 * freedom)


def _blocks(plane: np.ndarray, pixels: int) -> np.ndarray:
    lines = plane.shape[0] // LINES
    across = plane.shape[1] // pixels
    return plane[: lines * LINES, : across * pixels].reshape(lines, LINES, across, pixels).swapaxes(1, 2).reshape(-1, LINES, pixels)


def reading(picture: np.ndarray, before: np.ndarray | None = None) -> dict:
    """Noise of both fields by channel, and the verdict; picture: 480 rows x 1440 bytes (chroma and luma in turn)."""
    out: dict = {"noise": [], "blocks": []}
    enough = detailed = True
    for f in (0, 1):
        field = picture[f::2][EDGE_LINES : 240 - EDGE_LINES]
        inside = field[:, 2 * EDGE_X : 2 * (720 - EDGE_X)]
        luma = _blocks(inside[:, 1::2], PIXELS)
        mean = luma.astype(float).mean((1, 2))
        keep = (mean >= LUMA[0]) & (mean <= LUMA[1])
        out["blocks"].append(int(keep.sum()))
        if out["blocks"][-1] < LEAST_BLOCKS:
            enough = False
            out["noise"].append(None)
            continue
        noise = {}
        for name, plane, pixels in (("y", inside[:, 1::2], PIXELS), ("cb", inside[:, 0::4], PIXELS // 2), ("cr", inside[:, 2::4], PIXELS // 2)):
            sd = plane_residuals(_blocks(plane, pixels)[keep])
            noise[name] = float(np.sort(sd)[int(SHARE * len(sd))]) / low_bias(pixels * LINES - 3)
            if name == "y":
                detailed &= bool((sd > DETAIL * noise["y"]).sum() >= DETAIL_SHARE * len(sd))
        out["noise"].append(noise)
    rows = slice(EDGE_LINES, 240 - EDGE_LINES)
    same = (picture[0::2][rows, 2 * EDGE_X : 2 * (720 - EDGE_X)] == picture[1::2][rows, 2 * EDGE_X : 2 * (720 - EDGE_X)]).all(axis=1)
    twice = same.mean() >= SAME_LINES
    noisy = enough and max(n["y"] for n in out["noise"]) > MOST_NOISE
    out["persist"] = None
    if before is not None:
        out["persist"] = min(_correlation(picture[f::2][16:224, 65:1377:4], before[f::2][16:224, 65:1377:4]) for f in (0, 1))
        noisy = noisy and out["persist"] < LEAST_PERSIST
    out["verdict"] = "too_few_blocks" if not enough else "fields_identical" if twice else "snow" if noisy else "ok" if detailed else "no_detail"
    return out


def _correlation(a: np.ndarray, b: np.ndarray) -> float:
    a, b, n = a.astype(np.int64), b.astype(np.int64), a.size
    va, vb = int((a * a).sum()) - int(a.sum()) ** 2 / n, int((b * b).sum()) - int(b.sum()) ** 2 / n
    return (int((a * b).sum()) - int(a.sum()) * int(b.sum()) / n) / math.sqrt(va * vb) if va > 0 and vb > 0 else 0.0


def window_readings(readings: DataFrame, keys: list[str], order: str, first: str, second: str, channel: str = "y", rows: int = 15) -> DataFrame:
    """Medians of the last `rows` valid readings of both fields, their ratio and signal-to-noise ratios in dB."""
    from .sequence import rolling_median

    one = rolling_median(readings, keys, order, first, rows).withColumnRenamed("median", "noise1")
    two = rolling_median(one, keys, order, second, rows).withColumnRenamed("median", "noise2")
    db = lambda c: F.when(F.col(c) > 0, 20 * F.log10(F.lit(PEAK[channel]) / F.col(c))).otherwise(0.0)
    return two.withColumn("ratio", F.when(F.col("noise1") > 0, F.col("noise2") / F.col("noise1")).otherwise(0.0)).withColumn("snr1", db("noise1")).withColumn("snr2", db("noise2"))


def static_comb(picture: np.ndarray, before: np.ndarray, still: float = 4.0) -> dict:
    """Combing of two interlaced pictures where nothing moves: mean alternation between rows of low-passed luma, and the reweave shift (-3..3) with the least."""
    smooth = lambda p: np.apply_along_axis(lambda r: np.convolve(r, np.ones(8) / 8, "valid"), 1, p[:, 1::2].astype(float))
    now, was = smooth(picture), smooth(before)
    fixed = np.abs(now - was) <= still

    def alternation(p: np.ndarray, mask: np.ndarray) -> float:
        left = (p[:-2] - p[1:-1]) * (p[2:] - p[1:-1])
        ok = mask[:-2] & mask[1:-1] & mask[2:]
        return float(np.maximum(left, 0)[ok].mean()) if ok.any() else 0.0

    found = {}
    for s in range(-3, 4):
        woven, mask = now.copy(), fixed.copy()
        woven[1::2], mask[1::2] = np.roll(now[1::2], s, axis=0), np.roll(fixed[1::2], s, axis=0)
        if s:
            mask[1::2][: max(0, s)], mask[1::2][len(mask[1::2]) + min(0, s) :] = False, False
        found[s] = alternation(woven, mask)
    best = min(found, key=lambda s: (found[s], abs(s), s))
    return {"static_share": float(fixed.mean()), "energy": found[0], "best_shift": best, "best_energy": found[best]}
