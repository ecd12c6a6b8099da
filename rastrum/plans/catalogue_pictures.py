"""Raster kernels as queries: rasters made from a formula over a table's keys, measured in tables, beside SQL that does so pixel by pixel."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import pictures, placement, raster, stats
from .catalogue import query, table


def made(key: str):
    """A raster for each key: a pattern that drifts with the key, padding rows as the device writes them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, x = np.arange(525)[:, None], np.arange(720)[None, :]
        for batch in batches:
            for u in batch.column(0).to_pylist():
                px = np.empty((525, 720, 2), np.uint8)
                px[:, :, 1] = (r * 7 + x * 3 + u * u * 5 + (r * x * (u + 1)) % 31) % 220 + 10
                px[:, :, 0] = 124 + (r + x + u) % 9
                px[raster.PADDING] = (128, 16)
                yield pa.RecordBatch.from_arrays([pa.array(["made"]), pa.array([u], pa.int64()), pa.array([b"\x00\x00\xff\xff" + bytes(44) + px.tobytes()], pa.binary())], names=["capture_id", "counter_extended", "unit"])

    return run


def units(spark, sf_dir: str, name: str, key: str) -> DataFrame:
    return table(spark, sf_dir, name).select(F.col(key).cast("long").alias(key)).mapInArrow(made(key), "capture_id string, counter_extended long, unit binary")


_LUMA = "CASE WHEN r < 7 OR (r >= 261 AND r < 270) OR r >= 523 THEN 16 ELSE (r * 7 + x * 3 + u * u * 5 + (r * x * (u + 1)) % 31) % 220 + 10 END"
_CHROMA = "CASE WHEN r < 7 OR (r >= 261 AND r < 270) OR r >= 523 THEN 128 ELSE 124 + (r + x + u) % 9 END"
_PIXELS = f"""
WITH p AS (SELECT u, r, x, {_LUMA} AS y, {_CHROMA} AS c FROM (SELECT CAST(n_nationkey AS BIGINT) AS u FROM nation), (SELECT unnest(range(0, 525)) AS r), (SELECT unnest(range(0, 720, 4)) AS x)),
q AS (SELECT *, CASE WHEN r < 257 THEN r - 20 ELSE r - 282 END AS k, r >= 282 AS f FROM p WHERE (r >= 20 AND r < 257) OR (r >= 282 AND r < 519)),
d AS (SELECT *, abs(y - lag(y) OVER (PARTITION BY u, f, r ORDER BY x)) AS dx, abs(y - lag(y) OVER (PARTITION BY u, f, x ORDER BY r)) AS dy, abs(y - lag(y) OVER (PARTITION BY r, x ORDER BY u)) AS dt, abs(c - 128) AS o FROM q),
"""


@query(_PIXELS + """
m AS (SELECT u, avg(y) AS mean FROM q GROUP BY u),
t AS (SELECT u, count(*) FILTER (WHERE hi - lo >= 12) / 450 AS extent FROM (SELECT u, f, k * 15 // 237 AS ty, x // 48 AS tx, max(y) AS hi, min(y) AS lo FROM q GROUP BY ALL) GROUP BY u),
v AS (SELECT u, sqrt(greatest(0, avg(y * y) - avg(y) * avg(y))) AS vbi_energy FROM p WHERE r IN (16, 17, 279, 280) GROUP BY u),
s AS (SELECT u, avg(y) AS luma_mean, CAST(list_sort(list(y))[count(*) // 2 + 1] AS DOUBLE) AS luma_median, sqrt(greatest(0, avg(y * y) - avg(y) * avg(y))) AS luma_sigma, avg(o) AS chroma_distance, CAST(list_sort(list(o))[count(*) // 2 + 1] AS DOUBLE) AS chroma_distance_median,
  avg(CASE WHEN o <= 4 THEN 1 ELSE 0 END) AS neutral_chroma_fraction, avg(CASE WHEN y < 16 THEN 1 ELSE 0 END) AS subblack_fraction, (coalesce(sum(dx), 0) + coalesce(sum(dy), 0)) / (count(dx) + count(dy)) AS gradient,
  CASE WHEN count(dt) > 0 THEN avg(dt) ELSE 0 END AS temporal_mad, avg(CASE WHEN abs(y - mean) <= 2 THEN 1 ELSE 0 END) AS flat_fraction FROM d JOIN m USING (u) GROUP BY u)
SELECT u AS counter_extended, round(luma_mean, 6) AS luma_mean, luma_median, round(luma_sigma, 6) AS luma_sigma, round(chroma_distance, 6) AS chroma_distance, chroma_distance_median, round(neutral_chroma_fraction, 6) AS neutral_chroma_fraction,
  round(subblack_fraction, 6) AS subblack_fraction, round(gradient, 6) AS gradient, round(extent, 6) AS extent, round(temporal_mad, 6) AS temporal_mad, round(flat_fraction, 6) AS flat_fraction, round(vbi_energy, 6) AS vbi_energy, CAST(1 AS DOUBLE) AS padding_fraction,
  CASE WHEN luma_sigma > 35 AND gradient > 30 AND extent > 0.5 THEN 'snow' WHEN extent < 0.12 THEN 'flat_ambiguous' ELSE 'program' END AS appearance FROM s JOIN t USING (u) JOIN v USING (u)""")
def raster_measurements(spark, sf_dir):
    got = raster.measurements(units(spark, sf_dir, "nation", "n_nationkey"), ["capture_id"])
    rounded = ("luma_mean", "luma_sigma", "chroma_distance", "neutral_chroma_fraction", "subblack_fraction", "gradient", "extent", "temporal_mad", "flat_fraction", "vbi_energy")
    return got.select("counter_extended", *[F.round(c, 6).alias(c) for c in rounded], "luma_median", "chroma_distance_median", "padding_fraction", "appearance")


@query(f"""
WITH k AS (SELECT CAST(r_regionkey AS BIGINT) AS u FROM region), x AS (SELECT unnest(range(24, 696)) AS x),
a AS (SELECT u, x, r, {_LUMA} AS y FROM k, x, (SELECT unnest(range(26, 238)) AS r)), b AS (SELECT u, x, r, {_LUMA} AS y FROM k, x, (SELECT unnest(range(284, 505)) AS r)),
w AS (SELECT a.u, a.x, a.r, a.y, lead(a.y) OVER (PARTITION BY a.u, a.x ORDER BY a.r) AS below FROM a),
e AS (SELECT w.u, d, sum(greatest((w.y - b.y) * (w.below - b.y), 0)) AS s FROM w JOIN (SELECT unnest(range(-5, 6)) AS d) ON TRUE JOIN b ON b.u = w.u AND b.x = w.x AND b.r = w.r + 263 + d WHERE w.below IS NOT NULL GROUP BY w.u, d),
f AS (SELECT u, d, CAST(CAST(s / (211 * 672) AS FLOAT) AS DOUBLE) AS energy FROM e), o AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY energy, d) AS n FROM f)
SELECT u AS counter_extended, CAST(max(CASE WHEN n = 1 THEN d END) AS INTEGER) AS comb_shift, round(max(CASE WHEN n = 2 THEN energy END) / max(CASE WHEN n = 1 THEN energy END), 6) AS comb_margin,
  max(CASE WHEN n = 2 THEN energy END) / max(CASE WHEN n = 1 THEN energy END) >= 1.5 AS comb_decided, round(max(CASE WHEN d = 0 THEN energy END), 3) AS energy FROM o GROUP BY u""")
def comb_energies(spark, sf_dir):
    got = raster.geometry(units(spark, sf_dir, "region", "r_regionkey"), ["capture_id"])
    return got.select("counter_extended", "comb_shift", F.round("comb_margin", 6).alias("comb_margin"), "comb_decided", F.round(F.element_at("comb_energies", 6), 3).alias("energy"))


@query(f"""
WITH k AS (SELECT CAST(n_nationkey AS BIGINT) AS u, n_nationkey % 7 - 3 AS d1, n_nationkey % 5 - 2 AS d2 FROM nation), j AS (SELECT unnest(range(0, 480)) AS j), x AS (SELECT unnest(range(0, 720)) AS x),
s AS (SELECT u, j, CASE WHEN j % 2 = 0 THEN 19 + d1 + j // 2 ELSE 282 + d2 + j // 2 END AS r FROM k, j),
t AS (SELECT u, j, r, x, (j % 2 = 0 AND r >= 0 AND r < 262) OR (j % 2 = 1 AND r >= 262 AND r < 525) AS here FROM s, x)
SELECT u AS counter_extended, CAST(j AS INTEGER) AS row, CAST(sum(CASE WHEN here THEN {_LUMA} ELSE 16 END) AS BIGINT) AS luma, CAST(sum(CASE WHEN here THEN {_CHROMA} ELSE 128 END) AS BIGINT) AS chroma FROM t GROUP BY u, j""")
def woven_rows(spark, sf_dir):
    """Pictures placed and woven, row by row."""
    k = F.col("counter_extended")
    frames = units(spark, sf_dir, "nation", "n_nationkey").withColumn("d1", (k % 7 - 3).cast("int")).withColumn("d2", (k % 5 - 2).cast("int"))
    return pictures.woven_rows(frames, ["capture_id"]).drop("capture_id")


@query(f"""
WITH k AS (SELECT CAST(n_nationkey AS BIGINT) AS u FROM nation),
p AS (SELECT u, r, CASE WHEN r >= 280 THEN 2 ELSE 1 END AS field, {_LUMA} AS y FROM k, (SELECT unnest(range(17, 523)) AS r), (SELECT unnest(range(40, 680)) AS x) WHERE r <= 260 OR r >= 280),
b AS (SELECT u, field, r, avg(CASE WHEN y <= 20 THEN 1 ELSE 0 END) >= 0.9 AS dark FROM p GROUP BY u, field, r)
SELECT u AS counter_extended, field, coalesce(min(CASE WHEN NOT dark THEN r END), -1) AS top, coalesce(max(CASE WHEN NOT dark THEN r END), -1) AS bottom, -1 AS caption FROM b GROUP BY u, field""")
def picture_envelopes(spark, sf_dir):
    return pictures.envelopes(units(spark, sf_dir, "nation", "n_nationkey"), ["capture_id"]).drop("capture_id")


@query()
def placed_frames(spark, sf_dir):
    """Placement decided for each frame; a machine over frames, tested on its own."""
    return placement.decide(raster.geometry(units(spark, sf_dir, "nation", "n_nationkey"), ["capture_id"]), ["capture_id"]).drop("capture_id")


@query()
def meter_readings(spark, sf_dir):
    """Noise of both fields of published pictures; kernels tested on their own."""
    return pictures.meter_readings(units(spark, sf_dir, "nation", "n_nationkey"), ["capture_id"]).drop("capture_id")


@query()
def static_comb_summary(spark, sf_dir):
    """Combing of what stands still, and how many frames it says are misregistered."""
    combs = pictures.static_combs(units(spark, sf_dir, "region", "r_regionkey"), ["capture_id"])
    return stats.misregistration(combs, ["capture_id"], "static_share", "best_shift", "ratio").drop("capture_id")


@query()
def picture_checks(spark, sf_dir):
    """Data lines and movement of published pictures, captions, row boundaries and two-band rows, one finding a row."""
    u = units(spark, sf_dir, "region", "r_regionkey")
    told = lambda df, kind, value: df.select("counter_extended", F.lit(kind).alias("kind"), value.cast("string").alias("value"))
    return (
        told(pictures.stability(u, ["capture_id"]), "stability", F.concat_ws("/", "data_rows", "shift"))
        .unionByName(told(pictures.captions(u, ["capture_id"]), "caption", F.concat_ws("/", "row", "byte1", "byte2")))
        .unionByName(told(pictures.row_boundaries(u, ["capture_id"]), "boundary", F.concat_ws("/", "row", "side", "status")))
        .unionByName(told(pictures.two_band_rows(u, ["capture_id"], [100, 400]), "two bands", F.concat_ws("/", "row", "why")))
    )
