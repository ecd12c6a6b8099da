"""Joins and rolling operators: repeated rows, empty sides, small blocks."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rastrum.operators import joins, sequence, stats


def test_repeated_rows_each_get_their_match(spark):
    units = spark.createDataFrame([(5, 100), (5, 100), (6, 101)], "counter long, arrival long")
    resyncs = spark.createDataFrame([(5, 90, 7), (5, 95, 8), (6, 200, 9)], "counter long, arrival long, ordinal long")
    got = sorted((r.counter, r.arrival, r.matched_ordinal) for r in joins.correlate(units, resyncs, [], "counter", "arrival").collect())
    assert got == [(5, 100, 8), (5, 100, 8), (6, 101, None)]
    df = spark.createDataFrame([(1, 10), (1, 10), (2, None)], "k long, target long")
    near = joins.nearest(df, spark.createDataFrame([(65537,), (1,), (1,)], "e long"), "k", "e", "target", 20)
    assert sorted((r.k, r.nearest, r.distance) for r in near.where("k = 1").collect()) == [(1, 1, 9), (1, 1, 9)]
    assert near.where("k = 2 AND nearest IS NULL").count() == 1


def test_correlation_sees_the_last_256_that_had_arrived(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(40), i, rng.random() < 0.3) for i in range(1500)]
    units = [(c, i) for c, i, u in rows if u]
    resyncs = [(c, i) for c, i, u in rows if not u]
    want = {}
    for c, i in units:
        seen = [r for r in resyncs if r[1] < i][-256:]
        want[i] = max((a for x, a in seen if x == c), default=None)
    got = joins.correlate(spark.createDataFrame(units, "c long, at long"), spark.createDataFrame([(c, i, i) for c, i in resyncs], "c long, at long, o long"), [], "c", "at")
    assert {r["at"]: r.matched_o for r in got.collect()} == want


def test_schedules_of_any_size(spark):
    df = spark.createDataFrame([(5,), (0,), (None,), (70_000,), (-1,)], "c long")
    empty = spark.createDataFrame([], "first_counter long, note string")
    assert [r.note for r in joins.schedule_lookup(df, empty, "c").collect()] == [None] * 5
    many = spark.createDataFrame([(i, f"n{i}") for i in range(65_536)], "first_counter long, note string")
    assert sorted((str(r.c), r.note) for r in joins.schedule_lookup(df, many, "c").collect()) == [("-1", None), ("0", "n0"), ("5", "n5"), ("70000", "n65535"), ("None", None)]
    with pytest.raises(ValueError):
        joins.schedule_lookup(df, many.union(spark.createDataFrame([(99_999, "x")], many.schema)), "c")


def test_refused_decisions_raise(spark):
    units = spark.createDataFrame([(0, 5, True), (1, 6, True)], "ordinal long, counter16 long, complete boolean")
    log = spark.createDataFrame([(0, 65541), (1, 65542)], "ordinal long, ext long")
    assert [r.ext for r in joins.decisions_of_units(units, log, [], "ordinal", "counter16", "complete", "ext").orderBy("ordinal").collect()] == [65541, 65542]
    with pytest.raises(Exception, match="unit 1: another counter"):
        joins.decisions_of_units(units, log.withColumn("ext", F.col("ordinal") + 65541 - F.col("ordinal")), [], "ordinal", "counter16", "complete", "ext").collect()


def voted(votes, rows=30):
    held, winner, out = [], 0, []
    for v in votes:
        if v is not None:
            held = [*held, v][-rows:]
            n = Counter(held)
            best = {x for x in n if n[x] == max(n.values())}
            winner = winner if winner in best else v if v in best else next(x for x in held if x in best)
        out.append((winner, max(Counter(held).values(), default=0)))
    return out


@pytest.mark.parametrize("block", [200_000, 40, 7])
def test_votes_keep_their_anchor_in_any_blocks(spark, block):
    rng = random.Random(6)
    streams = {k: [rng.choice([None, 1, 2, 2, 3, -1]) if rng.random() < 0.9 else 5 for _ in range(n)] for k, n in (("a", 333), ("b", 1), ("c", 90))}
    rows = [(k, 3 * i, v) for k, vs in streams.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "k string, n long, vote long").repartition(4)
    got = sequence.rolling_vote(df, ["k"], "n", "vote", block=block).orderBy("k", "n").collect()
    assert [(r.winner, r.winner_count) for r in got] == [x for k in sorted(streams) for x in voted(streams[k])]
    whole = sequence.rolling_vote(df.where("k = 'a'").drop("k"), [], "n", "vote", block=block).orderBy("n").collect()
    assert [r.winner for r in whole] == [w for w, _ in voted(streams["a"])]


@pytest.mark.parametrize("block", [200_000, 5])
def test_windows_reach_into_the_block_before(spark, block):
    rng = random.Random(8)
    values = [rng.randrange(50) for _ in range(60)]
    df = spark.createDataFrame([(i * i, v) for i, v in enumerate(values)], "n long, v long").repartition(3)
    got = [r.median for r in sequence.rolling_median(df, [], "n", "v", rows=7, block=block).orderBy("n").collect()]
    for i, m in enumerate(got):
        part = sorted(values[max(0, i - 6) : i + 1])
        assert m == (part[(len(part) - 1) // 2] + part[len(part) // 2]) / 2


def test_a_wide_gap_is_spread_in_parts(spark):
    df = spark.createDataFrame([(0,), (200_001,), (200_003,)], "n long")
    gaps = sequence.absent_rows(df, [], "n")
    assert gaps.count() == 200_001 and gaps.agg(F.min("n"), F.max("n")).first() == (1, 200_002) and gaps.distinct().count() == 200_001


def test_overlays_across_cells(spark):
    rng = random.Random(2)
    spans = [(a := rng.randrange(300), a + rng.randrange(1, 60), i) for i in range(40)]
    top = {x: max((p for a, b, p in spans if a <= x < b), default=None) for x in range(400)}
    df = spark.createDataFrame(spans, "a long, b long, p long")
    for cell in (7, 100, 1 << 20):
        got = sorted(tuple(r) for r in joins.overlay(df, [], "a", "b", "p", ["p"], cell=cell).collect())
        edges = sorted({x for a, b, _ in spans for x in (a, b)})
        want = [(x, y, top[x]) for x, y in zip(edges, edges[1:]) if top[x] is not None]
        assert got == want, cell


def test_spans_merge_in_any_blocks(spark):
    rng = random.Random(3)
    spans = [(a := rng.randrange(500), a + rng.randrange(12)) for _ in range(80)]
    covered, want = sorted(spans), []
    for a, b in covered:
        if want and a <= want[-1][1]:
            want[-1] = (want[-1][0], max(want[-1][1], b), want[-1][2] + 1)
        else:
            want.append((a, b, 1))
    for block in (None, 40):
        assert sorted(tuple(r) for r in sequence.merge_spans(spark.createDataFrame(spans, "a long, b long"), [], "a", "b", block).collect()) == want


def test_laws_that_hold_say_nothing(spark):
    totals = spark.createDataFrame([("a", 5, 3, 2), ("b", 5, 3, 1)], "k string, whole long, x long, y long")
    got = stats.conservation_laws(totals, ["k"], {"law": (["x", "y"], ["whole"])}).collect()
    assert [tuple(r) for r in got] == [("b", "law", 4, 5)]
