import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rastrum.llm import line_dedup, near_dup, repeats

DDL = "doc_id long, text string"


def removed(rows):
    """Brute force: bytes covered by a 50-byte string that starts in a smaller id's text."""
    out, texts = [], [(i, (t or "").encode()) for i, t in rows]
    for i, b in texts:
        earlier = {x[p : p + 50] for j, x in texts if i is not None and j is not None and j < i for p in range(len(x) - 49)}
        cover = bytearray(len(b))
        for p in range(len(b) - 49):
            if b[p : p + 50] in earlier:
                cover[p : p + 50] = b"\1" * 50
        kept = bytes(x for x, c in zip(b, cover, strict=True) if not c)
        spans = len(re.findall(b"\1+", bytes(cover)))
        out.append((i, len(b), sum(cover), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_repeats_equal_brute_force(spark):
    rng = random.Random(7)
    text = lambda n, a="abcdé \n": "".join(rng.choice(a) for _ in range(n))
    shared = [text(70), text(120), text(50), text(49)]
    rows = [(i, text(rng.randrange(200)) + rng.choice(shared) + text(rng.randrange(90)) + rng.choice(shared)) for i in range(60)]
    rows += [(60, None), (61, ""), (62, "x" * 400), (63, "y" + "x" * 90), (64, rows[3][1]), (64, rows[3][1]), (None, rows[3][1]), (-5, rows[5][1]), (65, "ab" * 300), (66, "ba" * 40), (67, "\x00" * 60), (68, "\x00" * 55)]
    df = spark.createDataFrame(rows, DDL).repartition(4).withColumn("n_bytes", F.lit("clash"))
    assert sorted((tuple(r) for r in repeats.remove_repeats(df).collect()), key=str) == removed(rows)
    assert repeats.remove_repeats(df.limit(0)).count() == 0


def test_suffix_order_is_the_order_of_all_suffixes():
    rng = random.Random(1)
    for n, longest in ((80, 50), (30, 3), (1, 50), (2, 255)):
        strings = [bytes(rng.choice(b"ab\x00z" if n > 2 else b"a") for _ in range(rng.randrange(1, 30))) for _ in range(n)]
        sid, off, shared = repeats.suffix_order(strings, longest)
        got = [strings[s][o:] for s, o in zip(sid.tolist(), off.tolist(), strict=True)]
        assert got == sorted(got) and len(got) == sum(len(s) + 1 for s in strings)
        common = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert shared.tolist() == [0, *(min(longest, common(a, b)) for a, b in zip(got, got[1:]))]


def near_classes(rows, words):
    """The class of each row: its smallest id."""
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append(collections.Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else None)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and (sets[a] & sets[b]).total() * 5 >= (sets[a] | sets[b]).total() * 4:
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min((x for x in (least.get(find(k)), i) if x is not None), default=None)
    return [least[find(k)] for k in range(len(rows))]


plain_words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
by_row = lambda rows: sorted(rows, key=str)


def test_near_duplicates_equal_brute_force(spark):
    rng, vocabulary = random.Random(11), [f"w{i}" for i in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randrange(20, 120))] for _ in range(12)]
    rows = []
    for i in range(220):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5, 9])):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((i, " ".join(w)))
    rows += [(300, None), (301, ""), (302, "!!"), (303, "!!"), (304, "one two"), (305, "One, two"), (306, "one two three"), (None, rows[0][1])]
    # Weights tell texts of one shingle apart: 2996 and 1996 of it are no near copies, 2996 and 2496 are.
    rows += [(307, "w1 " * 3000), (308, "W1 " * 2000), (309, "w1 " * 2500)]
    df = spark.createDataFrame(rows, DDL).repartition(5).withColumn("class_id", F.lit("clash")).withColumn("digest", F.lit("clash"))
    want = near_classes(rows, plain_words)
    assert by_row((r.doc_id, r.class_id) for r in near_dup.near_duplicates(df).collect()) == by_row((i, c) for (i, _), c in zip(rows, want, strict=True))
    kept = near_dup.deduplicated(df.union(df.where("doc_id = 3")))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for (i, _), c in zip(rows, want, strict=True) if i is not None and i == c) and kept.columns == df.columns
    assert near_dup.near_duplicates(df.limit(0)).count() == 0 and near_dup.deduplicated(df.limit(0)).count() == 0


def test_near_duplicates_in_several_slices(spark, monkeypatch):
    rng = random.Random(12)
    rows = [(i, " ".join(f"w{rng.randrange(9000)}" for _ in range(40)) if i % 5 else "") for i in range(300)]
    rows += [(1000 + i, t) for i, t in rows]
    df = spark.createDataFrame(rows, DDL).repartition(2)
    monkeypatch.setattr(near_dup, "SLICE_BYTES", 1000)
    # In this process, as workers don't see the patch.
    batches = pa.Table.from_pylist([{"doc_id": i, "digest": hashlib.md5(t.encode()).digest(), "text": t} for i, t in rows]).to_batches()
    got = pa.Table.from_batches(near_dup._signed(iter(batches))).to_pylist()
    assert [(r["doc_id"], r["digest"] is None, len(r["bands"])) for r in got] == [(i, not t, near_dup.BANDS) for i, t in rows]
    assert {r.doc_id: r.class_id for r in near_dup.near_duplicates(df).collect()} == {i: i if not t else i % 1000 for i, t in rows}


def test_near_duplicates_without_unique_ids(spark):
    """Null ids, an id with two texts, repeated rows: the same result in any order and partitioning."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    a2, c2 = a + " more", c + " more"
    rows = [(1, a), (1, b), (2, b + " more"), (3, a2), (None, a), (None, c), (None, c2), (1, a), (None, None), (None, None), (4, "?"), (4, "?")]
    want = near_classes(rows, plain_words)
    assert want == [1, 1, 1, 1, 1, None, None, 1, None, None, 4, 4]
    stay = by_row([(1, a), (1, b), (None, None), (None, None), (4, "?"), (4, "?")])
    for order, parts in ((rows, 1), (rows[::-1], 5)):
        df = spark.createDataFrame(order, DDL).repartition(parts)
        assert by_row((r.doc_id, r.class_id) for r in near_dup.near_duplicates(df).collect()) == by_row((i, x) for (i, _), x in zip(rows, want, strict=True))
        got = by_row(tuple(r) for r in near_dup.deduplicated(df).collect())
        assert [r for r in got if r[1] not in (c, c2)] == stay and len(got) == len(stay) + 1


def test_dart_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(3)
    names, k = rng.integers(0, 2**63, 300).astype(np.uint64), 512
    a, b = rng.uniform(0.2, 6, 300), rng.uniform(0.2, 6, 300)
    s = near_dup.dart_signatures(np.concatenate([names, names]), np.repeat([0, 1], 300), 2, k, np.concatenate([a, b]))
    truth = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((s[0] == s[1]).mean() - truth) < 5 * (truth * (1 - truth) / k) ** 0.5


def cut_lines(rows):
    found, texts = [], {}
    for i, t in rows:
        lines = (t or "").split("\n")
        solid = [k for k, x in enumerate(lines) if x.strip()]
        texts[i] = lines, solid, t
        for p in range(len(solid)):
            if p + 3 <= len(solid):
                found.append((i, p, 3, tuple(lines[k].strip() for k in solid[p : p + 3])))
            for n in (1, 2):
                part = [lines[k].strip() for k in solid[p : p + n]]
                if len(part) == n and len(" ".join(part).split()) >= 50:
                    found.append((i, p, n, tuple(part)))
    first = {}
    for i, p, _, x in found:
        first[x] = min(first.get(x, (i, p)), (i, p))
    out = {}
    for i, (lines, solid, t) in texts.items():
        drop = {k for j, p, n, x in found if j == i and first[x] < (j, p) for k in range(solid[p], solid[p + n - 1] + 1)}
        out[i] = None if t is None else "\n".join(x for k, x in enumerate(lines) if k not in drop)
    return out


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(13)
    lines = ["alpha", "beta ", "gamma", "delta", "", "  ", "epsilon", " ".join(["long"] * 55), " ".join(["some"] * 30), "zeta", "one " * 22]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 14)))) for i in range(80)] + [(90, None), (91, ""), (92, "alpha"), (93, "\n".join(["same"] * 4000))]
    df = spark.createDataFrame([(i, t, "x", len(t or "")) for i, t in rows], "doc_id long, text string, windows string, n_chars long").repartition(4)
    want = cut_lines(rows)
    report = {r.doc_id: r for r in line_dedup.line_report(df).collect()}
    assert {i: r.kept_sha256 for i, r in report.items()} == {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in want.items()}
    kept = {r.doc_id: r for r in line_dedup.without_repeats(df).collect()}
    before = dict(rows)
    stay = {i for i, t in want.items() if t == before[i] or t.strip()}
    assert set(kept) == stay and all(kept[i].text == want[i] for i in stay)
    assert all(r.n_chars == len(r.text or "") and r.windows == "x" for r in kept.values())
    assert line_dedup.line_report(df.limit(0)).count() == 0


def test_rows_without_an_id_stay(spark):
    df = spark.createDataFrame([(None, "a\nb\nc"), (1, "a\nb\nc"), (2, "a\nb\nc")], DDL)
    assert sorted((str(r.doc_id), r.text) for r in line_dedup.without_repeats(df).collect()) == [("1", "a\nb\nc"), ("None", "a\nb\nc")]
