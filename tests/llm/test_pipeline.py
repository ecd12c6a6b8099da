"""The classifier and the whole pipeline against plain Python."""

import collections
import math
import random
import re

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from test_codecs import sha
from test_dedup import cut_lines, near_classes
from test_scans import contaminated, words
from tokenizers import Tokenizer

import corpus_pipeline
from rastrum.llm import quality

N = quality.ORDER


def grams(text):
    t = quality.START * (N - 1) + re.sub("[1-9]", "0", " ".join(text.split())) + quality.END
    return [t[i : i + N] for i in range(len(t) - N + 1)]


class KneserNey:
    def __init__(self, texts):
        self.c = {N: collections.Counter(g for t in texts if t and t.split() for g in grams(t))}
        for n in range(N - 1, 0, -1):
            self.c[n] = collections.Counter(g[1:] for g in self.c[n + 1])
        self.d, self.t = {}, {}
        for n, c in self.c.items():
            k = collections.Counter(c.values())
            n1, n2, n3, n4 = (max(1, k[i]) for i in (1, 2, 3, 4))
            y = n1 / (n1 + 2 * n2)
            fit = lambda x, top: min(max(x, 0.05), top)
            self.d[n] = [0, fit(1 - 2 * y * n2 / n1, 0.95), fit(2 - 3 * y * n3 / n2, 1.95), fit(3 - 4 * y * n4 / n3, 2.95)]
            self.t[n] = collections.defaultdict(lambda: [0, 0.0])
            for g, v in c.items():
                self.t[n][g[:-1]][0] += v
                self.t[n][g[:-1]][1] += self.d[n][min(v, 3)]

    def p(self, g):
        n = len(g)
        if n == 0:
            return 1 / (len(self.c[1]) + 1)
        total, rest = self.t[n].get(g[:-1], (0, 0.0))
        if not total:
            return self.p(g[1:])
        v = self.c[n].get(g, 0)
        return (v - self.d[n][min(v, 3)] if v else 0) / total + rest / total * self.p(g[1:])

    def bits(self, text):
        g = grams(text)
        return sum(-math.log2(self.p(x)) for x in g) / len(g)


def corpus():
    rng = random.Random(6)
    syllables = {"en": ["the", "ing", "on", "er", "st", "an"], "de": ["sch", "ei", "ung", "ber", "ü"]}
    prose = lambda lang, n: " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    rows = []
    for i in range(240):
        lang = "en" if i % 3 else "de"
        rows.append([i, "\n".join(prose(lang, 14) + "." for _ in range(rng.randrange(1, 7))), lang])
    for i in range(240, 270):
        rows.append([i, prose("en", 30).upper().replace(" ", "!! "), "en"])
    rows += [[300, None, "en"], [301, "", "de"], [302, rows[4][1], None], [303, rows[7][1] + " x", "en"], [304, prose("en", 300) + " 31415 92653", "en"], [305, prose("de", 90), "xx"], [306, rows[8][1], "en"]]
    items = [[0, prose("en", 15)], [1, prose("de", 4)], [2, None]]
    rows.append([307, prose("en", 20) + "\n" + items[0][1] + "\n" + prose("en", 9), "en"])
    labels = [[i, int(i < 240), 0] for i in range(0, 270) if i % 7] + [[300, 1, 0], [None, 1, 1]]
    return rows, labels, items


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    rows, labels, items = corpus()
    docs = spark.createDataFrame([(i, t, x, f"src{i % 3}", len(t or "")) for i, t, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def classified(spark):
    """id -> (bits, keep), in plain Python; only the hash that splits the labels is Spark's."""
    rows, labels, _ = corpus()
    trusted = {i for i, q, _ in labels if q == 1 and i is not None}
    ids = spark.createDataFrame([(i,) for i in trusted], "doc_id long")
    held = {r.doc_id for r in ids.where(F.pmod(F.xxhash64("doc_id"), F.lit(quality.HELD_OUT)) == 0).collect()}
    models, bits, lang_of = {}, {}, {i: x for i, _, x in rows}
    for lang in set(lang_of.values()):
        texts = [t for i, t, x in rows if x == lang and i in trusted - held]
        if any(t and t.split() for t in texts):
            models[lang] = KneserNey(texts)
    size = {i: len(" ".join((t or "").split())) for i, t, _ in rows}
    for i, t, x in rows:
        bits[i] = models[x].bits(t) if x in models and size[i] else None
    at = lambda v, q: sorted(v)[max(0, math.ceil(q * len(v)) - 1)]
    scored = [i for i in held if bits.get(i) is not None]
    share, median = {}, {}
    for lang in models:
        mine = [bits[i] for i in scored if lang_of[i] == lang]
        share[lang] = min(1, len(mine) / quality.LEAST_HELD)
        every = at([bits[i] for i in scored], 0.5)
        median[lang] = share[lang] * (at(mine, 0.5) if mine else every) + (1 - share[lang]) * every
    strain = lambda i: (bits[i] - median[lang_of[i]]) / math.sqrt(1 / (size[i] + quality.SHORT) + 1 / quality.SCALE)
    keep = {}
    for i, lang in lang_of.items():
        keep[i] = True
        if bits[i] is not None:
            every, mine = at([strain(j) for j in scored], quality.QUANTILE), [strain(j) for j in scored if lang_of[j] == lang]
            keep[i] = strain(i) <= share[lang] * (at(mine, quality.QUANTILE) if mine else every) + (1 - share[lang]) * every + 1e-6
    return bits, keep


def test_classifier_equals_brute_force(spark, sf_dir):
    bits, keep = classified(spark)
    got = {r.doc_id: r for r in quality.classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()}
    assert set(got) == set(bits)
    for i, r in got.items():
        assert (r.bits is None) == (bits[i] is None) and (r.bits is None or abs(r.bits - bits[i]) < 1e-4), i
        assert r.keep == keep[i], i
    assert not any(keep[i] for i in range(240, 270)) and sum(keep[i] for i in range(240)) >= 232


def test_long_texts_are_scored_in_pieces(monkeypatch):
    texts = ["ab" * 700, "", "the end of it", "x" * 999]
    whole = quality.Grams(texts)
    monkeypatch.setattr(quality, "SLICE_CHARS", 100)
    pieces = quality.Grams(texts)
    assert whole.names.tolist() == pieces.names.tolist() and whole.counts().tolist() == pieces.counts().tolist()
    places = lambda g: {i: sum(int(e - s) for at, _, ends in g.slices for j, s, e in zip(at, [0, *ends[:-1]], ends, strict=True) if j == i) for i in range(4)}
    assert places(whole) == places(pieces) and len(pieces.slices) > 10


def test_classifier_of_rows_with_clashing_names_and_ids(spark, sf_dir):
    """Null and repeated ids, repeated rows, rows in an order that a shuffle gives, columns named like the result's."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    more = docs.unionByName(docs.where("doc_id IN (8, 250)")).unionByName(docs.where("doc_id IN (9, 251)").withColumn("doc_id", F.lit(None).cast("long")))
    plain = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    got = quality.classify(more.withColumn("bits", F.lit("x")).withColumn("limit", F.lit(1)).repartition(7), labels).collect()
    assert len(got) == len(plain) + 4
    text = {r.doc_id: r.text for r in docs.collect()}
    assert sorted(r.keep for r in got if r.doc_id is None) == sorted(plain[i].keep for i in (9, 251)) and text[9]
    assert all(r.keep == plain[r.doc_id].keep for r in got if r.doc_id is not None)


def test_rows_go_by_their_own_texts(spark, sf_dir):
    """Null ids, and one id with a text that stays and one that goes."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    junk, plain = docs.where("doc_id = 250").first().text, docs.where("doc_id = 8").first().text
    more = spark.createDataFrame([(None, junk, "en"), (None, plain, "en"), (900, junk, "en"), (900, plain, "en"), (901, plain, "en"), (901, plain, "en")], "doc_id long, text string, lang string")
    every = docs.select("doc_id", "text", "lang").unionByName(more)
    kept = quality.accepted(every, labels)
    assert sorted(str(r.doc_id) for r in kept.where("doc_id IS NULL OR doc_id >= 900").collect()) == ["900", "901", "901", "None"]
    assert {r.text for r in kept.where("doc_id IS NULL OR doc_id >= 900").collect()} == {plain} and kept.columns == every.columns


def test_classifier_of_nothing(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    assert quality.classify(docs.limit(0), labels).count() == 0
    assert quality.classify(docs, labels.limit(0)).where("keep").count() == docs.count()


def test_pipeline_equals_brute_force(spark, sf_dir):
    rows, _, items = corpus()
    _, keep = classified(spark)
    texts = {i: t for i, t, _ in rows if keep[i]}
    after = cut_lines(sorted(texts.items()))
    texts = {i: t for i, t in after.items() if t == texts[i] or t.strip()}
    rows = sorted(texts.items())
    texts = {i: t for (i, t), c in zip(rows, near_classes(rows, words), strict=True) if i == c}
    texts = {i: t for i, t in texts.items() if not contaminated(t, items)[4]}
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = {}
    for i, t in texts.items():
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want[i] = (len(ids), sha(" ".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False)))
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == want


def test_stages_keep_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("keep", F.lit(1)).withColumn("node", F.lit("x"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns, name
