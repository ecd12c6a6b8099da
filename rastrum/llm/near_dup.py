"""MinHash near-dedup with DartMinHash signatures (operator 4).

Elements are shingles of SHINGLE consecutive lower-cased words (all words, in shorter
texts), each weighted by how often the text holds it; two documents are near copies if the
weighted Jaccard similarity (sum of the lesser weights over sum of the greater) is THRESHOLD
or more, and a class is a connected group of near copies.

Signatures. Each element throws darts into its region of weight x rank, layer by layer
(weights 0 to 1, 1 to 2, 2 to 4, ...): the darts of a layer are a Poisson process along
the rank, all drawn by hashing, so an element throws the same darts in every document. A
document looks at ranks up to a bound that gives it K (ln K + 2) darts on average, keeps
those under its weight, deals them to K coordinates by their hash, and keeps the earliest
of each; where one stays empty, the bound doubles. Cost: one hash an element and a few
hundred darts a document. Exact comparisons number an element's occurrences: the similarity
of two weighted sets is that of the plain sets of (shingle, occurrence).

Banded join. Documents with equal texts are one node first. Nodes that share a band of
ROWS coordinates meet: of each band the node that meets the most others leads it, followers are held against the
leader by their exact sets, and the links make components. Nodes of bands that still
hold several components meet once more by an exact prefix filter (prefix_keys): only sets
that share a rare shingle early enough can be near copies. There the least altered nodes lead
(32, 256, 2048, ... of them a round) against those of other components behind them whose
places leave room for enough common shingles, until every pair of a key is linked, in one component, or known to be no near copy. So no link
between nodes of a band is lost, and no group's pairs are all emitted.
With 24 bands of 4 a pair of similarity 0.8 shares none with probability 3e-6.

Null and empty texts, and texts without words, are copies of nothing; other equal texts are
copies however short. Each row is a document of its own, whatever its id: rows that share an
id are told apart by their texts, rows without an id take part like any other. A class is
named by its smallest id, by null if none of its rows has one. Extra columns, whatever
their names, are neither read nor changed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_TABLE, arrow_rows, checkpoint_dir, forget_shuffles, mix64, release_memory, worker_cache

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 24, 4
SLICE_BYTES = 1_000_000
#: Texts, and pairs of sets, that a worker gets at a time.
TEXT_ROWS, PAIR_ROWS = 1000, 256
#: What a text with words holds.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
#: Nodes of a key that lead in the first round; each later round has eight times as many.
FIRST_LEADS = 32
#: Ratio of the sizes that bound a size class.
CLASS_RATIO = 1.05

_B = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def shingles(texts: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of some texts (repeats included), and the number of each one's text."""
    buf = np.frombuffer(b" ".join(t.translate(WORD_TABLE) for t in texts) + b" ", np.uint8)
    n = len(buf)
    word = buf != 32
    edge = np.diff(np.concatenate([[False], word, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    symbols = mix64(np.arange(256, dtype=np.uint64) + np.uint64(0x2545F4914F6CDD1D))
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(symbols[buf] * np.cumprod(np.full(n, _B)), out=prefix[1:])
    back = np.cumprod(np.full(n, _INVERSE))
    words = mix64((prefix[ends] - prefix[starts]) * back[starts])
    text_ends = np.cumsum([len(t) + 1 for t in texts])
    doc = np.searchsorted(text_ends, starts, side="right")
    count = np.bincount(doc, minlength=len(texts))
    first = np.cumsum(count) - count
    # Shorter texts are one shingle of all their words.
    short = np.flatnonzero((count > 0) & (count < size))
    h = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for k in range(size):
        h = h * _B + words[k : k + len(h)]
    own = np.flatnonzero(doc[: len(h)] == doc[size - 1 :]) if len(h) else np.zeros(0, np.int64)
    alone = []
    for d in short.tolist():
        x = 0
        for w in words[first[d] : first[d] + count[d]].tolist():
            x = (x * int(_B) + w) % 2**64
        alone.append(x)
    got = np.concatenate([h[own], np.array(alone, np.uint64)])
    of = np.concatenate([doc[own], short])
    order = np.argsort(of, kind="stable")
    return mix64(got[order] ^ np.uint64(size)), of[order]


def _uniform(x: np.ndarray) -> np.ndarray:
    """(0, 1) from 64-bit hashes."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def dart_signatures(elements: np.ndarray, of: np.ndarray, sets: int, k: int, weights: np.ndarray | None = None) -> np.ndarray:
    """The DartMinHash signatures (sets x k) of weighted sets; 0 throughout for empty ones.

    elements: hashes; of: the set of each; weights: of each, 1 by default. An element that is
    repeated in a set with the same weight counts once, as it throws the same darts.
    """
    weights = np.ones(len(elements)) if weights is None else weights
    out = np.zeros((sets, k), np.uint64)
    total = np.bincount(of, weights, sets)
    bound = np.zeros(sets)
    todo = np.flatnonzero(total > 0)
    bound[todo] = k * (math.log(k) + 2) / total[todo]
    while len(todo):
        mine = np.isin(of, todo) if len(todo) < sets else np.ones(len(of), bool)
        best = np.full((sets, k), np.inf)
        e, d, w = elements[mine], of[mine], weights[mine]
        layer, low = 0, 0.0
        while len(e):
            width = 1.0 if layer == 0 else low
            rank, at, live = np.zeros(len(e)), 0, np.arange(len(e))
            while len(live):
                dart = mix64(e[live] + np.uint64((layer * 0x9E3779B97F4A7C15 + at * 0xD1B54A32D192ED03 + 1) % 2**64))
                rank[live] -= np.log(_uniform(dart)) / width
                live_ok = rank[live] < bound[d[live]]
                live, dart = live[live_ok], dart[live_ok]
                # Where the dart lies in the layer's weights, and its coordinate.
                fine = low + width * _uniform(mix64(dart ^ np.uint64(0xA5A5A5A5A5A5A5A5))) < w[live]
                who, r, name = d[live][fine], rank[live][fine], dart[fine]
                spot = (mix64(name + np.uint64(0x632BE59BD9B4E019)) % np.uint64(k)).astype(np.int64)
                # Latest first, so that the earliest is written last.
                order = np.argsort(-r, kind="stable")
                who, r, name, spot = who[order], r[order], name[order], spot[order]
                better = r < best[who, spot]
                who, r, name, spot = who[better], r[better], name[better], spot[better]
                best[who, spot] = r
                out[who, spot] = name
                at += 1
            layer, low = layer + 1, max(1.0, low * 2)
            more = w > low
            e, d, w = e[more], d[more], w[more]
        todo = todo[np.isinf(best[todo]).any(axis=1)]
        bound[todo] *= 2
    return out


def band_keys(signatures: np.ndarray, bands: int = BANDS) -> np.ndarray:
    rows = signatures.shape[1] // bands
    keys = np.zeros((len(signatures), bands), np.uint64) + np.arange(1, bands + 1, dtype=np.uint64) * _B
    for r in range(rows):
        keys = mix64(keys + signatures[:, r::rows][:, :bands])
    return keys


def _texts(column: pa.Array) -> list[bytes]:
    return [(x or "").encode("utf-8", "surrogatepass") for x in column.to_pylist()]


def _slices(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    a = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= SLICE_BYTES or i == len(texts) - 1:
            yield a, i + 1
            a, size = i + 1, 0


def weighted(h: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct elements of each set, the set of each, and how often it holds it."""
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (of[1:] != of[:-1])])) if len(h) else np.zeros(0, np.int64)
    return h[new], of[new], np.diff(np.append(new, len(h))).astype(float)


def numbered(h: np.ndarray) -> np.ndarray:
    """The shingles of one text as a plain set, sorted: a shingle's second, third, ... occurrence is an element of its own."""
    h = np.sort(h)
    new = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    nth = np.arange(len(h)) - np.repeat(first, np.diff(np.append(first, len(h))))
    more = nth > 0
    h[more] = mix64(h[more] + nth[more].astype(np.uint64) * _B)
    return np.unique(h)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, digest of the text (null without words), band keys."""
    worker_cache("near_dup")
    for batch in batches:
        texts = _texts(batch.column(2))
        for a, b in _slices(texts):
            part = texts[a:b]
            h, of, weight = weighted(*shingles(part))
            some = (np.bincount(of, minlength=len(part)) > 0).tolist()
            keys = band_keys(dart_signatures(h, of, len(part), BANDS * ROWS, weight)).astype(np.int64)
            digest = pa.array([d if s else None for d, s in zip(batch.column(1).slice(a, b - a).to_pylist(), some, strict=True)], pa.binary())
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * BANDS, pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), digest, bands], names=["doc_id", "digest", "bands"])
    release_memory()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, size and content of the set of numbered shingles, sorted 64-bit hashes."""
    worker_cache("near_dup")
    for batch in batches:
        texts, ids = _texts(batch.column(1)), batch.column(0)
        for a, b in _slices(texts):
            h, of = shingles(texts[a:b])
            parts = [numbered(x) for x in np.split(h, np.cumsum(np.bincount(of, minlength=b - a))[:-1])]
            yield pa.RecordBatch.from_arrays([ids.slice(a, b - a).cast(pa.int64()), pa.array([len(x) for x in parts], pa.int64()), pa.array([x.tobytes() for x in parts], pa.binary())], names=["node", "size", "set"])
    release_memory()


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs with their sets, those whose similarity is THRESHOLD or more."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            # In whole numbers: 0.8 is 4 / 5.
            keep.append(both * 5 >= (len(x) + len(y) - both) * 4 if THRESHOLD == 0.8 else both >= THRESHOLD * (len(x) + len(y) - both))
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are near copies, by their exact sets."""
    of = lambda c: sets.select(F.col("node").alias(c), F.col("set").alias(f"set_{c}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "set_a", "set_b").mapInArrow(_linked, "a long, b long")


def able(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose sizes don't rule a near copy out, before any set moves."""
    size = lambda c: sets.select(F.col("node").alias(c), F.col("size").alias(f"s{c}"))
    sized = pairs.join(size("a"), "a").join(size("b"), "b")
    return sized.where(F.least("sa", "sb") >= F.greatest("sa", "sb") * (THRESHOLD - 1e-9)).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """node, class: the smallest node of each connected group, for nodes with an edge.

    Each round every node takes the smallest class about it, then its class's own class; the
    rounds are as many as the logarithm of the longest way, and each is checkpointed.
    """
    both = edges.select(F.col("a").alias("x"), F.col("b").alias("y")).union(edges.select("b", "a")).distinct().checkpoint()
    now = both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("class")).withColumnRenamed("x", "node")
    while True:
        near = both.join(now.select(F.col("node").alias("y"), F.col("class").alias("other")), "y").groupBy("x").agg(F.min("other").alias("other"))
        low = now.join(near.withColumnRenamed("x", "node"), "node").select("node", F.least("class", "other").alias("new"), F.col("class").alias("old"))
        jump = now.select(F.col("node").alias("new"), F.col("class").alias("far"))
        after = low.join(jump, "new").select("node", F.least("new", "far").alias("class"), (F.least("new", "far") != F.col("old")).alias("moved")).checkpoint()
        now = after.select("node", "class")
        if after.where("moved").isEmpty():
            forget_shuffles(edges.sparkSession)
            return now


def joined_classes(classes: DataFrame, links: DataFrame) -> DataFrame:
    """The classes after some more links: only classes that a link joins, and nodes that had none, are looked at."""
    of = lambda c: classes.select(F.col("node").alias(c), F.col("class").alias(f"c{c}"))
    between = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    merged = components(between)
    known = classes.join(merged.select(F.col("node").alias("class"), F.col("class").alias("into")), "class", "left").select("node", F.coalesce("into", "class").alias("class"))
    return known.unionByName(merged.join(classes.select("node"), "node", "left_anti")).checkpoint()


def _shingles_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, size, shingle: a row for each shingle of each set."""
    for batch in batches:
        for node, size, data in zip(*(batch.column(k) for k in range(3)), strict=True):
            h = np.frombuffer(data.as_buffer(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), node.as_py())), pa.array(np.full(len(h), size.as_py())), pa.array(h)], names=["node", "size", "shingle"])


def prefix_keys(sets: DataFrame) -> DataFrame:
    """band, node, size, rest: keys of which any two near copies among these sets share one (exact prefix filter).

    In each set shingles are ordered by how few sets hold them. Near copies of n and m shingles
    share o >= (n + m) * THRESHOLD / (1 + THRESHOLD), so their first common shingle has at most
    n - o shingles before it in one and m - o in the other. A key is a shingle and the size classes
    of both sides; a set emits a shingle for a class if its place allows it. Sets whose rare shingles
    are all their own emit nothing that others hold: they have no near copy, without a comparison.
    """
    rows = sets.mapInArrow(_shingles_of, "node long, size long, shingle long")
    # Counted by partial sums; the join that follows may split a shingle that very many sets hold.
    shared = rows.join(rows.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1"), "shingle")
    mine = Window.partitionBy("node")
    # Shingles that no other set holds come first; they are counted, not kept.
    placed = shared.withColumn("place", F.col("size") - F.count("*").over(mine) + F.row_number().over(mine.orderBy("df", "shingle")) - 1)
    own = F.floor(F.log("size") / math.log(CLASS_RATIO) + 1e-9).cast("int")
    reach = math.ceil(math.log(1 / THRESHOLD) / math.log(CLASS_RATIO))
    # The least size of a class, rounded down: a longer prefix is only more work.
    least = lambda c: F.floor(F.pow(F.lit(CLASS_RATIO), c) * (1 - 1e-6))
    share = THRESHOLD / (1 + THRESHOLD)
    other = F.filter(F.sequence(F.col("own") - reach, F.col("own") + reach), lambda c: F.col("size") - F.col("place") >= (F.col("size") + least(c)) * (share - 1e-9))
    spread = placed.withColumn("own", own).withColumn("other", F.explode(other))
    return spread.select(F.xxhash64("shingle", F.least("own", "other"), F.greatest("own", "other")).alias("band"), "node", "size", (F.col("size") - F.col("place")).alias("rest"))


def _digested(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5("text")).alias("digest"), "text")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the smallest id of its class): one row for each row of docs."""
    signed, nodes, classes = _classes(docs)
    named = _members(nodes, classes)
    names = named.groupBy("class").agg(F.min("low").alias("class_id"))
    by_text = named.join(names, "class").select("digest", "class_id")
    return signed.where("digest IS NOT NULL").join(by_text, "digest").select("doc_id", "class_id").unionByName(signed.where("digest IS NULL").select("doc_id", F.col("doc_id").alias("class_id")))


def _members(nodes: DataFrame, classes: DataFrame) -> DataFrame:
    """digest, low, class of every node, alone or not."""
    return nodes.join(classes, "node", "left").select("digest", "low", F.coalesce("class", "node").alias("class"))


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, digest), nodes (node, digest, low: smallest id) for each text with words, and the classes of nodes with an edge."""
    checkpoint_dir(docs.sparkSession)
    docs = _digested(docs)
    spark = docs.sparkSession
    with arrow_rows(spark, TEXT_ROWS):
        signed = docs.mapInArrow(_signed, "doc_id long, digest binary, bands array<long>").checkpoint()
    # Numbers that only this table gives out: read from its files ever after.
    nodes = signed.where("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("low"), F.first("bands").alias("bands")).withColumn("node", F.monotonically_increasing_id()).checkpoint()
    banded = nodes.select("node", F.explode("bands").alias("band"))
    crowds = banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    # All that is left below are bands with two nodes or more.
    met = banded.join(crowds, "band").checkpoint()
    # A text that others were made from meets more of them than its altered copies do each other.
    meets = met.groupBy("node").agg(F.sum("n").alias("meets"))
    leads = met.join(meets, "node").groupBy("band").agg(F.max(F.struct("meets", (-F.col("node")).alias("back"))).alias("lead"))
    held = met.select("band", "node").join(leads.select("band", (-F.col("lead.back")).alias("lead")), "band").checkpoint()
    wanted = nodes.join(held.select("node").distinct(), "node", "left_semi").select("node", F.col("digest").alias("__digest"), "low")
    texts = docs.join(wanted, (docs["digest"] == wanted["__digest"]) & docs["doc_id"].eqNullSafe(wanted["low"])).select("node", "text")
    with arrow_rows(spark, TEXT_ROWS):
        sets = texts.mapInArrow(_sets, "node long, size long, set binary").dropDuplicates(["node"]).checkpoint()
    forget_shuffles(spark)
    tried = held.where("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
    with arrow_rows(spark, PAIR_ROWS):
        edges = links(able(tried, sets), sets).checkpoint()
    classes = components(edges)
    # Bands that hold several components: their nodes meet again by the rarest shingles they share.
    of = lambda c: classes.select("node", F.col("class").alias(c))
    now = held.join(of("class"), "node", "left").withColumn("class", F.coalesce("class", "node"))
    split = now.groupBy("band").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo < hi").select("band")
    left = now.join(split, "band").select("node").distinct()
    with arrow_rows(spark, PAIR_ROWS):
        held = prefix_keys(sets.join(left, "node", "left_semi")).checkpoint()
    forget_shuffles(spark)
    # The first key that two sets share leaves room for their overlap in both.
    room = F.least("ra", "rb") * (1 + THRESHOLD) >= (F.col("sa") + F.col("sb")) * (THRESHOLD - 1e-9)
    side = lambda df, c: df.select("band", F.col("node").alias(c), F.col("place").alias(f"p{c}"), F.col("class").alias(f"c{c}"), F.col("size").alias(f"s{c}"), F.col("rest").alias(f"r{c}"), "n")
    placed, first, leads = None, 0, FIRST_LEADS
    while True:
        if placed is None:
            # Keys that hold several components. Their nodes are ordered by how few rarer shingles they
            # have: a text that others were made from comes before its altered copies, and links them all.
            now = held.join(classes, "node", "left").withColumn("class", F.coalesce("class", "node"))
            split = now.groupBy("band").agg(F.min("class").alias("lo"), F.max("class").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("band", "n")
            placed = now.join(split, "band").withColumn("place", F.row_number().over(Window.partitionBy("band").orderBy(F.col("size") - F.col("rest"), "node")) - 1).checkpoint()
        rest = placed.where(F.col("n") > first + 1)
        if rest.isEmpty():
            return signed.select("doc_id", "digest"), nodes.select("node", "digest", "low"), classes
        # The next leads meet those behind them.
        lead = side(rest, "a").where((F.col("pa") >= first) & (F.col("pa") < first + leads)).drop("n")
        pairs = lead.join(side(rest, "b").drop("n"), "band").where((F.col("pb") > F.col("pa")) & (F.col("ca") != F.col("cb")) & room).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().checkpoint()
        first, leads = first + leads, leads * 8
        with arrow_rows(spark, PAIR_ROWS):
            more = None if pairs.isEmpty() else links(pairs, sets).checkpoint()
        if more is not None and not more.isEmpty():
            classes, placed = joined_classes(classes, more), None


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of each class: that with its smallest id (rows without one last), of several texts under it the one with the least digest,
    of equal rows one; rows without words all stay. Columns as they are."""
    _, nodes, classes = _classes(docs)
    best = _members(nodes, classes).groupBy("class").agg(F.min(F.struct(F.col("low").isNull(), F.col("low"), F.col("digest"))).alias("best"))
    keep = best.select(F.col("best.digest").alias("__keep_digest"), F.col("best.low").alias("__keep_low"))
    own = F.unhex(F.md5(docs["text"]))
    columns = [docs[f"`{c}`"] for c in docs.columns]
    some = F.coalesce(docs["text"], F.lit("")).rlike(WORD)
    stay = docs.where(some).join(keep, (own == keep["__keep_digest"]) & docs["doc_id"].cast("long").eqNullSafe(keep["__keep_low"])).select(*columns, "__keep_digest")
    return stay.dropDuplicates(["__keep_digest"]).drop("__keep_digest").union(docs.where(~some))
