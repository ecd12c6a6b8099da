"""Quality classifier: an interpolated modified Kneser-Ney model of characters (operator 6).

A model of `ORDER`-grams of characters for each language, trained on trusted text: all
documents labelled quality 1 and not toxic, but for the held-out ones. Its
counts stay in distributed tables, keyed by language and n-gram, and all of them are kept.
Scoring joins them in shards: documents are packed into chunks of bounded size; each
chunk asks each of SHARDS shards for its distinct n-grams; shards are split by groups of GROUP
chunks, so that rows and tasks grow with the input and no faster; a group's distinct requests meet the
counts of every order by joins on the n-gram and its context; the answers return to the
chunk in the order asked, which sums them over each of its documents. What is shuffled
are sorted distinct n-grams by chunk and, once, the compressed chunks: both grow with the input.

A fifth of the trusted documents, chosen by a hash of the id, is held out of training.
Their scores set each language's limit. A text's strain is its bits a character less the
language's median, over the scatter that its length makes likely: a variance of 1 / SCALE
between documents and 1 / (length + SHORT) within one. A document is rejected if its strain is over
the QUANTILE of its language's held-out ones. A language with n held-out ones, under LEAST_HELD, takes
n / LEAST_HELD of its own median and limit and the rest from those of all languages together; only without any
held-out text is there no limit. A language without trusted text to train on has no model,
and its texts are judged by their words alone: other languages say nothing about them.

Toxic words don't make a text improbable, so they are evidence of their own: of each word the
labelled documents tell (all but the held-out fifth, equal texts
once) how many that hold it are toxic. A word speaks for toxic documents if the share's posterior lies over TOXIC_BOUND
by TOXIC_Z deviations. A document is rejected for two such words, or for one whose bound is TOXIC_ALONE or more, however long it is;
toxicity is the greatest bound of a rejected document's words.

Texts are scored with runs of white space as one space and digits as 0. Null and empty texts have no
characters, a null score, and are kept; a null language is one of its own. Repeated rows
and ids are each scored; a null or repeated label counts if any of the id's rows says 1; rows without an id are
scored, and belong to no label. Extra columns, whatever their names, are not read. No documents give no rows, no
labels no model, no toxic words and no limit. A very long text is scored in pieces of SLICE_CHARS.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, brief_shuffles, by_shard, checkpoint_dir, chunks, forget_shuffles, forget_tables, map_rows, mix64, packed, release_memory, small, steady, unpacked, words_of

ORDER = 5
CHUNK_CHARS = 14_000_000
SLICE_CHARS = 500_000
#: Texts that a Python worker and the JVM beside it hold at a time besides a chunk.
TEXT_ROWS = 1024
#: The limit is a mean of quantiles: a text at it stays, however it is rounded.
ROUNDING = 1e-9
QUANTILE, LEAST_HELD, HELD_OUT, SHORT, SCALE = 0.98, 500, 5, 30, 4096
NO_LANG = "\x00"
#: Ids of labelled documents that go to every task at a time; more are taken in blocks, each with a pass over the documents.
MOST_IDS = 1_000_000
#: Documents that the toxic share of all stands for in a word's; deviations; the share that a word must exceed; toxic documents a word needs.
TOXIC_PRIOR, TOXIC_Z, TOXIC_BOUND, TOXIC_LEAST = 1.0, 2.0, 0.5, 2
#: The share's bound from which on a word is enough by itself.
TOXIC_ALONE = 0.65
#: Characters of an n-gram that choose its shard; shards of a group of chunks; chunks of a group.
HEAD, SHARDS, GROUP = 3, 64, 64
START, END = "\x02", "\x03"


def prepared(text: str | None) -> str:
    return "" if text is None else " ".join(text.replace("\x00", "�").split())


def gram_hashes(codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every ORDER code points in a row."""
    n = len(codes) - ORDER + 1
    h = codes[:n].astype(np.uint64)
    for k in range(1, ORDER):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += codes[k : k + n]
        h ^= h >> np.uint64(29)
    return mix64(h)


def slices(texts: list[str]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Pieces of the documents a slice at a time: whose they are, code points, ends of the pieces.

    A document is a piece with START and END about it; a very long one is several that share ORDER - 1 places.
    """
    at: list[int] = []
    parts: list[str] = []
    size = 0

    def coded():
        codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
        # A number is as likely as any other: digits count as one.
        codes[(codes >= 49) & (codes <= 57)] = 48
        return at, codes, np.cumsum([len(x) for x in parts])

    for i, t in enumerate(texts):
        whole = START * (ORDER - 1) + t + END if t else ""
        for a in range(0, len(whole) - ORDER + 1, SLICE_CHARS):
            at.append(i)
            parts.append(whole[a : a + SLICE_CHARS + ORDER - 1])
            size += len(parts[-1])
            if size >= SLICE_CHARS:
                yield coded()
                at, parts, size = [], [], 0
    if at:
        yield coded()


class Grams:
    """The distinct n-grams of some texts, sorted, and which of them stands at each place of each text.

    slices: whose the pieces are; the ids of the slice's n-grams and which of these stands at each place; ends of the pieces.
    """

    def __init__(self, texts: list[str]):
        # The hashes found so far, in order, and their numbers; what slices share is held once.
        known, number = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        codes_of, self.slices = [np.zeros((0, ORDER), np.uint32)], []
        for at, codes, ends in slices(texts):
            # Windows that lie across two pieces begin in the last ORDER - 1 places of one.
            own = np.ones(len(codes) - ORDER + 1, bool)
            for k in range(1, ORDER):
                own[ends[:-1] - k] = False
            where = np.flatnonzero(own)
            coded = pa.array(gram_hashes(codes)[where]).dictionary_encode()
            index, distinct = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_numpy()
            first = np.empty(len(distinct), np.int64)
            first[index[::-1]] = where[::-1]
            place = np.searchsorted(known, distinct)
            new = np.ones(len(distinct), bool)
            inside = np.flatnonzero(place < len(known))
            new[inside] = known[place[inside]] != distinct[inside]
            ids = np.empty(len(distinct), np.int32)
            ids[~new] = number[place[~new]]
            new = np.flatnonzero(new)
            new = new[np.argsort(distinct[new])]
            ids[new] = np.arange(len(known), len(known) + len(new))
            codes_of.append(codes[first[new][:, None] + np.arange(ORDER)])
            known, number = np.insert(known, place[new], distinct[new]), np.insert(number, place[new], ids[new])
            lengths = np.diff(np.concatenate([[0], ends])) - ORDER + 1
            # A slice's places are numbers among its own n-grams, as narrow as they can be: together they are the largest thing here.
            self.slices.append((at, (ids, index.astype(np.uint16 if len(distinct) <= 1 << 16 else np.int32)), np.cumsum(lengths)))
            del codes, own, where, coded, index, distinct, first, place, inside
        del known, number
        names = np.concatenate(codes_of).view(f"<U{ORDER}").ravel()
        del codes_of
        order = np.argsort(names)
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        self.names = names[order]
        self.slices = [(at, (rank[ids], index), ends) for at, (ids, index), ends in self.slices]

    def counts(self) -> np.ndarray:
        total = np.zeros(len(self.names), np.int64)
        for _, (ids, index), _ in self.slices:
            total[ids] += np.bincount(index, minlength=len(ids))
        return total

    def shards(self, lang: str) -> np.ndarray:
        """Each n-gram's shard, by its language and first characters, so that neighbours stay together."""
        heads, of = np.unique(self.names.astype(f"<U{HEAD}"), return_inverse=True)
        return np.array([shard_of(lang, h) for h in heads.tolist()], np.int64)[of] if len(heads) else np.zeros(0, np.int64)


def shard_of(lang: str, head: str) -> int:
    return zlib.crc32(f"{lang}/{head}".encode("utf-8", "surrogatepass")) % SHARDS


def _by_language(t: pa.Table) -> Iterator[tuple[str | None, list[int], list[str]]]:
    """Each language, its rows and prepared texts; the texts of one language at a time become Python's."""
    rows: dict[str | None, list[int]] = {}
    for i, x in enumerate(t.column(1).to_pylist()):
        rows.setdefault(x, []).append(i)
    texts = t.column(t.num_columns - 1)
    for lang in sorted(rows, key=lambda x: (x is None, x)):
        yield lang, rows[lang], [prepared(texts[i].as_py()) for i in rows[lang]]


def _named(lang: str | None) -> str:
    return NO_LANG if lang is None else lang


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, t in chunks(batches, CHUNK_CHARS):
        for lang, _, texts in _by_language(t):
            grams = Grams(texts)
            yield pa.RecordBatch.from_arrays([pa.array([_named(lang)]), pa.array([grams.names.tolist()], pa.list_(pa.string())), pa.array([grams.counts().tolist()], pa.list_(pa.int64()))], names=["lang", "gram", "n"])


def counted_grams(docs: DataFrame) -> DataFrame:
    """lang, gram, n over all the documents."""
    found = docs.select("doc_id", "lang", "text").mapInArrow(_counted, "lang string, gram array<string>, n array<long>")
    return found.select("lang", F.explode(F.arrays_zip("gram", "n")).alias("x")).groupBy("lang", F.col("x.gram").alias("gram")).agg(F.sum("x.n").alias("n"))


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each chunk, shard and language: the distinct n-grams, sorted and compressed."""
    import zstandard

    for name, t in chunks(batches, CHUNK_CHARS):
        rows = []
        for lang, _, texts in _by_language(t):
            grams = Grams(texts)
            for s, at in by_shard(grams.shards(_named(lang))):
                rows.append((name, s, _named(lang), zstandard.ZstdCompressor(level=6).compress("\x00".join(grams.names[at].tolist()).encode("utf-8", "surrogatepass"))))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ASKED, strict=True)], schema=_ASKED)


_ASKED = pa.schema([("chunk", pa.string()), ("shard", pa.int64()), ("lang", pa.string()), ("grams", pa.binary())])


def _unjoined(blob: bytes) -> list[str]:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(blob).decode("utf-8", "surrogatepass").split("\x00")


def _distinct(key: tuple, asked: pa.Table) -> pa.Table:
    every: dict[str, set[str]] = {}
    for lang, blob in zip(asked.column("lang").to_pylist(), asked.column("grams").to_pylist(), strict=True):
        every.setdefault(lang, set()).update(_unjoined(blob))
    n = sum(map(len, every.values()))
    return pa.table({"shard": pa.array([key[0].as_py()] * n, pa.int64()), "part": pa.array([key[1].as_py()] * n, pa.int64()), "lang": pa.array([x for x, g in every.items() for _ in g], pa.string()), "gram": pa.array([y for g in every.values() for y in g], pa.string())})


def _answered(key: tuple, asked: pa.Table, known: pa.Table) -> pa.Table:
    """The bits of each n-gram asked for, in the order asked."""
    table: dict[str, dict[str, float]] = {}
    for lang, gram, p in zip(*(known.column(c).to_pylist() for c in ("lang", "gram", "p")), strict=True):
        table.setdefault(lang, {})[gram] = p
    out = []
    for lang, blob in zip(asked.column("lang").to_pylist(), asked.column("grams").to_pylist(), strict=True):
        # A language without a model has no answers.
        out.append(-np.log2(np.array(list(map(table[lang].__getitem__, _unjoined(blob))))) if lang in table else np.zeros(0))
    table = {}
    release_memory()
    return pa.table({"chunk": asked.column("chunk"), "shard": asked.column("shard"), "lang": asked.column("lang"), "bits": pa.array([x.astype(np.float32).tobytes() for x in out], pa.binary())})


_DISCOUNTS = pa.schema([("lang", pa.string()), ("k", pa.int32()), ("d1", pa.float64()), ("d2", pa.float64()), ("d3", pa.float64())])


class Model:
    """A row for each language, order k and context: sum of its counts, share left to the order below, counts of what follows.

    Below the highest order a gram counts the characters it has been seen to follow.
    """

    def __init__(self, trusted: DataFrame):
        with arrow_rows(trusted.sparkSession, TEXT_ROWS):
            five = counted_grams(trusted).checkpoint()
        longer = five.select("lang", F.explode(F.sequence(F.lit(1), F.lit(ORDER - 1))).alias("k"), "gram").select("lang", "k", F.expr(f"substring(gram, {ORDER} - k, k + 1)").alias("gram")).distinct()
        lower = longer.groupBy("lang", "k", F.expr("substring(gram, 2, k)").alias("gram")).agg(F.count("*").alias("n"))
        counts = lower.unionByName(five.withColumn("k", F.lit(ORDER)))
        of = lambda c: F.sum(c.cast("long"))
        told = counts.groupBy("lang", "k", F.expr("substring(gram, 1, k - 1)").alias("context")).agg(
            F.sum("n").alias("total"), *[of(F.col("n") == i).alias(f"c{i}") for i in (1, 2, 3, 4)], of(F.col("n") >= 3).alias("more"),
            F.map_from_entries(F.collect_list(F.struct(F.expr("substring(gram, k, 1)"), F.col("n")))).alias("next"),
        )
        self.contexts = told.checkpoint()
        forget_tables(five)
        self.tables = [self.contexts]
        # A row for each language and order.
        sums = self.contexts.groupBy("lang", "k").agg(*[F.greatest(F.sum(f"c{i}"), F.lit(1)).alias(f"n{i}") for i in (1, 2, 3, 4)]).collect()
        fit = lambda x, top: min(max(x, 0.05), top)
        rows = []
        for r in sums:
            y = r.n1 / (r.n1 + 2 * r.n2)
            rows.append({"lang": r.lang, "k": r.k, "d1": fit(1 - 2 * y * r.n2 / r.n1, 0.95), "d2": fit(2 - 3 * y * r.n3 / r.n2, 1.95), "d3": fit(3 - 4 * y * r.n4 / r.n3, 2.95)})
        # From Arrow: a list would be read by Python workers of another kind, a second daemon and its workers in every executor.
        self.discounts = trusted.sparkSession.createDataFrame(pa.Table.from_pylist(rows, _DISCOUNTS))

    def probabilities(self, grams: DataFrame) -> DataFrame:
        """lang, gram, p for distinct (lang, gram) of order ORDER; languages without a model drop out."""
        need = grams.select("lang", F.explode(F.sequence(F.lit(1), F.lit(ORDER - 1))).alias("k"), "gram").select("lang", "k", F.expr(f"substring(gram, {ORDER + 1} - k, k)").alias("gram")).distinct().checkpoint()
        self.tables.append(need)
        p: DataFrame | None = None
        for k in range(1, ORDER + 1):
            now = need.where(F.col("k") == k).drop("k") if k < ORDER else grams
            known = self.contexts.where(F.col("k") == k).join(F.broadcast(self.discounts.where(F.col("k") == k).drop("k")), "lang")
            known = known.select("lang", "context", "total", "next", F.expr("(d1 * c1 + d2 * c2 + d3 * more) / total").alias("rest"), "d1", "d2", "d3")
            now = now.withColumn("context", F.substring("gram", 1, k - 1))
            if p is None:
                # Below the characters lies one chance for each known character and one for all others.
                now = now.join(known.withColumn("lower", 1.0 / (F.size("next") + 1)), ["lang", "context"])
            else:
                now = now.withColumn("suffix", F.substring("gram", 2, k - 1)).join(p.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("lower")), ["lang", "suffix"]).drop("suffix").join(known, ["lang", "context"], "left")
            n = F.try_element_at("next", F.substring("gram", k, 1))
            off = F.when(n >= 3, F.col("d3")).when(n == 2, F.col("d2")).otherwise(F.col("d1"))
            high = F.coalesce((n - off) / F.col("total"), F.lit(0.0))
            p = now.select("lang", "gram", (high + F.coalesce("rest", F.lit(1.0)) * F.col("lower")).alias("p"))
            if k == ORDER - 1:
                # The shuffles of the lower orders go before the widest one begins.
                p = p.checkpoint()
                self.tables.append(p)
                forget_shuffles(grams.sparkSession)
        return p

    def forget(self) -> None:
        """Delete the model's tables: no more probabilities, and those asked for must have been written."""
        forget_tables(*self.tables)


def toxic_words(docs: DataFrame, marks: DataFrame) -> dict[bytes, float]:
    """Words that speak for a toxic document, and how surely. marks: doc_id, toxic (0 or 1), once an id."""
    # Equal texts count once; only ids and hashes move.
    mark = F.xxhash64("text").alias("mark")
    known = with_ids(docs.where("text IS NOT NULL").select("doc_id", mark), marks, ["doc_id"])
    once = known.groupBy("mark").agg(F.max("toxic").alias("toxic"), F.min("doc_id").alias("doc_id")).checkpoint()
    sums = once.agg(F.sum("toxic").alias("a"), F.count("*").alias("n")).first()
    if not sums.a:
        return {}
    texts = with_ids(docs.select("doc_id", "text", mark), once, ["doc_id", "mark"])
    held = map_rows(texts, ["toxic", "text"], lambda toxic, text: (toxic, list(set(words_of(prepared(text))))), "toxic int, word array<binary>")
    told = held.select("toxic", F.explode("word").alias("word")).groupBy("word").agg(F.sum("toxic").alias("a"), F.count("*").alias("n")).where(F.col("a") >= TOXIC_LEAST)
    mean = (F.col("a") + TOXIC_PRIOR * sums.a / sums.n) / (F.col("n") + TOXIC_PRIOR)
    sure = mean - TOXIC_Z * F.sqrt(mean * (1 - mean) / (F.col("n") + TOXIC_PRIOR + 1))
    with arrow_rows(docs.sparkSession, TEXT_ROWS):
        return {bytes(r.word): r.sure for r in told.select("word", sure.alias("sure")).where(F.col("sure") >= TOXIC_BOUND).collect()}


def toxicity(text: str, toxic: dict[bytes, float]) -> float:
    """That of the worst word, if it is enough by itself or another one speaks too; else not a number."""
    words = words_of(text) if toxic else []
    found = [] if toxic.keys().isdisjoint(words) else [toxic[w] for w in toxic.keys() & set(words)]
    worst = max(found, default=0.0)
    return worst if worst >= TOXIC_ALONE or len(found) > 1 else float("nan")


def _scored(toxic):
    def run(key: tuple, answers: pa.Table, mine: pa.Table) -> pa.Table:
        told = {(s, x): np.frombuffer(b, np.float32) for s, x, b in zip(*(answers.column(c).to_pylist() for c in ("shard", "lang", "bits")), strict=True)}
        out: list[pa.Table] = []
        for blob in mine.column("docs"):
            t = unpacked(blob.as_py())
            bits, size, worst = np.full(t.num_rows, np.nan), np.zeros(t.num_rows, np.int64), np.full(t.num_rows, np.nan)
            for lang, rows, texts in _by_language(t):
                rows = np.array(rows)
                size[rows] = [len(x) for x in texts]
                worst[rows] = [toxicity(x, toxic.value) for x in texts]
                grams = Grams(texts)
                cost, known = np.zeros(len(grams.names)), True
                total_of, n_of = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
                for s, at in by_shard(grams.shards(_named(lang))):
                    got = told.get((s, _named(lang)))
                    if got is None or len(got) not in (0, len(at)):
                        raise RuntimeError("a chunk's n-grams have no answer: its rows were not the same when they were read again")
                    if len(got):
                        cost[at] = got
                    else:
                        known = False
                for at, (ids, index), ends in grams.slices if known else []:
                    total = np.concatenate([[0.0], np.cumsum(cost[ids][index])])
                    starts = np.concatenate([[0], ends[:-1]])
                    # A very long document has several pieces.
                    np.add.at(total_of, at, total[ends] - total[starts])
                    np.add.at(n_of, at, ends - starts)
                some = n_of > 0
                bits[rows[some]] = total_of[some] / n_of[some]
            out.append(pa.table({"doc_id": t.column(0).cast(pa.int64()), "lang": t.column(1), "mark": t.column(2), "n_scored": pa.array(size), "bits": pa.array(bits, from_pandas=True), "toxicity": pa.array(worst, from_pandas=True)}))
        told = grams = None
        release_memory()
        return pa.concat_tables(out) if out else _NOTHING

    return run


_NOTHING = pa.table({"doc_id": pa.array([], pa.int64()), "lang": pa.array([], pa.string()), "mark": pa.array([], pa.int64()), "n_scored": pa.array([], pa.int64()), "bits": pa.array([], pa.float64()), "toxicity": pa.array([], pa.float64())})


def scores(docs: DataFrame, model: Model, toxic: dict[bytes, float]) -> DataFrame:
    """doc_id, lang, mark (hash of language and text), n_scored, bits (a character; null without characters or model), toxicity (null without toxic words): one row for each row of docs. The model goes with its last answer."""
    docs = steady(docs.select("doc_id", "lang", _mark().alias("mark"), "text"))
    forget_shuffles(docs.sparkSession)
    # Read twice, with the same rows at a time: for the distinct n-grams, and to be answered.
    with arrow_rows(docs.sparkSession, TEXT_ROWS):
        asked = docs.mapInArrow(_asked, "chunk string, shard long, lang string, grams binary").checkpoint()
    parts = -(-asked.select("chunk").distinct().count() // GROUP) or 1
    parted = asked.withColumn("part", F.pmod(F.crc32("chunk"), F.lit(parts)))
    needed = parted.groupBy("shard", "part").applyInArrow(_distinct, "shard long, part long, lang string, gram string").checkpoint()
    forget_shuffles(docs.sparkSession)
    if parts == 1:
        # Each n-gram is asked for once.
        known = model.probabilities(needed.select("lang", "gram")).withColumn("shard", F.pmod(F.crc32(F.concat("lang", F.lit("/"), F.substring("gram", 1, HEAD)).cast("binary")), F.lit(SHARDS)).cast("long")).withColumn("part", F.lit(0).cast("long"))
    else:
        known = needed.join(model.probabilities(needed.select("lang", "gram").distinct()), ["lang", "gram"])
    # Written before the documents move, so that requests and joins are gone by then.
    answered = parted.groupBy("shard", "part").cogroup(known.groupBy("shard", "part")).applyInArrow(_answered, "chunk string, shard long, lang string, bits binary").checkpoint()
    model.forget()
    forget_tables(asked, needed)
    del asked, parted, needed, known
    forget_shuffles(docs.sparkSession)
    scored = answered.groupBy("chunk").cogroup(packed(docs, CHUNK_CHARS).groupBy("chunk")).applyInArrow(_scored(docs.sparkSession.sparkContext.broadcast(toxic)), "doc_id long, lang string, mark long, n_scored long, bits double, toxicity double")
    with arrow_rows(docs.sparkSession, TEXT_ROWS):
        scored = scored.checkpoint()
    forget_tables(answered)
    return scored


def with_ids(docs: DataFrame, ids: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """The rows of docs whose doc_id is among ids, joined to them, without moving a text: ids are broadcast, a block of about MOST_IDS at a time."""
    blocks = -(-ids.count() // MOST_IDS) or 1
    block = F.pmod(F.xxhash64("doc_id", F.lit("block")), F.lit(blocks))
    return reduce(DataFrame.unionByName, [docs.join(F.broadcast(ids.where(block == b) if blocks > 1 else ids), on, how) for b in range(blocks)])


def _mark() -> Column:
    return F.xxhash64("lang", "text")


def strain() -> Column:
    """How far a text's bits a character lie over its language's median, in units of what its length makes likely."""
    return (F.col("bits") - F.col("median")) / F.sqrt(1 / (F.col("n_scored") + SHORT) + F.lit(1 / SCALE))


def limits(held: DataFrame, langs: DataFrame) -> DataFrame:
    """lang, median, limit for each of langs, from scored held-out trusted documents; nothing without any."""
    held = held.where("bits IS NOT NULL").checkpoint()
    middle = F.percentile_approx("bits", 0.5, 10000)
    limit = F.percentile_approx(strain(), QUANTILE, 10000)
    own = held.groupBy("lang").agg(F.count("bits").alias("n"), middle.alias("own"))
    medians = langs.join(own, "lang", "left").crossJoin(held.agg(middle.alias("all")).where("all IS NOT NULL"))
    share = F.least(F.lit(1.0), F.coalesce("n", F.lit(0)) / LEAST_HELD)
    medians = medians.select("lang", share.alias("share"), (share * F.coalesce("own", "all") + (1 - share) * F.col("all")).alias("median")).checkpoint()
    strains = held.join(small(medians), "lang")
    own = strains.groupBy("lang").agg(limit.alias("own"))
    told = medians.join(own, "lang", "left").crossJoin(strains.agg(limit.alias("all")))
    return told.select("lang", "median", (F.col("share") * F.coalesce("own", "all") + (1 - F.col("share")) * F.col("all")).alias("limit"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, n_scored, bits, perplexity, toxicity, strain, limit, keep: one row for each row of docs."""
    return _judged(docs, labels).drop("mark")


def _judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """classify() and the mark of each row: what it is told by, beside its id."""
    checkpoint_dir(docs.sparkSession)
    marks = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").cast("int").alias("toxic"))
    trusted = marks.where("quality = 1 AND coalesce(toxic, 0) = 0").select("doc_id")
    held_out = F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT)) == 0
    plain = docs.select("doc_id", "lang", "text")
    with brief_shuffles(docs.sparkSession):
        model = Model(with_ids(plain, trusted.where(~held_out).checkpoint(), ["doc_id"], "left_semi"))
        toxic = toxic_words(plain, marks.where(~held_out & F.col("toxic").isin(0, 1)).select("doc_id", "toxic").checkpoint())
        # Scores are read twice: for the quantiles, and against them.
        scored = scores(docs, model, toxic).withColumn("lang", F.coalesce("lang", F.lit(NO_LANG)))
        # Languages with a model; joined by a shuffle if there are many.
        by_lang = limits(scored.join(trusted.where(held_out), "doc_id", "left_semi"), scored.where("bits IS NOT NULL").select("lang").distinct()).checkpoint()
    out = scored.join(small(by_lang), "lang", "left").withColumn("strain", strain())
    return out.select("doc_id", "mark", F.nullif("lang", F.lit(NO_LANG)).alias("lang"), "n_scored", "bits", F.pow(F.lit(2.0), F.col("bits")).alias("perplexity"), "toxicity", "strain", "limit", (F.coalesce(F.col("strain") <= F.col("limit") + ROUNDING, F.lit(True)) & F.col("toxicity").isNull()).alias("keep"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier keeps, columns as they are; each goes by its own text, whatever its id."""
    bad = _judged(docs, labels).where(~F.col("keep")).select(F.col("doc_id").alias("__bad"), F.col("mark").alias("__mark")).distinct()
    own = F.xxhash64(docs["lang"], docs["text"])
    return docs.join(bad, docs["doc_id"].cast("long").eqNullSafe(bad["__bad"]) & (own == bad["__mark"]), "left_anti")
