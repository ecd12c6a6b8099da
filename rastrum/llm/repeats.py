"""Suffix-array dedup: bytes covered by strings that an earlier document holds (operator 5).

A byte goes if a `LENGTH`-byte string over it also starts in a document with a smaller id.

Sharding. The least hash of the M-byte strings inside a window of LENGTH bytes depends on the
window alone, so equal windows share it wherever they are. Runs of windows with the same
least hash form a piece, a short string that holds them all; pieces are dealt out by that
hash. First only hashes travel, to find those that two documents hold; then the pieces of
those, one copy from each chunk of documents with its smallest id; the answers, the smallest
id for each window, go back to the chunk, which knows where its own copies are. So no task
ever holds a group of copies, and every document's text stays in its chunk.

Construction. A shard's pieces are a collection of short strings whose Burrows-Wheeler
transform and common prefixes are built column by column: each round inserts, for every string, its next
symbol from the right, at the place that the symbol's rank among those already there gives (counting
sort of the transform; the new transform is written in one sequential pass). What the new suffix shares
with its neighbours is one symbol more than the least common prefix between the rows that they extend, so
the prefixes are carried through the rounds, up to LENGTH. At the end a class is a run of rows whose prefix
is LENGTH long, and its windows take the smallest id of any. Pieces equal as a whole are one string there;
where a hash has a single string left, its windows are one class each, and no order is needed.

Whole documents as columns would need a round for each byte of the longest, each over all
files; pieces bound the rounds by MOST_WINDOWS + LENGTH. A block of strings is small enough
to keep its transform in memory in place of external files; what is external is Spark's
shuffle between the steps. A chunk sends a row to each shard that it has hashes for, so rows are
at most as many as hashes, however many chunks and shards there are.

Null texts are empty; rows with a null id keep all their bytes and lend none; repeated
rows with one id aren't earlier than each other. Lone rows come out once for each row in. Extra
columns, whatever their names, are left out; no documents give no rows. A text is cut into pieces as a
whole: a very long one takes some fifty bytes a byte while that lasts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_shard, checkpoint_dir, chunks, mix64, packed, steady, unpacked

LENGTH, M = 50, 20
MOST_WINDOWS = 64
CHUNK_CHARS = 16_000_000
SLICE_BYTES = 1_000_000
SHARD_BYTES = 16_000_000
BLOCK = 4096
NO_ID = np.iinfo(np.int64).max
HASH_BYTES = 6

_B = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


class Chunk:
    """A chunk's documents as bytes, and its pieces: document, first byte, number of windows, least hash, hash of the content."""

    def __init__(self, t: pa.Table):
        self.ids = t.column(0).to_pylist()
        self.texts = [(x or "").encode("utf-8", "surrogatepass") for x in t.column(1).to_pylist()]
        found = [self._pieces(rows) for rows in self._slices()]
        self.doc, self.start, self.windows, self.hash, self.content = (np.concatenate(x) for x in zip(*found, strict=True)) if found else [np.zeros(0, d) for d in (np.int64, np.int64, np.int64, np.uint64, np.uint64)]
        self.id = np.array([NO_ID if i is None else i for i in self.ids], np.int64)

    def _slices(self) -> Iterator[list[int]]:
        rows, size = [], 0
        for i, x in enumerate(self.texts):
            if len(x) >= LENGTH:
                rows.append(i)
                size += len(x)
            if rows and (size >= SLICE_BYTES or i == len(self.texts) - 1):
                yield rows
                rows, size = [], 0
        if rows:
            yield rows

    def _pieces(self, rows: list[int]):
        buf = np.frombuffer(b"".join([self.texts[i] for i in rows]), np.uint8)
        ends = np.cumsum([len(self.texts[i]) for i in rows])
        n = len(buf)
        # A polynomial over all bytes; differences of its prefixes are hashes of any string.
        symbols = mix64(np.arange(256, dtype=np.uint64) + np.uint64(0x5851F42D4C957F2D))
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(symbols[buf] * np.cumprod(np.full(n, _B)), out=prefix[1:])
        inverse = np.cumprod(np.full(n, _INVERSE))
        least = mix64((prefix[M:] - prefix[:-M]) * inverse[: n - M + 1])
        wide = 1
        while wide < LENGTH - M + 1:
            step = min(wide, LENGTH - M + 1 - wide)
            least = np.minimum(least[:-step], least[step:])
            wide += step
        starts = np.concatenate([[0], ends[:-1]])
        doc = np.repeat(np.arange(len(rows)), np.diff(np.concatenate([[0], ends])))[: len(least)]
        whole = np.arange(len(least)) + LENGTH <= ends[doc]
        new = np.ones(len(least), bool)
        new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1]) | (whole[1:] != whole[:-1])
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(least)))
        keep = whole[first]
        first, count = first[keep], count[keep]
        # Long runs (periodic text) are cut: rounds stay bounded.
        parts = -(-count // MOST_WINDOWS)
        step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        first, count = np.repeat(first, parts) + step * MOST_WINDOWS, np.minimum(np.repeat(count, parts) - step * MOST_WINDOWS, MOST_WINDOWS)
        content = mix64((prefix[first + count + LENGTH - 1] - prefix[first]) * inverse[first] + count.astype(np.uint64))
        return np.array(rows)[doc[first]], first - starts[doc[first]], count, least[first], content

    def text(self, k: int) -> bytes:
        return self.texts[self.doc[k]][self.start[k] : self.start[k] + self.windows[k] + LENGTH - 1]

    def hashes(self):
        """Distinct hashes in order, each piece's number among them, and whether two ids hold it."""
        distinct, inverse = np.unique(self.hash, return_inverse=True)
        low, high = np.full(len(distinct), NO_ID), np.full(len(distinct), -1 - NO_ID)
        np.minimum.at(low, inverse, self.id[self.doc])
        np.maximum.at(high, inverse, self.id[self.doc])
        return distinct, inverse, high > low


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return (hashes % np.uint64(shards)).astype(np.int64)


def _asked(shards: int):
    """Of each chunk and shard: the hashes in order, and which of them two ids of the chunk hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, t in chunks(batches, CHUNK_CHARS):
            distinct, _, many = Chunk(t).hashes()
            rows = [(name, s, _short(distinct[at]), np.packbits(many[at]).tobytes()) for s, at in by_shard(shard_of(distinct, shards))]
            yield pa.RecordBatch.from_pylist([dict(zip(("chunk", "shard", "hashes", "many"), r, strict=True)) for r in rows], schema=_ASKED)

    return run


_ASKED = pa.schema([("chunk", pa.string()), ("shard", pa.int64()), ("hashes", pa.binary()), ("many", pa.binary())])


def _short(hashes: np.ndarray) -> bytes:
    """The high HASH_BYTES bytes of each: strings taken for equal by mistake only cost work."""
    return hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES].tobytes()


def _long(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // HASH_BYTES, 8), np.uint8)
    out[:, :HASH_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, HASH_BYTES)
    return out.view(">u8").ravel().astype(np.uint64)


def _met(key: tuple, asked: pa.Table) -> pa.Table:
    """Which of a shard's hashes two ids hold, as bits in the order of each chunk's hashes."""
    parts = [_long(x) for x in asked.column("hashes").to_pylist()]
    every = np.concatenate(parts)
    many = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=len(p)) for b, p in zip(asked.column("many").to_pylist(), parts, strict=True)]).astype(bool)
    distinct, inverse, count = np.unique(every, return_inverse=True, return_counts=True)
    shared = count > 1
    shared[inverse[many]] = True
    bits = np.split(shared[inverse], np.cumsum([len(p) for p in parts])[:-1])
    return pa.table({"chunk": asked.column("chunk"), "shard": asked.column("shard"), "kind": pa.array(["met"] * len(parts)), "data": pa.array([np.packbits(b).tobytes() for b in bits], pa.binary())})


def _wanted(chunk: Chunk, met: list[dict], shards: int):
    """The chunk's pieces whose hash is shared, by shard: their numbers, that of each one's string, a piece for each string.

    Pieces are one string if both hashes agree, in 128 bits of which the first 64 name few strings.
    """
    distinct, inverse, _ = chunk.hashes()
    shard, shared = shard_of(distinct, shards), np.zeros(len(distinct), bool)
    bits = {r["shard"]: r["data"] for r in met}
    for s, at in by_shard(shard):
        if s not in bits:
            raise RuntimeError("a chunk's hashes have no answer: its rows were not the same when they were read again")
        shared[at] = np.unpackbits(np.frombuffer(bits[s], np.uint8), count=len(at)).astype(bool)
    pieces = np.flatnonzero(shared[inverse])
    for s, at in by_shard(shard[inverse[pieces]]):
        mine = pieces[at]
        order = np.lexsort((chunk.content[mine], chunk.hash[mine]))
        h, c = chunk.hash[mine][order], chunk.content[mine][order]
        new = np.ones(len(mine), bool)
        new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
        strings = np.empty(len(mine), np.int64)
        strings[order] = np.cumsum(new) - 1
        yield s, mine, strings, mine[order][new]


def _sent(shards: int):
    def run(key: tuple, met: pa.Table, mine: pa.Table) -> pa.Table:
        import zstandard

        rows = []
        for blob in mine.column("docs").to_pylist():
            chunk = Chunk(unpacked(blob))
            for s, pieces, strings, distinct in _wanted(chunk, met.to_pylist(), shards):
                low = np.full(len(distinct), NO_ID)
                np.minimum.at(low, strings, chunk.id[chunk.doc[pieces]])
                lengths = (chunk.windows[distinct] + LENGTH - 1).astype(np.uint16)
                body = chunk.hash[distinct].tobytes() + low.tobytes() + lengths.tobytes() + b"".join([chunk.text(k) for k in distinct.tolist()])
                rows.append({"chunk": key[0].as_py(), "shard": s, "n": len(distinct), "pieces": zstandard.ZstdCompressor(level=1).compress(body)})
        return pa.Table.from_pylist(rows, schema=pa.schema([("chunk", pa.string()), ("shard", pa.int64()), ("n", pa.int64()), ("pieces", pa.binary())]))

    return run


def suffix_order(strings: list[bytes], longest: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All suffixes of a collection in order (string, offset) and what each shares with the one before it, up to `longest`.

    One symbol of each string is inserted a round, and the common prefixes with it.
    """
    n, lens = len(strings), np.array([len(s) for s in strings])
    text = np.zeros((n, lens.max() + 1), np.uint8)
    for i, s in enumerate(strings):
        # UTF-8 has no byte over 0xF4: 0 is free for the end.
        text[i, : len(s)] = np.frombuffer(s, np.uint8) + 1
    bwt = text[np.arange(n), lens - 1]
    name, shared = np.arange(n) << 16 | lens, np.zeros(n, np.uint8)
    row = np.arange(n)
    for j in range(1, int(lens.max()) + 1):
        act = np.flatnonzero(lens >= j)
        order = np.argsort(bwt, kind="stable")
        rank = np.empty(len(bwt), np.int64)
        rank[order] = np.arange(len(bwt))
        mine, at = row[act], rank[row[act]]
        place = n + at - np.count_nonzero(bwt == 0)
        # Rows with the same symbol are extended to neighbours that share it and all that the rows between have in common.
        mark, end = bwt[mine], len(bwt) - 1
        before = (at > 0) & (bwt[order[np.maximum(at - 1, 0)]] == mark)
        after = (at < end) & (bwt[order[np.minimum(at + 1, end)]] == mark)
        with_before = np.zeros(len(act), np.uint8)
        with_before[before] = _extended(shared, order[at[before] - 1], mine[before], longest)
        with_after = _extended(shared, mine[after], order[at[after] + 1], longest)
        old = np.ones(len(bwt) + len(act), bool)
        old[place] = False
        wider, names, common = np.empty(len(old), np.uint8), np.empty(len(old), np.int64), np.empty(len(old), np.uint8)
        wider[old], names[old], common[old] = bwt, name, shared
        preceding = lens[act] - j - 1
        wider[place] = np.where(preceding >= 0, text[act, preceding], 0)
        names[place] = act << 16 | (lens[act] - j)
        common[place] = with_before
        common[place[after] + 1] = with_after
        bwt, name, shared, row[act] = wider, names, common, place
    return name >> 16, name & 0xFFFF, shared


def _extended(shared: np.ndarray, first: np.ndarray, last: np.ndarray, longest: int) -> np.ndarray:
    """1 and the least of shared over (first, last] for each pair of rows, `longest` at most."""
    if not len(first):
        return np.zeros(0, np.uint8)
    # Every other segment is a range that is asked for; in order of the rows those between are short. The last one may end with the table.
    order = np.argsort(last)
    bounds = np.stack([first[order] + 1, last[order] + 1], axis=1).ravel()
    least = np.empty(len(first), np.int64)
    least[order] = np.minimum.reduceat(shared, bounds[:-1] if bounds[-1] == len(shared) else bounds)[::2]
    return np.minimum(least + 1, longest).astype(np.uint8)


def least_ids(strings: list[bytes], low: np.ndarray) -> np.ndarray:
    """For each window of LENGTH bytes of each string, in order, the smallest of the ids whose strings hold that window."""
    sid, off, shared = suffix_order(strings)
    lens = np.array([len(s) for s in strings])
    keep = np.flatnonzero(lens[sid] - off >= LENGTH)
    # What neighbours among the windows share is the least of what lies between them.
    common = np.minimum.reduceat(shared[keep[0] + 1 :], keep[:-1] - keep[0]) if len(keep) > 1 else np.zeros(0, np.uint8)
    sid, off = sid[keep], off[keep]
    first = np.flatnonzero(np.concatenate([[True], common < LENGTH]))
    of = np.repeat(np.minimum.reduceat(low[sid], first), np.diff(np.append(first, len(sid))))
    windows = lens - LENGTH + 1
    out = np.empty(windows.sum(), np.int64)
    out[(np.cumsum(windows) - windows)[sid] + off] = of
    return out


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each range, one after the other."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


def _answered(key: tuple, sent: pa.Table) -> pa.Table:
    """For each piece of each chunk, the smallest id of each window, as runs (windows, id)."""
    import zstandard

    sizes, hashes, lows, strings = sent.column("n").to_pylist(), [], [], []
    for n, blob in zip(sizes, sent.column("pieces").to_pylist(), strict=True):
        body = zstandard.ZstdDecompressor().decompress(blob)
        hashes.append(np.frombuffer(body, np.uint64, n))
        lows.append(np.frombuffer(body, np.int64, n, 8 * n))
        ends = np.cumsum(np.frombuffer(body, np.uint16, n, 16 * n), dtype=np.int64) + 18 * n
        strings += [body[a:b] for a, b in zip(np.concatenate([[18 * n], ends[:-1]]).tolist(), ends.tolist(), strict=True)]
    hashes, lows = np.concatenate(hashes), np.concatenate(lows)
    number: dict[bytes, int] = {}
    of = np.array([number.setdefault(s, len(number)) for s in strings], np.int64)
    distinct = list(number)
    low, hash_ = np.full(len(distinct), NO_ID), np.zeros(len(distinct), np.uint64)
    np.minimum.at(low, of, lows)
    hash_[of] = hashes
    windows = np.array([len(x) - LENGTH + 1 for x in distinct], np.int64)
    base = np.cumsum(windows) - windows
    # A window's answer is its string's own, unless other strings share the hash.
    flat = np.repeat(low, windows)
    order = np.argsort(hash_, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], hash_[order][1:] != hash_[order][:-1]]))
    size = np.diff(np.append(first, len(order)))
    first, size = first[size > 1], size[size > 1]
    # Equal windows share a hash, so a block that holds all strings of its hashes is complete.
    block = np.cumsum(size) // BLOCK
    for k in np.split(np.arange(len(first)), np.flatnonzero(np.diff(block)) + 1):
        if len(k):
            at = order[ranges(first[k], size[k])]
            flat[ranges(base[at], windows[at])] = least_ids([distinct[i] for i in at.tolist()], low[at])
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    new[base] = True
    start = np.flatnonzero(new)
    width, ids = np.diff(np.append(start, len(flat))), flat[start]
    begin = np.searchsorted(start, base)
    runs = np.diff(np.append(begin, len(start)))
    data, at = [], 0
    for n in sizes:
        mine = of[at : at + n]
        at += n
        every = ranges(begin[mine], runs[mine])
        data.append(zstandard.ZstdCompressor(level=1).compress(np.int64(len(every)).tobytes() + runs[mine].astype(np.uint8).tobytes() + width[every].astype(np.uint8).tobytes() + ids[every].tobytes()))
    return pa.table({"chunk": sent.column("chunk"), "shard": sent.column("shard"), "kind": pa.array(["answer"] * len(sizes)), "data": pa.array(data, pa.binary())})


def _removed(shards: int, with_text: bool):
    def run(key: tuple, known: pa.Table, mine: pa.Table) -> pa.Table:
        import zstandard

        known = known.to_pylist()
        answers = {r["shard"]: r["data"] for r in known if r["kind"] == "answer"}
        out = []
        for blob in mine.column("docs").to_pylist():
            chunk = Chunk(unpacked(blob))
            docs, starts, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for s, pieces, strings, distinct in _wanted(chunk, [r for r in known if r["kind"] == "met"], shards):
                body, n = zstandard.ZstdDecompressor().decompress(answers[s]), len(distinct)
                m = int(np.frombuffer(body, np.int64, 1)[0])
                counts = np.frombuffer(body, np.uint8, n, 8).astype(np.int64)
                widths = np.frombuffer(body, np.uint8, m, 8 + n).astype(np.int64)
                ids = np.frombuffer(body, np.int64, m, 8 + n + m)
                # Each piece takes the runs of its string.
                run = ranges((np.cumsum(counts) - counts)[strings], counts[strings])
                piece = np.repeat(pieces, counts[strings])
                within = np.cumsum(widths) - widths
                within -= np.repeat(within[np.cumsum(counts) - counts], counts)
                doc, a = chunk.doc[piece], chunk.start[piece] + within[run]
                hit = (ids[run] < chunk.id[doc]) & (chunk.id[doc] != NO_ID)
                docs.append(doc[hit])
                starts.append(a[hit])
                ends.append((a + widths[run] + LENGTH - 1)[hit])
            doc, start, end = map(np.concatenate, (docs, starts, ends))
            # On one line, with a byte between documents, spans that overlap or touch become one.
            base = np.cumsum([0, *(len(x) + 1 for x in chunk.texts)])
            a, b = base[doc] + start, base[doc] + end
            order = np.argsort(a, kind="stable")
            a, b, doc = a[order], np.maximum.accumulate(b[order]), doc[order]
            new = np.flatnonzero(np.concatenate([[True], a[1:] > b[:-1]])) if len(a) else np.zeros(0, np.int64)
            spans: dict[int, list[tuple[int, int]]] = {}
            for d, x, y in zip(doc[new].tolist(), (a[new] - base[doc[new]]).tolist(), (b[np.append(new[1:], len(a)) - 1] - base[doc[new]]).tolist() if len(a) else [], strict=True):
                spans.setdefault(d, []).append((x, y))
            for i, (doc_id, text) in enumerate(zip(chunk.ids, chunk.texts, strict=True)):
                cut = spans.get(i, [])
                kept = b"".join(text[a:b] for a, b in zip([0, *(b for _, b in cut)], [*(a for a, _ in cut), len(text)], strict=True)) if cut else text
                row = {"doc_id": doc_id, "n_bytes": len(text), "n_removed": len(text) - len(kept), "n_spans": len(cut), "kept_sha256": hashlib.sha256(kept).hexdigest()}
                out.append(row | {"spans": [{"start": a, "end": b} for a, b in cut]} if with_text else row)
        return pa.Table.from_pylist(out, schema=_OUT if not with_text else _OUT.append(pa.field("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))))

    return run


_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def remove_repeats(docs: DataFrame, *, with_spans: bool = False, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the removed byte spans): one row for each row of docs."""
    spark = docs.sparkSession
    checkpoint_dir(spark)
    docs = steady(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(24, -(-size // shard_bytes))
    asked = docs.mapInArrow(_asked(shards), "chunk string, shard long, hashes binary, many binary")
    known = "chunk string, shard long, kind string, data binary"
    # Read by two later steps; a bit for each piece.
    met = asked.groupBy("shard").applyInArrow(_met, known).checkpoint()
    chunked = packed(docs, CHUNK_CHARS)
    sent = met.groupBy("chunk").cogroup(chunked.groupBy("chunk")).applyInArrow(_sent(shards), "chunk string, shard long, n long, pieces binary")
    answers = sent.groupBy("shard").applyInArrow(_answered, known)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", spans array<struct<start:long,end:long>>" * with_spans
    return met.unionByName(answers).groupBy("chunk").cogroup(chunked.groupBy("chunk")).applyInArrow(_removed(shards, with_spans), schema)
