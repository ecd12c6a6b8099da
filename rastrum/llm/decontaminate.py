"""Benchmark decontamination with one Aho-Corasick automaton (operator 8).

Words are what common.words_of gives. A window is 10 consecutive words of an item, or all
words of a shorter one that has any. The automaton's letters are the benchmark's words,
numbered; a text is scanned once as the numbers of its words (0 for any other word), and a
match ends at a word, whose number leads to offsets in the original text.

An automaton takes some hundred bytes a word of its windows, so the benchmark is measured
before any of it moves. Up to `most_words` words go into one automaton; a longer benchmark
is taken in blocks of whole items, each with an automaton and a scan of its own, so that a
task's memory does not grow with it. The benchmark is the stated query set.

Null and empty texts have no words and are clean; items without words are in no window;
repeated items each count; null item ids are left out. Each row of the documents is judged
by its own text, whatever its id: null and repeated ids, repeated rows and extra columns
(whatever their names) change nothing. No documents give no rows, no items no hits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_TABLE, release_memory, words_of, worker_cache

WINDOW = 10
#: Words of benchmark text that one automaton takes.
MOST_WORDS = 1_000_000


def windows(words: list[bytes], size: int = WINDOW) -> list[tuple[bytes, ...]]:
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []


class Automaton:
    """The windows of some items; value: number of words and the items that hold the window."""

    def __init__(self, items: list[tuple[str, str]], size: int = WINDOW):
        import ahocorasick

        self.number: dict[bytes, int] = {}
        held: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            for w in windows(words_of(text), size):
                held.setdefault(tuple(self.number.setdefault(x, len(self.number) + 1) for x in w), set()).add(item)
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for w, ids in held.items():
            self.machine.add_word(w, (len(w), sorted(ids)))
        if held:
            self.machine.make_automaton()
        self.empty = not held

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Runs [first, end) of hit words, disjoint and in order, and the items with occurring windows."""
        items: set[str] = set()
        if self.empty or not words:
            return [], items
        get, runs = self.number.get, []
        numbers = tuple([get(w, 0) for w in words])
        for end, (n, ids) in self.machine.iter(numbers) if any(numbers) else ():
            items.update(ids)
            runs.append((end + 1 - n, end + 1))
        return merged(runs), items


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs that overlap or touch as one, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


def word_spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code-point offsets in the original text of runs of words, from first letter to last."""
    if not runs:
        return []
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    clear = np.frombuffer(WORD_TABLE, np.uint8)[data] == 32
    edge = np.diff(np.concatenate([[1], clear, [1]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    # Continuation bytes begin no code point.
    point = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return [(int(point[starts[a]]), int(point[ends[b - 1]])) for a, b in runs]


def _blocks(items: Iterator[tuple[str, str]], most: int) -> Iterator[list[tuple[str, str]]]:
    block, n = [], 0
    for item, text in items:
        k = len(words_of(text))
        if block and n + k > most:
            yield block
            block, n = [], 0
        block.append((item, text))
        n += k
    yield block


def _scanner(key: str, block: list[tuple[str, str]], size: int) -> Automaton:
    cache = worker_cache("automaton")
    if cache.get("key") != (key, size):
        cache["key"], cache["automaton"] = (key, size), Automaton(block, size)
    return cache["automaton"]


def _scanned(docs: DataFrame, benchmark: DataFrame, size: int, most_words: int, finish, schema: str) -> DataFrame:
    """Scans the text of each row; its other columns are carried. finish(batch, found) makes what comes out, found being (words, runs, items) a row."""
    spark = docs.sparkSession
    items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("string"), "text")
    # One block at a time is on the driver; each is a broadcast of bounded size.
    shared = [(hashlib.sha256(repr(b).encode("utf-8", "surrogatepass")).hexdigest(), spark.sparkContext.broadcast(b)) for b in _blocks((tuple(r) for r in items.toLocalIterator()), most_words)]
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                words = [words_of(t) for t in part.column(at).to_pylist()]
                found = [(len(w), [], set()) for w in words]
                for key, block in shared:
                    scan = _scanner(key, block.value, size).scan
                    for k, w in enumerate(words):
                        runs, ids = scan(w)
                        if runs:
                            found[k] = found[k][0], merged([*found[k][1], *runs]), found[k][2] | ids
                yield finish(part, found)
        release_memory()

    return docs.mapInArrow(run, schema)


def find_hits(docs: DataFrame, benchmark: DataFrame, *, size: int = WINDOW, most_words: int = MOST_WORDS) -> DataFrame:
    """doc_id, n_words, runs of hit words, their code-point spans, item ids: one row for each row of docs."""
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def finish(part, found):
        texts = part.column(1).to_pylist()
        pair = lambda names, pairs: [dict(zip(names, p, strict=True)) for p in pairs]
        return pa.RecordBatch.from_arrays(
            [
                part.column(0), pa.array([n for n, _, _ in found], pa.int64()), pa.array([pair(("first", "end"), runs) for _, runs, _ in found], pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))),
                pa.array([sorted(ids) for *_, ids in found], pa.list_(pa.string())), pa.array([pair(("start", "end"), word_spans(t or "", runs)) for t, (_, runs, _) in zip(texts, found, strict=True)], spans),
            ],
            names=["doc_id", "n_words", "runs", "items", "spans"],
        )

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _scanned(docs, benchmark, size, most_words, finish, "doc_id long, n_words long, runs array<struct<first:int,end:int>>, items array<string>, spans array<struct<start:int,end:int>>")


def contamination(docs: DataFrame, benchmark: DataFrame, *, size: int = WINDOW, most_words: int = MOST_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: one row for each row of docs."""

    def finish(part, found):
        n_hit = [sum(b - a for a, b in runs) for _, runs, _ in found]
        digest = [hashlib.sha256(",".join(sorted(ids)).encode("utf-8", "surrogatepass")).hexdigest() for *_, ids in found]
        return pa.RecordBatch.from_arrays(
            [part.column(0), pa.array([n for n, _, _ in found], pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(ids) for *_, ids in found], pa.int64()), pa.array(digest), pa.array([n > 0 for n in n_hit], pa.bool_())],
            names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        )

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _scanned(docs, benchmark, size, most_words, finish, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, size: int = WINDOW, most_words: int = MOST_WORDS) -> DataFrame:
    """The rows of docs without a hit word; columns as they are."""
    return _scanned(docs, benchmark, size, most_words, lambda part, found: part.filter(pa.array([not runs for _, runs, _ in found], pa.bool_())), docs.schema)
