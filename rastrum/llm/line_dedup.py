"""Line dedup by winnowing over line hashes (operator 2).

A run of RUN or more consecutive lines (or of fewer that hold LONG_WORDS words or more) that
stands earlier, in a document with a smaller id or further up in the same one, is deleted;
its first occurrence stays. Blank lines are passed over, and go if they lie inside a run;
other lines are compared without the white space about them.

Fingerprints are the least line hash (the last of equal ones) of each window of RUN lines,
so any two copies of a run select the same ones; shorter runs of many words are windows
of their own. Only fingerprints that two places hold are joined by position: each carries 128-bit
digests of the windows that selected it, and a window that also starts earlier is a match of a later
place with that window's first. Matches are extended both ways a line at a time: a match goes on
by a line exactly if the next window, one line further, is a match too, so marked windows
that overlap or touch make up the run, however long it is. What is
compared is each digest's first place, kept by a partial minimum, so a line or passage that
many documents share is never paired with itself, and its copies may have as many contexts as they like.

Null texts stay null, empty ones empty; rows without an id are left as they are. Rows
that share an id and a text are copies that stay, as neither is earlier; a text that loses all
its lines becomes empty. without_repeats carries all columns; a column called n_chars is taken for the
text's length and set anew, names that begin with two underscores are its own. No documents give no rows. A text's lines are
held as a whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint_dir, release_memory, worker_cache

RUN, LONG_WORDS = 3, 50


def lines_of(text: str) -> tuple[list[str], list[int]]:
    """The lines of a text, and the numbers of those that aren't blank."""
    lines = text.split("\n")
    return lines, [i for i, x in enumerate(lines) if x and not x.isspace()]


def fingerprints(text: str) -> Iterator[tuple[int, int, list[tuple[int, int, bytes]]]]:
    """Selected lines: place among the non-blank ones, hash, and the windows (first, lines, digest) that selected each."""
    import xxhash

    lines, solid = lines_of(text)
    stripped = [lines[i].strip() for i in solid]
    digests = [xxhash.xxh3_128_digest(x.encode("utf-8", "surrogatepass")) for x in stripped]
    hashes = [int.from_bytes(d[:8], "little", signed=True) for d in digests]
    held: dict[int, list[tuple[int, int, bytes]]] = {}
    for i in range(len(solid) - RUN + 1):
        at = max(range(i, i + RUN), key=lambda j: (-hashes[j], j))
        held.setdefault(at, []).append((i, RUN, xxhash.xxh3_128_digest(b"".join(digests[i : i + RUN]))))
    words = [len(x.split()) for x in stripped]
    for n in range(1, RUN):
        for i in range(len(solid) - n + 1):
            if sum(words[i : i + n]) >= LONG_WORDS:
                at = max(range(i, i + n), key=lambda j: (-hashes[j], j))
                held.setdefault(at, []).append((i, n, xxhash.xxh3_128_digest(b"".join(digests[i : i + n]))))
    for at, windows in held.items():
        yield at, hashes[at], windows


_ROWS = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("print", pa.int64()), ("windows", pa.list_(pa.struct([("at", pa.int32()), ("lines", pa.int32()), ("digest", pa.binary())])))])


def _printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    worker_cache("line_dedup")
    for batch in batches:
        for a in range(0, batch.num_rows, 512):
            part = batch.slice(a, 512)
            rows = [(d, m, h, [dict(zip(("at", "lines", "digest"), w, strict=True)) for w in windows]) for d, m, t in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True) for _, h, windows in fingerprints(t)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ROWS, strict=True)], schema=_ROWS)
    release_memory()


def repeated_runs(docs: DataFrame) -> DataFrame:
    """doc_id, mark (hash of the text), windows: the windows (first, lines) to delete, for texts that have any."""
    checkpoint_dir(docs.sparkSession)
    marked = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
    # Read three times below; some bytes for each line.
    prints = marked.mapInArrow(_printed, "doc_id long, mark long, print long, windows array<struct<at:int,lines:int,digest:binary>>").checkpoint()
    twice = prints.groupBy("print").agg(F.count("*").alias("n")).where("n > 1").select("print")
    windows = prints.join(twice, "print", "left_semi").select("doc_id", "mark", F.inline("windows"))
    place = F.struct("doc_id", "at")
    first = windows.groupBy("digest", "lines").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last").select("digest", "lines", "first")
    later = windows.join(first, ["digest", "lines"]).where(place > F.col("first"))
    return later.groupBy("doc_id", "mark").agg(F.collect_set(F.struct("at", "lines")).alias("windows"))


def cut(text: str, windows: list) -> tuple[str, int, int, int]:
    """The text without the lines of the windows; its lines, lines deleted, runs deleted."""
    lines, solid = lines_of(text)
    drop = np.zeros(len(lines), bool)
    for w in windows:
        drop[solid[w["at"]] : solid[w["at"] + w["lines"] - 1] + 1] = True
    runs = int(np.count_nonzero(drop & ~np.concatenate([[False], drop[:-1]])))
    kept = "\n".join(x for x, d in zip(lines, drop.tolist(), strict=True) if not d)
    return kept, len(lines), int(drop.sum()), runs


def _cuts(columns: list[str], out: pa.Schema, report: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                texts = part.column(columns.index("text")).to_pylist()
                done = [(t, 0 if not t else t.count("\n") + 1, 0, 0) if not w else cut(t, w) for t, w in zip(texts, part.column(part.num_columns - 1).to_pylist(), strict=True)]
                if report:
                    digest = [hashlib.sha256((k or "").encode("utf-8", "surrogatepass")).hexdigest() for k, *_ in done]
                    arrays = [part.column(0), *(pa.array([d[i] for d in done], pa.int64()) for i in (1, 2, 3)), pa.array(digest)]
                else:
                    arrays = [pa.array([d[0] for d in done], out.field(i).type) if c == "text" else pa.array([len(d[0]) if d[2] else n for d, n in zip(done, part.column(i).to_pylist(), strict=True)], out.field(i).type) if c == "n_chars" else part.column(i) for i, c in enumerate(columns)]
                    arrays.append(pa.array([bool(d[2]) and not d[0].strip() for d in done]))
                yield pa.RecordBatch.from_arrays(arrays, schema=out)
        release_memory()

    return run


def _with_windows(docs: DataFrame) -> DataFrame:
    """docs and, as its last column, the windows to delete."""
    runs = repeated_runs(docs).withColumnsRenamed({"doc_id": "__doc", "mark": "__mark", "windows": "__windows"})
    joined = docs.join(runs.hint("shuffle_hash"), (docs["doc_id"] == runs["__doc"]) & (F.xxhash64(docs["text"]) == runs["__mark"]), "left")
    return joined.drop("__doc", "__mark")


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, n_runs, kept_sha256: one row for each row of docs."""
    out = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_removed", pa.int64()), ("n_runs", pa.int64()), ("kept_sha256", pa.string())])
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _with_windows(docs).mapInArrow(_cuts(docs.columns, out, True), "doc_id long, n_lines long, n_removed long, n_runs long, kept_sha256 string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with repeated runs deleted and n_chars as it then is; a document of which nothing is left goes."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import BooleanType, StructType

    schema = StructType([*docs.schema.fields]).add("__gone", BooleanType())
    return _with_windows(docs).mapInArrow(_cuts(docs.columns, to_arrow_schema(schema), False), schema).where("NOT __gone").drop("__gone")
