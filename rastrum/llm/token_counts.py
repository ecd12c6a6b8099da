"""Token counts by overlap resynchronisation (operator 7).

Texts up to `chunk` characters are encoded whole. Longer ones are encoded in overlapping
chunks with offsets, and neighbours are spliced at a common word boundary of the
pre-tokenizer. Such a boundary p is proven stable when it lies `margin` characters or
more before the left chunk's end: the pre-tokenizer's pattern looks one character ahead,
special tokens are no longer than the margin, and from p on both chunks see the same
text, so their tokens agree from there. Where no boundary is shared (one word longer
than the overlap), the left chunk is widened, at last to the end of the text.

Nulls count as empty texts; an empty text has no tokens. Each row is counted by itself: null and
repeated ids and repeated rows stay as they are; extra columns, whatever their names, are left
out; no documents give no rows. Memory is that of a chunk's tokens, but for a single word longer
than the overlap, for which the left chunk grows to hold it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import release_memory, worker_cache

CHUNK, OVERLAP = 32_768, 512


def tokenizer(path: str):
    cache = worker_cache("tokenizer")
    if ("tokenizer", path) not in cache:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        cache[("tokenizer", path)] = t
    return cache[("tokenizer", path)]


def boundaries(encoding, base: int) -> dict[int, int]:
    """Offsets at which a word of the pre-tokenizer begins, each with its token's index."""
    words, offsets, found = encoding.word_ids, encoding.offsets, {}
    for i, (start, _) in enumerate(offsets):
        if i == 0 or words[i] is None or words[i] != words[i - 1]:
            found.setdefault(base + start, i)
    return found


def spliced_count(tok, text: str, chunk: int = CHUNK, overlap: int = OVERLAP, margin: int | None = None) -> int:
    """Number of tokens of a text, encoded chunk by chunk."""
    if len(text) <= chunk:
        return len(tok.encode(text, add_special_tokens=False).ids)
    if margin is None:
        margin = 2 + max([1, *(len(t.content) for t in tok.get_added_tokens_decoder().values())])
    start, end, total = 0, chunk + overlap, 0
    left = tok.encode(text[start:end], add_special_tokens=False)
    first = 0  # index in `left` of the first token that isn't counted yet
    while end < len(text):
        wide = overlap
        while True:
            begin = end - wide
            # The right chunk reaches far beyond the left one's end, so that it is stable there too.
            right_end = min(len(text), end + chunk)
            right = tok.encode(text[begin:right_end], add_special_tokens=False)
            mine, theirs = boundaries(left, start), boundaries(right, begin)
            shared = [p for p in mine.keys() & theirs.keys() if begin < p <= end - margin and mine[p] >= first]
            if shared:
                p = max(shared)
                total += mine[p] - first
                start, end, left, first = begin, right_end, right, theirs[p]
                break
            # No common stable boundary: the left chunk grows, and the next overlap with it.
            wide *= 2
            end = min(len(text), end + wide)
            left = tok.encode(text[start:end], add_special_tokens=False)
            if end == len(text):
                break
    return total + len(left.ids) - first


def count_tokens(docs: DataFrame, path: str, *, limit: int = 1024, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs, repeated ids included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tok = tokenizer(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [t or "" for t in part.column(1).to_pylist()]
                counts = [0] * len(texts)
                short = [i for i, t in enumerate(texts) if len(t) <= chunk]
                for i, e in zip(short, tok.encode_batch_fast([texts[i] for i in short], add_special_tokens=False), strict=True):
                    counts[i] = len(e.ids)
                for i, t in enumerate(texts):
                    if len(t) > chunk:
                        counts[i] = spliced_count(tok, t, chunk, overlap)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts])],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )
        release_memory()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
