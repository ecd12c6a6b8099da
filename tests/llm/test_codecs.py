import hashlib
import random

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rastrum.llm import bpe, token_counts

WORD, BYTE = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, ids string"
TEXTS = [None, "", " \n\t", "Hello, world's ÉTÉ Σς 12 <|endoftext|> x<|startoftext|>", "a" * 20_000, "Straße İstanbul \u0558ab \U0001f600\U0001f600", "日本語のテキスト" * 400, "don't 'LL we'RE", "tie tie", "tie tie"]


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_codec_equals_the_library(path):
    mine, theirs, rng = bpe.BpeCodec(path), Tokenizer.from_file(path), random.Random(5)
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice("aabehinrst'  ÉΣσςéé1٣\n_-<|>%") for _ in range(rng.randrange(60))) for _ in range(500)]
    for t in texts:
        ids = theirs.encode(t, add_special_tokens=False).ids
        assert mine.encode(t) == ids
        assert mine.decode(ids) == theirs.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_transducer_emits_only_what_stays(path, monkeypatch):
    """With the smallest chunks the stream still gives what the whole word gives."""
    codec, rng = bpe.BpeCodec(path), random.Random(9)
    for alphabet in ("ab", "a", "th", "aehint", "ing"):
        word = "".join(rng.choice(alphabet) for _ in range(3 * codec.lookahead)).encode()
        whole = codec.merge([*(codec.symbol[b] for b in word[:-1]), codec.last[word[-1]]])
        monkeypatch.setattr(bpe, "CHUNK", 8)
        assert list(codec.transduce(word[i : i + 7] for i in range(0, len(word), 7))) == whole
        monkeypatch.undo()


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_digests_of_streams_are_those_of_whole_texts(path, monkeypatch):
    """Short segments, chunks and few remembered words: ids and text are still the library's, and both came through the streams."""
    codec, theirs, rng = bpe.BpeCodec(path), Tokenizer.from_file(path), random.Random(15)
    monkeypatch.setattr(bpe, "SEGMENT", 20)
    monkeypatch.setattr(bpe, "CHUNK", 8)
    monkeypatch.setattr(bpe, "CACHED_WORDS", 10)
    words = ["the", "ing ", "é ", " ", "\n", "<|endoftext|>", "日本", "x" * 90, "Σ", "it's ", "1 2", "e\u0301 ", " \u0301", "\U0001f600"]
    for _ in range(200):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(40)))
        ids = theirs.encode(text, add_special_tokens=False).ids
        assert codec.digest(text) == (len(ids), sha(" ".join(map(str, ids))), sha(theirs.decode(ids, skip_special_tokens=False)))
        parts = [ids[i : i + 3] for i in range(0, len(ids), 3)]
        assert "".join(codec.decode_stream(parts)) == theirs.decode(ids, skip_special_tokens=False)
    calls = []
    real = codec.transduce
    monkeypatch.setattr(codec, "transduce", lambda data: calls.append(1) or real(data))
    codec.digest("brandnewword")
    assert calls


def test_newer_and_older_characters_agree_with_the_library():
    mine, theirs = bpe.BpeCodec(WORD), Tokenizer.from_file(WORD)
    points = [*range(1, 0x3000), *range(0xA000, 0xD800), *range(0xE000, 0x11000), *range(0x1E000, 0x1F000)]
    for c in points:
        assert mine.encode(f"a{chr(c)}b") == theirs.encode(f"a{chr(c)}b", add_special_tokens=False).ids, hex(c)


def test_encode_documents(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumn("n_tokens", F.lit("clash"))
    got = {r.doc_id: r for r in bpe.encode_documents(docs, WORD, with_ids=True).collect()}
    theirs = Tokenizer.from_file(WORD)
    for i, t in enumerate(TEXTS):
        e = theirs.encode(t or "", add_special_tokens=False).ids
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].ids) == (len(e), sha(" ".join(map(str, e))), e)
        assert got[i].decoded_sha256 == sha(theirs.decode(e, skip_special_tokens=False))
    assert bpe.encode_documents(docs.limit(0), WORD).count() == 0


def test_spliced_counts_equal_whole_counts():
    tok, rng = token_counts.tokenizer(BYTE), random.Random(3)
    for k in range(120):
        words = ["the", " and", "  ", "\n\n", "ing", "<|endoftext|>", "1234", "'s", "%%%", "日本", " " * rng.randrange(90), "x" * rng.randrange(200)]
        text = "".join(rng.choice(words) for _ in range(400))
        assert token_counts.spliced_count(tok, text, chunk=97 + k, overlap=40) == len(tok.encode(text, add_special_tokens=False).ids)


def test_counts_of_odd_tables(spark):
    rows = [(1, "a b", 7), (1, "a b", 7), (None, "a b", 8), (2, None, None), (2, "", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long").withColumn("over_limit", F.lit("x"))
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(df, BYTE).collect())
    assert got == [("1", 3, 2, False), ("1", 3, 2, False), ("2", 0, 0, False), ("2", 0, 0, False), ("None", 3, 2, False)]
    assert token_counts.count_tokens(df.limit(0), BYTE).count() == 0
    one = "x" * 50_000
    tok = Tokenizer.from_file(BYTE)
    assert token_counts.spliced_count(tok, one + " y", 1000, 50) == len(tok.encode(one + " y", add_special_tokens=False).ids)


def test_counts_of_documents(spark):
    texts = [*TEXTS, "word " * 30_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tok = Tokenizer.from_file(BYTE)
    for r in token_counts.count_tokens(docs, BYTE, chunk=5000, overlap=300).collect():
        t = texts[r.doc_id] or ""
        n = len(tok.encode(t, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 1024)
