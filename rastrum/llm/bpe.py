"""BPE encoding and decoding as streaming transducers (operator 1).

Encoding. A merge list fixes a *sufficient lookahead* L: text beyond position n can
change only tokens that start after n - L. A merge of rank r next to text that differs
can draw in at most its left part, so a chain of changes runs left through merges of
rising rank, each ending where a token that the one before produced may begin;
`sufficient_lookahead` is the longest such chain. Within a word the transducer keeps a
buffer, merges it, emits the tokens that end L or more symbols before its end, and
carries the rest on: a token boundary that is final splits the word into independent
parts. Its memory is one chunk and L symbols, however long a word is. A text comes in
segments, cut at single spaces that no word lies across; every word goes through the
transducer, and the final tokens of short words are remembered.

Decoding. Tokens become bytes and bytes become text through a UTF-8 state machine that
holds at most three bytes (byte-level decoders), or tokens are joined by one space,
which is what a tokenizer file without a decoder means. A document's tokens go segment by
segment into the digest of its ids and through the decoder into that of its text, so that
neither the ids nor the decoded text of a document are ever whole in memory.

Nulls are encoded as empty texts; an empty text has no tokens and decodes to "". Each row is
encoded by itself: null and repeated ids and repeated rows stay as they are; extra columns,
whatever their names, are left out; no documents give no rows.
"""

from __future__ import annotations

import codecs
import hashlib
import itertools
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame

from .common import map_rows, worker_cache

#: Symbols that the transducer takes in at a time, beside its lookahead.
CHUNK = 4096
#: Characters of a segment, up to the next place to cut.
SEGMENT = 65_536
#: Neither a word, nor a special token, nor a composed character lies across the place before this space.
CUT = re.compile(r"(?<=[!-~])\x20(?=[!-~])")
#: Words kept with their tokens; the older half goes when it is full.
CACHED_WORDS = 800_000


#: What the pattern of lower-casing files says of ASCII text.
ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+", re.ASCII)
#: Bits of a token's id; a rank over all others.
BITS = 24
NO_MERGE = 1 << 60


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return [chr(b) if b in set(plain) else chr(256 + rest.index(b)) for b in range(256)]


def newer_letters() -> tuple[str, str]:
    """Two character classes of code points unknown to Python's Unicode tables.

    The first holds all that the installed `regex` calls letters or numbers, the second
    those of them that the tokenizer library's engine doesn't.
    """
    import regex
    from tokenizers import Regex, pre_tokenizers

    def named(points: list[int]) -> str:
        runs: list[list[int]] = []
        for c in points:
            if runs and runs[-1][1] == c - 1:
                runs[-1][1] = c
            else:
                runs.append([c, c])
        return "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs) + "]" if runs else r"[\U0000fdd0]"

    found = [c for c in regex.findall(r"[\p{L}\p{N}]", "".join(map(chr, (*range(0x80, 0xD800), *range(0xE000, 0x110000))))) if unicodedata.category(c) == "Cn"]
    known = {c for c, _ in pre_tokenizers.Split(Regex(r"\p{L}|\p{N}"), "removed", invert=True).pre_tokenize_str("".join(found))}
    return named([ord(c) for c in found]), named([ord(c) for c in found if c not in known])


def sufficient_lookahead(merges: list[tuple[str, str]]) -> int:
    """Symbols of lookahead after which a token can't change, by dynamic programming over ranks.

    reach[u] is the longest chain of merges so far whose last one starts with a token u.
    A merge (u, v) extends chains that start at a prefix of v, or begins one. One more
    symbol is added, as a word's last symbol carries the end-of-word mark.
    """
    reach: dict[str, int] = {}
    for left, right in merges:
        best = max((reach.get(right[:i], 0) for i in range(1, len(right) + 1)), default=0)
        if best + len(left) > reach.get(left, 0):
            reach[left] = best + len(left)
    return 1 + max(reach.values(), default=0)


class BpeCodec:
    """Encoder and decoder for a public tokenizer file (`model.type` BPE, byte-level symbols)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("byte_fallback") or model.get("continuing_subword_prefix") or spec.get("post_processor"):
            raise ValueError(f"{path}: not a plain byte-level BPE file")
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        # A pair's rank and what it becomes, in one integer.
        self.pairs = {(self.vocab[a], self.vocab[b]): r << BITS | self.vocab[a + b] for r, (a, b) in enumerate(self.merges)}
        self.lookahead = sufficient_lookahead([(a, b.removesuffix(self.suffix) if self.suffix else b) for a, b in self.merges])
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError(f"{path}: such added tokens aren't supported")
        every = self.vocab | self.specials
        if any(" " in t for t in self.specials):
            raise ValueError(f"{path}: special tokens with a space aren't supported")
        self.names = [""] * (1 + max(every.values()))
        for t, i in every.items():
            self.names[i] = t
        self.digits = [str(i) for i in range(len(self.names))]
        self.number = list(range(len(self.names)))  # one object for each id
        self.byte_level = (spec.get("decoder") or {}).get("type") == "ByteLevel"
        if spec.get("decoder") and not self.byte_level:
            raise ValueError(f"{path}: unknown decoder")
        self.lower = spec.get("normalizer") is not None
        symbols = byte_symbols()
        self.symbol = [self.vocab.get(s, -1) for s in symbols]
        self.last = [self.vocab.get(s + self.suffix, -1) for s in symbols]
        self.byte_of = {s: b for b, s in enumerate(symbols)}
        if self.byte_level:
            special = set(self.specials.values())
            self.bytes_of = [t.encode() if i in special else bytes(self.byte_of[c] for c in t) for i, t in enumerate(self.names)]
        self.length = {i: len(t.removesuffix(self.suffix) if self.suffix else t) for t, i in self.vocab.items()}
        import regex

        # The file's pattern; white space is named by its Unicode property, as in the library's engine.
        # Texts with characters newer than some engine's tables take a pattern that names the difference.
        def pattern(letter: str, number: str, other: str, s: str = r"\p{White_Space}"):
            return regex.compile(
                rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d|{letter}+|{number}|{other}+"
                if self.lower
                else rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{number}+| ?{other}+|{s}+(?!\P{{White_Space}})|{s}+"
            )

        newer, unknown = newer_letters()
        self.newer = regex.compile(newer)
        self.words = pattern(r"\p{L}", r"\p{N}", r"[^\p{White_Space}\p{L}\p{N}]")
        self.words_newer = pattern(rf"[\p{{L}}--{unknown}]", rf"[\p{{N}}--{unknown}]", rf"[[^\p{{White_Space}}\p{{L}}\p{{N}}]||{unknown}]")
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def split(self, text: str) -> list[str]:
        """The words of a text, normalised if the file says so."""
        if self.lower and text.isascii():
            return ASCII_WORDS.findall(text.lower())
        newer = not text.isascii() and self.newer.search(text)
        if self.lower and newer:
            from tokenizers import normalizers

            text = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]).normalize_str(text)
        elif self.lower:
            text = unicodedata.normalize("NFC", text)
            # Lower case is taken character by character: a final sigma is no exception.
            text = (text.replace("Σ", "σ") if "Σ" in text else text).lower()
        return (self.words_newer if newer else self.words).findall(text)

    def merge(self, ids: list[int]) -> list[int]:
        """The merges of the list, lowest rank first and leftmost first within a rank. Changes ids."""
        get = self.pairs.get
        if len(ids) > 256:
            return self._merge_long(ids)
        ranks = [get(p, NO_MERGE) for p in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == NO_MERGE:
                break
            i = ranks.index(best)
            del ranks[i], ids[i + 1]
            ids[i] = best & ((1 << BITS) - 1)
            if i:
                ranks[i - 1] = get((ids[i - 1], ids[i]), NO_MERGE)
            if i < len(ranks):
                ranks[i] = get((ids[i], ids[i + 1]), NO_MERGE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same, all places of a rank in one pass."""
        get = self.pairs.get
        while len(ids) > 1:
            best = min(get(p, NO_MERGE) for p in zip(ids, ids[1:]))
            if best == NO_MERGE:
                break
            out, i, n = [], 0, len(ids)
            while i < n:
                if i + 1 < n and get((ids[i], ids[i + 1])) == best:
                    out.append(best & ((1 << BITS) - 1))
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    def transduce(self, data: Iterable[bytes]) -> Iterator[int]:
        """Tokens of one word that comes in pieces, each emitted once no later byte can change it."""
        held: list[int] = []
        pending: int | None = None  # the last byte, which may carry the end-of-word mark
        symbol, number = self.symbol, self.number
        for piece in data:
            for a in range(0, len(piece), CHUNK):
                part = piece[a : a + CHUNK]
                if pending is not None:
                    held.append(symbol[pending])
                held += [symbol[b] for b in part[:-1]]
                pending = part[-1]
                if len(held) >= CHUNK + self.lookahead:
                    at = 0
                    for token in self.merge(held[:]):
                        if at + self.length[token] > len(held) - self.lookahead:
                            break
                        at += self.length[token]
                        yield number[token]
                    held = held[at:]
        if pending is not None:
            held.append(self.last[pending])
            yield from map(number.__getitem__, self.merge(held))

    def _new_word(self, word: str) -> Iterable[int]:
        """Tokens of a word that isn't among the young ones; short words are remembered."""
        if len(word) > 64:
            return self.transduce([word.encode("utf-8", "surrogatepass")])
        got = self.old.get(word) or tuple(self.transduce([word.encode("utf-8", "surrogatepass")]))
        if len(self.young) >= CACHED_WORDS // 2:
            self.old, self.young = self.young, {}
        self.young[word] = got
        return got

    def segments(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > SEGMENT and (cut := CUT.search(text, at + SEGMENT)):
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:]

    def encode_stream(self, text: str) -> Iterator[list[int]]:
        """Tokens of a text, some thousands at a time."""
        ids: list[int] = []
        for segment in self.segments(text):
            for k, part in enumerate(self.special.split(segment) if self.special else [segment]):
                if k % 2:
                    ids.append(self.specials[part])
                    continue
                get = self.young.get
                for word in self.split(part) if part else ():
                    got = get(word)
                    if got is None:
                        got = self._new_word(word)
                        get = self.young.get
                        if len(word) > CHUNK:
                            # Tokens of a very long word are handed on as they come.
                            for some in itertools.batched(got, CHUNK):
                                ids += some
                                yield ids
                                ids = []
                            continue
                    ids += got
            yield ids
            ids = []

    def encode(self, text: str) -> list[int]:
        return [i for ids in self.encode_stream(text) for i in ids]

    def decode_stream(self, parts: Iterable[Iterable[int]]) -> Iterator[str]:
        """Text of tokens that come in parts, as far as each part settles it; special tokens are kept."""
        if self.byte_level:
            machine = codecs.getincrementaldecoder("utf-8")("replace")
            for ids in parts:
                yield machine.decode(b"".join(map(self.bytes_of.__getitem__, ids)))
            yield machine.decode(b"", final=True)
            return
        before = ""
        for ids in parts:
            if ids:
                yield before + " ".join(map(self.names.__getitem__, ids))
                before = " "

    def decode(self, ids: Iterable[int]) -> str:
        return "".join(self.decode_stream([ids]))

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """Number of tokens, SHA-256 of the ids, SHA-256 of the text that the ids decode to."""
        of_ids, of_text, n = hashlib.sha256(), hashlib.sha256(), 0

        def told() -> Iterator[list[int]]:
            nonlocal n
            for ids in self.encode_stream(text or ""):
                if ids:
                    of_ids.update(((" " if n else "") + " ".join(map(self.digits.__getitem__, ids))).encode())
                    n += len(ids)
                    yield ids

        for piece in self.decode_stream(told()):
            of_text.update(piece.encode("utf-8", "surrogatepass"))
        return n, of_ids.hexdigest(), of_text.hexdigest()


def codec(path: str) -> BpeCodec:
    cache = worker_cache("bpe")
    if ("bpe", path) not in cache:
        cache[("bpe", path)] = BpeCodec(path)
    return cache[("bpe", path)]


def encode_documents(docs: DataFrame, path: str, *, with_ids: bool = False) -> DataFrame:
    """Encode and decode each whole text: doc_id, n_tokens, ids_sha256, decoded_sha256, and ids if asked for.

    One row for each row of docs, repeated ids included; other columns are left out.
    """

    def one(doc_id, text):
        n, ids, decoded = codec(path).digest(text)
        return (doc_id, n, ids, decoded, codec(path).encode(text or "")) if with_ids else (doc_id, n, ids, decoded)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return map_rows(docs, ["doc_id", "text"], one, schema)
