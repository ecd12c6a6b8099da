"""Secret scans by assignment-aware lexing (operator 3).

Base spans, leftmost and non-overlapping within a kind (offsets are code points, ends
exclusive): `assign`, `access`, `hex`, see BASE. The method adds spans of kind `literal`.

Lexing. A text that names something sensitive is cut into tokens: strings (with prefixes, escapes,
triple quotes), comments, markup tags, names, URLs, operators, line breaks with their
indentation. A quote inside a word opens no string, and what looks like code inside a string is none.

Pairs. What stands left of `=`, `:=`, `:`, `=>` or `+=` (a name, a string key, a subscript, a
name with its type) is a target, what stands right of it is a value: strings, names and
calls joined by concatenation, a bare word, or an indented block after `|` or `>`. So are
an element and its text, `key="..." value="..."` in a tag, and two arguments
`("name", value)` of a call; the password in a URL's user part has the target `password`.

Constants. A name that a value holds stands for all that it is bound to, wherever in its
scope or around it: functions (by indentation or braces) and comments have scopes of their
own. A literal takes the score of the most sensitive target that it reaches, found as a
fixpoint over these links, times its own strength. Placeholders and plain words are no secrets.

Nulls are empty texts. Each row is read by itself: null and repeated ids and repeated rows
stay as they are; extra columns, whatever their names, are left out; no documents give no
rows. Time and memory grow with a text's length, however long its names, lines and literals.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from .common import map_rows

#: Pattern, group whose length counts, least length; letters of `assign`'s names in either case (ASCII).
BASE = (
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]{24,}"), 0, 24),
)
KINDS = {k: i for i, k in enumerate(["assign", "access", "hex", "literal"])}
#: How much a part of a target's name says that its value is secret.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9,
    "privatekey": 1.0, "accesskey": 1.0, "authorization": 0.8, "auth": 0.6, "key": 0.5, "pass": 0.7, "bearer": 0.8, "cookie": 0.5, "salt": 0.5, "signature": 0.5,
}
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|change_?me|example.*|your[_-].*|none|null|true|false|todo|test|dummy|placeholder|<.*>|\$\{.*\}|%\(.*\)s|\{\{.*\}\})$")
LEAST_SCORE, LEAST_STRENGTH = 0.6, 0.6
#: A literal of more words is prose.
PHRASE_WORDS = 8

_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_TOKEN = re.compile(
    r"""
    (?P<newline>\n[\x20\t]*)
  | (?P<space>[\x20\t\r\f\v]+|\\\r?\n)
  | (?P<url>[A-Za-z][A-Za-z0-9+.\-]{0,30}://[^\s"'<>`]*)
  | (?P<triple>(?<!\w)[rRbBuUfF]{0,2}(?:\"\"\"|'''))
  | (?P<string>(?<!\w)[rRbBuUfF]{0,2}(?:"[^"\\\n]*(?:\\.[^"\\\n]*)*"|'[^'\\\n]*(?:\\.[^'\\\n]*)*'|`[^`\n]*`))
  | (?P<comment>(?:(?<=\s)|(?<=^))(?:\#|//|--\x20)|;;|/\*|<!--)
  | (?P<tag></?[A-Za-z][\w:.\-]*(?:\s+[\w:.\-]+\s*=\s*(?:"[^"<>]*"|'[^'<>]*'))*\s*/?>)
  | (?P<name>[^\W\d][\w$]*(?:(?:\.|->|::|-)[^\W\d][\w$]*)*|\$\{?[^\W\d]\w*\}?)
  | (?P<op>:=|=>|\+=|\?=|[=!<>]=|\|\||\.\.|->|[^\w\s])
  | (?P<other>\w+|\S)
    """,
    re.VERBOSE | re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""([\w:.\-]+)\s*=\s*(?:"([^"<>]*)"|'([^'<>]*)')""")
_TAG = re.compile(r"<([A-Za-z][\w:.\-]*)")
_BARE = re.compile(r"""[\x20\t]*([^\s"'`,;()\[\]{}<>]+)""")
_REFERENCE = re.compile(r"[&*]?\$?\{?([^\W\d][\w$]*(?:[.\-][\w$]+)*)\}?")
_INSIDE = re.compile(r"\$?\{([^\W\d]\w*)\}|\$([^\W\d]\w*)")
_KEY = re.compile(r"[\w$.:\- ]+")
_USERINFO = re.compile(r"://[^\s/?#@:]*:([^\s/?#@:]+)@")
_BLOCK = re.compile(r"[\x20\t]*[|>][+\-0-9]*[\x20\t]*\r?\n")
_ASSIGN = {"=", ":=", ":", "=>", "+=", "?="}
_CONCAT = {"+", ".", "..", "||", "&", "%"}
_CONTROL = {"if", "for", "while", "switch", "catch", "with", "else", "do", "try", "match", "select", "unless", "until"}
_FUNCTION = {"def", "function", "func", "fn", "sub"}
_KEY_ATTRIBUTES, _VALUE_ATTRIBUTES = {"key", "name", "id"}, {"value", "val"}
_TYPES = {"string", "str", "bytes", "var", "auto", "char", "text"}

Span = tuple[int, int]


def name_score(name: str) -> float:
    """How sensitive a target's name is: its parts (camelCase, snake_case, dotted), singly and in pairs."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    return max([SENSITIVE.get(p, 0.0) for p in [*parts, *map("".join, zip(parts, parts[1:]))]], default=0.0)


def literal_score(literal: str) -> float:
    """Strength of a literal: entropy of its characters, whether it mixes classes, its length.

    Of several words it must mix three classes, as a phrase to remember does and prose mostly doesn't.
    """
    words = literal.split()
    solid = "".join(words)
    if len(solid) < 6 or PLACEHOLDER.match(literal):
        return 0.0
    n = len(solid)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(solid).values())
    classes = sum(any(f(c) for c in solid) for f in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum()))
    if len(words) > 1 and "\n" not in literal and (len(words) > PHRASE_WORDS or classes < 3 or not any(c.isdigit() for c in solid)):
        return 0.0
    return min(1.0, 0.2 + 0.12 * entropy + 0.15 * (classes - 1)) if classes > 1 else 0.3


@dataclass(slots=True)
class Pair:
    """A target, its scope, and what its value is made of."""

    name: str
    scope: int
    spans: list[Span] = field(default_factory=list)
    names: list[str] = field(default_factory=list)
    bare: Span | None = None  # an unquoted value, which may be a name


def tokens(text: str, start: int = 0, end: int | None = None) -> Iterator[tuple[str, int, int]]:
    """Kind, start and end of the tokens, blanks left out. A comment is one token, as is a triple-quoted string."""
    at, end = start, len(text) if end is None else end
    closed: dict[str, int] = {}  # where an end mark isn't found any more

    def until(mark: str, a: int) -> int:
        if closed.get(mark, end + 1) <= a:
            return -1
        found = text.find(mark, a, end)
        if found < 0:
            closed[mark] = a
        return found

    while at < end and (m := _TOKEN.match(text, at, end)):
        kind, a, at = m.lastgroup, m.start(), m.end()
        if kind == "space":
            continue
        if kind == "triple":
            stop = until(text[at - 3 : at], at)
            kind, at = ("string", stop + 3) if stop >= 0 else ("op", at)
        elif kind == "comment":
            mark = {"/*": "*/", "<!--": "-->"}.get(m[0])
            stop = until(mark or "\n", at)
            at = end if stop < 0 else stop + len(mark or "")
        yield kind, a, at


def inner(text: str, a: int, b: int) -> Span:
    """What lies between a string's quotes."""
    while text[a] not in "\"'`":
        a += 1
    n = 3 if b - a >= 6 and text[a : a + 3] in ('"""', "'''") else 1
    return a + n, b - n


class Reader:
    """Reads the pairs of a text; scopes are numbered, each with the one around it."""

    def __init__(self, text: str):
        self.text = text
        self.pairs: list[Pair] = []
        self.around: list[int] = [-1]  # of each scope
        self.run, self.holders = (0, 0), []  # the present run without blanks, and the pairs whose value it is
        self._read(0, len(text), 0)

    def _scope(self, parent: int) -> int:
        self.around.append(parent)
        return len(self.around) - 1

    def _read(self, start: int, end: int, scope: int) -> None:
        text, toks = self.text, list(tokens(self.text, start, end))
        open_: list[tuple[str, int, int]] = []  # "{" or "indent", its width, the scope around it
        indent, first = 0, 0  # of the line, and its first token
        for i, (kind, a, b) in enumerate(toks):
            word = text[a:b] if kind in ("op", "name") else ""
            if kind == "newline":
                following = toks[i + 1][0] if i + 1 < len(toks) else "newline"
                if following not in ("newline", "comment"):
                    indent, first = b - a - 1, i + 1
                    while open_ and open_[-1][0] == "indent" and indent <= open_[-1][1]:
                        scope = open_.pop()[2]
            elif kind == "comment":
                # A comment may hold code that was switched off; its names are its own.
                inside = a + len(re.match(r"[#/\-;<!*]*", text[a:b])[0])
                if b > inside and _LOW.search(text, inside, b):
                    self._nested(inside, b, scope)
            elif kind in ("url", "string"):
                if m := _USERINFO.search(text, a, b):
                    self.pairs.append(Pair("password", scope, [m.span(1)]))
            elif kind == "tag":
                self._tag(toks, i, scope)
            elif word in _FUNCTION and kind == "name" and i == first or word == "def":
                open_.append(("indent", indent, scope))
                scope = self._scope(scope)
            elif word == "{":
                open_.append(("{", indent, scope))
                if self._opens_function(toks, i, first):
                    scope = self._scope(scope)
            elif word == "}":
                if any(k == "{" for k, *_ in open_):
                    while (entry := open_.pop())[0] != "{":
                        scope = entry[2]
                    scope = entry[2]
            elif word in _ASSIGN:
                self._assigned(toks, i, first, indent, scope)
            elif word == "," and i >= 2 and toks[i - 1][0] == "string" and self._is(toks, i - 2, "(") and i >= 3 and toks[i - 3][0] == "name":
                key = text[slice(*inner(text, *toks[i - 1][1:]))]
                if _KEY.fullmatch(key):
                    self._valued(Pair(key, scope), toks, i + 1, calls=False)

    def _nested(self, start: int, end: int, scope: int) -> None:
        self._read(start, end, self._scope(scope))

    def _is(self, toks, i: int, what: str) -> bool:
        return 0 <= i < len(toks) and toks[i][0] == "op" and self.text[toks[i][1] : toks[i][2]] == what

    def _opens_function(self, toks, i: int, first: int) -> bool:
        if self._is(toks, i - 1, "=>"):
            return True
        words = {self.text[a:b] for k, a, b in toks[first : min(i, first + 4)] if k == "name"}
        return bool(words & _FUNCTION) or (self._is(toks, i - 1, ")") and not words & _CONTROL)

    def _tag(self, toks, i: int, scope: int) -> None:
        text, (_, a, b) = self.text, toks[i]
        key, value = None, None
        for m in _ATTRIBUTE.finditer(text, a, b):
            span = m.span(2) if m[2] is not None else m.span(3)
            self.pairs.append(Pair(m[1], scope, [span]))
            if m[1].lower() in _KEY_ATTRIBUTES:
                key = text[slice(*span)]
            elif m[1].lower() in _VALUE_ATTRIBUTES:
                value = span
        if key and value:
            self.pairs.append(Pair(key, scope, [value]))
        m = _TAG.match(text, a)
        if m and text[b - 2] != "/" and (c := text.find("<", b)) >= 0 and text.startswith(f"</{m[1]}", c):
            body = text[b:c]
            start = b + len(body) - len(body.lstrip())
            if body.strip():
                self.pairs.append(Pair(m[1], scope, [(start, start + len(body.strip()))]))
                if key:
                    self.pairs.append(Pair(key, scope, [(start, start + len(body.strip()))]))

    def _target(self, toks, i: int, first: int) -> str | None:
        """The name of what stands left of the operator at i."""
        text = self.text
        j = i - 1
        if self._is(toks, j, "]") and j >= 2 and toks[j - 1][0] in ("string", "name"):
            j -= 1
        if j < 0 or toks[j][0] not in ("name", "string"):
            return None
        k, a, b = toks[j]
        # With a type: `name: type =`, `name type =`.
        if k == "name" and text[toks[i][1] : toks[i][2]] == "=" and j - 1 >= first:
            if self._is(toks, j - 1, ":") and j - 2 >= first and toks[j - 2][0] == "name":
                k, a, b = toks[j - 2]
            elif text[a:b] in _TYPES and toks[j - 1][0] == "name":
                k, a, b = toks[j - 1]
        if k == "string":
            a, b = inner(text, a, b)
            return text[a:b] if _KEY.fullmatch(text, a, b) else None
        return text[a:b]

    def _assigned(self, toks, i: int, first: int, indent: int, scope: int) -> None:
        text, (_, a, b) = self.text, toks[i]
        name = self._target(toks, i, first)
        if name is None or text.startswith("//", b):
            return
        pair = Pair(name, scope)
        if text[a:b] == ":" and (m := _BLOCK.match(text, b)):
            self.pairs.append(pair)
            if span := self._block(m.end(), indent):
                pair.spans.append(span)
            return
        if text[a:b] == ":" and self._is(toks, i + 1, "&") and i + 2 < len(toks) and toks[i + 2][0] == "name" and toks[i + 1][2] == toks[i + 2][1]:
            # An anchor is one more name of the value.
            self._valued(Pair(text[toks[i + 2][1] : toks[i + 2][2]], scope), toks, i + 3)
            self._valued(pair, toks, i + 3)
            return
        self._valued(pair, toks, i + 1)

    def _block(self, at: int, indent: int) -> Span | None:
        """The lines from `at` on that are indented deeper, or blank."""
        text, start, stop = self.text, -1, -1
        while at < len(text):
            end = text.find("\n", at)
            end = len(text) if end < 0 else end
            line = text[at:end]
            if line.strip():
                deep = len(line) - len(line.lstrip(" \t"))
                if deep <= indent:
                    break
                start = at + deep if start < 0 else start
                stop = at + len(line.rstrip())
            at = end + 1
        return (start, stop) if start >= 0 else None

    def _valued(self, pair: Pair, toks, i: int, calls: bool = True) -> None:
        """Adds what the expression from token i on holds; it ends where another assignment begins."""
        text, depth, begun = self.text, 0, i
        self.pairs.append(pair)
        after = False  # an operand has just been read
        while i < len(toks):
            kind, a, b = toks[i]
            word = text[a:b] if kind == "op" else ""
            if kind == "string" and (not after or toks[i - 1][0] in ("string", "newline")):
                span = inner(text, a, b)
                pair.spans.append(span)
                pair.names += [x or y for x, y in _INSIDE.findall(text, *span)]
                after = True
            elif kind == "newline" and depth:
                pass
            elif kind == "name" and not after:
                if not (calls and self._is(toks, i + 1, "(")) and i + 1 < len(toks) and self._at(toks, i + 1) in _ASSIGN and depth:
                    break  # a named argument has a target of its own
                if not self._is(toks, i + 1, "("):
                    pair.names.append(text[a:b].strip("${}"))
                after = True
            elif word == "(" and calls:
                depth, after = depth + 1, False
            elif word == ")" and depth:
                depth, after = depth - 1, True
            elif word in _CONCAT and after or word == "," and depth:
                after = False
            elif word in "[" and word and after and i + 1 < len(toks) and toks[i + 1][0] == "string":
                break
            else:
                break
            i += 1
        if not pair.spans and begun < len(toks) and toks[begun][0] != "newline":
            self._bare(pair, toks[begun][1])

    def _bare(self, pair: Pair, at: int) -> None:
        """Configuration: the value is all up to a blank or a delimiter. Of several operators in such a run the first and the last with a sensitive target count."""
        if at >= self.run[1]:
            if not (m := _BARE.match(self.text, at)):
                return
            self.run, self.holders = m.span(1), []
        elif not name_score(pair.name):
            return
        for p in self.holders[1:]:
            p.bare = None
        self.holders = [*self.holders[:1], pair]
        pair.bare = (max(at, self.run[0]), self.run[1])

    def _at(self, toks, i: int) -> str:
        return self.text[toks[i][1] : toks[i][2]]


def literal_spans(text: str, least: float = LEAST_SCORE) -> list[Span]:
    """Spans of literals whose score, name times strength, is `least` or more."""
    reader = Reader(text)
    bound: dict[tuple[int, str], list[int]] = {}
    for n, p in enumerate(reader.pairs):
        bound.setdefault((0 if "." in p.name else p.scope, p.name), []).append(n)

    def found(name: str, scope: int) -> tuple[int, str] | None:
        """What a name stands for: the nearest scope around that binds it."""
        while scope >= 0:
            if (scope, name) in bound:
                return scope, name
            scope = reader.around[scope]
        return (0, name) if (0, name) in bound else None

    # The score of a target goes on to all it is made of, the highest first: each pair is settled once.
    score = [name_score(p.name) for p in reader.pairs]
    by_score: dict[float, list[int]] = {}
    for n, s in enumerate(score):
        if s > 0:
            by_score.setdefault(s, []).append(n)
    settled, followed, reached = set(), set(), {}
    for s in sorted(by_score, reverse=True):
        todo = by_score[s]
        while todo:
            n = todo.pop()
            if n in settled:
                continue
            settled.add(n)
            p = reader.pairs[n]
            names, spans = p.names, p.spans
            if p.bare:
                a, b = p.bare
                while text[b - 1] == "." and b > a + 1:
                    b -= 1
                ref = _REFERENCE.fullmatch(text, a, b)
                if ref and any(m != n for m in bound.get(found(ref[1], p.scope), ())):
                    names = [*names, ref[1]]
                # A chain of names joined by concatenation has been read as such.
                elif not any(found(x, p.scope) for x in names if x != p.name):
                    spans = [*spans, (a, b)]
            for span in spans:
                reached[span] = max(reached.get(span, 0.0), s)
            for key in {found(name, p.scope) for name in names} - followed:
                followed.add(key)
                todo += bound.get(key, [])
    strong = {span: literal_score(text[span[0] : span[1]]) for span in reached}
    return sorted(span for span, s in reached.items() if strong[span] >= LEAST_STRENGTH and s * (0.4 + 0.6 * strong[span]) >= least)


_LOW = re.compile(r"(?i)pass|pwd|secret|token|key|cred|auth|bearer|cookie|salt|signature|://[^\s/?#@:]*:[^\s/?#@:]+@")


def scan(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans and all spans, each as kind, start, end in order of start, then kind."""
    base = []
    marked = _LOW.search(text)
    for kind, pattern, group, least in BASE:
        if kind == "assign" and not marked or kind == "access" and "AKIA" not in text:
            continue
        base += [(kind, *m.span()) for m in pattern.finditer(text) if len(m[group]) >= least]
    added = [("literal", a, b) for a, b in literal_spans(text)] if marked else []
    order = lambda x: (x[1], KINDS[x[0]], x[2])
    return sorted(base, key=order), sorted(base + added, key=order)


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_literal: one row for each row of docs."""

    def one(doc_id, text):
        base, spans = scan(text or "")
        write = lambda found: ",".join(f"{k}:{a}:{b}" for k, a, b in found)
        n = Counter(k for k, _, _ in spans)
        return doc_id, n["assign"], n["access"], n["hex"], hashlib.sha256(write(base).encode()).hexdigest(), write(spans), n["literal"]

    return map_rows(docs, ["doc_id", "text"], one, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_literal long")
