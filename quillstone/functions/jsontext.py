"""JSON text: a strict parser and a canonical printer with exact number rules, and their columns.

Values are None, bool, int (64-bit), float, str, list and dict. What is particular:
* comments are white space; exactly one root; the first of duplicate keys wins; raw control characters may stand in strings;
  unpaired surrogate escapes are errors;
* digits alone that fit 64 bits are integers, every other number is a double, overflow being infinite;
* printing sorts keys by UTF-8 bytes, writes doubles with a whole value below 2**63 as integers, others shortest, and
  non-finite ones as null.
Positions in errors count UTF-8 bytes.
"""

from __future__ import annotations

import json
import math
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

INT_MIN, INT_MAX = -(1 << 63), (1 << 63) - 1
_PART = re.compile(r"(?=[0-9])|\.|[eE][+-]?")
_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?")
_SKIP = re.compile(r"(?:[ \t\n\r]+|//[^\n\r]*|/\*[\s\S]*?\*/)*")
_PLAIN = re.compile(r'[^"\\]*')
_SHORT = {'"': '"', "\\": "\\", "/": "/", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}
_HEX4 = re.compile(r"[0-9a-fA-F]{4}")
_WORDS = {"t": ("true", True), "f": ("false", False), "n": ("null", None)}


class JsonError(ValueError):
    """Text that is not one JSON document; position in bytes."""

    def __init__(self, text: str, at: int, reason: str):
        self.position, self.reason = len(text[:at].encode("utf-8", "surrogatepass")), reason
        super().__init__(f"JSON parse error at position {self.position}: {reason}")


def number(text: str) -> int | float:
    """A number token's value."""
    if "." not in text and "e" not in text and "E" not in text:
        value = int(text) if len(text) < 25 else None
        if value is not None and INT_MIN <= value <= INT_MAX:
            return value
    return float(text)


class _Reader:
    """An explicit stack instead of recursion: depth is bounded by memory alone."""

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def fail(self, reason: str, at: int | None = None):
        raise JsonError(self.text, self.at if at is None else at, reason)

    def skip(self) -> str:
        self.at = _SKIP.match(self.text, self.at).end()
        c = self.text[self.at : self.at + 1]
        if c == "/":
            self.fail("unterminated comment" if self.text[self.at + 1 : self.at + 2] == "*" else "unexpected '/'")
        return c

    def string(self) -> str:
        """From behind the opening quote to behind the closing one."""
        out, text = [], self.text
        while True:
            m = _PLAIN.match(text, self.at)
            out.append(m.group())
            self.at = m.end()
            if self.at >= len(text):
                self.fail("unterminated string")
            if text[self.at] == '"':
                self.at += 1
                return "".join(out)
            out.append(self.escape())

    def unit(self) -> int:
        m = _HEX4.match(self.text, self.at)
        if not m:
            self.fail("bad \\u escape")
        self.at += 4
        return int(m.group(), 16)

    def escape(self) -> str:
        self.at += 1
        c = self.text[self.at : self.at + 1]
        if c in _SHORT and c:
            self.at += 1
            return _SHORT[c]
        if c != "u":
            self.fail("bad escape")
        self.at += 1
        high = self.unit()
        if 0xDC00 <= high < 0xE000:
            self.fail("unpaired low surrogate")
        if 0xD800 <= high < 0xDC00:
            if self.text[self.at : self.at + 2] != "\\u":
                self.fail("unpaired high surrogate")
            self.at += 2
            low = self.unit()
            if not 0xDC00 <= low < 0xE000:
                self.fail("unpaired high surrogate")
            return chr(0x10000 + ((high - 0xD800) << 10) + low - 0xDC00)
        return chr(high)

    def scalar(self, c: str):
        if c == '"':
            self.at += 1
            return self.string()
        if c in _WORDS and c:
            word, value = _WORDS[c]
            if not self.text.startswith(word, self.at):
                self.fail("bad literal")
            self.at += len(word)
            return value
        m = _NUMBER.match(self.text, self.at) if c else None
        if not m:
            if c == "-":
                self.fail("bad number", self.at + 1)
            self.fail("unexpected end" if not c else "a value is expected")
        if part := _PART.match(self.text, m.end()):  # a second integer, or a fraction or exponent without digits: the error is where the digit should be
            self.fail("bad number", part.end())
        self.at = m.end()
        return number(m.group())

    def key(self) -> str:
        if self.skip() != '"':
            self.fail("a key is expected")
        self.at += 1
        name = self.string()
        if self.skip() != ":":
            self.fail("':' is expected")
        self.at += 1
        return name

    def document(self):
        stack: list[list] = []  # each: container, key
        while True:
            c = self.skip()
            if c == "[" or c == "{":
                self.at += 1
                made = [] if c == "[" else {}
                close = "]" if c == "[" else "}"
                if self.skip() != close:
                    stack.append([made, self.key() if c == "{" else None])
                    continue
                self.at += 1
                value = made
            else:
                value = self.scalar(c)
            while stack:
                holder, name = stack[-1]
                if name is None:
                    holder.append(value)
                else:
                    holder.setdefault(name, value)
                c = self.skip()
                if c == ",":
                    self.at += 1
                    if name is not None:
                        stack[-1][1] = self.key()
                    break
                if c != ("]" if name is None else "}"):
                    self.fail("',' or a closing bracket is expected")
                self.at += 1
                value = stack.pop()[0]
            else:
                if self.skip():
                    self.fail("text after the document")
                return value


def _first_wins(pairs: list[tuple]) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        out = {}
        for k, v in pairs:
            out.setdefault(k, v)
    return out


def _no_constant(name: str):
    raise ValueError(name)


_FAST = json.JSONDecoder(object_pairs_hook=_first_wins, parse_int=number, parse_constant=_no_constant, strict=False)


def parse(text: str):
    """The value of a JSON text; JsonError if it is not one.

    The standard decoder reads what it reads alike; texts with \\u escapes (surrogates) or that it rejects (comments, errors, depth) are read by the reader above.
    """
    if "\\u" not in text:
        try:
            return _FAST.decode(text)
        except (ValueError, RecursionError):
            pass
    return _Reader(text).document()


def parse_or_null(text: str):
    """Malformed text is a null document."""
    try:
        return parse(text)
    except JsonError:
        return None


_ESCAPES = {c: f"\\u{c:04x}" for c in range(32)} | {ord(k): v for k, v in {'"': '\\"', "\\": "\\\\", "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}.items()}


def quote(text: str) -> str:
    return f'"{text.translate(_ESCAPES)}"'


def double_text(d: float) -> str:
    """Shortest of 15 to 17 significant digits that reads back; whole values in 64-bit range as integers."""
    if not math.isfinite(d):
        return "null"
    if d == math.floor(d) and -(2.0**63) <= d < 2.0**63:
        return str(int(d))
    return next(t for t in (f"{d:.{n}g}" for n in (15, 16, 17)) if float(t) == d)


def typed_double_text(d: float) -> str:
    """A spelling that stays a double wherever a number without fraction or exponent would be an integer; infinities overflow."""
    if math.isinf(d):
        return "1e999" if d > 0 else "-1e999"
    text = repr(d)
    return text if "e" in text else f"{text}E0"


def dump(value, indent: int = 0, doubles=double_text) -> str:
    """Canonical text; with indent, one entry a line."""
    out: list[str] = []
    todo: list = [(value, 0)]
    while todo:
        v, depth = todo.pop()
        if depth < 0:
            out.append(v)
        elif isinstance(v, dict | list):
            named = isinstance(v, dict)
            items = sorted(v.items(), key=lambda kv: kv[0].encode("utf-8", "surrogatepass")) if named else [(None, x) for x in v]
            if not items:
                out.append("{}" if named else "[]")
                continue
            line = "\n" + " " * (indent * (depth + 1)) if indent > 0 else ""
            parts: list = [("{" if named else "[", -1)]
            for i, (k, x) in enumerate(items):
                parts.append(((("," if i else "") + line + (quote(k) + (": " if indent > 0 else ":") if named else "")), -1))
                parts.append((x, depth + 1))
            parts.append((("\n" + " " * (indent * depth) if indent > 0 else "") + ("}" if named else "]"), -1))
            todo.extend(reversed(parts))
        elif v is None:
            out.append("null")
        elif isinstance(v, bool):
            out.append("true" if v else "false")
        elif isinstance(v, int):
            out.append(str(v) if INT_MIN <= v <= INT_MAX else doubles(float(v)))
        elif isinstance(v, float):
            out.append(doubles(v))
        else:
            out.append(quote(v))
    return "".join(out)


def equal(a, b) -> bool:
    """Deep equality; integers and doubles compare by exact value, never through rounding; booleans are no numbers."""
    todo = [(a, b)]
    while todo:
        x, y = todo.pop()
        if isinstance(x, bool) or isinstance(y, bool) or x is None or y is None:
            if x is not y:
                return False
        elif isinstance(x, int | float) and isinstance(y, int | float):
            if x != y:  # Python compares int and float exactly
                return False
        elif type(x) is not type(y):
            return False
        elif isinstance(x, list):
            if len(x) != len(y):
                return False
            todo.extend(zip(x, y, strict=True))
        elif isinstance(x, dict):
            if x.keys() != y.keys():
                return False
            todo.extend((x[k], y[k]) for k in x)
        elif x != y:
            return False
    return True


# Columns


def json_parse(text: Column) -> Column:
    """struct(ok, canonical, position, message): the strict parse of a text column; SQL null gives null canonical and ok false."""

    @F.pandas_udf("ok boolean, canonical string, position int, message string")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            try:
                rows.append((True, dump(parse(t)), None, None) if t is not None else (False, None, None, None))
            except JsonError as e:
                rows.append((False, None, e.position, str(e)))
        return pd.DataFrame(rows, columns=["ok", "canonical", "position", "message"]).astype({"position": "Int32"})

    return run(text)


def json_print(text: Column, indent: int = 0) -> Column:
    """Canonical (or indented) text of a JSON text column; null where the text is malformed or null."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            try:
                out.append(None if t is None else dump(parse(t), indent))
            except JsonError:
                out.append(None)
        return pd.Series(out, dtype=object)

    return run(text)


def json_typed(text: Column) -> Column:
    """As json_print, but doubles are spelled so that a VARIANT of the text holds them as doubles, infinities too."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            try:
                out.append(None if t is None else dump(parse(t), 0, typed_double_text))
            except JsonError:
                out.append(None)
        return pd.Series(out, dtype=object)

    return run(text)


def json_tolerant(text: Column, indent: int = 0) -> Column:
    """As json_print, but malformed text is the null document."""
    return F.when(text.isNotNull(), F.coalesce(json_print(text, indent), F.lit("null")))


def json_equal(left: Column, right: Column) -> Column:
    """Whether two JSON texts hold equal documents; null where one is malformed or null."""

    @F.pandas_udf("boolean")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            try:
                out.append(None if x is None or y is None else equal(parse(x), parse(y)))
            except JsonError:
                out.append(None)
        return pd.Series(out, dtype=object)

    return run(left, right)
