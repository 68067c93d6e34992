"""Unicode 16 general categories, classes and UTF-8, as numpy tables and columns."""

from __future__ import annotations

import functools
import itertools
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The general categories' short names, in the standard's order.
NAMES = "Lu Ll Lt Lm Lo Mn Mc Me Nd Nl No Pc Pd Ps Pe Pi Pf Po Sm Sc Sk So Zs Zl Zp Cc Cf Cs Co Cn".split()
#: Code points whose category is new in Unicode 16.0 against 15.1, as ranges.
NEW_IN_16 = """
897:Mn 1B4E-1B4F:Po 1B7F:Po 1C89:Lu 1C8A:Ll 2427-2429:So 31E4-31E5:So A7CB-A7CC:Lu A7CD:Ll A7DA:Lu A7DB:Ll A7DC:Lu
105C0-105F3:Lo 10D40-10D49:Nd 10D4A-10D4D:Lo 10D4E:Lm 10D4F:Lo 10D50-10D65:Lu 10D69-10D6D:Mn 10D6E:Pd 10D6F:Lm
10D70-10D85:Ll 10D8E-10D8F:Sm 10EC2-10EC4:Lo 10EFC:Mn 11380-11389:Lo 1138B:Lo 1138E:Lo 11390-113B5:Lo 113B7:Lo
113B8-113BA:Mc 113BB-113C0:Mn 113C2:Mc 113C5:Mc 113C7-113CA:Mc 113CC-113CD:Mc 113CE:Mn 113CF:Mc 113D0:Mn 113D1:Lo
113D2:Mn 113D3:Lo 113D4-113D5:Po 113D7-113D8:Po 113E1-113E2:Mn 116D0-116E3:Nd 1171E:Mc 11BC0-11BE0:Lo 11BE1:Po
11BF0-11BF9:Nd 11F5A:Mn 13460-143FA:Lo 16100-1611D:Lo 1611E-16129:Mn 1612A-1612C:Mc 1612D-1612F:Mn 16130-16139:Nd
16D40-16D42:Lm 16D43-16D6A:Lo 16D6B-16D6C:Lm 16D6D-16D6F:Po 16D70-16D79:Nd 18CFF:Lo 1CC00-1CCEF:So 1CCF0-1CCF9:Nd
1CD00-1CEB3:So 1E5D0-1E5ED:Lo 1E5EE-1E5EF:Mn 1E5F0:Lo 1E5F1-1E5FA:Nd 1E5FF:Po 1F8B2-1F8BB:So 1F8C0-1F8C1:So 1FA89:So
1FA8F:So 1FABE:So 1FAC6:So 1FADC:So 1FADF:So 1FAE9:So 1FBCB-1FBEF:So
"""
#: The 25 White_Space code points.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
LIMIT = 0x110000
#: Bytes or code points that a worker turns into arrays at a time.
PORTION = 1 << 20
CLASSES = {"letter": "L", "mark": "M", "number": "N", "punctuation": "P", "symbol": "S", "separator": "Z", "other": "C"}


@functools.cache
def table() -> np.ndarray:
    """Category index of every code point."""
    index = {n: i for i, n in enumerate(NAMES)}
    out = np.fromiter((index[unicodedata.category(chr(c))] for c in range(LIMIT)), np.uint8, LIMIT)
    for entry in NEW_IN_16.split():
        span, name = entry.split(":")
        low, _, high = span.partition("-")
        out[int(low, 16) : int(high or low, 16) + 1] = index[name]
    return out


def category(code_points: np.ndarray) -> np.ndarray:
    """Category index; what is no code point is unassigned."""
    c = np.asarray(code_points, np.int64)
    inside = (c >= 0) & (c < LIMIT)
    return np.where(inside, table()[np.where(inside, c, 0)], NAMES.index("Cn"))


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def decode_at(data: bytes, at: int) -> tuple[int, int, bool]:
    """(value, byte length, valid) of the character at a byte; any bad sequence gives its first byte, 1, False."""
    lead = data[at]
    if lead < 0x80:
        return lead, 1, True
    size = 2 if 0xC2 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 4 if 0xF0 <= lead < 0xF5 else 0
    if size:
        try:
            return ord(data[at : at + size].decode("utf-8")), size, True
        except (UnicodeDecodeError, TypeError):
            pass
    return lead, 1, False


def decode_all(data: bytes) -> list[tuple[int, int, bool]]:
    out, at = [], 0
    while at < len(data):
        out.append(decode_at(data, at))
        at += out[-1][1]
    return out


def encode_point(cp: int) -> bytes:
    """UTF-8 by the bit pattern alone, surrogates too."""
    if cp < 0x80:
        return bytes([cp])
    tail = []
    for bits, head in ((11, 0xC0), (16, 0xE0), (21, 0xF0)):
        tail.insert(0, 0x80 | cp & 0x3F)
        cp >>= 6
        if cp < 1 << (bits - 6 * len(tail)):
            return bytes([head | cp, *tail])
    raise ValueError("beyond four bytes")


# Columns


def general_category(code_point: Column) -> Column:
    """Two-letter category of an integer column."""

    @F.pandas_udf("string")
    def run(c: pd.Series) -> pd.Series:
        names = np.array(NAMES, object)[category(c.fillna(-1).to_numpy(np.int64))]
        return pd.Series(np.where(c.isna(), None, names))

    return run(code_point.cast("long"))


def is_class(code_point: Column, name: str) -> Column:
    """name: letter, mark, number, punctuation, symbol, separator, other."""
    return F.substring(general_category(code_point), 1, 1) == CLASSES[name]


def is_white_space(code_point: Column) -> Column:
    return code_point.cast("int").isin(WHITE_SPACE)


def category_counts(text: Column) -> Column:
    """Characters by category: map of two-letter name to count, exact for Unicode 16."""

    @F.pandas_udf("array<struct<category string, n bigint>>")
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            if t is None:
                out.append(None)
                continue
            counts = np.bincount(table()[points(t)], minlength=len(NAMES))
            out.append([{"category": NAMES[i], "n": int(counts[i])} for i in np.flatnonzero(counts)])
        return pd.Series(out, dtype=object)

    return run(text)


def ranges(code_points: np.ndarray) -> list[tuple[int, int]]:
    """Ascending code points as inclusive ranges."""
    if not len(code_points):
        return []
    cuts = np.flatnonzero(np.diff(code_points) != 1)
    return list(zip(code_points[np.append(0, cuts + 1)].tolist(), code_points[np.append(cuts, len(code_points) - 1)].tolist(), strict=True))


@functools.cache
def class_pattern(name: str) -> str:
    """A regular expression of one character of a major class, exact for Unicode 16: the JVM's own class, with what its tables lack and without what they have otherwise."""
    java = SparkContext._active_spark_context._jvm.java.util.regex.Pattern
    own = np.char.startswith(np.array(NAMES)[table()], CLASSES[name])
    own[0xD800:0xE000] = False  # no text holds a surrogate
    rest = ~own
    rest[0xD800:0xE000] = False
    kept = lambda points, pattern: np.array([ord(c) for c in java.compile(pattern).matcher("".join(map(chr, points))).replaceAll("")], np.int64)
    p = f"\\p{{{CLASSES[name]}}}"
    lacks, wrong = kept(np.flatnonzero(own), p), kept(np.flatnonzero(rest), p.replace("p", "P", 1))
    spelt = lambda points: "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges(points))
    return f"(?![{spelt(wrong)}])[{p}{spelt(lacks)}]" if len(wrong) else f"[{p}{spelt(lacks)}]"


def class_count(text: Column, name: str) -> Column:
    """Characters of a major class, counted in the JVM, exact for Unicode 16."""
    return F.regexp_count(text, F.lit(class_pattern(name))).cast("long")


def code_points(text: Column) -> Column:
    """A text's code points."""
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c))


def decoded_arrays(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """decode_all as arrays; valid data is decoded at once."""
    try:
        v = points(data.decode("utf-8")).astype(np.int32)
        return v, (1 + (v >= 0x80) + (v >= 0x800) + (v >= 0x10000)).astype(np.int32), np.ones(len(v), bool)
    except UnicodeDecodeError:
        v, n, ok = zip(*decode_all(data), strict=True)
        return np.array(v, np.int32), np.array(n, np.int32), np.array(ok, bool)


def encoded_points(cps: np.ndarray) -> bytes:
    """encode_point of each."""
    try:
        return cps.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    except UnicodeDecodeError:
        return b"".join(encode_point(int(c)) for c in cps)


def _portions(column: pa.Array, weight: Callable[[pa.Array], pa.Array], most: int = PORTION) -> Iterator[pa.Array]:
    """A batch's rows in order, in slices of about `most` by weight, a row at least, and all rows of an empty batch."""
    held = np.cumsum(np.append(0, pc.fill_null(weight(column), 0).to_numpy(zero_copy_only=False))) // most
    cuts = [0, *(np.flatnonzero(np.diff(held[:-1])) + 1).tolist(), len(column)]
    return (column.slice(a, b - a) for a, b in itertools.pairwise(cuts) if b > a or not len(column))


def utf8_decoded(data: Column) -> Column:
    """array of struct(value, length, valid) over the characters of a binary."""

    @F.arrow_udf("array<struct<value int, length int, valid boolean>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for blobs in (x for b in batches for x in _portions(b, pc.binary_length)):
            each = [decoded_arrays(b) if b is not None else None for b in blobs.to_pylist()]
            held = [e for e in each if e is not None]
            cuts = np.concatenate(([0], np.cumsum([0 if e is None else len(e[0]) for e in each])))
            columns = [pa.array(np.concatenate([e[i] for e in held]) if held else [], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.bool_()))]
            yield pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.StructArray.from_arrays(columns, ["value", "length", "valid"]), mask=pa.array([e is None for e in each], pa.bool_()))

    return run(data)


def utf8_encoded(cps: Column) -> Column:
    """UTF-8 bytes of an array of code points, not validated."""

    @F.arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for rows in (x for b in batches for x in _portions(b, pc.list_value_length)):
            yield pa.array([None if r is None else encoded_points(np.array(r, np.int64)) for r in rows.to_pylist()], pa.binary())

    return run(cps)


def utf8_again(data: Column) -> Column:
    """struct(bytes, characters, first_point, again) of a binary: the sums of what utf8_decoded gives and what utf8_encoded makes of it. Only a row's characters are held at a time, none leave the worker."""
    names, kinds = ["bytes", "characters", "first_point", "again"], (pa.int64(), pa.int64(), pa.int32(), pa.binary())

    @F.arrow_udf("struct<bytes bigint, characters bigint, first_point int, again binary>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for blobs in (x for b in batches for x in _portions(b, pc.binary_length)):
            rows = []
            for b in blobs:
                if not b.is_valid:
                    rows.append((None,) * 4)
                    continue
                value, length, _ = decoded_arrays(b.as_py())
                rows.append((int(length.sum()), len(value), int(value[0]) if len(value) else None, encoded_points(value)))
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]
            yield pa.StructArray.from_arrays(columns, names, mask=pa.array([not b.is_valid for b in blobs], pa.bool_()))

    return run(data)
