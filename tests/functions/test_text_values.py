import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from quillstone import catalog
from quillstone.functions import strings, unicode16, values


def test_categories():
    t = unicode16.table()
    names = np.array(unicode16.NAMES)
    assert [names[t[ord(c)]] for c in "Aa1 _-(€ "] == ["Lu", "Ll", "Nd", "Zs", "Pc", "Pd", "Ps", "Sc", "Zl"]
    assert names[t[0x1C89]] == "Lu" and names[t[0x16D40]] == "Lm" and names[t[0x10FFFF]] == "Cn" and names[t[0xD800]] == "Cs"
    differ = sum(unicodedata.category(chr(c)) != names[t[c]] for c in range(0x110000))
    assert differ in (0, 5186)


def test_category_sweep(spark):
    got = dict(spark.range(0x110000).groupBy(unicode16.general_category(F.col("id")).alias("c")).count().collect())
    want = np.bincount(unicode16.table(), minlength=30)
    assert got == {unicode16.NAMES[i]: n for i, n in enumerate(want) if n}


def test_white_space(spark):
    assert spark.range(0x110000).filter(unicode16.is_white_space(F.col("id"))).count() == 25


@pytest.mark.parametrize(
    ("data", "out"),
    [(b"a", [(97, 1, True)]), ("é€😀".encode(), [(0xE9, 2, True), (0x20AC, 3, True), (0x1F600, 4, True)]), (b"\x80", [(0x80, 1, False)]), (b"\xe2\x82", [(0xE2, 1, False), (0x82, 1, False)]), (b"\xc0\xaf", [(0xC0, 1, False), (0xAF, 1, False)]), (b"\xed\xa0\x80", [(0xED, 1, False), (0xA0, 1, False), (0x80, 1, False)]), (b"\xf4\x90\x80\x80", [(0xF4, 1, False), (0x90, 1, False), (0x80, 1, False), (0x80, 1, False)]), (b"\xff", [(0xFF, 1, False)])],
)
def test_decode(data, out):
    assert unicode16.decode_all(data) == out


@pytest.mark.parametrize("data", [b"", "aé€😀".encode(), b"a\xffb\xe2\x82", b"\xed\xa0\x80"])
def test_decoded_arrays(data):
    assert list(zip(*(x.tolist() for x in unicode16.decoded_arrays(data)), strict=True)) == unicode16.decode_all(data)


def test_encode():
    for c in (0, 0x7F, 0x80, 0x7FF, 0x800, 0xFFFF, 0x10000, 0x10FFFF):
        assert unicode16.encode_point(c) == chr(c).encode("utf-8", "surrogatepass")


def test_utf8_columns(spark):
    assert [r[0] for r in spark.createDataFrame([(None,), (b"",)], "b binary").select(unicode16.utf8_decoded(F.col("b"))).collect()] == [None, []]
    df = spark.createDataFrame([("a😀b", b"a\xff", [97, 0x20AC])], "t string, b binary, c array<int>")
    r = df.select(unicode16.code_points(F.col("t")).alias("p"), unicode16.utf8_decoded(F.col("b")).alias("d"), unicode16.utf8_encoded(F.col("c")).alias("e"), unicode16.category_counts(F.col("t")).alias("n")).first()
    assert list(r.p) == [97, 128512, 98] and [tuple(x) for x in r.d] == [(97, 1, True), (255, 1, False)] and bytes(r.e) == "a€".encode() and [tuple(x) for x in r.n] == [("Ll", 2), ("So", 1)]


def test_utf8_in_portions(spark):
    """Texts are decoded and encoded again a few at a time; no characters pass between workers and the JVM."""
    odd = [0, 0x7F, 0x800, 0xD83D, 0xDE00, 0x10FFFF]
    for points in (odd, [*odd, 0x110000, 0x1FFFFF], []):
        assert unicode16.encoded_points(np.array(points, np.int64)) == b"".join(map(unicode16.encode_point, points))
    blobs = [b"", None, "a\u20ac\U0001f600".encode(), b"\xffa", b"x" * 50, None, b"yz"] * 3
    parts = list(unicode16._portions(pa.array(blobs, pa.binary()), pc.binary_length, 20))
    assert pa.concat_arrays(parts).to_pylist() == blobs and len(parts) > 3 and all(sum(len(b or b"") for b in p.to_pylist()[:-1]) <= 40 for p in parts)
    assert [len(p) for p in unicode16._portions(pa.array([], pa.binary()), pc.binary_length, 20)] == [0]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(blobs)], "i int, b binary").coalesce(1)
    got = df.select("i", "b", unicode16.utf8_again(F.col("b")).alias("u"), unicode16.utf8_decoded(F.col("b")).alias("d")).collect()
    assert len(got) == len(blobs)
    for r in got:
        assert (r.b is None) == (r.u is None) == (r.d is None)
        if r.b is not None:
            d = unicode16.decode_all(bytes(r.b))
            assert [tuple(x) for x in r.d] == d
            assert (r.u.bytes, r.u.characters, r.u.first_point) == (len(r.b), len(d), d[0][0] if d else None)
            assert bytes(r.u.again) == b"".join(unicode16.encode_point(x[0]) for x in d)
    plan = catalog.queries()["text_utf8"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("EvalPython") == 1


def test_strings(spark):
    df = spark.createDataFrame([(" a,b..c\t",)], "t string")
    c = F.col("t")
    r = df.select(strings.split_on(c, ".").alias("s"), strings.split_on(c, "").alias("w"), strings.replace_all(c, ".", "#").alias("r"), strings.replace_all(c, "", "#").alias("u"), strings.trim_ascii(c).alias("m"), strings.make_indent(2, F.lit(3)).alias("i")).first()
    assert (r.s, r.w, r.r, r.u, r.m, r.i) == ([" a,b", "", "c\t"], [" a,b..c\t"], " a,b##c\t", " a,b..c\t", "a,b..c", " " * 6)
    rows = spark.createDataFrame([("12",), ("-3",), (" 12 ",), ("+12",), ("",), ("9223372036854775808",), ("1x",)], "t string")
    assert [r[0] for r in rows.select(strings.parse_whole_integer(F.col("t"))).collect()] == [12, -3, None, None, None, None, None]
    assert [tuple(r) for r in spark.createDataFrame([("a_1",), ("$a",), ("1a",), ("a\n",)], "t string").select(strings.is_identifier(F.col("t")), strings.is_js_identifier(F.col("t"))).collect()] == [(True, True), (False, True), (False, False), (False, False)]
    assert strings.sanitized("Ns::A<B>") == "Ns_A_B" and strings.short_name("a::b::C<x::D>") == "C<x::D>"


VALUE_ROWS = ["null", "true", "1", "1.5", "1e3", '"x"', "[1,2]", '{"a":null,"b":{"c":1}}', "9223372036854775807", "9.223372036854775807e18"]


def test_values(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(VALUE_ROWS)], "i int, t string").withColumn("v", values.variant(F.col("t")))
    v = F.col("v")
    rows = df.select("i", values.kind(v), values.is_integer(v), values.as_bool(v), values.as_number(v), values.as_integer(v), values.as_string(v), values.array_size(v), values.kind(values.find(v, "a")), values.kind(values.find(v, "zz")), values.kind(values.to_object(v)), values.kind(values.payload_or_empty(v))).orderBy("i").collect()
    assert [r[1] for r in rows] == ["null", "bool", "number", "number", "number", "string", "array", "object", "number", "number"]
    assert [r[2] for r in rows] == [False, False, True, False, False, False, False, False, True, False]
    assert rows[1][3] is True and rows[2][3] is None
    assert [r[4] for r in rows[2:5]] == [1.0, 1.5, 1000.0] and rows[1][4] is None
    assert [r[5] for r in rows] == [None, None, 1, None, 1000, None, None, None, 2**63 - 1, None]
    assert rows[5][6] == "x" and rows[2][6] is None and rows[6][7] == 2 and rows[7][7] == 0
    assert rows[7][8] == "null" and rows[7][9] == "absent" and rows[2][10] == "object" and rows[0][11] == "object"


def test_strict(spark):
    df = spark.createDataFrame([("[1]",)], "t string").withColumn("v", values.variant(F.col("t")))
    assert df.select(F.size(values.strict(F.col("v"), "array"))).first()[0] == 1
    with pytest.raises(Exception, match="expected string but value is array"):
        df.select(values.strict(F.col("v"), "string")).collect()
    with pytest.raises(Exception, match="expected object but value is array"):
        df.select(F.size(values.strict(F.col("v"), "object"))).collect()
