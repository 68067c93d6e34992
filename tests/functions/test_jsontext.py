import json
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstone.functions.jsontext import JsonError, dump, equal, json_equal, json_parse, json_tolerant, parse

BAD = ["", "1 2", '{"a":1} x', "[1,]", '{"a":1,}', "01", "-", "1.", "1e", ".5", "+1", "/", "/* x", "tru", '"a', '"\\q"', '"\\ud83d"', '"\\udc00"', '"\\ud83d\\u0041"', "{1:2}", "{'a':1}", "NaN", "Infinity", "-Infinity", "[1 2]", " 1", '"\\u12g4"']


@pytest.mark.parametrize("text", BAD)
def test_rejects(text):
    with pytest.raises(JsonError):
        parse(text)


@pytest.mark.parametrize(
    ("text", "canonical"),
    [
        ("// c\n1", "1"),
        ("/* a */ [1, /* b */ 2] // end", "[1,2]"),
        ('{"b":1,"a":2}', '{"a":2,"b":1}'),
        ('{"a":1,"a":2}', '{"a":1}'),
        ("-0", "0"),
        ("9223372036854775807", "9223372036854775807"),
        ("9223372036854775808", "9.223372036854776e+18"),
        ("-9223372036854775808", "-9223372036854775808"),
        ("1e999", "null"),
        ("1e3", "1000"),
        ("0.1", "0.1"),
        ("1e20", "1e+20"),
        ("1e-7", "1e-07"),
        ("0.30000000000000004", "0.30000000000000004"),
        ('"a\tb"', '"a\\tb"'),
        ('"\\u0041\\ud83d\\ude00/\\/"', '"A😀//"'),
        ('"\\u0001"', '"\\u0001"'),
        ("[]", "[]"),
        ("{}", "{}"),
        ('{"\\uffee":1,"\\ud83d\\ude00":2}', '{"￮":1,"😀":2}'),
    ],
)
def test_canonical(text, canonical):
    assert dump(parse(text)) == canonical


def test_indent():
    assert dump(parse('{"a":[1,{}],"b":{"c":null}}'), 2) == '{\n  "a": [\n    1,\n    {}\n  ],\n  "b": {\n    "c": null\n  }\n}'


def test_depth():
    assert dump(parse("[" * 50_000 + "]" * 50_000)) == "[" * 50_000 + "]" * 50_000


def test_position_counts_bytes():
    with pytest.raises(JsonError) as e:
        parse('["é", x]')
    assert e.value.position == 7


def test_equal():
    assert equal(parse("[1, 2.0]"), parse("[1.0, 2]"))
    assert not equal(9007199254740993, 9007199254740992.0)
    assert not equal(True, 1)
    assert not equal(parse('{"a":null}'), parse("{}"))


VALUES = st.recursive(st.none() | st.booleans() | st.integers(-(2**63), 2**63 - 1) | st.floats(allow_nan=False, allow_infinity=False) | st.text(st.characters(exclude_categories=["Cs"])), lambda v: st.lists(v) | st.dictionaries(st.text(st.characters(exclude_categories=["Cs"])), v), max_leaves=20)


@settings(max_examples=200, deadline=None)
@given(VALUES)
def test_round_trip(value):
    text = dump(value)
    assert equal(parse(text), value)
    assert dump(parse(text)) == text
    assert equal(parse(dump(value, 3)), value)


@given(st.floats())
def test_double(d):
    text = dump(d)
    assert (text == "null") if not math.isfinite(d) else float(text) == d


def test_columns(spark):
    df = spark.createDataFrame([("a", '{"b":1, "a":[1.0]}'), ("b", "[1,"), ("c", None)], "id string, text string")
    rows = df.select("id", json_parse(F.col("text")).alias("p"), json_tolerant(F.col("text")).alias("t"), json_equal(F.col("text"), F.lit('{"a":[1],"b":1.0}')).alias("e")).orderBy("id").collect()
    assert [(r.p.ok, r.p.canonical, r.p.position, r.t, r.e) for r in rows] == [(True, '{"a":[1],"b":1}', None, '{"a":[1],"b":1}', True), (False, None, 3, "null", None), (False, None, None, None, None)]


def test_string_documents(spark, tmp_path):
    """Every character of a text is printed, past the first 200 too."""
    from quillstone import catalog

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x11000)])) + '"quoted\\" \U0001f600'
    texts = ["x" * 5000 + every, every * 2, '"', "\\", "\x7f\t\n", "", "y" * 200 + "z", None, "\\\x0b\x0b\\\\u000B\\u000B\x1f\\"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["printed"] for r in catalog.queries()["json_string_documents"](spark, str(tmp_path)).collect()}
    assert got == {i: json.dumps({"t": t}, ensure_ascii=False, separators=(",", ":")) for i, t in enumerate(texts)}
