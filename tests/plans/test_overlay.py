import json
from dataclasses import dataclass

import pytest
from pyspark.sql import functions as F

from quillstone.plans import model as m, overlay, records
from quillstone.plans.overlay import handled, literal, load, loaded, patched, save

COLOR = m.Enum("Color", (("Red", 0), ("Green", 1)))
CODE = m.Enum("Code", (("low", -1), ("none", 0)), integer=True)
INNER = m.record("Inner", x=(m.Int(), 7))
SHAPE = m.External((("Circle", m.record("Circle", r=m.Int())), ("Square", m.record("Square", s=m.Int()))))
PART = m.Internal("type", ((2, m.record("Button", label=m.Text())), (3, m.record("Menu", id=m.Text()))))
WIDE = m.record("Wide", b=(m.Bool(), True), i=(m.Int(), 5), d=(m.Double(), 1.5), t=(m.Text(), "t"), e=(COLOR, 1), g=(CODE, 0), o=(m.Optional(m.Int()), 3), om=m.Omittable(m.Int()), omo=m.Omittable(m.Optional(m.Int())), v=(m.Vector(m.Int()), [1, 2]), f=(m.Fixed(m.Int(), 2), [8, 9]), mp=(m.Map(m.Int()), {"k": 1}), n=INNER, w=(m.Raw(), "prior"), s=SHAPE, p=PART)


def run(spark, t, texts, prior=None):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, t string")
    return [r[1] for r in loaded(df, t, "t", "r", prior).select("i", save(t, F.col("r"))).orderBy("i").collect()]


BASE = '{"b":true,"d":1.5,"e":"Green","f":[8,9],"g":0,"i":5,"mp":{},"n":{"x":7},"o":3,"p":null,"s":null,"t":"t","v":[],"w":"prior"}'


@pytest.mark.parametrize("text", ["{}", "nonsense", "[1]", "null"])
def test_absent_keeps_clears_resets(spark, text):
    assert run(spark, WIDE, [text]) == [BASE]


@pytest.mark.parametrize(
    ("key", "cases"),
    [
        ("b", {"null": "true", "1": "true", "false": "false"}),
        ("i", {"null": "5", '"1"': "5", "true": "5", "7": "7", "5.9": "5", "-5.9": "-5", "4294967297": "1"}),
        ("d", {"null": "1.5", "2": "2", '"2"': "1.5", "0.1": "0.1"}),
        ("t", {"null": '"t"', "5": '"t"', '"a\\n"': '"a\\n"'}),
        ("e", {"null": '"Green"', '"Red"': '"Red"', '"Nope"': '"Green"', "0": '"Red"', "9": "9", '"0"': '"Green"'}),
        ("g", {'"low"': "-1", '"-1"': "-1", "4": "4", '"x"': "0", '"+1"': "0"}),
        ("o", {"null": "null", '"x"': "0", "4": "4"}),
        ("om", {"null": "0", '"x"': "0", "4": "4"}),
        ("omo", {"null": "null", "4": "4", '"x"': "0"}),
        ("v", {"null": "[]", '"x"': "[]", "[]": "[]", "[5,\"x\",null,6]": "[5,2,0,6]"}),
        ("f", {"null": "[8,9]", "[1]": "[1,9]", "[1,2,3]": "[1,2]", '["x",3]': "[8,3]"}),
        ("mp", {"null": "{}", '{"z":1,"a":"x"}': '{"a":0,"z":1}'}),
        ("n", {"null": '{"x":7}', '{"x":1}': '{"x":1}', "3": '{"x":7}'}),
        ("w", {"null": "null", "{}": "{}", "[]": "[]", '{"b":1.0,"a":[1e2]}': '{"a":[100],"b":1}'}),
        ("s", {"null": "null", '{"Circle":{"r":2}}': '{"Circle":{"r":2}}', '{"Square":{},"Circle":{"r":1}}': '{"Circle":{"r":1}}', '{"Other":1}': "null", '{"A":1,"Circle":{}}': "null"}),
        ("p", {'{"type":2,"label":"x"}': '{"label":"x","type":2}', '{"type":"3"}': '{"id":"","type":3}', '{"type":2.5}': '{"label":"","type":2}', '{"type":9}': "null", "{}": "null"}),
    ],
)
def test_matrix(spark, key, cases):
    got = run(spark, m.Record("One", tuple(f for f in WIDE.fields if f.name == key)), [f'{{"{key}":{text}}}' for text in cases])
    assert got == [f'{{"{key}":{out}}}' for out in cases.values()]


def test_prior(spark):
    t = m.record("P", a=m.Int(), b=m.Vector(INNER))
    prior = literal(t, {"a": 4, "b": [{"x": 1}, {"x": 2}]})
    assert run(spark, t, ['{"b":[{},{"x":5},{}]}'], prior) == ['{"a":4,"b":[{"x":1},{"x":5},{"x":7}]}']


def test_first_duplicate_and_unknown_keys(spark):
    assert run(spark, m.record("T", a=m.Int()), ['{"a":1,"a":2,"z":[]}']) == ['{"a":1}']


def test_wire_keys_and_integers(spark):
    t = m.record("T", n=(m.Text(), None, "Full Name's"), q=(m.Int(64), None, "a.b"))
    assert run(spark, t, ['{"Full Name\'s":"x","a.b":9007199254740993}']) == ['{"Full Name\'s":"x","a.b":9007199254740993}']


def test_tag_wins_over_own_field(spark):
    t = m.record("H", c=m.Internal("type", ((7, m.record("Echo", type=(m.Int(), 1), k=m.Int())),)))
    assert run(spark, t, ['{"c":{"type":7,"k":1}}']) == ['{"c":{"k":1,"type":7}}']


def test_enum_tag(spark):
    op = m.Enum("Op", (("Ping", 1), ("Pong", 2)))
    t = m.record("H", c=m.Internal("op", ((1, m.record("A", n=m.Int())), (2, m.record("B", n=m.Int()))), op))
    assert run(spark, t, ['{"c":{"op":"Pong","n":3}}', '{"c":{"op":1}}']) == ['{"c":{"n":3,"op":"Pong"}}', '{"c":{"n":0,"op":"Ping"}}']


def test_handled_and_empty(spark):
    df = spark.createDataFrame([('{"Circle":{}}',), ("{}",)], "t string").withColumn("v", F.try_parse_json("t"))
    assert [r[0] for r in df.select(handled(SHAPE, F.col("v"))).collect()] == [True, False]
    assert run(spark, m.Record("E"), ["{}"]) == ["{}"]
    assert [r[0] for r in df.select(load(m.Map(m.Omittable(m.Int())), F.parse_json(F.lit('{"a":1}')), None)).limit(1).collect()] == [{"a": (True, 1)}]


def test_patch(spark):
    base, patch = m.record("B", a=(m.Int(), 1), b=(m.Text(), "x")), m.record("B", a=m.Omittable(m.Int()), b=m.Omittable(m.Text()))
    df = spark.createDataFrame([('{"b":"y"}',)], "t string")
    assert loaded(df, patch, "t", "p").select(save(base, patched(base, literal(base, base.fresh()), F.col("p")))).first()[0] == '{"a":1,"b":"y"}'


def test_bad_tags():
    with pytest.raises(TypeError):
        m.Internal("t", ((1, INNER), ("x", INNER)))


@dataclass
class Person:
    name: str
    tags: list[str]
    age: int | None = None


def test_registry(spark):
    r = m.Registry()
    assert r.of(Person).ddl() == "struct<`name`:string,`tags`:array<string>,`age`:bigint>" and not r.is_supported(complex)
    assert run(spark, r.of(Person), ['{"name":"a","tags":["x"],"age":3}']) == ['{"age":3,"name":"a","tags":["x"]}']
    assert m.from_spark(spark.range(1).schema).fields[0].type == m.Int(64)


def test_options_reach_every_nested_slot(spark):
    inner = m.record("Inner", x=m.Int(), seen=(m.Handed(m.Text(), "tag"), None, "tag"))
    outer = m.record("Outer", one=inner, items=m.Vector(inner), maybe=m.Optional(inner), by=m.Map(inner), u=m.Internal("k", ((1, inner),)))
    text = '{"one":{"x":5,"tag":"theirs"},"items":[{"x":1},{"x":2}],"maybe":{},"by":{"a":{}},"u":{"k":1}}'
    df = spark.createDataFrame([(text,)], "t string")
    for options, want in (({"tag": "ours", "other": 1}, "ours"), (None, "")):
        r = overlay.loaded(df, outer, "t", options=options).first()["record"]
        assert r["one"]["x"] == 5 and [x["x"] for x in r["items"]] == [1, 2]
        assert [r["one"]["seen"], *(x["seen"] for x in r["items"]), r["maybe"]["seen"], r["by"]["a"]["seen"], r["u"]["arm_0"]["seen"]] == [want] * 6
        plain = records.load(m.handed(outer, options), json.loads(text), outer.fresh())
        assert plain["one"]["seen"] == plain["items"][1]["seen"] == plain["by"]["a"]["seen"] == want
        assert records.save(m.handed(outer, options), plain)["maybe"] == {"x": 0, "tag": want}
    saved = overlay.loaded(df, outer, "t").select(overlay.save(outer, F.col("record"), options={"tag": "out"}).alias("s")).first()["s"]
    held = json.loads(saved)
    assert held["one"] == {"x": 5, "tag": "out"} and [x["tag"] for x in held["items"]] == ["out"] * 2 and held["u"] == {"k": 1, "x": 0, "tag": "out"}
