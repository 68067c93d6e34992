"""Queries of the rules of the document engine, case by case, over documents made from rows of a table.

A case is a text and what must come of it. In both, @n stands for a row's number and @s for its name, so every case is met with every
row. The SQL equivalents hold what must come of the cases as the rules have it, filled in from the same table.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone import exported
from quillstone.functions import jsontext, strings, unicode16, values, xmltext
from quillstone.operators.commands import Api, CommandTable, Completer
from quillstone.plans import export as ex
from quillstone.plans import model as m
from quillstone.plans import overlay, records, xmlmap
from quillstone.plans.visitor import Values, visit
from quillstone.streaming import events as ev

QUERIES: dict = {}
SQL: dict[str, str] = {}
CASES: dict[str, list[tuple[str, str]]] = {}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _filled(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("@n"), F.col("n_nationkey").cast("string")), F.lit("@s"), F.col("n_name"))


def cases(rows: list[tuple[str, str]]):
    """Registers a function from a table (id, case, text) to (id, case, got) as a query of these cases."""

    def add(f):
        def run(spark, sf_dir: str) -> DataFrame:
            each = F.explode(F.array(*[F.struct(F.lit(i).alias("case"), F.lit(text).alias("text")) for i, (text, _) in enumerate(rows)])).alias("c")
            df = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name", each)
            return f(df.select(F.col("n_nationkey").alias("id"), F.col("c.case").alias("case"), _filled(F.col("c.text")).alias("text"))).select("id", "case", "got")

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        wants = ", ".join(f"({i}, {_quoted(want)})" for i, (_, want) in enumerate(rows))
        QUERIES[f.__name__], CASES[f.__name__] = run, rows
        SQL[f.__name__] = f"select n_nationkey as id, c as case, replace(replace(want, '@n', cast(n_nationkey as varchar)), '@s', n_name) as got from nation, (values {wants}) w(c, want)"
        return run

    return add


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


GRAMMAR = [
    (" \t\r\n1@n \n", "1@n"),
    ("\x0c1@n", "!0"),
    (" 1@n", "!0"),
    ("[] 1@n", "!3"),
    ("[1@n.50, 2@n]", "[1@n.5,2@n]"),
    ("9223372036854775807", "9223372036854775807"),
    ("-9223372036854775808", "-9223372036854775808"),
    ("9223372036854775808", "9.223372036854776e+18"),
    ("-0", "0"),
    ("[-0, @n]", "[0,@n]"),
    ("01@n", "!1"),
    ("-", "!1"),
    ("1.", "!2"),
    ("1e", "!2"),
    (".5", "!0"),
    ("+1", "!0"),
    ("1e999", "null"),
    ("[-1e999,@n]", "[null,@n]"),
    ('"\\"\\\\\\/\\b\\f\\n\\r\\t@s"', '"\\"\\\\/\\b\\f\\n\\r\\t@s"'),
    ('"\\q@s"', "!2"),
    ('"\\ud83d\\ude00@s\\u00e9"', '"😀@sé"'),
    ('"\\ud83d\\ude"', "!"),
    ('"\\udc00"', "!"),
    ('"\\ud83d"', "!"),
    ('"a\x01\tb@s"', '"a\\u0001\\tb@s"'),
    ('{"@s":1,"b":2,"@s":3}', '{"@s":1,"b":2}'),
    ("[1,]", "!3"),
    ('{"a":1,}', "!7"),
    ("{'a':1}", "!1"),
    ("/* @s */ [ // x\n @n ]", "[@n]"),
    ("[@n] /* open", "!"),
    ("/ 1", "!"),
    ("[" * 300 + "@n" + "]" * 300, "[" * 300 + "@n" + "]" * 300),
    ('{"é":1,"z":2,"a":@n,"Z":{},"b":[]}', '{"Z":{},"a":@n,"b":[],"z":2,"é":1}'),
    ("[3.25e-7,1e20,1E3,0.1,100000000000000000000]", "[3.25e-07,1e+20,1000,0.1,1e+20]"),
    ("[tru]", "!"),
    ("", "!0"),
]


@cases([(text, "!" if want.startswith("!") else want) for text, want in GRAMMAR])
def json_grammar(df):
    """White space, comments, numbers, strings, escapes, duplicates, order, depth; malformed texts are told apart."""
    return df.withColumn("p", jsontext.json_parse(F.col("text"))).withColumn("got", F.when(F.col("p.ok"), F.col("p.canonical")).otherwise("!"))


@cases([(text, want[1:]) for text, want in GRAMMAR if len(want) > 1 and want.startswith("!")])
def json_error_positions(df):
    return df.withColumn("got", jsontext.json_parse(F.col("text"))["position"].cast("string"))


def _shown(v: Column) -> Column:
    text = lambda c: F.coalesce(c.cast("string"), F.lit("-"))
    keys = F.array_join(F.array_sort(F.map_keys(values.as_object(v))), "+")
    return F.concat_ws("|", values.kind(v), text(values.is_integer(v)), text(values.as_bool(v)), text(values.as_number(v)), text(values.as_integer(v)), text(values.to_int(v)), text(values.to_float(v)), text(values.as_string(v)), text(values.array_size(v)), text(keys), values.kind(values.find(v, 1)), values.kind(values.find(v, "a")))


@cases(
    [
        ("5@n", "number|true|-|5@n.0|5@n|5@n|5@n.0|-|0|-|absent|absent"),
        ("5@n.0", "number|false|-|5@n.0|5@n|5@n|5@n.0|-|0|-|absent|absent"),
        ("5@n.75", "number|false|-|5@n.75|-|5@n|5@n.75|-|0|-|absent|absent"),
        ("-5@n.75", "number|false|-|-5@n.75|-|-5@n|-5@n.75|-|0|-|absent|absent"),
        ("1e3", "number|false|-|1000.0|1000|1000|1000.0|-|0|-|absent|absent"),
        ("1e999", "number|false|-|Infinity|-|-|Infinity|-|0|-|absent|absent"),
        ("9007199254740993", "number|true|-|9.007199254740992E15|9007199254740993|-|9.0071993E15|-|0|-|absent|absent"),
        ("9223372036854775808", "number|false|-|9.223372036854776E18|-|-|9.223372E18|-|0|-|absent|absent"),
        ("-9223372036854775808.0", "number|false|-|-9.223372036854776E18|-9223372036854775808|-|-9.223372E18|-|0|-|absent|absent"),
        ("true", "bool|false|true|-|-|-|-|-|0|-|absent|absent"),
        ("null", "null|false|-|-|-|-|-|-|0|-|absent|absent"),
        ('"@s"', "string|false|-|-|-|-|-|@s|0|-|absent|absent"),
        ("[@n,null,{}]", "array|false|-|-|-|-|-|-|3|-|null|absent"),
        ('{"é":1,"b":2,"a":"@s"}', "object|false|-|-|-|-|-|-|0|a+b+é|absent|string"),
        ('{"a":[],"A":{}}', "object|false|-|-|-|-|-|-|0|A+a|absent|array"),
        ("[@n", "absent|-|-|-|-|-|-|-|0|-|absent|absent"),
    ]
)
def json_number_kinds(df):
    """Kinds, guarded reads, exact integers, conversions that cut, elements and members of parsed values."""
    return df.withColumn("v", values.parsed(F.col("text"))).withColumn("got", F.when(F.col("v").isNull(), "absent|-|-|-|-|-|-|-|0|-|absent|absent").otherwise(_shown(F.col("v"))))


COLOR = m.Enum("Color", (("Red", 0), ("Green", 1), ("Deep", -2)))
CODE = m.Enum("Code", (("low", -1), ("none", 0), ("high", 4)), integer=True)
LEAF = m.record("Leaf", x=(m.Int(), 7))
BOX = m.record("Box", y=(m.Int(), 2), v=m.Vector(m.Int()), om=m.Omittable(m.Int()))
SHAPE = m.External((("Disc", m.record("Disc", r=m.Int())), ("Bar", m.record("Bar", s=m.Int()))))
PART = m.Internal("type", ((2, m.record("Knob", label=m.Text())), (3, m.record("List", id=m.Text())), (2, m.record("Late", z=m.Int()))))
OP = m.Enum("Op", (("Ping", 1), ("Pong", 2)))
FRAME = m.Internal("op", ((1, m.record("PingArm", n=m.Int())), (2, m.record("PongArm", n=m.Int(), op=(m.Int(), 9)))), OP)
SAID = m.Internal("kind", (("text", m.record("Said", body=m.Text())), ("5", m.record("Five", body=m.Text()))))
#: field: its type and default, and its text in a record loaded from an empty document.
FIELDS = {
    "b": (m.Bool(), True, "true"),
    "i": (m.Int(), 5, "5"),
    "i8": (m.Int(8), 3, "3"),
    "l": (m.Int(64), 6, "6"),
    "d": (m.Double(), 1.5, "1.5"),
    "t": (m.Text(), "t", '"t"'),
    "e": (COLOR, 1, '"Green"'),
    "g": (CODE, 0, "0"),
    "o": (m.Optional(m.Int()), 3, "3"),
    "od": (m.Optional(m.Double()), 2.5, "2.5"),
    "os": (m.Optional(LEAF), None, "null"),
    "om": (m.Omittable(m.Int()), m.Absent, None),
    "omo": (m.Omittable(m.Optional(m.Int())), m.Absent, None),
    "ome": (m.Omittable(m.Record("Nothing")), m.Absent, None),
    "v": (m.Vector(m.Int()), [1, 2], "[]"),
    "vl": (m.Vector(LEAF), [{"x": 1}, {"x": 2}], "[]"),
    "vo": (m.Vector(m.Omittable(m.Int())), [], "[]"),
    "f": (m.Fixed(m.Int(), 2), [8, 9], "[8,9]"),
    "mp": (m.Map(m.Int()), {"k": 1}, "{}"),
    "ml": (m.Map(LEAF), {}, "{}"),
    "mo": (m.Map(m.Omittable(m.Int())), {}, "{}"),
    "n": (LEAF, None, '{"x":7}'),
    "bx": (BOX, None, '{"v":[],"y":2}'),
    "w": (m.Raw(), "first", '"first"'),
    "vw": (m.Vector(m.Raw()), [], "[]"),
    "mw": (m.Map(m.Raw()), {}, "{}"),
    "ow": (m.Optional(m.Raw()), None, "null"),
    "omw": (m.Omittable(m.Raw()), m.Absent, None),
    "s": (SHAPE, None, "null"),
    "p": (PART, None, "null"),
    "fr": (FRAME, None, "null"),
    "vp": (m.Vector(SAID), [], "[]"),
}


def _rule(changes: dict[str, list[tuple[str, str | None]]]) -> list[tuple[str, str]]:
    """Cases of one record type each document of which sets one field: the document, and the whole record saved."""
    out = []
    for name, each in changes.items():
        for text, want in each:
            held = {k: t for k, (_, _, t) in FIELDS.items()} | {name: want}
            out.append((f'{{"{name}":{text},"unknown":[@n]}}', "{" + ",".join(f'"{k}":{held[k]}' for k in sorted(held) if held[k] is not None) + "}"))
    return out


def _loaded(df: DataFrame) -> DataFrame:
    fields = {k: (t, start) if start is not None else t for k, (t, start, _) in FIELDS.items()}
    t = m.record("Every", **fields)
    return overlay.loaded(df, t, "text", "r").withColumn("got", overlay.save(t, F.col("r")))


@cases(
    _rule(
        {
            "b": [("null", "true"), ("@n", "true"), ('"false"', "true"), ("false", "false")],
            "i": [("null", "5"), ('"@n"', "5"), ("true", "5"), ("4@n", "4@n"), ("4@n.9", "4@n"), ("-4@n.9", "-4@n"), ("4294967297", "1"), ("1e2", "100"), ("1e999", "5")],
            "i8": [("257", "1"), ("-129", "127")],
            "l": [("9007199254740993", "9007199254740993"), ("2.5e3", "2500")],
            "d": [("null", "1.5"), ("4@n", "4@n"), ('"@n"', "1.5"), ("0.1", "0.1"), ("1e999", "null")],
            "t": [("null", '"t"'), ("@n", '"t"'), ('"a\\n@s"', '"a\\n@s"')],
        }
    )
)
def record_scalars(df):
    """Scalar slots: unknown keys are ignored; null and wrong kinds keep the prior; doubles are cut for integers."""
    return _loaded(df)


@cases(
    _rule(
        {
            "e": [("null", '"Green"'), ('"Red"', '"Red"'), ('"Deep"', '"Deep"'), ('"@s"', '"Green"'), ("0", '"Red"'), ("-2", '"Deep"'), ("9@n", "9@n"), ('"0"', '"Green"'), ("true", '"Green"')],
            "g": [('"low"', "-1"), ('"high"', "4"), ('"-1"', "-1"), ("4@n", "4@n"), ('"4@n"', "4@n"), ('"@s"', "0"), ('"+1"', "0"), ('" 1"', "0"), ("null", "0")],
            "o": [("null", "null"), ('"@s"', "0"), ("4@n", "4@n")],
            "od": [("null", "null"), ("1e999", "null"), ("4@n.5", "4@n.5")],
            "os": [("null", "null"), ("{}", '{"x":7}'), ('{"x":4@n}', '{"x":4@n}'), ("@n", '{"x":7}')],
            "om": [("null", "0"), ('"@s"', "0"), ("4@n", "4@n")],
            "omo": [("null", "null"), ("4@n", "4@n"), ('"@s"', "0")],
            "ome": [("{}", "{}"), ("null", "{}")],
        }
    )
)
def record_enums_and_absence(df):
    """Enums by name, number and digits; optionals are emptied by null and engaged by anything else; omittables know absent, null and value."""
    return _loaded(df)


@cases(
    _rule(
        {
            "v": [("null", "[]"), ('"@s"', "[]"), ("[]", "[]"), ('[4@n,"x",null,6]', "[4@n,2,0,6]")],
            "vl": [('[{},{"x":4@n},{}]', '[{"x":1},{"x":4@n},{"x":7}]'), ("{}", "[]")],
            "vo": [("[1,null,@n]", "[1,0,@n]")],
            "f": [("null", "[8,9]"), ("[4@n]", "[4@n,9]"), ("[1,4@n,3]", "[1,4@n]"), ('["x",4@n]', "[8,4@n]")],
            "mp": [("null", "{}"), ('{"z":4@n,"a":"x"}', '{"a":0,"z":4@n}'), ('{"@s":1}', '{"@s":1}')],
            "ml": [('{"q":{},"p":{"x":4@n}}', '{"p":{"x":4@n},"q":{"x":7}}')],
            "mo": [('{"q":null,"p":4@n}', '{"p":4@n,"q":0}')],
            "n": [("null", '{"x":7}'), ('{"x":4@n}', '{"x":4@n}'), ("@n", '{"x":7}')],
            "bx": [("{}", '{"v":[],"y":2}'), ('{"om":null}', '{"om":0,"v":[],"y":2}'), ('{"v":[4@n],"y":"@s"}', '{"v":[4@n],"y":2}')],
        }
    )
)
def record_containers(df):
    """Vectors and maps are replaced, fixed arrays and records overlaid, elements in place."""
    return _loaded(df)


@cases(
    _rule(
        {
            "w": [("null", "null"), ("{}", "{}"), ("[]", "[]"), ('{"b":1.5,"a":[@n,"@s"]}', '{"a":[@n,"@s"],"b":1.5}'), ("9007199254740993", "9007199254740993"), ("1e999", "null")],
            "vw": [("[null,[],{},@n]", "[null,[],{},@n]"), ("null", "[]")],
            "mw": [('{"q":null,"p":[@n]}', '{"p":[@n],"q":null}')],
            "ow": [("null", "null"), ("[@n]", "[@n]")],
            "omw": [("null", "null"), ('"@s"', '"@s"')],
            "s": [("null", "null"), ('{"Disc":{"r":4@n}}', '{"Disc":{"r":4@n}}'), ('{"Disc":{},"Bar":{"s":4@n}}', '{"Bar":{"s":4@n}}'), ('{"Other":@n}', "null"), ('{"A":1,"Disc":{}}', "null")],
            "p": [('{"type":2,"label":"@s"}', '{"label":"@s","type":2}'), ('{"type":"3"}', '{"id":"","type":3}'), ('{"type":2.5}', '{"label":"","type":2}'), ('{"type":9}', "null"), ("{}", "null"), ("[2]", "null"), ('{"type":" 2"}', "null")],
            "fr": [('{"op":"Pong","n":4@n}', '{"n":4@n,"op":"Pong"}'), ('{"op":1,"n":4@n,"op2":0}', '{"n":4@n,"op":"Ping"}'), ('{"op":"2"}', '{"n":0,"op":"Pong"}'), ('{"op":"Peng"}', "null")],
            "vp": [('[{"kind":"text","body":"@s"},{"kind":5},{"kind":"5"}]', '[{"body":"@s","kind":"text"},null,{"body":"","kind":"5"}]')],
        }
    )
)
def record_raw_and_unions(df):
    """Raw slots word for word; unions by first key or by tag, the first registration wins, a tag beats an arm's own field; vectors of unions."""
    return _loaded(df)


@cases([('{"w":5@n}', "BIGINT"), ('{"w":5@n.0}', "DOUBLE"), ('{"w":1e3}', "DOUBLE"), ('{"w":1e999}', "DOUBLE"), ('{"w":9223372036854775807}', "BIGINT"), ('{"w":9223372036854775808}', "DOUBLE"), ('{"w":{}}', "OBJECT<>"), ('{"w":null}', "VOID"), ("{}", "STRING"), ('{"w":[1,2.0]}', "ARRAY<DOUBLE>"), ('{"w":{"@s":1.0}}', "OBJECT<@s: DOUBLE>")])
def raw_number_kinds(df):
    """What is held in a raw slot keeps its kind."""
    t = m.record("Held", w=(m.Raw(), "first"))
    return overlay.loaded(df, t, "text", "r").withColumn("got", F.schema_of_variant("r.w"))


@cases([("{}", "gone|9|reset|{}"), ('{"a":null}', "held|0|reset|{\"a\":0}"), ('{"a":4@n}', "held|4@n|reset|{\"a\":4@n}")])
def omittable_helpers(df):
    """Presence, value or another, reset, emplaced and equality of omittable columns."""
    t = m.record("Patch", a=m.Omittable(m.Int()))
    df = overlay.loaded(df, t, "text", "r").withColumn("a", F.col("r.a"))
    none = overlay.reset(F.col("a"))
    told = F.when(overlay.same(F.col("a"), overlay.emplaced(F.lit(1))) | overlay.has(none) | ~overlay.same(none, none), "wrong").otherwise("reset")
    return df.withColumn("got", F.concat_ws("|", F.when(overlay.has(F.col("a")), "held").otherwise("gone"), overlay.value_or(F.col("a"), F.lit(9)).cast("string"), told, overlay.save(t, F.col("r"))))


XML = [
    ("<a x='1' x='@n'/>", '<a x="1"/>'),
    ("<a> <b/> @s </a>", "<a><b/></a>"),
    ("<a>  @s  </a>", "<a>  @s  </a>"),
    ("<n:a.b-c_1 y='@n' x=\"@s\"/>", '<n:a.b-c_1 x="@s" y="@n"/>'),
    ("<a>&#65;&#x1F600;&lt;&amp;@s</a >", "<a>A😀&lt;&amp;@s</a>"),
    ("<a b='&quot;&apos;&gt;'/>", '<a b="&quot;&apos;&gt;"/>'),
    ("<a>x<!-- @s -->y<?p q?>z</a>", "<a>xyz</a>"),
    ("<?xml version='1.0'?><a></a>", "<a/>"),
    ("<é/>", "!"),
    ("<a>&#0;</a>", "!"),
    ("<a>&#xD800;</a>", "!"),
    ("<a>&#x110000;</a>", "!"),
    ("<a>&@s;</a>", "!"),
    ("<a></b>", "!"),
    ("<a/><b/>", "!"),
    ("<a x='<'/>", "!"),
    ("<a x=1/>", "!"),
    ("<a", "!"),
    ("<a><![CDATA[@s]]></a>", "!"),
    ("<!DOCTYPE a><a/>", "!"),
    ("<a><!-- @s", "!"),
]


@cases(XML)
def xml_grammar(df):
    """The XML subset: attributes, text, references, comments, names, errors."""
    return df.withColumn("got", F.coalesce(xmltext.xml_print(F.col("text")), F.lit("!")))


THING = m.record("Thing", name=m.Text(), on=m.Bool(), k=(m.Int(), 4), ratio=m.Double(), n=LEAF, v=m.Vector(m.Int()), vv=m.Vector(m.Vector(m.Int())), mp=m.Map(m.Int()), ms=m.Map(LEAF), o=m.Optional(m.Int()), oi=m.Optional(LEAF), om=m.Omittable(m.Int()), ov=m.Omittable(m.Vector(m.Int())))


def _thing(**changes: str) -> str:
    held = {"name": '""', "on": "false", "k": "4", "ratio": "0", "n": '{"x":7}', "v": "[]", "vv": "[]", "mp": "{}", "ms": "{}", "o": "null", "oi": "null"} | changes
    return "{" + ",".join(f'"{k}":{held[k]}' for k in sorted(held)) + "}"


@cases(
    [
        ("<Thing/>", _thing()),
        ('<Thing name="@s" on="1" k="4@n" ratio="0.5"/>', _thing(name='"@s"', on="true", k="4@n", ratio="0.5")),
        ('<Thing on="yes" k="12x" ratio="2z"><unknown a="1"/></Thing>', _thing(on="false", k="12", ratio="2")),
        ('<Thing k="junk"/>', _thing(k="0")),
        ("<Thing><v>1</v><v>4@n</v><vv><item>1</item><item>2</item></vv><vv><item>3</item></vv></Thing>", _thing(v="[1,4@n]", vv="[[1,2],[3]]")),
        ('<Thing><n x="4@n"/><mp z="1" a="4@n"/><ms><q x="2"/><p/></ms></Thing>', _thing(n='{"x":4@n}', mp='{"a":4@n,"z":1}', ms='{"p":{"x":7},"q":{"x":2}}')),
        ('<Thing o="4@n"><oi/></Thing>', _thing(o="4@n", oi='{"x":7}')),
        ('<Thing om="4@n"><ov>1</ov></Thing>', _thing(om="4@n", ov="[1]")),
    ]
)
def xml_loads(df):
    """Records from XML: attributes, children, siblings; texts read by their beginnings; absent stays absent."""
    df = df.withColumn("json", xmlmap.xml_document(THING, F.col("text")))
    return overlay.loaded(df, THING, "json", "r").withColumn("got", overlay.save(THING, F.col("r")))


@cases(
    [
        ("{}", '<Thing k="4" name="" on="false" ratio="0"><n x="7"/><mp/><ms/><oi/></Thing>'),
        ('{"name":"a<@s\\"","on":true,"ratio":0.3333333333333333,"v":[1,4@n],"vv":[[1],[2,3]]}', '<Thing k="4" name="a&lt;@s&quot;" on="true" ratio="0.333333"><n x="7"/><v>1</v><v>4@n</v><vv><item>1</item></vv><vv><item>2</item><item>3</item></vv><mp/><ms/><oi/></Thing>'),
        ('{"mp":{"k":4@n},"ms":{"q":{"x":1}},"o":4@n,"om":1,"ratio":1e15}', '<Thing k="4" name="" o="4@n" om="1" on="false" ratio="1e+15"><n x="7"/><mp k="4@n"/><ms><q x="1"/></ms><oi/></Thing>'),
    ]
)
def xml_saves(df):
    """Records as XML: scalars are attributes, arrays siblings; empty optionals, and what is absent."""
    df = overlay.loaded(df, THING, "text", "r").withColumn("saved", overlay.save(THING, F.col("r")))
    return df.withColumn("got", xmltext.xml_print(xmlmap.xml_saved(THING, F.col("saved"))))


@cases([("Ns::A<B>", "Ns_A_B"), ("a__b@s", "a__b@s"), ("@n9x", "x"), ("_lead_", "lead"), ("(anonymous namespace)::T@n", "T@n"), ("a::_b", "a__b"), ("a<>::c", "a_c"), ("9", "")])
def text_identifiers(df):
    """Qualified and templated names as identifiers."""

    @F.pandas_udf("string")
    def run(names):
        return names.map(strings.sanitized)

    return df.withColumn("got", run(F.col("text")))


@query("""select n_nationkey as id, 'A' || repeat(chr(93507), n_nationkey + 1) || chr(7305) || chr(7306) || chr(769) || chr(1632) || '_+' || chr(8232) || chr(1) || chr(124112) as text,
cast(n_nationkey + 5 as bigint) as letter, cast(1 as bigint) as mark, cast(1 as bigint) as number, cast(1 as bigint) as punctuation, cast(1 as bigint) as symbol, cast(1 as bigint) as separator, cast(1 as bigint) as other from nation""")
def text_classes_of_new_letters(spark, sf_dir):
    """Major classes of characters that are newer than the JVM's tables."""
    new = F.concat(F.lit("A"), F.repeat(F.lit("\U00016d43"), F.col("n_nationkey") + 1), F.lit("Ᲊᲊ́٠_+ \x01\U0001e4d0"))
    df = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("id"), new.alias("text"))
    return df.select("id", "text", *[unicode16.class_count(F.col("text"), c).alias(c) for c in unicode16.CLASSES])


@query("select n_nationkey as id, n_name as name, case when n_nationkey % 3 = 0 then null else n_nationkey end as k, '{\"k\":' || case when n_nationkey % 3 = 0 then 'null' else cast(n_nationkey as varchar) end || ',\"name\":\"' || n_name || '\"}' as object, '[' || n_nationkey || ',' || n_regionkey || ']' as list, case when n_nationkey % 2 = 0 then 'DOUBLE' else 'BIGINT' end as wide, 'BIGINT' as whole from nation")
def json_values_of_columns(spark, sf_dir):
    """Values made from columns: records, arrays, nulls, unsigned integers beyond 64 signed bits."""
    k = F.when(F.col("n_nationkey") % 3 != 0, F.col("n_nationkey"))
    df = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), k.alias("k"), "n_regionkey")
    t = m.record("Row", k=m.Optional(m.Int()), name=m.Text())
    wide = F.when(F.col("id") % 2 == 0, F.lit("18446744073709551615")).otherwise("12").cast("decimal(20,0)")
    return df.select(
        "id",
        "name",
        "k",
        jsontext.json_print(F.to_json(overlay.value_of(t, F.struct("k", "name")))).alias("object"),
        jsontext.json_print(F.to_json(values.of(F.array("id", "n_regionkey")))).alias("list"),
        F.schema_of_variant(values.of(wide, unsigned=True)).alias("wide"),
        F.schema_of_variant(values.of(F.col("id"))).alias("whole"),
    )


@query("""select o_orderkey, case when x = floor(x) and abs(x) < 9.2e18 then cast(cast(x as bigint) as varchar) when cast(printf('%.15g', x) as double) = x then printf('%.15g', x) when cast(printf('%.16g', x) as double) = x then printf('%.16g', x) else printf('%.17g', x) end as text
from (select o_orderkey, o_totalprice * case o_orderkey % 5 when 0 then 1e-7 when 1 then 1.0 when 2 then 100.0 when 3 then 1e20 else 0.333 end as x from orders)""")
def json_doubles(spark, sf_dir):
    """Doubles of all sizes, printed with as few digits as read back."""
    x = F.col("o_totalprice") * F.element_at(F.array(*[F.lit(f) for f in (1e-7, 1.0, 100.0, 1e20, 0.333)]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    t = m.record("D", x=m.Double())
    df = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", overlay.save(t, F.struct(x.alias("x"))).alias("d"))
    return df.select("o_orderkey", F.regexp_extract("d", r"\{.x.:(.*)\}", 1).alias("text"))


# Commands and events: a case is a script, its outcome what was answered or sent.

ADD, SUM = m.record("Add", a=(m.Int(), 1), more=m.Vector(m.Int()), hue=COLOR), m.record("Sum", total=m.Int(64), hue=COLOR)


def _add(request) -> dict:
    return {"total": request["a"] + sum(request["more"]), "hue": request["hue"]}


def _note(request) -> None:
    return None


def _fails(request) -> dict:
    raise RuntimeError("no luck")


def _later(request, completer: Completer) -> None:
    completer.resolve(request)
    completer.resolve("again")
    completer.reject("late")


def _dropped(request, completer: Completer) -> None:
    return None


def _refused(request, completer: Completer) -> None:
    completer.reject("refused")


def _table() -> CommandTable:
    files, api, table = Api(), Api(), CommandTable()
    files.command("list")(lambda: "listed")
    for name, call, types in (("add", _add, (ADD, SUM)), ("note", _note, ()), ("fails", _fails, ()), ("later", _later, ()), ("dropped", _dropped, ()), ("refused", _refused, ()), ("twice", _fails, ()), ("twice", _note, ())):
        api.command(name, *types)(call)
    outer = Api.of(inner=files)
    api.use("outer", outer)
    api.bind(table)
    return table


def _outcome(table: CommandTable, line: str) -> str:
    how, name, payload = line.split(" ", 2)
    if how == "has":
        return str(table.has(name)).lower()
    held = jsontext.parse_or_null(payload)
    try:
        return jsontext.dump(table.dispatch(name, held) if how == "now" else table.dispatch_async(name, held).result(10))
    except Exception as e:  # the outcome is what is asked for
        return f"{type(e).__name__}: {e.args[0]}"


@cases(
    [
        ('now add {"hue":-2}', '{"hue":"Deep","total":1}'),
        ("now add null", '{"hue":"Red","total":1}'),
        ("now add junk", '{"hue":"Red","total":1}'),
        ("now note {}", "null"),
        ("now twice @n", "null"),
        ("now outer.inner.list null", '"listed"'),
        ("now later @n", "RuntimeError: later answers later only"),
        ("now fails {}", "RuntimeError: no luck"),
        ("now @s {}", "UnknownCommand: @s"),
        ("later add null", '{"hue":"Red","total":1}'),
        ('later later [@n,"@s"]', '[@n,"@s"]'),
        ("later dropped {}", "RuntimeError: the command was dropped without an answer"),
        ("later refused {}", "RuntimeError: refused"),
        ("later fails {}", "RuntimeError: no luck"),
        ("has later -", "true"),
        ("has list -", "false"),
        ("has outer.inner.list -", "true"),
        ('now add {"a":10,"more":[1,"x",2],"hue":"Red","unknown":@n}', '{"hue":"Red","total":13}'),
    ]
)
def commands_outcomes(df):
    """Handlers of all shapes over declared requests, now and later: replaced, unknown, failing, dropped, refused, settled twice, prefixed."""

    @F.pandas_udf("string")
    def run(lines):
        table = _table()
        return lines.map(lambda line: _outcome(table, line))

    return df.withColumn("got", run(F.col("text")))


def _sent(script: str) -> str:
    """Runs a script of events over a bridge and tells what its transport was sent."""
    state, sent = {"n": 0}, []
    event, ref = ev.Event({"v": -1}), ev.RefEvent(lambda: dict(state))
    bridge = ev.Bridge()
    bridge.on_emit(lambda name, payload: sent.append(f"{name}={payload}"))
    Api.of(files=Api.of(changed=event), state=ref).bind(CommandTable(), bridge)
    stop = None
    for act in script.split(";"):
        verb, _, rest = act.strip().partition(" ")
        if verb == "publish":
            event.publish(jsontext.parse(rest)) if rest else event.publish()
        elif verb == "state":
            state["n"] = int(rest)
        elif verb == "fire":
            ref.publish()
        elif verb == "emit":
            bridge.emit(*rest.split(" ", 1))
        elif verb == "listen":
            stop = event.listen(lambda value: sent.append(f"heard {jsontext.dump(value)}"))
        elif verb == "stop":
            stop()
        elif verb == "close":
            bridge.close()
        elif verb == "snapshot":
            sent.append(f"snapshot {jsontext.dump(event.snapshot)}")
    return " ".join(sent)


@cases(
    [
        ("publish @n; publish; publish [1.0]", "files.changed=@n files.changed=@n files.changed=[1]"),
        ("publish", 'files.changed={"v":-1}'),
        ("fire; state 4@n; fire", 'state={"n":0} state={"n":4@n}'),
        ('publish "@s"; close; publish 9; snapshot', 'files.changed="@s" snapshot 9'),
        ("listen; publish @n; stop; publish 7", "files.changed=@n heard @n files.changed=7"),
        ("snapshot; publish @n; snapshot", 'snapshot {"v":-1} files.changed=@n snapshot @n'),
        ("emit own 1; publish 2; emit own 3", 'own="1" files.changed=2 own="3"'),
    ]
)
def events_sent(df):
    """Snapshots, events over outside state, listeners and their end, prefixed names, order of delivery."""

    @F.pandas_udf("string")
    def run(scripts):
        return scripts.map(_sent)

    return df.withColumn("got", run(F.col("text")))


@query("""select n_regionkey as seq, cast(n_nationkey as varchar) as item_key, '{"id":' || n_nationkey || ',"it''s":"' || n_name || '"}' as item from nation""")
def events_keyed(spark, sf_dir):
    """Keyed events: a row for each item of a collection, by its key."""
    item = m.record("Item", id=m.Int(), its=(m.Text(), None, "it's"))
    batch = m.record("Batch", items=(m.Vector(item), None, "all items"))
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").groupBy("n_regionkey").agg(F.collect_list(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("its"))).alias("items"))
    events = nation.select(F.col("n_regionkey").alias("seq"), overlay.save(batch, F.struct("items")).alias("payload"))
    return ev.exploded(events, "all items", "id").select("seq", "item_key", "item")


@query("""select coalesce(e.name, d.name) as name, coalesce(e.payload, d.payload) as payload from (select event_type as name, arg_max(props, event_id) as payload from events where event_type <> 'view' group by 1) e
full join (values ('view', '{}'), ('click', '[]'), ('other', 'null')) d(name, payload) on e.name = d.name""")
def events_defaults(spark, sf_dir):
    """Default payloads of names without an event."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").filter("event_type <> 'view'").select(F.col("event_id").alias("seq"), F.col("event_type").alias("name"), F.col("props").alias("payload"))
    return ev.with_defaults(ev.latest(rows), {"view": "{}", "click": "[]", "other": "null"}).select("name", "payload")


@query("""select item_key, max(seq) as seq, arg_max(item, seq) as item from (select o_orderkey as seq, cast(o_custkey as varchar) as item_key, o_orderstatus as item from orders) group by 1""")
def events_upserted(spark, sf_dir):
    """Newest row of each key; changes applied twice change nothing."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").cast("string").alias("item_key"), F.col("o_orderstatus").alias("item"))
    once = ev.upsert(rows.limit(0), rows)
    return ev.upsert(once, rows).select("item_key", "seq", "item")


@query("""select n_nationkey as k, 'load' as seen, '{"items":[{"tag":"save","x":' || n_nationkey || '},{"tag":"save","x":0}],"one":{"tag":"save","x":' || n_regionkey || '}}' as saved, '{"tag":"","x":' || n_regionkey || '}' as bare from nation""")
def record_options(spark, sf_dir):
    """Options of a load and of a save reach every nested slot that holds one, whatever the document says there; without options it has its default."""
    inner = m.record("Inner", x=m.Int(), seen=(m.Handed(m.Text(), "tag"), None, "tag"))
    outer = m.record("Outer", one=inner, items=m.Vector(inner))
    text = F.format_string('{"one":{"x":%d,"tag":"theirs"},"items":[{"x":%d,"tag":1},{}]}', "n_regionkey", "n_nationkey")
    df = overlay.loaded(spark.read.parquet(f"{sf_dir}/nation.parquet").withColumn("t", text), outer, "t", options={"tag": "load", "other": 1})
    return df.select(F.col("n_nationkey").alias("k"), F.element_at("record.items", 2)["seen"].alias("seen"), overlay.save(outer, F.col("record"), options={"tag": "save"}).alias("saved"), overlay.save(inner, F.col("record.one")).alias("bare"))


class _Halving(Values):
    """Arrays lose half of their items, nulls become zeros, omittables leave, enums step on, maps lose keys with an a; tags are noted."""

    def __init__(self):
        self.tags = []

    def null(self, slot):
        return 0

    def present(self, slot, here):
        return False

    def size(self, slot, n):
        return n // 2

    def keys(self, slot, held):
        return [k for k in held if "a" not in k]

    def enum(self, slot, held, name):
        return held + 4

    def value(self, slot, held):
        return held.upper() if isinstance(held, str) else held

    def alternative(self, slot, tag):
        self.tags.append(tag)


@query("""select n_nationkey as k, '{"h":"Blue","list":[' || n_nationkey || '],"map":{"b":2},"none":0,"t":"' || upper(n_name) || '","u":{"k":3,"x":' || n_regionkey || '}}' as saved, '3' as tags from nation""")
def record_values(spark, sf_dir):
    """Hooks at the slots of loaded values: nulls, omittables, array sizes, map keys, enums, primitives and unions' arms."""
    hue = m.Enum("Hue", (("Red", 0), ("Blue", 4)))
    arm = m.record("Arm", x=m.Int())
    held = m.record("Held", h=hue, list=m.Vector(m.Int()), map=m.Map(m.Int()), none=m.Optional(m.Int()), om=m.Omittable(m.Int()), t=m.Text(), u=m.Internal("k", ((2, arm), (3, arm))))

    @F.pandas_udf("saved string, tags string")
    def run(texts):
        out = []
        for text in texts:
            hooks = _Halving()
            left = visit(held, records.load(held, jsontext.parse(text), held.fresh()), hooks)
            out.append((jsontext.dump(records.save(held, left)), ",".join(map(str, hooks.tags))))
        return pd.DataFrame(out, columns=["saved", "tags"])

    text = F.format_string('{"h":"Red","list":[%d,2,3],"map":{"a":1,"b":2},"none":null,"om":1,"t":"%s","u":{"k":3,"x":%d}}', "n_nationkey", "n_name", "n_regionkey")
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("k"), run(text).alias("r")).select("k", "r.*")


# Exports: lines of each format over one model, against texts written down in `exported`.


def _exports(suffix: str, text: str) -> None:
    def run(spark, sf_dir: str) -> DataFrame:
        made = ex.export(exported.context())[f"forest{suffix}"]
        return spark.createDataFrame(list(enumerate(made.rstrip("\n").split("\n"))), "line int, text string")

    name = "export" + suffix.replace(".", "_")
    run.__name__, run.__doc__ = name, f"The model of `exported` as {suffix}."
    lines = ", ".join(f"({i}, {_quoted(x)})" for i, x in enumerate(text.strip("\n").split("\n")))
    QUERIES[name], SQL[name] = run, f"select cast(line as integer) as line, text from (values {lines}) t(line, text)"


for _suffix, _text in exported.TEXTS.items():
    _exports(_suffix, _text)
