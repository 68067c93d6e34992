import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstone.functions import xmltext as x

BAD = ["", "a", "<a>", "<a></b>", "<a/><b/>", "<a b=c/>", "<a b='<'/>", "<a>&nope;</a>", "<a>&#0;</a>", "<a>&#xD800;</a>", "<a>&#x110000;</a>", "<a", "<a b", "<a b='", "<!DOCTYPE a><a/>", "<a><![CDATA[x]]></a>", "<a>&amp</a>", "<a/>x", "<!-- <a/>", "<?x <a/>", "<1/>", "<a b='1'c='2'/>"]


@pytest.mark.parametrize("text", BAD)
def test_rejects(text):
    with pytest.raises(x.XmlError):
        x.parse(text)


@pytest.mark.parametrize(
    ("text", "printed"),
    [
        ("<?xml version='1.0'?><!-- c --><a b='1' a=\"2\"/>", '<a a="2" b="1"/>'),
        ("<a>x &lt; y &#65;&#x1F600;</a >", "<a>x &lt; y A😀</a>"),
        ("<a> <b/> mixed </a>", "<a><b/></a>"),
        ("<a>  keep  </a>", "<a>  keep  </a>"),
        ("<a b='1' b='2'></a>", '<a b="1"/>'),
        ("<a b='&quot;&apos;&gt;'/>", '<a b="&quot;&apos;&gt;"/>'),
        ("<a>x<!-- c -->y<?p?>z</a>", "<a>xyz</a>"),
        ("<n:a.b-c_1/>", "<n:a.b-c_1/>"),
    ],
)
def test_prints(text, printed):
    assert x.dump_xml(x.parse(text)) == printed


def test_indent_and_find():
    n = x.parse("<a><b c='1'/><b/><d>t</d></a>")
    assert x.dump_xml(n, 2) == '<a>\n  <b c="1"/>\n  <b/>\n  <d>t</d>\n</a>'
    assert n.child("b").attribute("c") == "1" and n.child("z") is None and n.attribute("q") is None


def test_deep():
    text = "<a>" * 20_000 + "</a>" * 20_000
    assert len(x.dump_xml(x.parse(text))) > 100_000


def test_scalars():
    assert [x.scalar_text(v) for v in (True, 3, 2.0, 0.1, 1e15, 1 / 3, float("nan"))] == ["true", "3", "2", "0.1", "1e+15", "0.333333", "nan"]
    assert [x.text_int(t) for t in ("12x", "junk", " -3", "99999999999999999999")] == [12, 0, -3, 2**63 - 1]
    assert [x.text_float(t) for t in ("1.5z", "x", "-.5e1")] == [1.5, 0.0, -5.0] and x.text_bool("1") and not x.text_bool("True")


NAMES = st.from_regex(r"\A[A-Za-z_][A-Za-z0-9_.-]{0,5}\Z")
TEXTS = st.text(st.characters(min_codepoint=32, exclude_categories=["Cs"]), max_size=8)
NODES = st.recursive(st.builds(lambda n, a, t: x.Node(n, a, [], t), NAMES, st.dictionaries(NAMES, TEXTS, max_size=3), TEXTS), lambda c: st.builds(lambda n, a, k: x.Node(n, a, k, ""), NAMES, st.dictionaries(NAMES, TEXTS, max_size=3), st.lists(c, min_size=1, max_size=3)), max_leaves=8)


@settings(max_examples=150, deadline=None)
@given(NODES)
def test_round_trip(node):
    assert x.parse(x.dump_xml(node)) == node


def test_columns(spark):
    df = spark.createDataFrame([(1, "<a b='1'>t</a>"), (2, "<a>é</b>"), (3, None)], "i int, t string")
    rows = df.select("i", x.xml_parse(F.col("t")).alias("p"), x.xml_print(F.col("t"), 2).alias("r")).orderBy("i").collect()
    assert rows[0].p.tree == '{"attributes":{"b":"1"},"children":[],"name":"a","text":"t"}' and rows[0].r == '<a b="1">t</a>'
    assert (rows[1].p.ok, rows[1].p.position) == (False, 7) and rows[2].p.position is None
