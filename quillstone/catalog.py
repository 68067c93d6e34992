"""Queries of the document engine over the driver's tables, and their DuckDB equivalents.

Every query projects to plain types and names every computed column. Where SQL has no equivalent (exports, commands) there is none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone import conformance
from quillstone.functions import jsontext, strings, unicode16, values, xmltext
from quillstone.operators.commands import CommandTable
from quillstone.plans import model as m
from quillstone.plans import overlay, xmlmap
from quillstone.streaming import events as ev

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# JSON


@query("select event_type, cast(sum(cast(json_extract_string(props, '$.k') as bigint)) as bigint) as s, count(*) as n from events group by event_type")
def json_field_sum(spark, sf_dir):
    """A field of JSON documents, aggregated; plain documents are parsed and read in the JVM."""
    field = values.as_integer(values.find(values.parsed(F.col("props")), "k"))
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(field).alias("s"), F.count(F.lit(1)).alias("n"))


@query("select event_id, cast(json(props) as varchar) as canonical from events")
def json_canonical(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", jsontext.json_print(F.col("props")).alias("canonical"))


@query("select event_id, '{' || chr(10) || '  \"k\": ' || json_extract_string(props, '$.k') || chr(10) || '}' as printed from events")
def json_indented(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", jsontext.json_print(F.col("props"), 2).alias("printed"))


@query("select event_id, false as ok, cast(null as varchar) as canonical, cast(strlen(props) as integer) + 1 as position, 'null' as tolerant from events")
def json_rejects(spark, sf_dir):
    """Text behind the document is an error with a byte position; the tolerant parse gives null."""
    text = F.concat("props", F.lit(" x"))
    df = read(spark, sf_dir, "events").select("event_id", jsontext.json_parse(text).alias("p"), jsontext.json_tolerant(text).alias("tolerant"))
    return df.select("event_id", "p.ok", "p.canonical", "p.position", "tolerant")


@query("select event_id, '{\"k\":' || json_extract_string(props, '$.k') || ',\"z\":1000}' as canonical from events")
def json_comments_duplicates(spark, sf_dir):
    """Comments are white space, the first of duplicate keys counts, whole doubles print as integers."""
    text = F.concat(F.lit("/* head */"), F.replace("props", F.lit("}"), F.lit(', "z": 1e3, "k": -1} // tail')))
    return read(spark, sf_dir, "events").select("event_id", jsontext.json_print(text).alias("canonical"))


@query("select event_id, true as same, false as other from events")
def json_equality(spark, sf_dir):
    same = jsontext.json_equal(F.col("props"), F.replace("props", F.lit("}"), F.lit(".0}")))
    other = jsontext.json_equal(F.col("props"), F.replace("props", F.lit('"k"'), F.lit('"K"')))
    return read(spark, sf_dir, "events").select("event_id", same.alias("same"), other.alias("other"))


@query("""select doc_id, case when text is null then '{"t":null}' else '{"t":' || replace(replace(cast(to_json(replace(text, chr(127), chr(57344))) as varchar), chr(57344), chr(127)), '\\/', '/') || '}' end as printed from documents""")
def json_string_documents(spark, sf_dir):
    """Whole texts as JSON strings, quotes, backslashes and control characters included; other scripts stand as they are."""
    t = m.record("T", t=m.Text())
    return read(spark, sf_dir, "documents").select("doc_id", overlay.save(t, F.struct(F.col("text").alias("t"))).alias("printed"))


_KINDS = "select event_id, 'object' as root, 'number' as k, 'absent' as missing, true as whole, cast(json_extract_string(props, '$.k') as bigint) as as_int, cast(json_extract_string(props, '$.k') as double) as as_num, cast(null as varchar) as as_text, 1 as n_keys from events"


@query(_KINDS)
def json_value_kinds(spark, sf_dir):
    df = read(spark, sf_dir, "events").withColumn("v", values.parsed(F.col("props"))).withColumn("x", values.find(F.col("v"), "k"))
    x = F.col("x")
    return df.select(
        "event_id",
        values.kind(F.col("v")).alias("root"),
        values.kind(x).alias("k"),
        values.kind(values.find(F.col("v"), "zz")).alias("missing"),
        values.is_integer(x).alias("whole"),
        values.as_integer(x).alias("as_int"),
        values.as_number(x).alias("as_num"),
        values.as_string(x).alias("as_text"),
        F.size(values.object_keys(F.col("props"))).alias("n_keys"),
    )


@query("select event_id, case when event_id % 2 = 0 then '{}' else props end as payload, case when event_id % 3 = 0 then '{}' else props end as forced from events")
def json_payload_or_empty(spark, sf_dir):
    null = F.when(F.col("event_id") % 2 == 0, F.lit("null")).otherwise(F.col("props"))
    other = F.when(F.col("event_id") % 3 == 0, F.lit("[1]")).otherwise(F.col("props"))
    shown = lambda v: jsontext.json_print(F.to_json(v))
    df = read(spark, sf_dir, "events").withColumn("props", F.replace("props", F.lit(" "), F.lit("")))
    return df.select("event_id", shown(values.payload_or_empty(values.parsed(null))).alias("payload"), shown(values.to_object(values.parsed(other))).alias("forced"))


SQL["json_payload_or_empty"] = SQL["json_payload_or_empty"].replace("else props end", "else replace(props, ' ', '') end")


# Records

EVENT_TYPE = m.Enum("EventType", (("click", 0), ("view", 1), ("purchase", 2), ("signup", 3), ("error", 4)))
ORDER_STATUS = m.Enum("OrderStatus", (("O", 0), ("F", 1), ("P", 2)), integer=True)
NATION = m.record("Nation", key=m.Int(), name=m.Text())
REGION = m.record("Region", key=m.Int(), name=m.Text(), nations=m.Vector(NATION))
EVENT = m.record("Event", k=(m.Int(64), 5), missing=(m.Text(), "kept"), list=m.Vector(m.Int()), om=m.Omittable(m.Int()), opt=(m.Optional(m.Int()), 3))


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) as k, 'kept' as missing, 0 as n_list, false as om_present, 3 as opt from events")
def record_overlay(spark, sf_dir):
    """Fields over defaults: absent scalars stay, vectors clear, omittables reset."""
    df = overlay.loaded(read(spark, sf_dir, "events"), EVENT, "props", "r")
    return df.select("event_id", "r.k", "r.missing", F.size("r.list").alias("n_list"), F.col("r.om.present").alias("om_present"), "r.opt")


@query("select event_id, cast(case when event_id % 4 = 0 then 7 when event_id % 4 = 1 then 5 when event_id % 4 = 2 then 5 else event_id end as bigint) as k from events")
def record_prior(spark, sf_dir):
    """Absent, null, wrong kind and value over a prior of 5 (7 where the text is malformed and the prior differs)."""
    i = F.col("event_id") % 4
    text = F.when(i == 0, F.lit("{")).when(i == 1, F.lit('{"k":null}')).when(i == 2, F.lit('{"k":"1"}')).otherwise(F.concat(F.lit('{"k":'), "event_id", F.lit(".75}")))
    df = read(spark, sf_dir, "events").select("event_id", text.alias("t"), F.when(i == 0, 7).otherwise(5).cast("long").alias("p"))
    t = m.record("K", k=m.Int(64))
    return overlay.loaded(df, t, "t", "r", F.struct(F.col("p").alias("k"))).select("event_id", "r.k")


@query("""select r_regionkey, '{"key":' || r_regionkey || ',"name":"' || r_name || '","nations":[' || string_agg('{"key":' || n_nationkey || ',"name":"' || n_name || '"}', ',' order by n_nationkey) || ']}' as document
from region join nation on n_regionkey = r_regionkey group by r_regionkey, r_name""")
def record_nested_save(spark, sf_dir):
    nation = read(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")))).alias("nations"))
    df = read(spark, sf_dir, "region").join(nation, F.col("n_regionkey") == F.col("r_regionkey"))
    return df.select("r_regionkey", overlay.save(REGION, F.struct(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name"), "nations")).alias("document"))


@query("""select l_orderkey, '{"lines":[' || string_agg('{"n":' || l_linenumber || ',"part":' || l_partkey || '}', ',' order by l_linenumber, l_partkey) || '],"order":' || l_orderkey || '}' as document from lineitem group by l_orderkey""")
def record_order_documents(spark, sf_dir):
    """Order documents from lines; one shuffle on the order key."""
    line = m.record("Line", n=m.Int(), part=m.Int(64))
    order = m.record("Order", order=m.Int(64), lines=m.Vector(line))
    df = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("part")))).alias("lines"))
    return df.select("l_orderkey", overlay.save(order, F.struct(F.col("l_orderkey").alias("order"), "lines")).alias("document"))


@query("""select d.doc_id, case when l.doc_id is null then '{}' else '{"toxic":' || l.toxic || '}' end as patch, coalesce(l.toxic, -1) as toxic from documents d left join labels l using (doc_id)""")
def record_patch(spark, sf_dir):
    """Absent or a value: a patch document laid over a base."""
    patch, base = m.record("Label", toxic=m.Omittable(m.Int())), m.record("Label", toxic=(m.Int(), -1))
    df = read(spark, sf_dir, "documents").select("doc_id").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    held = F.struct(F.struct(F.col("toxic").isNotNull().alias("present"), F.col("toxic").cast("int").alias("value")).alias("toxic"))
    df = overlay.loaded(df.select("doc_id", overlay.save(patch, held).alias("patch")), patch, "patch", "p")
    return df.select("doc_id", "patch", overlay.patched(base, overlay.literal(base, base.fresh()), F.col("p")).getField("toxic").alias("toxic"))


@query("""select event_id, case event_type when 'click' then 0 when 'view' then 1 when 'purchase' then 2 when 'signup' then 3 when 'error' then 4 end as code,
'{"type":"' || event_type || '"}' as document from events""")
def enum_names(spark, sf_dir):
    t = m.record("E", type=EVENT_TYPE)
    text = F.concat(F.lit('{"type":"'), "event_type", F.lit('"}'))
    df = overlay.loaded(read(spark, sf_dir, "events").select("event_id", text.alias("t")), t, "t", "r")
    return df.select("event_id", F.col("r.type").alias("code"), overlay.save(t, F.col("r")).alias("document"))


@query("""select o_orderkey, case o_orderstatus when 'O' then 0 when 'F' then 1 when 'P' then 2 end as code, '{"s":' || case o_orderstatus when 'O' then 0 when 'F' then 1 when 'P' then 2 end || '}' as document from orders""")
def enum_integers(spark, sf_dir):
    """An integer-format enum reads names and digits and writes numbers."""
    t = m.record("S", s=ORDER_STATUS)
    named = F.concat(F.lit('{"s":"'), "o_orderstatus", F.lit('"}'))
    digits = F.concat(F.lit('{"s":"'), F.when(F.col("o_orderstatus") == "O", "0").when(F.col("o_orderstatus") == "F", "1").otherwise("2"), F.lit('"}'))
    df = read(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, named).otherwise(digits).alias("t"))
    return overlay.loaded(df, t, "t", "r").select("o_orderkey", F.col("r.s").alias("code"), overlay.save(t, F.col("r")).alias("document"))


BUY, SEEN = m.record("Buy", k=m.Int(64)), m.record("Seen", k=m.Int(64), note=m.Text())


@query("""select event_id, event_type in ('purchase', 'view') as handled, case when event_type = 'purchase' then '{"u":{"k":' || json_extract_string(props, '$.k') || ',"type":"purchase"}}'
when event_type = 'view' then '{"u":{"k":' || json_extract_string(props, '$.k') || ',"note":"","type":"view"}}' else '{"u":null}' end as document from events""")
def union_internal(spark, sf_dir):
    """A tag among the fields picks the arm."""
    t = m.record("Holder", u=m.Internal("type", (("purchase", BUY), ("view", SEEN))))
    text = F.concat(F.lit('{"u":'), F.replace("props", F.lit("}"), F.lit("")), F.lit(',"type":"'), "event_type", F.lit('"}}'))
    df = overlay.loaded(read(spark, sf_dir, "events").select("event_id", text.alias("t")), t, "t", "r")
    return df.select("event_id", F.col("r.u").isNotNull().alias("handled"), overlay.save(t, F.col("r")).alias("document"))


@query("""select conv_id, turn, case when role = 'user' then '{"m":{"user":{"n":' || length(text) || '}}}' when role = 'assistant' then '{"m":{"assistant":{"n":' || length(text) || '}}}' else '{"m":null}' end as document from conversations""")
def union_external(spark, sf_dir):
    arm = lambda n: m.record(n, n=m.Int())
    t = m.record("Turn", m=m.External((("user", arm("User")), ("assistant", arm("Assistant")))))
    text = F.concat(F.lit('{"m":{"'), "role", F.lit('":{"n":'), F.length("text"), F.lit("}}}"))
    df = overlay.loaded(read(spark, sf_dir, "conversations").select("conv_id", "turn", text.alias("t")), t, "t", "r")
    return df.select("conv_id", "turn", overlay.save(t, F.col("r")).alias("document"))


@query("select event_id, event_type, props as document from events where event_type = 'click'")
def raw_envelope(spark, sf_dir):
    """Two-pass decoding: the envelope's `op` says what its raw `d` holds."""
    t = m.record("Frame", op=m.Text(), d=m.Raw())
    text = F.concat(F.lit('{"op":"'), "event_type", F.lit('","d":'), "props", F.lit("}"))
    df = overlay.loaded(read(spark, sf_dir, "events").select("event_id", text.alias("t")), t, "t", "r").filter(F.col("r.op") == "click")
    return df.select("event_id", F.col("r.op").alias("event_type"), jsontext.json_print(F.to_json("r.d")).alias("document"))


SQL["raw_envelope"] = SQL["raw_envelope"].replace("props as", "replace(props, ' ', '') as")


# XML


@query("""select page_id, false as ok, case when html is null then null when regexp_matches(html, '^[ \\t\\r\\n]*<!') then cast(strlen(regexp_extract(html, '^[ \\t\\r\\n]*<')) as integer) end as position from pages""")
def xml_rejects(spark, sf_dir):
    """Web pages begin with a declaration outside the subset: an error just behind its bracket."""
    df = read(spark, sf_dir, "pages").select("page_id", xmltext.xml_parse(F.col("html")).alias("p"))
    return df.select("page_id", "p.ok", "p.position")


@query("""select c_custkey, '<Customer key="' || c_custkey || '" name="' || c_name || '"><segment>' || c_mktsegment || '</segment></Customer>' as xml, c_name as name, c_mktsegment as segment from customer""")
def xml_records(spark, sf_dir):
    """Records written as XML, printed, and read back."""
    t = m.record("Customer", key=m.Int(64), name=m.Text(), segment=m.Vector(m.Text()))
    body = F.struct(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.array("c_mktsegment").alias("segment"))
    df = read(spark, sf_dir, "customer").select("c_custkey", xmlmap.xml_saved(t, overlay.save(t, body)).alias("xml"))
    df = overlay.loaded(df.withColumn("json", xmlmap.xml_document(t, F.col("xml"))), t, "json", "r")
    return df.select("c_custkey", "xml", "r.name", F.col("r.segment")[0].alias("segment"))


@query("""select n_nationkey, '<n k="' || n_nationkey || '">' || chr(10) || '  <a>' || n_name || ' &amp; &lt;</a>' || chr(10) || '</n>' as printed from nation""")
def xml_print(spark, sf_dir):
    text = F.concat(F.lit("<?xml version='1.0'?><!-- c --><n k='"), "n_nationkey", F.lit("'><a>"), "n_name", F.lit(" &#38; &lt;</a></n>"))
    return read(spark, sf_dir, "nation").select("n_nationkey", xmltext.xml_print(text, 2).alias("printed"))


# Text


@query(r"select doc_id, cast(length(regexp_replace(text, '[^\p{L}]', '', 'g')) as bigint) as letters, cast(length(regexp_replace(text, '[^\p{N}]', '', 'g')) as bigint) as numbers, cast(length(regexp_replace(text, '[^\p{P}]', '', 'g')) as bigint) as punctuation from documents")
def text_class_counts(spark, sf_dir):
    """Native counts by major class."""
    c = F.col("text")
    return read(spark, sf_dir, "documents").select("doc_id", *[unicode16.class_count(c, n).alias(a) for n, a in (("letter", "letters"), ("number", "numbers"), ("punctuation", "punctuation"))])


_CATEGORIES = " union all ".join(rf"select '{c}' as category, length(regexp_replace(text, '[^\p{{{c}}}]', '', 'g')) as n from documents" for c in unicode16.NAMES if c not in ("Cs", "Cn"))


@query(f"select category, cast(sum(n) as bigint) as n from ({_CATEGORIES}) group by category having sum(n) > 0")
def text_categories(spark, sf_dir):
    """Exact Unicode 16 categories over all texts."""
    counts = read(spark, sf_dir, "documents").select(F.explode(unicode16.category_counts(F.col("text"))).alias("c")).select("c.*")
    return counts.groupBy("category").agg(F.sum("n").alias("n"))


@query("select doc_id, cast(strlen(text) as bigint) as bytes, cast(length(text) as bigint) as characters, cast(case when text = '' then null else unicode(text) end as integer) as first_point, sha256(text) as again from documents")
def text_utf8(spark, sf_dir):
    """Characters decoded from bytes one by one, against the text's own lengths, and encoded again."""
    df = read(spark, sf_dir, "documents").select("doc_id", unicode16.utf8_again(F.encode("text", "UTF-8")).alias("u"))
    return df.select("doc_id", "u.bytes", "u.characters", "u.first_point", F.sha2("u.again", 256).alias("again"))


@query("select cast(c as bigint) as code_point from range(0, 1114112) t(c) where c between 9 and 13 or c in (32, 133, 160, 5760) or c between 8192 and 8202 or c in (8232, 8233, 8239, 8287, 12288)")
def text_white_space(spark, sf_dir):
    return spark.range(unicode16.LIMIT).filter(unicode16.is_white_space(F.col("id"))).select(F.col("id").alias("code_point"))


@query(r"""select p_partkey, regexp_matches(p_name, '^[A-Za-z_][A-Za-z0-9_]*$') as is_ident, cast(len(string_split(p_type, ' ')) as integer) as n_parts, replace(p_type, ' ', '_') as joined, repeat(' ', 2 * p_size) as indent, cast(p_size as bigint) as parsed, cast(null as bigint) as unparsed from part""")
def text_strings(spark, sf_dir):
    df = read(spark, sf_dir, "part")
    size = F.col("p_size").cast("string")
    return df.select(
        "p_partkey",
        strings.is_identifier(F.col("p_name")).alias("is_ident"),
        F.size(strings.split_on(F.col("p_type"), " ")).alias("n_parts"),
        strings.replace_all(F.col("p_type"), " ", "_").alias("joined"),
        strings.make_indent(2, F.col("p_size")).alias("indent"),
        strings.parse_whole_integer(strings.trim_ascii(F.concat(F.lit(" \t"), size, F.lit("\r\n")))).alias("parsed"),
        strings.parse_whole_integer(F.concat(F.lit("+"), size)).alias("unparsed"),
    )


# Commands, events, exports


def _double(request) -> dict:
    return {"k": 2 * request["k"]}


@query("""select event_id, event_type in ('click', 'view') as ok, case when event_type = 'click' then '{"k":' || 2 * cast(json_extract_string(props, '$.k') as bigint) || '}' when event_type = 'view' then 'null' end as response,
case when event_type not in ('click', 'view') then 'unknown command ' || event_type end as error from events""")
def commands_rows(spark, sf_dir):
    t = CommandTable()
    t.on("click", _double, {"k": 0})
    t.on("view", _nothing)
    return read(spark, sf_dir, "events").select("event_id", t.column(F.col("event_type"), F.col("props")).alias("r")).select("event_id", "r.*")


def _nothing(request) -> None:
    return None


@query("select event_type as name, arg_max(props, event_id) as payload, max(event_id) as seq from events group by event_type")
def events_snapshot(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("name"), F.col("props").alias("payload"))
    return ev.latest(rows)


@query("select 'app.' || event_type as name, count(*) as n from events group by 1")
def events_prefixed(spark, sf_dir):
    rows = ev.prefixed(read(spark, sf_dir, "events").select(F.col("event_type").alias("name")), "app")
    return rows.groupBy("name").agg(F.count(F.lit(1)).alias("n"))


def queries():
    return QUERIES | conformance.QUERIES


def oracle_sql():
    return SQL | conformance.SQL
