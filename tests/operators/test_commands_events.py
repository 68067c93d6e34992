import json
import threading

import pytest
from pyspark.sql import functions as F

from quillstone.operators.commands import Api, CommandTable, Completer, FrameCommands, UnknownCommand, describe
from quillstone.functions.jsontext import dump, parse
from quillstone.plans import export
from quillstone.plans import model as m
from quillstone.plans.overlay import loaded, save
from quillstone.plans.xmlmap import from_xml, to_xml, xml_document, xml_saved
from quillstone.streaming.events import Bridge, Event, RefEvent, exploded, latest, prefixed, push, upsert, with_defaults


def add(request) -> dict:
    return {"sum": request["a"] + request["b"]}


def ping() -> str:
    return "pong"


def note(request) -> None:
    return None


def fails(request) -> dict:
    raise RuntimeError("no luck")


def table() -> CommandTable:
    t = CommandTable()
    t.on("add", add, {"a": 1, "b": 2})
    t.on("ping", ping)
    t.on("note", note)
    t.on("fails", fails)
    return t


def test_dispatch():
    t = table()
    assert t.dispatch("add", {"a": 5, "x": 1}) == {"sum": 7} and t.dispatch("add") == {"sum": 3} and t.dispatch("add", {"a": "5"}) == {"sum": 3}
    assert t.dispatch("ping") == "pong" and t.dispatch("note", {}) is None and t.has("ping") and not t.has("x")
    with pytest.raises(UnknownCommand):
        t.dispatch("x")


def test_declared_requests(spark):
    """Requests of declared types, nested ones and unions too, are read as columns are."""
    from quillstone import conformance as c

    every = m.record("Every", **{k: (t, start) if start is not None else t for k, (t, start, _) in c.FIELDS.items()})
    t = CommandTable()
    t.on("echo", lambda request: request, every, every)
    df = c.QUERIES["record_raw_and_unions"](spark, "/root/testdata/sf0.001")
    assert df.count() and t.dispatch("echo", None) == json.loads(dump(t.dispatch("echo", {})))
    for name in ("record_scalars", "record_enums_and_absence", "record_containers", "record_raw_and_unions"):
        sent = {k: w for k, w in c.CASES[name]}
        for text, want in sent.items():
            assert dump(t.dispatch("echo", parse(text.replace("@n", "3").replace("@s", "N")))) == want.replace("@n", "3").replace("@s", "N"), text


def later(request, completer: Completer) -> None:
    completer.resolve(request)


def test_shapes_and_one_line_declarations():
    inner, event = Api.of(ping=ping), Event({"v": 0})
    api = Api.of(Api.of(note=note), add=add, later=later, changed=event, files=inner)
    assert [(k, n) for k, n, _ in api.walk()] == [("command", "note"), ("command", "add"), ("command", "later"), ("event", "changed"), ("command", "files.ping")]
    assert describe(ping) == (False, True, False) and describe(note) == (True, False, False) and describe(later) == (True, True, True)
    t = CommandTable()
    api.bind(t, Bridge())
    assert t.dispatch("files.ping") == "pong" and t.dispatch_async("later", 4).result(1) == 4
    leaf = m.record("Leaf", x=m.Int())
    api.command("typed", leaf, leaf)(add)
    ctx = api.described("made")
    assert [c.name for c in ctx.commands] == ["note", "add", "later", "files.ping", "typed"] and ctx.commands[-1].request == leaf and ctx.events[0].name == "changed"
    assert "typed" in export.export(ctx)["made.backend.ts"]


def test_async():
    t = table()
    t.on_async("later", lambda r, c: threading.Timer(0.05, lambda: (c.resolve(r["n"]), c.resolve("again"))).start(), {"n": 4})
    t.on_async("dropped", lambda r, c: None)
    assert t.dispatch_async("later").result(5) == 4 and t.dispatch_async("ping").result(1) == "pong"
    for name, text in (("dropped", "dropped"), ("fails", "no luck"), ("x", "x")):
        with pytest.raises(RuntimeError, match=text):
            t.dispatch_async(name).result(5)
    with pytest.raises(RuntimeError):
        t.dispatch("later")


def test_rows(spark):
    df = spark.createDataFrame([(1, "add", '{"a":2}'), (2, "add", "junk"), (3, "x", None), (4, "fails", "{}"), (5, "note", None)], "i int, name string, payload string")
    rows = df.select("i", table().column(F.col("name"), F.col("payload")).alias("r")).orderBy("i").collect()
    assert [tuple(r.r) for r in rows] == [(True, '{"sum":4}', None), (True, '{"sum":3}', None), (False, None, "unknown command x"), (False, None, "no luck"), (True, "null", None)]


def test_frames(spark):
    f = FrameCommands()
    f.on("up", lambda d: d.select(F.upper("payload").alias("out")))
    f.on("len", lambda d: d.select(F.length("payload").cast("string").alias("out")))
    df = spark.createDataFrame([("up", "a"), ("len", "abc")], "name string, payload string")
    assert sorted(r.out for r in f.dispatch(df).collect()) == ["3", "A"]
    with pytest.raises(Exception, match="unknown command zz"):
        f.dispatch(df.union(spark.createDataFrame([("zz", "")], df.schema))).collect()


def test_api_and_events():
    files, api, t, bridge, sent = Api(), Api(), CommandTable(), Bridge(), []
    files.command("list")(ping)
    state = {"n": 1}
    changed, ref = files.event("changed", Event({"v": 0})), api.event("state", RefEvent(lambda: dict(state)))
    api.use("files", files)
    bridge.on_emit(lambda n, p: sent.append((n, p)))
    api.bind(t, bridge)
    assert t.dispatch("files.list") == "pong" and [k for k in api.walk()][0][:2] == ("event", "state")
    changed.publish({"v": 1.0})
    changed.publish()
    state["n"] = 2
    ref.publish()
    bridge.close()
    changed.publish({"v": 9})
    assert sent == [("files.changed", '{"v":1}')] * 2 + [("state", '{"n":2}')] and changed.snapshot == {"v": 9} and bridge.current == ("state", '{"n":2}')


def test_snapshots(spark):
    df = spark.createDataFrame([(1, "a", '{"items":[{"id":1,"v":1},{"id":2,"v":1}]}'), (3, "a", '{"items":[{"id":1,"v":2}]}'), (2, "b", "{}")], "seq long, name string, payload string")
    assert {r.name: r.seq for r in latest(df).collect()} == {"a": 3, "b": 2}
    assert {r.name: r.payload for r in with_defaults(latest(df), {"b": "x", "c": "{}"}).collect() if r.name != "a"} == {"b": "{}", "c": "{}"}
    items = exploded(df, "items", "id")
    assert sorted((r.seq, r.item_key, r.item) for r in items.collect()) == [(1, "1", '{"id":1,"v":1}'), (1, "2", '{"id":2,"v":1}'), (3, "1", '{"id":1,"v":2}')]
    rows = items.select("seq", "item_key", "item")
    once = upsert(rows.limit(0), rows)
    assert {r.item_key: r.seq for r in upsert(once, rows).collect()} == {"1": 3, "2": 1}
    assert {r.name for r in prefixed(df, "p").collect()} == {"p.a", "p.b"}


def test_stream(spark, tmp_path):
    spark.range(20).selectExpr("id as seq", "concat('n', id % 3) as name", "cast(id as string) as payload").write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("seq long, name string, payload string").json(str(tmp_path / "in"))
    got = []
    q = push(stream, lambda batch, n: got.extend((r.seq, r.name) for r in batch.collect()), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert got == [(i, f"n{i % 3}") for i in range(20)]
    q = latest(stream).writeStream.format("memory").queryName("snap").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {r.name: r.payload for r in spark.table("snap").collect()} == {"n0": "18", "n1": "19", "n2": "17"}


INNER = m.record("Inner", x=(m.Int(), 7))
T = m.record("Thing", name=m.Text(), on=m.Bool(), ratio=m.Double(), n=INNER, v=m.Vector(m.Int()), vv=m.Vector(m.Vector(m.Int())), mp=m.Map(m.Int()), ms=m.Map(INNER), o=m.Optional(m.Int()), oi=m.Optional(INNER), om=m.Omittable(m.Vector(m.Int())))


def test_xml_mapping(spark):
    value = {"name": "a<b", "on": True, "ratio": 0.5, "n": {"x": 1}, "v": [1, 2], "vv": [[1, 2], [3]], "mp": {"k": 1}, "ms": {"q": {"x": 2}}, "o": None, "oi": None}
    xml = '<Thing name="a&lt;b" on="true" ratio="0.5"><n x="1"/><v>1</v><v>2</v><vv><item>1</item><item>2</item></vv><vv><item>3</item></vv><mp k="1"/><ms><q x="2"/></ms><oi/></Thing>'
    assert to_xml(T, value) == xml
    assert json.loads(from_xml(T, xml)) == {k: v for k, v in value.items() if k != "o"} | {"oi": {}}
    df = spark.createDataFrame([(xml,), ("<Thing on='yes' ratio='2z' name='q'><zz/></Thing>",)], "t string").withColumn("j", xml_document(T, F.col("t")))
    out = loaded(df, T, "j").select(save(T, F.col("record")).alias("s"), xml_saved(INNER, F.lit('{"x":3}')).alias("x")).collect()
    assert json.loads(out[0].s) == value | {"oi": {"x": 7}} and out[0].x == '<Inner x="3"/>'
    assert json.loads(out[1].s) == {"name": "q", "on": False, "ratio": 2, "n": {"x": 7}, "v": [], "vv": [], "mp": {}, "ms": {}, "o": None, "oi": None}
    with pytest.raises(Exception, match="XML parse error"):
        spark.createDataFrame([("<a",)], "t string").select(xml_document(T, F.col("t"))).collect()
