"""Records as XML: scalars are attributes, records and maps of records child elements, vectors repeated siblings.

Reading makes the JSON document that the element stands for under a type, so the overlay rules of JSON apply: what is missing is absent, and
XML has no null. Writing takes a record's JSON text.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstone.functions.jsontext import dump, parse
from quillstone.functions.xmltext import Node, XmlError, dump_xml, scalar_text, text_bool, text_float, text_int
from quillstone.functions.xmltext import parse as parse_xml
from quillstone.plans import model as m

ITEM = "item"


def _bare(t: m.Type) -> m.Type:
    while isinstance(t, m.Optional | m.Omittable):
        t = t.inner
    return t


def is_scalar(t: m.Type) -> bool:
    return isinstance(_bare(t), m.Bool | m.Int | m.Double | m.Text | m.Enum)


def _told(t: m.Type, value) -> str:
    """A double's text, though its document may spell it as an integer."""
    real = isinstance(_bare(t), m.Double) and isinstance(value, int) and not isinstance(value, bool)
    return scalar_text(float(value) if real else value)


def put(t: m.Type, parent: Node, name: str, value) -> None:
    """Writes a member into an element."""
    t = _bare(t)
    if isinstance(t, m.Vector | m.Fixed) or isinstance(value, list):
        inner = t.inner if isinstance(t, m.Vector | m.Fixed) else m.Raw()
        for x in value or []:
            child = Node(name)
            parent.children.append(child)
            if is_scalar(inner) or not isinstance(x, dict | list):
                child.text = "" if x is None else _told(inner, x)
            elif isinstance(_bare(inner), m.Vector | m.Fixed) or isinstance(x, list):
                put(inner, child, ITEM, x)
            else:
                fill(inner, child, x)
    elif is_scalar(t) or not isinstance(value, dict):
        if value is not None:
            parent.attributes[name] = _told(t, value)
        elif isinstance(t, m.Record):
            parent.children.append(Node(name))
    else:
        child = Node(name)
        parent.children.append(child)
        fill(t, child, value)


def fill(t: m.Type, node: Node, value: dict) -> None:
    t = _bare(t)
    if isinstance(t, m.Record):
        for f in t.fields:
            if f.wire in value:
                put(f.type, node, f.wire, value[f.wire])
    elif isinstance(t, m.Internal):
        arm = next((r for tag, r in t.arms if value.get(t.key) in (tag, t.enum.name_of(tag) if t.enum else tag)), None)
        known = {f.wire: f.type for f in arm.fields} if arm else {}
        for k, x in value.items():
            put(known.get(k, m.Raw()), node, k, x)
    else:
        inner = t.inner if isinstance(t, m.Map) else m.Raw()
        arms = dict(t.arms) if isinstance(t, m.External) else {}
        for k, x in value.items():
            put(arms.get(k, inner), node, k, x)


def _scalar(t: m.Type, text: str):
    t = _bare(t)
    if isinstance(t, m.Bool):
        return text_bool(text)
    if isinstance(t, m.Int):
        return text_int(text)
    return text_float(text) if isinstance(t, m.Double) else text


_MISSING = object()


def _whole(t: m.Type, node: Node):
    """An element as a value of a type."""
    t = _bare(t)
    if is_scalar(t):
        return _scalar(t, node.text)
    if isinstance(t, m.Vector | m.Fixed):
        return [_whole(t.inner, c) for c in node.children if c.name == ITEM]
    if isinstance(t, m.Record):
        return {f.wire: v for f in t.fields if (v := member(f.type, node, f.wire)) is not _MISSING}
    if isinstance(t, m.Map):
        keys = [*node.attributes, *dict.fromkeys(c.name for c in node.children if c.name not in node.attributes)]
        return {k: v for k in keys if (v := member(t.inner, node, k)) is not _MISSING}
    if isinstance(t, m.External):
        arms = dict(t.arms)
        return {c.name: _whole(arms.get(c.name, m.Raw()), c) for c in reversed(node.children)}
    if isinstance(t, m.Internal):
        tag = node.attributes.get(t.key, "")
        arm = next((r for g, r in t.arms if tag in (str(g), t.enum.name_of(g) if t.enum else str(g))), None)
        return (_whole(arm, node) if arm else {}) | {t.key: tag}
    if not node.attributes and not node.children:
        return node.text
    out = dict(node.attributes)
    for name in dict.fromkeys(c.name for c in node.children):
        same = [_whole(m.Raw(), c) for c in node.children if c.name == name]
        out.setdefault(name, same[0] if len(same) == 1 else same)
    return out


def member(t: m.Type, node: Node, name: str):
    """A member's value, or _MISSING."""
    bare = _bare(t)
    same = [c for c in node.children if c.name == name]
    if isinstance(bare, m.Vector | m.Fixed):
        return [_whole(bare.inner, c) for c in same] if same else _MISSING
    if is_scalar(bare):
        return _scalar(bare, node.attributes[name]) if name in node.attributes else _MISSING
    if isinstance(bare, m.Raw):
        if name in node.attributes:
            return node.attributes[name]
        return _MISSING if not same else _whole(bare, same[0]) if len(same) == 1 else [_whole(bare, c) for c in same]
    return _whole(bare, same[0]) if same else _MISSING


def to_xml(t: m.Record, value: dict, indent: int = 0) -> str:
    node = Node(t.name)
    fill(t, node, value)
    return dump_xml(node, indent)


def from_xml(t: m.Type, text: str) -> str:
    """The JSON text an XML text stands for; XmlError if it is none."""
    return dump(_whole(t, parse_xml(text)))


def xml_saved(t: m.Record, json_text: Column, indent: int = 0) -> Column:
    """XML of a column with a record's JSON text (see overlay.save)."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else to_xml(t, parse(x), indent) for x in texts], dtype=object)

    return run(json_text)


def xml_document(t: m.Type, xml: Column, strict: bool = True) -> Column:
    """JSON text of an XML column, to be loaded (see overlay.loaded). Malformed text is an error, or null if not strict."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for x in texts:
            try:
                out.append(None if x is None else from_xml(t, x))
            except XmlError:
                if strict:
                    raise
                out.append(None)
        return pd.Series(out, dtype=object)

    return run(xml)
