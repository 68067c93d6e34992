"""Loading documents over records and saving records, as native expressions built from the model.

load(type, document, prior) reads a VARIANT slot over an earlier value. loaded() does so from JSON text: one strict parse, then one
projection. Each slot is bound once (`let`), so expressions grow with the type, not with a power of its depth. save(type, value)
writes canonical JSON text; it crosses into Python once, and only if the type holds doubles or raw JSON, whose text Spark writes
otherwise.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.jsontext import dump, json_print
from quillstone.functions.values import as_array, as_bool, as_number, as_object, as_string, find, is_integer, kind, parsed
from quillstone.plans import model as m


def literal(t: m.Type, value: Any) -> Column:
    """A default as a column of the type."""
    if isinstance(t, m.Omittable):
        absent = value is m.Absent
        return F.struct(F.lit(not absent).alias("present"), (F.lit(None).cast(t.inner.ddl()) if absent else literal(t.inner, value)).alias("value"))
    if isinstance(t, m.Raw):
        return F.parse_json(F.lit(dump(value)))
    if value is None:
        return F.lit(None).cast(t.ddl())
    if isinstance(t, m.Optional | m.Handed):
        return literal(t.inner, value)
    if isinstance(t, m.Vector | m.Fixed):
        return F.array(*[literal(t.inner, x) for x in value]).cast(t.ddl())
    if isinstance(t, m.Map):
        return F.create_map(*[c for k, x in value.items() for c in (F.lit(k), literal(t.inner, x))]).cast(t.ddl())
    if isinstance(t, m.Record):
        return F.struct(*[literal(f.type, value.get(f.name, f.start())).alias(f.name) for f in t.fields] or [F.lit(None).cast("boolean").alias("_")])
    return F.lit(value).cast(t.ddl())


def narrowed(n: Column, bits: int) -> Column:
    """The low bits of a 64-bit integer, sign extended."""
    return n if bits == 64 else F.shiftright(F.shiftleft(n, 64 - bits), 64 - bits).cast({8: "tinyint", 16: "smallint", 32: "int"}[bits])


def whole(v: Column) -> Column:
    """A number slot as 64-bit integer, doubles cut off; null if it is none or beyond 64 bits."""
    cut = F.try_variant_get(v, "$", "double").try_cast("long")
    return F.when(is_integer(v), F.try_variant_get(v, "$", "bigint")).when(kind(v) == "number", cut)


def tag_of(t: m.Internal, v: Column) -> Column:
    """Index of the arm that a tag slot names, null if none."""
    k, text, number = kind(v), as_string(v), whole(v)
    digits = F.when(text.rlike(r"\A-?[0-9]+\z"), text.try_cast("long"))
    out = F.lit(None).cast("int")
    for i, (tag, _) in reversed(list(enumerate(t.arms))):
        if isinstance(tag, str):
            hit = (k == "string") & (text == tag)
        else:
            hit = ((k == "number") & (number == tag)) | ((k == "string") & (digits == tag))
            if t.enum and t.enum.name_of(tag):
                hit = hit | ((k == "string") & (text == t.enum.name_of(tag)))
        out = F.when(F.coalesce(hit, F.lit(False)), F.lit(i)).otherwise(out)
    return out


def let(value: Column, body) -> Column:
    """body(value), with value evaluated and written down once. The body refers to nothing but its argument, as optimizer rules about Python functions want it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _slot(t: m.Type, v: Column, prior: Column) -> Column:
    return let(F.struct(v.alias("v"), prior.alias("p")), lambda s: load(t, s["v"], s["p"]))


def _reader(t: m.Type):
    return lambda v: load(t, v, None)


def _arms(t: m.External | m.Internal, index: Column, body, prior: Column) -> Column:
    made = prior
    for i, (tag, r) in enumerate(t.arms):
        fields = [(let(body(i), _reader(r)) if i == j else F.lit(None).cast(o.ddl())).alias(f"arm_{j}") for j, (_, o) in enumerate(t.arms)]
        made = F.when(index == i, F.struct(F.lit(str(tag)).alias("tag"), *fields)).otherwise(made)
    return made


def load(t: m.Type, v: Column, prior: Column | None) -> Column:
    """Reads slot v (a VARIANT, null if absent) over prior (None: the type's default)."""
    if prior is None:
        prior = literal(t, t.fresh())
    k = kind(v)
    if isinstance(t, m.Bool):
        return F.when(k == "bool", as_bool(v)).otherwise(prior)
    if isinstance(t, m.Int):
        return F.coalesce(narrowed(whole(v), t.bits), prior)
    if isinstance(t, m.Double):
        return F.when(k == "number", as_number(v)).otherwise(prior)
    if isinstance(t, m.Text):
        return F.when(k == "string", as_string(v)).otherwise(prior)
    if isinstance(t, m.Enum):
        named = F.lit(None).cast("int")
        for name, value in reversed(t.members):
            named = F.when(as_string(v) == name, F.lit(value)).otherwise(named)
        digits = F.when(F.lit(t.integer) & as_string(v).rlike(r"\A-?[0-9]+\z"), as_string(v).try_cast("long"))
        return F.coalesce(narrowed(whole(v), 32), named, narrowed(digits, 32), prior)
    if isinstance(t, m.Raw):
        return F.when(v.isNotNull(), v).otherwise(prior)
    if isinstance(t, m.Handed):
        return literal(t, t.fresh())
    if isinstance(t, m.Optional):
        return F.when(v.isNull(), prior).when(k == "null", F.lit(None).cast(t.ddl())).otherwise(load(t.inner, v, None))
    if isinstance(t, m.Omittable):
        return F.struct(v.isNotNull().alias("present"), F.when(v.isNotNull(), load(t.inner, v, None)).alias("value"))
    if isinstance(t, m.Vector):
        new = F.coalesce(as_array(v), F.array().cast("array<variant>"))
        return F.zip_with(new, F.slice(prior, F.lit(1), F.size(new)), lambda x, p: load(t.inner, x, F.coalesce(p, literal(t.inner, t.inner.fresh()))))
    if isinstance(t, m.Fixed):
        new = F.slice(F.coalesce(as_array(v), F.array().cast("array<variant>")), 1, t.size)
        return F.zip_with(new, prior, lambda x, p: load(t.inner, x, p))
    if isinstance(t, m.Map):
        return F.coalesce(F.transform_values(as_object(v), lambda _, x: load(t.inner, x, None)), F.create_map().cast(t.ddl()))
    if isinstance(t, m.Record):
        return F.struct(*[_slot(f.type, find(v, f.wire), prior.getField(f.name)).alias(f.name) for f in t.fields] or [F.lit(None).cast("boolean").alias("_")])
    if isinstance(t, m.External):
        first = F.array_min(F.map_keys(as_object(v)))
        index = F.lit(None).cast("int")
        for i, (tag, _) in reversed(list(enumerate(t.arms))):
            index = F.when(first == tag, F.lit(i)).otherwise(index)
        return _arms(t, index, lambda i: find(v, t.arms[i][0]), prior)
    if isinstance(t, m.Internal):
        return _arms(t, tag_of(t, find(v, t.key)), lambda _: v, prior)
    raise TypeError(t)


def handled(t: m.External | m.Internal, v: Column) -> Column:
    """Whether a union slot names one of the arms."""
    if isinstance(t, m.External):
        return F.coalesce(F.array_min(F.map_keys(as_object(v))).isin([tag for tag, _ in t.arms]), F.lit(False))
    return tag_of(t, find(v, t.key)).isNotNull()


def loaded(df: DataFrame, t: m.Type, text: str, out: str = "record", prior: Column | None = None, options: dict[str, Any] | None = None) -> DataFrame:
    """Adds column `out`: the JSON text column loaded over prior (None: the type's default). Malformed text has no fields. options fill Handed slots."""
    slot, names = "_document", {c.lower() for c in df.columns}
    while slot in names:
        slot += "_"
    null = F.parse_json(F.lit("null"))
    read = df.withColumn(slot, F.coalesce(parsed(F.col(text)), null))
    return read.withColumn(out, load(m.handed(t, options), F.col(slot), prior)).drop(slot)


#: Control characters whose escapes hold a letter.
_HEX_LETTERS = [c for c in range(32) if c not in (10, 12, 13) and c % 16 > 9]


def _quoted(text: Column) -> Column:
    whole_text = F.to_json(F.struct(text.alias("v")))
    out = lower = F.substring(whole_text, F.lit(6), F.length(whole_text) - 6)
    for c in _HEX_LETTERS:  # Spark writes these escapes in capitals; an escape follows an even number of backslashes
        lower = F.regexp_replace(lower, rf"(?<!\\)((?:\\\\)*+)\\u{c:04X}", rf"$1\\u{c:04x}")
    return F.when(text.rlike("[" + "".join(rf"\x{c:02x}" for c in _HEX_LETTERS) + "]"), lower).when(text.isNotNull(), out)


def _exact(t: m.Type) -> bool:
    """Whether Spark's own text of the type is canonical."""
    if isinstance(t, m.Double | m.Raw):
        return False
    if isinstance(t, m.Record):
        return all(_exact(f.type) for f in t.fields)
    if isinstance(t, m.External | m.Internal):
        return all(_exact(r) for _, r in t.arms)
    return _exact(t.inner) if hasattr(t, "inner") else True


def _members(t: m.Record, value: Column) -> list[tuple[str, Column]]:
    """Wire keys with texts; a null text leaves the member out."""
    out = []
    for f in t.fields:
        c = value.getField(f.name)
        if isinstance(f.type, m.Omittable):
            out.append((f.wire, F.when(c["present"], _text(f.type.inner, c["value"]))))
        else:
            out.append((f.wire, _text(f.type, c)))
    return out


def _object(members: list[tuple[str, Column]]) -> Column:
    parts = [F.when(text.isNotNull(), F.concat(F.lit(dump(key) + ":"), text)) for key, text in sorted(members, key=lambda kv: kv[0].encode())]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts) if parts else F.lit(""), F.lit("}"))


def _text(t: m.Type, value: Column) -> Column:
    null = F.lit("null")
    if isinstance(t, m.Optional):
        return F.when(value.isNull(), null).otherwise(_text(t.inner, value))
    if isinstance(t, m.Handed):
        return _text(t.inner, literal(t, t.fresh()))
    if isinstance(t, m.Omittable):  # in an array: null stands in
        return F.when(value["present"], _text(t.inner, value["value"])).otherwise(null)
    if isinstance(t, m.Bool | m.Int):
        return F.coalesce(value.cast("string"), null)
    if isinstance(t, m.Double):
        return F.when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), null).otherwise(value.cast("string"))
    if isinstance(t, m.Text):
        return F.coalesce(_quoted(value), null)
    if isinstance(t, m.Enum):
        out = value.cast("string")
        for name, n in [] if t.integer else t.members:
            out = F.when(value == n, F.lit(dump(name))).otherwise(out)
        return F.coalesce(out, null)
    if isinstance(t, m.Raw):
        endless = (kind(value) == "number") & (F.abs(F.try_variant_get(value, "$", "double")) == float("inf"))
        return F.when(endless, null).otherwise(F.coalesce(F.to_json(value), null))
    if isinstance(t, m.Vector | m.Fixed):
        return F.coalesce(F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: _text(t.inner, x)), ","), F.lit("]")), F.lit("[]"))
    if isinstance(t, m.Map):
        entries = F.array_sort(F.map_keys(value))
        inner = t.inner.inner if isinstance(t.inner, m.Omittable) else t.inner
        if isinstance(t.inner, m.Omittable):
            entries = F.filter(entries, lambda k: F.element_at(value, k)["present"])
        of = lambda k: F.element_at(value, k)["value"] if isinstance(t.inner, m.Omittable) else F.element_at(value, k)
        return F.coalesce(F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda k: F.concat(_quoted(k), F.lit(":"), _text(inner, of(k)))), ","), F.lit("}")), F.lit("{}"))
    if isinstance(t, m.Record):
        return _object(_members(t, value))
    if isinstance(t, m.External | m.Internal):
        out = null
        for i, (tag, r) in enumerate(t.arms):
            body = value.getField(f"arm_{i}")
            if isinstance(t, m.External):
                text = _object([(tag, _text(r, body))])
            else:  # the registered tag stands before a field of the arm with its key
                shown = dump(t.enum.name_of(tag)) if t.enum and not t.enum.integer and t.enum.name_of(tag) else dump(tag)
                text = _object([*[kv for kv in _members(r, body) if kv[0] != t.key], (t.key, F.lit(shown))])
            out = F.when(body.isNotNull() & (value["tag"] == str(tag)), text).otherwise(out)
        return out
    raise TypeError(t)


def save(t: m.Type, value: Column, indent: int = 0, options: dict[str, Any] | None = None) -> Column:
    """Canonical JSON text of a column of the type. options fill Handed slots."""
    text = _text(m.handed(t, options), value)
    return text if _exact(t) and not indent else json_print(text, indent)


def value_of(t: m.Type, value: Column) -> Column:
    """A column of the type as a JSON value."""
    return F.parse_json(save(t, value))


# Omittables: struct(present, value)


def has(omittable: Column) -> Column:
    return F.coalesce(omittable["present"], F.lit(False))


def value_or(omittable: Column, other: Column) -> Column:
    return F.when(has(omittable), omittable["value"]).otherwise(other)


def emplaced(value: Column) -> Column:
    return F.struct(F.lit(True).alias("present"), value.alias("value"))


def reset(omittable: Column) -> Column:
    """The omittable without its value, of the same type."""
    return omittable.withField("present", F.lit(False)).withField("value", F.nullif(omittable["value"], omittable["value"]))


def same(a: Column, b: Column) -> Column:
    """Both absent, or both present with equal values (nulls are equal)."""
    return (~has(a) & ~has(b)) | (has(a) & has(b) & a["value"].eqNullSafe(b["value"]))


def patched(t: m.Record, base: Column, patch: Column) -> Column:
    """A record with the present members of a patch (a record of the same field names, Omittable each) laid over it."""
    return F.struct(*[F.when(patch.getField(f.name)["present"], patch.getField(f.name)["value"]).otherwise(base.getField(f.name)).alias(f.name) for f in t.fields])
