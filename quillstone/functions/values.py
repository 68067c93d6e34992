"""Operators on JSON values held in VARIANT columns; native expressions only.

A VARIANT made by `parsed(...)` comes from a strict parse, so duplicates, comments and bad surrogates are gone, and doubles are doubles
however they are written. `variant(...)` reads text that is known to be canonical in the JVM; a fraction is stored as DECIMAL there and a
whole double as an integer. Numeric reads go through DOUBLE. SQL null is "absent", a variant null is "null".
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstone.functions.jsontext import json_typed

KINDS = ("absent", "null", "bool", "number", "string", "array", "object")
_LOW, _HIGH = -9223372036854775808.0, 9223372036854775808.0


def variant(canonical: Column) -> Column:
    return F.try_parse_json(canonical)


#: Texts that the JVM's parser reads as the strict one does: a scalar, or an object of one member with a scalar, without escapes, fractions or numbers near 64 bits.
_PLAIN = r'(?:-?(?:0|[1-9][0-9]{0,17})|"[^"\\\x00-\x1f]*"|true|false|null)'
PLAIN = rf'\A[ \t\r\n]*(?:{_PLAIN}|\{{[ \t\r\n]*"[^"\\\x00-\x1f]*"[ \t\r\n]*:[ \t\r\n]*{_PLAIN}[ \t\r\n]*\}})[ \t\r\n]*\z'


def parsed(text: Column) -> Column:
    """The value of a JSON text, numbers with their kinds; null where it is malformed. Plain documents are parsed in the JVM, only the others go through the strict parser."""
    plain = text.rlike(PLAIN)
    return F.when(plain, F.try_parse_json(text)).otherwise(F.try_parse_json(json_typed(F.when(plain, F.lit(None)).otherwise(text))))


def of(value: Column, unsigned: bool = False) -> Column:
    """A value from a column of any Spark type but intervals: structs and maps are objects, null is the null value. unsigned: a decimal of an unsigned 64-bit integer, a double beyond 64 signed bits."""
    null = F.parse_json(F.lit("null"))
    if unsigned:
        return F.coalesce(F.when(value < F.lit(_HIGH), value.try_cast("long").cast("variant")).otherwise(value.cast("double").cast("variant")), null)
    boxed = F.to_variant_object(F.struct(value.alias("v")))
    return F.coalesce(F.try_variant_get(boxed, "$.v", "variant"), null)


def step(key: str | int) -> str:
    """One step of a path."""
    if isinstance(key, int):
        return f"$[{key}]"
    quote = "'" if "'" not in key else '"'
    return f"$[{quote}{key}{quote}]"


def find(v: Column, key: str | int) -> Column:
    """The member or element, null if absent. A key that no path can hold is looked up in the object's map."""
    if isinstance(key, str) and (not key or "\\" in key or "]" in key or ("'" in key and '"' in key)):
        return F.try_element_at(as_object(v), F.lit(key))
    return F.try_variant_get(v, step(key), "variant")


def kind(v: Column) -> Column:
    s = F.schema_of_variant(v)
    return (
        F.when(v.isNull(), "absent")
        .when(F.is_variant_null(v), "null")
        .when(s == "BOOLEAN", "bool")
        .when(s == "STRING", "string")
        .when(s.startswith("ARRAY<"), "array")
        .when(s.startswith("OBJECT<"), "object")
        .otherwise("number")
    )


def is_integer(v: Column) -> Column:
    """Stored as a 64-bit integer (a number written without fraction or exponent, in range)."""
    return F.coalesce(F.schema_of_variant(v) == "BIGINT", F.lit(False))


def as_bool(v: Column) -> Column:
    return F.when(kind(v) == "bool", F.try_variant_get(v, "$", "boolean"))


def as_number(v: Column) -> Column:
    return F.when(kind(v) == "number", F.try_variant_get(v, "$", "double"))


def as_integer(v: Column) -> Column:
    """Exact: a stored integer, or a finite whole double within 64 bits; null otherwise."""
    d = F.try_variant_get(v, "$", "double")
    whole = (kind(v) == "number") & (d == F.floor(d).cast("double")) & (d >= _LOW) & (d < _HIGH)
    return F.when(is_integer(v), F.try_variant_get(v, "$", "bigint")).when(whole, d.cast("long"))


def to_int(v: Column, bits: int = 32) -> Column:
    """A number as an integer of so many bits, a double's fraction cut off; null if it is none or out of range. 64 bits are exact, as as_integer."""
    if bits == 64:
        return as_integer(v)
    return F.when(kind(v) == "number", F.try_variant_get(v, "$", "double").try_cast({8: "tinyint", 16: "smallint", 32: "int"}[bits]))


def to_float(v: Column) -> Column:
    """A number in single precision."""
    return as_number(v).cast("float")


def as_string(v: Column) -> Column:
    return F.when(kind(v) == "string", F.try_variant_get(v, "$", "string"))


def as_array(v: Column) -> Column:
    return F.when(kind(v) == "array", F.try_variant_get(v, "$", "array<variant>"))


def as_object(v: Column) -> Column:
    return F.when(kind(v) == "object", F.try_variant_get(v, "$", "map<string,variant>"))


READS = {"bool": as_bool, "number": as_number, "integer": as_integer, "string": as_string, "array": as_array, "object": as_object}


def strict(v: Column, wanted: str) -> Column:
    """As the as_ functions, but a value of another kind is an error."""
    got = READS[wanted](v)
    told = F.raise_error(F.concat(F.lit(f"expected {wanted} but value is "), kind(v)))
    none = {"bool": "boolean", "number": "double", "integer": "bigint", "string": "string", "array": "array<variant>", "object": "map<string,variant>"}[wanted]
    return F.when(got.isNotNull(), got).otherwise(F.try_variant_get(F.parse_json(told.cast("string")), "$", none))


def to_object(v: Column) -> Column:
    """Whatever is no object becomes an empty one."""
    return F.when(kind(v) == "object", v).otherwise(F.parse_json(F.lit("{}")))


def payload_or_empty(v: Column) -> Column:
    """A null payload becomes an empty object."""
    return F.when(v.isNull() | F.is_variant_null(v), F.parse_json(F.lit("{}"))).otherwise(v)


def object_keys(canonical: Column) -> Column:
    """Keys in ascending order."""
    return F.array_sort(F.json_object_keys(canonical))


def array_size(v: Column) -> Column:
    """Elements of an array, 0 for anything else."""
    return F.coalesce(F.size(as_array(v)), F.lit(0)).cast("int")
