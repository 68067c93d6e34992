"""Record model: declared types of documents, and their Spark types.

A type says how a document's slot is read and written:

* Bool, Int, Double, Text: a slot that is absent or of another kind keeps what was there before;
* Enum: a number, or the name of one; written as name (or number, if unnamed or if the format is integer);
* Raw: any JSON, kept as it is; Ref: a record that contains itself, kept as raw JSON;
* Optional: null or a value; Omittable: no key at all, or a value (null counts as one);
* Vector, Map: cleared unless the slot is an array or object; Fixed: an array of a fixed size, read as far as it goes;
* Handed: a slot that an option fills, which loads and saves hand down to it;
* Record: fields by key; External: {"Tag": body}; Internal: a tag among the body's own fields.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any


class Type:
    """Base of all types."""

    def ddl(self) -> str:
        raise NotImplementedError

    def fresh(self) -> Any:
        """The default, as a JSON-like Python value."""
        raise NotImplementedError


@dataclass(frozen=True)
class Bool(Type):
    def ddl(self):
        return "boolean"

    def fresh(self):
        return False


@dataclass(frozen=True)
class Int(Type):
    bits: int = 32

    def ddl(self):
        return {8: "tinyint", 16: "smallint", 32: "int", 64: "bigint"}[self.bits]

    def fresh(self):
        return 0


@dataclass(frozen=True)
class Double(Type):
    def ddl(self):
        return "double"

    def fresh(self):
        return 0.0


@dataclass(frozen=True)
class Text(Type):
    def ddl(self):
        return "string"

    def fresh(self):
        return ""


@dataclass(frozen=True)
class Enum(Type):
    name: str
    members: tuple[tuple[str, int], ...]
    integer: bool = False

    def ddl(self):
        return "int"

    def fresh(self):
        return 0

    def name_of(self, value: int) -> str:
        return next((n for n, v in self.members if v == value), "")

    def value_of(self, name: str) -> int | None:
        return next((v for n, v in self.members if n == name), None)

    def entries(self) -> list[tuple[str, int]]:
        """In numeric order."""
        return sorted(self.members, key=lambda m: m[1])


@dataclass(frozen=True)
class Raw(Type):
    def ddl(self):
        return "variant"

    def fresh(self):
        return None


@dataclass(frozen=True)
class Ref(Raw):
    """A record named inside itself."""

    name: str = ""


@dataclass(frozen=True)
class Optional(Type):
    inner: Type

    def ddl(self):
        return self.inner.ddl()

    def fresh(self):
        return None


@dataclass(frozen=True)
class Omittable(Type):
    inner: Type

    def ddl(self):
        return f"struct<present:boolean,value:{self.inner.ddl()}>"

    def fresh(self):
        return Absent


class Absent:
    """Default of an Omittable."""


@dataclass(frozen=True)
class Vector(Type):
    inner: Type

    def ddl(self):
        return f"array<{self.inner.ddl()}>"

    def fresh(self):
        return []


@dataclass(frozen=True)
class Fixed(Type):
    inner: Type
    size: int

    def ddl(self):
        return f"array<{self.inner.ddl()}>"

    def fresh(self):
        return [self.inner.fresh()] * self.size


@dataclass(frozen=True)
class Map(Type):
    inner: Type

    def ddl(self):
        return f"map<string,{self.inner.ddl()}>"

    def fresh(self):
        return {}


@dataclass(frozen=True)
class Field:
    name: str
    type: Type
    default: Any = None
    key: str = ""

    @property
    def wire(self) -> str:
        return self.key or self.name

    def start(self) -> Any:
        return self.type.fresh() if self.default is None else self.default


@dataclass(frozen=True)
class Record(Type):
    name: str
    fields: tuple[Field, ...] = ()
    space: str = ""

    @property
    def qualified(self) -> str:
        return f"{self.space}.{self.name}" if self.space else self.name

    def ddl(self):
        # a record without fields still needs a column to stand in
        return "struct<" + (",".join(f"`{f.name}`:{f.type.ddl()}" for f in self.fields) or "_:boolean") + ">"

    def fresh(self):
        return {f.name: f.start() for f in self.fields}


@dataclass(frozen=True)
class External(Type):
    """Externally tagged; arms by tag. The column is a struct of the tag and one nullable field an arm."""

    arms: tuple[tuple[str, Record], ...]

    def ddl(self):
        return "struct<tag:string," + ",".join(f"`arm_{i}`:{r.ddl()}" for i, (_, r) in enumerate(self.arms)) + ">"

    def fresh(self):
        return None


@dataclass(frozen=True)
class Internal(Type):
    """Internally tagged by a key; tags are integers, strings, or names of an enum. The first arm of a tag wins."""

    key: str
    arms: tuple[tuple[int | str, Record], ...]
    enum: Enum | None = None

    def __post_init__(self):
        kinds = {type(t) for t, _ in self.arms}
        if len(kinds) > 1:
            raise TypeError("all arms need one kind of tag")
        if self.enum and kinds != {int}:
            raise TypeError("an enum's tags are integers")

    def ddl(self):
        return "struct<tag:string," + ",".join(f"`arm_{i}`:{r.ddl()}" for i, (_, r) in enumerate(self.arms)) + ">"

    def fresh(self):
        return None


@dataclass(frozen=True)
class Handed(Type):
    """A slot that documents have no say in: it holds the option `key` of the load or save, or the inner type's default where none is given."""

    inner: Type
    key: str
    value: Any = None

    def ddl(self):
        return self.inner.ddl()

    def fresh(self):
        return self.inner.fresh() if self.value is None else self.value


def handed(t: Type, options: dict[str, Any] | None) -> Type:
    """The type with options handed down to every slot below it."""
    if not options:
        return t
    if isinstance(t, Handed):
        return replace(t, value=options.get(t.key))
    if isinstance(t, Record):
        return replace(t, fields=tuple(replace(f, type=handed(f.type, options)) for f in t.fields))
    if isinstance(t, External | Internal):
        return replace(t, arms=tuple((tag, handed(r, options)) for tag, r in t.arms))
    return replace(t, inner=handed(t.inner, options)) if hasattr(t, "inner") else t


def record(name: str, space: str = "", /, **fields: Type | tuple) -> Record:
    """record("User", name=Text(), age=(Int(), 18), note=(Optional(Text()), None, "Note")): type, default, wire key."""
    made = [Field(n, *(t if isinstance(t, tuple) else (t,))) for n, t in fields.items()]
    return Record(name, tuple(made), space)


@dataclass
class Registry:
    """Types for classes declared elsewhere: what a Python type or a Spark type is read as."""

    types: dict[type, Type] = field(default_factory=lambda: {bool: Bool(), int: Int(64), float: Double(), str: Text(), dict: Raw(), list: Raw()})

    def add(self, cls: type, kind: Type) -> None:
        self.types[cls] = kind

    def of(self, hint: Any) -> Type:
        """The type of a Python annotation: registered classes, dataclasses, list[T], dict[str, T], T | None."""
        import dataclasses
        import types
        import typing

        if isinstance(hint, Type):
            return hint
        if hint in self.types:
            return self.types[hint]
        origin, args = typing.get_origin(hint), typing.get_args(hint)
        if origin is list:
            return Vector(self.of(args[0]))
        if origin is dict and args[0] is str:
            return Map(self.of(args[1]))
        if origin in (typing.Union, types.UnionType) and type(None) in args and len(args) == 2:
            return Optional(self.of(next(a for a in args if a is not type(None))))
        if dataclasses.is_dataclass(hint):
            hints = typing.get_type_hints(hint)
            fresh = lambda f: f.default if f.default is not dataclasses.MISSING else f.default_factory() if f.default_factory is not dataclasses.MISSING else None
            made = Record(hint.__name__, tuple(Field(f.name, self.of(hints[f.name]), fresh(f)) for f in dataclasses.fields(hint)), hint.__module__)
            return self.types.setdefault(hint, made)
        raise TypeError(f"no type is known for {hint!r}")

    def is_supported(self, hint: Any) -> bool:
        try:
            self.of(hint)
        except TypeError:
            return False
        return True


def from_spark(kind) -> Type:
    """The type of a Spark DataType; nullable fields become Optional."""
    name = kind.typeName()
    if name in ("boolean", "string", "double", "float"):
        return {"boolean": Bool(), "string": Text()}.get(name, Double())
    if name in ("byte", "short", "integer", "long"):
        return Int({"byte": 8, "short": 16, "integer": 32, "long": 64}[name])
    if name == "array":
        return Vector(from_spark(kind.elementType))
    if name == "map":
        return Map(from_spark(kind.valueType))
    if name == "struct":
        return Record("Row", tuple(Field(f.name, Optional(from_spark(f.dataType)) if f.nullable else from_spark(f.dataType)) for f in kind.fields))
    if name == "variant":
        return Raw()
    raise TypeError(f"no document type for {name}")
