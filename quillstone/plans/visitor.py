"""Walking over types and values: a visitor sees every slot with its path and shape, and free-form options handed down to all nested slots."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from quillstone.plans import model as m

#: Shape of a type's slot.
SHAPES = {m.Record: "object", m.External: "object", m.Internal: "object", m.Vector: "array", m.Fixed: "array", m.Map: "map", m.Raw: "raw", m.Ref: "raw"}


def shape(t: m.Type) -> str:
    while isinstance(t, m.Optional | m.Omittable | m.Handed):
        t = t.inner
    return SHAPES.get(type(t), "primitive")


@dataclass
class Slot:
    path: tuple[str, ...]
    type: m.Type
    shape: str
    nullable: bool
    omittable: bool
    options: dict[str, Any] = field(default_factory=dict)


class Visitor:
    """Override what is needed. enter may return options for what lies below."""

    def enter(self, slot: Slot) -> dict[str, Any] | None:
        return None

    def leave(self, slot: Slot) -> None:
        return None


def walk(t: m.Type, visitor: Visitor, options: dict[str, Any] | None = None, path: tuple[str, ...] = (), nullable: bool = False, omittable: bool = False) -> None:
    if isinstance(t, m.Optional):
        return walk(t.inner, visitor, options, path, True, omittable)
    if isinstance(t, m.Omittable):
        return walk(t.inner, visitor, options, path, nullable, True)
    slot = Slot(path, t, shape(t), nullable, omittable, dict(options or {}))
    below = slot.options | (visitor.enter(slot) or {})
    if isinstance(t, m.Record):
        for f in t.fields:
            walk(f.type, visitor, below, (*path, f.wire))
    elif isinstance(t, m.Vector | m.Fixed):
        walk(t.inner, visitor, below, (*path, "[]"))
    elif isinstance(t, m.Map):
        walk(t.inner, visitor, below, (*path, "{}"))
    elif isinstance(t, m.External | m.Internal):
        for tag, r in t.arms:
            walk(r, visitor, below, (*path, f"<{tag}>"))
    visitor.leave(slot)


def slots(t: m.Type, options: dict[str, Any] | None = None) -> list[Slot]:
    """All slots of a type, outer ones first."""
    found: list[Slot] = []

    class Listing(Visitor):
        def enter(self, slot):
            found.append(slot)

    walk(t, Listing(), options)
    return found


class Values:
    """Hooks at the slots of a value, outer ones first. What a hook returns stands in the slot; as they are, hooks leave all as it was."""

    def value(self, slot: Slot, held: Any) -> Any:
        """Primitive and raw slots."""
        return held

    def enum(self, slot: Slot, held: int, name: str | None) -> int:
        return held

    def null(self, slot: Slot) -> Any:
        """An Optional without a value; anything but None takes its place."""
        return None

    def present(self, slot: Slot, here: bool) -> bool:
        """An Omittable; one made present holds the default."""
        return here

    def size(self, slot: Slot, n: int) -> int:
        """An array's size, before its items are seen; items beyond the old size are defaults. Fixed arrays keep theirs."""
        return n

    def keys(self, slot: Slot, held: list[str]) -> list[str]:
        """A map's keys, in order, before its values are seen; new ones hold defaults."""
        return held

    def named(self, slot: Slot, record: m.Record) -> None:
        """A record begins."""

    def alternative(self, slot: Slot, tag: int | str) -> None:
        """A union's arm begins. Visitors that know no unions refuse them."""
        raise TypeError(f"{'.'.join(slot.path)}: this visitor takes no unions")


def visit(t: m.Type, held: Any, hooks: Values, options: dict[str, Any] | None = None, path: tuple[str, ...] = (), nullable: bool = False, omittable: bool = False) -> Any:
    """The value (as in `records`) that the hooks leave of one."""
    slot = Slot(path, t, shape(t), nullable, omittable, dict(options or {}))
    below = lambda inner, x, step: visit(inner, x, hooks, options, (*path, step))
    if isinstance(t, m.Optional):
        held = hooks.null(slot) if held is None else held
        return None if held is None else visit(t.inner, held, hooks, options, path, True, omittable)
    if isinstance(t, m.Omittable):
        if not hooks.present(slot, held is not m.Absent):
            return m.Absent
        return visit(t.inner, t.inner.fresh() if held is m.Absent else held, hooks, options, path, nullable, True)
    if isinstance(t, m.Handed):
        return visit(t.inner, held, hooks, options, path, nullable, omittable)
    if isinstance(t, m.Enum):
        return hooks.enum(slot, held, t.name_of(held))
    if isinstance(t, m.Vector | m.Fixed):
        n = hooks.size(slot, len(held))
        n = t.size if isinstance(t, m.Fixed) else n
        return [below(t.inner, held[i] if i < len(held) else t.inner.fresh(), "[]") for i in range(n)]
    if isinstance(t, m.Map):
        return {k: below(t.inner, held[k] if k in held else t.inner.fresh(), "{}") for k in hooks.keys(slot, list(held))}
    if isinstance(t, m.Record):
        hooks.named(slot, t)
        return {f.name: below(f.type, held[f.name], f.wire) for f in t.fields}
    if isinstance(t, m.External | m.Internal):
        if held is None:
            return None
        tag, r = t.arms[held[0]]
        hooks.alternative(slot, tag)
        return held[0], below(r, held[1], f"<{tag}>")
    return hooks.value(slot, held)
