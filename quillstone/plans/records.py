"""Loads and saves of declared records over single documents, as plain Python values: what commands do with requests and responses.

The rules are those of `overlay`, which does the same for columns. A record is a dict by field name, an absent omittable is
`model.Absent`, a union is (index of its arm, body) or None. Options reach Handed slots by `model.handed`.
"""

from __future__ import annotations

import math
import re
from typing import Any

from quillstone.plans import model as m

_DIGITS = re.compile(r"-?[0-9]+").fullmatch


def _is_number(v: Any) -> bool:
    return isinstance(v, int | float) and not isinstance(v, bool)


def whole(v: Any) -> int | None:
    """A number as 64-bit integer, a fraction cut off."""
    if not _is_number(v) or not math.isfinite(v):
        return None
    n = int(v)
    return n if -(1 << 63) <= n < 1 << 63 else None


def narrowed(n: int, bits: int) -> int:
    half = 1 << (bits - 1)
    return (n + half) % (2 * half) - half


def arm_of(t: m.External | m.Internal, v: Any) -> tuple[int, Any] | None:
    """The arm a slot names, and the slot of its body."""
    if not isinstance(v, dict):
        return None
    if isinstance(t, m.External):
        first = min(v, default=None)
        return next(((i, v[tag]) for i, (tag, _) in enumerate(t.arms) if tag == first), None)
    held = v.get(t.key)
    digits = int(held) if isinstance(held, str) and _DIGITS(held) else None
    for i, (tag, _) in enumerate(t.arms):
        if isinstance(tag, str):
            hit = held == tag
        else:
            hit = tag in (whole(held), digits) or bool(t.enum and isinstance(held, str) and held and t.enum.name_of(tag) == held)
        if hit:
            return i, v
    return None


def load(t: m.Type, v: Any, prior: Any) -> Any:
    """Reads slot v (model.Absent if there is none) over prior."""
    fresh = lambda inner, x: load(inner, x, inner.fresh())
    if isinstance(t, m.Bool):
        return v if isinstance(v, bool) else prior
    if isinstance(t, m.Int):
        n = whole(v)
        return prior if n is None else narrowed(n, t.bits)
    if isinstance(t, m.Double):
        return float(v) if _is_number(v) else prior
    if isinstance(t, m.Text):
        return v if isinstance(v, str) else prior
    if isinstance(t, m.Enum):
        n = whole(v)
        if n is None and isinstance(v, str):
            n = t.value_of(v)
            if n is None and t.integer and _DIGITS(v):
                n = whole(int(v))
        return prior if n is None else narrowed(n, 32)
    if isinstance(t, m.Raw):
        return prior if v is m.Absent else v
    if isinstance(t, m.Handed):
        return t.fresh()
    if isinstance(t, m.Optional):
        return prior if v is m.Absent else None if v is None else fresh(t.inner, v)
    if isinstance(t, m.Omittable):
        return m.Absent if v is m.Absent else fresh(t.inner, v)
    if isinstance(t, m.Vector):
        held = prior or []
        return [load(t.inner, x, held[i] if i < len(held) else t.inner.fresh()) for i, x in enumerate(v)] if isinstance(v, list) else []
    if isinstance(t, m.Fixed):
        given = v if isinstance(v, list) else []
        return [load(t.inner, given[i] if i < len(given) else m.Absent, p) if i < len(given) else p for i, p in enumerate(prior)]
    if isinstance(t, m.Map):
        return {k: fresh(t.inner, x) for k, x in v.items()} if isinstance(v, dict) else {}
    if isinstance(t, m.Record):
        given, held = v if isinstance(v, dict) else {}, prior if isinstance(prior, dict) else t.fresh()
        return {f.name: load(f.type, given.get(f.wire, m.Absent), held[f.name]) for f in t.fields}
    if isinstance(t, m.External | m.Internal):
        found = arm_of(t, v)
        return prior if found is None else (found[0], fresh(t.arms[found[0]][1], found[1]))
    raise TypeError(t)


def save(t: m.Type, value: Any) -> Any:
    """The value as a document."""
    if isinstance(t, m.Enum):
        return value if t.integer else t.name_of(value) or value
    if isinstance(t, m.Handed):
        return save(t.inner, t.fresh())
    if isinstance(t, m.Optional):
        return None if value is None else save(t.inner, value)
    if isinstance(t, m.Omittable):
        return None if value is m.Absent else save(t.inner, value)
    if isinstance(t, m.Vector | m.Fixed):
        return [save(t.inner, x) for x in value]
    if isinstance(t, m.Map):
        return {k: save(t.inner, x) for k, x in value.items() if x is not m.Absent}
    if isinstance(t, m.Record):
        return {f.wire: save(f.type, value[f.name]) for f in t.fields if value[f.name] is not m.Absent}
    if isinstance(t, m.External | m.Internal):
        if value is None:
            return None
        tag, r = t.arms[value[0]]
        body = save(r, value[1])
        return {tag: body} if isinstance(t, m.External) else body | {t.key: t.enum.name_of(tag) if t.enum and not t.enum.integer and t.enum.name_of(tag) else tag}
    return value
