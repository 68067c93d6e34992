import pytest

from quillstone.plans import model as m
from quillstone.plans.visitor import Values, Visitor, slots, visit, walk

INNER = m.record("Inner", x=m.Int())
OUTER = m.record("Outer", a=m.Optional(INNER), b=m.Omittable(m.Vector(m.Text())), c=m.Map(INNER), u=m.Internal("k", ((1, INNER),)), r=m.Raw())


def test_slots():
    got = [(".".join(s.path), s.shape, s.nullable, s.omittable) for s in slots(OUTER)]
    assert got == [("", "object", False, False), ("a", "object", True, False), ("a.x", "primitive", False, False), ("b", "array", False, True), ("b.[]", "primitive", False, False), ("c", "map", False, False), ("c.{}", "object", False, False), ("c.{}.x", "primitive", False, False), ("u", "object", False, False), ("u.<1>", "object", False, False), ("u.<1>.x", "primitive", False, False), ("r", "raw", False, False)]


def test_options_reach_nested_slots():
    seen = []

    class Tagging(Visitor):
        def enter(self, slot):
            seen.append((slot.path, slot.options.get("tag")))
            return {"tag": "deep"} if slot.path == ("a",) else None

    walk(OUTER, Tagging(), {"tag": "top"})
    assert dict(seen)[("a", "x")] == "deep" and dict(seen)[("b", "[]")] == "top"


HUE = m.Enum("Hue", (("Red", 0), ("Blue", 4)))
ALL = m.record("All", o=m.Optional(m.Int()), om=m.Omittable(m.Text()), v=m.Vector(m.Int()), f=m.Fixed(m.Int(), 2), c=m.Map(INNER), h=HUE, r=m.Raw())
HELD = {"o": None, "om": m.Absent, "v": [1, 2, 3], "f": [4, 5], "c": {"a": {"x": 6}, "b": {"x": 7}}, "h": 4, "r": {"k": 1}}


def test_values_stay_without_hooks():
    assert visit(ALL, HELD, Values()) == HELD


def test_hooks_act_on_values():
    seen = []

    class Acting(Values):
        value = lambda self, slot, held: held * slot.options["by"] if isinstance(slot.type, m.Int) else held
        null = lambda self, slot: 9
        present = lambda self, slot, here: True
        size = lambda self, slot, n: 4 if slot.path == ("v",) else 1
        keys = lambda self, slot, held: ["b", "new"]

        def enum(self, slot, held, name):
            seen.append(name)
            return 0

        def named(self, slot, record):
            seen.append(record.name)

    got = visit(ALL, HELD, Acting(), {"by": 10})
    assert got == {"o": 90, "om": "", "v": [10, 20, 30, 0], "f": [40, 50], "c": {"b": {"x": 70}, "new": {"x": 0}}, "h": 0, "r": {"k": 1}}
    assert seen == ["All", "Inner", "Inner", "Blue"]


def test_unions_need_a_visitor_that_takes_them():
    union, tags = m.record("U", u=m.Internal("k", ((1, INNER),))), []
    with pytest.raises(TypeError):
        visit(union, {"u": (0, {"x": 1})}, Values())

    class Taking(Values):
        def alternative(self, slot, tag):
            tags.append((slot.path, tag))

    assert visit(union, {"u": (0, {"x": 1})}, Taking()) == {"u": (0, {"x": 1})} and tags == [(("u",), 1)]
    assert visit(union, {"u": None}, Values()) == {"u": None}
