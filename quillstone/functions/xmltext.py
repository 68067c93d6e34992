"""XML text: a strict subset parser and printer, the mapping between records' documents and elements, and their columns.

The subset: elements, attributes in either quotes, text, five named and all numeric references; comments and processing instructions are
skipped; there is no CDATA, DOCTYPE or namespace. A node has a name, attributes, children and, only without children, text.
Where an attribute is repeated the first counts. Positions in errors count UTF-8 bytes.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstone.functions.jsontext import dump

_NAME = re.compile(r"[A-Za-z_:][A-Za-z0-9_:.-]*")
_BLANK = re.compile(r"[ \t\r\n]*")
_TEXT = re.compile(r"[^<&]+")
_QUOTED = {'"': re.compile(r'[^"<&]+'), "'": re.compile(r"[^'<&]+")}
#: The predefined entities.
ENTITIES = {"lt": "<", "gt": ">", "amp": "&", "quot": '"', "apos": "'"}


class XmlError(ValueError):
    """Text that is not one XML document; position in bytes."""

    def __init__(self, text: str, at: int, reason: str):
        self.position = len(text[:at].encode("utf-8", "surrogatepass"))
        super().__init__(f"XML parse error at position {self.position}: {reason}")


@dataclass
class Node:
    name: str = ""
    attributes: dict[str, str] = field(default_factory=dict)
    children: list[Node] = field(default_factory=list)
    text: str = ""

    def attribute(self, name: str) -> str | None:
        return self.attributes.get(name)

    def child(self, name: str) -> Node | None:
        return next((c for c in self.children if c.name == name), None)

    def as_value(self) -> dict:
        """The tree as a JSON value, iteratively."""
        top: dict = {}
        todo = [(self, top)]
        while todo:
            node, out = todo.pop()
            out |= {"name": node.name, "attributes": dict(node.attributes), "children": [{} for _ in node.children], "text": node.text}
            todo.extend(zip(node.children, out["children"], strict=True))
        return top


class _Reader:
    def __init__(self, text: str):
        self.text, self.at = text, 0

    def fail(self, reason: str, at: int | None = None):
        raise XmlError(self.text, self.at if at is None else at, reason)

    def blank(self) -> None:
        self.at = _BLANK.match(self.text, self.at).end()

    def past(self, end: str, what: str) -> None:
        stop = self.text.find(end, self.at)
        if stop < 0:
            self.fail(f"unterminated {what}")
        self.at = stop + len(end)

    def misc(self) -> bool:
        """Skips a comment or processing instruction."""
        if self.text.startswith("<!--", self.at):
            self.at += 4
            self.past("-->", "comment")
        elif self.text.startswith("<?", self.at):
            self.at += 2
            self.past("?>", "processing instruction")
        else:
            return False
        return True

    def name(self) -> str:
        m = _NAME.match(self.text, self.at)
        if not m:
            self.fail("a name is expected")
        self.at = m.end()
        return m.group()

    def reference(self) -> str:
        begin = self.at
        stop = self.text.find(";", begin)
        body = self.text[begin + 1 : stop] if stop >= 0 else ""
        self.at = stop + 1
        if body in ENTITIES:
            return ENTITIES[body]
        if m := re.fullmatch(r"#(?:x([0-9A-Fa-f]+)|([0-9]+))", body):
            digits = (m[1] or m[2]).lstrip("0") or "0"
            c = int(digits, 16 if m[1] else 10) if len(digits) < 9 else 0x110000
            if c in (9, 10, 13) or 0x20 <= c < 0xD800 or 0xE000 <= c < 0x110000:
                return chr(c)
            self.fail("no such character", begin)
        self.fail("unknown entity", begin)

    def quoted(self) -> str:
        q = self.text[self.at : self.at + 1]
        if q not in _QUOTED or not q:
            self.fail("a quoted value is expected")
        self.at += 1
        out = []
        while True:
            if m := _QUOTED[q].match(self.text, self.at):
                out.append(m.group())
                self.at = m.end()
            c = self.text[self.at : self.at + 1]
            if c == q:
                self.at += 1
                return "".join(out)
            if c != "&":
                self.fail("'<' in an attribute" if c else "unterminated attribute")
            out.append(self.reference())

    def opened(self) -> tuple[Node, bool]:
        """A start tag from behind '<'; whether it is closed at once."""
        node = Node(self.name())
        while True:
            before = self.at
            self.blank()
            if self.text.startswith("/>", self.at):
                self.at += 2
                return node, True
            if self.text.startswith(">", self.at):
                self.at += 1
                return node, False
            if self.at == before or self.at >= len(self.text):
                self.fail("unterminated tag" if self.at >= len(self.text) else "an attribute or '>' is expected")
            key = self.name()
            self.blank()
            if not self.text.startswith("=", self.at):
                self.fail("'=' is expected")
            self.at += 1
            self.blank()
            node.attributes.setdefault(key, self.quoted())

    def document(self) -> Node:
        while True:
            self.blank()
            if not self.misc():
                break
        if not self.text.startswith("<", self.at):
            self.fail("an element is expected")
        self.at += 1
        root, closed = self.opened()
        stack = [] if closed else [(root, [])]
        while stack:
            node, texts = stack[-1]
            if m := _TEXT.match(self.text, self.at):
                texts.append(m.group())
                self.at = m.end()
            elif self.at >= len(self.text):
                self.fail(f"unterminated element {node.name}")
            elif self.text[self.at] == "&":
                texts.append(self.reference())
            elif self.misc():
                continue
            elif self.text.startswith("</", self.at):
                self.at += 2
                begin = self.at
                if self.name() != node.name:
                    self.fail(f"the end of {node.name} is expected", begin)
                self.blank()
                if not self.text.startswith(">", self.at):
                    self.fail("'>' is expected")
                self.at += 1
                if not node.children:
                    node.text = "".join(texts)
                stack.pop()
            else:
                self.at += 1
                child, closed = self.opened()
                node.children.append(child)
                if not closed:
                    stack.append((child, []))
        while True:
            self.blank()
            if not self.misc():
                break
        if self.at < len(self.text):
            self.fail("text after the document")
        return root


def parse(text: str) -> Node:
    return _Reader(text).document()


_IN_TEXT = str.maketrans({"&": "&amp;", "<": "&lt;", ">": "&gt;"})
_IN_VALUE = str.maketrans({"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&apos;"})


def dump_xml(node: Node, indent: int = 0) -> str:
    """Attributes sorted by name; an empty element closes itself."""
    out: list[str] = []
    todo: list = [(node, 0)]
    while todo:
        item, depth = todo.pop()
        line = "\n" + " " * (indent * depth) if indent > 0 and depth else ""
        if isinstance(item, str):
            out.append(item)
            continue
        head = "".join(f' {k}="{v.translate(_IN_VALUE)}"' for k, v in sorted(item.attributes.items(), key=lambda kv: kv[0].encode()))
        if item.children:
            out.append(f"{line}<{item.name}{head}>")
            end = "\n" + " " * (indent * depth) if indent > 0 else ""
            todo.append((f"{end}</{item.name}>", 0))
            todo.extend((c, depth + 1) for c in reversed(item.children))
        elif item.text:
            out.append(f"{line}<{item.name}{head}>{item.text.translate(_IN_TEXT)}</{item.name}>")
        else:
            out.append(f"{line}<{item.name}{head}/>")
    return "".join(out)


# Scalars in attributes


def scalar_text(value) -> str:
    """bool as words, integers plainly, whole doubles below 10**15 as integers, other doubles with 6 digits."""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        return str(int(value)) if value == value and abs(value) < 1e15 and value == int(value) else f"{value:g}"
    return str(value)


_INT, _FLOAT = re.compile(r"[ \t\n\v\f\r]*([+-]?[0-9]+)"), re.compile(r"[ \t\n\v\f\r]*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)")


def text_bool(text: str) -> bool:
    return text in ("true", "1")


def text_int(text: str) -> int:
    """The leading integer, 0 without one, held within 64 bits."""
    m = _INT.match(text)
    return max(-(1 << 63), min((1 << 63) - 1, int(m[1]))) if m else 0


def text_float(text: str) -> float:
    m = _FLOAT.match(text)
    return float(m[1]) if m else 0.0


# Columns


def xml_parse(text: Column) -> Column:
    """struct(ok, tree, printed, position, message); tree is the node as canonical JSON (name, attributes, children, text)."""

    @F.pandas_udf("ok boolean, tree string, printed string, position int, message string")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            try:
                if t is None:
                    rows.append((False, None, None, None, None))
                else:
                    node = parse(t)
                    rows.append((True, dump(node.as_value()), dump_xml(node), None, None))
            except XmlError as e:
                rows.append((False, None, None, e.position, str(e)))
        return pd.DataFrame(rows, columns=["ok", "tree", "printed", "position", "message"]).astype({"position": "Int32"})

    return run(text)


def xml_print(text: Column, indent: int = 0) -> Column:
    """XML text printed anew; null where malformed or null."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            try:
                out.append(None if t is None else dump_xml(parse(t), indent))
            except XmlError:
                out.append(None)
        return pd.Series(out, dtype=object)

    return run(text)
