"""String functions of the document engine, all native expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_identifier(text: Column) -> Column:
    """ASCII identifier."""
    return text.rlike(r"\A[A-Za-z_][A-Za-z0-9_]*\z")


def is_js_identifier(text: Column) -> Column:
    """As is_identifier, dollar signs allowed."""
    return text.rlike(r"\A[A-Za-z_$][A-Za-z0-9_$]*\z")


def split_on(text: Column, delimiter: str) -> Column:
    """Splits at a literal delimiter; an empty one leaves the text whole."""
    return F.split(text, "\\Q" + delimiter.replace("\\E", "\\E\\\\E\\Q") + "\\E") if delimiter else F.array(text)


def replace_all(text: Column, old: str, new: str) -> Column:
    """Literal replacement; replacing nothing changes nothing."""
    return F.replace(text, F.lit(old), F.lit(new)) if old else text


def trim_ascii(text: Column) -> Column:
    """Without blanks, tabs, carriage returns and line feeds at the ends."""
    return F.btrim(text, F.lit(" \t\r\n"))


def make_indent(width: int, depth: Column) -> Column:
    return F.repeat(F.lit(" "), F.lit(width) * depth)


def parse_whole_integer(text: Column) -> Column:
    """A 64-bit integer written with digits and a minus only; null otherwise."""
    return F.when(text.rlike(r"\A-?[0-9]+\z"), text.try_cast("long"))


def sanitized(name: str) -> str:
    """A qualified or templated name as an identifier: each run of other characters one underscore unless one stands there, none at the end, no underscore or digit at the front. The prefix of unnamed namespaces is no part of a name."""
    name = re.sub(r"\A(?:\(anonymous namespace\)::)+", "", name)
    joined = re.sub(r"_*[^A-Za-z0-9_]+", lambda run: run[0][: len(run[0]) - len(run[0].lstrip("_"))] or "_", name)
    return joined.rstrip("_").lstrip("_0123456789")


def short_name(name: str) -> str:
    """A qualified name without its namespaces; template arguments stay as written."""
    head, bracket, rest = name.partition("<")
    return re.split(r"::|\.", head)[-1] + bracket + rest
