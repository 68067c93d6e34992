"""Named commands: request and response documents over registered functions, for one document, for rows, and for whole DataFrames.

A handler takes a request record (or nothing) and returns a response (or nothing). Payloads are JSON texts: null stands for {},
requests are declared records, or dicts of fields with defaults, and are read by the overlay rules; responses are written canonically, as
their declared type says if there is one; no response is null. An unknown name is an error; in row form errors are a column.
"""

from __future__ import annotations

import inspect
import threading
import typing
from collections.abc import Callable
from concurrent.futures import Future
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.jsontext import dump, parse_or_null
from quillstone.plans import export, records
from quillstone.plans import model as m


class UnknownCommand(KeyError):
    """No command has this name."""


class Completer:
    """Settles once; later tries are ignored; one dropped without an answer is rejected."""

    def __init__(self):
        self.future: Future = Future()
        self._lock, self._settled = threading.Lock(), False

    def _settle(self, act: Callable[[], None]) -> bool:
        with self._lock:
            if self._settled:
                return False
            self._settled = True
        act()
        return True

    def resolve(self, value: Any = None) -> bool:
        return self._settle(lambda: self.future.set_result(value))

    def reject(self, reason: str) -> bool:
        return self._settle(lambda: self.future.set_exception(RuntimeError(reason)))

    def __del__(self):
        self.reject("the command was dropped without an answer")


@dataclass(frozen=True)
class Handler:
    call: Callable
    takes: bool
    answers: bool
    is_async: bool = False
    #: A record type, or request fields with defaults; other keys are left out. None: the payload as it is.
    request: m.Record | tuple[tuple[str, Any], ...] | None = None
    response: m.Type | None = None

    def read(self, payload: Any) -> Any:
        if isinstance(self.request, m.Record):
            return records.load(self.request, {} if payload is None else payload, self.request.fresh())
        return _laid_over(self.request, payload)

    def run(self, payload: Any) -> Any:
        out = self.call(*([self.read(payload)] if self.takes else []))
        if not self.answers:
            return None
        return out if self.response is None else records.save(self.response, out)


def _laid_over(fields: tuple[tuple[str, Any], ...] | None, payload: Any) -> Any:
    if payload is None:
        payload = {}
    if fields is None:
        return payload
    given = payload if isinstance(payload, dict) else {}

    def read(default: Any, value: Any) -> Any:
        if isinstance(default, bool):
            return value if isinstance(value, bool) else default
        if isinstance(default, int | float):
            number = isinstance(value, int | float) and not isinstance(value, bool)
            return type(default)(value) if number else default
        if isinstance(default, list | dict):
            return value if isinstance(value, type(default)) else type(default)()
        if isinstance(default, str):
            return value if isinstance(value, str) else default
        return value if value is not None else default

    return {k: read(d, given[k]) if k in given else ([] if isinstance(d, list) else {} if isinstance(d, dict) else d) for k, d in fields}


class Shape(typing.NamedTuple):
    """What a function's signature tells of a handler."""

    takes: bool
    answers: bool
    is_async: bool


def describe(call: Callable) -> Shape:
    s = inspect.signature(call)
    hints = typing.get_type_hints(call)
    later = any(hints.get(name) is Completer for name in s.parameters)
    return Shape(bool(s.parameters), later or hints.get("return", Any) is not type(None), later)


@dataclass
class CommandTable:
    handlers: dict[str, Handler] = field(default_factory=dict)

    def on(self, name: str, call: Callable, request: m.Record | dict[str, Any] | None = None, response: m.Type | None = None) -> None:
        """Registers, or replaces, a function; its signature tells which of the four shapes it has, and whether it answers later (a second parameter, or a coroutine's)."""
        shape = describe(call)
        self.handlers[name] = Handler(call, shape.takes, shape.answers, shape.is_async, tuple(request.items()) if isinstance(request, dict) else request, response)

    def on_async(self, name: str, call: Callable[[Any, Completer], None], request: m.Record | dict[str, Any] | None = None) -> None:
        """A function of (request, completer) that may answer later, from any thread."""
        self.handlers[name] = Handler(call, True, True, True, tuple(request.items()) if isinstance(request, dict) else request)

    def has(self, name: str) -> bool:
        return name in self.handlers

    def dispatch(self, name: str, payload: Any = None) -> Any:
        if name not in self.handlers:
            raise UnknownCommand(name)
        if self.handlers[name].is_async:
            raise RuntimeError(f"{name} answers later only")
        return self.handlers[name].run(payload)

    def dispatch_async(self, name: str, payload: Any = None) -> Future:
        """The answer as a future; whatever goes wrong is in it."""
        completer = Completer()
        future = completer.future
        h = self.handlers.get(name)
        try:
            if h is None:
                raise UnknownCommand(name)
            if h.is_async:
                h.call(h.read(payload), completer)
            else:
                completer.resolve(h.run(payload))
        except Exception as e:  # handlers are foreign code
            completer.reject(str(e))
        return future

    def column(self, name: Column, payload: Column) -> Column:
        """struct(ok, response, error): each row's command run on its JSON payload; rows are independent and handlers must be picklable."""
        held = {n: h for n, h in self.handlers.items() if not h.is_async}

        @F.pandas_udf("ok boolean, response string, error string")
        def run(names: pd.Series, payloads: pd.Series) -> pd.DataFrame:
            rows = []
            for n, p in zip(names, payloads, strict=True):
                if n not in held:
                    rows.append((False, None, f"unknown command {n}"))
                    continue
                try:
                    rows.append((True, dump(held[n].run(parse_or_null(p) if p is not None else None)), None))
                except Exception as e:  # handlers are foreign code
                    rows.append((False, None, str(e)))
            return pd.DataFrame(rows, columns=["ok", "response", "error"])

        return run(name, payload)


@dataclass
class FrameCommands:
    """Commands over whole DataFrames: each takes the rows addressed to it."""

    handlers: dict[str, Callable[[DataFrame], DataFrame]] = field(default_factory=dict)

    def on(self, name: str, call: Callable[[DataFrame], DataFrame]) -> None:
        self.handlers[name] = call

    def dispatch(self, requests: DataFrame, name: str = "name") -> DataFrame:
        """The union of what the handlers make of their rows; handlers return one schema. Names without a handler are an error when rows carry them."""
        from functools import reduce

        if not self.handlers:
            raise UnknownCommand("no commands are registered")
        made = [call(requests.filter(F.col(name) == n)) for n, call in self.handlers.items()]
        first = made[0].schema
        strange = requests.filter(~F.coalesce(F.col(name).isin(list(self.handlers)), F.lit(False)))
        failed = strange.select(*[F.raise_error(F.concat(F.lit("unknown command "), F.coalesce(F.col(name), F.lit("null")))).cast(f.dataType).alias(f.name) for f in first])
        return reduce(DataFrame.unionByName, [*made, failed])


class Api:
    """Declares commands, events and nested APIs; prefixes names with dots."""

    def __init__(self):
        self.members: list[tuple[str, str, Any]] = []

    @classmethod
    def of(cls, *apis: Api, **members: Any) -> Api:
        """A declaration in one line: functions are commands, APIs are nested, whatever else listens is an event; unnamed APIs' members are taken over."""
        out = cls()
        for api in apis:
            out.members += api.members
        for name, member in members.items():
            if isinstance(member, Api):
                out.use(name, member)
            elif hasattr(member, "listen"):
                out.event(name, member)
            else:
                out.command(name)(member)
        return out

    def command(self, name: str | None = None, request: m.Record | dict[str, Any] | None = None, response: m.Type | None = None):
        def add(call: Callable) -> Callable:
            self.members.append(("command", name or call.__name__, (call, request, response)))
            return call

        return add

    def event(self, name: str, event: Any, payload: m.Type | None = None, collection: str = "", key: str = "") -> Any:
        self.members.append(("event", name, (event, payload, collection, key)))
        return event

    def described(self, base: str = "schema") -> export.Context:
        """The commands and events with their declared types, as exports take them."""
        ctx = export.Context(base=base)
        for kind, name, member in self.walk():
            if kind == "command":
                ctx.commands.append(export.Command(name, member[1] if isinstance(member[1], m.Record) else None, member[2]))
            else:
                ctx.events.append(export.EventType(name, member[1] or m.Raw(), *member[2:]))
        return ctx

    def use(self, name: str, api: Api) -> None:
        self.members.append(("api", name, api))

    def walk(self, prefix: str = ""):
        """(kind, full name, member) of all, nested ones too."""
        for kind, name, member in self.members:
            full = f"{prefix}.{name}" if prefix else name
            if kind == "api":
                yield from member.walk(full)
            else:
                yield kind, full, member

    def bind(self, table: CommandTable, bridge: Any = None) -> None:
        for kind, name, member in self.walk():
            if kind == "command":
                table.on(name, *member)
            elif bridge is not None:
                bridge.attach(name, member[0])
