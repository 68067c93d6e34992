"""Events: named push channels with a latest snapshot, in one process and on Structured Streaming.

In process, delivery is at once, in the publisher's thread, in order, without buffering. On streams, events are rows (seq, name,
payload); order is seq's, delivery is by micro-batch and at least once, so appliers are idempotent by seq.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions import values
from quillstone.functions.jsontext import dump


class Event:
    """Owns its snapshot: publish(value) sets it, then calls the listeners; publish() calls them again."""

    def __init__(self, value: Any = None):
        self._value, self._listeners = value, []

    @property
    def snapshot(self) -> Any:
        return self._value

    def publish(self, *value: Any) -> None:
        if value:
            self._value = value[0]
        for listener in list(self._listeners):
            listener(self.snapshot)

    def listen(self, listener: Callable[[Any], None]) -> Callable[[], None]:
        """Returns what detaches the listener."""
        self._listeners.append(listener)
        return lambda: self._listeners.remove(listener) if listener in self._listeners else None


class RefEvent(Event):
    """Reads state held elsewhere whenever it fires."""

    def __init__(self, read: Callable[[], Any]):
        super().__init__()
        self._read = read

    @property
    def snapshot(self) -> Any:
        return self._read()

    def publish(self) -> None:
        super().publish()


class Bridge:
    """Hands named events, as JSON text, to its transports; detaches from its events when closed."""

    def __init__(self):
        self._transports, self._detach = [], []
        self.current: tuple[str, str] | None = None

    def on_emit(self, transport: Callable[[str, str], None]) -> None:
        self._transports.append(transport)

    def emit(self, name: str, value: Any) -> None:
        self.current = (name, dump(value))
        for t in list(self._transports):
            t(*self.current)

    def attach(self, name: str, event: Event) -> None:
        self._detach.append(event.listen(lambda value: self.emit(name, value)))

    def close(self) -> None:
        while self._detach:
            self._detach.pop()()

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()


def latest(events: DataFrame, by: str = "name", payload: str = "payload", seq: str = "seq") -> DataFrame:
    """Snapshot of each name: the payload with the largest seq. One aggregation, combined on the map side; works on streams too."""
    return events.groupBy(by).agg(F.max_by(payload, seq).alias(payload), F.max(seq).alias(seq))


def with_defaults(snapshots: DataFrame, defaults: dict[str, str], by: str = "name", payload: str = "payload") -> DataFrame:
    """Names without an event yet get their default payload. defaults is a handful of declared names."""
    known = snapshots.sparkSession.createDataFrame(list(defaults.items()), f"`{by}` string, _default string")
    joined = snapshots.join(F.broadcast(known), by, "full")
    return joined.withColumn(payload, F.coalesce(payload, "_default")).drop("_default")


def exploded(events: DataFrame, collection: str, key: str, payload: str = "payload") -> DataFrame:
    """Keyed events: one row for each item of the payload's collection, with its key as text."""
    items = values.as_array(values.find(values.parsed(F.col(payload)), collection))
    rows = events.withColumn("_item", F.explode(items))
    return rows.withColumn("item_key", F.try_variant_get(values.find(F.col("_item"), key), "$", "string")).withColumn("item", F.to_json("_item")).drop("_item")


def prefixed(events: DataFrame, prefix: str, name: str = "name") -> DataFrame:
    return events.withColumn(name, F.concat_ws(".", F.lit(prefix), F.col(name)))


def push(events: DataFrame, deliver: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):
    """Starts a query that hands each micro-batch, ordered by seq, to deliver; stop() detaches it."""
    writer = events.writeStream.foreachBatch(lambda batch, n: deliver(batch.orderBy("seq"), n)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def upsert(target: DataFrame, changes: DataFrame, key: str = "item_key", seq: str = "seq") -> DataFrame:
    """Target with each key's newest row; applying the same changes again changes nothing."""
    rows = target.unionByName(changes.select(*target.columns))
    newest = rows.groupBy(key).agg(F.max_by(F.struct(*target.columns), seq).alias("r"))
    return newest.select("r.*")
