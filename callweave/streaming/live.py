"""The event operators over streams: the same rows as their batch twins, with state kept for each stream of events."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from callweave.operators.events import CALL, CLEAR, ENTER, LOAD
from callweave.session import shared_dir

EDGE = "stream long, source long, target long"


def _edges(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The pending call is all the state there is."""
    pending = state.get[0] if state.exists else None
    rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
    out = []
    for kind, k in zip(rows["kind"], rows["key"], strict=True):
        if kind == ENTER and pending is not None:
            out.append((key[0], pending, k))
        if kind in (CALL, ENTER, CLEAR, LOAD):
            pending = int(k) if kind == CALL else None
    state.update((pending,))
    yield pd.DataFrame(out, columns=["stream", "source", "target"]).astype("int64")


def call_edges(events: DataFrame) -> DataFrame:
    """Streamed events (stream, ts, event_id, kind, key) -> call edges as events.call_edges() finds them. Within a batch events are put in order; batches come in order."""
    return events.groupBy("stream").applyInPandasWithState(_edges, EDGE, "pending long", "append", GroupStateTimeout.NoTimeout)


def _ordered(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Events wait until the watermark has passed them, then they are taken in order; the pending call and those that wait are the state."""
    pending, held = state.get if state.exists else (None, "[]")
    held = json.loads(held)
    if not state.hasTimedOut:
        for rows in frames:
            at = rows["ts"].astype("datetime64[us]").astype("int64")
            held += [[int(t), int(i), k, int(x)] for t, i, k, x in zip(at, rows["event_id"], rows["kind"], rows["key"], strict=True)]
    held.sort()
    passed = state.getCurrentWatermarkMs()
    due = sum(e[0] <= passed * 1000 for e in held)
    out = []
    for _, _, kind, k in held[:due]:
        if kind == ENTER and pending is not None:
            out.append((key[0], pending, k))
        if kind in (CALL, ENTER, CLEAR, LOAD):
            pending = k if kind == CALL else None
    held = held[due:]
    state.update((pending, json.dumps(held)))
    if held:
        state.setTimeoutTimestamp(max(held[0][0] // 1000 + 1, passed + 1))
    yield pd.DataFrame(out, columns=["stream", "source", "target"]).astype("int64")


def late_call_edges(events: DataFrame, delay: str) -> DataFrame:
    """Streamed events -> call edges as in call_edges(), whatever order they come in, as long as none is `delay` older than the newest before it.

    An event is taken when the watermark has passed it; those that wait are state, as many as a stream has in `delay`. Later ones are
    dropped. What still waits when the stream ends comes with the next event that is newer by `delay`, of any stream.
    """
    late = events.withWatermark("ts", delay)
    return late.groupBy("stream").applyInPandasWithState(_ordered, EDGE, "pending long, held string", "append", GroupStateTimeout.EventTimeTimeout)


def _loads(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    on = bool(state.get[0]) if state.exists else False
    rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
    seen = rows["start"].cummax() | on
    state.update((bool(seen.iloc[-1]),))
    yield rows.loc[seen & (rows["kind"] == LOAD), ["stream", "event_id", "key"]].astype("int64")


def illegal_loads(events: DataFrame, allowed: DataFrame, builtin: Column | None = None) -> DataFrame:
    """Streamed events (stream, ts, event_id, kind, key, start) -> loads after a stream's start of keys that allowed (key), a table, does not have; nor those for which builtin, over events, holds."""
    if builtin is not None:  # such a load starts nothing and is none
        events = events.withColumn("kind", F.when(builtin & (F.col("kind") == LOAD), "none").otherwise(F.col("kind")))
    loads = events.groupBy("stream").applyInPandasWithState(_loads, "stream long, event_id long, key long", "started boolean", "append", GroupStateTimeout.NoTimeout)
    return loads.join(allowed.withColumn("ok", F.lit(True)), "key", "left_outer").where("ok IS NULL").select("stream", "event_id", "key")


#: The entry of a package's model that describes the module itself.
MAIN = "MAIN_MODULE"
#: Hooks that a model is told by; rows of others aren't moved.
TOLD = ("loaded", "read", "invoke", "bound", "builtin", "function")
HOOKS = "stream long, ts timestamp, event_id long, hook string, client boolean, base string, object string, name string, type string, place string"
SHAPE = "stream long, ts timestamp, event_id long, path string, value string"


#: Where a time is missing.
NO_TIME = np.iinfo("int64").min


class _Seen:
    """What a run has shown of its library so far: objects by path, functions by name, bound functions, the module, and whether a call into it is under way."""

    def __init__(self, text: str | None) -> None:
        self.paths, self.names, self.bound, self.module, self.entering = json.loads(text) if text else ({}, {}, {}, None, False)

    def __str__(self) -> str:
        return json.dumps([self.paths, self.names, self.bound, self.module, self.entering])

    def is_module(self, fn: str) -> bool:
        return self.module is not None and (fn == self.module or self.bound.get(self.module) == fn)

    def of(self, base: str, name: str) -> str:
        at = self.paths.get(base, "undefined")
        return name if at == "" else f"{at}.{name}"

    def take(self, e) -> tuple[str, str] | None:
        """What an event adds to the model, if anything."""
        if e.hook == "loaded":
            self.paths[e.object], self.module = "", e.object
            return (MAIN, e.name or e.type) if e.type != "function" or e.name else None
        if e.hook == "read" and e.client and e.base in self.paths:
            if e.type == "function":
                self.names[e.object] = e.name
                return None
            path = self.of(e.base, e.name)
            if e.type == "object":
                self.paths[e.object] = path
            return path, e.type
        if e.hook == "invoke" and ((e.client and e.base in self.paths) or (self.module is not None and e.object == self.module)):
            self.entering = True
        elif e.hook == "bound":
            self.bound[e.object] = e.base
        elif e.hook == "builtin" and self.entering:
            own = self.is_module(e.object)
            known = own or e.object in self.names
            self.entering = not known and e.name == "Promise"
            return (MAIN if own else self.names[e.object], e.name) if known else None
        elif e.hook == "function" and self.entering and not e.place.startswith("(*"):
            self.entering = False
            if self.is_module(e.object):
                return MAIN, e.place
            if e.object in self.names:
                return self.of(e.base, self.names[e.object]), e.place
        return None


class _Hook(NamedTuple):
    ts: int
    event_id: int
    hook: str
    client: bool
    base: str | None
    object: str | None
    name: str | None
    type: str | None
    place: str | None


def _shapes(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Runs are many and short: their rows are taken as lists, since each step over a frame costs more than all their events."""
    seen = _Seen(state.get[0] if state.exists else None)
    rows = []
    for f in frames:
        at = f["ts"].to_numpy("datetime64[ns]").view("int64").tolist()
        rows += map(_Hook, at, *(f[c].tolist() for c in _Hook._fields[1:]))
    rows.sort(key=lambda e: (e.ts == NO_TIME, e.ts, e.event_id))
    out = [(e.ts, e.event_id, *added) for e in rows if (added := seen.take(e))]
    state.update((str(seen),))
    if out:
        ts, ids, paths, values = zip(*out, strict=True)
        own = {"stream": np.full(len(out), key[0], "int64"), "ts": np.array(ts, "int64").view("datetime64[ns]"), "event_id": np.array(ids, "int64")}
        yield pd.DataFrame({**own, "path": np.array(paths, object), "value": np.array(values, object)})


def shapes(hooks: DataFrame) -> DataFrame:
    """Streamed hooks (columns as in HOOKS) -> (stream, ts, event_id, path, value): what each adds to the model of the library that its run uses.

    loaded: the library's module is `object`, of a type, or a built-in of a name; read: client code reads property `name` of
    base and gets `object`, of a type; invoke: a call of `object` on base; builtin, function: a built-in function of a name, or
    one at a place, is entered, `object` on base; bound: `object` is base, bound. A property that is no function is described by
    its type, at its path of names from the module; a function by the place, or the built-in name, that is entered when
    client code calls into the library. Entered on a receiver that no read gave, a function is under `undefined`. State
    is one text a run, as large as what its client code has read.
    """
    told = hooks.where(F.col("hook").isin(*TOLD))
    return told.groupBy("stream").applyInPandasWithState(_shapes, SHAPE, "seen string", "append", GroupStateTimeout.NoTimeout)


def package_model(shape: DataFrame) -> DataFrame:
    """(stream, path, value): the last value that shapes() gives each path."""
    return shape.groupBy("stream", "path").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))


def drained(stream: DataFrame) -> DataFrame:
    """Everything that the stream gives from what its source has now, as a table in the shared folder."""
    spark = stream.sparkSession
    at = f"{shared_dir(spark).rstrip('/')}/callweave-stream-{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")
