"""Operators with state per connection and per source, for streams of packets.

Rows of a key are taken in the order (``ts``, ``packet_id``) within a micro-batch, so a task holds
the rows that one key has in one micro-batch; ``maxFilesPerTrigger`` bounds that. The state itself
is a few numbers per key and lives in the state store. Connections are many and short, and a call of Python and
a visit to the state store for each would take nearly all of the time: they share state by hashed buckets.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewatch.functions import packets as p
from tidewatch.operators.connections import MAX_AGE
from tidewatch.operators.scans import PORTS, WITHIN
from tidewatch.schemas import CONNECTION

WATERMARK = "30 seconds"

# Send the processors below to the workers as code, so that workers need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Not "_micros": pandas renames columns with a leading underscore on this path.
_MICROS = "micros"
_BUCKET = "bucket"

# Fixed value: groups of connections that share a row of state. A running stream can't change it.
BUCKETS = 512

# What is known of a connection, in the order in which it is stored.
_COUNTED = ["start", "count", "bytes"]


def in_event_time(stream: DataFrame, delay: str = WATERMARK, unique: bool = False) -> DataFrame:
    """Set the watermark; drop repeats of a packet within it unless packets are ``unique`` already."""
    timed = stream.withWatermark("ts", delay)
    return timed if unique else timed.dropDuplicatesWithinWatermark(["packet_id"])


def _in_order(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values([_MICROS, "packet_id"])


class ConnectionCounter(StatefulProcessor):
    """Numbers the packets of a bucket's connections and forgets each ``age`` microseconds after its start.

    The state is one row per bucket: its connections, and of each the start, the packets and their bytes since.
    """

    def __init__(self, age: int, keys: list[T.StructField]):
        self.age, self.keys = age, keys

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        fields = [*self.keys, *[T.StructField(c, T.LongType()) for c in _COUNTED]]
        self.state = handle.getValueState(
            "connections", T.StructType([T.StructField(f.name, T.ArrayType(f.dataType)) for f in fields]))

    def handleInputRows(self, key, rows, timerValues):
        batch = pd.concat(list(rows), ignore_index=True)
        known = self._known()
        both = pd.concat([known[CONNECTION], batch[CONNECTION]], ignore_index=True) if len(known) else batch[CONNECTION]
        codes = both.groupby(CONNECTION, dropna=False, sort=False).ngroup().to_numpy()
        batch = batch.assign(code=codes[len(known):]).sort_values(["code", _MICROS, "packet_id"], ignore_index=True)
        code, us = batch["code"].to_numpy(), batch[_MICROS].to_numpy()
        sizes = batch["frame_len"].fillna(0).to_numpy("int64")

        # one group of rows per connection; known ones have the first codes
        first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        stop = np.append(first[1:], len(code))
        start, count, total = us[first].copy(), np.zeros(len(first), "int64"), np.zeros(len(first), "int64")
        old = np.flatnonzero(code[first] < len(known))
        old = old[us[first[old]] - known["start"].to_numpy()[code[first[old]]] <= self.age]
        start[old], count[old], total[old] = (known[c].to_numpy()[code[first[old]]] for c in _COUNTED)

        # counts begin at each connection's first row, and at rows too old for the start before
        late = us - np.repeat(start, stop - first) > self.age
        again = []
        for k in np.flatnonzero(np.logical_or.reduceat(late, first)).tolist():
            at, end = int(first[k] + late[first[k]:stop[k]].argmax()), int(stop[k])
            while at < end:
                again.append(at)
                at += int(np.searchsorted(us[at:end], us[at] + self.age, side="right"))
        again = np.asarray(again, "int64")
        begins = np.concatenate([first, again])
        order = np.argsort(begins)
        begins, length = begins[order], np.diff(np.append(begins[order], len(code)))
        running = np.cumsum(sizes)
        start, count, total = (np.append(x, y)[order] for x, y in (
            (start, us[again]), (count, np.zeros_like(again)), (total, np.zeros_like(again))))
        counts = np.arange(1, len(code) + 1) + np.repeat(count - begins, length)
        totals = running + np.repeat(total - running[begins] + sizes[begins], length)

        last = stop - 1
        newest = batch.loc[last, CONNECTION].assign(
            start=np.repeat(start, length)[last], count=counts[last], bytes=totals[last])
        self._remember(known, ~np.isin(np.arange(len(known)), code[first]), newest, timerValues)
        yield batch.drop(columns=[_MICROS, _BUCKET, "code"]).assign(count=counts, running_bytes=totals)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.state.clear()
        return iter([])

    def _known(self) -> pd.DataFrame:
        stored = self.state.get() if self.state.exists() else [[] for _ in [*CONNECTION, *_COUNTED]]
        return pd.DataFrame(dict(zip([*CONNECTION, *_COUNTED], map(list, stored))))

    def _remember(self, known: pd.DataFrame, untouched: np.ndarray, newest: pd.DataFrame, timerValues) -> None:
        """Store ``newest`` and those of the untouched connections to which packets may still come."""
        starts = known["start"].to_numpy()
        stays = untouched & ((starts + self.age) // 1000 + 1 > timerValues.getCurrentWatermarkInMs())
        kept = pd.concat([known[stays], newest], ignore_index=True) if stays.any() else newest
        columns = [[None if pd.isna(x) else x for x in kept[f.name].tolist()] for f in self.keys]
        columns = [[x if x is None or not isinstance(f.dataType, T.IntegralType) else int(x) for x in own]
                   for f, own in zip(self.keys, columns)]
        self.state.update((*columns, *(kept[c].astype("int64").tolist() for c in _COUNTED)))
        # one timer, for when the youngest connection is forgotten and the bucket with it
        before, now = (int(starts.max()) if len(starts) else None), int(kept["start"].max())
        if now != before:
            if before is not None:
                self.handle.deleteTimer(self._expiry(before))
            self.handle.registerTimer(self._expiry(now))

    def _expiry(self, start: int) -> int:
        """The first millisecond by which any further packet belongs to a new count."""
        return (start + self.age) // 1000 + 1


class ScanTracker(StatefulProcessor):
    """Marks the bare SYNs of a source once it has tried more than ``ports`` ports.

    No more than ``ports + 1`` ports are remembered per source; further ones change nothing. With ``forget``
    (microseconds) a source is forgotten that long after its first bare SYN, and its next one starts anew.
    """

    def __init__(self, ports: int, within: int, forget: int | None = None):
        self.ports, self.within, self.forget = ports, within, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("source", "first_seen long, ports array<int>")

    def handleInputRows(self, key, rows, timerValues):
        batch = _in_order(rows)
        us, tried = batch[_MICROS].to_numpy(), batch["dst_port"].to_numpy()
        hit = np.zeros(len(us), bool)
        first_seen, seen = self.state.get() if self.state.exists() else (None, [])
        known, at = first_seen, 0
        while at < len(us):
            if first_seen is None or self.forget is not None and us[at] >= first_seen + self.forget:
                first_seen, seen = int(us[at]), []
            end = len(us)
            if self.forget is not None:
                end = int(np.searchsorted(us, first_seen + self.forget, side="left"))
            part = pd.Series(tried[at:end])
            new = np.flatnonzero(~part.isin(list(seen)).to_numpy() & ~part.duplicated().to_numpy())
            missing = self.ports + 1 - len(seen)
            if missing <= 0:
                reached = 0
            else:
                reached = new[missing - 1] if len(new) >= missing else end - at
            hit[at:end] = (np.arange(end - at) >= reached) & (us[at:end] < first_seen + self.within)
            seen = [*seen, *(int(port) for port in tried[at:end][new[: max(missing, 0)]])]
            at = end
        self.state.update((first_seen, seen))
        if self.forget is not None and first_seen != known:
            if known is not None:
                self.handle.deleteTimer(self._expiry(known))
            self.handle.registerTimer(self._expiry(first_seen))
        yield batch.drop(columns=_MICROS).assign(port_scan=hit)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.state.clear()
        return iter([])

    def _expiry(self, start: int) -> int:
        """The first millisecond by which any further packet starts the source anew."""
        return (start + self.forget) // 1000 + 1


def _keyed(stream: DataFrame) -> DataFrame:
    return stream.withColumn(_MICROS, F.unix_micros("ts"))


def _with(schema: T.StructType, *fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([*schema.fields, *[T.StructField(n, t) for n, t in fields]])


def stream_connection_count(stream: DataFrame, max_age: float = MAX_AGE) -> DataFrame:
    """Add ``count`` and ``running_bytes`` per TCP connection; other packets count as 1.

    The stream needs a watermark on ``ts``, by which idle connections are forgotten. A task holds a bucket's rows
    of one micro-batch, and its connections that are not yet forgotten.
    """
    added = [("count", T.LongType()), ("running_bytes", T.LongType())]
    bucket = F.pmod(F.xxhash64(*CONNECTION), F.lit(BUCKETS)).cast("int")
    keyed = _keyed(stream.filter(p.in_connection())).withColumn(_BUCKET, bucket)
    counted = keyed.groupBy(_BUCKET).transformWithStateInPandas(
        ConnectionCounter(round(max_age * 1_000_000), [stream.schema[c] for c in CONNECTION]),
        outputStructType=_with(stream.schema, *added),
        outputMode="Append",
        timeMode="EventTime",
    )
    single = stream.filter(~p.in_connection()).withColumns({
        "count": F.lit(1).cast("long"), "running_bytes": F.col("frame_len").cast("long"),
    })
    return counted.unionByName(single)


def stream_port_scan(
    stream: DataFrame, ports: int = PORTS, within: float = WITHIN, forget: float | None = None
) -> DataFrame:
    """Add ``port_scan``. Only bare SYNs go through the state.

    Without ``forget`` the clock of a source never resets and its state stays. With it (seconds) the stream needs a
    watermark on ``ts``: the state of a source goes that long after its first bare SYN, so that only sources
    of so much time are known at any moment.
    """
    micros = None if forget is None else round(forget * 1_000_000)
    tracked = _keyed(stream.filter(p.is_bare_syn())).groupBy("src_ip").transformWithStateInPandas(
        ScanTracker(ports, round(within * 1_000_000), micros),
        outputStructType=_with(stream.schema, ("port_scan", T.BooleanType())),
        outputMode="Append",
        timeMode="None" if forget is None else "EventTime",
    )
    return tracked.unionByName(
        stream.filter(~p.is_bare_syn()).withColumn("port_scan", F.lit(False))
    )
