"""Request quotas on a stream, with the open window of every key as state."""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from parapet.functions import fixed
from parapet.functions.clock import epoch_micros, from_micros

_OUT = "quota_key string, request_id %s, us long, window_us long, n long"
_STATE = "window_us long, n long"
#: Arrow's types of request ids.
ID_TYPES = {t.simpleString(): to_arrow_type(t) for t in (T.StringType(), T.LongType(), T.IntegerType(), T.ShortType(), T.BinaryType())}
#: Groups of keys whose held requests share a state.
GROUPS = 64
#: Requests of a group taken in before they are sorted and held, and those of one piece, which ends with a slice.
GATHERED, PIECE = 200_000, 10_000


def _numbered(us: np.ndarray, opened: int | None, n: int, width: int) -> tuple[np.ndarray, np.ndarray, int | None, int]:
    """Window starts and numbers of requests in time order, and the window that is open after them."""
    starts, numbers = np.empty(len(us), "int64"), np.empty(len(us), "int64")
    i = 0
    while i < len(us):
        if opened is None or us[i] - opened >= width:
            opened, n = int(us[i]), 0
        end = max(i + 1, int(np.searchsorted(us, opened + width, side="left")))
        starts[i:end], numbers[i:end] = opened, n + 1 + np.arange(end - i)
        n, i = n + end - i, end
    return starts, numbers, opened, n


def _counter(width: int, idle_ms: int | None = None):
    def count(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(batches)).sort_values(["us", "request_id"], kind="stable")
        us = pdf["us"].to_numpy()
        starts, numbers, opened, n = _numbered(us, *(state.get if state.exists else (None, 0)), width)
        state.update((opened, n))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"quota_key": pd.Series([key[0]] * len(us), dtype=object),
                            "request_id": pdf["request_id"].to_numpy(), "us": us, "window_us": starts, "n": numbers})

    return count


def stream_quota(stream: DataFrame, key: Column, ts: str, request_id: str, limit: int,
                 window_seconds: int = fixed.QUOTA_WINDOW_SECONDS, idle_seconds: int | None = None) -> DataFrame:
    """Number every request of a stream within its key's window: ``quota_key, request_id, ts, window_start, n, denied``.

    Within a micro-batch requests are taken in time order (a key's requests of one micro-batch are held together, so
    the trigger bounds them); across micro-batches in arrival order: a late request counts towards the open window.
    With ``idle_seconds`` a key from which nothing has come for so long (of the job's clock; not less than a window) leaves
    the state. Set it on streams that run on; an ``availableNow`` run may not end with it.
    """
    keyed = stream.select(key.alias("quota_key"), F.col(request_id).alias("request_id"),
                          F.coalesce(epoch_micros(stream, ts), F.lit(0).cast("bigint")).alias("us"))
    counted = keyed.groupBy("quota_key").applyInPandasWithState(
        _counter(window_seconds * 1_000_000, idle_seconds and max(idle_seconds, window_seconds) * 1_000),
        _OUT % dict(keyed.dtypes)["request_id"], _STATE, "append",
        GroupStateTimeout.ProcessingTimeTimeout if idle_seconds else GroupStateTimeout.NoTimeout)
    return counted.select("quota_key", "request_id", from_micros(F.col("us")).alias("ts"),
                          from_micros(F.col("window_us")).alias("window_start"), "n",
                          (F.col("n") > limit).alias("denied"))


def _joined(tables: list[pa.Table]) -> pa.Table:
    return pa.concat_tables([t for t in tables if len(t)], promote_options="permissive").combine_chunks()


class _Ordered(StatefulProcessor):
    """Holds a group's requests back in slices of time and numbers a slice once the watermark has passed its end.

    A group is one quota key or, with ``key`` (the column of the quota key), many: calls to the state store are then shared by
    all of them. State per group: the open windows of its keys, the requests held, packed in pieces of whole slices, and the
    time of the next timer, which is the end of the first held slice or of the first window to end. When a window's timer
    has fired, any request still to come would open a new one, so it leaves the state.
    """

    def __init__(self, width: int, slice_us: int, ids: str, key: str | None = None):
        self.width, self.slice_us, self.key = width, slice_us, key
        self.ids = ID_TYPES.get(ids)  # others as Arrow infers them

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.windows = handle.getValueState("windows", "keys array<string>, opened array<long>, n array<long>")
        self.held = handle.getMapState("held", "slice long, number long", "rows binary")
        self.next = handle.getValueState("next", "us long")

    def _wake(self, us: int) -> None:
        if not self.next.exists() or us < self.next.get()[0]:
            self.handle.registerTimer(us // 1000)
            self.next.update((us,))

    def _hold(self, table: pa.Table, number: int) -> list[int]:
        """Put requests into the state, in pieces that end with a slice; gives the first slice of each."""
        table = table.sort_by("us")
        own = table.column("us").to_numpy() // self.slice_us
        starts = np.searchsorted(own, own[::PIECE])  # where the slice of every so many requests begins
        starts = np.unique(starts)
        for k, (low, high) in enumerate(zip(starts, [*starts[1:], len(own)])):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as out:
                out.write_table(table.slice(low, high - low))
            self.held.updateValue((int(own[low]), number + k), (sink.getvalue().to_pybytes(),))
        return own[starts].tolist()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        number = max((place[1] for place in self.held.keys()), default=-1) + 1
        first, new, count = [], [], 0
        for frame in rows:
            keys = frame[self.key] if self.key else [key[0]] * len(frame)
            new.append(pa.table({"quota_key": pa.array(keys, pa.string(), from_pandas=True), "us": pa.array(frame["us"], pa.int64()),
                                 "request_id": pa.array(frame["request_id"], self.ids, from_pandas=True)}))
            count += len(frame)
            if count >= GATHERED:
                first += self._hold(_joined(new), number + len(first))
                new, count = [], 0
        if count:
            first += self._hold(_joined(new), number + len(first))
        if first:
            self._wake((min(first) + 1) * self.slice_us)
        return iter(())

    def _counted(self, table: pa.Table, windows: dict) -> Iterator[pd.DataFrame]:
        """Requests in time order with their windows and numbers, a frame per slice."""
        frame = table.sort_by([("us", "ascending"), ("request_id", "ascending")]).to_pandas()
        starts, numbers = [], []
        for key, at in zip(frame["quota_key"].tolist(), frame["us"].tolist()):
            opened, n = windows.get(key, (at, 0))
            windows[key] = opened, n = (at, 1) if at - opened >= self.width else (opened, n + 1)
            starts.append(opened)
            numbers.append(n)
        frame = frame.assign(window_us=np.array(starts, "int64"), n=np.array(numbers, "int64"))
        own = frame["us"].to_numpy() // self.slice_us
        cuts = [0, *np.flatnonzero(own[1:] != own[:-1]) + 1, len(own)]
        for low, high in zip(cuts, cuts[1:]):
            yield frame.iloc[low:high]

    def _ends(self, opened: int) -> int:
        """When a window's state may go: slices are counted whole, so requests before the end of its last one may still come."""
        return -(-(opened + self.width) // self.slice_us) * self.slice_us

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        if self.next.exists() and self.next.get()[0] > passed:
            return  # an older timer; what was due is done
        end = passed // self.slice_us  # the first slice that is not due
        places = sorted(tuple(place) for place in self.held.keys())
        windows = {k: (opened, n) for k, opened, n in zip(*self.windows.get())} if self.windows.exists() else {}
        open_ = pa.table({"us": pa.array([], pa.int64())})  # requests of pieces that reach beyond what has been counted
        i = 0
        while True:
            own = open_.column("us").to_numpy() // self.slice_us
            first = min([*own[:1], *(place[0] for place in places[i:i + 1])], default=end)
            if first >= end:
                break
            pieces = [open_]
            while i < len(places) and places[i][0] <= first:
                pieces.append(pa.ipc.open_stream(self.held.getValue(places[i])[0]).read_all())
                self.held.removeKey(places[i])
                i += 1
            open_ = _joined(pieces).sort_by("us")
            own = open_.column("us").to_numpy() // self.slice_us
            stop = int(np.searchsorted(own, min([end, *(place[0] for place in places[i:i + 1])])))
            yield from self._counted(open_.slice(0, stop), windows)
            open_ = open_.slice(stop)
        left = [place[0] for place in places[i:i + 1]]
        if len(open_):
            left += self._hold(open_, max((place[1] for place in places), default=-1) + 1)[:1]
        windows = {k: w for k, w in windows.items() if self._ends(w[0]) > passed}
        if windows:
            opened, n = zip(*windows.values())
            self.windows.update((list(windows), list(opened), list(n)))
        else:
            self.windows.clear()
        self.next.clear()
        ends = [(number + 1) * self.slice_us for number in left] + [self._ends(w[0]) for w in windows.values()]
        if ends:
            self._wake(min(ends))

    def close(self) -> None:
        pass


def stream_quota_in_order(stream: DataFrame, key: Column, ts: str, request_id: str, limit: int,
                          window_seconds: int = fixed.QUOTA_WINDOW_SECONDS, late: str = "10 minutes",
                          slice_seconds: int = 60, groups: int = GROUPS) -> DataFrame:
    """The batch replay's numbers on a stream: ``quota_key, request_id, ts, window_start, n, denied`` in time order.

    Requests are held until the watermark (the latest time seen less ``late``) has passed the end of their slice of time, then
    counted by time and id, whatever order they came in. A request that comes later than that is dropped by the
    watermark, as in any windowed stream; give ``late`` room. Keys are dealt into ``groups`` that share their calls to the state
    store. In memory at once are the open windows of one group and the pieces of its held requests that meet in a slice, where
    ``GATHERED`` requests that came together make pieces of about ``PIECE``. The number of groups stays the same for as long as
    a checkpoint is used. A key without open window or held request has no state.
    Requests of the last ``late`` and slice stay held until time moves on.
    Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``). Requests need a time.
    """
    keyed = stream.select(key.alias("quota_key"), F.col(request_id).alias("request_id"), epoch_micros(stream, ts).alias("us"))
    keyed = keyed.filter(F.col("us").isNotNull()).withColumn("at", from_micros(F.col("us"))).withWatermark("at", late)
    ids = dict(keyed.dtypes)["request_id"]
    shape = T.StructType([T.StructField("quota_key", T.StringType()), T.StructField("request_id", keyed.schema["request_id"].dataType),
                          *[T.StructField(name, T.LongType()) for name in ("us", "window_us", "n")]])
    grouped = keyed.withColumn("group", F.pmod(F.xxhash64("quota_key"), F.lit(groups))).groupBy("group")
    counted = grouped.transformWithStateInPandas(
        _Ordered(window_seconds * 1_000_000, slice_seconds * 1_000_000, ids, "quota_key"), shape, "Append", "EventTime")
    return counted.select("quota_key", "request_id", from_micros(F.col("us")).alias("ts"),
                          from_micros(F.col("window_us")).alias("window_start"), "n", (F.col("n") > limit).alias("denied"))
