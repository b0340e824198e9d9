"""Rate limiting of a request stream (ST1)."""

from __future__ import annotations

from bisect import insort
from collections import deque
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from newswatch.operators.activity import RATE_LIMITS, RATE_WINDOW_SECONDS

SECOND = 1_000_000

OUTPUT = StructType(
    [
        StructField("activity_id", StringType()),
        StructField("scope", StringType()),
        StructField("client_ip", StringType()),
        StructField("allowed", BooleanType()),
        StructField("retry_after", LongType()),
    ]
)
ADMITTED = StructType([StructField("at", LongType())])
PART = StructType([StructField("level", LongType()), StructField("start", LongType()), StructField("chunk", LongType())])
HELD = StructType([StructField("at", ArrayType(LongType())), StructField("ids", ArrayType(StringType()))])
# Of each part that holds calls: level, start, number of chunks, number of calls, first time.
OPEN = StructType([StructField(name, ArrayType(LongType())) for name in ("level", "start", "chunks", "calls", "first")])
SLICE_SECONDS = 60  # verdicts are given slice by slice
# Widths of the parts that held calls are kept in: all time, hours, slices. A part takes ROOM calls, further ones go to narrower parts.
WIDTHS = (1 << 62, 3600 * SECOND, SLICE_SECONDS * SECOND)
ROOM = 16_384


def admit(admitted: deque, times: Iterable[int], window: int, limit: int) -> Iterator[tuple[bool, int]]:
    """Decide calls in time order; ``admitted`` holds the admitted times still in the window.

    Refused calls are not counted. Refused ones get the seconds until the
    oldest admitted call leaves the window, at least one.
    """
    for now in times:
        while admitted and admitted[0] <= now - window:
            admitted.popleft()
        if len(admitted) >= limit:
            yield False, max(1, (admitted[0] + window - now) // SECOND)
        else:
            insort(admitted, now)  # at the end, but for a call later than is waited for
            yield True, 0


def split(calls: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Calls with a time and calls without one."""
    known = calls["at_us"].notna()
    return calls[known].astype({"at_us": "int64"}), calls[~known]


def verdicts(key, calls: pd.DataFrame, allowed, retry) -> pd.DataFrame:
    scope, client = key
    columns = {"scope": scope, "client_ip": client, "allowed": allowed, "retry_after": retry}
    return pd.DataFrame({"activity_id": calls["activity_id"], **columns})


class RateLimiter(StatefulProcessor):
    """State per (scope, client): at most ``limit`` admitted times."""

    def __init__(self, window_seconds: int, limits: dict[str, int]):
        self.window, self.limits = window_seconds * SECOND, limits

    def init(self, handle) -> None:
        self.admitted = handle.getListState("admitted", ADMITTED)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # a key's rows of one micro-batch: two narrow columns, put in time order
        timed, untimed = split(pd.concat(list(rows), ignore_index=True))
        if len(untimed):
            yield verdicts(key, untimed, None, None)
        if len(timed):
            yield from self.judged(key, [timed])

    def judged(self, key, pieces: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Verdicts of calls that come in pieces, each later than the one before; the state is read and written once."""
        known = deque(at for (at,) in self.admitted.get()) if self.admitted.exists() else deque()
        for calls in pieces:
            calls = calls.sort_values(["at_us", "activity_id"])
            decided = list(admit(known, calls["at_us"].tolist(), self.window, self.limits[key[0]]))
            yield verdicts(key, calls, *zip(*decided, strict=True))
        if known:
            self.admitted.put([(int(at),) for at in known])
        else:
            self.admitted.clear()

    def close(self) -> None:
        pass


class PatientRateLimiter(RateLimiter):
    """Holds calls back, until no call before their slice's end is waited for.

    State per (scope, client): the admitted times and the calls held, in parts. The first ROOM calls are one
    part; while it is full, further ones go to a part of their hour and, while that is full, of their slice, so a
    task holds two full parts and one slice of one client. One timer a client, at the end of its earliest
    slice, judges all slices that the watermark has passed.
    """

    def init(self, handle) -> None:
        super().init(handle)
        self.handle = handle
        self.held = handle.getMapState("held", PART, HELD)
        self.open = handle.getValueState("open", OPEN)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        parts = self.parts()
        before = self.wake(parts)
        for chunk in rows:
            timed, untimed = split(chunk[chunk["activity_id"].notna()])
            if len(untimed):
                yield verdicts(key, untimed, None, None)
            self.hold(parts, timed)
        if parts:
            # a slice whose end is past already is judged by the timer in this same micro-batch
            self.keep(parts, before)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs() * 1000 // WIDTHS[-1] * WIDTHS[-1]
        parts, back = self.parts(), []
        none = pd.DataFrame({"at_us": pd.Series(dtype="int64"), "activity_id": pd.Series(dtype="object")})
        yield from self.judged(key, self.due(parts, none, 0, -WIDTHS[0], until, back))
        for calls in back:
            self.hold(parts, calls)
        self.keep(parts, None)  # the timer that brought us here is gone

    def parts(self) -> dict[tuple[int, int], list[int]]:
        """(level, start) of every part that holds calls: number of chunks, number of calls, first time."""
        found = self.open.get()
        return {(level, start): rest for level, start, *rest in zip(*found, strict=True)} if found else {}

    def wake(self, parts: dict) -> int | None:
        """The end of the earliest slice with a call, in milliseconds."""
        first = min((first for _, _, first in parts.values()), default=None)
        return None if first is None else (first // WIDTHS[-1] + 1) * SLICE_SECONDS * 1000

    def keep(self, parts: dict, timer: int | None) -> None:
        """Store what is held and see that it is judged in time; `timer` is registered already."""
        if parts:
            self.open.update(tuple(list(c) for c in zip(*[(*k, *v) for k, v in parts.items()], strict=True)))
        else:
            self.open.clear()
        now = self.wake(parts)
        if now != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if now is not None:
                self.handle.registerTimer(now)

    def hold(self, parts: dict, calls: pd.DataFrame) -> None:
        for level, width in enumerate(WIDTHS):
            left = []
            for start, own in calls.groupby(calls["at_us"] // width * width):
                chunks, n, first = parts.get((level, int(start)), (0, 0, None))
                if n + len(own) > ROOM and level < len(WIDTHS) - 1:
                    left.append(own)
                    continue
                at = own["at_us"].tolist()
                self.held.updateValue((level, int(start), chunks), (at, own["activity_id"].tolist()))
                parts[level, int(start)] = [chunks + 1, n + len(at), min(at) if first is None else min(first, *at)]
            if not left:
                return
            calls = pd.concat(left)

    def take(self, parts: dict, level: int, start: int) -> pd.DataFrame:
        at, ids = [], []
        chunks, _, _ = parts.pop((level, start), (0, 0, 0))
        for chunk in range(chunks):
            own = self.held.getValue((level, start, chunk))
            self.held.removeKey((level, start, chunk))
            at.extend(own[0])
            ids.extend(own[1])
        return pd.DataFrame({"at_us": pd.Series(at, dtype="int64"), "activity_id": pd.Series(ids, dtype="object")})

    def due(self, parts: dict, calls: pd.DataFrame, level: int, low: int, high: int, back: list) -> Iterator[pd.DataFrame]:
        """`calls` and those held in parts of this level on from `low` to `high`, in pieces that follow each other in time.

        What a part holds from the end of the whole search on goes to ``back``.
        """
        if level < len(WIDTHS):
            width = WIDTHS[level]
            for start in sorted({at // width * width for part, at in parts if part >= level and low <= at < high}):
                end = min(start + width, high)
                earlier, calls = calls[calls["at_us"] < start], calls[calls["at_us"] >= start]
                if len(earlier):
                    yield earlier
                own = pd.concat([calls[calls["at_us"] < end], self.take(parts, level, start)])
                calls = calls[calls["at_us"] >= end]
                if len(over := own[own["at_us"] >= end]):
                    back.append(over)
                yield from self.due(parts, own[own["at_us"] < end], level + 1, start, end, back)
        if len(calls):
            yield calls


def rate_limited(
    calls: DataFrame, window_seconds: int = RATE_WINDOW_SECONDS, limits: dict[str, int] | None = None,
    lateness_seconds: int | None = None,
) -> DataFrame:
    """Admit or refuse every call of a stream (ST1).

    ``calls``: activity_id, scope, client_ip and ``at_us``, the call's time in
    microseconds. Needs the RocksDB state store. A client's verdicts depend on
    each other, so a client stays with one task; the trigger bounds its rows.

    Without ``lateness_seconds`` a call is judged in the micro-batch that brings it. With it, a call is held
    back until the latest call met is more than that many seconds (and a slice) later. Calls that arrive
    at most so late then have the verdicts of the true order, however they are shuffled and cut
    into batches; a call that is later still is judged in the micro-batch that brings it. A call without a
    time cannot be placed: ``allowed`` and ``retry_after`` are NULL. With ``lateness_seconds`` a row whose ``activity_id`` is NULL
    is a heartbeat: it has no verdict and only moves the time on, for instance at the end of a stream.
    """
    columns = ["activity_id", "scope", "client_ip", "at_us"]
    limits, patient = limits or RATE_LIMITS, lateness_seconds is not None
    if patient:
        # the time column is dropped behind the watermark, so that Spark does not drop late calls
        timed = calls.select(*columns, F.timestamp_micros("at_us").alias("at"))
        calls = timed.withWatermark("at", f"{lateness_seconds} seconds")
    limiter = (PatientRateLimiter if patient else RateLimiter)(window_seconds, limits)
    return (
        calls.select(*columns)
        .groupBy("scope", "client_ip")
        .transformWithStateInPandas(limiter, OUTPUT, "append", "eventTime" if patient else "none")
    )
