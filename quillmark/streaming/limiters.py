"""Stateful time rules: the same transitions for tables (a fold per key) and for streams (state per key).

Rows of one key are taken in order of (time, id). Streams carry a watermark; what arrives later than it is left out.
State is a few numbers for each key and goes by a timer once it says nothing any more.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

HOUR = 3600.0
WATERMARK = "10 minutes"


def micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def fixed_window(started: float | None, attempts: int, now: float, length: float = HOUR) -> tuple[float, int]:
    """The window that an event falls in and its count: a new one begins with the first event later than its length."""
    return (now, 1) if started is None or now - started > length else (started, attempts + 1)


def sliding_log(stamps: list[float], now: float, length: float, limit: int) -> tuple[list[float], bool]:
    """The stamps kept and whether the event is admitted; a rejected one leaves no stamp."""
    kept = [s for s in stamps if now - s < length]
    return (kept, False) if len(kept) >= limit else ([*kept, now], True)


def fixed_window_table(events: DataFrame, key: str, time: str, order: str, limit: int, length: float = HOUR) -> DataFrame:
    """events with attempts and admitted. Arrow batches of one key, state carried between them: a hot key streams
    through and is never held as a whole."""
    def run(pdf: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at: object = None
        started, n = None, 0
        for rows in pdf:
            out = []
            for k, t in zip(rows[key], rows["_t"]):
                if k != at:
                    at, started, n = k, None, 0
                started, n = fixed_window(started, n, t / 1e6, length)
                out.append(n)
            yield rows.drop(columns="_t").assign(attempts=out, admitted=[x <= limit for x in out])

    own = events.withColumn("_t", micros(F.col(time))).repartition(key).sortWithinPartitions(key, "_t", order)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema)
    return own.mapInPandas(run, f"{schema}, attempts long, admitted boolean")


def sliding_log_table(events: DataFrame, key: str, time: str, order: str, limit: int, length: float, success: str | None = None) -> DataFrame:
    """events with admitted, by the sliding log; success, if named, is a boolean column: an admitted success clears the
    key's log. Arrow batches of one key, its log carried between them: at most `limit` stamps."""

    def run(pdf: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at: object = None
        stamps: list[float] = []
        for rows in pdf:
            out = []
            for k, t, cleared in zip(rows[key], rows["_t"], rows[success] if success else [False] * len(rows)):
                if k != at:
                    at, stamps = k, []
                stamps, ok = sliding_log(stamps, t / 1e6, length, limit)
                stamps = [] if ok and cleared else stamps
                out.append(ok)
            yield rows.drop(columns="_t").assign(admitted=out)

    own = events.withColumn("_t", micros(F.col(time))).repartition(key).sortWithinPartitions(key, "_t", order)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema)
    return own.mapInPandas(run, f"{schema}, admitted boolean")


def sessions(events: DataFrame, key: str, time: str, idle_minutes: int, absolute_hours: int) -> DataFrame:
    """Sessions of each key: a new one begins after a gap beyond the idle time. Returns key, session, started, ended,
    n_events, expired (beyond the absolute life at its last event), n_live (events within that life). Windows over one
    key in order of time; no state."""
    w = Window.partitionBy(key).orderBy("_t")
    rows = events.select(key, micros(F.col(time)).alias("_t"))
    begins = F.coalesce(F.col("_t") - F.lag("_t").over(w) > idle_minutes * 60_000_000, F.lit(True))
    numbered = rows.withColumn("_b", begins.cast("int")).withColumn("session", F.sum("_b").over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    first = F.min("_t").over(Window.partitionBy(key, "session"))
    life = absolute_hours * 3_600_000_000
    return numbered.withColumn("_s", first).groupBy(key, "session").agg(
        F.timestamp_micros(F.min("_t")).alias("started"), F.timestamp_micros(F.max("_t")).alias("ended"), F.count("*").alias("n_events"),
        (F.max("_t") - F.min("_t") >= life).alias("expired"), F.count_if(F.col("_t") - F.col("_s") < life).alias("n_live"),
    )


def checked_sessions(requests: DataFrame, now: Column, idle_minutes: int, touch_seconds: int = 300) -> DataFrame:
    """requests with their session (revoked_at, expires_at, idle_expires_at, last_seen_at, auth_version) and user_version:
    refused (revoked, changed, expired, idle, or null), touch (whether last_seen_at is written anew: seen longer ago than
    touch_seconds) and the idle_expires_at that then holds, never beyond expires_at."""
    refused = F.when(F.col("revoked_at").isNotNull(), "revoked").when(F.col("auth_version") != F.col("user_version"), "changed").when(now >= F.col("expires_at"), "expired").when(now >= F.col("idle_expires_at"), "idle")
    rows = requests.withColumn("refused", refused)
    seen = F.col("last_seen_at").isNull() | (F.unix_micros(now) - F.unix_micros("last_seen_at") > touch_seconds * 1_000_000)
    later = F.least(F.col("expires_at"), F.timestamp_micros(F.unix_micros(now) + idle_minutes * 60_000_000))
    rows = rows.withColumn("touch", F.col("refused").isNull() & seen)
    return rows.withColumn("idle_expires_at", F.when(F.col("touch"), later).otherwise(F.col("idle_expires_at")))


class Keyed(StatefulProcessor):
    """A key's state as one value, which goes by an event-time timer: once the watermark has passed the time from which on
    it says nothing, no row can come any more that it would matter for, and the key takes no room."""

    schema: str

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", f"{self.schema}, until long")

    def found(self) -> tuple | None:
        return tuple(self.state.get())[:-1] if self.state.exists() else None

    def keep(self, values: tuple | None, until: float, watermark: int) -> None:
        """Hold the values until the second `until`, exclusively; None, or a time already past, holds nothing."""
        at = int(until * 1000) + 1
        before = self.state.get()[-1] if self.state.exists() else None
        if before is not None and (values is None or before != at):
            self.handle.deleteTimer(before)
        if values is None or at <= watermark:
            if before is not None:
                self.state.clear()
            return
        if before != at:
            self.handle.registerTimer(at)
        self.state.update((*values, at))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        if self.state.exists() and self.state.get()[-1] <= expiredTimerInfo.getExpiryTimeInMs():
            self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def in_order(rows: Iterator[pd.DataFrame]) -> list:
    return sorted((x for pdf in rows for x in pdf.itertuples(index=False)), key=lambda x: (x.t, x.event_id))


class FixedWindow(Keyed):
    """The fixed-window limiter as a keyed stateful operator. State goes with its window: the next event begins a new one
    anyway."""

    schema = "started double, attempts long"

    def __init__(self, limit: int, length: float = HOUR):
        self.limit, self.length = limit, length

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        started, n = self.found() or (None, 0)
        out = []
        for r in in_order(rows):
            started, n = fixed_window(started, n, r.t / 1e6, self.length)
            out.append((key[0], r.event_id, n, n <= self.limit))
        if started is not None:
            self.keep((started, n), started + self.length, timerValues.getCurrentWatermarkInMs())
        yield pd.DataFrame(out, columns=["key", "event_id", "attempts", "admitted"])


class SlidingLog(Keyed):
    """The sliding log as a keyed stateful operator: the stamps kept, `limit` at most, as one value, until the last one is
    too old to count."""

    schema = "stamps string"

    def __init__(self, limit: int, length: float):
        self.limit, self.length = limit, length

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        stamps = [float(x) for x in (self.found() or ("",))[0].split()]
        out = []
        for r in in_order(rows):
            stamps, ok = sliding_log(stamps, r.t / 1e6, self.length, self.limit)
            stamps = [] if ok and r.success else stamps
            out.append((key[0], r.event_id, ok))
        self.keep((" ".join(map(repr, stamps)),) if stamps else None, stamps[-1] + self.length if stamps else 0, timerValues.getCurrentWatermarkInMs())
        yield pd.DataFrame(out, columns=["key", "event_id", "admitted"])


class Sessions(Keyed):
    """Sessions as keyed state: logins, requests and revocations of a key in order. A session's state goes with its idle
    end, since no request can be admitted after it."""

    schema = "expires double, idle double, seen double"

    def __init__(self, idle: float, absolute: float, touch: float):
        self.rule = idle, absolute, touch

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        session, out = self.found(), []
        for r in in_order(rows):
            session, admitted, touched = session_step(session, r.kind, r.t / 1e6, *self.rule)
            if r.kind == "request":
                out.append((key[0], r.event_id, admitted, touched))
        self.keep(session, session[1] if session else 0, timerValues.getCurrentWatermarkInMs())
        yield pd.DataFrame(out, columns=["key", "event_id", "admitted", "touched"])


def session_step(session: tuple | None, kind: str, now: float, idle: float, absolute: float, touch: float) -> tuple[tuple | None, bool, bool]:
    """(absolute end, idle end, last written), or None, after a row: also whether it is admitted, and whether it writes the
    session anew, which a request does that comes more than `touch` seconds after the last one that did. A login begins a
    session in place of any other; a revocation ends it; the idle end is never beyond the absolute one."""
    if kind == "login":
        return (now + absolute, min(now + absolute, now + idle), now), True, False
    if kind != "request" or session is None or now >= session[1]:
        return None, False, False
    if now - session[2] > touch:
        return (session[0], min(session[0], now + idle), now), True, True
    return session, True, False


def session_requests(events: DataFrame, key: str, time: str, order: str, kind: str, idle: float, absolute: float, touch: float = 300.0) -> DataFrame:
    """The requests among events (kind: login, request or revoke) with admitted and touched, by the rule of `session_step`.
    Arrow batches of one key, its session carried between them."""

    def run(pdf: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at: object = None
        session: tuple | None = None
        for rows in pdf:
            out = []
            for k, t, what in zip(rows[key], rows["_t"], rows[kind]):
                if k != at:
                    at, session = k, None
                session, admitted, touched = session_step(session, what, t / 1e6, idle, absolute, touch)
                out.append((admitted, touched))
            yield rows.drop(columns="_t").assign(admitted=[x[0] for x in out], touched=[x[1] for x in out])[rows[kind].eq("request")]

    own = events.withColumn("_t", micros(F.col(time))).repartition(key).sortWithinPartitions(key, "_t", order)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema)
    return own.mapInPandas(run, f"{schema}, admitted boolean, touched boolean")


def _timed(events: DataFrame, key: str, time: str, *more: Column) -> DataFrame:
    return events.select(F.col(key).cast("string").alias("key"), "event_id", micros(F.col(time)).alias("t"), *more, F.col(time).cast("timestamp").alias("_at")).withWatermark("_at", WATERMARK)


def sliding_log_stream(events: DataFrame, key: str, time: str, limit: int, length: float, success: str | None = None) -> DataFrame:
    """The sliding log over a stream of events (event_id, key, time): key, event_id, admitted. Event-time timers: what comes
    later than the watermark is left out."""
    own = _timed(events, key, time, (F.col(success) if success else F.lit(False)).alias("success"))
    return own.groupBy("key").transformWithStateInPandas(SlidingLog(limit, length), "key string, event_id long, admitted boolean", "Append", "EventTime")


def fixed_window_stream(events: DataFrame, key: str, time: str, limit: int, length: float = HOUR) -> DataFrame:
    """The limiter over a stream of events (event_id, key, time): key, event_id, attempts, admitted."""
    return _timed(events, key, time).groupBy("key").transformWithStateInPandas(FixedWindow(limit, length), "key string, event_id long, attempts long, admitted boolean", "Append", "EventTime")


def session_stream(requests: DataFrame, revocations: DataFrame, key: str, time: str, kind: str, idle: float, absolute: float, touch: float = 300.0) -> DataFrame:
    """Sessions over two streams, logins and requests (event_id, key, time, kind) and revocations (event_id, key, time): key,
    event_id, admitted, touched of each request."""
    rows = requests.select("event_id", key, time, F.col(kind).alias("kind")).unionByName(revocations.select("event_id", key, time, F.lit("revoke").alias("kind")))
    return _timed(rows, key, time, F.col("kind")).groupBy("key").transformWithStateInPandas(Sessions(idle, absolute, touch), "key string, event_id long, admitted boolean, touched boolean", "Append", "EventTime")


def windowed_counts(events: DataFrame, key: str, time: str, length: str = "1 hour") -> DataFrame:
    """Counts of each key and window over a stream or a table; late rows beyond the watermark are left out of streams."""
    own = events.withColumn("_at", F.col(time).cast("timestamp"))
    own = own.withWatermark("_at", WATERMARK) if events.isStreaming else own
    return own.groupBy(F.window("_at", length), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("started"), key, "n")
