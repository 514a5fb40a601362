"""Operators with state of their own over streams: sessions by the end of intervals, the ingest status machine, and once-a-period gates.

State lives in Spark's state store, keyed and checkpointed with the stream; a restart goes on where the last finished batch ended.
They need ``spark.sql.streaming.stateStore.providerClass`` to be the RocksDB provider; ``use_rocksdb`` sets it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SESSIONS = "key string, start_ts timestamp, end_ts timestamp, n_rows long"
STATES = "media_id string, status string, last_error string, retries int, updated_at timestamp"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def merge_spans(spans: list[tuple[int, int, int]], gap: int) -> list[tuple[int, int, int]]:
    """(start, end, rows) of unions: a span continues one whose end so far lies at most ``gap`` before its start."""
    out: list[tuple[int, int, int]] = []
    for start, end, n in sorted(spans):
        if out and start - out[-1][1] <= gap:
            out[-1] = (out[-1][0], max(out[-1][1], end), out[-1][2] + n)
        else:
            out.append((start, end, n))
    return out


def _us(x: pd.Timestamp) -> int:
    return x.value // 1000


def _time(us: int) -> pd.Timestamp:
    return pd.Timestamp(us, unit="us")


def _sessions_frame(key: str, spans: list[tuple[int, int, int]]) -> pd.DataFrame:
    times = {name: pd.Series([_time(s[i]) for s in spans], dtype="datetime64[us]") for i, name in enumerate(("start_ts", "end_ts"))}
    return pd.DataFrame({"key": pd.Series([key] * len(spans), dtype=object), **times, "n_rows": pd.Series([s[2] for s in spans], dtype="int64")})


class Sessions(StatefulProcessor):
    """Open sessions of a key; one is given out, and forgotten, when the watermark has passed its end by the gap: nothing that may still come can continue it."""

    def __init__(self, gap_ms: int) -> None:
        self._gap = gap_ms * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._open = handle.getListState("open", "start long, end long, n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        spans = [tuple(map(int, s)) for s in self._open.get()] if self._open.exists() else []
        had = {self._due(s) for s in spans}
        for part in rows:
            spans += [(_us(a), _us(b), 1) for a, b in zip(part["start_ts"], part["end_ts"])]
        spans = merge_spans(spans, self._gap)
        self._keep(spans)
        due = {self._due(s) for s in spans}
        for t in had - due:
            self._handle.deleteTimer(t)
        for t in due - had:
            self._handle.registerTimer(t)
        yield _sessions_frame(key[0], [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        spans = [tuple(map(int, s)) for s in self._open.get()] if self._open.exists() else []
        done = [s for s in spans if self._due(s) <= at]
        self._keep([s for s in spans if self._due(s) > at])
        yield _sessions_frame(key[0], done)

    def _due(self, span: tuple[int, int, int]) -> int:
        return -(-(span[1] + self._gap) // 1000) + 1

    def _keep(self, spans: list[tuple[int, int, int]]) -> None:
        if spans:
            self._open.put(spans)
        elif self._open.exists():
            self._open.clear()

    def close(self) -> None:
        pass


def sessions(stream: DataFrame, gap_ms: int, delay: str) -> DataFrame:
    """(key, start_ts, end_ts, n_rows) of finished sessions of a stream of (key, start_ts, end_ts).

    Unlike ``session_window``, the gap is measured from the largest end so far. Rows may come late and in any order within ``delay`` of the newest
    start; later ones are left out. Rows without a key or a bound, and those that end before they start, belong to no session.
    """
    known = stream.filter("key is not null and start_ts <= end_ts").withWatermark("start_ts", delay)
    return known.groupBy("key").transformWithStateInPandas(Sessions(gap_ms), SESSIONS, "Append", "EventTime")


def sessions_of(rows: DataFrame, gap_ms: int, **scan) -> DataFrame:
    """The same sessions of a table, by a union of intervals."""
    from lyrebird.operators.cluster import span_unions

    known = rows.filter("key is not null and start_ts <= end_ts").select("key", "start_ts", "end_ts", F.unix_micros("start_ts").alias("s"), F.unix_micros("end_ts").alias("e"))
    u = span_unions(known, "key", "e", gap_ms * 1000, "s", "e", **scan)
    return u.groupBy("key", "cluster").agg(F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"), F.count("*").alias("n_rows")).drop("cluster")


class StatusMachine(StatefulProcessor):
    """The state row of one item: its newest status, the last error, and one retry more for each error. Items that nothing touches for ``ttl_ms`` are forgotten."""

    def __init__(self, ttl_ms: int | None) -> None:
        self._ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("state", "status string, last_error string, retries int, updated_us long", self._ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        status, error, retries, at = self._state.get() if self._state.exists() else (None, None, 0, None)
        events = pd.concat(list(rows)).sort_values(["updated_at", "status"], kind="stable")
        for new, text, when in zip(events["status"], events["last_error"], events["updated_at"]):
            error = text if isinstance(text, str) else error
            retries += new == "error"
            if at is None or _us(when) >= at:
                status, at = new, _us(when)
        self._state.update((status, error, int(retries), at))
        yield pd.DataFrame({"media_id": [key[0]], "status": [status], "last_error": [error], "retries": [int(retries)], "updated_at": [_time(at)]})

    def close(self) -> None:
        pass


def status_machine(stream: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Current state rows of all items that a batch of (media_id, status, last_error, updated_at) touches; an older event that comes late counts, but changes no newer status."""
    known = stream.filter("media_id is not null and status is not null and updated_at is not null")
    return known.groupBy("media_id").transformWithStateInPandas(StatusMachine(ttl_ms), STATES, "Update", "ProcessingTime" if ttl_ms else "None")


class Gate(StatefulProcessor):
    """Lets at most ``most`` rows of a key through each period of event time; the count of a period is forgotten after the watermark passed it."""

    def __init__(self, most: int, period_ms: int, schema_names: list[str], at: str) -> None:
        self._most, self._period, self._names, self._at = most, period_ms, schema_names, at

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._used = handle.getMapState("used", "period long", "n int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        part = pd.concat(list(rows)).sort_values(self._names, kind="stable").reset_index(drop=True)
        periods = part[self._at].map(_us) // (self._period * 1000)
        keep = []
        for i, p in enumerate(map(int, periods)):
            used = self._used.getValue((p,))[0] if self._used.containsKey((p,)) else 0
            if used < self._most:
                keep.append(i)
                self._used.updateValue((p,), (used + 1,))
                if not used:
                    self._handle.registerTimer((p + 1) * self._period)
        yield part.loc[keep, self._names]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        period = expiredTimerInfo.getExpiryTimeInMs() // self._period - 1
        if self._used.containsKey((period,)):
            self._used.removeKey((period,))
        yield pd.DataFrame({n: [] for n in self._names})

    def close(self) -> None:
        pass


def rate_limited(stream: DataFrame, key: str, at: str, most: int, period_ms: int, delay: str) -> DataFrame:
    """The first ``most`` rows of each key and period, as they come; of one batch, the first by the row's columns in order."""
    known = stream.filter(f"`{key}` is not null and `{at}` is not null").withWatermark(at, delay)
    return known.groupBy(key).transformWithStateInPandas(Gate(most, period_ms, stream.columns, at), stream.schema, "Append", "EventTime")
