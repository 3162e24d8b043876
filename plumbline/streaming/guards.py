"""Guardrails on streams, as keyed state that outlives a micro-batch.

A key's rows are taken in (time, id) order within a micro-batch and in the order of
micro-batches between them. So a stream equals the batch form over the same rows if these
arrive in order; a row that comes in a later micro-batch than younger rows counts when it
comes. A key's rows of one micro-batch must fit in a task. The state store must be RocksDB
(``use_rocksdb``); rows without a key share one, rows without time or id come first.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Choose the state store that these operators need, for queries that are started from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _in_order(rows: Iterator[Row]) -> list[Row]:
    return sorted(rows, key=lambda r: ((r.at is not None, r.at), (r.id is not None, r.id)))


def _fields(df: DataFrame, *names: str) -> str:
    return ", ".join(f"{n} {df.schema[n].dataType.simpleString()}" for n in names)


class _Breaker(StatefulProcessor):
    """Failures in a row, and when the last one was."""

    def __init__(self, threshold: int, timeout_us: int, forget_ms: int | None):
        self.threshold, self.timeout_us, self.forget_ms = threshold, timeout_us, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("breaker", "failures long, last long", self.forget_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        failures, last = self.state.get() if self.state.exists() else (0, None)
        for r in _in_order(rows):
            waited = last is not None and r.at is not None and r.at - last >= self.timeout_us
            allowed = failures < self.threshold or waited
            if r.ok:
                failures = 0
            else:
                failures += 1
                last = r.at if last is None or r.at is not None and r.at > last else last
            yield Row(key=key[0], id=r.id, failures=failures, is_open=failures >= self.threshold, allowed=allowed)
        self.state.update((failures, last))

    def close(self) -> None:
        pass


def breaker_stream(events: DataFrame, key: str, event_id: str, ok: Column, ts: str, threshold: int, timeout_s: float, forget_s: float | None = None) -> DataFrame:
    """(key, id, failures, is_open, allowed) of each event: ``guards.breaker`` on a stream, in append mode.

    Two numbers a key are kept. With ``forget_s`` the state of a key that has had no event for
    so long (of the clock, not of the events) goes, and its breaker is closed as if new.
    """
    rows = events.select(F.col(key).alias("key"), F.col(event_id).alias("id"), F.coalesce(ok, F.lit(False)).alias("ok"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"))
    processor = _Breaker(max(threshold, 1), int(timeout_s * 1_000_000), None if forget_s is None else int(forget_s * 1000))
    return rows.groupBy("key").transformWithState(processor, f"{_fields(rows, 'key', 'id')}, failures long, is_open boolean, allowed boolean", "append", "none" if forget_s is None else "processingTime")


class _Loops(StatefulProcessor):
    """How often each node was visited, and the last 2 * max_alternations nodes."""

    def __init__(self, max_visits: int, max_alternations: int, node_type: str):
        self.max_visits, self.swings, self.node_type = max_visits, max_alternations, node_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        # a null node cannot be a key of a map: the flag tells it from a node
        self.visits = handle.getMapState("visits", f"known boolean, node {self.node_type}", "n long")
        self.recent = handle.getListState("recent", f"node {self.node_type}")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        window = [r[0] for r in self.recent.get()] if self.recent.exists() else []
        counts: dict = {}
        for r in _in_order(rows):
            at = (r.node is not None, r.node)
            if at not in counts:
                counts[at] = self.visits.getValue(at)[0] if self.visits.containsKey(at) else 0
            counts[at] += 1
            window = [*window, r.node][-2 * self.swings :]
            over = counts[at] > self.max_visits
            a, b = window[0], window[1] if len(window) > 1 else window[0]
            swung = len(window) == 2 * self.swings and a != b and all(x == (b if i % 2 else a) for i, x in enumerate(window))
            yield Row(key=key[0], id=r.id, visits=counts[at], violation="overvisit" if over else "alternation" if swung else None, observed=counts[at] if over else self.swings if swung else None, allowed_count=self.max_visits if over else self.swings if swung else None)
        for at, n in counts.items():
            self.visits.updateValue(at, (n,))
        self.recent.put([(x,) for x in window])

    def close(self) -> None:
        pass


def loops_stream(events: DataFrame, run: str, event_id: str, node: str, ts: str, max_visits: int, max_alternations: int) -> DataFrame:
    """(key, id, visits, violation, observed, allowed_count) of each visit: ``guards.loops`` on a stream, in append mode.

    A run keeps a count for each node and a list of 2 * max_alternations nodes, nothing that
    grows with its visits. A null node is a node.
    """
    if max_alternations < 1:
        raise ValueError("max_alternations must be at least 1")
    rows = events.select(F.col(run).alias("key"), F.col(event_id).alias("id"), F.col(node).alias("node"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"))
    processor = _Loops(max_visits, max_alternations, rows.schema["node"].dataType.simpleString())
    return rows.groupBy("key").transformWithState(processor, f"{_fields(rows, 'key', 'id')}, visits long, violation string, observed long, allowed_count int", "append", "none")


class _Escalation(StatefulProcessor):
    """The latest event of a case, when it was created, and a timer for its end."""

    def __init__(self, timeout_ms: int, keep_ms: int | None):
        self.timeout_ms, self.keep_ms = timeout_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.case = handle.getValueState("case", "created long, seq long, event string, by string, reason string, late boolean")

    def _row(self, key: tuple, status: str, by: str | None, reason: str | None, created: int) -> Row:
        return Row(id=key[0], status=status, by=by, reason=reason, created=created)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        created, seq, event, by, reason, late = self.case.get() if self.case.exists() else (None, None, None, None, None, False)
        before, told = created, (event, by, reason) if created is not None else None
        if created is not None and event == "created" and not late and self._ends(created) <= timerValues.getCurrentWatermarkInMs():
            late = True  # its time was over before these rows came
            yield self._row(key, "timed_out", by, reason, created)
        for r in rows:
            if r.event == "created":
                created = r.at if created is None else min(created, r.at)
            if seq is None or r.seq is not None and r.seq >= seq:
                seq, event, by, reason = r.seq, r.event, r.by, r.reason
        if created is not None:
            if before != created:
                if before is not None:
                    self.handle.deleteTimer(self._ends(before))
                self.handle.registerTimer(self._ends(created))
            if (event, by, reason) != told:
                late = late and event == "created"
                yield self._row(key, "timed_out" if late else "pending" if event == "created" else event, by, reason, created)
        self.case.update((created, seq, event, by, reason, late))

    def _ends(self, created: int) -> int:
        return -(-created // 1000) + self.timeout_ms  # up to whole milliseconds: never early

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        created, seq, event, by, reason, late = self.case.get()
        if expiredTimerInfo.getExpiryTimeInMs() >= self._ends(created) + 1 and self.keep_ms is not None:
            self.case.clear()
            return
        if self.keep_ms is not None:
            self.handle.registerTimer(self._ends(created) + self.keep_ms + 1)
        if event == "created" and not late:
            self.case.update((created, seq, event, by, reason, True))
            yield self._row(key, "timed_out", by, reason, created)

    def close(self) -> None:
        pass


def escalation_stream(log: DataFrame, timeout_s: float, late: str, keep_s: float | None = None) -> DataFrame:
    """(id, status, by, reason, created) whenever a case changes: ``guards.escalation_status`` on a stream, in update mode.

    ``log`` has id, seq, event (created, approved, rejected), by, reason, ts; rows later than
    ``late`` behind the newest are dropped, as are rows without id, event or time. A case still
    pending when the watermark passes its creation by ``timeout_s`` is told as timed_out once,
    without any row of its own. Later events win whatever the state before. An id never created
    tells nothing. A case's six values are kept; with ``keep_s`` only so long after its
    timeout, after which further events of the id tell nothing.
    """
    timed = log.where("id is not null and event is not null and ts is not null").select("id", "seq", "event", "by", "reason", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    rows = timed.withColumn("at", F.unix_micros("ts"))
    processor = _Escalation(int(timeout_s * 1000), None if keep_s is None else int(keep_s * 1000))
    told = rows.groupBy("id").transformWithState(processor, f"{_fields(rows, 'id')}, status string, by string, reason string, created long", "update", "eventTime")
    return told.withColumn("created", F.timestamp_micros("created"))
