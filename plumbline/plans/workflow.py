"""Workflow graphs: one state through Python steps, or a table of states through column updates."""

from __future__ import annotations

import concurrent.futures
import functools
import json
import logging
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone
from typing import Any, Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.scratch import commit_text, list_names, materialize, release, remove

#: Steps of a table of states between two writes of it.
STEPS_A_WRITE = 20


class WorkflowError(Exception):
    """Base of the workflow errors."""


class NoEntry(WorkflowError):
    pass


class UnknownNode(WorkflowError):
    pass


class CycleFound(WorkflowError):
    def __init__(self, path: list[str]):
        super().__init__(" -> ".join(path))
        self.path = path


class NodeFailed(WorkflowError):
    pass


class NodeTimedOut(WorkflowError):
    pass


class TooManySteps(WorkflowError):
    pass


class ApprovalNeeded(Exception):
    """Raised by a node that waits for a human."""


@dataclass
class Checkpoint:
    state: Any
    next_node: str
    steps_completed: int
    reason: str | None = None
    created_at: str = field(default_factory=lambda: datetime.now(timezone.utc).isoformat())

    def to_json(self) -> str:
        return json.dumps(self.__dict__)

    @classmethod
    def from_json(cls, text: str) -> Checkpoint:
        return cls(**json.loads(text))


class EventCollector:
    """A hook that keeps events in their order."""

    def __init__(self):
        self.events: list[dict] = []

    def __call__(self, event: dict) -> None:
        self.events.append(event)

    def frame(self, spark: SparkSession) -> DataFrame:
        """(ord, event, node, step, target, error), a row an event."""
        rows = [(i, e["event"], e.get("node"), e.get("step", e.get("steps")), e.get("target"), e.get("error")) for i, e in enumerate(self.events)]
        return spark.createDataFrame(rows, "ord int, event string, node string, step int, target string, error string")


class TracingHook:
    """A hook that writes events to a logger: failures as warnings, the rest as debug messages."""

    def __init__(self, logger: logging.Logger | None = None):
        self.logger = logger or logging.getLogger("plumbline.workflow")

    def __call__(self, event: dict) -> None:
        level = logging.WARNING if event["event"] == "node_failed" else logging.DEBUG
        self.logger.log(level, "%s %s", event["event"], {k: v for k, v in event.items() if k != "event"})


class AnalyticalEngine(Protocol):
    """What answers the requests of one domain: a table in, a table out."""

    domain: str

    def analyze(self, requests: DataFrame) -> DataFrame: ...


def dispatch(requests: DataFrame, engines: Sequence[AnalyticalEngine], domain: str = "domain") -> DataFrame:
    """Each domain's requests through its engine, in one table; requests without an engine are left out."""
    parts = [e.analyze(requests.where(F.col(domain) == e.domain)) for e in engines]
    if not parts:
        raise ValueError("no engine")
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


class Workflow:
    """Nodes are functions state -> state; an edge chosen by the state goes before a fixed edge."""

    def __init__(self):
        self.nodes: dict[str, Callable] = {}
        self.edges: dict[str, list[str]] = {}
        self.choices: dict[str, Callable] = {}
        self.entry: str | None = None
        self.hooks: list[Callable[[dict], None]] = []

    def add_node(self, name: str, step: Callable) -> Workflow:
        self.nodes[name] = step
        return self

    def set_entry(self, name: str) -> Workflow:
        self.entry = name
        return self

    def add_edge(self, a: str, b: str) -> Workflow:
        self.edges.setdefault(a, []).append(b)
        return self

    def add_conditional_edge(self, a: str, choose: Callable) -> Workflow:
        self.choices[a] = choose
        return self

    def add_hook(self, hook: Callable[[dict], None]) -> Workflow:
        self.hooks.append(hook)
        return self

    def _tell(self, event: str, **what) -> None:
        for hook in self.hooks:
            hook({"event": event, **what})

    def find_cycle(self) -> list[str] | None:
        """A closed path along fixed edges, or None."""
        colour: dict[str, int] = {}
        for start in self.nodes:
            if colour.get(start):
                continue
            path, stack = [start], [iter(self.edges.get(start, []))]
            colour[start] = 1
            while stack:
                nxt = next(stack[-1], None)
                if nxt is None:
                    colour[path.pop()] = 2
                    stack.pop()
                elif colour.get(nxt) == 1:
                    return [*path[path.index(nxt) :], nxt]
                elif not colour.get(nxt):
                    colour[nxt] = 1
                    path.append(nxt)
                    stack.append(iter(self.edges.get(nxt, [])))
        return None

    def validate(self) -> None:
        """Entry set and known, ends of fixed edges known, no cycle of fixed edges."""
        if self.entry is None:
            raise NoEntry("no entry node")
        for name in [self.entry, *(x for a, bs in self.edges.items() for x in (a, *bs))]:
            if name not in self.nodes:
                raise UnknownNode(name)
        if cycle := self.find_cycle():
            raise CycleFound(cycle)

    def _next(self, name: str, state: Any) -> str | None:
        if name in self.choices:
            target = self.choices[name](state)
            self._tell("route_decision", node=name, target=target)
            return target
        return next(iter(self.edges.get(name, [])), None)

    def _run(self, state: Any, at: str, done: int, max_steps: int, timeout_s: float | None) -> Any:
        for step in range(done, max_steps):
            if at not in self.nodes:
                raise UnknownNode(at)
            self._tell("node_started", node=at, step=step)
            try:
                state = self.nodes[at](state) if timeout_s is None else _within(self.nodes[at], state, timeout_s)
            except concurrent.futures.TimeoutError as e:
                self._tell("node_failed", node=at, step=step, error="timed out")
                raise NodeTimedOut(f"{at}: over {timeout_s} s") from e
            except Exception as e:
                self._tell("node_failed", node=at, step=step, error=str(e))
                raise NodeFailed(f"{at}: {e}") from e
            self._tell("node_completed", node=at, step=step)
            target = self._next(at, state)
            if target is None:
                self._tell("execution_completed", steps=step + 1)
                return state
            at = target
        raise TooManySteps(f"{max_steps} steps")

    def execute(self, state: Any, max_steps: int) -> Any:
        self.validate()
        return self._run(state, self.entry, 0, max_steps, None)

    def execute_with_timeout(self, state: Any, max_steps: int, timeout_s: float) -> Any:
        self.validate()
        return self._run(state, self.entry, 0, max_steps, timeout_s)

    def resume(self, checkpoint: Checkpoint, max_steps: int) -> Any:
        """Goes on from a checkpoint; steps done before count towards ``max_steps``."""
        return self._run(checkpoint.state, checkpoint.next_node, checkpoint.steps_completed, max_steps, None)


def _within(node: Callable[[Any], Any], state: Any, timeout_s: float) -> Any:
    """The node's result, or TimeoutError after ``timeout_s``; the Spark jobs that it has started are cancelled then.

    The node runs in a thread of its own under a tag of its own. Python code that starts no
    Spark job cannot be stopped and ends by itself.
    """
    spark, tag = SparkSession.getActiveSession(), f"node-{uuid.uuid4().hex}"

    def tagged() -> Any:
        if spark is not None:
            spark.addTag(tag)
        return node(state)

    pool = concurrent.futures.ThreadPoolExecutor(1)
    try:
        return pool.submit(tagged).result(timeout_s)
    except concurrent.futures.TimeoutError:
        if spark is not None:
            spark.interruptTag(tag)
        raise
    finally:
        pool.shutdown(wait=False, cancel_futures=True)


@dataclass
class TableNode:
    """A step over a table of states: column updates, then the next node's name (null: the end)."""

    updates: dict[str, Column]
    target: Column


def _saved_step(folder: str, spark: SparkSession) -> int | None:
    """The last step whose manifest was committed in ``folder``."""
    steps = [int(name) for name in list_names(spark, f"{folder}/manifest") if name.isdigit()]
    return max(steps, default=None)


def _save_step(folder: str, step: int, out: DataFrame) -> DataFrame:
    """Write the states after ``step``, then commit the step, then drop the states before."""
    spark, before = out.sparkSession, _saved_step(folder, out.sparkSession)
    out.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/states/{step}")
    commit_text(spark, f"{folder}/manifest/{step}", json.dumps({"step": step}))
    if before is not None and before != step:
        remove(spark, f"{folder}/manifest/{before}")
        remove(spark, f"{folder}/states/{before}")
    return spark.read.schema(out.schema).parquet(f"{folder}/states/{step}")


def run_table(states: DataFrame, nodes: dict[str, TableNode], max_steps: int, folder: str | None = None) -> DataFrame:
    """``states`` (current_node and data columns) with final_node, steps and error.

    All rows take their steps together in one projection a step, without shuffle; a row that
    is done stays as it is. Every STEPS_A_WRITE steps the states are written, so that plans stay
    small, and once all are done no further step is made. Unfinished rows get the error max_steps_exceeded, rows that meet
    an unknown node node_not_found.

    With ``folder`` (shared, of this run alone) the states are written there instead, and a
    manifest is committed after them. A run that finds one goes on from its step, which
    counts towards ``max_steps``, and does not look at ``states`` again; a crash costs the steps
    since the last manifest. The folder is the caller's to remove once the result is written.
    """
    spark, done = states.sparkSession, None
    if folder is not None and (done := _saved_step(folder, spark)) is not None:
        out = spark.read.parquet(f"{folder}/states/{done}")
    data = sorted({c for n in nodes.values() for c in n.updates})
    if done is None:
        out = states.withColumns({"final_node": F.lit(None).cast("string"), "steps": F.lit(0).cast("long"), "error": F.lit(None).cast("string")})
    before = None
    for step in range(done or 0, max_steps):
        if step and step % STEPS_A_WRITE == 0 and step != done:
            out = materialize(out) if folder is None else _save_step(folder, step, out)
            if before is not None:
                release(before)
            before = out
            if out.where("current_node is not null and error is null").isEmpty():
                break
        live = F.col("current_node").isNotNull() & F.col("error").isNull()
        known = F.col("current_node").isin(list(nodes))
        changed = {}
        for c in data:
            new = F.col(c)
            for name, node in nodes.items():
                if c in node.updates:
                    new = F.when(live & (F.col("current_node") == name), node.updates[c]).otherwise(new)
            changed[c] = new
        out = out.withColumns(changed | {"final_node": F.when(live & known, F.col("current_node")).otherwise(F.col("final_node")), "steps": F.col("steps") + (live & known).cast("long"), "error": F.when(live & ~known, F.lit("node_not_found")).otherwise(F.col("error"))})
        target = F.lit(None).cast("string")
        for name, node in nodes.items():
            target = F.when(F.col("current_node") == name, node.target).otherwise(target)
        out = out.withColumn("current_node", F.when(F.col("error").isNull(), target).otherwise(F.col("current_node")))
    return out.withColumn("error", F.when(F.col("error").isNull() & F.col("current_node").isNotNull(), F.lit("max_steps_exceeded")).otherwise(F.col("error"))).drop("current_node")
