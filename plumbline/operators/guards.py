"""Guardrails: policies, risk thresholds, circuit breaking, loops, rate limits, escalation, audit, bias.

Order matters to most of these, so they take ``order``, columns that order a key's rows
without ties.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.frames import free_names, join_null_safe

#: Fixed value: what the reason of an error begins with.
FAILED = "Policy evaluation failed: "
DECISION = "struct<decision:string,reason:string,target:string>"


def approve() -> Column:
    return F.struct(F.lit("approve").alias("decision"), F.lit(None).cast("string").alias("reason"), F.lit(None).cast("string").alias("target"))


def reject(reason: Column | str) -> Column:
    return F.struct(F.lit("reject").alias("decision"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"), F.lit(None).cast("string").alias("target"))


def escalate(target: str) -> Column:
    return F.struct(F.lit("escalate").alias("decision"), F.lit(None).cast("string").alias("reason"), F.lit(target).alias("target"))


def error(message: Column | str) -> Column:
    """A policy that could not be evaluated: neither approval nor rejection, so nothing may go on."""
    told = F.lit(message) if isinstance(message, str) else message
    return F.struct(F.lit("error").alias("decision"), F.concat(F.lit(FAILED), told).alias("reason"), F.lit(None).cast("string").alias("target"))


def policy_chain(*policies: Column) -> Column:
    """The first decision that is not null (a policy is null where it approves); approval if none.

    Rejection, escalation and error all end the chain, so an error is never passed over and a
    rejection before it stands. The row itself always stays.
    """
    return F.coalesce(*policies, approve()) if policies else approve()


def rule_policy(allow: Column | str, reason: str = "denied by policy") -> Column:
    """A boolean rule, denied by default: null unless the rule holds."""
    rule = F.expr(allow) if isinstance(allow, str) else allow
    return F.when(~F.coalesce(rule, F.lit(False)), reject(reason))


def risk_policy(risk: Column, escalate_at: float, reject_at: float, target: str = "role:reviewer", field: str = "risk") -> Column:
    """Reject from ``reject_at``, escalate from ``escalate_at``, else null. A null or NaN risk is an error that names ``field``."""
    # fixed values: both messages
    over = F.format_string(f"Risk score %.3f exceeds reject threshold {reject_at:.3f}", risk)
    unread = error(f"Missing or invalid risk field '{field}' in context")
    return F.when(risk.isNull() | F.isnan(risk.cast("double")), unread).when(risk >= reject_at, reject(over)).when(risk >= escalate_at, escalate(target))


def risk_of(context: Column | str, field: str) -> Column:
    """A number at the top level of a JSON context; null when missing or of another type (a string of digits too)."""
    if '"' in field or "]" in field:
        raise ValueError(f"not a field name: {field}")
    read = lambda kind: F.try_variant_get(F.try_parse_json(context), f'$["{field}"]', kind)
    return F.when(F.schema_of_variant(read("variant")).rlike("^(BIGINT|DOUBLE|DECIMAL)"), read("double"))


def breaker(df: DataFrame, key: str | Sequence[str], ok: Column, ts: str, order: Sequence[str], threshold: int, timeout_s: float) -> DataFrame:
    """``df`` with failures, is_open (after the event) and allowed (before it).

    A breaker opens at ``threshold`` failures in a row (0 acts as 1); a success closes it. An
    open breaker allows every call once ``timeout_s`` have passed since its latest failure. A
    null outcome is a failure, a null key a key; a failure without time never times out. For
    resets give the columns of ``functions.order.epochs`` as key.
    """
    key = [key] if isinstance(key, str) else list(key)
    good, island = free_names([*df.columns, "failures", "is_open", "allowed"], "good", "island")
    ok = F.coalesce(ok, F.lit(False))
    w = Window.partitionBy(*key).orderBy(*order)
    rows = df.withColumns({good: ok, island: F.sum(ok.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    inside = Window.partitionBy(*key, island).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("failures", F.sum((~F.col(good)).cast("int")).over(inside)).withColumn("is_open", F.col("failures") >= max(threshold, 1))
    last = F.max(F.when(~F.col(good), F.unix_micros(F.col(ts).cast("timestamp")))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    was = F.coalesce(F.lag("is_open").over(w), F.lit(False))
    waited = F.unix_micros(F.col(ts).cast("timestamp")) - last >= int(timeout_s * 1_000_000)
    return rows.withColumn("allowed", ~was | F.coalesce(waited, F.lit(False))).drop(good, island)


def loops(df: DataFrame, run: str | Sequence[str], node: str, order: Sequence[str], max_visits: int, max_alternations: int) -> DataFrame:
    """``df`` with visits, violation ('overvisit', 'alternation' or null), observed and allowed_count.

    Overvisit means more than ``max_visits`` and hides an alternation: the last
    2 * max_alternations visits strictly A, B, A, B.
    """
    if max_alternations < 1:
        raise ValueError("max_alternations must be at least 1")
    run = [run] if isinstance(run, str) else list(run)
    w = Window.partitionBy(*run).orderBy(*order)
    visits = F.row_number().over(Window.partitionBy(*run, node).orderBy(*order)).cast("long")
    v = F.col(node)
    swung, step = free_names([*df.columns, "visits", "violation", "observed", "allowed_count"], "swung", "step")
    if max_alternations == 1:
        rows = df.withColumn(swung, ~v.eqNullSafe(F.lag(node).over(w)) & (F.row_number().over(w) > 1))
    else:
        back = v.eqNullSafe(F.lag(node, 2).over(w)) & ~v.eqNullSafe(F.lag(node).over(w)) & (F.row_number().over(w) > 2)
        rows = df.withColumn(step, back.cast("int"))
        rows = rows.withColumn(swung, F.sum(step).over(w.rowsBetween(-(2 * max_alternations - 3), 0)) == 2 * max_alternations - 2).drop(step)
    rows = rows.withColumn("visits", visits)
    over = F.col("visits") > max_visits
    return rows.withColumns({"violation": F.when(over, F.lit("overvisit")).when(F.col(swung), F.lit("alternation")), "observed": F.when(over, F.col("visits")).when(F.col(swung), F.lit(max_alternations).cast("long")), "allowed_count": F.when(over, F.lit(max_visits)).when(F.col(swung), F.lit(max_alternations))}).drop(swung)


def visit_history(df: DataFrame, run: str, node: str, order: Sequence[str], max_alternations: int) -> DataFrame:
    """(run, history, total): the last 4 * max_alternations nodes of each run. A null run is a run; null nodes stay in their places."""
    rows = df.select(F.col(run).alias("run"), F.col(node).alias("node"), F.struct(*order).alias("at"))
    recent = rows.withColumn("n", F.row_number().over(Window.partitionBy("run").orderBy(F.desc("at")))).where(F.col("n") <= 4 * max_alternations)
    lists = recent.groupBy("run").agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("p"), F.col("node").alias("v")))), lambda x: x["v"]).alias("history"))
    return join_null_safe(lists, rows.groupBy("run").agg(F.count("*").alias("total")), ["run"]).withColumnRenamed("run", run)


class Bucket:
    """A token bucket of one key: full at first, refilled over time, a call takes a token."""

    def __init__(self, capacity: int, rate: float):
        if capacity < 1 or rate < 0:
            raise ValueError("capacity of at least 1 and a rate of at least 0 are needed")
        self.capacity, self.rate, self.tokens, self.at = capacity, rate, float(capacity), None

    def check(self, now: float | None, consume: bool = True) -> tuple[bool, int, int]:
        """(allowed, remaining, retry_after_ms). A call without time refills nothing."""
        if now is not None:
            if self.at is not None:
                self.tokens = min(float(self.capacity), self.tokens + max(0.0, now - self.at) * self.rate)
            self.at = now if self.at is None else max(now, self.at)
        if self.tokens >= 1:
            left = self.tokens - 1
            if consume:
                self.tokens = left
            return True, int(left if consume else self.tokens), 0
        return False, 0, math.ceil((1 - self.tokens) / self.rate * 1000) if self.rate else -1


def rate_limit(df: DataFrame, key: str | Sequence[str], ts: str, order: Sequence[str], capacity: int, rate: float, consume: bool | Column = True) -> DataFrame:
    """(key, order columns, allowed, remaining, retry_after_ms) of every call, in each key's order.

    The cap and the rejections make the state non-linear, so a key's calls are folded in
    order: rows are dealt by key, sorted, and streamed; only the current key's two numbers
    are held. Where ``consume`` is false a call only peeks. retry_after_ms is -1 where the rate is 0. Null and NaN are
    keys like others. For resets give the columns of ``functions.order.epochs`` as key.
    """
    Bucket(capacity, rate)
    key = [key] if isinstance(key, str) else list(key)
    names = list(dict.fromkeys([*key, *order]))
    clock, takes = free_names(names, "now", "takes")
    taken = F.coalesce(consume, F.lit(False)) if isinstance(consume, Column) else F.lit(consume)
    rows = df.select(*names, taken.alias(takes), (F.unix_micros(F.col(ts).cast("timestamp")) / 1_000_000).alias(clock)).repartition(*key).sortWithinPartitions(*key, *order)
    schema = rows.drop(clock, takes).schema.add("allowed", "boolean").add("remaining", "long").add("retry_after_ms", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, bucket = object(), None
        for batch in batches:
            out = []
            for *k, now, uses in zip(*(batch.column(c).to_pylist() for c in (*key, clock, takes))):
                k = ["NaN" if x != x else x for x in k]
                if k != current:
                    current, bucket = k, Bucket(capacity, rate)
                out.append(bucket.check(now, uses))
            allowed, remaining, wait = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(allowed, pa.bool_()), pa.array(remaining, pa.int64()), pa.array(wait, pa.int64())], [*names, "allowed", "remaining", "retry_after_ms"])

    return rows.mapInArrow(run, schema)


def escalation_status(log: DataFrame, now: Column, timeout_s: float) -> DataFrame:
    """(id, status, by, reason, created): the latest state of each escalation.

    ``log`` has id, seq, event (created, approved, rejected), by, reason, ts. Later events
    win whatever the state before; a pending one as old as the timeout has timed out, one
    created at an unknown time never does. Events of an id never created are left out. A null
    id is an id. One aggregate, combined map-side.
    """
    new = F.col("event") == "created"
    per = log.groupBy("id").agg(F.min(F.when(new, F.col("ts"))).alias("created"), F.max(new).alias("made"), F.max_by(F.struct("event", "by", "reason"), "seq").alias("e"))
    status = F.when(F.col("e.event") == "created", F.when(F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("created").cast("timestamp")) >= int(timeout_s * 1_000_000), F.lit("timed_out")).otherwise("pending")).otherwise(F.col("e.event"))
    return per.where("made").select("id", status.alias("status"), F.col("e.by").alias("by"), F.col("e.reason").alias("reason"), "created")


def recent_entries(audit: DataFrame, limit: int, order: Sequence[str]) -> DataFrame:
    """The last ``limit`` entries, oldest first: a top-k, not a sort of the trail."""
    return audit.orderBy(*(F.desc(c) for c in order)).limit(limit).orderBy(*order)


def audit_entries(decisions: DataFrame, engine: str, id_col: str, ts: str, action: Column, decision: Column, metadata: Column | None = None) -> DataFrame:
    """(id, timestamp, action, engine, decision, metadata), an entry for each decision."""
    return decisions.select(F.col(id_col).cast("string").alias("id"), F.col(ts).alias("timestamp"), action.alias("action"), F.lit(engine).alias("engine"), decision.alias("decision"), (metadata if metadata is not None else F.lit(None).cast("string")).alias("metadata"))


def new_entries(decisions: DataFrame, engine: str, action: Column, decision: Column, metadata: Column | None = None) -> DataFrame:
    """``audit_entries`` stamped here: a random id and the time at which the query runs."""
    name, now = free_names(decisions.columns, "id", "now")
    stamped = decisions.withColumns({name: F.expr("uuid()"), now: F.current_timestamp()})
    return audit_entries(stamped, engine, name, now, action, decision, metadata)


# bias


def normal_quantile(p: float) -> float:
    """A rational approximation of the standard normal quantile (Abramowitz and Stegun 26.2.23)."""
    if p < 0.5:
        return -normal_quantile(1 - p)
    t = math.sqrt(-2 * math.log(1 - p))
    # fixed values of the published formula
    return t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t**3)


def chi2_critical(df: Column, alpha: float = 0.05) -> Column:
    """The Wilson-Hilferty approximation of the chi-squared quantile, never below 0; 0 for no degrees of freedom."""
    k, z = df.cast("double"), normal_quantile(1 - alpha)
    part = F.try_divide(F.lit(2.0), 9 * k)
    return F.when(k > 0, F.greatest(k * F.pow(1 - part + z * F.sqrt(part), F.lit(3)), F.lit(0.0))).otherwise(0.0)


def _chi2(cells: DataFrame, keys: Sequence[str], alpha: float) -> DataFrame:
    """Cells (observed, expected) -> (keys, chi2, df, critical, biased)."""
    e = F.greatest("expected", F.lit(1e-10))
    term = (F.col("observed") - e) * (F.col("observed") - e) / e
    chi_, d_ = free_names(keys, "chi", "d")
    aggs = [F.sum(term).alias(chi_), (F.count("*") - 1).alias(d_)]
    got = cells.groupBy(*keys).agg(*aggs) if keys else cells.agg(*aggs)
    d = F.greatest(d_, F.lit(0))
    chi = F.when(d > 0, F.col(chi_)).otherwise(0.0)
    return got.select(*keys, chi.alias("chi2"), d.cast("long").alias("df"), chi2_critical(d, alpha).alias("critical"), ((d > 0) & (chi > chi2_critical(d, alpha))).alias("biased"))


def bias_uniformity(counts: DataFrame, count: str, keys: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """Whether counts (a row a category) differ from equal ones; a null or NaN key is a key."""
    cells = counts.select(*keys, F.col(count).cast("double").alias("observed"))
    if not keys:
        return _chi2(cells.crossJoin(F.broadcast(cells.agg(F.avg("observed").alias("expected")))), keys, alpha)
    return _chi2(join_null_safe(cells, cells.groupBy(*keys).agg(F.avg("observed").alias("expected")), keys), keys, alpha)


def bias_distribution(observed: DataFrame, expected: DataFrame, category: str, alpha: float = 0.05) -> DataFrame:
    """(category, observed) against (category, expected); a category without expectation has 1.0, one only expected is ignored. Null is a category."""
    cells = join_null_safe(observed.select(category, "observed"), expected.select(category, "expected"), [category], "left")
    return _chi2(cells.withColumn("expected", F.coalesce("expected", F.lit(1.0))), (), alpha)


def bias_approval(decisions: DataFrame, group: str, approved: Column, alpha: float = 0.05) -> DataFrame:
    """Whether approvals per group differ from the group's size times the overall rate (approval cells only)."""
    sizes = decisions.select(F.col(group).alias("g"), F.coalesce(approved, F.lit(False)).alias("ok")).groupBy("g").agg(F.count("*").alias("n"), F.count(F.when(F.col("ok"), 1)).cast("double").alias("observed"))
    whole = sizes.agg(F.try_divide(F.sum("observed"), F.sum("n")).alias("rate"))
    return _chi2(sizes.crossJoin(F.broadcast(whole)).withColumn("expected", F.col("n") * F.col("rate")), (), alpha)
