"""Structured Streaming forms of the operators whose input arrives over time."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from plumbline.operators import beliefs
from plumbline.operators.guards import Bucket
from plumbline.operators.routing import DOMAINS, count_columns, domain_shares, drift_columns


def beta_stream(events: DataFrame, success: Column, keys: list[str], alpha: float = 1.0, beta: float = 1.0) -> DataFrame:
    """Running Beta posteriors; write in update or complete mode. Equal to the batch form over the same events."""
    return beliefs.beta_posterior(events, success.cast("int"), (~success).cast("int"), keys, alpha, beta)


def normal_stream(events: DataFrame, value: str, keys: list[str], mu: float = 0.0, prior_variance: float = 1.0, obs_variance: float = 1.0) -> DataFrame:
    """Running Normal posteriors; update or complete mode."""
    return beliefs.normal_posterior(events, value, keys, mu, prior_variance, obs_variance)


def gamma_stream(events: DataFrame, count: str, keys: list[str], alpha: float = 1.0, beta: float = 1.0) -> DataFrame:
    """Running Gamma posteriors, each event a period with a count; update or complete mode."""
    return beliefs.gamma_posterior(events, count, keys, alpha, beta)


def dirichlet_stream(events: DataFrame, category: str, keys: list[str], categories: list[str], prior: list[float] | None = None) -> DataFrame:
    """Running Dirichlet posteriors; update or complete mode."""
    return beliefs.dirichlet_posterior(events, category, keys, categories, prior)


def track_stream(observations: DataFrame, kind: str, **prior) -> DataFrame:
    """``beliefs.track`` over a stream of observations, mismatches counted apart; update or complete mode."""
    return beliefs.track(observations, kind, **prior)


def domain_counts(events: DataFrame, ts: str, domain: str, window: str, late: str) -> DataFrame:
    """(window start, domain, n) for drift checks; events later than ``late`` behind the newest are dropped."""
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return timed.groupBy(F.window("_ts", window).alias("w"), F.col(domain).alias("domain")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("starts"), "domain", "n")


def drift_stream(events: DataFrame, ts: str, domain: str, reference: DataFrame, window: str, late: str, threshold: float, domains: Sequence[str] = tuple(DOMAINS)) -> DataFrame:
    """(starts, kl, drifted, n): ``routing.drift`` of each window against a static ``reference`` (domain, n), in append mode.

    One state row a window holds its counts; it becomes a drift row when the watermark passes
    the window's end, so late rows within ``late`` still count and later ones do not. Other
    domains and rows without time do not count; a window without rows has no row.
    """
    timed = events.select(F.col(ts).cast("timestamp").alias("ts"), F.col(domain).alias("domain")).withWatermark("ts", late)
    counts = timed.groupBy(F.window("ts", window).alias("w")).agg(*count_columns("c", F.lit(1), domains))
    both = counts.crossJoin(F.broadcast(domain_shares(reference, "r", (), domains)))  # one row
    return both.select(F.col("w.start").alias("starts"), *drift_columns(len(domains), threshold))


def rate_limit_stream(events: DataFrame, key: str, ts: str, event_id: str, capacity: int, rate: float, late: str | None = None) -> DataFrame:
    """(key, event_id, allowed): token buckets kept as keyed state across micro-batches.

    Within a micro-batch a key's events are taken by (time, id), so a key's share of one must
    fit in a task; an event older than the bucket's clock refills nothing, one without time is
    left out. With ``late`` events that far behind the newest are dropped, and a bucket that the
    watermark shows to be full again, which needs no state, is too. Without it, or at rate 0,
    every key's two numbers are kept.
    """
    Bucket(capacity, rate)
    ends = bool(late and rate)

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        bucket = Bucket(capacity, rate)
        if state.exists:
            bucket.tokens, bucket.at = state.get
        rows = pd.concat(list(frames)).sort_values(["_now", event_id])
        allowed = [bucket.check(now)[0] for now in rows["_now"]]
        state.update((bucket.tokens, bucket.at))
        if ends:
            full = int((bucket.at + (capacity - bucket.tokens) / rate) * 1000) + 1
            state.setTimeoutTimestamp(max(full, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: rows[key], event_id: rows[event_id], "allowed": allowed})

    timed = events.withColumn("_ts", F.col(ts).cast("timestamp")).where("_ts is not null")
    if late:
        timed = timed.withWatermark("_ts", late)
    timed = timed.select(key, event_id, "_ts", (F.unix_micros("_ts") / 1_000_000).alias("_now"))
    kinds = {f.name: f.dataType.simpleString() for f in timed.schema}
    timeout = GroupStateTimeout.EventTimeTimeout if ends else GroupStateTimeout.NoTimeout
    return timed.groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, {event_id} {kinds[event_id]}, allowed boolean", "tokens double, at double", "append", timeout)
