"""Conjugate beliefs: prior plus sums of observations, per entity, in one aggregate.

Updates commute, so the batch form is a grouped sum and the streaming form the same sum in
update mode. Parameters must be finite and positive, else ValueError.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.frames import free_names
from plumbline.scratch import materialize

Z = 1.96


def _positive(**values: float) -> None:
    for name, v in values.items():
        if not (math.isfinite(v) and v > 0):
            raise ValueError(f"{name} must be positive and finite, not {v}")


def beta_summary(alpha: Column, beta: Column) -> dict[str, Column]:
    """mean, variance, mode and the normal-approximation interval within [0, 1]."""
    total = alpha + beta
    mean = alpha / total
    var = alpha * beta / (total * total * (total + 1))
    mode = F.when((alpha > 1) & (beta > 1), F.try_divide(alpha - 1, total - 2)).otherwise(mean)
    return {"mean": mean, "variance": var, "mode": mode, "lower": F.greatest(mean - Z * F.sqrt(var), F.lit(0.0)), "upper": F.least(mean + Z * F.sqrt(var), F.lit(1.0))}


def beta_posterior(df: DataFrame, successes: Column | str, failures: Column | str, keys: Sequence[str], alpha: float = 1.0, beta: float = 1.0) -> DataFrame:
    """(keys, alpha, beta, mean, variance, mode, lower, upper) from counts of successes and failures."""
    _positive(alpha=alpha, beta=beta)
    sums = df.groupBy(*keys).agg((F.sum(successes) + alpha).cast("double").alias("alpha"), (F.sum(failures) + beta).cast("double").alias("beta"))
    return sums.withColumns(beta_summary(F.col("alpha"), F.col("beta")))


def normal_posterior(df: DataFrame, value: str, keys: Sequence[str], mu: float = 0.0, prior_variance: float = 1.0, obs_variance: float = 1.0) -> DataFrame:
    """(keys, mean, variance, lower, upper): precision-weighted; null values are no observations."""
    _positive(prior_variance=prior_variance, obs_variance=obs_variance)
    agg = df.groupBy(*keys).agg(F.count(value).alias("_n"), F.coalesce(F.sum(value), F.lit(0.0)).alias("_s"))
    precision = F.lit(1 / prior_variance) + F.col("_n") / obs_variance
    mean = (mu / prior_variance + F.col("_s") / obs_variance) / precision
    return agg.select(*keys, mean.alias("mean"), (1 / precision).alias("variance"), (mean - Z * F.sqrt(1 / precision)).alias("lower"), (mean + Z * F.sqrt(1 / precision)).alias("upper"))


def gamma_posterior(df: DataFrame, count: str, keys: Sequence[str], alpha: float = 1.0, beta: float = 1.0) -> DataFrame:
    """(keys, alpha, beta, mean, variance): each row one period with a count."""
    _positive(alpha=alpha, beta=beta)
    a, b = (F.coalesce(F.sum(count), F.lit(0)) + alpha).cast("double"), (F.count(count) + beta).cast("double")
    return df.groupBy(*keys).agg(a.alias("alpha"), b.alias("beta")).withColumns({"mean": F.col("alpha") / F.col("beta"), "variance": F.col("alpha") / (F.col("beta") * F.col("beta"))})


def dirichlet_posterior(df: DataFrame, category: str, keys: Sequence[str], categories: Sequence[str], prior: Sequence[float] | None = None) -> DataFrame:
    """(keys, category, alpha, mean, mode, variance), a row for each category of each entity.

    Observations outside ``categories`` are ignored. The mode is the mean unless all
    parameters exceed 1.
    """
    prior = [1.0] * len(categories) if prior is None else list(prior)
    if not categories or len(prior) != len(categories):
        raise ValueError("one prior value for each category, and at least one category")
    for v in prior:
        _positive(alpha=v)
    sums = df.groupBy(*keys).agg(*(F.count(F.when(F.col(category) == c, 1)).alias(f"_c{i}") for i, c in enumerate(categories)))
    rows = F.array(*(F.struct(F.lit(c).alias("category"), (F.col(f"_c{i}") + prior[i]).cast("double").alias("alpha")) for i, c in enumerate(categories)))
    total = F.aggregate("_r", F.lit(0.0), lambda s, r: s + r["alpha"])
    tall = sums.select(*keys, rows.alias("_r")).select(*keys, total.alias("_s"), F.forall("_r", lambda r: r["alpha"] > 1).alias("_all"), F.explode("_r").alias("_x")).select(*keys, "_s", "_all", "_x.*")
    a, s, k = F.col("alpha"), F.col("_s"), len(categories)
    return tall.select(*keys, "category", "alpha", (a / s).alias("mean"), F.when(F.col("_all"), F.try_divide(a - 1, s - k)).otherwise(a / s).alias("mode"), (a * (s - a) / (s * s * (s + 1))).alias("variance"))


#: Columns of an observation table; ``kind`` says which apply.
OBSERVATION = "entity string, seq long, kind string, successes long, failures long, value double, count long, periods long, counts array<long>"


def track(obs: DataFrame, kind: str, p1: float = 1.0, p2: float = 1.0, obs_variance: float = 1.0, prior: Sequence[float] | None = None) -> DataFrame:
    """(entity, kind, p1, p2, mean, variance, lower, upper, observation_count, mismatches, alphas).

    One belief kind for all entities: binary, continuous, count or categorical. Observations of
    another kind are mismatches: counted apart and without effect. A count observation of several
    periods adds count * periods over that many periods. A categorical belief starts from ``prior``,
    a parameter a category, and ``alphas`` has the parameters; the other figures are those of the
    first category, p2 the sum of the rest. An observation with another number of counts, or null
    ones, is counted but changes nothing. ``obs`` may be a stream.
    """
    mine = F.col("kind") == kind
    n = F.count(F.when(mine, 1)).alias("observation_count")
    other = F.count(F.when(~mine, 1)).alias("mismatches")
    add = lambda c: F.coalesce(F.sum(F.when(mine, c)), F.lit(0)).cast("double")
    alphas = F.lit(None).cast("array<double>")
    if kind == "continuous":
        _positive(p2=p2, obs_variance=obs_variance)
        got = obs.groupBy("entity").agg(add(F.col("value")).alias("_s"), n, other)
        precision = F.lit(1 / p2) + F.col("observation_count") / obs_variance
        got = got.withColumns({"p2": 1 / precision, "p1": (p1 / p2 + F.col("_s") / obs_variance) / precision}).drop("_s")
        look = {"mean": F.col("p1"), "variance": F.col("p2"), "lower": F.col("p1") - Z * F.sqrt("p2"), "upper": F.col("p1") + Z * F.sqrt("p2")}
    elif kind == "binary":
        _positive(p1=p1, p2=p2)
        got = obs.groupBy("entity").agg((add(F.col("successes")) + p1).alias("p1"), (add(F.col("failures")) + p2).alias("p2"), n, other)
        look = {k: v for k, v in beta_summary(F.col("p1"), F.col("p2")).items() if k != "mode"}
    elif kind == "count":
        _positive(p1=p1, p2=p2)
        got = obs.groupBy("entity").agg((add(F.col("count") * F.col("periods")) + p1).alias("p1"), (add(F.col("periods")) + p2).alias("p2"), n, other)
        mean, var = F.col("p1") / F.col("p2"), F.col("p1") / (F.col("p2") * F.col("p2"))
        look = {"mean": mean, "variance": var, "lower": mean - Z * F.sqrt(var), "upper": mean + Z * F.sqrt(var)}
    elif kind == "categorical":
        if not prior or len(prior) < 2:
            raise ValueError("a prior of at least two categories is needed")
        _positive(**{f"alpha{i}": a for i, a in enumerate(prior)})
        fits = F.coalesce((F.size("counts") == len(prior)) & F.forall("counts", lambda c: c.isNotNull()), F.lit(False))
        got = obs.groupBy("entity").agg(*((add(F.when(fits, F.get("counts", F.lit(i)))) + float(a)).alias(f"_a{i}") for i, a in enumerate(prior)), n, other)
        alphas = F.array(*(f"_a{i}" for i in range(len(prior))))
        rest = F.aggregate(F.slice(alphas, 2, len(prior) - 1), F.lit(0.0), lambda x, y: x + y)
        got = got.withColumns({"p1": F.col("_a0"), "p2": rest})
        look = {k: v for k, v in beta_summary(F.col("p1"), F.col("p2")).items() if k != "mode"}
    else:
        raise ValueError(f"unknown kind {kind}")
    return got.withColumns(look).select("entity", F.lit(kind).alias("kind"), "p1", "p2", "mean", "variance", "lower", "upper", "observation_count", "mismatches", alphas.alias("alphas"))


def before_first_mismatch(obs: DataFrame, kind: str) -> DataFrame:
    """The observations of each entity that a batch applies: those before its first of another kind."""
    bad = F.sum((F.col("kind") != kind).cast("int")).over(Window.partitionBy("entity").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    (name,) = free_names(obs.columns, "bad")
    return obs.withColumn(name, bad).where(F.col(name) == 0).drop(name)


def running_beta(df: DataFrame, success: Column, key: str, order: Sequence[str], threshold: float, alpha: float = 1.0, beta: float = 1.0) -> DataFrame:
    """``df`` with running_mean, running_variance and confident (variance under the threshold) after each event."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    a, b = F.sum(success.cast("int")).over(w) + alpha, F.sum((~success).cast("int")).over(w) + beta
    first, second = free_names([*df.columns, "running_mean", "running_variance", "confident"], "a", "b")
    look = beta_summary(F.col(first), F.col(second))
    return df.withColumns({first: a, second: b}).withColumns({"running_mean": look["mean"], "running_variance": look["variance"], "confident": look["variance"] < threshold}).drop(first, second)


def tool_reliability(calls: DataFrame, tool: str, ok: Column, order: Sequence[str], min_reliability: float, alpha: float = 1.0, beta: float = 1.0, registry: DataFrame | None = None) -> DataFrame:
    """(tool, reliability, lower, upper, total_calls, recent_failures, is_reliable, should_break, failure_rate, frequency).

    recent_failures counts failures since the last success. should_break looks at the
    interval's lower end. failure_rate is (beta - 1) / calls, right for a uniform prior
    only; ``frequency`` is the plain share of failures. A null tool is a tool; a call whose
    outcome is null counts as a failure. With a ``registry`` (tool) calls of other tools are
    left out, and registered ones without calls have the prior.
    """
    _positive(alpha=alpha, beta=beta)
    rows = calls.select(F.col(tool).alias("tool"), F.coalesce(ok, F.lit(False)).alias("_ok"), F.struct(*order).alias("_at"))
    if registry is not None:
        known = registry.select(F.col("tool").alias("_tool")).distinct()
        rows = rows.join(known, F.col("tool").eqNullSafe(F.col("_tool")), "left_semi")
    # written before it is joined, so that a hot tool's calls can be split over tasks
    last = materialize(rows.where("_ok").groupBy("tool").agg(F.max("_at").alias("_last")).withColumnRenamed("tool", "_tool"))
    late = rows.join(last, F.col("tool").eqNullSafe(F.col("_tool")), "left")
    failed = ~F.col("_ok") & (F.col("_last").isNull() | (F.col("_at") > F.col("_last")))
    per = late.groupBy("tool").agg(F.count(F.when(F.col("_ok"), 1)).alias("_s"), F.count("*").alias("total_calls"), F.count(F.when(failed, 1)).alias("recent_failures"))
    if registry is not None:
        per = known.join(per, F.col("tool").eqNullSafe(F.col("_tool")), "left").select(F.col("_tool").alias("tool"), *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("_s", "total_calls", "recent_failures")))
    per = per.withColumns({"_a": F.col("_s") + alpha, "_b": F.col("total_calls") - F.col("_s") + beta})
    look = beta_summary(F.col("_a"), F.col("_b"))
    return per.select("tool", look["mean"].alias("reliability"), look["lower"].alias("lower"), look["upper"].alias("upper"), "total_calls", "recent_failures", (look["mean"] > min_reliability).alias("is_reliable"), (look["lower"] < min_reliability).alias("should_break"), F.try_divide(F.col("_b") - 1, F.col("total_calls")).alias("failure_rate"), F.try_divide(F.col("total_calls") - F.col("_s"), F.col("total_calls")).alias("frequency"))


def unreliable(tools: DataFrame, threshold: float) -> DataFrame:
    """The tools whose reliability does not exceed the threshold."""
    return tools.where(~(F.col("reliability") > threshold))


def most_reliable(tools: DataFrame) -> DataFrame:
    """The tool with the highest reliability; the first by name among equals."""
    return tools.agg(F.min_by("tool", F.struct(-F.col("reliability"), "tool")).alias("tool"))


# sampling


def _checked(init: Sequence[float], draws: int, warmup: int, proposal_std: Sequence[float] | None) -> tuple[np.ndarray, np.ndarray]:
    start = np.array(init, float)
    steps = np.ones(len(start)) if proposal_std is None else np.array(proposal_std, float)
    if draws < 1 or warmup < 0 or len(steps) != len(start) or not (steps > 0).all():
        raise ValueError("draws >= 1, warmup >= 0 and a positive step for each dimension are needed")
    return start, steps


def _chain(log_density: Callable[[np.ndarray], float], start: np.ndarray, steps: np.ndarray, draws: int, warmup: int, target_rate: float | None, seed: list[int]) -> tuple[np.ndarray, float]:
    """The draws of one chain and the share accepted after the warm-up."""
    rng = np.random.default_rng(seed)
    x, lp, scale, hits = start.copy(), log_density(start), 0.0, 0
    out = np.zeros((draws, len(x)))
    for i in range(warmup + draws):
        new = x + rng.normal(size=len(x)) * steps * np.exp(scale)
        lq = log_density(new)
        yes = bool(np.log(rng.random()) < lq - lp)
        if yes:
            x, lp = new, lq
        if i < warmup:
            scale += (yes - target_rate) / np.sqrt(1 + i) if target_rate is not None else 0.0
        else:
            hits += yes
            out[i - warmup] = x
    return out, hits / draws


def metropolis(spark: SparkSession, log_density: Callable[[np.ndarray], float], init: Sequence[float], draws: int, warmup: int, proposal_std: Sequence[float] | None = None, target_rate: float | None = None, chains: int = 4, seed: int = 0) -> DataFrame:
    """(chain, draw, dim, value, acceptance_rate): random-walk chains, one a task.

    With ``target_rate`` the step adapts during the warm-up: log s += (accepted - target) /
    sqrt(1 + i), from s = 1. A NaN log ratio is a rejection. Chains are seeded by (seed, chain).
    """
    start, steps = _checked(init, draws, warmup, proposal_std)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for chain in frame["id"]:
                out, rate = _chain(log_density, start, steps, draws, warmup, target_rate, [seed, int(chain)])
                yield pd.DataFrame({"chain": chain, "draw": np.repeat(np.arange(draws), len(start)), "dim": np.tile(np.arange(len(start)), draws), "value": out.ravel(), "acceptance_rate": rate})

    return spark.range(0, chains, 1, chains).mapInPandas(run, "chain long, draw long, dim long, value double, acceptance_rate double")


def posterior_summaries(groups: DataFrame, keys: Sequence[str], log_density: Callable[[np.ndarray, dict], float], init: Callable[[dict], Sequence[float]], draws: int, warmup: int, target_rate: float | None = 0.4, chains: int = 4, seed: int = 0) -> DataFrame:
    """(keys, chain, dim, mean, variance, acceptance_rate) of sampled posteriors, a chain a row of ``groups`` and number.

    ``groups`` has a row a group with what its likelihood needs, such as sums made by an
    aggregate; ``log_density(x, row)`` and ``init(row)`` see the row as a dict. Every chain of
    every group is a task's own small work, dealt by hash; draws stay in the task. A group
    whose start has no finite density has null figures. Chains are seeded by (seed, chain, a
    hash of the keys), so results depend on neither partitions nor other groups.
    """
    _checked([0.0], draws, warmup, None)
    names = free_names(groups.columns, "chain", "spot")
    asked = groups.withColumn(names[0], F.explode(F.sequence(F.lit(0), F.lit(chains - 1)))).withColumn(names[1], F.xxhash64(*keys, names[0])).repartition(names[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], []
            for k, row in enumerate(batch.to_pylist()):
                start = np.array(init(row), float)
                density = lambda x: log_density(x, row)  # noqa: B023, E731
                if np.isfinite(start).all() and np.isfinite(density(start)):
                    drawn, rate = _chain(density, start, np.ones(len(start)), draws, warmup, target_rate, [seed, row[names[0]], row[names[1]] % 2**63])
                    told = [(d, float(drawn[:, d].mean()), float(drawn[:, d].var(ddof=1)) if draws > 1 else None, rate) for d in range(len(start))]
                else:
                    told = [(d, None, None, None) for d in range(len(start))]
                at += [k] * len(told)
                out += told
            dim, mean, variance, rate = zip(*out) if out else ((), (), (), ())
            own = [batch.column(c).take(pa.array(at, pa.int64())) for c in (*keys, names[0])]
            yield pa.RecordBatch.from_arrays([*own, pa.array(dim, pa.int64()), *(pa.array(c, pa.float64()) for c in (mean, variance, rate))], [*keys, "chain", "dim", "mean", "variance", "acceptance_rate"])

    schema = groups.select(*keys).schema.add("chain", "integer").add("dim", "long").add("mean", "double").add("variance", "double").add("acceptance_rate", "double")
    return asked.mapInArrow(run, schema)
