"""Effect estimation: difference in means, adjusted regression, weighting, instruments.

Every estimator is an aggregate of sufficient statistics per group (regressions first take
means and ranges); only k x k systems, one a group, are solved in Python, on the aggregated rows. Undefined standard errors are null.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence
from operator import add, and_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.frames import free_names, join_null_safe
from plumbline.scratch import materialize, release

#: Pivots below this, relative to the matrix's largest entry in the row, mean a singular system.
PIVOT = 1e-12
#: Fixed values of the gradient descent for propensities.
STEPS, RATE, CLAMP = 100, 0.1, 0.01
#: Distinct (covariates, treatment) cells of a group that one task fits at most.
MAX_CELLS = 100_000


def sigmoid(x: Column | str) -> Column:
    """1 / (1 + e^-x)."""
    return 1 / (1 + F.exp(-(F.col(x) if isinstance(x, str) else x)))


def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a x = b by elimination with row exchange; all zeros when a pivot vanishes."""
    n = len(b)
    m = np.hstack([np.asarray(a, float), np.asarray(b, float).reshape(n, -1)])
    for k in range(n):
        p = k + int(np.argmax(np.abs(m[k:, k])))
        if abs(m[p, k]) < PIVOT:
            return np.zeros_like(np.asarray(b, float))
        m[[k, p]] = m[[p, k]]
        m[k] /= m[k, k]
        others = np.arange(n) != k
        m[others] -= np.outer(m[others, k], m[k])
    return m[:, n:].reshape(np.shape(b))


def inverse(a: np.ndarray) -> np.ndarray:
    """The inverse, or a zero matrix when a pivot vanishes."""
    return solve(a, np.eye(len(a)))


def _grouped(df: DataFrame, keys: Sequence[str], *aggs: Column) -> DataFrame:
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)


def difference_in_means(df: DataFrame, treatment: str, outcome: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, ate, std_error, n_obs): treated (over 0.5) minus control mean, unequal variances.

    An empty arm's mean is 0. The error is null unless both arms have two units.
    """
    arm, y = F.col(treatment).cast("double") > 0.5, F.col(outcome).cast("double")
    on = df.where(F.col(treatment).isNotNull() & y.isNotNull()).withColumns({"_y1": F.when(arm, y), "_y0": F.when(~arm, y)})
    stats = _grouped(on, keys, *(f(c).alias(f"{n}{i}") for i, c in enumerate(["_y0", "_y1"]) for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))))
    ate = F.coalesce("m1", F.lit(0.0)) - F.coalesce("m0", F.lit(0.0))
    error = F.when((F.col("n0") > 1) & (F.col("n1") > 1), F.sqrt(F.col("v1") / F.nullif("n1", F.lit(0)) + F.col("v0") / F.nullif("n0", F.lit(0))))
    return stats.select(*keys, ate.alias("ate"), error.alias("std_error"), (F.col("n0") + F.col("n1")).alias("n_obs"))


def _exact_sum(p: Column, bound: Column) -> Column:
    """The sum of ``p``, |p| <= 1, over ``bound`` / 2 rows at most, in two parts whose sums round nowhere, so that no order of rows changes it.

    Adding and taking away a power of two cuts p to a multiple that every partial sum is, too; what is cut off is summed likewise.
    """
    high = (bound + p) - bound
    low, small = p - high, bound * bound * 2.0**-53
    return F.sum(high) + F.sum((small + low) - small)


def _moments(df: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """One row a group: n and the centred co-moments of the columns.

    Values are taken from the group's mean and over a power of two, and summed exactly: covariances near
    zero keep their digits, whatever the order and the partitions of the rows. Two passes; means and ranges are written between.
    """
    k = len(columns)
    x, mean, scale = (free_names(keys, *(f"{c}{i}" for i in range(k))) for c in ("x", "mean", "scale"))
    n, s, bound = free_names(keys, "n", "s", "bound")
    whole = df.dropna(subset=list(columns)).select(*keys, *(F.col(c).cast("double").alias(x[i]) for i, c in enumerate(columns)))
    power = lambda least: F.when(least > 0, F.pow(F.lit(2.0), F.ceil(F.log2(least)) + 1)).otherwise(F.lit(1.0))
    spread = _grouped(whole, keys, F.count("*").alias(bound), *(f(c).alias(f"{name}_{c}") for c in x for name, f in (("avg", F.avg), ("min", F.min), ("max", F.max))))
    known = materialize(spread.select(*keys, power(2 * F.col(bound)).alias(bound), *(F.col(f"avg_{c}").alias(m) for c, m in zip(x, mean)), *(power(F.greatest(F.col(f"max_{c}") - F.col(f"avg_{c}"), F.col(f"avg_{c}") - F.col(f"min_{c}"))).alias(z) for c, z in zip(x, scale))))
    joined = join_null_safe(whole, known, keys) if keys else whole.crossJoin(F.broadcast(known))  # one row
    u = [(F.col(x[i]) - F.col(mean[i])) / F.col(scale[i]) for i in range(k)]
    total = lambda p: _exact_sum(p, F.col(bound))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    sums, rest = [total(c) for c in u], [total(u[i] * u[j]) for i, j in pairs]
    size = [F.max(z) for z in scale]
    aggs = [F.coalesce((t - F.try_divide(sums[i] * sums[j], F.count("*"))) * size[i] * size[j], F.lit(0.0)) for (i, j), t in zip(pairs, rest)]
    return _grouped(joined, keys, F.count("*").alias(n), F.array(*aggs).alias(s))


def _square(s: Sequence[float], k: int) -> np.ndarray:
    out = np.zeros((k, k))
    out[np.triu_indices(k)] = s
    return out + np.triu(out, 1).T


def _per_group(stats: DataFrame, keys: Sequence[str], fit) -> DataFrame:
    """Solve each aggregated row; ``fit(n, s)`` -> (ate, std_error or None)."""
    names = list(keys)
    n_, s_ = stats.columns[-2:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(n_)
            done = [fit(int(k), np.array(s, float)) for k, s in zip(n.to_pylist(), batch.column(s_).to_pylist())]
            errors = [None if e is None or not np.isfinite(e) else float(e) for _, e in done]
            # key columns pass as they came: no value changes its type beside a null
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array([float(a) for a, _ in done], pa.float64()), pa.array(errors, pa.float64()), n.cast(pa.int64())], [*names, "ate", "std_error", "n_obs"])

    return stats.mapInArrow(run, stats.select(*names).schema.add("ate", "double").add("std_error", "double").add("n_obs", "long"))


def ols_adjusted(df: DataFrame, treatment: str, outcome: str, covariates: Sequence[str] = (), keys: Sequence[str] = ()) -> DataFrame:
    """(keys, ate, std_error, n_obs): the treatment's coefficient given the covariates.

    A singular design gives 0 and 0; no residual degrees of freedom give a null error.
    """
    p = len(covariates)

    def fit(n: int, s: np.ndarray):
        m = _square(s, p + 2)
        x, xy = m[: p + 1, : p + 1], m[: p + 1, p + 1]
        scale = np.sqrt(np.maximum(np.diag(x), 1e-300))
        beta, inv = solve(x / np.outer(scale, scale), xy / scale) / scale, inverse(x / np.outer(scale, scale)) / np.outer(scale, scale)
        dof = n - p - 2
        rss = max(m[p + 1, p + 1] - beta @ xy, 0.0)
        return beta[0], None if dof <= 0 else np.sqrt(rss / dof * inv[0, 0])

    return _per_group(_moments(df, [treatment, *covariates, outcome], keys), keys, fit)


def two_stage_ls(df: DataFrame, treatment: str, outcome: str, instruments: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, ate, std_error, n_obs): the outcome on the treatment as fitted by the instruments.

    The error uses residuals from the fitted treatment. A treatment that the instruments do
    not move gives 0 and 0; two units leave no degrees of freedom and a null error.
    """
    k = len(instruments)

    def fit(n: int, s: np.ndarray):
        m = _square(s, k + 2)
        z, zt, zy = m[:k, :k], m[:k, k], m[:k, k + 1]
        scale = np.sqrt(np.maximum(np.diag(z), 1e-300))
        first = solve(z / np.outer(scale, scale), zt / scale) / scale
        fitted = first @ zt
        if fitted <= PIVOT * max(m[k, k], 1e-300):
            return 0.0, 0.0
        beta = first @ zy / fitted
        rss = max(m[k + 1, k + 1] - beta * (first @ zy), 0.0)
        return beta, None if n <= 2 else np.sqrt(rss / (n - 2) / fitted)

    return _per_group(_moments(df, [*instruments, treatment, outcome], keys), keys, fit)


def _ipw_fit(cells: pd.DataFrame, p: int) -> tuple[float, float | None, int]:
    x = np.column_stack([np.ones(len(cells)), *(cells[f"x{i}"].to_numpy(float) for i in range(p))])
    t, n, y, yy = (cells[c].to_numpy(float) for c in ("t", "n", "sy", "syy"))
    total, weights = n.sum(), np.zeros(p + 1)
    for _ in range(STEPS):
        weights += RATE * x.T @ (n * (t - 1 / (1 + np.exp(-(x @ weights))))) / total
    e = np.clip(1 / (1 + np.exp(-(x @ weights))), CLAMP, 1 - CLAMP)
    on = t > 0.5
    w = np.where(on, 1 / e, 1 / (1 - e))
    mean = [(w * y)[arm].sum() / (w * n)[arm].sum() if arm.any() else 0.0 for arm in (on, ~on)]
    ate, sign = mean[0] - mean[1], np.where(on, w, -w)
    square = (sign**2 * yy - 2 * ate * sign * y + n * ate**2).sum()
    return ate, np.sqrt(square / total / (total - 1)) if total > 1 else None, int(total)


def _ipw_steps(cells: DataFrame, names: Sequence[str], p: int) -> DataFrame:
    """The same fit with each gradient step an aggregate over the cells; a step's weights are one row a group."""
    keys = [f"k{i}" for i in range(len(names))]
    groups = cells.select(*(F.col(c).alias(k) for c, k in zip(names, keys))).distinct() if names else cells.sparkSession.range(1).select()
    weights = materialize(groups.select(*keys, *(F.lit(0.0).alias(f"w{i}") for i in range(p + 1))))
    same = functools.reduce(and_, (F.col(c).eqNullSafe(F.col(k)) for c, k in zip(names, keys)), F.lit(True))
    x = [F.lit(1.0), *(F.col(f"x{i}") for i in range(p))]
    fitted = sigmoid(functools.reduce(add, (F.col(f"w{i}") * x[i] for i in range(p + 1))))
    for _ in range(STEPS):
        joined = cells.join(weights, same) if keys else cells.crossJoin(F.broadcast(weights))  # one row
        pull = F.col("n") * (F.col("t") - fitted)
        own = [F.col(k) for k in keys] + [F.col(f"w{i}") for i in range(p + 1)]
        moved = joined.groupBy(*own).agg(F.sum("n").alias("_n"), *(F.sum(pull * x[i]).alias(f"_g{i}") for i in range(p + 1)))
        after = materialize(moved.select(*keys, *((F.col(f"w{i}") + RATE * F.col(f"_g{i}") / F.col("_n")).alias(f"w{i}") for i in range(p + 1))))
        release(weights)
        weights = after
    joined = cells.join(weights, same) if keys else cells.crossJoin(F.broadcast(weights))
    e, on = F.least(F.greatest(fitted, F.lit(CLAMP)), F.lit(1 - CLAMP)), F.col("t") > 0.5
    w = F.when(on, 1 / e).otherwise(1 / (1 - e))
    sums = {"a1": F.when(on, w * F.col("sy")), "b1": F.when(on, w * F.col("n")), "a0": F.when(~on, w * F.col("sy")), "b0": F.when(~on, w * F.col("n")), "yy": w * w * F.col("syy"), "total": F.col("n")}
    got = joined.groupBy(*names).agg(*(F.sum(c).alias(f"_{k}") for k, c in sums.items()))
    mean = lambda arm: F.coalesce(F.try_divide(f"_a{arm}", f"_b{arm}"), F.lit(0.0))
    got = got.withColumn("ate", mean(1) - mean(0))
    signed = F.coalesce("_a1", F.lit(0.0)) - F.coalesce("_a0", F.lit(0.0))
    square = F.col("_yy") - 2 * F.col("ate") * signed + F.col("_total") * F.col("ate") * F.col("ate")
    return got.select(*names, "ate", F.when(F.col("_total") > 1, F.sqrt(F.try_divide(square / F.col("_total"), F.col("_total") - 1))).alias("std_error"), F.col("_total").cast("long").alias("n_obs"))


def ipw(df: DataFrame, treatment: str, outcome: str, covariates: Sequence[str], keys: Sequence[str] = (), max_cells: int = MAX_CELLS) -> DataFrame:
    """(keys, ate, std_error, n_obs): inverse-propensity weighting, normalised within arms.

    Propensities come from a fixed number of full-batch gradient steps from zero, clamped.
    Rows are first collapsed to distinct (covariates, treatment) cells with their sums, written
    once. Where every group has ``max_cells`` at most, a group is fitted in one task; else each
    step is an aggregate over all cells (same result, a hundred small jobs), so continuous
    covariates cost time, not memory.
    """
    p = len(covariates)
    named = df.dropna(subset=[treatment, outcome, *covariates]).select(*keys, F.col(treatment).cast("double").alias("t"), F.col(outcome).cast("double").alias("y"), *(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(covariates)))
    cells = materialize(named.groupBy(*keys, "t", *(f"x{i}" for i in range(p))).agg(F.count("*").alias("n"), F.sum("y").alias("sy"), F.sum(F.col("y") * F.col("y")).alias("syy")))
    names = list(keys)
    if (cells.groupBy(*names).agg(F.count("*").alias("c")).agg(F.max("c")).first()[0] or 0) > max_cells:
        return _ipw_steps(cells, names, p)

    def fit(cells: pd.DataFrame) -> pd.DataFrame:
        ate, error, n = _ipw_fit(cells, p)
        return pd.DataFrame({**{c: [cells[c].iloc[0]] for c in names}, "ate": [ate], "std_error": [error], "n_obs": [n]})

    schema = ", ".join([*(f"`{c}` {cells.schema[c].dataType.simpleString()}" for c in names), "ate double, std_error double, n_obs long"])
    return cells.withColumn("_all", F.lit(1)).groupBy("_all", *keys).applyInPandas(fit, schema)


def counterfactual(df: DataFrame, effect: DataFrame, treatment: str, outcome: str, new_treatment: Column | float, keys: Sequence[str] = ()) -> DataFrame:
    """``df`` with cf_outcome, cf_se, lower, upper under another treatment, given (keys, ate, std_error).

    The outcome moves by ate per unit of treatment; the interval is 1.96 errors either way.
    ``effect`` has one row a group (without keys: one row); several make the query fail. Null
    keys are a group like any other. Rows of a group without effect stay, with nulls.
    """
    shift = (new_treatment if isinstance(new_treatment, Column) else F.lit(float(new_treatment))) - F.col(treatment).cast("double")
    own = [f"_key{i}" for i in range(len(keys))]
    named = effect.select(*(F.col(c).alias(k) for c, k in zip(keys, own)), "ate", "std_error")
    one = _grouped(named, own, F.count("*").alias("_n"), F.first("ate").alias("ate"), F.first("std_error").alias("std_error"))
    only = lambda c: F.when(F.col("_n") > 1, F.raise_error(F.lit("several effects of one group")).cast("double")).otherwise(F.col(c))
    small = one.select(*own, only("ate").alias("_ate"), only("std_error").alias("_se"))
    same = functools.reduce(and_, (F.col(c).eqNullSafe(F.col(k)) for c, k in zip(keys, own)), F.lit(True))
    joined = df.join(small, same, "left") if keys else df.crossJoin(F.broadcast(small))  # one row
    y, se = F.col(outcome) + F.col("_ate") * shift, F.abs(shift) * F.col("_se")
    return joined.withColumns({"cf_outcome": y, "cf_se": se, "lower": y - 1.96 * se, "upper": y + 1.96 * se}).drop(*own, "_ate", "_se")


def counterfactual_from_data(df: DataFrame, treatment: str, outcome: str, new_treatment: Column | float, keys: Sequence[str] = ()) -> DataFrame:
    """``counterfactual`` with the effect estimated on ``df`` by difference in means.

    The effects are written first: the planner then knows how few they are and need not shuffle ``df`` by the keys.
    """
    return counterfactual(df, materialize(difference_in_means(df, treatment, outcome, keys)), treatment, outcome, new_treatment, keys)
