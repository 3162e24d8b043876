"""Refutation of effects: placebo, random common cause, subsets, bootstrap.

Each test has two forms. The scalable ones draw by an integer hash of unit and replicate:
they need no order, every replicate is a conditional sum in the same pass over the rows, and
any engine repeats them. The ``sequential`` ones make the draws of one linear congruential
generator, row after row and replicate after replicate; a draw is computed from its place, so
rows need not pass one after another. Draws travel as arrays, one a chunk of them and bucket of
rows, so what Spark shuffles has few rows and four to eight bytes a draw.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.order import numbered
from plumbline.operators.effects import difference_in_means, ols_adjusted
from plumbline.scratch import materialize

#: Draws of the hash lie below this prime.
COIN = 2**31 - 1
#: The sequential generator's multiplier, and each test's seed.
MULTIPLIER = 6364136223846793005
PLACEBO_SEED, CAUSE_SEED, SUBSET_SEED, BOOTSTRAP_SEED = 42, 123, 456, 789
#: Positions of a bucket, draws of a chunk, and chunks that a task makes one after another.
BUCKET, CHUNK, CHUNKS = 2**18, 2**21, 4


def passes(original: Column, refuted: Column, tolerance: float) -> Column:
    """Whether the change, relative unless the original is nearly 0, is below the tolerance."""
    change = F.abs(refuted - original)
    return F.when(F.abs(original) > 1e-10, change / F.abs(original)).otherwise(change) < tolerance


def coin_factors(rep: int, salt: int) -> tuple[int, int, int, int]:
    """The multipliers and the shift of a replicate's hash: powers of a primitive root, so they differ."""
    a, b, c, d = (pow(16807, 4 * (1009 * salt + rep) + k, COIN) for k in (1, 2, 3, 4))
    return a, b, c, d


def coin(unit: str, rep: int, salt: int) -> Column:
    """A number in 0..COIN-1 from an integer unit (null: as 0) and a replicate.

    Two rounds of multiply and shift modulo a prime; no product leaves 64 bits, whatever the unit.
    """
    a, b, c, d = coin_factors(rep, salt)
    u = F.coalesce(F.col(unit).cast("long"), F.lit(0).cast("long"))
    low = F.pmod(u, F.lit(COIN))
    high = F.pmod(F.shiftright(u, 31), F.lit(COIN))
    x = F.pmod(low * a + F.pmod(high * b, F.lit(COIN)) + d, F.lit(COIN))
    x = F.pmod(x.bitwiseXOR(F.shiftright(x, 15)) * c, F.lit(COIN))
    return F.pmod(x.bitwiseXOR(F.shiftright(x, 13)) * b, F.lit(COIN))


def _verdict(mean: DataFrame, name: str, original: float, tolerance: float) -> DataFrame:
    first = F.lit(float(original))
    return mean.select(F.lit(name).alias("test_name"), first.alias("original_effect"), F.col("m").alias("refuted_effect"), F.coalesce(passes(first, F.col("m"), tolerance), F.lit(False)).alias("passed"))


def _placebo_verdict(effect: DataFrame, original: float, tolerance: float) -> DataFrame:
    return effect.select(F.lit("placebo_treatment").alias("test_name"), F.lit(float(original)).alias("original_effect"), F.col("ate").alias("refuted_effect"), (F.abs("ate") < tolerance).alias("passed"))


def coins(units: np.ndarray, rep: int, salt: int) -> np.ndarray:
    """``coin`` of an array of integers."""
    a, b, c, d = coin_factors(rep, salt)
    x = (units % COIN * a + (units >> 31) % COIN * b % COIN + d) % COIN
    x = (x ^ x >> 15) * c % COIN
    return (x ^ x >> 13) * b % COIN


def _weighted_mean_effect(df: DataFrame, treatment: str, outcome: str, unit: str, replicates: int, salt: int, weigh: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(m): the mean over replicates of the difference in means weighted by ``weigh`` of the coins; an empty arm's mean is 0.

    One pass: each batch gives a row of sums a replicate, so rows are neither repeated nor shuffled.
    """
    rows = df.select(F.coalesce(F.col(unit).cast("long"), F.lit(0).cast("long")).alias("unit"), (F.col(treatment) > 0.5).alias("arm"), F.col(outcome).cast("double").alias("y")).where("arm is not null and y is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units, arm, y = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("unit", "arm", "y"))
            out = []
            for r in range(replicates):
                w = weigh(coins(units, r, salt)).astype(np.float64)
                on = w * arm
                out.append((r, (on * y).sum(), on.sum(), ((w - on) * y).sum(), (w - on).sum()))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)] if out else [pa.array([], t) for t in (pa.int64(), *[pa.float64()] * 4)], ["rep", "s1", "n1", "s0", "n0"])

    sums = rows.mapInArrow(run, "rep long, s1 double, n1 double, s0 double, n0 double").groupBy("rep").agg(*(F.sum(c).alias(c) for c in ("s1", "n1", "s0", "n0")))
    mean = lambda a: F.coalesce(F.try_divide(f"s{a}", f"n{a}"), F.lit(0.0))
    return sums.agg(F.avg(mean(1) - mean(0)).alias("m"))


def placebo(df: DataFrame, outcome: str, original: float, unit: str, tolerance: float, seed: int = PLACEBO_SEED) -> DataFrame:
    """Treatment replaced by coin flips: passes if the effect's size is below the tolerance."""
    flipped = df.withColumn("_t", (coin(unit, 0, seed) % 2).cast("double"))
    return _placebo_verdict(difference_in_means(flipped, "_t", outcome), original, tolerance)


def random_common_cause(df: DataFrame, treatment: str, outcome: str, original: float, unit: str, replicates: int = 10, seed: int = CAUSE_SEED, tolerance: float = 0.15) -> DataFrame:
    """A random covariate in (-1, 1) is adjusted for; the mean effect must stay. All replicates in one pass."""
    whole = df.where(F.col(treatment).isNotNull() & F.col(outcome).isNotNull())
    rows = whole.select(F.col(treatment).cast("double").alias("t"), F.col(outcome).cast("double").alias("y"), *((coin(unit, r, seed) * (2.0 / COIN) - 1).alias(f"x{r}") for r in range(replicates)))
    both = lambda a, b: F.coalesce(F.covar_pop(a, b), F.lit(0.0))
    got = rows.agg(both("t", "t").alias("tt"), both("t", "y").alias("ty"), *(both(a, b).alias(f"{a[0]}{b[0]}{r}") for r in range(replicates) for a, b in ((f"x{r}", f"x{r}"), ("t", f"x{r}"), (f"x{r}", "y"))))
    total = F.lit(0.0)
    for r in range(replicates):
        xx, tx, xy = (F.col(f"{n}{r}") for n in ("xx", "tx", "xy"))
        size = F.col("tt") * xx - tx * tx
        total = total + F.when(size > 1e-12 * F.col("tt") * xx, (xx * F.col("ty") - tx * xy) / F.nullif(size, F.lit(0.0))).otherwise(0.0)
    return _verdict(got.select(F.try_divide(total, F.lit(replicates)).alias("m")), "random_common_cause", original, tolerance)


def subset_validation(df: DataFrame, treatment: str, outcome: str, original: float, unit: str, fraction: float = 0.8, replicates: int = 10, seed: int = SUBSET_SEED, tolerance: float = 0.2) -> DataFrame:
    """Effects on hashed subsets of about ``fraction`` of the units; the mean must stay. All in one pass."""
    return _verdict(_weighted_mean_effect(df, treatment, outcome, unit, replicates, seed, lambda u: u < int(fraction * COIN)), "subset_validation", original, tolerance)


def poisson_edges() -> list[int]:
    """Draws from these on count one more: the hash form of Poisson(1), exact to eight."""
    edges, total, term = [], 0.0, float(np.exp(-1))
    for k in range(1, 9):
        total += term
        edges.append(round(total * COIN))
        term /= k
    return edges


def bootstrap(df: DataFrame, treatment: str, outcome: str, original: float, unit: str, replicates: int = 20, seed: int = BOOTSTRAP_SEED, tolerance: float = 0.2) -> DataFrame:
    """Resampling with replacement as Poisson(1) weights by hash; the mean effect must stay. All in one pass."""
    edges = np.array(poisson_edges())
    return _verdict(_weighted_mean_effect(df, treatment, outcome, unit, replicates, seed, lambda u: np.searchsorted(edges, u, "right")), "bootstrap_refutation", original, tolerance)


# the sequential generator


def draws_at(seed: int, places: np.ndarray) -> np.ndarray:
    """The generator's draws in [0, 1) at places (0 is the first): s <- s * a + 1 modulo 2^64, upper 31 bits.

    A step is an affine map, so the state at a place is put together from its powers of two.
    """
    steps = np.asarray(places, np.uint64) + np.uint64(1)
    state = np.full(len(steps), seed, np.uint64)
    factor, shift = MULTIPLIER, 1
    for bit in range(int(steps.max(initial=0)).bit_length()):
        on = (steps >> np.uint64(bit)) & np.uint64(1) == 1
        state[on] = state[on] * np.uint64(factor) + np.uint64(shift)
        factor, shift = factor * factor % 2**64, (factor + 1) * shift % 2**64
    return (state >> np.uint64(33)).astype(np.float64) / 2.0**31


def draws_from(seed: int, place: int, many: int) -> np.ndarray:
    """``draws_at`` of ``many`` places that follow one another: each step doubles how many are known."""
    state = np.empty(many, np.uint64)
    factor, shift, at = MULTIPLIER, 1, seed
    for bit in range((place + 1).bit_length()):
        if (place + 1) >> bit & 1:
            at = (at * factor + shift) % 2**64
        factor, shift = factor * factor % 2**64, (factor + 1) * shift % 2**64
    state[:1] = at
    factor, shift, done = MULTIPLIER, 1, 1
    while done < many:
        more = min(done, many - done)
        state[done : done + more] = state[:more] * np.uint64(factor) + np.uint64(shift)
        done, factor, shift = done + more, factor * factor % 2**64, (factor + 1) * shift % 2**64
    return (state >> np.uint64(33)).astype(np.float64) / 2.0**31


def _placed(df: DataFrame, treatment: str | None, outcome: str, order: Sequence[str]) -> tuple[DataFrame, int]:
    """(t, y, position) of the rows with both, sorted and written once, and how many there are."""
    t = F.col(treatment).cast("double") if treatment else F.lit(0.0)
    rows = df.select(*(F.col(c).alias(f"_o{i}") for i, c in enumerate(order)), t.alias("t"), F.col(outcome).cast("double").alias("y")).where("t is not null and y is not null")
    placed = numbered(rows, [f"_o{i}" for i in range(len(order))]).select("t", "y", "position")
    return placed, placed.count()


def _drawn(rows: DataFrame, seed: int, replicates: int, n: int) -> DataFrame:
    """(t, y, u): u has the draw of each replicate, which follow one another, n draws each."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            at = frame["position"].to_numpy()
            u = np.stack([draws_at(seed, r * n + at) for r in range(replicates)], axis=1)
            yield pd.DataFrame({"t": frame["t"], "y": frame["y"], "u": list(u)})

    return rows.mapInPandas(run, "t double, y double, u array<double>")


def placebo_sequential(df: DataFrame, outcome: str, original: float, order: Sequence[str], tolerance: float, seed: int = PLACEBO_SEED) -> DataFrame:
    """``placebo`` with the generator's draws: a row, in ``order``, is treated if its draw is below a half."""
    rows, n = _placed(df, None, outcome, order)
    flipped = _drawn(rows, seed, 1, n).withColumn("t", (F.col("u")[0] < 0.5).cast("double"))
    return _placebo_verdict(difference_in_means(flipped, "t", "y"), original, tolerance)


def random_common_cause_sequential(df: DataFrame, treatment: str, outcome: str, original: float, order: Sequence[str], replicates: int = 10, seed: int = CAUSE_SEED, tolerance: float = 0.15) -> DataFrame:
    """``random_common_cause`` with the generator's draws, a replicate's rows after the one before."""
    rows, n = _placed(df, treatment, outcome, order)
    many = _drawn(rows, seed, replicates, n).select("t", "y", F.posexplode("u").alias("rep", "u")).withColumn("x", F.col("u") * 2 - 1)
    return _verdict(ols_adjusted(many, "t", "y", ["x"], ["rep"]).agg(F.avg("ate").alias("m")), "random_common_cause", original, tolerance)


def _packed(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """A binary value for each piece of the array between one start and the next."""
    ends = np.append(starts, len(values)).astype(np.int32) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))])


def _unpacked(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    """The values of all binary values of a column, one after another."""
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _pieces(bucket: np.ndarray) -> np.ndarray:
    """Where each bucket starts in an array that is sorted by it."""
    return np.flatnonzero(np.diff(bucket, prepend=-1))


def _chunks(spark: SparkSession, replicates: int, size: int) -> DataFrame:
    """(id): the chunks of all replicates' draws, a replicate's one after another; few to a task."""
    many = replicates * -(-size // CHUNK)
    return spark.range(0, many, 1, max(-(-many // CHUNKS), min(many, spark.sparkContext.defaultParallelism), 1))


def _chunk_draws(batches: Iterator[pa.RecordBatch], seed: int, size: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(replicate, first step, draws) of each chunk."""
    for batch in batches:
        for chunk in batch.column("id").to_pylist():
            rep, k = divmod(chunk, -(-size // CHUNK))
            start = k * CHUNK
            yield rep, start, draws_from(seed, rep * size + start, min(CHUNK, size - start))


def _mean_by_positions(rows: DataFrame, met: DataFrame, replicates: int, left_out: bool) -> DataFrame:
    """(m): the mean over replicates of the difference in means.

    ``met`` (rep, bucket, at) holds positions: a row counts as often as its position is met, or,
    with ``left_out``, once unless it is met. A bucket's rows and positions meet in one task.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, arm, y = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("position", "arm", "y"))
            order = np.argsort(place, kind="stable")
            place = place[order]
            starts = _pieces(place // BUCKET)
            yield pa.RecordBatch.from_arrays([pa.array(place[starts] // BUCKET), _packed((place % BUCKET).astype(np.uint32), starts), _packed(arm[order].astype(np.uint8), starts), _packed(y[order].astype(np.float64), starts)], ["bucket", "at", "arm", "y"])

    def sums(met: pa.Table, own: pa.Table) -> pa.Table:
        at, arm, y = _unpacked(own.column("at"), np.uint32), _unpacked(own.column("arm"), np.uint8) == 1, _unpacked(own.column("y"), np.float64)
        parts: dict[int, list[bytes]] = {}
        for rep, some in zip(met.column("rep").to_pylist(), met.column("at").to_pylist()):
            parts.setdefault(rep, []).append(some)
        out = []
        for rep in range(replicates):
            times = np.bincount(np.frombuffer(b"".join(parts.get(rep, [])), np.uint32), minlength=BUCKET)[at]
            w = 1 - times if left_out else times
            on, off = arm & (w > 0), ~arm & (w > 0)
            out.append((rep, (y[on] * w[on]).sum(), w[on].sum(), (y[off] * w[off]).sum(), w[off].sum()))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.int64()))], ["rep", "s1", "n1", "s0", "n0"])

    packed = rows.select("position", (F.col("t") > 0.5).alias("arm"), "y").mapInArrow(pack, "bucket long, at binary, arm binary, y binary")
    got = met.groupBy("bucket").cogroup(packed.groupBy("bucket")).applyInArrow(sums, "rep long, s1 double, n1 long, s0 double, n0 long")
    mean = lambda a: F.coalesce(F.try_divide(F.sum(f"s{a}"), F.sum(f"n{a}")), F.lit(0.0))
    return got.groupBy("rep").agg((mean(1) - mean(0)).alias("ate")).agg(F.avg("ate").alias("m"))


def bootstrap_sequential(df: DataFrame, treatment: str, outcome: str, original: float, order: Sequence[str], replicates: int = 20, seed: int = BOOTSTRAP_SEED, tolerance: float = 0.2) -> DataFrame:
    """``bootstrap`` with the generator's draws: as many rows as there are, drawn with replacement."""
    rows, n = _placed(df, treatment, outcome, order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rep, _, u in _chunk_draws(batches, seed, n):
            place = np.sort((u * n).astype(np.int64) % n)
            starts = _pieces(place // BUCKET)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(starts), rep)), pa.array(place[starts] // BUCKET), _packed((place % BUCKET).astype(np.uint32), starts)], ["rep", "bucket", "at"])

    met = _chunks(df.sparkSession, replicates, n).mapInArrow(run, "rep long, bucket long, at binary")
    return _verdict(_mean_by_positions(rows, met, replicates, left_out=False), "bootstrap_refutation", original, tolerance)


def _buckets(spark: SparkSession, replicates: int, n: int) -> DataFrame:
    """(rep, bucket): every bucket of every replicate."""
    many = -(-n // BUCKET)
    return spark.range(replicates * many).select(F.floor(F.col("id") / max(many, 1)).alias("rep"), (F.col("id") % max(many, 1)).alias("bucket"))


def left_out_positions(spark: SparkSession, seed: int, replicates: int, n: int, size: int) -> DataFrame:
    """(rep, bucket, at): those of 0..n-1 that are not among the first ``size`` after each replicate's partial shuffle.

    Step i of a shuffle swaps places i and j >= i, and no later step touches place i. A place
    from ``size`` on ends with what the last step k that drew it found at its own place k:
    that is k, unless an earlier step drew k, and so on, a way of ever smaller steps. No two
    ways meet, since a step draws one place. Each round takes all ways one step on; about a
    dozen rounds end the longest of hundreds of millions, and each has fewer ways to take.
    """
    kind = np.int32 if n < 2**31 else np.int64

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rep, start, u in _chunk_draws(batches, seed, size):
            i = np.arange(start, start + len(u))
            j = i + (u * (n - i)).astype(np.int64) % (n - i)
            i, j = i[i < j], j[i < j]
            bucket = j // BUCKET
            order = np.argsort(bucket.astype(np.uint16) if n < BUCKET * 2**16 else bucket, kind="stable")
            i, j = i[order], j[order]
            starts = _pieces(j // BUCKET)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(starts), rep)), pa.array(j[starts] // BUCKET), pa.array(np.full(len(starts), start)), _packed((j % BUCKET).astype(np.uint32), starts), _packed(i.astype(kind), starts)], ["rep", "bucket", "start", "at", "step"])

    def latest(own: pa.Table) -> pa.Table:
        own = own.sort_by("start")
        last = np.full(BUCKET, -1, kind)
        last[_unpacked(own.column("at"), np.uint32)] = _unpacked(own.column("step"), kind)  # steps ascend, and the last one stays
        return pa.table({"rep": own.column("rep")[:1], "bucket": own.column("bucket")[:1], "last": pa.array([last.tobytes()], pa.binary())})

    def onward(own: pa.Table, at: np.ndarray) -> pa.Table:
        """The ways at these places of a bucket, a step on (``live``), or, where no step drew the place, its end."""
        rep, bucket = own.column("rep")[0].as_py(), own.column("bucket")[0].as_py()
        then = np.frombuffer(own.column("last")[0].as_py(), kind)[at]
        ends, then = at[then < 0].astype(np.uint32), np.sort(then[then >= 0])
        starts = _pieces(then // BUCKET)
        live = [pa.array(np.full(len(starts), rep)), pa.array(then[starts] // BUCKET, pa.int64()), _packed((then % BUCKET).astype(np.uint32), starts), pa.array(np.ones(len(starts), bool))]
        done = [pa.array([rep] * (len(ends) > 0), pa.int64()), pa.array([bucket] * (len(ends) > 0), pa.int64()), pa.array([ends.tobytes()] * (len(ends) > 0), pa.binary()), pa.array([False] * (len(ends) > 0), pa.bool_())]
        return pa.table([pa.chunked_array(c) for c in zip(live, done)], ["rep", "bucket", "at", "live"])

    def first(own: pa.Table) -> pa.Table:
        begin = own.column("bucket")[0].as_py() * BUCKET
        return onward(own, np.arange(max(size - begin, 0), min(n - begin, BUCKET)))

    def follow(ways: pa.Table, own: pa.Table) -> pa.Table:
        return onward(own, _unpacked(ways.column("at"), np.uint32)) if ways.num_rows else none

    schema = "rep long, bucket long, at binary, live boolean"
    none = pa.table({"rep": pa.array([], pa.int64()), "bucket": pa.array([], pa.int64()), "at": pa.array([], pa.binary()), "live": pa.array([], pa.bool_())})
    steps = _chunks(spark, replicates, size).mapInArrow(draw, "rep long, bucket long, start long, at binary, step binary")
    nothing = F.lit(b"")
    every = _buckets(spark, replicates, n).select("rep", "bucket", F.lit(-1).cast("long").alias("start"), nothing.alias("at"), nothing.alias("step"))
    last = materialize(steps.unionByName(every).groupBy("rep", "bucket").applyInArrow(latest, "rep long, bucket long, last binary"))
    drawn = last.where(F.col("bucket") * BUCKET < size).groupBy("rep", "bucket")
    rounds = [materialize(last.where((F.col("bucket") + 1) * BUCKET > size).groupBy("rep", "bucket").applyInArrow(first, schema))]
    while not (ways := rounds[-1].where("live")).isEmpty():
        rounds.append(materialize(ways.groupBy("rep", "bucket").cogroup(drawn).applyInArrow(follow, schema)))
    return reduce(DataFrame.unionByName, rounds).where("not live").drop("live")


def shuffled_prefix(spark: SparkSession, seed: int, replicates: int, n: int, size: int) -> DataFrame:
    """(rep, position): the first ``size`` of 0..n-1 after each replicate's partial shuffle, draws one replicate after another."""

    def rest(own: pa.Table) -> pa.Table:
        begin = own.column("bucket")[0].as_py() * BUCKET
        kept = np.ones(min(n - begin, BUCKET), bool)
        kept[_unpacked(own.column("at"), np.uint32)] = False
        place = begin + np.flatnonzero(kept)
        return pa.table({"rep": pa.array(np.full(len(place), own.column("rep")[0].as_py())), "position": pa.array(place, pa.int64())})

    out = left_out_positions(spark, seed, replicates, n, size).unionByName(_buckets(spark, replicates, n).withColumn("at", F.lit(b"")))
    return out.groupBy("rep", "bucket").applyInArrow(rest, "rep long, position long")


def subset_sequential(df: DataFrame, treatment: str, outcome: str, original: float, order: Sequence[str], fraction: float = 0.8, replicates: int = 10, seed: int = SUBSET_SEED, tolerance: float = 0.2) -> DataFrame:
    """``subset_validation`` with the generator's draws: subsets of exactly ``fraction`` of the rows (two at least), without replacement."""
    rows, n = _placed(df, treatment, outcome, order)
    rest = left_out_positions(df.sparkSession, seed, replicates, n, min(int(max(n * fraction, 2)), n))
    return _verdict(_mean_by_positions(rows, rest, replicates, left_out=True), "subset_validation", original, tolerance)
