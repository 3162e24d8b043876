"""Decision operators on small known cases."""

import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline import scratch
from plumbline.functions import confidence_level, fold_sessions, is_approved, is_error, needs_review, reasoning_log, reclassify
from plumbline.functions.order import epochs, numbered, running_total
from plumbline.operators import beliefs, effects, guards, refuters, routing
from plumbline.operators.graphs import CausalGraph, adjustment_sets, closure, reachable, separated
from plumbline.operators.policy_text import PolicyError, compile_policy, text_policy
from plumbline.plans.study import Study
from plumbline.plans import workflow
from plumbline.plans.workflow import ApprovalNeeded, Checkpoint, CycleFound, NodeFailed, NodeTimedOut, NoEntry, TableNode, TooManySteps, UnknownNode, Workflow, run_table


def units(spark, rows, cols="t double, y double"):
    return spark.createDataFrame(rows, cols)


# effects


def test_difference_in_means(spark):
    r = effects.difference_in_means(units(spark, list(zip([1.0] * 3 + [0.0] * 3, [10.0, 12.0, 11.0, 5.0, 6.0, 7.0]))), "t", "y").first()
    assert r.ate == pytest.approx(5) and r.n_obs == 6 and r.std_error == pytest.approx(0.816497, abs=1e-6)
    assert effects.difference_in_means(units(spark, [(1.0, 5.0), (0.0, 5.0)]), "t", "y").first()[:2] == (0.0, None)
    assert effects.difference_in_means(units(spark, [(1.0, 4.0), (1.0, 6.0), (None, 9.0)]), "t", "y").first()[:3] == (5.0, None, 2)


def simulated(n, seed):
    rng = np.random.default_rng(seed)
    z = rng.normal(size=n)
    t = (z + rng.normal(size=n) > 0).astype(float)
    return t, 2 + 5 * t + 3 * z + rng.normal(size=n), z


def test_ols_and_2sls_match_numpy(spark):
    t, y, z = simulated(200, 42)
    df = units(spark, [tuple(map(float, r)) for r in zip(t, y, z)], "t double, y double, z double")
    x = np.column_stack([np.ones(200), t, z])
    beta, rss = np.linalg.lstsq(x, y, rcond=None)[:2]
    r = effects.ols_adjusted(df, "t", "y", ["z"]).first()
    assert r.ate == pytest.approx(beta[1]) and r.std_error == pytest.approx(np.sqrt(rss[0] / 197 * np.linalg.inv(x.T @ x)[1, 1]))
    assert effects.ols_adjusted(df, "t", "y").first().ate == pytest.approx(effects.difference_in_means(df, "t", "y").first().ate)
    flat = df.withColumn("t", F.lit(1.0))
    assert effects.ols_adjusted(flat, "t", "y", ["z"]).first()[:2] == (0.0, 0.0)
    assert effects.ols_adjusted(df.limit(3), "t", "y", ["z"]).first().std_error is None
    r = effects.two_stage_ls(df, "t", "y", ["z"]).first()
    assert r.ate == pytest.approx(np.cov(z, y)[0, 1] / np.cov(z, t)[0, 1])
    assert effects.two_stage_ls(flat, "t", "y", ["z"]).first()[:2] == (0.0, 0.0)


def test_ipw_matches_row_by_row(spark):
    rows = [(float((x > 0 and i % 4 != 0) or (x < 0 and i % 4 == 0)), x) for i in range(80) for x in [1.0 if i < 40 else -1.0]]
    t, x = map(np.array, zip(*rows))
    y = 5 * t + 3 * x
    w = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-(w[0] + w[1] * x)))
        w += 0.1 * np.array([(t - p).mean(), ((t - p) * x).mean()])
    e = np.clip(1 / (1 + np.exp(-(w[0] + w[1] * x))), 0.01, 0.99)
    ate = (t * y / e).sum() / (t / e).sum() - ((1 - t) * y / (1 - e)).sum() / ((1 - t) / (1 - e)).sum()
    se = np.sqrt(((np.where(t > 0.5, y / e, -y / (1 - e)) - ate) ** 2).sum() / (80 * 79))
    r = effects.ipw(units(spark, [tuple(map(float, v)) for v in zip(t, y, x)], "t double, y double, x double"), "t", "y", ["x"]).first()
    assert r.ate == pytest.approx(ate) and r.std_error == pytest.approx(se) and abs(r.ate - 5) < 2 and r.n_obs == 80


def test_counterfactuals(spark):
    effect = spark.createDataFrame([(5.0, 1.0)], "ate double, std_error double")
    r = effects.counterfactual(units(spark, [(1.0, 10.0)]), effect, "t", "y", 0.0).first()
    assert r.cf_outcome == 5 and r.lower == pytest.approx(3.04) and r.upper == pytest.approx(6.96)
    got = effects.counterfactual_from_data(units(spark, [(1.0, 10.0), (1.0, 12.0), (0.0, 5.0), (0.0, 6.0)]), "t", "y", 0.0).collect()
    assert all((r.cf_outcome < r.y) == (r.t == 1) for r in got)


def test_refuters(spark):
    df = spark.range(100).selectExpr("id", "double(id < 50) as t", "if(id < 50, 10D, 5D) as y")
    assert refuters.subset_validation(df, "t", "y", 5.0, "id").first().passed
    assert refuters.bootstrap(df, "t", "y", 5.0, "id").first().passed
    assert refuters.random_common_cause(df, "t", "y", 5.0, "id").first().passed
    assert refuters.placebo(df, "y", 5.0, "id", 3.0).first().passed
    assert not refuters.subset_validation(df.limit(0), "t", "y", 5.0, "id").first().passed
    # units of any size, and null ones
    far = df.selectExpr("if(id = 7, null, id * 92233720368547758 - 4000000000000000000) as id", "t", "y")
    assert refuters.subset_validation(far, "t", "y", 5.0, "id").first().passed and refuters.bootstrap(far, "t", "y", 5.0, "id").first().passed


def test_replicates_are_independent(spark):
    cols = [refuters.coin("id", r, 456) for r in range(6)]
    x = np.array([list(r) for r in spark.range(4000).select(*cols).collect()]) / refuters.COIN
    assert x.min() >= 0 and x.max() < 1 and np.abs(x.mean(axis=0) - 0.5).max() < 0.03 and np.abs(x.std(axis=0) - 12**-0.5).max() < 0.02
    assert np.abs(np.corrcoef(x.T) - np.eye(6)).max() < 0.06 and np.abs(np.corrcoef(x[1:, 0], x[:-1, 0])[0, 1]) < 0.06


class Sequential:
    """The generator, draw after draw."""

    def __init__(self, seed):
        self.state = seed

    def draw(self):
        self.state = (self.state * 6364136223846793005 + 1) % (1 << 64)
        return (self.state >> 33) / float(1 << 31)


def test_sequential_refuters(spark):
    one = Sequential(42)
    want = [one.draw() for _ in range(300)]
    assert want[:3] == pytest.approx([0.490021672, 0.468765184, 0.560224195])
    assert refuters.draws_at(42, np.arange(300)).tolist() == want and refuters.draws_at(42, np.array([299, 7])).tolist() == [want[299], want[7]]
    rng = np.random.default_rng(3)
    t, y = (rng.random(41) < 0.5).astype(float), rng.normal(size=41)
    y[5], n = np.nan, 41
    rows = [(i, float(a), None if np.isnan(b) else float(b)) for i, (a, b) in enumerate(zip(t, y))]
    df = spark.createDataFrame(rows, "id long, t double, y double").repartition(5)
    keep = ~np.isnan(y)
    t, y, n = t[keep], y[keep], 40
    mean = lambda a, b: (b[a > 0.5].mean() if (a > 0.5).any() else 0.0) - (b[a <= 0.5].mean() if (a <= 0.5).any() else 0.0)
    g = Sequential(42)
    flips = np.array([float(g.draw() < 0.5) for _ in range(n)])
    assert refuters.placebo_sequential(df, "y", 0.3, ["id"], 1.0).first().refuted_effect == pytest.approx(mean(flips, y))
    g, effects_ = Sequential(123), []
    for _ in range(4):
        x = np.array([g.draw() * 2 - 1 for _ in range(n)])
        effects_.append(np.linalg.lstsq(np.column_stack([np.ones(n), t, x]), y, rcond=None)[0][1])
    assert refuters.random_common_cause_sequential(df, "t", "y", 0.3, ["id"], 4).first().refuted_effect == pytest.approx(np.mean(effects_))
    g, effects_ = Sequential(456), []
    for _ in range(4):
        items = list(range(n))
        for i in range(32):
            j = i + int(g.draw() * (n - i)) % (n - i)
            items[i], items[j] = items[j], items[i]
        effects_.append(mean(t[items[:32]], y[items[:32]]))
    assert refuters.subset_sequential(df, "t", "y", 0.3, ["id"], 0.8, 4).first().refuted_effect == pytest.approx(np.mean(effects_))
    g, effects_ = Sequential(789), []
    for _ in range(4):
        items = [int(g.draw() * n) % n for _ in range(n)]
        effects_.append(mean(t[items], y[items]))
    assert refuters.bootstrap_sequential(df, "t", "y", 0.3, ["id"], 4).first().refuted_effect == pytest.approx(np.mean(effects_))


@pytest.mark.parametrize(("n", "size"), [(1, 1), (2, 2), (7, 7), (40, 32), (5000, 4000), (5000, 3)])
def test_shuffled_prefix(spark, n, size):
    got = refuters.shuffled_prefix(spark, 456, 3, n, size)
    g = Sequential(456)
    for rep in range(3):
        items = list(range(n))
        for i in range(size):
            j = i + int(g.draw() * (n - i)) % (n - i)
            items[i], items[j] = items[j], items[i]
        assert sorted(r.position for r in got.where(F.col("rep") == rep).collect()) == sorted(items[:size])


def test_null_groups_and_several_effects(spark):
    df = spark.createDataFrame([(1, "a", 1.0, 5.0), (2, None, 1.0, 6.0), (3, None, 0.0, 2.0), (4, "a", 0.0, 1.0), (5, "lone", 1.0, 7.0)], "id int, k string, t double, y double")
    got = {r.id: r.cf_outcome for r in effects.counterfactual_from_data(df, "t", "y", 0.0, ["k"]).collect()}
    assert got == {1: 1.0, 2: 2.0, 3: 2.0, 4: 1.0, 5: 0.0}
    other = {r.id: r.cf_outcome for r in effects.counterfactual(df, spark.createDataFrame([("a", 2.0, None)], "k string, ate double, std_error double"), "t", "y", 0.0, ["k"]).collect()}
    assert other == {1: 3.0, 2: None, 3: None, 4: 1.0, 5: None}
    two = spark.createDataFrame([(1.0, None), (2.0, None)], "ate double, std_error double")
    with pytest.raises(Exception, match="several effects"):
        effects.counterfactual(df, two, "t", "y", 0.0).collect()


def test_ipw_by_steps_is_the_same(spark, monkeypatch):
    df = spark.range(120).selectExpr("if(id % 3 = 0, null, 'g') as k", "double(id % 5 < 2) as t", "double(id % 7) / 7 as x", "double(id % 11) + id % 5 as y")
    monkeypatch.setattr(effects, "STEPS", 6)
    cells = df.groupBy("k", "t", F.col("x").alias("x0")).agg(F.count("*").alias("n"), F.sum("y").alias("sy"), F.sum(F.col("y") * F.col("y")).alias("syy")).toPandas()
    for keys, parts in (([], [cells]), (["k"], [cells[cells.k.isna()], cells[cells.k == "g"]])):
        far = sorted(effects.ipw(df, "t", "y", ["x"], keys, max_cells=1).collect(), key=lambda r: r.n_obs)
        for (ate, error, n), r in zip(sorted((effects._ipw_fit(part, 1) for part in parts), key=lambda x: x[2]), far, strict=True):
            assert r.n_obs == n and r.ate == pytest.approx(ate) and r.std_error == pytest.approx(error)


def test_study(spark):
    t, y, z = simulated(300, 7)
    df = units(spark, [(i, *map(float, r)) for i, r in enumerate(zip(t, y, z))], "id long, t double, y double, z double")
    study = Study(df, CausalGraph([("z", "t"), ("z", "y"), ("t", "y")]), "t", "y")
    assert study.identify() == ["z"] and abs(study.estimate().first().ate - 5) < 0.5
    assert study.refute("id", 2.0).count() == 4
    with pytest.raises(ValueError):
        Study(df, CausalGraph([("missing", "t"), ("t", "y")]), "t", "y").identify()


# graphs


def test_separation():
    chain, fork, collider = CausalGraph([("X", "W"), ("W", "Y")]), CausalGraph([("W", "X"), ("W", "Y")]), CausalGraph([("X", "W"), ("Y", "W"), ("W", "D")])
    assert [g.d_separated("X", "Y", ["W"]) for g in (chain, fork, collider)] == [True, True, False]
    assert [g.d_separated("X", "Y") for g in (chain, fork, collider)] == [False, False, True]
    assert not collider.d_separated("X", "Y", ["D"])
    mixed = CausalGraph([("A", "B"), ("B", "C"), ("C", "D"), ("A", "E"), ("B", "E"), ("E", "D")])
    assert [mixed.d_separated("A", "D", z) for z in ([], ["B", "E"], ["C"])] == [False, True, False]
    assert chain.d_separated("X", "nobody") and not chain.d_separated("X", "X") and chain.d_separated("X", "Y", ["W", "nobody"])
    with pytest.raises(ValueError):
        chain.d_separated("X", "Y", ["X"], strict=True)


def test_adjustment_sets():
    assert CausalGraph([("Z", "X"), ("X", "Y"), ("Z", "Y")]).backdoor("X", "Y") == {"Z"}
    assert CausalGraph([("X", "Y")]).backdoor("X", "Y", "verified") == set()
    assert CausalGraph([("X", "Y")]).backdoor("X", "none") is None
    smoke = [("U", "S"), ("U", "C"), ("S", "T"), ("T", "C")]
    assert CausalGraph(smoke).front_door("S", "C") == {"T"}
    assert CausalGraph([*smoke, ("S", "C")]).front_door("S", "C") is None
    assert CausalGraph([("U", "X"), ("U", "Y"), ("X", "Y")]).front_door("X", "Y") is None
    assert CausalGraph([("X", "A"), ("A", "Y"), ("X", "B"), ("B", "Y")]).front_door("X", "Y") == {"A", "B"}


def test_graph_structure(spark):
    g = CausalGraph([("a", "b"), ("a", "b"), ("b", "c")], ["z"])
    assert (g.num_variables, g.num_edges, g.variables) == (4, 3, ["z", "a", "b", "c"])
    assert g.parents("b") == ["a", "a"] and g.children("nobody") == [] and g.is_acyclic()
    again = CausalGraph.from_json(g.to_json())
    assert (again.variables, again.edges) == (g.variables, g.edges)
    assert not CausalGraph([("a", "b"), ("b", "a")]).is_acyclic()
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    loop = CausalGraph([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y")]).frame(spark)
    assert {(r.node, r.depth) for r in reachable(loop, spark.createDataFrame([("a",)], "node string")).collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}


@settings(max_examples=60, deadline=None)
@given(st.sets(st.tuples(st.integers(0, 6), st.integers(0, 6)), max_size=14), st.sets(st.integers(2, 6)))
def test_separation_is_symmetric(pairs, given_):
    g = CausalGraph([(f"n{min(p)}", f"n{max(p)}") for p in pairs if p[0] != p[1]], [f"n{i}" for i in range(7)])
    z = [f"n{i}" for i in given_]
    assert g.d_separated("n0", "n1", z) == g.d_separated("n1", "n0", z)


# beliefs


def test_conjugate(spark):
    one = spark.createDataFrame([("a", 7, 3)], "k string, s long, f long")
    r = beliefs.beta_posterior(one, "s", "f", ["k"]).first()
    assert r.mean == pytest.approx(8 / 12) and r.mode == pytest.approx(0.7) and 0 <= r.lower < r.mean < r.upper <= 1
    fives = spark.createDataFrame([("a", 5.0)] * 5, "k string, v double")
    assert abs(beliefs.normal_posterior(fives, "v", ["k"], 0.0, 10.0, 1.0).first().mean - 5) < 0.5
    counts = spark.createDataFrame([("a", c) for c in (3, 4, 5, 6, 7)], "k string, c long")
    assert beliefs.gamma_posterior(counts, "c", ["k"]).first().mean == pytest.approx(26 / 6)
    cats = spark.createDataFrame([("a", c) for c in ["x"] * 10 + ["y"] * 5 + ["z"] * 5], "k string, c string")
    got = {r.category: r for r in beliefs.dirichlet_posterior(cats, "c", ["k"], ["x", "y", "z"]).collect()}
    assert got["x"].mean == pytest.approx(11 / 23) and got["y"].mode == pytest.approx(5 / 20)
    prior = {r.category: r for r in beliefs.dirichlet_posterior(cats.withColumn("c", F.lit("none")), "c", ["k"], ["x", "y", "z"], [3.0, 2.0, 5.0]).collect()}
    assert prior["z"].mode == pytest.approx(4 / 7) and prior["x"].variance == pytest.approx(21 / 1100)
    for bad in (0.0, -1.0, float("nan"), float("inf")):
        with pytest.raises(ValueError):
            beliefs.beta_posterior(one, "s", "f", ["k"], bad)


def test_tracking(spark):
    rows = [("e", 1, "binary", 5, 2), ("e", 2, "continuous", None, None), ("e", 3, "binary", 3, 1)]
    obs = spark.createDataFrame(rows, "entity string, seq long, kind string, successes long, failures long")
    r = beliefs.track(obs, "binary", 1.0, 1.0).first()
    assert r.mean == pytest.approx(9 / 13) and (r.observation_count, r.mismatches) == (2, 1)
    assert beliefs.before_first_mismatch(obs, "binary").count() == 1
    counts = spark.createDataFrame([("e", "count", 4, 3)], "entity string, kind string, count long, periods long")
    assert beliefs.track(counts, "count", 1.0, 1.0).first()[2:4] == (13.0, 4.0)
    values = spark.createDataFrame([("e", "continuous", 2.0)], "entity string, kind string, value double")
    assert beliefs.track(values, "continuous", 0.0, 1.0).first().mean == pytest.approx(1.0)


def test_tools(spark):
    calls = [("a", i, True) for i in range(10)] + [("b", i, False) for i in range(10)] + [("c", i, i < 5) for i in range(10)]
    tools = beliefs.tool_reliability(spark.createDataFrame(calls, "tool string, seq long, ok boolean"), "tool", F.col("ok"), ["seq"], 0.5)
    got = {r.tool: r for r in tools.collect()}
    assert got["a"].is_reliable and not got["b"].is_reliable and got["b"].should_break
    assert [got[k].recent_failures for k in "abc"] == [0, 10, 5] and got["c"].frequency == 0.5
    assert beliefs.most_reliable(tools).first().tool == "a"


def test_sampling(spark):
    got = beliefs.metropolis(spark, lambda x: -0.5 * float(x[0]) ** 2, [0.0], 3000, 500, [1.0], chains=2, seed=3)
    r = got.agg(F.avg("value").alias("m"), F.var_samp("value").alias("v")).first()
    assert abs(r.m) < 0.2 and abs(r.v - 1) < 0.3
    again = beliefs.metropolis(spark, lambda x: -0.5 * float(x[0]) ** 2, [0.0], 3000, 500, [1.0], chains=2, seed=3)
    assert got.exceptAll(again).isEmpty()
    rate = beliefs.metropolis(spark, lambda x: -50 * float(x[0]) ** 2, [0.0], 2000, 2000, target_rate=0.4, chains=1).first().acceptance_rate
    assert abs(rate - 0.4) < 0.15
    with pytest.raises(ValueError):
        beliefs.metropolis(spark, lambda x: 0.0, [0.0], 10, 0, [-1.0])


def test_posteriors_of_groups(spark):
    rows = [(None, 50, 2.0), ("a", 50, -1.0), ("a2", 0, 0.0), ("b", None, 1.0)]
    groups = spark.createDataFrame(rows, "g string, n int, m double").withColumn("chain", F.lit("mine"))
    density = lambda x, r: -0.5 * r["n"] * (x[0] - r["m"]) ** 2 if r["n"] else float("nan")
    ask = lambda df: beliefs.posterior_summaries(df, ["g"], density, lambda r: [r["m"]], 3000, 500, chains=3)
    got = ask(groups).collect()
    assert sorted((r.g or "", r.chain) for r in got) == [(g, c) for g in ("", "a", "a2", "b") for c in range(3)]
    for r in got:
        if r.g in ("a2", "b"):
            assert r.mean is None and r.variance is None
        else:
            assert r.mean == pytest.approx(2.0 if r.g is None else -1.0, abs=0.05) and r.variance == pytest.approx(0.02, rel=0.4) and abs(r.acceptance_rate - 0.4) < 0.1
    alone = ask(groups.where("g = 'a'").repartition(7)).collect()
    assert sorted(map(tuple, alone)) == sorted(tuple(r) for r in got if r.g == "a")  # no group depends on others


# guards


def test_policies(spark):
    df = spark.createDataFrame([('{"risk": 0.2}',), ('{"risk": 0.6}',), ('{"risk": 0.9}',), ('{"risk": "x"}',), ("{}",)], "ctx string")
    risk = guards.risk_of("ctx", "risk")
    got = [r[0] for r in df.select(guards.policy_chain(guards.risk_policy(risk, 0.5, 0.8))).collect()]
    assert [r.decision for r in got] == ["approve", "escalate", "reject", "error", "error"] and "0.900" in got[2].reason
    assert got[3].reason == "Policy evaluation failed: Missing or invalid risk field 'risk' in context"
    odd = ['{"risk": "0.2"}', '{"risk": null}', '{"risk": true}', '{"risk": [0.2]}', "no json", None, '{"deep": {"risk": 0.2}}', '{"risk": 1}']
    seen = spark.createDataFrame([(i, c) for i, c in enumerate(odd)], "id int, ctx string").orderBy("id")
    assert [r[0] for r in seen.select(guards.policy_chain(guards.risk_policy(risk, 0.5, 0.8)).decision).collect()] == ["error"] * 7 + ["reject"]
    number = spark.createDataFrame([(float("nan"),), (None,), (0.1,)], "r double").select(guards.policy_chain(guards.risk_policy(F.col("r"), 0.5, 0.8)).decision)
    assert [r[0] for r in number.collect()] == ["error", "error", "approve"]
    # the first of rejection, escalation and error stands
    late = guards.policy_chain(guards.rule_policy(F.lit(False), "no"), guards.error("late"))
    early = guards.policy_chain(guards.error("early"), guards.rule_policy(F.lit(False), "no"))
    kinds = df.select(F.explode(F.array(guards.approve(), guards.escalate("x"), guards.error("y"), guards.reject("z"))).alias("p")).limit(4)
    assert [tuple(r) for r in kinds.select(is_approved("p.decision"), needs_review("p.decision"), is_error("p.decision")).collect()] == [(True, False, False), (False, True, False), (False, False, True), (False, False, False)]
    assert df.select(late.decision, early.decision, early.reason).first() == ("reject", "error", "Policy evaluation failed: early")
    who = spark.createDataFrame([("admin",), ("viewer",), (None,)], "role string")
    assert [r[0] for r in who.select(guards.policy_chain(guards.rule_policy("role = 'admin'")).decision).collect()] == ["approve", "reject", "reject"]
    assert who.select(guards.policy_chain().decision).first()[0] == "approve"


def calls(spark, oks, gap=1):
    return spark.createDataFrame([("k", i, ok, i * gap) for i, ok in enumerate(oks)], "key string, seq long, ok boolean, s long").withColumn("ts", F.timestamp_seconds("s"))


def test_breaker(spark):
    got = guards.breaker(calls(spark, [False] * 3 + [True, False], 10), "key", F.col("ok"), "ts", ["seq"], 3, 10.0).orderBy("seq").collect()
    assert [r.is_open for r in got] == [False, False, True, False, False]
    assert all(r.allowed for r in got)  # each comes a whole timeout after the last failure
    got = guards.breaker(calls(spark, [False] * 4), "key", F.col("ok"), "ts", ["seq"], 0, 10.0).orderBy("seq").collect()
    assert [r.allowed for r in got] == [True, False, False, False]


def test_loops(spark):
    def run(nodes, v, a):
        df = spark.createDataFrame([("r", i, n) for i, n in enumerate(nodes)], "run string, seq long, node string")
        return [r.violation for r in guards.loops(df, "run", "node", ["seq"], v, a).orderBy("seq").collect()]

    assert run("XXXX", 3, 10) == [None] * 3 + ["overvisit"]
    assert run("ABABAB", 100, 3) == [None] * 5 + ["alternation"]
    assert run("AABB", 100, 1) == [None, None, "alternation", None]
    with pytest.raises(ValueError):
        run("A", 1, 0)


def test_rate_limits(spark):
    def run(seconds, cap, rate):
        df = spark.createDataFrame([("k", i, s) for i, s in enumerate(seconds)], "key string, seq long, s double").withColumn("ts", F.timestamp_millis((F.col("s") * 1000).cast("long")))
        return guards.rate_limit(df, "key", "ts", ["seq"], cap, rate).orderBy("seq").collect()

    assert run([0.0], 3, 1.0)[0].remaining == 2
    got = run([0.0, 0.0, 0.0], 2, 1.0)
    assert [r.allowed for r in got] == [True, True, False] and got[2].retry_after_ms == 1000
    assert [r.allowed for r in run([0.0, 0.0, 0.005], 1, 1000.0)] == [True, False, True]


def test_escalations_and_audit(spark):
    rows = [(1, 0, "created", None, None, 0), (2, 0, "created", None, None, 0), (2, 1, "approved", "ann", None, 5), (3, 0, "created", None, None, 90), (3, 1, "rejected", "bo", "no", 95), (4, 0, "created", None, None, 95), (5, 1, "approved", "x", None, 1)]
    log = spark.createDataFrame(rows, "id long, seq long, event string, by string, reason string, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.id: r.status for r in guards.escalation_status(log, F.timestamp_seconds(F.lit(100)), 60.0).collect()}
    assert got == {1: "timed_out", 2: "approved", 3: "rejected", 4: "pending"}
    assert [r.seq for r in guards.recent_entries(log.select("seq", "s", "id"), 2, ["s", "id"]).collect()] == [1, 0]


def test_bias(spark):
    counts = lambda *n: spark.createDataFrame([(str(i), v) for i, v in enumerate(n)], "c string, n long")
    assert [guards.bias_uniformity(counts(*n), "n").first().biased for n in ((100, 102, 98), (200, 50, 50))] == [False, True]
    assert guards.bias_uniformity(counts(9), "n").first()[:2] == (0.0, 0)
    rates = lambda a, b: spark.createDataFrame([("A", i < a) for i in range(100)] + [("B", i < b) for i in range(100)], "g string, ok boolean")
    assert [guards.bias_approval(rates(*p), "g", F.col("ok")).first().biased for p in ((90, 30), (50, 48))] == [True, False]
    crit = spark.range(1).select(*(guards.chi2_critical(F.lit(k)) for k in (1, 4))).first()
    assert crit[0] == pytest.approx(3.747985, abs=1e-5) and crit[1] == pytest.approx(9.457846, abs=1e-5)
    seen = spark.createDataFrame([("x", 10.0), ("y", 1.0)], "c string, observed double")
    assert guards.bias_distribution(seen, spark.createDataFrame([("x", 10.0), ("z", 9.0)], "c string, expected double"), "c").first().chi2 == 0.0


# routing


def test_classification(spark):
    texts = ["Why did sales fall, and what was the cause or effect of it?", "zz 9 qq", "Crisis: an urgent emergency, the third outage today", None]
    got = routing.classify(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string"), "text").orderBy("id").collect()
    assert [r.domain for r in got] == ["Complicated", "Disorder", "Chaotic", "Disorder"] and got[1].confidence == 0.0
    assert got[2].confidence == pytest.approx(4 / 6) and len(got[0].all_scores) == 4 and got[0].all_scores[0].domain == "Complicated"
    tie = routing.classify(spark.createDataFrame([("b a",)], "text string"), "text", {"Complex": ["a"], "Clear": ["b"]}).first()
    assert tie.domain == "Clear"


def test_keyword_tables(spark):
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("abé "), rng.integers(1, 5))) for _ in range(400)]
    table = [(["Complex", "Clear", "mine", "zz"][i % 4], w.upper() if i % 3 else w) for i, w in enumerate(words)] + [("Clear", ""), (None, "a"), ("mine", None), ("mine", words[2])]
    texts = [None, "", "É a", *("".join(rng.choice(list("aBé xy"), 30)) for _ in range(25))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, texts[5]])], "id int, text string").selectExpr("*", "1 as place", "'old' as domain", "2 as scored")
    sets = {d: {w.lower() for k, w in table if k == d and w} for d in ("Clear", "Complex", "mine", "zz")}
    want = {}
    for i, t in enumerate([*texts, texts[5]]):
        share = {d: sum(w in (t or "").lower() for w in ws) / len(ws) for d, ws in sets.items()}
        want[i] = sorted(((d, s) for d, s in share.items() if s), key=lambda x: (-x[1], ["Clear", "Complex", "mine", "zz"].index(x[0])))
    for block in (10**6, 37):
        got = routing.classify_by_table(df, "text", spark.createDataFrame(table, "domain string, keyword string"), block).collect()
        assert {r.id: [(s.domain, s.score) for s in r.all_scores] for r in got} == want and all(r.place == 1 and r.scored == 2 for r in got)
        assert all((r.domain, r.confidence) == (want[r.id][0] if want[r.id] else ("Disorder", 0.0)) for r in got)
    none = spark.createDataFrame([], "domain string, keyword string")
    assert {r.domain for r in routing.classify_by_table(df, "text", none).collect()} == {"Disorder"}
    some = {r.id: (r.domain, r.confidence) for r in routing.TableClassifier(spark.createDataFrame([("Clear", "a"), ("Clear", "b"), ("mine", "é")], "domain string, keyword string")).classify(df, "text").collect()}
    assert some[2] == ("mine", 1.0) and some[0] == ("Disorder", 0.0)


def test_routes_and_budget(spark):
    table = routing.route_table(spark, {"Clear": ("u0", "free"), "Chaotic": ("u1", "high")})
    asked = spark.createDataFrame([(1, "Clear", 0.9), (2, "Chaotic", 0.5), (3, "Chaotic", 0.1)], "id int, domain string, confidence double")
    got = {r.id: r for r in routing.route(asked, table).collect()}
    assert got[2].url == "u1" and got[3].url is None and not got[3].confident and got[3].domain == "Chaotic"
    spent = routing.spend(spark.createDataFrame([(i, "medium") for i in range(50)] + [(50, "high")], "id int, tier string"), "tier", ["id"], 2500).orderBy("id").collect()
    assert [r.spent_mills for r in spent] == [50 * (i + 1) for i in range(50)] + [2700]
    assert spent[49].within and not spent[50].within and (spent[50].overage_mills, spent[50].suggested_tier) == (200, "free")
    whole = routing.spend(routing.route(asked, table), "tier", ["id"], 100)
    assert {r.id: r.final_url for r in routing.downgrade(whole, table).collect()} == {1: "u0", 2: "u0", 3: "u0"}


def test_routes_over_the_domains_are_all_kept(spark):
    names = [f"d{i}" for i in range(9)]
    table = routing.route_table(spark, {n: (f"u-{n}", "low") for n in names})
    asked = routing.classify(spark.createDataFrame([(n,) for n in names], "text string"), "text", {n: [n] for n in names})
    assert {(r.text, r.url, r.tier) for r in routing.route(asked, table).collect()} == {(n, f"u-{n}", "low") for n in names}


def test_metrics(spark):
    pairs = [("Clear", "Clear"), ("Clear", "Clear"), ("Clear", "Complex"), ("Complex", "Complex"), ("Complex", "Clear")]
    m = routing.confusion(spark.createDataFrame(pairs, "p string, a string"), "p", "a")
    got = {r.domain: r for r in routing.domain_metrics(m).collect()}
    assert got["Clear"].precision == pytest.approx(2 / 3) and got["Complex"].recall == 0.5 and got["Chaotic"].f1 == 0.0 and got["Clear"].accuracy == 0.6
    wrong = routing.confusion(spark.createDataFrame([("Chaotic", "Clear"), ("Chaotic", "Complex"), ("Complicated", "Clear"), ("Clear", "Clear")], "p string, a string"), "p", "a")
    assert routing.misrouting_cost(wrong).first()[0] == 410


def test_drift(spark):
    table = lambda **n: spark.createDataFrame([(k, v) for k, v in n.items()] or [("Clear", 0)], "domain string, n long")
    same = table(Clear=50, Complicated=30, Chaotic=20)
    assert not routing.drift(same, same, 0.1).first().drifted
    r = routing.drift(table(Chaotic=70, Clear=20, Complicated=10), table(Clear=70, Complicated=20, Complex=10), 0.1).first()
    assert r.drifted and r.kl > 1
    assert routing.drift(table(), same, 0.1).first()[:2] == (0.0, False)


# workflow and sessions


def test_workflow():
    events = []
    flow = Workflow().add_node("add_one", lambda x: x + 1).add_node("double", lambda x: x * 2).set_entry("add_one").add_edge("add_one", "double").add_hook(events.append)
    assert flow.execute(5, 10) == 12 and [e["event"] for e in events] == ["node_started", "node_completed"] * 2 + ["execution_completed"]
    assert flow.resume(Checkpoint.from_json(Checkpoint(6, "double", 1).to_json()), 10) == 12
    for wrong, error in ((lambda: flow.execute(5, 1), TooManySteps), (lambda: flow.resume(Checkpoint(6, "double", 5), 5), TooManySteps), (lambda: Workflow().execute(1, 1), NoEntry), (lambda: Workflow().set_entry("x").execute(1, 1), UnknownNode)):
        with pytest.raises(error):
            wrong()
    ring = Workflow().set_entry("a")
    for a, b in ("ab", "bc", "ca"):
        ring.add_node(a, lambda x: x).add_edge(a, b)
    with pytest.raises(CycleFound) as found:
        ring.execute(0, 9)
    assert found.value.path == ["a", "b", "c", "a"]
    sign = Workflow().add_node("in", lambda x: x).add_node("up", lambda x: x * 10).add_node("down", lambda x: x).set_entry("in").add_conditional_edge("in", lambda x: "up" if x > 0 else "down")
    assert (sign.execute(5, 9), sign.execute(-3, 9)) == (50, -3)
    slow = Workflow().add_node("s", lambda x: time.sleep(0.5)).set_entry("s")
    with pytest.raises(NodeTimedOut):
        slow.execute_with_timeout(1, 5, 0.05)

    def ask(_):
        raise ApprovalNeeded("by a human")

    with pytest.raises(NodeFailed):
        Workflow().add_node("s", ask).set_entry("s").execute(1, 5)


def test_table_workflow(spark):
    x = F.col("x")
    nodes = {"a": TableNode({"x": x + 1}, F.when(x > 5, F.lit("b")).otherwise(F.lit("lost"))), "b": TableNode({"x": x * 2}, F.when(x < 100, F.lit("b")))}
    got = {r.id: r for r in run_table(spark.createDataFrame([(1, 5, "a"), (2, 1, "a"), (3, 60, "b")], "id int, x int, current_node string"), nodes, 4).collect()}
    assert got[2].error == "node_not_found" and got[3][1:] == (120, "b", 1, None)
    assert got[1].error == "max_steps_exceeded" or got[1].x >= 100


def test_sessions(spark):
    df = spark.createDataFrame([(0.95,), (0.85,), (0.6,), (0.3,), (0.0,)], "c double")
    assert [r[0] for r in df.select(confidence_level("c")).collect()] == ["high", "high", "medium", "low", "unknown"]
    steps = spark.createDataFrame([("s", 1, "Clear", 0.9, "approve"), ("s", 2, "Complex", 0.4, "reject"), ("t", 1, "Clear", 0.9, "escalate")], "session string, seq long, domain string, confidence double, decision string")
    got = {r.session: r for r in fold_sessions(steps).collect()}
    assert (got["s"].depth, got["s"].domain, got["s"].level, got["s"].has_rejection, got["s"].requires_human) == (2, "Complex", "low", True, False)
    assert got["t"].requires_human


# tables of any order, nulls and resets


def test_running_total_and_places(spark):
    rows = [(None if i % 10 == 0 else (i * 37) % 101, i) for i in range(400)]
    df = spark.createDataFrame(rows, "o int, id int").repartition(6)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert {r.id: r.position for r in numbered(df, ["o", "id"]).collect()} == {r[1]: k for k, r in enumerate(order)}
    sums = np.cumsum([r[1] for r in order])
    assert {r.id: r.total for r in running_total(df, F.col("id"), ["o", "id"], "total").collect()} == {r[1]: int(x) for r, x in zip(order, sums)}


def test_null_keys_and_orders(spark):
    calls = spark.createDataFrame([(None, i, "2024-01-01") for i in range(6)] + [(9007199254740993, 10 + i, "2024-01-01") for i in range(2)], "k long, id int, ts string")
    got = guards.rate_limit(calls, "k", "ts", ["id"], 2, 0.0).collect()
    assert sum(r.allowed for r in got if r.k is None) == 2 and {r.k for r in got} == {None, 9007199254740993}
    late = guards.rate_limit(spark.createDataFrame([("a", 1, None), ("a", 2, "2024-01-01")], "k string, id int, ts string"), "k", "ts", ["id"], 1, 1.0).orderBy("id").collect()
    assert [r.allowed for r in late] == [True, False]
    spent = routing.spend(spark.createDataFrame([(None, "low"), (2, "low"), (1, "high"), (3, None)], "id int, tier string"), "tier", ["id"], 100).collect()
    assert sorted((r.id or 0, r.spent_mills) for r in spent) == [(0, 10), (1, 210), (2, 220), (3, 220)]
    tools = beliefs.tool_reliability(spark.createDataFrame([(None, True, 1), ("a", False, 2), (None, False, 3), ("a", None, 4)], "t string, ok boolean, at int"), "t", F.col("ok"), ["at"], 0.5)
    assert {r.tool: (r.total_calls, r.recent_failures) for r in tools.collect()} == {None: (2, 1), "a": (2, 2)}
    assert [r.tool for r in beliefs.unreliable(tools, 0.4).collect()] == ["a"]
    known = spark.createDataFrame([("a",), ("new",)], "tool string")
    got = {r.tool: (r.reliability, r.total_calls) for r in beliefs.tool_reliability(spark.createDataFrame([("a", True, 1), ("b", True, 1)], "t string, ok boolean, at int"), "t", F.col("ok"), ["at"], 0.5, registry=known).collect()}
    assert got == {"a": (pytest.approx(2 / 3), 1), "new": (0.5, 0)}


def test_resets(spark):
    rows = [("a", i, "reset" if i == 3 else "call", "2024-01-01") for i in range(7)]
    live = epochs(spark.createDataFrame(rows, "k string, id int, kind string, ts string"), ["k"], ["id"], F.col("kind") == "reset")
    limited = guards.rate_limit(live, ["k", "epoch"], "ts", ["id"], 2, 0.0).orderBy("id").collect()
    assert [(r.id, r.epoch, r.allowed) for r in limited] == [(0, 0, True), (1, 0, True), (2, 0, False), (4, 1, True), (5, 1, True), (6, 1, False)]
    spent = routing.spend(live.withColumn("tier", F.lit("low")), "tier", ["id"], 20, ["k", "epoch"]).orderBy("id").collect()
    assert [r.spent_mills for r in spent] == [10, 20, 30, 10, 20, 30]
    seen = guards.loops(live.withColumn("node", F.lit("n")), ["k", "epoch"], "node", ["id"], 2, 2).orderBy("id").collect()
    assert [r.visits for r in seen] == [1, 2, 3, 1, 2, 3]
    broken = guards.breaker(live, ["k", "epoch"], F.lit(False), "ts", ["id"], 2, 10.0).orderBy("id").collect()
    assert [r.failures for r in broken] == [1, 2, 3, 1, 2, 3]


def test_categorical_tracking(spark):
    rows = [("a", "categorical", [1, 0, 2]), ("a", "categorical", [1, 1]), ("a", "binary", None), ("a", "categorical", [None, 1, 1]), ("b", "binary", None)]
    obs = spark.createDataFrame(rows, "entity string, kind string, counts array<long>")
    got = {r.entity: r for r in beliefs.track(obs, "categorical", prior=[1.0, 2.0, 3.0]).collect()}
    assert got["a"].alphas == [2.0, 2.0, 5.0] and (got["a"].observation_count, got["a"].mismatches) == (3, 1) and got["a"].mean == pytest.approx(2 / 9)
    assert got["b"].alphas == [1.0, 2.0, 3.0] and got["b"].observation_count == 0
    assert got["a"].variance == pytest.approx(2 * 7 / (81 * 10)) and got["a"].lower == 0.0
    with pytest.raises(ValueError):
        beliefs.track(obs, "categorical", prior=[1.0])


def test_policy_texts(spark):
    rows = ['{"role": "admin", "risk": 0.2, "n": 3}', '{"role": "guest", "risk": 0.2, "deep": {"ok": true}}', '{"risk": "high"}', None, "not json", '{"role": "a;b # c"}']
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "id int, c string")
    allow = lambda text: [r[0] for r in df.orderBy("id").select(compile_policy(text, "c")).collect()]
    assert allow('package policy\ndefault allow = false\nallow { input.role == "admin"; input.risk < 0.5 }') == [True, False, False, False, False, False]
    assert allow('allow if { input.deep.ok }\nallow if input.role == "admin"') == [True, True, False, False, False, False]
    assert allow('allow {\n not input.role == "admin" # never\n}') == [False, True, True, True, True, True]
    assert allow('allow { input.role in ["guest", "a;b # c"] }') == [False, True, False, False, False, True]
    assert allow("default allow := true") == [True] * 6 and allow('allow { input["n"] >= 3 }') == [True] + [False] * 5
    told = df.orderBy("id").select(guards.policy_chain(text_policy('allow { input.role == "admin" }', "c")).alias("p")).collect()
    assert told[0].p.decision == "approve" and told[1].p.decision == "reject" and told[1].p.reason
    for bad in ("deny { input.x }", "allow { }", "allow { count(input.x) > 1 }", "allow { input.a == b }", 'allow { "x" }', "allow { true < input.a }", "else"):
        with pytest.raises(PolicyError):
            compile_policy(bad, "c")


def test_policy_values_keep_their_types(spark):
    def allowed(context, condition):
        df = spark.createDataFrame([(context,)], "c string")
        return df.select(compile_policy(f"allow {{ {condition} }}", "c")).first()[0]

    cases = [
        ('{"a": 1}', 'input.a == "1"', False), ('{"a": 1}', "input.a == 1", True), ('{"a": 1}', "input.a == 1.0", True), ('{"a": true}', 'input.a == "true"', False),
        ('{"a": "5"}', "input.a < 40", False), ('{"a": "true"}', "input.a", False), ('{"a": true}', "input.a", True), ('{"a": false}', "input.a", False), ('{"a": 1}', "input.a", False),
        ('{"a": "1"}', "input.a in [1]", False), ('{"a": 1.0}', "input.a in [1]", True), ('{"a": 1}', 'input.a in ["1", true]', False), ('{"a": null}', "input.a in [null]", True),
        ('{"a": "x"}', "input.a != 1", True), ("{}", "input.a != 1", False), ("{}", "not input.a == 1", True), ('{"a": null}', "input.a == null", True), ("{}", "input.a == null", False),
        ('{"a": 9007199254740993}', "input.a == 9007199254740992", False), ('{"a": 9007199254740993}', "input.a > 9007199254740992", True), ('{"a": "b"}', 'input.a > "a"', True),
        ('{"a": 1, "b": "1"}', "input.a == input.b", False), ('{"a": 1, "b": 1.0}', "input.a == input.b", True), ('{"a": 2, "b": 10}', "input.a < input.b", True), ('{"a": "2", "b": 10}', "input.a < input.b", False),
        ('{"a": [1, 2], "b": [1, 2]}', "input.a == input.b", True), ('{"a": {"x": 1}}', "input.a == 1", False), ('{"a": [1]}', "input.a < 2", False), ('{"a b": {"c": 3}}', 'input["a b"].c == 3', True), ('{"a": 1e300}', "input.a > 5", True),
        ("not json", "not input.a", True),
    ]
    assert [(c, t) for c, t, want in cases if allowed(c, t) is not want] == []
    told = spark.createDataFrame([("no json",), (None,), ("[1]",), ('{"a": 1, "a": 2}',)], "c string").select(guards.policy_chain(text_policy("default allow := true", "c")).decision)
    assert [r[0] for r in told.collect()] == ["error", "error", "approve", "error"]
    with pytest.raises(PolicyError):
        compile_policy("allow { input.a < null }", "c")


BIG = 2**53 + 1
KEYS = [("long", [None, BIG, BIG - 1]), ("double", [None, float("nan"), 1.0])]


@pytest.mark.parametrize(("kind", "keys"), KEYS)
def test_every_key_is_kept(spark, kind, keys):
    """Null, NaN and long keys are keys, and helper columns meet no column of the caller's."""
    named = ["_ok", "_range", "_low", "_s", "_a", "_b", "_now", "_n", "good", "island", "range", "own", "before", "lowered", "scored", "swung", "step", "now", "reset", "free", "a", "b", "bad", "n", "s", "chi", "d"]
    rows = [(k, i, "xy"[i % 2], float(i * i % 7), float(i % 3), i % 2 == 0) for k in keys for i in range(8)]
    df = spark.createDataFrame(rows, f"k {kind}, id int, node string, y double, x double, hit boolean").withColumns({c: F.lit("mine") for c in named}).withColumn("ts", F.timestamp_seconds("id"))
    key = lambda v: "NaN" if v != v else v
    want = sorted(map(repr, map(key, keys)))
    held = lambda got, n: (sorted(map(repr, {key(r.k) for r in got})) == want, len(got)) == (True, n)
    own = lambda got: all(r[c] == "mine" for r in got for c in named)

    limited = guards.rate_limit(df, "k", "ts", ["id"], 2, 0.0).collect()
    assert held(limited, 24) and all(sum(r.allowed for r in limited if key(r.k) == key(k)) == 2 for k in keys)
    assert held(effects.ols_adjusted(df.withColumn("t", F.col("hit").cast("double")), "t", "y", ["x"], ["k"]).collect(), 3)
    assert held(effects.two_stage_ls(df, "x", "y", ["id"], ["k"]).collect(), 3)
    assert held(effects.difference_in_means(df.withColumn("t", F.col("hit").cast("double")), "t", "y", ["k"]).collect(), 3)
    broken = guards.breaker(df, "k", F.col("hit"), "ts", ["id"], 1, 1e9).collect()
    assert held(broken, 24) and own(broken)
    looped = guards.loops(df, "k", "node", ["id"], 3, 2).collect()
    assert held(looped, 24) and own(looped) and sum(r.violation == "alternation" for r in looped) == 9
    history = guards.visit_history(df, "k", "node", ["id"], 1).collect()
    assert held(history, 3) and all(r.history == ["x", "y", "x", "y"] and r.total == 8 for r in history)
    counts = df.groupBy("k", "node").agg(F.count("*").alias("n"))
    assert held(guards.bias_uniformity(counts, "n", ["k"]).collect(), 3)
    equal = guards.bias_distribution(df.groupBy("k").agg(F.count("*").alias("observed")), df.groupBy("k").agg(F.count("*").cast("double").alias("expected")), "k").first()
    assert equal.chi2 == 0.0 and not equal.biased and equal.df == 2
    drifts = routing.drift(df.select("k", F.when(F.col("id") < 6, "Clear").otherwise("Complex").alias("domain"), F.lit(1).alias("n")), df.select("k", F.when(F.col("id") < 2, "Clear").otherwise("Complex").alias("domain"), F.lit(1).alias("n")), 0.1, ["k"]).collect()
    assert held(drifts, 3) and len({r.kl for r in drifts}) == 1 and all(r.drifted for r in drifts)
    spent = routing.spend(df.withColumn("tier", F.lit("low")), "tier", ["id"], 30, ["k"]).collect()
    assert held(spent, 24) and own(spent) and sum(r.within for r in spent) == 9
    whole = routing.spend(df.withColumn("tier", F.lit("low")), "tier", ["k", "id"], 30).collect()
    assert held(whole, 24) and own(whole) and max(r.spent_mills for r in whole) == 240
    running = beliefs.running_beta(df, F.col("hit"), "k", ["id"], 0.1).collect()
    assert held(running, 24) and own(running)
    assert own(epochs(df, ["k"], ["id"], F.col("id") == 2).collect()) and own(routing.classify(df, "node").collect())
    log = df.select(F.col("k").alias("id"), F.col("id").alias("seq"), F.when(F.col("id") == 0, "created").otherwise("approved").alias("event"), F.lit("me").alias("by"), F.lit(None).cast("string").alias("reason"), "ts")
    status = guards.escalation_status(log, F.current_timestamp(), 1.0).withColumnRenamed("id", "k").collect()
    assert held(status, 3) and {r.status for r in status} == {"approved"}


def test_null_outcomes_and_doubled_routes(spark):
    got = guards.breaker(calls(spark, [None, None, True, None]), "key", F.col("ok"), "ts", ["seq"], 2, 100.0).orderBy("seq").collect()
    assert [(r.failures, r.is_open, r.allowed) for r in got] == [(1, False, True), (2, True, True), (0, False, False), (1, False, True)]
    routes = spark.createDataFrame([("Clear", "b", 1, "low"), ("Clear", "a", 1, "high"), (None, "x", 1, "low")], "target_domain string, url string, timeout_ms int, tier string")
    asked = spark.createDataFrame([(1, "what is this, define it"), (2, None)], "id int, text string")
    assert [(r.id, r.url) for r in routing.route(routing.classify(asked, "text"), routes).orderBy("id").collect()] == [(1, "a"), (2, None)]
    nodes = spark.createDataFrame([("r", i, n) for i, n in enumerate([None, "A", None, "A"])], "run string, seq long, node string")
    assert [r.violation for r in guards.loops(nodes, "run", "node", ["seq"], 9, 2).orderBy("seq").collect()] == [None] * 3 + ["alternation"]


def test_metrics_and_drift_with_other_domains(spark):
    m = spark.createDataFrame([("Clear", "Own", 3), ("Own", "Own", 1)], "predicted string, actual string, n long")
    got = {r.domain: r for r in routing.domain_metrics(m).collect()}
    assert set(got) == {*routing.DOMAINS, "Own"} and got["Own"].recall == 0.25 and got["Own"].precision == 1.0 and got["Chaotic"].total == 4
    assert {r.total for r in routing.domain_metrics(m.limit(0)).collect()} == {None}
    now, then = (spark.createDataFrame([("x", a), ("y", b)], "domain string, n long") for a, b in ((1, 3), (3, 1)))
    assert routing.drift(now, then, 0.1, domains=("x", "y")).first().kl == pytest.approx(0.25 * np.log(1 / 3) + 0.75 * np.log(3))

    class Fixed:
        def classify(self, df, text):
            return df.withColumns({"domain": F.lit("Own"), "confidence": F.lit(1.0), "all_scores": F.array()})

    table = routing.route_table(spark, {"Own": ("u", "high"), "Clear": ("c", "free")})
    asked = spark.createDataFrame([(1, "what is this? define it"), (2, "zz")], "id int, text string")
    assert {r.url for r in routing.Router(table, Fixed()).route(asked, "text").collect()} == {"u"}
    kept = routing.Router(table).route_with_budget(asked, "text", ["id"], 0).orderBy("id").collect()
    assert [(r.domain, r.final_url) for r in kept] == [("Clear", "c"), ("Disorder", None)]


def test_edge_tables_agree_with_graphs(spark):
    rng = np.random.default_rng(4)
    names = [f"v{i}" for i in range(8)]
    pairs = [(names[i], names[j]) for i in range(8) for j in range(i + 1, 8) if rng.random() < 0.3]
    graph = CausalGraph(pairs, names)
    edges = spark.createDataFrame([*pairs, (None, "v1"), pairs[0]], "src string, dst string")
    seen = {v for p in pairs for v in p}
    asked = [(q, *rng.choice(names, 2).tolist(), rng.choice(names, rng.integers(0, 3), replace=False).tolist()) for q in range(40)] + [(90, "v0", "gone", []), (91, "v2", "v2", [])]
    questions = spark.createDataFrame([a[:3] for a in asked], "question int, x string, y string")
    given_ = spark.createDataFrame([(a[0], z) for a in asked for z in [*a[3], "unknown"]], "question int, node string")
    got = {r.question: r.separated for r in separated(edges, questions, given_).collect()}
    assert got == {q: not {x, y} <= seen or graph.d_separated(x, y, z) for q, x, y, z in asked}
    sets = {(r.question, r.node) for r in adjustment_sets(edges, questions).collect()}
    assert sets == {(q, v) for q, x, y, _ in asked for v in graph.backdoor(x, x) or ()}
    seeds = spark.createDataFrame([("v0",), ("v5",), (None,)], "node string")
    below = {(r.seed, r.node) for r in closure(edges, seeds).collect()}
    assert below == {(s, n) for s in ("v0", "v5") for n in graph.descendants(s) | {s}}
    above = {(r.seed, r.node) for r in closure(edges, seeds, above=True).collect()}
    assert above == {(s, n) for s in ("v0", "v5") for n in graph.ancestors([s])}


def test_hooks_and_engines(spark, caplog):
    flow, seen = Workflow(), workflow.EventCollector()
    flow.add_node("a", lambda s: s + 1).add_node("b", lambda s: 1 // 0).set_entry("a").add_conditional_edge("a", lambda s: "b").add_hook(seen).add_hook(workflow.TracingHook())
    with caplog.at_level("DEBUG", "plumbline.workflow"), pytest.raises(NodeFailed):
        flow.execute(1, 5)
    assert [e["event"] for e in seen.events] == ["node_started", "node_completed", "route_decision", "node_started", "node_failed"]
    assert [r.event for r in seen.frame(spark).orderBy("ord").collect()] == [e["event"] for e in seen.events]
    assert [r.levelname for r in caplog.records].count("WARNING") == 1

    class Engine:
        def __init__(self, domain):
            self.domain = domain

        def analyze(self, requests):
            return requests.withColumn("by", F.lit(self.domain))

    asked = spark.createDataFrame([(1, "Clear"), (2, "Complex"), (3, "Chaotic")], "id int, domain string")
    assert {(r.id, r.by) for r in workflow.dispatch(asked, [Engine("Clear"), Engine("Complex")]).collect()} == {(1, "Clear"), (2, "Complex")}


def test_long_table_workflow(spark):
    x = F.col("x")
    nodes = {"count": TableNode({"x": x - 1}, F.when(x > 0, F.lit("count")))}
    states = spark.createDataFrame([(i, i, "count") for i in (0, 3, 50)], "id int, x int, current_node string")
    got = {r.id: (r.x, r.steps, r.error) for r in run_table(states, nodes, 1000).collect()}
    assert got == {0: (-1, 1, None), 3: (0, 3, None), 50: (0, 50, None)}


def test_table_workflow_goes_on_after_a_crash(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(workflow, "STEPS_A_WRITE", 3)
    states = spark.createDataFrame([(i, i, "a") for i in range(6)], "id int, x int, current_node string")
    x = F.col("x")
    good = {"a": TableNode({"x": x + 1}, F.when(x < 20, F.lit("a")).otherwise("b")), "b": TableNode({"x": x * 2}, F.lit(None).cast("string"))}
    bad = good | {"a": TableNode({"x": F.when(x == 12, F.raise_error(F.lit("crash")).cast("int")).otherwise(x + 1)}, good["a"].target)}
    want = sorted(map(tuple, run_table(states, good, 30).collect()))
    place = f"file://{tmp_path}/run"
    with pytest.raises(Exception, match="crash"):
        run_table(states, bad, 30, place).collect()
    saved = [int(p.name) for p in (tmp_path / "run" / "manifest").iterdir() if p.name.isdigit()]
    assert saved == [6] and (tmp_path / "run" / "states" / "6").exists()
    (tmp_path / "run" / "states" / "9").mkdir(exist_ok=True)  # states of a step that was not committed
    gone = spark.createDataFrame([], states.schema)  # what has been done is not done again
    assert sorted(map(tuple, run_table(gone, good, 30, place).collect())) == want
    short = sorted(map(tuple, run_table(states, good, 8).collect()))
    again = f"file://{tmp_path}/short"
    run_table(states, good, 7, again).collect()
    got = sorted(map(tuple, run_table(gone, good, 8, again).collect()))
    assert got == short and {r[-1] for r in got} == {"max_steps_exceeded"}


def test_a_node_that_takes_too_long_is_cancelled(spark):
    def slow(state):
        spark.range(0, 40, 1, 4).select(F.udf(lambda x: time.sleep(1) or x, "long")("id")).write.format("noop").mode("overwrite").save()

    flow = workflow.Workflow()
    flow.add_node("slow", slow)
    flow.set_entry("slow")
    with pytest.raises(workflow.NodeTimedOut):
        flow.execute_with_timeout({}, 3, 2.0)
    began = time.time()
    while spark.sparkContext.statusTracker().getActiveJobsIds() and time.time() - began < 15:
        time.sleep(0.2)
    assert not spark.sparkContext.statusTracker().getActiveJobsIds()


def test_session_logs(spark):
    steps = spark.createDataFrame([("s", 2, "Clear", 0.9, None, "b"), ("s", 1, "Complex", 0.4, "approve", "a"), ("u", 1, "Clear", 0.2, None, None)], "session string, seq int, domain string, confidence double, decision string, reasoning string")
    assert [(r.session, r.log) for r in reasoning_log(steps).collect()] == [("s", ["a", "b"])]
    changes = spark.createDataFrame([("s", 9, "Disorder", 0.1)], "session string, seq int, domain string, confidence double")
    got = {r.session: r for r in fold_sessions(reclassify(steps, changes)).collect()}
    assert (got["s"].domain, got["s"].depth, got["s"].requires_human) == ("Disorder", 3, True) and got["u"].domain == "Clear"


def test_new_audit_entries(spark):
    got = guards.new_entries(spark.range(3), "guard", F.lit("act"), F.lit("approve")).collect()
    assert len({r.id for r in got}) == 3 and all(r.timestamp and r.metadata is None for r in got)


def test_intermediate_tables_go(spark):
    before = set(scratch._live)
    one, two = scratch.materialize(spark.range(5)), scratch.materialize(spark.range(7))
    scratch.release(one.where("id > 2"), two, keep=[two])
    assert len(set(scratch._live) - before) == 1 and two.count() == 7
    scratch.release(two)
    assert set(scratch._live) == before
