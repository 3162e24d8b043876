"""Registered queries of the decision operators over the driver's tables."""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import confidence_level, fold_sessions, reasoning_log, reclassify
from plumbline.functions.order import epochs
from plumbline.operators import beliefs, effects, guards, refuters, routing
from plumbline.operators.graphs import CausalGraph, adjustment_sets, closure, cycles, degrees, front_door_sets, levels, paths_avoiding, reachable, separated, verified_adjustment
from plumbline.operators.policy_text import text_policy
from plumbline.oracles import SQL
from plumbline.plans.study import Study
from plumbline.plans.workflow import TableNode, run_table
from plumbline.sources import read_table

ROUTES = {"Clear": ("http://clear", "free"), "Complicated": ("http://complicated", "low"), "Complex": ("http://complex", "medium"), "Chaotic": ("http://chaotic", "high")}
#: Texts in the words of the default keywords, made from the event type; ``classify_documents`` reads the tables' own texts.
TEXTS = {"click": "What is this? Define it, look up how many", "view": "Why did the impact cause this effect", "purchase": "uncertain: explore what if", "signup": "Emergency! outage now", "error": "nothing of note"}


def _lineitem(spark, d) -> DataFrame:
    t = read_table(spark, d, "lineitem")
    y = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return t.select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_extendedprice", (F.col("l_discount") > 0.05).cast("double").alias("t"), y.alias("y"))


def _events(spark, d) -> DataFrame:
    return read_table(spark, d, "events")


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


def diff_in_means(spark, d):
    return _rounded(effects.difference_in_means(_lineitem(spark, d), "t", "y", ["l_returnflag"]), 4)


def ols_adjusted(spark, d):
    return _rounded(effects.ols_adjusted(_lineitem(spark, d), "t", "y", ["l_quantity"], ["l_returnflag"]), 3)


def iv_2sls(spark, d):
    return _rounded(effects.two_stage_ls(_lineitem(spark, d), "l_extendedprice", "y", ["l_quantity"], ["l_returnflag"]), 6)


def ipw_effect(spark, d):
    scaled = _lineitem(spark, d).withColumn("x", (F.col("l_quantity") - 25.5) / 25)
    return _rounded(effects.ipw(scaled, "t", "y", ["x"]), 2)


def counterfactual_units(spark, d):
    got = effects.counterfactual_from_data(_lineitem(spark, d), "t", "y", 0.0, ["l_returnflag"])
    return _rounded(got.select("l_orderkey", "l_linenumber", "cf_outcome", "cf_se", "lower", "upper"), 4)


def _refuted(spark, d, test):
    df = _lineitem(spark, d).withColumn("unit", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    ate = effects.difference_in_means(df, "t", "y").first()["ate"]
    return _rounded(test(df, ate), 3)


def placebo_refute(spark, d):
    return _refuted(spark, d, lambda df, ate: refuters.placebo(df, "y", ate, "unit", 1000.0))


def subset_refute(spark, d):
    return _refuted(spark, d, lambda df, ate: refuters.subset_validation(df, "t", "y", ate, "unit"))


def bootstrap_refute(spark, d):
    return _refuted(spark, d, lambda df, ate: refuters.bootstrap(df, "t", "y", ate, "unit"))


def random_common_cause_refute(spark, d):
    return _refuted(spark, d, lambda df, ate: refuters.random_common_cause(df, "t", "y", ate, "unit"))


def _refuted_in_order(spark, d, test):
    df = _lineitem(spark, d)
    ate = effects.difference_in_means(df, "t", "y").first()["ate"]
    return _rounded(test(df, ate, ["l_orderkey", "l_linenumber", "l_extendedprice", "y", "t"]), 3)


def placebo_sequential(spark, d):
    return _refuted_in_order(spark, d, lambda df, ate, order: refuters.placebo_sequential(df, "y", ate, order, 1000.0))


def common_cause_sequential(spark, d):
    return _refuted_in_order(spark, d, lambda df, ate, order: refuters.random_common_cause_sequential(df, "t", "y", ate, order))


def bootstrap_sequential(spark, d):
    return _refuted_in_order(spark, d, lambda df, ate, order: refuters.bootstrap_sequential(df, "t", "y", ate, order))


def subset_sequential(spark, d):
    return _refuted_in_order(spark, d, lambda df, ate, order: refuters.subset_sequential(df, "t", "y", ate, order))


def study_estimate(spark, d):
    df = _lineitem(spark, d)
    graph = CausalGraph([("l_quantity", "t"), ("l_quantity", "y"), ("t", "y")])
    return _rounded(Study(df, graph, "t", "y").estimate(("l_returnflag",)), 3)


def _links(spark, d) -> DataFrame:
    """Regions over nations over customers and suppliers, customers over their orders and market segments."""
    node = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    pairs = [("nation", "r", "n_regionkey", "n", "n_nationkey"), ("customer", "n", "c_nationkey", "c", "c_custkey"), ("supplier", "n", "s_nationkey", "s", "s_suppkey"), ("customer", "c", "c_custkey", "m", "c_mktsegment"), ("orders", "c", "o_custkey", "o", "o_orderkey")]
    tables = [read_table(spark, d, t).select(node(a, x).alias("src"), node(b, y).alias("dst")) for t, a, x, b, y in pairs]
    return functools.reduce(lambda p, q: p.unionByName(q), tables)


def graph_reachable(spark, d):
    """All below the first two regions, with their distance."""
    return reachable(_links(spark, d), spark.createDataFrame([("r0",), ("r1",)], "node string"))


def graph_ancestors(spark, d):
    """All above each order."""
    orders = read_table(spark, d, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("node"))
    return closure(_links(spark, d), orders, above=True)


def graph_adjustment(spark, d):
    """What to adjust for with each order and market segment as the treatment, where a segment also leads to a region."""
    links = _links(spark, d)
    back = links.where("dst like 'm%'").select(F.col("dst").alias("src"), F.lit("r0").alias("dst")).distinct()
    asked = links.where("dst like 'o%' or dst like 'm%'").select(F.col("dst").alias("question"), F.col("dst").alias("x")).distinct()
    return adjustment_sets(links.unionByName(back), asked)


def graph_separated(spark, d):
    """Each supplier and the customer of the same number: given nothing, its nation, the customer's segment, or both.

    Orders lead nowhere and are in no given set, so their edges cannot open or close a path; a
    question's walk would only visit those of a whole nation.
    """
    both = read_table(spark, d, "supplier").join(read_table(spark, d, "customer"), F.col("s_suppkey") == F.col("c_custkey"))
    text = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    asked = both.select(F.col("s_suppkey").alias("question"), text("s", "s_suppkey").alias("x"), text("c", "c_custkey").alias("y"), text("n", "s_nationkey").alias("nation"), text("m", "c_mktsegment").alias("segment"))
    given = asked.where("question % 4 in (1, 3)").select("question", F.col("nation").alias("node")).unionByName(asked.where("question % 4 >= 2").select("question", F.col("segment").alias("node")))
    return separated(_links(spark, d).where("dst not like 'o%'"), asked, given)


def _circular(spark, d) -> DataFrame:
    """The links, and each market segment leading back to a region by the length of its name."""
    back = read_table(spark, d, "customer").select(F.concat(F.lit("m"), "c_mktsegment").alias("src"), F.concat(F.lit("r"), (F.length("c_mktsegment") % 5).cast("string")).alias("dst")).distinct()
    return _links(spark, d).unionByName(back)


def _supplied(spark, d) -> DataFrame:
    """The links, and every third supplier leading to the customer of its number."""
    more = read_table(spark, d, "supplier").where("s_suppkey % 3 = 0").select(F.concat(F.lit("s"), "s_suppkey").alias("src"), F.concat(F.lit("c"), "s_suppkey").alias("dst"))
    return _links(spark, d).unionByName(more)


def graph_levels(spark, d):
    return levels(_links(spark, d))


def graph_levels_circular(spark, d):
    """Without level: the regions that segments lead back to, and all below."""
    return levels(_circular(spark, d))


def graph_cycles(spark, d):
    return cycles(_circular(spark, d))


def graph_avoiding(spark, d):
    """From the nation of each order's customer to the order, round the customer or round a supplier of its number."""
    both = read_table(spark, d, "orders").join(read_table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    text = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    asked = both.select(F.col("o_orderkey").alias("question"), text("n", "c_nationkey").alias("x"), text("o", "o_orderkey").alias("y"), F.when(F.col("o_orderkey") % 3 == 0, text("s", "c_custkey")).when(F.col("o_orderkey") % 3 == 1, text("c", "c_custkey")).alias("node"))
    # suppliers lead to the customers of their number and nations no longer do where one does
    edges = _supplied(spark, d)
    fed = edges.where("src like 's%'").select("dst")
    return paths_avoiding(edges.where("src not like 'n%'").unionByName(edges.where("src like 'n%'").join(fed, "dst", "left_anti").select("src", "dst")), asked, asked.select("question", "node"))


def dag_parents(spark, d):
    """How many causes and effects each node has, its cause if there is one only, and whether the whole graph is acyclic."""
    acyclic = graph_levels(spark, d).agg(F.every(F.col("level").isNotNull()).alias("acyclic"))
    return degrees(_supplied(spark, d)).crossJoin(F.broadcast(acyclic))


def dag_closure(spark, d):
    """Each supplier and customer with all below."""
    edges = _supplied(spark, d)
    return closure(edges, edges.where("dst like 's%' or dst like 'c%'").select(F.col("dst").alias("node")).distinct())


def backdoor_set(spark, d):
    """Whether the parents of each supplier and segment block its back-door paths to a nation, a segment or a region, where segments lead back to region 0."""
    links = _links(spark, d)
    back = links.where("dst like 'm%'").select(F.col("dst").alias("src"), F.lit("r0").alias("dst")).distinct()
    both = read_table(spark, d, "supplier").join(read_table(spark, d, "customer"), F.col("s_suppkey") == F.col("c_custkey"))
    text = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    pairs = both.select(text("s", "s_suppkey").alias("x"), F.explode(F.array(text("n", "s_nationkey"), text("m", "c_mktsegment"))).alias("y"))
    regions = read_table(spark, d, "region").select(text("r", "r_regionkey").alias("y"))
    wide = back.select(F.col("src").alias("x")).crossJoin(F.broadcast(regions))  # five segments, five regions
    asked = pairs.unionByName(wide).withColumn("question", F.concat_ws(">", "x", "y"))
    return verified_adjustment(links.unionByName(back), asked).select("x", "y", "verified")


def frontdoor_sets(spark, d):
    """Mediators between nations and their orders, nations and segments, regions and orders, where some customers have a supplier as a second cause."""
    n = read_table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    c = read_table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    o = read_table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    text = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    asks = [o.select(text("n", "c_nationkey").alias("x"), text("o", "o_orderkey").alias("y")), c.select(text("n", "c_nationkey").alias("x"), text("m", "c_mktsegment").alias("y")), o.select(text("r", "n_regionkey").alias("x"), text("o", "o_orderkey").alias("y")), o.select(text("c", "c_custkey").alias("x"), text("o", "o_orderkey").alias("y"))]
    asked = functools.reduce(lambda p, q: p.unionByName(q), asks).distinct().withColumn("question", F.concat_ws(">", "x", "y"))
    return front_door_sets(_supplied(spark, d), asked)


def dsep_table(spark, d):
    """Each supplier and the segment of the customer of its number, where segments lead to customers: given nothing, or that customer, at which both ways meet."""
    both = read_table(spark, d, "supplier").join(read_table(spark, d, "customer"), F.col("s_suppkey") == F.col("c_custkey"))
    text = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    links = _links(spark, d).where("dst not like 'o%'")
    turned = links.where("dst not like 'm%'").unionByName(links.where("dst like 'm%'").select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    asked = both.select(F.col("s_suppkey").alias("question"), text("s", "s_suppkey").alias("x"), text("m", "c_mktsegment").alias("y"), text("c", "c_custkey").alias("node"))
    return separated(turned, asked, asked.where("question % 2 = 1").select("question", "node"))


def _ok():
    return F.col("event_type") != "error"


def beta_posterior(spark, d):
    return _rounded(beliefs.beta_posterior(_events(spark, d), _ok().cast("int"), (~_ok()).cast("int"), ["user_id"]), 9)


def normal_posterior(spark, d):
    return _rounded(beliefs.normal_posterior(_events(spark, d), "value", ["user_id"], 0.0, 100.0, 25.0), 6)


def gamma_posterior(spark, d):
    days = _events(spark, d).groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return _rounded(beliefs.gamma_posterior(days, "n", ["user_id"]), 9)


def dirichlet_posterior(spark, d):
    return _rounded(beliefs.dirichlet_posterior(_events(spark, d), "event_type", ["user_id"], ["click", "error", "purchase", "signup", "view"]), 9)


def belief_running(spark, d):
    got = beliefs.running_beta(_events(spark, d), _ok(), "user_id", ["ts", "event_id"], 0.005)
    return _rounded(got.select("event_id", "running_mean", "running_variance", "confident"), 9)


def belief_tracked(spark, d):
    obs = _events(spark, d).select(F.col("user_id").cast("string").alias("entity"), F.when(F.col("event_id") % 10 == 0, F.lit("continuous")).otherwise("binary").alias("kind"), _ok().cast("long").alias("successes"), (~_ok()).cast("long").alias("failures"))
    got = beliefs.track(obs, "binary", 1.0, 1.0)
    return _rounded(got.select("entity", "p1", "p2", "mean", "observation_count", "mismatches"), 9)


def belief_categorical(spark, d):
    """A count vector an event: three kinds, purchases ten at a time; one in seven has the wrong length."""
    kinds = ["click", "purchase", "view"]
    counts = F.array(*(F.when(F.col("event_type") == k, F.lit(10 if k == "purchase" else 1)).otherwise(0).cast("long") for k in kinds))
    obs = _events(spark, d).select(F.col("user_id").cast("string").alias("entity"), F.when(F.col("event_type") == "error", F.lit("binary")).otherwise("categorical").alias("kind"), F.when(F.col("event_id") % 7 == 0, F.slice(counts, 1, 2)).otherwise(counts).alias("counts"))
    got = beliefs.track(obs, "categorical", prior=[1.0, 2.0, 0.5])
    return _rounded(got.select("entity", "p1", "p2", "mean", "variance", "lower", "upper", "observation_count", "mismatches", F.get("alphas", F.lit(1)).alias("alpha_purchase"), F.get("alphas", F.lit(2)).alias("alpha_view")), 9)


def belief_batch(spark, d):
    obs = _events(spark, d).select(F.col("user_id").cast("string").alias("entity"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", F.lit("continuous")).otherwise("binary").alias("kind"))
    return beliefs.before_first_mismatch(obs, "binary").groupBy("entity").agg(F.count("*").alias("applied"))


def tool_reliability(spark, d):
    return _rounded(beliefs.tool_reliability(_events(spark, d), "user_id", _ok(), ["ts", "event_id"], 0.8).withColumnRenamed("tool", "user_id"), 9)


def most_reliable_tool(spark, d):
    return beliefs.most_reliable(beliefs.tool_reliability(_events(spark, d), "user_id", _ok(), ["ts", "event_id"], 0.8))


def unreliable_tools(spark, d):
    return beliefs.unreliable(beliefs.tool_reliability(_events(spark, d), "user_id", _ok(), ["ts", "event_id"], 0.8), 0.8).select("tool", F.round("reliability", 9).alias("reliability"))


def registered_tools(spark, d):
    """Customers as the registry: some have no calls, some callers are not registered."""
    registry = read_table(spark, d, "customer").select(F.col("c_custkey").alias("tool"))
    got = beliefs.tool_reliability(_events(spark, d), "user_id", _ok(), ["ts", "event_id"], 0.8, registry=registry)
    return _rounded(got.select("tool", "reliability", "total_calls", "recent_failures"), 9)


def _normal_log_density(x, row):
    """Of (mean, log deviation) with flat priors, from a group's n, mean m and population variance v."""
    return -row["n"] * x[1] - row["n"] * (row["v"] + (row["m"] - x[0]) ** 2) / (2 * np.exp(2 * x[1]))


def mcmc_normal(spark, d):
    """Sampled posteriors of each event type's values, and whether they agree with the known ones within a standard deviation of these."""
    groups = _events(spark, d).groupBy("event_type").agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    got = beliefs.posterior_summaries(groups, ["event_type"], _normal_log_density, lambda r: [r["m"], 0.5 * np.log(r["v"])], 2000, 500)
    per = got.groupBy("event_type").agg(F.avg(F.when(F.col("dim") == 0, F.col("mean"))).alias("a"), F.avg(F.when(F.col("dim") == 1, F.col("mean"))).alias("b"), F.count_distinct("chain").alias("chains"), F.min("acceptance_rate").alias("rate"))
    sd = F.sqrt(F.col("v") / F.col("n"))
    return per.join(groups, "event_type").select("event_type", "n", "chains", (F.abs(F.col("a") - F.col("m")) < sd).alias("mean_agrees"), (F.abs(F.col("b") - F.log("v") / 2) < 1 / F.sqrt(2 * F.col("n"))).alias("deviation_agrees"), ((F.col("rate") > 0.25) & (F.col("rate") < 0.55)).alias("rate_near_target"))


def _risk():
    return guards.risk_of("props", "k") / 100


def policy_decisions(spark, d):
    chain = guards.policy_chain(guards.rule_policy(F.col("event_type") != "error", "errors are denied"), guards.risk_policy(_risk(), 0.5, 0.8))
    return _events(spark, d).withColumn("p", chain).select("event_id", "p.decision", "p.reason", "p.target")


POLICY = """
package policy
default allow := false

# reading is free, the rest needs a low risk and a known kind
allow if { input.kind == "view" }
allow {
    input.kind in ["click", "signup"]
    not input.k > 60
}
allow { input.kind == "purchase"; input.k < 40; input["k"] != 7 }
"""


def policy_text(spark, d):
    context = F.to_json(F.struct(F.col("event_type").alias("kind"), F.get_json_object("props", "$.k").cast("int").alias("k")))
    return _events(spark, d).withColumn("p", guards.policy_chain(text_policy(POLICY, context))).select("event_id", "p.decision", "p.reason")


def _contexts(spark, d) -> DataFrame:
    """Events with a context whose k is a number, a string, missing, null, a fraction or a boolean, and whose live has any type; some are no JSON."""
    k, by = F.get_json_object("props", "$.k"), lambda n: F.col("event_id") % n
    pick = lambda n, texts: F.element_at(F.array(*texts), (by(n) + 1).cast("int"))
    kinds = pick(6, [F.concat(F.lit(', "k": '), k), F.concat(F.lit(', "k": "'), k, F.lit('"')), F.lit(""), F.lit(', "k": null'), F.concat(F.lit(', "k": '), k, F.lit(".5")), F.lit(', "k": true')])
    live = pick(4, [F.lit(t) for t in (', "live": true', ', "live": "true"', ', "live": 1', "")])
    return _events(spark, d).withColumn("context", F.when(by(31) == 5, F.lit("not json")).otherwise(F.concat(F.lit('{"kind": "'), "event_type", F.lit('"'), kinds, live, F.lit("}"))))


TYPED_POLICY = """
package policy
default allow := false

allow { input.live; input.kind in ["view", "click"] }
allow { input.k < 20 }
allow { input.k == "7" }
allow { input.kind == "purchase"; input.k != 50 }
allow { input.kind == "signup"; not input.k >= 30 }
allow { input.kind == "error"; input.k in [1, 2.5, "3", true, null] }
allow { input.k == input.live }
"""


def policy_typed(spark, d):
    return _contexts(spark, d).withColumn("p", guards.policy_chain(text_policy(TYPED_POLICY, "context"))).select("event_id", "p.decision", "p.reason")


def risk_decisions(spark, d):
    """A rejection before an error stands; an error is a decision of its own, and no row goes."""
    chain = guards.policy_chain(guards.rule_policy(F.col("event_type") != "error", "errors are denied"), guards.risk_policy(guards.risk_of("context", "k"), 50, 80, field="k"), guards.rule_policy(F.col("value") < 100, "dear"))
    return _contexts(spark, d).withColumn("p", chain).select("event_id", "p.decision", "p.reason", "p.target")


def breaker_states(spark, d):
    return guards.breaker(_events(spark, d), "user_id", _ok(), "ts", ["ts", "event_id"], 2, 43_200.0).select("event_id", "failures", "is_open", "allowed")


def loop_checks(spark, d):
    days = _events(spark, d)
    return guards.loops(days, "user_id", "event_type", ["ts", "event_id"], 15, 2).select("event_id", "visits", "violation", "observed")


def visit_history(spark, d):
    got = guards.visit_history(_events(spark, d), "user_id", "event_type", ["ts", "event_id"], 2)
    return got.select("user_id", F.array_join("history", ",").alias("history"), "total")


def rate_limits(spark, d):
    return guards.rate_limit(_events(spark, d), "user_id", "ts", ["ts", "event_id"], 3, 0.00002).select("event_id", "allowed", "remaining")


def rate_limits_peek(spark, d):
    """As ``rate_limits``, but views only look."""
    return guards.rate_limit(_events(spark, d), "user_id", "ts", ["ts", "event_id"], 3, 0.00002, F.col("event_type") != "view").select("event_id", "allowed", "remaining")


def rate_limits_reset(spark, d):
    """As ``rate_limits``, but a signup resets its user's bucket."""
    live = epochs(_events(spark, d), ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup")
    return guards.rate_limit(live, ["user_id", "epoch"], "ts", ["ts", "event_id"], 3, 0.00002).select("event_id", "epoch", "allowed", "remaining")


def escalation_status(spark, d):
    o = read_table(spark, d, "orders")
    made = o.select(F.col("o_orderkey").alias("id"), F.lit(0).alias("seq"), F.lit("created").alias("event"), F.lit(None).cast("string").alias("by"), F.lit(None).cast("string").alias("reason"), F.col("o_orderdate").alias("ts"))
    done = o.where("o_orderstatus <> 'O'").select(F.col("o_orderkey").alias("id"), F.lit(1).alias("seq"), F.when(F.col("o_orderstatus") == "F", "approved").otherwise("rejected").alias("event"), F.col("o_orderpriority").alias("by"), F.lit("checked").alias("reason"), F.col("o_orderdate").alias("ts"))
    return guards.escalation_status(made.unionByName(done), F.lit("1998-06-01").cast("timestamp"), 86400.0 * 365).select("id", "status", "by")


def audit_recent(spark, d):
    e = _events(spark, d)
    entries = guards.audit_entries(e.withColumn("key", F.col("event_id")), "guard", "event_id", "ts", F.col("event_type"), guards.policy_chain(guards.risk_policy(_risk(), 0.5, 0.8))["decision"])
    return guards.recent_entries(entries, 20, ["timestamp", "id"]).select("id", "timestamp", "action", "decision")


def bias_uniformity(spark, d):
    counts = _events(spark, d).groupBy("event_type").agg(F.count("*").alias("n"))
    return _rounded(guards.bias_uniformity(counts, "n"), 6)


def bias_keyed(spark, d):
    """Event types of each of five groups of users, one of them null."""
    counts = _events(spark, d).groupBy(F.nullif(F.col("user_id") % 5, F.lit(0)).alias("team"), "event_type").agg(F.count("*").alias("n"))
    return _rounded(guards.bias_uniformity(counts, "n", ["team"]), 6)


def bias_distribution(spark, d):
    """Event types of the month's second half against the first half's counts, errors without expectation."""
    counted = _events(spark, d).groupBy("event_type").agg(F.count(F.when(F.dayofmonth("ts") > 15, 1)).alias("observed"), F.count(F.when(F.dayofmonth("ts") <= 15, 1)).cast("double").alias("expected"))
    return _rounded(guards.bias_distribution(counted.select("event_type", "observed"), counted.where("event_type <> 'error'").select("event_type", "expected"), "event_type"), 6)


def bias_approval(spark, d):
    o, c = read_table(spark, d, "orders"), read_table(spark, d, "customer")
    joined = o.join(c, o.o_custkey == c.c_custkey).select("c_mktsegment", "o_orderstatus")
    return _rounded(guards.bias_approval(joined, "c_mktsegment", F.col("o_orderstatus") == "F"), 6)


def _routed(spark, d) -> DataFrame:
    text = F.lit("")
    for kind, said in TEXTS.items():
        text = F.when(F.col("event_type") == kind, F.lit(said)).otherwise(text)
    return routing.route(routing.classify(_events(spark, d).withColumn("text", text), "text"), routing.route_table(spark, ROUTES))


def route_queries(spark, d):
    got = _routed(spark, d)
    return _rounded(got.select("event_id", "domain", "confidence", "confident", "url", "tier", F.array_join(F.transform("all_scores", lambda s: s["domain"]), ",").alias("ranked")), 9)


#: Keywords that the tables' invented prose holds.
SYLLABLES = {"Clear": ["the on", "tion is", "hand"], "Complicated": ["enth", "onand", "thin", "erth"], "Complex": ["reou", "edti", "haat"], "Chaotic": ["whwh", "lyly", "tiontion"], "Own": ["ción", "ung ", "eau"]}


def classify_documents(spark, d):
    got = routing.route(routing.classify(read_table(spark, d, "documents"), "text", SYLLABLES), routing.route_table(spark, ROUTES))
    return _rounded(got.select("doc_id", "domain", "confidence", "confident", "url", F.array_join(F.transform("all_scores", lambda s: s["domain"]), ",").alias("ranked")), 9)


def classify_by_keywords(spark, d):
    """Documents by a table of the longer words of all conversations, dealt to domains by their length."""
    words = read_table(spark, d, "conversations").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("keyword")).where("length(keyword) > 5").distinct()
    domain = F.element_at(F.array(*map(F.lit, [*routing.DOMAINS[:4], "Own", "Other"])), (F.length("keyword") % 6 + 1).cast("int"))
    got = routing.classify_by_table(read_table(spark, d, "documents").select("doc_id", "text"), "text", words.select(domain.alias("domain"), "keyword"))
    return _rounded(got.select("doc_id", "domain", "confidence", F.size("all_scores").alias("n_domains")), 9)


def budget_running(spark, d):
    got = routing.downgrade(routing.spend(_routed(spark, d), "tier", ["event_id"], 20_000), routing.route_table(spark, ROUTES))
    return got.select("event_id", "cost_mills", "spent_mills", "within", "overage_mills", "suggested_tier", "final_url")


def budget_reset(spark, d):
    """A budget a user, which each signup resets."""
    live = epochs(_routed(spark, d), ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup")
    return routing.spend(live, "tier", ["ts", "event_id"], 100, ["user_id", "epoch"]).select("event_id", "epoch", "cost_mills", "spent_mills", "within")


def budget_tiers(spark, d):
    return _rounded(routing.budget_summary(routing.spend(_routed(spark, d), "tier", ["event_id"], 20_000), "tier", 20_000), 9)


def _matrix(spark, d) -> DataFrame:
    truth = F.element_at(F.array(*map(F.lit, routing.DOMAINS)), (F.abs(F.floor("value")) % 5 + 1).cast("int"))
    return routing.confusion(_routed(spark, d).withColumn("truth", truth), "domain", "truth")


def confusion(spark, d):
    return _matrix(spark, d)


def precision_recall(spark, d):
    return _rounded(routing.domain_metrics(_matrix(spark, d)), 9)


def misrouting(spark, d):
    return routing.misrouting_cost(_matrix(spark, d))


def drift_kl(spark, d):
    counted = _routed(spark, d).groupBy((F.dayofmonth("ts") <= 15).alias("first"), "domain").agg(F.count("*").alias("n"))
    return _rounded(routing.drift(counted.where("not first"), counted.where("first"), 0.1), 9)


def drift_keyed(spark, d):
    """Second against first half of the month for each of five groups of users, one of them null."""
    counted = _routed(spark, d).groupBy(F.nullif(F.col("user_id") % 5, F.lit(0)).alias("team"), (F.dayofmonth("ts") <= 15).alias("first"), "domain").agg(F.count("*").alias("n"))
    return _rounded(routing.drift(counted.where("not first"), counted.where("first"), 0.001, ["team"]), 9)


def session_fold(spark, d):
    chain = guards.policy_chain(guards.risk_policy(_risk(), 0.5, 0.95))
    steps = _routed(spark, d).select(F.col("user_id").alias("session"), F.struct("ts", "event_id").alias("seq"), "domain", "confidence", chain["decision"].alias("decision"))
    return _rounded(fold_sessions(steps), 9)


def session_reclassified(spark, d):
    """Sessions as ``session_fold``, but an error puts its session into Disorder right after it."""
    chain = guards.policy_chain(guards.risk_policy(_risk(), 0.5, 0.95))
    steps = _routed(spark, d).select(F.col("user_id").alias("session"), F.struct("ts", "event_id", F.lit(0).alias("late")).alias("seq"), "domain", "confidence", chain["decision"].alias("decision"), "event_type")
    changes = steps.where("event_type = 'error'").select("session", F.struct("seq.ts", "seq.event_id", F.lit(1).alias("late")).alias("seq"), F.lit("Disorder").alias("domain"), F.lit(0.9).alias("confidence"))
    return _rounded(fold_sessions(reclassify(steps, changes)), 9)


def session_reasoning(spark, d):
    steps = _events(spark, d).select(F.col("user_id").alias("session"), F.struct("ts", "event_id").alias("seq"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("reasoning"))
    return reasoning_log(steps).select("session", F.array_join("log", ",").alias("log"))


def confidence_levels(spark, d):
    return _events(spark, d).select("event_id", confidence_level(F.abs(F.col("value")) / 100).alias("level"))


def workflow_batch(spark, d):
    states = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("state_id"), (F.col("o_orderkey") % 7).alias("x"), F.lit("start").alias("current_node"))
    x = F.col("x")
    nodes = {
        "start": TableNode({"x": x + 1}, F.when(x % 2 == 0, F.lit("double")).otherwise("drop")),
        "double": TableNode({"x": x * 2}, F.when(x < 20, F.lit("double")).otherwise("end")),
        "drop": TableNode({"x": x - 3}, F.lit("end")),
        "end": TableNode({}, F.lit(None).cast("string")),
    }
    return run_table(states, nodes, 6)


_ALL = [
    diff_in_means, ols_adjusted, iv_2sls, ipw_effect, counterfactual_units, placebo_refute, subset_refute, bootstrap_refute, random_common_cause_refute,
    placebo_sequential, common_cause_sequential, bootstrap_sequential, subset_sequential, study_estimate,
    dag_parents, dag_closure, backdoor_set, frontdoor_sets, dsep_table, graph_reachable, graph_ancestors, graph_adjustment, graph_separated,
    graph_levels, graph_levels_circular, graph_cycles, graph_avoiding,
    beta_posterior, normal_posterior, gamma_posterior, dirichlet_posterior, belief_running, belief_tracked, belief_categorical, belief_batch,
    tool_reliability, most_reliable_tool, unreliable_tools, registered_tools, mcmc_normal,
    policy_decisions, policy_text, policy_typed, risk_decisions, breaker_states, loop_checks, visit_history, rate_limits, rate_limits_peek, rate_limits_reset, escalation_status, audit_recent, bias_uniformity, bias_keyed, bias_distribution, bias_approval,
    route_queries, classify_documents, classify_by_keywords, budget_running, budget_reset, budget_tiers, confusion, precision_recall, misrouting, drift_kl, drift_keyed, session_fold, session_reclassified, session_reasoning, confidence_levels, workflow_batch,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in SQL.items() if k in queries()}
