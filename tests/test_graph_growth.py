"""Graph questions over hubs: what is shuffled grows with the tables, not with questions times a hub's edges."""

import pytest
from pyspark.sql import functions as F

from plumbline.operators.graphs import CausalGraph, adjustment_sets, front_door_sets, paths_avoiding, reachable, separated, strong_components, twins
from plumbline.scratch import materialize

N = 300


@pytest.fixture
def shuffled(spark):
    """The most records that a stage of the given work shuffled; joins are not broadcast meanwhile."""
    sc = spark.sparkContext
    stages = lambda: sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())

    def most(work):
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        before = {s.stageId() for s in [stages().apply(i) for i in range(stages().size())]}
        got = work()
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        after = stages()
        return got, max(s.shuffleWriteRecords() for s in [after.apply(i) for i in range(after.size())] if s.stageId() not in before)

    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield most
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def named(spark, kind, other):
    return spark.range(N).select(F.concat(F.lit(kind), F.col("id").cast("string")).alias("a"), F.concat(F.lit(other), F.col("id").cast("string")).alias("b"), F.col("id").alias("question"))


def test_separated_walks_twins_once(spark, shuffled):
    both = named(spark, "s", "c")
    n = F.lit("n")
    edges = both.select(n.alias("src"), F.col("a").alias("dst")).unionByName(both.select(n.alias("src"), F.col("b").alias("dst")))
    asked = both.select("question", F.col("a").alias("x"), F.col("b").alias("y"))
    given = asked.where("question % 2 = 1").select("question", n.alias("node"))
    got, records = shuffled(lambda: separated(edges, asked, given).collect())
    assert {r.question: r.separated for r in got} == {i: i % 2 == 1 for i in range(N)}
    assert records < 20 * N


def test_separated_tells_named_twins_apart(spark):
    pairs = [("n", "a"), ("n", "b"), ("n", "c"), ("a", "m"), ("b", "m"), ("c", "m"), ("m", "t"), ("u", "m"), ("n", "v"), ("n", "w")]
    graph, names = CausalGraph(pairs), ["n", "a", "b", "m", "t", "u", "v"]
    sets = [[], ["n"], ["a"], ["a", "b"], ["a", "b", "c"], ["t"], ["v", "w"], ["n", "t"], ["m", "n"]]
    asked = [(f"{x}{y}{i}", x, y, z) for x in names for y in names for i, z in enumerate(sets)]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = separated(frame(pairs, "src string, dst string"), frame([a[:3] for a in asked], "question string, x string, y string"), frame([(a[0], v) for a in asked for v in a[3]], "question string, node string")).collect()
    assert {r.question: r.separated for r in got} == {q: graph.d_separated(x, y, z) for q, x, y, z in asked}


def test_adjustment_walks_no_ring_question_by_question(spark, shuffled):
    both = named(spark, "c", "d")
    edges = both.select(F.lit("r").alias("src"), F.col("a").alias("dst")).unionByName(both.select(F.col("a").alias("src"), F.lit("m").alias("dst"))).unionByName(both.select(F.col("b").alias("src"), F.lit("m").alias("dst"))).unionByName(spark.createDataFrame([("m", "r")], "src string, dst string"))
    got, records = shuffled(lambda: adjustment_sets(edges, spark.createDataFrame([("q", "m")], "question string, x string")).collect())
    assert {r.node for r in got} == {f"d{i}" for i in range(N)} and records < 20 * N


def test_strong_components(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("e", "f"), ("g", "g"), ("z", "a")]
    got = strong_components(spark.createDataFrame(pairs, "src string, dst string")).collect()
    parts = {}
    for r in got:
        parts.setdefault(r.component, set()).add(r.node)
    assert sorted(map(sorted, parts.values())) == [["a", "b", "c"], ["d", "e"], ["g"]] and len(got) == 6


def test_front_door_reads_causes_not_all_effects(spark, shuffled):
    both = named(spark, "c", "o")
    edges = both.select(F.lit("n").alias("src"), F.col("a").alias("dst")).unionByName(both.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    got, records = shuffled(lambda: front_door_sets(edges, both.select("question", F.lit("n").alias("x"), F.col("b").alias("y"))).collect())
    assert sorted((r.question, r.node) for r in got) == [(i, f"c{i}") for i in range(N)] and records < 20 * N


def test_ways_are_walked_from_the_narrow_end(spark, shuffled):
    both = named(spark, "c", "o")
    edges = both.select(F.lit("n").alias("src"), F.col("a").alias("dst")).unionByName(both.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    asked = both.select("question", F.lit("n").alias("x"), F.col("b").alias("y"))
    got, records = shuffled(lambda: paths_avoiding(edges, asked, both.where("question % 3 = 0").select("question", F.col("a").alias("node"))).collect())
    assert {r.question: r.connected for r in got} == {i: i % 3 > 0 for i in range(N)} and records < 20 * N


@pytest.fixture
def gathered(spark):
    """The most MiB that a broadcast of the given work took on the driver, under Spark's own limit for broadcasts."""
    store = spark._jsparkSession.sharedState().statusStore()

    def size(text):
        number, unit = text.split("\n")[-1].split("(")[0].split()[:2]
        return float(number) * {"B": 2**-20, "KiB": 2**-10, "MiB": 1, "GiB": 2**10}[unit]

    def most(work):
        first = store.executionsCount()
        got = work()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        sizes, runs = [0.0], store.executionsList()
        for i in range(first, runs.size()):
            told, nodes = store.executionMetrics(runs.apply(i).executionId()), store.planGraph(runs.apply(i).executionId()).allNodes()
            for node in (nodes.apply(k) for k in range(nodes.size())):
                ids = [node.metrics().apply(k) for k in range(node.metrics().size())] if node.name() == "BroadcastExchange" else []
                sizes += [size(told.apply(m.accumulatorId())) for m in ids if m.name() == "data size" and told.contains(m.accumulatorId())]
        return got, max(sizes)

    return most


def test_driver_gathers_no_table_that_is_small_in_files_only(spark, gathered):
    n = 50_000
    nodes = materialize(spark.range(n).select(F.md5(F.col("id").cast("string")).alias("node")))
    links = materialize(nodes.select(F.lit("r").alias("src"), F.col("node").alias("dst")).unionByName(nodes.select(F.col("node").alias("src"), F.lit("m").alias("dst"))))
    got, most = gathered(lambda: (reachable(links, nodes).count(), twins(links, nodes).groupBy("class", "size").count().collect()))
    assert got[0] == n + 1 and [(r["size"], r["count"]) for r in got[1]] == [(n, n)] and most < 8
