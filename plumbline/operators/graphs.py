"""Causal graphs: structure, separation, and adjustment sets.

A causal graph is a modelling artefact of at most some thousands of edges, so questions
about one graph are answered on the driver. Edge tables of any size are asked by frontier
joins, whole tables of questions at once: ``reachable`` and ``closure`` for what is above or
below, ``levels`` and ``cycles`` for order, ``paths_avoiding``, ``separated``, ``adjustment_sets``,
``verified_adjustment`` and ``front_door_sets`` for identification.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterable, Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.scratch import joined, materialize, release


class CausalGraph:
    """Variables in order of arrival; parallel edges are kept and cycles not refused."""

    def __init__(self, edges: Iterable[tuple[str, str]] = (), variables: Iterable[str] = ()):
        self.variables: list[str] = []
        self.edges: list[tuple[str, str]] = []
        self._up, self._down = defaultdict(list), defaultdict(list)
        for v in variables:
            self.add_variable(v)
        for a, b in edges:
            self.add_edge(a, b)

    def add_variable(self, name: str) -> int:
        if name not in self.variables:
            self.variables.append(name)
        return self.variables.index(name)

    def add_edge(self, cause: str, effect: str) -> None:
        self.add_variable(cause)
        self.add_variable(effect)
        self.edges.append((cause, effect))
        self._down[cause].append(effect)
        self._up[effect].append(cause)

    @property
    def num_variables(self) -> int:
        return len(self.variables)

    @property
    def num_edges(self) -> int:
        return len(self.edges)

    def parents(self, name: str) -> list[str]:
        return list(self._up.get(name, []))

    def children(self, name: str) -> list[str]:
        return list(self._down.get(name, []))

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(self.edges)], "src string, dst string, ord int")

    def to_json(self) -> str:
        return json.dumps({"variables": self.variables, "edges": [list(e) for e in self.edges]})

    @classmethod
    def from_json(cls, text: str) -> CausalGraph:
        spec = json.loads(text)
        return cls([tuple(e) for e in spec["edges"]], spec["variables"])

    def is_acyclic(self) -> bool:
        waiting = {v: len(self._up[v]) for v in self.variables}
        ready = [v for v, n in waiting.items() if not n]
        done = 0
        while ready:
            done += 1
            for w in self._down[ready.pop()]:
                waiting[w] -= 1
                if not waiting[w]:
                    ready.append(w)
        return done == len(self.variables)

    def _closure(self, seeds: Iterable[str], step: dict, without: frozenset = frozenset()) -> set[str]:
        seen = {s for s in seeds if s in self.variables and s not in without}
        stack = list(seen)
        while stack:
            new = [w for w in step[stack.pop()] if w not in seen and w not in without]
            seen.update(new)
            stack += new
        return seen

    def ancestors(self, names: Iterable[str]) -> set[str]:
        """The names and all above them."""
        return self._closure(names, self._up)

    def descendants(self, name: str) -> set[str]:
        """All below a name, itself left out."""
        return self._closure([name], self._down) - {name}

    def has_path(self, a: str, b: str, without: Iterable[str] = ()) -> bool:
        """A directed path from a to b that avoids ``without`` in between (the ends always count)."""
        return b in self._closure([a], self._down, frozenset(without) - {a, b})

    def d_separated(self, x: str, y: str, given: Iterable[str] = (), strict: bool = False) -> bool:
        """Whether no path between x and y is open given a set.

        An unknown x or y is separated from all; x is never separated from itself. Unknown
        names in the set are ignored. ``strict`` refuses a set that holds x or y.
        """
        if x not in self.variables or y not in self.variables:
            return True
        z = {g for g in given if g in self.variables}
        if strict and z & {x, y}:
            raise ValueError("the conditioning set holds an end of the path")
        above = self.ancestors(z)
        seen, stack = set(), [(x, "up"), (x, "down")]
        while stack:
            at = stack.pop()
            if at in seen:
                continue
            seen.add(at)
            node, way = at
            if node == y:
                return False
            open_ = node not in z
            if way == "up" and open_:
                stack += [(p, "up") for p in self._up[node]] + [(c, "down") for c in self._down[node]]
            if way == "down":
                stack += [(c, "down") for c in self._down[node]] if open_ else []
                stack += [(p, "up") for p in self._up[node]] if node in above else []
        return True

    def backdoor(self, treatment: str, outcome: str, mode: str = "parents") -> set[str] | None:
        """The treatment's parents that it does not reach; None for unknown names.

        ``verified`` also asks that they block every back-door path, else None.
        """
        if treatment not in self.variables or outcome not in self.variables:
            return None
        found = set(self._up[treatment]) - self.descendants(treatment)
        if mode == "verified":
            cut = CausalGraph([e for e in self.edges if e[0] != treatment], self.variables)
            if outcome in found or not cut.d_separated(treatment, outcome, found):
                return None
        return found

    def front_door(self, treatment: str, outcome: str) -> set[str] | None:
        """The smallest mediating set, first in order of arrival among equals; None if there is none.

        A set serves if it meets every directed path and each member's parents are the
        treatment at most, which is what the front-door conditions come to.
        """
        if treatment not in self.variables or outcome not in self.variables:
            return None
        able = [v for v in self.variables if v not in (treatment, outcome) and v in self.descendants(treatment) and outcome in self.descendants(v) and set(self._up[v]) <= {treatment}]
        for size in range(1, len(able) + 1):
            for pick in combinations(able, size):
                if not self.has_path(treatment, outcome, pick):
                    return set(pick)
        return None


#: Tables of as many rounds are written into one.
FAN = 4


class _Found:
    """Rows found round by round, as a few tables: FAN tables of one rank become one of the next.

    A plan over them has some scans for a thousand rounds, not one a round, and a row is
    written again once a rank only.
    """

    def __init__(self) -> None:
        self.tables: list[tuple[int, DataFrame]] = []

    def add(self, table: DataFrame) -> None:
        self.tables.append((0, table))
        while len(self.tables) >= FAN and self.tables[-1][0] == self.tables[-FAN][0]:
            rank, last = self.tables[-1][0], [t for _, t in self.tables[-FAN:]]
            self.tables[-FAN:] = [(rank + 1, materialize(reduce(DataFrame.unionByName, last)))]
            release(*last)

    def rows(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [t for _, t in self.tables])

    def holds(self, table: DataFrame) -> bool:
        return any(t is table for _, t in self.tables)


def _rounds(start: DataFrame, step, max_rounds: int, keys: Sequence[str] | None = None) -> DataFrame:
    """All rows, distinct in ``keys`` (all columns unless given), that repeated steps reach from ``start``.

    Each round joins new rows only and is written to the shared folder, which cuts the lineage;
    ``step(frontier, round)`` gives rows of the same columns. A round's table goes when it has
    been written into a larger one and is no frontier any more.
    """
    found = _Found()
    frontier = materialize(start.distinct())
    found.add(frontier)
    keys = list(keys or frontier.columns)
    for i in range(1, max_rounds + 1):
        new = step(frontier, i).dropDuplicates(keys)
        before, frontier = frontier, materialize(new.transform(joined, found.rows().select(*keys), keys, "left_anti"))
        if not found.holds(before):
            release(before)
        if frontier.isEmpty():
            release(frontier)
            return found.rows()
        found.add(materialize(frontier) if _closes_rank(found) else frontier)
    raise RuntimeError(f"no end within {max_rounds} rounds")


def _closes_rank(found: _Found) -> bool:
    """Whether the next table completes a rank, which removes it: a frontier then needs a copy."""
    return len(found.tables) >= FAN - 1 and all(rank == 0 for rank, _ in found.tables[-(FAN - 1) :])


def _links(edges: DataFrame) -> DataFrame:
    return edges.where("src is not null and dst is not null").select("src", "dst")


def reachable(edges: DataFrame, seeds: DataFrame, max_depth: int = 1000) -> DataFrame:
    """(node, depth): all that the seeds (node) reach over (src, dst), by frontier joins.

    Each round joins the frontier only and leaves out what is known, so cycles end. Null nodes
    and ends are ignored; no seeds reach nothing.
    """
    links = _links(edges)
    start = seeds.where("node is not null").select("node").distinct().withColumn("depth", F.lit(0))
    return _rounds(start, lambda f, i: f.transform(joined, links, f.node == links.src).select(links.dst.alias("node"), F.lit(i).alias("depth")), max_depth, ["node"])


def closure(edges: DataFrame, seeds: DataFrame, above: bool = False, max_rounds: int = 1000) -> DataFrame:
    """(seed, node): every seed with itself and all below it, or above it, over (src, dst); ``seeds`` has node.

    The result has a row for each pair, which is what is asked for. Null nodes are ignored.
    """
    a, b = ("dst", "src") if above else ("src", "dst")
    links = _links(edges).select(F.col(a).alias("node"), F.col(b).alias("next"))
    start = seeds.where("node is not null").select(F.col("node").alias("seed"), "node")
    return _rounds(start, lambda f, i: f.join(links, "node").select("seed", F.col("next").alias("node")), max_rounds)


def levels(edges: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """(node, level): the longest way to each node from a node without causes; null on and behind cycles.

    Nodes are peeled by in-degree: a round takes the nodes whose causes have all gone, counts
    their edges towards their effects (summed map-side, so a hub is no hot row) and keeps the
    counts of effects that still wait. Every edge is joined once. A graph is acyclic if no
    level is null. Parallel edges count each; null ends are ignored.
    """
    links = materialize(_links(edges))
    needs = materialize(links.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("needs")))
    nodes = links.select(F.col("src").alias("node")).unionByName(links.select(F.col("dst").alias("node"))).distinct()
    found = _Found()
    frontier = materialize(nodes.transform(joined, needs, "node", "left_anti").withColumn("level", F.lit(0)))
    waits = None
    for i in range(1, max_rounds + 1):
        if frontier.isEmpty():
            break
        found.add(materialize(frontier) if _closes_rank(found) else frontier)
        got = frontier.transform(joined, links, frontier.node == links.src).groupBy(links.dst.alias("node")).agg(F.count("*").alias("seen"))
        both = got if waits is None else got.unionByName(waits.select("node", "seen")).groupBy("node").agg(F.sum("seen").alias("seen"))
        # what waits and what is next are two views of one table
        counted = materialize(both.transform(joined, needs, "node"))
        if not found.holds(frontier):
            release(frontier)
        waits, frontier = counted.where("seen < needs"), counted.where("seen = needs").select("node", F.lit(i).alias("level"))
    else:
        raise RuntimeError(f"no end within {max_rounds} rounds")
    every = materialize(nodes)
    release(links, needs, *([] if waits is None else [waits]), keep=[t for _, t in found.tables])
    return every.transform(joined, found.rows() if found.tables else frontier, "node", "left")


def cyclic_core(edges: DataFrame) -> DataFrame:
    """(src, dst): the edges between nodes that lie on a cycle or on a way from one cycle to another.

    What peeling from above and then from below leaves; without cycles it is empty.
    """
    links = materialize(_links(edges))
    left = materialize(levels(links).where("level is null").select("node"))
    inner = materialize(links.transform(joined, left.withColumnRenamed("node", "src"), "src", "left_semi").transform(joined, left.withColumnRenamed("node", "dst"), "dst", "left_semi"))
    turned = inner.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    kept = materialize(levels(turned).where("level is null").select("node"))
    core = materialize(inner.transform(joined, kept.withColumnRenamed("node", "src"), "src", "left_semi").transform(joined, kept.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst"))
    release(links, left, inner, kept)
    return core


def cycles(edges: DataFrame) -> DataFrame:
    """(cycle, position, node): closed ways through the graph, from their smallest node (``cycle``, position 0) on.

    Every node of the cyclic core points to its smallest effect in the core; these pointers
    end in cycles, at least one for each connected core, no two of which share a node. Cycle
    nodes, their smallest node and their places are found by doubling the pointers, so rounds
    grow with the logarithm of a cycle's length. An acyclic graph has no rows.
    """
    core = cyclic_core(edges)
    point = materialize(core.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("next")))
    release(core)

    def doubled(table: DataFrame, *more: Column) -> DataFrame:
        """Each node's pointer led on by the node it points to, whose columns are prefixed with to_."""
        other = table.withColumnsRenamed({c: f"to_{c}" for c in table.columns if c != "node"}).withColumnRenamed("node", "next")
        return materialize(table.join(other, "next").select("node", F.col("to_next").alias("next"), *more))

    size, jump = -1, point
    while True:  # nodes that some node reaches in 2^i steps: at last those on cycles
        ends = jump.select(F.col("next").alias("node")).distinct()
        count = ends.count()
        if count in (size, 0):
            break
        size, before = count, jump
        jump = doubled(jump)
        release(*(() if before is point else (before,)))
    ring = materialize(point.join(ends, "node", "left_semi").withColumn("least", F.least("node", "next")))
    state = ring
    while True:  # the smallest of the next 2^i nodes
        after = doubled(state, F.least("least", "to_least").alias("least"), (F.col("to_least") < F.col("least")).alias("moved"))
        release(*(() if state is ring else (state,)))
        state = after.drop("moved")
        if after.where("moved").isEmpty():
            break
    # steps from a node to its cycle's smallest, which stays where it is
    stops = F.col("node") == F.col("cycle")
    named = ring.select("node", "next").join(state.select("node", F.col("least").alias("cycle")), "node")
    walk = materialize(named.select("node", "cycle", F.when(stops, F.col("node")).otherwise(F.col("next")).alias("next"), F.when(stops, 0).otherwise(1).cast("long").alias("steps")))
    release(point, jump, ring, state)
    while not walk.where("next <> cycle").isEmpty():
        before, walk = walk, doubled(walk, F.col("cycle"), (F.col("steps") + F.col("to_steps")).alias("steps"))
        release(before)
    length = walk.groupBy("cycle").agg(F.count("*").alias("length"))
    return walk.join(length, "cycle").select("cycle", ((F.col("length") - F.col("steps")) % F.col("length")).alias("position"), "node")


def degrees(edges: DataFrame) -> DataFrame:
    """(node, n_parents, n_children, only_parent): distinct causes and effects of each node; its cause if it has one only."""
    links = _links(edges).distinct()
    none = F.lit(0).cast("long")
    up = links.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n_parents"), F.min("src").alias("first"))
    down = links.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n_children"))
    both = up.join(down, "node", "full")
    return both.select("node", F.coalesce("n_parents", none).alias("n_parents"), F.coalesce("n_children", none).alias("n_children"), F.when(F.col("n_parents") == 1, F.col("first")).alias("only_parent"))


def strong_components(edges: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """(node, component): which nodes reach each other, named by one of them; a node on no cycle has no row.

    In the cyclic core each node takes the smallest node that reaches it as its colour. What
    reaches that node inside its colour is its component; the rest is trimmed and coloured
    again. Every round is linear in the core.
    """
    left, found = cyclic_core(edges), []
    while not left.isEmpty():
        ends = left.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
        colours = materialize(ends.select("node", F.col("node").alias("colour"), F.lit(True).alias("moved")))
        for _ in range(max_rounds):
            told = colours.where("moved").transform(joined, left, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("told"))
            after = materialize(colours.transform(joined, told, "node", "left").select("node", F.least("colour", "told").alias("colour"), F.coalesce(F.col("told") < F.col("colour"), F.lit(False)).alias("moved")))
            release(colours)
            colours = after
            if colours.where("moved").isEmpty():
                break
        else:
            raise RuntimeError(f"no end within {max_rounds} rounds")
        named = colours.select("node", "colour")
        both = left.transform(joined, named.select(F.col("node").alias("src"), F.col("colour").alias("from_colour")), "src").transform(joined, named.select(F.col("node").alias("dst"), F.col("colour").alias("to_colour")), "dst")
        inner = materialize(both.where("from_colour = to_colour").select("src", "dst"))
        back = reachable(inner.select(F.col("dst").alias("src"), F.col("src").alias("dst")), named.where("node = colour").select("node"), max_rounds)
        part = materialize(named.transform(joined, back, "node", "left_semi").withColumnRenamed("colour", "component"))
        release(back, colours, left)
        found.append(part)
        gone = part.select("node")
        left = cyclic_core(inner.transform(joined, gone.withColumnRenamed("node", "src"), "src", "left_anti").transform(joined, gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"))
        release(inner)
    return reduce(DataFrame.unionByName, found) if found else left.select(F.col("src").alias("node"), F.col("dst").alias("component"))


def adjustment_sets(edges: DataFrame, questions: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """(question, node): for each treatment (question, x) its parents that it does not reach, over (src, dst).

    The table form of the back-door set in its ``parents`` mode; a treatment without any has no
    row, a repeated question its rows once. A treatment reaches a parent just when both are in
    one strong component, so no ways are walked question by question.
    """
    asked = questions.where("question is not null and x is not null").select("question", "x").distinct()
    parents = asked.transform(joined, edges.where("src is not null").select("src", F.col("dst").alias("x")).distinct(), "x").select("question", "x", F.col("src").alias("node"))
    parts = strong_components(edges, max_rounds)
    both = parents.transform(joined, parts.select(F.col("node").alias("x"), F.col("component").alias("own")), "x", "left").transform(joined, parts, "node", "left")
    return both.where("x = node or own is null or component is null or own <> component").select("question", "node")


def paths_avoiding(edges: DataFrame, questions: DataFrame, avoided: DataFrame | None = None, max_rounds: int = 1000) -> DataFrame:
    """(question, x, y, connected): whether a directed way leads from x to y that meets none of the question's ``avoided`` (question, node) in between.

    All questions walk together, each from the end with fewer edges on its way, down from x or
    up from y, and one stops once it has met its other end. The ends always count; a node is
    connected with itself. Questions without id are left out, null ends are not connected,
    unknown nodes only with themselves.
    """
    links = materialize(_links(edges).distinct())
    asked = questions.where("question is not null").select("question", "x", "y").distinct()
    shut = None if avoided is None else materialize(avoided.where("question is not null and node is not null").select("question", "node").distinct())
    ways = links.select(F.lit(False).alias("up"), F.col("src").alias("node"), F.col("dst").alias("next")).unionByName(links.select(F.lit(True).alias("up"), F.col("dst").alias("node"), F.col("src").alias("next")))
    below, above = links.groupBy(F.col("src").alias("x")).agg(F.count("*").alias("below")), links.groupBy(F.col("dst").alias("y")).agg(F.count("*").alias("above"))
    turned = F.coalesce("above", F.lit(0)) < F.coalesce("below", F.lit(0))
    walkers = asked.where("x is not null and y is not null").join(below, "x", "left").join(above, "y", "left").select("question", "x", "y", turned.alias("up"))
    state = ["question", "x", "y", "up"]
    arrived = "node = if(up, x, y)"

    def step(frontier: DataFrame, _: int) -> DataFrame:
        met = frontier.where(arrived).select("question", "x", "y").distinct()
        going = frontier.join(met, ["question", "x", "y"], "left_anti")
        new = going.join(ways, ["up", "node"]).select(*state, F.col("next").alias("node"))
        return new if shut is None else new.where(f"not ({arrived})").join(shut, ["question", "node"], "left_anti").select(*state, "node").unionByName(new.where(arrived))

    start = walkers.select(*state, F.expr("if(up, y, x)").alias("node"))
    reached = _rounds(start, step, max_rounds).where(arrived).select("question", "x", "y").distinct().withColumn("met", F.lit(True))
    return asked.join(reached, ["question", "x", "y"], "left").select("question", "x", "y", F.col("met").isNotNull().alias("connected"))


def front_door_sets(edges: DataFrame, questions: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(question, node): the smallest front-door set of each (question, x, y) over an acyclic (src, dst); none has no row.

    A member must lie on a way from x to y and have no cause but x (see ``CausalGraph.front_door``).
    So it is an effect of x, no way holds two members, and every way begins with one: the set
    is that of all effects of x which lead to y, or none if one of them is y or has another
    cause. No sets are enumerated. Ways are walked upwards once for each distinct y.
    """
    links = materialize(_links(edges).distinct())
    asked = questions.where("question is not null and x is not null and y is not null and x <> y").select("question", "x", "y").distinct()
    above = closure(links, asked.select(F.col("y").alias("node")), above=True, max_rounds=max_rounds).withColumnRenamed("seed", "y")
    # from what leads to y to its causes, not from x to all its effects: no more rows than the walk had
    causes = above.join(links.select(F.col("dst").alias("node"), F.col("src").alias("x")), "node")
    effects = materialize(asked.join(causes, ["x", "y"]).select("question", "x", "y", "node"))
    sole = degrees(links).where("only_parent is not null").select("node")
    able = effects.where("node <> y").join(sole, "node", "left_semi")
    unfit = effects.join(able.select("question", "node"), ["question", "node"], "left_anti").select("question").distinct()
    return able.join(unfit, "question", "left_anti").select("question", "node")


#: Nodes of more edges are not looked at as twins; questions with more classes in their sets walk alone.
TWIN_EDGES, SHARED_CLASSES = 32, 1000
#: Parts of a class in a question's graph: those that it does not name, its x, members of its set, an x in its own set.
REST, END, SHUT, SHUT_END = range(4)


def twins(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, class, size): nodes of the same causes and the same effects in one class, named by the smallest.

    Neighbours are compared as they are, of nodes with up to ``TWIN_EDGES`` edges; others are
    classes by themselves.
    """
    ends = links.select(F.col("src").alias("node"), F.struct(F.lit(1).alias("way"), F.col("dst").alias("other")).alias("end")).unionByName(links.select(F.col("dst").alias("node"), F.struct(F.lit(0).alias("way"), F.col("src").alias("other")).alias("end")))
    hubs = materialize(ends.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") > TWIN_EDGES).select("node"))
    told = ends.transform(joined, hubs, "node", "left_anti").groupBy("node").agg(F.sort_array(F.collect_set("end")).alias("ends"))
    ends_of = materialize(nodes.transform(joined, hubs, "node", "left_anti").transform(joined, told, "node", "left").withColumn("ends", F.coalesce("ends", F.array())))
    classes = ends_of.groupBy("ends").agg(F.min("node").alias("class"), F.count("*").alias("size"))
    alone = nodes.transform(joined, hubs, "node", "left_semi").select("node", F.col("node").alias("class"), F.lit(1).cast("long").alias("size"))
    return materialize(ends_of.transform(joined, classes, "ends").select("node", "class", "size").unionByName(alone))


def separated(edges: DataFrame, questions: DataFrame, given: DataFrame, max_rounds: int = 1000, cut: bool = False) -> DataFrame:
    """(question, x, y, separated): whether no path between x and y is open given the question's set.

    ``edges`` (src, dst), ``questions`` (question, x, y) and ``given`` (question, node) are tables
    of any size. As for one graph, an unknown x or y is separated from all, and unknown nodes of
    the set are ignored. Questions without id are left out. With ``cut`` each question's graph
    lacks the edges that leave its x, so only back-door paths are asked about.

    Only what leads to a node that some question names is walked. There, twins behave alike but
    for those that a question names, so a class of twins is one node, or a few parts of one,
    and questions whose x and set are of the same classes walk once, whatever their y. A state
    is a part of a class and the way it was entered, a round one join with the edges between
    classes upwards and one downwards.
    """
    links = materialize(_links(edges).distinct())
    nodes = links.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    asked = questions.where("question is not null").select("question", "x", "y")
    known = materialize(asked.distinct().transform(joined, nodes.withColumnRenamed("node", "x"), "x", "left_semi").transform(joined, nodes.withColumnRenamed("node", "y"), "y", "left_semi").select("question", "x", "y"))
    fixed = materialize(given.where("question is not null and node is not null").select("question", "node").distinct().transform(joined, nodes, "node", "left_semi").select("question", "node"))
    named = known.select(F.explode(F.array("x", "y")).alias("node")).unionByName(fixed.select("node"))
    above = materialize(reachable(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")), named, max_rounds).select("node"))
    inside = materialize(links.transform(joined, above.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst"))
    classes = twins(inside, above)
    a, b = classes.select(F.col("node").alias("src"), F.col("class").alias("a")), classes.select(F.col("node").alias("dst"), F.col("class").alias("b"))
    between = materialize(inside.transform(joined, a, "src").transform(joined, b, "dst").select("a", "b").distinct())
    up, down = between.select(F.col("b").alias("class"), F.col("a").alias("next")), between.select(F.col("a").alias("class"), F.col("b").alias("next"))

    # what each question names of a class
    no, yes = F.lit(False), F.lit(True)
    starts = known.select("question", "x").distinct()
    marks = starts.select("question", "x", F.col("x").alias("node"), yes.alias("end"), no.alias("shut")).unionByName(starts.transform(joined, fixed, "question").select("question", "x", "node", no.alias("end"), yes.alias("shut")))
    marks = marks.groupBy("question", "x", "node").agg(F.max("end").alias("end"), F.max("shut").alias("shut")).transform(joined, classes, "node")
    some = lambda kind, on: F.when(F.max(on), F.lit(kind))
    end, shut = F.col("end"), F.col("shut")
    parts = F.array_compact(F.array(F.when(F.count("*") < F.first("size"), F.lit(REST)), some(END, end & ~shut), some(SHUT, shut & ~end), some(SHUT_END, end & shut)))
    special = materialize(marks.groupBy("question", "x", "class").agg(parts.alias("parts")))
    few = special.groupBy("question", "x").agg(F.count("*").alias("n")).where(F.col("n") <= SHARED_CLASSES)
    shape = materialize(special.transform(joined, few, ["question", "x"], "left_semi").groupBy("question", "x").agg(F.sort_array(F.collect_list(F.struct("class", "parts"))).alias("shape")))
    shapes = materialize(shape.select("shape").distinct().withColumn("walk", F.monotonically_increasing_id()))
    alone = starts.transform(joined, few, ["question", "x"], "left_anti").withColumn("walk", -1 - F.monotonically_increasing_id())
    walks = materialize(shape.transform(joined, shapes, "shape").select("question", "x", "walk").unionByName(alone.select("question", "x", "walk")))
    apart = special.transform(joined, walks.where("walk < 0"), ["question", "x"]).select("walk", "class", "parts")
    special = materialize(shapes.select("walk", F.inline("shape")).unionByName(apart))

    def entered(new: DataFrame) -> DataFrame:
        """(walk, class, ...) as the parts that the class has in the walk."""
        found = new.distinct().transform(joined, special, ["walk", "class"], "left")
        return found.withColumn("part", F.explode(F.coalesce("parts", F.array(F.lit(REST))))).drop("parts")

    def climbed(f: DataFrame) -> DataFrame:
        new = entered(f.transform(joined, up, "class").select("walk", F.col("next").alias("class")))
        return new.where(~is_end) if cut else new

    is_end, is_shut = F.col("part").isin(END, SHUT_END), F.col("part").isin(SHUT, SHUT_END)
    each = special.select("walk", "class", F.explode("parts").alias("part"))
    ancestors = materialize(_rounds(each.where(is_shut), lambda f, _: climbed(f).select("walk", "class", "part"), max_rounds))
    lifting = ancestors.withColumn("lifts", yes)

    def step(frontier: DataFrame, _: int) -> DataFrame:
        at = frontier.transform(joined, lifting, ["walk", "class", "part"], "left").na.fill(False, ["lifts"])
        goes_up = climbed(at.where(F.when(F.col("way") == "up", ~is_shut).otherwise(F.col("lifts")))).withColumn("way", F.lit("up"))
        leaving = at.where(~is_shut & ~is_end) if cut else at.where(~is_shut)
        goes_down = entered(leaving.transform(joined, down, "class").select("walk", F.col("next").alias("class"))).withColumn("way", F.lit("down"))
        return goes_up.unionByName(goes_down).select("walk", "class", "part", "way")

    reached = _rounds(each.where(is_end).withColumn("way", F.explode(F.array(F.lit("up"), F.lit("down")))), step, max_rounds).select("walk", "class", "part").distinct()
    kept = fixed.select("question", F.col("node").alias("y"), yes.alias("held"))
    at_y = known.where("x <> y").transform(joined, walks, ["question", "x"]).transform(joined, kept, ["question", "y"], "left").transform(joined, classes.select(F.col("node").alias("y"), "class"), "y").withColumn("part", F.when(F.col("held"), F.lit(SHUT)).otherwise(F.lit(REST)))
    met = at_y.transform(joined, reached, ["walk", "class", "part"], "left_semi").select("question", "x", "y").unionByName(known.where("x = y")).distinct().withColumn("open", yes)
    return asked.transform(joined, met, ["question", "x", "y"], "left").select("question", "x", "y", F.col("open").isNull().alias("separated"))


def verified_adjustment(edges: DataFrame, questions: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(question, x, y, verified): whether the ``adjustment_sets`` of each (question, x, y) block every back-door path.

    The table form of ``CausalGraph.backdoor`` in its ``verified`` mode: false where the outcome is in
    the set, a path stays open in the graph without the treatment's effects, or an end is unknown.
    """
    asked = questions.where("question is not null").select("question", "x", "y").distinct()
    sets = materialize(adjustment_sets(edges, asked, max_rounds))
    told = separated(edges, asked, sets, max_rounds, cut=True)
    holds = sets.withColumnRenamed("node", "y").withColumn("inside", F.lit(True))
    nodes = _links(edges).select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("known", F.lit(True))
    both = told.transform(joined, holds, ["question", "y"], "left").transform(joined, nodes.withColumnsRenamed({"node": "x", "known": "knows_x"}), "x", "left").transform(joined, nodes.withColumnsRenamed({"node": "y", "known": "knows_y"}), "y", "left")
    good = F.col("separated") & F.col("inside").isNull() & F.col("knows_x").isNotNull() & F.col("knows_y").isNotNull()
    return both.select("question", "x", "y", good.alias("verified"))
