"""Identification by the backdoor criterion, set-wise over all graphs, and counterfactual propagation.

A pair's adjustment sets are searched by three facts. If any set of the pool separates treatment and outcome, the pool's own
ancestors of the pair do, so one test settles hopeless pairs. Sets of the least size hold ancestors alone, for which separation
is a search through the moral graph of those ancestors. And every separating set meets every open trail, so a set grows
by the pool's members on one open trail at a time, at most three. Each round tests all sets of all pairs by frontier joins.
Without a bound on their size, least sets are least cuts of the same moral graph: as many trails as share no member of the pool
are laid, for all pairs at once, and what they leave open tells the sets. That work grows with the graph, not with its subsets.
"""

from __future__ import annotations

from collections import defaultdict, deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import Grown, counted, cut
from ..schemas import CAUSAL_EDGES, MAX_POOL, MAX_SET
from . import blocks as B
from .components import closure, cyclic_components
from .graph import admissible

PAIR = ["graph_id", "treatment", "outcome"]
#: Treatments whose counterfactuals are computed together.
TREATED = 1_000


def identification(edges: DataFrame, nodes: DataFrame, pairs: DataFrame, most: int | None = MAX_SET, pool: int | None = MAX_POOL) -> DataFrame:
    """graph_id, treatment, outcome, identifiable, reason, adjustment_set, n_near_miss, truncated for each pair.

    nodes: graph_id, node_id, score. A route that only leads through a cyclic node is no causal path. The pool is the `pool` best
    nodes that the treatment doesn't reach, by score from the highest (null: 0), then name; sets of up to `most` are taken smallest
    first, then in the pool's order. None, for either, is no bound. A repeated pair is told once.
    """
    given = cut(edges.select("graph_id", "source_id", "target_id", "edge_type", admissible().alias("_ok")).distinct(), "identify-edges")
    scores = cut(nodes.groupBy("graph_id", "node_id").agg(F.max(F.coalesce("score", F.lit(0.0))).alias("score")), "identify-nodes")
    known = given.select("graph_id", F.explode(F.array("source_id", "target_id")).alias("node_id")).unionByName(scores.select("graph_id", "node_id")).distinct()
    held = given.where("_ok").select("graph_id", "source_id", "target_id").distinct()
    cyclic = cut(cyclic_components(held).select("graph_id", "node_id"), "cyclic-nodes")
    dag = held
    for end in ("source_id", "target_id"):
        dag = dag.join(cyclic.withColumnRenamed("node_id", end), ["graph_id", end], "left_anti")
    dag = cut(dag, "acyclic-edges")

    state = known.join(cyclic.withColumn("_c", F.lit(True)), ["graph_id", "node_id"], "left").withColumn("_c", F.coalesce("_c", F.lit(False)))
    asked = pairs.select(*PAIR).distinct()
    for end in ("treatment", "outcome"):
        asked = asked.join(state.select("graph_id", F.col("node_id").alias(end), F.col("_c").alias(f"_{end}")), ["graph_id", end], "left")
    early = F.when(F.col("_treatment").isNull(), "treatment_absent").when(F.col("_outcome").isNull(), "outcome_absent").when(F.col("_treatment") | F.col("_outcome"), "cyclic_component")
    asked = cut(asked.select(*PAIR, early.alias("_early")), "pairs")
    open_ = asked.where("_early is null").select(*PAIR)
    # One search: back from both ends of the pairs, and forth from treatments.
    ways = F.explode(F.array(F.struct(F.lit("back").alias("way"), F.col("target_id").alias("a"), F.col("source_id").alias("b")), F.struct(F.lit("forth").alias("way"), F.col("source_id").alias("a"), F.col("target_id").alias("b"))))
    both = dag.select("graph_id", ways.alias("_x")).select("graph_id", "_x.way", F.col("_x.a").alias("source_id"), F.col("_x.b").alias("target_id"))
    starts = F.explode(F.array(F.struct(F.lit("back").alias("way"), F.col("outcome").alias("start")), F.struct(F.lit("back").alias("way"), F.col("treatment").alias("start")), F.struct(F.lit("forth").alias("way"), F.col("treatment").alias("start"))))
    reach = closure(both, open_.select("graph_id", starts.alias("_x")).select("graph_id", "_x.*"), keys=("graph_id", "way"))
    ancestors, below = (reach.where(F.col("way") == w).select("graph_id", "start", "node") for w in ("back", "forth"))
    causal = open_.where("treatment <> outcome").join(ancestors.select("graph_id", F.col("start").alias("outcome"), F.col("node").alias("treatment")), PAIR)
    causal = cut(causal.select(*PAIR), "causal-pairs")
    below = below.join(causal.select("graph_id", F.col("treatment").alias("start")).distinct(), ["graph_id", "start"], "left_semi")
    members, size = _pools(dag, scores, below, pool)
    sets = _least_sets(dag, causal, ancestors, members) if most is None else _smallest_sets(dag, causal, ancestors, members, most)
    near = near_misses_of(edges, causal)

    out = asked.join(causal.withColumn("_causal", F.lit(True)), PAIR, "left").join(size, ["graph_id", "treatment"], "left").join(sets, PAIR, "left").join(near, PAIR, "left")
    found = F.col("_set").isNotNull()
    reason = F.coalesce("_early", F.when(F.col("_causal").isNull(), "no_causal_path").when(~found, "no_valid_adjustment_set").when(F.size("_set") > 0, "identifiable_by_adjustment").otherwise("identifiable_trivially"))
    none = F.array().cast("array<string>")
    bounds = [b for b in (most, pool) if b is not None]
    cut_off = F.coalesce(F.col("_causal") & ~found & (F.col("_rest") > min(bounds)), F.lit(False)) if bounds else F.lit(False)
    return out.select(*PAIR, F.coalesce(found, F.lit(False)).alias("identifiable"), reason.alias("reason"), F.coalesce("_set", none).alias("adjustment_set"), F.coalesce("_near", F.lit(0)).cast("long").alias("n_near_miss"), cut_off.alias("truncated"))


def _pools(dag: DataFrame, scores: DataFrame, below: DataFrame, pool: int | None) -> tuple[DataFrame, DataFrame]:
    """graph_id, treatment, node, pos (from 1): each treatment's pool; and graph_id, treatment, _rest: nodes it was taken from.

    Of a graph's order, a pool needs `pool` rows and as many more as the treatment reaches; all rows where pool is None.
    """
    of = Window.partitionBy("graph_id").orderBy(F.desc("score"), "node")
    on = dag.select("graph_id", F.explode(F.array("source_id", "target_id")).alias("node")).distinct()
    ranked = on.join(scores.withColumnRenamed("node_id", "node"), ["graph_id", "node"], "left").withColumn("score", F.coalesce("score", F.lit(0.0))).withColumn("_r", F.row_number().over(of))
    total = on.groupBy("graph_id").agg(F.count("*").alias("_n"))
    reached = below.groupBy("graph_id", F.col("start").alias("treatment")).agg(F.count("*").alias("_below"))
    size = cut(reached.join(total, "graph_id").select("graph_id", "treatment", "_below", (F.col("_n") - F.col("_below")).alias("_rest")), "pool-sizes")
    within = F.lit(True) if pool is None else F.col("_r") <= F.col("_below") + pool
    near = size.join(ranked.select(F.col("graph_id").alias("_g"), "node", "_r"), (F.col("graph_id") == F.col("_g")) & within)
    free = near.select("graph_id", "treatment", "node", "_r").join(below.select("graph_id", F.col("start").alias("treatment"), "node"), ["graph_id", "treatment", "node"], "left_anti")
    place = F.row_number().over(Window.partitionBy("graph_id", "treatment").orderBy("_r"))
    placed = free.withColumn("pos", place).where(F.lit(True) if pool is None else F.col("pos") <= pool)
    return cut(placed.select("graph_id", "treatment", "node", "pos"), "pools"), size.select("graph_id", "treatment", "_rest")


def _smallest_sets(dag: DataFrame, causal: DataFrame, ancestors: DataFrame, members: DataFrame, most: int) -> DataFrame:
    """graph_id, treatment, outcome, _set (names): the first smallest separating set of each pair that has one of up to `most`."""
    on = members.select("graph_id", "treatment", "node", "pos")
    none = F.array().cast("array<int>")
    widest = _widest_sets(causal, ancestors, on)
    # The widest set and the empty one are tested together; only pairs that the widest separates go on.
    tested = separated(dag, ancestors, on, widest.unionByName(causal.select(*PAIR, none.alias("given"), F.lit(False).alias("widest"))))
    hopeful = tested.where("widest and via is null").select(*PAIR)
    tested = cut(tested.where("not widest").join(hopeful, PAIR, "left_semi"), "tested-sets")
    found = None
    for k in range(most + 1):
        # Separating sets of one size: the first in the pool's order.
        done = cut(tested.where("via is null").groupBy(*PAIR).agg(F.min("given").alias("given")), "separating-sets")
        found = done if found is None else found.unionByName(done)
        if k == most:
            break
        more = tested.where("via is not null").join(done.select(*PAIR), PAIR, "left_anti")
        sets, n = counted(more.select(*PAIR, "given", F.explode("via").alias("_v")).select(*PAIR, F.array_sort(F.array_append("given", F.col("_v"))).alias("given")).distinct(), "grown-sets")
        if not n:
            break
        tested = separated(dag, ancestors, on, sets)
    return _named(found, on)


def _widest_sets(causal: DataFrame, ancestors: DataFrame, members: DataFrame) -> DataFrame:
    """graph_id, treatment, outcome, given, widest (true): the places of all of the pool's ancestors of each pair."""
    each = causal.select(*PAIR, F.explode(F.array("treatment", "outcome")).alias("start")).join(ancestors, ["graph_id", "start"]).join(members, ["graph_id", "treatment", "node"])
    held = causal.join(each.groupBy(*PAIR).agg(F.array_sort(F.collect_set("pos")).alias("_z")), PAIR, "left")
    return cut(held.select(*PAIR, F.coalesce("_z", F.array().cast("array<int>")).alias("given"), F.lit(True).alias("widest")), "widest-sets")


def _named(found: DataFrame, members: DataFrame) -> DataFrame:
    """graph_id, treatment, outcome, _set: the names of found sets (given: pool places), in the pool's order."""
    names = found.select(*PAIR, F.posexplode_outer("given").alias("_i", "pos")).join(members, ["graph_id", "treatment", "pos"], "left")
    named = F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "node"))))
    return cut(names.groupBy(*PAIR).agg(named.alias("_s")).select(*PAIR, F.transform("_s", lambda x: x["node"]).alias("_set")), "found-sets")


def _least_sets(dag: DataFrame, causal: DataFrame, ancestors: DataFrame, members: DataFrame) -> DataFrame:
    """graph_id, treatment, outcome, _set (names): the first smallest separating set of each pair that has one, of any size.

    Parents of both ends are in every separating set. Pairs that those alone don't separate get least cuts.
    """
    on = members.select("graph_id", "treatment", "node", "pos")
    up = dag.select("graph_id", F.col("source_id").alias("node"), F.col("target_id").alias("_child"))
    shared = causal.join(up.withColumnRenamed("_child", "treatment"), ["graph_id", "treatment"]).join(up.withColumnRenamed("_child", "outcome"), ["graph_id", "outcome", "node"])
    shared = shared.join(on, ["graph_id", "treatment", "node"]).groupBy(*PAIR).agg(F.array_sort(F.collect_set("pos")).alias("_z"))
    shared = causal.join(shared, PAIR, "left").select(*PAIR, F.coalesce("_z", F.array().cast("array<int>")).alias("given"), F.lit(False).alias("widest"))
    tested = separated(dag, ancestors, on, _widest_sets(causal, ancestors, on).unionByName(cut(shared, "shared-parents")))
    hopeful = tested.where("widest and via is null").select(*PAIR)
    tested = cut(tested.where("not widest").join(hopeful, PAIR, "left_semi"), "tested-sets")
    found = tested.where("via is null").select(*PAIR, "given")
    rest, n = counted(tested.where("via is not null").select(*PAIR, "given"), "uncut-pairs")
    return _named(found.unionByName(least_cuts(dag, ancestors, on, rest)) if n else found, on)


def least_cuts(dag: DataFrame, ancestors: DataFrame, members: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (graph_id, treatment, outcome, given: places that are in the set anyway) with given: the first smallest separating set.

    A flow through the moral graph, in which a member of the pool is two places with one unit between them (i and o), other nodes
    (n) and hubs (h) are one place without a bound. Each round lays one more way for every pair that has one left. A member
    is in some least cut if its i place leads neither to its o place nor to the outcome, and the treatment doesn't lead to that o
    place; two members are in one together if neither's i place leads to the other's o place. So members are taken in the pool's order.
    Some way must be closed by the pool for each pair (as the widest set separates it).
    """
    arc = [*PAIR, "a", "b"]
    hubs = pairs.select(*PAIR, "given", F.explode(F.array("treatment", "outcome")).alias("start")).join(ancestors.select("graph_id", "start", F.col("node").alias("hub")), ["graph_id", "start"]).drop("start").distinct()
    held = hubs.join(_families(dag), ["graph_id", "hub"]).where("node <> treatment or hub = treatment")
    held = held.join(members, ["graph_id", "treatment", "node"], "left").where("pos is null or not array_contains(given, pos)")
    free = F.col("pos").isNull()
    into, out, hub = F.concat(F.when(free, "n").otherwise("i"), "node"), F.concat(F.when(free, "n").otherwise("o"), "node"), F.concat(F.lit("h"), "hub")
    lead = lambda a, b, unit: F.struct(a.alias("a"), b.alias("b"), F.lit(unit).alias("unit"))
    arcs = held.select(*PAIR, F.explode(F.array(lead(out, hub, False), lead(hub, into, False), lead(into, out, True))).alias("_x")).select(*PAIR, "_x.*").where("a <> b").distinct()
    arcs = cut(arcs, "flow-arcs")
    back = lambda df: df.select(*PAIR, F.col("b").alias("a"), F.col("a").alias("b"))
    flow, searched = arcs.limit(0).select(*arc), pairs.select(*PAIR)
    while True:
        # A used unit leads back alone; other places lead on, and back to where flow came from.
        left = cut(arcs.join(flow.withColumn("unit", F.lit(True)), [*arc, "unit"], "left_anti").select(*arc).unionByName(back(flow)), "open-arcs")
        ways, n = counted(_ways(left, searched), "ways")
        if not n:
            break
        # Between unbounded places flow changes nothing.
        laid = ways.select(*PAIR, F.explode("way").alias("_x")).select(*PAIR, "_x.*").where("left(a, 1) in ('i', 'o') or left(b, 1) in ('i', 'o')")
        flow = cut(flow.join(back(laid), arc, "left_anti").unionByName(laid.join(back(flow), arc, "left_anti")), "flow")
        searched = ways.select(*PAIR)
    used = flow.where("left(a, 1) = 'i' and left(b, 1) = 'o'").withColumn("node", F.substr("a", F.lit(2))).join(members, ["graph_id", "treatment", "node"])
    used = cut(used.select(*arc, "pos"), "used-members")
    starts = used.select(*PAIR, F.col("a").alias("start")).unionByName(pairs.select(*PAIR, F.concat(F.lit("n"), "treatment").alias("start")))
    reach = closure(left.select(*PAIR, F.col("a").alias("source_id"), F.col("b").alias("target_id")), starts, keys=tuple(PAIR)).select(*PAIR, "start", F.col("node").alias("b"))
    reach = reach.join(used.select(*PAIR, F.col("a").alias("start"), F.col("pos").alias("_from")), [*PAIR, "start"], "left")
    reach = cut(reach.join(used.select(*PAIR, "b", F.col("pos").alias("_to")), [*PAIR, "b"], "left").where("_to is not null or b = concat('n', outcome)"), "led-to")
    never = reach.where("_from is null or _to is null or _from = _to").select(*PAIR, F.coalesce("_to", "_from").alias("pos"))
    sides = F.explode(F.array(F.struct(F.col("_from").alias("pos"), F.col("_to").alias("other")), F.struct(F.col("_to").alias("pos"), F.col("_from").alias("other"))))
    apart = reach.where("_from <> _to").select(*PAIR, sides.alias("_x")).select(*PAIR, "_x.*").groupBy(*PAIR, "pos").agg(F.collect_set("other").alias("_apart"))
    none = F.array().cast("array<int>")
    able = used.select(*PAIR, "pos").join(never, [*PAIR, "pos"], "left_anti").join(apart, [*PAIR, "pos"], "left").select(*PAIR, F.struct("pos", F.coalesce("_apart", none).alias("apart")).alias("_x"))
    taken = F.aggregate(F.array_sort(F.collect_list("_x")), none, lambda z, x: F.when(F.arrays_overlap(z, x["apart"]), z).otherwise(F.array_append(z, x["pos"])))
    return cut(pairs.join(able.groupBy(*PAIR).agg(taken.alias("_z")), PAIR).select(*PAIR, F.array_sort(F.concat("given", "_z")).alias("given")), "least-cuts")


def _ways(arcs: DataFrame, pairs: DataFrame) -> DataFrame:
    """graph_id, treatment, outcome, way (arcs): a shortest way from treatment to outcome for each pair that has one."""
    none = F.array().cast("array<struct<a: string, b: string>>")
    seen = Grown(pairs.select(*PAIR, F.concat(F.lit("n"), "treatment").alias("a"), none.alias("way")), "way-ends")
    frontier, end = seen.added, F.concat(F.lit("n"), "outcome")
    while seen.size:
        step = frontier.join(arcs, [*PAIR, "a"]).groupBy(*PAIR, "b").agg(F.min(F.array_append("way", F.struct("a", "b"))).alias("way")).withColumnRenamed("b", "a")
        fresh = seen.add(step.join(seen.table().select(*PAIR, "a"), [*PAIR, "a"], "left_anti"))
        frontier = fresh.join(fresh.where(F.col("a") == end).select(*PAIR), PAIR, "left_anti")
    return seen.table().where(F.col("a") == end).select(*PAIR, "way")


def _families(dag: DataFrame) -> DataFrame:
    """graph_id, node, hub: each node in its own family, named by it, and in those of its children."""
    own = dag.select("graph_id", F.explode(F.array("source_id", "target_id")).alias("node")).distinct()
    families = dag.select("graph_id", F.col("source_id").alias("node"), F.col("target_id").alias("hub"))
    return cut(families.unionByName(own.select("graph_id", "node", F.col("node").alias("hub"))), "families")


def separated(dag: DataFrame, ancestors: DataFrame, members: DataFrame, sets: DataFrame) -> DataFrame:
    """sets (graph_id, treatment, outcome, given: pool places) with via: null where given separates the pair in the moral
    graph of its ancestors without the treatment's out-edges; else the pool's places on an open trail (which may be none).

    A family, a node with its parents, is a clique of the moral graph. It stands as one hub between its members, so no clique is spelled
    out: a hop leads from nodes to the hubs they belong to, and on to those hubs' members that aren't given.
    """
    state = [*PAIR, "given"]
    families = _families(dag)
    shortest = F.min_by("via", F.struct(F.size("via"), "via")).alias("via")
    trails = Grown(sets.select(*state).distinct().select(*state, F.col("treatment").alias("node"), F.array().cast("array<int>").alias("via")), "trails")
    frontier = trails.added
    while trails.size:
        met = frontier.join(families, ["graph_id", "node"]).where("node <> treatment or hub = treatment").groupBy(*state, "hub").agg(shortest)
        either = met.select("*", F.explode(F.array("treatment", "outcome")).alias("start"))
        held = either.join(ancestors.select("graph_id", "start", F.col("node").alias("hub")), ["graph_id", "start", "hub"], "left_semi").drop("start").distinct()
        # The outcome's own family ends a search; its other members aren't walked.
        walked = held.join(families, ["graph_id", "hub"]).where("node <> treatment and (hub <> outcome or node = outcome)")
        placed = walked.join(members, ["graph_id", "treatment", "node"], "left").where("pos is null or not array_contains(given, pos)")
        via = F.when(F.col("pos").isNull(), F.col("via")).otherwise(F.array_append("via", F.col("pos")))
        step = placed.select(*state, "node", via.alias("via")).groupBy(*state, "node").agg(shortest)
        fresh = trails.add(step.join(trails.table().select(*state, "node"), [*state, "node"], "left_anti"))
        frontier = fresh.join(fresh.where("node = outcome").select(*state), state, "left_anti")
    ends = trails.table().where("node = outcome").select(*state, "via")
    return cut(sets.join(ends, state, "left"), "tested-sets")


def near_misses_of(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """graph_id, treatment, outcome, _near: near misses of the given pairs alone, from the regulators of each treatment."""
    up = edges.where(F.col("edge_type").isin(*CAUSAL_EDGES)).select("graph_id", F.col("source_id").alias("r"), F.col("target_id").alias("treatment")).distinct()
    weak = edges.where(~admissible()).select("graph_id", F.col("source_id").alias("r"), F.col("target_id").alias("outcome")).distinct()
    met = pairs.join(up, ["graph_id", "treatment"]).where("r <> treatment and r <> outcome").join(weak, ["graph_id", "r", "outcome"])
    return met.groupBy(*PAIR).agg(F.count("*").alias("_near"))


def counterfactual(edges: DataFrame, nodes: DataFrame, pairs: DataFrame, threshold: float = 0.1) -> DataFrame:
    """graph_id, treatment, outcome, factual, counterfactual, effect, valid.

    A node's value is the weighted mean of its parents' values, a root's its score (0.5 where unknown); the counterfactual
    holds the treatment at 0. Cyclic graphs are walked in name order, once for TREATED treatments, whose values are an array.
    """
    known = nodes.groupBy("graph_id").agg(F.map_from_entries(F.collect_list(F.struct("node_id", F.coalesce("score", F.lit(0.5))))).alias("_scores"))
    asked = pairs.select("graph_id", "treatment", "outcome").toDF("graph_id", "treatment", "outcome").join(known, "graph_id", "left")

    def values(parents: dict, order: list, scores: dict, held: list) -> dict:
        """Of each node, its value with each of `held` at 0, as one array."""
        out, at = {}, defaultdict(list)
        for i, n in enumerate(held):
            at[n].append(i)
        for n in order:
            ins = parents.get(n, ())
            total = sum(w for _, w in ins)
            value = sum(out.get(a, scores.get(a, 0.5)) * w for a, w in ins) / total if total > 0 else scores.get(n, 0.5)
            out[n] = np.full(len(held), value, dtype=float) if np.isscalar(value) else value
            out[n][at.get(n, [])] = 0.0
        return out

    def run(e: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        parents, nodes_, left = defaultdict(list), set(), defaultdict(int)
        for a, b, w in zip(e["source_id"], e["target_id"], e["weight"], strict=True):
            parents[b].append((a, w))
            nodes_ |= {a, b}
            left[b] += 1
        children = defaultdict(list)
        for b, ins in parents.items():
            for a, _ in ins:
                children[a].append(b)
        queue, order = deque(sorted(n for n in nodes_ if not left[n])), []
        while queue:
            n = queue.popleft()
            order.append(n)
            for c in sorted(children[n]):
                left[c] -= 1
                if not left[c]:
                    queue.append(c)
        if len(order) < len(nodes_):
            order = sorted(nodes_)
        rows = []
        scores = dict(p["_scores"].iloc[0]) if len(p) and p["_scores"].iloc[0] is not None else {}
        treated = sorted(set(p["treatment"]), key=str)
        wanted = set(p["outcome"])
        factual = {y: float(v[0]) for y, v in values(parents, order, scores, [None]).items() if y in wanted}
        for i in range(0, len(treated), TREATED):
            some = treated[i : i + TREATED]
            place = {x: k for k, x in enumerate(some)}
            against = {y: v for y, v in values(parents, order, scores, some).items() if y in wanted}
            for g, x, y in zip(p["graph_id"], p["treatment"], p["outcome"], strict=True):
                if x in place:
                    a = factual.get(y)
                    b = None if a is None else float(against[y][place[x]])
                    rows.append((g, x, y, a, b, None if a is None else a - b, a is not None and a - b >= threshold))
        return pd.DataFrame(rows, columns=["graph_id", "treatment", "outcome", "factual", "counterfactual", "effect", "valid"])

    e = edges.select(F.col("graph_id").alias("_g"), "source_id", "target_id", "weight")
    g = e.groupBy("_g").cogroup(asked.toDF(*asked.columns).groupBy("graph_id"))
    return g.applyInPandas(run, "graph_id string, treatment string, outcome string, factual double, counterfactual double, effect double, valid boolean")


def near_misses(edges: DataFrame) -> DataFrame:
    """graph_id, treatment, outcome, n: regulators of a treatment with only an inadmissible association to the outcome. Set-wise.

    Repeated edges count once, and the regulators of a node stand in blocks of 64: a pair's blocks are matched, not its regulators.
    """
    causal, weak = F.col("edge_type").isin(*CAUSAL_EDGES), ~admissible()
    held = edges.where("source_id <> target_id").groupBy("graph_id", "source_id", "target_id").agg(F.max(F.coalesce(causal, F.lit(False))).alias("_up"), F.max(weak).alias("_weak"))
    held = cut(held, "regulators")
    at = B.places(held.select("graph_id", F.col("source_id").alias("node"))).withColumnRenamed("node", "source_id")
    held = held.join(at, ["graph_id", "source_id"])
    side = lambda which, name: cut(B.united(held.where(which), ["graph_id", "target_id"], "place").withColumnRenamed("target_id", name), f"{name}-blocks")
    up = side("_up", "treatment")
    # By treatment, over all cores: the sums of a pair then stay in one task.
    up = up.repartition(2 * edges.sparkSession.sparkContext.defaultParallelism, "graph_id", "treatment")
    met = up.join(side("_weak", "outcome").withColumnRenamed("bits", "_bits"), ["graph_id", "block"]).withColumn("_both", F.col("bits").bitwiseAND(F.col("_bits"))).where("treatment <> outcome and _both <> 0")
    return met.groupBy("graph_id", "treatment", "outcome").agg(F.sum(F.bit_count("_both")).alias("n"))
