"""Reachability, shortest paths and their strength, set-wise over all graphs and treatments.

Breadth-first search as a loop of frontier joins, one for each hop: a frontier row is (graph, treatment, excluded
source, node), so leave-one-source-out runs are rows of the same search. It ends where the frontier is empty, or at a depth given by a parameter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut
from .blocks import reached

KEYS = ["graph_id", "treatment", "excluded"]


def shortest_paths(edges: DataFrame, starts: DataFrame, most: int | None = None, directed: bool = True, back: bool = False) -> DataFrame:
    """graph_id, treatment, excluded, node, hops, strength, path: the best path to each node, within `most` hops where given.

    edges: graph_id, source_id, target_id, weight, source_db. starts: graph_id, treatment and, where only edges of
    other sources count, excluded. Fewest hops first, then the largest product of weights, then the first path by
    name. The loop has a round for each hop; each shuffles the frontier, deduplicated to one row for each node. With
    back, treatment is where paths end, and node where they start.
    """
    ends = [("source_id", "target_id")] + [("target_id", "source_id")] * (not directed)
    ends = [(b, a) for a, b in ends] if back else ends
    pairs = F.explode(F.array(*(F.struct(F.col(a).alias("a"), F.col(b).alias("b")) for a, b in ends)))
    e = edges.select(F.col("graph_id").alias("_g"), F.col("weight").alias("_w"), F.col("source_db").alias("_s"), pairs.alias("x")).select("_g", "_w", "_s", "x.a", "x.b")
    e = cut(e, "path-edges")
    if "excluded" not in starts.columns:
        starts = starts.withColumn("excluded", F.lit(None).cast("string"))
    seen = starts.select(*(F.col(k).alias(k) for k in KEYS), F.col("treatment").alias("node"), F.lit(0).alias("hops"), F.lit(1.0).alias("strength"), F.array("treatment").alias("path"))
    frontier = seen
    longer = (lambda: F.concat(F.array("b"), "path")) if back else (lambda: F.concat("path", F.array("b")))
    hop = 0
    while most is None or hop < most:
        hop += 1
        step = frontier.join(e, (F.col("graph_id") == F.col("_g")) & (F.col("node") == F.col("a")) & ~F.coalesce(F.col("_s") == F.col("excluded"), F.lit(False)))
        step = step.select(*KEYS, F.col("b").alias("node"), F.lit(hop).alias("hops"), (F.col("strength") * F.coalesce("_w", F.lit(0.5))).alias("strength"), longer().alias("path"))
        best = step.groupBy(*KEYS, "node").agg(F.min_by(F.struct("hops", "strength", "path"), F.struct((-F.col("strength")).alias("s"), F.array_join("path", "\0").alias("p"))).alias("x")).select(*KEYS, "node", "x.*")
        met = seen.select(*(F.col(k).alias(f"_{k}") for k in KEYS), F.col("node").alias("_node"))
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in KEYS] + [F.col("node") == F.col("_node")]
        cond = same[0]
        for c in same[1:]:
            cond = cond & c
        frontier = cut(best.join(met, cond, "left_anti"), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def path_strength(edges: DataFrame, pairs: DataFrame, most: int | None = None) -> DataFrame:
    """pairs (graph_id, treatment, outcome, excluded?) with strength: of the directed path, discounted by its length;
    half a discount for an undirected one; 0.1 for none; 0 from a node to itself."""
    if "excluded" not in pairs.columns:
        pairs = pairs.withColumn("excluded", F.lit(None).cast("string"))
    pairs = cut(pairs, "path-pairs")
    edges = cut(edges.select("graph_id", "source_id", "target_id", "weight", "source_db"), "pair-edges")
    starts = pairs.select(*KEYS).distinct()
    goals = pairs.select("graph_id", F.col("outcome").alias("treatment"), "excluded").distinct()
    # From the side with fewer ends: a disease is the outcome of all its genes.
    back = goals.count() < starts.count()
    near, far = ("outcome", "treatment") if back else ("treatment", "outcome")
    side = ["graph_id", F.col("treatment").alias(near), "excluded", F.col("node").alias(far)]
    ahead = shortest_paths(edges, goals if back else starts, most, back=back).select(*side, "hops", "strength", "path")
    around = shortest_paths(edges, goals if back else starts, most, directed=False, back=back).select(*side, F.col("hops").alias("uhops"))

    def joined(left: DataFrame, right: DataFrame, name: str) -> DataFrame:
        r = right.select(F.struct(*right.columns).alias(name))
        x = F.col(name)
        return left.join(r, (F.col("outcome") == x["outcome"]) & (F.col("graph_id") == x["graph_id"]) & (F.col("treatment") == x["treatment"]) & F.col("excluded").eqNullSafe(x["excluded"]), "left")

    rows = joined(joined(pairs, ahead, "_d"), around, "_u")
    value = (
        F.when(F.col("treatment") == F.col("outcome"), 0.0)
        .when(F.col("_d.hops").isNotNull(), F.col("_d.strength") / (F.col("_d.hops") + 1))
        .when(F.col("_u.uhops").isNotNull(), 0.5 / (F.col("_u.uhops") + 1))
        .otherwise(0.1)
    )
    return rows.select(*pairs.columns, F.col("_d.hops").alias("hops"), F.col("_u.uhops").alias("uhops"), F.col("_d.path").alias("path"), value.alias("path_strength"))


def reachable(edges: DataFrame, starts: DataFrame, most: int | None = None) -> DataFrame:
    """graph_id, treatment, node, hops: as shortest_paths, without the paths, by blocks of nodes."""
    return reached(edges, starts.select("graph_id", F.col("treatment").alias("start")), most).withColumnRenamed("start", "treatment")


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select("graph_id", F.explode(F.array(F.struct(F.col("source_id").alias("node_id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("target_id").alias("node_id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("x"))
    return ends.groupBy("graph_id", "x.node_id").agg(F.sum("x.i").alias("in_degree"), F.sum("x.o").alias("out_degree"))


def density(edges: DataFrame) -> DataFrame:
    """graph_id, n_nodes, n_edges, density (share of ordered pairs of different nodes with an edge), mean_degree.

    Edges between one pair of nodes count once, self-loops as edges; a graph of one node has density 0.
    """
    n_nodes = edges.select("graph_id", F.explode(F.array("source_id", "target_id")).alias("n")).distinct().groupBy("graph_id").agg(F.count("*").alias("n_nodes"))
    n_edges = edges.select("graph_id", "source_id", "target_id").distinct().groupBy("graph_id").agg(F.count("*").alias("n_edges"))
    n, m = F.col("n_nodes"), F.col("n_edges")
    return n_nodes.join(n_edges, "graph_id").select("graph_id", "n_nodes", "n_edges", F.when(n > 1, m / (n * (n - 1))).otherwise(0.0).alias("density"), (m / n).alias("mean_degree"))


def pagerank(edges: DataFrame, damping: float = 0.85, tolerance: float = 1e-6) -> DataFrame:
    """graph_id, node_id, rank by joins until each graph's ranks move by less than tolerance a node, in sum; mass of
    nodes without out-edges is spread evenly. Moves shrink by `damping` a round, so the loop ends."""
    edges = cut(edges.select("graph_id", "source_id", "target_id"), "rank-edges")
    nodes = edges.select("graph_id", F.explode(F.array("source_id", "target_id")).alias("node_id")).distinct()
    out = edges.groupBy("graph_id", F.col("source_id").alias("node_id")).agg(F.count("*").alias("_out"))
    n = F.count("*").over(Window.partitionBy("graph_id"))
    rank = nodes.withColumn("_n", n).withColumn("rank", 1 / F.col("_n")).join(out, ["graph_id", "node_id"], "left")
    rank = cut(rank, "rank")
    base = rank.select("graph_id", "node_id", "_n", "_out")
    while True:
        was = rank.select("graph_id", "node_id", F.col("rank").alias("_was"))
        rank = rank.withColumn("_loose", F.sum(F.when(F.col("_out").isNull(), F.col("rank")).otherwise(0.0)).over(Window.partitionBy("graph_id")))
        sent = edges.join(rank.select("graph_id", F.col("node_id").alias("source_id"), (F.col("rank") / F.col("_out")).alias("_r")), ["graph_id", "source_id"])
        got = sent.groupBy("graph_id", F.col("target_id").alias("node_id")).agg(F.sum("_r").alias("_got"))
        loose = rank.groupBy("graph_id").agg(F.first("_loose").alias("_loose"))
        rank = base.join(got, ["graph_id", "node_id"], "left").join(loose, "graph_id")
        rank = cut(rank.select("graph_id", "node_id", "_n", "_out", ((1 - damping) / F.col("_n") + damping * (F.coalesce("_got", F.lit(0.0)) + F.col("_loose") / F.col("_n"))).alias("rank")), "rank")
        moved = rank.join(was, ["graph_id", "node_id"]).groupBy("graph_id").agg(F.sum(F.abs(F.col("rank") - F.col("_was"))).alias("_m"), F.first("_n").alias("_n"))
        if moved.where(F.col("_m") >= F.col("_n") * tolerance).isEmpty():
            break
    return rank.select("graph_id", "node_id", "rank")


def message_pass(edges: DataFrame, features: DataFrame) -> DataFrame:
    """Mean of the neighbours' features by target node and relation: one layer's gather, without learned weights."""
    src = features.select("graph_id", F.col("node_id").alias("source_id"), F.posexplode("features").alias("k", "v"))
    held = edges.join(src, ["graph_id", "source_id"]).groupBy("graph_id", "target_id", "edge_type", "k").agg(F.avg("v").alias("v"))
    return held.groupBy("graph_id", F.col("target_id").alias("node_id"), "edge_type").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda x: x["v"]).alias("features"))
