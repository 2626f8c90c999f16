"""Searches over many graphs at once, as joins: closures, cyclic components and betweenness.

A row of a frontier is (graph, start, node), so all graphs and all starts advance together, a round of joins for each hop. What
was visited is one written table that each round appends to; no graph is ever held in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import Grown, counted, cut
from . import blocks as B


def closure(edges: DataFrame, starts: DataFrame, back: bool = False, keys: tuple[str, ...] = ("graph_id",)) -> DataFrame:
    """graph_id, start, node, hops: every node that each start (graph_id, start) reaches, itself at 0 hops; with back, that reaches it.

    keys: columns of edges and starts that tell graphs apart.
    """
    a, b = ("target_id", "source_id") if back else ("source_id", "target_id")
    e = cut(edges.select(*keys, F.col(a).alias("node"), F.col(b).alias("_b")).distinct(), "closure-edges")
    of = [*keys, "start", "node"]
    seen = Grown(starts.select(*keys, "start").distinct().select(*keys, "start", F.col("start").alias("node"), F.lit(0).alias("hops")), "closure")
    frontier = seen.added
    while seen.size:
        step = frontier.join(e, [*keys, "node"]).select(*keys, "start", F.col("_b").alias("node"), (F.col("hops") + 1).alias("hops")).distinct()
        frontier = seen.add(step.join(seen.table().select(*of), of, "left_anti"))
    return seen.table()


def cyclic_components(edges: DataFrame) -> DataFrame:
    """graph_id, component, node_id: nodes of cycles (self-loops too) by strongly connected component, numbered by their least node.

    Nodes without in- or out-edges are trimmed, round by round. Then the least label spreads along edges until it rests;
    a component holds the node that gave a colour its label and all of that colour that lead back to it. Found
    components and edges between colours go, and the rest takes another turn. edges: graph_id, source_id, target_id.
    """
    given = cut(edges.select("graph_id", "source_id", "target_id").distinct(), "component-edges")
    found = Grown(given.where("source_id = target_id").select("graph_id", F.col("source_id").alias("least"), F.col("source_id").alias("node_id")), "components")
    e = given.where("source_id <> target_id")
    while True:
        e, n = trimmed(e)
        if not n:
            break
        colour = cut(least_label(e), "colours")
        at = lambda end, name: colour.select("graph_id", F.col("node").alias(end), F.col("label").alias(name))
        within = e.join(at("source_id", "_s"), ["graph_id", "source_id"]).join(at("target_id", "_t"), ["graph_id", "target_id"]).where("_s = _t")
        within = cut(within.select("graph_id", "source_id", "target_id"), "within-colours")
        # Within its colour alone a label's giver is reached by its own component only.
        roots = colour.where("node = label").select("graph_id", F.col("node").alias("start"))
        parts = cut(closure(within, roots, back=True).select("graph_id", F.col("start").alias("least"), F.col("node").alias("node_id")), "parts")
        cyclic = parts.join(parts.where("least <> node_id").select("graph_id", "least").distinct(), ["graph_id", "least"], "left_semi")
        found.add(cyclic)
        gone = parts.select("graph_id", "node_id")
        for end in ("source_id", "target_id"):
            within = within.join(gone.withColumnRenamed("node_id", end), ["graph_id", end], "left_anti")
        e = cut(within, "left-edges")
    # A self-loop inside a larger component belongs to that.
    nodes = found.table().groupBy("graph_id", "node_id").agg(F.min("least").alias("least"))
    order = nodes.select("graph_id", "least").distinct().withColumn("component", F.row_number().over(Window.partitionBy("graph_id").orderBy("least")) - 1)
    return nodes.join(order, ["graph_id", "least"]).select("graph_id", "component", "node_id")


def trimmed(edges: DataFrame) -> tuple[DataFrame, int]:
    """Edges that are left when those from nodes without in-edges and to nodes without out-edges are taken off, again and again; and their number."""
    e, n = counted(edges, "trimmed")
    was = -1
    while n not in (0, was):
        into, out = (e.select("graph_id", F.col(a).alias(b)).distinct() for a, b in (("target_id", "source_id"), ("source_id", "target_id")))
        was = n
        e, n = counted(e.join(into, ["graph_id", "source_id"], "left_semi").join(out, ["graph_id", "target_id"], "left_semi"), "trimmed")
    return e, n


def least_label(edges: DataFrame) -> DataFrame:
    """graph_id, node, label: the least of all nodes that reach a node, itself included; only labels that changed are sent on."""
    e = edges.select("graph_id", F.col("source_id").alias("node"), F.col("target_id").alias("_b"))
    ends = edges.select("graph_id", F.explode(F.array("source_id", "target_id")).alias("node")).distinct()
    labels = ends.withColumn("label", F.col("node"))
    moved = Grown(labels, "moved-labels")
    sent = moved.added
    while moved.size:
        told = sent.join(e, ["graph_id", "node"]).groupBy("graph_id", F.col("_b").alias("node")).agg(F.min("label").alias("label"))
        # A node's label is the least it was ever told.
        held = moved.table().groupBy("graph_id", "node").agg(F.min("label").alias("_was"))
        sent = moved.add(told.join(held, ["graph_id", "node"]).where("label < _was").select("graph_id", "node", "label"))
    return moved.table().groupBy("graph_id", "node").agg(F.min("label").alias("label"))


def betweenness(edges: DataFrame) -> DataFrame:
    """graph_id, node_id, betweenness: shares of shortest paths through a node, directed and normalised.

    Numbers of shortest paths are summed forward, hop by hop for all starts; then each node's dependence is
    summed backward from the farthest hop, over edges that lead one hop on. Blocks of 64 nodes are matched before edges are spelled
    out, so only edges between hops make rows. edges: graph_id, source_id, target_id.
    """
    edges = cut(edges.select("graph_id", "source_id", "target_id"), "betweenness-given")
    at = cut(B.places(edges.select("graph_id", F.explode(F.array("source_id", "target_id")).alias("node"))), "betweenness-nodes")
    e = cut(B.numbered(edges.where("source_id <> target_id"), at), "betweenness-edges")
    into = lambda a, b: cut(B.united(e.select("graph_id", F.col(a).alias("place"), F.col(b).alias("_b")), ["graph_id", "place"], "_b"), "neighbours")
    ahead, behind = into("a", "b"), into("b", "a")
    keys = ["graph_id", "start", "place"]
    blocks = lambda rows: cut(B.united(rows, ["graph_id", "start"], "place"), "hop-blocks")
    seen = Grown(e.select("graph_id", F.col("a").alias("start")).distinct().select("graph_id", "start", F.col("start").alias("place"), F.lit(1.0).alias("ways")), "ways")
    levels, sets = [seen.added], [blocks(seen.added)]
    while seen.size:
        had = reduce(DataFrame.unionByName, sets).groupBy(*B.SET).agg(F.bit_or("bits").alias("_had"))
        met = B.spread(levels[-1]).join(ahead, ["graph_id", "place"]).join(had, B.SET, "left").withColumn("bits", B.without("bits", "_had")).where("bits <> 0")
        levels.append(seen.add(B.listed(met.drop("place"), "graph_id", "start", "ways").groupBy(*keys).agg(F.sum("ways").alias("ways"))))
        sets.append(blocks(levels[-1]))
    shares = Grown(levels[-1].select(*keys, F.lit(0.0).alias("share")), "shares")
    last = None
    for i in range(len(levels) - 3, 0, -1):
        far = levels[i + 1].withColumn("share", F.lit(0.0)) if last is None else levels[i + 1].join(last, keys, "left")
        part = far.select(*keys, ((1 + F.coalesce("share", F.lit(0.0))) / F.col("ways")).alias("_part"))
        met = B.spread(part).join(behind, ["graph_id", "place"]).join(sets[i].withColumnRenamed("bits", "_on"), B.SET).withColumn("bits", F.col("bits").bitwiseAND(F.col("_on"))).where("bits <> 0")
        got = B.listed(met.drop("place"), "graph_id", "start", "_part").groupBy(*keys).agg(F.sum("_part").alias("_sum"))
        last = shares.add(levels[i].join(got, keys).select(*keys, (F.col("ways") * F.col("_sum")).alias("share")))
    total = shares.table().groupBy("graph_id", "place").agg(F.sum("share").alias("_total"))
    scale = F.when(F.col("_n") > 2, 1 / ((F.col("_n") - 1) * (F.col("_n") - 2))).otherwise(1.0)
    sized = at.join(at.groupBy("graph_id").agg(F.count("*").alias("_n")), "graph_id")
    return sized.join(total, ["graph_id", "place"], "left").select("graph_id", F.col("node").alias("node_id"), (F.coalesce("_total", F.lit(0.0)) * scale).alias("betweenness"))
