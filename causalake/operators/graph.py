"""Graph assembly: union of sources, keyed node merge, edge dedup and collisions, frames, default edges.

Every input carries graph_id and ord, the order of arrival; folds that depend on order use ord, never row order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import flag, match_key, pubmed_ids, split_list
from ..schemas import CAUSAL_EDGES, GENE_LIKE, GENETIC, OUTCOME_KEYS


def union_sources(sources: list[DataFrame], order: tuple[str, ...] = ("ord",)) -> DataFrame:
    """All rows; ord becomes (position of the source, order within), as one sortable struct."""
    parts = [s.withColumn("ord", F.struct(F.lit(i).alias("src"), *(F.col(c).alias(f"o{k}") for k, c in enumerate(order)))) for i, s in enumerate(sources)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def merge_nodes(nodes: DataFrame, substring_sources: bool = False) -> DataFrame:
    """One row for each (graph_id, node_id).

    First arrival gives name, type and description; score is the largest; metadata keys are last-wins; uniprot_id is
    the first non-empty; pdb_ids the ordered distinct union; source the ordered distinct list, joined by ", ". Rows
    with pinned true keep score and metadata: others may only add keys that state no outcome, and no source.
    With substring_sources a source is skipped if the list so far contains it as text.
    """
    if "pinned" not in nodes.columns:
        nodes = nodes.withColumn("pinned", F.lit(False))
    none = F.create_map().cast("map<string,string>")
    nodes = nodes.withColumn("metadata", F.map_entries(F.coalesce("metadata", none)))  # maps can't be sorted
    held = nodes.groupBy("graph_id", "node_id").agg(F.array_sort(F.collect_list(F.struct("ord", "name", "node_type", "description", "source", "score", "uniprot_id", "pdb_ids", "metadata", "pinned"))).alias("r"), F.max("pinned").alias("pinned"))
    rows = F.col("r")
    own = F.when(F.col("pinned"), F.filter(rows, lambda x: x["pinned"])).otherwise(rows)
    other = F.when(F.col("pinned"), F.filter(rows, lambda x: ~x["pinned"])).otherwise(F.slice(rows, 1, 0))
    entries = lambda rs: F.flatten(F.transform(rs, lambda x: x["metadata"]))
    allowed = F.filter(entries(other), lambda e: ~e["key"].isin(*OUTCOME_KEYS))
    # Last wins: entries in order, pinned ones behind the others; the last of each key is kept.
    every = F.concat(allowed, entries(own))
    keys = F.array_distinct(F.transform(every, lambda e: e["key"]))
    last = F.map_from_entries(F.transform(keys, lambda k: F.struct(k.alias("key"), F.element_at(F.filter(every, lambda e: e["key"] == k), -1)["value"].alias("value"))))
    names = F.array_distinct(F.filter(F.flatten(F.transform(own, lambda x: F.split(F.coalesce(x["source"], F.lit("")), ", "))), lambda s: s != ""))
    if substring_sources:
        names = F.aggregate(names, F.lit(""), lambda a, s: F.when(a.contains(s), a).otherwise(F.concat_ws(", ", F.when(a != "", a), s)))
        source = names
    else:
        source = F.array_join(names, ", ")
    first = lambda f: F.element_at(F.filter(F.transform(rows, lambda x: x[f]), lambda v: F.coalesce(v, F.lit("")) != ""), 1)
    return held.select(
        "graph_id", "node_id", rows[0]["name"].alias("name"), rows[0]["node_type"].alias("node_type"), source.alias("source"),
        F.array_max(F.transform(own, lambda x: x["score"])).alias("score"),
        F.when(F.size(F.filter(rows, lambda x: F.coalesce(x["uniprot_id"], F.lit("")) != "")) > 0, first("uniprot_id")).alias("uniprot_id"),
        F.array_distinct(F.flatten(F.transform(rows, lambda x: F.coalesce(x["pdb_ids"], F.array().cast("array<string>"))))).alias("pdb_ids"),
        rows[0]["description"].alias("description"), last.alias("metadata"), "pinned",
    )


def dedup_edges(edges: DataFrame) -> DataFrame:
    """The first arrival of each (graph, source, target, type)."""
    w = Window.partitionBy("graph_id", "source_id", "target_id", "edge_type").orderBy("ord")
    return edges.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def admissible(edge_type="edge_type", evidence_class="evidence_class") -> Column:
    """Whether an edge may carry a causal claim."""
    t, e = F.col(edge_type), F.col(evidence_class)
    return F.coalesce(t.isin(*CAUSAL_EDGES) | ((t == "associated_with") & e.isin(*GENETIC)), F.lit(False))


def resolve_collisions(edges: DataFrame) -> DataFrame:
    """One edge for each ordered pair: admissible before not, then heavier, then earlier; all primary sources kept.

    An aggregate with map-side combine except for the list of sources, which is bounded by a pair's own edges.
    """
    rest = [c for c in edges.columns if c not in ("graph_id", "source_id", "target_id", "primary_sources")]
    pick = F.min_by(F.struct(*rest), F.struct((~admissible()).alias("a"), (-F.col("weight")).alias("w"), "ord"))
    lists = F.array_sort(F.collect_list(F.struct("ord", F.coalesce("primary_sources", F.array().cast("array<string>")).alias("p"))))
    held = edges.groupBy("graph_id", "source_id", "target_id").agg(pick.alias("_e"), F.array_distinct(F.flatten(F.transform(lists, lambda x: x["p"]))).alias("primary_sources"))
    return held.select("graph_id", "source_id", "target_id", *(F.col(f"_e.{c}").alias(c) for c in rest), "primary_sources")


def default_edges(nodes: DataFrame, edges: DataFrame, label: str = "default") -> DataFrame:
    """An associated_with edge to the graph's disease node for each gene-like node that has no edge to it."""
    disease = nodes.where("node_type = 'disease'").select("graph_id", F.col("node_id").alias("target_id"))
    genes = nodes.where(F.col("node_type").isin(*GENE_LIKE)).select("graph_id", F.col("node_id").alias("source_id"), F.col("score").alias("weight"))
    pairs = genes.join(disease, "graph_id").join(edges.select("graph_id", "source_id", "target_id"), ["graph_id", "source_id", "target_id"], "left_anti")
    return pairs.select("graph_id", "source_id", "target_id", F.lit("associated_with").alias("edge_type"), "weight", F.lit(label).alias("source_db"), F.lit("").alias("evidence_class"))


def gene_symbols(nodes: DataFrame, most: int = 20) -> DataFrame:
    """graph_id, name, rank: gene-like symbols, one for each key (pinned, then score, then earlier), by score."""
    rows = nodes.where(F.col("node_type").isin(*GENE_LIKE)).withColumn("key", match_key("name"))
    if "pinned" not in rows.columns:
        rows = rows.withColumn("pinned", F.lit(False))
    one = Window.partitionBy("graph_id", "key").orderBy(F.desc("pinned"), F.desc("score"), "ord")
    rows = rows.withColumn("_n", F.row_number().over(one)).withColumn("_first", F.min("ord").over(Window.partitionBy("graph_id", "key"))).where("_n = 1")
    rank = F.row_number().over(Window.partitionBy("graph_id").orderBy(F.desc("score"), "_first"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= most).select("graph_id", "name", "score", "rank")


def _directed(rows: DataFrame) -> DataFrame:
    """Rows with two different symbols and an agreed direction."""
    src, dst = F.trim("source_symbol"), F.trim("target_symbol")
    return rows.where((src != "") & (dst != "") & (src != dst) & F.col("is_directed") & F.col("consensus_direction"))


def _by_sign(up, down, other) -> Column:
    up_, down_ = F.col("is_stimulation") & ~F.col("is_inhibition"), F.col("is_inhibition") & ~F.col("is_stimulation")
    return F.when(up_, up).when(down_, down).otherwise(other)


def first_interactions(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Of interactions between symbols that any graph knows, the first arrival of each pair and sign; known: (graph_id, symbol).

    A graph's edges keep the first arrival of each, so it is found once for all graphs, before rows are matched with them. Blank and
    self pairs are left to interaction_edges, which then tests a row for each pair and not each arrival.
    """
    keys = known.select(match_key("symbol").alias("_a")).distinct()
    held = rows.where(F.col("is_directed") & F.col("consensus_direction"))
    for end in ("source_symbol", "target_symbol"):
        held = held.withColumn("_a", match_key(end)).join(keys, "_a", "left_semi").drop("_a")
    first = F.min_by(F.struct(*rows.columns), F.struct("ord"))
    return held.groupBy(F.trim("source_symbol"), F.trim("target_symbol"), _by_sign(1, -1, 0)).agg(first.alias("_first")).select("_first.*")


def interaction_edges(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Signed regulatory edges between known symbols; known: (graph_id, symbol).

    Blank and self pairs, undirected rows and rows without consensus drop. Both ends are matched by key and keep
    their own spelling. Two semi joins become one join on each end's key, as graphs differ in what they know.
    """
    src, dst = F.trim("source_symbol"), F.trim("target_symbol")
    keys = known.select("graph_id", match_key("symbol").alias("k")).distinct()
    good = _directed(rows).withColumn("_a", match_key("source_symbol")).withColumn("_b", match_key("target_symbol"))
    good = good.join(keys.withColumnRenamed("k", "_a"), "_a").join(keys.withColumnRenamed("k", "_b"), ["graph_id", "_b"], "left_semi")
    sources = F.col("primary_sources") if dict(rows.dtypes)["primary_sources"].startswith("array") else split_list("primary_sources")
    return good.select(
        "graph_id", F.concat(F.lit("gene:"), src).alias("source_id"), F.concat(F.lit("gene:"), dst).alias("target_id"),
        _by_sign("activates", "inhibits", "regulates").alias("edge_type"),
        F.least(F.lit(1.0), 0.5 + 0.05 * F.size(sources)).alias("weight"), F.lit("OmniPath").alias("source_db"), F.lit("regulatory").alias("evidence_class"),
        _by_sign(1, -1, 0).alias("sign"), sources.alias("primary_sources"), pubmed_ids("references").alias("pmids"),
    )


def interaction_flags(raw: DataFrame) -> DataFrame:
    """Text flags as booleans; anything unknown is false."""
    flags = [c for c in ("is_directed", "consensus_direction", "is_stimulation", "is_inhibition") if c in raw.columns]
    return raw.withColumns({c: flag(c) for c in flags})


def respelled(rows: DataFrame, symbols: DataFrame) -> DataFrame:
    """Interactions with both ends in symbols (by key), in the spelling of symbols."""
    names = symbols.select(match_key("symbol").alias("_k"), F.col("symbol").alias("_s")).dropDuplicates(["_k"])
    for end in ("source_symbol", "target_symbol"):
        rows = rows.withColumn("_k", match_key(end)).join(names, "_k").withColumn(end, F.col("_s")).drop("_k", "_s")
    return rows


def restrict_to_frame(nodes: DataFrame, edges: DataFrame, frame: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes and edges inside a frame, and the exclusions counted by source and reason.

    frame: (graph_id, node_id, name), the release's spelling. Pathogen genes go by type; gene-like nodes off the frame
    go; matches take the frame's id and name, and edges follow. Edges that touch a dropped node go.
    """
    known = frame.select("graph_id", match_key("node_id").alias("_k"), F.col("node_id").alias("_id"), F.col("name").alias("_name"))
    rows = nodes.withColumn("_k", match_key("node_id")).join(known, ["graph_id", "_k"], "left")
    why = F.when(F.col("node_type") == "pathogen_gene", "excluded_by_type").when(F.col("node_type").isin(*GENE_LIKE) & F.col("_id").isNull(), "off_frame")
    rows = rows.withColumn("reason", why)
    gone = rows.where("reason is not null")
    counts = gone.groupBy("graph_id", "source", "reason").agg(F.count("*").alias("n"))
    kept = rows.where("reason is null").select(*(F.coalesce("_id", "node_id").alias(c) if c == "node_id" else F.coalesce("_name", "name").alias(c) if c == "name" else F.col(c) for c in nodes.columns))
    for end in ("source_id", "target_id"):
        drop = gone.select("graph_id", F.col("node_id").alias(end))
        edges = edges.join(drop, ["graph_id", end], "left_anti")
        spelled = known.select("graph_id", "_k", "_id")
        edges = edges.withColumn("_k", match_key(end)).join(spelled, ["graph_id", "_k"], "left").withColumn(end, F.coalesce("_id", end)).drop("_k", "_id")
    return kept, edges, counts


def enrich(nodes: DataFrame, extra: DataFrame) -> DataFrame:
    """Fill-if-empty of uniprot_id and description, and further metadata, by symbol key; pinned nodes are skipped."""
    facts = extra.select(match_key("symbol").alias("_k"), F.col("uniprot_id").alias("_u"), F.col("description").alias("_d"), F.col("metadata").alias("_m")).dropDuplicates(["_k"])
    rows = nodes.withColumn("_k", F.when(~F.coalesce(F.col("pinned"), F.lit(False)), match_key("name"))).join(facts, "_k", "left")
    fill = lambda a, b: F.when(F.coalesce(F.col(a), F.lit("")) == "", F.col(b)).otherwise(F.col(a))
    empty = F.create_map().cast("map<string,string>")
    more = F.map_filter(F.coalesce("_m", empty), lambda k, v: ~F.map_contains_key(F.coalesce("metadata", empty), k))
    return rows.withColumns({"uniprot_id": fill("uniprot_id", "_u"), "description": fill("description", "_d"), "metadata": F.map_concat(F.coalesce("metadata", empty), more)}).drop("_k", "_u", "_d", "_m")


def add_structures(nodes: DataFrame, structures: DataFrame, most: int = 3) -> DataFrame:
    """pdb_ids joined with an accession's best structures: with a ligand first, then by resolution."""
    order = Window.partitionBy("accession").orderBy(F.desc("has_ligand"), "resolution", "pdb_id")
    best = structures.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most)
    lists = best.groupBy("accession").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "pdb_id"))), lambda x: x["pdb_id"]).alias("_p"))
    rows = nodes.join(lists, nodes["uniprot_id"] == lists["accession"], "left")
    none = F.array().cast("array<string>")
    return rows.withColumn("pdb_ids", F.array_union(F.coalesce("pdb_ids", none), F.coalesce("_p", none))).drop("accession", "_p")


def node_counts(nodes: DataFrame) -> DataFrame:
    of = lambda t: F.count_if(F.col("node_type") == t)
    return nodes.groupBy("graph_id").agg(of("gene").alias("n_genes"), of("protein").alias("n_proteins"), of("pathway").alias("n_pathways"))


def causal_subgraph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Admissible edges, and the nodes that they touch."""
    kept = edges.where(admissible())
    ends = kept.select("graph_id", F.explode(F.array("source_id", "target_id")).alias("node_id")).distinct()
    return nodes.join(ends, ["graph_id", "node_id"], "left_semi"), kept


def mutilated(edges: DataFrame, node: str) -> DataFrame:
    """The interventional graph: no edges into the node."""
    return edges.where(F.col("target_id") != node)


def candidates(nodes: DataFrame, disease_id: str | None = None, frame: DataFrame | None = None) -> DataFrame:
    """Candidate nodes with a reason where one is excluded (null: evaluated)."""
    rows = nodes.where(F.col("node_type").isin("gene", "protein", "pathogen_gene"))
    if disease_id is not None:
        rows = rows.where(F.col("node_id") != disease_id)
    if frame is None:
        return rows.withColumn("reason", F.lit(None).cast("string"))
    known = frame.select("graph_id", match_key("symbol").alias("_k"), F.lit(True).alias("_in")).distinct()
    rows = rows.withColumn("_k", match_key("name")).join(known, ["graph_id", "_k"], "left")
    why = F.when(F.col("node_type") == "pathogen_gene", "excluded_by_type").when(F.col("_in").isNull(), "off_frame")
    return rows.withColumn("reason", why).drop("_k", "_in")


def disease_node(nodes: DataFrame) -> DataFrame:
    """graph_id, disease_node: the first disease node, else the first whose name contains the graph's id."""
    prio = F.when(F.col("node_type") == "disease", 0).when(F.lower("name").contains(F.lower("graph_id")), 1)
    return nodes.where(prio.isNotNull()).groupBy("graph_id").agg(F.min_by("node_id", F.struct(prio.alias("p"), "ord")).alias("disease_node"))


def augment(edges: DataFrame, learned: DataFrame) -> DataFrame:
    """Learned edges (graph_id, source_id, target_id, confidence) added, or taking over where more confident."""
    held = edges.alias("e").join(learned.alias("l"), ["graph_id", "source_id", "target_id"], "full")
    new = F.col("e.weight").isNull() | (F.col("l.confidence") > F.col("e.weight"))
    return held.select("graph_id", "source_id", "target_id", F.when(new, "learned").otherwise(F.col("e.edge_type")).alias("edge_type"), F.when(new, F.col("l.confidence")).otherwise(F.col("e.weight")).alias("weight"))


def by_provenance(edges: DataFrame) -> DataFrame:
    return edges.groupBy("graph_id", "source_db").agg(F.count("*").alias("n"), F.round(F.avg("weight"), 4).alias("mean_weight"))
