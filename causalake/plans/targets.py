"""Queries over targets, paths, identification, candidates and molecules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import molecules as FM
from ..functions import proteins as FP
from ..functions import scores as S
from ..operators import bio_tables as BT
from ..operators import causal as C
from ..operators import components as CO
from ..operators import evidence as E
from ..operators import graph as G
from ..operators import molecules as M
from ..operators import paths as PA
from ..operators import ranking as R
from ..operators import records as RE
from ..operators import validation as V
from ..runtime import cut
from . import projections as P
from .associations import COLLISIONS_SQL

Q, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def whole_graph(spark, sf) -> DataFrame:
    """Resolved edges of every graph."""
    return G.resolve_collisions(P.edges(spark, sf))


@query(
    "reachability",
    f"""WITH RECURSIVE {COLLISIONS_SQL}, r(graph_id, treatment, node, hops) USING KEY (graph_id, treatment, node) AS (SELECT DISTINCT graph_id, source_id, source_id, 0 FROM resolved
UNION SELECT r.graph_id, r.treatment, e.target_id, min(r.hops) + 1 FROM r JOIN resolved e ON r.graph_id = e.graph_id AND r.node = e.source_id
WHERE NOT EXISTS (SELECT 1 FROM recurring.r AS s WHERE s.graph_id = r.graph_id AND s.treatment = r.treatment AND s.node = e.target_id) GROUP BY 1, 2, 3)
SELECT graph_id, treatment, node, hops::INT AS hops FROM r""",
)
def _(spark, sf):
    g = cut(whole_graph(spark, sf), "whole-graph")
    return PA.reachable(g, g.select("graph_id", F.col("source_id").alias("treatment")).distinct())


def outcome_graph(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Edges and pairs: all edges, one from each node without out-edges to the disease, and a pair of each node with the disease."""
    e = cut(whole_graph(spark, sf).select("graph_id", "source_id", "target_id", "weight", "source_db"), "whole-graph")
    ids = e.select("graph_id", F.explode(F.array("source_id", "target_id")).alias("node_id")).distinct()
    ends = ids.join(e.select("graph_id", F.col("source_id").alias("node_id")).distinct(), ["graph_id", "node_id"], "left_anti")
    score = (F.substring("node_id", 2, 9).cast("int") % 10) / 10
    toward = ends.select("graph_id", F.col("node_id").alias("source_id"), F.lit("D").alias("target_id"), score.alias("weight"), F.lit("DB9").alias("source_db"))
    return e.unionByName(toward), ids.select("graph_id", F.col("node_id").alias("treatment"), F.lit("D").alias("outcome"))


@query(
    "path_strength",
    f"""WITH RECURSIVE {COLLISIONS_SQL}, ids AS (SELECT graph_id, source_id AS node FROM resolved UNION SELECT graph_id, target_id FROM resolved),
g AS (SELECT graph_id, source_id, target_id, weight FROM resolved UNION ALL
SELECT graph_id, node, 'D', substr(node, 2)::INT % 10 / 10.0::DOUBLE FROM ids WHERE NOT EXISTS (SELECT 1 FROM resolved e WHERE e.graph_id = ids.graph_id AND e.source_id = node)),
d(graph_id, node, hops, s) USING KEY (graph_id, node) AS (SELECT DISTINCT graph_id, 'D', 0, 1.0::DOUBLE FROM g
UNION SELECT d.graph_id, g.source_id, min(d.hops) + 1, max(d.s * coalesce(g.weight, 0.5::DOUBLE)) FROM d JOIN g ON d.graph_id = g.graph_id AND d.node = g.target_id
WHERE NOT EXISTS (SELECT 1 FROM recurring.d AS x WHERE x.graph_id = d.graph_id AND x.node = g.source_id) GROUP BY 1, 2),
w AS (SELECT graph_id, source_id AS a, target_id AS b FROM g UNION SELECT graph_id, target_id, source_id FROM g),
u(graph_id, node, hops) USING KEY (graph_id, node) AS (SELECT DISTINCT graph_id, 'D', 0 FROM g
UNION SELECT u.graph_id, w.a, min(u.hops) + 1 FROM u JOIN w ON u.graph_id = w.graph_id AND u.node = w.b
WHERE NOT EXISTS (SELECT 1 FROM recurring.u AS x WHERE x.graph_id = u.graph_id AND x.node = w.a) GROUP BY 1, 2)
SELECT ids.graph_id, ids.node AS treatment, d.hops::INT AS hops, round(CASE WHEN d.hops IS NOT NULL THEN d.s / (d.hops + 1) WHEN u.hops IS NOT NULL THEN 0.5 / (u.hops + 1) ELSE 0.1 END, 6)::DOUBLE AS strength
FROM ids LEFT JOIN d ON d.graph_id = ids.graph_id AND d.node = ids.node LEFT JOIN u ON u.graph_id = ids.graph_id AND u.node = ids.node""",
)
def _(spark, sf):
    # Rounded in binary, as the SQL engine does: products of short weights fall on decimal ties, which F.round takes upward.
    micro = F.floor(F.col("path_strength") * 1e6 + 0.5) / 1e6
    return PA.path_strength(*outcome_graph(spark, sf)).select("graph_id", "treatment", "hops", micro.alias("strength"))


@query("node_degrees", f"WITH {COLLISIONS_SQL}, e AS (SELECT graph_id, source_id AS node_id, 0 AS i, 1 AS o FROM resolved UNION ALL SELECT graph_id, target_id, 1, 0 FROM resolved) SELECT graph_id, node_id, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree FROM e GROUP BY 1, 2")
def _(spark, sf):
    return PA.degrees(G.resolve_collisions(P.edges(spark, sf)))


@query("message_passing", f"WITH {COLLISIONS_SQL}, f AS (SELECT DISTINCT 'G' || (p_partkey % 500)::VARCHAR AS node_id, (p_partkey % 500) % 10 AS v FROM part) SELECT graph_id, target_id AS node_id, edge_type, round(avg(v), 6) AS f0 FROM resolved JOIN f ON source_id = f.node_id GROUP BY 1, 2, 3")
def _(spark, sf):
    g = G.resolve_collisions(P.edges(spark, sf))
    f = g.select("graph_id", F.col("source_id").alias("node_id")).distinct().join(P.table(spark, sf, "part").select(P.symbol("p_partkey").alias("node_id")).distinct(), "node_id")
    f = f.withColumn("features", F.array((F.substring("node_id", 2, 9).cast("int") % 10).cast("double")))
    return PA.message_pass(g, f).select("graph_id", "node_id", "edge_type", F.round(F.col("features")[0], 6).alias("f0"))


@query("pagerank")
def _(spark, sf):
    return PA.pagerank(whole_graph(spark, sf)).withColumn("rank", F.round("rank", 8))


@query("near_misses", f"WITH {P.EDGES_SQL} SELECT a.graph_id, a.target_id AS treatment, b.target_id AS outcome, count(DISTINCT a.source_id) AS n FROM edges a JOIN edges b ON a.graph_id = b.graph_id AND a.source_id = b.source_id WHERE a.edge_type = 'activates' AND NOT (b.edge_type = 'activates' OR (b.edge_type = 'associated_with' AND b.evidence_class = 'genetic_association')) AND a.source_id <> a.target_id AND b.source_id <> b.target_id AND a.target_id <> b.target_id GROUP BY 1, 2, 3")
def _(spark, sf):
    return C.near_misses(P.edges(spark, sf))


def disease_graph(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and pairs: all edges and cycles, and an edge from each node to the disease; even nodes have genetic evidence."""
    e = cut(whole_graph(spark, sf).select("graph_id", "source_id", "target_id", "edge_type", "evidence_class", "weight", "source_db"), "whole-graph")
    ids = e.select("graph_id", F.explode(F.array("source_id", "target_id")).alias("node_id")).distinct()
    nodes = ids.withColumn("score", (F.substring("node_id", 2, 9).cast("int") % 10) / 10)
    kind = F.when(F.substring("node_id", 2, 9).cast("int") % 2 == 0, "genetic_association").otherwise("literature")
    toward = nodes.select("graph_id", F.col("node_id").alias("source_id"), F.lit("D").alias("target_id"), F.lit("associated_with").alias("edge_type"), kind.alias("evidence_class"), F.col("score").alias("weight"), F.lit("DB9").alias("source_db"))
    pairs = nodes.select("graph_id", F.col("node_id").alias("treatment"), F.lit("D").alias("outcome"), "score")
    return nodes, e.unionByName(toward), pairs


#: The same graph in SQL: all resolved edges, an edge from each node to the disease, even nodes with genetic evidence.
DISEASE_SQL = f"""{COLLISIONS_SQL}, ids AS (SELECT graph_id, source_id AS node FROM resolved UNION SELECT graph_id, target_id FROM resolved),
dg AS (SELECT graph_id, source_id AS a, target_id AS b, edge_type, {P.ADMISSIBLE_SQL} AS ok FROM resolved UNION ALL
SELECT graph_id, node, 'D', 'associated_with', substr(node, 2)::INT % 2 = 0 FROM ids),
adm AS (SELECT DISTINCT graph_id, a, b FROM dg WHERE ok)"""

#: Cyclic nodes reach themselves; all pairs of the rest that reach each other; the widest and the empty set by a search over
#: families; then all sets of up to three of the pool's ancestors, where the widest separates and the empty one doesn't.
IDENTIFICATION_SQL = f"""WITH RECURSIVE {DISEASE_SQL},
cyc0(graph_id, a, b) AS (SELECT graph_id, a, b FROM adm UNION SELECT c.graph_id, c.a, e.b FROM cyc0 c JOIN adm e ON e.graph_id = c.graph_id AND e.a = c.b),
cyc AS (SELECT DISTINCT graph_id, a AS node FROM cyc0 WHERE a = b),
dag AS (SELECT * FROM adm e WHERE NOT EXISTS (SELECT 1 FROM cyc c WHERE c.graph_id = e.graph_id AND c.node IN (e.a, e.b))),
nd AS (SELECT graph_id, a AS node FROM dag UNION SELECT graph_id, b FROM dag),
rc(graph_id, a, b) AS (SELECT graph_id, node, node FROM nd UNION SELECT r.graph_id, r.a, e.b FROM rc r JOIN dag e ON e.graph_id = r.graph_id AND e.a = r.b),
pr AS (SELECT ids.graph_id, ids.node AS x, EXISTS (SELECT 1 FROM cyc c WHERE c.graph_id = ids.graph_id AND c.node IN (ids.node, 'D')) AS loop,
 EXISTS (SELECT 1 FROM rc WHERE rc.graph_id = ids.graph_id AND rc.a = ids.node AND rc.b = 'D') AS path FROM ids),
ca AS (SELECT graph_id, x FROM pr WHERE path AND NOT loop),
pl AS (SELECT ca.graph_id, ca.x, nd.node, row_number() OVER (PARTITION BY ca.graph_id, ca.x ORDER BY CASE WHEN nd.node = 'D' THEN 0 ELSE substr(nd.node, 2)::INT % 10 END DESC, nd.node) AS pos
 FROM ca JOIN nd USING (graph_id) WHERE NOT EXISTS (SELECT 1 FROM rc WHERE rc.graph_id = ca.graph_id AND rc.a = ca.x AND rc.b = nd.node)),
po AS (SELECT * FROM pl WHERE pos <= 20), sz AS (SELECT graph_id, x, count(*) AS rest FROM pl GROUP BY 1, 2),
an AS (SELECT ca.graph_id, ca.x, rc.a AS node FROM ca JOIN rc ON rc.graph_id = ca.graph_id AND rc.b IN (ca.x, 'D') GROUP BY 1, 2, 3),
fam AS (SELECT graph_id, a AS node, b AS hub FROM dag UNION SELECT graph_id, node, node FROM nd),
cand AS (SELECT po.graph_id, po.x, po.pos FROM po JOIN an USING (graph_id, x, node)),
s0 AS (SELECT graph_id, x, 0 AS k, []::BIGINT[] AS z FROM ca UNION ALL
 SELECT ca.graph_id, ca.x, 9, coalesce((SELECT list(pos ORDER BY pos) FROM cand WHERE cand.graph_id = ca.graph_id AND cand.x = ca.x), []) FROM ca),
w0(graph_id, x, k, z, node) AS (SELECT graph_id, x, k, z, x FROM s0 UNION
 SELECT w.graph_id, w.x, w.k, w.z, m.node FROM w0 w JOIN fam h ON h.graph_id = w.graph_id AND h.node = w.node AND (w.node <> w.x OR h.hub = w.x)
 JOIN an ON an.graph_id = w.graph_id AND an.x = w.x AND an.node = h.hub JOIN fam m ON m.graph_id = w.graph_id AND m.hub = h.hub AND m.node <> w.x AND (h.hub <> 'D' OR m.node = 'D')
 LEFT JOIN po ON po.graph_id = w.graph_id AND po.x = w.x AND po.node = m.node WHERE po.pos IS NULL OR NOT list_contains(w.z, po.pos)),
sep0 AS (SELECT graph_id, x, k, z FROM s0 WHERE NOT EXISTS (SELECT 1 FROM w0 WHERE w0.graph_id = s0.graph_id AND w0.x = s0.x AND w0.k = s0.k AND w0.node = 'D')),
todo AS (SELECT graph_id, x FROM sep0 WHERE k = 9 AND (graph_id, x) NOT IN (SELECT graph_id, x FROM sep0 WHERE k = 0)),
one AS (SELECT graph_id, x, pos FROM cand JOIN todo USING (graph_id, x)),
s1 AS (SELECT graph_id, x, 1 AS k, [pos] AS z FROM one UNION ALL SELECT a.graph_id, a.x, 2, [a.pos, b.pos] FROM one a JOIN one b ON b.graph_id = a.graph_id AND b.x = a.x AND b.pos > a.pos UNION ALL
 SELECT a.graph_id, a.x, 3, [a.pos, b.pos, c.pos] FROM one a JOIN one b ON b.graph_id = a.graph_id AND b.x = a.x AND b.pos > a.pos JOIN one c ON c.graph_id = a.graph_id AND c.x = a.x AND c.pos > b.pos),
w1(graph_id, x, k, z, node) AS (SELECT graph_id, x, k, z, x FROM s1 UNION
 SELECT w.graph_id, w.x, w.k, w.z, m.node FROM w1 w JOIN fam h ON h.graph_id = w.graph_id AND h.node = w.node AND (w.node <> w.x OR h.hub = w.x)
 JOIN an ON an.graph_id = w.graph_id AND an.x = w.x AND an.node = h.hub JOIN fam m ON m.graph_id = w.graph_id AND m.hub = h.hub AND m.node <> w.x AND (h.hub <> 'D' OR m.node = 'D')
 LEFT JOIN po ON po.graph_id = w.graph_id AND po.x = w.x AND po.node = m.node WHERE po.pos IS NULL OR NOT list_contains(w.z, po.pos)),
hit AS (SELECT DISTINCT graph_id, x, z FROM w1 WHERE node = 'D'),
sep AS (SELECT graph_id, x, 0 AS k, z FROM sep0 WHERE k = 0 UNION ALL SELECT s1.* FROM s1 ANTI JOIN hit USING (graph_id, x, z)),
best AS (SELECT graph_id, x, z FROM sep QUALIFY row_number() OVER (PARTITION BY graph_id, x ORDER BY k, z) = 1),
names AS (SELECT best.graph_id, best.x, coalesce(list(po.node ORDER BY po.pos) FILTER (po.node IS NOT NULL), []) AS names FROM best LEFT JOIN po ON po.graph_id = best.graph_id AND po.x = best.x AND list_contains(best.z, po.pos) GROUP BY 1, 2),
near AS (SELECT u.graph_id, u.b AS x, count(DISTINCT u.a) AS n FROM dg u JOIN dg v ON v.graph_id = u.graph_id AND v.a = u.a AND v.b = 'D' AND NOT v.ok WHERE u.edge_type = 'activates' AND u.a <> u.b GROUP BY 1, 2)
SELECT pr.graph_id, pr.x AS treatment, 'D' AS outcome, names.x IS NOT NULL AS identifiable,
 CASE WHEN loop THEN 'cyclic_component' WHEN NOT path THEN 'no_causal_path' WHEN names.x IS NULL THEN 'no_valid_adjustment_set' WHEN len(names) > 0 THEN 'identifiable_by_adjustment' ELSE 'identifiable_trivially' END AS reason,
 coalesce(names, []) AS adjustment_set, CASE WHEN path AND NOT loop THEN coalesce(near.n, 0) ELSE 0 END AS n_near_miss, coalesce(path AND NOT loop AND names.x IS NULL AND rest > 3, false) AS truncated
FROM pr LEFT JOIN names ON names.graph_id = pr.graph_id AND names.x = pr.x LEFT JOIN near ON near.graph_id = pr.graph_id AND near.x = pr.x LEFT JOIN sz ON sz.graph_id = pr.graph_id AND sz.x = pr.x"""


@query("identification", IDENTIFICATION_SQL)
def _(spark, sf):
    nodes, e, pairs = disease_graph(spark, sf)
    return C.identification(e, nodes, pairs)


@query(
    "identification_summary",
    f"""WITH v AS ({IDENTIFICATION_SQL}), k AS (SELECT unnest(['identifiable_by_adjustment', 'identifiable_trivially', 'no_causal_path', 'cyclic_component', 'no_valid_adjustment_set', 'treatment_absent', 'outcome_absent']) AS reason),
c AS (SELECT k.reason, count(v.reason) AS n, avg(v.n_near_miss) FILTER (v.reason = 'identifiable_trivially') AS m FROM k LEFT JOIN v ON v.reason = k.reason GROUP BY 1)
SELECT reason, n, CASE WHEN sum(n) OVER () > 0 THEN round(n / sum(n) OVER (), 6) ELSE 0 END::DOUBLE AS share, round(m, 6) AS mean_near_miss FROM c""",
)
def _(spark, sf):
    nodes, e, pairs = disease_graph(spark, sf)
    return V.identification_summary(C.identification(e, nodes, pairs))


@query(
    "cyclic_components",
    f"""WITH RECURSIVE {COLLISIONS_SQL}, e AS (SELECT DISTINCT graph_id, source_id AS a, target_id AS b FROM resolved WHERE {P.ADMISSIBLE_SQL}),
r(graph_id, a, b) AS (SELECT graph_id, a, b FROM e UNION SELECT r.graph_id, r.a, e.b FROM r JOIN e ON e.graph_id = r.graph_id AND e.a = r.b),
m AS (SELECT x.graph_id, x.a AS node_id, min(x.b) AS least FROM r x JOIN r y ON y.graph_id = x.graph_id AND y.a = x.b AND y.b = x.a GROUP BY 1, 2)
SELECT graph_id, (dense_rank() OVER (PARTITION BY graph_id ORDER BY least) - 1)::INT AS component, node_id FROM m""",
)
def _(spark, sf):
    return CO.cyclic_components(whole_graph(spark, sf).where(G.admissible()))


@query(
    "betweenness",
    f"""WITH RECURSIVE {COLLISIONS_SQL}, e AS (SELECT DISTINCT graph_id, source_id AS a, target_id AS b FROM resolved WHERE source_id <> target_id),
r(graph_id, s, t, hops, ways) USING KEY (graph_id, s, t) AS (SELECT DISTINCT graph_id, a, a, 0, 1.0::DOUBLE FROM e
UNION SELECT r.graph_id, r.s, e.b, min(r.hops) + 1, sum(r.ways) FROM r JOIN e ON e.graph_id = r.graph_id AND e.a = r.t
WHERE NOT EXISTS (SELECT 1 FROM recurring.r AS k WHERE k.graph_id = r.graph_id AND k.s = r.s AND k.t = e.b) GROUP BY 1, 2, 3),
p AS (SELECT * FROM r),
b AS (SELECT x.graph_id, x.t AS v, sum(x.ways * y.ways / z.ways) AS share FROM p x JOIN p y ON y.graph_id = x.graph_id AND y.s = x.t JOIN p z ON z.graph_id = x.graph_id AND z.s = x.s AND z.t = y.t AND z.hops = x.hops + y.hops
WHERE x.s <> x.t AND y.s <> y.t AND x.s <> y.t GROUP BY 1, 2),
ids AS (SELECT graph_id, source_id AS node_id FROM resolved UNION SELECT graph_id, target_id FROM resolved), n AS (SELECT graph_id, count(*) AS n FROM ids GROUP BY 1)
SELECT ids.graph_id, ids.node_id, round(coalesce(share, 0) / CASE WHEN n > 2 THEN (n - 1) * (n - 2) ELSE 1 END, 8) AS betweenness
FROM ids JOIN n USING (graph_id) LEFT JOIN b ON b.graph_id = ids.graph_id AND b.v = ids.node_id""",
)
def _(spark, sf):
    return CO.betweenness(whole_graph(spark, sf)).withColumn("betweenness", F.round("betweenness", 8))


@query("counterfactual")
def _(spark, sf):
    nodes, e, pairs = disease_graph(spark, sf)
    return C.counterfactual(e, nodes, pairs)


@query("robustness")
def _(spark, sf):
    nodes, e, pairs = disease_graph(spark, sf)
    out = E.robustness(cut(e, "disease-edges"), cut(pairs, "disease-pairs"))
    return out.select("graph_id", "treatment", "outcome", *(F.round(c, 6).alias(c) for c in ("source_stability", "path_robustness", "degree_robustness", "robustness")))


CONF_SQL = """SELECT id, round(least(1.0, greatest(0.0, 0.30 * least(1.0, novelty * 1.5) + 0.25 * conf + 0.15 * (id % 2 = 0)::INT + 0.10 * least(1.0, (n_filters / 4.0) * novelty)
 + 0.10 * least(1.0, CASE WHEN hbd > 0 THEN 1 / log2(hbd + 2) ELSE 0.5 END) + 0.10 * (0.3 + CASE WHEN pains THEN 0.2 ELSE 0 END + CASE WHEN reactive THEN 0.1 ELSE 0 END + CASE WHEN basic_nitrogen THEN 0.15 ELSE 0 END))), 4)::DOUBLE AS confidence, conf, n_filters, pains, reactive FROM molecules"""


@query(
    "target_classification",
    f"""WITH {P.MOLECULES_SQL}, c AS ({CONF_SQL})
SELECT id, confidence, CASE WHEN reactive THEN 'correlational' WHEN pains THEN 'correlational' WHEN confidence >= 0.6 AND conf >= 0.4 AND id % 2 = 0 AND (n_filters >= 2 OR n_filters = 0) THEN 'causal'
 WHEN confidence < 0.4 OR conf < 0.3 THEN 'correlational' ELSE 'inconclusive' END AS label FROM c""",
)
def _(spark, sf):
    m = P.molecules(spark, sf)
    drug = S.druggability("pains", "reactive", F.lit(False), "basic_nitrogen", F.lit(""))
    conf = S.causal_confidence(F.col("novelty") * 1.5, "conf", F.col("id") % 2 == 0, S.consensus("n_filters", F.lit(4), "novelty"), S.specificity("hbd"), drug)
    m = m.withColumn("confidence", conf)
    kind = F.when(F.col("reactive"), "host_symptom").otherwise("host_immune")
    return m.select("id", "confidence", S.classification("confidence", "conf", F.col("id") % 2 == 0, "n_filters", kind, ~F.col("pains")).alias("label"))


@query(
    "quota_ranking",
    """WITH r AS (SELECT p_brand AS graph_id, p_partkey AS ord, CASE WHEN p_partkey % 3 = 0 THEN 'pathogen_direct' ELSE 'host' END AS target_type, (p_partkey % 50) / 50.0::DOUBLE AS c FROM part),
a AS (SELECT *, c >= 0.3 AS ok, row_number() OVER (PARTITION BY graph_id, target_type, c >= 0.3 ORDER BY c DESC, ord) AS i FROM r),
b AS (SELECT *, ok AND i <= 5 AS q FROM a), d AS (SELECT *, 10 - sum(q::INT) OVER (PARTITION BY graph_id) AS free, row_number() OVER (PARTITION BY graph_id, ok AND NOT q ORDER BY c DESC, ord) AS s FROM b)
SELECT graph_id, ord AS id, target_type, c AS causal_confidence, row_number() OVER (PARTITION BY graph_id ORDER BY c DESC, ord)::INT AS rank FROM d WHERE q OR (ok AND NOT q AND s <= free)""",
)
def _(spark, sf):
    p = P.table(spark, sf, "part")
    r = p.select(F.col("p_brand").alias("graph_id"), F.col("p_partkey").alias("ord"), F.when(F.col("p_partkey") % 3 == 0, "pathogen_direct").otherwise("host").alias("target_type"), (F.col("p_partkey") % 50 / 50.0).alias("causal_confidence"))
    return R.quota_ranking(r).withColumnRenamed("ord", "id")


#: Half up on the shortest decimal form, as Spark rounds; the other engine rounds the binary value.
ROUND4 = "round(({})::VARCHAR::DECIMAL(30, 18), 4)::DOUBLE"
CAND_SQL = "SELECT id, " + ROUND4.format("""0.30::DOUBLE * least(1, greatest(0, conf)) + 0.25::DOUBLE * coalesce(least(1, greatest(0, affinity / -12.0::DOUBLE)), 0.5::DOUBLE) + 0.15::DOUBLE * coalesce(least(1, greatest(0, qed)), 0.5::DOUBLE)
 + 0.10::DOUBLE * coalesce(least(1, greatest(0, (10 - sa) / 9.0::DOUBLE)), 0.5::DOUBLE) + 0.10::DOUBLE * 0.5::DOUBLE + 0.10::DOUBLE * novelty""") + """ AS composite_score,
 coalesce(qed, 0.5) >= 0.4 AND mw BETWEEN 150 AND 500 AND n_filters >= 2 AS is_drug_like, novelty >= 0.7 AS is_novel FROM molecules"""


@query("candidate_scores", f"WITH {P.MOLECULES_SQL} {CAND_SQL}")
def _(spark, sf):
    return scored(spark, sf).select("id", "composite_score", "is_drug_like", "is_novel")


def scored(spark, sf) -> DataFrame:
    m = P.molecules(spark, sf)
    return R.scored_candidates(m.select("id", F.col("conf").alias("causal_confidence"), F.col("affinity").alias("binding_affinity"), F.col("qed").alias("qed_score"), F.col("sa").alias("sa_score"), F.lit(0.5).alias("admet_score"), F.col("novelty").alias("novelty_score"), F.col("mw").alias("molecular_weight"), F.col("n_filters").alias("n_filters_passed")))


@query("candidate_ranking", f"WITH {P.MOLECULES_SQL}, c AS ({CAND_SQL}) SELECT id, composite_score, row_number() OVER (ORDER BY composite_score DESC, id)::INT AS rank FROM c")
def _(spark, sf):
    return R.ranked(scored(spark, sf).select("id", "composite_score"), "composite_score", ["id"])


@query("docking_composite", f"WITH {P.MOLECULES_SQL} SELECT id, round(0.40 / (1 + exp(coalesce(affinity, 0.0) + 7)) + 0.25 * coalesce(qed, 0.0) + 0.15 * least(1, greatest(0, (10 - coalesce(sa, 5.0)) / 9.0)) + 0.20 * (n_filters / 4.0), 4)::DOUBLE AS composite FROM molecules")
def _(spark, sf):
    return P.molecules(spark, sf).select("id", S.docking_composite("affinity", "qed", "sa", F.col("n_filters") / 4.0).alias("composite"))


ADMET_SQL = """SELECT id, (mw > 500)::INT + (logp > 5)::INT + (hbd > 5)::INT + (hba > 10)::INT AS b, * EXCLUDE (id) FROM molecules"""


@query(
    "admet_profile",
    f"""WITH {P.MOLECULES_SQL}, a AS ({ADMET_SQL}), p AS (SELECT id,
 least(1, greatest(0, CASE b WHEN 0 THEN 1.0 WHEN 1 THEN 0.7 ELSE greatest(0.1, 1 - b * 0.25) END - CASE WHEN rotatable > 10 THEN 0.15 ELSE 0 END - CASE WHEN tpsa > 140 THEN 0.2 ELSE 0 END))::DOUBLE AS absorption,
 least(1, greatest(0, CASE WHEN tpsa <= 90 AND mw <= 400 AND logp BETWEEN 1 AND 3 THEN 0.9 ELSE 0.7 END + CASE WHEN tpsa <= 131.6 AND logp <= 5.88 THEN 0.1 ELSE -0.1 END - CASE WHEN logp > 4 THEN 0.1 ELSE 0 END))::DOUBLE AS distribution,
 least(1, greatest(0, 0.7 - CASE WHEN aromatic >= 3 AND mw > 400 THEN 0.2 WHEN aromatic >= 4 THEN 0.15 ELSE 0 END + CASE WHEN mw BETWEEN 200 AND 450 THEN 0.1 WHEN mw > 600 THEN -0.15 ELSE 0 END))::DOUBLE AS metabolism,
 least(1, greatest(0, CASE WHEN mw < 300 AND logp < 2 THEN 0.85 WHEN mw > 500 THEN 0.55 ELSE 0.7 END + CASE WHEN logp BETWEEN 1 AND 3 THEN 0.1 ELSE 0 END))::DOUBLE AS excretion,
 least(1, greatest(0, 0.8 - CASE WHEN basic_nitrogen AND logp > 3.5 THEN 0.25 ELSE 0 END - CASE WHEN pains THEN 0.3 ELSE 0 END - CASE WHEN reactive THEN 0.2 ELSE 0 END))::DOUBLE AS toxicity FROM a)
SELECT id, round(absorption, 3) AS absorption, round(distribution, 3) AS distribution, round(metabolism, 3) AS metabolism, round(excretion, 3) AS excretion, round(toxicity, 3) AS toxicity FROM p""",
)
def _(spark, sf):
    prof = S.admet_profile("mw", "logp", "hbd", "hba", "tpsa", "rotatable", "aromatic", "atoms", "basic_nitrogen", "pains", "reactive")
    return P.molecules(spark, sf).select("id", *(prof[k].alias(k) for k in ("absorption", "distribution", "metabolism", "excretion", "toxicity")))


@query("quick_admet", f"WITH {P.MOLECULES_SQL} SELECT id, round(least(1, greatest(0, 0.5 + CASE WHEN mw BETWEEN 150 AND 500 THEN 0.2 WHEN mw > 500 THEN -0.1 ELSE 0 END + CASE WHEN logp BETWEEN -0.4 AND 5.6 THEN 0.2 WHEN logp IS NOT NULL THEN -0.1 ELSE 0 END + CASE WHEN qed > 0.5 THEN 0.1 ELSE 0 END)), 4)::DOUBLE AS score FROM molecules")
def _(spark, sf):
    return P.molecules(spark, sf).select("id", F.round(S.quick_admet("mw", "logp", "qed"), 4).alias("score"))


@query(
    "molecule_filters",
    f"""WITH {P.MOLECULES_SQL} SELECT id, (mw > 500)::INT + (logp > 5)::INT + (hbd > 5)::INT + (hba > 10)::INT <= 1 AS lipinski, rotatable <= 10 AND tpsa <= 140 AS veber,
 mw BETWEEN 160 AND 480 AND logp BETWEEN -0.4 AND 5.6 AND refractivity BETWEEN 40 AND 130 AND atoms BETWEEN 20 AND 70 AS ghose, tpsa <= 131.6 AND logp <= 5.88 AS egan,
 mw BETWEEN 150 AND 500 AND logp BETWEEN -1 AND 5 AND hbd <= 5 AND hba <= 10 AS drug_like FROM molecules""",
)
def _(spark, sf):
    m = P.molecules(spark, sf)
    rep = FM.filter_report(mw="mw", logp="logp", hbd="hbd", hba="hba", rotatable="rotatable", tpsa="tpsa", refractivity="refractivity", atoms="atoms")
    m = m.withColumn("r", rep)
    return m.select("id", *(F.col("r")[i]["passed"].alias(k) for i, k in enumerate(("lipinski", "veber", "ghose", "egan"))), FM.drug_like_range("mw", "logp", "hbd", "hba").alias("drug_like"))


@query("druggability", f"WITH {P.MOLECULES_SQL} SELECT id, round(0.3 + pains::INT * 0.2 + reactive::INT * 0.1 + basic_nitrogen::INT * 0.15 + (id % 23 = 0)::INT * 0.15 + regexp_matches(lower(p_name), 'receptor|kinase|protease|enzyme|channel|transporter|gpcr')::INT * 0.15, 4)::DOUBLE AS score FROM molecules")
def _(spark, sf):
    return P.molecules(spark, sf).select("id", F.round(S.druggability("pains", "reactive", "basic_nitrogen", F.col("id") % 23 == 0, "p_name"), 4).alias("score"))


@query(
    "pathogen_targets",
    f"""WITH {P.MOLECULES_SQL}, a AS (SELECT id, hbd % 5 AS phase, n_filters AS n_drugs, novelty AS ds, CASE id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.3 ELSE 0.0 END AS rel FROM molecules),
b AS (SELECT *, round(0.40 * ds + 0.25 * CASE WHEN phase >= 3 THEN 1.0 ELSE 0.8 END + 0.10 * rel + 0.09, 4)::DOUBLE AS confidence,
 round(least(1.0, CASE WHEN phase >= 4 THEN 0.9 WHEN phase >= 3 THEN 0.7 WHEN phase >= 2 THEN 0.5 WHEN phase >= 1 THEN 0.3 ELSE 0 END + CASE WHEN n_drugs >= 3 THEN 0.1 ELSE 0 END) * CASE WHEN rel < 0.5 THEN 0.3 ELSE 1 END, 4)::DOUBLE AS robustness FROM a)
SELECT id, confidence, robustness, CASE WHEN confidence >= 0.6 AND robustness >= 0.4 THEN 'causal' WHEN confidence >= 0.4 THEN 'inconclusive' ELSE 'correlational' END AS label FROM b""",
)
def _(spark, sf):
    m = P.molecules(spark, sf)
    organism = F.when(F.col("id") % 3 == 0, "Plasmodium falciparum").when(F.col("id") % 3 == 1, "Escherichia coli").otherwise("")
    m = m.select("id", (F.col("hbd") % 5).alias("phase"), "n_filters", "novelty", S.organism_relevance(organism, F.lit("Malaria")).alias("rel"))
    v = S.pathogen_scores("novelty", "phase", "n_filters", "rel", F.lit(False))
    return m.select("id", v["confidence"].alias("confidence"), F.round(v["robustness"], 4).alias("robustness"), v["label"].alias("label"))


STAR = """star AS (SELECT l_partkey AS tid, c_mktsegment AS drug, o_orderpriority AS mechanism, (l_linenumber % 5)::INT AS phase, n_name AS organism FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey
 JOIN part ON p_partkey = l_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN nation ON n_nationkey = s_nationkey WHERE lower(o_orderstatus) LIKE '%f%' OR lower(c_mktsegment) LIKE '%auto%')"""
ROLL = "SELECT tid, max(phase) AS max_phase, count(DISTINCT drug) AS n_drugs, count(DISTINCT mechanism) AS n_mechanisms FROM star GROUP BY 1"


@query("drug_targets", f"WITH {STAR}, r AS ({ROLL}) SELECT *, round(0.60 * CASE max_phase WHEN 4 THEN 1.0 WHEN 3 THEN 0.8 WHEN 2 THEN 0.6 WHEN 1 THEN 0.4 ELSE 0.1 END + 0.20 * least(1.0, log2(n_drugs + 1) / log2(11)) + 0.20 * least(1.0, n_mechanisms / 4.0), 4)::DOUBLE AS score FROM r")
def _(spark, sf):
    return drug_targets(spark, sf)


def drug_targets(spark, sf) -> DataFrame:
    """Drugs indicated -> mechanisms -> targets: a six-table star and its roll-up by target."""
    from ..sources.drugs import roll_up, star

    t = lambda n: P.table(spark, sf, n)
    # Orders as indications, lines as mechanisms, parts as targets, suppliers as components, nations as their sequences.
    indications = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    indications = indications.select(F.col("o_orderkey").alias("molregno"), F.col("o_orderstatus").alias("mesh_heading"), F.col("c_mktsegment").alias("efo_term"), F.col("c_mktsegment").alias("drug"), F.col("o_orderpriority").alias("mechanism_of_action"))
    mechanisms = t("lineitem").select(F.col("l_orderkey").alias("molregno"), F.col("l_partkey").alias("tid"), (F.col("l_linenumber") % 5).alias("max_phase_for_ind"))
    targets = t("part").select(F.col("p_partkey").alias("tid"), F.col("p_name").alias("pref_name"), F.col("p_brand").alias("organism"), F.col("p_type").alias("target_type"))
    components = t("supplier").select(F.col("s_suppkey").alias("tid"), F.col("s_nationkey").alias("component_id"))
    sequences = t("nation").select(F.col("n_nationkey").alias("component_id"), F.col("n_name").alias("accession"))
    return roll_up(star(indications, None, mechanisms, targets, components, sequences, "f", "auto"))


@query("top_drug_targets", f"WITH {STAR}, r AS ({ROLL}), t AS (SELECT * FROM r ORDER BY max_phase DESC, n_drugs DESC, tid LIMIT 50) SELECT tid, max_phase, n_drugs FROM t WHERE tid % 4 <> 0")
def _(spark, sf):
    from ..sources.drugs import top_targets

    return top_targets(drug_targets(spark, sf).withColumn("target_type", F.when(F.col("tid") % 4 == 0, "cell-line").otherwise("single protein")), 50).select("tid", "max_phase", "n_drugs")


@query("generation_metrics", "WITH v AS (SELECT CASE WHEN length(text) > 100 THEN md5(text) END AS c FROM documents), u AS (SELECT DISTINCT c FROM v WHERE c IS NOT NULL), t AS (SELECT DISTINCT md5(text) AS c FROM documents WHERE doc_id % 3 = 0) SELECT (SELECT count(*) FROM v) AS n, round((SELECT count(c) FROM v) / (SELECT count(*) FROM v), 6)::DOUBLE AS validity, round((SELECT count(*) FROM u) / (SELECT count(c) FROM v), 6)::DOUBLE AS uniqueness, round((SELECT count(*) FROM u ANTI JOIN t USING (c)) / (SELECT count(*) FROM u), 6)::DOUBLE AS novelty")
def _(spark, sf):
    d = P.table(spark, sf, "documents")
    gen = d.select(F.col("text").alias("smiles"), F.when(F.length("text") > 100, F.md5("text")).alias("canonical"))
    return M.generation_metrics(gen, d.where("doc_id % 3 = 0").select(F.md5("text").alias("canonical")))


@query("diversity")
def _(spark, sf):
    return M.diversity(P.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), FM.sign_bits("embedding").alias("fp")))


SUMMARY_COLUMNS = ["mw", "logp", "tpsa"]
UNPIVOT = "u AS (SELECT *, unnest(['mw', 'logp', 'tpsa']) AS property, unnest([mw, logp, tpsa]) AS value FROM molecules)"


@query("property_summary", f"WITH {P.MOLECULES_SQL}, {UNPIVOT} SELECT property, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS min, max(value) AS max, median(value) AS median FROM u GROUP BY 1")
def _(spark, sf):
    return M.property_summary(P.molecules(spark, sf), SUMMARY_COLUMNS)


@query(
    "ks_test",
    f"""WITH {P.MOLECULES_SQL}, {UNPIVOT}, c AS (SELECT property, value, count_if(hbd > 3) AS a, count_if(NOT hbd > 3) AS b FROM u GROUP BY 1, 2),
d AS (SELECT property, abs(sum(a) OVER w / sum(a) OVER (PARTITION BY property) - sum(b) OVER w / sum(b) OVER (PARTITION BY property)) AS d FROM c WINDOW w AS (PARTITION BY property ORDER BY value ROWS UNBOUNDED PRECEDING)) SELECT property, round(max(d), 6)::DOUBLE AS statistic FROM d GROUP BY 1""",
)
def _(spark, sf):
    return M.ks_statistic(P.molecules(spark, sf).withColumn("s", F.col("hbd") > 3), SUMMARY_COLUMNS, "s").select("property", "statistic")


@query("min_max_scaling", f"WITH {P.MOLECULES_SQL} SELECT id, round((mw - (SELECT min(mw) FROM molecules)) / (SELECT max(mw) - min(mw) FROM molecules), 6) AS mw_scaled FROM molecules")
def _(spark, sf):
    return M.min_max(P.molecules(spark, sf).select("id", "mw"), ["mw"]).select("id", F.round("mw_scaled", 6).alias("mw_scaled"))


@query("smiles_vocabulary", "WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(p_name, '(Br|Cl|@@|@|%\\d{2}|.)', 1)) AS token FROM part), s AS (SELECT token, (row_number() OVER (ORDER BY encode(token)) + 3)::INT AS id FROM t) SELECT * FROM s UNION ALL SELECT * FROM (VALUES ('<PAD>', 0), ('<SOS>', 1), ('<EOS>', 2), ('<UNK>', 3))")
def _(spark, sf):
    return M.vocabulary(P.table(spark, sf, "part").select(F.col("p_name").alias("smiles")))


@query("smiles_round_trip", "SELECT p_partkey AS id, p_name AS text, 120 AS n FROM part")
def _(spark, sf):
    p = P.table(spark, sf, "part")
    v = M.vocabulary(p.select(F.col("p_name").alias("smiles")))
    maps = v.agg(F.map_from_entries(F.collect_list(F.struct("token", "id"))).alias("ids"), F.map_from_entries(F.collect_list(F.struct("id", "token"))).alias("names"))
    rows = p.join(F.broadcast(maps)).withColumn("code", FM.encode(FM.smiles_tokens("p_name"), "ids"))  # one row, an alphabet
    return rows.select(F.col("p_partkey").alias("id"), FM.decode("code", "names").alias("text"), F.size("code").alias("n"))


PROTEIN = "s AS (SELECT p_partkey AS id, translate(md5(p_partkey::VARCHAR), '0123456789abcdef', 'ACDEFGHIKLMNPQRS') AS seq FROM part)"


@query("protein_properties", f"WITH {PROTEIN} SELECT id, reverse(seq) AS mirrored, round(len(regexp_extract_all(seq, '[ACFILMV]')) / length(seq), 4)::DOUBLE AS hydrophobic, regexp_matches(seq, '^[ACDEFGHIKLMNPQRSTVWY]+$') AS valid FROM s")
def _(spark, sf):
    s = proteins(spark, sf)
    return s.select("id", FP.mirrored("seq").alias("mirrored"), FP.hydrophobic_fraction("seq").alias("hydrophobic"), FP.is_sequence("seq").alias("valid"))


def proteins(spark, sf) -> DataFrame:
    return P.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.translate(F.md5(F.col("p_partkey").cast("string")), "0123456789abcdef", "ACDEFGHIKLMNPQRS").alias("seq"))


MASS_SQL = " + ".join(f"{m} * len(regexp_extract_all(seq, '{a}'))" for a, m in FP.MASS.items())
CHARGE_SQL = "1 / (1 + pow(10.0, 7.4 - 9.69)) - 1 / (1 + pow(10.0, 2.34 - 7.4))" + "".join(f" + len(regexp_extract_all(seq, '{a}')) / (1 + pow(10.0, 7.4 - {k}))" for a, k in FP.BASE.items()) + "".join(f" - len(regexp_extract_all(seq, '{a}')) / (1 + pow(10.0, {k} - 7.4))" for a, k in FP.ACID.items())


@query("protein_mass_charge", f"WITH {PROTEIN} SELECT id, round((18.01524 + {MASS_SQL})::DOUBLE, 2) AS mass, round(({CHARGE_SQL})::DOUBLE, 3) AS charge FROM s")
def _(spark, sf):
    return proteins(spark, sf).select("id", FP.molecular_weight("seq").alias("mass"), FP.net_charge("seq").alias("charge"))


@query("isoelectric_points")
def _(spark, sf):
    # By id first: a part table in one file would be one task's.
    return proteins(spark, sf).repartition("id").select("id", FP.isoelectric_point("seq").alias("pi"))


@query("event_islands", "WITH f AS (SELECT user_id, event_id, value > 50 AS hi, value FROM events), n AS (SELECT *, (hi IS DISTINCT FROM lag(hi) OVER (PARTITION BY user_id ORDER BY event_id))::INT AS nw FROM f), r AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM n) SELECT user_id, hi, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM r GROUP BY user_id, run, hi")
def _(spark, sf):
    e = P.table(spark, sf, "events").select("user_id", "event_id", (F.col("value") > 50).alias("hi"))
    return R.islands(e, ["user_id"], "event_id", "hi")


@query("moving_mean", "SELECT event_id, (sum((value * 10000)::BIGINT) OVER w)::BIGINT AS total, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)")
def _(spark, sf):
    # Whole numbers: the mean's parts, so that neither rounding nor the order of summation matters.
    e = P.table(spark, sf, "events").withColumn("value", F.round(F.col("value") * 10000).cast("long"))
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(-49, 0)
    held = R.moving_mean(e, ["user_id"], "event_id", "value").withColumn("n", F.count("*").over(w))
    return held.select("event_id", F.round(F.col("value_mean") * F.col("n")).cast("long").alias("total"), "n")


@query("dataset_split", "WITH n AS (SELECT count(*) AS n FROM part), s AS (SELECT unnest(['train', 'validation', 'test']) AS split) SELECT split, (CASE split WHEN 'train' THEN floor(n * 0.9) WHEN 'validation' THEN floor(n * 0.05) ELSE n - floor(n * 0.9) - floor(n * 0.05) END)::BIGINT AS n FROM s, n")
def _(spark, sf):
    return R.sized_split(P.table(spark, sf, "part").select(F.col("p_partkey").alias("id")), "id").groupBy("split").agg(F.count("*").alias("n"))


@query("arm_statistics", "SELECT event_type AS arm, count(*) AS n, round(sum(value), 4) AS total, round(avg(value) + 1.4 * sqrt(ln(1001.0) / count(*)), 6) AS bound FROM events GROUP BY 1")
def _(spark, sf):
    s = P.table(spark, sf, "events").groupBy(F.col("event_type").alias("arm")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return s.select("arm", "n", F.round("total", 4).alias("total"), F.round(F.col("total") / F.col("n") + 1.4 * F.sqrt(F.log(F.lit(1001.0)) / F.col("n")), 6).alias("bound"))


@query(
    "replay_diff",
    """WITH a AS (SELECT event_id AS i, unnest(['value', 'event_type']) AS field, unnest([value::VARCHAR, event_type]) AS x FROM (SELECT event_id, round(value, 1) AS value, event_type FROM events WHERE event_id % 5 <> 0)),
b AS (SELECT event_id AS i, unnest(['value', 'event_type']) AS field, unnest([value::VARCHAR, event_type]) AS y FROM (SELECT event_id, round(value, 1) AS value, CASE WHEN event_id % 11 = 0 THEN 'other' ELSE event_type END AS event_type FROM events WHERE event_id % 7 <> 0))
SELECT coalesce(a.i, b.i) AS row, coalesce(a.field, b.field) AS field, x IS NULL AS added, y IS NULL AS removed FROM a FULL JOIN b ON a.i = b.i AND a.field = b.field WHERE x IS DISTINCT FROM y""",
)
def _(spark, sf):
    e = P.table(spark, sf, "events").select(F.col("event_id").alias("row"), F.round("value", 1).alias("value"), "event_type")
    a, b = e.where("row % 5 <> 0"), e.where("row % 7 <> 0").withColumn("event_type", F.when(F.col("row") % 11 == 0, "other").otherwise(F.col("event_type")))
    d = RE.row_diff(a, b, "row", ["value", "event_type"])
    return d.select("row", "field", F.col("before").isNull().alias("added"), F.col("after").isNull().alias("removed"))


@query("latest_versions", "SELECT user_id AS key, event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2")
def _(spark, sf):
    e = P.table(spark, sf, "events").select(F.col("user_id").alias("key"), "event_type", "event_id", "ts")
    old, new = e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1")
    return RE.upserted(old, new, ["key", "event_type"], ["ts", "event_id"]).select("key", "event_type", "event_id")


@query("live_cache", "SELECT sha2_key AS key, max(event_id) AS event_id FROM (SELECT substr(sha256('{\"type\":\"' || event_type || '\",\"user\":' || user_id || '}'), 1, 16) AS sha2_key, event_id, ts FROM events) WHERE ts >= TIMESTAMP '2024-01-15 00:00:00' GROUP BY 1")
def _(spark, sf):
    from ..functions.text import cache_key

    e = P.table(spark, sf, "events").select(cache_key(type="event_type", user="user_id").alias("key"), "event_id", F.col("ts").alias("expires_at"))
    return RE.unexpired(e, F.lit("2024-01-15").cast("timestamp")).groupBy("key").agg(F.max("event_id").alias("event_id"))


VALID_SQL = f"""WITH {P.GENETIC_SQL}, best AS (SELECT disease_id, target_symbol, max(score) AS score FROM genetic GROUP BY 1, 2),
found AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY disease_id ORDER BY score DESC, target_symbol) AS r FROM best) WHERE r <= 20),
truth AS (SELECT DISTINCT n_name AS disease_id, 'G' || (l_partkey % 500)::VARCHAR AS target_symbol FROM {P.LINES_SQL} WHERE l_quantity > 49),
m AS (SELECT f.disease_id, count(*) AS n_found, count(t.target_symbol) AS hits FROM found f LEFT JOIN truth t USING (disease_id, target_symbol) GROUP BY 1), t AS (SELECT disease_id, count(*) AS n_truth FROM truth GROUP BY 1)"""


@query("validation", VALID_SQL + " SELECT disease_id, n_found, hits, n_truth, round(hits / n_found, 4)::DOUBLE AS precision, round(hits / n_truth, 4)::DOUBLE AS recall, round(CASE WHEN hits > 0 THEN 2.0 * hits / (n_found + n_truth) ELSE 0 END, 4)::DOUBLE AS f1 FROM m JOIN t USING (disease_id)")
def _(spark, sf):
    from ..operators import frames as A

    found = A.top_genetic_targets(P.assoc(spark, sf), 20).select("disease_id", F.col("target_symbol").alias("name"))
    truth = P.lines(spark, sf).where("l_quantity > 49").select(F.col("n_name").alias("disease_id"), P.symbol("l_partkey").alias("name")).distinct()
    return V.precision_recall(found, truth, "disease_id")


@query("citation_findings", "SELECT l.doc_id, CASE WHEN d.doc_id IS NULL THEN 'missing' WHEN quality = 0 THEN 'not citable' END AS finding FROM labels l LEFT JOIN (SELECT * FROM documents WHERE doc_id % 3 <> 0) d USING (doc_id) WHERE d.doc_id IS NULL OR quality = 0")
def _(spark, sf):
    cited = P.table(spark, sf, "labels").select(F.col("doc_id").alias("run"), (F.col("quality") == 1).alias("citable"))
    records = P.table(spark, sf, "documents").where("doc_id % 3 <> 0").select(F.col("doc_id").alias("run"))
    return V.citation_findings(cited, records).withColumnRenamed("run", "doc_id")


@query("name_matches", "SELECT DISTINCT p_name AS name FROM part WHERE EXISTS (SELECT 1 FROM part q WHERE q.p_size < 5 AND lower(split_part(q.p_name, ' ', 1)) = ANY (string_split(lower(part.p_name), ' ')))")
def _(spark, sf):
    p = P.table(spark, sf, "part")
    names = p.select(F.col("p_name").alias("name")).distinct()
    truth = p.where("p_size < 5").select(F.split("p_name", " ")[0].alias("name")).distinct()
    return V.token_matches(names.withColumn("_n", F.translate("name", " ", "-")), truth, "_n").select("name")


@query("ranked_targets")
def _(spark, sf):
    from ..operators import frames as A
    from .discovery import disease_graphs, ranked_targets

    best = cut(A.best_scores(P.assoc(spark, sf)), "best-scores")
    nodes, edges = disease_graphs(best, P.interactions(spark, sf))
    return ranked_targets(nodes, edges, facts=cut(P.facts(spark, sf, best), "target-facts"))


@query("disease_classes", "SELECT n_name AS disease, CASE WHEN n_nationkey % 5 = 0 THEN 'infectious_viral' WHEN n_nationkey % 5 = 1 THEN 'infectious_parasitic' WHEN n_nationkey % 5 = 2 THEN 'cancer' ELSE 'other' END AS class FROM nation")
def _(spark, sf):
    from ..operators.biology import disease_class

    n = P.table(spark, sf, "nation")
    k = F.col("n_nationkey") % 5
    name = F.when(k == 0, " HIV/AIDS").when(k == 1, "cerebral Malaria").when(k == 2, "Lung carcinoma").otherwise("gout")
    return n.select(F.col("n_name").alias("disease"), disease_class(name).alias("class"))


@query("target_classes", "SELECT p_partkey AS id, CASE WHEN p_partkey % 6 = 0 THEN 'host_symptom' WHEN p_partkey % 6 = 1 THEN 'host_immune' WHEN p_partkey % 6 = 2 THEN 'host_symptom' WHEN p_partkey % 6 = 3 THEN 'host_invasion' WHEN p_partkey % 6 = 4 THEN 'correlational' ELSE 'host_invasion' END AS target_type FROM part")
def _(spark, sf):
    from ..operators.biology import classified_targets

    k = F.col("p_partkey") % 6
    gene = F.when(k == 0, "Drd2").when(k == 1, "TLR4").when(k == 2, "IL6").when(k == 3, "CCR5").when(k == 4, "XYZ1").otherwise("XYZ2")
    genes = P.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), gene.alias("gene"), F.lit("infectious_viral").alias("disease_class"), (k != 4).alias("supported"))
    markers, invasion = spark.sql("SELECT 'DRD2' AS gene, 'dopamine_receptors' AS family"), spark.sql("SELECT 'CCR5' AS gene")
    return classified_targets(genes, markers, invasion).select("id", "target_type")


#: Whole and altered names of every disease of the fixed table, a name for each part.
DISEASE_NAMES_SQL = f"""WITH t(i, name, class) AS (VALUES {", ".join(f"({i}, '{k.replace(chr(39), chr(39) * 2)}', '{v}')" for i, (k, v) in enumerate(BT.DISEASE_NAMES.items()))}),
d AS (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN ' ' || upper(name) || ' ' WHEN 1 THEN 'Chronic ' || name WHEN 2 THEN name ELSE left(name, 3) || '-carcinoma' END AS name FROM part JOIN t ON i = p_partkey % {len(BT.DISEASE_NAMES)}),
k AS (SELECT id, name, lower(trim(name)) AS key FROM d),
m AS (SELECT k.id, min_by(t.class, CASE WHEN t.name = k.key THEN -1 ELSE t.i END) AS class FROM k JOIN t ON contains(k.key, t.name) OR contains(t.name, k.key) GROUP BY 1)
SELECT k.id, k.name, coalesce(m.class, CASE WHEN regexp_matches(key, 'cancer|carcinoma|sarcoma|blastoma|oma|leukemia|lymphoma|myeloma') THEN 'cancer' ELSE 'other' END) AS class FROM k LEFT JOIN m USING (id)"""


@query("disease_names", DISEASE_NAMES_SQL)
def _(spark, sf):
    from ..operators.biology import disease_class

    names, k, id_ = F.array(*map(F.lit, BT.DISEASE_NAMES)), F.col("p_partkey") % 4, F.col("p_partkey")
    name = F.get(names, (id_ % len(BT.DISEASE_NAMES)).cast("int"))
    name = F.when(k == 0, F.concat(F.lit(" "), F.upper(name), F.lit(" "))).when(k == 1, F.concat(F.lit("Chronic "), name)).when(k == 2, name).otherwise(F.concat(F.substring(name, 1, 3), F.lit("-carcinoma")))
    return P.table(spark, sf, "part").select(id_.alias("id"), name.alias("name")).select("id", "name", disease_class("name").alias("class"))


GENES = [g for held in BT.MARKER_FAMILIES.values() for g in held.split()] + BT.ENTRY_FACTORS.split() + ["TNF", "IL6", "TLR4", "HLA-A", "STAT1", "EGFR", "TP53"]
CLASSES = ["infectious_viral", "autoimmune", "infectious_bacterial", "cancer", "infectious_parasitic"]
TARGET_FAMILIES_SQL = f"""WITH g(i, gene) AS (VALUES {", ".join(f"({i}, '{g}')" for i, g in enumerate(GENES))}),
f(gene, family) AS (VALUES {", ".join(f"('{g}', '{family}')" for family, held in BT.MARKER_FAMILIES.items() for g in held.split())}),
r AS (SELECT p_partkey AS id, gene, [{", ".join(f"'{c}'" for c in CLASSES)}][(p_partkey % 5 + 1)::INT] AS c, p_size % 2 = 0 AS supported FROM part JOIN g ON i = p_partkey % {len(GENES)})
SELECT id, family, CASE WHEN family IS NOT NULL AND c LIKE 'infectious%' THEN 'host_symptom' WHEN gene IN ('TNF', 'IL6') AND c LIKE 'infectious%' THEN 'host_symptom'
 WHEN gene IN ('TNF', 'IL6', 'TLR4', 'HLA-A', 'STAT1', 'CD4') AND c LIKE 'infectious%' THEN 'host_immune' WHEN gene IN ('TNF', 'IL6', 'TLR4', 'HLA-A', 'STAT1', 'CD4') AND c = 'autoimmune' THEN 'host_invasion'
 WHEN gene IN ({", ".join(f"'{g}'" for g in BT.ENTRY_FACTORS.split())}) AND c LIKE 'infectious%' THEN 'host_invasion' WHEN NOT supported THEN 'correlational' ELSE 'host_invasion' END AS target_type
FROM r LEFT JOIN f USING (gene)"""


@query("target_families", TARGET_FAMILIES_SQL)
def _(spark, sf):
    from ..operators.biology import classified_targets

    id_ = F.col("p_partkey")
    pick = lambda held: F.get(F.array(*map(F.lit, held)), (id_ % len(held)).cast("int"))
    genes = P.table(spark, sf, "part").select(id_.alias("id"), pick(GENES).alias("gene"), pick(CLASSES).alias("disease_class"), (F.col("p_size") % 2 == 0).alias("supported"))
    return classified_targets(genes).select("id", "family", "target_type")


@query("tissue_gate", "WITH e AS (SELECT DISTINCT 'G' || (l_partkey % 50)::VARCHAR AS gene, l_returnflag AS t FROM lineitem WHERE l_quantity > 49), g AS (SELECT DISTINCT 'G' || (p_partkey % 60)::VARCHAR AS gene FROM part), c AS (SELECT gene, count(*) AS n, count_if(t = 'A') AS k FROM e GROUP BY 1) SELECT gene, n IS NULL OR k > 0 AS tissue_relevant, CASE WHEN n IS NULL THEN 0.0 ELSE round(k / n, 4) END::DOUBLE AS coverage FROM g LEFT JOIN c USING (gene)")
def _(spark, sf):
    from ..operators.biology import tissue_gate

    e = P.table(spark, sf, "lineitem").where("l_quantity > 49").select(F.concat(F.lit("G"), (F.col("l_partkey") % 50).cast("string")).alias("gene"), F.col("l_returnflag").alias("tissue"))
    g = P.table(spark, sf, "part").select(F.concat(F.lit("G"), (F.col("p_partkey") % 60).cast("string")).alias("gene"), F.lit("d").alias("disease_id")).distinct()
    return tissue_gate(g, e, spark.sql("SELECT 'd' AS disease_id, 'alpha' AS tissue"), spark.sql("SELECT 'A' AS tissue, 'Alpha' AS canonical")).select("gene", "tissue_relevant", "coverage")


@query("binding_boxes", "SELECT label AS id, round(avg(embedding[1]), 4) AS center_x, round(max(embedding[1])::DOUBLE - min(embedding[1])::DOUBLE + 10, 4) AS size_x FROM embeddings GROUP BY 1")
def _(spark, sf):
    from ..operators.structures import bounding_box

    e = P.table(spark, sf, "embeddings").select(F.col("label").alias("id"), *(F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")))
    return bounding_box(e, "id").select("id", "center_x", "size_x")


@query("structure_comparison")
def _(spark, sf):
    from ..operators import structures as ST

    e = P.table(spark, sf, "embeddings").select((F.col("vec_id") % 10).alias("structure_id"), F.col("vec_id").alias("position"), *(F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")))
    turned = e.select("structure_id", "position", F.col("y").alias("x"), (-F.col("x")).alias("y"), (F.col("z") + 1).alias("z"))
    return ST.tm_score(ST.superposed(e, turned))


@query("event_windows", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, sf):
    from ..streaming.runs import tumbling

    return tumbling(P.table(spark, sf, "events"), "ts", ["event_type"], "1 day", "1 day").select("start", "event_type", "n")
