"""Queries over observations, fingerprints and run records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import molecules as FM
from ..operators import integrity as I
from ..operators import linear as L
from ..operators import molecules as M
from ..operators import paths as PA
from ..operators import tensors as TE
from ..runtime import cut
from ..streaming import buffers as B
from ..streaming import jobs as J
from . import projections as P
from .associations import COLLISIONS_SQL
from .targets import whole_graph

Q, SQL = {}, {}
#: Numbers of a line and its part, and two that follow from them, as one system.
NAMES = ["l_discount", "l_extendedprice", "l_quantity", "l_tax", "p_retailprice", "p_size", "revenue", "worth"]


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def observations(spark, sf) -> DataFrame:
    part = P.table(spark, sf, "part").select("p_partkey", "p_retailprice", "p_size")
    rows = P.table(spark, sf, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    return rows.withColumns({"revenue": F.col("l_extendedprice") * (1 - F.col("l_discount")), "worth": F.col("l_quantity") * F.col("p_retailprice")}).select(*NAMES)


_PAIRS = [(a, b) for i, a in enumerate(NAMES) for b in NAMES[i + 1 :]]
OBS_SQL = "obs AS (SELECT l_discount, l_extendedprice, l_quantity, l_tax, p_retailprice, p_size::DOUBLE AS p_size, l_extendedprice * (1 - l_discount) AS revenue, l_quantity * p_retailprice AS worth FROM lineitem JOIN part ON l_partkey = p_partkey)"
CORR_SQL = f"{OBS_SQL}, c AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, corr({a}, {b}) AS r FROM obs" for a, b in _PAIRS) + ")"


@query("correlations", f"WITH {CORR_SQL} SELECT a, b, n, round(r, 6) AS correlation FROM c")
def _(spark, sf):
    return L.correlations(L.moments(observations(spark, sf), NAMES)).withColumn("correlation", F.round("correlation", 6))


@query(
    "pc_skeleton",
    f"""WITH {CORR_SQL}, s AS (SELECT a, b, n, r FROM c UNION ALL SELECT b, a, n, r FROM c), e AS (SELECT * FROM s WHERE sqrt(n - 3) * abs(atanh(r)) >= 1.9599639845400536),
gone AS (SELECT DISTINCT ab.a, ab.b FROM e ab JOIN e x ON x.a IN (ab.a, ab.b) AND x.b NOT IN (ab.a, ab.b) JOIN s ac ON ac.a = ab.a AND ac.b = x.b JOIN s bc ON bc.a = ab.b AND bc.b = x.b
 WHERE sqrt(ab.n - 4) * abs(atanh((ab.r - ac.r * bc.r) / sqrt((1 - ac.r * ac.r) * (1 - bc.r * bc.r)))) < 1.9599639845400536)
SELECT a, b FROM e ANTI JOIN gone USING (a, b) WHERE a < b""",
)
def _(spark, sf):
    # With sets of up to one name, as SQL has partial correlations in closed form.
    return L.skeleton(observations(spark, sf), NAMES, depth=1)[0]


@query("causal_discovery")
def _(spark, sf):
    return L.discovered(observations(spark, sf), NAMES)


PARENTS = {"l_extendedprice": ["l_quantity", "p_retailprice"], "l_tax": ["l_discount"], "p_size": []}
#: p_size has no parent and so itself; its next value is the part's price.
FOLLOWING = {"p_size": "p_retailprice"}
FIT_SQL = f"""{OBS_SQL}, m AS (SELECT covar_samp(l_quantity, l_quantity) AS s11, covar_samp(p_retailprice, p_retailprice) AS s22, covar_samp(l_quantity, p_retailprice) AS s12,
 covar_samp(l_quantity, l_extendedprice) AS s1, covar_samp(p_retailprice, l_extendedprice) AS s2, avg(l_quantity) AS m1, avg(p_retailprice) AS m2, avg(l_extendedprice) AS my,
 regr_slope(l_tax, l_discount) AS wt, regr_intercept(l_tax, l_discount) AS ct, regr_slope(p_retailprice, p_size) AS wp, regr_intercept(p_retailprice, p_size) AS cp FROM obs),
w AS (SELECT *, (s1 * s22 - s2 * s12) / (s11 * s22 - s12 * s12) AS w1, (s2 * s11 - s1 * s12) / (s11 * s22 - s12 * s12) AS w2 FROM m),
f AS (SELECT *, my - w1 * m1 - w2 * m2 AS c FROM w)"""


def model(spark, sf) -> tuple[DataFrame, L.LinearModel]:
    rows = observations(spark, sf)
    return rows, L.LinearModel.fit(rows, PARENTS, FOLLOWING)


@query(
    "scm_strengths",
    f"""WITH {FIT_SQL} SELECT 'l_quantity' AS source, 'l_extendedprice' AS target, round(w1, 3) AS weight, round((sqrt(w1 * w1 + w2 * w2) + abs(c)) / 2, 3) AS strength FROM f
UNION ALL SELECT 'p_retailprice', 'l_extendedprice', round(w2, 3), round((sqrt(w1 * w1 + w2 * w2) + abs(c)) / 2, 3) FROM f
UNION ALL SELECT 'l_discount', 'l_tax', round(wt, 3), round(abs(wt) + abs(ct), 3) FROM f UNION ALL SELECT 'p_size', 'p_size', round(wp, 3), round(abs(wp) + abs(cp), 3) FROM f""",
)
def _(spark, sf):
    return model(spark, sf)[1].strengths(spark).withColumns({c: F.round(c, 3) for c in ("weight", "strength")})


@query(
    "scm_intervention",
    f"""WITH {FIT_SQL}, b AS (SELECT CASE WHEN l_quantity > 25 THEN 'large' ELSE 'small' END AS size, l_quantity AS q, p_retailprice AS p FROM obs)
SELECT size, count(*) AS n, round(avg(c + w1 * q + w2 * p), 2) AS predicted, round(avg(c + w1 * 10 + w2 * p), 2) AS held, 0.5::DOUBLE AS tax FROM b, f GROUP BY 1""",
)
def _(spark, sf):
    rows, m = model(spark, sf)
    given = m.predict({"l_quantity": 10.0, "l_tax": 0.5})
    size = F.when(F.col("l_quantity") > 25, "large").otherwise("small").alias("size")
    told = rows.select(size, m.predict()["l_extendedprice"].alias("p"), given["l_extendedprice"].alias("h"), given["l_tax"].alias("t"))
    return told.groupBy("size").agg(F.count("*").alias("n"), F.round(F.avg("p"), 2).alias("predicted"), F.round(F.avg("h"), 2).alias("held"), F.max("t").alias("tax"))


@query(
    "nearest_drugs",
    """WITH e AS (SELECT vec_id AS id, list_transform(embedding, lambda x: (x > 0)::INT) AS b, list_sum(list_transform(embedding, lambda x: (x > 0)::INT)) AS n FROM embeddings),
s AS (SELECT q.id AS query_id, r.id AS reference_id, q.n + r.n AS total, list_dot_product(q.b::DOUBLE[], r.b::DOUBLE[]) AS shared FROM e q JOIN e r ON q.id % 100 = 0 AND q.id <> r.id),
t AS (SELECT query_id, reference_id, CASE WHEN total - shared > 0 THEN round(shared / (total - shared), 4) ELSE 0 END::DOUBLE AS similarity FROM s)
SELECT query_id, reference_id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, reference_id)::INT AS rank FROM t QUALIFY rank <= 5""",
)
def _(spark, sf):
    e = P.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), FM.sign_bits("embedding").alias("fp"))
    # Against all rows; one more than asked, as the query's own row goes.
    near = M.nearest(e.where("id % 100 = 0"), e, 6).where("query_id <> reference_id")
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where("rank <= 5")


RUN_FIELDS = ["l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus"]
_TEXT_SQL = "concat_ws(chr(31), l_linenumber::VARCHAR, l_linestatus, l_orderkey::VARCHAR, l_partkey::VARCHAR, l_returnflag)"
_LIMBS_SQL = ", ".join(f"sum(('0x' || substr(h, {8 * i + 1}, 8))::BIGINT)::VARCHAR" for i in range(I.LIMBS))
RUNS_SQL = f"""t AS (SELECT l_suppkey AS k, concat('run-', l_suppkey) AS run, l_linenumber, {_TEXT_SQL} AS x, sha256({_TEXT_SQL}) AS h FROM lineitem),
d AS (SELECT k, run, count(*) AS n_rows, sum(strlen(x))::BIGINT AS size_bytes, sha256(concat_ws(':', count(*)::VARCHAR, {_LIMBS_SQL})) AS digest FROM t GROUP BY 1, 2)"""


def run_rows(spark, sf) -> DataFrame:
    """Lines as rows of a run for each supplier."""
    return P.table(spark, sf, "lineitem").select(F.concat(F.lit("run-"), F.col("l_suppkey").cast("string")).alias("run"), "l_suppkey", *RUN_FIELDS)


@query(
    "run_records",
    f"""WITH {RUNS_SQL}, r AS (SELECT *, CASE k % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'lost' ELSE 'complete' END AS status, k % 6 = 0 AS dirty FROM d),
z AS (SELECT *, CASE WHEN status = 'lost' THEN 'unknown status' WHEN size_bytes > 8000 AND k % 5 <> 0 THEN 'too large' END AS refused FROM r)
SELECT run, status, refused IS NULL AND status = 'complete' AND NOT dirty AS citable, n_rows, size_bytes, CASE WHEN refused IS NULL THEN digest END AS digest, refused FROM z""",
)
def _(spark, sf):
    rows = run_rows(spark, sf)
    k = F.col("l_suppkey")
    runs = rows.select("run", "l_suppkey").distinct().select("run", F.when(k % 4 == 0, "failed").when(k % 4 == 1, "lost").otherwise("complete").alias("status"), (k % 6 == 0).alias("git_dirty"), (k % 5 == 0).alias("allow_large"))
    return I.finalised(runs, rows, RUN_FIELDS, 8_000)


@query(
    "run_integrity",
    f"""WITH {RUNS_SQL}, old AS (SELECT k, run, count(*) AS n_rows, sha256(concat_ws(':', count(*)::VARCHAR, {_LIMBS_SQL})) AS digest
 FROM (SELECT k, run, CASE WHEN k % 5 = 0 THEN sha256(x || '!') ELSE h END AS h FROM t WHERE NOT (k % 7 = 0 AND l_linenumber = 1)) GROUP BY 1, 2),
r AS (SELECT k, run, n_rows, CASE WHEN k % 13 <> 0 THEN digest END AS digest, k % 3 <> 0 AS citable FROM old WHERE k % 11 <> 0)
SELECT d.run, 'no record' AS finding, NULL::VARCHAR AS expected, d.n_rows::VARCHAR AS actual FROM d ANTI JOIN r USING (run)
UNION ALL SELECT run, 'rows', r.n_rows::VARCHAR, d.n_rows::VARCHAR FROM r JOIN d USING (run) WHERE r.n_rows <> d.n_rows
UNION ALL SELECT run, 'no digest', NULL, d.digest FROM r JOIN d USING (run) WHERE r.digest IS NULL
UNION ALL SELECT run, 'digest', r.digest, d.digest FROM r JOIN d USING (run) WHERE r.digest <> d.digest
UNION ALL SELECT run, 'not citable', NULL, NULL FROM r WHERE NOT citable AND k % 2 = 0""",
)
def _(spark, sf):
    rows, k = run_rows(spark, sf), F.col("l_suppkey")
    # Records as of earlier rows: of some runs a line was missing then, of others each line ended otherwise.
    was = rows.where(~((k % 7 == 0) & (F.col("l_linenumber") == 1))).withColumn("l_returnflag", F.when(k % 5 == 0, F.concat("l_returnflag", F.lit("!"))).otherwise(F.col("l_returnflag")))
    runs = rows.select("run", "l_suppkey").distinct().where(k % 11 != 0)
    held = I.run_digests(was, RUN_FIELDS).join(runs, "run").select("run", (k % 3 != 0).alias("citable"), "n_rows", F.when(k % 13 != 0, F.col("digest")).alias("digest"))
    return I.integrity_findings(held, rows, RUN_FIELDS, runs.where(k % 2 == 0))


TENSOR_SQL = f"""{COLLISIONS_SQL}, e AS (SELECT graph_id, source_id, target_id, CASE WHEN substr(source_db, 3) = '2' THEN 'learned' ELSE edge_type END AS kind FROM resolved),
ids AS (SELECT graph_id, source_id AS node FROM resolved UNION SELECT graph_id, target_id FROM resolved),
p AS (SELECT graph_id, node, row_number() OVER (PARTITION BY graph_id ORDER BY node) - 1 AS place FROM ids),
v AS (SELECT kind, row_number() OVER (ORDER BY count(*) DESC, kind) AS type_id FROM e WHERE kind <> 'associated_with' GROUP BY 1 ORDER BY type_id LIMIT 2),
x AS (SELECT e.graph_id, a.place AS source_place, b.place AS target_place, coalesce(v.type_id, 0) AS type_id FROM e JOIN p a ON a.graph_id = e.graph_id AND a.node = e.source_id JOIN p b ON b.graph_id = e.graph_id AND b.node = e.target_id LEFT JOIN v ON v.kind = e.kind)"""


def tensors(spark, sf) -> tuple[DataFrame, DataFrame]:
    e = cut(whole_graph(spark, sf).select("graph_id", "source_id", "target_id", "edge_type", "source_db"), "whole-graph")
    e = e.withColumn("evidence_type", F.when(F.substring("source_db", 3, 1) == "2", "learned"))
    places = TE.node_places(e.select("graph_id", F.explode(F.array("source_id", "target_id")).alias("node_id")))
    return places, TE.edge_index(places, e, TE.edge_vocabulary(e, 2))


@query("edge_tensors", f"WITH {TENSOR_SQL} SELECT graph_id, source_place::INT AS source_place, target_place::INT AS target_place, type_id::INT AS type_id FROM x")
def _(spark, sf):
    return tensors(spark, sf)[1]


@query(
    "compressed_rows",
    f"""WITH {TENSOR_SQL}, o AS (SELECT p.graph_id, p.place, count(x.graph_id) AS n FROM p LEFT JOIN x ON x.graph_id = p.graph_id AND x.source_place = p.place GROUP BY 1, 2),
s AS (SELECT graph_id, place, sum(n) OVER (PARTITION BY graph_id ORDER BY place) AS upto FROM o), f AS (SELECT graph_id, [0] || list(upto::INT ORDER BY place) AS offsets FROM s GROUP BY 1),
t AS (SELECT graph_id, list(target_place::INT ORDER BY source_place, target_place, type_id) AS targets, list(type_id::INT ORDER BY source_place, target_place, type_id) AS types FROM x GROUP BY 1)
SELECT graph_id, offsets, targets, types FROM f JOIN t USING (graph_id)""",
)
def _(spark, sf):
    return TE.compressed_rows(*tensors(spark, sf))


PATIENCE = 36 * 3600
_STATES_SQL = "[" + ", ".join(f"'{x}'" for x in J.STATES) + "]"


def job_events(spark, sf) -> DataFrame:
    """Events of a user as a job's: mostly the next state, by number, and now and then another."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    place = F.when(F.col("event_id") % 11 == 0, F.col("event_id") % 9).otherwise(F.col("_n") % 8)
    return P.table(spark, sf, "events").withColumn("_n", n).select(F.col("user_id").alias("job_id"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"), F.get(F.array(*map(F.lit, J.STATES)), place.cast("int")).alias("state"))


@query(
    "job_transitions",
    f"""WITH k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events),
e AS (SELECT user_id AS job_id, ts, event_id AS seq, {_STATES_SQL}[CASE WHEN event_id % 11 = 0 THEN event_id % 9 ELSE n % 8 END + 1] AS state FROM k),
w AS (SELECT *, lag(state) OVER o AS was, lag(ts) OVER o AS was_ts, lead(ts) OVER o AS next_ts, max(ts) OVER () AS last FROM e WINDOW o AS (PARTITION BY job_id ORDER BY ts, seq)),
m AS (SELECT *, CASE WHEN was NOT IN ('complete', 'failed') AND epoch_us(ts) - epoch_us(was_ts) > {PATIENCE * 1_000_000} THEN 'failed' ELSE was END AS prior FROM w)
SELECT job_id, ts AS "at", prior AS "before", state AS "after", CASE WHEN prior IS NULL THEN CASE WHEN state = 'pending' THEN 'ok' ELSE 'illegal' END WHEN prior IN ('complete', 'failed') THEN 'illegal'
 WHEN state = 'failed' OR list_position({_STATES_SQL}, state) = list_position({_STATES_SQL}, prior) + 1 THEN 'ok' ELSE 'illegal' END AS finding FROM m
UNION ALL SELECT job_id, ts + to_seconds({PATIENCE}), state, 'failed', 'stale' FROM w WHERE state NOT IN ('complete', 'failed') AND epoch_us(coalesce(next_ts, last)) - epoch_us(ts) > {PATIENCE * 1_000_000}""",
)
def _(spark, sf):
    return J.transitions(job_events(spark, sf), PATIENCE).withColumn("at", F.col("at").cast("timestamp_ntz"))


@query(
    "graph_density",
    f"""WITH {COLLISIONS_SQL}, n AS (SELECT graph_id, count(DISTINCT node) AS n_nodes FROM (SELECT graph_id, source_id AS node FROM resolved UNION ALL SELECT graph_id, target_id FROM resolved) GROUP BY 1),
m AS (SELECT graph_id, count(*) AS n_edges FROM resolved GROUP BY 1)
SELECT graph_id, n_nodes, n_edges, round(n_edges / (n_nodes * (n_nodes - 1)), 8) AS density, round(n_edges / n_nodes, 6) AS mean_degree FROM n JOIN m USING (graph_id)""",
)
def _(spark, sf):
    return PA.density(whole_graph(spark, sf)).withColumns({"density": F.round("density", 8), "mean_degree": F.round("mean_degree", 6)})


@query(
    "recalibrations",
    """WITH o AS (SELECT event_type AS key, event_id, event_id % 97 AS x, value AS y FROM events WHERE value IS NOT NULL),
w AS (SELECT key, count(*) OVER u AS n, avg(x) OVER u AS mean_x, avg(y) OVER u AS mean_y, regr_slope(y, x) OVER u AS slope, regr_intercept(y, x) OVER u AS intercept FROM o WINDOW u AS (PARTITION BY key ORDER BY event_id ROWS UNBOUNDED PRECEDING))
SELECT key, n, round(mean_x, 6) AS mean_x, round(mean_y, 6) AS mean_y, round(slope, 6) AS slope, round(intercept, 6) AS intercept FROM w WHERE n % 50 = 0""",
)
def _(spark, sf):
    e = P.table(spark, sf, "events").withColumn("x", F.col("event_id") % 97)
    out = B.recalibrations(e, "event_type", "event_id", "x", "value", 50)
    return out.withColumns({c: F.round(c, 6) for c in ("mean_x", "mean_y", "slope", "intercept")})
