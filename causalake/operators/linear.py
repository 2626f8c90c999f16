"""Linear structure from observations: moments in one pass, PC discovery, structural causal models.

Observations of any size are read twice, for means and for sums of products about them: each task sums its own rows, and only
those sums, columns squared, are shuffled. What comes after works on the moments, whose size the number of columns bounds (COLUMNS at most).
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import Grown, counted, cut

#: Columns of one system: moments of a thousand columns are 8 MB.
COLUMNS = 1_000
EDGE = ["source", "target"]


def moments(rows: DataFrame, names: list[str]) -> DataFrame:
    """a, b, n, mean_a, mean_b, sum_a, sum_b, sum_ab for every pair of the named columns, each once, in their order.

    Rows with a null or NaN in one of the columns are left out. The three sums are taken about the columns' means, so that columns
    with a large mean keep their digits.
    """
    if len(set(names)) != len(names) or len(names) > COLUMNS:
        raise ValueError(f"give at most {COLUMNS} different columns")
    held = rows.select(*(F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(names)))
    whole = F.lit(True)
    for i in range(len(names)):
        whole = whole & F.col(f"x{i}").isNotNull() & ~F.isnan(f"x{i}")
    held = held.where(whole)
    pivot = held.agg(*(F.avg(f"x{i}").alias(f"x{i}") for i in range(len(names)))).first()  # one row
    pivot = np.array([x or 0.0 for x in pivot])
    upper = np.triu_indices(len(names))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, gram = 0, np.zeros(len(names)), np.zeros((len(names), len(names)))
        for b in batches:
            if b.num_rows:
                x = np.column_stack([c.to_numpy() for c in b.columns]) - pivot
                n, total, gram = n + len(x), total + x.sum(0), gram + x.T @ x
        yield pa.RecordBatch.from_pydict({"i": pa.array(upper[0], pa.int32()), "j": pa.array(upper[1], pa.int32()), "n": pa.array(np.full(len(upper[0]), n), pa.int64()), "s": total[upper[0]], "t": total[upper[1]], "st": gram[upper]})

    parts = held.mapInArrow(sums, "i int, j int, n long, s double, t double, st double")
    total = parts.groupBy("i", "j").agg(*(F.sum(c).alias(c) for c in ("n", "s", "t", "st")))
    named = F.array(*map(F.lit, names))
    mean = F.array(*(F.lit(float(x)) for x in pivot))
    return total.select(F.get(named, F.col("i")).alias("a"), F.get(named, F.col("j")).alias("b"), "n", F.get(mean, F.col("i")).alias("mean_a"), F.get(mean, F.col("j")).alias("mean_b"), F.col("s").alias("sum_a"), F.col("t").alias("sum_b"), F.col("st").alias("sum_ab"))


def covariances(sums: DataFrame) -> DataFrame:
    """a, b, n, covariance (sample) of moments()."""
    value = (F.col("sum_ab") - F.col("sum_a") * F.col("sum_b") / F.col("n")) / (F.col("n") - 1)
    return sums.select("a", "b", "n", F.when(F.col("n") > 1, value).alias("covariance"))


def correlations(sums: DataFrame) -> DataFrame:
    """a, b, n, correlation for a and b different; null where a column is constant."""
    c = covariances(sums)
    own = c.where("a = b").select(F.col("a").alias("_x"), F.col("covariance").alias("_v"))
    held = c.where("a <> b").join(own.toDF("_x", "_va"), F.col("a") == F.col("_x")).drop("_x").join(own.toDF("_y", "_vb"), F.col("b") == F.col("_y"))
    scale = F.sqrt(F.col("_va") * F.col("_vb"))
    return held.select("a", "b", "n", F.when(scale > 0, F.col("covariance") / scale).alias("correlation"))


def _matrix(pairs: DataFrame, value: str, names: list[str], own: float) -> np.ndarray:
    """A symmetric matrix of a, b and a value: columns squared, bounded by COLUMNS."""
    at = {x: i for i, x in enumerate(names)}
    out = np.eye(len(names)) * own
    for r in pairs.select("a", "b", value).collect():
        out[at[r.a], at[r.b]] = out[at[r.b], at[r.a]] = r[value] if r[value] is not None else 0.0
    return out


def skeleton(rows: DataFrame, names: list[str], alpha: float = 0.05, depth: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The PC algorithm's undirected edges (a, b with a < b) and, for pairs that were parted, a, b and their separating set.

    Level by level: with sets of k neighbours, an edge goes if a set makes its ends independent by Fisher's z at alpha; all sets of
    a level are taken from the neighbours at its start, so results don't depend on order. Of several separating sets the first
    in name order is told. The candidates of a level are a table; partial correlations are inverses of its rows' blocks of the
    correlation matrix, many at once. A constant column has no edges. depth bounds the sets' size.
    """
    spark = rows.sparkSession
    sums = cut(moments(rows, names), "moments")
    n = sums.agg(F.max("n")).first()[0] or 0
    corr = spark.sparkContext.broadcast(_matrix(correlations(sums), "correlation", names, 1.0))
    at = {x: i for i, x in enumerate(names)}
    limit = NormalDist().inv_cdf(1 - alpha / 2)

    def independent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(c).to_pylist() for c in ("a", "b", "given")]
            idx = np.array([[at[x], at[y], *(at[z] for z in given)] for x, y, given in zip(*cols, strict=True)])
            block = corr.value[idx[:, :, None], idx[:, None, :]]
            inverse = np.linalg.pinv(block, hermitian=True)
            r = -inverse[:, 0, 1] / np.sqrt(np.maximum(inverse[:, 0, 0] * inverse[:, 1, 1], 1e-300))
            r = np.clip(r, -1 + 1e-12, 1 - 1e-12)
            free = n - (idx.shape[1] - 2) - 3
            z = np.sqrt(max(free, 0)) * np.abs(np.arctanh(r))
            keep = pa.array(z < limit)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("a", "b", "given")], ["a", "b", "given"])

    some = spark.createDataFrame([(x,) for x in names], "x string")
    edges = cut(some.select(F.col("x").alias("a")).join(some.select(F.col("x").alias("b")), F.col("a") < F.col("b")), "pc-edges")  # columns squared
    parted = None
    level = 0
    while depth is None or level <= depth:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.array_sort(F.collect_set("b")).alias("_near"))
        sets = both.join(near, "a").select("a", "b", F.array_remove("_near", F.col("b")).alias("_near"), F.array().cast("array<string>").alias("given")).where(F.size("_near") >= level)
        for _ in range(level):
            # A set grows by names behind its last.
            sets = sets.select("a", "b", "_near", "given", F.explode(F.filter("_near", lambda x: (F.size("given") == 0) | (x > F.get("given", F.size("given") - 1)))).alias("_v")).select("a", "b", "_near", F.array_append("given", F.col("_v")).alias("given"))
        tests, any_ = counted(sets.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "given").distinct(), "pc-tests")
        if not any_:
            break
        done = cut(tests.repartition("a", "b").mapInArrow(independent, "a string, b string, given array<string>").groupBy("a", "b").agg(F.min("given").alias("given")), "pc-parted")
        parted = done if parted is None else parted.unionByName(done)
        edges = cut(edges.join(done, ["a", "b"], "left_anti"), "pc-edges")
        level += 1
    if parted is None:
        parted = spark.createDataFrame([], "a string, b string, given array<string>")
    return edges, parted


def discovered(rows: DataFrame, names: list[str], alpha: float = 0.05, depth: int | None = None) -> DataFrame:
    """source, target, directed: the PC algorithm's graph; an undirected edge stands once, by name.

    Colliders x -> z <- y where x and y have no edge and z isn't in their separating set; where two colliders point along one edge
    against each other, that of the first collider by name holds. Then Meek's first three rules until nothing moves.
    """
    edges, parted = skeleton(rows, names, alpha, depth)
    both = cut(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).toDF("source", "target"), "pc-both")
    meets = both.select(F.col("source").alias("x"), F.col("target").alias("z")).join(both.select(F.col("source").alias("y"), F.col("target").alias("z")), "z").where("x < y")
    apart = meets.join(edges.select(F.col("a").alias("x"), F.col("b").alias("y")), ["x", "y"], "left_anti").join(parted.toDF("x", "y", "given"), ["x", "y"])
    colliders = apart.where(~F.array_contains("given", F.col("z")))
    arrows = colliders.select(F.explode(F.array(F.struct(F.col("x").alias("source"), F.col("z").alias("target")), F.struct(F.col("y").alias("source"), F.col("z").alias("target")))).alias("e"), F.struct("x", "z", "y").alias("first"))
    arrows = arrows.groupBy("e.source", "e.target").agg(F.min("first").alias("first"))
    against = arrows.select(F.col("source").alias("target"), F.col("target").alias("source"), F.col("first").alias("other"))
    arrows = arrows.join(against, EDGE, "left").where("other is null or first < other").select(*EDGE)
    found = Grown(arrows, "pc-arrows")
    while True:
        known = found.table()
        ends = known.select(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target"))
        loose = both.join(ends, EDGE, "left_anti").join(ends.toDF("target", "source"), EDGE, "left_anti")  # both ways each
        into = known.toDF("w", "source")
        one = loose.join(into, "source").join(both.toDF("w", "target"), ["w", "target"], "left_anti").select(*EDGE)  # w -> source - target, w and target apart
        two = loose.join(known.toDF("source", "w"), "source").join(known.toDF("w", "target"), ["w", "target"]).select(*EDGE)  # source -> w -> target
        side = loose.toDF("source", "w").join(known.toDF("w", "target"), "w")  # source - w -> target
        pairs = loose.join(side, EDGE).join(side.toDF("v", "source", "target"), EDGE).where("w < v")
        three = pairs.join(both.toDF("w", "v"), ["w", "v"], "left_anti").select(*EDGE)
        new = one.unionByName(two).unionByName(three).distinct()
        new = new.join(new.toDF("target", "source").withColumn("_c", F.lit(True)), EDGE, "left").where("_c is null or source < target").select(*EDGE)
        found.add(new)
        if not found.size:
            break
    known = found.table().withColumn("directed", F.lit(True))
    ends = known.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"))
    return known.unionByName(edges.join(ends, ["a", "b"], "left_anti").select(F.col("a").alias("source"), F.col("b").alias("target"), F.lit(False).alias("directed")))


class LinearModel:
    """A structural causal model of linear mechanisms: each target is a weighted sum of its parents and a constant.

    Its weights are a bounded table (targets times parents), so predictions are plain expressions over the columns of a row.
    """

    def __init__(self, weights: dict[str, dict[str, float]], constants: dict[str, float]) -> None:
        self.weights, self.constants = weights, constants

    @classmethod
    def fit(cls, rows: DataFrame, parents: dict[str, list[str]], following: dict[str, str] | None = None) -> LinearModel:
        """Least squares of all targets from one pass over rows.

        parents: each target's parents; a target without any has itself. following: the column that holds a target's next
        value (the target's own column if not named). Of parents that determine each other the shortest weights are taken.
        """
        following = following or {}
        parents = {t: p or [t] for t, p in parents.items()}
        names = sorted({x for p in parents.values() for x in p} | {following.get(t, t) for t in parents})
        sums = cut(moments(rows, names), "moments")
        cov = _matrix(covariances(sums), "covariance", names, 0.0)
        mean = {r.a: r.mean_a for r in sums.where("a = b").select("a", "mean_a").collect()}  # COLUMNS rows at most
        at = {x: i for i, x in enumerate(names)}
        weights, constants = {}, {}
        for t, p in parents.items():
            i, y = [at[x] for x in p], at[following.get(t, t)]
            w = np.linalg.lstsq(cov[np.ix_(i, i)], cov[i, y], rcond=1e-12)[0]
            weights[t] = dict(zip(p, w.tolist(), strict=True))
            constants[t] = mean[following.get(t, t)] - sum(w * mean[x] for x, w in weights[t].items())
        return cls(weights, constants)

    def predict(self, given: dict[str, float] | None = None) -> dict[str, Column]:
        """Next value of each target as an expression over a row's columns; under an intervention, given names are held at their values."""
        given = given or {}
        value = lambda x: F.lit(float(given[x])) if x in given else F.col(f"`{x}`").cast("double")
        out = {}
        for t, w in self.weights.items():
            total = F.lit(self.constants[t])
            for x, k in w.items():
                total = total + k * value(x)
            out[t] = F.lit(float(given[t])) if t in given else total
        return out

    def strengths(self, spark) -> DataFrame:
        """source, target, weight, strength: the mechanism's norm (of weights, and of its constant) over its number of parents."""
        rows = []
        for t, w in self.weights.items():
            norm = float(np.sqrt(sum(k * k for k in w.values()))) + abs(self.constants[t])
            rows += [(x, t, k, norm / len(w)) for x, k in w.items()]
        return spark.createDataFrame(rows, "source string, target string, weight double, strength double")
