"""Molecule tables: similarity, generation metrics, property distributions, vocabularies."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.molecules import SPECIAL, smiles_tokens, tanimoto
from ..runtime import cut

#: Reference rows of a tile whose similarities bound a query's k-th best from below.
SEEDS = 2_000


#: Reference rows and queries of a tile; a tile is compared in one task.
TILE, ASKED = 65_536, 16_384


def _best(most: int, seeds: int):
    """What a tile is compared by. The functions are local, so that workers needn't import this package."""

    def words(column: pa.ChunkedArray, width: int) -> np.ndarray:
        """Fingerprints as rows of `width` unsigned words; empty ones have no bits."""
        sizes = pc.list_value_length(column).to_numpy()
        out = np.zeros((len(sizes), width), np.uint64)
        out[np.arange(width) < sizes[:, None]] = pc.list_flatten(column).to_numpy().astype(np.int64).view(np.uint64)
        return out

    def tile(rows: pa.Table) -> pa.Table:
        """The `most` best reference rows of each query in a tile with a similarity above 0."""
        asks = rows["_asks"]
        q, r = rows.filter(asks), rows.filter(pc.invert(asks))
        width = max(pc.max(pc.list_value_length(rows["fp"])).as_py() or 0, 1)
        r = r.take(pc.sort_indices(r["reference_id"]))
        asked, held = words(q["fp"], width), np.ascontiguousarray(words(r["fp"], width).T)
        n_held = np.bitwise_count(held).sum(axis=0, dtype=np.int64)
        top = int(n_held.max(initial=0))
        # Ten thousandths by popcount and shared bits, rounded half up in whole numbers.
        shared_, sizes = np.arange(top + 1), np.arange(top + 1)[:, None]
        row = n_held * (top + 1)
        step = max(1, len(n_held) // seeds) if seeds else 0
        which, found, scores = [], [], []
        for i, fp in enumerate(asked):
            every = np.maximum(sizes + int(np.bitwise_count(fp).sum()) - shared_, 1)
            table = ((20_000 * shared_ + every) // (2 * every)).astype(np.int64).ravel()
            both = np.bitwise_count(held[0] & fp[0])
            for w in range(1, width):
                both = both.astype(np.int64) + np.bitwise_count(held[w] & fp[w])
            score = table[row + both]
            least = 1
            if step and len(some := score[::step]) > most:
                least = max(1, int(np.partition(some, -most)[-most]))
            near = np.flatnonzero(score >= least)
            near = near[np.lexsort((near, -score[near]))[:most]]
            which.append(np.full(len(near), i))
            found.append(near)
            scores.append(score[near])
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return pa.table({"query_id": q["query_id"].take(pa.array(join(which))), "reference_id": r["reference_id"].take(pa.array(join(found))), "similarity": join(scores) / 1e4})

    return tile


def nearest(queries: DataFrame, reference: DataFrame, k: int = 5, qid: str = "id", rid: str = "id", fp: str = "fp") -> DataFrame:
    """query_id, reference_id, similarity, rank: the k most similar reference rows of each query, exactly.

    Similarities are compared as rounded to 4 places, then ids decide. All pairs are compared, in tiles of at most some TILE reference
    rows and ASKED queries, a tile a task: by popcounts of shared words, with the bound that a sample of the tile's rows proves. Memory
    is bounded by a tile, work by queries times reference rows. A query with fewer than k rows that share a bit is filled up with
    others by id. Fingerprints are arrays of 64-bit words of one length; null ones have no bits.
    """
    none = F.array().cast("array<long>")
    r = cut(reference.select(F.col(rid).alias("reference_id"), F.coalesce(fp, none).alias("fp")).distinct(), "references")
    q = cut(queries.select(F.col(qid).alias("query_id"), F.coalesce(fp, none).alias("fp")).distinct(), "queries")
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "reference_id")

    # An id with several fingerprints may take several places of a tile's best.
    rows = r.groupBy("reference_id").agg(F.count("*").alias("n")).agg(F.max("n").alias("same"), F.sum("n").alias("n")).first()
    down, across = (rows["n"] or 0) // TILE + 1, q.count() // ASKED + 1
    tile = lambda d, n, key, m, other: d.select("*", F.pmod(F.xxhash64(*d.columns), F.lit(n)).cast("int").alias(key), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other))
    sides = tile(r, down, "_d", across, "_a").withColumn("_asks", F.lit(False)).unionByName(tile(q, across, "_a", down, "_d").withColumn("_asks", F.lit(True)), allowMissingColumns=True)
    most, seeds = k * (rows["same"] or 1), SEEDS
    schema = StructType([q.schema["query_id"], r.schema["reference_id"], StructField("similarity", DoubleType())])
    met = sides.repartition(min(down * across, 2_000), "_d", "_a").groupBy("_d", "_a").applyInArrow(_best(most, seeds), schema).distinct()
    top = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    top = cut(top, "nearest")

    short = q.select("query_id").distinct().join(top.groupBy("query_id").agg(F.count("*").alias("_n")), "query_id", "left").where(F.coalesce("_n", F.lit(0)) < k).select("query_id", F.coalesce("_n", F.lit(0)).alias("_n"))
    firsts = r.select("reference_id").distinct().orderBy("reference_id").limit(2 * k)
    rest = short.join(F.broadcast(firsts)).join(top.select("query_id", "reference_id"), ["query_id", "reference_id"], "left_anti")  # 2 k rows
    more = rest.withColumn("similarity", F.lit(0.0)).withColumn("rank", (F.col("_n") + F.row_number().over(order)).cast("int")).where(F.col("rank") <= k)
    return top.unionByName(more.select("query_id", "reference_id", "similarity", "rank"))


def novel_only(molecules: DataFrame, similarity: DataFrame, limit: float = 0.7) -> DataFrame:
    """Molecules whose best similarity is under the limit; if none is, all of them."""
    best = similarity.groupBy(F.col("query_id").alias("id")).agg(F.max("similarity").alias("_s"))
    held = molecules.join(best, "id", "left").withColumn("_new", F.coalesce(F.col("_s") < limit, F.lit(True)))
    some = held.agg(F.max("_new").alias("_some"))
    return held.join(F.broadcast(some)).where(F.col("_new") | ~F.col("_some")).drop("_s", "_new", "_some")  # one row


def generation_metrics(generated: DataFrame, training: DataFrame) -> DataFrame:
    """One row: n, validity, uniqueness (of valid), novelty (of unique); zeros where the base is empty.

    generated: smiles, canonical (null where invalid); training: canonical.
    """
    valid = generated.where("canonical is not null")
    unique = valid.select("canonical").distinct()
    new = unique.join(training.select("canonical").distinct(), "canonical", "left_anti")
    counts = [generated.agg(F.count("*").alias("n")), valid.agg(F.count("*").alias("n_valid")), unique.agg(F.count("*").alias("n_unique")), new.agg(F.count("*").alias("n_novel"))]
    row = reduce(lambda a, b: a.join(F.broadcast(b)), counts)  # single rows
    share = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 6)).otherwise(0.0)
    return row.select("n", share("n_valid", "n").alias("validity"), share("n_unique", "n_valid").alias("uniqueness"), share("n_novel", "n_unique").alias("novelty"))


def diversity(molecules: DataFrame, most: int = 1000) -> DataFrame:
    """1 - mean pairwise similarity over at most `most` molecules in hash order: the sample is the feature."""
    s = molecules.orderBy(F.xxhash64("id"), "id").limit(most).select("id", "fp")
    pairs = s.alias("a").join(s.alias("b"), F.col("a.id") < F.col("b.id")).select(tanimoto(F.col("a.fp"), F.col("b.fp")).alias("s"))
    return pairs.agg(F.round(1 - F.avg("s"), 6).alias("diversity"), F.count("*").alias("n_pairs"))


def unpivoted(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    return rows.select(*keys, *(F.col(c).cast("double").alias(c) for c in columns)).unpivot(keys, columns, "property", "value").where("value is not null")


def property_summary(rows: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    by = by or []
    v = F.col("value")
    return unpivoted(rows, by, columns).groupBy(*by, "property").agg(F.count("*").alias("n"), F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_pop(v), 6).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), F.median(v).alias("median"))


def ks_statistic(rows: DataFrame, columns: list[str], sample: str) -> DataFrame:
    """property, n_a, n_b, statistic, p_value between the two values of the boolean column `sample`.

    Cumulative counts over distinct values, by window within each property; p from the asymptotic series, in columns.
    """
    each = unpivoted(rows, [sample], columns).groupBy("property", "value").agg(F.count_if(F.col(sample)).alias("a"), F.count_if(~F.col(sample)).alias("b"))
    upto = Window.partitionBy("property").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy("property")
    each = each.select("property", (F.sum("a").over(upto) / F.sum("a").over(every) - F.sum("b").over(upto) / F.sum("b").over(every)).alias("d"), F.sum("a").over(every).alias("na"), F.sum("b").over(every).alias("nb"))
    out = each.groupBy("property").agg(F.max(F.abs("d")).alias("d"), F.first("na").alias("n_a"), F.first("nb").alias("n_b"))
    z = F.sqrt(F.col("n_a") * F.col("n_b") / (F.col("n_a") + F.col("n_b"))) * F.col("d")
    p = reduce(lambda s, k: s + F.lit(2.0 * (-1) ** (k - 1)) * F.exp(-2.0 * k * k * z * z), range(1, 21), F.lit(0.0))
    return out.select("property", "n_a", "n_b", F.round("d", 6).alias("statistic"), F.round(F.when(z < 0.3, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), p))), 6).alias("p_value"))


def vocabulary(molecules: DataFrame, smiles: str = "smiles") -> DataFrame:
    """token, id: special tokens first, then all others in order."""
    spark = molecules.sparkSession
    tokens = molecules.select(F.explode(smiles_tokens(smiles)).alias("token")).distinct()
    own = tokens.select("token", (F.row_number().over(Window.orderBy("token")) + len(SPECIAL) - 1).alias("id"))  # an alphabet: tens of rows
    quoted = ", ".join(f"('{t}', {i})" for i, t in enumerate(SPECIAL))
    return spark.sql(f"SELECT * FROM VALUES {quoted} AS t(token, id)").union(own)


def min_max(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows with each column scaled to 0..1 by the range over all rows; 0.5 where the range is empty."""
    fit = rows.agg(*(F.min(c).alias(f"_lo_{c}") for c in columns), *(F.max(c).alias(f"_hi_{c}") for c in columns))
    held = rows.join(F.broadcast(fit))  # one row
    out = {f"{c}_scaled": F.when(F.col(f"_hi_{c}") > F.col(f"_lo_{c}"), (F.col(c) - F.col(f"_lo_{c}")) / (F.col(f"_hi_{c}") - F.col(f"_lo_{c}"))).otherwise(0.5) for c in columns}
    return held.withColumns(out).drop(*(f"_{e}_{c}" for e in ("lo", "hi") for c in columns))
