"""Validation of found targets against known ones, identification summaries, and findings of gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import match_key, name_tokens
from ..schemas import REASONS


def token_matches(found: DataFrame, truth: DataFrame, name: str = "name") -> DataFrame:
    """Rows of found whose name, or a part of it between - and /, is a true name: tokens turn the match into an equi join."""
    keys = truth.select(match_key("name").alias("_k")).distinct()
    ids = found.select(name, F.explode(name_tokens(name)).alias("_k")).join(keys, "_k", "left_semi").select(name).distinct()
    return found.join(ids, name, "left_semi")


def precision_recall(found: DataFrame, truth: DataFrame, by: str) -> DataFrame:
    """by, n_found, hits, n_truth, precision, recall, f1; recall is over true names that were found."""
    f = found.select(by, match_key("name").alias("k")).distinct()
    t = truth.select(by, match_key("name").alias("k")).distinct().withColumn("_hit", F.lit(1))
    a = f.join(t, [by, "k"], "left").groupBy(by).agg(F.count("*").alias("n_found"), F.count("_hit").alias("hits"))
    n = t.groupBy(by).agg(F.count("*").alias("n_truth"))
    rows = a.join(n, by)
    f1 = F.when(F.col("hits") > 0, 2.0 * F.col("hits") / (F.col("n_found") + F.col("n_truth"))).otherwise(0.0)
    return rows.select(by, "n_found", "hits", "n_truth", F.round(F.col("hits") / F.col("n_found"), 4).alias("precision"), F.round(F.col("hits") / F.col("n_truth"), 4).alias("recall"), F.round(f1, 4).alias("f1"))


def identification_summary(verdicts: DataFrame) -> DataFrame:
    """reason, n, share, mean_near_miss (of trivial verdicts) for all seven reasons, zeros included."""
    spark = verdicts.sparkSession
    quoted = ", ".join(f"('{r}', {i})" for i, r in enumerate(REASONS))
    every = spark.sql(f"SELECT * FROM VALUES {quoted} AS t(reason, ord)")
    held = verdicts.groupBy("reason").agg(F.count("*").alias("n"), F.avg(F.when(F.col("reason") == "identifiable_trivially", F.col("n_near_miss"))).alias("mean_near_miss"))
    total = verdicts.agg(F.count("*").alias("_t"))
    rows = every.join(held, "reason", "left").join(F.broadcast(total))  # one row
    n = F.coalesce("n", F.lit(0))
    return rows.select("reason", n.alias("n"), F.when(F.col("_t") > 0, F.round(n / F.col("_t"), 6)).otherwise(0.0).alias("share"), F.round("mean_near_miss", 6).alias("mean_near_miss"))


def citation_findings(cited: DataFrame, records: DataFrame) -> DataFrame:
    """run, finding for cited runs that have no record or aren't citable."""
    rows = cited.join(records.select("run", F.lit(True).alias("_r")).distinct(), "run", "left")
    why = F.when(F.col("_r").isNull(), "missing").when(~F.col("citable"), "not citable")
    return rows.select("run", why.alias("finding")).where("finding is not null")


def baseline(assoc: DataFrame, truth: DataFrame, n: int = 20) -> DataFrame:
    """The correlation-only baseline: top n by score of every disease, with hits and the ranks of misses."""
    from .ranking import ranked

    best = assoc.groupBy("disease_id", "target_symbol").agg(F.max("score").alias("score"))
    top = ranked(best, "score", ["target_symbol"], ["disease_id"]).where(F.col("rank") <= n)
    t = truth.select("disease_id", match_key("name").alias("_k")).distinct().withColumn("_hit", F.lit(True))
    rows = top.withColumn("_k", match_key("target_symbol")).join(t, ["disease_id", "_k"], "left")
    return rows.groupBy("disease_id").agg(F.count("_hit").alias("hits"), F.array_sort(F.collect_list(F.when(F.col("_hit").isNull(), F.col("rank")))).alias("false_positive_ranks"))


def graded(found: DataFrame, truth: DataFrame, wrong: DataFrame, by: str = "disease_id") -> DataFrame:
    """A report for each disease: counts, precision, recall, f1 (3 places), grade, true and known false positives, missed, warnings.

    found: by, name, is_causal; truth: by, gene, drug; wrong: by, gene, reason. Names fold case. Precision is of causal names, and a name
    counts if it or a part between - and / is a true gene; a true gene is missed if no name, causal or not, has it. A disease without
    true genes isn't validated. Names are exploded into parts and met by equality; the lists are as long as a disease's genes.
    """
    names = found.where(F.col("name").isNotNull()).select(by, F.upper(F.trim("name")).alias("name"), "is_causal").groupBy(by, "name").agg(F.max(F.coalesce("is_causal", F.lit(False))).alias("c"))
    parts = names.select(by, "name", "c", F.explode(name_tokens("name")).alias("k")).withColumn("k", F.upper("k"))
    known = truth.select(by, F.upper(F.trim("gene")).alias("k"), "drug").groupBy(by, "k").agg(F.max("drug").alias("drug"))
    bad = wrong.select(by, F.upper(F.trim("gene")).alias("k"), "reason").groupBy(by, "k").agg(F.max("reason").alias("reason"))
    sets = lambda c, n: F.array_sort(F.collect_set(c)).alias(n)

    def hits(table: DataFrame, n: str) -> DataFrame:
        return parts.where("c").join(table.select(by, "k"), [by, "k"]).groupBy(by).agg(sets("name", n))

    missed = known.join(parts.select(by, "k").distinct(), [by, "k"], "left_anti")
    note = F.concat(F.lit("MISSED: "), "k", F.when(F.coalesce("drug", F.lit("")) != "", F.concat(F.lit(" (targeted by "), "drug", F.lit(")"))).otherwise(""), F.lit(" is an established target not identified"))
    missed = missed.groupBy(by).agg(sets("k", "missed_targets"), F.transform(F.array_sort(F.collect_list(F.struct("k", note.alias("w")))), lambda x: x["w"]).alias("_m"))
    false = parts.where("c").join(bad.select(by, "k"), [by, "k"]).select(by, "name").distinct().join(bad.withColumnRenamed("k", "name"), [by, "name"], "left")
    why = F.concat(F.lit("FALSE POSITIVE: "), "name", F.lit(" is a known non-target ("), F.coalesce("reason", F.lit("known non-target")), F.lit(")"))
    false = false.groupBy(by).agg(sets("name", "false_positives_known"), F.transform(F.array_sort(F.collect_list(F.struct("name", why.alias("w")))), lambda x: x["w"]).alias("_f"))
    rows = found.select(by).distinct().join(names.groupBy(by).agg(F.count_if("c").alias("n_identified")), by, "left")
    rows = rows.join(known.groupBy(by).agg(F.count("*").alias("n_truth")), by, "left")
    for t in (hits(known, "true_positives"), false, missed):
        rows = rows.join(t, by, "left")
    none, n = F.array().cast("array<string>"), F.coalesce("n_identified", F.lit(0))
    rows = rows.withColumns({c: F.coalesce(c, none) for c in ("true_positives", "false_positives_known", "missed_targets", "_f", "_m")})
    valid, tp = F.col("n_truth").isNotNull(), F.size("true_positives")
    p, r = F.when(n > 0, tp / n).otherwise(0.0), tp / F.col("n_truth")
    rows = rows.withColumns({"_p": p, "_r": r}).withColumn("_h", F.when(F.col("_p") + F.col("_r") > 0, 2 * F.col("_p") * F.col("_r") / (F.col("_p") + F.col("_r"))).otherwise(0.0))
    grade = F.when(F.col("_h") > 0.7, "A").when(F.col("_h") > 0.4, "B").when(F.col("_h") > 0.2, "C").otherwise("F")
    low = F.when((n > 0) & (F.col("_p") < 0.5), F.array(F.concat(F.lit("LOW PRECISION: Only "), F.bround(F.col("_p") * 100, 0).cast("int").cast("string"), F.lit("% of identified causal targets are validated")))).otherwise(none)
    of = lambda c: F.when(valid, c)
    return rows.select(
        by, valid.alias("validated"), n.alias("n_identified"), of(F.round("_p", 3)).alias("precision"), of(F.round("_r", 3)).alias("recall"), of(F.round("_h", 3)).alias("f1"), of(grade).alias("grade"),
        of(F.col("true_positives")).alias("true_positives"), of(F.col("false_positives_known")).alias("false_positives_known"), of(F.col("missed_targets")).alias("missed_targets"),
        of(F.concat("_f", "_m", low)).alias("warnings"),
    )
