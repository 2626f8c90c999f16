"""Run records over distributed rows: digests that don't depend on order, finalised records, integrity findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How a run can end, and the size above which a record needs leave.
STATUSES = ("complete", "failed", "incomplete")
MOST_BYTES = 250 * 1024 * 1024
LIMBS = 4


def row_text(fields: list[str]) -> Column:
    """A row as one text: values by field name, a control mark between them, another for null."""
    return F.concat_ws("\x1f", *(F.coalesce(F.col(f).cast("string"), F.lit("\x00")) for f in sorted(fields)))


def run_digests(rows: DataFrame, fields: list[str], run: str = "run") -> DataFrame:
    """run, n_rows, size_bytes, digest: a digest of each run's rows as a multiset, whatever their order, files or partitions.

    A row's SHA-256 is cut into 32-bit limbs that are summed one by one in 38 digits, so rows are combined where they
    are and a run of any size sends a few numbers a task. Repeated rows count each time; rows of a null run are a run of their own.
    """
    held = rows.select(F.col(run).alias("run"), row_text(fields).alias("_t")).select("run", F.octet_length("_t").alias("_b"), F.sha2("_t", 256).alias("_h"))
    limb = lambda i: F.sum(F.conv(F.substring("_h", 8 * i + 1, 8), 16, 10).cast("decimal(38,0)"))
    sums = held.groupBy("run").agg(F.count("*").alias("n_rows"), F.sum("_b").alias("size_bytes"), *(limb(i).alias(f"_{i}") for i in range(LIMBS)))
    joined = F.concat_ws(":", F.col("n_rows").cast("string"), *(F.col(f"_{i}").cast("string") for i in range(LIMBS)))
    return sums.select("run", "n_rows", "size_bytes", F.sha2(joined, 256).alias("digest"))


def finalised(runs: DataFrame, rows: DataFrame, fields: list[str], most_bytes: int = MOST_BYTES) -> DataFrame:
    """run, status, citable, n_rows, size_bytes, digest, refused: the record of each run (run, status, git_dirty, allow_large).

    A run is citable if it is complete and its tree was clean. It is refused, with the reason, if its status is none of STATUSES or
    its rows are larger than most_bytes without leave; a refused run has no digest and isn't citable. A run without rows has 0.
    """
    held = runs.join(run_digests(rows, fields), "run", "left")
    n, size = F.coalesce("n_rows", F.lit(0)), F.coalesce("size_bytes", F.lit(0))
    refused = F.when(~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)), "unknown status").when((size > most_bytes) & ~F.coalesce("allow_large", F.lit(False)), "too large")
    empty = F.sha2(F.lit("0" + ":0" * LIMBS), 256)
    return held.select("run", "status", (refused.isNull() & (F.col("status") == "complete") & ~F.coalesce("git_dirty", F.lit(True))).alias("citable"), n.alias("n_rows"), size.alias("size_bytes"), F.when(refused.isNull(), F.coalesce("digest", empty)).alias("digest"), refused.alias("refused"))


def integrity_findings(records: DataFrame, rows: DataFrame, fields: list[str], tracked: DataFrame | None = None) -> DataFrame:
    """run, finding, expected, actual: what is wrong with stored records, one row for each finding.

    records: run, citable, n_rows, digest. `no record`: rows of a run that was never finalised; `rows`: another number of rows than the
    record claims; `no digest`: an old or cut record; `digest`: rows were edited after the record; `not citable`: a record in
    `tracked` (run; all records where not given) that backs no claim.
    """
    now = run_digests(rows, fields).select(F.col("run").alias("_run"), F.col("n_rows").alias("_n"), F.col("digest").alias("_d"))
    kept = records.select("run", "citable", "n_rows", "digest", F.lit(True).alias("_held"))
    if tracked is None:
        kept = kept.withColumn("_tracked", F.lit(True))
    else:
        kept = kept.join(tracked.select("run", F.lit(True).alias("_tracked")).distinct(), "run", "left")
    both = kept.join(now, F.col("run").eqNullSafe(F.col("_run")), "full").withColumn("run", F.coalesce("run", "_run"))
    n = F.coalesce("_n", F.lit(0))
    found = lambda name, test, a, b: F.when(test, F.struct(F.lit(name).alias("finding"), a.cast("string").alias("expected"), b.cast("string").alias("actual")))
    held, empty = F.coalesce("_held", F.lit(False)), F.sha2(F.lit("0" + ":0" * LIMBS), 256)
    none = F.lit(None)
    findings = F.array(
        found("no record", ~held, none, n),
        found("rows", held & ~F.col("n_rows").eqNullSafe(n), F.col("n_rows"), n),
        found("no digest", held & F.col("digest").isNull(), none, F.col("_d")),
        found("digest", held & (F.col("digest") != F.coalesce("_d", empty)), F.col("digest"), F.coalesce("_d", empty)),
        found("not citable", held & F.coalesce("_tracked", F.lit(False)) & ~F.coalesce("citable", F.lit(False)), none, none),
    )
    return both.select("run", F.explode(F.filter(findings, lambda x: x.isNotNull())).alias("f")).select("run", "f.*")
