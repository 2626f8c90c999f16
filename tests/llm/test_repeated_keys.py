"""Operator 9 on rows that share a doc_id."""

import numpy as np
from pyspark.sql import functions as F

from causalake.llm import substring_dedup


def test_rows_of_one_key_are_told_apart(spark):
    """Texts whose 64-bit hashes agree in 16 bits, in one key: each loses its own copied words alone."""
    lead = " ".join(f"w{i}" for i in range(40))
    made = spark.range(3000).select(F.concat(F.lit("own "), F.col("id").cast("string"), F.lit(" "), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(19)), lambda k: F.concat(F.lit("v"), F.col("id") * 100 + k)), " ")).alias("text"))
    rows = made.withColumn("low", F.pmod(F.xxhash64("text"), F.lit(1 << 16))).collect()
    by: dict = {}
    for r in rows:
        by.setdefault(r.low, []).append(r.text)
    one, other = next(v for v in by.values() if len(v) > 1)[:2]
    docs = spark.createDataFrame([(1, lead), (1, one), (2, other), (2, one), (3, lead)], "doc_id long, text string")
    out = {(r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.deduplicated(docs).collect()}
    assert out == {(1, 40, 0), (1, 22, 0), (2, 22, 0), (2, 22, 22), (3, 40, 40)}
    assert np.sum([r.n_removed for r in substring_dedup.deduplicated(docs.where("doc_id = 2")).collect()]) == 0
