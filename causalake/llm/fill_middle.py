"""Operator 13, fill-in-middle transformation: a text cut at two of its units and written prefix, suffix, middle.

Relational: the units of a text are exploded with their ordinals, running sums of their lengths give where each ends,
cut requests meet them by ordinal, and the two offsets of a document are aggregated. Only lengths are shuffled for that;
texts meet their offsets in one join. Cuts depend on key and text alone, so rows equal in both share one request and
are combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import guarded, read

#: Units of the contract: lines with their ends.
LINES = r"[^\n]*\n|[^\n]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
EXTRA = ("n", "form", "prefix_chars", "middle_chars", "fim_text")


def _draw(h: Column, group: int) -> Column:
    """The group-th 8 hex digits (from 1) of a digest as a number."""
    return F.conv(F.substring(h, 8 * group - 7, 8), 16, 10).cast("long")


def _planned(docs: DataFrame, seed: int, fim_percent: int, spm_percent: int, unit: str, key: str, text: str) -> DataFrame:
    """docs with _t (text without nulls), _k (identity), n, form, and the ordinals _i and _j after which to cut."""
    t, h = F.col("_t"), F.col("_h")
    marked = F.lit(False)
    for m in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | t.contains(m)
    held = docs.withColumn("_t", F.coalesce(F.col(text), F.lit(""))).withColumn("_h", F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256))
    held = held.withColumn("n", F.regexp_count(t, F.lit(unit)).cast("long"))
    plain = (t == "") | marked | (_draw(h, 3) % 100 >= fim_percent)
    held = held.withColumn("form", F.when(plain, "plain").when(_draw(h, 4) % 100 < spm_percent, "spm").otherwise("psm"))
    a, b = _draw(h, 1) % (F.col("n") + 1), _draw(h, 2) % (F.col("n") + 1)
    held = held.withColumn("_i", F.least(a, b).cast("int")).withColumn("_j", F.greatest(a, b).cast("int"))
    return held.withColumn("_k", F.unhex(F.sha2(F.concat(h, t), 256))).drop("_h")


def _offsets(planned: DataFrame, unit: str) -> DataFrame:
    """_k, _a, _b: code points before the two cuts; a cut before the first unit has no row and counts as 0."""
    cut = planned.where(F.col("form") != "plain").where("_j > 0")
    # No unit behind the later cut moves an offset.
    sizes = cut.select("_k", F.slice(F.transform(F.regexp_extract_all("_t", F.lit(unit), F.lit(0)), F.length), F.lit(1), F.col("_j")).alias("_sizes"))
    units = sizes.groupBy("_k").agg(F.first("_sizes").alias("_sizes")).select("_k", F.posexplode("_sizes").alias("_pos", "_size"))
    ends = units.select("_k", (F.col("_pos") + 1).alias("_unit"), F.sum("_size").over(Window.partitionBy("_k").orderBy("_pos")).alias("_end"))
    asked = cut.select(F.col("_k").alias("_rk"), "_i", "_j").distinct()
    asked = asked.select("_rk", F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("_i").alias("at")), F.struct(F.lit("b").alias("side"), F.col("_j").alias("at")))).alias("_r"))
    # Both sides are dealt by document; the ordinals are compared within it.
    met = ends.join(asked, (F.col("_k") == F.col("_rk")) & (F.col("_unit") - F.col("_r.at") == 0))
    side = lambda s: F.max(F.when(F.col("_r.side") == s, F.col("_end")))
    return met.groupBy("_k").agg(side("a").alias("_a"), side("b").alias("_b")).withColumnRenamed("_k", "_ok")


def fill_in_middle(docs: DataFrame, seed: int = 7, fim_percent: int = 100, spm_percent: int = 50, unit: str = LINES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with n (units), form (plain, psm, spm), prefix_chars, middle_chars (null if plain) and fim_text.

    Draws are digits of a hash of seed and key: reruns agree, and rows of one key get the same draws. `unit` is a pattern
    whose matches, left to right, cover a text. Null and empty texts give n = 0, form plain, an empty fim_text. A text that
    holds a marker stays plain. A null key counts as an empty one. Repeated rows each get the same result, a third of
    all rows too: they are combined before units are dealt out. Whole texts are cut, however long: what is held of a text
    at once is its units' lengths. An empty table gives an empty result. Columns of docs named like one of the five new ones are replaced;
    others may have any name.
    """

    def run(d: DataFrame) -> DataFrame:
        planned = _planned(d, seed, fim_percent, spm_percent, unit, key, text)
        held = planned.join(_offsets(planned, unit), F.col("_k") == F.col("_ok"), "left")
        a, b = F.coalesce("_a", F.lit(0)).cast("int"), F.coalesce("_b", F.lit(0)).cast("int")
        t, cut = F.col("_t"), F.col("form") != "plain"
        parts = F.substring(t, F.lit(1), a), F.substring(t, a + 1, b - a), F.substring(t, b + 1, F.length(t))
        psm = F.concat(F.lit(PREFIX), parts[0], F.lit(SUFFIX), parts[2], F.lit(MIDDLE), parts[1])
        spm = F.concat(F.lit(SUFFIX), parts[2], F.lit(PREFIX), parts[0], F.lit(MIDDLE), parts[1])
        out = F.when(~cut, t).when(F.col("form") == "psm", psm).otherwise(spm)
        return held.select(*d.columns, "n", "form", F.when(cut, a.cast("long")).alias("prefix_chars"), F.when(cut, (b - a).cast("long")).alias("middle_chars"), out.alias("fim_text"))

    return guarded(docs, (key, text), run, EXTRA)


def original(fim_text: str = "fim_text", form: str = "form") -> Column:
    """The text that a transformed one came from, by its markers. No marker can begin inside another or in a text that
    was cut, so the first of each kind is the one that was set."""
    x = F.col(fim_text)

    def between(first: str, second: str | None) -> Column:
        start = F.locate(first, x) + len(first)
        return F.substring(x, start, F.locate(second, x) - start if second else F.length(x))

    psm = F.concat(between(PREFIX, SUFFIX), between(MIDDLE, None), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), between(MIDDLE, None), between(SUFFIX, PREFIX))
    return F.when(F.col(form) == "plain", x).when(F.col(form) == "psm", psm).otherwise(spm)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut at two of its lines."""
    out = fill_in_middle(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("fim_text", 256).alias("output_sha256"), F.sha2(original(), 256).alias("restored_sha256"))


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (
  SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS units, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
    ('0x' || substr(h, 25, 8))::BIGINT AS h4, t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') AS plain FROM d),
c AS (
  SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS i, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS j FROM u),
p AS (
  SELECT *, coalesce(array_to_string(units[1:i], ''), '') AS pre, coalesce(array_to_string(units[i + 1:j], ''), '') AS mid,
    coalesce(array_to_string(units[j + 1:n], ''), '') AS suf FROM c)
SELECT doc_id, n::BIGINT AS n, CASE WHEN plain THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
  CASE WHEN NOT plain THEN length(pre)::BIGINT END AS prefix_chars, CASE WHEN NOT plain THEN length(mid)::BIGINT END AS middle_chars,
  sha256(CASE WHEN plain THEN t WHEN h4 % 100 < 50 THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE '<P>' || pre || '<S>' || suf || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
