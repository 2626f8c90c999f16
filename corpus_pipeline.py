"""The corpus pipeline: quality rules, near-duplicates, decontamination, secrets, mixing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept, written as Parquet and read
again. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causalake.llm import decontaminate, mixing, near_dedup, quality_rules, secrets
from causalake.llm.common import guarded, read, ship, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go.

    Null and empty texts have too few words and go. Equal texts get equal verdicts, whatever their number. Texts are
    judged whole. An empty table gives an empty result; other columns may have any name.
    """
    ship(spark)
    return quality_rules.passed(docs, read(spark, sf_dir, "labels").select("doc_id", "quality"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays, that with the smallest doc_id.

    Each null text stays, unless its row repeats; of equal empty texts one stays. Of rows with the same doc_id and text
    one stays. Texts are compared whole. An empty table gives an empty result; other columns may have any name.
    """
    ship(spark)
    return near_dedup.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; benchmark windows in the others are cut from the text, and n_chars follows.

    Null and empty texts have no words and stay. Equal texts get equal results; rows that repeat all stay. Texts are
    searched whole. An empty table gives an empty result; other columns may have any name.
    """
    bench = read(spark, sf_dir, "benchmark").select("item_id", "text")
    return _counted(decontaminate.decontaminated(docs, bench), docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark in the text, and n_chars follows; every document stays, repeated rows too.

    Null texts stay null and empty ones empty. Texts are scanned whole. Other columns may have any name.
    """
    ship(spark)
    return _counted(guarded(docs, ("text",), lambda d: secrets.secret_spans(d, redacted="text")), docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each time a document is taken, with `epoch` and `taken`; n_chars is the text's length.

    Null and empty texts have no words and aren't taken. A null source is a source of its own. Repeated rows are taken
    each for itself. Columns named epoch or taken are replaced; others may have any name. An empty table gives an empty mix.
    """
    ship(spark)
    mixed = mixing.mixed(docs)
    return mixed.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else mixed


def _counted(out: DataFrame, docs: DataFrame) -> DataFrame:
    """n_chars as the text's length where documents have that column; a null text keeps its null count or its old one."""
    if "n_chars" not in docs.columns:
        return out.select(*docs.columns)
    n = F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))
    return out.withColumn("n_chars", n).select(*docs.columns)


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret scans", secret_scans),
    ("mixing", mixture),
]

#: The forest of the first stage and the sampled signatures of the second are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents."""
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage-{i}-{name.replace(' ', '-')}")
    return docs
