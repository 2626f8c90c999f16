"""Readers of association releases and interaction archives: explicit schemas, drift absorbed at the reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, MapType, StringType, StructField, StructType

from ..functions.text import flag
from ..schemas import HUMAN

_S = StringType()


def _struct(**kinds) -> StructType:
    return StructType([StructField(k, v) for k, v in kinds.items()])


JSON_RELEASE = _struct(target=_struct(id=_S, gene_info=_struct(symbol=_S)), disease=_struct(id=_S), association_score=_struct(datatypes=MapType(_S, DoubleType())))
#: Column names of each Parquet era: association columns, then target columns.
ERAS = {
    "21.11": {"target": "targetId", "disease": "diseaseId", "datatype": "datatypeId", "score": "score", "id": "id", "symbol": "approvedSymbol", "associations": "associationByDatatypeDirect", "targets": "targets"},
    "25.06": {"target": "targetId", "disease": "diseaseId", "datatype": "datatypeId", "score": "score", "id": "id", "symbol": "approvedSymbol", "associations": "association_by_datasource_direct", "targets": "target"},
}
# Time points and the releases pinned to them.
TIME_POINTS = {"2018-06": {"opentargets": "18.06"}, "2021-11": {"opentargets": "21.11"}, "2025-06": {"opentargets": "25.06", "omnipath": "20230728-20250813"}}


class UnmappedTargets(ValueError):
    """Associations name targets that the release's target table lacks."""


def _canonical(rows: DataFrame) -> DataFrame:
    kept = rows.where((F.col("score") > 0) & (F.trim("target_symbol") != "") & F.col("target_id").isNotNull() & F.col("disease_id").isNotNull())
    return kept.select(*(F.col(c).cast("string") for c in ("target_id", "target_symbol", "disease_id", "datatype")), F.col("score").cast("double").alias("score"))


def read_json_release(spark: SparkSession, path: str) -> DataFrame:
    """The JSON-lines era (gzip too): a row for each target, disease and datatype with a positive score. Bad JSON fails."""
    raw = spark.read.schema(JSON_RELEASE).option("mode", "FAILFAST").json(path)
    rows = raw.select(F.col("target.id").alias("target_id"), F.col("target.gene_info.symbol").alias("target_symbol"), F.col("disease.id").alias("disease_id"), F.explode("association_score.datatypes").alias("datatype", "score"))
    return _canonical(rows)


def unmapped(associations: DataFrame, targets: DataFrame) -> DataFrame:
    """target_id, n of associations without a target row."""
    return associations.join(targets.select(F.col("id").alias("target_id")), "target_id", "left_anti").groupBy("target_id").agg(F.count("*").alias("n"))


def join_targets(associations: DataFrame, targets: DataFrame, era: str = "25.06", check: bool = True) -> DataFrame:
    """Canonical rows of a Parquet era. With check, a target id that has no symbol fails the query itself."""
    k = ERAS[era]
    a = associations.select(*(F.col(k[c]).alias(n) for c, n in (("target", "target_id"), ("disease", "disease_id"), ("datatype", "datatype"), ("score", "score"))))
    t = targets.select(F.col(k["id"]).alias("target_id"), F.col(k["symbol"]).alias("target_symbol")).dropDuplicates(["target_id"])
    rows = a.join(t, "target_id", "left")
    if check:
        missing = F.raise_error(F.concat(F.lit("target without a symbol: "), F.coalesce("target_id", F.lit("null"))))
        rows = rows.withColumn("target_symbol", F.coalesce("target_symbol", missing.cast("string")))
    return _canonical(rows)


def read_release(spark: SparkSession, release: str, path: str) -> DataFrame:
    """The reader of a release's era; an unknown release is an error."""
    if release == "18.06":
        return read_json_release(spark, path)
    if release not in ERAS:
        raise ValueError(f"no reader for release {release}")
    k = ERAS[release]
    return join_targets(spark.read.parquet(f"{path}/{k['associations']}"), spark.read.parquet(f"{path}/{k['targets']}"), release)


def release_for(source: str, as_of: str) -> str:
    """The pinned release at a time point: an exact match, never the nearest."""
    try:
        return TIME_POINTS[as_of][source]
    except KeyError:
        raise ValueError(f"no release of {source} is pinned at {as_of}; known: {sorted(TIME_POINTS)}") from None


def read_archive(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """An interaction archive (tab-separated text, all strings) as canonical interactions, and one row of notes.

    Both ends must be human; an archive without organism columns is refused. A missing consensus column is taken
    from is_directed and noted.
    """
    raw = spark.read.option("sep", "\t").option("header", True).option("inferSchema", False).csv(path)
    return archive_interactions(raw)


def archive_interactions(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    need = {"ncbi_tax_id_source", "ncbi_tax_id_target"}
    if not need <= set(raw.columns):
        raise ValueError("the archive has no organism columns; its rows can't be told apart by species")
    synthetic = "consensus_direction" not in raw.columns
    if synthetic:
        raw = raw.withColumn("consensus_direction", F.col("is_directed"))
    human = F.coalesce((F.trim("ncbi_tax_id_source") == HUMAN) & (F.trim("ncbi_tax_id_target") == HUMAN), F.lit(False))
    notes = raw.agg(F.count("*").alias("n_rows"), F.count_if(~human).alias("n_other_organism"), F.lit(synthetic).alias("consensus_from_is_directed"))
    flags = [flag(c).alias(c) for c in ("is_directed", "consensus_direction", "is_stimulation", "is_inhibition")]
    rows = raw.where(human & (F.trim("source_genesymbol") != "") & (F.trim("target_genesymbol") != ""))
    return rows.select(F.trim("source_genesymbol").alias("source_symbol"), F.trim("target_genesymbol").alias("target_symbol"), *flags, F.coalesce("sources", F.lit("")).alias("primary_sources"), F.coalesce("references", F.lit("")).alias("references")), notes


def read_compressed_text(spark: SparkSession, path: str) -> DataFrame:
    """path, text of gzip, xz or plain files, told apart by their first bytes; one file is one row."""
    import gzip
    import lzma

    import pandas as pd

    def unpack(batches):
        for b in batches:
            texts = []
            for raw in b["content"]:
                raw = bytes(raw)
                raw = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else lzma.decompress(raw) if raw[:6] == b"\xfd7zXZ\x00" else raw
                texts.append(raw.decode())
            yield pd.DataFrame({"path": b["path"], "text": texts})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(unpack, "path string, text string")
