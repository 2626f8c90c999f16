"""Disease and target classes and the tissue gate. Word lists come as small dimension tables or ordered dictionaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col, match_key, starts_with_any
from .bio_tables import DISEASE_NAMES, ENTRY_FACTORS, ENTRY_TERMS, MARKER_FAMILIES

# Cancer words, immune prefixes and genes, cytokines.
CANCER = ("cancer", "carcinoma", "sarcoma", "blastoma", "oma", "leukemia", "lymphoma", "myeloma")
INFECTIOUS = ("infectious_viral", "infectious_parasitic", "infectious_bacterial")
IMMUNE_PREFIXES = ("TLR", "NOD", "NLRP", "RIG", "DDX58", "IFIH1", "STING", "TMEM173", "MAVS", "HLA-", "MHC")
IMMUNE_GENES = (
    "CD4", "CD8A", "CD8B", "CD14", "CD16", "CD56", "CD3D", "CD3E", "CD3G", "CD19", "CD20", "MS4A1", "IFNG", "IFNA1", "IFNB1", "IFNL1",
    "IL1B", "IL2", "IL4", "IL6", "IL10", "IL12A", "IL17A", "TNF", "TNFRSF1A", "TNFRSF1B", "CXCL8", "CXCL10", "CCL2", "CCL5", "STAT1", "STAT3", "STAT4", "IRF3", "IRF7",
)
CYTOKINES = ("TNF", "IL6", "IL1B", "CXCL8", "IL10")


def disease_class(name, table: dict[str, str] | None = None) -> Column:
    """Exact name, then the first pattern that contains or is contained, then cancer words, then other."""
    table, key = table or DISEASE_NAMES, match_key(name)
    out = F.when(F.lit(False), F.lit(""))
    for k, v in table.items():
        out = out.when(key == k, v)
    for k, v in table.items():
        out = out.when(key.contains(k) | F.lit(k).contains(key), v)
    return out.when(key.rlike("|".join(CANCER)), "cancer").otherwise("other")


def target_class(gene, disease, markers: Column, invades: Column, supported: Column) -> Column:
    """host_symptom, host_immune, host_invasion or correlational.

    markers: the gene is a symptom marker; invades: it is a known entry factor; supported: it has any evidence.
    """
    g, infectious = F.upper(F.trim(col(gene))), col(disease).isin(*INFECTIOUS)
    immune = g.isin(*IMMUNE_GENES) | starts_with_any(g, IMMUNE_PREFIXES)
    return (
        F.when(markers & infectious, "host_symptom")
        .when(g.isin(*CYTOKINES) & infectious, "host_symptom")
        .when(immune & infectious, "host_immune")
        .when(immune & (col(disease) == "autoimmune"), "host_invasion")
        .when(invades & infectious, "host_invasion")
        .when(~supported, "correlational")
        .otherwise("host_invasion")
    )


def _listed(genes: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    return genes.sparkSession.createDataFrame(rows, schema)


def classified_targets(genes: DataFrame, markers: DataFrame | None = None, invasion: DataFrame | None = None) -> DataFrame:
    """genes (gene, disease_class, supported) with family and target_type; markers: (gene, family), invasion: (gene).

    Without markers or invasion, the fixed families and entry factors count. Where genes has `go_terms` (an array), a
    term of entry makes a gene an entry factor too.
    """
    if markers is None:
        markers = _listed(genes, [(g, family) for family, held in MARKER_FAMILIES.items() for g in held.split()], "gene string, family string")
    if invasion is None:
        invasion = _listed(genes, [(g,) for g in ENTRY_FACTORS.split()], "gene string")
    m = markers.select(match_key("gene").alias("_k"), "family").dropDuplicates(["_k"])
    i = invasion.select(match_key("gene").alias("_k"), F.lit(True).alias("_i")).distinct()
    rows = genes.withColumn("_k", match_key("gene")).join(m, "_k", "left").join(i, "_k", "left")
    enters = F.coalesce("_i", F.lit(False))
    if "go_terms" in genes.columns:
        enters = enters | F.coalesce(F.arrays_overlap("go_terms", F.array(*map(F.lit, ENTRY_TERMS))), F.lit(False))
    kind = target_class("gene", "disease_class", F.col("family").isNotNull(), enters, F.col("supported"))
    return rows.withColumn("target_type", kind).drop("_k", "_i")


def tissue_gate(genes: DataFrame, expression: DataFrame, relevant: DataFrame, synonyms: DataFrame) -> DataFrame:
    """genes (gene, disease_id) with tissue_relevant, coverage: unknown tissues pass; else some must be shared.

    expression: (gene, tissue); relevant: (disease_id, tissue); synonyms: (tissue, canonical).
    """
    s = synonyms.select(F.lower("tissue").alias("_t"), F.lower("canonical").alias("_c")).dropDuplicates(["_t"])

    def canonical(rows: DataFrame, key: str, name: str) -> DataFrame:
        r = rows.select(key, F.lower(F.trim("tissue")).alias("_t")).distinct().join(s, "_t", "left")
        return r.groupBy(key).agg(F.array_sort(F.collect_set(F.coalesce("_c", "_t"))).alias(name))

    rows = genes.join(canonical(expression, "gene", "_g"), "gene", "left").join(canonical(relevant, "disease_id", "_d"), "disease_id", "left")
    shared = F.size(F.array_intersect("_g", "_d"))
    unknown = F.col("_g").isNull() | F.col("_d").isNull()
    return rows.select(*genes.columns, (unknown | (shared > 0)).alias("tissue_relevant"), F.when(unknown, 0.0).otherwise(F.round(shared / F.size("_g"), 4)).alias("coverage"))
