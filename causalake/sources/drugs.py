"""The drug star: indications, drugs, mechanisms, targets, components, synonyms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import drug_evidence

# Target types that are no proteins, and generic names that are no symbols.
NO_PROTEIN = ("organism", "cell-line", "tissue", "unknown")
NO_SYMBOL = (
    "reverse", "transcriptase", "protease", "integrase",
    "polymerase", "reductase", "synthase", "synthetase",
    "kinase", "transferase", "transporter", "receptor",
    "inhibitor", "activator", "regulator", "protein",
    "antigen", "toxin", "capsid", "envelope",
)


def star(indications: DataFrame, molecules: DataFrame | None, mechanisms: DataFrame, targets: DataFrame, components: DataFrame, sequences: DataFrame, term: str, other: str | None = None) -> DataFrame:
    """Targets of the drugs indicated for a disease: three inner and two outer joins over tables in ChEMBL's layout.

    indications: molregno, mesh_heading, efo_term; molecules: molregno, pref_name (None where indications already has
    `drug`); mechanisms: molregno, tid; targets: tid, pref_name, organism, target_type; components: tid, component_id;
    sequences: component_id, accession. mechanism_of_action and max_phase_for_ind may come with indications or
    mechanisms. A heading that contains `term`, or an EFO term that contains `other` (`term` if null), is the
    disease; the test is `contains`, so that % and _ mean themselves. Null headings and terms are no match.
    """
    named = F.coalesce(F.lower("mesh_heading").contains(term.lower()), F.lit(False)) | F.coalesce(F.lower("efo_term").contains((other or term).lower()), F.lit(False))
    held = indications.where(named)
    if molecules is not None:
        held = held.join(molecules.select("molregno", F.col("pref_name").alias("drug")), "molregno")
    held = held.join(mechanisms, "molregno").join(targets.select("tid", F.col("pref_name").alias("target_name"), "organism", "target_type"), "tid")
    held = held.join(components.select("tid", "component_id"), "tid", "left").join(sequences.select("component_id", "accession"), "component_id", "left")
    return held.select("tid", "target_name", "target_type", "organism", "component_id", "accession", "drug", F.col("mechanism_of_action").alias("mechanism"), F.col("max_phase_for_ind").cast("int").alias("phase"))


def roll_up(rows: DataFrame) -> DataFrame:
    """max_phase, n_drugs, n_mechanisms and the evidence score of each target."""
    held = rows.groupBy("tid").agg(F.max("phase").alias("max_phase"), F.count_distinct("drug").alias("n_drugs"), F.count_distinct("mechanism").alias("n_mechanisms"))
    return held.withColumn("score", drug_evidence("max_phase", "n_drugs", "n_mechanisms"))


def top_targets(rows: DataFrame, n: int) -> DataFrame:
    """The n targets with the highest phase and most drugs; only then those that are no proteins drop."""
    return rows.orderBy(F.desc("max_phase"), F.desc("n_drugs"), "tid").limit(n).where(~F.col("target_type").isin(*NO_PROTEIN))


def human_symbols(synonyms: DataFrame) -> DataFrame:
    """component_id, symbol: the first gene symbol of each component, by one window for all."""
    w = Window.partitionBy("component_id").orderBy("ord")
    return synonyms.where("syn_type = 'GENE_SYMBOL'").withColumn("_n", F.row_number().over(w)).where("_n = 1").select("component_id", F.col("synonym").alias("symbol"))


def pathogen_symbols(synonyms: DataFrame, stop: tuple[str, ...] = NO_SYMBOL) -> DataFrame:
    """component_id, symbol: the shortest acceptable gene symbol, else the shortest short accession-like synonym."""
    s, n = F.col("synonym"), F.length("synonym")
    gene = (F.col("syn_type") == "GENE_SYMBOL") & (n >= 2) & ~F.lower(s).isin(*(stop or ("",)))
    other = (F.col("syn_type") == "UNIPROT") & (n <= 15) & ~s.contains(" ") & s.rlike("[A-Z]")
    rank = F.when(gene, 0).when(other, 1)
    rows = synonyms.withColumn("_r", rank).where("_r is not null")
    return rows.groupBy("component_id").agg(F.min_by("synonym", F.struct("_r", n.alias("n"), "ord")).alias("symbol"))


def organism_slug(x):
    """Genus initial and species, as in p_falciparum."""
    words = F.split(F.lower(F.trim(x)), r"\s+")
    return F.when(F.size(words) >= 2, F.concat_ws("_", F.substring(words[0], 1, 1), words[1])).otherwise(words[0])


def is_human(x):
    return F.coalesce(F.lower(x).contains("homo sapiens"), F.lit(False))


def dedup_targets(nodes: DataFrame) -> DataFrame:
    """One row for each node_id: drugs and mechanisms united, highest phase, score anew."""
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    held = nodes.groupBy("node_id").agg(F.max("max_phase").alias("max_phase"), union("drugs").alias("drugs"), union("mechanisms").alias("mechanisms"))
    return held.withColumn("score", drug_evidence("max_phase", F.size("drugs"), F.size("mechanisms")))
