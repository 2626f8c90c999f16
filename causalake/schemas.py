"""Canonical schemas and the closed vocabularies that operators test against."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, MapType, StringType, StructField, StructType


def _fields(**kinds) -> StructType:
    return StructType([StructField(k, v) for k, v in kinds.items()])


S, D, B, I = StringType(), DoubleType(), BooleanType(), IntegerType()  # noqa: E741

ASSOCIATIONS = _fields(target_id=S, target_symbol=S, disease_id=S, datatype=S, score=D)
INTERACTIONS = _fields(source_symbol=S, target_symbol=S, is_directed=B, consensus_direction=B, is_stimulation=B, is_inhibition=B, primary_sources=S, references=S)
NODES = _fields(graph_id=S, node_id=S, name=S, node_type=S, source=S, score=D, uniprot_id=S, pdb_ids=ArrayType(S), description=S, metadata=MapType(S, S))
EDGES = _fields(graph_id=S, source_id=S, target_id=S, edge_type=S, weight=D, source_db=S, evidence=S, pmids=ArrayType(S), evidence_class=S, sign=I, primary_sources=ArrayType(S))

# The vocabularies of the data model.
GENETIC = ("genetic_association", "somatic_mutation")
CAUSAL_EDGES = ("activates", "causes", "downregulates", "inhibits", "phosphorylates", "regulates", "upregulates")
GENE_LIKE = ("gene", "protein")
CANDIDATE_TYPES = ("gene", "protein", "pathogen_gene")
HUMAN = "9606"
REASONS = (
    "identifiable_by_adjustment",
    "identifiable_trivially",
    "no_causal_path",
    "cyclic_component",
    "no_valid_adjustment_set",
    "treatment_absent",
    "outcome_absent",
)
# Bounds of the adjustment search.
MAX_SET, MAX_POOL = 3, 20
# Outcome-bearing metadata that a live source may not add to a pinned node.
OUTCOME_KEYS = ("clinical_phase", "max_phase", "chembl_drug_evidence_score", "n_drugs", "drugs", "mechanisms_of_action", "is_druggable", "tractability")
