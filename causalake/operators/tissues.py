"""Tissues of diseases and genes, and whether a target is expressed where its disease is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import match_key
from .biology import disease_class

# Tissues of single diseases, in the order in which names are tried; tissues of classes; coarser names of tissues.
DISEASE_TISSUES = {
    "hiv": ("blood", "lymph node", "gut", "brain", "tonsil", "spleen", "bone marrow", "thymus", "liver"),
    "ebola": ("blood", "liver", "spleen", "lymph node", "lung", "kidney", "adrenal gland", "endothelium"),
    "covid-19": ("lung", "blood", "heart", "kidney", "brain", "liver", "intestine", "endothelium"),
    "hepatitis b": ("liver", "blood", "lymph node", "kidney"),
    "hepatitis c": ("liver", "blood", "lymph node"),
    "influenza": ("lung", "blood", "lymph node", "trachea"),
    "dengue": ("blood", "liver", "spleen", "bone marrow", "lymph node"),
    "malaria": ("blood", "liver", "spleen", "bone marrow", "placenta", "brain", "lung", "kidney", "endothelium"),
    "trypanosomiasis": ("blood", "brain", "lymph node", "heart"),
    "leishmaniasis": ("spleen", "liver", "bone marrow", "skin", "blood"),
    "tuberculosis": ("lung", "lymph node", "blood", "bone marrow", "liver", "spleen", "kidney"),
    "cholera": ("intestine", "blood", "kidney"),
    "typhoid": ("intestine", "blood", "liver", "spleen", "bone marrow"),
    "lung cancer": ("lung", "lymph node", "blood", "brain", "bone", "liver", "adrenal gland", "pleura"),
    "breast cancer": ("breast", "lymph node", "blood", "bone", "liver", "lung", "brain", "ovary"),
    "colorectal cancer": ("colon", "intestine", "liver", "lymph node", "blood", "lung", "peritoneum"),
    "pancreatic cancer": ("pancreas", "liver", "lymph node", "blood", "peritoneum", "lung"),
    "prostate cancer": ("prostate", "bone", "lymph node", "blood", "liver", "lung"),
    "melanoma": ("skin", "lymph node", "blood", "liver", "lung", "brain"),
    "glioblastoma": ("brain", "blood", "cerebral cortex"),
    "leukemia": ("blood", "bone marrow", "spleen", "lymph node", "liver"),
    "lymphoma": ("lymph node", "spleen", "blood", "bone marrow", "liver", "lung"),
    "type 2 diabetes": ("pancreas", "liver", "adipose tissue", "skeletal muscle", "kidney", "blood", "intestine", "brain"),
    "type 1 diabetes": ("pancreas", "blood", "lymph node", "thymus"),
    "obesity": ("adipose tissue", "liver", "brain", "skeletal muscle", "pancreas", "blood"),
    "alzheimer disease": ("brain", "cerebral cortex", "hippocampus", "blood", "liver", "choroid plexus"),
    "alzheimer's disease": ("brain", "cerebral cortex", "hippocampus", "blood", "liver", "choroid plexus"),
    "parkinson disease": ("brain", "substantia nigra", "cerebral cortex", "blood", "intestine"),
    "parkinson's disease": ("brain", "substantia nigra", "cerebral cortex", "blood", "intestine"),
    "huntington disease": ("brain", "cerebral cortex", "striatum", "blood"),
    "als": ("brain", "spinal cord", "skeletal muscle", "blood"),
    "rheumatoid arthritis": ("synovium", "blood", "lymph node", "joint", "bone marrow"),
    "lupus": ("blood", "kidney", "skin", "lymph node", "joint"),
    "multiple sclerosis": ("brain", "spinal cord", "blood", "lymph node"),
    "crohn's disease": ("intestine", "colon", "blood", "lymph node", "liver"),
    "heart failure": ("heart", "blood", "kidney", "lung", "liver"),
    "atherosclerosis": ("blood", "endothelium", "heart", "liver"),
    "cystic fibrosis": ("lung", "pancreas", "intestine", "liver", "sweat gland"),
    "sickle cell disease": ("blood", "bone marrow", "spleen", "liver", "kidney", "lung"),
}
CLASS_TISSUES = {
    "infectious_viral": ("blood", "lymph node", "spleen", "liver", "lung", "bone marrow", "thymus", "gut", "brain", "kidney", "endothelium"),
    "infectious_parasitic": ("blood", "liver", "spleen", "bone marrow", "lung", "brain", "kidney", "intestine", "skin", "endothelium"),
    "infectious_bacterial": ("blood", "lung", "lymph node", "liver", "spleen", "bone marrow", "kidney", "intestine", "brain"),
    "cancer": (
        "blood", "lymph node", "liver", "lung", "bone", "brain", "kidney", "skin", "breast", "prostate", "colon", "pancreas", "ovary", "stomach", "thyroid",
        "endothelium", "bone marrow",
    ),
    "metabolic": ("liver", "pancreas", "adipose tissue", "skeletal muscle", "kidney", "blood", "intestine", "brain", "heart"),
    "neurodegenerative": ("brain", "cerebral cortex", "hippocampus", "spinal cord", "blood", "liver", "intestine"),
    "autoimmune": ("blood", "lymph node", "bone marrow", "thymus", "spleen", "skin", "joint", "kidney", "intestine", "liver"),
    "cardiovascular": ("heart", "blood", "endothelium", "kidney", "liver", "lung", "brain"),
    "genetic": ("blood", "liver", "lung", "brain", "kidney", "bone marrow", "skeletal muscle", "pancreas", "intestine", "skin"),
    "other": ("blood", "liver", "lung", "kidney", "brain", "lymph node", "bone marrow", "spleen"),
}
COARSER = {
    "cerebral cortex": "brain", "hippocampus": "brain", "substantia nigra": "brain", "striatum": "brain", "choroid plexus": "brain",
    "spinal cord": "brain", "dorsal root ganglia": "brain", "lymphoid tissue": "lymph node", "tonsil": "lymph node", "gut": "intestine",
    "colon": "intestine", "thyroid gland": "thyroid", "adrenal gland": "adrenal", "parathyroid gland": "parathyroid",
    "minor salivary gland": "salivary gland", "sweat gland": "skin", "synovium": "joint", "smooth muscle": "skeletal muscle",
    "peritoneum": "intestine", "pleura": "lung", "endothelium": "blood", "trachea": "lung", "bone": "skeletal",
}


def _lookup(table: dict) -> Column:
    """A dictionary as a map literal; its values are texts or lists of texts."""
    value = lambda v: F.lit(v) if isinstance(v, str) else F.array(*map(F.lit, v))
    return F.create_map(*(x for k, v in table.items() for x in (F.lit(k), value(v))))


def tissue_name(x) -> Column:
    """The organ that a tissue counts as; an unknown name is itself in lower case."""
    key = match_key(x)
    return F.coalesce(F.try_element_at(_lookup(COARSER), key), key)


def disease_tissues(diseases: DataFrame, name: str = "disease") -> DataFrame:
    """Each different disease name with disease_class, basis (listed, similar, class) and its tissues.

    An exact name counts first, then the first listed one that contains the name or is contained, then the name's class. A null
    or blank name is contained in any, so it takes the first. The lists are literals of the plan: nothing is joined.
    """
    rows, key = diseases.select(name).distinct(), F.coalesce(match_key(name), F.lit(""))
    near = F.filter(F.array(*map(F.lit, DISEASE_TISSUES)), lambda p: key.contains(p) | p.contains(key))
    listed, classes = _lookup(DISEASE_TISSUES), _lookup(CLASS_TISSUES)
    rows = rows.withColumns({"_exact": F.try_element_at(listed, key), "_near": F.get(near, F.lit(0)), "disease_class": disease_class(F.coalesce(F.col(name), F.lit("")))})
    basis = F.when(F.col("_exact").isNotNull(), "listed").when(F.col("_near").isNotNull(), "similar").otherwise("class")
    broad = F.coalesce(F.try_element_at(classes, F.col("disease_class")), F.element_at(classes, F.lit("other")))
    tissues = F.coalesce("_exact", F.try_element_at(listed, F.col("_near")), broad)
    return rows.select(name, "disease_class", basis.alias("basis"), tissues.alias("tissues"))


def annotated_targets(targets: DataFrame, expression: DataFrame) -> DataFrame:
    """targets (gene, disease and others) with tissue_relevant, tissue_coverage and tissue_explanation.

    expression: (gene, tissue). Genes meet by upper-case symbol. A gene without tissues passes, as nothing speaks against it; coverage is
    the share of its organs that the disease has, and never counts in a score. Tissues of a gene are combined before they are
    joined, so a target is one row all the way.
    """
    symbol = lambda c: F.upper(F.trim(c))
    seen = expression.where(F.trim("tissue") != "").groupBy(symbol("gene").alias("_k")).agg(F.array_sort(F.collect_set(tissue_name("tissue"))).alias("_g"))
    wanted = disease_tissues(targets).select(F.col("disease").alias("_name"), F.array_sort(F.array_distinct(F.transform("tissues", tissue_name))).alias("_d"))
    rows = targets.withColumn("_k", symbol("gene")).join(seen, "_k", "left")
    rows = rows.join(wanted, F.col("disease").eqNullSafe(F.col("_name")), "left")
    shared, unknown = F.array_intersect("_g", "_d"), F.col("_g").isNull()
    n, of = F.size(shared), F.size("_g")
    share = F.when(unknown, 0.0).otherwise(n / of)
    expressed = F.concat(F.col("gene"), F.lit(" expressed in "), F.array_join("_g", ", "))
    passed = F.concat(expressed, F.lit("; "), n.cast("string"), F.lit("/"), of.cast("string"), F.lit(" overlap with "), "disease", F.lit("-relevant tissues ("), F.array_join(shared, ", "), F.lit("). Gate: PASS (coverage "), F.bround(share * 100, 0).cast("int").cast("string"), F.lit("%)."))
    failed = F.concat(expressed, F.lit(", none overlap with "), "disease", F.lit("-relevant tissues ("), F.array_join("_d", ", "), F.lit("). Gate: FAIL — demote to CORRELATIONAL."))
    told = F.when(unknown, F.concat(F.lit("Tissue expression unknown for "), "gene", F.lit("; gate: PASS (unknown = pass, no data to reject)."))).when(n > 0, passed).otherwise(failed)
    return rows.select(*targets.columns, (unknown | (n > 0)).alias("tissue_relevant"), share.alias("tissue_coverage"), told.alias("tissue_explanation"))
