"""Mirror-image proteins: residues as SMILES, kept pockets, viability, and the two forms' properties side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import proteins as FP
from ..functions.scores import stability
from ..functions.text import col

# Natural amino acids as SMILES. A mirror image swaps @@ and @ at every centre.
RESIDUES = {
    "G": "NCC(=O)O", "A": "N[C@@H](C)C(=O)O", "V": "N[C@@H](C(C)C)C(=O)O", "L": "N[C@@H](CC(C)C)C(=O)O", "I": "N[C@@H]([C@@H](C)CC)C(=O)O",
    "P": "OC(=O)[C@@H]1CCCN1", "F": "N[C@@H](Cc1ccccc1)C(=O)O", "W": "N[C@@H](Cc1c[nH]c2ccccc12)C(=O)O", "M": "N[C@@H](CCSC)C(=O)O",
    "S": "N[C@@H](CO)C(=O)O", "T": "N[C@@H]([C@@H](O)C)C(=O)O", "C": "N[C@@H](CS)C(=O)O", "Y": "N[C@@H](Cc1ccc(O)cc1)C(=O)O",
    "N": "N[C@@H](CC(=O)N)C(=O)O", "Q": "N[C@@H](CCC(=O)N)C(=O)O", "D": "N[C@@H](CC(=O)O)C(=O)O", "E": "N[C@@H](CCC(=O)O)C(=O)O",
    "K": "N[C@@H](CCCCN)C(=O)O", "R": "N[C@@H](CCCNC(=N)N)C(=O)O", "H": "N[C@@H](Cc1c[nH]cn1)C(=O)O",
}
#: The largest chain that synthesis of mirror images reaches.
FEASIBLE = 200


def residue_smiles(x, mirror: bool = False) -> Column:
    """SMILES of a one-letter residue in either case; null for other letters."""
    table = F.create_map(*(F.lit(t) for k, v in RESIDUES.items() for t in (k, v.replace("@@", "@") if mirror else v)))
    return F.try_element_at(table, F.upper(col(x)))


def is_mirror_pair(a, b) -> Column:
    """Two SMILES that are equal but for every centre, of which each is the other's inverse, or both without one."""
    swapped = F.replace(F.replace(F.replace(col(a), F.lit("@@"), F.lit("\0")), F.lit("@"), F.lit("@@")), F.lit("\0"), F.lit("@"))
    return F.coalesce(swapped == col(b), F.lit(False))


def residues(rows: DataFrame, key: str = "id", sequence: str = "sequence", mirror: bool = False) -> DataFrame:
    """key, position (from 1), residue, chirality, smiles ('' if unknown) and valid, for each letter. An empty or null sequence has none."""
    letters = F.filter(F.split(F.upper(sequence), ""), lambda x: x != "")
    r = rows.select(key, F.posexplode(letters).alias("p", "residue"))
    s = residue_smiles("residue", mirror)
    return r.select(key, (F.col("p") + 1).alias("position"), "residue", F.lit("D" if mirror else "L").alias("chirality"), F.coalesce(s, F.lit("")).alias("smiles"), s.isNotNull().alias("valid"))


def residue_forms(rows: DataFrame, sequence: str = "sequence") -> DataFrame:
    """residue, n, smiles, mirrored: how often each letter stands in the sequences, and its two forms ('' if unknown).

    A form depends on the letter alone, so letters are counted first and never joined by position.
    """
    letters = rows.select(F.explode(F.split(F.upper(sequence), "")).alias("residue")).where("residue <> ''")
    form = lambda mirror: F.coalesce(residue_smiles("residue", mirror), F.lit(""))
    return letters.groupBy("residue").agg(F.count("*").alias("n")).select("residue", "n", form(False).alias("smiles"), form(True).alias("mirrored"))


def protease_resistance(chirality) -> Column:
    return F.when(col(chirality) == "D", "Very High").otherwise("Normal (susceptible to natural proteases)")


def immunogenicity(chirality) -> Column:
    return F.when(col(chirality) == "D", "Very Low (MHC cannot present D-peptides)").otherwise("Normal (subject to standard immune surveillance)")


def viability(tm_score, pocket_conserved, n_residues) -> Column:
    tm, pocket = F.coalesce(col(tm_score), F.lit(0.0)), F.coalesce(col(pocket_conserved), F.lit(False))
    return (
        F.when((tm > 0.7) & pocket & (col(n_residues) <= FEASIBLE), "Excellent")
        .when((tm > 0.7) & pocket, "Good (but synthesis challenging for this size)")
        .when((tm > 0.5) & pocket, "Good")
        .when(tm > 0.5, "Moderate")
        .otherwise("Poor")
    )


def synthesis(n_residues) -> Column:
    n = col(n_residues)
    return F.when(n <= 50, "Feasible").when(n <= FEASIBLE, "Feasible with ligation").otherwise("Challenging")


def kept_pockets(scores: DataFrame, distances: DataFrame, pockets: DataFrame | None = None, key: str = "structure_id", near: float = 2.0) -> DataFrame:
    """key, tm_score, pocket_conserved: the pocket's mean distance is below `near`, or without pocket residues, tm_score is above 0.5.

    scores: key, tm_score; distances: key, position, distance; pockets: key, position. A pair without a score has no kept pocket; a pocket
    none of whose residues is paired counts as none.
    """
    rows = scores.select(key, "tm_score")
    if pockets is None:
        rows = rows.withColumn("_m", F.lit(None).cast("double"))
    else:
        mean = distances.join(pockets.select(key, "position"), [key, "position"]).groupBy(key).agg(F.avg("distance").alias("_m"))
        rows = rows.join(mean, key, "left")
    kept = F.when(F.col("tm_score").isNull(), False).when(F.col("_m").isNotNull(), F.col("_m") < near).otherwise(F.col("tm_score") > 0.5)
    return rows.select(key, "tm_score", kept.alias("pocket_conserved"))


def same_secondary(a: DataFrame, b: DataFrame, key: str = "structure_id") -> DataFrame:
    """key, match: the share of places, up to the shorter form's end, with the same label. Both: key, position, label."""
    pairs = a.select(key, "position", F.col("label").alias("_a")).join(b.select(key, "position", F.col("label").alias("_b")), [key, "position"])
    return pairs.groupBy(key).agg(F.round(F.avg((F.col("_a") == F.col("_b")).cast("int")), 6).alias("match"))


def profiles(rows: DataFrame, sequence: str = "sequence", plddt: str = "mean_plddt", ph: float = 7.4) -> DataFrame:
    """rows with stability and the properties of the sequence alone, which both mirror forms share."""
    return rows.withColumns({
        "stability": stability(F.coalesce(F.col(plddt), F.lit(0.0))), "net_charge": FP.net_charge(sequence, ph), "isoelectric_point": FP.isoelectric_point(sequence),
        "molecular_weight": FP.molecular_weight(sequence), "hydrophobic_fraction": FP.hydrophobic_fraction(sequence),
    })


def assessments(scores: DataFrame, forms: DataFrame, key: str = "structure_id") -> DataFrame:
    """What kept_pockets tells, with viability, synthesis, resistance, immunogenicity and whether both forms are predicted alike.

    forms: key, n_residues, plddt_l, plddt_d. A difference of 5 points or more of mean confidence calls for caution.
    """
    rows = scores.join(forms, key)
    tm = F.coalesce(F.col("tm_score"), F.lit(0.0))
    fold = F.when(tm > 0.7, "Strong").when(tm > 0.5, "Moderate").otherwise("Weak")
    delta = F.round(F.abs(F.col("plddt_l") - F.col("plddt_d")), 1)
    return rows.select(
        key, "tm_score", "pocket_conserved", "n_residues", fold.alias("fold"), delta.alias("plddt_delta"), (F.abs(F.col("plddt_l") - F.col("plddt_d")) < 5).alias("similar_confidence"),
        synthesis("n_residues").alias("synthesis"), protease_resistance(F.lit("D")).alias("protease_resistance"), immunogenicity(F.lit("D")).alias("immunogenicity"),
        viability("tm_score", "pocket_conserved", "n_residues").alias("viability"),
    )
