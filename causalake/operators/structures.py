"""Protein structures: atoms, superposition, TM-score, regions, torsions, secondary structure, binding sites."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.proteins import atom_records
from .ranking import islands


def atoms(structures: DataFrame, key: str = "structure_id", text: str = "pdb") -> DataFrame:
    """A row for each atom record of each structure text, in order."""
    return structures.select(key, F.posexplode(atom_records(text)).alias("ord", "x")).select(key, "ord", "x.*")


def alpha_carbons(rows: DataFrame, key: str = "structure_id") -> DataFrame:
    """One alpha carbon for each residue number, the first; position from 1."""
    w = Window.partitionBy(key, "seq").orderBy("ord")
    ca = rows.where("record = 'ATOM' and atom = 'CA'").withColumn("_n", F.row_number().over(w)).where("_n = 1")
    return ca.select(key, "seq", "x", "y", "z", "b", F.row_number().over(Window.partitionBy(key).orderBy("seq")).alias("position"))


def mirrored(rows: DataFrame) -> DataFrame:
    """Coordinates reflected in x."""
    return rows.withColumn("x", -F.col("x"))


def mean_confidence(rows: DataFrame, key: str = "structure_id") -> DataFrame:
    return alpha_carbons(rows, key).groupBy(key).agg(F.round(F.avg("b"), 4).alias("mean_plddt"), F.count("*").alias("n_residues"))


def superposed(a: DataFrame, b: DataFrame, key: str = "structure_id") -> DataFrame:
    """key, position, distance, rmsd after the best rigid fit of b on a, residues paired by position.

    One structure pair to a group: an SVD of a 3x3 matrix over a few thousand residues.
    """
    pairs = a.select(key, "position", *(F.col(c).alias(f"{c}1") for c in "xyz")).join(b.select(key, "position", *(F.col(c).alias(f"{c}2") for c in "xyz")), [key, "position"])
    kind = dict(a.dtypes)[key]

    def fit(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("position")
        fixed, moving = p[["x1", "y1", "z1"]].to_numpy(float), p[["x2", "y2", "z2"]].to_numpy(float)
        f, m = fixed - fixed.mean(0), moving - moving.mean(0)
        u, _, vt = np.linalg.svd(m.T @ f)
        flip = np.ones(3)
        flip[-1] = np.sign(np.linalg.det(u @ vt)) or 1.0  # a proper rotation: a mirror image doesn't fit
        away = np.linalg.norm(m @ (u * flip @ vt) - f, axis=1)
        return pd.DataFrame({key: p[key], "position": p["position"].astype("int32"), "distance": away, "rmsd": float(np.sqrt((away**2).mean()))})

    return pairs.groupBy(key).applyInPandas(fit, f"{key} {kind}, position int, distance double, rmsd double")


def tm_score(distances: DataFrame, key: str = "structure_id") -> DataFrame:
    """rmsd and TM-score of each pair, by its length-dependent scale (0.5 at least)."""
    n = F.count("*").over(Window.partitionBy(key))
    scale = F.greatest(F.lit(0.5), F.when(n > 15, 1.24 * F.pow((n - 15).cast("double"), 1 / 3) - 1.8).otherwise(F.lit(0.5)))
    rows = distances.withColumn("_s", 1 / (1 + F.pow(F.col("distance") / scale, 2)))
    return rows.groupBy(key).agg(F.round(F.first("rmsd"), 4).alias("rmsd"), F.round(F.least(F.lit(1.0), F.avg("_s")), 4).alias("tm_score"), F.count("*").alias("n_residues"))


def regions(distances: DataFrame, key: str = "structure_id", threshold: float = 2.0) -> DataFrame:
    """Runs of residues nearer than the threshold (conserved) or not."""
    return islands(distances.withColumn("conserved", F.col("distance") < threshold), [key], "position", "conserved")


def _dihedral(p: list):
    sub = lambda a, b: [a[i] - b[i] for i in range(3)]
    cross = lambda a, b: [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    dot = lambda a, b: a[0] * b[0] + a[1] * b[1] + a[2] * b[2]
    b0, b1, b2 = sub(p[1], p[0]), sub(p[2], p[1]), sub(p[3], p[2])
    n1, n2 = cross(b0, b1), cross(b1, b2)
    return F.degrees(F.atan2(dot(cross(n1, n2), b1) / F.sqrt(dot(b1, b1)), dot(n1, n2)))


def torsions(rows: DataFrame, key: str = "structure_id") -> DataFrame:
    """key, seq, phi, psi, label (H, E or C) by neighbours in residue order: windows and arithmetic only."""
    point = lambda n: F.max(F.when(F.col("atom") == n, F.struct("x", "y", "z"))).alias(n)
    r = rows.where("record = 'ATOM' and atom in ('N', 'CA', 'C')").groupBy(key, "seq").agg(point("N"), point("CA"), point("C"))
    w = Window.partitionBy(key).orderBy("seq")
    r = r.withColumn("_before", F.lag("C").over(w)).withColumn("_after", F.lead("N").over(w))
    xyz = lambda c: [F.col(c)[k] for k in "xyz"]
    r = r.select(key, "seq", _dihedral([xyz("_before"), xyz("N"), xyz("CA"), xyz("C")]).alias("phi"), _dihedral([xyz("N"), xyz("CA"), xyz("C"), xyz("_after")]).alias("psi"))
    f, s = F.abs("phi"), F.abs("psi")
    label = F.when(f.between(20, 160) & (s <= 80), "H").when(f.between(40, 180) & s.between(50, 180), "E").otherwise("C")
    return r.withColumn("label", label)


def surface_buried(rows: DataFrame, key: str = "structure_id", confident: float = 70.0) -> DataFrame:
    """n_surface, n_buried: buried alpha carbons lie nearer the centre than the median and are confident."""
    ca = rows.where("record = 'ATOM' and atom = 'CA'")
    every = Window.partitionBy(key)
    centre = F.sqrt(sum(F.pow(F.col(c) - F.avg(c).over(every), 2) for c in "xyz"))
    ca = ca.withColumn("_d", centre).withColumn("_m", F.median("_d").over(every))
    deep = (F.col("_d") < F.col("_m")) & (F.col("b") >= confident)
    return ca.groupBy(key).agg(F.count_if(~deep).alias("n_surface"), F.count_if(deep).alias("n_buried"))


def bounding_box(rows: DataFrame, key: str = "structure_id", padding: float = 5.0) -> DataFrame:
    """Centre and padded size of a ligand's atoms: the docking box."""
    out = [x for c in "xyz" for x in (F.round(F.avg(c), 4).alias(f"center_{c}"), F.round(F.max(c) - F.min(c) + 2 * padding, 4).alias(f"size_{c}"))]
    return rows.groupBy(key).agg(*out)


def residues_near(protein: DataFrame, boxes: DataFrame, key: str = "structure_id", reach: float = 5.0) -> DataFrame:
    """key, chain, seq of residues with an atom within reach of a box's faces."""
    p = protein.join(boxes, key)
    inside = F.lit(True)
    for c in "xyz":
        inside = inside & (F.abs(F.col(c) - F.col(f"center_{c}")) <= F.col(f"size_{c}") / 2 + reach)
    return p.where(inside).select(key, "chain", "seq").distinct()
