"""Scalar properties of protein sequences, and fixed-width structure records."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

# Residue masses, water, pKa values and the hydropathy scale.
MASS = {"G": 57.0519, "A": 71.0788, "V": 99.1326, "L": 113.1594, "I": 113.1594, "P": 97.1167, "F": 147.1766, "W": 186.2132, "M": 131.1926, "S": 87.0782, "T": 101.1051, "C": 103.1388, "Y": 163.1760, "H": 137.1411, "D": 115.0886, "E": 129.1155, "N": 114.1038, "Q": 128.1307, "K": 128.1741, "R": 156.1875}
WATER = 18.01524
ACID = {"D": 3.65, "E": 4.25, "C": 8.18, "Y": 10.07}
BASE = {"H": 6.00, "K": 10.53, "R": 12.48}
N_TERM, C_TERM = 9.69, 2.34
HYDROPATHY = {"I": 4.5, "V": 4.2, "L": 3.8, "F": 2.8, "C": 2.5, "M": 1.9, "A": 1.8, "G": -0.4, "T": -0.7, "S": -0.8, "W": -0.9, "Y": -1.3, "P": -1.6, "H": -3.2, "E": -3.5, "Q": -3.5, "D": -3.5, "N": -3.5, "K": -3.9, "R": -4.5}


def _count(sequence: Column, letters: str) -> Column:
    return F.length(sequence) - F.length(F.translate(sequence, letters, ""))


def is_sequence(x) -> Column:
    return col(x).rlike("^[ACDEFGHIKLMNPQRSTVWY]+$")


def mirrored(x) -> Column:
    return F.reverse(col(x))


def molecular_weight(x) -> Column:
    """By the number of each residue, so the cost doesn't depend on a fold over the sequence."""
    s, out = F.upper(col(x)), F.lit(WATER)
    for letter, mass in MASS.items():
        out = out + _count(s, letter) * mass
    return F.round(out, 2)


def _charge(counts: dict[str, Column], ph: Column) -> Column:
    out = 1 / (1 + F.pow(F.lit(10.0), ph - N_TERM)) - 1 / (1 + F.pow(F.lit(10.0), C_TERM - ph))
    for letter, pka in BASE.items():
        out = out + counts[letter] / (1 + F.pow(F.lit(10.0), ph - pka))
    for letter, pka in ACID.items():
        out = out - counts[letter] / (1 + F.pow(F.lit(10.0), pka - ph))
    return out


def net_charge(x, ph: float = 7.4) -> Column:
    s = F.upper(col(x))
    return F.round(_charge({k: _count(s, k) for k in (*BASE, *ACID)}, F.lit(ph)), 3)


def isoelectric_point(x, tolerance: float = 0.01, steps: int = 40) -> Column:
    """Bisection of pH 0 to 14, an array of sequences at a time; 40 halvings reach the resolution of a double."""
    s = F.upper(col(x))

    @F.pandas_udf("double")
    def bisected(counts: pd.DataFrame) -> pd.Series:
        n = {k: counts[k].to_numpy(dtype=float) for k in (*BASE, *ACID)}
        known = ~np.isnan(n["H"])
        low, high, left = np.zeros(len(counts)), np.full(len(counts), 14.0), np.flatnonzero(known)
        for _ in range(steps):
            if not len(left):
                break
            mid = (low[left] + high[left]) / 2
            q = 1 / (1 + 10.0 ** (mid - N_TERM)) - 1 / (1 + 10.0 ** (C_TERM - mid))
            for k, pka in BASE.items():
                q = q + n[k][left] / (1 + 10.0 ** (mid - pka))
            for k, pka in ACID.items():
                q = q - n[k][left] / (1 + 10.0 ** (pka - mid))
            # Charges count as rounded to three places, as net_charge() gives them.
            q = np.sign(q) * np.floor(np.abs(q) * 1_000 + 0.5) / 1_000
            go = np.abs(q) >= tolerance
            left, mid, up = left[go], mid[go], q[go] > 0
            low[left[up]], high[left[~up]] = mid[up], mid[~up]
        return pd.Series(np.where(known, (low + high) / 2, np.nan))

    held = bisected(F.struct(*(_count(s, k).alias(k) for k in (*BASE, *ACID))))
    return F.round(F.when(s.isNotNull(), held), 2)


def hydrophobic_fraction(x) -> Column:
    s = F.upper(col(x))
    letters = "".join(k for k, v in HYDROPATHY.items() if v > 0)
    return F.when(F.length(s) > 0, F.round(_count(s, letters) / F.length(s), 4)).otherwise(F.lit(0.0))


def atom_records(x) -> Column:
    """Atoms of structure text as an array of structs, by column positions; bad numbers are null."""
    lines = F.filter(F.split(col(x), "\n"), lambda r: F.substring(r, 1, 6).isin("ATOM  ", "HETATM"))
    piece = lambda r, a, n: F.trim(F.substring(r, a, n))
    return F.transform(
        lines,
        lambda r: F.struct(
            piece(r, 1, 6).alias("record"), piece(r, 13, 4).alias("atom"), piece(r, 18, 3).alias("residue"), piece(r, 22, 1).alias("chain"),
            piece(r, 23, 4).try_cast("int").alias("seq"), piece(r, 31, 8).try_cast("double").alias("x"), piece(r, 39, 8).try_cast("double").alias("y"),
            piece(r, 47, 8).try_cast("double").alias("z"), piece(r, 61, 6).try_cast("double").alias("b"),
        ),
    )
