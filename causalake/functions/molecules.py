"""SMILES tokens, descriptor filters and fingerprint similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

# Token pattern (longest first), special tokens and padded length.
SMILES = r"(Br|Cl|@@|@|%\d{2}|.)"
SPECIAL = ("<PAD>", "<SOS>", "<EOS>", "<UNK>")
PAD, SOS, EOS, UNK = range(4)
LENGTH = 120


def smiles_tokens(x) -> Column:
    return F.regexp_extract_all(col(x), F.lit(SMILES), F.lit(1))


def encode(tokens, vocabulary, length: int = LENGTH) -> Column:
    """Ids with start and end, cut so that the end stays, padded. vocabulary: a map column token -> id."""
    ids = F.transform(col(tokens), lambda t: F.coalesce(F.try_element_at(col(vocabulary), t), F.lit(UNK)))
    ids = F.concat(F.array(F.lit(SOS)), F.slice(ids, 1, length - 2), F.array(F.lit(EOS)))
    return F.concat(ids, F.array_repeat(F.lit(PAD), F.lit(length) - F.size(ids)))


def decode(ids, names) -> Column:
    """Text up to the first end token, without special ones. names: a map column id -> token."""
    end = F.array_position(col(ids), F.lit(EOS)).cast("int")
    held = F.when(end > 0, F.slice(col(ids), F.lit(1), end - 1)).otherwise(col(ids))
    return F.array_join(F.transform(F.filter(held, lambda i: i > UNK), lambda i: F.try_element_at(col(names), i)), "")


def largest_fragment(x) -> Column:
    """The longest part between dots, without stereo marks: an approximation on the string alone."""
    parts = F.transform(F.split(col(x), r"\."), lambda p: F.struct(F.length(p).alias("n"), p.alias("p")))
    return F.regexp_replace(F.array_max(parts)["p"], r"[@/\\]", "")


def violations(**rules) -> Column:
    return F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in rules.items())))


def rule_filters(mw, logp, hbd, hba, rotatable, tpsa, refractivity, atoms) -> dict[str, Column]:
    """name -> array of broken rules for the four descriptor filters."""
    mw, logp, tpsa = col(mw), col(logp), col(tpsa)
    return {
        "lipinski": violations(mw=mw > 500, logp=logp > 5, hbd=col(hbd) > 5, hba=col(hba) > 10),
        "veber": violations(rotatable=col(rotatable) > 10, tpsa=tpsa > 140),
        "ghose": violations(mw=~mw.between(160, 480), logp=~logp.between(-0.4, 5.6), refractivity=~col(refractivity).between(40, 130), atoms=~col(atoms).between(20, 70)),
        "egan": violations(tpsa=tpsa > 131.6, logp=logp > 5.88),
    }


def filter_report(pains=None, brenk=None, **descriptors) -> Column:
    """All filters as an array of (name, passed, violations); alerts come as arrays of names."""
    broken = rule_filters(**descriptors)
    if pains is not None:
        broken["pains"] = col(pains)
    if brenk is not None:
        broken["brenk"] = col(brenk)
    allowed = {"lipinski": 1}
    return F.array(*(F.struct(F.lit(k).alias("name"), (F.size(v) <= allowed.get(k, 0)).alias("passed"), v.alias("violations")) for k, v in broken.items()))


def drug_like_range(mw, logp, hbd, hba) -> Column:
    return col(mw).between(150, 500) & col(logp).between(-1, 5) & (col(hbd) <= 5) & (col(hba) <= 10)


def tanimoto(a, b) -> Column:
    """Shared over all set bits of two fingerprints, arrays of 64-bit words; 0 where neither has any."""
    both = lambda f: F.aggregate(F.zip_with(col(a), col(b), f), F.lit(0), lambda s, x: s + F.bit_count(x))
    shared, every = both(lambda x, y: x.bitwiseAND(y)), both(lambda x, y: x.bitwiseOR(y))
    return F.when(every > 0, shared / every).otherwise(F.lit(0.0))


def sign_bits(vector, width: int = 64) -> Column:
    """One word whose bits are the signs of up to 64 numbers."""
    held = F.aggregate(F.sequence(F.lit(0), F.lit(width - 1)), F.lit(0).cast("long"), lambda s, i: F.when(F.get(col(vector), i) > 0, s.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))).otherwise(s))
    return F.array(held)
