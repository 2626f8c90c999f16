"""Scores and labels of targets and candidates, as column expressions."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

# Weights, thresholds and keyword lists of the scores.
CANDIDATE_WEIGHTS = {"causal_confidence": 0.30, "binding_affinity": 0.25, "qed": 0.15, "sa": 0.10, "admet": 0.10, "novelty": 0.10}
DOCKING_WEIGHTS = {"affinity": 0.40, "qed": 0.25, "sa": 0.15, "filters": 0.20}
DRUGGABLE_WORDS = ("receptor", "kinase", "protease", "enzyme", "channel", "transporter", "gpcr", "nuclear receptor")
PHASES = {4: 1.0, 3: 0.8, 2: 0.6, 1: 0.4}
ORGANISMS = {
    "malaria": ("plasmodium", "falciparum", "vivax", "malariae", "ovale", "knowlesi"),
    "hiv": ("immunodeficiency", "hiv"),
    "ebola": ("ebola", "ebolavirus"),
    "tuberculosis": ("tuberculosis", "mycobacterium"),
    "hepatitis": ("hepatitis",),
    "covid": ("sars", "coronavirus"),
    "influenza": ("influenza",),
    "dengue": ("dengue",),
    "zika": ("zika",),
    "cholera": ("vibrio", "cholera"),
    "typhoid": ("salmonella", "typhi"),
    "leprosy": ("leprae", "leprosy"),
    "chagas": ("trypanosoma", "cruzi"),
    "sleeping sickness": ("trypanosoma", "brucei"),
    "leishmaniasis": ("leishmania",),
}


def clamp(x, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(col(x), F.lit(low)), F.lit(high))


def affinity_score(x) -> Column:
    """0 at no binding to 1 at -12 kcal/mol, straight between."""
    return clamp(col(x) / -12.0)


def affinity_sigmoid(x, midpoint: float = -7.0, steepness: float = 1.0) -> Column:
    return 1 / (1 + F.exp((col(x) - midpoint) * steepness))


def ease_score(x) -> Column:
    """Synthetic accessibility from 1 (easy, 1.0) to 10 (hard, 0.0)."""
    return clamp((10 - col(x)) / 9.0)


def candidate_weights(overrides: dict | None = None, variable: str = "CAUSALAKE_WEIGHTS") -> dict[str, float]:
    """Defaults, then JSON in the environment, then the call; brought to a sum of 1 if off by over 0.01."""
    out = dict(CANDIDATE_WEIGHTS)
    try:
        out |= json.loads(os.environ.get(variable, "{}"))
    except (ValueError, TypeError):
        pass
    out |= overrides or {}
    total = sum(out.values())
    return {k: v / total for k, v in out.items()} if total > 0 and abs(total - 1) > 0.01 else out


def candidate_parts(confidence, affinity, qed, sa, admet, novelty) -> dict[str, Column]:
    """Each part of the composite, normalised; missing binding, QED and SA are neutral."""
    neutral = F.lit(0.5)
    return {
        "causal_confidence": clamp(confidence),
        "binding_affinity": F.coalesce(affinity_score(affinity), neutral),
        "qed": F.coalesce(clamp(qed), neutral),
        "sa": F.coalesce(ease_score(sa), neutral),
        "admet": clamp(admet),
        "novelty": clamp(novelty),
    }


def weighted(parts: dict[str, Column], weights: dict[str, float]) -> Column:
    out = F.lit(0.0)
    for k, v in parts.items():
        out = out + F.lit(weights[k]) * v
    return out


def breakdown(parts: dict[str, Column], weights: dict[str, float]) -> Column:
    return F.create_map(*(x for k, v in parts.items() for x in (F.lit(k), F.round(F.lit(weights[k]) * v, 4))))


def docking_composite(affinity, qed, sa, filters, weights: dict | None = None) -> Column:
    """Of a docked ligand: no pose counts as affinity 0, and missing QED, SA and filters as 0, 5 and 0."""
    parts = {
        "affinity": affinity_sigmoid(F.coalesce(col(affinity), F.lit(0.0))),
        "qed": F.coalesce(col(qed), F.lit(0.0)),
        "sa": ease_score(F.coalesce(col(sa), F.lit(5.0))),
        "filters": F.coalesce(col(filters), F.lit(0.0)),
    }
    return F.round(weighted(parts, weights or DOCKING_WEIGHTS), 4)


def druggability(has_structure, has_accession, tractable, is_druggable, description) -> Column:
    words = F.lower(F.coalesce(col(description), F.lit(""))).rlike("|".join(DRUGGABLE_WORDS))
    yes = lambda c, v: F.when(F.coalesce(col(c), F.lit(False)), F.lit(v)).otherwise(F.lit(0.0))
    return F.least(F.lit(1.0), F.lit(0.3) + yes(has_structure, 0.2) + yes(has_accession, 0.1) + yes(tractable, 0.15) + yes(is_druggable, 0.15) + yes(words, 0.15))


def specificity(n_diseases) -> Column:
    """1/log2(n+2); neutral where nothing is known."""
    n = col(n_diseases)
    return F.when(n > 0, 1 / F.log2(n + F.lit(2.0))).otherwise(F.lit(0.5))


def consensus(n_sources, n_active, mean_score) -> Column:
    share = col(n_sources) / F.greatest(col(n_active), F.lit(1))
    return F.least(F.lit(1.0), share * F.coalesce(col(mean_score), F.lit(0.0)))


def causal_confidence(effect, robustness, identifiable, consensus_, specificity_, druggability_) -> Column:
    total = (
        0.30 * F.least(F.lit(1.0), col(effect))
        + 0.25 * col(robustness)
        + 0.15 * F.when(col(identifiable), 1.0).otherwise(0.0)
        + 0.10 * col(consensus_)
        + 0.10 * F.least(F.lit(1.0), col(specificity_))
        + 0.10 * col(druggability_)
    )
    return F.round(clamp(total), 4)


def classification(confidence, robustness, identifiable, streams, target_type, tissue_ok) -> Column:
    """causal, correlational or inconclusive; symptom markers and wrong tissues are never causal."""
    c, r, n = col(confidence), col(robustness), col(streams)
    return (
        F.when(col(target_type) == "host_symptom", "correlational")
        .when(~col(tissue_ok), "correlational")
        .when((c >= 0.6) & (r >= 0.4) & col(identifiable) & ((n >= 2) | (n == 0)), "causal")
        .when((c < 0.4) | (r < 0.3), "correlational")
        .otherwise("inconclusive")
    )


def reasoning(name, label, confidence, robustness, streams) -> Column:
    """One sentence on the label."""
    return F.concat_ws("", name, F.lit(" is "), label, F.lit(" (confidence "), F.format_number(col(confidence), 2), F.lit(", robustness "), F.format_number(col(robustness), 2), F.lit(", "), col(streams).cast("string"), F.lit(" evidence streams)"))


def organism_relevance(organism, disease) -> Column:
    """1 for the disease's own pathogen, 0.3 for another, 0 for diseases without one or missing names."""
    org, dis, out = F.lower(col(organism)), F.lower(col(disease)), None
    empty = F.coalesce(col(organism), F.lit("")).eqNullSafe("") | F.coalesce(col(disease), F.lit("")).eqNullSafe("")
    out = F.when(empty, 0.0)
    for key, words in ORGANISMS.items():
        out = out.when(dis.contains(key), F.when(org.rlike("|".join(words)), 1.0).otherwise(0.3))
    return out.otherwise(0.0)


def drug_evidence(max_phase, n_drugs, n_mechanisms) -> Column:
    phase = F.lit(None).cast("double")
    for k, v in PHASES.items():
        phase = F.when(col(max_phase) == k, v).otherwise(phase)
    drugs = F.least(F.lit(1.0), F.log2(col(n_drugs) + F.lit(1.0)) / F.log2(F.lit(11.0)))
    ways = F.least(F.lit(1.0), col(n_mechanisms) / 4.0)
    return F.round(clamp(0.60 * F.coalesce(phase, F.lit(0.1)) + 0.20 * drugs + 0.20 * ways), 4)


def pathogen_scores(drug_score, phase, n_drugs, relevance, has_structure) -> dict[str, Column]:
    """confidence, robustness, druggability, streams and label of a drug target in a pathogen. Never identifiable."""
    phase, near = F.coalesce(col(phase), F.lit(0)), col(relevance)
    drug = F.when(phase >= 3, 1.0).otherwise(0.8)
    confidence = F.round(clamp(0.40 * F.coalesce(col(drug_score), F.lit(0.5)) + 0.25 * drug + 0.10 * near + F.lit(0.10 * 0.9)), 4)
    base = F.when(phase >= 4, 0.9).when(phase >= 3, 0.7).when(phase >= 2, 0.5).when(phase >= 1, 0.3).otherwise(0.0)
    base = F.when(F.coalesce(col(n_drugs), F.lit(0)) >= 3, F.least(F.lit(1.0), base + 0.1)).otherwise(base)
    robust = base * F.when(near < 0.5, 0.3).otherwise(1.0)
    label = F.when((confidence >= 0.6) & (robust >= 0.4), "causal").when(confidence >= 0.4, "inconclusive").otherwise("correlational")
    streams = F.lit(1) + F.coalesce(col(has_structure), F.lit(False)).cast("int")
    return {"confidence": confidence, "robustness": robust, "druggability": drug, "streams": streams, "label": label}


def literature_score(hits) -> Column:
    n = col(hits)
    return F.when(n <= 0, 0.0).when(n < 3, 0.3).when(n < 10, 0.6).when(n < 50, 0.8).otherwise(1.0)


def quick_admet(mw, logp, qed) -> Column:
    """From weight, logP and QED alone; what is missing doesn't count."""
    w, p, q = col(mw), col(logp), col(qed)
    by = F.when(w.between(150, 500), 0.2).when(w > 500, -0.1).otherwise(0.0)
    by = by + F.when(p.between(-0.4, 5.6), 0.2).when(p.isNotNull(), -0.1).otherwise(0.0)
    return clamp(F.lit(0.5) + by + F.when(q > 0.5, 0.1).otherwise(0.0))


def admet_profile(mw, logp, hbd, hba, tpsa, rotatable, aromatic, atoms, basic_nitrogen, pains, reactive) -> dict[str, Column]:
    """Five sub-scores, composite and flags by descriptor rules; substructure alerts come as boolean columns."""
    mw, logp, tpsa, rot, rings = col(mw), col(logp), col(tpsa), col(rotatable), col(aromatic)
    broken = (mw > 500).cast("int") + (logp > 5).cast("int") + (col(hbd) > 5).cast("int") + (col(hba) > 10).cast("int")
    has = lambda c: F.coalesce(col(c), F.lit(False))
    cost = lambda c, v: F.when(c, v).otherwise(0.0)
    absorption = F.when(broken == 0, 1.0).when(broken == 1, 0.7).otherwise(F.greatest(F.lit(0.1), 1 - broken * 0.25)) - cost(rot > 10, 0.15) - cost(tpsa > 140, 0.2)
    brain = (tpsa <= 90) & (mw <= 400) & logp.between(1, 3)
    egan = (tpsa <= 131.6) & (logp <= 5.88)
    distribution = F.when(brain, 0.9).otherwise(0.7) + F.when(egan, 0.1).otherwise(-0.1) - cost(logp > 4, 0.1)
    metabolism = F.lit(0.7) - F.when((rings >= 3) & (mw > 400), 0.2).when(rings >= 4, 0.15).otherwise(0.0) + F.when(mw.between(200, 450), 0.1).when(mw > 600, -0.15).otherwise(0.0)
    excretion = F.when((mw < 300) & (logp < 2), 0.85).when(mw > 500, 0.55).otherwise(0.7) + cost(logp.between(1, 3), 0.1)
    toxicity = F.lit(0.8) - cost(has(basic_nitrogen) & (logp > 3.5), 0.25) - cost(has(pains), 0.3) - cost(has(reactive), 0.2)
    ghose = mw.between(160, 480) & logp.between(-0.4, 5.6) & col(atoms).between(20, 70)
    parts = {"absorption": clamp(absorption), "distribution": clamp(distribution), "metabolism": clamp(metabolism), "excretion": clamp(excretion), "toxicity": clamp(toxicity)}
    weights = {"absorption": 0.25, "distribution": 0.20, "metabolism": 0.20, "excretion": 0.15, "toxicity": 0.20}
    flags = F.array_compact(F.array(F.when(broken > 0, "lipinski"), F.when(rot > 10, "rotatable bonds"), F.when(tpsa > 140, "polar surface"), F.when(~egan, "egan"), F.when(logp > 4, "accumulation"), F.when(has(pains), "pains"), F.when(has(reactive), "reactive group"), F.when(~ghose, "ghose")))
    return {k: F.round(v, 3) for k, v in parts.items()} | {"composite": F.round(weighted(parts, weights), 3), "flags": flags}


def reward_affinity(x) -> Column:
    """The learner's normaliser: missing binding is worse than neutral."""
    return F.coalesce(affinity_score(x), F.lit(0.3))


def stability(plddt) -> Column:
    p = col(plddt)
    return F.when(p > 90, "very high").when(p > 70, "high").when(p > 50, "low").otherwise("very low")


def novelty(max_similarity) -> Column:
    """1 - the largest similarity to a known drug; 0.9 where there is none to compare."""
    return F.coalesce(1 - col(max_similarity), F.lit(0.9))


def passes_screen(valid, sa, qed, most_sa: float = 4.0, least_qed: float = 0.3) -> Column:
    """A valid molecule that is easy to make and drug-like enough; what is missing doesn't count against it."""
    return F.coalesce(col(valid), F.lit(False)) & F.coalesce(col(sa) <= most_sa, F.lit(True)) & F.coalesce(col(qed) >= least_qed, F.lit(True))


def screened_properties(mw, logp, qed, sa, n_filters) -> dict[str, Column]:
    """Properties of a found molecule. Where the filters weren't run (null) it counts as drug-like with three filters and SA 5."""
    ran = col(n_filters).isNotNull()
    n = F.coalesce(col(n_filters), F.lit(3))
    return {
        "molecular_weight": col(mw), "logp": col(logp), "qed": F.when(ran, F.coalesce(col(qed), F.lit(0.5))).otherwise(col(qed)),
        "sa_score": F.when(ran, F.coalesce(col(sa), F.lit(5.0))).otherwise(5.0), "n_filters_passed": n, "drug_class": F.when(n >= 3, "drug-like").otherwise("non-drug-like"),
    }


def report_cards(affinity, composite) -> list[Column]:
    """Aggregates of a docking report's head; zeros without a score."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return [zero(F.min(affinity)).alias("best_affinity"), zero(F.avg(affinity)).alias("mean_affinity"), zero(F.max(composite)).alias("best_composite")]


def objective_weights(base: dict[str, float], expected: dict, temperature: float = 1.0) -> dict[str, Column]:
    """Weights that sum to 1: base times (1 - expected score)^temperature, so that hard objectives count more."""
    raw = {k: F.lit(b) * (F.pow(1 - col(expected[k]), F.lit(temperature)) + 1e-6) for k, b in base.items()}
    total = sum(raw.values(), F.lit(0.0))
    return {k: v / total for k, v in raw.items()}


def unscaled(x, low, high) -> Column:
    """The inverse of scaling to 0..1."""
    return col(x) * (col(high) - col(low)) + col(low)
