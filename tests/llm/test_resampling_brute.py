"""Operator 2 against counts of n-grams as strings: models, weights and the top k."""

import math
import random
import re
from collections import Counter

import pytest

from causalake.llm import resampling


def grams(text):
    words = re.findall(r"\w+|[^\w\s]+", (text or "").lower())
    return words + list(zip(words, words[1:]))


def test_against_brute_force(spark):
    r = random.Random(3)
    texts = [None, "", "Ab, ab!", "a\nb  c"] + [" ".join(r.choice(["ab", "cd", "Ef", "gh,", "12"]) for _ in range(r.randint(1, 30))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)]
    known = [(i, int(i % 2 == 0), 0) for i in range(0, 40)] + [(40, 1, 1), (41, None, 0), (42, 1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(known, "doc_id long, quality int, toxic int")
    good = {i for i, q, x in known if q == 1 and not x}
    raw = Counter(g for t in texts for g in grams(t))
    target = Counter(g for i, t in rows if i in good for g in grams(t))
    scale = target.total() / raw.total()
    ratio = {g: math.log((target[g] + resampling.PRIOR) / (n * scale + resampling.PRIOR)) for g, n in raw.items()}
    out = {x.doc_id: x for x in resampling.resampled(docs, labels).collect()}
    assert len(out) == len(texts)
    for i, t in rows:
        assert out[i].n_grams == len(grams(t))
        assert out[i].log_weight == pytest.approx(sum(ratio[g] for g in grams(t)), abs=2e-6)
    k = round(len(good) / sum(q is not None for _, q, _ in known) * len(texts))
    ordered = sorted(out.values(), key=lambda x: -x.gumbel_key)
    assert {x.doc_id for x in out.values() if x.kept} == {x.doc_id for x in ordered[:k]}
    noise = [x.gumbel_key - x.log_weight for x in out.values()]
    assert abs(sum(noise) / len(noise) - 0.5772) < 0.6  # the mean of Gumbel noise
