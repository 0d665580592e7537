"""The near-dedup stage of the pipeline against brute-force Jaccard similarity."""

from __future__ import annotations

import numpy as np
import pytest

import corpus_pipeline
from tidelog.llm import near_copies


def word_sets(texts):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return sets


def kept_by_brute_force(rows):
    """Places of the rows (doc_id, text) that stay."""
    sets = word_sets(t for _, t in rows)
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                x, y = sorted((label[i], label[j]))
                label = [x if k == y else k for k in label]
    least = {}
    for (d, _), k in zip(rows, label, strict=True):
        if d is not None:
            least[k] = min(d, least.get(k, d))
    return {i for i, ((d, _), k) in enumerate(zip(rows, label, strict=True)) if d is None or d == least[k]}


def changed(rng, text, words):
    w = text.split()
    for i in rng.choice(len(w), words, replace=False):
        w[i] = f"new{rng.integers(1 << 40)}"
    return " ".join(w)


@pytest.mark.parametrize("small", [near_copies.SMALL, 3])
def test_stage_keeps_what_brute_force_keeps(spark, monkeypatch, small):
    monkeypatch.setattr(near_copies, "SMALL", small)
    monkeypatch.setattr(near_copies, "HOT", 4)
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(500)]
    texts = []
    for size in (8, 40, 120, 300):
        for _ in range(4):
            base = " ".join(rng.choice(vocabulary, size))
            texts += [base] + [changed(rng, base, k) for k in (1, 2, 3, 5, 7, 9) if k <= size // 6]
    base = " ".join(rng.choice(vocabulary, 150))
    texts += [changed(rng, base, 3) for _ in range(45)] + [base]
    texts += ["", None, " \n", "few words", "Few  words", "few words more", base.upper()]
    rows = [(int(i), t) for i, t in zip(rng.permutation(len(texts)), texts, strict=True)]
    rows += [(None, base), (3, "one of its own " + " ".join(rng.choice(vocabulary, 30)))]
    docs = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, place int")
    got = corpus_pipeline.without_near_copies(spark, docs, "")
    assert got.columns == docs.columns
    assert {r.place for r in got.collect()} == kept_by_brute_force(rows)


def test_near_copy_beyond_four_bits_goes(spark):
    """Pairs of the corpus with J >= 0.8 had fingerprints 5 to 13 bits apart, and were both kept."""
    rng = np.random.default_rng(5)
    base = [" ".join(rng.choice([f"w{i}" for i in range(900)], 60)) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, changed(rng, t, 1)) for i, t in enumerate(base)]
    got = corpus_pipeline.without_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert {r.doc_id for r in got.collect()} == set(range(30))


def test_only_the_copy_of_a_repeated_id_goes(spark):
    rng = np.random.default_rng(6)
    base, other = (" ".join(rng.choice([f"w{i}" for i in range(900)], 60)) for _ in range(2))
    rows = [(1, base), (2, changed(rng, base, 1)), (2, other)]
    got = corpus_pipeline.without_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted((r.doc_id, r.text) for r in got.collect()) == sorted([(1, base), (2, other)])


def test_no_rows(spark):
    assert corpus_pipeline.without_near_copies(spark, spark.createDataFrame([], "doc_id long, text string"), "").count() == 0
