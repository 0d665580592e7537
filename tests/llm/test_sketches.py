"""Sketches of shingle sets: they rule candidates out and never a link."""

from __future__ import annotations

import numpy as np
import pytest

from tidelog.llm import near_copies as n


def pair(rng, size, alone, other):
    """Two sets with `size` shingles in common, and what each has alone."""
    all_ = np.unique(rng.integers(0, 1 << 63, size + alone + other, dtype=np.uint64))
    rng.shuffle(all_)
    return np.sort(all_[: size + alone]), np.sort(np.append(all_[:size], all_[size + alone :]))


def test_no_similar_pair_is_ruled_out():
    rng = np.random.default_rng(4)
    for _ in range(3000):
        size = int(rng.choice([1, 4, 8, 60, 64, 65, 500, 3000]))
        a, b = pair(rng, size, int(rng.integers(0, size // 3 + 2)), int(rng.integers(0, size // 3 + 2)))
        if n.similar(len(np.intersect1d(a, b)), len(a), len(b)):
            assert n.may_be_similar(n.sketch(a), n.sketch(b)) and n.may_be_similar(n.sketch(b), n.sketch(a))


@pytest.mark.parametrize("size", [40, 400, 5000])
def test_pairs_with_half_in_common_are_ruled_out(size):
    rng = np.random.default_rng(size)
    left = [n.may_be_similar(*map(n.sketch, pair(rng, size // 2, size // 2, size // 2))) for _ in range(200)]
    assert sum(left) <= 10


def test_sets_are_moved_for_close_pairs_only(spark):
    rng = np.random.default_rng(9)
    near, far = pair(rng, 190, 10, 10), pair(rng, 100, 100, 100)
    sets = [*near, *far]
    marks = spark.createDataFrame([(i, i, n.set_hash(s), bytearray(n.sketch(s))) for i, s in enumerate(sets)], "doc_id long, text_hash long, fp long, sketch binary")
    pairs = spark.createDataFrame([(n.set_hash(a), n.set_hash(b)) for a, b in (near, far)], "a long, b long")
    assert [tuple(r) for r in n.close_pairs(marks, pairs).collect()] == [tuple(map(n.set_hash, near))]


def test_simhash_gives_the_first_candidates_and_prefixes_the_rest(spark, monkeypatch):
    """Links within four bits come from op2's index; those beyond from prefixes."""
    import corpus_pipeline
    from tidelog.llm import simhash

    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(900)]
    base = " ".join(rng.choice(words, 3000))
    far = " ".join(rng.choice(words, 60))
    docs = spark.createDataFrame([(1, base), (2, base + " end"), (3, far), (4, far.replace(far.split()[30], "new", 1))], "doc_id long, text string")
    bits = [simhash.fingerprint(r.text.encode(), n.SHINGLE) for r in docs.orderBy("doc_id").collect()]
    assert (bits[0] ^ bits[1]).bit_count() <= simhash.DISTANCE < (bits[2] ^ bits[3]).bit_count()
    asked, confirm = [], n._confirm
    monkeypatch.setattr(n, "_confirm", lambda d, m, pairs: asked.append(pairs.collect()) or confirm(d, m, pairs))
    assert sorted(r.doc_id for r in corpus_pipeline.without_near_copies(spark, docs, "").collect()) == [1, 3]
    fp = [n.set_hash(n.shingles(r.text.encode())) for r in docs.orderBy("doc_id").collect()]
    assert [[{r.a, r.b} for r in step] for step in asked[:2]] == [[{fp[0], fp[1]}], [{fp[2], fp[3]}]]
