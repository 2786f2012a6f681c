"""Set joins: few pairs leave the join, and none that is asked for is lost."""

import itertools

import numpy as np
import pytest

from graftline.operators import sets
from graftline.operators.msf import forest, msf


@pytest.fixture(scope="module")
def words(spark):
    """Sets over few frequent words, so that prefixes meet often, and variants that are alike; two sets of hundreds of words."""
    rng = np.random.default_rng(5)
    some = [set(rng.choice(60, rng.integers(1, 14), replace=False).tolist()) for _ in range(120)]
    some += [s ^ set(rng.choice(60, 2).tolist()) for s in some[:60]] + [set(range(900)), set(range(300, 1100))]
    some = [s for s in some if s]
    rows = {n: {f"w{t}" for t in s} for n, s in enumerate(some)}
    reps, _ = sets.classes(spark.createDataFrame([(n, sorted(s)) for n, s in rows.items()], "doc_id long, tokens array<string>"))
    kept = {r.id: set(r.tokens) for r in reps.collect()}
    alike = {(i, j): len(kept[i] & kept[j]) / len(kept[i] | kept[j]) for i, j in itertools.combinations(sorted(kept), 2)}
    return reps, kept, alike


@pytest.mark.parametrize("hot", [4096, 7])
@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8, 1.0])
def test_pairs_equal_brute_force(words, monkeypatch, threshold, hot):
    monkeypatch.setattr(sets, "HOT", hot)
    reps, _, alike = words
    got = {(r.i, r.j): r.w for r in sets.similar(reps, threshold).collect()}
    want = {p: 1 - s for p, s in alike.items() if s >= threshold - 1e-9}
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-12 for p in got)


def test_few_pairs_leave_the_join(words, monkeypatch):
    checked = []
    real = sets._verified
    monkeypatch.setattr(sets, "_verified", lambda pairs, *rest: checked.append(pairs.count()) or real(pairs, *rest))
    reps, _, alike = words
    want = sum(s >= 0.5 for s in alike.values())
    assert sets.similar(reps, 0.5).count() == want and checked[0] <= 2 * want


def test_forest_of_similar_words(words):
    reps, _, alike = words
    pairs = [(i, j, 1 - s) for (i, j), s in alike.items() if s >= 0.5 - 1e-9]
    i, j, w = (np.array(c) for c in zip(*pairs, strict=True))
    keep = forest(i, j, np.round(w, 12))
    got = msf(sets.similar(reps, 0.5)).collect()
    assert len(got) == len(keep) and sum(r.w for r in got) == pytest.approx(w[keep].sum())


def test_few_pairs_leave_the_buckets(words, monkeypatch):
    checked = []
    real = sets._verified
    monkeypatch.setattr(sets, "_verified", lambda pairs, *rest: checked.append(pairs.count()) or real(pairs, *rest))
    reps, _, alike = words
    want = {p for p, s in alike.items() if s >= 0.5 - 1e-9}
    # at prefix 0 all sets share a bucket
    got = {(r.i, r.j) for r in sets.bucket_similar(reps, sets.MinHash(2, 2), 0.5, 0).collect()}
    assert got == want and checked[0] <= 2 * len(want)
