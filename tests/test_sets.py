import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graftline.operators import sets, settiles
from graftline.operators.diagnostics import histogram, recall_over_runs
from graftline.operators.msf import forest, msf
from graftline.session import materialize


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_join_is_exact(spark):
    r = random.Random(4)
    base = [[r.randrange(400) for _ in range(r.randint(1, 30))] for _ in range(30)]
    data = []
    for n in range(150):
        tokens = set(map(str, r.choice(base)))
        for _ in range(r.randint(0, 3)):
            tokens.symmetric_difference_update({str(r.randrange(400))})
        data.append((n, sorted(tokens)))
    df = spark.createDataFrame(data, "doc_id long, tokens array<string>")
    reps, membership = sets.classes(df)
    by = {x.id: set(x.tokens) for x in reps.collect()}
    assert {x.doc_id: by[x.rep] for x in membership.collect()} == {n: set(t) for n, t in data if t}
    for t in (0.5, 0.8, 1.0):
        want = {(i, j) for i in by for j in by if i < j and jaccard(by[i], by[j]) >= t}
        assert {(x.i, x.j) for x in sets.similar(reps, t).collect()} == want
    near = sets.set_neighbours(df.selectExpr("doc_id as id", "tokens").filter("id < 5"), reps, 3).collect()
    assert all(x.rank <= 3 and x.query_id != x.id for x in near)


def test_shingles(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a b"), (4, "a b c d e f"), (5, "x x x x x x"), (6, " "), (7, "a\u00a0 b\n\nc\td e ")], "doc_id long, text string")
    got = {x.doc_id: x.tokens for x in df.select("doc_id", sets.shingles("text").alias("tokens")).collect()}
    assert got == {1: [], 2: [], 3: ["a b"], 4: ["a b c d e", "b c d e f"], 5: ["x x x x x"], 6: [], 7: ["a b c d e"]}
    with pytest.raises(ValueError):
        sets.similar(df, 0)


def test_diagnostics(spark):
    runs = spark.createDataFrame([(1, 2.0, 2.0, 3.0), (2, None, float("nan"), 1.0), (3, None, None, None)], "run_id long, w0 double, w1 double, w2 double")
    got = {x.run_id: (x.least, x.share) for x in recall_over_runs(runs, ["w0", "w1", "w2"]).collect()}
    assert got == {1: (2.0, pytest.approx(2 / 3)), 2: (1.0, 1.0), 3: (None, None)}
    values = spark.createDataFrame([(0.0,), (-0.0,), (1.0,), (2.0,), (None,), (float("nan"),), (9.0,)], "v double")
    assert {x.bin: x.n for x in histogram(values, "v", 0.0, 2.0, 2).collect()} == {1: 2, 2: 2}


def test_minhash_buckets_find_similar_sets(spark, monkeypatch):
    monkeypatch.setattr(sets, "HOT", 20)  # frequent tokens are cut
    r = random.Random(2)
    base = [[str(r.randrange(500)) for _ in range(40)] for _ in range(20)]
    data = [(n, sorted(set(r.choice(base)[:36]) | {str(r.randrange(500)) for _ in range(4)} | {"common"})) for n in range(200)]
    reps = spark.createDataFrame(data, "id long, tokens array<string>")
    want = {(i, j) for i, a in data for j, b in data if i < j and jaccard(set(a), set(b)) >= 0.7}
    assert {(x.i, x.j) for x in sets.similar(reps, 0.7).collect()} == want
    found = sets.bucket_similar(reps, sets.MinHash(40, 3), 0.7).collect()
    assert {(x.i, x.j) for x in found} <= want and len(found) >= 0.95 * len(want)
    assert all(0 <= x.fail < 0.05 for x in found)
    assert sets.bucket_similar(reps.limit(0), sets.MinHash(2, 2), 0.7).count() == 0


def alike(n=240):
    r = random.Random(7)
    base = [[str(r.randrange(500)) for _ in range(r.randint(1, 40))] for _ in range(25)]
    return [(k, sorted(set(r.choice(base)) ^ {str(r.randrange(500)) for _ in range(r.randint(0, 5))} | {"common"})) for k in range(n)]


@pytest.fixture
def in_tiles(monkeypatch):
    """Small blocks and parts, and the names of the tables that are written."""
    for name, value in (("FEW", 20), ("LIST", 50), ("HELD", 100), ("TOKENS", 300)):
        monkeypatch.setattr(settiles, name, value)
    written = []
    monkeypatch.setattr(sets, "materialize", lambda df, name: (written.append(name), materialize(df, name))[1])
    return written


def test_forest_of_sets_in_tiles_writes_no_pairs(spark, in_tiles):
    data = alike()
    reps = spark.createDataFrame(data, "id long, tokens array<string>")
    want = {(i, j): 1 - jaccard(set(a), set(b)) for i, a in data for j, b in data if i < j and jaccard(set(a), set(b)) >= 0.5}
    got = sets.similar(reps, 0.5).toPandas()
    assert len(got) == len(want) > 500 and {(i, j): w for i, j, w in zip(got.i, got.j, got.w, strict=True)} == pytest.approx(want)
    keys = sorted((w, i, j) for (i, j), w in want.items())
    i, j, w = (np.array(c) for c in ([k[1] for k in keys], [k[2] for k in keys], [k[0] for k in keys]))
    tree = msf(sets.similar(reps, 0.5)).toPandas()
    assert set(zip(tree.i, tree.j, strict=True)) == {(i[k], j[k]) for k in forest(i, j, w)}
    assert set(in_tiles) == {"sets"}


@pytest.mark.parametrize("prefix", [0, 2, 3])
def test_bucket_pairs_in_tiles_write_no_pairs(spark, in_tiles, prefix):
    data = alike()
    reps = spark.createDataFrame(data, "id long, tokens array<string>")
    family = sets.MinHash(5, 3)
    code = {(x.vec_id, x.rep): tuple(x.code[:prefix]) for x in family.codes(reps).collect()}
    met = {(i, j) for i, _ in data for j, _ in data if i < j and any(code[i, k] == code[j, k] for k in range(5))}
    want = {(i, j) for i, a in data for j, b in data if (i, j) in met and jaccard(set(a), set(b)) >= 0.5}
    got = sets.bucket_similar(reps, family, 0.5, prefix).collect()
    assert len(got) == len(want) and {(x.i, x.j) for x in got} == want
    assert in_tiles == ["sets"]


def test_tokens_of_one_number_are_told_apart(spark, in_tiles, monkeypatch):
    data = alike(80)
    reps = spark.createDataFrame(data, "id long, tokens array<string>")
    want = {(x.i, x.j) for x in sets.similar(reps, 0.5).collect()}, {(x.i, x.j) for x in sets.bucket_similar(reps, sets.MinHash(5, 3), 0.5).collect()}
    monkeypatch.setattr(settiles, "token_number", lambda t: F.length(t).cast("long"))
    assert not settiles.distinct_numbers(reps)
    assert ({(x.i, x.j) for x in sets.similar(reps, 0.5).collect()}, {(x.i, x.j) for x in sets.bucket_similar(reps, sets.MinHash(5, 3), 0.5).collect()}) == want
