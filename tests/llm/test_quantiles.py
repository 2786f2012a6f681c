import datetime
import math
import random

import numpy as np
import pytest

from graftline.llm.quantiles import RelativeSketch, merge_sketches, read_sketches, sketch_table

SCHEMA = "i int, j int, day date, v double, sketch string, _salt int"


@pytest.mark.parametrize("high", [True, False])
def test_error_is_relative_to_the_protected_tail(high):
    rng = np.random.default_rng(1)
    x = np.sort(rng.lognormal(size=200_000))
    whole = RelativeSketch(high, seed=9)
    for n, part in enumerate(np.array_split(rng.permutation(x), 30)):
        s = RelativeSketch(high, seed=n)
        s.update(part)
        whole.merge(RelativeSketch.from_bytes(s.to_bytes()))
    assert whole.n == len(x) == sum(len(b) << h for h, b in enumerate(whole.buffers)) and whole.held() < 5000
    for q in (0.001, 0.01, 0.1, 0.5, 0.9, 0.99, 0.999):
        v = x[int(q * len(x))]
        true = np.searchsorted(x, v, "right")
        tail = len(x) - true if high else true
        assert abs(whole.rank(v) - true) <= 0.03 * tail + 1
        got = np.searchsorted(x, whole.quantile(q), "right")
        assert abs(got - q * len(x)) <= 0.03 * (len(x) * (1 - q) if high else len(x) * q) + 2


def test_small_sets_are_exact():
    for values in ([0.5], [3.0, 1.0, 2.0], [1.0] * 10 + [2.0] * 10):
        s = RelativeSketch()
        s.update(np.array(values))
        for q in (0.1, 0.25, 0.5, 0.9, 1.0):
            assert s.quantile(q) == sorted(values)[max(0, math.ceil(q * len(values) - 1e-9) - 1)]
    assert RelativeSketch().quantile(0.5) is None


def test_table_by_day_merges_to_the_whole(spark):
    r = random.Random(2)
    day = [None, *(datetime.date(2026, 3, d) for d in range(1, 5))]
    data = [(1 if r.random() < 0.6 else r.choice([None, 2, 3]), r.choice([0, None]), r.choice(day), r.choice([None, float("nan"), -0.0, r.random(), r.random()]), "s", 1) for _ in range(20_000)]
    data += data[:100]
    df = spark.createDataFrame(data, SCHEMA).repartition(6)
    daily = sketch_table(df, ["i", "j", "day"], "v")
    merged = {(x.i, x.j): x for x in read_sketches(merge_sketches(daily, ["i", "j"]), ["i", "j"], {"p50": 0.5, "p90": 0.9}, {"half": (0.5, True)}).collect()}
    want = {}
    for i, j, _, v, *_ in data:
        if v is not None and v == v:
            want.setdefault((i, j), []).append(v)
    assert {k: len(v) for k, v in want.items()} == {k: x.n for k, x in merged.items()}
    for k, values in want.items():
        values = np.sort(values)
        for q, got in ((0.5, merged[k].p50), (0.9, merged[k].p90)):
            low, high = np.searchsorted(values, got), np.searchsorted(values, got, "right")
            slack = 0.03 * len(values) * (1 - q) + 2
            assert low - slack <= q * len(values) <= high + slack
    again = {(x.i, x.j): x.p50 for x in read_sketches(merge_sketches(daily, ["i", "j"]), ["i", "j"], {"p50": 0.5}).collect()}
    assert again == {k: x.p50 for k, x in merged.items()}


def test_empty_and_bad_arguments(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert sketch_table(df, ["i"], "v").collect() == []
    with pytest.raises(ValueError):
        sketch_table(df, [], "v")
    with pytest.raises(ValueError):
        RelativeSketch(True).merge(RelativeSketch(False))
