import random

import pyarrow.parquet as pq
import pytest

from graftline.llm import topn

SCHEMA = "g long, item long, score double, key string, rank int"


def brute(data, n, largest):
    best = {}
    for g, item, s, *_ in data:
        if g is None or item is None or s is None or s != s:
            continue
        k = (g, item)
        s += 0.0
        if k not in best or (s > best[k] if largest else s < best[k]):
            best[k] = s
    groups = {}
    for (g, item), s in best.items():
        groups.setdefault(g, []).append((-s if largest else s, item))
    return {(g, item, abs(s) if s == 0 else (-s if largest else s), r) for g, rows in groups.items() for r, (s, item) in enumerate(sorted(rows)[:n], 1)}


def data(size, seed=1):
    r = random.Random(seed)
    rows = []
    for _ in range(size):
        g = 1 if r.random() < 0.4 else r.choice([None, *range(2, 60)])
        rows.append((g, r.choice([None, *range(size // 3)]), r.choice([None, -0.0, 0.0, float("nan"), float("inf"), round(r.random(), 2)]), "k", 0))
    return rows + rows[:50]


@pytest.mark.parametrize("largest", [True, False])
def test_equals_brute_force(spark, largest):
    rows = data(3000)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = {(x.g, x.item, x.score, x["rank"]) for x in topn.top_n_per_group(df, "g", "item", "score", 7, largest).collect()}
    assert got == brute(rows, 7, largest)


def test_hot_group_row_groups_are_skipped(spark, tmp_path):
    rows = [(1, k, (k * 7919 % 100003) / 1e5) for k in range(60_000)] + [(g, 1, 0.5) for g in range(2, 40)]
    df = spark.createDataFrame(rows, "g long, item long, score double")
    topn.cluster(df, "g", "item", "score", str(tmp_path / "t"), largest=False, row_group_bytes=20_000)
    read = skipped = 0
    for f in spark.read.parquet(str(tmp_path / "t")).inputFiles():
        _, r, s = topn.scan_file(f, 5)
        read, skipped = read + r, skipped + s
        assert pq.ParquetFile(f.replace("file://", "")).metadata.num_row_groups == r + s
    assert skipped > read
    got = [x.item for x in topn.top_n(spark, str(tmp_path / "t"), 5).filter("g = 1").orderBy("rank").collect()]
    assert got == [k for _, k in sorted((s, k) for g, k, s in rows if g == 1)[:5]]


def test_ties_over_row_groups(spark, tmp_path):
    df = spark.createDataFrame([(1, k, 0.5) for k in range(40_000)], "g long, item long, score double")
    topn.cluster(df, "g", "item", "score", str(tmp_path / "t"), row_group_bytes=20_000)
    assert [x.item for x in topn.top_n(spark, str(tmp_path / "t"), 3).orderBy("rank").collect()] == [0, 1, 2]


def test_text_groups_and_empty_table(spark):
    df = spark.createDataFrame([("a" * 5000, "x", 1), ("a" * 5000, "y", 2), ("", "z", 3)], "g string, i string, s int")
    assert topn.top_n_per_group(df, "g", "i", "s", 1).count() == 2
    assert topn.top_n_per_group(df.limit(0), "g", "i", "s", 1).collect() == []
    with pytest.raises(ValueError):
        topn.top_n_per_group(df, "g", "i", "s", 0)
