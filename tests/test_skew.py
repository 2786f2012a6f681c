import random
import re

from pyspark.sql import functions as F

from graftline.operators.skew import LoadPlan, pack, per_key, skew_join

SCHEMA = "i int, a long, b long, v double, n string"


def test_pack_balances_and_cuts():
    rows = pack([("big", 900), ("x", 50), ("y", 50)], 4)
    load = [0.0] * 4
    for item, shards, _, task in rows:
        load[task] += {"big": 900, "x": 50, "y": 50}[item] / shards
    assert max(load) <= 1.25 * sum(load) / 4
    assert sorted(r[2] for r in rows if r[0] == "big") == [0, 1, 2, 3]
    assert pack([], 3) == []


def brute(data):
    out = {}
    for i, a, b, v, _ in data:
        lines, pairs, values = out.setdefault(i, [0, set(), []])
        out[i][0] = lines + 1
        if a is not None and b is not None:
            pairs.add((a, b))
        if v is not None and 0 <= v <= 2:
            values.append(v)
    return {(i, n, len(p), round(sum(v) / len(v), 9) if v else None) for i, (n, p, v) in out.items()}


def test_per_key_with_a_hot_key_nulls_and_repeats(spark):
    r = random.Random(3)
    data = [(7 if r.random() < 0.5 else r.choice([None, *range(40)]), r.choice([None, *range(6)]), r.randrange(5), r.choice([None, 0.5, 1.0, -0.0, float("nan"), float("inf"), -1.0]), "x") for _ in range(4000)]
    data += [(7, 1, 1, 0.25, "y")] * 2000  # one pair holds a third of all rows
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    got = per_key(df, ["i"], ["a", "b"], "v", F.col("v").between(0.0, 2.0), tasks=6, combine_rows=500).collect()
    assert {(x.i, x.n_lines, x.n_pairs, None if x.mean_value is None else round(x.mean_value, 9)) for x in got} == brute(data)
    assert len(got) == len(brute(data))


def test_hot_key_is_spread_over_tasks(spark):
    df = spark.createDataFrame([(1, k, k) for k in range(3000)] + [(k, 0, 0) for k in range(2, 300)], "i int, a long, b long")
    plan = LoadPlan(df, ["i"], tasks=5)
    parts = plan.fragment(df, ["a", "b"]).repartition(5, "_salt").groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) == 5 and max(p["count"] for p in parts) < 1.5 * 3298 / 5


def test_empty_table(spark):
    assert per_key(spark.createDataFrame([], SCHEMA), ["i"], ["a", "b"], "v").collect() == []


def test_key_columns_may_clash_with_working_names(spark):
    df = spark.createDataFrame([(1, 2, 3, 0.5)], "n int, k0 int, total long, used double")
    row = per_key(df, ["n", "total"], ["k0"], "used").collect()[0]
    assert (row["n"], row["total"], row.n_lines, row.n_pairs, row.mean_value) == (1, 3, 1, 1, 0.5)


def test_skew_join_equals_join(spark):
    r = random.Random(5)
    left = spark.createDataFrame([(1 if r.random() < 0.6 else r.choice([None, *range(30)]), n, "l") for n in range(2000)], "k int, id long, s string")
    right = spark.createDataFrame([(k, f"r{k}") for k in [1, 1, *range(5, 20)]] + [(None, "none")], "k int, s string")
    for how in ("inner", "left"):
        want = sorted((x.k or -1, x.id, x.t or "") for x in left.join(right.withColumnRenamed("s", "t"), "k", how).collect())
        got = sorted((x.k or -1, x.id, x.s_right or "") for x in skew_join(left, right, ["k"], ["id"], how, tasks=4).collect())
        assert got == want


def test_skew_join_keeps_to_the_packed_tasks(spark):
    left = spark.createDataFrame([(1 if n % 2 else n, n) for n in range(6000)], "k int, id long")
    right = spark.createDataFrame([(k, f"r{k}") for k in range(6000)], "k int, s string")
    joined = skew_join(left, right, ["k"], ["id"], tasks=6)
    parts = [p["count"] for p in joined.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(parts) == 6000 and max(parts) < 2 * sorted(parts)[len(parts) // 2]
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"hashpartitioning\(_salt#\d+, 6\)", plan)) == 2 and not re.search(r"hashpartitioning\(_salt#\d+, k#", plan)
