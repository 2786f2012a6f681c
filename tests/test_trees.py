import numpy as np
import pytest
from pyspark.sql import functions as F

from graftline.functions.families import E2LSH, CrossPolytope, SimHash, codes
from graftline.functions.vectors import METRICS, metric, prepare
from graftline.operators import candidates as cand
from graftline.operators.buckets import bucket_closest, hashed, placed
from graftline.operators import knn, tree
from graftline.operators.msf import canonical, component_labels, distributed_forest, forest, msf
from graftline.operators.pairs import all_pairs, closest_pairs, exact_neighbours, exact_tree
from graftline.plans.config import Settings, repetitions_within
from graftline.sources import logs
from graftline.sources.index_store import Index
from graftline.streaming.incremental import TreeStream, append_points

POINT = "vec_id long, embedding array<float>, label int"


def frame(spark, x):
    return spark.createDataFrame([(n, [float(v) for v in r], n % 3) for n, r in enumerate(x)], POINT)


def clustered(n=160, dim=16, groups=8, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, dim)) * 4
    return (centres[np.arange(n) % groups] + rng.standard_normal((n, dim)) * 0.2).astype(np.float32)


def kruskal(x, name):
    m = metric(name)
    u = prepare(x, m)
    edges = sorted((w, i, i + 1 + j) for i in range(len(u) - 1) for j, w in enumerate(m.rows(u[i], u[i + 1 :])))
    up = list(range(len(u)))

    def find(v):
        while up[v] != v:
            v = up[v]
        return v

    out = set()
    for w, i, j in edges:
        a, b = find(i), find(j)
        if a != b:
            up[a] = b
            out.add((i, j))
    return out


def ends(df):
    return {(r.i, r.j) for r in df.select("i", "j").collect()}


@pytest.mark.parametrize("name", sorted(METRICS))
@pytest.mark.parametrize("kind", ["clustered", "copies", "collinear"])
def test_exact_tree(spark, name, kind):
    x = {"clustered": clustered(60), "copies": np.repeat(clustered(15), 3, axis=0), "collinear": np.outer(np.arange(1, 31), np.ones(4)).astype(np.float32)}[kind]
    got = exact_tree(frame(spark, x), name, tile_rows=16)
    rows = got.collect()
    assert len(rows) == len(x) - 1
    m = metric(name)
    u = prepare(x, m)
    want = kruskal(x, name)
    if kind == "clustered":
        assert {(r.i, r.j) for r in rows} == want
    assert sum(r.w for r in rows) == pytest.approx(sum(m.rows(u[i], u[j : j + 1])[0] for i, j in want), abs=1e-9)


@pytest.mark.parametrize("n", [0, 1, 2])
def test_few_points(spark, n):
    points = frame(spark, clustered(4)[:n])
    for edges in (exact_tree(points, "euclidean"), tree.find_tree(points, E2LSH(16, 2, 2)).edges, tree.find_epsilon_tree(points, E2LSH(16, 2, 2)).edges):
        assert edges.count() == max(0, n - 1)
    assert all_pairs(points, "cosine").count() == n * (n - 1) // 2


def test_zero_vector_has_a_defined_distance(spark):
    x = np.vstack([np.zeros(4), np.eye(4)[:2]]).astype(np.float32)
    assert sorted(round(r.w, 9) for r in all_pairs(frame(spark, x), "cosine").collect()) == [1.0, 1.0, 1.0]


def test_forest_matches_distributed(spark):
    rng = np.random.default_rng(0)
    i, j = rng.integers(0, 60, 300), rng.integers(0, 60, 300)
    edges = spark.createDataFrame([(int(a), int(b), float(w)) for a, b, w in zip(i, j, rng.integers(0, 5, 300), strict=True)] + [(1, None, 2.0), (2, 3, float("nan"))], "i long, j long, w double")
    clean = canonical(edges).toPandas()
    keep = forest(clean.i.to_numpy(), clean.j.to_numpy(), clean.w.to_numpy())
    want = set(zip(clean.i[keep], clean.j[keep], strict=True))
    assert ends(msf(canonical(edges))) == ends(distributed_forest(canonical(edges))) == want


def test_component_labels_both_ways(spark, monkeypatch):
    edges = spark.createDataFrame([(k, k + 1) for k in range(20, 40)] + [(1, 5), (5, 3)], "i long, j long")
    vertices = spark.range(50).withColumnRenamed("id", "vec_id")
    want = {k: (20 if 20 <= k <= 40 else 1 if k in (1, 3, 5) else k) for k in range(50)}
    assert {r.vec_id: r.comp for r in component_labels(edges, vertices).collect()} == want
    monkeypatch.setattr("graftline.operators.msf.LOCAL_VERTICES", 10)
    assert {r.vec_id: r.comp for r in component_labels(edges, vertices).collect()} == want


@pytest.mark.parametrize("family", [SimHash(16, 12, 8), E2LSH(16, 12, 5, width=4.0)])
def test_finders_on_clusters(spark, family):
    x = clustered()
    points = frame(spark, x)
    want = kruskal(x, family.metric)
    for prune in (False, True):
        found = tree.find_tree(points, family, prune_connected=prune)
        assert ends(found.edges) == want
    least = exact_tree(points, family.metric).agg(F.sum("w")).first()[0]
    near = tree.find_epsilon_tree(points, family, epsilon=0.5)
    assert near.edges.agg(F.sum("w")).first()[0] <= 1.5 * least + 1e-9 and near.edges.count() == len(x) - 1
    assert found.metrics().count() == len(found.levels) and found.levels[-1]["accepted"]
    last = found.levels[-1]
    assert found.path == last["path"] and found.described().first().prefix == found.prefix
    row = tree.is_connected(found.edges, points).first()
    assert row.connected and row.n_edges == len(x) - 1


def test_buckets_nest_and_widening_repeats_no_pair(spark):
    table = codes(frame(spark, clustered()), SimHash(16, 3, 6)).cache()
    seen = set()
    for prefix in range(6, -1, -1):
        new, everything = ends(cand.new_pairs(table, prefix)), ends(cand.prefix_pairs(table, prefix))
        assert not new & seen
        seen |= new
        assert seen == everything
    assert len(seen) == 160 * 159 // 2


def test_cross_polytope_probability(spark):
    family = CrossPolytope(16, 40, 1)
    rng = np.random.default_rng(2)
    a = rng.standard_normal((400, 16))
    b = a + 0.5 * rng.standard_normal((400, 16))
    same = (family.symbols(a) == family.symbols(b)).mean()
    d = 1 - (a * b).sum(1) / np.linalg.norm(a, axis=1) / np.linalg.norm(b, axis=1)
    p = spark.createDataFrame([(float(v),) for v in d], "d double").agg(F.avg(family.collision(F.col("d")))).first()[0]
    assert abs(p - same) < 0.03


def test_neighbours_and_closest_pairs(spark):
    x = clustered(150)
    points = frame(spark, x)
    u = x.astype(float)
    d = np.sqrt(((u[:, None] - u[None]) ** 2).sum(2))
    want = {(q, int(i)) for q in range(0, 150, 50) for i in np.lexsort((np.arange(150), np.where(np.arange(150) == q, np.inf, d[q])))[:5]}
    asked = points.filter("vec_id % 50 = 0")
    assert {(r.query_id, r.id) for r in exact_neighbours(asked, points, "euclidean", 5).collect()} == want
    assert {(r.query_id, r.id) for r in knn.knn(asked, points, E2LSH(16, 8, 4, width=4.0), 5).collect()} == want
    pairs = sorted((d[i, j], i, j) for i in range(150) for j in range(i + 1, 150))[:10]
    assert ends(closest_pairs(points, "euclidean", 10, tile_rows=40)) == {(i, j) for _, i, j in pairs}
    found, figures = knn.closest_pairs(points, E2LSH(16, 16, 4, width=4.0), 10)
    assert figures["path"] == "lsh" and figures["prefix"] > 0
    assert len(ends(found) & {(i, j) for _, i, j in pairs}) >= 9


def test_filter_modes(spark):
    points = frame(spark, clustered(150))
    for mode in knn.FILTERS:
        assert knn.knn(points.filter("vec_id = 0"), points, SimHash(16, 4, 6), 5, filter_type=mode).count() == 5
    with pytest.raises(ValueError):
        knn.knn(points, points, SimHash(16, 4, 6), 5, filter_type="other")


def test_derived_sketch_limit_keeps_the_neighbours(spark, sf):
    from graftline import queries as core

    ends_ = {q: {(r.query_id, r.id) for r in getattr(core, q)(spark, sf).collect()} for q in ("knn_lsh_sketch_derived", "knn_from_index_exact")}
    want = ends_["knn_from_index_exact"]
    assert len(ends_["knn_lsh_sketch_derived"] & want) >= 0.9 * len(want)
    with pytest.raises(ValueError):
        knn.knn(frame(spark, clustered(150)), frame(spark, clustered(150)), E2LSH(16, 4, 4, width=4.0), 5, filter_type="simple", miss=0.01)


def plane(n=600, seed=3):
    return (np.random.default_rng(seed).random((n, 2)) * 100).astype(np.float32)


@pytest.mark.parametrize("tile_rows", [40, 2048])
@pytest.mark.parametrize("prune", [False, True])
def test_the_rule_accepts_before_all_pairs_are_compared(spark, monkeypatch, tile_rows, prune):
    monkeypatch.setattr("graftline.operators.buckets.TILE_ROWS", tile_rows)
    x = plane()
    found = tree.find_tree(frame(spark, x), E2LSH(2, 16, 12, width=60.0), prune_connected=prune)
    assert found.path == "lsh" and found.prefix > 0 and found.levels[-1]["n_confirmed"] == len(x) - 1
    assert ends(found.edges) == kruskal(x, "euclidean")
    near = tree.find_epsilon_tree(frame(spark, x), E2LSH(2, 16, 12, width=60.0), epsilon=0.1)
    assert near.path == "lsh" and near.prefix >= found.prefix


def test_the_sweep_starts_where_the_buckets_connect(spark):
    x, family = plane(200), E2LSH(2, 4, 8, width=40.0)
    table = hashed(frame(spark, x), family)
    start = tree.connecting_prefix(table, family.depth, len(x))

    def parts(prefix):
        labels = component_labels(cand.prefix_pairs(table, prefix), frame(spark, x).select("vec_id"))
        return labels.select("comp").distinct().count()

    assert parts(start) == 1 and (start == family.depth or parts(start + 1) > 1)


def test_a_bucket_with_half_of_the_rows_is_spread(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([np.repeat(rng.standard_normal((1, 8)), 1000, axis=0) + 1e-3 * rng.standard_normal((1000, 8)), rng.standard_normal((1000, 8))]).astype(np.float32)
    table, points = hashed(frame(spark, x), SimHash(8, 2, 16)), frame(spark, x)
    rows = placed(table, points, 16, False, 100).groupBy("bucket", "lo", "hi").count().collect()
    assert max(r["count"] for r in rows) <= 300  # two tiles of about 100
    pairs = cand.met(codes(frame(spark, x), SimHash(8, 1, 16)), 16, hot=100)
    plain = cand.met(codes(frame(spark, x), SimHash(8, 1, 16)), 16, hot=10**9)
    assert pairs.select("i", "j").exceptAll(plain.select("i", "j")).isEmpty() and pairs.count() == plain.count() > 400_000
    closest = bucket_closest(table, points, 16, "cosine", 50, 9, tile_rows=100).collect()
    assert [tuple(r) for r in closest] == [tuple(r) for r in bucket_closest(table, points, 16, "cosine", 50, 9).collect()] and len(closest) == 50


def test_random_path_visits_every_point_once(spark):
    edges = cand.random_path(spark.range(101).withColumnRenamed("id", "vec_id")).collect()
    ends_ = [v for r in edges for v in (r.i, r.j)]
    assert len(edges) == 100 and sorted(np.bincount(ends_).tolist())[:3] == [1, 1, 2] and max(np.bincount(ends_)) == 2
    assert cand.random_path(spark.range(1).withColumnRenamed("id", "vec_id")).count() == 0


def test_index_save_load_extend(spark, tmp_path):
    points, family = frame(spark, clustered(40)), SimHash(16, 3, 4)
    whole = Index(points, family)
    grown = Index(points.filter("vec_id < 20"), family).insert(points)
    assert grown.equals(whole)
    path = str(tmp_path / "index")
    assert Index.load_or_build(points, family, path).equals(whole)
    whole.save(path)
    loaded = Index.load(spark, path)
    assert loaded.equals(whole) and loaded.describe()["points"] == 40
    assert loaded.code_of(3, 1).count() == 1 and loaded.get(3).count() == 1
    assert not loaded.equals(Index(points, SimHash(16, 3, 4, seed=1)))
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        whole.save(path)


def test_logs_round_trip(spark, tmp_path):
    edges = spark.createDataFrame([(24, 0, 1, 2, 0.5)], logs.COLLISIONS)
    for _ in range(2):
        logs.write_collisions(edges, str(tmp_path / "c"))
    assert logs.read_collisions(spark, str(tmp_path / "c")).count() == 2
    runs = spark.createDataFrame([("glove", 200, 1.0, 2.0, None, 2.0)], logs.RECALLS)
    logs.write_recalls(runs, str(tmp_path / "r"))
    assert logs.read_recalls(spark, str(tmp_path / "r")).collect() == runs.collect()
    logs.write_tree(spark.createDataFrame([(1, 2)], "i long, j long"), str(tmp_path / "t"))
    assert logs.read_tree(spark, str(tmp_path / "t")).collect()[0].j == 2


def test_the_whole_log_survives_a_round_trip(spark, sf, tmp_path):
    from collections import Counter

    from graftline import queries as core
    from graftline.session import table

    def lines(df):
        return Counter(map(repr, df.select("i", "j", "edge1", "edge2", "distance").collect()))

    log = table(spark, sf, "glove_sampl")
    assert lines(core.QUERIES["collision_log_roundtrip"](spark, sf)) == lines(log)
    odd = spark.createDataFrame([(None,) * 5, (1, None, 2, 3, float("nan")), (1, 0, 2, 3, float("inf")), (1, 0, 2, 3, float("-inf")), (1, 0, None, 3, -0.0), (1, 0, 2, 3, 1e-300)], logs.COLLISIONS)
    logs.write_collisions(odd, str(tmp_path / "odd"))
    assert lines(logs.read_collisions(spark, str(tmp_path / "odd"))) == lines(odd)


def test_appending_gives_the_tree_of_all(spark, tmp_path):
    x = clustered(60)
    points = frame(spark, x)
    old, new = points.filter("vec_id < 35"), points.filter("vec_id >= 35")
    assert ends(append_points(exact_tree(old, "euclidean"), old, new, "euclidean")) == kruskal(x, "euclidean")
    for n, part in enumerate((old, new, new)):
        part.coalesce(1).write.parquet(str(tmp_path / "in" / f"b{n}"))
    where = str(tmp_path / "state")

    def follow():
        state = TreeStream(spark, where=where)
        stream = spark.readStream.schema(POINT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
        query = state.start(stream, availableNow=True)
        query.awaitTermination()
        return state

    state = follow()
    assert ends(state.tree) == kruskal(x, "euclidean") and state.points.count() == 60
    # after a restart the state goes on, a batch that comes again changes nothing and known points are left out
    more = frame(spark, clustered(70)).filter("vec_id >= 60").unionByName(new.limit(3))
    more.coalesce(1).write.parquet(str(tmp_path / "in" / "b9"))
    state = follow()
    assert state.points.count() == 70 and ends(state.tree) == kruskal(clustered(70), "euclidean")
    before = state.batches
    state.writer(points, before[-1])
    assert state.batches == before and state.points.count() == 70


def test_settings_and_memory():
    assert isinstance(Settings("cosine").family(8), SimHash) and Settings("angular").family(8).metric == "angular"
    for bad in ({"metric": "dot"}, {"delta": 0}, {"recall": 2}, {"k": 0}):
        with pytest.raises(ValueError):
            Settings(**bad)
    assert repetitions_within(10_000_000, 1000, 64, 8) > 1
    with pytest.raises(ValueError, match="insufficient memory"):
        repetitions_within(1000, 1000, 64, 8)


def test_settings_drive_the_operators(spark):
    from graftline.plans import config

    x = clustered(120)
    points = frame(spark, x)
    for name in ("angular", "cosine"):
        found = config.find_tree(points, 16, Settings(name, 12, 6))
        assert ends(found.edges) == kruskal(x, name)
        m = metric(name)
        u = prepare(x, m)
        edge = found.edges.first()
        assert edge.w == pytest.approx(m.rows(u[edge.i], u[edge.j : edge.j + 1])[0])
    assert config.find_epsilon_tree(points, 16, Settings("cosine", 12, 6)).edges.count() == 119
    assert config.neighbours(points.filter("vec_id < 3"), points, 16, Settings("cosine", 12, 6, k=4)).count() == 12
    assert config.closest_pairs(points, 16, Settings("cosine", 12, 6, k=7)).count() == 7


def test_bad_arguments(spark):
    with pytest.raises(ValueError):
        SimHash(0, 1, 1)
    with pytest.raises(ValueError):
        cand.prefix_of("code", -1)
    with pytest.raises(Exception, match="every vector must have"):
        codes(frame(spark, clustered(4, dim=8)), SimHash(16, 1, 1)).collect()
