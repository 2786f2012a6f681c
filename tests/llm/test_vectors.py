import numpy as np
import pytest

from graftline.llm import imi
from graftline.llm.clusters import Clusters, cliques, markov_clusters, pivots
from graftline.llm.neighbours import nearest

SCHEMA = "row_id long, train array<float>, vec string, cells int"
DIM = 20


def groups(seed=0, background=300, sizes=(3, 4, 9, 40, 120, 2), noise=0.12):
    rng = np.random.default_rng(seed)
    rows = [rng.standard_normal((background, DIM))]
    for n in sizes:
        centre = rng.standard_normal(DIM)
        rows.append((centre / np.linalg.norm(centre) + noise / np.sqrt(DIM) * rng.standard_normal((n, DIM))) * rng.uniform(1, 9, (n, 1)))
    x = np.concatenate(rows).astype(np.float32)
    return x[rng.permutation(len(x))]


def frame(spark, x, dirty=True):
    rows = [(n, [float(v) for v in r], "v", 1) for n, r in enumerate(x)]
    if dirty:
        bad = [None, [], [1.0] * (DIM - 1), [0.0] * DIM, [float("nan")] + [1.0] * (DIM - 1), [float("inf")] + [1.0] * (DIM - 1), [None] + [1.0] * (DIM - 1)]
        rows += [(100_000 + n, b, None, None) for n, b in enumerate(bad)] + [(None, [1.0] * DIM, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def distances(x):
    u = imi.unit(x)
    return np.round(1 - u @ u.T, 9) + 0.0


def truth(x, k, radius):
    d = distances(x)
    np.fill_diagonal(d, 9)
    out = set()
    for r in range(len(x)):
        for c in np.lexsort((np.arange(len(x)), d[r]))[:k]:
            if d[r, c] <= radius:
                out.add((r, int(c)))
    return out


@pytest.mark.parametrize("block_rows", [40, imi.BLOCK_ROWS])
def test_neighbours_within_radius(spark, block_rows):
    x = groups()
    got = {(r.row, r.other) for r in nearest(frame(spark, x), "row_id", "train", DIM, 5, 0.2, block_rows=block_rows).collect()}
    want = truth(x, 5, 0.2)
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)


def test_recall_without_radius(spark):
    x = groups(background=600)
    got = {(r.row, r.other) for r in nearest(frame(spark, x), "row_id", "train", DIM, 5, probes=32, margin=9.0).collect()}
    want = truth(x, 5, 2.0)
    assert len(got & want) >= 0.9 * len(want)


@pytest.mark.parametrize("block_rows", [100, None])
def test_exact_neighbours_are_whole(spark, block_rows):
    x = groups(background=600)
    got = {(r.row, r.other) for r in nearest(frame(spark, x), "row_id", "train", DIM, 5, block_rows=block_rows, exact=True).collect()}
    want = truth(x, 5, 2.0)
    assert len(got) == len(want) == 5 * len(x) and len(got & want) >= 0.99 * len(want)


def test_registered_neighbours_have_no_radius(spark, sf):
    from graftline.llm.queries import p3_neighbours
    from graftline.session import table

    rows = table(spark, sf, "glove_100_angular").toArrow()
    usable, _ = imi.vectors_of(rows.column("train"), 100)
    got = p3_neighbours(spark, sf).collect()
    assert len(got) == 5 * len(usable) and {r.row for r in got} == set(rows.column("row_id").to_numpy()[usable].tolist())


def test_copies_take_the_smallest_ids(spark):
    x = np.concatenate([np.repeat(np.eye(DIM)[:1], 50, axis=0), 3 * np.eye(DIM)[:1], groups(background=50, sizes=())]).astype(np.float32)
    got = {}
    for r in nearest(frame(spark, x), "row_id", "train", DIM, 5, 0.2, block_rows=16).collect():
        got.setdefault(r.row, []).append((r.rank, r.other))
    assert sorted(got[0]) == [(k, k) for k in range(1, 6)]
    assert [o for _, o in sorted(got[49])] == [0, 1, 2, 3, 4]
    assert [o for _, o in sorted(got[50])] == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("block_rows", [50, imi.BLOCK_ROWS])
def test_clusters(spark, block_rows, monkeypatch):
    x = groups()
    near = distances(x) <= 0.2
    want = set()
    for r in range(len(x)):
        m = np.flatnonzero(near[r])
        if len(m) > 2:
            assert near[np.ix_(m, m)].all()
            want |= {(int(m[0]), int(v)) for v in m}
    monkeypatch.setattr("graftline.llm.clusters.TILE_ROWS", 50)  # the largest cluster is checked in tiles
    c = Clusters(frame(spark, x), "row_id", "train", DIM, 0.2, block_rows=block_rows)
    got = {(r.cluster_row, r.row_id) for r in c.found.collect()}
    assert len(got & want) >= 0.97 * len(want) and len(got) <= 1.03 * len(want)
    rows = c.described().collect()
    assert sum(r["size"] for r in rows) == len(got)
    assert all(1 <= len(r.typical) <= 3 and {(r.cluster_row, t) for t in r.typical} <= got for r in rows)


@pytest.mark.parametrize("block_rows", [2, imi.BLOCK_ROWS])
def test_a_clique_with_a_satellite_of_smaller_id(spark, block_rows):
    def at(*degrees):
        x = np.zeros((len(degrees), DIM), np.float32)
        x[:, 0], x[:, 1] = np.cos(np.radians(degrees)), np.sin(np.radians(degrees))
        return x

    x = at(0, 30, 60, 64)  # 0.20 is 36.9 degrees
    assert pivots(x, 0.8).tolist() == [0, 0, 2, 2]
    assert {(r.cluster_row, r.row_id) for r in Clusters(frame(spark, x, dirty=False), "row_id", "train", DIM, 0.2, block_rows=block_rows).found.collect()} == {(1, 1), (1, 2), (1, 3)}


def test_a_large_cluster_with_outliers_is_parted(spark, monkeypatch):
    from graftline.llm.clusters import exact_cliques

    monkeypatch.setattr("graftline.llm.clusters.TILE_ROWS", 20)
    x = groups(seed=3, background=40, sizes=(60, 30))
    near = distances(x) <= 0.2
    want = {(int(np.flatnonzero(near[r])[0]), r) for r in range(len(x)) if near[r].sum() > 2}
    rows = spark.createDataFrame([(1, n, [float(v) for v in r], len(x)) for n, r in enumerate(x)], "cluster long, row long, vec array<float>, size long")
    assert {(r.cluster_row, r.row_id) for r in exact_cliques(rows, DIM, 0.2).collect()} == want


@pytest.mark.parametrize("seed", range(3))
def test_cliques_do_not_depend_on_the_tiles(spark, monkeypatch, seed):
    from graftline.llm.clusters import exact_cliques

    rng = np.random.default_rng(seed)
    x = groups(seed=seed, background=30, sizes=(25, 12, 6), noise=0.35)
    x = np.concatenate([x, x[:10], rng.standard_normal((20, DIM)) * 0.2 + x[:20]]).astype(np.float32)  # overlapping sets and copies
    rows = spark.createDataFrame([(1, n, [float(v) for v in r], len(x)) for n, r in enumerate(x)], "cluster long, row long, vec array<float>, size long")
    found = []
    for tile in (7, 30, 5000):
        monkeypatch.setattr("graftline.llm.clusters.TILE_ROWS", tile)
        found.append({(r.cluster_row, r.row_id) for r in exact_cliques(rows, DIM, 0.2).collect()})
    assert found[0] == found[1] == found[2] != set()
    near = distances(x) <= 0.2
    for head in {h for h, _ in found[0]}:
        m = [r for h, r in found[0] if h == head]
        assert len(m) > 2 and near[np.ix_(m, m)].all() and head == min(m)


def test_all_found_rows_pass_through_the_flow(spark):
    from graftline.llm.clusters import similarity_graph

    df = frame(spark, groups())
    c = Clusters(df, "row_id", "train", DIM, 0.2)
    members, edges = similarity_graph(df, "row_id", "train", DIM, 0.2)
    flows = markov_clusters(edges, members.select("pivot").withColumnRenamed("pivot", "node"))
    passed = {r.row for r in members.collect()} | {r.node for r in flows.collect()}
    assert {r.row_id for r in c.found.collect()} <= passed
    assert {r.pivot for r in members.collect()} <= {r.node for r in flows.collect()}


def test_pairs_in_doubt_are_settled_by_the_stored_vectors(spark):
    from graftline.llm.neighbours import nearest_pairs

    rng = np.random.default_rng(4)
    base = rng.standard_normal((30, DIM))
    x = np.repeat(base, 12, axis=0) * rng.uniform(1, 5, (360, 1))  # scaled copies, apart by rounding only
    x = (x + 1e-6 * rng.standard_normal(x.shape)).astype(np.float32)
    got = {(r.row, r.other) for r in nearest_pairs(frame(spark, x), "row_id", "train", DIM, 5, 0.2, probes=64, margin=9.0).collect()}
    assert got == truth(x, 5, 0.2)


def test_recall_without_radius_in_a_hundred_dimensions(spark):
    from graftline.session import table

    df = table(spark, "/root/testdata/sf0.1", "glove_100_angular").filter("row_id % 5 = 0")
    rows = df.toArrow()
    at, x = imi.vectors_of(rows.column("train"), 100)
    ids, u = rows.column("row_id").to_numpy()[at], imi.unit(x)
    order = np.argsort(ids)
    ids, u = ids[order], u[order]
    got = {(r.row, r.other) for r in nearest(df, "row_id", "train", 100, 5).collect()}
    want = set()
    for r in range(0, len(u), 10):
        d = np.round(1 - u @ u[r], 9)
        d[r] = 9
        want |= {(int(ids[r]), int(ids[c])) for c in np.lexsort((ids, d))[:5]}
    assert len(got & want) >= 0.9 * len(want)


def test_empty_and_unusable(spark):
    none = frame(spark, np.empty((0, DIM), np.float32))
    for df in (none, none.limit(0)):
        found = nearest(df.filter("row_id is not null"), "row_id", "train", DIM, 5).collect()
        assert found == [] and Clusters(df.filter("row_id is not null"), "row_id", "train", DIM, 0.2).found.collect() == []


def test_markov_clusters_part_a_bridge(spark):
    edges = [(a, b, 1.0) for s in (0, 10) for a in range(s, s + 5) for b in range(a + 1, s + 5)] + [(4, 10, 0.2), (30, 31, 1.0), (30, 30, 1.0), (1, None, 1.0)]
    rows = markov_clusters(spark.createDataFrame(edges, "a long, b long, w double")).collect()
    label = {r.node: r.cluster for r in rows}
    assert len({label[k] for k in range(5)}) == 1 and len({label[k] for k in range(10, 15)}) == 1
    assert label[0] != label[10] and label[30] == label[31] and len(label) == 12


def test_cliques_and_pivots():
    near = np.zeros((7, 7), bool)
    for a, b in [(0, 1), (1, 2), (0, 2), (2, 3), (4, 5), (5, 6), (4, 6)]:
        near[a, b] = near[b, a] = True
    assert [c.tolist() for c in cliques(near)] == [[0, 1, 2], [4, 5, 6]]
    x = np.array([[1, 0], [0, 1], [1, 0.01], [0.01, 1]], np.float32)
    assert pivots(x, 0.9).tolist() == [0, 1, 0, 1]


def adjacency(n, edges):
    near = np.zeros((n, n), bool)
    for a, b in edges:
        near[a, b] = near[b, a] = True
    return near


def test_a_hub_does_not_take_a_row_from_a_clique():
    near = adjacency(7, [(0, 1), (0, 4), (0, 5), (0, 6), (1, 2), (1, 3), (2, 3)])
    assert [c.tolist() for c in cliques(near)] == [[1, 2, 3]]


def test_the_largest_clique_is_taken_first():
    rng = np.random.default_rng(5)
    for _ in range(20):
        near = np.triu(rng.random((14, 14)) < 0.5, 1)
        near |= near.T
        sets = [m for m in range(1 << 14) if m.bit_count() > 2]
        rows = [int(sum(1 << int(c) for c in np.flatnonzero(r))) for r in near]
        most = max((m.bit_count() for m in sets if all(m & ~(1 << v) & ~rows[v] == 0 for v in range(14) if m >> v & 1)), default=0)
        found = cliques(near)
        assert max((len(c) for c in found), default=0) == most
        assert all(near[np.ix_(c, c)].sum() == len(c) * (len(c) - 1) for c in found)


def test_a_clique_with_a_hub_isnt_cut_by_degree(spark, monkeypatch):
    from graftline.llm.clusters import exact_cliques

    monkeypatch.setattr("graftline.llm.clusters.TILE_ROWS", 10)
    x = np.zeros((19, 20), np.float32)
    x[:8, 0], x[8:16, 1] = 1, 1  # two cliques of 8
    x[16:, 2] = 1  # and one of 3, of which a row is near all of the first
    x[16, 0], x[17, 0], x[18, 0] = 1.35, 0.3, 0.3
    near = distances(x) <= 0.2
    assert near[16].sum() == 11 and near[17].sum() == 3
    rows = spark.createDataFrame([(1, n, [float(v) for v in r], len(x)) for n, r in enumerate(x)], "cluster long, row long, vec array<float>, size long")
    got = {}
    for r in exact_cliques(rows, 20, 0.2).collect():
        got.setdefault(r.cluster_row, set()).add(r.row_id)
    assert got == {0: {*range(8), 16}, 8: set(range(8, 16))}


def test_layout_cuts_only_full_cells():
    rng = np.random.default_rng(0)
    index = imi.MultiIndex(8, rng.standard_normal((6, 4)).astype(np.float32), rng.standard_normal((6, 4)).astype(np.float32))
    count = rng.integers(0, 30, 36)
    count[7] = 1000
    index.lay_out(count, 100)
    used = np.flatnonzero(count)
    assert (index.block[used] >= 0).all()
    size = np.bincount(index.block[used], count[used])
    assert all(s <= 100 or (index.block[used] == b).sum() == 1 for b, s in enumerate(size))
    assert index.shards[index.block[7]] == 10
    visits = list(index.visits(rng.standard_normal((5, 8)), 6, 9.0))
    assert all(len(v) == len(set(v)) <= 6 and all(count[c] for c in v) for v in visits)
