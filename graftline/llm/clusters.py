"""Similarity clusters of vectors by Markov clustering.

1. *Graph.* Rows visit the cells of an inverted multi-index. In each cell, rows join the first pivot (by id)
   within the radius, so a dense group shrinks to few pivots; links of the rows, at home or visiting, are carried
   over to the pivots. The similarity graph has pivots as nodes; its size doesn't depend on how many rows a pivot stands for.
2. *Markov clustering.* The column-stochastic flow matrix is squared as a sparse self-join, inflated, pruned
   of small entries and normalised, until columns no longer change. The row that receives a column's
   flow is its attractor; attractor rows define the clusters.
   A pivot without edges is a node with a loop.
3. *Exact check.* In each cluster every distance is computed from the stored vectors. A cluster of which
   all pairs are within the radius stays; of any other its cliques are taken, largest first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from graftline.llm import imi
from graftline.session import materialize, parallelism

PROBES = 16
MARGIN = 0.045
CHUNK = 1024
TILE_ROWS = 4096  # larger clusters are checked in tiles of so many rows; no result depends on it
INFLATION = 2.0
PRUNE = 1e-3  # share of the column's largest entry
MAX_ROUNDS = 40
MAX_STEPS = 20_000  # of the search for a larger clique, where cliques overlap
BITS = 8  # of the vectors that the graph is made from; the check reads the stored ones
LOOSE = 5e-3  # more than the error of their cosines


def pivots(x: np.ndarray, least: float) -> np.ndarray:
    """For each row (in order of id) the position of its pivot: the first pivot within reach, or itself."""
    own = np.arange(len(x))
    chosen: list[np.ndarray] = []
    for s in range(0, len(x), CHUNK):
        part = x[s : s + CHUNK]
        free = np.ones(len(part), bool)
        if chosen:
            known = np.concatenate(chosen)
            for t in range(0, len(known), 8 * CHUNK):
                near = part @ x[known[t : t + 8 * CHUNK]].T >= least
                hit = near.any(axis=1) & free
                own[s + np.flatnonzero(hit)] = known[t + near[hit].argmax(axis=1)]
                free &= ~hit
        rest = np.flatnonzero(free)
        near = part[rest] @ part[rest].T >= least
        new = near.sum(axis=1) == 1  # alone; the others are taken in turn
        left = ~new
        for r in np.flatnonzero(left):
            if left[r]:
                new[r] = True
                mine = near[r] & left
                own[s + rest[mine]] = s + rest[r]
                left &= ~mine
        chosen.append(s + rest[new])
    return own


def link_block(b: imi.Block, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``kind, row, pivot, sim`` of a task: 0 joins a row to its pivot, 1 links a row to the pivot of another."""
    x = b.x.astype(np.float32)
    x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    out: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
    low, high = b.pair

    def link(rows: np.ndarray, entries: np.ndarray, own: np.ndarray, heads: np.ndarray | None = None) -> None:
        """Links of rows to the pivots of the entries; with ``heads``, the rows' own pivots, between pivots only."""
        order = np.argsort(own, kind="stable")
        targets, starts = np.unique(own[order], return_index=True)
        step = max(1, 4_000_000 // max(1, len(entries)))
        for s in range(0, len(rows), step):
            part = rows[s : s + step]
            best = np.maximum.reduceat(x[part] @ x[entries[order]].T, starts, axis=1)
            r, c = np.nonzero(best >= least)
            if heads is None:
                out.append((1, b.ids[part[r]], b.ids[entries[targets[c]]], best[r, c]))
                continue
            p, q, sim = heads[s : s + step][r], entries[targets[c]], best[r, c]
            p, q, sim = p[p != q], q[p != q], sim[p != q]
            if len(p):  # each pair of pivots once, at its best
                by = np.lexsort((q, p))
                p, q = p[by], q[by]
                first = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (q[1:] != q[:-1])])
                out.append((1, b.ids[p[first]], b.ids[q[first]], np.maximum.reduceat(sim[by], first)))

    for cell, rows in b.at.items():
        mine = rows[b.shard[rows] == low]
        own = pivots(x[mine], least)
        if low == high:
            joined = np.flatnonzero(own != np.arange(len(mine)))
            if len(joined):
                sims = np.einsum("ij,ij->i", x[mine[joined]], x[mine[own[joined]]])
                out.append((0, b.ids[mine[joined]], b.ids[mine[own[joined]]], sims))
                link(mine, mine, own, mine[own])
            if cell in b.visiting:
                link(b.visiting[cell], mine, own)
            continue
        others = rows[b.shard[rows] == high]
        link(others, mine, own, others[pivots(x[others], least)])
    if not out:
        none = np.empty(0, np.int64)
        return none, none, none, np.empty(0)
    kind = np.concatenate([np.full(len(r), k, np.int64) for k, r, _, _ in out])
    return kind, *(np.concatenate([o[n] for o in out]) for n in (1, 2, 3))


def similarity_graph(df: DataFrame, row_id: str, vector: str, dim: int, radius: float, probes: int = PROBES, margin: float = MARGIN, seed: int = 0, block_rows: int = imi.BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """``members(row, pivot, sim)`` of all rows but pivots, and ``edges(a, b, w)`` between pivots, a < b."""
    spark = df.sparkSession
    index = imi.build(df, row_id, vector, dim, seed, block_rows)
    if index is None:
        return spark.createDataFrame([], "row long, pivot long, sim double"), spark.createDataFrame([], "a long, b long, w double")
    least = 1 - radius - LOOSE

    def links(key, t):
        cols = link_block(imi.open_block(t, dim, index.shards, BITS), least)
        return pa.table([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["kind", "row", "pivot", "sim"])

    sent = imi.send(df, row_id, vector, index, probes, margin, BITS).repartition(index.tasks(parallelism(spark)), "grp")
    raw = sent.groupBy("grp").applyInArrow(links, "kind long, row long, pivot long, sim double")
    raw = materialize(raw, "links")
    members = raw.filter("kind = 0").groupBy("row").agg(F.min("pivot").alias("pivot"), F.max("sim").alias("sim"))
    found = raw.filter("kind = 1").alias("l").join(members.alias("m"), F.col("l.row") == F.col("m.row"), "left")
    ends = found.select(F.coalesce("m.pivot", "l.row").alias("p"), F.col("l.pivot").alias("q"), F.col("l.sim").alias("w")).filter("p <> q")
    edges = ends.groupBy(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).agg(F.max("w").alias("w"))
    return members, edges


def markov_clusters(edges: DataFrame, nodes: DataFrame | None = None, inflation: float = INFLATION, prune: float = PRUNE, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """``node, cluster, flow`` of every node of a weighted graph ``a, b, w`` and of ``nodes(node)`` beside it.

    ``cluster`` is the attractor row that gets most of the node's flow (ties to the smaller id) and ``flow`` the
    flow that the node itself receives. Edges count in both directions, repeated ones once at the largest
    weight; nulls and weights that aren't positive are left out. Every node gets a loop of its largest weight, a
    node without edges one of weight 1. Columns that still change after ``max_rounds`` are an error.

    The flow is partitioned by column, so that the sums of a round and its windows share one exchange.
    """
    good = edges.filter("a is not null and b is not null and a <> b and w > 0 and not isnan(w)")
    both = good.select(F.col("a").alias("col"), F.col("b").alias("row"), "w").unionByName(good.select(F.col("b").alias("col"), F.col("a").alias("row"), "w"))
    if nodes is not None:
        both = both.unionByName(nodes.filter("node is not null").select(F.col("node").alias("col"), F.col("node").alias("row"), F.lit(None).cast("double").alias("w")))
    column = Window.partitionBy("col")
    once = both.repartition("col").groupBy("col", "row").agg(F.max("w").alias("v"))
    links = once.filter("col <> row")
    loops = once.groupBy("col").agg(F.coalesce(F.max("v"), F.lit(1.0)).alias("v")).select("col", F.col("col").alias("row"), "v")
    flow = links.unionByName(loops).repartition("col").withColumn("v", F.col("v") / F.sum("v").over(column))
    flow = materialize(flow, "flow")
    worst = None
    for _ in range(max_rounds):
        left = flow.select(F.col("col").alias("mid"), F.col("row"), F.col("v").alias("x"))
        right = flow.select(F.col("row").alias("mid"), F.col("col"), F.col("v").alias("y"))
        square = left.join(right, "mid").select("col", "row", (F.col("x") * F.col("y")).alias("xy")).repartition("col").groupBy("col", "row").agg(F.sum("xy").alias("v"))
        raised = square.withColumn("v", F.pow("v", F.lit(inflation)))
        kept = raised.withColumn("most", F.max("v").over(column)).filter(F.col("v") >= prune * F.col("most"))
        share = kept.select("col", "row", (F.col("v") / F.sum("v").over(column)).alias("v"))
        open_ = share.withColumn("open", F.max("v").over(column) - F.sum(F.col("v") * F.col("v")).over(column))
        seen = Observation()
        flow = materialize(open_.observe(seen, F.max("open").alias("open")), "flow").drop("open")
        worst = seen.get["open"]
        if worst is None or worst < 1e-3:
            break
    else:
        raise RuntimeError(f"columns still change by {worst} after {max_rounds} rounds")
    # equal shares differ in their last digits, so they are compared in seven
    value = F.round("v", 7)
    rank = Window.partitionBy("col").orderBy(value.desc(), "row")
    to = flow.withColumn("rn", F.row_number().over(rank)).filter("rn = 1").select(F.col("col").alias("node"), F.col("row").alias("head"))
    heads = to.select(F.col("node").alias("head"), F.col("head").alias("cluster"))
    gets = flow.groupBy(F.col("row").alias("node")).agg(F.sum("v").alias("flow"))
    named = to.join(heads, "head", "left").select("node", F.coalesce("cluster", "head").alias("cluster"))
    return named.join(gets, "node", "left").withColumn("flow", F.coalesce("flow", F.lit(0.0)))


def _grown(near: np.ndarray, weight: np.ndarray, start: int) -> list[int]:
    """The clique grown from ``start`` by the weight of the neighbours among the nodes that can still join."""
    can, got = near[start].copy(), [start]
    inside = weight[can] @ near[can]
    while can.any():
        nxt = int(np.where(can, inside + weight, -1).argmax())
        got.append(nxt)
        gone = can & ~near[nxt]
        inside = inside - weight[gone] @ near[gone]
        can &= near[nxt]
    return got


def _larger(near: np.ndarray, weight: np.ndarray, least: int) -> list[int]:
    """A heaviest clique of more than ``least``, by branch and bound with greedy colouring, or nothing. After
    ``MAX_STEPS`` the heaviest so far."""
    adjacent = [int.from_bytes(np.packbits(r, bitorder="little").tobytes(), "little") for r in near]
    heavy = weight.tolist()

    def coloured(rows: int) -> list[tuple[int, int]]:
        """Nodes with a bound on the weight of a clique among them and those before."""
        out, bound = [], 0
        while rows:
            free, top = rows, 0
            first = len(out)
            while free:
                v = (free & -free).bit_length() - 1
                rows &= ~(1 << v)
                free &= ~(1 << v) & ~adjacent[v]
                top = max(top, heavy[v])
                out.append((v, 0))
            bound += top
            out[first:] = [(v, bound) for v, _ in out[first:]]
        return out

    everything = (1 << len(near)) - 1
    stack, got, best, size, most = [[coloured(everything), everything]], [], [], 0, least
    for _ in range(MAX_STEPS):
        while stack and (not stack[-1][0] or size + stack[-1][0][-1][1] <= most):
            stack.pop()
            if got:
                size -= heavy[got.pop()]
        if not stack:
            break
        v, _ = stack[-1][0].pop()
        rows = stack[-1][1]
        stack[-1][1] = rows & ~(1 << v)
        got.append(v)
        size += heavy[v]
        if size > most:
            best, most = list(got), size
        stack.append([coloured(rows & adjacent[v]), rows & adjacent[v]])
    return best


def _largest(near: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Positions of a heaviest clique; nodes with too light a neighbourhood are dropped before the search."""
    best = _grown(near, weight, int((near @ weight + weight).argmax()))
    size = int(weight[best].sum())
    core = np.ones(len(near), bool)
    while True:
        fewer = core & ((near & core) @ weight + weight > size)
        if fewer.sum() == core.sum():
            break
        core = fewer
    at = np.flatnonzero(core)
    if len(at):
        inner = near[np.ix_(at, at)]
        by = np.argsort(-(inner @ weight[at]), kind="stable")
        better = _larger(inner[np.ix_(by, by)], weight[at[by]], size)
        if better:
            best = at[by[better]]
    return np.sort(np.array(best))


def cliques(near: np.ndarray, weight: np.ndarray | None = None) -> list[np.ndarray]:
    """Positions of cliques that weigh at least 3, of each connected part the heaviest first, which is then removed.

    A node stands for ``weight`` rows near each other (1 by default). Edges of no triangle belong to no such
    clique and are dropped first, so cliques that share no row are the connected parts of the rest. Ties go to
    the earlier node."""
    weight = np.ones(len(near), np.int64) if weight is None else weight
    out, pending = [], [np.arange(len(near))]
    while pending:
        rows = pending.pop()
        some, w = near[np.ix_(rows, rows)], weight[rows]
        flat = some.astype(np.float32)
        for s in range(0, len(rows), CHUNK):
            some[s : s + CHUNK] &= (flat[s : s + CHUNK] @ flat > 0) | (w[s : s + CHUNK, None] + w >= 3)
        left = some.any(axis=1) | (w >= 3)
        while left.any():
            part = np.zeros(len(rows), bool)
            fresh = np.array([int(left.argmax())])
            while len(fresh):
                part[fresh] = True
                fresh = np.flatnonzero(some[fresh].any(axis=0) & ~part)
            left &= ~part
            at = np.flatnonzero(part)
            inner = some[np.ix_(at, at)]
            if inner.sum() == len(at) * (len(at) - 1):
                out.append(rows[at])
                continue
            got = _largest(inner, w[at])
            if w[at[got]].sum() >= 3:
                out.append(rows[at[got]])
                pending.append(np.delete(rows[at], got))
    return sorted(out, key=lambda c: int(c[0]))


def _near(u: np.ndarray, v: np.ndarray, radius: float) -> np.ndarray:
    """Whether the cosine distance, rounded to nine decimals, is within the radius."""
    return np.round(1 - u @ v.T, 9) <= radius


def twins(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the first row of each set of rows with the same neighbours (themselves among them), and the set
    of every row. Such rows are near each other and belong to the same cliques."""
    packed = np.packbits(near, axis=1)
    _, first, of = np.unique(np.ascontiguousarray(packed).view(np.dtype((np.void, packed.shape[1]))).ravel(), return_index=True, return_inverse=True)
    by = np.argsort(first)
    place = np.empty(len(by), np.int64)
    place[by] = np.arange(len(by))
    return first[by], place[of]


def _solve(radius: float, dim: int):
    """``row, head`` of the cliques among the nodes of a partition sorted by cluster. A node stands for ``weight`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(t: pa.Table) -> pa.RecordBatch:
            t = t.sort_by("row").combine_chunks()
            at, x = imi.vectors_of(t.column("vec"), dim)
            u, ids, weight = imi.unit(x), t.column("row").to_numpy()[at], t.column("weight").to_numpy()[at]
            near = np.concatenate([_near(u[s : s + CHUNK], u, radius) for s in range(0, len(u), CHUNK)]) if len(u) else np.zeros((0, 0), bool)
            np.fill_diagonal(near, True)
            while len(ids) and (thin := near @ weight < 3).any():  # of no clique of 3
                keep = np.flatnonzero(~thin)
                near, ids, weight = near[np.ix_(keep, keep)], ids[keep], weight[keep]
            if near.all():
                first, of = np.zeros(min(1, len(ids)), np.int64), np.zeros(len(ids), np.int64)
            else:
                first, of = twins(near)
            near = near[np.ix_(first, first)]
            np.fill_diagonal(near, False)
            total = np.bincount(of, weight, len(first)).astype(np.int64)
            head = np.full(len(first), -1, np.int64)
            for c in cliques(near, total):
                head[c] = c[0]
            kept = np.flatnonzero(head[of] >= 0)
            return pa.RecordBatch.from_arrays([pa.array(ids[kept]), pa.array(ids[first[head[of[kept]]]])], names=["row", "head"])

        held: list[pa.Table] = []
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            cluster = b.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(cluster[1:] != cluster[:-1]) + 1).tolist(), len(cluster)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if held and cluster[lo] != last:
                    yield solve(pa.concat_tables(held))
                    held = []
                held.append(t.slice(lo, hi - lo))
                last = cluster[lo]
        if held:
            yield solve(pa.concat_tables(held))

    return run


def _signatures(rows: DataFrame, dim: int, radius: float) -> DataFrame:
    """``cluster, row, degree, s0..s3`` of clusters too large for one task. Rows go to the pairs of tiles that they
    belong to; each adds up the hashes of its neighbours and itself, 20 bits in each of four sums, so rows with equal sums have
    the same neighbours."""
    counted = rows.withColumn("tiles", F.ceil(F.col("size") / TILE_ROWS).cast("int")).withColumn("tile", F.pmod(F.xxhash64("row"), F.col("tiles")).cast("int"))
    paired = counted.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    hashes = [F.shiftright(F.xxhash64("row", F.lit(n // 2)), 20 * (n % 2)).bitwiseAND(F.lit((1 << 20) - 1)).cast("double").alias(f"h{n}") for n in range(4)]
    paired = paired.select("cluster", F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi"), "tile", "row", *hashes, "vec")

    def sums(key, t):
        _, lo, hi = (k.as_py() for k in key)
        at, x = imi.vectors_of(t.column("vec"), dim)
        u, tile, ids = imi.unit(x), t.column("tile").to_numpy()[at], t.column("row").to_numpy()[at]
        value = np.column_stack([np.ones(len(ids)), *(t.column(f"h{n}").to_numpy()[at] for n in range(4))])
        a, b = np.flatnonzero(tile == lo), np.flatnonzero(tile == hi)
        total = np.zeros((len(ids), 5))
        for s in range(0, len(a), CHUNK):
            near = _near(u[a[s : s + CHUNK]], u[b], radius)
            if lo == hi:
                near[np.arange(len(near)), np.arange(s, s + len(near))] = True
            near = near.astype(np.float64)
            total[a[s : s + CHUNK]] += near @ value[b]
            if lo != hi:
                total[b] += near.T @ value[a[s : s + CHUNK]]
        return pa.table([pa.array([key[0].as_py()] * len(ids), pa.int64()), pa.array(ids, pa.int64()), *(pa.array(c) for c in total.T)], names=["cluster", "row", "degree", "s0", "s1", "s2", "s3"])

    schema = "cluster long, row long, degree double, s0 double, s1 double, s2 double, s3 double"
    found = paired.groupBy("cluster", "lo", "hi").applyInArrow(sums, schema)
    return found.groupBy("cluster", "row").agg(*[F.sum(c).alias(c) for c in ("degree", "s0", "s1", "s2", "s3")])


def exact_cliques(rows: DataFrame, dim: int, radius: float) -> DataFrame:
    """``cluster_row, row_id`` of the cliques in the clusters of ``rows(cluster, row, vec, size)``.

    Rows of a cluster with the same neighbours are one node, so a clique with whatever is attached to it is a few
    nodes, which one task solves (``cliques``). A cluster up to ``TILE_ROWS`` finds its nodes in that task, a
    larger one in tiles; the nodes and with them the result are the same either way.
    """
    spark = rows.sparkSession
    sized = materialize(rows.select("cluster", "row", "vec", "size"), "clusters")
    solve, schema = _solve(radius, dim), "row long, head long"

    def solved(nodes: DataFrame) -> DataFrame:
        return nodes.select("cluster", "row", "weight", "vec").repartition(parallelism(spark), "cluster").sortWithinPartitions("cluster").mapInArrow(solve, schema)

    few = solved(sized.filter(F.col("size") <= TILE_ROWS).withColumn("weight", F.lit(1).cast("long"))).select(F.col("head").alias("cluster_row"), F.col("row").alias("row_id"))
    large = sized.filter(F.col("size") > TILE_ROWS)
    if large.isEmpty():
        return few
    sums = ["s0", "s1", "s2", "s3"]
    signed = materialize(_signatures(large, dim, radius).filter("degree >= 3"), "signatures")
    nodes = signed.groupBy("cluster", *sums).agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("weight"))
    nodes = materialize(nodes, "nodes")
    heads = materialize(solved(large.select("row", "vec").join(nodes.select("cluster", "row", "weight"), "row")), "heads")
    many = signed.join(nodes.join(heads, "row").select("cluster", *sums, "head"), ["cluster", *sums])
    return few.unionByName(many.select(F.col("head").alias("cluster_row"), F.col("row").alias("row_id")))


class Clusters:
    """Clusters of at least 3 vectors, any two of them within cosine distance ``radius``.

    ``found``: ``cluster_row, row_id``, a row per member; ``cluster_row`` is the smallest id of the cluster.
    ``described``: a row per cluster with its size and the ``row_id`` of its most typical members.
    Vectors of another length, with null, NaN or infinite elements or of zeros only, and null ids are left
    out; ids must be unique whole numbers; other columns are ignored; an empty table gives no clusters. Where
    the sets of mutually near vectors overlap, a vector goes to the largest set first grown (``cliques``).
    """

    def __init__(self, df: DataFrame, row_id: str, vector: str, dim: int, radius: float, probes: int = PROBES, margin: float = MARGIN, seed: int = 0, block_rows: int = imi.BLOCK_ROWS):
        members, edges = similarity_graph(df, row_id, vector, dim, radius, probes, margin, seed, block_rows)
        members = materialize(members, "members")
        # every pivot that stands for others is a node, with or without edges, so all rows with a neighbour pass through the flow
        flows = materialize(markov_clusters(materialize(edges, "edges"), members.select(F.col("pivot").alias("node"))), "clusters")
        rows = members.unionByName(flows.select(F.col("node").alias("row"), F.col("node").alias("pivot"), F.lit(1.0).alias("sim")))
        rows = rows.join(flows, rows["pivot"] == flows["node"])
        self.rows = materialize(rows.select("cluster", "row", "flow", "sim"), "labels")
        sizes = self.rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")).filter("size > 2")
        labels = materialize(self.rows.join(sizes, "cluster").select("cluster", "row", "size"), "sized")
        vectors = imi.only(df, row_id, vector, labels, dim)
        self.found = exact_cliques(labels.join(vectors, "row"), dim, radius)

    def described(self, typical: int = 3) -> DataFrame:
        """``cluster_row, size, typical``: members by the flow that their pivot receives, then by closeness to
        it, then by id."""
        found = materialize(self.found, "found").join(self.rows, F.col("row_id") == F.col("row"))
        order = Window.partitionBy("cluster_row").orderBy(F.round("flow", 6).desc(), F.round("sim", 6).desc(), "row_id")
        first = found.withColumn("rn", F.row_number().over(order)).withColumn("one", F.when(F.col("rn") <= typical, F.struct("rn", "row_id")))
        out = first.groupBy("cluster_row").agg(F.count(F.lit(1)).alias("size"), F.sort_array(F.collect_list("one")).alias("some"))
        return out.select("cluster_row", "size", F.col("some.row_id").alias("typical"))
