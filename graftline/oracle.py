"""DuckDB SQL for the core queries."""

from __future__ import annotations

import numpy as np

from graftline.functions.families import E2LSH, PRIME, CrossPolytope, Family, SimHash, minhash_factors
from graftline.operators.sets import BLANKS
from graftline.queries import ALIKE, CLOSEST, CROSS, DELTA, DIM, E2, E2_TREE, GLOVE, LSH_PREFIX, PARTS, SIM, SIM_TREE, WORDS

USABLE = "edge1 is not null and edge2 is not null and edge1 <> edge2 and distance >= 0 and distance <= 2"

SQL = {
    "p4_keys": f"""
        select i, j, count(*)::bigint n_lines,
               count(distinct case when edge1 is not null and edge2 is not null then (edge1, edge2) end)::bigint n_pairs,
               round(avg(case when {USABLE} then distance end) + 1e-10::double, 6) mean_distance
        from glove_sampl where i is not null and j is not null group by i, j""",
    "p4_found": """
        with k as (select i, j, count(*) n from glove_sampl where i is not null and j is not null group by i, j)
        select i, j from k where n > 0.015 * (select sum(n) from k)""",
    "p4_above_mean": f"""
        with l as (select * from glove_sampl where i is not null and j is not null and {USABLE}),
        m as (select i, j, round(avg(distance) + 1e-10::double, 6) m from l group by i, j)
        select l.i, l.j, sum((l.distance > m.m)::bigint)::bigint n_above from l join m on l.i = m.i and l.j = m.j group by l.i, l.j""",
}


def plane_rows(family: Family) -> str:
    """Projections of a family as a table ``(rep, k, a, b)``."""
    shift = family.offsets if isinstance(family, E2LSH) else np.zeros((family.repetitions, family.depth))
    rows = []
    for rep in range(family.repetitions):
        for k in range(family.depth):
            numbers = ",".join(repr(float(v)) for v in family.planes[rep, k])
            rows.append(f"({rep}, {k}, '[{numbers}]'::double[], '{float(shift[rep, k])!r}'::double)")
    return "(values " + ",\n".join(rows) + ") t(rep, k, a, b)"


def codes_sql(family: Family, where: str = "true", source: str = "embeddings") -> str:
    """``vec_id, rep, code`` of the embeddings or another table of points."""
    product = "list_inner_product(p.embedding::double[], t.a)"
    symbol = f"(floor(({product} + t.b) / {family.width}))::bigint" if isinstance(family, E2LSH) else f"({product} >= 0)::bigint"
    return f"select p.vec_id, t.rep, list({symbol} order by t.k) code from {source} p, {plane_rows(family)} where {where} group by p.vec_id, t.rep"


def cross_codes_sql(family: CrossPolytope) -> str:
    rows = []
    for rep in range(family.repetitions):
        for k in range(family.depth):
            for axis in range(family.axes):
                numbers = ",".join(repr(float(v)) for v in family.rotations[rep, k, axis])
                rows.append(f"({rep}, {k}, {axis}, '[{numbers}]'::double[])")
    values = "(values " + ",\n".join(rows) + ") t(rep, k, axis, a)"
    return f"""
        with y as (select p.vec_id, t.rep, t.k, t.axis, list_inner_product(p.embedding::double[], t.a) y from embeddings p, {values}),
        s as (select vec_id, rep, k, arg_min(2 * axis + (y < 0)::bigint, (-abs(y), axis)) s from y group by vec_id, rep, k)
        select vec_id, rep, array_to_string(list(s order by k), ',') code from s group by vec_id, rep"""


DISTANCE = {
    "euclidean": "list_distance(a.embedding::double[], b.embedding::double[])",
    "cosine": "1 - list_cosine_similarity(a.embedding::double[], b.embedding::double[])",
    "angular": "acos(greatest(-1, least(1, list_cosine_similarity(a.embedding::double[], b.embedding::double[]))))",
}


def pairs_sql(name: str, extra: str = "true") -> str:
    return f"select a.vec_id i, b.vec_id j, {DISTANCE[name]} w from embeddings a join embeddings b on a.vec_id < b.vec_id and {extra}"


def boruvka(edges: str, vertices: str, rounds: int = 11) -> str:
    """CTEs after which ``tree(i, j, w)`` and ``labels(v, c)`` exist, c being the least vertex of the component."""
    parts = [f"e as materialized ({edges})", f"c0 as materialized (select v, v c from ({vertices}))"]
    for r in range(rounds):
        parts.append(
            f"""m{r} as materialized (
            select c, min((w, i, j)) e, arg_min(o, (w, i, j)) o from (
                select a.c, b.c o, e.w, e.i, e.j from e join c{r} a on e.i = a.v join c{r} b on e.j = b.v where a.c <> b.c
                union all select b.c, a.c, e.w, e.i, e.j from e join c{r} a on e.i = a.v join c{r} b on e.j = b.v where a.c <> b.c)
            group by c)"""
        )
        parts.append(f"p{r}_0 as materialized (select m.c, case when n.o = m.c and m.c < m.o then m.c else m.o end p from m{r} m left join m{r} n on n.c = m.o)")
        for d in range(rounds):
            parts.append(f"p{r}_{d + 1} as materialized (select a.c, coalesce(b.p, a.p) p from p{r}_{d} a left join p{r}_{d} b on a.p = b.c)")
        parts.append(f"c{r + 1} as materialized (select c.v, coalesce(p.p, c.c) c from c{r} c left join p{r}_{rounds} p on c.c = p.c)")
    union = " union ".join(f"select e from m{r}" for r in range(rounds))
    parts.append(f"tree as materialized (select e[2] i, e[3] j, e[1] w from ({union}))")
    parts.append(f"labels as materialized (select v, min(v) over (partition by c) c from c{rounds})")
    return ",\n".join(parts)


ALL = "select vec_id v from embeddings"
EDGES = "select i, j, round(w, 6) w from tree"


def mst(name: str) -> str:
    return f"with {boruvka(pairs_sql(name), ALL)} {EDGES}"


SIM_CODES = f"codes as materialized ({codes_sql(SIM)})"


def prefix_join(prefix: int) -> str:
    return f"from codes a join codes b on a.rep = b.rep and a.vec_id < b.vec_id and a.code[1:{prefix}] = b.code[1:{prefix}]"


def lcp_sql(depth: int) -> str:
    same = " + ".join(f"(a.code[1:{k}] = b.code[1:{k}])::int" for k in range(1, depth + 1))
    return f"({same})"


LCP = f"select a.vec_id i, b.vec_id j, max({lcp_sql(SIM.depth)})::integer lcp {prefix_join(LSH_PREFIX)} group by 1, 2"
SIM_P = "(1 - acos(greatest(-1, least(1, 1 - {d}))) / pi())"
FULL_EDGES = f"select distinct a.vec_id i, b.vec_id j, 0.0 w {prefix_join(SIM.depth)}"


def fail_sql(p: str, prefix: str, seen: str, total: int, depth: int) -> str:
    return f"case when {prefix} >= {depth} then pow(1 - pow({p}, {prefix}), {seen}) else pow(1 - pow({p}, {prefix}), {seen}) * pow(1 - pow({p}, {prefix} + 1), {total} - {seen}) end"


def erf_sql(x: str) -> str:
    t = f"(1 / (1 + 0.3275911::double * {x}))"
    poly = "0"
    for a in (1.061405429, -1.453152027, 1.421413741, -0.284496736, 0.254829592):
        poly = f"(({poly} + ({a})::double) * {t})"
    return f"(1 - {poly} * exp(-{x} * {x}))"


def e2_sql(d: str, width: float) -> str:
    u = f"({width}::double / {d})"
    return f"case when {d} <= 0 then 1 else {erf_sql(f'({u} / sqrt(2::double))')} - 2 / (sqrt(2 * pi()) * {u}) * (1 - exp(-{u} * {u} / 2)) end"


SPLIT = f"{boruvka(pairs_sql('cosine'), ALL)}, s as (select *, {fail_sql(SIM_P.format(d='w'), '3', '8', SIM.repetitions, SIM.depth)} fail from tree), cs as (select *, fail < {DELTA} confirmed from s)"
BOUND = "b as (select count(*)::bigint n_edges, count(*) filter (where confirmed)::bigint n_confirmed, sum(w) weight, sum(case when confirmed then w else 0 end) + max(case when confirmed then w else 0 end) * count(*) filter (where not confirmed) bound from cs)"


def knn_sql(name: str, k: int, keep_self: bool) -> str:
    other = "true" if keep_self else "a.vec_id <> b.vec_id"
    return f"""
        with r as (select a.vec_id query_id, b.vec_id id, {DISTANCE[name]} dist from embeddings a join embeddings b on {other} where a.vec_id % 50 = 0),
        n as (select *, row_number() over (partition by query_id order by dist, id)::integer as rank from r)
        select query_id, rank, id, round(dist, 6) dist from n where rank <= {k}"""


def knn_lsh_sql(k: int) -> str:
    return f"""
        with {SIM_CODES},
        l as (select a.vec_id q, b.vec_id id, max({lcp_sql(SIM.depth)}) lcp from codes a join codes b on a.rep = b.rep and a.vec_id <> b.vec_id where a.vec_id % 50 = 0 group by 1, 2),
        d as (select l.q, l.id, l.lcp, {DISTANCE['cosine']} dist from l join embeddings a on a.vec_id = l.q join embeddings b on b.vec_id = l.id),
        v as (select d.*, p.prefix, row_number() over (partition by q, prefix order by dist, id) rn from d join range(0, {SIM.depth + 1}) p(prefix) on d.lcp >= p.prefix),
        t as (select q, prefix, count(*) n, max(dist) kth from v where rn <= {k} group by 1, 2),
        f as (select q, max(prefix) prefix from t where prefix = 0 or (n >= {k} and {fail_sql(SIM_P.format(d='kth'), 'prefix', str(SIM.repetitions), SIM.repetitions, SIM.depth)} <= 0.1) group by q)
        select v.q query_id, v.rn::integer as rank, v.id, round(v.dist, 6) dist from v join f on v.q = f.q and v.prefix = f.prefix where v.rn <= {k}"""


BY_TABLE = f"met as (select a.rep, array_to_string(a.code[1:{LSH_PREFIX}], ',') as key, a.vec_id i, b.vec_id j {prefix_join(LSH_PREFIX)}), bt as (select met.*, {DISTANCE['cosine']} w from met join embeddings a on a.vec_id = met.i join embeddings b on b.vec_id = met.j)"

def sets_sql(tokens: str) -> str:
    """Token sets of the documents from the list ``w`` of their words, the classes of equal ones and their representatives."""
    return f"""
    words as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '{BLANKS}'), lambda x: x <> '') w from documents),
    docs as (select doc_id, case when len(w) = 0 then []::varchar[] else list_distinct({tokens}) end tokens from words),
    sets as materialized (select doc_id, list_sort(tokens) tokens from docs where len(tokens) > 0),
    members as materialized (select doc_id, min(doc_id) over (partition by tokens) rep from sets),
    flat as materialized (select doc_id, unnest(tokens) t, len(tokens) n from sets),
    reps as materialized (select flat.* from flat join members m on flat.doc_id = m.doc_id and m.rep = m.doc_id)"""


SETS = sets_sql("list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda k: array_to_string(w[k:k + 4], ' '))")
WORD_SETS = sets_sql("w")


def similar_sql(threshold: float) -> str:
    return f"""
    shared as (select a.doc_id i, b.doc_id j, a.n na, b.n nb, count(*) s from reps a join reps b on a.t = b.t and a.doc_id < b.doc_id group by all),
    near as materialized (select i, j, 1 - s::double / (na + nb - s) w from shared where s >= {threshold} * (na + nb - s) - 1e-9)"""


SIMILAR = similar_sql(0.8)


def minhash_rows(repetitions: int, depth: int, seed: int, source: str) -> str:
    """``doc_id, rep, code`` of the token sets of ``source(doc_id, t)``."""
    factors = ", ".join(f"({n // depth}, {n % depth}, {a}::bigint, {b}::bigint)" for n, (a, b) in enumerate(minhash_factors(repetitions, depth, seed)))
    symbol = f"min((f.a * (('0x' || substr(md5(t), 1, 15))::bigint % {PRIME}) + f.b) % {PRIME})"
    return f"select doc_id, rep, list(s order by k) code from (select doc_id, f.rep, f.k, {symbol} s from {source}, (values {factors}) f(rep, k, a, b) group by all) group by doc_id, rep"


def minhash_sql(repetitions: int, depth: int, seed: int = 42) -> str:
    return f"with {SETS} select doc_id, rep::integer rep, array_to_string(code, ',') code from ({minhash_rows(repetitions, depth, seed, 'flat')})"


PART_POINTS = "pts as materialized (select p_partkey vec_id, [(p_size * 2)::float, (p_retailprice - 900.0::double)::float] embedding from part where p_partkey is not null and p_size is not null and p_retailprice < 'inf'::double)"
GLOVE_POINTS = """pts as materialized (select row_id vec_id, train embedding from glove_100_angular where row_id is not null and len(train) = 100
    and len(list_filter(train, lambda e: e is null or isnan(e) or isinf(e))) = 0 and len(list_filter(train, lambda e: e <> 0)) > 0)"""
EMBEDDED = "pts as materialized (select vec_id, embedding from embeddings)"


def levels_sql(points: str, family: Family, name: str, floor: int, digits: int | None = None) -> str:
    """CTEs after which ``wp(i, j, lcp, w)`` are the pairs with a common prefix of at least ``floor`` and ``lev(p)`` the prefixes from there on."""
    w = DISTANCE[name] if digits is None else f"round({DISTANCE[name]}, {digits}) + 0.0"
    return f"""{points}, codes as materialized ({codes_sql(family, source='pts')}),
        lp as materialized (select a.vec_id i, b.vec_id j, max({lcp_sql(family.depth)}) lcp {prefix_join(floor)} group by 1, 2),
        wp as materialized (select i, j, lcp, {w} w from lp join pts a on a.vec_id = i join pts b on b.vec_id = j),
        lev as (select p from range({floor}, {family.depth + 1}) p(p))"""


def sweep_sql(points: str, family: Family, name: str, floor: int, accept: str) -> str:
    """CTEs after which ``s(p, i, j, w, fail)`` are the trees of all prefixes and ``stop(p)`` is the longest at which the tree spans and the rule holds.

    Points of a prefix are numbered apart, so one search gives the trees of all."""
    far = 10_000_000
    p = SIM_P.format(d="w") if name == "cosine" else f"({e2_sql('w', family.width)})"
    fail = fail_sql(p, "p", str(family.repetitions), family.repetitions, family.depth)
    edges = f"select p * {far} + i i, p * {far} + j j, w from wp join lev on lcp >= p"
    return f"""{levels_sql(points, family, name, floor)}, {boruvka(edges, f'select p * {far} + vec_id v from pts, lev')},
        t as (select i // {far} p, i % {far} i, j % {far} j, w from tree), s as materialized (select *, {fail} fail from t),
        n as (select count(*) n from pts),
        f as (select p, count(*) n_edges, count(*) filter (where fail < 0.1 / n) n_confirmed, max(fail) worst, sum(w) weight, any_value(n) n,
            sum(case when fail < 0.1 / n then w else 0 end) + max(case when fail < 0.1 / n then w else 0 end) * count(*) filter (where fail >= 0.1 / n) bound from s, n group by p),
        stop as (select max(p) p from f where n_edges = n - 1 and {accept})"""


SURE, NEAR = "worst < 0.1 / n", "weight <= 1.2 * bound"
FOUND = "select i::bigint i, j::bigint j, round(w, 6) w, s.p::integer prefix, 'lsh' path from s join stop on s.p = stop.p"


def found_tree(points: str, family: Family, name: str, floor: int, accept: str) -> str:
    return f"with {sweep_sql(points, family, name, floor, accept)} {FOUND}"


CLOSE = f"""
    {levels_sql(GLOVE_POINTS, GLOVE, 'cosine', 5, 9)},
    r as (select p, i, j, w, row_number() over (partition by p order by w, i, j) rn from wp join lev on lcp >= p),
    g as (select p, count(*) n, max(w) w from r where rn <= {CLOSEST} group by p),
    stop as (select max(p) p from g where n = {CLOSEST} and {fail_sql(SIM_P.format(d='w'), 'p', str(GLOVE.repetitions), GLOVE.repetitions, GLOVE.depth)} <= 0.1)"""
SKETCHED = "select count(*)::bigint n_queries, 10 * count(*)::bigint n_true, true enough from embeddings where vec_id % 50 = 0"

PATH = "select vec_id, lead(vec_id) over (order by md5(vec_id || ',0'), vec_id) nxt from embeddings"
VALID = "case when {c}::varchar <> 'nan' then {c} end"  # isnan() is folded away by the column statistics
RUNS = ", ".join(VALID.format(c=c) + f" {c}" for c in ("w0", "w1", "w2"))

SQL |= {
    "exact_mst_euclidean": mst("euclidean"),
    "exact_mst_cosine": mst("cosine"),
    "exact_mst_angular": mst("angular"),
    "exact_mst_weight": f"with {boruvka(pairs_sql('euclidean'), ALL)} select count(*)::bigint n_edges, round(sum(w), 6) weight from tree",
    "mst_by_label": f"with {boruvka(pairs_sql('euclidean', 'a.label = b.label'), ALL)} {EDGES}",
    "all_pairs_euclidean": f"select i, j, round(w, 6) w from ({pairs_sql('euclidean')})",
    "all_pairs_cosine": f"select i, j, round(w, 6) w from ({pairs_sql('cosine')})",
    "normalize_vectors": """
        with u as (select vec_id, list_transform(embedding::double[], lambda x: x / sqrt(list_inner_product(embedding::double[], embedding::double[]))) u from embeddings)
        select vec_id, round(sqrt(list_inner_product(u, u)), 6) norm, round(list_sum(u), 6) total from u""",
    "knn_exact_euclidean": knn_sql("euclidean", 10, True),
    "knn_exact_cosine": knn_sql("cosine", 10, True),
    "knn_from_index_exact": knn_sql("cosine", 10, False),
    "closest_pairs_exact": f"select i, j, round(w, 6) w from (select * from ({pairs_sql('euclidean')}) order by w, i, j limit 20)",
    "closest_pairs_lsh": f"with {CLOSE} select i, j, round(w, 6) w, r.p::integer prefix, 'lsh' path from r join stop on r.p = stop.p where rn <= {CLOSEST}",
    "closest_pairs_glove_exact": f"with {GLOVE_POINTS} select i, j, round(w, 6) w from (select a.vec_id i, b.vec_id j, round({DISTANCE['cosine']}, 9) + 0.0 w from pts a join pts b on a.vec_id < b.vec_id order by w, i, j limit {CLOSEST})",
    "simhash_codes": f"select vec_id, rep, array_to_string(code, ',') code from ({codes_sql(SIM)})",
    "index_save_load_roundtrip": f"select vec_id, rep, array_to_string(code, ',') code from ({codes_sql(SIM)})",
    "e2lsh_codes": f"select vec_id, rep, array_to_string(code, ',') code from ({codes_sql(E2)})",
    "crosspolytope_codes": cross_codes_sql(CROSS),
    "bucket_sizes_by_prefix": f"""
        with {SIM_CODES}, b as (select rep, p.prefix, code[1:p.prefix] as key, count(*) n from codes, range(0, {SIM.depth + 1}, 2) p(prefix) group by all)
        select rep, prefix::integer prefix, count(*)::bigint buckets, max(n)::bigint largest, sum(n * (n - 1) // 2)::bigint pairs from b group by rep, prefix""",
    "bucket_runs": f"with {SIM_CODES} select rep, vec_id, (dense_rank() over (partition by rep order by code) - 1)::bigint bucket from codes",
    "lsh_pairs_full_hash": f"with {SIM_CODES} select distinct a.vec_id i, b.vec_id j {prefix_join(SIM.depth)}",
    "lsh_pairs_prefix": f"with {SIM_CODES} select distinct a.vec_id i, b.vec_id j {prefix_join(LSH_PREFIX)}",
    "pair_lcp": f"with {SIM_CODES} {LCP}",
    "lsh_pairs_incremental": f"with {SIM_CODES} select i, j from ({LCP}) where lcp = {LSH_PREFIX}",
    "component_labels": f"with {SIM_CODES}, {boruvka(FULL_EDGES, ALL)} select v vec_id, c comp from labels",
    "lsh_pairs_filtered": f"""
        with {SIM_CODES}, {boruvka(FULL_EDGES, ALL)},
        met as (select distinct a.vec_id i, b.vec_id j {prefix_join(LSH_PREFIX)})
        select met.i, met.j, round({DISTANCE['cosine']}, 6) w from met join labels x on x.v = met.i join labels y on y.v = met.j
        join embeddings a on a.vec_id = met.i join embeddings b on b.vec_id = met.j where x.c <> y.c""",
    "failure_probability_table": f"""
        with g as (select (d.d / 10.0)::double distance, p.p::integer prefix, least(p.p, {E2.depth}) q from range(1, 20) d(d), range(0, 11) p(p))
        select distance, prefix, round({fail_sql(SIM_P.format(d='distance'), 'prefix', '8', SIM.repetitions, SIM.depth)}, 6) simhash,
               round({fail_sql(SIM_P.format(d='distance'), 'prefix', '4', SIM.repetitions, SIM.depth)}, 6) simhash_half,
               round({fail_sql('(' + e2_sql('distance', E2.width) + ')', 'q', str(E2.repetitions), E2.repetitions, E2.depth)}, 6) e2lsh from g""",
    "confirmed_split": f"with {SPLIT} select i, j, round(w, 6) w, round(fail, 6) fail, confirmed from cs",
    "bound_weight": f"with {SPLIT}, {BOUND} select n_edges, n_confirmed, round(weight, 6) weight, round(bound, 6) bound from b",
    "epsilon_accept": f"with {SPLIT}, {BOUND} select t.epsilon::double epsilon, weight <= (1 + t.epsilon::double) * bound accepted from b, (values (0.01), (0.2), (0.5), (1.0)) t(epsilon)",
    "find_tree_simhash": found_tree(EMBEDDED, SIM_TREE, "cosine", 2, SURE),
    "find_tree_e2lsh": found_tree(EMBEDDED, E2_TREE, "euclidean", 2, SURE),
    "find_epsilon_tree_simhash": found_tree(EMBEDDED, SIM_TREE, "cosine", 2, NEAR),
    "find_tree_parts": found_tree(PART_POINTS, PARTS, "euclidean", PARTS.depth - 4, SURE),
    "find_tree_parts_pruned": found_tree(PART_POINTS, PARTS, "euclidean", PARTS.depth - 4, SURE),
    "find_epsilon_tree_parts": found_tree(PART_POINTS, PARTS, "euclidean", PARTS.depth - 4, NEAR),
    "find_tree_parts_levels": f"with {sweep_sql(PART_POINTS, PARTS, 'euclidean', PARTS.depth - 4, SURE)} select f.p::integer prefix, 'lsh' path, n_edges::bigint n_edges, n_confirmed::bigint n_confirmed, round(weight, 6) weight, round(bound, 6) bound from f join stop on f.p = stop.p",
    "exact_mst_parts": f"with {PART_POINTS}, {boruvka('select a.vec_id i, b.vec_id j, ' + DISTANCE['euclidean'] + ' w from pts a join pts b on a.vec_id < b.vec_id', 'select vec_id v from pts')} {EDGES}",
    "tree_connected": f"with {boruvka(pairs_sql('euclidean'), ALL)} select (select count(*) from embeddings)::bigint n_points, (select count(*) from tree)::bigint n_edges, count(distinct c)::bigint n_components, count(distinct c) <= 1 connected from labels",
    "local_msf_by_rep": f"with {SIM_CODES}, {BY_TABLE}, {boruvka('select rep * 10000000 + i i, rep * 10000000 + j j, w from bt', 'select distinct rep * 10000000 + vec_id v from codes')} select (i // 10000000)::integer rep, (i % 10000000)::bigint i, (j % 10000000)::bigint j, round(w, 6) w from tree",
    "merge_msf": f"with {SIM_CODES}, {BY_TABLE}, {boruvka('select distinct i, j, w from bt', ALL)} {EDGES}",
    "knn_lsh": knn_lsh_sql(10),
    "knn_few_points": """
        with p as (select n_nationkey id, [n_nationkey, n_regionkey * 10]::double[] x from nation),
        d as (select a.id::bigint query_id, b.id::bigint id, list_distance(a.x, b.x) dist from p a join p b on a.id <> b.id),
        r as (select *, row_number() over (partition by query_id order by dist, id)::integer as rank from d)
        select query_id, rank, id, round(dist, 6) dist from r where rank <= 3""",
    "rejected_arguments": "select unnest(['negative prefix', 'no symbols', 'other length', 'unknown metric', 'unknown filter', 'sketches of lengths', 'recall of nothing', 'negative epsilon', 'insufficient memory', 'existing path']) argument, true refused",
    "knn_lsh_sketch_simple": SKETCHED,
    "knn_lsh_sketch_default": SKETCHED,
    "cap_unconfirmed": f"""
        with {SIM_CODES}, {BY_TABLE}, s as (select *, {fail_sql(SIM_P.format(d='w'), '3', '8', SIM.repetitions, SIM.depth)} < {DELTA} confirmed from bt),
        n as (select *, row_number() over (partition by rep, confirmed order by w, i, j) r from s)
        select rep, i, j, round(w, 6) w, confirmed from n where confirmed or r <= 10 * (select count(*) from embeddings)""",
    "reservoir_pairs": f"""
        with {SIM_CODES}, {BY_TABLE}, n as (select *, row_number() over (partition by rep, key order by md5(i || ',' || j || ',0'), i, j) r from bt)
        select rep, i, j, round(w, 6) w from n where r <= 2""",
    "bernoulli_pairs": f"with {SIM_CODES} select i, j from (select distinct a.vec_id i, b.vec_id j {prefix_join(LSH_PREFIX)}) where ('0x' || substr(md5(i || ',' || j || ',0'), 1, 8))::bigint < 1073741824",
    "random_path": f"select least(vec_id, nxt) i, greatest(vec_id, nxt) j from ({PATH}) where nxt is not null",
    "recall_over_runs": f"""
        with v as (select run_id, {RUNS} from recall_results),
        t as (select *, least(w0, w1, w2) low, ((w0 is not null)::int + (w1 is not null)::int + (w2 is not null)::int) n from v)
        select run_id, round(low, 6) "least", round((coalesce(w0 <= low, false)::int + coalesce(w1 <= low, false)::int + coalesce(w2 <= low, false)::int)::double / nullif(n, 0), 6) share from t""",
    "distance_histogram": "select least(floor(distance / (2.0::double / 70)) + 1, 70)::bigint bin, count(*)::bigint n from glove_sampl where i = 24 and j = 0 and distance >= 0 and distance <= 2 group by 1",
    "tree_median_edge": f"with {boruvka(pairs_sql('euclidean'), ALL)}, s as (select w, row_number() over (order by w, i, j) - 1 r from tree) select round(w, 6) w from s where r = (select count(*) // 2 from s)",
    "tree_log_weights": """
        with v as (select row_id, train::double[] x from glove_100_angular where len(train) = 100 and len(list_filter(train, lambda e: e is null or isnan(e) or isinf(e))) = 0 and len(list_filter(train, lambda e: e <> 0)) > 0),
        e as (select distinct run_id, least(u, v) i, greatest(u, v) j from tree_edges where u <> v)
        select run_id, count(*)::bigint n_edges, round(sum(1 - list_cosine_similarity(a.x, b.x)), 4) weight from e join v a on a.row_id = e.i join v b on b.row_id = e.j group by run_id""",
    "incremental_append_tree": mst("euclidean"),
    "collision_log_roundtrip": "select i, j, edge1, edge2, distance from glove_sampl",
    "recall_log_roundtrip": "select name, rep, recall, w0, w1, w2 from recall_results",
    "tree_log_roundtrip": f"with {boruvka(pairs_sql('euclidean'), ALL)} select i, j from tree",
    "index_lookup": f"select c.vec_id, c.rep, array_to_string(c.code, ',') code, len(e.embedding)::integer dim, round(sqrt(list_inner_product(e.embedding::double[], e.embedding::double[])), 6) norm from ({codes_sql(SIM)}) c join embeddings e using (vec_id) where c.vec_id = 7 and c.rep = 1",
    "index_description": f"select count(*)::bigint points, {SIM.repetitions} repetitions, {SIM.depth} depth, '{SIM.describe()}' family, true same from embeddings",
    "stream_append_tree": mst("euclidean"),
    "hdf5_roundtrip": "select vec_id row_id, len(embedding)::integer dim, round(list_sum(embedding::double[]), 6) total from embeddings",
    "binomial_table": "select n.n::bigint n, k.k::bigint k, case when k.k <= n.n then (factorial(n.n::integer) / factorial(k.k::integer) / factorial((n.n - k.k)::integer))::bigint else 0 end ways from range(0, 13) n(n), range(0, 13) k(k)",
    "memory_plan": "select l.l::bigint memory_limit, n::bigint n, ((l.l - 4 * n * 64) // (12 * n + 4 * 8 * 64))::bigint repetitions from (values (2000000), (8000000), (900000000)) l(l), (select count(*) n from embeddings)",
    "jaccard_pairs_documents": f"with {SETS}, {SIMILAR} select i, j, round(w, 6) w from near",
    "jaccard_classes_documents": f"with {SETS} select doc_id, rep from members",
    "jaccard_knn_documents": f"""
        with {SETS}, s as (select q.doc_id query_id, r.doc_id id, 1 - count(*)::double / (q.n + r.n - count(*)) dist from flat q join reps r on q.t = r.t and q.doc_id <> r.doc_id where q.doc_id % 50 = 0 group by q.doc_id, r.doc_id, q.n, r.n),
        n as (select *, row_number() over (partition by query_id order by dist, id)::integer as rank from s)
        select query_id, rank, id, round(dist, 6) dist from n where rank <= 5""",
    "jaccard_mst_documents": f"with {SETS}, {SIMILAR}, {boruvka('select * from near', 'select doc_id v from members', 12)} {EDGES}",
    "minhash_codes_documents": minhash_sql(2, 2),
    "jaccard_pairs_words": f"with {WORD_SETS}, {similar_sql(ALIKE)} select i, j, round(w, 6) w from near",
    "jaccard_mst_words": f"with {WORD_SETS}, {similar_sql(ALIKE)}, {boruvka('select * from near', 'select doc_id v from members', 12)} {EDGES}",
    "minhash_pairs_words": f"""
        with {WORD_SETS}, {similar_sql(ALIKE)},
        c as materialized ({minhash_rows(WORDS.repetitions, WORDS.depth, WORDS.seed, 'reps')}),
        m as (select distinct a.doc_id i, b.doc_id j from c a join c b on a.rep = b.rep and a.code = b.code and a.doc_id < b.doc_id)
        select i, j, round(w, 6) w, round({fail_sql('(1 - w)', str(WORDS.depth), str(WORDS.repetitions), WORDS.repetitions, WORDS.depth)}, 6) fail from near join m using (i, j)""",
}
