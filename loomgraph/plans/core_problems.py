"""Queries of the two general problems: hierarchies and orphan references."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.hierarchy import DOWN, UP, descendants, hierarchy, hierarchy_edges, several_parents
from ..operators.references import orphan_references, orphan_report
from ..session import load


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy(hierarchy_edges(load(spark, d, "relations"), load(spark, d, "entities")))


def p3_paths(spark: SparkSession, d: str) -> DataFrame:
    h = hierarchy(hierarchy_edges(load(spark, d, "relations"), load(spark, d, "entities")), with_paths=True)
    return h.selectExpr("node_id", "root_id", "depth", "array_join(path, '/') as path")


def p3_descendants(spark: SparkSession, d: str) -> DataFrame:
    return descendants(hierarchy(hierarchy_edges(load(spark, d, "relations"), load(spark, d, "entities")), with_paths=True))


def p3_several_parents(spark: SparkSession, d: str) -> DataFrame:
    """Nodes that name several parents, of which the hierarchy follows the smallest."""
    p = several_parents(hierarchy_edges(load(spark, d, "relations"), load(spark, d, "entities")))
    return p.selectExpr("node_id", "array_join(parents, ',') as parents")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return orphan_references(*[load(spark, d, t) for t in ("relations", "entities", "ontology_projects")]).select("relation_id", "ref_field", "kind")


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(orphan_references(*[load(spark, d, t) for t in ("relations", "entities", "ontology_projects")]))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p3_found, p3_paths, p3_descendants, p3_several_parents, p5_found, p5_report)}


def _list(xs: tuple[str, ...]) -> str:
    return ", ".join(f"'{x}'" for x in xs)


_WALK = f"""
with recursive r as (
  select distinct lower(regexp_replace(type, '[\\s_\\-]+', '', 'g')) as k, lower(trim(source_entity)) as s, lower(trim(target_entity)) as t from relations where deprecated_at is null),
ids as (select lower(trim(id)) as k, min(id) as id from entities group by 1),
e as (select c.id as child, min(p.id) as parent from (
    select case when k in ({_list(UP)}) then s else t end as a, case when k in ({_list(UP)}) then t else s end as b from r where k in ({_list(UP + DOWN)})) x
  join ids c on c.k = x.a join ids p on p.k = x.b group by 1),
nodes as (select child as n from e union select parent from e),
up as (
  select n, n as pos, 0 as d, [n] as seen from nodes
  union all select up.n, e.parent, up.d + 1, list_prepend(e.parent, up.seen) from up join e on e.child = up.pos where not list_contains(up.seen[:len(up.seen)], e.parent)),
ends as (select n, arg_max(pos, d) as pos, max(d) as d, arg_max(seen, d) as seen from up group by n),
x as (select ends.n, ends.pos, ends.d, ends.seen, e.parent as back from ends left join e on e.child = ends.pos)
"""


def oracle_sql() -> dict[str, str]:
    loop = "list_min(seen[1:list_position(seen, back)])"
    orphans = """
with e as (select lower(trim(id)) as k, min(created_at) as born, max(deprecated_at) as died, bool_and(deprecated_at is not null) as gone from entities group by 1),
p as (select lower(trim(id)) as k, min(created_at) as born from ontology_projects group by 1),
r as (select distinct id, created_at, f, lower(trim(v)) as k from (
    select id, created_at, unnest(['source_entity', 'target_entity', 'ontology_id']) as f, unnest([source_entity, target_entity, ontology_id]) as v from relations) where trim(v) <> ''),
o as (
  select id, created_at, f, case when e.k is null then 'missing' when born > created_at then 'late' when gone and died <= created_at then 'deleted' end as kind from r left join e using (k) where f <> 'ontology_id'
  union all select id, created_at, f, case when p.k is null then 'missing' when born > created_at then 'late' end from r left join p using (k) where f = 'ontology_id')
"""
    return {
        "p3_found": _WALK + f"select n as node_id, case when back is null then pos else {loop} end as root_id, cast(case when back is null then d else -1 end as bigint) as depth from x",
        "p3_paths": _WALK + f"select n as node_id, case when back is null then pos else {loop} end as root_id, cast(case when back is null then d else -1 end as bigint) as depth, case when back is null then array_to_string(seen, '/') end as path from x",
        "p3_descendants": _WALK + "select up.pos as ancestor_id, up.n as node_id, cast(up.d as bigint) as distance from up join x using (n) where x.back is null and up.d > 0",
        "p3_several_parents": _WALK.split("e as (")[0] + f"""x as (select distinct c.id as child, p.id as parent from (
    select case when k in ({_list(UP)}) then s else t end as a, case when k in ({_list(UP)}) then t else s end as b from r where k in ({_list(UP + DOWN)})) y
  join ids c on c.k = y.a join ids p on p.k = y.b)
select child as node_id, string_agg(parent, ',' order by parent) as parents from x group by 1 having count(*) > 1""",
        "p5_found": orphans + "select id as relation_id, f as ref_field, kind from o where kind is not null",
        "p5_report": orphans + "select f as ref_field, strftime(created_at, '%Y-%m') as period, kind, count(*) as n from o where kind is not null group by all",
    }
