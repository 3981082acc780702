"""Queries over graphs, texts, vectors, events and streams. Each stands beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import documents, graph, search
from ..session import load
from ..streaming import incremental as inc

_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_S: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _Q[f.__name__] = f
        if sql:
            _S[f.__name__] = sql
        return f
    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_S)


# -- graphs -----------------------------------------------------------------------------------------------

def _edges(spark, d):
    return load(spark, d, "relations").select(F.col("source_entity").alias("src"), F.col("target_entity").alias("dst"), "ontology_id", "type")


def _nodes(spark, d):
    return load(spark, d, "entities").select("id", "name_cn", "type").distinct()


@query("""with e as (select distinct source_entity as s, target_entity as t from relations), x as (select s as node, 0 as i, 1 as o from e union all select t, 1, 0 from e)
 select node, cast(sum(i) as bigint) as in_degree, cast(sum(o) as bigint) as out_degree, cast(sum(i + o) as bigint) as degree from x group by 1""")
def node_degree(spark, d):
    return graph.degrees(_edges(spark, d))


@query("""with e as (select distinct source_entity as s, target_entity as t from relations), x as (select s as node, 0 as i, 1 as o from e union all select t, 1, 0 from e)
 select node, cast(sum(i) as bigint) as in_degree, cast(sum(o) as bigint) as out_degree, cast(sum(i + o) as bigint) as degree from x group by 1 order by degree desc, node limit 10""")
def top_connected(spark, d):
    return graph.top_connected(_edges(spark, d), 10)


@query("select id from (select distinct id from entities) where id not in (select source_entity from relations union select target_entity from relations)")
def isolated_nodes(spark, d):
    touched = _edges(spark, d).select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return _nodes(spark, d).select("id").distinct().join(touched, "id", "left_anti")


_NEAR = "n as (select distinct * from (select source_entity as s, target_entity as t from relations union all select target_entity, source_entity from relations) where s <> t)"


@query(f"with {_NEAR}, a as (select min(id) as id from entities where id in (select s from n)), h1 as (select distinct t as node from n where s in (select id from a)), h2 as (select distinct t as node from n where s in (select node from h1) and t not in (select node from h1) and t not in (select id from a)), h3 as (select distinct t as node from n where s in (select node from h2) and t not in (select node from h2) and t not in (select node from h1) and t not in (select id from a)) select node, 1 as hops from h1 where node not in (select id from a) union all select node, 2 from h2 union all select node, 3 from h3")
def khop_neighbors(spark, d):
    e = _edges(spark, d)
    start = _nodes(spark, d).join(graph.both_ways(e).select(F.col("src").alias("id")), "id", "left_semi").agg(F.min("id").alias("id"))
    return graph.neighbourhood(e, start, 3)


@query(f"""with recursive {_NEAR}, a as (select min(s) as lo, max(s) as hi from n), b as (select lo as node, 0 as h from a union select t, h + 1 from b join n on s = node where h < 12), m as (select node, min(h) as h from b group by 1)
 select cast(coalesce((select h from m join a on node = hi), -1) as bigint) as hops""")
def shortest_path(spark, d):
    e = _edges(spark, d)
    r = graph.both_ways(e).agg(F.min("src"), F.max("src")).first()
    return graph.path_length(e, r[0], r[1])


@query("""with recursive ids as (select distinct id from entities), n as (select distinct * from (select source_entity as s, target_entity as t from relations union all select target_entity, source_entity from relations) where s <> t and s in (select id from ids) and t in (select id from ids) ),
 w as (select id as node, id as c from ids union select t, c from w join n on s = node) select count(distinct c) as components, max(k)::bigint as largest from (select c, count(*) over (partition by c) as k from (select node, min(c) as c from w group by 1))""")
def components(spark, d):
    c = graph.components(_nodes(spark, d), _edges(spark, d)).groupBy("component").agg(F.count("*").alias("k"))
    return c.agg(F.count("*").alias("components"), F.max("k").alias("largest"))


@query()
def graph_diagnostics(spark, d):
    return graph.diagnostics(_nodes(spark, d), _edges(spark, d))


@query("""with n as (select distinct id, name_cn, type from entities), e as (select source_entity as s, target_entity as t from relations),
 c as (select (select count(*) from n) as node_count, (select count(*) from e) as edge_count, (select count(*) from (select distinct id from n) where id not in (select s from e union select t from e)) as isolated,
 (select coalesce(sum(k), 0) from (select count(*) as k from n where name_cn <> '' group by name_cn having count(*) > 1))::bigint as duplicates, (select count(*) from e where s not in (select id from n) or t not in (select id from n)) as orphans)
 select *, round(1 - least(0.4, isolated / node_count * 0.4) - least(0.25, duplicates / node_count * 0.25) - least(0.25, orphans / edge_count * 0.25), 6) as quality from c""")
def graph_quality(spark, d):
    return graph.graph_quality(_nodes(spark, d), _edges(spark, d), "name_cn")


@query("""with t as (select source_entity as s from relations union select target_entity from relations), n as (select distinct id, type from entities) select type, count(*) as total, count(t.s) as covered, round(count(t.s) / count(*), 6) as rate from n left join t on t.s = id group by 1""")
def coverage_by_type(spark, d):
    return graph.coverage(_nodes(spark, d).select("id", "type").distinct(), _edges(spark, d), "type")


@query("""select source_entity as source, target_entity as target, type, arg_max(id, (coalesce(confidence, 0.0), id)) as id, coalesce(string_agg(distinct properties->>'$.source', ',' order by properties->>'$.source'), '') as fk_columns, count(*) as evidence_count from relations group by 1, 2, 3""")
def edge_dedupe_best(spark, d):
    r = load(spark, d, "relations").select("id", F.col("source_entity").alias("source"), F.col("target_entity").alias("target"), "type", "confidence", F.get_json_object("properties", "$.source").alias("fk_column"))
    return graph.best_edges(r)


@query("""with k as (select distinct id from entities order by id limit 500) select distinct source_entity as src, target_entity as dst from relations where source_entity in (select id from k) and target_entity in (select id from k)""")
def visual_subgraph(spark, d):
    return graph.subgraph(_nodes(spark, d), _edges(spark, d).select("src", "dst"), 500)


@query("""select type, count(*) as n, round(count(*) * 1.0 / (select count(*) from relations), 6) as share from relations group by 1""")
def relation_histogram(spark, d):
    from pyspark.sql import Window as W

    return _edges(spark, d).groupBy("type").agg(F.count("*").alias("n")).withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy()), 6))


@query("""with p(a, b, rel) as (values ('药物', '疾病', 'treats'), ('供应商', '物料', 'supply'), ('部门', '人员', 'PART-OF')), l as (select distinct s.type as a, t.type as b from relations r join entities s on s.id = source_entity join entities t on t.id = target_entity where r.type = 'treats')
 select p.a as ta, p.b as tb, p.rel from p where not exists (select 1 from l where l.a = p.a and l.b = p.b)""")
def missing_relation_patterns(spark, d):
    n = _nodes(spark, d)
    kinds = n.select("id", "type").distinct()
    linked = _edges(spark, d).where("type = 'treats'").join(kinds.toDF("src", "src_type"), "src").join(kinds.toDF("dst", "dst_type"), "dst").select("src_type", "dst_type").distinct()
    return graph.missing_relations(n.select("type").where("type is not null").distinct(), linked, (("药物", "疾病", "treats"), ("供应商", "物料", "supply"), ("部门", "人员", "PART-OF")))


# -- search -----------------------------------------------------------------------------------------------

@query("select distinct id from entities where contains(lower(coalesce(name_cn, '')), '物流') or contains(lower(coalesce(description, '')), '物流') or contains(lower(coalesce(properties, '')), '物流')")
def keyword_search(spark, d):
    return search.keyword_search(load(spark, d, "entities"), ["name_cn", "description", "properties"], "物流").select("id").distinct()


_DOT = "list_sum(list_transform(range(1, len(embedding) + 1), lambda i: embedding[i]::double * q[i]::double))"
_NORM = "sqrt(list_sum(list_transform({v}, lambda x: x::double * x::double)))"


@query(f"with q as (select embedding as q from embeddings where vec_id = (select min(vec_id) from embeddings)) select vec_id as id, round({_DOT} / {_NORM.format(v='embedding')} / {_NORM.format(v='q')}, 6) as score from embeddings, q order by score desc, id limit 10")
def vector_topk(spark, d):
    e = load(spark, d, "embeddings")
    q = e.orderBy("vec_id").select("embedding").first()[0]
    return search.vector_topk(e, "vec_id", "embedding", list(q), 10)


@query(f"""with q as (select vec_id as query_id, embedding as q from embeddings where vec_id % 50 = 0), s as (select query_id, vec_id as id, {_DOT} / {_NORM.format(v='embedding')} / {_NORM.format(v='q')} as s from embeddings, q where query_id <> vec_id),
 r as (select *, row_number() over (partition by query_id order by s desc, id) as rank from s) select query_id, id, cast(rank as int) as rank, round(s, 6) as score from r where rank <= 10""")
def vector_nearest(spark, d):
    e = load(spark, d, "embeddings")
    return search.nearest_in_bulk(e, "vec_id", "embedding", e.where("vec_id % 50 = 0"), 10)


@query("""with t as (select doc_id, cast((length(lower(text)) - length(replace(lower(text), '合同', ''))) / 2 + (length(lower(text)) - length(replace(lower(text), 'lot', ''))) / 3 as int) as n from documents), h as (select * from t where n > 0)
 select doc_id as key, round(case when (select max(n) from h) > (select min(n) from h) then (n - (select min(n) from h)) / ((select max(n) from h) - (select min(n) from h)) else 1 end, 6) as lexical from h""")
def lexical_rank(spark, d):
    return search.lexical_scores(load(spark, d, "documents"), "doc_id", "text", ["合同", "lot"])


@query("""select vec_id, round(case when vec_id % 3 = 0 then 0.5 * ((vec_id % 10) / 10.0 + 1) / 2 + 0.2 * (vec_id % 7) / 7.0 + 0.15 * 0.8 + 0.1 * exp(-(vec_id % 60) / 30.0) + 0.05 when vec_id % 7 > 0 then 0.4 * (vec_id % 7) / 7.0 + 0.3 * 0.8 + 0.2 * exp(-(vec_id % 60) / 30.0) + 0.1 end, 6) as score from embeddings""")
def hybrid_score(spark, d):
    v = F.col("vec_id")
    s = search.hybrid_score(F.when(v % 3 == 0, (v % 10) / 10.0), (v % 7) / 7.0, F.lit(0.8), F.exp(-(v % 60) / 30.0), F.lit(1.0))
    return load(spark, d, "embeddings").select("vec_id", F.round(s, 6).alias("score"))


@query()
def diverse_recall(spark, d):
    e = load(spark, d, "embeddings")
    s = e.select("label", F.col("vec_id").alias("id"), (F.pmod(F.xxhash64("vec_id"), F.lit(1000)) / 1000.0).alias("score"), F.when(F.col("vec_id") % 4 != 0, F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(1000)) / 1000.0).alias("cosine"), (F.lit(50) + F.col("vec_id") % 100).alias("tokens"))
    return search.diverse_picks(s, "label", 5, 400)


@query("""with p as (select distinct 物料编码 as t, left(物料编码, 2) as blk from purchase_orders) select a.t as a, b.t as b, round(1 - levenshtein(a.t, b.t) / greatest(length(a.t), length(b.t)), 6) as ratio from p a join p b on a.blk = b.blk and a.t < b.t where 1 - levenshtein(a.t, b.t) / greatest(length(a.t), length(b.t)) >= 0.85""")
def fuzzy_pairs_levenshtein(spark, d):
    p = load(spark, d, "purchase_orders").select(F.col("物料编码").alias("t")).distinct().withColumn("blk", F.substring("t", 1, 2)).withColumn("k", F.col("t"))
    return search.similar_pairs(p, "k", "t", "blk", 0.85)


@query("""select p_partkey, coalesce(b, p_brand) as p_brand from part left join (select 'Brand#' || x as a, 'Brand#' || (x - x % 10) as b from (select unnest(range(11, 60)) as x)) on a = p_brand""")
def alias_resolution(spark, d):
    a = spark.range(11, 60).select(F.concat(F.lit("Brand#"), "id").alias("alias"), F.concat(F.lit("Brand#"), F.col("id") - F.col("id") % 10).alias("canonical"))
    return search.resolve_aliases(load(spark, d, "part").select("p_partkey", "p_brand"), "p_brand", a)


@query("""with e as (select distinct id from entities where confidence > 0.8), f as (select distinct id from entities where type in ('疾病', '药物')), x as (select (select count(*) from e) as e, (select count(*) from f) as f, (select count(*) from e semi join f using (id)) as h) select round(h / f, 6) as precision, round(h / e, 6) as recall, round(2 * (h / f) * (h / e) / (h / f + h / e), 6) as f1 from x""")
def precision_recall(spark, d):
    e = load(spark, d, "entities")
    return search.f1(e.where("confidence > 0.8"), e.where(F.col("type").isin("疾病", "药物")), ["id"])


@query()
def resolution_plan(spark, d):
    e = load(spark, d, "entities").where("canonical_id is not null")
    return search.resolution_plan(e.where("deprecated_at is not null"), e.where("deprecated_at is null"), "name_cn")


# -- documents --------------------------------------------------------------------------------------------

@query("""select doc_id as key, length(regexp_extract(l, '^(#{1,6})', 1)) as level, trim(regexp_extract(l, '^#{1,6}\\s+(.+)$', 1)) as title, cast(i - 1 as int) as line from (select doc_id, unnest(string_split(text, chr(10))) as l, generate_subscripts(string_split(text, chr(10)), 1) as i from documents) where regexp_matches(l, '^#{1,6}\\s+\\S')""")
def headings(spark, d):
    return documents.headings(load(spark, d, "documents"), "doc_id", "text")


_LINES = """
with l as (select doc_id as key, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from documents where text is not null),
k as (select *, regexp_matches(line, '^#{1,6}\\s+\\S') as h, regexp_matches(line, '^[ \\t]*\\d+[.、)][ \\t]+\\S.{0,60}$') and not regexp_matches(line, '^[ \\t]*\\d+[.、)][ \\t]+(?i:if|step)\\b') as n from l)
"""


@query(_LINES + """, m as (select *, case when bool_or(h) over (partition by key) then h else n end as mark from k),
s as (select *, sum(mark::int) over (partition by key order by i) as sec, bool_or(mark) over (partition by key) as any_mark from m),
b as (select key, sec, coalesce(max(case when mark then trim(regexp_replace(line, '^\\s*(?:#{1,6}|\\d+[.、)])\\s+', ''), chr(32) || chr(9)) end), '') as title,
  regexp_replace(coalesce(string_agg(case when not mark then line end, chr(10) order by i), ''), '^\\s+|\\s+$', '', 'g') as body from s where sec > 0 or not any_mark group by key, sec)
select key, cast(row_number() over (partition by key order by sec) as int) as section_index, title, body from b where body <> ''""")
def section_split(spark, d):
    return documents.sections(load(spark, d, "documents"), "doc_id", "text")


@query("""with t as (select doc_id as key, unnest(regexp_extract_all(text, '(?m)^[ \\t]*\\|[^\\n]*\\n[ \\t]*\\|*[ \\t]*:?-{3,}:?[ \\t]*(?:\\|[ \\t]*:?-{3,}:?[ \\t]*)*\\|*[ \\t]*$(?:\\n[ \\t]*\\|[^\\n]*)*')) as block,
  generate_subscripts(regexp_extract_all(text, '(?m)^[ \\t]*\\|[^\\n]*\\n[ \\t]*\\|*[ \\t]*:?-{3,}:?[ \\t]*(?:\\|[ \\t]*:?-{3,}:?[ \\t]*)*\\|*[ \\t]*$(?:\\n[ \\t]*\\|[^\\n]*)*'), 1) as table_index from documents),
r as (select key, table_index, list_transform(string_split(block, chr(10)), lambda l: list_transform(string_split(regexp_replace(trim(l), '^\\|+|\\|+$', '', 'g'), '|'), lambda c: trim(c))) as rows from t),
x as (select key, table_index, rows[1] as head, list_filter(rows[3:], lambda r: len(r) = len(rows[1])) as good from r),
y as (select key, table_index, head, unnest(good) as cells, generate_subscripts(good, 1) as row_index from x)
select key, cast(table_index as int) as table_index, cast(row_index as int) as row_index, unnest(list_transform(head, lambda h, i: case when h = '' then 'col_' || i else h end)) as col, unnest(cells) as cell from y""")
def table_rows(spark, d):
    return documents.tables(load(spark, d, "documents"), "doc_id", "text")


@query()
def chunk_docs(spark, d):
    return documents.chunks(load(spark, d, "documents"), "doc_id", "text", 1500, 100)


@query("""select doc_id, list_slice(regexp_extract_all(text, '(\\d[\\d,\\.]+)\\s*(?:万元?|吨|件|小时|天|%|个月|季度)', 1), 1, 6) as thresholds from documents""")
def text_thresholds(spark, d):
    from ..functions.columns import thresholds

    return load(spark, d, "documents").select("doc_id", thresholds("text", 6).alias("thresholds"))


@query("""select doc_id, regexp_extract_all(text, '(\\d[\\d,.]+)\\s*(?:万元|万|吨|件|小时|天|%|个月|季度)', 1) as thresholds from documents""")
def text_thresholds_all(spark, d):
    from ..functions.columns import thresholds

    return load(spark, d, "documents").select("doc_id", thresholds("text").alias("thresholds"))


@query()
def rule_text_extract(spark, d):
    return documents.rules(load(spark, d, "documents"), "doc_id", "text").unionByName(documents.definitions(load(spark, d, "documents"), "doc_id", "text").select("key", F.lit(0).alias("rule_index"), F.col("name").alias("condition"), F.col("definition").alias("action")))


# -- events -----------------------------------------------------------------------------------------------

def _log(spark, d):
    e = load(spark, d, "events")
    return e.withColumn("operation", F.when(F.col("event_type") == "error", "delete").otherwise("upsert"))


_LOG = "l as (select *, case when event_type = 'error' then 'delete' else 'upsert' end as operation from events)"


@query(f"with {_LOG} select user_id, event_id, event_type, value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from l) where r = 1 and operation <> 'delete'")
def current_state(spark, d):
    return inc.current_state(_log(spark, d), "user_id", ["ts", "event_id"], "operation").select("user_id", "event_id", "event_type", "value")


@query("select event_type, cast(sum(case when (ts, event_id) <= (select (ts, event_id) from events where event_id = (select cast(median(event_id) as bigint) from events)) then 1 else 0 end) as bigint) as late, count(*) as n from events group by 1")
def late_flag(spark, d):
    e = load(spark, d, "events")
    m = e.selectExpr("cast(round(percentile(event_id, 0.5)) as bigint) as m").first()[0]
    r = e.where(F.col("event_id") == m).first()
    return inc.flagged_late(e, "ts", "event_id", (r.ts, r.event_id)).groupBy("event_type").agg(F.sum(F.col("is_late").cast("long")).alias("late"), F.count("*").alias("n"))


@query("select max(ts) as watermark, arg_max(event_id, (ts, event_id)) as primary_key, count(*) as \"rows\" from events")
def cursor_advance(spark, d):
    return inc.next_cursor(load(spark, d, "events"), "ts", "event_id")


@query("select event_id, sha256(concat_ws('|', event_id::varchar, user_id::varchar, event_type, props)) as hash from events")
def event_dedupe_hash(spark, d):
    return load(spark, d, "events").select("event_id", inc.event_hash("event_id", "user_id", "event_type", "props").alias("hash"))


@query("select event_id, user_id from events where (ts > (select median(ts) from events) - interval 60 second)")
def keyset_delta(spark, d):
    e = load(spark, d, "events")
    m = e.selectExpr("percentile(unix_micros(cast(ts as timestamp)), 0.5) as m").selectExpr("cast(timestamp_micros(cast(m as bigint)) as timestamp_ntz) as m").first()[0]
    return inc.after_cursor(e, "ts", "event_id", (m, 0), "60 seconds").where(F.col("ts") > F.lit(m) - F.expr("interval 60 seconds")).select("event_id", "user_id")


@query("select user_id, count(*) as copies, count(distinct event_type) as payloads, case when count(distinct event_type) > 1 then 'replay' else 'duplicate' end as verdict from events group by 1 having count(*) > 1")
def replay_detection(spark, d):
    return inc.replays(load(spark, d, "events"), "user_id", "event_type")


@query("""select event_id, case when event_id % 9 = 0 then 'missing primary_key' when event_id % 10 = 0 then 'unknown operation' end as reason from events""")
def envelope_check(spark, d):
    i = F.col("event_id")
    raw = load(spark, d, "events").select(F.to_json(F.struct(i.cast("string").alias("event_id"), F.lit("s").alias("source_id"), F.lit("r").alias("resource"), F.when(i % 10 == 0, "merge").otherwise("upsert").alias("operation"), F.when(i % 9 != 0, i.cast("string")).alias("primary_key"), F.col("ts").cast("string").alias("watermark"))).alias("value"))
    return inc.envelopes(raw).select(F.col("event_id").cast("long").alias("event_id"), "reason")


@query("select user_id, count(*) as attempts, least(3600.0, pow(2.0, count(*) - 1)) as delay, case when bool_or(event_type = 'purchase') then 'done' when count(*) >= 5 then 'dead' else 'retry' end as state from events group by 1")
def retry_state(spark, d):
    e = load(spark, d, "events").withColumn("ok", F.col("event_type") == "purchase")
    return inc.retries(e, "user_id", 5)


_FRESH = "select user_id, case when age <= {s} then 'fresh' when age <= {h} then 'soft_stale' else 'hard_stale' end as state from (select user_id, date_diff('second', max(ts), (select max(ts) from events)) as age from events group by 1)"


@query("select user_id, case when age <= 3600 then 'fresh' when age <= 86400 then 'soft_stale' else 'hard_stale' end as state, case when age <= 7200 then 'within' else 'breached' end as sla from (select user_id, floor(epoch(n))::bigint - floor(epoch(max(ts)))::bigint as age from events, (select max(ts) as n from events) group by user_id, n)")
def freshness_state(spark, d):
    e = load(spark, d, "events")
    now = e.agg(F.max("ts").alias("now"))
    last = e.groupBy("user_id").agg(F.max("ts").alias("last")).join(F.broadcast(now))
    return last.select("user_id", inc.freshness(F.col("last"), F.col("now")).alias("state"), inc.sla(F.col("last"), F.col("now"), F.lit(7200)).alias("sla"))


_TUMBLE = "select time_bucket(interval 1 hour, ts, timestamp '1970-01-01') as window_start, time_bucket(interval 1 hour, ts, timestamp '1970-01-01') + interval 1 hour as window_end, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2, 3"


@query(_TUMBLE)
def window_tumbling(spark, d):
    return inc.tumbling(load(spark, d, "events"), "ts", "1 hour", ["event_type"])


@query("with w as (select unnest([time_bucket(interval 30 minute, ts, timestamp '1970-01-01'), time_bucket(interval 30 minute, ts, timestamp '1970-01-01') - interval 30 minute]) as s, event_type, value from events) select s as window_start, s + interval 1 hour as window_end, event_type, count(*) as n, round(sum(value), 4) as total from w group by 1, 2, 3")
def window_sliding(spark, d):
    return inc.tumbling(load(spark, d, "events"), "ts", "1 hour", ["event_type"], "30 minutes")


@query("with g as (select user_id, ts, case when lag(ts) over w is null or ts > lag(ts) over w + interval 2 hour then 1 else 0 end as b from events window w as (partition by user_id order by ts)), s as (select user_id, ts, sum(b) over (partition by user_id order by ts rows unbounded preceding) as s from g) select user_id, min(ts) as session_start, max(ts) + interval 2 hour as session_end, count(*) as n from s group by user_id, s")
def window_session(spark, d):
    return inc.sessions(load(spark, d, "events"), "ts", "user_id", "2 hours")


@query(_TUMBLE)
def stream_tumbling(spark, d):
    e = load(spark, d, "events")
    return inc.replay_stream(spark, e, "ts", lambda s: s.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("v")), mode="complete").select(
        F.col("w.start").cast("timestamp_ntz").alias("window_start"), F.col("w.end").cast("timestamp_ntz").alias("window_end"), "event_type", "n", F.round("v", 4).alias("total"))


@query("select event_id, user_id, event_type from events where event_type <> 'view'")
def stream_filter(spark, d):
    return inc.replay_stream(spark, load(spark, d, "events"), "ts", lambda s: s.where("event_type <> 'view'").select("event_id", "user_id", "event_type"))


@query("select distinct event_id from events")
def stream_dedupe(spark, d):
    e = load(spark, d, "events").select("event_id", "ts")
    return inc.replay_stream(spark, e.unionByName(e), "ts", lambda s: s.dropDuplicates(["event_id"]).select("event_id"))
