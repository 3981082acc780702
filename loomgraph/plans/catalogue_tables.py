"""Queries over tables: typing, cleansing, quality, keys, links, joins, aggregates, windows, rules. Each stands beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, Window as W

from ..functions import columns as C
from ..operators import governance, links, nested, profile, rules
from ..session import load
from ..sources import exports

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


# -- typing, cleansing, quality ---------------------------------------------------------------------------

_TYPE = """case when v is null or lower(trim(v)) in ('', 'none', 'null', 'nan') then 'null'
 when regexp_matches(trim(v), '^[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}|^[0-9]{1,2}[-/][0-9]{1,2}[-/][0-9]{4}|^[0-9]{8}$') then 'timestamp'
 when lower(trim(v)) in ('true', 'false', 'yes', 'no', '1', '0') then 'boolean'
 when regexp_matches(replace(trim(v), ',', ''), '^[+-]?[0-9]+$') then 'integer'
 when try_cast(replace(trim(v), ',', '') as double) is not null then 'float' else 'string' end"""


@query(f"""with a as (select * from purchase_orders order by 订单号, 下单日期 limit 10),
 c as (unpivot (select cast(订单号 as varchar) 订单号, 下单日期, 供应商, 数量, 单价, 总金额, 状态 from a) on 订单号, 下单日期, 供应商, 数量, 单价, 总金额, 状态 into name col value v),
 t as (select col, {_TYPE} as type, count(*) n from c where trim(v) <> '' group by 1, 2)
 select x.col, coalesce((select type from t where t.col = x.col order by n desc, list_position(['timestamp','integer','float','boolean','string','null'], type) limit 1), 'string') as type
 from (select unnest(['订单号','下单日期','供应商','数量','单价','总金额','状态']) as col) x""")
def infer_types_vote(spark, d):
    df = load(spark, d, "purchase_orders").select("订单号", "下单日期", "供应商", "数量", "单价", "总金额", "状态")
    return profile.inferred_schema(df, ["订单号", "下单日期"])


@query(f"select v as value, type, count(*) as n from (select 数量 as v, {_TYPE} as type from (select 数量, 数量 as v from purchase_orders)) group by 1, 2")
def classify_values(spark, d):
    return load(spark, d, "purchase_orders").groupBy(F.col("数量").alias("value"), profile.value_type(F.col("数量")).alias("type")).agg(F.count("*").alias("n"))


@query("select doc_id, lang, source, domain from documents where trim(coalesce(lang, '')) <> '' and trim(coalesce(source, '')) <> '' and trim(coalesce(domain, '')) <> ''")
def cleanse_drop(spark, d):
    return profile.drop_blank_rows(load(spark, d, "documents").select("doc_id", "lang", "source", "domain"))


@query("select cast(doc_id as varchar) as doc_id, trim(coalesce(lang, '')) as lang, trim(coalesce(source, '')) as source, trim(coalesce(domain, '')) as domain from documents")
def cleanse_fill(spark, d):
    return profile.fill_blank(load(spark, d, "documents").select("doc_id", "lang", "source", "domain"))


@query("""select doc_id, trim(coalesce(lang, '')) as lang, trim(coalesce(source, '')) as source, case when trim(coalesce(lang, '')) = '' then '1' end as "__null_lang__", case when trim(coalesce(source, '')) = '' then '1' end as "__null_source__" from documents""")
def cleanse_mark(spark, d):
    return profile.mark_blank(load(spark, d, "documents").select("doc_id", "lang", "source"), ["lang", "source"])


@query("select distinct * from purchase_orders")
def dedupe_rows(spark, d):
    return load(spark, d, "purchase_orders").distinct()


@query("select md5(text) as digest, min(doc_id) as first_doc, count(*) as copies from documents group by 1")
def dedupe_exact_docs(spark, d):
    return load(spark, d, "documents").groupBy(F.md5("text").alias("digest")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"))


_DATE = """case when regexp_matches(trim({c}), '^\\d{{4}}[-/]\\d{{1,2}}[-/]\\d{{1,2}}$') then regexp_extract(trim({c}), '^(\\d{{4}})', 1) || '-' || lpad(regexp_extract(trim({c}), '^\\d{{4}}[-/](\\d{{1,2}})', 1), 2, '0') || '-' || lpad(regexp_extract(trim({c}), '(\\d{{1,2}})$', 1), 2, '0')
 when regexp_matches(trim({c}), '^\\d{{1,2}}[-/]\\d{{1,2}}[-/]\\d{{4}}$') then right(trim({c}), 4) || '-' || lpad(regexp_extract(trim({c}), '^\\d{{1,2}}[-/](\\d{{1,2}})', 1), 2, '0') || '-' || lpad(regexp_extract(trim({c}), '^(\\d{{1,2}})', 1), 2, '0')
 when regexp_matches(trim({c}), '^\\d{{8}}$') then left(trim({c}), 4) || '-' || substr(trim({c}), 5, 2) || '-' || right(trim({c}), 2) else trim({c}) end"""


@query(f"select 订单号 as order_no, {_DATE.format(c='下单日期')} as ordered, {_DATE.format(c='要求交货期')} as due from purchase_orders")
def normalize_dates_iso(spark, d):
    return load(spark, d, "purchase_orders").select(F.col("订单号").alias("order_no"), C.iso_date("下单日期").alias("ordered"), C.iso_date("要求交货期").alias("due"))


def _quality(table: str, cols: list[str]) -> str:
    blank = "({c} is null or trim(cast({c} as varchar)) = '')"
    nulls = " + ".join(f"avg(case when {blank.format(c=c)} then 1.0 else 0.0 end)" for c in cols)
    k = len(cols)

    def mixed(c: str) -> str:
        v = f"trim(cast({c} as varchar))"
        kind = f"case when regexp_matches({v}, '^[+-]?[0-9]+$') then 'n' when try_cast({v} as double) is not null then 'n' when lower({v}) in ('true', 'false') then 'b' else 's' end"
        return f"(case when count(distinct case when not {blank.format(c=c)} then {kind} end) > 1 then 1 else 0 end)"

    m = " + ".join(mixed(c) for c in cols)
    key = ", ".join(cols)
    return f"""with q as (select count(*) as n, ({nulls}) / {k} as nulls, ({m}) as mixed from {table}), u as (select count(*) as u from (select distinct {key} from {table}))
 select n as row_count, cast({k} as bigint) as column_count, round(1 - nulls, 6) as completeness, round(1 - (n - u) / n, 6) as uniqueness, round(1 - mixed / {k}, 6) as validity,
 round(0.4 * (1 - nulls) + 0.4 * (1 - (n - u) / n) + 0.2 * (1 - mixed / {k}), 6) as overall, n - u as duplicate_count from q, u"""


def _report(name: str, table: str, cols: list[str]) -> None:
    def f(spark, d, table=table, cols=cols):
        return profile.quality_report(load(spark, d, table).select(*cols))

    f.__name__ = name
    query(_quality(table, [f'"{c}"' for c in cols]))(f)


_report("quality_report_orders", "orders", "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority".split())
_report("quality_report_lineitem", "lineitem", "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate".split())
_report("quality_report_purchase_orders", "purchase_orders", "订单号 下单日期 供应商 供应商类别 物料编码 物料名称 物料类别 规格型号 单位 数量 单价 总金额 要求交货期 实际到货期 状态 质检结果 采购员".split())
_report("quality_report_relations", "relations", "id ontology_id source_entity target_entity type properties confidence deprecated_at deprecated_by created_at".split())


@query("""with c as (unpivot (select cast(event_id as varchar) event_id, cast(user_id as varchar) user_id, event_type, props from events) on event_id, user_id, event_type, props into name col value v)
 select x.col, (select count(*) from events) - count(c.v) filter (where trim(c.v) <> '') as null_count, count(distinct c.v) filter (where trim(c.v) <> '') as distinct_count from (select unnest(['event_id','user_id','event_type','props']) as col) x left join c using (col) group by 1""")
def column_profile(spark, d):
    return profile.column_profile(load(spark, d, "events").select("event_id", "user_id", "event_type", "props")).select("col", "null_count", "distinct_count")


@query("""select count(*) as rows_before, count(*) filter (where not b) as rows_after, round(0.4 * count(*) filter (where not b) / count(*) + 0.6, 3) as score
 from (select (lang is null or trim(lang) = '' or source is null or trim(source) = '') as b from documents)""")
def pipeline_score(spark, d):
    x = load(spark, d, "documents").select("doc_id", "lang", "source")
    return profile.retention_score(x, profile.drop_blank_rows(x))


@query("select distinct c_custkey, c_name, c_mktsegment from customer")
def split_wide_customer(spark, d):
    df = load(spark, d, "orders").join(load(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "right")
    return profile.split_table(df, {"customer": ["c_custkey", "c_name", "c_mktsegment", "nowhere"], "order": ["o_orderkey"]})["customer"]


@query("""with e as (select o_orderkey as k, 'o_orderstatus' as f, 'Z' as v, 1 as s from orders where o_orderkey % 7 = 0 union all select o_orderkey, 'o_orderstatus', 'Y', 2 from orders where o_orderkey % 14 = 0 union all select o_orderkey, 'o_orderpriority', null, 1 from orders where o_orderkey % 10 = 0),
 s as (select k, arg_max(v, s) as v from e where f = 'o_orderstatus' group by 1), p as (select k from e where f = 'o_orderpriority')
 select o_orderkey, o_custkey, case when s.k is not null then s.v else o_orderstatus end as o_orderstatus, case when p.k is not null then null else o_orderpriority end as o_orderpriority from orders left join s on s.k = o_orderkey left join p on p.k = o_orderkey""")
def review_edits(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    k = F.col("o_orderkey")
    e = lambda f, v, s, n: o.where(k % n == 0).select(k.cast("string").alias("row_pk"), F.lit(f).alias("field_name"), F.lit(v).cast("string").alias("new_value"), F.lit(s).alias("seq"))
    edits = e("o_orderstatus", "Z", 1, 7).unionByName(e("o_orderstatus", "Y", 2, 14)).unionByName(e("o_orderpriority", None, 1, 10))
    return profile.apply_edits(o, edits, "o_orderkey", "seq")


# -- nested records ---------------------------------------------------------------------------------------

@query("select event_id, user_id, event_type, cast(props->>'$.k' as bigint) as \"props.k\" from events")
def json_flatten_props(spark, d):
    e = load(spark, d, "events").select("event_id", "user_id", "event_type", F.from_json("props", "k long").alias("props"))
    return nested.flatten(e)


@query("select o_orderkey, l_linenumber as \"items.line\", l_partkey as \"items.part\", l_quantity as \"items.qty\" from orders join lineitem on l_orderkey = o_orderkey")
def json_explode_first_array(spark, d):
    li = load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_quantity").alias("qty"))).alias("items"))
    o = load(spark, d, "orders").select("o_orderkey").join(li, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "items")
    return nested.explode_first_array(o)


@query("select id, k as prop, properties->>('$.\"' || k || '\"') as value from entities, unnest(json_keys(properties)) as t(k)")
def property_pairs(spark, d):
    e = load(spark, d, "entities").select("id", F.explode(F.from_json("properties", "map<string,string>")).alias("prop", "value"))
    return e


# -- keys and links ---------------------------------------------------------------------------------------

_DIMS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey"}
_COLS = {"region": ["r_regionkey", "r_name"], "nation": ["n_nationkey", "n_name", "n_regionkey"], "customer": ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"], "supplier": ["s_suppkey", "s_name", "s_nationkey"], "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size"]}
_CELLS = " union all ".join(f"select '{t}' as dataset, '{c}' as col, trim(cast({c} as varchar)) as v from {t}" for t, cs in _COLS.items() for c in cs)


@query(f"""with x as ({_CELLS}), g as (select dataset, col, count(*) as n, count(v) filter (where v <> '') as filled, count(distinct v) filter (where v <> '') as distinct_count,
 count(*) filter (where v <> '' and length(v) >= 3) as long, coalesce(bool_and(regexp_matches(v, '^[0-9\\s.,%\\-]+$')) filter (where v <> ''), true) as numeric from x group by 1, 2)
 select dataset, col, n, filled, distinct_count, (n > 0 and filled = n and distinct_count = n) as is_unique, distinct_count <= 1 as constant, (filled >= 2 and not numeric and long >= 0.8 * filled and distinct_count >= 0.9 * filled) as alt_key from g""")
def key_candidates(spark, d):
    return links.key_profile({t: load(spark, d, t).select(*cs) for t, cs in _COLS.items()})


_CHAIN = {**_COLS, "orders": ["o_orderkey", "o_custkey", "o_orderstatus"], "lineitem": ["l_orderkey", "l_partkey", "l_suppkey"]}
_KEYS = {**_DIMS, "orders": "o_orderkey"}
_CHAIN_CELLS = " union all ".join(f"select '{t}' as dataset, '{c}' as col, upper(regexp_replace(trim(cast({c} as varchar)), '[\\s\\-_]', '', 'g')) as k from {t} where {c} is not null" for t, cs in _CHAIN.items() for c in cs)
_CHAIN_KEYS = " union all ".join(f"select distinct '{t}' as tgt, '{c}' as key, upper(regexp_replace(trim(cast({c} as varchar)), '[\\s\\-_]', '', 'g')) as k from {t}" for t, c in _KEYS.items())
_FK = f"""with c as ({_CHAIN_CELLS}), u as (select dataset, col, k, count(*) as n from c group by all), k as ({_CHAIN_KEYS}), t as (select dataset, col, count(*) as vals from u group by 1, 2),
 h as (select dataset, col, tgt, key, count(*) as matched, sum(n) as rows from u join k using (k) where dataset <> tgt group by all),
 f as (select dataset as src, col, tgt, key, vals, matched, cast(rows as bigint) as rows from h join t using (dataset, col) where matched >= 2 and matched >= 0.5 * vals) """


def _chain(spark, d):
    return {t: load(spark, d, t).select(*cs) for t, cs in _CHAIN.items()}


@query(_FK + "select src, col, tgt, key, vals as \"values\", matched, round(matched / vals, 6) as share from f")
def fk_value_overlap(spark, d):
    return links.foreign_keys(_chain(spark, d), _KEYS)


@query(_FK + "select src, col, tgt, key, 'HAS_' || upper(tgt) as rel_type, rows as match_count, case when matched = rows then 'one_to_one' else 'many_to_one' end as cardinality from f")
def infer_links_cardinality(spark, d):
    return links.infer_links(_chain(spark, d), _KEYS)


@query("select regexp_extract(upper(col), '^([A-Z]+)', 1) as prefix, count(*) as n from (select s_name as col from supplier) where regexp_matches(col, '^[A-Za-z]+[-_#]?[0-9]+$') group by 1")
def value_pattern_prefix(spark, d):
    s = load(spark, d, "supplier").select(F.regexp_replace("s_name", "#", "-").alias("s_name"))
    return links.value_patterns(s, ["s_name"]).select("prefix", "n")


@query("select a.c_custkey as left_key, min(b.c_name) as \"__key\" from customer a join customer b on upper(regexp_replace(a.c_name, '[\\s\\-_]', '', 'g')) = upper(regexp_replace(b.c_name, '[\\s\\-_]', '', 'g')) group by 1")
def normalized_key_join(spark, d):
    c = load(spark, d, "customer")
    src = c.select(F.col("c_custkey").alias("left_key"), F.lower(F.regexp_replace("c_name", "#", "-#_")).alias("typed"))
    tgt = c.select(F.regexp_replace("c_name", "#", "#").alias("c_name"))
    return links.key_join(src, "typed", tgt, "c_name").select("left_key", "__key")


@query("""with l as (select n_regionkey as src_key, string_agg(n_name, '，') as names from nation group by 1) select distinct src_key, n_nationkey as tgt_key from l, unnest(string_split(names, '，')) as t(x) join nation on upper(regexp_replace(n_name, '[\\s\\-_]', '', 'g')) = upper(regexp_replace(x, '[\\s\\-_]', '', 'g'))""")
def alt_key_multivalue_join(spark, d):
    n = load(spark, d, "nation")
    lists = n.groupBy("n_regionkey").agg(F.array_join(F.collect_list("n_name"), "，").alias("names"))
    return links.multi_value_join(lists, "names", n, "n_name", "n_regionkey", "n_nationkey")


@query("select count(*) as matches from orders where o_custkey in (select c_custkey from customer)")
def link_mapping_count(spark, d):
    return links.link_count(load(spark, d, "orders"), "o_custkey", load(spark, d, "customer"), "c_custkey")


@query("select l_orderkey, l_linenumber from lineitem where l_partkey not in (select p_partkey from part where p_size < 40)")
def orphan_refs(spark, d):
    p = load(spark, d, "part").where("p_size < 40").select(F.col("p_partkey").alias("l_partkey"))
    return load(spark, d, "lineitem").join(p, "l_partkey", "left_anti").select("l_orderkey", "l_linenumber")


_UUID5 = """substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12)"""


@query(f"""select {_UUID5} as instance_id, row_identity, source_row_count from (select 'c_custkey:' || c_custkey as row_identity, count(*) as source_row_count, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('o1:Customer:c_custkey:' || c_custkey)) as h from customer group by c_custkey)""")
def stable_instance_ids(spark, d):
    return links.instances(load(spark, d, "customer"), "o1", "Customer", "c_custkey")


@query("select o_orderkey as k, case when trim(coalesce(o_orderpriority, '')) <> '' then o_orderpriority else cast(o_orderkey as varchar) end as name from orders")
def display_names(spark, d):
    o = load(spark, d, "orders").withColumnRenamed("o_orderpriority", "title")
    return o.select(F.col("o_orderkey").alias("k"), links.display_name(["o_orderstatus", "title"], "o_orderkey").alias("name"))


# -- rules ------------------------------------------------------------------------------------------------

_RULES = [("r1", "required", "o_orderstatus", None), ("r2", "eq", "o_orderstatus", "F"), ("r3", "ne", "o_orderpriority", "1-URGENT"), ("r4", "gt", "o_totalprice", 100000), ("r5", "gte", "o_custkey", 75), ("r6", "lt", "o_totalprice", 250000), ("r7", "lte", "o_orderkey", 1000), ("r8", "in", "o_orderstatus", ["O", "P"])]


@query("""with r as (select unnest([{r:'r1', p: o_orderstatus is not null and o_orderstatus <> ''}, {r:'r2', p: o_orderstatus = 'F'}, {r:'r3', p: o_orderpriority <> '1-URGENT'}, {r:'r4', p: o_totalprice > 100000}, {r:'r5', p: o_custkey >= 75}, {r:'r6', p: o_totalprice < 250000}, {r:'r7', p: o_orderkey <= 1000}, {r:'r8', p: o_orderstatus in ('O', 'P')}]) as x from orders)
 select x.r as rule, case when x.p then 'passed' else 'failed' end as status, count(*) as n from r group by all""")
def rule_eval_all(spark, d):
    return rules.evaluate_rules(load(spark, d, "orders"), _RULES)


@query("""select 'documents' as dataset, col, cast(missing_count as bigint) as missing_count, n as row_count from (select count(*) as n, unnest(['lang', 'source', 'domain', 'ontology_id']) as col,
 unnest([count(*) filter (where lang is null or trim(lang) = ''), count(*) filter (where source is null or trim(source) = ''), count(*) filter (where domain is null or trim(domain) = ''), count(*) filter (where ontology_id is null or trim(ontology_id) = '')]) as missing_count from documents) where missing_count > 0""")
def missing_value_rules(spark, d):
    return rules.missing_value_rules(load(spark, d, "documents").select("lang", "source", "domain", "ontology_id"), "documents")


@query("select 'orders' as dataset, 'o_orderstatus' as col, string_agg(distinct o_orderstatus, ',' order by o_orderstatus) as states from orders union all select 'purchase_orders', '状态', string_agg(distinct 状态, ',' order by 状态) from purchase_orders where 状态 <> ''")
def state_discovery(spark, d):
    return rules.state_values(load(spark, d, "orders"), "orders").unionByName(rules.state_values(load(spark, d, "purchase_orders"), "purchase_orders"))


@query("""select 'events' as dataset, 'type' as rule, 'event_id' as col, 'bigint' as detail union all select 'events', 'type', 'ts', 'timestamp_ntz' union all select 'events', 'type', 'user_id', 'bigint' union all select 'events', 'type', 'event_type', 'string' union all select 'events', 'type', 'value', 'double' union all select 'events', 'type', 'props', 'string'""")
def rule_catalog(spark, d):
    return rules.rule_catalogue(load(spark, d, "events"), "events")


@query("""select cast(o_orderkey as varchar) as key, 'o_orderstatus' as field, o_orderstatus as old_value, 'X' as new_value from orders where o_orderkey % 5 = 0 and o_orderstatus <> 'X'""")
def before_after_diff(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return rules.changed_fields(o, rules.set_property(o, F.col("o_orderkey") % 5 == 0, "o_orderstatus", F.lit("X")), "o_orderkey")


@query("""select l_orderkey * 10 + l_linenumber as action_id, concat_ws(',', case when p_partkey is null then 'unknown_target' end, case when l_returnflag = 'N' then 'reason_required' end) as errors from lineitem left join (select p_partkey from part where p_size < 25) p on p_partkey = l_partkey""")
def action_submission_errors(spark, d):
    a = load(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("action_id"), F.col("l_partkey").alias("target_id"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("reason"))
    return rules.submission_errors(a, load(spark, d, "part").where("p_size < 25"), "p_partkey", ["reason"])


@query("""select id, round(greatest(0.30, least(0.98, coalesce(nullif(confidence, 0), 0.85) + case when properties is null or properties in ('', '{}') then -0.10 else 0 end + case when trim(coalesce(description, '')) = '' then -0.05 else 0 end + case when id in (select source_entity from relations union select target_entity from relations) then 0.05 else 0 end)), 3) as confidence
 from (select distinct * from entities) where confidence is null or confidence between 0 and 1""")
def confidence_calibration(spark, d):
    e = load(spark, d, "entities").distinct().where("confidence is null or confidence between 0 and 1")
    r = load(spark, d, "relations").select(F.explode(F.array("source_entity", "target_entity")).alias("id")).distinct().withColumn("hit", F.lit(True))
    return e.join(r, "id", "left").select("id", rules.calibrated("confidence", "properties", "description", F.coalesce("hit", F.lit(False))).alias("confidence"))


@query("""select id, name_cn, trim(regexp_replace(trim(regexp_replace(trim(name_cn), '[（(].*?[)）]', '', 'g')), '\\s+', ' ', 'g')) as clean,
 (length(name_cn) < 2 or regexp_matches(name_cn, '^[0-9]+$') or not regexp_matches(name_cn, '[\\p{L}\\p{N}]')) as junk, regexp_matches(name_cn, '(规则|政策|办法|制度|准则|细则|规程)$') as rule_like from (select distinct id, name_cn from entities)""")
def name_checks(spark, d):
    e = load(spark, d, "entities").select("id", "name_cn").distinct()
    return e.select("id", "name_cn", C.clean_name("name_cn").alias("clean"), C.junk_name("name_cn").alias("junk"), C.rule_name("name_cn").alias("rule_like"))


# -- joins, sets, aggregates, windows ---------------------------------------------------------------------

@query("select n_name, count(*) as customers, round(sum(o_totalprice), 2) as total from nation join customer on c_nationkey = n_nationkey join orders on o_custkey = c_custkey group by 1")
def joins_star(spark, d):
    j = load(spark, d, "orders").join(load(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(load(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.count("*").alias("customers"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
def joins_anti(spark, d):
    return load(spark, d, "customer").join(load(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query("select k, source from (select o_custkey as k, 'o' as source from orders union all select c_custkey, 'c' from customer) group by all")
def setops_union(spark, d):
    return load(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.lit("o").alias("source")).unionByName(load(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.lit("c").alias("source"))).distinct()


@query("(select c_custkey as k from customer intersect select o_custkey from orders) except select s_suppkey from supplier")
def setops_intersect_except(spark, d):
    c, o, s = load(spark, d, "customer").select(F.col("c_custkey").alias("k")), load(spark, d, "orders").select(F.col("o_custkey").alias("k")), load(spark, d, "supplier").select(F.col("s_suppkey").alias("k"))
    return c.intersect(o).subtract(s)


@query("select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, round(avg(l_discount), 6) as avg_disc, count(*) as n from lineitem where l_shipdate <= date '1998-09-02' group by 1, 2")
def pricing_summary(spark, d):
    li = load(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("select p_brand, coalesce(p_size, -1) as p_size, count(*) as n from part group by cube (p_brand, p_size)")
def rollup_cube(spark, d):
    return load(spark, d, "part").cube("p_brand", "p_size").agg(F.count("*").alias("n")).withColumn("p_size", F.coalesce("p_size", F.lit(-1)))


@query("select o_orderpriority, count(*) filter (where o_orderstatus = 'F') as \"F\", count(*) filter (where o_orderstatus = 'O') as \"O\", count(*) filter (where o_orderstatus = 'P') as \"P\" from orders group by 1")
def pivot_status(spark, d):
    return load(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).na.fill(0)


@query("select o_custkey, o_orderkey, r from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as r from orders) where r <= 3")
def window_rank(spark, d):
    w = W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return load(spark, d, "orders").withColumn("r", F.row_number().over(w).cast("long")).where("r <= 3").select("o_custkey", "o_orderkey", "r")


@query("select o_orderkey, round(sum(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey rows between 2 preceding and current row), 2) as moving, ntile(4) over (partition by o_custkey order by o_orderdate, o_orderkey) as quarter from orders")
def window_frames(spark, d):
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return load(spark, d, "orders").select("o_orderkey", F.round(F.sum("o_totalprice").over(w.rowsBetween(-2, 0)), 2).alias("moving"), F.ntile(4).over(w).cast("long").alias("quarter"))


@query("select 规格型号 as spec, 订单号 as order_no from (select distinct 规格型号, 订单号, try_cast(regexp_extract(规格型号, '^(-?[0-9]+(\\.[0-9]+)?)', 1) as double) as x from purchase_orders) order by x desc nulls last, order_no limit 25")
def numeric_prefix_sort(spark, d):
    p = load(spark, d, "purchase_orders").select(F.col("规格型号").alias("spec"), F.col("订单号").alias("order_no")).distinct()
    return p.orderBy(C.numeric_prefix("spec").desc_nulls_last(), "order_no").limit(25)


@query("select * from (select ontology_id, count(*) as n, count(distinct type) as types, max(created_at) as last from relations group by 1)")
def overview_by_project(spark, d):
    return load(spark, d, "relations").groupBy("ontology_id").agg(F.count("*").alias("n"), F.countDistinct("type").alias("types"), F.max("created_at").alias("last"))


@query("select doc_id, length(text) as chars, cast(ceil(length(text) / 4.0) as bigint) as tokens from documents")
def approximate_token_counts(spark, d):
    return load(spark, d, "documents").select("doc_id", F.length("text").cast("long").alias("chars"), C.approximate_tokens("text").alias("tokens"))


# -- exports ----------------------------------------------------------------------------------------------

@query("select 'entity' as record_type, id, name_cn, name_en, type, description, null as source, null as target, confidence from entities union all select 'relation', id, null, null, type, null, source_entity, target_entity, confidence from relations")
def export_one_table(spark, d):
    return exports.one_table(load(spark, d, "entities"), load(spark, d, "relations"))


@query("select id, trim(concat_ws(' ', nullif(trim(name_cn), ''), nullif(trim(name_en), ''), nullif(trim(type), ''), nullif(trim(description), ''), nullif(trim(properties), ''))) as text from entities")
def concept_texts(spark, d):
    return exports.concept_text(load(spark, d, "entities"))


@query()
def export_turtle(spark, d):
    return exports.turtle(load(spark, d, "entities"), load(spark, d, "relations"))


@query()
def export_cypher(spark, d):
    return exports.cypher(load(spark, d, "entities"), load(spark, d, "relations"))


# -- governance -------------------------------------------------------------------------------------------

@query("select l_orderkey, count(distinct l_partkey || ':' || l_suppkey) as inputs, sha256(string_agg(distinct l_partkey || ':' || l_suppkey, '|' order by l_partkey || ':' || l_suppkey)) as hash from lineitem group by 1")
def snapshot_hash_inputs(spark, d):
    return governance.input_hash(load(spark, d, "lineitem"), "l_orderkey", ["l_partkey", "l_suppkey"])


_BODY = "cast(event_id as varchar) || '|' || user_id || '|' || event_type"


@query(f"""with h as (select event_id, event_type, sha256({_BODY}) as event_hash, lag(sha256({_BODY})) over (partition by event_type order by ts, event_id) as previous_hash, ts, user_id from events),
 b as (select * replace (case when event_id % 50 = 0 then 'x' else event_hash end as event_hash) from h),
 v as (select *, lag(event_hash) over (partition by event_type order by ts, event_id) as prev, sha256({_BODY}) as own from b)
 select event_type, count(*) as events, count(*) filter (where event_hash is distinct from own) as altered, count(*) filter (where previous_hash is distinct from prev) as broken from v group by 1""")
def audit_chain_verify(spark, d):
    body = F.concat_ws("|", F.col("event_id").cast("string"), F.col("user_id").cast("string"), "event_type")
    e = governance.chained(load(spark, d, "events"), ["event_type"], ["ts", "event_id"], body)
    e = e.withColumn("event_hash", F.when(F.col("event_id") % 50 == 0, "x").otherwise(F.col("event_hash")))
    return governance.verify_chain(e, ["event_type"], ["ts", "event_id"], body)


@query("""select o_orderkey as key, case when o_orderkey % 11 = 0 then 'missing' else 'different' end as state from orders where o_orderkey % 11 = 0 or o_orderkey % 13 = 0 union all select -1 - s_suppkey, 'stale' from supplier""")
def reconcile_diff(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    k = F.col("o_orderkey")
    idx = o.where(k % 11 != 0).withColumn("o_orderstatus", F.when(k % 13 == 0, "!").otherwise(F.col("o_orderstatus"))).unionByName(load(spark, d, "supplier").select((-1 - F.col("s_suppkey")).alias("o_orderkey"), F.lit("O").alias("o_orderstatus")))
    return governance.reconcile(o, idx, "o_orderkey", "o_orderstatus")


@query("select 供应商类别 as class, coalesce(sum(try_cast(数量 as bigint)), 0)::bigint as qty, round(avg(try_cast(单价 as double)), 6) as price from purchase_orders group by 1")
def lineage_rollup(spark, d):
    p = load(spark, d, "purchase_orders").select(F.col("供应商类别").alias("class"), F.col("数量").alias("qty"), F.col("单价").alias("price"))
    return governance.quality_rollup(p, "class", ["qty"], ["price"])


@query("select r.id from (select distinct id, ontology_id, created_at from relations) r where created_at < timestamp '2025-01-01' and ontology_id not in (select id from ontology_projects where status = 'published')")
def retention_purge(spark, d):
    r = load(spark, d, "relations").select("id", "ontology_id", "created_at").distinct()
    hold = load(spark, d, "ontology_projects").where("status = 'published'").select(F.col("id").alias("ontology_id"))
    return governance.purgeable(r, "created_at", F.lit("2025-01-01").cast("timestamp_ntz"), "ontology_id", hold).select("id")


# -- ontology ---------------------------------------------------------------------------------------------

@query("""with e as (select distinct id as name, coalesce(type, '') as type, confidence from entities), r as (select source_entity as s, type as t, target_entity as o from relations), n as (select name from e)
 select 'unknown_type' as "check", 'warning' as severity, count(*) as n from e where type not in ('疾病', '药物', '物料', '财务概念', '部门', '企业', '组织', '人员', '供应商', '客户')
 union all select 'confidence_range', 'warning', count(*) from e where not coalesce(confidence between 0 and 1, false)
 union all select 'dangling_source', 'error', count(*) from r where s not in (select name from n) union all select 'dangling_target', 'error', count(*) from r where o not in (select name from n)
 union all select 'loop', 'warning', count(*) from r where s = o having count(*) > 0
 union all select 'repeated_triple', 'info', count(*) from (select 1 from r group by s, t, o having count(*) > 1)""")
def validation_findings(spark, d):
    from ..operators import ontology

    e = load(spark, d, "entities").select(F.col("id").alias("name"), F.coalesce("type", F.lit("")).alias("type"), "confidence").distinct()
    r = load(spark, d, "relations").select(F.col("source_entity").alias("source"), "type", F.col("target_entity").alias("target"))
    return ontology.violations(e, r, ("疾病", "药物", "物料", "财务概念", "部门", "企业", "组织", "人员", "供应商", "客户")).groupBy("check", "severity").agg(F.count("*").alias("n"))


@query("select id as key, case when properties is null then 'null' when not json_valid(properties) then 'invalid' when json_type(properties) = 'OBJECT' then 'object' when json_type(properties) = 'ARRAY' then 'array' else 'scalar' end as kind from entities")
def property_payloads(spark, d):
    return governance.property_findings(load(spark, d, "entities"), "id", "properties")


@query("""with a as (select distinct 物料类别 as name from purchase_orders where length(物料类别) >= 2), b as (select distinct 产品名称 as m from logistics_fulfillment union select distinct 物料名称 from purchase_orders union select '高级' || 物料类别 || '类' from purchase_orders where 物料类别 is not null), x as (select name, m, row_number() over (partition by name order by length(m), m) as r from a join b on length(m) >= 2 and (contains(m, name) or contains(name, m))) select name, m as "match" from x where r = 1""")
def containing_names(spark, d):
    from ..operators import ontology

    p = load(spark, d, "purchase_orders")
    known = load(spark, d, "logistics_fulfillment").select(F.col("产品名称").alias("n")).unionByName(p.select(F.col("物料名称").alias("n"))).unionByName(p.where(F.col("物料类别").isNotNull()).select(F.concat(F.lit("高级"), "物料类别", F.lit("类")).alias("n"))).distinct()
    return ontology.containing_name(p.select(F.col("物料类别").alias("n")).distinct(), known, "n")


@query("select o_orderkey, o_orderdate, true as truncated from orders order by o_orderkey limit 20")
def truncated_read(spark, d):
    from ..operators import ontology

    return ontology.truncated(load(spark, d, "orders").select("o_orderkey", "o_orderdate"), ["o_orderkey"], 20)


@query(f"""select {_UUID5} as relation_id, source, target, 'HAS_NATION' as type, 0.85 as confidence from (select distinct cast(c_custkey as varchar) as source, cast(n_nationkey as varchar) as target, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('o1:' || c_custkey || ':HAS_NATION:' || n_nationkey || ':c_nationkey')) as h from customer join nation on c_nationkey = n_nationkey)""")
def instance_relations(spark, d):
    from ..operators import ontology

    return ontology.row_links(load(spark, d, "customer"), "c_custkey", "c_nationkey", load(spark, d, "nation"), "n_nationkey", "o1", "HAS_NATION")


@query()
def ontology_build_rules(spark, d):
    from ..operators import ontology

    return ontology.build({t: load(spark, d, t) for t in ("region", "nation", "supplier")}, "o1")["rules"]


@query()
def ontology_build_links(spark, d):
    from ..operators import ontology

    return ontology.build({t: load(spark, d, t) for t in ("region", "nation", "supplier", "customer")}, "o1")["links"]


@query("select canonical_id, arg_max(id, (coalesce(length(name_cn), 0) + coalesce(length(description), 0), id)) as id from (select distinct * from entities) where canonical_id is not null group by 1")
def richest_record(spark, d):
    e = load(spark, d, "entities").where("canonical_id is not null").distinct()
    rich = F.coalesce(F.length("name_cn"), F.lit(0)) + F.coalesce(F.length("description"), F.lit(0))
    return e.groupBy("canonical_id").agg(F.max_by("id", F.struct(rich, "id")).alias("id"))


@query("select o_orderkey, o_orderstatus, version from (select o_orderkey, o_orderstatus, 1 as version from orders where o_orderkey % 3 <> 0 union all select o_orderkey, 'U', 2 from orders where o_orderkey % 3 = 0)")
def instance_upsert(spark, d):
    from ..streaming import incremental as inc

    o = load(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.lit(1).alias("version"))
    return inc.upsert(o, o.where("o_orderkey % 3 = 0").select("o_orderkey", F.lit("U").alias("o_orderstatus"), F.lit(2).alias("version")), "o_orderkey", "version")


@query("select rows, cast(cast(rows as varchar) = cast((select count(*) from orders) as varchar) as boolean) as same from (select count(*) as rows from orders)")
def content_hash_stable(spark, d):
    o = load(spark, d, "orders")
    a, b = governance.content_hash(o), governance.content_hash(o.orderBy(F.desc("o_orderkey"))).withColumnsRenamed({"rows": "r2", "content_hash": "h2"})
    return a.join(F.broadcast(b)).select("rows", (F.col("content_hash") == F.col("h2")).alias("same"))
