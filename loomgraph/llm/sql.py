"""SQL that states what the queries of this subpackage return, where SQL can."""

from __future__ import annotations

from .fusion import D5, P5, STAND_INS


def _verhoeff() -> str:
    rows, row = [], list(range(10))
    for _ in range(8):
        rows += row
        row = [row[x] for x in P5]
    return (
        f"list_reduce(list_prepend(0, list_transform(range(0, length(s)), lambda i: {rows}[(i % 8) * 10 + cast(substr(s, length(s) - i, 1) as int) + 1])), lambda a, x: {list(D5)}[a * 10 + x + 1]) = 0"
    )


def p4_found() -> str:
    stand = ", ".join("'" + s.replace("/", "") + "'" for s in STAND_INS)
    text = (
        "({c} is not null and bare_{c} <> '' and bare_{c} not in (" + stand + ") and not regexp_matches(t_{c}, '(\\.{{2,}}|[…⋯]+|。{{2,}})[\\s”\"』」）)]*$')"
        " and not regexp_matches(t_{c}, '[（(\\[【](未完|截断|待续|省略)[^）)\\]】]{{0,4}}[）)\\]】]?$') and not regexp_matches(t_{c}, '[（(【\\[][^）)】\\]]{{0,6}}$')"
        " and not regexp_matches(t_{c}, '[�□]|\\?\\?|锟斤拷|ï¼'))"
    )
    trim = "regexp_replace({c}, '^[\\s　]+|[\\s　]+$', '', 'g')"
    bare = "lower(regexp_replace({c}, '[\\s!-/:-@\\[-`{{-~。，、；：？！—–…⋯（）【】《》“”]+', '', 'g'))"
    cols = ", ".join(f"{trim.format(c=c)} as t_{c}, {bare.format(c=c)} as bare_{c}" for c in ("name_cn", "description", "snomed_id"))
    return f"""
with e as (select distinct id, canonical_id, name_cn, description, snomed_id, confidence, updated_at, {cols} from entities where canonical_id is not null and deprecated_at is null),
g as (select canonical_id from e group by 1 having count(distinct id) > 1),
r as (select e.*, case when confidence between 0 and 1 then confidence end as conf from e join g using (canonical_id)),
s as (select *, t_snomed_id as s from r where regexp_full_match(t_snomed_id, '[0-9]{{6,18}}')),
f as (
  select canonical_id, 'name_cn' as field, id, row_number() over (partition by canonical_id order by conf desc nulls last, updated_at desc, id) as k from r where {text.format(c='name_cn')}
  union all select canonical_id, 'description', id, row_number() over (partition by canonical_id order by length(t_description) desc, conf desc nulls last, updated_at desc, id) from r where {text.format(c='description')}
  union all select canonical_id, 'snomed_id', id, row_number() over (partition by canonical_id order by updated_at desc, conf desc nulls last, id) from s where {_verhoeff()}
  union all select canonical_id, 'confidence', id, row_number() over (partition by canonical_id order by conf desc, updated_at desc, id) from r where conf is not null)
select canonical_id, field, id as entity_id from f where k = 1"""


def oracle_sql() -> dict[str, str]:
    return {"p4_found": p4_found()}
