"""Column functions: everything here is a built-in expression evaluated in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

WS = r"^\s+|\s+$"


def stripped(c: Column | str) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(F.col(c) if isinstance(c, str) else c, WS, "")


def is_blank(c: str) -> Column:
    return F.col(c).isNull() | (stripped(F.col(c).cast("string")) == "")


def key_value(c: Column | str) -> Column:
    """Keys that differ only in case, blanks, hyphens and underscores are one key."""
    c = F.col(c) if isinstance(c, str) else c
    return F.upper(F.regexp_replace(c.cast("string"), r"[\s\-_]", ""))


def folded_key(c: str) -> Column:
    """Lower case with white space collapsed."""
    return F.lower(F.regexp_replace(stripped(c), r"\s+", " "))


def clean_name(c: str) -> Column:
    """A name without bracketed annotations."""
    return F.regexp_replace(stripped(F.regexp_replace(stripped(c), r"[（(].*?[)）]", "")), r"\s+", " ")


# Endings of file names, of the names of rules, of enumerated values, of organisations, and units of thresholds.
FILES = ("md", "doc", "docx", "csv", "xls", "xlsx", "pdf", "ppt", "pptx", "json", "txt")
RULE_ENDINGS = ("规则", "政策", "办法", "制度", "准则", "细则", "规程")
GRADE_ENDINGS = ("轮融资", "阶段", "层", "级", "档", "类")
ORGANISATION_ENDINGS = ("公司", "集团", "科技", "物流", "铝业", "五金", "包装", "原材料")
UNITS = ("万元", "万", "吨", "件", "小时", "天", "%", "个月", "季度")


def _one_of(words: tuple[str, ...]) -> str:
    return "(?:" + "|".join(words) + ")"


def junk_name(c: str) -> Column:
    """Names that denote nothing: under two characters, only digits or marks, or a file's name."""
    last = F.element_at(F.split(c, "/"), -1)
    file = F.lower(F.substring_index(last, ".", -1)).isin(*FILES) & last.rlike(r"^[^\s.][^\s]*\.[^\s.]+$")
    content = F.regexp_replace(c, r"[^\p{L}\p{N}]", "")
    return (F.length(c) < 2) | (content == "") | F.col(c).rlike("^[0-9]+$") | file


def rule_name(c: str) -> Column:
    return any_of([F.endswith(F.col(c), F.lit(w)) for w in RULE_ENDINGS])


def enum_value_name(c: str) -> Column:
    """A grade, as ``A+级``, or a month class, as ``M3`` with or without the word for a stage."""
    grade = F.regexp_extract(c, rf"^(.*?){_one_of(GRADE_ENDINGS)}$", 1).rlike("^[A-Za-z]{1,2}[+-]?$")
    return grade | F.col(c).rlike(rf"^M[0-9]{{1,2}}\+?(?:{GRADE_ENDINGS[1]})?$")


def numeric_prefix(c: str) -> Column:
    """The number a text begins with; null without one."""
    return F.regexp_extract(stripped(c), r"^(-?[0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")


# Fixed value: the namespace of names that are URLs, as the standard gives it.
URL_NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"


def uuid5(name: Column, namespace: str = URL_NAMESPACE) -> Column:
    """The version 5 UUID of a name, without leaving the JVM."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def md5_uuid(name: Column) -> Column:
    """The MD5 of a name in the form of a UUID."""
    h = F.md5(name)
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def canonical_hash(*cols: str) -> Column:
    """SHA-256 over the columns as JSON with the keys in order."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(cols)])), 256)


def recency(days: Column) -> Column:
    return F.exp(-days / 30.0)


def backoff(attempt: Column, base: float = 1.0, cap: float = 3600.0) -> Column:
    """Exponential back-off from the first attempt on, capped."""
    return F.least(F.lit(cap), F.lit(base) * F.pow(F.lit(2.0), attempt - 1))


def approximate_tokens(c: str) -> Column:
    """Tokens of a text at four characters each; the exact count needs a tokenizer's files."""
    return F.ceil(F.length(c) / 4)


def parsed_time(c: str) -> Column:
    """ISO timestamps, else seconds since the epoch; null where neither is there."""
    s = stripped(c)
    return F.coalesce(F.try_to_timestamp(s), F.timestamp_seconds(F.when(s.rlike(r"^[0-9]{9,11}(\.[0-9]+)?$"), s.try_cast("double"))))


def iso_date(c: str, compat: bool = False) -> Column:
    """Dates in the three usual notations as YYYY-MM-DD; other texts unchanged.

    ``compat`` reads dates that end in the year month by month as they stand
    (day and month are not swapped) and leaves eight digits unpadded.
    """
    s = stripped(c)
    ymd, dmy, run = r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})$", r"^(\d{1,2})[-/](\d{1,2})[-/](\d{4})$", r"^(\d{4})(\d{2})(\d{2})$"
    part = lambda p, k: F.regexp_extract(s, p, k)
    two = lambda x: F.lpad(x, 2, "0")
    if compat:
        plain = lambda x: x.cast("int").cast("string")
        return (F.when(s.rlike(ymd), F.concat_ws("-", part(ymd, 1), two(part(ymd, 2)), two(part(ymd, 3))))
                .when(s.rlike(dmy), F.concat_ws("-", part(dmy, 3), two(part(dmy, 1)), two(part(dmy, 2))))
                .when(s.rlike(run), F.concat_ws("-", plain(part(run, 1)), plain(part(run, 2)), plain(part(run, 3)))).otherwise(s))
    return (F.when(s.rlike(ymd), F.concat_ws("-", part(ymd, 1), two(part(ymd, 2)), two(part(ymd, 3))))
            .when(s.rlike(dmy), F.concat_ws("-", part(dmy, 3), two(part(dmy, 2)), two(part(dmy, 1))))
            .when(s.rlike(run), F.concat_ws("-", part(run, 1), part(run, 2), part(run, 3))).otherwise(s))


def organisations(c: str, most: int | None = None) -> Column:
    """Organisations a text names, each once; all of them unless a limit is given."""
    found = F.array_distinct(F.regexp_extract_all(c, F.lit(rf"[一-龥]{{2,10}}{_one_of(ORGANISATION_ENDINGS)}"), F.lit(0)))
    return F.slice(found, 1, most) if most else found


def thresholds(c: str, most: int | None = None) -> Column:
    """Numbers of two digits or more that a unit follows; all of them unless a limit is given."""
    found = F.regexp_extract_all(c, F.lit(rf"(\d[\d,.]+)\s*{_one_of(UNITS)}"), F.lit(1))
    return F.slice(found, 1, most) if most else found


def any_of(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds, F.lit(False))


def all_of(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conds, F.lit(True))
