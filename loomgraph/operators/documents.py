"""Documents to records: rules, tables, definitions, sections, chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

# The wordings of rules, definitions, headings, numbered titles and tables that count.
RULE_THEN = r"(?im)IF[ \t]+(.+?)[ \t]+THEN[ \t]+(.+?)$"
RULE_COMMA = r"(?im)^[ \t]*IF[ \t]+([^,，\n]+?)[,，][ \t]*((?:(?!\bTHEN\b).)+)$"
DEFINITION = r"(?m)^\s*([A-Za-z一-龥][\w一-龥 /\-]{0,40}?)\s*[(（]([^)）\n]{1,40})[)）]\s*[:：]\s*(.+)$"
HEADING = r"^#{1,6}\s+\S"
NUMBERED = r"^[ \t]*\d+[.、)][ \t]+\S.{0,60}$"
NUMBERED_STEP = r"^[ \t]*\d+[.、)][ \t]+(?i)(?:if|step)\b"
TABLE = r"(?m)^[ \t]*\|[^\n]*\n[ \t]*\|*[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{3,}:?[ \t]*)*\|*[ \t]*$(?:\n[ \t]*\|[^\n]*)*"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` computed once for each row."""
    return F.transform(F.array(value), use)[0]


def bare(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def rules(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, rule_index, condition, action`` of IF ... THEN ... and IF ..., ... lines."""
    pairs = lambda p: F.arrays_zip(F.regexp_extract_all(text, F.lit(p), F.lit(1)).alias("condition"), F.regexp_extract_all(text, F.lit(p), F.lit(2)).alias("action"))
    both = F.concat(pairs(RULE_THEN), pairs(RULE_COMMA))
    return docs.select(F.col(key).alias("key"), F.posexplode(both).alias("i", "r")).select("key", (F.col("i") + 1).alias("rule_index"), F.trim(F.col("r")["condition"]).alias("condition"), F.trim(F.col("r")["action"]).alias("action"))


def definitions(docs: DataFrame, key: str, text: str, most: int | None = None, longest: int | None = None) -> DataFrame:
    """``key, name, qualifier, definition`` of lines ``Name (qualifier): text``; all of them and whole, unless limits are given."""
    g = [F.regexp_extract_all(text, F.lit(DEFINITION), F.lit(k)) for k in (1, 2, 3)]
    z = F.arrays_zip(g[0].alias("name"), g[1].alias("qualifier"), g[2].alias("definition"))
    d = F.col("d")["definition"]
    return docs.select(F.col(key).alias("key"), F.explode(F.slice(z, 1, most) if most else z).alias("d")).select(
        "key", F.trim(F.col("d")["name"]).alias("name"), F.trim(F.col("d")["qualifier"]).alias("qualifier"), (F.substring(d, 1, longest) if longest else d).alias("definition"))


def headings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, level, title, line`` of Markdown headings."""
    lines = docs.select(F.col(key).alias("key"), F.posexplode(F.split(text, r"\r?\n")).alias("line", "l"))
    return lines.where(F.col("l").rlike(r"^#{1,6}\s+\S")).select("key", F.length(F.regexp_extract("l", "^(#{1,6})", 1)).alias("level"), F.trim(F.regexp_extract("l", r"^#{1,6}\s+(.+)$", 1)).alias("title"), "line")


def sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, section_index, title, body`` at Markdown headings, else at numbered titles, else of the whole text.

    What stands before the first title belongs to no section, and sections
    without a body are left out. Lines are classified within the row, so no
    text is shuffled.
    """
    at = lambda ls, test: F.filter(F.sequence(F.lit(0), F.size(ls) - 1), lambda i: test(F.get(ls, i)))
    numbered = lambda l: l.rlike(NUMBERED) & ~l.rlike(NUMBERED_STEP)
    title = lambda l: bare(F.regexp_replace(l, r"^\s*(?:#{1,6}|\d+[.、)])\s+", ""))
    part = lambda t, b: F.struct(t.alias("title"), bare(b).alias("body"))

    def parts(ls: Column) -> Column:
        def by(marks: Column) -> Column:
            body = lambda m, k: F.array_join(F.slice(ls, m + 2, F.coalesce(F.get(marks, k + 1), F.size(ls)) - m - 1), "\n")
            return F.when(F.size(marks) > 0, F.transform(marks, lambda m, k: part(title(F.get(ls, m)), body(m, k)))).otherwise(F.array(part(F.lit(""), F.array_join(ls, "\n"))))

        heads = lambda h: F.when(F.size(h) > 0, h).otherwise(at(ls, numbered))
        return let(let(at(ls, lambda l: l.rlike(HEADING)), heads), by)

    full = F.filter(let(F.split(text, r"\r?\n"), parts), lambda x: x["body"] != "")
    return docs.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.posexplode(full).alias("i", "s")).select("key", (F.col("i") + 1).alias("section_index"), "s.title", "s.body")


def tables(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, table_index, row_index, col, cell`` of Markdown tables; rows of another width than the header's are left out.

    A table is one match of :data:`TABLE`, a line of cells, a ruling and
    further lines of cells.
    """
    cells = lambda l: F.transform(F.split(F.regexp_replace(bare(l), r"^\|+|\|+$", ""), r"\|"), bare)
    blocks = docs.where(F.col(text).contains("|")).select(F.col(key).alias("key"), F.posexplode(F.regexp_extract_all(F.regexp_replace(text, r"\r\n", "\n"), F.lit(TABLE), F.lit(0))).alias("t", "block"))
    lines = blocks.select("key", (F.col("t") + 1).alias("table_index"), F.transform(F.split("block", "\n"), cells).alias("rows"))
    wide = lines.select("key", "table_index", F.get("rows", F.lit(0)).alias("head"), F.posexplode(F.filter(F.slice("rows", 3, F.greatest(F.size("rows"), F.lit(1))), lambda r: F.size(r) == F.size(F.get("rows", F.lit(0))))).alias("r", "cells"))
    named = F.transform("head", lambda h, i: F.when(h == "", F.concat(F.lit("col_"), (i + 1).cast("string"))).otherwise(h))
    return wide.select("key", "table_index", (F.col("r") + 1).alias("row_index"), F.explode(F.arrays_zip(named.alias("col"), F.col("cells").alias("cell"))).alias("x")).select("key", "table_index", "row_index", "x.col", "x.cell")


def chunks(docs: DataFrame, key: str, text: str, most: int = 12_000, overlap: int = 500) -> DataFrame:
    """``key, chunk_index, chunk``: a text in chunks of about ``most`` characters that end where sections do, without headings where paragraphs do.

    Chunks are stretches of the text: each but the first begins ``overlap``
    characters before the end of the one before. A section longer than
    ``most`` stays whole. Only the lengths of the sections are folded.
    """
    t = F.col(text)
    heads = F.split(t, r"(?m)(?=^#{1,3}[ \t]+\S)")
    parts = F.when(F.size(heads) > 1, heads).otherwise(F.split(t, r"(?<=\n\n)"))
    span = lambda a, b: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"))
    state = lambda a, b, out: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"), out.alias("out"))

    def add(s: Column, n: Column) -> Column:
        a, b = s["a"], s["b"]
        full = (b > a) & (b - a + n > most)
        return state(F.when(full, b - F.least(F.lit(overlap), b - a)).otherwise(a), b + n, F.when(full, F.concat(s["out"], F.array(span(a, b)))).otherwise(s["out"]))

    none = F.array().cast("array<struct<a:int,b:int>>")
    spans = F.aggregate(F.transform(parts, lambda p: F.length(p)), state(F.lit(0), F.lit(0), none), add, lambda s: F.concat(s["out"], F.array(span(s["a"], s["b"]))))
    spans = F.when(F.length(t) <= most, F.array(span(F.lit(0), F.length(t)))).otherwise(spans)
    return docs.where(F.length(t) > 0).select(F.col(key).alias("key"), t.alias("t"), F.posexplode(spans).alias("i", "s")).select("key", (F.col("i") + 1).alias("chunk_index"), F.expr("substring(t, s.a + 1, s.b - s.a)").alias("chunk"))


def document_score(docs: DataFrame, key: str, fields: list[str], rules: str) -> DataFrame:
    """``key, score``: the share of filled fields and 0.04 for each rule found, 0.2 at most, together 1 at most."""
    filled = sum((F.coalesce(bare(F.col(f).cast("string")) != "", F.lit(False)).cast("int") for f in fields), F.lit(0)) / max(len(fields), 1)
    bonus = F.least(F.lit(0.2), F.coalesce(F.col(rules), F.lit(0)) * 0.04)
    return docs.select(F.col(key).alias("key"), F.round(F.least(F.lit(1.0), filled + bonus), 6).alias("score"))
