"""Types, cleansing and quality of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from ..functions.columns import all_of, is_blank, stripped

# Fixed value: what counts as a date or time when types are inferred.
DATES = r"^[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}|^[0-9]{1,2}[-/][0-9]{1,2}[-/][0-9]{4}|^[0-9]{8}$"
INTEGER = r"^[+-]?[0-9]+(_[0-9]+)*$"
FLOAT = r"(?i)^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|inf(inity)?|nan)$"
PRIORITY = ("timestamp", "integer", "float", "boolean", "string", "null")


def value_type(c: Column) -> Column:
    """The type of one text: null, timestamp, boolean, integer, float or string, tested in this order."""
    s = stripped(c)
    bare = F.regexp_replace(s, ",", "")
    return (F.when(s.isNull() | F.lower(s).isin("", "none", "null", "nan"), "null").when(s.rlike(DATES), "timestamp")
            .when(F.lower(s).isin("true", "false", "yes", "no", "1", "0"), "boolean").when(bare.rlike(INTEGER), "integer").when(bare.rlike(FLOAT), "float").otherwise("string"))


def inferred_schema(df: DataFrame, order: list[str], rows: int = 10) -> DataFrame:
    """``col, type``: the majority type of each column over the first ``rows`` rows by ``order``; ties go to the more specific type.

    Blank cells don't vote; a column without votes is a string.
    """
    first = df.orderBy(*order).limit(rows)
    cells = first.select(F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(f"`{c}`").cast("string").alias("v")) for c in df.columns])).alias("x")).select("x.*")
    votes = cells.where(F.col("v").isNotNull() & (stripped("v") != "")).groupBy("col", value_type(F.col("v")).alias("type")).agg(F.count("*").alias("n"))
    rank = F.array_position(F.array(*[F.lit(p) for p in PRIORITY]), F.col("type"))
    best = votes.groupBy("col").agg(F.max_by("type", F.struct("n", -rank)).alias("type"))
    return cells.select("col").distinct().join(best, "col", "left").select("col", F.coalesce("type", F.lit("string")).alias("type"))


def drop_blank_rows(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Rows in which no cell is null or blank."""
    return df.where(all_of([~is_blank(c) for c in cols or df.columns]))


def fill_blank(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Null and blank cells as empty texts, others without white space at their ends."""
    return df.withColumns({c: F.coalesce(stripped(F.col(c).cast("string")), F.lit("")) for c in cols or df.columns})


def mark_blank(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Filled cells and ``__null_<col>__`` = '1' where they were blank, else null."""
    cs = cols or df.columns
    marks = {f"__null_{c}__": F.when(is_blank(c), F.lit("1")) for c in cs}
    return fill_blank(df.withColumns(marks), cs)


def trimmed(df: DataFrame) -> DataFrame:
    return df.withColumns({c: stripped(c) for c, t in df.dtypes if t == "string"})


def drop_jagged(df: DataFrame, cells: str, columns: int) -> DataFrame:
    """Rows whose array of cells has more cells than there are columns are dropped; short rows are filled by the scan."""
    return df.where(F.size(cells) <= columns)


def column_profile(df: DataFrame) -> DataFrame:
    """``col, null_count, null_pct, distinct_count, type`` in one pass over the table.

    Distinct values are counted exactly; types come from every value, so a
    column of two kinds is mixed wherever the odd value stands.
    """
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(f"`{c}`").cast("string").alias("v")) for c in df.columns])).alias("x")).select("x.*")
    blank = F.col("v").isNull() | (stripped("v") == "")
    s = stripped("v")
    t = F.when(s.rlike(INTEGER), "integer").when(s.rlike(FLOAT), "float").when(F.lower(s).isin("true", "false"), "boolean").otherwise("string")
    # values first, so that a frequent value crosses the shuffle once a task
    by_value = cells.groupBy("col", F.when(~blank, F.col("v")).alias("v")).agg(F.count("*").alias("n"))
    by_value = by_value.withColumn("t", F.when(F.col("v").isNotNull(), t))
    p = by_value.groupBy("col").agg(
        F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("null_count"), F.sum("n").alias("rows"),
        F.count("v").alias("distinct_count"), F.max(F.when(F.col("t") == "integer", 1).otherwise(0)).alias("i"), F.max(F.when(F.col("t") == "float", 1).otherwise(0)).alias("f"),
        F.max(F.when(F.col("t") == "boolean", 1).otherwise(0)).alias("b"), F.max(F.when(F.col("t") == "string", 1).otherwise(0)).alias("s"))
    kinds = F.col("i") + F.col("f") + F.col("b") + F.col("s")
    kind = (F.when(kinds == 0, "null").when((F.col("b") + F.col("s")) == 0, F.when(F.col("f") == 1, "float").otherwise("integer"))
            .when(kinds > 1, "mixed").when(F.col("b") == 1, "boolean").otherwise("string"))
    return p.select("col", "null_count", F.round(F.col("null_count") / F.col("rows") * 100, 6).alias("null_pct"), "distinct_count", kind.alias("type"), "rows")


def quality_report(df: DataFrame) -> DataFrame:
    """One row: rows, columns, completeness, uniqueness, validity, overall and the number of duplicate rows; an empty table scores 1."""
    k = len(df.columns)
    p = column_profile(df).agg(F.avg(F.col("null_pct") / 100).alias("nulls"), F.count_if(F.col("type") == "mixed").alias("mixed"))
    rows = df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"), F.count("*").alias("d"))
    x = rows.join(F.broadcast(p))  # one row each
    one = lambda c: F.when(F.col("row_count") == 0, 1.0).otherwise(c)
    comp, uniq, valid = 1 - F.col("nulls"), 1 - (F.col("row_count") - F.col("d")) / F.col("row_count"), 1 - F.col("mixed") / k
    return x.select(
        "row_count", F.lit(k).cast("long").alias("column_count"), F.round(one(comp), 6).alias("completeness"), F.round(one(uniq), 6).alias("uniqueness"),
        F.round(one(valid), 6).alias("validity"), F.round(one(0.4 * comp + 0.4 * uniq + 0.2 * valid), 6).alias("overall"), (F.col("row_count") - F.col("d")).alias("duplicate_count"))


def retention_score(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: 0.4 times the rows kept plus 0.6 times the cells filled."""
    b = before.agg(F.count("*").alias("b"))
    filled = sum((~is_blank(c)).cast("long") for c in after.columns)
    a = after.agg(F.count("*").alias("a"), F.coalesce(F.sum(filled), F.lit(0)).alias("f"))
    kept = F.when(F.col("b") > 0, F.col("a") / F.col("b")).otherwise(1.0)
    full = F.when(F.col("a") > 0, F.col("f") / (F.col("a") * len(after.columns))).otherwise(0.0)
    return b.join(F.broadcast(a)).select(F.col("b").alias("rows_before"), F.col("a").alias("rows_after"), F.round(0.4 * kept + 0.6 * full, 3).alias("score"))


def split_table(df: DataFrame, groups: dict[str, list[str]]) -> dict[str, DataFrame]:
    """One distinct projection per group of columns; unknown columns are ignored, groups without known ones left out."""
    found = {k: [c for c in cs if c in df.columns] for k, cs in groups.items()}
    return {k: df.select(*cs).distinct() for k, cs in found.items() if cs}


def suggested_split(columns: list[str], width: int = 80) -> dict[str, list[str]]:
    """Two halves of a table that is at least ``width`` columns wide; none for narrower ones."""
    if len(columns) < width:
        return {}
    h = (len(columns) + 1) // 2
    return {"part_1": columns[:h], "part_2": columns[h:]}


def apply_edits(df: DataFrame, edits: DataFrame, pk: str, order: str) -> DataFrame:
    """Cell edits ``row_pk, field_name, new_value`` applied; the last by ``order`` wins, a null new value empties the cell.

    Edits are pivoted to one row per key first, so the table is joined once.
    Edits of unknown rows or fields change nothing.
    """
    last = edits.groupBy("row_pk", "field_name").agg(F.max_by(F.struct("new_value"), order).alias("e"))
    wide = last.groupBy("row_pk").agg(F.map_from_entries(F.collect_list(F.struct("field_name", F.col("e.new_value")))).alias("m"))
    j = df.join(wide, df[pk].cast("string") == wide["row_pk"], "left")
    has = lambda c: F.coalesce(F.array_contains(F.map_keys("m"), c), F.lit(False))
    types = dict(df.dtypes)
    return j.select(*[df[c] if c == pk else F.when(has(c), F.try_element_at("m", F.lit(c)).try_cast(types[c])).otherwise(df[c]).alias(c) for c in df.columns])


def first_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by ``order``."""
    return df.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")


def observed(df: DataFrame, name: str = "rows"):
    """The table and an observation that counts its rows and nulls while it is computed for something else."""
    from pyspark.sql import Observation

    o = Observation(name)
    return df.observe(o, F.count("*").alias("rows"), *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in df.columns]), o
