"""Rules as data: predicates from rule rows, rule discovery, diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import is_blank, stripped


def rule_status(op: str, field: str, value: object) -> Column:
    """``passed``, ``failed`` or ``error`` of one rule on a row; numbers are compared as doubles, equality as text.

    A value that is no number makes a numeric comparison an error, as does an
    unknown operator.
    """
    c = F.col(field)
    text, number = c.cast("string"), c.try_cast("double") if not isinstance(value, (list, tuple)) else None
    op = op.lower()
    if op in ("required", "non_empty"):
        ok = c.isNotNull() & (text != "")
    elif op in ("equals", "eq"):
        ok = F.coalesce(text, F.lit("None")) == str(value)
    elif op in ("not_equals", "ne"):
        ok = F.coalesce(text, F.lit("None")) != str(value)
    elif op in ("gt", "gte", "lt", "lte"):
        right = F.lit(str(value)).try_cast("double")
        ok = {"gt": number > right, "gte": number >= right, "lt": number < right, "lte": number <= right}[op]
    elif op == "in":
        ok = F.coalesce(text.isin(*[str(v) for v in value]), F.lit(False))
    else:
        return F.lit("error")
    return F.when(ok.isNull(), "error").when(ok, "passed").otherwise("failed")


def evaluate_rules(df: DataFrame, rules: list[tuple[str, str, str, object]]) -> DataFrame:
    """``rule, status, n`` of rules (name, operator, field, value) over a table, in one pass."""
    stack = F.array(*[F.struct(F.lit(name).alias("rule"), rule_status(op, field, value).alias("status")) for name, op, field, value in rules])
    return df.select(F.explode(stack).alias("x")).groupBy("x.rule", "x.status").agg(F.count("*").alias("n"))


def missing_value_rules(df: DataFrame, dataset: str) -> DataFrame:
    """``dataset, col, missing_count, row_count`` of columns that lack values."""
    one = df.agg(F.count("*").alias("n"), *[F.count_if(is_blank(c)).alias(c) for c in df.columns])
    rows = F.array(*[F.struct(F.lit(c).alias("col"), F.col(f"`{c}`").alias("missing_count"), F.col("n").alias("row_count")) for c in df.columns])
    return one.select(F.explode(rows).alias("x")).select(F.lit(dataset).alias("dataset"), "x.*").where("missing_count > 0")


STATE_WORDS = ("status", "state", "状态", "阶段")


def state_values(df: DataFrame, dataset: str, words: tuple[str, ...] = STATE_WORDS) -> DataFrame:
    """``dataset, col, states``: sorted values of the columns that are named like a state."""
    cols = [c for c in df.columns if any(w in c.lower() for w in words)]
    if not cols:
        return df.sparkSession.createDataFrame([], "dataset string, col string, states string")
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("v")) for c in cols])).alias("x")).select("x.*")
    return cells.where("v is not null and v != ''").distinct().groupBy("col").agg(F.array_join(F.sort_array(F.collect_list("v")), ",").alias("states")).select(F.lit(dataset).alias("dataset"), "col", "states")


def rule_catalogue(df: DataFrame, dataset: str) -> DataFrame:
    """Rules a table suggests: completeness, states and a type contract per column, as ``dataset, rule, col, detail``."""
    types = df.sparkSession.createDataFrame([(c, t) for c, t in df.dtypes], "col string, detail string")
    parts = [
        missing_value_rules(df, dataset).select("dataset", F.lit("completeness").alias("rule"), "col", F.format_string("%d of %d missing", "missing_count", "row_count").alias("detail")),
        state_values(df, dataset).select("dataset", F.lit("state").alias("rule"), "col", F.col("states").alias("detail")),
        types.select(F.lit(dataset).alias("dataset"), F.lit("type").alias("rule"), "col", "detail"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def changed_fields(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """``key, field, old_value, new_value`` of every cell that differs; rows on one side only differ in all cells."""
    cols = [c for c in before.columns if c != key and c in after.columns]
    cell = lambda d, n: d.select(F.col(key).cast("string").alias("key"), F.explode(F.create_map(*[x for c in cols for x in (F.lit(c), F.col(c).cast("string"))])).alias("field", n))
    j = cell(before, "old_value").join(cell(after, "new_value"), ["key", "field"], "full")
    return j.where(~F.col("old_value").eqNullSafe(F.col("new_value")))


def set_property(df: DataFrame, when: Column, col: str, value: Column) -> DataFrame:
    """The effect of an action on the rows it applies to; other rows as they are."""
    return df.withColumn(col, F.when(when, value.cast(dict(df.dtypes)[col])).otherwise(F.col(col)))


def submission_errors(actions: DataFrame, objects: DataFrame, key: str, required: list[str]) -> DataFrame:
    """``action_id, errors``: what keeps an action from being submitted: a missing target, an unknown one, missing parameters."""
    o = objects.select(F.col(key).cast("string").alias("k")).distinct().withColumn("known", F.lit(True))
    x = actions.join(o, F.col("target_id").cast("string") == F.col("k"), "left")
    errs = F.filter(F.array(F.when(is_blank("target_id"), F.lit("target_required")).when(F.col("known").isNull(), F.lit("unknown_target")), *[F.when(is_blank(p), F.lit(f"{p}_required")) for p in required]), lambda e: e.isNotNull())
    return x.select("action_id", F.array_join(errs, ",").alias("errors"))


def richest(df: DataFrame, key: str, cols: list[str], order: str) -> DataFrame:
    """Per key the record with the most text, its blank cells filled from the others by ``order``."""
    rich = sum(F.coalesce(F.length(F.col(c).cast("string")), F.lit(0)) for c in cols)
    x = df.withColumn("__rich", rich)
    picks = [F.coalesce(F.max_by(F.when(~is_blank(c), F.col(c)), F.when(~is_blank(c), F.struct(F.col("__rich"), F.col(order)))), F.lit(None)).alias(c) for c in cols]
    return x.groupBy(key).agg(*picks)


def calibrated(confidence: str, properties: str, description: str, linked: Column) -> Column:
    """A confidence moved by completeness and links, kept within 0.30 and 0.98."""
    base = F.coalesce(F.when(F.col(confidence) != 0, F.col(confidence)), F.lit(0.85))
    adj = F.when(F.col(properties).isNull() | F.col(properties).isin("", "{}"), -0.10).otherwise(0.0) + F.when(F.coalesce(stripped(description), F.lit("")) == "", -0.05).otherwise(0.0) + F.when(linked, 0.05).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.30), F.least(F.lit(0.98), base + adj)), 3)
