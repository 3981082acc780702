"""Nested records: structs to dotted columns, arrays to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T


def flat_columns(schema: T.StructType, sep: str = ".", max_depth: int = 10) -> list[tuple[str, str, T.DataType]]:
    """Paths, flat names and types of the leaves of a schema; arrays are leaves, structs beyond ``max_depth`` too."""
    out: list[tuple[str, str, T.DataType]] = []

    def walk(s: T.StructType, path: str, name: str, depth: int) -> None:
        for f in s.fields:
            p, n = (f"{path}.`{f.name}`" if path else f"`{f.name}`"), (f"{name}{sep}{f.name}" if name else f.name)
            if isinstance(f.dataType, T.StructType) and depth < max_depth:
                walk(f.dataType, p, n, depth + 1)
            else:
                out.append((p, n, f.dataType))

    walk(schema, "", "", 0)
    return out


def flatten(df: DataFrame, sep: str = ".", max_depth: int = 10) -> DataFrame:
    """Structs as dotted columns, by a walk over the schema only."""
    cols = [(F.to_json(F.col(p)) if isinstance(t, T.StructType) else F.col(p)).alias(n) for p, n, t in flat_columns(df.schema, sep, max_depth)]
    return df.select(*cols)


def explode_first_array(df: DataFrame, sep: str = ".", array: str | None = None) -> DataFrame:
    """One row per element of the first array column (or ``array``): fields of objects as ``<array><sep><field>``; other arrays as JSON text.

    Rows with an empty array stay, with the text ``[]`` where elements are no objects.
    """
    arrays = [f for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)]
    if not arrays:
        return df
    first = next(f for f in arrays if array in (None, f.name))
    rest: list[Column] = [F.to_json(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f"`{f.name}`") for f in df.schema.fields if f.name != first.name]
    e = df.select(*rest, F.size(F.col(f"`{first.name}`")).alias("__n"), F.explode_outer(F.col(f"`{first.name}`")).alias("__e"))
    t = first.dataType.elementType
    if isinstance(t, T.StructType):
        return e.select(*[F.col(f"`{c}`") for c in df.columns if c != first.name], *[F.col(f"__e.`{f.name}`").alias(f"{first.name}{sep}{f.name}") for f in t.fields])
    return e.select(*[F.col(f"`{c}`") for c in df.columns if c != first.name], F.when(F.col("__n") == 0, F.lit("[]")).otherwise(F.col("__e").cast("string")).alias(first.name))


def json_records(df: DataFrame, col: str, schema: str) -> DataFrame:
    """A column of JSON text as columns of the given schema, besides the others."""
    return df.withColumn("__j", F.from_json(col, schema)).select(*[c for c in df.columns if c != col], "__j.*")


def records_of(df: DataFrame, col: str, data_path: str | None = None) -> DataFrame:
    """The records of a REST reply: the array itself, or the one under ``data_path``, data, results, items or records, as VARIANT rows."""
    v = F.try_parse_json(col)
    paths = [f"$.{data_path}"] if data_path else []
    arr = F.coalesce(*[F.try_variant_get(v, p, "array<variant>") for p in ["$", *paths, "$.data", "$.results", "$.items", "$.records"]])
    return df.select(*[c for c in df.columns if c != col], F.explode(arr).alias("record"))
