"""Immutable dataset versions: one folder each, a manifest beside them, readers pinned to a number."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.governance import content_hash

MANIFEST = "dataset string, version long, rows long, content_hash string, source_cursor string, provenance string"


def versions(spark: SparkSession, root: str, dataset: str) -> DataFrame:
    """The manifest's lines; none if there is no manifest yet. One that can't be read is an error."""
    try:
        return spark.read.schema(MANIFEST).json(f"{root}/{dataset}/manifest")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], MANIFEST)
        raise


def write_version(df: DataFrame, root: str, dataset: str, cursor: str | None = None, provenance: str | None = None) -> int:
    """The table as the next version. Data come first, the manifest's line last: a crash in between leaves no half version visible.

    A version's folder is never overwritten: of two writers of one number the second fails.
    """
    spark = df.sparkSession
    n = (versions(spark, root, dataset).agg(F.max("version")).first()[0] or 0) + 1
    path = f"{root}/{dataset}/v={n}"
    df.write.mode("errorifexists").parquet(path)
    h = content_hash(spark.read.parquet(path)).first()
    spark.createDataFrame([(dataset, n, h["rows"], h["content_hash"], cursor, provenance)], MANIFEST).coalesce(1).write.mode("append").json(f"{root}/{dataset}/manifest")
    return n


def read_version(spark: SparkSession, root: str, dataset: str, version: int | None = None) -> DataFrame:
    """A pinned version, else the latest; an unknown one is an error."""
    known = {r.version for r in versions(spark, root, dataset).select("version").collect()}
    n = version if version is not None else max(known, default=0)
    if n not in known:
        raise LookupError(f"{dataset} has no version {n}")
    return spark.read.parquet(f"{root}/{dataset}/v={n}")


def pinned(sources: list[str], pins: dict[str, list[int]]) -> dict[str, int]:
    """Exactly one version per source, or an error that names the sources without."""
    bad = sorted(s for s in sources if len(pins.get(s, [])) != 1)
    if bad:
        raise ValueError("pinned inputs incomplete: " + ", ".join(bad))
    return {s: pins[s][0] for s in sources}
