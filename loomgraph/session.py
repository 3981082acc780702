"""Session factory, table loading and lineage cuts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN_DIRS: list[str] = []


def session(app: str = "loomgraph", master: str = "local[8]", **conf: str) -> SparkSession:
    """A session with the settings the operators expect; cluster settings win where they are already given."""
    b = SparkSession.builder.appName(app).master(master)
    base = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.sql.files.openCostInBytes": "1m",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "20g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in {**base, **conf}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; only where it is unset, a folder of this process (local mode, tests)."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _OWN_DIRS:
        _OWN_DIRS.append(tempfile.mkdtemp(prefix="loomgraph-"))
        atexit.register(shutil.rmtree, _OWN_DIRS[0], True)
    return "file://" + _OWN_DIRS[0]


def scratch(spark: SparkSession) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/loomgraph/{os.getpid()}-{uuid.uuid4().hex}"


def cut(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back.

    The plan behind it is not computed again and its rows survive the loss of
    any executor, as checkpoint files do, but in compressed columnar form and
    in one pass.
    """
    spark = df.sparkSession
    path = path or scratch(spark)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path below the shared folder."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
