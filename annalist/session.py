"""Sessions, the shared folder for cut lineage, and tables kept in it."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from contextlib import suppress

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []
_kept: dict[tuple, DataFrame] = {}


def _clean() -> None:
    """Deletes the tables this program wrote for itself, when it ends."""
    spark = SparkSession.getActiveSession()
    for path in _written if spark else ():
        with suppress(Exception):
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


atexit.register(_clean)


def build_session(app: str = "annalist", master: str | None = None, cpus: int | None = None, **conf: str) -> SparkSession:
    """A session with the defaults this library is tuned for.

    Partition counts follow the data: adaptive execution coalesces and splits them, so the number of shuffle
    partitions is only an upper start. On a cluster leave ``master`` unset and let spark-submit choose.
    """
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.shuffle.partitions": str(cpus or 8),
        "spark.ui.enabled": "false",
    }
    builder = SparkSession.builder.appName(app)
    if master or cpus:
        builder = builder.master(master or f"local[{cpus}]")
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: what the session names in spark.checkpoint.dir.

    Only where the session names none (local tests) a local folder is made and used instead.
    """
    jsc = spark.sparkContext._jsc.sc()
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = jsc.getCheckpointDir()
    if not named and current.isDefined():
        return current.get()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), "annalist-shared")
    if not current.isDefined():
        spark.sparkContext.setCheckpointDir(named)
    return named


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder in the shared one, which is deleted when the program ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def written(df: DataFrame, what: str = "step") -> DataFrame:
    """The rows of df from a table written to the shared folder: cuts lineage and survives lost executors.

    The table is deleted when the program ends, so what is made of it must be saved before.
    """
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def kept(spark: SparkSession, what: str, inputs: list[str], make: object) -> DataFrame:
    """A table made from files once a program and read again while those files (their names, sizes and times) are the same."""
    seen = []
    for path in inputs:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = where.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(where, True)
        while files.hasNext():
            f = files.next()
            seen.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    key = (spark.sparkContext.applicationId, what, tuple(sorted(seen)))
    if key not in _kept:
        _kept[key] = written(make(), what)
    return _kept[key]
