"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "pricebook", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings this library relies on (UTC, AQE, skew join)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    options = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        # Call sites are captured per expression; text rules have thousands.
        "spark.sql.dataFrameQueryContext.enabled": "false",
        **conf,
    }
    for k, v in options.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder name on storage every executor sees.

    The cluster names it in ``spark.checkpoint.dir``.  Only where that is unset
    and driver and executors are one process (tests, a laptop) a temporary
    folder is made; elsewhere a missing setting is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="pricebook-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


#: HotSpot interprets methods of more bytes for good; Spark's own limit (65,535) lets it generate them for wide rows and long rules.
LARGEST_METHOD = 8000


#: A write's shuffle files are of no use once its table is complete; left to the driver's garbage collector they fill the disk.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _setting(spark: SparkSession, key: str, value: str):
    """While it lasts, a setting has a value, unless the session has one of its own."""
    if spark.conf.get(key, None) is not None:
        yield
        return
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key)


def _compiled_methods(spark: SparkSession):
    """While it lasts, steps whose one generated method would be too large to be compiled run as several small ones."""
    return _setting(spark, "spark.sql.codegen.hugeMethodLimit", str(LARGEST_METHOD))


def shuffles_dropped(spark: SparkSession):
    """While it lasts, a finished write drops the shuffle files that it made."""
    return _setting(spark, SHUFFLE_CLEANUP, "true")


def materialize(df: DataFrame, purpose: str = "step", wide: bool = False) -> DataFrame:
    """Cut the lineage by writing a table; it survives the loss of executors.

    ``wide`` rows with many computed columns make one method that the JVM does not compile: it is then split.  The shuffle
    files of the write go with its end; the table stays until :func:`discard` or until the shared folder is cleaned.
    """
    spark, path = df.sparkSession, shared_dir(df.sparkSession, purpose)
    packed = _setting(spark, "spark.sql.parquet.compression.codec", "zstd")
    with packed, shuffles_dropped(spark), _compiled_methods(spark) if wide else nullcontext():
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of :func:`materialize` once all that was made of them is itself written; other frames are left alone."""
    for df in tables:
        path = df.__dict__.pop("_written_to", None)
        if path:
            remove(df.sparkSession, path)


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out to all cores: a small file is one task, however long the rules take on its rows."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder or file is there, in whatever store the path names."""
    fs, where = _file_system(spark, path)
    return fs.exists(where)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of this library's own making; one that is not there is fine."""
    fs, where = _file_system(spark, path)
    fs.delete(where, True)


def folders(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder."""
    fs, where = _file_system(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
