"""Cutting lineage with tables in the cluster's shared folder."""

from __future__ import annotations

import atexit
import os
import shutil
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Used only on a local master whose session names no shared folder, as in tests; emptied when Python ends.
FALLBACK_DIR = f"/tmp/checkpoints/lattix-{os.getpid()}"
#: Bytes of rows that a Python worker gets at once.
BATCH_BYTES = str(4 << 20)
#: Of a table of packed rows, what a task holds until it writes it and reads at once. Parquet by itself looks at sizes only after 100 rows.
GROUP = {"parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "1"}
atexit.register(shutil.rmtree, FALLBACK_DIR, ignore_errors=True)


@contextmanager
def configured(spark: SparkSession, **options: str) -> Iterator[None]:
    """Session options for the time of a block: ``sweep`` deletes a query's exchanges at its end, ``batch_bytes`` bounds what a
    Python worker gets at once, ``split_bytes`` is what a task reads of a file, and a task reads one file."""
    names = {"sweep": ["spark.sql.classic.shuffleDependency.fileCleanup.enabled"], "batch_bytes": ["spark.sql.execution.arrow.maxBytesPerBatch"], "split_bytes": ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]}
    wanted = {name: value for k, value in options.items() for name in names[k]}
    before = {name: spark.conf.get(name, None) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value is not None else spark.conf.unset(name)


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor and the driver can reach (``spark.checkpoint.dir``).

    A cluster has to name it: without it only a local master has a folder that all its tasks see.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (named or FALLBACK_DIR).rstrip("/")


def scratch_dir(spark: SparkSession) -> str:
    """The application's own part of the shared folder; :func:`clean` deletes it."""
    return f"{shared_dir(spark)}/lattix-{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and return the stored table.

    Unlike a local checkpoint the files outlive executors, and unlike ``persist`` the
    plan above them starts from a scan whose size Catalyst knows. What was exchanged for it is deleted at once.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    packed = any(kind == "binary" for _, kind in df.dtypes)
    with configured(spark, sweep="true", batch_bytes=BATCH_BYTES):
        df.write.options(**GROUP if packed else {}).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release(*tables: DataFrame | None) -> None:
    """Delete the files of tables made by :func:`materialize`, once nothing reads them any more."""
    for df in tables:
        if (path := getattr(df, "_stored_at", None)) is not None:
            _delete(df.sparkSession, path)


def clean(spark: SparkSession) -> None:
    """Delete all tables that this application has stored: its results have been read or written elsewhere."""
    _delete(spark, scratch_dir(spark))
