"""Intermediate tables that survive lost executors.

Everything an operator has to keep between jobs is written as Parquet under the folder that the
cluster names in ``spark.checkpoint.dir`` and read back, which also cuts the lineage.
"""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; in local mode a temporary one where none is configured (tests).

    On a cluster there is no folder to fall back to, so a missing setting is an error there.
    """
    configured = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tessera-"))
        configured = spark.sparkContext.getCheckpointDir()
    return configured.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to a fresh table in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    _paths[stored] = path
    return stored


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables that ``materialize`` returned and that nothing unfinished reads; others are left alone."""
    for table in tables:
        path = None if table is None else _paths.pop(table, None)
        if path is not None:
            spark = table.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
