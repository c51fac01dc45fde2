"""Materialised stage boundaries on shared storage.

Fixpoint loops and tables read by several branches are written once, as
columnar files under the folder the cluster names in ``spark.checkpoint.dir``,
and read back: later stages prune columns, and losing an executor never replays
what came before. Each application keeps its tables in one catalog database at
that folder, so that ``release`` and ``release_all`` delete them by plain SQL.
"""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Where none is named, as in tests, it is one in the warehouse, if executors
    see that too: they do in local mode, and where the warehouse is not on a
    machine's own disk. Otherwise this raises, as each executor would write to
    a disk that no other reads.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    master = spark.conf.get("spark.master", "")
    own_disk = warehouse.startswith(("file:", "/")) or ":" not in warehouse
    if own_disk and not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return warehouse + "/checkpoints"


def _database(spark: SparkSession) -> str:
    name = "cut_" + "".join(c if c.isalnum() else "_" for c in spark.conf.get("spark.app.id"))
    if not spark.catalog.databaseExists(name):
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {name} LOCATION '{ensure_checkpoint_dir(spark).rstrip('/')}/{name}'")
        atexit.register(release_all, spark)
    return name


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back; its lineage ends there.

    The table stays until ``release(result)`` or the end of the application.
    """
    spark = df.sparkSession
    name = f"{_database(spark)}.t{uuid.uuid4().hex}"
    df.write.format("parquet").saveAsTable(name)
    stored = spark.table(name)
    stored._cut_name = name
    return stored


def folder(spark: SparkSession) -> str:
    """A new place for files in the shared folder, deleted with the tables of ``cut`` when the application ends."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{_database(spark)}/f{uuid.uuid4().hex}"


def release(*stored: DataFrame) -> None:
    """Delete tables made by ``cut`` that no later plan reads."""
    for df in stored:
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {df._cut_name}")


def release_all(spark: SparkSession) -> None:
    """Delete all that ``cut`` has left for this application."""
    with contextlib.suppress(Exception):  # the session may have ended already
        spark.sql(f"DROP DATABASE IF EXISTS {_database(spark)} CASCADE")
