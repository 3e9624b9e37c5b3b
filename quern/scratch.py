"""Intermediate tables in the shared scratch folder: written once, read by several consumers."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``.

    Only where the setting is absent (tests, a laptop) is a temporary folder used; the
    checkpoint folder of the context is set along with it.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or getattr(sc, "_quern_scratch", None)
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = sc._quern_scratch = tempfile.mkdtemp(prefix="quern-")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(root)
    return root


def new_path(spark: SparkSession) -> str:
    """A path in the scratch folder that is deleted when the program ends."""
    path = f"{scratch_root(spark)}/quern-{uuid.uuid4().hex}"
    atexit.register(_drop, spark.sparkContext, path)
    return path


def _drop(sc, path: str) -> None:
    try:
        target = sc._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001 - the context is already gone at exit
        pass


def scratch_table(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet to the shared scratch folder and read it back.

    This cuts the lineage: a lost executor costs a re-read, not a recomputation, and the
    planner knows the table's size from then on. ``release`` deletes the table once all that
    reads it has been written; what is left goes when the session's program ends.
    """
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._scratch_path = path
    return table


def release(*tables: DataFrame | None) -> None:
    """Delete scratch tables that nothing unwritten reads; other frames are left alone."""
    for table in tables:
        if path := getattr(table, "_scratch_path", None):
            _drop(table.sparkSession.sparkContext, path)
