"""Reliable checkpoints: lineage is cut only through a folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses ``spark.checkpoint.dir`` of the session; only a local session without one gets a folder of its own."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if where is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="quarryline-checkpoint-")
        atexit.register(shutil.rmtree, where, ignore_errors=True)
    sc.setCheckpointDir(where)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared checkpoint folder and reads it from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
