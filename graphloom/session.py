"""Reading the project's tables and cutting lineage."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the data folder ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder that the cluster names in spark.checkpoint.dir.

    Where that setting is missing and no folder was set by hand, a temporary one is
    created in local mode, as in tests; on a cluster that is an error, because the
    executors share no local folder.
    """
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='graphloom-checkpoint-')}"
    context.setCheckpointDir(named)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and forget how it was made."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_and_count(df: DataFrame, which: str = "true") -> tuple[DataFrame, int]:
    """``cut_lineage`` together with the number of rows for which ``which`` holds, counted while they are written."""
    ensure_checkpoint_dir(df.sparkSession)
    seen = Observation()
    out = df.observe(seen, F.count_if(F.expr(which)).alias("n")).checkpoint(eager=True)
    return out, int(seen.get["n"] or 0)
