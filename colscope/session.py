"""Session settings and the shared scratch folder used to cut long lineages."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SCRATCH_KEY = "spark.checkpoint.dir"


def build_session(app: str = "colscope", master: str | None = None,
                  shuffle_partitions: int | None = None) -> SparkSession:
    """Session with the settings the library expects (UTC, AQE, skew joins)."""
    builder = (SparkSession.builder.appName(app)
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.adaptive.skewJoin.enabled", "true")
               .config("spark.sql.adaptive.coalescePartitions.enabled", "true"))
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by the cluster.

    Only a session on one machine may name none; a temporary folder is then chosen,
    once per process. Elsewhere executors would write to disks of their own.
    """
    root = spark.conf.get(SCRATCH_KEY, None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError(f"set {SCRATCH_KEY} to a folder that all executors share")
        root = _own_root()
    return root.rstrip("/")


def run_folder(spark: SparkSession) -> str:
    """All files of this application; its owner may delete the folder when the results are read."""
    return f"{scratch_dir(spark)}/colscope/{spark.sparkContext.applicationId}"


@functools.cache
def _own_root() -> str:
    return tempfile.mkdtemp(prefix="colscope-")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{run_folder(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The copy outlives lost executors, is columnar (later passes prune columns)
    and fixes values such as the partition number of a range shuffle.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

