"""Where the library may write on its own."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """A new folder name below the shared folder the session names."""
    return f"{shared_dir(spark).rstrip('/')}/insight-{uuid.uuid4().hex}"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset, the session's warehouse, which is shared as well."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    return base or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
