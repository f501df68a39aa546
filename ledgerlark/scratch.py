"""Tables in the folder that driver and executors share, to cut lineage between stages."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def saved(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="ledgerlark-")
        spark.sparkContext.setCheckpointDir(folder)
    path = f"{folder.rstrip('/')}/ledgerlark/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
