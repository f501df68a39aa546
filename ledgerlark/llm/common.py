"""Session helpers of the training-data operators: scratch tables and sizes."""

from __future__ import annotations

from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import saved  # noqa: F401


def shipped(spark: SparkSession, value) -> Broadcast:
    """A broadcast of an object with its class, for ``pickle.loads`` in a task.

    The caller bounds the object's size.  (A plain broadcast names the class,
    which executors could not import.)
    """
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(df: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of a text column, over all rows (one row reaches the driver)."""
    return df.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]


def spread(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
