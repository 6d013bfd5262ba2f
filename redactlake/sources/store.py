"""A key-value sink: small tables kept as JSON lines below one folder, each replaced as a whole."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder where all executors can write: below spark.checkpoint.dir, else below the session's warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/store-{uuid.uuid4().hex}"


def persisted(items: dict[str, DataFrame], folder: str) -> dict[str, bool]:
    """Whether each item could be written below folder: a failure is told, not raised, and leaves the others."""
    out = {}
    for key, df in items.items():
        try:
            df.write.mode("overwrite").json(f"{folder}/{key}")
            out[key] = True
        except (PySparkException, Py4JJavaError):
            out[key] = False
    return out


def loaded(spark: SparkSession, folder: str, key: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(f"{folder}/{key}")
