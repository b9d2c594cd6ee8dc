"""Sinks: directories written in parallel by the executors."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Name of the file that says which data directory of a published table is the current one.
MANIFEST = "manifest"


def write_csv(df: DataFrame, path: str) -> bool:
    """CSV with a header in UTF-8; an empty frame writes nothing and returns False."""
    if df.isEmpty():
        return False
    df.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)
    return True


def write_parquet(df: DataFrame, path: str) -> bool:
    """Parquet; an empty frame writes nothing and returns False."""
    if df.isEmpty():
        return False
    df.write.mode("overwrite").parquet(path)
    return True


def publish_csv(df: DataFrame, path: str) -> None:
    """Write a new version of a CSV table, then name it in the manifest.

    The data directory is complete before the manifest names it, so readers see the old version or
    the new one, never a part; an export that fails leaves the old version in force. The manifest
    keeps the schema. NULL and the empty text stay apart: NULL is written as ``\\N``.
    """
    version = uuid.uuid4().hex
    df.write.options(header=True, encoding="UTF-8", nullValue="\\N", emptyValue="", escape='"', quoteAll=True).csv(f"{path}/{version}")
    entry = json.dumps({"version": version, "schema": df.schema.jsonValue()})
    note = df.sparkSession.createDataFrame([(entry,)], "entry string")
    note.coalesce(1).write.mode("append").text(f"{path}/{MANIFEST}")


def _current(spark: SparkSession, path: str) -> dict:
    """The entry of the manifest that was written last."""
    entries = spark.read.text(f"{path}/{MANIFEST}").select("value", F.col("_metadata.file_modification_time").alias("at"))
    return json.loads(entries.orderBy(F.desc("at"), "value").first()["value"])


def read_published_csv(spark: SparkSession, path: str) -> DataFrame:
    """The version of a published table that its manifest names, read with the schema it was written with."""
    entry = _current(spark, path)
    schema = StructType.fromJson(entry["schema"])
    return spark.read.schema(schema).options(
        header=True, encoding="UTF-8", nullValue="\\N", emptyValue="", escape='"', multiLine=True, enforceSchema=True,
        mode="FAILFAST",
    ).csv(f"{path}/{entry['version']}")
