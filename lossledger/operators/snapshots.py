"""Versioned profiles of tables: written as snapshots, read back, and compared.

A snapshot keeps, per column, its type, fill rate and number of values, the fingerprint of its table's
schema, and the rows per value. Both parts are Parquet partitioned by snapshot, so reading one snapshot
touches its files only, and writing one again replaces it alone.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalog

COLUMNS, VALUES = "columns", "values"
Sources = dict[str, tuple[DataFrame, list[str]]]


def fingerprint(df: DataFrame) -> str:
    """SHA-256 of the names and types of all columns, whatever their order."""
    text = ",".join(sorted(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema.fields))
    return hashlib.sha256(text.encode()).hexdigest()


def column_profile(sources: Sources) -> DataFrame:
    """``(tbl, col, type, schema_sha256, filled_pct)`` of every column of every table; the fill rates of
    a table are one aggregate."""
    parts = []
    for table, (df, _) in sources.items():
        types = F.create_map(*[F.lit(x) for f in df.schema.fields for x in (f.name, f.dataType.simpleString())])
        parts.append(
            catalog.fill_rates(df, df.columns, table).select(
                "tbl", "col", F.try_element_at(types, F.col("col")).alias("type"),
                F.lit(fingerprint(df)).alias("schema_sha256"), "filled_pct",
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def save(sources: Sources, root: str, snapshot: str) -> None:
    """Profile the tables and keep the result as a snapshot. ``sources`` names, per table, the columns
    whose values are counted; the columns are all profiled."""
    def write(df: DataFrame, part: str) -> None:
        (
            df.withColumn("snapshot", F.lit(snapshot))
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot")
            .parquet(f"{root}/{part}")
        )

    write(column_profile(sources), COLUMNS)
    write(catalog.build_catalog(sources).select("tbl", "col", "value", "cnt", "filled_pct"), VALUES)


def read(spark: SparkSession, root: str, part: str, snapshot: str) -> DataFrame:
    """One part of one snapshot; an unknown snapshot is an error, not an empty profile."""
    found = spark.read.parquet(f"{root}/{part}").filter(F.col("snapshot").cast("string") == snapshot).drop("snapshot")
    if part == COLUMNS and found.isEmpty():
        raise ValueError(f"no snapshot {snapshot!r} in {root}")
    return found


def schema_drift(spark: SparkSession, root: str, before: str, after: str) -> DataFrame:
    """Columns that are new or lost, changed their type, or are filled differently."""
    old, new = (read(spark, root, COLUMNS, s) for s in (before, after))
    same = old.select("tbl", "schema_sha256").distinct().join(new.select("tbl", "schema_sha256").distinct(), ["tbl", "schema_sha256"])

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select("tbl", "col", F.col("type").alias(f"type_{name}"), F.col("filled_pct").alias(f"filled_{name}"))

    change = (
        F.when(F.col("type_before").isNull(), "new")
        .when(F.col("type_after").isNull(), "lost")
        .when(F.col("type_before") != F.col("type_after"), "type")
        .when(F.col("filled_before") != F.col("filled_after"), "fill")
    )
    return (
        side(old, "before").join(side(new, "after"), ["tbl", "col"], "outer")
        .withColumn("change", change)
        .filter(F.col("change").isNotNull())
        .join(same.select("tbl", F.lit(True).alias("__same")), "tbl", "left")
        .withColumn("same_schema", F.coalesce("__same", F.lit(False)))
        .drop("__same")
    )


def value_drift(spark: SparkSession, root: str, before: str, after: str) -> DataFrame:
    """Values that are new, lost or counted differently, as :func:`catalog.drift` tells them."""
    return catalog.drift(*(read(spark, root, VALUES, s) for s in (before, after)))
