"""Cutting lineage in storage that survives the loss of an executor."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(session: SparkSession) -> str:
    """The folder the session names for checkpoints; else one in the warehouse, which every executor
    can reach, too."""
    folder = session.conf.get("spark.checkpoint.dir", None)
    return folder or f"{session.conf.get('spark.sql.warehouse.dir')}/_checkpoints"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    session = df.sparkSession
    if session.sparkContext.getCheckpointDir() is None:
        session.sparkContext.setCheckpointDir(shared_folder(session))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again; unlike a checkpoint it is worked out once."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)
