"""Cut long lineage with tables in the cluster's shared checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """`spark.checkpoint.dir` of the session.

    Where it is unset, a local master gets a folder beside its warehouse; a cluster must name one
    that all its machines share.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
            shared = f"{spark.conf.get('spark.sql.warehouse.dir')}/studyspark-{sc.applicationId}"
        sc.setCheckpointDir(shared)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write `df` once as a table in the shared folder and go on from there.

    Used where several later passes read the same result. Unlike an in-memory copy the table
    survives lost executors, and later passes read only the columns they need.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
