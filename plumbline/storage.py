"""Tables that a job writes for itself: a round's result, a materialised view, a stream's output."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the folder that driver and executors share: spark.checkpoint.dir, or what stands in where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        one_machine = spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster")
        named = f"file://{tempfile.gettempdir()}/plumbline-tables" if one_machine else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_tables"
    return f"{named.rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet and read again: its lineage ends there."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table_name(spark: SparkSession, name: str) -> str:
    """A name for a new table of a database of this application's own, whose tables are in the shared folder."""
    database = "plumbline_" + re.sub(r"\W", "_", spark.sparkContext.applicationId)
    if not spark.catalog.databaseExists(database):
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{new_path(spark, 'database')}'")
    return f"{database}.{name}_{uuid.uuid4().hex[:12]}"
