"""Helpers that the operators of this folder share."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space only: words are what stands between it. ``bytes.split()`` splits at the same six characters.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def importable(spark: SparkSession) -> None:
    """Lets Python workers find this package where its folder is, also if they start elsewhere."""
    root = str(Path(__file__).resolve().parents[2])
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in spark.checkpoint.dir. Only where that is unset a folder of our own is taken: a
    temporary one for a single-machine master, else one beside the warehouse, which all executors can reach too.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        return f"file://{tempfile.gettempdir()}/plumbline-checkpoints"
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"


#: The paths that this process has given out, in order.
PATHS: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    PATHS.append(f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}")
    return PATHS[-1]


def input_bytes(df: DataFrame) -> int:
    """Bytes of the tables that df reads, each of them once; a source whose size Spark does not know counts nothing."""
    unknown = int(df.sparkSession.conf.get("spark.sql.defaultSizeInBytes", str(2**63 - 1)))
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    return sum(n for n in sizes if n < unknown)


def parts_for(df: DataFrame, bytes_each: int = 256 << 20) -> int:
    """Partitions for a shuffle of what comes from df: as configured, more where its input is larger than so many bytes each.

    Only the sizes of sources count: Spark's estimate of a whole plan multiplies the sides of its joins.
    """
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes(df) // bytes_each))


def forget(spark: SparkSession) -> None:
    """Removes what this application has written to the shared folder, once its results are read."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{spark.sparkContext.applicationId}")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written as a Parquet table in the shared folder and read again: its lineage ends there."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def remove(spark: SparkSession, *paths: str) -> None:
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def dropped(*tables: DataFrame) -> None:
    """Removes tables of saved() that nothing reads any more."""
    for t in tables:
        remove(t.sparkSession, t.saved_at)


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """The rows of docs as _row, with a number of their own, _at, that stays the same whenever they are read.

    Rows of a file have theirs from the file's path and their place in it, if no two agree. Other frames, whose rows may
    come in another order when they are computed again, are written first.
    """
    if "_metadata" not in docs.columns:
        try:
            rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.xxhash64("_metadata.file_path", "_metadata.row_index").alias("_at"))
            if rows.groupBy("_at").count().where("count > 1").isEmpty():
                return rows
        except AnalysisException:
            pass  # no files, or several sources
    return saved(as_row(docs).withColumn("_at", F.monotonically_increasing_id()), name)


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """What runs within hands Python so many rows at a time, at most: whole texts are long, and a batch is held on both sides."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, also where body uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words of a text as an array; none for a null text."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(*cols: Column) -> Column:
    """A number in [0, 1) that depends on the given values only."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) * F.lit(2.0**-53)


def as_row(df: DataFrame) -> DataFrame:
    """df as one struct column ``_row``: working columns beside it can't clash with its own."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"))


def from_row(df: DataFrame, like: DataFrame, text: Column | None = None) -> DataFrame:
    """The columns of like out of ``_row``; with text in place of the column text, n_chars, if there is one, follows it."""

    def value(name: str) -> Column:
        if text is not None and name == "text":
            return text
        if text is not None and name == "n_chars":
            return F.char_length(text).cast(like.schema[name].dataType)
        return F.col("_row").getField(name)

    return df.select(*[value(c).alias(c) for c in like.columns])


def field(name: str) -> Column:
    return F.col("_row").getField(name)
