"""Shared helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; what separates words in every contract of this subpackage.
WORD = r"[^\x20\x09-\x0D]+"


#: Folders of local sessions without a shared one, by application.
_LOCAL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only a local session may leave it unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or _LOCAL.get(spark.sparkContext.applicationId)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _LOCAL[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="folioscope-")
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Lets Spark delete a query's shuffle files as soon as it ends; what it wrote is all that later queries read.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEAN_UP) if before is None else spark.conf.set(CLEAN_UP, before)
    found = spark.read.schema(df.schema).parquet(path)
    found._written = path
    return found


def discard(*tables: DataFrame) -> None:
    """Delete what materialize() wrote, once later tables that were made from it are written."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df._written)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def utf8_bytes(column: str):
    """UTF-8 length of a text column, zero for null."""
    return F.coalesce(F.octet_length(column), F.lit(0)).cast("long")
