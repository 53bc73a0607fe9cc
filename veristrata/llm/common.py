"""Helpers shared by the training-data operators: table access and shared-folder materialisation."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Parts into which a hot key of a join is split.
SALTS = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one input table through Spark's reader (works for any Hadoop path)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share: spark.checkpoint.dir, else the one set by setCheckpointDir. Where neither is set, a temporary one
    if Spark runs in this process alone (tests), and an error on a cluster."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="veristrata-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/veristrata/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_tables(*tables: DataFrame) -> None:
    """Deletes what materialize wrote, of steps that nothing lazy reads any more."""
    for df in tables:
        context = df.sparkSession.sparkContext
        for file in df.inputFiles()[:1]:
            folder = context._jvm.org.apache.hadoop.fs.Path(file).getParent()
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def salted_join(df: DataFrame, other: DataFrame, key: str, by: str, how: str = "inner") -> DataFrame:
    """df joined with other, whose keys are unique, on key; rows of df with one key are dealt to SALTS parts by a second column."""
    many = df.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    few = other.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return many.join(few, [key, "_salt"], how).drop("_salt")


def shielded(docs: DataFrame, body: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """body(docs), where body returns docs' columns; columns whose names operators use inside (_vs_...) have others meanwhile."""
    names = docs.columns
    if not any(c.lower().startswith("_vs_") for c in names):
        return body(docs)
    safe = [f"_own_{k}" if c.lower().startswith("_vs_") else c for k, c in enumerate(names)]
    return body(docs.toDF(*safe)).toDF(*names)


def text_of(col: str = "text"):
    """The text column with null as the empty string."""
    return F.coalesce(F.col(col), F.lit(""))


#: Stands for a null id inside operators that compare ids; it is smaller than any other id.
NO_ID = -(1 << 63)


def some_id(col: str):
    return F.coalesce(F.col(col), F.lit(NO_ID).cast("long")).alias(col)


def given_id(col: str):
    return F.nullif(F.col(col), F.lit(NO_ID).cast("long")).alias(col)
