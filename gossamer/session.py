"""Session helpers: table access and the shared folder for cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"
#: Repeated keys that may be sent to every task (16 MB with their places); beyond it they are joined.
MAX_SENT_KEYS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; columns are pruned later by the plans that read it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    It is what ``spark.checkpoint.dir`` names; a temporary local folder is set only where that
    setting is absent on a single machine (tests).  On a cluster its absence is an error.
    """
    have = spark.sparkContext.getConf().get(CHECKPOINT_CONF, None) or spark.conf.get(CHECKPOINT_CONF, None)
    if have:
        return have
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError(f"on a cluster {CHECKPOINT_CONF} must name a folder that all executors share")
    own = f"file://{tempfile.mkdtemp(prefix='gossamer-')}"
    spark.conf.set(CHECKPOINT_CONF, own)
    spark.sparkContext.setCheckpointDir(own)
    return own


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df``: an eager, reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    where = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(where)
    return df.checkpoint(eager=True)


def written(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back (columnar, prunable).

    ``by`` names a column of few values whose rows stand in folders of their own.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    writer = df.write
    (writer.partitionBy(by) if by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def once_each(df: DataFrame, key: str) -> DataFrame:
    """The rows of a table in files, a repeated ``key`` only at its first place.

    Only keys and places are grouped; the few repeated keys are written and sent to the tasks that read the
    rows, so no wide column is shuffled while they are within ``MAX_SENT_KEYS``.  Rows with a null key stay.
    """
    place = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    keys = df.select(key, place.alias("_place")).groupBy(key).agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_c"))
    twice = written(keys.filter("_c > 1").select(key, "_first"), "redelivered")
    few = twice.count() <= MAX_SENT_KEYS  # from the written footers
    marked = df.withColumn("_place", place).join(F.broadcast(twice) if few else twice, key, "left")
    return marked.filter("_first IS NULL OR _place = _first").select(*df.columns)
