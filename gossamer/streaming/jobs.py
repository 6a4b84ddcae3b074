"""Structured Streaming jobs: link tables kept up to date and crawl statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import relational as R


def windowed_status(events: DataFrame, time: str, late: str = "1 hour", window: str = "1 hour", group: str | None = None, size: str = "value") -> DataFrame:
    """Tumbling-window totals with a watermark; works on a stream and on a table alike."""
    keys = [F.window(time, window).alias("w"), *([group] if group else [])]
    out = events.withWatermark(time, late).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("total"))
    return out.select(F.col("w.start").alias("start"), *([group] if group else []), "n", "total")


def sessions(events: DataFrame, time: str, group: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    out = events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), group).agg(F.count(F.lit(1)).alias("n"))
    return out.select(group, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def accumulate_links(stream: DataFrame, target: str, checkpoint: str):
    """Each micro-batch adds its new links, by bucket, to the link table; links there already are left out.

    Progress is the stream's checkpoint: a batch that is run again finds its links present.
    """

    def merge(batch: DataFrame, _: int) -> None:
        spark: SparkSession = batch.sparkSession
        new = R.back_links(batch, "from_id", "to_id").distinct()
        path = spark._jvm.org.apache.hadoop.fs.Path(target)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            # only the batch's buckets are read: a folder each
            buckets = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # at most 64
            have = spark.read.schema("src bigint, dst bigint, bucket int").parquet(target).filter(F.col("bucket").isin(buckets))
            new = new.join(have, ["bucket", "src", "dst"], "left_anti")
        new.write.mode("append").partitionBy("bucket").parquet(target)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def error_runs(stream: DataFrame, group: str, failed: str, order: str) -> DataFrame:
    """Current run of errors of each group, kept as state across batches."""

    def update(key, batches, state):
        import pandas as pd

        run, worst = state.get if state.exists else (0, 0)
        for pdf in batches:
            for f in pdf.sort_values(order)[failed]:
                run = run + 1 if f else 0
                worst = max(worst, run)
        state.update((run, worst))
        yield pd.DataFrame({group: [key[0]], "run": [run], "longest": [worst]})

    schema = T.StructType([stream.schema[group], T.StructField("run", T.IntegerType()), T.StructField("longest", T.IntegerType())])
    return stream.groupBy(group).applyInPandasWithState(update, schema, T.StructType([T.StructField("run", T.IntegerType()), T.StructField("longest", T.IntegerType())]), "update", "NoTimeout")
