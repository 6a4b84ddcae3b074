import time

from pyspark.sql import functions as F

from gossamer.streaming import jobs


def test_links_accumulate_once(spark, tmp_path):
    src, out, cp = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    spark.createDataFrame([(1, 2), (1, 2), (3, 4)], "from_id bigint, to_id bigint").coalesce(1).write.parquet(src)
    read = lambda: spark.readStream.schema("from_id bigint, to_id bigint").parquet(src)
    jobs.accumulate_links(read(), out, cp).awaitTermination()
    spark.createDataFrame([(1, 2), (5, 6)], "from_id bigint, to_id bigint").coalesce(1).write.mode("append").parquet(src)
    jobs.accumulate_links(read(), out, cp).awaitTermination()
    assert sorted((r.src, r.dst) for r in spark.read.parquet(out).collect()) == [(2, 1), (4, 3), (6, 5)]


def test_windows_and_error_runs(spark, tmp_path):
    rows = [(1, "2003-01-01 00:10:00", 2.0, False), (1, "2003-01-01 00:20:00", 3.0, True), (1, "2003-01-01 01:20:00", 1.0, True)]
    e = spark.createDataFrame(rows, "u bigint, t string, value double, bad boolean").withColumn("t", F.col("t").cast("timestamp"))
    assert {(r.n, r.total) for r in jobs.windowed_status(e, "t").collect()} == {(2, 5.0), (1, 1.0)}
    assert jobs.sessions(e, "t", "u").count() == 2
    path = str(tmp_path / "e")
    e.coalesce(1).write.parquet(path)
    q = jobs.error_runs(spark.readStream.schema(e.schema).parquet(path), "u", "bad", "t").writeStream.outputMode("update").format("memory").queryName(f"runs{int(time.time())}").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.run, r.longest) for r in spark.sql(f"SELECT * FROM {q.name}").collect()] == [(2, 2)]
