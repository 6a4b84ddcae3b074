"""Set, sort, aggregate and link-table building blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import url as U


def sorted_pairs(df: DataFrame, src: str, dst: str) -> DataFrame:
    return df.orderBy(src, dst)


def sort_unique_merge(batch: DataFrame, have: DataFrame, key: list[str]) -> DataFrame:
    """The distinct rows of a new batch and what is there already."""
    return have.select(*key).unionByName(batch.select(*key)).distinct()


def drop_consecutive(df: DataFrame, key: Column, order: list[str], group: list[str] | None = None, first: int | None = None) -> DataFrame:
    """Rows whose key differs from the row before; ``first`` is the key assumed before the first row."""
    w = Window.partitionBy(*(group or [])).orderBy(*order)
    before = F.lag(key).over(w)
    before = F.coalesce(before, F.lit(first)) if first is not None else before
    return df.withColumn("_before", before).withColumn("_key", key).filter(F.col("_before").isNull() | (F.col("_before") != F.col("_key"))).drop("_before", "_key")


def max_with_ties(df: DataFrame, value: str) -> DataFrame:
    """All rows that hold the largest value."""
    top = df.agg(F.max(value).alias("_top"))
    return df.join(F.broadcast(top), F.col(value) == F.col("_top")).drop("_top")


def prefix_scan(df: DataFrame, value: str, order: str, out: str, group: str | None = None, upto: bool = True) -> DataFrame:
    """Running sum by ``order`` (within ``group``) without a single-task window: range partitions are
    summed first.  ``upto`` tells whether a row's own value is in its sum.

    The driver holds one row for each partition, and for each group that begins or goes on in it.
    """
    spark = df.sparkSession
    by = [group] if group else []
    parts = df.repartitionByRange(*by, order).sortWithinPartitions(*by, order).withColumn("_p", F.spark_partition_id()).persist()
    rows, base = [], {}
    for r in sorted(parts.groupBy("_p", *by).agg(F.sum(value).alias("s")).collect(), key=lambda r: r["_p"]):
        g = r[group] if group else 0
        rows.append((r["_p"], g, base.get(g, 0)))
        base[g] = base.get(g, 0) + (r["s"] or 0)
    kind = dict(df.dtypes)[group] if group else "int"
    start = spark.createDataFrame(rows, f"_p int, _g {kind}, _base bigint")
    w = Window.partitionBy("_p", *by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0 if upto else -1)
    same = (F.col("_p") == F.col("q")) & (F.col(group).eqNullSafe(F.col("_g")) if group else F.lit(True))
    summed = parts.withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0))).join(F.broadcast(start.withColumnRenamed("_p", "q")), same)
    return summed.withColumn(out, F.col(out) + F.col("_base")).select(*df.columns, out)


def link_lists(links: DataFrame, src: str, dst: str, most: int | None = None) -> DataFrame:
    """``src``, ``n`` and sorted distinct ``dests`` without dest 0; lists of more than ``most`` are skipped."""
    rows = links.filter(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(dst) != 0) & (F.col(src) != 0))
    lists = rows.groupBy(F.col(src).alias("src")).agg(F.sort_array(F.collect_set(dst)).alias("dests")).withColumn("n", F.size("dests"))
    return (lists.filter(F.col("n") <= most) if most is not None else lists).select("src", "n", "dests")


def back_links(links: DataFrame, src: str, dst: str) -> DataFrame:
    """Links turned round, with the bucket of their new source."""
    return links.filter(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(U.bucket(F.col(dst)).alias("bucket"), F.col(dst).alias("src"), F.col(src).alias("dst"))


def list_offsets(lists: DataFrame) -> DataFrame:
    """``src`` and the byte offset of its list in the file of its bucket: 16 bytes and 8 for each dest."""
    rows = lists.select("src", U.bucket(F.col("src")).alias("bucket"), (F.lit(16) + 8 * F.col("n")).cast("bigint").alias("bytes"))
    return prefix_scan(rows, "bytes", "src", "offset", "bucket", False).select("src", "bucket", "offset")


def fetch_lists(lists: DataFrame, offsets: DataFrame, asked: DataFrame) -> DataFrame:
    """The lists that stand at the asked places (``bucket``, ``offset``) of the files."""
    return lists.join(offsets.join(asked, ["bucket", "offset"], "left_semi").select("src"), "src", "left_semi")


def seen_set(urls: DataFrame, group: str, hashed: Column, order: str) -> DataFrame:
    """The first row of each hash in its group, by ``order``."""
    row = F.struct(*[F.col(c) for c in urls.columns])
    keyed = urls.select(F.col(group).alias("_g"), hashed.alias("_h"), F.col(order).alias("_o"), row.alias("_r")).filter("_h IS NOT NULL")
    return keyed.groupBy("_g", "_h").agg(F.min_by("_r", "_o").alias("_r")).select("_r.*")


def compare_streams(a: DataFrame, b: DataFrame, order: str, value: str) -> DataFrame:
    """Line-by-line comparison by position: ``pos``, ``a``, ``b`` where they differ or one has ended."""
    num = lambda d, c: prefix_scan(d.select(F.col(order).alias("_o"), F.col(value).alias(c)).withColumn("_1", F.lit(1)), "_1", "_o", "pos").select("pos", c)
    return num(a, "a").join(num(b, "b"), "pos", "full_outer").filter(~F.col("a").eqNullSafe(F.col("b")))


def consecutive_errors(df: DataFrame, group: str, order: list[str], failed: Column) -> DataFrame:
    """``group`` with its rows, successes, errors and longest run of errors without a success between."""
    w = Window.partitionBy(group).orderBy(*order)
    rows = df.withColumn("_f", failed.cast("int")).withColumn("_ok", F.sum(1 - F.col("_f")).over(w))
    runs = rows.groupBy(group, "_ok").agg(F.sum("_f").alias("run"), F.count(F.lit(1)).alias("n"))
    return runs.groupBy(group).agg(F.sum("n").alias("n_rows"), (F.sum("n") - F.sum("run")).alias("n_success"), F.sum("run").alias("n_error"), F.max("run").alias("longest_error_run"))


def merge_entries(df: DataFrame, key: str, value: str) -> DataFrame:
    """Sums by key, the largest first."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.sum(value).alias(value)).orderBy(F.desc(value), key)


def throughput(df: DataFrame, time: str, size: str, minutes: int = 60) -> DataFrame:
    """``start``, ``total`` and the ``change`` against the sample before, for samples of so many minutes."""
    samples = df.filter(F.col(time).isNotNull()).groupBy(F.window(F.col(time).cast("timestamp"), f"{minutes} minutes").alias("w")).agg(F.coalesce(F.sum(size), F.lit(0)).alias("total"))
    # one row a sample: the window runs over the samples, not the rows
    return samples.select(F.col("w.start").alias("start"), "total", (F.col("total") - F.lag("total").over(Window.orderBy("w.start"))).alias("change"))


def search(pages: DataFrame, key: str, text: str, title: str, query: str) -> DataFrame:
    """Pages that hold every query word, those with one in the title first: ``key``, ``title_match``, ``pos``."""
    terms = [t.lstrip("+") for t in query.replace('"', " ").lower().split()]
    words = F.split(F.lower(F.col(text)), r"[^\p{L}\p{Nd}]+")
    in_title = F.split(F.lower(F.col(title)), r"[^\p{L}\p{Nd}]+")
    hits = pages.filter(F.col(text).isNotNull()).filter(F.forall(F.array(*[F.lit(t) for t in terms]), lambda t: F.array_contains(words, t)))
    first = F.exists(F.array(*[F.lit(t) for t in terms]), lambda t: F.coalesce(F.array_contains(in_title, t), F.lit(False)))
    marked = hits.select(key, first.alias("title_match"))
    return marked.orderBy(F.desc("title_match"), key)
