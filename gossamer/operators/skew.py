"""Per-key results over keys of very unequal size.

A few keys may hold most rows.  ``heavy_hitters`` finds them with a mergeable sketch and verifies the
candidates with exact counts; ``skew_join`` and ``chunked_lists`` then treat those keys apart from the
rest, so that no task receives a whole heavy key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Counters kept by the frequent-items sketch: an item is missed only below 4 / SKETCH_ITEMS of the rows.
SKETCH_ITEMS = 16384


def heavy_hitters(df: DataFrame, columns: list[str], share: float = 0.01) -> DataFrame:
    """Keys that hold more than ``share`` of all rows, for each of ``columns``.

    Returns ``side`` (column name), ``key``, ``n`` (exact rows of the key), ``total`` (all rows, nulls
    included).  One scan feeds a frequent-items sketch per column, a second one counts its candidates
    exactly.  At most ``2 / share`` candidates a column reach the driver, whatever the input size.

    Null keys are never heavy, but their rows count in ``total``; an empty table gives no row; repeated
    rows count as often as they stand; ties are all kept.
    """
    if not 4 / SKETCH_ITEMS < share <= 1:
        raise ValueError("share must lie above the sketch's error")
    k = int(2 / share) + 1
    types = {c: df.schema[c].dataType.simpleString() for c in columns}
    sketches = [F.expr(f"approx_top_k(`{c}`, {k}, {SKETCH_ITEMS}) FILTER (WHERE `{c}` IS NOT NULL)").alias(f"s{i}") for i, c in enumerate(columns)]
    top = df.agg(F.count(F.lit(1)).alias("total"), *sketches).first()
    found = {c: [x["item"] for x in top[f"s{i}"] or [] if x["item"] is not None] for i, c in enumerate(columns)}
    total = top["total"]
    sides = [F.struct(F.lit(c).alias("side"), F.when(F.col(c).isin(found[c]), F.col(c)).alias("key")) for c in columns if found[c]]
    if not sides:
        kind = types[columns[0]]
        return df.sparkSession.createDataFrame([], f"side string, key {kind}, n bigint, total bigint")
    return (
        df.select(F.inline(F.array(*sides)))
        .filter("key IS NOT NULL")
        .groupBy("side", "key")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > F.lit(total) * F.lit(share))
        .withColumn("total", F.lit(total).cast("bigint"))
    )


def _heavy_list(df: DataFrame, key: str, share: float) -> list:
    return [r["key"] for r in heavy_hitters(df, [key], share).select("key").collect()]


def skew_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", share: float = 0.01) -> DataFrame:
    """Equi-join of a skewed ``left`` with ``right`` (unique per ``key``).

    Heavy keys of ``left`` (at most ``1 / share`` of them) meet their few ``right`` rows by a broadcast
    join, all other keys by the ordinary shuffle join; the results are united.  ``how`` is ``inner`` or
    ``left``.  Null keys match nothing and, with ``left``, keep their row.
    """
    heavy = _heavy_list(left, key, share)
    if not heavy:
        return left.join(right, key, how)
    is_heavy = F.coalesce(F.col(key).isin(heavy), F.lit(False))
    few = right.filter(F.col(key).isin(heavy))
    return left.filter(is_heavy).join(F.broadcast(few), key, how).unionByName(left.filter(~is_heavy).join(right.filter(~F.col(key).isin(heavy)), key, how))


def degrees(edges: DataFrame, src: str = "from_id", dst: str = "to_id") -> DataFrame:
    """``key_id``, ``out_degree``, ``in_degree`` of every id in either column.

    Both counts come from one shuffle of partial counts: a key leaves each map task as a single row, so
    a heavy key costs its reducer no more rows than there are map tasks.  Nulls name no id.
    """
    sides = F.array(
        F.struct(F.col(src).alias("key_id"), F.lit(1).alias("o"), F.lit(0).alias("i")),
        F.struct(F.col(dst).alias("key_id"), F.lit(0).alias("o"), F.lit(1).alias("i")),
    )
    return edges.select(F.inline(sides)).filter("key_id IS NOT NULL").groupBy("key_id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def chunked_lists(df: DataFrame, key: str, value: str, share: float = 0.01, parts: int = 64) -> DataFrame:
    """The sorted distinct ``value`` list of each ``key``, heavy keys cut into ``parts`` chunks.

    Returns ``key``, ``chunk`` (0 for ordinary keys), ``values``.  The chunk of a heavy key's value is
    ``value mod parts``; joined over its chunks the list is whole.  ``value`` must be an integer.
    Heavy keys are known to the map tasks as a literal set, so their rows spread over ``parts`` tasks.
    Rows with a null key or value belong to no list.
    """
    heavy = _heavy_list(df, key, share)
    chunk: Column = F.when(F.col(key).isin(heavy), F.pmod(F.col(value), F.lit(parts))).otherwise(F.lit(0)) if heavy else F.lit(0)
    rows = df.select(F.col(key), F.col(value), chunk.cast("int").alias("chunk")).filter(F.col(key).isNotNull() & F.col(value).isNotNull())
    return rows.groupBy(key, "chunk").agg(F.sort_array(F.collect_set(value)).alias("values"))
