"""Problem 2: has this key been seen before?

Keys are spread over shards by hash.  A shard reads its rows in order of arrival; the current batch is
compared exactly, older keys are kept only as sealed partitions (``mphf.Sealed``): a minimal perfect
hash and a 32-bit fingerprint per key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .mphf import Sealed

#: Rows compared exactly with one another before their keys are sealed.
BATCH_ROWS = 131_072
#: Rows a shard should hold at most on average; the number of shards follows the table.
SHARD_ROWS = 500_000


def _firsts(h1: np.ndarray, h2: np.ndarray, rid: np.ndarray) -> np.ndarray:
    """A mask of the rows that hold the smallest id of their 128-bit key."""
    order = np.lexsort((rid, h2, h1))
    a, b = h1[order], h2[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    first = np.zeros(len(order), bool)
    first[order[new]] = True
    # rows of one id repeated: the same id isn't earlier than itself
    if len(order):
        run = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        same = rid[order] == rid[order[run]]
        first[order[same]] = True
    return first


def _grouped(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[list[np.ndarray]]:
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield [pa.concat_arrays([x.column(i) for x in held]).to_numpy(zero_copy_only=False) for i in range(4)]
            held, n = [], 0
    if held:
        yield [pa.concat_arrays([x.column(i) for x in held]).to_numpy(zero_copy_only=False) for i in range(4)]


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Within a map task: rows after the first of their key in the batch are decided at once.

    They leave with ``seen`` set, so that the copies of a hot key spread over all reducers by their ids.
    """
    for tab, rid, h1, h2 in _grouped(batches, BATCH_ROWS):
        first = _firsts(h1, h2, rid)
        yield pa.RecordBatch.from_arrays([pa.array(tab, pa.int8()), pa.array(rid), pa.array(h1), pa.array(h2), pa.array(~first)], ["tab", "rec_id", "h1", "h2", "seen"])


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One shard in order of arrival: exact current batch, sealed partitions of all earlier keys.

    Only the current batch and the sealed partitions (about six bytes a key) are in memory.
    """
    sealed: list[Sealed] = []

    def settle(tab: np.ndarray, r: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        first = _firsts(a, b, r)
        prints = (b.view(np.uint64) >> np.uint64(32)).astype(np.uint32)
        old = np.zeros(len(r), bool)
        for s in sealed:
            ask = np.flatnonzero(first & ~old)
            old[ask] = s.has(a[ask], prints[ask])
        new = np.flatnonzero(first & ~old)
        keys, at = np.unique(a[new], return_index=True)
        if len(keys):
            sealed.append(Sealed(keys, prints[new[at]]))
        # an id delivered twice comes out once
        ids, at = np.unique(np.stack([tab.astype(np.int64), r], 1)[old | ~first], axis=0, return_index=True)
        return pa.RecordBatch.from_arrays([pa.array(ids[:, 0].astype(np.int8)), pa.array(ids[:, 1])], ["tab", "rec_id"])

    held: list[np.ndarray] | None = None
    for x in batches:
        seen = x.column(4).to_numpy(zero_copy_only=False)
        cols = [x.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        if seen.any():
            yield pa.RecordBatch.from_arrays([pa.array(cols[0][seen], pa.int8()), pa.array(cols[1][seen])], ["tab", "rec_id"])
        cols = [c[~seen] for c in cols]
        held = cols if held is None else [np.concatenate(p) for p in zip(held, cols)]
        if len(held[1]) >= BATCH_ROWS:
            # rows of one id stay together
            end = int(np.searchsorted(held[1], held[1][-1]))
            if end:
                yield settle(*(c[:end] for c in held))
                held = [c[end:] for c in held]
    if held is not None and len(held[1]):
        yield settle(*held)


def seen_before(df: DataFrame, tab: str, rec_id: str, key: str, total: int | None = None) -> DataFrame:
    """Rows of ``df`` whose ``key`` occurred under a smaller ``rec_id``: columns ``tab``, ``rec_id``.

    Keys agree byte for byte, told by a 128-bit hash inside a batch and by slot and 32-bit fingerprint
    against sealed keys: a key never seen is reported with probability below 2^-32 for each sealed
    partition of its shard (``error_rate`` measures it); a key seen is always reported.

    Null keys are no case; empty strings are a key; a row delivered twice (same id) isn't earlier than
    itself; an empty table gives no row; other columns are not read.
    """
    return seen_in([(df, tab, rec_id, key)], total)


def seen_in(parts: list[tuple[DataFrame, str, str, str]], total: int | None = None) -> DataFrame:
    """``seen_before`` over several tables in one pass; keys of different tables never agree."""
    rows = None
    for i, (df, _, rec_id, key) in enumerate(parts):
        one = df.filter(F.col(key).isNotNull()).select(
            F.lit(i).cast("tinyint").alias("tab"),
            F.col(rec_id).cast("bigint").alias("rec_id"),
            F.xxhash64(F.lit(2 * i + 1), F.col(key)).alias("h1"),
            F.xxhash64(F.lit(-2 * i - 2), F.col(key)).alias("h2"),
        )
        rows = one if rows is None else rows.unionByName(one)
    if total is None:
        total = sum(df.count() for df, *_ in parts)  # from Parquet footers
    spark = rows.sparkSession
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARD_ROWS))
    local = rows.mapInArrow(_local, "tab tinyint, rec_id bigint, h1 bigint, h2 bigint, seen boolean")
    spread = local.repartition(shards, F.when(F.col("seen"), F.col("rec_id")).otherwise(F.col("h1")))
    # the order of arrival is made by the sort of the shuffle, which spills
    hits = spread.sortWithinPartitions("rec_id").mapInArrow(_decide, "tab tinyint, rec_id bigint")
    names = F.array(*[F.lit(t) for _, t, _, _ in parts])
    return hits.select(F.element_at(names, F.col("tab").cast("int") + 1).alias("tab"), "rec_id")


def _hashed(df: DataFrame, key: str) -> list:
    return [F.xxhash64(F.lit(1), F.col(key)).alias("h1"), F.xxhash64(F.lit(-2), F.col(key)).alias("h2")]


def seal(df: DataFrame, key: str, shards: int) -> DataFrame:
    """The keys of ``df`` as sealed partitions: ``shard``, ``n`` (distinct keys) and ``blob``.

    Write the result to a table and append to it after each batch; it holds about six bytes a key and
    no key.  ``shards`` must stay the same for all batches of an index.  Nulls are no keys.
    """
    keys = df.filter(F.col(key).isNotNull()).select(*_hashed(df, key)).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols = [(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy()) for b in batches]
        if not cols:
            return
        shard, h1, h2 = (np.concatenate(c) for c in zip(*cols))
        for s in np.unique(shard):
            on = shard == s
            a, at = np.unique(h1[on], return_index=True)
            one = Sealed(a, (h2[on][at].view(np.uint64) >> np.uint64(32)).astype(np.uint32))
            yield pa.RecordBatch.from_arrays([pa.array([int(s)], pa.int32()), pa.array([one.n], pa.int64()), pa.array([one.dump()], pa.binary())], ["shard", "n", "blob"])

    placed = keys.select(F.pmod("h1", F.lit(shards)).cast("int").alias("shard"), "h1", "h2").repartition(shards, "shard")
    return placed.mapInArrow(run, "shard int, n bigint, blob binary")


def seen_in_index(batch: DataFrame, tab: str, rec_id: str, key: str, index: DataFrame, shards: int) -> DataFrame:
    """Rows of a new batch whose key is in the ``index`` of all earlier batches, or under a smaller id of
    the batch itself: ``tab``, ``rec_id``.

    Each shard of the batch meets that shard's sealed partitions only; copies inside a map task are
    decided there and don't travel with their key, so a hot key costs its shard one row a task.
    """
    rows = batch.filter(F.col(key).isNotNull()).select(F.lit(0).cast("tinyint").alias("tab"), F.col(rec_id).cast("bigint").alias("rec_id"), *_hashed(batch, key))
    local = written(rows.mapInArrow(_local, "tab tinyint, rec_id bigint, h1 bigint, h2 bigint, seen boolean"), "seen-batch")
    open_ = local.filter("NOT seen").select("rec_id", "h1", "h2", F.pmod("h1", F.lit(shards)).cast("int").alias("shard"))

    def probe(left: pa.Table, right: pa.Table) -> pa.Table:
        rid, h1, h2 = (left.column(c).to_numpy() for c in ("rec_id", "h1", "h2"))
        first = _firsts(h1, h2, rid) if len(rid) else np.zeros(0, bool)
        prints = (h2.view(np.uint64) >> np.uint64(32)).astype(np.uint32)
        old = np.zeros(len(rid), bool)
        for blob in right.column("blob").to_pylist():
            old |= Sealed.load(blob).has(h1, prints)
        return pa.table({"rec_id": pa.array(rid[old | ~first], pa.int64())})

    found = open_.groupBy("shard").cogroup(index.select(F.col("shard").alias("part"), "blob").groupBy("part")).applyInArrow(probe, "rec_id bigint")
    return local.filter("seen").select("rec_id").unionByName(found).select(F.lit(tab).alias("tab"), "rec_id")


def error_rate(df: DataFrame, tab: str, rec_id: str, key: str) -> DataFrame:
    """Measured wrong answers of ``seen_before`` on ``df``, against exact grouping of the keys.

    Columns ``tab``, ``n_rows`` (non-null keys), ``n_seen`` (reported), ``n_exact`` (true), ``n_wrong``
    (reported without cause plus missed) and ``rate`` = n_wrong / n_rows (0 for an empty table).
    """
    keyed = df.filter(F.col(key).isNotNull()).select(F.col(rec_id).alias("rec_id"), F.col(key).alias("k"))
    firsts = keyed.groupBy("k").agg(F.min("rec_id").alias("rec_id"), F.count(F.lit(1)).alias("c"))
    found = seen_before(df, tab, rec_id, key).select("rec_id", F.lit(1).alias("f"))
    judged = firsts.join(found, "rec_id", "left")
    sums = judged.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("n_exact"), F.count("f").alias("fp"))
    n = found.agg(F.count(F.lit(1)).alias("n_seen"))
    wrong = F.col("fp") + F.abs(F.col("n_exact") - (F.col("n_seen") - F.col("fp")))
    return sums.crossJoin(F.broadcast(n)).select(F.lit(tab).alias("tab"), "n_rows", "n_seen", "n_exact", wrong.alias("n_wrong"), F.when(F.col("n_rows") > 0, wrong / F.col("n_rows")).otherwise(F.lit(0.0)).alias("rate"))
