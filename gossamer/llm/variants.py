"""Problem 3: duplicates hidden by formatting differences.

A record's canonical form drops whitespace, case, punctuation and field order, and is hashed to 128 bits.
The hashes are split by range.  Each range owns a Bloom filter of once- and one of repeatedly-seen hashes,
merged from what the partitions send (every hash once); records whose hash may have been seen repeatedly go
to the exact grouping, all others are singletons.  No filter is sent to the tasks, so none is bounded by
the size of the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import skew_join
from ..session import written
from .mphf import mixed

#: Bits for each hash of a range's filters, and hash functions.
BITS_PER_HASH, FUNCTIONS = 16, 2
#: Records of a range on average, and records of a task among which copies are found before the shuffle.
RANGE_ROWS, BATCH_ROWS = 500_000, 131_072
WORD = r"[^\p{L}\p{Nd}\p{Nl}\p{No}]+"
#: Top-level labels that tell which end of a host name is the top (fixed values).
TOP_LABELS = "example test invalid localhost com org net edu gov mil int info biz arpa de fr es pt ru cn jp uk it nl ch at se us eu"


def words(text: Column) -> Column:
    """The lower-case words of ``text``, joined by single blanks."""
    return F.trim(F.regexp_replace(F.lower(text), WORD, " "))


def url_form(url: Column) -> Column:
    """Canonical address: words before the first ``?``, then the set of the fields' words after it."""
    at = F.instr(url, "?")
    head = F.when(at > 0, F.substring_index(url, "?", 1)).otherwise(url)
    tail = F.when(at > 0, F.substring(url, at + 1, F.length(url))).otherwise(F.lit(""))
    fields = F.filter(F.transform(F.split(tail, "[&;]"), words), lambda x: x != "")
    return F.when(url.isNotNull(), F.concat_ws("?", words(head), F.array_join(F.array_sort(F.array_distinct(fields)), "&")))


def host_form(name: Column) -> Column:
    """Canonical host name, read from the lowest label to the top one whichever way it stands.

    Labels are parted by anything but letters, digits, ``-`` and ``_``.  If just one end is a known top
    label it shows the direction; otherwise the smaller of both readings counts.
    """
    labels = F.filter(F.split(F.lower(name), r"[^\p{L}\p{Nd}\p{Nl}\p{No}_-]+"), lambda x: words(x) != "")
    there, back = words(F.array_join(labels, " ")), words(F.array_join(F.reverse(labels), " "))
    tops = F.array(*[F.lit(t) for t in TOP_LABELS.split()])
    first, last = F.array_contains(tops, F.substring_index(there, " ", 1)), F.array_contains(tops, F.substring_index(there, " ", -1))
    return F.when(last & ~first, there).when(first & ~last, back).otherwise(F.least(there, back))


def alias_form(hid: Column, alias_id: Column, alias: Column) -> Column:
    """Host form within one ``hid``; a null ``hid`` agrees with no other row."""
    owner = F.coalesce(hid.cast("string"), F.concat(F.lit("null "), alias_id))
    return F.concat(owner, F.lit("\t"), host_form(alias))


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Within a task: the smallest id of each hash stands for its copies, which are repeats already.

    ``sort`` 0: a hash met once here, 1: one with copies here, 2: such a copy, which needs no filter.
    """

    def out(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        tab, rid, h1, h2 = (pa.concat_arrays([x.column(k) for x in held]).to_numpy(zero_copy_only=False) for k in range(4))
        order = np.lexsort((rid, h2, h1))
        a, b = h1[order], h2[order]
        first = np.ones(len(order), bool)
        first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        last = np.ones(len(order), bool)
        last[:-1] = first[1:]
        sort = np.full(len(order), 2, np.int8)
        sort[order[first]] = 1
        sort[order[first & last]] = 0
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (tab, rid, h1, h2, sort)], ["tab", "rec_id", "h1", "h2", "sort"])

    held, n = [], 0
    for x in batches:
        held.append(x)
        n += x.num_rows
        if n >= BATCH_ROWS:
            yield out(held)
            held, n = [], 0
    if held:
        yield out(held)


class OnceTwice:
    """Bloom filters of the hashes seen once and seen repeatedly."""

    def __init__(self, n: int):
        self.bits = 1 << max(6, int(BITS_PER_HASH * max(n, 1) - 1).bit_length())
        self.once, self.twice = np.zeros(self.bits, bool), np.zeros(self.bits, bool)

    def _slots(self, h: np.ndarray, k: int) -> np.ndarray:
        return (mixed(h, k) & np.uint64(self.bits - 1)).astype(np.int64)

    def add(self, h: np.ndarray) -> None:
        for k in range(FUNCTIONS):
            at, n = np.unique(self._slots(h, k), return_counts=True)
            self.twice[at[self.once[at] | (n > 1)]] = True
            self.once[at] = True

    def may_repeat(self, h: np.ndarray) -> np.ndarray:
        """Whether each hash may have been added more than once; never wrong for one that was."""
        hit = np.ones(len(h), bool)
        for k in range(FUNCTIONS):
            hit &= self.twice[self._slots(h, k)]
        return hit


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range: the records whose hash may be repeated."""
    names = ["tab", "rec_id", "h1", "h2"]
    held: list[pa.RecordBatch] = []
    for x in batches:
        copies = pa.compute.equal(x.column("sort"), pa.scalar(2, pa.int8()))
        yield x.filter(copies).select(names)
        held.append(x.filter(pa.compute.invert(copies)))
    if not held:
        return
    filters = OnceTwice(sum(x.num_rows for x in held))
    for x in held:
        filters.add(x.column("h1").to_numpy())
    for x in held:
        on = filters.may_repeat(x.column("h1").to_numpy()) | (x.column("sort").to_numpy() == 1)
        yield x.filter(pa.array(on)).select(names)


def repeats(keyed: DataFrame, total: int) -> DataFrame:
    """Rows of ``keyed`` (``tab``, ``rec_id`` and the hash ``h1``, ``h2``) whose hash may occur more than
    once.  Never loses a repeat.

    A hot hash reaches its range once from each batch of a task; its copies spread by their ids.
    """
    ranges = max(int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE_ROWS))
    local = keyed.mapInArrow(_local, "tab tinyint, rec_id bigint, h1 bigint, h2 bigint, sort tinyint")
    spread = local.repartition(ranges, F.when(F.col("sort") == 2, F.col("rec_id")).otherwise(F.col("h1")))
    return spread.mapInArrow(_possible, "tab tinyint, rec_id bigint, h1 bigint, h2 bigint")


def variant_groups(parts: list[tuple[DataFrame, str, str, Column]], total: int | None = None) -> DataFrame:
    """Copies of records that differ only in form: ``tab``, ``keep_id``, ``dup_id``.

    ``parts`` holds (table, its name, id column, canonical form).  ``keep_id`` is the smallest id of a
    group, each other id is one ``dup_id``; a group's copies are its rows plus one.  A null form is no
    case; identical values are copies; a row delivered twice under one id is one record; an empty table
    gives no row; a form without any word (only punctuation) is a value like others; a null id names no
    record.  Forms agree when their 128-bit hashes do.
    """
    keyed = None
    for i, (df, _, rec_id, form) in enumerate(parts):
        one = df.select(F.col(rec_id).cast("bigint").alias("rec_id"), form.alias("form")).filter("form IS NOT NULL AND rec_id IS NOT NULL")
        one = one.select(F.lit(i).cast("tinyint").alias("tab"), "rec_id", F.xxhash64(F.lit(2 * i + 1), "form").alias("h1"), F.xxhash64(F.lit(-2 * i - 2), "form").alias("h2"))
        keyed = one if keyed is None else keyed.unionByName(one)
    if total is None:
        total = sum(df.count() for df, *_ in parts)  # from Parquet footers
    maybe = written(repeats(keyed, total), "possible-repeats")
    # exact grouping: partial minima leave each map task once per form, however often it occurs there
    groups = maybe.groupBy("h1", "h2").agg(F.min("rec_id").alias("keep_id"), F.max("rec_id").alias("last_id")).filter("keep_id < last_id")
    heads = groups.select("h1", F.col("h2").alias("other"), "keep_id")
    pairs = skew_join(maybe, heads, "h1").filter("h2 = other AND rec_id > keep_id")
    names = F.array(*[F.lit(t) for _, t, _, _ in parts])
    return pairs.select(F.element_at(names, F.col("tab").cast("int") + 1).alias("tab"), "keep_id", F.col("rec_id").alias("dup_id")).distinct()
