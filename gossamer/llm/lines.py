"""Problem 5: lines repeated across one site's documents.

Every partition summarises each source by the fingerprints of its lines and their page counts, cut into
shards by fingerprint.  Summaries of a shard merge as Misra-Gries summaries do: counts add up, and where
more than ``COUNTERS`` stand side by side all counts fall by one.  That happens at most ``MIN_PAGES`` - 1
times, so no line at the threshold is lost; a summary that would need more keeps its counters.  A second
pass counts the candidate lines exactly, by their text; a third one marks or removes the confirmed lines.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import skew_join
from ..session import written
from .garbled import Mender
from .pages import LETTER, flag_redelivered, shown_lines

#: Different pages of a source in which a line must stand.
MIN_PAGES = 10
#: Lines that may be sent to every task as flat arrays of 20 bytes each (80 MB); beyond it they are joined
#: by shuffle, with the same rows.
MAX_SENT_LINES = 4_000_000
#: Counters of a summary before all of them fall by one, and pages for each shard of the fingerprints.
COUNTERS, SHARD_PAGES = 1_000_000, 200_000
#: Importance below which a line is its site's furniture, for the operators that judge by it.
FURNITURE = 0.75
#: Repeated lines of a source that must hold a name.
NAMED = 3
CONTENT = "content of the page"


def digest(source: int, line: str) -> bytes:
    """128 bits of a line within its source."""
    return xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass"), seed=source & 0xFFFFFFFF)


def digests(source: int, lines: list[str]) -> list[bytes]:
    """``digest`` of each line."""
    try:
        seed, of = source & 0xFFFFFFFF, xxhash.xxh3_128_digest
        return [of(x, seed) for x in lines]  # text is hashed as UTF-8
    except UnicodeEncodeError:  # half a surrogate pair
        return [digest(source, x) for x in lines]


def _first_half(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.uint64)[::2] if digests else np.zeros(0, np.uint64)


def _shard_bits(pages: int) -> int:
    """Bits of the fingerprint that number the shards: they follow the table."""
    return max(4, (max(pages, 1) // SHARD_PAGES).bit_length())


def _summaries(bits: int):
    """(source, shard, fingerprints, counts) of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints: dict[int, list[np.ndarray]] = {}
        held = 0

        def out() -> Iterator[pa.RecordBatch]:
            for source, parts in prints.items():
                fp, n = np.unique(np.concatenate(parts), return_counts=True)
                if not len(fp):
                    continue
                shard = (fp >> np.uint64(64 - bits)).astype(np.int64)  # sorted fingerprints come shard by shard
                cuts = np.flatnonzero(np.diff(shard)) + 1
                starts = np.concatenate([[0], cuts])
                n = np.minimum(n, 255).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(starts), source), pa.int32()), pa.array(shard[starts], pa.int32()), pa.array([x.tobytes() for x in np.split(fp, cuts)], pa.binary()), pa.array([x.tobytes() for x in np.split(n, cuts)], pa.binary())],
                    ["source", "shard", "prints", "counts"],
                )

        for b in batches:
            for source, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = _first_half(digests(source, [x for x in set(shown_lines(page)) if LETTER.search(x)]))
                prints.setdefault(source, []).append(own)
                held += len(own)
            if held > 2_000_000:
                yield from out()
                prints, held = {}, 0
        yield from out()

    return run


class Summary:
    """A mergeable summary of fingerprints; ``lost`` is what every count may have fallen by."""

    def __init__(self, counters: int, threshold: int):
        self.counters, self.threshold, self.lost = counters, threshold, 0
        self.prints, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, prints: np.ndarray, counts: np.ndarray) -> None:
        both, at = np.unique(np.concatenate([self.prints, prints]), return_inverse=True)
        sums = np.bincount(at, np.concatenate([self.counts, counts]), minlength=len(both)).astype(np.int64)
        while len(both) > self.counters and self.lost < self.threshold - 1:
            self.lost += 1
            sums -= 1
            both, sums = both[sums > 0], sums[sums > 0]
        self.prints, self.counts = both, sums

    def top(self) -> np.ndarray:
        """Fingerprints that may reach the threshold: none that does is left out."""
        return self.prints[self.counts + self.lost >= self.threshold]


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merged summaries; fingerprints that may reach the threshold."""
    held: dict[tuple[int, int], Summary] = {}
    wait: dict[tuple[int, int], list[tuple[bytes, bytes]]] = {}

    def settle(key: tuple[int, int]) -> None:
        parts = wait.pop(key)
        prints = np.concatenate([np.frombuffer(p, np.uint64) for p, _ in parts])
        held.setdefault(key, Summary(COUNTERS, MIN_PAGES)).add(prints, np.concatenate([np.frombuffer(c, np.uint8) for _, c in parts]).astype(np.int64))

    size = 0
    for b in batches:
        for s, k, p, c in zip(*(b.column(i).to_pylist() for i in range(4))):
            wait.setdefault((s, k), []).append((p, c))
            size += len(c)
        if size > 2_000_000:
            for key in list(wait):
                settle(key)
            size = 0
    for key in list(wait):
        settle(key)
    for (s, _), summary in held.items():
        top = summary.top()
        if len(top):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(top), s), pa.int32()), pa.array(top.view(np.int64))], ["source", "print"])


def _candidate_counts(sent):
    """Exact counts of candidate lines: (source, line, n, request_id); the id only for redelivered pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = sent.value if sent is not None else None
        counts: Counter = Counter()
        single: list[tuple] = []
        for b in batches:
            for source, page, rid, again in zip(*(b.column(i).to_pylist() for i in range(4))):
                lines = [x for x in set(shown_lines(page)) if LETTER.search(x)]
                if wanted is not None:
                    hit = _places(wanted, _first_half(digests(source, lines))) >= 0
                    lines = [x for x, on in zip(lines, hit.tolist()) if on]
                if again:
                    single += [(source, x, 0, rid) for x in lines]
                else:
                    counts.update((source, x) for x in lines)
            if len(counts) + len(single) > 500_000:
                yield _rows([*((s, x, n, None) for (s, x), n in counts.items()), *single])
                counts, single = Counter(), []
        yield _rows([*((s, x, n, None) for (s, x), n in counts.items()), *single])

    return run


def _places(have: np.ndarray, ask: np.ndarray) -> np.ndarray:
    """Where each asked number stands in a sorted array, or -1."""
    if not len(have):
        return np.full(len(ask), -1)
    at = np.minimum(np.searchsorted(have, ask), len(have) - 1)
    return np.where(have[at] == ask, at, -1)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.string(), pa.int64(), pa.int64()))], ["source", "line", "n", "rid"])


def repeated_lines(df: DataFrame, source: str = "queue_id", page: str = "page", key: str = "request_id", least: float | None = None) -> DataFrame:
    """``source``, ``line`` (shown text), ``n`` (different keys) of the lines standing in at least
    ``MIN_PAGES`` different keys of a source.

    With ``least``, lines count whose importance is below it as well: 1 for a line of a single key, 0 for
    one that all keys of its source hold (its normalised entropy).

    Lines without a letter never count.  Rows with a null source or page have no lines; a key delivered
    twice counts once; an empty table gives no row.
    """
    spark = df.sparkSession
    pages = df.select(F.col(source).cast("int").alias("source"), F.col(page).alias("page"), F.col(key).cast("bigint").alias("rid")).filter("source IS NOT NULL AND page IS NOT NULL")
    bits = _shard_bits(df.count())  # from Parquet footers
    merged = pages.select("source", "page").mapInArrow(_summaries(bits), "source int, shard int, prints binary, counts binary").repartition("source", "shard").mapInArrow(_merge, "source int, print bigint")
    top = np.unique(merged.select("print").limit(MAX_SENT_LINES + 1).toArrow().column("print").to_numpy().view(np.uint64))
    # beyond the bound all lines go to the exact count, which aggregates before it shuffles
    sent = spark.sparkContext.broadcast(top) if len(top) <= MAX_SENT_LINES else None
    flagged = flag_redelivered(pages, "rid").select("source", "page", "rid", "again")
    counted = flagged.mapInArrow(_candidate_counts(sent), "source int, line string, n bigint, rid bigint")
    found = counted.groupBy("source", "line").agg((F.sum("n") + F.count_distinct("rid")).alias("n")).filter(F.col("n") >= MIN_PAGES)
    if least is None:
        return found
    sizes = pages.groupBy("source").agg(F.count_distinct("rid").alias("of"))
    low = F.log("n") > (1 - least) * F.log("of")
    return found.join(sizes, "source").filter(low).select("source", "line", "n")


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h1, h2, n) of (source, line, n)."""
    for b in batches:
        both = np.frombuffer(b"".join(map(digest, b.column(0).to_pylist(), b.column(1).to_pylist())), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), b.column(2)], ["h1", "h2", "n"])


class Sent:
    """The confirmed lines as flat arrays: 128 bits of each line, and its pages."""

    def __init__(self, h1: np.ndarray, h2: np.ndarray, n: np.ndarray):
        order = np.argsort(h1, kind="stable")
        self.h1, self.h2, self.n = h1[order], h2[order], np.minimum(n[order], 2**31 - 1).astype(np.int32)

    def counts(self, source: int | None, lines: list[str]) -> list[int]:
        """The pages of each line within the source; 0 for a line that isn't confirmed."""
        if source is None or not lines or not len(self.h1):
            return [0] * len(lines)
        both = np.frombuffer(b"".join(digests(source, lines)), np.uint64).reshape(-1, 2)
        at = _places(self.h1, both[:, 0])
        return np.where((at >= 0) & (self.h2[at] == both[:, 1]), self.n[at], 0).tolist()


def _names_in(name: re.Pattern):
    """(source, name) of the names in each line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(s, w) for s, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for w in set(name.findall(x))]
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows], pa.int32()), pa.array([w for _, w in rows], pa.string())], ["source", "name"])

    return run


def _mended(mender: Mender | None, text: str, raw: list[str]) -> list[str]:
    """The shown lines after repair; as they stand where there is none."""
    if mender is None:
        return raw
    fixed, hit = mender.page(text)
    if not hit:
        return raw
    now = shown_lines(fixed)
    return now if len(now) == len(raw) else raw


def _listed(mend: bool):
    """All lines of all pages: (key, line_no, h1, h2); a line that repair changes has a row for either form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mender = Mender() if mend else None
        for b in batches:
            for s, text, key in zip(*(b.column(i).to_pylist() for i in range(3))):
                raw = shown_lines(text)
                rows = list(enumerate(raw))
                rows += [(k, y) for k, (x, y) in enumerate(zip(raw, _mended(mender, text, raw))) if x != y]
                both = np.frombuffer(b"".join([digest(s, x) for _, x in rows]), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(rows), pa.int64()), pa.array([k for k, _ in rows], pa.int32()), pa.array(both[:, 0]), pa.array(both[:, 1])], ["key", "line_no", "h1", "h2"])

    return run


def with_repeated_lines(df: DataFrame, source: str, page: str, key: str, work: Callable, schema: str, least: float | None = None, mend: bool = False, contents: bool = False, name: re.Pattern | None = None) -> DataFrame:
    """``work`` over the rows of all pages, a partition at a time; it yields record batches of ``schema``.

    A row: source, text, key, shown lines, the same after repair of garbled text (with ``mend``), for each
    line the pages it is repeated on, in either form, or 0 (``repeated_lines``), and the source's names: what
    ``name`` finds in at least ``NAMED`` of its repeated lines.  The repeated lines are
    sent to the tasks; where they are too many, each page is joined with its own.  With ``contents``, lines
    count by different pages instead of keys, so a page fetched often repeats nothing.
    """
    counted = df.select(source, page, F.xxhash64(page).alias(CONTENT)) if contents else df
    found = written(repeated_lines(counted, source, page, CONTENT if contents else key, least).select("source", "line", "n"), "site-lines")
    prints = found.mapInArrow(_digested, "h1 bigint, h2 bigint, n bigint")
    names = found.mapInArrow(_names_in(name), "source int, name string").groupBy("source", "name").count().filter(F.col("count") >= NAMED).select("source", "name") if name else None
    pages = df.select(F.col(source).cast("int").alias("source"), F.col(page).alias("page"), F.col(key).cast("bigint").alias("key")).filter("page IS NOT NULL")
    if found.count() <= MAX_SENT_LINES:  # from the written footers
        t = prints.toArrow()
        of: dict[int, set] = {}
        for r in names.toLocalIterator() if names is not None else ():  # fewer than the lines
            of.setdefault(r[0], set()).add(r[1])
        sent_names = df.sparkSession.sparkContext.broadcast({k: frozenset(v) for k, v in of.items()})
        sent = df.sparkSession.sparkContext.broadcast(Sent(*(t.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2", "n"))))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def rows():
                known, own, mender = sent.value, sent_names.value, Mender() if mend else None
                for b in batches:
                    for s, text, k in zip(*(b.column(i).to_pylist() for i in range(3))):
                        raw = shown_lines(text)
                        now, counts = _mended(mender, text, raw), known.counts(s, raw)
                        if now is not raw:
                            counts = [max(a, c) if x != y else a for a, c, x, y in zip(counts, known.counts(s, now), raw, now)]
                        yield s, text, k, raw, now, counts, own.get(s, frozenset())

            yield from work(rows())

        return pages.mapInArrow(run, schema)
    # hot lines are split by the adaptive join
    listed = pages.filter("source IS NOT NULL").mapInArrow(_listed(mend), "key bigint, line_no int, h1 bigint, h2 bigint")
    numbers = listed.join(prints, ["h1", "h2"]).groupBy("key", "line_no").agg(F.max("n").alias("n"))
    numbers = numbers.groupBy("key").agg(F.collect_list(F.struct("line_no", "n")).alias("bad"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            mender = Mender() if mend else None
            for b in batches:
                for s, text, k, bad, own in zip(*(b.column(i).to_pylist() for i in range(5))):
                    raw = shown_lines(text)
                    counts = [0] * len(raw)
                    for x in bad or () if s is not None else ():
                        counts[x["line_no"]] = x["n"]
                    yield s, text, k, raw, _mended(mender, text, raw), counts, frozenset(own or ())

        yield from work(rows())

    if names is None:
        pages = pages.withColumn("names", F.lit(None).cast("array<string>"))
    else:
        pages = skew_join(pages, names.groupBy("source").agg(F.collect_list("name").alias("names")), "source", "left")
    return pages.join(numbers, "key", "left").select("source", "page", "key", "bad", "names").mapInArrow(joined, schema)


def repeated_line_numbers(df: DataFrame, source: str = "queue_id", page: str = "page", key: str = "request_id") -> DataFrame:
    """``key`` and ``line_no`` of every line that ``repeated_lines`` confirms, each once.

    Nulls, redelivered rows and empty tables as in ``repeated_lines``.
    """

    def numbers(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        ids, nos = [], []
        for _, _, k, _, _, counts, _ in rows:
            own = [i for i, n in enumerate(counts) if n]
            nos += own
            ids += [k] * len(own)
            if len(ids) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(nos, pa.int32())], [key, "line_no"])
                ids, nos = [], []
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(nos, pa.int32())], [key, "line_no"])

    return with_repeated_lines(df.filter(F.col(source).isNotNull()), source, page, key, numbers, f"`{key}` bigint, line_no int").distinct()


def without_repeated_lines(df: DataFrame, source: str = "queue_id", page: str = "page", key: str = "request_id") -> DataFrame:
    """``key`` and ``page`` without its repeated lines; a page without a source is kept as it is, a null
    page stays null; rows delivered twice are kept as they stand."""

    def kept(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0
        for _, text, k, _, _, counts, _ in rows:
            ids.append(k)
            texts.append("\n".join(x for x, n in zip(text.split("\n"), counts) if not n))
            size += len(text)
            if size > 8_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string())], [key, page])
                ids, texts, size = [], [], 0
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string())], [key, page])

    found = with_repeated_lines(df, source, page, key, kept, f"`{key}` bigint, `{page}` string")
    return found.unionByName(df.filter(F.col(page).isNull()).select(F.col(key).cast("bigint").alias(key), F.col(page).cast("string").alias(page)))
