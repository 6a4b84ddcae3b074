"""Problem 9: evaluation texts leaking into training text.

Passages are windows of consecutive tokens.  Their TF-IDF vectors are projected on the leading singular
vectors of all passages, found by a distributed randomised SVD; passages of documents whose latent
cosine with a passage of an item is high are candidates, and the longest common run and subsequence of
words decide.

Equal windows have equal latent vectors, so no passage in common is lost, whatever the rank.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

WORD = re.compile(r"[^\W_]+")
#: Scripts written without blanks; texts of the joined kind must hold one of these letters.
JOINED = re.compile(r"[㐀-䶿一-鿿豈-﫿]")
#: Tokens of a passage: consecutive words, or trigrams of the joined letters (20 letters).
WORDS, TRIGRAMS = 10, 18
RANK, POWER_ROUNDS = 48, 2
COSINE = 0.97
#: Held-out items sent to the tasks at once; more of them are searched for in blocks.
BLOCK_ITEMS = 20_000
BLOCK = 1024


class Items:
    """Vocabulary and passages of the held-out items; kind 0: words, kind 1: joined letters."""

    def __init__(self, rows: list[tuple[int, str | None, str | None]]):
        self.vocab: tuple[dict[str, int], dict[str, int]] = ({}, {})
        windows: tuple[list, list] = ([], [])
        owner: tuple[list, list] = ([], [])
        self.plain = False
        for item, text, lang in rows:
            if not text or item is None:
                continue
            kind = int((lang or "").lower().split("-")[0] == "zh")
            tokens = tokens_of(text, kind)
            ids = [self.vocab[kind].setdefault(t, len(self.vocab[kind])) for t in tokens]
            n = (WORDS, TRIGRAMS)[kind]
            for k in range(len(ids) - n + 1):
                windows[kind].append(ids[k : k + n])
                owner[kind].append(item)
                if kind:
                    self.plain |= not any(JOINED.search(t) for t in tokens[k : k + n])
        self.windows = tuple(np.array(w, np.int32).reshape(-1, n) for w, n in zip(windows, (WORDS, TRIGRAMS)))
        self.texts = {item: (int((lang or "").lower().split("-")[0] == "zh"), text) for item, text, lang in rows if text and item is not None}
        self.owner = tuple(np.array(o, np.int64) for o in owner)
        # tokens that few items hold
        held = tuple(np.zeros(len(v), np.int64) for v in self.vocab)
        for kind, text in self.texts.values():
            held[kind][[self.vocab[kind][t] for t in set(tokens_of(text, kind))]] += 1
        self.rare = tuple(h <= max(3, RARE * len(self.texts)) for h in held)


def tokens_of(text: str, kind: int) -> list[str]:
    words = WORD.findall(text.casefold())
    if not kind:
        return words
    joined = "".join(words)
    return [joined[k : k + 3] for k in range(len(joined) - 2)]


def _passages(items: Items):
    """Runs of tokens known to the items, long enough for a passage, and document frequencies.

    Rows: (doc_id, kind, ids) for a run; (null, kind, counts) once a partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq = [np.zeros(len(v) + 1, np.int64) for v in items.vocab]  # the last entry counts documents
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                out: list[tuple] = []
                texts = b.column(1).to_pylist()
                for kind in (0, 1):
                    vocab = items.vocab[kind]
                    if not vocab:
                        continue
                    get, parts, rows = vocab.get, [], []
                    for r, t in enumerate(texts):
                        if t and (not kind or items.plain or JOINED.search(t)):
                            tokens = tokens_of(t, kind)
                            parts.append(np.fromiter(map(get, tokens, repeat(-1)), np.int32, len(tokens)))
                            rows.append(r)
                    if not parts:
                        continue
                    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
                    flat = np.full(int(sizes.sum()), -1, np.int32)  # a -1 ends each document
                    ends = np.cumsum(sizes)
                    for p, e, n in zip(parts, ends, sizes):
                        flat[e - n : e - 1] = p
                    doc = np.repeat(np.array(rows), sizes)
                    known = flat >= 0
                    pair = np.unique(doc[known] * np.int64(len(vocab)) + flat[known])
                    freq[kind][:-1] += np.bincount(pair % len(vocab), minlength=len(vocab))
                    freq[kind][-1] += len(rows)
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], known]).astype(np.int8)))
                    starts, stops = edge[::2], edge[1::2]
                    for s, e in zip(starts, stops):
                        if e - s >= (WORDS, TRIGRAMS)[kind]:
                            out.append((b.column(0)[int(doc[s])].as_py(), kind, flat[s:e].tolist()))
                if out:
                    yield _batch(out)
        yield _batch([(None, k, f.tolist()) for k, f in enumerate(freq)])

    return run


PASSAGE = "doc_id bigint, kind int, ids array<int>"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.list_(pa.int32())))], ["doc_id", "kind", "ids"])


def _cut(ids: np.ndarray, n: int) -> np.ndarray:
    """All windows of ``n`` tokens."""
    return np.lib.stride_tricks.sliding_window_view(ids, n)


def _gram_product(windows: np.ndarray, idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """A' A basis for the unit TF-IDF rows of ``windows``."""
    out = np.zeros_like(basis)
    for k in range(0, len(windows), BLOCK):
        w = windows[k : k + BLOCK]
        weight = idf[w]
        weight = weight / np.maximum(np.sqrt((weight**2).sum(1, keepdims=True)), 1e-9)
        y = np.einsum("ij,ijr->ir", weight, basis[w])
        np.add.at(out, w.ravel(), (weight[:, :, None] * y[:, None, :]).reshape(-1, basis.shape[1]))
    return out


def latent_basis(passages: DataFrame, items: Items, kind: int, idf: np.ndarray) -> np.ndarray:
    """Leading right singular vectors of the passages' TF-IDF matrix, by randomised subspace iteration.

    Each round sends the current basis (vocabulary x rank, bounded by the items) to the tasks, which
    return their share of A'A times it; shares are added by blocks of rows, in parallel.
    """
    spark, n, size = passages.sparkSession, (WORDS, TRIGRAMS)[kind], len(idf)
    rank = min(RANK, size)
    own = items.windows[kind]
    basis = np.linalg.qr(np.random.default_rng(0).standard_normal((size, rank)))[0].astype(np.float32)
    rows_per = 512
    for _ in range(POWER_ROUNDS):
        sent = spark.sparkContext.broadcast(basis)

        def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, total = sent.value, None
            for b in batches:
                cut = [_cut(np.array(ids, np.int32), n) for ids in b.column(0).to_pylist()]
                if cut:
                    part = _gram_product(np.concatenate(cut), idf, now)
                    total = part if total is None else total + part
            if total is not None:
                k = range(0, size, rows_per)
                yield pa.RecordBatch.from_arrays([pa.array([x // rows_per for x in k], pa.int32()), pa.array([total[x : x + rows_per].tobytes() for x in k], pa.binary())], ["block", "part"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for b in batches:
                for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    x = np.frombuffer(x, np.float32)
                    sums[k] = sums[k] + x if k in sums else x
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["block", "part"])

        parts = passages.filter(F.col("doc_id").isNotNull() & (F.col("kind") == kind)).select("ids").mapInArrow(share, "block int, part binary")
        z = _gram_product(own, idf, basis)
        for r in parts.repartition("block").mapInArrow(add, "block int, part binary").collect():  # vocabulary x rank in all
            z[r["block"] * rows_per : (r["block"] + 1) * rows_per] += np.frombuffer(r["part"], np.float32).reshape(-1, rank)
        basis = np.linalg.qr(z.astype(np.float64))[0].astype(np.float32)
    return basis


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x**2).sum(1, keepdims=True)), 1e-9)


def _study(docs: DataFrame, held_out: DataFrame, doc_id: str, item_id: str, text: str, lang: str):
    """The items, the documents' two columns, their passages (written), which of the items' tokens are
    rare, and their idf."""
    items = Items([(r[0], r[1], r[2]) for r in held_out.select(item_id, text, lang).collect()])  # at most BLOCK_ITEMS
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    passages = written(rows.mapInArrow(_passages(items), PASSAGE), "passages")
    freq: tuple = tuple(np.zeros(len(v) + 1, np.int64) for v in items.vocab)
    counted = passages.filter("doc_id IS NULL").select("kind", F.posexplode("ids").alias("pos", "n")).groupBy("kind", "pos").agg(F.sum("n").alias("n"))
    for r in counted.collect():  # the items' vocabulary
        freq[r["kind"]][r["pos"]] = r["n"]
    # rare in the documents, or in the items: the leak's own copies can't raise the latter
    rare = tuple((f[:-1] <= max(3, RARE * f[-1])) | r for f, r in zip(freq, items.rare))
    return items, rows, passages, rare, tuple(np.log((f[-1] + 1) / (f[:-1] + 1)).astype(np.float32) + np.float32(0.1) for f in freq)


def _in_blocks(search, docs: DataFrame, held_out: DataFrame, item_id: str, *rest) -> DataFrame:
    """``search`` over blocks of at most about ``BLOCK_ITEMS`` items, each against all documents; rows of one
    item stay together."""
    blocks = -(-held_out.count() // BLOCK_ITEMS)
    if blocks <= 1:
        return search(docs, held_out, item_id, *rest)
    part = F.pmod(F.xxhash64(item_id), F.lit(blocks))
    found = [search(docs, held_out.filter(part == k), item_id, *rest) for k in range(blocks)]
    return reduce(DataFrame.unionByName, found)


def leaked_items(docs: DataFrame, held_out: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``doc_id`` and ``item_id`` of every document and item with a passage in common.

    A passage is ten consecutive words, or twenty joined letters and digits for items of lang zh,
    compared without case and separators.  Null, empty and blank texts share nothing; repeated rows give
    a pair once; an empty table gives no row; other columns are not read.  A block of the held-out items
    stands in memory; the documents never do.
    """
    return _in_blocks(_leaked_items, docs, held_out, item_id, doc_id, text, lang)


def _leaked_items(docs: DataFrame, held_out: DataFrame, item_id: str, doc_id: str, text: str, lang: str) -> DataFrame:
    spark = docs.sparkSession
    items, rows, passages, rare, idfs = _study(docs, held_out, doc_id, item_id, text, lang)
    found = None
    for kind in (0, 1):
        if not len(items.windows[kind]):
            continue
        idf = idfs[kind]
        basis = latent_basis(passages, items, kind, idf)
        own, owner, n = items.windows[kind], items.owner[kind], (WORDS, TRIGRAMS)[kind]
        placed = (idf[:, None] * basis).astype(np.float32)  # latent position of a token
        there = _unit(placed[own].sum(1))
        sent = spark.sparkContext.broadcast((own, owner, placed, there))

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, owner, placed, there = sent.value
            flipped = np.ascontiguousarray(there.T)
            for b in batches:
                windows, doc = [], []
                for d, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    cut = _cut(np.array(ids, np.int32), n)
                    windows.append(cut)
                    doc.append(np.full(len(cut), d))
                if not windows:
                    continue
                windows, doc = np.concatenate(windows), np.concatenate(doc)
                pairs = set()
                for k in range(0, len(windows), BLOCK):
                    w = windows[k : k + BLOCK]
                    here = _unit(placed[w].sum(1))
                    i, j = np.nonzero(here @ flipped >= COSINE)
                    same = (w[i] == own[j]).all(1)  # the longest common run reaches a passage
                    pairs |= set(zip(doc[k + i[same]].tolist(), owner[j[same]].tolist()))
                ds, its = zip(*pairs) if pairs else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(ds, pa.int64()), pa.array(its, pa.int64())], ["doc_id", "item_id"])

        hits = passages.filter(F.col("doc_id").isNotNull() & (F.col("kind") == kind)).select("doc_id", "ids").mapInArrow(search, "doc_id bigint, item_id bigint")
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return spark.createDataFrame([], f"{doc_id} bigint, {item_id} bigint")
    return found.distinct().select(F.col("doc_id").alias(doc_id), F.col("item_id").alias(item_id))


#: Tokens of a longer passage and known ones it must hold, by kind.
SPAN, LEAST_KNOWN = (40, 60), (12, 18)
#: Latent cosine of a candidate; share of the passage that the longest common subsequence must cover;
#: rare tokens (names, numbers: the answers) in common.
NEAR, COVER, ANSWERS = 0.7, 0.4, 3
#: Share of the documents, or of the items, up to which a token is rare.
RARE = 0.002


def _common(a: list[int], b: list[int]) -> tuple[int, int]:
    """Lengths of the longest common run and of the longest common subsequence."""
    x, y = np.array(a), np.array(b)
    best, run, row = 0, np.zeros(len(y) + 1, np.int64), np.zeros(len(y) + 1, np.int64)
    for t in x:
        same = (y == t) & (t >= 0)
        run[1:] = np.where(same, run[:-1] + 1, 0)
        best = max(best, int(run.max()))
        new = np.maximum(row[1:], np.where(same, row[:-1] + 1, 0))
        row[1:] = np.maximum.accumulate(new)
    return best, int(row[-1])


def _prints(windows: np.ndarray) -> np.ndarray:
    """A number for each window, the same for equal ones."""
    by = np.random.default_rng(1).integers(1, 2**62, windows.shape[1], np.int64) | 1
    return (windows.astype(np.int64) * by).sum(1)


def _word_for_word(ids: np.ndarray, kind: int, items: Items, index: tuple, rare: np.ndarray):
    """(item, run, lcs, answers) of each longest run of a document that holds a passage of an item.

    ``index``: the prints of the items' windows in order, and where these windows stand.
    """
    n, span, own = (WORDS, TRIGRAMS)[kind], SPAN[kind], items.windows[kind]
    if len(ids) < n or not len(own):
        return
    cut, (prints, place) = _cut(ids, n), index
    whole = np.flatnonzero((_cut(ids >= 0, n)).all(1))
    here = _prints(cut[whole])
    first, last = np.searchsorted(prints, here, "left"), np.searchsorted(prints, here, "right")
    hits = {(int(i), int(j)) for i, a, b in zip(whole[last > first], first[last > first], last[last > first]) for j in place[a:b] if (cut[i] == own[j]).all()}
    owner = items.owner[kind]
    same = lambda i, j, k: (i + k, j + k) in hits and owner[j + k] == owner[j]
    for i, j in hits:
        if j and same(i, j, -1):
            continue
        k = 0
        while same(i, j, k + 1):
            k += 1
        a, b = ids[i : i + span].tolist(), [*own[j].tolist()]
        for x in range(j + 1, min(j + span - n + 1, len(own))):
            if owner[x] != owner[j]:
                break
            b.append(int(own[x][-1]))
        yield int(owner[j]), k + n, _common(a, b)[1], len({x for x in a if x >= 0 and rare[x]} & set(b))


def similar_passages(docs: DataFrame, held_out: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Documents and items with a passage in common word for word or reworded: ``doc_id``, ``item_id``,
    ``run`` (longest common run), ``lcs`` (longest common subsequence of a passage) and ``answers`` (rare
    tokens in common), each the largest of the pair's passages.

    Every pair of ``leaked_items`` is a case, whatever its answers.  Besides, passages of ``SPAN`` tokens at
    every half span are candidates by latent cosine; the subsequence and the answers decide.  Nulls, repeats
    and empty tables as in ``leaked_items``.  A token's rarity in the items is that in its block of items.
    """
    return _in_blocks(_similar_passages, docs, held_out, item_id, doc_id, text, lang)


def _similar_passages(docs: DataFrame, held_out: DataFrame, item_id: str, doc_id: str, text: str, lang: str) -> DataFrame:
    spark = docs.sparkSession
    items, rows, passages, rare, idfs = _study(docs, held_out, doc_id, item_id, text, lang)
    known: dict[int, list] = {0: [], 1: []}
    for item, (kind, t) in items.texts.items():
        ids = [items.vocab[kind][x] for x in tokens_of(t, kind)]
        step = SPAN[kind] // 2
        for k in range(0, max(1, len(ids) - step), step):
            known[kind].append((item, ids[k : k + SPAN[kind]]))
    kinds = {}
    for kind, spans in known.items():
        if spans:
            placed = (idfs[kind][:, None] * latent_basis(passages, items, kind, idfs[kind])).astype(np.float32)
            prints = _prints(items.windows[kind])
            order = np.argsort(prints, kind="stable")
            kinds[kind] = (placed, _unit(np.stack([placed[ids].sum(0) for _, ids in spans])), rare[kind], (prints[order], order))
    sent = spark.sparkContext.broadcast((items, known, kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, known, kinds = sent.value
        for b in batches:
            out: dict[tuple[int, int], list[int]] = {}
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for kind, (placed, there, rare, index) in kinds.items():
                    if not t or kind and not items.plain and not JOINED.search(t):
                        continue
                    tokens = tokens_of(t, kind)
                    ids = np.fromiter(map(items.vocab[kind].get, tokens, repeat(-1)), np.int32, len(tokens))
                    for item, *measures in _word_for_word(ids, kind, items, index, rare):
                        out[d, item] = [max(x) for x in zip(out.get((d, item), (0, 0, 0)), measures)]
                    if kind and not JOINED.search(t):
                        continue
                    step = SPAN[kind] // 2
                    spans = [ids[k : k + SPAN[kind]] for k in range(0, max(1, len(ids) - step), step)]
                    spans = [x for x in spans if (x >= 0).sum() >= LEAST_KNOWN[kind]]
                    if not spans:
                        continue
                    here = _unit(np.stack([placed[x[x >= 0]].sum(0) for x in spans]))
                    for i, j in zip(*np.nonzero(here @ there.T >= NEAR)):
                        item, own = known[kind][j]
                        answers = len({x for x in spans[i].tolist() if x >= 0 and rare[x]} & set(own))
                        if answers < ANSWERS:
                            continue
                        longest, lcs = _common(spans[i].tolist(), own)
                        if lcs >= COVER * min(len(own), len(spans[i])):
                            got = out.setdefault((d, item), [0, 0, 0])
                            out[d, item] = [max(x) for x in zip(got, (longest, lcs, answers))]
            cols = list(zip(*((*k, *v) for k, v in out.items()))) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "item_id", "run", "lcs", "answers"])

    found = rows.mapInArrow(run, "doc_id bigint, item_id bigint, run bigint, lcs bigint, answers bigint")
    best = found.groupBy("doc_id", "item_id").agg(*[F.max(c).alias(c) for c in ("run", "lcs", "answers")])
    return best.withColumnsRenamed({"doc_id": doc_id, "item_id": item_id})
