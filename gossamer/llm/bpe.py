"""Problem 8: encoding a corpus with a public byte-level BPE vocabulary.

Texts are cut into words by the vocabulary's own pattern; the distinct new words of a batch are merged
together: their symbols stand in one flat array, every round looks the adjacent pairs up by binary
search among the sorted pair keys and merges each word's lowest-ranked pair.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The vocabulary's public word pattern (fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words a worker remembers before it starts anew.
CACHE_WORDS = 400_000
NONE = np.iinfo(np.int32).max


class Merger:
    """Byte-level BPE over many words at once."""

    def __init__(self, path: str):
        ranks = {}
        with open(path, "rb") as f:
            for line in f:
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        keys, out = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    out.append(rank)
        order = np.argsort(keys)
        self.keys = np.array(keys, np.int64)[order]
        self.out = np.array(out, np.int32)[order]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.out[at], NONE)

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """Token ids of each word."""
        done: list[np.ndarray | None] = [None] * len(words)
        lens = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), lens)
        while len(sym):
            # pairs reach from i to i + 1 within a word; the last symbol of a word has none
            rank = np.full(len(sym), NONE, np.int32)
            inside = np.flatnonzero(word[1:] == word[:-1])
            rank[inside] = self.ranks(sym[inside], sym[inside + 1])
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            lowest = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(sym)))
            over = lowest == NONE
            if over.any():
                for k in np.flatnonzero(over):
                    done[word[starts[k]]] = sym[starts[k] : starts[k] + sizes[k]].copy()
                keep = np.repeat(~over, sizes)
                sym, word, rank = sym[keep], word[keep], rank[keep]
                lowest, sizes = lowest[~over], sizes[~over]
                if not len(sym):
                    break
            pick = rank == np.repeat(lowest, sizes)
            at = np.flatnonzero(pick)
            # overlapping candidates stand side by side: of each run take the first, third, ...
            run = np.concatenate([[True], np.diff(at) != 1])
            first = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - first) % 2 == 0]
            sym = sym.copy()
            sym[at] = rank[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            sym, word = sym[keep], word[keep]
        return [x if x is not None else np.zeros(0, np.int32) for x in done]


@lru_cache(maxsize=4)
def merger(path: str) -> Merger:
    return Merger(path)


@lru_cache(maxsize=4)
def _pattern():
    import regex

    return regex.compile(PATTERN)


class Encoder:
    """Texts to token ids, remembering the words met so far."""

    def __init__(self, path: str = VOCABULARY):
        self.merger, self.cut = merger(path), _pattern().findall
        self.index: dict[str, int] = {}
        self.ids: list[np.ndarray] = []

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts and the offsets of each; a null and an empty text have none."""
        if len(self.index) > CACHE_WORDS:
            self.index, self.ids = {}, []
        index, start = self.index, len(self.index)
        lens, at = [], []
        for t in texts:
            words = self.cut(t) if t else []
            lens.append(len(words))
            for w in words:
                i = index.get(w)
                if i is None:
                    i = index[w] = len(index)
                at.append(i)
        new = [w.encode("utf-8", "surrogatepass") for w in list(index)[start:]]
        self.ids += self.merger.merge(new) if new else []
        at = np.array(at, np.int64)
        # ragged gather over the words in use
        used, back = np.unique(at, return_inverse=True)
        parts = [self.ids[i] for i in used]
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        base = np.cumsum(size) - size
        n = size[back]
        ends = np.cumsum(n)
        out = flat[np.repeat(base[back] - (ends - n), n) + np.arange(int(n.sum()))] if len(back) else flat
        upto = np.concatenate([[0], ends])
        cuts = np.concatenate([[0], np.cumsum(lens)])
        return out.astype(np.int32), upto[cuts].astype(np.int64)


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """``key`` and ``ids`` (token ids without special tokens) of each row.

    Text that looks like a special token is ordinary text.  A null and an empty text give an empty list,
    a blank text is encoded as it is; a null key and repeated rows are kept as they stand.  Only the two
    columns are read, whatever else the table holds.  ``path`` must be readable on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(path)
        for whole in batches:
            for k in range(0, whole.num_rows, 1000):
                b = whole.slice(k, 1000)
                ids, offsets = enc.encode(b.column(1).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0), lists], [key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")
