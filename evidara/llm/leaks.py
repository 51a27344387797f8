"""Held-out passages inside a corpus.

Every window of `width` consecutive words, in items and texts alike, gets a SimHash: each word pair of the window votes
with its weight on each of 64 bits. Windows are cut at the length that counts as a leak rather than
at an item's, so that a part of an item is found as well. The bits are indexed in `radius + 1` blocks: fingerprints
within `radius` bits agree in one block at least, so that looking up every block retrieves all of them. Retrieved windows are
verified by their weighted shingle similarity; at the default `similarity` of 1 all shingles must be equal, in order.

Items are read in blocks of bounded size, each looked up by all texts; the corpus is never shuffled. Null texts and passages, and those under `width` words, are in no leak. Repeated items
count once; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidara.llm.common import U64, arrow_map, hashed_words, mix, shingles
from evidara.session import spread

#: Windows of items in one block, which every task holds: 40 bytes each.
BLOCK = 1_000_000
#: Words of texts that are fingerprinted at a time.
AT_ONCE = 1 << 15
_SPREAD = np.array([[b >> k & 1 for k in range(8)] for b in range(256)], np.int8) * 2 - 1


def weights_of(pairs: np.ndarray) -> np.ndarray:
    """A weight of 1 to 4 for each word pair, drawn from its hash, so that no two bits are often tied."""
    return (pairs & U64(3)).astype(np.int16) + 1


def fingerprints(pairs: np.ndarray, span: int) -> np.ndarray:
    """64-bit SimHashes of every run of span consecutive word pairs."""
    n = len(pairs) - span + 1
    if n <= 0:
        return np.empty(0, U64)
    votes = _SPREAD[mix(pairs).view(np.uint8)].reshape(len(pairs), 64) * weights_of(pairs)[:, None]
    total = np.zeros((len(pairs) + 1, 64), np.int32)
    np.cumsum(votes, axis=0, out=total[1:])
    bits = total[span:] > total[:-span]
    return np.packbits(bits, axis=1, bitorder="little").view(U64).ravel()


class Index:
    """The windows of a block of items, by blocks of their fingerprints' bits."""

    def __init__(self, items: list[tuple[int, str]], width: int, radius: int, similarity: float, stride: int = 1):
        self.width, self.radius, self.similarity = width, radius, similarity
        own, prints, at, pairs, exact = [], [], [], [], []
        base = 0
        for item, passage in items:
            w = hashed_words(passage)
            p = shingles(w, 2)
            f = fingerprints(p, width - 1)
            if len(f):
                kept = np.unique(np.append(np.arange(0, len(f), stride), len(f) - 1))
                own.append(np.full(len(kept), item))
                prints.append(f[kept])
                at.append(base + kept)
                exact.append(shingles(w, width)[kept])
                pairs.append(p)
                base += len(p)
        none = np.empty(0, np.int64)
        self.own, self.at = (np.concatenate(x) if x else none for x in (own, at))
        self.prints, self.pairs, self.exact = (np.concatenate(x) if x else np.empty(0, U64) for x in (prints, pairs, exact))
        # equal fingerprints are retrieved together
        self.kinds, self.kind = np.unique(self.prints, return_inverse=True)
        self.order = np.argsort(self.kind, kind="stable")
        self.first = np.searchsorted(self.kind[self.order], np.arange(len(self.kinds) + 1))
        cuts = np.linspace(0, 64, radius + 2).astype(int)
        self.blocks = []
        for a, z in zip(cuts[:-1], cuts[1:]):
            key = self.kinds >> U64(a) & U64((1 << int(z - a)) - 1)
            order = np.argsort(key, kind="stable")
            # the leading bits of a block tell quickly which keys there are
            bits = min(16, int(z - a))
            there = np.zeros(1 << bits, bool)
            there[(key & U64((1 << bits) - 1)).astype(np.int64)] = True
            self.blocks.append((U64(a), U64((1 << int(z - a)) - 1), key[order], order, there, U64((1 << bits) - 1)))

    def look_up(self, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, kind): all pairs of fingerprints within the radius."""
        left, right = [], []
        for shift, mask, keys, order, there, low in self.blocks:
            key = f >> shift & mask
            near = np.flatnonzero(there[(key & low).astype(np.int64)])
            a, z = np.searchsorted(keys, key[near]), np.searchsorted(keys, key[near], side="right")
            n = z - a
            x = np.repeat(near, n)
            k = order[np.repeat(a - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())] if n.sum() else np.empty(0, np.int64)
            ok = np.bitwise_count(f[x] ^ self.kinds[k]) <= self.radius
            left.append(x[ok])
            right.append(k[ok])
        x, k = np.concatenate(left), np.concatenate(right)
        both = np.unique(x.astype(np.int64) * max(1, len(self.kinds)) + k)
        return both // max(1, len(self.kinds)), both % max(1, len(self.kinds))

    def matches(self, w: np.ndarray, owner: np.ndarray) -> list[tuple[int, int, int]]:
        """(owner, item, windows in common) for the hashed words w of several owners."""
        span = self.width - 1
        p = shingles(w, 2)
        f = fingerprints(p, span)
        if not len(f) or not len(self.kinds):
            return []
        whole = np.flatnonzero(owner[: len(f)] == owner[self.width - 1 : self.width - 1 + len(f)])
        x, k = self.look_up(f[whole])
        x = whole[x]
        exact = shingles(w, self.width)
        found: dict[tuple[int, int], int] = {}
        n = self.first[k + 1] - self.first[k]
        x = np.repeat(x, n)
        j = self.order[np.repeat(self.first[k] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())] if len(n) else np.empty(0, np.int64)
        if self.similarity >= 1:
            ok = exact[x] == self.exact[j]
        else:
            ok = np.fromiter((self._alike(p[a : a + span], self.pairs[b : b + span]) for a, b in zip(x, self.at[j])), bool, len(x))
        seen = set(zip(owner[x[ok]].tolist(), self.own[j[ok]].tolist(), x[ok].tolist()))
        for o, item, _ in seen:
            found[o, item] = found.get((o, item), 0) + 1
        return [(o, item, n) for (o, item), n in found.items()]

    def _alike(self, a: np.ndarray, b: np.ndarray) -> bool:
        a, b = np.unique(a), np.unique(b)
        both = weights_of(np.intersect1d(a, b)).sum()
        return both >= self.similarity * weights_of(np.union1d(a, b)).sum()


def leaks(texts: DataFrame, id_col: str, text_col: str, items: DataFrame, item_col: str, passage_col: str, width: int = 10, radius: int = 3, similarity: float = 1.0, stride: int = 1, block: int = BLOCK) -> DataFrame:
    """(id, item, windows): texts that hold windows of items, and how many of the text's windows do.

    stride: words from one window of an item to the next. Texts are met at every word, so that a stride over 1 still finds
    whatever repeats width + stride - 1 words of an item, but not all that is alike to windows in between; no query uses one.
    """
    docs = spread(texts.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null"))
    held = items.select(F.col(item_col).cast("long").alias("item"), F.col(passage_col).alias("passage")).where("item is not null and passage is not null").distinct()
    result = None
    for part in _blocks(held, block):
        shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, part))
        found = arrow_map(docs, _finder(shared, width, radius, similarity, stride), "id long, item long, windows long")
        result = found if result is None else result.unionByName(found)
    if result is None:
        return docs.select("id", F.lit(0).cast("long").alias("item"), F.lit(0).cast("long").alias("windows")).where("false")
    return result.groupBy("id", "item").agg(F.max("windows").alias("windows"))


def by_item(found: DataFrame) -> DataFrame:
    """(item, texts, windows): how many texts each leaked item is in, and how many of their windows hold it."""
    return found.groupBy("item").agg(F.count("*").alias("texts"), F.sum("windows").alias("windows"))


def _blocks(items: DataFrame, block: int) -> Iterator[list[tuple[int, str]]]:
    """The items, a block of at most so many words (or one item) at a time."""
    part: list[tuple[int, str]] = []
    size = 0
    for r in items.toLocalIterator():
        n = len(r.passage) // 4 + 1
        if part and size + n > block:
            yield part
            part, size = [], 0
        part.append((r.item, r.passage))
        size += n
    if part:
        yield part


_INDEXES: dict = {}


def _finder(shared, width: int, radius: int, similarity: float, stride: int):
    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        name, part = shared.value
        key = (name, width, radius, similarity, stride)
        if key not in _INDEXES:
            _INDEXES.clear()
            _INDEXES[key] = Index(part, width, radius, similarity, stride)
        index = _INDEXES[key]
        rows, held, ids, size = [], [], [], 0
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            w = hashed_words(t)
            if len(w) < width:
                continue
            held.append(w)
            ids.append(i)
            size += len(w)
            if size >= AT_ONCE:
                rows += _found(index, held, ids)
                held, ids, size = [], [], 0
        if held:
            rows += _found(index, held, ids)
        if rows:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows)], names=["id", "item", "windows"])

    return run


def _found(index: Index, held: list[np.ndarray], ids: list[int]) -> list[tuple[int, int, int]]:
    owner = np.repeat(np.arange(len(held)), [len(w) for w in held])
    return [(ids[o], item, n) for o, item, n in index.matches(np.concatenate(held), owner)]
