"""Shared pieces: words and their hashes, rolling hashes over characters, grouped streams, components."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidara.session import scratch

#: Words are runs of letters or digits, lower case.
WORD = re.compile(r"[^\W_]+")
U64 = np.uint64
#: Words of which a worker keeps the hash; the table starts anew beyond.
CACHED_WORDS = 1_000_000


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > CACHED_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_HASHES = _WordHashes()


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def hashed_words(text: str) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, WORD.findall(text.lower())), dtype=U64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every bit of the result depends on every bit of x."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U64(33))
        x = x * U64(0xFF51AFD7ED558CCD)
        x = x ^ (x >> U64(33))
        x = x * U64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> U64(33))


def shingles(w: np.ndarray, width: int) -> np.ndarray:
    """A hash of every run of width consecutive words, in order; empty where there are fewer words."""
    n = len(w) - width + 1
    if n <= 0:
        return np.empty(0, U64)
    with np.errstate(over="ignore"):
        h = w[:n].copy()
        for j in range(1, width):
            h = h * U64(0x9E3779B97F4A7C15) + w[j : j + n]
    return mix(h)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def rolling(points: np.ndarray, width: int) -> np.ndarray:
    """A hash of every run of width characters, by doubling: exact for any width, in log(width) passes."""
    n = len(points) - width + 1
    if n <= 0:
        return np.empty(0, U64)
    with np.errstate(over="ignore"):
        power, have = mix(points.astype(U64) + U64(0x51ED27)), 1
        whole, done, rest, factor = None, 0, width, 0xD6E8FEB86659FD93
        while rest:
            if rest & 1:
                part = power[done : done + n]
                whole = part if whole is None else whole * U64(factor) + part
                done += have
            rest >>= 1
            if rest:
                power = power[:-have] * U64(factor) + power[have:]
                have *= 2
                factor = factor * factor & (2**64 - 1)
    return mix(whole)


def window_min(h: np.ndarray, window: int) -> np.ndarray:
    """Where the least value of every window of h lies, the leftmost where several are least."""
    n = len(h)
    if n < window:
        return np.empty(0, np.int64)
    # doubling again: the place of the least value of runs of 1, 2, 4 ... then two overlapping runs
    best, have = np.arange(n), 1
    while have * 2 <= window:
        left, right = best[:-have], best[have:]
        best = np.where(h[right] < h[left], right, left)
        have *= 2
    left, right = best[: n - window + 1], best[window - have :]
    return np.where(h[right] < h[left], right, left)


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def batches(schema: pa.Schema, columns: list, rows: int = 100_000) -> Iterator[pa.RecordBatch]:
    """Columns as record batches of bounded size."""
    table = pa.table(columns, schema=schema)
    yield from table.to_batches(max_chunksize=rows)


def groups(batches_in: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by key; only the group at a batch's end is carried on."""
    held: list[pa.RecordBatch] = []
    for b in batches_in:
        if not b.num_rows:
            continue
        k = b.column(key).to_numpy(zero_copy_only=False)
        cut = int(np.flatnonzero(k != k[-1])[-1]) + 1 if (k != k[-1]).any() else 0
        if held and (cut or held[-1].column(key)[-1].as_py() != k[0]):
            if held[-1].column(key)[-1].as_py() != k[0]:
                yield pa.Table.from_batches(held)
                held = []
        if cut:
            yield pa.Table.from_batches([*held, b.slice(0, cut)])
            held = []
        held.append(b.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def components(links: DataFrame) -> DataFrame:
    """(node, group) of every node in links(a, b): group is the least node that it is linked with.

    Alternating large-star and small-star rounds, each written to the shared folder; no component is ever
    gathered. Links of a node with itself count as a node without links. Rounds go on until one changes nothing; their number grows
    with the square of the logarithm of the nodes at most.
    """
    edges = scratch(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").union(edges.where("a = b").select("a", "b"))
        large = large.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(down, "b")
        small = small.select(F.col("m").alias("a"), "b").union(small.select(F.col("m").alias("a"), F.col("a").alias("b"))).distinct()
        edges = scratch(small, "edges")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    return edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("group")).unionByName(
        edges.select(F.col("a").alias("node"), F.col("a").alias("group")).distinct()
    ).groupBy("node").agg(F.min("group").alias("group"))


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield from fn(b)

    return df.mapInArrow(run, schema)
