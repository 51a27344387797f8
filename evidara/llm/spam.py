"""Pages of repeated keywords, link lists and product tags, told from pages of sentences.

The order of neighbouring words is judged by pointwise mutual information from counts over the whole corpus. Words of one subject
attract each other in any order, which makes the plain mean large for word salad too; what is summed up is therefore
PMI(a, b) - PMI(b, a), in which what a subject's words have in common cancels out and what sentences put in order remains. It is
set against the most that the block's pairs could reach, had each been seen in its more frequent order only, and a prior for pairs that were
hardly seen at all, so that coherence lies between -1 and 1 in corpora of any size. A block of text is word salad where it is incoherent, or less than coherent while it runs on
without ends of sentences. It is overused where it is less than coherent and its collocations come back within few words.
Blocks that consist of links are flagged as such. Code and tables never count.

Pairs count as seen where two texts hold them or more; counts leave out the text that is judged. Up to `held` of them are broadcast, in pieces
so that the driver never holds them all, more are joined with each text's own pairs; the result is the same.
Null and empty texts have a share of 0. Other columns are ignored; a repeated id with several texts counts with the largest share.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidara.llm.common import _HASHES, CACHED_WORDS, U64, arrow_map, as_long, mix
from evidara.session import few_rows, scratch, spread


@dataclass(frozen=True)
class SpamSettings:
    """incoherent: coherence below which any block is stuff; weak: coherence below which a block is stuff if it
    runs on for more than `breath` words without the end of a sentence, or if the share `repeated` of its collocations come again within `window`
    of them; links: share of a block's characters that makes it a list of links; least_pairs: pairs that a block needs to be judged by order;
    held: pairs whose counts are broadcast, 12 bytes each, at most; share: of a text's characters in stuff that makes it a case."""

    incoherent: float = 0.02
    weak: float = 0.52
    repeated: float = 0.3
    breath: float = 40
    window: int = 60
    links: float = 0.5
    least_pairs: int = 8
    held: int = 5_000_000
    share: float = 0.5


#: Links: bare addresses, Markdown targets, anchors.
LINK = re.compile(r"\[[^\]\n]*\]\([^)\n]*\)|<a\b[^>]*>[^<\n]*</a>|<br\s*/?>|(?:https?:)?//\S+", re.I)
TARGET = re.compile(r"\]\([^)\n]*\)|<[^>\n]*>|(?:https?:)?//\S+", re.I)
#: Words, and what ends a sentence.
TOKEN = re.compile(r"[^\W_]+|[.!?;:]+(?=\s|$)")
GAP = re.compile(r"\n[ \t\r]*\n")
FENCE = re.compile(r"^[ \t]*(```|~~~)[^\n]*\n.*?(?:^[ \t]*\1[^\n]*$|\Z)", re.M | re.S)


def blocks(text: str) -> list[tuple[str, bool]]:
    """(block, judged): the text cut at blank lines; code and tables are not judged."""
    out, last = [], 0
    for m in FENCE.finditer(text):
        out += [(b, True) for b in GAP.split(text[last : m.start()])]
        out.append((m.group(), False))
        last = m.end()
    out += [(b, True) for b in GAP.split(text[last:])]
    return [(b, judged and not _table(b)) for b, judged in out]


def _table(block: str) -> bool:
    lines = [x.strip() for x in block.splitlines() if x.strip()]
    return len(lines) > 1 and sum(x[0] == "|" for x in lines) * 2 > len(lines)


class _Tokens(dict):
    """Hashes of words; 0 for what ends a sentence."""

    def __missing__(self, token: str) -> int:
        h = 0 if token[0] in ".!?;:" else _HASHES[token] or 1
        if len(self) > CACHED_WORDS:
            self.clear()
        self[token] = h
        return h


_TOKENS = _Tokens()


class Read:
    """Several texts as hashed words: w, the block of each word and the text of each block."""

    def __init__(self, texts: list[str]):
        self.text_of: list[int] = []
        self.blocks: list[str] = []
        self.judged: list[bool] = []
        tokens: list[str] = []
        sizes = []
        for n, text in enumerate(texts):
            for b, judged in blocks(text):
                self.text_of.append(n)
                self.blocks.append(b)
                self.judged.append(judged)
                before = len(tokens)
                if judged:
                    low = b.lower()
                    tokens += TOKEN.findall(TARGET.sub(" ", low) if "//" in low or "](" in low or "<" in low else low)
                sizes.append(len(tokens) - before)
        self.w = np.fromiter(map(_TOKENS.__getitem__, tokens), U64, len(tokens))
        self.ends = np.cumsum(sizes, dtype=np.int64)
        self.block = np.repeat(np.arange(len(sizes)), sizes)
        left, right = self.w[:-1], self.w[1:]
        #: Where the first word of each pair of neighbours stands.
        self.at = np.flatnonzero((left != 0) & (right != 0) & (self.block[:-1] == self.block[1:])) if len(self.w) > 1 else np.empty(0, np.int64)

    def pairs(self, back: bool = False) -> np.ndarray:
        """A key of every pair of neighbours; back: of the pair the other way round."""
        a, b = (self.w[self.at + 1], self.w[self.at]) if back else (self.w[self.at], self.w[self.at + 1])
        with np.errstate(over="ignore"):
            return mix(a * U64(0x9E3779B97F4A7C15) + b)

    def words(self, block: int) -> tuple[np.ndarray, int]:
        """(the words of a block, how many sentences they make)."""
        own = self.w[self.ends[block - 1] if block else 0 : self.ends[block]]
        word = own != 0
        return own[word], int(np.count_nonzero(word & ~np.append(False, word[:-1])))


class Counts:
    """Counts of pairs by key; 0 for pairs that are not seen."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.counts = keys[order], counts[order].astype(np.float32)

    def of(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys), np.float32)
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == keys, self.counts[at], 0)


def judge(texts: list[str], counts: Counts, settings: SpamSettings) -> list[list[tuple[str, int, float]]]:
    """For each text (kind, characters, coherence) of its blocks: kind is '', 'links', 'salad' or 'repeated'."""
    r = Read(texts)
    ahead, back = r.pairs(), r.pairs(True)
    n, blocks_of = len(ahead), r.block[r.at]
    salt = mix(np.asarray(r.text_of, U64))[blocks_of] if n else np.empty(0, U64)
    own, inverse, times = np.unique(ahead ^ salt, return_inverse=True, return_counts=True)
    mine = times[inverse] if n else np.empty(0)
    there = np.searchsorted(own, back ^ salt)
    there[there == len(own)] = 0
    mine_back = np.where(own[there] == back ^ salt, times[there], 0) if n else np.empty(0)
    kinds, which = np.unique(np.concatenate([ahead, back]), return_inverse=True)
    every = counts.of(kinds)[which]
    one, other = np.maximum(0, every[:n] - mine) + 0.5, np.maximum(0, every[n:] - mine_back) + 0.5
    k = np.bincount(blocks_of, minlength=len(r.blocks))
    order = np.bincount(blocks_of, weights=np.log(one / other), minlength=len(r.blocks))
    most = np.bincount(blocks_of, weights=np.log(np.maximum(one, other) / 0.5), minlength=len(r.blocks))
    coherence = order / np.maximum(most + PRIOR * k, 1e-9)
    again = _again(ahead, blocks_of, k, settings.window)
    out: list[list[tuple[str, int, float]]] = [[] for _ in texts]
    for i, (b, judged) in enumerate(zip(r.blocks, r.judged)):
        kind = ""
        if judged:
            if ("//" in b or "](" in b or "<" in b) and sum(len(m.group()) for m in LINK.finditer(b)) >= settings.links * max(1, len(b.strip())):
                kind = "links"
            elif k[i] >= settings.least_pairs and coherence[i] < settings.weak:
                w, sentences = r.words(i)
                if coherence[i] < settings.incoherent or len(w) > settings.breath * sentences:
                    kind = "salad"
                elif again[i] >= settings.repeated:
                    kind = "repeated"
        out[r.text_of[i]].append((kind, len(b), float(coherence[i])))
    return out


def _again(pairs: np.ndarray, block: np.ndarray, k: np.ndarray, window: int) -> np.ndarray:
    """The share of each block's collocations that come more than once among the `window` that they stand with."""
    if not len(pairs):
        return np.zeros(len(k))
    span = (np.arange(len(pairs)) - np.searchsorted(block, block)) // window
    with np.errstate(over="ignore"):
        place = mix(block.astype(U64) * U64(0x9E3779B97F4A7C15) + span.astype(U64))
    _, which, times = np.unique(pairs ^ place, return_inverse=True, return_counts=True)
    return np.bincount(block, weights=times[which] > 1, minlength=len(k)) / np.maximum(1, k)


#: What a pair weighs beside its counts: as much as four sightings.
PRIOR = float(np.log(9))
_COUNTS: dict = {}


#: Characters that are judged or counted at a time.
AT_ONCE = 1 << 19


def _batches(texts: list[str]) -> Iterator[list[str]]:
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size > AT_ONCE:
            yield held
            held, size = [], 0
    if held:
        yield held


def _pairs_of(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """(key, n, texts): how often a batch has each pair, and in how many texts."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0
    for texts in _batches(b.column(0).to_pylist()):
        held.append(_counted(Read(texts)))
        size += len(held[-1][0])
        if size > 2_000_000:
            yield _added(held)
            held, size = [], 0
    if held:
        yield _added(held)


def _counted(r: Read) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys, text = r.pairs(), np.asarray(r.text_of, np.int64)[r.block[r.at]]
    # pairs stand in the order of their texts, which a stable sort keeps
    order = np.argsort(keys, kind="stable")
    keys, text = keys[order], text[order]
    new = np.append(True, keys[1:] != keys[:-1])[: len(keys)]
    first = np.flatnonzero(new)
    texts = np.add.reduceat((new | np.append(True, text[1:] != text[:-1])[: len(keys)]).astype(np.int64), first) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys))), texts


def _added(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    keys, n, texts = (np.concatenate(c) for c in zip(*held))
    keys, which = np.unique(keys, return_inverse=True)
    sums = (np.bincount(which, weights=c, minlength=len(keys)).astype(np.int64) for c in (n, texts))
    return pa.record_batch([pa.array(as_long(keys)), *map(pa.array, sums)], names=["key", "n", "texts"])


def _asked(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """(id, digest, key): the pairs of each text, either way round."""
    for i, digest, text in zip(*(b.column(c).to_pylist() for c in ("id", "digest", "text"))):
        r = Read([text])
        keys = np.unique(np.concatenate([r.pairs(), r.pairs(True)]))
        if len(keys):
            yield pa.record_batch([pa.array(np.full(len(keys), i)), pa.array([digest]).take(pa.array(np.zeros(len(keys), np.int64))), pa.array(as_long(keys))], names=["id", "digest", "key"])


def _shares(ids: list, texts: list[str], counts: Counts, settings: SpamSettings) -> list[tuple]:
    rows = []
    for i, text, found in zip(ids, texts, judge(texts, counts, settings)):
        by = dict.fromkeys(("links", "salad", "repeated"), 0)
        for kind, size, _ in found:
            if kind:
                by[kind] += size
        whole = max(1, len(text))
        rows.append((i, sum(by.values()) / whole, *(v / whole for v in by.values())))
    return rows


#: Pairs that the driver passes on at a time, 12 bytes each.
PIECE = 250_000
SHARES = "id long, share double, links double, salad double, repeated double"


def _record(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c) for c in zip(*rows)], names=["id", "share", "links", "salad", "repeated"])


def stuffed(df: DataFrame, id_col: str, text_col: str, settings: SpamSettings = SpamSettings()) -> DataFrame:
    """(id, share, links, salad, repeated): the share of each text's characters in stuff, and of each kind of it."""
    docs = spread(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null"))
    texts = docs.where("text is not null and text <> ''")
    pairs = arrow_map(texts.select("text"), _pairs_of, "key long, n long, texts long").groupBy("key").agg(F.sum("n").alias("n"), F.sum("texts").alias("texts"))
    counts = scratch(pairs.where("texts > 1").select("key", "n"), "pairs")
    judged = _by_broadcast(docs, counts, settings) if few_rows(counts, settings.held) else _by_join(docs, counts, settings)
    return judged.groupBy("id").agg(*(F.max(c).alias(c) for c in ("share", "links", "salad", "repeated")))


def _packed(counts: DataFrame, piece: int) -> DataFrame:
    """(keys, n): pairs and their counts as bytes, at most `piece` of them in a row."""

    def bytes_of(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        columns = (t.column("key").to_numpy(), t.column("n").to_numpy().astype(np.float32))
        return pa.record_batch([pa.array([c.tobytes()], pa.binary()) for c in columns], names=["keys", "n"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for whole in it:
            for b in (whole.slice(at, piece) for at in range(0, whole.num_rows, piece)):
                if size + b.num_rows > piece:
                    yield bytes_of(held)
                    held, size = [], 0
                held.append(b)
                size += b.num_rows
        if held:
            yield bytes_of(held)

    return counts.select("key", "n").mapInArrow(run, "keys binary, n binary")


def _by_broadcast(docs: DataFrame, counts: DataFrame, settings: SpamSettings) -> DataFrame:
    context, name = docs.sparkSession.sparkContext, uuid.uuid4().hex
    # at most settings.held pairs, of which the driver reads a piece at a time
    shared = [context.broadcast((bytes(r["keys"]), bytes(r["n"]))) for r in _packed(counts, PIECE).toLocalIterator()]

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if name not in _COUNTS:
            _COUNTS.clear()
            keys, n = (b"".join(c) for c in zip(*(piece.value for piece in shared))) if shared else (b"", b"")
            _COUNTS[name] = Counts(np.frombuffer(keys, U64), np.frombuffer(n, np.float32))
        rows, ids = [], iter(b.column("id").to_pylist())
        for texts in _batches([t or "" for t in b.column("text").to_pylist()]):
            rows += _shares([next(ids) for _ in texts], texts, _COUNTS[name], settings)
        if rows:
            yield _record(rows)

    return arrow_map(docs, run, SHARES)


def _by_join(docs: DataFrame, counts: DataFrame, settings: SpamSettings) -> DataFrame:
    """Each text with the counts of its own pairs, which are at most twice as many as its words."""
    docs = docs.select("id", F.coalesce("text", F.lit("")).alias("text")).withColumn("digest", F.md5("text"))
    met = arrow_map(docs, _asked, "id long, digest string, key long").distinct().join(counts, "key")
    own = met.groupBy("id", "digest").agg(F.collect_list("key").alias("keys"), F.collect_list("n").alias("n"))

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = []
        for i, text, keys, n in zip(*(b.column(c).to_pylist() for c in ("id", "text", "keys", "n"))):
            rows += _shares([i], [text], Counts(np.array(keys or [], np.int64).view(U64), np.array(n or [], np.float32)), settings)
        if rows:
            yield _record(rows)

    return arrow_map(docs.join(own, ["id", "digest"], "left").select("id", "text", "keys", "n"), run, SHARES)
