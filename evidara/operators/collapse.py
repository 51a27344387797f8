"""Near-duplicate results folded under the better one: overlap in words or vectors, decisions, leader clustering.

Pairs are of results of one query, at most MAX_SCAN of them; the greedy part is one bounded group for each query.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidara.functions.columns import collapsed, words
from evidara.operators.frames import frame
from evidara.session import scratch
from evidara.settings import MAX_SCAN

#: Over these, strictly, two results are alike, or one holds the other.
ALIKE, CONTAINED = 0.5, 0.8
#: Fewer words say too little to be called a copy; fewer shingles too little to be compared.
LEAST_WORDS, LEAST_SHINGLES = 7, 5
WORDS = re.compile(r"[^\W_]+")
#: Pairs whose vectors are taken out of a batch at a time, and vectors of one result that are met with the other's at a time.
OVERLAPS, PIECE = 256, 1024


@dataclass(frozen=True)
class Spaces:
    """What results are compared in: vectors where every chunk has one and the model's bars are known, chunk for how much of a result
    another holds and passage for wholes; then words, but for a search that ranks by vectors alone."""

    chunk: float | None = None
    passage: float = 1.0
    mode: str = "hybrid"


def exact_duplicates(rows: DataFrame, key: str, text: str, group: list[str] | None = None) -> DataFrame:
    """(group, key, first): rows whose text is another's but for blanks, of at least LEAST_WORDS words, and the least key of their kind."""
    group = group or []
    own = rows.select(*group, key, F.md5(collapsed(text)).alias("digest"), F.size(words(text)).alias("n")).where(F.col("n") >= LEAST_WORDS)
    kinds = own.groupBy(*group, "digest").agg(F.min(key).alias("first"), F.count_distinct(key).alias("copies")).where("copies > 1")
    return own.join(kinds, [*group, "digest"]).select(*group, key, "first", "copies").distinct()


def shingle_overlaps(items: DataFrame, width: int = 3) -> DataFrame:
    """(query_id, a, b, into, over, alike) of each two results of a query that share a word, a ranked before b.

    items(query_id, item, rank, texts): the shingles of a result are those of each of its chunks, none across two. into is the share of b's that a
    holds, over the share of a's that b holds, alike the share of their words that both have. Results under LEAST_SHINGLES have 0 throughout.
    One bounded group a query: at most MAX_SCAN results, whose sets never leave the task.
    """
    listed = items.where(F.col("rank") <= MAX_SCAN).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "item", F.transform("texts", lambda t: F.struct(t.alias("text"))).alias("chunks")))).alias("own"))

    def run(it):
        for batch in it:
            found = []
            for q, own in zip(batch.query_id, batch["own"]):
                m, names = Measured.by_words(list(own), width), np.array([r["item"] for r in own])
                a, b = np.nonzero(np.triu(m.met > 0, 1))
                found.append(pd.DataFrame({"query_id": q, "a": names[a], "b": names[b], "into": m.into[b, a], "over": m.into[a, b], "alike": m.alike[a, b]}))
            if found:
                yield pd.concat(found)

    return listed.mapInPandas(run, "query_id long, a long, b long, into double, over double, alike double")


def vector_overlaps(pairs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, a, b, into, over, alike) from chunk vectors: the mean over a result's chunks of the best cosine in the other; alike of the mean vectors.

    pairs(query_id, a, b), chunks(query_id, item, seq, vector). Results of some pair are gathered, each in one row, so that chunks meet within a task.
    """
    pairs = scratch(pairs, "pairs")
    ends = pairs.select("query_id", F.explode(F.array("a", "b")).alias("item")).distinct()
    own = chunks.join(ends, ["query_id", "item"], "left_semi").groupBy("query_id", "item").agg(F.collect_list("vector").alias("v"))
    own = scratch(own, "gathered")
    ca, cb = (own.select("query_id", F.col("item").alias(x), F.col("v").alias(f"{x}_v")) for x in "ab")
    types = {f.name: f.dataType.simpleString() for f in pairs.schema}
    met = pairs.join(ca, ["query_id", "a"]).join(cb, ["query_id", "b"]).select("query_id", "a", "b", "a_v", "b_v")
    return met.mapInArrow(_overlaps, f"query_id {types['query_id']}, a {types['a']}, b {types['b']}, into double, over double, alike double")


def _directions(listed: pa.Array) -> list[np.ndarray]:
    """The unit vectors of each row's list of vectors; a zero vector stays zero."""
    inner, size = listed.flatten(), listed.value_lengths().to_numpy()
    flat = inner.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    v = flat.reshape(len(inner), -1)
    n = np.linalg.norm(v, axis=1, keepdims=True)
    v = v / np.where(n == 0, 1, n)
    return np.split(v, np.cumsum(size)[:-1])


def _overlaps(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in it:
        for at in range(0, whole.num_rows, OVERLAPS):
            b = whole.slice(at, OVERLAPS)
            into, over, alike = np.empty((3, b.num_rows))
            for n, (x, y) in enumerate(zip(_directions(b.column("a_v")), _directions(b.column("b_v")))):
                # rows of x in pieces, so that two long results need no whole table of cosines
                best = np.full(len(y), -np.inf)
                total = 0.0
                for i in range(0, len(x), PIECE):
                    cos = x[i : i + PIECE] @ y.T
                    best, total = np.maximum(best, cos.max(0)), total + cos.max(1).sum()
                into[n], over[n] = best.mean(), total / len(x)
                # the cosine of two mean vectors is that of the sums
                s, t = x.sum(0), y.sum(0)
                size = np.linalg.norm(s) * np.linalg.norm(t)
                alike[n] = 0.0 if size == 0 else s @ t / size
            yield pa.record_batch([*(b.column(c) for c in ("query_id", "a", "b")), *(pa.array(c) for c in (into, over, alike))], names=["query_id", "a", "b", "into", "over", "alike"])


def decided(pairs: DataFrame, alike: float = ALIKE, contained: float = CONTAINED) -> DataFrame:
    """pairs with relation (null for none), swap and similarity.

    Touching pairs are one passage cut in two. Equal texts are duplicates. Spans of one document of which one holds the other (nested: -1 where the worse
    is inside, 1 where it holds the better) are contained. If only the better holds the other, that is contained as much as it is held; if only the
    other holds the better, it is contained the other way round and the two swap places; if both, or if they are alike, they are equivalent.
    """
    def flag(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(False)) if name in pairs.columns else F.lit(False)

    into, over = F.col("into"), F.col("over")
    nested = F.coalesce(F.col("nested"), F.lit(0)) if "nested" in pairs.columns else F.lit(0)
    inside, holds = (into > contained) & (over <= contained), (over > contained) & (into <= contained)
    both = ((into > contained) & (over > contained)) | (F.col("alike") > alike)
    kinds = [(flag("touching"), None, False, None), (flag("exact"), "duplicate", False, F.lit(1.0)), (nested < 0, "contained", False, F.lit(1.0)), (nested > 0, "contained", True, F.lit(1.0)),
             (holds, "contained", True, over), (inside, "contained", False, into), (both, "equivalent", False, F.greatest(F.least(into, over), "alike"))]
    relation, swap, similarity = F.lit(None).cast("string"), F.lit(False), F.lit(None).cast("double")
    for when, name, turned, strength in reversed(kinds):
        relation = F.when(when, F.lit(name).cast("string")).otherwise(relation)
        swap = F.when(when, F.lit(turned)).otherwise(swap)
        similarity = F.when(when, strength if strength is not None else F.lit(None).cast("double")).otherwise(similarity)
    return pairs.withColumns({"relation": relation, "swap": swap, "similarity": similarity})


def folded_results(items: DataFrame, limit: int | None = None, spaces: Spaces = Spaces()) -> DataFrame:
    """(query_id, item, slot, lead, root, relation, similarity, score, words, embedding, chars): results best first, each with a slot of its own or under
    another.

    items(query_id, item, rank, score, alone, collection, document_id, seq_start, seq_end, char_start, char_end, chunks): chunks are structs of a text and
    a vector, in order. lead is the result that one was folded under, root the one whose slot it is in; words, embedding and chars say how much of it lead holds.
    A result is folded under the closest kept one that it repeats. One that holds kept ones and repeats none takes the best of
    their slots, score and all, and they go under it with what is under them. What is marked alone leads nothing. Once there are `limit` slots, only folding
    goes on. A query's results are at most MAX_SCAN.
    """
    if spaces.chunk is None:  # vectors are not looked at
        items = items.withColumn("chunks", F.transform("chunks", lambda c: F.struct(c["text"].alias("text"), F.lit(None).cast("array<float>").alias("vector"))))
    fields = ["rank", "item", "score", "alone", "collection", "document_id", "seq_start", "seq_end", "char_start", "char_end", "chunks"]
    listed = items.where(F.col("rank") <= MAX_SCAN).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("own"))

    def run(it):
        for batch in it:
            rows: list[tuple] = []
            for q, own in zip(batch.query_id, batch["own"]):
                rows += [(q, *r) for r in fold(list(own), limit, spaces)]
            yield frame(rows, FOLDED)

    return listed.mapInPandas(run, FOLDED)


FOLDED = "query_id long, item long, slot int, lead long, root long, relation string, similarity double, score double, words double, embedding double, chars double"


class Measured:
    """How much of each result every other one holds: into[i, j] is the part of i that j holds, alike[i, j] how alike they are as wholes."""

    def __init__(self, into: np.ndarray, alike: np.ndarray, contained: float, whole: float, met: np.ndarray | None = None):
        self.into, self.alike, self.contained, self.whole, self.met = into, alike, contained, whole, met

    @classmethod
    def by_words(cls, results: list, width: int = 3) -> Measured:
        known: dict[str, int] = {}
        texts = [[np.array([known.setdefault(w, len(known)) for w in WORDS.findall((c["text"] or "").lower())], np.int64) for c in r["chunks"]] for r in results]
        shingled = []
        for own in texts:
            runs = [np.empty(0, np.int64)]
            for w in own:
                if len(w) >= width:
                    # the places of the words in one table, as the digits of one number
                    runs.append(sum(w[i : len(w) - width + 1 + i] * (len(known) + 1) ** i for i in range(width)))
            shingled.append(np.unique(np.concatenate(runs)))
        common, n = _common(shingled)
        met, size = _common([np.unique(np.concatenate([np.empty(0, np.int64), *own])) for own in texts])
        speaks = n >= LEAST_SHINGLES
        into = np.where(speaks[:, None], common / np.maximum(n, 1)[:, None], 0.0)
        alike = np.where(speaks[:, None] & speaks[None, :], met / np.maximum(size[:, None] + size[None, :] - met, 1), 0.0)
        return cls(into, alike, CONTAINED, ALIKE, met)

    @classmethod
    def by_vectors(cls, results: list, contained: float, whole: float) -> Measured:
        owner = np.repeat(np.arange(len(results)), [len(r["chunks"]) for r in results])
        v = np.array([np.asarray(c["vector"], float) for r in results for c in r["chunks"]])
        v /= np.where((n := np.linalg.norm(v, axis=1, keepdims=True)) > 0, n, 1)
        cosines, first = v @ v.T, np.searchsorted(owner, np.arange(len(results)))
        best = np.maximum.reduceat(cosines, first, axis=1)
        into = np.add.reduceat(best, first, axis=0) / np.bincount(owner)[:, None]
        sums = np.add.reduceat(np.add.reduceat(cosines, first, axis=0), first, axis=1)
        within = np.outer(sums.diagonal(), sums.diagonal())
        return cls(into, np.where(within > 0, sums / np.sqrt(np.where(within > 0, within, 1)), 0.0), contained, whole)

    def decide(self, i: int, kept: int) -> tuple[str, float, bool] | None:
        into, over, alike = self.into[i, kept], self.into[kept, i], self.alike[i, kept]
        inside, holds = into > self.contained, over > self.contained
        if inside != holds:
            return "contained", float(over if holds else into), bool(holds)
        return ("equivalent", float(max(min(into, over), alike)), False) if inside or alike > self.whole else None


def _common(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(members in common of each two sets, sizes); sets are of distinct numbers."""
    n = np.array([len(s) for s in sets])
    _, place, times = np.unique(np.concatenate([np.empty(0, np.int64), *sets]), return_inverse=True, return_counts=True)
    # members of one set only are in common with none
    several = times > 1
    column = np.cumsum(several) - 1
    row, met = np.repeat(np.arange(len(sets)), n), several[place]
    table = np.zeros((len(sets), int(several.sum())), np.float32)
    table[row[met], column[place[met]]] = 1
    common = (table @ table.T).astype(float)
    np.fill_diagonal(common, n)
    return common, n.astype(float)


def _label(result) -> str | None:
    """What equal results are told by; none for texts of a few words, which are labels."""
    text = " ".join(" ".join(c["text"] or "" for c in result["chunks"]).split())
    return text if len(WORDS.findall(text)) >= LEAST_WORDS else None


def related(results: list, deciding: list[Measured]):
    """A function of (i, kept) that says how result i repeats a kept one: (relation, similarity, whether i takes its place), or None."""
    labels = [_label(r) for r in results]

    def decide(i: int, kept: int) -> tuple[str, float, bool] | None:
        a, b = results[i], results[kept]
        if a["document_id"] == b["document_id"]:
            if a["collection"] == b["collection"] and a["seq_start"] <= b["seq_end"] + 1 and b["seq_start"] <= a["seq_end"] + 1:
                return None  # one passage cut in two
        if labels[i] is not None and labels[i] == labels[kept]:
            return "duplicate", 1.0, False
        if a["document_id"] == b["document_id"] and a["collection"] != b["collection"]:
            if b["char_start"] <= a["char_start"] and a["char_end"] <= b["char_end"]:
                return "contained", 1.0, False
            if a["char_start"] <= b["char_start"] and b["char_end"] <= a["char_end"]:
                return "contained", 1.0, True
        return next((d for m in deciding if (d := m.decide(i, kept))), None)

    return decide


def leaders(alone: list[bool], scores: list[float], decide, limit: int | None) -> tuple[list[tuple[int, float]], dict[int, tuple[int, str, float]]]:
    """(slots, under): the leader and score of each slot, and for each folded result what it is under, how, and how strongly."""
    slots: list[tuple[int, float]] = []
    under: dict[int, tuple[int, str, float]] = {}
    for i in range(len(scores)):
        met = [(n, lead, d) for n, (lead, _) in enumerate(slots) if (d := decide(i, lead)) and not alone[i if d[2] else lead]]
        repeats = [(d[1], -n, lead, d) for n, lead, d in met if not d[2]]
        if repeats:
            _, _, lead, d = max(repeats)
            under[i] = (lead, d[0], d[1])
        elif met:
            under.update((lead, (i, d[0], d[1])) for _, lead, d in met)
            slots[met[0][0]] = (i, slots[met[0][0]][1])
            gone = {n for n, _, _ in met[1:]}
            slots = [s for n, s in enumerate(slots) if n not in gone]
        elif limit is None or len(slots) < limit:
            slots.append((i, scores[i]))
    return slots, under


def fold(results: list, limit: int | None, spaces: Spaces) -> list[tuple]:
    """Rows as of FOLDED, but for the query, of one query's results, best first."""
    if not len(results):
        return []
    words, vectors = Measured.by_words(results), None
    if spaces.chunk is not None and all(c["vector"] is not None for r in results for c in r["chunks"]):
        vectors = Measured.by_vectors(results, spaces.chunk, spaces.passage)
    deciding = [m for m in (vectors, words) if m is not None and not (m is words and vectors is not None and spaces.mode == "vector")]
    slots, under = leaders([bool(r["alone"]) for r in results], [r["score"] for r in results], related(results, deciding), limit)
    out = [(results[i]["item"], n, None, None, None, None, float(s), None, None, None) for n, (i, s) in enumerate(slots, 1)]
    for i, (lead, relation, similarity) in under.items():
        root = lead
        while root in under:
            root = under[root][0]
        chars = None
        a, b = results[i], results[lead]
        if a["document_id"] == b["document_id"]:
            shorter = min(r["char_end"] - r["char_start"] for r in (a, b))
            chars = max(0, min(a["char_end"], b["char_end"]) - max(a["char_start"], b["char_start"])) / shorter if shorter > 0 else 0.0
        out.append((a["item"], None, b["item"], results[root]["item"], relation, float(similarity), float(a["score"]), float(words.into[i, lead]), None if vectors is None else float(vectors.into[i, lead]), chars))
    return out


def places(folded: DataFrame) -> DataFrame:
    """(query_id, slot, item, places): how many results each slot's leader stands for, at every depth."""
    n = folded.where("lead is not null").groupBy("query_id", F.col("root").alias("item")).agg(F.count("*").alias("places"))
    return folded.where("slot is not null").select("query_id", "slot", "item").join(n, ["query_id", "item"], "left").select("query_id", "slot", "item", F.coalesce("places", F.lit(0)).alias("places"))
