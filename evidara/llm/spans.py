"""Long exact spans that records share, character by character.

Banding of paragraph MinHashes finds paragraphs that resemble each other, not runs that start and end anywhere, so
it can't give the required result. Instead each text is winnowed: of every run of `least` characters the gram with the least
hash is its anchor, the same wherever the run stands. Runs that two records share thus share an anchor. Around anchors
that several records hold, the context is compared exactly: the characters to the left and right that complete runs of `least`.
Anchors of many occurrences are compared window by window instead, with an aggregation, so that no group is gathered.

`paragraph_clusters` is the banding of paragraphs, for what it can tell: which paragraphs are near copies of each other and
which of them to remove.

Nulls and texts under `least` characters share nothing. Records of one and the same text (one class) share it all; one of
them, that of the least id, stands for the class in comparisons. A repeated id counts as one record;
other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidara.llm import neardup
from evidara.llm.common import U64, arrow_map, as_long, code_points, components, groups, mix, rolling
from evidara.session import few_rows, keep_keys, scratch, spread

#: Characters of a gram.
GRAM = 48
#: Characters that are hashed at a time.
AT_ONCE = 1 << 16
#: An anchor of more occurrences is compared by aggregation instead of in one group.
HOT = 5_000
#: Up to so many different contexts of an anchor are compared in pairs, more by the hashes of their windows.
PAIRED = 8


def _sliding(x: np.ndarray, width: int, op: np.ufunc) -> np.ndarray:
    have = 1
    while have * 2 <= width:
        x = op(x[:-have], x[have:])
        have *= 2
    return x if have == width else op(x[: len(x) - (width - have)], x[width - have :])


def anchors_of(points: np.ndarray, owner: np.ndarray, least: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the grams with the least hash in some run of `least` points of one owner."""
    window = least - gram + 1
    if len(points) < least:
        return np.empty(0, np.int64), np.empty(0, U64)
    h = rolling(points, gram)
    low = _sliding(h, window, np.minimum)
    low[owner[: len(low)] != owner[least - 1 :]] = 0  # runs across two texts
    pad = np.zeros(window - 1, U64)
    best = _sliding(np.concatenate([pad, low, pad]), window, np.maximum)
    at = np.flatnonzero(best == h)
    return at, h[at]


def anchors(df: DataFrame, least: int, gram: int) -> DataFrame:
    """(id, gram, at) of each text's anchors."""

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if len(t) < least:
                continue
            held.append((i, code_points(t)))
            size += len(t)
            if size >= AT_ONCE:
                yield _anchored(held, least, gram)
                held, size = [], 0
        if held:
            yield _anchored(held, least, gram)

    return arrow_map(df.select("id", "text"), run, "id long, gram long, at int")


def _anchored(held: list[tuple[int, np.ndarray]], least: int, gram: int) -> pa.RecordBatch:
    n = np.fromiter((len(p) for _, p in held), np.int64)
    owner = np.repeat(np.arange(len(held)), n)
    starts = np.concatenate(([0], np.cumsum(n)[:-1]))
    at, h = anchors_of(np.concatenate([p for _, p in held]), owner, least, gram)
    ids = np.fromiter((i for i, _ in held), np.int64)
    return pa.record_batch([pa.array(ids[owner[at]]), pa.array(as_long(h)), pa.array((at - starts[owner[at]]).astype(np.int32))], names=["id", "gram", "at"])


def contexts(df: DataFrame, places: DataFrame, least: int, gram: int) -> DataFrame:
    """(gram, hot, id, at, left, right): what stands around each anchor, as far as runs of `least` reach."""
    reach = least - gram

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows: list[list] = [[], [], [], [], [], []]
        size = 0
        for i, text, places_of in zip(*(b.column(k).to_pylist() for k in ("id", "text", "places"))):
            for p in places_of:
                at = p["at"]
                for column, v in zip(rows, (p["gram"], p["hot"], i, at, text[max(0, at - reach) : at], text[at + gram : at + least])):
                    column.append(v)
            size += len(places_of)
            if size > 20_000:
                yield pa.record_batch([pa.array(c) for c in rows], schema=CONTEXT)
                rows, size = [[], [], [], [], [], []], 0
        if rows[0]:
            yield pa.record_batch([pa.array(c) for c in rows], schema=CONTEXT)

    by_text = places.groupBy("id").agg(F.collect_list(F.struct("gram", "at", "hot")).alias("places"))
    return arrow_map(keep_keys(df, by_text.select("id"), "id").join(by_text, "id").select("id", "text", "places"), run, "gram long, hot boolean, id long, at int, left string, right string")


CONTEXT = pa.schema([("gram", pa.int64()), ("hot", pa.bool_()), ("id", pa.int64()), ("at", pa.int32()), ("left", pa.string()), ("right", pa.string())])
SPAN = pa.schema([("id", pa.int64()), ("s", pa.int32()), ("e", pa.int32())])


def _common(a: str, b: str) -> int:
    """Characters that a and b start with alike."""
    top = min(len(a), len(b))
    if a[:top] == b[:top]:
        return top
    low = 0
    while top - low > 1:
        mid = (low + top) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            top = mid
    return low


def compare(ids: list[int], ats: list[int], lefts: list[str], rights: list[str], least: int, gram: int) -> list[tuple[int, int, int]]:
    """Spans (id, start, end) around one anchor of which each run of `least` characters another record holds as well."""
    if min(ids) == max(ids):
        return []
    kinds: dict[tuple[str, str], list[int]] = {}
    for k, c in enumerate(zip(lefts, rights)):
        kinds.setdefault(c, []).append(k)
    spans = []
    owners = {c: {ids[k] for k in ks} for c, ks in kinds.items()}
    several = {c for c, own in owners.items() if len(own) > 1}
    if len(kinds) <= PAIRED:
        listed = [(c, c[0][::-1]) for c in kinds]
        for c, back in listed:
            if c in several:
                found = {(len(c[0]), len(c[1]))}
            else:
                found = {(_common(back, b), _common(c[1], d[1])) for d, b in listed if d is not c and owners[d] != owners[c]}
            for left, right in found:
                if left + gram + right >= least:
                    spans += [(ids[k], ats[k] - left, ats[k] + gram + right) for k in kinds[c]]
        return spans
    # by the hashes of all windows: (offset from the anchor, hash) held by two records
    keys, lows, highs, place, which = [], [], [], [], []
    for n, ((left, right), ks) in enumerate(kinds.items()):
        # the anchor's own characters are the same for all, so that any filling serves
        h = rolling(np.concatenate([code_points(left), np.zeros(gram, np.uint32), code_points(right)]), least)
        o = np.arange(len(h)) - len(left)
        with np.errstate(over="ignore"):
            keys.append(h + mix(o.astype(np.int64).view(U64)))
        lows.append(np.full(len(h), min(owners[(left, right)])))
        highs.append(np.full(len(h), max(owners[(left, right)])))
        place.append(o)
        which.append(np.full(len(h), n))
    key, low, high, o, n = map(np.concatenate, (keys, lows, highs, place, which))
    if not len(key):
        return []
    order = np.argsort(key, kind="stable")
    k = key[order]
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    size = np.diff(np.append(first, len(k)))
    shared = np.repeat(np.minimum.reduceat(low[order], first) < np.maximum.reduceat(high[order], first), size)
    ok = np.empty(len(k), bool)
    ok[order] = shared
    every = list(kinds.items())
    for j, (c, ks) in enumerate(every):
        mine = np.sort(o[(n == j) & (ok | (c in several))])
        if not len(mine):
            continue
        cut = np.flatnonzero(np.diff(mine) > 1)
        for a, z in zip(mine[np.concatenate(([0], cut + 1))], mine[np.append(cut, len(mine) - 1)]):
            spans += [(ids[x], ats[x] + int(a), ats[x] + int(z) + least) for x in ks]
    return spans


def _grouped(cold: DataFrame, least: int, gram: int) -> DataFrame:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(it, "gram"):
            g = t.column("gram").to_numpy()
            cuts = np.concatenate(([0], np.flatnonzero(g[1:] != g[:-1]) + 1, [len(g)]))
            columns = [t.column(k).to_pylist() for k in ("id", "at", "left", "right")]
            spans = [s for a, z in zip(cuts[:-1], cuts[1:]) if z - a > 1 for s in compare(*(c[a:z] for c in columns), least, gram)]
            if spans:
                yield pa.record_batch([pa.array(c) for c in zip(*spans)], schema=SPAN)

    rows = cold.select("gram", "id", "at", "left", "right").repartition("gram").sortWithinPartitions("gram")
    return rows.mapInArrow(run, "id long, s int, e int")


def _by_window(hot: DataFrame, least: int, gram: int) -> DataFrame:
    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for g, i, at, left, right in zip(*(b.column(k).to_pylist() for k in ("gram", "id", "at", "left", "right"))):
            h = rolling(np.concatenate([code_points(left), np.zeros(gram, np.uint32), code_points(right)]), least)
            if len(h):
                o = np.arange(len(h)) - len(left)
                with np.errstate(over="ignore"):
                    key = h + mix(o.astype(np.int64).view(U64)) + U64(g & (2**64 - 1))
                yield pa.record_batch([pa.array(as_long(key)), pa.array(np.full(len(h), i)), pa.array((at + o).astype(np.int32))], names=["key", "id", "s"])

    windows = arrow_map(hot, run, "key long, id long, s int")
    held = windows.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("key")
    return windows.join(held, "key", "left_semi").select("id", "s", (F.col("s") + least).alias("e"))


def merged(spans: DataFrame) -> DataFrame:
    """(id, s, e): spans of an id that overlap or touch are one."""
    before = Window.partitionBy("id").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy("id").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, 0)
    new = F.coalesce(F.col("s") > F.max("e").over(before), F.lit(True)).cast("int")
    isles = spans.distinct().withColumn("new", new).withColumn("isle", F.sum("new").over(so_far))
    return isles.groupBy("id", "isle").agg(F.min("s").alias("s"), F.max("e").alias("e")).select("id", "s", "e")


def shared_spans(df: DataFrame, id_col: str, text_col: str, least: int = 300, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(id, span_start, span_end, share): maximal stretches of which each character lies in a run of at least
    `least` characters that another record holds too, and how much of the text all its stretches make up."""
    gram = min(gram, max(1, least - 1))
    docs = spread(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where(F.length(text_col) >= least).where("id is not null"))
    texts = docs.select("id", F.md5("text").alias("digest"), F.length("text").alias("n"))
    same = texts.groupBy("digest").agg(F.min("id").alias("rep"), F.max("id").alias("last"), F.max("n").alias("n")).where("rep < last")
    copies = scratch(texts.join(same.select("digest", "rep"), "digest").select("id", "rep", "n").distinct(), "copies")
    others = copies.where("id <> rep").select("id")
    kept = docs.join(F.broadcast(others) if few_rows(others, 1_000_000) else others, "id", "left_anti")
    found = scratch(anchors(kept, least, gram), "anchors")
    held = found.groupBy("gram").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("times")).where("lo < hi")
    places = scratch(found.join(held.select("gram", (F.col("times") > hot).alias("hot")), "gram"), "places")
    around = contexts(kept, places, least, gram)
    spans = _grouped(around.where("not hot"), least, gram)
    if places.where("hot").limit(1).count():
        spans = spans.unionByName(_by_window(around.where("hot"), least, gram))
    whole = copies.select("id", F.lit(0).alias("s"), F.col("n").alias("e"))
    spans = merged(spans.unionByName(whole))
    n = texts.groupBy("id").agg(F.max("n").alias("n"))
    total = spans.groupBy("id").agg(F.sum(F.col("e") - F.col("s")).alias("held")).join(n, "id").select("id", (F.col("held") / F.col("n")).alias("share"))
    return spans.join(total, "id").select("id", F.col("s").alias("span_start"), F.col("e").alias("span_end"), "share")


GAP = re.compile(r"\r?\n[ \t\r]*\n\s*")


def paragraphs(df: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """(id, start, end, text): the paragraphs, parted by blank lines, of at least `least` characters."""

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for i, text in zip(b.column("id").to_pylist(), b.column("text").to_pylist()):
            last = 0
            for a, z in [m.span() for m in GAP.finditer(text)] + [(len(text), len(text))]:
                if a - last >= least:
                    rows.append((i, last, a, text[last:a]))
                last = z
            if len(rows) > 20_000:
                yield pa.record_batch([pa.array(c) for c in zip(*rows)], schema=PARAGRAPH)
                rows = []
        if rows:
            yield pa.record_batch([pa.array(c) for c in zip(*rows)], schema=PARAGRAPH)

    own = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    return arrow_map(spread(own), run, "id long, start int, end int, text string")


PARAGRAPH = pa.schema([("id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("text", pa.string())])


def paragraph_clusters(df: DataFrame, id_col: str, text_col: str, least: int = 100, settings: neardup.SketchSettings = neardup.SketchSettings()) -> DataFrame:
    """(id, start, end, cluster, removed) of each paragraph of at least `least` characters that has a near copy, in another place or record.

    Minima of word shingles are banded for a recall of 1 - settings.miss at the threshold, colliding paragraphs verified by their exact Jaccard
    similarity, and components of what remains are clusters. The first place of each cluster, by the hash of its place, is kept.
    """
    own = scratch(paragraphs(df, id_col, text_col, least).distinct().withColumn("place", F.xxhash64("id", "start")), "paragraphs")
    pairs, classes = neardup.similar_pairs(own, "place", "text", settings)
    classes = scratch(classes.select("id", "rep", "size").distinct(), "classes")
    group = components(pairs.select("a", "b")).withColumnRenamed("node", "rep")
    known = classes.join(group, "rep", "left").where("size > 1 or group is not null").select(F.col("id").alias("place"), F.coalesce("group", "rep").alias("cluster"))
    known = known.groupBy("place").agg(F.min("cluster").alias("cluster"))
    return own.join(known, "place").select("id", "start", "end", "cluster", (F.col("place") != F.col("cluster")).alias("removed"))
