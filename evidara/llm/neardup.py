"""Near-duplicate records: SetSketch registers, banded, judged by their joint likelihood, then verified.

A record's set of word shingles is sketched by registers of exponentially spaced, truncated minima (SetSketch):
register i holds floor(1 - log_b(h)) of the least exponential variate h that any shingle draws. Sketches merge by
taking the larger register and are locality-sensitive: registers of two sets are equal about as often as
their Jaccard similarity. Bands of registers give candidates, the joint likelihood of the registers' order
(how many are larger, smaller, equal) gives an estimate of the similarity, and candidates within reach of the threshold
are verified with the exact sets.

Nulls, and texts with fewer words than a shingle has, have no shingles and are in no pair; as groups they stand alone.
Records with equal shingle sets are one class: one representative (the least id) is compared, the others follow it. Within it, records
of equal text are copies.
Repeated ids count once for each different text. Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import md5
from math import ceil, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidara.llm.common import U64, arrow_map, as_long, components, hashed_words, mix, shingles
from evidara.session import keep_keys, scratch, spread


@dataclass(frozen=True)
class SketchSettings:
    """width: words of a shingle; threshold: least similarity of a pair; rows: registers of a band;
    miss: the most that a pair just at the threshold may be missed by banding; base: spacing of the registers.
    expand_copies: groups of equal texts up to this size are listed as all their pairs, larger ones as pairs
    with their first record."""

    width: int = 5
    threshold: float = 0.8
    rows: int = 3
    miss: float = 1e-4
    base: float = 1.02
    expand_copies: int = 32

    @property
    def bands(self) -> int:
        return max(1, ceil(log(self.miss) / log1p(-(self.threshold**self.rows))))

    @property
    def registers(self) -> int:
        return self.bands * self.rows


SKETCH = "id long, set_a long, set_b long, n int, registers array<short>"
#: Shingles that are hashed at a time, so that the hashes stay in the processor's cache.
AT_ONCE = 1 << 17


def _draws(m: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20_011)
    return r.integers(1, 1 << 31, m, dtype=np.uint32) * np.uint32(2) + np.uint32(1), r.integers(0, 1 << 32, m, dtype=np.uint32)


def registers_of(minima: np.ndarray, base: float) -> np.ndarray:
    """Registers from least 32-bit uniform draws: floor(1 - log_b of the exponential variate), from 0 up."""
    h = -np.log1p(-(minima.astype(np.float64) + 0.5) / 2.0**32)
    return np.maximum(0, np.floor(1 - np.log(h / 23) / log(base))).astype(np.int16)


def sketches(df: DataFrame, id_col: str, text_col: str, settings: SketchSettings) -> DataFrame:
    """(id, set_a, set_b, n, registers, digest) of each record with a shingle; set_a and set_b identify its set, digest its text."""
    m, width, base = settings.registers, settings.width, settings.base
    mult, add = _draws(m)

    def sketch(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, sets, digests, held = [], [], [], 0
        out = []

        def flush() -> None:
            out.append(_sketched(ids, sets, mult, add, base).append_column("digest", pa.array(digests, pa.binary())))

        for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            s = np.unique(shingles(hashed_words(text), width))
            if not len(s):
                continue
            ids.append(i)
            sets.append(s)
            digests.append(md5(text.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest())
            held += len(s)
            if held >= AT_ONCE:
                flush()
                ids, sets, digests, held = [], [], [], 0
        if ids:
            flush()
        yield from out

    return arrow_map(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null"), sketch, SKETCH + ", digest binary")


def _sketched(ids: list[int], sets: list[np.ndarray], mult: np.ndarray, add: np.ndarray, base: float) -> pa.RecordBatch:
    n = np.fromiter(map(len, sets), dtype=np.int64)
    every = np.concatenate(sets)
    starts = np.concatenate(([0], np.cumsum(n)[:-1]))
    x = (every >> U64(32)).astype(np.uint32)
    buf = np.empty_like(x)
    least = np.empty((len(ids), len(mult)), np.uint32)
    with np.errstate(over="ignore"):
        for i in range(len(mult)):
            np.multiply(x, mult[i], out=buf)
            np.add(buf, add[i], out=buf)
            least[:, i] = np.minimum.reduceat(buf, starts)
        a = np.add.reduceat(every, starts)
        b = np.add.reduceat(mix(every ^ U64(0xA5A5A5A5DEADBEEF)), starts)
    regs = registers_of(least, base)
    flat = pa.ListArray.from_arrays(pa.array(np.arange(0, regs.size + 1, regs.shape[1], dtype=np.int32)), pa.array(regs.ravel()))
    return pa.record_batch([pa.array(ids, pa.int64()), pa.array(as_long(a)), pa.array(as_long(b)), pa.array(n.astype(np.int32)), flat], names=["id", "set_a", "set_b", "n", "registers"])


def joint_estimate(ra: np.ndarray, rb: np.ndarray, na: np.ndarray, nb: np.ndarray, base: float) -> np.ndarray:
    """The similarity under which the registers' order is most likely, on a grid of hundredths."""
    up, down = (ra > rb).sum(1), (ra < rb).sum(1)
    same = ra.shape[1] - up - down
    u = na / (na + nb)
    v = 1 - u
    grid = np.arange(0, 1.005, 0.01)

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (base - 1) / base) / log(base)

    larger, smaller = p(u[:, None] - v[:, None] * grid), p(v[:, None] - u[:, None] * grid)
    possible = grid[None, :] <= np.minimum(u / v, v / u)[:, None] + 0.01
    likelihood = up[:, None] * np.log(larger + 1e-9) + down[:, None] * np.log(smaller + 1e-9) + same[:, None] * np.log(np.maximum(1e-9, 1 - larger - smaller))
    return grid[np.argmax(np.where(possible, likelihood, -np.inf), axis=1)]


def candidates(reps: DataFrame, settings: SketchSettings) -> DataFrame:
    """(a, b), a < b: representatives that share a band of registers."""
    r = settings.rows
    band = F.transform(F.sequence(F.lit(0), F.lit(settings.bands - 1)), lambda i: F.xxhash64(i, F.slice("registers", i * r + 1, r)))
    keyed = reps.select("id", F.explode(band).alias("band"))
    left, right = keyed.select("band", F.col("id").alias("a")), keyed.select("band", F.col("id").alias("b"))
    return left.join(right, "band").where("a < b").select("a", "b").distinct()


def similar_pairs(df: DataFrame, id_col: str, text_col: str, settings: SketchSettings = SketchSettings()) -> tuple[DataFrame, DataFrame]:
    """(pairs, classes): pairs(a, b, similarity) between representatives, and classes(id, rep, size, copy_of, copies).

    No link between different sets is lost but by banding's stated chance. A class is of equal sets; copy_of is the least
    id of an equal text, copies the number of ids that have it.
    """
    df = spread(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")))
    sk = scratch(sketches(df, "id", "text", settings), "sketches")
    heads = sk.groupBy("set_a", "set_b").agg(F.min("id").alias("rep"), F.count_distinct("id").alias("size"))
    texts = sk.groupBy("set_a", "set_b", "digest").agg(F.min("id").alias("copy_of"), F.count_distinct("id").alias("copies"))
    classes = sk.select("id", "set_a", "set_b", "digest").distinct().join(texts, ["set_a", "set_b", "digest"]).join(heads, ["set_a", "set_b"]).select("id", "rep", "size", "copy_of", "copies")
    reps = sk.join(heads.select("set_a", "set_b", F.col("rep").alias("id")), ["set_a", "set_b", "id"], "left_semi")
    near = scratch(_estimated(candidates(reps, settings), sk, settings), "near")
    return _verified(near, df, settings), classes


def _estimated(pairs: DataFrame, sk: DataFrame, settings: SketchSettings) -> DataFrame:
    t, m, base = settings.threshold, settings.registers, settings.base
    floor = t - 5 * (t * (1 - t) / m) ** 0.5
    one = sk.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("registers").alias("ra"))
    two = sk.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("registers").alias("rb"))

    def estimate(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if b.num_rows:
            regs = [np.asarray(b.column(k).flatten()).reshape(b.num_rows, m) for k in ("ra", "rb")]
            e = joint_estimate(*regs, *(b.column(k).to_numpy().astype(float) for k in ("na", "nb")), base)
            yield pa.record_batch([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(e >= floor))

    # sizes alone rule out a pair whose smaller set is under threshold times the larger
    joined = pairs.join(one, "a").join(two, "b").where(F.least("na", "nb") >= t * F.greatest("na", "nb")).select("a", "b", "na", "nb", "ra", "rb")
    return arrow_map(joined, estimate, "a long, b long").distinct()


def _verified(near: DataFrame, df: DataFrame, settings: SketchSettings) -> DataFrame:
    width = settings.width

    def sets(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = [as_long(np.unique(shingles(hashed_words(t), width))) for t in b.column("text").to_pylist()]
        yield pa.record_batch([b.column("id"), pa.array(found, pa.list_(pa.int64()))], names=["id", "s"])

    involved = near.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    held = scratch(arrow_map(keep_keys(df.where("text is not null"), involved, "id"), sets, "id long, s array<long>"), "sets")
    one, two = held.select(F.col("id").alias("a"), F.col("s").alias("sa")), held.select(F.col("id").alias("b"), F.col("s").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    j = near.join(one, "a").join(two, "b").select("a", "b", common.alias("c"), (F.size("sa") + F.size("sb")).alias("t"))
    j = j.select("a", "b", (F.col("c") / (F.col("t") - F.col("c"))).alias("similarity")).where(F.col("similarity") >= settings.threshold)
    return j.groupBy("a", "b").agg(F.max("similarity").alias("similarity"))


def near_duplicate_pairs(df: DataFrame, id_col: str, text_col: str, settings: SketchSettings = SketchSettings()) -> DataFrame:
    """(id_a, id_b, similarity), id_a < id_b: all similar records.

    Equal texts of more than settings.expand_copies records stand in pairs with other texts by the least id only,
    and each other record of theirs is paired with it. Different texts are listed in full, equal sets or not.
    """
    pairs, classes = similar_pairs(df, id_col, text_col, settings)
    pairs, classes = scratch(pairs, "pairs"), scratch(classes, "classes")
    alone = F.col("id") == F.col("copy_of")
    shown = classes.where((F.col("copies") <= settings.expand_copies) | alone).select("rep", "id", "size").distinct()
    a, b = shown.select(F.col("rep").alias("a"), F.col("id").alias("x")), shown.select(F.col("rep").alias("b"), F.col("id").alias("y"))
    across = pairs.join(a, "a").join(b, "b").select("x", "y", "similarity")
    several = shown.where("size > 1")
    within = several.select("rep", F.col("id").alias("x")).join(several.select("rep", F.col("id").alias("y")), "rep").where("x < y")
    large = classes.where((F.col("copies") > settings.expand_copies) & ~alone).select(F.col("copy_of").alias("x"), F.col("id").alias("y"))
    copies = within.select("x", "y").unionByName(large).withColumn("similarity", F.lit(1.0))
    every = across.unionByName(copies).where("x <> y")
    return every.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "similarity").groupBy("id_a", "id_b").agg(F.max("similarity").alias("similarity"))


def near_duplicate_groups(df: DataFrame, id_col: str, text_col: str, settings: SketchSettings = SketchSettings()) -> DataFrame:
    """(id, group_id, links, class_id): every record with its group, the least id linked with it, its number of similar records, and
    the least id of an equal text, with which pairs of copies that are not listed can be restored.

    Records without shingles, null or short, are groups and classes of their own with no links.
    """
    pairs, classes = similar_pairs(df, id_col, text_col, settings)
    pairs, classes = scratch(pairs, "pairs"), scratch(classes, "classes")
    group = components(pairs.select("a", "b"))
    size = classes.groupBy("rep").agg(F.max("size").alias("size"))
    ends = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = ends.join(size, F.col("b") == F.col("rep")).groupBy("a").agg(F.sum("size").alias("others"))
    known = (
        classes.join(group.withColumnRenamed("node", "rep"), "rep", "left")
        .join(links.withColumnRenamed("a", "rep"), "rep", "left")
        .select("id", F.coalesce("group", "rep").alias("group_id"), (F.coalesce("others", F.lit(0)) + F.col("size") - 1).alias("links"), "copy_of")
        .groupBy("id")
        .agg(F.min("group_id").alias("group_id"), F.max("links").alias("links"), F.min("copy_of").alias("class_id"))
    )
    ids = df.select(F.col(id_col).cast("long").alias("id")).where("id is not null").distinct()
    return ids.join(known, "id", "left").select("id", F.coalesce("group_id", "id").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("class_id", "id").alias("class_id"))
