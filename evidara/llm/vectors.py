"""Most similar vectors: multi-index hashing of learned, rotated binary codes, reranked by the floats themselves.

Codes are learned by iterative quantisation: on a bounded sample, principal directions and a rotation that brings
the projected vectors closest to their signs. Several rotations, each from another start, give as many bits as are asked for. A code is
cut into substrings, each an index of its own: codes that differ in fewer bits than there are substrings agree in
one of them (pigeonhole). Retrieved pairs are kept within a Hamming radius, then judged by the floats. How many substrings are
needed is measured on the sample; where it takes too many, as with vectors that all lie close to their mean, all pairs are compared.

`close_pairs` joins all vectors with all under substrings that agree; `search` takes stated queries, in blocks, and probes an index of all
vectors by substrings within a Hamming radius.
Null vectors, all-zero vectors and vectors of another length or with values that are no finite numbers are left out. Of rows with one id, the
greatest vector counts. Similarity is cosine; ties are broken by the smaller id. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from math import acos, ceil, log, log1p, pi

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidara.llm.common import U64, arrow_map, as_long
from evidara.session import scratch, spread


@dataclass(frozen=True)
class HashSettings:
    """sample: rows that the rotations are learned from, at most; miss: chance at most that a pair just at the
    threshold is not retrieved, as measured on pairs made from the sample; load: vectors that a bucket should hold on average; seed: of the starts."""

    sample: int = 4096
    miss: float = 5e-4
    load: int = 8
    rounds: int = 20
    seed: int = 7


def learn(sample: np.ndarray, rotations: int, settings: HashSettings) -> tuple[np.ndarray, np.ndarray]:
    """(mean, directions): the signs of (v - mean) @ directions are the bits of v's code, 64 for each rotation.

    The sample's vectors have unit length. Fewer than 64 dimensions are padded by random directions.
    """
    r = np.random.default_rng(settings.seed)
    d = sample.shape[1]
    mean = sample.mean(0)
    x = sample - mean
    _, _, basis = np.linalg.svd(x, full_matrices=False)
    basis = basis[: min(64, d, len(basis))].T
    found = []
    for _ in range(rotations):
        z = x @ basis
        k = z.shape[1]
        turn = np.linalg.qr(r.standard_normal((k, k)))[0]
        for _ in range(settings.rounds):
            u, _, v = np.linalg.svd(np.where(z @ turn >= 0, 1.0, -1.0).T @ z)
            turn = (u @ v).T
        w = basis @ turn
        if k < 64:
            w = np.concatenate([w, basis @ r.standard_normal((k, 64 - k))], axis=1)
        found.append(w)
    return mean, np.concatenate(found, axis=1)


def codes(v: np.ndarray, mean: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Codes of the unit vectors v, a row of 64-bit words each."""
    bits = (v - mean) @ directions >= 0
    return np.packbits(bits, axis=1, bitorder="little").view(U64)


def usable(df: DataFrame, id_col: str, vector_col: str, dims: int | None = None) -> DataFrame:
    """(id, v): one usable vector of each id, as it is."""
    v = F.col("v")
    rows = spread(df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<float>").alias("v")))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(F.col("id").isNotNull() & v.isNotNull() & fine)
    if dims is not None:
        rows = rows.where(F.size("v") == dims)
    return rows.groupBy("id").agg(F.max("v").alias("v"))


def unit(column: pa.Array) -> np.ndarray:
    v = np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _dims(rows: DataFrame) -> int | None:
    """The length that most vectors have."""
    most = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return most and most.d


def _sample(rows: DataFrame, settings: HashSettings) -> np.ndarray:
    """At most settings.sample rows, those of the least hashes, so that the choice hangs on nothing else."""
    few = rows.select("v", F.xxhash64("id").alias("h")).orderBy("h").limit(settings.sample).select("v").toArrow()
    return unit(few.column("v").combine_chunks())


#: Rotations that flips are measured on, and the part of the sample's rows, those with the most flips, that miss holds for.
MEASURED, WORST = 8, 0.01
#: Beyond so many substrings, and one for each 400 rows, comparing all pairs is the lesser work.
MANY = 256


def _partners(v: np.ndarray, least: float, r: np.random.Generator) -> Iterator[np.ndarray]:
    """Vectors of cosine `least` to v's rows: towards other rows, as pairs of one data set lie, and in any direction."""
    for towards in (1.0, 0.0) * 4:
        w = towards * v[r.integers(0, len(v), len(v))] + (1e-3 if towards else 1.0) * r.standard_normal(v.shape)
        w -= np.einsum("ij,ij->i", w, v)[:, None] * v
        yield least * v + (1 - least**2) ** 0.5 * w / np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-300)


def plan(n: int, least: float, sample: np.ndarray, settings: HashSettings) -> tuple[int, int, int]:
    """(bits of a substring, substrings, radius): buckets of about settings.load of n vectors; as many substrings as a pair of cosine
    `least` needs, and the radius in bits of 128 that such a pair stays within.

    For directions free of the data bits differ with chance angle / pi, which is the least that is planned for. Codes are cut about the
    mean, which widens angles, so the bits that differ are counted on pairs made at the threshold; the chance to miss
    one holds for the rows whose pairs fare worst as well.
    """
    bits = int(np.clip(ceil(np.log2(max(2, n) / settings.load)), 6, 30))
    flip = acos(min(1.0, least)) / pi
    parts = max(1, ceil(log(settings.miss) / log1p(-min((1 - flip) ** bits, 1 - 1e-12))))
    mean, directions = learn(sample, MEASURED, settings)
    own, r = codes(sample, mean, directions), np.random.default_rng(settings.seed)
    apart = np.array([np.bitwise_count(own ^ codes(v, mean, directions)) for v in _partners(sample, min(1.0, least), r)])
    met = (1 - apart.sum(2) / (64 * MEASURED)) ** bits
    worst = met[:, np.argsort(met.mean(0))[: max(1, int(len(sample) * WORST))]]
    while parts < n and ((1 - worst) ** parts).mean() > settings.miss:
        parts = ceil(parts * 1.05)
    judged = apart[:, :, :2].sum(2)
    wide = max(128 * flip + 5 * (128 * flip * (1 - flip)) ** 0.5, judged.mean() + 5 * judged.std(), judged.max())
    return bits, parts, int(wide)


def close_pairs(df: DataFrame, id_col: str, vector_col: str, least: float = 0.95, k: int = 10, settings: HashSettings = HashSettings()) -> DataFrame:
    """(id_a, id_b, cosine), id_a < id_b: pairs of cosine at least `least`, each among the other's k most similar.

    Of vectors that are equal, bit for bit, only the k + 1 of the least ids can be among the k most similar of any other
    row, as ties go to the smaller id; the rest take no part. That keeps groups of copies, however large, short.
    """
    rows = usable(df, id_col, vector_col)
    dims = _dims(rows)
    if dims is None:
        return df.select(F.col(id_col).alias("id_a"), F.col(id_col).alias("id_b"), F.lit(0.0).alias("cosine")).where("false")
    first = Window.partitionBy("v").orderBy("id")
    rows = rows.where(F.size("v") == dims).withColumn("copy", F.row_number().over(first)).where(F.col("copy") <= k + 1).drop("copy")
    # ids become hashes until the end; equal hashes of different ids only cost a comparison
    rows = scratch(rows.withColumn("h", F.xxhash64("id")), "vectors")
    kind = rows.schema["id"].dataType.simpleString()
    n, sample = rows.count(), _sample(rows, settings)
    bits, parts, radius = plan(n, least, sample, settings) if n > 1 else (6, 1, 128)
    if parts > max(MANY, n // 400):
        return _mutual(_all_ends(rows, least, k, kind), k)
    # the first two words only judge
    mean, directions = learn(sample, ceil(bits * parts / 64) + 2, settings)

    def entries(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n = b.num_rows
        if not n:
            return
        c = codes(unit(b.column("v")), mean, directions)
        flat = np.unpackbits(np.ascontiguousarray(c[:, 2:]).view(np.uint8), axis=1, bitorder="little")[:, : bits * parts].reshape(n, parts, bits)
        keys = flat @ (1 << np.arange(bits, dtype=np.int64)) + (np.arange(parts, dtype=np.int64) << 32)
        yield pa.record_batch(
            [pa.array(keys.ravel()), pa.array(np.repeat(b.column("h").to_numpy(), parts)), *(pa.array(np.repeat(as_long(np.ascontiguousarray(c[:, j])), parts)) for j in (0, 1))],
            names=["key", "h", "code0", "code1"],
        )

    entry = arrow_map(rows.select("h", "v"), entries, "key long, h long, code0 long, code1 long")
    one, two = (entry.select("key", F.col("h").alias(f"h{x}"), F.col("code0").alias(f"{x}0"), F.col("code1").alias(f"{x}1")) for x in "ab")
    apart = F.bit_count(F.col("a0").bitwiseXOR(F.col("b0"))) + F.bit_count(F.col("a1").bitwiseXOR(F.col("b1")))
    met = one.join(two, "key").where(F.col("ha") < F.col("hb")).where(apart <= radius).select("ha", "hb").distinct()
    a, b = (rows.select(F.col("h").alias(f"h{x}"), F.col("id").alias(f"id_{x}"), F.col("v").alias(f"v{x}")) for x in "ab")
    both = met.join(a, "ha").join(b, "hb").select("id_a", "id_b", "va", "vb")

    def cosines(x: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if x.num_rows:
            cos = np.einsum("ij,ij->i", unit(x.column("va")), unit(x.column("vb")))
            yield pa.record_batch([x.column("id_a"), x.column("id_b"), pa.array(cos)], names=["id_a", "id_b", "cosine"]).filter(pa.array(cos >= least))

    near = arrow_map(both, cosines, f"id_a {kind}, id_b {kind}, cosine double")
    ends = near.unionByName(near.select(F.col("id_b").alias("id_a"), F.col("id_a").alias("id_b"), "cosine"))
    return _mutual(ends, k)


def _mutual(ends: DataFrame, k: int) -> DataFrame:
    """Pairs of which each is among the other's k most similar, from pairs listed in both directions."""
    best = ends.withColumn("rank", F.row_number().over(Window.partitionBy("id_a").orderBy(F.desc("cosine"), "id_b"))).where(F.col("rank") <= k)
    pairs = best.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"), "cosine")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("sides"), F.max("cosine").alias("cosine")).where("sides = 2").select(F.col("a").alias("id_a"), F.col("b").alias("id_b"), "cosine")


def _all_ends(rows: DataFrame, least: float, k: int, kind: str, block: int = 1024) -> DataFrame:
    """(id_a, id_b, cosine): pairs of cosine at least `least` in both directions, each task's best k of each id_a: all rows are compared with all, a
    block at a time."""

    def ends_of(ids: list, vectors: np.ndarray) -> DataFrame:
        shared = rows.sparkSession.sparkContext.broadcast((ids, vectors))

        def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            if not b.num_rows:
                return
            asked, q = shared.value
            v, place = unit(b.column("v")), {x: i for i, x in enumerate(b.column("id").to_pylist())}
            cos = q @ v.T
            for i, x in enumerate(asked):
                if x in place:
                    cos[i, place[x]] = -2
            # ties at the cut are kept, so that the last word on them is the window's
            edge = np.partition(cos, -min(k, b.num_rows), axis=1)[:, -min(k, b.num_rows)]
            at_q, at_v = np.nonzero(cos >= np.maximum(edge, least)[:, None] - 1e-12)
            near = np.einsum("ij,ij->i", q[at_q], v[at_v])
            found = pa.record_batch([pa.array(asked, b.column("id").type).take(pa.array(at_q)), b.column("id").take(pa.array(at_v)), pa.array(near)], names=["id_a", "id_b", "cosine"])
            yield found.filter(pa.array((near >= least) & (cos[at_q, at_v] > -2)))

        return arrow_map(rows.select("id", "v"), run, f"id_a {kind}, id_b {kind}, cosine double")

    return reduce(DataFrame.unionByName, (ends_of(*x) for x in _query_blocks(rows.select("id", "v"), block)))


#: Substrings of an indexed code, of 16 bits each; words of 64 bits that a row's whole code has.
PARTS, WORDS = 4, 4
#: Rows of the index that are met with a block of queries at a time.
MET = 2048


def index(rows: DataFrame, mean: np.ndarray, directions: np.ndarray) -> DataFrame:
    """(part, key, h, code0 ...): rows(h, v) under each substring of their code's first word, a bucket's rows side by side.

    The other words of the code only measure how far apart codes are.
    """

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not b.num_rows:
            return
        c = codes(unit(b.column("v")), mean, directions)
        for j in range(PARTS):
            key = (c[:, 0] >> U64(16 * j) & U64(0xFFFF)).astype(np.int32)
            yield pa.record_batch([pa.array(np.full(len(c), j, np.int32)), pa.array(key), b.column("h"), *(pa.array(as_long(np.ascontiguousarray(c[:, w]))) for w in range(WORDS))], names=["part", "key", "h", *(f"code{w}" for w in range(WORDS))])

    entries = arrow_map(rows.select("h", "v"), run, "part int, key int, h long, " + ", ".join(f"code{w} long" for w in range(WORDS)))
    return entries.repartition("part", "key").sortWithinPartitions("part", "key")


def search(df: DataFrame, id_col: str, vector_col: str, queries: DataFrame, k: int = 10, nprobes: int = 24, refine_factor: int = 20, block: int = 2048, settings: HashSettings = HashSettings()) -> DataFrame:
    """(query_id, id, cosine, rank): the k vectors most similar to each query, itself left out.

    nprobes is a radius in bits of 64. A code within it differs from the query's by at most a quarter of it in one of four substrings
    (pigeonhole), so all buckets within that distance are probed, and of the codes met there, those within the radius are kept. The refine_factor * k nearest of
    these by their whole codes, over all rows, are reranked by their floats. A query that finds fewer is asked again with twice the radius, in
    the end with all. Queries, (id, vector) under the same names, are read a block at a time, each block small enough to be held by every task.

    Of equal vectors only the k + 1 of the least ids are indexed, as ties go to the smaller id.
    """
    rows = usable(df, id_col, vector_col)
    dims = _dims(rows)
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"query_id {kind}, id {kind}, cosine double"
    if dims is None:
        return df.sparkSession.createDataFrame([], schema + ", rank int")
    first = Window.partitionBy("v").orderBy("id")
    rows = rows.where(F.size("v") == dims).withColumn("copy", F.row_number().over(first)).where(F.col("copy") <= k + 1).drop("copy")
    rows = scratch(rows.withColumn("h", F.xxhash64("id")), "vectors")
    mean, directions = learn(_sample(rows, settings), WORDS, settings)
    entries, size, most = scratch(index(rows, mean, directions), "index"), rows.count(), refine_factor * k + 1
    result = None
    for ids, vectors in _query_blocks(usable(queries, id_col, vector_col, dims), block):
        near = _nearest_codes(entries, codes(vectors, mean, directions), nprobes, most, size)
        shared = df.sparkSession.sparkContext.broadcast((ids, vectors))
        found = near.join(rows, "h").select("query", "id", "v").mapInArrow(_reranked(shared, kind), schema)
        result = found if result is None else result.unionByName(found)
    if result is None:
        return df.sparkSession.createDataFrame([], schema + ", rank int")
    order = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "id")
    return result.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _nearest_codes(entries: DataFrame, asked: np.ndarray, radius: int, most: int, size: int) -> DataFrame:
    """(query, h): the `most` entries nearest to each asked code, from the buckets within a radius that is doubled where they are too few."""
    spark, left, result = entries.sparkSession, np.arange(len(asked)), None
    order = Window.partitionBy("query").orderBy("apart", "h")
    while len(left):
        shared = spark.sparkContext.broadcast((left, asked[left]))
        found = entries.mapInArrow(_prober(shared, radius, most), "query int, h long, apart int")
        found = scratch(found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most), "met")
        # one row for each query of a block
        n = {r.query: r["count"] for r in found.groupBy("query").count().collect()}
        short = np.array([q for q in left if n.get(q, 0) < min(most, size)], int) if radius < 64 else left[:0]
        done = found.where(~F.col("query").isin([int(q) for q in short])) if len(short) else found
        result = done if result is None else result.unionByName(done)
        left, radius = short, min(64, 2 * radius)
    return result.select("query", "h")


def _prober(shared, radius: int, most: int):
    reach = radius // PARTS

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, asked = shared.value
        subs = [(asked[:, 0] >> U64(16 * j) & U64(0xFFFF)).astype(np.uint16) for j in range(PARTS)]
        best = _Best(len(names), most)
        for b in it:
            part, keys, h = (b.column(c).to_numpy() for c in ("part", "key", "h"))
            own = np.stack([b.column(f"code{w}").to_numpy().view(U64) for w in range(WORDS)], axis=1)
            for j in np.unique(part):
                lines = np.flatnonzero(part == j)
                for at in (lines[i : i + MET] for i in range(0, len(lines), MET)):
                    bucket, which, n = np.unique(keys[at].astype(np.uint16), return_inverse=True, return_counts=True)
                    probed, q = np.nonzero(np.bitwise_count(bucket[:, None] ^ subs[j][None, :]) <= reach)
                    # the rows of each probed bucket
                    by_bucket, start = np.argsort(which, kind="stable"), np.concatenate(([0], np.cumsum(n)[:-1]))
                    times = n[probed]
                    if not times.sum():
                        continue
                    place = np.repeat(start[probed] - np.concatenate(([0], np.cumsum(times)[:-1])), times) + np.arange(times.sum())
                    x, q = at[by_bucket[place]], np.repeat(q, times)
                    differ = own[x, 0] ^ asked[q, 0]
                    apart = np.bitwise_count(differ)
                    ok = apart <= radius
                    for i in range(j):  # met under an earlier substring already
                        ok &= np.bitwise_count(differ >> U64(16 * i) & U64(0xFFFF)) > reach
                    x, q, apart = x[ok], q[ok], apart[ok].astype(np.int32)
                    for w in range(1, WORDS):
                        apart += np.bitwise_count(own[x, w] ^ asked[q, w])
                    best.add(q, h[x], apart)
        q, found, apart = best.all()
        if len(q):
            yield from pa.table([pa.array(names[q].astype(np.int32)), pa.array(found), pa.array(apart)], names=["query", "h", "apart"]).to_batches(max_chunksize=100_000)

    return run


class _Best:
    """The `most` nearest of what each query has met so far."""

    def __init__(self, queries: int, most: int):
        self.most, self.limit = most, max(1 << 20, 2 * queries * most)
        self.bound = np.full(queries, 1 << 30, np.int32)
        self.held: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, q: np.ndarray, h: np.ndarray, apart: np.ndarray) -> None:
        ok = apart <= self.bound[q]
        self.held.append((q[ok], h[ok], apart[ok]))
        self.size += int(ok.sum())
        if self.size > self.limit:
            self.all()

    def all(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.held:
            return np.empty(0, int), np.empty(0, np.int64), np.empty(0, np.int32)
        q, h, apart = (np.concatenate(c) for c in zip(*self.held))
        order = np.lexsort((h, apart, q))
        q, h, apart = q[order], h[order], apart[order]
        first = np.searchsorted(q, q)
        kept = np.arange(len(q)) - first < self.most
        last = np.arange(len(q)) - first == self.most - 1
        self.bound[q[last]] = apart[last]
        self.held = [(q[kept], h[kept], apart[kept])]
        self.size = int(kept.sum())
        return self.held[0]


def _reranked(shared, kind: str):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, wanted = shared.value
        for b in it:
            if b.num_rows:
                q = b.column("query").to_numpy()
                names = pa.array(asked, b.column("id").type).take(pa.array(q))
                cos = np.einsum("ij,ij->i", unit(b.column("v")), wanted[q])
                found = pa.record_batch([names, b.column("id"), pa.array(cos)], names=["query_id", "id", "cosine"])
                yield found.filter(pa.compute.not_equal(names, b.column("id")))

    return run


def _query_blocks(asked: DataFrame, block: int) -> Iterator[tuple[list, np.ndarray]]:
    ids, vectors = [], []
    for r in asked.toLocalIterator():
        ids.append(r.id)
        vectors.append(r.v)
        if len(ids) == block:
            yield ids, _unit_rows(vectors)
            ids, vectors = [], []
    if ids:
        yield ids, _unit_rows(vectors)


def _unit_rows(vectors: list) -> np.ndarray:
    v = np.asarray(vectors, dtype=np.float64)
    return v / np.linalg.norm(v, axis=1, keepdims=True)
