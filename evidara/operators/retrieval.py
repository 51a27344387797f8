"""Retrieval over chunk rows for batches of queries: postings, BM25, exact nearest vectors, fusion, reranking, pages.

Every operator carries query_id; what ranks one query's rows is a window over it. Filters come before the cut to k.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from evidara.functions.columns import words
from evidara.session import few_rows, scratch

#: Constants of BM25.
K1, B = 1.2, 0.75
#: Queries that a task holds at a time.
QUERY_BLOCK = 1024


def top_k(df: DataFrame, k: int, by: list[str], *order: Column | str, rank: str = "rank") -> DataFrame:
    """The first k rows of each group, with their rank from 1."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def postings(rows: DataFrame, key: list[str], text: str, index: list[str] | None = None) -> DataFrame:
    """(index, key, term, tf, dl): the uses of each term in each row; index names the columns of which each value is an index of its own."""
    index = index or []
    own = rows.select(*index, *key, words(text).alias("w")).where(F.size("w") > 0)
    terms = own.select(*index, *key, F.size("w").alias("dl"), F.explode("w").alias("term"))
    return terms.groupBy(*index, *key, "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def bm25(queries: DataFrame, rows: DataFrame, key: list[str], text: str, k: int | None = None, index: list[str] | None = None, query_text: str = "question") -> DataFrame:
    """(query_id, index, key, score [, rank]): the full-text scores of the rows that hold a term of a query.

    queries(query_id, question). Statistics are those of each index, or of all rows. With k, rows are scored in blocks of queries and only each task's best k are
    shuffled, by an index that is built here (FullText, where one is at hand); without k, all rows with a term are, where the terms are few by a broadcast.
    """
    index = index or []
    if k is not None:
        return FullText(rows, key, text, index).search(queries, k, query_text)
    asked = queries.select("query_id", F.explode(F.array_distinct(words(query_text))).alias("term"))
    own = rows.select(*index, *key, words(text).alias("w")).where(F.size("w") > 0)
    size = own.groupBy(*index).agg(F.count("*").alias("n"), F.avg(F.size("w")).alias("avgdl"))
    found = postings(rows, key, text, index)
    terms = asked.select("term").distinct()
    met = found.join(F.broadcast(terms) if few_rows(terms, 200_000) else terms, "term", "left_semi")
    df = met.groupBy(*index, "term").agg(F.count("*").alias("df"))
    weighed = met.join(df, [*index, "term"])
    weighed = weighed.join(F.broadcast(size) if few_rows(size, 200_000) else size, index) if index else weighed.crossJoin(F.broadcast(size))  # one row
    idf = F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return weighed.withColumn("part", part).join(asked, "term").groupBy("query_id", *index, *key).agg(F.sum("part").alias("score"))


class FullText:
    """A stored full-text index: each row's terms with their counts, how many rows of an index have each term, and its size.

    Texts are cut into words once. A row is stored once, whatever the number of its terms, so that a term that a third of all rows hold is no hot key.
    Rows are taken as they come: the caller sees to it that a key is there once. index names columns of which each value is an index of its own.
    """

    def __init__(self, rows: DataFrame, key: list[str], text: str, index: list[str] | None = None):
        self.key, self.index = key, index or []
        place = [*self.index, *key]
        kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                counted = [Counter(w) for w in b.column("w").to_pylist()]
                columns = [*(b.column(c) for c in place), pa.array([n.total() for n in counted], pa.int32()), pa.array([list(n) for n in counted], pa.list_(pa.string())), pa.array([list(n.values()) for n in counted], pa.list_(pa.int32()))]
                yield pa.record_batch(columns, names=[*place, "dl", "terms", "tfs"])

        own = rows.select(*place, words(text).alias("w")).where(F.size("w") > 0)
        schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in place), "dl int, terms array<string>, tfs array<int>"])
        self.rows = scratch(own.mapInArrow(run, schema), "fulltext")
        self.sizes = scratch(self.rows.groupBy(*self.index).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")), "sizes")
        self.df = scratch(self.rows.select(*self.index, F.explode("terms").alias("term")).groupBy(*self.index, "term").agg(F.count("*").alias("df")), "df")
        self.schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in place), "score double"])

    def search(self, queries: DataFrame, k: int, query_text: str = "question") -> DataFrame:
        """(query_id, index, key, score, rank): the best k rows of each index for each query; queries are read a block at a time."""
        kind, named = queries.schema["query_id"].dataType.simpleString(), to_arrow_type(queries.schema["query_id"].dataType)
        schema, place = f"query_id {kind}, {self.schema}", [*self.index, *self.key]
        asked = queries.select("query_id", F.array_distinct(words(query_text)).alias("terms")).where(F.size("terms") > 0)
        parts, block = [], []
        for r in asked.toLocalIterator():
            block.append(r)
            if len(block) == QUERY_BLOCK:
                parts.append(self.rows.mapInArrow(self._scorer(block, k, named), schema))
                block = []
        if block:
            parts.append(self.rows.mapInArrow(self._scorer(block, k, named), schema))
        if not parts:
            return self.rows.sparkSession.createDataFrame([], schema + ", rank int")
        return top_k(reduce(DataFrame.unionByName, parts), k, ["query_id", *self.index], F.round("score", 9).desc(), *place)

    def _scorer(self, block: list, k: int, named: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        spark, index, key = self.rows.sparkSession, self.index, self.key
        terms = sorted({t for r in block for t in r.terms})
        mine = spark.createDataFrame([(t, n) for n, t in enumerate(terms)], "term string, t int")
        # for each index at most the terms of a block
        known = self.df.join(F.broadcast(mine), "term").join(self.sizes, index).select(*index, "t", "df", "n", "avgdl") if index else self.df.join(F.broadcast(mine), "term").crossJoin(F.broadcast(self.sizes)).select("t", "df", "n", "avgdl")
        weights: dict[tuple, tuple] = {}
        for r in known.toLocalIterator():
            idf, avgdl = weights.setdefault(tuple(r[c] for c in index), (np.zeros(len(terms)), r.avgdl))
            idf[r.t] = np.log1p((r.n - r.df + 0.5) / (r.df + 0.5))
        at = {t: n for n, t in enumerate(terms)}
        shared = spark.sparkContext.broadcast(([r.query_id for r in block], [np.array([at[t] for t in r.terms]) for r in block], pa.array(terms, pa.string()), weights))

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, wanted, terms, weights = shared.value
            for b in it:
                if not b.num_rows:
                    continue
                flat = pc.index_in(b.column("terms").flatten(), value_set=terms)
                met = np.flatnonzero(np.asarray(flat.is_valid()))
                term = flat.take(pa.array(met)).to_numpy(zero_copy_only=False).astype(np.int64)
                row = np.repeat(np.arange(b.num_rows), b.column("terms").value_lengths().to_numpy(zero_copy_only=False))[met]
                tf = b.column("tfs").flatten().to_numpy(zero_copy_only=False)[met].astype(float)
                dl = b.column("dl").to_numpy(zero_copy_only=False)[row]
                places = list(zip(*(b.column(c).to_pylist() for c in index))) if index else [()] * b.num_rows
                found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
                for name in dict.fromkeys(places):
                    if name not in weights:
                        continue
                    idf, avgdl = weights[name]
                    own = np.flatnonzero(np.fromiter((places[r] == name for r in row), bool, len(row))) if index else np.arange(len(row))
                    t, r = term[own], row[own]
                    score = idf[t] * tf[own] * (K1 + 1) / (tf[own] + K1 * (1 - B + B * dl[own] / avgdl))
                    found += _best_rows(t, r, score, wanted, len(terms), b.num_rows, k)
                if found:
                    q, r, score = (np.concatenate(x) for x in zip(*found))
                    taken = pa.array(r)
                    yield pa.record_batch([pa.array(names, named).take(pa.array(q)), *(b.column(c).take(taken) for c in (*index, *key)), pa.array(score)], names=["query_id", *index, *key, "score"])

        return run


def _best_rows(term: np.ndarray, row: np.ndarray, score: np.ndarray, wanted: list[np.ndarray], terms: int, rows: int, k: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, row, score) of the best k rows of each query, and those that tie with the last, so that the last word on ties is the window's."""
    order = np.argsort(term, kind="stable")
    row, score = row[order], score[order]
    first = np.searchsorted(term[order], np.arange(terms + 1))
    out = []
    for q, own in enumerate(wanted):
        spans = [(first[t], first[t + 1]) for t in own if first[t] < first[t + 1]]
        if not spans:
            continue
        total = np.bincount(np.concatenate([row[a:z] for a, z in spans]), weights=np.concatenate([score[a:z] for a, z in spans]), minlength=rows)
        hit = np.flatnonzero(total > 0)
        if len(hit) > k:
            edge = np.partition(total[hit], len(hit) - k)[len(hit) - k]
            hit = hit[total[hit] >= edge - 2e-9]
        out.append((np.full(len(hit), q), hit, total[hit]))
    return out


def nearest(queries: DataFrame, rows: DataFrame, id_col: str, vector_col: str, k: int, query_vector: str = "vector") -> DataFrame:
    """(query_id, id, distance, rank): the k rows of least squared distance to each query, exact.

    Queries are read in blocks that every task holds; each task multiplies its rows with a block and passes on its best k,
    so that what is shuffled does not grow with the rows of a task.
    """
    spark = rows.sparkSession
    ids = rows.schema[id_col].dataType.simpleString()
    asked, named = queries.schema["query_id"].dataType.simpleString(), to_arrow_type(queries.schema["query_id"].dataType)
    schema = f"query_id {asked}, id {ids}, distance double"
    own = rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where("id is not null and v is not null")
    result = None
    block: list = []

    def asked_of(block: list) -> DataFrame:
        shared = spark.sparkContext.broadcast(([r.query_id for r in block], np.array([r.v for r in block], dtype=np.float64)))

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, q = shared.value
            for b in it:
                fine = np.flatnonzero(np.asarray(b.column("v").value_lengths()) == q.shape[1])
                b = b.take(pa.array(fine))
                if not b.num_rows:
                    continue
                v = np.asarray(b.column("v").flatten(), dtype=np.float64).reshape(b.num_rows, -1)
                d = np.maximum(0, (q * q).sum(1)[:, None] + (v * v).sum(1)[None, :] - 2 * q @ v.T)
                most = min(k, b.num_rows)
                # ties at the cut are kept, so that the last word on them is the window's
                edge = np.partition(d, most - 1, axis=1)[:, most - 1 : most]
                at_q, at_v = np.nonzero(d <= edge + 1e-12)
                near = ((q[at_q] - v[at_v]) ** 2).sum(1)
                yield pa.record_batch([pa.array(names, named).take(pa.array(at_q)), b.column("id").take(pa.array(at_v)), pa.array(near)], names=["query_id", "id", "distance"])

        return own.mapInArrow(run, schema)

    for r in queries.select("query_id", F.col(query_vector).alias("v")).where("v is not null").toLocalIterator():
        block.append(r)
        if len(block) == QUERY_BLOCK:
            result = asked_of(block) if result is None else result.unionByName(asked_of(block))
            block = []
    if block:
        result = asked_of(block) if result is None else result.unionByName(asked_of(block))
    if result is None:
        return spark.createDataFrame([], schema + ", rank int")
    return top_k(result, k, ["query_id"], F.round("distance", 9), "id")


def first_per(df: DataFrame, span: list[str], *order: Column | str) -> DataFrame:
    """The first row of each span of a query, in the given order."""
    return df.withColumn("_first", F.row_number().over(Window.partitionBy("query_id", *span).orderBy(*order))).where("_first = 1").drop("_first")


def ranked_halves(half: DataFrame, span: list[str], score: str, more: bool, k: int) -> DataFrame:
    """One ranking of a half over several collections: a span found in several keeps its first, best score."""
    order = F.desc(score) if more else F.asc(score)
    return top_k(first_per(half, span, order, "collection"), k, ["query_id"], order, *span)


def rrf(halves: list[DataFrame], key: list[str], k: int = 60) -> DataFrame:
    """(query_id, key, score, first, rank): the sum of 1 / (k + rank) over ranked halves; ties by first appearance."""
    both = None
    for n, h in enumerate(halves):
        own = h.select("query_id", *key, "rank", F.lit(n).alias("half"))
        both = own if both is None else both.unionByName(own)
    appeared = F.min(F.struct("half", "rank"))
    fused = both.groupBy("query_id", *key).agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), appeared.alias("first"))
    w = Window.partitionBy("query_id").orderBy(F.round("score", 12).desc(), "first", *key)
    return fused.withColumn("rank", F.row_number().over(w)).select("query_id", *key, "score", "rank")


def scaled(df: DataFrame, score: str, more: bool = True) -> Column:
    """A score on 0 to 1 within its query; 0 where all are equal."""
    w = Window.partitionBy("query_id")
    low, high = F.min(score).over(w), F.max(score).over(w)
    up = (F.col(score) - low) if more else (high - F.col(score))
    return F.when(high > low, up / (high - low)).otherwise(0.0)


def linear(vector: DataFrame, lexical: DataFrame, key: list[str], share: float) -> DataFrame:
    """(query_id, key, score, rank): share of the scaled vector half and the rest of the scaled full-text half; a missing half is 0."""
    v = vector.withColumn("v", scaled(vector, "distance", more=False)).select("query_id", *key, "v", F.col("rank").alias("vr"))
    b = lexical.withColumn("b", scaled(lexical, "score")).select("query_id", *key, "b", F.col("rank").alias("br"))
    both = v.join(b, ["query_id", *key], "full_outer")
    score = share * F.coalesce("v", F.lit(0.0)) + (1 - share) * F.coalesce("b", F.lit(0.0))
    first = F.struct(F.when(F.col("vr").isNotNull(), 0).otherwise(1), F.coalesce("vr", "br"))
    w = Window.partitionBy("query_id").orderBy(F.round("score", 12).desc(), "first", *key)
    return both.select("query_id", *key, score.alias("score"), first.alias("first")).withColumn("rank", F.row_number().over(w)).drop("first")


Scorer = Callable[[list[str], list[str]], list[float]]


def overlap_scorer(questions: list[str], texts: list[str]) -> list[float]:
    """A deterministic stand-in for a cross-encoder: the share of a question's words that a text holds."""
    own = [(set(q.lower().split()), set(t.lower().split())) for q, t in zip(questions, texts)]
    return [len(q & t) / len(q) if q else 0.0 for q, t in own]


def rerank(pool: DataFrame, question: str, text: str, floor: float | None, k: int, key: list[str], scorer: Scorer = overlap_scorer, weighs: bool = False) -> DataFrame:
    """pool with new scores and ranks: rescored in batches, rows under the floor dropped unless the answer weighs all."""

    @F.pandas_udf("double")
    def score(q: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series(scorer(q.fillna("").tolist(), t.fillna("").tolist()), dtype="float64")

    rows = pool.drop("score", "rank").withColumn("score", score(question, text))
    if not weighs:
        rows = rows.where(F.col("score") >= (floor or 0.0))
    return top_k(rows, k, ["query_id"], F.desc("score"), *key)


def text_page(hits: DataFrame, span: list[str], size: int, offset: int = 0) -> DataFrame:
    """A page of a full-text listing over all collections: each span's best copy, best first."""
    if not 0 < size <= 200 or offset + size > 1000:
        raise ValueError("a page holds 1 to 200 rows, and a listing is read 1,000 deep")
    one = first_per(hits, span, F.round("score", 9).desc(), "collection")
    return top_k(one, offset + size, ["query_id"], F.round("score", 9).desc(), *span, "collection").where(F.col("rank") > offset)


def leaving_out(rows: DataFrame, leaving: DataFrame, key: str = "document_id") -> DataFrame:
    """rows without what is leaving, before anything is ranked: what leaves takes no place of the limit."""
    return rows.join(leaving.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def scoped(rows: DataFrame, documents: list[str] | None = None, sections: list[str] | None = None) -> DataFrame:
    """rows of the given documents that lie in any of the given sections; None leaves a scope open."""
    if documents is not None:
        rows = rows.where(F.col("document_id").isin(documents))
    if sections is not None:
        rows = rows.where(F.arrays_overlap("section_ids", F.array(*map(F.lit, sections))))
    return rows
