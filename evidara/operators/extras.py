"""Smaller operators: probes for missing words, aspects, profiles, backfills, batches, topic pairs."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidara.operators.retrieval import FullText, top_k

DOC = ["collection", "document_id"]
#: Rows that every task holds at a time when all pairs are counted.
PAIR_BLOCK = 512


def probes(missing: DataFrame, index: FullText, held: DataFrame, depth: int = 20) -> DataFrame:
    """(query_id, key, score): for each question the best row that holds words its answer misses and is not in the answer yet.

    missing(query_id, term), held(query_id, key), index over the rows by their key. The ranking is read `depth` and what is held deep, which is bounded by what an answer scans.
    """
    key = index.key
    asked = missing.groupBy("query_id").agg(F.concat_ws(" ", F.sort_array(F.collect_set("term"))).alias("question"))
    n = held.groupBy("query_id").agg(F.count("*").alias("n_held"))
    most = n.join(asked, "query_id", "left_semi").agg(F.max("n_held")).first()[0] or 0
    found = index.search(asked, depth + most).drop("rank")
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), *key)
    deep = found.join(n, "query_id", "left").withColumn("at", F.row_number().over(order)).where(F.col("at") <= depth + F.coalesce("n_held", F.lit(0)))
    new = deep.join(held.select("query_id", *key).distinct(), ["query_id", *key], "left_anti")
    return top_k(new, 1, ["query_id"], F.round("score", 9).desc(), *key).select("query_id", *key, "score")


def aspects(picked: DataFrame, ranked: DataFrame, key: list[str]) -> DataFrame:
    """(request_id, item, aspects, best): the questions whose rankings hold a picked item's chunks, and the best score of any of them.

    picked(request_id, item, key), ranked(request_id, part, key, score).
    """
    met = picked.join(ranked, ["request_id", *key])
    by = met.groupBy("request_id", "item", "part").agg(F.max("score").alias("score"))
    return by.groupBy("request_id", "item").agg(F.sort_array(F.collect_list("part")).alias("aspects"), F.max("score").alias("best"))


def framed_question(context: Column, question: Column) -> Column:
    """What is embedded of a question: its context before it, where there is one."""
    return F.when(F.length(F.trim(context)) > 0, F.concat(F.trim(context), F.lit("\n\n"), question)).otherwise(question)


def profiles(rows: DataFrame, models: DataFrame) -> DataFrame:
    """Profiles with their models, by dimensions, parameters and name; a missing description is the model's."""
    m = models.select("model", "dims", "params", F.col("description").alias("_d"))
    return rows.join(m, "model").withColumn("description", F.coalesce("description", "_d")).drop("_d").orderBy("dims", "params", "profile")


def unknown_references(used: DataFrame, known: DataFrame, column: str) -> DataFrame:
    return used.select(column).where(F.col(column).isNotNull()).distinct().join(known.select(column), column, "left_anti")


def first_members(rows: DataFrame, leaving: DataFrame, n: int) -> DataFrame:
    """The first n documents of each collection by name, without what is leaving."""
    kept = rows.join(leaving.select("document_id").distinct(), "document_id", "left_anti")
    return top_k(kept, n, ["collection"], "name", "document_id", rank="n")


def described_if_empty(rows: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """rows with the new description where they have none."""
    own = new.select(key, F.col("description").alias("_new"))
    filled = F.when(F.coalesce(F.trim("description"), F.lit("")) == "", F.coalesce("_new", "description")).otherwise(F.col("description"))
    return rows.join(own, key, "left").withColumn("description", filled).drop("_new")


def backfilled(rows: DataFrame, computed: DataFrame, key: str, column: str) -> DataFrame:
    """rows with the computed value where theirs is null."""
    return rows.join(computed.select(key, F.col(column).alias("_c")), key, "left").withColumn(column, F.coalesce(column, "_c")).drop("_c")


def plan_batches(rows: DataFrame, group: list[str], order: list[str], size: int) -> DataFrame:
    """rows with batch, from 0: groups of a fixed size in order."""
    w = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size).cast("int"))


def evenly_spaced(chunks: DataFrame, group: list[str], chars: str, whole: int = 6000, picks: int = 6) -> DataFrame:
    """chunks with share: all of a group that is short enough, else `picks` of them from first to last, each cut to its share."""
    w = Window.partitionBy(*group)
    rows = chunks.withColumns({"_all": F.sum(chars).over(w), "_n": F.count("*").over(w), "_at": F.row_number().over(w.orderBy("seq")) - 1})
    step = (F.col("_n") - 1) / (picks - 1)
    spots = F.transform(F.sequence(F.lit(0), F.lit(picks - 1)), lambda i: F.floor(i * step + 0.5).cast("int"))
    keep = (F.col("_all") <= whole) | F.array_contains(spots, F.col("_at"))
    share = F.when(F.col("_all") <= whole, F.col(chars)).otherwise(F.least(F.col(chars), F.lit(whole // picks)))
    return rows.where(keep).withColumn("share", share).drop("_all", "_n", "_at")


def subsections(sections: DataFrame) -> DataFrame:
    """(collection, document_id, position, sub): the deeper sections within each section's run, under its headings."""
    inner = sections.select(*DOC, F.col("position").alias("sub"), F.col("depth").alias("d"), F.col("path").alias("p"), F.col("seq_start").alias("s"), F.col("seq_end").alias("e"))
    met = sections.join(inner, DOC).where("d > depth and s >= seq_start and e <= seq_end")
    return met.where(F.slice("p", F.lit(1), F.col("depth")) == F.col("path")).select(*DOC, "position", "sub")


def topic_pairs(topics: DataFrame, vector: str, bar: float) -> DataFrame:
    """(same, pairs, joined): pairs of phrasings of one topic and of different topics, and how many of each a bar joins.

    topics(id, topic, vector), of any size: all pairs are counted. Rows are read in blocks that every task holds and multiplied with all
    rows, so that only counts are shuffled; the work is quadratic in the rows. Null vectors are joined with nothing; all-zero ones
    have cosine 0.
    """
    spark = topics.sparkSession
    own = topics.select("id", F.col("topic").cast("string").alias("topic"), F.col(vector).cast("array<double>").alias("v")).where("id is not null")
    schema = "same boolean, pairs long, joined long"
    parts: list[DataFrame] = []

    def counted(block: list) -> DataFrame:
        shared = spark.sparkContext.broadcast((np.array([r.id for r in block]), [r.topic for r in block], [r.v for r in block]))

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, names, vectors = shared.value
            known: dict[str | None, int] = {None: -1}
            of = np.array([known.setdefault(x, len(known)) for x in names])
            by_length = _unit_by_length(vectors)
            for b in it:
                if not b.num_rows:
                    continue
                later = ids[:, None] < np.array(b.column("id").to_pylist())[None, :]
                theirs = np.array([known.get(x, -2) for x in b.column("topic").to_pylist()])
                near = np.zeros(later.shape, bool)
                for n, (at, v) in _unit_by_length(b.column("v").to_pylist()).items():
                    if n in by_length:
                        near[np.ix_(by_length[n][0], at)] = by_length[n][1] @ v.T > bar
                unknown = (of == -1)[:, None] | (theirs == -1)[None, :]
                alike = of[:, None] == theirs[None, :]
                groups = [(same, later & m) for same, m in ((True, alike & ~unknown), (False, ~alike & ~unknown), (None, unknown))]
                found = [(same, int(m.sum()), int((m & near).sum())) for same, m in groups]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*found), (pa.bool_(), pa.int64(), pa.int64()))], names=["same", "pairs", "joined"])

        return own.mapInArrow(run, schema)

    block: list = []
    for r in own.toLocalIterator():
        block.append(r)
        if len(block) == PAIR_BLOCK:
            parts.append(counted(block))
            block = []
    if block:
        parts.append(counted(block))
    every = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)
    return every.groupBy("same").agg(F.sum("pairs").alias("pairs"), F.sum("joined").alias("joined")).where("pairs > 0")


def _unit_by_length(vectors: list) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Places and unit vectors of the vectors of each length; nulls are left out, all-zero vectors stay as they are."""
    lengths = np.array([len(v) if v is not None and None not in v else 0 for v in vectors])
    out = {}
    for n in set(lengths.tolist()) - {0}:
        at = np.flatnonzero(lengths == n)
        v = np.array([vectors[i] for i in at], dtype=np.float64)
        norm = np.linalg.norm(v, axis=1, keepdims=True)
        out[n] = at, v / np.where(norm > 0, norm, 1)
    return out


def batch_outputs(runs: DataFrame, batches: DataFrame) -> DataFrame:
    """(id, finished_at, outputs): finished runs with what their batches put out."""
    sums = batches.groupBy(F.col("run_id").alias("id")).agg(F.sum("outputs").alias("outputs"))
    return runs.where("status = 'SUCCESS'").join(sums, "id", "left").select("id", "finished_at", F.coalesce("outputs", F.lit(0)).alias("outputs"))


def activity(runs: DataFrame) -> DataFrame:
    """(name, running, left): what is under way of each kind, and how many of its batches are left."""
    return runs.where("status in ('PENDING', 'ENQUEUED')").groupBy("name").agg(F.count("*").alias("running"), F.sum(F.greatest(F.lit(0), F.col("total") - F.col("done"))).alias("left"))


def model_cache_name(model: Column, dims: Column, prefix: Column, matryoshka: Column) -> Column:
    """'model@dims:' and twelve digits of the digest of what else decides a vector."""
    own = F.sha2(F.concat_ws(";", F.coalesce(prefix, F.lit("")), F.coalesce(matryoshka.cast("string"), F.lit(""))), 256)
    return F.concat(model, F.lit("@"), dims.cast("string"), F.lit(":"), F.substring(own, 1, 12))
