"""Metadata: keyset pages, counts, memberships, upserts, caches, nearest documents, workflow history."""

from __future__ import annotations

import base64
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Cursor:
    """Where a page ended: query identity, sort, order and the last row's sort value and name."""

    identity: str
    sort: str
    descending: bool
    value: object
    name: str

    def encode(self) -> str:
        own = {"k": self.identity, "s": self.sort, "o": self.descending, "v": self.value, "n": self.name}
        return base64.urlsafe_b64encode(json.dumps(own, separators=(",", ":")).encode()).decode()

    @classmethod
    def decode(cls, text: str, identity: str, sort: str, descending: bool) -> Cursor:
        try:
            own = json.loads(base64.urlsafe_b64decode(text.encode()))
            found = cls(own["k"], own["s"], own["o"], own["v"], own["n"])
        except (ValueError, KeyError, TypeError) as e:
            raise ValueError("this is no cursor") from e
        if (found.identity, found.sort, found.descending) != (identity, sort, descending):
            raise ValueError("this cursor is of another query, sort or order")
        return found


def keyset_page(rows: DataFrame, sort: str, name: str, size: int, after: tuple | None = None, descending: bool = False) -> DataFrame:
    """The rows after (sort, name), in order, one more than a page as a look-ahead. Row comparison, so that no row is skipped or met twice."""
    if after is not None:
        here, there = F.struct(F.col(sort).alias("s"), F.col(name).alias("n")), F.struct(F.lit(after[0]).cast(rows.schema[sort].dataType).alias("s"), F.lit(after[1]).alias("n"))
        rows = rows.where(here < there if descending else here > there)
    order = (F.desc(sort), F.desc(name)) if descending else (F.asc(sort), F.asc(name))
    return rows.orderBy(*order).limit(size + 1)


def offset_page(rows: DataFrame, order: list, size: int, offset: int) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(size)


def counts_by(rows: DataFrame, group: str, status: str, states: list[str]) -> DataFrame:
    """(group, one column for each state, total)."""
    return rows.groupBy(group).agg(*(F.sum(F.when(F.col(status) == s, 1).otherwise(0)).alias(s) for s in states), F.count("*").alias("total"))


def leaving(members: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents that leave: members being removed, and documents that are not imported."""
    return members.where("status = 'removing'").select("document_id").union(documents.where("status <> 'imported'").select("document_id")).distinct()


def searchable(collections: DataFrame, members: DataFrame, gone: DataFrame) -> DataFrame:
    """Collections with a member that is indexed or has a cache entry, and is not leaving."""
    held = members.where("status = 'indexed' or cache_id is not null").join(gone, "document_id", "left_anti")
    return collections.join(held.select("collection").distinct(), "collection", "left_semi")


def inserted(table: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """table with those new rows whose key it does not have: insert or do nothing."""
    return table.unionByName(new.dropDuplicates(key).join(table.select(*key), key, "left_anti"))


def upserted(table: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """table with the new rows in place of those of the same key."""
    return table.join(new.select(*key), key, "left_anti").unionByName(new)


def moved(rows: DataFrame, column: str, allowed: list[str], to: str, guard: Column | None = None) -> DataFrame:
    """rows with the state `to` where the state is allowed to move there and the guard holds."""
    ok = F.col(column).isin(allowed) if guard is None else F.col(column).isin(allowed) & guard
    return rows.withColumn(column, F.when(ok, F.lit(to)).otherwise(F.col(column)))


def settled(pending: Column, claimed: Column) -> Column:
    return F.greatest(F.lit(0), pending - claimed)


def newest(rows: DataFrame, key: list[str], order: str, tie: str) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(F.desc(order), tie)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def mean_vector(rows: DataFrame, key: list[str], vector: str, normalise: bool = True, zeros: bool = False) -> DataFrame:
    """(key, vector, rows): the mean of the rows' unit vectors, not made a unit again; null vectors are left out, and zero vectors unless
    `zeros`, where they count as rows that point nowhere.

    Sums are taken place by place before anything is put together, so that partial sums are what is shuffled.
    """
    from evidara.functions.columns import norm

    own = rows.where(F.col(vector).isNotNull()).withColumn("_n", norm(vector))
    own = own if zeros else own.where("_n > 0")
    each = own.select(*key, "_n", F.posexplode(vector).alias("at", "x"))
    x = F.col("x").cast("double") / F.col("_n") if normalise else F.col("x").cast("double")
    x = F.when(F.col("_n") > 0, F.nanvl(x, F.lit(0.0))).otherwise(0.0) if zeros else x
    sums = each.groupBy(*key, "at").agg(F.sum(x).alias("x"), F.count("*").alias("rows"))
    listed = F.sort_array(F.collect_list(F.struct("at", (F.col("x") / F.col("rows")).alias("x"))))
    return sums.groupBy(*key).agg(F.transform(listed, lambda p: p["x"]).alias("vector"), F.max("rows").alias("rows"))


def step_counts(steps: DataFrame, function: str) -> DataFrame:
    return steps.where(F.col("function") == function).groupBy("workflow_id").agg(F.count("*").alias("steps"))


def folded_operations(runs: DataFrame) -> DataFrame:
    """(id, name, status, jobs, jobs_done): runs without a parent, each with its children as jobs."""
    jobs = runs.where("parent_id is not null").groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("jobs"), F.sum(F.when(F.col("status") == "SUCCESS", 1).otherwise(0)).alias("jobs_done"))
    return runs.where("parent_id is null").join(jobs, "id", "left").select("id", "name", "status", F.coalesce("jobs", F.lit(0)).alias("jobs"), F.coalesce("jobs_done", F.lit(0)).alias("jobs_done"))


def stage_caps(weights: DataFrame, budget: int, key: str = "stage", weight: str = "weight") -> DataFrame:
    """(key, cap): a budget shared out by weights, what is left over going to the largest remainders."""
    # stages are a handful of rows
    all_ = Window.partitionBy()
    exact = F.lit(float(budget)) * F.col(weight) / F.sum(weight).over(all_)
    rows = weights.withColumn("exact", exact).withColumn("base", F.floor("exact")).withColumn("left", F.lit(budget) - F.sum("base").over(all_))
    place = F.row_number().over(Window.orderBy(F.round(F.col("exact") - F.col("base"), 9).desc(), key))
    return rows.withColumn("place", place).select(key, (F.col("base") + F.when(F.col("place") <= F.col("left"), 1).otherwise(0)).cast("long").alias("cap"))


def slices(rows: DataFrame, group: str, order: list[str], n: int) -> DataFrame:
    """rows with slice, from 1: contiguous runs of nearly equal length, longer ones first."""
    return rows.withColumn("slice", F.ntile(n).over(Window.partitionBy(group).orderBy(*order)))
