"""Mixing sources to target shares: a min-cost flow from groups of texts to the sources' quotas.

The unit of the mix is a text. What several listed sources hold is one unit, which belongs to all of them; further copies of a text
within one source are units of that source alone. Units are grouped by the set of sources that hold them. A group's
first use, by whichever source, is free, and each further one costs more than the one before; a source takes each unit at most as often as
its cap says. The flow that fills the quotas at the least cost says how often each group is used for each source; units are then
drawn by a seeded hash, which cuts the last, partial repetition, and come out as the document that the source has of the text.

Sources are compared trimmed and in lower case. Null sources and those not listed take no part. Null texts have size 0.
Rows of one id in one source count once (the largest). Quotas are shares of `total`, by default the size of all documents of
listed sources, each document once.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidara.llm.common import arrow_map
from evidara.llm.tokens import counter
from evidara.session import few_rows, scratch, spread

#: Sets of sources that the flow is solved over on the driver, at most; with few sources there are few.
GROUPS = 50_000
#: Slices of the hash in which sizes are added up to find where a partial repetition ends.
SLICES = 4096


class Flow:
    """Successive shortest paths with potentials; capacities are numbers, costs are not negative."""

    def __init__(self, n: int):
        self.arcs: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.room: list[float] = []
        self.cost: list[float] = []

    def add(self, a: int, b: int, room: float, cost: float) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.arcs[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def run(self, s: int, t: int) -> float:
        n, total = len(self.arcs), 0.0
        level = [0.0] * n
        while True:
            far, via = [float("inf")] * n, [-1] * n
            far[s] = 0.0
            heap = [(0.0, s)]
            while heap:
                d, x = heapq.heappop(heap)
                if d > far[x]:
                    continue
                for e in self.arcs[x]:
                    if self.room[e] > 0:
                        y = self.to[e]
                        z = d + self.cost[e] + level[x] - level[y]
                        if z < far[y] - 1e-12:
                            far[y], via[y] = z, e
                            heapq.heappush(heap, (z, y))
            if via[t] < 0:
                return total
            level = [p + min(f, far[t]) for p, f in zip(level, far)]
            step, x = float("inf"), t
            while x != s:
                step = min(step, self.room[via[x]])
                x = self.to[via[x] ^ 1]
            x = t
            while x != s:
                self.room[via[x]] -= step
                self.room[via[x] ^ 1] += step
                x = self.to[via[x] ^ 1]
            total += step


@dataclass(frozen=True)
class Mix:
    """documents(id, source, copies, size): what to draw; report(source, target_share, max_repeats, available, quota,
    reachable, used, actual_share): used and actual_share are of the drawn documents."""

    documents: DataFrame
    report: DataFrame


def route(sizes: dict[tuple[str, ...], int], targets: list[tuple[str, float, int]], total: int) -> dict[tuple[tuple[str, ...], str], float]:
    """How much of each group goes to each source, repetitions included."""
    groups = sorted(sizes)
    at = {g: 1 + i for i, g in enumerate(groups)}
    goal = {s: 1 + len(groups) + i for i, (s, _, _) in enumerate(targets)}
    end = 1 + len(groups) + len(targets)
    flow = Flow(end + 1)
    arcs: dict[tuple[tuple[str, ...], str], int] = {}
    for g in groups:
        own = [(s, max(0, most)) for s, _, most in targets if s in g]
        for r in range(sum(most for _, most in own)):
            flow.add(0, at[g], sizes[g], r)
        for s, most in own:
            arcs[g, s] = flow.add(at[g], goal[s], sizes[g] * most, 0)
    for s, share, _ in targets:
        flow.add(goal[s], end, share * total, 0)
    flow.run(0, end)
    return {k: flow.room[e ^ 1] for k, e in arcs.items()}


def filled(used: dict[tuple[tuple[str, ...], str], float], own: dict[str, int], targets: list[tuple[str, float, int]], total: int) -> dict[str, bool]:
    """Whether the flow routed to each source fills its quota. That a source's caps alone allow as much is compared as a check."""
    out = {}
    for s, share, most in targets:
        quota = share * total
        slack = 1e-9 * max(1.0, quota)
        out[s] = sum(v for (_, to), v in used.items() if to == s) >= quota - slack
        spare = max(0, most) * own[s] - quota
        if abs(spare) > slack and out[s] != (spare > 0):
            raise RuntimeError(f"the flow and the caps of source {s!r} disagree on whether its quota is reachable")
    return out


def normal(source: Column) -> Column:
    return F.lower(F.trim(source))


def mixed(df: DataFrame, id_col: str, source_col: str, text_col: str, targets: DataFrame, size: str = "words", share_texts: bool = True, total: int | None = None, seed: int = 13, tokenizer: str | None = None) -> Mix:
    """size: 'words' or 'tokens'; share_texts: whether a text found in several listed sources is one unit of them all."""
    terms = targets.groupBy(normal(F.col("source")).alias("s")).agg(F.sum("target_share").alias("t"), F.max("max_repeats").alias("m")).where("s is not null")
    if not few_rows(terms, GROUPS):
        raise ValueError(f"more than {GROUPS} target sources")
    wanted = [(r.s, r.t or 0.0, r.m or 0) for r in terms.orderBy("s").collect()]
    names = [s for s, _, _ in wanted]
    spark = df.sparkSession
    listed = spark.createDataFrame([(s,) for s in names], "source string")
    docs = spread(df.select(F.col(id_col).cast("long").alias("id"), normal(F.col(source_col)).alias("source"), F.col(text_col).alias("text")))
    docs = docs.where("id is not null").join(F.broadcast(listed) if len(names) < 10_000 else listed, "source")
    sized = scratch(_sized(docs, size, tokenizer).groupBy("id", "source").agg(F.max_by(F.struct("size", "digest"), "size").alias("x")).select("id", "source", "x.*"), "sized")
    units = scratch(_units(sized, share_texts, seed), "units")
    sizes = units.groupBy("held").agg(F.sum("size").alias("size"))
    if not few_rows(sizes, GROUPS):
        raise ValueError(f"more than {GROUPS} sets of sources overlap")
    by = {tuple(r.held): int(r["size"] or 0) for r in sizes.collect()}
    whole = total if total is not None else sum(n * len(g) for g, n in by.items())
    used = route(by, wanted, whole)
    own = {s: sum(n for g, n in by.items() if s in g) for s in names}
    most = {s: max(0, m) for s, _, m in wanted}
    passes, start = [], dict.fromkeys(by, 0.0)
    for (g, s), v in used.items():
        passes.append((list(g), s, start[g], v / by[g] if by[g] else 0.0, most[s]))
        start[g] += passes[-1][3]
    plan = spark.createDataFrame(passes, "held array<string>, to string, begin double, passes double, most int")
    drawn = _drawn(units, F.broadcast(plan))
    actual = drawn.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("used"))
    reachable = filled(used, own, wanted, whole)
    terms = spark.createDataFrame([(s, t, m, own[s], t * whole, reachable[s]) for s, t, m in wanted], "source string, target_share double, max_repeats int, available long, quota double, reachable boolean")
    report = terms.join(actual, "source", "left").withColumn("used", F.coalesce("used", F.lit(0)))
    report = report.withColumn("actual_share", F.coalesce(F.col("used") / F.when(F.sum("used").over(Window.partitionBy()) > 0, F.sum("used").over(Window.partitionBy())), F.lit(0.0)))
    return Mix(drawn, report)


def _units(sized: DataFrame, share_texts: bool, seed: int) -> DataFrame:
    """(held, size, u, docs): the sources that hold a unit, its place in the draw, and each source's document of it.

    The first document of a text in each source is part of the text's unit; no group of copies is gathered, however large.
    """
    def place(key: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 30)) / float(1 << 30)

    alone = sized.select(F.array("source").alias("held"), "size", place(F.col("id")).alias("u"), F.array(F.struct("source", "id")).alias("docs"), "id", "source")
    if not share_texts:
        return alone.drop("id", "source")
    first = sized.groupBy("digest", "source").agg(F.min("id").alias("id"), F.max("size").alias("size"))
    shared = first.groupBy("digest").agg(F.max("size").alias("size"), F.sort_array(F.collect_list(F.struct("source", "id"))).alias("docs")).where("size(docs) > 1")
    shared = shared.select(F.transform("docs", lambda x: x["source"]).alias("held"), "size", place(F.col("digest")).alias("u"), "docs")
    of_shared = shared.select(F.explode("docs").alias("d")).select("d.id", "d.source")
    return shared.unionByName(alone.join(of_shared, ["id", "source"], "left_anti").drop("id", "source"))


def _sized(docs: DataFrame, size: str, tokenizer: str | None) -> DataFrame:
    if size == "words":
        return docs.select("id", "source", F.coalesce(F.regexp_count("text", F.lit(r"\S+")), F.lit(0)).cast("long").alias("size"), F.md5(F.coalesce("text", F.lit(""))).alias("digest"))
    docs = docs.select("id", "source", "text", F.md5(F.coalesce("text", F.lit(""))).alias("digest"))

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        count: Callable[[list[str]], list[int]] = counter(tokenizer)
        n = count([t or "" for t in b.column("text").to_pylist()])
        yield pa.record_batch([b.column("id"), b.column("source"), pa.array(n, pa.int64()), b.column("digest")], names=["id", "source", "size", "digest"])

    return arrow_map(docs, run, "id long, source string, size long, digest string")


def _drawn(units: DataFrame, plan: DataFrame) -> DataFrame:
    """(id, source, copies, size): units lie in the order of their hash, by size, on a ring of length 1 for each group;
    each source takes its passes round the ring from where the one before it stopped."""
    rows = units.withColumn("slice", F.floor(F.col("u") * SLICES))
    sums = rows.groupBy("held", "slice").agg(F.sum("size").alias("sum"))
    w = Window.partitionBy("held").orderBy("slice")
    sums = sums.select("held", "slice", "sum", (F.sum("sum").over(w) - F.col("sum")).alias("before"), F.sum("sum").over(Window.partitionBy("held")).alias("all"))
    place = (F.col("before") + (F.col("u") * SLICES - F.col("slice")) * F.col("sum")) / F.when(F.col("all") > 0, F.col("all"))
    placed = rows.join(sums, ["held", "slice"]).select("docs", "held", "size", F.coalesce(place, F.lit(0.0)).alias("place"))
    copies = F.least(F.ceil(F.col("begin") + F.col("passes") - F.col("place")) - F.ceil(F.col("begin") - F.col("place")), "most")
    taken = placed.join(plan, "held").withColumn("copies", copies.cast("int")).where("copies > 0")
    return taken.select(F.filter("docs", lambda x: x["source"] == F.col("to"))[0]["id"].alias("id"), F.col("to").alias("source"), "copies", "size")
