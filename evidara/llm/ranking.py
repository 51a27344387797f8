"""One ranking from several differently scaled scores: ideal points.

Within each group every score is winsorised, divided by the root of its sum of squares and weighted; a row's closeness is its distance to
the worst point (the worst of each score) over the sum of that and its distance to the ideal point. No score decides by its range.

Nulls and values that are no numbers are as bad as the worst. Repeated rows of a key are one, with its best scores.
A group whose rows are all alike has closeness 0.5 throughout; ties are broken by the key. Rows without a group or a key are left out.
Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidara.session import few_rows, scratch


@dataclass(frozen=True)
class Score:
    """A score column; more: whether more is better; weight: a number or the name of a column of one value for each group."""

    column: str
    more: bool = True
    weight: float | str = 1.0


#: Slices of closeness in which a group's rows are counted, so that no task sorts a whole large group.
SLICES = 256
#: Rows that one step of a tournament holds.
HEAT = 256
#: Groups up to which a table of one row for each is broadcast; such a row is some 200 bytes.
FEW_GROUPS = 200_000


def _gain(s: Score) -> Column:
    x = F.col(s.column).cast("double")
    return F.when(~F.isnan(x), x if s.more else -x)


def ideal_points(df: DataFrame, group: str, key: list[str], scores: list[Score], tail: float = 0.05) -> DataFrame:
    """(group, key, g0, g1 ..., closeness, rank): g are the scores with more as better; rank counts from 1 in each group."""
    weights = [s.weight for s in scores if isinstance(s.weight, str)]
    rows = df.where(reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in [group, *key])))
    rows = rows.groupBy(group, *key).agg(*(F.max(_gain(s)).alias(f"g{i}") for i, s in enumerate(scores)), *(F.max(w).cast("double").alias(f"w_{w}") for w in dict.fromkeys(weights)))
    n = range(len(scores))
    rows = scratch(rows, "rows")
    # quantiles from bounded, mergeable summaries; exact for groups up to their size
    ends = rows.groupBy(group).agg(*(F.percentile_approx(f"g{i}", [tail, 1 - tail], 10_000).alias(f"q{i}") for i in n))
    clipped = rows.join(_small(scratch(ends, "ends")), group).select("*", *(F.least(F.greatest(f"g{i}", F.col(f"q{i}")[0]), F.col(f"q{i}")[1]).alias(f"c{i}") for i in n)).drop(*(f"q{i}" for i in n))
    # least and greatest pass over nulls, which a null score must not
    clipped = clipped.withColumns({f"c{i}": F.when(F.col(f"g{i}").isNotNull(), F.col(f"c{i}")) for i in n})
    points = clipped.groupBy(group).agg(*(f(f"c{i}").alias(f"{name}{i}") for i in n for name, f in (("lo", F.min), ("hi", F.max))), *(F.sqrt(F.sum(F.col(f"c{i}") ** 2)).alias(f"norm{i}") for i in n))

    def weighted(i: int, x: Column) -> Column:
        w = scores[i].weight
        return F.coalesce(F.col(f"w_{w}"), F.lit(0.0)) * x if isinstance(w, str) else F.lit(float(w)) * x

    def part(i: int, end: str) -> Column:
        d = weighted(i, (F.coalesce(f"c{i}", f"lo{i}") - F.col(f"{end}{i}")) / F.when(F.col(f"norm{i}") > 0, F.col(f"norm{i}")))
        return F.coalesce(d * d, F.lit(0.0))

    far, near = (F.sqrt(reduce(add, (part(i, end) for i in n))) for end in ("lo", "hi"))
    placed = clipped.join(_small(scratch(points, "points")), group).withColumn("far", far).withColumn("near", near)
    closeness = F.when(F.col("far") + F.col("near") > 0, F.col("far") / (F.col("far") + F.col("near"))).otherwise(0.5)
    placed = placed.select(group, *key, *(f"g{i}" for i in n), closeness.alias("closeness"))
    return ranked(placed, group, key)


def _small(by_group: DataFrame) -> DataFrame:
    """A written table of one row for each group, to be broadcast while there are few groups."""
    return F.broadcast(by_group) if few_rows(by_group, FEW_GROUPS) else by_group


def ranked(rows: DataFrame, group: str, key: list[str]) -> DataFrame:
    """rows with rank by closeness, counted slice by slice: a group is never sorted in one task."""
    rows = rows.withColumn("slice", F.least(F.floor((1 - F.col("closeness")) * SLICES), F.lit(SLICES - 1)))
    sizes = rows.groupBy(group, "slice").agg(F.count("*").alias("size"))
    before = Window.partitionBy(group).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(group, "slice", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy(group, "slice").orderBy(F.desc("closeness"), *key)
    own = rows.withColumn("at", F.row_number().over(inside))
    return own.join(sizes, [group, "slice"]).withColumn("rank", F.col("before") + F.col("at")).drop("slice", "before", "at")


def majority_winner(ranking: DataFrame, group: str, key: list[str], n: int) -> DataFrame:
    """(group, key, rank): the row of each group, if any, that is strictly better than every other row by more than half of its n scores.

    The ranking proposes: the row closest to the ideal point is compared with every row of its group first. Of groups where it
    fails, a tournament in the order of the ranking, in heats of bounded size, leaves the one row that can still be it: whoever beats all
    others is beaten by none, whatever the heats. That row is compared with every row of its group in turn. rank is the winner's by closeness.
    """
    fields = [*key, *(f"g{i}" for i in range(n))]
    worst = F.lit(float("-inf"))

    def beats(x: Column, y: Column) -> Column:
        better = (F.coalesce(x[f"g{i}"], worst) > F.coalesce(y[f"g{i}"], worst) for i in range(n))
        return reduce(add, (b.cast("int") for b in better)) * 2 > n

    def won(rows: DataFrame, by: list[Column | str]) -> DataFrame:
        listed = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("rank", *fields))).alias("r"))
        first = F.reduce("r", F.col("r")[0], lambda acc, x: F.when((x["rank"] == acc["rank"]) | beats(acc, x), acc).when(beats(x, acc), x).otherwise(acc))
        return listed.select(group, first.alias("first")).select(group, "first.*")

    def judged(champions: DataFrame) -> DataFrame:
        """(group, champion, sure): whether the one row of each group beats all others."""
        own = champions.select(group, F.struct("rank", *fields).alias("champion"))
        both = rows.select(group, F.struct(*fields).alias("other")).join(_small(scratch(own, "champions")), group)
        same = reduce(lambda a, b: a & b, (F.col(f"champion.{k}") == F.col(f"other.{k}") for k in key))
        return both.groupBy(group).agg(F.bool_and(same | beats(F.col("champion"), F.col("other"))).alias("sure"), F.first("champion").alias("champion"))

    rows = scratch(ranking.select(group, "rank", *fields), "ranking")
    first = scratch(judged(rows.where("rank = 1")), "first")
    left = rows.join(_small(first.where("not sure").select(group)), group, "left_semi").where("rank > 1")
    left = won(left, [group, F.floor((F.col("rank") - 1) / HEAT).alias("heat")])
    # each round leaves one row of HEAT; three reach 16 million rows of a group, and the last takes what is left of larger ones
    left = won(left, [group, F.floor((F.col("rank") - 1) / HEAT**2).alias("heat")])
    left = won(left, [group])
    winners = first.where("sure").unionByName(judged(left).where("sure"))
    return winners.select(group, *(F.col(f"champion.{k}").alias(k) for k in key), F.col("champion.rank").alias("rank"))
