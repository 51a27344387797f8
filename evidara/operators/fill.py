"""Short passages: which are fragments, what the chunks around them are worth, how far they grow, and what fills the room that is left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidara.functions.columns import question_terms, words

LEAST_WORDS = 7
#: What a passage must be worth by an absolute scale.
WORTH = 0.18


def fragment(chars: Column, n_words: Column, start_reason: Column, end_reason: Column, min_chars: int) -> Column:
    """Whether a passage is a fragment: short in characters or words, and not closed by headings or the document's ends on both sides."""
    if not min_chars:
        return F.lit(False)
    closed = start_reason.isin("heading", "edge", "document") & end_reason.isin("heading", "edge", "document")
    return ((chars < min_chars) | (n_words < LEAST_WORDS)) & ~F.coalesce(closed, F.lit(False))


def neighbours(ranges: DataFrame, grow: int) -> DataFrame:
    """(query_id, collection, document_id, seq_start, seq, side, steps): the chunks asked for around each range, at most `grow` on each side that no heading closes."""
    key = ["query_id", "collection", "document_id", "seq_start"]
    steps = F.explode(F.sequence(F.lit(1), F.lit(grow)))
    before = ranges.where(F.coalesce(F.col("start_reason"), F.lit("")) != "heading").select(*key, F.lit("before").alias("side"), steps.alias("steps")).withColumn("seq", F.col("seq_start") - F.col("steps"))
    after = ranges.where(F.coalesce(F.col("end_reason"), F.lit("")) != "heading").select(*key, "seq_end", F.lit("after").alias("side"), steps.alias("steps")).withColumn("seq", F.col("seq_end") + F.col("steps")).drop("seq_end")
    return before.where("seq >= 1").unionByName(after)


def overlap(question: Column | str, text: Column | str) -> Column:
    """The share of a question's terms that a text holds, 0 for a question without terms."""
    t = question_terms(question)
    return F.when(F.size(t) > 0, F.size(F.array_intersect(t, words(text))) / F.size(t)).otherwise(0.0)


def values(rows: DataFrame, score: str, floor: float = 0.0, bias: float = 0.0) -> DataFrame:
    """rows with value: where the score lies from the query's median (0) to its best (1), clipped to -1 and 1.

    Where the best is the median, 1 for scores of at least the floor, else -1. The median is exact: what is scanned of a query is bounded.
    """
    w = Window.partitionBy("query_id")
    rows = rows.withColumns({"_mid": F.median(score).over(w), "_top": F.max(score).over(w)})
    scaled = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col(score) - F.col("_mid")) / (F.col("_top") - F.col("_mid"))))
    value = F.when(F.col("_top") > F.col("_mid"), scaled).when(F.col(score) >= floor, 1.0).otherwise(-1.0)
    return rows.withColumn("value", value + bias).drop("_mid", "_top")


def best_runs(walk: DataFrame) -> DataFrame:
    """(query_id, collection, document_id, seq_start, side, steps, total): how far to grow on each side, as the shortest run of the greatest positive sum.

    walk has neighbours with value and continues: it ends at the first that is missing or does not continue.
    """
    key = ["query_id", "collection", "document_id", "seq_start", "side"]
    out = Window.partitionBy(*key).orderBy("steps")
    rows = walk.withColumn("open", F.min(F.col("continues").cast("int")).over(out)).withColumn("there", F.row_number().over(out) == F.col("steps"))
    sums = rows.where("open = 1 and there").withColumn("total", F.round(F.sum("value").over(out), 9))
    return sums.groupBy(*key).agg(F.max_by("steps", F.struct("total", -F.col("steps"))).alias("steps"), F.max("total").alias("total")).where("total > 0")


def valued(candidates: DataFrame, reference: DataFrame, score: str, bias: float = 0.0) -> DataFrame:
    """candidates with value: where their score lies from the middle of the query's reference rows (0) to the best of them (1), within -1 and 1."""
    ends = reference.groupBy("query_id").agg(F.median(score).alias("_mid"), F.max(score).alias("_top"))
    rows = candidates.join(ends, "query_id")
    scaled = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col(score) - F.col("_mid")) / (F.col("_top") - F.col("_mid"))))
    value = F.when(F.col("_top") > F.col("_mid"), scaled).when(F.col(score) >= F.col("_mid"), 1.0).otherwise(-1.0)
    return rows.withColumn("value", value + bias).drop("_mid", "_top")
