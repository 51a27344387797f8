"""Sections from heading paths, results grouped by section, excerpts within a budget, words that no answer holds."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidara.functions.columns import question_terms, words

DOC = ["collection", "document_id"]
#: Characters that an excerpt, a passage and a label cost beside their text.
EXCERPT_COST, PASSAGE_COST, LABEL_COST = 600, 300, 4


def runs(chunks: DataFrame) -> DataFrame:
    """(collection, document_id, depth, path, seq_start, seq_end, char_start, char_end, position): every run of chunks under one heading path.

    Depth 0 is the whole document. Position numbers a document's runs from 0 by first chunk and depth. Repeated chunks count once.
    """
    own = chunks.groupBy(*DOC, "seq").agg(F.first("headings").alias("headings"), F.min("char_start").alias("char_start"), F.max("char_end").alias("char_end"))
    w = Window.partitionBy(*DOC).orderBy("seq")
    own = own.withColumn("at", F.row_number().over(w))
    each = own.withColumn("depth", F.explode(F.sequence(F.lit(0), F.size("headings")))).withColumn("path", F.slice("headings", F.lit(1), F.col("depth")))
    by_depth = Window.partitionBy(*DOC, "depth").orderBy("seq")
    new = (F.lag("path").over(by_depth) == F.col("path")) & (F.lag("at").over(by_depth) == F.col("at") - 1)
    isles = each.withColumn("new", F.when(F.coalesce(new, F.lit(False)), 0).otherwise(1)).withColumn("isle", F.sum("new").over(by_depth))
    one = isles.groupBy(*DOC, "depth", "isle").agg(
        F.first("path").alias("path"), F.min("seq").alias("seq_start"), F.max("seq").alias("seq_end"), F.min("char_start").alias("char_start"), F.max("char_end").alias("char_end")
    )
    order = Window.partitionBy(*DOC).orderBy("seq_start", "depth")
    return one.drop("isle").withColumn("position", F.row_number().over(order) - 1)


def parents(sections: DataFrame) -> DataFrame:
    """sections with parent, the position of the run one level up that holds it; null for the whole document."""
    up = sections.select(*DOC, (F.col("depth") + 1).alias("depth"), F.col("seq_start").alias("from_"), F.col("seq_end").alias("to_"), F.col("position").alias("parent"))
    # runs of one depth do not overlap, so that at most one holds it
    joined = sections.join(up, [*DOC, "depth"], "left").where("parent is null or (seq_start >= from_ and seq_end <= to_)")
    return joined.drop("from_", "to_")


def section_of(hits: DataFrame, sections: DataFrame, longest: int, scoped: DataFrame | None = None) -> DataFrame:
    """hits with the position, path and span of their section: the largest run above their own headings' that is neither the whole document nor longer
    than `longest` characters, else the run of their own headings. Only the runs of documents that were hit are met.

    A run that spans every chunk of its document is no section, whatever its heading, unless scoped(collection, document_id, position) names it as
    one that a search keeps to.
    """
    whole = Window.partitionBy(*DOC)
    every = (F.col("seq_start") == F.min("seq_start").over(whole)) & (F.col("seq_end") == F.max("seq_end").over(whole))
    own = sections.select(*DOC, "depth", "path", F.col("seq_start").alias("s_start"), F.col("seq_end").alias("s_end"), F.col("char_start").alias("s_char_start"), F.col("char_end").alias("s_char_end"), "position", every.alias("_whole"))
    if scoped is not None:
        own = own.join(scoped.select(*DOC, "position", F.lit(True).alias("_kept")).distinct(), [*DOC, "position"], "left").withColumn("_whole", F.col("_whole") & F.col("_kept").isNull()).drop("_kept")
    met = hits.join(own, DOC).where("seq_start between s_start and s_end")
    key = Window.partitionBy(*[c for c in hits.columns if c in ("query_id", *DOC, "seq_start")])
    fits = (F.col("s_char_end") - F.col("s_char_start") <= longest) & (F.col("depth") > 0) & ~F.col("_whole") & (F.col("depth") < F.max("depth").over(key))
    best = key.orderBy(F.when(F.col("_fits"), 0).otherwise(1), F.when(F.col("_fits"), F.col("depth")).otherwise(-F.col("depth")))
    return met.withColumn("_fits", fits).withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n", "_fits", "_whole")


def grouped(ranges: DataFrame, limit: int) -> DataFrame:
    """(query_id, collection, document_id, position, rank, score, ranges, standing): ranges of one section, by their best rank; groups all of
    whose ranges are alone are dropped, and the first `limit` kept."""
    by = ranges.groupBy("query_id", *DOC, "position").agg(F.min("rank").alias("best"), F.max("score").alias("score"), F.count("*").alias("ranges"), F.sum((~F.col("alone")).cast("int")).alias("standing"))
    w = Window.partitionBy("query_id").orderBy("best", *DOC, "position")
    return by.where("standing > 0").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).drop("best")


def passage_cost(chars: Column, tag_chars: Column | None = None, also_in: Column | None = None) -> Column:
    cost = F.lit(PASSAGE_COST) + chars + (tag_chars if tag_chars is not None else F.lit(0))
    return cost + F.coalesce(F.length(F.to_json(also_in)), F.lit(0)) if also_in is not None else cost


def excerpt_cost(labels: Column, passages: Column) -> Column:
    """The cost of an excerpt: its own, its labels and its passages' costs (an array)."""
    return F.lit(EXCERPT_COST) + F.aggregate(labels, F.lit(0), lambda a, x: a + F.length(x) + LABEL_COST) + F.aggregate(passages, F.lit(0).cast("long"), lambda a, x: a + x)


def documents_needed(ranges: DataFrame, limit: int) -> DataFrame:
    """(query_id, collection, document_id): the documents whose runs the first `limit` sections can open in: those of all ranges, in
    order of rank, up to the one where the `limit`-th document with a range that stands alone turns up."""
    place = F.struct(*DOC)
    w = Window.partitionBy("query_id").orderBy("rank")
    first = F.row_number().over(Window.partitionBy("query_id", *DOC).orderBy("alone", "rank")) == 1
    opened = ranges.withColumn("_new", (first & ~F.col("alone")).cast("int"))
    seen = opened.withColumn("_seen", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    return seen.where((F.coalesce("_seen", F.lit(0)) < limit)).select("query_id", place.alias("_p")).distinct().select("query_id", "_p.*")


def within_budget(passages: DataFrame, budget: int) -> DataFrame:
    """passages with kept: those that fit, each whole; what does not fit is skipped and the next is tried.

    First the one marked first, if any; then each group's best that is not alone, the first group's always; then the
    others of groups that have one already, by rank. passages(query_id, group_rank, rank, cost, header_cost, alone, first): header_cost is
    paid with a group's first passage; alone and first may be left out. A query's passages are at most as many as were scanned.
    """
    def flag(name: str) -> Column:
        return (F.coalesce(F.col(name), F.lit(False)) if name in passages.columns else F.lit(False)).alias(name)

    listed = F.sort_array(F.collect_list(F.struct("group_rank", "rank", "cost", "header_cost", flag("alone"), flag("first"))))

    def choose(it):
        for own in it:
            rows = []
            for q, ps in zip(own.query_id, own.ps):
                kept = fitting(list(ps), budget)
                rows += [(q, p["group_rank"], p["rank"], n in kept) for n, p in enumerate(ps)]
            yield pd.DataFrame(rows, columns=["query_id", "group_rank", "rank", "kept"])

    return passages.groupBy("query_id").agg(listed.alias("ps")).mapInPandas(choose, "query_id long, group_rank int, rank int, kept boolean")


def fitting(passages: list, budget: int) -> set[int]:
    """Which of a query's passages, in the order of group and rank, are kept."""
    best: dict = {}
    for n, p in enumerate(passages):
        if not p["alone"]:
            best.setdefault(p["group_rank"], n)
    lead = min(best) if best else None
    turns = [(n, False) for n, p in enumerate(passages) if p["first"]]
    turns += [(n, g == lead) for g, n in sorted(best.items())]
    turns += [(n, None) for n, p in sorted(enumerate(passages), key=lambda x: x[1]["rank"])]
    kept: set[int] = set()
    opened: set = set()
    spent = 0
    for n, always in turns:
        group = passages[n]["group_rank"]
        if n in kept or (always is None and group not in opened):
            continue
        cost = passages[n]["cost"] + (0 if group in opened else passages[n]["header_cost"])
        if always or spent + cost <= budget:
            kept.add(n)
            opened.add(group)
            spent += cost
    return kept


def excerpts(passages: DataFrame, under: str | None = None) -> DataFrame:
    """(query_id, collection, document_id, position, text): the passages of a section in document order, headings that open below the section's
    own path (the column `under`) written out, gaps marked. passages(query_id, collection, document_id, position, seq_start, seq_end, headings, quote)."""
    key = ["query_id", *DOC, "position"]
    w = Window.partitionBy(*key).orderBy("seq_start")
    before = F.coalesce(F.lag("headings").over(w), F.col(under) if under else F.array().cast("array<string>"))
    gap = F.col("seq_start") > F.lag("seq_end").over(w) + 1
    rows = passages.withColumns({"_before": before, "_gap": F.coalesce(gap, F.lit(False))})
    # the common prefix is as long as there are equal headings from the top without a break
    same = F.aggregate(F.arrays_zip(F.col("headings").alias("h"), F.col("_before").alias("b")), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
                       lambda a, x: F.struct((a["n"] + F.when(a["on"] & x["h"].eqNullSafe(x["b"]), 1).otherwise(0)).alias("n"), (a["on"] & x["h"].eqNullSafe(x["b"])).alias("on")), lambda a: a["n"])
    rows = rows.withColumn("_same", F.greatest(same, F.size(under)) if under else same)
    opened = F.transform(F.expr("slice(headings, _same + 1, greatest(size(headings) - _same, 0))"), lambda h, i: F.concat(F.repeat(F.lit("#"), (F.col("_same") + i + 1).cast("int")), F.lit(" "), h))
    block = F.concat(F.when(F.col("_gap"), F.lit("[…]\n\n")).otherwise(""), F.array_join(F.concat(opened, F.array("quote")), "\n\n"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq_start", block.alias("block")))), lambda x: x["block"]), "\n\n")
    return rows.groupBy(*key).agg(text.alias("text"))


def missing_terms(queries: DataFrame, texts: DataFrame, stemmed: bool = True, question: str = "question") -> DataFrame:
    """(query_id, term): the terms of a question that no text kept for it holds, by stem. texts(query_id, text).

    A stem starts with the letter of its word, so that only words that start as a term of their question does are stemmed.
    """
    from evidara.functions.stem import stems

    asked = queries.select("query_id", F.explode(question_terms(question)).alias("term")).distinct()
    held = texts.select("query_id", F.explode(F.array_distinct(words("text"))).alias("word")).distinct()
    if not stemmed:
        return asked.join(held.withColumnRenamed("word", "term"), ["query_id", "term"], "left_anti")
    first = F.substring("term", 1, 1)
    near = held.withColumn("head", F.substring("word", 1, 1)).join(asked.select("query_id", first.alias("head")).distinct(), ["query_id", "head"])
    told = near.select("query_id", stems(F.array("word"))[0].alias("stem")).distinct()
    return asked.withColumn("stem", stems(F.array("term"))[0]).join(told, ["query_id", "stem"], "left_anti").select("query_id", "term")
