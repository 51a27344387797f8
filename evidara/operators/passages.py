"""Hits that follow each other in one document as passages: islands, folded scores, documents, the least set of collections."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidara.functions.columns import score_fold

PLACE = ["query_id", "collection", "document_id"]


def ranges(hits: DataFrame, fold: str = "sum") -> DataFrame:
    """(query_id, collection, document_id, name, seq_start, seq_end, spans, hits, score, best_seq, rank).

    A hit continues the one before if it is the next of its document in its collection and that one does not end
    at a heading. Ranges are ordered by score, then the document's name, then their start. Repeated hits count once, with their best score.
    """
    once = hits.groupBy(*PLACE, "seq").agg(
        F.max("score").alias("score"), F.first("name").alias("name"), F.first("end_reason").alias("end_reason"),
        *(F.first(c).alias(c) for c in ("char_start", "char_end", "line_start", "line_end", "page_start", "page_end")),
    )
    w = Window.partitionBy(*PLACE).orderBy("seq")
    goes_on = (F.col("seq") == F.lag("seq").over(w) + 1) & (F.coalesce(F.lag("end_reason").over(w), F.lit("")) != "heading")
    isles = once.withColumn("new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn("isle", F.sum("new").over(w))
    one = isles.groupBy(*PLACE, "isle").agg(
        F.first("name").alias("name"), F.min("seq").alias("seq_start"), F.max("seq").alias("seq_end"),
        F.min("char_start").alias("char_start"), F.max("char_end").alias("char_end"), F.min("line_start").alias("line_start"), F.max("line_end").alias("line_end"),
        F.min("page_start").alias("page_start"), F.max("page_end").alias("page_end"),
        F.count("*").alias("hits"), score_fold(fold, "score").alias("score"), F.max_by("seq", F.struct("score", -F.col("seq"))).alias("best_seq"),
        F.max_by("end_reason", "seq").alias("end_reason"), F.min_by("start_reason", "seq").alias("start_reason") if "start_reason" in once.columns else F.lit(None).cast("string").alias("start_reason"),
    )
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "name", "seq_start", "collection")
    return one.drop("isle").withColumn("rank", F.row_number().over(order))


def rejoined(parts: DataFrame) -> DataFrame:
    """Ranges over the union of parts(query_id, collection, document_id, seq_start, seq_end, alone, owed, aspects, aspect_scores, at).

    Parts that overlap or follow each other become one: alone and owed only if all parts are, aspects each once in the parts' order (at),
    and of each aspect the best score.
    """
    w = Window.partitionBy(*PLACE).orderBy("seq_start", "seq_end")
    so_far = F.max("seq_end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    isles = parts.withColumn("new", F.when(F.col("seq_start") <= so_far + 1, 0).otherwise(1)).withColumn("isle", F.sum("new").over(w))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("at", "aspects"))), lambda x: x["aspects"])
    one = isles.groupBy(*PLACE, "isle").agg(
        F.min("seq_start").alias("seq_start"), F.max("seq_end").alias("seq_end"), F.bool_and("alone").alias("alone"), F.bool_and("owed").alias("owed"),
        F.array_distinct(F.flatten(listed)).alias("aspects"),
    )
    best = isles.select(*PLACE, "isle", F.explode("aspect_scores").alias("aspect", "score")).groupBy(*PLACE, "isle", "aspect").agg(F.max("score").alias("score"))
    maps = best.groupBy(*PLACE, "isle").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("aspect", "score")))).alias("aspect_scores"))
    return one.join(maps, [*PLACE, "isle"], "left").drop("isle")


def top_documents(hits: DataFrame, fold: str = "sum", k: int = 10) -> DataFrame:
    """(query_id, document_id, name, score, hits, rank): hits folded per document over all collections, each chunk once."""
    once = hits.groupBy("query_id", "document_id", "seq").agg(F.max("score").alias("score"), F.first("name").alias("name"))
    by = once.groupBy("query_id", "document_id").agg(F.first("name").alias("name"), score_fold(fold, "score").alias("score"), F.count("*").alias("hits"))
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "name", "document_id")
    return by.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def min_cover(members: DataFrame) -> DataFrame:
    """(query_id, step, collection, documents): collections chosen greedily until all documents of a query are covered.

    members(query_id, collection, document_id), at most as many documents as an answer lists. Ties go to the first name.
    """

    def choose(own: pd.DataFrame) -> pd.DataFrame:
        held = {c: set(d) for c, d in own.groupby("collection").document_id}
        left, out = set(own.document_id), []
        while left:
            name = min(held, key=lambda c: (-len(held[c] & left), c))
            out.append((own.query_id.iloc[0], len(out) + 1, name, len(held[name] & left)))
            left -= held[name]
        return pd.DataFrame(out, columns=["query_id", "step", "collection", "documents"])

    kind = members.schema["query_id"].dataType.simpleString()
    return members.select("query_id", "collection", "document_id").dropna().distinct().groupBy("query_id").applyInPandas(choose, f"query_id {kind}, step int, collection string, documents int")


def quotes(spans: DataFrame, documents: DataFrame, text: str = "text") -> DataFrame:
    """spans with the text that they hold of their document, page markers stripped, trimmed."""
    own = documents.select("document_id", F.col(text).alias("_text"))
    joined = spans.join(own, "document_id")
    cut = F.substring(F.col("_text"), F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))
    return joined.withColumn("quote", F.trim(stripped(cut))).drop("_text")


def stripped(text: Column) -> Column:
    """A text without page markers: blanks around one shrink to the larger of the two runs."""
    run = r"\n{2,}\s*(?:<!--\s*page \d+[^>]*-->\s*)+|\s*(?:<!--\s*page \d+[^>]*-->\s*)+\n{2,}"
    return F.regexp_replace(F.regexp_replace(text, run, "\n\n"), r"[ \t]*\n?(?:<!--\s*page \d+[^>]*-->[ \t]*\n?)+", "\n")
