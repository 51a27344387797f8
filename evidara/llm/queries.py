"""The training-data queries: each takes (spark, sf_dir) and reads whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidara.llm import leaks, mixing, neardup, ocr, ranking, spam, spans, splitting, terms, vectors
from evidara.session import load

Query = Callable[[SparkSession, str], DataFrame]

#: The statement of problem 2: triples of words, at least 0.6 of them common.
TRIPLES = neardup.SketchSettings(width=3, threshold=0.6)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = splitting.SplitSettings(limit=4000, overlap=200, with_text=False)
    pieces = splitting.split_texts(load(spark, sf_dir, "documents"), "doc_id", "text", load(spark, sf_dir, "headings"), "doc_id", "byte_offset", cut)
    return splitting.oversized(pieces).withColumnRenamed("id", "doc_id")


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every section in pieces of at most 512 tokens, 64 of them repeated from the piece before."""
    cut = splitting.SplitSettings(limit=512, overlap=64, unit="tokens")
    pieces = splitting.split_texts(load(spark, sf_dir, "documents"), "doc_id", "text", load(spark, sf_dir, "headings"), "doc_id", "byte_offset", cut)
    return pieces.withColumnRenamed("id", "doc_id")


def p1_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run of chunks that a result quotes, in pieces of at most 1,200 characters."""
    runs = splitting.quoted_runs(*(load(spark, sf_dir, t) for t in ("search_results", "documents", "chunks")))
    return splitting.split_texts(runs, "run", "text", settings=splitting.SplitSettings(limit=1200, overlap=120)).withColumnRenamed("id", "run")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = neardup.near_duplicate_pairs(load(spark, sf_dir, "documents"), "doc_id", "text", TRIPLES)
    return pairs.select("id_a", "id_b").toDF("doc_id_a", "doc_id_b")


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = neardup.near_duplicate_groups(load(spark, sf_dir, "documents"), "doc_id", "text", TRIPLES)
    return groups.withColumnRenamed("id", "doc_id")


#: The scores of candidates, with more as better but for distances.
THREE = [("bm25_score", True, "bm25_weight"), ("vector_distance", False, "vector_weight"), ("rerank_score", True, 1.0)]


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = ["document_id", "seq"]
    order = ranking.ideal_points(load(spark, sf_dir, "candidates"), "search_id", key, [ranking.Score(c, more) for c, more, _ in THREE])
    return ranking.majority_winner(order, "search_id", key, 3).select("search_id", *key)


def p3_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each search's candidates under its weights: those of its collection if it ranked one only, else the user's own."""
    candidates, settings = load(spark, sf_dir, "candidates"), load(spark, sf_dir, "search_settings")
    fields = ("bm25_weight", "vector_weight")
    # search_settings is of a fixed size
    user = settings.where("collection is null").agg(*(F.max(f).alias(f"user_{f}") for f in fields))
    own = settings.where("collection is not null").groupBy("collection").agg(*(F.max(f).alias(f) for f in fields))
    one = candidates.groupBy("search_id").agg(F.when(F.count_distinct("collection") == 1, F.max("collection")).alias("collection"))
    weights = one.join(own, "collection", "left").crossJoin(F.broadcast(user)).select("search_id", *(F.coalesce(f, f"user_{f}", F.lit(0.5)).alias(f) for f in fields))
    rows = candidates.drop(*fields).join(weights, "search_id")
    order = ranking.ideal_points(rows, "search_id", ["document_id", "seq"], [ranking.Score(*x) for x in THREE])
    return order.select("search_id", "document_id", "seq", "rank", F.round("closeness", 6).alias("closeness"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans.shared_spans(load(spark, sf_dir, "documents"), "doc_id", "text", least=300)
    return found.select(F.col("id").alias("doc_id"), "span_start", "span_end")


def p4_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each document's text is shared elsewhere; 0 where nothing is."""
    docs = load(spark, sf_dir, "documents")
    found = spans.shared_spans(docs, "doc_id", "text", least=300).groupBy("id").agg(F.count("*").alias("spans"), F.max("share").alias("share"))
    ids = docs.select(F.col("doc_id").alias("id")).distinct()
    return ids.join(found, "id", "left").select(F.col("id").alias("doc_id"), F.coalesce("spans", F.lit(0)).alias("spans"), F.round(F.coalesce("share", F.lit(0.0)), 6).alias("share"))


def p4_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs that are near copies of others, in clusters, and which of them to remove."""
    return spans.paragraph_clusters(load(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


#: Documents with pages read by OCR.
SCANNED = "pages_ocr > 0"


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ocr.findings(load(spark, sf_dir, "documents"), "doc_id", "text", SCANNED)
    return found.select(F.col("id").alias("doc_id"), F.col("line").alias("line_no"), "kind", "word").distinct()


def p5_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scanned documents as continuous paragraphs of right words."""
    return ocr.repaired(load(spark, sf_dir, "documents"), "doc_id", "text", SCANNED).withColumnRenamed("id", "doc_id")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.close_pairs(load(spark, sf_dir, "chunks"), "id", "vector", least=0.95, k=10).select("id_a", "id_b")


def p6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten chunks most similar to every chunk whose id's checksum is divisible by 100, among all chunks."""
    chunks = load(spark, sf_dir, "chunks")
    found = vectors.search(chunks, "id", "vector", chunks.where(F.crc32("id") % 100 == 0), k=10)
    return found.select("query_id", "id", "rank", F.round("cosine", 6).alias("cosine"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = terms.term_counts(load(spark, sf_dir, "documents"), "doc_id", ["text", "description"], shortest=5, least=3, most=6)
    return counts.select(F.col("id").alias("doc_id"), "term")


def p7_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most distinctive terms of each document."""
    scores = terms.term_scores(load(spark, sf_dir, "documents"), "doc_id", ["text", "description"], shortest=5)
    return terms.top_terms(scores, 10).select(F.col("id").alias("doc_id"), "rank", "term", "n", "df", F.round("score", 6).alias("score"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks.leaks(load(spark, sf_dir, "documents"), "doc_id", "text", load(spark, sf_dir, "eval_items"), "item_id", "passage", width=10)
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"))


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items that leaked: into how many documents, in how many of their windows."""
    found = leaks.leaks(load(spark, sf_dir, "documents"), "doc_id", "text", load(spark, sf_dir, "eval_items"), "item_id", "passage", width=10)
    return leaks.by_item(found).withColumnsRenamed({"item": "item_id", "texts": "documents"})


def p8_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with 30 words that are much alike any 30 words of an item: fingerprints within 6 bits, 0.8 of the weight of word pairs in common."""
    found = leaks.leaks(load(spark, sf_dir, "documents"), "doc_id", "text", load(spark, sf_dir, "eval_items"), "item_id", "passage", width=30, radius=6, similarity=0.8)
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "windows")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mixed(load(spark, sf_dir, "documents"), "doc_id", "source", "text", load(spark, sf_dir, "mix_targets"), size="words")
    return mix.report.where("not reachable").select("source")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets and reached shares, in tokens."""
    mix = mixing.mixed(load(spark, sf_dir, "documents"), "doc_id", "source", "text", load(spark, sf_dir, "mix_targets"), size="tokens")
    return mix.report


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is drawn, and for which source."""
    mix = mixing.mixed(load(spark, sf_dir, "documents"), "doc_id", "source", "text", load(spark, sf_dir, "mix_targets"), size="tokens")
    return mix.documents.withColumnRenamed("id", "doc_id")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spam.stuffed(load(spark, sf_dir, "documents"), "doc_id", "text")
    return found.where(F.col("share") > 0.5).select(F.col("id").alias("doc_id"))


def p10_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam.stuffed(load(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def queries() -> dict[str, Query]:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1:2].isdigit()}
