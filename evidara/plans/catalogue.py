"""The queries over the reference data model. Each takes (spark, sf_dir), reads whole tables and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidara.functions import columns as C
from evidara.functions import ids
from evidara.operators import calibrate, chunking, collapse, descriptors, extras, fill, gaps, library, log, mapping, metadata, passages, retrieval, sections
from evidara.session import load, scratch
from evidara.settings import ChunkSettings, resolved

Query = Callable[[SparkSession, str], DataFrame]
KEY = ["collection", "document_id", "seq"]
SPAN = ["document_id", "char_start", "char_end"]
REGISTRY: dict[str, Query] = {}


def query(f: Query) -> Query:
    REGISTRY[f.__name__] = f
    return f


# --- inputs


def corpus(spark: SparkSession, d: str) -> DataFrame:
    """Chunks, each once."""
    return load(spark, d, "chunks").where("text is not null").dropDuplicates(KEY)


def asked(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "eval_items").where("question is not null").select(F.col("item_id").alias("query_id"), F.concat_ws(" ", C.question_terms("question")).alias("question"))


def asked_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Logged questions that kept their vector."""
    rows = load(spark, d, "search_questions").where("query_vector is not null and trim(question) <> ''")
    return rows.select(F.col("id").alias("query_id"), F.concat_ws(" ", C.question_terms("question")).alias("question"), F.col("query_vector").alias("vector"))


def names(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").groupBy("document_id").agg(F.min("name").alias("name"))


def hits(spark: SparkSession, d: str, k: int = 50) -> DataFrame:
    """The best k chunks of each question by full text, with what passages need."""
    rows = corpus(spark, d)
    best = fulltext(spark, d).search(asked(spark, d), k)
    own = rows.select(*KEY, "char_start", "char_end", "line_start", "line_end", "page_start", "page_end", "start_reason", "end_reason", "headings", "text", "framed", "vector")
    return best.join(own, KEY).join(names(spark, d), "document_id", "left").withColumn("name", F.coalesce("name", "document_id"))


#: Stored full-text indexes by application, folder, and what is indexed.
_INDEXES: dict[tuple, retrieval.FullText] = {}


def fulltext(spark: SparkSession, d: str, per_collection: bool = False) -> retrieval.FullText:
    """The stored index of a folder's chunks; built once in an application, as the tables of a folder stay as they are."""
    name = (spark.sparkContext.applicationId, d, per_collection)
    if name not in _INDEXES:
        _INDEXES[name] = retrieval.FullText(corpus(spark, d), ["document_id", "seq"], "framed", ["collection"]) if per_collection else retrieval.FullText(corpus(spark, d), KEY, "framed")
    return _INDEXES[name]


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


# --- retrieval


@query
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fulltext(spark, d).search(asked(spark, d), 25), "score")


@query
def bm25_per_collection(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fulltext(spark, d, per_collection=True).search(asked(spark, d), 5), "score")


@query
def postings_stats(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.postings(corpus(spark, d), KEY, "framed").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("uses"))


@query
def knn_l2_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "embeddings")
    queries = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    found = retrieval.nearest(queries, rows, "vec_id", "embedding", 10)
    return rounded(found.withColumn("score", C.nearness("distance")), "distance", "score")


def _halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows, queries = corpus(spark, d), asked_vectors(spark, d)
    # one document may lie in two collections under one id
    lexical = retrieval.bm25(queries, rows.groupBy("id").agg(F.min("framed").alias("framed")), ["id"], "framed", 50)
    usable = rows.where("vector is not null").groupBy("id").agg(F.max("vector").alias("vector"))
    return retrieval.nearest(queries, usable, "id", "vector", 50), lexical


@query
def rrf_hybrid(spark: SparkSession, d: str) -> DataFrame:
    fused = retrieval.rrf(list(_halves(spark, d)), ["id"], 60)
    return rounded(fused.where("rank <= 25"), "score")


@query
def linear_hybrid(spark: SparkSession, d: str) -> DataFrame:
    vector, lexical = _halves(spark, d)
    return rounded(retrieval.linear(vector, lexical, ["id"], 0.7).where("rank <= 25"), "score")


@query
def ranked_halves_multi_collection(spark: SparkSession, d: str) -> DataFrame:
    rows = corpus(spark, d)
    per = fulltext(spark, d, per_collection=True).search(asked(spark, d), 10).drop("rank")
    spans = per.join(rows.select(*KEY, "char_start", "char_end"), KEY)
    half = retrieval.ranked_halves(spans.withColumn("score", F.round("score", 6)), SPAN, "score", True, 25)
    return half.select("query_id", "rank", "collection", *SPAN, "score")


@query
def first_per_span(spark: SparkSession, d: str) -> DataFrame:
    rows = corpus(spark, d).withColumn("query_id", F.lit(0))
    return retrieval.first_per(rows, SPAN, "collection", "seq").select(*SPAN, "collection", "seq")


@query
def global_text_page(spark: SparkSession, d: str) -> DataFrame:
    rows = corpus(spark, d)
    found = fulltext(spark, d, per_collection=True).search(asked(spark, d), 60).drop("rank")
    found = found.join(rows.select(*KEY, "char_start", "char_end"), KEY)
    page = retrieval.text_page(found.withColumn("score", F.round("score", 6)), SPAN, 20, 10)
    return page.select("query_id", "rank", "collection", *SPAN, "score")


@query
def leaving_anti(spark: SparkSession, d: str) -> DataFrame:
    gone = load(spark, d, "documents").where("status <> 'imported'")
    rows = retrieval.leaving_out(corpus(spark, d), gone)
    return rounded(retrieval.bm25(asked(spark, d), rows, KEY, "framed", 10), "score")


@query
def scoped_sections(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of the sections that hold each document's second chunk."""
    rows = corpus(spark, d)
    wanted = rows.where("seq = 2").select("collection", "document_id", F.col("section_ids").alias("wanted"))
    return rows.join(wanted, ["collection", "document_id"]).where(F.arrays_overlap("section_ids", "wanted")).select(*KEY)


@query
def citations(spark: SparkSession, d: str) -> DataFrame:
    rows = corpus(spark, d).join(names(spark, d), "document_id", "left")
    name = F.coalesce("name", "document_id")
    cited = C.citation(name, F.col("page_start"), F.col("page_end"), F.col("line_start"), F.col("line_end"))
    return rows.select(*KEY, cited.alias("citation"), C.header("headings").alias("header"))


@query
def row_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "candidates").distinct()
    relevance = C.sigmoid("rerank_score")
    return rows.select("search_id", "document_id", "seq", F.round(C.row_score(relevance, "bm25_score", "vector_distance"), 6).alias("score"), F.round(C.logit(relevance), 4).alias("back"))


@query
def reranked(spark: SparkSession, d: str) -> DataFrame:
    pool = hits(spark, d, 50).join(load(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), F.col("question").alias("asked")), "query_id")
    return retrieval.rerank(pool, "asked", "framed", 0.05, 25, KEY).select("query_id", *KEY, F.round("score", 6).alias("score"), "rank")


# --- passages


def _ranges(fold: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        found = passages.ranges(hits(spark, d), fold)
        return rounded(found.select("query_id", "rank", "collection", "document_id", "name", "seq_start", "seq_end", "char_start", "char_end", "hits", "best_seq", "score"), "score")

    return run


for _fold in ("sum", "max", "harmonic"):
    REGISTRY[f"passage_ranges_{_fold}"] = _ranges(_fold)


@query
def top_documents(spark: SparkSession, d: str) -> DataFrame:
    return rounded(passages.top_documents(hits(spark, d)), "score")


@query
def min_cover(spark: SparkSession, d: str) -> DataFrame:
    best = passages.top_documents(hits(spark, d)).select("query_id", "document_id")
    held = load(spark, d, "chunks").select("collection", "document_id").distinct()
    return passages.min_cover(best.join(held, "document_id"))


@query
def passage_quotes(spark: SparkSession, d: str) -> DataFrame:
    spans = passages.ranges(hits(spark, d, 10)).select("query_id", "collection", "document_id", "char_start", "char_end")
    return passages.quotes(spans, load(spark, d, "documents"))


@query
def rejoined_ranges(spark: SparkSession, d: str) -> DataFrame:
    parts = load(spark, d, "search_results").where("parent is null").dropDuplicates(["search_id", "position"])
    parts = parts.select(F.col("search_id").alias("query_id"), "collection", F.col("document").alias("document_id"), "seq_start", "seq_end", (F.col("score") < 0.1).alias("alone"), F.lit(False).alias("owed"),
                         F.array(F.col("header")).alias("aspects"), F.create_map(F.col("header"), F.col("score")).alias("aspect_scores"), F.col("position").alias("at"))
    found = passages.rejoined(parts.where("header is not null"))
    return found.select("query_id", "collection", "document_id", "seq_start", "seq_end", "alone", "owed", F.size("aspects").alias("n_aspects"), F.round(F.array_max(F.map_values("aspect_scores")), 6).alias("best"))


# --- short passages and filling


@query
def fragments(spark: SparkSession, d: str) -> DataFrame:
    rows = corpus(spark, d)
    short = fill.fragment(F.col("char_end") - F.col("char_start"), F.size(C.words("text")), F.col("start_reason"), F.col("end_reason"), 300)
    return rows.select(*KEY, short.alias("fragment"))


@query
def neighbour_demand(spark: SparkSession, d: str) -> DataFrame:
    found = passages.ranges(hits(spark, d, 10))
    return fill.neighbours(found, 3)


@query
def fill_value(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "candidates").where("bm25_score is not null").distinct().withColumnRenamed("search_id", "query_id")
    return rounded(fill.values(rows, "bm25_score", floor=1.0).select("query_id", "document_id", "seq", "bm25_score", "value"), "bm25_score", "value")


@query
def term_overlap(spark: SparkSession, d: str) -> DataFrame:
    pool = hits(spark, d, 25).join(load(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), F.col("question").alias("asked")), "query_id")
    return pool.select("query_id", *KEY, F.round(fill.overlap("asked", "text"), 6).alias("overlap"))


def _valued(spark: SparkSession, d: str) -> DataFrame:
    """What lies around each passage, worth what its share of the question's words says."""
    questions = load(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), F.col("question").alias("asked"))
    own = hits(spark, d, 10)
    near = fill.neighbours(passages.ranges(own), 3).join(corpus(spark, d).select(*KEY, "text", "end_reason"), KEY).join(questions, "query_id")
    scored = near.withColumns({"overlap": fill.overlap("asked", "text"), "continues": F.coalesce("end_reason", F.lit("")) != "heading"}).drop("text", "asked", "end_reason")
    return fill.valued(scored, own.join(questions, "query_id").select("query_id", fill.overlap("asked", "text").alias("overlap")), "overlap")


@query
def neighbour_values(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_valued(spark, d).select("query_id", *KEY, "seq_start", "side", "steps", "value"), "value")


@query
def best_run(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fill.best_runs(_valued(spark, d)), "total")


# --- folding


@query
def exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return collapse.exact_duplicates(load(spark, d, "documents"), "doc_id", "text")


def _items(spark: SparkSession, d: str, k: int = 15) -> DataFrame:
    rows = hits(spark, d, k)
    return rows.select("query_id", F.col("rank").cast("long").alias("item"), "rank", "score", F.array("text").alias("texts"), F.array(F.struct("text", "vector")).alias("chunks"), *KEY, F.col("seq").alias("seq_start"), F.col("seq").alias("seq_end"), "char_start", "char_end", "vector", F.lit(False).alias("alone"))


@query
def shingle_containment(spark: SparkSession, d: str) -> DataFrame:
    return rounded(collapse.shingle_overlaps(_items(spark, d)), "into", "over", "alike")


def _related(spark: SparkSession, d: str) -> DataFrame:
    items = _items(spark, d)
    sides = ["document_id", "collection", "seq", "char_start", "char_end"]
    a, b = (items.select("query_id", F.col("item").alias(x), *(F.col(c).alias(f"{x}_{c}") for c in sides), C.collapsed(F.col("texts")[0]).alias(f"{x}_text"), F.size(C.words(F.col("texts")[0])).alias(f"{x}_n")) for x in "ab")
    both = collapse.shingle_overlaps(items).join(a, ["query_id", "a"]).join(b, ["query_id", "b"])
    one = F.col("a_document_id") == F.col("b_document_id")
    apart = one & (F.col("a_collection") != F.col("b_collection"))
    inside = (F.col("a_char_start") <= F.col("b_char_start")) & (F.col("b_char_end") <= F.col("a_char_end"))
    holds = (F.col("b_char_start") <= F.col("a_char_start")) & (F.col("a_char_end") <= F.col("b_char_end"))
    return both.select("query_id", "a", "b", "into", "over", "alike", ((F.col("a_text") == F.col("b_text")) & (F.col("a_n") >= collapse.LEAST_WORDS)).alias("exact"),
                       (one & (F.col("a_collection") == F.col("b_collection")) & (F.abs(F.col("a_seq") - F.col("b_seq")) <= 1)).alias("touching"),
                       F.when(apart & inside, -1).when(apart & holds, 1).otherwise(0).alias("nested"))


@query
def fold_decisions(spark: SparkSession, d: str) -> DataFrame:
    decided = collapse.decided(_related(spark, d))
    return rounded(decided.where("relation is not null").select("query_id", "a", "b", "relation", "swap", "similarity"), "similarity")


def _folded(spark: SparkSession, d: str) -> DataFrame:
    return collapse.folded_results(_items(spark, d), 10)


@query
def leader_fold(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_folded(spark, d).select("query_id", "item", "slot", "lead", "relation", "similarity", "score"), "score", "similarity")


@query
def fold_tree(spark: SparkSession, d: str) -> DataFrame:
    """Every folded result with the slot it is in and how much of it the one above it holds."""
    tree = _folded(spark, d).where("lead is not null")
    return rounded(tree.select("query_id", "item", "lead", "root", "words", "chars"), "words", "chars")


@query
def fold_places(spark: SparkSession, d: str) -> DataFrame:
    return collapse.places(_folded(spark, d))


@query
def embedding_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Documents compared by their chunks' vectors, of which two chunks are near each other."""
    rows = scratch(corpus(spark, d).where("vector is not null").select(F.lit(0).alias("query_id"), "id", "document_id", "seq", "vector"), "rows")
    chunks = rows.groupBy("query_id", F.col("document_id").alias("item"), "seq").agg(F.max("vector").alias("vector"))
    of = rows.select("id", "document_id").distinct()
    near = _near(rows).join(of.withColumnsRenamed({"id": "a", "document_id": "da"}), "a").join(of.withColumnsRenamed({"id": "b", "document_id": "db"}), "b").where("da <> db")
    pairs = near.select(F.lit(0).alias("query_id"), F.least("da", "db").alias("a"), F.greatest("da", "db").alias("b")).distinct()
    return rounded(collapse.vector_overlaps(pairs, chunks).drop("query_id"), "into", "over", "alike", places=5)


# --- sections


@query
def section_runs(spark: SparkSession, d: str) -> DataFrame:
    return sections.runs(corpus(spark, d)).select("collection", "document_id", "position", "depth", C.header("path").alias("path"), "seq_start", "seq_end", "char_start", "char_end")


@query
def section_parents(spark: SparkSession, d: str) -> DataFrame:
    return sections.parents(sections.runs(corpus(spark, d))).select("collection", "document_id", "position", "depth", "parent")


def _placed(spark: SparkSession, d: str) -> DataFrame:
    found = passages.ranges(hits(spark, d)).select("query_id", "collection", "document_id", "name", "seq_start", "seq_end", F.col("char_start").alias("p_start"), F.col("char_end").alias("p_end"), "rank", "score", ((F.col("rank") > 1) & (F.col("char_end") - F.col("char_start") < 300)).alias("alone"))
    return sections.section_of(found, sections.runs(corpus(spark, d)), 12_000)


@query
def section_groups(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sections.grouped(_placed(spark, d), 10), "score")


@query
def documents_needed(spark: SparkSession, d: str) -> DataFrame:
    found = passages.ranges(hits(spark, d)).withColumn("alone", (F.col("rank") > 1) & (F.col("char_end") - F.col("char_start") < 300))
    return sections.documents_needed(found, 5)


@query
def budget_within(spark: SparkSession, d: str) -> DataFrame:
    """The passages of ten sections within 12,000 characters, the twentieth passage first, as a probe's would be."""
    placed = _placed(spark, d)
    groups = sections.grouped(placed, 10).select("query_id", "collection", "document_id", "position", F.col("rank").alias("group_rank"))
    rows = placed.join(groups, ["query_id", "collection", "document_id", "position"])
    cost = sections.passage_cost(F.col("p_end") - F.col("p_start"))
    head = sections.excerpt_cost(F.array().cast("array<string>"), F.array().cast("array<bigint>"))
    return sections.within_budget(rows.select("query_id", "group_rank", "rank", cost.alias("cost"), head.alias("header_cost"), "alone", (F.col("rank") == 20).alias("first")), 12_000)


@query
def section_excerpts(spark: SparkSession, d: str) -> DataFrame:
    placed = _placed(spark, d)
    kept = sections.grouped(placed, 10).select("query_id", "collection", "document_id", "position")
    rows = placed.join(kept, ["query_id", "collection", "document_id", "position"]).withColumnsRenamed({"p_start": "char_start", "p_end": "char_end", "path": "headings"})
    return sections.excerpts(passages.quotes(rows, load(spark, d, "documents")))


@query
def missing_terms(spark: SparkSession, d: str) -> DataFrame:
    return sections.missing_terms(load(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), "question"), hits(spark, d, 10).select("query_id", "text"), stemmed=False)


@query
def missing_stems(spark: SparkSession, d: str) -> DataFrame:
    return sections.missing_terms(load(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), "question"), hits(spark, d, 10).select("query_id", "text"))


# --- maps and interleaving


@query
def corpus_centre(spark: SparkSession, d: str) -> DataFrame:
    centre = metadata.mean_vector(load(spark, d, "embeddings").withColumn("all", F.lit(1)), ["all"], "embedding")
    return centre.select(F.posexplode("vector").alias("at", "x"), "rows").withColumn("x", F.round("x", 6))


@query
def document_vectors(spark: SparkSession, d: str) -> DataFrame:
    found = metadata.mean_vector(load(spark, d, "embeddings"), ["label"], "embedding")
    return found.select("label", "rows", F.posexplode("vector").alias("at", "x")).withColumn("x", F.round("x", 6))


@query
def nearest_documents(spark: SparkSession, d: str) -> DataFrame:
    """The five labels whose mean directions are closest to each label's."""
    found = metadata.mean_vector(load(spark, d, "embeddings"), ["label"], "embedding").select(F.col("label").alias("b"), C.unit("vector").alias("vector"))
    near = retrieval.nearest(found.select(F.col("b").alias("query_id"), "vector"), found, "b", "vector", 12).withColumnRenamed("id", "b").where("query_id <> b")
    return retrieval.top_k(near.select(F.col("query_id").alias("a"), "b", F.round(1 - F.col("distance") / 2, 4).alias("cosine")), 5, ["a"], F.desc("cosine"), "b")


def _mapped(spark: SparkSession, d: str, worded: bool = False) -> DataFrame:
    rows = _placed_hits(spark, d)
    centre = metadata.mean_vector(corpus(spark, d).where("vector is not null").withColumn("all", F.lit(1)), ["all"], "vector").select(F.col("vector").alias("centre"))
    centred = C.unit(F.zip_with(C.unit("vector"), "centre", lambda x, y: x - y))
    vector = F.lit(None).cast("array<double>") if worded else centred
    return mapping.covered(rows.crossJoin(F.broadcast(centre)).select("query_id", "rank", "item", "document_id", "score", vector.alias("vector"), "text"), 8)  # one row


def _placed_hits(spark: SparkSession, d: str) -> DataFrame:
    own = hits(spark, d, 50).select("query_id", "rank", "collection", "document_id", F.col("seq").alias("seq_start"), "score", "vector", "text")
    placed = sections.section_of(own.where("vector is not null"), sections.runs(corpus(spark, d)), 12_000)
    return placed.withColumn("item", F.xxhash64("document_id", "s_char_start", "s_char_end"))


@query
def facility_location_map(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_mapped(spark, d).where("pick is not null").select("query_id", "item", "pick", "score", "chunks", "coverage", "capped"), "score", "coverage")


@query
def related_sections(spark: SparkSession, d: str) -> DataFrame:
    return rounded(mapping.related(_mapped(spark, d)).select("query_id", "item", "lead", "n", "similarity"), "similarity")


@query
def map_by_rank(spark: SparkSession, d: str) -> DataFrame:
    """The map of chunks without vectors: sections by score, repeats by words."""
    return rounded(_mapped(spark, d, worded=True).select("query_id", "item", "pick", "lead", "similarity", "score", "capped"), "similarity", "score")


@query
def map_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The sections that the hits of each question fall in, with the rank of the first and the score of all."""
    rows = _placed_hits(spark, d)
    return rounded(rows.groupBy("query_id", "document_id", "s_char_start", "s_char_end").agg(F.min("rank").alias("first"), F.count("*").alias("chunks"), F.sum("score").alias("score")), "score")


@query
def validated_questions(spark: SparkSession, d: str) -> DataFrame:
    searches = load(spark, d, "searches").select(F.col("id").alias("search_id"), "context")
    asked_ = load(spark, d, "search_questions").groupBy("search_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("position", "question"))), lambda x: x["question"]).alias("questions"))
    found = mapping.validated(asked_.join(searches, "search_id").withColumnRenamed("search_id", "request_id"))
    return found.select("request_id", F.array_join("parts", "|").alias("parts"), "context", "problem", mapping.depth(10, F.greatest(F.size("parts"), F.lit(1))).alias("depth"))


@query
def interleave_questions(spark: SparkSession, d: str) -> DataFrame:
    found = passages.ranges(hits(spark, d, 10))
    parts = found.select(F.floor(F.col("query_id") / 3).alias("request_id"), (F.col("query_id") % 3).cast("int").alias("part"), "rank", F.xxhash64("query_id", "rank").alias("item"), "collection", "document_id", "seq_start", "seq_end", "end_reason")
    return mapping.interleaved(parts, 12).withColumn("answers", F.array_join(F.transform("answers", lambda x: x.cast("string")), ","))


# --- the log


@query
def load_log(spark: SparkSession, d: str) -> DataFrame:
    return log.loaded(load(spark, d, "searches"), load(spark, d, "search_questions"), since="2026-03-01").select("id", "ts", "tool", "question_id", "position", "question")


@query
def top_results_per_search(spark: SparkSession, d: str) -> DataFrame:
    return log.top_results(load(spark, d, "search_results"), 3).select("search_id", "n", "position", "document", F.round("score", 6).alias("score"))


@query
def search_history(spark: SparkSession, d: str) -> DataFrame:
    return log.history(load(spark, d, "searches"), load(spark, d, "search_results")).select("id", F.array_join("documents", ",").alias("documents"))


@query
def search_tally(spark: SparkSession, d: str) -> DataFrame:
    return log.tally(load(spark, d, "searches"))


@query
def recent_questions(spark: SparkSession, d: str) -> DataFrame:
    return log.recent_questions(load(spark, d, "search_questions").where("trim(question) <> ''"), load(spark, d, "searches"), 50)


@query
def searches_since(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "searches").where("ts >= timestamp'2026-05-01'").select("id", "ts", "duration_ms")


@query
def retention_prune(spark: SparkSession, d: str) -> DataFrame:
    kept, children = log.pruned(load(spark, d, "searches"), load(spark, d, "search_questions"), 90, "2026-07-18")
    return children.groupBy("search_id").agg(F.count("*").alias("questions"))


def _events(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").withColumn("session_id", F.concat(F.lit("u"), F.col("user_id").cast("string")))


@query
def session_summaries(spark: SparkSession, d: str) -> DataFrame:
    return log.session_summaries(load(spark, d, "searches"), _events(spark, d))


@query
def session_history(spark: SparkSession, d: str) -> DataFrame:
    return log.session_history(load(spark, d, "searches"), _events(spark, d), "u1", 100)


@query
def session_selections(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "searches").where("session_id is not null").select("session_id", F.posexplode_outer("collections").alias("position", "collection")).groupBy("session_id", "collection").agg(F.min("position").alias("position"))
    return log.selections(rows).select("session_id", F.array_join("collections", ",").alias("collections"))


@query
def similarities_top(spark: SparkSession, d: str) -> DataFrame:
    flat = load(spark, d, "search_questions").select(F.col("id").alias("question_id"), F.explode("similarities").alias("cosine"))
    return log.similarities(flat.withColumn("cosine", F.round(F.col("cosine").cast("double"), 4))).select("question_id", F.array_join(F.transform("similarities", lambda x: F.format_number(x, 4)), ",").alias("similarities"))


@query
def trend_daily_top6_other(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "events").withColumn("kind", F.concat_ws("-", "event_type", (F.col("user_id") % 2).cast("string")))
    return log.trend(rows, "ts", "kind", "day", "2024-01-01", "2024-01-31")


@query
def trend_hourly(spark: SparkSession, d: str) -> DataFrame:
    return log.trend(load(spark, d, "events"), "ts", "event_type", "hour", "2024-01-10", "2024-01-11")


@query
def trend_searches(spark: SparkSession, d: str) -> DataFrame:
    return log.trend(load(spark, d, "searches"), "ts", "tool", "day", "2026-01-01", "2026-08-01", F.coalesce("result_count", F.lit(0)))


# --- gaps

BARS = [("fern-64", 0.79, 0.885, 0.82), ("fern-64q", 0.75, 0.86, 0.82)]


def _bars(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BARS, "embedding string, weak_match double, answered_match double, same_topic double")


def _gaps(spark: SparkSession, d: str) -> DataFrame:
    return gaps.signals(load(spark, d, "search_questions"), load(spark, d, "searches"), _bars(spark)).where("signal is not null and review is null")


@query
def gap_signals(spark: SparkSession, d: str) -> DataFrame:
    return gaps.signals(load(spark, d, "search_questions"), load(spark, d, "searches"), _bars(spark)).select("question_id", "signal")


@query
def gap_topics_words(spark: SparkSession, d: str) -> DataFrame:
    return gaps.word_topics(_gaps(spark, d))


@query
def gap_topics_vectors(spark: SparkSession, d: str) -> DataFrame:
    return gaps.vector_topics(_gaps(spark, d), 0.82)


@query
def gap_topic_summaries(spark: SparkSession, d: str) -> DataFrame:
    own = _gaps(spark, d)
    return gaps.topic_summaries(own, gaps.word_topics(own)).withColumn("collections", F.array_join("collections", ","))


@query
def gap_near_misses(spark: SparkSession, d: str) -> DataFrame:
    wanting = _gaps(spark, d).select(F.col("search_id").alias("id"))
    return rounded(gaps.near_misses(load(spark, d, "search_results"), wanting), "score")


@query
def gap_reviews(spark: SparkSession, d: str) -> DataFrame:
    questions = load(spark, d, "search_questions")
    return gaps.reviewed(questions, questions.where("agent_verdict = 'partial'").select("id"), "dismissed").groupBy("review").agg(F.count("*").alias("n"))


@query
def report_window_asof(spark: SparkSession, d: str) -> DataFrame:
    questions, searches = load(spark, d, "search_questions"), load(spark, d, "searches")
    own = questions.join(searches.select(F.col("id").alias("search_id"), "session_id", "ts"), "search_id").where("session_id is not null and trim(question) <> ''")
    asked_ = own.select(F.col("id").alias("report_id"), "session_id", "question", (F.col("ts") + F.expr("interval 30 minutes")).alias("ts"))
    return gaps.reports(asked_, questions, searches)


# --- calibration


@query
def beta_fit(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "searches").join(load(spark, d, "search_questions").select("search_id", F.explode("rerank_scores").alias("s")), F.col("id") == F.col("search_id"))
    return rounded(calibrate.beta_fit(rows.where("reranker is not null").select("reranker", F.col("s").cast("double").alias("s")), "reranker", "s"), "floor", "beta_a", "beta_b")


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "search_questions").join(load(spark, d, "searches").select(F.col("id").alias("search_id"), "embedding"), "search_id").where("embedding is not null")
    return rows.select(F.col("embedding").alias("profile"), F.round(F.array_max("similarities").cast("double"), 4).alias("best_similarity"), (F.col("uncovered") == 0).alias("answered")).where("best_similarity is not null")


@query
def gap_bars(spark: SparkSession, d: str) -> DataFrame:
    return calibrate.gap_bars(_labelled(spark, d))


@query
def auroc(spark: SparkSession, d: str) -> DataFrame:
    return rounded(calibrate.auroc(_labelled(spark, d), "profile", "best_similarity", "answered"), "auroc")


@query
def qpp_features(spark: SparkSession, d: str) -> DataFrame:
    rows = calibrate.predictors(load(spark, d, "search_questions").where("similarities is not null"), "similarities")
    return rounded(rows.select("id", "best", "lead", "spread", "mean_five"), "best", "lead", "spread", "mean_five", places=5)


@query
def sample_candidates(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "candidates").where("rerank_score is not null").distinct().withColumnRenamed("search_id", "query_id")
    ranked = retrieval.top_k(rows, 200, ["query_id"], F.desc("rerank_score"), "document_id", "seq")
    return calibrate.sampled_candidates(ranked).select("query_id", "document_id", "seq", "rank")


# --- metadata


@query
def members_keyset_page(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "documents").select("size", "name", "status").where("size is not null")
    return metadata.keyset_page(rows, "size", "name", 50, (2000, "m"))


@query
def member_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "documents").withColumn("source", F.lower(F.trim("source")))
    return metadata.counts_by(rows, "source", "status", ["imported", "failed", "queued", "deleting"])


@query
def leaving_union(spark: SparkSession, d: str) -> DataFrame:
    documents = load(spark, d, "documents")
    members = documents.select("document_id", F.when(F.col("pages_unread") > 0, "removing").otherwise("indexed").alias("status"))
    return metadata.leaving(members, documents)


@query
def searchable_exists(spark: SparkSession, d: str) -> DataFrame:
    documents = load(spark, d, "documents")
    members = load(spark, d, "chunks").select("collection", "document_id", F.lit("indexed").alias("status"), F.lit(None).cast("string").alias("cache_id")).distinct()
    gone = documents.where("status <> 'imported'").select("document_id")
    return metadata.searchable(load(spark, d, "search_settings").where("collection is not null").select("collection"), members, gone)


@query
def settings_resolved(spark: SparkSession, d: str) -> DataFrame:
    return resolved(load(spark, d, "search_settings"))


@query
def insert_or_ignore(spark: SparkSession, d: str) -> DataFrame:
    """Orders' customers, and as many that are not there yet, put into the customers where they are missing."""
    rows = load(spark, d, "customer").select("c_custkey", "c_nationkey")
    kind = rows.schema["c_nationkey"].dataType
    new = load(spark, d, "orders").select(F.explode(F.array(F.col("o_custkey"), -F.col("o_custkey"))).alias("c_custkey"), F.lit(-1).cast(kind).alias("c_nationkey"))
    return metadata.inserted(rows, new, ["c_custkey"]).groupBy("c_nationkey").agg(F.count("*").alias("n"))


@query
def upsert(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "part").select("p_partkey", "p_size")
    new = load(spark, d, "part").where("p_retailprice > 1500").select("p_partkey", F.lit(0).cast(rows.schema["p_size"].dataType).alias("p_size"))
    return metadata.upserted(rows, new, ["p_partkey"]).groupBy("p_size").agg(F.count("*").alias("n"))


@query
def membership_transitions(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "documents").select("doc_id", "status", "pages_unread")
    return metadata.moved(rows, "status", ["queued", "failed"], "cancelled", F.coalesce("pages_unread", F.lit(0)) == 0).groupBy("status").agg(F.count("*").alias("n"))


@query
def newest_entries(spark: SparkSession, d: str) -> DataFrame:
    return metadata.newest(load(spark, d, "documents").select("doc_id", "lang", "updated_at"), ["lang"], "updated_at", "doc_id")


@query
def largest_remainder_caps(spark: SparkSession, d: str) -> DataFrame:
    weights = load(spark, d, "documents").groupBy(F.lower(F.trim("source")).alias("stage")).agg(F.count("*").alias("weight")).where("stage is not null")
    return metadata.stage_caps(weights, 100)


@query
def ntile_slices(spark: SparkSession, d: str) -> DataFrame:
    return metadata.slices(load(spark, d, "customer").select("c_nationkey", "c_custkey"), "c_nationkey", ["c_custkey"], 3)


@query
def folded_operations(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "search_results").dropDuplicates(["search_id", "position"])
    runs = rows.select(F.concat_ws("-", "search_id", "position").alias("id"), F.concat_ws("-", "search_id", F.col("parent")).alias("_p"), "parent", F.col("collection").alias("name"), F.when(F.col("score") > 0.5, "SUCCESS").otherwise("ERROR").alias("status"))
    return metadata.folded_operations(runs.withColumn("parent_id", F.when(F.col("parent").isNotNull(), F.col("_p"))))


@query
def step_counts(spark: SparkSession, d: str) -> DataFrame:
    return metadata.step_counts(load(spark, d, "events").select(F.col("user_id").alias("workflow_id"), F.col("event_type").alias("function")), "click")


@query
def cache_keys(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", ids.cache_key(document=F.col("document_id"), chunk_size=F.lit(1200), frame=F.lit(True)).alias("cache_id"))


@query
def chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "chunks").select("document_id", "seq").distinct().select("document_id", "seq", ids.chunk_id("document_id", "seq").alias("id"))


@query
def identical_documents(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "documents").where("status <> 'deleting' and text is not null")
    return rows.groupBy(F.md5("text").alias("digest")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first")).where("copies > 1")


# --- chunking


@query
def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunked(load(spark, d, "documents"), "document_id", "text").drop("text", "framed")


@query
def chunk_plain(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunked(load(spark, d, "documents"), "document_id", "text", ChunkSettings(chunker="text", chunk_size=800)).drop("text", "framed")


@query
def heading_contents(spark: SparkSession, d: str) -> DataFrame:
    return chunking.contents(load(spark, d, "documents"), "doc_id", "text")


@query
def page_split(spark: SparkSession, d: str) -> DataFrame:
    return chunking.pages(load(spark, d, "documents"), "doc_id").select("id", "page", F.length("text").alias("chars"))


@query
def page_counts(spark: SparkSession, d: str) -> DataFrame:
    return chunking.page_counts(load(spark, d, "documents"), "doc_id")


@query
def line_ranges(spark: SparkSession, d: str) -> DataFrame:
    return chunking.lines(load(spark, d, "documents").where("text is not null"), 3, 6).select("doc_id", F.array_join("lines", "\n").alias("lines"))


@query
def text_slices(spark: SparkSession, d: str) -> DataFrame:
    """The text of every chunk as its document has it at the chunk's place."""
    docs = load(spark, d, "documents").select("document_id", F.col("text").alias("whole"))
    rows = corpus(spark, d).select(*KEY, "char_start", "char_end").join(docs, "document_id")
    return rows.select(*KEY, F.md5(F.substring(F.col("whole"), F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))).alias("digest"))


# --- descriptors and vocabulary


def _class_terms(spark: SparkSession, d: str, stemmed: bool = False) -> DataFrame:
    return descriptors.class_terms(corpus(spark, d), ["collection"], "text", stemmed)


@query
def ctfidf_terms(spark: SparkSession, d: str) -> DataFrame:
    """Terms of collections as written; ctfidf_stems counts them by their stems."""
    weights = rounded(descriptors.ctfidf(_class_terms(spark, d), ["collection"]), "weight")
    return retrieval.top_k(weights, 20, ["collection"], F.desc("weight"), "term")


@query
def ctfidf_stems(spark: SparkSession, d: str) -> DataFrame:
    weights = rounded(descriptors.ctfidf(_class_terms(spark, d, stemmed=True), ["collection"]), "weight")
    return retrieval.top_k(weights, 20, ["collection"], F.desc("weight"), "term")


@query
def widespread_terms(spark: SparkSession, d: str) -> DataFrame:
    terms = _class_terms(spark, d)
    classes = terms.agg(F.count_distinct("collection").alias("all"))
    return terms.groupBy("term").agg(F.count("*").alias("classes")).crossJoin(F.broadcast(classes)).where("classes > 0.5 * all").drop("all")  # one row


@query
def term_candidates(spark: SparkSession, d: str) -> DataFrame:
    """What may describe each collection."""
    found = descriptors.candidates(_class_terms(spark, d), ["collection"])
    return found.groupBy("collection").agg(F.count("*").alias("terms"), F.round(F.sum("weight"), 4).alias("weight"))


@query
def picked_descriptors(spark: SparkSession, d: str) -> DataFrame:
    found = descriptors.picked(descriptors.candidates(_class_terms(spark, d), ["collection"]), ["collection"])
    return found.withColumn("descriptors", F.array_join("descriptors", "|"))


@query
def section_terms(spark: SparkSession, d: str) -> DataFrame:
    rows = corpus(spark, d)
    terms = descriptors.section_terms(descriptors.class_terms(rows, KEY, "text", stemmed=False), sections.runs(rows))
    weights = descriptors.ctfidf(terms, ["position"], ["collection", "document_id", "depth"])
    return rounded(weights.groupBy("collection", "document_id", "position").agg(F.count("*").alias("terms"), F.sum("weight").alias("weight")), "weight", places=4)


@query
def section_descriptors(spark: SparkSession, d: str) -> DataFrame:
    rows = corpus(spark, d)
    found = descriptors.described(rows.withColumn("text", descriptors.prose(F.col("layout"), F.col("text"))), sections.runs(rows))
    return found.withColumn("descriptors", F.array_join("descriptors", "|"))


@query
def chunk_prose(spark: SparkSession, d: str) -> DataFrame:
    return corpus(spark, d).select(*KEY, F.md5(descriptors.prose(F.col("layout"), F.col("text"))).alias("digest"))


@query
def section_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The mean direction of each section's chunks; a chunk without a direction counts as one."""
    rows = corpus(spark, d).where("vector is not null")
    runs = sections.runs(corpus(spark, d)).select("collection", "document_id", "position", "seq_start", "seq_end")
    met = rows.join(runs, ["collection", "document_id"]).where("seq between seq_start and seq_end")
    found = metadata.mean_vector(met, ["collection", "document_id", "position"], "vector", zeros=True)
    return found.select("collection", "document_id", "position", "rows", F.round(F.element_at("vector", 1), 5).alias("first"), F.round(C.norm("vector"), 5).alias("norm"))


@query
def mmr_descriptors(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "embeddings")
    centre = metadata.mean_vector(rows, ["label"], "embedding").select("label", F.col("vector").alias("centre"))
    near = rows.join(centre, "label").select("label", F.col("vec_id").alias("item"), C.cosine("embedding", "centre").alias("relevance"), F.col("embedding").alias("vector"))
    return descriptors.diverse(near, "label")


@query
def vocabulary_variants(spark: SparkSession, d: str) -> DataFrame:
    return descriptors.variants(corpus(spark, d), "headings")


def _alike(spark: SparkSession, d: str) -> DataFrame:
    return _near(corpus(spark, d).where("vector is not null"))


def _near(rows: DataFrame) -> DataFrame:
    one = rows.groupBy("id").agg(F.max("vector").alias("vector")).where(F.exists("vector", lambda x: x != 0))
    return descriptors.pairs_to_judge(one, "id", "vector")


@query
def vocabulary_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _alike(spark, d).select("a", "b", F.round("cosine", 5).alias("cosine"))


def _uses(spark: SparkSession, d: str) -> DataFrame:
    return scratch(corpus(spark, d).groupBy(F.col("id").alias("variant")).agg(F.count("*").alias("uses"), F.min("document_id").alias("shown")), "uses")


@query
def vocabulary_preferred(spark: SparkSession, d: str) -> DataFrame:
    return descriptors.preferred(_uses(spark, d), _alike(spark, d).withColumn("cosine", F.round("cosine", 5)))


@query
def vocabulary_terms(spark: SparkSession, d: str) -> DataFrame:
    uses = _uses(spark, d)
    found = descriptors.vocabulary_terms(uses, descriptors.preferred(uses, _alike(spark, d).withColumn("cosine", F.round("cosine", 5))))
    return found.withColumn("variants", F.array_join("variants", ","))


def _heading_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Titles of one document that start alike."""
    own = load(spark, d, "headings").where("text is not null").select("doc_id", C.variant("text").alias("v")).where("v <> ''").distinct().withColumn("head", F.substring("v", 1, 4))
    pairs = own.select("doc_id", "head", F.col("v").alias("a")).join(own.select("doc_id", "head", F.col("v").alias("b")), ["doc_id", "head"]).where("a < b")
    return pairs.select("a", "b").distinct().withColumn("cosine", F.lit(0.95))


@query
def same_titles(spark: SparkSession, d: str) -> DataFrame:
    return descriptors.same_words(_heading_pairs(spark, d)).select("a", "b", "same")


@query
def pairs_to_ask(spark: SparkSession, d: str) -> DataFrame:
    pairs = _heading_pairs(spark, d)
    told = pairs.select(F.lit("judge-1").alias("judge"), "a", "b", F.lit(0.7).alias("score")).where("length(a) > length(b)")
    return descriptors.pairs_to_ask(pairs, told, "judge-1")


@query
def missing_vectors(spark: SparkSession, d: str) -> DataFrame:
    variants = descriptors.variants(corpus(spark, d), "headings")
    known = load(spark, d, "headings").where("level = 1 and text is not null").select(F.lit("fern-64").alias("model"), C.variant("text").alias("variant"))
    return descriptors.missing_vectors(variants, known, "fern-64").select("variant", "uses")


@query
def compact_descriptors(spark: SparkSession, d: str) -> DataFrame:
    rows = corpus(spark, d).where("size(headings) > 0").select(F.concat_ws("/", *KEY).alias("key"), "headings")
    first = rows.select(F.explode("headings").alias("h")).distinct().select(C.variant("h").alias("variant"), F.substring_index(C.variant("h"), " ", 1).alias("preferred")).distinct()
    return descriptors.compacted(rows, first, "key", "headings").select("key", F.array_join("descriptors", "|").alias("descriptors"))


# --- smaller ones


@query
def probe_gaps(spark: SparkSession, d: str) -> DataFrame:
    best = scratch(hits(spark, d, 10), "hits")
    missing = sections.missing_terms(load(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), "question"), best.select("query_id", "text"), stemmed=False)
    return rounded(extras.probes(missing, fulltext(spark, d), best.select("query_id", *KEY)), "score")


@query
def aspects_tagged(spark: SparkSession, d: str) -> DataFrame:
    ranked = hits(spark, d, 10).select(F.floor(F.col("query_id") / 3).alias("request_id"), (F.col("query_id") % 3).cast("int").alias("part"), *KEY, "score")
    picked = ranked.groupBy("request_id", *KEY).agg(F.max("score").alias("m")).select("request_id", F.xxhash64(*KEY).alias("item"), *KEY)
    found = extras.aspects(picked, ranked, KEY).join(picked, ["request_id", "item"])
    return rounded(found.select("request_id", *KEY, F.array_join(F.transform("aspects", lambda x: x.cast("string")), ",").alias("aspects"), "best"), "best")


@query
def framed_questions(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "search_questions").join(load(spark, d, "searches").select(F.col("id").alias("search_id"), "context"), "search_id")
    return rows.select("id", F.md5(extras.framed_question(F.col("context"), F.col("question"))).alias("digest"))


@query
def unknown_references(spark: SparkSession, d: str) -> DataFrame:
    return extras.unknown_references(load(spark, d, "chunks").select("collection"), load(spark, d, "search_settings").where("collection is not null").select("collection"), "collection")


@query
def first_members(spark: SparkSession, d: str) -> DataFrame:
    documents = load(spark, d, "documents")
    rows = load(spark, d, "chunks").select("collection", "document_id").distinct().join(documents.select("document_id", "name"), "document_id")
    return extras.first_members(rows, documents.where("status <> 'imported'"), 5).select("collection", "n", "name")


@query
def describe_if_empty(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "documents").select("doc_id", "description")
    new = load(spark, d, "headings").where("level = 1 and text is not null").groupBy("doc_id").agg(F.min("text").alias("description"))
    return extras.described_if_empty(rows, new, "doc_id")


@query
def backfill_sizes(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "documents")
    computed = rows.where("text is not null").select("doc_id", F.length("text").cast("long").alias("n_chars"))
    return extras.backfilled(rows.select("doc_id", "n_chars"), computed, "doc_id", "n_chars")


@query
def plan_batches(spark: SparkSession, d: str) -> DataFrame:
    return extras.plan_batches(corpus(spark, d).select(*KEY), ["collection"], ["document_id", "seq"], 32)


@query
def evenly_spaced(spark: SparkSession, d: str) -> DataFrame:
    rows = corpus(spark, d).select(*KEY, (F.col("char_end") - F.col("char_start")).alias("chars"))
    return extras.evenly_spaced(rows, ["collection", "document_id"], "chars", whole=2000, picks=3)


@query
def subsections(spark: SparkSession, d: str) -> DataFrame:
    return extras.subsections(sections.runs(corpus(spark, d)))


@query
def topic_pairs_joined(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of the table, of one topic and of two, and how many of each the bar joins."""
    rows = load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("topic"), F.col("embedding").alias("vector"))
    return extras.topic_pairs(rows, "vector", 0.1)


@query
def chunk_trend(spark: SparkSession, d: str) -> DataFrame:
    searches = load(spark, d, "searches")
    runs = searches.select("id", F.col("ts").alias("finished_at"), F.when(F.col("error").isNull(), "SUCCESS").otherwise("ERROR").alias("status"))
    batches = load(spark, d, "search_results").dropDuplicates(["search_id", "position"]).select(F.col("search_id").alias("run_id"), (F.col("seq_end") - F.col("seq_start") + 1).alias("outputs"))
    return extras.batch_outputs(runs, batches).select("id", "outputs")


@query
def active_runs(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "orders").select(F.col("o_orderpriority").alias("name"), F.when(F.col("o_orderstatus") == "O", "PENDING").otherwise("SUCCESS").alias("status"), (F.col("o_orderkey") % 10).alias("total"), (F.col("o_custkey") % 10).alias("done"))
    return extras.activity(rows)


@query
def model_cache_names(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "searches").select("embedding").where("embedding is not null").distinct()
    return rows.select("embedding", extras.model_cache_name(F.col("embedding"), F.lit(64), F.lit("query: "), F.lit(None)).alias("cache_name"))


# --- documents, collections, caches


def _members(spark: SparkSession, d: str) -> DataFrame:
    documents = load(spark, d, "documents").select("document_id", "status")
    return load(spark, d, "chunks").select("collection", "document_id").distinct().join(documents, "document_id")


@query
def key_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The chunks that search candidates name."""
    return library.at_keys(corpus(spark, d), load(spark, d, "candidates"), KEY).select(*KEY)


@query
def hit_rows(spark: SparkSession, d: str) -> DataFrame:
    return library.as_hits(corpus(spark, d)).select(*KEY, "section_id", "header")


@query
def listed_with_collections(spark: SparkSession, d: str) -> DataFrame:
    found = library.with_collections(load(spark, d, "documents").select("document_id", "name"), load(spark, d, "chunks"))
    return found.withColumn("collections", F.array_join("collections", ","))


@query
def batched_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The source of every imported document that has chunks."""
    return library.looked_up(load(spark, d, "documents"), load(spark, d, "chunks"), "document_id", "source", F.col("status") == "imported")


@query
def collection_info(spark: SparkSession, d: str) -> DataFrame:
    return library.collection_info(_members(spark, d), corpus(spark, d))


@query
def pending_collections(spark: SparkSession, d: str) -> DataFrame:
    return library.pending_collections(library.collection_info(_members(spark, d), corpus(spark, d)))


@query
def member_id_walk(spark: SparkSession, d: str) -> DataFrame:
    return library.id_walk(load(spark, d, "documents"), "document_id", "M", 50)


@query
def sorted_documents(spark: SparkSession, d: str) -> DataFrame:
    return library.sorted_page(load(spark, d, "documents").select("doc_id", "name", "pages"), "pages", 40, 20, descending=True)


@query
def indexed_caches(spark: SparkSession, d: str) -> DataFrame:
    rows = _members(spark, d).withColumns({"status": F.when(F.col("status") == "imported", "indexed").otherwise(F.col("status")), "cache_id": F.md5("document_id")})
    return library.indexed_caches(rows)


@query
def cache_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Entries of documents with text whose chunks are there."""
    documents = load(spark, d, "documents")
    entry = F.md5("document_id").alias("cache_id")
    return library.cached(documents.select(entry), documents.where("text is not null").select(entry), load(spark, d, "chunks").select(entry)).distinct()


@query
def members_added(spark: SparkSession, d: str) -> DataFrame:
    """Every document put into one more collection, and into those that it is in already."""
    members = _members(spark, d)
    new = load(spark, d, "documents").select(F.lit("everything").alias("collection"), "document_id").unionByName(members.select("collection", "document_id"))
    found = library.members_added(members, new, load(spark, d, "documents"), ["imported", "queued"])
    return found.groupBy("collection", "status").agg(F.count("*").alias("n"))


@query
def loaded_models(spark: SparkSession, d: str) -> DataFrame:
    return library.loaded_models(resolved(load(spark, d, "search_settings")))


@query
def calibration_lookup(spark: SparkSession, d: str) -> DataFrame:
    models = library.loaded_models(resolved(load(spark, d, "search_settings")))
    return library.calibrations(models, beta_fit(spark, d).where("beta_a > 1"))


@query
def operation_origins(spark: SparkSession, d: str) -> DataFrame:
    return library.origins(load(spark, d, "search_results").select(F.col("search_id").alias("id")), load(spark, d, "searches"))


@query
def events_added(spark: SparkSession, d: str) -> DataFrame:
    """Sessions after the log's searches were added to the event stream's."""
    known = _events(spark, d)
    sessions_ = known.groupBy("session_id").agg(F.min("ts").cast("timestamp").alias("created_at"))
    new = load(spark, d, "searches").select("session_id", F.col("ts").cast("timestamp").alias("at"), F.col("tool").alias("kind"))
    made, _ = library.events_added(sessions_, known.select("session_id", F.col("ts").cast("timestamp").alias("at"), F.col("event_type").alias("kind")), new)
    return made.groupBy(F.to_date("created_at").cast("string").alias("day")).agg(F.count("*").alias("n"))


@query
def stale_runs(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "searches").select("id", F.when(F.col("error").isNull(), "PENDING").otherwise("ERROR").alias("status"), F.col("reranker").alias("version"), F.col("ts").alias("created_at"))
    return library.stale(rows, ["PENDING"], "none", 50).select("id", "status", "version")


def _weak(spark: SparkSession, d: str) -> DataFrame:
    searches = load(spark, d, "searches").select(F.col("id").alias("search_id"), "embedding")
    return library.weak_questions(load(spark, d, "search_questions").join(searches, "search_id"), _bars(spark))


@query
def weak_questions(spark: SparkSession, d: str) -> DataFrame:
    return _weak(spark, d)


@query
def uncovered_questions(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "search_questions").where("trim(question) <> ''").select("id", "position", "question", (F.col("uncovered") == 1).alias("uncovered")).join(_weak(spark, d), "id")
    return library.answered_with_gaps(rows).withColumn("uncovered", F.array_join("uncovered", "|"))


@query
def describe_order(spark: SparkSession, d: str) -> DataFrame:
    return library.describe_order(sections.runs(corpus(spark, d))).select("collection", "document_id", "position", "turn")


@query
def ann_due(spark: SparkSession, d: str) -> DataFrame:
    trained = corpus(spark, d).where("part = 0").groupBy("collection").agg(F.count("vector").alias("trained"))
    return library.ann_due(corpus(spark, d), trained, least=0)


@query
def kept_children(spark: SparkSession, d: str) -> DataFrame:
    """Questions of the searches that a backup keeps: those of documents that are leaving are not."""
    gone = load(spark, d, "documents").where("status <> 'imported'").select(F.col("name").alias("document"))
    results = library.without(load(spark, d, "search_results"), gone, "document")
    return library.kept_children(load(spark, d, "search_questions"), results, "search_id", "search_id").groupBy("search_id").agg(F.count("*").alias("n"))


@query
def shortened_vectors(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "embeddings").select("vec_id", library.shortened(F.col("embedding"), 16).alias("v"))
    return rows.select("vec_id", F.size("v").alias("dims"), F.round(F.element_at("v", 1), 5).alias("first"))


@query
def parts_deleted(spark: SparkSession, d: str) -> DataFrame:
    first = corpus(spark, d).agg(F.min("document_id")).first()[0]
    return library.parts_deleted(corpus(spark, d), first or "", 0).groupBy("collection").agg(F.count("*").alias("n"))


# --- the flagship


@query
def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Questions to cited passages: chunks ranked by full text, one per span, joined where they follow each other."""
    found = retrieval.first_per(hits(spark, d, 25), SPAN, "rank")
    best = passages.ranges(found, "sum").where("rank <= 10")
    cited = C.citation(F.col("name"), F.col("page_start"), F.col("page_end"), F.col("line_start"), F.col("line_end"))
    return rounded(best.select("query_id", "rank", "collection", "document_id", "seq_start", "seq_end", cited.alias("citation"), "hits", "score"), "score")


def queries() -> dict[str, Query]:
    from evidara.plans import answers
    from evidara.streaming import live

    return {**REGISTRY, **answers.queries(), **live.queries()}


def oracle_sql() -> dict[str, str]:
    from evidara.plans import oracles

    return oracles.oracle_sql()
