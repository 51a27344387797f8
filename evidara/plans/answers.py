"""Whole answers for batches of questions: explore, excerpts, section maps, text listings; and what is written of them to the log."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidara.functions import columns as C
from evidara.operators import collapse, extras, growth, mapping, metadata, passages, retrieval, sections
from evidara.session import load, scratch
from evidara.settings import SearchSettings

KEY = ["collection", "document_id", "seq"]
SPAN = ["document_id", "char_start", "char_end"]


_LIBRARIES: dict[tuple, Library] = {}


@dataclass(frozen=True)
class Library:
    """The tables that answers are made from: chunks and documents, without what is leaving."""

    chunks: DataFrame
    documents: DataFrame
    indexes: dict = field(default_factory=dict, compare=False)

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> Library:
        """The library of a folder, whose indexes are kept for the application, as the tables of a folder stay as they are."""
        name = (spark.sparkContext.applicationId, sf_dir)
        if name not in _LIBRARIES:
            documents = load(spark, sf_dir, "documents")
            gone = documents.where("status <> 'imported'")
            chunks = load(spark, sf_dir, "chunks").where("text is not null").dropDuplicates(KEY)
            _LIBRARIES[name] = cls(scratch(retrieval.leaving_out(chunks, gone), "library"), documents)
        return _LIBRARIES[name]

    def by_id(self) -> retrieval.FullText:
        """Full text by chunk id; a chunk that lies in two collections counts once."""
        if "id" not in self.indexes:
            self.indexes["id"] = retrieval.FullText(self.chunks.groupBy("id").agg(F.min("framed").alias("framed")), ["id"], "framed")
        return self.indexes["id"]

    def by_place(self) -> retrieval.FullText:
        if "place" not in self.indexes:
            self.indexes["place"] = retrieval.FullText(self.chunks, KEY, "framed")
        return self.indexes["place"]

    def runs(self) -> DataFrame:
        if "runs" not in self.indexes:
            self.indexes["runs"] = scratch(sections.runs(self.chunks), "runs")
        return self.indexes["runs"]

    def names(self) -> DataFrame:
        return self.documents.groupBy("document_id").agg(F.min("name").alias("name"))


def ranked(library: Library, questions: DataFrame, settings: SearchSettings, kind: str) -> DataFrame:
    """(query_id, chunk columns, score, rank): each question's scan of the library, one row per span.

    questions(query_id, question[, vector]). Both halves are read where there are vectors and the mode asks for them.
    """
    scan, deep = settings.scan(kind)
    asked = questions.withColumn("question", F.concat_ws(" ", C.question_terms("question")))
    halves = []
    if settings.mode != "bm25" and "vector" in questions.columns:
        own = library.chunks.where("vector is not null").groupBy("id").agg(F.max("vector").alias("vector"))
        halves.append(retrieval.nearest(questions.where("vector is not null"), own, "id", "vector", deep))
    if settings.mode != "vector" or not halves:
        halves.append(library.by_id().search(asked, deep))
    if len(halves) == 1:
        only = halves[0] if "score" in halves[0].columns else halves[0].withColumn("score", C.nearness("distance"))
        fused = only.select("query_id", "id", "score", "rank")
    elif settings.fusion == "linear":
        fused = retrieval.linear(halves[0], halves[1], ["id"], settings.vector_share)
    else:
        fused = retrieval.rrf(halves, ["id"], settings.rrf_k)
    # one id may lie in several collections: the first by name answers
    one = metadata.newest(library.chunks.withColumn("_k", F.lit(0)), ["id"], "_k", "collection").drop("_k")
    rows = fused.join(one, "id").join(library.names(), "document_id", "left").withColumn("name", F.coalesce("name", "document_id"))
    return retrieval.top_k(retrieval.first_per(rows, SPAN, "rank").drop("rank"), scan, ["query_id"], F.round("score", 12).desc(), "id")


def _ranges_as_items(spans: DataFrame) -> DataFrame:
    return spans.select("query_id", F.col("rank").cast("long").alias("item"), "rank", "score", "alone", "collection", "document_id", "seq_start", "seq_end", "char_start", "char_end", "chunks")


def _led(spans: DataFrame, limit: int | None, settings: SearchSettings, spaces: collapse.Spaces) -> DataFrame:
    """spans, those that lead a slot only, with the slot's score and place and how many places it stands for."""
    fold = scratch(collapse.folded_results(_ranges_as_items(spans), limit, spaces), "fold")
    n = collapse.places(fold).select("query_id", F.col("item").cast("int").alias("rank"), "places")
    lead = fold.where("slot is not null").select("query_id", F.col("item").cast("int").alias("rank"), "slot", F.col("score").alias("_score"))
    return spans.drop("score").join(lead, ["query_id", "rank"]).join(n, ["query_id", "rank"]).drop("rank").withColumnsRenamed({"slot": "rank", "_score": "score"})


def explore(library: Library, questions: DataFrame, settings: SearchSettings = SearchSettings(), kind: str = "chunk", spaces: collapse.Spaces = collapse.Spaces()) -> DataFrame:
    """Chunks or passages, best first, near copies folded under the better one; passages too short to stand alone are grown or left out."""
    rows = scratch(ranked(library, questions, settings, kind), "ranked")
    if kind == "passage":
        grown = scratch(growth.judged(rows, library.chunks, questions, settings, grows=True, vectors=spaces.chunk is not None), "spans")
        found = _led(grown.where("not alone"), settings.limit, settings, spaces)
        cited = C.citation(F.col("name"), F.col("page_start"), F.col("page_end"), F.col("line_start"), F.col("line_end"))
        return passages.quotes(found.withColumn("citation", cited).drop("chunks"), library.documents.select("document_id", "text"))
    items = rows.select("query_id", F.col("rank").cast("long").alias("item"), "rank", "score", F.lit(False).alias("alone"), "collection", "document_id", F.col("seq").alias("seq_start"), F.col("seq").alias("seq_end"), "char_start", "char_end", F.array(F.struct("text", "vector")).alias("chunks"))
    fold = collapse.folded_results(items, settings.limit, spaces).drop("score")
    return rows.join(fold, (rows.query_id == fold.query_id) & (rows["rank"] == fold["item"])).drop(fold.query_id)


PASSAGE = ["query_id", "collection", "document_id", "position"]
RANGE = ["query_id", "rank", "collection", "document_id", "seq_start", "seq_end", "char_start", "char_end", "score", "alone", "owed"]


def _costs(rows: DataFrame) -> DataFrame:
    """rows with what a passage costs, and what its section costs with the first one of it."""
    cost = sections.passage_cost(F.col("char_end") - F.col("char_start"))
    return rows.withColumns({"cost": cost, "header_cost": sections.excerpt_cost(F.array().cast("array<string>"), F.array().cast("array<bigint>"))})


def _within(rows: DataFrame, settings: SearchSettings) -> DataFrame:
    kept = sections.within_budget(_costs(rows).select("query_id", "group_rank", "rank", "cost", "header_cost", "alone", "first"), settings.answer_budget_chars)
    return rows.join(kept.where("kept").drop("kept"), ["query_id", "group_rank", "rank"])


def _with_probe(library: Library, questions: DataFrame, kept: DataFrame, runs: DataFrame, settings: SearchSettings) -> DataFrame:
    """What is kept of each section, and where a question has words that none of it holds, the best chunk that full text finds for them: it takes its
    room first, as the only evidence there is."""
    seqs = kept.select("query_id", "collection", "document_id", F.explode(F.sequence("seq_start", "seq_end")).alias("seq"))
    held = scratch(seqs.join(library.chunks.select(*KEY, "text", "headings"), KEY), "held")
    texts = held.select("query_id", F.concat_ws(" ", "text", F.array_join("headings", " ")).alias("text"))
    missing = sections.missing_terms(questions.join(kept.select("query_id").distinct(), "query_id"), texts).distinct()
    best = scratch(extras.probes(missing, library.by_place(), held.select("query_id", *KEY)).select("query_id", *KEY), "probes")
    spans = best.join(library.chunks.select(*KEY, "char_start", "char_end"), KEY).select("query_id", "collection", "document_id", F.col("seq").alias("seq_start"), F.col("seq").alias("seq_end"), "char_start", "char_end")
    placed = sections.section_of(spans, runs, settings.max_section_chars).select(*PASSAGE, "path", "s_start", "s_end", "seq_start", "seq_end", "char_start", "char_end")
    groups = kept.groupBy(*PASSAGE).agg(F.first("group_rank").alias("_own"))
    last = kept.groupBy("query_id").agg(F.max("group_rank").alias("_last"), F.max("rank").alias("_rank"))
    found = placed.join(groups, PASSAGE, "left").join(last, "query_id")
    found = found.select(*PASSAGE, "path", "s_start", "s_end", "seq_start", "seq_end", "char_start", "char_end", F.coalesce("_own", F.col("_last") + 1).alias("group_rank"), (F.col("_rank") + 1).alias("rank"),
                         F.lit(0.0).alias("score"), F.lit(False).alias("alone"), F.lit(False).alias("owed"), F.lit(True).alias("first"))
    return kept.unionByName(found)


def excerpts(library: Library, questions: DataFrame, settings: SearchSettings = SearchSettings(), spaces: collapse.Spaces = collapse.Spaces()) -> DataFrame:
    """(query_id, collection, document_id, position, group_rank, text, score, spans, missing_terms): what the best sections say on each question.

    Hits become passages; short ones are judged by what is around them; near copies are folded; what is left falls into sections, of which the first `limit`
    are kept, as far as the budget has room; words that none of it holds are looked for; the text around and between passages is filled in where it answers
    too and fits; sections of which nothing stands are dropped. missing_terms are the words of the question that no excerpt holds in the end.
    """
    rows = scratch(ranked(library, questions, settings, "section"), "ranked")
    spans = scratch(growth.judged(rows, library.chunks, questions, settings, grows=False, vectors=spaces.chunk is not None), "spans")
    return assembled(library, questions, _led(spans, None, settings, spaces).select(*RANGE), settings)


def assembled(library: Library, questions: DataFrame, found: DataFrame, settings: SearchSettings) -> DataFrame:
    """Excerpts, as of excerpts(), from folded ranges; questions may have several rows of one query_id, the parts of one request."""
    runs = library.runs()
    placed = scratch(sections.section_of(found, runs, settings.max_section_chars), "placed")
    groups = sections.grouped(placed, settings.limit).select(*PASSAGE, F.col("rank").alias("group_rank"))
    own = placed.join(groups, PASSAGE).select(*PASSAGE, "path", "s_start", "s_end", "seq_start", "seq_end", "char_start", "char_end", "group_rank", "rank", "score", "alone", "owed", F.lit(False).alias("first"))
    kept = scratch(_within(own, settings), "kept")
    kept = scratch(_within(_with_probe(library, questions, kept, runs, settings), settings), "kept")
    spent = _costs(kept).groupBy(*PASSAGE).agg((F.sum("cost") + F.first("header_cost")).alias("c")).groupBy("query_id").agg(F.sum("c").alias("cost"))
    full = scratch(growth.filled(kept.join(spent, "query_id"), library.chunks, questions, settings), "filled")
    first = library.chunks.select("collection", "document_id", F.col("seq").alias("seq_start"), "headings")
    heads = kept.select(*PASSAGE, "path").distinct()
    shown = full.join(heads, PASSAGE).join(first, ["collection", "document_id", "seq_start"])
    quoted = scratch(passages.quotes(shown, library.documents.select("document_id", "text")), "quoted")
    texts = sections.excerpts(quoted, under="path")
    by = quoted.groupBy(*PASSAGE).agg(F.min("group_rank").alias("group_rank"), F.max("score").alias("score"), F.count("*").cast("int").alias("spans"), F.array_join(F.flatten(F.collect_list("headings")), " ").alias("_heads"))
    texts = scratch(texts.join(by, PASSAGE), "excerpts")
    missing = sections.missing_terms(questions, texts.select("query_id", F.concat_ws(" ", "text", "_heads").alias("text"))).groupBy("query_id").agg(F.sort_array(F.collect_set("term")).alias("missing_terms"))
    return texts.drop("_heads").join(missing, "query_id", "left").withColumn("missing_terms", F.coalesce("missing_terms", F.array().cast("array<string>")))


def report(questions: DataFrame, answered: DataFrame) -> DataFrame:
    """(query_id, excerpts, missing_terms, uncovered): one row for every question, answered or not."""
    by = answered.groupBy("query_id").agg(F.count("*").alias("excerpts"), F.first("missing_terms").alias("_missing"))
    rows = questions.join(by, "query_id", "left")
    every = C.question_terms("question")
    return rows.select("query_id", F.coalesce("excerpts", F.lit(0)).alias("excerpts"), F.coalesce("_missing", F.sort_array(every)).alias("missing_terms"), F.col("excerpts").isNull().alias("uncovered"))


def several(library: Library, requests: DataFrame, settings: SearchSettings = SearchSettings(), spaces: collapse.Spaces = collapse.Spaces()) -> tuple[DataFrame, DataFrame]:
    """(excerpts, tags) for requests of several questions: excerpts as of excerpts() with the request as query_id, and tags(query_id, rank, aspects, aspect_scores) of the
    ranges that they are made from.

    requests(request_id, part, question[, vector]): the parts of a request, at most MAX_QUESTIONS, numbered from 0. Each part is ranked on its own; their ranges take turns,
    near copies are folded across the parts, and a range answers the parts that picked it, or rank it or what is folded into it among their own best.
    """
    asked = requests.withColumn("query_id", F.col("request_id") * mapping.MAX_QUESTIONS + F.col("part"))
    extra = ["vector"] if "vector" in requests.columns else []
    own = asked.select("query_id", "question", *extra)
    rows = scratch(ranked(library, own, settings, "section"), "ranked")
    request = F.floor(F.col("query_id") / mapping.MAX_QUESTIONS).alias("request_id")
    spans = scratch(growth.judged(rows, library.chunks, own, settings, grows=False, vectors=False).withColumns({"request_id": request, "part": F.pmod("query_id", F.lit(mapping.MAX_QUESTIONS)).cast("int"), "item": F.xxhash64("query_id", "rank")}), "spans")
    ends = spans.join(library.chunks.select("collection", "document_id", F.col("seq").alias("seq_end"), "end_reason"), ["collection", "document_id", "seq_end"], "left")
    picks = scratch(mapping.interleaved(ends, settings.limit, settings.scan("section")[0]), "picks")
    # the ranges of one pick are one range: its chunks once each, its score the fold of theirs
    parts = picks.join(spans.drop("request_id", "part"), "item")
    whole = parts.groupBy("request_id", "slot").agg(
        F.first("collection").alias("collection"), F.first("document_id").alias("document_id"), F.min("seq_start").alias("seq_start"), F.max("seq_end").alias("seq_end"), F.min("char_start").alias("char_start"),
        F.max("char_end").alias("char_end"), F.max("score").alias("score"), F.bool_and("alone").alias("alone"), F.bool_and("owed").alias("owed"), F.first("answers").alias("answers"),
    )
    text = library.chunks.select("collection", "document_id", "seq", F.struct("text", "vector").alias("chunk"))
    held = whole.select("request_id", "slot", "collection", "document_id", F.explode(F.sequence("seq_start", "seq_end")).alias("seq")).join(text, KEY)
    chunks = held.groupBy("request_id", "slot").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "chunk"))), lambda x: x["chunk"]).alias("chunks"))
    ranges = scratch(whole.join(chunks, ["request_id", "slot"]).withColumnsRenamed({"request_id": "query_id", "slot": "rank"}), "ranges")
    fold = scratch(collapse.folded_results(_ranges_as_items(ranges), None, spaces), "fold")
    root = fold.select("query_id", F.col("item").cast("int").alias("rank"), F.coalesce("root", "item").cast("int").alias("lead"))
    held = ranges.join(root, ["query_id", "rank"])
    aspects = held.groupBy("query_id", "lead").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("answers")))).alias("aspects"))
    scored = rows.select(F.floor(F.col("query_id") / mapping.MAX_QUESTIONS).alias("query_id"), F.pmod("query_id", F.lit(mapping.MAX_QUESTIONS)).cast("int").alias("part"), *KEY, F.col("score").alias("s"))
    at = held.select("query_id", "lead", "collection", "document_id", F.explode(F.sequence("seq_start", "seq_end")).alias("seq")).join(scored, ["query_id", *KEY])
    best = at.groupBy("query_id", "lead", "part").agg(F.max("s").alias("s")).groupBy("query_id", "lead").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("part", "s")))).alias("aspect_scores"))
    led = _led(ranges, None, settings, spaces)
    order = fold.where("slot is not null").select("query_id", F.col("item").cast("int").alias("lead"), F.col("slot").alias("rank"))
    tags = order.join(aspects, ["query_id", "lead"]).join(best, ["query_id", "lead"], "left").drop("lead")
    joined = asked.select(F.col("request_id").alias("query_id"), "question", *extra)
    return assembled(library, joined, led.select(*RANGE), settings), tags


def section_map(library: Library, questions: DataFrame, settings: SearchSettings = SearchSettings(limit=15)) -> DataFrame:
    """(query_id, collection, document_id, position, path, s_start, s_end, pick, lead, similarity, score, chunks, coverage, capped): sections that cover what was found, and those
    related to them. A section that lies in two collections counts once, by its span of the document."""
    rows = scratch(ranked(library, questions, settings, "section"), "ranked")
    found = rows.select("query_id", "rank", "collection", "document_id", F.col("seq").alias("seq_start"), "score", "vector", "text")
    placed = sections.section_of(found, library.runs(), settings.max_section_chars)
    centre = metadata.mean_vector(library.chunks.where("vector is not null").withColumn("_all", F.lit(1)), ["_all"], "vector").select(F.col("vector").alias("centre"))
    centred = placed.crossJoin(F.broadcast(centre)).withColumn("vector", C.unit(F.zip_with(C.unit("vector"), "centre", lambda x, y: x - y)))  # one row
    items = scratch(centred.withColumn("item", F.xxhash64("document_id", "s_char_start", "s_char_end")), "items")
    cover = mapping.covered(items.select("query_id", "rank", "item", "document_id", "score", "vector", "text"), settings.limit, settings.score_fold)
    first = items.groupBy("query_id", "item").agg(F.min_by(F.struct("collection", "document_id", "position", "path", "s_start", "s_end"), "rank").alias("x")).select("query_id", "item", "x.*")
    return first.join(cover, ["query_id", "item"])


def map_documents(library: Library, questions: DataFrame, mapped: DataFrame, settings: SearchSettings = SearchSettings(limit=15)) -> DataFrame:
    """(query_id, rank, document_id, name, score, hits, sections, collections, description): the documents that a map lists."""
    rows = ranked(library, questions, settings, "section")
    by = passages.top_documents(rows, settings.score_fold, k=settings.scan("section")[0])
    listed = mapping.documents_listed(by, mapped.where("pick is not null").select("query_id", "document_id"))
    about = library.documents.groupBy("document_id").agg(F.max("description").alias("description"))
    return mapping.memberships(listed, library.chunks.select("collection", "document_id")).join(about, "document_id", "left").withColumn("description", F.coalesce("description", F.lit("")))


def log_rows(questions: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What the log keeps of a batch: (id, question, result_count) and (search_id, position, collection, document, seq_start, seq_end, score)."""
    n = results.groupBy("query_id").agg(F.count("*").alias("result_count"))
    asked = questions.join(n, "query_id", "left").select(F.col("query_id").alias("id"), "question", F.coalesce("result_count", F.lit(0)).alias("result_count"))
    return asked, results.select(F.col("query_id").alias("search_id"), (F.col("rank") - 1).alias("position"), "collection", F.col("name").alias("document"), "seq_start", "seq_end", "score")


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "eval_items").where("question is not null").select(F.col("item_id").alias("query_id"), "question")


def _with_vectors(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "search_questions").where("query_vector is not null and trim(question) <> ''").select(F.col("id").alias("query_id"), "question", F.col("query_vector").alias("vector"))


def answer_chunks(spark: SparkSession, d: str) -> DataFrame:
    found = explore(Library.of(spark, d), _questions(spark, d))
    return found.select("query_id", "rank", *KEY, F.round("score", 6).alias("score"), "slot", "lead", "relation", F.round("similarity", 6).alias("similarity"))


def answer_passages(spark: SparkSession, d: str) -> DataFrame:
    found = explore(Library.of(spark, d), _questions(spark, d), kind="passage")
    return found.select("query_id", "rank", "citation", F.round("score", 6).alias("score"), "quote")


def answer_excerpts(spark: SparkSession, d: str) -> DataFrame:
    return excerpts(Library.of(spark, d), _questions(spark, d)).withColumn("score", F.round("score", 6))


def answer_report(spark: SparkSession, d: str) -> DataFrame:
    """What each question's excerpts leave out."""
    asked = _questions(spark, d)
    return report(asked, excerpts(Library.of(spark, d), asked))


def answer_sections(spark: SparkSession, d: str) -> DataFrame:
    found = section_map(Library.of(spark, d), _with_vectors(spark, d))
    return found.withColumns({c: F.round(c, 6) for c in ("similarity", "score", "coverage")})


def answer_map_documents(spark: SparkSession, d: str) -> DataFrame:
    """The documents that the maps of logged questions list."""
    library, asked = Library.of(spark, d), _with_vectors(spark, d)
    return map_documents(library, asked, section_map(library, asked)).withColumn("score", F.round("score", 6))


def _requests(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation questions of one shelf, three at a time, as one request."""
    w = Window.partitionBy("shelf").orderBy("item_id")
    rows = load(spark, d, "eval_items").where("question is not null").withColumn("n", F.row_number().over(w) - 1)
    return rows.select(F.floor(F.pmod(F.crc32("shelf"), F.lit(1000)) * 1000 + F.col("n") / 3).alias("request_id"), F.pmod("n", F.lit(3)).cast("int").alias("part"), "question")


def answer_several(spark: SparkSession, d: str) -> DataFrame:
    """Excerpts for requests of three questions each."""
    return several(Library.of(spark, d), _requests(spark, d))[0].withColumn("score", F.round("score", 6))


def answer_aspects(spark: SparkSession, d: str) -> DataFrame:
    """Which questions of a request each of its ranges answers."""
    tags = several(Library.of(spark, d), _requests(spark, d))[1]
    return tags.select("query_id", "rank", F.array_join(F.transform("aspects", lambda x: x.cast("string")), ",").alias("aspects"), F.round(F.array_max(F.map_values("aspect_scores")), 6).alias("best"))


def queries() -> dict:
    return {f.__name__: f for f in (answer_chunks, answer_passages, answer_excerpts, answer_report, answer_sections, answer_map_documents, answer_several, answer_aspects)}
