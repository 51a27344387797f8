"""Joins over documents, collections, caches and sessions: who holds what, what is pending, what is looked up in batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidara.session import keep_keys

#: Names that callers may sort a page of documents by, and the columns that they mean.
SORTS = {"name": "name", "size": "size", "created": "created_at", "updated": "updated_at", "status": "status", "pages": "pages"}
#: Rows below which an index of vectors isn't worth its training; the growth after which it is trained anew.
LEAST_ROWS, TRAINED, GROWTH = 50_000, 256, 2


def at_keys(chunks: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The chunks at stated places; places that are not there give none."""
    return chunks.join(keys.select(*on).distinct(), on, "left_semi")


def as_hits(rows: DataFrame) -> DataFrame:
    """Chunk rows as hits: null paths as empty, the section that a chunk lies deepest in, and its heading path as a header."""
    none = F.array().cast("array<string>")
    return rows.withColumns({"headings": F.coalesce("headings", none), "section_id": F.coalesce(F.try_element_at("section_ids", F.lit(-1)), F.lit(""))}).withColumn("header", F.array_join("headings", " > "))


def with_collections(documents: DataFrame, members: DataFrame) -> DataFrame:
    """documents with collections, those that hold each by name; none is an empty list."""
    held = members.select("document_id", "collection").distinct().groupBy("document_id").agg(F.sort_array(F.collect_set("collection")).alias("collections"))
    return documents.join(held, "document_id", "left").withColumn("collections", F.coalesce("collections", F.array().cast("array<string>")))


def looked_up(rows: DataFrame, ids: DataFrame, key: str, column: str, where: Column | None = None) -> DataFrame:
    """(key, column) of many ids at once, of the rows for which where holds; ids without one are absent."""
    own = rows if where is None else rows.where(where)
    return keep_keys(own.select(key, column).distinct(), ids.select(key).distinct(), key)


def collection_info(members: DataFrame, chunks: DataFrame, state: str = "status") -> DataFrame:
    """(collection, documents, pending, chunks, parts, vectors): what each collection holds; one without chunks has 0 of them."""
    counted = members.groupBy("collection").agg(F.count_distinct("document_id").alias("documents"), F.count_distinct(F.when(F.col(state) != "imported", F.col("document_id"))).alias("pending"))
    held = chunks.groupBy("collection").agg(F.count("*").alias("chunks"), F.count_distinct("document_id", "part").alias("parts"), F.count("vector").alias("vectors"))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("chunks", "parts", "vectors")}
    return counted.join(held, "collection", "left").withColumns(zero)


def pending_collections(info: DataFrame) -> DataFrame:
    """Collections with documents that are not indexed yet."""
    return info.where("pending > 0").select("collection", "pending")


def id_walk(rows: DataFrame, key: str, after, size: int) -> DataFrame:
    """The next `size` ids after one, in order; null starts at the first."""
    own = rows.select(key).where(F.col(key).isNotNull()).distinct()
    return (own if after is None else own.where(F.col(key) > after)).orderBy(key).limit(size)


def sorted_page(rows: DataFrame, sort: str, size: int, offset: int = 0, descending: bool = False) -> DataFrame:
    """A page by one of SORTS, nulls last, ties by name; any other name is refused."""
    if sort not in SORTS:
        raise ValueError(f"documents are sorted by one of {', '.join(sorted(SORTS))}, not {sort!r}")
    column = F.col(SORTS[sort])
    return rows.orderBy(column.desc_nulls_last() if descending else column.asc_nulls_last(), "name").offset(offset).limit(size)


def indexed_caches(members: DataFrame) -> DataFrame:
    """(document_id, cache_id): the cache entry of each document that is indexed from one."""
    return members.where("status = 'indexed' and cache_id is not null").select("document_id", "cache_id").distinct()


def cached(wanted: DataFrame, entries: DataFrame, files: DataFrame) -> DataFrame:
    """The wanted cache ids that are there: an entry and a file, both."""
    return wanted.join(entries.select("cache_id").distinct(), "cache_id", "left_semi").join(files.select("cache_id").distinct(), "cache_id", "left_semi")


def members_added(members: DataFrame, new: DataFrame, documents: DataFrame, allowed: list[str]) -> DataFrame:
    """members with the new (collection, document_id) that are not there yet, of documents in an allowed status, as queued."""
    fit = documents.where(F.col("status").isin(allowed)).select("document_id").distinct()
    fresh = new.select("collection", "document_id").distinct().join(fit, "document_id", "left_semi").join(members.select("collection", "document_id"), ["collection", "document_id"], "left_anti")
    return members.select("collection", "document_id", "status").unionByName(fresh.withColumn("status", F.lit("queued")))


def loaded_models(resolved: DataFrame) -> DataFrame:
    """(reranker): every model that the collections' settings load, each once."""
    return resolved.where("reranker is not null and reranker <> 'none'").select("reranker").distinct()


def calibrations(models: DataFrame, known: DataFrame) -> DataFrame:
    """models(reranker) with their floor and beta curve; (0, 1, 1), which changes nothing, where there is none."""
    rows = models.join(known.select("reranker", "floor", "beta_a", "beta_b"), "reranker", "left")
    return rows.select("reranker", F.coalesce("floor", F.lit(0.0)).alias("floor"), F.coalesce("beta_a", F.lit(1.0)).alias("beta_a"), F.coalesce("beta_b", F.lit(1.0)).alias("beta_b"))


def origins(runs: DataFrame, searches: DataFrame) -> DataFrame:
    """(id, session_id): the session that each run came from; null where none is known."""
    return runs.select("id").distinct().join(searches.select("id", "session_id").distinct(), "id", "left")


def events_added(sessions: DataFrame, events: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sessions, events) with new(session_id, at, kind): a session that is not there yet is made, as of its first event."""
    first = new.where("session_id is not null").groupBy("session_id").agg(F.min("at").alias("created_at"))
    made = first.join(sessions.select("session_id"), "session_id", "left_anti")
    return sessions.select("session_id", "created_at").unionByName(made), events.select("session_id", "at", "kind").unionByName(new.where("session_id is not null").select("session_id", "at", "kind"))


def stale(rows: DataFrame, states: list[str], version: str, size: int) -> DataFrame:
    """Rows in one of the states that another version made, oldest first."""
    return rows.where(F.col("status").isin(states) & ~F.col("version").eqNullSafe(F.lit(version))).orderBy("created_at", "id").limit(size)


def weak_questions(questions: DataFrame, bars: DataFrame) -> DataFrame:
    """(id, search_id, weak): whether a question's best match lies under the bar that its model was measured at; never where there is no bar or match.

    questions(id, search_id, embedding, similarities), bars(embedding, weak_match).
    """
    best = F.array_max("similarities").cast("double")
    rows = questions.join(bars.select("embedding", "weak_match"), "embedding", "left")
    return rows.select("id", "search_id", F.coalesce(best < F.col("weak_match"), F.lit(False)).alias("weak"))


def answered_with_gaps(questions: DataFrame) -> DataFrame:
    """(search_id, uncovered): the questions of each search that are weak or that nothing covers, each once, in the order asked.

    questions(search_id, position, question, weak, uncovered).
    """
    own = questions.where("weak or uncovered").groupBy("search_id", "question").agg(F.min("position").alias("position"))
    return own.groupBy("search_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("position", "question"))), lambda x: x["question"]).alias("uncovered"))


def describe_order(sections: DataFrame) -> DataFrame:
    """sections with turn: the deepest are described first, in the order of their document."""
    from pyspark.sql import Window

    w = Window.partitionBy("collection", "document_id").orderBy(F.desc("depth"), "position")
    return sections.withColumn("turn", F.row_number().over(w))


def ann_due(rows: DataFrame, trained: DataFrame, least: int = LEAST_ROWS) -> DataFrame:
    """(collection, vectors, due): whether a collection's vectors should be indexed anew: enough of them, and no index yet or twice as many as it was trained on."""
    n = rows.groupBy("collection").agg(F.count("vector").alias("vectors")).join(trained.select("collection", "trained"), "collection", "left")
    return n.select("collection", "vectors", ((F.col("vectors") >= max(least, TRAINED)) & (F.col("trained").isNull() | (F.col("vectors") >= GROWTH * F.col("trained")))).alias("due"))


def without(rows: DataFrame, leaving: DataFrame, key: str) -> DataFrame:
    """rows but for what is leaving."""
    return rows.join(leaving.select(key).distinct(), key, "left_anti")


def kept_children(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Children of parents that are kept."""
    return children.join(parents.select(F.col(parent_key).alias(child_key)).distinct(), child_key, "left_semi")


def shortened(vector: Column, dims: int) -> Column:
    """The first dims numbers of a vector, at unit length again."""
    from evidara.functions.columns import unit

    return unit(F.slice(vector, 1, dims))


def parts_deleted(chunks: DataFrame, document_id: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """chunks without those of a document, or of a range of its parts."""
    gone = F.col("document_id") == document_id
    if first is not None:
        gone = gone & (F.col("part") >= first)
    if last is not None:
        gone = gone & (F.col("part") <= last)
    return chunks.where(~gone)
