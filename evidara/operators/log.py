"""The search log: searches, their questions and results, sessions, trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidara.session import few_rows

#: Similarities of a question that the log keeps.
KEPT_SIMILARITIES = 20
#: Series that a trend shows before the rest is 'other'.
SHOWN = 6


def loaded(searches: DataFrame, questions: DataFrame, since: str | None = None, session: str | None = None, ids: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Searches, newest first, each with its questions (one row without if it has none); ids: question ids that a search must have one of."""
    if since is not None:
        searches = searches.where(F.col("ts") >= F.lit(since).cast("timestamp"))
    if session is not None:
        searches = searches.where(F.col("session_id") == session)
    if ids is not None:
        searches = searches.join(questions.join(ids, "id", "left_semi").select(F.col("search_id").alias("id")).distinct(), "id", "left_semi")
    if limit is not None:
        searches = searches.orderBy(F.desc("ts"), F.desc("id")).limit(limit)
    own = questions.select(F.col("search_id").alias("id"), F.col("id").alias("question_id"), "position", "question")
    return searches.join(own, "id", "left")


def top_results(results: DataFrame, k: int) -> DataFrame:
    """The first k results of each search that stand on their own, by position; repeated rows count once."""
    own = results.where("parent is null").dropDuplicates(["search_id", "position"])
    w = Window.partitionBy("search_id").orderBy("position")
    return own.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k)


def history(searches: DataFrame, results: DataFrame) -> DataFrame:
    """(id, documents): the documents that each search found, each once, in order."""
    by = results.groupBy("search_id", "document").agg(F.min("position").alias("at"))
    listed = by.groupBy("search_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "document"))), lambda x: x["document"]).alias("documents"))
    return searches.join(listed, F.col("id") == F.col("search_id"), "left").select("id", F.coalesce("documents", F.array().cast("array<string>")).alias("documents"))


def tally(searches: DataFrame) -> DataFrame:
    """(session_id, searches, last_at): searches of each session; those without one are not counted."""
    return searches.where("session_id is not null").groupBy("session_id").agg(F.count("*").alias("searches"), F.max("ts").alias("last_at"))


def recent_questions(questions: DataFrame, searches: DataFrame, limit: int) -> DataFrame:
    """The last asked questions that are not blank, each once, trimmed."""
    asked = questions.select(F.col("search_id").alias("id"), F.trim("question").alias("question")).where("question <> ''")
    by = asked.join(searches.select("id", "ts"), "id").groupBy("question").agg(F.max("ts").alias("last_at"))
    return by.orderBy(F.desc("last_at"), "question").limit(limit)


def pruned(searches: DataFrame, children: DataFrame, days: int, now: str, key: str = "search_id") -> tuple[DataFrame, DataFrame]:
    """What is left of the searches and their children once those older than so many days are gone."""
    kept = searches.where(F.col("ts") >= F.lit(now).cast("timestamp") - F.expr(f"interval {days} days"))
    return kept, children.join(kept.select(F.col("id").alias(key)), key, "left_semi")


def session_summaries(searches: DataFrame, events: DataFrame) -> DataFrame:
    """(session_id, searches, events, last_at) from both sides, whichever there is; events(session_id, ts)."""
    found = tally(searches)
    happened = events.where("session_id is not null").groupBy("session_id").agg(F.count("*").alias("events"), F.max("ts").alias("event_at"))
    both = found.join(happened, "session_id", "full_outer")
    return both.select("session_id", F.coalesce("searches", F.lit(0)).alias("searches"), F.coalesce("events", F.lit(0)).alias("events"), F.greatest("last_at", "event_at").alias("last_at"))


def session_history(searches: DataFrame, events: DataFrame, session: str, limit: int = 100) -> DataFrame:
    """What happened in a session, newest first: searches and events in one list."""
    one = searches.where(F.col("session_id") == session).select("ts", F.lit("search").alias("kind"), F.col("tool").alias("what"), F.col("id"))
    two = events.where(F.col("session_id") == session).select("ts", F.lit("event").alias("kind"), F.col("event_type").alias("what"), F.col("event_id").alias("id"))
    return one.unionByName(two).orderBy(F.desc("ts"), "kind", "id").limit(limit)


def selections(sessions: DataFrame) -> DataFrame:
    """(session_id, collections): the collections of each session in their order, none where it has none. sessions(session_id, position, collection)."""
    listed = F.sort_array(F.collect_list(F.when(F.col("collection").isNotNull(), F.struct("position", "collection"))))
    return sessions.groupBy("session_id").agg(F.transform(listed, lambda x: x["collection"]).alias("collections"))


def similarities(cosines: DataFrame) -> DataFrame:
    """(question_id, similarities): the greatest cosines of the rows read for a question, in order. cosines(question_id, cosine)."""
    w = Window.partitionBy("question_id").orderBy(F.desc("cosine"))
    best = cosines.withColumn("n", F.row_number().over(w)).where(F.col("n") <= KEPT_SIMILARITIES)
    return best.groupBy("question_id").agg(F.sort_array(F.collect_list("cosine"), asc=False).alias("similarities"))


def trend(points: DataFrame, ts: str, series: str, unit: str, start: str, end: str, value: Column | None = None) -> DataFrame:
    """(bucket, series, n, rank, stacked): values per bucket of [start, end), zero where nothing is, for each shown series.

    The SHOWN greatest series are shown, by total and name; if there are more, one less and 'other' for the rest. stacked
    is the sum of a series and those under it.
    """
    inside = points.where((F.col(ts) >= F.lit(start).cast("timestamp")) & (F.col(ts) < F.lit(end).cast("timestamp")))
    counted = inside.groupBy(F.date_trunc(unit, ts).alias("bucket"), F.coalesce(F.col(series), F.lit("none")).alias("key")).agg(F.sum(value if value is not None else F.lit(1)).alias("n"))
    # one row for each series, so that the window is over few rows
    totals = counted.groupBy("key").agg(F.sum("n").alias("total"))
    order = Window.orderBy(F.desc("total"), "key")
    ranked = totals.withColumn("place", F.row_number().over(order)).withColumn("all", F.count("*").over(Window.partitionBy()))
    shown = F.when((F.col("all") > SHOWN) & (F.col("place") >= SHOWN), F.lit("other")).otherwise(F.col("key"))
    ranked = ranked.select("key", shown.alias("series"), F.least("place", F.lit(SHOWN)).alias("rank"))
    folded = counted.join(F.broadcast(ranked) if few_rows(ranked, 100_000) else ranked, "key").groupBy("bucket", "series", "rank").agg(F.sum("n").alias("n"))
    step = {"day": "interval 1 day", "hour": "interval 1 hour"}[unit]
    calendar = inside.sparkSession.range(1).select(F.explode(F.sequence(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp") - F.expr(step), F.expr(step))).alias("bucket"))
    grid = calendar.crossJoin(ranked.select("series", "rank").distinct())
    full = grid.join(folded, ["bucket", "series", "rank"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    under = Window.partitionBy("bucket").orderBy(F.desc("rank")).rowsBetween(Window.unboundedPreceding, 0)
    return full.withColumn("stacked", F.sum("n").over(under))
