"""Questions that the collections answer badly: signals, topics, reviews, reports."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidara.functions.columns import words
from evidara.session import scratch

#: Signals in the order in which the first that holds is taken.
SIGNALS = ["reported", "empty", "uncovered", "weak", "borderline"]
#: Seconds for which a report finds the question it is about.
REPORT_WINDOW = 3600


def signals(questions: DataFrame, searches: DataFrame, bars: DataFrame) -> DataFrame:
    """(question_id, signal): the first signal of each question, null for none.

    bars(embedding, weak_match, answered_match). A failed search gives no signal; one within a scope only what was reported. A null or
    empty list of similarities gives neither 'weak' nor 'borderline'.
    """
    own = searches.select(F.col("id").alias("search_id"), "embedding", "scoped", "result_count", "error", "session_id", "ts", "collections")
    rows = questions.withColumnRenamed("id", "question_id").join(own, "search_id").join(F.broadcast(bars), "embedding", "left")
    best = F.array_max("similarities").cast("double")
    open_ = F.coalesce(F.col("scoped"), F.lit(0)) == 0
    signal = (
        F.when(F.col("error").isNotNull(), F.lit(None))
        .when(F.col("agent_verdict").isNotNull(), "reported")
        .when(open_ & (F.col("result_count") == 0), "empty")
        .when(open_ & (F.col("uncovered") == 1), "uncovered")
        .when(open_ & (best < F.col("weak_match")), "weak")
        .when(open_ & (best < F.col("answered_match")), "borderline")
    )
    return rows.select("question_id", "search_id", "question", "query_vector", "embedding", "session_id", "ts", "collections", "review", signal.alias("signal"))


def word_topics(gaps: DataFrame) -> DataFrame:
    """(question_id, topic_id): questions of the same set of words are one topic, named by its newest question."""
    kinds = gaps.withColumn("kind", F.array_sort(F.array_distinct(words("question"))))
    newest = Window.partitionBy("kind").orderBy(F.desc("ts"), F.desc("question_id"))
    return kinds.select("question_id", F.first("question_id").over(newest).alias("topic_id"))


#: Gaps that one task clusters at a time.
BLOCK = 4096


def vector_topics(gaps: DataFrame, same_topic: float, block: int = BLOCK) -> DataFrame:
    """(question_id, topic_id): newest first, a question joins the closest earlier-made topic of its embedding over the bar, else makes its own.

    Gaps with the same words are one before that, so that repeats, however many, are compared once. What is left is clustered in blocks of about `block`
    from the newest on: a block is compared with all topics there are, by all tasks, and then with itself in order, in one task for each embedding.
    """
    kinds = gaps.where("query_vector is not null").withColumn("kind", F.array_sort(F.array_distinct(words("question"))))
    w = Window.partitionBy("embedding", "kind").orderBy(F.desc("ts"), F.desc("question_id"))
    kinds = scratch(kinds.withColumn("head", F.first("question_id").over(w)), "kinds")
    heads = scratch(kinds.where("question_id = head").select("embedding", "head", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("query_vector").cast("array<double>").alias("v")), "heads")
    n = -(-heads.count() // block)
    cuts = heads.agg(F.percentile_approx("at", [1 - i / n for i in range(1, n)], 100_000).alias("c")).first().c if n > 1 else []
    schema = "embedding string, head long, topic_id long, v array<double>"
    topics, found = None, []
    for low, high in zip([*cuts, None], [None, *cuts]):
        own = heads.where((F.col("at") > low) if low is not None else F.lit(True)).where((F.col("at") <= high) if high is not None else F.lit(True))
        near = _nearest_topics(own, topics, same_topic) if topics is not None else None
        own = own.join(near, "head", "left") if near is not None else own.withColumns({"known": F.lit(None).cast("long"), "cosine": F.lit(None).cast("double")})
        # a null embedding is one of its own
        made = scratch(own.groupBy("embedding").applyInPandas(lambda rows: _clustered(rows, same_topic), schema), "topics")
        found.append(made.select("head", "topic_id"))
        fresh = made.where("head = topic_id").select("embedding", "head", "v")
        topics = fresh if topics is None else topics.unionByName(fresh)
    every = reduce(DataFrame.unionByName, found)
    return kinds.select("question_id", "head").join(every, "head").select("question_id", "topic_id")


def _rows_of(vectors) -> np.ndarray:
    v = np.stack([np.asarray(x, float) for x in vectors])
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(n > 0, n, 1)


def _nearest_topics(own: DataFrame, topics: DataFrame, bar: float) -> DataFrame:
    """(head, known, cosine): the topic closest to each row of a block, of those over the bar."""
    part = own.select("embedding", "head", "v").toPandas()  # one block
    shared = own.sparkSession.sparkContext.broadcast(part)

    def run(it):
        asked = shared.value
        for b in it:
            for name, theirs in b.groupby("embedding", dropna=False):
                mine = asked[asked.embedding.isna() if pd.isna(name) else asked.embedding == name]
                if len(mine):
                    near = _rows_of(mine.v) @ _rows_of(theirs.v).T
                    best = near.argmax(1)
                    over = near[np.arange(len(near)), best] > bar
                    yield pd.DataFrame({"head": mine["head"].to_numpy()[over], "known": theirs["head"].to_numpy()[best[over]], "cosine": near.max(1)[over]})

    met = topics.mapInPandas(run, "head long, known long, cosine double")
    return met.groupBy("head").agg(F.max_by("known", F.struct("cosine", "known")).alias("known"), F.max("cosine").alias("cosine"))


def _clustered(rows: pd.DataFrame, bar: float) -> pd.DataFrame:
    rows = rows.sort_values(["at", "head"], ascending=False)
    v, ids = _rows_of(rows.v), rows["head"].to_numpy()
    made: list[int] = []
    topic = []
    for i, (known, cosine) in enumerate(zip(rows.known, rows.cosine)):
        near = v[made] @ v[i] if made else np.empty(0)
        j = int(np.argmax(near)) if made else -1
        best = near[j] if made else -2.0
        if not pd.isna(cosine) and cosine >= best:
            topic.append(int(known))
        elif best > bar:
            topic.append(int(ids[made[j]]))
        else:
            made.append(i)
            topic.append(int(ids[i]))
    return pd.DataFrame({"embedding": rows.embedding.to_numpy(), "head": ids, "topic_id": topic, "v": list(rows.v)})


def topic_summaries(gaps: DataFrame, topics: DataFrame) -> DataFrame:
    """(topic_id, questions, sessions, first_at, last_at, collections) by size, then newest; null sessions are not counted."""
    rows = gaps.join(topics, "question_id")
    each = rows.select("topic_id", F.explode("collections").alias("c")).distinct().groupBy("topic_id").agg(F.sort_array(F.collect_list("c")).alias("collections"))
    by = rows.groupBy("topic_id").agg(F.count("*").alias("questions"), F.count_distinct("session_id").alias("sessions"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))
    return by.join(each, "topic_id", "left").withColumn("collections", F.coalesce("collections", F.array().cast("array<string>")))


def near_misses(results: DataFrame, searches: DataFrame, k: int = 3) -> DataFrame:
    """(search_id, n, document, score): the best results of searches that were found wanting."""
    own = results.where("parent is null").join(searches.select(F.col("id").alias("search_id")).distinct(), "search_id", "left_semi").dropDuplicates(["search_id", "position"])
    w = Window.partitionBy("search_id").orderBy("position")
    return own.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).select("search_id", "n", "document", "score")


def reviewed(questions: DataFrame, ids: DataFrame, decision: str | None) -> DataFrame:
    """questions with the decision set, or cleared by None, on those of the given ids."""
    hit = questions.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    return hit.withColumn("review", F.when(F.col("_hit"), F.lit(decision)).otherwise(F.col("review"))).drop("_hit")


def reports(asked: DataFrame, questions: DataFrame, searches: DataFrame, window: int = REPORT_WINDOW) -> DataFrame:
    """(report_id, question_id): the newest question of the same session and text within the window before each report.

    asked(report_id, session_id, question, ts). Joined on session and text, so that the as-of part is a filter.
    """
    own = questions.join(searches.where("error is null").select(F.col("id").alias("search_id"), "session_id", F.col("ts").alias("asked_at")), "search_id")
    own = own.select(F.col("id").alias("question_id"), "session_id", F.trim("question").alias("question"), "asked_at")
    rows = asked.withColumn("question", F.trim("question")).join(own, ["session_id", "question"])
    inside = rows.where((F.col("asked_at") <= F.col("ts")) & (F.col("asked_at") >= F.col("ts") - F.expr(f"interval {window} seconds")))
    w = Window.partitionBy("report_id").orderBy(F.desc("asked_at"), F.desc("question_id"))
    return inside.withColumn("n", F.row_number().over(w)).where("n = 1").select("report_id", "question_id")
