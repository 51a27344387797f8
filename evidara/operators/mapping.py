"""A map of sections that covers what was found, and several questions that take turns at the slots of one answer.

Both are one bounded group for each query or request: at most MAX_SCAN chunks of a query, and as many ranges of each of at most MAX_QUESTIONS parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidara.operators.collapse import ALIKE, Measured
from evidara.operators.frames import frame
from evidara.operators.growth import folded_score
from evidara.settings import MAX_SCAN

#: Sections of one document while there are others of at least this part of the best gain.
PER_DOCUMENT, CAP_GAIN = 2, 0.5
RELATED, DOCUMENTS = 5, 10
MAX_QUESTIONS, MAX_QUESTION, MAX_CONTEXT = 5, 500, 200

COVERED = "query_id long, item long, pick int, lead long, similarity double, score double, chunks int, coverage double, capped boolean"


def covered(hits: DataFrame, limit: int, fold: str = "sum") -> DataFrame:
    """(query_id, item, pick, lead, similarity, score, chunks, coverage, capped): each query's sections, picked so that what was hit is covered, and those related to a pick.

    hits(query_id, rank, item, document_id, score, vector, text): the chunks that were hit, item being the section of each; vectors are about the corpus' centre.
    A section covers a chunk as closely as its nearest chunk that was hit lies to it; a chunk asks for as much as it scores. First comes the section
    of the best score, then whichever covers most of what is asked for and not covered yet, but of one document no more than PER_DOCUMENT while another
    section gains CAP_GAIN of the best. A section that was not picked is related to the pick that covers its own chunks best, at most RELATED to each. Where
    a chunk has no vector, sections come by score under the same cap, and repeat a pick by their words.
    pick counts from 1; coverage is the part that is covered after a pick; capped tells a pick beyond the cap.
    """
    # texts are looked at where a vector is missing only
    whole = F.max(F.col("vector").isNull().cast("int")).over(Window.partitionBy("query_id")) == 0
    rows = hits.where(F.col("rank") <= MAX_SCAN).withColumn("text", F.when(~whole, F.col("text")))
    fields = ["rank", "item", "document_id", "score", "text"]
    listed = rows.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct(*fields, F.col("vector").cast("array<float>").alias("vector")))).alias("rows"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out: list[tuple] = []
            ends, flat = b.column("rows").offsets.to_pylist(), b.column("rows").values
            columns = {c: flat.field(c).to_pylist() for c in fields}
            cuts, values, known = flat.field("vector").offsets.to_numpy(), flat.field("vector").values.to_numpy(), flat.field("vector").is_valid().to_pylist()
            for q, a, z in zip(b.column("query_id").to_pylist(), ends, ends[1:]):
                own = [{**{c: v[i] for c, v in columns.items()}, "vector": values[cuts[i] : cuts[i + 1]] if known[i] else None} for i in range(a, z)]
                out += [(q, *r) for r in mapped(own, limit, fold)]
            if out:
                yield pa.RecordBatch.from_pandas(frame(out, COVERED), preserve_index=False)

    return listed.mapInArrow(run, COVERED)


def mapped(rows: list, limit: int, fold: str) -> list[tuple]:
    """Rows as of COVERED, but for the query, of one query's hits, best first."""
    at: dict = {}
    for n, r in enumerate(rows):
        at.setdefault(r["item"], []).append(n)
    names, own = list(at), list(at.values())
    documents = [rows[a[0]]["document_id"] for a in own]
    scores = [folded_score([rows[n]["score"] for n in a], fold) for a in own]
    if all(r["vector"] is not None for r in rows):
        near, demand = nearness([r["vector"] for r in rows], own), np.array([float(r["score"]) for r in rows])
        demand = demand / demand.sum() if demand.sum() > 0 else np.full(len(rows), 1 / len(rows))
        picks = cover(demand, near, scores, documents, limit)
        related = relations(demand, near, own, [p for p, _, _ in picks])
    else:
        alike = Measured.by_words([{"chunks": [{"text": rows[n]["text"]} for n in a]} for a in own]).alike
        picks, related = by_score(scores, alike, documents, limit)
    out = [(names[p], n, None, None, float(scores[p]), len(own[p]), c, bool(extra)) for n, (p, c, extra) in enumerate(picks, 1)]
    return out + [(names[s], None, names[p], float(like), float(scores[s]), len(own[s]), None, None) for p, found in related.items() for s, like in found[:RELATED]]


def nearness(vectors: list, own: list[list[int]]) -> np.ndarray:
    """How closely each section, as the chunks that it has, covers each chunk: rows are chunks."""
    v = np.array([np.asarray(x, float) for x in vectors])
    v /= np.where((n := np.linalg.norm(v, axis=1, keepdims=True)) > 0, n, 1)
    near = np.clip(v @ v.T, 0, 1)
    flat = [i for a in own for i in a]
    return np.maximum.reduceat(near[:, flat], np.cumsum([0] + [len(a) for a in own[:-1]]), axis=1)


def cover(demand: np.ndarray, near: np.ndarray, scores: list[float], documents: list, limit: int) -> list[tuple[int, float, bool]]:
    """(section, what is covered with it, whether it is beyond its document's cap) in the order picked; none that covers nothing new."""
    picks: list[tuple[int, float, bool]] = []
    held, used = np.zeros(len(demand)), dict.fromkeys(documents, 0)
    open_ = np.ones(len(scores), bool)
    while open_.any() and len(picks) < limit:
        if picks:
            gain = np.where(open_, demand @ np.maximum(near - held[:, None], 0), 0.0)
            fresh = gain > 1e-12
            if not fresh.any():
                break
            fair = fresh & (gain >= CAP_GAIN * gain.max()) & np.array([used[d] < PER_DOCUMENT for d in documents])
            best, beyond = int(np.argmax(np.where(fair if fair.any() else fresh, np.round(gain, 12), -1))), not fair.any()
        else:
            best, beyond = int(np.argmax(scores)), False
        open_[best] = False
        used[documents[best]] += 1
        held = np.maximum(held, near[:, best])
        picks.append((best, float(demand @ held), beyond))
    return picks


def relations(demand: np.ndarray, near: np.ndarray, own: list[list[int]], picks: list[int]) -> dict[int, list[tuple[int, float]]]:
    """For each pick the sections it covers best, the closest first: how closely it covers their chunks, each by what it asks for."""
    found: dict[int, list[tuple[int, float]]] = {p: [] for p in picks}
    for s, a in enumerate(own):
        if s not in found:
            like = np.round(demand[a] @ near[np.ix_(a, picks)] / max(float(demand[a].sum()), 1e-12), 12)
            if like.max() > 0:
                found[picks[int(np.argmax(like))]].append((s, float(like.max())))
    return {p: sorted(rest, key=lambda x: -x[1]) for p, rest in found.items()}


def by_score(scores: list[float], alike: np.ndarray, documents: list, limit: int) -> tuple[list[tuple[int, None, bool]], dict[int, list[tuple[int, float]]]]:
    """Picks as of cover, and relations, by score and words: what repeats a pick goes under it; what the cap holds back waits until all others had their turn."""
    picks: list[tuple[int, None, bool]] = []
    related: dict[int, list[tuple[int, float]]] = {}
    waiting = sorted(range(len(scores)), key=lambda s: -scores[s])
    for beyond in (False, True):
        queue, waiting = waiting, []
        for s in queue:
            repeated = next((p for p, _, _ in picks if alike[s, p] >= ALIKE), None)
            if repeated is not None:
                related[repeated].append((s, float(alike[s, repeated])))
            elif len(picks) < limit and (beyond or sum(documents[p] == documents[s] for p, _, _ in picks) < PER_DOCUMENT):
                picks.append((s, None, beyond))
                related[s] = []
            else:
                waiting.append(s)
    return picks, related


def related(cover: DataFrame) -> DataFrame:
    """The sections most related to each pick, n counting from 1."""
    w = Window.partitionBy("query_id", "lead").orderBy(F.desc("similarity"), "item")
    return cover.where("pick is null").withColumn("n", F.row_number().over(w))


def documents_listed(ranked: DataFrame, mapped: DataFrame) -> DataFrame:
    """ranked(query_id, document_id, rank, ...), the best DOCUMENTS of each query and those of a mapped section, with how many mapped sections each has."""
    n = mapped.groupBy("query_id", "document_id").agg(F.count("*").alias("sections"))
    return ranked.join(n, ["query_id", "document_id"], "left").withColumn("sections", F.coalesce("sections", F.lit(0))).where((F.col("rank") <= DOCUMENTS) | (F.col("sections") > 0))


def memberships(documents: DataFrame, members: DataFrame) -> DataFrame:
    """documents with collections: all that hold each, by name. members(collection, document_id)."""
    held = members.distinct().groupBy("document_id").agg(F.sort_array(F.collect_set("collection")).alias("collections"))
    return documents.join(held, "document_id", "left")


# --- several questions


def validated(requests: DataFrame) -> DataFrame:
    """(request_id, parts, context, problem): the questions of each request, trimmed, each once in order and none blank, or what is wrong with it.

    requests(request_id, questions array<string>, context)."""
    parts = F.array_distinct(F.filter(F.transform("questions", lambda q: F.trim(q)), lambda q: F.length(q) > 0))
    context = F.when(F.length(F.trim("context")) > 0, F.trim("context"))
    rows = requests.select("request_id", F.coalesce(parts, F.array().cast("array<string>")).alias("parts"), context.alias("context"))
    problem = (
        F.when((F.size("parts") < 1) | (F.size("parts") > MAX_QUESTIONS), F.lit("number of questions"))
        .when(F.exists("parts", lambda q: F.length(q) > MAX_QUESTION), F.lit("length of a question"))
        .when(F.length("context") > MAX_CONTEXT, F.lit("length of the context"))
    )
    return rows.withColumn("problem", problem)


def depth(limit: Column | int, parts: Column) -> Column:
    """How many of its own best each part is owed of an answer's slots; null where there are fewer slots than parts."""
    limit = F.lit(limit) if isinstance(limit, int) else limit
    return F.when(limit >= parts, F.ceil(limit / parts)).cast("int")


PICKS = "request_id long, slot int, part int, item long, joined boolean, answers array<int>"


def interleaved(candidates: DataFrame, limit: int, cap: int = MAX_SCAN) -> DataFrame:
    """Rows as of PICKS: the ranges of several questions taken in turn, at most `cap` picks of a request.

    candidates(request_id, part, rank, item, collection, document_id, seq_start, seq_end, end_reason). Round after round, each part takes its next range, unless more
    picks are among its own best than rounds are past: its share of `limit` is owed to it, by whichever part it was picked. A range over a pick, or right beside
    one in the same section, joins it instead of taking a slot; several such picks become one, in the earliest's place. answers are the parts that
    picked or joined a slot, or have it among their own best.
    """
    fields = ["part", "rank", "item", "collection", "document_id", "seq_start", "seq_end", "end_reason"]
    listed = candidates.where(F.col("rank") <= MAX_SCAN).groupBy("request_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("rows"))

    def run(it):
        for own in it:
            out: list[tuple] = []
            for r, rows in zip(own.request_id, own.rows):
                for slot, pick in enumerate(take_turns(list(rows), limit, cap), 1):
                    out += [(r, slot, x["part"], x["item"], n > 0, sorted(pick.parts)) for n, x in enumerate(pick.taken)]
            yield frame(out, PICKS)

    return listed.mapInPandas(run, PICKS)


class Pick:
    """Ranges of one document that overlap or go on in one section, and the parts that they answer."""

    def __init__(self, taken: list, best: dict[int, list]):
        self.taken = taken
        self.start, self.end = min(x["seq_start"] for x in taken), max(x["seq_end"] for x in taken)
        self.closed = any(x["seq_end"] == self.end and x["end_reason"] == "heading" for x in taken)
        self.place = (taken[0]["collection"], taken[0]["document_id"])
        self.high = {p for p, own in best.items() if any(self.over(x) for x in own)}
        self.parts = self.high | {x["part"] for x in taken}

    def over(self, x) -> bool:
        return self.place == (x["collection"], x["document_id"]) and self.start <= x["seq_end"] and x["seq_start"] <= self.end

    def met_by(self, x) -> bool:
        beside = (self.end + 1 == x["seq_start"] and not self.closed) or (x["seq_end"] + 1 == self.start and x["end_reason"] != "heading")
        return self.over(x) or (self.place == (x["collection"], x["document_id"]) and beside)


def take_turns(rows: list, limit: int, cap: int) -> list[Pick]:
    queues: dict[int, list] = {}
    for r in rows:
        queues.setdefault(r["part"], []).append(r)
    owed = -(-limit // max(1, len(queues)))
    best = {part: own[:owed] for part, own in queues.items()}
    left = {part: iter(own) for part, own in sorted(queues.items())}
    picks: list[Pick] = []
    past = 0
    while left and len(picks) < cap:
        for part in list(left):
            if len(picks) >= cap or sum(part in p.high for p in picks) > past:
                continue
            x = next(left[part], None)
            if x is None:
                del left[part]
                continue
            met = [n for n, p in enumerate(picks) if p.met_by(x)]
            if met:
                # in the order of the picks, so that the first one's ranges lead
                picks[met[0]] = Pick([y for n in met for y in picks[n].taken] + [x], best)
                picks = [p for n, p in enumerate(picks) if n not in met[1:]]
            else:
                picks.append(Pick([x], best))
        past += 1
    return picks
