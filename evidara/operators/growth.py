"""Passages that are too short, and the text beside and between passages: what of it answers too, and who takes it.

A neighbouring chunk is worth what its match lies above the middle of the chunks that were ranked: 0 there, 1 at the best. A stretch of
neighbours is taken where its values sum up to more than nothing, so that a weak chunk comes in only if stronger ones behind it pay.
Every step is one bounded group for each query: what was scanned (at most MAX_SCAN rows) and a few chunks on each side.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from itertools import accumulate, groupby

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidara.functions.columns import STOPWORDS, words
from evidara.operators.collapse import LEAST_WORDS
from evidara.operators.frames import frame
from evidara.settings import MAX_SCAN, SearchSettings

WORD = re.compile(r"[^\W_]+")
STOPPED = frozenset(STOPWORDS)
CLOSED = {"heading", "document", "edge"}
PLACE = ["collection", "document_id", "seq"]
CHUNK = [*PLACE, "char_start", "char_end", "line_start", "line_end", "page_start", "page_end", "start_reason", "end_reason", "text", "vector"]


def key_of(c) -> tuple[str, str, int]:
    return c["collection"], c["document_id"], c["seq"]


@dataclass
class Span:
    """Chunks of one document that follow each other, best questions' score, and its standing: alone, too short to be a passage; owed, short
    but with something beside it worth taking."""

    chunks: list
    scores: list[float]
    score: float = 0.0
    alone: bool = False
    owed: bool = False
    rank: int = 0
    extra: dict = field(default_factory=dict)

    @property
    def start(self) -> int:
        return self.chunks[0]["seq"]

    @property
    def end(self) -> int:
        return self.chunks[-1]["seq"]

    @property
    def keys(self) -> list[tuple]:
        return [key_of(c) for c in self.chunks]


def folded_score(scores: list[float], how: str) -> float:
    most, total = max(scores, default=0.0), sum(scores)
    if how == "harmonic":
        return 2 * most * total / (most + total) if most > 0 and total > 0 else 0.0
    return total if how == "sum" else most


def follows(before, after) -> bool:
    """Whether a chunk goes on where another one ends, in the same section."""
    return key_of(after) == (before["collection"], before["document_id"], before["seq"] + 1) and before["end_reason"] != "heading"


def islands(scored: dict, how: str) -> list[Span]:
    """Spans, best first, of chunks by key with their scores."""
    out: list[Span] = []
    for k in sorted(scored):
        chunk, score = scored[k]
        if out and follows(out[-1].chunks[-1], chunk):
            out[-1].chunks.append(chunk)
            out[-1].scores.append(score)
        else:
            out.append(Span([chunk], [score]))
    for s in out:
        s.score = folded_score(s.scores, how)
    return sorted(out, key=lambda s: (-round(s.score, 9), str(s.chunks[0].get("name") or s.chunks[0]["document_id"]), s.start, s.chunks[0]["collection"]))


def united(parts: list[Span], how: str) -> list[Span]:
    """Spans over all chunks of the parts, each chunk as the first part has it. A span is alone or owed only if all its parts are."""
    scored: dict = {}
    for p in parts:
        for c, s in zip(p.chunks, p.scores):
            scored.setdefault(key_of(c), (c, s))
    at = {key: p for p in reversed(parts) for key in p.keys[:1]}
    whole = {key: [q for q in parts if q.keys[0] == key] for key in at}
    spans = islands(scored, how)
    for s in spans:
        own = [q for key in s.keys for q in whole.get(key, ())]
        s.alone, s.owed = all(q.alone for q in own), all(q.owed for q in own)
        s.extra = next((q.extra for q in own if q.extra), {})
    return spans


def question_words(text: str) -> list[str]:
    return [w for w in dict.fromkeys(WORD.findall((text or "").lower())) if len(w) > 2 and w not in STOPPED]


def worth(scores: np.ndarray, reference: np.ndarray, bias: float = 0.0) -> np.ndarray:
    """Scores by where they lie from the reference's middle (0) to its best (1), within -1 and 1."""
    if not len(reference):
        return np.zeros(len(scores)) + bias
    middle, top = float(np.median(reference)), float(reference.max())
    if top <= middle:
        return np.where(scores >= middle, 1.0, -1.0) + bias
    return np.clip((scores - middle) / (top - middle), -1, 1) + bias


def values(reference: list, candidates: list, asked: list[tuple[str, object]], bias: float = 0.0) -> tuple[np.ndarray, str]:
    """What each candidate chunk is worth to its best question, and by what it was matched: vectors where every chunk and question has one, else the share of
    a question's words that a chunk holds. asked has (question, vector)."""
    every = [*reference, *candidates]
    if asked and all(v is not None for _, v in asked) and all(c["vector"] is not None for c in every):
        m = [np.array([np.asarray(x, float) for x in side]) for side in ([c["vector"] for c in every], [v for _, v in asked])]
        a, q = (x / np.where((n := np.linalg.norm(x, axis=1, keepdims=True)) > 0, n, 1) for x in m)
        scores, signal = q @ a.T, "vector"
    else:
        held = [set(question_words(c["text"])) for c in every]
        wanted = [question_words(q) for q, _ in asked]
        scores, signal = np.array([[sum(w in h for w in ws) / len(ws) if ws else 0.0 for h in held] for ws in wanted]).reshape(len(wanted), len(every)), "words"
    n = len(reference)
    own = [worth(s[n:], s[:n], bias) for s in scores]
    return (np.max(own, axis=0) if own else np.zeros(len(candidates))), signal


def fragment(span: Span, least: int) -> bool:
    """Whether a span is a short piece of a longer section."""
    first, last = span.chunks[0], span.chunks[-1]
    if least <= 0 or (first["start_reason"] in CLOSED and last["end_reason"] in CLOSED):
        return False
    return last["char_end"] - first["char_start"] < least or sum(len(WORD.findall(c["text"] or "")) for c in span.chunks) < LEAST_WORDS


def outward(edge, near: dict, reach: int, step: int) -> list[tuple[dict, float]]:
    """The best stretch of neighbours from a span's edge in one direction, nearest first; empty where none is worth it."""
    walk = []
    while len(walk) < reach:
        here = walk[-1][0] if walk else edge
        found = near.get((here["collection"], here["document_id"], here["seq"] + step))
        if found is None or not (follows(here, found[0]) if step > 0 else follows(found[0], here)):
            break
        walk.append(found)
    sums = [round(s, 12) for s in accumulate(v for _, v in walk)]
    best = max(sums, default=0.0)
    return walk[: sums.index(best) + 1] if best > 0 else []


def both_ways(span: Span, near: dict, back: int, ahead: int) -> list[list]:
    return [outward(span.chunks[0], near, back, -1), outward(span.chunks[-1], near, ahead, 1)]


def judged_spans(spans: list[Span], near: dict, least: int, reach: int, how: str, grows: bool) -> list[Span]:
    """Spans, best first, with those that are fragments grown by what is worth it around them, or else marked alone, but for the best one. Where they don't
    grow yet, they are owed what is there. Neighbours score 0: a span's score says what matched."""
    out, taken = [], []
    for n, s in enumerate(spans):
        if fragment(s, least):
            found = [c for side in both_ways(s, near, reach, reach) for c, _ in side]
            if found and grows:
                taken += found
            elif n:
                s = replace(s, alone=not found, owed=bool(found))
        out.append(s)
    held = {k for s in out for k in s.keys}
    new = {key_of(c): c for c in taken if key_of(c) not in held}
    return united([*out, *(Span([c], [0.0]) for c in new.values())], how)


@dataclass
class Group:
    """One section with the spans that were kept of it."""

    start: int
    end: int
    spans: list[Span]


def nearby(group: Group, reach: int) -> set[int]:
    """The numbers of the chunks of a section that lie within reach of its spans, without their own."""
    own = {k[2] for s in group.spans for k in s.keys}
    return {n for s in group.spans for n in range(max(group.start, s.start - reach), min(group.end, s.end + reach) + 1)} - own


def stretches(group: Group, near: dict, reach: int) -> list[list[tuple[dict, float]]]:
    """What a section could take: whole gaps between two spans that are worth it, and what each span would grow by, into a gap at most
    half of it, the odd chunk going to the span before."""
    spans = sorted(group.spans, key=lambda s: s.start)
    gaps = [b.start - a.end - 1 for a, b in zip(spans, spans[1:])]
    found = []
    for a, n in zip(spans, gaps):
        place = a.keys[-1][:2]
        between = [near.get((*place, a.end + i)) for i in range(1, n + 1)]
        if n and all(x is not None for x in between) and round(sum(v for _, v in between), 12) > 0:
            found.append(between)
    for n, s in enumerate(spans):
        back = gaps[n - 1] // 2 if n else reach
        ahead = -(-gaps[n] // 2) if n < len(gaps) else reach
        found += [side for side in both_ways(s, near, min(back, reach), min(ahead, reach)) if side]
    return found


def affordable(options: list[tuple[int, list]], room: int) -> list[tuple[int, list]]:
    """The stretches of most worth for each character that fit into the room, each without what another one has brought already."""
    def size(part: list) -> int:
        return sum(c["char_end"] - c["char_start"] for c, _ in part)

    def value(part: list) -> float:
        return sum(v for _, v in part)

    out, held = [], set()
    for g, part in sorted(options, key=lambda o: -value(o[1]) / max(1, size(o[1]))):
        new = [x for x in part if key_of(x[0]) not in held]
        if new and value(new) > 0 and size(new) <= room:
            room -= size(new)
            held.update(key_of(c) for c, _ in new)
            out.append((g, new))
    return out


def grown(groups: list[Group], near: dict, reach: int, room: int, how: str) -> list[Group]:
    """The groups with what they take into the room; a span that is owed and has nothing worth taking beside it is alone after all, and a group
    of which nothing stands is dropped."""
    options = []
    for n, g in enumerate(groups):
        place = g.spans[0].keys[0][:2]
        own = {k: near[k] for k in ((*place, i) for i in nearby(g, reach)) if k in near}
        options += [(n, part) for part in stretches(g, own, reach)]
    taken: dict[int, list] = {}
    for n, part in affordable(options, room):
        taken.setdefault(n, []).extend(c for c, _ in part)
    out = []
    for n, g in enumerate(groups):
        offered = {key_of(c) for m, part in options if m == n for c, _ in part}
        spans = united([*g.spans, *(Span([c], [0.0]) for c in taken.get(n, ()))], how) if n in taken else g.spans
        settled = []
        for s in spans:
            if s.owed:
                (c, d, first), last = s.keys[0], s.end
                s = replace(s, owed=False, alone=not {(c, d, first - 1), (c, d, last + 1)} & offered)
            settled.append(s)
        if not all(s.alone for s in settled):
            out.append(replace(g, spans=settled))
    return out


def _row(r) -> dict:
    return r.asDict() if hasattr(r, "asDict") else dict(r)


SPANS = (
    "query_id long, rank int, collection string, document_id string, name string, seq_start int, seq_end int, char_start int, char_end int, line_start int, line_end int, "
    "page_start int, page_end int, score double, alone boolean, owed boolean, chunks array<struct<text:string,vector:array<float>>>"
)


def _least(chunks: list, name: str):
    return min((c[name] for c in chunks if c[name] is not None), default=None)


def _most(chunks: list, name: str):
    return max((c[name] for c in chunks if c[name] is not None), default=None)


def _shown(q, n: int, s: Span) -> tuple:
    c = s.chunks
    return (q, n, c[0]["collection"], c[0]["document_id"], c[0].get("name"), s.start, s.end, _least(c, "char_start"), _most(c, "char_end"), _least(c, "line_start"), _most(c, "line_end"),
            _least(c, "page_start"), _most(c, "page_end"), s.score, s.alone, s.owed, [{"text": x["text"], "vector": x["vector"]} for x in c])


def wanted(hits: DataFrame, least: int, reach: int) -> DataFrame:
    """(query_id, collection, document_id, seq): what lies around hits of which a span may be a fragment: at most `reach` chunks before and after each."""
    if least <= 0:
        return hits.select("query_id", *PLACE).where("false")
    steps = F.explode(F.concat(F.sequence(F.lit(-reach), F.lit(-1)), F.sequence(F.lit(1), F.lit(reach))))
    # a span is no fragment if one of its chunks is long enough by itself
    short = hits.where((F.col("char_end") - F.col("char_start") < least) | (F.size(words("text")) < LEAST_WORDS))
    around = short.select("query_id", "collection", "document_id", "seq", steps.alias("_by")).withColumn("seq", F.col("seq") + F.col("_by")).where("seq >= 1").drop("_by").distinct()
    return around.join(hits.select("query_id", *PLACE), ["query_id", *PLACE], "left_anti")


def _without_vectors(chunks: DataFrame, unless: bool) -> DataFrame:
    """chunks with null vectors where nothing is going to look at them."""
    return chunks if unless else chunks.withColumn("vector", F.lit(None).cast(chunks.schema["vector"].dataType))


def judged(hits: DataFrame, chunks: DataFrame, questions: DataFrame, settings: SearchSettings, grows: bool, vectors: bool = True) -> DataFrame:
    """Rows as of SPANS: what was hit as passages, those that are too short grown (or, where grows is false, owed what is around them), or marked alone.

    hits(query_id, rank, score, name, chunk columns), questions(query_id, question[, vector]). The best span of a question is never alone. vectors: whether the
    chunks in the result need theirs.
    """
    needed = vectors or "vector" in questions.columns
    hits, chunks = _without_vectors(hits, needed), _without_vectors(chunks.select(*CHUNK), needed)
    near = wanted(hits, settings.min_passage_chars, settings.max_passage_grow).join(chunks.select(*CHUNK), PLACE)
    own = hits.where(F.col("rank") <= MAX_SCAN).groupBy("query_id").agg(F.collect_list(F.struct("rank", "score", "name", *CHUNK)).alias("own"))
    beside = near.groupBy("query_id").agg(F.collect_list(F.struct(*CHUNK)).alias("near"))
    asked = questions.select("query_id", "question", (F.col("vector") if "vector" in questions.columns else F.lit(None).cast("array<float>")).alias("asked"))

    def run(it):
        for batch in it:
            rows = []
            for q, own, near, question, vector in zip(batch.query_id, batch["own"], batch["near"], batch.question, batch.asked):
                scanned = [_row(r) for r in sorted(own, key=lambda r: r["rank"])]
                spans = islands({key_of(c): (c, float(c["score"])) for c in scanned}, settings.score_fold)
                candidates = sorted((_row(r) for r in near), key=key_of) if near is not None else []
                names = {c["document_id"]: c["name"] for c in scanned}
                candidates = [{**c, "name": names.get(c["document_id"])} for c in candidates]
                around = {}
                if candidates and any(fragment(s, settings.min_passage_chars) for s in spans):
                    value, _ = values(scanned, candidates, [(question, vector)], settings.grow_bias)
                    around = {key_of(c): (c, float(v)) for c, v in zip(candidates, value)}
                found = judged_spans(spans, around, settings.min_passage_chars, settings.max_passage_grow, settings.score_fold, grows)
                rows += [_shown(q, n, s) for n, s in enumerate(found, 1)]
            yield frame(rows, SPANS)

    return own.join(beside, "query_id", "left").join(asked, "query_id").mapInPandas(run, SPANS)


FILLED = "query_id long, group_rank int, rank int, collection string, document_id string, position int, seq_start int, seq_end int, char_start int, char_end int, score double, grew boolean"


def filled(kept: DataFrame, chunks: DataFrame, questions: DataFrame, settings: SearchSettings) -> DataFrame:
    """Rows as of FILLED: the passages kept of each section with the text around and between them that answers too, as far as the budget has room.

    kept(query_id, group_rank, rank, collection, document_id, position, s_start, s_end, seq_start, seq_end, score, alone, owed, cost): cost is what the query's passages take of
    the budget already, on any of its rows. Sections of which nothing stands are dropped.
    """
    reach = settings.max_passage_grow
    chunks = _without_vectors(chunks.select(*CHUNK), "vector" in questions.columns)
    within = F.explode(F.sequence(F.least(F.col("seq_start"), F.greatest("s_start", F.col("seq_start") - reach)), F.greatest(F.col("seq_end"), F.least("s_end", F.col("seq_end") + reach))))
    asked = kept.select("query_id", "collection", "document_id", within.alias("seq")).distinct()
    rows = asked.join(chunks.select(*CHUNK), PLACE).groupBy("query_id").agg(F.collect_list(F.struct(*CHUNK)).alias("rows"))
    fields = ["group_rank", "rank", "collection", "document_id", "position", "s_start", "s_end", "seq_start", "seq_end", "score", "alone", "owed"]
    spans = kept.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("spans"), F.max("cost").alias("cost"))
    vector = F.col("vector") if "vector" in questions.columns else F.lit(None).cast("array<float>")
    parts = questions.groupBy("query_id").agg(F.collect_list(F.struct("question", vector.alias("vector"))).alias("parts"))

    def run(it):
        for batch in it:
            out = []
            for q, spans, rows, cost, parts in zip(batch.query_id, batch["spans"], batch["rows"], batch.cost, batch["parts"]):
                asked = [(p["question"], p["vector"]) for p in parts]
                at = {key_of(c): c for c in map(_row, rows)}
                groups = []
                for (rank, start, end, position), own in groupby(spans, key=lambda p: (p["group_rank"], p["s_start"], p["s_end"], p["position"])):
                    held_spans = []
                    for p in own:
                        held = [at[k] for i in range(p["seq_start"], p["seq_end"] + 1) if (k := (p["collection"], p["document_id"], i)) in at]
                        if held:
                            held_spans.append(Span(held, [p["score"]] + [0.0] * (len(held) - 1), p["score"], p["alone"], p["owed"], p["rank"], {"group": rank, "position": position, "rank": p["rank"], "score": p["score"]}))
                    if held_spans:
                        groups.append(Group(start, end, held_spans))
                reference = [c for g in groups for s in g.spans for c in s.chunks]
                held = {key_of(c) for c in reference}
                candidates = [c for k, c in sorted(at.items()) if k not in held]
                value, _ = values(reference, candidates, asked, settings.grow_bias)
                near = {key_of(c): (c, float(v)) for c, v in zip(candidates, value)}
                before = {(s.keys[0], s.end) for g in groups for s in g.spans}
                for g in grown(groups, near, reach, int(settings.answer_budget_chars - (cost or 0)), settings.score_fold):
                    for s in g.spans:
                        c = s.chunks
                        out.append((q, s.extra["group"], s.extra["rank"], c[0]["collection"], c[0]["document_id"], s.extra["position"], s.start, s.end, _least(c, "char_start"), _most(c, "char_end"), s.score, (s.keys[0], s.end) not in before))
            yield frame(out, FILLED)

    return spans.join(rows, "query_id").join(parts, "query_id").mapInPandas(run, FILLED)
