"""Folding, sections, budgets and growth by value, and whole answers on small tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from evidara.operators import collapse, growth, mapping, sections

RETRY = "a background job repeats a failed call so that the call must be safe to repeat"
BACKOFF = "wait longer between the tries and add some noise or clients come back at once"
CHUNK = "struct<text:string,vector:array<float>>"
ITEM = f"query_id long, item long, rank int, score double, alone boolean, collection string, document_id string, seq_start int, seq_end int, char_start int, char_end int, chunks array<{CHUNK}>"


def result(text, document, collection="c", seq=1, alone=False, span=(0, 100), vector=None):
    return {"chunks": [{"text": text, "vector": vector}], "document_id": document, "collection": collection, "seq_start": seq, "seq_end": seq, "char_start": span[0], "char_end": span[1], "alone": alone}


def fold(results, limit=10, spaces=collapse.Spaces()):
    own = [{**r, "item": n, "score": 1.0 / (n + 1)} for n, r in enumerate(results)]
    rows = collapse.fold(own, limit, spaces)
    return {r[0]: (r[1] if r[1] else (r[2], r[4], round(r[5], 3))) for r in rows}


def test_equal_texts_fold_under_the_better():
    assert fold([result(RETRY, "a"), result(RETRY + "  ", "b"), result(BACKOFF, "d")]) == {0: 1, 1: (0, "duplicate", 1.0), 2: 2}
    assert fold([result("Short label", "a"), result("Short label", "b")]) == {0: 1, 1: 2}


def test_touching_chunks_of_one_document_are_never_folded():
    assert fold([result(RETRY, "a", seq=1), result(RETRY, "a", seq=2)]) == {0: 1, 1: 2}
    assert fold([result(RETRY, "a", seq=1), result(RETRY, "a", seq=3)])[1] == (0, "duplicate", 1.0)


def test_spans_of_one_document_in_two_collections_nest():
    inner, outer = result("one", "a", "x", span=(10, 20)), result("other words", "a", "y", span=(0, 50))
    assert fold([outer, inner])[1] == (0, "contained", 1.0)
    assert fold([inner, outer]) == {1: 1, 0: (1, "contained", 1.0)}


def test_a_fuller_result_takes_the_best_slot_and_all_that_it_holds():
    both = RETRY + " " + BACKOFF
    found = collapse.fold([{**r, "item": n, "score": 9.0 - n} for n, r in enumerate([result(RETRY, "a"), result(BACKOFF, "b"), result("x y z", "e"), result(both, "d")])], 10, collapse.Spaces())
    slots = {r[0]: (r[1], r[6]) for r in found if r[1]}
    assert slots == {3: (1, 9.0), 2: (2, 7.0)}
    assert {r[0]: r[2] for r in found if r[2] is not None} == {0: 3, 1: 3}


def test_what_was_folded_stays_under_what_it_was_measured_against():
    both = RETRY + " " + BACKOFF
    rows = collapse.fold([{**r, "item": n, "score": 9.0 - n} for n, r in enumerate([result(RETRY, "a"), result(RETRY, "b"), result(both, "d")])], 10, collapse.Spaces())
    assert {r[0]: (r[2], r[3]) for r in rows if r[2] is not None} == {1: (0, 2), 0: (2, 2)}


def test_repeats_come_before_swaps():
    decisions = {(2, 0): ("contained", 0.9, True), (2, 1): ("equivalent", 0.6, False)}
    slots, under = collapse.leaders([False] * 3, [3.0, 2.0, 1.0], lambda i, k: decisions.get((i, k)), None)
    assert slots == [(0, 3.0), (1, 2.0)] and under == {2: (1, "equivalent", 0.6)}


def test_what_is_alone_leads_nothing():
    assert fold([result(RETRY, "a", alone=True), result(RETRY, "b")]) == {0: 1, 1: 2}
    both = RETRY + " " + BACKOFF
    assert fold([result(RETRY, "a"), result(both, "b", alone=True)]) == {0: 1, 1: 2}


def test_beyond_the_limit_only_folding_goes_on():
    assert fold([result(RETRY, "a"), result(BACKOFF, "b"), result(RETRY, "d")], limit=1) == {0: 1, 2: (0, "duplicate", 1.0)}


def test_words_in_another_order_are_alike_as_wholes():
    w = RETRY.split()
    found = fold([result(RETRY, "a"), result(" ".join(w[::-1]), "b")])
    assert found[1] == (0, "equivalent", 1.0)


def test_vectors_decide_where_all_chunks_have_one():
    bars = collapse.Spaces(0.9, 0.85)
    rows = [result("one two three", "a", vector=[1.0, 0.0]), result("four five six", "b", vector=[0.99, 0.05]), result("seven", "d", vector=[0.0, 1.0])]
    assert fold(rows, spaces=bars)[1][:2] == (0, "equivalent") and fold(rows, spaces=bars)[2] == 2
    rows[2] = result("seven", "d")
    assert fold(rows, spaces=bars) == {0: 1, 1: 2, 2: 3}
    copy = [result(RETRY, "a", vector=[1.0, 0.0]), result(RETRY + " indeed", "b", vector=[0.0, 1.0])]
    assert fold(copy, spaces=bars)[1][1] == "equivalent" and fold(copy, spaces=collapse.Spaces(0.9, 0.85, "vector")) == {0: 1, 1: 2}


def test_fold_of_nothing_and_of_nulls(spark):
    assert collapse.folded_results(spark.createDataFrame([], ITEM), 5).count() == 0
    rows = [(1, n, n + 1, 1.0, False, "c", f"d{n}", 1, 1, 0, 5, [{"text": t, "vector": None}]) for n, t in enumerate([None, "", RETRY, RETRY])]
    got = {r["item"]: r.slot for r in collapse.folded_results(spark.createDataFrame(rows, ITEM), 5).collect()}
    assert got == {0: 1, 1: 2, 2: 3, 3: None}


# --- sections and budgets


def chunks_of(spark, rows):
    return spark.createDataFrame([("c", d, seq, h, 100 * seq, 100 * seq + 100) for d, seq, h in rows], "collection string, document_id string, seq int, headings array<string>, char_start int, char_end int")


def test_a_run_over_the_whole_document_is_no_section(spark):
    own = chunks_of(spark, [("one", s, ["Top", f"Part {s // 3}", f"Point {s}"]) for s in range(1, 6)] + [("flat", s, ["Top"]) for s in (1, 2)] + [("bare", 1, [])])
    hits = spark.createDataFrame([(1, "c", "one", 4), (1, "c", "one", 1), (1, "c", "flat", 2), (1, "c", "bare", 1)], "query_id long, collection string, document_id string, seq_start int")
    runs = sections.runs(own)
    found = {(r.document_id, r.seq_start): (r.path, r.s_start, r.s_end) for r in sections.section_of(hits, runs, 1000).collect()}
    assert found["one", 4] == (["Top", "Part 1"], 3, 5) and found["one", 1] == (["Top", "Part 0"], 1, 2)
    assert found["flat", 2] == (["Top"], 1, 2) and found["bare", 1] == ([], 1, 1)
    tight = {(r.document_id, r.seq_start): r.path for r in sections.section_of(hits, runs, 150).collect()}
    assert tight["one", 4] == ["Top", "Part 1", "Point 4"]
    scope = runs.where("document_id = 'one' and depth = 1")
    kept = {(r.document_id, r.seq_start): r.path for r in sections.section_of(hits, runs, 1000, scope).collect()}
    assert kept["one", 4] == ["Top"]


def p(group, rank, cost, alone=False, first=False):
    return {"group_rank": group, "rank": rank, "cost": cost, "header_cost": 100, "alone": alone, "first": first}


@pytest.mark.parametrize(
    "passages, budget, kept",
    [
        ([p(1, 1, 900), p(1, 3, 50), p(2, 2, 50)], 10, {0}),  # the first group's best stays, whatever it costs
        ([p(1, 1, 100), p(1, 4, 50), p(2, 2, 900), p(2, 3, 10)], 400, {0, 1}),  # nothing of a group whose best did not fit
        ([p(1, 1, 100, alone=True), p(1, 2, 100), p(2, 3, 100)], 500, {0, 1, 2}),  # the best is one that stands alone
        ([p(1, 1, 100), p(2, 2, 100), p(2, 9, 150, first=True)], 450, {0, 2}),  # what a probe found takes its room first
        ([p(1, 1, 100), p(1, 5, 60), p(2, 2, 100), p(2, 4, 60)], 470, {0, 2, 3}),  # the next best across all groups
        ([], 10, set()),
    ],
)
def test_passages_within_a_budget(passages, budget, kept):
    assert sections.fitting(passages, budget) == kept


# --- growth


def chunk(seq, text="word " * 80, document="d", collection="c", start="block", end="block", vector=None, size=400):
    return {"collection": collection, "document_id": document, "seq": seq, "char_start": seq * 400, "char_end": seq * 400 + size, "line_start": seq, "line_end": seq, "page_start": None, "page_end": None,
            "start_reason": start, "end_reason": end, "text": text, "vector": vector, "name": document}


def span(*chunks, score=1.0, **more):
    return growth.Span(list(chunks), [score] + [0.0] * (len(chunks) - 1), score, **more)


def near(*pairs):
    return {growth.key_of(c): (c, v) for c, v in pairs}


def test_a_run_ends_where_its_sum_is_greatest():
    side = growth.outward(chunk(5), near((chunk(6), -0.5), (chunk(7), 1.0), (chunk(8), -0.2)), 3, 1)
    assert [c["seq"] for c, _ in side] == [6, 7]
    assert growth.outward(chunk(5), near((chunk(6), -0.5), (chunk(7), 0.5)), 3, 1) == []
    assert growth.outward(chunk(5, end="heading"), near((chunk(6), 1.0)), 3, 1) == []
    assert growth.outward(chunk(5), near((chunk(4, end="heading"), 1.0)), 3, -1) == []
    assert growth.outward(chunk(5), near((chunk(7), 1.0)), 3, 1) == []


def test_fragments_grow_or_stand_back():
    short = chunk(3, "few words", size=30)
    best, piece, lone = span(chunk(1, document="x"), score=3.0), span(short, score=2.0), span(chunk(9, "few words", "e", size=20), score=1.0)
    whole = span(chunk(1, "a note", "n", start="heading", end="heading", size=20), score=0.5)
    around = near((chunk(4), 0.7))
    grown = growth.judged_spans([best, piece, lone, whole], around, 300, 3, "sum", True)
    assert [(s.start, s.end, s.alone, s.owed) for s in grown] == [(1, 1, False, False), (3, 4, False, False), (9, 9, True, False), (1, 1, False, False)]
    assert grown[1].score == 2.0
    judged = growth.judged_spans([best, piece, lone, whole], around, 300, 3, "sum", False)
    assert [(s.start, s.end, s.alone, s.owed) for s in judged] == [(1, 1, False, False), (3, 3, False, True), (9, 9, True, False), (1, 1, False, False)]
    first = growth.judged_spans([lone], {}, 300, 3, "sum", False)
    assert not first[0].alone
    assert not any(s.alone for s in growth.judged_spans([best, lone], {}, 0, 3, "sum", True))


def test_gaps_are_bridged_and_shared_by_halves():
    group = growth.Group(1, 9, [span(chunk(1)), span(chunk(5))])
    assert growth.nearby(group, 2) == {2, 3, 4, 6, 7}
    paid = growth.stretches(group, near((chunk(2), 0.5), (chunk(3), -0.4), (chunk(4), 0.5)), 3)
    assert sorted([c["seq"] for c, _ in part] for part in paid) == [[2], [2, 3, 4], [4]]
    apart = growth.stretches(group, near((chunk(2), 0.5), (chunk(3), 0.5)), 3)
    assert [[c["seq"] for c, _ in part] for part in apart] == [[2, 3]]
    ends = growth.stretches(growth.Group(1, 9, [span(chunk(5))]), near((chunk(6), 0.5), (chunk(7), 0.5), (chunk(8), 0.5), (chunk(9), 0.5)), 3)
    assert [[c["seq"] for c, _ in part] for part in ends] == [[6, 7, 8]]


def test_the_room_goes_to_what_is_worth_most_for_its_size():
    options = [(0, [(chunk(2), 0.5)]), (0, [(chunk(2), 0.5), (chunk(3, size=100), 0.9)]), (1, [(chunk(8), 0.1)])]
    taken = growth.affordable(options, 900)
    assert [(g, [c["seq"] for c, _ in part]) for g, part in taken] == [(0, [2, 3]), (1, [8])]
    assert growth.affordable(options, 99) == []


def test_owed_spans_are_settled_by_what_was_offered():
    groups = [growth.Group(1, 9, [span(chunk(3, "few", size=20), owed=True)]), growth.Group(1, 9, [span(chunk(3, "few", "e", size=20), owed=True)])]
    found = growth.grown(groups, near((chunk(4), 0.5)), 3, 0, "sum")
    assert [(g.spans[0].keys[0][1], g.spans[0].alone) for g in found] == [("d", False)]
    bridged = growth.grown([growth.Group(1, 9, [span(chunk(1), score=2.0), span(chunk(3), score=1.0)])], near((chunk(2), 0.5)), 3, 1000, "sum")
    assert [(s.start, s.end, s.score) for s in bridged[0].spans] == [(1, 3, 3.0)]


def test_worth_lies_around_the_middle():
    assert growth.worth(growth.np.array([1.0, 2.0, 3.0, 9.0, -5.0]), growth.np.array([1.0, 2.0, 4.0])).tolist() == [-0.5, 0.0, 0.5, 1.0, -1.0]
    assert growth.worth(growth.np.array([1.0, 2.0]), growth.np.array([2.0, 2.0]), 0.25).tolist() == [-0.75, 1.25]


def test_values_are_by_vectors_or_by_words():
    held, more = [chunk(1, vector=[1.0, 0.0]), chunk(2, vector=[0.0, 1.0])], [chunk(3, vector=[1.0, 0.0]), chunk(4, vector=[-1.0, 0.0])]
    assert growth.values(held, more, [("q", [1.0, 0.0])]) == (pytest.approx([1.0, -1.0]), "vector")
    worded = growth.values([chunk(1, "safe retries"), chunk(2, "nothing here")], [chunk(3, "safe retries indeed"), chunk(4, "none")], [("are retries safe", None)])
    assert worded == (pytest.approx([1.0, -1.0]), "words")


def test_empty_and_very_short_inputs(spark):
    assert sections.within_budget(spark.createDataFrame([], "query_id long, group_rank int, rank int, cost long, header_cost long"), 10).count() == 0
    ranges = spark.createDataFrame([(1, "c", f"d{n}", n, n % 2 == 0) for n in range(1, 8)], "query_id long, collection string, document_id string, rank int, alone boolean")
    assert {r.document_id for r in sections.documents_needed(ranges, 2).collect()} == {"d1", "d2", "d3"}
    assert sections.documents_needed(ranges.where(F.lit(False)), 2).count() == 0


# --- maps and turns


def hit(n, item, document, score, vector=None, text=""):
    return {"rank": n, "item": item, "document_id": document, "score": score, "vector": vector, "text": text}


def picks_of(rows):
    return [r[0] for r in sorted((r for r in rows if r[1] is not None), key=lambda r: r[1])]


def test_a_map_covers_a_second_topic_before_a_near_copy():
    rows = [hit(1, 7, "a", 3.0, [1.0, 0.0]), hit(2, 8, "b", 2.5, [0.99, 0.1]), hit(3, 9, "d", 1.0, [0.0, 1.0]), hit(4, 7, "a", 0.5, [0.9, 0.1])]
    found = mapping.mapped(rows, 2, "sum")
    assert picks_of(found) == [7, 9]
    under = {r[0]: (r[2], round(r[3], 3)) for r in found if r[1] is None}
    assert under == {8: (7, 1.0)}  # by the nearest of its chunks
    first, second = (r for r in found if r[1] is not None)
    assert first[4] == 3.5 and first[5] == 2 and 0 < first[6] < second[6] <= 1


def test_a_map_stops_where_nothing_new_is_covered():
    rows = [hit(1, 1, "a", 2.0, [1.0, 0.0]), hit(2, 2, "b", 1.0, [1.0, 0.0])]
    assert picks_of(mapping.mapped(rows, 5, "sum")) == [1]
    assert picks_of(mapping.mapped([hit(1, 1, "a", 0.0, [0.0, 0.0]), hit(2, 2, "b", 0.0, [0.0, 1.0])], 5, "sum")) == [1, 2]


def test_a_document_gives_way_only_to_a_section_that_covers_enough():
    e = [[float(i == j) for j in range(4)] for i in range(4)]
    rows = [hit(n + 1, n, "a", 4.0 - n, e[n]) for n in range(3)] + [hit(4, 3, "b", 0.6, e[3])]
    assert picks_of(mapping.mapped(rows, 4, "sum")) == [0, 1, 2, 3]
    rows[3]["score"] = 1.2
    found = mapping.mapped(rows, 4, "sum")
    assert picks_of(found) == [0, 1, 3, 2] and [r[7] for r in found if r[1] is not None] == [False, False, False, True]


def test_a_map_without_vectors_goes_by_score_and_words():
    texts = [RETRY, BACKOFF, RETRY, "third matter that has nothing in common with what else is said here"]
    rows = [hit(n + 1, n, "a" if n < 3 else "b", 4.0 - n, None, t) for n, t in enumerate(texts)]
    found = mapping.mapped(rows, 4, "sum")
    assert picks_of(found) == [0, 1, 3] and {r[0]: r[2] for r in found if r[1] is None} == {2: 0}
    rows[2]["text"] = "a fourth thing in the same document that the cap holds back until the others are through"
    assert picks_of(mapping.mapped(rows, 4, "sum")) == [0, 1, 3, 2]
    assert picks_of(mapping.mapped(rows, 3, "sum")) == [0, 1, 3]


def ranged(part, rank, document, start, end=None, reason="block"):
    return {"part": part, "rank": rank, "item": 100 * part + rank, "collection": "c", "document_id": document, "seq_start": start, "seq_end": end or start, "end_reason": reason}


def turns(rows, limit, cap=50):
    return [([x["item"] for x in p.taken], sorted(p.parts)) for p in mapping.take_turns(rows, limit, cap)]


def test_parts_take_turns():
    rows = [ranged(0, 1, "a", 1), ranged(0, 2, "b", 1), ranged(1, 1, "d", 1), ranged(1, 2, "e", 1)]
    assert turns(rows, 2) == [([1], [0]), ([101], [1]), ([2], [0]), ([102], [1])]
    assert turns(rows, 2, cap=3) == [([1], [0]), ([101], [1]), ([2], [0])]
    assert turns([], 2) == []


def test_a_part_that_is_answered_already_waits():
    rows = [ranged(0, 1, "a", 1), ranged(0, 2, "b", 1), ranged(0, 3, "f", 1), ranged(1, 1, "a", 1), ranged(1, 2, "d", 1)]
    # the second part's best was picked for the first: its first turn is past, and the next goes into joining that pick
    assert turns(rows, 4) == [([1, 101], [0, 1]), ([2], [0]), ([3], [0]), ([102], [1])]


def test_neighbours_join_and_bridge_picks():
    rows = [ranged(0, 1, "a", 1), ranged(0, 2, "a", 3), ranged(1, 1, "z", 1), ranged(1, 2, "a", 2)]
    assert turns(rows, 2) == [([1, 2, 102], [0, 1]), ([101], [1])]
    closed = [ranged(0, 1, "a", 1, reason="heading"), ranged(1, 1, "a", 2)]
    assert turns(closed, 2) == [([1], [0]), ([101], [1])]


def test_questions_are_validated(spark):
    rows = [(1, [" a ", "b", "a", " "], " about x "), (2, ["", " "], None), (3, list("abcdef"), ""), (4, ["x" * 501], None), (5, ["x"], "c" * 201), (6, None, None)]
    found = {r.request_id: r for r in mapping.validated(spark.createDataFrame(rows, "request_id long, questions array<string>, context string")).collect()}
    assert found[1].parts == ["a", "b"] and found[1].context == "about x" and found[1].problem is None
    assert [found[i].problem is None for i in range(2, 7)] == [False] * 5 and found[3].context is None
    deep = spark.range(1).select(mapping.depth(10, F.lit(3)).alias("a"), mapping.depth(2, F.lit(3)).alias("b")).first()
    assert (deep.a, deep.b) == (4, None)
