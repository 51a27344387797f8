"""Operators on small inputs, each case with what it must give."""

from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from evidara.operators import chunking, collapse, descriptors, extras, fill, gaps, mapping, metadata, passages, retrieval, sections
from evidara.settings import ChunkSettings, SearchSettings

HIT = "query_id long, collection string, document_id string, name string, seq int, score double, end_reason string, char_start int, char_end int, line_start int, line_end int, page_start int, page_end int"


def hit(seq, score, end="block", doc="d", q=1, coll="c"):
    return (q, coll, doc, doc + "-name", seq, score, end, seq * 10, seq * 10 + 9, seq, seq, None, None)


def test_ranges_break_at_headings_and_gaps(spark):
    rows = [hit(1, 1.0), hit(2, 3.0, "heading"), hit(3, 2.0), hit(5, 4.0), hit(5, 4.0), hit(1, 9.0, doc="e")]
    got = [(r.document_id, r.seq_start, r.seq_end, r.score, r.best_seq, r["rank"]) for r in passages.ranges(spark.createDataFrame(rows, HIT)).orderBy("rank").collect()]
    assert got == [("e", 1, 1, 9.0, 1, 1), ("d", 1, 2, 4.0, 2, 2), ("d", 5, 5, 4.0, 5, 3), ("d", 3, 3, 2.0, 3, 4)]


def test_ranges_of_nothing(spark):
    assert passages.ranges(spark.createDataFrame([], HIT)).count() == 0


def test_rejoined_keeps_flags_only_if_all_have_them(spark):
    rows = [(1, "c", "d", 1, 2, True, True, ["x"], {"x": 0.2}, 1), (1, "c", "d", 3, 4, False, True, ["y", "x"], {"x": 0.5, "y": 0.1}, 0), (1, "c", "d", 9, 9, True, False, [], {}, 2)]
    df = spark.createDataFrame(rows, "query_id long, collection string, document_id string, seq_start int, seq_end int, alone boolean, owed boolean, aspects array<string>, aspect_scores map<string,double>, at int")
    got = {(r.seq_start, r.seq_end): r for r in passages.rejoined(df).collect()}
    one = got[1, 4]
    assert (one.alone, one.owed, one.aspects, one.aspect_scores) == (False, True, ["y", "x"], {"x": 0.5, "y": 0.1})
    assert got[9, 9].alone


def test_min_cover_takes_names_on_ties(spark):
    rows = [(1, "b", "1"), (1, "b", "2"), (1, "a", "1"), (1, "a", "2"), (1, "c", "3"), (1, "a", "1")]
    got = passages.min_cover(spark.createDataFrame(rows, "query_id long, collection string, document_id string")).orderBy("step").collect()
    assert [(r.collection, r.documents) for r in got] == [("a", 2), ("c", 1)]


def related(*pairs):
    return {(a, b): {"relation": r, "swap": s, "similarity": v} for a, b, r, s, v in pairs}


def items(*scores, alone=()):
    return [{"item": i, "score": s, "alone": i in alone} for i, s in enumerate(scores, 1)]


def test_decisions(spark):
    df = spark.createDataFrame([(1, 0.9, 0.5, 0.4), (2, 0.5, 0.9, 0.4), (3, 0.9, 0.9, 0.4), (4, 0.1, 0.1, 0.51), (5, 0.8, 0.8, 0.5)], "n int, into double, over double, alike double")
    got = {r.n: (r.relation, r.swap) for r in collapse.decided(df).collect()}
    assert got == {1: ("contained", False), 2: ("contained", True), 3: ("equivalent", False), 4: ("equivalent", False), 5: (None, False)}


def test_budget_keeps_the_first_and_skips_what_does_not_fit(spark):
    rows = [(1, 1, 1, 900, 10), (1, 1, 2, 50, 10), (1, 2, 3, 30, 10), (1, 3, 4, 5000, 10)]
    df = spark.createDataFrame(rows, "query_id long, group_rank int, rank int, cost long, header_cost long")
    got = {r["rank"]: r.kept for r in sections.within_budget(df, 960).collect()}
    assert got == {1: True, 3: True, 4: False, 2: False}


def test_best_run_is_the_shortest_of_the_greatest_sum(spark):
    rows = [(1, "c", "d", 5, "after", i, v, ok) for i, v, ok in [(1, -1.0, True), (2, 2.0, True), (3, 0.0, True)]] + [(1, "c", "d", 5, "before", 1, -1.0, True), (1, "c", "e", 5, "after", 2, 9.0, True)]
    df = spark.createDataFrame(rows, "query_id long, collection string, document_id string, seq_start int, side string, steps int, value double, continues boolean")
    assert [(r.side, r.steps, r.total) for r in fill.best_runs(df).collect()] == [("after", 2, 1.0)]


def test_values_where_all_are_equal(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 0.5), (2, 1.0), (2, 3.0), (2, 2.0)], "query_id long, s double")
    assert [r.value for r in fill.values(df, "s", floor=0.6).orderBy("query_id", "s").collect()] == [-1.0, -1.0, -1.0, 0.0, 1.0]


def test_runs_nest_and_split(spark):
    rows = [("c", "d", 1, []), ("c", "d", 2, ["A"]), ("c", "d", 3, ["A", "B"]), ("c", "d", 4, ["C"]), ("c", "d", 5, ["A"])]
    df = spark.createDataFrame([(*r, r[2] * 10, r[2] * 10 + 9) for r in rows], "collection string, document_id string, seq int, headings array<string>, char_start int, char_end int")
    got = {(r.depth, tuple(r.path), r.seq_start, r.seq_end) for r in sections.runs(df).collect()}
    assert got == {(0, (), 1, 5), (1, ("A",), 2, 3), (2, ("A", "B"), 3, 3), (1, ("C",), 4, 4), (1, ("A",), 5, 5)}


@pytest.mark.parametrize("descending", [False, True])
def test_keyset_walk_meets_every_row_once(spark, descending):
    rows = [(i % 3, f"n{i:02}") for i in range(17)]
    df = spark.createDataFrame(rows, "s int, name string")
    seen, after = [], None
    while True:
        page = [(r.s, r.name) for r in metadata.keyset_page(df, "s", "name", 5, after, descending).collect()]
        seen += page[:5]
        if len(page) <= 5:
            break
        after = page[4]
    assert seen == sorted(rows, reverse=descending)


def test_cursor_is_of_one_query():
    text = metadata.Cursor("q", "name", False, 3, "n").encode()
    assert metadata.Cursor.decode(text, "q", "name", False).value == 3
    for other in (("p", "name", False), ("q", "size", False), ("q", "name", True)):
        with pytest.raises(ValueError):
            metadata.Cursor.decode(text, *other)
    with pytest.raises(ValueError):
        metadata.Cursor.decode("!!", "q", "name", False)


@pytest.mark.parametrize("block", [7, 1000])
def test_vector_topics_are_the_same_in_blocks(spark, block):
    r = np.random.default_rng(3)
    near = r.standard_normal((6, 8))
    rows = [(i, f"m{i % 2}" if i % 9 else None, f"question number {i}", (near[i % 6] + 0.25 * r.standard_normal(8)).tolist(), f"2026-01-{1 + i % 28:02} 10:00:{i:02}") for i in range(60)]
    df = spark.createDataFrame(rows, "question_id long, embedding string, question string, query_vector array<double>, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    want, made = {}, {}
    for i, m, _, v, ts in sorted(rows, key=lambda x: (x[4], x[0]), reverse=True):
        u = np.array(v) / np.linalg.norm(v)
        best = max(((float(u @ w), t) for t, w in made.get(m, [])), default=(-2, None))
        want[i] = best[1] if best[0] > 0.8 else i
        if want[i] == i:
            made.setdefault(m, []).append((i, u))
    got = {x.question_id: x.topic_id for x in gaps.vector_topics(df, 0.8, block).collect()}
    assert got == want and len(set(want.values())) < 60


def test_vector_topics_join_the_closest(spark):
    rows = [(1, "a b", "m", 1, [1.0, 0.0]), (2, "b a", "m", 2, [0.9, 0.1]), (3, "c", "m", 3, [0.0, 1.0]), (4, "d", "m", 4, [0.99, 0.0])]
    df = spark.createDataFrame(rows, "question_id long, question string, embedding string, ts int, query_vector array<double>")
    assert {r.question_id: r.topic_id for r in gaps.vector_topics(df, 0.9).collect()} == {1: 4, 2: 4, 3: 3, 4: 4}


def test_preferred_goes_to_the_most_used(spark):
    uses = spark.createDataFrame([("a", 9), ("b", 5), ("c", 3), ("d", 1)], "variant string, uses long")
    same = spark.createDataFrame([("a", "b", 0.95), ("b", "c", 0.99), ("a", "c", 0.94)], "a string, b string, cosine double")
    assert {r.variant: r.preferred for r in descriptors.preferred(uses, same).collect()} == {"a": "a", "b": "a", "c": "a", "d": "d"}


def test_picked_terms_do_not_hold_each_other(spark):
    df = spark.createDataFrame([("k", "red fox", 3.0), ("k", "fox", 2.0), ("k", "den", 1.0)], "key string, term string, weight double")
    assert descriptors.picked(df, ["key"]).first().descriptors == ["red fox", "den"]


def test_nearest_is_exact_with_ties_by_id(spark):
    rows = spark.createDataFrame([(i, [float(i % 3), 0.0]) for i in range(9)] + [(99, None), (98, [1.0])], "id long, v array<float>")
    asked = spark.createDataFrame([(7, [0.0, 0.0])], "query_id long, vector array<float>")
    assert [(r.id, r.distance) for r in retrieval.nearest(asked, rows, "id", "v", 4).orderBy("rank").collect()] == [(0, 0.0), (3, 0.0), (6, 0.0), (1, 1.0)]


def test_rrf_breaks_ties_by_first_appearance(spark):
    one = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "query_id long, id string, rank int")
    two = spark.createDataFrame([(1, "b", 1), (1, "a", 2), (1, "c", 3)], "query_id long, id string, rank int")
    assert [r.id for r in retrieval.rrf([one, two], ["id"]).orderBy("rank").collect()] == ["a", "b", "c"]


def test_settings_refuse_what_they_do_not_know():
    with pytest.raises(ValueError):
        SearchSettings(mode="psychic")
    assert SearchSettings(vector_weight=0, bm25_weight=0).vector_share == 0.5
    assert SearchSettings(limit=25).scan("section") == (200, 200)


MARKDOWN = [
    "",
    "\n\n",
    "# Only a heading\n",
    "Title\n=====\n\nOne sentence. Another one, e.g. this. A third!\n\n- item one\n- item two\n\n```\ncode here\n\nmore\n```\n\n| a | b |\n| - | - |\n| 1 | 2 |\n",
    "<!-- page 1 -->\n\nÜber größere Dinge. " + "Wörter und Wörter. " * 200 + "\n<!-- page 2 -->\n\n## Next\n\n" + "x" * 5000,
    "A\r\n\r\nB\r\n\r\n# H\r\n\r\nC\r\n",
]


@pytest.mark.parametrize("text", MARKDOWN)
@pytest.mark.parametrize("size", [40, 300, 1200])
@pytest.mark.parametrize("chunker", ["markdown", "text"])
def test_chunk_contract(text, size, chunker):
    check_contract(text, ChunkSettings(chunker=chunker, chunk_size=size))


def reasons(text, **more):
    return [(r[13], r[14]) for r in chunking.located(text, ChunkSettings(**{"chunk_size": 60, "merge_below": 0, "frame": False, **more}))]


def test_reasons_name_the_rule_of_each_cut():
    assert reasons("One here.") == [("edge", "edge")]
    assert reasons("# A\n\nOne here.\n\n# B\n\nTwo here.") == [("heading", "heading"), ("heading", "edge")]
    assert reasons("One paragraph.\n\nAnother one.") == [("edge", "paragraph"), ("paragraph", "edge")]
    assert reasons("One paragraph.\n\nAnother one.", merge_below=100) == [("edge", "edge")]
    assert reasons("- " + "a" * 40 + "\n- " + "b" * 40) == [("edge", "length_block"), ("length_block", "edge")]
    assert reasons("A" * 40 + ". " + "B" * 40 + ".") == [("edge", "length_sentence"), ("length_sentence", "edge")]
    assert reasons("word " * 20) == [("edge", "length_oversize"), ("length_oversize", "edge")]


def test_tables_are_cut_between_rows_and_frames_count():
    table = "\n".join(f"| row {i} | {'x' * 20} |" for i in range(6))
    rows = list(chunking.located(table, ChunkSettings(chunk_size=70, frame=False)))
    assert all(line.startswith("| row") and line.endswith("|") for r in rows for line in r[3].split("\n")) and len(rows) == 3
    deep = "# " + "Long title " * 6 + "\n\n## Short\n\n" + "word " * 60
    for r in chunking.located(deep, ChunkSettings(chunk_size=80)):
        assert r[2] == ["Short"] and len(r[4]) <= 80 and r[4].startswith("Short\n\n")
    assert chunking.frame_of(["x" * 90], 40) == ["x" * 18] and chunking.frame_of([], 40) == []


@given(st.text(alphabet="aB.!\n# -|`é😀", max_size=400), st.integers(5, 120))
@settings(max_examples=200, deadline=None)
def test_chunk_contract_holds_for_any_text(text, size):
    check_contract(text, ChunkSettings(chunk_size=size))


def check_contract(text, own):
    last = 0
    raw = text.encode()
    for n, r in enumerate(chunking.located(text, own), 1):
        seq, _, _, body, _, line_start, line_end, a, z, b, y = r[:11]
        assert seq == n and a >= last and 0 < z - a <= own.chunk_size
        assert text[a:z] == body and raw[b:y].decode() == body and len(r[4]) <= own.chunk_size
        assert text[:a].count("\n") + 1 == line_start and text[:z].count("\n") + 1 == line_end
        last = z


def test_part_cuts():
    assert chunking.part_cuts(10, [4, 9], 5, []) == [(0, 4), (4, 9), (9, 10)]
    assert chunking.part_cuts(10, [], 4, [3]) == [(0, 3), (3, 7), (7, 10)]
    assert chunking.part_cuts(3, [1], 5, []) == [(0, 3)]


def test_auroc_against_all_pairs(spark):
    from evidara.operators.calibrate import auroc

    random.seed(3)
    rows = [("p", random.randint(0, 5) / 5, random.random() < 0.5) for _ in range(60)]
    wins = [1 if a[1] > b[1] else 0.5 if a[1] == b[1] else 0 for a in rows if a[2] for b in rows if not b[2]]
    got = auroc(spark.createDataFrame(rows, "profile string, s double, y boolean"), "profile", "s", "y").first().auroc
    assert got == pytest.approx(sum(wins) / len(wins))


def test_shingle_overlaps_against_sets(spark):
    texts = ["the quick brown fox jumps over the lazy dog", "a quick brown fox jumps over the lazy dog", "nothing in common with the others here at all", "short text"]
    df = spark.createDataFrame([(1, i, i, [t]) for i, t in enumerate(texts, 1)], "query_id long, item long, rank int, texts array<string>")
    sets = [{tuple(t.split()[i : i + 3]) for i in range(len(t.split()) - 2)} for t in texts]
    words = [set(t.split()) for t in texts]
    fine = [len(s) >= 5 for s in sets]
    want = {(i + 1, j + 1): len(words[i] & words[j]) / len(words[i] | words[j]) if fine[i] and fine[j] else 0 for i, j in combinations(range(4), 2) if words[i] & words[j]}
    rows = collapse.shingle_overlaps(df).collect()
    assert {(r.a, r.b): r.alike for r in rows} == pytest.approx(want)
    assert {(r.a, r.b): r.into for r in rows} == pytest.approx({(a, b): len(sets[a - 1] & sets[b - 1]) / len(sets[b - 1]) if fine[b - 1] else 0 for a, b in want})


def test_topic_pairs_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(extras, "PAIR_BLOCK", 16)
    r = np.random.default_rng(4)
    rows = [(i, f"t{i % 4}", r.standard_normal(5).tolist()) for i in range(75)] + [(75, None, [1.0] * 5), (76, "t1", [0.0] * 5), (77, "t2", None), (None, "t0", [1.0] * 5)]
    want: dict = {}
    for (_, ta, va), (_, tb, vb) in combinations(rows[:-1], 2):
        same = None if ta is None or tb is None else ta == tb
        near = va is not None and vb is not None and any(va) and any(vb) and np.dot(va, vb) / np.linalg.norm(va) / np.linalg.norm(vb) > 0.1
        n = want.setdefault(same, [0, 0])
        n[0], n[1] = n[0] + 1, n[1] + int(near)
    df = spark.createDataFrame(rows, "id long, topic string, vector array<double>")
    assert {x.same: [x.pairs, x.joined] for x in extras.topic_pairs(df, "vector", 0.1).collect()} == want


def test_whole_topic_pairs_count_every_pair(spark, small):
    from evidara.plans import catalogue

    n = spark.read.parquet(f"{small}/embeddings.parquet").count()
    assert sum(x.pairs for x in catalogue.queries()["topic_pairs_joined"](spark, small).collect()) == n * (n - 1) // 2


def test_overlap_reads_the_pairs_and_only_their_vectors_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(it):
        for b in it:
            read.add(b.num_rows)
            yield b

    chunks = [("a", 1, [1.0, 0.0]), ("a", 2, [0.0, 2.0]), ("b", 1, [3.0, 0.0]), ("c", 1, [0.0, 0.0]), ("d", 1, [1.0, 0.0]), ("d", 2, [-1.0, 0.0]), ("e", 1, [1.0, 1.0])]
    rows = spark.createDataFrame([(0, *c) for c in chunks], "query_id int, item string, seq int, vector array<float>")
    kind = "query_id int, a string, b string"
    pairs = spark.createDataFrame([(0, "a", "b"), (0, "b", "c"), (0, "a", "d"), (0, "b", "x")], kind).mapInArrow(counted, kind)
    found = {(r.a, r.b): (round(r.into, 6), round(r.over, 6), round(r.alike, 6)) for r in collapse.vector_overlaps(pairs, rows).collect()}
    assert found == {("a", "b"): (1.0, 0.5, round(0.5**0.5, 6)), ("b", "c"): (0.0, 0.0, 0.0), ("a", "d"): (0.5, 0.5, 0.0)}
    assert read.value == 4
