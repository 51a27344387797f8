"""Splitting, rankings, scanned text, terms, mixes, stuffed pages: against brute force, and their edges."""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evidara.llm import mixing, ocr, queries, ranking, spam, splitting, terms, tokens

needs_tokenizer = pytest.mark.skipif(not Path(f"{tokens.FOLDER}/{tokens.VOCABULARY}").exists(), reason="no vocabulary files")


# --- splitting


@given(st.text(alphabet="ab \n.é😀", max_size=300), st.integers(2, 40), st.data(), st.sampled_from(["characters", "words"]))
@settings(max_examples=150, deadline=None)
def test_pieces_tile_with_the_overlap(text, limit, data, unit):
    overlap = data.draw(st.integers(0, limit - 1))
    own = splitting.SplitSettings(limit=limit, overlap=overlap, unit=unit)
    starts = splitting.unit_starts(text, own)
    kinds = [splitting.np.fromiter((m.end() for m in k.finditer(text)), int) for k in splitting.KINDS]
    if not text:
        return
    pieces = splitting.cut(starts, kinds, 0, len(text), limit, overlap)
    size = lambda a, z: splitting.np.searchsorted(starts, z) - splitting.np.searchsorted(starts, a)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for (a, z), (b, y) in zip(pieces, pieces[1:]):
        assert a < b <= z < y
    assert all(size(a, z) <= limit for a, z in pieces)
    if unit == "characters":
        assert all(z - b == overlap for (_, z), (b, _) in zip(pieces, pieces[1:]))
        assert "".join([text[a:z] for a, z in pieces[:1]] + [text[z:y] for (_, z), (_, y) in zip(pieces, pieces[1:])]) == text


def test_blanks_between_a_boundary_and_the_next_word_are_kept():
    text = "a a\n a"
    starts = splitting.unit_starts(text, splitting.SplitSettings(limit=2, overlap=0, unit="words"))
    kinds = [splitting.np.fromiter((m.end() for m in k.finditer(text)), int) for k in splitting.KINDS]
    assert "".join(text[a:z] for a, z in splitting.cut(starts, kinds, 0, len(text), 2, 0)) == text


def test_pieces_end_at_the_best_boundary():
    text = "One. Two three.\n\nFour five six. Seven eight nine ten eleven twelve."
    pieces = splitting.cut(splitting.np.arange(len(text) + 1), [splitting.np.array([m.end() for m in k.finditer(text)]) for k in splitting.KINDS], 0, len(text), 25, 0)
    assert text[slice(*pieces[0])] == "One. Two three.\n\n" and text[slice(*pieces[1])] == "Four five six. "


def test_sections_of_bytes(spark):
    text = "é" * 10 + "\n# B\n" + "x" * 50
    docs = spark.createDataFrame([(1, text, 9), (2, "", 9), (3, None, 9), (4, "short", 9), (None, "x" * 99, 9)], "doc_id long, text string, piece int")
    heads = spark.createDataFrame([(1, 21), (1, 21), (1, None), (1, 999), (1, -4), (1, 0), (4, 5), (9, 1)], "doc_id long, byte_offset long")
    own = splitting.SplitSettings(limit=20, overlap=5)
    got = splitting.split_texts(docs, "doc_id", "text", heads, "doc_id", "byte_offset", own).orderBy("id", "byte_offset", "piece").collect()
    assert {(r.id, r.byte_offset, r.section_chars) for r in got} == {(1, 0, 11), (1, 21, 54), (4, 0, 5)}
    assert {(r.id, r.byte_offset) for r in splitting.oversized(splitting.split_texts(docs, "doc_id", "text", heads, "doc_id", "byte_offset", own)).collect()} == {(1, 21)}
    assert all(r.text == (text if r.id == 1 else "short")[r.char_start : r.char_end] for r in got)


@needs_tokenizer
def test_pieces_in_tokens(spark):
    text = "naïve 😀 words, and more words.\n" * 200
    own = splitting.SplitSettings(limit=64, overlap=8, unit="tokens")
    got = splitting.split_texts(spark.createDataFrame([("d", text)], "doc string, text string"), "doc", "text", settings=own).orderBy("piece").collect()
    count = tokens.counter()
    assert len(got) > 20 and all(r["size"] <= 64 for r in got) and all(n <= 66 for n in count([r.text for r in got]))
    assert got[-1].char_end == len(text) and all(b.char_start < a.char_end for a, b in zip(got, got[1:]))


@needs_tokenizer
def test_token_starts_lie_where_tokens_do():
    for text in ("", "plain words", "naïve 😀😀 — “x”", "\n\n  é"):
        starts = tokens.token_starts(text)
        assert starts[-1] == len(text) and list(starts) == sorted(starts) and len(starts) == tokens.counter()([text])[0] + 1


def test_overlap_must_be_under_the_limit():
    with pytest.raises(ValueError):
        splitting.SplitSettings(limit=10, overlap=10)


def test_split_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    heads = spark.createDataFrame([], "doc_id long, byte_offset long")
    assert splitting.split_texts(empty, "doc_id", "text", heads, "doc_id", "byte_offset").count() == 0


def test_quoted_runs_put_chunks_together_once(spark):
    results = spark.createDataFrame([("c", "n", 1, 2), ("c", "n", 1, 2), ("c", "gone", 1, 1), ("c", None, 1, 1), ("c", "n", 7, 9)], "collection string, document string, seq_start int, seq_end int")
    documents = spark.createDataFrame([("n", "d")], "name string, document_id string")
    chunks = spark.createDataFrame([("c", "d", 2, "two"), ("c", "d", 1, "one"), ("c", "d", 1, "one"), ("x", "d", 1, "other")], "collection string, document_id string, seq int, text string")
    assert [(r.seq_start, r.text) for r in splitting.quoted_runs(results, documents, chunks).collect()] == [(1, "one\n\ntwo")]


# --- rankings

SCORES = [ranking.Score("b"), ranking.Score("v", more=False), ranking.Score("r")]


def winner(rows):
    def beats(x, y):
        g = lambda s: [(-math.inf if s[0] is None else s[0]), (-math.inf if s[1] is None else -s[1]), (-math.inf if s[2] is None else s[2])]
        return sum(a > b for a, b in zip(g(x), g(y))) >= 2

    return [k for k, s in rows.items() if all(beats(s, t) for j, t in rows.items() if j != k)]


def test_majority_winner_matches_brute_force(spark):
    r = random.Random(7)
    data, want = [], set()
    for g in range(60):
        rows = {f"k{i}": tuple(None if r.random() < 0.1 else r.choice([0.0, 1.0, r.random() * 100, -r.random()]) for _ in range(3)) for i in range(r.choice([1, 2, 5, 300]) if g else 700)}
        if g % 2 == 0:
            rows["k0"] = (1e6, -1e6, None)
        data += [(g, k, *s) for k, s in rows.items()] * (1 + g % 2)
        want |= {(g, k) for k in winner(rows)}
    data += [(None, "x", 1.0, 1.0, 1.0), (3, None, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(data, "g long, key string, b double, v double, r double")
    order = ranking.ideal_points(df, "g", ["key"], SCORES)
    assert {(x.g, x.key) for x in ranking.majority_winner(order, "g", ["key"], 3).collect()} == want and want


def test_ranking_is_whole_and_not_ruled_by_range(spark):
    rows = [(1, "wide", 10_000.0, 0.5, 0.1), (1, "good", 9_000.0, 0.1, 0.9), (1, "null", None, None, None), (1, "mid", 5_000.0, 0.4, 0.5), (2, "a", 1.0, 1.0, 1.0), (2, "b", 1.0, 1.0, 1.0)]
    df = spark.createDataFrame([(*r, 5) for r in rows], "g long, key string, b double, v double, r double, rank int")
    got = {(x.g, x.key): (x["rank"], x.closeness) for x in ranking.ideal_points(df, "g", ["key"], SCORES).collect()}
    assert got[1, "good"][0] == 1 and got[1, "null"][0] == 4 and got[1, "null"][1] == 0
    assert sorted(v[0] for k, v in got.items() if k[0] == 1) == [1, 2, 3, 4]
    assert got[2, "a"] == (1, 0.5) and got[2, "b"] == (2, 0.5)


def test_weights_by_column(spark):
    df = spark.createDataFrame([(1, "x", 1.0, 0.9, 0.0, 1.0), (1, "y", 0.0, 0.1, 0.0, 1.0)], "g long, key string, b double, v double, wb double, wv double")
    order = ranking.ideal_points(df, "g", ["key"], [ranking.Score("b", True, "wb"), ranking.Score("v", False, "wv")])
    assert [r.key for r in order.orderBy("rank").collect()] == ["y", "x"]


def test_ranking_of_an_empty_table(spark):
    df = spark.createDataFrame([], "g long, key string, b double, v double, r double")
    order = ranking.ideal_points(df, "g", ["key"], SCORES)
    assert order.count() == 0 and ranking.majority_winner(order, "g", ["key"], 3).count() == 0


# --- scanned text

PAGES = """<!-- page 1: read by OCR -->

The quiet engine keeps its
cursor near the quiet win-
dow. Each narrow window is
— 4 —
<!-- page 2: read by OCR -->

QUIET ENGINES

late-
bound and carefu1. The engine
— 5 —
<!-- page 3: read by OCR -->

Narrow windows

cornpares each cursor with the
narrovv window.

NARROW CURSORS

The engine ends.
— 6 —
<!-- page 4: read by OCR -->

QUIET ENGINES

Each cursor is careful.
— 7 —
"""


def test_furniture_is_told_from_headings():
    lines = PAGES.split("\n")
    found = {lines[i].strip() for i in ocr.furniture(lines)}
    assert found == {"— 4 —", "— 5 —", "— 6 —", "— 7 —", "QUIET ENGINES", "Narrow windows"}


@pytest.mark.parametrize("line, number", [("12", 12), ("l2", 12), ("iv", 4), ("xlv", 45), ("2O", 20)])
def test_page_numbers(line, number):
    assert ocr.value(line) == number


@pytest.mark.parametrize("right, read", [("careful", "carefu1"), ("compares", "cornpares"), ("narrow", "narrovv"), ("carries", "carnes"), ("delay", "dclay"), ("manifold", "mariifold"), ("budget", "biidget"), ("confirms", "conﬁrms"), ("immediately", "immedi@tely")])
def test_misreadings_meet_in_the_index_and_cost_little(right, read):
    assert ocr.index_keys(right) & ocr.index_keys(read)
    assert ocr.distance(right, read) <= 0.5 < ocr.distance(right + "s", read)


def test_findings_and_repair(spark):
    plain = "The quiet engine compares each narrow window with a careful cursor. A late-bound cursor keeps the window careful. " * 12
    rows = [(1, PAGES, 4), (2, plain, None), (3, None, 2), (4, "", 1), (5, "Only one engine.", 1)]
    df = spark.createDataFrame([(*r, "w") for r in rows], "doc_id long, text string, pages_ocr int, word string")
    got = {(r.id, r.kind, r.word) for r in ocr.findings(df, "doc_id", "text", "pages_ocr > 0").collect()}
    assert {w for i, k, w in got if k == "garbled"} == {"careful", "compares", "narrow"}
    assert {w for i, k, w in got if k == "hyphen"} == {"window", "late-bound"}
    assert sum(k == "furniture" for _, k, _ in got) == 1  # they have no word, so that they are one here
    text = {r.id: r.text for r in ocr.repaired(df, "doc_id", "text", "pages_ocr > 0").collect()}
    assert set(text) == {1, 4, 5}
    assert "near the quiet window. Each narrow window is late-bound and careful. The engine compares each cursor with the narrow window." in text[1]
    assert "—" not in text[1] and "QUIET" not in text[1] and "NARROW CURSORS" in text[1]


def test_scans_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, pages_ocr int")
    assert ocr.findings(empty, "doc_id", "text", "pages_ocr > 0").count() == 0


# --- terms


def test_terms_match_brute_force(spark):
    r = random.Random(3)
    vocabulary = ["words", "Größe", "tables", "αβγδε", "short", "ab", "mixed1word", "under_score", "longest"]
    rows = [(i, " ".join(r.choice(vocabulary) for _ in range(30)), r.choice([None, "", "tables and words"])) for i in range(25)] + [(30, None, "tables tables"), (31, None, None), (32, "", "")]
    df = spark.createDataFrame([(*x, "n") for x in rows], "doc_id long, text string, description string, term string")
    counts = {i: Counter(w for t in (a, b) for w in re.findall(r"[^\W\d_]+", (t or "").lower()) if len(w) >= 5) for i, a, b in rows}
    total, df_, every = Counter(), Counter(), 0
    for c in counts.values():
        total.update(c)
        df_.update(c.keys())
        every += sum(c.values())

    def llr(n, size, t):
        cells = [(n, size, t), (size - n, size, every - t), (t - n, every - size, t), (every - size - t + n, every - size, every - t)]
        g = 2 * sum(o * math.log(o * every / (a * b)) for o, a, b in cells if o > 0)
        return max(0.0, g) * (1 if n * every >= t * size else -1)

    want = {(i, w): (n, df_[w], llr(n, sum(c.values()), total[w])) for i, c in counts.items() for w, n in c.items()}
    got = {(x.id, x.term): (x.n, x.df, x.score) for x in terms.term_scores(df, "doc_id", ["text", "description"]).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)
    twice = {(x.id, x.term): x.n for x in terms.term_scores(df.union(df), "doc_id", ["text", "description"]).collect()}
    assert twice == {k: 2 * v[0] for k, v in want.items()}


def test_found_terms_come_by_counts_alone(spark, tmp_path, monkeypatch):
    r = random.Random(4)
    vocabulary, rare = ["words", "Größe", "tables", "short", "longest"], [f"rare{c}" for c in "abcdefgh"]
    rows = [(i % 22, " ".join(r.choices(vocabulary, k=20) + [r.choice(rare)] * r.randrange(5)), r.choice([None, "", "tables and words"])) for i in range(25)]
    rows += [(30, None, "longer longer longer"), (31, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, description string").write.parquet(f"{tmp_path}/documents.parquet")
    counts: dict[int, Counter] = {}
    for i, *texts in rows:
        counts.setdefault(i, Counter()).update(w for t in texts for w in re.findall(r"[^\W\d_]+", (t or "").lower()) if len(w) >= 5)
    df_ = Counter(w for c in counts.values() for w in c)
    want = {(i, w) for i, c in counts.items() for w, n in c.items() if n >= 3 and df_[w] <= 6}
    scored = terms.term_scores(spark.read.parquet(f"{tmp_path}/documents.parquet"), "doc_id", ["text", "description"], least=3, most=6)
    assert {(x.id, x.term) for x in scored.collect()} == want
    monkeypatch.setattr(terms, "log_likelihood", lambda *_: pytest.fail("a ratio that decides nothing"))
    got = [(x.doc_id, x.term) for x in queries.p7_found(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and (30, "longer") in want and len(want) > 5


def test_terms_of_an_empty_table(spark):
    assert terms.term_scores(spark.createDataFrame([], "doc_id long, text string"), "doc_id", ["text"]).count() == 0


# --- mixes

TARGETS = "source string, target_share double, max_repeats int"


def test_flow_meets_quotas_at_least_cost():
    sizes = {("a",): 100, ("b",): 100, ("a", "b"): 100}
    used = mixing.route(sizes, [("a", 0.5, 2), ("b", 0.5, 2)], 300)
    for s in "ab":
        assert sum(v for (g, t), v in used.items() if t == s) == pytest.approx(150)
    assert all(sum(v for (g, _), v in used.items() if g == h) <= 100 + 1e-6 for h in sizes)  # nothing is repeated where nothing must be
    used = mixing.route({("a",): 10, ("b",): 90}, [("a", 0.5, 3), ("b", 0.5, 1)], 100)
    assert used[("a",), "a"] == pytest.approx(30) and used[("b",), "b"] == pytest.approx(50)


def test_mix_reports_and_draws(spark):
    rows = [(i, "A " if i % 2 else "a", "one two three four") for i in range(200)] + [(1000 + i, "b", "five six seven eight") for i in range(50)]
    rows += [(2000, "b", None), (2001, None, "lost"), (2002, "other", "not listed"), (0, "a", "one two three four")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, text string, size int")
    targets = spark.createDataFrame([("a", 0.5, 1), ("B", 0.5, 3), ("none", 0.0, 2), (None, 0.1, 1)], TARGETS)
    mix = mixing.mixed(docs, "doc_id", "source", "text", targets, share_texts=False)
    report = {r.source: r for r in mix.report.collect()}
    assert (report["a"].available, report["b"].available, report["none"].available) == (800, 200, 0)
    assert report["a"].reachable and report["b"].reachable and report["none"].reachable
    drawn = mix.documents.collect()
    assert max(r.copies for r in drawn if r.source == "b") <= 3 and max(r.copies for r in drawn if r.source == "a") == 1
    assert report["a"].used == pytest.approx(500, abs=24) and report["b"].used == pytest.approx(500, abs=24)
    again = {(r.id, r.source, r.copies) for r in mixing.mixed(docs, "doc_id", "source", "text", targets, share_texts=False).documents.collect()}
    assert again == {(r.id, r.source, r.copies) for r in drawn}
    few = spark.createDataFrame([("a", 0.2, 1), ("b", 0.8, 2)], TARGETS)
    assert {r.source for r in mixing.mixed(docs, "doc_id", "source", "text", few, share_texts=False).report.where("not reachable").collect()} == {"b"}


def test_texts_in_several_sources_serve_either(spark):
    rows = [(i, "a", f"shared text number {i}") for i in range(40)] + [(100 + i, "b", f"shared text number {i}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    mix = mixing.mixed(docs, "doc_id", "source", "text", spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], TARGETS))
    assert sorted(r.used for r in mix.report.collect()) == pytest.approx([160, 160], abs=16)
    assert all(r.id < 100 if r.source == "a" else r.id >= 100 for r in mix.documents.collect())


def test_a_shared_text_is_one_unit_of_its_sources(spark):
    text = " ".join(f"w{i}" for i in range(100))
    docs = spark.createDataFrame([(1, "a", text), (2, "b", text), (3, "b", " ".join(f"v{i}" for i in range(300)))], "doc_id long, source string, text string")
    mix = mixing.mixed(docs, "doc_id", "source", "text", spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], TARGETS))
    report = {r.source: r for r in mix.report.collect()}
    assert (report["a"].available, report["b"].available) == (100, 400)
    assert (report["a"].quota, report["b"].quota) == (250, 250) and not report["a"].reachable and report["b"].reachable
    assert [(r.id, r.copies) for r in mix.documents.where("source = 'a'").collect()] == [(1, 1)]
    copies = spark.createDataFrame([(i, s, text) for s, own in (("a", range(3)), ("b", range(10, 12))) for i in own], "doc_id long, source string, text string")
    mix = mixing.mixed(copies, "doc_id", "source", "text", spark.createDataFrame([("a", 0.6, 1), ("b", 0.4, 1)], TARGETS))
    assert {r.source: (r.available, r.used) for r in mix.report.collect()} == {"a": (300, 300), "b": (200, 200)}
    assert sorted((r.id, r.copies) for r in mix.documents.collect()) == [(0, 1), (1, 1), (2, 1), (10, 1), (11, 1)]


def test_more_targets_than_the_flow_takes_are_refused(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUPS", 2)
    docs = spark.createDataFrame([(1, "a", "x")], "doc_id long, source string, text string")
    with pytest.raises(ValueError, match="target sources"):
        mixing.mixed(docs, "doc_id", "source", "text", spark.createDataFrame([(s, 0.3, 1) for s in "abc"], TARGETS))


def test_mix_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, text string")
    mix = mixing.mixed(docs, "doc_id", "source", "text", spark.createDataFrame([("a", 1.0, 1)], TARGETS))
    assert mix.documents.count() == 0 and mix.report.first().used == 0
    none = mixing.mixed(docs, "doc_id", "source", "text", spark.createDataFrame([], TARGETS))
    assert none.report.count() == 0


# --- stuffed pages


def sentences(r, n):
    nouns, verbs, more = "engine window cursor table record ledger garden bridge".split(), "keeps moves finds holds reads".split(), "quiet narrow careful bright small".split()
    return " ".join(f"The {r.choice(more)} {r.choice(nouns)} {r.choice(verbs)} a {r.choice(more)} {r.choice(nouns)} near the {r.choice(nouns)}." for _ in range(n))


def test_stuffed_pages_are_told_from_prose(spark):
    r = random.Random(1)
    bag = "engine window cursor table quiet narrow bright cheap ledger".split()
    prose = [(i, sentences(r, 12)) for i in range(60)]
    salad = [(100 + i, " ".join(r.choice(bag) for _ in range(150))) for i in range(3)]
    links = [(110, "\n".join(f"- [{r.choice(bag)} {r.choice(bag)}](http://x.example/{i})" for i in range(20))), (111, "\n".join(f"https://y.example/{r.choice(bag)}?id={i}" for i in range(20)))]
    orders = [(120, " ".join(f"Order {r.choice(bag[:3])} {r.choice(bag[:3])} now!" for _ in range(60)))]
    good = [(200, "```\n" + "x = call(y)\n" * 40 + "```\n"), (201, "| a | b |\n| - | - |\n" + "| engine | 3 |\n" * 30), (202, "\n".join("- " + sentences(r, 1) for _ in range(15))),
            (203, sentences(r, 12) + "\n\n" + " ".join(r.choice(bag) for _ in range(60)))]
    rows = prose + salad + links + orders + good + [(300, None), (301, ""), (302, "x")]
    df = spark.createDataFrame([(*x, 0.5) for x in rows], "doc_id long, text string, share double")
    found = {x.id: x.share for x in spam.stuffed(df, "doc_id", "text").collect()}
    assert {i for i, s in found.items() if s > 0.5} == {100, 101, 102, 110, 111, 120}
    assert set(found) == {i for i, _ in rows} and found[300] == found[301] == 0 and 0 < found[203] < 0.5
    joined = {x.id: x.share for x in spam.stuffed(df, "doc_id", "text", spam.SpamSettings(held=0)).collect()}
    assert joined == pytest.approx(found)


def test_pair_counts_pass_the_driver_in_pieces(spark, monkeypatch):
    texts = [sentences(random.Random(i), 12) for i in range(40)] + [" ".join(random.Random(9).choices(["engine", "window", "cheap", "table"], k=90))] * 2
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    joined = {x.id: x.share for x in spam.stuffed(df, "doc_id", "text", spam.SpamSettings(held=0)).collect()}
    sent, broadcast = [], spark.sparkContext.broadcast
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda value: sent.append(value) or broadcast(value))
    monkeypatch.setattr(type(df), "toPandas", lambda self: pytest.fail("the driver takes all pairs at once"))
    monkeypatch.setattr(spam, "PIECE", 30, raising=False)
    found = {x.id: x.share for x in spam.stuffed(df, "doc_id", "text").collect()}
    keys, n, m = spam._counted(spam.Read(texts))
    pieces = [dict(zip(spam.np.frombuffer(k, spam.U64).tolist(), spam.np.frombuffer(v, spam.np.float32).tolist(), strict=True)) for k, v in sent]
    assert len(pieces) > 1 and all(0 < len(x) <= 30 for x in pieces)
    assert {k: v for x in pieces for k, v in x.items()} == dict(zip(keys[m > 1].tolist(), n[m > 1].tolist())) and sum(map(len, pieces)) == (m > 1).sum()
    assert found == pytest.approx(joined) and max(found.values()) > 0.5


def test_coherence_holds_at_any_size():
    texts = [sentences(random.Random(i), 12) for i in range(40)]
    keys, n, m = spam._counted(spam.Read(texts))
    one, many = (spam.judge(texts[:5], spam.Counts(keys[m > 1], times * n[m > 1]), spam.SpamSettings()) for times in (1, 100))
    assert all(a[0][2] == pytest.approx(b[0][2], abs=0.4) and b[0][2] > a[0][2] > 0.3 for a, b in zip(one, many))


def test_stuffed_pages_of_an_empty_table(spark):
    assert spam.stuffed(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text").count() == 0


def test_reachable_follows_the_flow(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a", "one two three"), (2, "b", "four")], "id long, source string, text string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1), ("c", 0.0, 1)], "source string, target_share double, max_repeats int")
    mix = mixing.mixed(docs, "id", "source", "text", targets, share_texts=False)
    assert {r.source: r.reachable for r in mix.report.collect()} == {"a": True, "b": False, "c": True}
    assert mixing.filled({(("a",), "a"): 2.0}, {"a": 2}, [("a", 0.5, 1)], 4) == {"a": True}
    monkeypatch.setattr(mixing, "route", lambda sizes, wanted, total: {(g, s): 0.0 for g in sizes for s in g})
    with pytest.raises(RuntimeError, match="disagree"):
        mixing.mixed(docs, "id", "source", "text", targets, share_texts=False)
