"""Terms, candidates, picks and the vocabulary by value."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidara.operators import descriptors

RUN = "collection string, document_id string, position int, depth int, seq_start int, seq_end int"


def terms(text, stemmed=False):
    return [t for t, _ in descriptors.phrases(text, stemmed)]


def test_phrases_stay_within_a_clause():
    assert terms("Aggregate root, of the **aggregate** root.") == ["aggregate", "root", "aggregate root"] * 2
    assert terms("root of the aggregate") == ["root", "aggregate"]
    assert terms("don't split charac-\nteristics it’s 2024 ab") == ["split", "characteristics", "split characteristics"]
    assert terms("events (stored) | replayed\n\nlater") == ["events", "stored", "replayed", "later"]
    assert terms("Aggregates aggregate", True) == ["aggreg", "aggreg", "aggreg aggreg"]
    assert terms("") == terms(None) == terms("...") == []


def test_terms_are_shown_as_mostly_written(spark):
    rows = spark.createDataFrame([("x", "Roots root roots"), ("x", None), ("x", "")], "c string, text string")
    forms = descriptors.term_forms(rows, ["c"], "text")
    assert {r.term: r.form for r in descriptors.shown(forms, ["c"]).collect()}["root"] == "Roots"  # one use each: the first by name
    assert {r.term: r.tf for r in descriptors.class_terms(rows, ["c"], "text").collect()} == {"root": 3, "root root": 2}


def test_candidates_are_used_twice_unless_there_are_few(spark):
    long = " ".join(f"word{i} word{i}." for i in range(6)) + " once."
    rows = spark.createDataFrame([("a", long), ("b", "short text"), ("c", "everywhere. everywhere.")], "c string, text string")
    got: dict = {}
    for r in descriptors.candidates(descriptors.class_terms(rows, ["c"], "text", False), ["c"]).collect():
        got.setdefault(r.c, set()).add(r.term)
    assert "once" not in got["a"] and {f"word{i}" for i in range(6)} <= got["a"]
    assert got["b"] == {"short", "text", "short text"}
    wide = spark.createDataFrame([(c, "everywhere. everywhere.") for c in "xyz"], "c string, text string")
    assert descriptors.candidates(descriptors.class_terms(wide, ["c"], "text", False), ["c"]).count() == 3  # nothing else is left of them


def test_picks_go_on_until_there_are_enough(spark):
    rows = [("a", "core", 9.0)] + [("a", f"core extra{i}", 8.0 - i / 100) for i in range(90)] + [("a", "other", 0.2), ("a", "third", 0.1), ("b", "lone", 1.0)]
    df = spark.createDataFrame(rows, "c string, term string, weight double")
    assert {r.c: r.descriptors for r in descriptors.picked(df, ["c"], k=3, first=4).collect()} == {"a": ["core", "other", "third"], "b": ["lone"]}
    assert descriptors.picked(df.where("false"), ["c"]).count() == 0


def test_sections_are_described_against_their_siblings(spark):
    chunks = spark.createDataFrame([("c", "d", 1, "Events shared. Events shared. Stores stores."), ("c", "d", 2, "Shared shared. Queues queues."), ("c", "d", 3, "shared shared. Queues")], "collection string, document_id string, seq int, text string")
    runs = spark.createDataFrame([("c", "d", 0, 0, 1, 3), ("c", "d", 1, 1, 1, 1), ("c", "d", 2, 1, 2, 2), ("c", "d", 3, 1, 3, 3)], RUN)
    got = {r.position: r.descriptors for r in descriptors.described(chunks, runs).collect()}
    assert "shared" not in [x.lower() for x in got[1]] and got[1][0].lower() in ("events", "stores") and got[0][0].lower() == "shared"


def test_variants_of_the_same_words(spark):
    rows = [("data base", "database"), ("event stores", "event store"), ("event store", "store event"), ("", ""), ("c++", "c"), ("über", "ueber")]
    got = [r.same for r in descriptors.same_words(spark.createDataFrame(rows, "a string, b string")).collect()]
    assert got == [True, True, False, False, True, False]


def test_concepts_take_the_nearest_preferred_term(spark):
    uses = spark.createDataFrame([("aa", 5, "AA"), ("bbb", 5, "BBB"), ("c", 1, "C"), ("dd", 2, "DD"), ("e", 1, "E")], "variant string, uses long, shown string")
    pairs = spark.createDataFrame([("aa", "c", 0.95), ("bbb", "c", 0.97), ("c", "dd", 0.99), ("bbb", "dd", 0.94)], "a string, b string, cosine double")
    verdicts = spark.createDataFrame([("j", "aa", "c", 0.9), ("j", "bbb", "c", 0.9), ("j", "c", "dd", 0.9), ("k", "bbb", "dd", 0.9)], "judge string, a string, b string, score double")
    one = descriptors.one_concept(pairs, verdicts, "j", 0.5)
    found = {r.variant: r.preferred for r in descriptors.preferred(uses.select("variant", "uses"), one).collect()}
    assert found == {"aa": "aa", "bbb": "bbb", "dd": "dd", "c": "dd", "e": "e"}
    terms_ = {r.variant: (r.term, r.uses, r.variants) for r in descriptors.vocabulary_terms(uses, descriptors.preferred(uses.select("variant", "uses"), one)).collect()}
    assert terms_["dd"] == ("DD", 3, ["dd", "c"]) and len(terms_) == 4
    assert {(r.a, r.b) for r in descriptors.pairs_to_ask(pairs, verdicts, "j").collect()} == {("bbb", "dd")}
    vectors = spark.createDataFrame([("m", "aa"), ("n", "c")], "model string, variant string")
    assert {r.variant for r in descriptors.missing_vectors(uses, vectors, "m").collect()} == {"bbb", "c", "dd", "e"}


def test_neighbours_of_a_block_read_the_rows_once(spark):
    given = [(f"i{n:02d}", [1.0, n // 8 / 10]) for n in range(24)] + [("j", [0.0, -1.0])]
    rows = spark.createDataFrame(given, "id string, v array<float>").groupBy("id").agg(F.max("v").alias("v"))
    found = [descriptors.pairs_to_judge(rows, "id", "v", k=3, least=0.999, block=block) for block in (100, 1)]
    plans = [f._jdf.queryExecution().executedPlan().toString() for f in found]
    assert plans[0].count("Exchange") == plans[1].count("Exchange") and not any("Scan ExistingRDD" in p for p in plans)
    # of eight equal vectors each pairs with the first three others
    wanted = {(f"i{8 * g + a:02d}", f"i{8 * g + b:02d}") for g in range(3) for b in range(8) for a in range(min(b, 4 if b < 4 else 3))}
    for f in found:
        assert {(r.a, r.b) for r in f.collect()} == wanted


def test_concepts_read_the_pairs_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(it):
        for b in it:
            read.add(b.num_rows)
            yield b

    uses = spark.createDataFrame([(v, n) for n, v in enumerate("abcdef")], "variant string, uses long")
    same = spark.createDataFrame([("a", "b", 0.95), ("b", "c", 0.96), ("c", "d", 0.97), ("c", "e", 0.94)], "a string, b string, cosine double").mapInArrow(counted, "a string, b string, cosine double")
    assert {r.variant: r.preferred for r in descriptors.preferred(uses, same).collect()} == {"a": "b", "b": "b", "c": "d", "d": "d", "e": "e", "f": "f"}
    assert read.value == 4
