"""Every catalogue query with SQL against a second engine, over whole tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from evidara.plans import catalogue
from evidara.plans.oracles import CORPUS

ORACLES = catalogue.oracle_sql()


def plain(x):
    if isinstance(x, float):
        return "nan" if x != x else repr(round(x, 6) + 0.0)
    if isinstance(x, (list, tuple)):
        return str([plain(y) for y in x])
    return str(int(x)) if type(x).__name__ == "Decimal" else str(x)


def rows(data, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, small, duck, name):
    found = catalogue.queries()[name](spark, small)
    wanted = duck.sql(ORACLES[name])
    assert rows([tuple(r) for r in found.collect()], found.columns) == rows(wanted.fetchall(), wanted.columns)


@pytest.mark.parametrize("name", ["answer_chunks", "answer_excerpts", "answer_report", "answer_sections", "answer_map_documents", "answer_several", "answer_aspects", "facility_location_map", "map_by_rank", "interleave_questions", "section_descriptors", "vocabulary_terms", "same_titles", "chunk_documents"])
def test_query_without_sql_runs(spark, small, name):
    assert catalogue.queries()[name](spark, small).count() > 0


def test_section_vectors_count_zero_vectors(spark, tmp_path):
    chunks = [("c", "d", 1, ["A"], "x", [3.0, 4.0]), ("c", "d", 2, ["A", "B"], "x", [0.0, 0.0]), ("c", "d", 3, ["C"], "x", None), ("c", "e", 1, [], "x", [0.0, 0.0]), ("c", "f", 1, [], "x", [float("nan"), 1.0])]
    chunks = [(*r, n, n + 1) for n, r in enumerate(chunks)]
    spark.createDataFrame(chunks, "collection string, document_id string, seq int, headings array<string>, text string, vector array<float>, char_start int, char_end int").coalesce(1).write.parquet(f"{tmp_path}/chunks.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW chunks AS SELECT * FROM '{tmp_path}/chunks.parquet/*.parquet'")
    found, wanted = catalogue.queries()["section_vectors"](spark, str(tmp_path)), c.sql(ORACLES["section_vectors"])
    assert rows([tuple(r) for r in found.collect()], found.columns) == rows(wanted.fetchall(), wanted.columns)
    assert {(r.document_id, r.position): (r.rows, r.first, r.norm) for r in found.collect()} == {("d", 0): (2, 0.3, 0.5), ("d", 1): (2, 0.3, 0.5), ("d", 2): (1, 0.0, 0.0), ("e", 0): (1, 0.0, 0.0), ("f", 0): (1, 0.0, 0.0)}


@pytest.mark.parametrize("name", ["vocabulary_preferred", "vocabulary_terms", "embedding_overlap"])
def test_chunks_are_read_before_neighbours_are_joined(spark, small, name):
    found = catalogue.queries()[name](spark, small)
    assert "chunks.parquet" not in found._jdf.queryExecution().executedPlan().toString()  # what comes from them is written once


def test_vocabulary_terms_stand_for_every_id(spark, small, duck):
    found = catalogue.queries()["vocabulary_terms"](spark, small).collect()
    names = [v for r in found for v in r.variants.split(",")]
    assert (sum(r.uses for r in found), len(names), len(set(names))) == duck.sql(f"WITH {CORPUS} SELECT count(*), count(DISTINCT id), count(DISTINCT id) FROM corpus").fetchall()[0]
