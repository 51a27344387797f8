from __future__ import annotations

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from evidara.functions import columns as C
from evidara.functions import ids
from evidara.functions.stem import stem
from evidara.operators.calibrate import beta_cdf


def one(spark, column, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) if v is not None else F.lit(None).cast("double").alias(k) for k, v in values.items()))
    return df.select(column.alias("x")).first().x


# pairs of the published sample vocabulary
@pytest.mark.parametrize("word, stem_", [("consistency", "consist"), ("consolingly", "consol"), ("knightly", "knight"), ("knitting", "knit"), ("generously", "generous"), ("hopping", "hop"), ("hoping", "hope"), ("dying", "die"), ("cries", "cri"), ("ties", "tie"), ("by", "by"), ("news", "news")])
def test_stem(word, stem_):
    assert stem(word) == stem_


def test_sigmoid_and_logit_do_not_overflow(spark):
    assert one(spark, C.sigmoid("x"), x=-1000.0) == 0.0
    assert one(spark, C.sigmoid("x"), x=1000.0) == 1.0
    assert one(spark, C.logit("x"), x=0.5) == pytest.approx(0)
    assert math.isfinite(one(spark, C.logit("x"), x=1.0)) and math.isfinite(one(spark, C.logit("x"), x=0.0))
    assert one(spark, C.logit("x"), x=None) is None


def test_shingles_need_as_many_words(spark):
    df = spark.createDataFrame([("a b",), ("a b c a b c",), (None,), ("",)], "t string")
    got = [r.s for r in df.select(C.shingles(C.words("t")).alias("s")).collect()]
    assert got == [[], ["a b c", "b c a", "c a b"], [], []]


def test_unit_of_zero_is_zero(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "v array<float>")
    assert [r.u for r in df.select(C.unit("v").alias("u")).collect()] == [[0.0, 0.0], [0.6, 0.8]]


def test_row_score_takes_the_first_there_is(spark):
    df = spark.createDataFrame([(0.9, 2.0, 0.5), (None, 2.0, 0.5), (None, None, 1.0), (None, None, None)], "r double, b double, d double")
    assert [r.s for r in df.select(C.row_score("r", "b", "d").alias("s")).collect()] == [0.9, 2.0, 0.5, 0.0]


def test_citation(spark):
    df = spark.createDataFrame([("a", 3, 4, 10, 20), ("b", None, None, 5, 5), ("c", 2, 2, None, None)], "n string, p int, q int, l int, m int")
    assert [r.c for r in df.select(C.citation(*map(F.col, "npqlm")).alias("c")).collect()] == ["a p.3-4 L10-20", "b L5", "c p.2"]


def test_question_terms(spark):
    df = spark.createDataFrame([("What does the Cache of a cache do, on 2 disks?",), (None,)], "q string")
    assert [r.t for r in df.select(C.question_terms("q").alias("t")).collect()] == [["cache", "disks"], []]


def test_base58_is_padded_and_reversible():
    assert ids.base58(b"\0" * 16) == "1" * 22
    digest = hashlib.md5(b"x").digest()
    n = 0
    for c in ids.base58(digest):
        n = n * 58 + ids.ALPHABET.index(c)
    assert n.to_bytes(16, "big") == digest


@pytest.mark.parametrize("name, stored", [("Ünder Cover (2).PDF", "under-cover-2.pdf"), ("plain", "plain"), ("…", "document")])
def test_stored_name(name, stored):
    assert ids.stored_name(name) == stored


def test_beta_cdf_against_closed_forms():
    assert beta_cdf(2, 3, 0.4) == pytest.approx(0.5248)
    assert beta_cdf(1, 1, 0.3) == pytest.approx(0.3)
    assert beta_cdf(0.5, 0.5, 0.3) == pytest.approx(2 / math.pi * math.asin(math.sqrt(0.3)))
    assert beta_cdf(2, 2, 0) == 0 and beta_cdf(2, 2, 1) == 1
