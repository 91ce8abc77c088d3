"""Scalars by hand-computed cases."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sessionloom.functions import similarity as S
from sessionloom.functions import text as T


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return row.select(column).first()[0]


@pytest.mark.parametrize(("text", "expected"), [("1:56 pm on 8 May, 2023", "2023/05/08"), ("10 sep 2021", "2021/09/10"), ("3 Foo 2023", "2023/00/03"), ("nothing", "nothing"), ("", ""), (None, "")])
def test_long_dates(spark, text, expected):
    assert one(spark, T.parse_long_date(F.lit(text).cast("string"))) == expected


@pytest.mark.parametrize(("a", "b", "strict", "gap"), [("2023/5/2", "2023/05/20 (Sat) 02:21", False, 18.0), ("2023-05-20 00:00:00", "2023-05-19", False, 1.0), ("2023-05-20", "2023-05-19", True, 0.0), ("2023/05/20", "2023-05-19", False, 0.0), ("2023/00/08", "2023/05/08", False, 0.0), ("", "2023/05/08", False, 0.0)])
def test_time_gap(spark, a, b, strict, gap):
    assert one(spark, T.time_gap(F.lit(a), F.lit(b), strict)) == gap


@pytest.mark.parametrize(("expected", "output", "match"), [("5", "there are 15", True), ("7", "there are 15", False), ("12 days", "after 12 nights", True), ("12 days", "the days", False), ("Crème, brûlée!", "a crème brûlée", True), ("red big car", "a car that is big and red", True), ("one two three four", "four three two one", False), ("!!", "words", True), ("", "words", False), (None, "words", False), ("words", " ", False), ("1_0", "10", False), ("inf", "x", False)])
def test_answer_match(spark, expected, output, match):
    assert one(spark, T.answer_match(F.lit(expected), F.lit(output))) is match


def test_names_and_lists(spark):
    assert one(spark, F.array_join(T.evidence_prefix(F.array(*map(F.lit, ("D1:3", "D2", "D1:5", "D3:1:2")))), ",")) == "D1,D3"
    assert one(spark, F.array_join(T.origin_ids(F.lit(" a, b;;c ")), "|")) == "a|b|c"
    assert one(spark, F.array_join(T.session_union(F.array(F.lit("a"), F.lit("")), F.lit("b")), ",")) == "a,b"
    assert one(spark, T.answer_or_default(F.lit(""))) == T.NO_ANSWER and one(spark, T.answer_or_default(F.lit("0"))) == "0"
    assert one(spark, T.triple_string(F.lit("a"), F.lit(""), F.lit("c"))) is None
    assert one(spark, S.name_similarity(F.lit("Ann Lee"), F.lit("lee smith"))) == pytest.approx(1 / 3 + 0.2)
    assert one(spark, S.jaccard(F.lit(""), F.lit("a"))) == 0.0


def test_vectors(spark):
    a, zero = F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, S.cosine(a, F.array(F.lit(2.0), F.lit(4.0)))) == pytest.approx(1.0)
    assert one(spark, S.cosine(a, F.array(F.lit(2.0), F.lit(4.0)), dim=2)) == pytest.approx(1.0)
    assert one(spark, S.cosine(a, zero)) is None
    assert one(spark, S.cosine(a, zero, floor=1e-8)) == 0.0


def test_scaling(spark):
    rows = spark.createDataFrame([(1, 0.0), (1, 0.0), (2, 1.0), (2, 3.0)], "k int, x double")
    w = Window.partitionBy("k")
    got = [tuple(r) for r in rows.select("k", S.minmax("x", w), S.share("x", w)).orderBy("k", "x").collect()]
    assert got == [(1, 1.0, 0.5), (1, 1.0, 0.5), (2, 0.0, 0.25), (2, 1.0, 0.75)]
