"""Scores of candidates on small cases worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from sextant.functions import lexical
from sextant.operators import neighbours, scoring


@pytest.fixture(scope="module")
def asked(spark):
    queries = spark.createDataFrame([(0, "cached rings"), (1, None), (2, "")], "query_id int, query string")
    idf = spark.createDataFrame([("cached", 2.0)], "term string, idf double")
    return scoring.query_terms(queries, idf).cache()


def test_terms_of_null_and_empty_queries_are_none(asked):
    assert {(r.query_id, r.term, r.idf) for r in asked.collect()} == {(0, "cached", 2.0), (0, "rings", 1.0)}


def test_matches_in_blocks_equal_matches_at_once(spark, asked, monkeypatch):
    words = spark.createDataFrame([("cach",), ("ring",), ("string",), ("ngs",), ("x",)], "term string")
    rows = lambda: sorted(tuple(r) for r in scoring.term_matches(asked.filter("query_id = 0"), words).collect())
    once = rows()
    monkeypatch.setattr(scoring, "BROADCAST_TERMS", 2)
    assert rows() == once and any(r[4] == "string" and math.isclose(r[5], 4 / 6) for r in once)


def test_an_equal_variant_ends_a_name(spark, asked):
    names = spark.createDataFrame([(7, "ring"), (8, "cache")], "id long, term string")
    got = {r.id: (r.score, r.matched) for r in scoring.name_scores(asked.filter("query_id = 0"), names).collect()}
    # each term occurs twice, as a token and as a word of a split name
    assert got[7] == (6.0, 2)  # ring is an equal variant and comes before rings
    assert math.isclose(got[8][0], 2 * 2.0 * 2 * (4 / 5 + 5 / 6)) and got[8][1] == 4  # cach, cached


def test_empty_tables_give_no_rows(spark, asked):
    none = spark.createDataFrame([], "id long, term string, w double")
    edges = spark.createDataFrame([], "source_id long, target_id long, kind string, weight double")
    scores = scoring.term_scores(asked, none)
    assert scoring.coverage(asked, none).isEmpty() and scores.isEmpty()
    assert neighbours.walk(edges, none.selectExpr("0 AS query_id", "id"), asked, scores).isEmpty()
    assert scoring.result_roles(edges).isEmpty() and scoring.edge_mix(edges).isEmpty()


def test_a_channel_of_null_did_not_find(spark):
    row = spark.range(1).select(scoring.agreement(F.lit(None).cast("boolean"), F.lit(True), F.lit(True)).alias("x")).first()
    assert row.x == 1.05


def test_questions(spark):
    texts = ["where is the retry limit", "what does open_file call", "one two", None, "Parse XmlNode trees lazily", "how do requests reach handlers"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r.q for r in df.orderBy("i").select(lexical.is_question(F.col("t")).alias("q")).collect()] == [True, False, False, False, False, True]


def test_a_walk_halves_with_each_hop_and_takes_the_least_weight(spark):
    edges = spark.createDataFrame([(1, 2, "calls"), (2, 3, "tests"), (3, 4, "calls")], "source_id long, target_id long, kind string")
    asked = spark.createDataFrame([(0, 0, 1.0)], "query_id int, place int, idf double")
    scores = spark.createDataFrame([(0, 0, i, 2.0) for i in (2, 3, 4)], "query_id int, place int, id long, score double")
    got = {r.id: (round(r.evidence, 9), r.from_seeds) for r in neighbours.walk(edges, spark.createDataFrame([(0, 1)], "query_id int, id long"), asked, scores).collect()}
    assert got == {2: (1.0, 1), 3: (0.15, 1)}
