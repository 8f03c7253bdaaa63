"""Keywords and regions that stand late in a question, against the queries' SQL."""

import os

import pytest
from oracle_check import compare, duck

from kpiloom.plans.registry import ORACLE, QUERIES, load_all

SF = os.environ.get("KPILOOM_TEST_SF", "/root/testdata/sf0.001")
FAR = "hello there " * 8  # no keyword, longer than any prefix

load_all()


@pytest.fixture(scope="module")
def late(spark, tmp_path_factory):
    """The smallest tables, with conversations of their own."""
    d = tmp_path_factory.mktemp("late")
    for f in os.listdir(SF):
        if f != "conversations.parquet":
            os.symlink(f"{SF}/{f}", d / f)
    texts = [FAR + "so show the north market please", FAR + "and tell me a joke", FAR + "so what of revenue", "one"]
    rows = [(k, turn, "user", t) for k, t in enumerate(texts) for turn in (0, 1)]  # both parities of conv_id + turn
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{d}/conversations.parquet")
    return str(d)


def test_late_regions_are_answered(spark, late):
    got = {(r["conv_id"], r["turn"]): r for r in QUERIES["region_answers_plain"](spark, late).collect()}
    assert all(got[0, turn]["ref_region"] == "North" and got[0, turn]["region_found"] for turn in (0, 1))


def test_late_keywords_are_accepted(spark, late):
    got = {(r["conv_id"], r["turn"]): r["accepted"] for r in QUERIES["answer_confidence_plain"](spark, late).collect()}
    assert got == {(k, turn): x for k, x in enumerate((True, False, True, True)) for turn in (0, 1)}


def test_late_keywords_beside_the_planted_questions(spark, late):
    """Own texts are read whole in the derived forms too."""
    regions = {(r["conv_id"], r["turn"]): r["region_found"] for r in QUERIES["region_answers"](spark, late).where("NOT planted").collect()}
    assert regions[0, 0] and regions[0, 1]
    asked = QUERIES["asked_gate_intent"](spark, late)
    assert asked.where("planted").count() == asked.where("NOT planted").count() == 8
    got = {(r["conv_id"], r["turn"]): r["accepted"] for r in asked.where("NOT planted").collect()}
    assert got == {(k, turn): x for k, x in enumerate((True, False, True, True)) for turn in (0, 1)}


@pytest.mark.parametrize("name", ["region_answers_plain", "answer_confidence_plain", "region_answers", "region_answers_by_segment", "question_answers",
                                  "question_answers_noprofit", "question_answers_by_entity", "answer_confidence", "asked_gate_intent"])
def test_late_texts_match_the_sql(spark, late, name):
    con = duck_of(late)
    r = compare(spark, con, name, QUERIES[name], ORACLE[name], late)
    assert r["cols_match"] and r["rows"] == r["oracle_rows"] and (r["exact"] or r["approx"]), r


def duck_of(late):
    con = duck(SF)
    con.execute(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM read_parquet('{late}/conversations.parquet/*.parquet')")
    return con
