"""Dedup of rows whose ids are null or stand on several texts."""

import pytest

from pathloom.llm import exact, simhash

SCHEMA = "doc_id long, text string, lang string"

UNIQUE = ["one clean text about rivers and the hills behind them", "another text on bread, salt and a long winter at sea", "third text: machines hum while nobody listens to them", "a fourth one tells of glass, sand, fire and patient hands"]


@pytest.mark.parametrize("stage", [exact.dedup, simhash.dedup])
def test_null_and_reused_ids_lose_no_text(spark, stage):
    rows = [(None, UNIQUE[0]), (None, UNIQUE[1]), (5, UNIQUE[2]), (5, UNIQUE[3]), (None, UNIQUE[2]), (None, "same words"), (None, "same words"), (7, None), (None, ""), (None, None)]
    docs = spark.createDataFrame([(i, t, None) for i, t in rows], SCHEMA).repartition(3)
    got = stage(docs)
    assert got.columns == docs.columns
    kept = [(r["doc_id"], r["text"]) for r in got.collect()]
    assert sorted(t or "" for _, t in kept) == sorted([*UNIQUE, "same words", ""])
    assert (5, UNIQUE[2]) in kept and (5, UNIQUE[3]) in kept and (None, UNIQUE[0]) in kept and 7 in [i for i, _ in kept]


def test_exact_keeps_the_longest_row_of_a_repeated_id(spark):
    docs = spark.createDataFrame([(1, "a b", None), (1, "a  b", None), (1, "ab", None), (2, "a b", None)], SCHEMA)
    assert [r["text"] for r in exact.dedup(docs).collect()] == ["a  b"]
