"""Sources whose sizes are in exact proportion to their weights get their share; rows that are alike are sampled one by one."""

from collections import Counter

import pytest

from weftgraph.llm import mixing

SCHEMA = "doc_id long, text string, source string"


def test_op2_ties(spark):
    docs = spark.createDataFrame([(i, "one two three four five six seven eight nine ten", "a" if i < 10 else "b") for i in range(30)], SCHEMA)
    got = {r["source"]: r["target"] for r in mixing.plan(mixing.numbered(mixing.sized_rows(docs))).collect()}
    assert {k: round(v, 6) for k, v in got.items()} == {"a": 100.0, "b": 200.0}


@pytest.mark.parametrize("bits", [16, 4])
def test_op2_repeated_rows(spark, monkeypatch, bits):
    """3,000 rows without an id, all alike or alike in size: their words come within a document of the target."""
    monkeypatch.setattr(mixing, "CHUNK_BITS", bits)
    rows = [(None, "one two three four", "a") for _ in range(1500)] + [(None, f"one two three n{i}", "a") for i in range(1500)]
    rows += [(i, "one two three four", "b") for i in range(3000)] + [(7, "five six", "b")] * 5
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = mixing.mix(docs).collect()
    for source in "ab":
        taken, target = sum(r["taken"] for r in got if r["source"] == source), {r["target"] for r in got if r["source"] == source}
        assert abs(taken - target.pop()) <= 4
    again = mixing.mix(docs.repartition(2)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    words = Counter()
    for r in mixing.mix_rows(docs).collect():
        words[r["source"]] += len(r["text"].split())
    assert words == Counter({s: sum(r["taken"] for r in got if r["source"] == s) for s in "ab"})
