"""Columns of odd names and very long texts."""

import re
import time

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import data
from weftgraph.llm import pii

ODD = ("_h", "_spans", "_gone", "_row", "_id", "key", "spans", "occurrence", "a.b", "c`d", "_times", "body_hash")


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:-1])
def test_stages_leave_odd_columns_alone(spark, name, stage):
    docs = data.frame(spark, 120).select("doc_id", "text", "source", "lang", "n_chars", *[F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(c) for c in ODD])
    got = stage(spark, docs, "")
    assert got.columns == docs.columns
    rows = got.collect()
    assert rows and all(r[c] == c + (str(r["doc_id"]) if r["doc_id"] is not None else "none") for r in rows for c in ODD)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_of_an_empty_table(spark, name, stage):
    assert stage(spark, data.empty(spark), "").count() == 0


def test_op1_time_grows_with_the_matches(spark):
    texts = {n: " ".join(f"user{i}@mail{i % 7}.example.org" for i in range(n)) for n in (200, 30_000)}
    docs = spark.createDataFrame([(n, t) for n, t in texts.items()] + [(1, texts[200] + " +12 (345) 678-9012")], "doc_id long, text string")
    began = time.time()
    got = {r["doc_id"]: r for r in pii.digest(pii.find(docs)).collect()}
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert time.time() - began < 60
    assert got[30_000]["n_email"] == 30_000 and got[200]["n_email"] == 200
    spans = [tuple(map(int, x.split(":")[1:])) for x in got[30_000]["spans"].split(",") if x.startswith("email")]
    assert spans == [m.span() for m in re.finditer(r"\S+", texts[30_000])]
    assert clean[30_000] == " ".join(["[EMAIL]"] * 30_000) and clean[1].endswith("[EMAIL] [PHONE]")
