"""Every registered query with SQL gives DuckDB's rows at the smallest scale."""

import math

import duckdb
import pytest

from weftgraph import registry

SF = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("lineitem", "part", "events", "customer", "orders", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if v is None or isinstance(v, bool | str):
        return v
    return round(float(v), 9)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_duckdb(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    found = duck.execute(SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=str)


def test_graphml_round_trip_of_any_size(spark, monkeypatch):
    """The query writes its whole graph also where a command would refuse the file's size."""
    from weftgraph.sources import files

    monkeypatch.setattr(files, "graphml_size", lambda pairs, left, right: spark.createDataFrame([(3 << 30,)], "n_bytes long"))
    rows = registry.queries()["graphml_round_trip"](spark, SF)
    edges = registry.users_items(spark, SF)
    assert rows.where("kind = 'edge'").count() == edges.count() and rows.where("kind = 'user_id'").count() == edges.select("user_id").distinct().count()


def test_edge_overlap_writes_no_edges(spark, duck, monkeypatch):
    """The edges of both graphs are counted where they arise; no table of them is written or looked up."""
    written = []
    monkeypatch.setattr(registry, "graph", lambda *a: written.append(a))
    row = registry.queries()["edge_overlap"](spark, SF).first()
    assert not written and tuple(row) == duck.execute(SQL["edge_overlap"]).fetchone()
