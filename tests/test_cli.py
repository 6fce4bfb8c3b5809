"""The command line, the store of aggregates and the checks that go with them."""

import json

import pytest

from weftgraph.cli import main
from weftgraph.operators import contracts, projection
from weftgraph.sources import aggregates, files

PAIRS = [(u, i) for u in range(12) for i in range(6) if (u * 7 + i * 3) % 5 < 3]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def pairs(spark, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('cli')}/pairs.parquet"
    spark.createDataFrame(PAIRS, "user_id long, app_id long").write.parquet(path)
    return path


def test_store_gives_the_edges_of_a_projection(spark, pairs, tmp_path):
    all_pairs = spark.read.parquet(pairs)
    want = rows(projection.project_pairs(all_pairs))
    aggregates.save(all_pairs, f"{tmp_path}/all")
    aggregates.save(all_pairs.where("user_id < 5"), f"{tmp_path}/a")
    aggregates.save(all_pairs.where("user_id >= 5"), f"{tmp_path}/b")
    assert rows(aggregates.edges(spark, f"{tmp_path}/all")) == want
    assert rows(aggregates.edges(spark, f"{tmp_path}/a", f"{tmp_path}/b").select("src", "dst", "shared", "weight")) == want
    assert aggregates.delete(spark, f"{tmp_path}/a") and not (tmp_path / "a").exists()
    spark.range(3).write.parquet(f"{tmp_path}/odd/pairs")
    with pytest.raises(contracts.ContractError):
        aggregates.reopen(spark, f"{tmp_path}/odd")


def test_commands_in_a_row(spark, pairs, tmp_path):
    at = lambda name: f"{tmp_path}/{name}"
    main(["base", "--interactions", pairs, "--out", at("base")], spark)
    main(["core", "--interactions", pairs, "--min-users", "2", "--out", at("core.csv")], spark)
    assert rows(files.read_table(spark, at("core.csv"))) == sorted(PAIRS)
    main(["universe", "--left", at("base"), "--right", pairs, "--out", at("ids")], spark)
    main(["project", "--pairs", at("base"), "--universe", at("ids"), "--estimate-only", "--out", at("estimate")], spark)
    main(["project", "--pairs", at("base"), "--store", at("store"), "--skip-export"], spark)
    main(["project", "--store", at("store"), "--reuse", "--delete-store", "--out", at("edges")], spark)
    want = rows(projection.project_pairs(spark.read.parquet(pairs)))
    assert rows(spark.read.parquet(at("edges"))) == want and not (tmp_path / "store").exists()
    graph = ["--edges", at("edges"), "--universe", at("ids")]
    main(["sweep", *graph, "--thresholds", "0,0.4", "--out", at("sweep")], spark)
    assert [r["n_edges"] for r in spark.read.parquet(at("sweep")).orderBy("threshold").collect()] == [len(want), sum(w[3] >= 0.4 for w in want)]
    main(["threshold", "--edges", at("edges"), "--threshold", "0.4", "--out", at("cut")], spark)
    main(["overlap", "--left", at("edges"), "--right", at("cut"), "--out", at("overlap")], spark)
    assert spark.read.parquet(at("overlap")).first()["n_shared"] == sum(w[3] >= 0.4 for w in want)
    main(["detect-communities", *graph, "--top-k", "3", "--out", at("communities")], spark)
    main(["rank-centrality", *graph, "--top-k", "3", "--report-top-k", "2", "--out", at("ranks")], spark)
    assert spark.read.parquet(at("communities")).count() == 6 and spark.read.parquet(at("ranks")).count() == 6
    main(["sweep-both", "--left", at("edges"), "--right", at("cut"), "--universe", at("ids"), "--thresholds", "0,0.4", "--out", at("both")], spark)
    swept = {(r["projection"], r["threshold"]): r["n_edges"] for r in spark.read.parquet(at("both")).collect()}
    assert len(swept) == 4 and swept["left", 0.4] == swept["right", 0.4] == swept["right", 0.0]
    main(["threshold-stats", "--edges", at("edges"), "--threshold", "0.4", "--out", at("cutstats")], spark)
    assert spark.read.parquet(at("cutstats")).first()["n_edges"] == swept["left", 0.4]
    for part, n in (("assignments", 6), ("sizes", spark.read.parquet(at("communities")).select("community").distinct().count())):
        main(["report-communities", "--labels", at("communities"), "--part", part, "--out", at(f"report-{part}")], spark)
        assert spark.read.parquet(at(f"report-{part}")).count() == n
    main(["compare-communities", "--left", at("communities"), "--right", at("communities"), "--out", at("agree")], spark)
    assert spark.read.parquet(at("agree")).first()["ari"] == 1.0
    main(["compare-centrality", "--left", at("edges"), "--right", at("edges"), "--universe", at("ids"), "--top-k", "3", "--report-top-k", "2", "--out", at("central")], spark)
    assert {r["metric"]: r["n_shared"] for r in spark.read.parquet(at("central")).collect()} == {"strength": 2, "pagerank": 2, "betweenness": 2}
    for name in ("profile", "weight-histogram", "weight-quantiles"):
        main([name, *(graph if name == "profile" else graph[:2]), "--out", at(name)], spark)
        assert spark.read.parquet(at(name)).count() > 0
    main(["graphml", "--pairs", pairs, "--out", at("graph")], spark)
    contracts.bipartite(files.read_graphml_edges(spark, at("graph")), "user_id", "app_id")
    with pytest.raises(contracts.ContractError):
        contracts.bipartite(files.read_graphml_edges(spark, at("graph")), "app_id", "user_id")


def test_limits_of_a_projection(spark, pairs, tmp_path):
    with pytest.raises(ValueError):
        main(["project", "--pairs", pairs, "--max-pairs", "3"], spark)
    with pytest.raises(ValueError):
        main(["project", "--pairs", pairs, "--reuse"], spark)


def test_tag_config_and_names(spark, tmp_path):
    (tmp_path / "items.jsonl").write_text("".join(json.dumps({"app_id": i, "tags": ["a", "b", "old"]}) + "\n" for i in range(4)))
    (tmp_path / "config.json").write_text(json.dumps({"min_freq": 2, "max_ratio": 1.0, "rename": {"old": "new"}, "blacklist": ["b"]}, indent=1))
    main(["clean-tags", "--items", f"{tmp_path}/items.jsonl", "--config", f"{tmp_path}/config.json", "--out", f"{tmp_path}/tags"], spark)
    assert rows(spark.read.parquet(f"{tmp_path}/tags")) == sorted((i, t) for i in range(4) for t in ("a", "new"))
    spark.createDataFrame([(0, "zero"), (1, "one"), (1, "again"), (9, "gone"), (None, "no id")], "app_id long, title string").coalesce(1).write.parquet(f"{tmp_path}/games")
    for part, n in (("edges", 8), ("items", 2), ("names", 2), ("stats", 1)):
        main(["clean-catalog", "--items", f"{tmp_path}/items.jsonl", "--games", f"{tmp_path}/games", "--config", f"{tmp_path}/config.json", "--part", part, "--out", f"{tmp_path}/cat-{part}"], spark)
        assert spark.read.parquet(f"{tmp_path}/cat-{part}").count() == n
    assert rows(spark.read.parquet(f"{tmp_path}/cat-names")) == [(0, "zero"), (1, "one")]
    names = spark.createDataFrame([(1, "x"), (1, None), (2, "y"), (2, "y")], "app_id long, name string")
    contracts.one_name(names)
    with pytest.raises(contracts.ContractError):
        contracts.one_name(names.unionAll(names.selectExpr("app_id", "'z' AS name")))
