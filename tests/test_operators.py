"""Small cases worked out by hand, and sequential models."""

import random
from xml.etree import ElementTree

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from weftgraph import session
from weftgraph.functions.expressions import average_degree, jaccard, log_edges, parse_thresholds, strip, value_type
from weftgraph.operators import bipartite, centrality, communities, compare, contracts, interactions, masks, neighbours, ordering, projection, tags
from weftgraph.operators.components import connected_components
from weftgraph.plans import audit, taxonomy
from weftgraph.sources import files
from weftgraph.streaming import ingest


def edges(spark, rows):
    return spark.createDataFrame(rows, "src long, dst long, weight double")


def ids(spark, values):
    return spark.createDataFrame([(v,) for v in values], "id long")


def test_expressions(spark):
    row = spark.range(1).select(strip(F.lit("\t a b\n")).alias("s"), jaccard(F.lit(1), F.lit(64), F.lit(65)).alias("j"), average_degree(F.lit(0), F.lit(3)).alias("d"), *[value_type(F.lit(x)).alias(f"v{i}") for i, x in enumerate(["7", "1.5", "2020-01-02", "x", "", " -7 ", "+5", "1e5", "TRUE", "nan", "1_000", "-", "1.", "2020-1-2"])]).first()
    assert row["s"] == "a b" and row["j"] == 0.007813 and row["d"] == 0.0
    assert [row[f"v{i}"] for i in range(14)] == ["int", "float", "date", "string", "null", "int", "float", "float", "bool", "float", "float", "string", "float", "string"]
    assert parse_thresholds("0.5, 0.1,0.5") == [0.1, 0.5]
    with pytest.raises(ValueError):
        parse_thresholds("1.5")
    assert len(log_edges(1, 100)) == 24 and log_edges(5, 5) == [5.0, 6.0]
    with pytest.raises(ValueError):
        log_edges(0, 3)


def test_components_against_union_find(spark):
    rng = random.Random(3)
    found = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)]
    parent = {v: v for v in [*range(300), *range(400, 461)]}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in found:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    out = connected_components(ids(spark, list(parent)), spark.createDataFrame(found, "src long, dst long"))
    assert {r["id"]: r["component"] for r in out.collect()} == {v: root(v) for v in parent}


def test_components_without_edges(spark):
    out = connected_components(ids(spark, [1, 2]), spark.createDataFrame([], "src long, dst long"))
    assert sorted(map(tuple, out.collect())) == [(1, 1), (2, 2)]


def test_core_prune_to_nothing_and_nulls(spark):
    pairs = interactions.dedupe(spark.createDataFrame([(1, 1), (1, 1), (1, 2), (2, 1), (None, 3), (3, None)], "user_id long, app_id long"))
    assert pairs.count() == 3
    left, rounds = interactions.core_prune(pairs, 2, 30, 2)
    assert left.isEmpty() and rounds[-1]["removed_by_item"] == 0
    with pytest.raises(contracts.ContractError):
        contracts.not_empty(left)


def test_tags(spark):
    items = spark.createDataFrame([(1, [" RTS ", "Strategy", ""]), (2, None), (3, []), (4, ["RTS", None, "x"])], "app_id long, tags array<string>")
    config = tags.TagConfig(min_freq=2, max_ratio=2.0, rename={"RTS": "Strategy"}, blacklist=("x",))
    assert sorted(map(tuple, tags.clean(items, config).collect())) == [(1, "Strategy"), (4, "Strategy")]


def test_projection_and_knn(spark):
    pairs = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 2), (3, 3), (3, 1)], "user_id long, app_id long")
    got = {(r["src"], r["dst"]): (r["shared"], r["weight"]) for r in projection.project_pairs(pairs).collect()}
    assert got == {(1, 2): (2, 0.666667), (1, 3): (1, 0.333333)}
    with pytest.raises(ValueError):
        projection.guard(pairs, "user_id", 2)
    star = edges(spark, [(1, 2, 0.5), (1, 3, 0.5), (1, 4, 0.5)])
    assert sorted(map(tuple, neighbours.knn_edges(star, 1, "mutual").collect())) == [(1, 4)]
    assert neighbours.knn_edges(star, 1, "union").count() == 3


def test_reservoir_against_sequential_model(spark):
    n, k = 700, 60
    rows = spark.createDataFrame([(i, float(i % 97)) for i in range(n)], "i long, w double")
    slots = {}
    for seen in range(1, n + 1):
        slot = seen - 1 if seen <= k else ((seen * 1103515245 + 12345) & 0x7FFFFFFF) % seen
        if slot < k:
            slots[slot] = float((seen - 1) % 97)
    assert {r["slot"]: r["value"] for r in compare.reservoir(rows, ["i"], "w", k).collect()} == slots


def test_correlation_edge_cases(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert compare.pearson(rows, "x", "y").first()["pearson"] is None
    assert compare.pearson(rows.limit(0), "x", "y").first()["pearson"] is None


def test_betweenness_closed_forms(spark):
    path = edges(spark, [(1, 2, 1.0), (2, 3, 1.0), (3, 4, 1.0)]).withColumn("distance", 1 / F.col("weight"))
    got = {r["id"]: r["score"] for r in centrality.betweenness(path, ids(spark, [1, 2, 3, 4, 9])).collect()}
    assert got == {1: 0.0, 2: 2.0, 3: 2.0, 4: 0.0, 9: 0.0}
    cycle = edges(spark, [(1, 2, 1.0), (2, 3, 1.0), (3, 4, 1.0), (1, 4, 1.0)]).withColumn("distance", 1 / F.col("weight"))
    assert {r["score"] for r in centrality.betweenness(cycle, ids(spark, [1, 2, 3, 4])).collect()} == {0.5}


def test_pagerank_sums_to_one(spark):
    got = centrality.pagerank(edges(spark, [(1, 2, 0.5), (2, 3, 0.2)]), ids(spark, [1, 2, 3, 4]), rounds=6)
    assert abs(got.agg(F.sum("score")).first()[0] - 1) < 1e-9


def test_communities(spark):
    two = edges(spark, [(a, b, 1.0) for g in (range(0, 5), range(10, 15)) for a in g for b in g if a < b] + [(4, 10, 0.1)])
    nodes = ids(spark, [*range(5), *range(10, 15), 99])
    got = {r["id"]: r["community"] for r in communities.detect(two, nodes).collect()}
    assert len({got[i] for i in range(5)}) == 1 and len({got[i] for i in range(10, 15)}) == 1 and got[0] != got[10] and got[99] not in (got[0], got[10])
    same = communities.detect(two, nodes)
    assert compare.partition_agreement(same, same).first()["ari"] == 1.0
    assert compare.modularity(two, same).first()["modularity"] > 0.4


def test_leiden_beats_what_it_starts_from(spark):
    """A ring of cliques with noise: modularity at least that of the cliques, every community connected, the same for one seed."""
    rng = random.Random(12)
    rows = {}
    for g in range(12):
        own = range(10 * g, 10 * g + 10)
        rows.update({(a, b): 1.0 for a in own for b in own if a < b and rng.random() < 0.8})
        rows[tuple(sorted((10 * g, (10 * g + 17) % 120)))] = 1.0
    rows.update({(a, b): 0.5 for a, b in (sorted(rng.sample(range(120), 2)) for _ in range(40))})
    graph, nodes = edges(spark, [(a, b, w) for (a, b), w in rows.items()]), ids(spark, range(120))
    found = communities.detect(graph, nodes)
    cliques = nodes.select("id", (F.col("id") / 10).cast("long").alias("community"))
    assert compare.modularity(graph, found).first()["modularity"] >= compare.modularity(graph, cliques).first()["modularity"] - 1e-9
    label = {r["id"]: r["community"] for r in found.collect()}
    inside = spark.createDataFrame([(a, b) for a, b in rows if label[a] == label[b]], "src long, dst long")
    parts = {r["id"]: r["component"] for r in connected_components(nodes, inside).collect()}
    assert len({(label[v], parts[v]) for v in label}) == len(set(label.values()))
    assert label == {r["id"]: r["community"] for r in communities.detect(graph, nodes).collect()}
    sizes = [r["size"] for r in compare.community_sizes(found, 3).orderBy("place").collect()]
    assert sizes == sorted(sizes, reverse=True) and len(sizes) == 3


def test_leiden_by_components(spark, monkeypatch):
    """The size limit is one of a component: graphs of many go through whole, resolved by the weight of all of them."""
    monkeypatch.setattr(communities, "MOST_EDGES", 12)
    graph = edges(spark, [(10 * g + a, 10 * g + b, 0.1 + g / 10) for g in range(6) for a in range(5) for b in range(a)])
    got = {r["id"]: r["community"] for r in communities.detect(graph, ids(spark, [*(10 * g + a for g in range(6) for a in range(5)), 7])).collect()}
    assert got == {10 * g + a: g for g in range(6) for a in range(5)} | {7: 6}
    bridged = graph.unionAll(edges(spark, [(0, 10, 0.1)]))
    with pytest.raises(ValueError):
        communities.detect(bridged, ids(spark, range(60)))
    # At a resolution by its own weight alone the light clique would fall apart.
    monkeypatch.setattr(communities, "MOST_EDGES", 100)
    light = edges(spark, [(1, 2, 0.01), (2, 3, 0.01), (1, 3, 0.01), (11, 12, 1.0), (12, 13, 1.0), (11, 13, 1.0)])
    assert compare.community_sizes(communities.detect(light, ids(spark, [1, 2, 3, 11, 12, 13]), gamma=2.5), 9).count() == 4


def test_masks_against_the_pair_join(spark, monkeypatch):
    monkeypatch.setattr(masks, "BLOCK", 17)
    rng = random.Random(6)
    pairs = spark.createDataFrame(list({(f"t{rng.randrange(90)}", rng.randrange(80)) for _ in range(700)}), "tag string, app_id long")
    rows = masks.masks(pairs)
    want = {tuple(r) for r in projection.project_pairs(pairs, "tag", "app_id").select("src", "dst", "shared", "weight").collect()}
    assert {tuple(r) for r in masks.project(rows).collect()} == want
    some = spark.createDataFrame([(a, b) for a in range(80) for b in range(a + 1, 80, 3)], "src long, dst long")
    assert {tuple(r) for r in masks.weights(some, rows).collect()} == {w for w in want if (w[1] - w[0]) % 3 == 1}
    got = {r["threshold"]: r["n_edges"] for r in masks.threshold_counts(rows, [0.0, 0.1, 0.2]).collect()}
    assert got == {t: sum(w[3] >= t for w in want) for t in (0.0, 0.1, 0.2)}
    right = some.withColumn("weight", F.lit(1.0))
    left = spark.createDataFrame([w[:2] for w in want], "src long, dst long").withColumn("weight", F.lit(1.0))
    assert masks.overlap(rows, right).first() == compare.edge_overlap(left, right).first()
    with pytest.raises(ValueError):
        monkeypatch.setattr(masks, "MOST_HUBS", 5)
        masks.masks(pairs)


def test_masks_of_many_alike_items(spark, monkeypatch):
    """Items with the same hubs are compared once; the number of blocks, and so what is sent, stays bounded; pairs carry masks to an overlap."""
    rng = random.Random(8)
    kinds = [rng.sample(range(70), 3) for _ in range(12)]
    pairs = spark.createDataFrame([(f"t{t}", i) for i in range(400) for t in kinds[i % 12]], "tag string, app_id long")
    rows = masks.masks(pairs)
    assert masks.alike(rows).agg(F.count("*"), F.sum("m")).first()[:] == (len({tuple(sorted(k)) for k in kinds}), 400)
    left = projection.project_pairs(pairs, "tag", "app_id").cache()
    got = {r["threshold"]: r["n_edges"] for r in masks.threshold_counts(rows, [0.0, 0.3, 1.0, 1.1]).collect()}
    assert got == {t: left.where(F.col("weight") >= t).count() for t in (0.0, 0.3, 1.0, 1.1)}
    users = spark.createDataFrame(list({(rng.randrange(200), rng.randrange(420)) for _ in range(900)}), "user_id long, app_id long")
    assert masks.overlap_of_pairs(rows, users).first() == compare.edge_overlap(left, projection.project_pairs(users)).first()
    sent = []
    monkeypatch.setattr(masks, "BLOCK", 1)
    monkeypatch.setattr(masks, "MOST_BLOCKS", 5)
    repartition = type(rows).repartition
    monkeypatch.setattr(type(rows), "repartition", lambda self, *a: sent.append(self.count()) or repartition(self, *a))
    assert masks.project(rows).count() == left.count() and sent == [25]


def test_projection_sends_a_mask_once_for_alike_items(spark, monkeypatch):
    """Blocks are ids and one mask for each kind of item in them; items without an id make no pair; more ranges than were asked for do no harm."""
    rng = random.Random(8)
    kinds = [rng.sample(range(70), 3) for _ in range(12)]
    pairs = spark.createDataFrame([(f"t{t}", i) for i in range(400) for t in kinds[i % 12]] + [(f"t{t}", None) for t in kinds[0]], "tag string, app_id long")
    want = {tuple(r) for r in projection.project_pairs(pairs, "tag", "app_id").collect()}
    monkeypatch.setattr(masks, "BLOCK", 1)
    monkeypatch.setattr(masks, "MOST_BLOCKS", 5)
    repartition, by_range, sent = type(pairs).repartition, type(pairs).repartitionByRange, []
    monkeypatch.setattr(type(pairs), "repartition", lambda self, *a: sent.append(sum(len(x) for r in self.collect() for x in r if isinstance(x, (bytes, bytearray)))) or repartition(self, *a))
    got = masks.project(masks.masks(pairs)).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) and sent[0] <= 5 * 8 * (400 + 4 * 16)
    monkeypatch.setattr(type(pairs), "repartitionByRange", lambda self, n, *a: by_range(self, n + 4, *a))
    got = masks.project(masks.masks(pairs)).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_lists_of_pairs_are_bounded(monkeypatch):
    """However many items are alike, a row of lists stands for a bounded number of pairs; each pair of two blocks comes once each way at most."""
    monkeypatch.setattr(masks, "ALIKE", 3)
    monkeypatch.setattr(masks, "ROWS", 10)
    rng = np.random.default_rng(3)
    blocks, tags_of = [], {}
    for at in (0, 1):
        ids = rng.permutation(np.arange(at, 60, 2))
        words = np.array([1, 3, 6, 8])
        for i, w in zip(ids, np.repeat(words, [20, 5, 4, 1]), strict=True):
            tags_of[int(i)] = int(w)
        ids = np.concatenate([np.sort(x) for x in np.split(ids, [20, 25, 29])])
        blocks.append((ids, np.stack([[20, 5, 4, 1], np.bitwise_count(words).astype(np.int64), words])))
    for way in ([blocks[0], blocks[1]], [blocks[1], blocks[0]], [blocks[0], blocks[0]]):
        got = []
        for srcs, dsts, cuts, shared, union in masks._lists(*way):
            ends = np.append(cuts, len(dsts))
            assert len(srcs) <= 3 and (np.diff(ends) * len(srcs)).max() <= 10
            for k, (start, end) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                got += [(int(a), int(b), int(shared[k]), int(union[k])) for a in srcs for b in dsts[start:end] if a < b]
        both = [(int(a), int(b), tags_of[int(a)], tags_of[int(b)]) for a in way[0][0] for b in way[1][0]]
        assert sorted(got) == sorted((a, b, (x & y).bit_count(), (x | y).bit_count()) for a, b, x, y in both if a < b and x & y)


def test_numbers_and_ranks_over_ranges(spark):
    rng = random.Random(2)
    values = [rng.randrange(40) for _ in range(500)]
    rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i long, x double").repartition(6)
    assert {r["i"]: r["no"] for r in ordering.numbered(rows, ["x", "i"], "no").collect()} == {i: n for n, (_, i) in enumerate(sorted((v, i) for i, v in enumerate(values)), 1)}
    got = {r["i"]: r["rank"] for r in compare.average_ranks(rows, "x", "rank").collect()}
    assert got == {i: sum(w < v for w in values) + (values.count(v) + 1) / 2 for i, v in enumerate(values)}


def test_more_contracts(spark):
    pairs = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "user_id long, app_id long")
    contracts.final_degrees(pairs, 1, 2, 1)
    with pytest.raises(contracts.ContractError):
        contracts.final_degrees(pairs, 2, 2, 1)
    with pytest.raises(contracts.ContractError):
        contracts.final_degrees(pairs, 1, 2, 2)
    contracts.in_order(pairs, "user_id", "app_id")
    with pytest.raises(contracts.ContractError):
        contracts.in_order(pairs.unionAll(pairs.limit(1)), "user_id", "app_id")
    sizes = spark.createDataFrame([(1, 2, 1), (0, 0, 0)], "shared long, a long, b long")
    contracts.positive_union(sizes.where("a > 0"), "shared", "a", "b")
    with pytest.raises(contracts.ContractError):
        contracts.positive_union(sizes, "shared", "a", "b")


def test_graphml_of_other_writers(spark, tmp_path):
    """Nodes and edges of indented files, several to a line, with marks that XML reserves."""
    (tmp_path / "g.graphml").write_text('<graphml>\n  <graph edgedefault="undirected">\n    <node id="game:1"><data key="d0">game</data><data key="d2">1</data></node><node id="tag:R&amp;D &quot;x&quot;"><data key="d0">tag</data><data key="d1">R&amp;D &quot;x&quot;</data></node>\n    <edge source="game:1" target="tag:R&amp;D &quot;x&quot;"/><edge target="game:2" source="tag:a"></edge>\n  </graph>\n</graphml>\n')
    assert sorted(map(tuple, files.read_graphml_edges(spark, str(tmp_path)).collect())) == [("game:1", 'tag:R&D "x"'), ("tag:a", "game:2")]
    assert sorted(map(tuple, files.read_graphml_nodes(spark, str(tmp_path)).collect())) == [("game:1", "game", "1"), ('tag:R&D "x"', "tag", 'R&D "x"')]
    odd = spark.createDataFrame([(1, 'R&D "x" <y>'), (2, "a\tb\nc")], "app_id long, tag string")
    files.write_graphml(odd, "app_id", "tag", str(tmp_path / "o"))
    whole = "".join(p.read_text() for p in sorted((tmp_path / "o").glob("part-*")))
    assert {n.get("id") for n in ElementTree.fromstring(whole.encode()).iter("{http://graphml.graphdrawing.org/xmlns}node")} == {"app_id:1", "app_id:2", 'tag:R&D "x" <y>', "tag:a\tb\nc"}
    assert len(whole.encode()) == bipartite.graphml_size(odd, "app_id", "tag").first()[0]
    assert {r["target"] for r in files.read_graphml_edges(spark, str(tmp_path / "o")).collect()} == {'tag:R&D "x" <y>', "tag:a\tb\nc"}
    with pytest.raises(contracts.ContractError):
        files.write_graphml(odd.unionAll(odd), "app_id", "tag", str(tmp_path / "p"))
    (tmp_path / "n.graphml").write_text("<graphml></graphml>")
    with pytest.raises(contracts.ContractError):
        files.read_graphml_edges(spark, str(tmp_path / "n.graphml"))


def test_metadata_without_rows_or_ids(spark, tmp_path):
    for name, text in (("empty", ""), ("null", '{"app_id": null, "tags": []}\n')):
        (tmp_path / name).write_text(text)
        with pytest.raises(contracts.ContractError):
            files.read_metadata(spark, str(tmp_path / name))


def test_release_removes_the_tables(spark):
    df = session.materialize(spark.range(3))
    path = df.inputFiles()[0].rsplit("/", 1)[0]
    assert session.release(spark) >= 1
    with pytest.raises(AnalysisException):
        spark.read.parquet(path)


def test_contracts(spark):
    good = edges(spark, [(1, 2, 0.5)])
    contracts.weighted_graph(good, ids(spark, [1, 2]))
    for bad in ([(2, 1, 0.5)], [(1, 2, 1.5)], [(1, 2, 0.5), (1, 2, 0.5)], [(1, 3, 0.5)], [(1, 1, 0.5)]):
        with pytest.raises(contracts.ContractError):
            contracts.weighted_graph(edges(spark, bad), ids(spark, [1, 2]))
    with pytest.raises(contracts.ContractError):
        contracts.required_columns(good, "x")


def test_files(spark, tmp_path):
    pairs = spark.createDataFrame([(1, 7), (2, 7)], "user_id long, app_id long")
    files.write_graphml(pairs, "user_id", "app_id", f"{tmp_path}/g")
    text = "".join(p.read_text() for p in sorted((tmp_path / "g").glob("part-*")))
    assert len(text.encode()) == bipartite.graphml_size(pairs, "user_id", "app_id").first()[0]
    assert files.read_graphml_edges(spark, f"{tmp_path}/g").count() == 2
    files.write_csv(pairs, f"{tmp_path}/c", "user_id")
    assert files.read_csv(spark, f"{tmp_path}/c", "user_id long, app_id long", exact=True).count() == 2
    (tmp_path / "m.json").write_text('{"app_id": 1, "tags": null}\n{"app_id": 2, "description": "d", "tags": ["a"]}\n')
    assert [r["tags"] for r in files.read_metadata(spark, f"{tmp_path}/m.json").orderBy("app_id").collect()] == [[], ["a"]]


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, 1, "2020-01-01"), (1, 1, "2020-01-01"), (2, None, "2020-01-01")], "user_id long, app_id long, d string").selectExpr("user_id", "app_id", "timestamp(d) AS ts").write.parquet(f"{tmp_path}/in")
    rows = ingest.interactions_stream(spark, f"{tmp_path}/in", "user_id long, app_id long, ts timestamp")
    ingest.start(rows, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 1


def test_component_sweep_without_edges_and_with_ties(spark):
    nodes = spark.range(4)
    edges = spark.createDataFrame([(0, 1, 0.5), (1, 2, 0.25), (0, 2, 0.25)], "src long, dst long, weight double")
    got = {r["threshold"]: (r["n_components"], r["giant"], r["n_single"]) for r in projection.component_sweep(edges, nodes, [0.0, 0.25, 0.5, 0.75]).collect()}
    assert got == {0.0: (2, 3, 1), 0.25: (2, 3, 1), 0.5: (3, 2, 2), 0.75: (4, 1, 4)}
    assert projection.component_sweep(edges.limit(0), nodes, [0.5]).first()["n_components"] == 4


def test_summary_of_nothing_is_zero(spark):
    row = compare.summary(spark.createDataFrame([], "x double"), "x").first()
    assert row.asDict() == {"n": 0, "min": 0.0, "max": 0.0, "avg": 0.0, "q25": 0.0, "median": 0.0, "q75": 0.0}


def test_taxonomy_has_to_cover_the_tags(spark):
    freq = spark.createDataFrame([("a", 3), ("b", 1), ("c", 2)], "tag string, freq long")
    known = spark.createDataFrame([("a", 1, "x"), ("b", 3, "y"), ("c", 4, "z")], "tag string, category_id int, category string")
    got = {r["tag"]: r["suggestion"] for r in taxonomy.suggest(taxonomy.classify(freq, known), [1, 2], [3], ["b", "c"]).collect()}
    assert got == {"a": "keep", "b": "keep_optional", "c": "remove"}
    with pytest.raises(contracts.ContractError):
        taxonomy.classify(freq, known.where("tag <> 'c'"))


def test_set_overlap_counts_ids_once(spark):
    one = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k long")
    two = spark.createDataFrame([(2,), (3,)], "k long")
    got = {(r["in_a"], r["in_b"]): r["n"] for r in audit.set_overlap({"a": one, "b": two}, "k").collect()}
    assert got == {(True, False): 1, (True, True): 1, (False, True): 1}


def test_checked_csv_and_guarded_graphml(spark, tmp_path):
    pairs = spark.createDataFrame([(2, 10), (1, 10), (1, 11)], "user_id long, app_id long")
    assert files.write_checked_csv(pairs, str(tmp_path / "c"), "user_id", "app_id") == 3
    with pytest.raises(contracts.ContractError):
        files.write_graphml_within(pairs, "user_id", "app_id", str(tmp_path / "g"), most_bytes=10)
    assert files.write_graphml_within(pairs, "user_id", "app_id", str(tmp_path / "g"), most_bytes=10, force=True) > 10
    assert files.read_graphml_edges(spark, str(tmp_path / "g")).count() == 3
    (tmp_path / "s.json").write_text(files.stats_json(spark.sql("SELECT 1 AS n, 'é' AS t")))
    assert files.read_stats(spark, str(tmp_path / "s.json")).first().asDict() == {"n": 1, "t": "é"}


def test_tag_invariants(spark):
    rows = [(i, ["a", "b" if i < 5 else "bb", "x"]) for i in range(10)] + [(99, None)]
    config = tags.TagConfig(min_freq=2, max_ratio=0.6, rename={"bb": "b"}, blacklist=("x",), protected=("b",))
    frame = spark.createDataFrame(rows, "app_id long, tags array<string>")
    assert {r["tag"] for r in tags.check_clean(frame, config).collect()} == {"b"}
    got = {r["tag"]: (r["raw_freq"], r["normalized_freq"], r["final_freq"]) for r in tags.stage_frequencies(frame, config).collect()}
    assert got == {"a": (10, 10, 0), "b": (5, 10, 10), "bb": (5, 0, 0), "x": (10, 10, 0)}
    pairs = tags.normalize(tags.explode_tags(frame), config)
    assert [(r["tag"], r["share"], r["reason"]) for r in tags.removed(pairs, config).collect()] == [("a", 1.0, "too_frequent")]
    assert [r["tag"] for r in tags.spared(pairs, config).collect()] == ["b"]


def test_a_swept_table_leaves_no_shuffle(spark):
    from weftgraph.session import SWEEP, materialize

    settings = spark.conf.get(SWEEP, None)
    status = spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    shuffles = lambda: status.shuffleStatuses().size()
    before = shuffles()
    rows = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    assert materialize(rows, sweep=True).count() == 7 and spark.conf.get(SWEEP, None) == settings
    assert shuffles() <= before + 1


def test_core_prune_of_a_long_chain(spark):
    """Twelve users between every two of 21 items: each round takes the two ends, until nothing is left; more rounds than the SQL unrolls."""
    rows = [(12 * i + u, i + side) for i in range(20) for u in range(12) for side in (0, 1)]
    left, rounds = interactions.core_prune(spark.createDataFrame(rows, "user_id long, app_id long"), 2, 30, 24)
    assert left.count() == 0 and [x["n_edges"] for x in rounds] == [24 * n for n in range(18, -1, -2)] + [0]
    assert all(x["removed_by_item"] == x["removed_by_user"] == 24 for x in rounds[:-1])
