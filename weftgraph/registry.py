"""Every query of the engine outside the corpus subpackage, with its DuckDB SQL.

Bindings: users are orders, items are parts (distinct pairs of `lineitem`); the tags of an
item are the words of its name, its brand, its type and its size.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators import bipartite, centrality, communities, compare, contracts, interactions, masks, neighbours, projection, tags
from weftgraph.operators.components import connected_components
from weftgraph.operators.ordering import numbered
from weftgraph.plans import audit, taxonomy
from weftgraph.session import materialize, shared_path, table
from weftgraph.sources import aggregates, files

CORE = (2, 30, 24)
TAGS = tags.TagConfig(min_freq=50, max_ratio=0.15, rename={"size:1": "size:small", "size:2": "size:small"}, blacklist=("size:50",), protected=("size:small",))
THRESHOLDS = [0.0, 0.018, 0.02, 0.025, 0.03, 0.035, 0.05]
CUT = 0.02
K = 10

#: What the parts of one query share; written once, and forgotten when the next query starts.
_shared: dict[str, DataFrame] = {}
_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        @functools.wraps(f)
        def run(spark: SparkSession, sf: str) -> DataFrame:
            _shared.clear()
            return f(spark, sf)

        _queries[f.__name__] = run
        if sql:
            _sql[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


# Inputs ---------------------------------------------------------------------


def raw(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").selectExpr("l_orderkey AS user_id", "l_partkey AS app_id")


def once(name: str, make: Callable[[], DataFrame]) -> DataFrame:
    if name not in _shared:
        _shared[name] = materialize(make(), sweep=True)
    return _shared[name]


def users_items(spark: SparkSession, sf: str) -> DataFrame:
    return once("users_items", lambda: interactions.user_degree_filter(interactions.dedupe(raw(spark, sf))))


def items(spark: SparkSession, sf: str) -> DataFrame:
    words = F.split("p_name", " ")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("app_id"), F.concat(words, F.array("p_brand", "p_type", F.concat(F.lit("size:"), "p_size"))).alias("tags"))


def universe(spark: SparkSession, sf: str) -> DataFrame:
    return users_items(spark, sf).select(F.col("app_id").alias("id")).distinct()


def graph(spark: SparkSession, sf: str) -> DataFrame:
    return projection.project_pairs(users_items(spark, sf))


def tag_masks(spark: SparkSession, sf: str) -> DataFrame:
    return once("tag_masks", lambda: masks.masks(tags.clean(items(spark, sf), TAGS)))


def shared_weights(spark: SparkSession, sf: str) -> DataFrame:
    """(src, dst, w_left, w_right) of the edges that both graphs have: those of the sparse one are looked up in the masks of the dense one."""
    edges = graph(spark, sf).withColumnRenamed("weight", "w_right")
    return masks.weights(edges, tag_masks(spark, sf), "w_right").select("src", "dst", F.col("weight").alias("w_left"), "w_right")


def final_graph(spark: SparkSession, sf: str) -> DataFrame:
    return once("final_graph", lambda: projection.threshold_filter(graph(spark, sf), CUT))


def names(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_partkey").alias("app_id"), F.col("p_name").alias("name"))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.both_ways(graph(spark, sf)).groupBy("id").agg(F.count("*").alias("degree"), F.max("weight").alias("top_weight"))


# SQL fragments --------------------------------------------------------------

INTER = "inter AS (SELECT DISTINCT l_orderkey AS user_id, l_partkey AS app_id FROM lineitem WHERE l_orderkey IS NOT NULL AND l_partkey IS NOT NULL)"
UF = INTER + ", uf AS (SELECT * FROM inter WHERE user_id IN (SELECT user_id FROM inter GROUP BY 1 HAVING count(*) BETWEEN 2 AND 30))"


def r(part: str, whole: str, digits: int) -> str:
    """Half-up ratio on integers."""
    return f"(((2 * CAST({part} AS HUGEINT) * {10**digits} + {whole}) // (2 * nullif({whole}, 0))) / {10**digits}.0)::DOUBLE"


def pairs_sql(source: str, hub: str, name: str) -> str:
    return (
        f"{name}_n AS (SELECT app_id, count(*) AS n FROM {source} GROUP BY 1), "
        f"{name}_s AS (SELECT a.app_id AS src, b.app_id AS dst, count(*) AS shared FROM {source} a JOIN {source} b ON a.{hub} = b.{hub} AND a.app_id < b.app_id GROUP BY 1, 2), "
        f"{name} AS (SELECT src, dst, shared, {r('shared', '(x.n + y.n - shared)', 6)} AS weight FROM {name}_s JOIN {name}_n x ON x.app_id = src JOIN {name}_n y ON y.app_id = dst)"
    )


G = UF + ", " + pairs_sql("uf", "user_id", "g")
UNI = "uni AS (SELECT DISTINCT app_id AS id FROM uf)"
TAG_RAW = """traw AS (
  SELECT p_partkey AS app_id, trim(unnest(list_concat(string_split(p_name, ' '), [p_brand, p_type, 'size:' || p_size]))) AS tag_original FROM part
), tnorm AS (
  SELECT app_id, tag_original, CASE WHEN tag_original IN ('size:1', 'size:2') THEN 'size:small' ELSE tag_original END AS tag FROM traw WHERE tag_original <> ''
), tkept AS (SELECT * FROM tnorm WHERE tag <> 'size:50'
), tfreq AS (
  SELECT tag, freq, n_items, tag = 'size:small' AS protected, tag <> 'size:small' AND freq > n_items * 0.15 AS too_frequent, tag <> 'size:small' AND freq < 50 AS rare
  FROM (SELECT tag, count(*) AS freq FROM tkept GROUP BY 1), (SELECT count(DISTINCT app_id) AS n_items FROM tkept)
), tclean AS (SELECT DISTINCT app_id, tag FROM tkept WHERE tag IN (SELECT tag FROM tfreq WHERE NOT too_frequent AND NOT rare))"""
TG = TAG_RAW + ", " + pairs_sql("tclean", "tag", "t")
WAYS = "ways AS (SELECT src AS id, dst AS other, weight FROM f UNION ALL SELECT dst, src, weight FROM f)"
FIN = G + f", f AS (SELECT * FROM g WHERE weight >= {CUT}), " + UNI + ", " + WAYS
COMPONENTS = (
    "comp(id, component) USING KEY (id) AS (SELECT id, id FROM uni UNION SELECT w.other, min(comp.component) FROM comp JOIN ways w ON w.id = comp.id "
    "JOIN recurring.comp AS known ON known.id = w.other WHERE comp.component < known.component GROUP BY 1)"
)


def core_sql(rounds: int = 8) -> str:
    low_user, high_user, low_item = CORE
    parts = [INTER, f"e0 AS MATERIALIZED (SELECT * FROM inter WHERE user_id IN (SELECT user_id FROM inter GROUP BY 1 HAVING count(*) BETWEEN {low_user} AND {high_user}))"]
    for i in range(rounds):
        parts.append(f"i{i} AS MATERIALIZED (SELECT * FROM e{i} WHERE app_id IN (SELECT app_id FROM e{i} GROUP BY 1 HAVING count(*) >= {low_item}))")
        parts.append(f"e{i + 1} AS MATERIALIZED (SELECT * FROM i{i} WHERE user_id IN (SELECT user_id FROM i{i} GROUP BY 1 HAVING count(*) >= {low_user}))")
    return ", ".join(parts)


# Interactions ---------------------------------------------------------------


@query(f"WITH {INTER} SELECT * FROM inter")
def dedupe_interactions(spark, sf):
    return interactions.dedupe(raw(spark, sf))


@query(f"WITH {UF} SELECT * FROM uf")
def user_degree_filter(spark, sf):
    return users_items(spark, sf)


@query(f"WITH {core_sql()} SELECT * FROM e8 WHERE CASE WHEN (SELECT count(*) FROM e7) = (SELECT count(*) FROM e8) THEN true ELSE error('more rounds are needed') END")
def core_prune(spark, sf):
    return interactions.core_prune(interactions.dedupe(raw(spark, sf)), *CORE)[0]


@query(
    f"WITH {core_sql()}, s AS ("
    + " UNION ALL ".join(f"SELECT {i + 1} AS round, (SELECT count(*) FROM e{i}) AS b, (SELECT count(*) FROM i{i}) AS m, (SELECT count(*) FROM e{i + 1}) AS n_edges" for i in range(8))
    + ") SELECT round, b - m AS removed_by_item, m - n_edges AS removed_by_user, n_edges FROM s WHERE round <= (SELECT min(round) FROM s WHERE b = n_edges)"
)
def core_prune_summary(spark, sf):
    rounds = interactions.core_prune(interactions.dedupe(raw(spark, sf)), *CORE)[1]
    return spark.createDataFrame([(x["round"], x["removed_by_item"], x["removed_by_user"], x["n_edges"]) for x in rounds], "round int, removed_by_item long, removed_by_user long, n_edges long")


@query(
    f"WITH {UF}, u AS (SELECT user_id, count(*) AS n FROM uf GROUP BY 1), i AS (SELECT app_id, count(*) AS n FROM uf GROUP BY 1), "
    "a AS (SELECT CAST(sum(n) AS BIGINT) AS n_edges, count(*) AS n_users, min(n) AS min_items_per_user, max(n) AS max_items_per_user, CAST(sum(n * (n - 1) // 2) AS BIGINT) AS user_induced_pairs FROM u), "
    "b AS (SELECT count(*) AS n_items, min(n) AS min_users_per_item, max(n) AS max_users_per_item FROM i) "
    f"SELECT a.*, b.*, {r('n_edges', 'n_users', 4)} AS avg_items_per_user, {r('n_edges', 'n_items', 4)} AS avg_users_per_item FROM a, b"
)
def interaction_stats(spark, sf):
    return interactions.stats(users_items(spark, sf))


@query(
    f"WITH {INTER}, d AS (SELECT user_id, count(*) AS deg FROM inter GROUP BY 1), mu AS (SELECT unnest([3, 5, 10, 30]) AS max_user), mi AS (SELECT unnest([10, 20, 24, 28]) AS min_item), "
    "e AS (SELECT user_id, app_id, max_user FROM inter JOIN d USING (user_id), mu WHERE deg BETWEEN 2 AND max_user), c AS (SELECT max_user, app_id, count(*) AS n FROM e GROUP BY ALL) "
    f"SELECT max_user, min_item, count(DISTINCT user_id) AS n_users, count(DISTINCT app_id) AS n_items, count(*) AS n_edges, {r('100 * count(*)', '(SELECT count(*) FROM inter)', 2)} AS pct_edges "
    "FROM e JOIN c USING (max_user, app_id), mi WHERE n >= min_item GROUP BY ALL"
)
def filter_sensitivity_grid(spark, sf):
    return interactions.sensitivity_grid(interactions.dedupe(raw(spark, sf)), [3, 5, 10, 30], [10, 20, 24, 28])


@query("SELECT DISTINCT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS app_id FROM events WHERE user_id IS NOT NULL AND json_extract_string(props, '$.k') IS NOT NULL")
def json_extract_interactions(spark, sf):
    return interactions.dedupe(table(spark, sf, "events").select("user_id", F.get_json_object("props", "$.k").cast("long").alias("app_id")))


# Tags -----------------------------------------------------------------------


@query(f"WITH {TAG_RAW} SELECT app_id, tag_original AS tag FROM traw WHERE tag_original <> ''")
def explode_tags(spark, sf):
    return tags.explode_tags(items(spark, sf))


@query(f"WITH {TAG_RAW} SELECT app_id, tag, tag_original FROM tnorm")
def normalize_tags(spark, sf):
    return tags.normalize(tags.explode_tags(items(spark, sf)), TAGS)


@query(f"WITH {TAG_RAW} SELECT * FROM tfreq")
def tag_frequency(spark, sf):
    return tags.verdicts(tags.normalize(tags.explode_tags(items(spark, sf)), TAGS), TAGS)


@query(f"WITH {TAG_RAW} SELECT * FROM tclean")
def clean_tags(spark, sf):
    return tags.clean(items(spark, sf), TAGS)


@query(
    f"WITH {TAG_RAW}, x AS (SELECT '1_raw' AS stage, app_id, tag_original AS tag FROM tnorm UNION ALL SELECT '2_normalized', app_id, tag FROM tnorm UNION ALL SELECT '3_blacklist', app_id, tag FROM tkept UNION ALL SELECT '4_final', app_id, tag FROM tclean) "
    "SELECT stage, count(*) AS n_pairs, count(DISTINCT app_id) AS n_items, count(DISTINCT tag) AS n_tags FROM x GROUP BY 1"
)
def tag_funnel(spark, sf):
    return tags.funnel(items(spark, sf), TAGS)


@query(f"WITH {TAG_RAW} SELECT tag_original, tag, count(*) AS freq FROM tnorm WHERE tag_original <> tag GROUP BY ALL")
def normalization_summary(spark, sf):
    return tags.renamed(tags.normalize(tags.explode_tags(items(spark, sf)), TAGS))


@query(f"WITH {TAG_RAW}, x AS (SELECT app_id, count(DISTINCT tag) AS n FROM tclean GROUP BY 1) SELECT count(*) AS n_items, min(n) AS min_tags, max(n) AS max_tags, round(avg(n), 4) AS avg_tags, quantile_cont(n, 0.5) AS median_tags FROM x")
def tags_per_item_stats(spark, sf):
    return tags.tags_per_item(tags.clean(items(spark, sf), TAGS))


@query(f"WITH {TAG_RAW} SELECT p_partkey AS app_id, p_name AS name FROM part WHERE p_partkey IN (SELECT app_id FROM tclean)")
def item_dimension(spark, sf):
    ids = tags.clean(items(spark, sf), TAGS).select("app_id").distinct()
    return table(spark, sf, "part").select(F.col("p_partkey").alias("app_id"), F.col("p_name").alias("name")).join(ids, "app_id", "left_semi")


@query(f"WITH {UF}, {TAG_RAW} SELECT DISTINCT app_id FROM uf WHERE app_id IN (SELECT app_id FROM tclean)")
def common_universe(spark, sf):
    return users_items(spark, sf).select("app_id").intersect(tags.clean(items(spark, sf), TAGS).select("app_id"))


@query(
    f"WITH {UF}, {TAG_RAW}, l AS (SELECT DISTINCT app_id FROM tclean), q AS (SELECT DISTINCT app_id FROM uf), c AS (SELECT (SELECT count(*) FROM l) AS n_left, (SELECT count(*) FROM q) AS n_right, (SELECT count(*) FROM l JOIN q USING (app_id)) AS n_common) "
    f"SELECT n_left, n_right, n_common, n_left - n_common AS n_left_only, n_right - n_common AS n_right_only, {r('100 * n_common', 'n_left', 2)} AS pct_left, {r('100 * n_common', 'n_right', 2)} AS pct_right FROM c"
)
def universe_overlap_stats(spark, sf):
    return tags.overlap_stats(tags.clean(items(spark, sf), TAGS), users_items(spark, sf))


# Bipartite graphs -----------------------------------------------------------


@query(f"WITH {UF}, c AS (SELECT count(*) AS e, count(DISTINCT user_id) AS l, count(DISTINCT app_id) AS q FROM uf) SELECT l AS n_left, q AS n_right, l + q AS n_nodes, e AS n_edges, {r('2 * e', '(l + q)', 4)} AS avg_degree FROM c")
def bipartite_stats(spark, sf):
    return bipartite.stats(users_items(spark, sf), "user_id", "app_id")


@query(
    f"WITH {UF}, d AS (SELECT 'left' AS side, count(*) AS degree FROM uf GROUP BY user_id UNION ALL SELECT 'right', count(*) FROM uf GROUP BY app_id) "
    "SELECT side, degree, count(*) AS n FROM d GROUP BY ALL UNION ALL SELECT 'all', degree, count(*) FROM d GROUP BY degree"
)
def degree_distribution(spark, sf):
    return bipartite.degree_distribution(users_items(spark, sf), "user_id", "app_id")


@query(
    f"WITH {UF}, d AS (SELECT count(*) AS degree FROM uf GROUP BY app_id), s AS (SELECT min(degree) AS lo, max(degree) AS hi FROM d) "
    "SELECT CAST(least(coalesce(floor(ln(degree / lo) * 23 / nullif(ln(hi / lo), 0)), 0), 22) AS INTEGER) AS bin, count(*) AS n FROM d, s GROUP BY 1"
)
def log_binned_degrees(spark, sf):
    return bipartite.log_binned(bipartite.degree_distribution(users_items(spark, sf), "user_id", "app_id").where("side = 'right'"))


def _component_sizes_sql(left: str, right: str, source: str, recursive: str) -> str:
    return (
        f"WITH RECURSIVE {source}, e AS (SELECT {left} * 2 AS a, {right} * 2 + 1 AS b FROM {recursive}), w AS (SELECT a AS id, b AS other FROM e UNION ALL SELECT b, a FROM e), "
        "cc(id, label) USING KEY (id) AS (SELECT DISTINCT id, id FROM w UNION SELECT w.other, min(cc.label) FROM cc JOIN w ON w.id = cc.id JOIN recurring.cc AS known ON known.id = w.other WHERE cc.label < known.label GROUP BY 1) "
        "SELECT size, count(*) AS n_components FROM (SELECT count(*) AS size FROM cc GROUP BY label) GROUP BY 1"
    )


@query(_component_sizes_sql("user_id", "app_id", UF, "uf"))
def component_size_distribution(spark, sf):
    return bipartite.component_sizes(users_items(spark, sf), "user_id", "app_id")


def _node_sql(c: str, key: str) -> str:
    return f"""SELECT DISTINCT '    <node id="{c}:' || {c} || '"><data key="d0">{c}</data><data key="{key}">' || {c} || '</data></node>' AS line FROM uf"""


@query(
    f"""WITH {UF}, x AS ({_node_sql("user_id", "d1")} UNION ALL {_node_sql("app_id", "d2")}
    UNION ALL SELECT '    <edge source="user_id:' || user_id || '" target="app_id:' || app_id || '"/>' FROM uf)
    SELECT CAST(sum(strlen(line) + 1) + {len(bipartite.head("user_id", "app_id")) + len(bipartite.TAIL) + 2} AS BIGINT) AS n_bytes FROM x"""
)
def graphml_size_estimate(spark, sf):
    return bipartite.graphml_size(users_items(spark, sf), "user_id", "app_id")


# Projections ----------------------------------------------------------------


@query(f"WITH {UF}, d AS (SELECT count(*) AS n FROM uf GROUP BY user_id) SELECT CAST(sum(n * (n - 1) // 2) AS BIGINT) AS raw_pair_incidences, count(*) AS n_hubs, max(n) AS max_degree FROM d")
def projection_estimate(spark, sf):
    return projection.estimate(users_items(spark, sf))


@query(f"WITH {G} SELECT * FROM g")
def project_user_item(spark, sf):
    return graph(spark, sf)


@query(f"WITH {UF} SELECT a.app_id AS src, b.app_id AS dst, count(*) AS shared FROM uf a JOIN uf b ON a.user_id = b.user_id AND a.app_id < b.app_id GROUP BY ALL")
def pair_counts(spark, sf):
    return projection.count_pairs(users_items(spark, sf))


@query(f"WITH {UF} SELECT app_id AS id, count(*) AS n FROM uf GROUP BY 1")
def item_counts(spark, sf):
    return projection.count_items(users_items(spark, sf))


@query(f"WITH {G} SELECT * FROM g")
def project_from_stores(spark, sf):
    """Aggregates of two halves of the users are stored, reopened and added."""
    pairs = users_items(spark, sf)
    stores = [shared_path(spark) for _ in range(2)]
    for half, path in enumerate(stores):
        aggregates.save(pairs.where(F.pmod(F.xxhash64("user_id"), F.lit(2)) == half), path)
    return aggregates.edges(spark, *stores)


@query(f"WITH {TG} SELECT * FROM t")
def project_item_tag(spark, sf):
    return masks.project(tag_masks(spark, sf))


@query(f"WITH RECURSIVE {FIN}, {COMPONENTS} SELECT id, component FROM comp")
def connected_components_final(spark, sf):
    return connected_components(universe(spark, sf), final_graph(spark, sf))


@query(
    f"WITH {G}, {UNI}, th AS (SELECT CAST(unnest({THRESHOLDS}) AS DOUBLE) AS threshold), top AS (SELECT id, max(weight) AS w FROM (SELECT src AS id, weight FROM g UNION ALL SELECT dst, weight FROM g) GROUP BY 1), "
    "a AS (SELECT threshold, (SELECT count(*) FROM g WHERE weight >= threshold) AS n_edges, (SELECT count(*) FROM uni) AS n, (SELECT count(*) FROM top WHERE w >= threshold) AS touched FROM th) "
    f"SELECT threshold, n_edges, n - touched AS n_isolated, {r('100 * n_edges', '(SELECT max(n_edges) FROM a)', 4)} AS retained_pct, {r('2 * n_edges', 'n', 4)} AS avg_degree FROM a"
)
def threshold_sweep(spark, sf):
    return projection.sweep(materialize(graph(spark, sf)), universe(spark, sf), THRESHOLDS)


@query(f"WITH {G} SELECT * FROM g WHERE weight >= {CUT}")
def threshold_filter(spark, sf):
    return projection.threshold_filter(graph(spark, sf), CUT)


@query(
    f"WITH RECURSIVE {FIN}, {COMPONENTS}, deg AS (SELECT uni.id, count(other) AS degree FROM uni LEFT JOIN ways ON ways.id = uni.id GROUP BY 1), "
    "c AS (SELECT count(*) AS n_components, max(n) AS giant FROM (SELECT count(*) AS n FROM comp GROUP BY component)), d AS (SELECT count(*) AS n_nodes, max(degree) AS max_degree, count(*) FILTER (WHERE degree = 0) AS n_isolated FROM deg), "
    "w AS (SELECT count(*) AS n_edges, min(weight) AS min_weight, max(weight) AS max_weight, round(CAST(sum(CAST(weight AS DECIMAL(18,6))) AS DOUBLE), 4) AS sum_weight FROM f) "
    f"SELECT n_nodes, n_edges, max_degree, n_isolated, n_components, {r('100 * giant', 'n_nodes', 4)} AS giant_pct, {r('2 * n_edges', 'n_nodes', 4)} AS avg_degree, {r('2 * n_edges', '(n_nodes * (n_nodes - 1))', 8)} AS density, min_weight, max_weight, sum_weight FROM c, d, w"
)
def projection_profile(spark, sf):
    return projection.profile(final_graph(spark, sf), universe(spark, sf))


@query(f"WITH {G} SELECT " + ", ".join(f"round(quantile_cont(weight, {a}), 9) AS q{n}" for a, n in ((0.25, 25), (0.5, 50), (0.75, 75), (0.9, 90), (0.99, 99))) + " FROM g")
def weight_quantiles(spark, sf):
    return compare.quantiles(graph(spark, sf), "weight")


@query(
    f"WITH {G}, o AS (SELECT weight AS value, row_number() OVER (ORDER BY src, dst) AS seen FROM g), s AS (SELECT value, seen, CASE WHEN seen <= 500 THEN seen - 1 ELSE ((seen * 1103515245 + 12345) & 2147483647) % seen END AS slot FROM o) "
    "SELECT slot, arg_max(value, seen) AS value FROM s WHERE slot < 500 GROUP BY 1"
)
def weight_reservoir(spark, sf):
    return compare.reservoir(graph(spark, sf), ["src", "dst"], "weight", 500)


@query(
    f"WITH {G}, s AS (SELECT min(weight) AS lo, max(weight) AS hi FROM g) SELECT CAST(coalesce(least(floor((weight - lo) * 50 / nullif(hi - lo, 0)), 49), 0) AS INTEGER) AS bin, count(*) AS n FROM g, s GROUP BY 1"
)
def weight_histogram(spark, sf):
    return compare.histogram(graph(spark, sf), "weight", 50)


# Comparison -----------------------------------------------------------------

BOTH = G + ", " + TG
SHARED = BOTH + ", sh AS (SELECT g.src, g.dst, t.weight AS w_left, g.weight AS w_right FROM g JOIN t ON g.src = t.src AND g.dst = t.dst)"


@query(
    f"WITH {SHARED}, c AS (SELECT (SELECT count(*) FROM t) AS n_left, (SELECT count(*) FROM g) AS n_right, (SELECT count(*) FROM sh) AS n_shared) "
    f"SELECT n_left, n_right, n_shared, n_left + n_right - n_shared AS n_union, {r('n_shared', '(n_left + n_right - n_shared)', 6)} AS edge_jaccard FROM c"
)
def edge_overlap(spark, sf):
    return masks.overlap_of_pairs(tag_masks(spark, sf), users_items(spark, sf))


@query(f"WITH {SHARED} SELECT * FROM sh")
def shared_edge_weights(spark, sf):
    return shared_weights(spark, sf)


@query(f"WITH {SHARED} SELECT count(*) AS n, CASE WHEN min(w_left) < max(w_left) AND min(w_right) < max(w_right) THEN round(corr(w_left, w_right), 6) END AS pearson FROM sh")
def pearson_shared(spark, sf):
    return compare.pearson(shared_weights(spark, sf), "w_left", "w_right")


@query(
    f"WITH {SHARED}, k AS (SELECT rank() OVER (ORDER BY w_left) + (count(*) OVER (PARTITION BY w_left) - 1) / 2.0 AS a, rank() OVER (ORDER BY w_right) + (count(*) OVER (PARTITION BY w_right) - 1) / 2.0 AS b FROM sh) "
    "SELECT count(*) AS n, CASE WHEN min(a) < max(a) AND min(b) < max(b) THEN round(corr(a, b), 6) END AS spearman FROM k"
)
def spearman_shared(spark, sf):
    return compare.spearman(materialize(shared_weights(spark, sf)), "w_left", "w_right")


# Neighbours and centrality --------------------------------------------------

KNN = FIN + f", ch AS (SELECT id, other, row_number() OVER (PARTITION BY id ORDER BY weight DESC, other DESC) AS n FROM ways), votes AS (SELECT least(id, other) AS src, greatest(id, other) AS dst, count(*) AS v FROM ch WHERE n <= {K} GROUP BY ALL)"


@query(f"WITH {KNN} SELECT src, dst FROM votes")
def knn_union(spark, sf):
    return neighbours.knn_edges(final_graph(spark, sf), K, "union")


@query(f"WITH {KNN} SELECT src, dst FROM votes WHERE v = 2")
def knn_mutual(spark, sf):
    return neighbours.knn_edges(final_graph(spark, sf), K, "mutual")


@query(f"WITH {KNN} SELECT src, dst, shared, weight, 1 / weight AS distance FROM f JOIN votes USING (src, dst)")
def knn_graph(spark, sf):
    return neighbours.knn_graph(final_graph(spark, sf), K)


STRENGTH = FIN + ", st AS (SELECT uni.id, coalesce(CAST(sum(CAST(weight AS DECIMAL(18,6))) AS DOUBLE), 0) AS score FROM uni LEFT JOIN ways ON ways.id = uni.id GROUP BY 1)"


@query(f"WITH {STRENGTH} SELECT * FROM st")
def strength(spark, sf):
    return neighbours.strength(final_graph(spark, sf), universe(spark, sf))


@query(f"WITH {STRENGTH} SELECT CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) AS rank, id, score FROM st ORDER BY score DESC, id LIMIT 25")
def centrality_topk(spark, sf):
    return neighbours.top(neighbours.strength(final_graph(spark, sf), universe(spark, sf)), 25)


@query(
    f"WITH {STRENGTH}, dg AS (SELECT uni.id, CAST(count(other) AS DOUBLE) AS score FROM uni LEFT JOIN ways ON ways.id = uni.id GROUP BY 1), a AS (SELECT id FROM st ORDER BY score DESC, id LIMIT 25), b AS (SELECT id FROM dg ORDER BY score DESC, id LIMIT 25) "
    f"SELECT count(*) AS n_shared, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids, {r('100 * count(*)', '25', 2)} AS overlap_pct FROM a JOIN b USING (id)"
)
def topk_overlap(spark, sf):
    edges, nodes = final_graph(spark, sf), universe(spark, sf)
    degree = projection.degrees(edges, nodes).select("id", F.col("degree").cast("double").alias("score"))
    return neighbours.top_overlap(neighbours.strength(edges, nodes), degree, 25)


def _pagerank_sql(rounds: int) -> str:
    parts = [FIN, "outw AS (SELECT id, sum(weight) AS total FROM ways GROUP BY 1)", "steps AS MATERIALIZED (SELECT ways.id, other, weight / total AS p FROM ways JOIN outw USING (id))", "r0 AS (SELECT id, 1.0 / (SELECT count(*) FROM uni) AS score FROM uni)"]
    for i in range(rounds):
        parts.append(
            f"r{i + 1} AS MATERIALIZED (SELECT uni.id, 0.15 / (SELECT count(*) FROM uni) + 0.85 * (coalesce(got, 0) + (SELECT coalesce(sum(score), 0) FROM r{i} WHERE id NOT IN (SELECT id FROM outw)) / (SELECT count(*) FROM uni)) AS score "
            f"FROM uni LEFT JOIN (SELECT other AS id, sum(score * p) AS got FROM r{i} JOIN steps USING (id) GROUP BY 1) x ON x.id = uni.id)"
        )
    return ", ".join(parts)


@query(f"WITH {_pagerank_sql(10)} SELECT id, round(score, 8) AS score FROM r10")
def pagerank(spark, sf):
    return centrality.pagerank(final_graph(spark, sf), universe(spark, sf), rounds=10).select("id", F.round("score", 8).alias("score"))


@query()
def betweenness(spark, sf):
    return centrality.betweenness(materialize(neighbours.knn_graph(final_graph(spark, sf), K)), universe(spark, sf)).select("id", F.round("score", 6).alias("score"))


# Communities ----------------------------------------------------------------


@query()
def leiden(spark, sf):
    return communities.detect(final_graph(spark, sf), universe(spark, sf))


LABELS = "la AS (SELECT id, id % 7 AS community FROM uni), lb AS (SELECT id, id % 5 AS community FROM uni)"


def _labels(spark, sf, n: int) -> DataFrame:
    return universe(spark, sf).select("id", (F.col("id") % n).alias("community"))


@query(
    f"WITH {FIN}, {LABELS}, m AS (SELECT sum(weight) AS m FROM f), x AS (SELECT a.community AS c, CASE WHEN a.community = b.community THEN weight ELSE 0 END AS inside, weight AS w FROM f JOIN la a ON a.id = src JOIN la b ON b.id = dst UNION ALL SELECT b.community, 0, weight FROM f JOIN la b ON b.id = dst), "
    "s AS (SELECT c, sum(inside) AS i, sum(w) AS d FROM x GROUP BY 1) SELECT count(*) AS n_communities, round(sum(i / m - (d / (2 * m)) ** 2), 6) AS modularity FROM s, m"
)
def modularity(spark, sf):
    return compare.modularity(final_graph(spark, sf), _labels(spark, sf, 7))


@query(
    f"WITH {UF}, {UNI}, {LABELS}, c AS (SELECT la.community AS a, lb.community AS b, count(*) AS n FROM la JOIN lb USING (id) GROUP BY ALL), ra AS (SELECT a, sum(n) AS n FROM c GROUP BY 1), rb AS (SELECT b, sum(n) AS n FROM c GROUP BY 1), "
    "t AS (SELECT CAST(sum(n) AS DOUBLE) AS t FROM c), s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS s, (SELECT sum(n * (n - 1) / 2) FROM ra) AS x, (SELECT sum(n * (n - 1) / 2) FROM rb) AS y, "
    "(SELECT sum(c.n / t * ln(c.n * t / (ra.n * rb.n))) FROM c JOIN ra USING (a) JOIN rb USING (b), t) AS mi, (SELECT -sum(n / t * ln(n / t)) FROM ra, t) AS ha, (SELECT -sum(n / t * ln(n / t)) FROM rb, t) AS hb, t FROM t) "
    "SELECT round((s - x * y / (t * (t - 1) / 2)) / ((x + y) / 2 - x * y / (t * (t - 1) / 2)), 6) AS ari, round(mi / ((ha + hb) / 2), 6) AS nmi FROM s"
)
def ari_nmi(spark, sf):
    return compare.partition_agreement(_labels(spark, sf, 7), _labels(spark, sf, 5))


# Audit ----------------------------------------------------------------------


NUMBER = r"[+-]?(([0-9]+(_[0-9]+)*(\.([0-9]+(_[0-9]+)*)?)?|\.[0-9]+(_[0-9]+)*)([eE][+-]?[0-9]+(_[0-9]+)*)?|(?i:inf|infinity|nan))"


def _column_sql(source: str, column: str) -> str:
    return (
        f"SELECT '{column}' AS column, count(*) AS n_rows, count(*) FILTER (WHERE k = 'null') AS n_null, count(DISTINCT v) AS n_distinct, "
        "CASE WHEN count(DISTINCT k) FILTER (WHERE k <> 'null') = 0 THEN 'null' WHEN count(DISTINCT k) FILTER (WHERE k <> 'null') = 1 THEN max(k) FILTER (WHERE k <> 'null') WHEN bool_and(k IN ('null', 'int', 'float')) THEN 'float' ELSE 'string' END AS value_type "
        "FROM (SELECT v, CASE WHEN v IS NULL OR trim(v) = '' THEN 'null' WHEN lower(trim(v)) IN ('true', 'false') THEN 'bool' WHEN regexp_full_match(trim(v), '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN 'date' "
        f"WHEN regexp_full_match(trim(v), '-?[0-9]+') THEN 'int' WHEN regexp_full_match(trim(v), '{NUMBER}') THEN 'float' ELSE 'string' END AS k FROM (SELECT CAST({column} AS VARCHAR) AS v FROM {source}))"
    )


#: Raw values of every kind, made of those of `customer`.
RAW_VALUES = {
    "c_custkey": "c_custkey",
    "c_name": "c_name",
    "c_acctbal": "c_acctbal",
    "dates": "concat('20', lpad(CAST(c_custkey % 90 + 10 AS VARCHAR), 2, '0'), '-01-02')",
    "flags": "CASE WHEN c_custkey % 2 = 0 THEN ' TRUE' ELSE 'false' END",
    "numbers": "CASE WHEN c_custkey % 3 = 0 THEN '1e5' WHEN c_custkey % 3 = 1 THEN '+5' ELSE '-12' END",
    "whole": "CASE WHEN c_custkey % 5 = 0 THEN '' WHEN c_custkey % 5 = 1 THEN CAST(NULL AS VARCHAR) ELSE concat('-', CAST(c_custkey + 1 AS VARCHAR)) END",
    "mixed": "CASE WHEN c_custkey % 2 = 0 THEN '2020-01-02' ELSE '7' END",
    "nothing": "CAST(NULL AS VARCHAR)",
}


@query("WITH raws AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in RAW_VALUES.items()) + " FROM customer) " + " UNION ALL ".join(_column_sql("raws", c) for c in RAW_VALUES))
def audit_value_types(spark, sf):
    return audit.column_profile(table(spark, sf, "customer").select(*[F.expr(e.replace("VARCHAR", "STRING")).alias(c) for c, e in RAW_VALUES.items()]))


@query(" UNION ALL ".join(_column_sql("customer", c) for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")))
def audit_columns(spark, sf):
    return audit.column_profile(table(spark, sf, "customer"))


@query(
    f"WITH {UF}, d AS (SELECT count(*) AS n FROM uf GROUP BY app_id) SELECT " + ", ".join(f"count(*) FILTER (WHERE {c}) AS {n}" for n, c in (("eq_1", "n = 1"), ("le_5", "n <= 5"), ("le_10", "n <= 10"), ("ge_100", "n >= 100"), ("ge_1k", "n >= 1000"), ("ge_10k", "n >= 10000"))) + " FROM d"
)
def audit_buckets(spark, sf):
    return audit.degree_buckets(users_items(spark, sf), "app_id")


@query(f"WITH {UF}, d AS (SELECT count(*) AS n FROM uf GROUP BY app_id) SELECT " + ", ".join(f"quantile_disc(n, {a}) AS p{round(a * 100)}" for a in (0.5, 0.9, 0.99)) + " FROM d")
def audit_nearest_rank(spark, sf):
    return audit.nearest_rank(users_items(spark, sf), "app_id")


@query(
    f"WITH {UF}, {TAG_RAW}, x AS (SELECT app_id AS id, 1 AS k FROM uf UNION ALL SELECT p_partkey, 2 FROM part UNION ALL SELECT app_id, 3 FROM tclean), "
    "m AS (SELECT id, bool_or(k = 1) AS in_interactions, bool_or(k = 2) AS in_catalogue, bool_or(k = 3) AS in_tags FROM x GROUP BY 1) SELECT in_interactions, in_catalogue, in_tags, count(*) AS n FROM m GROUP BY ALL"
)
def audit_entity_overlap(spark, sf):
    catalogue = table(spark, sf, "part").select(F.col("p_partkey").alias("app_id"))
    return audit.set_overlap({"interactions": users_items(spark, sf), "catalogue": catalogue, "tags": tags.clean(items(spark, sf), TAGS)}, "app_id")


@query(
    "WITH x AS (SELECT l_orderkey AS id, 1 AS k FROM lineitem UNION ALL SELECT o_orderkey, 2 FROM orders), m AS (SELECT id, bool_or(k = 1) AS in_interactions, bool_or(k = 2) AS in_users FROM x WHERE id IS NOT NULL GROUP BY 1) "
    "SELECT in_interactions, in_users, count(*) AS n FROM m GROUP BY ALL"
)
def audit_user_overlap(spark, sf):
    return audit.set_overlap({"interactions": raw(spark, sf), "users": table(spark, sf, "orders").select(F.col("o_orderkey").alias("user_id"))}, "user_id")


@query(
    "WITH x AS (SELECT length(string_split(p_name, ' ')) + 3 AS n FROM part WHERE p_name IS NOT NULL) SELECT "
    + ", ".join(f"count(*) FILTER (WHERE {c}) AS {n}" for n, c in (("n_0", "n = 0"), ("n_1_2", "n BETWEEN 1 AND 2"), ("n_3_5", "n BETWEEN 3 AND 5"), ("n_6_10", "n BETWEEN 6 AND 10"), ("n_gt_10", "n > 10")))
    + " FROM x"
)
def audit_tag_counts(spark, sf):
    return audit.size_buckets(items(spark, sf), "tags")


@query(f"WITH {UF}, d AS (SELECT count(*) AS n FROM uf GROUP BY user_id), i AS (SELECT count(DISTINCT app_id) AS n_items FROM uf) SELECT n_items, n_items * (n_items - 1) // 2 AS all_pairs, (SELECT CAST(sum(n * (n - 1) // 2) AS BIGINT) FROM d) AS user_induced_pairs FROM i")
def projection_bounds(spark, sf):
    return audit.bounds(users_items(spark, sf))


# Reports --------------------------------------------------------------------

CATEGORIES = {1: "name", 3: "kind", 4: "brand", 5: "size"}
OF_TAG = "CASE WHEN tag LIKE 'size:%' THEN 5 WHEN tag LIKE 'Brand%' THEN 4 WHEN substr(tag, 1, 1) BETWEEN 'A' AND 'Z' THEN 3 ELSE 1 END"
LABEL = "CASE " + " ".join(f"WHEN category_id = {k} THEN '{v}'" for k, v in CATEGORIES.items()) + " END"
TAXONOMY = TAG_RAW + f", cl0 AS (SELECT tag, count(*) AS freq, {OF_TAG} AS category_id FROM tnorm GROUP BY tag), cl AS (SELECT tag, freq, category_id, {LABEL} AS category FROM cl0)"


def _classified(spark, sf) -> DataFrame:
    freq = tags.frequencies(tags.normalize(tags.explode_tags(items(spark, sf)), TAGS))
    categories = freq.select("tag", F.expr(OF_TAG).alias("category_id")).withColumn("category", F.expr(LABEL))
    return taxonomy.classify(freq, categories)


@query(f"WITH {TAXONOMY} SELECT *, CASE WHEN category_id = 1 THEN 'keep' WHEN category_id = 3 AND tag IN ('STANDARD', 'SMALL', 'PROMO') THEN 'keep_optional' ELSE 'remove' END AS suggestion FROM cl")
def tag_taxonomy(spark, sf):
    return taxonomy.suggest(_classified(spark, sf), core=[1, 2], optional=[3], wanted=["STANDARD", "SMALL", "PROMO"])


@query(f"WITH {TAXONOMY} SELECT category_id, category, count(*) AS n_tags, CAST(sum(freq) AS BIGINT) AS freq_total FROM cl GROUP BY ALL")
def tag_category_summary(spark, sf):
    return taxonomy.category_summary(_classified(spark, sf))


@query(f"WITH {TAG_RAW} SELECT tag, freq FROM tfreq ORDER BY freq DESC, tag LIMIT 30")
def top_tags(spark, sf):
    pairs = tags.normalize(tags.explode_tags(items(spark, sf)), TAGS)
    return tags.verdicts(pairs, TAGS).select("tag", "freq").orderBy(F.desc("freq"), "tag").limit(30)


@query(f"WITH {UF} SELECT app_id, count(*) AS n_users FROM uf GROUP BY 1 ORDER BY n_users DESC, app_id LIMIT 10")
def top_items(spark, sf):
    return users_items(spark, sf).groupBy("app_id").agg(F.count("*").alias("n_users")).orderBy(F.desc("n_users"), "app_id").limit(10)


@query(
    f"WITH RECURSIVE {G}, {UNI}, th AS (SELECT CAST(unnest({THRESHOLDS}) AS DOUBLE) AS threshold), wy AS (SELECT src AS id, dst AS other, weight FROM g UNION ALL SELECT dst, src, weight FROM g), "
    "rt(threshold, id, label) USING KEY (threshold, id) AS (SELECT threshold, id, id FROM th, uni UNION SELECT rt.threshold, wy.other, min(rt.label) FROM rt JOIN wy ON wy.id = rt.id AND wy.weight >= rt.threshold "
    "JOIN recurring.rt AS known ON known.threshold = rt.threshold AND known.id = wy.other WHERE rt.label < known.label GROUP BY 1, 2), "
    "sz AS (SELECT threshold, label, count(*) AS n FROM rt GROUP BY ALL) SELECT threshold, count(*) AS n_components, max(n) AS giant, count(*) FILTER (WHERE n = 1) AS n_single FROM sz GROUP BY 1"
)
def component_sweep(spark, sf):
    return projection.component_sweep(materialize(graph(spark, sf)), universe(spark, sf), THRESHOLDS)


def _weight_stats_sql(edges: str) -> str:
    return (
        f"SELECT (SELECT count(*) FROM (SELECT src FROM {edges} UNION SELECT dst FROM {edges})) AS n_nodes, n_edges, {r('2 * n_edges', '(SELECT count(*) FROM (SELECT src FROM ' + edges + ' UNION SELECT dst FROM ' + edges + '))', 4)} AS avg_degree, min_weight, max_weight, {r('s', 'n_edges', 0)} / 1000000 AS avg_weight "
        f"FROM (SELECT count(*) AS n_edges, min(weight) AS min_weight, max(weight) AS max_weight, CAST(sum(CAST(round(weight * 1000000) AS BIGINT)) AS BIGINT) AS s FROM {edges})"
    )


@query(f"WITH {G} {_weight_stats_sql('g')}")
def projection_stats(spark, sf):
    return projection.weight_stats(graph(spark, sf))


@query(f"WITH {KNN}, kg AS (SELECT src, dst, weight FROM f JOIN votes USING (src, dst)) {_weight_stats_sql('kg')}")
def knn_graph_stats(spark, sf):
    return projection.weight_stats(neighbours.knn_graph(final_graph(spark, sf), K))


@query(
    f"WITH {G}, o AS (SELECT weight AS value, row_number() OVER (ORDER BY src, dst) AS seen FROM g), s AS (SELECT value, seen, CASE WHEN seen <= 500 THEN seen - 1 ELSE ((seen * 1103515245 + 12345) & 2147483647) % seen END AS slot FROM o), "
    "v AS (SELECT slot, arg_max(value, seen) AS value FROM s WHERE slot < 500 GROUP BY 1) SELECT " + ", ".join(f"round(quantile_cont(value, {a}), 9) AS q{n}" for a, n in ((0.25, 25), (0.5, 50), (0.75, 75), (0.9, 90), (0.99, 99))) + " FROM v"
)
def weight_quantiles_sampled(spark, sf):
    return compare.quantiles(compare.reservoir(graph(spark, sf), ["src", "dst"], "weight", 500), "value")


@query(
    f"WITH {SHARED} SELECT count(w_right) AS n, "
    + ", ".join(f"coalesce(round({e}, 6), 0.0)::DOUBLE AS {n}" for n, e in (("min", "min(w_right)"), ("max", "max(w_right)"), ("avg", "avg(w_right)"), ("q25", "quantile_cont(w_right, 0.25)"), ("median", "quantile_cont(w_right, 0.5)"), ("q75", "quantile_cont(w_right, 0.75)")))
    + " FROM sh"
)
def shared_weight_summary(spark, sf):
    return compare.summary(shared_weights(spark, sf), "w_right")


@query(
    f"WITH {STRENGTH}, dg AS (SELECT uni.id, CAST(count(other) AS DOUBLE) AS score FROM uni LEFT JOIN ways ON ways.id = uni.id GROUP BY 1), "
    "k AS (SELECT rank() OVER (ORDER BY st.score) + (count(*) OVER (PARTITION BY st.score) - 1) / 2.0 AS a, rank() OVER (ORDER BY dg.score) + (count(*) OVER (PARTITION BY dg.score) - 1) / 2.0 AS b FROM st JOIN dg USING (id)) "
    "SELECT count(*) AS n, CASE WHEN min(a) < max(a) AND min(b) < max(b) THEN round(corr(a, b), 6) END AS spearman FROM k"
)
def centrality_spearman(spark, sf):
    edges, nodes = final_graph(spark, sf), universe(spark, sf)
    degree = projection.degrees(edges, nodes).select("id", F.col("degree").cast("double").alias("other"))
    return compare.spearman(materialize(neighbours.strength(edges, nodes).join(degree, "id")), "score", "other")


@query(
    f"WITH {TAG_RAW}, a AS (SELECT tag_original AS tag, 1 AS x, 0 AS y FROM tnorm UNION ALL SELECT tag, 0, 1 FROM tnorm), b AS (SELECT tag, CAST(sum(x) AS BIGINT) AS raw_freq, CAST(sum(y) AS BIGINT) AS normalized_freq FROM a GROUP BY 1) "
    "SELECT b.tag, raw_freq, normalized_freq, CASE WHEN NOT too_frequent AND NOT rare THEN normalized_freq ELSE 0 END AS final_freq FROM b LEFT JOIN tfreq USING (tag)"
)
def tag_stage_frequencies(spark, sf):
    return tags.stage_frequencies(items(spark, sf), TAGS)


@query(f"WITH {TAG_RAW} SELECT tag, freq, {r('freq', 'n_items', 4)} AS share, CASE WHEN too_frequent THEN 'too_frequent' ELSE 'rare' END AS reason FROM tfreq WHERE too_frequent OR rare")
def tags_removed(spark, sf):
    return tags.removed(tags.normalize(tags.explode_tags(items(spark, sf)), TAGS), TAGS)


@query(f"WITH {TAG_RAW} SELECT tag, freq FROM tfreq WHERE protected AND (freq < 50 OR freq > n_items * 0.15)")
def tags_spared(spark, sf):
    return tags.spared(tags.normalize(tags.explode_tags(items(spark, sf)), TAGS), TAGS)


@query(
    f"WITH {core_sql()}, base AS (SELECT * FROM inter WHERE user_id IN (SELECT user_id FROM inter GROUP BY 1 HAVING count(*) BETWEEN 2 AND 100)), "
    "x AS (SELECT '1_distinct' AS stage, * FROM inter UNION ALL SELECT '2_base', * FROM base UNION ALL SELECT '3_core', * FROM e8), y AS (SELECT stage, count(DISTINCT user_id) AS n_users, count(DISTINCT app_id) AS n_items, count(*) AS n_edges FROM x GROUP BY 1) "
    f"SELECT *, {r('100 * n_edges', '(SELECT count(*) FROM inter)', 2)} AS pct_edges FROM y"
)
def interaction_funnel(spark, sf):
    pairs = materialize(interactions.dedupe(raw(spark, sf)))
    return interactions.funnel({"1_distinct": pairs, "2_base": interactions.user_degree_filter(pairs, 2, 100), "3_core": interactions.core_prune(pairs, *CORE)[0]})


# Results of the reports, contracts and files -----------------------------------


@query("SELECT p_partkey AS app_id, concat('part ', CAST(p_partkey AS VARCHAR)) AS description, array_to_string(list_concat(string_split(p_name, ' '), [p_brand, p_type, 'size:' || p_size]), '|') AS tags FROM part")
def metadata_round_trip(spark, sf):
    """Items are written as JSON lines and read back with defaults."""
    path = shared_path(spark)
    items(spark, sf).select("app_id", F.concat(F.lit("part "), F.col("app_id").cast("string")).alias("description"), "tags").write.json(path)
    return files.read_metadata(spark, path).select("app_id", "description", F.array_join("tags", "|").alias("tags"))


@query(f"WITH {UF} SELECT * FROM uf")
def csv_round_trip(spark, sf):
    """Edges are written as sorted CSV, checked, and read back with their exact header."""
    path = shared_path(spark)
    files.write_checked_csv(users_items(spark, sf), path, "user_id", "app_id")
    return files.read_csv(spark, path, "user_id long, app_id long", exact=True)


@query(f"WITH {UF} SELECT app_id, user_id FROM uf")
def open_csv_round_trip(spark, sf):
    """The same without a schema: types are found by reading, columns by name."""
    path = shared_path(spark)
    files.write_csv(users_items(spark, sf), path)
    return files.read_csv(spark, path).select(F.col("app_id").cast("long").alias("app_id"), F.col("user_id").cast("long").alias("user_id"))


@query(f"WITH {UF} SELECT 'edge' AS kind, 'user_id:' || user_id AS a, 'app_id:' || app_id AS b FROM uf UNION ALL SELECT DISTINCT 'user_id', 'user_id:' || user_id, CAST(user_id AS VARCHAR) FROM uf UNION ALL SELECT DISTINCT 'app_id', 'app_id:' || app_id, CAST(app_id AS VARCHAR) FROM uf")
def graphml_round_trip(spark, sf):
    """The whole bipartite graph is written as GraphML, whatever its size, and its nodes and edges read back."""
    path = shared_path(spark)
    files.write_graphml_within(users_items(spark, sf), "user_id", "app_id", path, force=True, compression="gzip")
    edges = contracts.bipartite(files.read_graphml_edges(spark, path), "user_id", "app_id")
    nodes = files.read_graphml_nodes(spark, path)
    return edges.select(F.lit("edge").alias("kind"), F.col("source").alias("a"), F.col("target").alias("b")).unionByName(nodes.select(F.col("type").alias("kind"), F.col("id").alias("a"), F.col("value").alias("b")))


@query(f"WITH {TAG_RAW}, q AS (SELECT app_id, tag || ' & \"<' || app_id % 3 || '>\"' AS tag FROM tclean) SELECT 'app_id:' || app_id AS source, 'tag:' || tag AS target FROM q")
def graphml_escaped_round_trip(spark, sf):
    """Tags with marks that XML reserves."""
    path = shared_path(spark)
    odd = F.concat("tag", F.lit(' & "<'), (F.col("app_id") % 3).cast("string"), F.lit('>"'))
    files.write_graphml(tags.clean(items(spark, sf), TAGS).select("app_id", odd.alias("tag")), "app_id", "tag", path)
    return files.read_graphml_edges(spark, path)


@query(f"WITH {UF}, c AS (SELECT count(*) AS e, count(DISTINCT user_id) AS l, count(DISTINCT app_id) AS q FROM uf) SELECT l AS n_left, q AS n_right, l + q AS n_nodes, e AS n_edges, {r('2 * e', '(l + q)', 4)} AS avg_degree FROM c")
def stats_round_trip(spark, sf):
    """Statistics are written as one JSON document and read back."""
    row = bipartite.stats(users_items(spark, sf), "user_id", "app_id")
    path, schema = shared_path(spark), row.schema
    spark.createDataFrame([(files.stats_json(row),)], "value string").coalesce(1).write.text(path)
    found = files.read_stats(spark, path)
    return found.select(*[F.col(f.name).cast(f.dataType) for f in schema])


@query("SELECT count(*) AS n_rows, count(*) FILTER (WHERE user_id IS NOT NULL AND k IS NOT NULL) AS n_with_keys, count(DISTINCT (user_id, k)) FILTER (WHERE user_id IS NOT NULL AND k IS NOT NULL) AS n_distinct FROM (SELECT user_id, CAST(nullif(json_extract_string(props, '$.k'), '3') AS BIGINT) AS k FROM events)")
def raw_counts(spark, sf):
    """Rows before and after those without a key go; one value stands for a missing key."""
    k = F.nullif(F.get_json_object("props", "$.k"), F.lit("3")).cast("long")
    return interactions.raw_counts(table(spark, sf, "events").select("user_id", k.alias("app_id")), "user_id", "app_id")


@query("SELECT l_orderkey, min(l_linenumber) AS l_linenumber, arg_min(l_partkey, l_linenumber) AS l_partkey FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY ALL) GROUP BY 1")
def keep_first(spark, sf):
    return interactions.keep_first(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), ["l_orderkey"], "l_linenumber")


@query(f"WITH {UF}, {UNI} SELECT id, row_number() OVER (ORDER BY id) - 1 AS index FROM uni")
def item_index(spark, sf):
    return numbered(universe(spark, sf), ["id"], "index").select("id", (F.col("index") - 1).alias("index"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 3")
def first_records(spark, sf):
    return audit.first_records(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), ["o_orderkey"])


@query(f"WITH {TAXONOMY} SELECT *, CAST(row_number() OVER (ORDER BY category_id, freq DESC, tag) AS INTEGER) AS place FROM cl")
def tag_category_order(spark, sf):
    return taxonomy.ordered(_classified(spark, sf))


@query(f"WITH {UF}, {TAG_RAW} SELECT * FROM uf WHERE app_id IN (SELECT app_id FROM tclean WHERE tag LIKE 'size:%')")
def edges_in_universe(spark, sf):
    inside = tags.clean(items(spark, sf), TAGS).where(F.col("tag").startswith("size:")).select("app_id").distinct()
    return users_items(spark, sf).join(inside, "app_id", "left_semi").select("user_id", "app_id")


@query(
    "WITH ed AS (SELECT l_partkey AS src, l_suppkey AS dst, l_discount * 20 AS weight FROM lineitem), un AS (SELECT s_suppkey AS id FROM supplier), b AS (SELECT *, src IN (SELECT id FROM un) AND dst IN (SELECT id FROM un) AS inside FROM ed) "
    "SELECT 'weight_range' AS contract, count(*) FILTER (WHERE weight IS NULL OR weight <= 0 OR weight > 1) AS n_bad FROM b UNION ALL SELECT 'self_loop', count(*) FILTER (WHERE src = dst) FROM b UNION ALL SELECT 'wrong_order', count(*) FILTER (WHERE src > dst) FROM b "
    "UNION ALL SELECT 'outside_universe', count(*) FILTER (WHERE NOT inside) FROM b UNION ALL SELECT 'repeated_pair', count(*) FROM (SELECT 1 FROM ed GROUP BY src, dst HAVING count(*) > 1)"
)
def contract_violations(spark, sf):
    """The contracts of a weighted graph, counted on edges that break all of them."""
    edges = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), (F.col("l_discount") * 20).alias("weight"))
    return contracts.graph_violations(edges, table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id")))


@query(f"WITH {UF} SELECT (SELECT count(*) FROM (SELECT 1 FROM uf GROUP BY user_id HAVING count(*) NOT BETWEEN 3 AND 5)) AS n_bad_users, (SELECT count(*) FROM (SELECT 1 FROM uf GROUP BY app_id HAVING count(*) < 24)) AS n_bad_items")
def degree_violations(spark, sf):
    return contracts.degree_violations(users_items(spark, sf), 3, 5, 24)


@query(f"WITH {core_sql()} SELECT * FROM e8")
def core_within_bounds(spark, sf):
    """The pruned core, after its degree bounds were checked."""
    low_user, high_user, low_item = CORE
    return contracts.final_degrees(interactions.core_prune(interactions.dedupe(raw(spark, sf)), *CORE)[0], low_user, high_user, low_item)


@query("SELECT count(*) AS n_rows, count(*) FILTER (WHERE again) AS n_repeated FROM (SELECT coalesce(lag(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_partkey) = l_partkey, false) AS again FROM lineitem)")
def repeats_of_the_row_before(spark, sf):
    return contracts.repeats_of_the_row_before(table(spark, sf, "lineitem").select("l_orderkey", "l_partkey"), "l_orderkey", "l_partkey")


@query(f"WITH {G} SELECT * FROM g")
def checked_projection(spark, sf):
    """The projection, after its contracts were checked: weights, order, repeats, ends, sets that aren't empty."""
    edges = materialize(graph(spark, sf))
    counts = projection.count_items(users_items(spark, sf))
    sizes = edges.join(counts.withColumnsRenamed({"id": "src", "n": "n_src"}), "src").join(counts.withColumnsRenamed({"id": "dst", "n": "n_dst"}), "dst")
    contracts.positive_union(sizes, "shared", "n_src", "n_dst")
    return contracts.in_order(contracts.weighted_graph(edges, universe(spark, sf)), "src", "dst")


BEFORE = tags.TagConfig(min_freq=1, max_ratio=1.0)


@query(
    f"WITH {TAG_RAW}, bf AS (SELECT DISTINCT app_id, tag_original AS tag FROM traw WHERE tag_original <> ''), "
    "m AS (SELECT 1 AS k, count(DISTINCT tag) AS t, count(DISTINCT app_id) AS i, count(*) AS p FROM bf UNION ALL SELECT 2, count(DISTINCT tag), count(DISTINCT app_id), count(*) FROM tclean), "
    f"v AS (SELECT k, unnest(['n_tags', 'avg_tags_per_item', 'n_items', 'n_pairs']) AS metric, unnest([CAST(t AS DOUBLE), {r('p', 'i', 4)}, CAST(i AS DOUBLE), CAST(p AS DOUBLE)]) AS x FROM m) "
    "SELECT a.metric, a.x AS before, b.x AS after FROM v a JOIN v b USING (metric) WHERE a.k = 1 AND b.k = 2"
)
def tag_before_after(spark, sf):
    return tags.before_after(items(spark, sf), BEFORE, TAGS)


@query(f"WITH {TAG_RAW} SELECT tag, count(*) AS freq FROM tclean WHERE tag IN ('size:small', 'size:50', 'size:7', 'blue', 'STANDARD') GROUP BY 1")
def tag_survivors(spark, sf):
    return tags.survivors(items(spark, sf), TAGS, ("size:small", "size:50", "size:7", "blue", "STANDARD"))


@query(f"WITH {TAG_RAW} SELECT * FROM tclean")
def checked_tags(spark, sf):
    """The cleaned tags, after their invariants were checked."""
    return tags.check_clean(items(spark, sf), TAGS)


@query(f"WITH {UF}, {UNI}, {LABELS} SELECT id AS app_id, coalesce(p_name, CAST(id AS VARCHAR)) AS name, community AS community_id, count(*) OVER (PARTITION BY community) AS community_size FROM la LEFT JOIN part ON p_partkey = id AND p_partkey % 4 > 0")
def community_assignments(spark, sf):
    """Items with their names, or ids where a name is missing, their community and its size."""
    return compare.assignments(_labels(spark, sf, 7), names(spark, sf).where("app_id % 4 > 0"))


@query(f"WITH {UF}, {UNI}, {LABELS}, z AS (SELECT community, count(*) AS size FROM la GROUP BY 1) SELECT CAST(row_number() OVER (ORDER BY size DESC, community) AS INTEGER) AS place, community, size, {r('100 * size', '(SELECT count(*) FROM la)', 4)} AS pct FROM z ORDER BY size DESC, community LIMIT 5")
def largest_communities(spark, sf):
    return compare.community_sizes(_labels(spark, sf, 7), 5)


CUTS = [0.0, 0.02, 0.1, 0.25, 0.5]


@query(
    f"WITH {BOTH}, th AS (SELECT CAST(unnest({CUTS}) AS DOUBLE) AS threshold), x AS (SELECT 'catalogue' AS projection, threshold, (SELECT count(*) FROM t WHERE weight >= threshold) AS n_edges FROM th UNION ALL SELECT 'community', threshold, (SELECT count(*) FROM g WHERE weight >= threshold) FROM th) "
    f"SELECT *, {r('100 * n_edges', '(max(n_edges) OVER (PARTITION BY projection))', 4)} AS retained_pct FROM x"
)
def labelled_sweep(spark, sf):
    """Both projections at several thresholds, in one table."""
    return projection.labelled_sweep({"catalogue": masks.threshold_counts(tag_masks(spark, sf), CUTS), "community": projection.threshold_counts(graph(spark, sf), CUTS)})


@query(
    f"WITH {_pagerank_sql(10)}, st AS (SELECT uni.id, coalesce(CAST(sum(CAST(weight AS DECIMAL(18,6))) AS DOUBLE), 0) AS score FROM uni LEFT JOIN ways ON ways.id = uni.id GROUP BY 1), dg AS (SELECT uni.id, CAST(count(other) AS DOUBLE) AS score FROM uni LEFT JOIN ways ON ways.id = uni.id GROUP BY 1), "
    "m AS (SELECT 'strength' AS metric, * FROM st UNION ALL SELECT 'degree', * FROM dg UNION ALL SELECT 'pagerank', id, round(score, 8) FROM r10), k AS (SELECT metric, CAST(row_number() OVER (PARTITION BY metric ORDER BY score DESC, id) AS INTEGER) AS rank, id AS app_id, score FROM m) "
    "SELECT metric, rank, app_id, coalesce(p_name, CAST(app_id AS VARCHAR)) AS name, score FROM k LEFT JOIN part ON p_partkey = app_id WHERE rank <= 25"
)
def centrality_report(spark, sf):
    """The first 25 items by strength, degree and PageRank."""
    edges, nodes = final_graph(spark, sf), universe(spark, sf)
    degree = projection.degrees(edges, nodes).select("id", F.col("degree").cast("double").alias("score"))
    rank = centrality.pagerank(edges, nodes, rounds=10).select("id", F.round("score", 8).alias("score"))
    return neighbours.stacked_top({"strength": neighbours.strength(edges, nodes), "degree": degree, "pagerank": rank}, names(spark, sf))


@query(
    _component_sizes_sql("app_id", "tag_no", TAG_RAW + ", tn AS (SELECT tag, row_number() OVER (ORDER BY tag) AS tag_no FROM (SELECT DISTINCT tag FROM tclean)), tp AS (SELECT app_id, tag_no FROM tclean JOIN tn USING (tag) WHERE tag LIKE 'size:%')", "tp")
)
def tag_component_sizes(spark, sf):
    """Components of the graph of items and their size tags."""
    pairs = tags.clean(items(spark, sf), TAGS)
    numbers = numbered(pairs.select("tag").distinct(), ["tag"], "tag_no")
    return bipartite.component_sizes(pairs.where(F.col("tag").startswith("size:")).join(numbers, "tag"), "app_id", "tag_no")
