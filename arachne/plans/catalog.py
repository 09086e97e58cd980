"""Registered queries over the driver's tables, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arachne.functions import vectors as V
from arachne.operators import centrality, components, embed, flow, gnn, kg, metrics, paths, pgm, retrieval, spectral
from arachne.operators.graph import PropertyGraph
from arachne.plans.iterate import checkpoint
from arachne.sources import graphs as G
from arachne.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

START, GOAL = "NATION_3", "NATION_7"

_TRADE = """trade AS (
  SELECT cn.n_name AS src, sn.n_name AS dst, cn.n_nationkey AS sk, sn.n_nationkey AS dk, CAST(sum(l_quantity) AS DOUBLE) AS weight
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation cn ON c_nationkey = cn.n_nationkey
  JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey GROUP BY ALL),
t5 AS (SELECT src, dst, sk, dk, weight FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS r FROM trade WHERE src <> dst) WHERE r <= 5),
tb AS (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, sum(weight) AS weight FROM trade WHERE src <> dst GROUP BY ALL),
tba AS (SELECT src, dst, weight FROM tb UNION ALL SELECT dst, src, weight FROM tb)"""
_HOPS = """hop AS (
  SELECT n_name AS source, n_name AS id, 0 AS hops FROM nation
  UNION SELECT source, dst, hops + 1 FROM hop JOIN t5 ON id = src WHERE hops < 24),
d AS (SELECT source, id, CAST(min(hops) AS BIGINT) AS hops FROM hop GROUP BY ALL)"""
_DIST = """walk AS (
  SELECT n_name AS src, n_name AS dst, 0::DOUBLE AS dist, 0 AS k FROM nation
  UNION ALL SELECT w.src, e.dst, min(w.dist + e.weight), w.k + 1 FROM walk w JOIN t5 e ON w.dst = e.src WHERE w.k < 24 GROUP BY w.src, e.dst, w.k),
dist AS (SELECT src, dst, min(dist) AS dist FROM walk GROUP BY ALL)"""
_KG = """kg AS (
  SELECT 'customer:' || c_custkey AS s, 'in_nation' AS p, 'nation:' || c_nationkey AS o FROM customer UNION SELECT 'supplier:' || s_suppkey, 'in_nation', 'nation:' || s_nationkey FROM supplier
  UNION SELECT 'nation:' || n_nationkey, 'in_region', 'region:' || n_regionkey FROM nation UNION SELECT 'order:' || o_orderkey, 'placed_by', 'customer:' || o_custkey FROM orders
  UNION SELECT 'part:' || p_partkey, 'has_brand', p_brand FROM part)"""
_RING = """rg AS (
  SELECT CAST(vec_id AS VARCHAR) AS src, CAST(lead(vec_id, 1) OVER w AS VARCHAR) AS dst, 'next' AS type FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id)
  UNION ALL SELECT CAST(vec_id AS VARCHAR), CAST(lead(vec_id, 3) OVER w AS VARCHAR), 'skip' FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id)),
ring AS (SELECT * FROM rg WHERE dst IS NOT NULL),
f AS (SELECT CAST(vec_id AS VARCHAR) AS id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c, embedding[4]::DOUBLE AS e FROM embeddings)"""
_WORDS = "words AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w FROM documents), tok AS (SELECT doc_id, len(w) AS size, unnest(w) AS term FROM words)"
_STEPS = "steps AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step, event_type, ts, event_id FROM events)"


def query(sql: str | None = None, *, using: tuple[str, ...] = ()):
    """Registers a query under its name; using: common table expressions that stand before sql."""
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = (f"WITH RECURSIVE {', '.join(using)} " if using else "") + sql
        return f

    return add


def r6(c, name: str):
    return (F.round(c, 6) + F.lit(0.0)).alias(name)


# Graphs


@query("SELECT coalesce(n.src, t5.src) AS src, coalesce(n.dst, t5.dst) AS dst, coalesce(n.weight * 2, t5.weight) AS weight FROM t5 FULL JOIN (SELECT * FROM trade WHERE sk <= dk) n ON t5.src = n.src AND t5.dst = n.dst", using=(_TRADE,))
def graph_edge_upsert(spark, sf):
    more = G.trade_edges(spark, sf).where("cast(ord / 100000 as int) <= ord % 100000").withColumn("weight", F.col("weight") * 2)
    return G.trade5(spark, sf).add_edges(more).edge_list()


@query("SELECT src, dst, weight FROM t5", using=(_TRADE,))
def graph_edge_list(spark, sf):
    return G.trade5(spark, sf).edge_list()


@query("SELECT n_name AS id, coalesce((SELECT string_agg(dst || ':' || CAST(weight AS BIGINT), ',' ORDER BY dk) FROM t5 WHERE src = n_name), '') AS neighbours FROM nation", using=(_TRADE,))
def graph_adjacency_list(spark, sf):
    return G.trade5(spark, sf).adjacency_lists().select("id", F.expr("array_join(transform(neighbours, x -> concat(x.dst, ':', cast(cast(x.weight as long) as string))), ',')").alias("neighbours"))


@query("SELECT a.n_nationkey::BIGINT AS i, b.n_nationkey::BIGINT AS j, coalesce(weight, 0::DOUBLE) AS v FROM nation a CROSS JOIN nation b LEFT JOIN t5 ON sk = a.n_nationkey AND dk = b.n_nationkey", using=(_TRADE,))
def graph_adjacency_matrix(spark, sf):
    return G.trade5(spark, sf).adjacency_matrix().select(F.col("i").cast("long"), F.col("j").cast("long"), "v")


@query("SELECT sk::BIGINT AS i, dk::BIGINT AS j, weight AS v FROM t5", using=(_TRADE,))
def graph_sparse_matrix(spark, sf):
    return G.trade5(spark, sf).sparse_matrix().select(F.col("i").cast("long"), F.col("j").cast("long"), "v")


@query("SELECT src AS id, src, dst, (-1)::BIGINT AS v FROM t5 UNION ALL SELECT dst, src, dst, 1 FROM t5", using=(_TRADE,))
def graph_incidence_matrix(spark, sf):
    return G.trade5(spark, sf).incidence_matrix().withColumn("v", F.col("v").cast("long"))


@query("SELECT least(sk, dk)::VARCHAR AS a, greatest(sk, dk)::VARCHAR AS b, arg_max(weight, sk * 100 + dk) AS weight FROM trade GROUP BY least(sk, dk), greatest(sk, dk)", using=(_TRADE,))
def graph_from_matrix(spark, sf):
    cells = G.trade_edges(spark, sf).selectExpr("cast(ord / 100000 as int) as i", "cast(ord % 100000 as int) as j", "weight as v")
    e = PropertyGraph.from_matrix(cells, False).edge_list()
    first = F.col("src").cast("int") <= F.col("dst").cast("int")
    return e.select(F.when(first, F.col("src")).otherwise(F.col("dst")).alias("a"), F.when(first, F.col("dst")).otherwise(F.col("src")).alias("b"), "weight")


@query("SELECT src, dst, weight FROM t5 WHERE sk NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 0) AND dk NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 0)", using=(_TRADE,))
def graph_remove_node(spark, sf):
    gone = G.table(spark, sf, "nation").where("n_regionkey = 0").select(F.col("n_name").alias("id"))
    return G.trade5(spark, sf).remove_nodes(gone).edge_list()


@query("SELECT src, dst, weight FROM t5 WHERE (sk + dk) % 2 = 1", using=(_TRADE,))
def graph_remove_edges(spark, sf):
    g = G.trade5(spark, sf)
    return g.remove_edges(g.edges.where("(cast(ord / 100000 as int) + ord % 100000) % 2 = 0")).edge_list()


@query("SELECT n_name AS id, 'nation' AS type, CASE n_regionkey WHEN 1 THEN 'one' END AS note FROM nation UNION ALL SELECT r_name, 'region', 'new' FROM region")
def graph_add_nodes(spark, sf):
    """Known nodes keep their type and gain properties, new ones come with theirs."""
    more = G.table(spark, sf, "nation").where("n_regionkey = 1").select(F.col("n_name").alias("id"), F.lit("other").alias("type"), F.lit("one").alias("note"))
    more = more.union(G.table(spark, sf, "region").select("r_name", F.lit("region"), F.lit("new")))
    g = G.trade5(spark, sf).add_nodes(more.select("id", "type", F.create_map(F.lit("note"), F.col("note")).alias("props")))
    return g.nodes.select("id", "type", F.col("props")["note"].alias("note"))


# Metrics


@query("SELECT 's' || l_suppkey AS id, count(DISTINCT l_partkey) AS in_degree, count(DISTINCT l_partkey) AS out_degree FROM lineitem GROUP BY l_suppkey UNION ALL SELECT 'p' || l_partkey, count(DISTINCT l_suppkey), count(DISTINCT l_suppkey) FROM lineitem GROUP BY l_partkey")
def degree(spark, sf):
    return metrics.degree(G.supplier_part(spark, sf))


@query("SELECT n_nodes, n_edges, round(2 * n_edges / (n_nodes * (n_nodes - 1)::DOUBLE), 9) AS density FROM (SELECT count(DISTINCT l_suppkey) + count(DISTINCT l_partkey) AS n_nodes, (SELECT count(*) FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)) AS n_edges FROM lineitem)")
def density(spark, sf):
    return metrics.density(G.supplier_part(spark, sf)).withColumn("density", F.round("density", 9))


@query("SELECT n_name AS id, round(((SELECT count(*) FROM t5 WHERE src = n_name) + (SELECT count(*) FROM t5 WHERE dst = n_name)) / 24::DOUBLE, 6) AS centrality FROM nation", using=(_TRADE,))
def degree_centrality(spark, sf):
    return metrics.degree_centrality(G.trade5(spark, sf)).select("id", r6(F.col("centrality"), "centrality"))


_CLUSTER = """nb AS (SELECT src AS id, dst AS u FROM t5 UNION SELECT dst, src FROM t5),
k AS (SELECT id, count(*) AS k FROM nb GROUP BY 1),
l AS (SELECT x.id, count(*) AS l FROM nb x JOIN nb y ON x.id = y.id JOIN t5 ON t5.src = x.u AND t5.dst = y.u GROUP BY 1),
cc AS (SELECT n_name AS id, coalesce(CASE WHEN k > 1 THEN coalesce(l, 0) / (k * (k - 1))::DOUBLE END, 0) AS c FROM nation LEFT JOIN k ON k.id = n_name LEFT JOIN l ON l.id = n_name)"""


@query("SELECT id, round(c, 6) AS clustering FROM cc", using=(_TRADE, _CLUSTER))
def local_clustering(spark, sf):
    return metrics.local_clustering(G.trade5(spark, sf)).select("id", r6(F.col("clustering"), "clustering"))


@query("SELECT round(avg(c), 6) AS clustering FROM cc", using=(_TRADE, _CLUSTER))
def global_clustering(spark, sf):
    return metrics.global_clustering(G.trade5(spark, sf)).select(r6(F.col("clustering"), "clustering"))


@query("SELECT source, id, hops FROM d", using=(_TRADE, _HOPS))
def all_pairs_hops(spark, sf):
    return metrics.hops(G.trade5(spark, sf))


@query(f"SELECT n_name AS id, coalesce(hops::DOUBLE, 'inf'::DOUBLE) AS hops FROM nation LEFT JOIN d ON id = n_name AND source = '{START}'", using=(_TRADE, _HOPS))
def bfs_levels(spark, sf):
    return metrics.bfs_distances(G.trade5(spark, sf), START)


@query("SELECT n_name AS id, coalesce(max(hops) FILTER (source <> d.id), 0)::DOUBLE AS eccentricity FROM nation LEFT JOIN d ON source = n_name GROUP BY 1", using=(_TRADE, _HOPS))
def eccentricity(spark, sf):
    return metrics.eccentricity(G.trade5(spark, sf))


@query("SELECT min(e) AS radius, max(e) AS diameter FROM (SELECT n_name, coalesce(max(hops) FILTER (source <> d.id), 0)::DOUBLE AS e FROM nation LEFT JOIN d ON source = n_name GROUP BY 1)", using=(_TRADE, _HOPS))
def radius_diameter(spark, sf):
    return metrics.radius_diameter(G.trade5(spark, sf))


@query("SELECT source AS id, round(coalesce((r / s::DOUBLE) * (r / 24::DOUBLE), 0), 6) AS closeness FROM (SELECT source, nullif(count(*) FILTER (source <> id), 0) AS r, nullif(sum(hops), 0) AS s FROM d GROUP BY 1)", using=(_TRADE, _HOPS))
def closeness(spark, sf):
    return metrics.closeness(G.trade5(spark, sf)).select("id", r6(F.col("closeness"), "closeness"))


@query(
    """SELECT n_name AS id, round(coalesce(b, 0) / (24 * 23)::DOUBLE, 6) AS betweenness FROM nation LEFT JOIN (
    SELECT a.id, sum(a.c * b.c / st.c) AS b FROM sg a JOIN sg b ON b.s = a.id JOIN sg st ON st.s = a.s AND st.id = b.id AND st.k = a.k + b.k
    WHERE a.s <> a.id AND b.id <> a.id AND a.s <> b.id GROUP BY a.id) x ON x.id = n_name""",
    using=(_TRADE, _HOPS, "sig AS (SELECT n_name AS s, n_name AS id, 0::BIGINT AS k, 1::DOUBLE AS c FROM nation UNION ALL SELECT sig.s, t5.dst, sig.k + 1, sum(sig.c) FROM sig JOIN t5 ON t5.src = sig.id JOIN d ON d.source = sig.s AND d.id = t5.dst AND d.hops = sig.k + 1 GROUP BY sig.s, t5.dst, sig.k), sg AS (SELECT * FROM sig)"),
)
def betweenness(spark, sf):
    return centrality.betweenness(G.trade5(spark, sf)).select("id", r6(F.col("betweenness"), "betweenness"))


@query(
    "SELECT id, round(x / sqrt(sum(x * x) OVER ()), 6) AS x FROM p WHERE k = 8",
    using=(_TRADE, "p AS (SELECT n_name AS id, 1::DOUBLE AS x, 0 AS k FROM nation UNION ALL SELECT t.src, sum(t.weight / 1e5 * p.x), p.k + 1 FROM p JOIN trade t ON t.dst = p.id WHERE p.k < 8 GROUP BY t.src, p.k)"),
)
def eigenvector_fixed(spark, sf):
    return centrality.eigenvector(G.trade(spark, sf), fixed_iters=8).select("id", r6(F.col("x"), "x"))


@query(
    "SELECT id, round(x, 8) AS rank FROM p WHERE k = 6",
    using=(_TRADE, "p AS (SELECT n_name AS id, (1 / 25::DOUBLE) AS x, 0 AS k FROM nation UNION ALL SELECT n_name, 0.15::DOUBLE / 25 + 0.85::DOUBLE * coalesce(sum(p.x / 5) FILTER (t5.dst = n_name), 0), p.k + 1 FROM p LEFT JOIN t5 ON t5.src = p.id CROSS JOIN nation WHERE p.k < 6 GROUP BY n_name, p.k)"),
)
def pagerank_fixed(spark, sf):
    return centrality.pagerank(G.trade5(spark, sf), fixed_iters=6, every=6).select("id", F.round("rank", 8).alias("rank"))


# Spectra


@query("SELECT src, dst, -weight AS v FROM tba UNION ALL SELECT src, src, sum(weight) FROM tba GROUP BY 1", using=(_TRADE,))
def laplacian(spark, sf):
    return spectral.laplacian(G.trade_both(spark, sf))


@query("SELECT src, dst, round(-weight / sqrt(a.d * b.d), 9) AS v FROM tba JOIN dg a ON a.id = src JOIN dg b ON b.id = dst UNION ALL SELECT id, id, 1::DOUBLE FROM dg", using=(_TRADE, "dg AS (SELECT src AS id, sum(weight) AS d FROM tba GROUP BY 1)"))
def normalized_laplacian(spark, sf):
    return spectral.normalized_laplacian(G.trade_both(spark, sf)).select("src", "dst", F.round("v", 9).alias("v"))


@query()
def spectral_values(spark, sf):
    return spectral.eigenvalues(G.trade_both(spark, sf)).select("k", F.round("value", 3).alias("value"))


_NL = "dg AS (SELECT src AS id, sum(weight) AS d FROM tba GROUP BY 1), nl AS (SELECT src AS i, dst AS j, -weight / sqrt(a.d * b.d) AS v FROM tba JOIN dg a ON a.id = src JOIN dg b ON b.id = dst UNION ALL SELECT id, id, 1::DOUBLE FROM dg)"


@query("SELECT round((SELECT sum(v) FROM nl WHERE i = j), 5) AS m1, round((SELECT sum(v * v) FROM nl), 5) AS m2, round((SELECT sum(a.v * b.v * c.v) FROM nl a JOIN nl b ON a.j = b.i JOIN nl c ON c.i = b.j AND c.j = a.i), 5) AS m3", using=(_TRADE, _NL))
def spectral_moments(spark, sf):
    """Sums of the powers of the normalised Laplacian's eigenvalues: traces of its powers."""
    values = spectral.eigenvalues(G.trade_both(spark, sf), normalized=True)
    return values.agg(*[F.round(F.sum(F.col("value") ** p), 5).alias(f"m{p}") for p in (1, 2, 3)])


@query("SELECT k::BIGINT AS k, CASE WHEN k = 0 THEN 5::DOUBLE ELSE 0 END AS value, (SELECT sum(n_nationkey * n_nationkey) FROM nation)::DOUBLE AS energy FROM range(25) t(k)")
def gft_constant(spark, sf):
    """A constant signal lies in the first place alone; the energy of any signal is that of its transform."""
    g = G.trade_both(spark, sf)
    energy = spectral.fourier(g, g.nodes.select("id", F.col("ord").cast("double").alias("value"))).agg(r6(F.sum(F.col("value") ** 2), "energy"))
    flat = spectral.fourier(g, g.nodes.select("id", F.lit(1.0).alias("value")))
    return flat.join(F.broadcast(energy)).select(F.col("k").cast("long").alias("k"), r6(F.col("value"), "value"), "energy")


@query()
def spectral_embeddings(spark, sf):
    return spectral.embeddings(G.trade_both(spark, sf))


@query("SELECT n_name AS id, n_nationkey::DOUBLE AS value FROM nation")
def gft_roundtrip(spark, sf):
    g = G.trade_both(spark, sf)
    signal = g.nodes.select("id", F.col("ord").cast("double").alias("value"))
    return spectral.inverse_fourier(g, spectral.fourier(g, signal)).select("id", r6(F.col("value"), "value"))


_PAIRS = "un AS (SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM t5), ua AS (SELECT src, dst FROM un UNION ALL SELECT dst, src FROM un), ud AS (SELECT src AS id, count(*)::DOUBLE AS d FROM ua GROUP BY 1)"


@query(
    "SELECT id, CASE WHEN v >= -1e-9 * (SELECT stddev_pop(v) FROM p WHERE k = 60) THEN 'A' ELSE 'B' END AS side FROM p WHERE k = 60",
    using=(
        _TRADE, _PAIRS, "st AS (SELECT src, dst, 0.5::DOUBLE / (SELECT max(d) FROM ud) AS w FROM ua UNION ALL SELECT id, id, 1 - 0.5::DOUBLE * d / (SELECT max(d) FROM ud) FROM ud)",
        "s0 AS (SELECT n_name AS id, (n_nationkey * 7919) % 101 / 101::DOUBLE AS v FROM nation), p AS (SELECT id, v - (SELECT avg(v) FROM s0) AS v, 0 AS k FROM s0 UNION ALL SELECT st.src, sum(st.w * p.v), p.k + 1 FROM p JOIN st ON st.dst = p.id WHERE p.k < 60 GROUP BY st.src, p.k)",
    ),
)
def fiedler_cut(spark, sf):
    g = G.trade5(spark, sf, directed=False)
    start = g.nodes.select("id", (F.col("ord") * 7919 % 101 / 101.0).alias("v"))
    return spectral.fiedler_cut(g, rounds=60, start=start).select("id", "side")


# Paths


@query(f"SELECT n_name AS id, coalesce(dist, 'inf'::DOUBLE) AS dist FROM nation LEFT JOIN dist ON dist.dst = n_name AND dist.src = '{START}'", using=(_TRADE, _DIST))
def dijkstra(spark, sf):
    return paths.dijkstra(G.trade5(spark, sf), START).select("id", "dist")


@query(f"SELECT n_name AS id, coalesce(dist, 'inf'::DOUBLE) AS dist, false AS negative_cycle FROM nation LEFT JOIN dist ON dist.dst = n_name AND dist.src = '{START}'", using=(_TRADE, _DIST))
def bellman_ford(spark, sf):
    found, negative = paths.bellman_ford(G.trade5(spark, sf), START)
    return found.select("id", "dist", F.lit(negative).alias("negative_cycle"))


@query("SELECT src, dst, dist FROM dist", using=(_TRADE, _DIST))
def floyd_warshall(spark, sf):
    return paths.all_pairs(G.trade5(spark, sf))


@query("SELECT src, dst, dist FROM dist", using=(_TRADE, _DIST))
def johnson(spark, sf):
    return paths.johnson(G.trade5(spark, sf))


@query(f"SELECT coalesce(min(dist), 'inf'::DOUBLE) AS cost FROM dist WHERE src = '{START}' AND dst = (SELECT min(dst) FROM t5)", using=(_TRADE, _DIST))
def astar_cost(spark, sf):
    g = G.trade5(spark, sf)
    goal = g.edges.agg(F.min("dst")).first()[0]
    return spark.createDataFrame([(paths.a_star(g, START, goal, F.lit(0.0))[1],)], "cost double")


# The first path, by the order of edges, among a node's shortest ones gives its place.
@query(
    "SELECT id, level, row_number() OVER (ORDER BY level, way) - 1 AS rank FROM (SELECT id, k::BIGINT AS level, min(way) AS way FROM w GROUP BY ALL)",
    using=(_TRADE, _HOPS, f"w AS (SELECT '{START}' AS id, 0 AS k, CAST([] AS INTEGER[]) AS way UNION ALL SELECT t5.dst, w.k + 1, list_append(way, t5.dk::INTEGER) FROM w JOIN t5 ON t5.src = w.id JOIN d ON d.source = '{START}' AND d.id = t5.dst AND d.hops = w.k + 1)"),
)
def bfs_order(spark, sf):
    return paths.bfs_order(G.trade5(spark, sf), START).select("id", F.col("level").cast("long").alias("level"), "rank")


@query()
def dfs_preorder(spark, sf):
    return paths.dfs_preorder(G.trade5(spark, sf), START)


# Structure


_FOREST = """SELECT src, dst, weight FROM e WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.src = e.src AND r.dst = e.dst AND r.at = e.dst)"""
_FOREST_USING = (_TRADE, "e AS (SELECT src, dst, weight, row_number() OVER (ORDER BY weight, src, dst) AS o FROM tb), ea AS (SELECT src AS a, dst AS b, o FROM e UNION ALL SELECT dst, src, o FROM e), r AS (SELECT src, dst, o, src AS at FROM e UNION SELECT r.src, r.dst, r.o, b FROM r JOIN ea ON ea.a = r.at AND ea.o < r.o)")


@query(_FOREST, using=_FOREST_USING)
def spanning_forest(spark, sf):
    g = G.trade_both(spark, sf)
    return components.spanning_forest(PropertyGraph(g.nodes, g.edges.withColumn("ord", F.dense_rank().over(Window.orderBy("src", "dst")).cast("long")), False))


@query(_FOREST, using=_FOREST_USING)  # every nation is linked with the start
def spanning_tree_from_start(spark, sf):
    g = G.trade_both(spark, sf)
    return components.spanning_forest(PropertyGraph(g.nodes, g.edges.withColumn("ord", F.dense_rank().over(Window.orderBy("src", "dst")).cast("long")), False), start=START)


@query(
    "SELECT id, c.component, max(level) AS level FROM scc c JOIN lv ON lv.component = c.component GROUP BY ALL",
    using=(
        _TRADE, _HOPS, "scc AS (SELECT a.source AS id, min(a.id) AS component FROM d a JOIN d b ON a.source = b.id AND a.id = b.source GROUP BY 1)",
        "ce AS (SELECT DISTINCT a.component AS a, b.component AS b FROM t5 JOIN scc a ON a.id = src JOIN scc b ON b.id = dst WHERE a.component <> b.component), lv AS (SELECT DISTINCT component, 0::BIGINT AS level FROM scc UNION SELECT b, level + 1 FROM lv JOIN ce ON ce.a = lv.component)",
    ),
)
def condensation(spark, sf):
    return components.condensation(G.trade5(spark, sf)).withColumn("level", F.col("level").cast("long"))


_TREE = """tree AS (SELECT 'r' || n_regionkey AS id, n_regionkey AS r, 0 AS l FROM nation UNION SELECT 'n' || n_nationkey, n_regionkey, 1 FROM nation UNION SELECT 'c' || c_custkey, n_regionkey, 2 FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


@query("SELECT id, min(id) OVER (PARTITION BY r) AS component FROM tree", using=(_TREE,))
def connected_components(spark, sf):
    return components.connected(G.hierarchy(spark, sf))


@query("SELECT id, l::BIGINT AS level FROM tree", using=(_TREE,))
def topological_level(spark, sf):
    return components.topological_levels(G.hierarchy(spark, sf)).select("id", F.col("level").cast("long"))


@query("SELECT a.source AS id, min(a.id) AS component FROM d a JOIN d b ON a.source = b.id AND a.id = b.source GROUP BY 1", using=(_TRADE, _HOPS))
def strongly_connected(spark, sf):
    return components.strongly_connected(G.trade5(spark, sf))


@query(
    "SELECT 'hierarchy' AS graph, EXISTS (SELECT 1 FROM hr WHERE src = dst) AS cyclic UNION ALL SELECT 'trade', EXISTS (SELECT 1 FROM tr WHERE src = dst)",
    using=(
        _TRADE, "he AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer)",
        "hr AS (SELECT src, dst FROM he UNION SELECT hr.src, he.dst FROM hr JOIN he ON hr.dst = he.src), tr AS (SELECT src, dst FROM trade UNION SELECT tr.src, trade.dst FROM tr JOIN trade ON tr.dst = trade.src)",
    ),
)
def has_cycle(spark, sf):
    return spark.createDataFrame([("hierarchy", components.has_cycle(G.hierarchy(spark, sf))), ("trade", components.has_cycle(G.trade(spark, sf)))], "graph string, cyclic boolean")


_IN_TURN = """r AS (SELECT id, row_number() OVER (ORDER BY {order}) AS k FROM (SELECT n_name AS id, n_nationkey AS ord, d FROM nation LEFT JOIN ud ON ud.id = n_name)),
    nb AS (SELECT a.k, a.id, list(b.k) FILTER (b.k < a.k) AS before FROM r a LEFT JOIN ua ON ua.src = a.id LEFT JOIN r b ON b.id = ua.dst GROUP BY ALL),
    col AS (SELECT 0::BIGINT AS k, CAST([] AS BIGINT[]) AS c UNION ALL SELECT nb.k, list_append(c, list_filter(range(0, 26), lambda x: NOT list_contains(list_transform(coalesce(before, []), lambda j: c[j]), x))[1]) FROM col JOIN nb ON nb.k = col.k + 1)"""
_COLOURS = "SELECT nb.id, (SELECT c FROM col ORDER BY k DESC LIMIT 1)[nb.k] AS colour FROM nb"


@query(_COLOURS, using=(_TRADE, _PAIRS, _IN_TURN.format(order="ord")))
def greedy_colouring(spark, sf):
    return components.colouring(G.trade5(spark, sf, directed=False)).select("id", F.col("colour").cast("long").alias("colour"))


@query(_COLOURS, using=(_TRADE, _PAIRS, _IN_TURN.format(order="coalesce(d, 0) DESC, ord")))
def welsh_powell(spark, sf):
    return components.colouring(G.trade5(spark, sf, directed=False), by_degree=True).select("id", F.col("colour").cast("long").alias("colour"))


@query("SELECT count(DISTINCT l_suppkey) AS pairs FROM lineitem")
def bipartite_matching_size(spark, sf):
    g = G.supplier_part(spark, sf)
    return flow.bipartite_matching(g, g.nodes.where("id like 's%'")).agg(F.count("*").alias("pairs"))


@query()
def max_flow(spark, sf):
    return flow.max_flow(G.trade(spark, sf), START, GOAL)


# On this dense graph the least cut is around one of the two ends; the test suite checks cuts elsewhere.
@query(f"SELECT least((SELECT sum(weight) FROM trade WHERE src = '{START}' AND dst <> src), (SELECT sum(weight) FROM trade WHERE dst = '{GOAL}' AND dst <> src)) AS value", using=(_TRADE,))
def max_flow_edmonds_karp(spark, sf):
    return flow.max_flow(G.trade(spark, sf), START, GOAL, "edmonds_karp").agg(F.max("value").alias("value"))


# Embeddings


@query(
    "SELECT t, v, x, round(weight * 1.0 / sum(weight) OVER (PARTITION BY t, v), 6) AS prob FROM (SELECT a.src AS t, a.dst AS v, b.dst AS x, b.weight * CASE WHEN b.dst = a.src THEN 2::DOUBLE WHEN EXISTS (SELECT 1 FROM t5 c WHERE c.src = a.src AND c.dst = b.dst) THEN 1 ELSE 0.25::DOUBLE END AS weight FROM t5 a JOIN t5 b ON a.dst = b.src)",
    using=(_TRADE,),
)
def transition_probability(spark, sf):
    return embed.transition_probabilities(G.trade5(spark, sf), p=0.5, q=4.0).select("t", "v", "x", r6(F.col("prob"), "prob"))


@query("SELECT a.event_type AS target, b.event_type AS context, count(*) AS n FROM steps a JOIN steps b ON a.user_id = b.user_id AND abs(a.step - b.step) IN (1, 2) GROUP BY 1, 2", using=(_STEPS,))
def skipgram_pairs(spark, sf):
    seq = G.event_steps(spark, sf).select(F.col("user_id").alias("seq"), F.col("step").alias("pos"), F.col("event_type").alias("id"))
    return embed.skipgram_pairs(seq).groupBy("target", "context").agg(F.count("*").alias("n"))


@query()
def random_walks(spark, sf):
    return embed.walks(G.trade5(spark, sf), 3, 5, 0.5, 2.0)


@query()
def node2vec(spark, sf):
    return embed.node2vec(G.trade5(spark, sf), dim=8, num_walks=4, epochs=2)


@query()
def line_embeddings(spark, sf):
    return embed.line(G.trade5(spark, sf), dim=8, epochs=3)


@query()
def hope(spark, sf):
    return embed.hope(G.trade5(spark, sf), dim=8, beta=1e-6)


# Probabilistic models


def _event_net(spark, sf) -> pgm.BayesNet:
    s = G.event_steps(spark, sf)
    pairs = s.select("user_id", F.col("step") + 1, F.col("event_type").alias("before")).toDF("user_id", "step", "before").join(s.select("user_id", "step", F.col("event_type").alias("after")), ["user_id", "step"])
    counts = pairs.groupBy("before", "after").agg(F.count("*").alias("c"))
    first = counts.groupBy("before").agg(F.sum("c").alias("n"))
    prior = first.join(F.broadcast(first.agg(F.sum("n").alias("z")))).select("before", (F.col("n") / F.col("z")).alias("prob"))
    table = counts.join(first, "before").select("before", "after", (F.col("c") / F.col("n")).alias("prob"))
    return pgm.BayesNet().add_variable("before", [], prior).add_variable("after", ["before"], table)


@query("SELECT a.event_type AS value, round(count(*) / sum(count(*)) OVER ()::DOUBLE, 6) AS prob FROM steps a JOIN steps b ON a.user_id = b.user_id AND b.step = a.step + 1 WHERE b.event_type = 'purchase' GROUP BY 1", using=(_STEPS,))
def bayes_exact(spark, sf):
    return _event_net(spark, sf).query("before", {"after": "purchase"}).select("value", r6(F.col("prob"), "prob"))


@query()
def bayes_rejection(spark, sf):
    return _event_net(spark, sf).rejection(spark, "before", {"after": "purchase"}, 5000)


# The chains are a tree, so that the beliefs are the marginals: every assignment of the four linked variables is weighed.
@query(
    """SELECT 'error' AS var, v::BIGINT AS value, round(CASE v WHEN 1 THEN p ELSE 1 - p END, 6) AS belief FROM pr, (SELECT unnest([0, 1]) AS v) WHERE event_type = 'error'
    UNION ALL SELECT var, value, round(sum(w) / sum(sum(w)) OVER (PARTITION BY var), 6) FROM (SELECT w, unnest(['click', 'view', 'purchase', 'signup']) AS var, unnest([cv, bv, pv, sv])::BIGINT AS value
      FROM (SELECT c.v AS cv, b.v AS bv, u.v AS pv, s.v AS sv, c.p * b.p * u.p * s.p * CASE WHEN c.v = b.v THEN 0.8::DOUBLE ELSE 0.2::DOUBLE END * CASE WHEN u.v = b.v THEN 0.8::DOUBLE ELSE 0.2::DOUBLE END * CASE WHEN s.v = b.v THEN 0.8::DOUBLE ELSE 0.2::DOUBLE END AS w
        FROM bt c, bt b, bt u, bt s WHERE c.event_type = 'click' AND b.event_type = 'view' AND u.event_type = 'purchase' AND s.event_type = 'signup')) GROUP BY var, value""",
    using=("pr AS (SELECT event_type, count(*) / (SELECT count(*) FROM events)::DOUBLE AS p FROM events GROUP BY 1), bt AS (SELECT event_type, v, CASE v WHEN 1 THEN p ELSE 1 - p END AS p FROM pr, (SELECT unnest([0, 1]) AS v))",),
)
def belief_propagation(spark, sf):
    kinds = G.event_steps(spark, sf).groupBy("event_type").agg(F.count("*").cast("double").alias("n"))
    z = kinds.agg(F.sum("n").alias("z"))
    one = kinds.join(F.broadcast(z)).select(F.concat(F.lit("prior-"), "event_type").alias("factor"), F.col("event_type").alias("var1"), F.explode(F.array(F.struct(F.lit(0).alias("v"), (1 - F.col("n") / F.col("z")).alias("p")), F.struct(F.lit(1).alias("v"), (F.col("n") / F.col("z")).alias("p")))).alias("e"))
    one = one.select("factor", "var1", F.col("e.v").alias("val1"), F.lit(None).cast("string").alias("var2"), F.lit(None).cast("int").alias("val2"), F.col("e.p").alias("phi"))
    chain = spark.createDataFrame([(f"{a}-{b}", a, i, b, j, 0.8 if i == j else 0.2) for a, b in (("click", "view"), ("view", "purchase"), ("view", "signup")) for i in (0, 1) for j in (0, 1)], one.schema)
    return pgm.belief_propagation(kinds.select(F.col("event_type").alias("var")), one.union(chain), 5).select("var", F.col("value").cast("long").alias("value"), r6(F.col("belief"), "belief"))


@query(
    "SELECT seq, arg_min(path, {'p': -p, 's': s}) AS path, round(max(p), 6) AS score FROM (SELECT *, max(step) OVER (PARTITION BY seq) AS l FROM vt) WHERE step = l GROUP BY seq",
    using=(
        _STEPS, "em AS (SELECT * FROM (VALUES ('browse', 'click', 0.3), ('browse', 'view', 0.4), ('browse', 'error', 0.1), ('browse', 'signup', 0.1), ('browse', 'purchase', 0.1), ('buy', 'click', 0.2), ('buy', 'view', 0.1), ('buy', 'error', 0.1), ('buy', 'signup', 0.2), ('buy', 'purchase', 0.4)) t(s, o, p))",
        "tr AS (SELECT * FROM (VALUES ('browse', 'browse', 0.8), ('browse', 'buy', 0.2), ('buy', 'browse', 0.4), ('buy', 'buy', 0.6)) t(a, b, p))",
        "vt AS (SELECT user_id AS seq, step, s, ln(CASE s WHEN 'browse' THEN 0.7 ELSE 0.3 END::DOUBLE) + ln(em.p::DOUBLE) AS p, s AS path FROM steps JOIN em ON em.o = event_type WHERE step = 0 "
        "UNION ALL SELECT vt.seq, steps.step, em.s, max(vt.p + ln(tr.p::DOUBLE)) + max(ln(em.p::DOUBLE)), arg_min(vt.path, {'p': -(vt.p + ln(tr.p::DOUBLE)), 's': vt.s}) || ',' || em.s FROM vt JOIN steps ON steps.user_id = vt.seq AND steps.step = vt.step + 1 JOIN em ON em.o = event_type JOIN tr ON tr.a = vt.s AND tr.b = em.s GROUP BY vt.seq, steps.step, em.s)",
    ),
)
def hmm_viterbi(spark, sf):
    seq = G.event_steps(spark, sf).groupBy(F.col("user_id").alias("seq")).agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "event_type"))), lambda x: x["event_type"]).alias("observations"))
    emission = [{"click": 0.3, "view": 0.4, "error": 0.1, "signup": 0.1, "purchase": 0.1}, {"click": 0.2, "view": 0.1, "error": 0.1, "signup": 0.2, "purchase": 0.4}]
    out = pgm.viterbi(seq, ["browse", "buy"], [0.7, 0.3], [[0.8, 0.2], [0.4, 0.6]], emission, log=True)
    return out.select("seq", F.array_join("path", ",").alias("path"), r6(F.col("score"), "score"))


@query(
    "SELECT seq::VARCHAR AS seq, arg_min(path, {'p': -p, 's': s}) AS path FROM (SELECT *, max(step) OVER (PARTITION BY seq) AS l FROM cf) WHERE step = l GROUP BY seq",
    using=(
        _STEPS, "lb AS (SELECT * FROM (VALUES (0, 'click'), (1, 'view'), (2, 'purchase')) t(s, o))",
        "tr AS (SELECT * FROM (VALUES (0, 0, 0.2), (0, 1, 0.1), (0, 2, 0.0), (1, 0, 0.0), (1, 1, 0.3), (1, 2, 0.1), (2, 0, 0.1), (2, 1, 0.0), (2, 2, 0.2)) t(a, b, w))",
        "cf AS (SELECT user_id AS seq, step, s, (event_type = o)::INTEGER::DOUBLE AS p, s::VARCHAR AS path FROM steps, lb WHERE step = 0 "
        "UNION ALL SELECT cf.seq, steps.step, lb.s, max(cf.p + tr.w::DOUBLE) + max((event_type = lb.o)::INTEGER::DOUBLE), arg_min(cf.path, {'p': -(cf.p + tr.w::DOUBLE), 's': cf.s}) || ',' || lb.s FROM cf JOIN steps ON steps.user_id = cf.seq AND steps.step = cf.step + 1 JOIN tr ON tr.a = cf.s JOIN lb ON lb.s = tr.b GROUP BY cf.seq, steps.step, lb.s)",
    ),
)
def crf_decode(spark, sf):
    s = G.event_steps(spark, sf).select(F.col("user_id").alias("seq"), "step", F.array(*[F.when(F.col("event_type") == t, 1.0).otherwise(0.0) for t in ("click", "view", "purchase")]).alias("e"))
    seq = s.groupBy("seq").agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "e"))), lambda x: x["e"]).alias("emissions")).withColumn("transitions", F.array(V.vec([0.2, 0.1, 0.0]), V.vec([0.0, 0.3, 0.1]), V.vec([0.1, 0.0, 0.2])))
    return pgm.crf_decode(seq, 3).select("seq", F.array_join(F.col("path").cast("array<string>"), ",").alias("path"))


# Knowledge graph


@query(
    """SELECT 'spo' AS pattern, count(*) AS n FROM kg WHERE s = 'nation:3' AND p = 'in_region' AND o = 'region:3' UNION ALL SELECT 'sp', count(*) FROM kg WHERE s = 'nation:3' AND p = 'in_region'
    UNION ALL SELECT 'so', count(*) FROM kg WHERE s = 'customer:1' AND o = 'nation:3' UNION ALL SELECT 'po', count(*) FROM kg WHERE p = 'in_nation' AND o = 'nation:3' UNION ALL SELECT 's', count(*) FROM kg WHERE s = 'customer:1'
    UNION ALL SELECT 'p', count(*) FROM kg WHERE p = 'in_nation' UNION ALL SELECT 'o', count(*) FROM kg WHERE o = 'nation:3' UNION ALL SELECT 'any', count(*) FROM kg""",
    using=(_KG,),
)
def triple_patterns(spark, sf):
    t, out = G.triples(spark, sf), None
    for name, pattern in {"spo": ("nation:3", "in_region", "region:3"), "sp": ("nation:3", "in_region", "?o"), "so": ("customer:1", "?p", "nation:3"), "po": ("?s", "in_nation", "nation:3"), "s": ("customer:1", "?p", "?o"), "p": ("?s", "in_nation", "?o"), "o": ("?s", "?p", "nation:3"), "any": ("?s", "?p", "?o")}.items():
        one = kg.match(t, *pattern).agg(F.count("*").alias("n")).select(F.lit(name).alias("pattern"), "n")
        out = one if out is None else out.union(one)
    return out


def _named(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").alias(c.lstrip("?")) for c in df.columns])


@query("SELECT a.s AS c, a.o AS n, b.o AS r FROM kg a JOIN kg b ON a.o = b.s WHERE a.p = 'in_nation' AND b.p = 'in_region'", using=(_KG,))
def bgp_two_hop(spark, sf):
    return _named(kg.bgp(G.triples(spark, sf), [("?c", "in_nation", "?n"), ("?n", "in_region", "?r")]))


@query("SELECT x.s AS o, x.o AS c, a.o AS n, b.o AS r FROM kg x JOIN kg a ON x.o = a.s JOIN kg b ON a.o = b.s WHERE x.p = 'placed_by' AND a.p = 'in_nation' AND b.p = 'in_region'", using=(_KG,))
def bgp_three_hop(spark, sf):
    return _named(kg.bgp(G.triples(spark, sf), [("?o", "placed_by", "?c"), ("?c", "in_nation", "?n"), ("?n", "in_region", "?r")]))


@query("SELECT s AS x, p FROM kg WHERE s = o UNION ALL SELECT 'loop', 'self'", using=(_KG,))
def bgp_repeated_var(spark, sf):
    t = kg.add_triples(G.triples(spark, sf), spark.createDataFrame([("loop", "self", "loop")], "s string, p string, o string"))
    return _named(kg.bgp(t, [("?x", "?p", "?x")]))


@query("SELECT DISTINCT p FROM kg WHERE o = 'nation:3'", using=(_KG,))
def bgp_predicate_var(spark, sf):
    return _named(kg.bgp(G.triples(spark, sf), [("?s", "?p", "nation:3")])).select("p").distinct()


@query("SELECT a.s AS n, b.s AS m FROM kg a CROSS JOIN kg b WHERE a.p = 'in_region' AND a.o = 'region:0' AND b.p = 'in_region' AND b.o = 'region:1'", using=(_KG,))
def bgp_cartesian(spark, sf):
    return _named(kg.bgp(G.triples(spark, sf), [("?n", "in_region", "region:0"), ("?m", "in_region", "region:1")]))


@query(
    """SELECT mention, arg_min(c_name, o) FILTER (d IS NOT NULL) AS id FROM (SELECT m.mention, e.n_name AS c_name, levenshtein(lower(m.mention), lower(e.n_name)) AS d, levenshtein(lower(m.mention), lower(e.n_name)) * 1000 + e.n_nationkey AS o
    FROM (SELECT DISTINCT 'nation ' || n_nationkey AS mention FROM nation) m LEFT JOIN nation e ON 1 - levenshtein(lower(m.mention), lower(e.n_name)) / greatest(length(m.mention), length(e.n_name))::DOUBLE >= 0.6) GROUP BY 1"""
)
def entity_linking(spark, sf):
    n = G.table(spark, sf, "nation")
    mentions = n.select(F.concat(F.lit("nation "), F.col("n_nationkey").cast("string")).alias("mention"))
    return kg.link_entities(mentions, n.select(F.col("n_name").alias("id"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("ord")))


@query(
    "SELECT a, b, round(0.4::DOUBLE * i / u + 0.6::DOUBLE, 6) AS score, 0.4::DOUBLE * i / u + 0.6::DOUBLE >= 0.7 - 1e-12 AS same FROM (SELECT x.n_name AS a, y.n_name AS b, (SELECT count(*) FROM t5 p JOIN t5 q ON p.dst = q.dst WHERE p.src = x.n_name AND q.src = y.n_name) AS i, (SELECT count(DISTINCT dst) FROM t5 WHERE src IN (x.n_name, y.n_name)) AS u FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey AND x.n_nationkey < y.n_nationkey)",
    using=(_TRADE,),
)
def entity_resolution(spark, sf):
    n = G.table(spark, sf, "nation").select("n_name", "n_nationkey", "n_regionkey")
    pairs = n.toDF("a", "ka", "r").join(n.toDF("b", "kb", "r"), "r").where("ka < kb").select("a", "b")
    return kg.resolve_entities(G.trade5(spark, sf), pairs).select("a", "b", r6(F.col("score"), "score"), "same")


def _vectors(spark, sf) -> DataFrame:
    """Each embedding, whole, as eight vectors: a triple's parts, and the rows of its matrix."""
    part = lambda lo: F.transform(F.slice("embedding", lo, 8), lambda v: v.cast("double"))
    return G.table(spark, sf, "embeddings").select("vec_id", *[part(8 * k + 1).alias(n) for k, n in enumerate("hrtwabcd")])


_VEC = "v AS (SELECT vec_id, " + ", ".join(f"embedding[{8 * k + 1}:{8 * k + 8}]::DOUBLE[] AS {n}" for k, n in enumerate("hrtwabcd")) + " FROM embeddings)"


def _sum(e: str) -> str:
    return f"list_sum([{', '.join(e.replace('$', str(i)) for i in range(1, 9))}])"


_UH, _UT, _UW = "sqrt(list_inner_product(h, h))", "sqrt(list_inner_product(t, t))", "list_inner_product(w, w)"


@query(f"SELECT vec_id, round({_sum(f'abs(h[$] / {_UH} + r[$] - t[$] / {_UT})')}, 5) + 0::DOUBLE AS score FROM v", using=(_VEC,))
def score_transe(spark, sf):
    return _vectors(spark, sf).select("vec_id", F.round(kg.transe("h", "r", "t"), 5).alias("score"))


@query(f"SELECT vec_id, round({_sum(f'abs(h[$] - w[$] * list_inner_product(w, h) / {_UW} + r[$] - t[$] + w[$] * list_inner_product(w, t) / {_UW})')}, 5) + 0::DOUBLE AS score FROM v", using=(_VEC,))
def score_transh(spark, sf):
    return _vectors(spark, sf).select("vec_id", F.round(kg.transh("h", "r", "t", "w"), 5).alias("score"))


_ROW = dict(enumerate("abcdabcd", 1))


@query("SELECT vec_id, round(list_sum([" + ", ".join(f"abs(list_inner_product({_ROW[i]}, h) + r[{i}] - list_inner_product({_ROW[i]}, t))" for i in range(1, 9)) + "]), 5) + 0::DOUBLE AS score FROM v", using=(_VEC,))
def score_transr(spark, sf):
    return _vectors(spark, sf).select("vec_id", F.round(kg.transr("h", "r", "t", F.array(*_ROW.values())), 5).alias("score"))


@query(f"SELECT vec_id, round({_sum('sqrt(power(h[$] * cos(r[$]) - w[$] * sin(r[$]) - t[$], 2) + power(h[$] * sin(r[$]) + w[$] * cos(r[$]) - a[$], 2) + 1e-15)')}, 5) + 0::DOUBLE AS score FROM v", using=(_VEC,))
def score_rotate(spark, sf):
    return _vectors(spark, sf).select("vec_id", F.round(kg.rotate("h", "w", "r", "t", "a"), 5).alias("score"))


@query(f"SELECT vec_id, round({_sum('h[$] * r[$] * t[$]')}, 5) + 0::DOUBLE AS score FROM v", using=(_VEC,))
def score_distmult(spark, sf):
    return _vectors(spark, sf).select("vec_id", F.round(kg.distmult("h", "r", "t"), 5).alias("score"))


@query(f"SELECT vec_id, round({_sum('h[$] * r[$] * t[$] + w[$] * r[$] * b[$] + h[$] * a[$] * b[$] - w[$] * a[$] * t[$]')}, 5) + 0::DOUBLE AS score FROM v", using=(_VEC,))
def score_complex(spark, sf):
    return _vectors(spark, sf).select("vec_id", F.round(kg.complex_score("h", "w", "r", "a", "t", "b"), 5).alias("score"))


@query("SELECT vec_id, round(list_sum([" + ", ".join(f"h[{i}] * list_inner_product({_ROW[i]}, t)" for i in range(1, 9)) + "]), 5) + 0::DOUBLE AS score FROM v", using=(_VEC,))
def score_rescal(spark, sf):
    return _vectors(spark, sf).select("vec_id", F.round(kg.rescal("h", F.array(*_ROW.values()), "t"), 5).alias("score"))


@query(f"SELECT vec_id, round(greatest(1 + {_sum('h[$] * w[$] * t[$]')} - {_sum('h[$] * r[$] * t[$]')}, 0), 5) + 0::DOUBLE AS loss FROM v", using=(_VEC,))
def kge_margin_loss(spark, sf):
    return _vectors(spark, sf).select("vec_id", F.round(kg.margin_loss(kg.distmult("h", "r", "t"), kg.distmult("h", "w", "t"), "distmult"), 5).alias("loss"))


# Graph neural layers

W3 = [[0.5, -0.25, 0.125, 1.0], [1.0, 0.0, -1.0, 0.5], [-0.5, 0.75, 0.25, -1.0]]


def _ring(spark, sf) -> tuple[DataFrame, DataFrame]:
    return G.features(spark, sf), G.ring(spark, sf).edges.select("src", "dst", "type")


def _flat(df: DataFrame, size: int, column: str = "x") -> DataFrame:
    return df.select("id", *[(F.round(F.col(column)[k], 5) + F.lit(0.0)).alias(f"x{k}") for k in range(size)])


def _agg(how: str, last: str = "") -> str:
    return "SELECT f0.id, " + ", ".join(f"round(coalesce({last.replace('$', f'{how}(f.{c})') if last else f'{how}(f.{c})'}, 0), 5) AS x{k}" for k, c in enumerate("abce")) + " FROM f f0 LEFT JOIN (ring JOIN f ON f.id = ring.src) ON ring.dst = f0.id GROUP BY f0.id"


@query(_agg("sum"), using=(_RING,))
def scatter_add(spark, sf):
    x, e = _ring(spark, sf)
    return _flat(gnn.scatter_add(e.join(x.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"), "x"), 4, x), 4)


@query(_agg("avg"), using=(_RING,))
def mp_mean(spark, sf):
    return _flat(gnn.propagate(*_ring(spark, sf), 4, "mean"), 4, "agg")


@query(_agg("max", "greatest($, 0)"), using=(_RING,))
def mp_max(spark, sf):
    return _flat(gnn.propagate(*_ring(spark, sf), 4, "max"), 4, "agg")


def _lin(row: list[float]) -> str:
    return " + ".join(f"{w}::DOUBLE * f.{c}" for w, c in zip(row, "abce", strict=True))


@query(
    "SELECT el.dst AS id, " + ", ".join(f"round(sum(({_lin(w)}) / sqrt(di.d * dj.d)), 5) AS x{k}" for k, w in enumerate(W3)) + " FROM el JOIN f ON f.id = el.src JOIN dg di ON di.id = el.dst JOIN dg dj ON dj.id = el.src GROUP BY 1",
    using=(_RING, "el AS (SELECT src, dst FROM ring UNION ALL SELECT id, id FROM f), dg AS (SELECT dst AS id, count(*)::DOUBLE AS d FROM el GROUP BY 1)"),
)
def gcn(spark, sf):
    return _flat(gnn.gcn(*_ring(spark, sf), W3), 3)


@query(
    "SELECT f.id, " + ", ".join(f"round(greatest({_lin(w)} + " + " + ".join(f"{x}::DOUBLE * coalesce(m.{c}, 0)" for x, c in zip(w[::-1], "abce", strict=True)) + f", 0), 5) AS x{k}" for k, w in enumerate(W3)) + " FROM f LEFT JOIN (SELECT ring.dst AS id, avg(f.a) AS a, avg(f.b) AS b, avg(f.c) AS c, avg(f.e) AS e FROM ring JOIN f ON f.id = ring.src GROUP BY 1) m ON m.id = f.id",
    using=(_RING,),
)
def sage(spark, sf):
    return _flat(gnn.sage(*_ring(spark, sf), W3, [w[::-1] for w in W3]), 3)


_R3 = [w[::-1] for w in W3]


def _dot(row: list[float], columns: list[str]) -> str:
    return " + ".join(f"{w}::DOUBLE * {c}" for w, c in zip(row, columns, strict=True))


def _columns(rows: list[list[float]], columns: list[str], name: str, wrap: str = "{}") -> str:
    """SELECT items: the matrix times the columns, each wrapped, as name0, name1 and so on."""
    return ", ".join(f"{wrap.format(_dot(w, columns))} AS {name}{k}" for k, w in enumerate(rows))


_F = ["f.a", "f.b", "f.c", "f.e"]
_LOOPED = _RING + ", el AS (SELECT src, dst FROM ring UNION ALL SELECT id, id FROM f), dg AS (SELECT dst AS id, count(*)::DOUBLE AS d FROM el GROUP BY 1)"


def _gcn(table: str, columns: list[str], rows: list[list[float]], name: str = "x", wrap: str = "{}") -> str:
    """A GCN layer over the table (id, columns)."""
    return f"SELECT el.dst AS id, {_columns(rows, columns, name, wrap.format('sum(({}) / sqrt(di.d * dj.d))'))} FROM el JOIN {table} ON {table}.id = el.src JOIN dg di ON di.id = el.dst JOIN dg dj ON dj.id = el.src GROUP BY 1"


@query(
    "SELECT f.id, " + ", ".join(f"round(coalesce(h{k}.v{j}, 0), 5) AS x{3 * k + j}" for k in range(2) for j in range(3)) + " FROM f LEFT JOIN att h0 ON h0.id = f.id AND h0.head = 0 LEFT JOIN att h1 ON h1.id = f.id AND h1.head = 1",
    using=(
        _RING, f"hd AS (SELECT id, 0 AS head, {_columns(W3, _F, 'h')} FROM f UNION ALL SELECT id, 1, {_columns(_R3, _F, 'h')} FROM f)",
        f"sc AS (SELECT t.id, t.head, s.h0, s.h1, s.h2, {_dot([0.1, 0.2, 0.3], ['t.h0', 't.h1', 't.h2'])} + {_dot([0.3, 0.1, -0.2], ['s.h0', 's.h1', 's.h2'])} AS r FROM ring JOIN hd s ON s.id = ring.src JOIN hd t ON t.id = ring.dst AND t.head = s.head)",
        "sw AS (SELECT *, exp(CASE WHEN r > 0 THEN r ELSE 0.2::DOUBLE * r END) AS w FROM sc), att AS (SELECT id, head, sum(w * h0) / sum(w) AS v0, sum(w * h1) / sum(w) AS v1, sum(w * h2) / sum(w) AS v2 FROM sw GROUP BY ALL)",
    ),
)
def gat(spark, sf):
    return _flat(gnn.gat(*_ring(spark, sf), [W3, [w[::-1] for w in W3]], [[0.1, 0.2, 0.3]] * 2, [[0.3, 0.1, -0.2]] * 2), 6)


_W4 = W3 + W3[:1]
_N4 = [f"n{k}" for k in range(4)]


def _normed(table: str, columns: list[str], name: str) -> str:
    mean = f"(({' + '.join(columns)}) / {len(columns)})"
    var = f"(({' + '.join(f'power({c} - {mean}, 2)' for c in columns)}) / {len(columns)})"
    return f"SELECT id, {', '.join(f'({c} - {mean}) / sqrt({var} + 1e-5::DOUBLE) AS {name}{k}' for k, c in enumerate(columns))} FROM {table}"


@query(
    "SELECT id, " + ", ".join(f"round(o{k}, 5) AS x{k}" for k in range(4)) + " FROM out4",
    using=(
        _RING, f"hd AS (SELECT id, 0 AS head, {_columns(W3[:2], _F, 'h')} FROM f UNION ALL SELECT id, 1, {_columns(W3[1:], _F, 'h')} FROM f)",
        "sw AS (SELECT t.id, t.head, s.h0, s.h1, exp((t.h0 * s.h0 + t.h1 * s.h1) / sqrt(2::DOUBLE)) AS w FROM ring JOIN hd s ON s.id = ring.src JOIN hd t ON t.id = ring.dst AND t.head = s.head)",
        "att AS (SELECT id, head, sum(w * h0) / sum(w) AS v0, sum(w * h1) / sum(w) AS v1 FROM sw GROUP BY ALL)",
        "mx AS (SELECT f.id, " + ", ".join(f"{_dot(_W4[k], _F)} + coalesce(h{k // 2}.v{k % 2}, 0) AS m{k}" for k in range(4)) + " FROM f LEFT JOIN att h0 ON h0.id = f.id AND h0.head = 0 LEFT JOIN att h1 ON h1.id = f.id AND h1.head = 1)",
        f"ln AS ({_normed('mx', ['m0', 'm1', 'm2', 'm3'], 'n')}), hid AS (SELECT *, {_columns(_W4, _N4, 'u', 'greatest({}, 0)')} FROM ln)",
        "fed AS (SELECT id, " + ", ".join(f"n{k} + {_dot(w, ['u0', 'u1', 'u2', 'u3'])} AS g{k}" for k, w in enumerate(_W4)) + f" FROM hid), out4 AS ({_normed('fed', ['g0', 'g1', 'g2', 'g3'], 'o')})",
    ),
)
def graph_transformer(spark, sf):
    two = [W3[:2], W3[1:]]
    return _flat(gnn.graph_transformer(*_ring(spark, sf), two, two, two, W3 + W3[:1], W3 + W3[:1], W3 + W3[:1]), 4)


@query(
    "SELECT f.id, " + ", ".join(f"round({_dot(W3[k], _F)} + coalesce(n.x{k}, 0) + coalesce(s.x{k}, 0), 5) AS x{k}" for k in range(3)) + " FROM f LEFT JOIN rm n ON n.id = f.id AND n.type = 'next' LEFT JOIN rm s ON s.id = f.id AND s.type = 'skip'",
    using=(_RING, "rm AS (SELECT ring.dst AS id, type, " + ", ".join(f"avg(CASE type WHEN 'next' THEN {_dot(W3[k], _F)} ELSE {_dot(_R3[k], _F)} END) AS x{k}" for k in range(3)) + " FROM ring JOIN f ON f.id = ring.src GROUP BY ALL)"),
)
def rgcn(spark, sf):
    return _flat(gnn.rgcn(*_ring(spark, sf), {"next": W3, "skip": [w[::-1] for w in W3]}, W3), 3)


_X3 = ["x0", "x1", "x2"]


@query(
    "SELECT t.id, round(t.x0 * s0 + t.x1 * s1 + t.x2 * s2, 6) AS positive, round(n.x0 * s0 + n.x1 * s1 + n.x2 * s2, 6) AS negative FROM tr t JOIN fa n ON n.id = t.id CROSS JOIN ws",
    using=(
        _LOOPED, f"tr AS ({_gcn('f', _F, W3)}), fa AS ({_gcn('f', _F[::-1], W3)})",
        "sm AS (SELECT " + ", ".join(f"1 / (1 + exp(-avg(x{k}))) AS m{k}" for k in range(3)) + f" FROM tr), ws AS (SELECT {_columns([r[:3] for r in W3], ['m0', 'm1', 'm2'], 's')} FROM sm)",
    ),
)
def infomax_scores(spark, sf):
    x, e = _ring(spark, sf)
    out = gnn.infomax_scores(x, x.select("id", F.reverse("x").alias("x")), e, W3, [r[:3] for r in W3])
    return out.select("id", r6(F.col("positive"), "positive"), r6(F.col("negative"), "negative"))


_VGAE = (_LOOPED, f"h1 AS ({_gcn('f', _F, W3, wrap='greatest({}, 0)')}), mu AS ({_gcn('h1', _X3, [r[:3] for r in W3[:2]], 'm')}), lv AS ({_gcn('h1', _X3, [r[1:] for r in W3[:2]], 'l')})")


@query("SELECT ring.src, ring.dst, round(1 / (1 + exp(-(a.m0 * b.m0 + a.m1 * b.m1))), 6) AS prob FROM ring JOIN mu a ON a.id = ring.src JOIN mu b ON b.id = ring.dst", using=_VGAE)
def vgae_decode(spark, sf):
    x, e = _ring(spark, sf)
    z = gnn.vgae_encode(x, e, W3, [r[:3] for r in W3[:2]], [r[1:] for r in W3[:2]])
    return gnn.vgae_decode(z.select("id", F.col("mu").alias("x")), e).select("src", "dst", r6(F.col("prob"), "prob"))


@query("SELECT round(-0.5::DOUBLE * avg(2 + l0 + l1 - m0 * m0 - m1 * m1 - exp(l0) - exp(l1)), 6) AS kl FROM mu JOIN lv USING (id)", using=_VGAE)
def vgae_kl(spark, sf):
    return gnn.vgae_kl(gnn.vgae_encode(*_ring(spark, sf), W3, [r[:3] for r in W3[:2]], [r[1:] for r in W3[:2]])).select(r6(F.col("kl"), "kl"))


@query(
    "SELECT k::BIGINT AS step, id, round(h, 6) AS heat FROM p",
    using=(_TRADE, "dg AS (SELECT src AS id, sum(weight / 1e6) AS d FROM tba GROUP BY 1), m AS (SELECT id, id AS src, 1 - 0.2::DOUBLE * d AS v FROM dg UNION ALL SELECT dst, src, 0.2::DOUBLE * weight / 1e6 FROM tba), p AS (SELECT n_name AS id, n_nationkey::DOUBLE AS h, 0 AS k FROM nation UNION ALL SELECT m.id, sum(m.v * p.h), p.k + 1 FROM p JOIN m ON m.src = p.id WHERE p.k < 3 GROUP BY m.id, p.k)"),
)
def heat_diffusion(spark, sf):
    g = G.trade_both(spark, sf)
    g = PropertyGraph(g.nodes, g.edges.withColumn("weight", F.col("weight") / 1e6), False)
    out = gnn.heat_diffusion(g, g.nodes.select("id", F.col("ord").cast("double").alias("heat")), 3, 0.2)
    return out.select(F.col("step").cast("long").alias("step"), "id", r6(F.col("heat"), "heat"))


# Retrieval and memory


@query("SELECT term, count(*) AS n, count(DISTINCT doc_id) AS docs FROM tok GROUP BY 1", using=(_WORDS,))
def tokenize_counts(spark, sf):
    t = G.table(spark, sf, "documents").select("doc_id", F.explode(retrieval.tokens("text")).alias("term"))
    by_doc = t.groupBy("term", "doc_id").agg(F.count("*").alias("c"))
    return by_doc.groupBy("term").agg(F.sum("c").alias("n"), F.count("*").alias("docs"))


_TFIDF = _WORDS + ", c AS (SELECT doc_id, size, term, count(*) AS c FROM tok GROUP BY ALL), ix AS (SELECT doc_id, term, c / size::DOUBLE AS tf, ln(1 + (SELECT count(*) FROM documents) / (1 + df)::DOUBLE) AS idf FROM c JOIN (SELECT term, count(*) AS df FROM c GROUP BY 1) USING (term))"


@query("SELECT doc_id, count(*) AS terms, round(sum(tf * idf), 6) AS weight, round(max(tf * idf), 6) AS top FROM ix GROUP BY 1", using=(_TFIDF,))
def tfidf_index(spark, sf):
    ix = retrieval.tfidf(G.table(spark, sf, "documents"))
    return ix.groupBy("doc_id").agg(F.count("*").alias("terms"), F.round(F.sum("tfidf"), 6).alias("weight"), F.round(F.max("tfidf"), 6).alias("top"))


TEXT = "this work is licensed under the apache license of the thing"


@query(
    "SELECT documents.doc_id, round(coalesce(s, 0), 6) AS score FROM documents LEFT JOIN (SELECT doc_id, sum(tf * idf * qtf * idf) / (max(dn) * max(qn)) AS s FROM ix JOIN q USING (term) JOIN (SELECT doc_id, sqrt(sum(power(tf * idf, 2))) AS dn FROM ix GROUP BY 1) USING (doc_id) CROSS JOIN (SELECT sqrt(sum(power(qtf * idf, 2))) AS qn FROM (SELECT DISTINCT term, idf, qtf FROM ix JOIN q USING (term))) GROUP BY 1) x ON x.doc_id = documents.doc_id ORDER BY coalesce(s, 0) DESC, documents.doc_id LIMIT 5",
    using=(_TFIDF, f"q AS (SELECT term, count(*) / 11::DOUBLE AS qtf FROM (SELECT unnest(string_split('{TEXT}', ' ')) AS term) GROUP BY 1)"),
)
def tfidf_query_topk(spark, sf):
    docs = G.table(spark, sf, "documents")
    return retrieval.vector_query(checkpoint(retrieval.tfidf(docs)), docs, TEXT, 5).select("doc_id", r6(F.col("score"), "score"))


_CHUNKS = "SELECT doc_id, (i - 1)::BIGINT AS chunk, trim(parts[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS text FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS parts FROM documents)) WHERE trim(parts[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''"


@query(_CHUNKS)
def chunking(spark, sf):
    return retrieval.chunks(G.table(spark, sf, "documents")).withColumn("chunk", F.col("chunk").cast("long"))


# The pattern's look-ahead holds no capital, so reading its end along doesn't move the next match.
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_STATED = r"\b([A-Z][a-zA-Z]+)\s+([a-z_]+)\s+([A-Z][a-zA-Z\s0-9]+?)(?:\.|,|and|\s+is\b|\s+was\b|$)"
_COPULA = r"\b([A-Z][a-zA-Z]+)\s+is\s+(?:a|an)?\s*([a-zA-Z\s]+?)(?:\.|,|$)"


@query(
    f"SELECT doc_id, unnest(regexp_extract_all(text, '{_STATED}', 1)) AS s, unnest(regexp_extract_all(text, '{_STATED}', 2)) AS p, trim(unnest(regexp_extract_all(text, '{_STATED}', 3)), {_BLANKS}) AS o FROM documents "
    f"UNION ALL SELECT doc_id, unnest(regexp_extract_all(text, '{_COPULA}', 1)), 'is_a', replace(trim(unnest(regexp_extract_all(text, '{_COPULA}', 2)), {_BLANKS}), ' ', '_') FROM documents"
)
def extract_triples(spark, sf):
    return retrieval.extract_triples(G.table(spark, sf, "documents").select("doc_id", "text"))


@query(
    "SELECT DISTINCT entity, doc_id, chunk FROM (SELECT doc_id, chunk, unnest([s, o]) AS entity FROM st)",
    using=(
        f"ch AS ({_CHUNKS}), st AS (SELECT doc_id, chunk, unnest(regexp_extract_all(text, '{_STATED}', 1)) AS s, trim(unnest(regexp_extract_all(text, '{_STATED}', 3)), {_BLANKS}) AS o FROM ch "
        f"UNION ALL SELECT doc_id, chunk, unnest(regexp_extract_all(text, '{_COPULA}', 1)), replace(trim(unnest(regexp_extract_all(text, '{_COPULA}', 2)), {_BLANKS}), ' ', '_') FROM ch)",
    ),
)
def ingest_sources(spark, sf):
    return retrieval.ingest(G.table(spark, sf, "documents"))[3].withColumn("chunk", F.col("chunk").cast("long"))


_HYBRID = "SELECT s, p, o FROM loc WHERE s IN (SELECT id FROM seed) OR o IN (SELECT id FROM seed) OR s IN (SELECT id FROM one) OR o IN (SELECT id FROM one)"
_HYBRID_USING = (
    _TFIDF, "q AS (SELECT unnest(['where', 'is', 'nation_3']) AS term, 1 / 3::DOUBLE AS qtf), dn AS (SELECT doc_id, sqrt(sum(power(tf * idf, 2))) AS dn FROM ix GROUP BY 1)",
    "best AS (SELECT documents.doc_id, text, row_number() OVER (ORDER BY coalesce(s, 0) DESC, documents.doc_id) AS place FROM documents LEFT JOIN (SELECT doc_id, sum(tf * idf * qtf * idf) / max(dn) AS s FROM ix JOIN q USING (term) JOIN dn USING (doc_id) GROUP BY 1) x ON x.doc_id = documents.doc_id ORDER BY coalesce(s, 0) DESC, documents.doc_id LIMIT 2)",
    "play AS (SELECT term AS w FROM q UNION SELECT unnest(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) FROM best)",
    "loc AS (SELECT n_name AS s, 'located_in' AS p, 'region' || n_regionkey AS o FROM nation), seed AS (SELECT id FROM (SELECT s AS id FROM loc UNION SELECT o FROM loc) JOIN play ON play.w = lower(id))",
    "one AS (SELECT s AS id FROM loc WHERE o IN (SELECT id FROM seed) UNION SELECT o FROM loc WHERE s IN (SELECT id FROM seed))",
)


@query(_HYBRID, using=_HYBRID_USING)
def hybrid_retrieve(spark, sf):
    docs = G.table(spark, sf, "documents")
    names = G.table(spark, sf, "nation").select(F.col("n_name").alias("s"), F.lit("located_in").alias("p"), F.concat(F.lit("region"), F.col("n_regionkey").cast("string")).alias("o"))
    return retrieval.hybrid_retrieve(docs, names, "where is nation_3", 2, 2)[1]


_ANSWER = "'" + retrieval.CONTEXT.replace("{query}", "where is nation_3").replace("\n", "' || chr(10) || '").replace("{chunks}", "' || (SELECT string_agg('- ' || text, chr(10) ORDER BY place) FROM best) || '").replace("{facts}", "' || (SELECT string_agg('- (' || s || ') --[' || p || ']--> (' || o || ')', chr(10) ORDER BY s, p, o) FROM fact) || '") + "'"
_PLACE = "'" + retrieval.PLACE.replace("'", "''").replace("{s}", "' || s || '").replace("{p}", "' || p || '").replace("{o}", "' || o || '") + "'"
_CITED = "'" + retrieval.CITED.replace("'", "''").replace("{text}", "' || left(text, 80) || '") + "'"


@query(f"SELECT {_ANSWER} || chr(10) || (SELECT {_PLACE} FROM fact ORDER BY s, p, o LIMIT 1) || ' ' || (SELECT {_CITED} FROM best WHERE place = 1) AS answer", using=(*_HYBRID_USING, f"fact AS ({_HYBRID})"))
def grounded_answer(spark, sf):
    names = G.table(spark, sf, "nation").select(F.col("n_name").alias("s"), F.lit("located_in").alias("p"), F.concat(F.lit("region"), F.col("n_regionkey").cast("string")).alias("o"))
    return spark.createDataFrame([(retrieval.grounded_answer(G.table(spark, sf, "documents"), names, "where is nation_3"),)], "answer string")


@query("SELECT 'u' || user_id AS event, event_type AS concept, round(least(1, 0.5::DOUBLE + 0.2::DOUBLE * (count(*) - 1)), 6) AS strength FROM events GROUP BY 1, 2")
def memory_strength(spark, sf):
    e = G.table(spark, sf, "events").select(F.concat(F.lit("u"), "user_id").alias("event"), F.col("event_type").alias("concept"))
    return retrieval.memory_strengths(e).withColumn("strength", F.round("strength", 6))


@query("SELECT event, concept, round(s, 6) AS strength FROM (SELECT 'u' || user_id AS event, event_type AS concept, 0.15::DOUBLE * least(1, 0.5::DOUBLE + 0.2::DOUBLE * (count(*) - 1)) AS s FROM events GROUP BY 1, 2) WHERE s >= 0.1")
def memory_decay(spark, sf):
    e = G.table(spark, sf, "events").select(F.concat(F.lit("u"), "user_id").alias("event"), F.col("event_type").alias("concept"))
    return retrieval.decay(retrieval.memory_strengths(e), 0.15).withColumn("strength", F.round("strength", 6))


@query("SELECT 'u' || user_id AS event, round(least(1, 0.5::DOUBLE + 0.2::DOUBLE * (count(*) - 1)), 6) AS strength FROM events WHERE event_type = 'purchase' GROUP BY 1")
def memory_recall(spark, sf):
    e = G.table(spark, sf, "events").select(F.concat(F.lit("u"), "user_id").alias("event"), F.col("event_type").alias("concept"))
    return retrieval.recall(retrieval.memory_strengths(e), "purchase").withColumn("strength", F.round("strength", 6))


@query()
def temporal_memory(spark, sf):
    e = G.table(spark, sf, "events").select(F.concat(F.lit("u"), "user_id").alias("u"), F.col("event_type").alias("v"), F.array(F.coalesce("value", F.lit(0.0)) / 100).alias("feature"), "ts", "event_id")
    return incremental.temporal_memory(e, 4, 1)


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def task_plan(spark, sf):
    plan = retrieval.TaskPlan()
    plan.register("load", lambda _: G.table(spark, sf, "orders"))
    plan.register("count", lambda x: x["input_from_load"].groupBy("o_orderstatus").agg(F.count("*").alias("n")))
    plan.depend("load", "count")
    return plan.execute()["count"]


@query(
    """SELECT id, round(least(greatest(x + vx, 30), 770), 6) AS x, round(least(greatest(y + vy, 30), 570), 6) AS y, round(vx, 6) AS vx, round(vy, 6) AS vy FROM (
      SELECT b.id, b.x, b.y, 0.85::DOUBLE * sum(fx) AS vx, 0.85::DOUBLE * sum(fy) AS vy FROM bd b JOIN (
        SELECT id, 800 / power(d, 3) * dx AS fx, 800 / power(d, 3) * dy AS fy FROM (SELECT a.id, a.x - b.x AS dx, a.y - b.y AS dy, greatest(sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)), 1) AS d FROM bd a JOIN bd b ON a.id <> b.id)
        UNION ALL SELECT id, 0.04::DOUBLE * (d - 120) * dx / d, 0.04::DOUBLE * (d - 120) * dy / d FROM (SELECT a.id, b.x - a.x AS dx, b.y - a.y AS dy, greatest(sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)), 1) AS d FROM lk JOIN bd a ON a.id = lk.src JOIN bd b ON b.id = lk.dst)
        UNION ALL SELECT id, (400 - x) * 0.015::DOUBLE, (300 - y) * 0.015::DOUBLE FROM bd) f ON f.id = b.id GROUP BY b.id, b.x, b.y)""",
    using=(_TRADE, "bd AS (SELECT n_name AS id, n_nationkey % 5 * 100 + 100::DOUBLE AS x, n_nationkey // 5 * 80 + 100::DOUBLE AS y FROM nation), lk AS (SELECT src, dst FROM t5 UNION SELECT dst, src FROM t5)"),
)
def layout_step(spark, sf):
    g = G.trade5(spark, sf)
    bodies = g.nodes.select("id", (F.pmod("ord", F.lit(5)) * 100 + 100.0).alias("x"), ((F.col("ord") / 5).cast("int") * 80 + 100.0).alias("y"), F.lit(0.0).alias("vx"), F.lit(0.0).alias("vy"))
    return retrieval.layout_step(g, bodies).select("id", *[r6(F.col(c), c) for c in ("x", "y", "vx", "vy")])
