"""Degrees, density, clustering, hop distances, closeness and related measures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arachne.operators.graph import PropertyGraph
from arachne.plans.iterate import checkpoint


def degree(g: PropertyGraph) -> DataFrame:
    """(id, in_degree, out_degree): neighbours, weights aside; equal for an undirected graph."""
    end = lambda c, i, o: F.struct(F.col(c).alias("id"), F.lit(i).alias("i"), F.lit(o).alias("o"))
    ends = F.array(end("src", 0, 1), end("dst", 1, 0))
    if not g.directed:  # a loop counts once
        ends = F.when(F.col("src") == F.col("dst"), F.array(end("src", 1, 1))).otherwise(F.array(end("src", 1, 1), end("dst", 1, 1)))
    rows = g.edges.select(F.explode(ends).alias("e")).select("e.*").union(g.nodes.select("id", F.lit(0), F.lit(0)))
    return rows.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def degree_of(g: PropertyGraph, node: str) -> tuple[int, int] | int:
    row = degree(g).where(F.col("id") == node).first()
    if row is None:
        raise ValueError(f"no node {node!r}")
    return (row.in_degree, row.out_degree) if g.directed else row.out_degree


def density(g: PropertyGraph) -> DataFrame:
    """(n_nodes, n_edges, density): edges over possible edges; 0 with fewer than two nodes."""
    n = g.nodes.agg(F.count("*").alias("n_nodes"))
    e = g.adjacency().agg(F.count("*").alias("entries"))
    both = n.join(e, F.lit(True)).select("n_nodes", (F.col("entries") if g.directed else F.expr("entries div 2")).alias("n_edges"))
    k = 1 if g.directed else 2
    return both.select("n_nodes", "n_edges", F.expr(f"if(n_nodes > 1, {k} * n_edges / (n_nodes * (n_nodes - 1D)), 0D)").alias("density"))


def local_clustering(g: PropertyGraph) -> DataFrame:
    """(id, clustering): links among a node's neighbours over possible ones; 0 with fewer than two neighbours.

    Neighbours are taken both ways and leave the node out; a neighbour's own loop counts as a link. Edges point from the
    end with fewer neighbours to the other, and triangles are found from their smallest corner, so that a hub isn't the
    middle of pairs of all its neighbours.
    """
    a = checkpoint(g.adjacency().select("src", "dst"))
    both = a.where("src <> dst").groupBy(F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y")).agg(F.count("*").alias("c"))
    both = checkpoint(both)  # c: links between x and y, either way
    size = checkpoint(both.select(F.explode(F.array("x", "y")).alias("id")).groupBy("id").agg(F.count("*").cast("double").alias("k")))
    rank = lambda n: size.select(F.col("id").alias(n), F.struct("k", "id").alias(f"r{n}"))
    ranked = both.join(rank("x"), "x").join(rank("y"), "y")
    up = checkpoint(ranked.select(F.when(F.col("rx") < F.col("ry"), F.struct(F.col("x").alias("a"), F.col("y").alias("b"), F.col("ry").alias("r"), "c")).otherwise(F.struct(F.col("y").alias("a"), F.col("x").alias("b"), F.col("rx").alias("r"), "c")).alias("e")).select("e.*"), both)
    wedge = up.toDF("p", "q", "rq", "pq").join(up.toDF("p", "s", "rs", "ps"), "p").where("rq < rs")
    triangle = wedge.join(up.select(F.col("a").alias("q"), F.col("b").alias("s"), F.col("c").alias("qs")), ["q", "s"])
    corners = triangle.select(F.explode(F.array(*[F.struct(F.col(n).alias("id"), F.col(c).alias("links")) for n, c in (("p", "qs"), ("q", "ps"), ("s", "pq"))])).alias("t")).select("t.*")
    loops = up.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("u")), F.struct(F.col("b").alias("id"), F.col("a").alias("u")))).alias("n")).select("n.*")
    loops = loops.join(a.where("src = dst").select(F.col("src").alias("u"), F.lit(1).cast("long").alias("links")), "u").select("id", "links")
    closed = corners.union(loops).groupBy("id").agg(F.sum("links").alias("links"))
    rows = g.nodes.select("id").join(size, "id", "left").join(closed, "id", "left")
    return rows.select("id", F.expr("if(k > 1, coalesce(links, 0) / (k * (k - 1)), 0D)").alias("clustering")).na.fill(0.0)


def global_clustering(g: PropertyGraph) -> DataFrame:
    """(clustering): mean of the local values; 0 for an empty graph."""
    return local_clustering(g).agg(F.coalesce(F.avg("clustering"), F.lit(0.0)).alias("clustering"))


def hops(g: PropertyGraph, sources: DataFrame | None = None, max_rounds: int | None = None) -> DataFrame:
    """(source, id, hops) of all nodes that each source (column id; all nodes if None) reaches by out-edges.

    All sources advance together: each round joins the frontier with the edges and drops what was seen.
    """
    a = checkpoint(g.adjacency().select("src", "dst").distinct())
    ids = sources if sources is not None else g.nodes
    seen = frontier = checkpoint(ids.select(F.col("id").alias("source"), "id", F.lit(0).cast("long").alias("hops")))
    level = 0
    while max_rounds is None or level < max_rounds:
        level += 1
        new = frontier.join(a, frontier.id == a.src).select("source", F.col("dst").alias("id")).distinct()
        frontier = checkpoint(new.join(seen, ["source", "id"], "left_anti").withColumn("hops", F.lit(level).cast("long")))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if level % 5 == 0:
            seen = checkpoint(seen)
    return seen


def bfs_distances(g: PropertyGraph, start: str) -> DataFrame:
    """(id, hops): infinite where start doesn't reach."""
    reached = hops(g, g.nodes.where(F.col("id") == start))
    return g.nodes.select("id").join(reached.select("id", F.col("hops").cast("double")), "id", "left").na.fill(float("inf"), ["hops"])


def eccentricity(g: PropertyGraph, distances: DataFrame | None = None) -> DataFrame:
    """(id, eccentricity): largest distance to another node that is reached; 0 if there is none."""
    d = distances if distances is not None else hops(g)
    far = d.where("source <> id").groupBy(F.col("source").alias("id")).agg(F.max("hops").cast("double").alias("eccentricity"))
    return g.nodes.select("id").join(far, "id", "left").na.fill(0.0)


def radius_diameter(g: PropertyGraph) -> DataFrame:
    return eccentricity(g).agg(F.min("eccentricity").alias("radius"), F.max("eccentricity").alias("diameter"))


def degree_centrality(g: PropertyGraph) -> DataFrame:
    """(id, centrality): in- plus out-degree (undirected: degree) over n - 1."""
    n = g.nodes.agg((F.greatest(F.count("*") - 1, F.lit(1))).cast("double").alias("n1"))
    both = F.col("in_degree") + F.col("out_degree") if g.directed else F.col("out_degree")
    return degree(g).join(F.broadcast(n)).select("id", (both / F.col("n1")).alias("centrality"))


def closeness(g: PropertyGraph, distances: DataFrame | None = None) -> DataFrame:
    """(id, closeness): (r / sum of distances) * (r / (n - 1)) over the r nodes that out-edges reach; 0 if none."""
    d = distances if distances is not None else hops(g)
    n = g.nodes.agg((F.count("*") - 1).cast("double").alias("n1"))
    sums = d.where("source <> id").groupBy(F.col("source").alias("id")).agg(F.count("*").alias("r"), F.sum("hops").alias("s"))
    rows = g.nodes.select("id").join(sums, "id", "left").join(F.broadcast(n))
    return rows.select("id", F.expr("if(r > 0, (r / s) * (r / n1), 0D)").alias("closeness")).na.fill(0.0)
