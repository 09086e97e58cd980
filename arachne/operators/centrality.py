"""Betweenness, eigenvector centrality and PageRank: loops of joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arachne.operators.graph import PropertyGraph
from arachne.plans.iterate import checkpoint, remove


def betweenness(g: PropertyGraph, normalization: str = "double", sources: DataFrame | None = None) -> DataFrame:
    """(id, betweenness): unweighted shortest paths through a node.

    sources (column id): only paths that begin there count, scaled by nodes over sources. The state has a row for each
    source and node, so a large graph needs a sample of sources; with all nodes, the default, the values are exact.
    Forward, all sources advance a level at a time and count paths; backward, dependencies are summed from the last
    level. normalization: "double" divides by (n - 1)(n - 2) and doubles an undirected graph's value, whose pairs count
    twice already; "standard" doesn't double; with two nodes or fewer the raw sums stay.
    """
    a = checkpoint(g.adjacency().where("src <> dst").select("src", "dst").distinct())
    begin = g.nodes.select("id") if sources is None else g.nodes.select("id").join(sources.select("id").distinct(), "id", "left_semi")
    level = checkpoint(begin.select(F.col("id").alias("s"), "id", F.lit(1.0).alias("paths")))
    levels, seen = [level], level.select("s", "id")
    while True:
        new = levels[-1].join(a, F.col("id") == F.col("src")).groupBy("s", F.col("dst").alias("id")).agg(F.sum("paths").alias("paths"))
        new = checkpoint(new.join(seen, ["s", "id"], "left_anti"))
        if new.isEmpty():
            break
        levels.append(new)
        seen = seen.unionByName(new.select("s", "id"))
    total = None
    below = levels[-1].withColumn("dep", F.lit(0.0))
    for upper in reversed(levels[:-1]):
        own = below if total is None else below
        total = own.select("s", "id", "dep") if total is None else total.unionByName(own.select("s", "id", "dep"))
        edges = a.join(below.select("s", F.col("id").alias("dst"), F.col("paths").alias("pw"), "dep"), "dst")
        back = edges.join(upper.select("s", F.col("id").alias("src"), F.col("paths").alias("pv")), ["s", "src"])
        deps = back.groupBy("s", F.col("src").alias("id")).agg(F.sum(F.expr("pv / pw * (1 + dep)")).alias("dep"))
        below = checkpoint(upper.join(deps, ["s", "id"], "left").na.fill(0.0, ["dep"]))
    n = g.num_nodes()
    share = n / max(1, level.count()) if sources is not None else 1.0
    factor = share if n <= 2 else (1.0 if g.directed or normalization == "standard" else 2.0) * share / ((n - 1) * (n - 2))
    sums = total.where("s <> id").groupBy("id").agg(F.sum("dep").alias("b")) if total is not None else None
    rows = g.nodes.select("id")
    rows = rows.join(sums, "id", "left") if sums is not None else rows.withColumn("b", F.lit(0.0))
    return rows.select("id", (F.coalesce("b", F.lit(0.0)) * factor).alias("betweenness"))


def eigenvector(g: PropertyGraph, max_iter: int = 100, tol: float = 1e-6, fixed_iters: int | None = None) -> DataFrame:
    """(id, x): power iteration on the weighted adjacency (out-edges) from a uniform start, L2-normed each round.

    Stops when the L2 change falls below tol, or after max_iter (fixed_iters: exactly so many rounds). A zero vector
    stays zero; on a bipartite graph the last iterate is returned.
    """
    a = checkpoint(g.adjacency().groupBy("src", "dst").agg(F.max("weight").alias("weight")))
    n = g.num_nodes()
    x = checkpoint(g.nodes.select("id", F.lit(1.0 / max(n, 1) ** 0.5 if n else 0.0).alias("x")))
    for _ in range(fixed_iters or max_iter):
        y = a.join(x, F.col("dst") == F.col("id")).groupBy(F.col("src").alias("i")).agg(F.sum(F.col("weight") * F.col("x")).alias("y"))
        y = checkpoint(x.join(y, F.col("id") == F.col("i"), "left").select("id", F.coalesce("y", F.lit(0.0)).alias("y"), F.col("x").alias("old")))
        norm = y.agg(F.sqrt(F.sum(F.col("y") * F.col("y")))).first()[0] or 0.0
        z = y.select("id", (F.col("y") / norm if norm > 0 else F.col("y")).alias("x"), "old")
        change = z.agg(F.sqrt(F.sum((F.col("x") - F.col("old")) ** 2))).first()[0] if fixed_iters is None else None
        x = z.select("id", "x")
        if norm == 0 or change is not None and change < tol:
            break
    return x


def pagerank(g: PropertyGraph, alpha: float = 0.85, max_iter: int = 100, tol: float = 1e-6, fixed_iters: int | None = None, every: int = 5) -> DataFrame:
    """(id, rank): unweighted; a node without out-edges gives its rank to all. Stops when the L1 change falls below tol.

    fixed_iters: exactly so many rounds, without asking for the change. Each round is one join: every node has a loop
    without weight, so that it is there even if nothing leads to it, and no plan holds the ranks twice. Lineage is cut
    every few rounds; with nodes without out-edges every round, as their ranks' sum is then asked for.
    """
    n = g.num_nodes()
    if not n:
        return g.nodes.select("id", F.lit(0.0).alias("rank"))
    a = g.adjacency().select("src", "dst").distinct()
    out = a.groupBy("src").agg(F.count("*").alias("out"))
    step = checkpoint(a.join(out, "src").select("src", "dst", (1 / F.col("out")).alias("w")).union(g.nodes.select("id", "id", F.lit(0.0))))
    sinks = checkpoint(g.nodes.select("id").join(out, F.col("id") == F.col("src"), "left_anti"))
    has_sinks = not sinks.isEmpty()
    last = x = checkpoint(g.nodes.select("id", F.lit(1.0 / n).alias("rank")))
    for k in range(1, (fixed_iters or max_iter) + 1):
        lost = (x.join(sinks, "id", "left_semi").agg(F.sum("rank")).first()[0] or 0.0) if has_sinks else 0.0
        got = step.join(x, F.col("src") == F.col("id")).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("w") * F.col("rank")).alias("got"))
        new = got.select("id", (F.lit((1 - alpha) / n + alpha * lost / n) + alpha * F.col("got")).alias("rank"))
        if fixed_iters is None:
            new = checkpoint(new)
            change = new.join(x.withColumnRenamed("rank", "old"), "id").agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0]
            remove(x)
            x = new
            if change < tol:
                break
        else:
            x = new
            if has_sinks or k % every == 0 or k == fixed_iters:
                last = x = checkpoint(x, last)
    return x
