"""Traversal orders and shortest paths."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arachne.operators.components import connected
from arachne.operators.graph import PropertyGraph
from arachne.plans.iterate import bounded, checkpoint

#: Edges of the component that a depth-first walk holds.
MAX_EDGES = 10_000_000


def bfs_order(g: PropertyGraph, start: str) -> DataFrame:
    """(id, level, rank): level order; within a level by the parent's rank, then by the order of its edges."""
    a = checkpoint(g.adjacency().select("src", "dst", "ord"))
    seen = frontier = checkpoint(g.nodes.where(F.col("id") == start).select("id", F.lit(0).alias("level"), F.lit(0).cast("long").alias("rank")))
    level, used = 0, 1
    while True:
        level += 1
        new = frontier.join(a, F.col("id") == F.col("src")).groupBy(F.col("dst").alias("id")).agg(F.min(F.struct("rank", "ord")).alias("k"))
        new = new.join(seen, "id", "left_anti")
        new = checkpoint(new.select("id", F.lit(level).alias("level"), (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("k")) + (used - 1)).cast("long").alias("rank")))
        size = new.count()
        if not size:
            return seen
        used += size
        seen, frontier = seen.unionByName(new), new


def dfs_preorder(g: PropertyGraph, start: str) -> DataFrame:
    """(id, rank): depth-first preorder, neighbours in order of insertion. Sequential by nature: the start's component in one task, of at most MAX_EDGES edges."""
    part = connected(g)
    own = part.where(F.col("id") == start).select("component")
    members = part.join(F.broadcast(own), "component", "left_semi").select("id")
    a = g.adjacency().join(members.withColumnRenamed("id", "src"), "src", "left_semi").select("src", "dst", "ord")

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict[str, list[str]] = {}
        for s, d in pdf.sort_values("ord")[["src", "dst"]].itertuples(index=False):
            near.setdefault(s, []).append(d)
        seen, stack = {}, [start]
        while stack:
            x = stack.pop()
            if x not in seen:
                seen[x] = len(seen)
                stack += [y for y in reversed(near.get(x, ())) if y not in seen]
        return pd.DataFrame({"id": list(seen), "rank": list(seen.values())})

    rows = a.union(g.nodes.where(F.col("id") == start).select("id", "id", F.lit(-1).cast("long")))
    return bounded(rows, MAX_EDGES).groupBy(F.lit(0).alias("_g")).applyInPandas(walk, "id string, rank long")


def shortest(g: PropertyGraph, sources: DataFrame, rounds: int | None = None) -> tuple[DataFrame, bool]:
    """(source, id, dist, pred) of what each source (column id) reaches, and whether the last allowed round still improved.

    Each round relaxes the edges of the nodes that improved; pred is the smallest id among the best. rounds: n - 1 by
    default, so a True says that a negative cycle is reached.
    """
    a = checkpoint(g.adjacency().groupBy("src", "dst").agg(F.min("weight").alias("w")))
    limit = rounds if rounds is not None else max(g.num_nodes() - 1, 0)
    best = checkpoint(sources.select(F.col("id").alias("source"), "id", F.lit(0.0).alias("dist"), F.lit(None).cast("string").alias("pred")))
    live = best
    for k in range(limit + 1):
        offers = live.join(a, F.col("id") == F.col("src")).groupBy("source", F.col("dst").alias("id")).agg(F.min(F.struct((F.col("dist") + F.col("w")).alias("d"), F.col("src").alias("p"))).alias("o"))
        both = best.join(offers, ["source", "id"], "full")
        better = F.col("o").isNotNull() & (F.col("dist").isNull() | (F.col("o.d") < F.col("dist")))
        both = checkpoint(both.select("source", "id", F.when(better, F.col("o.d")).otherwise(F.col("dist")).alias("dist"), F.when(better, F.col("o.p")).otherwise(F.col("pred")).alias("pred"), better.alias("new")))
        live = both.where("new").select("source", "id", "dist", "pred")
        if live.isEmpty():
            return best, False
        if k == limit:
            return best, True
        best = both.drop("new")
    return best, False


def dijkstra(g: PropertyGraph, start: str) -> DataFrame:
    """(id, dist, pred) of all nodes, for weights that aren't negative; infinite and null where start doesn't reach."""
    found, _ = shortest(g, g.nodes.where(F.col("id") == start))
    return g.nodes.select("id").join(found.drop("source"), "id", "left").na.fill(float("inf"), ["dist"])


def shortest_path(g: PropertyGraph, start: str, target: str) -> tuple[list[str], float]:
    """The path and its length; ([], inf) if there is none. The path is walked back a join at a time."""
    found, _ = shortest(g, g.nodes.where(F.col("id") == start))
    row = found.where(F.col("id") == target).first()
    if row is None:
        return [], float("inf")
    path, length = [target], row.dist
    while row is not None and row.pred is not None:
        path.append(row.pred)
        row = found.where(F.col("id") == row.pred).first()
    return path[::-1], length


def bellman_ford(g: PropertyGraph, start: str) -> tuple[DataFrame, bool]:
    """((id, dist, pred), whether a negative cycle is reached). An undirected graph is relaxed both ways."""
    found, negative = shortest(g, g.nodes.where(F.col("id") == start))
    return g.nodes.select("id").join(found.drop("source"), "id", "left").na.fill(float("inf"), ["dist"]), negative


def all_pairs(g: PropertyGraph) -> DataFrame:
    """(src, dst, dist) of the pairs that a path joins, by min-plus squaring; 0 from a node to itself."""
    d = g.adjacency().select("src", "dst", F.col("weight").alias("dist")).union(g.nodes.select("id", F.col("id"), F.lit(0.0)))
    d = checkpoint(d.groupBy("src", "dst").agg(F.min("dist").alias("dist")))
    reach, n = 1, g.num_nodes()
    while reach < n - 1:
        two = d.join(d.select(F.col("src").alias("dst"), F.col("dst").alias("z"), F.col("dist").alias("more")), "dst")
        new = checkpoint(two.groupBy("src", F.col("z").alias("dst")).agg(F.min(F.col("dist") + F.col("more")).alias("dist")))
        same = new.count() == d.count() and new.join(d.withColumnRenamed("dist", "old"), ["src", "dst"]).where("dist < old").isEmpty()
        d, reach = new, reach * 2
        if same:
            break
    return d


def a_star(g: PropertyGraph, start: str, goal: str, heuristic: Column) -> tuple[list[str], float]:
    """Path and cost under a consistent heuristic, a column over id; a node whose cost plus heuristic exceeds the best known goal cost goes no further."""
    a = checkpoint(g.adjacency().groupBy("src", "dst").agg(F.min("weight").alias("w")))
    best = checkpoint(g.nodes.where(F.col("id") == start).select("id", F.lit(0.0).alias("dist"), F.lit(None).cast("string").alias("pred")))
    live, bound = best, float("inf")
    while not live.isEmpty():
        offers = live.where(F.col("dist") + heuristic <= bound).join(a, F.col("id") == F.col("src")).groupBy(F.col("dst").alias("id")).agg(F.min(F.struct((F.col("dist") + F.col("w")).alias("d"), F.col("src").alias("p"))).alias("o"))
        both = best.join(offers, "id", "full")
        better = F.col("o").isNotNull() & (F.col("dist").isNull() | (F.col("o.d") < F.col("dist")))
        both = checkpoint(both.select("id", F.when(better, F.col("o.d")).otherwise(F.col("dist")).alias("dist"), F.when(better, F.col("o.p")).otherwise(F.col("pred")).alias("pred"), better.alias("new")))
        best, live = both.drop("new"), both.where("new").drop("new")
        at_goal = best.where(F.col("id") == goal).first()
        bound = at_goal.dist if at_goal else bound
    if bound == float("inf"):
        return [], bound
    path, row = [goal], best.where(F.col("id") == goal).first()
    while row is not None and row.pred is not None:
        path.append(row.pred)
        row = best.where(F.col("id") == row.pred).first()
    return path[::-1], bound


def johnson(g: PropertyGraph) -> DataFrame | None:
    """(src, dst, dist) of all pairs that a path joins, also with negative weights; None if there is a negative cycle.

    Potentials come from a virtual source that reaches every node at 0; the reweighted edges aren't negative.
    """
    a = checkpoint(g.adjacency().groupBy("src", "dst").agg(F.min("weight").alias("w")))
    h = checkpoint(g.nodes.select("id", F.lit(0.0).alias("h")))
    for k in range(g.num_nodes() + 1):
        offers = a.join(h, F.col("src") == F.col("id")).groupBy(F.col("dst").alias("id")).agg(F.min(F.col("h") + F.col("w")).alias("o"))
        new = checkpoint(h.join(offers, "id", "left").select("id", F.least("h", F.coalesce("o", "h")).alias("h"), (F.coalesce("o", "h") < F.col("h")).alias("moved")))
        moved = not new.where("moved").isEmpty()
        h = new.select("id", "h")
        if not moved:
            break
        if k == g.num_nodes():
            return None
    p = h.select(F.col("id").alias("src"), F.col("h").alias("hs")), h.select(F.col("id").alias("dst"), F.col("h").alias("hd"))
    e = a.join(p[0], "src").join(p[1], "dst").select("src", "dst", F.greatest(F.col("w") + F.col("hs") - F.col("hd"), F.lit(0.0)).alias("weight"))
    plain = PropertyGraph.from_edges(e, True, g.nodes)
    found, _ = shortest(plain, g.nodes)
    out = found.select(F.col("source").alias("src"), F.col("id").alias("dst"), "dist").join(p[0], "src").join(p[1], "dst")
    return out.select("src", "dst", (F.col("dist") - F.col("hs") + F.col("hd")).alias("dist"))
