"""Maximum bipartite matching and maximum flow. Matching begins with distributed greedy rounds; augmenting searches, sequential by nature, run in one task for each component that still needs them."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arachne.operators.components import connected
from arachne.operators.graph import PropertyGraph
from arachne.plans.iterate import bounded, checkpoint

#: Edges up to which one component is solved in a task.
MAX_EDGES = 2_000_000


def greedy_matching(edges: DataFrame) -> DataFrame:
    """(left, right): a matching of the edges (src, dst) to which no edge can be added, in rounds: each free src asks one free dst, and each dst takes one that asks."""
    left, found, k = checkpoint(edges.select("src", "dst").distinct()), None, 0
    while not left.isEmpty():
        # Another hash order each round, so that few ask the same one again.
        asked = left.groupBy("src").agg(F.min_by("dst", F.xxhash64("src", "dst", F.lit(k))).alias("dst"))
        new = checkpoint(asked.groupBy("dst").agg(F.min("src").alias("src")).select(F.col("src").alias("left"), F.col("dst").alias("right")))
        found = new if found is None else found.union(new)
        left = checkpoint(left.join(new.select(F.col("left").alias("src")), "src", "left_anti").join(new.select(F.col("right").alias("dst")), "dst", "left_anti"), left)
        k += 1
    return found if found is not None else edges.select(F.col("src").alias("left"), F.col("dst").alias("right")).limit(0)


def bipartite_matching(g: PropertyGraph, left: DataFrame) -> DataFrame:
    """(left, right): a maximum matching of the nodes in left (column id) with the others.

    A greedy matching comes first. It is a maximum already if it uses up all linked nodes of one side. Else components
    with free nodes on both sides are augmented, each in one task, side by side.
    """
    e = checkpoint(g.both_ways().join(left.select(F.col("id").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("id").alias("dst")).distinct(), "dst", "left_anti"))
    greedy = checkpoint(greedy_matching(e))
    pairs = greedy.count()
    if pairs in (e.select("src").distinct().count(), e.select("dst").distinct().count()):
        return greedy
    part = checkpoint(connected(PropertyGraph.from_edges(e, False)))
    held = checkpoint(greedy.join(part.withColumnRenamed("id", "left"), "left"))
    sides = e.select(F.col("src").alias("id"), F.lit(1).alias("l"), F.lit(0).alias("r")).union(e.select("dst", F.lit(0), F.lit(1))).distinct()
    counts = sides.join(part, "id").groupBy("component").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    open_ = checkpoint(counts.join(held.groupBy("component").agg(F.count("*").alias("k")), "component", "left").where("l > coalesce(k, 0) and r > coalesce(k, 0)").select("component"))
    rows = bounded(e.join(part.withColumnRenamed("id", "src"), "src").join(open_, "component", "left_semi"), MAX_EDGES, "component")
    rows = rows.join(held.select(F.col("left").alias("src"), F.col("right").alias("dst"), F.lit(True).alias("held")), ["src", "dst"], "left")

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        near = {k: sorted(v) for k, v in pdf.groupby("src")["dst"]}
        kept = pdf[pdf["held"].notna()]
        mine: dict[str, str] = dict(zip(kept["src"], kept["dst"], strict=True))
        yours: dict[str, str] = dict(zip(kept["dst"], kept["src"], strict=True))
        while True:
            level = {u: 0 for u in near if u not in mine}
            queue, free = deque(level), False
            while queue:
                u = queue.popleft()
                for v in near[u]:
                    w = yours.get(v)
                    if w is None:
                        free = True
                    elif w not in level:
                        level[w] = level[u] + 1
                        queue.append(w)
            if not free:
                break
            at = dict.fromkeys(near, 0)
            for root in [u for u in near if u not in mine]:
                path = [root]
                while path:
                    u = path[-1]
                    if at[u] == len(near[u]):
                        level[u] = -1
                        path.pop()
                        continue
                    v = near[u][at[u]]
                    at[u] += 1
                    w = yours.get(v)
                    if w is None:
                        while path:  # flips the pairs along the path
                            u = path.pop()
                            v, mine[u] = mine.get(u), v
                            yours[mine[u]] = u
                        break
                    if level.get(w) == level[u] + 1:
                        path.append(w)
        return pd.DataFrame({"left": list(mine), "right": list(mine.values())})

    done = held.join(open_, "component", "left_anti").select("left", "right")
    return done.union(rows.groupBy("component").applyInPandas(match, "left string, right string"))


class _Residual:
    def __init__(self, rows):
        self.near: dict[str, dict[str, float]] = {}
        for s, d, c in rows:
            self.near.setdefault(s, {})
            self.near.setdefault(d, {})
            self.near[s][d] = self.near[s].get(d, 0.0) + c
            self.near[d].setdefault(s, 0.0)

    def levels(self, source: str) -> dict[str, int]:
        level, queue = {source: 0}, deque([source])
        while queue:
            u = queue.popleft()
            for v, c in self.near.get(u, {}).items():
                if c > 1e-12 and v not in level:
                    level[v] = level[u] + 1
                    queue.append(v)
        return level

    def push(self, path: list[str]) -> float:
        amount = min(self.near[a][b] for a, b in zip(path, path[1:], strict=False))
        for a, b in zip(path, path[1:], strict=False):
            self.near[a][b] -= amount
            self.near[b][a] += amount
        return amount


def _blocking(r: _Residual, source: str, sink: str) -> float:
    """Phases of level graphs with current arcs, until the sink is out of reach."""
    total = 0.0
    while sink in (level := r.levels(source)):
        arcs = {u: list(vs) for u, vs in r.near.items()}
        path = [source]
        while path:
            u = path[-1]
            if u == sink:
                total += r.push(path)
                path = [source]
                continue
            while arcs[u] and not (r.near[u][arcs[u][-1]] > 1e-12 and level.get(arcs[u][-1]) == level[u] + 1):
                arcs[u].pop()
            if arcs[u]:
                path.append(arcs[u][-1])
            else:
                path.pop()
                if path:
                    arcs[path[-1]].pop()
    return total


def _shortest_first(r: _Residual, source: str, sink: str) -> float:
    """One shortest augmenting path at a time."""
    total = 0.0
    while True:
        before, queue = {source: source}, deque([source])
        while queue and sink not in before:
            u = queue.popleft()
            for v, c in r.near.get(u, {}).items():
                if c > 1e-12 and v not in before:
                    before[v] = u
                    queue.append(v)
        if sink not in before:
            return total
        path = [sink]
        while path[-1] != source:
            path.append(before[path[-1]])
        total += r.push(path[::-1])


def max_flow(g: PropertyGraph, source: str, sink: str, method: str = "dinic") -> DataFrame:
    """(src, dst, flow, in_cut, value): each capacity with its flow, whether it crosses the minimum cut, and the flow's value.

    Capacity is the weight, both ways if undirected. method: "dinic" or "edmonds_karp". Raises ValueError if source and
    sink are one node.
    """
    if source == sink:
        raise ValueError("source and sink are the same node")
    solve = {"dinic": _blocking, "edmonds_karp": _shortest_first}[method]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r = _Residual(pdf[["src", "dst", "weight"]].itertuples(index=False))
        cap = {u: dict(vs) for u, vs in r.near.items()}
        value = solve(r, source, sink) if source in cap and sink in cap else 0.0
        side = set(r.levels(source))
        rows = [(u, v, max(0.0, c - r.near[u][v]), u in side and v not in side, value) for u, vs in cap.items() for v, c in vs.items() if c > 0]
        return pd.DataFrame(rows, columns=["src", "dst", "flow", "in_cut", "value"])

    return bounded(g.adjacency().where("src <> dst"), MAX_EDGES).groupBy(F.lit(0).alias("_g")).applyInPandas(run, "src string, dst string, flow double, in_cut boolean, value double")
