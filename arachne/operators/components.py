"""Connected and strongly connected components, orders of directed acyclic graphs, spanning forests, colouring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arachne.operators.graph import PropertyGraph
from arachne.plans.iterate import checkpoint


def labels(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, component): the smallest id that the undirected pairs (src, dst) join to each id of nodes.

    Rounds of the smallest neighbouring label followed by a jump to the label's label, so long chains take few rounds.
    """
    pairs = checkpoint(pairs.select("src", "dst").union(pairs.select("dst", "src")).where("src <> dst").distinct())
    x = checkpoint(nodes.select("id", F.col("id").alias("component")))
    while True:
        near = pairs.join(x.select(F.col("id").alias("dst"), "component"), "dst").groupBy("src").agg(F.min("component").alias("m"))
        low = x.join(near, F.col("id") == F.col("src"), "left").select("id", "component", F.least("component", F.coalesce("m", "component")).alias("l"))
        low = checkpoint(low)
        jump = low.join(low.select(F.col("id").alias("k"), F.col("l").alias("ll")), F.col("l") == F.col("k"), "left")
        new = checkpoint(jump.select("id", F.least("l", F.coalesce("ll", "l")).alias("component"), F.col("component").alias("old")))
        moved = not new.where("component <> old").isEmpty()
        x = new.select("id", "component")
        if not moved:
            return x


def connected(g: PropertyGraph) -> DataFrame:
    """(id, component): weakly connected components, named by their smallest id."""
    return labels(g.nodes, g.edges)


def strongly_connected(g: PropertyGraph) -> DataFrame:
    """(id, component): strongly connected components, named by their smallest id.

    Rounds over what is left: the largest id that reaches each node colours it; the nodes of a colour that also reach
    the colour's id backwards are a component, and go. Nodes without edges in or out go first, each for itself.
    """
    left = checkpoint(g.nodes.select("id"))
    edges = checkpoint(g.adjacency().select("src", "dst").where("src <> dst").distinct())
    done = None
    while not left.isEmpty():
        while True:  # trimming
            keep = left.join(edges.select(F.col("src").alias("id")).distinct(), "id", "left_semi").join(edges.select(F.col("dst").alias("id")).distinct(), "id", "left_semi")
            gone = checkpoint(left.join(keep, "id", "left_anti").select("id", F.col("id").alias("component")))
            if gone.isEmpty():
                break
            done = gone if done is None else done.union(gone)
            left = checkpoint(left.join(gone, "id", "left_anti"))
            edges = checkpoint(edges.join(left.toDF("src"), "src", "left_semi").join(left.toDF("dst"), "dst", "left_semi"))
        if left.isEmpty():
            break
        colour = checkpoint(left.select("id", F.col("id").alias("c")))
        while True:
            got = edges.join(colour, F.col("src") == F.col("id")).groupBy("dst").agg(F.max("c").alias("m"))
            new = checkpoint(colour.join(got, F.col("id") == F.col("dst"), "left").select("id", F.greatest("c", F.coalesce("m", "c")).alias("c"), (F.coalesce("m", "c") > F.col("c")).alias("moved")))
            colour = new.select("id", "c")
            if new.where("moved").isEmpty():
                break
        inside = checkpoint(edges.join(colour.toDF("src", "c"), "src").join(colour.toDF("dst", "c2"), "dst").where("c = c2").select("src", "dst", "c"))
        back = front = checkpoint(colour.where("id = c"))
        while True:
            new = inside.join(front.select(F.col("id").alias("dst")), "dst").select(F.col("src").alias("id"), "c").distinct()
            front = checkpoint(new.join(back, "id", "left_anti"))
            if front.isEmpty():
                break
            back = checkpoint(back.union(front))
        name = back.groupBy("c").agg(F.min("id").alias("component"))
        found = checkpoint(back.join(name, "c").select("id", "component"))
        done = found if done is None else done.union(found)
        left = checkpoint(left.join(found, "id", "left_anti"))
        edges = checkpoint(edges.join(left.toDF("src"), "src", "left_semi").join(left.toDF("dst"), "dst", "left_semi"))
    return done if done is not None else g.nodes.select("id", F.col("id").alias("component"))


def condensation(g: PropertyGraph) -> DataFrame:
    """(id, component, level): strongly connected components, and their topological level: each edge between two of them goes to a higher one."""
    parts = checkpoint(strongly_connected(g))
    ends = g.adjacency().select("src", "dst").distinct().join(parts.toDF("src", "a"), "src").join(parts.toDF("dst", "b"), "dst")
    between = ends.where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()
    levels = topological_levels(PropertyGraph.from_edges(between, True, parts.select(F.col("component").alias("id")).distinct()))
    return parts.join(levels.toDF("component", "level"), "component").select("id", "component", "level")


def topological_levels(g: PropertyGraph, strict: bool = True) -> DataFrame:
    """(id, level): 0 without in-edges, else one more than the highest source. Raises ValueError on a cycle; not strict: leaves its nodes out."""
    if not g.directed:
        raise ValueError("a topological order needs a directed graph")
    edges = checkpoint(g.adjacency().select("src", "dst").distinct())
    left, done, level = checkpoint(g.nodes.select("id")), None, 0
    while not left.isEmpty():
        free = checkpoint(left.join(edges.select(F.col("dst").alias("id")).distinct(), "id", "left_anti").withColumn("level", F.lit(level)))
        if free.isEmpty():
            if strict:
                raise ValueError("the graph has a cycle")
            break
        done = free if done is None else done.union(free)
        left = checkpoint(left.join(free, "id", "left_anti"))
        edges = checkpoint(edges.join(free.select(F.col("id").alias("src")), "src", "left_anti"))
        level += 1
    return done if done is not None else g.nodes.select("id", F.lit(0).alias("level")).limit(0)


def has_cycle(g: PropertyGraph) -> bool:
    if g.directed:
        return topological_levels(g, strict=False).count() < g.num_nodes()
    return g.edges.count() > g.num_nodes() - connected(g).select("component").distinct().count()


def spanning_forest(g: PropertyGraph, start: str | None = None) -> DataFrame:
    """(src, dst, weight) of the minimum spanning forest; with start, only of its component.

    Boruvka rounds: each component takes its cheapest edge outward and merges. The order (weight, ord) is total, so the
    forest is unique, and is what Kruskal's or Prim's method finds.
    """
    e = checkpoint(g.edges.where("src <> dst").select("src", "dst", "weight", "ord"))
    x, picked = checkpoint(g.nodes.select("id", F.col("id").alias("c"))), None
    while True:
        cross = e.join(x.toDF("src", "a"), "src").join(x.toDF("dst", "b"), "dst").where("a <> b")
        both = cross.select(F.explode(F.array("a", "b")).alias("c"), F.struct("weight", "ord", "src", "dst").alias("k"))
        best = checkpoint(both.groupBy("c").agg(F.min("k").alias("k")).select("k.src", "k.dst", "k.weight", "k.ord").distinct())
        if best.isEmpty():
            break
        picked = best if picked is None else picked.union(best)
        merged = best.join(x.toDF("src", "a"), "src").join(x.toDF("dst", "b"), "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"))
        names = labels(x.select(F.col("c").alias("id")).distinct(), merged)
        x = checkpoint(x.join(names.toDF("c", "n"), "c").select("id", F.col("n").alias("c")))
    if picked is None:
        return e.select("src", "dst", "weight").limit(0)
    if start is not None:
        own = x.where(F.col("id") == start).select("c")
        picked = picked.join(x.join(own, "c", "left_semi").select(F.col("id").alias("src")), "src", "left_semi")
    return picked.select("src", "dst", "weight")


def colouring(g: PropertyGraph, by_degree: bool = False) -> DataFrame:
    """(id, colour): the smallest colour free among neighbours, taken in order of insertion, or of degree first if by_degree.

    In waves: every node that comes before all its uncoloured neighbours takes its colour at once, which gives what one
    node at a time gives. Neighbours count both ways.
    """
    near = checkpoint(g.both_ways().where("src <> dst"))
    order = g.nodes.select("id", "ord")
    if by_degree:
        deg = near.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("d"))
        order = order.join(deg, "id", "left").select("id", F.struct((-F.coalesce("d", F.lit(0))).alias("d"), "ord", "id").alias("k"))
    else:
        order = order.select("id", F.struct("ord", "id").alias("k"))
    left, done = checkpoint(order), None
    while not left.isEmpty():
        rivals = near.join(left.toDF("dst", "rk"), "dst").groupBy("src").agg(F.min("rk").alias("rk"))
        wave = checkpoint(left.join(rivals, F.col("id") == F.col("src"), "left").where("rk is null or k < rk").select("id"))
        if done is None:
            new = wave.select("id", F.lit(0).alias("colour"))
        else:
            used = near.join(done.toDF("dst", "colour"), "dst").groupBy("src").agg(F.collect_set("colour").alias("used"))
            free = F.expr("coalesce(array_min(array_except(sequence(0, size(used)), used)), 0)")
            new = wave.join(used, F.col("id") == F.col("src"), "left").select("id", F.coalesce(free, F.lit(0)).alias("colour"))
        done = checkpoint(new if done is None else done.union(new))
        left = checkpoint(left.join(wave, "id", "left_anti"))
    return done if done is not None else g.nodes.select("id", F.lit(0).alias("colour"))
