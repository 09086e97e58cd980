"""Property graphs as two DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NODES = "id string, type string, props map<string,string>, ord long"
EDGES = "src string, dst string, weight double, type string, props map<string,string>, ord long"


def _key(directed: bool) -> list[Column]:
    if directed:
        return [F.col("src").alias("_a"), F.col("dst").alias("_b")]
    return [F.least("src", "dst").alias("_a"), F.greatest("src", "dst").alias("_b")]


def _filled(df: DataFrame, schema: str, defaults: dict[str, Column]) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    return df.select(*[(F.col(n) if n in df.columns else defaults[n]).alias(n) for n in names])


@dataclass(frozen=True)
class PropertyGraph:
    """nodes (id, type, props, ord) and canonical edges (src, dst, weight, type, props, ord), one row an edge.

    ord is the order of first insertion, which ties and matrices follow. An undirected edge has the orientation in
    which it was first inserted.
    """

    nodes: DataFrame
    edges: DataFrame
    directed: bool = False

    @staticmethod
    def empty(spark: SparkSession, directed: bool = False) -> PropertyGraph:
        return PropertyGraph(spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES), directed)

    @staticmethod
    def from_edges(edges: DataFrame, directed: bool = False, nodes: DataFrame | None = None) -> PropertyGraph:
        """A graph of edges (src, dst [, weight, type, props, ord]); missing endpoints become nodes."""
        g = PropertyGraph.empty(edges.sparkSession, directed)
        if nodes is not None:
            g = g.add_nodes(nodes)
        return g.add_edges(edges)

    def add_nodes(self, nodes: DataFrame) -> PropertyGraph:
        """Inserts or merges: the first type stays, later props win over earlier ones."""
        rows = _filled(nodes, NODES, {"type": F.lit("default"), "props": F.expr("cast(map() as map<string,string>)"), "ord": F.monotonically_increasing_id()})
        every = self.nodes.withColumn("_late", F.lit(0)).unionByName(rows.withColumn("_late", F.lit(1)))
        order = F.struct("_late", "ord")
        # Entries in order of insertion; the last of each key stays.
        entries = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_late", "ord", F.map_entries("props").alias("e")))), lambda x: x["e"]))
        merged = every.groupBy("id").agg(F.min_by("type", order).alias("type"), entries.alias("_e"), F.min_by("ord", order).alias("ord"))
        props = F.map_from_entries(F.filter("_e", lambda x, i: ~F.exists(F.slice("_e", i + 2, F.size("_e")), lambda y: y["key"] == x["key"])))
        return PropertyGraph(merged.select("id", "type", props.alias("props"), "ord"), self.edges, self.directed)

    def add_edges(self, edges: DataFrame) -> PropertyGraph:
        """Upserts by (src, dst), unordered if undirected: the last weight, type and props count, the first ord stays."""
        rows = _filled(edges, EDGES, {"weight": F.lit(1.0), "type": F.lit("default"), "props": F.expr("cast(map() as map<string,string>)"), "ord": F.monotonically_increasing_id()})
        every = self.edges.withColumn("_late", F.lit(0)).unionByName(rows.withColumn("_late", F.lit(1)))
        order = F.struct("_late", "ord")
        last = F.max_by(F.struct("weight", "type", F.map_entries("props").alias("props")), order).alias("l")
        first = F.min_by(F.struct("src", "dst", "ord"), order).alias("f")
        merged = every.groupBy(*_key(self.directed)).agg(last, first)
        merged = merged.select("f.src", "f.dst", "l.weight", "l.type", F.map_from_entries("l.props").alias("props"), "f.ord")
        ends = rows.select(F.explode(F.array(F.struct(F.col("src").alias("id"), (F.col("ord") * 2).alias("ord")), F.struct(F.col("dst").alias("id"), (F.col("ord") * 2 + 1).alias("ord")))).alias("e")).select("e.*").groupBy("id").agg(F.min("ord").alias("ord"))
        new = ends.join(self.nodes.select("id"), "id", "left_anti").select("id", F.lit("default").alias("type"), F.expr("cast(map() as map<string,string>)").alias("props"), "ord")
        return PropertyGraph(self.nodes.unionByName(new), merged, self.directed)

    def remove_edges(self, edges: DataFrame) -> PropertyGraph:
        gone = edges.select(*_key(self.directed)).distinct()
        a, b = _key(self.directed)
        kept = self.edges.withColumns({"_a": a, "_b": b}).join(gone, ["_a", "_b"], "left_anti").select(self.edges.columns)
        return PropertyGraph(self.nodes, kept, self.directed)

    def remove_nodes(self, ids: DataFrame) -> PropertyGraph:
        gone = ids.select("id").distinct()
        kept = self.edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
        return PropertyGraph(self.nodes.join(gone, "id", "left_anti"), kept.select(self.edges.columns), self.directed)

    def adjacency(self) -> DataFrame:
        """(src, dst, weight, type, ord): the edges, with their reverses if undirected (a loop only once)."""
        e = self.edges.select("src", "dst", "weight", "type", "ord")
        if self.directed:
            return e
        return e.unionByName(e.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight", "type", "ord"))

    def both_ways(self) -> DataFrame:
        """Distinct (src, dst) of the symmetrised graph."""
        e = self.edges.select("src", "dst")
        return e.union(self.edges.select("dst", "src")).distinct()

    def num_nodes(self) -> int:
        return self.nodes.count()

    def num_edges(self) -> int:
        """Directed: the edges; undirected: half the adjacency entries, rounded down."""
        return self.adjacency().count() // (1 if self.directed else 2)

    def edge_list(self) -> DataFrame:
        """(src, dst, weight), each edge once."""
        return self.edges.select("src", "dst", "weight")

    def adjacency_lists(self) -> DataFrame:
        """(id, neighbours): array of (dst, weight) in order of insertion; empty for an isolated node."""
        lists = self.adjacency().groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list(F.struct("ord", "dst", "weight"))).alias("n"))
        empty = F.expr("cast(array() as array<struct<dst:string,weight:double>>)")
        return self.nodes.select("id").join(lists, "id", "left").select("id", F.coalesce(F.transform("n", lambda x: F.struct(x["dst"].alias("dst"), x["weight"].alias("weight"))), empty).alias("neighbours"))

    def index(self) -> DataFrame:
        """(id, i): places of nodes in order of insertion."""
        from pyspark.sql import Window

        return self.nodes.select("id", (F.row_number().over(Window.orderBy("ord", "id")) - 1).alias("i"))

    def adjacency_matrix(self) -> DataFrame:
        """(i, j, v) of every cell, in places of nodes; small graphs only, as it is dense."""
        at = self.index()
        cells = at.select("i").crossJoin(at.select(F.col("i").alias("j")))
        return cells.join(self.sparse_matrix(), ["i", "j"], "left").select("i", "j", F.coalesce("v", F.lit(0.0)).alias("v"))

    def sparse_matrix(self) -> DataFrame:
        """(i, j, v) of the cells that aren't 0."""
        at = self.index()
        a = self.adjacency().join(at.select(F.col("id").alias("src"), "i"), "src").join(at.select(F.col("id").alias("dst"), F.col("i").alias("j")), "dst")
        return a.where("weight <> 0").select("i", "j", F.col("weight").alias("v"))

    def incidence_matrix(self) -> DataFrame:
        """(id, src, dst, v): 1 at both ends, or -1 at the source and 1 at the target; a directed loop is 1."""
        if not self.directed:
            return self.edges.select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("id"), "src", "dst", F.lit(1).alias("v"))
        cells = F.when(F.col("src") == F.col("dst"), F.array(F.struct(F.col("dst").alias("id"), F.lit(1).alias("v")))).otherwise(F.array(F.struct(F.col("src").alias("id"), F.lit(-1).alias("v")), F.struct(F.col("dst").alias("id"), F.lit(1).alias("v"))))
        return self.edges.select("src", "dst", F.explode(cells).alias("c")).select("c.id", "src", "dst", "c.v")

    @staticmethod
    def from_matrix(cells: DataFrame, directed: bool = False) -> PropertyGraph:
        """From (i, j, v): cells that aren't 0 are edges between nodes i and j; undirected, the last cell in row order counts."""
        e = cells.where("v <> 0").select(F.col("i").cast("string").alias("src"), F.col("j").cast("string").alias("dst"), F.col("v").cast("double").alias("weight"), (F.col("i").cast("long") * (1 << 31) + F.col("j").cast("long")).alias("ord"))
        nodes = cells.select(F.explode(F.array("i", "j")).alias("n")).distinct().select(F.col("n").cast("string").alias("id"), F.col("n").cast("long").alias("ord"))
        return PropertyGraph.from_edges(e, directed, nodes)
