"""Graphs derived from the star schema, the event log and the embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arachne.operators.graph import PropertyGraph


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, weight, ord): quantity from each customer nation to each supplier nation."""
    t = lambda n: table(spark, sf_dir, n)
    # Quantities are summed by the keys of the two nations before their names come in.
    lines = t("lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    buyers = t("orders").select("o_orderkey", "o_custkey").join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    sold = lines.join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).join(buyers, F.col("l_orderkey") == F.col("o_orderkey"))
    by = sold.groupBy("c_nationkey", "s_nationkey").agg(F.sum("l_quantity").alias("weight"))
    n = t("nation").select("n_nationkey", "n_name")
    named = by.join(n.toDF("c_nationkey", "src"), "c_nationkey").join(n.toDF("s_nationkey", "dst"), "s_nationkey")
    return named.select("src", "dst", "weight", (F.col("c_nationkey").cast("long") * 100_000 + F.col("s_nationkey")).alias("ord"))


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("id"), F.lit("nation").alias("type"), F.col("n_nationkey").cast("long").alias("ord"))


def trade(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    return PropertyGraph.from_edges(trade_edges(spark, sf_dir), True, nations(spark, sf_dir))


def trade5(spark: SparkSession, sf_dir: str, directed: bool = True) -> PropertyGraph:
    """Each nation's five largest flows to others; undirected: both directions of a pair are one edge, the later one's weight."""
    best = Window.partitionBy("src").orderBy(F.desc("weight"), "dst")
    top = trade_edges(spark, sf_dir).where("src <> dst").withColumn("r", F.row_number().over(best)).where("r <= 5").drop("r")
    return PropertyGraph.from_edges(top, directed, nations(spark, sf_dir))


def trade_both(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Undirected: the flow between two nations, both ways summed; no loops."""
    e = trade_edges(spark, sf_dir).where("src <> dst").groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.sum("weight").alias("weight"), F.min("ord").alias("ord"))
    return PropertyGraph.from_edges(e, False, nations(spark, sf_dir))


def supplier_part(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Undirected and bipartite: suppliers s<key> and the parts p<key> that they shipped."""
    pairs = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()
    e = pairs.select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"), (F.col("l_suppkey") * 10_000_000 + F.col("l_partkey")).alias("ord"))
    return PropertyGraph.from_edges(e, False)


def hierarchy(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Directed forest: region to nation to customer."""
    n, c = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    name = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    e = n.select(name("r", "n_regionkey").alias("src"), name("n", "n_nationkey").alias("dst"), F.col("n_nationkey").cast("long").alias("ord"))
    e = e.union(c.select(name("n", "c_nationkey"), name("c", "c_custkey"), F.col("c_custkey") + 1_000_000))
    return PropertyGraph.from_edges(e, True)


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s, p, o): customers, suppliers, nations, regions, orders and parts."""
    t = lambda n: table(spark, sf_dir, n)
    name = lambda p, k: F.concat(F.lit(p + ":"), F.col(k).cast("string"))
    parts = [
        t("customer").select(name("customer", "c_custkey"), F.lit("in_nation"), name("nation", "c_nationkey")),
        t("supplier").select(name("supplier", "s_suppkey"), F.lit("in_nation"), name("nation", "s_nationkey")),
        t("nation").select(name("nation", "n_nationkey"), F.lit("in_region"), name("region", "n_regionkey")),
        t("orders").select(name("order", "o_orderkey"), F.lit("placed_by"), name("customer", "o_custkey")),
        t("part").select(name("part", "p_partkey"), F.lit("has_brand"), F.col("p_brand")),
    ]
    out = parts[0].toDF("s", "p", "o")
    for p in parts[1:]:
        out = out.union(p.toDF("s", "p", "o"))
    return out.distinct()


def event_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, step, event_type, ts, event_id): each user's events in order, counted from 0."""
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select("user_id", (F.row_number().over(w) - 1).alias("step"), "event_type", "ts", "event_id")


def features(spark: SparkSession, sf_dir: str, size: int = 4) -> DataFrame:
    """(id, x): the first places of each embedding."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.transform(F.slice("embedding", 1, size), lambda v: v.cast("double")).alias("x"))


def ring(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Directed: each vector to the next one, and to the next but two, of the same label."""
    e = table(spark, sf_dir, "embeddings")
    w = Window.partitionBy("label").orderBy("vec_id")
    ahead = e.select("vec_id", F.lead("vec_id", 1).over(w).alias("next"), F.lead("vec_id", 3).over(w).alias("skip"))
    rows = ahead.select(F.col("vec_id").cast("string").alias("src"), "vec_id", F.explode(F.array(*[F.struct(F.col(t).alias("d"), F.lit(t).alias("type")) for t in ("next", "skip")])).alias("n"))
    out = rows.where("n.d is not null").select("src", F.col("n.d").cast("string").alias("dst"), F.lit(1.0).alias("weight"), "n.type", (F.col("vec_id") * 10 + F.when(F.col("n.type") == "next", 0).otherwise(1)).alias("ord"))
    nodes = e.select(F.col("vec_id").cast("string").alias("id"), F.col("vec_id").alias("ord"))
    return PropertyGraph.from_edges(out, True, nodes)
