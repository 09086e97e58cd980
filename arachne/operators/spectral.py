"""Laplacians and spectra. Factorisations run in numpy in one group, up to a stated size; Laplacians and the Fiedler cut are distributed."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arachne.operators.graph import PropertyGraph
from arachne.plans.iterate import checkpoint

#: Nodes up to which a dense matrix is factorised.
MAX_DENSE = 2000


def laplacian(g: PropertyGraph) -> DataFrame:
    """(src, dst, v): degree (weighted row sum) minus adjacency, cells that aren't 0."""
    a = g.adjacency()
    cells = a.select("src", "dst", (-F.col("weight")).alias("v")).union(a.groupBy("src").agg(F.sum("weight").alias("v")).select("src", F.col("src").alias("dst"), "v"))
    return cells.groupBy("src", "dst").agg(F.sum("v").alias("v")).where("v <> 0")


def normalized_laplacian(g: PropertyGraph) -> DataFrame:
    """(src, dst, v): D^-1/2 L D^-1/2, cells that aren't 0; a degree of 0 or less counts as a zero factor."""
    d = g.adjacency().groupBy("src").agg(F.sum("weight").alias("d")).select("src", F.expr("if(d > 0, 1 / sqrt(d), 0D)").alias("f"))
    l = laplacian(g).join(d, "src").join(d.select(F.col("src").alias("dst"), F.col("f").alias("f2")), "dst", "left")
    return l.select("src", "dst", F.expr("v * f * coalesce(f2, 0D)").alias("v")).where("v <> 0")


def _dense(g: PropertyGraph, normalized: bool, run, schema: str, extra: DataFrame | None = None) -> DataFrame:
    """run(ids, L, extra values) in one task, for an undirected graph within MAX_DENSE nodes."""
    if g.directed:
        raise ValueError("spectra are defined here for undirected graphs: a directed Laplacian isn't symmetric")
    if g.num_nodes() > MAX_DENSE:
        raise ValueError(f"more than {MAX_DENSE} nodes")
    cells = (normalized_laplacian(g) if normalized else laplacian(g)).select("src", "dst", "v", F.lit(None).cast("long").alias("ord"))
    rows = cells.union(g.nodes.select("id", F.lit(None).cast("string"), F.lit(None).cast("double"), "ord"))
    if extra is not None:
        rows = rows.union(extra.select("id", F.lit("#"), F.col("value").cast("double"), F.lit(None).cast("long")))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = pdf[pdf["dst"].isna()].sort_values(["ord", "src"])["src"].tolist()
        at = {x: i for i, x in enumerate(nodes)}
        matrix, values = np.zeros((len(nodes), len(nodes))), np.zeros(len(nodes))
        for s, d, v in pdf[pdf["dst"].notna()][["src", "dst", "v"]].itertuples(index=False):
            if d == "#":
                values[at[s]] = v
            else:
                matrix[at[s], at[d]] = v
        return run(nodes, matrix, values)

    return rows.groupBy(F.lit(0).alias("_g")).applyInPandas(one, schema)


def _eigh(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending eigenvalues, vectors in columns with the largest entry positive."""
    values, vectors = np.linalg.eigh(matrix)
    if vectors.size:
        big = np.abs(vectors).argmax(axis=0)
        vectors = vectors * np.where(vectors[big, range(len(values))] < 0, -1, 1)
    return values, vectors


def eigenvalues(g: PropertyGraph, normalized: bool = False) -> DataFrame:
    return _dense(g, normalized, lambda ids, m, _: pd.DataFrame({"k": range(len(ids)), "value": _eigh(m)[0]}), "k int, value double")


def decomposition(g: PropertyGraph, normalized: bool = False) -> DataFrame:
    """(k, value, id, u): eigenvalue k, ascending, and the entries of its eigenvector."""

    def run(ids, m, _):
        w, u = _eigh(m)
        return pd.DataFrame([(k, w[k], x, u[i, k]) for k in range(len(w)) for i, x in enumerate(ids)], columns=["k", "value", "id", "u"])

    return _dense(g, normalized, run, "k int, value double, id string, u double")


def embeddings(g: PropertyGraph, k: int = 2, normalized: bool = False) -> DataFrame:
    """(id, x): eigenvectors 1 to k; with k + 1 nodes or fewer, all but the first."""
    run = lambda ids, m, _: pd.DataFrame({"id": ids, "x": list(_eigh(m)[1][:, 1 : k + 1])})
    return _dense(g, normalized, run, "id string, x array<double>")


def fourier(g: PropertyGraph, signal: DataFrame, normalized: bool = False) -> DataFrame:
    """(k, value): the transform of the signal (id, value) in the eigenbasis."""
    return _dense(g, normalized, lambda ids, m, x: pd.DataFrame({"k": range(len(ids)), "value": _eigh(m)[1].T @ x}), "k int, value double", signal)


def inverse_fourier(g: PropertyGraph, spectrum: DataFrame, normalized: bool = False) -> DataFrame:
    """(id, value) of the spectrum (k, value)."""
    basis = decomposition(g, normalized).select("k", "id", "u")
    return basis.join(spectrum, "k").groupBy("id").agg(F.sum(F.col("u") * F.col("value")).alias("value"))


def fiedler_cut(g: PropertyGraph, rounds: int = 150, every: int = 10, start: DataFrame | None = None) -> DataFrame:
    """(id, v, side): the sign cut after rounds of v - gamma L v (unweighted) from start (id, v), or from a hash of the id; gamma is half of the largest degree's inverse.

    A round keeps v's sum, so v is made orthogonal to 1 once, and again whenever lineage is cut, against rounding. Each
    round is one join: a node's own share stands among its edges as a loop, so that no plan holds v twice. A node
    without edges keeps its start. A node whose v is zero but for rounding, such as one linked with all others, is on side A.
    """
    a = g.both_ways().where("src <> dst").select("src", "dst")
    deg = checkpoint(a.groupBy("src").agg(F.count("*").cast("double").alias("d")))
    gamma = 0.5 / (deg.agg(F.max("d")).first()[0] or 1.0)
    own = g.nodes.select("id").join(deg, F.col("id") == F.col("src"), "left").select(F.col("id").alias("src"), F.col("id").alias("dst"), (1 - gamma * F.coalesce("d", F.lit(0.0))).alias("w"))
    step = checkpoint(a.withColumn("w", F.lit(gamma)).union(own), deg)
    last = v = checkpoint(start.select("id", "v") if start is not None else g.nodes.select("id", (F.pmod(F.xxhash64("id"), F.lit(10_007)) / 10_007.0 - 0.5).alias("v")))
    for k in range(rounds):
        if k % every == 0:
            mean, spread = v.agg(F.avg("v"), F.stddev_pop("v")).first()
            v = v.select("id", ((F.col("v") - (mean or 0.0)) / (spread or 1.0)).alias("v"))
        v = step.join(v, F.col("dst") == F.col("id")).groupBy(F.col("src").alias("id")).agg(F.sum(F.col("w") * F.col("v")).alias("v"))
        if (k + 1) % every == 0 or k == rounds - 1:
            last = v = checkpoint(v, last)
    return v.select("id", "v", F.when(F.col("v") >= -1e-9, "A").otherwise("B").alias("side"))
