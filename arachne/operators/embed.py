"""Random walks and node embeddings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arachne.operators.graph import PropertyGraph
from arachne.operators.spectral import MAX_DENSE
from arachne.plans.iterate import checkpoint

#: Training pairs, and nodes, that one training task holds.
MAX_PAIRS, MAX_NODES = 5_000_000, 1_000_000


def transition_probabilities(g: PropertyGraph, p: float = 1.0, q: float = 1.0) -> DataFrame:
    """(t, v, x, prob): after a step from t to v, the chance of x next: weight, times 1/p back to t, 1 to a neighbour of t, 1/q else."""
    a = g.adjacency().select("src", "dst", "weight")
    step = a.select(F.col("src").alias("t"), F.col("dst").alias("v")).join(a.select(F.col("src").alias("v"), F.col("dst").alias("x"), "weight"), "v")
    near = a.select(F.col("src").alias("t"), F.col("dst").alias("x"), F.lit(True).alias("near"))
    bias = F.when(F.col("x") == F.col("t"), 1.0 / p).when(F.col("near"), 1.0).otherwise(1.0 / q)
    rows = step.join(near, ["t", "x"], "left").withColumn("w", F.col("weight") * bias)
    return rows.select("t", "v", "x", (F.col("w") / F.sum("w").over(Window.partitionBy("t", "v"))).alias("prob"))


def walks(g: PropertyGraph, num: int = 5, length: int = 10, p: float = 1.0, q: float = 1.0, seed: int = 7) -> DataFrame:
    """(start, walk, pos, id): num biased walks of up to length nodes from every node, all advanced together.

    The next node is the smallest of exponential variates over the weights, drawn from hashes of the seed, the walk and
    the edge, so a rerun of a lost task draws the same. A walk ends at a dead end.
    """
    a = checkpoint(g.adjacency().groupBy("src", "dst").agg(F.max("weight").alias("weight")))
    here = checkpoint(g.nodes.select(F.col("id").alias("start"), F.explode(F.sequence(F.lit(0), F.lit(num - 1))).alias("walk"), "id", F.lit(None).cast("string").alias("t")))
    out = here.select("start", "walk", F.lit(0).alias("pos"), "id")
    for pos in range(1, length):
        opts = here.join(a, F.col("id") == F.col("src")).select("start", "walk", "t", F.col("id").alias("v"), F.col("dst").alias("x"), "weight")
        if p != 1.0 or q != 1.0:
            near = a.select(F.col("src").alias("t"), F.col("dst").alias("x"), F.lit(True).alias("near"))
            bias = F.when(F.col("t").isNull(), 1.0).when(F.col("x") == F.col("t"), 1.0 / p).when(F.col("near"), 1.0).otherwise(1.0 / q)
            opts = opts.join(near, ["t", "x"], "left").withColumn("weight", F.col("weight") * bias)
        u = (F.pmod(F.xxhash64(F.lit(seed), F.lit(pos), "start", "walk", "x"), F.lit(1 << 40)) + 1) / float((1 << 40) + 1)
        here = checkpoint(opts.where("weight > 0").groupBy("start", "walk").agg(F.min_by(F.struct(F.col("x").alias("id"), F.col("v").alias("t")), F.struct(-F.log(u) / F.col("weight"), "x")).alias("n")).select("start", "walk", "n.id", "n.t"))
        out = out.union(here.select("start", "walk", F.lit(pos).alias("pos"), "id"))
    return out


def skipgram_pairs(sequences: DataFrame, window: int = 2) -> DataFrame:
    """(target, context) of each two places of a sequence (seq, pos, id) at most window apart."""
    offsets = F.explode(F.array(*[F.lit(o) for o in range(-window, window + 1) if o])).alias("o")
    a = sequences.select("seq", F.col("id").alias("target"), "pos", offsets).select("seq", "target", (F.col("pos") + F.col("o")).alias("pos"))
    return a.join(sequences.select("seq", "pos", F.col("id").alias("context")), ["seq", "pos"]).select("target", "context")


def skipgram_loss(targets: np.ndarray, contexts: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> float:
    """Mean negative-sampling loss of pairs pos (n, 2) and negatives neg (n, k), in places of the two tables."""
    t, c = targets[pos[:, 0]], contexts[pos[:, 1]]
    good = np.log(1 / (1 + np.exp(-(t * c).sum(1))) + 1e-15)
    bad = np.log(1 / (1 + np.exp(np.einsum("nd,nkd->nk", t, contexts[neg]))) + 1e-15).sum(1)
    return float(-(good + bad).mean())


def _sgd(pairs: np.ndarray, n: int, dim: int, epochs: int, lr: float, negatives: int, batch: int, seed: int, shared: bool) -> tuple[np.ndarray, list[float]]:
    """Adam on the skip-gram loss; shared: one table for both roles."""
    rng = np.random.default_rng(seed)
    t = rng.uniform(-0.5 / dim, 0.5 / dim, (n, dim))
    c = t if shared else np.zeros((n, dim))
    state = {id(x): (np.zeros_like(x), np.zeros_like(x)) for x in (t, c)}
    losses, k = [], 0
    for _ in range(epochs):
        order = rng.permutation(len(pairs))
        total = 0.0
        for lo in range(0, len(order), batch):
            pos = pairs[order[lo : lo + batch]]
            neg = rng.integers(0, n, (len(pos), negatives))
            total += skipgram_loss(t, c, pos, neg) * len(pos)
            a, b, m = t[pos[:, 0]], c[pos[:, 1]], c[neg]
            gp = 1 / (1 + np.exp(-(a * b).sum(1))) - 1
            gn = 1 / (1 + np.exp(-np.einsum("nd,nkd->nk", a, m)))
            gt, gc = np.zeros_like(t), np.zeros_like(c)
            np.add.at(gt, pos[:, 0], (gp[:, None] * b + np.einsum("nk,nkd->nd", gn, m)) / len(pos))
            np.add.at(gc, pos[:, 1], gp[:, None] * a / len(pos))
            np.add.at(gc, neg, gn[:, :, None] * a[:, None, :] / len(pos))
            k += 1
            for x, grad in ((t, gt + gc),) if shared else ((t, gt), (c, gc)):
                m1, m2 = state[id(x)]
                m1 += 0.1 * (grad - m1)
                m2 += 0.001 * (grad**2 - m2)
                x -= lr * (m1 / (1 - 0.9**k)) / (np.sqrt(m2 / (1 - 0.999**k)) + 1e-8)
        losses.append(total / max(1, len(pairs)))
    return t, losses


def _train(pairs: DataFrame, nodes: DataFrame, dim: int, epochs: int, lr: float, batch: int, seed: int, shared: bool) -> DataFrame:
    pairs = checkpoint(pairs)
    if pairs.count() > MAX_PAIRS or nodes.count() > MAX_NODES:  # before anything moves
        raise ValueError("too many pairs or nodes for one training task")
    rows = pairs.select(F.col("target").alias("a"), F.col("context").alias("b")).union(nodes.select("id", F.lit(None).cast("string")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = sorted(pdf[pdf["b"].isna()]["a"])
        real = pdf[pdf["b"].notna()]
        at = {x: i for i, x in enumerate(ids)}
        places = np.array([[at[a], at[b]] for a, b in zip(real["a"], real["b"], strict=True)], np.int64).reshape(-1, 2)
        emb = _sgd(places, len(ids), dim, epochs, lr, 5, batch, seed, shared)[0] if len(places) else np.zeros((len(ids), dim))
        return pd.DataFrame({"id": ids, "x": list(emb)})

    return rows.groupBy(F.lit(0).alias("_g")).applyInPandas(run, "id string, x array<double>")


def node2vec(g: PropertyGraph, dim: int = 16, num_walks: int = 5, length: int = 10, p: float = 1.0, q: float = 1.0, epochs: int = 5, lr: float = 0.01, seed: int = 7) -> DataFrame:
    """(id, x): skip-gram over biased walks, windows of 2, 5 negatives, batches of 64; zeros if there are no pairs."""
    seqs = walks(g, num_walks, length, p, q, seed).select(F.concat_ws("#", "start", "walk").alias("seq"), "pos", "id")
    return _train(skipgram_pairs(seqs), g.nodes.select("id"), dim, epochs, lr, 64, seed, False)


def line(g: PropertyGraph, dim: int = 16, proximity: str = "first", epochs: int = 10, lr: float = 0.01, seed: int = 7) -> DataFrame:
    """(id, x): first-order proximity shares one table, second-order has a context table; edges in one direction, weights aside."""
    if proximity not in ("first", "second"):
        raise ValueError("proximity is 'first' or 'second'")
    pairs = g.edges.select(F.col("src").alias("target"), F.col("dst").alias("context"))
    return _train(pairs, g.nodes.select("id"), dim, epochs, lr, 32, seed, proximity == "first")


def hope(g: PropertyGraph, dim: int = 16, beta: float = 0.01) -> DataFrame:
    """(id, x): source side of the SVD of the Katz matrix (I - beta A)^-1 beta A; zero-padded; beta A if that is singular."""
    if g.num_nodes() > MAX_DENSE:
        raise ValueError(f"more than {MAX_DENSE} nodes")
    rows = g.adjacency().select("src", "dst", "weight", F.lit(None).cast("long").alias("ord")).union(g.nodes.select("id", F.lit(None).cast("string"), F.lit(None).cast("double"), "ord"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf[pdf["dst"].isna()].sort_values(["ord", "src"])["src"].tolist()
        at = {x: i for i, x in enumerate(ids)}
        a = np.zeros((len(ids), len(ids)))
        for s, d, w in pdf[pdf["dst"].notna()][["src", "dst", "weight"]].itertuples(index=False):
            a[at[s], at[d]] = w
        try:
            katz = np.linalg.solve(np.eye(len(ids)) - beta * a, beta * a)
        except np.linalg.LinAlgError:
            katz = beta * a
        u, s, _ = np.linalg.svd(katz)
        k = min(dim, len(ids))
        emb = np.zeros((len(ids), dim))
        emb[:, :k] = u[:, :k] * np.sqrt(s[:k])
        return pd.DataFrame({"id": ids, "x": list(emb)})

    return rows.groupBy(F.lit(0).alias("_g")).applyInPandas(run, "id string, x array<double>")
