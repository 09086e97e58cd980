"""Graph neural layers: gather by a join on the source, aggregate by target, update by vector columns.

x: (id, x array<double>); edges: (src, dst), messages go from src to dst. Weights are plain nested lists (rows: outputs).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arachne.functions import vectors as V
from arachne.operators.graph import PropertyGraph
from arachne.operators.spectral import MAX_DENSE
from arachne.plans.iterate import bounded, checkpoint

Matrix = list[list[float]]


def scatter_add(values: DataFrame, size: int, ids: DataFrame | None = None) -> DataFrame:
    """(id, x): sum of the rows (id, x) of each id; ids without rows, of the table ids, are zeros."""
    out = values.groupBy("id").agg(V.sum_vectors("x", size).alias("x"))
    return out if ids is None else ids.select("id").join(out, "id", "left").select("id", F.coalesce("x", V.zeros(size)).alias("x"))


def propagate(x: DataFrame, edges: DataFrame, size: int, aggregate: str = "sum", message: Column | None = None, clamp: bool = True) -> DataFrame:
    """(id, x, agg): messages (the source's x, or a column over x) by target: sum, mean or max.

    A node without in-edges has zeros. clamp: a maximum below 0 becomes 0.
    """
    sent = edges.join(x.select(F.col("id").alias("src"), "x"), "src").select(F.col("dst").alias("id"), (message if message is not None else F.col("x")).alias("x"))
    how = {"sum": V.sum_vectors, "mean": V.mean_vectors, "max": V.max_vectors}[aggregate]
    got = sent.groupBy("id").agg(how("x", size).alias("agg"))
    agg = V.relu("agg") if aggregate == "max" and clamp else F.col("agg")
    return x.select("id", "x").join(got, "id", "left").select("id", "x", F.coalesce(agg, V.zeros(size)).alias("agg"))


def with_loops(x: DataFrame, edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(x.select("id", F.col("id")))


def gcn(x: DataFrame, edges: DataFrame, weight: Matrix, bias: list[float] | None = None) -> DataFrame:
    """(id, x): W first, loops added, 1 / sqrt(d_i d_j) by the targets' degrees, then the bias; no activation."""
    e = with_loops(x, edges)
    deg = e.groupBy(F.col("dst").alias("id")).agg(F.count("*").cast("double").alias("d"))
    h = x.select("id", V.linear("x", weight).alias("h")).join(deg, "id")
    sent = e.join(h.select(F.col("id").alias("src"), "h", F.col("d").alias("dj")), "src").join(deg.select(F.col("id").alias("dst"), F.col("d").alias("di")), "dst")
    rows = sent.select(F.col("dst").alias("id"), V.scale("h", 1 / F.sqrt(F.col("di") * F.col("dj"))).alias("x"))
    out = rows.groupBy("id").agg(V.sum_vectors("x", len(weight)).alias("x"))
    return out.select("id", V.add("x", V.vec(bias)).alias("x")) if bias else out


def sage(x: DataFrame, edges: DataFrame, own: Matrix, near: Matrix, bias: list[float] | None = None, aggregate: str = "mean") -> DataFrame:
    """(id, x): relu(W1 x + W2 agg + b)."""
    rows = propagate(x, edges, len(own[0]), aggregate)
    total = V.add(V.linear("x", own, bias), V.linear("agg", near))
    return rows.select("id", V.relu(total).alias("x"))


def _attend(rows: DataFrame, score: str, value: str, size: int) -> DataFrame:
    """(id, head, x): softmax of score over each target's in-edges and head, times value. The exponents are shifted by the maximum."""
    top = rows.groupBy("id", "head").agg(F.max(score).alias("m"))
    w = rows.join(top, ["id", "head"]).withColumn("w", F.exp(F.col(score) - F.col("m")))
    sums = w.groupBy("id", "head").agg(F.sum("w").alias("z"), *[F.sum(F.col("w") * F.col(value)[k]).alias(f"v{k}") for k in range(size)])
    return sums.select("id", "head", F.array(*[F.col(f"v{k}") / (F.col("z") + 1e-15) for k in range(size)]).alias("x"))


def _heads(x: DataFrame, weights: list[Matrix], name: str) -> Column:
    return F.array(*[V.linear("x", w) for w in weights]).alias(name)


def _joined_heads(ids: DataFrame, per_head: DataFrame, heads: int, size: int, concat: bool) -> DataFrame:
    wide = per_head.groupBy("id").agg(*[F.max(F.when(F.col("head") == k, F.col("x"))).alias(f"h{k}") for k in range(heads)])
    wide = ids.select("id").join(wide, "id", "left").na.fill(0)
    parts = [F.coalesce(f"h{k}", V.zeros(size)) for k in range(heads)]
    if concat:
        return wide.select("id", F.concat(*parts).alias("x"))
    total = parts[0]
    for p in parts[1:]:
        total = V.add(total, p)
    return wide.select("id", V.scale(total, 1.0 / heads).alias("x"))


def gat(x: DataFrame, edges: DataFrame, weights: list[Matrix], att_target: list[list[float]], att_source: list[list[float]], bias: list[float] | None = None, concat: bool = True) -> DataFrame:
    """(id, x): attention over in-edges, a head for each of weights: leaky ReLU 0.2 of a_t . h_i + a_s . h_j; no loops.

    Heads are joined end to end, or averaged. A node without in-edges has the bias.
    """
    heads, size = len(weights), len(weights[0])
    h = checkpoint(x.select("id", _heads(x, weights, "h")))
    one = h.select("id", F.posexplode("h").alias("head", "h"))
    case = lambda table: F.element_at(F.array(*[V.dot("h", V.vec(a)) for a in table]), F.col("head") + 1)
    src = one.select(F.col("id").alias("src"), "head", "h", case(att_source).alias("sj"))
    dst = one.select(F.col("id").alias("dst"), "head", case(att_target).alias("si"))
    raw = F.col("si") + F.col("sj")
    rows = edges.select("src", "dst").join(src, "src").join(dst, ["dst", "head"]).select(F.col("dst").alias("id"), "head", "h", F.when(raw > 0, raw).otherwise(0.2 * raw).alias("s"))
    out = _joined_heads(x, _attend(rows, "s", "h", size), heads, size, concat)
    return out.select("id", V.add("x", V.vec(bias)).alias("x")) if bias else out


def _layer_norm(a: Column, size: int, eps: float = 1e-5) -> Column:
    mean = V.total(a) / size
    var = V.total(F.transform(a, lambda v: (v - mean) * (v - mean))) / size
    return F.transform(a, lambda v: (v - mean) / F.sqrt(var + eps))


def graph_transformer(x: DataFrame, edges: DataFrame, query: list[Matrix], key: list[Matrix], value: list[Matrix], residual: Matrix, ffn1: Matrix, ffn2: Matrix) -> DataFrame:
    """(id, x): scaled dot-product attention over in-edges, a residual projection, layer norm, a ReLU network, layer norm.

    All heads have the same width, and together the width of residual.
    """
    heads, size = len(query), len(query[0])
    out = len(residual)
    if heads * size != out:
        raise ValueError("the heads' widths must add up to the output's")
    p = checkpoint(x.select("id", _heads(x, query, "q"), _heads(x, key, "k"), _heads(x, value, "v")))
    src = p.select(F.col("id").alias("src"), F.posexplode(F.arrays_zip("k", "v")).alias("head", "kv"))
    dst = p.select(F.col("id").alias("dst"), F.posexplode("q").alias("head", "q"))
    rows = edges.select("src", "dst").join(src, "src").join(dst, ["dst", "head"]).select(F.col("dst").alias("id"), "head", F.col("kv.v").alias("v"), (V.dot("q", F.col("kv.k")) / size**0.5).alias("s"))
    att = _joined_heads(x, _attend(rows, "s", "v", size), heads, size, True)
    h = checkpoint(x.join(att.withColumnRenamed("x", "a"), "id").select("id", V.add("a", V.linear("x", residual)).alias("h")))
    h = checkpoint(h.select("id", _layer_norm(F.col("h"), out).alias("h")))
    h = checkpoint(h.select("id", V.add("h", V.linear(V.relu(V.linear("h", ffn1)), ffn2)).alias("h")))
    return h.select("id", _layer_norm(F.col("h"), out).alias("x"))


def rgcn(x: DataFrame, edges: DataFrame, by_type: dict[str, Matrix], own: Matrix, bias: list[float] | None = None) -> DataFrame:
    """(id, x): for each relation the mean over its in-edges of W_r x, plus W_0 x and the bias. edges: (src, dst, type)."""
    size = len(own)
    none = F.lit(None).cast("array<double>")
    msg = F.coalesce(*[F.when(F.col("type") == t, V.linear("x", w)) for t, w in by_type.items()], none)
    sent = edges.join(x.select(F.col("id").alias("src"), "x"), "src").select(F.col("dst").alias("id"), "type", msg.alias("x")).where("x is not null")
    mean = sent.groupBy("id", "type").agg(V.mean_vectors("x", size).alias("x")).groupBy("id").agg(V.sum_vectors("x", size).alias("agg"))
    rows = x.join(mean, "id", "left")
    return rows.select("id", V.add(V.linear("x", own, bias), F.coalesce("agg", V.zeros(size))).alias("x"))


def infomax_scores(x: DataFrame, corrupt: DataFrame, edges: DataFrame, weight: Matrix, bilinear: Matrix) -> DataFrame:
    """(id, positive, negative): bilinear scores of true and corrupted GCN encodings against sigmoid of the true mean."""
    size = len(weight)
    true, false = checkpoint(gcn(x, edges, weight)), gcn(corrupt, edges, weight)
    summary = true.agg(F.transform(V.mean_vectors("x", size), V.sigmoid).alias("s")).select(V.linear("s", bilinear).alias("ws"))
    both = true.join(false.withColumnRenamed("x", "y"), "id").join(F.broadcast(summary))
    return both.select("id", V.dot("x", "ws").alias("positive"), V.dot("y", "ws").alias("negative"))


def vgae_encode(x: DataFrame, edges: DataFrame, hidden: Matrix, mean: Matrix, logvar: Matrix) -> DataFrame:
    """(id, mu, logvar): a GCN with ReLU, then one GCN for each."""
    h = checkpoint(gcn(x, edges, hidden).select("id", V.relu("x").alias("x")))
    return gcn(h, edges, mean).withColumnRenamed("x", "mu").join(gcn(h, edges, logvar).withColumnRenamed("x", "logvar"), "id")


def vgae_sample(encoded: DataFrame, seed: int = 7) -> DataFrame:
    """(id, x): mu + exp(logvar / 2) times normal noise from hashes of seed, id and place; for training only."""
    def noise(i: Column) -> Column:
        u = lambda k: (F.pmod(F.xxhash64(F.lit(seed), F.lit(k), F.col("id"), i), F.lit(1 << 40)) + 1) / float((1 << 40) + 1)
        return F.sqrt(-2 * F.log(u(1))) * F.cos(2 * np.pi * u(2))

    std = F.transform("logvar", lambda v, i: F.exp(v / 2) * noise(i))
    return encoded.select("id", V.add("mu", std).alias("x"))


def vgae_decode(z: DataFrame, pairs: DataFrame) -> DataFrame:
    """(src, dst, prob): sigmoid of the inner product, for the pairs asked for: all of them is quadratic."""
    a, b = z.select(F.col("id").alias("src"), F.col("x").alias("a")), z.select(F.col("id").alias("dst"), F.col("x").alias("b"))
    return pairs.select("src", "dst").join(a, "src").join(b, "dst").select("src", "dst", V.sigmoid(V.dot("a", "b")).alias("prob"))


def vgae_kl(encoded: DataFrame) -> DataFrame:
    """(kl): -1/2 of the mean over nodes of sum(1 + logvar - mu^2 - exp(logvar))."""
    one = V.total(F.zip_with("mu", "logvar", lambda m, v: 1 + v - m * m - F.exp(v)))
    return encoded.agg((-0.5 * F.avg(one)).alias("kl"))


def vgae_train(x: DataFrame, edges: DataFrame, hidden: int = 8, latent: int = 4, epochs: int = 10, lr: float = 0.05, seed: int = 7) -> DataFrame:
    """(epoch, loss, kl) of training in numpy, in one task within MAX_DENSE nodes: cross entropy plus 0.1 KL, finite steps by Adam."""
    bounded(x.select("id"), MAX_DENSE)
    rows = x.select("id", "x", F.lit(None).cast("string").alias("dst")).union(edges.select("src", F.lit(None).cast("array<double>"), "dst"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = pdf[pdf["dst"].isna()].sort_values("id")
        at = {n: i for i, n in enumerate(nodes["id"])}
        feats = np.stack(nodes["x"].map(np.asarray).tolist())
        adj = np.zeros((len(at), len(at)))
        for s, d in pdf[pdf["dst"].notna()][["id", "dst"]].itertuples(index=False):
            adj[at[d], at[s]] += 1
        target = np.minimum(adj + adj.T, 1)
        loops = adj + np.eye(len(at))
        f = 1 / np.sqrt(loops.sum(1))
        norm = loops * f[:, None] * f[None, :]
        rng = np.random.default_rng(seed)
        w = [rng.normal(0, s[0] ** -0.5, s) for s in ((feats.shape[1], hidden), (hidden, latent), (hidden, latent))]
        m1, m2 = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
        nx, out = norm @ feats, []
        for k in range(1, epochs + 1):
            pre = nx @ w[0]
            h = np.maximum(pre, 0)
            nh = norm @ h
            mu, lv = nh @ w[1], np.clip(nh @ w[2], -10, 10)
            eps = rng.normal(size=mu.shape)
            z = mu + np.exp(lv / 2) * eps
            p = 1 / (1 + np.exp(-z @ z.T))
            kl = -0.5 * np.mean((1 + lv - mu**2 - np.exp(lv)).sum(1))
            loss = -np.mean(target * np.log(p + 1e-10) + (1 - target) * np.log(1 - p + 1e-10)) + 0.1 * kl
            gs = (p - target) / p.size
            gz = (gs + gs.T) @ z
            gmu = gz + 0.1 * mu / len(at)
            glv = gz * eps * np.exp(lv / 2) / 2 - 0.05 * (1 - np.exp(lv)) / len(at)
            gh = norm.T @ (gmu @ w[1].T + glv @ w[2].T) * (pre > 0)
            for i, g in enumerate((nx.T @ gh, nh.T @ gmu, nh.T @ glv)):
                m1[i] += 0.1 * (g - m1[i])
                m2[i] += 0.001 * (g**2 - m2[i])
                w[i] -= lr * (m1[i] / (1 - 0.9**k)) / (np.sqrt(m2[i] / (1 - 0.999**k)) + 1e-8)
            out.append((k, float(loss), float(kl)))
        return pd.DataFrame(out, columns=["epoch", "loss", "kl"])

    return rows.groupBy(F.lit(0).alias("_g")).applyInPandas(run, "epoch int, loss double, kl double")


def heat_diffusion(g: PropertyGraph, heat: DataFrame, steps: int = 5, alpha: float = 0.2) -> DataFrame:
    """(step, id, heat): h - alpha L h (weighted), from step 0; heat: (id, heat), missing nodes are 0."""
    a = checkpoint(g.adjacency().select("src", "dst", "weight"))
    h = checkpoint(g.nodes.select("id").join(heat.select("id", "heat"), "id", "left").na.fill(0.0, ["heat"]))
    out = h.select(F.lit(0).alias("step"), "id", "heat")
    for k in range(1, steps + 1):
        flow = a.join(h.select(F.col("id").alias("dst"), F.col("heat").alias("hd")), "dst").join(h.select(F.col("id").alias("src"), F.col("heat").alias("hs")), "src")
        change = flow.groupBy("src").agg(F.sum(F.expr("weight * (hd - hs)")).alias("c"))
        h = checkpoint(h.join(change, F.col("id") == F.col("src"), "left").select("id", F.expr(f"heat + {alpha} * coalesce(c, 0D)").alias("heat")))
        out = out.union(h.select(F.lit(k).alias("step"), "id", "heat"))
    return out
