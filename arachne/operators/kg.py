"""Triples, basic graph patterns, entity linking and resolution, knowledge-graph embedding scores."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arachne.functions import vectors as V
from arachne.operators.graph import PropertyGraph

Pattern = tuple[str, str, str]


def add_triples(triples: DataFrame, more: DataFrame) -> DataFrame:
    """The set union of two tables (s, p, o)."""
    return triples.select("s", "p", "o").union(more.select("s", "p", "o")).dropDuplicates()


def match(triples: DataFrame, s: str = "?s", p: str = "?p", o: str = "?o") -> DataFrame:
    """(s, p, o) that fit a pattern in which ?names are free; names that repeat are not compared here."""
    out = triples.select("s", "p", "o")
    for column, term in (("s", s), ("p", p), ("o", o)):
        if not term.startswith("?"):
            out = out.where(F.col(column) == term)
    return out


def _bindings(triples: DataFrame, pattern: Pattern) -> DataFrame:
    out, seen = match(triples, *pattern), {}
    for column, term in zip("spo", pattern, strict=True):
        if term.startswith("?"):
            if term in seen:
                out = out.where(F.col(seen[term]) == F.col(column))
            else:
                seen[term] = column
    return out.select(*[F.col(c).alias(t) for t, c in seen.items()]).distinct() if seen else out.limit(1).select()


def bgp(triples: DataFrame, patterns: list[Pattern]) -> DataFrame:
    """A row for each solution of the patterns, a column for each ?variable: natural joins on what they share.

    Patterns that share a variable with those before are joined first; where none does, the product is the answer. A
    pattern without variables only has to match. No patterns have no solutions: a table without rows and columns.
    """
    if not patterns:
        return triples.limit(0).select()
    left, out = list(patterns), None
    # All-constant patterns are existence tests.
    for fixed in [x for x in left if not any(t.startswith("?") for t in x)]:
        left.remove(fixed)
        if match(triples, *fixed).isEmpty():
            triples = triples.limit(0)
    if not left:
        return match(triples, *patterns[0]).limit(1).select(F.lit(True).alias("matched"))
    while left:
        nxt = next((x for x in left if out is None or any(t in out.columns for t in x)), left[0])
        left.remove(nxt)
        b = _bindings(triples, nxt)
        shared = [c for c in b.columns if out is not None and c in out.columns]
        out = b if out is None else out.join(b, shared) if shared else out.crossJoin(b)
    return out


def link_entities(mentions: DataFrame, entities: DataFrame, threshold: float = 0.6) -> DataFrame:
    """(mention, id): for each mention the entity (id, name, ord) with the smallest edit distance, lower-cased, first by ord; null if none is similar enough.

    Similarity 1 - d / longer length >= threshold bounds the lengths, so mentions meet only entities of like length.
    """
    m = mentions.select("mention").distinct().withColumn("l", F.length("mention"))
    reach = F.explode(F.sequence(F.greatest(F.ceil(F.col("l") * threshold - 1e-9).cast("int"), F.lit(0)), F.floor(F.col("l") / threshold + 1e-9).cast("int"))).alias("n")
    pairs = m.select("mention", "l", reach).join(entities.select("id", "name", "ord", F.length("name").alias("n")), "n")
    d = F.levenshtein(F.lower("mention"), F.lower("name"))
    alike = F.when(F.greatest("l", "n") > 0, 1 - F.col("d") / F.greatest("l", "n")).otherwise(0.0)  # two empty names aren't alike
    near = pairs.withColumn("d", d).where(alike >= threshold)
    best = near.groupBy("mention").agg(F.min_by("id", F.struct("d", "ord")).alias("id"))
    return mentions.select("mention").distinct().join(best, "mention", "left")


def resolve_entities(g: PropertyGraph, pairs: DataFrame, attribute: Column | None = None, threshold: float = 0.7) -> DataFrame:
    """(a, b, score, same) for pairs (a, b, ...): 0.4 * Jaccard of out-neighbours + 0.6 * attribute similarity (1 by default)."""
    near = g.adjacency().select("src", "dst").distinct()
    size = near.groupBy("src").agg(F.count("*").alias("k"))
    shared = pairs.select("a", "b").distinct().join(near.toDF("a", "x"), "a").join(near.toDF("b", "x"), ["b", "x"]).groupBy("a", "b").agg(F.count("*").alias("both"))
    rows = pairs.join(shared, ["a", "b"], "left").join(size.toDF("a", "ka"), "a", "left").join(size.toDF("b", "kb"), "b", "left").na.fill(0, ["both", "ka", "kb"])
    jaccard = F.expr("if(ka + kb - both > 0, both / (ka + kb - both), 0D)")
    score = 0.4 * jaccard + 0.6 * (attribute if attribute is not None else F.lit(1.0))
    return rows.select("a", "b", score.alias("score")).withColumn("same", F.col("score") >= threshold - 1e-12)


def transe(h, r, t, norm: int = 1) -> Column:
    """Distance of unit(h) + r from unit(t)."""
    d = V.sub(V.add(V.unit(h), r), V.unit(t))
    return V.l1(d) if norm == 1 else V.l2(d)


def transh(h, r, t, normal) -> Column:
    w = V.unit(normal)
    on = lambda x: V.sub(x, V.scale(w, V.dot(w, x)))
    return V.l1(V.sub(V.add(on(h), r), on(t)))


def transr(h, r, t, matrix) -> Column:
    return V.l1(V.sub(V.add(V.matvec(matrix, h), r), V.matvec(matrix, t)))


def rotate(h_re, h_im, phase, t_re, t_im) -> Column:
    c, s = F.transform(V._c(phase), F.cos), F.transform(V._c(phase), F.sin)
    re = V.sub(V.sub(V.mul(h_re, c), V.mul(h_im, s)), t_re)
    im = V.sub(V.add(V.mul(h_re, s), V.mul(h_im, c)), t_im)
    return V.total(F.zip_with(re, im, lambda a, b: F.sqrt(a * a + b * b + 1e-15)))


def distmult(h, r, t) -> Column:
    return V.dot(V.mul(h, r), t)


def complex_score(h_re, h_im, r_re, r_im, t_re, t_im) -> Column:
    return V.dot(V.mul(h_re, r_re), t_re) + V.dot(V.mul(h_im, r_re), t_im) + V.dot(V.mul(h_re, r_im), t_im) - V.dot(V.mul(h_im, r_im), t_re)


def rescal(h, matrix, t) -> Column:
    return V.dot(h, V.matvec(matrix, t))


#: Models whose score is a distance; of all others it is a similarity.
DISTANCES = ("transe", "transh", "transr", "rotate")


def margin_loss(positive: Column, negative: Column, model: str = "transe", margin: float = 1.0) -> Column:
    gap = positive - negative if model in DISTANCES else negative - positive
    return F.greatest(gap + margin, F.lit(0.0))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def _through_unit(x: np.ndarray, grad: np.ndarray) -> np.ndarray:
    """The gradient at x of what has grad at unit(x)."""
    norm = np.linalg.norm(x, axis=-1, keepdims=True)
    u = x / norm
    return (grad - u * (grad * u).sum(-1, keepdims=True)) / norm


def _score_transe(h, t, r):
    d = _unit(h) + r - _unit(t)
    g = np.sign(d)
    return np.abs(d).sum(-1), (_through_unit(h, g), _through_unit(t, -g), g)


def _score_transh(h, t, r, normal):
    w = _unit(normal)
    along = lambda x: (w * x).sum(-1, keepdims=True)
    d = (h - w * along(h)) + r - (t - w * along(t))
    g = np.sign(d)
    gh = g - w * along(g)
    return np.abs(d).sum(-1), (gh, -gh, g, _through_unit(normal, -along(h - t) * g - along(g) * (h - t)))


def _score_transr(h, t, r, m):
    d = np.einsum("nij,nj->ni", m, h - t) + r
    g = np.sign(d)
    gh = np.einsum("nij,ni->nj", m, g)
    return np.abs(d).sum(-1), (gh, -gh, g, g[:, :, None] * (h - t)[:, None, :])


def _halves(x):
    k = x.shape[-1] // 2
    return x[..., :k], x[..., k:]


def _score_rotate(h, t, phase):
    (a, b), (x, y), c, s = _halves(h), _halves(t), np.cos(phase), np.sin(phase)
    re, im = a * c - b * s - x, a * s + b * c - y
    m = np.sqrt(re * re + im * im + 1e-15)
    re, im = re / m, im / m
    return m.sum(-1), (np.concatenate([re * c + im * s, im * c - re * s], -1), np.concatenate([-re, -im], -1), re * (-a * s - b * c) + im * (a * c - b * s))


def _score_distmult(h, t, r):
    return (h * r * t).sum(-1), (r * t, h * r, h * t)


def _score_complex(h, t, r):
    (a, b), (x, y), (p, q) = _halves(h), _halves(t), _halves(r)
    score = (a * p * x + b * p * y + a * q * y - b * q * x).sum(-1)
    pair = lambda u, v: np.concatenate([u, v], -1)
    return score, (pair(p * x + q * y, p * y - q * x), pair(a * p - b * q, b * p + a * q), pair(a * x + b * y, a * y - b * x))


def _score_rescal(h, t, m):
    mt = np.einsum("nij,nj->ni", m, t)
    return (h * mt).sum(-1), (mt, np.einsum("nij,ni->nj", m, h), h[:, :, None] * t[:, None, :])


#: Of each model its score with gradients, and the shapes of its tables of entities and relations by the dimension.
MODELS = {
    "transe": (_score_transe, lambda d: (d,), (lambda d: (d,),)),
    "transh": (_score_transh, lambda d: (d,), (lambda d: (d,), lambda d: (d,))),
    "transr": (_score_transr, lambda d: (d,), (lambda d: (d,), lambda d: (d, d))),
    "rotate": (_score_rotate, lambda d: (2 * d,), (lambda d: (d,),)),
    "distmult": (_score_distmult, lambda d: (d,), (lambda d: (d,),)),
    "complex": (_score_complex, lambda d: (2 * d,), (lambda d: (2 * d,),)),
    "rescal": (_score_rescal, lambda d: (d,), (lambda d: (d, d),)),
}


class KGETrainer:
    """Margin-ranking training of the embeddings of any of MODELS in numpy, with Adam; for stores that fit one process.

    tables: the entities' table, then those of the relations. Complex numbers are stored as real and imaginary halves.
    """

    def __init__(self, model: str, entities: int, relations: int, dim: int, margin: float = 1.0, lr: float = 0.01, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.score, entity, relation = MODELS[model]
        bound = 6 / dim**0.5
        self.tables = [rng.uniform(-bound, bound, (entities, *entity(dim)))] + [rng.uniform(-bound, bound, (relations, *shape(dim))) for shape in relation]
        self.sign = 1.0 if model in DISTANCES else -1.0
        self.margin, self.lr, self.k = margin, lr, 0
        self.moments = [(np.zeros_like(x), np.zeros_like(x)) for x in self.tables]

    def _graded(self, x: np.ndarray):
        e, *r = self.tables
        return self.score(e[x[:, 0]], e[x[:, 2]], *[table[x[:, 1]] for table in r])

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Of triples (rows h, r, t), in places of the tables."""
        return self._graded(x)[0]

    def gradients(self, pos: np.ndarray, neg: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """The mean margin loss, and its gradient by each table."""
        (sp, gp), (sn, gn) = self._graded(pos), self._graded(neg)
        gap = self.margin + self.sign * (sp - sn)
        out = [np.zeros_like(x) for x in self.tables]
        for x, grads, sign in ((pos, gp, self.sign), (neg, gn, -self.sign)):
            weight = sign * (gap > 0) / len(pos)
            for table, at, g in zip([0, 0, *range(1, len(out))], [x[:, 0], x[:, 2], *[x[:, 1]] * (len(out) - 1)], grads, strict=True):
                np.add.at(out[table], at, g * weight.reshape(-1, *[1] * (g.ndim - 1)))
        return float(np.maximum(gap, 0).mean()), out

    def train_step(self, pos: np.ndarray, neg: np.ndarray) -> float:
        """One step on triples pos and neg (rows h, r, t); returns the loss before it."""
        loss, grads = self.gradients(pos, neg)
        self.k += 1
        for w, g, (a, b) in zip(self.tables, grads, self.moments, strict=True):
            a += 0.1 * (g - a)
            b += 0.001 * (g**2 - b)
            w -= self.lr * (a / (1 - 0.9**self.k)) / (np.sqrt(b / (1 - 0.999**self.k)) + 1e-8)
        return loss
