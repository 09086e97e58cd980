"""Bayes nets, factor graphs, hidden Markov models and conditional random fields."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arachne.plans.iterate import checkpoint


@dataclass
class BayesNet:
    """Variables with conditional tables (parents..., name, prob), values as strings."""

    parents: dict[str, list[str]] = field(default_factory=dict)
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def add_variable(self, name: str, parents: list[str], table: DataFrame) -> BayesNet:
        """table: one column for each parent and for the variable, and prob."""
        self.parents[name] = sorted(parents)
        self.tables[name] = table.select(*self.parents[name], name, F.col("prob").cast("double").alias("prob"))
        return self

    def order(self) -> list[str]:
        out: list[str] = []
        while len(out) < len(self.parents):
            ready = [v for v in self.parents if v not in out and all(p in out for p in self.parents[v])]
            if not ready:
                raise ValueError("the parents form a cycle, or one is missing")
            out += ready
        return out

    def joint(self, evidence: dict[str, str] | None = None) -> DataFrame:
        """Every assignment that agrees with the evidence, with its probability; tables are cut to the evidence first."""
        out = None
        for v in self.order():
            t = self.tables[v].withColumnRenamed("prob", f"p_{v}")
            for k, x in (evidence or {}).items():
                if k in t.columns:
                    t = t.where(F.col(k) == x)
            shared = [c for c in t.columns if out is not None and c in out.columns]
            out = t if out is None else out.join(t, shared) if shared else out.crossJoin(t)
        product = reduce(lambda a, b: a * b, [F.col(f"p_{v}") for v in self.parents])
        return out.select(*self.parents, product.alias("prob"))

    def query(self, variable: str, evidence: dict[str, str] | None = None) -> DataFrame:
        """(value, prob) of the variable given the evidence, by enumeration; no rows if the evidence is impossible."""
        by = self.joint(evidence).groupBy(F.col(variable).alias("value")).agg(F.sum("prob").alias("w"))
        all_of = by.agg(F.sum("w").alias("z"))
        return by.join(F.broadcast(all_of)).where("z > 0").select("value", (F.col("w") / F.col("z")).alias("prob"))

    def sample(self, spark: SparkSession, n: int, seed: int = 7) -> DataFrame:
        """(sample, variables...): n ancestral samples; each variable is drawn by its cumulative table from a hash of seed and sample."""
        out = spark.range(n).withColumnRenamed("id", "sample")
        for v in self.order():
            ps = self.parents[v]
            rows = self.tables[v].groupBy(*ps).agg(F.array_sort(F.collect_list(F.struct(F.col(v).alias("value"), "prob"))).alias("options")) if ps else self.tables[v].agg(F.array_sort(F.collect_list(F.struct(F.col(v).alias("value"), "prob"))).alias("options"))
            out = out.join(F.broadcast(rows), ps) if ps else out.join(F.broadcast(rows))
            out = out.withColumn("u", F.pmod(F.xxhash64(F.lit(seed), F.lit(v), "sample"), F.lit(1 << 40)) / float(1 << 40))
            pick = "aggregate(options, named_struct('c', 0D, 'v', cast(null as string)), (s, o) -> named_struct('c', s.c + o.prob, 'v', if(s.v is null and u < s.c + o.prob, o.value, s.v)), s -> coalesce(s.v, options[size(options) - 1].value))"
            out = out.withColumn(v, F.expr(pick)).drop("options", "u")
        return out

    def rejection(self, spark: SparkSession, variable: str, evidence: dict[str, str], n: int = 1000, seed: int = 7) -> DataFrame:
        """(value, prob) among the samples that agree with the evidence; no rows if none does."""
        kept = self.sample(spark, n, seed)
        for k, x in evidence.items():
            kept = kept.where(F.col(k) == x)
        by = kept.groupBy(F.col(variable).alias("value")).agg(F.count("*").alias("w"))
        return by.join(F.broadcast(by.agg(F.sum("w").alias("z")))).select("value", (F.col("w") / F.col("z")).alias("prob"))


def belief_propagation(variables: DataFrame, factors: DataFrame, rounds: int = 10) -> DataFrame:
    """(var, value, belief) by synchronous sum-product. variables: (var); all are binary, with values 0 and 1.

    factors: (factor, var1, val1, var2, val2, phi) with var2 and val2 null for a factor over one variable. A variable
    without factors is uniform. Raises ValueError if a factor names a third variable, as tables here can't.
    """
    extra = set(factors.columns) - {"factor", "var1", "val1", "var2", "val2", "phi"}
    if extra:
        raise ValueError("factors over three or more variables are not supported")
    f = checkpoint(factors)
    links = f.select("factor", F.explode(F.array("var1", "var2")).alias("var")).where("var is not null").distinct()
    binary = F.explode(F.array(F.lit(0), F.lit(1))).alias("val")
    to_factor = checkpoint(links.select("factor", "var", binary).withColumn("m", F.lit(1.0)))
    def normal(df: DataFrame, keys: list[str]) -> DataFrame:
        z = df.groupBy(*keys).agg(F.sum("m").alias("z"))
        return df.join(z, keys).select(*keys, "val", F.expr("if(z > 0, m / z, 0.5D)").alias("m"))

    def multiplied(messages: DataFrame) -> DataFrame:
        return messages.groupBy("var", "val").agg(F.sum(F.expr("if(m = 0, 1, 0)")).alias("zeros"), F.sum(F.expr("if(m > 0, ln(m), 0D)")).alias("logs"))

    def shifted(df: DataFrame, keys: list[str]) -> DataFrame:
        """m from zeros and logs, up to a factor common to the values, so that many messages don't underflow."""
        top = df.groupBy(*keys).agg(F.max(F.expr("if(zeros = 0, logs, null)")).alias("top"))
        return df.join(top, keys).select(*keys, "val", F.expr("if(zeros = 0, exp(logs - top), 0D)").alias("m"))

    one = f.where("var2 is null").select("factor", F.col("var1").alias("var"), F.col("val1").alias("val"), F.col("phi").alias("m"))
    two = f.where("var2 is not null")
    to_var = None
    for _ in range(rounds):
        other = lambda a, b: two.join(to_factor.select("factor", F.col("var").alias(f"var{b}"), F.col("val").alias(f"val{b}"), "m"), ["factor", f"var{b}", f"val{b}"]).groupBy("factor", F.col(f"var{a}").alias("var"), F.col(f"val{a}").alias("val")).agg(F.sum(F.col("phi") * F.col("m")).alias("m"))
        to_var = checkpoint(normal(other(1, 2).unionByName(other(2, 1)).unionByName(one), ["factor", "var"]))
        # All of a variable's messages multiplied, as logs and a count of zeros, without the factor's own: a hub costs its edges.
        own = to_factor.select("factor", "var", "val").join(to_var, ["factor", "var", "val"], "left")
        rest = own.join(multiplied(to_var), ["var", "val"]).select("factor", "var", "val", F.expr("zeros - if(m = 0, 1, 0)").alias("zeros"), F.expr("logs - if(m > 0, ln(m), 0D)").alias("logs"))
        to_factor = checkpoint(normal(shifted(rest, ["factor", "var"]), ["factor", "var"]), to_factor)
    every = variables.select("var", binary)
    if to_var is None:
        return every.select("var", F.col("val").alias("value"), F.lit(0.5).alias("belief"))
    beliefs = every.join(multiplied(to_var), ["var", "val"], "left").na.fill(0, ["zeros"]).na.fill(0.0, ["logs"])
    return normal(shifted(beliefs, ["var"]), ["var"]).select("var", F.col("val").alias("value"), F.col("m").alias("belief"))


def viterbi(sequences: DataFrame, states: list[str], start: list[float], transition: list[list[float]], emission: list[dict[str, float]], log: bool = False) -> DataFrame:
    """(seq, path, score): the likeliest state path of each sequence (seq, observations array), first state on ties.

    A fold over the observations in SQL functions. log: log probabilities, for long sequences. An observation that no
    state emits gives score 0; an empty sequence has a null path.
    """
    import math

    ln = (lambda p: math.log(p) if p > 0 else float("-inf")) if log else (lambda p: p)
    times = "+" if log else "*"
    num = lambda x: "double('-Infinity')" if x == float("-inf") else f"{x!r}D"
    emit = lambda s: "case x " + " ".join(f"when '{o}' then {num(ln(p))}" for o, p in emission[s].items()) + f" else {num(ln(0.0))} end"

    def step(s: int) -> str:
        best = "array_max(array(" + ", ".join(f"struct(a[{r}].p {times} {num(ln(transition[r][s]))} as p, -{r} as r)" for r in range(len(states))) + "))"
        return f"struct({best}.p {times} ({emit(s)}) as p, concat(a[-{best}.r].path, array('{states[s]}')) as path)"

    first = "transform(slice(observations, 1, 1), x -> array(" + ", ".join(f"struct({num(ln(start[s]))} {times} ({emit(s)}) as p, array('{states[s]}') as path)" for s in range(len(states))) + "))[0]"
    fold = f"aggregate(slice(observations, 2, size(observations)), {first}, (a, x) -> array({', '.join(step(s) for s in range(len(states)))}))"
    out = sequences.withColumn("_a", F.when(F.size("observations") > 0, F.expr(fold)))
    top = F.expr("array_max(transform(_a, (s, i) -> struct(s.p as p, -i as i)))")
    return out.withColumn("_t", top).select("seq", F.expr("_a[-_t.i].path").alias("path"), F.col("_t.p").alias("score"))


def crf_decode(sequences: DataFrame, size: int) -> DataFrame:
    """(seq, path): the best label path of each sequence (seq, emissions array<array<double>>, transitions array<array<double>>), additive scores."""

    def run(batches):
        import numpy as np

        for pdf in batches:
            paths = []
            for e, t in zip(pdf["emissions"], pdf["transitions"], strict=True):
                e, t = np.array([list(r) for r in e], float).reshape(-1, size), np.array([list(r) for r in t], float)
                if not len(e):
                    paths.append([])
                    continue
                score, back = e[0], []
                for row in e[1:]:
                    total = score[:, None] + t
                    back.append(total.argmax(0))
                    score = total.max(0) + row
                path = [int(score.argmax())]
                for b in reversed(back):
                    path.append(int(b[path[-1]]))
                paths.append(path[::-1])
            yield pd.DataFrame({"seq": pdf["seq"], "path": paths})

    return sequences.select(F.col("seq").cast("string").alias("seq"), "emissions", "transitions").mapInPandas(run, "seq string, path array<int>")
