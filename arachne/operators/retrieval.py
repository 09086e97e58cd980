"""TF-IDF, triple extraction, ingestion, hybrid retrieval, associative memory, task plans and the sandbox layout."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arachne.operators.graph import PropertyGraph
from arachne.plans.iterate import checkpoint


def tokens(text: Column | str) -> Column:
    """Words of the lower-cased text: runs of letters, numbers and underscores of any script."""
    return words(F.lower(text))


def words(text: Column | str) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, chunk, text): parts between blank lines, trimmed, empty ones dropped."""
    parts = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.col(text_col), "\n\n")).alias("chunk", "text"))
    return parts.withColumn("text", F.regexp_replace("text", r"(?U)^\s+|\s+$", "")).where("text <> ''")


def tfidf(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, term, tf, idf, tfidf): tf = count / tokens; idf = ln(1 + n / (1 + df)). n counts the documents without tokens too."""
    split = docs.select(F.col(id_col).alias("doc_id"), tokens(text_col).alias("w"))
    counts = split.select("doc_id", F.size("w").alias("size"), F.explode("w").alias("term")).groupBy("doc_id", "size", "term").agg(F.count("*").alias("c"))
    n = docs.agg(F.count("*").alias("n"))
    df = counts.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(n)).select("term", F.log(1 + F.col("n") / (1 + F.col("df"))).alias("idf"))
    return counts.join(df, "term").select("doc_id", "term", (F.col("c") / F.col("size")).alias("tf"), "idf", (F.col("c") / F.col("size") * F.col("idf")).alias("tfidf"))


def vector_query(index: DataFrame, docs: DataFrame, query: str, top_k: int = 2, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, score) of the top_k cosines, ties by id; a query without known terms scores every document 0.

    The index is read twice, so one that isn't a table yet is best written first.
    """
    q = docs.sparkSession.range(1).select(tokens(F.lit(query)).alias("w")).select(F.size("w").alias("size"), F.explode("w").alias("term")).groupBy("size", "term").agg((F.count("*") / F.first("size")).alias("qtf"))
    hits = index.join(F.broadcast(q.select("term", "qtf")), "term")
    terms = hits.select("term", (F.col("qtf") * F.col("idf")).alias("qw")).distinct()
    qn = terms.agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qn"))
    norms = index.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("tfidf") * F.col("tfidf"))).alias("dn"))
    dots = hits.groupBy("doc_id").agg(F.sum(F.col("tfidf") * F.col("qtf") * F.col("idf")).alias("dot"))
    scored = docs.select(F.col(id_col).alias("doc_id")).join(dots.join(norms, "doc_id"), "doc_id", "left").join(F.broadcast(qn), F.lit(True), "left")
    score = F.coalesce(F.expr("if(dn > 0 and qn > 0, dot / (dn * qn), 0D)"), F.lit(0.0)).alias("score")
    return scored.select("doc_id", score).orderBy(F.desc("score"), "doc_id").limit(top_k)


# How a statement and a copula read. Groups: subject, predicate, object; subject, class.
STATEMENT = r"\b([A-Z][a-zA-Z]+)\s+([a-z_]+)\s+([A-Z][a-zA-Z\s0-9]+?)(?=\.|,|and|\s+is\b|\s+was\b|$)"
COPULA = r"\b([A-Z][a-zA-Z]+)\s+is\s+(?:a|an)?\s*([a-zA-Z\s]+?)(?=\.|,|$)"


def extract_triples(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(other columns, s, p, o): a row for each statement "Name predicate Name" and each "Name is a class" of each text.

    A statement's predicate is any one lower-case word. Its object runs to the next full stop, comma, "and" (inside a
    word too: "Thailand" ends at "Thail"), "is" or "was"; a copula's class runs to the next stop or comma, becomes
    one word with "_", and keeps the n of "an". A null text has none.
    """
    keep = [F.col(c) for c in docs.columns if c != text_col]
    group = lambda p, i: F.regexp_extract_all(F.col(text_col), F.lit("(?U)" + p), F.lit(i))
    trimmed = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    stated = docs.select(*keep, F.explode(F.arrays_zip(*[group(STATEMENT, i + 1).alias(x) for i, x in enumerate("spo")])).alias("_t")).select(*keep, "_t.s", "_t.p", trimmed("_t.o").alias("o"))
    copulas = docs.select(*keep, F.explode(F.arrays_zip(*[group(COPULA, i + 1).alias(x) for i, x in enumerate("so")])).alias("_t"))
    return stated.union(copulas.select(*keep, "_t.s", F.lit("is_a"), F.replace(trimmed("_t.o"), F.lit(" "), F.lit("_"))))


def ingest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(chunks, index, triples, sources) of documents: (doc_id, chunk, text), the TF-IDF index by chunk_id "doc_id:chunk",
    (s, p, o) once each, and provenance (entity, doc_id, chunk): where a subject or object was stated."""
    parts = chunks(docs, id_col, text_col)
    stated = extract_triples(parts)
    index = tfidf(parts.select(F.concat_ws(":", "doc_id", "chunk").alias("chunk_id"), "text"), "chunk_id").withColumnRenamed("doc_id", "chunk_id")
    sources = stated.select(F.explode(F.array("s", "o")).alias("entity"), "doc_id", "chunk").distinct()
    return parts, index, stated.select("s", "p", "o").distinct(), sources


def neighbourhood(triples: DataFrame, seeds: DataFrame, max_hops: int = 2) -> DataFrame:
    """(s, p, o) of every triple met within max_hops of the seeds (column id), both ways."""
    t = triples.select("s", "p", "o").distinct()
    seen = frontier = seeds.select("id").distinct()
    found = None
    for _ in range(max_hops):
        hit = t.join(frontier.withColumnRenamed("id", "s"), "s", "left_semi").select("s", "p", "o").union(t.join(frontier.withColumnRenamed("id", "o"), "o", "left_semi").select("s", "p", "o")).distinct()
        found = hit if found is None else found.union(hit).distinct()
        ends = hit.select(F.explode(F.array("s", "o")).alias("id")).distinct()
        frontier = ends.join(seen, "id", "left_anti")
        seen = seen.union(frontier)
    return found if found is not None else t.limit(0)


def hybrid_retrieve(docs: DataFrame, triples: DataFrame, query: str, top_k: int = 2, max_hops: int = 2, id_col: str = "doc_id", text_col: str = "text", lowercase_chunks: bool = False) -> tuple[DataFrame, DataFrame]:
    """((doc_id, score, text), (s, p, o)): the best chunks, and the triples around entities that the query or they name.

    An entity is named if its lower-cased name is a word of the lower-cased query or of a chunk as it stands
    (lowercase_chunks: lower-cased too).
    """
    top = vector_query(checkpoint(tfidf(docs, id_col, text_col)), docs, query, top_k, id_col).join(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "doc_id")
    chunk = F.lower("text") if lowercase_chunks else F.col("text")
    play = docs.sparkSession.range(1).select(F.explode(tokens(F.lit(query))).alias("w")).union(top.select(F.explode(words(chunk)))).distinct()
    entities = triples.select(F.explode(F.array("s", "o")).alias("id")).distinct()
    seeds = entities.join(play, F.lower("id") == F.col("w"), "left_semi")
    return top, neighbourhood(triples, seeds, max_hops)


# The parts of an answer, and the facts that tell a place.
CONTEXT = "======= GROUNDED CONTEXT =======\n[Unstructured Chunks]:\n{chunks}\n\n[Structured Knowledge Graph Paths]:\n{facts}\n================================\n\n[User Query]: {query}\n\n[GraphRAG Grounded Response]:"
PLACE = "Based on the Knowledge Graph paths, we know that {s} is associated with {o} via a '{p}' relationship."
NO_PLACE = "I searched the vector chunks and graph relations, but could not find a specific location."
GENERAL = "Using hybrid retrieval, I synthesized information from the vector text and graph relationships."
CITED = "According to the retrieved documents: '{text}...'"
PLACES = ("located_in", "works_at")


def grounded_answer(docs: DataFrame, triples: DataFrame, query: str, most_facts: int = 1000, **options) -> str:
    """The context (best chunks, facts in order of (s, p, o)) and an answer from it.

    A query for a place ("where", "located") is answered by the first fact that tells one, or says that there is none;
    any other query by a general sentence. The best chunk's first 80 characters are cited. The context quotes at most
    most_facts facts; the place is looked for among all.
    """
    top, facts = hybrid_retrieve(docs, triples, query, **options)
    best = top.orderBy(F.desc("score"), "doc_id").collect()  # top_k rows
    quoted = facts.orderBy("s", "p", "o").limit(most_facts).collect()
    answer = [GENERAL]
    if "where" in query.lower() or "located" in query.lower():
        place = facts.where(F.col("p").isin(*PLACES)).orderBy("s", "p", "o").first()
        answer = [PLACE.format(s=place.s, p=place.p, o=place.o) if place else NO_PLACE]
    if best:
        answer.append(CITED.format(text=best[0].text[:80]))
    context = CONTEXT.format(chunks="\n".join(f"- {r.text}" for r in best), facts="\n".join(f"- ({r.s}) --[{r.p}]--> ({r.o})" for r in quoted), query=query)
    return context + "\n" + " ".join(answer)


def memory_strengths(episodes: DataFrame) -> DataFrame:
    """(event, concept, strength) of episodes (event, concept), a row for each time: 0.5, and 0.2 more for each repeat, up to 1."""
    return episodes.groupBy("event", "concept").agg(F.least(F.lit(1.0), 0.5 + 0.2 * (F.count("*") - 1)).alias("strength"))


def remember(memory: DataFrame, episodes: DataFrame) -> DataFrame:
    """memory with further episodes: known links gain 0.2 for each, new ones begin at 0.5."""
    more = episodes.groupBy("event", "concept").agg(F.count("*").alias("k"))
    strength = F.least(F.lit(1.0), F.coalesce(F.col("strength"), F.lit(0.3)) + 0.2 * F.coalesce("k", F.lit(0)))
    return memory.join(more, ["event", "concept"], "full").select("event", "concept", strength.alias("strength"))


def decay(memory: DataFrame, factor: float = 0.9) -> DataFrame:
    """Strengths times factor; links below 0.1 go."""
    return memory.withColumn("strength", F.col("strength") * factor).where("strength >= 0.1")


def recall(memory: DataFrame, concept: str) -> DataFrame:
    """(event, strength) linked with the concept, strongest first; none for an unknown one."""
    return memory.where(F.col("concept") == concept).select("event", "strength").orderBy(F.desc("strength"), "event")


class TaskPlan:
    """Named tools and what they depend on. A tool takes a dict of inputs and returns anything, such as a lazy DataFrame."""

    def __init__(self) -> None:
        self.tools: dict[str, Callable[[dict], object]] = {}
        self.after: dict[str, list[str]] = {}

    def register(self, name: str, tool: Callable[[dict], object]) -> None:
        self.tools[name] = tool
        self.after.setdefault(name, [])

    def depend(self, before: str, name: str) -> None:
        self.after.setdefault(before, [])
        self.after.setdefault(name, []).append(before)

    def order(self) -> list[str]:
        """First come, first served among tasks whose parents are done. Raises ValueError on a cycle."""
        out, left = [], dict(self.after)
        while left:
            ready = [t for t, b in left.items() if all(x in out for x in b)]
            if not ready:
                raise ValueError("the tasks form a cycle")
            out += ready
            for t in ready:
                del left[t]
        return out

    def execute(self, initial: dict[str, object] | None = None) -> dict[str, object]:
        """Results by task. A task gets input_from_<parent>, or initial_input if it is a root with one; unregistered tasks are skipped."""
        done: dict[str, object] = dict(initial or {})
        for t in self.order():
            if t in self.tools:
                inputs = {f"input_from_{b}": done[b] for b in self.after[t]}
                if not self.after[t] and t in (initial or {}):
                    inputs["initial_input"] = initial[t]
                done[t] = self.tools[t](inputs)
        return done


def layout_step(g: PropertyGraph, bodies: DataFrame, width: float = 800.0, height: float = 600.0) -> DataFrame:
    """(id, x, y, vx, vy) after one step: repulsion 800 / d^2 of all pairs, springs .04 (d - 120), gravity .015, damping .85, margin 30.

    A drawing of a small graph: every pair counts, so the step is quadratic in its nodes.
    """
    a, b = bodies.select("id", "x", "y"), bodies.select(F.col("id").alias("o"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    pair = a.crossJoin(b).where("id <> o").selectExpr("id", "x - ox as dx", "y - oy as dy", "greatest(sqrt(pow(x - ox, 2) + pow(y - oy, 2)), 1D) as d")
    push = pair.selectExpr("id", "800D / (d * d) * dx / d as fx", "800D / (d * d) * dy / d as fy")
    spring = g.both_ways().where("src <> dst").select(F.col("src").alias("id"), F.col("dst").alias("o")).join(a, "id").join(b, "o").selectExpr("id", "greatest(sqrt(pow(x - ox, 2) + pow(y - oy, 2)), 1D) as d", "ox - x as dx", "oy - y as dy").selectExpr("id", "0.04D * (d - 120) * dx / d as fx", "0.04D * (d - 120) * dy / d as fy")
    pull = a.selectExpr("id", f"({width} / 2 - x) * 0.015D as fx", f"({height} / 2 - y) * 0.015D as fy")
    force = push.union(spring).union(pull).groupBy("id").agg(F.sum("fx").alias("fx"), F.sum("fy").alias("fy"))
    moved = bodies.join(force, "id").selectExpr("id", "x", "y", "(vx + fx) * 0.85D as vx", "(vy + fy) * 0.85D as vy")
    return moved.selectExpr("id", f"least(greatest(x + vx, 30D), {width} - 30) as x", f"least(greatest(y + vy, 30D), {height} - 30) as y", "vx", "vy")
