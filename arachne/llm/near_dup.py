"""Exact n-gram Jaccard join in the metric space of shingle sets.

Jaccard distance is a metric, so pivots can stand for the documents around them. Almost all documents are at distance 1
from each other, where pivots tell nothing apart; so cells are formed first, of documents that may be near. The join
then goes on in each cell by pivots and regions:

1. Cells. Equal sets are one node. The universe of shingles is cut into k parts by hash. Two sets within the radius
   differ in at most h shingles, so at least k - h parts hold the same members in both. A node's signatures are its
   parts' members; ordered from full parts to thin ones, two linked nodes share one of their first h + 1. A signature
   stands for several shingles at once, so unlike documents seldom meet by chance. k grows with the size class of a
   set, and a set takes part in the class below if a smaller partner can be there. Sets that fill too few parts for
   this bound also meet by their shingles (a prefix filter).
2. Own shingles. A shingle that no other node of any cell holds can't be in an intersection. A node with too few shared
   shingles for any partner of its cell's sizes leaves.
3. Regions. In each cell the densest nodes of several random slots are pivots. A pivot's region holds the nodes within
   the radius r, which are all in its component. A boundary node, beyond r but within 2 r, is replicated into the
   region's window, as only such a node can be near one of the region's members. Home and window are compared where they
   are of different components and where the sizes inside and outside the pivot allow a link.
4. Recursion. What is beyond r of all its cell's pivots goes on as a smaller cell, with new and more pivots, until no
   cell holds two components.

No link that could change a component is missed; a group of thousands of near copies costs links to pivots, not pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arachne.llm import kernels as K
from arachne.llm import shared as S

U64 = K.U64
#: Parts for each difference that two sets of a class may have, in percent: above 100, so that some parts may be empty.
PARTS = 125
#: Texts that a Python worker holds at once.
BATCH = 500
#: log2 of the bits of the filter of shared signatures, 8 MB whatever the input; only what it passes is shuffled again.
FILTER_BITS = 26
#: Pivots of a cell at the first level, and how many times as many each further level has.
PIVOTS, MORE_PIVOTS = 2, 4


class Bounds:
    """What sets linked at `percent` may differ in, in whole numbers."""

    def __init__(self, percent: int):
        if not 50 < percent <= 100:
            raise ValueError("percent must be above 50 and at most 100")
        self.percent = percent
        least = 1
        while least < 1000 and not self.differ(least, self.largest(least)):
            least += 1
        #: Sizes at which classes begin: below the first, only equal sets link; each class is twice the one before.
        self.starts = [least << i for i in range(40)]

    def largest(self, n: int) -> int:
        return 100 * n // self.percent

    def differ(self, n: int, m: int) -> int:
        """Most members that only one of two linked sets of sizes n and m holds."""
        return (n + m) * (100 - self.percent) // (100 + self.percent)

    def parts(self, c: int) -> int:
        top = self.starts[c + 1] - 1
        return -(-PARTS * (self.differ(top, self.largest(top)) + 1) // 100)

    def schemes(self, n: int) -> list[tuple[int, int, int]]:
        """(class, parts, most differences) of the classes in which a set of size n takes part."""
        if n < self.starts[0]:
            return []
        c = int(np.searchsorted(self.starts, n, "right")) - 1
        out = [(c, self.parts(c), self.differ(n, self.largest(n)))]
        if c and n <= self.largest(self.starts[c] - 1):
            out.append((c - 1, self.parts(c - 1), self.differ(n, self.starts[c] - 1)))
        return out


def signatures(s: np.ndarray, bounds: Bounds) -> np.ndarray:
    """The signatures of a sorted set: two sets that link share one. The top four bits order them, full parts first."""
    out, poor = [], False
    sums = None
    for c, k, h in bounds.schemes(len(s)):
        if sums is None:
            sums = np.concatenate([np.zeros(1, U64), np.cumsum(K.mix(s ^ U64(0x2545F4914F6CDD1D)), dtype=U64)])
        size = np.bincount(((s >> U64(32)) * U64(k) >> U64(32)).astype(np.int64), minlength=k)
        end = np.cumsum(size)
        held = np.flatnonzero(size)
        content = sums[end[held]] - sums[end[held] - size[held]]
        sig = K.mix(content ^ K.mix(held.astype(U64) + U64(c << 32) + U64(1)))
        sig = (sig >> U64(4)) | ((U64(15) - np.minimum(size[held], 15).astype(U64)) << U64(60))
        if len(held) > h + 1:
            sig = np.partition(sig, h)[: h + 1]
        poor |= len(held) <= h
        out.append(sig)
    if poor:
        order = np.sort(K.mix(s ^ U64(0x9FB21C651E98DF25)))
        out.append(order[: len(s) - (bounds.percent * len(s) + 99) // 100 + 1])
    return np.concatenate(out) if out else np.zeros(0, U64)


def _features(n: int, percent: int):
    """(id, n, d1, d2, cells) of each text: size and digest of its set, its signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = Bounds(percent)
        for b in batches:
            sets = K.shingle_sets(b.column(1), n)
            sigs = [signatures(s, bounds) for s in sets]
            digests = [K.set_digest(s) for s in sets]
            flat = np.concatenate(sigs) if sigs else np.zeros(0, U64)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).cast(pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([d[0] for d in digests], pa.int64()),
                    pa.array([d[1] for d in digests], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sigs)]), pa.int32()), pa.array(flat.view(np.int64))),
                ],
                names=["id", "n", "d1", "d2", "cells"],
            )

    return run


def _listed(filter_):
    """Rows (cell, d1, d2) for those signatures of rows (d1, d2, cells) that the filter of shared ones passes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = filter_.value
        for b in batches:
            lists = b.column(2)
            sig = lists.flatten().to_numpy(zero_copy_only=False)
            own = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
            at = sig & ((1 << FILTER_BITS) - 1)
            hit = np.flatnonzero((words[at >> 6] >> (at & 63)) & 1)
            row = pa.array(own[hit])
            yield pa.RecordBatch.from_arrays([pa.array(sig[hit]), b.column(0).take(row), b.column(1).take(row)], names=["cell", "d1", "d2"])

    return run


def _filter_of(cells: DataFrame) -> np.ndarray:
    """A bit for each hash bucket in which a cell of `cells` lies: 64-bit words of fixed number."""
    at = F.col("cell").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    words = cells.select(F.shiftright(at, 6).alias("word"), F.expr("shiftleft(1L, cast(cell & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out


def _texts_of(n: int):
    """(id, d1, d2, text) of rows (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests = [K.set_digest(s) for s in K.shingle_sets(b.column(1), n)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array([d[0] for d in digests], pa.int64()), pa.array([d[1] for d in digests], pa.int64()), b.column(1).cast(pa.string())], names=["id", "d1", "d2", "text"])

    return run


def _members(n: int):
    """(shingle, x) for each member of the set of each row (x, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = K.shingle_sets(b.column(1), n)
            row = pa.array(np.repeat(np.arange(len(sets)), [len(s) for s in sets]))
            flat = np.concatenate(sets) if sets else np.zeros(0, U64)
            for lo in range(0, len(flat), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(flat[lo : lo + (1 << 17)].view(np.int64)), b.column(0).take(row[lo : lo + (1 << 17)])], names=["shingle", "x"])

    return run


def _overlaps(n: int):
    """(x, p, nx, np, both) for each row (x, p, nx, np, tx, tp): the size of the intersection. A text that a batch repeats is cut up once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets: list[list[np.ndarray]] = []
            for name in ("tx", "tp"):
                codes = b.column(name).dictionary_encode()
                distinct = K.shingle_sets(codes.dictionary, n)
                sets.append([distinct[i] for i in codes.indices.to_pylist()])
            both = [K.common(x, y) for x, y in zip(*sets, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(both, pa.int64())], names=["x", "p", "nx", "np", "both"])

    return run


def _distances(pairs: DataFrame, texts: DataFrame, n: int, least: int) -> tuple[DataFrame, str]:
    """(x, p, nx, np, both), written out, of those rows (x, p, nx, np) whose sets are similar by at least `least` percent.

    Only texts of the pairs are moved.
    """
    pairs, at = S.write_out(pairs, "pairs")
    rows = pairs.count()

    def side(column: str) -> DataFrame:
        ids = pairs.select(F.col(column).alias("x")).distinct()
        return texts.join(S.maybe_broadcast(ids, rows), "x", "left_semi").select(F.col("x").alias(column), F.col("text").alias(f"t{column}"))

    full = pairs.join(side("x"), "x").join(side("p"), "p").select("x", "p", "nx", "np", "tx", "tp")
    found = full.mapInArrow(_overlaps(n), "x long, p long, nx long, np long, both long").where(f"100 * both >= {least} * (nx + np - both)")
    out = S.write_out(found.distinct(), "distances")
    S.remove(pairs.sparkSession, at)
    return out


def _fitting(cells: DataFrame, percent: int) -> DataFrame:
    """Rows (cell, x, n, s, w, comp) of the cells that hold two components, without those whose s shared shingles are too few for all sizes of their cell."""
    least = cells.groupBy("cell").agg(F.min("n").alias("least"))
    fit = cells.join(least, "cell").where(f"{100 + percent} * s >= {percent} * (n + greatest(least, ({percent} * n + 99) div 100))").drop("least")
    live = fit.groupBy("cell").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("cell")
    return fit.join(live, "cell")


def _with_components(rows: DataFrame, comps: DataFrame) -> DataFrame:
    """rows with x's component as comp."""
    return rows.drop("comp").join(comps.select(F.col("id").alias("x"), "comp"), "x", "left").withColumn("comp", F.coalesce("comp", "x"))


def _merged(comps: DataFrame | None, linked: DataFrame) -> DataFrame | None:
    """comps (id, comp) after the links (x, p): the components that they join become one, named by the smallest."""
    links = linked.select(F.col("x").alias("a"), F.col("p").alias("b"))
    if comps is None:
        return S.saved(S.components(links), "comps")
    if links.isEmpty():
        return comps
    of = lambda side: comps.select(F.col("id").alias(side), F.col("comp").alias(f"c{side}"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb")).where("ca <> cb")
    ends = S.saved(ends, "joining")
    if ends.isEmpty():
        return comps
    names = S.saved(S.components(ends, "ca", "cb"), "names")
    known = comps.union(ends.select("a", "ca").union(ends.select("b", "cb")).where("a = ca")).distinct()
    return S.saved(known.join(names.select(F.col("id").alias("comp"), F.col("comp").alias("name")), "comp", "left").select("id", F.coalesce("name", "comp").alias("comp")), "comps")


def _first_cells(texts: DataFrame, feats: DataFrame, classes: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(cells, texts): rows (cell, x, n, s, w, comp) of the cells that hold two nodes or more, and the text (x, text) of each of their nodes."""
    spark = texts.sparkSession
    mine = feats.where("size(cells) > 0 and id is not null")
    copies = S.saved(mine.select("id", "d1", "d2").join(classes.select("d1", "d2", "rep"), ["d1", "d2"]).where("id <> rep").select("id", "d1", "d2"), "copies")  # not made distinct, so that Spark can split a large group
    reps = mine.join(S.maybe_broadcast(copies, copies.count()), ["id", "d1", "d2"], "left_anti")
    shared = S.saved(reps.select(F.explode("cells").alias("cell")).groupBy("cell").count().where("count > 1").select("cell"), "shared")
    listed = reps.select("d1", "d2", "cells").mapInArrow(_listed(spark.sparkContext.broadcast(_filter_of(shared))), "cell long, d1 long, d2 long")
    member = listed.join(shared, "cell").join(classes.select("d1", "d2", F.col("node").alias("x")), ["d1", "d2"]).select("cell", "x").distinct()
    member, member_at = S.write_out(member, "members")
    # Of cells with equal members one is kept.
    marks = member.groupBy("cell").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("k"), F.bit_xor(F.xxhash64("x")).alias("h1"), F.bit_xor(F.xxhash64("x", F.lit(1))).alias("h2"))
    kept = marks.where("lo < hi").groupBy("lo", "hi", "k", "h1", "h2").agg(F.min("cell").alias("cell")).select("cell", "k")
    member, old = S.write_out(member.join(kept, "cell"), "members")
    S.remove(spark, member_at)
    S.free_shuffles(spark)

    nodes = S.saved(member.groupBy("x").agg(F.sum("k").alias("w")).join(classes.select(F.col("node").alias("x"), "n", "rep", "d1", "d2"), "x"), "nodes")
    ids = nodes.select(F.col("rep").alias("id")).distinct()
    many = nodes.count()
    found = texts.join(S.maybe_broadcast(ids, many), "id", "left_semi").mapInArrow(_texts_of(n), "id long, d1 long, d2 long, text string")
    near, near_at = S.write_out(found.join(S.maybe_broadcast(nodes.select("x", F.col("rep").alias("id"), "d1", "d2"), many), ["id", "d1", "d2"]).select("x", "text"), "near")
    own = near.mapInArrow(_members(n), "shingle long, x long").groupBy("shingle").agg(F.count("*").alias("holders"), F.min("x").alias("x")).where("holders = 1").groupBy("x").agg(F.count("*").alias("own"))
    able = nodes.select("x", "n", "w").join(own, "x", "left").withColumn("s", F.col("n") - F.coalesce("own", F.lit(0)))
    able = able.where(f"{100 + percent} * s >= {percent} * (n + ({percent} * n + 99) div 100)").select("x", "n", "s", "w")
    cells = S.saved(_fitting(member.select("cell", "x").join(able, "x").withColumn("comp", F.col("x")), percent), "cells")
    alive = S.saved(cells.select("x").distinct(), "alive")
    near = S.saved(near.join(S.maybe_broadcast(alive, alive.count()), "x", "left_semi"), "near")
    S.remove(spark, old, near_at)
    S.free_shuffles(spark)
    return cells, near


def _regions(known: DataFrame, cells: DataFrame, comps: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, p, nx, np) of a home and a boundary node of one pivot's region, of two components, that may link.

    known: the distances within 2 r of pivots. What two sets share inside a pivot is at most the less of what each shares
    with it, and outside it the less of what each shares with any other node.
    """
    shared = cells.groupBy("x").agg(F.max("s").alias("s"))
    sides = _with_components(known.select("x", "p", F.col("nx").alias("n"), F.col("both").alias("i"), F.expr(f"100 * both >= {percent} * (nx + np - both)").alias("home")).join(shared, "x"), comps)
    home = sides.where("home").select("p", F.col("x").alias("y"), F.col("n").alias("ny"), F.col("i").alias("iy"), F.col("s").alias("sy"), F.col("comp").alias("cy"))
    edge = sides.where("not home")
    return edge.join(home, "p").where(
        f"comp <> cy and 100 * least(n, ny) >= {percent} * greatest(n, ny) and {100 + percent} * least(s, sy, least(i, iy) + least(s - i, sy - iy)) >= {percent} * (n + ny)"
    ).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("p"), F.when(F.col("x") < F.col("y"), F.col("n")).otherwise(F.col("ny")).alias("nx"), F.when(F.col("x") < F.col("y"), F.col("ny")).otherwise(F.col("n")).alias("np")).distinct()


def _join(cells: DataFrame, near: DataFrame, n: int, percent: int) -> DataFrame | None:
    """(id, comp) of the nodes that links reach, by pivots and regions, level by level; None if there are no cells."""
    spark = cells.sparkSession
    comps = None
    level, window = 0, 2 * percent - 100  # percent of similarity at twice the radius
    linked = f"100 * both >= {percent} * (nx + np - both)"
    while not cells.isEmpty():
        slot = F.pmod(F.xxhash64("x", F.lit(level)), F.lit(PIVOTS * MORE_PIVOTS**level))
        best = F.max(F.struct("w", F.xxhash64("x").alias("h"), "x", "n", "s")).alias("t")
        pivots, pivots_at = S.write_out(cells.groupBy("cell", slot.alias("slot")).agg(best).select("cell", F.col("t.x").alias("p"), F.col("t.n").alias("np"), F.col("t.s").alias("sp")), "pivots")
        to = cells.join(pivots, "cell").where(f"x <> p and 100 * least(n, np) >= {window} * greatest(n, np) and {100 + window} * least(s, sp) >= {window} * (n + np)")
        known, known_at = _distances(to.select("x", "p", F.col("n").alias("nx"), "np").distinct(), near, n, window)
        comps = _merged(comps, known.where(linked))
        pairs, pairs_at = _distances(_regions(known, cells, comps, percent), near, n, percent)
        comps = _merged(comps, pairs.where(linked))
        # What is within r of a pivot of its cell is settled there, as are the pivots.
        homes = known.where(linked).select("x", "p")
        settled = cells.select("cell", "x").join(pivots.select("cell", "p"), "cell").join(homes, ["x", "p"]).select("cell", "x").union(pivots.select("cell", F.col("p").alias("x"))).distinct()
        cells = S.saved(_fitting(_with_components(cells.join(settled, ["cell", "x"], "left_anti"), comps).select("cell", "x", "n", "s", "w", "comp"), percent), "cells")
        S.remove(spark, pivots_at, known_at, pairs_at)
        S.free_shuffles(spark)
        level += 1
    return comps


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """Rows (id_col, n_shingles, component_id), one for each input row.

    Words are runs of anything but space and control characters 9 to 13, A-Z lower-cased; a set holds the distinct
    n-word shingles. Documents link when 100 * intersection >= percent * union; component_id is the smallest id that
    links lead to. Cases: null, empty or blank text has an empty set, links with nothing and is its own component;
    fewer than n words are one shingle; very long texts are cut up whole, in bounded buffers; each row is a document of
    its own, so rows that repeat an id are joined only if their texts are near; a row with a null id is returned with a
    null component; ties of pivots are broken by a hash of the node and change no result; an empty table gives an empty
    result; other columns are ignored.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    with S.small_batches(docs.sparkSession, BATCH):  # all that Python does is written out in here
        feats = S.saved(texts.mapInArrow(_features(n, percent), "id long, n long, d1 long, d2 long, cells array<long>"), "features")
        classes = S.saved(feats.where("n > 0 and id is not null").groupBy("d1", "d2", "n").agg(F.min("id").alias("rep")).withColumn("node", F.monotonically_increasing_id()), "classes")
        comps = _join(*_first_cells(texts, feats, classes, n, percent), n, percent)
    named = classes.select("d1", "d2", "rep", F.col("node").alias("x"))
    if comps is not None:
        least = comps.join(named.select(F.col("x").alias("id"), "rep"), "id").groupBy("comp").agg(F.min("rep").alias("least"))
        of = comps.join(least, "comp").select(F.col("id").alias("x"), "least")
        named = named.join(of, "x", "left").withColumn("rep", F.coalesce("least", "rep"))
    out = feats.select("id", "n", "d1", "d2").join(named.select("d1", "d2", "rep"), ["d1", "d2"], "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("rep", "id")).alias("component_id"))


#: DuckDB SQL of the same result: every two documents that share a shingle are counted.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                 ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS sh FROM w),
u AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS sh FROM s),
l AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM u a JOIN u b ON a.sh = b.sh AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM s UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y)
SELECT s.doc_id, len(s.sh) AS n_shingles, min(r.y) AS component_id FROM s JOIN r ON r.x = s.doc_id GROUP BY s.doc_id, s.sh"""
