"""Packing of tokenised documents into fixed-length sequences by a grouping genetic algorithm on islands.

Pieces that fill a sequence are sequences. The others are dealt to shards of bounded size, and each shard to islands
that evolve it from different seeds. A chromosome is a list of bins (the groups), not of items: crossover injects the
best-filled bins of one parent into the other, removes the bins that now hold duplicates, and puts the displaced pieces
back by best fit. Between epochs the elite of each island migrates to the next island of its shard. Then the bins that
a shard's best packing leaves loose are opened, and their pieces are dealt to fewer shards and packed again.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arachne.llm import shared as S
from arachne.llm import tokenize

#: Pieces of a shard: what one task holds at once.
SHARD = 4096
ISLANDS = 3
EPOCHS = 3
GENERATIONS = 12
POPULATION = 6
#: A bin that is filled to this share stays as it is; others are opened for the next round.
TIGHT = 0.98
ROUNDS = 3

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, uid long"


def _cut(vocabulary: str, size: int, end_id: int):
    """Rows PIECES of rows (doc_id, text); uid is unique, from the task and the place in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = tokenize.encoder(vocabulary, special=True)
        uid = TaskContext.get().partitionId() << 34
        for b in batches:
            ids, counts = encode(b.column(1))
            docs = b.column(0).cast(pa.int64()).to_pylist()
            rows: list[tuple] = []
            at = 0
            for doc, n in zip(docs, counts.tolist(), strict=True):
                own = np.append(ids[at : at + n], end_id).astype("<u4")
                at += n
                lo, k = 0, 0
                hi = len(own) if len(own) <= size else len(own) % size or size
                while lo < len(own):
                    rows.append((doc, k, lo, hi - lo, zlib.crc32(own[lo:hi]), uid))
                    uid += 1
                    lo, hi, k = hi, hi + size, k + 1
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "uid"])

    return run


def best_fit(bins: list[list[int]], loads: list[int], items: list[int], size: list[int], room: int) -> None:
    """Puts items, longest first, each into the fullest bin that takes it; opens new bins. Changes bins and loads."""
    free = sorted((room - x, i) for i, x in enumerate(loads) if x < room)
    for item in sorted(items, key=lambda i: (-size[i], i)):
        need = size[item]
        at = bisect_left(free, (need, -1))
        if at < len(free):
            left, b = free.pop(at)
            bins[b].append(item)
            loads[b] += need
        else:
            b, left = len(bins), room
            bins.append([item])
            loads.append(need)
        if left > need:
            insort(free, (left - need, b))


def fitness(loads: list[int], room: int) -> float:
    """Mean square fill: more for fewer bins, and for full ones beside loose ones at the same number."""
    return sum((x / room) ** 2 for x in loads) / max(1, len(loads))


def crossover(a: tuple, b: tuple, size: list[int], room: int, rng: np.random.Generator) -> tuple:
    """A child of b into which a random share of a's well-filled bins is injected whole."""
    abins, aloads = a
    bbins, bloads = b
    order = sorted(range(len(abins)), key=lambda i: -aloads[i])
    gift = [i for i in order[: max(1, len(order) * 3 // 4)] if rng.random() < 0.5] or order[:1]
    taken = {x for i in gift for x in abins[i]}
    bins, loads, loose = [list(abins[i]) for i in gift], [aloads[i] for i in gift], []
    for members, load in zip(bbins, bloads, strict=True):
        if taken.isdisjoint(members):
            bins.append(list(members))
            loads.append(load)
        else:
            loose += [x for x in members if x not in taken]
    best_fit(bins, loads, loose, size, room)
    return bins, loads


def mutate(a: tuple, size: list[int], room: int, rng: np.random.Generator) -> tuple:
    """Opens the loosest bins and some others, and puts their pieces back by best fit."""
    bins, loads = a
    order = sorted(range(len(bins)), key=lambda i: loads[i])
    opened = set(order[: max(2, len(order) // 50)]) | set(rng.integers(0, len(bins), max(1, len(bins) // 20)).tolist())
    keep = [i for i in range(len(bins)) if i not in opened]
    loose = [x for i in opened for x in bins[i]]
    nb, nl = [list(bins[i]) for i in keep], [loads[i] for i in keep]
    best_fit(nb, nl, loose, size, room)
    return nb, nl


def evolve(size: list[int], room: int, seed: int, elite: list[int] | None = None, generations: int = GENERATIONS, population: int = POPULATION) -> list[int]:
    """The bin of each item in the best packing found. elite: such a list from another island, which joins the population."""
    rng = np.random.default_rng(seed)
    every = list(range(len(size)))
    least = -(-sum(size) // room)

    def packed(order: list[int], share: float) -> tuple:
        bins, loads = [], []
        first = order[: int(len(order) * share)]
        for i in range(0, len(first), 3):  # a few random small groups, so that individuals differ
            group, load = [], 0
            for x in first[i : i + 3]:
                if load + size[x] <= room:
                    group.append(x)
                    load += size[x]
            bins.append(group)
            loads.append(load)
        placed = {x for g in bins for x in g}
        best_fit(bins, loads, [x for x in order if x not in placed], size, room)
        return bins, loads

    people = [packed(every, 0.0)]
    if len(people[0][0]) > least:  # a packing at the lower bound can't be bettered
        people += [packed(rng.permutation(every).tolist(), 0.1 * k) for k in range(1, population)]
    if elite is not None:
        bins: list[list[int]] = [[] for _ in range(max(elite, default=-1) + 1)]
        for i, b in enumerate(elite):
            bins[b].append(i)
        people.append((bins, [sum(size[x] for x in g) for g in bins]))
    rank = lambda p: (len(p[0]), -fitness(p[1], room))
    people.sort(key=rank)
    for _ in range(generations):
        if len(people[0][0]) <= least:
            break
        i, j = rng.integers(0, len(people), 2).tolist()
        people += [crossover(people[0], people[max(1, i)], size, room, rng), crossover(people[j], people[0], size, room, rng), mutate(people[0], size, room, rng)]
        people = sorted(people, key=rank)[:population]
    out = [0] * len(size)
    for b, members in enumerate(people[0][0]):
        for x in members:
            out[x] = b
    return out


def _island(room: int, epoch: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("uid", kind="stable")
        elite = pdf["bin"].tolist() if epoch else None
        bins = evolve(pdf["length"].tolist(), room, int(pdf["shard"].iloc[0]) * 1000 + int(pdf["island"].iloc[0]) * 10 + epoch, elite)
        # The elite migrates: the next epoch's rows of the next island carry it.
        out = pdf.assign(bin=np.array(bins, np.int32), island=(pdf["island"] + 1) % ISLANDS)
        fill = out.groupby("bin")["length"].sum()
        return out.assign(bins=np.int32(len(fill)), fit=float(np.square(fill.to_numpy() / room).mean()))

    return run


def _choose(room: int, tight: float, last: bool):
    """The shard's best packing over its islands; offset in the bin; open: the bin is loose and goes to the next round."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        best = min(((g["bins"].iloc[0], -g["fit"].iloc[0], i) for i, g in pdf.groupby("island")))[2]
        own = pdf[pdf["island"] == best].sort_values(["bin", "uid"], kind="stable")
        grouped = own.groupby("bin")["length"]
        fill = grouped.transform("sum")
        return pd.DataFrame({"uid": own["uid"], "shard": own["shard"], "bin": own["bin"], "length": own["length"], "place": grouped.cumsum() - own["length"], "open": (fill < tight * room) & (not last)})

    return run


def pack_lengths(pieces: DataFrame, room: int) -> DataFrame:
    """Rows (uid, sequence_id, offset) for rows (uid, length) with 1 <= length <= room and unique uid."""
    spark = pieces.sparkSession
    full = pieces.where(F.col("length") == room).select("uid", (F.col("uid") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    left, done = pieces.where(F.col("length") < room).select("uid", "length"), [full]
    layout = "uid long, length long, shard long, island int, bin int, bins int, fit double"
    for level in range(ROUNDS):
        rows = left.count()
        if not rows:
            break
        shards = -(-rows // SHARD)
        last = level == ROUNDS - 1 or shards == 1
        islands = left.select("uid", "length", F.pmod(F.xxhash64("uid", F.lit(level)), F.lit(shards)).alias("shard"), F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])).alias("island"))
        islands = islands.withColumns({"bin": F.lit(0), "bins": F.lit(0), "fit": F.lit(0.0)})
        for epoch in range(EPOCHS):
            islands = islands.groupBy("shard", "island").applyInPandas(_island(room, epoch), layout)
        chosen = S.saved(islands.groupBy("shard").applyInPandas(_choose(room, TIGHT, last), "uid long, shard long, bin int, length long, place long, open boolean"), "packed")
        done.append(chosen.where("not open").select("uid", ((F.shiftleft(F.col("shard"), 20) + F.col("bin")) * 8 + level * 2).alias("sequence_id"), F.col("place").alias("offset")))
        left = chosen.where("open").select("uid", "length")
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out


def pack_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, end_id: int = 0) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, sequence_id, offset), one for each piece of each document.

    A document's ids are those of its text by the tokenizers library, which reads the string of a special token as that
    token, followed by end_id. Only documents longer than size are cut, from their end
    into pieces of size, so that the first may be shorter. Every sequence holds at most size ids, gapless from 0.
    Cases: null or empty text is the single id end_id; very long texts are tokenised whole; rows that repeat an id are
    packed each; null ids stay null; ties of lengths go by the pieces' order; an empty table gives an empty result;
    other columns are ignored.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = S.saved(texts.mapInArrow(_cut(vocabulary, size, end_id), PIECES), "pieces")
    return pieces.join(pack_lengths(pieces.select("uid", "length"), size), "uid").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
