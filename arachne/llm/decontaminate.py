"""Benchmark decontamination: every passage of every document queries a BM25 index of test items with block-max WAND.

The index holds, for each term, the items with it in blocks, and the largest impact of each block. An item's impacts
are BM25 weights divided by the least score that a passage can have which holds enough of the item to count as a leak,
so the threshold is 1 for every item and no leak falls below it. Items of like length share an index, and passages are
cut to fit it. Upper bounds of all passages, first over all items, then over blocks of items, are summed in numpy; the
passages that may reach the threshold go through block-max WAND, which retrieves every item at or above it. A
retrieved item counts if its question and its answer both overlap the document, or, where it marks no such parts, all
of it does.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arachne.llm import kernels as K

K1, B = 1.2, 0.75
#: Share of the question's and of the answer's shingles that the document must hold, in percent.
OVERLAP = 80
SHINGLE = 5
POSTING_BLOCK = 16
#: Cells of the table of block bounds: a larger index gets longer blocks there.
BOUND_CELLS = 1 << 23
#: Items of one index: the size of what is sent to the executors is bounded by this; more items make more indexes.
INDEX_ITEMS = 20_000
#: Indexes that a task holds at once; more items make more passes over the corpus.
PASS_INDEXES = 8
SLACK = 1e-6
#: Where an answer begins: at its label at the start of a line, or after a question mark that ends a line.
ANSWER = re.compile(r"^[ \t]*(?:answer|a|response|solution)[ \t]*:", re.I | re.M)
ASKED = re.compile(r"\?[\"'»”)]*[ \t]*\r?\n")


def split_item(text: str, n: int = SHINGLE, overlap: int = OVERLAP) -> tuple[str, str]:
    """(question, answer) of an item that marks them, by a label of the answer or by a question mark that ends a line; else (text, "").

    A part counts by itself only if it still has overlap percent of its shingles when two of its words are glued
    together, which takes up to n + 1 of them. Otherwise all is the question, and the whole item's shingles decide.
    """
    body = text.strip()
    at = next((m.start() for m in ANSWER.finditer(body)), 0) or max((m.end() for m in ASKED.finditer(body)), default=0)
    parts = body[:at], body[at:]
    if at and all(100 * (n + 1) <= (100 - overlap) * len(s) for s in K.shingle_sets(pa.array(parts), n)):
        return parts
    return text, ""


@dataclass
class Index:
    """Items of up to `step` words. postings: of each term the items, impacts, and last item and largest impact of each block."""

    step: int
    items: list[int]
    terms: np.ndarray  # sorted hashes
    bound: np.ndarray  # largest impact of each term
    blocks: np.ndarray  # the same for each term and block of items
    postings: list[tuple[list[int], list[float], list[int], list[float]]]
    parts: list[tuple[np.ndarray, np.ndarray]]  # shingles of question and answer


def build_indexes(rows: list[tuple[int, str]], n: int = SHINGLE, overlap: int = OVERLAP) -> list[Index]:
    """Indexes of (item_id, text) by length; items without words are left out, as nothing overlaps them."""
    items = []
    for item, text in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        h, _ = K.words(*K.utf8(pa.array([text or ""])))
        if len(h):
            items.append((item, Counter(h.tolist()), tuple(K.shingle_sets(pa.array(split_item(text or "", n, overlap)), n))))
    df = Counter(t for _, w, _ in items for t in w)
    mean = sum(sum(w.values()) for _, w, _ in items) / max(1, len(items))
    classes: dict[int, list] = {}
    for item, w, parts in items:
        size = sum(w.values())
        score = {t: math.log(1 + (len(items) - df[t] + 0.5) / (df[t] + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * size / mean)) for t, c in w.items()}
        # A missing word takes at least one shingle with it, so this many words may be missing from a leak.
        missing = sum(len(p) * (100 - overlap) // 100 for p in parts)
        least = sum(score.values()) - sum(sorted(score.values())[len(score) - min(missing, len(score)) :])
        step = max(16, 1 << (size - 1).bit_length())
        classes.setdefault(step, []).append((item, {t: x / least if least > 0 else 1e9 for t, x in score.items()}, parts, size))
    out = []
    for step, members in sorted(classes.items()):
        members.sort(key=lambda m: m[3])
        by_term: dict[int, list[tuple[int, float]]] = {}
        for i, (_, impacts, _, _) in enumerate(members):
            for t, x in impacts.items():
                by_term.setdefault(t, []).append((i, x))
        terms = np.array(sorted(by_term), np.uint64)
        width = max(POSTING_BLOCK, -(-len(members) * len(terms) // BOUND_CELLS))
        blocks = np.zeros((len(terms), -(-len(members) // width)), np.float32)
        postings = []
        for k, t in enumerate(terms.tolist()):
            ids, weights = [p[0] for p in by_term[t]], [p[1] for p in by_term[t]]
            np.maximum.at(blocks[k], np.array(ids) // width, np.array(weights, np.float32))
            cut = range(0, len(ids), POSTING_BLOCK)
            postings.append((ids, weights, [ids[min(c + POSTING_BLOCK, len(ids)) - 1] for c in cut], [max(weights[c : c + POSTING_BLOCK]) for c in cut]))
        out.append(Index(step, [m[0] for m in members], terms, blocks.max(axis=1).astype(np.float64), blocks, postings, [m[2] for m in members]))
    return out


def search(index: Index, terms: list[int], threshold: float = 1.0) -> list[tuple[int, float]]:
    """All (item position, score) with score >= threshold for a query of distinct terms, by block-max WAND."""
    threshold -= SLACK
    cursors = [[index.postings[t][0][0], 0, *index.postings[t], float(index.bound[t])] for t in terms]  # item, place, items, impacts, block ends, block bounds, bound
    found = []
    while cursors:
        cursors.sort(key=itemgetter(0))
        total, pivot = 0.0, -1
        for i, c in enumerate(cursors):
            total += c[6]
            if total >= threshold:
                pivot = i
                break
        if pivot < 0:
            break
        item = cursors[pivot][0]
        while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
            pivot += 1
        moved = cursors[: pivot + 1]
        # The blocks that may hold the item: if even their bounds fall short, go on to where one of them ends.
        bound, stops = 0.0, [c[0] for c in cursors[pivot + 1 : pivot + 2]]
        for c in moved:
            b = bisect_left(c[4], item)
            if b < len(c[4]):
                bound += c[5][b]
                stops.append(c[4][b] + 1)
        if bound < threshold:
            target = max(item + 1, min(stops, default=item + 1))
        elif cursors[0][0] == item:
            score = sum(c[3][c[1]] for c in moved)
            if score >= threshold:
                found.append((item, score))
            target = item + 1
        else:
            target = item
        for c in moved:
            c[1] = bisect_left(c[2], target, c[1])
            c[0] = c[2][c[1]] if c[1] < len(c[2]) else None
        cursors = [c for c in cursors if c[0] is not None]
    return found


def candidates(index: Index, h: np.ndarray, counts: np.ndarray) -> dict[int, set[int]]:
    """For each text (by place) the items that a passage of it retrieves. h: word hashes of all texts; counts: words of each.

    Passages have 2 * step words and begin every step words, so any run of step words lies in one of them.
    """
    hits: dict[int, set[int]] = {}
    step = index.step
    at = np.searchsorted(index.terms, h)
    at[at == len(index.terms)] = 0
    place = np.flatnonzero(index.terms[at] == h)
    term = at[place]
    if not len(place):
        return hits
    # The last place of the same term: a passage counts each term once.
    order = np.lexsort((place, term))
    before = np.full(len(place), -1)
    same = term[order][1:] == term[order][:-1]
    before[order[1:][same]] = place[order[:-1][same]]
    ends = np.cumsum(counts)
    begins = ends - counts
    own = np.searchsorted(ends, place, "right")
    slots = np.maximum(1, -(-(counts - step) // step)) * (counts > 0)
    slot_of = np.cumsum(slots) - slots
    members, passage = [], []
    for back in (0, 1):  # each place lies in the passage that begins in its step, and in the one before
        k = (place - begins[own]) // step - back
        ok = (k >= 0) & (k < slots[own])
        ok &= before < begins[own] + k * step
        members.append(term[ok])
        passage.append((slot_of[own] + k)[ok])
    members, passage = np.concatenate(members), np.concatenate(passage)
    total = np.bincount(passage, weights=index.bound[members], minlength=int(slots.sum()))
    keep = total[passage] >= 1 - SLACK
    members, passage = members[keep], passage[keep]
    if not len(members):
        return hits
    order = np.argsort(passage, kind="stable")
    members, passage = members[order], passage[order]
    first = np.flatnonzero(np.append(True, passage[1:] != passage[:-1]))
    last = np.append(first[1:], len(members))
    for lo in range(0, len(first), 256):
        part = slice(first[lo], last[min(lo + 256, len(first)) - 1])
        sums = np.add.reduceat(index.blocks[members[part]], first[lo : lo + 256] - first[lo], axis=0)
        for j in np.flatnonzero(sums.max(axis=1) >= 1 - 100 * SLACK).tolist():
            found = search(index, members[first[lo + j] : last[lo + j]].tolist())
            if found:
                text = int(np.searchsorted(slot_of + slots, passage[first[lo + j]], "right"))
                hits.setdefault(text, set()).update(i for i, _ in found)
    return hits


def _found(column: pa.Array, sent: list, overlap: int, n: int) -> Iterator[tuple]:
    """(place in the column, item id, question hits, question shingles, answer hits, answer shingles) of each leak."""
    h, counts = K.words(*K.utf8(column))
    sets: dict[int, np.ndarray] = {}
    for indexes in sent if len(h) else []:
        for index in indexes.value:
            for i, items in candidates(index, h, counts).items():
                if i not in sets:
                    sets[i] = K.shingle_sets(column.slice(i, 1), n)[0]
                for item in sorted(items):
                    q, a = index.parts[item]
                    nq, na = K.common(sets[i], q), K.common(sets[i], a)
                    if 100 * nq >= overlap * len(q) and 100 * na >= overlap * len(a):
                        yield i, index.items[item], nq, len(q), na, len(a)


def _query(sent: list, overlap: int, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(b.column(0)[i].as_py(), *rest) for i, *rest in _found(b.column(1), sent, overlap, n)]
            cols = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "item_id", "question_hits", "question_shingles", "answer_hits", "answer_shingles"])

    return run


def _clean(sent: list, text_col: str, overlap: int, n: int):
    """The rows, whole, into which no item leaks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.ones(b.num_rows, bool)
            for i, *_ in _found(b.column(text_col).cast(pa.string()), sent, overlap, n):
                keep[i] = False
            yield b.filter(pa.array(keep))

    return run


def _passes(benchmark: DataFrame, item_col: str, item_text_col: str, n: int, overlap: int) -> Iterator[list]:
    """Broadcast indexes of INDEX_ITEMS items each; those of one list go through the corpus in one pass."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text_col).cast("string").alias("t")).where("i is not null and t is not null")
    shards = max(1, -(-items.count() // INDEX_ITEMS))
    for lo in range(0, shards, PASS_INDEXES):
        part = [items if shards == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(shards)) == k) for k in range(lo, min(lo + PASS_INDEXES, shards))]
        yield [spark.sparkContext.broadcast(build_indexes([(r.i, r.t) for r in p.toLocalIterator()], n, overlap)) for p in part]


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", overlap: int = OVERLAP, n: int = SHINGLE) -> DataFrame:
    """Rows (doc_id, item_id, question_hits, question_shingles, answer_hits, answer_shingles), one for each leak.

    An item leaks into a document if the document holds at least overlap percent of the n-word shingles of the item, or
    of its question and of its answer where it marks both (see split_item; the answer's columns are 0 elsewhere), with
    enough of its words in one passage. Cases: null or empty texts and items leak nothing; an item of fewer than n
    words counts as one shingle, which only a document of just these words holds; very long texts are queried whole, in
    passages; repeated rows give repeated leaks; a null id stays null; an item id given twice is two items; ties of
    scores are all retrieved; an empty table gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shape = "doc_id long, item_id long, question_hits long, question_shingles long, answer_hits long, answer_shingles long"
    out = None
    for sent in _passes(benchmark, item_col, item_text_col, n, overlap):
        found = rows.mapInArrow(_query(sent, overlap, n), shape)
        out = found if out is None else out.unionByName(found)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", overlap: int = OVERLAP, n: int = SHINGLE) -> DataFrame:
    """The rows of docs, in all their columns, into which no item leaks by the rule of leaks().

    Every row is judged by its own text, in the one pass that reads it, so null and repeated ids, repeated rows and
    columns of any name are no matter. Null and empty texts stay; an empty table gives an empty result.
    """
    for sent in _passes(benchmark, item_col, item_text_col, n, overlap):
        docs = docs.mapInArrow(_clean(sent, text_col, overlap, n), docs.schema)
    return docs


#: DuckDB SQL of the same result for items that mark no question and answer.
ORACLE = r"""
WITH w AS (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark),
v AS (
  SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM w),
s AS (
  SELECT kind, id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                   ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS sh FROM v),
u AS (SELECT kind, id, len(sh) AS n, unnest(sh) AS sh FROM s)
SELECT d.id AS doc_id, i.id AS item_id, count(*) AS question_hits, i.n AS question_shingles, 0::BIGINT AS answer_hits, 0::BIGINT AS answer_shingles
FROM u i JOIN u d ON d.sh = i.sh AND d.kind = 'd' AND i.kind = 'i' GROUP BY d.id, i.id, i.n HAVING 100 * count(*) >= 80 * i.n"""
