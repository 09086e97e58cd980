"""Token counts of documents in flat token files that have no index: only end-of-document ids tell where documents end.

A file is a stream of little-endian 16-bit ids, read in blocks that may cut a document anywhere. Each block is searched
for the separator with one vectorised comparison. A prefix scan over small block summaries (ids, separators, place of
the last separator) then stitches what crosses block borders: the ordinal and the start of each block's first document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arachne.llm import shared as S
from arachne.llm import tokenize

#: Ids of a block.
BLOCK = 1 << 18
#: Blocks that one step of the scan handles; beyond them a second level scans their sums.
SPAN = 1024


def _write(vocabulary: str, end_id: int, block: int):
    """Blocks (file, block, data, docs) of the tokenised texts: docs lists the ids of documents that end in the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, file, k = tokenize.encoder(vocabulary), TaskContext.get().partitionId(), 0
        rest, ends = np.zeros(0, "<u2"), np.zeros(0, np.int64)
        docs: list = []

        def cut(n: int) -> pa.RecordBatch:
            nonlocal rest, ends, docs, k
            own = int(np.searchsorted(ends, n))
            out = pa.RecordBatch.from_arrays(
                [pa.array([file], pa.int64()), pa.array([k], pa.int64()), pa.array([rest[:n].tobytes()], pa.binary()), pa.array([docs[:own]], pa.list_(pa.int64()))],
                names=["file", "block", "data", "docs"],
            )
            rest, ends, docs, k = rest[n:], ends[own:] - n, docs[own:], k + 1
            return out

        for b in batches:
            ids, counts = encode(b.column(1))
            if max(int(ids.max(initial=0)), end_id) > 0xFFFF:
                raise ValueError("a token file holds 16-bit ids, and this vocabulary has larger ones")
            at = np.cumsum(counts)
            flat = np.insert(ids, at, end_id).astype("<u2")
            ends = np.concatenate([ends, at + np.arange(len(at)) + len(rest)])
            rest = np.concatenate([rest, flat])
            docs += b.column(0).cast(pa.int64()).to_pylist()
            while len(rest) >= block:
                yield cut(block)
        if len(rest):
            yield cut(len(rest))

    return run


def write_token_blocks(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 50256, block: int = BLOCK) -> DataFrame:
    """Tokenises texts into flat files, saved in blocks (file, block, data, docs)."""
    texts = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return S.saved(texts.mapInArrow(_write(vocabulary, end_id, block), "file long, block long, data binary, docs array<long>"), "tokens")


def read_token_files(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """Blocks (path as file, block, data) of flat files of 16-bit ids that lie under path.

    Spark reads a file whole, so one has 2 GB at most; its blocks are cut once. A file with an odd byte at its end is an error.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    whole = F.when(F.length("content") % 2 == 0, F.col("content")).otherwise(F.raise_error(F.concat(F.lit("odd length: "), "path")).cast("binary"))
    cut = F.expr(f"transform(sequence(0L, greatest(length(content) - 1, 0) div {2 * block}), i -> struct(i as block, substring(content, cast(i * {2 * block} + 1 as int), {2 * block}) as data))")
    return files.select(F.xxhash64("path").alias("file"), whole.alias("content")).select("file", F.inline(cut))


def _scan(end_id: int):
    """For each block: rows (file, block, k, at, ids): k-th separator (from 0) and its place; k = -1 holds the block's length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = []
            for file, block, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                ids = np.frombuffer(data.as_buffer(), "<u2")
                seps = np.flatnonzero(ids == end_id)
                parts.append((np.full(len(seps) + 1, file), np.full(len(seps) + 1, block), np.arange(-1, len(seps)), np.append(len(ids), seps)))
            if parts:
                cols = [np.concatenate(c).astype(np.int64) for c in zip(*parts, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["file", "block", "k", "at"])

    return run


def count_tokens(blocks: DataFrame, end_id: int = 50256) -> DataFrame:
    """Rows (file, ordinal, block, k, start, n_tokens), one for each separator in blocks (file, block, data).

    ordinal counts a file's documents from 0, start is the place of its first id in the file, n_tokens leaves the
    separator out; block and k say where the separator stands. Cases: ids after a file's last separator are an
    unfinished document and give no row; two separators in a row give a document of 0 ids; a file without separators
    gives none; an odd last byte fails, as the file is then damaged.
    """
    found = S.saved(blocks.select("file", "block", "data").mapInArrow(_scan(end_id), "file long, block long, k long, at long"), "separators")
    one = found.groupBy("file", "block").agg(
        F.max(F.when(F.col("k") < 0, F.col("at"))).alias("ids"), F.sum(F.when(F.col("k") >= 0, 1).otherwise(0)).alias("seps"), F.max(F.when(F.col("k") >= 0, F.col("at"))).alias("last")
    )
    one = S.saved(one.withColumn("span", F.expr(f"block div {SPAN}")), "summaries")

    def scan(df: DataFrame, by: list[str], order: str) -> DataFrame:
        before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        df = df.withColumns({"ids_before": F.coalesce(F.sum("ids").over(before), F.lit(0)), "seps_before": F.coalesce(F.sum("seps").over(before), F.lit(0))})
        return df.withColumn("last_before", F.max(F.col("ids_before") + F.col("last")).over(before))

    inner = scan(one, ["file", "span"], "block")
    spans = inner.groupBy("file", "span").agg(F.sum("ids").alias("ids"), F.sum("seps").alias("seps"), F.max(F.col("ids_before") + F.col("last")).alias("last"))
    spans = scan(spans, ["file"], "span").select("file", "span", F.col("ids_before").alias("ids_0"), F.col("seps_before").alias("seps_0"), F.col("last_before").alias("last_0"))
    placed = inner.join(spans, ["file", "span"]).select(
        "file", "block", (F.col("ids_before") + F.col("ids_0")).alias("ids_0"), (F.col("seps_before") + F.col("seps_0")).alias("seps_0"),
        F.coalesce(F.col("last_before") + F.col("ids_0"), F.col("last_0"), F.lit(-1)).alias("last_0"),
    )
    seps = found.where("k >= 0").join(placed, ["file", "block"])
    before = Window.partitionBy("file", "block").orderBy("k")
    seps = seps.withColumn("start", F.coalesce(F.lag("at").over(before) + F.col("ids_0"), F.col("last_0")) + 1)
    return seps.select("file", (F.col("seps_0") + F.col("k")).alias("ordinal"), "block", "k", "start", (F.col("at") + F.col("ids_0") - F.col("start")).alias("n_tokens"))


def document_token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 50256) -> DataFrame:
    """Rows (doc_id, n_tokens, file, ordinal, start): writes flat token files of the texts and counts from them alone.

    Cases: null or empty text counts 0; rows that repeat an id are counted each; null ids stay null; an empty table
    gives an empty result; other columns are ignored.
    """
    blocks = write_token_blocks(docs, vocabulary, id_col, text_col, end_id)
    names = blocks.select("file", "block", F.posexplode("docs").alias("k", "doc_id"))
    return count_tokens(blocks, end_id).join(names, ["file", "block", "k"]).select("doc_id", "n_tokens", "file", "ordinal", "start")
