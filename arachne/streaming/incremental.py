"""Operators over unbounded events: node memories, association strengths that decay, incremental ingestion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from arachne.operators.retrieval import decay, remember, tokens

#: Numbers that the gates of a block of events may take.
BLOCK = 1 << 21


def gru_cell(hidden: np.ndarray, inputs: np.ndarray, w: dict[str, np.ndarray]) -> np.ndarray:
    """One step of a gated recurrent unit; w has wz, wr, wn (inputs) and uz, ur, un (hidden)."""
    s = lambda v: 1 / (1 + np.exp(-v))
    z, r = s(w["wz"] @ inputs + w["uz"] @ hidden), s(w["wr"] @ inputs + w["ur"] @ hidden)
    n = np.tanh(w["wn"] @ inputs + r * (w["un"] @ hidden))
    return (1 - z) * n + z * hidden


def gru_weights(node: int, edge: int, seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    k = node**-0.5
    return {n + g: rng.uniform(-k, k, (node, 2 * node + edge if n == "w" else node)) for g in "zrn" for n in "wu"}


def pair_weights(w: dict[str, np.ndarray], node: int) -> tuple[np.ndarray, np.ndarray]:
    """Matrices from both memories (u's, v's), and from the feature, to the gates z, r, n of both ends and the n gate's hidden part.

    What goes into a sigmoid, and the hidden part, is halved: s(x) = (tanh(x / 2) + 1) / 2.
    """
    parts, feature = [], []
    for g, by in (("z", 0.5), ("r", 0.5), ("n", 1)):
        own, other, f = np.split(w["w" + g] * by, [node, 2 * node], axis=1)
        own = own + w["u" + g] * by if g != "n" else own
        parts.append(np.block([[own, other], [other, own]]))
        feature += [f, f]
    return np.vstack([*parts, np.kron(np.eye(2), w["un"] / 2)]), np.vstack(feature)


def _levels(us: list, vs: list, slot: dict) -> tuple[np.ndarray, np.ndarray]:
    """Slots of both ends, and the level of each event: one more than the highest earlier one at its ends. New nodes get the next slots."""
    at, levels, last = [], [], {}
    for u, v in zip(us, vs):
        i, j = slot.setdefault(u, len(slot)), slot.setdefault(v, len(slot))
        last[i] = last[j] = k = max(last.get(i, -1), last.get(j, -1)) + 1
        at.append((i, j))
        levels.append(k)
    return np.array(at), np.array(levels)


def _fold(memory: np.ndarray, at: np.ndarray, levels: np.ndarray, features: np.ndarray, mix: np.ndarray, mix_feature: np.ndarray) -> None:
    """gru_cell at both ends of all events, one level at a time. memory: flat, by slot.

    Levels are as narrow as the hubs are few, so calls count: a level's numbers lie together, one row for each gate, and
    results go to arrays made once for each width.
    """
    order, width = np.argsort(levels, kind="stable"), np.bincount(levels)
    start, node = np.cumsum(width) - width, mix.shape[1] // 2
    levels = levels[order]

    def lay(x: np.ndarray) -> np.ndarray:
        """Rows of events by level, then column, then event."""
        out, k = np.empty(x.size, x.dtype), x.shape[1]
        out[(start[levels] * k + np.arange(len(x)) - start[levels])[:, None] + width[levels][:, None] * np.arange(k)] = x
        return out

    place = lay((at[order][:, :, None] * node + np.arange(node)).reshape(len(at), 2 * node))
    given = lay(features[order] @ mix_feature.T)
    rooms: dict[int, tuple] = {}
    for a, b in zip(start.tolist(), width.tolist()):
        if b not in rooms:
            old, x = np.empty((2 * node, b)), np.empty((8 * node, b))
            rooms[b] = old, old.reshape(-1), x, x[: 6 * node].reshape(-1), x[: 4 * node], x[: 2 * node], x[2 * node : 4 * node], x[4 * node : 6 * node], x[6 * node :]
        old, flat, x, inputs, zr, z, r, n, hidden = rooms[b]
        i = place[2 * node * a : 2 * node * (a + b)]
        memory.take(i, out=flat, mode="clip")
        np.dot(mix, old, x)
        np.add(inputs, given[6 * node * a : 6 * node * (a + b)], inputs)
        np.tanh(zr, zr)
        np.add(zr, 1, zr)
        np.multiply(r, hidden, hidden)
        np.add(n, hidden, n)
        np.tanh(n, n)
        np.subtract(old, n, old)
        np.multiply(old, z, old)
        np.multiply(old, 0.5, old)
        np.add(old, n, old)
        memory[i] = flat


def fold_events(batches: Iterator[pa.RecordBatch], w: dict[str, np.ndarray], node: int, edge: int, block: int) -> Iterator[pa.RecordBatch]:
    """(id, memory) after batches of (component, u, v, feature) in order; a block of so many events is held at once, and all nodes' memories.

    Events of a block that no chain of shared nodes puts in order are computed together. A null v is a node of its own in each component.
    """
    mix, mix_feature = pair_weights(w, node)
    slot: dict = {}
    memory = np.zeros(1024 * node)

    def take(held: list[pa.RecordBatch]) -> None:
        nonlocal memory
        rows = pa.Table.from_batches(held)
        us, vs, lists = rows["u"].to_pylist(), rows["v"].to_pylist(), rows["feature"]
        if pc.any(pc.not_equal(pc.fill_null(pc.list_value_length(lists), -1), edge)).as_py():
            raise ValueError(f"a feature has {edge} numbers")
        if rows["v"].null_count:
            vs = [(c,) if v is None else v for v, c in zip(vs, rows["component"].to_pylist())]
        at, levels = _levels(us, vs, slot)
        if len(slot) * node > len(memory):
            memory = np.concatenate([memory, np.zeros(max(len(slot) * node, 2 * len(memory)) - len(memory))])
        features = pc.list_flatten(lists).to_numpy().astype(float).reshape(len(us), edge)
        _fold(memory, at, levels, features, mix, mix_feature)

    held, n = [], 0
    for batch in batches:
        while batch.num_rows:
            held.append(batch.slice(0, block - n))
            batch, n = batch.slice(block - n), n + held[-1].num_rows
            if n == block:
                take(held)
                held, n = [], 0
    if n:
        take(held)
    names = [None if isinstance(k, tuple) else k for k in slot]
    for k in range(0, len(names), block):
        some = names[k : k + block]
        lists = pa.ListArray.from_arrays(np.arange(len(some) + 1, dtype=np.int32) * node, memory[k * node : (k + len(some)) * node])
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), lists], ["id", "memory"])


def temporal_memory(events: DataFrame, node: int, edge: int, weights: dict[str, np.ndarray] | None = None) -> DataFrame:
    """(id, memory) after events (u, v, feature array, ts, event_id), in order of (ts, event_id).

    At each event both ends are updated from the memories that both had before: inputs are u's, v's and the feature.
    Events touch two nodes, so order matters within a connected part of the event graph only, and parts run side by
    side. A part goes through one task, of any number of events: Spark sorts them on disk, the task holds a block of
    them and the memories of its nodes.
    """
    from arachne.operators.components import labels

    w = weights or gru_weights(node, edge)
    block = max(256, BLOCK // (8 * node))
    ends = events.select(F.col("u").alias("src"), F.col("v").alias("dst")).distinct()
    ids = ends.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    part = labels(ids, ends)
    rows = events.join(part.withColumnRenamed("id", "u"), "u").select("component", "u", "v", F.col("feature").cast("array<double>").alias("feature"), "ts", "event_id")
    order = [F.col(c).asc_nulls_last() for c in ("ts", "event_id", "u", "v", "feature")]
    rows = rows.repartition("component").sortWithinPartitions(*order).select("component", "u", "v", "feature")
    return rows.mapInArrow(lambda batches: fold_events(batches, w, node, edge, block), "id string, memory array<double>")


class BatchStore:
    """Tables of micro-batches in a shared folder, one for each batch id. A batch that is delivered again, also after a
    restart, writes its own table again; a table without its end mark was cut off and doesn't count."""

    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def batches(self) -> list[int]:
        """Ids of the complete batches, in order."""
        root = self._path("")
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [x.getPath().getName() for x in fs.listStatus(root)] if fs.exists(root) else []
        return sorted(int(n[6:]) for n in names if n.startswith("batch=") and fs.exists(self._path(f"{n}/_SUCCESS")))

    def write(self, table: DataFrame, batch_id: int) -> None:
        table.write.mode("overwrite").parquet(f"{self.folder}/batch={batch_id}")

    def read(self, ids: list[int]) -> DataFrame:
        paths = [f"{self.folder}/batch={i}" for i in ids]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def drop(self, ids: list[int]) -> None:
        for i in ids:
            path = self._path(f"batch={i}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


class MemoryStore(BatchStore):
    """Association strengths (event, concept, strength) across micro-batches: pass fold to foreachBatch.

    Every batch decays all links once, drops the weak ones, and then counts its episodes (event, concept); late ones
    count in the batch that brings them. The table of the batch before stays until the next one is complete.
    """

    def __init__(self, spark: SparkSession, folder: str, factor: float = 0.9):
        super().__init__(spark, folder, "event string, concept string, strength double")
        self.factor = factor

    def memory(self) -> DataFrame:
        return self.read(self.batches()[-1:])

    def fold(self, batch: DataFrame, batch_id: int) -> None:
        before = [i for i in self.batches() if i < batch_id]
        self.write(remember(decay(self.read(before[-1:]), self.factor), batch.select("event", "concept")), batch_id)
        self.drop(before[:-1])


class TermStore(BatchStore):
    """Term counts (doc_id, term, c) across micro-batches: each batch adds a table of its own, and what came before isn't touched."""

    def __init__(self, spark: SparkSession, folder: str, id_type: str = "long"):
        super().__init__(spark, folder, f"doc_id {id_type}, term string, c long")

    def counts(self) -> DataFrame:
        return self.read(self.batches())

    def fold(self, batch: DataFrame, batch_id: int) -> None:
        """batch: (doc_id, text)."""
        self.write(batch.select("doc_id", F.explode(tokens("text")).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("c")), batch_id)


def stream_strengths(episodes: DataFrame, store: MemoryStore, checkpoint_dir: str) -> StreamingQuery:
    """Folds a stream (event, concept) into the store, until what is there now is read."""
    return episodes.writeStream.foreachBatch(store.fold).option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start()
