"""Micro-batch stores: idle links decay and go, a batch that comes again counts once, a restart goes on."""

import pytest

from arachne.streaming import incremental


def rows(df):
    return {tuple(r)[:2]: pytest.approx(r[2]) for r in df.collect()}


def test_memory_of_batches(spark, tmp_path):
    batch = lambda *e: spark.createDataFrame(list(e), "event string, concept string")
    store = incremental.MemoryStore(spark, f"file://{tmp_path}/m", 0.4)
    assert store.memory().count() == 0
    store.fold(batch(("e", "x"), ("e", "x"), ("f", "x")), 0)
    assert rows(store.memory()) == {("e", "x"): 0.7, ("f", "x"): 0.5}
    store.fold(batch(("f", "x")), 1)
    again = incremental.MemoryStore(spark, f"file://{tmp_path}/m", 0.4)  # as after a restart
    again.fold(batch(("f", "x")), 1)
    assert rows(again.memory()) == {("e", "x"): 0.28, ("f", "x"): 0.4}
    for i in range(2, 5):
        again.fold(batch(), i)
    assert again.memory().count() == 0 and again.batches() == [3, 4]


def test_stream_of_episodes(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.createDataFrame([("e", "x"), ("e", "y")], "event string, concept string").write.parquet(f"{tmp_path}/in/a")
    stream = spark.readStream.schema("event string, concept string").option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    store = incremental.MemoryStore(spark, f"file://{tmp_path}/m")
    incremental.stream_strengths(stream, store, f"{tmp_path}/c").awaitTermination()
    assert rows(store.memory()) == {("e", "x"): 0.5, ("e", "y"): 0.5}


def test_terms_of_batches(spark, tmp_path):
    store = incremental.TermStore(spark, f"file://{tmp_path}/t")
    for i, text in enumerate(["a b a", "c", "c"]):
        store.fold(spark.createDataFrame([(min(i, 1), text)], "doc_id long, text string"), min(i, 1))
    assert {(r.doc_id, r.term, r.c) for r in store.counts().collect()} == {(0, "a", 2), (0, "b", 1), (1, "c", 1)}


def test_temporal_memory_in_order(spark):
    import numpy as np

    w = incremental.gru_weights(2, 1)
    ev = spark.createDataFrame([("a", "b", [1.0], 2, 0), ("b", "c", [0.5], 1, 1)], "u string, v string, feature array<double>, ts int, event_id int")
    got = {r.id: r.memory for r in incremental.temporal_memory(ev, 2, 1, w).collect()}
    z = np.zeros(2)
    b1, c1 = incremental.gru_cell(z, np.array([0, 0, 0, 0, 0.5]), w), incremental.gru_cell(z, np.array([0, 0, 0, 0, 0.5]), w)
    a2, b2 = incremental.gru_cell(z, np.concatenate([z, b1, [1.0]]), w), incremental.gru_cell(b1, np.concatenate([b1, z, [1.0]]), w)
    assert got["c"] == pytest.approx(c1) and got["a"] == pytest.approx(a2) and got["b"] == pytest.approx(b2)


def test_temporal_memory_beyond_a_block(spark, monkeypatch):
    """A part of more events than a task holds, against one event at a time: hubs, two parts, equal and missing times, loops, null ends."""
    import numpy as np

    monkeypatch.setattr(incremental, "MAX_EVENTS", 500, raising=False)  # the limit that parts had
    monkeypatch.setattr(incremental, "BLOCK", 0, raising=False)  # 256 events
    rng, w, events = np.random.default_rng(3), incremental.gru_weights(3, 2), []
    for k in range(1500):
        u, v = (f"a{rng.integers(40)}", f"h{rng.integers(3)}") if k % 5 else (f"b{rng.integers(6)}", f"b{rng.integers(6)}")
        u, v = None if k % 100 == 1 else u, None if k % 100 in (2, 5) else v
        events.append((u, v, rng.normal(size=2).tolist(), None if k % 70 == 3 else int(rng.integers(60)), int(k * 7919 % 1500)))
    want, zero = {}, np.zeros(3)
    for u, v, f, *_ in sorted((e for e in events if e[0]), key=lambda e: (e[3] is None, e[3] or 0, e[4])):
        v = v or (u[0],)
        mu, mv = want.get(u, zero), want.get(v, zero)
        want[u], want[v] = incremental.gru_cell(mu, np.concatenate([mu, mv, f]), w), incremental.gru_cell(mv, np.concatenate([mv, mu, f]), w)
    got = incremental.temporal_memory(spark.createDataFrame(events, "u string, v string, feature array<double>, ts int, event_id int"), 3, 2, w).collect()
    line = lambda x: (x[0] or "", [round(float(m), 9) for m in x[1]])
    assert sorted(map(line, got)) == sorted(line((k if isinstance(k, str) else None, m)) for k, m in want.items())


def test_temporal_memory_of_a_wrong_feature(spark):
    ev = spark.createDataFrame([("a", "b", [1.0, 2.0], 1, 0), ("b", "c", [], 2, 1)], "u string, v string, feature array<double>, ts int, event_id int")
    with pytest.raises(Exception, match="a feature has 1 numbers"):
        incremental.temporal_memory(ev, 2, 1).collect()
