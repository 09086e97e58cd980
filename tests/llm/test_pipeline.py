"""The pipeline's stages on a small table: what each drops and keeps."""

import random

import corpus_pipeline
from test_operators import brute_components, shingles


def test_stages(spark, tmp_path):
    rng = random.Random(1)
    words = ["the", "of", "and", "moon", "tide", "salt", "river", "stone", "hill", "wind", "lamp", "door", "field", "cloud", "iron", "glass"]
    prose = lambda n: " ".join(rng.choice(words) + rng.choice(["", "s", "er", "ing", "ed"]) for _ in range(n))
    item, clean = prose(30), [prose(120) for _ in range(6)]
    texts = [*clean, clean[0], clean[1] + " end", prose(60) + " " + item + " " + prose(60), "heat " * 50, None, clean[2] + " write to ann.b@mail.example.com"]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == df.columns, name
        out.write.parquet(f"{tmp_path}/{len(seen)}")
        docs = spark.read.parquet(f"{tmp_path}/{len(seen)}")
        seen.append({r.doc_id for r in docs.select("doc_id").collect()})
    assert seen[0] == set(range(12)) - {9, 10}
    assert seen[1] == {0, 1, 2, 3, 4, 5, 8}
    assert seen[2] == seen[3] == {0, 1, 2, 3, 4, 5}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == seen[3]


def brute(docs, items):
    """The rows (doc_id, text) after each stage but the last, by other means: DuckDB SQL, all pairs, sets of shingles."""
    import duckdb
    import pyarrow as pa

    from arachne.llm import decontaminate, pii, quality

    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": range(len(docs)), "text": pa.array([t for _, t in docs], pa.string())}))
    kept = sorted(i for i, k in con.sql(f"SELECT doc_id, kept FROM ({quality.ORACLE})").fetchall() if k)
    out = [[docs[i] for i in kept]]
    comp = {i: c for i, (_, c) in brute_components([(i, docs[i][1]) for i in kept]).items()}
    best = {}
    for i in kept:
        best.setdefault(comp[i], []).append(i)
    first = {min(m, key=lambda i: (docs[i][0] is None, docs[i][0] or 0, i)) for m in best.values()}
    out.append([docs[i] for i in kept if i in first])
    parts = [[shingles(x) for x in decontaminate.split_item(t)] for t in items]
    out.append([(d, t) for d, t in out[-1] if not any(all(100 * len(p & shingles(t)) >= 80 * len(p) for p in ps) for ps in parts)])
    out.append([(d, pii.redact(t)) for d, t in out[-1]])
    return out


def test_stages_equal_brute_force(spark, tmp_path):
    rng = random.Random(2)
    words = ["the", "of", "and", "moon", "tide", "salt", "river", "stone", "hill", "wind", "lamp", "door", "field", "cloud", "iron", "glass", "coal", "reed", "wolf", "fern"]
    prose = lambda n: " ".join(rng.choice(words) + rng.choice(["", "s", "er", "ing", "ed"]) for _ in range(n))
    items = [prose(25) for _ in range(4)] + [prose(30) + "?\nAnswer: " + prose(6)]
    base = [prose(rng.choice([15, 60, 120, 200])) for _ in range(25)]
    texts = base + [" ".join(t.split()[: -rng.randint(1, 4)]) for t in base[:12]] + base[5:9] + [prose(50) + " " + x + " " + prose(40) for x in items]
    texts += ["", None, "one two", "heat " * 40, prose(60) + " ann@mail.example.com or +1 555 010 0199 99", prose(9000), "a b\n" * 30]
    ids = [rng.choice([i, i, i, None, 3]) for i in range(len(texts))]
    rows = list(zip(ids, texts, strict=True))
    schema = "doc_id long, text string, row int, __text string, cell int, component_id string"
    df = spark.createDataFrame([(*r, 1, "t", 2, "c") for r in rows], schema)
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = df
    for k, ((name, stage), want) in enumerate(zip(corpus_pipeline.STAGES, brute(rows, items), strict=False)):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.columns == df.columns, name
        key = lambda r: (str(r[0]), str(r[1]))
        assert sorted(((r.doc_id, r.text) for r in docs.collect()), key=key) == sorted(want, key=key), name
        assert docs.where("row <> 1 or __text <> 't' or cell <> 2 or component_id <> 'c'").count() == 0, name
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).toPandas()
    assert packed.groupby("sequence_id").length.sum().max() <= 2048
    empty = df.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0, name
