"""Deterministic results on small graphs with values derived by hand or by brute force."""

import pytest
from pyspark.sql import functions as F

from arachne.operators import centrality, components, embed, flow, gnn, kg, metrics, paths, pgm, retrieval, spectral
from arachne.operators.graph import PropertyGraph


def graph(spark, text, directed=False):
    rows = [(e.split("-")[0], e.split("-")[1], float(e.split("-")[2]) if e.count("-") > 1 else 1.0, i) for i, e in enumerate(text.split())]
    return PropertyGraph.from_edges(spark.createDataFrame(rows, "src string, dst string, weight double, ord long"), directed)


def values(df, key="id"):
    return {r[key]: tuple(v for k, v in r.asDict().items() if k != key) for r in df.collect()}


@pytest.fixture(scope="module")
def square(spark):
    return graph(spark, "A-B-1 B-C-2 C-D-1.5 D-A-1 B-D-3")


@pytest.fixture(scope="module")
def network(spark):
    return graph(spark, "source-A-16 source-B-13 A-B-10 B-A-4 A-C-12 B-D-14 C-B-9 D-C-7 C-sink-20 D-sink-4", True)


def test_metrics_of_the_square(square):
    assert values(metrics.degree(square)) == {"A": (2, 2), "B": (3, 3), "C": (2, 2), "D": (3, 3)}
    assert metrics.density(square).first().density == pytest.approx(5 / 6)
    assert metrics.global_clustering(square).first()[0] == pytest.approx(5 / 6)
    assert values(metrics.closeness(square)) == {"A": (0.75,), "B": (1.0,), "C": (0.75,), "D": (1.0,)}
    assert values(centrality.betweenness(square))["B"][0] == pytest.approx(1 / 3)
    assert values(centrality.pagerank(square))["B"][0] == pytest.approx(0.295213, abs=1e-5)


def test_betweenness_by_sources(spark, square):
    whole = values(centrality.betweenness(square))
    each = [values(centrality.betweenness(square, sources=spark.createDataFrame([(x,)], "id string"))) for x in "ABCD"]
    assert {k: (sum(e[k][0] for e in each) / 4,) for k in whole} == {k: pytest.approx(v) for k, v in whole.items()}


def test_spectrum_of_the_square(spark, square):
    got = [r.value for r in spectral.eigenvalues(square).orderBy("k").collect()]
    assert got == pytest.approx([0, 2.3861, 5.8031, 8.8108], abs=1e-4)
    signal = spark.createDataFrame([("A", 1.0), ("B", 2.0), ("C", 0.5), ("D", -1.0)], "id string, value double")
    back = values(spectral.inverse_fourier(square, spectral.fourier(square, signal)))
    assert [back[x][0] for x in "ABCD"] == pytest.approx([1, 2, 0.5, -1])


def test_shortest_paths(spark):
    g = graph(spark, "S-A-4 S-B-2 A-B-1 B-A-3 A-C-2 B-D-5 C-D-1 D-T-3 C-T-6", True)
    want = {"S": 0, "A": 4, "B": 2, "C": 6, "D": 7, "T": 10}
    assert {k: v[0] for k, v in values(paths.dijkstra(g, "S")).items()} == want
    assert not paths.bellman_ford(g, "S")[1]
    assert paths.shortest_path(g, "S", "T")[1] == 10
    assert paths.a_star(g, "S", "T", F.lit(0.0))[1] == 10
    assert {r.dst: r.dist for r in paths.all_pairs(g).where("src = 'S'").collect()} == want
    assert {r.dst: r.dist for r in paths.johnson(g).where("src = 'S'").collect()} == want
    assert paths.johnson(PropertyGraph.from_edges(spark.createDataFrame([("A", "B", 1.0), ("B", "A", -3.0)], "src string, dst string, weight double"), True)) is None
    assert [r.id for r in paths.bfs_order(g, "S").orderBy("rank").collect()] == list("SABCDT")
    assert [r.id for r in paths.dfs_preorder(g, "S").orderBy("rank").collect()] == list("SABDTC")


def test_spanning_forest(spark):
    g = graph(spark, "A-B-4 B-C-8 C-D-7 D-E-9 E-F-10 F-G-2 G-H-1 H-A-8 B-H-11 H-I-7 I-C-2 G-I-6 C-F-4 D-F-14")
    t = components.spanning_forest(g)
    assert (t.count(), t.agg(F.sum("weight")).first()[0]) == (8, 37.0)


def test_components_and_orders(spark):
    g = graph(spark, "A-B B-C C-A C-D D-E E-F F-D G-F G-H H-G", True)
    assert values(components.strongly_connected(g)) == {x: (c,) for c in ("ABC", "DEF", "GH") for x in c for c in [c[0]]}
    assert {v[0] for v in values(components.connected(g)).values()} == {"A"}
    assert values(components.condensation(g)) == {"A": ("A", 0), "B": ("A", 0), "C": ("A", 0), "G": ("G", 0), "H": ("G", 0), "D": ("D", 1), "E": ("D", 1), "F": ("D", 1)}
    assert components.has_cycle(g)
    with pytest.raises(ValueError):
        components.topological_levels(g)
    dag = graph(spark, "a-b b-c d-c", True)
    assert values(components.topological_levels(dag)) == {"a": (0,), "b": (1,), "c": (2,), "d": (0,)}
    ring = graph(spark, "1-2 2-3 3-4 4-5 5-1")
    assert values(components.colouring(ring)) == {"1": (0,), "2": (1,), "3": (0,), "4": (1,), "5": (2,)}


@pytest.mark.parametrize("method", ["dinic", "edmonds_karp"])
def test_max_flow(network, method):
    rows = flow.max_flow(network, "source", "sink", method).collect()
    assert rows[0].value == 23
    assert {(r.src, r.dst) for r in rows if r.in_cut} == {("A", "C"), ("D", "C"), ("D", "sink")}
    with pytest.raises(ValueError):
        flow.max_flow(network, "A", "A")


def test_matching(spark):
    g = graph(spark, "a-x a-y b-x c-y c-z d-z")
    left = spark.createDataFrame([(x,) for x in "abcd"], "id string")
    rows = flow.bipartite_matching(g, left).collect()
    assert len(rows) == 3 and len({r.left for r in rows}) == len({r.right for r in rows}) == 3


def test_bayes_net_and_viterbi(spark):
    cpt = lambda names, rows: spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names) + ", prob double")
    net = pgm.BayesNet().add_variable("B", [], cpt(["B"], [("1", 0.001), ("0", 0.999)])).add_variable("E", [], cpt(["E"], [("1", 0.002), ("0", 0.998)]))
    p = {("1", "1"): 0.95, ("1", "0"): 0.94, ("0", "1"): 0.29, ("0", "0"): 0.001}
    net.add_variable("A", ["B", "E"], cpt(["B", "E", "A"], [(b, e, a, q if a == "1" else 1 - q) for (b, e), q in p.items() for a in "10"]))
    assert {r.value: r.prob for r in net.query("A").collect()}["1"] == pytest.approx(0.002516442)
    assert {r.value: r.prob for r in net.query("B", {"A": "1"}).collect()}["1"] == pytest.approx(0.373551, abs=1e-6)
    seq = spark.createDataFrame([(1, ["Normal", "Cold", "Dizzy"])], "seq int, observations array<string>")
    names, emission = ["Healthy", "Fever"], [{"Normal": 0.5, "Cold": 0.4, "Dizzy": 0.1}, {"Normal": 0.1, "Cold": 0.3, "Dizzy": 0.6}]
    row = pgm.viterbi(seq, names, [0.6, 0.4], [[0.7, 0.3], [0.4, 0.6]], emission).first()
    assert (row.path, row.score) == (["Healthy", "Healthy", "Fever"], pytest.approx(0.01512))


def test_patterns(spark):
    t = spark.createDataFrame([("Alice", "works_at", "Google"), ("Bob", "works_at", "Google"), ("Google", "located_in", "USA"), ("Charlie", "works_at", "DeepMind"), ("DeepMind", "located_in", "UK"), ("Alice", "knows", "Bob")], "s string, p string, o string")
    got = kg.bgp(t, [("?x", "works_at", "?c"), ("?c", "located_in", "USA")]).collect()
    assert {(r["?x"], r["?c"]) for r in got} == {("Alice", "Google"), ("Bob", "Google")}
    assert kg.match(t, "Alice", "?p", "?o").count() == 2


def test_heat_keeps_its_sum(spark):
    g = graph(spark, "a-b b-c c-d d-a")
    h = gnn.heat_diffusion(g, spark.createDataFrame([("a", 100.0)], "id string, heat double"), 3, 0.1)
    assert {r.id: r.heat for r in h.where("step = 3").collect()} == {k: pytest.approx(v) for k, v in {"a": 56, "b": 19.6, "c": 4.8, "d": 19.6}.items()}


def test_walks_follow_edges_and_repeat(spark, square):
    w = embed.walks(square, 2, 4)
    rows = {(r.start, r.walk, r.pos): r.id for r in w.collect()}
    near = {(r.src, r.dst) for r in square.adjacency().collect()}
    assert all((rows[s, k, p - 1], x) in near for (s, k, p), x in rows.items() if p)
    assert rows == {(r.start, r.walk, r.pos): r.id for r in embed.walks(square, 2, 4).collect()}


def test_plan_and_memory(spark):
    plan = retrieval.TaskPlan()
    plan.register("a", lambda x: x["initial_input"] + 1)
    plan.register("b", lambda x: x["input_from_a"] * 2)
    plan.depend("a", "b")
    assert plan.execute({"a": 1})["b"] == 4
    e = spark.createDataFrame([("E1", "x"), ("E1", "x"), ("E2", "x")], "event string, concept string")
    assert [(r.event, r.strength) for r in retrieval.recall(retrieval.memory_strengths(e), "x").collect()] == [("E1", pytest.approx(0.7)), ("E2", 0.5)]


def test_fiedler_cut_of_a_bridge(spark):
    g = graph(spark, "A-B-2 A-C-4 B-C-1.5 C-D-6 D-E-2.5 D-F-3 E-F-1")
    side = {r.id: r.side for r in spectral.fiedler_cut(g).collect()}
    assert len({side[x] for x in "ABC"}) == len({side[x] for x in "DEF"}) == 1 and side["A"] != side["D"]


def test_pagerank_with_sinks_and_unreached_nodes(spark):
    g = graph(spark, "a-b a-c b-c d-a", True)
    near, rank = {"a": "bc", "b": "c", "c": "", "d": "a"}, dict.fromkeys("abcd", 0.25)
    for _ in range(7):
        lost = sum(rank[x] for x in near if not near[x])
        rank = {x: 0.15 / 4 + 0.85 * (lost / 4 + sum(rank[y] / len(near[y]) for y in near if x in near[y])) for x in near}
    assert {k: v[0] for k, v in values(centrality.pagerank(g, fixed_iters=7)).items()} == pytest.approx(rank)
    assert sum(v[0] for v in values(centrality.pagerank(g)).values()) == pytest.approx(1)


F17 = "Alice works_at Google. Google located_in USA. Bob likes Carol, who is gone.\nDan is an engineer of trade. Eve visits Thailand, alone. Rex is a good dog"


def test_triples_are_extracted_as_stated(spark):
    import re

    text = [F17, None, "", "no names", "A b C. Al sees Bo and Bo sees Cy", "Al is\n a Big Cat.", "éAl sees Bo. Al_x sees Bo. Al  sees\tBo  Jo\n is here", "Xy sees Bo was Cy sees Do,"] + ["Al " * 3000 + "sees Bo."]
    want = []
    for i, t in enumerate(text):
        want += [(i, s, p, o.strip()) for s, p, o in re.findall(retrieval.STATEMENT, t or "")]
        want += [(i, s, "is_a", o.strip().replace(" ", "_")) for s, o in re.findall(retrieval.COPULA, t or "")]
    df = spark.createDataFrame(list(enumerate(text)), "doc_id long, text string")
    assert sorted(tuple(r) for r in retrieval.extract_triples(df).collect()) == sorted(want)
    assert (0, "Alice", "works_at", "Google") in want and (0, "Eve", "visits", "Thail") in want and (0, "Dan", "is_a", "n_engineer_of_trade") in want


def test_ingestion_and_answers(spark):
    df = spark.createDataFrame([(1, "Alice works_at Google. Google located_in USA.\n\nBob likes Carol."), (2, "nothing here")], "doc_id long, text string")
    parts, index, triples, sources = retrieval.ingest(df)
    assert sorted((r.doc_id, r.chunk) for r in parts.collect()) == [(1, 0), (1, 1), (2, 0)]
    assert {(r.entity, r.chunk) for r in sources.collect()} == {("Alice", 0), ("Google", 0), ("USA", 0), ("Bob", 1), ("Carol", 1)}
    assert index.select("chunk_id").distinct().count() == 3
    chunked = parts.select((F.col("doc_id") * 10 + F.col("chunk")).alias("doc_id"), "text")
    answer = retrieval.grounded_answer(chunked, triples, "Where is alice?")
    assert "we know that Alice is associated with Google via a 'works_at' relationship. According to" in answer and "- (Google) --[located_in]--> (USA)" in answer
    assert retrieval.NO_PLACE in retrieval.grounded_answer(chunked, triples, "where is bob located")
    assert retrieval.GENERAL in retrieval.grounded_answer(chunked, triples, "who is alice")


def test_edges_and_trees(spark):
    g = graph(spark, "a-b a-c b-c-3")
    gone = spark.createDataFrame([("b", "a")], "src string, dst string")
    assert {tuple(sorted((r.src, r.dst))) for r in g.remove_edges(gone).edge_list().collect()} == {("a", "c"), ("b", "c")}
    more = g.add_nodes(spark.createDataFrame([("a", "city"), ("z", "town")], "id string, type string"))
    assert {r.id: r.type for r in more.nodes.collect()}["z"] == "town" and more.num_nodes() == 4
    two = graph(spark, "a-b-2 b-c-1 a-c-5 x-y-1")
    assert components.spanning_forest(two, start="a").agg(F.sum("weight")).first()[0] == 3
    assert kg.bgp(spark.createDataFrame([("a", "b", "c")], "s string, p string, o string"), []).count() == 0


def test_skipgram_loss_and_line(spark, square):
    import numpy as np

    t, c = np.array([[1.0, 0.0], [0.0, 2.0]]), np.array([[0.5, 1.0], [1.0, -1.0]])
    s = lambda v: np.log(1 / (1 + np.exp(-v)))
    assert embed.skipgram_loss(t, c, np.array([[0, 1]]), np.array([[0, 1]])) == pytest.approx(-(s(1.0) + s(-0.5) + s(-1.0)))
    pairs = np.array([[0, 1], [1, 0], [2, 3], [3, 2]] * 20)
    losses = embed._sgd(pairs, 4, 4, 40, 0.05, 2, 16, 1, False)[1]
    assert losses[-1] < losses[0]
    assert {len(r.x) for r in embed.line(square, dim=4, proximity="second", epochs=2).collect()} == {4}


def test_two_empty_names_are_not_alike(spark):
    m = spark.createDataFrame([("",), ("Pariss",)], "mention string")
    e = spark.createDataFrame([("1", "", 0), ("2", "paris", 1)], "id string, name string, ord int")
    assert {r.mention: r.id for r in kg.link_entities(m, e).collect()} == {"": None, "Pariss": "2"}


def test_matching_is_a_maximum_on_random_graphs(spark):
    import random

    rng = random.Random(3)
    edges = [(f"{c}l{rng.randrange(7)}", f"{c}r{rng.randrange(7)}") for c in range(25) for _ in range(rng.randrange(1, 14))]
    g = PropertyGraph.from_edges(spark.createDataFrame([(*e, i) for i, e in enumerate(edges)], "src string, dst string, ord long"), False)
    near: dict[str, set] = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
    held: dict[str, str] = {}

    def place(u, seen):
        for v in near[u]:
            if v not in seen:
                seen.add(v)
                if v not in held or place(held[v], seen):
                    held[v] = u
                    return True
        return False

    for u in near:
        place(u, set())
    rows = flow.bipartite_matching(g, spark.createDataFrame([(u,) for u in near], "id string")).collect()
    assert len(rows) == len(held) == len({r.left for r in rows}) == len({r.right for r in rows})
    assert all(r.right in near[r.left] for r in rows)


@pytest.mark.parametrize("model", list(kg.MODELS))
def test_training_of_embeddings(model):
    import numpy as np

    trainer = kg.KGETrainer(model, 6, 2, 4, lr=0.05)
    pos, neg = np.array([[0, 0, 2], [0, 1, 1], [3, 0, 4]]), np.array([[0, 0, 1], [0, 1, 2], [3, 0, 5]])
    _, grads = trainer.gradients(pos, neg)
    for table, grad in zip(trainer.tables, grads, strict=True):  # against finite differences
        for at in [tuple(i) for i in np.argwhere(np.abs(grad) > 1e-9)[::5]]:
            old = table[at]
            table[at] = old + 1e-6
            up = trainer.gradients(pos, neg)[0]
            table[at] = old - 1e-6
            down = trainer.gradients(pos, neg)[0]
            table[at] = old
            assert grad[at] == pytest.approx((up - down) / 2e-6, abs=1e-4)
    losses = [trainer.train_step(pos, neg) for _ in range(80)]
    assert losses[-1] < losses[0] or losses[0] == 0


def test_scores_of_the_trainer_are_those_of_the_columns(spark):
    import numpy as np

    columns = {"transe": lambda h, t, r: kg.transe(h, r[0], t), "transh": lambda h, t, r: kg.transh(h, r[0], t, r[1]), "distmult": lambda h, t, r: kg.distmult(h, r[0], t)}
    vec = lambda x: F.array(*[F.lit(float(v)) for v in x])
    for model, column in columns.items():
        trainer = kg.KGETrainer(model, 3, 2, 4)
        e, *r = trainer.tables
        got = spark.range(1).select(column(vec(e[0]), vec(e[2]), [vec(x[1]) for x in r]).alias("s")).first().s
        assert got == pytest.approx(trainer.scores(np.array([[0, 1, 2]]))[0])


@pytest.mark.parametrize("directed", [False, True])
def test_clustering_equals_brute_force(spark, directed):
    import random

    rng = random.Random(5)
    pairs = {(rng.choice("abcdefgh"), rng.choice("abcdefgh")) for _ in range(30)} | {("hub", x) for x in "abcdefgh"}
    g = PropertyGraph.from_edges(spark.createDataFrame([(*p, i) for i, p in enumerate(sorted(pairs))], "src string, dst string, ord long"), directed)
    links = [(r.src, r.dst) for r in g.adjacency().collect()]
    near = {x: {b for a, b in links if a == x} | {a for a, b in links if b == x} for p in pairs for x in p}
    want = {}
    for x, n in near.items():
        n = n - {x}
        want[x] = sum(a in n and b in n for a, b in links) / (len(n) * (len(n) - 1)) if len(n) > 1 else 0.0
    assert {k: v[0] for k, v in values(metrics.local_clustering(g)).items()} == pytest.approx(want)


def test_what_one_task_cannot_hold_is_refused(spark, network, monkeypatch):
    monkeypatch.setattr(flow, "MAX_EDGES", 3)
    monkeypatch.setattr(paths, "MAX_EDGES", 3)
    for run in (lambda: flow.max_flow(network, "source", "sink"), lambda: paths.dfs_preorder(network, "source")):
        with pytest.raises(ValueError, match="one task holds 3"):
            run()


def test_vgae_training_lowers_the_loss(spark):
    x = spark.createDataFrame([(str(i), [float(i % 3 == k) for k in range(3)]) for i in range(12)], "id string, x array<double>")
    e = spark.createDataFrame([(str(i), str((i + d) % 12)) for i in range(12) for d in (3, 6)], "src string, dst string")
    rows = gnn.vgae_train(x, e, epochs=40).orderBy("epoch").collect()
    assert len(rows) == 40 and rows[-1].loss < rows[0].loss
