"""Composed graphs, ranks, reports and kernels: against brute force."""

import datetime as dt
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from postbag.functions import text
from postbag.kernels import cluster, diffusion, flow
from postbag.operators import bounded, graphs, hypergraphs, iterate, reports, temporal, tensors
from postbag.sources import files

MSG = "msg_id long, thread long, pos int, ts timestamp_ntz, sender long, recipients array<long>, cc array<long>"


def some_messages(spark, seed=0, n=120, people=14):
    rng = random.Random(seed)
    pick = lambda k: rng.sample(range(people), rng.randrange(k))
    rows = [(i, i % 20, 1 + i // 20, dt.datetime(2020, 1, 1) + dt.timedelta(hours=7 * i), rng.randrange(people), pick(4), pick(3)) for i in range(n)]
    return spark.createDataFrame(rows, MSG), rows


def random_graph(seed, n=9, p=0.5):
    rng = random.Random(seed)
    pairs = [(i, j, rng.randrange(1, 6)) for i in range(n) for j in range(i) if rng.random() < p] + [(i, i + 1, 1) for i in range(n - 1)]
    merged: dict = {}
    for i, j, w in pairs:
        merged[min(i, j), max(i, j)] = max(w, merged.get((min(i, j), max(i, j)), 0))
    return [(a, b, float(w)) for (i, j), w in merged.items() for a, b in ((i, j), (j, i))]


@pytest.mark.parametrize("kind,keepcc", list(reports.FIVE.values()))
def test_built_graphs(spark, kind, keepcc):
    msgs, rows = some_messages(spark)
    w: dict = {}
    for _, thread, pos, _, s, r, c in rows:
        if kind == "tofrom":
            to = r + c if keepcc else r
            edges = [(s, x) for x in to] if len(to) <= 5 else []
        elif kind == "projection":
            p = sorted({s, *r, *(c if keepcc else [])})
            edges = [(x, y) for x in p for y in p if x > y] if len(p) <= 5 else []
        else:
            edges = [(s2, s) for _, t2, p2, _, s2, _, _ in rows if t2 == thread and p2 > pos and s2 in r + c]
        for e in edges:
            w[e] = w.get(e, 0) + 1
    sym = {e: max(w.get(e, 0), w.get(e[::-1], 0)) for e in {*w, *(x[::-1] for x in w)}}
    degree: dict = {}
    for a, _ in sym:
        degree[a] = degree.get(a, 0) + 1
    sym = {e: x for e, x in sym.items() if degree[e[0]] >= 3 and degree[e[1]] >= 3}
    left, comps = {a for e in sym for a in e}, []
    while left:
        comp, todo = set(), [left.pop()]
        while todo:
            u = todo.pop()
            comp.add(u)
            todo += [b for a, b in sym if a == u and b not in comp and b not in todo]
        comps.append(comp)
        left -= comp
    big = max(comps, key=lambda c: (len(c), -min(c))) if comps else set()
    got = {(r.src, r.dst): r.w for r in reports.build_graph(msgs, kind, keepcc, mindegree=3).collect()}
    assert got == {e: x for e, x in sym.items() if e[0] in big}


def test_global_ranks_and_running_sums(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(20), rng.randrange(5)) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, score long, v long").repartition(7)
    ranked = iterate.global_rank(df, [F.desc("score"), F.asc("id")])
    want = sorted(rows, key=lambda r: (-r[1], r[0]))
    assert [r.id for r in ranked.orderBy("rank").collect()] == [r[0] for r in want] and [r["rank"] for r in ranked.orderBy("rank").collect()] == list(range(1, 501))
    sums = iterate.running_sums(ranked, {"upto": "v"}, each=37).orderBy("rank").collect()
    assert [r.upto for r in sums] == list(np.cumsum([r[2] for r in want]))
    assert iterate.global_rank(df.limit(0), ["id"]).collect() == []


def test_small_operators(spark):
    rng = random.Random(2)
    pts, spans = [rng.randrange(300) for _ in range(80)], [(k, a := rng.randrange(300), a + rng.randrange(60)) for k in range(25)]
    got = reports.interval_join(spark.createDataFrame([(p,) for p in pts], "p long"), spark.createDataFrame(spans, "k long, a long, b long"), 16).collect()
    assert sorted((r.p, r.k) for r in got) == sorted((p, k) for p in pts for k, a, b in spans if a <= p <= b)
    top = reports.all_argmax(spark.createDataFrame([(1, 5), (1, 5), (1, 2), (2, 0)], "g long, v long"), ["g"], "v")
    assert sorted(map(tuple, top.collect())) == [(1, 5), (1, 5), (2, 0)]
    labels = spark.createDataFrame([(1, 0, 4), (1, 1, 4), (2, 0, 1), (2, 1, 3), (3, 0, 2)], "id long, slice long, label long")
    assert [tuple(r) for r in reports.label_rows(labels).orderBy("row").collect()] == [(3, 1, 2, 0), (1, 1, 4, 1), (2, 2, 3, 2)]
    days = spark.createDataFrame([(dt.date(2024, 1, d),) for d in (1, 2, 8)], "d date").filter(reports.is_monday(F.col("d")))
    assert [r.d.day for r in days.orderBy("d").collect()] == [1, 8]
    names = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    assert reports.assert_present(names.filter("id = 2").select("name"), names).first().id == 2
    with pytest.raises(KeyError):
        reports.assert_present(spark.createDataFrame([("zed",)], "name string"), names)
    none, one = names.select("id").limit(0), names.select("id").limit(1)
    assert all(x != x for x in reports.set_scores_strict(none, none).first())
    assert tuple(reports.set_scores_strict(one, names.select("id")).first()) == pytest.approx((1.0, 0.5, 2 / 3))
    table = spark.createDataFrame([(1, "a_b", 2.5), (2, None, 1.0)], "n long, name string, x double")
    lines = [r.line for r in reports.table_rows(table, ["name", "x"], form={"x": lambda c: F.format_number(c, 2)}).orderBy("n").collect()]
    assert lines == ["| name | x |", "|---|---|", "| a_b | 2.50 |", "| -- | 1.00 |"]
    assert [r.line for r in reports.table_rows(table, ["name", "x"], "latex").orderBy("n").collect()][1] == r"a\_b & 2.5 \\"


def test_role_embeddings(spark):
    msgs, rows = some_messages(spark, 3, 12, 4)
    rng = random.Random(4)
    vec = {r[0]: ([rng.random() for _ in range(3)], [rng.random() for _ in range(3)]) for r in rows}
    v = spark.createDataFrame([(k, *x) for k, x in vec.items()], "msg_id long, subject array<double>, body array<double>")
    got = {(r.id, r.block, r.dim): r.x for r in reports.role_embeddings(msgs, v).collect()}
    people = {p for r in rows for p in (r[4], *r[5], *r[6])}
    assert len(got) == len(people) * 18
    for p in people:
        for role, has in (("sender", lambda r, p=p: [r[4]].count(p)), ("recipients", lambda r, p=p: r[5].count(p)), ("cc", lambda r, p=p: r[6].count(p))):
            for k, part in enumerate(("subject", "body")):
                own = [vec[r[0]][k] for r in rows for _ in range(has(r))]
                mean = np.mean(own, axis=0) if own else np.zeros(3)
                assert [got[p, f"{part}_{role}", d] for d in range(3)] == pytest.approx(list(mean))


@pytest.mark.parametrize("seed", range(6))
def test_cut_tree_has_all_minimum_cuts(seed):
    edges, n = random_graph(seed), 9
    tree = flow.cut_tree(n, edges)
    for s in range(n):
        for t, (value, size) in flow.tree_cuts(n, tree, s).items():
            want, _ = flow.st_cut(n, edges, s, t)
            assert value == pytest.approx(want)
            sides = [m for m in range(1 << n) if m >> s & 1 and not m >> t & 1]
            cut = lambda m: sum(w for u, v, w in edges if m >> u & 1 and not m >> v & 1)
            assert size in {min(k, n - k) for m in sides if cut(m) == pytest.approx(want) for k in [bin(m).count("1")]}


def test_all_pairs_and_delta_sweeps(spark):
    edges = random_graph(11)
    e = spark.createDataFrame([(10 * u, 10 * v, w) for u, v, w in edges], "src long, dst long, w double")
    tree = {(r.s, r.t): r.value for r in bounded.all_cuts(e).collect()}
    direct = {(r.s, r.t): r.value for r in bounded.all_cuts(e, list(tree)).collect()}
    assert len(tree) == 36 and tree == pytest.approx(direct)
    rng = random.Random(5)
    sets = [(k, sorted(rng.sample(range(7), rng.randrange(2, 6))), float(rng.randrange(1, 4))) for k in range(9)]
    h = spark.createDataFrame(sets, "edge_id long, members array<long>, weight double")
    deltas = [1.0, 1.5, 3.0]
    got = bounded.hyper_st_cuts(h, 0, 6, deltas).collect()
    for delta in deltas:
        # threshold-linear cuts by enumeration; an edge of three cuts one pair at a half twice: weight 1
        cost = lambda m, delta=delta: sum(w * (min(k, len(x) - k, delta) if len(x) > 3 else min(k, len(x) - k)) for _, x, w in sets for k in [sum(m >> i & 1 for i in x)])
        best = min(cost(m) for m in range(1 << 7) if m & 1 and not m >> 6 & 1)
        own = [r for r in got if r.delta == delta]
        assert all(r.value == pytest.approx(best) for r in own) and cost(sum(r.side << r.id for r in own)) == pytest.approx(best)
    table = bounded.cut_comparison(h, 0, 6, [3, 10]).collect()
    assert len(table) == 4 and all(r.shared <= min(r.graph_size, r.hyper_size) for r in table)


@pytest.mark.parametrize("seed", range(8))
def test_exact_clusters(seed):
    rng = np.random.default_rng(seed)
    n = 7
    w = rng.normal(size=(n, n))
    w = np.triu(w, 1) + np.triu(w, 1).T
    _, value = cluster.exact_clusters(w.copy())
    best = max(sum(w[i, j] for i in range(n) for j in range(i) if p[i] == p[j]) for p in itertools.product(range(4), repeat=n))
    assert value >= best - 1e-9
    a = cluster.dense(9, random_graph(seed))
    labels, q = cluster.exact_modularity(a)
    assert q == pytest.approx(cluster.exact_modularity_small(a)[1])
    labels, c = cluster.exact_normalised_cut(a)
    d, v = a.sum(axis=1), a.sum()
    cuts = [a[np.ix_(s, ~s)].sum() / (d[s].sum() * (v - d[s].sum())) for m in range(1, (1 << 9) - 1) for s in [np.array([m >> i & 1 for i in range(9)], bool)]]
    assert c == pytest.approx(min(cuts)) and cluster.scaled_ncut(a, labels)[0] == pytest.approx(c)


def test_exact_communities_of_two_cliques(spark):
    rows = [(i + o, j + o, 1.0) for o in (0, 10) for i in range(5) for j in range(5) if i != j] + [(0, 10, 1.0), (10, 0, 1.0)]
    e = spark.createDataFrame(rows, "src long, dst long, w double")
    for what in ("modularity", "ncut"):
        _, labels = bounded.exact_communities(e, what)
        sides = {}
        for r in labels.collect():
            sides.setdefault(r.label, set()).add(r.id)
        assert sorted(map(sorted, sides.values())) == [[0, 1, 2, 3, 4], [10, 11, 12, 13, 14]]


def test_vectorised_steps_are_the_plain_ones():
    rng = random.Random(7)
    es = [rng.sample(range(8), rng.randrange(1, 5)) for _ in range(12)]
    d = np.zeros(8)
    for e in es:
        d[e] += 1
    x, safe, s = np.zeros(8), np.where(d > 0, d, 1), np.zeros(8)
    s[[2, 3]] = d[[2, 3]] / d[[2, 3]].sum()
    for _ in range(40):
        y, grad = x / safe, np.zeros(8)
        for e in (np.array(e) for e in es if len(e) > 1):
            i, j = e[y[e].argmax()], e[y[e].argmin()]
            grad[i] += 2 * (y[i] - y[j])
            grad[j] -= 2 * (y[i] - y[j])
        x = x + 0.01 * (0.05 * s - 0.05 * x - 0.95 * grad)
    assert diffusion.qdsfm_pagerank(8, es, [2, 3], steps=40) == pytest.approx(x)
    with pytest.raises(RuntimeError):
        diffusion.ppr_push([[(1, 1.0)], [(0, 1.0)]], {0: 1.0}, 0.9, 1e-9, most=3)


def test_sweeps_of_pushes(spark):
    e = spark.createDataFrame([(i + o, j + o, 1.0) for o in (0, 10) for i in range(5) for j in range(5) if i != j] + [(0, 10, 1.0), (10, 0, 1.0)], "src long, dst long, w double")
    cond, side = bounded.grow_one(e, 3)
    assert sorted(r.id for r in side.collect()) == [0, 1, 2, 3, 4] and cond == pytest.approx(1 / 21)
    scores = spark.createDataFrame([(i, 5.0 - i) for i in range(5)] + [(10, 0.0)], "id long, score double")
    assert bounded.round_to_cluster(e, scores)[0] == pytest.approx(1 / 21)
    assert bounded.lambda2_of(e)[0] == pytest.approx(bounded.lambda2_of(e)[1])


def test_harness_takes_an_evaluation_and_sweeps(spark):
    rows = [(k, o + i) for o in (0, 10) for k, pair in enumerate(itertools.combinations(range(7), 3), 100 * o) for i in pair]
    inc = spark.createDataFrame(rows, "edge_id long, node_id long")
    truth = spark.createDataFrame([(o + i, o) for o in (0, 10) for i in range(7)], "node_id long, label long")
    whole = bounded.recovery_trials(inc, truth, 2, 0.5, evaluate=lambda n, es, seeds, size: {i for e in es if set(e) & set(seeds) for i in e}).collect()
    assert len(whole) == 4 and all(r.method == "evaluate" and r.f1 == 1.0 for r in whole)
    grid = bounded.recovery_sweep(inc, truth, 1, [0.3, 0.5], [1.0, 2.0], methods=("grow",)).collect()
    assert {(r.ratio, r.delta) for r in grid} == {(0.3, 1.0), (0.3, 2.0), (0.5, 1.0), (0.5, 2.0)} and all(r.f1 == 1.0 for r in grid)


def temporal_edges(spark, seed=0, days=6, n=7, each=8):
    rng = random.Random(seed)
    rows = {(dt.date(2020, 1, 1 + d + d // 3), rng.randrange(n), rng.randrange(n)): float(rng.randrange(1, 3)) for d in range(days) for _ in range(each)}
    return spark.createDataFrame([(*k, w) for k, w in rows.items()], "day date, src long, dst long, w double"), rows, n


def test_communicability_is_the_product_of_inverses(spark):
    te, rows, n = temporal_edges(spark)
    people = spark.createDataFrame([(i,) for i in range(n)], "id long")
    a, product = 0.03, np.eye(n)
    for day in sorted({d for d, _, _ in rows}):
        m = np.zeros((n, n))
        for (d, i, j), w in rows.items():
            if d == day:
                m[i, j] += w
        product = product @ np.linalg.inv(np.eye(n) - a * m)
    got = {r.id: (r.broadcast, r.receive) for r in temporal.communicability(te, people, a).collect()}
    for i in range(n):
        assert got[i] == pytest.approx((product[i].sum(), product[:, i].sum()))
    with pytest.raises(ValueError):
        temporal.communicability(te, people, 0.9)


def test_same_day_components_reach_alike(spark):
    d = dt.date
    te = spark.createDataFrame([(d(2020, 1, 1), 1, 2), (d(2020, 1, 1), 2, 3), (d(2020, 1, 1), 3, 1), (d(2020, 1, 2), 3, 4)], "day date, src long, dst long").withColumn("w", F.lit(1))
    people = spark.createDataFrame([(i,) for i in range(1, 5)], "id long")
    pairs = lambda df: {tuple(r) for r in df.collect()}
    assert pairs(temporal.reachability(te, people)) == {(1, 1), (2, 2), (3, 3), (4, 4), (1, 2), (2, 3), (3, 1), (3, 4), (2, 4)}
    assert pairs(temporal.reachability(te, people, same_day=True)) == {(4, 4)} | {(i, j) for i in (1, 2, 3) for j in (1, 2, 3, 4)}


@pytest.mark.parametrize("gamma,tol,calendar", [(0.5, 0.0, False), (0.9, 0.0, True), (0.5, 0.3, False), (0.5, 0.3, True)])
def test_fading_memory_is_the_fold(spark, gamma, tol, calendar):
    te, rows, _ = temporal_edges(spark, 3, days=9, n=4, each=3)
    days = sorted({d for d, _, _ in rows})
    if calendar:
        days = [days[0] + dt.timedelta(k) for k in range((days[-1] - days[0]).days + 1)]
    want: dict = {}
    f: dict = {}
    for day in days:
        f = {p: gamma * x for p, x in f.items()}
        for (d, i, j), w in rows.items():
            if d == day:
                f[i, j] = f.get((i, j), 0.0) + w
        f = {p: x for p, x in f.items() if abs(x) > tol}
        want |= {(day, *p): x for p, x in f.items()}
    got = {(r.day, r.src, r.dst): r.f for r in temporal.fading_memory(te, gamma, tol, calendar).collect()}
    assert got == pytest.approx(want)


def test_streamed_memory_takes_late_days(spark, tmp_path):
    from postbag.streaming import threads

    rows = [(1, 2, dt.date(2020, 1, 2), 1.0), (1, 2, dt.date(2020, 1, 5), 2.0), (1, 2, dt.date(2020, 1, 3), 4.0)]
    for k, part in enumerate((rows[:2], rows[2:])):  # the second file is late
        spark.createDataFrame(part, "src long, dst long, day date, w double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("src long, dst long, day date, w double").parquet(f"{tmp_path}/in")
        q = threads.fading_memory(stream, 0.5, 0.0).writeStream.format("memory").queryName("late").outputMode("append").option("checkpointLocation", f"{tmp_path}/c{k}").start()
        q.processAllAvailable()
        q.stop()
    batch = temporal.fading_memory(spark.createDataFrame(rows, "src long, dst long, day date, w double"), 0.5, calendar=True)
    last = {r.day: r.f for r in batch.collect()}[dt.date(2020, 1, 5)]
    assert last in [pytest.approx(r.f) for r in spark.table("late").collect() if r.day == dt.date(2020, 1, 5)]


def test_tensor_words_and_residual(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(4), rng.randrange(4), rng.randrange(8), f"w{rng.randrange(5)}", 1.0) for _ in range(30)]
    t = spark.createDataFrame(rows, "i long, j long, day long, word string, v double")
    people = spark.createDataFrame([(0,), (1,)], "id long")
    used = sorted({r[3] for r in rows if r[2] >= 3})
    got = sorted(tuple(r) for r in tensors.restrict(t, people, 3, renumber=True).select("i", "j", "day", "word").collect())
    assert got == sorted((r[0], r[1], r[2] - 3, used.index(r[3])) for r in rows if r[0] < 2 and r[1] < 2 and r[2] >= 3)
    cells = {(c, r, s): rng.random() for c in range(3) for r in range(4) for s in range(3)}
    x = spark.createDataFrame([(*k, v) for k, v in cells.items()], "c long, r long, s long, v double")
    f = tensors.cp_als(x, ["c", "r", "s"], 2, rounds=4)
    m = {mode: {r.id: np.array(r.f) for r in table.collect()} for mode, table in f.items()}
    left = sum((v - float((m["c"][c] * m["r"][r] * m["s"][s]).sum())) ** 2 for (c, r, s), v in cells.items())
    assert tensors.relative_residual(x, ["c", "r", "s"], f, 2) == pytest.approx((left / sum(v * v for v in cells.values())) ** 0.5)


def test_models_and_labelled_hypergraphs_are_read(spark, tmp_path):
    from pyspark.ml.feature import Word2Vec

    docs = spark.createDataFrame([(["a", "b", "c"] * 5,)] * 4, "words array<string>")
    Word2Vec(vectorSize=4, minCount=1, seed=1, inputCol="words", outputCol="v").fit(docs).save(f"{tmp_path}/w2v")
    assert {r.word: len(r.vector) for r in files.read_word_model(spark, f"{tmp_path}/w2v").collect()} == {"a": 4, "b": 4, "c": 4}
    inc = spark.createDataFrame([(0, 1), (0, 2), (1, 1), (1, 2), (2, 3), (2, 1), (3, 3), (3, 4), (3, 5)], "edge_id long, node_id long")
    lab = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, "z"), (5, "z")], "node_id long, label string")
    inc.write.parquet(f"{tmp_path}/inc")
    lab.write.parquet(f"{tmp_path}/lab")
    cond = {r.label: r.cond for r in hypergraphs.tl_cut(inc, lab, 1.0).collect()}
    for most in (0.3, 0.6, 2.0):
        _, kept = files.read_labelled_hypergraph(spark, f"{tmp_path}/inc", f"{tmp_path}/lab", least=2, most_cond=most)
        assert {r.label for r in kept.collect()} == {x for x in ("x", "z") if cond[x] <= most}


def test_nearest_word_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    words = spark.createDataFrame([(f"w{i}", rng.normal(size=3).tolist()) for i in range(30)], "word string, embedding array<double>")
    vecs = spark.createDataFrame([(i, rng.normal(size=3).tolist()) for i in range(10)], "vec_id long, embedding array<double>")
    want = {r.vec_id: r.word for r in text.nearest_word(vecs, words).collect()}
    assert {r.vec_id: r.word for r in text.nearest_word(vecs, words, block=7).collect()} == want
    assert graphs.drop_small(spark.createDataFrame([(1, 2, 0.5), (1, 3, -2.0)], "src long, dst long, w double"), 1).count() == 1
