"""Operators with the limits of a block, cell or batch set low, against brute force."""

import itertools
import math
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabloom.functions import cuts, ordering, quantiles
from tabloom.operators import evaluate, graph, laws, models, nearest, retrieval, text


def vectors(spark, m, name="id"):
    return spark.createDataFrame(pd.DataFrame({name: range(len(m)), "v": [x.tolist() for x in m]})).repartition(5)


# ---- nearest rows ----


@pytest.mark.parametrize("measure", [nearest.COSINE, nearest.EUCLID])
@pytest.mark.parametrize("small", [True, False])
def test_nearest_rows_of_ten_thousand_queries(spark, measure, small):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 6)) * 4
    x = (centres[rng.integers(0, 12, 3000)] + rng.normal(size=(3000, 6)) * 0.3).round(2)
    x[:40] = x[0]
    x[40] = 0.0
    q = (centres[rng.integers(0, 12, 10_000)] + rng.normal(size=(10_000, 6)) * 0.3).round(2)
    q[0] = 0.0
    limits = {"ball": 64, "slot_bytes": 20_000, "page_bytes": 100_000} if small else {}
    got = nearest.nearest(vectors(spark, x), "id", "v", vectors(spark, q, "q"), "q", "v", 4, measure, **limits).toPandas().sort_values(["q", "rank"])
    if measure == nearest.COSINE:
        unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
        score = unit(q) @ unit(x).T
    else:
        score = -((q[:, None, :] - x[None]) ** 2).sum(2)
    ids, scores = got.id.to_numpy().reshape(-1, 4), got.score.to_numpy().reshape(-1, 4)
    assert np.allclose(scores, -np.sort(-score, axis=1)[:, :4], atol=1e-9)
    assert np.allclose(scores, np.take_along_axis(score, ids, 1), atol=1e-9)
    # equal vectors come by their ids
    same = score.argmax(1) < 40
    assert same.any() and (ids[same] == [0, 1, 2, 3]).all()


def test_balls_far_away_never_meet(spark):
    x = np.concatenate([np.random.default_rng(1).normal(size=(500, 3)) + c for c in (0.0, 100.0, 200.0)])
    d, q = nearest.balls(vectors(spark, x), "id", "v", nearest.EUCLID, 50), nearest.balls(vectors(spark, x[:400], "q"), "q", "v", nearest.EUCLID, 50)
    place = lambda df, c: df.withColumn(c, F.pmod(F.xxhash64("ball"), F.lit(3)).cast("int"))
    met = nearest._meetings(place(q, "page"), place(d, "slot"), 3, 3, 5, nearest.EUCLID)
    assert 0 < met.count() < d.count() * q.count() / 2
    assert d.agg(F.max("n")).first()[0] <= 50 and d.agg(F.sum("n")).first()[0] == 1500


def test_balls_are_compact_and_leaves_prune(spark):
    """Balls cut by their distance from a pivot were shells as wide as all of its rows, and all rows of a slot met all of a page."""
    rng = np.random.default_rng(4)
    x = rng.random((6000, 2))
    d = nearest.balls(vectors(spark, x), "id", "v", nearest.EUCLID, 20)
    assert d.agg(F.avg("radius")).first()[0] < 0.06 and d.agg(F.sum("n")).first()[0] == 6000
    rows = nearest._Leaves(nearest.EUCLID, x[nearest._halved(x, nearest.LEAF)], np.array([6000]))
    q = nearest._Leaves(nearest.EUCLID, rng.random((50, 2)) / 20, np.array([50]))
    seen, real = [], nearest._score
    nearest._score = lambda m, a, b: seen.append(len(a) * len(b)) or real(m, a, b)
    try:
        who, what, score = nearest._leaf_hits(nearest.EUCLID, q.x, rows, rows.best(q, 0), np.arange(6000), 3)
    finally:
        nearest._score = real
    far = ((q.x[:, None] - rows.x[None]) ** 2).sum(2)
    assert np.allclose(-score.reshape(-1, 3), np.sort(far, axis=1)[:, :3]) and (who == np.repeat(np.arange(50), 3)).all()
    assert sum(seen) < 0.8 * far.size


def test_nearest_rows_with_gaps_and_without_rows(spark):
    some = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [2.0, 0.0]), ("c", None), ("a", [0.0, 1.0])], "k string, v array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "q int, v array<double>")
    got = nearest.nearest(some, "k", "v", asked, "q", "v", 5).orderBy("rank").collect()
    assert [(r["q"], r["k"], r["rank"]) for r in got] == [(1, "a", 1), (1, "b", 2), (1, "a", 3)]
    assert nearest.nearest(some.where("k = 'x'"), "k", "v", asked, "q", "v", 5).count() == 0
    assert nearest.nearest(some, "k", "v", asked.where("q > 5"), "q", "v", 5).count() == 0


@pytest.mark.parametrize("limits", [{}, {"POSTINGS": 20, "SEEDS": 2, "SEED_WORDS": 1}])
def test_lexical_search_against_all_pairs(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(retrieval, name, value)
    rng = np.random.default_rng(5)
    word = lambda: f"w{min(int(rng.zipf(1.4)), 300)}"
    docs = [(i, " ".join(["the", *(word() for _ in range(rng.integers(0, 40)))])) for i in range(400)] + [(400, None), (401, "?!"), (402, "The THE")]
    asked = [(i, " ".join(word() for _ in range(rng.integers(1, 12)))) for i in range(40)] + [(40, "the"), (41, "the w1 nowhere nothing"), (42, "unknown"), (43, None), (44, "")]
    got: dict = {}
    for r in retrieval.lexical_search(spark.createDataFrame(docs, "id int, t string").repartition(4), "id", "t", spark.createDataFrame(asked, "q int, t string"), "q", "t", 6).collect():
        got.setdefault(r["q"], []).append((r["rank"], round(-r["score"], 9), r["id"]))
    sets = lambda t: set(re.findall("[a-z0-9]+", (t or "").lower()))
    for q, t in asked:
        s = sets(t)
        found = sorted((round(-len(s & sets(d)) / len(s | sets(d)), 9), i) for i, d in docs if s & sets(d))[:6]
        assert sorted(got.get(q, [])) == [(n + 1, *f) for n, f in enumerate(found)], q


@pytest.mark.parametrize("task", ["classification", "regression"])
def test_neighbours_as_a_model(spark, task):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 2))
    df = spark.createDataFrame(pd.DataFrame({"i": range(600), "a": x[:, 0], "b": x[:, 1], "y": (x[:, 0] > 0).astype(int) if task == "classification" else x[:, 0] * 3}))
    train, test, _ = models.prepare(df, "y", ["a", "b"], ["i"], task)
    table, fitted = models.leaderboard(train, test, ["knn"], task)
    assert table.first()["score"] > 0.95
    tr, te = (t.select("i", "features", "label").toPandas() for t in (train, test))
    t, e = np.stack([v.toArray() for v in tr.features]), np.stack([v.toArray() for v in te.features])
    near = np.argsort(((e[:, None] - t[None]) ** 2).sum(2), axis=1)[:, :5]
    want = tr.label.to_numpy()[near].mean(1)
    got = fitted["knn"].transform(test).toPandas().set_index("i").loc[te.i]
    assert got.prediction.to_numpy() == pytest.approx((want > 0.5).astype(float) if task == "classification" else want)


# ---- order ----


def test_buckets_grow_with_rows_beyond_one_level(spark):
    counts = []
    for n in (300, 5000):
        df = spark.range(n).select((F.col("id") * 7919 % n).alias("v"), F.lit(1).alias("one"))
        placed, split = cuts.place(df, F.col("v"), (), "b", small=10, fanout=8)
        per = placed.groupBy("b").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("b").collect()
        assert split and all(a["hi"] < b["lo"] for a, b in zip(per, per[1:])) and sum(r["n"] for r in per) == n
        counts.append(len(per))
        got = ordering.running_totals(df, "v", ["one"], buckets=8, small=10).orderBy("v").toPandas()
        assert got.cum_one.tolist() == list(range(1, n + 1)) and got.next_v.tolist()[:-1] == list(range(1, n)) and math.isnan(got.next_v.iloc[-1])
    assert counts[0] >= 25 and counts[1] > 200 > 8 * 8 > counts[0]


def test_one_value_cannot_be_cut(spark):
    placed, _ = cuts.place(spark.range(500).select(F.lit(3).alias("v")), F.col("v"), (), "b", small=5, fanout=4)
    assert placed.select("b").distinct().count() == 1 and placed.columns == ["v", "b"]


@pytest.mark.parametrize("few", [True, False])
def test_brackets_shrink_until_few_rows_are_kept(spark, monkeypatch, few):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.exponential(size=20_000), np.full(9_000, 0.7)])
    pdf = pd.DataFrame({"column": np.where(np.arange(29_000) % 3, "a", "b"), "value": x})
    df, probs = spark.createDataFrame(pdf).repartition(5), [0.0, 0.01, 0.333, 0.5, 0.95, 1.0]
    sketch = df.groupBy("column").agg(F.count("value").alias("_n"), F.percentile_approx("value", [max(p - 0.02, 0) for p in probs] + [min(p + 0.02, 1) for p in probs], 100).alias("_b"))
    small = quantiles._narrowed(df, sketch, ["column"], probs, 100, 40, few).collect()
    for r in small:
        own = pdf[pdf.column == r["column"]].value.to_numpy()
        for lo, hi in zip(r["_b"][:6], r["_b"][6:]):
            assert lo == hi or ((own >= lo) & (own <= hi)).sum() <= 40
    got = {r["column"]: r["quantiles"] for r in quantiles.long_quantiles(df, probs, accuracy=100, few_groups=few, kept=40).collect()}
    for c, part in pdf.groupby("column"):
        assert got[c] == pytest.approx(list(np.quantile(part.value, probs)), abs=1e-12)


# ---- frontier ----


@pytest.mark.parametrize("cell_rows", [20_000, 9])
def test_hypervolume_in_cells(spark, cell_rows):
    m = np.random.default_rng(4).integers(1, 12, size=(120, 3)).astype(float)
    df = spark.createDataFrame(pd.DataFrame(m, columns=["p", "r", "f"]))
    cube = np.zeros((12, 12, 12), bool)
    for p, r, f in m.astype(int):
        cube[:p, :12 - r, :f] = True
    assert evaluate.hypervolume(df, "p", "r", "f", (0.0, 12.0, 0.0), cell_rows).first()[0] == pytest.approx(cube.sum())
    assert evaluate.hypervolume(df.where("p > 50"), "p", "r", "f", (0.0, 12.0, 0.0), cell_rows).first()[0] == 0.0


def test_skyline_of_an_anticorrelated_table(spark):
    rng = np.random.default_rng(1)
    m = rng.dirichlet([1, 1, 1], 3000)
    m[1500:] *= 0.9
    df = spark.createDataFrame(pd.DataFrame({"n": range(3000), "p": m[:, 0], "r": -m[:, 1], "f": m[:, 2]})).unionAll(spark.createDataFrame([(9000, None, 1.0, 1.0)], "n long, p double, r double, f double"))
    got = {r["n"] for r in evaluate.skyline(df.repartition(7), "p", "r", "f", 60).collect()}
    assert got == {i for i in range(3000) if not ((m >= m[i]).all(1) & (m > m[i]).any(1)).any()} | {9000}


# ---- graphs ----


def ring(spark, n, extra):
    rng = np.random.default_rng(6)
    pairs = {(i, (i + 1) % n) for i in range(n)} | {tuple(sorted(p)) for p in rng.integers(0, n, (extra, 2)).tolist() if p[0] != p[1]} | {(0, j) for j in range(2, n, 7)}
    return {tuple(sorted(p)) for p in pairs}


def brandes(n, pairs):
    near = [[] for _ in range(n)]
    for a, b in pairs:
        near[a].append(b)
        near[b].append(a)
    out = np.zeros(n)
    for s in range(n):
        order, before, paths, dist = [], [[] for _ in range(n)], np.zeros(n), np.full(n, -1)
        paths[s], dist[s], queue = 1, 0, [s]
        for v in queue:
            order.append(v)
            for w in near[v]:
                if dist[w] < 0:
                    dist[w] = dist[v] + 1
                    queue.append(w)
                if dist[w] == dist[v] + 1:
                    paths[w] += paths[v]
                    before[w].append(v)
        delta = np.zeros(n)
        for w in reversed(order):
            for v in before[w]:
                delta[v] += paths[v] / paths[w] * (1 + delta[w])
            if w != s:
                out[w] += delta[w]
    return out / ((n - 1) * (n - 2))


def test_betweenness_in_batches_with_hubs(spark, monkeypatch):
    monkeypatch.setattr(graph, "SLOT_EDGES", 5)
    pairs = ring(spark, 40, 60)
    e = graph.edges(spark.createDataFrame([(f"{a:03}", f"{b:03}") for a, b in pairs], "a string, b string"), "a", "b")
    got = {r["node"]: r["betweenness"] for r in graph.betweenness(e, state_rows=40 * 20).collect()}
    assert [got[f"{i:03}"] for i in range(40)] == pytest.approx(brandes(40, pairs).tolist(), abs=1e-12)


@pytest.mark.parametrize("slot", [2_000, 2])
def test_triangles_with_heavy_nodes(spark, monkeypatch, slot):
    monkeypatch.setattr(graph, "WEDGE_ENDS", slot)
    pairs = ring(spark, 50, 150)
    e = graph.edges(spark.createDataFrame([(f"{a:03}", f"{b:03}") for a, b in pairs] + [("001", "001")], "a string, b string"), "a", "b")
    got = {r["node"]: r["triangles"] for r in graph.triangles(e).collect()}
    want: dict = {}
    for t in itertools.combinations(range(50), 3):
        if all(p in pairs for p in itertools.combinations(t, 2)):
            for v in t:
                want[f"{v:03}"] = want.get(f"{v:03}", 0) + 1
    assert got == want


def test_pagerank_over_many_rounds(spark):
    pairs = sorted(ring(spark, 40, 20))
    e = graph.edges(spark.createDataFrame([(f"{a:03}", f"{b:03}") for a, b in pairs], "a string, b string"), "a", "b")
    got = {r["node"]: r["pagerank"] for r in graph.pagerank(e, tol=1e-8).collect()}
    m = np.zeros((40, 40))
    for a, b in pairs:
        m[a, b] = m[b, a] = 1
    p = np.full(40, 1 / 40)
    for _ in range(300):
        p = 0.15 / 40 + 0.85 * (m / m.sum(0)) @ p
    assert np.allclose([got[f"{i:03}"] for i in range(40)], p, atol=1e-6)


# ---- fits ----


def test_svd_beyond_one_block(spark):
    rng = np.random.default_rng(12)
    docs = [" ".join(f"t{min(int(z), 150)}" for z in rng.zipf(1.3, rng.integers(3, 30))) for _ in range(300)]
    df = spark.createDataFrame(pd.DataFrame({"k": range(300), "t": docs})).repartition(4)
    model = text.tfidf(df, "k", "t", 200, True, [])
    w = model.weights.toPandas()
    x = np.zeros((300, model.size))
    x[w.k, w.term_id] = w.weight
    svd = text.fit_svd(model, 6)
    assert svd.singular == pytest.approx(np.linalg.svd(x, compute_uv=False)[:6], rel=1e-9)
    assert np.allclose(svd.components.T @ svd.components, np.eye(6), atol=1e-9)
    assert np.allclose(x.T @ (x @ svd.components), svd.components * svd.singular**2, atol=1e-6)


@pytest.mark.parametrize("kind", ["noise", "falling", "rising", "steps"])
@pytest.mark.parametrize("increasing", [True, False])
def test_monotone_fit_in_parts(spark, kind, increasing):
    rng = np.random.default_rng(3)
    n = 900
    x = rng.permutation(n) // 2
    y = {"noise": rng.normal(size=n), "falling": -x * 1.0, "rising": x + rng.normal(size=n) * 20, "steps": np.floor(x / 100) + rng.normal(size=n) * 0.1}[kind].round(3)
    w = rng.integers(1, 5, n).astype(float)
    pdf = pd.DataFrame({"x": x, "y": y, "w": w})
    got = laws.monotone_fit(spark.createDataFrame(pdf), "x", "y", "w", increasing, block=20).toPandas().groupby("x").fitted.agg(["min", "max"])
    g = pdf.assign(s=pdf.w * pdf.y).groupby("x")[["w", "s"]].sum()
    sign = 1 if increasing else -1
    s, t = np.concatenate([[0], (sign * g.s).cumsum()]), np.concatenate([[0], g.w.cumsum()])
    mean = np.array([[(s[j + 1] - s[i]) / (t[j + 1] - t[i]) if j >= i else np.inf for j in range(len(g))] for i in range(len(g))])
    # the fit at k is the greatest over i <= k of the least mean from i to some j >= k
    least = np.minimum.accumulate(mean[:, ::-1], axis=1)[:, ::-1]
    want = sign * np.array([least[:k + 1, k].max() for k in range(len(g))])
    assert np.allclose(got["min"], want, atol=1e-9) and np.allclose(got["max"], want, atol=1e-9)


def test_rows_with_missing_features_are_scored(spark):
    rng = np.random.default_rng(5)
    z = rng.normal(size=(400, 2))
    m = z @ rng.normal(size=(2, 4)) + rng.normal(size=(400, 4)) * 0.05
    m[5, 2] += 4
    m[6, 3] += 4
    pdf = pd.DataFrame(m, columns=list("abcd")).assign(i=range(400))
    gaps = pdf.copy()
    gaps.loc[6, "a"] = None
    gaps.loc[20:60, "b"] = None
    gaps.loc[399, list("abcd")] = None
    for data, wanted in ((pdf, {5, 6}), (gaps, {5, 6})):
        rows, per = models.reconstruction_anomalies(spark.createDataFrame(data).withColumns({c: F.nanvl(c, F.lit(None)) for c in "abcd"}), list("abcd"), 2, 0.99)
        got = rows.toPandas().set_index("i")
        assert len(got) == 400 and wanted <= set(got[got.anomaly].index) and per.count() == 4
    assert math.isnan(got.error[399]) and not got.anomaly[399] and got.error[25] >= 0
    whole = models.reconstruction_anomalies(spark.createDataFrame(pdf), list("abcd"), 2)[0].toPandas().sort_values("i")
    s = (m - m.mean(0)) / m.std(0, ddof=1)
    v = np.linalg.eigh(np.corrcoef(m.T))[1][:, ::-1][:, :2]
    assert np.allclose(whole.error, ((s - s @ v @ v.T) ** 2).mean(1), atol=1e-6)
