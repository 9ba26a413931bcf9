"""Planted-truth tests of the operators."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabloom.operators import causal, clean, contract, drift, evaluate, features, graph, insight, laws, leakage, match, models, privacy, profile, query, retrieval, scenario, text
from tabloom.sources import glossary, readers, writers


def frame(spark, **cols):
    return spark.createDataFrame(pd.DataFrame(cols))


# ---- sources ----


def test_csv_delimiter_headers_and_encoding(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id;  user name ;user name;\n1;x;y;2.5\n2;u;v;3.5\n", encoding="utf-8-sig")
    df = readers.read_any(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["id", "user name", "user name_1", "column_4"]
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, "x", "y", 2.5), (2, "u", "v", 3.5)]
    (tmp_path / "b.csv").write_bytes("employé,salaire\nRené,10\nZoé,20\n".encode("latin-1"))
    b = readers.read_csv(spark, str(tmp_path / "b.csv"))
    assert b.columns[0] == "employé" and b.agg(F.sum("salaire")).first()[0] == 30
    (tmp_path / "c.tsv").write_text("a\tb\n1\t2\n")
    assert readers.read_any(spark, str(tmp_path / "c.tsv")).first().asDict() == {"a": 1, "b": 2}


def test_malformed_rows_are_skipped_and_countable(spark, tmp_path):
    (tmp_path / "m.csv").write_text("a,b\n1,2\nx,3\n4,5\n")
    schema = "a int, b int"
    from pyspark.sql.types import StructType
    st = StructType.fromDDL(schema)
    assert readers.read_csv(spark, str(tmp_path / "m.csv"), schema=st).count() == 2
    assert readers.malformed_rows(spark, str(tmp_path / "m.csv"), st).first()["line"] == "x,3"


@pytest.mark.parametrize("body", ['[{"a":1,"b":{"c":"x"}},{"a":2,"b":{"c":"y"}}]', '{"a":1,"b":{"c":"x"}}\n{"a":2,"b":{"c":"y"}}\n', '{"data":[{"a":1,"b":{"c":"x"}},{"a":2,"b":{"c":"y"}}]}'])
def test_json_shapes(spark, tmp_path, body):
    (tmp_path / "j.json").write_text(body)
    df = readers.read_json(spark, str(tmp_path / "j.json"))
    assert sorted(df.columns) == ["a", "b.c"] and df.count() == 2


def test_gates_and_options(spark):
    with pytest.raises(readers.SourceError):
        readers.check_shape(spark.range(3))
    with pytest.raises(readers.SourceError):
        readers.jdbc_options("jdbc:x", table="a; drop table b")
    assert readers.jdbc_options("jdbc:x", query="select 1 ; ", limit=5)["query"] == "SELECT * FROM (select 1) q LIMIT 5"
    assert readers.redact("jdbc:pg://me:secret@host/db") == "jdbc:pg://me:***@host/db"
    assert readers.object_uri("s3", "b", "/k.csv") == "s3a://b/k.csv"
    assert readers.clean_headers(["  user name  ", "user name", "col\twith\nnewlines", "", None]) == ["user name", "user name_1", "col with newlines", "column_4", "column_5"]
    assert readers.clean_control_names(["a\x00b", "\x01"]) == ["ab", "unnamed_1"]


def test_sinks_round_trip(spark, tmp_path):
    df = frame(spark, k=[1, 2, 2], v=["a", "b", "c"])
    writers.write_parquet(df, str(tmp_path / "p"), partition_by=["k"])
    writers.write_json(df, str(tmp_path / "j"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 3 and spark.read.json(str(tmp_path / "j")).count() == 3


def test_glossary(spark):
    raw = frame(spark, **{" Term ": ["ARR", " ", "Churn"], "Definition": ["x", "y", " z "]})
    assert sorted(tuple(r) for r in glossary.load(raw).collect()) == [("ARR", "x"), ("Churn", "z")]
    assert glossary.safe_to_keep(glossary.load(raw))
    mail = frame(spark, term=["a", "b", "c"], definition=["x@y.com", "z@w.org", "u@v.net"])
    assert not glossary.safe_to_keep(glossary.load(mail))


# ---- cleaning, contracts, privacy ----


def test_repair_of_a_dirty_table(spark):
    df = frame(spark, **{
        " Price ($) ": ["€120.50", "$1.5k", "2,000", "n/a"], "Prime": ["Yes", "no", "--", "YES"], "x": [1.0, float("inf"), float("-inf"), 2e15], "z": ["a\u00a0", "b\x01", "?", "c"],
    }).withColumn("dead", F.lit(None).cast("string"))
    out, report = clean.repair(df)
    rows = out.collect()
    assert out.columns == ["Price", "Prime", "x", "z"]
    assert [r["Price"] for r in rows] == [120.5, 1500.0, 2000.0, None] and [r["Prime"] for r in rows] == [1.0, 0.0, None, 1.0]
    assert [r["x"] for r in rows] == [1.0, None, None, 1e15] and [r["z"] for r in rows] == ["a", "b", None, "c"]
    kinds = {(r["kind"], r["column"]): r["count"] for r in report.collect()}
    assert kinds[("inf_replaced", "x")] == 2 and kinds[("null_tokens", "Price")] == 1 and ("dropped_all_null", "dead") in kinds
    assert clean.repaired_names(["A b", "a_b", "", "Unnamed: 0"]) == ["A_b", "a_b_1", "feature", "feature_1"]


def test_contract_finds_violations(spark):
    good = frame(spark, n=[1.0, 2.0, 3.0], c=["a", "b", "a"], y=[0, 1, 0])
    rules = contract.learn(good, "y")
    assert contract.summary(contract.check(good, rules)).first()["success"]
    bad = frame(spark, n=[1.0, 9.0, None], c=["a", "zz", "a"], y=[0, 1, 0])
    failed = {(r["rule"], r["column"]) for r in contract.check(bad, rules).where("not success").collect()}
    assert failed == {("between", "n"), ("not_null", "n"), ("in_set", "c")}
    assert not contract.check(good.drop("c"), rules).where("rule = 'columns_match_set'").first()["success"]


def test_masking(spark):
    df = frame(spark, e=["bob@x.com", "b@y.org", "secret", "abc"], n=[1234.9, -7.0, float("inf"), 5.0])
    rows = privacy.mask(df, ["e", "n"]).collect()
    assert [r["e"] for r in rows] == ["b***@x.com", "***@y.org", "se**et", "***"]
    assert [r["n"] for r in rows] == ["***34", "***93", "***00", "***05"]
    assert privacy.guarded_columns(["email_addr", "amount", "Age"]) == ["email_addr", "Age"]


def test_streaming_uses_the_same_expressions(spark, tmp_path):
    from tabloom import streaming

    df = frame(spark, id=[1, 2], mail=["a@b.co", "cc@d.io"], amount=["$1k", "2"])
    df.write.parquet(str(tmp_path / "in"))
    plan = clean.plan_repair(df)
    stream = streaming.mask(streaming.apply_plan(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), plan), ["mail"])
    q = stream.writeStream.format("memory").queryName("cleaned").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(tuple(r) for r in spark.table("cleaned").collect()) == [(1, "***@b.co", 1000.0), (2, "c***@d.io", 2.0)]


# ---- profile, match, query ----


def test_roles_of_a_churn_table(spark):
    n = 300
    df = frame(spark, customer_id=range(n), tenure_months=[i % 60 for i in range(n)], monthly_charges=[20 + i * 0.31 for i in range(n)], churn_flag=[i % 2 for i in range(n)])
    got = {r["column"]: r["role"] for r in profile.roles(df).collect()}
    assert got == {"customer_id": "identifier", "tenure_months": "duration / tenure", "monthly_charges": "numeric feature", "churn_flag": "target candidate"}
    assert profile.fingerprint(df).first() == profile.fingerprint(df.repartition(5).orderBy(F.col("customer_id").desc())).first()


def test_column_matching_tiers(spark):
    df = frame(spark, customer_id=[1, 2], sale_price=[1.0, 2.0], annual_income=[1.0, 2.0], default_risk=[0, 1], outcome_type=["fraud ring", "legit"])
    words = frame(spark, term=["SalePrice", "defualt", "income", "ring", "sale_price"])
    got = {r["term"]: (r["column"], r["tier"]) for r in match.match_columns(words, match.catalogue({"t": df})).collect()}
    assert got == {"SalePrice": ("sale_price", "normalised"), "defualt": ("default_risk", "fuzzy"), "income": ("annual_income", "substring"), "ring": ("outcome_type", "value"), "sale_price": ("sale_price", "exact")}
    goals = frame(spark, g=[1], text=["predict default risk of a customer"])
    assert match.rank_targets(goals, "g", "text", df).where("rank = 1").first()["column"] == "default_risk"


def test_protected_columns_answer_counts_only(spark):
    df = frame(spark, email=["a", None], v=[1.0, 2.0])
    with pytest.raises(query.ProtectedColumn):
        query.describe_column(df, "email", protected=["email"])
    assert query.null_count(df, "email").first()["nulls"] == 1


def test_normality_p_separates_shapes(spark):
    rng = np.random.default_rng(8)
    df = frame(spark, g=rng.normal(size=3000), u=rng.uniform(size=3000))
    assert query.numeric_distribution(df, "g").first()["normality_p"] > 0.01 > query.numeric_distribution(df, "u").first()["normality_p"]


# ---- audits and insights ----


def test_leakage_proxy_id_and_clean_feature(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 200)
    df = frame(spark, clean_feat=rng.normal(size=200), proxy_leak=y * 10 + rng.normal(0, 0.01, 200), customer_uuid=[f"u{i}" for i in range(200)], target=y)
    a = leakage.audit(df, "target")
    got = {r["column"]: r["severity"] for r in a.collect()}
    assert got["proxy_leak"] == "CRITICAL" and got["customer_uuid"] != "CLEAN" and got["clean_feat"] == "CLEAN"
    assert leakage.overall_risk(a, leakage.contradictions(df, "target")).first()["risk_score"] > 40
    assert leakage.quarantine(df, a).columns == ["clean_feat", "target"]
    clash = frame(spark, a=[1.0, 2.0, 1.0, 3.0], b=[1.0, 2.0, 1.0, 3.0], y=[0, 1, 1, 0])
    assert leakage.contradictions(clash, "y").first()["conflict_count"] == 1


def test_drift_sees_a_shift_and_not_noise(spark):
    rng = np.random.default_rng(1)
    ref, same, far = (frame(spark, x=rng.normal(m, 1, 1000)) for m in (0, 0, 10))
    assert drift.numeric_psi(ref, same, ["x"]).first()["psi"] < 0.10
    assert drift.numeric_psi(ref, far, ["x"]).first()["psi"] > 0.5
    d = drift.distances(ref, far, ["x"]).first()
    assert d["ks"] > 0.99 and d["p_value"] < 1e-6 and d["wasserstein"] == pytest.approx(10, abs=0.2)
    assert drift.mmd(ref, far, ["x"]) > 0.45 > 0.2 > drift.mmd(ref, same, ["x"])


def test_outlier_rate_rises_with_a_shift(spark):
    rng = np.random.default_rng(2)
    ref = frame(spark, a=rng.normal(size=2000), b=rng.normal(size=2000))
    far = frame(spark, a=rng.normal(6, 1, 500), b=rng.normal(-6, 1, 500))
    assert drift.outlier_rate(ref, far).first()["anomaly_pct"] > 80
    assert 2 <= drift.outlier_rate(ref, ref).first()["anomaly_pct"] <= 6


def test_insights_find_what_was_planted(spark):
    rng = np.random.default_rng(3)
    x = np.linspace(-10, 10, 300)
    df = frame(spark, x=x, m=np.linspace(10, 100, 300), y=0.5 * x**2 + rng.normal(0, 1.5, 300), s=np.where(np.linspace(10, 100, 300) > 55, 45.0, 15.0) + rng.normal(0, 1, 300), e=rng.normal(size=300))
    assert insight.curved_relations(df, ["x"], F.col("y")).first()["found"]
    t = insight.threshold_effects(df, ["m"], F.col("s")).first()
    assert t["found"] and t["threshold"] == pytest.approx(55, abs=1)
    assert not insight.curved_relations(df, ["x"], F.col("e")).first()["found"] and insight.linear_relations(df, ["x", "m"], F.col("e")).count() == 0
    kinds = [r["kind"] for r in insight.insights(df.select("x", "y"), "y", "regression").collect()]
    assert kinds[0] == "curve"


def test_simpson_reversal(spark):
    rng = np.random.default_rng(4)
    base = np.repeat([0, 20, 40], 60)
    x = base + rng.uniform(0, 10, 180)
    df = frame(spark, ad=x, revenue=np.repeat([40, 75, 110], 60) - 2 * (x - base) + rng.normal(0, 1, 180) + base, tier=np.repeat(["a", "b", "c"], 60))
    r = insight.reversals(df, ["ad"], F.col("revenue"), ["tier"]).first()
    assert r["r_global"] > 0.35 and r["mean_group_r"] < -0.7 and r["reversed"] == 3


# ---- features ----


def test_label_direction_and_split(spark):
    assert features.positive_class(["Default", "Non-Default"]) == "Default" and features.positive_class(["no", "yes"]) == "yes"
    df = spark.range(1000).select("id", (F.col("id") % 4 == 0).cast("int").alias("y"))
    s = features.stratified_split(df, "y", ["id"])
    a, b = (sorted(r["id"] for r in x.where("is_train").collect()) for x in (s, features.stratified_split(df.repartition(7), "y", ["id"])))
    assert a == b and len(a) == 800


# ---- graph, text, retrieval ----


def small_graph(spark):
    pairs = [("a", "b", 1.0), ("b", "c", 1.0), ("c", "a", 1.0), ("c", "d", 2.0), ("d", "e", 1.0), ("x", "y", 1.0), ("b", "a", 1.0), ("e", "f", 1.0), ("d", "f", 5.0)]
    return graph.edges(spark.createDataFrame(pairs, "s string, t string, w double"), "s", "t", "w")


def brandes(edges, nodes):
    adj = {n: {} for n in nodes}
    for u, v, w in edges:
        adj[u][v] = adj[v][u] = w
    score = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        dist, sigma, order, todo = {s: 0.0}, {s: 1.0}, [], {s}
        pred = {n: [] for n in nodes}
        while todo:
            v = min(todo, key=lambda n: dist[n])
            todo.discard(v)
            order.append(v)
            for w, d in adj[v].items():
                new = dist[v] + d
                if w not in dist or new < dist[w] - 1e-12:
                    dist[w], sigma[w], pred[w] = new, sigma[v], [v]
                    todo.add(w)
                elif abs(new - dist[w]) < 1e-12 and w not in order:
                    sigma[w] += sigma[v]
                    pred[w].append(v)
        delta = dict.fromkeys(nodes, 0.0)
        for w in reversed(order):
            for v in pred[w]:
                delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
            if w != s:
                score[w] += delta[w]
    n = len(nodes)
    return {k: v / ((n - 1) * (n - 2)) for k, v in score.items()}


def test_graph_measures_against_brute_force(spark):
    e = small_graph(spark)
    edges = [(r["u"], r["v"], r["weight"]) for r in e.collect()]
    nodes = sorted({n for u, v, _ in edges for n in (u, v)})
    assert {r["node"]: r["component"] for r in graph.components(e).collect()} == {n: "x" if n in "xy" else "a" for n in nodes}
    got = {r["node"]: r["betweenness"] for r in graph.betweenness(e).collect()}
    assert got == pytest.approx(brandes(edges, nodes))
    m = np.zeros((len(nodes), len(nodes)))
    for u, v, w in edges:
        i, j = nodes.index(u), nodes.index(v)
        m[i, j] = m[j, i] = w
    p = np.full(len(nodes), 1 / len(nodes))
    for _ in range(200):
        p = 0.15 / len(nodes) + 0.85 * p @ (m / m.sum(1, keepdims=True))
    ranks = {r["node"]: r["pagerank"] for r in graph.pagerank(e, tol=1e-9).collect()}
    assert ranks == pytest.approx(dict(zip(nodes, p)), abs=1e-6)
    c = {r["node"]: r["clustering"] for r in graph.clustering(e).collect()}
    assert c["a"] == 1.0 and c["c"] == pytest.approx(1 / 3) and c["x"] == 0.0


def test_long_chain_is_one_component(spark):
    chain = spark.range(400).select(F.format_string("%05d", "id").alias("s"), F.format_string("%05d", F.col("id") + 1).alias("t"))
    assert graph.components(graph.edges(chain, "s", "t")).select("component").distinct().count() == 1


def test_svd_embedding_equals_numpy(spark):
    docs = ["red apple pie", "green apple tart", "fast red car", "slow green car", "apple apple car", "pie and tart"]
    df = frame(spark, k=range(6), t=docs)
    model = text.tfidf(df, "k", "t", 50, True, [])
    w = model.weights.toPandas()
    x = np.zeros((6, model.size))
    x[w.k, w.term_id] = w.weight
    assert np.linalg.norm(x, axis=1) == pytest.approx(np.ones(6))
    svd = text.fit_svd(model, 2)
    e = text.embed(model, svd, "e").orderBy("k").select("e_0", "e_1").toPandas().to_numpy()
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    assert np.abs(e) == pytest.approx(np.abs(u[:, :2] * s[:2]), abs=1e-8)
    assert text.fuse(df, "k", ["t"], 2, 50).count() == 6


def test_retrieval_against_brute_force(spark):
    rng = np.random.default_rng(6)
    m = rng.normal(size=(60, 8))
    docs = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id long, v array<double>").repartition(4)
    q = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(3, 8)))], "q long, w array<double>")
    got = retrieval.vector_search(docs, "id", "v", q, "q", "w", 4)
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    for r in q.collect():
        want = np.argsort(-(unit @ np.array(r["w"])))[:4].tolist()
        assert [x["id"] for x in got.where(F.col("q") == r["q"]).orderBy("rank").collect()] == want


# ---- laws and causes ----


def test_laws_are_found_and_noise_is_not(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(500, 5)) * 10
    x[:, 2] = 2 * x[:, 0] - 1.5 * x[:, 1]
    found = laws.discover(frame(spark, **{f"X{i + 1}": x[:, i] for i in range(5)}))
    assert len(found) == 1 and found[0].coefficients == {"X1": 2.0, "X2": -1.5, "X3": -1.0}
    assert laws.discover(frame(spark, a=rng.normal(size=300), b=rng.normal(size=300))) == []
    u = rng.uniform(0, 1000, 400)
    affine = laws.discover(frame(spark, a=u, b=1000 - u, c=rng.normal(size=400)))
    assert len(affine) == 1 and affine[0].total == 1000.0 and affine[0].coefficients == {"a": 1.0, "b": 1.0}


def test_projection_simplex_and_isotonic(spark):
    law = laws.Law("balance", {"a": 1.0, "b": 1.0, "c": -1.0}, 0.0)
    df = frame(spark, k=[1], a=[100.0], b=[50.0], c=[80.0])
    assert laws.residuals(laws.project(df, [law], ["a", "b", "c"]), [law], ["k"]).first()["error"] < 1e-12
    p = spark.createDataFrame([([-0.5, 2.0, 0.3, 0.0, 1.5],)], "v array<double>").select(laws.simplex("v").alias("p")).first()["p"]
    assert sum(p) == pytest.approx(1.0) and min(p) >= 0 and p == pytest.approx([0, 0.75, 0, 0, 0.25])
    fit = laws.monotone_fit(frame(spark, x=range(6), y=[1.0, 3.0, 2.0, 5.0, 4.0, 6.0]), "x", "y").orderBy("x").toPandas().fitted.tolist()
    assert fit == pytest.approx([1, 2.5, 2.5, 4.5, 4.5, 6])


def test_causal_chain_and_do(spark):
    rng = np.random.default_rng(18)
    z = rng.normal(size=2000)
    x = 0.8 * z + rng.normal(0, 0.5, 2000)
    y = 1.2 * x + rng.normal(0, 0.5, 2000)
    df = frame(spark, Z=z, X=x, Y=y, W=rng.normal(size=2000))
    g = causal.discover_graph(df, "Y", alpha=0.01)
    assert g.adjacent("X", "Y") and g.adjacent("Z", "X") and not g.adjacent("Z", "Y") and not g.adjacent("W", "Y")
    income = rng.uniform(10, 50, 400)
    d = frame(spark, i=range(400), Income=income, Spending=2.5 * income + rng.normal(0, 2, 400))
    e = causal.intervention(d, "Income", "Spending", 40.0, causal.Graph(["Income", "Spending"], {("Income", "Spending")}), keys=["i"]).first()
    assert e["expected"] == pytest.approx(100, abs=2) and e["ci_lower"] <= e["ate"] <= e["ci_upper"]
    collider = causal.Graph(["a", "b", "c"], {("a", "c"), ("b", "c")})
    assert causal.structural_role(collider, "a", "b", "c") == "Collider"


# ---- evaluation, models, scenarios ----


def test_hypervolume_and_skyline(spark):
    pts = spark.createDataFrame([("a", 10.0, 5.0, 5.0), ("b", 10.0, 5.0, 5.0), ("c", 1.0, 9.0, 1.0)], "n string, p double, r double, f double")
    f = evaluate.skyline(pts, "p", "r", "f")
    assert sorted(r["n"] for r in f.collect()) == ["a", "b"]
    assert evaluate.hypervolume(f, "p", "r", "f", (0.0, 10.0, 0.0)).first()[0] == 250.0


@pytest.mark.parametrize("cell_rows", [2048, 20])
def test_skyline_in_cells(spark, cell_rows):
    m = np.random.default_rng(9).random((400, 3)).round(2)
    got = {r["n"] for r in evaluate.skyline(frame(spark, n=range(400), p=m[:, 0], r=m[:, 1], f=m[:, 2]).repartition(6), "p", "r", "f", cell_rows).collect()}
    b = m * [1, -1, 1]
    want = {i for i in range(400) if not ((b >= b[i]).all(1) & (b > b[i]).any(1)).any()}
    assert got == want


def test_conformal_coverage(spark):
    rng = np.random.default_rng(10)
    p = rng.beta(2, 2, 2000)
    y = np.where(rng.random(2000) < p, "dog", "cat")
    df = spark.createDataFrame([(i, float(a), [1 - float(a), float(a)], str(b)) for i, (a, b) in enumerate(zip(p, y))], "i long, x double, probs array<double>, y string")
    cal, test = df.where("i < 1000"), df.where("i >= 1000")
    q = evaluate.conformal_threshold(cal.withColumn("s", evaluate.class_score("y", "probs", ["cat", "dog"])), "s")
    mean, std = evaluate.center_spread(cal, ["x"])
    r = evaluate.conformal_report(evaluate.conformal_sets(test, "probs", ["cat", "dog"], q, evaluate.distance_to_center(["x"], mean, std)), "y", q).first()
    assert r["coverage"] >= 0.85


@pytest.fixture(scope="module")
def trained(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(600, 2))
    df = spark.createDataFrame(pd.DataFrame({"i": range(600), "a": x[:, 0], "b": x[:, 1], "c": np.where(x[:, 0] > 1, "hi", "lo"), "y": (x[:, 0] + 0.5 * x[:, 1] + rng.normal(0, 0.4, 600) > 0).astype(int)}))
    return df, models.prepare(df, "y", ["a", "b", "c"], ["i"])


def test_models_learn_and_explain(spark, trained):
    df, (train, test, prep) = trained
    table, fitted = models.leaderboard(train, test, ["logreg", "dt"])
    scores = {r["model"]: r["score"] for r in table.collect()}
    assert scores["logreg"] > 0.9 and scores["dt"] > 0.8
    assert models.importance(fitted["logreg"], prep.names, spark).first()["feature"] == "a"
    e = models.ensemble(list(fitted.values()), test)
    assert evaluate.classification_metrics(e, "label", "prediction").first()["accuracy"] > 0.8
    names = [f"v[{i}]" for i in range(len(prep.names))]
    from pyspark.ml.functions import vector_to_array
    for key in ("dt", "rf", "gb"):
        m = models.fit_model(key, train) if key != "gb" else models.estimator("gb", "classification").setMaxIter(5).fit(train)
        flat = m.transform(test).withColumn("v", vector_to_array("features")).withColumn("sql", F.expr(models.tree_sql(m, names))) if key != "rf" else None
        if flat is not None:
            assert flat.where("sql <> prediction").count() == 0
    a, b = models.calibrate("logreg", train, ["i"])
    assert a > 0 and math.isfinite(b)
    assert models.surrogate_rules(models.scored(fitted["logreg"], test), prep.names).count() > 3
    w = models.what_if(fitted["logreg"], df, prep, {"a": 3.0}).agg(F.avg(F.col("probs")[1]), F.avg(F.col("probs_before")[1])).first()
    assert w[0] > w[1]


def test_recourse_respects_directions(spark):
    rng = np.random.default_rng(12)
    df = frame(spark, i=range(200), tenure=rng.uniform(0, 10, 200), income=rng.uniform(20, 80, 200), debt=rng.uniform(0, 1, 200))

    def score(t):
        z = 0.4 * F.col("tenure") + 0.05 * F.col("income") - 5.0 * F.col("debt") - 1.0
        return t.withColumn("p", 1.0 / (1.0 + F.exp(-z)))

    low = score(df).where("p < 0.55").drop("p")
    cols = ["tenure", "income", "debt"]
    r = scenario.recourse(low, df, cols, "i", score, immutable=["tenure"], directions={"income": "increasing", "debt": "decreasing"})
    rows = r.collect()
    assert len(rows) == low.count() and all(x["tenure"] == x["_o_tenure"] and x["income"] >= x["_o_income"] - 1e-9 and x["debt"] <= x["_o_debt"] + 1e-9 for x in rows)
    assert sum(x["feasibility"] == "OPTIMAL_RECOURSE_FOUND" for x in rows) > 0.9 * len(rows)
    cf = scenario.counterfactuals(low, df, cols, "i", score, step=0.5, rounds=15)
    assert cf.count() == low.count() and cf.where("found").count() > 0.9 * low.count()


def test_stress_of_a_constant_model(spark):
    df = frame(spark, i=range(60), f1=np.random.default_rng(13).normal(size=60), f2=np.random.default_rng(14).normal(size=60))
    reps = scenario.stress_replicates(df, ["f1", "f2"], ["i"], lambda t: t.withColumn("p", F.lit(0.9)), replicates=5)
    rep = scenario.stress_report(reps, 0.4)
    d = scenario.risk_drivers(reps, rep, ["f1", "f2"]).collect()
    assert all(r["sensitivity"] == pytest.approx(0.6) for r in d) and rep.count() == 4


# ---- one behaviour at any size ----


@pytest.mark.parametrize("distinct", [900, 1500])
def test_causal_encoding_is_the_same_at_any_number_of_categories(spark, distinct):
    df = spark.range(distinct).select(F.format_string("c%05d", "id").alias("c")).unionAll(spark.createDataFrame([(None,), ("  n/a ",)], "c string"))
    codes = [r["c"] for r in causal.encode(df).orderBy("c").collect()]
    assert codes == [-1.0, -1.0] + [float(i) for i in range(distinct)]


def test_mmd_of_repeated_rows(spark):
    rows = spark.range(6000).select((F.col("id") % 10).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"))
    assert drift.mmd(rows, rows.where("a <> 3"), ["a", "b"]) < 0.2
    assert drift.mmd(rows, rows.withColumn("a", F.col("a") + 30), ["a", "b"]) > 0.45
    forest = drift.isolation_forest(rows, ["a", "b"], trees=5).toPandas()
    assert forest.groupby("tree")["size"].max().min() > 100 and forest.groupby("tree").size().min() > 10


def test_short_csv_rows_are_kept_and_long_ones_skipped(spark, tmp_path):
    (tmp_path / "s.csv").write_text("a,b,c\n1,2,3\n4,5\n6\n7,8,9,10\n7,8,9,10,11\n")
    df = readers.read_csv(spark, str(tmp_path / "s.csv"))
    assert sorted(map(tuple, df.collect()), key=str) == [(1, 2, 3), (4, 5, None), (6, None, None)]
    lines = [r["line"] for r in readers.malformed_rows(spark, str(tmp_path / "s.csv"), df.schema).collect()]
    assert sorted(lines) == ["7,8,9,10", "7,8,9,10,11"]


def test_value_counts_honours_the_limit(spark):
    assert query.value_counts(spark.range(80).select(F.col("id").cast("string").alias("v")), "v", 70).count() == 70


def test_laws_over_many_columns(spark):
    cols = [F.rand(i).alias(f"x{i}") for i in range(16)]
    df = spark.range(400).select(*cols).withColumn("y", F.col("x0") * 0.001 + F.col("x15") * 0.002)
    assert [sorted(law.coefficients) for law in laws.discover(df)] == [["x0", "x15", "y"]]


def test_name_rules():
    from tabloom.functions.names import number_repeats, snake

    assert [snake(n) for n in ["CustomerID", "sale price ($)", "  isHTTPServer", "_a__b_"]] == ["customer_id", "sale_price", "is_http_server", "a_b"]
    assert number_repeats(["a", "A", "b", "a"], str.lower) == ["a", "A_1", "b", "a_2"]


def test_zero_weights_are_rejected(spark):
    e = graph.edges(spark.createDataFrame([("a", "b", 0.0), ("b", "c", 1.0)], "u string, v string, w double"), "u", "v", "w")
    with pytest.raises(ValueError):
        graph.betweenness(e)


def test_rows_walk_isolation_trees_as_one_by_one():
    """Paths of whole blocks equal a walk of each row from node to node, gaps to the right, in far fewer array steps a tree."""
    rng = np.random.default_rng(8)
    m = rng.normal(size=(drift.WALK + 300, 3))
    m[::50, 1] = np.nan
    made = [drift._grow(rng.normal(size=(64, 3)), np.random.default_rng(s), 8) for s in range(5)] + [[(0, -1, -1, -1, 0.0, 1)]]
    trees = [drift._flat_tree(*(np.array(c) for c in list(zip(*t))[1:])) for t in made]
    expected = np.zeros(len(m))
    for t in made:
        for i, row in enumerate(m):
            at, depth = 0, 0
            while t[at][3] >= 0:
                at, depth = t[at][1] if row[t[at][3]] <= t[at][4] else t[at][2], depth + 1
            expected[i] += depth + drift._mean_path(t[at][5])
    assert (drift._path_lengths(m, trees) == expected).all()
