"""Nulls in any column, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from oracle import compare, duck
from tabloom.llm import licences, mixing, quality, url_filter
from tabloom.llm.queries import QUERIES, SQL
from tabloom.plans.registry import TABLES

DOCUMENTS = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])
PAGES = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string())])
BENCHMARK = pa.schema([("item_id", pa.int64()), ("text", pa.string())])


def documents():
    rng = random.Random(2)
    word = lambda: rng.choice(["the", "of", "and", "naïve", "Ünder", "x#y", "$$$", "a|b", "tion", "zu"]) + str(rng.randrange(30))
    rows = [
        (1, None, "en", "s1", None), (2, "", "en", "s1", 0), (3, " \t\n\x0b\x0c\r ", None, None, 1), (None, "no id " * 60, "en", "s1", 1),
        (None, None, None, None, None), (4, "a b c a b c a b c " * 30, "en", "s1", 5), (5, "one line\n" * 80, "en", "s1", 5),
        (6, "Released under the MIT License.", "en", "s1", 5), (6, "Released under the MIT License.", "en", "s1", 5), (7, "x\nAll rights reserved.\ny", "de", "s1", 5),
        (10, "Licensed under the Apache License, Version 2.0.", "en", "s1", 1), (1000, "Licensed under CC BY-NC 4.0.", "en", "s2", 1), (100, "short", "en", "s2", 1),
        (11, "wörter " * 30_000, "de", "s2", 9), (12, "\x00nul\x00 in text", "en", "", 3), (13, "emoji 😀 " * 70, "", "s1", 4),
    ]
    for i in range(300):
        text = " ".join(word() + ("\n" if rng.random() < 0.1 else "") for _ in range(rng.choice([0, 3, 60, 200])))
        rows.append((20 + i, text, rng.choice(["en", "de", None]), rng.choice(["s1", "s1", "s2", None]), i))
    return rows + rows[-3:]


def pages():
    urls = [None, "", "not a url", "http://", "HTTP://User@A.Example.com.:80/x", "https://a.example.com", "https://b.a.example.com/y?z=http://q", "ftp://" + "l." * 200 + "x", "http://[::1]/"]
    rows = [(i, u, "<p>x</p>") for i, u in enumerate(urls)] + [(None, urls[5], None), (None, None, ""), (3, urls[6], "<p>y</p>"), (3, urls[6], "<p>y</p>")]
    return rows + [(100 + i, f"http://h{i % 9}.site{i % 4}.example.org/{i}", f"<p>{i}</p>") for i in range(120)]


@pytest.fixture(scope="module", params=["edges", "empty"])
def folder(request, tmp_path_factory):
    root = tmp_path_factory.mktemp(request.param)
    full = request.param == "edges"
    data = {"documents": (DOCUMENTS, documents()), "pages": (PAGES, pages()), "benchmark": (BENCHMARK, [(1, "the1 of2 and3 tion4 zu5 the6 of7"), (None, None), (2, "")])}
    for name in TABLES:
        if name in data:
            schema, rows = data[name]
            rows = rows if full else []
            table = pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)
        else:
            table = pq.read_table(f"/root/testdata/sf0.001/{name}.parquet")
        pq.write_table(table, root / f"{name}.parquet")
    return str(root)


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql_queries(spark, folder, name):
    assert compare(QUERIES[name](spark, folder), duck(folder), SQL[name]) is None


@pytest.mark.parametrize("name,table", [("op1_main_text", "pages"), ("op2_simhash", "documents"), ("op4_token_files", "documents"), ("op5_warc", "pages"), ("op8_language_id", "documents"), ("op12_lattice_score", "documents")])
def test_one_row_per_row(spark, folder, name, table):
    got = QUERIES[name](spark, folder)
    assert got.count() == spark.read.parquet(f"{folder}/{table}.parquet").count()


def test_decontamination_runs(spark, folder):
    QUERIES["op6_decontamination"](spark, folder).collect()


def test_pipeline_runs(spark, folder):
    import corpus_pipeline

    corpus_pipeline.run(spark, folder).collect()


# ---- the operators' own interfaces ----


def test_quality_counts(spark):
    rows = [(1, "a b c d a b c", "x"), (2, "a a a a", "x"), (3, "a b c", "x"), (4, "l\nl\n\nl \n l", "x"), (5, "#1 <b>|", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words string").withColumns({"lang": F.lit("en"), "source": F.lit("s")})
    got = {r["doc_id"]: tuple(r)[3:] for r in quality.base_measures(df).collect()}
    assert got == {1: (7, 7, 0, 0, 6), 2: (4, 4, 0, 0, 4), 3: (3, 3, 0, 0, 0), 4: (4, 4, 0, 1, 4), 5: (2, 6, 4, 0, 0)}


def test_sketches_merge(spark):
    values = spark.range(5000).select((F.col("id") % 3).alias("g"), *[(F.col("id") * F.col("id") % 9973).alias(m) for m in quality.MEASURES])
    parts = quality.sketches(values.where("g < 2"), ["g"]).unionAll(quality.sketches(values.where("g >= 2"), ["g"]))
    merged = quality.quantiles(parts, [], {"mid": 50}).where("measure = 'repeat_share'").first()
    exact = values.selectExpr("percentile(repeat_share, 0.5)").first()[0]
    assert abs(merged["mid"] - exact) <= exact / 16 and merged["n"] == 5000


def test_budgets_fill_siblings_before_ancestors(spark):
    rows = [("web", "en", "a", 10), ("web", "en", "b", 1000), ("web", "de", "c", 1000), ("books", "en", "d", 1000)]
    leaves = spark.createDataFrame(rows, "domain string, lang string, source string, tokens long")
    got = {r["source"]: r["budget"] for r in mixing.leaf_budgets(leaves, 800, {("web",): 3.0}, 1).collect()}
    assert got == {"a": 10, "b": 290, "c": 300, "d": 200}
    got = {r["source"]: r["budget"] for r in mixing.leaf_budgets(leaves, 10_000, {("web",): 3.0}, 1).collect()}
    assert got == {"a": 10, "b": 1000, "c": 1000, "d": 1000}
    with pytest.raises(ValueError):
        mixing.leaf_budgets(leaves, 1, {("web",): 0.0}, 1)


@pytest.mark.parametrize("per_range", [3, 5000])
def test_prefixes_do_not_depend_on_ranges(spark, monkeypatch, per_range):
    monkeypatch.setattr(mixing, "ROWS_PER_RANGE", per_range)
    rows = [(i, "en", f"s{i % 2}", 1 + i % 5, "clash") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, source string, n long, epoch string")
    got = mixing.mix(df, F.col("n"), F.lit("web"), {}, 1.3, 2, 5).select("row.doc_id", "source", "epoch", "row.n").collect()
    for s in ("s0", "s1"):
        mine = [r for r in got if r["source"] == s]
        total = sum(r[3] for r in rows if r[2] == s)
        assert sum(r["epoch"] == 0 for r in mine) == 100
        partial = {r["doc_id"] for r in mine if r["epoch"] == 1}
        order = sorted((r[0] for r in rows if r[2] == s), key=lambda d: __import__("hashlib").md5(f"5|1|{d}".encode()).hexdigest())
        assert partial == set(order[:len(partial)])
        assert sum(r["n"] for r in mine) <= 1.3 * total + 5


def test_intervals_and_verdicts(spark):
    entries = spark.createDataFrame([("l", "A.com", "2024-01-05", "add"), ("l", "a.com", "2024-01-05", "add"), ("l", "a.com", "2024-01-09", "remove"), ("l", "a.com", "2024-01-20", "add"),
                                     ("l", "b.com", "2024-01-01", "remove"), ("l", None, "2024-01-01", "add"), ("k", "x.a.com", "2024-01-06", "add"), ("l", "c.com", "2024-01-01", "?")],
                                    "list string, pattern string, day string, action string").withColumns({"day": F.to_date("day"), "pattern": F.lower("pattern")})
    seen = [("http://x.a.com/", d) for d in ("2024-01-04", "2024-01-05", "2024-01-08", "2024-01-09", "2024-01-21")] + [("http://ba.com/", "2024-01-06"), ("http://b.com", "2024-01-06"), (None, "2024-01-06"), ("http://a.com", None)]
    captures = spark.createDataFrame([(u, d, "clash") for u, d in seen], "url string, day string, host string")
    got = [(r["row"]["url"], str(r["row"]["day"]), r["n_active"], r["lists"], r["pattern"]) for r in url_filter.judge(captures, entries, F.col("url"), F.to_date("day")).collect()]
    want = {("http://x.a.com/", "2024-01-05"): (1, "l", "a.com"), ("http://x.a.com/", "2024-01-08"): (2, "k,l", "x.a.com"), ("http://x.a.com/", "2024-01-09"): (1, "k", "x.a.com"), ("http://x.a.com/", "2024-01-21"): (2, "k,l", "x.a.com")}
    assert sorted(got, key=str) == sorted([(u, str(d), *want.get((u, d), (0, None, None))) for u, d in seen], key=str)


def test_nearest_licence_file(spark):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    rows = [("LICENSE", mit, 1), ("a/b/COPYING", apache, 2), ("a/b/c/x.txt", "nothing here", 3), ("a/y.txt", None, 4), ("a/b/z.txt", "x\n" + mit + "\nz", 5), ("a/b/LICENSE.md", "no words", 6), (None, mit, 7), ("a/y.txt", None, 4)]
    df = spark.createDataFrame(rows, "path string, text string, licence int")
    templates = spark.createDataFrame([(i, *t) for i, t in enumerate(licences.TEMPLATES)], "t int, licence string, text string")
    got = licences.scan(df, templates, F.col("path"), F.col("text")).collect()
    got = sorted(((r["row"]["licence"], r["own"], r["licence"], r["inherited_from"]) for r in got if r["path"]), key=lambda r: r[0])
    assert [g[1:] for g in got] == [("MIT", "MIT", None), ("Apache-2.0", "Apache-2.0", None), (None, "Apache-2.0", "a/b"), (None, "MIT", ""), (None, "MIT", ""), ("MIT", "MIT", None), (None, "Apache-2.0", "a/b")]
