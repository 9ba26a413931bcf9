"""The filter audit against counting document by document in every order."""

from collections import Counter
from itertools import permutations

import pytest

from tabloom.llm import filter_audit as A


def fails(text, doc_id, least):
    words = [w for w in text.replace("\t", " ").replace("\n", " ").split(" ") if w]
    return {x for x, f in {
        "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text),
        "D": any(c in "#$%&*|" for c in text), "E": doc_id is not None and least.get(text) is not None and doc_id > least[text]}.items() if f}


def plain(docs, labels):
    docs = [(d, t or "", g or "") for d, t, g in docs]
    least: dict = {}
    for d, t, _ in docs:
        if d is not None:
            least[t] = min(d, least.get(t, d))
    marked = [(g, fails(t, d, least), *[d is not None and any(x[0] == d and x[k] == 1 for x in labels) for k in (1, 2)]) for d, t, g in docs]
    out, shapley = {}, Counter()
    for part in {g for _, _, g in docs}:
        own = [m for m in marked if m[0] == part]
        for order in permutations("ABCDE"):
            left = own
            for step, x in enumerate(order, 1):
                gone = [m for m in left if x in m[1]]
                stay = [m for m in left if x not in m[1]]
                shapley[part, x] += len(gone)
                out[part, "".join(order), step] = [len(stay), len(gone), sum(x in m[1] for m in own) - len(gone), sum(m[1] == {x} for m in own), sum(m[2] for m in gone), sum(m[3] for m in gone)]
                left = stay
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_every_order(spark):
    """Nulls in any column, ties, repeated rows and ids, copies across parts, clashing columns, several labels per id."""
    long = " ".join(f"w{i}" for i in range(150))
    docs = [(5, long, "en"), (5, long, "en"), (7, long, "de"), (9, long, None), (None, long, "en"), (1, None, "en"), (2, "", "de"), (3, "A B C", "en"), (4, "a|b " * 120, None),
            (6, "same word " * 90, "en"), (8, "UPPER " * 120, "de"), (10, "\x00 # x", ""), (11, "ok " + long, "en"), (12, "ok " + long, "en"), (12, "ok " + long, "de"), (None, None, None)]
    labels = [(5, 1, 0), (7, 0, 1), (7, 1, None), (9, None, 1), (None, 1, 1), (12, 1, 1), (12, 1, 1), (99, 1, 1)]
    df = spark.createDataFrame([(*d, "clash", 1, 2) for d in docs], "doc_id int, text string, lang string, part string, good int, n int")
    got = A.filter_audit(df, spark.createDataFrame([(*x, "clash") for x in labels], "doc_id int, quality int, toxic int, part string"))
    assert {tuple(r)[:3]: tuple(r)[3:] for r in got.collect()} == plain(docs, labels)
    assert got.count() == 3 * 600


def test_empty_and_many_parts(spark, monkeypatch):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert A.filter_audit(none, labels).count() == 0
    # more rows than a recursive query may make by default, which is set back afterwards
    limit = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "500")
    try:
        many = spark.range(4).selectExpr("id AS doc_id", "'x' AS text", "concat('l', id) AS lang")
        assert A.filter_audit(many, labels).count() == 4 * 600
        assert spark.conf.get(limit) == "500"
    finally:
        spark.conf.set(limit, before)


@pytest.mark.parametrize("text", ["a" * 200_000, "word " * 50_000, " \t\n\x0b\x0c\r "])
def test_masks_of_long_and_blank_texts(spark, text):
    df = spark.createDataFrame([(text,)], "text string")
    got = df.select(A.text_mask(df["text"])).first()[0]
    assert {x for i, x in enumerate("ABCD") if got >> i & 1} == fails(text.replace("\x0b", " ").replace("\x0c", " ").replace("\r", " "), None, {})
