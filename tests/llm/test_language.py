"""Hyperdimensional profiles against a letter-by-letter version, and held-out accuracy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.llm import language as L
from tabloom.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, row string"


def letter(c, dimensions):
    bits = np.random.default_rng([L.SEED, ord(c) if c.isalpha() else 0]).integers(0, 2, dimensions, dtype=np.int8)
    return 2 * bits.astype(int) - 1


def bundle(text, dimensions):
    padded, out = f" {text.lower()} ", np.zeros(dimensions)
    for a, b, c in zip(padded, padded[1:], padded[2:]):
        if b.isalpha():
            out += np.roll(letter(a, dimensions), 2) * np.roll(letter(b, dimensions), 1) * letter(c, dimensions)
    return out


@pytest.mark.parametrize("cells", [L.CELLS, 3000])
def test_bundles_equal_trigram_sums(cells, monkeypatch):
    monkeypatch.setattr(L, "CELLS", cells)
    texts = ["Hello, world", "", "x", "12 !?", "日本語 のテキスト", "İstanbul ΣΑΣ", "\x00null\x00", "a" * 500] + ["the cat " * i for i in range(20)]
    got = L.Bundler(64).vectors([t.lower() for t in texts])
    assert np.array_equal(got, np.array([bundle(t, 64) for t in texts]))


def test_prediction(spark):
    rows = [(i, t, g, "clash") for i, (t, g) in enumerate([("the cat and the dog", "en"), ("und der hund ist", "de"), (None, "en"), ("", "de"), ("12 34", "en"), ("the dog", None), ("the dog", None), ("und " * 40_000, "de")])]
    df = spark.createDataFrame(rows, SCHEMA)
    profiles = L.learn(df)
    assert profiles.languages == ("de", "en")
    got = {r["row"]["doc_id"]: (r["lang_pred"], r["score"], r["row"]["row"]) for r in L.predict(df, profiles).collect()}
    assert len(got) == len(rows)
    assert [got[i][0] for i in range(8)] == ["en", "de", "und", "und", "und", "en", "en", "de"]
    assert all(0 <= s <= 1 for _, s, _ in got.values()) and got[2][1] == 0 and got[5][1] == got[6][1]
    unit = [bundle(t, L.DIMENSIONS) for t in ("the cat and the dog", "the dog")]
    assert abs(got[5][1] - unit[0] @ unit[1] / np.linalg.norm(unit[0]) / np.linalg.norm(unit[1])) < 1e-6


def test_nothing_learned(spark):
    df = spark.createDataFrame([(1, "text", None, "")], SCHEMA)
    assert L.predict(df, L.learn(df)).select("lang_pred", "score").first() == ("und", 0.0)
    empty = df.where("false")
    assert L.predict(empty, L.learn(empty)).count() == 0


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    joined = QUERIES["op8_language_id"](spark, folder).join(docs, "doc_id").where("held_out")
    right, n = joined.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 100 and right / n > 0.98
