"""The pipeline's stages on a small table, each against a plain version of its decision."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline as C
from tabloom.llm.common import stored

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    extra = spark.createDataFrame([(90_000, None, "en", "src1", 0), (90_001, "12 34", None, None, None), (90_002, "", "en", "src1", 0)], docs.schema)
    out = [docs.unionAll(extra)]
    for name, stage in C.STAGES:
        out.append(stored(stage(spark, out[-1], FOLDER), name))
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))}


def test_columns(steps):
    for df in steps[:-1]:
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_language(steps):
    before, after = texts(steps[0]), texts(steps[1])
    assert set(before) - set(after) == {90_000, 90_001, 90_002}


def test_language_rejects_noise_and_keeps_clean_texts(spark):
    folder, rng = "/root/testdata/sf0.01", random.Random(5)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    alphabets = [[chr(c) for c in range(a, b)] for a, b in ((0x3B1, 0x3CA), (0x430, 0x450), (0x4E00, 0x5E00), (97, 123))]
    noise = ["".join(rng.choice(a) if rng.random() > 0.16 else " " for _ in range(n)) for a in alphabets for n in (20, 60, 120, 400, 3000) for _ in range(25)]
    # a null id is not learned from
    planted = spark.createDataFrame([(None, t, "en", f"noise{len(t)}", i) for i, t in enumerate(noise)], docs.schema)
    kept = C.identify_language(spark, docs.unionAll(planted), folder).select("doc_id", "source", F.length("text").alias("n")).collect()
    assert {r["doc_id"] for r in kept} - {None} == {r["doc_id"] for r in docs.collect()}
    left = [r["n"] for r in kept if r["doc_id"] is None]
    short = [n for n in left if n < C.SHORT_TEXT]
    # 100 planted texts are short, 400 are not
    assert len(left) - len(short) <= 8 and len(short) <= 15


def test_near_duplicates(steps):
    before, after = texts(steps[1]), texts(steps[2])
    sets = {d: shingles(t) for d, t in before.items()}
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    for d in set(before) - set(after):
        assert max(alike(d, o) for o in before if o != d) >= 0.72
    left = sorted(after)
    assert all(alike(a, b) < 0.88 for i, a in enumerate(left) for b in left[:i])


def test_leaks(spark, steps):
    fold = lambda t: " ".join("".join(c if c.isalnum() else " " for c in t.lower()).split())
    items = [fold(r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    before, after = texts(steps[2]), texts(steps[3])
    leaky = {d for d, t in before.items() if any(i in fold(t) for i in items)}
    assert leaky and leaky <= set(before) - set(after)
    assert len(set(before) - set(after) - leaky) <= 0.02 * len(before)


def test_mixture(steps):
    words = lambda df: sum(len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in texts(df).values())
    assert set(texts(steps[4])) <= set(texts(steps[3]))
    assert 0.7 * words(steps[3]) <= words(steps[4]) <= C.FRACTION * words(steps[3])


def test_token_files(steps):
    tokenizer, at, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, []
    for d, t in sorted(texts(steps[4]).items()):
        ids = tokenizer.encode(t, add_special_tokens=False).ids + [2]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, steps[5].collect())) == want


def test_registered_and_run(spark):
    assert entry.queries()["pipeline"] is C.run and "pipeline" not in entry.oracle_sql()
    assert C.run(spark, FOLDER).count() > 0
