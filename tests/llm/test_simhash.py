"""Fingerprints and their components against a pairwise brute force."""

import random

import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.llm import simhash as S

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("fp", T.StringType())])


def brute_fp(text, size):
    words = [w.lower() if w.isascii() else "".join(c.lower() if c.isascii() else c for c in w) for w in (text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows, size=4, bits=4):
    fps = [brute_fp(t, size) for _, t in rows]
    comp = list(range(len(rows)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                comp[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = root(i)
        least[r] = d if least.get(r) is None else least[r] if d is None else min(d, least[r])
    return sorted(((d, f"{f:016x}", least[root(i)]) for i, ((d, _), f) in enumerate(zip(rows, fps))), key=str)


def sample():
    rng = random.Random(3)
    words = ["The", "cat", "Éa", "dog", "sat", "ÇA", "on", "x" * 9, "mat", "ran", "und", "le"]
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (4, "one"), (None, "one two"), (5, "One  TWO"), (6, "é " * 20_000)]
    base = [rng.choice(words) + str(rng.randrange(60)) for _ in range(400)]
    for i in range(60):
        copy = list(base) if i % 3 else [rng.choice(words) + str(rng.randrange(60)) for _ in range(rng.randrange(1, 300))]
        for _ in range(rng.randrange(3)):
            copy[rng.randrange(len(copy))] = "zz"
        rows.append((100 - i, " ".join(copy)))
    return rows


def test_components_match_pairwise_links(spark):
    rows = sample()
    df = spark.createDataFrame([(d, t, "extra") for d, t in rows], SCHEMA)
    got = S.near_duplicates(df)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


@pytest.mark.parametrize("bits", [0, 2, 6])
def test_links_are_all_close_pairs(spark, bits):
    rng = random.Random(bits)
    seeds = [rng.getrandbits(64) for _ in range(6)]
    fps = {s ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))) for s in seeds for _ in range(15)}
    fps = sorted(S._signed(f) for f in fps)
    want = {(a, b) for a in fps for b in fps if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= bits}
    got = [tuple(r) for r in S.fingerprint_links(spark.createDataFrame([(f,) for f in fps], "fp long"), bits).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_empty_table(spark):
    assert S.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def similar_sample():
    rng = random.Random(11)
    new = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    rows, group = [], {}
    for g in range(12):
        base = new(rng.choice([8, 150, 400, 2000]))
        for c in range(rng.choice([1, 2, 5])):
            copy = list(base)
            if c and len(base) > 100:
                for _ in range(max(1, len(base) // 150)):
                    copy[rng.randrange(len(copy))] = "changed"
            group[100 * g + c] = g
            rows.append((100 * g + c, ("  " if c % 2 else " ").join(copy), "a"))
    blank = [(5000, None, "a"), (5001, "", "b"), (5002, " \n", "c")]
    same = [(6000, "twice the same row", "a")] * 2 + [(None, "no id at all", "a")] * 2 + [(6001, "one id", "a"), (6001, "two texts here", "a"), (None, "twice the same row", "x")]
    return rows + blank + same, group


def test_keep_one_of_similar_texts(spark):
    rows, group = similar_sample()
    df = spark.createDataFrame(rows, "doc_id long, text string, same string").withColumnRenamed("same", "group")
    got = S.keep_one(df)
    assert got.columns == df.columns
    first = {}
    for d, g in group.items():
        first[g] = min(d, first.get(g, d))
    text = {r[0]: r[1] for r in rows}
    want = [(d, text[d]) for d in first.values()] + [(5000, None), (6000, "twice the same row"), (None, "no id at all"), (6001, "one id"), (6001, "two texts here")]
    assert sorted((tuple(r)[:2] for r in got.collect()), key=str) == sorted(want, key=str)
    assert S.keep_one(df.where("false")).count() == 0


def test_sketch_estimates_similarity():
    import numpy as np

    rng = np.random.default_rng(1)
    turns = S._permutations()
    pool = rng.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2)
    for shared in (0, 500, 1600, 2000):
        a, b = pool[:2000], pool[2000 - shared:4000 - shared][:2000]
        equal = sum(x == y for x, y in zip(S.sketch(a, turns), S.sketch(b, turns))) / S.SKETCH
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs(equal - true) < 0.1


def family(n, planted, rng, length=200, common=165):
    """``n`` texts that share a passage (pairwise about 0.7), and a copy of each of the first ``planted`` at 0.9."""
    passage = [f"c{i}" for i in range(common)]
    texts = [passage + [f"u{rng.randrange(10 ** 9)}" for _ in range(length - common)] for _ in range(n)]
    for t in texts[:planted]:
        texts.append(t[:-9] + [f"v{rng.randrange(10 ** 9)}" for _ in range(9)])
    return [" ".join(t) for t in texts]


def jaccard(a, b, size=5):
    one, other = ({tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} for w in (a.split(), b.split()))
    return len(one & other) / len(one | other)


def test_copies_inside_a_family_are_found(spark):
    texts = family(2000, 200, random.Random(7))
    assert 0.65 < jaccard(texts[500], texts[501]) < 0.75 and all(jaccard(texts[i], texts[2000 + i]) > 0.89 for i in range(200))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in S.keep_one(df).collect()) == list(range(2000))


def test_similarity_is_decided_exactly(spark):
    rng, rows, want = random.Random(3), [], []
    for g in range(150):
        # one run of changed words at the end: 90 of n shingles stay on both sides
        n, kept = (100, 90) if g % 3 else (96 + 5, 90)
        base = [f"g{g}w{i}" for i in range(kept + 4)]
        pair = [" ".join(base + [f"{rng.random()}" for _ in range(n - kept)]) for _ in range(2)]
        if g % 3 == 2:
            pair = [" ".join(base), " ".join(base + [f"{rng.random()}" for _ in range(22)])]
            if g % 2:
                pair = [" ".join(base[:84]), " ".join(base + ["x", "y", "z", "u", "v", "w"])]
        rows += [(2 * g, pair[0]), (2 * g + 1, pair[1])]
        want += [2 * g] if jaccard(*pair) >= 0.8 else [2 * g, 2 * g + 1]
    exact = "".join(f"e{i} " for i in range(84)), "".join(f"e{i} " for i in range(104))
    assert jaccard(*exact) == 0.8
    rows += [(1000, exact[0]), (1001, exact[1])]
    got = S.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(want + [1000])


def test_similar_texts_meet_by_their_fingerprints(spark):
    """Without any sampled byte, texts with linked fingerprints are still on one list, and exact similarity decides."""
    rng = random.Random(5)
    rows = []
    for g in range(20):
        base = [f"w{rng.randrange(10 ** 6)}" for _ in range(600)]
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(base[:-1] + ["last"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    near = {(a, a + 1) for a in range(0, 40, 2) if (brute_fp(rows[a][1], 5) ^ brute_fp(rows[a + 1][1], 5)).bit_count() <= 4}
    assert len(near) > 10
    classes = S.text_marks(df, "doc_id", "text", 5).withColumn("any_id", F.col("doc_id")).withColumn("keys", F.expr("array()").cast("array<bigint>"))
    met = S._lists_of_several(classes, 4).join(classes.select("same", "doc_id"), "same").groupBy("band", "key").agg(F.sort_array(F.collect_set("doc_id")).alias("ids"))
    assert near == {tuple(r["ids"]) for r in met.collect()}
