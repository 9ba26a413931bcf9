"""Lattice likelihood against enumerated segmentations and plain counts."""

import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from tabloom.llm import lattice as L
from tabloom.llm.queries import PIECES, QUERIES

TEXTS = ["The cat sat on the mat. THE cat!", "naïve Übermut  \t the cat", None, "", " \n ", "日本語のテキスト the", "\x00\x01 nul", "x" * 200 + " cat", "x" * 200 + " dog", "the the the mat"]


@pytest.fixture(scope="module")
def pieces():
    return L.vocabulary(public_tokenizers.path(PIECES))


def segmentations(word, known):
    """Probability of a word as a plain sum over all ways to cut it, by the first piece."""
    sums = [0.0] * len(word) + [1.0]
    for i in range(len(word) - 1, -1, -1):
        sums[i] = sum(known[word[i:j]] * sums[j] for j in range(i + 1, len(word) + 1) if word[i:j] in known)
    return sums[0]


def all_cuts(word, known):
    return [[word]] * (word in known) + [[word[:i], *rest] for i in range(1, len(word)) if word[:i] in known for rest in all_cuts(word[i:], known)]


def test_vocabulary_is_a_distribution(pieces):
    assert abs(math.fsum(map(math.exp, pieces.logs)) + math.exp(pieces.end) - 1) < 1e-9
    assert len(set(pieces.names)) == len(pieces.names) and {bytes([b]) for b in range(256)} <= set(pieces.names)


def test_forward_recursion(pieces):
    known, lattices = dict(zip(pieces.names, np.exp(pieces.logs))), L.Lattices(pieces)
    words = [L.MARK + w.encode() for w in ["the", "heheon", "", "naïve", "日本語", "aaaaaaaaaaaaaaaa", "\x00"]]
    got = np.exp(lattices.log_probability(words))
    assert np.allclose(got, [segmentations(w, known) for w in words], rtol=1e-9)
    assert np.isclose(got[0], sum(math.prod(known[p] for p in cut) for cut in all_cuts(words[0], known)), rtol=1e-9)
    long = L.MARK + b"abc" * 3000
    assert np.isclose(lattices.log_probability([long])[0], _log_sum(long, dict(zip(pieces.names, pieces.logs))), rtol=1e-9)


def _log_sum(word, logs):
    sums = [0.0] + [-math.inf] * len(word)
    for j in range(1, len(word) + 1):
        sums[j] = np.logaddexp.reduce([sums[i] + logs[word[i:j]] for i in range(max(0, j - 30), j) if word[i:j] in logs])
    return sums[-1]


def test_expected_counts(pieces):
    known, lattices = dict(zip(pieces.names, np.exp(pieces.logs))), L.Lattices(pieces)
    words, times = [L.MARK + b"the", L.MARK + b"on", L.MARK + b"thenon"], [3.0, 1.0, 2.0]
    want: Counter = Counter()
    for w, n in zip(words, times):
        cuts = [(cut, math.prod(known[p] for p in cut)) for cut in all_cuts(w, known)]
        for cut, x in cuts:
            for p in cut:
                want[p] += n * x / sum(y for _, y in cuts)
    got = {p: c for p, c in zip(pieces.names, lattices.expected(words, times)) if c}
    assert set(got) == set(want) and all(math.isclose(got[p], want[p], rel_tol=1e-9) for p in want)


def plain(texts, training, pieces, rounds=L.ROUNDS):
    """Scores by dictionaries: counts, rounds of expected counts, and the sum over pieces and whole words."""
    words = lambda t: (t or "").encode().lower().split()
    counts = Counter(w for t in training for w in words(t)) + Counter({None: len(training)})
    n, v, known, end = sum(counts.values()), len(counts), dict(zip(pieces.names, np.exp(pieces.logs))), math.exp(pieces.end)
    start, start_end = dict(known), end
    for _ in range(rounds):
        lattices = L.Lattices(L.Pieces(pieces.names, [math.log(known[p]) for p in pieces.names], math.log(end)))
        own = [w for w in counts if w is not None]
        got = lattices.expected([L.MARK + w for w in own], [counts[w] for w in own])
        whole = got.sum() + counts[None] + L.PRIOR_TOKENS
        known = {p: (c + L.PRIOR_TOKENS * start[p]) / whole for p, c in zip(pieces.names, got)}
        end = (counts[None] + L.PRIOR_TOKENS * start_end) / whole
    new = (sum(c == 1 for c in counts.values()) + 1) / (n + 2) if n else 1.0
    out = []
    for t in texts:
        base = points = 0.0
        tokens = [*words(t), None]
        for w in tokens:
            base += math.log10((counts[w] + 1) / (n + v + 1))
            own = math.log(end) if w is None else _log_sum(L.MARK + w, {p: math.log(x) for p, x in known.items()}) if len(w) > 60 else math.log(segmentations(L.MARK + w, known))
            points += np.logaddexp(math.log(new) + own, math.log((1 - new) * counts[w] / n) if counts[w] else -math.inf) / math.log(10)
        out.append((len(tokens), sum(counts[w] > 0 for w in tokens), n, base, points))
    return out


@pytest.mark.parametrize("head", [1 << 17, 3])
def test_scores(spark, monkeypatch, pieces, head):
    """Nulls, blanks, long words and repeated rows; with all counts at hand and with most of them joined."""
    monkeypatch.setattr(L, "HEAD_WORDS", head)
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], "clash")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, score string")
    counts = docs.where("doc_id % 2 = 0").select("text").transform(L.word_counts).cache()
    found = L.score(docs, counts, L.fit(counts, pieces))
    got = sorted((r["row"]["doc_id"], *[r[c] for c in ("n_tokens", "n_known", "train_tokens", "base_score", "score")]) for r in found.collect())
    want = sorted((r[0], *x) for r, x in zip(rows, plain([r[1] for r in rows], [r[1] for r in rows if r[0] % 2 == 0], pieces)))
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert np.allclose([g[4:] for g in got], [w[4:] for w in want], rtol=1e-9)


def test_without_training(spark, pieces):
    docs = spark.createDataFrame([(1, "the cat"), (None, None)], "doc_id int, text string")
    counts = L.word_counts(docs.where("doc_id > 5").select("text")).cache()
    got = {r["row"]["doc_id"]: r for r in L.score(docs, counts, L.fit(counts, pieces)).collect()}
    assert math.isclose(got[None]["score"], pieces.end / math.log(10)) and got[1]["n_known"] == 0 and got[1]["train_tokens"] == 0 and got[1]["base_score"] == 0
    assert L.score(docs.where("doc_id > 5"), counts, pieces).count() == 0


def test_query_on_the_given_documents(spark, pieces):
    sf = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    fold = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    got = {r["doc_id"]: r for r in QUERIES["op12_lattice_score"](spark, sf).collect()}
    few = [d for d in docs if d[0] % 20 == 0]
    want = plain([t for _, t in few], [t for d, t in docs if not fold(d)], pieces)
    assert len(got) == len(docs)
    for (d, _), x in zip(few, want):
        assert got[d]["held_out"] == fold(d) and tuple(got[d])[2:5] == x[:3] and np.allclose(tuple(got[d])[5:], x[3:], rtol=1e-9)
