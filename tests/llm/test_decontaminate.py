"""Leaks against a plain approximate-substring alignment of every item with every text."""

import random

import numpy as np
import pytest

from tabloom.llm import decontaminate as D

DOCS, ITEMS = "doc_id long, text string, leaks string", "item_id long, text string, row int"


def folded(text):
    return " ".join("".join(c if c.isalnum() else " " for c in text.lower()).split())


def fewest_edits(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def brute(docs, items, q, percent):
    out = []
    for d, text, _ in docs:
        for i, item, _ in items:
            a = folded(item or "")
            if text and len(a) >= q:
                edits = fewest_edits(a, folded(text))
                if edits <= min(len(a) * percent // 100, (len(a) - q) // q):
                    out.append((d, i, edits))
    return sorted(out, key=str)


def sample():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgé") for _ in range(rng.randrange(1, 8)))
    items = [(i, " ".join(word() for _ in range(rng.choice([2, 6, 20, 45]))), 0) for i in range(12)]
    items += [(12, None, 0), (13, "", 0), (14, "short", 0), (15, items[3][1], 0)]
    docs = [(0, None, ""), (1, "", ""), (2, "?!", "")]
    for n in range(60):
        text = list(rng.choice(items[:12])[1])
        for _ in range(rng.choice([0, 0, 1, 3, 6, 12, 20])):
            p = rng.randrange(len(text))
            text[p:p + rng.randrange(2)] = rng.choice(["", "x", "yy", " "])
        around = [" ".join(word() for _ in range(rng.randrange(15))) for _ in range(2)]
        docs.append((10 + n, f"{around[0]}.  {''.join(text).upper()}\n{around[1]}" if n % 4 else " ".join(around), ""))
    return docs + [docs[4]], items


@pytest.mark.parametrize("q,percent", [(10, 8), (5, 12), (3, 0)])
def test_leaks_match_full_alignment(spark, q, percent):
    docs, items = sample()
    found = D.find_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), carry=["doc_id"], q=q, edit_percent=percent).collect()
    assert len(found) == len(docs)
    got = sorted(((r["row"]["doc_id"], x["item_id"], x["edits"]) for r in found for x in r["leaks"]), key=str)
    assert got == brute(docs, items, q, percent) and got


def test_blocks_and_slices_give_the_same(spark, monkeypatch):
    docs, items = sample()
    frames = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    pairs = lambda: sorted(str((r["row"]["doc_id"], x)) for r in D.find_leaks(*frames).collect() for x in r["leaks"])
    whole = pairs()
    monkeypatch.setattr(D, "BLOCK_CHARS", 300)
    assert pairs() == whole


def test_gram_hashes_follow_windows():
    x = np.array([1, 2, 3, 1, 2, 3, 1, 2, 9], np.int32)
    for q in range(1, 9):
        h, want = D.gram_hashes(x, q), [tuple(x[i:i + q]) for i in range(len(x) - q + 1)]
        assert [[a == b for b in want] for a in want] == [[a == b for b in h] for a in h]


def test_long_text_and_empty_tables(spark):
    item = "the quick brown fox jumps over the lazy dog " * 3
    docs = spark.createDataFrame([(1, "filler words " * 30_000 + item + " more" * 10, "")], DOCS)
    items = spark.createDataFrame([(7, item, 0)], ITEMS)
    assert [x["edits"] for x in D.find_leaks(docs, items).first()["leaks"]] == [0]
    assert D.find_leaks(docs, items.where("false")).first()["leaks"] == []
    assert D.find_leaks(docs.where("false"), items).count() == 0
