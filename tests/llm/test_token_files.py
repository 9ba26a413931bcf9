"""Token files: exact round trip against the tokenizer run on whole texts."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tabloom.llm import token_files as K

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, path string"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    return K.WordEncoder(PATH)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(".,AİÅéß̇̊ \t\n\x0b\x0c\r\x1c\x85  ́Σ'<|endoftext|>st")), max_size=40), max_size=4))
def test_encoding_by_words_is_encoding_of_whole_texts(tokenizer, encoder, texts):
    ids, n = encoder.encode(pa.array(texts, pa.string()))
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert list(n) == [len(w) for w in want] and list(ids) == [x for w in want for x in w]


def rows():
    out = [(7, "The cat's 12 mats", "x"), (3, None, None), (5, "", "y"), (9, "long word " * 30_000, "z"), (-2, "déjà vu \n\t Σ", ""), (None, "no id", "n"), (7, "The cat's 12 mats", "x"), (7, "other", "x")]
    return out + [(100 + i, f"document number {i} " * (i % 50), "p") for i in range(500)]


def want(rows, tokenizer):
    out, at = [], 0
    for d, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        out.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_round_trip(spark, tokenizer):
    data = rows()
    index = K.write_token_files(spark.createDataFrame(data, SCHEMA), PATH, 2, length=64, batch=8)
    got = sorted(map(tuple, K.read_token_files(index).collect()), key=lambda r: r[1])
    expected = want(data, tokenizer)
    assert [r[0] for r in got] == [r[0] for r in expected]
    unique = [i for i, r in enumerate(expected) if r[0] != 7]
    assert [got[i] for i in unique] == [expected[i] for i in unique]
    assert sorted((r[2], r[3]) for r in got) == sorted((r[2], r[3]) for r in expected)


def test_sequences_and_masks_are_views(spark, tokenizer):
    index = K.write_token_files(spark.createDataFrame([(1, "one two three four five six", "")], SCHEMA).coalesce(1), PATH, 2, length=4, batch=8)
    reader = K.ShardReader(index.first()["path"])
    ids = tokenizer.encode("one two three four five six").ids + [2]
    assert list(np.concatenate([reader.sequence(0), reader.sequence(1)]))[:7] == ids
    assert reader.mask(1).to_pylist() == [True, True, True, False]
    assert not reader.sequence(0).flags.owndata


def test_empty_table(spark):
    index = K.write_token_files(spark.createDataFrame([], SCHEMA), PATH, 2)
    assert K.read_token_files(index).count() == 0


def test_full_encoder_keeps_words_that_come_again(monkeypatch):
    monkeypatch.setattr(K, "REMEMBERED", 300)
    encoder, whole, asked = K.WordEncoder(PATH), Tokenizer.from_file(PATH), []
    real = encoder.tokenizer

    class Counting:
        def encode_batch_fast(self, words, **more):
            asked.extend(words)
            return real.encode_batch_fast(words, **more)

    encoder.tokenizer = Counting()
    common = [f"often{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(100)]
    for k in range(40):
        own = [f"once{chr(97 + i % 26)}{chr(97 + k % 26)}{chr(97 + i // 26)}{chr(97 + k // 26)}" for i in range(60 if k != 20 else 400)]
        text = " ".join(common + own)
        ids, n = encoder.encode(pa.array([text, None]))
        assert ids.tolist() == whole.encode(text, add_special_tokens=False).ids and n.tolist() == [len(ids), 0]
    # the common ones (and the empty one) are learned at first and twice around the text that alone is too large, not each time it is full
    assert len(asked) == 39 * 60 + 400 + 3 * 101
