"""Language identification with hyperdimensional profiles of letter trigrams.

Each letter has a random vector of +1 and -1. A trigram's vector binds its letters' vectors, permuted by position
(rotated by two, one and no places and multiplied); anything that isn't a letter counts as the border of a word. A
text's vector bundles (adds) the vectors of all its trigrams around a letter, and a language's prototype bundles the
unit vectors of its texts. A text gets the language whose prototype has the largest cosine with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import arrow_slices, released, stored

DIMENSIONS = 1024
SEED = 20_240_501
UNKNOWN = "und"
#: At most about this many texts of a language are learned from, drawn by a hash of text and language.
TRAIN_PER_LANGUAGE = 4_000
#: Characters bundled at once, and cells of the count matrix at most.
SLICE_CHARS, CELLS = 1 << 20, 1 << 21
#: Unit vectors are added up as integers of this scale, so that no order of summation shows.
SCALE = 1 << 24


class Bundler:
    """Turns texts into bundled trigram vectors; the letters seen so far keep their numbers."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED):
        import numpy as np

        self.np, self.dimensions, self.seed = np, dimensions, seed
        self.number = np.full(0x110000, -1, np.int32)
        self.letters = self._vector(0)[None]

    def _vector(self, code: int):
        bits = self.np.random.default_rng([self.seed, code]).integers(0, 2, self.dimensions, dtype=self.np.int8)
        return 2 * bits - 1

    def _numbers(self, codes):
        """Letter numbers of code points, 0 for anything that isn't a letter."""
        np, out = self.np, self.number[codes]
        if (out < 0).any():
            new = [c for c in np.unique(codes[out < 0]).tolist()]
            self.number[[c for c in new if not chr(c).isalpha()]] = 0
            for c in (c for c in new if chr(c).isalpha()):
                self.number[c] = len(self.letters)
                self.letters = np.concatenate([self.letters, self._vector(c)[None]])
            out = self.number[codes]
        return out

    def vectors(self, texts: list[str]):
        """The bundled vector of each text (exact integers as float32; zero for a text without letters)."""
        np = self.np
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        x = self._numbers(np.frombuffer((" ".join(["", *texts, ""])).encode("utf-32-le"), np.uint32))
        out = np.zeros((len(texts), self.dimensions), np.float32)
        at = np.flatnonzero(x)
        if not len(at):
            return out
        doc = np.repeat(np.arange(len(texts)), lengths)[at - 1]
        k = len(self.letters)
        code = (x[at - 1].astype(np.int64) * k + x[at]) * k + x[at + 1]
        if k ** 3 <= CELLS:
            seen = np.flatnonzero(np.bincount(code, minlength=k ** 3))
            rank = np.zeros(k ** 3, np.int64)
            rank[seen] = np.arange(len(seen))
            code = rank[code]
        else:
            seen, code = np.unique(code, return_inverse=True)
        for a in range(0, len(seen), CELLS // self.dimensions):
            some = seen[a:a + CELLS // self.dimensions]
            bound = (np.roll(self.letters, 2, axis=1)[some // (k * k)] * np.roll(self.letters, 1, axis=1)[some // k % k] * self.letters[some % k]).astype(np.float32)
            mine = (code >= a) & (code < a + len(some)) if len(some) < len(seen) else slice(None)
            d, c = doc[mine], code[mine] - a
            step = max(1, CELLS // len(some))
            for b in range(0, len(texts), step):
                rows = slice(*np.searchsorted(d, [b, b + step]))
                n = min(step, len(texts) - b)
                counts = np.bincount((d[rows] - b) * len(some) + c[rows], minlength=n * len(some)).reshape(n, len(some))
                out[b:b + n] += counts.astype(np.float32) @ bound
        return out


def _units(vectors):
    import numpy as np

    v = vectors.astype(np.float64)
    size = np.sqrt((v * v).sum(1, keepdims=True))
    return np.divide(v, size, out=np.zeros_like(v), where=size > 0)


@dataclass(frozen=True)
class Profiles:
    """Learned languages in order, and the integer prototype of each."""

    languages: tuple[str, ...]
    prototypes: tuple[tuple[int, ...], ...]
    dimensions: int
    seed: int


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", per_language: int = TRAIN_PER_LANGUAGE,
          dimensions: int = DIMENSIONS, seed: int = SEED) -> Profiles:
    """Prototypes from the rows with a text and a language.

    ``per_language`` bounds the expected number of texts of a language: larger languages are thinned by a hash of the
    text. Tasks add their texts up, so a row per task and language is shuffled; the result is a vector per language.
    """
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    # a stored table has a known size: small ones are broadcast, larger ones joined by splittable shuffles
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n")).select(F.col("lang").alias("l"), F.least(F.lit(1.0), per_language / F.col("n")).alias("share"))
    sizes = stored(sizes, "language-sizes")
    drawn = F.pmod(F.xxhash64("text", F.lit(seed)), F.lit(1 << 30)) < F.col("share") * (1 << 30)
    rows = rows.join(sizes, F.col("lang") == F.col("l")).where(drawn).select("lang", "text")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        bundler, sums = Bundler(dimensions, seed), {}
        for b in batches:
            for i, j in arrow_slices(b.column(1), SLICE_CHARS):
                langs, texts = (b.column(c).slice(i, j - i).to_pylist() for c in (0, 1))
                whole = np.rint(_units(bundler.vectors([t.lower() for t in texts])) * SCALE).astype(np.int64)
                for g in set(langs):
                    sums[g] = sums.get(g, 0) + whole[[x == g for x in langs]].sum(0)
        if sums:
            yield pa.record_batch([pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))], names=["lang", "v"])

    parts = rows.mapInArrow(released(run), "lang string, v array<bigint>")
    total = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    vectors = total.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v")).orderBy("lang").collect()
    learned = [(r["lang"], tuple(e["x"] for e in r["v"])) for r in vectors]
    learned = [(g, v) for g, v in learned if any(v)]
    return Profiles(tuple(g for g, _ in learned), tuple(v for _, v in learned), dimensions, seed)


def predict(docs: DataFrame, profiles: Profiles, text_col: str = "text") -> DataFrame:
    """``(row, lang_pred, score)`` per row, ``row`` being all its columns.

    ``score`` is the cosine, not below 0. Texts that are null or have no letter, and all texts if nothing was learned,
    get ``und`` and 0. Of languages with the same cosine the first in order wins.
    """
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        bundler = Bundler(profiles.dimensions, profiles.seed)
        prototypes = _units(np.array(profiles.prototypes).reshape(len(profiles.languages), profiles.dimensions))
        names = np.array([*profiles.languages, UNKNOWN], dtype=object)
        for b in batches:
            column = b.column(0).field(text_col)
            for i, j in arrow_slices(column, SLICE_CHARS):
                texts = [(t or "").lower() for t in column.slice(i, j - i).to_pylist()]
                units = _units(bundler.vectors(texts))
                blank = ~units.any(1)
                cosines = np.concatenate([units @ prototypes.T, np.full((j - i, 1), -2.0)], axis=1)
                best = np.where(blank, len(names) - 1, cosines.argmax(1))
                score = np.where(best == len(names) - 1, 0.0, np.clip(cosines.max(1), 0.0, 1.0))
                yield pa.record_batch([b.column(0).slice(i, j - i), pa.array(names[best], pa.string()), pa.array(score, pa.float64())], names=["row", "lang_pred", "score"])

    rows = docs.select(F.struct("*").alias("row"))
    row_type = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(released(run), f"row {row_type}, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    """True for the fold that nothing is learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
