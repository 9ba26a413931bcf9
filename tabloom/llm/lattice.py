"""Likelihood of texts under a subword unigram model that sums over all segmentations.

A text is its words, each led by the vocabulary's word mark, and one end piece. Its probability is the product of the
probabilities of its pieces, summed over every way to cut the words into pieces; no piece crosses words, so the sum is
the product of the words' sums, each a forward recursion in log space over the word's lattice. The pieces are those of
an existing vocabulary. Its stored scores are ranks, read as Zipf's law; they weight the first segmentations and stay
as a prior. Two rounds of expected piece counts over the distinct words of the training texts then fit the probabilities.

Pieces alone tell less of a text than the plain frequency of its words. So a word that occurs in training is one more
edge of its own lattice, from its start to its end, by its frequency; all piece edges together keep the share of words
that a new text would bring, by the words seen once (Good and Turing).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import arrow_slices, stored
from tabloom.llm.quality import bin_floor

MARK = "▁".encode()
#: Rounds of expected counts, and how many tokens the vocabulary's own scores count for in each.
ROUNDS, PRIOR_TOKENS = 2, 10_000.0
#: Counts of the commonest words, so many at most, travel to every task; all other words meet their counts in a join.
HEAD_WORDS = 131_072
#: A longer word is known by its hash, so that keys stay short.
LONGEST_KEY = 64
#: Bytes of text that a task splits at once, and cells of a lattice that it fills at once.
SLICE, CELLS = 4 << 20, 1 << 15
#: Words whose probability a worker remembers.
REMEMBERED = 1 << 18
#: Key of the end of a text among the words; no word is empty.
END_KEY = b""


@dataclass(frozen=True)
class Pieces:
    """A vocabulary: the bytes of each piece, its log probability, and the log probability of the end."""

    names: list[bytes]
    logs: list[float]
    end: float


def vocabulary(path: str) -> Pieces:
    """Pieces of a SentencePiece file with Zipf's law over the ranks that it stores as scores.

    Byte pieces stand for single bytes, so every text has a probability; they and the end share the last rank. Left out
    are control pieces, pieces that the file bars, and those with a word mark after their start.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n, rank = model.get_piece_size(), {}
    for i in range(n):
        name = model.id_to_piece(i)
        if model.is_byte(i):
            rank[bytes([int(name[3:5], 16)])] = n
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) and "▁" not in name[1:] and model.get_score(i) > -1e8:
            # a character that is also a byte piece keeps its own rank
            rank[name.encode()] = min(rank.get(name.encode(), n), 1 - model.get_score(i))
    for b in range(256):
        rank.setdefault(bytes([b]), n)
    total = math.log(sum(1 / r for r in rank.values()) + 1 / n)
    return Pieces(list(rank), [-math.log(r) - total for r in rank.values()], -math.log(n) - total)


class Lattices:
    """Forward and backward recursions over the lattices of many words at once."""

    BASE, SPREAD = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03

    def __init__(self, pieces: Pieces):
        import numpy as np

        self.longest = max(map(len, pieces.names))
        self.logs = np.array(pieces.logs)
        keys = np.array([self._hash(p) for p in pieces.names], np.uint64)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[self.keys >> np.uint64(42)] = True

    def _hash(self, piece: bytes) -> int:
        h = 0
        for b in piece:
            h = (h * self.BASE + b + 1) & (2**64 - 1)
        return ((h ^ len(piece)) * self.SPREAD) & (2**64 - 1)

    def edges(self, grid):
        """``(k, row, start, piece)`` arrays for each length k of pieces that occur in the rows of bytes."""
        import numpy as np

        run = np.zeros(grid.shape, np.uint64)
        for k in range(1, min(self.longest, grid.shape[1]) + 1):
            run = run[:, :grid.shape[1] - k + 1] * np.uint64(self.BASE) + grid[:, k - 1:] + np.uint64(1)
            h = (run ^ np.uint64(k)) * np.uint64(self.SPREAD)
            row, start = np.nonzero(self.maybe[h >> np.uint64(42)])
            h = h[row, start]
            at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            hit = self.keys[at] == h
            yield k, row[hit], start[hit], self.order[at[hit]]

    @staticmethod
    def blocks(words: list[bytes]) -> Iterator[tuple]:
        """Indices of words of similar length with a grid of their bytes, padded to the longest."""
        import numpy as np

        sizes = np.array([len(w) for w in words])
        order, at = np.argsort(sizes, kind="stable"), 0
        while at < len(order):
            # as many as fit when padded to the longest of them
            stop = min(len(order), at + max(1, CELLS // max(int(sizes[order[at]]), 1)))
            while stop > at + 1 and int(sizes[order[stop - 1]]) * (stop - at) > 2 * CELLS:
                stop = at + max(1, (stop - at) // 2)
            own = order[at:stop]
            width = int(sizes[own[-1]])
            grid = np.frombuffer(b"".join(words[i].ljust(width, b"\0") for i in own), np.uint8).reshape(len(own), width)
            yield own, sizes[own], grid.astype(np.uint64)
            at = stop

    @staticmethod
    def _sum(steps, first, back: bool):
        """Log sums over all paths of a lattice: forward from its start, or ``back`` from its ends.

        ``steps[j, k - 1]`` are the log probabilities of the pieces of length k that end (back: start) at j, a column
        per word, and ``first`` those of no piece at all.
        """
        import numpy as np

        width, depth, n = steps.shape[0] - 1, steps.shape[1], steps.shape[2]
        # depth cells of nothing before the start (back: behind the end) save bounds in the loop
        sums = np.full((width + 1 + depth, n), -np.inf)
        with np.errstate(divide="ignore", invalid="ignore"):
            for j in range(width, -1, -1) if back else range(width + 1):
                near = sums[j + 1:j + 1 + depth] if back else sums[j:j + depth][::-1]
                ways = near + steps[j]
                top = np.maximum(ways.max(0), first[j])
                top[np.isneginf(top)] = 0
                sums[j if back else j + depth] = top + np.log(np.exp(ways - top).sum(0) + np.exp(first[j] - top))
        return sums[:width + 1] if back else sums[depth:]

    def _forward(self, grid):
        import numpy as np

        found, (n, width) = list(self.edges(grid)), grid.shape
        steps = np.full((width + 1, len(found), n), -np.inf)
        for k, row, start, piece in found:
            steps[start + k, k - 1, row] = self.logs[piece]
        first = np.full((width + 1, n), -np.inf)
        first[0] = 0
        return found, self._sum(steps, first, back=False)

    def log_probability(self, words: list[bytes]):
        """Natural log of each word's probability, summed over all of its segmentations (words with their mark)."""
        import numpy as np

        out = np.zeros(len(words))
        for own, sizes, grid in self.blocks(words):
            out[own] = self._forward(grid)[1][sizes, np.arange(len(own))]
        return out

    def expected(self, words: list[bytes], times):
        """Expected count of each piece in words that occur ``times`` each: forward and backward recursion."""
        import numpy as np

        counts, times = np.zeros(len(self.logs)), np.asarray(times, float)
        for own, sizes, grid in self.blocks(words):
            found, alpha = self._forward(grid)
            n, width = grid.shape
            steps = np.full((width + 1, len(found), n), -np.inf)
            for k, row, start, piece in found:
                steps[start, k - 1, row] = self.logs[piece]
            # behind the end of a shorter word nothing counts
            beta = self._sum(steps, np.where(sizes == np.arange(width + 1)[:, None], 0.0, -np.inf), back=True)
            total = alpha[sizes, np.arange(n)]
            for k, row, start, piece in found:
                share = np.exp(alpha[start, row] + self.logs[piece] + beta[start + k, row] - total[row])
                counts += np.bincount(piece, share * times[own][row], len(counts))
        return counts


def word_key(word: bytes) -> bytes:
    """What counts are kept by: the word, or the mark 0xFF and a 128-bit hash of a long one."""
    from xxhash import xxh3_128_digest

    return word if len(word) <= LONGEST_KEY else b"\xff" + xxh3_128_digest(word)


def _split(texts):
    """``(words, ids, parents)``: the distinct words of an Arrow string array, and the word and row of each token."""
    import numpy as np
    import pyarrow.compute as pc

    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat, parents = pc.list_flatten(lists), pc.list_parent_indices(lists)
    full = pc.greater(pc.binary_length(flat), 0)
    coded = flat.filter(full).dictionary_encode()
    words = coded.dictionary.cast("large_binary").to_pylist()
    return words, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), parents.filter(full).to_numpy(zero_copy_only=False).astype(np.int64)


def word_counts(texts: DataFrame) -> DataFrame:
    """``(key, long, n)``: tokens of each word of the one string column of ``texts``, and of the end of each text.

    ``long`` is the word itself where the key is a hash. Counted per slice of a task before the shuffle.
    """
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for start, stop in arrow_slices(b.column(0), SLICE):
                words, ids, _ = _split(b.column(0).slice(start, stop - start))
                n = np.bincount(ids, minlength=len(words)).tolist() + [stop - start]
                keys = [word_key(w) for w in words] + [END_KEY]
                long = [w if len(w) > LONGEST_KEY else None for w in words] + [None]
                yield pa.record_batch([pa.array(keys, pa.binary()), pa.array(long, pa.binary()), pa.array(n, pa.int64())], names=["key", "long", "n"])

    parts = texts.mapInArrow(run, "key binary, long binary, n long")
    return parts.groupBy("key").agg(F.max("long").alias("long"), F.sum("n").alias("n"))


def fit(counts: DataFrame, pieces: Pieces, rounds: int = ROUNDS) -> Pieces:
    """Piece probabilities after rounds of expected counts over the distinct words of ``counts``.

    Only one number per piece of the vocabulary reaches the driver. No counts leave the vocabulary's own scores.
    """
    spark, start = counts.sparkSession, pieces
    ends = counts.where(F.col("key") == F.lit(bytearray(END_KEY))).agg(F.sum("n")).first()[0] or 0
    words = counts.where(F.col("key") != F.lit(bytearray(END_KEY))).select(F.coalesce("long", "key").alias("word"), "n")
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(pieces)

        def run(batches: Iterator, sent=sent) -> Iterator:
            import numpy as np
            import pyarrow as pa

            lattices, total = Lattices(sent.value), np.zeros(len(sent.value.names))
            for b in batches:
                total += lattices.expected([MARK + w for w in b.column(0).to_pylist()], b.column(1).to_numpy(zero_copy_only=False))
            seen = np.flatnonzero(total)
            yield pa.record_batch([pa.array(seen, pa.int64()), pa.array(total[seen])], names=["piece", "n"])

        got = words.mapInArrow(run, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).toArrow()
        n = dict(zip(got["piece"].to_pylist(), got["n"].to_pylist()))
        whole = math.log(sum(n.values()) + ends + PRIOR_TOKENS)
        logs = [math.log(n.get(i, 0.0) + PRIOR_TOKENS * math.exp(p)) - whole for i, p in enumerate(start.logs)]
        pieces = Pieces(start.names, logs, math.log(ends + PRIOR_TOKENS * math.exp(start.end)) - whole)
        sent.unpersist()
    return pieces


def head_floor(counts: DataFrame) -> int:
    """The least count that at most ``HEAD_WORDS`` words reach, by logarithmic bins of counts; 1 if all words do."""
    bins = sorted(counts.groupBy(bin_floor(F.col("n")).alias("b")).agg(F.count("*").alias("words")).collect(), reverse=True)
    held, least = 0, None
    for b, words in bins:
        held += words
        if held > HEAD_WORDS:
            break
        least = b
    return least if least is not None else (bins[0][0] * 2 + 1 if bins else 1)


def new_share(n: int, once: int) -> float:
    """Share of tokens that are new words, from ``once`` words seen once among ``n`` tokens; all without training."""
    return (once + 1) / (n + 2) if n else 1.0


def score(docs: DataFrame, counts: DataFrame, pieces: Pieces, text_col: str = "text") -> DataFrame:
    """``(row, n_tokens, n_known, train_tokens, base_score, score)`` per row of ``docs``, all its other columns in ``row``.

    ``counts`` are the training tokens as from :func:`word_counts`, stored. ``base_score`` is the add-one unigram score
    over words, ``score`` the log10 probability of the text. Null and blank texts are the end alone. Repeated rows
    are scored one by one; empty ``counts`` leave every token unknown and all probability to the pieces.
    """
    spark = docs.sparkSession
    size = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.count_if(F.col("n") == 1).alias("once")).first()
    n_all, distinct = size["n"] or 0, size["v"]
    new = new_share(n_all, size["once"])
    least = head_floor(counts)
    top = counts.where(F.col("n") >= least).select("key", "n").collect()
    sent = spark.sparkContext.broadcast((pieces, {bytes(r["key"]): r["n"] for r in top}))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        model, head = sent.value
        lattices, remembered, ten = Lattices(model), {}, math.log(10)
        # logs of the share of the pieces, and of a word's frequency by its count
        by_pieces, by_word = math.log(new), math.log((1 - new) / n_all) if n_all else -math.inf
        for b in batches:
            for start, stop in arrow_slices(b.column(1), SLICE):
                rows = stop - start
                words, ids, parents = _split(b.column(1).slice(start, rows))
                fresh = [w for w in words if w not in remembered]
                found = dict(zip(fresh, lattices.log_probability([MARK + w for w in fresh]).tolist()))
                lattice = by_pieces + np.array([found[w] if w in found else remembered[w] for w in words])
                if len(remembered) + len(found) > REMEMBERED:
                    remembered.clear()
                remembered.update((w, x) for w, x in found.items() if len(w) <= LONGEST_KEY)
                keys = [word_key(w) for w in words]
                c = np.array([head.get(k, 0) for k in keys], float)
                # the end of the text is the last word
                c, lattice = np.append(c, head.get(END_KEY, 0)), np.append(lattice, by_pieces + model.end)
                ids, parents = np.append(ids, np.full(rows, len(words))), np.append(parents, np.arange(rows))
                with np.errstate(divide="ignore"):
                    logs = np.logaddexp(lattice, by_word + np.log(c)) / ten
                total = lambda values: np.bincount(parents, values[ids], rows)
                # words outside the head, once per text, wait for the join with their counts
                rest = (c[ids] == 0) & (ids < len(words))
                pairs, times = np.unique(parents[rest] * (len(words) + 1) + ids[rest], return_counts=True)
                owner, word = pairs // (len(words) + 1), pairs % (len(words) + 1)
                offsets = np.searchsorted(owner, np.arange(rows + 1)).astype(np.int32)
                tail = pa.StructArray.from_arrays(
                    [pa.array(keys, pa.binary()).take(pa.array(word)), pa.array(times, pa.int64()), pa.array(lattice[word])], names=["key", "times", "lattice"])
                yield pa.record_batch(
                    [b.column(0).slice(start, rows), pa.array(np.bincount(parents, minlength=rows)), pa.array(total(logs)), pa.array(total((c > 0) * 1.0).astype(np.int64)),
                     pa.array(total(np.log10(c + 1))), pa.ListArray.from_arrays(pa.array(offsets), tail)],
                    names=["row", "n_tokens", "points", "head_known", "head_log", "tail"])

    kept = docs.drop(text_col) if len(docs.columns) > 1 else docs
    two = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept.columns]).alias("row"), F.col(text_col).alias("text"))
    kind = two.schema["row"].dataType.simpleString()
    marked = two.mapInArrow(run, f"row {kind}, n_tokens long, points double, head_known long, head_log double, tail array<struct<key:binary,times:bigint,lattice:double>>")
    marked = stored(marked.withColumn("at", F.monotonically_increasing_id()), "scored")
    base = F.col("head_log") - F.col("n_tokens") * F.lit(math.log10(n_all + distinct + 1))
    if least <= 1:
        return marked.select("row", "n_tokens", F.col("head_known").alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"), base.alias("base_score"), F.col("points").alias("score"))
    cold = counts.where(F.col("n") < least).select(F.col("key").alias("c_key"), "n")
    waiting = marked.select("at", F.explode("tail").alias("t")).select("at", "t.*").hint("merge").join(cold, F.col("key") == F.col("c_key"))
    # the word's own edge joins the pieces' sum: log(e^lattice + e^word) - lattice
    gain = F.log1p(F.exp(F.log("n") + F.lit(math.log((1 - new) / n_all)) - F.col("lattice"))) / F.lit(math.log(10))
    more = waiting.groupBy(F.col("at").alias("m_at")).agg(
        F.sum("times").alias("known"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("logs"), F.sum(F.col("times") * gain).alias("gain"))
    out = marked.drop("tail").hint("merge").join(more, F.col("at") == F.col("m_at"), "left")
    return out.select("row", "n_tokens", (F.col("head_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"),
                      (base + F.coalesce("logs", F.lit(0.0))).alias("base_score"), (F.col("points") + F.coalesce("gain", F.lit(0.0))).alias("score"))
