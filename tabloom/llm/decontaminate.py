"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts are folded: lower case, runs of anything but letters and digits become one space. An item of ``m`` characters
that occurs in a text with at most ``k`` edits keeps at least ``m - q + 1 - k * q`` of its q-grams, and their diagonals
(position in the text minus position in the item) span at most ``k``. So shared q-grams are counted in overlapping
bands of ``2 (k + 1)`` diagonals, ``k + 1`` apart; bands that reach the bound are kept and verified by an alignment
that stays within ``k`` diagonals of the band.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import arrow_slices, released

Q = 10
#: Edits allowed per 100 characters of an item; fewer for short items, so that one shared q-gram stays guaranteed.
EDIT_PERCENT = 8
#: Characters of items that one pass over the documents holds, and characters of documents handled at once.
BLOCK_CHARS, SLICE_CHARS = 1 << 21, 1 << 20
SPACE, BORDER = 32, 0x110000
LEAK = "item_id bigint, edits int, end int"
SLOT_BITS = 22


class Folder:
    """Folds texts to arrays of code points."""

    def __init__(self):
        import numpy as np

        self.np, self.code = np, np.full(0x110000, -1, np.int32)

    def fold(self, texts: list[str]):
        """``(codes, ends)``: the folded texts with a border before each and after the last, and the borders' places."""
        np = self.np
        low = [t.lower() for t in texts]
        raw = np.frombuffer(" ".join(["", *low, ""]).encode("utf-32-le"), np.uint32)
        x = self.code[raw]
        if (x < 0).any():
            new = np.unique(raw[x < 0])
            self.code[new] = [c if chr(c).isalnum() else SPACE for c in new.tolist()]
            x = self.code[raw]
        x[np.cumsum([0, *(len(t) + 1 for t in low)])] = BORDER
        spaced = x == SPACE
        after = np.concatenate([[False], (spaced | (x == BORDER))[:-1]])
        x = x[~(spaced & after)]
        x = x[~((x == SPACE) & np.concatenate([x[1:] == BORDER, [False]]))]
        return x, np.flatnonzero(x == BORDER)


def gram_hashes(x, q: int):
    """A 64-bit polynomial hash of each window of ``q`` codes."""
    import numpy as np

    base, size, span = 0x9E3779B97F4A7C15 | 1, 1, x.astype(np.uint64) + np.uint64(1)
    whole, covered = None, 0
    power = lambda n: np.uint64(pow(base, n, 1 << 64))
    left = q
    while True:
        if left & 1:
            whole = span if whole is None else whole[:len(span) - covered] * power(size) + span[covered:][:len(whole)]
            covered += size
        left >>= 1
        if not left:
            return whole[:max(0, len(x) - q + 1)]
        span = span[:-size] * power(size) + span[size:] if len(span) > size else span[:0]
        size *= 2


class Index:
    """The q-grams of a block of items."""

    def __init__(self, items: list[tuple[int | None, str]], q: int, edit_percent: int):
        import numpy as np

        folder, self.q = Folder(), q
        self.ids, self.codes, hashes, owner, place = [], [], [], [], []
        for item, text in items:
            x = folder.fold([text])[0][1:-1]
            if len(x) >= q:
                h = gram_hashes(x, q)
                hashes.append(h)
                owner.append(np.full(len(h), len(self.ids)))
                place.append(np.arange(len(h)))
                self.ids.append(item)
                self.codes.append(x)
        m = np.array([len(x) for x in self.codes], np.int64)
        self.budget = np.minimum(m * edit_percent // 100, (m - q) // q)
        self.need = m - q + 1 - self.budget * q
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.grams, self.first, self.count = np.unique(h[order], return_index=True, return_counts=True)
        self.owner = (np.concatenate(owner) if owner else np.zeros(0, np.int64))[order]
        self.place = (np.concatenate(place) if place else np.zeros(0, np.int64))[order]
        self.slots = np.zeros(1 << SLOT_BITS, bool)
        self.slots[self._slot(self.grams)] = True

    @staticmethod
    def _slot(h):
        import numpy as np

        return ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def leaks(self, texts: list[str], folder: Folder) -> list[list[tuple]]:
        """``(item_id, edits, end)`` of every item in each text: the fewest edits and where that occurrence ends."""
        import numpy as np

        out: list[list[tuple]] = [[] for _ in texts]
        if not self.ids:
            return out
        x, borders = folder.fold(texts)
        h = gram_hashes(x, self.q)
        at = np.flatnonzero(self.slots[self._slot(h)])
        gram = np.minimum(np.searchsorted(self.grams, h[at]), len(self.grams) - 1)
        real = self.grams[gram] == h[at]
        at, gram = at[real], gram[real]
        n = self.count[gram]
        entry = np.repeat(self.first[gram] - np.cumsum(n) + n, n) + np.arange(n.sum())
        item, diagonal = self.owner[entry], np.repeat(at, n) - self.place[entry]
        doc = np.repeat(np.searchsorted(borders, at) - 1, n)
        band = diagonal // (self.budget[item] + 1)
        shift = len(x) + 2 * max(map(len, self.codes))
        low = int(band.min(initial=0)) - 1
        key = ((doc * len(self.ids) + item) * (2 * shift)) + band - low
        keys, counts = np.unique(np.concatenate([key, key - 1]), return_counts=True)
        pair = keys // (2 * shift)
        good = counts >= self.need[pair % len(self.ids)]
        best: dict[int, tuple[int, int]] = {}
        for p, b in zip(pair[good].tolist(), (keys[good] % (2 * shift) + low).tolist()):
            d, i = divmod(p, len(self.ids))
            found = self._align(x, borders[d] + 1, borders[d + 1], i, b)
            if found and (p not in best or found < best[p]):
                best[p] = found
        for p, (edits, end) in sorted(best.items()):
            d, i = divmod(p, len(self.ids))
            out[d].append((self.ids[i], edits, int(end - borders[d] - 1)))
        return out

    def _align(self, x, start: int, stop: int, i: int, band: int) -> tuple[int, int] | None:
        """Fewest edits of item ``i`` around a band of diagonals of the text ``x[start:stop]`` and its end, if within budget."""
        import numpy as np

        a, k = self.codes[i], int(self.budget[i])
        first = band * (k + 1) - k
        width = 2 * (k + 1) + 2 * k
        window = np.full(len(a) + width, BORDER, np.int32)
        lo, hi = max(first, start), min(first + len(window), stop)
        if lo >= hi:
            return None
        window[lo - first:hi - first] = x[lo:hi]
        offsets = np.arange(width)
        row = np.zeros(width, np.int64)
        for j, c in enumerate(a):
            down = row + (window[j:j + width] != c)
            down[:-1] = np.minimum(down[:-1], row[1:] + 1)
            row = np.minimum.accumulate(down - offsets) + offsets
            if row.min() > k:
                return None
        o = int(row.argmin())
        return int(row[o]), first + len(a) + o


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list]:
    """The items in blocks of about BLOCK_CHARS characters, one block on the driver at a time."""
    block, held = [], 0
    for r in benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).where("t is not null").toLocalIterator():
        block.append((r["i"], r["t"]))
        held += len(r["t"])
        if held >= BLOCK_CHARS:
            yield block
            block, held = [], 0
    if block:
        yield block


def find_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
               carry: list[str] | None = None, q: int = Q, edit_percent: int = EDIT_PERCENT) -> DataFrame:
    """``(row, leaks)`` per row: its columns (only ``carry`` if given) and an array of ``(item_id, edits, end)``.

    An item leaks into a text when some part of the folded text is within its edit budget; the entry has the fewest
    edits and the folded end position. Items of fewer than ``q`` folded characters are never found. Null and empty
    texts have no leaks; repeated rows and items are reported one by one. Items are taken in blocks of bounded size,
    a narrow pass over all documents each; no document is shuffled.
    """
    spark = docs.sparkSession
    cols = docs.columns if carry is None else carry
    apart = [] if text_col in cols else [F.col(text_col).alias("text")]  # a text within the row isn't sent twice
    frame = docs.select(F.struct(*[docs[c] for c in cols]).alias("row"), *apart, F.lit(None).cast(f"array<struct<{LEAK.replace(' ', ':').replace(',:', ',')}>>").alias("leaks"))
    blocks = list(_indexed(spark, benchmark, item_col, item_text_col, q, edit_percent))
    for n, held in enumerate(blocks, 1):
        frame = _one_pass(frame, held, text_col, last=n == len(blocks))
    return frame.select("row", F.coalesce("leaks", F.array().cast(frame.schema["leaks"].dataType)).alias("leaks"))


def _indexed(spark, benchmark: DataFrame, item_col: str, text_col: str, q: int, edit_percent: int) -> Iterator:
    for block in _blocks(benchmark, item_col, text_col):
        yield spark.sparkContext.broadcast(Index(block, q, edit_percent))


def _one_pass(frame: DataFrame, held, text_col: str, last: bool) -> DataFrame:
    """Add the leaks of one block of items; the last pass gives the text up."""
    kept = frame.schema if not last else frame.select("row", "leaks").schema

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        folder, index = Folder(), held.value
        for b in batches:
            column = b.column("text") if "text" in b.schema.names else b.column("row").field(text_col)
            for i, j in arrow_slices(column, SLICE_CHARS):
                part = b.slice(i, j - i)
                found = index.leaks([t or "" for t in column.slice(i, j - i).to_pylist()], folder)
                leaks = part.column("leaks")
                if any(found):
                    before = leaks.to_pylist()
                    leaks = pa.array([(old or []) + [dict(zip(("item_id", "edits", "end"), x)) for x in new] for old, new in zip(before, found)], leaks.type)
                yield pa.record_batch([leaks if c == "leaks" else part.column(c) for c in kept.names], names=kept.names)

    return frame.mapInArrow(released(run), kept)
