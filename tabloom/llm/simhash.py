"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A 64-bit fingerprint is eight bytes, each at a fixed position. Two fingerprints with at most ``d`` differing bits share
at least ``8 - d`` positional bytes. The index lists each distinct fingerprint under every choice of that many
positions and their bytes, so a pair that reaches the guaranteed count meets under at least one list; the pair is kept
at its first such list only, its shared bytes are tallied, and its bits are verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import release, released, stored
from tabloom.llm.components import components

BYTES = 8


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def word_spans(text: str | None) -> tuple[bytes, list[int], list[int]]:
    """The words of a text, A-Z lower-cased and joined by one space, with their starts and ends."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    starts, ends, at = [], [], 0
    for w in words:
        starts.append(at)
        at += len(w)
        ends.append(at)
        at += 1
    return b" ".join(words), starts, ends


def shingle_hashes(text: str | None, size: int):
    """XXH64 (seed 42) of all ``size``-word shingles, repeats included; one for a shorter text, none for no words."""
    import numpy as np
    from xxhash import xxh64_intdigest as xx

    joined, starts, ends = word_spans(text)
    if not starts:
        return np.zeros(0, np.uint64)
    if len(starts) <= size:
        return np.array([xx(joined, 42)], np.uint64)
    return np.array([xx(joined[a:b], 42) for a, b in zip(starts, ends[size - 1:])], np.uint64)


def vote(hashes) -> int:
    """The fingerprint whose bit is 1 where over half of the hashes have it (signed; 0 without hashes)."""
    import numpy as np

    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        block = hashes[i:i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1).sum(0, dtype=np.int64)
    return _signed(int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4) -> DataFrame:
    """``(doc_id, fp)`` with the signed 64-bit fingerprint of every whole text, one row per row.

    Null and blank texts get fingerprint 0; repeated rows stay repeated.
    """
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            fps = [vote(shingle_hashes(t.as_py(), size)) for t in b.column(1)]
            yield pa.record_batch([b.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    two = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return two.mapInArrow(run, "doc_id long, fp long")


def _shared_bytes(x: Column) -> Column:
    """Bits 0 to 7 tell which bytes of ``x``, the XOR of two fingerprints, are zero."""
    return sum((F.when(F.shiftrightunsigned(x, 8 * i).bitwiseAND(F.lit(255)) == 0, 1 << i).otherwise(0) for i in range(1, BYTES)),
               F.when(x.bitwiseAND(F.lit(255)) == 0, 1).otherwise(0))


def _lists(fps: DataFrame, chosen: list[tuple[int, ...]]) -> DataFrame:
    """The inverted index: a row per fingerprint and choice of positions, keyed by the bytes there."""
    masks = [_signed(sum(255 << 8 * i for i in c)) for c in chosen]
    return fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("choice", "bytes"))


def fingerprint_links(fps: DataFrame, max_bits: int = 4) -> DataFrame:
    """``(a, b)``, a < b: all pairs of distinct fingerprints of ``fps(fp)`` that differ in at most ``max_bits`` bits.

    ``fps`` must be distinct. ``max_bits`` is 0 to 6, so that at least two positions are guaranteed. Each pair comes
    out once, under the first list that holds both, and only after verification.
    """
    if not 0 <= max_bits <= BYTES - 2:
        raise ValueError("max_bits must be between 0 and 6")
    need = BYTES - max_bits
    chosen = list(combinations(range(BYTES), need))
    before = [sum(1 << i for i in range(c[-1]) if i not in c) for c in chosen]
    left = _lists(fps, chosen).withColumnRenamed("fp", "a")
    right = _lists(fps, chosen).withColumnRenamed("fp", "b")
    x = F.col("a").bitwiseXOR(F.col("b"))
    shared = _shared_bytes(x)
    first = shared.bitwiseAND(F.element_at(F.array(*map(F.lit, before)), left["choice"] + 1)) == 0
    # lists are many times the size that their table suggests, so no side may be broadcast by estimate
    return (
        left.hint("merge").join(right, (left["choice"] == right["choice"]) & (left["bytes"] == right["bytes"]) & (F.col("a") < F.col("b"))
                  & first & (F.bit_count(shared) >= need) & (F.bit_count(x) <= max_bits))
        .select("a", "b")
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, max_bits: int = 4) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` per row: documents linked by close fingerprints, directly or in chains.

    ``component_id`` is the smallest id reachable (null if all are null); ``fingerprint`` is 16 hex digits. Links are
    found between distinct fingerprints; copies only join their fingerprint's class.
    """
    marked = stored(fingerprints(docs, id_col, text_col, size), "fingerprints")
    classes = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    member = stored(components(fingerprint_links(classes.select("fp"), max_bits)), "members")
    lowest = (
        member.join(classes, member["node"] == classes["fp"]).groupBy("component").agg(F.min("least").alias("component_id"))
    )
    linked = member.join(lowest, "component").select(F.col("node").alias("fp"), "component_id")
    ids = classes.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return marked.join(ids, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Similar word shingles: texts whose fingerprints are linked meet, as above, and exact Jaccard over the shingle hashes
# decides. A second index, over bytes that each sample one shingle, finds what fingerprints can't promise:
#
# At a Jaccard similarity of 0.8, 64 voted bits differ in up to 14 places (measured on the given tables), so no byte is
# guaranteed to agree. A byte that stands for the one shingle with the smallest permuted hash agrees with a probability
# of about the similarity, so six bytes agree in 0.26 of all pairs at 0.8, and in at least one of 42 times six bytes
# in all pairs but three in a million.

#: Bytes of a text's sketch, and how many of them are a key of the index together.
SKETCH, BAND = 256, 6
#: Texts that meet a leader in one task. Texts and shingles of a block of a family, about, which a task holds twice.
LEAST_BLOCK, MOST_BLOCK, BLOCK_SHINGLES = 64, 4096, 1 << 20


def _permutations():
    import numpy as np

    rng = np.random.default_rng(64)
    return rng.integers(0, 1 << 63, SKETCH, dtype=np.uint64), rng.integers(0, 1 << 63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sketch(hashes, turns) -> bytes:
    """``SKETCH`` bytes, each of the shingle hash that is smallest under that byte's permutation (zeros without hashes)."""
    import numpy as np

    if not len(hashes):
        return bytes(SKETCH)
    least = np.full(SKETCH, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 4096):
        least = np.minimum(least, ((hashes[i:i + 4096, None] ^ turns[0]) * turns[1]).min(0))
    return ((least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.uint8).tobytes()


def text_marks(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """``(doc_id, same, fp, n, keys)`` per row: ``same`` is a 128-bit hash of the words, equal for equal word sequences.

    ``fp`` is the signed fingerprint, ``n`` counts the shingles and ``keys`` are the text's keys in the index of sampled
    bytes, none for a text without words.
    """
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh3_128_digest

        turns, bands = _permutations(), SKETCH // BAND
        for b in batches:
            same, fp, n, keys = [], [], [], []
            for t in b.column(1):
                text = t.as_py()
                hashes = shingle_hashes(text, size)
                same.append(xxh3_128_digest(word_spans(text)[0]))
                fp.append(vote(hashes))
                n.append(len(hashes))
                wide = np.zeros((bands, 8), np.uint8)
                wide[:, :BAND] = np.frombuffer(sketch(hashes, turns), np.uint8)[:bands * BAND].reshape(bands, BAND)
                keys.append(wide.view("<i8").ravel() if len(hashes) else [])
            yield pa.record_batch([b.column(0), pa.array(same, pa.binary()), pa.array(fp, pa.int64()), pa.array(n, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                                  names=["doc_id", "same", "fp", "n", "keys"])

    two = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = two.schema["doc_id"].dataType.simpleString()
    return two.mapInArrow(released(run), f"doc_id {kind}, same binary, fp long, n long, keys array<bigint>")


def shingle_sets(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """``(same, hashes)`` of the rows of ``docs`` whose id is in ``ids(any_id)``: the distinct hashes of their shingles."""
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh3_128_digest

        for b in batches:
            # few texts at a time: a batch of sets is larger than its texts
            for at in range(0, b.num_rows, 256):
                texts = b.column(0).slice(at, 256).to_pylist()
                same = [xxh3_128_digest(word_spans(t)[0]) for t in texts]
                sets = [np.unique(shingle_hashes(t, size)).view(np.int64) for t in texts]
                yield pa.record_batch([pa.array(same, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], names=["same", "hashes"])

    two = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # the ids grow with the documents, so they are never broadcast
    rows = two.hint("merge").join(ids.where("any_id is not null"), F.col("doc_id") == F.col("any_id"), "left_semi").select("text")
    if not ids.where("any_id is null").isEmpty():
        rows = rows.unionAll(two.where("doc_id is null").select("text"))
    return rows.mapInArrow(released(run), "same binary, hashes array<bigint>")


def links_within(same: list, label, offsets, hashes, similarity: float) -> list[tuple]:
    """Pairs of at least this Jaccard similarity that join all parts of a block which such pairs connect.

    ``label`` numbers the parts that are joined already; text ``i`` has ``hashes[offsets[i]:offsets[i + 1]]``. Each text
    that is outside the largest part when its turn comes is compared with all others; a link between two other texts
    shows when one of them has its turn.
    """
    import numpy as np

    n, size, label, out = len(same), np.diff(offsets), label.copy(), []
    _, ids, times = np.unique(hashes, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), size)
    shared = times[ids] > 1
    ids, owner = ids[shared], owner[shared]
    starts = np.searchsorted(owner, np.arange(n + 1))
    members = np.bincount(label, minlength=n)
    for i in range(n):
        if label[i] == members.argmax():
            continue
        here = np.zeros(len(times), bool)
        here[ids[starts[i]:starts[i + 1]]] = True
        both = np.bincount(owner[here[ids]], minlength=n)
        for j in np.flatnonzero((both > 0) & (label != label[i]) & (both / np.maximum(size[i] + size - both, 1) >= similarity)):
            if label[j] != label[i]:
                out.append((same[i], same[j]))
                members[label[i]] += members[label[j]]
                members[label[j]] = 0
                label[label == label[j]] = label[i]
    return out


def _block_links(blocks: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``(a, b)``: what ``links_within`` finds in each block of ``blocks(g, i, j, same, part)``."""
    def run(table):
        import numpy as np
        import pyarrow as pa

        same, found = table["same"].to_pylist(), []
        _, label = np.unique(np.array([p.hex() for p in table["part"].to_pylist()]), return_inverse=True)
        if label.any():
            lists = table["hashes"].combine_chunks()
            hashes, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            found = links_within(same, label, offsets - offsets[0], hashes[offsets[0]:offsets[-1]], similarity)
            del lists, hashes, offsets
            release()
        return pa.table({"a": pa.array([a for a, _ in found], pa.binary()), "b": pa.array([b for _, b in found], pa.binary())})

    rows = blocks.hint("merge").join(sets.withColumnRenamed("same", "s_same"), F.col("same") == F.col("s_same"))
    return rows.select("g", "i", "j", "same", "part", "hashes").groupBy("g", "i", "j").applyInArrow(run, "a binary, b binary")


def _lists_of_several(classes: DataFrame, max_bits: int) -> DataFrame:
    """``(same, band, key, lead)``: the members of every list of two texts or more, with its smallest one.

    Band -1 has a list for all texts whose fingerprints are linked at ``max_bits`` bits, also in chains; the others are
    the index of sampled bytes.
    """
    worded = classes.where("n > 0").select("same", "fp")
    fps = stored(worded.select("fp").distinct(), "distinct-fingerprints")
    close = stored(components(fingerprint_links(fps, max_bits)), "close-fingerprints")
    linked = worded.hint("merge").join(close, F.col("fp") == F.col("node"), "left").select("same", F.lit(-1).alias("band"), F.coalesce("component", "fp").alias("key"))
    # one exchange serves both the smallest of the lists and their members
    lists = classes.select("same", F.posexplode("keys").alias("band", "key")).unionAll(linked).repartition("band", "key")
    ends = lists.groupBy("band", "key").agg(F.min("same").alias("lead"), F.max("same").alias("last")).where("lead <> last")
    ends = ends.select(F.col("band").alias("e_band"), F.col("key").alias("e_key"), "lead")
    return lists.hint("merge").join(ends, (F.col("band") == F.col("e_band")) & (F.col("key") == F.col("e_key"))).select("same", "band", "key", "lead")


def _star_blocks(met: DataFrame) -> DataFrame:
    """Blocks of each text with the one that leads most of its lists; a lead of many is in each of its blocks."""
    led = met.where("same <> lead").groupBy("same", "lead").agg(F.count("*").alias("times"))
    led = stored(led.groupBy("same").agg(F.max(F.struct("times", "lead")).alias("m")).select("same", F.col("m.lead").alias("g")), "leads")
    slots = led.groupBy(F.col("g").alias("lead")).agg(F.ceil(F.count("*") / LEAST_BLOCK).cast("int").alias("slots"))
    slots = stored(slots, "slots")
    own = led.hint("merge").join(slots, F.col("g") == F.col("lead")).select("g", F.pmod(F.xxhash64("same"), "slots").cast("int").alias("i"), "same")
    heads = slots.select(F.col("lead").alias("g"), F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("i"), F.col("lead").alias("same"))
    return own.unionAll(heads).select("g", "i", F.lit(0).alias("j"), "same", F.col("same").alias("part"))


def _family_blocks(met: DataFrame, member: DataFrame, classes: DataFrame) -> DataFrame | None:
    """Blocks in which all texts meet that lists with several parts connect; none if every list is one part.

    ``member(node, component)`` are the parts. The texts of a family are dealt into blocks, and any two blocks meet.
    """
    part = F.coalesce("component", "same").alias("part")
    met = met.hint("merge").join(member, F.col("same") == F.col("node"), "left").select("same", "band", "key", "lead", part)
    mixed = met.groupBy("band", "key").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p <> q").select(F.col("band").alias("m_band"), F.col("key").alias("m_key"))
    rows = met.hint("merge").join(mixed, (F.col("band") == F.col("m_band")) & (F.col("key") == F.col("m_key")))
    rows = stored(rows.select("same", "lead", "part").distinct(), "mixed-lists")
    if rows.isEmpty():
        return None
    family = stored(components(rows.select(F.col("same").alias("a"), F.col("lead").alias("b"))), "families")
    parts = rows.select("same", "part").distinct()
    texts = family.hint("merge").join(parts, F.col("node") == F.col("same")).select("same", "part", F.col("component").alias("g"))
    texts = stored(texts.hint("merge").join(classes.select(F.col("same").alias("c_same"), "n"), F.col("same") == F.col("c_same")).select("same", "part", "g", "n"), "family-texts")
    # a text travels with its hashes once for every other block, so blocks are as large as a task can hold
    count = F.greatest(F.ceil(F.count("*") / MOST_BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    sizes = stored(texts.groupBy(F.col("g").alias("s_g")).agg(count.alias("blocks")), "family-sizes")
    dealt = texts.hint("merge").join(sizes, F.col("g") == F.col("s_g")).withColumn("own", F.pmod(F.xxhash64("same"), "blocks").cast("int"))
    others = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: x != F.col("own")))
    dealt = dealt.select("g", "own", "same", "part", F.explode(others).alias("other"))
    return dealt.select("g", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "same", "part")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = 0.8, max_bits: int = 4) -> DataFrame:
    """``(doc_id, same, group)`` per row: texts linked by word shingles of at least this similarity, also in chains.

    Texts with equal words form a class, and blank texts are one. Texts meet when their fingerprints are linked at
    ``max_bits`` bits or when they share a list of the index of sampled bytes. Every link is decided by the exact Jaccard
    similarity of the shingle hashes. Each text is first compared with the leader of most of its index lists. Where a list then
    still has several parts, all texts that such lists connect form a family, and all pairs of a family in different
    parts are compared, block by block; so no list is cut, and large groups of copies cost as much as they have texts.
    """
    marks = stored(text_marks(docs, id_col, text_col, size), "text-marks")
    classes = stored(marks.groupBy("same").agg(F.min("doc_id").alias("any_id"), F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("keys").alias("keys")), "text-classes")
    met = stored(_lists_of_several(classes, max_bits), "lists")
    stars = stored(_star_blocks(met), "stars")
    wanted = stars.select(F.col("same").alias("w_same")).distinct()
    ids = stored(classes.select("same", "any_id").hint("merge").join(wanted, F.col("same") == F.col("w_same"), "left_semi").select("any_id").distinct(), "set-ids")
    sets = stored(shingle_sets(docs, ids, id_col, text_col, size), "shingle-sets")
    links = _block_links(stars, sets, similarity)
    member = stored(components(links), "group-members")
    families = _family_blocks(met, member, classes)
    if families is not None:
        links = _block_links(families, sets, similarity).unionAll(member.select(F.col("node").alias("a"), F.col("component").alias("b")))
        member = stored(components(links), "all-members")
    return marks.join(member, F.col("same") == F.col("node"), "left").select("doc_id", "same", F.coalesce("component", "same").alias("group"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = 0.8, max_bits: int = 4) -> DataFrame:
    """The rows of ``docs`` that stay: of each group the smallest id (nulls last), once if rows are repeated."""
    groups = stored(similar_groups(docs, id_col, text_col, size, similarity, max_bits), "groups")
    first = groups.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "same")).alias("k")).select("k.doc_id", "k.same")
    times = groups.where("doc_id is not null").groupBy(F.col("doc_id").alias("t_id")).agg(F.count("*").alias("times"))
    kept = stored(first.join(times, F.col("doc_id") == F.col("t_id"), "left").select("doc_id", "same", F.coalesce("times", F.lit(2)).alias("times")), "kept")
    # the kept ids grow with the documents, so they are never broadcast
    out = docs.hint("merge").join(kept.where("times = 1").select(F.col("doc_id").alias("kept_id")), docs[id_col] == F.col("kept_id"), "left_semi")
    unclear = kept.where("times > 1").select(F.col("doc_id").alias("kept_id"), F.col("same").alias("kept_same"))
    if unclear.isEmpty():
        return out
    # ids on several rows, or none: tell those rows apart by their words
    ids = unclear.select(F.col("kept_id").alias("any_id")).distinct()
    rows = _with_same(docs.join(ids, docs[id_col].eqNullSafe(F.col("any_id")), "left_semi"), text_col)
    hit = rows.join(unclear, rows[f"row.{id_col}"].eqNullSafe(F.col("kept_id")) & (F.col("same") == F.col("kept_same")))
    once = hit.groupBy("kept_id", "kept_same").agg(F.first("row").alias("row"))
    return out.unionByName(once.select("row.*"))


def _with_same(rows: DataFrame, text_col: str) -> DataFrame:
    """``(row, same)``: all columns of each row and the hash of its words."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from xxhash import xxh3_128_digest

        for b in batches:
            same = [xxh3_128_digest(word_spans(t)[0]) for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(same, pa.binary())], names=["row", "same"])

    two = rows.select(F.struct("*").alias("row"), F.col(text_col).alias("text"))
    return two.mapInArrow(run, f"row {two.schema['row'].dataType.simpleString()}, same binary")
