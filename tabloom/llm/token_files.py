"""Token ids as Arrow stream files of fixed-size-list batches, with the index that addresses documents in them.

Documents are laid out in ascending id order over range-partitioned shards. A shard is one Arrow IPC stream file whose
batches hold ``BATCH`` equal-length sequences: ``ids`` (fixed-size list of uint16, or uint32 for vocabularies above
65,536) and ``mask`` (fixed-size list of bool, false on the padding after the shard's last id). Document ``d`` is the
run ``[local_start, local_start + n_tokens)`` of its shard's unmasked ids. Sequence ``i`` is row ``i % BATCH`` of batch
``i // BATCH``, so a memory-mapped shard gives every sequence and mask as a view without a copy.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.common import arrow_slices, files, shared_folder

LENGTH = 2048
BATCH = 256
#: Bytes of text encoded at once and distinct words remembered by a worker.
SLICE_BYTES = 3 << 20
REMEMBERED = 300_000
#: A letter, then commas or points before white space.
WORD_MARKS = r"([a-z\x{df}-\x{f6}\x{f8}-\x{ff}])([.,]+[ \n])"


class WordEncoder:
    """Encodes texts with a tokenizer file, calling it once per distinct run between ASCII white space.

    Valid for tokenizers that ignore case, drop white space and never join a letter with a mark or anything across
    white space, as ``word_bpe_49k`` does. Case is folded for A-Z and marks after a word are set apart beforehand only
    so that fewer runs are distinct. A worker keeps one encoder per file and at most ``REMEMBERED`` runs in it. When
    they are full, those go that were not met again since they were learned or last kept.
    """

    def __init__(self, tokenizer_path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self._forget()

    @classmethod
    def of(cls, tokenizer_path: str) -> WordEncoder:
        if tokenizer_path not in _ENCODERS:
            _ENCODERS[tokenizer_path] = cls(tokenizer_path)
        return _ENCODERS[tokenizer_path]

    def _forget(self) -> None:
        import numpy as np

        self.slots: dict[str, int] = {}
        self.table, self.size, self.first, self.again = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _make_room(self, words: list[str]) -> None:
        """Keep the runs that were met again, or none if the new ones of ``words`` still don't fit."""
        import numpy as np

        keep = self.again > 0
        self.slots = {w: i for i, w in enumerate(w for w, k in zip(self.slots, keep) if k)}
        self.table, self.size = self.table[np.repeat(keep, self.size)], self.size[keep]
        self.first, self.again = np.cumsum(self.size) - self.size, np.zeros(len(self.size), np.int64)
        if len(self.slots) + sum(w not in self.slots for w in words) > REMEMBERED:
            self._forget()

    def _learn(self, words: list[str]) -> None:
        """Encode the runs that are new and append their ids to the table."""
        import numpy as np

        new = [w for w in words if w not in self.slots]
        if len(self.slots) + len(new) > REMEMBERED:
            self._make_room(words)
            new = [w for w in words if w not in self.slots]
        if not new:
            return
        runs = [e.ids for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]
        self.slots.update(zip(new, range(len(self.slots), len(self.slots) + len(new))))
        self.size = np.concatenate([self.size, np.fromiter(map(len, runs), np.int64, len(runs))])
        self.table = np.concatenate([self.table, np.fromiter(chain.from_iterable(runs), np.uint32)])
        self.first = np.cumsum(self.size) - self.size
        self.again = np.concatenate([self.again, np.full(len(new), -1)])

    def encode(self, texts) -> tuple:
        """``(ids, lengths)``: all ids of an Arrow string array one after another, and how many each text has."""
        import numpy as np
        import pyarrow.compute as pc

        texts = texts.fill_null("")
        if not pc.any(pc.match_substring(texts, "<|")).as_py():  # else the case of a special token's name matters
            texts = pc.replace_substring_regex(pc.ascii_lower(texts), WORD_MARKS, r"\1 \2")
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        self._learn(words)
        slot = np.fromiter(map(self.slots.__getitem__, words), np.int64, len(words))
        self.again[slot] += 1
        index = slot[coded.indices.to_numpy(zero_copy_only=False)]
        n = self.size[index]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = self.table[np.repeat(self.first[index] - ends[:-1], n) + np.arange(ends[-1])]
        cuts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        return ids, ends[cuts[1:]] - ends[cuts[:-1]]


_ENCODERS: dict[str, WordEncoder] = {}


class ShardWriter:
    """Fills equal-length sequences and writes them as an Arrow stream."""

    def __init__(self, sink, dtype: str, length: int, batch: int):
        import numpy as np
        import pyarrow as pa

        self.pa, self.np, self.length, self.room = pa, np, length, length * batch
        item = pa.from_numpy_dtype(np.dtype(dtype))
        self.schema = pa.schema([("ids", pa.list_(item, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.item, self.buffer, self.at, self.total = item, np.zeros(self.room, dtype), 0, 0
        self.sink, self.stream = sink, pa.ipc.new_stream(sink, self.schema)

    def add(self, ids) -> None:
        done = 0
        while done < len(ids):
            take = min(len(ids) - done, self.room - self.at)
            self.buffer[self.at:self.at + take] = ids[done:done + take]
            self.at, done = self.at + take, done + take
            if self.at == self.room:
                self._flush()
        self.total += len(ids)

    def _flush(self) -> None:
        rows = -(-self.at // self.length)
        values = self.buffer[:rows * self.length].copy()
        mask = self.np.arange(len(values)) < self.at
        lists = [self.pa.FixedSizeListArray.from_arrays(self.pa.array(v, t), self.length) for v, t in ((values, self.item), (mask, self.pa.bool_()))]
        self.stream.write_batch(self.pa.record_batch(lists, schema=self.schema))
        self.buffer[:], self.at = 0, 0

    def close(self) -> None:
        if self.at:
            self._flush()
        self.stream.close()
        self.sink.close()


class ShardReader:
    """Random access to a shard: ``sequence(i)``, ``mask(i)`` and ``run(start, n)``."""

    def __init__(self, uri: str):
        import pyarrow as pa
        from pyarrow import fs

        system, path = files(uri)
        source = pa.memory_map(path) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(path)
        with pa.ipc.open_stream(source) as stream:
            self.batches = list(stream)
            self.length = stream.schema.field("ids").type.list_size
        self.batch = self.batches[0].num_rows if self.batches else 1

    def sequence(self, i: int):
        return self.batches[i // self.batch].column("ids")[i % self.batch].values.to_numpy(zero_copy_only=True)

    def mask(self, i: int):
        return self.batches[i // self.batch].column("mask")[i % self.batch].values

    def run(self, start: int, n: int):
        import numpy as np

        room, parts = self.length * self.batch, []
        while n > 0:
            values = self.batches[start // room].column("ids").flatten().to_numpy(zero_copy_only=True)
            part = values[start % room:start % room + n]
            parts.append(part)
            start, n = start + len(part), n - len(part)
        return np.concatenate(parts) if parts else np.zeros(0, np.uint16)


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
                      length: int = LENGTH, batch: int = BATCH) -> DataFrame:
    """Write the shards and return their stored index ``(doc_id, shard, path, local_start, n_tokens)``.

    Every whole text (null: empty) is encoded without special tokens and followed by ``end_id``. Order is by id, nulls
    first; repeated ids are ordered by a hash of their text. A retried task writes a new file; the index names the
    file of the attempt that was committed. An empty table writes no file.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark, "token-files")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        encoder, writer, path = WordEncoder.of(tokenizer_path), None, None
        context = TaskContext.get()
        shard = context.partitionId()
        dtype = "uint16" if max(encoder.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "uint32"
        for b in batches:
            for i, j in arrow_slices(b.column(1), SLICE_BYTES):
                part = b.slice(i, j - i)
                if writer is None:
                    system, root = files(folder)
                    system.create_dir(root, recursive=True)
                    path = f"{folder}/shard-{shard:08d}-{context.taskAttemptId()}.arrows"
                    writer = ShardWriter(system.open_output_stream(files(path)[1]), dtype, length, batch)
                ids, n = encoder.encode(part.column(1))
                ends = np.cumsum(n)
                starts = writer.total + ends - n + np.arange(len(n))
                writer.add(np.insert(ids, ends, end_id))
                yield pa.record_batch([part.column(0), pa.array([shard] * len(n), pa.int32()), pa.array([path] * len(n)),
                                       pa.array(starts, pa.int64()), pa.array(n + 1, pa.int64())],
                                      names=["doc_id", "shard", "path", "local_start", "n_tokens"])
        if writer:
            writer.close()

    two = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    tie = F.xxhash64("text")
    ordered = two.repartitionByRange(F.col("doc_id"), tie).sortWithinPartitions(F.col("doc_id"), tie)
    index = ordered.mapInArrow(run, "doc_id long, shard int, path string, local_start long, n_tokens long")
    out = f"{folder}/index"
    index.write.parquet(out)
    return spark.read.schema(index.schema).parquet(out)


def read_token_files(index: DataFrame) -> DataFrame:
    """Read every document's ids back from its shard: ``(doc_id, start, n_tokens, ids_crc32)``.

    ``start`` counts the ids of all documents before it over all shards. An index file holds one shard's rows, so a
    task opens few shards and nothing but the shards' totals is shuffled.
    """
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        open_path, reader = None, None
        for b in batches:
            crc = []
            for path, at, n in zip(b.column("path").to_pylist(), b.column("local_start").to_pylist(), b.column("n_tokens").to_pylist()):
                if path != open_path:
                    open_path, reader = path, ShardReader(path)
                crc.append(zlib.crc32(reader.run(at, n).astype("<u4").tobytes()))
            yield pa.record_batch([b.column("doc_id"), b.column("shard"), b.column("local_start"), b.column("n_tokens"), pa.array(crc, pa.int64())],
                                  names=["doc_id", "shard", "local_start", "n_tokens", "ids_crc32"])

    totals = index.groupBy("shard").agg(F.sum("n_tokens").alias("ids"))
    before = totals.select("shard", (F.sum("ids").over(Window.orderBy("shard")) - F.col("ids")).alias("before"))
    read = index.mapInArrow(run, "doc_id long, shard int, local_start long, n_tokens long, ids_crc32 long")
    return read.join(before, "shard").select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
