"""Shared pieces of the training-data operators: shared-folder tables, file access and word rules."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

from tabloom.functions.lineage import ensure_checkpoint_dir

#: Words are runs of anything but these: the space and the controls x09 to x0D.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


def shared_folder(spark: SparkSession, name: str) -> str:
    """URI of a new folder that the driver and all executors can reach (below ``spark.checkpoint.dir``)."""
    ensure_checkpoint_dir(spark)
    base = re.sub(r"^file:/+", "file:///", spark.sparkContext.getCheckpointDir())
    return f"{base}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to a shared folder and read it back: lineage ends there and lost executors reread files."""
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def files(uri: str):
    """The pyarrow filesystem and path of a URI, for tasks that write or read files of their own format."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def arrow_slices(texts, size: int) -> Iterator[tuple[int, int]]:
    """Bounds of runs of an Arrow string array that hold about ``size`` bytes each (a longer text is a run of its own)."""
    import numpy as np
    import pyarrow.compute as pc

    held = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(held):
        before = held[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(held, before + size, side="right")))
        yield start, stop
        start = stop


def release() -> None:
    """Give memory that this worker has freed back to the system (glibc keeps it otherwise)."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for ``mapInArrow``, whose worker keeps no freed memory afterwards: it stays idle beside later steps."""
    def rows(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return rows
