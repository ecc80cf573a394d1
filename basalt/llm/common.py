"""Helpers shared by the training-data operators: shared storage, Arrow batches, hashes of spans."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Odd multipliers of the 64-bit mixing functions (fixed values, any odd numbers would do).
MIX_A = np.uint64(0x9E3779B97F4A7C15)
MIX_B = np.uint64(0xC2B2AE3D27D4EB4F)
MIX_C = np.uint64(0xD6E8FEB86659FD93)

#: Bytes of text that a Python operator holds at a time; a longer text is a chunk of its own, taken in pieces.
CHUNK_BYTES = 250_000
#: Bytes of an Arrow batch that goes to a Python worker (a longer row is a batch of its own).
BATCH_BYTES = 4 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only on a local master that names none (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='basalt-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/basalt-{uuid.uuid4().hex[:12]}/{name}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing reads any more, and let Spark drop ended jobs' shuffle files.

    Spark's cleaner follows the driver's garbage collector, which a driver with a large heap may not run
    for half an hour; meanwhile executors keep the shuffle files of ended jobs.
    """
    for t in tables:
        jvm = t.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(t.written_to).getParent()
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    SparkSession.getActiveSession().sparkContext._jvm.System.gc()


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow by a function of one batch; batches are bounded in bytes, so a worker's memory is."""
    bound_batches(df.sparkSession)
    return df.mapInArrow(by_batch(fn), schema)


def bound_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) != f"{BATCH_BYTES}b":
        spark.conf.set(key, f"{BATCH_BYTES}b")


def chunks(lengths: list[int], most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Cut a batch into runs of rows of at most `most`; a longer row is alone."""
    begin = total = 0
    for i, n in enumerate(lengths):
        if i > begin and total + n > most:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(lengths):
        yield begin, len(lengths)


def text_chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, list[str]]]:
    """(first row, end, texts) of chunks of a column of strings; null is empty; a long text is alone."""
    for b, e in chunks(pc.fill_null(pc.binary_length(column), 0).to_pylist(), most):
        yield b, e, [t or "" for t in column.slice(b, e - b).to_pylist()]


def text_pieces(text: str, most: int = CHUNK_BYTES) -> Iterator[str]:
    """Cut a long text before spaces that stand between ASCII letters or digits; words, lower case and normal forms don't reach over such a space."""
    at = 0
    while len(text) - at > most:
        window = text[at + most // 2 : at + most]
        cut = max((m.start() for m in _SAFE.finditer(window)), default=-1)
        if cut < 0:
            found = _SAFE.search(text, at + most)
            if found is None:
                break
            stop = found.start() + 1
        else:
            stop = at + most // 2 + cut + 1
        yield text[at:stop]
        at = stop
    yield text[at:] if at else text


_SAFE = re.compile("[0-9A-Za-z] (?=[0-9A-Za-z])")


def by_batch(fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]):
    """A mapInArrow function from one on a single batch."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch)
        give_back()

    return run


def give_back() -> None:
    """Return free memory to the system: Spark keeps a Python worker for later tasks, and with it what its allocators hold."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = (x ^ (x >> np.uint64(32))) * MIX_C
    x = (x ^ (x >> np.uint64(29))) * MIX_A
    return x ^ (x >> np.uint64(32))


def pair(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Name of an ordered pair of 64-bit names."""
    z = (x * MIX_A + y) * MIX_B
    return z ^ (z >> np.uint64(29))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    have = _POWERS.get(int(base))
    if have is None or len(have[0]) < n:
        size = max(n, CHUNK_BYTES + 1024)
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        up, down = np.full(size, base, np.uint64), np.full(size, inverse, np.uint64)
        up[0] = down[0] = 1
        have = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if size <= 1 << 20:  # what a chunk needs; more isn't kept
            _POWERS[int(base)] = have
    return have[0][:n], have[1][:n]


class SpanHasher:
    """64-bit names of any spans of a sequence, from one pass of prefix sums."""

    def __init__(self, symbols: np.ndarray, base: np.uint64 = MIX_B):
        n = len(symbols) + 1
        up, self.down = _powers(base, n)
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(mix(symbols.astype(np.uint64) + MIX_A) * up[:-1], out=self.sums[1:])

    def __call__(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[begin]) * self.down[begin] + (end - begin).astype(np.uint64))


def gather(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Concatenation of flat[begin[i] : begin[i] + size[i]]."""
    total = int(size.sum())
    if not total:
        return flat[:0]
    at = np.cumsum(size) - size
    return flat[np.arange(total) + np.repeat(begin - at, size)]
