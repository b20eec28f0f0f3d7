"""What the text operators share: reading tables, written intermediate results, hold-out rules, hashing."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of input in one Arrow batch; very long texts then stay few to a batch.
BATCH_BYTES = "8m"
BATCH_ROWS = "2000"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Bounds the size of the batches that Python workers get."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where none is set, a local master gets one of its
    own; a cluster is an error, as a machine's own folder would lose what other machines write."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(where or tempfile.mkdtemp(prefix="pulsegrid-"))
    return context.getCheckpointDir()


#: Spark's setting that takes a query's shuffle files away when it ends, not when the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, codec: str = "zstd", clean: bool = False, by: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and outlives lost executors. clean: its shuffle files go as soon
    as it is written. by: a column whose values are read apart."""
    spark = df.sparkSession
    path, before = f"{shared_dir(spark)}/{uuid.uuid4().hex}", spark.conf.get(CLEANUP)
    if clean:
        spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path, partitionBy=by)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Takes tables of `written` away again, when everything made from them is written itself."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.written_at)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """df checkpointed; for small tables in loops."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_held: dict[str, object] = {}


def held(name: str, make: Callable[[], object]):
    """What a Python worker keeps from task to task, made once: one operator's things at a time. Workers outlive a query, so
    when another operator starts, those of the one before are dropped and their memory is given back."""
    if name not in _held:
        _held.clear()
        give_back()
        _held[name] = make()
    return _held[name]


def give_back() -> None:
    """Gives memory that this process has freed back to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def id_crc(doc_id: str | Column = "doc_id") -> Column:
    """crc32 of an id written as text; a null id counts as an empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")))


def hidden(df: DataFrame, name: str) -> str:
    """A column name that clashes with none of df's (letter case aside)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def byte_texts(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of each text; null gives b""."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def str_texts(column: pa.Array | pa.ChunkedArray) -> list[str]:
    return ["" if x is None else x for x in column.to_pylist()]


def blocks(texts: list, most: int = 1 << 20):
    """(first, end) of runs of texts with about `most` characters together: bounds what is unpacked at once."""
    first = held = 0
    for i, t in enumerate(texts):
        held += len(t) + 64
        if held >= most:
            yield first, i + 1
            first, held = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply rounds), element by element."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def list_array(values: np.ndarray, lengths, kind: pa.DataType) -> pa.Array:
    """An Arrow list array from flat values and the length of each list."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


class _Codes(dict):
    """Numbers keys as they come; the new ones wait in `new`."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = code = len(self)
        self.new.append(key)
        return code


class DistinctTable:
    """Distinct strings with an array of 32-bit integers each, found once and joined back by position.

    find gets the new strings and returns their integers in a row, and how many each has. The table is bounded: beyond `most` strings or
    `most_chars` characters it starts anew before the next block of texts.
    """

    def __init__(self, find, most: int = 300_000, most_chars: int = 6_000_000) -> None:
        self.find, self.most, self.most_chars = find, most, most_chars
        self.reset()

    def reset(self) -> None:
        self.codes, self.chars, self.used = _Codes(), 0, 0
        self.flat, self.starts, self.sizes = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def full(self) -> bool:
        return len(self.codes) > self.most or self.chars > self.most_chars

    def number(self, strings: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all strings in a row, and how many there are in each list."""
        if self.full():
            self.reset()
        counts = np.fromiter(map(len, strings), np.int64, len(strings))
        get = self.codes.__getitem__
        codes = np.fromiter(map(get, chain.from_iterable(strings)), np.int64, int(counts.sum()))
        if new := self.codes.new:
            self.codes.new = []
            first = len(self.codes) - len(new)
            values, sizes = self.find(new)
            end = self.used + len(values)
            self.flat = _room(self.flat, end)
            self.starts, self.sizes = _room(self.starts, len(self.codes)), _room(self.sizes, len(self.codes))
            self.flat[self.used : end] = values
            self.sizes[first : first + len(new)] = sizes
            self.starts[first : first + len(new)] = self.used + np.cumsum(sizes) - sizes
            self.used, self.chars = end, self.chars + sum(map(len, new))
        return codes, counts

    def gather(self, codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The integers of all strings in a row, and how many there are for each list."""
        sizes = self.sizes[codes]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(self.starts[codes] - (ends - sizes), sizes)
        at += np.arange(total)
        at_list = np.concatenate([[0], np.cumsum(counts)])
        before = np.concatenate([[0], ends])
        return self.flat[at], np.diff(before[at_list])


def _room(a: np.ndarray, n: int) -> np.ndarray:
    if n <= len(a):
        return a
    return np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)])


#: Bits of a bitmap that is sent to all tasks: 8 MB, whatever the data.
MAP_BITS = 1 << 26


def map_bit(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(MAP_BITS)) + 1  # Spark's bitmap functions number bits from 1


class Bitmap:
    """The set of bits of some values, built by Spark in at most 2048 parts of 4 KB: tells rows that cannot be wanted from
    those that may be, before they are shuffled. With very many values it lets everything pass."""

    def __init__(self, values: DataFrame, column: str) -> None:
        bits = values.select(map_bit(column).alias("bit"))
        parts = bits.groupBy(F.expr("bitmap_bucket_number(bit)").alias("part")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(bit))").alias("bits"))
        self.held = values.sparkSession.sparkContext.broadcast({r["part"]: bytes(r["bits"]) for r in parts.collect()})

    def may_hold(self, bits: pa.Array) -> np.ndarray:
        """For each value of map_bit: whether a wanted value has this bit."""
        bits = bits.to_numpy(zero_copy_only=False) - 1
        keep = np.zeros(len(bits), bool)
        part, place = bits // 32768 + 1, bits % 32768
        for p in np.unique(part):
            if (raw := self.held.value.get(int(p))) is not None:
                some = part == p
                keep[some] = (np.frombuffer(raw, np.uint8)[place[some] >> 3] >> (place[some] & 7) & 1).astype(bool)
        return keep

    def __getstate__(self):
        return self.held

    def __setstate__(self, held) -> None:
        self.held = held
