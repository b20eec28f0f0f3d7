"""Document fingerprints: quartile digests of hashed byte triplets.

Every three consecutive bytes of a text are hashed into one of 128 buckets. A bucket's count is written as its quartile
among all counts (two bits), the length as a step of a logarithmic scale, and both make the digest. Two digests differ by the
distances of their quartiles and of their length steps, each bounded, and likeness is 1 less the share of the greatest
difference. Digests depend on the text alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

BUCKETS = 128
#: Length steps count for at most so much of the difference.
LENGTH_MOST = 24
#: Documents in a block of neighbours, about, and the most blocks: the table of block heads stays under 2 MB.
BLOCK = 1024
BLOCKS_MOST = 65_536
#: Ids to a block, about, in the sample that gives the bounds of blocks; what stands for a null id.
SAMPLED = 32
NULL_ID = -(1 << 63)

_WORST = 3 * BUCKETS + LENGTH_MOST


def digest(raw: bytes) -> str:
    """Two hex digits for the length, then the quartile codes of all buckets, four to a byte."""
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    n = len(b)
    step = 0 if n == 0 else min(255, 1 + int(np.log(n) / np.log(1.1)))
    if n < 3:
        counts = np.bincount(((np.concatenate([b, np.zeros(3 - n, np.uint32)]) * np.uint32(2654435761)) >> np.uint32(25)).astype(np.int64), minlength=BUCKETS) * (n > 0)
    else:
        h = b[:-2] * np.uint32(2654435761) + b[1:-1] * np.uint32(2246822519) + b[2:] * np.uint32(3266489917)
        h ^= h >> np.uint32(15)
        h *= np.uint32(668265263)
        counts = np.bincount((h >> np.uint32(25)).astype(np.int64), minlength=BUCKETS)
    ordered = np.sort(counts)
    cuts = ordered[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    codes = np.searchsorted(cuts, counts, side="left").astype(np.uint8)
    four = codes.reshape(-1, 4)
    packed = four[:, 0] << 6 | four[:, 1] << 4 | four[:, 2] << 2 | four[:, 3]
    return f"{step:02x}" + packed.tobytes().hex()


def _unpack(digests: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(bytes.fromhex("".join(digests)), np.uint8).reshape(len(digests), -1)
    codes = np.stack([raw[:, 1:] >> s & 3 for s in (6, 4, 2, 0)], axis=-1).reshape(len(digests), -1)
    return raw[:, 0].astype(np.int16), codes.astype(np.int16)


def likeness(left: list[str], right: list[str]) -> np.ndarray:
    """1 for equal digests down to 0 for the greatest difference, pair by pair."""
    if not left:
        return np.zeros(0)
    (sa, a), (sb, b) = _unpack(left), _unpack(right)
    return 1 - (abs(a - b).sum(axis=1) + np.minimum(abs(sa - sb), LENGTH_MOST)) / _WORST


def block_bounds(ids: DataFrame) -> np.ndarray:
    """The greatest doc_id of each block but the last: quantiles of a sample of the ids, chosen by hash, of about SAMPLED for each block.

    Blocks hold about BLOCK rows however ids are spread; the bounds are at most BLOCKS_MOST numbers."""
    n = ids.count()
    blocks = max(1, min(BLOCKS_MOST, n // BLOCK))
    share = min(1.0, blocks * SAMPLED / max(1, n))
    some = ids.where(F.col("doc_id").isNotNull() & (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))))
    found = np.sort(np.array([r[0] for r in some.distinct().collect()], np.int64))
    return np.unique(found[np.linspace(0, len(found), blocks, endpoint=False).astype(int)[1:]]) if len(found) else found


def fingerprint(docs: DataFrame, bounds: np.ndarray, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, text, fingerprint, block) of each whole text; null counts as empty, and a null id as the smallest."""
    shipped = docs.sparkSession.sparkContext.broadcast(bounds)  # bounded: BLOCKS_MOST numbers

    def run(batches):
        for b in batches:
            ids = b.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False)
            block = np.searchsorted(shipped.value, ids)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([digest(t) for t in C.byte_texts(b.column(1))], pa.string()), pa.array(block, pa.int64())], ["doc_id", "text", "fingerprint", "block"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, text string, fingerprint string, block long")


def with_next(rows: DataFrame, ids: DataFrame, bounds: np.ndarray, carried: list[str]) -> DataFrame:
    """rows (doc_id, block and the carried columns) with next_<column> of the following row by descending doc_id; after the
    last comes the first.

    So that no block needs another's rows, the first row of each block goes to the block above it as well (a guest, dropped
    again): one shuffle. ids: the same rows' doc_id alone, to find the block heads, of which there are at most BLOCKS_MOST, so
    broadcasting them is bounded. Rows with equal ids share a block and follow one another in the order of the carried columns;
    a null id counts as the smallest.
    """
    at = F.coalesce(F.col("doc_id"), F.lit(NULL_ID))
    block = ids.select(at.alias("at")).mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([b.column(0), pa.array(np.searchsorted(bounds, b.column(0).to_numpy(zero_copy_only=False)), pa.int64())], ["at", "block"]) for b in batches), "at long, block long")
    heads = block.groupBy("block").agg(F.max("at").alias("head"))
    order = Window.orderBy(F.desc("block"))  # over the heads alone
    heads = heads.select("head", F.coalesce(F.lag("block").over(order), F.min("block").over(Window.partitionBy())).alias("host"))
    tied = [F.desc_nulls_last("doc_id"), *[F.asc(c) for c in carried]]
    # one guest row a block: only the first of rows that share the head's id would do, so all of them come
    guests = rows.withColumn("at", at).withColumnRenamed("block", "own").join(F.broadcast(heads), F.col("at") == F.col("head"), "left")
    mine = F.struct(F.col("own").alias("block"), F.lit(0).alias("guest"))
    placed = guests.withColumn("seat", F.explode(F.when(F.col("host").isNull(), F.array(mine)).otherwise(F.array(mine, F.struct(F.col("host").alias("block"), F.lit(1).alias("guest"))))))
    w = Window.partitionBy("seat.block").orderBy("seat.guest", *tied)
    out = placed.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in carried])
    return out.where("seat.guest = 0").drop("seat", "at", "own", "head", "host")


def neighbours(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Each document's digest, that of its edited text, and how alike they are.

    The edited text replaces the last floor(n/2) code points by as many first ones (or all) of the next document. Returns
    doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next. A single document follows itself. Null
    texts count as empty, null ids come last, rows with equal ids go by their texts; repeated rows stay. An empty table gives
    no rows; further columns are not looked at, whatever their names.
    """

    def run(batches):
        for b in batches:
            mine, after = b.column(3).to_pylist(), b.column(4).to_pylist()
            edited = [digest(t) for t in C.byte_texts(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), pa.array(edited, pa.string()), pa.array(likeness(mine, edited)), pa.array(likeness(mine, after))], ["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    ids = docs.select(F.col(doc_id).cast("long").alias("doc_id"))
    bounds = block_bounds(ids)
    rows = with_next(fingerprint(docs, bounds, text, doc_id), ids, bounds, ["text", "fingerprint"])
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "fingerprint", F.col("next_fingerprint").alias("after"))
    return rows.mapInArrow(run, "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
