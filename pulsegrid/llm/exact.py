"""Exact dedup through a minimal perfect hash over the distinct digests of a history.

The history's distinct digests are split into shards of bounded size. A task builds one shard's hash: level after level,
a key whose position no other key shares is placed there, the rest go on to the next level; the rank of a placed key among
all set bits is its slot, so n keys fill exactly n slots. A slot holds the whole digest and the locator of the winner.
History and incoming rows are grouped apart, each by digest. A lookup of an incoming digest finds the slot and compares all
bytes: a match is a repeat of the history and takes the slot's winner and copies, everything else is a nonmember and stays a
group of its own. History that no incoming row repeats is answered from its slots.

Rows reach the index as distinct digests (combined before the shuffle), so a text that a third of all rows share is one
probe; only the last join, which gives each row its answer, sees every row, and that join is one Spark can split.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Distinct digests in a shard, about.
SHARD_KEYS = 1 << 14

_INDEX = "shard long, sizes array<long>, bits array<binary>, digests binary, winners array<struct<id: long, tie: long>>, copies array<long>"
_EMPTY = np.zeros(0, np.uint64)


# -- the hash of one shard ---------------------------------------------------------------------------------------------


def _halves(digests: bytes) -> tuple[np.ndarray, np.ndarray]:
    words = np.frombuffer(digests, "<u8").reshape(-1, 4)
    return words[:, 0], words[:, 1]


def _positions(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
    return (C.mix(a + b * np.uint64(2 * level + 1)) % np.uint64(size)).astype(np.int64)


def build_levels(digests: bytes) -> tuple[list[int], list[bytes], np.ndarray]:
    """Sizes and bit maps of the levels, and the slot of each of the distinct 32-byte digests."""
    a, b = _halves(digests)
    left, slots, sizes, maps, base = np.arange(len(a)), np.zeros(len(a), np.int64), [], [], 0
    while len(left):
        size = max(64, int(len(left) * 1.6))
        at = _positions(a[left], b[left], len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        placed = alone[at]
        slots[left[placed]] = base + np.cumsum(alone)[at[placed]] - 1
        base += int(alone.sum())
        sizes.append(size)
        maps.append(np.packbits(alone).tobytes())
        left = left[~placed]
        if len(sizes) > 200:
            raise ValueError("digests repeat in one shard")
    return sizes, maps, slots


def find_slots(sizes: list[int], maps: list[bytes], digests: bytes) -> np.ndarray:
    """The slot that each digest would have; -1 where no level has a bit for it."""
    a, b = _halves(digests)
    found, left, base = np.full(len(a), -1, np.int64), np.arange(len(a)), 0
    for level, (size, packed) in enumerate(zip(sizes, maps, strict=True)):
        if not len(left):
            break
        bits = np.unpackbits(np.frombuffer(packed, np.uint8), count=size).astype(bool)
        at = _positions(a[left], b[left], level, size)
        hit = bits[at]
        found[left[hit]] = base + np.cumsum(bits)[at[hit]] - 1
        base += int(bits.sum())
        left = left[~hit]
    return found


def _build(table: pa.Table) -> pa.Table:
    blob = b"".join(table["digest"].to_pylist())
    sizes, maps, slots = build_levels(blob)
    order = np.argsort(slots)
    ordered = np.frombuffer(blob, np.uint8).reshape(-1, 32)[order].tobytes()
    winners = table["winner"].combine_chunks().take(pa.array(order))
    copies = table["copies"].combine_chunks().take(pa.array(order))
    return pa.table({
        "shard": pa.array([table["shard"][0].as_py()], pa.int64()), "sizes": pa.array([sizes], pa.list_(pa.int64())),
        "bits": pa.array([maps], pa.list_(pa.binary())), "digests": pa.array([ordered], pa.binary()),
        "winners": pa.array([winners.to_pylist()], pa.list_(pa.struct([("id", pa.int64()), ("tie", pa.int64())]))),
        "copies": pa.array([copies.to_pylist()], pa.list_(pa.int64())),
    })


def _probe(probes: pa.Table, index: pa.Table) -> pa.Table:
    """One row for each probe, with winner and copies of its slot if it is a member, and one for each slot not asked for."""
    n = probes.num_rows
    row = index.to_pylist()[0] if index.num_rows else None
    winners, copies, digests = [None] * n, [0] * n, probes["digest"].to_pylist() if n else []
    asked_for = np.zeros(len(row["copies"]) if row else 0, bool)
    if n and row:
        blob = b"".join(digests)
        slots = find_slots(row["sizes"], row["bits"], blob)
        held = np.frombuffer(row["digests"], np.uint8).reshape(-1, 32)
        asked = np.frombuffer(blob, np.uint8).reshape(-1, 32)
        at = np.flatnonzero(slots >= 0)
        same = (held[slots[at]] == asked[at]).all(axis=1)
        for i in at[same]:
            winners[i], copies[i] = row["winners"][slots[i]], row["copies"][slots[i]]
        asked_for[slots[at[same]]] = True
    alone = np.flatnonzero(~asked_for).tolist()
    kind = pa.struct([("id", pa.int64()), ("tie", pa.int64())])
    newest = probes["newest"].to_pylist() if n else []
    fresh = probes["fresh"].to_pylist() if n else []
    return pa.table({
        "digest": pa.array(digests + [row["digests"][32 * i : 32 * i + 32] for i in alone], pa.binary()),
        "newest": pa.array(newest + [None] * len(alone), kind), "fresh": pa.array(fresh + [0] * len(alone), pa.int64()),
        "winner": pa.array(winners + [row["winners"][i] for i in alone], kind), "copies": pa.array(copies + [row["copies"][i] for i in alone], pa.int64()),
    })


# -- Spark -------------------------------------------------------------------------------------------------------------


def text_digests(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", tie: str | None = None) -> DataFrame:
    """(doc_id, tie, digest): SHA-256 of each whole text after lower-casing A-Z only; null counts as an empty text.

    tie numbers the rows, so that rows that repeat both text and id can be told apart: a column of docs, or made here."""

    def digest(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([hashlib.sha256(t.lower()).digest() for t in C.byte_texts(b.column(2))], pa.binary())], ["doc_id", "tie", "digest"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), (F.col(tie) if tie else F.monotonically_increasing_id()).alias("tie"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(digest, "doc_id long, tie long, digest binary")


def build_index(groups: DataFrame, shards: int) -> DataFrame:
    """One row per shard: its minimal perfect hash, slots and all. groups: (digest, winner, copies), digests distinct."""
    return groups.withColumn("shard", _shard(shards)).groupBy("shard").applyInArrow(_build, _INDEX)


def lookup(probes: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """Distinct probes (digest, newest, fresh) with winner and copies of their slots (null and 0 for nonmembers), and the slots
    that no probe asks for, whose newest is null and fresh 0."""
    asked = probes.withColumn("shard", _shard(shards))
    kind = "digest binary, newest struct<id: long, tie: long>, fresh long, winner struct<id: long, tie: long>, copies long"
    return asked.groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(_probe, kind)


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(shards))


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", in_history: Column | None = None, tie: str | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, in_history_index, text_sha256, tie.

    in_history: a condition on doc_id that marks the rows whose digests form the index (all of them by default); the other
    rows come in against it: members take their slot's winner into account, nonmembers form groups of their own. Of equal
    texts, the row with the largest doc_id stays (null ids come last); of rows that repeat both, one stays. Null texts equal
    empty ones. An empty table gives an empty result; further columns are not looked at. tie: a column that numbers the rows;
    without it they are numbered here, once, and the numbers in the result are those.
    """
    marked = C.written(text_digests(docs, text, doc_id, tie).withColumn("old", F.lit(True) if in_history is None else F.coalesce(in_history, F.lit(True))))
    where = F.struct(F.col("doc_id").alias("id"), "tie")
    history = C.written(marked.where("old").groupBy("digest").agg(F.max(where).alias("winner"), F.count("*").alias("copies")))
    incoming = marked.where("not old").groupBy("digest").agg(F.max(where).alias("newest"), F.count("*").alias("fresh"))
    # not more shards than both kinds of keys need
    shards = max(1, -(-max(history.count(), marked.where("not old").count()) // SHARD_KEYS))
    answers = lookup(incoming, build_index(history, shards), shards)
    larger = F.when(F.col("winner").isNull(), F.col("newest")).when(F.col("newest").isNull(), F.col("winner"))
    larger = larger.otherwise(F.greatest(F.col("winner"), F.col("newest")))
    best = answers.select("digest", F.col("winner").isNotNull().alias("member"), larger.alias("best"), (F.col("copies") + F.col("fresh")).alias("group_size"))
    out = marked.join(best, "digest")
    kept = F.col("tie") == F.col("best.tie")
    return out.select("doc_id", F.col("best.id").alias("keep_id"), "group_size", kept.alias("kept"), F.col("member").alias("in_history_index"), F.lower(F.hex("digest")).alias("text_sha256"), "tie")


def older_half(docs: DataFrame, doc_id: str = "doc_id") -> Column:
    """A condition for the ids up to the middle of the range of ids: the rows that stand for the history."""
    low, high = docs.agg(F.min(doc_id), F.max(doc_id)).first()
    return F.lit(True) if low is None else F.col("doc_id") <= F.lit(low + (high - low) // 2)


def drop_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs that stay, with the columns of docs: of equal texts the row with the largest id, as in exact_dedup.

    Rows are numbered once, in a written table, so that input which comes in another order when it is read again loses
    nothing. Null texts equal empty ones; an empty table gives no rows; further columns, clashing or not, stay as they are.
    """
    at = C.hidden(docs, "row_at")
    numbered = C.written(docs.withColumn(at, F.monotonically_increasing_id()))
    stay = exact_dedup(numbered, text, doc_id, older_half(numbered, doc_id), at).where("kept").select(F.col("tie").alias(at))
    return numbered.join(stay, at, "left_semi").drop(at)
