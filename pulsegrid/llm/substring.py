"""Substring dedup by content-defined chunks.

A gear rolling hash over the last WINDOW bytes sets chunk ends where its top bits are zero, between a least and a greatest
size, so an insertion moves only the chunks around it. Chunks are compared by digest; of equal chunks the first by (doc_id,
start) stays. A run of chunks that repeat earlier text is cut out when it is at least LEAST_RUN bytes long.

Chunks travel packed, not as rows: each task packs a batch's chunks by the shard of their digest. Repeats within a batch are
settled there and are passed on as settled, under another shard number, so a chunk that a third of all documents share costs
its shard one entry per batch. Shards are as many as the input's bytes ask for.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

WINDOW, LEAST, MOST = 16, 16, 256
#: A chunk ends at one in 2**BITS places beyond the least size.
BITS = 5
#: Bytes of repeated text in a row that are cut out; shorter runs are left as they are.
LEAST_RUN = 100
#: Bytes of text to a shard, about.
SHARD_BYTES = 16 << 20
_DIGEST = 12

#: The gear table comes from the finaliser, so it needs no list of numbers.
GEAR = (C.mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(48)).astype(np.uint16)

_PACKED = "shard long, settled boolean, digests binary, docs binary, checks binary, starts binary, sizes binary"


def gear_hashes(raw: np.ndarray) -> np.ndarray:
    """At each byte: the sum over the WINDOW bytes up to it of gear[byte] << age, modulo 2**16, by doubling."""
    h = GEAR[raw]
    span = 1
    while span < WINDOW:
        moved = np.zeros_like(h)
        moved[span:] = h[:-span] << np.uint16(span)
        h = h + moved
        span *= 2
    return h


def ends_of(raw: bytes) -> list[int]:
    """Ends of the chunks of a text, on character boundaries."""
    n = len(raw)
    if n <= LEAST:
        return [n] if n else []
    b = np.frombuffer(raw, np.uint8)
    ok = gear_hashes(b)[:-1] >> np.uint16(16 - BITS) == 0
    ok &= (b[1:] & 0xC0) != 0x80
    ends, start = [], 0
    for c in [*(np.flatnonzero(ok) + 1).tolist(), n]:
        while c - start > MOST:
            forced = start + MOST
            while forced < c and raw[forced] & 0xC0 == 0x80:
                forced += 1
            if forced >= c:
                break
            ends.append(forced)
            start = forced
        if c - start >= LEAST or c == n:
            ends.append(c)
            start = c
    return ends


def _pack(table: dict[str, np.ndarray], shard: np.ndarray, settled: bool):
    order = np.argsort(shard, kind="stable")
    at = np.flatnonzero(np.diff(shard[order], prepend=-1))
    for i, j in zip(at, [*at[1:], len(order)]):
        rows = order[i:j]
        yield (int(shard[rows[0]]), settled, *(table[k][rows].tobytes() for k in ("digests", "docs", "checks", "starts", "sizes")))


def chunk_batch(ids: list[int], texts: list[bytes]) -> dict[str, np.ndarray]:
    """All chunks of some texts as arrays; empty texts have none."""
    docs, checks, starts, sizes, digests = [], [], [], [], []
    for name, raw in zip(ids, texts, strict=True):
        ends = ends_of(raw)
        first = [0, *ends[:-1]] if ends else []
        docs.append(np.full(len(ends), name, np.int64))
        checks.append(np.full(len(ends), zlib.crc32(raw), np.uint32))
        starts.append(np.array(first, np.int32))
        sizes.append(np.array(ends, np.int32) - starts[-1])
        digests += [xxhash.xxh3_128_digest(raw[i:j])[:_DIGEST] for i, j in zip(first, ends, strict=True)]
    one = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
    return {"docs": one(docs, np.int64), "checks": one(checks, np.uint32), "starts": one(starts, np.int32), "sizes": one(sizes, np.int32), "digests": np.frombuffer(b"".join(digests), np.dtype((np.void, _DIGEST)))}


def repeats(t: dict[str, np.ndarray]) -> np.ndarray:
    """Which chunks have the digest of one that comes before, by (doc, check, start)."""
    raw = t["digests"].view(np.uint8).reshape(-1, _DIGEST)
    a, b = np.ascontiguousarray(raw[:, :8]).view("<u8")[:, 0], np.ascontiguousarray(raw[:, 8:]).view("<u4")[:, 0]
    order = np.lexsort((t["starts"], t["checks"], t["docs"], b, a))
    same = np.zeros(len(order), bool)
    same[1:] = (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1])
    out = np.zeros(len(order), bool)
    out[order] = same
    # a row that repeats id and text is the same document: its chunks are not repeats of themselves
    if same.any():
        head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
        lead = order[head]
        itself = (t["docs"][order] == t["docs"][lead]) & (t["checks"][order] == t["checks"][lead]) & (t["starts"][order] == t["starts"][lead])
        out[order[itself]] = False
    return out


def repeated_chunks(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, check, start, size) of every chunk that an earlier chunk equals; start and size in bytes."""
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63))).alias("doc_id"), F.col(text).cast("string").alias("text"))
    total = docs.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
    shards = max(1, -(-total // SHARD_BYTES))

    def pack(batches):
        for b in batches:
            t = chunk_batch(b.column(0).to_pylist(), C.byte_texts(b.column(1)))
            if not len(t["docs"]):
                continue
            again = repeats(t)
            raw = np.ascontiguousarray(t["digests"].view(np.uint8).reshape(-1, _DIGEST)[:, :4]).view("<u4")[:, 0].astype(np.int64)
            fresh, old = {k: v[~again] for k, v in t.items()}, {k: v[again] for k, v in t.items()}
            out = list(_pack(fresh, raw[~again] % shards, False))
            if again.any():
                out += _pack(old, C.mix(old["docs"].astype(np.uint64)).astype(np.int64) % shards, True)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), [pa.int64(), pa.bool_(), *[pa.binary()] * 5])], ["shard", "settled", "digests", "docs", "checks", "starts", "sizes"])

    kinds = {"docs": np.int64, "checks": np.uint32, "starts": np.int32, "sizes": np.int32, "digests": np.dtype((np.void, _DIGEST))}

    def settle(table: pa.Table) -> pa.Table:
        parts = {}
        for done in (False, True):
            some = table.filter(pa.compute.equal(table["settled"], done))
            parts[done] = {k: np.frombuffer(b"".join(some[k].to_pylist()), d) for k, d in kinds.items()}
        again = repeats(parts[False])
        both = {k: np.concatenate([parts[False][k][again], parts[True][k]]) for k in ("docs", "checks", "starts", "sizes")}
        return pa.table({"doc_id": both["docs"], "check": both["checks"].astype(np.int64), "start": both["starts"], "size": both["sizes"]})

    return rows.mapInArrow(pack, _PACKED).groupBy("shard").applyInArrow(settle, "doc_id long, check long, start int, size int")


def cut(raw: bytes, spans: list[tuple[int, int]]) -> tuple[str, list[tuple[int, int]]]:
    """The text without its runs of repeated chunks, and the byte ranges cut out."""
    runs: list[list[int]] = []
    for start, size in sorted(set(spans)):
        if runs and start <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], start + size)
        else:
            runs.append([start, start + size])
    out = [(i, j) for i, j in runs if j - i >= LEAST_RUN or j - i == len(raw)]
    kept, at = [], 0
    for i, j in out:
        kept.append(raw[at:i])
        at = j
    return b"".join([*kept, raw[at:]]).decode(), out


def substring_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with text freed of repeated passages, and removed: array of (start, length) in bytes of the old text.

    Every row stays; a text that is repeated whole becomes empty. Null texts stay null. Rows that repeat both id and text are
    one document and are cut alike; null ids come before all others. The added column is named removed (with underscores
    before it if docs has that name); other columns stay as they are. An empty table gives no rows.
    """
    removed, check, key, spans = (C.hidden(docs, n) for n in ("removed", "text_check", "doc_key", "chunk_spans"))
    found = repeated_chunks(docs, text, doc_id).groupBy("doc_id", "check").agg(F.collect_list(F.struct("start", "size")).alias(spans))
    found = found.select(F.col("doc_id").alias(key), F.col("check").alias(check), spans)
    marked = docs.withColumn(key, F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63)))).withColumn(check, F.crc32(F.coalesce(F.col(text).cast("string"), F.lit(""))))
    joined = marked.join(found, [key, check], "left").drop(key, check)
    place, at = docs.columns.index(text), len(docs.columns)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))

    def run(batches):
        for b in batches:
            some = b.column(at)
            texts, gone = b.column(place).to_pylist(), [[]] * b.num_rows
            for i in np.flatnonzero(some.is_valid().to_numpy(zero_copy_only=False)):
                if texts[i]:
                    texts[i], out = cut(texts[i].encode(), [(s["start"], s["size"]) for s in some[int(i)].as_py()])
                    gone[i] = [{"start": x, "length": y - x} for x, y in out]
            columns = [b.column(k) if k != place else pa.array(texts, pa.string()) for k in range(at)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(gone, kind)], [*b.schema.names[:at], removed])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString() if f.name != text else 'string'}" for f in docs.schema.fields)
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], spans).mapInArrow(run, f"{schema}, `{removed}` array<struct<start: int, length: int>>")


def removed_bytes(column: str = "removed") -> Column:
    return F.aggregate(F.col(column), F.lit(0).cast("long"), lambda a, x: a + x["length"])
