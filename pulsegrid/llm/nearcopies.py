"""Near-duplicate documents by ProbMinHash over weighted five-word shingles, banding and exact verification.

A shingle of weight w sends arrivals of a Poisson process of rate w, each to a random register; a register keeps the shingle
that arrives first. Arrivals come in rounds for all texts of a batch, and a shingle is given up once its time is past the
latest register of its text. Two texts agree in a register with probability J_P, their probability Jaccard similarity.

Texts with equal words are one class from the start. Classes that agree in all registers of a band share a bucket:
1. In each bucket every member is compared with a head picked by hash; the links make components.
2. A bucket whose members are then in several components is cut into blocks; those outside its largest component go to all
   of its blocks and are compared: members of different components, each pair in the first bucket, by key, that it shares. The sum of sqrt(p q) over shingles is never less than J_P, so
   one matrix product rules out most pairs of two blocks; the rest is computed exactly, but for pairs that this pair of
   blocks has linked already. Only links leave the tasks, never pairs.
No pair in a bucket that could reach the threshold goes without a comparison, unless it is connected already.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .graph import components

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 20, 5
REGISTERS = BANDS * ROWS

_word = re.compile(r"\w+")
_STEP = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h




def words_of(text: str) -> list[str]:
    return _word.findall(text.lower())


def shingles(lists: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of the texts in a row, their counts, and how many each text has.

    A text of fewer than five words is one shingle, a text without words has none."""
    hashes = C.held("word hashes", _Hashes)
    if len(hashes) > 200_000:
        hashes.clear()
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    words = np.fromiter((h for ws in lists for h in map(hashes.__getitem__, ws)), np.uint64, int(counts.sum()))
    n = np.where(counts >= SHINGLE, counts - SHINGLE + 1, (counts > 0).astype(np.int64))
    first = np.cumsum(counts) - counts
    starts = np.repeat(first, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    room = np.repeat(first + counts, n) - starts
    padded = np.concatenate([words, np.zeros(SHINGLE, np.uint64)])
    h = np.zeros(len(starts), np.uint64)
    for k in range(SHINGLE):
        h = h * np.uint64(0x100000001B3) + np.where(room > k, padded[starts + k], 0).astype(np.uint64)
    h = C.mix(h)
    at = np.cumsum(n) - n
    for i, k in zip(at.tolist(), n.tolist()):
        if k > 1:
            h[i : i + k].sort()
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    new[at[n > 0]] = True
    places = np.flatnonzero(new)
    weights = np.diff(np.append(places, len(h)))
    distinct = np.add.reduceat(new.astype(np.int64), at[n > 0]) if len(h) else np.zeros(0, np.int64)
    sizes = np.zeros(len(lists), np.int64)
    sizes[n > 0] = distinct
    return h[places], weights, sizes


def registers(elements: np.ndarray, weights: np.ndarray, sizes: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """The shingle in each of m registers, for each text; texts without shingles have zeros."""
    texts = len(sizes)
    best, held = np.full(texts * m, np.inf), np.zeros(texts * m, np.uint64)
    doc = np.repeat(np.arange(texts), sizes)
    x, el, w = np.zeros(len(elements)), elements, weights.astype(np.float64)
    round_ = 0
    while len(el):
        round_ += 1
        u = C.mix(el + np.uint64(round_ * int(_STEP) & 0xFFFFFFFFFFFFFFFF))
        x = x - np.log1p(-(u >> np.uint64(11)).astype(np.float64) * 2.0**-53) / w
        slot = doc * m + (((u & np.uint64(0xFFFFF)) * np.uint64(m)) >> np.uint64(20)).astype(np.int64)
        np.minimum.at(best, slot, x)
        won = x == best[slot]
        held[slot[won]] = el[won]
        open_docs = np.unique(doc)
        latest = np.full(texts, -1.0)
        latest[open_docs] = best.reshape(texts, m)[open_docs].max(axis=1)
        alive = x < latest[doc]
        x, el, w, doc = x[alive], el[alive], w[alive], doc[alive]
    return held.reshape(texts, m)


def bands(held: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each text."""
    rows = held.reshape(len(held), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(held), BANDS)).copy()
    for k in range(ROWS):
        key = C.mix(key * np.uint64(0x100000001B3) + rows[:, :, k])
    return key.view(np.int64)


def similarity(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """J_P of two texts from sorted distinct shingles and their counts; 0 if either has none."""
    if not len(a) or not len(b):
        return 0.0
    i = np.minimum(np.searchsorted(a, b), len(a) - 1)
    shared = a[i] == b
    x, y = wa[i[shared]].astype(np.float64), wb[shared].astype(np.float64)
    if not len(x):
        return 0.0
    only_a, only_b = wa.sum() - x.sum(), wb.sum() - y.sum()
    order = np.argsort(-x / y, kind="stable")
    x, y = x[order], y[order]
    # for a shared shingle d: those with a larger ratio count by their weight in a, the others by that in b
    larger, rest = np.cumsum(x), y.sum() - np.cumsum(y)
    return float((1 / ((only_a + larger) / x + (only_b + rest) / y)).sum())


# -- Spark -------------------------------------------------------------------------------------------------------------


def signatures(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, words: digest of a text's words, bands). A text without words has no bands, and its own bytes' digest."""

    def run(batches):
        for b in batches:
            texts = C.str_texts(b.column(1))
            small, made = [], {}
            for i, j in C.blocks(texts):
                lists = [words_of(t) for t in texts[i:j]]
                for k, ws in zip(range(i, j), lists, strict=True):
                    made[k] = [xxhash.xxh3_128_digest(" ".join(ws)) if ws else xxhash.xxh3_128_digest("\0" + texts[k]), []]
                # short texts take many rounds, so a batch's are done together
                small += [(k, ws) for k, ws in zip(range(i, j), lists, strict=True) if 0 < len(ws) < 64]
                large = [(k, ws) for k, ws in zip(range(i, j), lists, strict=True) if len(ws) >= 64]
                _sign(large, made)
            _sign(small, made)
            rows = [made[k] for k in range(len(texts))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.list_(pa.int64()))], ["doc_id", "words", "bands"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, words binary, bands array<long>")


def _sign(some: list[tuple[int, list[str]]], made: dict[int, list]) -> None:
    if some:
        keys = bands(registers(*shingles([ws for _, ws in some])))
        for (k, _), row in zip(some, keys, strict=True):
            made[k][1] = row


def weighted_shingles(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, shingles, weights) of the wanted nodes from (node, text): sorted 64-bit hashes and 32-bit counts, as bytes.

    A bitmap keeps most other texts from being looked at, and from the shuffle."""
    wanted_bits = C.Bitmap(wanted, "node")

    def run(batches):
        for b in batches:
            some = b.filter(pa.array(wanted_bits.may_hold(b.column(2))))
            texts = C.str_texts(some.column(1))
            for i, j in C.blocks(texts):
                h, w, n = shingles([words_of(t) for t in texts[i:j]])
                ends = np.cumsum(n)
                cut = lambda a, s: [a[x - y : x].tobytes() for x, y in zip(ends, s, strict=True)]
                yield pa.RecordBatch.from_arrays([some.column(0).slice(i, j - i), pa.array(cut(h, n), pa.binary()), pa.array(cut(w.astype(np.int32), n), pa.binary())], ["node", "shingles", "weights"])

    likely = docs.withColumn("bit", C.map_bit("node")).mapInArrow(run, "node long, shingles binary, weights binary")
    return likely.join(wanted, "node", "left_semi")


def compare(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """(a, b, sim) with the exact similarity of each pair of nodes."""

    def run(batches):
        for t in batches:
            a, wa, b, wb = (t.column(i).to_pylist() for i in range(2, 6))
            sims = [similarity(np.frombuffer(p, np.uint64), np.frombuffer(q, np.int32), np.frombuffer(r, np.uint64), np.frombuffer(s, np.int32)) for p, q, r, s in zip(a, wa, b, wb, strict=True)]
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1), pa.array(sims, pa.float64())], ["a", "b", "sim"])

    left = table.select(F.col("node").alias("a"), F.col("shingles").alias("sa"), F.col("weights").alias("wa"))
    right = table.select(F.col("node").alias("b"), F.col("shingles").alias("sb"), F.col("weights").alias("wb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "wa", "sb", "wb").mapInArrow(run, "a long, b long, sim double")


class _Groups:
    """Which of some numbered things are linked so far."""

    def __init__(self, first: list) -> None:
        numbers = {x: i for i, x in enumerate(dict.fromkeys(first))}
        self.of, self.up = [numbers[x] for x in first], list(range(len(numbers)))

    def find(self, i: int) -> int:
        x = self.of[i]
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def link(self, i: int, j: int) -> None:
        self.up[self.find(i)] = self.find(j)


def bounds(left: list[tuple[np.ndarray, np.ndarray]], right: list[tuple[np.ndarray, np.ndarray]], columns: int = 4096) -> np.ndarray:
    """For each pair of texts the sum of sqrt(p q) over shared shingles: at least J_P."""
    def flat(some):
        h = np.concatenate([h for h, _ in some])
        v = np.concatenate([np.sqrt(w / max(1, w.sum())) for _, w in some]).astype(np.float32)
        return h, v, np.repeat(np.arange(len(some)), [len(h) for h, _ in some])

    (ha, va, oa), (hb, vb, ob) = flat(left), flat(right)
    shared = np.intersect1d(ha, hb)
    out = np.zeros((len(left), len(right)), np.float32)
    if not len(shared):
        return out
    ia, ib = np.searchsorted(shared, ha), np.searchsorted(shared, hb)
    ia[ia == len(shared)] = ib[ib == len(shared)] = 0
    ka, kb = shared[ia] == ha, shared[ib] == hb
    for c in range(0, len(shared), columns):
        parts = []
        for i, k, v, o, n in ((ia, ka, va, oa, len(left)), (ib, kb, vb, ob, len(right))):
            here = k & (i >= c) & (i < c + columns)
            m = np.zeros((n, min(columns, len(shared) - c)), np.float32)
            m[o[here], i[here] - c] = v[here]
            parts.append(m)
        out += parts[0] @ parts[1].T
    return out


def links(rows: list[dict], threshold: float) -> list[tuple[int, int]]:
    """Links in one pair of blocks: side 0 against side 1, or side 2 within itself."""
    texts = [(np.frombuffer(r["shingles"], np.uint64), np.frombuffer(r["weights"], np.int32)) for r in rows]
    sides = np.array([r["side"] for r in rows])
    left, right = (np.flatnonzero(sides == 2),) * 2 if (sides == 2).any() else (np.flatnonzero(sides == 0), np.flatnonzero(sides == 1))
    if not len(left) or not len(right):
        return []
    may = bounds([texts[i] for i in left], [texts[i] for i in right]) >= threshold - 1e-3
    groups, out, keys = _Groups([r["label"] for r in rows]), [], [set(r["bands"]) for r in rows]
    for x, y in zip(*np.nonzero(may)):
        i, j = int(left[x]), int(right[y])
        if (left is right and i >= j) or groups.find(i) == groups.find(j):
            continue
        if min(keys[i] & keys[j]) != rows[i]["key"]:
            continue
        if similarity(*texts[i], *texts[j]) >= threshold:
            groups.link(i, j)
            out.append((rows[i]["node"], rows[j]["node"]))
    return out


#: Members of a bucket in a block, about, and rows that one call of the block comparison gets, about.
BLOCK, PART = 256, 2000


def links_across(members: DataFrame, table: DataFrame, threshold: float) -> DataFrame:
    """(u, v): links between members (key, node, label, bands) of one bucket with different labels.

    The members of a bucket's largest component need no comparison with each other: they lie in one block each, and only the
    other members go to all of these blocks, and to pairs of blocks among themselves."""
    sizes = members.groupBy("key", "label").agg(F.count("*").alias("of_label"))
    largest = sizes.groupBy("key").agg(F.max(F.struct("of_label", "label")).alias("top"), F.sum("of_label").alias("n"))
    rows = members.drop("n").join(largest.select("key", "n", F.col("top.of_label").alias("inside"), F.col("top.label").alias("top")), "key")
    rows = rows.withColumn("outer", F.col("label") != F.col("top"))
    blocks = F.greatest(F.lit(1), F.ceil(F.when(F.col("outer"), F.col("n") - F.col("inside")).otherwise(F.col("inside")) / BLOCK)).cast("int")
    rows = rows.withColumn("inner_blocks", F.ceil(F.col("inside") / BLOCK).cast("int")).withColumn("blocks", blocks)
    rows = C.written(rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")))
    seat = lambda low, high, side: F.struct(low.cast("int").alias("low"), high.cast("int").alias("high"), side.cast("int").alias("side"))
    # blocks of the largest component have a high of -1
    across = F.transform(F.sequence(F.lit(0), F.col("inner_blocks") - 1), lambda j: seat(j, F.lit(-1), F.lit(1)))
    among = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: seat(F.least("block", j), F.greatest("block", j), F.when(F.col("block") == j, 2).when(F.col("block") < j, 0).otherwise(1)))
    seats = F.when(F.col("outer"), F.concat(across, among)).otherwise(F.array(seat(F.col("block"), F.lit(-1), F.lit(0))))
    count = rows.agg(F.sum(F.size(seats))).first()[0] or 0
    rows = rows.withColumn("seat", F.explode(seats)).select("key", "node", "label", "bands", "seat.*")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("key", "low", "high"), F.lit(max(1, -(-count // PART)))))

    def run(group: pa.Table) -> pa.Table:
        by: dict[tuple, list[dict]] = {}
        for r in group.to_pylist():
            by.setdefault((r["key"], r["low"], r["high"]), []).append(r)
        found = [x for rows_ in by.values() for x in links(rows_, threshold)]
        return pa.table({"u": pa.array([u for u, _ in found], pa.int64()), "v": pa.array([v for _, v in found], pa.int64())})

    return rows.join(table, "node").groupBy("part").applyInArrow(run, "u long, v long")


def near_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, class_id, text_class.

    text_class is the smallest id with the same words, class_id the smallest id in the component of classes with J_P of at
    least the threshold. Null texts count as empty; texts without words are alike only if they are equal. Rows with one id
    are one document, so all their texts fall in one class; a null id has no links of its own. Rows keep their multiplicity,
    further columns are not looked at, an empty table gives no rows.
    """
    signed = C.written(signatures(docs, text, doc_id))
    classes = signed.groupBy("words").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands"))
    rows = classes.where("node is not null").select("node", F.explode("bands").alias("key"))
    head = F.min(F.struct(F.xxhash64("node", "key").alias("h"), "node"))["node"]
    heads = rows.groupBy("key").agg(head.alias("head"), F.count("*").alias("n")).where("n > 1")
    members = C.written(rows.join(heads, "key"))

    texts = docs.select(F.col(doc_id).cast("long").alias("node"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    table = C.written(weighted_shingles(texts, members.select("node").distinct()))
    with_heads = members.where("node <> head").select(F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b")).distinct()
    edges = C.written(compare(with_heads, table).where(F.col("sim") >= threshold).select(F.col("a").alias("u"), F.col("b").alias("v")))
    labels = components(edges)

    found = members.join(labels.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select("key", "node", "n", F.coalesce("label", "node").alias("label"))
    mixed = found.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
    # two members have been compared already, one of them being the head
    left = C.written(found.where("n > 2").join(mixed, "key"))
    in_left = left.select("node").distinct()
    keys = members.join(in_left, "node", "left_semi").groupBy("node").agg(F.collect_list("key").alias("bands"))
    more = C.written(links_across(left.join(keys, "node"), table.join(in_left, "node", "left_semi"), threshold))
    final = components(edges.unionByName(more))

    named = classes.select("words", "node").join(final.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left")
    named = named.select("words", F.col("node").alias("text_class"), F.coalesce("label", "node").alias("class_id"))
    return signed.select("doc_id", "words").join(named, "words").select("doc_id", "class_id", "text_class")


def drop_near_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs whose id is the smallest of their class, and rows that belong to no class; columns as in docs."""
    key = C.hidden(docs, "near_copy_of")
    gone = near_copies(docs, text, doc_id).where("class_id <> doc_id").select(F.col("doc_id").alias(key)).distinct()
    return docs.join(gone, F.col(doc_id).cast("long") == F.col(key), "left_anti")
