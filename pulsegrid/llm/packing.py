"""Packing documents into training windows by non-negative least squares over a length histogram.

Documents longer than the window give whole windows and a rest. Lengths are rounded up to units; every combination of up to
DEPTH rounded lengths that fills the window exactly is a column, the histogram of rounded lengths the right-hand side. The
non-negative solution, rounded down, says how often each combination is used. Pieces get a rank within their length and so
a place in a combination; what is left over is packed greedily (best fit, longest first) in blocks of bounded size.

The driver handles only the histogram and the plan, both bounded by the window, never by the data.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

WINDOW = 2048
UNIT = 8
DEPTH = 3
END = 1
#: Pieces of one length that are ranked together, about, so that a common length is not one task's work.
RANKED = 1024
#: Pieces in a block of the greedy part, about.
BLOCK = 4096

# -- tokens ------------------------------------------------------------------------------------------------------------

#: Fixed values of the tokenizer file: its pattern, what its normaliser would treat unlike str.split, and its specials.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_CONTROL = re.compile("[\x00\x1c-\x1f]")
_SPECIALS = ("<|startoftext|>", "<|endoftext|>")


def _is_odd(text: str) -> bool:
    return bool(_CONTROL.search(text)) or any(s in text for s in _SPECIALS)


class WordEncoder:
    """Token ids as the tokenizer file gives them, word by word.

    White space separates words and a word's ids depend on nothing else, so distinct words are tokenized once. Words with
    characters that this Python's Unicode tables do not have, and texts with special tokens or control characters, go to the
    tokenizers library, whose tables may know them."""

    def __init__(self, path: str) -> None:
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.split = regex.compile(" |" + _PATTERN).findall
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, merges = model["vocab"], [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        to_byte = {char: byte for byte, char in _byte_chars().items()}

        def raw(token: str) -> bytes:
            stem = token.removesuffix("</w>")
            return bytes(to_byte[c] for c in stem) + b"\0" * (stem != token)

        # the end of a word is written as a zero byte, which joins its last byte before all merges
        singles = [bytes([i]) for i in range(256)]
        ranks, ids = {b: i for i, b in enumerate(singles)}, [vocab[_byte_chars()[i]] for i in range(256)]
        for token in (_byte_chars()[i] + "</w>" for i in range(256)):
            ranks[raw(token)] = len(ids)
            ids.append(vocab[token])
        for left, right in merges:
            if (key := raw(left + right)) not in ranks:
                ranks[key] = len(ids)
                ids.append(vocab[left + right])
        self.ids = np.array(ids, np.int32)
        self.space = ranks[b" \0"]
        self.words = tiktoken.Encoding("words", pat_str="[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})
        self.table = C.DistinctTable(self.tokenize)

    def tokenize(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and how many each word has."""
        if not words:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        unknown = {c for c in set("".join(words)) if unicodedata.category(c) == "Cn"}
        if unknown:
            odd = [i for i, w in enumerate(words) if not unknown.isdisjoint(w)]
            said = self.library.encode_batch([words[i] for i in odd], add_special_tokens=False)
            at = {i: np.array(e.ids, np.int32) for i, e in zip(odd, said)}
            ids, sizes = self.tokenize([w for i, w in enumerate(words) if i not in at])
            rest = iter(np.split(ids, np.cumsum(sizes)[:-1]))
            found = [at[i] if i in at else next(rest) for i in range(len(words))]
            return np.concatenate(found), np.fromiter(map(len, found), np.int64, len(found))
        # no word holds a space, so a space after each word keeps them apart
        parts = self.split(unicodedata.normalize("NFC", " ".join(words) + " ").replace("Σ", "σ").lower())
        got = np.array(self.words.encode_ordinary("\0".join(parts) + "\0"), np.int64)
        between = got == self.space
        ends = np.flatnonzero(between)
        return self.ids[got[~between]], np.diff(ends, prepend=-1) - 1

    def run(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        odd = [i for i, t in enumerate(texts) if _is_odd(t)]
        plain = [t.split() for t in texts]
        for i in odd:
            plain[i] = []
        ids, sizes = self.table.gather(*self.table.number(plain))
        out = np.split(ids, np.cumsum(sizes)[:-1])
        for i in odd:
            out[i] = np.array(self.library.encode(texts[i], add_special_tokens=False).ids, np.int32)
        return out


def _byte_chars() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def encoder(path: str) -> WordEncoder:
    return C.held(f"words {path}", lambda: WordEncoder(path))


_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Each document's ids (and id 1 at the end), cut into whole windows and a rest: one row per piece."""

    def run(batches):
        words = encoder(tokenizer)
        for b in batches:
            texts, names = C.str_texts(b.column(1)), b.column(0).to_pylist()
            rows = []
            for i, j in C.blocks(texts):
                for name, ids in zip(names[i:j], words.run(texts[i:j]), strict=True):
                    raw, n = np.append(ids, np.int32(END)).astype("<u4").tobytes(), len(ids) + 1
                    rows += [(name, s, min(window, n - s), zlib.crc32(raw[4 * s : 4 * (s + window)]), n) for s in range(0, n, window)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, _PIECE)


# -- the plan ----------------------------------------------------------------------------------------------------------


def combinations(units: int, depth: int, present: list[int]) -> list[tuple[int, ...]]:
    """All ways to write `units` as a sum of up to `depth` of the present lengths, longest first."""
    have = sorted(present)

    def grow(left: int, most: int, deep: int):
        if left == 0:
            yield ()
        elif deep:
            for n in have:
                if n > min(left, most):
                    break
                if n * deep >= left:
                    for rest in grow(left - n, n, deep - 1):
                        yield (n, *rest)

    return list(grow(units, units, depth))


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """x >= 0 with the least |a x - b|, by the active-set method. Of the product of all columns with each other only that of
    the active ones is made: all have the square of the combinations' number, a quarter of a gigabyte."""
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    right = a.T @ b
    for _ in range(rounds):
        slope = np.where(active, -np.inf, right - a.T @ (a @ x))
        if not len(slope) or slope.max() <= 1e-7 * max(1.0, abs(right).max()):
            break
        active[slope.argmax()] = True
        while True:
            at = np.flatnonzero(active)
            own = a[:, at]
            z = np.linalg.lstsq(own.T @ own, right[at], rcond=None)[0]
            if (z > 1e-12).all():
                x[:] = 0
                x[at] = z
                break
            bad = z <= 1e-12
            step = min(1.0, (x[at][bad] / np.maximum(x[at][bad] - z[bad], 1e-300)).min())
            x[at] += step * (z - x[at])
            active[at[x[at] <= 1e-12]] = False
            x[~active] = 0
            if not active.any():
                break
    return x


def plan(histogram: dict[int, int], units: int, depth: int = DEPTH) -> list[tuple[tuple[int, ...], int]]:
    """Combinations and how often each is used: the rounded solution, never more than the histogram holds."""
    full = histogram.get(units, 0)
    ways = combinations(units, depth, [n for n, c in histogram.items() if c and n < units])
    chosen = [((units,), full)] if full else []
    if ways:
        lengths = sorted({n for w in ways for n in w})
        a = np.zeros((len(lengths), len(ways)))
        for k, w in enumerate(ways):
            for n in w:
                a[lengths.index(n), k] += 1
        x = nnls(a, np.array([histogram[n] for n in lengths], float))
        left = dict(histogram)
        for k in np.argsort(-x):
            times = int(min([x[k] + 1e-9, *(left[n] // ways[k].count(n) for n in ways[k])]))
            if times > 0:
                chosen.append((ways[k], times))
                for n in ways[k]:
                    left[n] -= times
    return chosen


def best_fit(lengths: list[int], window: int) -> tuple[list[int], list[int]]:
    """Sequence and offset of each piece: longest first, each into the fullest open sequence that has room."""
    rooms: list[int] = []
    open_by_room: dict[int, list[int]] = {}
    where, offsets, used = [0] * len(lengths), [0] * len(lengths), 0
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        k = bisect_left(rooms, n)
        if k == len(rooms):
            seq, room, used = used, window, used + 1
        else:
            room = rooms[k]
            seq = open_by_room[room].pop()
            if not open_by_room[room]:
                del rooms[k]
        where[i], offsets[i] = seq, window - room
        if left := room - n:
            if not open_by_room.get(left):
                insort(rooms, left)
            open_by_room.setdefault(left, []).append(seq)
    return where, offsets


# -- Spark -------------------------------------------------------------------------------------------------------------


def _ranked(df: DataFrame, histogram: dict[int, int]) -> DataFrame:
    """df (units, row) with rank, from 0 within each value of units: ranks within parts, moved on by the parts before."""
    parts = [-(-histogram.get(n, 0) // RANKED) or 1 for n in range(max(histogram, default=0) + 1)]
    salted = df.withColumn("salt", F.pmod(F.xxhash64("row"), F.element_at(F.lit(parts), F.col("units") + 1)).cast("int"))
    sizes = salted.groupBy("units", "salt").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("units").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = sizes.select(F.col("units").alias("of"), F.col("salt").alias("part"), before.alias("first"))
    ranked = salted.withColumn("inner", F.row_number().over(Window.partitionBy("units", "salt").orderBy("row")))
    # rows lie by (units, salt) already, so this join moves only the sizes
    ranked = ranked.join(firsts, (F.col("units") == F.col("of")) & (F.col("salt") == F.col("part")))
    return ranked.withColumn("rank", F.col("first") + F.col("inner") - 1).drop("of", "part", "first", "inner", "salt")


def pack(piece_rows: DataFrame, window: int = WINDOW, unit: int = UNIT, depth: int = DEPTH) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens) with sequence_id and offset; each piece once, none cut further.

    Lengths lie between 1 and the window. Offsets in a sequence run from 0 without gaps. Pieces that fill a window to the unit
    are sequences of their own and are not ranked. Sequence ids are unique, not dense. Repeated rows are told apart by their
    row in the written table of pieces. No pieces give no rows.
    """
    spark = piece_rows.sparkSession
    units = window // unit
    rows = C.written(piece_rows.withColumn("units", F.ceil(F.col("length") / unit).cast("int")).withColumn("row", F.monotonically_increasing_id()))
    histogram = {r["units"]: r["count"] for r in rows.groupBy("units").count().collect()}  # as many rows as units at most
    fields = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    whole = rows.where(F.col("units") == units).select(*fields, (F.col("row") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    histogram.pop(units, None)
    slots, base, used = [], 0, dict.fromkeys(histogram, 0)
    for way, times in plan(histogram, units, depth):
        for place, n in enumerate(way):
            slots.append((n, used[n], used[n] + times, base, place))
            used[n] += times
        base += times
    # at most a slot for each place of each combination in use, and no more combinations than lengths are in use
    places = spark.createDataFrame(slots, "of int, low long, high long, base long, place int")
    inside = (F.col("units") == F.col("of")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    placed = C.written(_ranked(rows.where(F.col("units") < units), histogram).join(F.broadcast(places), inside, "left"))
    planned = placed.where("place is not null").withColumn("sequence_id", (F.col("base") + F.col("rank") - F.col("low")) * 2)
    before = F.sum("length").over(Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    planned = planned.select(*fields, "sequence_id", F.coalesce(before, F.lit(0)).alias("offset"))

    rest = placed.where("place is null").select(*fields, "row")
    count = sum(histogram.values()) - sum(used.values())
    n_blocks = max(1, -(-count // BLOCK))

    def greedy(table: pa.Table) -> pa.Table:
        order = table.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending"), ("row", "ascending")])
        where, offsets = best_fit(order["length"].to_pylist(), window)
        return order.append_column("local", pa.array(where, pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))

    blocks = rest.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(n_blocks)))
    packed = C.written(blocks.groupBy("block").applyInArrow(greedy, f"{_PIECE}, row long, block long, local long, offset long"))
    # a block's sequences follow those of all blocks before it: ids are (block, local) pairs written as one number
    numbered = (F.lit(base) + F.col("local") * F.lit(n_blocks) + F.col("block")) * 2
    return whole.unionByName(planned).unionByName(packed.select(*fields, numbered.alias("sequence_id"), "offset"))


def pack_documents(docs: DataFrame, tokenizer: str, window: int = WINDOW, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """All documents as pieces in windows: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null text counts as empty and is one piece, its end id. Repeated rows are packed each. A sequence id is unique, not
    dense. An empty table gives no rows; further columns are not looked at.
    """
    return pack(pieces(docs, tokenizer, window, text, doc_id), window)
