"""SentencePiece encoding and decoding through a table of distinct chunks.

No piece of the vocabulary has a white-space marker after another character, so no piece crosses the start of a marked
word: a text's segmentation is that of its marked words, one after the other. Each worker segments a distinct marked word
once, keeps ids and decoded text in a table of bounded size, and joins them back by position. No row leaves its partition.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

MARK = "▁"
END = 2

_chunk = re.compile(f"{MARK}+[^{MARK}]*")


class ChunkTable:
    """Ids and decoded text of marked words, by the library's own encode and decode."""

    def __init__(self, model: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            if MARK in piece.lstrip(MARK):
                raise ValueError(f"piece {piece!r} crosses a white-space marker")
        self.table = C.DistinctTable(self.segment)
        self.said: list[str] = []

    def segment(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = self.model.encode([c[1:] for c in new], num_threads=1)
        # the library encodes an empty string as nothing, so a lone marker is looked up
        ids = [x or [self.model.piece_to_id(c)] for x, c in zip(ids, new, strict=True)]
        self.said += self.model.decode(ids, num_threads=1)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum())), sizes

    def run(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Ids of all texts in a row (each with the end id), how many each text has, and the decoded texts."""
        chunks = [_chunk.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if self.table.full():
            self.table.reset()
            self.said = []
        codes, counts = self.table.number(chunks)
        ids, sizes = self.table.gather(codes, counts)
        words, at, said = list(map(self.said.__getitem__, codes.tolist())), 0, []
        for n in counts.tolist():
            # decoding drops the marker that a text starts with; of every other chunk it stands for a space
            said.append(" ".join(words[at : at + n]))
            at += n
        ends = np.cumsum(sizes)
        return np.insert(ids, ends, END), sizes + 1, said


def table(model: str) -> ChunkTable:
    return C.held(f"pieces {model}", lambda: ChunkTable(model))


def encode_decode(docs: DataFrame, model: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, ids array<int>, decoded string): the ids of each whole text as the library encodes it, with an end id, and
    the text that the library decodes from these ids.

    A null text counts as empty and has the end id alone. Rows keep their multiplicity; further columns are not looked at.
    """

    def run(batches):
        chunks = table(model)
        for b in batches:
            texts = C.str_texts(b.column(1))
            for i, j in C.blocks(texts):
                ids, sizes, said = chunks.run(texts[i:j])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), C.list_array(ids, sizes, pa.int32()), pa.array(said, pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of encode_decode's rows."""
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
