"""Language identification by unigram piece models that sum over all segmentations.

The pieces are those of a fixed public vocabulary. For each language, expectation-maximisation fits piece probabilities on
words: the forward algorithm gives a word's probability as the sum over all ways to write it in pieces, forward times
backward the expected piece counts. A text's score for a language is the sum of its words' log probabilities.

Fitting sees a bounded sample of labelled rows (SAMPLE rows a language in expectation); scoring covers every whole text, and
every segmentation of every whole word in the pieces of the whole vocabulary.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

MARK = "▁"
#: Labelled rows a language, in expectation, that fitting sees, and the longest words among them that it takes.
SAMPLE, FIT_MOST = 400, 64
#: Numbers that a worker keeps of the words it has scored, and characters of those words.
KEPT, KEPT_CHARS = 2_000_000, 4_000_000
ROUNDS = 3
#: Probability of a character that no piece has, and the weight of all languages together in each one's probabilities.
FLOOR, SHARED = 1e-7, 0.02

_letters = re.compile(r"[^\W\d_]+")
_PRIME = np.uint64(0x100000001B3)


def words_of(text: str) -> list[str]:
    """Lower-case runs of letters, each with the marker before it."""
    return [MARK + w for w in _letters.findall(text.lower())]


class Vocabulary:
    """Finds pieces in many words at once, by a rolling hash."""

    def __init__(self, pieces: list[str]) -> None:
        keys = self.keys(pieces)
        keep = np.unique(keys)
        self.hashes, self.size, self.longest = keep, len(keep), max(map(len, pieces), default=1)

    @staticmethod
    def keys(strings: list[str]) -> np.ndarray:
        out = np.zeros(len(strings), np.uint64)
        for i, s in enumerate(strings):
            h = 0
            for c in s:
                h = (h * int(_PRIME) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
            out[i] = h
        return out

    def spans(self, words: list[str]) -> list[list[tuple[int, np.ndarray]]]:
        """For words of one length: at each end, (start, piece of each word; self.size if there is none)."""
        n = len(words[0])
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), n).T.astype(np.uint64) + np.uint64(1)
        ends: list[list[tuple[int, np.ndarray]]] = [[] for _ in range(n + 1)]
        h = np.zeros_like(chars)
        for width in range(1, min(n, self.longest) + 1):
            h = h[: n - width + 1] * _PRIME + chars[width - 1 :]
            at = np.searchsorted(self.hashes, h)
            at[at == self.size] = 0
            found = self.hashes[at] == h
            at[~found] = self.size
            for i in np.flatnonzero(found.any(axis=1)) if width > 1 else range(n):
                ends[i + width].append((int(i), at[i]))
        return ends


def log_forward(spans, probabilities: np.ndarray, count: int, longest: int) -> np.ndarray:
    """Logarithms of the sums over all segmentations of whole words, however long: the sums of the last prefixes are scaled
    up together, word by word and language by language, as they get small."""
    alpha, logs = [np.ones((count, probabilities.shape[1]))], np.zeros((count, probabilities.shape[1]))
    for j in range(1, len(spans)):
        total = np.zeros_like(logs)
        for i, piece in spans[j]:
            p = probabilities[piece]
            if j - i == 1:
                p = np.where((piece == len(probabilities) - 1)[:, None], FLOOR, p)
            total += alpha[i - j] * p
        alpha = [*alpha[-longest:], total]
        if j % 8 == 0:
            # a prefix that is one unknown character longer has FLOOR of the one before, so the last sums are never all 0
            most = np.maximum.reduce(alpha[-longest:])
            alpha = [a / most for a in alpha]
            logs += np.log(most)
    return logs + np.log(alpha[-1] + 1e-300)


def forward(spans, probabilities: np.ndarray, count: int) -> list[np.ndarray]:
    """Sums over all segmentations of every prefix; probabilities has a row per piece and a last one for unknown ones."""
    alpha = [np.ones((count, probabilities.shape[1]))]
    for j in range(1, len(spans)):
        total = np.zeros_like(alpha[0])
        for i, piece in spans[j]:
            p = probabilities[piece]
            if j - i == 1:
                p = np.where((piece == len(probabilities) - 1)[:, None], FLOOR, p)
            total += alpha[i] * p
        alpha.append(total)
    return alpha


def by_length(words: list[str]):
    """(positions, words) of each length."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        for k in range(0, len(at), 20_000):
            yield at[k : k + 20_000], [words[i] for i in at[k : k + 20_000]]


class Model:
    def __init__(self, languages: list[str], vocabulary: Vocabulary, probabilities: np.ndarray, prior: np.ndarray) -> None:
        self.languages, self.vocabulary, self.probabilities, self.prior = languages, vocabulary, probabilities, prior
        self.reset()

    def reset(self) -> None:
        self.scores, self.used, self.codes, self.chars = np.zeros((1024, len(self.languages))), 0, {}, 0

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("scores", "used", "codes", "chars")}

    def __setstate__(self, state) -> None:
        self.__dict__.update(state)
        self.reset()

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log probability of each word in each language."""
        out = np.zeros((len(words), len(self.languages)))
        for at, some in by_length(words):
            out[at] = log_forward(self.vocabulary.spans(some), self.probabilities, len(some), self.vocabulary.longest)
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """Language and share of its probability among all languages; und and 0 where there is no letter."""
        if self.used * max(1, len(self.languages)) > KEPT or self.chars > KEPT_CHARS:
            self.reset()
        lists = [words_of(t) for t in texts]
        new = [w for w in set().union(*lists) if w not in self.codes]
        if new:
            self.codes.update(zip(new, range(len(self.codes), len(self.codes) + len(new)), strict=True))
            end = self.used + len(new)
            if end > len(self.scores):
                self.scores = np.concatenate([self.scores, np.zeros((max(end, 2 * len(self.scores)) - len(self.scores), len(self.languages)))])
            self.scores[self.used : end] = self.word_scores(new)
            self.used, self.chars = end, self.chars + sum(map(len, new))
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        codes = np.fromiter((c for ws in lists for c in map(self.codes.__getitem__, ws)), np.int64, int(counts.sum()))
        sums = np.concatenate([np.zeros((1, len(self.languages))), np.cumsum(self.scores[codes], axis=0)])
        ends = np.concatenate([[0], np.cumsum(counts)])
        names, shares = [], []
        for total, n in zip(np.diff(sums[ends], axis=0) + self.prior, counts, strict=True):
            if not n or not self.languages:
                names.append("und")
                shares.append(0.0)
                continue
            e = np.exp(total - total.max())
            names.append(self.languages[int(total.argmax())])
            shares.append(float((e / e.sum()).max()))
        return names, shares


def fit(counts: dict[str, dict[str, int]], pieces: list[str], prior: dict[str, int]) -> Model:
    """A model from the word counts of each language."""
    languages = sorted(counts)
    vocabulary = Vocabulary([p.lower() for p in pieces])
    words = sorted(set().union(*counts.values())) if languages else []
    where = {w: i for i, w in enumerate(words)}
    weights = np.zeros((len(words), len(languages)))
    for k, name in enumerate(languages):
        for w, c in counts[name].items():
            weights[where[w], k] = c
    p = np.full((vocabulary.size + 1, len(languages)), 1 / (vocabulary.size + 1))
    for _ in range(ROUNDS if languages else 0):
        expected = np.zeros_like(p)
        for at, some in by_length(words):
            spans = vocabulary.spans(some)
            alpha = forward(spans, p, len(some))
            n, beta = len(spans) - 1, [np.zeros_like(alpha[0]) for _ in spans]
            beta[n] = weights[at] / (alpha[n] + 1e-300)
            for j in range(n, 0, -1):
                for i, piece in spans[j]:
                    q = p[piece]
                    if j - i == 1:
                        q = np.where((piece == vocabulary.size)[:, None], FLOOR, q)
                    for k in range(len(languages)):
                        expected[:, k] += np.bincount(piece, alpha[i][:, k] * q[:, k] * beta[j][:, k], minlength=len(p))
                    beta[i] += q * beta[j]
        expected[-1] = 0
        alone = expected / np.maximum(expected.sum(axis=0), 1e-300)
        both = expected.sum(axis=1, keepdims=True) / max(expected.sum(), 1e-300)
        p = (1 - SHARED) * alone + SHARED * both + 1e-10
        p[-1] = 0
    total = sum(prior.values())
    return Model(languages, vocabulary, p, np.log([prior[k] / total for k in languages]) if languages else np.zeros(0))


def learn(rows: DataFrame, vocabulary_model: str, sample: int = SAMPLE, text: str = "text", lang: str = "lang") -> Model:
    """Fits on rows with a language and a text: about `sample` whole texts of each language.

    No such rows give a model that knows no language. The choice of rows depends on a hash of their text alone. Words longer
    than FIT_MOST are not fitted on (they are scored whole all the same). The driver holds the words of the chosen texts.
    """
    import sentencepiece

    rows = rows.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).where("text is not null and lang is not null")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    shares = rows.sparkSession.createDataFrame([(name, min(1.0, sample / n)) for name, n in sizes.items()], "of string, share double")
    # as many rows as there are languages
    some = rows.join(F.broadcast(shares), F.col("lang") == F.col("of")).where((F.pmod(F.xxhash64("text"), F.lit(1 << 20)) / float(1 << 20)) < F.col("share")).select("text", "lang")

    def count(batches):
        for b in batches:
            langs, words, numbers = [], [], []
            tally: dict[tuple[str, str], int] = {}
            for t, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for w in words_of(t):
                    if len(w) > FIT_MOST:
                        continue
                    tally[name, w] = tally.get((name, w), 0) + 1
            for (name, w), n in tally.items():
                langs.append(name)
                words.append(w)
                numbers.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array(numbers, pa.int64())], ["lang", "word", "n"])

    counted = some.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toPandas()
    counts = {name: dict(zip(g["word"], g["n"], strict=True)) for name, g in counted.groupby("lang")}
    pieces = sentencepiece.SentencePieceProcessor(model_file=vocabulary_model)
    known = [pieces.id_to_piece(i) for i in range(pieces.get_piece_size()) if not (pieces.is_control(i) or pieces.is_unknown(i) or pieces.is_byte(i))]
    return fit(counts, known, {k: sizes[k] for k in counts})


def identify(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id", also: list[Column] | None = None) -> DataFrame:
    """(doc_id, lang_pred, score) and the columns of `also` for every whole text; und and 0 for null and letterless ones.

    Rows keep their multiplicity; further columns are not looked at, whatever their names. An empty table gives no rows; a
    model that knows no language gives und and 0.
    """
    import uuid

    shipped, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex  # bounded: vocabulary times languages

    def run(batches):
        here = C.held(f"language {name}", lambda: shipped.value)
        for b in batches:
            texts = C.str_texts(b.column(0))
            for i, j in C.blocks(texts):
                names, shares = here.predict(texts[i:j])
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(i, j - i) for k in range(1, b.num_columns)), pa.array(names, pa.string()), pa.array(shares, pa.float64())], [*b.schema.names[1:], "lang_pred", "score"])

    rows = docs.select(F.col(text).cast("string").alias("text"), F.col(doc_id).cast("long").alias("doc_id"), *(also or []))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(run, f"{kinds}, lang_pred string, score double")
