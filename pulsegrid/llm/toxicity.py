"""Toxicity by averaged subword embeddings and a linear softmax, trained together in numpy.

A word is the bag of its hashed character n-grams and itself, so a misspelling shares most vectors with the word it hides.
A window of words is the average of its subword vectors; a softmax over two classes scores it, and a text scores as its most
toxic window. Labels hold for whole texts, so training takes, epoch by epoch, the window of each text that the model finds
most toxic (and a random one of clean texts). A logistic fit on the best windows' margins gives the final score.

Training sees a bounded sample of labelled rows; scoring covers every window of every whole text.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Labelled rows that training sees: at most about so many toxic and clean ones.
TOXIC_MOST, CLEAN_MOST = 1500, 3500
BUCKETS, WIDTH, WORDS = 1 << 16, 8, 10
#: Most characters of a word, and from one piece of a longer one to the next: STEP characters in a row are in one piece.
PIECE, STEP = 40, 20
EPOCHS, RATE = 14, 0.5
THRESHOLD = 0.7

_word = re.compile(r"\w+")
_PRIME = np.uint64(0x100000001B3)


def words_of(text: str) -> list[str]:
    """Lower-case words; runs longer than PIECE are split at underscores, and what is still longer gives overlapping pieces."""
    out = []
    for w in _word.findall(text.lower()):
        if len(w) <= PIECE:
            out.append(w)
            continue
        for part in [x for x in w.split("_") if x] or [w]:
            out += [part[i : i + PIECE] for i in range(0, max(1, len(part) - STEP), STEP)]
    return out


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words' subwords in a row, ordered by word, and how many each word has.

    A word's subwords are the n-grams of 3 to 5 characters of <word>, and <word> whole."""
    marked = [f"<{w}>" for w in words]
    lengths = np.fromiter(map(len, marked), np.int64, len(marked))
    chars = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    owner = np.repeat(np.arange(len(words)), lengths)
    starts = np.cumsum(lengths) - lengths
    left = np.repeat(starts + lengths, lengths) - np.arange(len(chars))
    h = np.zeros(len(chars), np.uint64)
    found, of = [], []
    for n in range(1, min(5, len(chars)) + 1):
        h[: len(chars) - n + 1] = h[: len(chars) - n + 1] * _PRIME + chars[n - 1 :]
        if n >= 3:
            ok = left >= n
            found.append(h[ok] + np.uint64(n))
            of.append(owner[ok])
    whole = np.zeros(len(words), np.uint64)
    if len(words):
        power = np.ones(len(chars), np.uint64)
        place = np.arange(len(chars)) - np.repeat(starts, lengths)
        for _ in range(int(lengths.max()) - 1):
            power[place > 0] *= _PRIME
            place = place - 1
        whole = np.add.reduceat(chars * power, starts) + np.uint64(99)
    found.append(whole)
    of.append(np.arange(len(words)))
    hashes, of = np.concatenate(found), np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return (C.mix(hashes[order]) & np.uint64(BUCKETS - 1)).astype(np.int64), np.bincount(of, minlength=len(words))


def window_sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For texts laid end to end: sums over the windows of WORDS words that end at each word of its text."""
    total = np.concatenate([np.zeros((1, values.shape[1])), np.cumsum(values, axis=0)])
    first = np.repeat(np.cumsum(counts) - counts, counts)
    ends = np.arange(1, len(values) + 1)
    return total[ends] - total[np.maximum(first, ends - WORDS)]


class Model:
    """margin(window) = average over its subwords of margins[bucket], plus bias; score = logistic(a * best margin + b)."""

    def __init__(self, margins: np.ndarray, bias: float, a: float, b: float) -> None:
        self.margins, self.bias, self.a, self.b = margins, bias, a, b
        self.reset()

    def reset(self) -> None:
        self.codes, self.known = {}, np.zeros((0, 2))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("codes", "known")}

    def __setstate__(self, state) -> None:
        self.__dict__.update(state)
        self.reset()

    def word_values(self, words: list[str]) -> np.ndarray:
        """Sum of margins and number of subwords of each word."""
        at, n = subwords(words)
        return np.stack([np.add.reduceat(self.margins[at], np.cumsum(n) - n) if len(n) else np.zeros(0), n], axis=1)

    def best_margins(self, texts: list[str]) -> np.ndarray:
        if len(self.codes) > 200_000:
            self.reset()
        lists = [words_of(t) for t in texts]
        new = [w for w in set().union(*lists) if w not in self.codes]
        if new:
            self.codes.update(zip(new, range(len(self.codes), len(self.codes) + len(new)), strict=True))
            self.known = np.concatenate([self.known, self.word_values(new)])
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        codes = np.fromiter((c for ws in lists for c in map(self.codes.__getitem__, ws)), np.int64, int(counts.sum()))
        return best_of(window_sums(self.known[codes], counts), counts)[0] + self.bias

    def score(self, texts: list[str]) -> np.ndarray:
        z = self.a * self.best_margins(texts) + self.b
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def best_of(sums: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The largest average of each text's windows (0 for a text without words) and the word it ends at (-1)."""
    best, at = np.zeros(len(counts)), np.full(len(counts), -1)
    has = np.flatnonzero(counts)
    if len(has):
        average = sums[:, 0] / sums[:, 1]
        starts = (np.cumsum(counts) - counts)[has]
        best[has] = np.maximum.reduceat(average, starts)
        hit = average == np.repeat(best[has], counts[has])
        places = np.flatnonzero(hit)
        owner = np.repeat(np.arange(len(has)), counts[has])[places]
        firsts = np.unique(owner, return_index=True)[1]
        at[has] = places[firsts]
    return best, at


def fit(texts: list[str], toxic: np.ndarray, seed: int = 7) -> Model:
    """Trains embeddings and softmax together; texts of one class only give a model that scores all of them alike."""
    rng = np.random.default_rng(seed)
    where: dict[str, int] = {}
    coded = [np.array([where.setdefault(w, len(where)) for w in words_of(t)], np.int32) for t in texts]
    if not where or toxic.all() or not toxic.any():
        return Model(np.zeros(BUCKETS), 0.0, 0.0, 4.0 if len(toxic) and toxic.all() else -4.0)
    vocabulary = list(where)
    del where
    parts = [subwords(vocabulary[i : i + 50_000]) for i in range(0, len(vocabulary), 50_000)]
    at, n = np.concatenate([a.astype(np.int32) for a, _ in parts]), np.concatenate([b for _, b in parts])
    del vocabulary, parts
    starts = np.cumsum(n) - n
    counts = np.fromiter(map(len, coded), np.int64, len(coded))
    codes = np.concatenate(coded)
    first = np.cumsum(counts) - counts
    some = np.flatnonzero(counts)
    e = rng.normal(0, 0.1, (BUCKETS, WIDTH))
    w, bias = rng.normal(0, 0.5, (WIDTH, 2)), np.zeros(2)
    seen_e, seen_w = np.full(BUCKETS, 1e-6), np.full(w.shape, 1e-6)

    def windows(ends: np.ndarray, docs: np.ndarray) -> list[np.ndarray]:
        return [codes[max(first[d], k - WORDS + 1) : k + 1] for k, d in zip(ends, docs, strict=True)]

    for epoch in range(EPOCHS):
        margins = e @ (w[:, 1] - w[:, 0])
        per_word = np.stack([np.add.reduceat(margins[at], starts), n], axis=1)
        best = best_of(window_sums(per_word[codes], counts), counts)[1]
        random = first + (rng.random(len(counts)) * np.maximum(counts, 1)).astype(np.int64)
        clean = some[~toxic[some]]
        # at first any window of a toxic text may be the toxic one; later the model's own choice is
        docs = np.concatenate([some, clean])
        ends = np.concatenate([(random if epoch < 3 else best)[some], random[clean]])
        bags, labels = windows(ends, docs), toxic[docs].astype(int)
        weight = np.where(labels == 1, len(labels) / (2 * max(1, labels.sum())), len(labels) / (2 * max(1, (1 - labels).sum())))
        order = rng.permutation(len(bags))
        for k in range(0, len(order), 64):
            pick = order[k : k + 64]
            sizes = [len(bags[i]) for i in pick]
            words = np.concatenate([bags[i] for i in pick])
            per = n[words]
            ends_sub = np.cumsum(per)
            sub = at[np.repeat(starts[words] - (ends_sub - per), per) + np.arange(int(ends_sub[-1]))]
            owner = np.repeat(np.repeat(np.arange(len(pick)), sizes), per)
            total = np.bincount(owner, minlength=len(pick))
            bounds = np.searchsorted(owner, np.arange(len(pick)))
            hidden = np.add.reduceat(e[sub], bounds, axis=0) / total[:, None]
            z = hidden @ w + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(pick)), labels[pick]] -= 1
            p *= weight[pick][:, None] / len(pick)
            grad_w, grad_h = hidden.T @ p, p @ w.T
            step = grad_h[owner] / total[owner][:, None]
            used, inverse = np.unique(sub, return_inverse=True)
            grad = np.stack([np.bincount(inverse, step[:, c], minlength=len(used)) for c in range(WIDTH)], axis=1)
            seen_e[used] += (grad**2).mean(axis=1)
            seen_w += grad_w**2
            e[used] -= RATE * grad / np.sqrt(seen_e[used])[:, None]
            w -= RATE * 0.2 * grad_w / np.sqrt(seen_w)
            bias -= 0.05 * p.sum(axis=0)
    model = Model(e @ (w[:, 1] - w[:, 0]), float(bias[1] - bias[0]), 1.0, 0.0)
    found = np.concatenate([model.best_margins(texts[i : i + 200]) for i in range(0, len(texts), 200)])
    model.a, model.b = logistic(found, toxic)
    model.reset()
    return model


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """a, b of a logistic fit of y by x, with a slight pull to 0."""
    scale = float(np.abs(x).max()) or 1.0
    f, beta = np.stack([x / scale, np.ones(len(x))], axis=1), np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(f @ beta, -30, 30)))
        hessian = (f * (p * (1 - p))[:, None]).T @ f + np.diag([1e-3, 1e-3])
        step = np.linalg.solve(hessian, f.T @ (y - p) - 1e-3 * beta)
        beta += np.clip(step, -4, 4)
    return float(beta[0] / scale), float(beta[1])


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", toxic_most: int = TOXIC_MOST, clean_most: int = CLEAN_MOST) -> Model:
    """Fits on about toxic_most toxic and clean_most clean rows that labels (doc_id, label) names, chosen by a hash of the id.

    Labels other than 0 and 1 are left out; of several labels of one id the larger one counts. Only the chosen rows' texts
    are moved: their ids are sent to all tasks, and are bounded by the two numbers (in expectation)."""
    known = labels.select(F.col(doc_id).alias("of"), F.col(label).cast("int").alias("label")).where("of is not null and label in (0, 1)").groupBy("of").agg(F.max("label").alias("label"))
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    share = F.when(F.col("label") == 1, min(1.0, toxic_most / max(1, sizes.get(1, 0)))).otherwise(min(1.0, clean_most / max(1, sizes.get(0, 0))))
    chosen = known.where(F.pmod(F.xxhash64("of"), F.lit(1 << 20)) / float(1 << 20) < share)
    some = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text")).where("text is not null")
    some = some.join(F.broadcast(chosen), F.col("id") == F.col("of")).select("id", "text", "label").toPandas()
    some = some.sort_values(["id", "text"], kind="stable")
    toxic = some["label"].to_numpy(bool)
    model = fit(some["text"].tolist(), toxic)
    if sizes.get(0) and sizes.get(1) and toxic.any() and not toxic.all():
        # the sample holds more toxic texts than the labels do
        model.b += float(np.log(sizes[1] / sizes[0]) - np.log(toxic.sum() / (~toxic).sum()))
    del some
    C.give_back()  # the driver goes on to other things
    return model


def score(docs: DataFrame, model: Model, also: list[Column], text: str = "text") -> DataFrame:
    """The columns of `also` with score (0 to 1) and predicted (1 from THRESHOLD on) for every row and whole text.

    A null or wordless text scores as one whose windows all have the margin 0 plus the bias."""
    shipped, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex  # bounded: BUCKETS numbers

    def run(batches):
        here = C.held(f"toxicity {name}", lambda: shipped.value)
        for b in batches:
            texts = C.str_texts(b.column(0))
            for i, j in C.blocks(texts):
                s = here.score(texts[i:j])
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(i, j - i) for k in range(1, b.num_columns)), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], [*b.schema.names[1:], "score", "predicted"])

    rows = docs.select(F.col(text).cast("string").alias(C.hidden(docs, "scored_text")), *also)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(run, f"{kinds}, score double, predicted int")
