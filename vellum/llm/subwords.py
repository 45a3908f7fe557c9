"""Text classifiers of subword bags: word and character n-gram vectors, averaged, under a linear softmax.

A bag is a whole document or, for marks that a few words decide, each run of window words; a document then
scores as its highest run. Every word and every character n-gram inside a word (its edges marked), and with
pairs every two neighbouring words (in either order; a word and itself always make the same feature), falls into one
of 2**bits buckets, each with a vector. Without repeats a word right after itself makes no features. A bag's vector is the mean of its features' vectors, and a linear softmax
over it gives the classes. Vectors and softmax are trained jointly by stochastic gradient descent in numpy on the
driver, on a bounded sample of labelled rows. For scoring, softmax and vectors collapse into one number a bucket,
which is broadcast (2**bits doubles, whatever the size of the corpus).
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.pieces import pieces
from vellum.llm.common import free_name, idle_memory

#: Texts are worked through in runs of about so many code points; longer ones are cut at white space, or inside a
#: word that goes on for as many more: its pieces count as words.
CHUNK = 1 << 18
_MIX, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))
_powers: dict = {}


@dataclass(frozen=True)
class Shape:
    """How texts become buckets."""

    bits: int = 18
    shortest: int = 3
    longest: int = 5
    fold_case: bool = True
    window: int | None = None
    pairs: bool = False
    repeats: bool = True


def _powers_to(n: int):
    if _powers.get("n", 0) < n:
        size = max(n, 2 * CHUNK)
        up, down = np.full(size, _STEP), np.full(size, _BACK)
        up[0] = down[0] = 1
        _powers.update(n=size, up=np.cumprod(up), down=np.cumprod(down))
    return _powers["up"], _powers["down"]


def _bucket(h: np.ndarray, bits: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return (h >> np.uint64(64 - bits)).astype(np.int32)


def _runs(texts: list[str]):
    """Groups of (document, text piece) of about CHUNK code points. A long text makes groups of its own."""
    group, size = [], 0
    for i, t in enumerate(texts):
        if len(t) > CHUNK:
            start = 0
            while start < len(t):
                end = start + CHUNK
                while end < len(t) and end < start + 2 * CHUNK and not t[end].isspace():
                    end += 1
                yield [(i, t[start:end])]
                start = end
            continue
        if size + len(t) > CHUNK and group:
            yield group
            group, size = [], 0
        group.append((i, t))
        size += len(t)
    if group:
        yield group


def bags(texts: list[str], shape: Shape):
    """Yields (document of each bag, features of all bags in a row, where each bag begins in them).

    A document without words makes no bag. With no window a document makes a bag for each of its pieces; their
    sums add up to the document's.
    """
    for group in _runs([t.lower() for t in texts] if shape.fold_case else texts):
        joined = " " + " ".join(t for _, t in group) + " " * (shape.longest + 1)
        cp = np.frombuffer(joined.encode("utf-32-le", "replace"), dtype=np.uint32)
        starts = np.cumsum([0] + [len(t) + 1 for _, t in group])
        n = int(starts[-1]) + 1
        space = (cp == 32) | ((cp >= 9) & (cp <= 13))
        v = (np.where(space, np.uint32(32), cp).astype(np.uint64) + np.uint64(1)) * _MIX
        spaces = np.concatenate([[0], np.cumsum(space)])
        slots = np.full((n, 3 + shape.longest - shape.shortest), -1, dtype=np.int32)
        first = np.flatnonzero(~space[1:n] & space[: n - 1]) + 1
        last = np.flatnonzero(~space[: n - 1] & space[1:n]) + 1
        if not len(first):
            continue
        up, down = _powers_to(n + 1)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(v[:n] * up[:n])])
        words = (sums[last] - sums[first]) * down[first]
        slots[first - 1, 0] = _bucket(words + np.uint64(7), shape.bits)
        h = v.copy()
        for size in range(2, shape.longest + 1):
            h = h[:-1] * _STEP + v[size - 1 :]
            if size >= shape.shortest:
                inside = spaces[size - 1 : n + size - 1] - spaces[1 : n + 1] == 0
                slots[inside, size - shape.shortest + 1] = _bucket(h[:n][inside] + np.uint64(size), shape.bits)
        owner = np.searchsorted(starts, first, "right") - 1  # the piece of each word
        if shape.pairs:
            same = owner[1:] == owner[:-1]
            slots[first[1:][same] - 1, -1] = _bucket((words[1:] ^ words[:-1])[same], shape.bits)
        if not shape.repeats:
            again = np.r_[False, (owner[1:] == owner[:-1]) & (words[1:] == words[:-1])]
            covered = np.zeros(n + 1, dtype=np.int8)
            covered[first[again] - 1] += 1
            covered[last[again] - 1] -= 1
            slots[np.cumsum(covered[:n]) > 0] = -1
            first, owner = first[~again], owner[~again]
        if shape.window:
            begins = np.r_[True, owner[1:] != owner[:-1]]
            at = np.arange(len(first))
            ordinal = at - np.maximum.accumulate(np.where(begins, at, 0))
            begins = ordinal % shape.window == 0
        else:
            begins = np.r_[True, owner[1:] != owner[:-1]]
        used = slots >= 0
        upto = np.concatenate([[0], np.cumsum(used.sum(axis=1))])
        docs = np.array([i for i, _ in group])
        yield docs[owner[begins]], slots[used], upto[first[begins] - 1]


@dataclass
class Model:
    """weights: what each bucket adds to the log odds of class 1; bias: the rest; prior: the score of a text without words."""

    weights: np.ndarray
    bias: float
    shape: Shape
    prior: float = 0.5

    def score(self, texts: list[str]) -> np.ndarray:
        n = len(texts)
        best = np.full(n, -np.inf)
        total, count = np.zeros(n), np.zeros(n)
        for docs, features, begins in bags(texts, self.shape):
            sums = np.add.reduceat(self.weights[features], begins)
            sizes = np.diff(np.append(begins, len(features)))
            if self.shape.window:
                np.maximum.at(best, docs, sums / sizes)
            else:
                np.add.at(total, docs, sums)
                np.add.at(count, docs, sizes)
        if self.shape.window:
            words, odds = np.isfinite(best), best
        else:
            words, odds = count > 0, total / np.maximum(count, 1)
        return np.where(words, 1 / (1 + np.exp(-np.clip(odds + self.bias, -40, 40))), self.prior)


def train(texts: list[str], labels: list[int], shape: Shape, dim: int = 12, epochs: int = 12, rate: float = 0.5, batches: int = 16, rounds: int = 1, seed: int = 11) -> Model:
    """Fits vectors and softmax jointly, by gradient descent over random batches of bags.

    Steps are scaled by the root of the squared gradients that a bucket
    has seen (AdaGrad), so that rare features learn too. With windows, a document's label says that some run of a
    positive has the mark and no run of a negative: the first round takes all runs with their document's label,
    the later ones of each positive only its highest run.
    """
    rng = np.random.default_rng(seed)
    labels = np.asarray(labels)
    vectors = ((rng.random((1 << shape.bits, dim)) - 0.5) / dim).astype(np.float32)
    out = (rng.standard_normal(dim) * 0.3).astype(np.float32)  # of two classes, the softmax needs the difference of the rows
    seen, seen_out, bias = np.zeros(1 << shape.bits, dtype=np.float32), np.zeros(dim + 1), 0.0
    doc, flat, size = _all_bags(texts, shape)
    if not len(doc):
        return Model(np.zeros(1 << shape.bits), 0.0, shape)
    begin = np.concatenate([[0], np.cumsum(size)])
    keep = np.ones(len(doc), bool)
    for turn in range(rounds):
        if turn:
            odds = np.add.reduceat((vectors @ out)[flat], begin[:-1]) / size + bias
            top = np.full(len(texts), -np.inf)
            np.maximum.at(top, doc, odds)
            keep = (labels[doc] == 0) | (odds == top[doc])
        for epoch in range(epochs):
            batch = rng.integers(0, batches, len(doc))
            for k in range(batches):
                bag = np.flatnonzero(keep & (batch == k))
                if not len(bag):
                    continue
                n = size[bag]
                ids = flat[np.repeat(begin[bag] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
                at = np.concatenate([[0], np.cumsum(n)[:-1]])
                odds = np.add.reduceat((vectors @ out)[ids], at) / n + bias
                y = labels[doc[bag]]
                g = (1 / (1 + np.exp(-np.clip(odds, -30, 30))) - y) / len(bag)
                pull = np.bincount(ids, np.repeat(g / n, n), minlength=len(vectors)).astype(np.float32)
                step = rate * (1 - 0.9 * epoch / epochs)
                seen += pull * pull
                toward = vectors.T @ pull
                vectors -= (step * pull / np.sqrt(seen + 1e-10))[:, None] * out
                seen_out += np.append(toward * toward, g.sum() ** 2)
                slow = 0.1 * (1 - 0.9 * epoch / epochs) / np.sqrt(seen_out + 1e-10)
                out -= (slow[:-1] * toward).astype(np.float32)
                bias -= float(slow[-1] * g.sum())
    return Model(vectors.astype(np.float64) @ out.astype(np.float64), float(bias), shape)


def _all_bags(texts: list[str], shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document and size of each bag, and the features of all in a row."""
    parts = list(bags(texts, shape))
    if not parts:
        return (np.zeros(0, np.int64),) * 3
    return np.concatenate([d for d, _, _ in parts]), np.concatenate([f for _, f, _ in parts]), np.concatenate([np.diff(np.append(b, len(f))) for _, f, b in parts])


def fit(docs: DataFrame, labels: DataFrame, text: str, key: str, label: str, shape: Shape, max_rows: int = 3000, max_chars: int = 50_000, max_total: int = 12_000_000, **options) -> Model:
    """Trains on a bounded sample of labelled rows.

    Of each class come at most max_rows / 2 ids, those with the smallest hashes, and of these the texts of at most
    max_chars code points, in the order of the hashes until they have max_total / 2 code points together: so many
    texts, each whole, reach the driver (about 9 bytes of features a code point). Rows without id, label or text are
    not drawn; an id with both labels counts as 1, of an id with several texts comes the one with the smallest hash,
    so that reruns learn the same. A text without words scores as the share of class 1 among all
    labelled ids. Without any labelled text to train on, every text scores so (0.5 if there is no label either).
    """
    hashed, mark = "_hash", "_label"
    marks = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(key).alias("_key")).agg(F.max(label).alias(mark))
    marks = marks.withColumn(hashed, F.xxhash64("_key"))
    totals = dict(marks.groupBy(mark).count().collect())
    prior = totals.get(1, 0) / (sum(totals.values()) or 2) if totals else 0.5
    drawn = [marks.where(F.col(mark) == y).orderBy(hashed, "_key").limit(max_rows // 2) for y in (0, 1)]
    ids = drawn[0].unionByName(drawn[1])
    texts = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text")).where(F.length("_text") <= max_chars)
    texts = texts.join(F.broadcast(ids), F.col("_id") == F.col("_key")).groupBy("_key", mark, hashed).agg(F.min(F.struct(F.xxhash64("_text").alias("_order"), "_text")).alias("_one"))
    # the windows hold max_rows / 2 rows at most
    upto = F.sum(F.length("_one._text")).over(Window.partitionBy(mark).orderBy(hashed, "_key"))
    rows = texts.withColumn("_upto", upto).where(F.col("_upto") <= max_total // 2).select("_key", F.col("_one._text").alias("_text"), mark).collect()
    rows.sort(key=lambda r: (str(r["_key"]), r["_text"]))
    if not rows:
        return Model(np.zeros(1 << shape.bits), float(np.log((prior + 1e-9) / (1 - prior + 1e-9))), shape, prior)
    return replace(train([r["_text"] for r in rows], [r[mark] for r in rows], shape, **options), prior=prior)


def score(df: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Adds the probability of class 1 of each whole text, null counting as empty; equal texts score alike.

    A map over rows without a shuffle. Empty tables stay empty; a column of the name given is replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(texts: pa.Array) -> pa.Array:
        out = [shared.value.score([t or "" for t in piece.to_pylist()]) for (piece,) in pieces((texts,))]
        idle_memory()
        return pa.array(np.concatenate(out), pa.float64())

    return df.withColumn(out, F.arrow_udf(run, "double")(F.col(text)))


def classify(df: DataFrame, model: Model, threshold: float, text: str = "text", scored: str = "score", predicted: str = "predicted") -> DataFrame:
    """Score, and 1 where it reaches the threshold, else 0."""
    return score(df, model, text, scored).withColumn(predicted, F.when(F.col(scored) >= threshold, 1).otherwise(0))


def keep(df: DataFrame, model: Model, threshold: float, text: str = "text") -> DataFrame:
    """The rows whose score reaches the threshold, with the columns they had."""
    name = free_name(df, "_score")
    return score(df, model, text, name).where(F.col(name) >= threshold).drop(name)
