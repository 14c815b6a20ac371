"""Document quality from a linear-chain conditional random field over lines.

Every line that is not blank gets features of its own bytes and words, and those of the line before and after.
A two-state chain labels it good or bad; marginals by forward-backward, weighted by length, give the share of
good text, and a logistic step turns that share into the probability that the document is good.

Training takes a bounded sample of labelled documents, whose lines inherit the label of their document, and runs on the
driver; scoring runs on all documents, batch by batch, for all documents of a batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from counterscope.llm.shared import map_batches
from counterscope.llm.words import Words, mixed

_U = np.uint64
OWN = 13
NAMES = ("own", "before", "after")
FEATURES = 1 + len(NAMES) * OWN

_CLASS = np.zeros(256, dtype=np.uint8)
_KINDS = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"!?", b"#$%&*@^~+=<>{}[]\\/_", b"|", b".,;:")
for _i, _kind in enumerate(_KINDS):
    _CLASS[list(_kind)] = _i + 1


def line_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines with a word (lines x OWN), their lengths, and where each text's lines begin."""
    words = Words(column)
    data, offsets = words.data, words.offsets
    breaks = np.flatnonzero(data == 10)
    edges = np.union1d(breaks + 1, offsets[:-1])
    edges = edges[edges < len(data)]
    line_of = np.searchsorted(edges, words.first, "right") - 1
    used, word_start = np.unique(line_of, return_index=True)
    if not len(used):
        return np.zeros((0, OWN)), np.zeros(0), np.zeros(len(offsets), np.int64)
    start = edges[used]
    end = np.append(edges, len(data))[used + 1]
    n_words = np.diff(np.append(word_start, len(words.hashes))).astype(float)
    length = (end - start).astype(float)

    counts = np.empty((len(used), len(_KINDS)))
    kinds = _CLASS[data]
    for k in range(len(_KINDS)):
        total = np.concatenate([[0], np.cumsum(kinds == k + 1, dtype=np.int64)])
        counts[:, k] = total[end] - total[start]
    upper, lower, digit, loud, odd, bar, stop = counts.T

    index = np.repeat(np.arange(len(used)), n_words.astype(np.int64))
    same = np.zeros(len(words.hashes))
    same[1:] = (words.hashes[1:] == words.hashes[:-1]) & (index[1:] == index[:-1])
    repeats = np.add.reduceat(same, word_start)
    # distinct words of a line: its number and the word's first bits in one sortable number
    key = np.sort((index.astype(_U) << _U(36)) | (words.hashes >> _U(28)))
    fresh = np.ones(len(key), dtype=bool)
    fresh[1:] = key[1:] != key[:-1]
    distinct = np.bincount((key[fresh] >> _U(36)).astype(np.int64), minlength=len(used))

    with np.errstate(over="ignore"):
        place = (np.arange(len(words.hashes)) - word_start[index]).astype(_U)
        line_hash = np.add.reduceat(mixed(words.hashes + place * _U(0x9E3779B97F4A7C15)), word_start)
    doc = np.searchsorted(offsets, start, "right") - 1
    order = np.lexsort((np.arange(len(used)), line_hash, doc))
    seen = np.zeros(len(used))
    h, d = line_hash[order], doc[order]
    seen[order[1:]] = (h[1:] == h[:-1]) & (d[1:] == d[:-1])

    letters = np.maximum(upper + lower, 1)
    final = data[words.end[np.append(word_start[1:], len(words.hashes)) - 1] - 1]
    features = np.column_stack(
        [
            np.log1p(length) / 5,
            np.minimum(upper / letters * 2, 1),
            digit / length,
            np.minimum(loud / n_words, 1),
            np.minimum(odd / n_words, 2),
            np.minimum(bar / n_words, 1),
            np.minimum(stop / n_words, 1),
            np.minimum(length / n_words / 10, 3),
            repeats / n_words,
            distinct / n_words,
            seen,
            np.isin(final, list(b".!?")).astype(float),
            n_words < 4,
        ]
    )
    return features, length, np.searchsorted(doc, np.arange(len(offsets)))


def with_neighbours(features: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A constant, a line's own features and those of the line before and after within the text (0 outside)."""
    n = len(features)
    out = np.zeros((n, FEATURES))
    out[:, 0] = 1
    out[:, 1 : 1 + OWN] = features
    if n:
        before, after = np.zeros_like(features), np.zeros_like(features)
        before[1:], after[:-1] = features[:-1], features[1:]
        before[bounds[:-1][bounds[:-1] < n]] = 0
        after[(bounds[1:] - 1)[bounds[1:] > bounds[:-1]]] = 0
        out[:, 1 + OWN : 1 + 2 * OWN], out[:, 1 + 2 * OWN :] = before, after
    return out


@dataclass(frozen=True)
class LineChain:
    """Weights of the good state against the bad one, 2 x 2 transitions (bad, good), and the logistic step."""

    weights: np.ndarray
    moves: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def marginals(self, emission: np.ndarray, bounds: np.ndarray, pairs: bool = False):
        """P(good) of every line; with ``pairs`` also the expected transitions and the log partition sum.

        Texts are handled together, one line of each at a time, those with most lines first.
        """
        n_lines = np.diff(bounds)
        order = np.argsort(-n_lines, kind="stable")
        starts, sizes = bounds[:-1][order], n_lines[order]
        odds = np.exp(np.stack([np.zeros(len(emission)), np.clip(emission, -30, 30)], axis=1))
        move = np.exp(self.moves)
        forward, backward = np.ones_like(odds), np.ones_like(odds)
        logs = 0.0
        steps = [starts[: np.searchsorted(-sizes, -t, "left")] + t for t in range(int(sizes[0]) if len(sizes) else 0)]
        for t, at in enumerate(steps):
            f = odds[at] if t == 0 else odds[at] * (forward[at - 1] @ move)
            scale = f.sum(axis=1, keepdims=True)
            forward[at] = f / scale
            logs += float(np.log(scale).sum())
        for at in reversed(steps[1:]):
            b = (odds[at] * backward[at]) @ move.T
            backward[at - 1] = b / b.sum(axis=1, keepdims=True)
        both = forward * backward
        good = both[:, 1] / both.sum(axis=1)
        if not pairs:
            return good
        expected = np.zeros((2, 2))
        for at in steps[1:]:
            joint = forward[at - 1][:, :, None] * move * (odds[at] * backward[at])[:, None, :]
            expected += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        return good, expected, logs

    def shares(self, features: np.ndarray, lengths: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Length-weighted share of good text; 0.5 for texts without lines."""
        good = self.marginals(with_neighbours(features, bounds) @ self.weights, bounds)
        total = np.concatenate([[0], np.cumsum(lengths)])
        part = np.concatenate([[0], np.cumsum(lengths * good)])
        weight = total[bounds[1:]] - total[bounds[:-1]]
        return np.where(weight > 0, (part[bounds[1:]] - part[bounds[:-1]]) / np.maximum(weight, 1e-9), 0.5)

    def probability(self, share: np.ndarray) -> np.ndarray:
        x = np.clip(share, 1e-3, 1 - 1e-3)
        return 1 / (1 + np.exp(-(self.slope * np.log(x / (1 - x)) + self.shift)))


def fit(features: np.ndarray, lengths: np.ndarray, bounds: np.ndarray, labels: np.ndarray, steps: int = 250) -> LineChain:
    """Train on texts with labels 0 or 1 by gradient ascent (Adam) on the penalised likelihood of line labels.

    Texts weigh the same whatever their number of lines. Without both labels the chain stays neutral.
    """
    chain = LineChain(np.zeros(FEATURES), np.zeros((2, 2)))
    rate = labels.mean() if len(labels) else 0.5
    prior = float(np.log((rate * len(labels) + 1) / ((1 - rate) * len(labels) + 1)))
    if len(set(labels.tolist())) < 2:
        return LineChain(chain.weights, chain.moves, 0.0, prior)
    x = with_neighbours(features, bounds)
    lines = np.diff(bounds)
    y = np.repeat(labels, lines).astype(float)
    seen = np.array([[np.sum((lines - 1)[(labels == 0) & (lines > 0)]), 0], [0, np.sum((lines - 1)[(labels == 1) & (lines > 0)])]])
    theta = np.zeros(FEATURES + 4)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for i in range(1, steps + 1):
        chain = LineChain(theta[:FEATURES], theta[FEATURES:].reshape(2, 2))
        good, expected, _ = chain.marginals(x @ chain.weights, bounds, pairs=True)
        slope = np.concatenate([(x.T @ (y - good)), (seen - expected).ravel()]) / max(1, len(y)) - 1e-3 * theta
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        theta = theta + 0.1 * (first / (1 - 0.9**i)) / (np.sqrt(second / (1 - 0.99**i)) + 1e-8)
    chain = LineChain(theta[:FEATURES], theta[FEATURES:].reshape(2, 2))
    share = np.clip(chain.shares(features, lengths, bounds), 1e-3, 1 - 1e-3)
    slope, shift = logistic(np.log(share / (1 - share))[:, None], labels)
    return LineChain(chain.weights, chain.moves, float(slope[0]), float(shift))


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 50) -> tuple[np.ndarray, float]:
    """Logistic regression by Newton steps, with a ridge penalty on the slopes."""
    x = np.column_stack([x, np.ones(len(x))])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    theta = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        pull = x.T @ (y - p) - ridge * theta
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(curve, pull)
        theta = theta + step
        if np.abs(step).max() < 1e-8:
            break
    return theta[:-1], theta[-1]


def drop_low_quality(docs: DataFrame, labels: DataFrame, least: float = 0.3) -> DataFrame:
    """Keep documents whose score is at least ``least``; all columns stay, whatever their names.

    Empty and null texts have the score of a share of one half. Equal texts have equal scores, so repeated rows stay or go
    together. Texts are read whole; an empty table stays empty.
    """
    taken = {c.lower() for c in docs.columns}
    name = next(n for n in (f"quality_{i}" for i in range(len(taken) + 1)) if n not in taken)
    scored = quality(docs, labels, name=name)
    return scored.filter(F.col(name) >= least).select(*[F.col(f"`{c}`") for c in docs.columns])


def fold(parts: int, id_column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % parts


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, usable: Column, bound: int) -> DataFrame:
    """At most ``bound`` texts (doc_id, text, label), those first in order of a hash of the id.

    Labels other than 0 and 1 and ids with different labels are left out. Of an id with several texts the least is used.
    """
    known = (
        labels.select(F.col("doc_id").alias("id"), F.col(target).alias("label"))
        .filter(F.col("id").isNotNull() & F.col("label").isin(0, 1))
        .groupBy("id")
        .agg(F.min("label").alias("label"), F.max("label").alias("high"))
        .filter(F.col("label") == F.col("high"))
        .withColumnRenamed("id", "doc_id")
        .filter(usable)
    )
    order = F.xxhash64(F.lit(target), F.col("doc_id"))
    chosen = F.broadcast(known.select("doc_id", "label").orderBy(order, "doc_id").limit(bound))
    found = docs.select("doc_id", "text").join(chosen, "doc_id")
    return found.groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.first("label").alias("label"))


def train(sample: DataFrame, lines: int = 200) -> LineChain:
    """Fit a chain on a bounded sample (text, label); of very long training texts ``lines`` lines around the middle are used."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            features, lengths, bounds = line_features(batch.column("text"))
            rows = []
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                lo = max(lo, (lo + hi - lines) // 2)
                rows.append(np.column_stack([lengths[lo : min(hi, lo + lines)], features[lo : min(hi, lo + lines)]]).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), batch.column("label")], ["rows", "label"])

    got = map_batches(sample.select("text", F.col("label").cast("int").alias("label")), run, "rows binary, label int").collect()
    parts = [np.frombuffer(r["rows"]).reshape(-1, OWN + 1) for r in got]
    parts, labels = [p for p in parts if len(p)], np.array([r["label"] for r, p in zip(got, parts) if len(p)], dtype=int)
    if not parts:
        return fit(np.zeros((0, OWN)), np.zeros(0), np.zeros(1, np.int64), labels)
    every = np.concatenate(parts)
    return fit(every[:, 1:], every[:, 0], np.concatenate([[0], np.cumsum([len(p) for p in parts])]), labels)


def score(docs: DataFrame, chain: LineChain, name: str = "quality_score") -> DataFrame:
    """All columns of ``docs`` and ``name``, the score from the whole text alone; a column of that name is replaced.

    Null text counts as empty and gets the score of a share of one half.
    """
    rest = [f for f in docs.schema.fields if f.name != name]
    columns = [F.col(f"`{f.name}`") for f in rest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            step = max(1, min(512, whole.num_rows * (1 << 22) // max(1, whole.nbytes)))
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                result = chain.probability(chain.shares(*line_features(batch.column("text"))))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(result, pa.float64())], [*batch.schema.names, name])

    return map_batches(docs.select(*columns), run, T.StructType([*rest, T.StructField(name, T.DoubleType())]))


def quality(
    docs: DataFrame, labels: DataFrame, sample: int = 4000, parts: int = 5, name: str = "quality_score"
) -> DataFrame:
    """Score documents (doc_id, text) after training on labels (doc_id, quality) of ids outside fold 0 of ``parts``.

    At most ``sample`` labelled texts train the model. All columns of ``docs`` come back with ``name``
    (0 to 1, higher is better). Without labels of both kinds the score is their smoothed rate.

    Texts are scored whole; of a training text beyond 200 lines, the 200 in its middle teach. Null and empty texts have no line and the score
    of a share of one half. Equal texts have equal scores, however often they are repeated. An empty table gives no rows. Other columns keep
    their values, and a column called ``name`` is replaced.
    """
    chosen = labelled_sample(docs, labels, "quality", fold(parts) != 0, sample)
    return score(docs, train(chosen), name)
