"""Alignment of two tokenizers' cuts of the same text, by merging the ends of their tokens.

Both lists of token ends are sorted, so merging them tells which tokens overlap: every distinct end closes one stretch of bytes
that belongs to one token of A and one of B. The merge path of a batch of texts is cut by binary searches along its
diagonals into pieces of equal numbers of steps, wherever texts begin; a piece knows from its two corners all it
needs and emits its links and the ends common to both. A group that crosses corners is stitched from the last common
end of the pieces before and the first one after.

How often a pair of ids is linked in the corpus is counted by documents. Pairs held by many documents are few and are broadcast; the
others meet their counts in a shuffle, in which no key is hot.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from counterscope.llm.batches import slices
from counterscope.llm.shared import BROADCAST_LIMIT, map_batches, staged

STEPS = 1 << 14
LONG = 1 << 20
SPACE = "▁"


@dataclass(frozen=True)
class BytePairs:
    """Byte-pair ranks in a file, applied to a space and the text; special tokens in a text are plain text."""

    ranks: str

    def load(self):
        import public_tokenizers
        import tiktoken

        with open(self.ranks, "rb") as lines:
            order = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        known = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=order, special_tokens={})
        table = [b""] * (max(order.values()) + 1)
        for entry, i in order.items():
            table[i] = entry
        return lambda texts: known.encode_ordinary_batch([" " + t for t in texts], num_threads=1), table


@dataclass(frozen=True)
class SentencePieces:
    """A sentencepiece model, which puts a space before the text by itself."""

    model: str

    def load(self):
        import sentencepiece

        known = sentencepiece.SentencePieceProcessor(model_file=self.model)

        def entry(i: int) -> bytes:
            piece = known.id_to_piece(i)
            return bytes([int(piece[3:5], 16)]) if known.is_byte(i) else piece.replace(SPACE, " ").encode()

        return lambda texts: known.encode(texts, num_threads=1), [entry(i) for i in range(known.get_piece_size())]


class Side:
    """One tokenizer in a worker: its encoder, the bytes of each id, and their numbers."""

    def __init__(self, spec: BytePairs | SentencePieces):
        self.encode, self.table = spec.load()
        self.lengths = np.array([len(x) for x in self.table])
        self.size = len(self.table)
        self.written = {sign: np.array([f"{i}{sign}" for i in range(self.size)], dtype=object) for sign in ",|;"}

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text. A long text is cut before single spaces between words, where no token reaches across."""
        parts = [list(_parts(t)) for t in texts]
        flat = self.encode([p for x in parts for p in x])
        out, at = [], 0
        for x in parts:
            own = [np.array(i, dtype=np.int64) for i in flat[at : at + len(x)]]
            out.append(own[0] if len(own) == 1 else np.concatenate(own))
            at += len(x)
        return out

    def text(self, ids: np.ndarray) -> bytes:
        return b"".join([self.table[i] for i in ids.tolist()])


def _parts(text: str, long: int = LONG) -> Iterator[str]:
    """Pieces of a long text without the space between two of them, as either encoder puts one before each."""
    at = 0
    while len(text) - at > long:
        cut = text.find(" ", at + long)
        while cut > 0 and not (text[cut - 1].isalnum() and text[cut + 1 : cut + 2].isalnum()):
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut + 1
    yield text[at:]


@lru_cache(maxsize=4)
def _side(spec: BytePairs | SentencePieces) -> Side:
    return Side(spec)


def corners(a: np.ndarray, b: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """How many of ``a`` and of ``b`` the merge has taken after every ``steps`` steps; a goes before an equal b."""
    diagonal = np.append(np.arange(0, len(a) + len(b), steps), len(a) + len(b))
    low, high = np.maximum(0, diagonal - len(b)), np.minimum(diagonal, len(a))
    while (open_ := low < high).any():
        middle = (low + high) // 2
        at, other = np.minimum(middle, len(a) - 1), np.clip(diagonal - 1 - middle, 0, len(b) - 1)
        ahead = a[at] <= b[other]
        low = np.where(open_ & ahead, middle + 1, low)
        high = np.where(open_ & ~ahead, middle, high)
    return low, diagonal - low


def piece(a: np.ndarray, b: np.ndarray, i0: int, i1: int, j0: int, j1: int):
    """Of the steps from corner (i0, j0) to (i1, j1): linked tokens of a and of b, and the numbers taken at common ends."""
    own_a, own_b = a[i0:i1], b[j0:j1]
    at_b = j0 + np.searchsorted(own_b, own_a, "left")
    at_a = i0 + np.searchsorted(own_a, own_b, "right")
    common = (at_a > 0) & (a[at_a - 1] == own_b)
    j = np.arange(j0, j1)
    links_a = np.concatenate([np.arange(i0, i1), at_a[~common]])
    links_b = np.concatenate([at_b, j[~common]])
    return links_a, links_b, at_a[common], j[common] + 1


def merged(a: np.ndarray, b: np.ndarray, steps: int = STEPS):
    """All links (token of a, token of b) and the ends of all groups (tokens of a, tokens of b so far) of two lists of ends."""
    i, j = corners(a, b, steps)
    done = [piece(a, b, *x) for x in zip(i[:-1].tolist(), i[1:].tolist(), j[:-1].tolist(), j[1:].tolist())]
    return [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (list(zip(*done)) or [[]] * 4)]


def _group_texts(a: Side, b: Side, ids_a, ids_b, ends_a, ends_b) -> np.ndarray:
    """Every token's id and the sign after it, in the order of groups of a-ids and b-ids."""
    start_a, start_b = np.append(0, ends_a[:-1]), np.append(0, ends_b[:-1])
    out = np.empty(len(ids_a) + len(ids_b), dtype=object)
    group_a = np.repeat(np.arange(len(ends_a)), ends_a - start_a)
    group_b = np.repeat(np.arange(len(ends_b)), ends_b - start_b)
    place_a, place_b = np.arange(len(ids_a)) + start_b[group_a], np.arange(len(ids_b)) + ends_a[group_b]
    out[place_a], out[place_b] = a.written[","][ids_a], b.written[","][ids_b]
    out[place_a[ends_a - 1]], out[place_b[ends_b - 1]] = a.written["|"][ids_a[ends_a - 1]], b.written[";"][ids_b[ends_b - 1]]
    return out


_OUT = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, groups_sha256 string, pairs array<long>, times array<int>"
)


def aligned(docs: DataFrame, a: BytePairs | SentencePieces, b: BytePairs | SentencePieces, keep_groups: bool = True) -> DataFrame:
    """Align the tokens of every text of documents (doc_id, text) under two tokenizers.

    Returns one row per input row: doc_id, n_a, n_b, n_groups, n_links, groups (ids of a and b between common ends, as
    ``a1,a2|b1;a3|b2``; left null without ``keep_groups``), groups_sha256, and the distinct linked pairs as a number
    (id of a times the size of b's vocabulary, plus id of b) with the times each occurs.

    Null and empty texts, and texts that the bytes of either's tokens do not spell, have no tokens: zeros, empty text and no digest
    (''). A text is aligned whole; one beyond a million characters is encoded in parts between words. A task holds the tokens of some
    4 MB of text or of one longer text. Repeated rows have equal results, an empty table gives none, and other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = _side(a), _side(b)
        for batch in slices(batches):
            texts = [x or "" for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *_align(one, two, texts, keep_groups)], _NAMES)

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")), run, _OUT)


_NAMES = [x.split()[0] for x in _OUT.split(", ")]


def _align(one: Side, two: Side, texts: list[str], keep_groups: bool) -> list[pa.Array]:
    n = len(texts)
    at = [i for i, t in enumerate(texts) if t]
    tokens = []
    for i, x, y in zip(at, one.ids([texts[i] for i in at]), two.ids([texts[i] for i in at])):
        spelled = (" " + texts[i]).encode()
        if one.text(x) == spelled and two.text(y) == spelled:
            tokens.append((i, x, y))
    groups, digests = [""] * n if keep_groups else [None] * n, [""] * n
    counts = np.zeros((4, n), dtype=np.int64)
    if not tokens:
        empty = pa.array([[]] * n, pa.list_(pa.int64())), pa.array([[]] * n, pa.list_(pa.int32()))
        return [*map(pa.array, counts), pa.array(groups, pa.string()), pa.array(digests), *empty]
    at = np.array([t[0] for t in tokens])
    counts[0, at], counts[1, at] = [len(t[1]) for t in tokens], [len(t[2]) for t in tokens]
    ids_a, ids_b = np.concatenate([t[1] for t in tokens]), np.concatenate([t[2] for t in tokens])
    # one line of bytes for all texts: where a text ends, tokens of both end, so no link or group leaves its text
    links_a, links_b, ends_a, ends_b = merged(np.cumsum(one.lengths[ids_a]), np.cumsum(two.lengths[ids_b]))
    row_of_a = np.repeat(at, counts[0, at])
    counts[2] = np.bincount(row_of_a[ends_a - 1], minlength=n)
    row = row_of_a[links_a]
    counts[3] = np.bincount(row, minlength=n)

    texts_of = _group_texts(one, two, ids_a, ids_b, ends_a, ends_b)
    high = np.cumsum(counts[0] + counts[1])
    for i in at.tolist():
        joined = "".join(texts_of[high[i] - counts[0, i] - counts[1, i] : high[i]])[:-1]
        digests[i] = hashlib.sha256(joined.encode()).hexdigest()
        if keep_groups:
            groups[i] = joined

    if n * one.size * two.size >= 1 << 63:
        raise ValueError("two vocabularies of this size are too large for 64-bit pairs")
    keys = np.sort(row * (one.size * two.size) + ids_a[links_a] * two.size + ids_b[links_b])
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    times = np.diff(np.append(first, len(keys))).astype(np.int32)
    row, pair = np.divmod(keys[first], one.size * two.size)
    offsets = pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (pair, times)]
    return [*map(pa.array, counts), pa.array(groups, pa.string()), pa.array(digests), *lists]


def vocabulary_size(spec: BytePairs | SentencePieces) -> int:
    return _side(spec).size


def link_counts(docs: DataFrame, a: BytePairs | SentencePieces, b: BytePairs | SentencePieces, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Alignment of every document (doc_id, text) with how common its links are in the corpus.

    A pair of ids counts once for each row whose text links it, however often; repeated rows count each. Returns one row per input row: doc_id, n_a, n_b,
    n_groups, n_links, n_best (links whose pair no other pair with their id of a exceeds), count_sum (sum of
    the counts over all links) and groups_sha256. Nulls, empty and long texts as in ``aligned``. At most ``limit`` pairs
    are broadcast; this changes no result.
    """
    fields = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    rows = aligned(docs, a, b, keep_groups=False).drop("groups").withColumn("row", F.monotonically_increasing_id())
    rows = staged(rows, "aligned")
    counts = rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("held"))
    counts = counts.withColumn("id", F.expr(f"pair div {vocabulary_size(b)}"))
    # as many rows as there are ids of a at most
    best = counts.groupBy("id").agg(F.max("held").alias("best"))
    known = staged(counts.join(F.broadcast(best), "id").select("pair", "held", (F.col("held") == F.col("best")).alias("is_best")), "pairs")
    powers = [F.count(F.when(F.col("held") >= (1 << p), 1)).alias(str(p)) for p in range(63)]
    sums = known.agg(*powers).first()
    least = next((1 << p for p in range(63) if sums[str(p)] <= limit), 1 << 62)

    links = rows.select(*fields, F.explode_outer(F.arrays_zip("pairs", "times")).alias("link"))
    links = links.select(*fields, F.col("link.pairs").alias("pair"), F.col("link.times").alias("times"))
    found = links.join(F.broadcast(known.where(F.col("held") >= least)), "pair", "left")
    if least > 1:
        met = found.where(F.col("held").isNotNull() | F.col("pair").isNull())
        rest = links.join(F.broadcast(known.where(F.col("held") >= least)), "pair", "left_anti").where(F.col("pair").isNotNull())
        found = met.unionByName(rest.join(known.where(F.col("held") < least), "pair"))
    times = F.col("times").cast("long")
    summed = found.groupBy(*fields).agg(
        F.coalesce(F.sum(F.when(F.col("is_best"), times)), F.lit(0)).cast("long").alias("n_best"),
        F.coalesce(F.sum(times * F.col("held")), F.lit(0)).cast("long").alias("count_sum"),
    )
    return summed.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
