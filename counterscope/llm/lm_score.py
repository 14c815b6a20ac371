"""Language-model scores by stupid backoff, joined from n-gram count tables.

The model has words and word pairs. S(w | v) is c(v w) / c(v) where the pair occurs at least ``least`` times in the corpus,
and alpha c(w) / N otherwise; the first word of a text has c(w) / N. Every word and every pair counts, however rare.

Words that make up at least one in ``hot`` of all words have numbers and are broadcast with their counts; the others are told
apart by their 64-bit hashes. Pairs of numbered words are two numbers in one integer. Those frequent anywhere are found as heavy
hitters: what makes up 1 / (2 h) of a batch is counted there, and what reaches N / (2 h) in sum is in the head. The head
has at most 2 h pairs and contains every pair with more than N / h occurrences; it is broadcast. All other n-grams are partitioned
by the hash of the pair, or of the rare word in it: a partition sums up its count table and looks its n-grams up there, and what they
add to a text's score goes back to the text. No key of a partition is hot, as h grows with the corpus. A pair of two rare words is sent
to both, as each knows its own count only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from counterscope.llm.batches import slices
from counterscope.llm.shared import map_batches, staged, text_key
from counterscope.llm.words import Words, mixed

UNKNOWN = 0
SHIFT = 22  # bits of the second word number in a pair
HEAVY = 1 << 19  # pairs that make up more than one in this many are in the head
BATCH = 1 << 22  # pairs among which heavy hitters are looked for at a time
MOST = 1 << 22  # occurrences of a pair outside the head, at most
TASK = 1 << 21  # rows that count in one task, on average
# What a shuffled row is about: two numbered words; a rare word before a numbered one, or after one; two rare words, sent to
# the second, or to the first; a rare word at the beginning of a text. Kept in the last three bits of ``pair``, above which is the
# other word's number, or 48 bits of its hash: ``key`` is the rare word (or the two numbers), so few others are to be told apart.
BOTH_HOT, BEFORE_HOT, AFTER_HOT, SECOND, FIRST, START = range(6)


class Table:
    """Lookup of sorted 64-bit keys by their first bits."""

    BITS = 18

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.starts = np.searchsorted(keys >> np.uint64(64 - self.BITS), np.arange((1 << self.BITS) + 1, dtype=np.uint64))
        self.longest = int(np.diff(self.starts).max()) if len(keys) else 0

    def find(self, values: np.ndarray) -> np.ndarray:
        """Position of each value, -1 if it is no key."""
        at = (values >> np.uint64(64 - self.BITS)).astype(np.int64)
        low, high = self.starts[at], self.starts[at + 1]
        out = np.full(len(values), -1, dtype=np.int64)
        for i in range(self.longest):
            place = low + i
            hit = (place < high) & (self.keys[np.minimum(place, len(self.keys) - 1)] == values)
            out[hit] = place[hit]
        return out


def spread(pairs: np.ndarray) -> np.ndarray:
    """Scramble pairs reversibly, so that their first bits are even."""
    with np.errstate(over="ignore"):
        return pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def _unique(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values = np.sort(values)
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return values[first], np.diff(np.append(first, len(values)))


class Numbers:
    """Word numbers and pairs of a batch under a vocabulary (known hashes sorted, their counts).

    Number 0 is all other words: as one word if ``merged``, else they are rare words with hashes only.
    """

    def __init__(self, vocabulary: Broadcast):
        self.known, self.counts, self.total, self.merged = vocabulary.value
        self.table = Table(self.known)
        self.logs = np.log10(np.maximum(self.counts, 1) / max(1, self.total))

    def rare(self, numbers: np.ndarray) -> np.ndarray:
        return np.zeros(len(numbers), dtype=bool) if self.merged else numbers == UNKNOWN

    def read(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Word numbers and hashes, text bounds, and for every word but the first of a text: its position and its pair."""
        words = Words(column)
        numbers = self.table.find(words.hashes) + 1
        inner = np.ones(len(numbers), dtype=bool)
        inner[words.bounds[:-1][words.bounds[:-1] < len(numbers)]] = False
        at = np.flatnonzero(inner)
        return numbers, words.hashes, words.bounds, at, (numbers[at - 1] << SHIFT) | numbers[at]


def _vocabulary(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Sorted hashes of words that make up at least 1 / size of all, the counts by number (unknown first), all words."""

    def summed(parts: list) -> tuple[np.ndarray, np.ndarray]:
        hashes, n = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(hashes)
        known, first = np.unique(hashes[order], return_index=True)
        return known, np.add.reduceat(n[order], first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in slices(batches):
            parts.append(_unique(Words(batch.column("text")).hashes))
            size += len(parts[-1][0])
            if size > 1_000_000:
                parts = [summed(parts)]
                size = len(parts[0][0])
            if size > 700_000:
                yield rows(parts)
                parts, size = [], 0
        if size:
            yield rows(parts)

    def rows(parts: list) -> pa.RecordBatch:
        hashes, n = summed(parts)
        return pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(n)], ["word", "n"])

    words = map_batches(docs.select("text"), run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words = staged(words, "words")
    total = words.agg(F.sum("n")).first()[0] or 0
    rows = words.filter(F.col("n") * size >= total).select("word", "n").toArrow()  # at most ``size`` rows of 16 bytes
    hashes = rows.column("word").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    counts = rows.column("n").to_numpy()[order]
    return hashes[order], np.concatenate([[total - counts.sum()], counts]), total


def _head(docs: DataFrame, vocabulary: Broadcast, heavy: int, total: int) -> np.ndarray:
    """Scrambled pairs that are frequent over the corpus, sorted; at most 2 * heavy."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, parts, size = Numbers(vocabulary), [], 0
        for batch in slices(batches):
            number, _, _, at, pairs = numbers.read(batch.column("text"))
            rare = numbers.rare(number)
            parts.append(pairs[~(rare[at - 1] | rare[at])])
            size += len(parts[-1])
            if size >= BATCH:
                yield frequent(parts)
                parts, size = [], 0
        if size:
            yield frequent(parts)

    def frequent(parts: list[np.ndarray]) -> pa.RecordBatch:
        pairs, n = _unique(np.concatenate(parts))
        keep = n * 2 * heavy >= n.sum()
        return pa.RecordBatch.from_arrays([pa.array(pairs[keep]), pa.array(n[keep])], ["pair", "n"])

    sums = map_batches(docs.select("text"), run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    rows = sums.filter(F.col("n") * 2 * heavy >= total).select("pair").toArrow()  # at most 2 * heavy rows of 8 bytes
    return np.sort(spread(rows.column("pair").to_numpy()))


def lm_scores(
    docs: DataFrame, least: int = 2, alpha: float = 0.4, vocabulary: int | None = None, heavy: int | None = None, hot: int = (1 << SHIFT) - 1
) -> DataFrame:
    """Score every text of documents (doc_id, text) under the counts of all of them.

    A word is a run of anything but white space, A-Z lower-cased. Returns one row per input row: doc_id, n_words,
    n_backoff (words scored by backing off), log10_sum and log10_mean of S (null without words). Null text counts as
    empty. Rows that repeat doc_id and text have equal scores, and their words count as often as they occur.
    With a ``vocabulary`` words rarer than one in so many count as one unknown word. ``hot`` and ``heavy`` say what is
    broadcast and change no score; by default ``heavy`` grows with the corpus so that no pair outside the head occurs more than ``MOST``
    times. Texts are read whole; a task holds the words of some 4 MB of text or of one longer text, and a count task some ``TASK`` rows. An
    empty table gives no rows. Other columns, whatever their names, are not read.
    """
    if max(vocabulary or hot, 1) >= 1 << SHIFT:
        raise ValueError(f"at most {(1 << SHIFT) - 1} words can have numbers")
    spark = docs.sparkSession
    context = spark.sparkContext
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), F.col("text"))
    known = (*_vocabulary(texts, vocabulary or hot), vocabulary is not None)
    words = context.broadcast(known)
    heavy = heavy or max(HEAVY, known[2] // MOST)
    head = context.broadcast(_head(texts, words, heavy, known[2]))

    def tail(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, table = Numbers(words), Table(head.value)
        for batch in slices(batches):
            number, hashes, bounds, at, pairs = numbers.read(batch.column("text"))
            rare = numbers.rare(number)
            before, after = rare[at - 1], rare[at]
            cold = np.flatnonzero(~before & ~after & (table.find(spread(pairs)) < 0))
            starts = bounds[:-1][bounds[:-1] < bounds[1:]]
            starts = starts[rare[starts]]
            v, w = at[before] - 1, at[after]
            others = [
                np.where(rare[x], (hashes[x] >> np.uint64(16)).astype(np.int64), number[x]) << 3 | np.where(rare[x], a, b)
                for x, a, b in ((v + 1, FIRST, BEFORE_HOT), (w - 1, SECOND, AFTER_HOT))
            ]
            row = np.searchsorted(bounds, np.concatenate([at[cold], v, w, starts]), "right") - 1
            key = np.concatenate([pairs[cold], *(hashes[x].view(np.int64) for x in (v, w, starts))])
            pair = np.concatenate([np.full(len(cold), BOTH_HOT), *others, np.full(len(starts), START)])
            # by text, and equal rows together; should hashes meet, a row comes twice and is summed where it is counted
            order = np.argsort(row.astype(np.uint64) << np.uint64(54) | mixed((key ^ pair * 0x1E3779B97F4A7C15).view(np.uint64)) >> np.uint64(10))
            row, key, pair = row[order], key[order], pair[order]
            fresh = (row[1:] != row[:-1]) | (key[1:] != key[:-1]) | (pair[1:] != pair[:-1])
            first = np.flatnonzero(np.concatenate([[True], fresh])) if len(row) else row
            n = np.diff(np.append(first, len(row)))
            take = pa.array(row[first])
            columns = [batch.column("doc_id").take(take), batch.column("text_key").take(take)]
            columns += [pa.array(x) for x in (key[first], pair[first], n)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "key", "pair", "n"])

    def head_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, table = Numbers(words), Table(head.value)
        counts = np.zeros(len(head.value), dtype=np.int64)
        for batch in slices(batches):
            found = table.find(spread(numbers.read(batch.column("text"))[4]))
            counts += np.bincount(found[found >= 0], minlength=len(counts))
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["place", "n"])

    sums = map_batches(texts.select("text"), head_counts, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    head_n = np.zeros(len(head.value), dtype=np.int64)
    head_n[sums.column("place").to_numpy()] = sums.column("n").to_numpy()  # a row per head pair
    head_sums = context.broadcast(head_n)

    # log10 of c(v w) / c(v) over alpha c(w) / N, for pairs that are frequent enough
    def gain(v: np.ndarray, w: np.ndarray, n: np.ndarray, logs: np.ndarray, total: int) -> np.ndarray:
        return np.log10(np.maximum(n, 1)) - logs[v] - np.log10(max(1, total)) - np.log10(alpha) - logs[w]

    def base(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, table = Numbers(words), Table(head.value)
        for batch in slices(batches):
            number, _, bounds, at, pairs = numbers.read(batch.column("text"))
            found = table.find(spread(pairs))
            n = np.where(found >= 0, head_sums.value[np.maximum(found, 0)], 0) if len(head_sums.value) else np.zeros(len(pairs))
            score = numbers.logs[number]
            score[at] += np.log10(alpha)
            more = np.where(n >= least, gain(number[at - 1], number[at], n, numbers.logs, numbers.total), 0.0)
            score[at] += more
            score[numbers.rare(number)] = 0.0  # all of it comes with the counts
            backed = np.zeros(len(number))
            backed[at] = n < least
            sums = [np.concatenate([[0.0], np.cumsum(x)]) for x in (score, backed)]
            parts = [s[bounds[1:]] - s[bounds[:-1]] for s in sums]
            columns = [batch.column("doc_id"), batch.column("text_key"), pa.array(np.diff(bounds)), pa.array(parts[0]), pa.array(parts[1])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "n_words", "score", "backed"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """The rows of one hash partition, each with its key's and its pair's count from the partition's count table."""
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        rows = pa.Table.from_batches(parts)
        key, pair, n = (rows.column(c).to_numpy() for c in ("key", "pair", "n"))
        order = np.lexsort((pair, key))
        key, pair, n = key[order], pair[order], n[order]
        new_key = np.concatenate([[True], key[1:] != key[:-1]])
        new_pair = new_key | np.concatenate([[True], pair[1:] != pair[:-1]])
        # a rare word occurs where it is second or starts a text
        occurs = np.isin(pair & 7, (AFTER_HOT, SECOND, START))
        own, total = (np.add.reduceat(x, np.flatnonzero(at)) for x, at in ((np.where(occurs, n, 0), new_key), (n, new_pair)))
        own, total = own[np.cumsum(new_key) - 1], total[np.cumsum(new_pair) - 1]
        keep = np.flatnonzero((total >= least) | occurs)
        yield rows.select(["doc_id", "text_key"]).take(pa.array(order[keep])), *(x[keep] for x in (key, pair, n, total, own))

    def gains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = Numbers(words)
        for batch, key, pair, n, total, own in counted(batches):
            kind, other = pair & 7, pair >> 3
            often, hot_pair = total >= least, kind == BOTH_HOT
            v = np.where(hot_pair, key >> SHIFT, np.where(kind == AFTER_HOT, other, 0))
            w = np.where(hot_pair, key & ((1 << SHIFT) - 1), np.where(kind == BEFORE_HOT, other, 0))
            log_v, log_w = numbers.logs[v], numbers.logs[w]
            all_words, log_n, log_own = np.log10(max(1, numbers.total)), np.log10(total), np.log10(np.maximum(own, 1))
            backed = np.log10(alpha) + log_own - all_words
            value = np.select(
                [hot_pair, kind == BEFORE_HOT, kind == AFTER_HOT, kind == SECOND, kind == FIRST],
                [
                    gain(v, w, total, numbers.logs, numbers.total),
                    log_n - log_own - np.log10(alpha) - log_w,
                    np.where(often, log_n - log_v - all_words, backed),
                    np.where(often, log_n, backed),
                    -log_own,
                ],
                log_own - all_words,
            )
            hits = np.where(often & (kind != FIRST) & (kind != START), n, 0)
            columns = [batch.column("doc_id"), batch.column("text_key"), pa.array(n * value), pa.array(hits)]
            yield from pa.Table.from_arrays(columns, ["doc_id", "text_key", "gain", "n"]).to_batches(max_chunksize=1 << 16)

    rare = map_batches(texts, tail, "doc_id long, text_key long, key long, pair long, n long")
    # one shuffle by key brings a pair's occurrences together; keys are rare, and there are as many partitions as their rows need
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-known[2] // TASK))
    added = map_batches(rare.repartition(tasks, "key"), gains, "doc_id long, text_key long, gain double, n long")
    added = added.groupBy("doc_id", "text_key").agg(F.sum("gain").alias("gain"), F.sum("n").alias("hits"))
    rows = map_batches(texts, base, "doc_id long, text_key long, n_words long, score double, backed double")
    rows = staged(rows, "lm-rows")
    copies = rows.groupBy(F.col("doc_id").alias("id"), F.col("text_key").alias("key")).agg(F.count("*").alias("copies"))
    shared = added.join(copies, added["doc_id"].eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("key")))
    added = shared.select("id", "key", (F.col("gain") / F.col("copies")).alias("gain"), (F.col("hits") / F.col("copies")).alias("hits"))
    joined = rows.join(added, rows["doc_id"].eqNullSafe(F.col("id")) & (rows["text_key"] == F.col("key")), "left")
    total = F.col("score") + F.coalesce("gain", F.lit(0.0))
    some = F.col("n_words") > 0
    return joined.select(
        rows["doc_id"],
        "n_words",
        F.round(F.col("backed") - F.coalesce("hits", F.lit(0.0))).cast("long").alias("n_backoff"),
        F.when(some, total).alias("log10_sum"),
        F.when(some, total / F.col("n_words")).alias("log10_mean"),
    )
