"""Best-fit packing of token sequences with a swap-based local search.

Texts longer than a sequence are cut from their end into full pieces, so only a first piece may be shorter. Full
pieces fill sequences by themselves. The others are dealt to groups of bounded size; a group is packed best
fit first, longest pieces first, and then improved: an underfull bin takes a piece from an emptier one, or exchanges one
piece for a longer one, or two pieces for one, or one for two. Every step raises the sum of squared fills, so fuller bins fill up
and emptier ones drain until they can be closed. What stays underfull is dealt anew to fewer groups and
improved again, turn by turn.
"""

from __future__ import annotations

import base64
import itertools
import zlib
from bisect import insort
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from counterscope.llm.shared import map_batches, ship, staged

END_OF_TEXT = 2
SPECIAL = {"<|endoftext|>": 50256}  # of byte_bpe_50k.json
GROUP = 50_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@lru_cache(maxsize=4)
def encoder(vocabulary: str | None, ranks: str | None, special: bool = False):
    """A function from a text to its token ids.

    ``vocabulary`` is a tokenizer file. ``ranks`` is the same byte-pair vocabulary in rank form: its encoder gives
    the same ids several times faster, and is used if given. With ``special`` a special token spelled out in a text is one
    id, as an unchanged ``Tokenizer`` has it; else it is plain text.
    """
    import public_tokenizers

    if ranks is None:
        from tokenizers import Tokenizer

        known = Tokenizer.from_file(vocabulary or public_tokenizers.path("byte_bpe_50k.json"))
        known.encode_special_tokens = not special
        return lambda text: known.encode(text, add_special_tokens=False).ids
    import tiktoken

    with open(ranks, "rb") as lines:
        order = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=order, special_tokens=SPECIAL)
    return (lambda text: fast.encode(text, allowed_special="all")) if special else fast.encode_ordinary


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; only the first may be shorter than the capacity."""
    first = n % capacity if n > capacity else n
    ends = list(range(first or capacity, n + 1, capacity))
    return [(0, ends[0])] + [(a, b - a) for a, b in zip(ends, ends[1:])]


def token_pieces(
    docs: DataFrame, capacity: int = 1024, vocabulary: str | None = None, ranks: str | None = None, keep_ids: bool = False
) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32) of documents (doc_id, text); with ``keep_ids`` also their token ids.

    A document's tokens are its text's and END_OF_TEXT; null text counts as empty, so every row has a piece. A long text is tokenized
    whole and cut into pieces of ``capacity``. Rows with equal doc_id or text each have their own pieces. An empty table gives none; columns other than
    doc_id and text, whatever their names, are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, ranks, special=True)
        names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = []
                for doc, text in zip(batch["doc_id"][at : at + 256].to_pylist(), batch["text"][at : at + 256]):
                    ids = np.array([*encode(text.as_py() or ""), END_OF_TEXT], dtype="<u4")
                    for i, (start, length) in enumerate(cut(len(ids), capacity)):
                        part = ids[start : start + length]
                        rows.append((doc, i, start, length, zlib.crc32(part.tobytes()), part.astype(np.int32) if keep_ids else None))
                columns = list(zip(*rows))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)][: len(names)], names)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_batches(texts, run, PIECES + (", ids array<int>" if keep_ids else ""))


class Bins:
    """Bins of a group: the lengths' positions in each, and how full each is."""

    def __init__(self, lengths: np.ndarray, capacity: int, bins: list[list[int]] | None = None):
        self.lengths, self.capacity = lengths.tolist(), capacity
        self.bins = bins if bins is not None else self._best_fit()
        self.fill = [sum(self.lengths[i] for i in b) for b in self.bins]

    def _best_fit(self) -> list[list[int]]:
        """Longest first, each into the fullest bin that has room. One bit per size of room finds that bin."""
        bins, rooms, open_ = [], [[] for _ in range(self.capacity + 1)], 0
        for i in np.argsort(-np.array(self.lengths), kind="stable").tolist():
            size = self.lengths[i]
            fitting = open_ >> size
            if fitting:
                room = size + (fitting & -fitting).bit_length() - 1
                b = rooms[room].pop()
                if not rooms[room]:
                    open_ &= ~(1 << room)
                bins[b].append(i)
            else:
                room, b = self.capacity, len(bins)
                bins.append([i])
            if room > size:
                rooms[room - size].append(b)
                open_ |= 1 << (room - size)
        return bins

    def improve(self) -> None:
        """Local search over underfull bins until a round no longer raises the sum of squared fills."""
        squares = -1
        while (now := sum(f * f for f in self.fill)) > squares and self._round():
            squares = now
        kept = [b for b in range(len(self.bins)) if self.bins[b]]
        self.bins, self.fill = [self.bins[b] for b in kept], [self.fill[b] for b in kept]

    def _round(self) -> bool:
        under = [b for b in range(len(self.bins)) if 0 < self.fill[b] < self.capacity]
        under.sort(key=lambda b: (-self.fill[b], b))
        self.place = {b: i for i, b in enumerate(under)}
        # holders[size]: places of underfull bins with a piece of that size, emptiest last; singles and pairs
        self.ones: list[list[int]] = [[] for _ in range(self.capacity + 1)]
        self.twos: list[list[int]] = [[] for _ in range(self.capacity + 1)]
        self.one_bits = self.two_bits = 0
        self.under = under
        for b in under:
            self._index(b)
        changed = False
        for i, b in enumerate(under):
            while 0 < self.fill[b] < self.capacity and self._fill_up(i, b):
                changed = True
        return changed

    def _sums(self, b: int) -> tuple[set[int], set[int]]:
        sizes = Counter(self.lengths[i] for i in self.bins[b])
        distinct = list(sizes)  # few: different sizes that fit one bin
        pairs = {x + y for k, x in enumerate(distinct) for y in distinct[k + 1 :]}
        return set(distinct), pairs | {2 * x for x, n in sizes.items() if n > 1}

    def _index(self, b: int) -> None:
        ones, twos = self._sums(b)
        for s in ones:
            insort(self.ones[s], self.place[b])
            self.one_bits |= 1 << s
        for s in twos:
            insort(self.twos[s], self.place[b])
            self.two_bits |= 1 << s

    def _forget(self, b: int) -> None:
        ones, twos = self._sums(b)
        for s in ones:
            self.ones[s].remove(self.place[b])
            if not self.ones[s]:
                self.one_bits &= ~(1 << s)
        for s in twos:
            self.twos[s].remove(self.place[b])
            if not self.twos[s]:
                self.two_bits &= ~(1 << s)

    def _fill_up(self, i: int, b: int) -> bool:
        """The best exchange for bin b with an emptier one: give nothing, one or two pieces, take a longer one or two."""
        room = self.capacity - self.fill[b]
        mine, my_pairs = self._sums(b)
        best = None
        offers = [(0, 0)] + [(s, 1) for s in mine] + [(s, 2) for s in my_pairs]
        for given, n_given in offers:
            wanted = [(self.ones, self.one_bits, 1)] + ([(self.twos, self.two_bits, 2)] if n_given < 2 else [])
            for holders, bits, n_taken in wanted:
                left = bits & ((1 << (given + room + 1)) - 1)
                while left:
                    size = left.bit_length() - 1
                    gain = size - given
                    if gain <= 0 or (best and gain <= best[0]):
                        break
                    if holders[size][-1] > i:
                        best = (gain, given, n_given, size, n_taken, self.under[holders[size][-1]])
                        break
                    left &= ~(1 << size)
            if best and best[0] == room:
                break
        if not best:
            return False
        _, given, n_given, size, n_taken, other = best
        self._forget(b)
        self._forget(other)
        out, back = self._pick(b, given, n_given), self._pick(other, size, n_taken)
        for k in out:
            self.bins[b].remove(k)
        for k in back:
            self.bins[other].remove(k)
        self.bins[b] += back
        self.bins[other] += out
        self.fill[b] += size - given
        self.fill[other] += given - size
        if self.fill[b] < self.capacity:
            self._index(b)
        if self.bins[other]:
            self._index(other)
        return True

    def _pick(self, b: int, total: int, n: int) -> list[int]:
        """Positions of one or two pieces of bin b that add up to a total."""
        items = self.bins[b]
        if n == 0:
            return []
        if n == 1:
            return [next(k for k in items if self.lengths[k] == total)]
        seen: dict[int, int] = {}
        for k in items:
            if total - self.lengths[k] in seen:
                return [seen[total - self.lengths[k]], k]
            seen[self.lengths[k]] = k
        raise ValueError("no such pair")


def _pack_group(capacity: int, again: bool):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "piece", "start", "ids_crc32"], kind="stable").reset_index(drop=True)
        lengths = rows["length"].to_numpy()
        start = [g.tolist() for g in rows.groupby("sequence_id").indices.values()] if again else None
        bins = Bins(lengths, capacity, start)
        bins.improve()
        sequence, offset, fill = (np.zeros(len(rows), dtype=np.int64) for _ in range(3))
        for b, items in enumerate(bins.bins):
            sequence[items] = b
            offset[items] = np.concatenate([[0], np.cumsum(lengths[items])[:-1]])
            fill[items] = bins.fill[b]
        return rows.assign(sequence_id=sequence + (int(key[0]) << 32), offset=offset, fill=fill)[_COLUMNS]

    return run


_PACKED = PIECES + ", sequence_id long, offset long, fill long"
_COLUMNS = [c.split()[0] for c in _PACKED.split(", ")]


def pack(pieces: DataFrame, capacity: int = 1024, group: int = GROUP, least_gain: float = 0.001) -> DataFrame:
    """Place pieces (doc_id, piece, start, length, ids_crc32) into sequences of at most ``capacity`` tokens.

    Returns the pieces with sequence_id, offset (gapless from 0 in each sequence) and fill. ``group`` bounds how many pieces
    are packed together; no piece is left out. What stays in underfull sequences is dealt anew and improved again, until it fits one group
    or a turn closes fewer than ``least_gain`` of these sequences.

    Repeated rows are pieces of their own, and pieces of equal length may change places between runs over other partitions. An empty
    table gives no rows. Other columns are not read.
    """
    pieces = staged(pieces, "pieces")
    short = pieces.filter(F.col("length") < capacity)
    groups = max(1, -(-short.count() // group))
    ship(pieces.sparkSession)
    deal = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)).alias("deal")
    dealt = short.select(*PIECES_COLUMNS, F.lit(0).cast("long").alias("sequence_id"), deal)
    packed = staged(dealt.groupBy("deal").applyInPandas(_pack_group(capacity, False), _PACKED), "packed")
    closed = pieces.filter(F.col("length") >= capacity).select(
        *PIECES_COLUMNS,
        (-1 - F.monotonically_increasing_id()).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
        F.col("length").alias("fill"),
    )
    for turn in itertools.count(1):
        loose = packed.filter(F.col("fill") < capacity)
        n = loose.agg(F.count("*").alias("pieces"), F.count_if(F.col("offset") == 0).alias("bins")).first()
        if turn > 1 and (groups == 1 or before - n["bins"] < least_gain * before):
            return closed.unionByName(packed)
        groups, before = max(1, -(-n["pieces"] // group)), n["bins"]
        closed = closed.unionByName(packed.filter(F.col("fill") >= capacity))
        deal = F.pmod(F.xxhash64("sequence_id"), F.lit(groups)).alias("deal")
        dealt = loose.select(*PIECES_COLUMNS, "sequence_id", deal)
        packed = dealt.groupBy("deal").applyInPandas(_pack_group(capacity, True), _PACKED)
        # numbers of a turn begin where those of the one before end
        packed = staged(packed.withColumn("sequence_id", F.col("sequence_id") + F.lit(turn << 56)), "packed")


PIECES_COLUMNS = [c.split()[0] for c in PIECES.split(", ")]


def pack_documents(
    docs: DataFrame, capacity: int = 1024, vocabulary: str | None = None, ranks: str | None = None, group: int = GROUP
) -> DataFrame:
    """Tokenize documents (doc_id, text) and pack them; see ``token_pieces`` and ``pack``."""
    return pack(token_pieces(docs, capacity, vocabulary, ranks), capacity, group)


def sequences(docs: DataFrame, placed: DataFrame, capacity: int = 1024, vocabulary: str | None = None, ranks: str | None = None) -> DataFrame:
    """The sequences themselves (sequence_id, ids): the tokens of ``placed`` pieces of ``docs``, in order of their offsets.

    ``doc_id`` must be unique in ``docs``.
    """
    pieces = token_pieces(docs, capacity, vocabulary, ranks, keep_ids=True).select("doc_id", "piece", "ids")
    joined = placed.select("doc_id", "piece", "sequence_id", "offset").join(pieces, ["doc_id", "piece"])
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return joined.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
