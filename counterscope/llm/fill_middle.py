"""Fill-in-the-middle examples, cut where a compressed set of boundaries says.

The byte offsets at which a text may be cut, the starts of its code points and its end, are kept as a set of
integers in containers of 2^16 values: a container is a sorted array, a bitmap or a list of runs, whichever is smallest,
and knows how many values lie in the containers before it. The k-th boundary is then found by a search over these cumulative
cardinalities and a selection inside one container, so both cuts of a text cost two lookups, not two walks over its characters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from counterscope.llm.batches import slices
from counterscope.llm.shared import map_batches
from counterscope.llm.words import text_bytes

SPAN = 1 << 16
SENTINELS = ("<P>", "<S>", "<M>")


class _Array:
    """Sorted low halves."""

    def __init__(self, mask: np.ndarray):
        self.values = np.flatnonzero(mask).astype(np.uint16)

    def select(self, k: int) -> int:
        return int(self.values[k])


class _Bitmap:
    """One bit a value, and the number of bits before each word."""

    def __init__(self, mask: np.ndarray):
        bits = np.zeros(SPAN, dtype=bool)
        bits[: len(mask)] = mask
        self.words = np.packbits(bits, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def select(self, k: int) -> int:
        at = int(np.searchsorted(self.before, k, "right")) - 1
        bits = np.unpackbits(self.words[at : at + 1].view(np.uint8), bitorder="little")
        return 64 * at + int(np.flatnonzero(bits)[k - self.before[at]])


class _Runs:
    """First values of runs, and the number of values before each run."""

    def __init__(self, mask: np.ndarray):
        edges = np.flatnonzero(np.diff(mask.view(np.int8), prepend=0, append=0))
        self.first, lengths = edges[::2], edges[1::2] - edges[::2]
        self.before = np.concatenate([[0], np.cumsum(lengths)])

    def select(self, k: int) -> int:
        at = int(np.searchsorted(self.before, k, "right")) - 1
        return int(self.first[at] + k - self.before[at])


class Boundaries:
    """A set of offsets, given as a mask over all offsets of a text, that finds its k-th member."""

    def __init__(self, mask: np.ndarray):
        self.keys: list[int] = []
        self.containers: list[_Array | _Bitmap | _Runs] = []
        before = [0]
        for low in range(0, len(mask), SPAN):
            part = mask[low : low + SPAN]
            n = int(np.count_nonzero(part))
            if not n:
                continue
            runs = 1 if n == len(part) else int(part[0]) + int(np.count_nonzero(part[1:] & ~part[:-1]))
            size, kind = min((2 * n, 0), (SPAN // 8, 1), (4 * runs, 2))
            self.keys.append(low)
            self.containers.append((_Array, _Bitmap, _Runs)[kind](part))
            before.append(before[-1] + n)
        self.before = np.array(before)

    def __len__(self) -> int:
        return int(self.before[-1])

    def select(self, k: int) -> int:
        """The k-th offset, from 0."""
        at = int(np.searchsorted(self.before, k, "right")) - 1
        return self.keys[at] + self.containers[at].select(k - int(self.before[at]))


def code_points(data: np.ndarray) -> Boundaries:
    """Where the code points of UTF-8 bytes begin, and the end."""
    mask = np.empty(len(data) + 1, dtype=bool)
    np.not_equal(data & 0xC0, 0x80, out=mask[:-1])
    mask[-1] = True
    return Boundaries(mask)


def _dice(seed: int, doc_id: int | None) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[4 * i : 4 * i + 4], "big") for i in range(4)]


_OUT = "doc_id long, n long, form string, cut long, end long, prefix_chars long, middle_chars long, output string"


def fill_middle(
    docs: DataFrame, seed: int = 1, plain: int = 10, suffix_first: int = 20, sentinels: tuple[str, str, str] = SENTINELS
) -> DataFrame:
    """Rearrange every text of documents (doc_id, text) so that a model learns to fill in its middle.

    Four numbers drawn from ``seed`` and doc_id alone decide: the two cuts, whether the text stays as it is (``plain`` in a
    hundred) and whether the suffix leads (``suffix_first`` in a hundred). ``sentinels`` mark prefix, suffix and middle.
    Returns one row per input row: doc_id, n (code points), form (plain, psm or spm), cut and end (byte offsets of the middle),
    prefix_chars, middle_chars and output. Offsets and counts are null in form plain.

    A null text counts as empty; empty texts, and texts that hold a sentinel, stay plain. A null doc_id draws
    from ``seed`` and nothing. Texts of any length are cut whole; a task holds some 4 MB of text at a time, or one
    longer text. Rows with equal doc_id draw alike, and repeated rows have equal results. An empty table gives no rows.
    Other columns, whatever their names, are not read.
    """
    marks = [s.encode() for s in sentinels]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, offsets = text_bytes(batch.column("text"))
            rows = []
            for doc_id, low, high in zip(batch.column("doc_id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                text = data[low:high].tobytes()
                places = code_points(data[low:high])
                n = len(places) - 1
                h1, h2, h3, h4 = _dice(seed, doc_id)
                if not n or h3 % 100 >= 100 - plain or any(m in text for m in marks):
                    rows.append((n, "plain", None, None, None, None, text))
                    continue
                first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
                cut, end = places.select(first), places.select(last)
                prefix, middle, suffix = marks[0] + text[:cut], marks[2] + text[cut:end], marks[1] + text[end:]
                form = "spm" if h4 % 100 < suffix_first else "psm"
                output = (suffix + prefix if form == "spm" else prefix + suffix) + middle
                rows.append((n, form, cut, end, first, last - first, output))
            names = ["n", "form", "cut", "end", "prefix_chars", "middle_chars", "output"]
            kinds = [pa.int64(), pa.string(), *[pa.int64()] * 4, pa.string()]
            columns = [pa.array(x, kind) for x, kind in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *names])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")), run, _OUT)


def restored(sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that columns ``form`` and ``output`` came from, rebuilt from these two alone."""
    mark_p, mark_s, mark_m = (F.lit(s) for s in sentinels)

    def part(text: Column, mark: Column, i: int) -> Column:
        return F.split_part(text, mark, F.lit(i))

    after_p, after_s = part(F.col("output"), mark_p, 2), part(F.col("output"), mark_s, 2)
    psm = F.concat(part(after_p, mark_s, 1), part(F.col("output"), mark_m, 2), part(after_s, mark_m, 1))
    spm = F.concat(part(after_p, mark_m, 1), part(F.col("output"), mark_m, 2), part(after_s, mark_p, 1))
    return F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("output"))
