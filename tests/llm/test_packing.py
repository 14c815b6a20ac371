import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from counterscope.llm.packing import END_OF_TEXT, Bins, cut, default_ranks, encoder, pack, pack_documents, sequences, token_pieces
from tests.llm.helpers import CLASHING, documents, prose


def test_only_a_first_piece_is_short():
    assert cut(1, 4) == [(0, 1)] and cut(4, 4) == [(0, 4)] and cut(8, 4) == [(0, 4), (4, 4)]
    assert cut(9, 4) == [(0, 1), (1, 4), (5, 4)]


def test_both_encoders_give_the_same_ids():
    known = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    known.encode_special_tokens = True
    fast = encoder(None, default_ranks())
    rnd = random.Random(7)
    letters = [chr(c) for c in range(0x250)] + list("’　一\U0001f600́​ <|>")
    texts = ["", "<|endoftext|>", "x" * 50_000, " " * 50_000, "\n" * 999]
    texts += ["".join(rnd.choice(letters if rnd.random() < 0.5 else " \n'stl aA1.") for _ in range(60)) for _ in range(3000)]
    texts += ["".join(f"{chr(c)} a{chr(c)}{chr(c)}1" for c in range(at, min(at + 500, 0xD800))) for at in range(0, 0xD800, 500)]
    for text in texts:
        assert fast(text) == known.encode(text, add_special_tokens=False).ids


SPELLED = ["a<|endoftext|>b", "a  <|endoftext|>  b", "<|endoftext|><|endoftext|>\n", "<|endoftext|", "x <|<|endoftext|>|> y", " <|endoftext|>", "\n\n<|endoftext|>\n"]


@pytest.mark.parametrize("ranks", [None, default_ranks()])
def test_special_tokens_in_texts_are_those_of_an_unchanged_tokenizer(spark, ranks):
    known = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = encoder(None, ranks, special=True)
    rnd = random.Random(12)
    texts = SPELLED + ["".join(rnd.choice(["<|endoftext|>", " ", "\n", "ab", "’", "1"]) for _ in range(12)) for _ in range(300)]
    for text in texts:
        assert encode(text) == known.encode(text, add_special_tokens=False).ids
    assert 50256 in encode(SPELLED[0])
    got = {r.doc_id: r for r in token_pieces(documents(spark, list(enumerate(SPELLED))), ranks=ranks).collect()}
    for i, text in enumerate(SPELLED):
        ids = known.encode(text, add_special_tokens=False).ids + [END_OF_TEXT]
        assert (got[i].length, got[i].ids_crc32) == (len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))


@pytest.mark.parametrize("kind", ["even", "middle", "small", "one", "none"])
def test_bins_hold_everything_and_search_never_worsens(kind):
    rng = np.random.default_rng(1)
    lengths = {
        "even": rng.integers(1, 1024, 3000),
        "middle": rng.integers(300, 700, 6000),
        "small": np.minimum(1023, rng.geometric(1 / 90, 3000)),
        "one": np.array([5]),
        "none": np.zeros(0, dtype=int),
    }[kind]
    bins = Bins(lengths, 1024)
    before = len(bins.bins)
    squares = sum(f * f for f in bins.fill)
    bins.improve()
    assert sorted(i for b in bins.bins for i in b) == list(range(len(lengths)))
    assert [sum(lengths[b]) for b in bins.bins] == bins.fill and all(0 < f <= 1024 for f in bins.fill)
    assert len(bins.bins) <= before and sum(f * f for f in bins.fill) >= squares
    if kind in ("even", "middle", "small"):
        assert len(bins.bins) <= -(-lengths.sum() // 1024) * 1.01 + 1


def test_swaps_close_bins():
    bins = Bins(np.array([6, 6, 5, 5, 4, 4]), 10, bins=[[0], [1], [2], [3], [4], [5]])
    bins.improve()
    assert len(bins.bins) == 3
    # 7 + 2 | 6 + 3 | 2: giving 2 for 3 fills the first bin, and the rest fits the second
    bins = Bins(np.array([7, 2, 6, 3, 2]), 10, bins=[[0, 1], [2, 3], [4]])
    bins.improve()
    assert sorted(bins.fill) == [10, 10]


def test_sequences_are_gapless_and_hold_every_token_once(spark):
    rnd = random.Random(8)
    rows = [(i, " ".join(prose(rnd, rnd.choice([rnd.randint(0, 30), rnd.randint(0, 300)])))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, "x " * 4000), (1003, " " * 5000)]
    docs = documents(spark, rows, CLASHING)
    placed = pack_documents(docs, capacity=128, group=200)
    known = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: known.encode(t or "", add_special_tokens=False).ids + [END_OF_TEXT] for i, t in rows}
    bins, pieces = defaultdict(list), defaultdict(list)
    for r in placed.collect():
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], dtype="<u4")
        assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32
        bins[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.piece, r.start, r.length))
    for i in ids:
        assert [p[1:] for p in sorted(pieces[i])] == cut(len(ids[i]), 128)
    for parts in bins.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 128
    total = sum(map(len, ids.values()))
    assert len(bins) <= -(-total // 128) * 1.02 + 2
    made = sequences(docs, placed, capacity=128).collect()
    assert sorted(t for r in made for t in r.ids) == sorted(t for i in ids.values() for t in i)


def test_repeated_rows_and_empty_table(spark):
    docs = documents(spark, [(1, "a b c"), (1, "a b c"), (None, "a b c")])
    assert pack_documents(docs, ranks=default_ranks()).select("doc_id", "offset").distinct().count() == 3
    assert pack_documents(docs.limit(0)).count() == 0
    assert pack(token_pieces(docs, 2), 2).count() == 6
