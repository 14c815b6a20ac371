import random
import re

import numpy as np
import pyarrow as pa

from counterscope.llm import words as w

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def test_words_are_found_and_told_apart_in_texts_of_any_kind():
    rnd = random.Random(1)
    texts = ["", None, "a", "A  B\tc\nd\x0be", "é ü ñ", "x" * 300_000, "word " * 200_000, "y" * 2_500_000 + " abc"]
    texts += ["".join(rnd.choice("ab \n\tAé") for _ in range(rnd.randint(0, 40))) for _ in range(2000)]
    found = w.Words(pa.array(texts), starts=(1,))
    seen = {}
    for i, text in enumerate(texts):
        expected = WORD.findall(lowered(text or ""))
        got = found.hashes[found.bounds[i] : found.bounds[i + 1]].tolist()
        assert len(got) == len(expected)
        for word, value in zip(expected, got):
            assert seen.setdefault(word, value) == value
    assert len(set(seen.values())) == len(seen)
    assert w.hash_of("Abc") == seen["abc"]
    first = found.starts[1][found.end - found.first > 1]
    assert set(first[first != 0].tolist()) <= {w.hash_of(x) for x in "abxywé"} | set(first.tolist())
    assert w.hash_of("x") in set(first.tolist())


def test_sliced_columns_and_both_string_kinds_give_the_same_words():
    column = pa.array(["a b", "c", "d e f"])
    whole, _ = w.word_hashes(column)
    part, bounds = w.word_hashes(column.slice(1))
    assert part.tolist() == whole[2:].tolist() and bounds.tolist() == [0, 1, 4]
    assert w.word_hashes(column.cast(pa.large_string()))[0].tolist() == whole.tolist()


def test_shingle_sets_follow_the_definition():
    texts = ["a b c d e f a b c d e f", "a b", "", "A b c d e", "a", "b a"]
    sets = list(w.shingle_sets(*w.word_hashes(pa.array(texts))))
    assert [len(s) for s in sets] == [6, 1, 0, 1, 1, 1]
    assert sets[3][0] in sets[0] and all(np.all(np.diff(s.astype(object)) > 0) for s in sets)
    assert len({int(s[0]) for s in (sets[1], sets[4], sets[5])}) == 3
