import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from counterscope.llm.alignment import BytePairs, SentencePieces, Side, _parts, aligned, corners, link_counts, merged
from counterscope.llm.packing import default_ranks
from tests.llm.helpers import CLASHING, documents, prose

A, B = BytePairs(default_ranks()), SentencePieces(public_tokenizers.path("piece_bpe_32k.model"))


def byte_of():
    """The byte each sign of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    signs = plain + [256 + i for i in range(256 - len(plain))]
    values = plain + [b for b in range(256) if b not in plain]
    return {chr(s): v for s, v in zip(signs, values)}


@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    signs = byte_of()

    def bytes_b(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    def both(text):
        if not text:
            return [], []
        x = [(i, bytes(signs[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        y = [(i, bytes_b(i)) for i in b.encode(text)]
        spelled = (" " + text).encode()
        return (x, y) if b"".join(t for _, t in x) == spelled == b"".join(t for _, t in y) else ([], [])

    return both


def spans(tokens):
    out, at = [], 0
    for i, t in tokens:
        out.append((at, at + len(t), i))
        at += len(t)
    return out


def brute(both, text):
    """Counts, groups text and links, by walking both token lists."""
    x, y = (spans(t) for t in both(text))
    if not x:
        return 0, 0, 0, [], ""
    common = sorted({e for _, e, _ in x} & {e for _, e, _ in y})
    groups, low = [], 0
    for high in common:
        groups.append(tuple(",".join(str(i) for s, e, i in side if low <= s and e <= high) for side in (x, y)))
        low = high
    links, j = [], 0
    for s, e, i in x:
        while y[j][1] <= s:
            j += 1
        k = j
        while k < len(y) and y[k][0] < e:
            links.append((i, y[k][2]))
            k += 1
    return len(x), len(y), len(groups), links, hashlib.sha256(";".join("|".join(g) for g in groups).encode()).hexdigest()


def rows():
    rnd = random.Random(13)
    letters = "abc dé€😀\n\t  .,'1"
    out = [(i, "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 80)))) for i in range(120)]
    out += [(200 + i, " ".join(prose(rnd, rnd.randint(1, 60), 30))) for i in range(60)]
    out += [(300, None), (301, ""), (302, " "), (303, "<|endoftext|> and </s>"), (304, "under ▁ line"), (305, "ﬁ ﬀ ①"), (306, "\0\r\n")]
    out += [(307, "twice the same"), (307, "twice the same"), (None, "no id"), (None, None), (308, "  two  spaces   "), (309, "x" * 3000)]
    out += [(310, " ".join(prose(rnd, 9000, 300)))]
    return out


def test_counts_equal_brute_force(spark, tokenizers):
    docs = rows()
    plain = [brute(tokenizers, t) for _, t in docs]
    held = Counter(p for b in plain for p in set(b[3]))
    most = defaultdict(int)
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    want = [
        (d, na, nb, ng, len(links), sum(held[p] == most[p[0]] for p in links), sum(held[p] for p in links), digest)
        for (d, _), (na, nb, ng, links, digest) in zip(docs, plain)
    ]
    assert any(w[1] == 0 and t for w, (_, t) in zip(want, docs))  # some texts are not spelled by their tokens
    for limit in (200_000, 40, 0):
        got = [tuple(r) for r in link_counts(documents(spark, docs, CLASHING), A, B, limit).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr), limit


def test_pieces_of_any_size_give_the_same_links_and_groups():
    rnd = np.random.default_rng(2)
    for n, m, top in ((1, 1, 1), (40, 60, 200), (300, 5, 400), (5, 300, 400), (200, 200, 200)):
        a, b = (np.append(np.sort(rnd.choice(np.arange(1, top), min(k, top) - 1, replace=False)), top) for k in (n, m))
        ends = np.union1d(a, b)
        starts = np.append(0, ends[:-1])
        links = sorted(zip(np.searchsorted(a, starts, "right").tolist(), np.searchsorted(b, starts, "right").tolist()))
        common = np.intersect1d(a, b)
        groups = list(zip((np.searchsorted(a, common) + 1).tolist(), (np.searchsorted(b, common) + 1).tolist()))
        for steps in (1, 2, 3, 7, 64, 10_000):
            i, j = corners(a, b, steps)
            assert (np.diff(i + j)[:-1] == steps).all() and i[-1] == len(a) and j[-1] == len(b)
            x, y, ga, gb = merged(a, b, steps)
            assert sorted(zip(x.tolist(), y.tolist())) == links
            assert list(zip(ga.tolist(), gb.tolist())) == groups


def test_long_texts_are_encoded_in_parts_with_the_same_ids():
    rnd = random.Random(6)
    text = " ".join(rnd.choice(["word", "Wörter", "it's", "1,000", "(x)", "a  b", "...", "q\nr"]) for _ in range(3000))
    parts = list(_parts(text, 500))
    assert len(parts) > 20 and " ".join(parts) == text
    for spec in (A, B):
        side = Side(spec)
        joined = np.concatenate([np.array(x) for x in side.encode(parts)])
        assert joined.tolist() == side.encode([text])[0]
    assert list(_parts("x" * 5000, 500)) == ["x" * 5000] and list(_parts("", 5)) == [""]


def test_groups_are_given_as_text(spark, tokenizers):
    got = aligned(documents(spark, [(1, "Hello aligned wörld"), (2, None)]), A, B).collect()
    got = {r.doc_id: r for r in got}
    assert hashlib.sha256(got[1].groups.encode()).hexdigest() == got[1].groups_sha256 == brute(tokenizers, "Hello aligned wörld")[4]
    assert got[2].groups == got[2].groups_sha256 == "" and got[2].pairs == []


def test_empty_table(spark):
    assert link_counts(documents(spark, []).limit(0), A, B).count() == 0
