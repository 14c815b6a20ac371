import hashlib
import random

import numpy as np
import pytest

from counterscope.llm.fill_middle import SPAN, Boundaries, _Array, _Bitmap, _Runs, code_points, fill_middle, restored
from tests.llm.helpers import CLASHING, documents


def brute(doc_id, text):
    text = text or ""
    n = len(text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return doc_id, n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def test_outputs_equal_brute_force_and_texts_come_back(spark):
    rnd = random.Random(1)
    letters = "aü€😀 <PSM>\n\0"
    rows = [(i, "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60)))) for i in range(300)]
    rows += [(301, None), (302, ""), (303, "a<P>b"), (304, "<S>"), (305, "<M"), (306, "<"), (None, "no id ü"), (None, None)]
    rows += [(307, "long ü € 😀 " * 40_000), (308, "a" * 300_000), (309, "twice"), (309, "twice"), (-5, "negative"), (2**63 - 1, "largest")]
    made = fill_middle(documents(spark, rows, CLASHING))
    got = made.withColumn("back", restored()).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[-1])
    want = sorted((brute(*r) for r in rows), key=key)
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=key) == want
    texts = {r[0]: r[1] or "" for r in rows if r[0] is not None}
    assert all(r.back == texts[r.doc_id] for r in got if r.doc_id is not None)
    for r in got:
        if r.form != "plain" and r.doc_id is not None:
            assert texts[r.doc_id].encode()[r.cut : r.end].decode() == texts[r.doc_id][r.prefix_chars : r.prefix_chars + r.middle_chars]
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_other_parameters_and_sentinels(spark):
    rows = [(i, f"text number {i} | with <P> in it") for i in range(50)]
    marks = ("[pre]", "[suf]", "[mid]")
    got = fill_middle(documents(spark, rows), seed=7, plain=0, suffix_first=100, sentinels=marks).withColumn("back", restored(marks)).collect()
    assert {r.form for r in got} == {"spm"} and {r.back for r in got} == {t for _, t in rows}


def test_empty_table(spark):
    assert fill_middle(documents(spark, []).limit(0)).count() == 0


@pytest.mark.parametrize("kind", [_Array, _Bitmap, _Runs])
def test_each_container_selects_what_it_holds(kind):
    rnd = np.random.default_rng(3)
    for size, share in ((SPAN, 0.01), (SPAN, 0.5), (SPAN, 0.999), (777, 0.3), (SPAN, 1.0)):
        mask = rnd.random(size) < share
        mask[rnd.integers(size)] = True
        want = np.flatnonzero(mask)
        held = kind(mask)
        places = [0, len(want) - 1, *rnd.integers(len(want), size=200).tolist()]
        assert [held.select(k) for k in places] == want[places].tolist()


def test_a_set_picks_the_smallest_container_and_skips_empty_ones():
    rnd = np.random.default_rng(4)
    mask = np.zeros(5 * SPAN + 100, dtype=bool)
    mask[:SPAN] = True
    mask[SPAN : 2 * SPAN : 100] = True
    mask[2 * SPAN : 3 * SPAN] = rnd.random(SPAN) < 0.5
    mask[5 * SPAN + 99] = True
    held = Boundaries(mask)
    assert [type(c) for c in held.containers] == [_Runs, _Array, _Bitmap, _Array] and held.keys == [0, SPAN, 2 * SPAN, 5 * SPAN]
    want = np.flatnonzero(mask)
    assert len(held) == len(want)
    places = [0, SPAN - 1, SPAN, len(want) - 1, *rnd.integers(len(want), size=500).tolist()]
    assert [held.select(k) for k in places] == want[places].tolist()


def test_boundaries_at_the_edge_of_a_container():
    for n in (0, 1, SPAN - 1, SPAN, SPAN + 1):
        held = code_points(np.full(n, 97, dtype=np.uint8))
        assert len(held) == n + 1 and held.select(n) == n
    text = ("ü" * SPAN).encode()
    held = code_points(np.frombuffer(text, dtype=np.uint8))
    assert len(held) == SPAN + 1 and [held.select(k) for k in (0, 1, SPAN // 2, SPAN)] == [0, 2, SPAN, 2 * SPAN]
