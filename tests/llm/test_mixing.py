import random
from collections import Counter, defaultdict

import pytest

from counterscope.llm.mixing import mix, mixed
from tests.llm.helpers import CLASHING, documents, prose

WEIGHTS = (5.0, 2.0, 1.0)


def targets(sizes, most=3):
    """Share by weight, cap, share the excess again."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: WEIGHTS[i % 3] for i, s in enumerate(names)}
    total, out, free = sum(sizes.values()), {}, set(names)
    while free:
        level = (total - sum(out.values())) / sum(weight[s] for s in free)
        full = {s for s in free if most * sizes[s] <= weight[s] * level}
        if not full:
            return out | {s: weight[s] * level for s in free}
        out |= {s: most * sizes[s] for s in full}
        free -= full
    return out


def test_targets_and_taken_words(spark):
    rnd = random.Random(4)
    rows = []
    for i in range(900):
        source = rnd.choice(["hot"] * 6 + ["a", "Z", "é", None, "tiny"])
        if source == "tiny" and rnd.random() < 0.8:
            continue
        rows.append((i, " ".join(prose(rnd, rnd.randint(0, 60))), source))
    rows += [(2000, None, "a"), (2001, "", "only empty"), (None, "one two", "a"), rows[0], rows[0]]
    df = mix(documents(spark, rows, CLASHING))
    got = df.collect()
    assert len(got) == len(rows)
    sizes, largest = Counter(), Counter()
    for _, text, source in rows:
        n = len((text or "").split())
        sizes[source] += n
        largest[source] = max(largest[source], n)
    want, taken = targets(sizes), defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[r.source] += r.taken
    for source, target in want.items():
        assert abs(taken[source] - target) <= 2 * largest[source]
    again = sorted(map(tuple, mix(documents(spark, list(reversed(rows)))).collect()), key=repr)
    assert again == sorted(map(tuple, got), key=repr)
    # the mix itself has each document as often as it is taken
    docs = documents(spark, rows, CLASHING)
    out = mixed(docs)
    assert out.columns == docs.columns
    times = Counter((r.doc_id, r.source, r.text) for r in out.collect())
    wanted = Counter()
    text_of = {}
    for doc_id, text, source in rows:
        text_of.setdefault((doc_id, source, len((text or "").split())), []).append(text)
    for r in got:
        if r.taken:
            texts = text_of[r.doc_id, r.source, r["size"]]
            wanted[r.doc_id, r.source, texts[0]] += r.taken // r["size"]
    assert times == wanted


def test_many_rows_with_one_hash_and_one_source(spark):
    rows = [(7, "same words here", "s")] * 50 + [(8, "b", "t")]
    got = {(r.doc_id, r["size"], r.source_size, r.taken) for r in mix(documents(spark, rows)).collect()}
    # s gets 151 * 5 / 7, t 3 at most: the excess goes to s, which is capped by nothing below 450
    assert got == {(7, 3, 150, 3), (8, 1, 1, 3)}


def test_no_words_at_all(spark):
    assert [r.taken for r in mix(documents(spark, [(1, None), (2, " ")])).collect()] == [0, 0]
    empty = documents(spark, []).limit(0)
    assert mix(empty).count() == 0 and mixed(empty).count() == 0
