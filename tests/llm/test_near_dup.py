import random

import pytest

from counterscope.llm.near_dup import drop_near_duplicates, near_duplicates
from tests.llm.helpers import CLASHING, documents, prose
from tests.llm.test_words import WORD, lowered


def shingles(text):
    words = WORD.findall(lowered(text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets = [shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if sets[i] and 100 * shared >= 85 * (len(sets[i]) + len(sets[j]) - shared):
                parent[root(i)] = root(j)
    ids = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            ids[root(i)] = min(ids.get(root(i), r[0]), r[0])
    return sorted(((r[0], len(sets[i]), ids.get(root(i))) for i, r in enumerate(rows)), key=repr)


def corpus():
    rnd = random.Random(5)
    passage = prose(rnd, 60)
    rows, number = [], iter(range(10_000))
    base = prose(rnd, 150)
    for _ in range(120):  # near copies of all degrees, most of them too different from most others
        words = list(base)
        for _ in range(rnd.randint(0, 14)):
            words[rnd.randrange(len(words))] = f"e{rnd.randint(0, 10**6)}"
        rows.append((next(number), " ".join(words)))
    chain = prose(rnd, 200)
    for i in range(30):  # each is close to the one before
        chain = chain[:-2] + [f"c{i}", f"d{i}"] if i % 2 else [f"c{i}"] + chain
        rows.append((next(number), " ".join(chain)))
    for _ in range(60):  # a shared passage in otherwise different texts, some of them short
        rows.append((next(number), " ".join(prose(rnd, rnd.choice([3, 8, 80])) + passage)))
    rows += [(next(number), " ".join(passage)) for _ in range(40)]
    rows += [(next(number), t) for t in ("", None, " \n\t", "One two", "one  TWO", "one two three", "w1 w2 w3 w4 w5", "", None)]
    rnd.shuffle(rows)
    return rows


def test_components_equal_brute_force(spark):
    rows = corpus()
    rows += [rows[0], (None, rows[0][1]), (None, "nobody else says this"), (rows[1][0], "another text under an id in use")]
    found = near_duplicates(documents(spark, rows, CLASHING)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=repr) == brute(rows)
    assert all(r.kept == ((r.doc_id is not None or r.component_id is None) and r.doc_id == r.component_id) for r in found)


def test_one_row_of_each_component_stays(spark):
    rows = [(3, "a b c d e f g"), (1, "a b c d e f g"), (1, "a b c d e f g"), (2, None), (4, ""), (5, "x y")]
    docs = documents(spark, rows, CLASHING)
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, "a b c d e f g"), (2, None), (4, ""), (5, "x y")]


def test_empty_table_and_unsafe_settings(spark):
    docs = documents(spark, []).limit(0)
    assert near_duplicates(docs).count() == 0 and drop_near_duplicates(docs).count() == 0
    with pytest.raises(ValueError):
        near_duplicates(docs, percent=70)
