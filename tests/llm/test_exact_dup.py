import hashlib
import random
import re

from counterscope.llm.exact_dup import CHUNK, drop_exact_duplicates, exact_duplicates
from tests.llm.helpers import CLASHING, documents, prose


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def expected(rows):
    groups = {}
    for r in rows:
        groups.setdefault(normal(r[1]), []).append(r[0])
    out = []
    for r in rows:
        ids = groups[normal(r[1])]
        keep = min((i for i in ids if i is not None), default=None)
        out.append((r[0], keep, len(ids), r[0] == keep, hashlib.sha256(normal(r[1]).encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of():
    rnd = random.Random(2)
    long = [" ".join(prose(rnd, 5000)) for _ in range(4)] + ["Z" * 20_000, "é" * 9_000]
    rows = [(i, rnd.choice(long)) for i in range(40)]
    rows += [(100, long[0] + "x"), (101, "x" + long[0]), (102, long[0][:-1]), (103, long[0].replace(" ", "\n\t"))]
    rows += [(104, None), (105, ""), (106, " "), (107, "\t\n"), (108, "a b"), (109, "a  b"), (None, "a\nb"), (None, "alone"), (108, "a b")]
    return rows


def got(df):
    columns = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_groups_equal_those_of_whole_texts(spark):
    rows = rows_of()
    assert got(exact_duplicates(documents(spark, rows, CLASHING))) == expected(rows)


def test_clashing_identifiers_are_replaced(spark):
    rows = rows_of()
    assert got(exact_duplicates(documents(spark, rows), bits=2)) == expected(rows)


def test_chunks_cover_a_text_and_resynchronise():
    rnd = random.Random(3)
    text = " ".join("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(1, 9))) for _ in range(8000))
    pattern = re.compile(CHUNK)
    cuts = pattern.findall(text)
    assert "".join(cuts) == text and max(map(len, cuts)) <= 4098
    moved = pattern.findall("some words in front " + text)
    assert len(set(cuts) & set(moved)) > 0.6 * len(cuts)


def test_one_row_of_each_group_stays_with_all_columns(spark):
    docs = documents(spark, rows_of(), CLASHING)
    kept = drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    rows = [(r.doc_id, normal(r.text)) for r in kept.collect()]
    assert len(rows) == len({t for _, t in rows}) == len({normal(r[1]) for r in rows_of()})
    assert {(k, t) for k, t in rows} == {(e[1], normal(r[1])) for r, e in zip(sorted(rows_of(), key=repr), sorted_expected(rows_of()))}


def sorted_expected(rows):
    by_row = []
    for r in sorted(rows, key=repr):
        ids = [x[0] for x in rows if normal(x[1]) == normal(r[1]) and x[0] is not None]
        by_row.append((r[0], min(ids, default=None)))
    return by_row


def test_empty_table(spark):
    docs = documents(spark, []).limit(0)
    assert exact_duplicates(docs).count() == 0 and drop_exact_duplicates(docs).count() == 0
