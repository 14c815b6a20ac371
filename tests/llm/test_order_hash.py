import hashlib
import random
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from counterscope.llm.order_hash import as_text, edited_by_next, fingerprinted, likeness
from tests.llm.helpers import CLASHING, documents, prose
from tests.llm.test_words import WORD


def xx(*values):
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else struct.pack("<q", v), seed=seed)
    return seed - (1 << 64) if seed >> 63 else seed


def brute(text, k, least, slots):
    words = WORD.findall(text or "")
    grams = [tuple(words[i : i + k]) for i in range(max(len(words) - k + 1, min(len(words), 1)))]
    kmers = [xx(*g) for g in grams]
    below = (1 << len(f"{len(kmers):b}")) - 1
    seen, ring = {}, []
    for place, (g, h) in enumerate(zip(grams, kmers)):
        n = seen[g] = seen.get(g, -1) + 1
        ring.append(((struct.unpack("<q", struct.pack("<q", xxh_pair(h, n)))[0] & ~below), place))
    ring.sort()
    out = []
    width = 1 << (64 - (slots.bit_length() - 1))
    for j in range(slots):
        low = -(1 << 63) + j * width
        turned = [x for x in ring if x[0] >= low] + [x for x in ring if x[0] < low]
        places = sorted(p for _, p in turned[:least])
        out.append(xx(*[kmers[p] for p in places]) >> 32)
    return out


def xxh_pair(h, n):
    first = xxhash.xxh64_intdigest(struct.pack("<q", h), seed=42)
    second = xxhash.xxh64_intdigest(struct.pack("<i", n), seed=first)
    return second - (1 << 64) if second >> 63 else second


def texts():
    rnd = random.Random(12)
    rows = [" ".join(prose(rnd, rnd.randint(0, 90), rnd.choice([3, 40, 400]))) for _ in range(60)]
    rows += [None, "", " \t\n", "one", "one two", "one  two\tthree", "ü € 😀 ü € 😀", "same " * 700, " ".join(prose(rnd, 5000, 50))]
    return rows


@pytest.mark.parametrize(("k", "least", "slots"), [(2, 2, 64), (1, 3, 16), (3, 1, 8), (2, 5, 4)])
def test_fingerprints_equal_brute_force(spark, k, least, slots):
    rows = list(enumerate(texts()))
    df = fingerprinted(documents(spark, rows, CLASHING).select("doc_id", "text", "id", "score", "`a.b`"), "text", "prints", k, least, slots)
    assert df.columns == ["doc_id", "text", "id", "score", "a.b", "prints"]
    got = {r.doc_id: r.prints for r in df.collect()}
    assert got == {i: brute(t, k, least, slots) for i, t in rows}


def edit(text, after):
    n = len(text) // 4
    return text[: len(text) - n] + after[:n]


def check(spark, rows):
    df = edited_by_next(documents(spark, rows, CLASHING)).withColumns({"a": as_text(F.col("fingerprint")), "b": as_text(F.col("edited_fingerprint"))})
    distinct = sorted({(r[0] is None, r[0] or 0, xx(r[1] or ""), r[1] or "") for r in rows})
    after = dict(zip([x[:3] for x in distinct], [x[3] for x in distinct[1:] + distinct[:1]]))
    want = []
    for i, t in rows:
        t = t or ""
        other = after[i is None, i or 0, xx(t)]
        changed = edit(t, other)
        own, new, far = (brute(x, 2, 2, 64) for x in (t, changed, other))
        hexed = lambda p: "".join(f"{x & 0xFFFFFFFF:08x}" for x in p)
        same = lambda p, q: sum(x == y for x, y in zip(p, q)) / 64
        want.append((i, len(t), changed, hexed(own), hexed(new), same(own, new), same(own, far)))
    got = [(r.doc_id, r.n_chars, r.edited, r.a, r.b, r.near_edited, r.near_next) for r in df.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_edited_texts_equal_brute_force(spark):
    rnd = random.Random(5)
    rows = [(rnd.randint(-50, 10**12) if i else 2**63 - 1, t) for i, t in enumerate(texts())]
    rows += [(7, "two texts of one id"), (7, "the other text"), (8, "repeated row here"), (8, "repeated row here"), (None, "no id"), (None, None)]
    check(spark, rows)


def test_one_document_follows_itself(spark):
    check(spark, [(3, "a b c d e f g h")])
    check(spark, [(3, "a b c d"), (3, "a b c d")])


def test_empty_table(spark):
    assert edited_by_next(documents(spark, []).limit(0)).count() == 0


def test_likeness_falls_with_edits_and_with_a_change_of_order(spark):
    rnd = random.Random(8)
    words = prose(rnd, 600, 10**6)
    block = [words[i : i + 60] for i in range(0, 600, 60)]
    rnd.shuffle(block)
    forms = [words, words[:-12], words[:400], [w for b in block for w in b], prose(rnd, 600, 10**6)]
    rows = [(i, " ".join(w)) for i, w in enumerate(forms)]
    prints = fingerprinted(documents(spark, rows), "text", "prints", slots=256).select("doc_id", "prints")
    first = prints.where("doc_id = 0").select(F.col("prints").alias("own"))
    near = {r.doc_id: r.near for r in prints.join(F.broadcast(first)).select("doc_id", likeness("own", "prints").alias("near")).collect()}
    assert near[0] == 1 and near[1] > 0.9 > near[2] > 0.2 and near[4] == 0
    # moved blocks share nearly all k-mers, but only tuples within a block keep their order
    assert near[3] < 0.75


def test_it_stays_in_the_engine(spark):
    plan = edited_by_next(documents(spark, [(1, "a b"), (2, "c d")]))._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "CartesianProduct", "NestedLoop"))


def test_digest_of_an_edited_text(spark):
    rows = [(1, "aaaa bbbb cccc dddd"), (2, "xyz")]
    got = {r.doc_id: r.d for r in edited_by_next(documents(spark, rows)).select("doc_id", F.sha2("edited", 256).alias("d")).collect()}
    assert got[1] == hashlib.sha256(b"aaaa bbbb cccc xyz").hexdigest()  # four of 19 are replaced by all three of the next
