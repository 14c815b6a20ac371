"""The two classifiers against plain Python: features, terms, weights and document scores."""

import math
import re
import struct
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from counterscope.llm import quality as q
from counterscope.llm import toxicity as t
from counterscope.llm.quality import fold, labelled_sample, logistic

SMALL = "/root/testdata/sf0.001"
SPACE = re.compile(rb"[^\x20\x09-\x0D]+")


def plain_lines(text):
    """(features, bytes) of every line with a word."""
    data = (text or "").encode()
    out, before = [], set()
    lines = [x + b"\n" for x in data.split(b"\n")]
    lines[-1] = lines[-1][:-1]
    for line in lines:
        words = SPACE.findall(line.lower() if line.isascii() else bytes(b + 32 if 65 <= b <= 90 else b for b in line))
        if not words:
            continue
        n, size = len(words), len(line)
        count = lambda signs: sum(b in signs for b in line)  # noqa: E731, B023
        upper, lower = count(range(65, 91)), count(range(97, 123))
        out.append(
            (
                [
                    math.log1p(size) / 5,
                    min(upper / max(upper + lower, 1) * 2, 1),
                    count(b"0123456789") / size,
                    min(count(b"!?") / n, 1),
                    min(count(b"#$%&*@^~+=<>{}[]\\/_") / n, 2),
                    min(count(b"|") / n, 1),
                    min(count(b".,;:") / n, 1),
                    min(size / n / 10, 3),
                    sum(a == b for a, b in zip(words, words[1:])) / n,
                    len(set(words)) / n,
                    float(tuple(words) in before),
                    float(words[-1][-1:] in (b".", b"!", b"?")),
                    float(n < 4),
                ],
                size,
            )
        )
        before.add(tuple(words))
    return out


def plain_score(chain, text):
    lines = plain_lines(text)
    zero = [0.0] * q.OWN
    share = 0.5
    if lines:
        good = []
        for i, (own, _) in enumerate(lines):
            x = [1.0, *own, *(lines[i - 1][0] if i else zero), *(lines[i + 1][0] if i + 1 < len(lines) else zero)]
            good.append(max(-30.0, min(30.0, sum(a * b for a, b in zip(x, chain.weights)))))
        weight = lambda i, s: good[i] if s else 0.0
        n = len(lines)
        forward, backward = [[0.0, 0.0] for _ in range(n)], [[0.0, 0.0] for _ in range(n)]
        log = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b)))
        for i in range(n):
            for s in (0, 1):
                reach = 0.0 if i == 0 else log(*(forward[i - 1][r] + chain.moves[r, s] for r in (0, 1)))
                forward[i][s] = weight(i, s) + reach
        for i in reversed(range(n - 1)):
            for s in (0, 1):
                backward[i][s] = log(*(chain.moves[s, r] + weight(i + 1, r) + backward[i + 1][r] for r in (0, 1)))
        marginal = [1 / (1 + math.exp(f[0] + b[0] - f[1] - b[1])) for f, b in zip(forward, backward)]
        share = sum(m * size for m, (_, size) in zip(marginal, lines)) / sum(size for _, size in lines)
    share = min(max(share, 1e-3), 1 - 1e-3)
    return 1 / (1 + math.exp(-(chain.slope * math.log(share / (1 - share)) + chain.shift)))


TEXTS = ["One two.\n\nONE two.\nthree three three!\n", "", None, "x | y | z\n<a href=1>\t#tag $5\nende ü Ü?", "no break", "\n\n", "a\r\nb\x0bc\n a \n"]


def test_line_features_equal_plain_python():
    features, lengths, bounds = q.line_features(pa.array(TEXTS, pa.string()))
    for i, text in enumerate(TEXTS):
        want = plain_lines(text)
        assert np.allclose(features[bounds[i] : bounds[i + 1]], [f for f, _ in want] or np.zeros((0, q.OWN)))
        assert lengths[bounds[i] : bounds[i + 1]].tolist() == [n for _, n in want]


def test_document_scores_equal_plain_python(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    chain = q.train(labelled_sample(docs, labels, "quality", fold(5) != 0, 4000))
    got = {r.doc_id: r.quality_score for r in q.quality(docs, labels).collect()}
    for r in docs.collect():
        assert got[r.doc_id] == pytest.approx(plain_score(chain, r.text), abs=1e-9)
    extra = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in q.score(extra, chain).collect():
        assert r.quality_score == pytest.approx(plain_score(chain, r.text), abs=1e-9)


# Toxicity

WORD = re.compile("[^\x00-\x26\x28-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text):
    words = set(WORD.findall(text.translate(LOWER)))
    return words | {w[:m] + "*" for w in words for m in t.PREFIXES if len(w) > m}


def first_half(doc_id):
    seed = xxhash.xxh64_intdigest(b"half", seed=42)
    return xxhash.xxh64_intdigest(struct.pack("<q", doc_id), seed=seed) % 2 == 0


def plain_insults(rows, least, most):
    bad, good, toxic = Counter(), Counter(), sum(r.label for r in rows)
    clean = len(rows) - toxic
    for r in rows:
        (bad if r.label else good).update(terms_of(r.text))
    rate = toxic / len(rows)
    learnt, found = [], dict.fromkeys(t.WORDS[t.INSULT].split(), t.SEED_WEIGHT)
    for term in {*bad, *good}:
        a, b = bad[term], good[term]
        if a < 3 and b < 10:
            continue
        share = (a + 0.001) / (a + b + 0.002)
        ratio = 2 * (a * math.log(share / rate) + b * math.log((1 - share) / (1 - rate)))
        odds = math.log(((a + 0.5) / (toxic + 1)) / ((b + 0.5) / (clean + 1)))
        if ratio >= least and share > 0.5:
            learnt.append((-ratio, term, odds))
        elif term in found and a + b >= 10:
            found[term] = min(t.MOST_WEIGHT, odds)
    for _, term, odds in sorted(learnt)[:most]:
        found[term] = min(t.MOST_WEIGHT, odds)
    return {term: w for term, w in found.items() if w > 0.5}


def test_terms_and_weights_equal_plain_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    sample = labelled_sample(docs, labels, "toxic", fold(4) != 2, 20_000)
    rows = sample.collect()
    assert len({first_half(r.doc_id) for r in rows}) == 2
    model = t.train(sample, least=6.0)
    want = plain_insults(rows, 6.0, 4000)
    assert model.lexicon.insults.keys() == want.keys() and len(want) > 40
    assert all(model.lexicon.insults[k] == pytest.approx(want[k]) for k in want)
    # the logistic step is learnt on the other half, with the terms of the first
    trial = [r for r in rows if first_half(r.doc_id)]
    both = Counter(term for r in rows for term in terms_of(r.text) if r.label), Counter(term for r in rows for term in terms_of(r.text) if not r.label)
    kept = {term for term in {*both[0], *both[1]} if both[0][term] >= 3 or both[1][term] >= 10}
    assert kept
    other = [r for r in rows if not first_half(r.doc_id)]
    counted = t._terms(sample.withColumn("half", t.F.pmod(t.F.xxhash64(t.F.lit("half"), "doc_id"), t.F.lit(2)) == 0)).collect()
    own = Counter(term for r in trial for term in terms_of(r.text) if r.label)
    assert {r.term: r.t1 for r in counted if r.t1} == dict(own)
    assert {r.term: (r.t, r.n) for r in counted} == {term: (both[0][term], both[1][term]) for term in {*both[0], *both[1]}}
    assert len(trial) + len(other) == len(rows)


def test_probability_follows_from_the_evidence():
    lexicon = t.Lexicon({"idiot": 2.0})
    model = t.ToxicityModel(lexicon, np.array([0.3, 1.1, 0.2, 0.4]), -2.0)
    texts = ["you idiot. an idiot!", "fine words here", "", None]
    evidence = lexicon.evidence(pa.array(texts, pa.string()))
    for p, (total, most, _, hits, words) in zip(model.probability(pa.array(texts, pa.string())), evidence):
        x = [math.log1p(total), min(most, 12) / 6, math.log1p(hits), math.log1p(100 * hits / (words + 20))]
        z = sum(a * b for a, b in zip(x, [0.3, 1.1, 0.2, 0.4])) - 2.0
        assert p == pytest.approx(1 / (1 + math.exp(-z)))
    assert evidence[0].tolist() == pytest.approx([2.6 + 2.0, 2.6, 2, 2, 4])


def test_the_logistic_step_is_where_the_slope_of_the_likelihood_ends():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 3))
    y = (rng.random(400) < 1 / (1 + np.exp(-(x @ [1.0, -2.0, 0.5] + 0.3)))).astype(float)
    for penalty in (0.3, 1.0):
        slopes, shift = logistic(x, y, penalty=penalty)
        p = 1 / (1 + np.exp(-(x @ slopes + shift)))
        assert np.allclose(x.T @ (y - p) - penalty * slopes, 0, atol=1e-5) and abs((y - p).sum() - 1e-6 * shift) < 1e-5
