import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from counterscope.llm import toxicity as t
from tests.llm.helpers import CLASHING, documents, prose

LEXICON = t.Lexicon({"idiot": 2.0, "stupid": 2.0, "blarg*": 3.0, "été": 1.0})


def clause_score(text):
    return LEXICON.evidence(pa.array([text], pa.string()))[0, 0]


def test_composition_applies_machines_in_turn():
    first = t._window("a", 1, {"i": ("t", 2.0)})
    first = t.Transducer({(s, x): first.arcs.get((s, x), (0, x, 1.0)) for s in (0, 1) for x in t.ALPHABET + "a"} | {
        (s, "a"): (1, "o", 1.0) for s in (0, 1)})
    second = t._window("t", 1, {"y": ("m", 5.0)})
    both = first.then(second)
    assert both.read("aiy") == [("o", 1.0), ("t", 2.0), ("m", 5.0)]
    assert both.read("iiy") == [("i", 1.0), ("i", 1.0), ("y", 1.0)]


@pytest.mark.parametrize(
    ("text", "score"),
    [
        ("what an idiot", 2.0),
        ("you idiot", 2.6),
        ("he is not an idiot", 2 * 0.4 * 1.3),
        ("they said it was an idiot", 2 * 0.6),
        ("I will kill you", 3.0),
        ("it will kill the grass, you know", 0.0),
        ("IDIOT! stupid.", 4.0),
        ("blargh blarg", 3.0),
        ("Idiots and idiotic", 0.0),
        ("nothing here", 0.0),
        ("", 0.0),
        (None, 0.0),
    ],
)
def test_clauses_are_scored_by_the_grammar(text, score):
    assert clause_score(text) == pytest.approx(score)


@pytest.mark.parametrize(
    ("text", "score"),
    [
        ("I would never hurt you", 3 * 0.4),
        ("he said he would kill you", 3 * 0.6),
        ("he said he would not kill you", 3 * 0.24),
        ("I will kill never hurt you", 3.0),
        ("I never ever hurt it but I kill you", 3.0),
        ('he said: "you idiot"', 2 * 0.6 * 1.3),
        ('he said, "I will kill you"', 3 * 0.6),
        ('he said to me: "idiot"', 2 * 0.6),
        ("he wrote, idiot", 2 * 0.6),
        ("he wrote it, idiot", 2.0),
        ('what he "said" idiot', 2.0),
        ('he said: "fine" idiot', 2.0),
        ("he said. you idiot", 2.6),
    ],
)
def test_denied_and_reported_threats_and_quoted_insults_are_weaker(text, score):
    assert clause_score(text) == pytest.approx(score)


@pytest.mark.parametrize(
    ("text", "score"),
    [
        ("not at all an idiot", 2 * 0.4),
        ("he has not, in any way, been an idiot", 2 * 0.4 * 1.0),
        ("he has not, in any way. been an idiot", 2.0),
        ("he did not, idiot", 2.0),
        ("it was not good but idiot work", 2.0),
        ("no. idiot", 2.0),
        ("idiot, you", 2 * 1.3),
        ("you, idiot", 2 * 1.3),
        ("idiot that you are", 2 * 1.3),
        ("you idiot you", 2 * 1.3),
        ("an idiot, he thought", 2.0),
        ("it is not you, idiot", 2 * 0.4 * 1.3),
        ("idiot x x you", 2.0),
        ("I will murder you", 3.0),
        ("I'll stab you", 3.0),
    ],
)
def test_negation_reaches_to_the_end_and_the_addressed_may_stand_on_both_sides(text, score):
    assert clause_score(text) == pytest.approx(score)


def test_commas_between_texts_join_nothing():
    ev = LEXICON.evidence(pa.array(["he did not,", "ever, idiot", "you,", "idiot", "not,"]))
    assert ev[:, 0].tolist() == pytest.approx([0, 2, 0, 2, 0])


def test_a_threat_has_the_weight_of_its_verb():
    lexicon = t.Lexicon({"idiot": 2.0}, {"flog": 5.0, "beat": 0.7})
    found = lexicon.evidence(pa.array(["I flog you", "we beat them", "we never beat or flog you", "they beat it", "I kill you"]))[:, 0]
    assert found.tolist() == pytest.approx([5.0, 0.7, 5 * 0.4, 0, 0])


def plain_frames(rows, least):
    """Threat verbs by plain counting."""
    grammatical = {w for kind, words in t.WORDS.items() if kind not in (t.INSULT, t.THREAT) for w in words.split()}
    targets = set((t.WORDS[t.TARGET] + " " + t.WORDS[t.YOU]).split())
    bad, good, toxic = Counter(), Counter(), sum(label for _, label in rows)
    clean, rate = len(rows) - toxic, toxic / len(rows)
    for text, label in rows:
        words = text.lower().split()
        (bad if label else good).update({a for a, b in zip(words, words[1:]) if b in targets and a not in grammatical})
    found = dict.fromkeys(t.WORDS[t.THREAT].split(), t.MENACE_WEIGHT)
    for verb in {*bad, *good}:
        a, b = bad[verb], good[verb]
        share = (a + 0.001) / (a + b + 0.002)
        ratio = 2 * (a * math.log(share / rate) + b * math.log((1 - share) / (1 - rate)))
        odds = math.log(((a + 0.5) / (toxic + 1)) / ((b + 0.5) / (clean + 1)))
        if (ratio >= least and share > 0.5) or (verb in found and a + b >= 10):
            found[verb] = min(t.MOST_WEIGHT, odds)
    return {verb: weight for verb, weight in found.items() if weight > 0.5}


def test_threats_are_learnt_from_what_stands_before_targets(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(400):
        words, toxic = prose(rnd, 40), i % 6 == 0
        at = rnd.randrange(40)
        words[at:at] = [rnd.choice(["flog", "maim"]) if toxic else rnd.choice(["thank", "beat"]), rnd.choice(["You", "them"])]
        words.append(rnd.choice(["flog", "thank"]))  # the verb alone tells nothing
        rows.append((" ".join(words), int(toxic)))
    sample = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, label int")
    got, want = t.train(sample).lexicon.threats, plain_frames(rows, 16.0)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert {"flog", "maim"} <= got.keys() and not {"thank", "beat"} & got.keys()


def test_speech_does_not_reach_into_the_next_text():
    assert LEXICON.evidence(pa.array(["he said:", '"idiot"']))[:, 0].tolist() == [0.0, 2.0]


def test_clauses_end_at_punctuation_and_texts():
    ev = LEXICON.evidence(pa.array(["you", "idiot. not", "stupid", "you x x x x x idiot", "été"]))
    assert ev[:, 0].tolist() == pytest.approx([0, 2, 2, 2, 1])
    assert ev[:, 2].tolist() == [0, 1, 1, 1, 1] and ev[:, 4].tolist() == [1, 2, 1, 7, 1]


def labelled(spark, n=900):
    rnd = random.Random(9)
    rows, labels = [], []
    bad = [f"zorb{c}" for c in "abcdefgh"]
    for i in range(n):
        toxic = rnd.random() < 0.15
        words = prose(rnd, 60)
        if toxic:
            for _ in range(4):
                words[rnd.randrange(60)] = rnd.choice(bad)
        rows.append((i, " ".join(words) + "."))
        labels.append((i, int(toxic)))
    return rows, spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, toxic int")


def test_held_out_documents_are_told_apart(spark):
    rows, labels = labelled(spark)
    rows += [(9000, None), (9001, ""), (None, "zorba zorbb"), rows[0]]
    docs = documents(spark, rows, CLASHING)
    truth = {r.doc_id: r.toxic for r in labels.collect() if r.toxic is not None}
    got = t.toxicity(docs, labels).collect()
    held = [(r.toxicity_score >= 0.3, truth[r.doc_id]) for r in got if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(held) > 150 and np.mean([a == b for a, b in held]) > 0.97
    assert len(got) == len(rows) and all(0 <= r.toxicity_score <= 1 for r in got)


def test_without_labels_plain_insults_count(spark):
    rows, labels = labelled(spark, 20)
    docs = documents(spark, [(1, "you stupid idiot"), (2, "good morning")])
    got = {r.doc_id: r.toxicity_score for r in t.toxicity(docs, labels.limit(0)).collect()}
    assert got[1] > 0.9 and got[2] <= 0.5
    assert t.toxicity(docs.limit(0), labels).count() == 0
