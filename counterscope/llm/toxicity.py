"""Toxicity by a weighted finite-state grammar over clauses.

A lexicon turns words into symbols: insult, threat, target, addressed person, negation, contrast, reported speech, other.
Four small transducers are composed into one: negation weakens what follows it up to a contrast or the end of the clause,
reported speech weakens what follows it, a target before an insult strengthens it, and a threat counts only with a target
after it, as weakened. Before that, one more reads each clause from its end, for insults that the addressed person follows.
What a report verb introduces by a comma, a colon or a quote belongs to its clause; so does what stands between commas
after a negation, and a comma between an insult and the addressed person ends no clause. A document's evidence is the
sum, the maximum and the number of its matched clauses, and a logistic step turns it into a probability.

Insults are a few plain words plus what labelled documents teach: words and beginnings of words ("abcd*") that
occur mostly in toxic documents by a likelihood-ratio test, with their log odds as weight. Threats are a few verbs plus,
by the same test, words that stand right before a target mostly in toxic documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from counterscope.llm.quality import fold, labelled_sample, logistic
from counterscope.llm.shared import map_batches, staged
from counterscope.llm.words import NOT_LETTERS, Words, hash_of

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = "oitynr"
YOU, CONTRAST = "uc"
DIRECTED, MENACE = "dm"
# Threats that were denied, reported, or both
DENIED, REPORTED, BOTH = "123"
PAUSE = "p"  # between a report verb and what it introduces: nothing but reported speech reaches over it
WEAKENING = {THREAT: 1.0, REPORTED: 0.6, DENIED: 0.4, BOTH: 0.24}
WORDS = {
    INSULT: "idiot idiots moron morons stupid scum trash pathetic worthless disgusting loser losers clown imbecile "
    "dumb dumbass idiota estúpido estúpida imbécil basura idiote stupide crétin débile dummkopf trottel abschaum",
    THREAT: "kill hurt beat destroy smash strangle murder stab shoot matar matarte golpear asesinar tuer frapper poignarder "
    "töten umbringen schlagen ermorden erstechen",
    TARGET: "he she they them him her people ils elles sie",
    YOU: "you your you're youre ya tú te usted ustedes tu toi vous du dich ihr euch",
    NEGATION: "not no never isn't aren't don't wasn't nobody nunca jamás pas jamais nicht kein keine nie",
    CONTRAST: "but yet because why pero porque sino mais car aber sondern weil denn warum",
    REPORT: "said says called calls quoted wrote reported alleged dijo llamó écrit appelé sagte nannte schrieb",
}
SEED_WEIGHT, MENACE_WEIGHT, MOST_WEIGHT = 2.0, 3.0, 6.0
PREFIXES = (5, 6, 7, 8)
WORD = r"[^\x00-\x26\x28-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_CLAUSE_END = np.isin(np.arange(256), list(b".,;:!?()\n|\""))


@dataclass(frozen=True)
class Transducer:
    """Deterministic weighted transducer: (state, symbol) to (state, symbol, factor), starting in state 0."""

    arcs: dict[tuple[int, str], tuple[int, str, float]]

    def then(self, other: Transducer) -> Transducer:
        """The composition: this one's output is the other's input, factors multiply."""
        symbols = {symbol for _, symbol in self.arcs}
        numbers, todo, arcs = {(0, 0): 0}, [(0, 0)], {}
        while todo:
            pair = todo.pop()
            for symbol in symbols:
                mine, middle, factor = self.arcs[pair[0], symbol]
                its, out, more = other.arcs[pair[1], middle]
                if (mine, its) not in numbers:
                    numbers[mine, its] = len(numbers)
                    todo.append((mine, its))
                arcs[numbers[pair], symbol] = (numbers[mine, its], out, factor * more)
        return Transducer(arcs)

    def read(self, symbols: Iterator[str]) -> list[tuple[str, float]]:
        state, out = 0, []
        for symbol in symbols:
            state, symbol, factor = self.arcs[state, symbol]
            out.append((symbol, factor))
        return out


ALPHABET = OTHER + INSULT + THREAT + TARGET + YOU + NEGATION + CONTRAST + REPORT + DIRECTED + MENACE + DENIED + REPORTED + BOTH + PAUSE
# How far a threat reaches to its target, and what a parenthesis or quote may hold, in words
REACH, ASIDE = 3, 8


def _window(opens: str, length: int, effects: dict[str, tuple[str, float]], over_pause: bool = False) -> Transducer:
    """For ``length`` symbols after one of ``opens``, symbols change as ``effects`` says; a pause ends it or is not counted."""
    arcs = {}
    for left in range(length + 1):
        for symbol in ALPHABET:
            out, factor = effects.get(symbol, (symbol, 1.0)) if left else (symbol, 1.0)
            then = (left if over_pause else 0) if symbol == PAUSE else max(0, left - 1)
            arcs[left, symbol] = (length if symbol in opens else then, out, factor)
    return Transducer(arcs)


def _scope(opens: str, closes: str, effects: dict[str, tuple[str, float]]) -> Transducer:
    """From one of ``opens`` to one of ``closes``, symbols change as ``effects`` says."""
    arcs = {}
    for inside in (0, 1):
        for symbol in ALPHABET:
            out, factor = effects.get(symbol, (symbol, 1.0)) if inside else (symbol, 1.0)
            arcs[inside, symbol] = (1 if symbol in opens else 0 if symbol in closes else inside, out, factor)
    return Transducer(arcs)


def _menaces(length: int) -> Transducer:
    """A target among ``length`` symbols after a threat becomes a menace, as weak as the strongest such threat is.

    A state is how many symbols each threat still reaches, strongest first; one that a stronger one outlasts is left out.
    """
    kinds = list(WEAKENING)
    numbers, todo, arcs = {(0,) * len(kinds): 0}, [(0,) * len(kinds)], {}
    while todo:
        state = todo.pop()
        strongest = next((kind for kind, left in zip(kinds, state) if left), None)
        for symbol in ALPHABET:
            lefts, most = [], 0
            for kind, left in zip(kinds, state):
                left = length if symbol == kind else 0 if symbol == PAUSE else max(0, left - 1)
                lefts.append(left if left > most else 0)
                most = max(most, left)
            if (then := tuple(lefts)) not in numbers:
                numbers[then] = len(numbers)
                todo.append(then)
            out = (MENACE, WEAKENING[strongest]) if symbol in (TARGET, YOU) and strongest else (symbol, 1.0)
            arcs[numbers[state], symbol] = (numbers[then], *out)
    return Transducer(arcs)


def grammar() -> Transducer:
    """Negation, reported speech, targets and threats composed into one machine."""
    denied = {INSULT: (INSULT, 0.4), DIRECTED: (DIRECTED, 0.4), THREAT: (DENIED, 1.0)}
    reported = {INSULT: (INSULT, 0.6), DIRECTED: (DIRECTED, 0.6), THREAT: (REPORTED, 1.0), DENIED: (BOTH, 1.0)}
    negation = _scope(NEGATION, CONTRAST + PAUSE, denied)
    report = _window(REPORT, ASIDE, reported, over_pause=True)
    target = _window(TARGET + YOU, 4, {INSULT: (DIRECTED, 1.3)})
    return negation.then(report).then(target).then(_menaces(REACH))


def addressed() -> Transducer:
    """What reads a clause from its end: the addressed person up to two words after an insult strengthens it."""
    return _window(YOU, 2, {INSULT: (DIRECTED, 1.3)})


@dataclass(frozen=True)
class Lexicon:
    """Weights of insult terms, where one that ends with * stands for longer words that begin so, and of threats."""

    insults: dict[str, float]
    threats: dict[str, float] = field(default_factory=lambda: dict.fromkeys(WORDS[THREAT].split(), MENACE_WEIGHT))
    machine: Transducer = field(default_factory=grammar)
    backwards: Transducer = field(default_factory=addressed)

    def __post_init__(self):
        symbols = {word: symbol for symbol, words in WORDS.items() if symbol not in (INSULT, THREAT) for word in words.split()}
        whole = {hash_of(w): (INSULT, v, w) for w, v in self.insults.items() if not w.endswith("*")}
        whole |= {h: (s, 0.0, w) for w, s in symbols.items() if (h := hash_of(w)) not in whole}
        whole |= {h: (THREAT, v, w) for w, v in self.threats.items() if (h := hash_of(w)) not in whole}
        starts: dict[int, dict[int, tuple]] = {}
        for term, weight in self.insults.items():
            if term.endswith("*"):
                size = len(term[:-1].encode())
                starts.setdefault(size, {})[hash_of(term[:-1])] = (INSULT, weight, term)
        object.__setattr__(self, "whole", whole)
        object.__setattr__(self, "starts", dict(sorted(starts.items(), reverse=True)))

    @staticmethod
    def _found(hashes: np.ndarray, known: dict[int, tuple]) -> np.ndarray:
        """Positions of hashes that are known, after a look at their first 16 bits."""
        keys = np.fromiter(known, dtype=np.uint64, count=len(known))
        likely = np.zeros(1 << 16, dtype=bool)
        likely[(keys >> np.uint64(48)).astype(np.int64)] = True
        at = np.flatnonzero(likely[(hashes >> np.uint64(48)).astype(np.int64)])
        return at[np.isin(hashes[at], keys)]

    @staticmethod
    def _spoken(words: Words, reports: list[int], triggers: np.ndarray) -> np.ndarray:
        """Places of marks that end no clause, as a report verb before them introduces what follows.

        A comma counts right after the verb, a colon or an opening quote within its reach of eight words.
        """
        found = []
        for i in reports:
            at = np.searchsorted(triggers, i)
            if at == len(triggers) or triggers[at] > i + ASIDE:
                continue
            stop = words.offsets[np.searchsorted(words.offsets, words.first[i], "right")]
            for k in range(i, min(i + ASIDE, len(words.first) - 1)):
                lo, hi = int(words.end[k]), int(words.first[k + 1])
                if hi >= stop:
                    break
                gap = words.data[lo:hi]
                marks = np.flatnonzero(_CLAUSE_END[gap])
                if not len(marks):
                    continue
                kinds = gap[marks].tobytes()
                opening = b'"' in kinds and gap[0] != ord('"')
                if not kinds.strip(b',:"') and gap[0] != ord('"') and (k == i or b":" in kinds or opening):
                    found.append(marks + lo)
                break
        return np.concatenate(found) if found else np.zeros(0, dtype=np.int64)

    @staticmethod
    def _joined(words: Words, terms: dict[int, tuple], triggers: np.ndarray) -> np.ndarray:
        """Places of commas that end no clause: between an insult and the addressed person, and around an aside after a negation."""
        found = []

        def marks(k: int) -> np.ndarray | None:
            """Places of marks between a word and the next of its text; None if there is none."""
            if not 0 <= k < len(words.first) - 1:
                return None
            if np.searchsorted(words.offsets, words.first[k], "right") != np.searchsorted(words.offsets, words.first[k + 1], "right"):
                return None
            lo = int(words.end[k])
            return np.flatnonzero(_CLAUSE_END[words.data[lo : int(words.first[k + 1])]]) + lo

        def comma(at: np.ndarray | None) -> bool:
            return at is not None and len(at) == 1 and words.data[at[0]] == ord(",")

        for i in triggers.tolist():
            for k, other in ((i - 1, i - 1), (i, i + 1)):
                if terms[i][0] == INSULT and other in terms and terms[other][0] == YOU and comma(at := marks(k)):
                    found.append(at)
        for i in sorted(i for i, term in terms.items() if term[0] == NEGATION):
            nearest = np.searchsorted(triggers, i)
            if nearest == len(triggers) or triggers[nearest] > i + 2 * ASIDE or not comma(first := marks(i)):
                continue
            for k in range(i + 1, i + 1 + ASIDE):
                if (at := marks(k)) is None or len(at):
                    if comma(at):
                        found += [first, at]
                    break
        return np.concatenate(found) if found else np.zeros(0, dtype=np.int64)

    def evidence(self, column: pa.Array) -> np.ndarray:
        """For every text: sum and maximum of its clause scores, matched clauses, matched words, all words."""
        words = Words(column, NOT_LETTERS, tuple(self.starts))
        n = len(column)
        out = np.zeros((n, 5))
        out[:, 4] = np.diff(words.bounds)
        terms: dict[int, tuple] = {}
        for size, known in self.starts.items():
            for i in self._found(words.starts[size], known).tolist():
                terms.setdefault(i, known[int(words.starts[size][i])])
        for i in self._found(words.hashes, self.whole).tolist():
            terms[i] = self.whole[int(words.hashes[i])]
        triggers = np.array(sorted(i for i, t in terms.items() if t[0] in (INSULT, THREAT)), dtype=np.int64)
        if not len(triggers):
            return out
        ends = np.union1d(np.flatnonzero(_CLAUSE_END[words.data]), words.offsets)
        reports = [i for i, t in terms.items() if t[0] == REPORT]
        spoken = self._spoken(words, sorted(reports), triggers)
        ends = np.setdiff1d(ends, np.concatenate([spoken, self._joined(words, terms, triggers)]))
        pauses = set(np.searchsorted(words.first, spoken).tolist())  # words that come after one
        clause = np.searchsorted(ends, words.first[triggers], "right")
        for c in np.unique(clause):
            lo = np.searchsorted(words.first, ends[c - 1])
            hi = np.searchsorted(words.first, ends[c]) if c < len(ends) else len(words.first)
            row = int(np.searchsorted(words.offsets, words.first[lo], "right") - 1)
            inside = range(max(lo, int(triggers[np.searchsorted(clause, c)]) - 16), hi)
            steps = [s for i in inside for s in ([(i, PAUSE)] if i in pauses else []) + [(i, terms[i][0] if i in terms else OTHER)]]
            back = self.backwards.read(symbol for _, symbol in reversed(steps))[::-1]
            read = self.machine.read(symbol for symbol, _ in back)
            total, threats = 0.0, []
            for step, ((i, _), (_, raised), (symbol, factor)) in enumerate(zip(steps, back, read)):
                if symbol in (INSULT, DIRECTED):
                    total += raised * factor * terms[i][1]
                    out[row, 3] += 1
                elif symbol in WEAKENING:
                    threats.append((step, terms[i][1]))
                elif symbol == MENACE:
                    total += factor * max(weight for at, weight in threats if step - at <= REACH)
            if total > 0:
                out[row, 0] += total
                out[row, 1] = max(out[row, 1], total)
                out[row, 2] += 1
        return out


def _inputs(evidence: np.ndarray) -> np.ndarray:
    total, most, clauses, hits, words = evidence.T
    return np.column_stack([np.log1p(total), np.minimum(most, 12) / 6, np.log1p(hits), np.log1p(100 * hits / (words + 20))])


@dataclass(frozen=True)
class ToxicityModel:
    lexicon: Lexicon
    slopes: np.ndarray
    shift: float

    def probability(self, column: pa.Array) -> np.ndarray:
        z = _inputs(self.lexicon.evidence(column)) @ self.slopes + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _terms(sample: DataFrame) -> DataFrame:
    """(term, part counts) of a sample (doc_id, text, label): documents with each word and each beginning of one."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = F.array_distinct(F.regexp_extract_all(F.translate("text", upper, lower), F.lit(WORD), F.lit(0)))

    def beginnings(m: int):
        longer = F.filter("words", lambda w: F.length(w) > m)
        return F.array_distinct(F.transform(longer, lambda w: F.concat(F.substring(w, 1, m), F.lit("*"))))

    kinds = F.flatten(F.array("words", *[beginnings(m) for m in PREFIXES]))
    each = sample.select("label", "half", words.alias("words")).select("label", "half", F.explode(kinds).alias("term"))
    toxic = F.col("label") == 1
    return each.groupBy("term").agg(
        F.count_if(toxic).alias("t"), F.count_if(~toxic).alias("n"), F.count_if(toxic & F.col("half")).alias("t1"),
        F.count_if(~toxic & F.col("half")).alias("n1"),
    )


def _frames(sample: DataFrame) -> DataFrame:
    """(term, part counts) as of ``_terms``, for words that stand right before a target; words of the grammar are none."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    targets = "|".join((WORDS[TARGET] + " " + WORDS[YOU]).split())
    letter = WORD.removesuffix("+")
    frame = rf"({WORD}) +(?=(?:{targets})(?!{letter}))"
    verbs = F.array_distinct(F.regexp_extract_all(F.translate("text", upper, lower), F.lit(frame), F.lit(1)))
    each = sample.select("label", "half", F.explode(verbs).alias("term"))
    grammatical = [word for symbol, words in WORDS.items() if symbol not in (INSULT, THREAT) for word in words.split()]
    toxic = F.col("label") == 1
    return each.filter(~F.col("term").isin(grammatical)).groupBy("term").agg(
        F.count_if(toxic).alias("t"), F.count_if(~toxic).alias("n"), F.count_if(toxic & F.col("half")).alias("t1"),
        F.count_if(~toxic & F.col("half")).alias("n1"),
    )


def _weights(
    terms: DataFrame, t: str, n: str, toxic: int, clean: int, least: float, most_terms: int, kind: str = INSULT, start: float = SEED_WEIGHT
) -> dict[str, float]:
    """Terms whose likelihood ratio against independence is at least ``least`` and that are toxic mostly.

    At most ``most_terms``, the strongest. Plain words of the kind start with ``start`` and follow their own counts once seen ten times.
    """
    rate = toxic / max(1, toxic + clean)
    a, b = F.col(t).cast("double"), F.col(n).cast("double")
    share = (a + 0.001) / (a + b + 0.002)
    ratio = 2 * (a * F.log(share / rate) + b * F.log((1 - share) / (1 - rate)))
    odds = F.log(((a + 0.5) / (toxic + 1)) / ((b + 0.5) / (clean + 1)))
    seeds = WORDS[kind].split()
    scored = terms.withColumn("ratio", ratio).withColumn("odds", odds)
    learnt = scored.filter((F.col("ratio") >= least) & (share > 0.5)).orderBy(F.desc("ratio"), "term").limit(most_terms).collect()
    seen = scored.filter(F.col("term").isin(seeds) & (a + b >= 10)).collect()
    found = dict.fromkeys(seeds, start)
    for row in [*seen, *learnt]:
        found[row["term"]] = float(min(MOST_WEIGHT, row["odds"]))
    return {term: weight for term, weight in found.items() if weight > 0.5}


def train(sample: DataFrame, least: float = 16.0, most_terms: int = 4000) -> ToxicityModel:
    """Learn from a bounded sample (doc_id, text, label 0 or 1).

    Terms found in one half of the sample are tried on the other half to set the logistic step, so that this
    does not rely on terms having been chosen for the very documents; the terms kept are those of the whole sample.
    """
    half = F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2)) == 0
    sample = staged(sample.withColumn("half", half), "toxic-sample")
    count = lambda c: F.count_if(c)
    bad = F.col("label") == 1
    n = sample.agg(
        count(bad).alias("t"), count(~bad).alias("n"), count(bad & F.col("half")).alias("t1"), count(~bad & F.col("half")).alias("n1")
    ).first()
    if not n["t"] or not n["n"]:
        rate = (n["t"] + 1) / (n["t"] + n["n"] + 2)
        seeds = dict.fromkeys(WORDS[INSULT].split(), SEED_WEIGHT)
        return ToxicityModel(Lexicon(seeds), np.array([0.5, 1.0, 0.5, 0.5]), float(np.log(rate / (1 - rate))))
    terms = staged(_terms(sample).filter("t >= 3 or n >= 10"), "toxic-terms")
    frames = staged(_frames(sample), "toxic-frames")

    def lexicon(*part) -> Lexicon:
        insults = _weights(terms, *part, least, most_terms)
        return Lexicon(insults, _weights(frames, *part, least, most_terms, THREAT, MENACE_WEIGHT))

    trial = lexicon("t1", "n1", n["t1"], n["n1"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [pa.array(c) for c in trial.evidence(batch.column("text")).T]
            yield pa.RecordBatch.from_arrays([*columns, batch.column("label")], ["a", "b", "c", "d", "e", "label"])

    other = sample.filter("not half").select("text", F.col("label").cast("int").alias("label"))
    kinds = "a double, b double, c double, d double, e double, label int"
    got = np.array(map_batches(other, run, kinds).collect(), dtype=float).reshape(-1, 6)
    slopes, shift = logistic(_inputs(got[:, :5]), got[:, 5], penalty=0.3)
    return ToxicityModel(lexicon("t", "n", n["t"], n["n"]), slopes, float(shift))


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """All columns of ``docs`` and ``toxicity_score``, from the whole text alone; null text counts as empty."""
    name = "toxicity_score"
    rest = [f for f in docs.schema.fields if f.name != name]
    columns = [F.col(f"`{f.name}`") for f in rest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            step = max(1, min(512, whole.num_rows * (1 << 22) // max(1, whole.nbytes)))
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                result = pa.array(model.probability(batch.column("text")), pa.float64())
                yield pa.RecordBatch.from_arrays([*batch.columns, result], [*batch.schema.names, name])

    return map_batches(docs.select(*columns), run, T.StructType([*rest, T.StructField(name, T.DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = 20_000, parts: int = 4, held_out: int = 2) -> DataFrame:
    """Score documents (doc_id, text) after training on labels (doc_id, toxic) of ids outside one fold of ``parts``.

    At most ``sample`` labelled texts train the model. All columns of ``docs`` come back with toxicity_score
    (0 to 1). Empty and null texts have no evidence. Without labels of both kinds only the plain words count.

    Texts are scored whole, by batches of some 4 MB or one longer text. Equal texts have equal scores, however often they are
    repeated. Of learnt terms the 4,000 with the largest ratio are kept, ties by the term; terms in fewer than three toxic and ten other
    texts of the sample are not learnt. An empty table gives no rows. Other columns keep their values; toxicity_score is replaced.
    """
    chosen = labelled_sample(docs, labels, "toxic", fold(parts) != held_out, sample)
    return score(docs, train(chosen))
