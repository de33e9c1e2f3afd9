"""Toxicity by a weighted finite-state grammar over clauses.

A lexical transducer turns words into symbols with weights of their own. Four letter
transducers - negation, reported speech, target, threat - are composed behind it; their arcs
carry what they add to a clause. The weights of these arcs are learned on matched clauses,
and a text's score joins its clauses' chances.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Hashable, Iterable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import by_batch, pick, stored, unused

# The grammar's starting vocabulary, English, German, French and Spanish.
INSULTS = (
    "idiot idiots idiotic moron morons moronic stupid dumb dumbass fool loser losers scum trash garbage pathetic worthless disgusting clown clowns imbecile cretin jerk creep freak "
    "vermin filth filthy parasite bastard bitch asshole shit shithead fuck fucker fucking whore slut retard retarded subhuman degenerate coward liar pig pigs ugly useless hate despicable repulsive "
    "dummkopf trottel arschloch abschaum wichser schwein hurensohn missgeburt vollidiot "
    "imbécile crétin connard salaud ordure abruti débile pourriture "
    "imbécil estúpido estúpida cabrón gilipollas mierda escoria payaso inútil asqueroso"
).split()
THREATS = "kill murder hurt beat stab shoot destroy strangle burn hang rape töten umbringen tuer matar".split()
TARGETS = "you your you're youre u yourself they them he she him her his their these those du dich dir dein deine ihr euch sie tu toi vous te ton ta votre usted ustedes ellos ella él os".split()
NEGATIONS = "not no never isn't aren't wasn't weren't don't doesn't didn't won't isnt arent wasnt werent dont doesnt didnt wont nobody neither nor without hardly nicht kein keine nie niemals ohne pas jamais aucun sans nunca ni sin".split()
REPORTS = "said says say told called calls claimed wrote reported quoted quote allegedly sagte schrieb nannte dit déclaré écrit appelé dijo escribió llamó".split()
INTENTS = "will shall gonna going must should i'll we'll i'd werde werden wirst vais vas vont voy vamos".split()

INSULT, THREAT, TARGET, NEGATION, REPORT, INTENT, OTHER = "ithnrmo"
DENIED_INSULT, QUOTED_INSULT, NO_THREAT = "dqk"
#: What arcs may add to a clause; the first three by the weight of the word, the others by one.
INSULTED, DENIED, QUOTED, DIRECTED, THREATENED, MENACED = range(6)
BY_WORD = 3
WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)*")
CLAUSE_END = re.compile(r"[.!?;:\n]")
#: Weights before labels speak: a clause's bias, then one for each of the six, and how firmly each holds.
PRIOR = np.array([-4.0, 1.6, 0.4, 0.4, 1.0, 0.4, 5.0])
FIRM = np.array([0.5, 0.5, 2.0, 2.0, 2.0, 2.0, 2.0])
#: Chance that a text without any matched clause is toxic.
GROUND = 0.01
KNOWN_WEIGHT, MOST_WEIGHT = 3.0, 4.0
KEPT_WORDS = 150_000

State = Hashable
Adds = tuple[int, ...]


class Transducer(NamedTuple):
    """A deterministic letter transducer: step(state, symbol) gives the next state, the symbol written and what the arc adds."""

    start: State
    step: Callable[[State, str], tuple[State, str, Adds]]

    def then(self, other: Transducer) -> Transducer:
        """Composition: `other` reads what this one writes; what both arcs add goes together."""

        def step(state: State, symbol: str) -> tuple[State, str, Adds]:
            first, written, mine = self.step(state[0], symbol)
            second, out, theirs = other.step(state[1], written)
            return (first, second), out, mine + theirs

        return Transducer((self.start, other.start), step)


def rewriting(opener: str, rewritten: dict[str, str], reach: int) -> Transducer:
    """Rewrites symbols that come at most `reach` symbols after an opener."""

    def step(left: int, symbol: str) -> tuple[int, str, Adds]:
        out = rewritten.get(symbol, symbol) if left else symbol
        return (reach if symbol == opener else max(0, left - 1)), out, ()

    return Transducer(0, step)


def targeting(before: int, after: int) -> Transducer:
    """Adds insults, and that they are directed at a target at most so many symbols before or after."""

    def step(state: tuple[int, int], symbol: str) -> tuple[tuple[int, int], str, Adds]:
        near, waiting = state
        rest = max(0, near - 1), max(0, waiting - 1)
        if symbol == TARGET:
            return (before, 0), symbol, (DIRECTED,) if waiting else ()
        if symbol == INSULT:
            return (rest[0], 0 if near else after), symbol, (INSULTED, DIRECTED) if near else (INSULTED,)
        return rest, symbol, {DENIED_INSULT: (DENIED,), QUOTED_INSULT: (QUOTED,)}.get(symbol, ())

    return Transducer((0, 0), step)


def threatening(before: int, after: int) -> Transducer:
    """Adds threats, and menaces: a threat at most `before` symbols after an intent that has its target at most `after` symbols on."""

    def step(state: tuple[int, int], symbol: str) -> tuple[tuple[int, int], str, Adds]:
        near, waiting = state
        rest = max(0, near - 1), max(0, waiting - 1)
        if symbol == INTENT:
            return (before, rest[1]), symbol, ()
        if symbol == THREAT:
            return (rest[0], after if near else rest[1]), symbol, (THREATENED,)
        if symbol == TARGET and waiting:
            return (rest[0], 0), symbol, (MENACED,)
        return rest, symbol, ()

    return Transducer((0, 0), step)


class Composed:
    """The table of a transducer, made as clauses reach its states."""

    def __init__(self, machine: Transducer):
        self.machine, self.number, self.states = machine, {machine.start: 0}, [machine.start]
        self.rows: list[dict[str, tuple[int, Adds]]] = [{}]

    def arc(self, state: int, symbol: str) -> tuple[int, Adds]:
        following, _, adds = self.machine.step(self.states[state], symbol)
        if following not in self.number:
            self.number[following] = len(self.states)
            self.states.append(following)
            self.rows.append({})
        self.rows[state][symbol] = found = self.number[following], adds
        return found

    def __call__(self, symbols: Iterable[str], weights: Iterable[float]) -> tuple[float, ...]:
        """What a clause's arcs add: six sums."""
        state, total, rows = 0, [0.0] * 6, self.rows
        for symbol, weight in zip(symbols, weights):
            state, adds = rows[state].get(symbol) or self.arc(state, symbol)
            for x in adds:
                total[x] += weight if x < BY_WORD else 1.0
        return tuple(total)


# Denial comes first: what it rewrites is no longer an insult or a threat to those after it.
GRAMMAR = (
    rewriting(NEGATION, {INSULT: DENIED_INSULT, THREAT: NO_THREAT}, 3)
    .then(rewriting(REPORT, {INSULT: QUOTED_INSULT, THREAT: NO_THREAT}, 8))
    .then(targeting(4, 5))
    .then(threatening(3, 3))
)

STEMS = (4, 5, 6)
Lexicon = dict[str, tuple[str, float]]


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower().replace("’", "'"))


def stems_and_words(words: Iterable[str]) -> set[str]:
    """The words, and their openings of STEMS characters marked by a star."""
    found = set(words)
    return found | {w[:n] + "*" for w in found for n in STEMS if len(w) > n}


def telling_weight(clean: float, toxic: float, base: float, known: bool = False) -> float:
    """How much a word speaks for a toxic clause: its shrunk log odds over those of all documents, 0 to MOST_WEIGHT."""
    a, b = (1.9, 0.1) if known else (2 * base, 2 * (1 - base))
    return float(min(MOST_WEIGHT, max(0.0, np.log((toxic + a) / (clean + b)) - np.log(base / (1 - base)))))


def lexicon(counts: dict[str, tuple[int, int]] | None = None, base: float = 0.1) -> Lexicon:
    """Word or starred stem to symbol and weight: the lexical transducer.

    counts: numbers of clean and of toxic documents of a word. A word joins the insults if
    three toxic documents have it, a stem if eight have; at most one in ten of all that have
    it may be clean. Known insults start from KNOWN_WEIGHT, which counts correct.
    """
    counts = counts or {}
    out: Lexicon = {w: (INSULT, telling_weight(c, t, base)) for w, (c, t) in counts.items() if c * 9 <= t and t >= (8 if w.endswith("*") else 3)}
    for w in INSULTS:
        c, t = counts.get(w, (0, 0))
        out[w] = INSULT, telling_weight(c, t, base, True) if c + t else KNOWN_WEIGHT
    for words, symbol in ((THREATS, THREAT), (TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTS, REPORT), (INTENTS, INTENT)):
        out.update((w, (symbol, 1.0)) for w in words)
    return out


class Matcher:
    """Finds the clauses of texts that have an insult or a threat and what the grammar adds for each."""

    def __init__(self, words: Lexicon, machine: Transducer = GRAMMAR):
        self.words, self.grammar = words, Composed(machine)
        self.known: dict[str, tuple[str, float]] = {}

    def _symbol(self, word: str) -> tuple[str, float]:
        get = self.words.get
        return get(word) or (len(word) > 4 and (get(word[:6] + "*") or get(word[:5] + "*") or get(word[:4] + "*"))) or (OTHER, 0.0)

    def clauses(self, text: str) -> list[tuple[float, ...]]:
        tokens = set(words_of(text))
        if len(self.known) > KEPT_WORDS:
            self.known = {}
        for w in tokens.difference(self.known):
            self.known[w] = self._symbol(w)
        if not any(self.known[w][0] in (INSULT, THREAT) for w in tokens):
            return []
        out = []
        for clause in CLAUSE_END.split(text.lower().replace("’", "'")):
            found = [self.known[w] for w in WORD.findall(clause)]
            symbols = [s for s, _ in found]
            if INSULT in symbols or THREAT in symbols:
                out.append(self.grammar(symbols, [w for _, w in found]))
        return out


def clause_logits(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return np.clip(weights[0] + values @ weights[1:], -30, 30)


def joined(clauses: list[tuple[float, ...]], weights: np.ndarray) -> float:
    """Score of a text: the chance that any of its matched clauses is toxic, or the ground chance comes true."""
    if not clauses:
        return GROUND
    return float(1 - (1 - GROUND) * np.exp(-np.logaddexp(0, clause_logits(np.array(clauses), weights)).sum()))


def fitted(texts: list[tuple[list[tuple[float, ...]], int]], steps: int = 400) -> np.ndarray:
    """Arc weights of most likely labels, with a prior around PRIOR: gradient steps of shrinking size.

    A text's label is that of any clause; clauses have no labels of their own.
    """
    texts = [t for t in texts if t[0]]
    if not texts:
        return PRIOR.copy()
    x = np.array([c for clauses, _ in texts for c in clauses])
    sizes = np.array([len(c) for c, _ in texts])
    starts, y = np.cumsum(sizes) - sizes, np.array([float(label) for _, label in texts])
    design, w, moved = np.column_stack([np.ones(len(x)), x]), PRIOR.copy(), np.zeros(len(PRIOR))
    for step in range(steps):
        z = clause_logits(x, w)
        clean = (1 - GROUND) * np.exp(-np.add.reduceat(np.logaddexp(0, z), starts))
        pull = np.where(y > 0, clean / np.maximum(1 - clean, 1e-9), -1.0)  # d log likelihood / d softplus sum
        slope = design.T @ (np.repeat(pull, sizes) / (1 + np.exp(-z))) - FIRM * (w - PRIOR)
        moved += slope * slope
        w = w + 0.3 * slope / np.sqrt(moved + 1e-9)
        w[1:] = np.maximum(w[1:], 0)  # no event lowers a score below that of an empty clause
    return w


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


class Model(NamedTuple):
    """The lexical transducer and the grammar's arc weights."""

    words: Lexicon
    weights: np.ndarray


def _signature(words: list[str]) -> int:
    """The least hash of the text's runs of three words: near copies mostly share it."""
    return min((xxhash.xxh64_intdigest(" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))), default=0) >> 1


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learn from a sample of at most fit_rows labelled documents, chosen by a hash of doc_id.

    Documents that are held out (crc32 of doc_id modulo 4 is 2) and labels other than 0
    and 1 are left aside; of several labels of a document the largest holds, and near copies
    count once. Words and word stems that tell the toxic documents join the insults. Arc
    weights are learned on clauses matched with words of the other half of the sample, so
    that no text vouches for its own words. Without labelled documents the prior stands.
    """
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows).withColumnRenamed("doc_id", "label_id")
    rows = pick(docs, id=id_col, text=text_col)
    labelled = rows.join(F.broadcast(chosen), F.col("id") == F.col("label_id")).select("text", "toxic")  # fit_rows rows at most

    def signed(batch: pa.RecordBatch) -> pa.RecordBatch:
        sigs = [_signature(words_of(t or "")) for t in batch.column(0).to_pylist()]
        return pa.record_batch([*batch.columns, pa.array(sigs, pa.int64())], names=["text", "toxic", "sig"])

    sample = stored(by_batch(labelled, signed, "text string, toxic int, sig long").groupBy("toxic", "sig").agg(F.min("text").alias("text")), "labelled")

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        seen: list[Counter[str]] = [Counter() for _ in range(4)]
        for toxic, sig, text in zip(*(c.to_pylist() for c in batch.columns)):
            seen[2 * (sig & 1) + toxic].update(stems_and_words(words_of(text or "")))
        words = list(set().union(*seen))
        return pa.record_batch([pa.array(words, pa.string()), *(pa.array([s[w] for w in words], pa.int64()) for s in seen)], names=["word", "c0", "t0", "c1", "t1"])

    sums = [F.sum(c).alias(c) for c in ("c0", "t0", "c1", "t1")]
    words = by_batch(sample.select("toxic", "sig", "text"), count, "word string, c0 long, t0 long, c1 long, t1 long").groupBy("word").agg(*sums)
    half = "(t{0} >= 2 and c{0} * 9 <= t{0})"
    # Three toxic documents each: the sample's size bounds how many can come.
    told = stored(words.where(f"t0 + t1 >= 3 and ((c0 + c1) * 9 <= t0 + t1 or {half.format(0)} or {half.format(1)})"), "telling-words")
    whole = told.where("not endswith(word, '*')")
    stems = whole.select(F.explode(F.array(*(F.concat(F.substring("word", 1, n), F.lit("*")) for n in STEMS))).alias("word")).groupBy("word").agg(F.count("*").alias("several")).where("several >= 3")
    kept = whole.union(told.join(F.broadcast(stems), "word", "left_semi")).union(words.join(F.broadcast(docs.sparkSession.createDataFrame([(w,) for w in INSULTS], "word string")), "word", "left_semi"))
    counts = {r["word"]: tuple(r)[1:] for r in kept.collect()}
    sizes = dict.fromkeys(((h, t) for h in (0, 1) for t in (0, 1)), 0) | {(r["h"], r["toxic"]): r["n"] for r in sample.groupBy((F.col("sig") % 2).alias("h"), "toxic").agg(F.count("*").alias("n")).collect()}
    base = (sizes[0, 1] + sizes[1, 1] + 1) / (sum(sizes.values()) + 10)
    every = lexicon({w: (c0 + c1, t0 + t1) for w, (c0, t0, c1, t1) in counts.items()}, base)
    # The other half has half the documents, so half as many need to tell.
    halves = [lexicon({w: (2 * n[2 * h], 2 * n[2 * h + 1]) for w, n in counts.items()}, base) for h in (0, 1)]

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        by_half = [Matcher(w) for w in halves]
        found = [by_half[1 - (sig & 1)].clauses(text or "") for sig, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        flat = [[x for c in set(clauses) for x in c] for clauses in found]  # equal clauses of a text count once
        return pa.record_batch([batch.column(0), pa.array(flat, pa.list_(pa.float64()))], names=["toxic", "x"])

    found = by_batch(sample.select("toxic", "sig", "text"), measure, "toxic int, x array<double>").where("size(x) > 0").collect()  # matched clauses of the sample
    return Model(every, fitted([([tuple(r["x"][i : i + 6]) for i in range(0, len(r["x"]), 6)], r["toxic"]) for r in sorted(found, key=lambda r: (r["toxic"], r["x"]))]))


def score_texts(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with the column score_col (replaced if there): how likely each whole text is toxic, 0 to 1.

    Null and empty texts get the ground chance, as texts without matched clauses do. An
    empty table gives no rows.
    """
    kept = docs.select(*(f"`{c}`" for c in docs.columns if c != score_col))
    at, weights, words = kept.columns.index(text_col), model.weights, model.words
    held: list[Matcher] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not held:
            held.append(Matcher(words))
        scores = [joined(sorted(set(held[0].clauses(t))), weights) if t else GROUND for t in batch.column(at).to_pylist()]
        return pa.record_batch([*batch.columns, pa.array(scores, pa.float64())], names=[f"c{i}" for i in range(batch.num_columns + 1)])

    schema = ", ".join([*(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(kept.schema)), f"c{len(kept.columns)} double"])
    return by_batch(kept, run, schema).toDF(*kept.columns, score_col)


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, fit_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, held_out, score, predicted), one for each input row.

    A null doc_id is not held out. Repeated rows get equal scores; other columns are
    ignored.
    """
    rows = pick(docs, doc_id=id_col, text=text_col)
    done = score_texts(rows, fit(rows, labels, fit_rows, "doc_id", "text"))
    return done.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, fit_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that score threshold or more; columns as they were.

    Each row is judged by its own text alone, whatever its doc_id.
    """
    score = unused(docs, "score")
    return score_texts(docs, fit(docs, labels, fit_rows, id_col, text_col), text_col, score).where(F.col(score) < threshold).drop(score)
