"""Toxicity by a weighted finite-state pattern grammar.

A lexicon transducer maps words to symbols (insult, threat, target, negation, reported
speech, pause, end, other) with weights. Four transducers read the symbols of a clause:

- insult: a target and an insult in one clause, in either order, are an *aimed* insult;
  an insult without a target is a *bare* one;
- threat: a verb of violence and a target, in either order, are a *threat*; without a
  target the verb is *loose*;
- negation: holds for SPAN words or to the end of the clause; a match whose words were
  all read under it is *negated*;
- report: a verb of reported speech makes the rest of its sentence *reported*, over
  pauses too.

They are composed into one table over the product of their states. Words emit nothing:
the weights of a clause's insults and verbs are carried along, and the arc that ends the
clause emits them under the pattern that the product has accepted there (kind and mode),
or drops them. A document's score is a logistic function of the patterns' sums, so the
same word counts by the pattern it stands in. One bare insult or loose verb and nothing
else is a word in passing and stays under 0.5, whatever was learned.

Learned, from a sample of at most about SAMPLE labelled documents (the bound that lets
it be broadcast): weights of insults, as words and as stems (prefixes), by log odds of
the number of different contexts (preceding words) in toxic and in other documents, all
of those that the odds and their standard error bear out; and the weights of patterns,
with PRIOR as what they are drawn to where the sample says nothing. Contexts, because
copies of one document are no further evidence. Every document is scored where it is, by
whole text: no shuffle.

Rows with crc32(doc_id as text) mod 5 = 0 are held out and never learned from.
Defined results: null and empty texts have no clause and so the least score; a null
doc_id is scored, not held out and not learned from; repeated rows are scored alike;
without labels of both kinds the seed lexicon and PRIOR are used as they stand; an empty
table gives an empty result; lang, source and other columns are not looked at; words of
more than LONGEST letters are no entries of their own."""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import tune

SAMPLE, CACHE, LONGEST = 20_000, 300_000, 64
PREFIXES, LEAST_CONTEXTS, LEAST_ODDS, LEAST_ERRORS = range(3, 9), 4, 2.5, 3.0

SEEDS = {
    "insult": "idiot idiots moron morons stupid scum loser losers pathetic worthless disgusting trash clown imbecile dumb dummkopf idiotisch blödmann arschloch trottel abschaum connard imbécile crétin ordure salaud estúpido imbécil basura escoria inútil".split(),
    "threat": "kill hurt destroy punch stab strangle töten umbringen vernichten tuer frapper détruire matar golpear destruir".split(),
    "target": "you your yours u he she they them him her du dich dir ihr sie euch tu te toi vous ils elle tú ti usted ustedes ellos él ella".split(),
    "negation": "not no never isn't aren't don't won't nicht kein keine niemals pas jamais aucun nunca jamás ni".split(),
    "report": "said says wrote quoted claimed called reported sagte sagt schrieb behauptete dit écrit affirme dijo dice escribió afirmó".split(),
}
SEED_WEIGHT = {"insult": 4.0, "threat": 3.0}
#: Words that negation holds for.
SPAN = 3
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?").findall
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[.!?;:,\n]").findall
SYMBOLS = ("other", "insult", "threat", "target", "negation", "report", "pause", "end")
_PAUSE, _END = SYMBOLS.index("pause"), SYMBOLS.index("end")
_MARKS = {c: _PAUSE for c in ",;:"} | {c: _END for c in ".!?\n"}
KINDS, MODES = ("bare", "aimed", "loose", "threat"), ("plain", "negated", "reported")
PATTERNS = tuple(itertools.product(KINDS, MODES))
#: Weight of each pattern's logarithm where labels say nothing, and the constant.
PRIOR = {"bare": (1.2, 0.2, 0.4), "aimed": (2.6, 0.3, 0.8), "loose": (0.3, 0.0, 0.1), "threat": (2.6, 0.3, 0.8)}
CONSTANT, LONE = -3.0, -0.05


class Transducer:
    """States 0..n-1, start 0; step(state, symbol) gives the next state and, where the symbol ends a clause, what was accepted."""

    def __init__(self, n: int, step: Callable[[int, str], tuple[int, str | None]]):
        self.n, self.step = n, step


def _pair(word: str, alone: str, both: str):
    """A word and a target in one clause, in either order. States: nothing, target, word, both."""

    def step(state: int, symbol: str) -> tuple[int, str | None]:
        if symbol in ("pause", "end"):
            return 0, {2: alone, 3: both}.get(state)
        if symbol == "target":
            return {0: 1, 2: 3}.get(state, state), None
        if symbol == word:
            return {0: 2, 1: 3}.get(state, state), None
        return state, None

    return step


def _negation(state: int, symbol: str) -> tuple[int, str | None]:
    """State: words that negation still holds for (0 to SPAN), and what matches were read: none, only negated ones, others."""
    left, met = state % (SPAN + 1), state // (SPAN + 1)
    if symbol in ("pause", "end"):
        return 0, "negated" if met == 1 else None
    if symbol in ("insult", "threat"):
        met = 2 if met == 2 or not left else 1
    return met * (SPAN + 1) + (SPAN if symbol == "negation" else max(0, left - 1)), None


def _report(state: int, symbol: str) -> tuple[int, str | None]:
    """A clause is reported from the verb on, and so are the later clauses of its sentence."""
    if symbol in ("pause", "end"):
        return (1 if state and symbol == "pause" else 0), "reported" if state else None
    return (1 if symbol == "report" else state), None


def compose(*parts: Transducer) -> list[list[tuple[int, tuple[str | None, ...]]]]:
    """Arcs of the composition: table[state][symbol] = (next state, what each part has accepted)."""
    states = list(itertools.product(*(range(p.n) for p in parts)))
    number = {s: i for i, s in enumerate(states)}
    table = []
    for state in states:
        row = []
        for symbol in SYMBOLS:
            went = [p.step(s, symbol) for p, s in zip(parts, state, strict=True)]
            row.append((number[tuple(s for s, _ in went)], tuple(a for _, a in went)))
        table.append(row)
    return table


PARTS = (Transducer(4, _pair("insult", "bare", "aimed")), Transducer(4, _pair("threat", "loose", "threat")), Transducer(3 * (SPAN + 1), _negation), Transducer(2, _report))


def _emitted(accepted: tuple[str | None, ...]) -> tuple[int, int]:
    """Numbers in PATTERNS of the insult's and of the verb's pattern, -1 for none."""
    insult, threat, negated, reported = accepted
    mode = reported or negated or "plain"
    return tuple(PATTERNS.index((kind, mode)) if kind else -1 for kind in (insult, threat))


GRAMMAR = [[(to, _emitted(accepted)) for to, accepted in row] for row in compose(*PARTS)]
_PRIOR = (CONSTANT, *(PRIOR[kind][MODES.index(mode)] for kind, mode in PATTERNS))


class Model:
    """learned: word, or prefix followed by "*", to weight (0 or less: not an insult); weights: a constant and a weight for each of PATTERNS."""

    def __init__(self, learned: dict[str, float] | None = None, weights: tuple[float, ...] = _PRIOR):
        self.learned = dict(learned or {})
        self.weights = tuple(weights)
        self._known: dict[str, tuple[int, float]] = {}

    def __getstate__(self):
        return {"learned": self.learned, "weights": self.weights, "_known": {}}

    def symbol(self, word: str) -> tuple[int, float]:
        """Number in SYMBOLS and weight: the strongest of the word's entries."""
        got = self._known.get(word)
        if got is None:
            own = [w for w in (self.learned.get(word), *(self.learned.get(word[:n] + "*") for n in PREFIXES if n <= len(word))) if w is not None]
            if word in _SEED_OF and _SEED_OF[word] not in ("insult", "threat"):
                got = SYMBOLS.index(_SEED_OF[word]), 0.0
            elif own and max(own) > 0:
                got = 1, max(own)
            elif word in _SEED_OF and self.learned.get(word, 1.0) > 0:
                got = SYMBOLS.index(_SEED_OF[word]), SEED_WEIGHT[_SEED_OF[word]]
            else:
                got = 0, 0.0
            if len(self._known) >= CACHE:
                self._known.clear()
            self._known[word] = got
        return got

    def clauses(self, text: str) -> list[tuple[int, float, str]]:
        """Number in PATTERNS, weight and words of the clauses that match, in order; a clause may match as an insult and as a threat."""
        state, insults, verbs, words, out = 0, 0.0, 0.0, [], []
        for token in itertools.chain(_TOKEN(text.lower()), "."):
            if (mark := _MARKS.get(token)) is not None:
                state, (insult, threat) = GRAMMAR[state][mark]
                if insult >= 0:
                    out.append((insult, insults, " ".join(words)))
                if threat >= 0:
                    out.append((threat, verbs, " ".join(words)))
                insults, verbs, words = 0.0, 0.0, []
                continue
            number, weight = self.symbol(token)
            state = GRAMMAR[state][number][0]
            if number == 1:
                insults += weight
            elif number == 2:
                verbs += weight
            words.append(token)
        return out

    def features(self, text: str | None) -> tuple[tuple[float, ...], bool]:
        """The logarithm of each pattern's weights, and whether all there is is one word without a target."""
        sums = [0.0] * len(PATTERNS)
        symbol = self.symbol
        words = _WORD((text or "").lower())
        if not any(symbol(w)[1] for w in set(words)):
            return tuple(sums), False
        found = self.clauses(text)
        for pattern, weight, _ in found:
            sums[pattern] += weight
        lone = len(found) == 1 and PATTERNS[found[0][0]][0] in ("bare", "loose") and sum(symbol(w)[1] > 0 for w in words) == 1
        return tuple(math.log1p(s) for s in sums), lone

    def score(self, text: str | None) -> float:
        got, lone = self.features(text)
        z = self.weights[0] + sum(a * b for a, b in zip(self.weights[1:], got, strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0 if not lone else LONE, z))))


_SEED_OF = {w: kind for kind, words in SEEDS.items() for w in words}


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def hash_of(word: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word) >> 1


def _contexts(batches: Iterator[pa.RecordBatch]):
    """(word, context, toxic): the words of the texts with the hash of the word before, each once in a batch."""
    for batch in batches:
        seen: set[tuple[str, str, int]] = set()
        for text, label in zip(batch.column(0), batch.column(1), strict=True):
            toxic, before = label.as_py(), "."
            for word in _WORD((text.as_py() or "").lower()):
                if len(word) <= LONGEST:
                    seen.add((word, before, toxic))
                before = word
        hashed = {w: hash_of(w) for w in {b for _, b, _ in seen}}
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _, _ in seen]), pa.array([hashed[b] for _, b, _ in seen], pa.int64()), pa.array([t for _, _, t in seen], pa.int32())], ["word", "context", "toxic"])


def lexicon(texts: DataFrame) -> dict[str, float]:
    """Entries (words, and prefixes followed by "*") with their log odds, of a bounded table of text and toxic.

    What comes to the driver are the entries that at least LEAST_CONTEXTS contexts of toxic texts, LEAST_ODDS and
    LEAST_ERRORS standard errors bear out; the sample's bound is theirs. Seeds that clean texts use more come with -1."""
    counts = texts.mapInArrow(_contexts, "word string, context long, toxic int").distinct().groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    total = F.struct(F.sum("t").alias("t"), F.sum("c").alias("c")).alias("n")
    heads = F.transform(F.filter(F.array(*map(F.lit, PREFIXES)), lambda n: n <= F.length("word")), lambda n: F.concat(F.substring("word", F.lit(1), n), F.lit("*")))
    entries = counts.select(F.explode(F.concat(F.array("word"), heads)).alias("entry"), "t", "c").groupBy("entry").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    entries = entries.crossJoin(F.broadcast(counts.agg(total)))  # one row of two sums
    t, c = F.col("t") + 0.5, F.col("c") + 0.5
    odds = F.log(t / F.greatest(F.lit(1), F.col("n.t"))) - F.log(c / F.greatest(F.lit(1), F.col("n.c")))
    borne = (F.col("t") >= LEAST_CONTEXTS) & (F.col("odds") >= LEAST_ODDS) & (F.col("odds") >= LEAST_ERRORS * F.sqrt(1 / t + 1 / c))
    denied = F.col("entry").isin(*SEEDS["insult"], *SEEDS["threat"]) & (F.col("c") > 3 * F.col("t") + 3)
    rows = entries.withColumn("odds", odds).filter(borne | denied).select("entry", F.when(denied, -1.0).otherwise(F.col("odds")).alias("odds")).collect()
    found = {r.entry: r.odds for r in rows}
    # an entry that a shorter prefix says as well is left out
    shorter = lambda e: (found.get(e[:n] + "*") for n in PREFIXES if n < len(e.rstrip("*")) or (n == len(e) and e[-1] != "*"))
    return {e: w for e, w in sorted(found.items()) if w < 0 or not any(s is not None and s >= w - 0.5 for s in shorter(e))}


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model of a sample of at most about ``sample`` labelled documents that are not held out."""
    tune(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)").filter(~held_out(F.col("doc_id")))
    n = known.count()
    share = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) < int((1 << 30) * min(1.0, 0.95 * sample / max(n, 1)))
    chosen = known.filter(share).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "toxic")
    model = Model(lexicon(texts))
    x, y = _features_of(texts, model)
    if 0 < y.sum() < len(y):
        model.weights = _fit(x, y)
    return model


def _features_of(texts: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the sample: a few numbers for each of at most about SAMPLE rows."""
    shared = texts.sparkSession.sparkContext.broadcast(model)
    names = [f"f{i}" for i in range(len(PATTERNS))] + ["y"]

    def run(batches):
        m = shared.value
        for batch in batches:
            got = [m.features(x.as_py())[0] for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*(pa.array([g[i] for g in got], pa.float64()) for i in range(len(PATTERNS))), batch.column(1).cast(pa.float64())], names)

    rows = texts.mapInArrow(run, ", ".join(f"{n} double" for n in names)).toPandas().sort_values(names).to_numpy(dtype=float).reshape(-1, len(names))
    return rows[:, :-1], rows[:, -1]


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, ...]:
    """Logistic regression by Newton's method, drawn to the prior weights, the rarer class weighed up to a third; no pattern weighs less than nothing."""
    a = np.column_stack((np.ones(len(x)), x))
    weight = np.where(y == 1, max(1.0, 0.5 * (len(y) - y.sum()) / y.sum()), 1.0)
    prior = np.array(_PRIOR)
    w = prior.copy()
    r = len(y) * ridge * np.eye(len(w))
    r[0, 0] *= 0.01
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        w = w + np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + r, a.T @ (weight * (y - p)) - r @ (w - prior))
    return (float(w[0]), *np.maximum(w[1:], 0.0).tolist())


_CLAUSES = pa.list_(pa.struct([("kind", pa.string()), ("mode", pa.string()), ("weight", pa.float64()), ("clause", pa.string())]))


def score(docs: DataFrame, model: Model, with_clauses: bool = False) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 from 0.5), and with_clauses the matched clauses with their patterns and weights."""
    spark = tune(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]):
        m = shared.value
        for batch in batches:
            texts = [x.as_py() for x in batch.column(2)]
            got = [m.score(t) for t in texts]
            columns = [batch.column(0), batch.column(1), pa.array(got, pa.float64()), pa.array([int(s >= 0.5) for s in got], pa.int32())]
            names = ["doc_id", "held_out", "score", "predicted"]
            if with_clauses:
                columns.append(pa.array([[{"kind": PATTERNS[p][0], "mode": PATTERNS[p][1], "weight": w, "clause": c} for p, w, c in m.clauses(t or "")] for t in texts], _CLAUSES))
                names.append("clauses")
            yield pa.RecordBatch.from_arrays(columns, names)

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id").cast("long")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return base.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int" + ", clauses array<struct<kind:string,mode:string,weight:double,clause:string>>" * with_clauses)


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that the model does not predict as toxic, whatever their columns are named."""
    spark = tune(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]):
        m = shared.value
        for batch in batches:
            yield batch.filter(pa.array([m.score(x.as_py()) < 0.5 for x in pc.cast(batch.column(at), pa.string())], pa.bool_()))

    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # Python functions take no odd names
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
