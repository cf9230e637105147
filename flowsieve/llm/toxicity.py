"""Toxicity by a weighted finite-state grammar over clauses (operator 5).

Lexicon: an acceptor over characters. Its entries are whole words and word beginnings (``stem*``) with the log-odds of a toxic label as weight. It holds those
that are significant for the toxic ones among labelled rows (likelihood ratio, against the number of entries tested). Aho-Corasick runs it over whole texts.

Grammar: every clause with a match is read word by word through the composition of five transducers: insult (a lexicon match emits its weight), target (an
address nearby), negation (in force for some words), reported speech (in force up to the end of the clause) and threat (a violent verb near a target). The
composed transducer emits a weight under one tag per match, so the same word counts differently in "you are a ..." and "never called anyone a ...". How
much each tag counts is not assumed: a logistic model over the weights per tag is fitted to the labels, and gives the score.

Labels are learnt from at most ``MAX_PER_CLASS`` rows of each class (smallest hash of doc_id; different texts only). Null and empty texts have no match and get
the score of a text without match. Without labelled rows of both classes the score is the share of toxic labels (0 without labels).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsieve.llm.near_dedup import near_duplicates
from flowsieve.llm.text import give_back, stash

MAX_PER_CLASS = 5000
STEMS = (4, 5, 6, 7, 8)
MIN_TEXTS = 3
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80
MARGIN = 0.0
MIN_WEIGHT = 2.0
ENOUGH = 20.0
THRESHOLD = 0.7
TAGS = ("plain", "targeted", "negated", "reported", "threat")

#: Closed word classes of the grammar, in the four languages of the tables.
TARGET = frozenset("you your yours yourself u du dich dir dein deine deiner ihr euch euer tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros os".split())
NEGATION = frozenset("not no never none neither nor n't nicht kein keine keinen nie niemals ne pas jamais aucun aucune nunca jamás ningún ninguna tampoco".split())
REPORT = frozenset("said says say called calls wrote writes quoted claimed told sagte sagt nannte schrieb dit disait appelé écrit dijo dice llamó escribió".split())
THREAT = frozenset("kill hurt destroy attack beat punch shoot stab murder töten umbringen schlagen tuer frapper matar golpear".split())
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[\"“”„«»]")
_END = re.compile(r"[.!?;:\n]")
_LETTERS = re.compile(r"[^\W\d_]+")


class Transducer:
    """A deterministic transducer over word classes. ``step[state, class]`` is the next state; ``flag(state)`` says whether it marks a match read now."""

    def __init__(self, start: int, step, marks):
        self.start, self.step, self.marks = start, step, marks


def _window(opens: str, reach: int) -> Transducer:
    """After a word of class ``opens``, in force for ``reach`` words."""
    return Transducer(0, lambda s, c: reach if c == opens else max(0, s - 1), lambda s: s > 0)


def _latch(opens: str) -> Transducer:
    """After a word of class ``opens``, in force up to the end of the clause."""
    return Transducer(0, lambda s, c: 1 if c == opens else s, lambda s: s > 0)


class Composition:
    """The product of transducers, built as far as it is visited."""

    def __init__(self, *parts: Transducer):
        self.parts = parts
        self.start = tuple(p.start for p in parts)
        self._next: dict[tuple, tuple] = {}

    def step(self, state: tuple, word_class: str) -> tuple[tuple, tuple]:
        key = (state, word_class)
        found = self._next.get(key)
        if found is None:
            after = tuple(p.step(s, word_class) for p, s in zip(self.parts, state))
            found = self._next[key] = (after, tuple(p.marks(s) for p, s in zip(self.parts, after)))
        return found


def grammar() -> Composition:
    return Composition(_window("y", 6), _window("n", 4), _latch("r"), _window("t", 5))


@dataclass
class Model:
    lexicon: dict[str, float] = field(default_factory=dict)
    coefficients: tuple[float, ...] = (0.0,) * (2 * len(TAGS))
    intercept: float = -30.0


def word_class(word: str) -> str:
    return "y" if word in TARGET else "n" if word in NEGATION else "r" if word in REPORT or len(word) == 1 and not word.isalpha() else "t" if word in THREAT else "o"


def terms(text: str | None) -> set[str]:
    """The lexicon entries a text could support, its words and beginnings of longer words."""
    words = set(_LETTERS.findall((text or "").lower()))
    return words | {word[:n] + "*" for word in words for n in STEMS if len(word) > n}


def copy_classes(texts: DataFrame) -> DataFrame:
    """``texts`` (text, toxic) with ``copies``: a number that near copies share, by the links of operator 7. A text without words has its own."""
    known = stash(texts.select(F.shiftrightunsigned(F.xxhash64("text"), 2).alias("doc_id"), "text", "toxic"), "sample")
    linked = near_duplicates(known, SHINGLE_WORDS, SIMILAR_PERCENT).select("doc_id", F.col("component_id").alias("copies")).distinct()
    return known.join(linked, "doc_id").select("text", "toxic", F.coalesce("copies", "doc_id").alias("copies"))


class Scanner:
    """The lexicon as an Aho-Corasick automaton, and the grammar over the clauses it finds."""

    def __init__(self, lexicon: dict[str, float]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        self.lexicon = lexicon
        for entry, weight in lexicon.items():
            bare = entry.rstrip("*")
            stem, whole = self.automaton.get(bare, (0, 0.0, 0.0))[1:] if bare in self.automaton else (0.0, 0.0)
            self.automaton.add_word(bare, (len(bare), weight, whole) if entry.endswith("*") else (len(bare), stem, weight))
        if lexicon:
            self.automaton.make_automaton()
        self.grammar = grammar()

    def weight_at(self, text: str) -> dict[int, float]:
        """Start of each matched word → weight of its best entry."""
        found: dict[int, float] = {}
        if not self.lexicon or not text:
            return found
        for end, (size, stem, whole) in self.automaton.iter(text):
            start = end + 1 - size
            if start and text[start - 1].isalpha():
                continue
            weight = max(stem, whole) if end + 1 == len(text) or not text[end + 1].isalpha() else stem
            if weight:
                found[start] = max(weight, found.get(start, 0.0))
        return found

    def features(self, text: str | None) -> list[float] | None:
        """Per tag: the sum of the weights, up to ``ENOUGH``, and the square of the largest. None without a match."""
        text = (text or "").lower()
        hits = self.weight_at(text)
        if not hits:
            return None
        sums, most = dict.fromkeys(TAGS, 0.0), dict.fromkeys(TAGS, 0.0)
        done = -1
        for at in sorted(hits):
            if at < done:
                continue
            before = max(text.rfind(mark, 0, at) for mark in ".!?;:\n")
            after = _END.search(text, at)
            done = after.start() if after else len(text)
            state = self.grammar.start
            for word in _WORD.finditer(text, before + 1, done):
                weight = hits.get(word.start())
                kind = "i" if weight else word_class(word[0])
                state, (targeted, negated, reported, threat) = self.grammar.step(state, kind)
                if weight:
                    for tag in ["negated" if negated else "reported" if reported else "targeted" if targeted else "plain"] + ["threat"] * (threat and targeted):
                        sums[tag] += weight
                        most[tag] = max(most[tag], weight)
        return [x for tag in TAGS for x in (min(sums[tag], ENOUGH), most[tag] ** 2)]


def _odds(total1: int, total0: int) -> Column:
    return F.log((F.col("n1") + 0.5) / (total1 + 1)) - F.log((F.col("n0") + 0.5) / (total0 + 1))


def _surprise(total1: int, total0: int) -> Column:
    """Likelihood-ratio statistic of an entry that is in ``n1`` of ``total1`` toxic and ``n0`` of ``total0`` other texts."""
    share = (F.col("n1") + F.col("n0")) / (total1 + total0)
    cells = ((F.col("n1"), total1 * share), (total1 - F.col("n1"), total1 * (1 - share)), (F.col("n0"), total0 * share), (total0 - F.col("n0"), total0 * (1 - share)))
    return sum((F.when(seen > 0, 2 * seen * F.log(seen / expected)).otherwise(0.0) for seen, expected in cells), F.lit(0.0))


def choose(counted: DataFrame, total1: int, total0: int) -> dict[str, float]:
    """The lexicon: entries (entry, n1, n0: toxic and other texts) more significant for toxic texts than the best of all tested ones is likely to be by chance, with their log-odds.

    Only significant entries come to the driver; there are never more than the labelled texts, which are bounded, have terms.
    """
    usable = stash(counted.where(F.col("n1") + F.col("n0") >= MIN_TEXTS), "entries")
    odds = _odds(total1, total0)
    least = 2 * math.log(max(usable.count(), 1)) + MARGIN
    good = usable.where((F.col("n1") >= MIN_TEXTS) & (odds >= MIN_WEIGHT) & (_surprise(total1, total0) >= least))
    return {r["entry"]: r["odds"] for r in good.select("entry", odds.alias("odds")).orderBy("entry").collect()}


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.05, rounds: int = 50) -> np.ndarray:
    """Coefficients (intercept first) by Newton's method; the intercept is hardly penalised, the others are at least 0."""
    x = np.hstack([np.ones((len(x), 1)), x])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-3
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weight * (y - p)) - penalty * beta
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty), slope)
        beta += np.clip(step, -4, 4)
        beta[1:] = np.maximum(beta[1:], 0)  # a match never speaks for a clean text
        if np.abs(step).max() < 1e-8:
            break
    return beta


def learn(docs: DataFrame, labels: DataFrame, max_per_class: int = MAX_PER_CLASS) -> Model:
    """``docs``: doc_id, text; ``labels``: doc_id, toxic, already without the rows that are held out. Several labels of one document: toxic if any is."""
    per = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    totals = {r["toxic"]: r["count"] for r in per.groupBy("toxic").count().collect()}
    if not totals.get(1) or not totals.get(0):
        share = 1.0 if totals.get(1) else 0.0
        return Model(intercept=30.0 if share else -30.0)
    some = [per.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_per_class) for y in (1, 0)]
    sample = F.broadcast(some[0].unionAll(some[1]))  # at most 2 * max_per_class rows of two numbers
    texts = docs.select("doc_id", "text").join(sample, "doc_id").select("text", "toxic").groupBy("text").agg(F.max("toxic").alias("toxic"))

    # near copies of one text are one piece of evidence, for both classes alike
    texts = stash(copy_classes(texts), "evidence")

    def support(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, toxic, copies in zip(*(batch.column(k).to_pylist() for k in range(3))):
                found = list(terms(text))
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.repeat(toxic, len(found)).cast(pa.int32()), pa.repeat(copies, len(found)).cast(pa.int64())], names=["entry", "toxic", "copies"])

    size = {r["toxic"]: r for r in texts.groupBy("toxic").agg(F.count("*").alias("texts"), F.countDistinct("copies").alias("classes")).collect()}
    if len(size) < 2:
        return Model(intercept=30.0 if 1 in size else -30.0)
    total1, total0 = size[1]["classes"], size[0]["classes"]
    by_class = texts.mapInArrow(support, "entry string, toxic int, copies long").distinct()
    counted = by_class.groupBy("entry").agg(F.count(F.when(F.col("toxic") == 1, 1)).alias("n1"), F.count(F.when(F.col("toxic") == 0, 1)).alias("n0"))
    lexicon = choose(counted, total1, total0)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scanner(lexicon)
        for batch in batches:
            found = [scan.features(t) or [0.0] * (2 * len(TAGS)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.list_(pa.float64()))], names=["toxic", "features"])

    rows = texts.select("text", "toxic").mapInArrow(describe, "toxic int, features array<double>").collect()
    rows.sort(key=lambda r: (r["toxic"], r["features"]))
    y = np.array([r["toxic"] for r in rows], float)
    scale = np.where(y == 1, totals[1] / size[1]["texts"], totals[0] / size[0]["texts"])  # the classes' shares among all labels
    beta = fit_logistic(np.array([r["features"] for r in rows]), y, scale)
    return Model(lexicon, tuple(beta[1:].tolist()), float(beta[0]))


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a score between 0 and 1. A column of that name is replaced."""
    docs = docs.drop(out)
    keep = docs.columns
    blank = 1 / (1 + math.exp(-max(-30.0, min(30.0, model.intercept))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scanner(model.lexicon)
        weights = np.array(model.coefficients)
        for batch in batches:
            scores = []
            for value in batch.column(text):
                x = scan.features(value.as_py())
                scores.append(blank if x is None else float(1 / (1 + np.exp(-np.clip(model.intercept + weights @ np.array(x), -30, 30)))))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(scores, pa.float64())], names=[*keep, out])
            give_back()

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))


def held_out(modulus: int = 3, remainder: int = 1):
    """Whether a document is held out: crc32 of doc_id as text, modulo."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))
