"""Toxicity by a weighted finite-state pattern grammar.

Text is read as tokens of a few kinds: insults, threat verbs and their auxiliaries, targets (second and third person),
negations, words of reported speech, quotation marks, ends of clauses and of lines. Five transducers are composed:

* threat: a threat verb counts if an auxiliary of intent stands at most four tokens before it and a target at most three
  behind, in the same clause; what it doesn't count is an insult if it is one, or nothing;
* negation: an insult or threat at most three tokens behind a negation, in the same clause, is `negated`;
* reported speech: an insult or threat behind a verb of speech in the same clause, or between quotation marks in the same
  line (over any number of clauses), is `reported`, negated or not; what stands before the verb isn't;
* target: any other insult is `targeted` if the same clause has a target, before or behind it, and `plain` if not;
* insult: the marks are paid: an insult its learned weight, a threat a fixed one more, times the weight of the mark.

The best path through the composed machine gives each clause its reading. A document is scored on the sums over its
matched clauses by reading, never on isolated words: a logistic regression on these sums, fitted on the same bounded
sample as the insult stems and their weights.

Defined cases: a null text counts as empty; a text without a matched clause has zero sums and so the lowest score;
very long texts are read whole; labels other than 0 and 1 and null doc_ids are not learned from; without labels of
both classes the score is 0.0 for all; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.llm.common import held_out, thinned
from concord.llm.quality import labelled_sample
from concord.llm.transducers import Transducer

#: At most about so many labelled rows of each class are learned from, chosen by a hash of doc_id.
MAX_FIT = 4_000
#: Toxic rows of the sample that hold a stem, at least, for it to be learned.
LEAST = 4
PREFIXES = (4, 5, 6, 7, 8)

# Closed-class words of the four languages of the corpus.
TARGETS = frozenset("you your yours he she they them him his her their u du dich dir ihr euch sie er tu te toi vous ton votre il elle ils tú te usted ustedes vosotros él ella ellos".split())
NEGATIONS = frozenset("not no never nor neither isn aren wasn don doesn nicht kein keine keinen nie niemals ne pas jamais aucun non nunca jamás ningún ni".split())
REPORTS = frozenset("said says say wrote writes quoted quote quotes reported claimed called sagte sagt schrieb zitierte dit écrit disait dijo dice escribió citó".split())
INTENT = frozenset("will shall gonna going ll werde wird werden vais va vas voy vamos".split())
THREATS = frozenset("kill hurt destroy beat shoot stab burn strangle smash töten umbringen verletzen schlagen tuer frapper détruire brûler matar golpear destruir quemar".split())

_TOKEN = re.compile(r"[^\W\d_]+|[.!?;\n\"“”«»]")
_END = frozenset(".!?;")
_QUOTE = frozenset('"“”«»')
OTHER, TARGET, NEGATION, REPORT, INTENDS, THREAT, END, QUOTE, LINE, INSULT, WILD = range(11)  # WILD: a threat verb that is an insult too
KINDS = range(11)
PLAIN, TARGETED, NEGATED, REPORTED, THREATENED, SAID_THREAT, NEGATED_THREAT = (f"mark {n}" for n in range(7))
#: What the last transducer pays for a mark, as a multiple of the token's value; a threat's value is this much more than its stem's.
PAYS = {PLAIN: 1.0, TARGETED: 1.5, NEGATED: 0.25, REPORTED: 0.25, THREATENED: 1.0, SAID_THREAT: 0.25, NEGATED_THREAT: 0.25}
THREAT_VALUE = 4.0
#: Tokens to which the windows of the grammar reach at most: of a longer gap between tokens that count, the rest is of no account.
REACH = 5
FEATURES = ("plain", "targeted", "negated", "reported", "threats", "clauses", "distinct", "strongest", "tokens", "paid")


def kind_of(token: str) -> int:
    for words, kind in ((_END, END), (_QUOTE, QUOTE), (TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTS, REPORT), (INTENT, INTENDS), (THREATS, THREAT)):
        if token in words:
            return kind
    return LINE if token == "\n" else OTHER


_STOPS = (END, LINE)


def threat_machine() -> Transducer:
    """State: how far the last auxiliary is (5: too far), and within how many tokens a target has to come (0: needn't)."""

    def step(state, x):
        since, due = state
        if x in _STOPS:
            if not due:
                yield x, 1.0, (5, 0)
            return
        later = 1 if x == INTENDS else min(since + 1, 5)
        left = 0 if not due or x == TARGET else due - 1
        if due and not left and x != TARGET:
            return  # no target came
        if x in (THREAT, WILD):
            if since <= 4:
                yield THREATENED, 1.0, (later, left or 3)
            yield (INSULT if x == WILD else OTHER), 1.0, (later, left)
        else:
            yield x, 1.0, (later, left)

    return Transducer.grown((5, 0), KINDS, step, lambda s: not s[1])


def negation_machine() -> Transducer:
    """State: how far the last negation is (4: too far)."""

    def step(since, x):
        to = 1 if x == NEGATION else 4 if x in _STOPS else min(since + 1, 4)
        yield ({INSULT: NEGATED, THREATENED: NEGATED_THREAT}.get(x, x) if since <= 3 else x), 1.0, to

    return Transducer.grown(4, [*KINDS, THREATENED], step)


def report_machine() -> Transducer:
    """State: whether a verb of speech stands before in the clause, and whether quotation marks are open."""

    def step(state, x):
        said, quoted = state
        to = (False, False) if x == LINE else (False, quoted) if x == END else (said or x == REPORT, quoted != (x == QUOTE))
        told = {INSULT: REPORTED, NEGATED: REPORTED, THREATENED: SAID_THREAT, NEGATED_THREAT: SAID_THREAT}
        yield (told.get(x, x) if said or quoted else x), 1.0, to

    return Transducer.grown((False, False), [*KINDS, THREATENED, NEGATED, NEGATED_THREAT], step)


def target_machine() -> Transducer:
    """State: nothing guessed; guessed that the clause has no target; that one is to come; or one has come."""
    marks = (NEGATED, REPORTED, THREATENED, SAID_THREAT, NEGATED_THREAT)

    def step(state, x):
        if x in _STOPS:
            if state != "due":
                yield x, 1.0, "open"
        elif x == INSULT:
            if state in ("open", "none"):
                yield PLAIN, 1.0, "none"
            if state != "none":
                yield TARGETED, 1.0, "come" if state == "come" else "due"
        elif x == TARGET:
            if state != "none":
                yield x, 1.0, "come"
        else:
            yield x, 1.0, state

    return Transducer.grown("open", [*KINDS, *marks], step, lambda s: s != "due")


def insult_machine() -> Transducer:
    return Transducer.grown(0, [*KINDS, *PAYS], lambda s, x: [(x, PAYS.get(x, 0.0), 0)])


def machines() -> list[Transducer]:
    return [threat_machine(), negation_machine(), report_machine(), target_machine(), insult_machine()]


def grammar() -> Transducer:
    first, *rest = machines()
    for other in rest:
        first = first.then(other)
    return first


_grammar: list[Transducer] = []  # composed once a process


class Lexicon(dict):
    """token -> (kind, insult weight); unseen tokens are looked up by their stems once."""

    def __init__(self, stems: dict[str, float]) -> None:
        super().__init__()
        self.stems = stems

    def __reduce__(self):
        return Lexicon, (self.stems,)

    def __missing__(self, token: str) -> tuple[int, float]:
        stems = self.stems
        weight = max([stems.get(f"{token}$", 0.0), *[stems.get(token[:n], 0.0) for n in PREFIXES if n <= len(token)]])
        if len(self) > 500_000:  # a cache only: every token can be looked up again
            self.clear()
        kind = kind_of(token)
        if weight:
            kind = WILD if kind == THREAT else INSULT
        self[token] = found = (kind, weight + THREAT_VALUE * (kind in (THREAT, WILD)))
        return found


def clause_sums(text: str | None, lexicon: Lexicon) -> list[float]:
    """The grammar's output for a document: FEATURES."""
    tokens = _TOKEN.findall((text or "").lower())
    read = [lexicon[t] for t in tokens]
    out = [0.0] * len(FEATURES)
    out[8] = float(len(tokens))
    if not any(value for _, value in read):
        return out
    if not _grammar:
        _grammar.append(grammar())
    events, places, gap = [], [], 0
    for at, (kind, value) in enumerate(read):
        if kind == OTHER:
            gap += 1
            if gap > REACH:
                continue
        else:
            gap = 0
        events.append((kind, value))
        places.append(at)
    out[9], marks = _grammar[0].best(events, PAYS.__contains__)
    clause, clauses, seen, last = 0, set(), {}, 0
    for at, mark in marks:
        place = places[at]
        clause += sum(kind in _STOPS for kind, _ in read[last:place])
        last = place
        value, weight = read[place][1], read[place][1] - THREAT_VALUE * (read[place][0] in (THREAT, WILD))
        if mark == THREATENED:
            out[4] += 1.0
        if weight > 0:
            seen[tokens[place]] = weight
        out[0 if mark == PLAIN else 1 if mark in (TARGETED, THREATENED) else 2 if mark in (NEGATED, NEGATED_THREAT) else 3] += weight if mark in (PLAIN, TARGETED, THREATENED) else value
        clauses.add(clause)
    out[5], out[6], out[7] = float(len(clauses)), float(len(seen)), max(seen.values(), default=0.0)
    return out


def design(sums: np.ndarray) -> np.ndarray:
    """FEATURES as the regression takes them: how much, how strong, how dense, and in which readings."""
    plain, targeted, negated, reported, threats, clauses, distinct, strongest, tokens, paid = sums.reshape(-1, len(FEATURES)).T
    total = plain + targeted + negated + reported
    some = np.maximum(total, 1e-9)
    grown = [np.log1p(total), total / (total + 10), strongest / 5, np.log1p(clauses), np.log1p(distinct), np.log1p(1000 * total / np.maximum(tokens, 1)), np.log1p(threats), np.log1p(total / np.maximum(clauses, 1)), np.log1p(paid)]
    return np.stack([*grown, targeted / some, negated / some, reported / some], axis=1)


class Grammar:
    def __init__(self, stems: dict[str, float], weights: np.ndarray | None) -> None:
        self.lexicon, self.weights = Lexicon(stems), weights

    def score(self, texts: list) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(texts))
        x = design(np.array([clause_sums(t, self.lexicon) for t in texts]))
        z = x @ self.weights[1:] + self.weights[0]
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _stem_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each class that hold a stem, summed over the task."""
    counts = (Counter(), Counter())
    for batch in batches:
        for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()):
            words = {t for t in _TOKEN.findall((text or "").lower()) if len(t) > 2}
            stems = {w[:n] for w in words for n in PREFIXES if n <= len(w)}
            counts[y].update(stems)
            counts[y].update(f"{w}$" for w in words)
    for y in (0, 1):
        items = list(counts[y].items())
        for at in range(0, len(items), 20_000):
            part = items[at : at + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in part], pa.string()), pa.array([c * (y == 0) for _, c in part], pa.int64()), pa.array([c * (y == 1) for _, c in part], pa.int64())], ["stem", "clean", "toxic"])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.2) -> np.ndarray:
    """Newton's method on the ridge-penalised likelihood."""
    a = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(a.shape[1])
    penalty = np.diag([1e-6] + [ridge] * x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty, a.T @ (y - p) - penalty @ w)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, bound: int = MAX_FIT) -> Grammar:
    found = labelled_sample(labels, "toxic", 5, 0, 1 << 62)
    size = {r["y"]: r["n"] for r in found.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(size) < 2:
        return Grammar({}, None)
    share = {y: min(1.0, bound / n) for y, n in size.items()}
    sample = F.broadcast(found.where(F.when(F.col("y") == 1, thinned(share[1], "doc_id")).otherwise(thinned(share[0], "doc_id"))))  # 2 * bound rows
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(sample, "doc_id").select("text", "y").persist()
    try:
        n = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
        if len(n) < 2:
            return Grammar({}, None)
        counts = rows.mapInArrow(_stem_counts, "stem string, clean long, toxic long").groupBy("stem").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        # Evidence that survives chance: a low estimate of the share of toxic documents over that of clean ones.
        weight = F.log((F.col("toxic") - F.sqrt("toxic") + 0.1) / n[1]) - F.log((F.col("clean") + 0.5) / n[0])
        strong = counts.where(F.col("toxic") >= LEAST).withColumn("w", weight).where("w > 2")
        stems = {r["stem"]: float(r["w"]) for r in strong.collect()}  # stems of at most `bound` toxic rows
        lexicon = Lexicon(stems)

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = [clause_sums(t, lexicon) for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column("y")], ["x", "y"])

        got = rows.mapInArrow(sums, "x array<double>, y int").collect()  # 2 * bound rows of 10 numbers
    finally:
        rows.unpersist()
    x, y = design(np.array([r["x"] for r in got])), np.array([r["y"] for r in got], dtype=float)
    weights = _logistic(x, y)
    weights[0] += np.log(share[0] / share[1])  # classes were thinned unequally
    return Grammar(stems, weights)


def score(model: Grammar, text: Column) -> Column:
    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(list(texts)), dtype=float)

    return of(text)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """documents -> (doc_id, held_out, score, predicted)."""
    model = fit(docs, labels)
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), 5, 0).alias("held_out"), score(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that are not rejected, with their own columns."""
    return docs.where(score(fit(docs, labels), F.col("text")) < threshold)
