"""License scan by template matching.

A template is the whole published wording of a license, or a short notice that names one, with markup: [[...]] may be left
out, {{a|b}} is one of the given wordings, {{n}} with a number n is any text of up to n words (names, addresses). Templates
are compiled into automata over words (nondeterministic, with skips for optional parts), which accept a stretch of text
only if all mandatory wording stands there exactly. Automata start at the places of their first words only, and texts
without any of the words that every template needs are not tokenised at all.

Besides, three phrases are searched everywhere, for the base labels. The score is 1.0 where a license's text is accepted,
else 0.8 where a notice is, else 0.5 where a phrase stands, else 0.0. A
header that refers to a license's text elsewhere is a notice: it says nothing about the wording of the text.

Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased; everything else separates.

Defined cases: a null text has no words; n_words counts the whole text; repeated rows are judged alike; first_word and
last_word are null without a place; labels without any license are empty strings; a text that holds another license's whole
wording has both labels; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.llm.license_texts import TEMPLATES

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_IN_WORD = np.zeros(256, dtype=bool)
_IN_WORD[48:58] = _IN_WORD[65:91] = _IN_WORD[97:123] = _IN_WORD[128:] = True

# Phrases and labels of the base.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: What a match is worth.
SCORES = {"text": 1.0, "notice": 0.8, "phrase": 0.5}


def words_of(text: bytes) -> list[bytes]:
    return _WORD.findall(text.lower())


class Automaton:
    """States are places in the wording; arcs are (word or None for any word, next state), skips are free moves."""

    def __init__(self, label: str, markup: str, kind: str = "text") -> None:
        self.label, self.kind, self.arcs, self.skips = label, kind, [[]], [[]]
        self.mandatory = 0
        self.end = self._sequence(0, re.findall(r"\[\[|\]\]|\{\{[^}]*\}\}|(?:(?!\[\[|\]\]|\{\{).)+", markup, re.S))
        self.first = frozenset(w for s in self.closed({0}) for w, _ in self.arcs[s])
        if None in self.first:
            raise ValueError(f"a template begins with a word: {markup}")
        plain = re.sub(r"\[\[.*?\]\]|\{\{.*?\}\}", " ", markup, flags=re.S)
        self.needs = max(words_of(plain.encode()), key=len)  # a mandatory word; the longest is the rarest as a rule

    def _state(self) -> int:
        self.arcs.append([])
        self.skips.append([])
        return len(self.arcs) - 1

    def _word(self, at: int, word: bytes | None) -> int:
        to = self._state()
        self.arcs[at].append((word, to))
        return to

    def _sequence(self, at: int, parts: list[str]) -> int:
        opened: list[int] = []
        for part in parts:
            if part == "[[":
                opened.append(at)
            elif part == "]]":
                self.skips[opened.pop()].append(at)
            elif part.startswith("{{") and part[2:-2].strip().isdigit():
                ends = [at]
                for _ in range(int(part[2:-2])):
                    ends.append(self._word(ends[-1], None))
                to = self._state()
                for e in ends:
                    self.skips[e].append(to)
                at = to
            elif part.startswith("{{"):
                to = self._state()
                for choice in part[2:-2].split("|"):
                    end = at
                    for word in words_of(choice.encode()):
                        end = self._word(end, word)
                    self.skips[end].append(to)
                at = to
            else:
                for word in words_of(part.encode()):
                    at = self._word(at, word)
                    self.mandatory += not opened
        if opened:
            raise ValueError("an optional part isn't closed")
        return at

    def closed(self, states: set[int]) -> set[int]:
        out, stack = set(states), list(states)
        while stack:
            for to in self.skips[stack.pop()]:
                if to not in out:
                    out.add(to)
                    stack.append(to)
        return out

    def accepts(self, words: list[bytes], start: int) -> bool:
        """Whether some stretch that begins at `start` is a reading of the template."""
        states = self.closed({0})
        for at in range(start, len(words)):
            states = self.closed({to for s in states for w, to in self.arcs[s] if w is None or w == words[at]})
            if self.end in states:
                return True
            if not states:
                return False
        return False


class Scanner:
    def __init__(self, templates=TEMPLATES, phrases=PHRASES) -> None:
        self.automata = [Automaton(label, markup, kind) for label, kind, markup in templates]
        self.phrases = [(tuple(p.encode().split()), label) for p, label in phrases]
        self.phrase_ends = [words[-1] for words, _ in self.phrases]
        self.starts: dict[bytes, list[Automaton]] = {}
        for a in self.automata:
            for word in a.first:
                self.starts.setdefault(word, []).append(a)
        self.anchors = re.compile(b"|".join(sorted({re.escape(a.needs) for a in self.automata} | {re.escape(w) for w in self.phrase_ends}, key=len)))

    def scan(self, text: bytes | None) -> tuple[int, int, int | None, int | None, str, str, float]:
        text = (text or b"").lower()
        inside = _IN_WORD[np.frombuffer(text, dtype=np.uint8)]
        n = int(inside[:1].sum() + (inside[1:] & ~inside[:-1]).sum())
        if not n or not self.anchors.search(text):
            return n, 0, None, None, "", "", 0.0
        words = words_of(text)
        places, labels = [], set()
        at: dict[bytes, list[int]] = {}
        for i, w in enumerate(words):
            if w in self.starts or w in _PHRASE_STARTS:
                at.setdefault(w, []).append(i)
        for phrase, label in self.phrases:
            for i in at.get(phrase[0], ()):
                if tuple(words[i : i + len(phrase)]) == phrase:
                    places.append(i)
                    labels.add(label)
        base = ",".join(sorted(labels))
        score = SCORES["phrase"] if labels else 0.0
        present = set(words)
        for word, automata in self.starts.items():
            for automaton in automata:
                if automaton.needs in present and any(automaton.accepts(words, i) for i in at.get(word, ())):
                    labels.add(automaton.label)
                    score = max(score, SCORES[automaton.kind])
        return n, len(places), min(places, default=None), max(places, default=None), base, ",".join(sorted(labels)), score


_PHRASE_STARTS = frozenset(p.split()[0].encode() for p, _ in PHRASES)
_NAMES = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """documents -> (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score)."""
    scanner = Scanner(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        for batch in batches:
            found = [scanner.scan(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array([f[i] for f in found], k) for i, k in enumerate(kinds)]], ["doc_id", *_NAMES])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
