"""Text intents as Columns: pattern counts by class, the winning class, the confidence."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.functions.rules import CURRENT, UNSPECIFIED, RuleSet, literal_of

#: Case-insensitive, only \n ends a line, Unicode classes: the dialect of the patterns.
_FLAGS = "(?idU)"
AXES = ("longitudinal", "lateral")
_HITS = "_hits"


def _count(t: Column, pattern: str) -> Column:
    """Matches of a pattern in t (text, folded, odd); its literal is looked for first, which spares most texts the regex.

    Texts beyond ASCII always go to the regex: their case folding is the regex engine's business.
    """
    found = F.regexp_count(t["text"], F.lit(_FLAGS + pattern))
    literal = literal_of(pattern)
    return F.when(t["odd"] | F.contains(t["folded"], F.lit(literal)), found).otherwise(0) if literal else found


def pattern_counts(text: Column, patterns: Sequence[str]) -> Column:
    """Non-overlapping matches of each pattern, as one array; null for a null text.

    The counts stand in a function over the text, so that they are evaluated one by one: unrolled into a stage's generated
    code, some ninety of them are more than a method can hold.
    """
    once = F.array(F.struct(text.alias("text"), F.lower(text).alias("folded"), text.rlike(r"[^\x00-\x7F]").alias("odd")))
    counts = F.get(F.transform(once, lambda t: F.array(*[_count(t, p) for p in patterns])), F.lit(0))
    return F.when(text.isNotNull(), counts)


def _members(sets: Iterable[RuleSet], axes: tuple[str, ...] = AXES) -> tuple[list[str], dict[tuple[str, ...], Column]]:
    """The patterns of all rule sets, each once, and for the patterns of each class the sum of their counts in _hits."""
    classes = list(dict.fromkeys(ps for rules in sets for axis in axes for ps in getattr(rules, axis).values()))
    union = list(dict.fromkeys(p for ps in classes for p in ps))
    place = {p: i for i, p in enumerate(union)}
    total = lambda ps: F.coalesce(reduce(lambda a, b: a + b, [F.get(_HITS, F.lit(place[p])) for p in ps]), F.lit(0)).cast("long")
    return union, {ps: total(ps) for ps in classes}


def class_counts(df: DataFrame, text: str = "cot_text", rules: RuleSet = CURRENT, axes: tuple[str, ...] = AXES) -> DataFrame:
    """df with a column n_<class> for each class of the axes: the sum over its patterns of non-overlapping matches."""
    union, total = _members([rules], axes)
    counts = {f"n_{name}": total[patterns] for axis in axes for name, patterns in getattr(rules, axis).items()}
    return df.withColumn(_HITS, pattern_counts(F.col(text), union)).withColumns(counts).drop(_HITS)


def classify_by_sets(df: DataFrame, sets: dict[str, RuleSet], text: str = "cot_text") -> DataFrame:
    """df with <set>_long_intent, <set>_lat_intent and <set>_confidence for each of several rule sets.

    Every pattern of their union is counted once; a rule set is only which counts its classes add up.
    """
    union, total = _members(sets.values())
    name = {ps: f"_n{k}" for k, ps in enumerate(total)}
    out = df.withColumn(_HITS, pattern_counts(F.col(text), union)).withColumns({name[ps]: c for ps, c in total.items()}).drop(_HITS)
    made = {}
    for key, rules in sets.items():
        columns = [{c: F.col(name[ps]) for c, ps in getattr(rules, axis).items()} for axis in AXES]
        made |= {f"{key}_long_intent": winner(columns[0]), f"{key}_lat_intent": winner(columns[1]), f"{key}_confidence": confidence([c for axis in columns for c in axis.values()])}
    return out.withColumns(made).drop(*name.values())


def winner(counts: dict[str, Column]) -> Column:
    """The class with most matches, the first declared among equals; unspecified without any."""
    *others, last = counts
    best = F.greatest(*counts.values()) if others else counts[last]
    out = F.when(best == 0, UNSPECIFIED)
    for n in others:
        out = out.when(counts[n] == best, n)
    return out.otherwise(last)


def confidence(counts: list[Column]) -> Column:
    """The largest count of any class over all counts; 0 without any."""
    return F.coalesce(F.greatest(*counts) / F.nullif(reduce(lambda a, b: a + b, counts), F.lit(0)), F.lit(0.0))


def classify_text(df: DataFrame, text: str = "cot_text", rules: RuleSet = CURRENT, num_partitions: int | None = None, keep_counts: bool = False) -> DataFrame:
    """df with long_intent, lat_intent and confidence.

    num_partitions spreads a table of few files first, as the regex work is narrow. Materialise the result before
    filtering on it: a filter on an intent would be pushed below and evaluate the patterns twice.
    """
    if num_partitions:
        df = df.repartition(num_partitions)
    long, lat = ({n: F.col(f"n_{n}") for n in axis} for axis in (rules.longitudinal, rules.lateral))
    every = long | lat
    out = class_counts(df, text, rules).withColumns({"long_intent": winner(long), "lat_intent": winner(lat), "confidence": confidence(list(every.values()))})
    return out if keep_counts else out.drop(*[f"n_{n}" for n in every])
