"""The rules as SQL: temporary functions over the same patterns, matrices and thresholds, without a line of Python at run time.

    register(spark)
    spark.sql("select clip_id, long_intent(cot_text), mismatch_score(long_intent(cot_text), 'stopped', lat_intent(cot_text), 'straight') from t")
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from concord.functions.rules import CURRENT, LAT_COMPAT, LAT_EXECUTIONS, LONG_COMPAT, LONG_EXECUTIONS, UNSPECIFIED, RuleSet, Thresholds, literal_of

_POINTS = "array<struct<x: double, y: double, z: double>>"


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _counts(patterns: tuple[str, ...]) -> str:
    """Matches of all patterns of a class in s.text; a pattern's literal is looked for first, except beyond ASCII."""
    one = "if(s.odd or contains(s.folded, {0}), regexp_count(s.text, {1}), 0)"
    return " + ".join(one.format(_quoted(literal_of(p)), _quoted(f"(?idU){p}")) if literal_of(p) else f"regexp_count(s.text, {_quoted(f'(?idU){p}')})" for p in patterns)


def _winner(names: list[str], first: int) -> str:
    at = [f"n[{first + k}]" for k in range(len(names))]
    best = f"greatest({', '.join(at)})"
    return f"case when {best} = 0 then '{UNSPECIFIED}' " + " ".join(f"when {a} = {best} then '{c}'" for a, c in zip(at, names)) + " end"


def _matrix(cells: dict[str, tuple[float, ...]], executions: tuple[str, ...]) -> str:
    return "case " + " ".join(f"when intent = '{i}' and execution = '{e}' then {float(v)}D" for i, values in cells.items() for e, v in zip(executions, values)) + " end"


def definitions(rules: RuleSet = CURRENT, t: Thresholds = Thresholds(), dt: float = 0.1) -> dict[str, str]:
    """Signature and body of each function, in an order in which they can be made."""
    classes = rules.longitudinal | rules.lateral
    every = ", ".join(f"cast({_counts(ps)} as bigint)" for ps in classes.values())
    once = "transform(array(struct(cot_text as text, lower(cot_text) as folded, cot_text rlike '[^\\\\x00-\\\\x7F]' as odd)), s -> array(" + every + "))[0]"
    long, lat = list(rules.longitudinal), list(rules.lateral)
    n = len(classes)
    total, best = (f"({' + '.join(f'n[{k}]' for k in range(n))})", f"greatest({', '.join(f'n[{k}]' for k in range(n))})")
    gap = "sqrt(pow(q.x - p.x, 2) + pow(q.y - p.y, 2))"
    final = f"sqrt(pow(path[size(path) - 1].x - path[size(path) - 2].x, 2) + pow(path[size(path) - 1].y - path[size(path) - 2].y, 2)) / {dt}D"
    initial = f"sqrt(pow(path[1].x - path[0].x, 2) + pow(path[1].y - path[0].y, 2)) / {dt}D"
    speed = f"if(size(path) < 2, 0D, {final})"
    accel = f"if(size(path) < 3, 0D, (({final}) - ({initial})) / ((size(path) - 2) * {dt}D))"
    shift = "if(size(path) < 2, 0D, path[size(path) - 1].y - path[0].y)"
    side = lambda name: f"if(({shift}) > 0, '{name}_left', '{name}_right')"
    blank = f"array_repeat(0L, {n})"
    return {
        "intent_counts(cot_text string) returns array<bigint>": f"coalesce({once}, {blank})",
        "long_intent_of(n array<bigint>) returns string": _winner(long, 0),
        "lat_intent_of(n array<bigint>) returns string": _winner(lat, len(long)),
        "confidence_of(n array<bigint>) returns double": f"coalesce({best} / nullif({total}, 0), 0D)",
        "long_intent(cot_text string) returns string": "long_intent_of(intent_counts(cot_text))",
        "lat_intent(cot_text string) returns string": "lat_intent_of(intent_counts(cot_text))",
        "intent_confidence(cot_text string) returns double": "confidence_of(intent_counts(cot_text))",
        f"long_execution(path {_POINTS}) returns string": f"case when ({speed}) < {t.stopped}D then 'stopped' when ({accel}) > {t.acceleration}D then 'accelerating' when ({accel}) < -{t.acceleration}D then 'decelerating' else 'constant_speed' end",
        f"lat_execution(path {_POINTS}) returns string": f"case when abs({shift}) > {t.lane_change}D then {side('lane_change')} when abs({shift}) > {t.shift}D then {side('shift')} else 'straight' end",
        f"displacement(path {_POINTS}, truth {_POINTS}) returns double": f"if(size(path) = size(truth) and size(path) > 0, aggregate(zip_with(path, truth, (p, q) -> {gap}), 0D, (a, d) -> a + d) / size(path), null)",
        "long_compat(intent string, execution string) returns double": _matrix(LONG_COMPAT, LONG_EXECUTIONS),
        "lat_compat(intent string, execution string) returns double": _matrix(LAT_COMPAT, LAT_EXECUTIONS),
        "mismatch_score(long_intent string, long_execution string, lat_intent string, lat_execution string) returns double": (
            "round(1 - coalesce(0.5D * long_compat(long_intent, long_execution) + 0.5D * lat_compat(lat_intent, lat_execution), long_compat(long_intent, long_execution), lat_compat(lat_intent, lat_execution), 0.5D), 3)"
        ),
        "mismatch_type(score double, long_intent string, lat_intent string) returns string": (
            f"case when long_intent = '{UNSPECIFIED}' and lat_intent = '{UNSPECIFIED}' then 'unclassified_intent' when score < 0.3D then 'consistent' when score < 0.6D then 'partial_mismatch' else 'severe_mismatch' end"
        ),
    }


def register(spark: SparkSession, rules: RuleSet = CURRENT, t: Thresholds = Thresholds()) -> list[str]:
    """Make the functions in this session; their names. long_intent(), lat_intent() and intent_confidence() of one text each count
    all patterns: where several are wanted, take intent_counts() in a subquery and the _of functions of it."""
    made = []
    for signature, body in definitions(rules, t).items():
        spark.sql(f"create or replace temporary function {signature} return {body}")
        made.append(signature.partition("(")[0])
    return made
