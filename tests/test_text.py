import re

import pytest
from pyspark.sql import functions as F

from concord.functions import text
from concord.functions.rules import CURRENT, EXPANDED, LATERAL, LONGITUDINAL, STRICT, literal_of
from concord.plans.fixtures import PHRASES


def slow(t, rules=CURRENT):
    counts = {c: sum(len(re.findall(f"(?:{p})", t or "", re.IGNORECASE)) for p in ps) for a in (rules.longitudinal, rules.lateral) for c, ps in a.items()}

    def win(names):
        best = max(counts[n] for n in names)
        return next(n for n in names if counts[n] == best) if best else "unspecified"

    total = sum(counts.values())
    return win(list(rules.longitudinal)), win(list(rules.lateral)), (max(counts.values()) / total if total else 0.0)


def variants():
    """For each pattern a text that matches it and one that nearly does."""
    out = []
    for patterns in [*LONGITUDINAL.values(), *LATERAL.values()]:
        for p in patterns:
            t = re.sub(r"\(([^()|]*)(\|[^()]*)?\)(\?)?", lambda m: "" if m[3] else m[1], p)
            t = re.sub(r"\.\{\d+,(\d+)\}", "", t.replace(r"\b", "").replace(r"\w*", "x"))
            out += [f"Now {t} here.", f"Now {t}zz here", f"{t.upper()}; {t}"]
    return out


ODD = ["ſtop now", "decelerateé", "keep \rlane", "keep  lane", "keep \nlane", "éstop", "stopé", "K", "maintaın speed", "STOP, Stop stop", " ", "nudge 12345678901 left", "nudge 1234567890 left", "x" * 5000 + " stop"]


def test_texts_as_python_regex(spark):
    texts = [*PHRASES, *variants(), *ODD]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "clip_id int, cot_text string")
    for rules in (CURRENT, STRICT, EXPANDED):
        got = {r["clip_id"]: r for r in text.classify_text(df, rules=rules).collect()}
        for i, t in enumerate(texts):
            assert (got[i]["long_intent"], got[i]["lat_intent"], pytest.approx(got[i]["confidence"])) == slow(t, rules), t


def test_literals_are_in_every_match():
    for patterns in [*LONGITUDINAL.values(), *LATERAL.values()]:
        for p in patterns:
            assert literal_of(p)
    for t in variants():
        for patterns in [*LONGITUDINAL.values(), *LATERAL.values()]:
            for p in patterns:
                for m in re.finditer(p, t, re.IGNORECASE):
                    assert literal_of(p) in m[0].lower()


def test_ties_overlaps_and_no_negation(spark):
    def one(t):
        r = text.classify_text(spark.createDataFrame([(t,)], "cot_text string"), keep_counts=True).first()
        return r

    assert one("move to the left lane")["lat_intent"] == "nudge_left"
    assert one("brake hard")["long_intent"] == "stop"
    assert one("come to a full stop")["n_stop"] == 2
    assert one("do not stop")["long_intent"] == "stop"
    assert one("stopped")["long_intent"] == "unspecified"
    assert one(None)["confidence"] == 0.0


def test_rule_sets():
    n = lambda r: sum(map(len, [*r.longitudinal.values(), *r.lateral.values()]))
    assert (n(CURRENT), n(STRICT), n(EXPANDED)) == (87, 75, 92)


def test_plan_is_native(spark):
    df = spark.createDataFrame([("stop",)], "cot_text string").select(F.col("cot_text"))
    plan = text.classify_text(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan.replace("ExistingRDD", "")


#: Worked out from the patterns by hand: what each text of the fixture is to be.
FROZEN = [
    ("unspecified", "nudge_left", 1), ("stop", "unspecified", 1), ("slow_down", "hold_lane", 1 / 2), ("accelerate", "lane_change_left", 1 / 2), ("maintain", "hold_lane", 1 / 2), ("stop", "unspecified", 1),
    ("maintain", "hold_lane", 2 / 3), ("slow_down", "nudge_left", 2 / 3), ("unspecified", "nudge_left", 1 / 2), ("accelerate", "lane_change_right", 1 / 2), ("stop", "unspecified", 1 / 2), ("maintain", "unspecified", 2 / 3),
    ("accelerate", "lane_change_right", 1 / 2), ("maintain", "nudge_right", 1 / 2), ("slow_down", "lane_change_right", 1 / 2), ("maintain", "hold_lane", 1 / 2), ("unspecified", "unspecified", 0), ("unspecified", "unspecified", 0),
    ("slow_down", "nudge_right", 2 / 3), ("maintain", "hold_lane", 1 / 2), ("accelerate", "lane_change_left", 1 / 2), ("stop", "unspecified", 2 / 3), ("unspecified", "unspecified", 0), ("unspecified", "unspecified", 0),
]


def test_texts_of_the_fixture_as_frozen(spark):
    df = spark.createDataFrame(list(enumerate(PHRASES)), "clip_id int, cot_text string")
    got = text.classify_text(df).orderBy("clip_id").collect()
    assert [(r["long_intent"], r["lat_intent"], round(r["confidence"], 9)) for r in got] == [(a, b, round(c, 9)) for a, b, c in FROZEN]


def test_rule_sets_share_their_counts(spark):
    sets = {"strict": STRICT, "current": CURRENT, "expanded": EXPANDED}
    texts = [*PHRASES, *variants(), *ODD]
    df = spark.createDataFrame(list(enumerate(texts)), "clip_id int, cot_text string").cache()
    got = text.classify_by_sets(df, sets).orderBy("clip_id").collect()
    for name, rules in sets.items():
        alone = text.classify_text(df, rules=rules).orderBy("clip_id").collect()
        for a, b in zip(got, alone):
            assert tuple(a[f"{name}_{c}"] for c in ("long_intent", "lat_intent", "confidence")) == (b["long_intent"], b["lat_intent"], b["confidence"])
    union = {p for rules in sets.values() for axis in (rules.longitudinal, rules.lateral) for ps in axis.values() for p in ps}
    spark.conf.set("spark.sql.debug.maxToStringFields", "2000")
    plan = text.classify_by_sets(df, sets)._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert plan.count("regexp_extract_all(") == len(union)  # each pattern stands in the plan once


def test_many_patterns_compile(spark, sf_dir):
    """No stage falls back to interpretation because its code is too large."""
    from concord.operators.extended import parser_ablation
    from concord.plans import queries
    from concord.plans.fixtures import Tables

    rows = queries.scored(Tables(spark, sf_dir))
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        assert parser_ablation(rows).count() == 3
        assert len(text.classify_text(rows.select("cot_text")).collect()) == rows.count()
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")
