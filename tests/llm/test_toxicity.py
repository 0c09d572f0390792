import random

import numpy as np

from concord.llm import toxicity

DOCS = "doc_id long, text string, lang string, source string, toxic string, y int"
LABELS = "doc_id long, quality int, toxic int"


def features(text, stems={"idiot$": 3.0, "scum$": 2.0, "vermi": 2.5}):
    return dict(zip(toxicity.FEATURES, toxicity.clause_sums(text, toxicity.Lexicon(stems))))


def test_readings():
    assert features("What an idiot. Nice day.")["plain"] == 3.0
    assert features("You idiot! Hello.")["targeted"] == features("An idiot, you are. Hello.")["targeted"] == 3.0
    assert features("This was not an idiot at all.")["negated"] == 3.0
    assert features("He said idiot twice.")["reported"] == 3.0
    assert features("idiot he said")["targeted"] == 3.0  # the verb of speech stands behind
    assert features('A sign "idiot scum" hung there.')["reported"] == 5.0
    assert features('The sign: "What an idiot. Such scum!" idiot')["reported"] == 5.0  # over clauses
    assert features('The sign: "What an idiot. Such scum!" idiot')["plain"] == 3.0
    assert features('An open " mark\nidiot')["plain"] == 3.0
    assert features("We will kill you.")["threats"] == 1.0
    assert features("We will not kill you.")["threats"] == 0.0
    assert features("He said we will kill you.")["threats"] == 0.0
    assert features("It will kill time.")["threats"] == 0.0
    assert features("It will kill time. You know.")["threats"] == 0.0
    assert features("Vermin and vermiculite")["plain"] == 5.0
    assert features("idiot here. idiot there.")["clauses"] == 2.0
    assert features("You idiot, you idiot")["paid"] == 9.0
    assert features("IDIOT")["plain"] == 3.0
    for text in (None, "", "fine words only", "\n. ! "):
        assert not any(v for k, v in features(text).items() if k != "tokens")
    assert features("fine " * 100_000 + "idiot")["plain"] == 3.0


def paths(machine, read):
    """Everything that a machine can write for what it reads, with the weights of the arcs."""
    live = [(0, (), ())]
    for x in read:
        live = [(to, (*out, y), (*w, v)) for state, out, w in live for y, v, to in machine.arcs[state].get(x, ())]
    return [(out, w) for state, out, w in live if state in machine.finals]


def test_composition_is_one_machine_after_the_other():
    rng = random.Random(5)
    whole, parts = toxicity.grammar(), toxicity.machines()
    for _ in range(300):
        read = [(k := rng.choice([*toxicity.KINDS, toxicity.INSULT, toxicity.WILD, toxicity.TARGET, toxicity.INTENDS]), rng.choice([1.0, 2.5]) if k in (toxicity.INSULT, toxicity.WILD, toxicity.THREAT) else 0.0) for _ in range(rng.randrange(9))]
        slow = [(tuple(k for k, _ in read), (1.0,) * len(read))]
        for machine in parts:
            slow = [(out, tuple(a * b for a, b in zip(w, v))) for said, w in slow for out, v in paths(machine, said)]
        want = max(sum(v * w for (_, v), w in zip(read, ws)) for _, ws in slow)
        got = whole.best(read, toxicity.PAYS.__contains__)
        assert got[0] == want
        assert sorted(paths(whole, [k for k, _ in read])) == sorted(slow) if all(isinstance(y, str) for o, _ in slow for y in o) else len(paths(whole, [k for k, _ in read])) == len(slow)
        ties = [out for out, ws in slow if sum(v * w for (_, v), w in zip(read, ws)) == want]
        assert got[1] in [[(i, y) for i, y in enumerate(out) if y in toxicity.PAYS] for out in ties]


def test_long_gaps_are_of_no_account():
    rng = random.Random(6)
    words = ["idiot", "you", "not", "said", "will", "kill", ".", '"', "\n", "fine", "fine", "fine"]
    lexicon, whole = toxicity.Lexicon({"idiot$": 3.0}), toxicity.grammar()
    for _ in range(200):
        text = " ".join(rng.choice(words) + " fine" * rng.choice([0, 0, 1, 8]) for _ in range(12))
        read = [lexicon[t] for t in toxicity._TOKEN.findall(text)]
        assert toxicity.clause_sums(text, lexicon)[9] == whole.best(read)[0]


def test_held_out_accuracy(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.1")
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    found = [r["predicted"] for r in rows if r["toxic"] == 1]
    wrong = [r["predicted"] for r in rows if r["toxic"] == 0]
    print(len(found), np.mean(found), len(wrong), np.mean(wrong))
    assert np.mean(found) >= 0.9 and np.mean(wrong) <= 0.02


def corpus(n=600):
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(n):
        toxic = int(rng.random() < 0.3)
        words = [f"w{rng.randrange(300)}" for _ in range(60)]
        for _ in range(4 * toxic):
            words[rng.randrange(60)] = rng.choice(["grumbo", "flarn", "zibble"])
        docs.append((i, " ".join(words), None, None, None, 1))
        labels.append((i, 1, toxic))
    return docs, labels


def test_learns_words_from_labels_only_outside_the_held_out_part(spark):
    docs, labels = corpus()
    df = spark.createDataFrame(docs, DOCS)
    got = {r["doc_id"]: r for r in toxicity.classify(df, spark.createDataFrame(labels, LABELS)).collect()}
    assert np.mean([got[i]["predicted"] == t for i, _, t in labels]) > 0.98
    flipped = [(i, q, 1 - t if got[i]["held_out"] else t) for i, q, t in labels]
    again = {r["doc_id"]: r["score"] for r in toxicity.classify(df, spark.createDataFrame(flipped, LABELS)).collect()}
    assert all(again[i] == got[i]["score"] for i, _, _ in labels)
    kept = toxicity.keep_clean(df, spark.createDataFrame(labels, LABELS))
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i in got if not got[i]["predicted"]}


def test_nulls_and_empty(spark):
    docs = [(None, None, None, None, None, None), (1, "", None, None, None, None), (2, "a b", None, None, None, None), (2, "a b", None, None, None, None)]
    df = spark.createDataFrame(docs, DOCS)
    got = toxicity.classify(df, spark.createDataFrame([(1, 1, 1), (None, 0, 0), (2, None, None)], LABELS)).collect()
    assert len(got) == 4 and {r["score"] for r in got} == {0.0}
    assert toxicity.classify(spark.createDataFrame([], DOCS), spark.createDataFrame(corpus(50)[1], LABELS)).collect() == []
