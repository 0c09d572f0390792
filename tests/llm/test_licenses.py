import re

import pytest

from concord.llm import licenses

DOCS = "doc_id long, text string, labels string, score int"


def slow_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places, labels = [], set()
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        p = phrase.split()
        for i in range(len(words)):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


TEXTS = [
    None,
    "",
    "Released under the MIT License.",
    "the MIT\n*License* and the Apache-License; GNU General  Public License. MIT license",
    "Ämit license, mit licenses, permit license",
    "Licensed under CC BY-NC 4.0.",
    "word " * 50_000 + "Licensed under the Apache License, Version 2.0.",
    "a1b2 license MIT",
    "MİT license mit license",
]


@pytest.mark.parametrize("text", TEXTS)
def test_base_as_brute_force(text):
    got = licenses.Scanner().scan(None if text is None else text.encode())
    assert got[:5] == slow_base(text)


def readings(markup, numbers=(0, 1)):
    """Every text that a template accepts, for small templates."""
    m = re.search(r"\[\[([^\[\]]*)\]\]", markup)
    if m:
        return {r for inner in ("", m[1]) for r in readings(markup[: m.start()] + inner + markup[m.end() :], numbers)}
    m = re.search(r"\{\{([^}]*)\}\}", markup)
    if m:
        choices = [" ".join(["zz"] * n) for n in range(int(m[1]) + 1)] if m[1].strip().isdigit() else m[1].split("|")
        return {r for c in choices for r in readings(markup[: m.start()] + c + markup[m.end() :], numbers)}
    return {" ".join(markup.split())}


@pytest.mark.parametrize("markup", ["one [[two]] three {{four|five six}} seven", "a {{2}} b", "x [[y {{1|1 1}}]] z", "one [[two [[three]]]] four"])
def test_automaton_accepts_exactly_its_readings(markup):
    automaton = licenses.Automaton("t", markup)
    texts = readings(markup)
    assert texts
    for text in texts:
        words = [w.encode() for w in text.split()]
        assert automaton.accepts(words, 0)
        for i in range(len(words)):  # any mandatory word changed or missing
            for other in (words[:i] + [b"wrong"] + words[i + 1 :], words[:i] + words[i + 1 :]):
                plain = b" ".join(other).decode()
                ends = {" ".join(plain.split()[:n]) for n in range(len(other) + 1)}
                assert automaton.accepts(other, 0) == bool(ends & {re.sub("zz", "zz", t) for t in texts} or _wild(markup, ends))


def _wild(markup, ends):
    """Readings whose free words are any words."""
    forms = [re.escape(t).replace("zz", r"\S+") for t in readings(markup)]
    return any(re.fullmatch(f, e) for f in forms for e in ends)


def reading(markup):
    """One text that a template accepts: optional parts in, first choices, one word for free ones."""
    markup = re.sub(r"\{\{([^}]*)\}\}", lambda m: " somebody " if m[1].strip().isdigit() else m[1].split("|")[0], markup)
    return re.sub(r"\[\[|\]\]", " ", markup)


def bare(markup):
    """The mandatory words, with the first choices, in order; and which of them are mandatory."""
    out = []
    for part in re.split(r"(\[\[.*?\]\]|\{\{.*?\}\})", markup, flags=re.S):
        if part.startswith("{{"):
            inner = part[2:-2]
            out += [(w, False) for w in licenses.words_of((" " if inner.strip().isdigit() else inner.split("|")[0]).encode())]
        elif not part.startswith("[["):
            out += [(w, True) for w in licenses.words_of(part.encode())]
    return out


@pytest.mark.parametrize("n", range(len(licenses.TEMPLATES)))
def test_every_template_needs_all_its_wording(n):
    label, kind, markup = licenses.TEMPLATES[n]
    automaton = licenses.Automaton(label, markup, kind)
    scanner = licenses.Scanner()
    found = scanner.scan(("Preface. " + reading(markup) + " The end.").encode())
    assert label in found[5].split(",") and found[6] >= licenses.SCORES[kind]
    words = bare(markup)
    whole = [w for w, _ in words]
    assert automaton.accepts(whole, 0)
    for i, (_, mandatory) in enumerate(words):
        if mandatory:
            assert not automaton.accepts(whole[:i] + whole[i + 1 :], 0) or whole[i] in whole[i - 1 : i] + whole[i + 1 : i + 2] or _ends_early(automaton, whole, i)
            assert not automaton.accepts(whole[:i] + [b"zz"] + whole[i + 1 :], 0) or _ends_early(automaton, whole, i)


def _ends_early(automaton, words, i):
    """A choice that is a prefix of another may end the reading before word i."""
    return automaton.accepts(words[:i], 0)


def test_templates(spark):
    bsd = reading(next(m for label, _, m in licenses.TEMPLATES if label == "bsd-2-clause"))
    rows = [
        (1, "Released under the MIT License.", "mit", 0.8), (2, "Licensed under the Apache License, Version 2.0.", "apache", 0.8),
        (3, "This work is licensed under the GNU General Public License, version 3.", "gpl", 0.8), (4, "Licensed under CC BY-NC 4.0.", "cc-by-nc", 0.8),
        (5, "x " + bsd + " y", "bsd-2-clause", 1.0), (6, bsd.replace("binary form must", "binary form may"), "", 0.0), (7, "no license here", "", 0.0),
        (8, bsd.replace("SUCH DAMAGE", "DAMAGE"), "", 0.0), (10, "the mit license", "mit", 0.5),
        (None, None, "", 0.0), (9, "Licensed under CC BY-SA 4.0", "cc-by-sa", 0.8), (9, "Licensed under CC BY-SA 4.0", "cc-by-sa", 0.8),
    ]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t, _, _ in rows], DOCS)
    got = sorted((r["doc_id"] or 0, r["labels"], r["score"]) for r in licenses.scan(df).collect())
    assert got == sorted((i or 0, want, score) for i, _, want, score in rows)
    assert licenses.scan(spark.createDataFrame([], DOCS)).collect() == []


def test_a_header_is_a_notice():
    scanner = licenses.Scanner()
    for name in ("apache-2.0", "gpl-3.0", "mpl-2.0", "cc-by"):
        found = scanner.scan(reading(next(m for label, _, m in licenses.TEMPLATES if label == name)).encode())
        assert name in found[5].split(",") and found[6] == 0.8
