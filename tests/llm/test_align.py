import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from concord.llm import align

DOCS = "doc_id long, text string, n_a int, pair string"


@pytest.fixture(scope="module")
def tools():
    import sentencepiece
    import tokenizers

    a = tokenizers.Tokenizer.from_file(align.BYTE_BPE)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=align.PIECE_BPE)


def spelled(tools, text):
    """Ids and bytes of both token lists of a whole text."""
    a, b = tools
    table = {v: k for k, v in align._byte_letters().items()}
    back = {c: b for b, c in table.items()}
    ids_a = a.encode(" " + text, add_special_tokens=False).ids
    own_a = [bytes(back[c] for c in a.id_to_token(i)) if i < 50256 else b"" for i in ids_a]
    ids_b = b.encode(text)
    own_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    return ids_a, own_a, ids_b, own_b


def brute(tools, docs):
    """Every pair of tokens whose byte ranges overlap, without units, spans or chunks."""
    rows, count = [], Counter()
    for doc_id, text in docs:
        if not text:
            rows.append((doc_id, [], [], [], []))
            continue
        ids_a, own_a, ids_b, own_b = spelled(tools, text)
        want = (" " + text).encode()
        if b"".join(own_a) != want or b"".join(own_b) != want:
            rows.append((doc_id, [], [], [], []))
            continue
        stop_a, stop_b = ([sum(map(len, own[: k + 1])) for k in range(len(own))] for own in (own_a, own_b))
        both = [-1, *sorted({*stop_a} & {*stop_b})]
        groups = [(([i for i, e in zip(ids_a, stop_a) if lo < e <= hi]), ([i for i, e in zip(ids_b, stop_b) if lo < e <= hi])) for lo, hi in zip(both, both[1:])]
        links = [(ids_a[i], ids_b[j]) for i in range(len(ids_a)) for j in range(len(ids_b)) if max(stop_a[i] - len(own_a[i]), stop_b[j] - len(own_b[j])) < min(stop_a[i], stop_b[j])]
        count.update(links)
        rows.append((doc_id, ids_a, ids_b, groups, links))
    most = defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    out = []
    for doc_id, ids_a, ids_b, groups, links in rows:
        told = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        digest = hashlib.sha256(told.encode()).hexdigest() if ids_a else ""
        out.append((doc_id, len(ids_a), len(ids_b), len(groups), len(links), sum(count[p] == most[p[1]] for p in links), sum(count[p] for p in links), digest))
    return out, count


ODD = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a\nb", "a.\nB c\nd", "\nx\ny", "a\n\nb", "a \n b", "\n", "\t x\r\n y ", "héllo 世界 ☃ x", "ﬁ ﬀ 𝔘𝔫𝔦 👩‍👩‍👧 z", "a▁b c", "▁", "<|endoftext|> <s>x</s> <unk> <0x0A>", "it's we'll 12345 67.8",
    "x" * 3000, "naïve space　wide   line \x1c sep\x85 nel", "é ​ ﻿", "a\x00b \x7f \x01", "🙂" * 40, "def f(x):\n    return x  # ok\n", "word " * 400, "ไทยภาษา العربية हिन्दी",
]


def test_against_brute_force(spark, tools):
    rng = random.Random(5)
    letters = "abcdefgh'  \n\t.,éß世☃👍 ▁"
    docs = list(enumerate(ODD)) + [(100 + i, "".join(rng.choice(letters[: -(i % 2) or None]) for _ in range(rng.randrange(60)))) for i in range(150)]
    docs += [(None, "no id"), (3, "a  b"), (3, "a  b")]
    want, count = brute(tools, docs)
    df = spark.createDataFrame([(i, t, 7, "clash") for i, t in docs], DOCS).repartition(3)
    for size in (1, 500, 10**9):
        got = align.align(df, chunk_bytes=size)
        assert got.columns == [c.split()[0] for c in align.RESULT.split(", ")]
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    most = defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    assert sorted(map(tuple, align.pairs(df).collect())) == sorted((a, b, n, n == most[b]) for (a, b), n in count.items())


def test_units_are_exact(tools, sf_dir):
    """Units, spans and decoded bytes give whole texts' tokens, over the given documents."""
    import pyarrow.parquet as pq

    loaded = align.loaded(align.BYTE_BPE, align.PIECE_BPE)
    assert loaded.by_unit
    for text in pq.read_table(f"{sf_dir}/documents.parquet").column("text").to_pylist():
        if text:
            units = loaded.units(text)
            assert "".join(units) == f" {text}"
            made = loaded.learn(set(units))
            ids_a, own_a, ids_b, own_b = spelled(tools, text)
            good = b"".join(own_a) == b"".join(own_b) == f" {text}".encode()
            assert good == (None not in [made[u] for u in units])
            if good:
                told = ";".join(made[u][0] for u in units)
                a, b = zip(*[g.split("|") for g in told.split(";")])
                assert ",".join(a) == ",".join(map(str, ids_a)) and ",".join(b) == ",".join(map(str, ids_b))


def test_spans_that_fit_are_cuts_and_others_are_counted():
    ends = lambda spans, *n: align.ends(np.array(spans), np.array(n)).tolist()
    assert ends([(0, 2), (2, 4), (4, 5)], 2, 2, 1) == [2, 4, 5]
    assert ends([(0, 1), (1, 4), (1, 4), (4, 6)], 1, 2, 1, 2) == [1, 3, 4, 6]  # a character of three bytes in two tokens
    assert ends([(0, 3), (0, 3), (3, 4)], 2, 1, 1) == [2, 3, 4]
    assert ends([(0, 1), (1, 1), (1, 1), (1, 4), (4, 5)], 1, 1, 1, 1, 1) == [1, 2, 3, 4, 5]  # spelled in bytes


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab.,'1 \n\t\r\x1c\x85\u2028 é世☃👍▁ﬁ"), max_size=30))
def test_units_of_odd_texts(tools, text):
    if text:
        loaded = align.loaded(align.BYTE_BPE, align.PIECE_BPE)
        units = loaded.units(text)
        assert "".join(units) == f" {text}"
        ids_a, own_a, ids_b, own_b = spelled(tools, text)
        made = [loaded.learn({u})[u] for u in units]
        together = loaded.aligned(list(dict.fromkeys(units)))
        assert together == [made[units.index(u)] for u in dict.fromkeys(units)]
        assert (b"".join(own_a) == b"".join(own_b) == f" {text}".encode()) == (None not in made)
        if None not in made:
            a, b = zip(*[g.split("|") for g in ";".join(m[0] for m in made).split(";")])
            assert ",".join(a) == ",".join(map(str, ids_a)) and ",".join(b) == ",".join(map(str, ids_b))


def test_not_utf8_and_empty(spark):
    df = spark.sql("select 1L doc_id, cast(x'61ff62' as string) text union all select 2L, 'ok then'")
    got = {r["doc_id"]: r for r in align.align(df).collect()}
    assert tuple(got[1])[1:] == (0, 0, 0, 0, 0, 0, "") and got[2]["n_a"] > 0
    assert align.align(spark.createDataFrame([], DOCS)).collect() == []


def test_unit_memory_is_bounded(monkeypatch):
    tools = align.Tokenizers(align.BYTE_BPE, align.PIECE_BPE)
    monkeypatch.setattr(align, "REMEMBERED", 10)
    for k in range(50):
        made = tools.learn({f" w{k}", " again", f"\n{'y' * 300}{k}"})
        assert len(made) == 3 and None not in made.values() and len(tools.known) <= 11 and len(tools.older) <= 11
        assert not any(len(u) > align.LONGEST for u in (*tools.known, *tools.older))
    assert " again" in tools.known or " again" in tools.older
