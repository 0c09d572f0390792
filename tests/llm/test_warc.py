import base64
import hashlib
import random
import re

import pytest

from concord.llm import warc

PAGES = "page_id long, url string, html string, digest string, value int"


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def nasty():
    rng = random.Random(2)
    inner = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"
    texts = ["plain", "", None, "plain", "ä" * 70, inner, inner * 3, "x" + inner + "WARC/1.1\r\n", "WARC/1.1\r\nContent-Length: 30\r\n\r\nends early", "WARC/1.1\r\n\r\n", "\r\n\r\n", "tail\r\n\r\n", "WARC/1.1", "WARC/1.1\r\n" * 50, "y" * 200_000 + inner]
    texts += ["".join(rng.choice(["WARC/1.1\r\n", "Content-Length: 7\r\n\r\n", "seven..", "\r\n\r\n", "é"]) for _ in range(rng.randrange(12))) for _ in range(60)]
    return [(i, f"http://a.example/{i}\r\nX: y", t, "d", i) for i, t in enumerate(texts)]


def expected(rows, least=0):
    largest = {}
    for i, _, t, *_ in rows:
        largest[t or ""] = max(largest.get(t or "", -1), i)
    out = {}
    for i, _, t, *_ in rows:
        n, top = len((t or "").encode()), largest[t or ""]
        again = n >= least and i != top
        out[i] = (n, digest(t), "revisit" if again else "response", top if again else None)
    return out


@pytest.mark.parametrize("least", [0, 6])
def test_round_trip(spark, least):
    rows = nasty()
    got = warc.archive(spark.createDataFrame(rows, PAGES).repartition(3), least).collect()
    assert len(got) == len(rows) and all(r["verified"] for r in got)
    assert {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got} == expected(rows, least)


def test_split_files(spark):
    """Ranges of files end anywhere, within the magic too."""
    rows = nasty()
    path = warc.new_path(spark, "warc-test")
    warc.write(spark.createDataFrame(rows, PAGES).coalesce(1), path)
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(k) for k in keys]
    try:
        for size in (997, 4093):
            spark.conf.set(keys[0], str(size))
            spark.conf.set(keys[1], "1")
            got = warc.read_back(spark, path).collect()
            assert {r["page_id"]: r["payload_digest"] for r in got} == {i: digest(t) for i, _, t, *_ in rows}
    finally:
        for k, v in zip(keys, before):
            spark.conf.set(k, v)


def test_archive_is_plain_warc(spark, tmp_path):
    """A reader that follows Content-Length from the start of each file finds every record."""
    rows = nasty()
    path = str(tmp_path / "a")
    warc.write(spark.createDataFrame(rows, PAGES).coalesce(2), path)
    n = 0
    for file in (tmp_path / "a").glob("part-*"):
        data = file.read_bytes()
        at = 0
        while at < len(data):
            assert data.startswith(b"WARC/1.1\r\n", at)
            end = data.index(b"\r\n\r\n", at)
            size = int(re.search(rb"\r\nContent-Length: (\d+)", data[at:end])[1])
            at = end + 4 + size
            assert data[at : at + 4] == b"\r\n\r\n"
            at, n = at + 4, n + 1
    assert n == len(rows)


def test_nulls_repeats_empty(spark):
    rows = [(None, None, "p", None, None), (3, None, "p", None, None), (3, "u", "p", None, None), (None, "u", None, None, None)]
    got = sorted(((r["page_id"] or -1), r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.archive(spark.createDataFrame(rows, PAGES)).collect())
    assert got == [(-1, 0, "response", None), (-1, 1, "revisit", 3), (3, 1, "response", None), (3, 1, "response", None)]
    assert warc.archive(spark.createDataFrame([], PAGES)).collect() == []
