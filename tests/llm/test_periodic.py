"""Periodic runs against a plain scan of every stretch."""

import hashlib
import random
import re
import zlib

import helpers as H
import numpy as np
import pytest

from landmarkflow.llm import periodic
from landmarkflow.llm.queries import QUERIES


def plain_runs(w, least=12):
    """Every (start, length, period) by the definition: smallest period, not extendable."""
    out = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            stretch = w[i:j + q]
            if length >= max(least, 2 * q) and not any(
                    stretch[d:] == stretch[:-d] for d in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(text, least=12):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    runs = plain_runs(w, least)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return len(w), runs, " ".join(x for i, x in enumerate(w) if i not in gone)


def looped(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if doc_id is None or h % 10 or not n:
        return text
    a = h // 10 % n
    p = 1 + (n - a) // (3 + h // 10 % 8)
    return " ".join(w[i] if i < a else w[a + (i - a) % p] for i in range(n))


def digest(text):
    n, runs, kept = plain_row(text)
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    lines = "".join(f"{s},{k},{q}\n" for s, k, q in runs)
    return (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def cases():
    rng = random.Random(3)
    out = ["a " * 40, "a b " * 30, "abababa " * 3, " ".join("abababa" * 4), " ".join("aab" * 9),
           " ".join("abaababaabaababaababaabaababaabaab"), "x " * 11, "x " * 12,
           " ".join(("p q r s t u v " * 3).split()[:-1]), "1 2 3 4 5 6 1 2 3 4 5 6",
           "1 2 3 4 5 6 1 2 3 4 5", "a\x1cb é c " * 8, "a\tb\nc\r\n" * 5]
    for k in range(150):
        letters = "abcdefghij"[:rng.choice([1, 2, 2, 3, 5, 10])]
        w = [rng.choice(letters) for _ in range(rng.randint(0, 90))]
        if rng.random() < 0.6:
            unit = [rng.choice(letters) for _ in range(rng.randint(1, 15))]
            at = rng.randint(0, len(w))
            w[at:at] = (unit * 9)[:rng.randint(len(unit), 9 * len(unit))]
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("pairs", [periodic.PAIRS, 7])
def test_runs_equal_plain_scan(spark, monkeypatch, pairs):
    """Also with the lag grid cut into many blocks; one chunk holds all texts."""
    monkeypatch.setattr(periodic, "PAIRS", pairs)
    texts = cases()
    docs = H.table(spark, texts).repartition(1)
    got = {r.doc_id: (r.n_words, [tuple(x) for x in r.runs], r.collapsed)
           for r in periodic.periodic_runs(docs).collect()}
    assert got == {i: plain_row(t) for i, t in enumerate(texts)}


def test_other_lengths(spark):
    texts = cases()
    for least in (5, 7, 30):
        got = periodic.periodic_runs(H.table(spark, texts), periodic.RunParams(least))
        assert {r.doc_id: [tuple(x) for x in r.runs] for r in got.collect()} == {
            i: plain_row(t, least)[1] for i, t in enumerate(texts)}
    with pytest.raises(ValueError):
        periodic.periodic_runs(H.table(spark, texts), periodic.RunParams(4))


def test_splitting_leaves_only_frequent_words():
    ids = np.array([1, 2, 1, 2, 9, 1, 2, 3, 4, 1, 2] + [5] * 12)
    place, segment = periodic.split_rare(ids, np.array([0, 11, 23]), 4)
    # 9, 3 and 4 split the first row; two pieces are too short
    assert place.tolist() == [0, 1, 2, 3, *range(11, 23)]
    assert segment.tolist() == [0] * 4 + [1] * 12


def test_awkward_rows(spark):
    docs = H.awkward(spark, ["go on " * 3000, " ".join(str(i % 1999) for i in range(9000))])
    found = periodic.periodic_runs(docs)
    rows = docs.select("doc_id", "text").collect()
    assert found.columns == ["doc_id", "n_words", "runs", "collapsed"]
    got = {r.doc_id: r for r in found.collect()}
    assert found.count() == len(rows)
    for i, text in rows:
        if len(text or "") < 2000:
            assert (got[i].n_words, [tuple(x) for x in got[i].runs],
                    got[i].collapsed) == plain_row(text)
    assert [tuple(x) for x in got[9].runs] == [(0, 6000, 2)] and got[9].collapsed == "go on"
    assert [tuple(x) for x in got[10].runs] == [(0, 9000, 1999)]
    assert periodic.digest(periodic.periodic_runs(docs.limit(0))).count() == 0
    named = periodic.periodic_runs(docs.withColumn("doc_id", docs.doc_id.cast("string")))
    assert named.count() == len(rows)


def test_loop_words(spark):
    texts = [" ".join(f"w{i}" for i in range(n)) for n in range(60)] + [None, "", " \n"]
    ids = [None if k == 5 else k * 7 - 30 for k in range(len(texts))]
    docs = H.table(spark, texts, ids)
    got = periodic.loop_words(docs).collect()
    assert sorted(map(repr, ((r.doc_id, r.text) for r in got))) == sorted(
        map(repr, ((i, looped(i, t)) for i, t in zip(ids, texts))))


def test_query_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op13_periodic_runs"](spark, sf_dir)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli",
                           "runs_sha256", "collapsed_sha256"]
    want = {i: digest(looped(i, t)) for i, t in docs if len(t or "") < 4000}
    rows = {r.doc_id: tuple(r)[1:] for r in got.collect()}
    assert len(rows) == len(docs) and {i: rows[i] for i in want} == want
    assert sum(r[0] > 0 for r in rows.values()) > len(docs) // 12
