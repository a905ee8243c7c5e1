"""Bottom-k fingerprints against exact sets of shingles."""

import hashlib
import random

import helpers as H
import pytest
from pyspark.sql import functions as F

from landmarkflow.llm import fingerprints as P
from landmarkflow.llm.queries import QUERIES


def shingles(text):
    return H.shingles((text or "").lower())


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(text, follower):
    text, follower = text or "", follower or ""
    half = len(text) // 2
    return text[:len(text) - half] + follower[:half]


def texts(n, seed=1):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8))) for _ in range(400)]
    out = []
    for k in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 3, 5, 40, 400, 900]))]
        out.append(rng.choice(out) if k % 9 == 8 else " ".join(words).capitalize() + ".")
    return out


def report(df):
    return {r.doc_id: r for r in df.collect()}


def test_report_equals_exact_sets(spark):
    """Exact below k shingles, within the error of the estimate above."""
    every = texts(120) + ["", None, "éà ß 日本", "one two three four five six"]
    order = random.Random(5).sample(range(-40, 400), len(every))
    docs = H.table(spark, every, order).repartition(3)
    got = report(P.edited_report(docs))
    assert len(got) == len(every)
    ids = sorted(order)
    text_of = dict(zip(order, every))
    prints = {}
    for i, follower in zip(ids, ids[1:] + ids[:1]):
        text, new = text_of[i] or "", edited(text_of[i], text_of[follower])
        r, own, other, after = got[i], shingles(text), shingles(new), shingles(text_of[follower])
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert prints.setdefault(r.fingerprint, text.lower().strip(".")) == text.lower().strip(".")
        for estimate, x, y in ((r.near_edited, own, other), (r.near_next, own, after)):
            exact = likeness(x, y)
            if len(x | y) < 128:
                assert estimate == exact
            assert abs(estimate - exact) < 0.2
        if len(own) < 128:
            assert r.n_shingles == len(own)
        assert abs(r.n_shingles - len(own)) <= 0.4 * len(own)
        if own and len(own | other) < 128:
            assert r.kept_share == pytest.approx(len(own & other) / len(own))


def test_equal_texts_have_equal_prints(spark):
    docs = H.table(spark, ["Some text of more than five words", "some text of more than five WORDS",
                           "other", "Some text of more than five words"])
    got = report(P.edited_report(docs))
    assert got[0].fingerprint == got[3].fingerprint == got[1].fingerprint != got[2].fingerprint


def test_merging_parts_equals_the_whole(spark):
    """Any cut into parts gives the prints of all shingles, with many and repeated parts."""
    rng = random.Random(9)
    params = P.PrintParams(k=16, fan_in=4)
    rows, whole = [], {}
    for key in ("a", "b", None):
        for _ in range(90 if key == "a" else 3):
            text = " ".join(str(rng.randint(0, 60)) for _ in range(rng.choice([0, 3, 30])))
            rows += [(key, text)] * rng.choice([1, 1, 4])
    df = spark.createDataFrame(rows, "key string, text string")
    parts = P.fingerprints(df, params, keep=("key",))
    for key, text in rows:
        whole.setdefault(key, set()).update(shingles(text))
    single = spark.createDataFrame([(k, " ".join(s)) for k, v in whole.items() for s in v],
                                   "key string, text string")
    each = P.fingerprints(single, params, keep=("key",)).select(
        "key", F.explode("prints").alias("h"))
    want = {}
    for r in each.collect():
        want.setdefault(r.key, set()).add(r.h)
    got = {r.key: r.prints for r in P.merge_parts(parts, ["key"], params).collect()}
    assert got == {k: sorted(v)[:16] for k, v in want.items()}
    assert P.merge_parts(parts.limit(0), ["key"], params).count() == 0


def test_strings_read_back(spark):
    docs = P.fingerprints(H.table(spark, [*texts(10), None]))
    back = docs.select("prints", P.read(P.shown("prints")).alias("again")).collect()
    assert all(r.prints == r.again for r in back) and any(len(r.prints) == 128 for r in back)


def test_order_with_ties_nulls_and_other_types(spark):
    """Ties of ids go by text, null ids come first, strings sort as strings."""
    rows = [(None, "first text here"), (None, None), (5, "b b b b"), (5, "a a a a"),
            (5, "a a a a"), (2, "zz"), (9, "last one")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    pairs = [(r.doc_id, r.text, r.next_text) for r in P.with_next(docs).collect()]
    assert sorted(map(repr, ((i, t) for i, t, _ in pairs))) == sorted(map(repr, rows))
    chain = {(i, t): n for i, t, n in pairs if i in (2, 9)}
    first = {t for i, t in rows if i is None}
    assert chain[(9, "last one")] in first and chain[(2, "zz")] in {"b b b b", "a a a a"}
    named = docs.withColumn("doc_id", F.col("doc_id").cast("string"))
    assert P.edited_report(named).count() == len(rows)
    alone = P.with_next(docs.filter("doc_id = 9")).first()
    assert alone.next_text == "last one"


def test_awkward_rows(spark):
    docs = H.awkward(spark, ["word another " * 40_000])
    got = P.edited_report(docs)
    assert got.count() == docs.count()
    assert {r.n_chars for r in got.filter("doc_id in (0, 1)").collect()} == {0}
    assert P.edited_report(docs.limit(0)).count() == 0
    empty = P.edited_report(docs.filter("text is null or text = ''")).collect()
    assert {(r.near_edited, r.near_next, r.fingerprint) for r in empty} == {(1.0, 1.0, "")}


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    df = QUERIES["op11_document_fingerprints"](spark, sf_dir)
    assert df.columns[:7] == ["doc_id", "n_chars", "edited_sha256", "fingerprint",
                              "edited_fingerprint", "near_edited", "near_next"]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
    got, errors = report(df), []
    for r, n in zip(docs, docs[1:] + docs[:1]):
        new = edited(r.text, n.text)
        assert got[r.doc_id].edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        errors.append(abs(got[r.doc_id].near_edited - likeness(shingles(r.text), shingles(new))))
        errors.append(abs(got[r.doc_id].near_next - likeness(shingles(r.text), shingles(n.text))))
    assert max(errors) < 0.2 and sum(errors) / len(errors) < 0.03
