"""Quality operators, secrets and URL rules."""

import itertools
import math
import random
import re
from collections import Counter

import helpers as H
import pytest
from pyspark.sql import functions as F

from landmarkflow.llm import secrets, url_rules
from landmarkflow.llm.quality_classifier import (FEATURES, filter_documents, fit_quality,
                                                 held_out, score_statistics, tree_paths)
from landmarkflow.llm.quality_rules import judge
from landmarkflow.llm.queries import QUERIES
from landmarkflow.llm.statistics import text_statistics
from test_exact import corpus, prose


def brute_statistics(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = {}
    for i in range(len(w) - 4):
        grams.setdefault(tuple(w[i:i + 5]), []).append(i)
    covered = {i + k for at in grams.values() if len(at) > 1 for i in at for k in range(5)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)),
            len(lines) - len(set(lines)), len(covered))


def test_statistics_equal_brute_force(spark):
    rng = random.Random(2)
    texts = corpus(7) + ["a b c d e " * 3, "x\x1cy\x85z", "#|<>*&$% é😀\r\n\r\nA\n\nA\n A"]
    texts += ["\n".join(rng.choice(["a b", "c", "", " ", "d e f g h i"]) for _ in range(12))
              for _ in range(20)]
    rows = text_statistics(H.table(spark, texts)).orderBy("doc_id").collect()
    assert [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
            for r in rows] == [brute_statistics(t) for t in texts]
    assert [r.n_distinct_words for r in rows] == [
        len(set(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for t in texts]


def test_quality_rules(spark):
    rng = random.Random(1)
    texts = [prose(rng, rng.randint(30, 300)) + "." for _ in range(500)]
    junk = [re.sub(" ", "### ", prose(rng, 200)) for _ in range(10)]
    docs = H.table(spark, texts + junk + ["few words", "a b c d e f g h i j " * 5, None])
    got = {r.doc_id: r for r in judge(docs).collect()}
    assert len(got) == 513
    assert all(got[i].kept for i in range(500))
    assert not any(got[i].kept for i in range(500, 513))
    assert [got[i].base_failed for i in (500, 510, 511, 512)] == [False, True, True, True]
    awkward = H.awkward(spark)
    assert judge(awkward).count() == awkward.count()
    assert judge(awkward.limit(0)).count() == 0


def test_quality_rules_on_labelled_rows(spark, sf_dir):
    """Outliers that are not gross go too, and clean documents stay."""
    folder = sf_dir.replace("sf0.001", "sf0.01")
    rows = judge(spark.read.parquet(f"{folder}/documents.parquet")).join(
        spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").filter("not base_failed").collect()
    junk, clean = ([r.kept for r in rows if r.quality == q] for q in (0, 1))
    assert len(junk) >= 20 and sum(junk) / len(junk) < 0.2
    assert len(clean) >= 200 and sum(clean) / len(clean) > 0.99


def test_classifier_accuracy_on_held_out_rows(spark, sf_dir):
    out = QUERIES["op9_quality_classifier"](spark, sf_dir.replace("sf0.001", "sf0.01"))
    labels = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/labels.parquet")
    rows = out.join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert held and sum(r.predicted == r.quality for r in held) / len(held) >= 0.93
    assert all(0 <= r.score <= 1 for r in rows)
    assert all(r.predicted for r in held if r.quality == 1)


def test_classifier_edges(spark):
    docs = H.awkward(spark)
    labels = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (None, 1, 1), (3, None, 0), (2, 1, 0)],
                                   "doc_id bigint, quality int, toxic int")
    model = fit_quality(text_statistics(docs), labels)
    scored = score_statistics(text_statistics(docs), model)
    assert scored.count() == docs.count()
    assert scored.filter("score is null or score < 0 or score > 1").count() == 0
    none = fit_quality(text_statistics(docs), labels.limit(0))
    assert none.rules == () and none.intercept == 0
    assert filter_documents(docs, labels).columns == docs.columns
    assert filter_documents(docs.limit(0), labels).count() == 0
    ids = spark.createDataFrame([(10,), (11,), (None,)], "doc_id bigint")
    import zlib

    assert [r[0] for r in ids.select(held_out(F.col("doc_id"))).collect()] == [
        zlib.crc32(b"10") % 5 == 0, zlib.crc32(b"11") % 5 == 0, False]


def test_tree_paths_are_tightened():
    text = """RandomForest
  Tree 0 (weight 1.0):
    If (feature 0 <= 0.5)
     If (feature 0 <= 0.25)
      Predict: 0.0
     Else (feature 0 > 0.25)
      Predict: 1.0
    Else (feature 0 > 0.5)
     Predict: 1.0
"""
    assert tree_paths(text, list(FEATURES)) == [
        (("words", False, 0.25),), (("words", False, 0.5),),
        (("words", False, 0.5), ("words", True, 0.25)), (("words", True, 0.5),)]


def test_secret_candidates_and_forest(spark):
    rng = random.Random(9)
    texts, truth = [], set()
    for i in range(300):
        key = "".join(rng.choice("0123456789abcdef") for _ in range(40))
        kind = i % 3
        middle = (f'token = "{key}"' if kind == 0 else str(rng.randint(10**15, 10**16 - 1))
                  if kind == 1 else f"mail.user99.{rng.randint(10**9, 10**10)}xyz@mail.example.com")
        texts.append(f"{prose(rng, 20)} {middle} {prose(rng, 20)}")
        if kind == 0:
            truth.add((i, texts[-1].index(key)))
    docs = H.table(spark, texts)
    words = secrets.dictionary(docs)
    found = secrets.describe(secrets.candidates(docs), words)
    model = secrets.fit_forest(secrets.seed_labels(found))
    out = secrets.score(found, model).filter("is_secret").collect()
    assert {(r.doc_id, r.start) for r in out} == truth
    assert all(texts[r.doc_id][r.start:].startswith(r.candidate) for r in out)


def test_secret_edges(spark):
    docs = H.awkward(spark, ["1" * 50_000, "a1" * 9 + " " + "b2" * 9])
    found = secrets.describe(secrets.candidates(docs), [])
    assert {(r.start, len(r.candidate)) for r in found.collect()} == {(0, 50_000), (0, 18), (19, 18)}
    assert secrets.fit_forest(secrets.seed_labels(found)) is None
    assert secrets.score(found, None).filter("is_secret").count() == found.count()
    assert secrets.candidates(docs.limit(0)).count() == 0


def brute_url(url, rules=url_rules.LISTED):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group().translate(H.LOWER)
        path = re.match(r"[^?#]*", rest[len(host):]).group()
    fits = [r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    best = max(fits, key=lambda r: len(r[1] + r[2]), default=None)
    return host, path, best and best[1] + best[2], best and best[0]


URLS = ["http://a.Example.NET/en/1", "https://example.net/en", "https://x.net", "ftp://net/",
        "http://notnet/", "http://é.example.com/de/x?y=/#z", "http://org/fr/", "http://b.org/fr",
        "no scheme.net/", "", None, "http://h?q=://net/", "a://b://c.net/x", "http://a.net#/en/",
        "://net/", "http://example.com/de", "http://EXAMPLE.COM/de/\nx", "x" * 20_000 + "://net/"]


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(None, URLS[0]), (3, URLS[0])]
    for k in range(200):
        rows.append((100 + k, f"http://site{k % 40}.example.org/{'casino' if k % 4 == 0 else 'news'}"
                              f"/{'bonus' if k % 2 == 0 else 'page'}/{k}"))
    return spark.createDataFrame(rows, "page_id bigint, url string").withColumn("host", F.lit("clash"))


def test_listed_url_rules_equal_brute_force(spark, pages):
    labelled = pages.select("url", F.lit(None).cast("boolean").alias("block"))
    rows = url_rules.judge_urls(pages, labelled).collect()
    given = {}
    for r in pages.collect():
        given.setdefault(r.page_id, []).append(brute_url(r.url))
    assert len(rows) == pages.count()
    for r in rows:
        assert (r.host, r.path, r.rule, r.verdict) in [(*b[:3], b[3] or "allow")
                                                       for b in given[r.page_id]]


def test_mined_url_rules(spark, pages):
    labelled = pages.filter("page_id >= 100").select(
        "url", F.col("url").contains("casino").alias("block"))
    rules = {tuple(r["items"]): r for r in url_rules.mine_rules(labelled).collect()}
    assert ("p:casino",) in rules and rules[("p:casino",)].confidence == 1.0
    assert not any("p:news" in k for k in rules)
    out = url_rules.judge_urls(pages, labelled).filter("page_id >= 100").collect()
    assert all((r.verdict == "block") == ("casino" in r.path) for r in out)
    assert url_rules.judge_urls(pages.limit(0), labelled.limit(0)).count() == 0


def brute_rules(rows, params):
    """All combinations of tokens, tested and pruned one by one."""
    rows = [(frozenset(t), b) for t, b in rows if t or b]
    n, base = len(rows), sum(b for _, b in rows) / len(rows)
    least = max(params.min_support, params.min_urls / n) * n - 1e-9
    met, hit = Counter(), Counter()
    for items, block in rows:
        for k in range(1, params.max_tokens + 1):
            for combo in itertools.combinations(sorted(items), k):
                met[combo] += 1
                hit[combo] += block
    limit = math.log(sum(v >= least for v in met.values()) / params.error)
    good = {}
    for combo, m in met.items():
        h = hit[combo]
        c = h / m
        fits = h >= least and c >= params.min_confidence and c > base
        if fits and m * (c * math.log(c / base) + (
                (1 - c) * math.log((1 - c) / (1 - base)) if c < 1 else 0)) >= limit:
            good[combo] = h / m
    return {c: v for c, v in good.items()
            if not any(set(o) < set(c) and good[o] >= v for o in good)}


def test_mining_and_pruning_equal_brute_force(spark):
    rnd = random.Random(4)
    urls = [f"http://{rnd.choice('ab')}.{rnd.choice(['net', 'org'])}/{rnd.choice('xyz')}"
            f"/{rnd.choice('uvw')}/{rnd.choice('rs')}" for _ in range(600)]
    odds = [0.95 if "/x/" in u and "a.org" in u else 0.85 if "/y/u" in u else 0.1 for u in urls]
    rows = [(u, rnd.random() < o) for u, o in zip(urls, odds)]
    labelled = spark.createDataFrame(rows, "url string, block boolean")
    tokened = labelled.select(url_rules.tokens(F.col("url")).alias("t"), "block").collect()
    for params in (url_rules.UrlParams(), url_rules.UrlParams(min_urls=3, min_confidence=0.5)):
        got = {tuple(r["items"]): r["confidence"]
               for r in url_rules.mine_rules(labelled, params).collect()}
        want = brute_rules([(r["t"], r["block"]) for r in tokened], params)
        assert len(want) >= 2 and got == pytest.approx(want)


def test_labels_of_chance_give_no_rule(spark):
    for seed, share in ((1, 0.3), (2, 0.7), (3, 0.02)):
        rnd = random.Random(seed)
        rows = [(f"http://s{rnd.randrange(30)}.net/{rnd.choice('abc')}/{rnd.choice('xyz')}",
                 rnd.random() < share) for _ in range(1500)]
        labelled = spark.createDataFrame(rows, "url string, block boolean")
        loose = url_rules.UrlParams(min_support=0.0, min_urls=1, min_confidence=0.6)
        assert url_rules.mine_rules(labelled).count() == 0
        assert url_rules.mine_rules(labelled, loose).count() == 0
    # too few URLs for any rule, and labels all alike
    few = labelled.limit(5)
    assert url_rules.mine_rules(few).count() == 0
    assert url_rules.mine_rules(labelled.withColumn("block", F.lit(True))).count() == 0
