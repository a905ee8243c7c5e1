"""Near-duplicate operators against all-pairs versions."""

import random

import helpers as H
from pyspark.sql import functions as F

from landmarkflow.llm import line_dedup
from landmarkflow.llm.components import connected
from landmarkflow.llm.jaccard_join import JoinParams, join_documents, one_of_each
from landmarkflow.llm.line_dedup import LineParams, clean_lines, dedup_lines
from landmarkflow.llm.setpairs import intersections
from landmarkflow.sources.tables import run_folder
from test_exact import prose


def near_copies(rng, base, n, share):
    out = []
    for _ in range(n):
        w = base.split(" ")
        for k in range(len(w)):
            if rng.random() < share:
                w[k] = prose(rng, 1)
        out.append(" ".join(w))
    return out


def near_corpus(seed):
    rng = random.Random(seed)
    texts = [prose(rng, rng.randint(1, 120)) for _ in range(50)]
    for k in range(6):
        texts += near_copies(rng, prose(rng, rng.randint(40, 200)), 8, 0.004 * (k + 1))
    line = prose(rng, 30)
    texts += [line + " " + prose(rng, 40) for _ in range(30)]
    texts += [texts[0], texts[0].upper(), texts[55], "", None, "a b", "a  B!"]
    rng.shuffle(texts)
    return texts


def test_intersections():
    import numpy as np

    rng = random.Random(0)
    sets = [np.array(sorted(rng.sample(range(60), rng.randint(0, 30))), np.int64) for _ in range(20)]
    got = intersections(sets)
    assert all(got[i, j] == len(set(sets[i].tolist()) & set(sets[j].tolist()))
               for i in range(20) for j in range(20))
    assert (intersections(sets[:7], sets[7:]) == got[:7, 7:]).all()


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 120)] + [(7, 7), (3, 2)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    got = {r.node: r.root for r in connected(df, "c", run_folder(spark)).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{k: 100 for k in range(100, 120)}}
    assert connected(df.limit(0), "c", run_folder(spark)).count() == 0


def test_jaccard_join_equals_brute_force(spark):
    for seed in (1, 2):
        texts = near_corpus(seed)
        want = H.classes([H.shingles(t) for t in texts])
        # A tiny bucket limit drives the paths deep and the star rule.
        for params in (JoinParams(), JoinParams(bucket=4, depth=3)):
            got = {r.doc_id: (r.class_id, r.n_links)
                   for r in join_documents(H.table(spark, texts), params).collect()}
            assert [got[i] for i in range(len(texts))] == want
        kept = one_of_each(H.table(spark, texts))
        assert sorted(r.doc_id for r in kept.collect()) == sorted(
            {c for c, _ in want})


def test_jaccard_join_in_several_blocks(spark):
    import numpy as np

    from landmarkflow.llm.setpairs import deal, verify

    rng = random.Random(3)
    base = list(range(100))
    rows = [(1, k, " ".join(map(str, rng.sample(base, 95)))) for k in range(60)]
    members = spark.createDataFrame(rows + [(2, 99, "1"), (2, 98, "2"), (3, 97, "1")],
                                    "grp bigint, node bigint, body string")

    def sets_of(column):
        return [np.unique(np.array(x.split(), np.int64)) for x in column.to_pylist()]

    whole, parts = (verify(deal(members, block), (4, 5), sets_of) for block in (1024, 9))
    sums = [{r.a: r.n for r in x.filter("b is null").groupBy("a").agg(F.sum("links").alias("n"))
             .collect()} for x in (whole, parts)]
    assert sums[0] == sums[1] and len(sums[0]) == 60


def test_jaccard_join_of_awkward_rows(spark):
    docs = H.awkward(spark)
    got = join_documents(docs).collect()
    assert len(got) == docs.count()
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    texts = [r.text for r in kept.collect()]
    assert texts.count("a b c d e f g h i j k l") == 1 and texts.count("one") == 1
    assert join_documents(docs.limit(0)).count() == 0
    assert one_of_each(docs.limit(0)).count() == 0


def brute_lines(texts, params):
    low = [[x.translate(H.LOWER).strip("\t\n\x0b\x0c\r ") for x in (t or "").split("\n")]
           for t in texts]
    judged = [(d, k) for d, lines in enumerate(low) for k, x in enumerate(lines)
              if x]
    sets = []
    for d, k in judged:
        raw = low[d][k].encode()
        sets.append(frozenset(raw[i:i + params.chars] for i in range(len(raw) - params.chars + 1))
                    or frozenset([raw]))
    first = H.classes(sets, params.similarity)
    gone = {judged[i] for i, (c, _) in enumerate(first) if c != i}
    return ["\n".join(x for k, x in enumerate((t or "").split("\n")) if (d, k) not in gone)
            for d, t in enumerate(texts)]


def test_line_dedup_equals_brute_force(spark):
    for seed in (1, 2):
        rng = random.Random(seed)
        pool = [prose(rng, rng.randint(4, 60)) for _ in range(30)]
        texts = []
        for _ in range(60):
            lines = [prose(rng, rng.randint(0, 40)) for _ in range(rng.randint(0, 4))]
            for _ in range(rng.randint(0, 3)):
                lines.append(near_copies(rng, rng.choice(pool), 1, rng.choice([0, 0.01, 0.05]))[0])
            rng.shuffle(lines)
            texts.append("\n".join(lines))
        texts += ["  " + pool[0].upper() + "\t", "", None, pool[1] + "\n" + pool[1]]
        docs = H.table(spark, texts)
        for params in (LineParams(), LineParams(bucket=2)):
            got = {r.doc_id: r.text or "" for r in dedup_lines(docs, params).collect()}
            want = brute_lines(texts, params)
            assert sum(got[i] == want[i] for i in range(len(texts))) >= len(texts) - 1


def test_band_keys_are_short_and_bands_go_in_turns(spark, monkeypatch):
    rng = random.Random(5)
    base = prose(rng, 30)
    texts = ["\n".join(near_copies(rng, base, 3, 0.02)) for _ in range(20)]
    docs = H.table(spark, texts).selectExpr("doc_id g1", "0 g2", "text body")
    names, whole = [], line_dedup.written
    monkeypatch.setattr(line_dedup, "written", lambda df, name, folder: (
        names.append(name), whole(df, name, folder))[1])
    lines = line_dedup.sketch_lines(docs, LineParams())
    assert dict(lines.dtypes)["bands"] == "array<int>"
    edges = line_dedup.bucket_edges(lines, LineParams(), run_folder(spark)).collect()
    ids = {r.line_id for r in lines.collect()}
    assert len(names) == 2 and edges and {x for e in edges for x in e} <= ids


def test_line_dedup_judges_short_lines(spark):
    texts = ["Home\nx\n\n3 of 4", "  HOME\n\nread more here", "home \nread more here\nhome page",
             "X\n3 of 4\n3 of 5\n \n", "aaaaaaaa\naaaaaaaaa\naaaaaaa", "read our terms, 2024\nx y",
             "read our terms, 2024.\nread no terms, 1999"]
    got = [r.text for r in dedup_lines(H.table(spark, texts)).orderBy("doc_id").collect()]
    assert got == ["Home\nx\n\n3 of 4", "\nread more here", "home page", "3 of 5\n \n",
                   "aaaaaaaa\naaaaaaa", "read our terms, 2024\nx y", "read no terms, 1999"]


def test_short_lines_equal_brute_force(spark):
    rng = random.Random(5)
    pool = ["".join(rng.choice("abcd efgh") for _ in range(rng.randint(1, 30))) for _ in range(80)]
    texts = ["\n".join(x + rng.choice(["", "", ".", "xy"]) for x in rng.sample(pool, 5))
             for _ in range(60)]
    low = [[x.strip(" ") for x in t.split("\n")] for t in texts]
    flat = [(d, k, x) for d, lines in enumerate(low) for k, x in enumerate(lines)]
    first = H.classes([frozenset(x[i:i + 8] for i in range(len(x) - 7)) or
                       (frozenset([x]) if x else frozenset()) for _, _, x in flat])
    gone = {flat[i][:2] for i, (c, _) in enumerate(first) if c != i}
    want = ["\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) not in gone)
            for d, t in enumerate(texts)]
    got = [r.text for r in dedup_lines(H.table(spark, texts)).orderBy("doc_id").collect()]
    assert sum(len(w.split("\n")) < 5 for w in want) > 30
    assert sum(g == w for g, w in zip(got, want)) >= len(texts) - 1


def test_line_dedup_of_awkward_rows(spark):
    docs = H.awkward(spark)
    got = dedup_lines(docs).collect()
    assert len(got) == docs.count()
    assert {r.text for r in got if r.doc_id == 1} == {None}
    kept = clean_lines(docs)
    assert kept.columns == docs.columns
    assert all(r.n_chars == len(r.text) for r in kept.collect() if r.text is not None)
    assert dedup_lines(docs.limit(0)).count() == 0
