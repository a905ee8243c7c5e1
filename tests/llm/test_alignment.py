"""Cross-tokenizer alignment against plain loops."""

import functools
import hashlib
from collections import Counter, defaultdict

import helpers as H
import numpy as np
import public_tokenizers
import pytest

from landmarkflow.llm import alignment
from landmarkflow.llm.queries import QUERIES, align_params

PARAMS = align_params()


@functools.lru_cache(1)
def encoders():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(
        model_file=public_tokenizers.path("piece_bpe_32k.model"))


@functools.lru_cache(None)
def letters():
    return alignment.byte_letters()


def plain_tokens(text):
    """(id, bytes) of both sides, by the slow library; none where bytes differ."""
    if not text:
        return [], []
    a, b = encoders()
    left = [(i, bytes(letters()[c] for c in a.id_to_token(i)))
            for i in a.encode(" " + text, add_special_tokens=False).ids]
    right = []
    for i in b.encode(text):
        word = b.id_to_piece(i)
        right.append((i, bytes([int(word[3:5], 16)]) if b.is_byte(i)
                      else word.replace("▁", " ").encode()))
    raw = (" " + text).encode()
    if b"".join(x for _, x in left) != raw or b"".join(x for _, x in right) != raw:
        return [], []
    return left, right


def ends(tokens):
    out, n = [], 0
    for _, x in tokens:
        n += len(x)
        out.append(n)
    return out


def plain_groups(left, right):
    cuts = sorted(set(ends(left)) & set(ends(right)))
    out, a_end, b_end, low = [], ends(left), ends(right), 0
    for cut in cuts:
        out.append(([left[k][0] for k, e in enumerate(a_end) if low < e <= cut],
                    [right[k][0] for k, e in enumerate(b_end) if low < e <= cut]))
        low = cut
    return out


def plain_report(texts):
    """Contract columns and overlaps of each text."""
    tokens = [plain_tokens(t) for t in texts]
    groups = [plain_groups(*x) for x in tokens]
    links = [Counter((a, b) for g in gs for a in g[0] for b in g[1]) for gs in groups]
    docs = Counter(p for each in links for p in each)
    most = defaultdict(int)
    for (a, _), n in docs.items():
        most[a] = max(most[a], n)
    out = []
    for (left, right), gs, each in zip(tokens, groups, links):
        spans = [[(e - len(x), e) for (_, x), e in zip(side, ends(side))]
                 for side in (left, right)]
        overlaps = sum(max(s, u) < min(e, v) for s, e in spans[0] for u, v in spans[1])
        line = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in gs)
        out.append((len(left), len(right), len(gs), sum(each.values()), overlaps,
                    sum(n for p, n in each.items() if docs[p] == most[p[0]]),
                    sum(n * docs[p] for p, n in each.items()),
                    hashlib.sha256(line.encode()).hexdigest() if left else ""))
    return out


NAMES = ("n_a", "n_b", "n_groups", "n_links", "n_overlaps", "n_best", "count_sum",
         "groups_sha256")
TEXTS = ["the quick brown fox", "the the the quick", "", None, "<|endoftext|> <s> <unk> <0x41>",
         "a▁b", "ﬁne ½", "日本語テキスト 🙂👍🏽", "x" * 300, "  spaced   out  ", "\n\t\r\n", "a\x00b",
         "naïve café Ünïcödé", "1234567890 3.14159", "=" * 77 + "-" * 33, "the quick brown fox"]


def rows(df):
    return {r.doc_id: tuple(r[c] for c in NAMES) for r in df.collect()}


@pytest.mark.parametrize("chunk,block", [(1 << 22, 1 << 22), (60, 50)])
def test_report_equals_plain_loops(spark, monkeypatch, chunk, block):
    """Also with many small chunks and products in small blocks."""
    monkeypatch.setattr(alignment, "BLOCK", block)
    params = align_params(chunk_bytes=chunk)
    docs = H.table(spark, TEXTS).repartition(2)
    assert rows(alignment.link_report(docs, params)) == dict(enumerate(plain_report(TEXTS)))


def test_long_texts_go_through_the_slow_library(spark, monkeypatch):
    monkeypatch.setattr(alignment, "LONG_TEXT", 10)
    docs = H.table(spark, TEXTS)
    assert rows(alignment.link_report(docs, PARAMS)) == dict(enumerate(plain_report(TEXTS)))


def test_aligned_lists(spark):
    got = {r.doc_id: r for r in alignment.aligned(H.table(spark, TEXTS), PARAMS).collect()}
    for i, text in enumerate(TEXTS):
        left, right = plain_tokens(text)
        r, a_end, b_end = got[i], ends(left), ends(right)
        assert (r.a, r.b) == ([x for x, _ in left], [x for x, _ in right])
        groups = plain_groups(left, right)
        assert r.a_cut == np.cumsum([len(g[0]) for g in groups]).tolist()
        assert r.b_cut == np.cumsum([len(g[1]) for g in groups]).tolist()
        common = [(k, m, min(e, v) - max(e - len(left[k][1]), v - len(right[m][1])))
                  for k, e in enumerate(a_end) for m, v in enumerate(b_end)]
        assert list(zip(r.link_a, r.link_b, r.link_bytes)) == [x for x in common if x[2] > 0]


def test_product_equals_dense(spark):
    rng = np.random.default_rng(4)
    x, y = (rng.integers(0, 3, s) * (rng.random(s) < 0.3) for s in ((9, 7), (7, 11)))

    def rows_of(m):
        i, k = np.nonzero(m)
        return alignment.Rows.from_entries(i, k, m[i, k], *m.shape)

    got = alignment.product(rows_of(x), rows_of(y))
    dense = np.zeros((9, 11), int)
    dense[got.row_numbers(), got.columns] = got.values
    assert (dense == x @ y).all() and (got.values != 0).all()


def test_awkward_rows(spark):
    docs = H.awkward(spark, ["go " * 70_000])
    report = alignment.link_report(docs, PARAMS)
    assert report.count() == docs.count()
    got = {r.doc_id: r for r in report.collect()}
    assert got[0].n_a == 0 and got[0].groups_sha256 == "" and got[1].n_links == 0
    assert got[9].n_a > 69_000 and got[9].n_links >= got[9].n_groups > 0
    assert alignment.link_report(docs.limit(0), PARAMS).count() == 0
    assert alignment.link_report(docs.filter("text is null"), PARAMS).first().count_sum == 0
    assert alignment.aligned(docs, PARAMS).count() == docs.count()


def test_query_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("length(text) < 1500").select(
        "doc_id", "text").collect()
    got = QUERIES["op12_cross_tokenizer_alignment"](spark, sf_dir)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
                           "groups_sha256", "n_overlaps"]
    # counts over the corpus need every text; what a document has alone does not
    want = {i: w for (i, _), w in zip(docs, plain_report([t for _, t in docs]))}
    have = rows(got)
    assert {i: have[i][:5] + have[i][7:] for i in want} == {
        i: w[:5] + w[7:] for i, w in want.items()}
    small = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert rows(alignment.link_report(small, PARAMS)) == want
