"""Operators with an exact contract, against plain versions."""

import hashlib
import random
import zlib

import pytest
import helpers as H

from landmarkflow.llm import chat
from landmarkflow.llm.decontaminate import Params, clean_documents, digest, matches
from landmarkflow.llm.packing import PackParams, pack
from landmarkflow.llm.suffix_index import SuffixParams, remove_repeats

P = pytest.importorskip("public_tokenizers")


def prose(rng, n):
    return " ".join("".join(rng.choice(["an", "tion", "er", "Ou", "é", "st"])
                            for _ in range(rng.randint(1, 4))) for _ in range(n))


def corpus(seed, n=40):
    rng = random.Random(seed)
    shared = [prose(rng, 80), prose(rng, 50), "ab" * 300, "z" * 900]
    texts = []
    for i in range(n):
        parts = [prose(rng, rng.randint(0, 60)) for _ in range(3)]
        if i % 2:
            s = rng.choice(shared)
            cut = rng.randint(0, max(len(s) // 3, 1))
            parts.insert(1, s[cut:])
        texts.append("\n".join(parts))
    return texts + [texts[1], texts[3] + ".", "", None, "short"]


def test_suffix_dedup_equals_brute_force(spark):
    texts = corpus(1)
    docs = H.table(spark, texts)
    for length, batches in ((200, 4), (200, 3), (130, 1)):
        got = remove_repeats(docs, SuffixParams(length=length, batches=batches)).orderBy("doc_id")
        got = [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()]
        assert got == H.repeats(texts, length)


def test_suffix_dedup_counts_repeated_rows_and_awkward_ones(spark):
    docs = H.awkward(spark)
    rows = docs.collect()
    got = remove_repeats(docs).collect()
    want = H.repeats([r.text for r in rows], 200)
    assert sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted(want)
    assert remove_repeats(docs.limit(0)).count() == 0


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(3)
    items = [prose(rng, k) for k in (25, 12, 10, 4, 1, 0, 30)] + [None]
    texts = [prose(rng, 40) for _ in range(20)]
    for k, text in enumerate(items):
        w = (text or "").upper().split()
        texts.append(prose(rng, 5) + "-" + ", ".join(w[:11]) + " " + prose(rng, 3))
        texts.append(", ".join(w[:9]) + " different " + " ".join(w[9:]))
    texts += [texts[21], "", None, texts[0] + " " + texts[20]]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    docs = H.table(spark, texts)
    want = H.hits(texts, list(enumerate(items)))
    for block in (200_000, 5):
        got = digest(matches(docs, bench, Params(block_windows=block))).orderBy("doc_id").collect()
        assert [tuple(r)[1:] for r in got] == want
    kept = clean_documents(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, w in enumerate(want) if not w[4]]


def test_decontamination_of_awkward_rows(spark):
    docs = H.awkward(spark)
    bench = spark.createDataFrame([(None, "c d e f g h i j k l"), (2, None), (2, "one"), (2, "one")],
                                  "item_id bigint, text string")
    got = digest(matches(docs, bench)).collect()
    assert len(got) == docs.count()
    assert sum(r.contaminated for r in got) == sum(
        "one" in H.words(r.text) or "l" in H.words(r.text) for r in docs.collect())
    assert digest(matches(docs.limit(0), bench)).count() == 0
    nothing = digest(matches(docs, bench.limit(0))).collect()
    assert len(nothing) == docs.count() and not any(r.contaminated for r in nothing)
    assert clean_documents(docs, bench).columns == docs.columns


def check_packing(docs, rows, path, window=2048):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    want = [tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for t in docs]
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for i, ids in enumerate(want):
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.length > 0
            raw = b"".join(x.to_bytes(4, "little") for x in ids[at:at + r.length])
            assert r.ids_crc32 == zlib.crc32(raw)
            at += r.length
        assert at == len(ids)
    for rs in sequences.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window and at & (at - 1) == 0 or at == window


def test_packing_covers_every_id_once(spark):
    path = P.path("word_bpe_49k.json")
    rng = random.Random(4)
    texts = [prose(rng, rng.choice([3, 50, 400, 3000])) for _ in range(60)]
    texts += ["", None, "Straße ÉCOLE  \t e\u0301 \u00a0x\x1cy <|endoftext|> it's 12,5"]
    for shard in (3_000_000, 5_000):
        out = pack(H.table(spark, texts), PackParams(path, shard_tokens=shard)).collect()
        check_packing(texts, out, path)
    again = pack(H.awkward(spark), PackParams(path))
    assert again.select("doc_id").distinct().count() == 9
    assert pack(H.awkward(spark).limit(0), PackParams(path)).count() == 0


def test_packing_puts_like_documents_together(spark):
    rng = random.Random(5)
    topics = [[f"{c}{k}" for k in range(200)] for c in ("alpha", "beta", "gamma", "delta")]
    texts = [" ".join(rng.choice(topics[k % 4]) for _ in range(60)) for k in range(80)]
    rows = pack(H.table(spark, texts).coalesce(1), PackParams(P.path("word_bpe_49k.json"))).collect()
    first = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        first.setdefault(r.sequence_id, []).append(r.doc_id % 4)
    full = [v for v in first.values() if len(v) > 2]
    alike = sum(sum(x == v[0] for x in v) for v in full) / sum(map(len, full))
    assert alike > 0.6


def params():
    return chat.ChatParams(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


def test_chat_escapes_are_reversible():
    rng = random.Random(6)
    for _ in range(3000):
        text = "".join(rng.choice(["#", "##", "\\", "</turn>", "###", "a", "\n", "<", "/turn>"])
                       for _ in range(rng.randint(0, 9)))
        assert chat.unescape(chat.escape(text)) == text


def test_chat_reads_back(spark):
    rows = [(1, 1, "assistant", "ok ### </turn>"), (1, 0, "user", "héllo 😀\n"), (1, 2, None, None),
            (2, 0, "assistant", ""), (2, 1, "assistant", r"\### Assistant: </turn> ok"),
            (2, 1, "assistant", "\\"), (None, 0, "user", "x"), (3, None, "assistant", "first"),
            (3, 0, "assistant", "### "), (3, 0, "assistant", "### ")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r.conv_id: r for r in chat.digest(chat.format_chats(df, params()), params()).collect()}
    assert set(got) == {1, 2, 3, None}
    for c in got:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (
            r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or ""))
        said = "".join(r[3] or "" for r in own if r[2] == "assistant")
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        assert got[c].n_turns == len(own)
        assert got[c].turns_sha256 == hashlib.sha256(turns.encode()).hexdigest()
        assert got[c].loss_chars == len(said)
        assert got[c].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert got[c].formatted_chars == sum(
            len(chat.escape(r[2] or "")) + len(chat.escape(r[3] or ""))
            + sum(map(len, chat.MARKERS)) for r in own)
    assert chat.digest(chat.format_chats(df.limit(0), params()), params()).count() == 0


def test_chat_rendering_shows_markers(spark):
    table = chat.encoder(params())
    ids = [i for part in chat.segments("user", "a </turn>", table.encode_ordinary, params())
           for i in part]
    text = chat.render(ids, lambda x: table.decode_bytes(x).decode(), params())
    assert text == "### user:\na \\</turn>\n</turn>\n"


def test_batched_ids_equal_the_library():
    import numpy as np
    import pyarrow as pa
    from tokenizers import Tokenizer

    from landmarkflow.llm.textbytes import texts_of
    from landmarkflow.llm.wordbpe import ChunkEncoder

    path = P.path("word_bpe_49k.json")
    library, rng = Tokenizer.from_file(path), random.Random(8)
    parts = ["the", "Tion", "é", "é", "ß", "Ü", "İ", "Σ", "ς", "'", "'s", "'ve", "12", "3", ".",
             ",", "###", "<|endoftext|>", "<|", "|>", "_", " ", " ", "\x1c", "\x85", "中文",
             "😀", "ª", "²", "½", "x" * 30, "an", "ing", "\t", "\r\n", " ", " ", "\n", "ﬁ", "Å"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    texts += ["y" * 5000, "aaa" * 40 + " aaaa", ""]
    encoder = ChunkEncoder(path, slots=256, pool=20_000)  # small, so words are forgotten
    for a in range(0, len(texts), 100):
        part = texts[a:a + 100]
        ids, counts = encoder.encode(*texts_of(pa.array(part)), 1)
        cut = np.concatenate([[0], np.cumsum(counts)])
        for k, text in enumerate(part):
            want = library.encode(text, add_special_tokens=False).ids + [1]
            assert ids[cut[k]:cut[k + 1]].tolist() == want, text
