"""Plain versions of the operators, for small inputs."""

import hashlib
import re
from itertools import combinations

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def table(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en" if k % 3 else None, f"src{k % 2}" if k % 5 else None,
             None if t is None else len(t)) for k, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, SCHEMA)


def awkward(spark, more=()):
    """Nulls in every column, empty and long texts, repeated rows, clashing names."""
    texts = ["", None, "one", "a b c d e f g h i j k l", "x" * 40_000, "word " * 9000,
             "a b c d e f g h i j k l", "\n\n \t\n", "é\u2028ß \x1c # | 😀", *more]
    docs = table(spark, texts, [0, 1, 2, None, 4, 5, 3, 7, 8, *range(9, 9 + len(more))])
    docs = docs.unionByName(docs.filter("doc_id in (2, 3, 5)"))
    for name in ("k1", "g1", "key", "n", "start", "_t", "kept", "score", "n_words", "set_id"):
        docs = docs.selectExpr("*", f"'clash' as {name}")
    return docs


def repeats(texts, length):
    """Which bytes are covered by a string that starts twice."""
    data = [(t or "").encode() for t in texts]
    seen = {}
    for d in data:
        for i in range(len(d) - length + 1):
            s = d[i:i + length]
            seen[s] = seen.get(s, 0) + 1
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(d, gone) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def hits(texts, items, n=10):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(len(w) - n, 0) + 1 if w else 0):
            windows.setdefault(tuple(w[i:i + n]), set()).add(str(item))
    out = []
    for text in texts:
        w, hit, found = words(text), set(), set()
        for size in {len(k) for k in windows}:
            for i in range(len(w) - size + 1):
                got = windows.get(tuple(w[i:i + size]))
                if got:
                    found |= got
                    hit |= set(range(i, i + size))
        out.append((len(w), len(hit), len(found),
                    hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def classes(sets, similarity=(4, 5)):
    """Smallest index of each class and the number of different linked sets."""
    distinct = sorted({s for s in sets if s}, key=sorted)
    root = {s: s for s in distinct}

    def find(s):
        while root[s] is not s:
            s = root[s]
        return s

    links = dict.fromkeys(distinct, 0)
    for a, b in combinations(distinct, 2):
        both = len(a & b)
        if both * similarity[1] >= (len(a) + len(b) - both) * similarity[0]:
            links[a], links[b] = links[a] + 1, links[b] + 1
            root[find(a)] = find(b)
    first = {}
    for i, s in enumerate(sets):
        if s:
            first.setdefault(find(s), i)
    return [(first[find(s)], links[s]) if s else (i, 0) for i, s in enumerate(sets)]


def shingles(text, n=5):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + n]) for i in range(max(len(w) - n, 0) + 1))
