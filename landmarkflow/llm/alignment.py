"""Alignment of two tokenizers over the bytes they share.

Both token sequences of a text cover the same bytes. As sparse 0/1 matrices of tokens by
bytes, A and B in compressed rows, the product A·Bᵀ holds the bytes every pair of tokens
has in common: the overlap links. The bytes where tokens of both sides end cut a text
into groups, and products of the incidence of groups and token ids give the links of all
A tokens with all B tokens of a group. Products go row by row (Gustavson): a row of the
first matrix picks rows of the second, which are merged.

How many documents hold an id pair linked is a count over the corpus. Documents are
aligned in chunks; a chunk names its distinct groups and pairs once, so what is shuffled
to count pairs and to bring the counts back are a chunk's distinct pairs, not the pairs
of its documents.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from landmarkflow.llm.steps import run_folder, written
from landmarkflow.llm.textbytes import chunks, mix

#: Entries a product spells out at a time.
BLOCK = 1 << 18
#: Longer texts go through the tokenizer's own library: the look-ahead of the word
#: pattern overflows the faster one's stack on white space of about a million characters.
LONG_TEXT = 200_000


@dataclass(frozen=True)
class AlignParams:
    """``a`` is a byte-level BPE file (json), ``b`` a piece model that puts a space in front.

    ``pattern`` is the word pattern of ``a``; a chunk has about ``chunk_bytes`` of text
    (a longer text is a chunk of its own).
    """

    a: str
    b: str
    pattern: str
    chunk_bytes: int = 1 << 21


def byte_letters() -> dict:
    """Letter of each byte in a byte-level vocabulary: printable ones stand for
    themselves, the others for the letters from 256 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [i for i in range(256) if i not in shown]
    return {chr(i): i for i in shown} | {chr(256 + k): i for k, i in enumerate(hidden)}


def pieces(params: AlignParams):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=params.b)


class Tokenizers:
    """Both encoders and the bytes of every id."""

    def __init__(self, params: AlignParams):
        import tiktoken

        with open(params.a, encoding="utf-8") as f:
            spec = json.load(f)
        special = {x["id"] for x in spec["added_tokens"]}
        letters = byte_letters()
        plain = {i: bytes(letters[c] for c in word) for word, i in spec["model"]["vocab"].items()
                 if i not in special}
        self.a_bytes = [plain.get(i, b"") for i in range(max(plain) + 1)]
        self.fast = tiktoken.Encoding("a", pat_str=params.pattern, special_tokens={},
                                      mergeable_ranks={w: i for i, w in plain.items()})
        self.params, self._slow = params, None
        self.pieces = pieces(params)
        self.b_bytes = [
            bytes([int(word[3:5], 16)]) if self.pieces.is_byte(i)
            else word.replace("▁", " ").encode()
            for i, word in ((i, self.pieces.id_to_piece(i))
                            for i in range(self.pieces.get_piece_size()))]
        self.a_sizes = np.array([len(x) for x in self.a_bytes])
        self.b_sizes = np.array([len(x) for x in self.b_bytes])
        # what stands behind an id in the written groups
        self.shown = [b"%d%c" % (i, c) for sizes, ends in ((self.a_bytes, b",|"),
                                                          (self.b_bytes, b",;"))
                      for i in range(len(sizes)) for c in ends]

    @property
    def slow(self):
        if self._slow is None:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_file(self.params.a)
            self._slow.encode_special_tokens = True
        return self._slow

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both sides, or None where either does not give back the text."""
        if not text:
            return None
        full = " " + text
        if len(full) > LONG_TEXT:
            a = np.array(self.slow.encode(full, add_special_tokens=False).ids, np.int64)
        else:
            a = self.fast.encode_to_numpy(full, disallowed_special=()).astype(np.int64)
        b = np.asarray(self.pieces.encode_as_ids(text), np.int64)
        raw = full.encode()
        if (b"".join(map(self.a_bytes.__getitem__, a.tolist())) != raw
                or b"".join(map(self.b_bytes.__getitem__, b.tolist())) != raw):
            return None
        return a, b


@dataclass
class Rows:
    """A sparse matrix in compressed rows: row ``i`` holds ``at[i]:at[i + 1]``."""

    at: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    width: int

    @staticmethod
    def from_entries(row, column, value, height: int, width: int) -> "Rows":
        """From entries sorted by row."""
        return Rows(np.searchsorted(row, np.arange(height + 1)), column, value, width)

    def row_numbers(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))


def product(x: Rows, y: Rows) -> Rows:
    """``x y`` row by row: every entry of a row of ``x`` picks a row of ``y``; picked
    entries of one column are added up. A block of rows is worked off at a time."""
    picked = np.diff(y.at)[x.columns]
    work = np.r_[0, np.cumsum(picked)][x.at]
    height, low, parts = len(x.at) - 1, 0, []
    while low < height:
        high = max(low + 1, int(np.searchsorted(work, work[low] + BLOCK, "right")) - 1)
        part = slice(x.at[low], x.at[high])
        n, columns = picked[part], x.columns[part]
        offset = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        place = np.repeat(y.at[columns], n) + offset
        row = np.repeat(np.repeat(np.arange(low, high), np.diff(x.at[low:high + 1])), n)
        key = row * y.width + y.columns[place]
        value = np.repeat(x.values[part], n) * y.values[place]
        if (key[1:] < key[:-1]).any():
            order = np.argsort(key, kind="stable")
            key, value = key[order], value[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][:len(key)])
        parts.append((key[first], np.add.reduceat(value, first) if len(first) else value))
        low = high
    key = np.concatenate([p[0] for p in parts] or [np.zeros(0, np.int64)])
    value = np.concatenate([p[1] for p in parts] or [np.zeros(0, np.int64)])
    return Rows.from_entries(key // y.width, key % y.width, value, height, y.width)


def token_bytes(ends: np.ndarray) -> Rows:
    """Tokens by bytes, from the byte each token ends before."""
    n = int(ends[-1]) if len(ends) else 0
    return Rows(np.r_[0, ends], np.arange(n), np.ones(n, np.int64), n)


def byte_tokens(ends: np.ndarray) -> Rows:
    """The transpose of :func:`token_bytes`: each byte is in one token."""
    n = int(ends[-1]) if len(ends) else 0
    return Rows(np.arange(n + 1), np.repeat(np.arange(len(ends)), np.diff(np.r_[0, ends])),
                np.ones(n, np.int64), len(ends))


class Chunk:
    """Alignment of some texts laid end to end; ``None`` stands for a text without tokens."""

    def __init__(self, encoded: list, tools: Tokenizers):
        self.n, self.tools = len(encoded), tools
        none = np.zeros(0, np.int64)
        sides = [x or (none, none) for x in encoded]
        self.a, self.b = (np.concatenate([none, *[x[k] for x in sides]]) for k in (0, 1))
        self.a_at, self.b_at = (np.r_[0, np.cumsum([len(x[k]) for x in sides])].astype(np.int64)
                                for k in (0, 1))
        self.a_end, self.b_end = np.cumsum(tools.a_sizes[self.a]), np.cumsum(tools.b_sizes[self.b])
        cuts = np.intersect1d(self.a_end, self.b_end, assume_unique=True)
        # tokens before each group
        self.a_cut = np.r_[0, np.searchsorted(self.a_end, cuts) + 1]
        self.b_cut = np.r_[0, np.searchsorted(self.b_end, cuts) + 1]
        self.group_at = np.searchsorted(self.a_cut, self.a_at)

    def per_text(self, at: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Sums of ``values`` over each text's part ``at[i]:at[i + 1]``."""
        total = np.r_[0, np.cumsum(values)]
        return total[at[1:]] - total[at[:-1]]

    def overlaps(self) -> Rows:
        """A tokens by B tokens: bytes in common."""
        return product(token_bytes(self.a_end), byte_tokens(self.b_end))

    def group_strings(self) -> list[str]:
        """Per text the digest of its groups, ``a1,a2|b1;a3|b2``; '' without tokens."""
        groups, base = len(self.a_cut) - 1, 2 * len(self.tools.a_sizes)
        a_group = np.repeat(np.arange(groups), np.diff(self.a_cut))
        b_group = np.repeat(np.arange(groups), np.diff(self.b_cut))
        code = np.empty(len(self.a) + len(self.b), np.int64)
        a_code, b_code = 2 * self.a, base + 2 * self.b
        a_code[self.a_cut[1:] - 1] += 1
        b_code[self.b_cut[1:] - 1] += 1
        code[np.arange(len(self.a)) + self.b_cut[a_group]] = a_code
        code[np.arange(len(self.b)) + self.a_cut[b_group + 1]] = b_code
        at, shown = (self.a_at + self.b_at).tolist(), self.tools.shown
        return [hashlib.sha256(b"".join(map(shown.__getitem__, code[i:j].tolist()))[:-1])
                .hexdigest() if j > i else "" for i, j in zip(at[:-1], at[1:])]

    def distinct_groups(self) -> tuple[np.ndarray, np.ndarray]:
        """Number of each group among the different ones, and one place of each of these.

        Groups are compared by a 64-bit hash of their ids in order.
        """
        hashes = np.zeros(len(self.a_cut) - 1, np.uint64)
        for ids, cut, side in ((self.a, self.a_cut, 0), (self.b, self.b_cut, 1)):
            if not len(hashes):
                break
            place = np.arange(len(ids)) - np.repeat(cut[:-1], np.diff(cut))
            word = mix((2 * ids + side).astype(np.uint64)
                       + (place.astype(np.uint64) << np.uint64(32)) + np.uint64(1))
            hashes += mix(np.add.reduceat(word, cut[:-1]) + np.uint64(side))
        _, first, number = np.unique(hashes, return_index=True, return_inverse=True)
        return number, first

    def group_links(self, first: np.ndarray) -> Rows:
        """Groups (by one place of each) by id pairs: token pairs with these ids.

        Rows of the first factor are the different A ids of a group, each pointing at its
        group; the second has the groups' B ids; both count occurrences.
        """
        n, wide = len(first), len(self.tools.b_sizes)

        def counted(ids, cut):
            size = (cut[1:] - cut[:-1])[first]
            group = np.repeat(np.arange(n), size)
            place = (np.repeat(cut[first], size) + np.arange(len(group))
                     - np.repeat(np.cumsum(size) - size, size))
            key, times = np.unique(group << 32 | ids[place], return_counts=True)
            return key >> 32, key & 0xFFFFFFFF, times

        group, a, times = counted(self.a, self.a_cut)
        links = product(Rows(np.arange(len(group) + 1), group, times, n),
                        Rows.from_entries(*counted(self.b, self.b_cut), n, wide))
        row = links.row_numbers()
        return Rows.from_entries(group[row], a[row] * wide + links.columns, links.values, n,
                                 len(self.tools.a_sizes) * wide)


def _chunks(batches, params: AlignParams):
    """Ids of runs of rows, with their aligned texts."""
    tools = None
    for batch in batches:
        tools = tools or Tokenizers(params)
        for first, last, data, at in chunks(batch.column(1), params.chunk_bytes):
            whole, at = data.tobytes(), at.tolist()
            yield batch.column(0).slice(first, last - first), Chunk(
                [tools.encode(whole[i:j].decode()) for i, j in zip(at[:-1], at[1:])], tools)


def aligned(docs: DataFrame, params: AlignParams) -> DataFrame:
    """doc_id, a, b (token ids), a_cut, b_cut (tokens up to the end of each group) and the
    overlap links link_a, link_b, link_bytes (token numbers, bytes in common).

    Null and empty texts, and texts that either side does not give back byte for byte,
    have empty lists. Repeated rows give repeated results; other columns are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ("a", "b", "a_cut", "b_cut", "link_a", "link_b", "link_bytes")

    def run(batches):
        for ids, c in _chunks(batches, params):
            links = c.overlaps()
            row = links.row_numbers()
            link_at, ends = links.at[c.a_at], c.group_at
            groups, linked = np.diff(ends), np.diff(link_at)
            lists = ((c.a, c.a_at), (c.b, c.b_at),
                     (c.a_cut[1:] - np.repeat(c.a_at[:-1], groups), ends),
                     (c.b_cut[1:] - np.repeat(c.b_at[:-1], groups), ends),
                     (row - np.repeat(c.a_at[:-1], linked), link_at),
                     (links.columns - np.repeat(c.b_at[:-1], linked), link_at),
                     (links.values, link_at))
            yield pa.RecordBatch.from_arrays(
                [ids, *[pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(v, pa.int32()))
                        for v, at in lists]], names=["doc_id", *names])

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, " + ", ".join(f"{c} array<int>" for c in names))


COUNTS = ("n_a", "n_b", "n_groups", "n_links", "n_overlaps")
#: A chunk: what its documents have (as lists), which groups they hold how often, the
#: links of its groups, and its different id pairs with their numbers of documents.
LISTS = {**dict.fromkeys(COUNTS, "bigint"), "groups_sha256": "string", "held_at": "int",
         "held_group": "int", "held_times": "bigint", "links_at": "int", "link_pair": "int",
         "link_times": "bigint", "pairs": "bigint", "pair_docs": "bigint"}


def _described(c: Chunk) -> dict:
    """The lists of one chunk."""
    number, first = c.distinct_groups()
    links, n = c.group_links(first), len(first)
    text = np.repeat(np.arange(c.n), np.diff(c.group_at))
    held, times = np.unique(text * max(n, 1) + number, return_counts=True)
    held_text, held_group = held // max(n, 1), held % max(n, 1)
    held_at = np.searchsorted(held_text, np.arange(c.n + 1))
    pairs, link_pair, groups_of = np.unique(links.columns, return_inverse=True,
                                            return_counts=True)
    # a pair of one group is in as many texts as the group; others are counted text by text
    texts_of = np.bincount(held_group, minlength=n)
    link_group, lone = links.row_numbers(), groups_of[link_pair] == 1
    docs = np.bincount(link_pair[lone], texts_of[link_group[lone]], len(pairs)).astype(np.int64)
    shared = Rows.from_entries(link_group[~lone], link_pair[~lone],
                               np.ones(int((~lone).sum()), np.int64), n, max(len(pairs), 1))
    both = product(Rows(held_at, held_group, np.ones(len(held), np.int64), n), shared)
    docs += np.bincount(both.columns, minlength=len(pairs))
    overlaps = c.overlaps()
    return {"n_a": np.diff(c.a_at), "n_b": np.diff(c.b_at), "n_groups": np.diff(c.group_at),
            "n_links": c.per_text(c.group_at, np.diff(c.a_cut) * np.diff(c.b_cut)),
            "n_overlaps": np.diff(overlaps.at[c.a_at]),
            "groups_sha256": c.group_strings(), "held_at": held_at, "held_group": held_group,
            "held_times": times, "links_at": links.at, "link_pair": link_pair,
            "link_times": links.values, "pairs": pairs, "pair_docs": docs}


def described(docs: DataFrame, params: AlignParams) -> DataFrame:
    """One row per chunk: doc_ids and the lists of :data:`LISTS`."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    types = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}

    def run(batches):
        for ids, c in _chunks(batches, params):
            lists = [ids, *[pa.array(v, types[LISTS[k]]) for k, v in _described(c).items()]]
            yield pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in lists],
                names=["doc_ids", *LISTS])

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_ids array<{kind}>, " + ", ".join(f"{k} array<{t}>" for k, t in LISTS.items()))


def pair_counts(described: DataFrame, width: int) -> DataFrame:
    """pair (A id * ``width`` + B id), n_docs, and is_best: no other pair of the A id has more.

    A window holds the pairs of one A id, so ``width`` rows at most.
    """
    each = described.select(F.explode(F.arrays_zip("pairs", "pair_docs")).alias("x"))
    counts = each.groupBy(F.col("x.pairs").alias("pair")).agg(
        F.sum("x.pair_docs").alias("n_docs"))
    most = F.max("n_docs").over(Window.partitionBy(F.expr(f"pair div {width}")))
    return counts.select("pair", "n_docs", (F.col("n_docs") == most).alias("is_best"))


def _summed(kind: str):
    from_lists = [*COUNTS, "groups_sha256"]

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                def part(name, k=k):
                    return batch.column(name)[k].values

                def numbers(name):
                    return part(name).to_numpy(zero_copy_only=False)

                found = batch.column("found")[k].values
                n_docs = best = np.zeros(0, np.int64)
                if found is not None and len(found):
                    place = found.field(0).to_numpy()
                    n_docs, best = (np.zeros(len(place), np.int64) for _ in range(2))
                    n_docs[place] = found.field(1).to_numpy()
                    best[place] = found.field(2).to_numpy(zero_copy_only=False)
                at, pair, times = (numbers(x) for x in ("links_at", "link_pair", "link_times"))
                held_at, group, held = (numbers(x) for x in ("held_at", "held_group",
                                                             "held_times"))
                sums = []
                for value in (best, n_docs):
                    total = np.r_[0, np.cumsum(times * value[pair])]
                    total = np.r_[0, np.cumsum(held * (total[at[1:]] - total[at[:-1]])[group])]
                    sums.append(pa.array(total[held_at[1:]] - total[held_at[:-1]]))
                yield pa.RecordBatch.from_arrays(
                    [part("doc_ids"), *[part(c) for c in from_lists], *sums],
                    names=["doc_id", *from_lists, "n_best", "count_sum"])

    fields = ", ".join(f"{c} {LISTS[c]}" for c in from_lists)
    return run, f"doc_id {kind}, {fields}, n_best bigint, count_sum bigint"


def link_report(docs: DataFrame, params: AlignParams, folder: str | None = None) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_overlaps, groups_sha256, n_best
    (links whose id pair is the most frequent of its A id, ties included) and count_sum
    (documents with the link's id pair, over all links).

    A pair is counted once per row of ``docs`` that holds it linked, so repeated rows
    count each. Rows without tokens (see :func:`aligned`) have zeros and ''.
    """
    folder = folder or run_folder(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    parts = written(described(docs, params).withColumn("part", F.monotonically_increasing_id()),
                    "aligned", folder)
    counts = written(pair_counts(parts, pieces(params).get_piece_size()), "pair_counts", folder)
    wanted = parts.select("part", F.posexplode("pairs").alias("place", "pair"))
    found = (wanted.join(counts, "pair").groupBy("part")
             .agg(F.collect_list(F.struct("place", "n_docs", "is_best")).alias("found")))
    joined = parts.drop("pairs", "pair_docs").join(found, "part", "left")
    return joined.mapInArrow(*_summed(kind))
