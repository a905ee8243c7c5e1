"""Lexical retrieval packing: BM25 neighbours fill each seed document's window.

Documents become token ids once (a written table). Token and document counts over
the whole corpus weigh the terms. The corpus is then packed shard by shard: a
shard is a run of documents of bounded size, with an inverted index of its own.
A seed takes its nearest unused neighbours until its window is full; the last one
is cut and its rest stays in the pool, so windows carry no padding. What is left
at the end of a shard goes into windows whose lengths are powers of two.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landmarkflow.llm.steps import run_folder, written
from landmarkflow.llm.textbytes import chunks
from landmarkflow.llm.wordbpe import ChunkEncoder


@dataclass(frozen=True)
class PackParams:
    """``tokenizer`` is a file of the tokenizers library with fewer than 65,536 ids."""

    tokenizer: str
    window: int = 2048
    end_id: int = 1
    shard_tokens: int = 3_000_000
    query_terms: int = 12
    k1: float = 1.2
    b: float = 0.75


def tokenize(docs: DataFrame, params: PackParams) -> DataFrame:
    """(doc_id, tokens): ids as little-endian 16-bit numbers, the end id last; null is empty."""
    def run(batches):
        encoder = ChunkEncoder(params.tokenizer)
        for batch in batches:
            for first, last, data, at in chunks(batch.column(1)):
                ids, counts = encoder.encode(data, at, params.end_id)
                cut = np.concatenate([[0], np.cumsum(counts)]) * 2
                blob = ids.astype("<u2").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first),
                     pa.array([blob[a:b] for a, b in zip(cut[:-1], cut[1:])], pa.binary())],
                    names=["doc_id", "tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, tokens binary")


def term_counts(tokens: DataFrame) -> tuple[np.ndarray, int, int]:
    """Documents per token id over the whole corpus, number of documents, number of tokens."""
    def run(batches):
        df, n, total = np.zeros(1 << 16, np.int64), 0, 0
        for batch in batches:
            for _, _, data, at in chunks(batch.column(0)):
                ids = data.view("<u2").astype(np.int64)
                row = np.repeat(np.arange(len(at) - 1), np.diff(at) // 2)
                pair = np.sort(row << 16 | ids)
                once = pair[np.r_[True, pair[1:] != pair[:-1]]] if len(pair) else pair
                df += np.bincount(once & 0xFFFF, minlength=1 << 16)
                n, total = n + len(at) - 1, total + len(ids)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.r_[some, -1, -2]), pa.array(np.r_[df[some], n, total])],
            names=["term", "n"])

    rows = (tokens.select("tokens").mapInArrow(run, "term bigint, n bigint")
            .groupBy("term").agg(F.sum("n").alias("n")).collect())  # at most 65,538 rows
    by = {r["term"]: r["n"] for r in rows}
    df = np.zeros(1 << 16, np.int64)
    for term, n in by.items():
        if term >= 0:
            df[term] = n
    return df, by.get(-1, 0), by.get(-2, 0)


class Shard:
    """An inverted BM25 index over the units of one shard."""

    def __init__(self, units: list[np.ndarray], idf: np.ndarray, mean: float, params: PackParams):
        lengths = np.array([len(u) for u in units], np.int64)
        ids = np.concatenate(units).astype(np.int64)
        pair = np.sort(ids << 32 | np.repeat(np.arange(len(units)), lengths))
        first = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
        tf = np.diff(np.r_[first, len(pair)])
        term, self.unit = pair[first] >> 32, pair[first] & 0xFFFFFFFF
        norm = params.k1 * (1 - params.b + params.b * lengths[self.unit] / mean)
        self.weight = idf[term] * tf * (params.k1 + 1) / (tf + norm)
        self.bounds = np.searchsorted(term, np.arange((1 << 16) + 1))
        self.units, self.idf, self.terms = units, idf, params.query_terms
        self.score = np.zeros(len(units))

    def neighbours(self, seed: int, used: np.ndarray) -> list[int]:
        """Unused units that share one of the seed's rarest terms, best first."""
        terms = np.unique(self.units[seed]).astype(np.int64)
        if len(terms) > self.terms:
            terms = terms[np.argpartition(-self.idf[terms], self.terms)[:self.terms]]
        touched = []
        for t in terms.tolist():
            a, b = self.bounds[t], self.bounds[t + 1]
            self.score[self.unit[a:b]] += self.weight[a:b]
            touched.append(self.unit[a:b])
        found = np.unique(np.concatenate(touched)) if touched else np.zeros(0, np.int64)
        scores = self.score[found]
        self.score[found] = 0.0
        free = ~used[found]
        found, scores = found[free], scores[free]
        return found[np.lexsort((found, -scores))].tolist()


def pack_shard(docs: list[tuple], idf: np.ndarray, mean: float, params: PackParams):
    """Sequences of one shard, each a list of (doc, start, length).

    ``docs`` are (anything, ids). Long documents fill windows of their own first.
    """
    width, units, owner, offset = params.window, [], [], []
    for d, (_, ids) in enumerate(docs):
        full = len(ids) // width * width
        for start in range(0, full, width):
            yield [(d, start, width)]
        if full < len(ids):
            units.append(ids[full:])
            owner.append(d)
            offset.append(full)
    if not units:
        return
    shard, used = Shard(units, idf, mean, params), np.zeros(len(units), bool)
    taken, next_seed = np.zeros(len(units), np.int64), 0
    open_seq, room = [], width

    def put(u: int) -> None:
        nonlocal room
        n = min(room, len(units[u]) - int(taken[u]))
        open_seq.append((owner[u], offset[u] + int(taken[u]), n))
        taken[u] += n
        room -= n
        used[u] = taken[u] == len(units[u])

    while next_seed < len(units):
        if used[next_seed]:
            next_seed += 1
            continue
        seed = next_seed
        put(seed)
        if room:
            for u in shard.neighbours(seed, used):
                put(u)
                if not room:
                    break
        if not room:  # else the next seed goes on in the same window
            yield open_seq
            open_seq, room = [], width
    yield from powers_of_two(open_seq)


def powers_of_two(pieces: list[tuple]):
    """The pieces of one unfinished window cut into sequences without padding."""
    left = sum(n for _, _, n in pieces)
    pieces = pieces[::-1]
    while left:
        size, out = 1 << (left.bit_length() - 1), []
        left -= size
        while size:
            d, start, n = pieces.pop()
            if n > size:
                pieces.append((d, start + size, n - size))
                n = size
            out.append((d, start, n))
            size -= n
        yield out


PIECES = ("start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
          "sequence_id bigint, offset bigint, sequence_tokens bigint")


def pack(docs: DataFrame, params: PackParams, folder: str | None = None) -> DataFrame:
    """One row per piece of a document in a sequence of at most ``window`` tokens.

    A null or empty text is the end id alone. Equal rows are packed each for
    itself. A sequence is full or has a power of two of tokens. Sequence numbers
    hold the task and a counter; tasks read a written table, so a task that runs
    again gives the same rows.
    """
    tokens = written(tokenize(docs, params), "tokens", folder or run_folder(docs.sparkSession))
    df, n_docs, n_tokens = term_counts(tokens)
    idf = np.log1p((n_docs - df + 0.5) / (df + 0.5)).astype(np.float32)
    shared = docs.sparkSession.sparkContext.broadcast(idf)  # one number per token id
    mean = max(n_tokens / max(n_docs, 1), 1.0)

    def run(batches):
        weights, counter = shared.value, TaskContext.get().partitionId() << 40
        held, size = [], 0

        def flush():
            nonlocal counter
            ids, rows = [], []
            for seq in pack_shard(held, weights, mean, params):
                at, total = 0, sum(n for _, _, n in seq)
                for d, start, n in seq:
                    own = held[d][1]
                    ids.append(held[d][0])
                    rows.append((start, n, zlib.crc32(own[start:start + n].astype("<u4").tobytes()),
                                 len(own), counter, at, total))
                    at += n
                counter += 1
            cols = [pa.array(c, pa.int64()) for c in zip(*rows)]
            return pa.RecordBatch.from_arrays([pa.array(ids, kind), *cols], names=names)

        for batch in batches:
            kind, names = batch.schema.field(0).type, out_names
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                held.append((doc, np.frombuffer(raw.as_py(), "<u2")))
                size += len(held[-1][1])
                if size >= params.shard_tokens:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    kind_sql = docs.schema["doc_id"].dataType.simpleString()
    out_names = ["doc_id", *[x.split()[0] for x in PIECES.split(", ")]]
    return tokens.mapInArrow(run, f"doc_id {kind_sql}, {PIECES}")
