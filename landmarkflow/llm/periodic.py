"""Periodic runs of words: recursive frequency splitting, then a lag scan.

A run is a stretch of consecutive words with smallest period ``q`` that is at least
``max(min_length, 2 q)`` words long and cannot be extended. Every word of a run stands
in it twice or more, so a word met once in its segment belongs to none and splits the
segment; the pieces have fewer words of each kind, so splitting goes on until nothing
changes. Pieces under ``min_length`` go.

What survives is scanned at every lag ``q``. A run of ``2 q`` words holds two
neighbouring places of the grid ``0, q, 2 q, ...``, so only these are compared: how far
the words a lag apart agree on either side of such a pair gives the run. These
extensions are read off names of blocks of 1, 2, 4, ... words (equal blocks have equal
names), so a segment of n words takes about n log^2 n steps whatever its periods are.

Documents are worked off in chunks of a few megabytes by vector operations; nothing is
shuffled, and a document is never cut.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landmarkflow.llm.textbytes import chunks

#: Places of the lag grid that are compared at once.
PAIRS = 1 << 20


@dataclass(frozen=True)
class RunParams:
    """Runs have at least ``min_length`` words (5 or more) and two periods."""

    min_length: int = 12


def split_rare(ids: np.ndarray, at: np.ndarray, min_length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the surviving words and the segment of each, both ascending.

    ``ids`` are word numbers of all rows, ``at`` the rows' offsets in them.
    """
    place = np.arange(len(ids))
    segment = np.repeat(np.arange(len(at) - 1), np.diff(at))
    while len(place):
        new = np.r_[True, (segment[1:] != segment[:-1]) | (np.diff(place) > 1)]
        segment = np.cumsum(new) - 1
        _, kind, times = np.unique(segment * (int(ids.max()) + 1) + ids[place],
                                   return_inverse=True, return_counts=True)
        keep = (times[kind] > 1) & (np.bincount(segment)[segment] >= min_length)
        if keep.all():
            break
        place, segment = place[keep], segment[keep]
    return place, segment


class Blocks:
    """Names of the blocks of 2^t symbols from every place on; equal blocks, equal names.

    Blocks met once have no name (-1). Symbols must not be negative.
    """

    def __init__(self, symbols: np.ndarray):
        self.n, self.names = len(symbols), []
        here, name, size = np.arange(self.n), symbols, 1
        while len(here):
            _, kind, times = np.unique(name, return_inverse=True, return_counts=True)
            often = times[kind] > 1
            here, kind = here[often], kind[often]
            level = np.full(self.n + 1, -1, np.int32)
            level[here] = kind
            self.names.append(level)
            after = np.minimum(here + size, self.n)
            both = level[after] >= 0
            name = kind[both].astype(np.int64) * (self.n + 1) + level[after[both]]
            here, size = here[both], 2 * size

    def same(self, t: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the blocks at ``a`` and ``b`` (places outside have none) are equal."""
        level = self.names[t]
        x = level[np.where((a < 0) | (a > self.n), self.n, a)]
        return (x >= 0) & (x == level[np.where((b < 0) | (b > self.n), self.n, b)])

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols agree from ``a`` and ``b`` on."""
        total = np.zeros(len(a), np.int64)
        for t in reversed(range(len(self.names))):
            total += self.same(t, a + total, b + total).astype(np.int64) << t
        return total

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols agree before ``a`` and ``b``."""
        total = np.zeros(len(a), np.int64)
        for t in reversed(range(len(self.names))):
            at = total + (1 << t)
            total += self.same(t, a - at, b - at).astype(np.int64) << t
        return total


def _grid(starts: np.ndarray, sizes: np.ndarray):
    """Blocks of (place, lag) pairs: every lag of every segment, a lag apart."""
    half = sizes // 2
    of = np.repeat(np.arange(len(sizes)), half)
    lag = np.arange(len(of)) - np.repeat(np.cumsum(half) - half, half) + 1
    count = (sizes[of] - 1) // lag
    edge = np.r_[0, np.cumsum(count)]
    low = 0
    while low < len(lag):
        high = max(low + 1, int(np.searchsorted(edge, edge[low] + PAIRS, "right")) - 1)
        n = count[low:high]
        q = np.repeat(lag[low:high], n)
        k = np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n)
        yield np.repeat(starts[of[low:high]], n) + k * q, q
        low = high


def scan_lags(ids: np.ndarray, place: np.ndarray, segment: np.ndarray, min_length: int
              ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All runs of the segments, in order: place of the first word, length, period."""
    none = np.zeros(0, np.int64)
    if not len(place):
        return none, none, none
    # segments side by side, with a symbol of its own in front of each
    cut = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
    sizes = np.diff(np.r_[cut, len(place)])
    inner = np.arange(len(place)) + segment + 1
    symbols = int(ids.max()) + 1 + np.arange(len(place) + len(cut))
    symbols[inner] = ids[place]
    blocks, found = Blocks(symbols), []
    if len(blocks.names) < 2:
        return none, none, none
    for a, q in _grid(inner[cut], sizes):
        b = a + q
        # three words or more agree in all, so two do on one side at least
        some = np.flatnonzero(blocks.same(1, a, b) | blocks.same(1, a - 2, b - 2))
        a, b, q = a[some], b[some], q[some]
        before = blocks.backward(a, b)
        length = before + blocks.forward(a, b) + q
        good = length >= np.maximum(min_length, 2 * q)
        found.append(np.stack([(a - before)[good], length[good], q[good]]))
    start, length, q = np.concatenate(found, axis=1)
    order = np.lexsort((q, length, start))
    start, length, q = start[order], length[order], q[order]
    # of one stretch the smallest lag is the period
    first = np.r_[True, (start[1:] != start[:-1]) | (length[1:] != length[:-1])][:len(start)]
    start, length, q = start[first], length[first], q[first]
    start = place[np.searchsorted(inner, start)]
    order = np.lexsort((q, start))
    return start[order], length[order], q[order]


def repeated_words(n: int, start, length, period) -> np.ndarray:
    """Words that stand in some run after its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, start + length, -1)
    return np.cumsum(edge[:n]) > 0


def _runs(params: RunParams):
    def run(batches):
        for batch in batches:
            for first, last, data, at in chunks(batch.column(1)):
                numbers, words, ids, ends = {}, [], [], [0]
                whole = data.tobytes()
                for i, j in zip(at[:-1].tolist(), at[1:].tolist()):
                    own = whole[i:j].split()
                    words.append(own)
                    ids += [numbers.setdefault(w, len(numbers)) for w in own]
                    ends.append(len(ids))
                ids, ends = np.array(ids, np.int64), np.array(ends)
                start, length, period = scan_lags(
                    ids, *split_rare(ids, ends, params.min_length), params.min_length)
                gone = repeated_words(len(ids), start, length, period)
                row_at = np.searchsorted(start, ends)
                texts = []
                for own, i, j in zip(words, ends[:-1], ends[1:]):
                    drop = gone[i:j]
                    texts.append(b" ".join([w for w, g in zip(own, drop.tolist()) if not g]
                                           if drop.any() else own).decode())
                base = np.repeat(ends[:-1], np.diff(row_at))
                runs = pa.ListArray.from_arrays(
                    pa.array(row_at, pa.int32()), pa.StructArray.from_arrays(
                        [pa.array(x) for x in (start - base, length, period)],
                        names=["start", "length", "period"]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), pa.array(np.diff(ends)), runs,
                     pa.array(texts, pa.string())],
                    names=["doc_id", "n_words", "runs", "collapsed"])
    return run


def periodic_runs(docs: DataFrame, params: RunParams = RunParams()) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period), collapsed.

    Words are separated by ASCII white space and numbered from 0. ``collapsed`` is the
    text without the words that repeat a period of some run, joined by single spaces.
    Null and empty texts have no words, no runs and an empty ``collapsed``; repeated rows
    give repeated results; an empty table gives none. Other columns are not read.
    """
    if params.min_length < 5:
        raise ValueError("runs of fewer than 5 words are not looked for")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        _runs(params), f"doc_id {kind}, n_words bigint, "
        "runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def loop_words(docs: DataFrame) -> DataFrame:
    """doc_id and text; texts of one id in ten go round in circles from some word on.

    With ``h`` the CRC-32 of the decimal id and ``g = h div 10``: where ``h`` ends in 0,
    word ``i >= a`` of ``n`` becomes word ``a + (i - a) mod p``, ``a = g mod n`` and
    ``p = 1 + (n - a) div (3 + g mod 8)``. Other texts, and those of null ids, stay.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    g, n = F.expr("_h div 10"), F.size("_w").cast("long")
    chosen = docs.select("doc_id", "text", h.alias("_h")).withColumn(
        "_w", F.when(F.col("_h") % 10 == 0, words))
    placed = (chosen.withColumn("_a", F.when(n > 0, g % n))
              .withColumn("_p", 1 + F.expr("(size(_w) - _a) div (3 + (_h div 10) % 8)")))
    looped = F.transform("_w", lambda w, i: F.when(i < F.col("_a"), w).otherwise(F.get(
        "_w", (F.col("_a") + (i - F.col("_a")) % F.col("_p")).cast("int"))))
    return placed.select("doc_id", F.when(F.col("_a").isNotNull(), F.array_join(looped, " "))
                         .otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """Contract columns, read off the output of :func:`periodic_runs`."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    line = F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", *[r[k].cast("string") for k in ("start", "length", "period")]),
        F.lit("\n")))
    out = found.select("doc_id", "runs", "collapsed", best.alias("_b"))
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_b.start")).alias("start"),
        F.col("_b.length").alias("length"), (-F.col("_b.period")).alias("period"),
        F.expr("1000 * _b.length div (-_b.period)").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))
