"""Removal of long repeated byte strings by a logarithmic family of suffix arrays.

The arrays are sparse. In every string of ``length`` bytes one position is chosen
by its content alone (the smallest hash of ``prefix`` bytes), so two equal strings
choose the same one, and only the suffixes at chosen positions are kept: about
one in a hundred. A suffix is ordered by the hash of its first ``prefix`` bytes,
then by that of its span, which is all bytes of the strings that chose it; equal
beginnings are neighbours in this order as in an alphabetical one.

New batches get an array of their own, which is merge-scanned against the existing
levels for beginnings met before; levels of equal size are merged, so the sizes
are powers of two. Arrays are tables bucketed by their order, so neither scans nor
merges shuffle.

Spans found more than once are removed whole. Spans whose beginning is met
elsewhere but which are met only once lie at the edge of a repeat: the hashes of
their single strings tell, byte for byte, how far it goes.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from landmarkflow.llm.textbytes import (BYTE_CODES, CHUNK_BYTES, LEVEL_FACTORS, chunks, mix,
                                        repeated, signed, texts_of, whole_groups)
from landmarkflow.llm.steps import run_folder, written
from landmarkflow.sources.tables import work_dir

BLOCK = 128
PLACE_BITS = np.uint64(28)
LONG_ROW = 4 * CHUNK_BYTES


@dataclass(frozen=True)
class SuffixParams:
    """``length`` bytes make a repeat; ``batches`` is how many pieces the corpus comes in.

    The spans of one key are compared in one task up to ``together`` spans, else
    their strings are counted by a shuffle of their own.
    """

    length: int = 200
    prefix: int = 32
    batches: int = 4
    together: int = 50_000


def block_hashes(data: np.ndarray, *sizes: int) -> dict:
    """Hash of the bytes of each power-of-two size from every position on."""
    now, size, level, out = BYTE_CODES[data], 1, 0, {}
    while size < max(sizes):
        half = now[:-size] * LEVEL_FACTORS[level]
        half += now[size:]
        half ^= half >> np.uint64(29)
        now, size, level = half, 2 * size, level + 1
        if size in sizes:
            out[size] = now
    return out


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def _strings(lengths: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start in the chunk and row of every string that lies whole in its row."""
    total = int(lengths.sum())
    row = np.repeat(np.arange(len(lengths)), lengths)
    return np.arange(total) - (np.cumsum(lengths) - lengths)[row] + at[row], row


def spans(data: np.ndarray, at: np.ndarray, params: SuffixParams):
    """Chosen suffixes of a chunk: row, first string's start in it, number, place, key, print."""
    length = params.length
    counts = np.maximum(np.diff(at) - length + 1, 0)
    if not counts.any():
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty, empty, empty
    hashes = block_hashes(data, params.prefix, BLOCK)
    key, block = mix(hashes[params.prefix]), hashes[BLOCK]
    packed = key >> PLACE_BITS << PLACE_BITS | np.arange(len(key), dtype=np.uint64)
    least = _smallest(packed, length - params.prefix + 1)
    start, row = _strings(counts, at)
    chosen = (least[start] & np.uint64((1 << 28) - 1)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, (chosen[1:] != chosen[:-1]) | (row[1:] != row[:-1])])
    n = np.diff(np.r_[first, len(chosen)])
    begin, place, row = start[first], chosen[first], row[first]
    size = n - 1 + length
    middle = begin + np.minimum(BLOCK, size - BLOCK)
    code = (block[begin] * LEVEL_FACTORS[8] + block[middle] * LEVEL_FACTORS[9]
            + block[begin + size - BLOCK] * LEVEL_FACTORS[10]
            + n.astype(np.uint64) * LEVEL_FACTORS[11]
            + (place - begin).astype(np.uint64) * LEVEL_FACTORS[12])
    return row, begin - at[row], n, place - begin, signed(key[place]), signed(mix(code))


def _pieces(data: np.ndarray, at: np.ndarray, params: SuffixParams):
    """A chunk, or a very long row cut so that every string lies in one piece."""
    if len(at) > 2 or len(data) <= LONG_ROW:
        yield 0, data, at
        return
    for base in range(0, max(len(data) - params.length + 1, 1), CHUNK_BYTES):
        part = data[base:base + CHUNK_BYTES + params.length - 1]
        yield base, part, np.array([0, len(part)])


def row_key(docs: DataFrame) -> DataFrame:
    """text and (g1, g2): the id (for null, a hash of the text) and a short hash of the text."""
    return docs.select("doc_id", "text",
                       F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("g1"),
                       F.hash("text").alias("g2"))


SUFFIXES = "key bigint, print bigint, g1 bigint, g2 int, start int, n int"


def suffixes(rows: DataFrame, params: SuffixParams) -> DataFrame:
    """The chosen suffixes of all texts; texts under ``length`` bytes and nulls have none."""
    def run(batches):
        for batch in batches:
            g1, g2 = batch.column(0), batch.column(1)
            for top, _, data, at in chunks(batch.column(2)):
                for base, part, cuts in _pieces(data, at, params):
                    row, start, n, _, key, code = spans(part, cuts, params)
                    if len(row):
                        take = pa.array(row + top)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(key), pa.array(code), g1.take(take), g2.take(take),
                             pa.array((start + base).astype(np.int32)),
                             pa.array(n.astype(np.int32))],
                            names=["key", "print", "g1", "g2", "start", "n"])

    return rows.select("g1", "g2", "text").mapInArrow(run, SUFFIXES)


class SuffixFamily:
    """Levels of suffix arrays, as tables bucketed and sorted by key in one database.

    Level ``k`` holds ``2 ** k`` batches. :meth:`add` returns the keys of a new
    batch that occur twice in it or in a level.
    """

    def __init__(self, spark: SparkSession, params: SuffixParams = SuffixParams()):
        self.spark, self.params = spark, params
        self.name = f"suffixes_{uuid.uuid4().hex}"
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: dict[int, str] = {}
        self.shared: list[str] = []
        self.count = 0
        spark.sql(f"CREATE DATABASE {self.name} LOCATION '{work_dir(spark)}/{self.name}'")

    def _write(self, df: DataFrame) -> str:
        self.count += 1
        table = f"{self.name}.t{self.count}"
        (df.write.bucketBy(self.buckets, "key").sortBy("key").option("compression", "zstd")
         .format("parquet").saveAsTable(table))
        return table

    def add(self, rows: DataFrame) -> DataFrame:
        """Takes in a batch of :func:`row_key` rows and returns its keys met before."""
        array = self._write(suffixes(rows, self.params).repartition(self.buckets, "key"))
        batch = self.spark.table(array).groupBy("key").agg(F.count("*").alias("times"))
        for k, level in sorted(self.levels.items()):
            old = self.spark.table(level).select("key").distinct().withColumn(f"in{k}", F.lit(1))
            batch = batch.join(old, "key", "left")
        met = F.col("times") > 1
        for k in self.levels:
            met = met | F.col(f"in{k}").isNotNull()
        self.shared.append(self._write(batch.filter(met).select("key")))
        k = 0
        while k in self.levels:
            array, k = self._merge(self.levels.pop(k), array), k + 1
        self.levels[k] = array
        return self.spark.table(self.shared[-1])

    def _merge(self, a: str, b: str) -> str:
        """Two levels as one, without a shuffle: every file's rows stay in their bucket."""
        merged = self._write(self.spark.table(a).unionByName(self.spark.table(b)))
        for t in (a, b):
            self.spark.sql(f"DROP TABLE {t}")
        return merged

    def repeats(self) -> DataFrame:
        """Suffixes with a shared key: the columns of the array, whole, rep and wide.

        ``whole``: the span is met again. ``rep``: one suffix of every such span of
        a key that has single spans too; these and the single ones have to be
        compared string by string. ``wide``: the key has many different spans.
        """
        while len(self.levels) > 1:
            small, large = sorted(self.levels)[:2]
            self.levels[large] = self._merge(self.levels.pop(small), self.levels[large])
        (level,) = self.levels.values()
        keys = self.spark.table(self.shared[0])
        for t in self.shared[1:]:
            keys = keys.unionByName(self.spark.table(t))
        known = self._write(keys.distinct())
        found = self.spark.table(level).join(self.spark.table(known), "key", "left_semi")
        key, span = Window.partitionBy("key"), Window.partitionBy("key", "print")
        ranked = span.orderBy("g1", "g2", "start")
        return (found.withColumns({"of_span": F.count("*").over(span),
                                   "of_key": F.count("*").over(key),
                                   "nth": F.row_number().over(ranked)})
                .filter("of_key > 1")
                .withColumns({"whole": F.col("of_span") > 1,
                              "spans": F.sum((F.col("nth") == 1).cast("long")).over(key),
                              "singles": F.sum((F.col("of_span") == 1).cast("long")).over(key)})
                .select("key", "g1", "g2", "start", "n", "whole",
                        ((F.col("nth") == 1) & F.col("whole") & (F.col("singles") > 0))
                        .alias("rep"), (F.col("spans") > self.params.together).alias("wide")))

    def drop(self) -> None:
        self.spark.sql(f"DROP DATABASE {self.name} CASCADE")


def span_texts(rows: DataFrame, edges: DataFrame, params: SuffixParams) -> DataFrame:
    """(key, g1, g2, start, n, single, wide, bytes) of the given spans."""
    per = edges.groupBy("g1", "g2").agg(F.collect_set(F.struct(
        "start", "n", "key", (~F.col("whole")).alias("single"), "wide")).alias("spans"))
    joined = rows.select("g1", "g2", "text").join(per, ["g1", "g2"])

    def run(batches):
        for batch in batches:
            for top, last, data, at in chunks(batch.column(2)):
                lists = batch.column(3).slice(top, last - top)
                flat = lists.flatten()
                row = np.repeat(np.arange(last - top), np.asarray(lists.value_lengths()))
                start, n = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64)
                            for k in range(2))
                source, which = _strings(n - 1 + params.length, at[row] + start)
                ends = np.concatenate([[0], np.cumsum(n - 1 + params.length)])
                body = pa.Array.from_buffers(pa.large_binary(), len(n), [
                    None, pa.py_buffer(ends), pa.py_buffer(data[source])]).cast(pa.binary())
                take = pa.array(row + top)
                yield pa.RecordBatch.from_arrays(
                    [flat.field(2), batch.column(0).take(take), batch.column(1).take(take),
                     flat.field(0), flat.field(1), flat.field(3), flat.field(4), body],
                    names=["key", "g1", "g2", "start", "n", "single", "wide", "bytes"])

    return joined.mapInArrow(run, "key bigint, g1 bigint, g2 int, start int, n int, "
                                  "single boolean, wide boolean, bytes binary")


def _codes(batch: pa.RecordBatch, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all strings of a batch of spans: hash with the key, span, number in its span."""
    data, at = texts_of(batch.column(7))
    key = batch.column(0).to_numpy().view(np.uint64)
    block = block_hashes(data, BLOCK)[BLOCK]
    place, which = _strings(np.diff(at) - length + 1, at[:-1])
    code = block[place] * LEVEL_FACTORS[13] + block[place + length - BLOCK]
    return mix(mix(code) ^ key[which]), which, place - at[which]


MARKS = "g1 bigint, g2 int, start int, n int"


def _marks(batch: pa.RecordBatch, which: np.ndarray, number: np.ndarray, met: np.ndarray):
    """Runs of repeated strings of the single spans, as rows of :data:`MARKS`."""
    single = batch.column(5).to_numpy(zero_copy_only=False).astype(bool)
    at = np.flatnonzero(met & single[which])
    if not len(at):
        return None
    head = np.r_[True, (np.diff(at) > 1) | (which[at[1:]] != which[at[:-1]])]
    first, take = at[head], pa.array(which[at[head]])
    start = batch.column(3).take(take).to_numpy() + number[first]
    n = np.diff(np.r_[np.flatnonzero(head), len(at)])
    return pa.RecordBatch.from_arrays(
        [batch.column(1).take(take), batch.column(2).take(take),
         pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))],
        names=["g1", "g2", "start", "n"])


def repeats_together(spans_: DataFrame, params: SuffixParams) -> DataFrame:
    """:data:`MARKS` of keys with few spans: all strings of a key meet in one task."""
    ordered = spans_.filter("not wide").repartition("key").sortWithinPartitions("key")

    def run(batches):
        for batch in whole_groups(batches):
            code, which, number = _codes(batch, params.length)
            out = _marks(batch, which, number, repeated(code))
            if out is not None:
                yield out

    return ordered.mapInArrow(run, MARKS)


def repeats_apart(spans_: DataFrame, params: SuffixParams) -> DataFrame:
    """:data:`MARKS` of keys with many spans: equal strings are counted by a shuffle."""
    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                code, which, number = _codes(part, params.length)
                take = pa.array(which)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(take), pa.array(signed(code)), part.column(1).take(take),
                     part.column(2).take(take),
                     pa.array((part.column(3).to_numpy()[which] + number).astype(np.int32)),
                     part.column(5).take(take)],
                    names=["key", "code", "g1", "g2", "start", "single"])

    hashed = spans_.filter("wide").mapInArrow(
        run, "key bigint, code bigint, g1 bigint, g2 int, start int, single boolean")
    twice = hashed.groupBy("key", "code").agg(F.count("*").alias("n")).filter("n > 1")
    return hashed.filter("single").join(twice.select("key", "code"), ["key", "code"],
                                        "left_semi").select(
        "g1", "g2", "start", F.lit(1).alias("n"))


def repeated_strings(rows: DataFrame, found: DataFrame, params: SuffixParams, folder: str
                     ) -> DataFrame:
    """Per row key the runs (start, n) of repeated strings: of spans met again, and at edges."""
    edges = written(span_texts(rows, found.filter("rep or not whole"), params), "spans",
                        folder)
    marks = (found.filter("whole").select("g1", "g2", "start", "n")
             .unionByName(repeats_together(edges, params))
             .unionByName(repeats_apart(edges, params)))
    return marks.groupBy("g1", "g2").agg(F.collect_list(F.struct("start", "n")).alias("runs"))


RESULT = ("n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, "
          "removed array<bigint>")


def cut_repeats(rows: DataFrame, marks: DataFrame, params: SuffixParams) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed (start, end, start, end ...)."""
    joined = rows.join(marks, ["g1", "g2"], "left").select("doc_id", "text", "runs")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for top, last, data, at in chunks(batch.column(1)):
                edge = np.zeros(len(data) + 1, np.int64)
                lists = batch.column(2).slice(top, last - top)
                flat = lists.flatten()
                first = np.repeat(at[:-1], np.asarray(lists.value_lengths().fill_null(0)))
                first = first + flat.field(0).to_numpy(zero_copy_only=False)
                more = flat.field(1).to_numpy(zero_copy_only=False)
                np.add.at(edge, first, 1)
                np.add.at(edge, first + more - 1 + params.length, -1)
                gone = np.cumsum(edge[:-1]) > 0
                out = []
                for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                    own = gone[a:b]
                    cuts = np.flatnonzero(np.diff(np.r_[False, own, False].astype(np.int8)))
                    kept = data[a:b] if not len(cuts) else data[a:b][~own]
                    out.append((b - a, int(own.sum()), len(cuts) // 2,
                                hashlib.sha256(kept.tobytes()).hexdigest(), cuts.tolist()))
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(top, last - top),
                     *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.string()),
                     pa.array(cols[4], pa.list_(pa.int64()))],
                    names=["doc_id", *[x.split()[0] for x in RESULT.split(", ")]])

    return joined.mapInArrow(run, f"doc_id {kind}, {RESULT}")


def remove_repeats(docs: DataFrame, params: SuffixParams = SuffixParams(),
                   folder: str | None = None) -> DataFrame:
    """Per document what is left when every byte of a repeated string is removed.

    A string of ``length`` bytes counts as repeated if it also starts anywhere
    else, in another row or the same one; equal rows repeat each other. Matches
    never cross rows. A null text is an empty one, and texts under ``length``
    bytes stay whole. Only doc_id and text are read.
    """
    folder = folder or run_folder(docs.sparkSession)
    rows, family = row_key(docs), SuffixFamily(docs.sparkSession, params)
    for b in range(params.batches):
        family.add(rows.filter(F.pmod(F.col("g2"), F.lit(params.batches)) == b))
    found = written(family.repeats(), "repeats", folder)
    family.drop()
    return cut_repeats(rows, repeated_strings(rows, found, params, folder), params)
