"""N-gram Jaccard self-join of documents by chosen paths.

Documents with the same set of word shingles are one set. In each run a set walks
down a tree: a node samples one coordinate, and the sets with the same min-hashed
shingle there go on together, until a bucket is small. Small buckets are compared
by brute force on their sketches, buckets that are large at the last level are
passed on whole; runs are repeated until a pair at the threshold is met with the
target probability. What was met forms candidate groups, and inside them every
pair of sets is verified exactly, so a link is lost only if no chain of runs
brought its sets together.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landmarkflow.llm.components import connected
from landmarkflow.llm.decontaminate import words_of
from landmarkflow.llm.keys import fields, positional
from landmarkflow.llm.setpairs import deal, forest, verify
from landmarkflow.llm.textbytes import chunks, distinct, gram_hashes, mix, signed, whole_groups
from landmarkflow.llm.steps import run_folder, written


@dataclass(frozen=True)
class JoinParams:
    """Sets of ``words``-word shingles with a Jaccard similarity of ``similarity`` or more.

    ``coordinates`` min-hashes make a sketch; buckets of ``bucket`` sets are small;
    a path has at most ``depth`` steps. A pair at the threshold is missed by a run of
    typical depth 2 with probability 1 - s^2; ``runs`` follow from ``recall``.
    """

    words: int = 5
    similarity: tuple[int, int] = (4, 5)
    coordinates: int = 64
    bucket: int = 128
    depth: int = 6
    recall: float = 0.9999
    sketch_share: float = 0.6

    @property
    def runs(self) -> int:
        s = self.similarity[0] / self.similarity[1]
        return ceil(log(1 - self.recall) / log(1 - s ** 2))


def shingles(data: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles (48 bits) of every row, sorted by row and value, and their rows.

    A row of fewer than ``n`` words, but not none, has all its words as one shingle.
    """
    words, row = words_of(data, at)
    rows = len(at) - 1
    grams, first = gram_hashes(words, row, n)
    of = row[first]
    count = np.bincount(row, minlength=rows)
    for r in np.flatnonzero((count > 0) & (count < n)):
        own = words[np.searchsorted(row, r):np.searchsorted(row, r, "right")]
        code = np.uint64(len(own))
        for w in own:
            code = mix(np.array([code ^ w], np.uint64))[0]
        grams, of = np.append(grams, code), np.append(of, r)
    packed = distinct(of.astype(np.uint64) << np.uint64(48) | grams >> np.uint64(16))
    return packed & np.uint64((1 << 48) - 1), (packed >> np.uint64(48)).astype(np.int64)


def _constants(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(seed))
    return (rng.integers(1, 1 << 62, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1),
            rng.integers(1, 1 << 62, n, dtype=np.uint64))


def sketches(docs: DataFrame, keep, text: str, params: JoinParams) -> DataFrame:
    """``keep``, set_id (null without words), sketch (min-hash per coordinate), size.

    ``set_id`` is a 64-bit hash of the whole set.
    """
    keep = list(keep)
    schema = ", ".join([*fields(docs, keep), "set_id bigint, sketch array<int>, size int"])
    a, b = _constants(params.coordinates, 11)

    def run(batches):
        for batch in batches:
            for top, last, data, at in chunks(batch.column(len(keep))):
                n = last - top
                values, row = shingles(data, at, params.words)
                size = np.bincount(row, minlength=n)
                full = np.flatnonzero(size)
                begin = np.searchsorted(row, full)
                ids, sketch = np.zeros(n, np.uint64), np.zeros((n, params.coordinates), np.uint32)
                if len(full):
                    total = np.add.reduceat(mix(values), begin)
                    ids[full] = mix(total + size[full].astype(np.uint64))
                    for k in range(params.coordinates):
                        h = values * a[k]
                        h += b[k]
                        h >>= np.uint64(32)
                        sketch[full, k] = np.minimum.reduceat(h, begin).astype(np.uint32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(top, n) for c in range(len(keep))]
                    + [pa.array(signed(ids), mask=size == 0),
                       pa.FixedSizeListArray.from_arrays(
                           pa.array(sketch.view(np.int32).ravel()), params.coordinates)
                       .cast(pa.list_(pa.int32())), pa.array(size.astype(np.int32))],
                    names=[*keep, "set_id", "sketch", "size"])

    return docs.select(*keep, text).mapInArrow(run, schema)


def paths(sets: DataFrame, params: JoinParams) -> DataFrame:
    """(set_id, path): per run the keys of the nodes a set would come to, root first."""
    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            sketch = batch.column(1).flatten().to_numpy(zero_copy_only=False).view(np.uint32)
            sketch = sketch.reshape(n, params.coordinates).astype(np.uint64)
            for r in range(params.runs):
                node = mix(np.full(n, 1000 + r, np.uint64))
                out = np.zeros((n, params.depth), np.uint64)
                for d in range(params.depth):
                    coordinate = (node % np.uint64(params.coordinates)).astype(np.int64)
                    node = mix(node ^ mix(sketch[np.arange(n), coordinate]
                                          + (coordinate.astype(np.uint64) << np.uint64(32))))
                    out[:, d] = node
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.FixedSizeListArray.from_arrays(
                        pa.array(signed(out.ravel())), params.depth).cast(pa.list_(pa.int64()))],
                    names=["set_id", "path"])

    return sets.select("set_id", "sketch").mapInArrow(run, "set_id bigint, path array<bigint>")


def leaves(walks: DataFrame, params: JoinParams, folder: str) -> tuple[DataFrame, DataFrame]:
    """(key, set_id) of the small buckets with more than one set, and of the large last ones."""
    small, now = [], walks.withColumn("key", F.col("path")[0])
    for d in range(params.depth):
        counts = now.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
        placed = written(now.join(counts, "key"), f"level_{d}", folder)
        small.append(placed.filter(F.col("n") <= params.bucket).select("key", "set_id"))
        large = placed.filter(F.col("n") > params.bucket)
        if d + 1 == params.depth or large.isEmpty():
            break
        now = large.select("set_id", "path", F.col("path")[d + 1].alias("key"))
    out = small[0]
    for s in small[1:]:
        out = out.unionByName(s)
    return out, large.select("key", "set_id")


def bucket_edges(small: DataFrame, sets: DataFrame, params: JoinParams) -> DataFrame:
    """Pairs of a small bucket with like sketches, as a spanning forest of each bucket."""
    rows = (small.join(sets.select("set_id", "sketch"), "set_id").select("key", "set_id", "sketch")
            .repartition("key").sortWithinPartitions("key", "set_id"))
    least = params.sketch_share * params.coordinates

    def edges(ids: np.ndarray, sketch: np.ndarray):
        same = np.zeros((len(ids), len(ids)), np.int16)
        for k in range(sketch.shape[1]):
            same += sketch[:, k][:, None] == sketch[:, k][None, :]
        ok = same >= least
        np.fill_diagonal(ok, False)
        return [(int(ids[x]), int(ids[y])) for x, y in forest(ok)]

    def run(batches):
        for batch in whole_groups(batches):
            key = batch.column(0).to_numpy()
            ids = batch.column(1).to_numpy()
            sketch = batch.column(2).flatten().to_numpy(zero_copy_only=False)
            sketch = sketch.reshape(len(ids), params.coordinates)
            cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
            out = [e for a, b in zip(cut[:-1], cut[1:]) if b - a > 1
                   for e in edges(ids[a:b], sketch[a:b])]
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x for x, _ in out], pa.int64()),
                     pa.array([y for _, y in out], pa.int64())], names=["a", "b"])

    return rows.mapInArrow(run, "a bigint, b bigint")


def sets_of(params: JoinParams):
    """Shingle sets of a column of texts."""
    def run(column):
        out = []
        for top, last, data, at in chunks(column):
            values, row = shingles(data, at, params.words)
            cut = np.searchsorted(row, np.arange(last - top + 1))
            out += [signed(values[a:b]) for a, b in zip(cut[:-1], cut[1:])]
        return out
    return run


def similar_sets(docs: DataFrame, params: JoinParams, folder: str,
                 text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Documents with their set, and sets with class and links.

    First: g1, g2 (row key), doc, set_id. Second: set_id, root, links, for the
    sets that have a link.
    """
    docs = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("body")).withColumns({
        "g1": F.coalesce(F.col("doc").cast("long"), F.xxhash64("body")), "g2": F.hash("body")})
    all_rows = written(sketches(docs, ("g1", "g2", "doc"), "body", params), "sketches", folder)
    known = all_rows.filter("set_id is not null")
    sets = written(known.groupBy("set_id").agg(
        F.min(F.struct("g1", "g2")).alias("at"), F.first("sketch").alias("sketch")), "sets", folder)
    small, large = leaves(paths(sets, params), params, folder)
    hub = large.groupBy("key").agg(F.min("set_id").alias("b"))
    stars = large.join(hub, "key").select(F.col("set_id").alias("a"), "b")
    near = connected(bucket_edges(small, sets, params).unionByName(stars), "candidates", folder)
    chosen = near.join(sets.select("set_id", "at"), near.node == sets.set_id).select(
        F.col("at.g1").alias("g1"), F.col("at.g2").alias("g2"), "node", F.col("root").alias("grp"))
    dealt = docs.select("g1", "g2", "body").join(deal(chosen), ["g1", "g2"])
    found = written(verify(dealt, params.similarity, sets_of(params)), "verified", folder)
    links = found.filter("b is null").groupBy("a").agg(F.sum("links").alias("links"))
    classes = connected(found.filter("b is not null").select("a", "b"), "classes", folder)
    return all_rows.select("g1", "g2", "doc", "set_id"), classes.join(
        links, classes.node == links.a).select(F.col("node").alias("set_id"), "root", "links")


def join_documents(docs: DataFrame, params: JoinParams = JoinParams(),
                   folder: str | None = None) -> DataFrame:
    """doc_id, class_id, n_links, n_copies; one row per document.

    ``class_id`` is the smallest id of the class: documents connected by links or
    by equal sets. ``n_links`` counts the other sets with a similarity at the
    threshold or above, ``n_copies`` the other rows with an equal set. A document
    without words (null, empty) is a class of its own without links; its class is
    its id. Where all ids of a class are null, so is its class_id.
    """
    folder = folder or run_folder(docs.sparkSession)
    rows, sets = similar_sets(docs, params, folder)
    placed = rows.join(sets, "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    per_set = placed.filter("root is not null").groupBy("root", "set_id").agg(
        F.min("doc").alias("d"), F.count("*").alias("n"))
    per_class = per_set.groupBy("root").agg(F.min("d").alias("class_id"))
    return (placed.join(per_class, "root", "left")
            .join(per_set.select("set_id", "n"), "set_id", "left")
            .select(F.col("doc").alias("doc_id"),
                    F.when(F.col("root").isNull(), F.col("doc")).otherwise(F.col("class_id"))
                    .alias("class_id"),
                    F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
                    (F.coalesce("n", F.lit(1)) - 1).cast("long").alias("n_copies")))


def one_of_each(docs: DataFrame, params: JoinParams = JoinParams(),
                folder: str | None = None) -> DataFrame:
    """The rows of ``docs`` with one document of each class, all columns kept.

    The document with the smallest (id, hash of text) stays; rows equal in both
    are one document and one row of them stays. Documents without words all stay.
    """
    folder = folder or run_folder(docs.sparkSession)
    renamed, inner, doc_id, text = positional(docs)
    rows, sets = similar_sets(renamed, params, folder, text, doc_id)
    placed = rows.join(sets, "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    first = placed.filter("root is not null").groupBy("root").agg(
        F.min(F.struct("g1", "g2")).alias("k"))
    kept = F.struct("g1", "g2") == F.col("k")
    info = placed.join(first, "root").groupBy("g1", "g2").agg(
        F.max(kept).alias("kept"), F.count("*").alias("n"))
    keyed = renamed.withColumns({
        "g1": F.coalesce(F.col(doc_id).cast("long"), F.xxhash64(text)), "g2": F.hash(text)})
    told = keyed.join(info, ["g1", "g2"], "left").filter("kept is null or kept")
    single = told.filter("n is null or n = 1")
    several = told.filter("n > 1").dropDuplicates(["g1", "g2"])
    return single.unionByName(several).select(*inner).toDF(*docs.columns)
