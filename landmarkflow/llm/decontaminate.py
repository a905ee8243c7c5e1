"""Benchmark decontamination by a positional inverted index over the training texts.

Windows of the benchmark are looked up from their rarest words: the position
lists of the rarest word give the places where a window could start, the list of
the next rarest word, moved by the difference of their offsets, thins them out,
and the remaining places are compared word by word. With a ``slop`` the same
lists give proximity matches. The benchmark is worked off in blocks of bounded
size; every block is held against all documents.

The index is sharded by document, like the files it is made from, and holds the
lists of the words that some window of the block is looked up by.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landmarkflow.llm.keys import fields, positional
from landmarkflow.llm.textbytes import chunks, prefix_codes, runs, span_hashes
from landmarkflow.llm.steps import run_folder, written

#: Bytes of words: digits, letters and everything outside ASCII. A-Z become a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True


@dataclass(frozen=True)
class Params:
    """``window`` words must agree; ``block_windows`` bounds what one pass looks for."""

    window: int = 10
    block_windows: int = 200_000


def words_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word of a chunk."""
    lower = LOWER[data]
    start, end, row = runs(IS_WORD[lower], at)
    return span_hashes(prefix_codes(lower), start, end), row


@dataclass(frozen=True)
class Block:
    """Windows of some benchmark items, as numbers of a sorted vocabulary of word hashes."""

    vocabulary: np.ndarray
    windows: np.ndarray  # one row per window, -1 beyond a short one
    items: tuple  # per window, the ids of the items that hold it

    def numbers(self, words: np.ndarray) -> np.ndarray:
        """Place in the vocabulary, or -1."""
        if not len(self.vocabulary):
            return np.full(len(words), -1, np.int32)
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == words, at, -1).astype(np.int32)


def blocks(benchmark: DataFrame, params: Params):
    """Bounded blocks of items, streamed; items without words give no window."""
    held: dict = {}
    for item in benchmark.select(F.col("item_id").cast("string").alias("item"),
                                 F.col("text").alias("text")).toLocalIterator():
        for _, _, data, at in chunks(pa.array([item["text"]], pa.string()), 1 << 40):
            words, _ = words_of(data, at)
            for k in range(max(len(words) - params.window, 0) + 1 if len(words) else 0):
                held.setdefault(tuple(words[k:k + params.window].tolist()), set()).add(
                    item["item"] or "")
        if len(held) >= params.block_windows:
            yield _block(held, params)
            held = {}
    if held:
        yield _block(held, params)


def _block(held: dict, params: Params) -> Block:
    vocabulary = np.unique(np.array([w for key in held for w in key], np.uint64))
    windows = np.full((len(held), params.window), -1, np.int32)
    for i, key in enumerate(held):
        windows[i, :len(key)] = np.searchsorted(vocabulary, np.array(key, np.uint64))
    return Block(vocabulary, windows, tuple(sorted(v) for v in held.values()))


def word_counts(docs: DataFrame, text: str, block: Block) -> np.ndarray:
    """Corpus frequency of every word of the block, over all documents."""
    def count(batches):
        total = np.zeros(len(block.vocabulary) + 1, np.int64)
        for batch in batches:
            for _, _, data, at in chunks(batch.column(0)):
                total += np.bincount(block.numbers(words_of(data, at)[0]) + 1,
                                     minlength=len(total))
        some = np.flatnonzero(total[1:])
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[1:][some])],
                                         names=["term", "n"])

    rows = (docs.select(text).mapInArrow(count, "term bigint, n bigint")
            .groupBy("term").agg(F.sum("n").alias("n")).collect())  # at most the vocabulary
    out = np.zeros(len(block.vocabulary), np.int64)
    for r in rows:
        out[r["term"]] = r["n"]
    return out


def lookups(spark: SparkSession, block: Block, counts: np.ndarray) -> tuple[DataFrame, np.ndarray]:
    """Per window its rarest word and, if it has another, the next, with their offsets."""
    rows = []
    for i, window in enumerate(block.windows):
        real = window[window >= 0]
        order = sorted(range(len(real)), key=lambda k: (counts[real[k]], real[k], k))
        other = next((k for k in order if real[k] != real[order[0]]), None)
        rows.append((i, int(real[order[0]]), order[0],
                     None if other is None else int(real[other]), other))
    wanted = np.unique([x for r in rows for x in (r[1], r[3]) if x is not None])
    return (spark.createDataFrame(rows, "win int, t1 int, o1 int, t2 int, o2 int"),
            wanted.astype(np.int64))


def build_index(docs: DataFrame, text: str, block: Block, wanted: np.ndarray,
                path: tuple[str, str]) -> DataFrame:
    """Position lists (term, k1, k2, positions) of the wanted words, written and sorted by term."""
    pick = np.zeros(len(block.vocabulary) + 1, bool)
    pick[wanted] = True

    def post(batches):
        for batch in batches:
            k1, k2 = batch.column(0), batch.column(1)
            for first, last, data, at in chunks(batch.column(2)):
                words, row = words_of(data, at)
                term = block.numbers(words)
                place = np.flatnonzero(pick[term])
                begin = np.searchsorted(row, np.arange(last - first), "left")
                order = np.lexsort((place, term[place], row[place]))
                place = place[order]
                r, t = row[place], term[place]
                new = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (t[1:] != t[:-1])]
                                     if len(r) else np.zeros(0, bool))
                lists = pa.ListArray.from_arrays(
                    pa.array(np.r_[new, len(r)].astype(np.int32)),
                    pa.array((place - begin[r]).astype(np.int32)))
                rows = pa.array(r[new] + first)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(t[new].astype(np.int32)), k1.take(rows), k2.take(rows), lists],
                    names=["term", "k1", "k2", "positions"])

    found = docs.select("k1", "k2", text).mapInArrow(
        post, "term int, k1 bigint, k2 bigint, positions array<int>")
    return written(found.sortWithinPartitions("term"), *path)


def places(index: DataFrame, looked: DataFrame, slop: int = 0) -> DataFrame:
    """(k1, k2, win, start): where a window's two rarest words stand at their distance.

    With ``slop`` the second word may be that many words off: a proximity match.
    Places before a text's first word are left out.
    """
    first = (looked.join(index, F.col("t1") == F.col("term"))
             .select("win", "t2", "o1", "o2", "k1", "k2", F.explode("positions").alias("p"))
             .withColumn("start", F.col("p") - F.col("o1")).filter("start >= 0"))
    single = first.filter("t2 is null").select("k1", "k2", "win", "start")
    other = index.select(F.col("term").alias("t2"), "k1", "k2", "positions")
    near = (F.array_contains("positions", F.col("start") + F.col("o2")) if not slop else
            F.exists("positions", lambda p: F.abs(p - F.col("start") - F.col("o2")) <= slop))
    both = first.join(other, ["t2", "k1", "k2"]).filter(near).select("k1", "k2", "win", "start")
    return both.unionByName(single)


def _check(batch: pa.RecordBatch, n_keep: int, text: int, found: int, block: Block):
    """Rows of one batch with every candidate place compared word by word."""
    width = block.windows.shape[1]
    full = np.append(block.vocabulary, np.uint64(0))[block.windows]
    for first, last, data, at in chunks(batch.column(text)):
        n = last - first
        words, row = words_of(data, at)
        n_words = np.bincount(row, minlength=n)
        begin = np.concatenate([[0], np.cumsum(n_words)])
        lists = batch.column(found).slice(first, n)
        per = np.nan_to_num(np.asarray(lists.value_lengths().fill_null(0)), nan=0).astype(np.int64)
        packed = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        doc = np.repeat(np.arange(n), per)
        win, start = packed >> 32, packed & 0xFFFFFFFF
        length = (block.windows[win] >= 0).sum(axis=1)
        inside = start + length <= n_words[doc]
        doc, win, start, length = (x[inside] for x in (doc, win, start, length))
        place = begin[doc] + start
        span = np.arange(width)
        seen = words[np.minimum(place[:, None] + span, max(len(words) - 1, 0))] \
            if len(words) else np.zeros((len(place), width), np.uint64)
        same = ((seen == full[win]) | (span >= length[:, None])).all(axis=1)
        doc, win, place, length = (x[same] for x in (doc, win, place, length))
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, place, 1)
        np.add.at(edge, place + length, -1)
        hit = np.cumsum(edge[:-1]) > 0
        n_hit = np.bincount(row, hit, n).astype(np.int64)
        items = [() for _ in range(n)]
        for d, w in {*zip(doc.tolist(), win.tolist())}:
            items[d] = {*items[d], *block.items[w]}
        yield pa.RecordBatch.from_arrays(
            [batch.column(k).slice(first, n) for k in range(n_keep)]
            + [pa.array(n_words.astype(np.int64)), pa.array(n_hit),
               pa.array([sorted(x) for x in items], pa.list_(pa.string())),
               pa.array([_runs_of(hit[begin[i]:begin[i + 1]]) if n_hit[i] else []
                         for i in range(n)], pa.list_(pa.int32()))],
            names=[*batch.schema.names[:n_keep], "n_words", "n_hit", "items", "hit_runs"])


def _runs_of(hit: np.ndarray) -> list:
    """Start and end of every run of hit words, one after the other."""
    return np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8))).tolist()


def _block_result(docs: DataFrame, keep, text: str, block: Block, name: str, folder: str):
    spark = docs.sparkSession
    looked, wanted = lookups(spark, block, word_counts(docs, text, block))
    index = build_index(docs, text, block, wanted, (f"index_{name}", folder))
    found = (places(index, looked)
             .select("k1", "k2", (F.shiftleft(F.col("win").cast("long"), 32)
                                  + F.col("start")).alias("place"))
             .groupBy("k1", "k2").agg(F.collect_set("place").alias("found")))
    joined = docs.join(found, ["k1", "k2"], "left").select(*keep, text, "found")
    schema = ", ".join([*fields(docs, keep), "n_words bigint", "n_hit bigint",
                        "items array<string>", "hit_runs array<int>"])

    def check(batches):
        for batch in batches:
            yield from _check(batch, len(keep), len(keep), len(keep) + 1, block)

    return joined.mapInArrow(check, schema)


def _empty(docs: DataFrame, keep, text: str) -> DataFrame:
    """The result when there is no window at all."""
    nothing = Block(np.zeros(0, np.uint64), np.full((0, 1), -1, np.int32), ())
    schema = ", ".join([*fields(docs, keep), "n_words bigint", "n_hit bigint",
                        "items array<string>", "hit_runs array<int>"])

    def check(batches):
        for batch in batches:
            yield from _check(batch, len(keep), len(keep), len(keep) + 1, nothing)

    return docs.select(*keep, text, F.lit(None).cast("array<bigint>").alias("found")).mapInArrow(
        check, schema)


def matches(docs: DataFrame, benchmark: DataFrame, params: Params = Params(),
            keep=("doc_id",), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per document: ``keep``, n_words, n_hit, items (sorted ids as strings), hit_runs.

    ``hit_runs`` holds start and end of each run of hit words. A null text has no
    words; items without words match nothing, and an empty benchmark nothing at
    all. Equal rows give equal results. Several blocks are combined per row key.
    """
    keep, folder = list(keep), run_folder(docs.sparkSession)
    docs = docs.withColumns({"k1": F.xxhash64(doc_id), "k2": F.xxhash64(text)})
    parts = []
    for number, block in enumerate(blocks(benchmark, params)):
        part = _block_result(docs, [*keep, "k1", "k2"], text, block, str(number), folder)
        parts.append(part)
    if not parts:
        return _empty(docs, keep, text)
    if len(parts) == 1:
        return parts[0].drop("k1", "k2")
    kept = [written(p, f"block_{i}", folder) for i, p in enumerate(parts)]
    hits = kept[0].select("k1", "k2", "items", "hit_runs")
    for p in kept[1:]:
        hits = hits.unionByName(p.select("k1", "k2", "items", "hit_runs"))
    hits = hits.filter("size(items) > 0").dropDuplicates().groupBy("k1", "k2").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_distinct(F.flatten(F.collect_list(F.expr(
            "transform(sequence(0, cast(size(hit_runs) / 2 as int) - 1), "
            "i -> struct(hit_runs[2 * i] as a, hit_runs[2 * i + 1] as b))"))))
        .alias("spans"))
    words = F.array_distinct(F.flatten(F.transform(
        "spans", lambda s: F.sequence(s["a"], s["b"] - 1))))
    hits = hits.select("k1", "k2", "items", F.array_sort(words).alias("places"))
    return (kept[0].drop("items", "n_hit", "hit_runs").join(hits, ["k1", "k2"], "left")
            .select(*keep, "n_words", F.coalesce(F.size("places"), F.lit(0)).cast("long")
                    .alias("n_hit"), F.coalesce("items", F.array().cast("array<string>"))
                    .alias("items"), F.coalesce(_spans("places"), F.array().cast("array<int>"))
                    .alias("hit_runs")))


def _spans(places: str):
    """Runs of a sorted array of word places as start, end, start, end."""
    starts = F.filter(places, lambda p: ~F.array_contains(places, p - 1))
    ends = F.filter(places, lambda p: ~F.array_contains(places, p + 1))
    return F.flatten(F.zip_with(starts, ends, lambda a, b: F.array(a, b + 1)))


def digest(found: DataFrame) -> DataFrame:
    """Contract columns: counts, and the items as a hash."""
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, params: Params = Params()) -> DataFrame:
    """The rows of ``docs`` without a hit word, with all their columns."""
    renamed, inner, doc_id, text = positional(docs)
    found = matches(renamed, benchmark, params, keep=inner, text=text, doc_id=doc_id)
    return found.filter("n_hit = 0").select(*inner).toDF(*docs.columns)
