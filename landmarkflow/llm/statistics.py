"""Text statistics of whole documents, one pass, shared by the quality operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landmarkflow.llm.textbytes import (SPACE, chunks, gram_hashes, mix, prefix_codes, repeated,
                                        runs, span_hashes)

#: Byte classes that are counted. Continuation bytes are those of UTF-8.
CLASSES = ("other", "lower", "upper", "digit", "space", "newline", "symbol", "pipe", "mark",
           "stop", "continuation", "lead")
SYMBOLS = b"#*$%&<>"

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
         "n_bytes", "n_chars_all", "n_upper", "n_lower", "n_digit", "n_pipe", "n_mark", "n_stop",
         "n_distinct_words", "longest_word", "n_capital_words")


def _classes() -> np.ndarray:
    out = np.zeros(256, np.int64)
    for name, low, high in (("lower", 97, 122), ("upper", 65, 90), ("digit", 48, 57),
                            ("continuation", 128, 191), ("lead", 192, 255)):
        out[low:high + 1] = CLASSES.index(name)
    for name, of in (("space", b" \t\x0b\x0c\r"), ("newline", b"\n"), ("symbol", SYMBOLS),
                     ("pipe", b"|"), ("mark", b"!?"), ("stop", b".,;:")):
        out[list(of)] = CLASSES.index(name)
    return out


def _per_row(row: np.ndarray, n: int, weights=None) -> np.ndarray:
    return np.bincount(row, weights, n).astype(np.int64)


def chunk_statistics(data: np.ndarray, at: np.ndarray, gram: int = 5) -> dict:
    """Every statistic of :data:`STATS` for the rows of one chunk."""
    n, lengths = len(at) - 1, np.diff(at)
    classes = _classes()
    row_of = np.repeat(np.arange(n), lengths)
    counts = np.bincount(row_of * len(CLASSES) + classes[data], minlength=n * len(CLASSES))
    of = dict(zip(CLASSES, counts.reshape(n, -1).T))
    prefix = prefix_codes(data)
    start, end, row = runs(~SPACE[data], at)
    words = span_hashes(prefix, start, end)
    n_words = _per_row(row, n)

    salt = mix(np.arange(n, dtype=np.uint64) + np.uint64(77))
    grams, first = gram_hashes(words, row, gram)
    again = first[repeated(grams ^ salt[row[first]])]
    edge = np.zeros(len(words) + gram + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + gram, -1)
    covered = np.cumsum(edge[:len(words)]) > 0

    cut = np.flatnonzero(data == 10)
    line_start = np.sort(np.concatenate([at[:-1], cut + 1]))
    line_end = np.sort(np.concatenate([cut, at[1:]]))
    line_row = np.repeat(np.arange(n), of["newline"] + 1)
    has_word = (np.searchsorted(start, line_end, "left")
                > np.searchsorted(start, line_start, "left"))
    ls, le, lr = line_start[has_word], line_end[has_word], line_row[has_word]
    lines = span_hashes(prefix, ls, le) ^ salt[lr]
    _, kept = np.unique(lines, return_index=True)
    distinct_lines = _per_row(lr[kept], n)
    _, kept = np.unique(words ^ salt[row], return_index=True)

    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, row, end - start)
    capital = (data[start] >= 65) & (data[start] <= 90) if len(start) else np.zeros(0, bool)
    space = of["space"] + of["newline"]
    chars = lengths - of["continuation"]
    return {
        "n_words": n_words, "word_chars": chars - space,
        "n_symbols": of["symbol"] + of["pipe"],
        "n_dup_lines": _per_row(lr, n) - distinct_lines,
        "n_repeat_words": _per_row(row, n, covered), "n_lines": _per_row(lr, n),
        "n_bytes": lengths, "n_chars_all": chars, "n_upper": of["upper"], "n_lower": of["lower"],
        "n_digit": of["digit"], "n_pipe": of["pipe"], "n_mark": of["mark"], "n_stop": of["stop"],
        "n_distinct_words": _per_row(row[kept], n), "longest_word": longest,
        "n_capital_words": _per_row(row, n, capital),
    }


def _batches(passed: int):
    def run(batches):
        for batch in batches:
            for first, last, data, at in chunks(batch.column(passed)):
                stats = chunk_statistics(data, at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(k).slice(first, last - first) for k in range(passed)]
                    + [pa.array(stats[name]) for name in STATS],
                    names=batch.schema.names[:passed] + list(STATS))
    return run


def text_statistics(docs: DataFrame, text: str = "text", keep=("doc_id",)) -> DataFrame:
    """One row per document: the ``keep`` columns and :data:`STATS` as longs.

    Whole texts are read. A null or empty text gives zeros; equal rows give equal
    rows. Other columns of ``docs`` are not read, so their names cannot clash.
    """
    head = docs.select(*[F.col(c) for c in keep], F.col(text).alias("_text"))
    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    schema = ", ".join(fields + [f"{name} bigint" for name in STATS])
    return head.mapInArrow(_batches(len(keep)), schema)
