"""Bottom-k fingerprints of word shingles: DataFrame functions only.

A fingerprint keeps the ``k`` smallest of the hashes of a text's shingles. The smallest
of a union are among the smallest of its parts, so fingerprints of parts merge into that
of the whole. The smallest hashes of a union are an even draw of all its shingles: the
share of them that both sides hold estimates resemblance, and how far they reach into
the range of hashes tells how many different shingles there are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Hashes are numbers from 0 to ``RANGE`` - 1, written in ``DIGITS`` hexadecimal digits.
BITS, DIGITS = 60, 15
RANGE = float(1 << BITS)


@dataclass(frozen=True)
class PrintParams:
    """``k`` smallest hashes of shingles of ``words`` words; a merge takes ``fan_in`` at a time."""

    k: int = 128
    words: int = 5
    fan_in: int = 32


def words_of(text) -> Column:
    """Words of a text in lower case; a null text has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), 0)


def smallest(hashes: Column, params: PrintParams) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, params.k)


def shingle_prints(words: str, params: PrintParams) -> Column:
    """The fingerprint (ascending array of hashes) of the array column ``words``.

    Fewer words than a shingle has are one shingle; no words have none.
    """
    last = F.greatest(F.size(words) - params.words, F.lit(0))
    each = F.transform(F.sequence(F.lit(0), last), lambda i: F.shiftrightunsigned(
        F.xxhash64(*[F.get(words, i + d) for d in range(params.words)]), 64 - BITS))
    return F.when(F.size(words) > 0, smallest(each, params)).otherwise(
        F.array().cast("array<bigint>"))


def shown(hashes) -> Column:
    """A fingerprint as a string."""
    return F.array_join(F.transform(hashes, lambda h: F.lpad(F.hex(h), DIGITS, "0")), "")


def read(fingerprint) -> Column:
    """The hashes of a fingerprint string."""
    fingerprint = F.col(fingerprint) if isinstance(fingerprint, str) else fingerprint
    count = (F.length(fingerprint) / DIGITS).cast("int")
    at = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(
        F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.conv(
        F.substring(fingerprint, i * DIGITS + 1, F.lit(DIGITS)), 16, 10).cast("bigint"))


def merged(a, b, params: PrintParams = PrintParams()) -> Column:
    """Fingerprint of the union of two texts' shingles."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, params.k)


def common(a, b, params: PrintParams = PrintParams()) -> Column:
    """How many of the union's smallest hashes both sides hold."""
    return F.size(F.array_intersect(F.array_intersect(a, b), merged(a, b, params)))


def resemblance(a, b, params: PrintParams = PrintParams()) -> Column:
    """Estimated share of common shingles among all; 1 for two sides without any."""
    of = F.size(merged(a, b, params))
    return F.when(of == 0, F.lit(1.0)).otherwise(common(a, b, params) / F.nullif(of, F.lit(0)))


def distinct_shingles(a, params: PrintParams = PrintParams()) -> Column:
    """Estimated number of different shingles; exact below ``k``."""
    full = F.size(a) >= params.k
    reach = (F.element_at(F.when(full, a), params.k).cast("double") + 1.0) / RANGE
    return F.when(full, (params.k - 1) / reach).otherwise(F.size(a).cast("double"))


def containment(a, b, params: PrintParams = PrintParams()) -> Column:
    """Estimated share of the first side's shingles that the second has; 1 if it has none."""
    both = resemblance(a, b, params) * distinct_shingles(merged(a, b, params), params)
    own = distinct_shingles(a, params)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(
        F.least(F.lit(1.0), both / F.nullif(own, F.lit(0.0))))


def fingerprints(docs: DataFrame, params: PrintParams = PrintParams(), text: str = "text",
                 keep=("doc_id",)) -> DataFrame:
    """The ``keep`` columns and ``prints`` of every whole text.

    Null and empty texts have empty prints; equal texts have equal prints, repeated rows
    repeated results. Other columns are not read.
    """
    slim = docs.select(*[F.col(c) for c in keep], words_of(F.col(text)).alias("_words"))
    return slim.select(*keep, shingle_prints("_words", params).alias("prints"))


def merge_parts(parts: DataFrame, keys, params: PrintParams = PrintParams()) -> DataFrame:
    """``keys`` and ``prints``: the fingerprints of each key's parts as one.

    Equal parts count once, then about ``fan_in`` parts are merged at a time, round by
    round, so that a key with any number of parts is never gathered. Null keys are a key;
    a key whose parts are all empty has empty prints.
    """
    keys = list(keys)
    parts = parts.select(*keys, "prints").distinct()
    most = parts.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    together = F.flatten(F.collect_set("prints"))
    while most > params.fan_in:
        most = -(-most // params.fan_in)
        share = F.pmod(F.xxhash64("prints"), F.lit(most)).alias("_share")
        parts = parts.groupBy(*keys, share).agg(smallest(together, params).alias("prints")).drop(
            "_share").distinct()
    return parts.groupBy(*keys).agg(smallest(together, params).alias("prints"))


def _ordered(docs: DataFrame) -> tuple[DataFrame, Column]:
    """Keys of the documents in order, and the first key of every piece of that order.

    A key is the id and a hash of the text: ties of ids go by the text, and rows equal in
    both can stand in any order. There are four pieces for a shuffle partition, so their
    first keys, held as one value of nested arrays, are bounded by the cluster's size.
    """
    spark = docs.sparkSession
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"))
    keyed = docs.select("doc_id", "text", key.alias("_key"))
    firsts = (keyed.select("_key").repartitionByRange(n, "_key")
              .select("_key", F.spark_partition_id().alias("_p"))
              .groupBy("_p").agg(F.min("_key").alias("_key")))
    bounds = F.array_sort(F.collect_set("_key"))
    step = max(int(n ** 0.5), 1)
    nested = F.transform(F.sequence(F.lit(0), F.greatest(F.size("_b") - 1, F.lit(0)), F.lit(step)),
                         lambda i: F.slice("_b", i + 1, step))
    rows = firsts.agg(bounds.alias("_b")).select(nested.alias("_b"))
    tops = F.transform("_b", lambda x: F.get(x, F.lit(0)))
    return keyed, rows.select(F.struct(F.col("_b").alias("all"), tops.alias("tops"))).scalar()


def with_next(docs: DataFrame, params: PrintParams = PrintParams()) -> DataFrame:
    """doc_id, text, prints, next_text, next_prints: each document and the next one.

    Documents go by id, then by a hash of the text, null ids first; after the last comes
    the first. The texts are shuffled once, to pieces of that order; the first document
    of a piece goes to the end of the piece before as well. Prints are made behind the
    shuffle, so it carries texts only.
    """
    keyed, bounds = _ordered(docs)
    group = F.size(F.filter("_b.tops", lambda b: b <= F.col("_key"))) - 1
    inner = F.get("_b.all", F.col("_group"))
    step = F.size(F.get("_b.all", F.lit(0)))
    placed = (keyed.select("*", bounds.alias("_b"))
              .select("*", group.alias("_group"))
              .select("*", (F.size(F.filter(inner, lambda b: b <= F.col("_key"))) - 1)
                      .alias("_at")))
    piece = F.col("_group") * step + F.col("_at")
    last = F.size(F.flatten("_b.all")) - 1
    is_first = F.get(inner, F.col("_at")) == F.col("_key")
    before = F.when(is_first, F.when(piece > 0, piece - 1).otherwise(last))
    copies = placed.select(
        "doc_id", "text", "_key",
        F.explode(F.array(F.struct(piece.alias("piece"), F.lit(0).alias("ghost")),
                          F.struct(before.alias("piece"), F.lit(1).alias("ghost")))).alias("_x"))
    dealt = (copies.filter("_x.piece is not null")
             .select("doc_id", "text", "_key", F.col("_x.piece").alias("_piece"),
                     F.col("_x.ghost").alias("_ghost")).repartition("_piece"))
    printed = fingerprints(dealt, params, keep=("doc_id", "text", "_key", "_piece", "_ghost"))
    order = Window.partitionBy("_piece").orderBy("_ghost", "_key")
    ahead = printed.select("doc_id", "text", "prints", "_ghost",
                           F.lead("text").over(order).alias("next_text"),
                           F.lead("prints").over(order).alias("next_prints"))
    return ahead.filter("_ghost = 0").drop("_ghost")


def edited_report(docs: DataFrame, params: PrintParams = PrintParams()) -> DataFrame:
    """Every document beside its edited text, whose second half is the next one's beginning.

    Of ``n_chars`` code points the last ``floor(n_chars / 2)`` give way to as many first
    ones of the next document (or all of it). Null texts are empty. Besides the prints'
    likeness: estimated numbers of different shingles, and the share of the document's
    shingles that the edited text holds.
    """
    empty = F.lit("")
    pairs = with_next(docs.select("doc_id", F.coalesce("text", empty).alias("text")), params)
    half = F.expr("char_length(text) div 2").cast("int")
    cut = pairs.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), "prints",
                       "next_prints", F.concat(
                           F.left("text", F.char_length("text") - half),
                           F.left(F.coalesce("next_text", empty), half)).alias("edited"))
    both = fingerprints(cut.withColumnRenamed("prints", "own"), params, "edited",
                        ("doc_id", "n_chars", "own", "next_prints", "edited"))
    return both.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        shown("own").alias("fingerprint"), shown("prints").alias("edited_fingerprint"),
        resemblance("own", "prints", params).alias("near_edited"),
        resemblance("own", "next_prints", params).alias("near_next"),
        distinct_shingles(F.col("own"), params).alias("n_shingles"),
        containment(F.col("own"), F.col("prints"), params).alias("kept_share"))
