"""Secret scans: candidate strings, and a random forest that removes false positives.

All of it is DataFrame operations. One expression finds the candidates with the
text between them, features are string expressions, the dictionary is counted
over the whole corpus, and MLlib grows the forest on labelled findings.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A candidate is a run of these characters with a digit in it.
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
KEYWORDS = r"(?i)(key|token|secret|passw|pwd|auth|credential|bearer|private)"
ASSIGNED = r"[=:]\s*[\"'`]?$"
FEATURES = ("length", "case_changes", "digit_changes", "digits", "hex_letters", "upper",
            "distinct", "covered", "path_like", "keyword", "assigned", "quoted", "address",
            "number_only")


@dataclass(frozen=True)
class SecretParams:
    """``max_fit_rows`` bounds the labelled findings the forest is grown on."""

    context: int = 40
    dictionary_words: int = 300
    max_fit_rows: int = 20_000
    trees: int = 20
    depth: int = 5
    threshold: float = 0.5
    seed: int = 5


def candidates(docs: DataFrame, params: SecretParams = SecretParams()) -> DataFrame:
    """doc_id, source, start (code points), candidate, before, after; one row per candidate.

    The texts between the candidates give their places and their neighbouring
    words. Null and empty texts have none; repeated rows give repeated findings.
    """
    slim = docs.select("doc_id", F.col("source").cast("string").alias("source"),
                       F.coalesce("text", F.lit("")).alias("text"))
    found = slim.filter(F.col("text").rlike(CANDIDATE)).select(
        "doc_id", "source", F.regexp_extract_all("text", F.lit(CANDIDATE), 0).alias("hit"),
        F.split("text", CANDIDATE, -1).alias("between"))
    each = found.select(
        "doc_id", "source", F.posexplode(F.arrays_zip(
            "hit", F.transform("between", lambda x: F.right(x, F.lit(params.context))).alias("b"),
            F.slice(F.transform("between", lambda x: F.left(x, F.lit(params.context))), 2,
                    F.size("hit")).alias("a"),
            F.transform("between", F.length).alias("gap"),
            _before("hit", "between").alias("start"))).alias("n", "x"))
    return (each.filter(F.col("x.hit").rlike("[0-9]"))
            .select("doc_id", "source", F.col("x.start").alias("start"),
                    F.col("x.hit").alias("candidate"), F.col("x.b").alias("before"),
                    F.col("x.a").alias("after")))


def _before(hit: str, between: str) -> Column:
    """Start of each candidate: running sum of the lengths in front of it."""
    lengths = F.zip_with(between, F.concat(F.array(F.lit("")), hit),
                         lambda a, b: F.length(a) + F.length(b))
    sums = F.aggregate(
        lengths, F.struct(F.lit(0).cast("int").alias("s"), F.array().cast("array<int>").alias("a")),
        lambda acc, n: F.struct((acc["s"] + n).alias("s"),
                                F.concat(acc["a"], F.array(acc["s"] + n)).alias("a")),
        lambda acc: acc["a"])
    return F.slice(sums, 1, F.size(hit))


def dictionary(docs: DataFrame, params: SecretParams = SecretParams()) -> list[str]:
    """The most frequent short words of the whole corpus; their number is a parameter."""
    words = (docs.select(F.explode(F.regexp_extract_all(
        F.lower("text"), F.lit(r"(?<![a-z])[a-z]{3,6}(?![a-z])"), 0)).alias("w"))
        .groupBy("w").agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "w").limit(params.dictionary_words).collect())
    return sorted(r["w"] for r in words)


def describe(found: DataFrame, words: list[str]) -> DataFrame:
    """Adds :data:`FEATURES` to the rows of :func:`candidates`."""
    c = F.col("candidate")
    n = F.length(c)

    def count(pattern: str) -> Column:
        return F.regexp_count(c, F.lit(pattern))

    spelt = "|".join(sorted(words, key=lambda w: (-len(w), w))) or "(?!)"
    return found.withColumns({
        "length": F.ln(n.cast("double")),
        "case_changes": count("[a-z](?=[A-Z])|[A-Z](?=[a-z])") / n,
        "digit_changes": count("[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])") / n,
        "digits": count("[0-9]") / n,
        "hex_letters": count("[a-f]") / n,
        "upper": count("[A-Z]") / n,
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / n,
        "covered": 1 - F.length(F.regexp_replace(F.lower(c), spelt, "")) / n,
        "path_like": (c.contains("/") | F.coalesce(F.col("source").rlike(
            "(?i)test|example|sample|mock|fixture"), F.lit(False))).cast("double"),
        "keyword": F.col("before").rlike(KEYWORDS).cast("double"),
        "assigned": F.col("before").rlike(ASSIGNED).cast("double"),
        "quoted": (F.col("before").rlike("[\"'`]$") & F.col("after").rlike("^[\"'`]")).cast("double"),
        "address": (F.col("after").startswith("@") | F.col("before").endswith("@")
                    | F.col("before").endswith("//")).cast("double"),
        "number_only": c.rlike("^[0-9-]+$").cast("double"),
    })


def seed_labels(found: DataFrame) -> DataFrame:
    """Findings whose nature is beyond doubt, with ``label`` 1 (secret) or 0.

    Secret: a mixed string of 20 characters or more, assigned in quotes to a name
    with a keyword. Not: card and phone numbers, parts of addresses, and strings
    without a keyword or an assignment in front.
    """
    secret = ((F.col("keyword") > 0) & (F.col("assigned") > 0) & (F.col("quoted") > 0)
              & (F.length("candidate") >= 20) & (F.col("digit_changes") > 0))
    other = ((F.col("number_only") > 0) | (F.col("address") > 0)
             | ((F.col("keyword") == 0) & (F.col("assigned") == 0)))
    return (found.withColumn("label", F.when(secret, 1.0).when(other, 0.0))
            .filter("label is not null"))


def fit_forest(labelled: DataFrame, params: SecretParams = SecretParams()
               ) -> RandomForestClassificationModel | None:
    """A forest on at most ``max_fit_rows`` labelled findings, None without both labels."""
    rows = (labelled.select("label", *FEATURES, F.xxhash64("candidate", "before").alias("_o"))
            .orderBy("_o", "label", *FEATURES).limit(params.max_fit_rows))
    kinds = rows.agg(F.min("label").alias("a"), F.max("label").alias("b")).first()
    if kinds["a"] is None or kinds["a"] == kinds["b"]:
        return None
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(rows)
    return RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=params.trees,
                                  maxDepth=params.depth, seed=params.seed).fit(rows)


def score(found: DataFrame, model: RandomForestClassificationModel | None,
          params: SecretParams = SecretParams()) -> DataFrame:
    """Adds ``score`` and ``is_secret``. Without a model every candidate stays, with score 1."""
    if model is None:
        scored = found.withColumn("score", F.lit(1.0))
    else:
        scored = model.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="x")
                                 .transform(found))
        scored = scored.withColumn("score", vector_to_array("probability")[1]).drop(
            "x", "rawPrediction", "probability", "prediction")
    return scored.withColumn("is_secret", F.col("score") >= params.threshold)
