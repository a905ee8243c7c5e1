"""Registration of queries by name."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from landmarkflow.functions.scalars import scaled_round
from landmarkflow.plans.workflow import Workflow
from landmarkflow.sources.fixtures import FIXTURE_CONFIG, Fixture
from landmarkflow.sources.tables import run_folder

QUERIES = {}


def query(name: str, digits: int | None = None):
    """Register ``fn(context) -> DataFrame``; ``digits`` rounds its double columns,
    as sums of doubles differ in the last digits with the order of addition."""
    def wrap(fn):
        def run(spark, sf_dir):
            df = fn(Context(spark, sf_dir))
            return rounded(df, digits) if digits is not None else df
        QUERIES[name] = run
        return fn
    return wrap


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    return df.select(*[
        scaled_round(F.col(f"`{f.name}`"), digits).alias(f.name)
        if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`") for f in df.schema])


class Context:
    """What a query starts from: the fixture views and the workflow on them."""

    def __init__(self, spark, sf_dir: str):
        self.spark = spark
        self.fx = Fixture(spark, sf_dir)
        self.cfg = FIXTURE_CONFIG

    @cached_property
    def wf(self) -> Workflow:
        return Workflow(self.fx.clinical, self.cfg, run_folder(self.spark))

    @property
    def all_signals(self) -> DataFrame:
        """Raw events of every type as one long numeric relation."""
        return self.fx.events.select("stay_id", F.col("event_type").alias("feature_name"),
                                     F.col("ts").alias("t"), "value")
